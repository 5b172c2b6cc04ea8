"""Pair classification queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftmark.functions.pairs import date, numeric, text
from driftmark.operators.classify import (
    FLAGS,
    classify_bits,
    classify_counts,
    compare_dates,
    expand_flags,
    flag_text,
    start_label,
)
from driftmark.sources.pair_fixture import pairs

IDS = ("template", "pair_key")


def _classified(spark, sf_dir):
    return classify_bits(pairs(spark, sf_dir), "input1", "input2", "output")


def _counted(spark, sf_dir):
    return classify_counts(pairs(spark, sf_dir), ["template"], "input1", "input2", "output")


def pair_rows(spark, sf_dir):
    return _classified(spark, sf_dir).select(
        *IDS, F.col("PredClassify").alias("label"), flag_text(F.col("flag_bits")).alias("flags")
    )


def pair_labels(spark, sf_dir):
    """Pairs counted by template and label."""
    return (
        _counted(spark, sf_dir)
        .groupBy("template", F.col("PredClassify").alias("label"))
        .agg(F.sum("n").alias("n"))
    )


def pair_flags(spark, sf_dir):
    kinds = expand_flags(_counted(spark, sf_dir))
    return kinds.groupBy("template").agg(*(F.sum(F.col(f) * F.col("n")).alias(f) for f in FLAGS))


def pair_label_crosstab(spark, sf_dir):
    labels = ["sm", "concatenate", "derivedconcat", "numeric reformat", "datereformat",
              "stringreformat", "masking", "derived"]
    wide = (
        _counted(spark, sf_dir)
        .groupBy("template")
        .pivot("PredClassify", labels)
        .agg(F.sum("n"))
        .na.fill(0)
    )
    return wide.toDF("template", *(x.replace(" ", "_") for x in labels))


def pair_concat(spark, sf_dir):
    label = start_label(F.col("input1"), F.col("input2"), F.col("output"))
    return pairs(spark, sf_dir).select(*IDS, label.alias("label"))


def pair_numeric(spark, sf_dir):
    verdict = (
        pairs(spark, sf_dir)
        .withColumn("v", numeric.compare_numbers(F.col("input1"), F.col("output")))
        .where(F.col("v").isNotNull())
    )
    return verdict.select(
        *IDS, "v.label", "v.del_beg", "v.ins_beg", "v.del_end", "v.ins_end"
    )


def pair_date(spark, sf_dir):
    """Layout and components of both sides, where both are dates."""
    a, out = F.col("input1"), F.col("output")
    both = F.struct(
        date.date_parts(date.rewrite_date(a, layout=True)).alias("pa"),
        date.date_parts(date.rewrite_date(out, layout=True)).alias("po"),
    )
    # As the output of a generator the parts are not worked out again by the filter on them.
    step = pairs(spark, sf_dir).select(*IDS, F.inline_outer(F.array(both)))
    step = step.where(F.col("pa").isNotNull() & F.col("po").isNotNull())
    shown = []
    for name in date.PARTS:
        for side in ("pa", "po"):
            text = F.nullif(date.part(F.col(side), name), F.lit(""))
            shown.append(text.alias(f"{'in' if side == 'pa' else 'out'}_{name}"))
    return step.select(
        *IDS,
        date.part_layout(F.col("pa")).alias("in_layout"),
        date.part_layout(F.col("po")).alias("out_layout"),
        *shown,
    )


def pair_date_change(spark, sf_dir):
    """The date verdict alone, whatever the other steps say."""
    judged = compare_dates(pairs(spark, sf_dir), "input1", "output")
    return judged.select(
        *IDS,
        "date_label",
        flag_text(F.coalesce(F.col("date_bits"), F.lit(0).cast("bigint"))).alias("flags"),
    )


def pair_text(spark, sf_dir):
    """Pairs that differ in outer blanks only."""
    step = pairs(spark, sf_dir).withColumn(
        "v", text.blank_change(F.col("input1"), F.col("output"))
    )
    step = step.where((F.col("input1") != F.col("output")) & F.col("v").isNotNull())
    return step.select(*IDS, "v.ins_beg", "v.del_beg", "v.ins_end", "v.del_end")


def pair_mask(spark, sf_dir):
    step = pairs(spark, sf_dir).where(F.col("input1") != F.col("output"))
    return step.select(
        *IDS, text.is_masked(F.col("input1"), F.col("output")).alias("masked")
    )


QUERIES = {
    f.__name__: f
    for f in (
        pair_labels,
        pair_rows,
        pair_flags,
        pair_label_crosstab,
        pair_concat,
        pair_numeric,
        pair_date,
        pair_date_change,
        pair_text,
        pair_mask,
    )
}

# ---- SQL twins -------------------------------------------------------------------------

_ISO = "strftime(o_orderdate, '%Y-%m-%d')"


def _template(table: str, key: str, name: str, a: str, b: str, out: str) -> str:
    return (
        f"SELECT '{name}' AS template, {key} AS pair_key, {a} AS i1, {b} AS i2, {out} AS o "
        f"FROM {table}"
    )


def _part(*args):
    return _template("part", "p_partkey", *args)


def _orders(*args):
    return _template("orders", "o_orderkey", *args)


def _customer(*args):
    return _template("customer", "c_custkey", *args)


_SIZE = "CAST(p_size AS VARCHAR)"
_PRICE = "CAST(o_totalprice AS DECIMAL(18,2))"
PAIRS = "pairs AS (\n  " + "\n  UNION ALL ".join(
    (
        _part("same", "p_name", "''", "p_name"),
        _part("concat", "p_brand", "p_type", "p_brand || p_type"),
        _part("concat_other", "p_brand", "p_type", "p_name"),
        _part("zero_pad", _SIZE, "''", f"lpad({_SIZE}, 6, '0')"),
        _part("num_other", _SIZE, "''", "CAST(p_size + 1 AS VARCHAR)"),
        _part("unrelated", "p_name", "''", "p_type"),
        _part("to_empty", "p_name", "''", "''"),
        _orders(
            "dec_trim", f"CAST({_PRICE} AS VARCHAR)", "''", f"CAST({_PRICE} AS VARCHAR) || '0'"
        ),
        _orders("date_sep", _ISO, "''", "strftime(o_orderdate, '%Y/%m/%d')"),
        _orders("date_order", _ISO, "''", "strftime(o_orderdate, '%m-%d-%Y')"),
        _orders("date_short_year", _ISO, "''", "strftime(o_orderdate, '%y-%m-%d')"),
        _orders("date_unpadded", _ISO, "''", "strftime(o_orderdate, '%Y-%-m-%-d')"),
        _orders(
            "date_shift", _ISO, "''",
            "strftime(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH, '%Y-%m-%d')",
        ),
        _orders("time_12h", f"{_ISO} || ' 10:30:00'", "''", f"{_ISO} || ' 22:30:00'"),
        _customer("blanks", "c_name", "''", "'  ' || c_name || ' '"),
        _customer("mask", "c_name", "''", "'XXXX' || substr(c_name, 5)"),
    )
) + ")"

_START = """CASE WHEN i1 <> '' AND i2 <> '' AND o <> '' AND i1 || i2 <> o THEN 'derivedconcat'
  WHEN i1 <> '' AND i2 <> '' AND o <> '' AND i1 <> o THEN 'concatenate'
  WHEN i1 = o THEN 'sm' ELSE 'not sm' END"""

# One row per distinct text: number kind and digit groups, date layout and components.
_TOK = (
    r"^(?:(\d{1,4})([-./])(\d{1,2})([-./])(\d{1,4}))?( ?)"
    r"(?:(\d{1,2}):(\d{1,3})(?::(\d{1,3}))?(?: ([AP]M|[ap]m))?)?$"
)
_NUM = r"^([+-]?)([0-9]*)(\.?)([0-9]*)$"
_N = "CAST(nullif({}, '') AS INTEGER)"
_A, _B, _C = (_N.format(x) for x in ("t.a", "t.b", "t.c"))


def _day_ok(day_text: str, day: str, month_text: str, month: str) -> str:
    return (
        f"(length({day_text}) <= 2 AND length({month_text}) <= 2 AND {month} BETWEEN 1 AND 12 "
        f"AND {day} BETWEEN 1 AND (CASE WHEN {month} = 2 THEN 29 "
        f"WHEN {month} IN (4, 6, 9, 11) THEN 30 ELSE 31 END))"
    )


def _year_ok(text: str) -> str:
    return f"(length({text}) = 2 OR (length({text}) = 4 AND left({text}, 2) >= '16'))"


_LEAP = """CASE WHEN length(t.c) = 2 THEN t.c <> '00' AND {c} % 4 = 0
  WHEN right(t.c, 2) = '00' THEN CAST(left(t.c, 2) AS INTEGER) % 4 = 0 ELSE {c} % 4 = 0 END""".format(
    c=_C
)

_TEXTS = rf""",
texts AS (SELECT DISTINCT s FROM (SELECT i1 AS s FROM pairs UNION ALL SELECT o FROM pairs)),
cut AS (
  SELECT s, regexp_extract(s, '{_NUM}', ['sign', 'i', 'dot', 'd']) AS n,
    s <> '' AND regexp_matches(s, '{_NUM}') AS numish,
    regexp_extract(s, '{_TOK}',
      ['a', 's1', 'b', 's2', 'c', 'blank', 'hh', 'mi', 'ss', 'ampm']) AS t,
    regexp_matches(s, '{_TOK}') AS dateish
  FROM texts),
judged AS (
  SELECT s, t,
    CASE WHEN NOT numish THEN NULL WHEN n.dot = '.' AND n.d <> '' THEN 'float'
         WHEN n.i <> '' AND n.dot = '' THEN 'int' END AS kind,
    length(n.i) AS ilen, length(n.d) AS dlen,
    CASE WHEN NOT dateish THEN NULL
      WHEN (t.blank = ' ') <> (t.a <> '' AND t.hh <> '') THEN NULL
      WHEN t.hh <> '' AND ({_N.format('t.hh')} > 23 OR {_N.format('t.mi')} > 59
        OR (t.ss <> '' AND {_N.format('t.ss')} > 59)
        OR (t.ampm <> '' AND {_N.format('t.hh')} > 12)) THEN NULL
      WHEN t.a = '' THEN 'time'
      WHEN t.s1 <> t.s2 THEN NULL
      WHEN {_year_ok('t.a')} AND {_day_ok('t.c', _C, 't.b', _B)} THEN 'ymd'
      WHEN {_year_ok('t.c')} AND {_day_ok('t.b', _B, 't.a', _A)} THEN 'mdy'
      WHEN {_year_ok('t.c')} AND {_day_ok('t.a', _A, 't.b', _B)}
        AND NOT ({_A} = 29 AND {_B} = 2 AND NOT ({_LEAP})) THEN 'dmy'
      WHEN {_year_ok('t.a')} AND {_day_ok('t.b', _B, 't.c', _C)} THEN 'ydm'
    END AS layout
  FROM cut),
known AS (
  SELECT s, kind, ilen, dlen, layout,
    CASE WHEN layout IN ('ymd', 'ydm') THEN t.a WHEN layout IN ('mdy', 'dmy') THEN t.c END AS yr,
    CASE WHEN layout IN ('ymd', 'dmy') THEN t.b WHEN layout = 'mdy' THEN t.a
         WHEN layout = 'ydm' THEN t.c END AS mm,
    CASE WHEN layout IN ('mdy', 'ydm') THEN t.b WHEN layout = 'ymd' THEN t.c
         WHEN layout = 'dmy' THEN t.a END AS dd,
    CASE WHEN layout IS NOT NULL THEN nullif(t.hh, '') END AS hh,
    CASE WHEN layout IS NOT NULL THEN nullif(t.mi, '') END AS mi,
    CASE WHEN layout IS NOT NULL THEN nullif(t.ss, '') END AS ss,
    CASE WHEN layout IS NOT NULL THEN nullif(t.s1, '') END AS delim
  FROM judged),
sides AS (
  SELECT p.*, x.kind AS k1, y.kind AS k2, x.ilen AS il1, y.ilen AS il2, x.dlen AS dl1,
    y.dlen AS dl2, x.layout AS lay1, y.layout AS lay2,
    CASE WHEN length(x.yr) = 4 THEN x.yr END AS yyyy1,
    CASE WHEN length(y.yr) = 4 THEN y.yr END AS yyyy2,
    CASE WHEN length(x.yr) = 2 THEN x.yr END AS yy1,
    CASE WHEN length(y.yr) = 2 THEN y.yr END AS yy2,
    x.mm AS mm1, y.mm AS mm2, x.dd AS dd1, y.dd AS dd2, x.hh AS hh1, y.hh AS hh2,
    x.mi AS mi1, y.mi AS mi2, x.ss AS ss1, y.ss AS ss2, x.delim AS delim1, y.delim AS delim2
  FROM pairs p JOIN known x ON x.s = p.i1 JOIN known y ON y.s = p.o)"""

_SAME_INT = """(coalesce(TRY_CAST(i1 AS INTEGER), 0) = coalesce(TRY_CAST(o AS INTEGER), 0))"""
_SAME_FLOAT = "(TRY_CAST(i1 AS FLOAT) = TRY_CAST(o AS FLOAT))"
_NUM_LABEL = f"""CASE WHEN k1 IS NULL OR k2 IS NULL THEN NULL
  WHEN k1 = 'int' AND k2 = 'int' AND NOT {_SAME_INT} THEN 'derived'
  WHEN NOT (k1 = 'int' AND k2 = 'int') AND NOT {_SAME_FLOAT} THEN 'derived'
  WHEN i1 = o THEN 'sm' ELSE 'numeric reformat' END"""
_LEN1 = "(CASE WHEN k1 = 'int' AND k2 = 'int' THEN length(i1) ELSE il1 END)"
_LEN2 = "(CASE WHEN k1 = 'int' AND k2 = 'int' THEN length(o) ELSE il2 END)"
_BOTH = "(lay1 IS NOT NULL AND lay2 IS NOT NULL)"


def _int(c: str) -> str:
    return f"coalesce(CAST({c} AS INTEGER), 0)"


def _diff(c: str) -> str:
    return f"({c}1 IS NOT NULL AND {c}2 IS NOT NULL AND {_int(c + '1')} <> {_int(c + '2')})"


def _spelling(c: str) -> str:
    return (
        f"({_int(c + '1')} = {_int(c + '2')} AND "
        f"(({c}1 IS NULL) <> ({c}2 IS NULL) OR coalesce(length({c}1) <> length({c}2), FALSE)))"
    )


_NOYEAR1 = "(yyyy1 IS NULL AND yy1 IS NULL)"
_NOYEAR2 = "(yyyy2 IS NULL AND yy2 IS NULL)"
_TWELVE = f"(abs({_int('hh1')} - {_int('hh2')}) = 12)"
_DATE_RULES = {
    "YYYYChngFlag": f"""{_diff('yyyy')} OR (yyyy1 IS NOT NULL AND {_NOYEAR2})
      OR (yyyy2 IS NOT NULL AND {_NOYEAR1})
      OR (yyyy1 IS NOT NULL AND yy2 IS NOT NULL AND right(yyyy1, 2) <> yy2)""",
    "YYChngFlag": f"""{_diff('yy')} OR (yy1 IS NOT NULL AND {_NOYEAR2} AND yy1 <> '00')
      OR (yy2 IS NOT NULL AND {_NOYEAR1} AND yy2 <> '00')
      OR (yy1 IS NOT NULL AND yyyy2 IS NOT NULL AND right(yyyy2, 2) <> yy1)""",
    "MMChngFlag": _diff("mm"),
    "DDChngFlag": _diff("dd"),
    "HrChngFlag": f"{_diff('hh')} AND NOT {_TWELVE}",
    "MinChngFlag": _diff("mi"),
    "SecChngFlag": _diff("ss"),
    "YYYYFrmtChngFlag": "yyyy1 IS NOT NULL AND yy2 IS NOT NULL AND right(yyyy1, 2) = yy2",
    "YYFrmtChngFlag": f"""(yy1 = '00' AND {_NOYEAR2}) OR (yy2 = '00' AND {_NOYEAR1})
      OR (yy1 IS NOT NULL AND yyyy2 IS NOT NULL AND right(yyyy2, 2) = yy1)""",
    "MMFrmtChngFlag": _spelling("mm"),
    "DDFrmtChngFlag": _spelling("dd"),
    "DelimFrmtChngFlag": "delim1 IS DISTINCT FROM delim2",
    "HrFrmtChngFlag": f"{_spelling('hh')} OR ({_diff('hh')} AND {_TWELVE})",
    "MinFrmtChngFlag": _spelling("mi"),
    "SecFrmtChngFlag": _spelling("ss"),
    "DateFrmtChngFlag": " AND ".join(
        f"{c}1 IS NOT DISTINCT FROM {c}2"
        for c in ("yyyy", "yy", "mm", "dd", "hh", "mi", "ss", "delim")
    ),
}
_TRIM = r"regexp_replace({}, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')"
_LEAD = r"(length({0}) - length(regexp_replace({0}, '^\s+', '')))"
_TRAIL = r"(length({0}) - length(regexp_replace({0}, '\s+$', '')))"
# Excess of every character of the output over the first input, for characters with excess.
_MASKED = """(len(list_filter(list_distinct(string_split(o, '')),
    lambda c: c <> '' AND (length(o) - length(replace(o, c, '')))
                        > (length(i1) - length(replace(i1, c, ''))))) = 1
  AND len(list_filter(['X', 'Y', 'Z'],
    lambda c: (length(o) - length(replace(o, c, '')))
            - (length(i1) - length(replace(i1, c, ''))) >= 2)) = 1)"""

_CLASSIFIED = (
    "WITH "
    + PAIRS
    + _TEXTS
    + ",\nflagged AS (SELECT *,\n  "
    + f"{_START} AS l0, {_NUM_LABEL} AS ln,\n  "
    + ",\n  ".join(
        f"({_BOTH} AND i1 <> o AND coalesce({rule}, FALSE)) AS {name}"
        for name, rule in _DATE_RULES.items()
    )
    + f""",
  {_TRIM.format('i1')} = {_TRIM.format('o')} AS trim_same FROM sides),
dated AS (SELECT *, coalesce(ln, l0) AS l1,
  CASE WHEN i1 = o THEN NULL WHEN (lay1 IS NULL) <> (lay2 IS NULL) THEN 'derived'
    WHEN {' OR '.join(list(_DATE_RULES)[:7])} THEN 'derived'
    WHEN {' OR '.join(list(_DATE_RULES)[7:])} THEN 'datereformat' END AS ld
  FROM flagged),
opened AS (SELECT *, CASE WHEN l1 = 'not sm' AND ld IS NOT NULL THEN ld ELSE l1 END AS l2
  FROM dated),
done AS (SELECT *,
  l2 = 'not sm' AND trim_same AS blank,
  CASE WHEN l2 = 'not sm' AND NOT trim_same THEN {_MASKED} ELSE FALSE END AS masked
  FROM opened),
classified AS (SELECT template, pair_key,
  CASE WHEN masked THEN 'masking' WHEN blank THEN 'stringreformat'
       WHEN l2 = 'not sm' THEN 'derived' ELSE l2 END AS label,
  """
)

_RAISED = {
    "DelSpBegFlag": f"blank AND {_LEAD.format('i1')} > {_LEAD.format('o')}",
    "DelSpEndFlag": f"blank AND {_TRAIL.format('i1')} > {_TRAIL.format('o')}",
    "InsSpBegFlag": f"blank AND {_LEAD.format('i1')} < {_LEAD.format('o')}",
    "InsSpEndFlag": f"blank AND {_TRAIL.format('i1')} < {_TRAIL.format('o')}",
    "DelzBegFlag": f"ln = 'numeric reformat' AND {_LEN1} > {_LEN2}",
    "InszBegFlag": f"ln = 'numeric reformat' AND {_LEN1} < {_LEN2}",
    "DelDecEndFlag": "ln = 'numeric reformat' AND dl1 > dl2",
    "InsDecEndFlag": "ln = 'numeric reformat' AND dl1 < dl2",
    "ConcatFlag": "l0 = 'concatenate'",
    "InsSameFlag": "masked",
    **{name: name for name in _DATE_RULES},
}
_CLASSIFIED += (
    ", ".join(
        (
            f"CASE WHEN {_RAISED[f]} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"
            if f in _RAISED
            else "0.0::DOUBLE"
        )
        + f" AS {f}"
        for f in FLAGS
    )
    + " FROM done)\n"
)
_SIDES = "WITH " + PAIRS + _TEXTS
FLAG_TEXT = " || ".join(f"CAST(CAST({f} AS INTEGER) AS VARCHAR)" for f in FLAGS)

ORACLE = {
    "pair_labels": _CLASSIFIED
    + "SELECT template, label, count(*) AS n FROM classified GROUP BY ALL",
    "pair_rows": _CLASSIFIED
    + "SELECT template, pair_key, label, "
    + FLAG_TEXT
    + " AS flags FROM classified",
    "pair_flags": _CLASSIFIED
    + "SELECT template, "
    + ", ".join(f"sum({f}) AS {f}" for f in FLAGS)
    + " FROM classified GROUP BY template",
    "pair_label_crosstab": _CLASSIFIED
    + "SELECT template, "
    + ", ".join(
        f"count(*) FILTER (label = '{x}') AS {x.replace(' ', '_')}"
        for x in ("sm", "concatenate", "derivedconcat", "numeric reformat", "datereformat",
                  "stringreformat", "masking", "derived")
    )
    + " FROM classified GROUP BY template",
    "pair_concat": f"WITH {PAIRS} SELECT template, pair_key, {_START} AS label FROM pairs",
    "pair_numeric": f"""{_SIDES}, v AS (SELECT *, {_NUM_LABEL} AS label FROM sides)
        SELECT template, pair_key, label, {_LEN1} > {_LEN2} AS del_beg,
          {_LEN1} < {_LEN2} AS ins_beg, dl1 > dl2 AS del_end, dl1 < dl2 AS ins_end
        FROM v WHERE label IS NOT NULL""",
    "pair_date": f"{_SIDES} SELECT template, pair_key, lay1 AS in_layout, lay2 AS out_layout, "
    + ", ".join(
        f"{p}1 AS in_{p}, {p}2 AS out_{p}"
        for p in ("yyyy", "yy", "mm", "dd", "hh", "mi", "ss", "delim")
    )
    + f" FROM sides WHERE {_BOTH}",
    "pair_date_change": _CLASSIFIED.split(",\nopened AS")[0]
    + " SELECT template, pair_key, ld AS date_label, "
    + " || ".join(
        f"CAST(CAST({f} AS INTEGER) AS VARCHAR)" if f in _DATE_RULES else "'0'"
        for f in FLAGS
    )
    + " AS flags FROM dated",
    "pair_text": f"""WITH {PAIRS} SELECT template, pair_key,
        {_LEAD.format('i1')} < {_LEAD.format('o')} AS ins_beg,
        {_LEAD.format('i1')} > {_LEAD.format('o')} AS del_beg,
        {_TRAIL.format('i1')} < {_TRAIL.format('o')} AS ins_end,
        {_TRAIL.format('i1')} > {_TRAIL.format('o')} AS del_end
        FROM pairs WHERE i1 <> o AND {_TRIM.format('i1')} = {_TRIM.format('o')}""",
    "pair_mask": f"""WITH {PAIRS} SELECT template, pair_key, {_MASKED} AS masked
        FROM pairs WHERE i1 <> o""",
}
