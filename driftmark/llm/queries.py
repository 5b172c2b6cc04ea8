"""Registered queries of the operators in this package, with SQL twins where SQL can express them."""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import functions as F

from driftmark.llm import bpe, codes, html, jaccard, langid, mixing, neighbours, quality, repeats, rules, secrets, topk, whitening
from driftmark.llm.batches import small_batches
from driftmark.sources.scratch import materialize
from driftmark.sources.tables import read_table


def op8_mix_sources(spark, sf_dir):
    return mixing.mix(read_table(spark, sf_dir, "documents"))


# The twin ranks every single quotient, where the operator ranks those near the ideal share.
OP8_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS k FROM documents),
distinct_rows AS (SELECT k, doc_id, size FROM d GROUP BY ALL),
s0 AS (SELECT k, sum(size)::BIGINT AS source_size FROM d GROUP BY k),
s1 AS (SELECT *, row_number() OVER (ORDER BY k) AS pos FROM s0),
s AS (SELECT s1.*, CASE (pos - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
             (SELECT count(*) FROM distinct_rows r WHERE r.k = s1.k) AS n_rows FROM s1),
tot AS (SELECT sum(source_size)::BIGINT AS t FROM s),
lv(i, level) AS (
  SELECT 0, 0.0::DOUBLE
  UNION ALL
  SELECT i + 1, (SELECT ((SELECT t FROM tot) - coalesce(sum(CASE WHEN weight * lv.level > 3 * source_size
                 THEN 3 * source_size END), 0)) / sum(CASE WHEN weight * lv.level > 3 * source_size THEN NULL ELSE weight END) FROM s)
  FROM lv WHERE i < 60),
tg AS (SELECT s.*, least(weight * (SELECT arg_max(level, i) FROM lv), (3 * source_size)::DOUBLE) AS target FROM s),
q AS (SELECT k, weight / (2 * seat + 1) AS quotient
      FROM (SELECT k, weight, unnest(range(0, (3 * source_size) // 16)) AS seat FROM tg)),
won AS (SELECT k, count(*) AS seats FROM (SELECT k, quotient, row_number() OVER (ORDER BY quotient DESC, k) AS place FROM q)
        WHERE place <= (SELECT t // 16 FROM tot) GROUP BY k),
ss AS (SELECT tg.*, coalesce(seats, 0) AS seats FROM tg LEFT JOIN won USING (k)),
l AS (SELECT d.doc_id, d.size, d.k, ss.source_size, ss.target, ss.seats,
             sha256('mix-1:' || coalesce(d.doc_id::VARCHAR, '') || ':' || d.size) AS mark,
             ss.n_rows FROM d JOIN ss USING (k)),
l2 AS (SELECT *, ('0x' || substr(mark, 1, 8))::BIGINT % ceil(n_rows / 20000.0)::BIGINT AS shard FROM l),
sh AS (SELECT k, shard, sum(size)::BIGINT AS shard_size, any_value(seats) AS seats FROM l2 GROUP BY k, shard),
sq AS (SELECT k, shard, seats, shard_size / (2 * seat + 1) AS quotient
       FROM (SELECT *, unnest(range(0, (3 * shard_size) // 16)) AS seat FROM sh)),
sw AS (SELECT k, shard, count(*) * 16 AS quota FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY quotient DESC, shard) AS place FROM sq)
       WHERE place <= seats GROUP BY k, shard),
p AS (SELECT l2.*, sh.shard_size, coalesce(quota, 0) AS quota,
             sum(size) OVER (PARTITION BY l2.k, l2.shard ORDER BY mark, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS start
      FROM l2 JOIN sh USING (k, shard) LEFT JOIN sw USING (k, shard))
SELECT doc_id, size, source_size, target,
       (CASE WHEN shard_size = 0 THEN 0 ELSE (quota // shard_size) * size
        + greatest(least(quota % shard_size - start, size), 0) END)::BIGINT AS taken
FROM p
"""

def op10_secret_scan(spark, sf_dir):
    return secrets.secret_report(read_table(spark, sf_dir, "documents"))


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _kind_sql(kind: int, pattern: str, keep: str = "TRUE") -> str:
    """Matches of one kind: (rid, kind, s, e), positions from the lengths of pieces and matches."""
    return f"""
  SELECT rid, {kind} AS kind, s, s + length(m[i]) AS e FROM (
    SELECT rid, i, m, v, (list_sum(list_transform(p[1:i], lambda x: length(x)))
           + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0))::BIGINT AS s
    FROM (SELECT rid, m, v, p, unnest(range(1, len(m) + 1)) AS i FROM (
      SELECT rid, regexp_extract_all(t, {_sql(pattern)}) AS m, string_split_regex(t, {_sql(pattern)}) AS p,
             regexp_extract_all(t, {_sql(pattern)}, {2 if "(" in pattern else 0}) AS v
      FROM d WHERE regexp_matches(t, {_sql(pattern)})))) WHERE {keep}"""


OP10_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
parts AS ({" UNION ALL ".join([
    _kind_sql(0, secrets.ASSIGN, f"length(v[i]) >= {secrets.SHORTEST_ASSIGNED}"),
    _kind_sql(1, secrets.ACCESS), _kind_sql(2, secrets.HEX), _kind_sql(3, secrets.IDENTIFIER),
    _kind_sql(4, secrets.MIXED), _kind_sql(5, secrets.ENDPOINT)])}),
free AS (SELECT * FROM parts a WHERE kind < 3 OR NOT EXISTS (
  SELECT 1 FROM parts b WHERE b.rid = a.rid AND b.kind < 3 AND b.s <= a.s AND a.e <= b.e)),
shown AS (SELECT *, kind < 3 AS own,
  EXISTS (SELECT 1 FROM free b WHERE b.rid = a.rid AND b.kind IN (1, 3) AND a.s - 200 < b.e AND b.s < a.e + 200) AS near_id,
  EXISTS (SELECT 1 FROM free b WHERE b.rid = a.rid AND b.kind IN (0, 2, 4) AND a.s - 200 < b.e AND b.s < a.e + 200) AS near_secret
  FROM free a),
told AS (SELECT rid, kind, s, e, ['assign', 'access', 'hex', 'identifier', 'mixed', 'endpoint'][kind + 1]
                || ':' || s || ':' || e AS name FROM shown
  WHERE own OR (kind = 3 AND near_secret) OR (kind = 4 AND near_id) OR (kind = 5 AND near_id AND near_secret)),
g AS (SELECT rid, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access,
      count(*) FILTER (kind = 2) AS n_hex, string_agg(name, ',' ORDER BY s, kind) FILTER (kind < 3) AS base,
      string_agg(name, ',' ORDER BY s, kind) AS spans FROM told GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (rid)
"""

def encoded_digests(spark, docs, path):
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every text."""
    ranks = bpe.read_ranks(path)
    ids = bpe.encode(spark, docs, ranks, public_tokenizers.PATTERN, digest=True)
    pieces = bpe.piece_table(ranks)
    return ids.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        "ids_sha256",
        F.sha2(bpe.decode(F.col("ids"), pieces), 256).alias("decoded_sha256"),
    )


def op6_byte_bpe(spark, sf_dir):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return encoded_digests(spark, read_table(spark, sf_dir, "documents"), path)


def held_out(fold: int, folds: int):
    """Whether the row belongs to the fold that nothing is learnt from; a null id never does."""
    left = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds))
    return F.coalesce(left == fold, F.lit(False))


def op3_compression_quality(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    model = quality.fit(docs, read_table(spark, sf_dir, "labels"), ~held_out(0, 5))
    return quality.score(docs, model).select(
        "doc_id",
        held_out(0, 5).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"),
    )


def op1_main_text(spark, sf_dir):
    return html.main_text(read_table(spark, sf_dir, "pages"))


def op2_suffix_dedup(spark, sf_dir):
    found = repeats.remove_repeats(read_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op4_jaccard_join(spark, sf_dir):
    found = jaccard.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id")


def op5_nearest_neighbours(spark, sf_dir):
    return neighbours.nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op7_topk_products(spark, sf_dir):
    return topk.top_products(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


OP7_SQL = """
WITH v AS (SELECT DISTINCT vec_id, embedding FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
w AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM v),
p AS (SELECT q.rid, q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
      FROM w q JOIN w c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT query_id, (row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id))::INTEGER AS rank,
             vec_id, score FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


def op9_crf_language(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    model = langid.fit(docs, ~held_out(2, 4), calibrate=False)
    return langid.predict(docs, model).select(
        "doc_id", held_out(2, 4).alias("held_out"), "lang_pred", "score"
    )


def op11_vector_codes(spark, sf_dir):
    rows, books = codes.compress(read_table(spark, sf_dir, "embeddings"), F.col("label"))
    stored = materialize(rows, "vector-codes")
    numbers = codes.part_major(F.col("length"), F.col("m"), F.col("entries"))
    digests = books.select(
        "length", F.sha2(F.array_join(numbers, ","), 256).alias("codebooks_sha256")
    )
    hexadecimal = F.transform("code", lambda k: F.lower(F.lpad(F.hex(k), 2, "0")))
    return (
        codes.errors_by_label(stored)
        .join(digests, "length")
        .select(
            "vec_id",
            F.array_join(hexadecimal, "").alias("code"),
            "error",
            "label_error",
            "codebooks_sha256",
        )
    )


_ASSIGNED = """SELECT rid, part, v, arg_min(k, (d, k)) AS k, min(d) AS d FROM (
    SELECT p.rid, p.part, p.v, e.k, list_sum(list_transform(list_zip(p.v, e.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
    FROM p JOIN {book} e USING (part)) GROUP BY rid, part, v"""

_RENEWED = """SELECT part, k, coalesce(m, v) AS v FROM {book} LEFT JOIN (
    SELECT part, k, list(c ORDER BY i) AS m FROM (
      SELECT part, k, i, (sum(v[i]) - (((sum(v[i]) % count(*)) + count(*)) % count(*))) // count(*) AS c
      FROM {assigned}, (SELECT unnest(range(1, (SELECT len(x) // 16 FROM w LIMIT 1) + 1)) AS i) GROUP BY part, k, i)
    GROUP BY part, k) USING (part, k)"""

# For vectors of one length, a multiple of 16.
OP11_SQL = f"""
WITH w AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS rid, vec_id, label,
                  list_transform(embedding, lambda c: floor(256 * c::DOUBLE)::BIGINT) AS x
           FROM embeddings WHERE embedding IS NOT NULL
             AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
p AS (SELECT rid, part, x[part * (len(x) // 16) + 1 : (part + 1) * (len(x) // 16)] AS v
      FROM w, (SELECT unnest(range(0, 16)) AS part)),
b0 AS (SELECT part, rid - 1 AS k, v FROM p WHERE rid <= 64),
a0 AS ({_ASSIGNED.format(book="b0")}),
b1 AS ({_RENEWED.format(book="b0", assigned="a0")}),
a1 AS ({_ASSIGNED.format(book="b1")}),
b2 AS ({_RENEWED.format(book="b1", assigned="a1")}),
a2 AS ({_ASSIGNED.format(book="b2")}),
g AS (SELECT rid, string_agg(printf('%02x', k), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY rid),
h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, k)) AS codebooks_sha256 FROM b2)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM g JOIN w USING (rid), h
"""


def op12_whitening(spark, sf_dir):
    return whitening.whiten(read_table(spark, sf_dir, "embeddings"))


def op13_decision_list(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    stats = materialize(rules.statistics(docs), "text-statistics")
    found = rules.fit(stats, read_table(spark, sf_dir, "labels"), ~held_out(0, 5))
    return rules.decide(stats, found).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "rule",
    )


def _run(query):
    @wraps(query)
    def run(spark, sf_dir):
        return query(small_batches(spark), sf_dir)

    return run


QUERIES = {
    f.__name__: _run(f)
    for f in (
        op1_main_text,
        op2_suffix_dedup,
        op3_compression_quality,
        op4_jaccard_join,
        op5_nearest_neighbours,
        op6_byte_bpe,
        op7_topk_products,
        op8_mix_sources,
        op9_crf_language,
        op10_secret_scan,
        op11_vector_codes,
        op12_whitening,
        op13_decision_list,
    )
}

ORACLE = {
    "op7_topk_products": OP7_SQL,
    "op11_vector_codes": OP11_SQL,
    "op10_secret_scan": OP10_SQL,
    "op8_mix_sources": OP8_SQL,
}
