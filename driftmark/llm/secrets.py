"""Secret scans with multipart credential linking.

Three patterns are strong enough to report alone. Others are weak: a named identifier, a mixed
run that may be a secret, an endpoint. A weak part is reported only when complementary parts lie
within its scope, found by an interval join on (text, scope bucket): an identifier with a secret,
a secret with an identifier, an endpoint with both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftmark.llm.batches import quoted
from driftmark.sources.scratch import materialize

ASSIGN = (
    r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
IDENTIFIER = (
    r"""(?i)(access_?key_?id|client_?id|username|user|login|account)["']?\x20*[:=]\x20*["']?"""
    r"""([A-Za-z0-9@._+-]{3,})"""
)
MIXED = r"[A-Za-z0-9+/]{32,}"
ENDPOINT = r"(?i)(https?|ftp|jdbc:[a-z]+|mongodb|redis|amqp|postgres(ql)?|mysql)://[^\s\"'<>]+"

#: Kinds in the order that breaks ties of position; the first three are reported alone.
KINDS = ("assign", "access", "hex", "identifier", "mixed", "endpoint")
BASE_KINDS = 3
IDENTIFIERS = (1, 3)
SECRETS = (0, 2, 4)
ENDPOINTS = (5,)
SHORTEST_ASSIGNED = 12
SCOPE = 200
SALTS = 16

PART = "array<struct<start:int,kind:int,end:int>>"


def _nothing() -> Column:
    return F.array().cast(PART)


def spans_of(text: Column, pattern: str, kind: int, keep=None, when: Column | None = None) -> Column:
    """Leftmost non-overlapping matches as (start, kind, end) in code points.

    ``split`` and ``regexp_extract_all`` cut the text at the same places, so the lengths of what
    lies between and of the matches add up to the positions.
    """
    between = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), 0)

    def step(state, i):
        start = state["at"] + F.length(F.get(between, i))
        end = start + F.length(F.get(hits, i))
        part = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))
        kept = F.concat(state["parts"], F.array(part))
        kept = kept if keep is None else F.when(keep(i), kept).otherwise(state["parts"])
        return F.struct(end.alias("at"), kept.alias("parts"))

    places = F.when(F.size(hits) > 0, F.sequence(F.lit(0), F.size(hits) - 1)).otherwise(
        F.array().cast("array<int>")
    )
    zero = F.struct(F.lit(0).alias("at"), _nothing().alias("parts"))
    found = F.aggregate(places, zero, step, lambda state: state["parts"])
    wanted = text.rlike(pattern) if when is None else when & text.rlike(pattern)
    return F.when(wanted, found).otherwise(_nothing())


def find_parts(docs: DataFrame) -> DataFrame:
    """The columns but ``text``, and base, text_key, weak: spans that stand alone, and where weak
    parts could be linked, the digest of the text and the weak spans."""
    text = F.col("text")
    values = F.regexp_extract_all(text, F.lit(ASSIGN), 2)
    carried = [c for c in docs.columns if c != "text"]
    rows = docs.select(*carried, F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select(
        *carried,
        "text",
        spans_of(
            text, ASSIGN, 0, lambda i: F.length(F.get(values, i)) >= SHORTEST_ASSIGNED
        ).alias("assign"),
        spans_of(text, ACCESS, 1).alias("access"),
        spans_of(text, HEX, 2).alias("hex"),
        spans_of(text, IDENTIFIER, 3).alias("identifier"),
    )
    named = (F.size("access") > 0) | (F.size("identifier") > 0)
    rows = rows.withColumn("mixed", spans_of(text, MIXED, 4, when=named))
    secret = (F.size("assign") > 0) | (F.size("hex") > 0) | (F.size("mixed") > 0)
    rows = rows.withColumn("endpoint", spans_of(text, ENDPOINT, 5, when=named & secret))
    weak = F.concat("identifier", "mixed", "endpoint")
    linkable = named & secret & (F.size(weak) > 0)
    return rows.select(
        *carried,
        F.sort_array(F.concat("assign", "access", "hex")).alias("base"),
        F.when(linkable, F.sha2(text, 256)).alias("text_key"),
        F.when(linkable, weak).alias("weak"),
    )


def _bucketed(parts: DataFrame, scope: int, reach: int) -> DataFrame:
    first = F.floor((F.col("start") - reach) / scope)
    last = F.floor((F.col("end") + reach) / scope)
    return parts.withColumn("bucket", F.explode(F.sequence(first, last)))


def _near(parts: DataFrame, others: DataFrame, scope: int, reach: int) -> DataFrame:
    """Parts with one of ``others`` less than ``reach`` away."""
    a = _bucketed(parts, scope, reach).alias("a")
    b = _bucketed(others, scope, 0).alias("b")
    apart = (
        (F.col("a.text_key") == F.col("b.text_key"))
        & (F.col("a.bucket") == F.col("b.bucket"))
        & (F.col("a.start") - reach < F.col("b.end"))
        & (F.col("b.start") < F.col("a.end") + reach)
    )
    return a.join(b, apart, "left_semi").drop("bucket").distinct()


def _uncovered(parts: DataFrame, others: DataFrame, scope: int) -> DataFrame:
    """Parts that do not lie inside one of ``others``. What covers a part covers its start, so it is
    found in the bucket of that."""
    a = parts.withColumn("bucket", F.floor(F.col("start") / scope)).alias("a")
    b = _bucketed(others, scope, 0).alias("b")
    covers = (
        (F.col("a.text_key") == F.col("b.text_key"))
        & (F.col("a.bucket") == F.col("b.bucket"))
        & (F.col("b.start") <= F.col("a.start"))
        & (F.col("a.end") <= F.col("b.end"))
    )
    return a.join(b, covers, "left_anti").drop("bucket")


def link_parts(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(text_key, linked): weak spans with complementary parts in scope, once per distinct text."""
    parts = (
        found.where(F.col("text_key").isNotNull())
        .dropDuplicates(["text_key"])
        .select("text_key", F.inline(F.concat("base", "weak")))
    )
    base = parts.where(F.col("kind") < BASE_KINDS)
    # What lies inside a base span is not reported twice.
    weak = _uncovered(parts.where(F.col("kind") >= BASE_KINDS), base, scope)
    whole = base.unionByName(weak)
    identifiers = whole.where(F.col("kind").isin(*IDENTIFIERS))
    secrets = whole.where(F.col("kind").isin(*SECRETS))
    endpoints = weak.where(F.col("kind").isin(*ENDPOINTS))
    linked = (
        _near(weak.where(F.col("kind").isin(*IDENTIFIERS)), secrets, scope, scope)
        .unionByName(
            _near(weak.where(F.col("kind").isin(*SECRETS)), identifiers, scope, scope)
        )
        .unionByName(
            _near(
                _near(endpoints, identifiers, scope, scope), secrets, scope, scope
            )
        )
    )
    return linked.groupBy("text_key").agg(
        F.collect_list(F.struct("start", "kind", "end")).alias("linked")
    )


def find_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """``base`` and ``linked`` per document, as arrays of (start, kind, end), next to the columns
    of ``docs`` other than ``text``.

    docs: doc_id, text and at most names not used here. Null and empty texts have no spans, null and
    repeated ids are rows like any other, equal texts have equal spans, and an empty table gives an
    empty result.
    """
    carried = [c for c in docs.columns if c != "text"]
    found = materialize(find_parts(docs), "secret-parts")
    plain = found.where(F.col("text_key").isNull())
    # A third of the documents may share one text, so its row is joined from several partitions.
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    linked = link_parts(found, scope).withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    )
    keyed = (
        found.where(F.col("text_key").isNotNull())
        .withColumn("salt", salt)
        .join(linked, ["text_key", "salt"], "left")
        .select(*carried, "base", F.coalesce("linked", _nothing()).alias("linked"))
    )
    return plain.select(*carried, "base", _nothing().alias("linked")).unionByName(keyed)


def span_text(spans: Column) -> Column:
    """``kind:start:end`` by start and kind, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(
        F.transform(
            spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])
        ),
        ",",
    )


def secret_report(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) per document.

    docs: doc_id and text; other columns are ignored.
    """

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return find_secrets(docs.select("doc_id", "text"), scope).select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(span_text(F.col("base")), 256).alias("base_sha256"),
        span_text(F.sort_array(F.concat("base", "linked"))).alias("spans"),
    )


def masked_documents(docs: DataFrame, mask: str = "[SECRET]", scope: int = SCOPE) -> DataFrame:
    """``docs`` with every reported span of the text replaced by the mask; overlapping spans share
    one. Texts without a span, null ones included, stay as they are; ``n_chars`` follows the text.
    """
    columns = docs.columns
    found = find_secrets(docs.select("doc_id", "text", F.struct(*quoted(columns)).alias("row")), scope)
    text = F.col("row.text")

    def step(state, span):
        gap = F.substr(text, state["at"] + 1, F.greatest(span["start"] - state["at"], F.lit(0)))
        joined = F.concat(state["out"], gap, F.when(span["start"] >= state["at"], mask).otherwise(""))
        return F.struct(F.greatest(span["end"], state["at"]).alias("at"), joined.alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    spans = F.sort_array(F.concat("base", "linked"))
    masked = F.aggregate(
        spans, zero, step, lambda s: F.concat(s["out"], F.substr(text, s["at"] + 1))
    )
    changed = {"text": masked, "n_chars": F.length(masked).cast("long")}
    return found.select(
        *(
            F.when(F.size(spans) > 0, changed[c]).otherwise(F.col(f"row.`{c}`")).alias(c)
            if c in changed
            else F.col(f"row.`{c}`").alias(c)
            for c in columns
        )
    )
