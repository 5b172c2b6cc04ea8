"""Mixing sources to target weights by Sainte-Laguë apportionment.

Words are allotted in blocks of equal size. Blocks go to sources by highest quotients
(weight / (2 seats + 1)), then each source's blocks to its shards the same way (by shard size),
which gives every shard a whole quota. Inside a shard the documents lie end to end in seeded
order; the quota takes the line from its start, as often round as it reaches.

Sources are as many as they are: targets come from one-row aggregates, quotients are ranked only
around the ideal number of seats, and shards are cut by row count, so a source that holds a third
of all rows is many shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftmark.llm.batches import quoted
from driftmark.operators.sampling import with_position
from driftmark.sources.scratch import materialize

WORD = r"[^\x20\x09-\x0D]+"
WORD_AND_GAP = r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"
WEIGHTS = (5, 2, 1)
MOST_PASSES = 3
BLOCK_WORDS = 16
SHARD_ROWS = 20_000
SEED = "mix-1"


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """Text that sorts like the source by code point, null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def _grouped(sizes: DataFrame) -> DataFrame:
    """(source_key, doc_id, size, copies): equal rows are one row with a count, so that a
    document repeated without end is still one row of its shard."""
    return sizes.groupBy("source_key", "doc_id", "size").agg(F.count(F.lit(1)).alias("copies"))


def source_targets(
    grouped: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_PASSES
) -> tuple[DataFrame, int, float]:
    """(source_key, source_rows, source_size, weight, target) per source, all words, and the sum of
    the weights of the sources below their limit.

    The limit of a source is ``most`` times its size. The level (words per weight) rises from
    round to round as sources reach their limits, so the level alone says which ones have.
    """
    per_source = grouped.groupBy("source_key").agg(
        F.sum(F.lit(1)).alias("source_rows"),
        F.sum(F.col("size") * F.col("copies")).alias("source_size"),
    )
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    place = F.pmod(F.col("position") - 1, F.lit(len(weights))).cast("int")
    sources = materialize(
        with_position(per_source, [], [F.col("source_key")])
        .withColumn("weight", F.element_at(cycle, place + 1))
        .drop("position"),
        "mix-sources",
    )
    limit = most * F.col("source_size")
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("n")).first().n
    level, open_weight = 0.0, 0.0
    while True:
        full = F.col("weight") * F.lit(level) > limit
        row = sources.agg(
            F.coalesce(F.sum(F.when(full, limit)), F.lit(0)).alias("given"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)).alias("open"),
        ).first()
        following = (total - row.given) / row.open if row.open else level
        if following == level:
            break
        level, open_weight = following, row.open
    target = F.least(F.col("weight") * F.lit(level), limit.cast("double"))
    return sources.withColumn("target", target), int(total), open_weight


def _offers(df: DataFrame, ideal: Column, margin: Column, most_seats: Column) -> DataFrame:
    """``sure`` seats, and as ``seat`` the further ones whose quotients may be among the highest.

    A Sainte-Laguë share differs from the ideal one by less than the margin, so only quotients
    that close to it need ranking, however many seats there are.
    """
    sure = F.greatest(F.floor(ideal).cast("long") - margin, F.lit(0).cast("long"))
    last = F.least(F.floor(ideal).cast("long") + margin + 1, most_seats)
    return (
        df.withColumn("sure", F.least(sure, most_seats))
        .withColumn("last", last)
        .withColumn(
            "seat",
            F.explode_outer(
                F.when(F.col("last") > F.col("sure"), F.sequence("sure", F.col("last") - 1))
            ),
        )
    )


def source_seats(
    targets: DataFrame, total: int, open_weight: float, block: int, most: int
) -> DataFrame:
    """Adds ``seats``: blocks per source by highest quotients, at most its limit."""
    n_sources = targets.count()
    # The seats of the capped and uncapped sources differ from the ideal ones by at most one each;
    # an uncapped source bears its weight's part of that sum.
    margin = F.ceil(F.col("weight") / F.lit(open_weight or 1.0) * (n_sources + 2)) + 2
    most_seats = F.floor(most * F.col("source_size") / block).cast("long")
    offers = _offers(targets, F.col("target") / block, margin, most_seats)
    given = targets_sure(offers, ["source_key"])
    rest = total // block - (given.agg(F.coalesce(F.sum("sure"), F.lit(0)).alias("n")).first().n)
    won = (
        offers.where(F.col("seat").isNotNull())
        .select("source_key", (F.col("weight") / (2 * F.col("seat") + 1)).alias("quotient"))
        .orderBy(F.col("quotient").desc(), "source_key")
        .limit(max(int(rest), 0))
        .groupBy("source_key")
        .agg(F.count(F.lit(1)).alias("won"))
    )
    return (
        targets.join(given, "source_key")
        .join(won, "source_key", "left")
        .withColumn("seats", F.col("sure") + F.coalesce("won", F.lit(0)))
        .drop("sure", "won")
    )


def targets_sure(offers: DataFrame, keys: list[str]) -> DataFrame:
    return offers.groupBy(*keys).agg(F.first("sure").alias("sure"))


def shard_quotas(lines: DataFrame, seats: DataFrame, block: int, most: int) -> DataFrame:
    """(source_key, shard, quota): each source's blocks by highest quotients over its shards."""
    shards = lines.groupBy("source_key", "shard").agg(
        F.sum(F.col("size") * F.col("copies")).alias("shard_size")
    )
    whole = Window.partitionBy("source_key")
    joined = shards.join(
        seats.select("source_key", "source_size", "seats"), "source_key"
    ).withColumn("n_shards", F.count(F.lit(1)).over(whole))
    part = F.when(F.col("source_size") > 0, F.col("shard_size") / F.col("source_size"))
    joined = joined.withColumn("part", F.coalesce(part, F.lit(0.0)))
    offers = _offers(
        joined,
        F.col("part") * F.col("seats"),
        F.ceil(F.col("part") * (F.col("n_shards") + 2)) + 2,
        F.floor(most * F.col("shard_size") / block).cast("long"),
    )
    keys = ["source_key", "shard"]
    first = F.row_number().over(Window.partitionBy(*keys).orderBy("seat")) == 1
    sure_all = F.sum(F.when(F.col("first"), F.col("sure"))).over(whole)
    by_quotient = whole.orderBy(F.col("quotient").desc_nulls_last(), "shard")
    won = (F.col("place") <= F.col("seats") - F.col("sure_all")) & F.col("seat").isNotNull()
    return (
        offers.withColumn("first", first)
        .withColumn("quotient", F.col("shard_size") / (2 * F.col("seat") + 1))
        .withColumn("sure_all", sure_all)
        .withColumn("place", F.row_number().over(by_quotient))
        .groupBy(*keys)
        .agg(
            F.first("shard_size").alias("shard_size"),
            ((F.first("sure") + F.sum(F.when(won, 1).otherwise(0))) * block).alias("quota"),
        )
    )


def mixed_lines(
    sizes: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    most: int = MOST_PASSES,
    block: int = BLOCK_WORDS,
    shard_rows: int = SHARD_ROWS,
    seed: str = SEED,
) -> DataFrame:
    """(source_key, doc_id, size, copies, source_size, target, passes, start, rest) per distinct row.

    sizes: (source_key, doc_id, size), one row per document. The first copy of a row lies at
    ``start`` of its shard's line; each copy is taken ``passes`` times, and once more as far as
    the first ``rest`` words of the line reach.
    """
    grouped = materialize(_grouped(sizes), "mix-sizes")
    targets, total, open_weight = source_targets(grouped, weights, most)
    seats = materialize(source_seats(targets, total, open_weight, block, most), "mix-seats")
    mark = F.sha2(
        F.concat_ws(
            ":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "size"
        ),
        256,
    )
    digits = F.conv(F.substring("mark", 1, 8), 16, 10).cast("long")
    n_shards = F.ceil(F.col("source_rows") / shard_rows)
    lines = (
        grouped.join(
            seats.select("source_key", "source_rows", "source_size", "target"), "source_key"
        )
        .withColumn("mark", mark)
        .withColumn("shard", F.pmod(digits, n_shards))
    )
    quotas = shard_quotas(lines, seats, block, most)
    line = Window.partitionBy("source_key", "shard").orderBy("mark", "doc_id", "size")
    own = F.col("size") * F.col("copies")
    placed = lines.withColumn("start", F.sum(own).over(line) - own)
    passes = F.floor(F.col("quota") / F.col("shard_size")).cast("long")
    sized = F.col("shard_size") > 0
    return (
        placed.join(quotas, ["source_key", "shard"])
        .withColumn("passes", F.when(sized, passes).otherwise(F.lit(0)).cast("long"))
        .withColumn("rest", F.col("quota") - F.col("passes") * F.col("shard_size"))
        .select(
            "source_key", "doc_id", "size", "copies", "source_size", "target",
            "passes", "start", "rest",
        )
    )


def _part(start: Column) -> Column:
    """Words of a copy at ``start`` that the last, partial pass takes."""
    return F.greatest(F.least(F.col("rest") - start, F.col("size")), F.lit(0))


def mix(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, size, source_size, target, taken) per document; see ``mixed_lines`` for options.

    docs: doc_id, source and text; other columns are ignored. Null text has size 0, a null source
    is a source of its own, null and repeated ids are rows like any other, an empty table gives
    an empty result. Equal rows may swap what they get; the rows of the result stay the same.
    """
    sizes = docs.select(
        source_key(F.col("source")).alias("source_key"),
        "doc_id",
        word_count(F.col("text")).alias("size"),
    )
    lines = mixed_lines(sizes, **options)
    each = lines.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    taken = F.col("passes") * F.col("size") + _part(F.col("start") + F.col("copy") * F.col("size"))
    return each.select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as often as it is taken, with the columns of ``docs``.

    A pass that takes a document in part leaves its first words, with the white space between
    them; ``n_chars`` then follows the text.
    """
    columns = docs.columns
    rows = docs.select(F.struct(*quoted(columns)).alias("row"))
    rows = rows.select(
        "row",
        source_key(F.col("row.source")).alias("source_key"),
        F.col("row.doc_id").alias("doc_id"),
        word_count(F.col("row.text")).alias("size"),
    )
    lines = mixed_lines(rows.drop("row"), **options)
    # Never null, and the same keys for the window and the join: the texts move once.
    doc_key = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_key")
    keys = ["source_key", "doc_key", "size"]
    same = Window.partitionBy(*keys).orderBy(F.xxhash64("row"))
    copies = rows.select("row", "source_key", doc_key, "size").withColumn(
        "copy", F.row_number().over(same) - 1
    )
    joined = copies.join(
        lines.select("source_key", doc_key, "size", "passes", "start", "rest"), keys
    )
    part = _part(F.col("start") + F.col("copy") * F.col("size"))
    words = F.slice(F.regexp_extract_all("row.text", F.lit(WORD_AND_GAP), 0), 1, part.cast("int"))
    cut = F.rtrim(F.array_join(words, ""))
    last = F.when(part == F.col("size"), F.col("row.text")).when(part > 0, cut)
    texts = F.concat(
        F.array_repeat(F.col("row.text"), F.col("passes").cast("int")),
        F.when(last.isNotNull(), F.array(last)).otherwise(F.array().cast("array<string>")),
    )
    opened = joined.select("row", F.explode(texts).alias("taken_text"))
    whole = F.col("taken_text") == F.col("row.text")
    n_chars = F.length("taken_text").cast("long")
    changed = {"text": F.col("taken_text")}
    if "n_chars" in columns:
        changed["n_chars"] = F.when(whole, F.col("row.n_chars")).otherwise(n_chars)
    return opened.select(*(changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in columns))
