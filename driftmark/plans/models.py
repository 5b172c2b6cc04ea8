"""Model queries. Fits are seeded but not expressible in SQL, so most have no SQL twin."""

from __future__ import annotations

from pyspark.ml.classification import OneVsRestModel, RandomForestClassificationModel
from pyspark.ml.clustering import KMeansModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from driftmark.functions.scalars import rounded
from driftmark.functions.segments import NO_SEGMENT, as_feature, customer_segment
from driftmark.operators import evaluate as E
from driftmark.operators import features, models, pruning, rollup, sampling
from driftmark.operators.classify import FLAGS, classify_counts, expand_flags
from driftmark.plans.pairs import FLAG_TEXT
from driftmark.plans.pairs import ORACLE as PAIR_ORACLE
from driftmark.plans.views import BALANCES, ROLLUP, SEGMENTED
from driftmark.sources.files import load_model, save_model
from driftmark.sources.pair_fixture import pairs
from driftmark.sources.scratch import materialize, scratch_path
from driftmark.sources.tables import account_balances, accountlevel

CUSTOMER_FEATURES = ("fico_score", "delinquency")
LABEL = "customer_type"
INDEX = "label_index"
FOLDS = 3


def _customers(spark, sf_dir):
    """One row per account with a segment, split into train and test by account."""
    score, late = F.col("acc_cb_raw_scr_no"), F.col("acc_pdue_pplint_qt")
    rows = accountlevel(spark, sf_dir).select(
        as_feature(score).alias("fico_score"),
        as_feature(late).alias("delinquency"),
        customer_segment(score, late).alias(LABEL),
        (sampling.unit_hash("loannum", seed=11) < 0.7).alias("is_train"),
    )
    return rows.where(F.col(LABEL) != NO_SEGMENT)


def _indexed(counted, label=LABEL):
    """Attach the frequency index; there is one index row per label."""
    index = features.label_index(counted, label, weight=models.WEIGHT).select(label, INDEX)
    return counted.join(F.broadcast(index), label)


def _customer_table(spark, sf_dir):
    """Distinct (score, delinquency) with weights, stored: the table is scanned once."""
    counted = models.compress(
        _customers(spark, sf_dir), [*CUSTOMER_FEATURES, LABEL, "is_train"]
    )
    return features.assemble(_indexed(materialize(counted, "customers")), CUSTOMER_FEATURES)


def _pair_table(spark, sf_dir):
    """Distinct (label, flags, fold) of all classified pairs with weights, stored."""
    triples = pairs(spark, sf_dir)
    u = sampling.unit_hash("template", "pair_key", seed=123)
    tagged = triples.select(
        "input1",
        "input2",
        "output",
        (u < 0.8).alias("is_train"),
        F.floor(u * 1000 % FOLDS).cast("int").alias("fold"),
    )
    counted = classify_counts(
        tagged, ["is_train", "fold"], "input1", "input2", "output", "label", n=models.WEIGHT
    )
    weighted = counted.withColumn(models.WEIGHT, F.col(models.WEIGHT).cast("double"))
    kinds = expand_flags(weighted)
    return features.assemble(_indexed(materialize(kinds, "pairs"), "label"), FLAGS)


def _judged(scored, actual=INDEX, weight=models.WEIGHT):
    """Weighted metrics on train and test."""
    out = None
    for part, keep in (("train", F.col("is_train")), ("test", ~F.col("is_train"))):
        conf = E.confusion(scored.where(keep), actual, "prediction", weight)
        line = E.weighted_metrics(conf).withColumn("part", F.lit(part))
        out = line if out is None else out.unionByName(line)
    return out


def _as_prediction(scored):
    return scored.withColumn("prediction", F.col("prediction").cast("double"))


def customer_training_table(spark, sf_dir):
    """What the segment models are fitted on: distinct rows, their index and weight."""
    cols = (*CUSTOMER_FEATURES, LABEL, INDEX, "is_train", models.WEIGHT)
    return _customer_table(spark, sf_dir).select(*cols)


def pair_training_table(spark, sf_dir):
    """What the flag models are fitted on, with the flags as text."""
    flags = F.concat(*(F.col(f).cast("int").cast("string") for f in FLAGS))
    return _pair_table(spark, sf_dir).select(
        "label", INDEX, flags.alias("flags"), "is_train", "fold", models.WEIGHT
    )


def kmeans_segments(spark, sf_dir):
    data = _customer_table(spark, sf_dir)
    model = models.fit_kmeans(data.where("is_train"), 6)
    return _judged(_as_prediction(model.transform(data)))


def kmeans_aligned(spark, sf_dir):
    """Confusion of segments with clusters named after their majority segment."""
    data = _customer_table(spark, sf_dir)
    model = models.fit_kmeans(data.where("is_train"), 6)
    scored = _as_prediction(model.transform(data))
    conf = E.confusion(scored, INDEX, "prediction", models.WEIGHT)
    return E.align_clusters(conf)


def kmeans_centers(spark, sf_dir):
    data = _customer_table(spark, sf_dir)
    return models.centres(spark, models.fit_kmeans(data.where("is_train"), 6), CUSTOMER_FEATURES)


def kmeans_pairs(spark, sf_dir):
    data = _pair_table(spark, sf_dir)
    model = models.fit_kmeans(data.where("is_train"), 7)
    return _judged(_as_prediction(model.transform(data)))


def rf_segments(spark, sf_dir):
    data = _customer_table(spark, sf_dir)
    model = models.fit_forest(data.where("is_train"), INDEX)
    return _judged(model.transform(data))


def _customer_rows(spark, sf_dir):
    """Indexed rows for fits that cannot use weights: a few narrow columns, stored, because
    indexing, fitting and judging each read them."""
    rows = materialize(_customers(spark, sf_dir), "customer-rows")
    fitted = features.index_and_encode(rows, LABEL)
    data = features.assemble(fitted.transform(rows), CUSTOMER_FEATURES)
    return data.withColumn(models.WEIGHT, F.lit(1.0))


def rf_segments_rows(spark, sf_dir):
    """The forest on rows, each tree on a bootstrap sample."""
    data = _customer_rows(spark, sf_dir)
    model = models.fit_forest(data.where("is_train"), f"{LABEL}_index", weight=None)
    return _judged(model.transform(data), f"{LABEL}_index")


def ovr_segments(spark, sf_dir):
    data = _customer_table(spark, sf_dir)
    model = models.fit_one_vs_rest(data.where("is_train"), INDEX)
    return _judged(model.transform(data))


def mlp_segments(spark, sf_dir):
    """The perceptron takes no weights, so it is fitted on the rows."""
    data = _customer_rows(spark, sf_dir)
    model = models.fit_perceptron(data.where("is_train"), f"{LABEL}_index")
    return _judged(model.transform(data), f"{LABEL}_index")


def onehot_vectors(spark, sf_dir):
    """Index and one-hot vector per segment, from the fitted encoders."""
    rows = _customers(spark, sf_dir).select(LABEL)
    out = features.index_and_encode(rows, LABEL).transform(rows).distinct()
    size = 5
    bits = vector_to_array(f"{LABEL}_vec")
    return out.select(
        LABEL,
        f"{LABEL}_index",
        # With fewer labels there are fewer bits.
        *(F.coalesce(F.get(bits, F.lit(i)), F.lit(0.0)).alias(f"is_{i}") for i in range(size)),
    )


def tree_pairs(spark, sf_dir):
    """Diagnostic table of a tree on the flags, judged on the test rows."""
    data = _pair_table(spark, sf_dir)
    model = models.fit_tree(data.where("is_train"), INDEX)
    scored = model.transform(data.where("not is_train"))
    return E.class_table(E.confusion(scored, INDEX, "prediction", models.WEIGHT))


def tree_overall(spark, sf_dir):
    data = _pair_table(spark, sf_dir)
    model = models.fit_tree(data.where("is_train"), INDEX)
    scored = model.transform(data.where("not is_train"))
    return E.overall_table(E.confusion(scored, INDEX, "prediction", models.WEIGHT))


def tree_cv(spark, sf_dir):
    data = _pair_table(spark, sf_dir)
    return models.tree_complexity(data, INDEX, (1, 2, 3, 5, 10), "fold", FOLDS)


def tree_pruning(spark, sf_dir):
    """The pruning sequence of the tree on the flags, with its cross-validated errors."""
    data = _pair_table(spark, sf_dir)
    return pruning.complexity_table(data, INDEX, "fold", FOLDS)


def tree_importances(spark, sf_dir):
    data = _pair_table(spark, sf_dir)
    return models.tree_importances(spark, models.fit_tree(data.where("is_train"), INDEX), FLAGS)


def tree_text(spark, sf_dir):
    data = _pair_table(spark, sf_dir)
    return models.tree_text(spark, models.fit_tree(data.where("is_train"), INDEX))


CALENDAR = ("Year", "Month", "Day")


def _monthly(spark, sf_dir):
    """The roll-up as a regression frame, stored: four fits read a few dozen rows."""
    rolled = rollup.asof_rollup(account_balances(spark, sf_dir))
    frame = materialize(rollup.regression_frame(rolled), "rollup")
    frame = features.assemble(frame, CALENDAR)
    return frame.withColumn(
        "is_train", sampling.unit_hash("Year", "Month", "Day", seed=3) < 0.8
    )


def _linear(spark, sf_dir, measure):
    data = _monthly(spark, sf_dir)
    model = models.fit_linear(data.where("is_train"), measure, "predicted")
    scored = model.transform(data.where("not is_train"))
    return model, scored.select(*CALENDAR, F.col(measure).alias("actual"), "predicted")


def lr_count(spark, sf_dir):
    return _linear(spark, sf_dir, "Count")[1]


def lr_ledger(spark, sf_dir):
    return _linear(spark, sf_dir, "LedgerSum")[1]


def lr_accrual(spark, sf_dir):
    return _linear(spark, sf_dir, "IntAcruSum")[1]


def lr_reserve(spark, sf_dir):
    return _linear(spark, sf_dir, "IntReserveSum")[1]


def lr_summary(spark, sf_dir):
    return models.linear_summary(spark, _linear(spark, sf_dir, "Count")[0], CALENDAR)


def lr_test_metrics(spark, sf_dir):
    return E.regression_metrics(lr_count(spark, sf_dir), "actual", "predicted")


def _duration(spark, sf_dir):
    """Accounts per month against months since the first month."""
    rolled = materialize(
        rollup.asof_rollup(account_balances(spark, sf_dir)).select("asofdate", "cnt"), "rollup"
    )
    first = rolled.agg(F.min("asofdate")).scalar()
    months = F.round(F.months_between(F.col("asofdate"), first))
    return rolled.select(months.alias("duration"), F.col("cnt").cast("double").alias("count"))


def lr_duration(spark, sf_dir):
    """Elastic-net line through counts by duration."""
    data = features.assemble(_duration(spark, sf_dir), ["duration"])
    model = models.fit_linear(data, "count", "predicted")
    return model.transform(data).select("duration", "count", "predicted")


def lr_least_squares(spark, sf_dir):
    """Plain least squares, 100 iterations at most, no penalty."""
    data = features.assemble(_duration(spark, sf_dir), ["duration"])
    model = models.fit_linear(data, "count", "predicted", iterations=100, reg=0.0, l1_ratio=0.0)
    scored = model.transform(data)
    return scored.select("duration", "count", rounded(F.col("predicted"), 5).alias("predicted"))


def model_roundtrip(spark, sf_dir):
    """Rows scored alike by fitted models and by their saved and loaded copies."""
    data = _customer_table(spark, sf_dir)
    train = data.where("is_train")
    out = None
    for name, model, kind in (
        ("kmeans", models.fit_kmeans(train, 6), KMeansModel),
        ("forest", models.fit_forest(train, INDEX), RandomForestClassificationModel),
        ("one_vs_rest", models.fit_one_vs_rest(train, INDEX), OneVsRestModel),
    ):
        path = scratch_path(spark, name)
        save_model(model, path)
        again = load_model(kind, path)
        both = again.transform(
            model.transform(data).select("features", "n", F.col("prediction").alias("before"))
        )
        same = F.sum(F.when(F.col("before") == F.col("prediction"), F.col("n")).otherwise(0.0))
        line = both.agg(F.sum("n").cast("bigint").alias("n"), same.cast("bigint").alias("n_same"))
        line = line.withColumn("model", F.lit(name))
        out = line if out is None else out.unionByName(line)
    return out


QUERIES = {
    f.__name__: f
    for f in (
        customer_training_table,
        pair_training_table,
        kmeans_segments,
        kmeans_aligned,
        kmeans_centers,
        kmeans_pairs,
        rf_segments,
        rf_segments_rows,
        ovr_segments,
        mlp_segments,
        onehot_vectors,
        tree_pairs,
        tree_overall,
        tree_cv,
        tree_pruning,
        tree_importances,
        tree_text,
        lr_count,
        lr_ledger,
        lr_accrual,
        lr_reserve,
        lr_summary,
        lr_test_metrics,
        lr_duration,
        lr_least_squares,
        model_roundtrip,
    )
}

_SEGMENT_RANKS = f"""WITH {{segmented}}, c AS (
  SELECT customer_type, count(*) AS n FROM segmented WHERE customer_type <> '{NO_SEGMENT}'
  GROUP BY customer_type),
i AS (SELECT customer_type,
  CAST(row_number() OVER (ORDER BY n DESC, customer_type) - 1 AS DOUBLE) AS ix FROM c)"""

_UNIT = "CAST('0x' || substr(md5({key} || '|{seed}'), 1, 8) AS BIGINT) / 4294967296.0"
_ACCOUNT_UNIT = _UNIT.format(key="CAST(loannum AS VARCHAR)", seed=11)
_PAIR_UNIT = _UNIT.format(key="template || '|' || CAST(pair_key AS VARCHAR)", seed=123)

ORACLE = {
    "customer_training_table": _SEGMENT_RANKS.format(segmented=SEGMENTED)
    + f"""SELECT coalesce(CAST(acc_cb_raw_scr_no AS DOUBLE), 0.0) AS fico_score,
          CAST(acc_pdue_pplint_qt AS DOUBLE) AS delinquency, customer_type, ix AS label_index,
          {_ACCOUNT_UNIT} < 0.7 AS is_train, CAST(count(*) AS DOUBLE) AS n
        FROM segmented JOIN i USING (customer_type) GROUP BY ALL""",
    "pair_training_table": PAIR_ORACLE["pair_rows"].split("SELECT template, pair_key, label, ")[0]
    + f""", c AS (SELECT label, count(*) AS n FROM classified GROUP BY label),
        i AS (SELECT label, CAST(row_number() OVER (ORDER BY n DESC, label) - 1 AS DOUBLE) AS ix
          FROM c)
        SELECT label, ix AS label_index, {FLAG_TEXT} AS flags, {_PAIR_UNIT} < 0.8 AS is_train,
          CAST(floor(({_PAIR_UNIT}) * 1000 % {FOLDS}) AS INTEGER) AS fold,
          CAST(count(*) AS DOUBLE) AS n
        FROM classified JOIN i USING (label) GROUP BY ALL""",
    "onehot_vectors": _SEGMENT_RANKS.format(segmented=SEGMENTED)
    + "SELECT customer_type, ix AS customer_type_index, "
    + ", ".join(f"CAST(ix = {i} AS DOUBLE) AS is_{i}" for i in range(5))
    + " FROM i",
    "lr_least_squares": f"""WITH {ROLLUP}, d AS (
          SELECT CAST(date_diff('month', min(asofdate) OVER (), asofdate) AS DOUBLE) AS duration,
            CAST(cnt AS DOUBLE) AS "count" FROM rollup),
        line AS (SELECT regr_slope("count", duration) AS b, regr_intercept("count", duration) AS a
          FROM d)
        SELECT duration, "count", round(a + b * duration, 5) + 0.0 AS predicted
        FROM d CROSS JOIN line""",
    "model_roundtrip": f"""WITH {BALANCES}
        SELECT 'kmeans' AS model, count(*) AS n, count(*) AS n_same FROM balances
        UNION ALL SELECT 'forest', count(*), count(*) FROM balances
        UNION ALL SELECT 'one_vs_rest', count(*), count(*) FROM balances""",
}
