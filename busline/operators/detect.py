"""Detectors on window tables: id whitelist, entropy band, interval rule, random forests."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from busline.operators import forest as FT
from busline.operators import metrics as ME
from busline.operators import ordered as O
from busline.operators import sampling as S
from busline.operators import windows as WN
from busline.schema import STRIDE, WINDOW
from busline.session import discard, landed, scratch_dir


def normal_ids(frames: DataFrame) -> DataFrame:
    """Distinct ids of normal frames."""
    return frames.where("binary_label_id = 0").select("can_id").distinct()


def detect_whitelist(frames: DataFrame, ids: DataFrame, by: list[str], size=WINDOW, stride=STRIDE, idx="idx") -> DataFrame:
    """Windows with at least one id outside the set.

    Frames are marked once and summed by panes; the id table is joined by its
    key, so its size is for the planner to judge.
    """
    known = ids.select("can_id").distinct().withColumn("_k", F.lit(1))
    d = frames.join(known, "can_id", "left")
    w = WN.window_any(d, by, F.col("_k").isNull(), size, stride, idx)
    return w.select(*by, "start_index", F.col("events").alias("unknown_frames"), F.col("positive").alias("pred"))


def fit_entropy(entropies: DataFrame, lo=0.001, hi=0.999) -> DataFrame:
    """One row (lo, hi): the entropy band of normal windows."""
    return O.exact_quantiles(entropies, [], "entropy", {"lo": lo, "hi": hi})


def detect_entropy(entropies: DataFrame, band: DataFrame) -> DataFrame:
    b = band.select(F.struct("lo", "hi").alias("b")).scalar()
    d = entropies.withColumn("_b", b)
    out = (F.col("entropy") < F.col("_b.lo")) | (F.col("entropy") > F.col("_b.hi"))
    return d.withColumn("pred", out.cast("int")).drop("_b")


def detect_timing(intervals: DataFrame, id_counts: DataFrame, profile: DataFrame, keys: list[str], min_gaps=4, factor=0.5) -> DataFrame:
    """Windows where a known id comes too fast; a second flag also counts ids never seen.

    ``profile`` lists known ids with their median gap (NULL without one).
    """
    known = profile.select("can_id", "median_gap", F.lit(1).alias("_k"))
    c = id_counts.select(*keys, "can_id").join(intervals.select(*keys, "can_id", "mean_gap", "gaps"), [*keys, "can_id"], "left")
    c = c.join(known, "can_id", "left")
    fast = (F.col("gaps") >= min_gaps) & (F.col("mean_gap") < F.col("median_gap") * factor)
    return c.groupBy(*keys).agg(
        F.max(F.coalesce(fast, F.lit(False)).cast("int")).alias("pred_ignore_unseen"),
        F.max((F.coalesce(fast, F.lit(False)) | F.col("_k").isNull()).cast("int")).alias("pred_unseen_attack"),
    )


ML_ROWS = 1 << 11  # rows up to which Spark ML grows the forest
FOREST_ROWS = 1 << 15  # rows of a task that grows trees; small tables are dealt to up to eight tasks
FOREST_NODES = 1 << 18  # nodes that the driver holds at once, about 200 MB while they grow


class Forest:
    """Trees in batches, each saved to the shared folder: the driver holds one batch at a time."""

    def __init__(self, vectors: VectorAssembler):
        self.vectors, self.folders = vectors, []

    def add(self, model) -> None:
        self.folders.append(scratch_dir(SparkSession.active(), "forest"))
        model.write().save(self.folders[-1])

    def transform(self, d: DataFrame) -> DataFrame:
        """Class probabilities in ``probability``: the votes of all batches, added up from one written table to the next."""
        kept = d.columns
        table = landed(self.vectors.transform(d), "forest-votes")
        for folder in self.folders:
            voted = RandomForestClassificationModel.load(folder).transform(table)
            votes = vector_to_array("rawPrediction")
            if "_votes" in table.columns:
                votes = F.zip_with("_votes", votes, lambda a, b: a + b)
            after = landed(voted.select(*kept, "_x", votes.alias("_votes")), "forest-votes")
            discard(table)
            table = after
        total = F.aggregate("_votes", F.lit(0.0), lambda a, x: a + x)
        return table.select(*kept, array_to_vector(F.transform("_votes", lambda x: x / total)).alias("probability"))


def fit_forest(d: DataFrame, features: list[str], label: str, trees=160, depth=30, seed=42, balanced=True, leaf=2):
    """Random forest on feature columns; balanced weights per class of the training table, ``leaf`` rows in a leaf at least.

    Spark grows trees to a depth of 30 at most, one job for each level and node
    group. Every task of it sends the histograms of all open nodes, so the
    vectors are written once and dealt to no more tasks than needed.

    Their size does not fall with the rows of a node, so a table of more than
    ``ML_ROWS`` rows is grown by ``forest`` instead, by the same rule.

    Trees grow in the driver, and their nodes with the rows. A table whose trees
    could pass ``FOREST_NODES`` is fitted in batches with seeds of their own:
    one tree first, then as many as the largest tree so far leaves room for.
    """
    weighted = S.class_weights(d, label) if balanced else d.withColumn("weight", F.lit(1.0))
    vectors = VectorAssembler(inputCols=features, outputCol="_x")
    table = landed(vectors.transform(weighted.withColumn(label, F.col(label).cast("double"))).select("_x", label, "weight"), "forest-rows")
    n = table.count()
    if n > ML_ROWS:
        return FT.fit_in_tasks(table, n, vectors, label, trees, depth, seed, leaf)
    dealt = table.repartition(max(-(-n // FOREST_ROWS), min(8, 1 + n // 512)))

    def grow(k: int, seed: int):
        rf = RandomForestClassifier(
            featuresCol="_x", labelCol=label, weightCol="weight", numTrees=k, maxDepth=depth, seed=seed, subsamplingRate=1.0, minInstancesPerNode=leaf,
            featureSubsetStrategy="sqrt")  # "auto" would give a batch of one tree all features
        return rf.fit(dealt)

    if trees * (n // leaf) <= FOREST_NODES:  # half the nodes that so many leaves allow, which real trees do not reach
        return PipelineModel([vectors, grow(trees, seed)])
    forest, done, largest, batch = Forest(vectors), 0, 1, 1
    while done < trees:
        model = grow(batch, seed + done)
        forest.add(model)
        done += batch
        largest = max(largest, -(-model.totalNumNodes // batch))
        batch = min(trees - done, max(1, FOREST_NODES // (largest + largest // 4)))
    return forest


def score_forest(d: DataFrame, model) -> DataFrame:
    """Class probabilities, first largest class, and attack score 1 - p0."""
    drop = ["_x", "rawPrediction", "probability", "prediction"]
    s = model.transform(d).withColumn("probs", vector_to_array("probability")).drop(*drop)
    return s.select("*", (F.array_position("probs", F.array_max("probs")) - 1).cast("int").alias("pred_class"), (F.lit(1.0) - F.col("probs")[0]).alias("score"))


def _held_out(d: DataFrame, label: str, key: str, share: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """Train and held-out part; each class gives round(n * share) of its rows, one at least."""
    n = d.groupBy(label).agg(F.greatest(F.lit(1), F.bround(F.count("*") * F.lit(share))).cast("long").alias("quota"))
    held = landed(S.first_ranks(d.select(label, key), [label], n, seed, key, "held").select(label, key), "held-out")
    return d.join(held, [label, key], "left_anti"), d.join(held, [label, key], "left_semi")


def discriminator(real: DataFrame, syn: DataFrame, features: list[str], key: str, seed=42, test_share=0.3, trees=100) -> tuple[DataFrame, DataFrame]:
    """Forest that tells real from synthetic windows: AUC on a held-out part with equal shares of both, and scores of all synthetic windows."""
    cols = [key, *features]
    both = real.select(*cols, F.lit(0).alias("y")).unionByName(syn.select(*cols, F.lit(1).alias("y")))
    train, test = _held_out(both, "y", key, test_share, seed)
    model = fit_forest(train, features, "y", trees, seed=seed)
    auc = ME.roc_auc(score_forest(test, model), [], "score", "y")
    return auc, score_forest(syn, model)


AUDIT_WINDOWS = 12_500  # of one class and domain that the audit looks at


def domain_audit(
    real: DataFrame, syn: DataFrame, features: list[str], by: list[str], key: str, block: int,
    cls="y_attack_type", classes=S.CLASSES, most=AUDIT_WINDOWS, seed=42, train_share=0.7, trees=100,
) -> DataFrame:
    """AUC of telling real from synthetic windows with equal counts of every class in both domains.

    Real windows are split by blocks of raw frames, those over an edge dropped,
    so train and test share no frame; synthetic ones by a keyed draw. One row
    per class from a forest of its own, and row ``all`` from one over all
    classes, with the windows per class and domain that were used. Fewer than
    two in either part raise.
    """
    spark = real.sparkSession
    parts = S.purged_split(real, block, seed, by, cls, 1 - train_share).select(cls, key, *features, "part")
    parts = landed(parts.where(F.col(cls).isin(*classes)), "audit-real")
    have = {(r[0], r[1]): r[2] for r in parts.groupBy(cls, "part").agg(F.count("*")).collect()}  # two per class
    n_syn = S.class_sizes(syn, cls, classes)
    wanted = round(most * train_share)
    n_train = min([wanted, *(have.get((c, "train"), 0) for c in classes), *(max(1, round(train_share * n_syn[c])) for c in classes)])
    n_test = min([most - wanted, *(have.get((c, "test"), 0) for c in classes), *(n_syn[c] - n_train for c in classes)])
    if n_train < 2 or n_test < 2:
        raise ValueError(f"a class has too few windows for an audit: {n_train} to train, {n_test} to test")
    size = spark.createDataFrame([("train", n_train), ("test", n_test)], "part string, quota long")
    drawn = S.first_ranks(parts, [cls, "part"], size, seed, key, "audit").withColumn("y", F.lit(0))
    kind = syn.schema[cls].dataType
    pool = S.first_ranks(syn.select(cls, key, *features), [cls], S._quota_table(spark, cls, kind, dict.fromkeys(classes, n_train + n_test)), seed, key, "audit")
    pool = pool.withColumn("part", F.when(F.col("rank") <= n_train, "train").otherwise("test")).withColumn("y", F.lit(1))
    table = landed(drawn.unionByName(pool).select(F.col(cls).cast("int").alias("class"), "part", "y", *features), "audit")

    def auc(d: DataFrame, name: str, seed: int) -> DataFrame:
        model = fit_forest(d.where("part = 'train'"), features, "y", trees, seed=seed)
        scores = score_forest(d.where("part = 'test'"), model)
        return ME.roc_auc(scores, [], "score", "y").select(F.lit(name).alias("class"), "auc")

    rows = [auc(table, "all", seed)] + [auc(table.where(F.col("class") == c), str(c), seed + c) for c in classes]
    out = reduce(lambda a, b: a.unionByName(b), rows)
    return out.select("class", "auc", F.lit(n_train).cast("long").alias("train_windows"), F.lit(n_test).cast("long").alias("test_windows"))


def condition_agreement(real: DataFrame, pool: DataFrame, features: list[str], label="y_attack_type", trees=100, seed=42) -> DataFrame:
    """Share of pool windows that a forest trained on real classes assigns to their label."""
    model = fit_forest(real, features, label, trees, seed=seed)
    s = score_forest(pool, model)
    return s.groupBy(label).agg(F.count("*").alias("windows"), F.avg((F.col("pred_class") == F.col(label)).cast("double")).alias("agreement"))


def transfer_matrix(models: dict[str, object], sets: dict[str, DataFrame], label="y") -> DataFrame:
    """Attack recall of every model on every set, one row per training domain."""
    parts = []
    for m, model in models.items():
        for s, d in sets.items():
            scored = score_forest(d, model).select((F.col(label) > 0).cast("int").alias("y"), (F.col("score") >= 0.5).cast("int").alias("pred"))
            parts.append(scored.select(F.lit(m).alias("train"), F.lit(s).alias("eval"), "y", "pred"))
    both = reduce(lambda a, b: a.unionAll(b), parts)
    rates = ME.binary_metrics(ME.confusion(both, ["train", "eval"]))
    return rates.groupBy("train").pivot("eval", list(sets)).agg(F.first("attack_recall").alias("recall"), F.first("fpr").alias("fpr"))


def with_scores(d: DataFrame, logits="logits", probs="probs") -> DataFrame:
    """Attack score, first largest class, negative largest logit, energy and attack margin."""
    top = F.array_max(logits)
    energy = -(top + F.log(F.aggregate(F.transform(logits, lambda z: F.exp(z - top)), F.lit(0.0), lambda a, x: a + x)))
    margin = F.array_max(F.slice(logits, F.lit(2), F.size(logits) - 1)) - F.get(logits, F.lit(0))
    return d.select(
        "*", (F.lit(1.0) - F.get(probs, F.lit(0))).alias("score"), (F.array_position(probs, F.array_max(probs)) - 1).cast("int").alias("pred_class"),
        (-top).alias("maxlogit"), energy.alias("energy"), margin.alias("margin"),
    )


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    e = F.transform(logits, lambda z: F.exp(z - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: x / total)
