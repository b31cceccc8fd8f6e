"""Overlapping count windows and the features computed on them.

Window number ``w`` covers row indexes ``w*stride .. w*stride+size-1`` of its
group.  Sums, extremes and counts are first reduced to panes of ``stride``
frames and a window is put together from its ``size/stride`` panes, so the
overlap multiplies small pane rows and not frames.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from busline.operators import ordered as O
from busline.schema import BYTES, CHANNELS, SPAN, STRIDE, WINDOW
from busline.session import landed

PAIRS = list(combinations(range(8), 2))


def _covering(idx: Column, size: int, stride: int) -> Column:
    """Numbers of all windows that hold row ``idx``."""
    lo = F.greatest(F.lit(0).cast("long"), F.ceil((idx - (size - 1)) / stride).cast("long"))
    return F.sequence(lo, F.floor(idx / stride).cast("long"))


def with_group_rows(frames: DataFrame, by, out="_rows") -> DataFrame:
    """Rows per group, joined back without a shuffle of frames."""
    return O.with_facts(frames, frames.groupBy(*by).agg(F.count("*").alias(out)), by)


def window_frames(frames: DataFrame, by, size=WINDOW, stride=STRIDE, idx="idx") -> DataFrame:
    """Each frame once per complete window that holds it, with its position; no shuffle of frames."""
    d = with_group_rows(frames, by)
    d = d.withColumn("w", F.explode(_covering(F.col(idx), size, stride)))
    d = d.where(F.col("w") * stride + size <= F.col("_rows")).drop("_rows")
    return d.select("*", (F.col("w") * stride).alias("start_index"), (F.col(idx) - F.col("w") * stride).alias("pos")).drop("w")


def pane_table(frames: DataFrame, by, aggs: list[Column], stride=STRIDE, idx="idx") -> DataFrame:
    d = frames.withColumn("pane", F.floor(F.col(idx) / stride).cast("long"))
    return d.groupBy(*by, "pane").agg(F.count("*").alias("_n"), *aggs)


def from_panes(panes: DataFrame, by, aggs: list[Column], size=WINDOW, stride=STRIDE, keep=()) -> DataFrame:
    """Windows from panes; windows short of ``size`` frames are dropped."""
    if size % stride:
        raise ValueError("the stride must divide the window size")
    k = size // stride
    lo = F.greatest(F.lit(0).cast("long"), F.col("pane") - (k - 1))
    d = panes.withColumn("w", F.explode(F.sequence(lo, F.col("pane"))))
    d = d.groupBy(*by, "w", *keep).agg(F.sum("_n").alias("_n"), *aggs)
    d = d.where(F.col("_n") == size) if not keep else d
    return d.withColumn("start_index", F.col("w") * stride).drop("w", "_n")


def count_windows(frames: DataFrame, by, size=WINDOW, stride=STRIDE, idx="idx", channels=CHANNELS) -> DataFrame:
    """One row per window: frame array, labels and provenance."""
    weak = F.bool_or("is_weak_label") if "is_weak_label" in frames.columns else F.lit(False)
    kinds = range(1, 6)
    p = pane_table(
        frames,
        by,
        [
            F.sort_array(F.collect_list(F.struct(idx, *channels))).alias("f"),
            F.max("binary_label_id").alias("b"),
            *[F.count_if(F.col("attack_type_id") == k).alias(f"c{k}") for k in kinds],
            F.min_by("timestamp", idx).alias("t0"),
            F.max_by("timestamp", idx).alias("t1"),
            weak.alias("weak"),
        ],
        stride,
        idx,
    )
    w = from_panes(
        p,
        by,
        [
            F.flatten(F.sort_array(F.collect_list(F.struct("pane", "f")))["f"]).alias("_f"),
            F.max("b").alias("y_binary"),
            *[F.sum(f"c{k}").alias(f"c{k}") for k in kinds],
            F.min_by("t0", "pane").alias("start_timestamp"),
            F.max_by("t1", "pane").alias("end_timestamp"),
            F.bool_or("weak").alias("is_weak_label"),
        ],
        size,
        stride,
    )
    frames_only = F.transform("_f", lambda x: F.struct(*[x[c].alias(c) for c in channels]))
    return w.select(
        *by,
        "start_index",
        (F.col("start_index") + size - 1).alias("end_index"),
        "start_timestamp",
        "end_timestamp",
        "is_weak_label",
        "y_binary",
        _majority([F.col(f"c{k}") for k in kinds]).alias("y_attack_type"),
        frames_only.alias("frames"),
    )


def _majority(counts: list[Column]) -> Column:
    """Class with the largest count, the lowest on ties, 0 without attacks."""
    top = F.greatest(*counts)
    first = F.coalesce(*[F.when(c == top, F.lit(k)) for k, c in enumerate(counts, 1)])
    return F.when(F.col("y_binary") == 1, F.when(top > 0, first).otherwise(0)).otherwise(0)


def window_labels(frames: DataFrame, by, size=WINDOW, stride=STRIDE, idx="idx") -> DataFrame:
    """Binary label and majority attack class per window."""
    kinds = range(1, 6)
    p = pane_table(
        frames,
        by,
        [F.max("binary_label_id").alias("b"), *[F.count_if(F.col("attack_type_id") == k).alias(f"c{k}") for k in kinds]],
        stride,
        idx,
    )
    w = from_panes(p, by, [F.max("b").alias("y_binary"), *[F.sum(f"c{k}").alias(f"c{k}") for k in kinds]], size, stride)
    return w.select(*by, "start_index", "y_binary", _majority([F.col(f"c{k}") for k in kinds]).alias("y_attack_type"))


def window_any(frames: DataFrame, by, flag: Column, size=WINDOW, stride=STRIDE, idx="idx") -> DataFrame:
    """Flagged frames per window and whether there are any."""
    p = pane_table(frames, by, [F.sum(flag.cast("long")).alias("s")], stride, idx)
    w = from_panes(p, by, [F.sum("s").alias("events")], size, stride)
    return w.withColumn("positive", (F.col("events") > 0).cast("int"))


def window_stats(frames: DataFrame, by, size=WINDOW, stride=STRIDE, idx="idx") -> DataFrame:
    """Window counts per split and per (split, source) with groups seen and too short.

    ``by`` starts with split and source_file.
    """
    w = window_labels(frames, by, size, stride, idx)
    groups = frames.groupBy(*by).agg(F.count("*").alias("_rows"))
    per = w.groupBy(*by).agg(
        F.count("*").alias("windows"),
        F.count_if(F.col("y_binary") == 0).alias("normal"),
        F.count_if(F.col("y_binary") == 1).alias("attack"),
        *[F.count_if(F.col("y_attack_type") == k).alias(f"type_{k}") for k in range(1, 6)],
    )
    d = groups.join(per, list(by), "left")
    sums = ["windows", "normal", "attack", *[f"type_{k}" for k in range(1, 6)]]
    return (
        d.groupingSets([("split",), ("split", "source_file")], "split", "source_file")
        .agg(
            F.count("*").alias("groups_seen"),
            F.count_if(F.col("windows").isNull()).alias("groups_short"),
            *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums],
        )
        .withColumn("source_file", F.coalesce("source_file", F.lit("ALL")))
    )


def boundary_exposure(counts: DataFrame, ks=(1, 2, 4, 8, 16), value="events") -> DataFrame:
    """Attack windows with at most k injected frames, their share, and the median count."""
    a = counts.where(F.col(value) > 0)
    hist = O.tie_table(a, [], value, {"_n": F.lit(1)})
    median = O.exact_quantiles(hist, [], value, {"m": 0.5}, splits=[], weight=F.col("_n"))
    one = hist.agg(
        F.sum("_n").alias("_all"),
        *[F.coalesce(F.sum(F.when(F.col(value) <= k, F.col("_n"))), F.lit(0)).alias(f"k{k}") for k in ks],
    )
    rows = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"k{k}").alias("attack_windows")) for k in ks])
    d = one.select("_all", F.explode(rows).alias("r")).select("_all", "r.*")
    return d.select(
        "k",
        "attack_windows",
        F.try_divide("attack_windows", "_all").alias("share"),
        median.select("m").scalar().alias("median_events"),
    )


def window_features(frames: DataFrame, by, size=WINDOW, stride=STRIDE, idx="idx", channels=CHANNELS) -> DataFrame:
    """Mean, population SD, minimum, maximum and last minus first per channel.

    Panes of a whole window are full, so the window variance is the mean pane
    variance plus the variance of the pane means, and its first and last frame
    are the first of the first and the last of the last pane.
    """
    pane = []
    for c in channels:
        pane += [
            F.avg(c).alias(f"{c}_m"),
            F.var_pop(c).alias(f"{c}_v"),
            F.min(c).alias(f"{c}_lo"),
            F.max(c).alias(f"{c}_hi"),
            F.max(F.when(F.col(idx) % stride == 0, F.col(c))).alias(f"{c}_f"),
            F.max(F.when(F.col(idx) % stride == stride - 1, F.col(c))).alias(f"{c}_l"),
        ]
    p = pane_table(frames, by, pane, stride, idx)
    at_start, at_end = F.col("pane") == F.col("w"), F.col("pane") == F.col("w") + size // stride - 1
    win = []
    for c in channels:
        win += [
            F.avg(f"{c}_m").alias(f"{c}_mean"),
            F.sqrt(F.avg(f"{c}_v") + F.var_pop(f"{c}_m")).alias(f"{c}_std"),
            F.min(f"{c}_lo").alias(f"{c}_min"),
            F.max(f"{c}_hi").alias(f"{c}_max"),
            (F.max(F.when(at_end, F.col(f"{c}_l"))) - F.max(F.when(at_start, F.col(f"{c}_f")))).alias(f"{c}_delta"),
        ]
    return from_panes(p, by, win, size, stride)


FEATURES = [f"{c}_{s}" for s in ("mean", "std", "min", "max", "delta") for c in CHANNELS]
CORRELATIONS = [f"corr_{i}_{j}" for i, j in PAIRS]


def payload_correlations(frames: DataFrame, by, size=WINDOW, stride=STRIDE, idx="idx") -> DataFrame:
    """Pearson correlation of each byte pair per window, 0 where a byte is constant.

    All sums are of integers, hence exact.
    """
    x = [F.col(b).cast("long") for b in BYTES]
    p = pane_table(
        frames,
        by,
        [
            *[F.sum(x[i]).alias(f"s{i}") for i in range(8)],
            *[F.sum(x[i] * x[i]).alias(f"q{i}") for i in range(8)],
            *[F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i, j in PAIRS],
        ],
        stride,
        idx,
    )
    names = [f"s{i}" for i in range(8)] + [f"q{i}" for i in range(8)] + [f"p{i}_{j}" for i, j in PAIRS]
    w = from_panes(p, by, [F.sum(c).alias(c) for c in names], size, stride)
    var = lambda i: size * F.col(f"q{i}") - F.col(f"s{i}") * F.col(f"s{i}")
    out = []
    for i, j in PAIRS:
        cov = size * F.col(f"p{i}_{j}") - F.col(f"s{i}") * F.col(f"s{j}")
        den = F.sqrt(var(i).cast("double")) * F.sqrt(var(j).cast("double"))
        out.append(F.coalesce(F.try_divide(cov.cast("double"), den), F.lit(0.0)).alias(f"corr_{i}_{j}"))
    return w.select(*by, "start_index", *out)


def window_id_counts(frames: DataFrame, by, size=WINDOW, stride=STRIDE, idx="idx") -> DataFrame:
    """Frames per (window, id) of complete windows."""
    d = with_group_rows(frames, by)
    d = d.withColumn("pane", F.floor(F.col(idx) / stride).cast("long"))
    p = d.groupBy(*by, "pane", "can_id").agg(F.count("*").alias("_n"), F.max("_rows").alias("_rows"))
    k = size // stride
    lo = F.greatest(F.lit(0).cast("long"), F.col("pane") - (k - 1))
    p = p.withColumn("w", F.explode(F.sequence(lo, F.col("pane"))))
    p = p.where(F.col("w") * stride + size <= F.col("_rows"))
    return p.groupBy(*by, (F.col("w") * stride).alias("start_index"), "can_id").agg(F.sum("_n").alias("n"))


def window_id_entropy(frames: DataFrame, by, size=WINDOW, stride=STRIDE, idx="idx") -> DataFrame:
    """Shannon bits of the id mix per window."""
    c = window_id_counts(frames, by, size, stride, idx)
    share = F.col("n") / F.lit(float(size))
    return c.groupBy(*by, "start_index").agg(F.sum(-share * F.log2(share)).alias("entropy"))


def window_timing(frames: DataFrame, by, size=WINDOW, stride=STRIDE, idx="idx") -> DataFrame:
    f = window_features(frames, by, size, stride, idx, ["delta_t"])
    return f.select(*by, "start_index", "delta_t_mean", "delta_t_std")


def window_id_intervals(frames, by, size=WINDOW, stride=STRIDE, idx="idx", span=SPAN) -> DataFrame:
    """Mean gap and gap count between same-id frames inside each window.

    A gap counts for the windows that hold both its frames, so the gap is
    found once per frame and handed to at most ``size/stride`` windows.
    """
    d = with_group_rows(frames, by)
    d = O.previous(d, [*by, "can_id"], idx, {"_pi": idx, "_pt": "timestamp"}, span)
    d = d.where(F.col(idx) - F.col("_pi") < size)
    lo = F.greatest(F.lit(0).cast("long"), F.ceil((F.col(idx) - (size - 1)) / stride).cast("long"))
    hi = F.floor(F.col("_pi") / stride).cast("long")
    last = F.floor((F.col("_rows") - size) / stride).cast("long")
    hi = F.least(hi, last)
    d = d.withColumn("_lo", lo).withColumn("_hi", hi).where(F.col("_lo") <= F.col("_hi"))
    gap = F.greatest(F.col("timestamp") - F.col("_pt"), F.lit(0.0))
    d = d.select(*by, "can_id", gap.alias("gap"), F.explode(F.sequence("_lo", "_hi")).alias("w"))
    return d.groupBy(*by, (F.col("w") * stride).alias("start_index"), "can_id").agg(
        F.avg("gap").alias("mean_gap"), F.count("*").alias("gaps")
    )


def fit_scaler(frames: DataFrame, by, channels=CHANNELS, size=WINDOW, stride=STRIDE, idx="idx") -> DataFrame:
    """One row with mean and population SD per channel over the frames of all complete windows; SD below 1e-6 becomes 1.

    A frame counts once for each window over it. That number follows from its
    index and the length of its source, so frames are not repeated. Squares are
    taken from the least value of the channel, which keeps a constant one at 0.
    """
    sources = frames.groupBy(*by).agg(F.count("*").alias("_len"), *[F.min(c).alias(f"_m_{c}") for c in channels])
    sources = landed(sources, "scaler-sources")
    least = sources.agg(F.struct(*[F.min(f"_m_{c}").cast("double").alias(c) for c in channels]).alias("m")).scalar()
    first = F.greatest(F.lit(0), F.ceil((F.col(idx) - (size - 1)) / stride))
    last = F.least(F.floor(F.col(idx) / stride), F.floor((F.col("_len") - size) / stride))
    d = frames.select(*by, idx, *channels).join(sources.select(*by, "_len"), by).withColumn("_w", F.greatest(F.lit(0), last - first + 1)).where("_w > 0").withColumn("_least", least)
    aggs = []
    for c in channels:
        x = F.col(c) - F.col("_least")[c]
        w = F.sum(F.when(F.col(c).isNotNull(), F.col("_w")))
        aggs += [(F.sum(x * F.col("_w")) / w).alias(f"_a_{c}"), (F.sum(x * x * F.col("_w")) / w).alias(f"_q_{c}")]
    g = d.agg(*aggs).withColumn("_least", least)
    var = lambda c: F.greatest(F.lit(0.0), F.col(f"_q_{c}") - F.col(f"_a_{c}") * F.col(f"_a_{c}"))
    sd = lambda c: F.when(F.sqrt(var(c)) < 1e-6, 1.0).otherwise(F.sqrt(var(c))).alias(f"{c}_sd")
    mu = lambda c: (F.col(f"_a_{c}") + F.col("_least")[c]).alias(f"{c}_mu")
    known = lambda c, x: F.when(F.col(f"_a_{c}").isNotNull(), x)
    return g.select(*[mu(c) for c in channels], *[known(c, sd(c)).alias(f"{c}_sd") for c in channels])


def apply_scaler(d: DataFrame, scaler: DataFrame, channels=CHANNELS) -> DataFrame:
    """Standardized channels; the scaler row comes in as one scalar subquery."""
    s = scaler.select(F.struct(*scaler.columns).alias("s")).scalar()
    d = d.withColumn("_s", s)
    keep = [c for c in d.columns if c not in channels and c != "_s"]
    z = [((F.col(c) - F.col("_s")[f"{c}_mu"]) / F.col("_s")[f"{c}_sd"]).alias(c) for c in channels]
    return d.select(*keep, *z)
