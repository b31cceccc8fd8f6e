"""Checks of window tables, synthetic pools and result grids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from busline.operators import ordered as O
from busline.schema import BYTES, CHANNELS, MAX_ID

TOL = 1e-6
INTEGER = ["can_id", "dlc", *BYTES]
# Legal ranges of the integer channels.
RANGES = {"can_id": (0, MAX_ID), "dlc": (0, 8), **{b: (0, 255) for b in BYTES}}


def _any(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, cols)


def _count(cond: Column) -> Column:
    return F.count_if(cond)


def feature_validity(f: DataFrame, by: list[str] = ()) -> DataFrame:
    """Extremes and out-of-range counts of id, dlc, payload and gap over window frames."""
    outside = lambda c: ~F.col(c).between(*RANGES[c])
    return f.groupBy(*by).agg(
        F.min("can_id").alias("can_id_min"), F.max("can_id").alias("can_id_max"),
        F.min("dlc").alias("dlc_min"), F.max("dlc").alias("dlc_max"),
        F.min(F.least(*BYTES)).alias("payload_min"), F.max(F.greatest(*BYTES)).alias("payload_max"),
        F.min("delta_t").alias("delta_t_min"), F.max("delta_t").alias("delta_t_max"),
        _count(outside("can_id")).alias("invalid_can_id"), _count(outside("dlc")).alias("invalid_dlc"),
        F.sum(sum(outside(b).cast("long") for b in BYTES)).alias("invalid_payload"),
        _count(F.col("delta_t") < 0).alias("invalid_delta_t"),
    )


def _finite(c: str) -> Column:
    x = F.col(c).cast("double")
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def enforce_protocol(f: DataFrame, dt_max: float | None = None) -> DataFrame:
    """Round half-even and clip the integer channels, clip the gap, zero bytes at positions >= dlc.

    Values that are not finite raise: they are never repaired in silence.
    """
    ok = reduce(lambda a, b: a & b, [_finite(c) for c in CHANNELS])
    val = lambda c: F.when(ok, F.col(c).cast("double")).otherwise(F.raise_error(F.lit("value is not finite")).cast("double"))
    whole = lambda c: F.least(F.greatest(F.rint(val(c)), F.lit(float(RANGES[c][0]))), F.lit(float(RANGES[c][1])))
    keep = [c for c in f.columns if c not in CHANNELS]
    d = f.select(*keep, whole("can_id").alias("can_id"), whole("dlc").alias("dlc"), *[whole(b).alias(b) for b in BYTES],
                 F.greatest(val("delta_t"), F.lit(0.0)).alias("delta_t"))
    if dt_max is not None:
        d = d.withColumn("delta_t", F.least("delta_t", F.lit(float(dt_max))))
    pad = [F.when(F.col("dlc") <= j, 0.0).otherwise(F.col(b)).alias(b) for j, b in enumerate(BYTES)]
    return d.select(*keep, "can_id", "dlc", *pad, "delta_t")


def repair_stats(raw: DataFrame, fixed: DataFrame, keys: list[str]) -> DataFrame:
    """How many values the repair changed, by kind."""
    j = raw.select(*keys, *[F.col(c).cast("double").alias(f"r_{c}") for c in CHANNELS]).join(
        fixed.select(*keys, *[F.col(c).cast("double").alias(f"p_{c}") for c in CHANNELS]), keys)
    changed = lambda c: (F.abs(F.col(f"r_{c}") - F.col(f"p_{c}")) > TOL).cast("long")
    slots = sum((F.col("p_dlc") <= i).cast("long") for i in range(8))
    zeroed = sum(((F.col("p_dlc") <= i) & (F.col(f"r_{b}") != 0)).cast("long") for i, b in enumerate(BYTES))
    g = j.agg(
        F.count("*").alias("frames"),
        F.sum(sum(changed(c) for c in INTEGER)).alias("integer_values_changed"),
        _count(F.col("r_delta_t") < 0).alias("negative_delta_t_clipped"),
        F.sum(slots).alias("padding_slots"),
        F.sum(zeroed).alias("padding_zeroed"),
        F.sum(sum(changed(c) for c in CHANNELS)).alias("values_changed"),
    )
    return g.select(
        "*", (F.col("integer_values_changed") / (F.col("frames") * 10)).alias("integer_share"),
        (F.col("values_changed") / (F.col("frames") * 11)).alias("value_share"),
    )


def protocol_validity(f: DataFrame, by: list[str] = (), ref: tuple[float, float] | None = None) -> DataFrame:
    """Finite, integer, range and padding faults; a reference gap range is only reported."""
    ch = lambda c: F.col(c).cast("double")
    isint = lambda c: F.abs(ch(c) - F.rint(ch(c))) <= TOL
    inr = lambda c: ch(c).between(*RANGES[c])
    fin = _finite
    dlc_ok = fin("dlc") & isint("dlc") & inr("dlc")
    pad = [dlc_ok & (F.rint(ch("dlc")) <= j) for j in range(8)]
    bad_pad = [p & (~fin(b) | (ch(b) != 0)) for p, b in zip(pad, BYTES)]
    tally = lambda conds: F.sum(sum(F.coalesce(c, F.lit(False)).cast("long") for c in conds))
    groups = {"can_id": ["can_id"], "dlc": ["dlc"], "payload": BYTES}
    aggs = [F.count("*").alias("frames")]
    for g, cs in groups.items():
        aggs += [
            tally([~fin(c) for c in cs]).alias(f"nonfinite_{g}"),
            tally([fin(c) & ~isint(c) for c in cs]).alias(f"noninteger_{g}"),
            tally([fin(c) & ~inr(c) for c in cs]).alias(f"out_of_range_{g}"),
        ]
    bad_frame = _any([~F.coalesce(fin(c) & isint(c) & inr(c), F.lit(False)) for c in INTEGER] + [~fin("delta_t"), ch("delta_t") < 0, *bad_pad])
    aggs += [
        tally([~fin("delta_t")]).alias("nonfinite_delta_t"),
        tally([fin("delta_t") & (ch("delta_t") < 0)]).alias("negative_delta_t"),
        tally(pad).alias("padding_slots"),
        tally(bad_pad).alias("nonzero_padding_slots"),
        tally([_any(bad_pad)]).alias("frames_with_nonzero_padding"),
        tally([bad_frame]).alias("invalid_frames"),
    ]
    if ref is not None:
        aggs += [tally([fin("delta_t") & (ch("delta_t") < ref[0])]).alias("below_reference"), tally([fin("delta_t") & (ch("delta_t") > ref[1])]).alias("above_reference")]
    d = f.groupBy(*by).agg(*aggs)
    faults = [c for c in d.columns if c.startswith(("nonfinite_", "noninteger_", "out_of_range_"))] + ["negative_delta_t", "nonzero_padding_slots"]
    out = [
        (1 - F.coalesce(F.try_divide("nonzero_padding_slots", "padding_slots"), F.lit(0.0))).alias("padding_zero_share"),
        (1 - F.col("invalid_frames") / F.col("frames")).alias("valid_frame_share"),
        (sum(F.col(c) for c in faults) == 0).alias("valid"),
    ]
    if ref is not None:
        finite = F.col("frames") - F.col("nonfinite_delta_t")
        inside = F.coalesce(1 - F.try_divide(F.col("below_reference") + F.col("above_reference"), finite), F.lit(0.0))
        out.append(inside.alias("delta_t_in_reference_share"))
    return d.select("*", *out)


def condition_audit(pool: DataFrame, names: dict[int, str]) -> DataFrame:
    """Do label, name and requested condition of each pool window agree?"""
    expected = F.coalesce(*[F.when(F.col("y_attack_type") == k, F.lit(v)) for k, v in names.items()], F.lit(""))
    valid = F.col("y_attack_type").isin(*names)
    name = valid & (F.col("synthetic_type") == expected)
    lab = F.col("condition_label") == F.col("y_attack_type") if "condition_label" in pool.columns else F.lit(True)
    cname = F.col("condition_name") == F.col("synthetic_type") if "condition_name" in pool.columns else F.lit(True)
    binary = F.col("y_binary") == 1
    share = lambda c, n: F.avg(c.cast("double")).alias(n)
    every = binary & valid & name & lab & cname
    return pool.agg(
        F.count("*").alias("windows"), share(binary, "binary_share"), share(valid, "valid_label_share"), share(name, "name_share"),
        share(lab, "condition_label_share"), share(cname, "condition_name_share"), share(every, "all_share"), F.bool_and(every).alias("all_valid"),
    )


def support_profile(f: DataFrame, normal_ids: DataFrame, all_ids: DataFrame, by: list[str]) -> DataFrame:
    """Share of frames with known ids, integer dlc, values at the bounds, zero gaps.

    Frames are counted per id before they meet the vocabularies.
    """
    at = lambda c, lo, hi: ((F.col(c) == lo) | (F.col(c) == hi)).cast("long")
    g = f.groupBy(*by, F.col("can_id").cast("long").alias("can_id")).agg(
        F.count("*").alias("n"),
        _count(F.abs(F.col("dlc") - F.rint(F.col("dlc").cast("double"))) < TOL).alias("_int"),
        F.sum(sum(at(b, 0, 255) for b in BYTES)).alias("_pb"),
        F.sum(at("can_id", 0, MAX_ID)).alias("_ib"),
        _count(F.col("delta_t") == 0).alias("_z"),
    )
    vocab = lambda d, n: d.select(F.col("can_id").cast("long").alias("can_id")).distinct().withColumn(n, F.lit(1))
    g = g.join(vocab(normal_ids, "_vn"), "can_id", "left").join(vocab(all_ids, "_va"), "can_id", "left")
    n = F.sum("n")
    known = lambda c: F.coalesce(F.sum(F.when(F.col(c) == 1, F.col("n"))), F.lit(0)) / n
    return g.groupBy(*by).agg(
        n.alias("frames"), F.count("*").alias("unique_ids"), known("_vn").alias("in_normal_vocab"), known("_va").alias("in_all_vocab"),
        (F.sum("_int") / n).alias("dlc_integer_share"), (F.sum("_pb") / (n * 8)).alias("payload_bound_share"),
        (F.sum("_ib") / n).alias("id_bound_share"), (F.sum("_z") / n).alias("delta_t_zero_share"),
    )


def window_digest(w: DataFrame, frames="frames", out="digest") -> DataFrame:
    """SHA-256 of a window's frames as text; -0.0 counts as 0.0."""
    text = F.transform(frames, lambda f: F.concat_ws(",", *[(f[c].cast("double") + F.lit(0.0)).cast("string") for c in CHANNELS]))
    return w.withColumn(out, F.sha2(F.array_join(text, ";").cast("binary"), 256))


def content_uniqueness(d: DataFrame, by: list[str], digest="digest") -> DataFrame:
    """Windows, distinct contents and repeats per group; copies collapse before the shuffle."""
    c = d.groupBy(*by, digest).agg(F.count("*").alias("_n"))
    return c.groupBy(*by).agg(
        F.sum("_n").alias("windows"), F.count("*").alias("unique_windows"), F.count_if(F.col("_n") > 1).alias("repeated_contents")
    ).withColumn("repeats", F.col("windows") - F.col("unique_windows"))


def ordered_digest(d: DataFrame, rank: str, label="y_attack_type", digest="digest", fan=4096) -> DataFrame:
    """Hash of label byte and row digest in order: a tree of hashes, ``fan`` children per node.

    ``rank`` is dense from 1. The number of levels follows the number of rows, so one node is
    left; no node gathers more than ``fan`` rows.
    """
    levels, rows = 1, d.count()
    while fan**levels < rows:
        levels += 1
    cur = d.select((F.col(rank) - 1).alias("i"), F.concat(F.lpad(F.hex(F.col(label).cast("long")), 2, "0"), F.col(digest)).alias("h"))
    for _ in range(levels):
        node = F.sort_array(F.collect_list(F.struct("i", "h")))
        cur = cur.groupBy(F.floor(F.col("i") / fan).alias("p")).agg(F.sha2(F.array_join(node["h"], "").cast("binary"), 256).alias("h"))
        cur = cur.select(F.col("p").alias("i"), "h")
    return cur.select(F.col("h").alias("digest"))


def pool_overlap(d: DataFrame, pool="pool", digest="digest") -> DataFrame:
    """For each pair of pools the number of shared contents and the shares they make.

    Contents are reduced to the set of pools that hold them; pairs are formed
    on the distinct sets, whose number depends on the pools and not on the rows.
    """
    rows = d.groupBy(pool, digest).agg(F.count("*").alias("_n"))
    size = rows.groupBy(pool).agg(F.sum("_n").alias("rows"), F.count("*").alias("unique_rows"))
    sets = rows.groupBy(digest).agg(F.sort_array(F.collect_set(pool)).alias("_s")).groupBy("_s").agg(F.count("*").alias("_c"))
    right = F.explode(F.filter("_s", lambda x: x > F.col("left_pool")))
    pairs = sets.select("_s", "_c", F.explode("_s").alias("left_pool")).select("left_pool", right.alias("right_pool"), "_c")
    shared = pairs.groupBy("left_pool", "right_pool").agg(F.sum("_c").alias("overlap"))
    side = lambda s: size.select(F.col(pool).alias(f"{s}_pool"), F.col("rows").alias(f"{s}_rows"), F.col("unique_rows").alias(f"{s}_unique"))
    names = size.agg(F.sort_array(F.collect_list(pool)).alias("_p"))
    grid = names.select("_p", F.explode("_p").alias("left_pool")).select("left_pool", F.explode(F.filter("_p", lambda x: x > F.col("left_pool"))).alias("right_pool"))
    j = grid.join(shared, ["left_pool", "right_pool"], "left").join(side("left"), "left_pool").join(side("right"), "right_pool")
    n = F.coalesce("overlap", F.lit(0))
    same = (F.col("left_rows") == F.col("right_rows")) & (F.col("left_unique") == F.col("left_rows")) & (F.col("right_unique") == F.col("right_rows")) & (n == F.col("left_rows"))
    return j.select(
        "left_pool", "right_pool", "left_rows", "right_rows", "left_unique", "right_unique", n.alias("overlap"),
        (n / F.col("left_rows")).alias("left_share"), (n / F.col("right_rows")).alias("right_share"), same.alias("identical_sets"),
    )


def temporal_filter(real: DataFrame, syn: DataFrame, cls="y_attack_type", lo=0.05, hi=0.95) -> DataFrame:
    """Flag synthetic windows whose gap mean and SD lie in the class range of the real ones."""
    m = O.exact_quantiles(real, [cls], "delta_t_mean", {"m_lo": lo, "m_hi": hi})
    s = O.exact_quantiles(real, [cls], "delta_t_std", {"s_lo": lo, "s_hi": hi})
    d = syn.join(m.join(s, cls), cls, "left")
    keep = F.col("delta_t_mean").between(F.col("m_lo"), F.col("m_hi")) & F.col("delta_t_std").between(F.col("s_lo"), F.col("s_hi"))
    return d.withColumn("temporal_keep", F.coalesce(keep, F.lit(False))).drop("m_lo", "m_hi", "s_lo", "s_hi")


def artifact_filter(syn: DataFrame, score: str, order: str, keep=0.7, cls="y_attack_type") -> DataFrame:
    """Flag the ceil(n*keep) lowest scores of each class, ties in ``order``."""
    d = O.ranked_by_value(syn, [cls], score, [order], "_r")
    return d.withColumn("artifact_keep", F.col("_r") <= F.ceil(F.col("_r_total") * F.lit(keep))).drop("_r", "_r_total")


def filter_stats(d: DataFrame, filters: dict[str, Column], score: str, names: dict[int, str], cls="y_attack_type") -> DataFrame:
    """Kept windows, share, scores and class counts of each filter, in one scan."""
    flags = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in filters.items()]), lambda x: x.isNotNull())
    total = d.agg(F.count("*")).scalar()
    e = d.select(cls, score, F.explode(flags).alias("filter"))
    return e.groupBy("filter").agg(
        F.count("*").alias("windows"), F.avg(score).alias("score_mean"), F.max(score).alias("score_max"),
        *[F.count_if(F.col(cls) == k).alias(f"{n.lower()}_windows") for k, n in names.items()],
    ).withColumn("keep_ratio", F.col("windows") / total)


def pair_gates(a: DataFrame, b: DataFrame, keys: list[str], channel="data1", injected="injected") -> DataFrame:
    """Are two frame tables equal but for one channel, with the same values in it, moved only on injected frames?

    ``keys`` name the window; frames match on (keys, pos).
    """
    rest = [c for c in CHANNELS if c != channel]
    ra = a.select(*keys, "pos", injected, *[F.col(c).alias(f"a_{c}") for c in CHANNELS])
    rb = b.select(*keys, "pos", *[F.col(c).alias(f"b_{c}") for c in CHANNELS])
    j = ra.join(rb, [*keys, "pos"], "full")
    differ = lambda c: (~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))).cast("long")
    values = lambda s: F.sort_array(F.collect_list(f"{s}_{channel}"))
    w = j.groupBy(*keys).agg(
        F.count("*").alias("frames"),
        F.sum(sum(differ(c) for c in rest)).alias("other"),
        F.sum(differ(channel) * (~F.col(injected)).cast("long")).alias("off"),
        F.sum(differ(channel) * F.col(injected).cast("long")).alias("moved"),
        (values("a") == values("b")).alias("multiset"),
    )
    return w.agg(
        F.count("*").alias("windows"), F.sum("frames").alias("frames"), F.sum("other").alias("other_channel_changes"),
        F.sum("off").alias("changes_off_injected"), F.sum("moved").alias("moved_values"), F.count_if(~F.col("multiset")).alias("windows_with_new_values"),
        ((F.sum("other") == 0) & (F.sum("off") == 0) & F.bool_and("multiset")).alias("pass"),
    )


def relation_residual(f: DataFrame, keys: list[str], injected="injected", cls="y_attack_type") -> DataFrame:
    """Injected frames still inside the byte relation, per class, with the structural minimum."""
    d0, d1 = F.col("data0").cast("long"), F.col("data1").cast("long")
    gear = F.abs(F.lit(255) - d0 - d1) <= 8
    rpm = F.pmod(d1 - 8 * d0, F.lit(256)) < 8
    f = f.where(F.col(injected) & F.col(cls).isin(3, 4))
    f = f.withColumn("_in", F.when(F.col(cls) == 3, gear).otherwise(rpm)).withColumn("_b", d0 % 32)
    b = f.groupBy(*keys, cls, "_b").agg(F.count("*").alias("n"), F.count_if("_in").alias("hits"))
    w = b.groupBy(*keys, cls).agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"), F.max("n").alias("top"))
    floor = F.when(F.col(cls) == 4, F.greatest(F.lit(0), 2 * F.col("top") - F.col("n"))).otherwise(0)
    return w.groupBy(cls).agg(
        F.count("*").alias("windows"), F.sum("n").alias("frames"), F.sum("hits").alias("residual"), F.sum(floor).alias("structural_minimum")
    ).withColumn("residual_share", F.col("residual") / F.col("frames"))


def visibility(a: DataFrame, b: DataFrame, keys: list[str], features: list[str]) -> tuple[DataFrame, DataFrame]:
    """Windows in which any feature differs, and for each feature how many windows differ."""
    ra = a.select(*keys, F.array(*[F.col(c).cast("double") for c in features]).alias("_a"))
    rb = b.select(*keys, F.array(*[F.col(c).cast("double") for c in features]).alias("_b"))
    j = ra.join(rb, keys).withColumn("_d", F.zip_with("_a", "_b", lambda x, y: (~x.eqNullSafe(y)).cast("long")))
    per_window = j.agg(F.count("*").alias("windows"), F.count_if(F.array_max("_d") == 1).alias("visible_windows"))
    names = F.array(*[F.lit(c) for c in features])
    e = j.select(F.explode(F.arrays_zip(names.alias("n"), F.col("_d").alias("d"))).alias("z"))
    per_feature = e.groupBy(F.col("z.n").alias("feature")).agg(F.sum("z.d").alias("windows"))
    return per_window, per_feature


def assert_disjoint(w: DataFrame, by: list[str], start="start_index", end="end_index") -> DataFrame:
    """Per segment the number of adjacent pairs, overlaps and repeated rows."""
    d = O.previous(w, by, start, {"_pe": end})
    g = d.groupBy(*by).agg(
        F.count("*").alias("windows"), F.count_if(F.col("_pe").isNotNull()).alias("comparisons"),
        F.count_if(F.col(start) <= F.col("_pe")).alias("overlaps"),
    )
    dup = w.groupBy(*by, start, end).agg(F.count("*").alias("n")).groupBy(*by).agg(F.sum(F.col("n") - 1).alias("repeated_rows"))
    return g.join(dup, by)


def grid_report(d: DataFrame, levels: dict[str, list], finite: list[str] = (), bounded: dict[str, str] | None = None) -> DataFrame:
    """Missing, extra and double cells of a full grid, and values that are not finite or exceed their bound.

    The grid is made from the level lists, which are parameters.
    """
    lost = [c for c in [*levels, *finite, *(bounded or {})] if c not in d.columns]
    if lost:
        raise ValueError(f"columns missing: {lost}")
    grid = d.sparkSession.range(1).select()
    for name, values in levels.items():
        grid = grid.select("*", F.explode(F.array(*[F.lit(v) for v in values])).alias(name))
    keys = list(levels)
    cells = d.groupBy(*keys).agg(F.count("*").alias("_n"))
    n = lambda x: x.agg(F.count("*")).scalar()
    bad = _any([~_finite(c) for c in finite]) if finite else F.lit(False)
    over = _any([(F.col(c) > F.col(m)) | (F.col(c) < 0) for c, m in (bounded or {}).items()]) if bounded else F.lit(False)
    return d.agg(F.count("*").alias("rows"), F.count_if(bad).alias("not_finite"), F.count_if(over).alias("out_of_bounds")).select(
        "*",
        n(grid.join(cells, keys, "left_anti")).alias("missing"),
        n(cells.join(grid, keys, "left_anti")).alias("extra"),
        n(cells.where("_n > 1")).alias("double"),
    )


def assert_grid(d: DataFrame, levels: dict[str, list], finite: list[str] = (), bounded: dict[str, str] | None = None) -> DataFrame:
    """``d`` unchanged if its grid is complete, else an error that names the first fault."""
    r = grid_report(d, levels, finite, bounded)
    for c in ("missing", "extra", "double", "not_finite", "out_of_bounds"):
        fault = r.select(F.when(F.col(c) > 0, F.raise_error(F.lit(f"grid has {c} cells")).cast("long")).otherwise(F.lit(0).cast("long"))).scalar()
        d = d.where(fault == 0)
    return d


def validate_source(w: DataFrame) -> DataFrame:
    """Shape, finiteness and label agreement of training windows."""
    bad = F.exists("frames", lambda f: _any([F.isnan(f[c].cast("double")) | f[c].isNull() for c in CHANNELS]))
    agree = (F.col("y_binary") == 1) == (F.col("y_attack_type") > 0)
    return w.agg(
        F.count("*").alias("windows"), F.count_if(F.size("frames") != 128).alias("bad_length"), F.count_if(bad).alias("not_finite"),
        F.count_if(~agree).alias("label_conflicts"), F.count_if(F.col("y_binary") == 0).alias("normals"),
    ).withColumn("valid", (F.col("bad_length") + F.col("not_finite") + F.col("label_conflicts") == 0) & (F.col("normals") > 0))


def retention(w: DataFrame, kept: Column, by: list[str]) -> DataFrame:
    """Full and kept windows by each of the named columns, one grouping set per column."""
    g = w.withColumn("_k", kept.cast("long")).groupingSets([(c,) for c in by], *by).agg(
        F.count("*").alias("full_windows"), F.sum("_k").alias("kept_windows"), F.grouping_id().alias("_g"))
    kind = F.coalesce(*[F.when(F.col("_g") == (1 << len(by)) - 1 - (1 << (len(by) - 1 - i)), F.lit(c)) for i, c in enumerate(by)])
    value = F.coalesce(*[F.col(c).cast("string") for c in by])
    return g.select(kind.alias("group_type"), value.alias("group_key"), "full_windows", "kept_windows", (F.col("kept_windows") / F.col("full_windows")).alias("kept_share"))


def table_diff(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Cells that differ between two result tables, with both values."""
    cols = [c for c in a.columns if c not in key]
    ra = a.select(*key, *[F.col(c).alias(f"a_{c}") for c in cols], F.lit(1).alias("_ina"))
    rb = b.select(*key, *[F.col(c).alias(f"b_{c}") for c in cols], F.lit(1).alias("_inb"))
    j = ra.join(rb, key, "full")
    status = F.when(F.col("_inb").isNull(), "only_a").when(F.col("_ina").isNull(), "only_b").otherwise(
        F.when(_any([~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")) for c in cols]), "differs").otherwise("equal"))
    return j.select(*key, status.alias("status"), *[x for c in cols for x in (f"a_{c}", f"b_{c}")])


def draw_identity(a: DataFrame, b: DataFrame, position: list[str], row: str) -> DataFrame:
    """Do two recorded draws hold the same row at each position, each row once?"""
    j = a.select(*position, F.col(row).alias("_ra")).join(b.select(*position, F.col(row).alias("_rb")), position, "full")
    uniq = lambda d: d.agg((F.count("*") - F.count_distinct(row))).scalar()
    return j.agg(
        F.count("*").alias("positions"), F.count_if(F.col("_ra").eqNullSafe(F.col("_rb"))).alias("same"),
        F.count_if(F.col("_ra").isNull() | F.col("_rb").isNull()).alias("unpaired"),
    ).select("*", uniq(a).alias("repeats_a"), uniq(b).alias("repeats_b"), ((F.col("same") == F.col("positions"))).alias("identical"))
