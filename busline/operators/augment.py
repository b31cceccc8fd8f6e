"""Rule-made attack variants of window tables.

A window row holds its frames as an array, so an injection is a narrow
projection: no shuffle, and every draw is hashed from (seed, window, stream,
position), so a recomputed task makes the same frames.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from busline.functions.keyed import draw_int, draw_key, draw_unit
from busline.operators import ordered as O
from busline.operators import sampling as S
from busline.schema import BYTES, CHANNELS, MAX_ID, WINDOW

# Class ids and the ids that the spoofing rules write.
CLASSES = {1: "DoS", 2: "Fuzzy", 3: "Gear", 4: "RPM"}
TARGET_IDS = {"gear": (0x43F, 0x440), "rpm": (0x316, 0x329)}
DT_FLOOR = 1e-5


def explode_frames(w: DataFrame, keys: list[str], frames="frames") -> DataFrame:
    """Window rows to one row per frame.

    ``inline`` yields the fields as columns; exploding structs would let the
    optimizer pull every field out of the array on its own and evaluate a
    computed array once per field.
    """
    numbered = F.transform(frames, lambda f, i: F.struct(i.alias("pos"), *[f[c].alias(c) for c in CHANNELS]))
    return w.select(*keys, F.inline(numbered))


def implode_frames(f: DataFrame, keys: list[str], channels=CHANNELS) -> DataFrame:
    """One row per window again; a window has a fixed number of frames."""
    arr = F.sort_array(F.collect_list(F.struct("pos", *channels)))
    return f.groupBy(*keys).agg(F.transform(arr, lambda x: F.struct(*[x[c].alias(c) for c in channels])).alias("frames"))


def window_key(*cols: str) -> Column:
    return F.concat_ws(":", *[F.col(c).cast("string") for c in cols])


def child_key(*parts) -> Column:
    """Order-independent key of (seed, block, window, attack, stream)."""
    return draw_key(*parts)


def burst_positions(w: DataFrame, seed: int, lens=(32, 90), steps=(1, 2), key="wkey", size=WINDOW) -> DataFrame:
    """Burst length, start and step per window, and the positions they give."""
    k = F.col(key)
    length = F.lit(lens[0]) + draw_int(lens[1] - lens[0] + 1, seed, k, "len")
    w = w.withColumn("burst_len", length)
    w = w.withColumn("burst_start", draw_int(F.lit(size + 1) - F.col("burst_len"), seed, k, "start"))
    pick = draw_int(len(steps), seed, k, "step").cast("int")
    w = w.withColumn("burst_step", F.get(F.array(*[F.lit(s) for s in steps]), pick).cast("long"))
    return with_positions(w)


def with_positions(w: DataFrame) -> DataFrame:
    end = F.col("burst_start") + F.col("burst_len") - 1
    p = F.sequence(F.col("burst_start").cast("long"), end.cast("long"), F.col("burst_step").cast("long"))
    return w.withColumn("positions", p).withColumn("injection_count", F.size("positions").cast("long"))


def _inside(i: Column) -> Column:
    off = i - F.col("burst_start")
    return (off >= 0) & (off < F.col("burst_len")) & (off % F.col("burst_step") == 0)


def _order(i: Column) -> Column:
    """Rank of a position inside its burst."""
    return (i - F.col("burst_start")) / F.col("burst_step")


def clip(c: Column, lo=0, hi=255) -> Column:
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))


def rewrite(w: DataFrame, rule, frames="frames") -> DataFrame:
    """Apply ``rule(frame, position) -> {channel: value}`` to the injected frames."""

    def one(f, i):
        new = rule(f, i)
        hit = _inside(i)
        return F.struct(
            *[
                (F.when(hit, new[c].cast("double")).otherwise(f[c].cast("double")) if c in new else f[c].cast("double")).alias(c)
                for c in CHANNELS
            ]
        )

    return w.withColumn(frames, F.transform(frames, one))


def dos_rule(seed, key):
    def rule(f, i):
        out = {"can_id": F.lit(0), "dlc": F.lit(8)}
        for j, b in enumerate(BYTES):
            out[b] = F.when(draw_unit(seed, key, "byte", i, j) < 0.92, 0).otherwise(255)
        out["delta_t"] = F.lit(0.00003) + draw_unit(seed, key, "dt", i) * F.lit(0.002 - 0.00003)
        return out

    return rule


def fuzzy_rule(seed, key, ids: Column | None = None):
    """Random id (from ``ids`` when given), length, bytes and gap."""

    def rule(f, i):
        u = draw_unit(seed, key, "dlc", i)
        dlc = F.when(u < 0.08, 2).when(u < 0.2, 5).otherwise(8)
        out = {"can_id": _pick_id(ids, draw_unit(seed, key, "id", i)), "dlc": dlc}
        for j, b in enumerate(BYTES):
            out[b] = F.when(F.lit(j) < dlc, draw_int(256, seed, key, "byte", i, j)).otherwise(0)
        out["delta_t"] = F.lit(0.00005) + draw_unit(seed, key, "dt", i) * F.lit(0.02 - 0.00005)
        return out

    return rule


def _pick_id(ids: Column | None, u: Column) -> Column:
    if ids is None:
        return F.floor(u * (MAX_ID + 1))
    return F.get(ids, F.floor(u * F.size(ids)).cast("int"))


def spoof_rule(seed, key, mode: str, can_id, extra: dict[str, int] | None = None):
    """Coupled bytes: d1 near 255-d0 (gear), or both from one engine speed (rpm).

    ``extra`` adds noise of the given half width to further bytes.
    """

    def rule(f, i):
        ident = can_id(i) if callable(can_id) else F.lit(can_id)
        out = {"can_id": ident, "dlc": F.lit(8)}
        noise = lambda half, s: draw_int(2 * half + 1, seed, key, s, i) - half
        if mode == "gear":
            d0 = clip(draw_int(6, seed, key, "level", i) * 40 + draw_int(16, seed, key, "jit", i))
            out["data0"] = d0
            out["data1"] = clip(F.lit(255) - d0 + noise(8, "noise"))
        else:
            rpm = draw_int(8000, seed, key, "rpm", i)
            out["data0"] = F.floor(rpm / 32) % 256
            out["data1"] = F.floor(rpm / 4) % 256
            out["data2"] = clip(f["data2"] + noise(50, "noise"))
        for b, half in (extra or {}).items():
            out[b] = clip(f[b] + noise(half, b))
        out["delta_t"] = F.greatest(f["delta_t"], F.lit(DT_FLOOR))
        return out

    return rule


def inject_dos(w, seed, key="wkey") -> DataFrame:
    return rewrite(burst_positions(w, seed, (32, 90), (1, 2), key), dos_rule(seed, F.col(key)))


def inject_fuzzy(w, seed, key="wkey") -> DataFrame:
    return rewrite(burst_positions(w, seed, (24, 88), (1, 2, 3, 4), key), fuzzy_rule(seed, F.col(key)))


def inject_spoof(w, seed, mode: str, can_id: int | None = None, key="wkey") -> DataFrame:
    ident = TARGET_IDS[mode][0] if can_id is None else can_id
    return rewrite(burst_positions(w, seed, (32, 90), (1, 2, 3), key), spoof_rule(seed, F.col(key), mode, ident))


def inject_class(w, cls: int, seed, key="wkey") -> DataFrame:
    if cls == 1:
        return inject_dos(w, seed, key)
    if cls == 2:
        return inject_fuzzy(w, seed, key)
    return inject_spoof(w, seed, "gear" if cls == 3 else "rpm", key=key)


def _labelled(w: DataFrame, cls: int) -> DataFrame:
    return w.withColumn("y_binary", F.lit(1)).withColumn("y_attack_type", F.lit(cls)).withColumn("synthetic_type", F.lit(CLASSES[cls]))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def draw_bases(normals: DataFrame, n: int, seed: int, key="wkey") -> DataFrame:
    """``n`` draws with replacement per class from the normal windows, which ``key`` tells apart.

    Draws are made in parallel from a range and meet the key of their window by
    its rank; only then are the windows themselves looked up.
    """
    keys = normals.select(F.col(key), draw_key(seed, F.col(key), "base").alias("_k"))
    r = O.ranked(keys, [], ["_k", key], F.floor(F.col("_k") / (1 << 24)), "_rank").drop("_k")
    total = keys.agg(F.count("*")).scalar()
    d = normals.sparkSession.range(n).withColumnRenamed("id", "draw")
    d = d.select("draw", F.explode(F.array(*[F.lit(c) for c in CLASSES])).alias("cls"))
    d = d.withColumn("_rank", F.floor(draw_unit(seed, F.col("cls"), F.col("draw")) * total) + 1)
    d = d.join(r, "_rank").drop("_rank").join(normals, key)
    return d.withColumn(key, F.concat_ws(":", key, "cls", "draw"))


def rule_pool(normals: DataFrame, n: int, seed: int, key="wkey") -> DataFrame:
    """``n`` windows per attack class with labels, injection counts and a shuffled order key."""
    d = draw_bases(normals.drop("y_binary", "y_attack_type"), n, seed, key)
    parts = [_labelled(inject_class(d.where(F.col("cls") == c), c, seed, key), c) for c in CLASSES]
    return _union(parts).drop("cls").withColumn("order_key", draw_key(seed, F.col(key), "order"))


# ---- variant sets: parameters come from a scenario row ----------------------------


def take_slices(normals: DataFrame, sizes: list[int], seed: int, key="wkey") -> DataFrame:
    """Disjoint keyed slices of the normals; ``slice`` numbers them, nothing is used twice.

    Fewer normals than the slices need are an error.
    """
    have = normals.count()
    if have < sum(sizes):
        raise ValueError(f"not enough normal windows: {have} for slices of {sizes}")
    d = normals.withColumn("_k", draw_key(seed, F.col(key), "slice"))
    d = O.ranked(d, [], ["_k", key], F.floor(F.col("_k") / (1 << 24)), "_rank").drop("_k")
    ends, at = [], 0
    for s in sizes:
        at += s
        ends.append(at)
    pick = F.coalesce(*[F.when(F.col("_rank") <= e, F.lit(i)) for i, e in enumerate(ends)])
    return d.withColumn("slice", pick).where(F.col("slice").isNotNull()).drop("_rank")


def _with_params(d: DataFrame, scenarios: list[dict]) -> DataFrame:
    """Scenario parameters by slice: slice 0 is normal, slice i is scenario i-1."""
    for name in scenarios[0]:
        values = [F.when(F.col("slice") == i, F.lit(s[name])) for i, s in enumerate(scenarios, 1)]
        d = d.withColumn(name, F.coalesce(*values))
    return d


def _fixed_burst(d: DataFrame, seed, key="wkey") -> DataFrame:
    return with_positions(
        d.withColumn("burst_start", draw_int(F.lit(WINDOW + 1) - F.col("burst_len"), seed, F.col(key), "start"))
    )


def _ramp(i, scale=255.0):
    m = F.greatest(F.col("injection_count") - 1, F.lit(1))
    return _order(i) / m * scale


def _wave(i, turns=2.0):
    m = F.greatest(F.col("injection_count") - 1, F.lit(1))
    return F.lit(127.5) + 127.5 * F.sin(_order(i) / m * (turns * math.pi))


def _noise(seed, key, i, half, stream="noise"):
    return draw_int(2 * half + 1, seed, key, stream, i) - half


def _finish(d: DataFrame) -> DataFrame:
    ids = {"Normal": 0, **{v: k for k, v in CLASSES.items()}}
    d = d.withColumn("attack_type", F.coalesce("attack_type", F.lit("Normal")))
    y = F.coalesce(*[F.when(F.col("attack_type") == n, F.lit(i)) for n, i in ids.items()])
    return d.withColumn("y_attack_type", y).withColumn("y_binary", (y > 0).cast("int")).withColumn(
        "injection_count", F.coalesce("injection_count", F.lit(0).cast("long"))
    )


def _assemble(d: DataFrame, rules: dict[str, object]) -> DataFrame:
    parts = [d.where("slice = 0").withColumn("injection_count", F.lit(0).cast("long"))]
    for name, rule in rules.items():
        parts.append(rewrite(d.where(F.col("attack_type") == name), rule))
    return _finish(_union(parts))


def variant_set(normals: DataFrame, n_normal: int, n_attack: int, seed: int, key="wkey") -> DataFrame:
    """Held-out normals plus four injected families; no base window is used twice."""
    k = F.col(key)
    fam = [{"attack_type": a} for a in ("DoS", "Fuzzy", "Gear", "RPM")]
    d = _with_params(take_slices(normals, [n_normal] + [n_attack] * 4, seed, key), fam)
    lo = F.when(F.col("attack_type") == "Fuzzy", 40).otherwise(48)
    d = d.withColumn("burst_len", lo + draw_int(F.lit(97) - lo, seed, k, "len"))
    steps = F.when(F.col("attack_type") == "DoS", 2).when(F.col("attack_type") == "Fuzzy", 3)
    d = d.withColumn("burst_step", F.coalesce(draw_int(steps, seed, k, "step") + 1, F.lit(2).cast("long")))
    d = _fixed_burst(d, seed, key)
    zero = {b: F.lit(0) for b in BYTES}
    byte = lambda i, j: draw_int(256, seed, k, "byte", i, j)
    rules = {
        "DoS": lambda f, i: {"can_id": F.lit(0), "dlc": F.lit(8), **zero, "delta_t": F.greatest(f["delta_t"] * 0.25, F.lit(DT_FLOOR))},
        "Fuzzy": lambda f, i: {
            "can_id": draw_int(MAX_ID + 1, seed, k, "id", i),
            "dlc": F.lit(8),
            **{b: byte(i, j) for j, b in enumerate(BYTES)},
            "delta_t": F.lit(0.00005) + draw_unit(seed, k, "dt", i) * (0.015 - 0.00005),
        },
        "Gear": lambda f, i: {
            "can_id": F.lit(TARGET_IDS["gear"][0]), "dlc": F.lit(8), "data0": _ramp(i), "data1": F.lit(255.0) - _ramp(i),
            "data2": clip(f["data2"] + _noise(seed, k, i, 20)),
        },
        "RPM": lambda f, i: {
            "can_id": F.lit(TARGET_IDS["rpm"][0]), "dlc": F.lit(8), "data0": _wave(i), "data1": _ramp(i),
            "data3": clip(f["data3"] + _noise(seed, k, i, 30)),
        },
    }
    return _assemble(d, rules)


# Burst length, step and amplitude of the low, medium and high severity per family.
SEVERITIES = [
    {"attack_type": "DoS", "severity": "low", "burst_len": 24, "burst_step": 3, "amplitude": 0.25},
    {"attack_type": "DoS", "severity": "medium", "burst_len": 48, "burst_step": 2, "amplitude": 0.5},
    {"attack_type": "DoS", "severity": "high", "burst_len": 96, "burst_step": 1, "amplitude": 1.0},
    {"attack_type": "Fuzzy", "severity": "low", "burst_len": 24, "burst_step": 4, "amplitude": 0.25},
    {"attack_type": "Fuzzy", "severity": "medium", "burst_len": 48, "burst_step": 3, "amplitude": 0.5},
    {"attack_type": "Fuzzy", "severity": "high", "burst_len": 96, "burst_step": 1, "amplitude": 1.0},
    {"attack_type": "Gear", "severity": "low", "burst_len": 24, "burst_step": 4, "amplitude": 0.25},
    {"attack_type": "Gear", "severity": "medium", "burst_len": 48, "burst_step": 2, "amplitude": 0.5},
    {"attack_type": "Gear", "severity": "high", "burst_len": 96, "burst_step": 1, "amplitude": 1.0},
    {"attack_type": "RPM", "severity": "low", "burst_len": 24, "burst_step": 4, "amplitude": 0.25},
    {"attack_type": "RPM", "severity": "medium", "burst_len": 48, "burst_step": 2, "amplitude": 0.5},
    {"attack_type": "RPM", "severity": "high", "burst_len": 96, "burst_step": 1, "amplitude": 1.0},
]


def severity_set(normals: DataFrame, n_normal: int, n_each: int, seed: int, grid=None, key="wkey") -> DataFrame:
    """One slice per family and severity; payloads blend towards the attack by the amplitude."""
    grid = grid or SEVERITIES
    k, a = F.col(key), F.col("amplitude")
    d = _with_params(take_slices(normals, [n_normal] + [n_each] * len(grid), seed, key), grid)
    d = _fixed_burst(d, seed, key)
    keep = lambda c: c * (F.lit(1.0) - a)
    floor = lambda f: F.greatest(f["delta_t"], F.lit(DT_FLOOR))
    rules = {
        "DoS": lambda f, i: {
            "can_id": F.lit(0), "dlc": F.lit(8), **{b: F.lit(0) for b in BYTES},
            "delta_t": F.greatest(f["delta_t"] * (F.lit(0.4) - 0.25 * a), F.lit(DT_FLOOR)),
        },
        "Fuzzy": lambda f, i: {
            "can_id": draw_int(MAX_ID + 1, seed, k, "id", i), "dlc": F.lit(8),
            **{b: clip(keep(f[b]) + a * draw_int(256, seed, k, "byte", i, j)) for j, b in enumerate(BYTES)},
            "delta_t": F.lit(0.00005) + draw_unit(seed, k, "dt", i) * (F.lit(0.005 - 0.00005) + 0.01 * a),
        },
        "Gear": lambda f, i: {
            "can_id": F.lit(TARGET_IDS["gear"][0]), "dlc": F.lit(8),
            "data2": clip(keep(f["data2"]) + _ramp(i) * a), "data3": clip(keep(f["data3"]) + F.lit(255.0) - _ramp(i) * a),
            "data4": clip(f["data4"] + _noise(seed, k, i, 10) * a), "delta_t": floor(f),
        },
        "RPM": lambda f, i: {
            "can_id": F.lit(TARGET_IDS["rpm"][0]), "dlc": F.lit(8),
            "data2": clip(keep(f["data2"]) + _wave(i) * a), "data3": clip(keep(f["data3"]) + _ramp(i) * a),
            "data5": clip(f["data5"] + _noise(seed, k, i, 15) * a), "delta_t": floor(f),
        },
    }
    return _assemble(d, rules)


def _id_grid(length: int, step: int) -> list[dict]:
    """Both families with their canonical and their shifted id."""
    burst = {"burst_len": length, "burst_step": step}
    return [
        {"attack_type": "Gear", "id_condition": "canonical", "target_id": TARGET_IDS["gear"][0], **burst},
        {"attack_type": "Gear", "id_condition": "shifted", "target_id": TARGET_IDS["gear"][1], **burst},
        {"attack_type": "RPM", "id_condition": "canonical", "target_id": TARGET_IDS["rpm"][0], **burst},
        {"attack_type": "RPM", "id_condition": "shifted", "target_id": TARGET_IDS["rpm"][1], **burst},
    ]


def id_shift_set(normals: DataFrame, n_normal: int, n_each: int, seed: int, key="wkey") -> DataFrame:
    """The same payload rule on the canonical and on a shifted id."""
    k, grid = F.col(key), _id_grid(64, 2)
    d = _fixed_burst(_with_params(take_slices(normals, [n_normal] + [n_each] * 4, seed, key), grid), seed, key)
    base = lambda f: {"can_id": F.col("target_id"), "dlc": F.lit(8), "delta_t": F.greatest(f["delta_t"], F.lit(DT_FLOOR))}
    rules = {
        "Gear": lambda f, i: {**base(f), "data2": _ramp(i), "data3": F.lit(255.0) - _ramp(i), "data4": clip(f["data4"] + _noise(seed, k, i, 8))},
        "RPM": lambda f, i: {**base(f), "data2": _wave(i), "data3": _ramp(i), "data5": clip(f["data5"] + _noise(seed, k, i, 12))},
    }
    return _assemble(d, rules)


def payload_shift_set(normals: DataFrame, n_normal: int, n_each: int, seed: int, key="wkey") -> DataFrame:
    """The pattern moved to bytes that the pool never writes."""
    k, grid = F.col(key), _id_grid(96, 3)
    d = _fixed_burst(_with_params(take_slices(normals, [n_normal] + [n_each] * 4, seed, key), grid), seed, key)
    base = lambda f: {"can_id": F.col("target_id"), "dlc": F.lit(8), "delta_t": F.greatest(f["delta_t"], F.lit(DT_FLOOR))}
    rules = {
        "Gear": lambda f, i: {**base(f), "data6": _ramp(i), "data7": clip(F.lit(255.0) - _ramp(i) + _noise(seed, k, i, 10))},
        "RPM": lambda f, i: {**base(f), "data4": (_order(i) * 37) % 256, "data6": _wave(i, 3.0), "data7": clip(_ramp(i) + _noise(seed, k, i, 12))},
    }
    return _assemble(d, rules)


def quota_bases(normals: DataFrame, sizes: dict[int, int], seed: int, key="wkey") -> DataFrame:
    """Each class draws its number of normal windows: without replacement, or with it where there are too few.

    Only keys are ranked; windows are looked up once they are drawn.
    """
    keys, have = normals.select(key), normals.count()
    if not have and any(sizes.values()):
        raise ValueError("no normal windows to draw from")
    parts = []
    for c, n in sizes.items():
        r = S.first_ranks(keys, [], min(n, have) if n <= have else have, seed, key, f"base{c}", "_rank")
        if n > have:
            draws = normals.sparkSession.range(n).select(F.col("id").alias("draw"), (F.floor(draw_unit(seed, c, F.col("id")) * have) + 1).alias("_rank"))
            r = draws.join(r, "_rank")
        else:
            r = r.withColumn("draw", F.col("_rank") - 1)
        parts.append(r.select(key, "draw", F.lit(c).alias("cls")))
    d = _union(parts).join(normals, key)
    return d.withColumn(key, F.concat_ws(":", key, "cls", "draw"))


def target_pool(normals: DataFrame, n_train: int, seed: int, ratio=0.3, full_ids=False, key="wkey") -> DataFrame:
    """round(n_train * ratio) rule attacks on target normals with ids drawn from the target's own id set.

    The classes share the number equally, the first ones take the remainder.
    With ``full_ids`` Fuzzy draws from all ids instead. The id set is at most
    all 11-bit ids, so it fits one array.
    """
    ids = normals.select(F.explode("frames.can_id").alias("i")).select(F.col("i").cast("int").alias("i")).where(F.col("i").between(0, MAX_ID))
    support = ids.agg(F.sort_array(F.collect_set("i")).alias("ids")).scalar()
    d = quota_bases(normals.drop("y_binary", "y_attack_type"), S.quotas(S.half_even(n_train * ratio), tuple(CLASSES)), seed, key)
    full = F.sequence(F.lit(0), F.lit(MAX_ID))
    d = d.withColumn("_ids", support).withColumn("_ids", F.when(F.size("_ids") > 0, F.col("_ids")).otherwise(full))
    k, sup = F.col(key), F.col("_ids")
    ident = lambda i: _pick_id(sup, draw_unit(seed, k, "id", i))
    spoof = lambda mode, extra: spoof_rule(seed, k, mode, ident, extra)
    parts = []
    for c, (lens, steps, rule) in {
        1: ((32, 90), (1, 2), dos_rule(seed, k)),
        2: ((24, 88), (1, 2, 3, 4), fuzzy_rule(seed, k, None if full_ids else sup)),
        3: ((32, 90), (1, 2, 3), spoof("gear", {"data6": 16})),
        4: ((32, 90), (1, 2, 3), spoof("rpm", {"data5": 24})),
    }.items():
        parts.append(_labelled(rewrite(burst_positions(d.where(F.col("cls") == c), seed, lens, steps, key), rule), c))
    return _union(parts).drop("cls", "_ids")


def injection_stats(pool: DataFrame, by: list[str]) -> DataFrame:
    return pool.groupBy(*by).agg(
        F.count("*").alias("windows"),
        F.avg("injection_count").alias("mean"),
        F.min("injection_count").alias("min"),
        F.max("injection_count").alias("max"),
    )


# ---- relation-breaking twin ---------------------------------------------------------


def placebo_twin(pool: DataFrame, seed: int, key="wkey") -> DataFrame:
    """Rotate data1 among the injected spoof frames across value bins of data0.

    Marginals of every channel stay, the relation between data0 and data1 goes.
    Works on the frame array of one window at a time.
    """
    gear = F.col("y_attack_type") == 3

    def entry(p):
        f = F.get("frames", p.cast("int"))
        d0 = f["data0"].cast("long")
        bin_ = F.when(gear, F.least(F.floor(d0 / 40), F.lit(5))).otherwise(d0 % 32)
        return F.struct(bin_.alias("b"), draw_key(seed, F.col(key), "twin", p).alias("k"), p.alias("p"), f["data1"].alias("v"))

    d = pool.withColumn("_s", F.array_sort(F.transform("positions", entry)))
    n = F.size("_s")
    sizes = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda b: F.size(F.filter("_s", lambda e: e["b"] == b)))
    d = d.withColumn("_m", F.array_max(sizes))
    shift = F.when(F.col("_m") * 2 <= n, F.col("_m")).otherwise(n - F.col("_m"))
    d = d.withColumn("_shift", F.when((shift == 0) & (n > 1), 1).otherwise(shift))
    moved = F.transform("_s", lambda e, r: F.struct(e["p"].alias("p"), F.get("_s", ((r + F.col("_shift")) % n).cast("int"))["v"].alias("v")))
    d = d.withColumn("_map", F.map_from_entries(moved))
    swap = lambda f, i: f.withField("data1", F.coalesce(F.try_element_at("_map", i.cast("long")), f["data1"]))
    fresh = F.transform("frames", lambda f, i: F.when(i.between(F.array_min("positions"), F.array_max("positions")), swap(f, i)).otherwise(f))
    spoof = F.col("y_attack_type").isin(3, 4)
    return d.withColumn("frames", F.when(spoof, fresh).otherwise(F.col("frames"))).drop("_s", "_m", "_shift", "_map")


# ---- 2x2x2 factorial ------------------------------------------------------------------

# Bytes written at payload place 0 and 1.
PLACES = {
    "gear": (("data0", "data1"), ("data6", "data7")),
    "rpm": (("data0", "data1", "data2"), ("data4", "data6", "data7")),
}
MASK = 32


def _roles(mode, seed, k, frames, r, d: int):
    """Role values at burst rank ``r`` under dynamics ``d``; one latent serves all cells."""
    ramp = r * (255.0 / (MASK - 1))
    jit = lambda half, s: draw_int(2 * half + 1, seed, k, s, r) - half
    if mode == "gear":
        if d == 0:
            r0 = clip(draw_int(6, seed, k, "level", r) * 40 + draw_int(16, seed, k, "j0", r))
            return [r0, clip(F.lit(255) - r0 + jit(8, "j1"))]
        return [ramp, clip(F.lit(255.0) - ramp + jit(10, "dj"))]
    if d == 0:
        drv = draw_int(8000, seed, k, "rpm", r)
        at = F.get(frames, (F.col("latent_start") + 2 * r).cast("int"))["data2"]
        return [F.floor(drv / 32) % 256, F.floor(drv / 4) % 256, clip(at + jit(50, "j2"))]
    return [(r * 37) % 256, F.lit(127.5) + 127.5 * F.sin(r * (3 * math.pi / (MASK - 1))), clip(ramp + jit(12, "dj"))]


def burst_ranks(step: Column, frames="frames") -> Column:
    """Rank in the burst of each position of a window, null outside: a slice of a fixed array, as only the start moves."""
    at = lambda st: F.array(*[F.lit(j // st if j >= 0 and j % st == 0 and j < st * MASK else None).cast("int") for j in range(-WINDOW, WINDOW)])
    cut = lambda st: F.slice(at(st), (F.lit(WINDOW + 1) - F.col("latent_start")).cast("int"), F.size(frames))
    return F.when(step == 2, cut(2)).when(step == 3, cut(3))


def with_roles(base: DataFrame, mode, seed, k, d: int, n: int = MASK) -> DataFrame:
    """``_roles``: role values at the first ``n`` burst ranks; ``_wide``: the frames as doubles. Made once for all cells of a base."""
    values = lambda r: F.array(*[v.cast("double") for v in _roles(mode, seed, k, F.col("frames"), r, d)])
    wide = F.transform("frames", lambda f: F.struct(*[f[c].cast("double").alias(c) for c in CHANNELS]))
    ranks = F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))
    return base.withColumn("_roles", F.transform(ranks, values)).withColumn("_wide", wide)


def _apply(mode, p: int, step: Column, ident: Column, limit: int | Column = MASK):
    """The frames of ``with_roles`` with the burst written in; frames outside it are handed on as they are."""
    cols = PLACES[mode][p]

    def one(f, r):
        roles = {c: F.get(F.get("_roles", r), F.lit(j)) for j, c in enumerate(cols)}
        new = {"can_id": ident, "dlc": F.lit(8), **roles, "delta_t": F.greatest(f["delta_t"], F.lit(DT_FLOOR))}
        return F.when(r < limit, F.struct(*[(new[c].cast("double") if c in new else f[c]).alias(c) for c in CHANNELS])).otherwise(f)

    return F.zip_with("_wide", burst_ranks(step, "_wide"), one)


def with_latent(base: DataFrame, mode: str, seed: int, key="wkey") -> DataFrame:
    return base.withColumn("attack", F.lit(mode)).withColumn("latent_start", draw_int(33, seed, F.col(key), mode, "start"))


def factorial_windows(base: DataFrame, seed: int, modes=("gear", "rpm"), key="wkey") -> DataFrame:
    """Payload place P, spacing S, dynamics D in all 8 cells, on both ids, from one latent per base."""
    parts = []
    for mode in modes:
        d = with_latent(base, mode, seed, key)
        k = F.concat_ws("|", key, F.lit(mode))
        cells = [(s, st, ident) for s in (0, 1) for st, ident in zip(("canonical", "shifted"), TARGET_IDS[mode])]
        grid = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(st).alias("stratum"), F.lit(i).alias("_id")) for s, st, i in cells])
        step = F.col("s") + 2
        for p in (0, 1):
            for dyn in (0, 1):
                w = with_roles(d, mode, seed, k, dyn).withColumn("_c", F.explode(grid)).select("*", "_c.*").drop("_c")
                w = w.withColumn("p", F.lit(p)).withColumn("d", F.lit(dyn)).withColumn("base_frames", F.col("frames"))
                parts.append(w.withColumn("frames", _apply(mode, p, step, F.col("_id"))))
    return _union(parts).drop("_id", "_roles", "_wide")


def factorial_checks(w: DataFrame, key="wkey") -> DataFrame:
    """Per factor: frames compared and frames where a channel outside the factor changed.

    Cells of one base and attack differ only in the factor under test, so each
    is set beside its level-0 partner with the remaining cell coordinates, and
    their burst frames by position (spacing: by the rank in the burst). One pass
    and one shuffle: the burst frames of the 16 cells of a base and attack meet in one row.
    """
    step = F.col("s") + 2
    same = lambda a, b, cs: reduce(lambda x, y: x & y, [a[c].cast("double") == b[c].cast("double") for c in cs])
    wide = f"array<struct<{', '.join(f'{c}: double' for c in CHANNELS)}>>"
    narrow = F.transform(F.col("base_frames"), lambda f: F.struct(*[f[c].alias(c) for c in CHANNELS])).cast(wide)
    w = w.withColumn("_base", narrow).withColumn("_new", F.col("frames").cast(wide))
    w = w.withColumn("_rank", burst_ranks(step))
    w = w.withColumn("_out", F.filter(F.arrays_zip("_new", "_base", "_rank"), lambda z: z["_rank"].isNull()))
    changed = F.size(F.filter("_out", lambda z: ~same(z["_new"], z["_base"], CHANNELS)))  # counted only where the arrays differ
    w = w.withColumn("_changed", F.when(F.col("_out._new") == F.col("_out._base"), 0).otherwise(changed).cast("long"))

    cell = ["stratum", "p", "s", "d"]
    burst = F.transform(F.sequence(F.lit(0), F.lit(MASK - 1)), lambda r: F.get("_new", (F.col("latent_start") + r * step).cast("int")))
    g = w.groupBy(key, "attack").agg(
        F.collect_list(F.struct(*cell, "latent_start", burst.alias("burst"))).alias("_cells"),
        F.sum(F.size("_out").cast("long")).alias("frames"), F.sum("_changed").alias("violations"))

    def partners(col, lo, hi):
        rest = [c for c in cell if c != col]
        fits = lambda a: lambda b: reduce(lambda u, v: u & v, [b[col] == hi, *[b[c] == a[c] for c in rest]])
        entry = lambda a: lambda b: F.struct(F.lit(col).alias("check"), a.alias("a"), b.alias("b"))
        return F.flatten(F.transform(F.filter("_cells", lambda a: a[col] == lo), lambda a: F.transform(F.filter("_cells", fits(a)), entry(a))))

    both = lambda m, place: {*PLACES[m][0], *PLACES[m][1]}
    roles = lambda m, place: set(PLACES[m][place])
    spaced = lambda m, place: {c for c in CHANNELS if c not in ("can_id", "dlc", *PLACES[m][place])}
    free = {"stratum": lambda m, place: {"can_id"}, "p": both, "d": roles, "s": spaced}
    kinds = [(check, m, place) for check in free for m in PLACES for place in (0, 1)]

    def frozen(holds):
        """Whether ``holds`` is true of the channels that the check, attack and place leave alone."""
        out = F.lit(True)
        for check, m, place in kinds:
            here = (F.col("check") == check) & (F.col("attack") == m) & (F.col("a.p") == place)
            out = F.when(here, holds([c for c in CHANNELS if c not in free[check](m, place)])).otherwise(out)
        return out

    first = F.get("_cells", F.lit(0))
    pairs = g.select("attack", "frames", "violations", F.inline(F.concat(
        F.array(F.struct(F.lit("untouched").alias("check"), first.alias("a"), first.alias("b"))),
        partners("stratum", "canonical", "shifted"), partners("p", 0, 1), partners("d", 0, 1), partners("s", 0, 1))))
    gap, stride = F.col("a.latent_start") - F.col("b.latent_start"), F.col("a.s") + 2
    shift = F.when(F.col("check") == "s", F.lit(0)).when(gap % stride == 0, F.floor(gap / stride))
    d = pairs.select("*", shift.alias("_shift"), *[(F.col(f"a.burst.{c}") == F.col(f"b.burst.{c}")).alias(f"_eq_{c}") for c in CHANNELS])
    whole = (F.col("_shift") == 0) & F.get("a.burst", F.lit(MASK - 1)).isNotNull() & F.get("b.burst", F.lit(MASK - 1)).isNotNull()
    clean = whole & frozen(lambda cs: reduce(lambda x, y: x & y, [F.col(f"_eq_{c}") for c in cs]))
    beside = F.transform("a.burst", lambda x, r: F.struct(x.alias("x"), F.get("b.burst", (r + F.col("_shift")).cast("int")).alias("y")))
    met = F.filter(beside, lambda z: z["x"].isNotNull() & z["y"].isNotNull())
    bad = F.size(F.filter(met, lambda z: ~frozen(lambda cs: same(z["x"], z["y"], cs))))
    base = F.col("check") == "untouched"
    return d.groupBy("attack", "check").agg(
        F.sum(F.when(base, F.col("frames")).when(clean, MASK).otherwise(F.size(met))).alias("frames"),
        F.sum(F.when(base, F.col("violations")).when(clean, 0).otherwise(bad)).alias("violations"))


def sparse_windows(base: DataFrame, ks: tuple[int, ...], seed: int, mode: str, key="wkey") -> DataFrame:
    """Only the first k burst frames are injected, once with the relation intact and once broken."""
    d = with_roles(with_latent(base, mode, seed, key), mode, seed, F.concat_ws("|", key, F.lit(mode)), 0, max(ks))
    d = d.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
    d = d.withColumn("frames", _apply(mode, 0, F.lit(2), F.lit(TARGET_IDS[mode][0]), F.col("k"))).drop("_roles", "_wide")
    d = d.select("*", F.col("latent_start").alias("burst_start"), (F.col("k") * 2 - 1).alias("burst_len"), F.lit(2).alias("burst_step"))
    d = with_positions(d).withColumn("y_attack_type", F.lit(3 if mode == "gear" else 4)).withColumn("y_binary", F.lit(1))
    twin = placebo_twin(d, seed, key)
    return d.withColumn("relation", F.lit("intact")).unionByName(twin.withColumn("relation", F.lit("broken")))
