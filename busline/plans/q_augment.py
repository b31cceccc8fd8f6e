"""Queries for window augmentation (section H)."""

from __future__ import annotations

from pyspark.sql import functions as F

from busline.operators import augment as A
from busline.plans.registry import query
from busline.plans.views import CTES, Tables
from busline.schema import BYTES, CHANNELS

SEED = 7


def u(*parts) -> str:
    """SQL twin of ``draw_unit``; string literals are quoted by the caller."""
    return f"(('0x' || substr(md5(concat_ws('|', {', '.join(str(p) for p in parts)})), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def ui(n, *parts) -> str:
    return f"floor({u(*parts)} * {n})::BIGINT"


CTES["nw"] = "SELECT source_file, start_index, source_file || ':' || start_index AS wkey FROM wl WHERE y_binary = 0"
# Frames of normal windows.
CTES["nf"] = "SELECT nw.wkey, wf.pos, wf.event_id, " + ", ".join(f"wf.{c}::DOUBLE AS {c}" for c in CHANNELS) + " FROM nw JOIN wf USING (source_file, start_index)"


def _burst_sql(lens, steps, key="wkey"):
    n = lens[1] - lens[0] + 1
    return f"""SELECT *, {ui('(129 - burst_len)', SEED, key, "'start'")} AS burst_start, ([{', '.join(map(str, steps))}])[{ui(len(steps), SEED, key, "'step'")} + 1]::BIGINT AS burst_step
 FROM (SELECT *, {lens[0]} + {ui(n, SEED, key, "'len'")} AS burst_len FROM {{src}})"""


_HIT = "(pos >= burst_start AND pos < burst_start + burst_len AND (pos - burst_start) % burst_step = 0)"
K = ("7", "wkey")


def _d(s):
    return (*K, f"'{s}'", "pos")


def _byte(j):
    return (*K, "'byte'", "pos", str(j))


def _rule_sql(cls: int) -> dict[str, str]:
    if cls == 1:
        out = {"can_id": "0", "dlc": "8"}
        out.update({b: f"CASE WHEN {u(*_byte(j))} < 0.92 THEN 0 ELSE 255 END" for j, b in enumerate(BYTES)})
        out["delta_t"] = f"0.00003::DOUBLE + {u(*_d('dt'))} * (0.002::DOUBLE - 0.00003::DOUBLE)"
        return out
    if cls == 2:
        dlc = f"(CASE WHEN {u(*_d('dlc'))} < 0.08 THEN 2 WHEN {u(*_d('dlc'))} < 0.2 THEN 5 ELSE 8 END)"
        out = {"can_id": f"floor({u(*_d('id'))} * 2048)", "dlc": dlc}
        out.update({b: f"CASE WHEN {j} < {dlc} THEN {ui(256, *_byte(j))} ELSE 0 END" for j, b in enumerate(BYTES)})
        out["delta_t"] = f"0.00005::DOUBLE + {u(*_d('dt'))} * (0.02::DOUBLE - 0.00005::DOUBLE)"
        return out
    out = {"dlc": "8", "delta_t": "greatest(delta_t, 1e-5)"}
    if cls == 3:
        d0 = f"least(greatest({ui(6, *_d('level'))} * 40 + {ui(16, *_d('jit'))}, 0), 255)"
        out.update(can_id="1087", data0=d0, data1=f"least(greatest(255 - {d0} + {ui(17, *_d('noise'))} - 8, 0), 255)")
        return out
    rpm = ui(8000, *_d("rpm"))
    out.update(can_id="790", data0=f"({rpm} // 32) % 256", data1=f"({rpm} // 4) % 256", data2=f"least(greatest(data2 + {ui(101, *_d('noise'))} - 50, 0), 255)")
    return out


BURSTS = {1: ((32, 90), (1, 2)), 2: ((24, 88), (1, 2, 3, 4)), 3: ((32, 90), (1, 2, 3)), 4: ((32, 90), (1, 2, 3))}
for _c in (1, 2, 3, 4):
    CTES[f"nb{_c}"] = _burst_sql(*BURSTS[_c]).format(src="nw")
    _r = _rule_sql(_c)
    CTES[f"inj{_c}"] = (
        f"SELECT nf.wkey, pos, event_id, {_c} AS y_attack_type, {_HIT} AS injected, "
        + ", ".join(f"(CASE WHEN {_HIT} THEN ({_r[c]})::DOUBLE ELSE {c} END) AS {c}" if c in _r else c for c in CHANNELS)
        + f" FROM nf JOIN nb{_c} USING (wkey)"
    )
# A pool in which each normal window carries one attack class, cycling by its start.
CTES["pl"] = " UNION ALL ".join(f"SELECT * FROM inj{c} WHERE (split_part(wkey, ':', 2)::BIGINT // 32) % 4 = {c - 1}" for c in (1, 2, 3, 4))
# The same pool at one row per window.
CTES["pw"] = "SELECT wkey, y_attack_type, count(*) FILTER (injected) AS injection_count FROM pl GROUP BY ALL"


def normals(t: Tables):
    w = t.windows.where("y_binary = 0").withColumn("wkey", A.window_key("source_file", "start_index"))
    return w.select("wkey", "source_file", "start_index", "end_index", "frames")


def cycled_pool(t: Tables):
    """SQL twin: ``pl``/``pw``."""
    def build():
        n = normals(t).withColumn("cls", (F.floor(F.col("start_index") / 32) % 4 + 1).cast("int"))
        parts = [A._labelled(A.inject_class(n.where(F.col("cls") == c), c, SEED), c) for c in A.CLASSES]
        return A._union(parts).drop("cls")

    return t.stored("pool", build)


def pool_frames(w):
    keep = [c for c in ("wkey", "y_attack_type", "positions") if c in w.columns]
    f = A.explode_frames(w, keep)
    return f.withColumn("injected", F.array_contains("positions", F.col("pos").cast("long"))).drop("positions")


def _sums(f, by):
    return f.groupBy(*by).agg(
        F.sum("can_id").alias("ids"), F.sum("dlc").alias("dlcs"), *[F.sum(b).alias(b) for b in BYTES], F.round(F.sum("delta_t"), 4).alias("dts"), F.count_if("injected").alias("injected"))


_SUMS_SQL = "sum(can_id) AS ids, sum(dlc) AS dlcs, " + ", ".join(f"sum({b}) AS {b}" for b in BYTES) + ", round(sum(delta_t), 4) AS dts, count(*) FILTER (injected) AS injected"


@query("h1_burst_positions", "SELECT wkey, burst_len, burst_start, burst_step, ceil(burst_len / burst_step)::BIGINT AS injection_count FROM nb3")
def h1(t: Tables):
    d = A.burst_positions(normals(t), SEED, *BURSTS[3])
    return d.select("wkey", "burst_len", "burst_start", "burst_step", "injection_count")


@query("h2_inject_dos", f"SELECT wkey, {_SUMS_SQL} FROM inj1 GROUP BY wkey")
def h2(t: Tables):
    return _sums(pool_frames(A.inject_dos(normals(t), SEED)), ["wkey"])


@query("h3_inject_fuzzy", f"SELECT wkey, {_SUMS_SQL} FROM inj2 GROUP BY wkey")
def h3(t: Tables):
    return _sums(pool_frames(A.inject_fuzzy(normals(t), SEED)), ["wkey"])


@query("h4_inject_spoof", f"SELECT wkey, y_attack_type::BIGINT AS cls, {_SUMS_SQL} FROM (SELECT * FROM inj3 UNION ALL SELECT * FROM inj4) GROUP BY ALL")
def h4(t: Tables):
    n = normals(t)
    w = A._labelled(A.inject_spoof(n, SEED, "gear"), 3).unionByName(A._labelled(A.inject_spoof(n, SEED, "rpm"), 4))
    return _sums(pool_frames(w), ["wkey", F.col("y_attack_type").cast("long").alias("cls")])


def _summary(w, by):
    d = w.groupBy(*by).agg(F.count("*").alias("windows"), F.sum("injection_count").alias("injected"), F.round(F.avg(F.expr("aggregate(frames, 0D, (a, f) -> a + f.can_id)")), 3).alias("mean_ids"))
    return d


def share(t: Tables, of: int) -> int:
    """A size in proportion to the normal windows."""
    return normals(t).count() // of


# Draws with replacement: each class draws half as many windows as there are normals, by their rank in hashed order.
CTES["nr"] = "SELECT wkey AS bkey, row_number() OVER (ORDER BY ('0x' || substr(md5(concat_ws('|', 7, wkey, 'base')), 1, 8))::BIGINT, wkey) AS rk, count(*) OVER () AS total FROM nw"
CTES["pdr"] = f"""SELECT bkey || ':' || c || ':' || d AS wkey, bkey, c FROM (SELECT c, d, floor({u(SEED, 'c', 'd')} * total)::BIGINT + 1 AS pick
 FROM (SELECT unnest([1, 2, 3, 4]) AS c), (SELECT any_value(total) AS total, unnest(range(any_value(total) // 2)) AS d FROM nr)) JOIN nr ON rk = pick"""


def _pool_sql(cls: int) -> str:
    ident = _rule_sql(cls)["can_id"]
    burst = _burst_sql(*BURSTS[cls]).format(src=f"(SELECT wkey, bkey FROM pdr WHERE c = {cls})")
    return f"""SELECT {cls} AS c, wkey, count(*) FILTER (hit) AS injected, sum(CASE WHEN hit THEN {ident} ELSE can_id END) AS ids FROM (
 SELECT *, {_HIT} AS hit FROM (SELECT b.wkey, b.burst_len, b.burst_start, b.burst_step, nf.pos, nf.can_id FROM ({burst}) b JOIN nf ON nf.wkey = b.bkey)) GROUP BY ALL"""


@query("h5_rule_pool", f"""SELECT y_attack_type, count(*) AS windows, sum(injected)::BIGINT AS injected, round(avg(ids), 3) AS mean_ids
FROM (SELECT c::BIGINT AS y_attack_type, injected, ids FROM ({" UNION ALL ".join(_pool_sql(c) for c in BURSTS)})) GROUP BY y_attack_type""")
def h5(t: Tables):
    return _summary(A.rule_pool(normals(t), share(t, 2), SEED), [F.col("y_attack_type").cast("long").alias("y_attack_type")])


@query("h6_variant_set")
def h6(t: Tables):
    return _summary(A.variant_set(normals(t), share(t, 3), share(t, 8), SEED), ["attack_type", "y_binary"])


@query("h7_severity_set")
def h7(t: Tables):
    return _summary(A.severity_set(normals(t), share(t, 5), share(t, 20), SEED), ["attack_type", "severity"])


@query("h8_id_shift_set")
def h8(t: Tables):
    return _summary(A.id_shift_set(normals(t), share(t, 4), share(t, 8), SEED), ["attack_type", "id_condition"])


@query("h9_payload_shift_set")
def h9(t: Tables):
    return _summary(A.payload_shift_set(normals(t), share(t, 4), share(t, 8), SEED), ["attack_type", "id_condition"])


# 0.3 x all windows in equal shares, the remainder to the first classes; ids come from those of the normals.
CTES["tq"] = "SELECT c, t // 4 + (c - 1 < t % 4)::INT AS n FROM (SELECT unnest([1, 2, 3, 4]) AS c), (SELECT round_even(count(*) * 0.3::DOUBLE, 0)::BIGINT AS t FROM wl)"
CTES["tdr"] = """SELECT wkey || ':' || c || ':' || (rk - 1) AS wkey, wkey AS bkey, c FROM (
SELECT wkey, c, n, row_number() OVER (PARTITION BY c ORDER BY ('0x' || substr(md5(concat_ws('|', 7, 'base' || c, wkey)), 1, 8))::BIGINT, wkey) AS rk FROM nw, tq) WHERE rk <= n"""
CTES["tsup"] = "SELECT list(DISTINCT can_id::BIGINT ORDER BY can_id::BIGINT) AS ids FROM nf WHERE can_id BETWEEN 0 AND 2047"


def _target_sql(cls: int) -> str:
    ident = "0" if cls == 1 else f"ids[floor({u(*_d('id'))} * len(ids))::BIGINT + 1]"
    burst = _burst_sql(*BURSTS[cls]).format(src=f"(SELECT wkey, bkey FROM tdr WHERE c = {cls})")
    return f"""SELECT {cls} AS c, wkey, count(*) FILTER (hit) AS injected, sum(CASE WHEN hit THEN {ident} ELSE can_id END) AS ids FROM (
 SELECT *, {_HIT} AS hit FROM (SELECT b.wkey, b.burst_len, b.burst_start, b.burst_step, nf.pos, nf.can_id FROM ({burst}) b JOIN nf ON nf.wkey = b.bkey)), tsup GROUP BY ALL"""


@query("h10_target_pool", f"""SELECT c::BIGINT AS y_attack_type, count(*) AS windows, sum(injected)::BIGINT AS injected, round(avg(ids), 3) AS mean_ids
FROM (SELECT c, wkey, injected, ids FROM ({" UNION ALL ".join(_target_sql(c) for c in BURSTS)})) GROUP BY c""")
def h10(t: Tables):
    return _summary(A.target_pool(normals(t), t.windows.count(), SEED), [F.col("y_attack_type").cast("long").alias("y_attack_type")])


@query("h11_injection_stats", "SELECT y_attack_type::BIGINT AS cls, count(*) AS windows, round(avg(injection_count), 6) AS mean, min(injection_count) AS min, max(injection_count) AS max FROM pw GROUP BY ALL")
def h11(t: Tables):
    d = A.injection_stats(cycled_pool(t), ["y_attack_type"])
    return d.select(F.col("y_attack_type").cast("long").alias("cls"), "windows", F.round("mean", 6).alias("mean"), "min", "max")


CTES["twin"] = """
SELECT wkey, y_attack_type, pos, data0, data1, CASE WHEN vals IS NULL THEN data1 ELSE vals[((o - 1 + sh) % n + 1)] END AS twin1 FROM (
SELECT *, CASE WHEN (CASE WHEN 2 * m <= n THEN m ELSE n - m END) = 0 AND n > 1 THEN 1 ELSE CASE WHEN 2 * m <= n THEN m ELSE n - m END END AS sh FROM (
SELECT *, max(c) OVER (PARTITION BY wkey) AS m, list(data1) OVER (PARTITION BY wkey ORDER BY bin, tk ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS vals FROM (
SELECT *, count(*) OVER (PARTITION BY wkey) AS n, count(*) OVER (PARTITION BY wkey, bin) AS c, row_number() OVER (PARTITION BY wkey ORDER BY bin, tk) AS o FROM (
SELECT *, CASE WHEN y_attack_type = 3 THEN least(data0::BIGINT // 40, 5) ELSE data0::BIGINT % 32 END AS bin,
 ('0x' || substr(md5(concat_ws('|', 7, wkey, 'twin', pos)), 1, 8))::BIGINT AS tk FROM pl WHERE injected AND y_attack_type IN (3, 4)))))"""


@query("h12_placebo_twin", """
SELECT wkey, y_attack_type::BIGINT AS cls, sum(data1) AS total, sum(data1 * (pos + 1)) AS before, sum(twin1 * (pos + 1)) AS after FROM twin GROUP BY ALL""")
def h12(t: Tables):
    p = cycled_pool(t).where("y_attack_type IN (3, 4)")
    tw = A.placebo_twin(p, SEED).select("wkey", F.col("frames").alias("tf"))
    j = p.join(tw, "wkey").select("wkey", "y_attack_type", "positions", F.posexplode(F.arrays_zip("frames", "tf")).alias("pos", "z"))
    j = j.where(F.array_contains("positions", F.col("pos").cast("long")))
    w = F.col("pos") + 1
    return j.groupBy("wkey", F.col("y_attack_type").cast("long").alias("cls")).agg(
        F.sum("z.frames.data1").alias("total"), F.sum(F.col("z.frames.data1") * w).alias("before"), F.sum(F.col("z.tf.data1") * w).alias("after"))


@query("h13_child_key", "SELECT wkey, ('0x' || substr(md5(concat_ws('|', 7, 1, wkey, 3, 2)), 1, 8))::BIGINT AS key FROM nw")
def h13(t: Tables):
    return normals(t).select("wkey", A.child_key(SEED, 1, F.col("wkey"), 3, 2).alias("key"))


def factorial(t: Tables):
    return A.factorial_windows(normals(t).select("wkey", "frames"), SEED)  # made as it is read: 32 windows a base cost more to write than to make


@query("h14_factorial_windows")
def h14(t: Tables):
    w = factorial(t)
    cell = ["attack", "stratum", "p", "s", "d"]
    f = w.select(*cell, F.inline(F.arrays_zip("frames.data0", "frames.data7")))
    return f.groupBy(*cell).agg(F.count("*").alias("frames"), F.round(F.avg("data0"), 4).alias("data0"), F.round(F.avg("data7"), 4).alias("data7"))


@query("h15_factorial_checks", """
WITH n AS (SELECT count(*) AS n FROM nw), a AS (SELECT unnest(['gear', 'rpm']) AS attack)
SELECT attack, c.chk AS "check", (n * c.f)::BIGINT AS frames, 0::BIGINT AS violations FROM n, a,
 (SELECT unnest(['untouched', 'stratum', 'p', 'd', 's']) AS chk, unnest([16 * 96, 8 * 32, 8 * 32, 8 * 32, 8 * 32]) AS f) c""")
def h15(t: Tables):
    d = A.factorial_checks(factorial(t))
    return d.select("attack", "check", "frames", "violations")


@query("h16_sparse_windows")
def h16(t: Tables):
    w = A.sparse_windows(normals(t).select("wkey", "frames"), (2, 4, 8, 16, 32), SEED, "gear")
    f = w.select("k", "relation", F.col("injection_count").alias("n"), F.expr("aggregate(frames, 0D, (a, f) -> a + f.data1)").alias("d1"))
    return f.groupBy("k", "relation").agg(F.count("*").alias("windows"), F.sum("n").alias("injected"), F.round(F.sum("d1"), 3).alias("data1_total"))
