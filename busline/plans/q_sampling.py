"""Queries for keyed sampling, splitting and training-set assembly (section G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from busline.operators import sampling as S
from busline.operators import timeline as TL
from busline.plans.q_sources import files
from busline.plans.registry import query
from busline.plans.views import CTES, Tables

SEED = 7
# Orders as labelled rows: class 0..5 (class 4 rare), binary label, key.
CTES["od"] = "SELECT o_orderkey AS id, CASE WHEN o_custkey % 97 = 0 THEN 4 ELSE o_custkey % 4 END AS cls, (o_custkey % 10 = 0)::INT AS y FROM orders"


def od(t: Tables):
    c = F.col("o_custkey")
    return t.read("orders").select(F.col("o_orderkey").alias("id"), F.when(c % 97 == 0, 4).otherwise(c % 4).cast("int").alias("cls"), (c % 10 == 0).cast("int").alias("y"))


def key(id_: str, seed=SEED, stream="draw") -> str:
    return f"('0x' || substr(md5(concat_ws('|', {seed}, '{stream}', {id_})), 1, 8))::BIGINT"


def rk(src: str, part: str | None, id_="id", seed=SEED, stream="draw") -> str:
    over = f"PARTITION BY {part} " if part else ""
    size = f"count(*) OVER (PARTITION BY {part})" if part else "count(*) OVER ()"
    return f"(SELECT *, row_number() OVER ({over}ORDER BY {key(id_, seed, stream)}, {id_}) AS rk, {size} AS sz FROM {src})"


def _again(cls, seed, n, total):
    """SQL twin of the draws with replacement of one class."""
    return (f"SELECT id, cls, d FROM (SELECT d, floor(('0x' || substr(md5(concat_ws('|', {seed}, 'again', {cls}, d)), 1, 8))::BIGINT / 4294967296.0::DOUBLE * {n})::BIGINT + 1 AS pick "
            f"FROM (SELECT unnest(generate_series(1, {total})) AS d)) JOIN {rk('od', 'cls', seed=seed)} r ON r.cls = {cls} AND r.rk = pick")


def _n4():
    return "(SELECT count(*) FROM od WHERE cls = 4)"


def _balanced(total, seed):
    share, rest = divmod(total, 4)
    q = {c: share + (i < rest) for i, c in enumerate((1, 2, 3, 4))}
    case = " ".join(f"WHEN {c} THEN {n}" for c, n in q.items())
    return f"SELECT id, cls, rk AS d FROM {rk('od', 'cls', seed=seed)} WHERE cls IN (1, 2, 3) AND rk <= CASE cls {case} END UNION ALL {_again(4, seed, _n4(), q[4])}"


@query("g1_sample_balanced", f"SELECT id, cls::BIGINT AS cls, d AS draw FROM ({_balanced(2002, SEED)})")
def g1(t: Tables):
    return S.sample_balanced(od(t), 2002, SEED, "id", "cls").select("id", F.col("cls").cast("long").alias("cls"), F.col("draw").cast("long").alias("draw"))


@query("g2_sample_strict", f"""WITH r AS {rk('od', 'cls')}, q AS (SELECT unnest([0, 1, 2, 3]) AS c, unnest([26, 26, 25, 25]) AS n)
SELECT cls::BIGINT AS cls, any_value(sz) AS available, any_value(n)::BIGINT AS requested, count(*) AS drawn, count(DISTINCT id) AS unique_rows, 0::BIGINT AS repeated, sum(id)::BIGINT AS id_sum FROM r JOIN q ON cls = c WHERE rk <= n GROUP BY cls""")
def g2(t: Tables):
    drawn, audit = S.sample_strict(od(t), 102, SEED, "id", "cls", (0, 1, 2, 3))
    s = drawn.groupBy("cls").agg(F.sum("id").alias("id_sum"))
    return audit.join(s, "cls").withColumn("cls", F.col("cls").cast("long"))


@query("g3_capacity", "SELECT cls::BIGINT AS cls, n, requested, " + ", ".join(f"requested // 4 + ({i} < requested % 4)::INT AS class_{c}" for i, c in enumerate((1, 2, 3, 4))) + ", ceil(requested / 4)::BIGINT AS min_per_class FROM (SELECT cls, count(*) AS n, round_even(count(*) * 0.3::DOUBLE, 0)::BIGINT AS requested FROM od GROUP BY cls)")
def g3(t: Tables):
    d = od(t).groupBy(F.col("cls").cast("long").alias("cls")).agg(F.count("*").alias("n")).withColumn("ratio", F.lit(0.3))
    return S.capacity(d).drop("ratio")


CTES["odn"] = "SELECT count(*) AS n FROM od WHERE y = 0"


@query("g4_augment", """WITH q AS (SELECT round_even((SELECT n FROM odn) * 0.1::DOUBLE, 0)::BIGINT AS t), c AS (SELECT unnest([1, 2, 3, 4]) AS c, unnest([0, 1, 2, 3]) AS i),
w AS (SELECT c, t // 4 + (i < t % 4)::INT AS n FROM c, q), r AS """ + rk("od", "cls", seed=SEED + 100) + f""",
a AS (SELECT r.id, r.cls FROM r JOIN w ON r.cls = w.c WHERE sz >= n AND rk <= n UNION ALL SELECT r.id, r.cls FROM (SELECT c, unnest(generate_series(1, n)) AS d FROM w WHERE n > (SELECT count(*) FROM od WHERE cls = c)) x
 JOIN r ON r.cls = x.c AND r.rk = floor(('0x' || substr(md5(concat_ws('|', {SEED + 100}, 'again', x.c, d)), 1, 8))::BIGINT / 4294967296.0::DOUBLE * sz)::BIGINT + 1)
SELECT 'real' AS origin, cls::BIGINT AS cls, count(*) AS n, sum(id)::BIGINT AS id_sum FROM od WHERE y = 0 GROUP BY ALL UNION ALL SELECT 'pool', cls, count(*), sum(id)::BIGINT FROM a GROUP BY ALL""")
def g4(t: Tables):
    d = od(t)
    a = S.augment(d.where("y = 0"), d, 0.1, SEED, "id", "cls")
    return a.groupBy("origin", F.col("cls").cast("long").alias("cls")).agg(F.count("*").alias("n"), F.sum("id").alias("id_sum"))


@query("g5_oversample", """WITH q AS (SELECT round_even((SELECT count(*) FROM od) * 0.02::DOUBLE, 0)::BIGINT AS t), c AS (SELECT unnest([1, 2, 3, 4]) AS c, unnest([0, 1, 2, 3]) AS i),
w AS (SELECT c, t // 4 + (i < t % 4)::INT AS n FROM c, q), r AS """ + rk("od", "cls", seed=SEED + 20) + """
SELECT 'real' AS origin, cls::BIGINT AS cls, count(*) AS n, sum(id)::BIGINT AS id_sum FROM od GROUP BY ALL UNION ALL SELECT 'pool', cls, count(*), sum(id)::BIGINT FROM r JOIN w ON r.cls = w.c WHERE rk <= n GROUP BY ALL""")
def g5(t: Tables):
    a = S.oversample(od(t), 0.02, SEED, "id", "cls")
    return a.groupBy("origin", F.col("cls").cast("long").alias("cls")).agg(F.count("*").alias("n"), F.sum("id").alias("id_sum"))


@query("g6_cap_rows", f"SELECT id FROM {rk('od', None)} WHERE rk <= 500")
def g6(t: Tables):
    return S.cap_rows(od(t), 500, SEED, "id").select("id")


@query("g7_stratified_cap", f"SELECT y::BIGINT AS y, count(*) AS n, sum(id)::BIGINT AS id_sum FROM {rk('od', 'y')} WHERE rk <= CASE y WHEN 1 THEN least((SELECT count(*) FROM od WHERE y = 1), 2000) ELSE 4000 - least((SELECT count(*) FROM od WHERE y = 1), 2000) END GROUP BY y")
def g7(t: Tables):
    d = S.stratified_cap(od(t), 4000, SEED, "id")
    return d.groupBy(F.col("y").cast("long").alias("y")).agg(F.count("*").alias("n"), F.sum("id").alias("id_sum"))


@query("g8_stratified_fraction", f"SELECT cls::BIGINT AS cls, count(*) AS n, sum(id)::BIGINT AS id_sum FROM {rk('od', 'cls')} WHERE rk <= greatest(1, round_even(sz * 0.05::DOUBLE, 0)) GROUP BY cls")
def g8(t: Tables):
    d = S.stratified_fraction(od(t), 0.05, SEED, "id", "cls")
    return d.groupBy(F.col("cls").cast("long").alias("cls")).agg(F.count("*").alias("n"), F.sum("id").alias("id_sum"))


@query("g9_greedy_disjoint", """WITH RECURSIVE s AS (SELECT source_file, start_index FROM wl WHERE y_binary = 0),
nx AS (SELECT a.source_file, a.start_index, min(b.start_index) AS nxt FROM s a LEFT JOIN s b ON a.source_file = b.source_file AND b.start_index > a.start_index + 127 GROUP BY ALL),
g AS (SELECT source_file, min(start_index) AS start_index FROM s GROUP BY source_file UNION ALL SELECT nx.source_file, nx.nxt FROM g JOIN nx ON nx.source_file = g.source_file AND nx.start_index = g.start_index WHERE nx.nxt IS NOT NULL)
SELECT source_file, start_index, start_index + 127 AS end_index FROM g""")
def g9(t: Tables):
    w = t.windows.where("y_binary = 0").select("source_file", "start_index", "end_index")
    return S.greedy_disjoint(w, ["source_file"])


@query("g10_aligned", "SELECT source_file, start_index FROM wl WHERE start_index % 128 = 0")
def g10(t: Tables):
    return S.aligned(t.windows).select("source_file", "start_index")


@query("g11_blocks", f"SELECT (rk - 1) // 100 + 1 AS block, count(*) AS n, sum(id)::BIGINT AS id_sum FROM {rk('od', None)} WHERE rk <= 1000 GROUP BY block")
def g11(t: Tables):
    d = S.partition_blocks(od(t), 100, 10, SEED, "id")
    return d.groupBy(F.col("block").cast("long").alias("block")).agg(F.count("*").alias("n"), F.sum("id").alias("id_sum"))


CTES["pg"] = "SELECT source_file, start_index, y_attack_type AS cls, source_file || '|' || (start_index // 256) AS grp FROM wl WHERE y_attack_type > 0 AND start_index // 256 = (start_index + 127) // 256"


@query("g12_purged_split", f"WITH g AS {rk('(SELECT DISTINCT cls, grp FROM pg)', 'cls', 'grp', SEED, 'purge')} SELECT source_file, start_index, CASE WHEN rk <= greatest(1, least(sz - 1, round_even(sz * 0.3::DOUBLE, 0))) THEN 'test' ELSE 'train' END AS part FROM pg JOIN g USING (cls, grp)")
def g12(t: Tables):
    return S.purged_split(t.windows, 256, SEED, ["source_file"]).select("source_file", "start_index", "part")


CTES["md"] = "SELECT id, cls, CASE WHEN id % 3 = 0 THEN 'test' ELSE 'train' END AS part, CASE y WHEN 1 THEN 'synthetic' ELSE 'real' END AS domain FROM od WHERE cls BETWEEN 1 AND 3"


@query("g13_match_domains", f"WITH r AS {rk('md', 'domain, cls, part')}, q AS (SELECT part, min(c) AS q FROM (SELECT part, domain, cls, count(*) AS c FROM md GROUP BY ALL) GROUP BY part) SELECT domain, cls::BIGINT AS cls, part, count(*) AS n, sum(id)::BIGINT AS id_sum FROM r JOIN q USING (part) WHERE rk <= q GROUP BY ALL")
def g13(t: Tables):
    d = od(t).where("cls BETWEEN 1 AND 3").withColumn("part", F.when(F.col("id") % 3 == 0, "test").otherwise("train"))
    m = S.match_domains(d.where("y = 0"), d.where("y = 1"), SEED, "id", "cls")
    return m.groupBy("domain", F.col("cls").cast("long").alias("cls"), "part").agg(F.count("*").alias("n"), F.sum("id").alias("id_sum"))


# Arm tables: source = even orders, the rest of the roles by id.
_ARM = {"source": "id % 2 = 0", "rule": "id % 2 = 1", "target_normal": "y = 1 AND cls = 0", "target_synth": "id % 3 = 1", "oracle": "y = 1 AND cls > 0"}


def _arm_draw(where, seed):
    return f"""SELECT r.id, r.cls FROM (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY {key('id', seed)}, id) AS rk FROM od WHERE {where}) r JOIN (SELECT c, t // 4 + (i < t % 4)::INT AS n FROM (SELECT unnest([1, 2, 3, 4]) AS c, unnest([0, 1, 2, 3]) AS i), (SELECT round_even(count(*) * 0.005::DOUBLE, 0)::BIGINT AS t FROM od WHERE id % 2 = 0)) w ON r.cls = w.c WHERE rk <= n"""


_TN = f"SELECT 'target_normal' AS origin, 0 AS cls, id FROM od WHERE {_ARM['target_normal']}"
_PARTS = {"rule": f"SELECT 'rule' AS origin, cls, id FROM ({_arm_draw(_ARM['rule'], SEED + 5)})", "target_normal": _TN,
          "target_synth": f"SELECT 'target_synth' AS origin, cls, id FROM ({_arm_draw(_ARM['target_synth'], SEED + 600)})", "oracle": f"SELECT 'oracle' AS origin, cls, id FROM od WHERE {_ARM['oracle']}"}


@query("g14_training_arms", " UNION ALL ".join(
    f"SELECT '{arm}' AS arm, origin, cls::BIGINT AS cls, count(*) AS n, sum(id)::BIGINT AS id_sum FROM (SELECT 'source' AS origin, cls, id FROM od WHERE {_ARM['source']}" + "".join(f" UNION ALL {_PARTS[p]}" for p in parts) + ") GROUP BY ALL"
    for arm, parts in S.ARMS.items()))
def g14(t: Tables):
    tabs = {n: od(t).where(w) for n, w in _ARM.items()}
    parts = [S.build_arm(a, tabs, SEED, "id", 0.005, "cls").withColumn("arm", F.lit(a)) for a in S.ARMS]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p, allowMissingColumns=True)
    return u.groupBy("arm", "origin", F.col("cls").cast("long").alias("cls")).agg(F.count("*").alias("n"), F.sum("id").alias("id_sum"))


CTES["calf"] = """SELECT s_suppkey AS unit, CASE WHEN (row_number() OVER (ORDER BY 'logs/set_' || (s_suppkey % 3) || '/' || CASE s_suppkey % 5 WHEN 0 THEN 'train_01' WHEN 1 THEN 'test_01_known_vehicle_known_attack'
 WHEN 2 THEN 'test_02_unknown_vehicle_known_attack' WHEN 3 THEN 'test_03_known_vehicle_unknown_attack' ELSE 'test_04_unknown_vehicle_unknown_attack' END || '/' ||
 CASE s_suppkey % 3 WHEN 0 THEN 'DoS' WHEN 1 THEN 'rpm-accessory' ELSE 'force-neutral' END || '-' || s_suppkey || '.csv') - 1) % 5 = 0 THEN 'calibration' ELSE 'evaluation' END AS role FROM supplier"""
CTES["calw"] = "SELECT part * 10 + seed AS id, unit, max(y) AS y FROM sc GROUP BY ALL"


@query("g15_calibration", f"WITH w AS (SELECT id * 1000 + unit AS k, unit, y FROM calw JOIN calf USING (unit) WHERE role = 'calibration') SELECT unit, y::BIGINT AS y, count(*) AS n FROM (SELECT * FROM {rk('(SELECT * FROM w WHERE y = 0)', None, 'k')} WHERE rk <= 800 UNION ALL SELECT *, 0, 0 FROM w WHERE y = 1) GROUP BY ALL")
def g15(t: Tables):
    w = t.scores.groupBy((F.col("part") * 10 + F.col("seed")).alias("id"), "unit").agg(F.max("y").alias("y_binary"))
    w = w.withColumn("k", F.col("id") * 1000 + F.col("unit"))
    c = S.calibration_windows(w, TL.split_files(files(t)), 800, SEED, "k", "unit", oracle=True)
    return c.groupBy("unit", F.col("y_binary").cast("long").alias("y")).agg(F.count("*").alias("n"))


@query("g16_class_weights", "SELECT cls::BIGINT AS cls, count(*) AS n, round((SELECT count(*) FROM od) / (5.0 * count(*)), 6) AS weight FROM od GROUP BY cls")
def g16(t: Tables):
    return S.class_weights(od(t), "cls").groupBy(F.col("cls").cast("long").alias("cls")).agg(F.count("*").alias("n"), F.round(F.max("weight"), 6).alias("weight"))
