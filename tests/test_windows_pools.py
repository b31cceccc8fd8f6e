import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from busline.functions import student as SD
from busline.operators import audit as AU
from busline.operators import augment as A
from busline.operators import profile as P
from busline.operators import sampling as S
from busline.operators import timeline as TL
from busline.operators import windows as WN
from busline.schema import BYTES, CHANNELS
from busline.session import scratch_dir


@pytest.fixture(scope="module")
def frames(spark):
    rnd = random.Random(1)
    rows = []
    for src, n in (("s1", 300), ("s2", 127), ("s3", 128)):
        t = 0.0
        for i in range(n):
            t += rnd.random()
            rows.append((src, i, t, rnd.randrange(40), 8, *[rnd.randrange(256) if j else 7 for j in range(8)], rnd.random(), int(rnd.random() < 0.02), 0))
    cols = "source_file string, idx long, timestamp double, can_id int, dlc int, " + ", ".join(f"{b} int" for b in BYTES) + ", delta_t double, binary_label_id int, attack_type_id int"
    return spark.createDataFrame(rows, cols)


def arrays(frames):
    out = {}
    for r in sorted(frames.collect(), key=lambda r: (r.source_file, r.idx)):
        out.setdefault(r.source_file, []).append([float(r[c]) for c in CHANNELS])
    return {k: np.array(v) for k, v in out.items()}


def test_window_features_and_correlations(frames):
    ref = arrays(frames)
    f = {(r.source_file, r.start_index): r for r in WN.window_features(frames, ["source_file"]).collect()}
    c = {(r.source_file, r.start_index): r for r in WN.payload_correlations(frames, ["source_file"]).collect()}
    assert sorted(f) == [("s1", s) for s in (0, 32, 64, 96, 128, 160)] + [("s3", 0)]
    for (src, s), r in f.items():
        x = ref[src][s : s + 128]
        for i, ch in enumerate(CHANNELS):
            got = [r[f"{ch}_{k}"] for k in ("mean", "std", "min", "max", "delta")]
            want = [x[:, i].mean(), x[:, i].std(), x[:, i].min(), x[:, i].max(), x[-1, i] - x[0, i]]
            assert got == pytest.approx(want, abs=1e-9)
        assert c[(src, s)]["corr_0_1"] == 0.0  # byte 0 is constant
        assert c[(src, s)]["corr_2_5"] == pytest.approx(np.corrcoef(x[:, 4], x[:, 7])[0, 1])


def test_count_windows_keep_order(frames):
    ref = arrays(frames)
    for r in WN.count_windows(frames, ["source_file"]).collect():
        x = np.array([[float(v) for v in f] for f in r.frames])
        assert np.array_equal(x, ref[r.source_file][r.start_index : r.start_index + 128])
        assert r.end_index == r.start_index + 127


def test_majority_tie_goes_low_and_unknown_is_no_attack(spark):
    rows = [("a", i, float(i), 0 if i % 4 else 1, (3 if i % 8 else 2) if i % 4 == 0 else 0) for i in range(128)]
    rows += [("b", i, float(i), -1, -1) for i in range(128)]
    d = spark.createDataFrame(rows, "source_file string, idx long, timestamp double, binary_label_id int, attack_type_id int")
    got = {r.source_file: (r.y_binary, r.y_attack_type) for r in WN.window_labels(d, ["source_file"]).collect()}
    assert got["a"] == (1, 2)
    assert got["b"][1] == 0 and got["b"][0] < 1


def test_episode_split_asof(spark):
    ts = [0, 1, 2, 10, 11, 20, 21, 22, 30, 40]
    att = [0, 1, 1, 0, 1, 1, 0, 1, 1, 1]
    rows = [("x", i + 1, float(t), a) for i, (t, a) in enumerate(zip(ts, att))] + [("calm", i + 1, float(i), 0) for i in range(10)]
    d = spark.createDataFrame(rows, "source_file string, row_in_source long, timestamp double, binary_label_id int")
    ep = TL.split_episodes(TL.attack_episodes(d, 1.0, span=3))
    got = sorted((r.episode_index, r.start_row, r.end_row, r.split) for r in ep.collect())
    assert [g[1:3] for g in got] == [(2, 3), (5, 5), (6, 6), (8, 8), (9, 9), (10, 10)]
    assert [g[3] for g in got] == ["train"] * 3 + ["val"] + ["test"] * 2
    s = {(r.source_file, r.row_in_source): r.split for r in TL.split_frames(d, 1.0, span=4).collect()}
    assert [s[("x", i)] for i in range(1, 11)] == ["train"] * 7 + ["val"] + ["test"] * 2
    assert [s[("calm", i)] for i in range(1, 11)] == ["train"] * 5 + ["val"] * 2 + ["test"] * 3


def long(spark, rows, keys="k long, pos long"):
    rows = [(*r[:2], *map(float, r[2:])) for r in rows]
    return spark.createDataFrame(rows, f"{keys}, " + ", ".join(f"{c} double" for c in CHANNELS))


def test_protocol_repair(spark):
    raw = long(spark, [(0, 0, 3000.0, 2.6, 0.6, 2.4, 9.0, 0, 0, 0, 0, 300.0, -1.0), (0, 1, -4.0, 2.0, 1.5, 2.5, 3.0, 0, 0, 0, 0, 0, 5.0)])
    fixed = {r.pos: r for r in AU.enforce_protocol(raw, 2.0).collect()}
    assert [fixed[0][c] for c in ("can_id", "dlc", "data0", "data1", "data2", "data7", "delta_t")] == [2047, 3, 1, 2, 9, 0, 0]
    assert [fixed[1][c] for c in ("can_id", "dlc", "data0", "data1", "data2", "delta_t")] == [0, 2, 2, 2, 0, 2]
    nan = long(spark, [(0, 0, float("nan"), 1.0, *[0.0] * 8, 0.0)])
    with pytest.raises(Exception, match="not finite"):
        AU.enforce_protocol(nan).collect()


def test_padding_violation(spark):
    f = long(spark, [(0, 0, 1.0, 1.0, 5.0, 7.0, 0, 0, 0, 0, 0, 0, 0.1)])
    r = AU.protocol_validity(f).first()
    assert (r.padding_slots, r.nonzero_padding_slots, r.frames_with_nonzero_padding, r.invalid_frames, r.valid) == (7, 1, 1, 1, False)


def test_condition_share(spark):
    names = {c: n for c, n in A.CLASSES.items()}
    rows = [(1, c, names[c], c, names[c]) for c in (1, 1, 2, 3, 4)]
    rows += [(1, 4, names[4], 2, names[4]), (1, 1, names[1], 1, names[2])]
    d = spark.createDataFrame(rows, "y_binary int, y_attack_type int, synthetic_type string, condition_label int, condition_name string")
    r = AU.condition_audit(d, A.CLASSES).first()
    assert r.condition_label_share == pytest.approx(6 / 7) and r.condition_name_share == pytest.approx(6 / 7) and r.name_share == 1.0
    assert r.all_share == pytest.approx(5 / 7) and not r.all_valid


def test_balanced_quotas_and_strict_error(spark):
    d = spark.createDataFrame([(c * 100 + i, c) for c in (1, 2, 3, 4) for i in range(5)], "id long, cls int")
    for total in (19, 20):
        drawn, audit = S.sample_strict(d, total, 3, "id", "cls")
        assert drawn.count() == total and all(r.repeated == 0 for r in audit.collect())
    with pytest.raises(ValueError, match="class 1"):
        S.sample_strict(d, 21, 3, "id", "cls")
    assert list(S.quotas(31).values()) == [8, 8, 8, 7]
    b = S.sample_balanced(d, 31, 3, "id", "cls").groupBy("cls").count().collect()
    assert {r.cls: r["count"] for r in b} == {1: 8, 2: 8, 3: 8, 4: 7}


def test_purged_groups_of_uneven_classes(spark):
    groups = {1: 3, 2: 7, 3: 2}
    rows = []
    for cls, n in groups.items():
        for seg in range(2):
            for g in range(n):
                at = g * 256
                rows += [(f"log{cls}", seg, at + s, at + s + 63, cls) for s in (0, 64, 192)]
                rows.append((f"log{cls}", seg, at + 224, at + 287, cls))  # reaches into the next group
    schema = "source_file string, segment_id long, start_index long, end_index long, y_attack_type int"
    w = spark.createDataFrame([*rows, ("log1", 0, 5, 68, 0)], schema)
    parts = {}
    for r in S.purged_split(w, 256, 4, ["source_file", "segment_id"]).collect():
        assert r.start_index // 256 == r.end_index // 256 and r.y_attack_type > 0
        parts.setdefault(r.y_attack_type, {}).setdefault(r.part, []).append(r.group)
    for cls, n in groups.items():
        test, train = set(parts[cls]["test"]), set(parts[cls]["train"])
        assert not test & train and len(test | train) == 2 * n and len(test) == max(1, round(0.3 * 2 * n))
        assert len(parts[cls]["test"]) == 3 * len(test)
    with pytest.raises(Exception, match="fewer than two groups"):
        S.purged_split(spark.createDataFrame([("a", 0, 0, 63, 1), ("a", 0, 300, 363, 2), ("b", 0, 0, 63, 2)], schema), 256, 4, ["source_file"]).collect()


def greedy(rows):
    """(segment, start, end) kept by a scan in order of start, then end."""
    last, out = {}, set()
    for seg, s, e in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        if s > last.get(seg, -1):
            out.add((seg, s, e))
            last[seg] = e
    return out


@pytest.mark.parametrize("span", [16, 100, 1 << 20])
def test_greedy_disjoint(spark, span):
    rnd = random.Random(8)
    rows = [(f"s{rnd.randrange(3)}", s, s + rnd.choice([0, 1, 7, 15, 15, 40])) for s in (rnd.randrange(900) for _ in range(700))]
    rows += rows[:40] + [("one", 5, 9), ("long", 0, 10_000), ("long", 3, 4)]
    odd = [(None, 1, 2), ("s1", None, 3), ("s1", 4, None)]
    w = spark.createDataFrame([(*r, "x") for r in rows + odd], "source_file string, start_index long, end_index long, at string").repartition(5)
    got = [tuple(r) for r in S.greedy_disjoint(w, ["source_file"], span=span).collect()]
    assert len(got) == len(set(got)) and set(got) == greedy(rows)
    kept = spark.createDataFrame(got, "source_file string, start_index long, end_index long")
    assert all(r.overlaps == 0 for r in AU.assert_disjoint(kept, ["source_file"]).collect())


def test_greedy_disjoint_in_one_long_segment(spark):
    """Many windows of one segment; their successors are found by many tasks."""
    n = 300_000
    w = spark.range(n).select(F.lit("s").alias("source_file"), (F.col("id") * 3).alias("start_index"), (F.col("id") * 3 + 7 + F.col("id") % 5).alias("end_index"))
    got = sorted(r[0] for r in S.greedy_disjoint(w, ["source_file"]).select("start_index").collect())
    want, last = [], -1
    for i in range(n):
        if 3 * i > last:
            want.append(3 * i)
            last = 3 * i + 7 + i % 5
    assert got == want
    nodes = w.drop("source_file").selectExpr("'s' as source_file", "start_index", "end_index")
    jumps = S.next_starts(nodes, ["source_file"], "start_index", "end_index", span=1 << 14)
    plan = jumps._jdf.queryExecution().toString()
    assert "InPandas" not in plan and "InArrow" not in plan and "PythonUDF" not in plan
    spans = w.selectExpr("floor(start_index * -2 / (2 * 16384)) as s").groupBy("s").count().agg(F.count("*"), F.max("count")).first()
    assert spans[0] > 40 and spans[1] < 2 * n / spans[0]


def test_greedy_disjoint_of_nothing(spark):
    w = spark.createDataFrame([], "source_file string, start_index int, end_index int")
    out = S.greedy_disjoint(w, ["source_file"])
    assert out.count() == 0 and out.dtypes == w.dtypes


def test_twin_keeps_marginals_and_breaks_relation(spark, frames):
    w = WN.count_windows(frames, ["source_file"]).withColumn("wkey", A.window_key("source_file", "start_index")).drop("y_binary", "y_attack_type")
    for mode, cls in (("gear", 3), ("rpm", 4)):
        p = A._labelled(A.inject_spoof(w, 11, mode), cls)
        tw = A.placebo_twin(p, 11)
        rel = AU.relation_residual(A.explode_frames(tw, ["wkey", "positions", "y_attack_type"]).withColumn("injected", F.array_contains("positions", F.col("pos").cast("long"))), ["wkey"])
        r = rel.first()
        assert r.residual == r.structural_minimum if mode == "rpm" else r.residual_share < 0.2
        a = {r.wkey: r.frames for r in p.collect()}
        for r in tw.collect():
            b = a[r.wkey]
            assert sorted(f.data1 for f in b) == sorted(f.data1 for f in r.frames)
            assert all(x.data0 == y.data0 and x.can_id == y.can_id for x, y in zip(b, r.frames))


def test_rule_pool_protocol(spark, frames):
    w = WN.count_windows(frames, ["source_file"]).withColumn("wkey", A.window_key("source_file", "start_index")).select("wkey", "frames")
    pool = A.rule_pool(w, 12, 9)
    counts = {r.y_attack_type: r["count"] for r in pool.groupBy("y_attack_type").count().collect()}
    assert counts == {1: 12, 2: 12, 3: 12, 4: 12}
    v = AU.protocol_validity(A.explode_frames(pool.where("y_attack_type <> 3"), ["wkey"])).first()
    assert v.valid
    again = A.rule_pool(w.repartition(3), 12, 9)
    dig = lambda d: sorted(r.digest for r in AU.window_digest(d).collect())
    assert dig(pool) == dig(again)


def test_ordered_digest_depends_on_order_only(spark):
    rows = [(i + 1, i % 4, f"{i:064x}") for i in range(300)]
    d = spark.createDataFrame(rows, "rank long, y_attack_type int, digest string")
    h = lambda x: AU.ordered_digest(x, "rank", fan=7).first().digest
    assert h(d) == h(d.repartition(6))
    swapped = spark.createDataFrame([(2, *rows[0][1:]), (1, *rows[1][1:]), *rows[2:]], d.schema)
    assert h(d) != h(swapped)


def test_pool_overlap(spark):
    d = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (2, "c"), (3, "d"), (3, "e"), (4, "f"), (4, "g"), (5, "h"), (5, "i")], "pool int, digest string")
    got = {(r.left_pool, r.right_pool): (r.overlap, r.left_share, r.identical_sets) for r in AU.pool_overlap(d).collect()}
    assert len(got) == 10 and got[(1, 2)] == (1, 0.5, False) and got[(3, 4)][0] == 0


def test_student_table(spark):
    r = spark.range(1).select(SD.t_ppf(F.lit(0.975), F.lit(4)).alias("a"), SD.t_ppf(F.lit(0.95), F.lit(19)).alias("b"), SD.t_ppf(F.lit(0.975), F.lit(1)).alias("c"),
                              SD.t_sf(F.lit(2.0), F.lit(3)).alias("d"), SD.sign_p(F.lit(8), F.lit(10)).alias("e"), SD.t_ppf(F.lit(0.025), F.lit(4)).alias("f")).first()
    assert r.a == pytest.approx(2.7764451, abs=1e-6) and r.b == pytest.approx(1.7291328, abs=1e-6) and r.c == pytest.approx(12.7062047, abs=1e-5)
    assert r.d == pytest.approx(0.0696630, abs=1e-6) and r.e == pytest.approx(0.109375) and r.f == pytest.approx(-2.7764451, abs=1e-6)


def test_scaler_weights_equal_repeated_frames(spark, frames):
    """A frame counts once per window over it: against the frames of all windows one by one."""
    rnd = random.Random(3)
    rows = [(src, i, rnd.choice([1, 5, 7]), 0.1, None if i % 9 == 0 else rnd.random()) for src, n in (("long", 400), ("short", 127), ("one", 128), ("two", 161)) for i in range(n)]
    d = spark.createDataFrame(rows, "source_file string, idx long, can_id int, flat double, gap double").repartition(3)
    s = WN.fit_scaler(d, ["source_file"], ["can_id", "flat", "gap"]).first()
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    used = [r for own in by.values() for at in range(0, len(own) - 127, 32) for r in own[at : at + 128]]
    for k, c in ((2, "can_id"), (4, "gap")):
        x = [r[k] for r in used if r[k] is not None]
        assert s[f"{c}_mu"] == pytest.approx(np.mean(x)) and s[f"{c}_sd"] == pytest.approx(np.std(x))
    assert s.flat_mu == pytest.approx(0.1) and s.flat_sd == 1.0
    none = WN.fit_scaler(d.where("source_file = 'short'"), ["source_file"], ["can_id"]).first()
    assert (none.can_id_mu, none.can_id_sd) == (None, None)
    assert "Generate" not in WN.fit_scaler(d, ["source_file"], ["can_id"])._jdf.queryExecution().toString()


def test_shift_plans_read_frames_once(spark, frames, monkeypatch):
    """Divergences and quality rows are made from one written count table: exchanges and scans are counted."""
    seen, real = [], P.landed
    monkeypatch.setattr(P, "landed", lambda d, name: (seen.append(d._jdf.queryExecution().executedPlan().toString()), real(d, name))[1])
    path = scratch_dir(spark, "plan-frames")
    frames.write.parquet(path)
    f = spark.read.parquet(path)
    a, b = f.where("source_file = 's1'"), f.where("source_file <> 's1'")
    for build in (lambda: P.normal_shift(a, b), lambda: P.normal_summary(f, "source_file")):
        out = build()
        plans = [*seen, out._jdf.queryExecution().executedPlan().toString()]
        reads = sum(p.count("plan-frames") for p in plans)
        exchanges = sum(p.count("Exchange hashpartitioning") + p.count("Exchange rangepartitioning") for p in plans)
        assert reads <= 2 and exchanges <= 9, (reads, exchanges)
        assert out.count() >= 1
        seen.clear()


def test_first_ranks_equal_whole_ranking(spark):
    """Rows by the hash threshold are those of a whole ranking, also where keys are not spread as hoped."""
    rows = [(i, "ab"[i % 7 == 0], i % 3) for i in range(3000)] + [(10**9, "c", 0)] * 60 + [(5000 + i, "d", 1) for i in range(4)]
    d = spark.createDataFrame(rows, "id long, cls string, part int").repartition(5)
    want = spark.createDataFrame([("a", 20), ("b", 0), ("c", 3), ("d", 9), ("none", 5)], "cls string, quota long")
    whole = S.keyed_rank(d, ["cls"], 7, "id").join(want, "cls").where("rank <= quota")
    key = lambda t: sorted((r.cls, r.id, r["rank"]) for r in t.collect())
    assert key(S.first_ranks(d, ["cls"], want, 7, "id")) == key(whole)
    assert len(S.first_ranks(d, ["cls"], want, 7, "id").collect()) == 20 + 3 + 4
    for n in (0, 1, 500, 10**6):
        assert key(S.first_ranks(d, [], n, 7, "id")) == key(S.keyed_rank(d, [], 7, "id").where(F.col("rank") <= n))
    parts = spark.createDataFrame([(0, 5), (1, 2)], "part int, quota long")
    got = S.first_ranks(d, ["cls", "part"], parts, 7, "id").groupBy("cls", "part").count().collect()
    assert {(r.cls, r.part): r["count"] for r in got} == {("a", 0): 5, ("b", 0): 5, ("c", 0): 5, ("a", 1): 2, ("b", 1): 2, ("d", 1): 2}
    assert S.first_ranks(d.limit(0), [], 5, 7, "id").count() == 0 and S.first_ranks(d.limit(0), ["cls"], want, 7, "id").count() == 0


def test_pool_bases_are_looked_up_after_the_ranking(spark):
    """No frame array passes the exchanges of the ranks."""
    n = spark.range(200).select(F.concat(F.lit("k"), F.col("id")).alias("wkey"), F.array(F.struct(F.col("id").alias("x"))).alias("frames"))
    d = A.draw_bases(n, 50, 3)
    assert d.count() == 200 and d.select("wkey").distinct().count() == 200
    total = n.count()
    ranks = {r.wkey: i for i, r in enumerate(sorted(n.collect(), key=lambda r: (int(hashlib.md5(f"3|{r.wkey}|base".encode()).hexdigest()[:8], 16), r.wkey)))}
    for r in d.collect():
        k, c, i = r.wkey.split(":")
        u = int(hashlib.md5(f"3|{c}|{i}".encode()).hexdigest()[:8], 16) / 2**32
        assert ranks[k] == int(u * total) and r.frames[0].x == int(k[1:])


def test_target_pool_quotas(spark):
    """round(n * ratio) windows in equal shares, no base twice in a class unless it has too few, ids from the target."""
    n = spark.range(30).select(
        F.concat(F.lit("k"), F.col("id")).alias("wkey"),
        F.transform(F.sequence(F.lit(0), F.lit(127)), lambda i: F.struct(*[(F.lit(100.0) if c == "can_id" else F.lit(1.0)).alias(c) for c in CHANNELS])).alias("frames"))
    d = A.target_pool(n, 47, 3, ratio=0.5).collect()  # 23.5 goes to the even 24
    count = {}
    for r in d:
        base, c, draw = r.wkey.split(":")
        count.setdefault(int(c), []).append(base)
        assert r.y_attack_type == int(c) and {f.can_id for f in r.frames} <= ({0.0, 100.0} if c == "1" else {100.0})
    assert {c: len(v) for c, v in count.items()} == {1: 6, 2: 6, 3: 6, 4: 6} and all(len(set(v)) == 6 for v in count.values())
    odd = A.target_pool(n, 30, 3, ratio=0.2).groupBy("y_attack_type").count().collect()
    assert {r.y_attack_type: r["count"] for r in odd} == {1: 2, 2: 2, 3: 1, 4: 1}
    many = A.target_pool(n, 400, 3, full_ids=True).collect()
    by = {c: [r for r in many if r.y_attack_type == c] for c in (1, 2, 3, 4)}
    assert {c: len(v) for c, v in by.items()} == {1: 30, 2: 30, 3: 30, 4: 30} and len({r.wkey.split(":")[0] for r in by[1]}) == 30
    assert len({f.can_id for r in by[2] for f in r.frames}) > 100  # all ids for Fuzzy
    short = A.target_pool(n, 1000, 3).groupBy("y_attack_type").count().collect()
    assert {r["count"] for r in short} == {75}
    with pytest.raises(ValueError, match="no normal windows"):
        A.target_pool(n.limit(0), 100, 3)


def _bases(spark, n=6):
    one = lambda w, i: {c: float((w * 7 + i * 3 + j) % 200) for j, c in enumerate(CHANNELS)}
    kind = "wkey string, frames array<struct<" + ", ".join(f"{c}: double" for c in CHANNELS) + ">>"
    return spark.createDataFrame([(f"w{w}", [one(w, i) for i in range(A.WINDOW)]) for w in range(n)], kind)


def test_factorial_checks_count_planted_changes_in_one_shuffle(spark):
    """Clean cells have no violation; one changed byte in and one out of a burst are found; frames are not joined."""
    w = A.factorial_windows(_bases(spark), 5)
    want = {("untouched", 6 * 16 * 96), ("stratum", 6 * 8 * 32), ("p", 6 * 8 * 32), ("d", 6 * 8 * 32), ("s", 6 * 8 * 32)}
    got = A.factorial_checks(w).collect()
    assert {(r["attack"], r["check"], r["frames"]) for r in got} == {(m, *x) for m in ("gear", "rpm") for x in want}
    assert not sum(r["violations"] for r in got)

    cell = (F.col("wkey") == "w1") & (F.col("attack") == "gear") & (F.col("stratum") == "shifted") & (F.col("p") == 1) & (F.col("s") == 1) & (F.col("d") == 0)
    hurt = lambda at: F.transform("frames", lambda f, i: F.when(i == at, f.withField("data3", f["data3"] + 1)).otherwise(f))
    at = F.col("latent_start").cast("int")
    inside = A.factorial_checks(w.withColumn("frames", F.when(cell, hurt(at + 6)).otherwise(F.col("frames")))).where("violations > 0").collect()
    assert {(r["attack"], r["check"], r["violations"]) for r in inside} == {("gear", c, 1) for c in ("stratum", "p", "d")}
    outside = A.factorial_checks(w.withColumn("frames", F.when(cell, hurt(at + 1)).otherwise(F.col("frames")))).where("violations > 0").collect()
    assert [(r["attack"], r["check"], r["violations"]) for r in outside] == [("gear", "untouched", 1)]
    plan = A.factorial_checks(w)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_burst_values_are_drawn_once_for_all_cells(spark):
    """Draws lie below the row generator that deals a base out to its cells, not above it."""
    for made in (A.factorial_windows(_bases(spark), 5), A.sparse_windows(_bases(spark), (2, 32), 5, "gear").where("relation = 'intact'")):
        lines = made._jdf.queryExecution().optimizedPlan().toString().split("\n")
        depth, above = None, []
        for line in lines:
            indent = len(line) - len(line.lstrip(" :+-"))
            if "Generate " in line:
                depth = indent
            elif depth is None or indent <= depth:
                depth = None
                above.append(line)
        assert len(above) < len(lines) and not any("md5(" in line for line in above)
