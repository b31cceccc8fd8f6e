import os

import pytest

from busline.functions import text as X
from busline.plans import q_sources as QS
from busline.schema import FRAME_SCHEMA
from busline.sources import logs as L


def write(tmp_path, name, lines):
    p = os.path.join(tmp_path, name)
    with open(p, "w") as f:
        f.write("\n".join(lines) + "\n")
    return p


def test_line_numbers_cross_blocks(spark, tmp_path):
    """A file cut into many blocks still numbers its lines 1..n; blank lines count but are dropped."""
    lines = [f"line-{i}" if i % 10 else "" for i in range(1, 5001)]
    p = write(tmp_path, "big.txt", lines)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        d = L.read_lines(spark, p)
        assert spark.read.text(p).rdd.getNumPartitions() > 3
        rows = d.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(rows) == 4500
    assert all(r.value == f"line-{r.line_no}" for r in rows)


def test_attack_csv_and_rejects(spark, tmp_path):
    p = write(tmp_path, "a.csv", [
        "1.0,0316,8,05,21,68,09,21,21,00,6f,R",
        "2.0,0002,2,01,02,T",
        "1.5,0002,3,01,02,?",
        "x,0002,2,01,02,T",
        "3.0,0002,2,01,1ff,T",
        "3.0,02",
        "3.0,00zz,2,01,02,R",
        "4.0,0001,9,01,R",
    ])
    f, bad = L.read_attack_csv(spark, p, "Gear")
    assert [c.name for c in f.schema] == [c.name for c in FRAME_SCHEMA]
    rows = {r.row_in_source: r for r in f.collect()}
    assert sorted(rows) == [1, 2, 3, 8]
    assert (rows[1].data7, rows[1].can_id, rows[1].attack_type) == (0x6F, 0x316, "Normal")
    assert (rows[2].attack_type, rows[2].attack_type_id, rows[2].data2) == ("Gear", 3, 0)
    assert (rows[3].binary_label, rows[3].binary_label_id, rows[3].payload_len_mismatch) == ("Unknown", -1, True)
    assert (rows[3].segment_id, rows[3].row_in_segment) == (1, 0)
    assert (rows[8].invalid_dlc, rows[8].dlc, rows[8].payload_len) == (True, 9, 1)
    errors = {r.line_no: r.error for r in bad.collect()}
    assert errors == {4: "bad timestamp", 5: "bad payload byte", 6: "too few fields", 7: "bad id"}


def test_tagged_txt_cuts_at_dlc(spark, tmp_path):
    p = write(tmp_path, "n.txt", ["Timestamp: 1.5    ID: 0316    000    DLC: 2    05 21 68"])
    parsed = L.parse_tagged_txt(L.read_lines(spark, p)).first()
    assert (parsed.payload, parsed.tokens_after_dlc) == ([5, 0x21], 3)
    f, _ = L.read_tagged_txt(spark, p, "txt_scenario", "Fuzzy")
    r = f.first()
    assert (r.is_weak_label, r.original_label, r.attack_type, r.payload_len) == (True, "scenario_Fuzzy", "Fuzzy", 2)


def test_candump_skips_other_lines(spark, tmp_path):
    p = write(tmp_path, "c.log", ["(10.5) can0 1A#00ff3", "noise", "(11.0) can0 7FF#"])
    rows = sorted(L.read_candump(spark, p).collect(), key=lambda r: r.timestamp)
    assert [(r.can_id, r.dlc, r.data1, r.data2, r.padded) for r in rows] == [(0x1A, 2, 0xFF, 0x30, "00FF300000000000"), (0x7FF, 0, 0, 0, "0" * 16)]


def test_hex_csv_issues(spark, tmp_path):
    p = write(tmp_path, "h.csv", ["timestamp,arbitration_id,data_field,attack", "1.0,1F,0102F,0", "2.0,,zz,1", "3.0,7FF,010203040506070809,0"])
    f, issues = L.read_hex_csv(spark, p)
    rows = sorted(f.collect(), key=lambda r: r.timestamp)
    assert [(r.can_id, r.dlc, r.data1) for r in rows] == [(0x1F, 2, 2), (0, 0, 0), (0x7FF, 9, 2)]
    i = issues.first()
    assert (i.odd_length_payload, i.malformed_payload, i.dlc_gt_8) == (1, 1, 1)


def test_hex_and_wildcards(spark):
    d = spark.createDataFrame([("4z",), ("ff",), ("100",), ("0x1F",), (" a ",)], "t string")
    got = [tuple(r) for r in d.select(X.hex_to_int("t"), X.hex_byte("t")).collect()]
    assert got == [(None, None), (255, 255), (256, None), (31, 31), (10, 10)]
    d = spark.createDataFrame([("00FF00FF00FF00FF", "XXFFXXXXXXXXXXXX"), ("00FE00FF00FF00FF", "xxffXXXXXXXXXXXX")], "p string, m string")
    assert [r[0] for r in d.select(X.payload_matches("p", "m")).collect()] == [True, False]


def test_merge_shards_guards(spark):
    a = spark.createDataFrame([(1, 0.5)], "k int, v double")
    b = spark.createDataFrame([(2, 0.25, "x")], "k int, v double, note string")
    assert {tuple(r) for r in L.merge_shards([a, b], ["k"]).collect()} == {(1, 0.5, None), (2, 0.25, "x")}
    with pytest.raises(Exception, match="a cell occurs twice"):
        L.merge_shards([a, a], ["k"]).collect()
    with pytest.raises(Exception, match="a shard is empty"):
        L.merge_shards([a, b.where("k > 9")], ["k"]).collect()
    with pytest.raises(ValueError, match="lacks key columns"):
        L.merge_shards([a, b.drop("k")], ["k"])


def test_long_ids_survive_the_text(spark):
    """Ids of more than four hex digits are written whole, shorter ones padded to four."""
    d = spark.createDataFrame([(26,), (2047,), (65535,), (65536,), (89999,)], "can_id int").select(QS._hex_id().alias("h"))
    assert [r.h for r in d.collect()] == ["001a", "07ff", "ffff", "10000", "15f8f"]
