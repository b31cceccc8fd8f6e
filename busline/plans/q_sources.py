"""Queries for readers, sinks and scalar functions (sections A and B)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from busline.functions import text as X
from busline.operators import masks as M
from busline.operators import profile as P
from busline.operators import timeline as TL
from busline.plans.registry import query
from busline.plans.views import Tables
from busline.schema import BYTES
from busline.session import scratch_dir
from busline.sources import logs as L


def _seconds():
    return F.format_string("%d.%06d", F.floor(F.col("us") / 1000000), F.col("us") % 1000000)


def _hex_id():
    """Four hex digits at least; ``lpad`` alone would cut longer ids."""
    digits = F.lower(F.hex("can_id"))
    return F.lpad(digits, F.greatest(F.lit(4), F.length(digits)), "0")


def _four_digits():
    """The id as the SQL twin of A7 writes it into faulty lines, cut at four digits."""
    return F.lpad(F.lower(F.hex("can_id")), 4, "0")


def _payload_hex():
    return F.expr("substr(h, 1, 2 * dlc)")


def _joined(sep: str):
    return F.regexp_replace(F.regexp_replace(_payload_hex(), "(..)", f"$1{sep}"), f"{sep}$", "")


def _write_lines(d: DataFrame, line, name: str) -> str:
    """Lines as a text tree with one folder per source, in source order inside each file."""
    path = scratch_dir(d.sparkSession, name)
    d = d.select("source_file", "row_in_source", line.alias("value"))
    d = d.repartitionByRange("source_file", "row_in_source").sortWithinPartitions("source_file", "row_in_source")
    d.select("source_file", "value").write.partitionBy("source_file").text(path)
    return path


def _csv_line():
    flag = F.when(F.col("binary_label_id") == 1, "T").otherwise("R")
    return F.concat_ws(",", _seconds(), _hex_id(), F.col("dlc").cast("string"), _joined(","), flag)


def _txt_line():
    return F.concat(
        F.lit("Timestamp: "), _seconds(), F.lit("        ID: "), _hex_id(), F.lit("    000    DLC: "),
        F.col("dlc").cast("string"), F.lit("    "), _joined(" "),
    )


_FRAME_COLS = ["source_file", "timestamp", "can_id", "dlc", *BYTES]
_DATA_SQL = ", ".join(f"data{i}::BIGINT AS data{i}" for i in range(8))
_FRAME_SQL = f"source_file, timestamp, can_id::BIGINT AS can_id, dlc::BIGINT AS dlc, {_DATA_SQL}"


def _longs(d: DataFrame, cols) -> DataFrame:
    keep = {"source_file", "timestamp"}
    return d.select(*[F.col(c) if c in keep else F.col(c).cast("long").alias(c) for c in cols])


@query("a1_attack_csv", f"SELECT {_FRAME_SQL}, binary_label_id::BIGINT AS binary_label_id FROM lab")
def a1(t: Tables):
    frames, _ = L.read_attack_csv(t.spark, _write_lines(t.labelled, _csv_line(), "csv"))
    return _longs(frames, [*_FRAME_COLS, "binary_label_id"])


@query("a2_tagged_txt", f"SELECT {_FRAME_SQL}, dlc::BIGINT AS payload_len FROM lab")
def a2(t: Tables):
    frames, _ = L.read_tagged_txt(t.spark, _write_lines(t.labelled, _txt_line(), "txt"))
    return _longs(frames, [*_FRAME_COLS, "payload_len"])


@query("a3_candump", f"SELECT {_FRAME_SQL} FROM lab WHERE event_id % 50 <> 0")
def a3(t: Tables):
    good = F.concat(F.lit("("), _seconds(), F.lit(") can0 "), F.upper(_hex_id()), F.lit("#"), F.upper(_payload_hex()))
    line = F.when(F.col("event_id") % 50 == 0, F.lit("# interface down")).otherwise(good)
    return _longs(L.read_candump(t.spark, _write_lines(t.labelled, line, "candump")), _FRAME_COLS)


@query("a4_hex_csv", f"SELECT {_FRAME_SQL}, binary_label_id::BIGINT AS attack FROM lab")
def a4(t: Tables):
    path = scratch_dir(t.spark, "hexcsv")
    d = t.labelled.select(
        "source_file", _seconds().alias("timestamp"), _hex_id().alias("arbitration_id"),
        _payload_hex().alias("data_field"), F.col("binary_label_id").alias("attack"),
    )
    d.write.partitionBy("source_file").option("header", True).csv(path)
    frames, _ = L.read_hex_csv(t.spark, path)
    return _longs(frames, [*_FRAME_COLS, "attack"])


VEHICLES = {
    "set_0": {"known": "car A", "unknown": "car B"},
    "set_1": {"known": "car C", "unknown": "car D"},
    "set_2": {"known": "car E", "unknown": "car F"},
}
# Folder names of the subsets.
_SUBSETS = ["train_01", "test_01_known_vehicle_known_attack", "test_02_unknown_vehicle_known_attack",
            "test_03_known_vehicle_unknown_attack", "test_04_unknown_vehicle_unknown_attack"]


def files(t: Tables) -> DataFrame:
    """A file list with one log file per supplier."""
    k = F.col("s_suppkey")
    sub = F.get(F.array(*[F.lit(s) for s in _SUBSETS]), (k % 5).cast("int"))
    stem = F.when(k % 3 == 0, "DoS").when(k % 3 == 1, "rpm-accessory").otherwise("force-neutral")
    path = F.concat(F.lit("logs/set_"), (k % 3).cast("string"), F.lit("/"), sub, F.lit("/"), stem, F.lit("-"), k.cast("string"), F.lit(".csv"))
    return t.read("supplier").select(k.alias("unit"), path.alias("path"))


_SUBSET_CASE = "CASE s_suppkey % 5 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(_SUBSETS)) + " END"
FILES_SQL = f"""SELECT s_suppkey AS unit, 'set_' || (s_suppkey % 3) AS set_id, {_SUBSET_CASE} AS subset_id,
  CASE s_suppkey % 3 WHEN 0 THEN 'DoS' WHEN 1 THEN 'rpm-accessory' ELSE 'force-neutral' END AS source_stem,
  CASE s_suppkey % 5 WHEN 0 THEN 'train' WHEN 2 THEN 'unknown_vehicle' WHEN 4 THEN 'unknown_vehicle' ELSE 'known_vehicle' END AS vehicle_axis,
  CASE s_suppkey % 5 WHEN 0 THEN 'train' WHEN 3 THEN 'unknown_attack' WHEN 4 THEN 'unknown_attack' ELSE 'known_attack' END AS attack_axis,
  'car ' || substr('ABCDEF', (2 * (s_suppkey % 3) + CASE WHEN s_suppkey % 5 IN (2, 4) THEN 2 ELSE 1 END)::INT, 1) AS vehicle
FROM supplier"""


@query("a5_path_meta", FILES_SQL)
def a5(t: Tables):
    d = L.with_path_meta(files(t), VEHICLES)
    return d.select("unit", "set_id", "subset_id", "source_stem", "vehicle_axis", "attack_axis", "vehicle")


@query("a6_scan_sources", """
SELECT source_file, row_in_source::BIGINT AS n, mode, binary_label, attack_type, is_weak_label FROM (
SELECT source_file, count(*) AS row_in_source,
  CASE source_file WHEN 'src_0' THEN 'csv' WHEN 'src_1' THEN 'txt_normal' ELSE 'txt_scenario' END AS mode,
  CASE source_file WHEN 'src_0' THEN CASE binary_label_id WHEN 1 THEN 'Attack' ELSE 'Normal' END WHEN 'src_1' THEN 'Normal' ELSE 'Attack' END AS binary_label,
  CASE source_file WHEN 'src_0' THEN CASE binary_label_id WHEN 1 THEN 'DoS' ELSE 'Normal' END WHEN 'src_1' THEN 'Normal' WHEN 'src_2' THEN 'Fuzzy' ELSE 'Impersonation' END AS attack_type,
  source_file IN ('src_2', 'src_3') AS is_weak_label
FROM lab GROUP BY ALL)""")
def a6(t: Tables):
    d = t.labelled
    csv = _write_lines(d, _csv_line(), "csv")
    txt = _write_lines(d, _txt_line(), "txt")
    spec = [
        (f"{csv}/source_file=src_0", "src_0", "DoS", "csv"),
        (f"{txt}/source_file=src_1", "src_1", "Normal", "txt_normal"),
        (f"{txt}/source_file=src_2", "src_2", "Fuzzy", "txt_scenario"),
        (f"{txt}/source_file=src_3", "src_3", "Impersonation", "txt_scenario"),
    ]
    f = L.scan_sources(t.spark, spec)
    return f.groupBy("source_file", F.col("label_mode").alias("mode"), "binary_label", "attack_type", "is_weak_label").agg(
        F.count("*").alias("n"))


_BAD_SQL = r"""SELECT source_file, row_in_source,
  CASE WHEN event_id % 97 = 0 THEN 'bad id' WHEN event_id % 89 = 0 THEN 'bad payload byte' WHEN event_id % 101 = 0 THEN 'too few fields' END AS error,
  rtrim(substr(CASE
    WHEN event_id % 97 = 0 THEN ts || ',zz' || tail
    WHEN event_id % 89 = 0 THEN ts || ',' || idh || ',8,1ff' || ',R'
    WHEN event_id % 101 = 0 THEN ts || ',' || idh
  END, 1, 160)) AS raw_prefix
FROM (SELECT *, (us // 1000000) || '.' || lpad((us % 1000000)::VARCHAR, 6, '0') AS ts, lpad(lower(to_hex(can_id)), 4, '0') AS idh,
  ',' || dlc || ',' || rtrim(regexp_replace(substr(h, 1, 2 * dlc), '(..)', '\1,', 'g'), ',') || ',' || CASE binary_label_id WHEN 1 THEN 'T' ELSE 'R' END AS tail
  FROM lab)
WHERE event_id % 97 = 0 OR event_id % 89 = 0 OR event_id % 101 = 0"""


@query("a7_rejects", f"SELECT source_file, error, raw_prefix FROM ({_BAD_SQL})")
def a7(t: Tables):
    e = F.col("event_id")
    tail = F.concat_ws(",", F.col("dlc").cast("string"), _joined(","), F.when(F.col("binary_label_id") == 1, "T").otherwise("R"))
    line = (
        F.when(e % 97 == 0, F.concat_ws(",", _seconds(), F.lit("zz"), tail))
        .when(e % 89 == 0, F.concat_ws(",", _seconds(), _four_digits(), F.lit("8,1ff,R")))
        .when(e % 101 == 0, F.concat_ws(",", _seconds(), _four_digits()))
        .otherwise(_csv_line())
    )
    _, bad = L.read_attack_csv(t.spark, _write_lines(t.labelled, line, "csv"))
    return bad.select("source_file", "error", "raw_prefix")


def frame_table(t: Tables) -> DataFrame:
    """The canonical 26 columns from the labelled view."""
    d = t.labelled.select(
        "source_file", F.col("row_in_source").alias("line_no"), "timestamp", "can_id", F.col("dlc").alias("raw_dlc"),
        F.slice(F.array(*BYTES), F.lit(1), F.col("dlc")).alias("payload"),
        F.when(F.col("binary_label_id") == 1, "T").otherwise("R").alias("raw_label"),
    )
    return L.to_frames(d, "events", F.lit("csv"), F.lit("DoS"))


@query("a8_frame_sink", "SELECT source_file, count(*) AS n, max(row_in_source)::BIGINT AS last FROM raw GROUP BY source_file")
def a8(t: Tables):
    path = scratch_dir(t.spark, "frames")
    L.write_frames(frame_table(t), path)
    return t.spark.read.parquet(path).groupBy("source_file").agg(F.count("*").alias("n"), F.max("row_in_source").alias("last"))


@query("a9_split_sink", "SELECT source_file, split, count(*) AS n FROM sg WHERE split = 'train' GROUP BY ALL")
def a9(t: Tables):
    path = scratch_dir(t.spark, "splits")
    L.write_splits(TL.split_frames(t.labelled, 6 * 3600.0).select("source_file", "row_in_source", "can_id", "split"), path)
    return t.spark.read.parquet(path).where("split = 'train'").groupBy("source_file", "split").agg(F.count("*").alias("n"))


@query("a10_pruned_scan", "SELECT source_file, count(DISTINCT can_id)::BIGINT AS ids, max(timestamp) AS last FROM lab GROUP BY source_file")
def a10(t: Tables):
    path = scratch_dir(t.spark, "frames")
    L.write_frames(frame_table(t), path)
    d = L.read_frames(t.spark, path, ["source_file", "can_id", "timestamp"])
    return d.groupBy("source_file").agg(F.count_distinct("can_id").alias("ids"), F.max("timestamp").alias("last"))


@query("a11_capture_meta", """
SELECT 'cap_' || s_suppkey AS capture, lower(to_hex(s_suppkey)) AS injection_id, s_suppkey * 1.0::DOUBLE AS lo, s_suppkey * 2.0::DOUBLE AS hi,
 repeat('X', 14) || lpad(lower(to_hex(s_suppkey % 256)), 2, '0') AS pattern FROM supplier""")
def a11(t: Tables):
    k = F.col("s_suppkey")
    doc = F.to_json(F.create_map(
        F.concat(F.lit("cap_"), k.cast("string")),
        F.struct(
            F.lower(F.hex(k)).alias("injection_id"),
            F.array(k.cast("double"), k * 2.0).alias("injection_interval"),
            F.concat(F.lit("X" * 14), F.lpad(F.lower(F.hex(k % 256)), 2, "0")).alias("injection_data_str"),
        ),
    ))
    path = scratch_dir(t.spark, "meta")
    t.read("supplier").select(doc.alias("value")).write.text(path)
    m = L.read_capture_meta(t.spark, path)
    return m.select("capture", "injection_id", F.col("injection_interval")[0].alias("lo"), F.col("injection_interval")[1].alias("hi"),
                    F.col("injection_data_str").alias("pattern"))


@query("a12_window_table", "SELECT source_file, y_binary::BIGINT AS y_binary, count(*) AS n, (count(*) * 128)::BIGINT AS frames FROM wl GROUP BY ALL")
def a12(t: Tables):
    path = scratch_dir(t.spark, "windows")
    L.write_windows(t.windows, path)
    w = L.read_windows(t.spark, path)
    return w.groupBy("source_file", F.col("y_binary").cast("long").alias("y_binary")).agg(F.count("*").alias("n"), F.sum(F.size("frames")).alias("frames"))


@query("a13_result_sink", """
SELECT setting, coalesce(seed, -1)::BIGINT AS seed, coalesce(n, -1)::BIGINT AS n, mean_score FROM (
SELECT setting, seed, count(*) AS n, NULL::DOUBLE AS mean_score FROM sc GROUP BY setting, seed UNION ALL SELECT setting, NULL, NULL, round(avg(score), 6) FROM sc GROUP BY setting)""")
def a13(t: Tables):
    path = scratch_dir(t.spark, "result")
    s = t.scores
    a = s.groupBy("setting", "seed").agg(F.count("*").alias("n"))
    b = s.groupBy("setting").agg(F.round(F.avg("score"), 6).alias("mean_score"))
    L.write_result([a, b], path)
    d = t.spark.read.csv(path, header=True, schema="setting string, seed int, n long, mean_score double")
    return d.select("setting", F.coalesce(F.col("seed").cast("long"), F.lit(-1)).alias("seed"), F.coalesce("n", F.lit(-1)).alias("n"), "mean_score")


@query("a14_merge_shards", "SELECT setting, seed::BIGINT AS seed, count(*) AS n, sum(y)::BIGINT AS hits FROM sc GROUP BY ALL")
def a14(t: Tables):
    cells = t.scores.groupBy("setting", F.col("seed").cast("long").alias("seed")).agg(F.count("*").alias("n"), F.sum("y").alias("hits"))
    return L.merge_shards([cells.where("setting = 'O'"), cells.where("setting = 'F'")], ["setting", "seed"])


@query("a15_unit_view", f"""
WITH f AS ({FILES_SQL}), r AS (SELECT unit, CASE WHEN sum(y) > 0 THEN 'attack' ELSE 'normal' END AS role FROM sc GROUP BY unit)
SELECT set_id, subset_id, vehicle, role, set_id || '/' || subset_id || '/' || role AS stratum, count(*) AS windows, count(DISTINCT sc.unit) AS units
FROM sc JOIN r USING (unit) JOIN f USING (unit) GROUP BY ALL""")
def a15(t: Tables):
    w = t.scores.select("unit", F.col("y").alias("y_binary"))
    d = L.unit_view(w, L.with_path_meta(files(t), VEHICLES).drop("path"), "unit")
    return d.groupBy("set_id", "subset_id", "vehicle", "role", "stratum").agg(
        F.count("*").alias("windows"), F.count_distinct("unit").alias("units"))


@query("b1_hex_parse", """
SELECT event_id, (CASE WHEN event_id % 7 = 0 THEN -1 ELSE ('0x' || substr(h, 1, 3))::INT END)::BIGINT AS id,
 (CASE WHEN event_id % 7 = 0 OR ('0x' || substr(h, 1, 3))::INT > 255 THEN -1 ELSE ('0x' || substr(h, 1, 3))::INT END)::BIGINT AS byte FROM raw""")
def b1(t: Tables):
    txt = F.when(F.col("event_id") % 7 == 0, F.concat(F.substring("h", 1, 2), F.lit("z"))).otherwise(F.substring("h", 1, 3))
    d = t.raw.withColumn("x", txt)
    return d.select("event_id", F.coalesce(X.hex_to_int("x"), F.lit(-1)).alias("id"),
                    F.coalesce(X.hex_byte("x"), F.lit(-1)).cast("long").alias("byte"))


@query("b2_pad_payload", f"SELECT event_id, concat_ws(',', {', '.join(f'data{i}' for i in range(8))}) AS padded FROM lab")
def b2(t: Tables):
    arr = F.slice(F.array(*BYTES), F.lit(1), F.col("dlc"))
    return t.labelled.select("event_id", F.array_join(X.pad_payload(arr), ",").alias("padded"))


@query("b3_decode_payload", """
SELECT event_id, (CASE WHEN event_id % 11 = 0 THEN 0 ELSE n // 2 END)::BIGINT AS dlc,
 (CASE WHEN event_id % 11 = 0 OR n < 2 THEN 0 ELSE ('0x' || substr(h, 1, 2))::INT END)::BIGINT AS first_byte,
 (CASE WHEN event_id % 11 = 0 OR n < 16 THEN 0 ELSE ('0x' || substr(h, 15, 2))::INT END)::BIGINT AS eighth_byte,
 n % 2 = 1 AS odd_length, event_id % 11 = 0 AS malformed, event_id % 11 <> 0 AND n // 2 > 8 AS too_long
FROM (SELECT *, event_id % 21 + 2 AS n FROM raw)""")
def b3(t: Tables):
    e = F.col("event_id")
    text = F.substr(F.col("h"), F.lit(1), (e % 21 + 2).cast("int"))
    bad = F.when(e % 11 == 0, F.concat(F.lit("x"), F.substr(text, F.lit(2), F.length(text)))).otherwise(text)
    d = t.raw.select("event_id", X.decode_payload(bad).alias("d"))
    return d.select("event_id", F.col("d.dlc").cast("long").alias("dlc"), F.col("d.bytes")[0].cast("long").alias("first_byte"),
                    F.col("d.bytes")[7].cast("long").alias("eighth_byte"), "d.odd_length", "d.malformed", "d.too_long")


@query("b4_dlc_flags", """
SELECT event_id, v NOT BETWEEN 0 AND 8 AS invalid_dlc, dlc <> v AS payload_len_mismatch, greatest(0, least(v, 255))::BIGINT AS dlc, dlc::BIGINT AS payload_len
FROM (SELECT *, event_id % 300 - 20 AS v FROM raw)""")
def b4(t: Tables):
    d = t.labelled.select("event_id", (F.col("event_id") % 300 - 20).alias("raw_dlc"),
                          F.slice(F.array(*BYTES), F.lit(1), F.col("dlc")).alias("payload"))
    d = L.with_dlc_flags(d)
    return d.select("event_id", "invalid_dlc", "payload_len_mismatch", F.col("dlc").cast("long").alias("dlc"), F.col("payload_len").cast("long").alias("payload_len"))


@query("b5_label_map", """
SELECT event_id, CASE f WHEN 'T' THEN 'Attack' WHEN 'R' THEN 'Normal' ELSE 'Unknown' END AS binary_label,
 (CASE f WHEN 'T' THEN 1 WHEN 'R' THEN 0 ELSE -1 END)::BIGINT AS binary_label_id,
 CASE f WHEN 'T' THEN sc WHEN 'R' THEN 'Normal' ELSE 'Unknown' END AS attack_type,
 (CASE f WHEN 'T' THEN CASE sc WHEN 'Fuzzy' THEN 2 WHEN 'Gear' THEN 3 ELSE 4 END WHEN 'R' THEN 0 ELSE -1 END)::BIGINT AS attack_type_id, f AS original_label, false AS is_weak_label
FROM (SELECT event_id, CASE event_type WHEN 'view' THEN 'R' WHEN 'click' THEN '?' ELSE 'T' END AS f,
 CASE event_type WHEN 'error' THEN 'Fuzzy' WHEN 'signup' THEN 'Gear' ELSE 'RPM' END AS sc FROM raw)""")
def b5(t: Tables):
    e = F.col("event_type")
    d = t.raw.select("event_id", F.when(e == "view", "R").when(e == "click", "?").otherwise("T").alias("raw_label"),
                     F.when(e == "error", "Fuzzy").when(e == "signup", "Gear").otherwise("RPM").alias("scenario"))
    d = L.map_labels(d, F.lit("csv"), F.col("scenario")).drop("scenario")
    return d.withColumn("binary_label_id", F.col("binary_label_id").cast("long")).withColumn("attack_type_id", F.col("attack_type_id").cast("long"))


@query("b6_wildcard", "SELECT event_id, upper(substr(h, 1, 16)) LIKE '_A____________' || upper(right(h, 1)) || '_' AS hit FROM raw")
def b6(t: Tables):
    pattern = F.concat(F.lit("XA" + "X" * 12), F.right("h", F.lit(1)), F.lit("x"))
    return t.raw.select("event_id", X.payload_matches(F.upper(F.substring("h", 1, 16)), pattern).alias("hit"))


def _capture():
    k = F.col("s_suppkey")
    names = X.CAPTURE_FAMILIES + ["idle"]
    name = F.get(F.array(*[F.lit(n) for n in names]), (k % 9).cast("int"))
    return F.concat(name, F.lit("_"), k.cast("string"), F.when(k % 2 == 0, "_masquerade").otherwise(""))


_FAM = "['correlated_signal','fuzzing','max_speedometer','reverse_light_off','reverse_light_on','max_engine_coolant_temp','accelerator','ambient','other']"


@query("b7_capture_family", f"SELECT s_suppkey AS unit, {_FAM}[s_suppkey % 9 + 1] AS family, s_suppkey % 2 = 0 AS masquerade FROM supplier")
def b7(t: Tables):
    d = t.read("supplier").select(F.col("s_suppkey").alias("unit"), _capture().alias("c"))
    return d.select("unit", X.capture_family("c").alias("family"), X.is_masquerade("c").alias("masquerade"))


# Which attack a source stem stands for and how sure that is.
FAMILIES = {
    "DoS": ("DoS", "direct_name"),
    "fuzzing": ("Fuzzy", "direct_name"),
    "rpm": ("RPM", "direct_name"),
    "force-neutral": ("Gear-like", "tentative_semantic"),
    "rpm-accessory": ("RPM/accessory", "binary_only"),
    "speed-accessory": ("Speed/accessory", "binary_only"),
}


@query("b8_family_map", """
SELECT s_suppkey AS unit, CASE s_suppkey % 4 WHEN 0 THEN 'DoS' WHEN 1 THEN 'RPM/accessory' WHEN 2 THEN 'Gear-like' ELSE 'other_attack' END AS family,
 CASE s_suppkey % 4 WHEN 0 THEN 'direct_name' WHEN 1 THEN 'binary_only' WHEN 2 THEN 'tentative_semantic' ELSE 'binary_only' END AS confidence FROM supplier""")
def b8(t: Tables):
    k = F.col("s_suppkey")
    stem = F.when(k % 4 == 0, "DoS").when(k % 4 == 1, "rpm-accessory").when(k % 4 == 2, "force-neutral").otherwise("door")
    d = t.read("supplier").select(k.alias("unit"), stem.alias("source_stem"))
    return P.map_family(d, FAMILIES).select("unit", "family", "confidence")


_DT_CASE = """CASE WHEN x < 0 THEN 'neg' WHEN x = 0 THEN '0' WHEN x < 1e-4 THEN '<0.1ms' WHEN x < 5e-4 THEN '0.1-0.5ms' WHEN x < 1e-3 THEN '0.5-1ms'
 WHEN x < 5e-3 THEN '1-5ms' WHEN x < 1e-2 THEN '5-10ms' WHEN x < 5e-2 THEN '10-50ms' WHEN x < 1e-1 THEN '50-100ms' ELSE '>=100ms' END"""


@query("b9_dt_bin", f"SELECT bin, count(*) AS n FROM (SELECT {_DT_CASE} AS bin FROM (SELECT ((us % 1000000 - 20000) * (us % 7) / 4e7) AS x FROM raw)) GROUP BY bin")
def b9(t: Tables):
    x = (F.col("us") % 1000000 - 20000) * (F.col("us") % 7) / F.lit(4e7)
    return t.raw.select(X.dt_bin(x).alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))


_COUNTS = "SELECT source_file, k, count(*) AS c FROM (SELECT source_file, dlc::VARCHAR AS k FROM lab) GROUP BY ALL"


@query("b10_compact_counts", f"SELECT source_file, string_agg(k || ':' || c, ';' ORDER BY k) AS counts FROM ({_COUNTS}) GROUP BY source_file")
def b10(t: Tables):
    return P.compact_counts(t.labelled, ["source_file"], "dlc", "counts")


@query("b11_explode_counts", "SELECT dlc::VARCHAR AS k, count(*) AS n FROM lab GROUP BY ALL")
def b11(t: Tables):
    d = P.compact_counts(t.labelled, ["source_file"], "dlc", "counts")
    return P.explode_counts(d, [], "counts").select("k", "n")


@query("b12_mask_channels", """
SELECT source_file, start_index, round(avg(can_id), 6) AS can_id, round(avg(dlc), 6) AS dlc, 0.0::DOUBLE AS data0, round(avg(delta_t), 6) AS delta_t
FROM (SELECT source_file, start_index, (SELECT avg(can_id) FROM fr WHERE binary_label_id = 0) AS can_id, dlc, delta_t FROM wf) GROUP BY ALL""")
def b12(t: Tables):
    mean_id = t.frames.where("binary_label_id = 0").select(F.avg("can_id").alias("m"))
    w = t.windows.withColumn("_id", mean_id.scalar())
    w = M.mask_channels(w, {"can_id": F.col("_id"), "data0": F.lit(0.0)})
    f = w.select("source_file", "start_index", F.explode("frames").alias("f"))
    return f.groupBy("source_file", "start_index").agg(*[F.round(F.avg(f"f.{c}"), 6).alias(c) for c in ("can_id", "dlc", "data0", "delta_t")])


@query("b13_mask_constants", """
WITH n AS (SELECT wf.* FROM wf JOIN wl USING (source_file, start_index) WHERE y_binary = 0)
SELECT round((SELECT avg(can_id) FROM fr WHERE binary_label_id = 0), 6) AS frame_can_id,
 round(avg(can_id), 6) AS can_id, round(avg(dlc), 6) AS dlc, round(avg(data0), 6) AS data0, round(avg(data7), 6) AS data7, round(avg(delta_t), 6) AS delta_t FROM n""")
def b13(t: Tables):
    d = M.mask_constants(t.frames, t.windows)
    return d.select(*[F.round(c, 6).alias(c) for c in ("frame_can_id", "can_id", "dlc", "data0", "data7", "delta_t")])
