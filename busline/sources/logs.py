"""Readers for raw message logs and the sinks for the tables made from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from busline.functions import text as X
from busline.operators.timeline import with_segments
from busline.schema import BYTES, FRAME_SCHEMA, HEX_CSV_SCHEMA
from busline.session import landed

REJECT_PREFIX = 160


def _text(spark: SparkSession, paths) -> DataFrame:
    """Text lines with their file, file block and an id that rises by one inside a block."""
    raw = spark.read.text(paths)
    extra = [c for c in raw.columns if c != "value"]
    return raw.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_id"),
        "value",
        *extra,
    )


def _numbered(lines: DataFrame, every: DataFrame) -> DataFrame:
    """Line numbers for ``lines``, from the ids of all lines and the number of lines in the blocks before.

    The block table has one row per file block.  It is written first, so Spark
    knows its size and decides how to join it.
    """
    blocks = every.groupBy("path", "_block").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = W.partitionBy("path").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    blocks = landed(blocks.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n"), "blocks")
    number = F.col("_id") - F.col("_first") + F.col("_before") + 1
    checked = F.when(number.isNull(), F.raise_error(F.lit("file blocks changed between scans")).cast("long")).otherwise(number)
    return lines.join(blocks, ["path", "_block"], "left").withColumn("line_no", checked).drop("_block", "_id", "_first", "_before")


def read_lines(spark: SparkSession, paths) -> DataFrame:
    """Text lines with their line number in the file; blank ones are left out but counted.

    Line numbers come from two levels: the position inside a file block and the
    number of lines in the blocks before it, so a file of any size is read by
    many tasks.  Both scans see the same blocks; a mismatch raises.
    """
    raw = _text(spark, paths)
    out = _numbered(raw, raw).where(F.trim("value") != "")
    return out.select("path", "line_no", "value", *[c for c in out.columns if c not in ("path", "line_no", "value")])


def read_parsed(spark: SparkSession, paths, parse) -> DataFrame:
    """Parsed lines with their line number, from one scan of the text.

    Good, faulty and blank lines are written once, in folders of their own;
    block counts are then taken from the narrow columns of that table. Text is
    kept for faulty lines only.
    """
    d = parse(_named(_text(spark, paths)))
    kind = F.when(F.trim("value") == "", "blank").when(F.col("error").isNotNull(), "faulty").otherwise("good")
    d = d.withColumn("_kind", kind).withColumn("value", F.when(F.col("_kind") == "faulty", F.left("value", F.lit(REJECT_PREFIX))))
    table = landed(d, "parsed", ["_kind"])
    return _numbered(table.where("_kind <> 'blank'").drop("_kind"), table)


def _errors(checks: list[tuple[Column, str]]) -> Column:
    return F.coalesce(*[F.when(bad, F.lit(msg)) for bad, msg in checks])


def parse_attack_csv(lines: DataFrame) -> DataFrame:
    """``ts,hex id,dlc,b0..bn,flag``: payload is all between dlc and the last field."""
    parts = F.split("value", ",")
    n = F.size("_p")
    d = lines.withColumn("_p", parts).withColumn("_few", n < 5)
    pick = lambda i: F.when(~F.col("_few"), F.get("_p", F.lit(i)))
    d = d.withColumn("timestamp", pick(0).try_cast("double")).withColumn("can_id", X.hex_to_int(pick(1)))
    d = d.withColumn("raw_dlc", F.trim(pick(2)).try_cast("int"))
    body = F.when(~F.col("_few"), F.slice("_p", F.lit(4), n - 4))
    d = d.withColumn("payload", F.transform(body, X.hex_byte))
    d = d.withColumn("raw_label", F.trim(F.element_at("_p", -1)))
    return _with_error(d, [(F.col("_few"), "too few fields")]).drop("_p", "_few")


def parse_tagged_txt(lines: DataFrame) -> DataFrame:
    """``Timestamp: t ID: hex 000 DLC: n b0..bn``: payload tokens are cut at dlc."""
    d = lines.withColumn("_p", F.split(F.trim("value"), r"\s+"))
    at = F.array_position("_p", F.lit("DLC:")).cast("int")
    d = d.withColumn("_at", at)
    d = d.withColumn("timestamp", F.get("_p", F.lit(1)).try_cast("double"))
    d = d.withColumn("can_id", X.hex_to_int(F.get("_p", F.lit(3))))
    d = d.withColumn("raw_dlc", F.when(F.col("_at") > 0, F.get("_p", F.col("_at"))).try_cast("int"))
    tokens = F.when(
        F.col("_at") > 0, F.slice("_p", F.col("_at") + 2, F.greatest(F.coalesce("raw_dlc", F.lit(0)), F.lit(0)))
    )
    d = d.withColumn("_tail", F.when(F.col("_at") > 0, F.size("_p") - F.col("_at") - 1))
    d = d.withColumn("payload", F.transform(tokens, X.hex_byte)).withColumn("raw_label", F.lit(None).cast("string"))
    d = _with_error(d, [(F.col("_at") == 0, "no DLC tag")])
    return d.withColumnRenamed("_tail", "tokens_after_dlc").drop("_p", "_at")


def _with_error(d: DataFrame, first: list[tuple[Column, str]]) -> DataFrame:
    checks = [
        *first,
        (F.col("timestamp").isNull(), "bad timestamp"),
        (F.col("can_id").isNull(), "bad id"),
        (F.col("raw_dlc").isNull(), "bad dlc"),
        (F.exists("payload", lambda b: b.isNull()), "bad payload byte"),
    ]
    return d.withColumn("error", _errors(checks))


CANDUMP = r"^\((\d+\.\d+)\)\s+\S+\s+([0-9A-Fa-f]+)#([0-9A-Fa-f]*)"


def read_candump(spark: SparkSession, paths) -> DataFrame:
    """``(ts) iface ID#HEX`` lines; other lines are skipped without a trace."""
    d = read_lines(spark, paths).where(F.col("value").rlike(CANDUMP))
    g = lambda i: F.regexp_extract("value", CANDUMP, i)
    d = d.withColumn("hex", F.upper(g(3)))
    body = X.decode_payload(F.rpad("hex", 16, "0"))["bytes"]
    d = d.select(
        *[c for c in d.columns if c != "value"],
        g(1).cast("double").alias("timestamp"),
        X.hex_to_int(g(2)).cast("int").alias("can_id"),
        F.floor(F.length("hex") / 2).cast("int").alias("dlc"),
        F.rpad("hex", 16, "0").alias("padded"),
        body.alias("_b"),
    )
    return d.select("*", *[F.col("_b")[i].alias(b) for i, b in enumerate(BYTES)]).drop("_b", "hex")


def split_rejects(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that parse, and a quarantine table of those that do not."""
    extra = [c for c in parsed.columns if c in ("source_file", "path")]
    rejects = parsed.where(F.col("error").isNotNull()).select(
        *extra, "line_no", "error", F.rtrim(F.left("value", F.lit(REJECT_PREFIX))).alias("raw_prefix")
    )
    return parsed.where(F.col("error").isNull()).drop("error", "value"), rejects


def with_payload_columns(d: DataFrame) -> DataFrame:
    """Byte columns, clamped dlc and fault flags from ``payload`` and ``raw_dlc``."""
    d = d.withColumn("_b", X.pad_payload("payload"))
    d = d.select("*", *[F.col("_b")[i].alias(b) for i, b in enumerate(BYTES)]).drop("_b")
    return with_dlc_flags(d)


def with_dlc_flags(d: DataFrame) -> DataFrame:
    n = F.size("payload")
    return d.select(
        "*",
        (~F.col("raw_dlc").between(0, 8)).alias("invalid_dlc"),
        (n != F.col("raw_dlc")).alias("payload_len_mismatch"),
        F.least(F.greatest("raw_dlc", F.lit(0)), F.lit(255)).alias("dlc"),
        F.least(n, F.lit(255)).alias("payload_len"),
    )


def map_labels(d: DataFrame, mode: Column, scenario: Column) -> DataFrame:
    """Binary label, attack type, their ids and the weak flag from mode and raw label."""
    per_row = mode == "csv"
    normal = mode == "txt_normal"
    flag = F.col("raw_label")
    binary = (
        F.when(normal | (per_row & (flag == "R")), "Normal")
        .when((mode == "txt_scenario") | (per_row & (flag == "T")), "Attack")
        .otherwise("Unknown")
    )
    d = d.withColumn("binary_label", binary)
    attack = F.when(F.col("binary_label") == "Attack", scenario).otherwise(F.col("binary_label"))
    original = F.when(per_row, flag).when(normal, "scenario_normal").otherwise(F.concat(F.lit("scenario_"), scenario))
    d = d.withColumn("attack_type", attack)
    return d.select(
        *[c for c in d.columns if c != "raw_label"],
        original.alias("original_label"),
        X.binary_label_id("binary_label").alias("binary_label_id"),
        X.attack_type_id("attack_type").alias("attack_type_id"),
        (mode == "txt_scenario").alias("is_weak_label"),
    )


def to_frames(good: DataFrame, dataset: str, mode: Column, scenario: Column) -> DataFrame:
    """The fixed 26-column frame table from parsed rows."""
    d = map_labels(with_payload_columns(good), mode, scenario)
    d = d.withColumn("dataset", F.lit(dataset)).withColumn("label_mode", mode)
    d = with_segments(d.withColumnRenamed("line_no", "row_in_source"))
    return d.select(*[F.col(f.name).cast(f.dataType) for f in FRAME_SCHEMA])


def _named(d: DataFrame) -> DataFrame:
    """Source name: the ``source_file=`` folder of a partitioned tree, else the file name."""
    folder = F.regexp_extract("path", "/source_file=([^/]+)/", 1)
    name = F.when(folder != "", folder).otherwise(F.element_at(F.split("path", "/"), -1))
    return d if "source_file" in d.columns else d.withColumn("source_file", name)


def read_attack_csv(spark, paths, scenario="DoS", dataset="csv") -> tuple[DataFrame, DataFrame]:
    good, bad = split_rejects(read_parsed(spark, paths, parse_attack_csv))
    return to_frames(good, dataset, F.lit("csv"), F.lit(scenario)), bad


def read_tagged_txt(spark, paths, mode="txt_normal", scenario="Normal", dataset="txt") -> tuple[DataFrame, DataFrame]:
    good, bad = split_rejects(read_parsed(spark, paths, parse_tagged_txt))
    return to_frames(good, dataset, F.lit(mode), F.lit(scenario)), bad


def read_hex_csv(spark: SparkSession, paths) -> tuple[DataFrame, DataFrame]:
    """``timestamp,arbitration_id,data_field,attack`` files; dlc is the byte count.

    Returns frames and one row of issue counts per file.
    """
    raw = spark.read.schema(HEX_CSV_SCHEMA).csv(paths, header=True)
    raw = raw.select("*", F.col("_metadata.file_path").alias("path"))
    d = raw.withColumn("_d", X.decode_payload("data_field"))
    frames = d.select(
        *[c for c in raw.columns if c not in ("arbitration_id", "data_field")],
        X.hex_to_int(F.coalesce("arbitration_id", F.lit("0"))).cast("int").alias("can_id"),
        F.col("_d.dlc").alias("dlc"),
        *[F.col("_d.bytes")[i].alias(b) for i, b in enumerate(BYTES)],
    )
    issues = d.groupBy(*[c for c in raw.columns if c not in HEX_CSV_SCHEMA.fieldNames()]).agg(
        F.count_if("_d.odd_length").alias("odd_length_payload"),
        F.count_if("_d.malformed").alias("malformed_payload"),
        F.count_if("_d.too_long").alias("dlc_gt_8"),
    )
    return frames, issues


SPEC_SCHEMA = "path string, source_file string, scenario string, mode string"


def scan_sources(spark: SparkSession, spec: list[tuple], dataset="logs") -> DataFrame:
    """Frames of many files, each with its own label mode.

    ``spec`` rows are (path, source_file, scenario, mode), one per folder or file;
    Spark knows its size and decides how to join it.
    """
    parsers = {"csv": parse_attack_csv, "txt_normal": parse_tagged_txt, "txt_scenario": parse_tagged_txt}
    parts = []
    for mode in sorted({s[3] for s in spec}):
        rows = [s for s in spec if s[3] == mode]
        table = spark.createDataFrame(rows, SPEC_SCHEMA).drop("path")
        parse = lambda lines, mode=mode, table=table: parsers[mode](lines.join(table, "source_file"))
        good, _ = split_rejects(read_parsed(spark, [r[0] for r in rows], parse))
        parts.append(good)
    good = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return to_frames(good, dataset, F.col("mode"), F.col("scenario"))


def with_path_meta(d: DataFrame, vehicles: dict[str, dict[str, str]], path: str = "path") -> DataFrame:
    """Set, subset, stem, vehicle axis, attack axis and vehicle from ``.../set/subset/file``.

    ``vehicles`` maps a set to its known and unknown vehicle: a parameter, so the
    lookup is a literal map and needs no join.
    """
    p = F.split(path, "/")
    d = d.withColumn("set_id", F.element_at(p, -3)).withColumn("subset_id", F.element_at(p, -2))
    sub = F.col("subset_id")
    train = sub == "train_01"
    axis = F.when(train, "train").when(sub.contains("unknown_vehicle"), "unknown_vehicle").otherwise("known_vehicle")
    attack = F.when(train, "train").when(sub.contains("unknown_attack"), "unknown_attack").otherwise("known_attack")
    names = {f"{s}|{k}": v for s, kv in vehicles.items() for k, v in kv.items()}
    d = d.select("*", X.source_stem(path).alias("source_stem"), axis.alias("vehicle_axis"), attack.alias("attack_axis"))
    side = F.when(F.col("vehicle_axis") == "unknown_vehicle", "unknown").otherwise("known")
    return d.withColumn("vehicle", X.lookup(F.concat_ws("|", "set_id", side), names, "unlisted"))


CAPTURE_META = T.MapType(
    T.StringType(),
    T.StructType(
        [
            T.StructField("injection_id", T.StringType()),
            T.StructField("injection_interval", T.ArrayType(T.DoubleType())),
            T.StructField("injection_data_str", T.StringType()),
        ]
    ),
)


def read_capture_meta(spark: SparkSession, paths) -> DataFrame:
    """JSON maps capture -> injection facts, one row per capture.

    Each file is one JSON document or one document per line.
    """
    docs = spark.read.text(paths, wholetext=False).select(F.from_json("value", CAPTURE_META).alias("m"))
    return docs.select(F.explode("m").alias("capture", "meta")).select("capture", "meta.*")


def read_frames(spark: SparkSession, path: str, cols: list[str]) -> DataFrame:
    """Only the named columns are read from storage."""
    return spark.read.parquet(path).select(*cols)


def write_frames(d: DataFrame, path: str) -> None:
    d.select(*[F.col(f.name).cast(f.dataType) for f in FRAME_SCHEMA]).write.option("compression", "zstd").parquet(path)


def write_splits(d: DataFrame, path: str) -> None:
    d.write.partitionBy("split").option("compression", "zstd").parquet(path)


def write_windows(w: DataFrame, path: str) -> None:
    keys = ["split"] if "split" in w.columns else []
    w.write.partitionBy(*keys).option("compression", "zstd").parquet(path)


def read_windows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def union_results(tables: list[DataFrame]) -> DataFrame:
    """One table under the union of all columns; missing cells are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def write_result(tables: list[DataFrame], path: str) -> None:
    union_results(tables).write.option("header", True).csv(path)


def merge_shards(shards: list[DataFrame], key: list[str]) -> DataFrame:
    """Union of result shards; an absent key column, an empty shard or a double cell raises."""
    for i, s in enumerate(shards):
        lost = [k for k in key if k not in s.columns]
        if lost:
            raise ValueError(f"shard {i} lacks key columns {lost}")
    tagged = [s.withColumn("_shard", F.lit(i)) for i, s in enumerate(shards)]
    d = union_results(tagged)
    seen = d.select(F.count_distinct("_shard").alias("n")).scalar()
    cells = d.groupBy(*key).agg(F.count("*").alias("_copies"))
    ok = (
        F.when(seen != len(shards), F.raise_error(F.lit("a shard is empty")).cast("long"))
        .when(F.col("_copies") > 1, F.raise_error(F.lit("a cell occurs twice")).cast("long"))
        .otherwise(F.col("_copies"))
    )
    return d.drop("_shard").join(cells.select(*key, ok.alias("_copies")), key).where("_copies = 1").drop("_copies")


def unit_view(w: DataFrame, meta: DataFrame, unit: str = "source_file") -> DataFrame:
    """Windows with the metadata of their unit, its role and its resampling stratum.

    A unit that holds an attack window is an attack unit.  Roles come from one
    row per unit; the join is left to adaptive execution, which broadcasts that
    side only if its measured size allows it.
    """
    roles = w.groupBy(unit).agg(F.count_if(F.col("y_binary") == 1).alias("_a"))
    roles = roles.select(unit, F.when(F.col("_a") > 0, "attack").otherwise("normal").alias("role"))
    facts = meta.join(roles, unit, "left")
    facts = facts.withColumn("stratum", F.concat_ws("/", "set_id", "subset_id", "role"))
    return w.join(facts, unit)
