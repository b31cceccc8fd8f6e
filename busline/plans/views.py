"""Views that give the star-schema test tables the shapes of message logs.

``Tables`` builds them as DataFrames; ``CTES`` holds the same definitions as
SQL for the side-by-side check.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from busline.operators import ordered as O
from busline.operators import timeline as TL
from busline.operators import windows as WN
from busline.schema import BYTES
from busline.session import scratch_dir

GAP = 6 * 3600.0  # events lie minutes apart, so an episode gap is counted in hours


_STORED: dict[tuple[str, str, str], str] = {}


class Tables:
    """Reads the parquet tables of one folder and derives the views.

    Frames, splits and windows are stage tables: they are written once per
    session to the shared folder and read back by each query, so that a plan
    does not repeat the stages before it.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def stored(self, name: str, build) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.dir, name)
        if key not in _STORED:
            path = scratch_dir(self.spark, name)
            build().write.parquet(path)
            _STORED[key] = path
        return self.spark.read.parquet(_STORED[key])

    @cached_property
    def raw(self) -> DataFrame:
        return self.stored("raw", self._raw)

    def _raw(self) -> DataFrame:
        """Events as messages: source, row in the source, microseconds, id, dlc, payload hex."""
        us = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts)")
        e = F.col("event_id")
        ev = self.read("events").select(
            e,
            "event_type",
            F.concat(F.lit("src_"), (e % 4).cast("string")).alias("source_file"),
            us.alias("us"),
            F.col("user_id").cast("int").alias("can_id"),
            F.when(e % 10 == 0, 2).when(e % 10 == 1, 5).otherwise(8).alias("dlc"),
            F.md5(e.cast("string").cast("binary")).alias("h"),
        )
        return O.ranked(ev, ["source_file"], ["event_id"], O.span_of("event_id"), "row_in_source")

    @cached_property
    def labelled(self) -> DataFrame:
        """``raw`` with byte columns, labels, timestamp, idx and a clock that steps back."""
        r = F.col("row_in_source")
        kind = F.when(
            F.floor((r - 1) / 64) % 4 == 3,
            F.when(F.col("event_type") == "purchase", 1)
            .when(F.col("event_type") == "error", 2)
            .when(F.col("event_type") == "click", 3)
            .when(F.col("event_type") == "signup", 4)
            .otherwise(0),
        ).otherwise(0)
        byte = lambda j: F.when(F.lit(j) < F.col("dlc"), F.conv(F.substring("h", 2 * j + 1, 2), 16, 10).cast("int"))
        d = self.raw.select(
            "*",
            (F.col("us") / 1e6).alias("timestamp"),
            (F.col("us") / 1e6 - F.floor(r / 900) * 2000000.0).alias("clock"),
            kind.alias("attack_type_id"),
            *[F.coalesce(byte(j), F.lit(0)).alias(b) for j, b in enumerate(BYTES)],
            (r - 1).alias("idx"),
        )
        return d.withColumn("binary_label_id", (F.col("attack_type_id") > 0).cast("int"))

    @cached_property
    def frames(self) -> DataFrame:
        return self.stored("frames", lambda: TL.with_delta_t(self.labelled))

    @cached_property
    def split(self) -> DataFrame:
        """Frames with their split and their row index inside (split, source)."""

        def build():
            d = TL.split_frames(self.frames, GAP)
            d = O.ranked(d, ["split", "source_file"], ["row_in_source"], O.span_of("row_in_source"), "_r")
            return d.withColumn("idx", F.col("_r") - 1).drop("_r")

        return self.stored("split", build)

    @cached_property
    def wf(self) -> DataFrame:
        """Frames repeated once per window that holds them."""
        return WN.window_frames(self.frames, ["source_file"])

    @cached_property
    def windows(self) -> DataFrame:
        """Window table with frame arrays, labels and provenance."""
        return self.stored("windows", lambda: WN.count_windows(self.frames, ["source_file"]))

    @cached_property
    def labels_w(self) -> DataFrame:
        return WN.window_labels(self.frames, ["source_file"])

    @cached_property
    def scores(self) -> DataFrame:
        """Line items as scored windows: score with heavy ties, label, seed, unit, setting."""
        return self.read("lineitem").select(
            (F.col("l_discount") * 10).alias("score"),
            (F.col("l_returnflag") == "R").cast("int").alias("y"),
            F.col("l_linenumber").cast("int").alias("seed"),
            F.col("l_suppkey").alias("unit"),
            F.col("l_linestatus").alias("setting"),
            F.col("l_returnflag").alias("family"),
            F.col("l_quantity").alias("quantity"),
            F.col("l_partkey").alias("part"),
            F.col("l_orderkey").alias("order_id"),
            F.col("l_tax").alias("tax"),
            F.col("l_extendedprice").alias("price"),
            F.col("l_shipdate").alias("shipped"),
        )

    @cached_property
    def factorial(self) -> DataFrame:
        """Counts per (construction, pipeline, block, attack, arm, P, S, D)."""
        p = F.col("l_partkey")
        arm = F.when(F.col("l_returnflag") == "N", "real").when(F.col("l_returnflag") == "A", "placebo").otherwise("rule")
        return (
            self.read("lineitem")
            .select(
                (F.col("l_suppkey") % 5).alias("construction"),
                (F.col("l_linenumber") % 5).cast("long").alias("seed"),
                (p % 3).alias("block"),
                F.when(F.col("l_linestatus") == "O", "gear").otherwise("rpm").alias("attack"),
                arm.alias("arm"),
                F.floor(p / 4 % 2).cast("int").alias("p"),
                F.floor(p / 2 % 2).cast("int").alias("s"),
                (p % 2).cast("int").alias("d"),
                (F.col("l_quantity") >= 25).cast("int").alias("hit"),
            )
            .groupBy("construction", "seed", "block", "attack", "arm", "p", "s", "d")
            .agg(F.sum("hit").alias("hits"), F.count("*").alias("n"))
        )


_BYTES_SQL = ",\n".join(
    f"CASE WHEN {j} < dlc THEN ('0x' || substr(h, {2 * j + 1}, 2))::INT ELSE 0 END AS data{j}" for j in range(8)
)

CTES: dict[str, str] = {
    "raw": """
SELECT event_id, event_type, 'src_' || (event_id % 4) AS source_file,
       epoch_us(ts) - 1704067200000000 AS us, user_id::INT AS can_id,
       CASE event_id % 10 WHEN 0 THEN 2 WHEN 1 THEN 5 ELSE 8 END AS dlc,
       md5(event_id::VARCHAR) AS h,
       row_number() OVER (PARTITION BY event_id % 4 ORDER BY event_id) AS row_in_source
FROM events""",
    "lab": f"""
SELECT *, (attack_type_id > 0)::INT AS binary_label_id FROM (
SELECT *, us / 1e6 AS timestamp, us / 1e6 - (row_in_source // 900) * 2000000.0::DOUBLE AS clock, row_in_source - 1 AS idx,
       CASE WHEN ((row_in_source - 1) // 64) % 4 = 3 THEN
            CASE event_type WHEN 'purchase' THEN 1 WHEN 'error' THEN 2 WHEN 'click' THEN 3 WHEN 'signup' THEN 4 ELSE 0 END
            ELSE 0 END AS attack_type_id,
       {_BYTES_SQL}
FROM raw)""",
    "fr": """
SELECT *, coalesce(greatest(timestamp - lag(timestamp) OVER (PARTITION BY source_file ORDER BY idx), 0), 0) AS delta_t,
       count(*) OVER (PARTITION BY source_file) AS n_src
FROM lab""",
    "wf": """
SELECT *, w * 32 AS start_index, idx - w * 32 AS pos FROM (
SELECT *, unnest(generate_series(greatest(0, CAST(ceil((idx - 127) / 32.0) AS BIGINT)), least(idx // 32, (n_src - 128) // 32))) AS w
FROM fr)""",
    "wl": """
SELECT source_file, start_index, max(binary_label_id) AS y_binary,
       CASE WHEN max(binary_label_id) = 1 THEN
         (list_sort(list_distinct(list(attack_type_id) FILTER (attack_type_id > 0))))[
           list_position(
             list_transform(list_sort(list_distinct(list(attack_type_id) FILTER (attack_type_id > 0))),
               lambda c: CASE c WHEN 1 THEN count(*) FILTER (attack_type_id = 1) WHEN 2 THEN count(*) FILTER (attack_type_id = 2)
                         WHEN 3 THEN count(*) FILTER (attack_type_id = 3) ELSE count(*) FILTER (attack_type_id = 4) END),
             greatest(count(*) FILTER (attack_type_id = 1), count(*) FILTER (attack_type_id = 2),
                      count(*) FILTER (attack_type_id = 3), count(*) FILTER (attack_type_id = 4)))]
       ELSE 0 END AS y_attack_type
FROM wf GROUP BY source_file, start_index""",
    "sc": """
SELECT l_discount * 10 AS score, (l_returnflag = 'R')::INT AS y, l_linenumber AS seed, l_suppkey AS unit,
       l_linestatus AS setting, l_returnflag AS family, l_quantity AS quantity, l_partkey AS part,
       l_orderkey AS order_id, l_tax AS tax, l_extendedprice AS price, l_shipdate AS shipped
FROM lineitem""",
    "fac": """
SELECT l_suppkey % 5 AS construction, (l_linenumber % 5)::BIGINT AS seed, l_partkey % 3 AS block,
       CASE l_linestatus WHEN 'O' THEN 'gear' ELSE 'rpm' END AS attack,
       CASE l_returnflag WHEN 'N' THEN 'real' WHEN 'A' THEN 'placebo' ELSE 'rule' END AS arm,
       (l_partkey // 4 % 2)::INT AS p, (l_partkey // 2 % 2)::INT AS s, (l_partkey % 2)::INT AS d,
       sum((l_quantity >= 25)::INT)::BIGINT AS hits, count(*) AS n
FROM lineitem GROUP BY ALL""",
}
