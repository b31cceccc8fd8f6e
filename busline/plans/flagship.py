"""Which windows hold an id never seen in normal training traffic, and how good is that as a detector?"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from busline.operators import detect as DE
from busline.operators import metrics as ME
from busline.operators import windows as WN
from busline.plans.views import Tables


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    d = t.split
    by = ["split", "source_file"]
    flags = DE.detect_whitelist(d, DE.normal_ids(d.where("split = 'train'")), by)
    truth = WN.window_labels(d, by).withColumnRenamed("y_binary", "y")
    scored = flags.join(truth, [*by, "start_index"])
    m = ME.binary_metrics(ME.confusion(scored, ["split"]))
    rates = ["accuracy", "macro_f1", "attack_recall", "normal_recall", "fpr"]
    return m.select("split", "tn", "fp", "fn", "tp", *[F.round(c, 6).alias(c) for c in rates])
