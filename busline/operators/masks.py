"""Replacement of window channels by constants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from busline.schema import CHANNELS


def mask_channels(w: DataFrame, constants: dict[str, Column], frames: str = "frames") -> DataFrame:
    """Set the named channels of every frame to the given columns."""

    def change(f):
        for name, value in constants.items():
            f = f.withField(name, value.cast("double"))
        return f

    return w.withColumn(frames, F.transform(frames, change))


def keep_channels(w: DataFrame, keep: list[str], constants: dict[str, Column], frames: str = "frames") -> DataFrame:
    """Mask every channel outside ``keep``."""
    return mask_channels(w, {c: constants[c] for c in CHANNELS if c not in keep}, frames)


def mask_constants(frames: DataFrame, windows: DataFrame) -> DataFrame:
    """Mean id over normal frames, and channel means over normal windows (overlaps count)."""
    mean_id = frames.where("binary_label_id = 0").select(F.avg("can_id").alias("m")).scalar()
    f = windows.where("y_binary = 0").select(F.explode("frames").alias("f"))
    means = f.agg(*[F.avg(f"f.{c}").alias(c) for c in CHANNELS])
    return means.withColumn("frame_can_id", mean_id)
