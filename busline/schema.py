"""Column lists, schemas and default parameters shared by all operators."""

from __future__ import annotations

from pyspark.sql import types as T

# Columns, defaults and schemas of the frame format.
BYTES = [f"data{i}" for i in range(8)]
CHANNELS = ["can_id", "dlc", *BYTES, "delta_t"]

# Label names and their ids.
ATTACK_TYPES = {"Normal": 0, "DoS": 1, "Fuzzy": 2, "Gear": 3, "RPM": 4, "Impersonation": 5, "Unknown": -1}
BINARY_LABELS = {"Normal": 0, "Attack": 1, "Unknown": -1}

WINDOW = 128
STRIDE = 32
EPISODE_GAP = 1.0
SPLIT_RATIOS = (0.6, 0.2)
MAX_ID = 2047

# Rows of one source that a single task orders; longer sources are cut into
# spans of this many order units and stitched together by span totals.
SPAN = 1 << 16

# Columns of the frame table, in order.
FRAME_SCHEMA = T.StructType(
    [
        T.StructField("dataset", T.StringType()),
        T.StructField("source_file", T.StringType()),
        T.StructField("label_mode", T.StringType()),
        T.StructField("timestamp", T.DoubleType()),
        T.StructField("can_id", T.IntegerType()),
        T.StructField("dlc", T.ShortType()),
        *[T.StructField(b, T.ShortType()) for b in BYTES],
        T.StructField("payload_len", T.ShortType()),
        T.StructField("payload_len_mismatch", T.BooleanType()),
        T.StructField("invalid_dlc", T.BooleanType()),
        T.StructField("binary_label", T.StringType()),
        T.StructField("binary_label_id", T.ByteType()),
        T.StructField("attack_type", T.StringType()),
        T.StructField("attack_type_id", T.ByteType()),
        T.StructField("original_label", T.StringType()),
        T.StructField("is_weak_label", T.BooleanType()),
        T.StructField("segment_id", T.IntegerType()),
        T.StructField("row_in_source", T.LongType()),
        T.StructField("row_in_segment", T.LongType()),
    ]
)

HEX_CSV_SCHEMA = T.StructType(
    [
        T.StructField("timestamp", T.DoubleType()),
        T.StructField("arbitration_id", T.StringType()),
        T.StructField("data_field", T.StringType()),
        T.StructField("attack", T.ByteType()),
    ]
)
