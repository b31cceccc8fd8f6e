"""Column functions for hex text, payloads, labels and names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from busline.schema import ATTACK_TYPES, BINARY_LABELS


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hex_to_int(c) -> Column:
    """Hex text to long, NULL when it is not hex (``conv`` alone would accept '4z')."""
    t = F.trim(_col(c))
    return F.when(t.rlike("^(0[xX])?[0-9A-Fa-f]{1,15}$"), F.conv(F.regexp_replace(t, "^0[xX]", ""), 16, 10).cast("long"))


def hex_byte(c) -> Column:
    """Hex text to 0..255, NULL outside."""
    v = hex_to_int(c)
    return F.when(v.between(0, 255), v.cast("int"))


def pad_payload(arr) -> Column:
    """First eight bytes, zero-padded on the right."""
    return F.slice(F.concat(_col(arr), F.array_repeat(F.lit(0), 8)), 1, 8)


def _bytes_of(text: Column) -> Column:
    """Bytes of an even-length hex string (empty array for '')."""
    n = (F.length(text) / 2).cast("int")
    idx = F.when(n > 0, F.sequence(F.lit(1), F.greatest(n, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.transform(idx, lambda i: F.conv(F.substr(text, i * 2 - 1, F.lit(2)), 16, 10).cast("int"))


def decode_payload(c) -> Column:
    """Hex payload to (dlc, eight bytes, issue flags); a dangling nibble is dropped."""
    raw = F.trim(F.coalesce(_col(c), F.lit("")))
    odd = F.length(raw) % 2 == 1
    even = F.when(odd, F.substr(raw, F.lit(1), F.length(raw) - 1)).otherwise(raw)
    bad = ~even.rlike("^[0-9A-Fa-f]*$")
    clean = F.when(bad, F.lit("")).otherwise(even)
    n = (F.length(clean) / 2).cast("int")
    return F.struct(
        F.least(n, F.lit(255)).alias("dlc"),
        pad_payload(_bytes_of(clean)).alias("bytes"),
        odd.alias("odd_length"),
        bad.alias("malformed"),
        (n > 8).alias("too_long"),
    )


def payload_matches(c, pattern) -> Column:
    """16-nibble payload against a pattern in which X stands for any nibble."""
    return F.rlike(_col(c), F.concat(F.lit("^"), F.regexp_replace(F.upper(_col(pattern)), "X", "."), F.lit("$")))


# Capture name prefixes that name their own family, in match order.
CAPTURE_FAMILIES = [
    "correlated_signal",
    "fuzzing",
    "max_speedometer",
    "reverse_light_off",
    "reverse_light_on",
    "max_engine_coolant_temp",
    "accelerator",
    "ambient",
]


def capture_family(c, families=None) -> Column:
    """First family whose name starts the capture name, else 'other'."""
    name = _col(c)
    tests = [F.when(name.startswith(f), F.lit(f)) for f in (families or CAPTURE_FAMILIES)]
    return F.coalesce(*tests, F.lit("other"))


def is_masquerade(c) -> Column:
    return _col(c).endswith("_masquerade")


# Labelled upper edges in seconds of the delta-time bins.
DT_BINS = [
    (1e-4, "<0.1ms"),
    (5e-4, "0.1-0.5ms"),
    (1e-3, "0.5-1ms"),
    (5e-3, "1-5ms"),
    (1e-2, "5-10ms"),
    (5e-2, "10-50ms"),
    (1e-1, "50-100ms"),
]
DT_LABELS = ["neg", "0", *[label for _, label in DT_BINS], ">=100ms"]


def dt_bin(c, scale: float = 1.0) -> Column:
    """Label of the delta-time bin; ``scale`` multiplies the edges."""
    v = _col(c)
    start = F.when(v < 0, "neg").when(v == 0, "0")
    return reduce(lambda acc, e: acc.when(v < e[0] * scale, e[1]), DT_BINS, start).otherwise(">=100ms")


def source_stem(path) -> Column:
    """File name without folder, extension and trailing run number."""
    name = F.element_at(F.split(_col(path), "/"), -1)
    return F.regexp_replace(F.regexp_replace(name, r"\.[^.]*$", ""), r"-\d+$", "")


def lookup(c, values: dict, default) -> Column:
    pairs = [F.lit(x) for kv in values.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), _col(c)), F.lit(default))


def attack_type_id(c) -> Column:
    return lookup(c, ATTACK_TYPES, -1)


def binary_label_id(c) -> Column:
    return lookup(c, BINARY_LABELS, -1)
