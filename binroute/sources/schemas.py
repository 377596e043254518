"""Explicit schemas; nothing is inferred at read time."""

from __future__ import annotations

from pyspark.sql import types as T


def _fields(*columns: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns])


S, L, I, D = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType()

TRANSACTIONS = _fields(
    ("txid", L),
    ("processor_name", S),
    ("status", S),
    ("error_description", S),
    ("created_datetime", T.TimestampNTZType()),
    ("created_date", T.DateType()),
)
CUSTOMERS = _fields(("txid", L), ("card_no", S))
ERROR_BLACKLIST = _fields(("error_description", S))

CATEGORICAL = ("merchant", "card_type", "status", "is_3d", "currency", "processor_name", "project_name")
TRAINING = _fields(("bin", L), *((name, S) for name in CATEGORICAL))

DICTIONARY = _fields(("column_name", S), ("category", S), ("code", I))

FEATURES = (
    "bin",
    "bin_prefix",
    "bin_suffix",
    "is_3d_encoded",
    "bin_tx_count",
    "bin_success_rate",
    "processor_success_rate",
    "bin_processor_tx_count",
    "bin_processor_success_count",
    "bin_processor_success_rate",
)
