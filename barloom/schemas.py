"""The library's record types. Schemas are always given, never inferred."""

from pyspark.sql import types as T

BARS = T.StructType([T.StructField("symbol", T.StringType()), T.StructField("ts", T.TimestampType()), *(T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume"))])
QUOTES = T.StructType([T.StructField("symbol", T.StringType()), T.StructField("ts", T.TimestampType()), *(T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "change", "volume", "bid", "ask"))])
ACTIONS = T.StructType([T.StructField("symbol", T.StringType()), T.StructField("ts", T.TimestampType()), T.StructField("factor", T.DoubleType()), T.StructField("kind", T.StringType()), T.StructField("price_ratio", T.DoubleType())])
PREDICTIONS = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("symbol", T.StringType()), T.StructField("ts", T.TimestampType()), T.StructField("horizon", T.IntegerType()),
    *(T.StructField(c, T.DoubleType()) for c in ("anchor_price", "expected_return", "expected_price", "lower", "upper")),
    T.StructField("expiry", T.TimestampType()), T.StructField("status", T.StringType()), T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
])
