"""Declared shapes: nothing is inferred."""

from pyspark.sql import types as T

DIM, K = 14, 5

PAYLOAD = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("transaction", T.StructType([T.StructField("amount", T.DoubleType()), T.StructField("installments", T.LongType()), T.StructField("requested_at", T.StringType())])),
    T.StructField("customer", T.StructType([T.StructField("avg_amount", T.DoubleType()), T.StructField("tx_count_24h", T.LongType()), T.StructField("known_merchants", T.ArrayType(T.StringType()))])),
    T.StructField("merchant", T.StructType([T.StructField("id", T.StringType()), T.StructField("mcc", T.StringType()), T.StructField("avg_amount", T.DoubleType())])),
    T.StructField("terminal", T.StructType([T.StructField("is_online", T.BooleanType()), T.StructField("card_present", T.BooleanType()), T.StructField("km_from_home", T.DoubleType())])),
    T.StructField("last_transaction", T.StructType([T.StructField("timestamp", T.StringType()), T.StructField("km_from_current", T.DoubleType())])),
])
REFERENCE = T.StructType([T.StructField("vector", T.ArrayType(T.DoubleType())), T.StructField("label", T.StringType())])
ENTRIES = T.StructType([T.StructField("entries", T.ArrayType(T.StructType([T.StructField("request", T.VariantType()), T.StructField("expected_approved", T.VariantType())])))])
VERDICT = T.StructType([T.StructField("approved", T.BooleanType()), T.StructField("fraud_score", T.DoubleType())])
