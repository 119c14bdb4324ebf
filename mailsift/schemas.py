"""Declared schemas of the tables that pass between jobs."""

from pyspark.sql import types as T

# The four contract columns of a cleaned mail table.
CONTRACT = ("subject", "body", "label", "dataset")

CLEAN_MAIL = T.StructType(
    [
        T.StructField("subject", T.StringType()),
        T.StructField("body", T.StringType()),
        T.StructField("label", T.IntegerType()),
        T.StructField("dataset", T.IntegerType()),
    ]
)

PREDICTION = T.StructType(
    [
        T.StructField("index", T.LongType()),
        T.StructField("dataset", T.IntegerType()),
        T.StructField("subject", T.StringType()),
        T.StructField("label", T.IntegerType()),
        T.StructField("expected", T.StringType()),
        T.StructField("raw_prediction", T.StringType()),
        T.StructField("predicted_label", T.IntegerType()),
        T.StructField("correct", T.BooleanType()),
    ]
)

TOOL_CALL = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("arguments", T.StringType()),
    ]
)

CHAT_MESSAGE = T.StructType(
    [
        T.StructField("role", T.StringType()),
        T.StructField("content", T.StringType()),
    ]
)

TOOL_MESSAGE = T.StructType(
    CHAT_MESSAGE.fields + [T.StructField("tool_calls", T.ArrayType(TOOL_CALL))]
)

# Source ids of the `dataset` column.
SOURCES = {
    1: "legitimate corpus",
    2: "phishing corpus",
    3: "generated BEC",
    4: "adversarial BEC",
}
