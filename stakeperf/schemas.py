"""Explicit schemas of the pipeline's inputs (no schema inference)."""

from pyspark.sql.types import (ArrayType, BooleanType, DoubleType, LongType, StringType, StructField,
                               StructType, DateType, IntegerType)

SCORE = StructType([
    StructField("date", StringType()),
    StructField("day", IntegerType()),
    StructField("displayName", StringType()),
    StructField("payoutPending", DoubleType()),
    StructField("payoutSettled", DoubleType()),
    StructField("percentile", DoubleType()),
    StructField("value", DoubleType()),
])

# One round record of the nested response.
ROUND_RECORD = StructType([
    StructField("model_name", StringType()),
    StructField("roundNumber", LongType()),
    StructField("atRisk", DoubleType()),
    StructField("intraRoundSubmissionScores", ArrayType(SCORE)),
])

# One stored response document per model: the round records sit in a list
# under data.v2RoundModelPerformances (only the fields the analysis uses).
RESPONSE_RECORD = StructType([f for f in ROUND_RECORD.fields if f.name != "model_name"])
RESPONSE = StructType([
    StructField("data", StructType([
        StructField("v2RoundModelPerformances", ArrayType(RESPONSE_RECORD)),
    ])),
])

# Per-model score file, as written by the ingest (``model_name`` comes from
# the directory name when the files are partitioned by model).
STAKED_SCORES = StructType([
    StructField("roundNumber", LongType()),
    StructField("seq", LongType()),
    StructField("displayName", StringType()),
    StructField("date", StringType()),
    StructField("day", StringType()),
    StructField("payoutPending", DoubleType()),
    StructField("atRisk", DoubleType()),
])

ASSET_CONFIG = StructType([
    StructField("symbol", StringType()),
    StructField("category", StringType()),
    StructField("active", BooleanType()),
    StructField("priority", DoubleType()),
])

PRICES = StructType([
    StructField("date", DateType()),
    StructField("symbol", StringType()),
    StructField("price", DoubleType()),
])

CASH = StructType([
    StructField("date", DateType()),
    StructField("Principal", DoubleType()),
    StructField("Interest", DoubleType()),
    StructField("Adjustments", DoubleType()),
])
