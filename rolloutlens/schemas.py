"""Declared schemas of the rollout data model (no inference on read)."""

from pyspark.sql import types as T

MESSAGE = T.StructType([
    T.StructField("role", T.StringType()),
    T.StructField("content", T.StringType()),
])
MESSAGES = T.ArrayType(MESSAGE)

PROBLEMS_DAPO = T.StructType([
    T.StructField("prompt", MESSAGES),
    T.StructField("reward_model", T.StructType([T.StructField("ground_truth", T.StringType())])),
])
PROBLEMS_XR1 = T.StructType([
    T.StructField("problem", T.StringType()),
    T.StructField("solution", T.StringType()),
])
PROBLEMS_AIME = T.StructType([
    T.StructField("question", T.StringType()),
    T.StructField("answer", T.StringType()),
])
PROBLEMS_TEST = T.StructType([
    T.StructField("problem", T.StringType()),
    T.StructField("answer", T.StringType()),
])

ROLLOUTS = T.StructType([
    T.StructField("prompt_idx", T.LongType(), False),
    T.StructField("gen_idx", T.IntegerType(), False),
    T.StructField("gold", T.StringType()),
    T.StructField("content", T.StringType()),
])

BUFFER = T.StructType([
    T.StructField("prompt_idx", T.LongType()),
    T.StructField("gen_idx", T.IntegerType()),
    T.StructField("completion", MESSAGES),
    T.StructField("advantage", T.DoubleType()),
    T.StructField("reward", T.DoubleType()),
    T.StructField("label", T.StringType()),
])

SEQUENCES = T.StructType([
    T.StructField("seq_id", T.LongType(), False),
    T.StructField("input_ids", T.ArrayType(T.IntegerType())),
    T.StructField("logp", T.ArrayType(T.DoubleType())),
    T.StructField("old_logp", T.ArrayType(T.DoubleType())),
    T.StructField("ref_logp", T.ArrayType(T.DoubleType())),
    T.StructField("advantage", T.DoubleType()),
])

CODE_CASES = T.StructType([
    T.StructField("completion_id", T.LongType()),
    T.StructField("case_id", T.LongType()),
    T.StructField("returncode", T.IntegerType()),
    T.StructField("stdout", T.StringType()),
    T.StructField("expected", T.StringType()),
])

METRICS = T.StructType([
    T.StructField("run", T.StringType()),
    T.StructField("phase", T.StringType()),
    T.StructField("step", T.LongType()),
    T.StructField("metric", T.StringType()),
    T.StructField("value", T.DoubleType()),
])
