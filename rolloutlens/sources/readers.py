"""Sources: problem sets, buffers, run logs (S1, S2, S5, S7), state of a run."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas

ADAPTER_SCHEMAS = {"dapo": schemas.PROBLEMS_DAPO, "xr1": schemas.PROBLEMS_XR1,
                   "aime": schemas.PROBLEMS_AIME, "test": schemas.PROBLEMS_TEST}


def read_problems(spark: SparkSession, path: str, adapter: str = "test", fmt: str = "parquet",
                  schema: T.StructType | None = None) -> DataFrame:
    """A problem set with a declared schema (no inference); column
    names are lower-cased first (S2), as the trainer does with row keys."""
    schema = schema or ADAPTER_SCHEMAS[adapter]
    reader = spark.read.format(fmt)
    if fmt in ("json", "csv"):
        reader = reader.schema(schema)
        if fmt == "csv":
            reader = reader.option("header", "true")
        return lower_columns(reader.load(path))
    df = lower_columns(reader.load(path))
    return df.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])


def lower_columns(df: DataFrame) -> DataFrame:
    """Lower-case every column name; two names that differ only in case
    would collide, so that raises (the trainer silently kept the last)."""
    lowered = [c.lower() for c in df.columns]
    dup = {c for c in lowered if lowered.count(c) > 1}
    if dup:
        raise ValueError(f"columns collide after lower-casing: {sorted(dup)}")
    return df.toDF(*lowered)


def read_buffer(spark: SparkSession, path: str, legacy_array: bool = False) -> DataFrame:
    """Buffer records with the declared schema. JSON lines are
    splittable; ``legacy_array`` reads files that hold one JSON array each,
    cut into byte ranges (:mod:`rolloutlens.sources.json_array`)."""
    if legacy_array:
        from .json_array import read_json_array
        return read_json_array(spark, path, schemas.BUFFER)
    return spark.read.schema(schemas.BUFFER).json(path)


#: Files of a read whose offsets are sent to every task.
MOST_FILES = 1 << 20


def read_positioned(spark: SparkSession, *paths: str, position: str = "row_pos") -> DataFrame:
    """Parquet rows with their dense place (0, 1, 2 ...) in the order of the
    paths as given, of the files by name, and of the rows in a file.

    A row's place is its index in its file, which the reader knows, plus the
    rows of the files before; these are counted from the footers alone. So no
    row is moved or sorted, and a task that runs again gives the same places.
    The offsets are a row per file, of which the driver has listed all."""
    parts = [spark.read.parquet(p) for p in paths]
    place = lambda k, d: (F.lit(k).alias("_chunk"), d["_metadata.file_path"].alias("_file"))
    counts = None
    for k, d in enumerate(parts):
        c = d.select(*place(k, d)).groupBy("_chunk", "_file").agg(F.count(F.lit(1)).alias("_n"))
        counts = c if counts is None else counts.unionByName(c)
    before = Window.orderBy("_chunk", "_file").rowsBetween(Window.unboundedPreceding, -1)  # files, not rows
    offsets = counts.select("_chunk", "_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    if sum(len(d.inputFiles()) for d in parts) <= MOST_FILES:
        offsets = F.broadcast(offsets)
    rows = None
    for k, d in enumerate(parts):
        r = d.select("*", *place(k, d), d["_metadata.row_index"].alias("_row"))
        rows = r if rows is None else rows.unionByName(r)
    return rows.join(offsets, ["_chunk", "_file"]).withColumn(position, F.col("_before") + F.col("_row")) \
        .drop("_chunk", "_file", "_before", "_row")


def read_run_logs(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """Run logs line by line (run, file, block, seq, line).

    Files are split like any text, so no task holds a whole run; (file, block,
    seq) is a line's order in its run: where its split begins, then its place
    in the split. ``run`` is the partition folder value when the logs were
    written with ``partitionBy('run')``, else the file path. ``whole`` reads
    one row per file instead (run, log), for small logs only."""
    df = spark.read.text(path, wholetext=whole)
    file = F.col("_metadata.file_path")
    run = F.col("run").cast("string") if "run" in df.columns else file
    if whole:
        return df.select(run.alias("run"), F.col("value").alias("log"))
    return df.select(run.alias("run"), file.alias("file"), F.col("_metadata.file_block_start").alias("block"),
                     F.monotonically_increasing_id().alias("seq"), F.col("value").alias("line"))


STATE = "start_idx long, next_start long, kept long, shortfall long, cycle long"


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """The state table of a run (R3): a row per finished cycle, none at first."""
    try:
        return spark.read.schema(STATE).parquet(path).drop("since")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], STATE)


def resume_point(spark: SparkSession, path: str, start_idx: int) -> tuple[int, int]:
    """Finished cycles and the index at which the next one starts."""
    row = read_state(spark, path).agg(F.max(F.struct("cycle", "next_start")).alias("s")).first()["s"]
    return (0, start_idx) if row is None else (row["cycle"], row["next_start"])
