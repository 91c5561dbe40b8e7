"""JSON array files read in many tasks (S5, buffers written as one array).

A file is cut into byte ranges. Whether a range begins inside a string, and
how deep, depends on all bytes before it, so two passes are made. The first
takes from every range what does not depend on that: its number of quotes, and
the change of depth both for a range that begins outside a string and for one
that begins inside. Prefix sums over these few numbers give every range its
true beginning. In the second pass a range hands out the elements whose
border (the array's bracket or a comma at depth one) lies in it, and reads on
behind its end until the last of them is complete. This holds for any JSON:
commas, brackets and quotes in strings, escapes, nested arrays, any white
space. Python cuts the texts; Spark's own reader parses them.

Files are opened where the task runs, through the file system of their path
(a local or mounted folder, or whatever pyarrow can open).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

RANGE_BYTES = 32 << 20
#: Read at once behind a range's end, and before its beginning.
AHEAD = 1 << 16
MOST_TASKS = 1 << 16

QUOTE, ESCAPE, COMMA = ord('"'), ord("\\"), ord(",")
STEP = np.zeros(256, np.int8)
STEP[[ord("["), ord("{")]] = 1
STEP[[ord("]"), ord("}")]] = -1
STRUCTURAL = STEP != 0
STRUCTURAL[COMMA] = True


class Bytes:
    """A file read by ranges."""

    def __init__(self, path: str):
        system, name = fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] and not path.startswith("file:") else \
            (fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/"))
        self.file = system.open_input_file(name)

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.file.close()

    def read(self, start: int, size: int) -> np.ndarray:
        return np.frombuffer(self.file.read_at(size, start), np.uint8)

    def escapes_before(self, start: int) -> int:
        """Length of the row of backslashes that ends before ``start``."""
        run = 0
        while start > 0:
            size = min(AHEAD, start)
            b = self.read(start - size, size)
            other = np.flatnonzero(b != ESCAPE)
            if len(other):
                return run + size - 1 - int(other[-1])
            run, start = run + size, start - size
        return run


def quotes(b: np.ndarray, escapes: int) -> np.ndarray:
    """Places of the quotes that no backslash escapes, ``escapes`` of them before the first byte."""
    q = np.flatnonzero(b == QUOTE)
    behind = q[np.where(q > 0, b[q - 1] == ESCAPE, escapes > 0)]
    if not len(behind):
        return q
    other = np.flatnonzero(b != ESCAPE)
    at = np.searchsorted(other, behind) - 1
    run = np.where(at >= 0, behind - 1 - other[at], behind + escapes)
    return np.setdiff1d(q, behind[run % 2 == 1], assume_unique=True)


def structure(b: np.ndarray, escapes: int, inside: bool) -> tuple[np.ndarray, bool]:
    """Places of brackets and commas outside strings, and whether a string is open at the end."""
    q, s = quotes(b, escapes), np.flatnonzero(STRUCTURAL[b])
    return s[(np.searchsorted(q, s) + inside) % 2 == 0], bool((len(q) + inside) % 2)


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for file, start, end in zip(*(batch.column(c).to_pylist() for c in ("file", "start", "end"))):
            with Bytes(file) as f:
                b, escapes = f.read(start, end - start), f.escapes_before(start)
            deeper = [int(STEP[b[structure(b, escapes, inside)[0]]].sum(dtype=np.int64)) for inside in (False, True)]
            out.append((file, start, end, len(quotes(b, escapes)) % 2, *deeper))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.string(), *[pa.int64()] * 5])] if out else
                                         [pa.array([], t) for t in [pa.string(), *[pa.int64()] * 5]],
                                         ["file", "start", "end", "odd", "outside", "inside"])


def _elements(f: Bytes, start: int, end: int, inside: bool, depth: int) -> Iterator[tuple[int, str]]:
    """(place of its border, text) of the elements whose border lies in the range."""
    b, escapes = f.read(start, end - start), f.escapes_before(start)
    opened, parts = None, []  # the border of the element at hand, its bytes so far
    while len(b):
        s, inside = structure(b, escapes, inside)
        level = depth + np.cumsum(STEP[b[s]], dtype=np.int64)
        step = STEP[b[s]]
        border = s[((step == 0) & (level == 1)) | ((step == 1) & (level == 1)) | ((step == -1) & (level == 0))]
        closing = b[border] == ord("]")
        last = 0
        for at, close in zip(border.tolist(), closing.tolist()):
            if opened is not None:
                text = b"".join([*parts, b[last:at].tobytes()]).decode("utf-8", "replace").strip(" \t\r\n﻿")
                if text:
                    yield opened, text
                parts = []
            if start + at >= end:
                return
            opened, last = (None, at + 1) if close else (start + at, at + 1)
        if opened is not None:
            parts.append(b[last:].tobytes())
        elif start + len(b) >= end:
            return
        depth = int(level[-1]) if len(level) else depth
        escapes = _escapes_at_end(b, escapes)
        start += len(b)
        b = f.read(start, AHEAD)


def _escapes_at_end(b: np.ndarray, escapes: int) -> int:
    other = np.flatnonzero(b != ESCAPE)
    return len(b) - 1 - int(other[-1]) if len(other) else escapes + len(b)


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["file", "offset", "value"]
    for batch in batches:
        for r in batch.to_pylist():
            at, texts, size = [], [], 0
            with Bytes(r["file"]) as f:
                for place, text in _elements(f, r["start"], r["end"], r["in_string"], r["depth"]):
                    at.append(place)
                    texts.append(text)
                    size += len(text)
                    if size > AHEAD * 16:
                        yield pa.RecordBatch.from_arrays([pa.array([r["file"]] * len(at)), pa.array(at, pa.int64()), pa.array(texts)], names)
                        at, texts, size = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array([r["file"]] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(texts, pa.string())], names)


def array_elements(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """file, offset, value: the text of every element of the JSON arrays in the
    files, by the place of its border. An empty file or array has none; arrays
    one behind the other are read as one."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "length").where("length > 0")  # sizes only
    start = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long"))).alias("start")
    ranges = files.select("file", "length", start).select("file", "start", F.least(F.col("length"), F.col("start") + range_bytes).alias("end"))
    tasks = min(max(1, ranges.count()), MOST_TASKS)  # a few bytes a row, so Spark would put all into one
    ranges = ranges.repartition(tasks)
    found = ranges.mapInArrow(_summaries, "file string, start long, end long, odd long, outside long, inside long")
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    d = found.withColumn("in_string", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1)
    d = d.withColumn("_deeper", F.when(F.col("in_string"), F.col("inside")).otherwise(F.col("outside")))
    d = d.withColumn("depth", F.coalesce(F.sum("_deeper").over(before), F.lit(0)))
    d = d.select("file", "start", "end", "in_string", "depth").repartition(tasks)
    return d.mapInArrow(_records, "file string, offset long, value string")


def read_json_array(spark: SparkSession, path: str, schema: T.StructType, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The elements as rows of ``schema``."""
    d = array_elements(spark, path, range_bytes)
    return d.select(F.from_json("value", schema).alias("r")).select("r.*")
