"""Delimited numeric text: dense labelled rows (S1), one-vector-per-line by index.

S1  ``label,a_1,...,a_n`` per line  ->  ``[label: double, features: array<double>]``
S2/S3  one value (or one delimited vector) per line, where the *line number* is the key
        ->  ``[feat_id: long, value | features]``.  Line order only exists in the files: lines are
        numbered by file name, place of the split in its file, and place in the split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship_package

#: values that are put together in one text line of a column; a longer column goes on in the next line
LINE_PIECE = 1 << 14
#: ends a line that goes on in the next one
GOES_ON = "\\"


def parse_dense(lines: DataFrame, value: str = "value", sep: str = ",", strict: bool = True,
                n: int | None = None) -> DataFrame:
    """Split each line; first token is the label, the rest the features.

    ``strict``: a non-numeric token raises at execution (ANSI cast); otherwise it becomes null
    and the row is reported by :func:`rejects`.
    """
    toks = F.split(F.trim(F.col(value)), sep)
    if strict:
        def conv(t):
            return F.trim(t).cast("double")
    else:
        def conv(t):
            return F.trim(t).try_cast("double")
    keep = [c for c in lines.columns if c != value]
    if n is not None:
        # known width: unrolled casts (codegen); a line of another width is an error when strict
        t = lines.select(*keep, toks.alias("_t"))
        width_ok = F.size("_t") == n + 1
        feats = F.array(*[conv(F.col("_t")[j + 1]) for j in range(n)])
        if strict:
            feats = F.when(width_ok, feats).otherwise(
                F.raise_error(F.lit(f"line does not have {n + 1} fields")))
        return t.select(*keep, conv(F.col("_t")[0]).alias("label"), feats.alias("features"))
    arr = F.transform(toks, conv)
    return lines.select(*keep, F.element_at(arr, 1).alias("label"),
                        F.slice(arr, 2, F.size(arr) - 1).alias("features"))


def rejects(parsed: DataFrame) -> DataFrame:
    """Rows of a non-strict parse that hold a null label or feature."""
    return parsed.filter(F.col("label").isNull() | F.exists("features", lambda v: v.isNull()))


def read_dense_text(spark: SparkSession, path: str, sep: str = ",", min_partitions: int | None = None,
                    strict: bool = True) -> DataFrame:
    lines = spark.read.text(path)
    if min_partitions and lines.rdd.getNumPartitions() < min_partitions:
        lines = lines.repartition(min_partitions)
    return parse_dense(lines, sep=sep, strict=strict)


def read_indexed_lines(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """``[feat_id, features]`` with feat_id = 0-based line number over the files in name order."""
    return numbered_lines(spark, path).select("feat_id", F.transform(F.split(F.trim("value"), sep),
                                                                     lambda t: F.trim(t).cast("double")).alias("features"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``[feat_id, value]``: lines numbered over all files in name order.

    Spark deals splits to tasks by size, so neither partition order nor ``zipWithIndex`` follows the
    files.  One pass counts the lines of every split; the running sum over the splits (one row per
    split, not per line) is joined back, and the place within the split is added.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"),
                                         F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_id"))
    splits = lines.groupBy("_file", "_at").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = Window.orderBy("_file", "_at").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select("_file", "_at", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return lines.join(offsets, ["_file", "_at"]).select((F.col("_before") + F.col("_id") - F.col("_first")).alias("feat_id"), "value")


def read_vector_lines(spark: SparkSession, path: str) -> DataFrame:
    """S3: one scalar per line -> ``[feat_id, value]`` ordered by line number."""
    return read_indexed_lines(spark, path).select("feat_id", F.col("features")[0].alias("value"))


def to_dense_lines(df: DataFrame, label: str = "label", features: str = "features", sep: str = ",",
                   n: int | None = None) -> DataFrame:
    """Inverse of :func:`parse_dense` (Java shortest round-trip double text)."""
    keep = [c for c in df.columns if c not in (label, features)]
    if n is not None:
        parts = [F.col(label).cast("double").cast("string")] + [F.col(features)[j].cast("string")
                                                                 for j in range(n)]
        return df.select(*keep, F.concat_ws(sep, *parts).alias("value"))
    arr = F.concat(F.array(F.col(label).cast("double")), F.col(features))
    return df.select(*keep, F.array_join(F.transform(arr, lambda v: v.cast("string")), sep).alias("value"))


def read_column_pieces(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """A matrix with one column per line -> pieces of its lines, ``[feat_id, start, features]``.

    The line number is the column, ``start`` the place of a piece's first value in its line.  A line that ends with
    ``GOES_ON`` in place of a separator goes on in the next one, also in the next file, and has no number of its own; so
    no task holds a long column.  Two passes, as in :func:`numbered_lines`: one row per split says how many
    lines end in it and how many values follow the last end.
    """
    ship_package(spark)
    goes_on = F.col("value").endswith(GOES_ON)
    bare = F.when(goes_on, F.regexp_replace("value", r"\\$", "")).otherwise(F.col("value"))
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_at"),
                                         goes_on.alias("_on"), F.split(F.trim(bare), sep).alias("_t"))

    def places(batches: Iterator[pa.RecordBatch], sums: bool) -> Iterator[pa.RecordBatch]:
        # a task may read several splits, one after the other
        split, ends, held = None, 0, 0
        for b in batches:
            at, start = np.empty(b.num_rows, np.int64), np.empty(b.num_rows, np.int64)
            rows = zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)
            for i, (file, block, on, k) in enumerate(rows):
                if (file, block) != split:
                    if sums and split:
                        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*split, ends, held)], names=["_file", "_at", "_ends", "_held"])
                    split, ends, held = (file, block), 0, 0
                at[i], start[i] = ends, held
                ends, held = (ends, held + k) if on else (ends + 1, 0)
            if not sums:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(at), pa.array(start), b.column(4)], names=["_file", "_at", "_line", "_start", "features"])
        if sums and split:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*split, ends, held)], names=["_file", "_at", "_ends", "_held"])

    size = lines.select("_file", "_at", "_on", F.size("_t").cast("long").alias("_k"))
    splits = size.mapInArrow(lambda it: places(it, True), "_file string, _at long, _ends long, _held long")
    before = Window.orderBy("_file", "_at").rowsBetween(Window.unboundedPreceding, -1)
    upto = splits.select("*", F.coalesce(F.sum("_ends").over(before), F.lit(0)).alias("_before"), F.coalesce(F.sum("_held").over(before), F.lit(0)).alias("_values"))
    # values held over from the splits since the last one in which a line ended
    since = F.coalesce(F.last(F.when(F.col("_ends") > 0, F.col("_values")), ignorenulls=True).over(before), F.lit(0))
    upto = upto.select("_file", "_at", "_before", (F.col("_values") - since).alias("_over"))
    pieces = lines.select("_file", "_at", "_on", F.size("_t").cast("long").alias("_k"), F.transform("_t", lambda t: F.trim(t).cast("double")).alias("features"))
    placed = pieces.mapInArrow(lambda it: places(it, False), "_file string, _at long, _line long, _start long, features array<double>")
    return placed.join(F.broadcast(upto), ["_file", "_at"]).select(
        (F.col("_before") + F.col("_line")).alias("feat_id"), (F.col("_start") + F.when(F.col("_line") == 0, F.col("_over")).otherwise(0)).alias("start"), "features")


def read_column_entries(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """A matrix with one column per line -> its non-zero entries ``[row_id: long, feat_id: long, value]``.

    The place in a line is the row, the line number the column (see :func:`read_column_pieces`).
    """
    entries = read_column_pieces(spark, path, sep).select("feat_id", "start", F.posexplode("features").alias("place", "value"))
    return entries.where(F.col("value") != 0.0).select((F.col("start") + F.col("place")).alias("row_id"), "feat_id", "value")


def write_column_lines(entries: DataFrame, path: str, sep: str = ",", row: str = "row_id", piece: int = LINE_PIECE) -> None:
    """The inverse: all entries (zeros included) of ``[row, feat_id, value]``, one line per column, lines in column order.

    The values of each ``piece`` rows are put together by themselves; a column of more is a line that goes on.
    """
    place = F.floor(F.coalesce(F.col(row), F.lit(-1)) / piece)
    value = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(row, "value"))), lambda e: e["value"].cast("string")), sep)
    parts = entries.groupBy("feat_id", place.alias("place")).agg(value.alias("line"), F.count("value").alias("n"))
    # nulls are left out of a line; a line of nulls alone is an empty one
    some = F.when(F.col("n") > 0, F.col("place"))
    ends = parts.groupBy("feat_id").agg(F.coalesce(F.max(some), F.min("place")).alias("last"))
    parts = parts.join(ends, "feat_id").where((F.col("n") > 0) | (F.col("place") == F.col("last")))
    line = F.concat("line", F.when(F.col("place") < F.col("last"), F.lit(GOES_ON)).otherwise(F.lit("")))
    parts.select("feat_id", "place", line.alias("line")).orderBy("feat_id", "place").select("line").write.mode("overwrite").text(path)


def write_vector_lines(df: DataFrame, path: str, index: str = "feat_id", value: str = "value") -> None:
    """Write an n-vector one value per line in index order (one small file; n is bounded)."""
    (df.orderBy(index).select(F.col(value).cast("string").alias("value")).coalesce(1)
     .write.mode("overwrite").text(path))
