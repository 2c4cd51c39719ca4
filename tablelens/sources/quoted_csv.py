"""Delimited files whose quoted fields hold line breaks, read in many tasks.

Whether a line starts a record depends on the number of quotes before it in the file. A first scan takes the
parity of the quotes of each split; the splits that start inside a quoted field are few numbers. A second scan joins the lines of
each split to records; what a split's ends leave over is joined across splits. Spark then parses each record.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablelens.functions.columns import col, quoted
from tablelens.functions.stats import materialize

CORRUPT = "_corrupt_record"
# The types that a column may be inferred to, narrowest first.
INFERRED = ("int", "bigint", "double", "timestamp", "boolean")
PIECE = "file long, block long, part int, first boolean, record string"
WHOLE, HEAD, TAIL = 0, 1, 2  # a record; the lines before a split's first record; a split's last record, still open


def split_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, line) in file order within each split: file by its hash, block by its split's start. Only a line feed
    ends a line; a carriage return before it is removed later, where a record ends."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"))


def open_splits(lines: DataFrame) -> DataFrame:
    """(file, block) of the splits that start inside a quoted field. One row a split is summed over; splits hold up to
    ``spark.sql.files.maxPartitionBytes``, so a file of 100 TB has some 800,000 of them."""
    quotes = F.length("line") - F.length(F.replace("line", F.lit('"')))
    odd = lines.groupBy("file", "block").agg(F.bit_xor(F.pmod(quotes, F.lit(2))).alias("odd"))
    before = F.sum("odd").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    return odd.select("file", "block", F.coalesce(before, F.lit(0)).alias("before")).where("before % 2 = 1").select("file", "block")


def _single_lines(batch: pa.RecordBatch, at, first: bool):
    """(pieces, split of the last line, whether its first record is still to come) of lines that are a record each; None where
    a quoted field goes on beyond a line. ``at`` and ``first`` belong to the line before."""
    file, block, line, opened = batch.columns
    odd = pc.bit_wise_and(pc.count_substring(line, '"'), 1)
    if not len(line) or pc.any(opened).as_py() or pc.max(odd).as_py():
        return None
    file, block = file.to_numpy(), block.to_numpy()
    some = pc.not_equal(pc.utf8_trim(line, "\r"), "").to_numpy(zero_copy_only=False)
    firsts = np.zeros(len(line), bool)
    starts = np.concatenate([[0], 1 + np.nonzero((np.diff(file) != 0) | (np.diff(block) != 0))[0]])
    for lo, hi in zip(starts, [*starts[1:], len(line)]):
        if (file[lo], block[lo]) != at:
            at, first = (file[lo], block[lo]), block[lo] == 0
        records = np.nonzero(some[lo:hi])[0]
        if first and len(records):
            firsts[lo + records[0]], first = True, False
    keep = pa.array(some)
    columns = [pa.array(file), pa.array(block), pa.array(np.full(len(line), WHOLE), pa.int32()), pa.array(firsts), line.cast(pa.string())]
    return pa.RecordBatch.from_arrays([c.filter(keep) for c in columns], ["file", "block", "part", "first", "record"]), at, bool(first)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of consecutive splits to records and the pieces at the splits' ends; ``first`` marks a file's first record.

    A split that starts in a quoted field gives its lines up to the end of that field's record as HEAD (a record that
    fills the split: all of them). Blank lines between records are left out."""
    names = ["file", "block", "part", "first", "record"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.string()]
    at, inside, held, kind, first, out = None, False, [], WHOLE, False, []

    def emit(part):
        nonlocal first
        text = "\n".join(held)
        if part != WHOLE or text.strip("\r"):
            out.append((*at, part, first, text))
            first = False

    for batch in batches:
        plain = None if held else _single_lines(batch, at, first)
        if plain is not None:
            pieces, at, first = plain
            kind = WHOLE
            yield pieces
            continue
        out = []
        for file, block, line, opened in zip(*(c.to_pylist() for c in batch.columns)):
            if (file, block) != at:
                if held:
                    emit(TAIL if kind == WHOLE else HEAD)
                at, inside, held, first = (file, block), opened, [], block == 0
                kind = HEAD if opened else WHOLE
            held.append(line)
            inside ^= line.count('"') % 2 == 1
            if not inside:
                emit(kind)
                held, kind = [], WHOLE
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 5, types)], names)
    out = []
    if held:
        emit(TAIL if kind == WHOLE else HEAD)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)


def records(spark: SparkSession, path: str) -> DataFrame:
    """(first, record): every record of the files with its line breaks, without an order; first: of its file."""
    lines = split_lines(spark, path)
    starts = F.broadcast(open_splits(lines).withColumn("opened", F.lit(True)))  # 17 bytes for each such split
    pieces = lines.join(starts, ["file", "block"], "left").select("file", "block", "line", F.coalesce("opened", F.lit(False)).alias("opened")) \
        .mapInArrow(_pieces, PIECE)
    pieces = materialize(pieces)  # read for the whole records and for the joined ones, of each pass over the table
    # a TAIL is continued by the HEADs of the next splits; all pieces up to the next TAIL are one record
    ends = pieces.where(F.col("part") != WHOLE)
    number = F.count_if(F.col("part") == TAIL).over(Window.partitionBy("file").orderBy("block", "part").rowsBetween(Window.unboundedPreceding, 0))
    joined = ends.withColumn("number", number).groupBy("file", "number").agg(
        F.max("first").alias("first"), F.sort_array(F.collect_list(F.struct("block", "part", "record"))).alias("pieces"))
    whole = pieces.where(F.col("part") == WHOLE).select("first", "record") \
        .unionByName(joined.select("first", F.array_join(F.col("pieces.record"), "\n").alias("record")))
    return whole.withColumn("record", F.regexp_replace("record", "\r\\z", ""))


def _header(spark: SparkSession, path: str, sep: str) -> list[str]:
    return spark.read.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"') \
        .option("multiLine", True).option("inferSchema", False).csv(path).columns


def _reads_as(c: Column, t: str) -> Column:
    """Whether a text is a value of the type; looser casts (times without a day, ``yes`` as true) do not count."""
    if t == "boolean":
        return F.lower(c).isin("true", "false")
    # a failed try_cast costs an exception; texts that hold what no value of the type has are not cast
    if t in ("int", "bigint"):
        n = c.try_cast("bigint")
        fits = n.isNotNull() if t == "bigint" else n.between(-(1 << 31), (1 << 31) - 1)
        return F.when(~c.rlike("[A-Za-z:/.]|[0-9]-"), F.coalesce(fits, F.lit(False))).otherwise(F.lit(False))
    shape = {"double": r"[0-9.]$|(?i)^[-+]?(nan|inf|infinity)$", "timestamp": r"^\d{4}-\d{2}-\d{2}"}[t]
    able = c.rlike(shape) & ~c.rlike("[0-9][-:/]") if t == "double" else c.rlike(shape)
    return F.when(able, c.try_cast(t).isNotNull()).otherwise(F.lit(False))


def _narrowest(names: list[str], rows: DataFrame) -> dict[str, str]:
    """The first of ``INFERRED`` that every value of a column reads as; string where none does or nothing is there."""
    counts = rows.agg(*[x for i, n in enumerate(names) for x in
                        [F.count(col(n)).alias(f"n{i}"), *[F.count_if(_reads_as(col(n), t)).alias(f"{t}{i}") for t in INFERRED]]]).first()
    return {n: next((t for t in INFERRED if counts[f"n{i}"] and counts[f"{t}{i}"] == counts[f"n{i}"]), "string") for i, n in enumerate(names)}


def read_quoted_csv(spark: SparkSession, path: str, sep: str = ",", infer_schema: bool = True) -> DataFrame:
    """The table of one or more UTF-8 files with a header row each, in as many tasks as the files have splits.

    Quotes inside a quoted field are doubled; fields may hold separators and line breaks. A record with more or fewer
    fields than the header is kept whole in ``_corrupt_record`` besides the fields that could be read; :func:`corrupt_records` counts them. An empty
    unquoted field is null. Fields whose quotes are not balanced make the rest of their file one record."""
    names = _header(spark, path, sep)
    schema = ", ".join(f"{quoted(n)} string" for n in [*names, CORRUPT])
    options = {"sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "multiLine": "true"}
    rows = records(spark, path).where(~F.col("first")).select(F.from_csv("record", schema, options).alias("r")).select("r.*")
    if not infer_schema:
        return rows
    rows = materialize(rows)  # parsed once for the types and for the table
    types = _narrowest(names, rows)
    return rows.select(*[col(n).cast(types[n]).alias(n) for n in names], col(CORRUPT))


def corrupt_records(df: DataFrame) -> DataFrame:
    """S3: (rows, corrupt): the records of a table read by :func:`read_quoted_csv`, and those that do not fit its header."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count(col(CORRUPT)).alias("corrupt"))
