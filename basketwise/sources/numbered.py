"""Exact places in split files: line numbers, strict JSON lines that name the broken line, ids of one huge JSON array.

Spark cuts big files into splits that are read by different tasks, so a row knows its place in its split only. One
counting pass gives the records of every split; their running sum is what a split has to add. That table has one row a
split, not a record. It is stored, so Spark knows its size and broadcasts or shuffles it by its own limit.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketwise.session import materialize
from basketwise.sources.jsonl import CORRUPT

_SPLIT = ["source_file", "split_start"]


def _records(spark: SparkSession, path: str, separator: str | None) -> DataFrame:
    """Every record with its split and a rising number inside the scan; both passes read this one frame, hence the same
    list of files and the same splits."""
    reader = spark.read if separator is None else spark.read.option("lineSep", separator)
    return reader.text(path).select(
        F.col("value").alias("line"), F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_block_start").alias("split_start"), F.monotonically_increasing_id().alias("__scan"))


def _numbered(records: DataFrame, extra: tuple[Column, ...] = ()) -> DataFrame:
    """``__before``: records of the file before this one. ``extra`` are more sums per split, carried as running sums too."""
    sums = [F.count(F.lit(1)).alias("__n"), *extra]
    names = ["__n", *[f"__x{i}" for i in range(len(extra))]]
    counted = records.groupBy(*_SPLIT).agg(F.min("__scan").alias("__first"), *[c.alias(n) for c, n in zip(sums, names)])
    earlier = Window.partitionBy("source_file").orderBy("split_start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(counted.select(
        *_SPLIT, "__first", *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"{n}_before") for n in names]), "splits")
    return records.join(offsets, _SPLIT).withColumn("__before", F.col("__n_before") + F.col("__scan") - F.col("__first"))


def number_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(line, source_file, line_number)``: all lines, blank ones too, with their number in their file from 1.

    Empty files give no row, equal lines stay apart, a path that is absent is an error of the scan.
    """
    return _numbered(_records(spark, path, None)).select(
        "line", "source_file", (F.col("__before") + 1).alias("line_number"))


def _parsed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    wide = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    row = F.from_json("line", wide, options)
    filled = number_lines(spark, path).filter(F.trim("line") != "").withColumn("row", row)
    shape = F.schema_of_variant(F.try_parse_json("line"))
    odd = F.col("row").isNull() | F.col(f"row.{CORRUPT}").isNotNull()
    return filled.withColumn("broken", odd & ~F.coalesce(F.startswith(shape, F.lit("OBJECT")), F.lit(False)))


def broken_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(source_file, line_number, line)`` of every filled line that is no JSON object."""
    return _parsed(spark, path, T.StructType()).filter("broken").select("source_file", "line_number", "line")


def read_jsonl_located(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Strict scan whose error names the file, the line number and the text of a malformed line.

    Blank lines are skipped; a field of another type than declared is NULL; a missing path is an empty table. The rows
    carry ``source_file`` and ``line_number`` behind the declared columns (under ``__`` names where they clash).
    """
    declared = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    place = {n: n if n not in declared.fieldNames() else f"__{n}" for n in ("source_file", "line_number")}
    try:
        rows = _parsed(spark, path, declared)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        ends = [T.StructField(place["source_file"], T.StringType()), T.StructField(place["line_number"], T.LongType())]
        return spark.createDataFrame([], T.StructType([*declared.fields, *ends]))
    where = F.concat(F.lit("malformed line "), F.col("line_number").cast("string"), F.lit(" of "), F.col("source_file"),
                     F.lit(": "), F.substring("line", 1, 200))
    # the check is part of the row itself, so no projection can prune it away
    checked = F.when(F.col("broken"), F.raise_error(where).cast(declared)).otherwise(
        F.struct(*[F.col("row")[n].alias(n) for n in declared.fieldNames()]))
    return rows.select(checked.alias("row"), F.col("source_file"), F.col("line_number")).filter(F.col("row").isNotNull()).select(
        *[F.col("row")[n].alias(n) for n in declared.fieldNames()], *[F.col(n).alias(out) for n, out in place.items()])


def read_id_array(spark: SparkSession, path: str) -> DataFrame:
    """``(source_file, ordinal, id)`` from files that are one JSON array of ids each, read in splits of any number.

    Files are cut at commas. A comma inside an id splits it into pieces, of which the first and last have an odd number
    of quotes (an escape never reaches across a comma), so a running sum of odd pieces tells where an id starts: over
    splits from the counting pass, inside a split by one window, which is bounded by the size of a split. Ordinals start
    at 0. Numbers are read as text, null stays an id that is NULL, an empty array has no rows, anything that is no JSON
    value fails the read with its place.
    """
    records = _records(spark, path, ",")
    quotes = F.length(F.regexp_replace(F.regexp_replace("line", r"\\.", ""), '[^"]', ""))
    pieces = records.withColumn("__odd", quotes % 2)
    numbered = _numbered(pieces, (F.sum("__odd"),))
    inside = Window.partitionBy(*_SPLIT).orderBy("__before")
    open_before = (F.col("__x0_before") + F.sum("__odd").over(inside) - F.col("__odd")) % 2
    starts = F.when(F.col("__open") == 0, 1).otherwise(0)
    # a second pair of sums: ids that start in earlier splits, and so far in this one
    marked = materialize(numbered.withColumn("__open", open_before).withColumn("__starts", starts).select(
        *_SPLIT, "__before", "line", "__odd", "__open", "__starts"), "pieces")
    earlier = Window.partitionBy("source_file").orderBy("split_start").rowsBetween(Window.unboundedPreceding, -1)
    per_split = materialize(marked.groupBy(*_SPLIT).agg(F.sum("__starts").alias("__n")).select(
        *_SPLIT, F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__ids_before")), "splits")
    ranked = marked.join(per_split, _SPLIT).withColumn(
        "ordinal", F.col("__ids_before") + F.sum("__starts").over(inside) - 1)
    whole = (F.col("__open") == 0) & (F.col("__odd") == 0)
    single = ranked.filter(whole).select("source_file", "ordinal", F.col("line").alias("text"))
    cut = ranked.filter(~whole).groupBy("source_file", "ordinal").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("__before", "line"))), lambda p: p["line"]), ",").alias("text"))
    body = F.regexp_replace(F.when(F.col("ordinal") == 0, F.regexp_replace("text", r"^\s*\[", "")).otherwise(F.col("text")),
                            r"\]\s*$", "")
    ids = single.unionByName(cut).withColumn("text", F.trim(F.regexp_replace(body, r"^\s+|\s+$", "")))
    value = F.from_json(F.concat(F.lit("["), F.col("text"), F.lit("]")), "array<string>")
    bad = F.try_parse_json("text").isNull()
    where = F.concat(F.lit("no JSON value at ordinal "), F.col("ordinal").cast("string"), F.lit(" of "), F.col("source_file"))
    return ids.filter(~((F.col("text") == "") & (F.col("ordinal") == 0))).select(
        "source_file", "ordinal", F.when(bad, F.raise_error(where).cast("string")).otherwise(F.get(value, F.lit(0))).alias("id"))
