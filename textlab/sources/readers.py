"""Readers for labelled corpora and run records (all lazy DataFrame scans)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path

# CSV dialect of the corpus files (RFC 4180 quoting, text may hold newlines).
CSV_OPTIONS = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"',
               "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "mode": "PERMISSIVE"}
SEPARATORS = {".csv": ",", ".tsv": "\t"}
SPLIT_CODES = {1: "train", 2: "validation", 3: "test"}

CORPUS_SCHEMA = T.StructType([
    T.StructField("row_id", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("label", T.IntegerType()),
])

RECORD_SCHEMA = T.StructType([
    T.StructField("macro_f1", T.DoubleType()),
    T.StructField("accuracy", T.DoubleType()),
    T.StructField("macro_avg_precision", T.DoubleType()),
    T.StructField("roc_auc", T.DoubleType()),
    T.StructField("expected_calibration_error", T.DoubleType()),
    T.StructField("f1_per_class", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("precision_per_class", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("recall_per_class", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("avg_precision_per_class", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("confusion_matrix", T.ArrayType(T.ArrayType(T.LongType()))),
])


def _placed(df: DataFrame) -> DataFrame:
    """A scan's rows with the file and the block they come from."""
    return df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))


def _with_order(df: DataFrame, rank: str | None = None) -> DataFrame:
    """Keep an explicit ``row_id``; otherwise number ``_placed`` rows from 0 in the order of the files (by ``rank``,
    if given, then by path) and of their lines, written once to the shared folder so that every later read sees the
    same numbers.

    A block is read by one task from its first row to its last, so a row's place in it is its distance from the
    block's first row. Only the (file, block, rows) table is summed up, one row per scan split."""
    if "row_id" in df.columns:
        return df.drop("_file", "_block")
    path = scratch_path(df.sparkSession, "numbered-rows")
    df.withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
    rows = df.sparkSession.read.parquet(path)
    by = [rank] if rank else []
    blocks = rows.groupBy(*by, "_file", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = Window.orderBy(*by, "_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first"))
    # no hint: one row per block, so the planner broadcasts it by its size
    placed = rows.join(starts.select(*by, "_file", "_block", "_start"), [*by, "_file", "_block"])
    return placed.withColumn("row_id", F.col("_start") + F.col("_at")).drop("_file", "_block", "_at", "_start")


def read_delimited(spark: SparkSession, path: str, schema: T.StructType | None = None, multi_line: bool = True) -> DataFrame:
    """Separator chosen by extension (.csv comma, .tsv tab); anything else is rejected.
    ``multi_line=False`` reads files whose quoted texts hold no line feed in parallel splits."""
    ext = os.path.splitext(path.rstrip("/"))[1].lower()
    if ext not in SEPARATORS:
        raise ValueError(f"unsupported file type {ext!r}: expected one of {sorted(SEPARATORS)}")
    reader = spark.read.options(**CSV_OPTIONS).option("multiLine", multi_line).option("sep", SEPARATORS[ext])
    if schema is not None:
        reader = reader.schema(schema)
    return reader.csv(path)


def read_corpus_csv(spark: SparkSession, train_path: str, val_path: str, test_path: str,
                    text_column: str = "text", label_column: str = "label",
                    schema: T.StructType | None = None, multi_line: bool = True) -> DataFrame:
    """Three split files -> one corpus with a ``split`` column (text, label canonical).

    Files without a ``row_id`` are numbered over their union in file order, train first, so ids
    never meet across splits and keep-first keeps the first line."""
    parts = []
    for rank, (split, path) in enumerate((("train", train_path), ("validation", val_path), ("test", test_path))):
        df = _placed(read_delimited(spark, path, schema, multi_line))
        df = df.withColumnsRenamed({text_column: "text", label_column: "label"})
        parts.append(df.withColumns({"split": F.lit(split), "_rank": F.lit(rank)}))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return _with_order(out, "_rank").drop("_rank").withColumn("label", F.col("label").cast("int"))


def read_json_corpus(spark: SparkSession, path: str, type_split: int = 1,
                     schema: T.StructType | None = None, multi_line: bool = False) -> DataFrame:
    """JSON dataset, one record a line or (``multi_line``) an array or indented records;
    ``type_split`` 1/2/3 names the split (train/validation/test). Malformed input fails."""
    if type_split not in SPLIT_CODES:
        raise ValueError("type_split must be 1 (train), 2 (validation) or 3 (test)")
    reader = spark.read.schema(schema or CORPUS_SCHEMA).option("multiLine", multi_line).option("mode", "FAILFAST")
    return _with_order(_placed(reader.json(path))).withColumn("split", F.lit(SPLIT_CODES[type_split]))


def read_named_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    """One split of a ``split=``-partitioned Parquet dataset (partition pruning)."""
    return spark.read.parquet(path).where(F.col("split") == split)


def read_result_records(spark: SparkSession, pattern: str) -> DataFrame:
    """Every run directory's first matching file, read whole and parsed by itself: group, experiment, path, the
    record as a struct, and ``error`` (null for a good record). A broken file costs nothing but its own row."""
    files = (spark.read.text(pattern, wholetext=True)
             .select("value", F.col("_metadata.file_path").alias("path")))
    parts = F.split(F.col("path"), "/")
    strip = lambda c: F.regexp_replace(c, "^[^=/]*=", "")
    files = files.withColumns({
        "experiment": strip(F.element_at(parts, -2)),
        "group": strip(F.element_at(parts, -3)),
        "_dir": F.regexp_replace(F.col("path"), "/[^/]*$", ""),
    })
    first = files.groupBy("_dir").agg(F.min("path").alias("path"))
    schema = T.StructType([*RECORD_SCHEMA.fields, T.StructField("_corrupt", T.StringType())])
    parsed = files.join(first, ["_dir", "path"], "left_semi").withColumn(
        "record", F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    error = (F.when(F.trim("value") == "", "empty file")
             .when(~F.ltrim("value").startswith("{"), "no record")
             .when(F.col("record").isNull() | F.col("record._corrupt").isNotNull(), "malformed record"))
    return parsed.select("group", "experiment", "path", F.col("record").dropFields("_corrupt").alias("record"), error.alias("error"))


def broken_result_records(spark: SparkSession, pattern: str) -> DataFrame:
    """(group, experiment, path, error) of the files that ``scan_result_records`` leaves out."""
    return read_result_records(spark, pattern).where("error IS NOT NULL").drop("record")


def scan_result_records(spark: SparkSession, pattern: str, class_names=None) -> DataFrame:
    """Every run directory's first ``*_results.json`` -> one row (run name = the
    directory name, ``key=`` prefixes dropped; the grandparent directory is kept
    as ``group``). Records may be indented; broken ones are left out and listed by
    ``broken_result_records``; absent metrics are null; class columns are named by the records
    themselves unless ``class_names`` is given; sorted by macro_f1 descending."""
    good = read_result_records(spark, pattern).where("error IS NULL")
    recs = good.select("group", "experiment", "record.*")
    from ..operators.runs import flatten_metric_maps
    names = class_names or sorted(r[0] for r in recs.select(F.explode(F.map_keys("f1_per_class"))).distinct().collect())  # one row per class
    return flatten_metric_maps(recs, ["group", "experiment"], names).orderBy(F.col("macro_f1").desc_nulls_last())
