"""JSON, JSON Lines, CSV, Markdown and Parquet in and out, with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or a glob names anything, on any file system Spark knows."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def schema_of(schema: str | T.StructType) -> T.StructType:
    return schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)


def empty(spark: SparkSession, schema: str | T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema_of(schema))


def read_json_array(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Objects of files that hold one JSON array, with source_index, their place in the file.

    Elements that are no objects are left out; a file that holds no array is an error.
    """
    rows = spark.read.text(path, wholetext=True).select("value")
    kind = F.schema_of_variant(F.try_parse_json("value"))
    items = F.from_json(
        F.when(F.coalesce(kind, F.lit("")).startswith("ARRAY"), F.col("value")).otherwise(F.raise_error(F.lit("the file holds no JSON array")).cast("string")),
        "array<string>",
    )
    parts = rows.select(F.posexplode(items).alias("source_index", "item"))
    objects = parts.filter(F.col("item").startswith("{"))
    return objects.select("source_index", F.from_json("item", schema_of(schema)).alias("r")).select("source_index", "r.*")


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType, missing: str = "error", malformed: str = "error", limit: int | None = None) -> DataFrame:
    """JSON Lines with a fixed schema.

    missing='empty' gives no rows for a path that does not exist. A malformed line is an error
    (:func:`bad_lines` names it) unless malformed='drop'. *limit* stops reading early.
    """
    if missing == "empty" and not path_exists(spark, path):
        return empty(spark, schema)
    df = spark.read.schema(schema_of(schema)).option("mode", "DROPMALFORMED" if malformed == "drop" else "FAILFAST").json(path)
    return df.limit(limit) if limit is not None else df


def bad_lines(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """(file, line, text) of the lines that are no JSON objects, for error messages.

    Lines are read one by one, a file in as many blocks as tasks want; line numbers come from the counts of
    the blocks before.
    """
    at = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")]
    lines = spark.read.text(path).select(*at, F.col("value").alias("text"))
    blocks = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.withColumn("before", F.coalesce(before, F.lit(0)))
    bad = lines.filter((F.trim("text") != "") & (F.try_parse_json("text").isNull() | ~F.trim("text").startswith("{")))
    return bad.join(blocks, ["file", "block"]).select("file", (F.col("before") + F.col("at") - F.col("first") + 1).alias("line"), "text")


def read_document(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """One JSON document per file; a path that does not exist gives one row of nulls, to be filled by defaults."""
    if not path_exists(spark, path):
        return spark.createDataFrame([(None,) * len(schema_of(schema))], schema_of(schema))
    return spark.read.schema(schema_of(schema)).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_first_filled(spark: SparkSession, paths: list[str], schema: str | T.StructType, fallback: DataFrame | None = None) -> DataFrame:
    """The first path that exists and holds a row, with input_source; else *fallback*."""
    for path in paths:
        if path_exists(spark, path):
            df = read_jsonl(spark, path, schema)
            if not df.isEmpty():
                return df.withColumn("input_source", F.lit(path))
    return (fallback if fallback is not None else empty(spark, schema)).withColumn("input_source", F.lit("fallback"))


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite", keep_nulls: bool = True) -> None:
    """Compact JSON Lines in UTF-8; mode append for batches of an incremental run."""
    df.write.mode(mode).option("ignoreNullFields", not keep_nulls).json(path)


def write_document(df: DataFrame, path: str) -> None:
    """A one-row frame as one indented JSON document."""
    df.select(F.to_json(F.struct(*df.columns), {"pretty": "true"}).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """Chosen columns with a header; null is an empty field."""
    df.select(*columns).coalesce(1).write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def write_text(df: DataFrame, path: str) -> None:
    """A one-row frame with a column value as one text file."""
    df.select("value").coalesce(1).write.mode("overwrite").text(path)


def write_sections(df: DataFrame, path: str, by: str, order: list[str]) -> None:
    """Rows with a column value as text, one folder per *by*, in order within and between its files."""
    ordered = df.repartitionByRange(by, *order).sortWithinPartitions(by, *order)
    ordered.select(by, "value").write.mode("overwrite").partitionBy(by).text(path)


def backup(spark: SparkSession, path: str, suffix: str = ".backup") -> str | None:
    """A copy of *path* beside it before it is overwritten; None if there is nothing to copy."""
    if not path_exists(spark, path):
        return None
    target, conf = spark._jvm.org.apache.hadoop.fs.Path(path + suffix), spark._jsc.hadoopConfiguration()
    source = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = source.getFileSystem(conf)
    spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, source, target.getFileSystem(conf), target, False, True, conf)
    return path + suffix


def manifest(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    """(file, present) of the artefacts expected in a folder."""
    return spark.createDataFrame([(n, path_exists(spark, f"{folder}/{n}")) for n in names], "file string, present boolean")


def megabytes(spark: SparkSession, path: str) -> DataFrame:
    """size_mb of all files under a path; null if there are none."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("length")
    return files.agg((F.sum("length") / 1048576.0).alias("size_mb"))
