"""Reading binary files and encoded texts; rows that fail keep their key and a status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content, status) of binary files, one row for each file listed: ok; or empty or unreadable, without content.

    Spark's reader leaves out files without a byte, and with the options here those that are gone or fail while they are
    read. Their rows are what the listing has beside the paths that are read; the length that the listing gives tells
    the two kinds apart. No content is shuffled, but to tell which files fail each one is read once more.
    """
    options = {"ignoreMissingFiles": "true", "ignoreCorruptFiles": "true", "recursiveFileLookup": "true"}
    found = spark.read.format("binaryFile").options(**options).load(path)
    read = found.where(F.length("content") >= 0)
    one_slash = lambda url: F.regexp_replace(url, "^([A-Za-z][A-Za-z0-9+.-]*):/+", "$1:/")
    listed = spark.createDataFrame([(name,) for name in found.inputFiles()], "url string")  # the listing that the reader itself keeps
    left_out = listed.select(one_slash(F.col("url")).alias("url")).join(read.select(one_slash(F.col("_metadata.file_path")).alias("url")), "url", "left_anti")
    sizes = found.select(one_slash(F.col("_metadata.file_path")).alias("url"), F.col("_metadata.file_size").alias("_size"))  # without content no file is opened
    left_out = left_out.join(sizes, "url", "left").withColumn("_size", F.coalesce("_size", F.lit(0).cast("long")))
    path_of = F.url_decode(F.replace("url", F.lit("+"), F.lit("%2B")))
    none = left_out.select(path_of.alias("path"), F.col("_size").alias("length"), F.lit(None).cast("binary").alias("content"), F.when(F.col("_size") > 0, "unreadable").otherwise("empty").alias("status"))
    return found.select("path", "length", "content", F.lit("ok").alias("status")).unionByName(none)


def decode_base64(rows: DataFrame, column: str) -> DataFrame:
    """rows with content and status: other characters are dropped, the text ends at the first =, nothing left is empty."""
    kept = F.regexp_replace(F.substring_index(F.coalesce(F.col(column), F.lit("")), "=", 1), "[^A-Za-z0-9+/]", "")
    even = F.when(F.length(kept) % 4 == 1, F.substring(kept, F.lit(1), F.length(kept) - 1)).otherwise(kept)  # a single letter is no byte
    padded = F.rpad(even, (F.ceil(F.length(even) / 4) * 4).cast("int"), F.lit("="))
    return rows.withColumn("content", F.try_to_binary(padded, F.lit("base64"))).withColumn("status", F.when(F.length("content") > 0, "ok").otherwise("empty"))


def gate_versions(chunks: DataFrame, versions: tuple[int, int] = (3, 11), types: tuple[int, int] = (1, 3), typed_from: int = 4) -> DataFrame:
    """chunks with version, types_version and status: ok, empty, compile_error (0), or unsupported."""
    byte = lambda i: F.conv(F.hex(F.substring("content", i, 1)), 16, 10).cast("int")
    out = chunks.withColumn("version", byte(1))
    out = out.withColumn("types_version", F.when(F.col("version") >= typed_from, byte(2)))
    status = (
        F.when(F.col("content").isNull() | (F.length("content") == 0), "empty").when(F.col("version") == 0, "compile_error").when(~F.col("version").between(*versions), "unsupported")
        .when((F.col("version") >= typed_from) & ~F.coalesce(F.col("types_version").between(*types), F.lit(False)), "unsupported_types").otherwise("ok")
    )
    return out.withColumn("status", status)


def quarantine(rows: DataFrame, good: Column) -> tuple[DataFrame, DataFrame]:
    """(good rows, failed rows); a condition that is null is a failure."""
    passed = F.coalesce(good, F.lit(False))
    return rows.where(passed), rows.where(~passed)
