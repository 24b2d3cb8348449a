"""Scan of files as bytes, the gate before any parsing, and dispatch by extension."""

from __future__ import annotations

import posixpath
import re
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import extension
from ..schemas import MAX_FILE

FORMATS = (".fit", ".gpx", ".tcx")


def scan(spark: SparkSession, *paths: str) -> DataFrame:
    """path, length, content of regular files. Spark's file scan leaves out files of zero bytes, so these come from empty()."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths)).select("path", "length", "content")


def reason():
    return (
        F.when(F.col("length") == 0, "file is empty")
        .when(F.col("length") > MAX_FILE, "file is larger than 100 MB")
        .when(~extension(F.col("path")).isin(*FORMATS), "unknown file extension")
    )


def accepted(files: DataFrame, ext: str) -> DataFrame:
    """Files of one format that pass the gate. The gate reads no content, so that a rejected file is never loaded."""
    return files.filter(reason().isNull() & (extension(F.col("path")) == ext))


def rejected(files: DataFrame) -> DataFrame:
    return files.select("path", reason().alias("reason")).filter(F.col("reason").isNotNull())


def empty(spark: SparkSession, *paths: str) -> DataFrame:
    """Error rows of files of zero bytes: those that the listing names and the scan leaves out."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths))
    plain = lambda p: re.sub(r"^([a-z0-9]+:)/+(?=[^/])", r"\1/", unquote(p))
    listed = spark.createDataFrame([(plain(p),) for p in found.inputFiles() if not posixpath.basename(p).startswith(("_", "."))], "path string")
    scanned = found.select(F.regexp_replace("path", "^([a-z0-9]+:)/+(?=[^/])", "$1/").alias("path"))
    return listed.join(scanned, "path", "left_anti").select("path", F.lit("file is empty").alias("reason"))
