"""Sources and sinks over files, behind a list of folders that may be read."""

from __future__ import annotations

import os
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class PathRefused(PermissionError):
    """A path outside the folders that are allowed."""


class Files:
    """Readers confined to ``allowed`` folders: local paths after following links, others by their prefix. Remote http reads are off."""

    def __init__(self, spark: SparkSession, *allowed: str):
        self.spark = spark
        self.allowed = [a if "://" in a else os.path.realpath(a) for a in allowed]

    def check(self, path: str) -> str:
        scheme = urlparse(path).scheme
        if scheme in ("http", "https"):
            raise PathRefused(f"FODC0002: no network reads: {path}")
        real = path if scheme not in ("", "file") else os.path.realpath(urlparse(path).path)
        if not any(real == a or real.startswith(a.rstrip("/") + "/") for a in self.allowed):
            raise PathRefused(f"FODC0002: outside the allowed folders: {path}")
        return path

    def collection(self, path: str) -> DataFrame:
        """(uri, text) of all files of a folder or glob."""
        return self.spark.read.text(self.check(path), wholetext=True).select(F.input_file_name().alias("uri"), F.col("value").alias("text"))

    def uri_collection(self, path: str) -> DataFrame:
        return self.spark.read.format("binaryFile").load(self.check(path)).select(F.col("path").alias("uri"))

    unparsed_text = collection

    def unparsed_text_lines(self, path: str) -> DataFrame:
        """(uri, line): lines end with LF, CR or CRLF."""
        return self.collection(path).select("uri", F.posexplode(F.split(F.regexp_replace("text", r"(\r\n?|\n)\z", ""), r"\r\n?|\n")).alias("line_no", "line"))

    def available(self, path: str) -> bool:
        """doc-available and unparsed-text-available."""
        try:
            hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(self.check(path))
            return bool(hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop))
        except PathRefused:
            return False

    def json_doc(self, path: str) -> DataFrame:
        """One row per file: uri and its value as a VARIANT."""
        return self.collection(path).select("uri", F.parse_json("text").alias("value"))

    def xml_records(self, path: str, row_tag: str, schema: str | None = None) -> DataFrame:
        """Records of a large XML file, split by their tag; never the whole document at once."""
        reader = self.spark.read.format("xml").option("rowTag", row_tag)
        return (reader.schema(schema) if schema else reader).load(self.check(path))

    def doc(self, path: str, html: bool = False, strip_space: bool = False) -> DataFrame:
        """Node rows (sources.nodes) of all documents of a path."""
        from sylvan.sources.nodes import shred

        return shred(self.collection(path), F.col("uri"), F.col("text"), html, strip_space)

    def write_xml(self, df: DataFrame, path: str, row_tag: str = "row", root_tag: str = "rows") -> None:
        df.write.mode("errorifexists").format("xml").option("rowTag", row_tag).option("rootTag", root_tag).save(self.check(path))

    def write_json(self, df: DataFrame, path: str) -> None:
        df.write.mode("errorifexists").json(self.check(path))

    def write_text(self, df: DataFrame, path: str) -> None:
        df.write.mode("errorifexists").text(self.check(path))

    def result_documents(self, df: DataFrame, href: str, path: str) -> None:
        """result-document with an href of each row: a folder for each, written in one pass; an existing one is XTDE1490."""
        df.write.mode("errorifexists").partitionBy(href).parquet(self.check(path))
