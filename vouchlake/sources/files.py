"""Document files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import file_label
from ..tables import numbered


def clean_path(path: str) -> str:
    """Without outer white space and quotes."""
    return path.strip().strip('"').strip("'")


def scan_pdfs(spark: SparkSession, path: str) -> DataFrame:
    """``path, length, content`` and so on of all PDF files below a folder, in either case of the suffix. Unused columns are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[pP][dD][fF]").load(clean_path(path))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def list_files(files: DataFrame, root: str) -> DataFrame:
    """``(doc_seq, file_name, folder, size_label)`` in the order of paths: folder relative to ``root`` (``.`` for the root itself)."""
    inside = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), r"^/*", "/")
    base = "/" + clean_path(root).strip("/") + "/"
    rest = F.when(F.startswith(inside, F.lit(base)), F.substring(inside, F.lit(len(base) + 1), F.length(inside))).otherwise(inside)
    parts = F.split(rest, "/")
    folder = F.when(F.size(parts) > 1, F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/")).otherwise(".")
    listed = files.select("path", file_name(F.col("path")).alias("file_name"), folder.alias("folder"), file_label(F.col("length")).alias("size_label"))
    return numbered(listed, ["path"], "doc_seq").select("doc_seq", "file_name", "folder", "size_label")


def uploaded(spark: SparkSession, files: list[tuple[str, bytes]]) -> DataFrame:
    """Files in memory as ``(path, length, content)``."""
    return spark.createDataFrame([(n, len(b), b) for n, b in files], "path string, length bigint, content binary")
