"""New document files as a stream: the same rows and fields as in a batch, each file once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType, TimestampType

from ..operators import documents
from ..sources.files import clean_path, file_name
from ..sources.pdf import process_pdfs

FILES = StructType([StructField("path", StringType()), StructField("modificationTime", TimestampType()), StructField("length", LongType()), StructField("content", BinaryType())])


def stream_files(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """PDF files as they arrive below a folder, so many at most in a batch."""
    return spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[pP][dD][fF]").option("maxFilesPerTrigger", max_files).load(clean_path(path))


def stream_documents(spark: SparkSession, path: str, ocr: bool = True) -> DataFrame:
    """Decoded rows (see :mod:`..sources.pdf`) of new files. Stateless: the checkpoint of the query that writes them keeps which files were seen."""
    return process_pdfs(stream_files(spark, path), ocr)


def write_fields(files: DataFrame, sink: Callable[[DataFrame], None], checkpoint: str, ocr: bool = True) -> StreamingQuery:
    """Classified documents of new files to ``sink``, batch by batch until the folder is read. A file is whole within its batch, so no state is kept beyond the checkpoint; ``doc_seq`` is the file's time and a hash of its path."""

    def batch(df: DataFrame, _: int) -> None:
        order = df.select(file_name(F.col("path")).alias("file_name"), (F.unix_seconds("modificationTime") * (1 << 20) + F.pmod(F.xxhash64("path"), F.lit(1 << 20))).alias("doc_seq"))
        sink(documents.classified(process_pdfs(df, ocr), order.dropDuplicates(["file_name"])))

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
