"""Documents from text files, uploads and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Limits of an upload.
UPLOAD_BYTES, UPLOAD_LEAST, UPLOAD_MOST = 100 * 1024, 50, 200_000


def text_documents(spark: SparkSession, folder: str, metadata: DataFrame) -> DataFrame:
    """*.txt of a folder, whole. metadata: file, document_id, jurisdiction, document_type, source. A file without it is an error."""
    files = spark.read.text(f"{folder}/*.txt", wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), F.col("value").alias("text"))
    unknown = [r.file for r in files.select("file").join(F.broadcast(metadata), "file", "left_anti").orderBy("file").limit(20).collect()]
    if unknown:
        raise ValueError(f"files without metadata: {unknown}")
    rows = files.join(F.broadcast(metadata), "file").drop("file")
    return described(rows)


def described(rows: DataFrame) -> DataFrame:
    """Adds char_count, line_count and sha256."""
    return rows.withColumn("char_count", F.length("text")).withColumn("line_count", F.regexp_count("text", F.lit("\n")) + 1).withColumn("sha256", F.sha2(F.encode("text", "UTF-8"), 256))


def accepted_uploads(files: DataFrame) -> DataFrame:
    """files: content (binary). Decoded as UTF-8, else as Latin-1; too large, too short or with NUL characters they go."""
    utf8 = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    rows = files.where(F.octet_length("content") <= UPLOAD_BYTES).withColumn("text", F.coalesce(utf8, F.decode("content", "ISO-8859-1")))
    rows = rows.where(~F.contains("text", F.lit("\0")) & (F.length(F.regexp_replace("text", r"^\s+|\s+$", "")) >= UPLOAD_LEAST))
    return rows.withColumn("text", F.substring("text", 1, UPLOAD_MOST))
