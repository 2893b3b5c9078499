"""Source trees as DataFrames: reading, decoding and fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions.text import line_count


def read_tree(spark: SparkSession, root: str, content: bool = True) -> DataFrame:
    """filename, mtime, length (and content as bytes) of all files below root."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    columns = [F.col("path").alias("filename"), F.unix_timestamp("modificationTime").alias("mtime"), "length"]
    return files.select(*columns, *(["content"] if content else []))


def drop_binary(files: DataFrame, content: str = "content") -> DataFrame:
    """Without files that have a NUL in their first 8192 bytes (or characters, if content is a string)."""
    return files.where(F.locate("\0", F.substring(content, 1, 8192).cast("string")) == 0)


#: What Windows-1252 has in place of the control characters 80 to 9F of Latin-1, and those it leaves undefined.
_CONTROLS = [bytes([c]).decode("latin-1") for c in range(0x80, 0xA0)]
_WINDOWS = [bytes([c]).decode("cp1252", "replace") for c in range(0x80, 0xA0)]
_DEFINED = [(a, b) for a, b in zip(_CONTROLS, _WINDOWS, strict=True) if b != "\ufffd"]
_UNDEFINED = "".join(a for a, b in zip(_CONTROLS, _WINDOWS, strict=True) if b == "\ufffd")


def decode(content: Column) -> Column:
    """UTF-8 where valid; else Windows-1252, which is Latin-1 with signs for its control characters; where a byte has no
    meaning there either, the valid UTF-8 parts alone."""
    text = content.cast("string")
    latin = F.decode(content, "ISO-8859-1")
    single = F.translate(latin, "".join(a for a, _ in _DEFINED), "".join(b for _, b in _DEFINED))
    stripped = F.replace(F.make_valid_utf8(text), F.lit("\ufffd"), F.lit(""))
    return F.when(F.is_valid_utf8(text), text).when(latin.rlike(f"[{_UNDEFINED}]"), stripped).otherwise(single)


def fingerprint(files: DataFrame) -> DataFrame:
    """filename, md5 of the content, line count and length; mtime and entity count where the files have them."""
    own = [c for c in ("mtime", "entry_count") if c in files.columns]
    return files.select("filename", F.md5("content").alias("file_hash"), line_count(F.col("content")).cast("long").alias("n_lines"), F.length("content").cast("long").alias("n_chars"), *own)
