"""Readers for captured device messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pulsegrid import fixed


def _located(lines: DataFrame) -> DataFrame:
    """File, split offset and read order of each record.

    Records of one split are read in order by one task, so ``(block, seq)`` orders a file without
    gathering it, and ``block`` (bounded by the split size) is a natural slice."""
    return lines.select(
        "value",
        F.col("_metadata.file_path").alias("src"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"),
    )


def read_message_files(spark: SparkSession, path: str, line_end: str = "\n") -> DataFrame:
    """Messages of plain text captures: a line starting ``MSH`` opens a message.

    Records are cut at ``line_end`` + ``MSH`` while reading, so large files stay splittable; captures
    with other line ends give the same messages, but only of one record. Pass ``"\r"`` for captures
    whose lines end in carriage returns alone."""
    records = _located(spark.read.option("lineSep", line_end + "MSH").text(path))
    text = F.regexp_replace(F.concat(F.lit("\nMSH"), F.col("value")), "\r", "\n")
    first = (F.col("block") == 0) & F.col("value").rlike(r"^\s*MSH")
    text = F.when(first, F.regexp_replace("value", "\r", "\n")).otherwise(text)
    parts = F.split(text, r"\n\s*(?=MSH)")
    return (
        records.select("src", "block", "seq", F.posexplode(parts).alias("part", "message"))
        .withColumn("message", F.trim("message", F.lit(" \n\t")))
        .where("message != ''")
    )


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """Messages of a framed capture: the text between the start byte and the end bytes.

    Records are cut at the start byte; a record without end bytes is incomplete and dropped."""
    records = _located(spark.read.option("lineSep", fixed.MLLP_START).text(path))
    complete = F.col("value").contains(fixed.MLLP_END)
    message = F.substring_index("value", fixed.MLLP_END, 1)
    return records.where(complete).select("src", "block", "seq", message.alias("message"))


def write_frames(messages: DataFrame, path: str) -> None:
    """Framed capture files of a ``message`` column."""
    framed = messages.select(F.concat(F.lit(fixed.MLLP_START), "message").alias("value"))
    framed.write.option("lineSep", fixed.MLLP_END).text(path)
