"""Exact duplicates: groups of rows whose normalised texts are the same bytes.

Rows are grouped by a 128-bit hash of the normalised text, with partial counts in every task, so a group of any size is
one row a task. The texts of groups of more than one row are then grouped by (hash, text), where Spark compares the
bytes themselves: a hash under which two different texts meet shows there as two rows, and its members are told apart
by their texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, hot_join, small

#: The six white-space characters of ASCII.
BLANKS = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, "")


def exact_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", normalise: Callable[[Column], Column] = normalised, content_hash: Callable[[Column], Column] = F.md5) -> DataFrame:
    """A row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when ``normalise`` makes the same bytes of them (default: white space deleted; null is empty). Of a
    group's rows the one with the most code points in its original text stays, of these the one with the smallest id
    (no id comes last), of rows alike in both just one; ``keep_id`` is its id (null if it has none), ``kept`` marks it.
    ``group_size`` counts rows, repeated ones each. ``text_sha256`` is of the normalised text in UTF-8. All texts without
    visible characters are one group. An empty table gives no rows; other columns are ignored, whatever their names.
    ``content_hash`` (text to string) only groups: where it collides, bytes decide.
    """
    scratch = Scratch(docs.sparkSession)
    read = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    read = read.select("doc_id", F.char_length("text").cast("long").alias("n"), normalise(F.col("text")).alias("text"))
    read = read.withColumn("h", content_hash(F.col("text")))
    row = F.monotonically_increasing_id().alias("row")
    thin = scratch.save(read.select("doc_id", "n", "h", F.sha2("text", 256).alias("text_sha256"), row))
    # the complement turns the order of whole numbers round, without overflow
    best = F.max(F.struct("n", F.col("doc_id").isNotNull().alias("has"), F.bitwise_not(F.coalesce("doc_id", F.lit(0))).alias("low"), F.bitwise_not("row").alias("row"))).alias("best")
    classes = scratch.save(thin.groupBy("h").agg(F.count("*").alias("group_size"), best))

    # a group's texts meet as keys of an aggregate, which compares bytes: one row a task for each different text
    several = classes.where("group_size > 1").select("h")
    texts = read.select("h", "text")
    if several.count() <= 200_000:  # else all texts go through the aggregate: the same result without a broadcast
        texts = texts.join(F.broadcast(several), "h", "left_semi")
    apart = scratch.save(texts.groupBy("h", "text").agg(F.lit(1).alias("m")).groupBy("h").agg(F.count("*").alias("m")).where("m > 1").select("h"))

    def result(rows: DataFrame, of: DataFrame, keys: list[str]) -> DataFrame:
        keep = F.when(F.col("best.has"), F.bitwise_not("best.low"))
        return hot_join(rows, of, keys).select("doc_id", keep.alias("keep_id"), "group_size", (F.col("row") == F.bitwise_not("best.row")).alias("kept"), "text_sha256")

    if apart.isEmpty():
        return result(thin, classes, ["h"])
    # rows whose hash stands for several texts: the text itself is their key
    apart = small(apart, 200_000)
    full = scratch.save(read.join(apart, "h", "left_semi").withColumn("text_sha256", F.sha2("text", 256)).withColumn("row", F.monotonically_increasing_id()))
    rest = scratch.save(thin.join(apart, "h", "left_anti"))
    return result(rest, classes, ["h"]).unionByName(result(full, full.groupBy("h", "text").agg(F.count("*").alias("group_size"), best), ["h", "text"]))
