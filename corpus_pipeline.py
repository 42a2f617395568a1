"""A training corpus from raw documents: five stages, each one operator of ``barloom.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as Parquet and rereads as the next
stage's docs. All but the last return the columns of documents, whatever other columns there are. An empty table gives
no rows in any stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.llm import jaccard, mixing, packing, quality, queries, suffix
from barloom.llm.shared import Scratch, small


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts to be good.

    Null and empty texts are scored like others, by their lack of words; repeated rows share a score and stay or go
    together; rows without doc_id are scored, but not learned from.
    """
    fold = F.crc32(F.col("doc_id").cast("string")) % 3 != 1
    scored = quality.score(docs, queries.table(spark, sf_dir, "labels"), fold=fold)
    return scored.where("predicted = 1").select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates one row: that of the smallest doc_id (null: after all others), then of the smallest hash of its text.

    Rows are told apart by doc_id and text, so a row goes only with its own class, whatever shares its doc_id; of equal
    rows one stays. Texts without words are in no class: all their rows stay.
    """
    scratch = Scratch(spark)
    found = jaccard.jaccard_components(docs.select("doc_id", "text"), width=5, threshold=75).where("n_shingles > 0")
    rows = scratch.save(found.groupBy("class_id", "doc_id", "h").agg(F.count("*").alias("copies")))
    n = rows.count() // 2
    key = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "h")
    classes = rows.groupBy(F.col("class_id").alias("of")).agg(F.min(key).alias("one"), F.count("*").alias("n")).where("n > 1")
    classes = small(scratch.save(classes.select("of", F.col("one.doc_id").alias("first_id"), F.col("one.h").alias("first_h")), n))
    other = rows.join(classes, F.col("class_id") == F.col("of")).where(~(F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("h") == F.col("first_h"))))
    gone = small(scratch.save(other.select(F.col("doc_id").alias("gone_id"), F.col("h").alias("gone_h")), n))
    again = scratch.save(rows.where("copies > 1").select(F.col("doc_id").alias("gone_id"), F.col("h").alias("gone_h")), n)
    same = F.col("key_id").eqNullSafe(F.col("gone_id")) & (F.col("key_h") == F.col("gone_h"))
    keyed = docs.select(F.col("doc_id").cast("long").alias("key_id"), F.xxhash64("text").alias("key_h"), F.struct(*docs.columns).alias("row"))  # whatever names docs has
    left = keyed.join(gone, same, "left_anti")
    if again.isEmpty():
        return left.select("row.*")
    again = small(again)
    one = left.join(again, same, "left_semi").groupBy("key_id", "key_h", F.col("row.text").alias("text")).agg(F.first("row").alias("row"))
    return left.join(again, same, "left_anti").select("row.*").unionByName(one.select("row.*"))


def repeated_string_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 100 bytes that occur earlier; n_chars follows.

    Rows without doc_id come after all others; rows of one doc_id are not earlier than each other, so equal rows lose the
    same bytes. Null texts stay null, and short ones as they are; a text that loses all its bytes stays as an empty one.
    """
    out = suffix.remove(docs, length=100)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns) if "n_chars" in docs.columns else out


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it.

    Rows alike in doc_id, source and size share all their copies: some get one more than the others. Null is a source and
    a doc_id like others; null and empty texts have size 0 and cost the mix nothing.
    """
    scratch = Scratch(spark)
    mixed = mixing.mix(docs.select("doc_id", "text", "source"), weights=(3, 1, 2), share=1.5, cap=2.0)
    of = [F.col(c).alias(f"of_{c.removeprefix('doc_')}") for c in ("doc_id", "source", "size")]
    copies = mixed.groupBy("doc_id", "source", "size").agg(F.sum("copies").alias("all"), F.count("*").alias("rows")).where("all > 0")
    copies = scratch.save(copies.select(*of, F.floor(F.col("all") / F.col("rows")).cast("int").alias("copies"), (F.col("all") % F.col("rows")).alias("extra")))
    found = small(copies, 500_000)  # under 64 bytes a row
    size = F.coalesce(F.regexp_count("text", F.lit(mixing.WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("source").alias("from"), size.alias("size"), F.struct(*docs.columns).alias("row"))  # whatever names docs has
    match = F.col("id").eqNullSafe(F.col("of_id")) & F.col("from").eqNullSafe(F.col("of_source")) & (F.col("size") == F.col("of_size"))

    def repeated(hit: DataFrame) -> DataFrame:
        return hit.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")

    if copies.where("extra > 0").isEmpty():
        return repeated(rows.join(found, match))
    # rows of a group are numbered by the task that read them and their place there: no task has to hold a whole group
    hit = rows.join(found.where("extra > 0"), match).withColumn("of_task", F.spark_partition_id()).withColumn("of_place", F.monotonically_increasing_id())
    hit = scratch.save(hit.select("row", "of_id", "of_source", "of_size", "copies", "extra", "of_task", "of_place"))
    group = ["of_id", "of_source", "of_size"]
    before = hit.groupBy(*group, "of_task").agg(F.count("*").alias("of_rows"))
    before = before.withColumn("of_before", F.sum("of_rows").over(Window.partitionBy(*group).orderBy("of_task")) - F.col("of_rows"))
    place = hit.select(*group, "of_task", "of_place", "extra").withColumn("of_nth", F.row_number().over(Window.partitionBy(*group, "of_task").orderBy("of_place")))
    same = [F.col(f"p.{c}").eqNullSafe(F.col(f"q.{c}")) for c in (*group, "of_task")]
    more = place.alias("p").join(before.alias("q"), same).where("of_before + of_nth <= extra").select(F.col("p.of_place").alias("of_more"))
    odd = hit.join(more, F.col("of_place") == F.col("of_more"), "left").withColumn("copies", F.col("copies") + F.col("of_more").isNotNull().cast("int"))
    return repeated(rows.join(found.where("extra = 0"), match)).unionByName(repeated(odd))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, packed into sequences of 1024 tokens. A null or empty text is the end token alone; repeated rows are packed each."""
    return packing.pack(docs.select("doc_id", "text"), queries.tokenizer(), capacity=1024, end_id=2)


STAGES = [
    ("quality_classifier", quality_stage),
    ("jaccard_join", near_duplicate_stage),
    ("suffix_dedup", repeated_string_stage),
    ("source_mixing", mixing_stage),
    ("best_fit_packing", packing_stage),
]

#: Suffix deduplication by bytes, balanced sampling and a trained classifier have no SQL form; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = queries.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
