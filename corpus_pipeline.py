"""Cleaning a corpus in five stages, each one operator over all that its predecessor kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir). All but the last return the columns of docs.
Rows are told apart by their id and a hash of their text, so null and repeated ids do no harm. An empty table passes
through every stage as an empty one; null texts are empty texts, texts of any length are taken whole, and columns other than
doc_id, text and source pass unchanged whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionweave.llm.best_fit_packing import best_fit_packing
from ionweave.llm.common import BROADCAST_IDS, Workspace, crc_bucket, table, text_or_empty
from ionweave.llm.exact_dedup import exact_dedup_rows
from ionweave.llm.jaccard_join import near_duplicate_rows
from ionweave.llm.quality_classifier import ClassifierParams, fit, keep_good, training_sample
from ionweave.llm.queries import tokenizer_files
from ionweave.llm.source_mixing import mix_counts

#: The pipeline rejects a document only if it is more likely bad than good.
QUALITY_THRESHOLD = 0.5


def _free(name: str, docs: DataFrame) -> str:
    """The name, or with as many underscores behind it as it takes to be none of docs' columns."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _by_row(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Joins docs with a written table of rows (doc_id, text_hash, ...) on both, null ids too; an inner join keeps the other columns of keys.

    The keys are broadcast where they are counted at BROADCAST_IDS at most, else both sides are shuffled.
    """
    small = keys.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    row_id, row_hash = _free("row_doc_id", docs), _free("row_text_hash", docs)
    right = keys.withColumnsRenamed({"doc_id": row_id, "text_hash": row_hash})
    on = docs["doc_id"].cast("long").eqNullSafe(right[row_id]) & (F.xxhash64(text_or_empty(docs["text"])) == right[row_hash])
    joined = docs.join(F.broadcast(right), on, how) if small else docs.hint("shuffle_merge").join(right, on, how)
    return joined.drop(row_id, row_hash) if how == "inner" else joined


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier rejects; it learns from the labels that op1 learns from."""
    p = ClassifierParams()
    labels = table(spark, sf_dir, "labels")
    model = fit(*training_sample(docs, labels.where(~F.coalesce(crc_bucket(F.col("doc_id"), 4) == 2, F.lit(False))), p), p)
    return keep_good(docs, model, p, QUALITY_THRESHOLD)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of equal texts; a row that repeats id and text is a copy too."""
    space = Workspace(spark, "pipeline-exact")
    judged = space.write(exact_dedup_rows(docs).select("doc_id", "text_hash", "kept"), "judged")
    again = space.write(judged.where("kept").groupBy("doc_id", "text_hash").count().where("count > 1").drop("count"), "again")
    dropped = space.write(judged.where("not kept").select("doc_id", "text_hash").distinct(), "dropped")
    left = _by_row(docs, dropped, "left_anti")
    if again.isEmpty():
        return left
    return _by_row(left, again, "left_anti").unionByName(_by_row(left, again, "left_semi").dropDuplicates(["doc_id", "text"]))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of linked texts, the one with the smallest id; texts without words stay."""
    space = Workspace(spark, "pipeline-near")
    rows = space.write(near_duplicate_rows(docs).where("class_key is not null").select("doc_id", "text_hash", "class_key"), "rows")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    first = space.write(rows.groupBy("class_key").agg(F.min(order).alias("best"), F.count("*").alias("n")).where("n > 1"), "first")
    others = rows.join(first, "class_key").where(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash") != F.col("best"))
    return _by_row(docs, space.write(others.select("doc_id", "text_hash").distinct(), "others"), "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as the mix does; rows that repeat id and text are taken as often as all of them together."""
    space = Workspace(spark, "pipeline-mix")
    copies, nth = _free("row_copies", docs), _free("row_nth", docs)
    mixed = mix_counts(docs).groupBy("doc_id", "text_hash").agg(F.sum("copies").cast("int").alias(copies), F.count("*").alias("row_count"))
    taken = space.write(mixed.where(F.col(copies) > 0), "taken")
    columns = docs.columns
    if not taken.where("row_count > 1").isEmpty():
        docs = docs.dropDuplicates(["doc_id", "text"])
    found = _by_row(docs, taken.drop("row_count"), "inner").withColumn(nth, F.explode(F.sequence(F.lit(1), copies)))
    return found.select(*[f"`{c}`" for c in columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all that is left, repeats too, into sequences."""
    files = tokenizer_files()
    return best_fit_packing(docs, files["json"], files["ranks"], files["pattern"])[0]


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("n-gram Jaccard join", near), ("mixing sources to target weights", mix), ("best-fit packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage over `documents`, each written to the shared folder and read again."""
    space = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = space.write(stage(spark, docs, sf_dir), f"stage-{k}")
        if k > 1:
            space.drop(f"stage-{k - 1}")
    return docs


#: The classifier, the join and the packing are beyond SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None
