"""Exact deduplication by content-defined chunk recipes, in DataFrame functions only.

A text without its spaces is cut into chunks at places that the text itself names, so equal passages give equal
chunks wherever they stand. A chunk is known by a 64-bit hash; a hash that stands for two contents is found by
comparing the contents' SHA-256 and split into verified identifiers. A document is then its ordered identifier list, and
only these lists (8 bytes for about a thousand characters) are shuffled and compared: no text moves at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ionweave.llm.common import SPACE_RE, Workspace, text_or_empty

#: A chunk ends, after MIN_CHUNK characters, behind the first of these marks (one place in about 700), or after MAX_CHUNK.
#: A script without such letters is cut by MAX_CHUNK alone, which costs shared chunks but no right result.
MIN_CHUNK, MAX_CHUNK = 128, 8192
BOUNDARY = r"[adhlpsuy][cegkmortvz][bfinqwx][a-d]"


def chunks(text: Column, min_chunk: int = MIN_CHUNK, max_chunk: int = MAX_CHUNK) -> Column:
    """The text as an array of content-defined chunks; their concatenation is the text, an empty text has none."""
    pattern = rf"(?s).{{{min_chunk},{max_chunk}}}?(?<={BOUNDARY})|.{{1,{max_chunk}}}"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def with_verified_ids(recipes: DataFrame) -> DataFrame:
    """recipes (row_id, chunks array<struct<h, digest>>, ...) with a column ids, one identifier for each content.

    Where every hash stands for one digest, the hashes are the identifiers. Else a hash with more digests gets the
    digest's rank as a second part, and the lists are built anew from rows (row_id, position).
    """
    pairs = recipes.select(F.explode("chunks").alias("c")).select("c.h", "c.digest").distinct()
    clashes = pairs.groupBy("h").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("digest")).alias("digests")).where("n > 1")
    if clashes.isEmpty():
        return recipes.withColumn("ids", F.col("chunks.h")).drop("chunks")
    variants = clashes.select("h", F.posexplode("digests").alias("variant", "digest"))
    at = recipes.select("row_id", F.posexplode_outer("chunks").alias("pos", "c")).select("row_id", "pos", "c.h", "c.digest")
    named = at.join(variants, ["h", "digest"], "left").withColumn("id", F.struct("h", F.coalesce("variant", F.lit(0)).alias("variant")))
    lists = named.groupBy("row_id").agg(F.sort_array(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "id")))).alias("x"))
    return recipes.drop("chunks").join(lists.select("row_id", F.col("x.id").alias("ids")), "row_id")


def exact_dedup_rows(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_of=F.xxhash64, min_chunk: int = MIN_CHUNK, max_chunk: int = MAX_CHUNK
) -> DataFrame:
    """One row (doc_id, keep_id, group_size, kept, text_sha256, text_hash) for each row of docs.

    Texts are equal when they are the same after deleting every character of `[\\x20\\x09-\\x0D]`; a null text is an
    empty one, and empty texts are equal. Of equal texts the row with the most code points in its original text
    stays, then the one with the smallest id (a null id loses to any other). Repeated rows with one id and one text
    are counted in group_size one by one and share `kept`. An empty table gives no rows; other columns are ignored. Texts of any
    length are compared whole: a chunk has MAX_CHUNK characters at most.
    text_hash is xxhash64 of the original text.
    hash_of may be any function of a chunk column that returns a long: clashes of it are found and resolved.
    """
    space = Workspace(docs.sparkSession, "exact-dedup")
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("raw")).select(
        "doc_id", F.xxhash64("raw").alias("text_hash"), F.length("raw").alias("size"), F.regexp_replace("raw", SPACE_RE, "").alias("norm")
    )
    cut = plain.select("doc_id", "text_hash", "size", F.sha2("norm", 256).alias("text_sha256"), chunks(F.col("norm"), min_chunk, max_chunk).alias("parts"))
    recipes = space.write(
        cut.select(
            F.monotonically_increasing_id().alias("row_id"),
            "doc_id",
            "text_hash",
            "size",
            "text_sha256",
            F.transform("parts", lambda c: F.struct(hash_of(c).cast("long").alias("h"), F.unhex(F.sha2(c, 256)).alias("digest"))).alias("chunks"),
        ),
        "recipes",
    )
    rows = with_verified_ids(recipes)
    first = F.min(F.struct((-F.col("size")).alias("shortness"), F.col("doc_id").isNull().alias("none"), "doc_id"))
    groups = rows.groupBy("ids").agg(first.alias("best"), F.count("*").alias("group_size")).where("group_size > 1")
    # written, so that the join deals both sides itself: a list that a third of all rows share is then split by the skew join
    groups = space.write(groups.select("ids", F.col("best.doc_id").alias("keep_id"), "group_size"), "groups")
    found = rows.join(groups, "ids", "left").withColumn("keep_id", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")))
    return found.select(
        "doc_id", "keep_id", F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "text_hash"
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """exact_dedup_rows without the hash of the original text."""
    return exact_dedup_rows(docs, id_col, text_col).drop("text_hash")
