"""N-gram Jaccard join with Bayesian candidate pruning (after Satuluri and Parthasarathy, "BayesLSH", 2012).

Texts with one set of word shingles are one set with a number of copies. MinHash bands give buckets; only buckets
with two sets or more go on. Inside them MinHash values are compared step by step, and a pair is dropped as soon as the
posterior probability that its Jaccard similarity reaches the threshold falls below the tolerance. The pairs that
survive tie sets into candidate groups (a spanning forest is enough, so no bucket emits its pairs). A small candidate group is
one block; in a large one the sets that share their largest bucket form blocks of bounded size, and only blocks that some
bucket holds both of meet: the same pruning again, then exact intersection of the shingle sets. So a group that chains many
small buckets together costs what these buckets cost, not all its pairs. A block pair returns a number of links per set and
a forest of them, never the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionweave.llm.common import Workspace, connected_components, filter_by_id, text_or_empty


@dataclass(frozen=True)
class JoinParams:
    words: int = 5  # words of a shingle
    threshold: float = 0.8
    bands: int = 30  # a pair at the threshold misses all of them with probability 7e-6
    rows: int = 5
    tolerance: float = 1e-6  # a pair is dropped when it reaches the threshold with less than this probability
    bucket_block: int = 512  # sets of a bucket, or of each of two parts of it, that are compared in one task
    verify_rows: int = 512  # sets, and bytes of their shingles, in a block of the exact comparison
    verify_bytes: int = 4 << 20
    seed: int = 5

    @property
    def hashes(self) -> int:
        return self.bands * self.rows


def posterior(matches: int, n: int, threshold: float) -> float:
    """P(similarity >= threshold | matches of n hashes agree) under a uniform prior: a binomial tail."""
    total = n + 1  # Beta(matches + 1, n - matches + 1)
    logs = [math.lgamma(total + 1) - math.lgamma(k + 1) - math.lgamma(total - k + 1) + k * math.log(threshold) + (total - k) * math.log1p(-threshold) for k in range(matches + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * sum(math.exp(x - top) for x in logs))


@cache
def prune_table(p: JoinParams) -> list[tuple[int, int]]:
    """(n, least) steps: after n hashes a pair needs at least `least` agreements to stay."""
    steps = sorted({min(p.hashes, n) for n in (16, 32, 64, 96, p.hashes)})
    out = []
    for n in steps:
        least = 0
        while least <= n and posterior(least, n, p.threshold) < p.tolerance:
            least += 1
        out.append((n, least))
    return out


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the windows; a text of fewer words is one shingle of all of them, none has none."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    span = min(width, n)
    rolled = np.full(n - span + 1, span, np.uint64)
    for k in range(span):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + words[k : n - span + 1 + k]
        rolled ^= rolled >> np.uint64(32)
    rolled *= np.uint64(0xD6E8FEB86659FD93)
    rolled ^= rolled >> np.uint64(29)
    return np.unique(rolled)


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) >= 200_000:
            self.clear()
        if len(word) <= 64:
            self[word] = h
        return h

    def of(self, raw: bytes) -> np.ndarray:
        parts = raw.split()
        return np.fromiter(map(self.__getitem__, parts), np.uint64, len(parts))


class MinHasher:
    def __init__(self, p: JoinParams):
        rng = np.random.default_rng(p.seed)
        self.mul = (rng.integers(0, 1 << 32, p.hashes, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
        self.add = rng.integers(0, 1 << 32, p.hashes, dtype=np.uint64).astype(np.uint32)
        self.buffer = np.empty((256, p.hashes), np.uint32)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        low = (shingles >> np.uint64(32)).astype(np.uint32)
        best = np.full(len(self.mul), 0xFFFFFFFF, np.uint32)
        for at in range(0, len(low), 256):
            part = low[at : at + 256]
            room = self.buffer[: len(part)]
            np.multiply(part[:, None], self.mul, out=room)
            np.add(room, self.add, out=room)
            np.minimum(best, room.min(axis=0), out=best)
        return best


def band_keys(signatures: np.ndarray, p: JoinParams) -> np.ndarray:
    """A 64-bit key for each band of each signature (rows)."""
    parts = signatures.reshape(len(signatures), p.bands, p.rows).astype(np.uint64)
    keys = np.broadcast_to(np.arange(1, p.bands + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F), parts.shape[:2]).copy()
    for k in range(p.rows):
        keys = (keys ^ parts[:, :, k]) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(31)
    return keys


SKETCH = "doc_id long, text_hash long, n int, set_key binary, signature binary"


def sketches(docs: DataFrame, p: JoinParams, id_col: str, text_col: str) -> DataFrame:
    """A row per document: size and 128-bit key of its shingle set, and the set's MinHash values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, minhash = WordHashes(), MinHasher(p)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                sizes, keys, signatures = [], [], []
                for raw in batch.column(2).to_pylist():
                    own = shingle_set(hashes.of(raw), p.words)
                    sizes.append(len(own))
                    keys.append(xxhash.xxh3_128_digest(own.tobytes()))
                    signatures.append(minhash.signature(own).tobytes() if len(own) else None)
                arrays = [batch.column(0), batch.column(1), pa.array(sizes, pa.int32()), pa.array(keys, pa.binary()), pa.array(signatures, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "text_hash", "n", "set_key", "signature"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_or_empty(text_col)).alias("text_hash"), text_or_empty(text_col).cast("binary").alias("raw"))
    return rows.mapInArrow(run, SKETCH)


def _band_rows(sets: DataFrame, p: JoinParams) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                signatures = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(batch.num_rows, p.hashes)
                keys = band_keys(signatures, p).astype(np.int64).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(batch.column(0).to_numpy(), p.bands))], names=["key", "sid"])

    return sets.select("sid", "signature").mapInArrow(run, "key long, sid long")


def _agreeing(signatures: np.ndarray, one: int, others: np.ndarray, steps: list[tuple[int, int]]) -> np.ndarray:
    """Those of others that stay a candidate beside `one` through all steps."""
    before, agree = 0, np.zeros(len(others), np.int32)
    for n, least in steps:
        agree = agree + (signatures[others, before:n] == signatures[one, before:n]).sum(axis=1, dtype=np.int32)
        stay = agree >= least
        if not stay.all():
            others, agree = others[stay], agree[stay]
        if not len(others):
            break
        before = n
    return others


def _forest(key: tuple, t: pa.Table, p: JoinParams) -> pa.Table:
    """A spanning forest of the surviving pairs of a bucket, or of two blocks of a large one."""
    steps = prune_table(p)
    t = t.sort_by("sid")
    sids, blocks = t["sid"].to_numpy(), t["block"].to_numpy()
    signatures = np.frombuffer(b"".join(t["signature"].to_pylist()), np.uint32).reshape(len(sids), p.hashes)
    across = key[1].as_py() != key[2].as_py()
    root = np.arange(len(sids))
    a, b = [], []
    for i in range(len(sids)):
        others = np.arange(i + 1, len(sids))
        others = others[(root[i + 1 :] != root[i]) & ((blocks[i + 1 :] != blocks[i]) | (not across))]
        if not len(others):
            continue
        for j in _agreeing(signatures, i, others, steps).tolist():
            if root[j] != root[i]:
                a.append(sids[i])
                b.append(sids[j])
                root[root == root[j]] = root[i]
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of 0/1 blocks over the shingles that two sets share at least."""
    n = len(sets)
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    shingles, column, counts = np.unique(values, return_inverse=True, return_counts=True)
    shared = counts[column] > 1
    column, owner = column[shared], owner[shared]
    place = np.cumsum(counts > 1) - 1
    column = place[column]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    total = int((counts > 1).sum())
    out = np.zeros((n, n), np.float32)
    width = max(256, (8 << 20) // (4 * n))
    for at in range(0, total, width):
        lo, hi = np.searchsorted(column, (at, at + width))
        part = np.zeros((n, min(width, total - at)), np.float32)
        part[owner[lo:hi], column[lo:hi] - at] = 1
        out += part @ part.T
    return out


def _verify(key: tuple, t: pa.Table, p: JoinParams) -> pa.Table:
    """Rows (kind, a, b): 0 for a set and the documents it is linked with in this pair of blocks, 1 for an edge of a forest."""
    steps = prune_table(p)
    t = t.sort_by("sid")
    sids, blocks, copies, sizes = (t[c].to_numpy() for c in ("sid", "block", "copies", "n"))
    n = len(sids)
    across = key[0].as_py() != key[1].as_py()
    signatures = np.frombuffer(b"".join(t["signature"].to_pylist()), np.uint32).reshape(n, p.hashes)
    sets = [np.frombuffer(x, np.uint64) for x in t["shingles"].to_pylist()]
    stay: list[np.ndarray] = []
    for i in range(n):
        others = np.arange(i + 1, n)
        small, large = np.minimum(sizes[others], sizes[i]), np.maximum(sizes[others], sizes[i])
        others = others[(small >= p.threshold * large - 1e-9) & ((blocks[others] != blocks[i]) | (not across))]
        stay.append(_agreeing(signatures, i, others, steps) if len(others) else others)
    pairs = sum(map(len, stay))
    linked = np.zeros((n, n), bool)
    if pairs > 40:
        both = _intersections(sets)
        for i, others in enumerate(stay):
            common = both[i, others]
            linked[i, others] = common >= p.threshold * (sizes[i] + sizes[others] - common) - 1e-9
    else:
        for i, others in enumerate(stay):
            for j in others.tolist():
                common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                linked[i, j] = common >= p.threshold * (sizes[i] + sizes[j] - common) - 1e-9
    linked |= linked.T
    links = linked @ copies.astype(np.int64)
    some = np.flatnonzero(links)
    kinds, a, b = [0] * len(some), sids[some].tolist(), links[some].tolist()
    todo = set(some.tolist())
    while todo:
        front = [min(todo)]
        todo.discard(front[0])
        while front:
            i = front.pop()
            for j in np.flatnonzero(linked[i]).tolist():
                if j in todo:
                    todo.discard(j)
                    front.append(j)
                    kinds.append(1)
                    a.append(int(sids[i]))
                    b.append(int(sids[j]))
    return pa.table({"kind": pa.array(kinds, pa.int32()), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _in_blocks(rows: DataFrame, group: str, number) -> DataFrame:
    """Each row in one of `number` blocks of its group, once for each pair (i, j) of blocks that its own one belongs to."""
    rows = rows.withColumn("parts", number).withColumn("block", F.pmod(F.xxhash64("sid", F.lit(77)), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), (F.col("parts") - 1).cast("int"))))
    return rows.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("other", "parts")


def _placed(space: Workspace, groups: DataFrame, members: DataFrame, p: JoinParams) -> tuple[DataFrame, DataFrame]:
    """((sid, block) of each set, (block, i, j) of each block in the pairs of blocks that meet).

    groups (sid, component, n) and members (key, m, sid) are written. A component of bounded size is one block. In others a
    set's home is its largest bucket, a large home is dealt into several blocks, and blocks meet if a bucket holds sets of both.
    """

    def parts(count: str, shingles: str):
        return F.greatest(F.ceil(F.col(count) / F.lit(p.verify_rows)), F.ceil(F.col(shingles) * 8 / F.lit(p.verify_bytes)))

    sums = F.count("*").alias("count"), F.sum("n").alias("shingles")
    large = space.write(groups.groupBy("component").agg(*sums).where(parts("count", "shingles") > 1).select("component"), "large")  # written, as are other sums that are joined back
    small = groups.join(large, "component", "left_anti").select("sid", F.col("component").alias("block"))
    spread = members.join(groups.join(large, "component", "left_semi").select("sid", "n"), "sid")
    homes = space.write(spread.groupBy("sid", "n").agg(F.max(F.struct("m", "key")).alias("home")).select("sid", "n", "home.key"), "homes")
    home_parts = space.write(homes.groupBy("key").agg(*sums).select("key", parts("count", "shingles").alias("parts")), "home-parts")
    block = F.xxhash64("key", F.pmod(F.xxhash64("sid", F.lit(77)), F.col("parts")))
    dealt = space.write(homes.join(home_parts, "key").select("sid", block.alias("block")), "dealt")
    held = space.write(spread.select("key", "sid").join(dealt, "sid").select("key", "block").distinct(), "held")
    pairs = held.join(held.withColumnRenamed("block", "other"), "key").where("block <= other").select(F.col("block").alias("i"), F.col("other").alias("j"))
    pairs = pairs.distinct().unionByName(small.select(F.col("block").alias("i"), F.col("block").alias("j")).distinct())
    meetings = pairs.select(F.explode(F.array_distinct(F.array("i", "j"))).alias("block"), "i", "j")
    return small.unionByName(dealt), space.write(meetings, "meetings")


def near_duplicate_rows(docs: DataFrame, p: JoinParams = JoinParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (doc_id, class_id, n_links, n_shingles, text_hash, class_key) for each row of docs.

    Words are runs without the six ASCII spaces, as they are; shingles are sets of p.words of them, and a shorter
    text is one shingle of all its words. Two rows are linked if their sets' Jaccard similarity is p.threshold at least;
    n_links counts the rows that a row is linked with, copies included. class_id is the smallest doc_id that links lead to. Texts without
    words (null ones too) have no set: they are linked with nothing, and class_id is their own id. Repeated rows are
    copies of each other. A null id is no smallest id unless its class has no other. Texts of any length are taken whole; an empty
    table gives no rows; other columns are ignored.
    Shingles are known by 64-bit hashes, sets by 128-bit ones. class_key is a number of the class, null without words; text_hash is
    xxhash64 of the text.
    """
    spark = docs.sparkSession
    space = Workspace(spark, "jaccard")
    table = space.write(sketches(docs, p, id_col, text_col), "sketches")
    full = table.where("n > 0")
    sets = full.groupBy("set_key").agg(
        F.count("*").alias("copies"), F.min("doc_id").alias("min_doc"), F.min("text_hash").alias("text_hash"), F.first("n").alias("n"), F.first("signature").alias("signature")
    )
    sets = space.write(sets.withColumn("sid", F.monotonically_increasing_id()), "sets")

    bands = _band_rows(sets, p)
    seen = F.xxhash64("sid")
    crowded = bands.groupBy("key").agg(F.count("*").alias("m"), F.bit_xor(seen).alias("x"), F.bit_xor(F.xxhash64(seen)).alias("y")).where("m > 1")
    # near copies meet in most bands: of the buckets that hold the same sets, by their number and a 128-bit sum, one goes on
    crowded = crowded.groupBy("m", "x", "y").agg(F.min("key").alias("key")).select("key", "m")
    members = space.write(bands.join(crowded, "key"), "members")
    candidates = space.write(filter_by_id(sets.select("sid", "signature"), members.select("sid"), "sid", keep=True), "candidates")
    dealt = _in_blocks(members.join(candidates, "sid"), "key", F.ceil(F.col("m") / F.lit(p.bucket_block)))
    pairs = dealt.select("key", "i", "j", "sid", "block", "signature").groupBy("key", "i", "j").applyInArrow(lambda key, t: _forest(key, t, p), "a long, b long")
    edges = space.write(pairs, "edges")
    space.drop("candidates")
    space.release()

    groups = connected_components(space, edges, "groups").withColumnRenamed("node", "sid")
    groups = space.write(groups.join(sets.select("sid", "n"), "sid"), "grouped")
    placed, meetings = _placed(space, groups, members, p)
    wanted = space.write(placed.join(sets, "sid"), "wanted")
    space.drop("members")

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                own = [shingle_set(hashes.of(raw), p.words).tobytes() for raw in whole.column(0).slice(at, 512).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(x) for x in own], pa.binary()), pa.array(own, pa.binary())], names=["set_key", "shingles"])

    texts = docs.select(F.xxhash64(text_or_empty(text_col)).alias("text_hash"), text_or_empty(text_col).cast("binary").alias("raw"))
    texts = filter_by_id(texts, wanted.select("text_hash"), "text_hash", keep=True).dropDuplicates(["text_hash"]).select("raw")
    contents = texts.mapInArrow(shingles, "set_key binary, shingles binary")
    rows = wanted.select("set_key", "sid", "block", "copies", "n", "signature").join(contents, "set_key").drop("set_key")
    meeting = rows.join(meetings, "block")
    checked = space.write(meeting.groupBy("i", "j").applyInArrow(lambda key, t: _verify(key, t, p), "kind int, a long, b long"), "checked")
    space.drop("edges")
    space.release()

    classes = connected_components(space, checked.where("kind = 1").select("a", "b"), "classes")
    least = classes.join(sets.select(F.col("sid").alias("node"), "min_doc"), "node").groupBy("component").agg(F.min("min_doc").alias("class_id"))
    least = space.write(least, "least")
    of_set = classes.join(least, "component").select(F.col("node").alias("sid"), "component", "class_id")
    links = checked.where("kind = 0").groupBy(F.col("a").alias("sid")).agg(F.sum("b").alias("links"))
    known = sets.select("sid", "set_key", "copies", "min_doc").join(of_set, "sid", "left").join(links, "sid", "left")
    known = known.select(
        "set_key", F.coalesce("class_id", "min_doc").alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "sid").alias("class_key")
    )
    known = space.write(known, "known")
    linked = full.select("doc_id", "set_key", "n", "text_hash").join(known, "set_key").select("doc_id", "class_id", "n_links", F.col("n").alias("n_shingles"), "text_hash", "class_key")
    alone = F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("n").alias("n_shingles"), "text_hash", F.lit(None).cast("long").alias("class_key")
    return linked.unionByName(table.where("n = 0").select("doc_id", *alone))


def near_duplicates(docs: DataFrame, p: JoinParams = JoinParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """near_duplicate_rows without the keys of rows and classes."""
    return near_duplicate_rows(docs, p, id_col, text_col).drop("text_hash", "class_key")
