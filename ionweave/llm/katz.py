"""Language-model scoring with Katz backoff.

P(w | h) = d(c(hw)) c(hw) / c(h) if hw was seen, else alpha(h) P(w | h without its first word), with Good-Turing
discounts d and alpha(h) such that the sum over all words, the unknown one included, is exactly 1.

Whole texts are turned into blocks of about half a million tokens: a local vocabulary of word hashes and an index per token.
Everything gathered from the corpus is exchanged between blocks and buckets of n-gram hashes, as packed arrays: a block sends each
distinct n-gram once with its count, so a word or pair that fills the corpus arrives once per block; a bucket owns the n-grams of its
range and answers each block with the totals and with the n-grams' places in the bucket, by which the block names them when it sends
its sums for the backoff weights. Each length of n-gram is exchanged for itself. Blocks are stored bucketed, so they are read by many steps
and never shuffled. Buckets grow in number with the corpus, and so does what is sent. The
tables of n-gram counts (`grams`) and backoff weights (`backoff`) are stored partitioned by bucket.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionweave.llm.common import Workspace, crc_bucket, text_or_empty

#: Words are known by the upper 56 bits of their hashes, longer n-grams by hashes of 64 bits over them.
WORD_BITS = (1 << 64) - (1 << 8)
#: Hashes of the start mark, which is never predicted, and of the end token; no word has a space.
START, END = (xxhash.xxh3_64_intdigest(x) & WORD_BITS for x in (b" start", b" end"))
#: Counts up to this one get Good-Turing discounts.
K = 5


@dataclass(frozen=True)
class KatzParams:
    order: int = 3
    block_tokens: int = 500_000
    bucket_tokens: int = 3_000_000  # tokens of the corpus for each bucket
    folds: int = 7
    held: int = 2


def packed(values: np.ndarray, level: int = 1) -> bytes:
    """The array's bytes by place, so that equal high bytes stand together, compressed."""
    raw = np.ascontiguousarray(values)
    planes = raw.view(np.uint8).reshape(len(raw), raw.itemsize).T
    return zstandard.ZstdCompressor(level=level).compress(np.ascontiguousarray(planes).tobytes())


def unpacked(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, -1).T).view(kind).ravel()


def packed_keys(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys as their differences."""
    return packed(np.diff(keys, prepend=np.uint64(0)))


def unpacked_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data, "<u8"), dtype=np.uint64)


def bucket_edges(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's range begins and ends in sorted keys."""
    own = (keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
    return np.searchsorted(own, np.arange(buckets + 1, dtype=np.uint64))


# --- blocks -----------------------------------------------------------------------------------------------------

BLOCK = "block long, n_tokens long, ids array<long>, learn binary, lengths binary, vocab binary, tokens binary"
#: Files of the bucketed table at most, Spark's own limit.
MOST_BUCKETED = 100_000


def bucketed(space: Workspace, df: DataFrame, name: str, n: int) -> DataFrame:
    """df written to the shared folder in n buckets of `block`, which a grouping by block reads as they are.

    Spark keeps buckets with a table's name only, so the table has one of its own until it has been looked up; the files stay.
    """
    spark, table = space.spark, f"ionweave_{uuid.uuid4().hex}"
    df.write.format("parquet").option("compression", "uncompressed").option("path", space.path(name)).bucketBy(n, "block").saveAsTable(table)
    found = spark.table(table)
    found.schema  # noqa: B018  looks the table up
    spark.sql(f"DROP TABLE {table}")
    return found


def blocks(docs: DataFrame, p: KatzParams, id_col: str, text_col: str) -> DataFrame:
    """Whole documents in blocks; tokens are the words, ASCII lower-case, and an end. learn marks documents to learn from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32

        class Numbers(dict):
            def __missing__(self, word: bytes) -> int:
                n = self[word] = len(self)
                return n

        def close() -> pa.RecordBatch:
            # words are numbered as they appear, so frequent ones get small numbers, whose high bytes need no room
            vocab = np.fromiter((END if w is None else xxhash.xxh3_64_intdigest(w) & WORD_BITS for w in numbers), np.uint64, len(numbers))
            tokens = np.concatenate(parts).astype("<u4")
            row = [[number], [len(tokens)], [ids], [np.array(learn, np.uint8).tobytes()], [np.array(lengths, "<u4").tobytes()], [packed(vocab)], [packed(tokens, 3)]]
            types = [pa.int64(), pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, types, strict=True)], names=[x.split()[0] for x in BLOCK.split(", ")])

        numbers, parts, ids, learn, lengths, total = Numbers(), [], [], [], [], 0
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                for doc_id, train, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    words = raw.lower().split()  # bytes: A-Z only
                    words.append(None)
                    parts.append(np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words)))
                    ids.append(doc_id)
                    learn.append(train)
                    lengths.append(len(words))
                    total += len(words)
                    if total >= p.block_tokens:
                        yield close()
                        number += 1
                        numbers, parts, ids, learn, lengths, total = Numbers(), [], [], [], [], 0
        if parts:
            yield close()

    held = F.coalesce(crc_bucket(F.col("doc_id"), p.folds) == p.held, F.lit(False))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).cast("binary").alias("raw")).select("doc_id", (~held).alias("learn"), "raw")
    return rows.mapInArrow(run, BLOCK)


def numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct values, a place of each, index among them of every value), by one sort."""
    order = np.argsort(values)
    ordered = values[order]
    new = np.append(np.ones(min(len(values), 1), bool), ordered[1:] != ordered[:-1])
    at = np.empty(len(values), np.int64)
    at[order] = np.cumsum(new) - 1
    return ordered[new], order[new], at


@dataclass
class Level:
    """The distinct n-grams of one length in a block, sorted by hash, and the n-gram at each place that has one."""

    keys: np.ndarray  # hashes
    context: np.ndarray | None  # index of the n-gram's context among the level below
    suffix: np.ndarray | None  # index of the n-gram without its first word among the level below
    at: np.ndarray  # n-gram at each place, -1 without
    counts: np.ndarray  # in documents to learn from


class Block:
    """The levels of a block's n-grams. A start mark stands before each document, so places number tokens plus documents."""

    def __init__(self, row: dict, order: int):
        self.ids, self.learn = row["ids"], np.frombuffer(row["learn"], np.uint8).astype(bool)
        self.lengths = np.frombuffer(row["lengths"], "<u4").astype(np.int64)
        vocab, tokens = unpacked(row["vocab"], "<u8"), unpacked(row["tokens"], "<u4")
        keys = np.append(vocab, np.uint64(START))
        order_of = np.argsort(keys, kind="stable")
        rank = np.empty(len(keys), np.int64)
        rank[order_of] = np.arange(len(keys))
        starts = np.cumsum(self.lengths + 1) - (self.lengths + 1)
        offset = np.arange(len(tokens) + len(starts)) - np.repeat(starts, self.lengths + 1)
        word = np.full(len(offset), rank[-1], np.int64)
        word[offset > 0] = rank[tokens]
        self.starts, self.offset = starts, offset
        train = np.repeat(self.learn, self.lengths + 1)
        self.start_mark = int(rank[-1])
        self.levels = [Level(keys[order_of], None, None, word, np.bincount(word[train], minlength=len(keys)))]
        for n in range(2, order + 1):
            below = self.levels[-1]
            places = np.flatnonzero(offset >= n - 1)
            hashes = (below.keys[below.at[places - 1]] ^ np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15) + keys[order_of][word[places]] * np.uint64(0xC2B2AE3D27D4EB4F)
            hashes ^= hashes >> np.uint64(32)
            hashes *= np.uint64(0xD6E8FEB86659FD93)
            hashes ^= hashes >> np.uint64(29)
            distinct, first, at = numbered(hashes)
            everywhere = np.full(len(offset), -1, np.int64)
            everywhere[places] = at
            counts = np.bincount(at[train[places]], minlength=len(distinct))
            # an n-gram's context ends a place before it, its suffix ends where it ends; any of its places tells both
            self.levels.append(Level(distinct, below.at[places[first] - 1], below.at[places[first]], everywhere, counts))


# --- buckets ----------------------------------------------------------------------------------------------------

ASK = "level int, bucket int, block long, keys binary, counts binary"
STATS = [f"n{r}" for r in range(1, K + 2)]
ANSWER = "level int, bucket int, block long, counts binary, own binary, places binary, total long, types long, " + ", ".join(f"{s} long" for s in STATS)


def ask_counts(table: DataFrame, lengths: range, buckets: int) -> DataFrame:
    """The n-grams of these lengths in each block, by bucket, with their counts in documents to learn from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                block = Block(row, lengths[-1])
                for n in lengths:
                    level = block.levels[n - 1]
                    edges = bucket_edges(level.keys, buckets)
                    rows = [(n, b, row["block"], packed_keys(level.keys[lo:hi]), packed(level.counts[lo:hi].astype("<u4"))) for b, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if hi > lo]
                    types = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["level", "bucket", "block", "keys", "counts"])

    return table.mapInArrow(run, ASK)


def answer_counts(key: tuple, t: pa.Table) -> pa.Table:
    """The total of every n-gram asked for and its place among the bucket's; each one seen is owned by the first block that learned it."""
    t = t.sort_by("block")
    keys = [unpacked_keys(x) for x in t["keys"].to_pylist()]
    counts = np.concatenate([unpacked(x, "<u4") for x in t["counts"].to_pylist()]).astype(np.int64)
    distinct, _, at = numbered(np.concatenate(keys))
    totals = np.bincount(at, weights=counts, minlength=len(distinct)).astype(np.int64)
    learned = np.flatnonzero(counts)
    first = np.full(len(distinct), -1, np.int64)
    first[at[learned][::-1]] = learned[::-1]
    own = np.zeros(len(counts), bool)
    own[first[first >= 0]] = True
    level, bucket = key[0].as_py(), key[1].as_py()
    seen = totals[(totals > 0) & (distinct != np.uint64(START))] if level == 1 else totals[totals > 0]
    ends = np.cumsum([len(k) for k in keys])
    out: dict[str, list] = {x.split()[0]: [] for x in ANSWER.split(", ")}
    for i, (block, end) in enumerate(zip(t["block"].to_pylist(), ends, strict=True)):
        lo = end - len(keys[i])
        figures = [int(seen.sum()), len(seen), *(int((seen == r).sum()) for r in range(1, K + 2))] if i == 0 else [0] * (2 + len(STATS))
        row = [level, bucket, block, packed(totals[at[lo:end]].astype("<u8")), np.packbits(own[lo:end]).tobytes(), packed_keys(at[lo:end].astype(np.uint64)), *figures]
        for column, value in zip(out.values(), row, strict=True):
            column.append(value)
    types = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), *[pa.int64()] * (2 + len(STATS))]
    return pa.table({name: pa.array(c, ty) for (name, c), ty in zip(out.items(), types, strict=True)})


@dataclass(frozen=True)
class Discounts:
    """total: tokens learned; types: distinct ones; by_count[r]: the share of a count r that is kept, r up to K."""

    total: int
    types: int
    by_count: tuple[float, ...]
    unknown: float  # chance of the unknown word

    def kept(self, counts: np.ndarray) -> np.ndarray:
        """d(c) * c; above K a count loses as much as K does, so every context keeps something for unseen words."""
        small = np.minimum(counts, K)
        return np.where(counts <= K, np.array(self.by_count)[small] * counts, counts - K * (1 - self.by_count[K]))


def discounts(total: int, types: int, ns: list[int]) -> Discounts:
    """Good-Turing discounts from the numbers of n-grams with counts 1 to K + 1; where these give no share between 0 and 1, half a count goes."""
    by_count = [0.0]
    n1 = ns[0]
    tail = (K + 1) * ns[K] / n1 if n1 else 1.0
    for r in range(1, K + 1):
        d = -1.0
        if tail < 1 and ns[r - 1]:
            d = ((r + 1) * ns[r] / (r * ns[r - 1]) - tail) / (1 - tail)
        by_count.append(d if 0 < d < 1 else (r - 0.5) / r)
    lost = sum((1 - by_count[r]) * r * ns[r - 1] for r in range(1, K + 1)) + K * (1 - by_count[K]) * (types - sum(ns[:K]))
    return Discounts(total, types, tuple(by_count), lost / total if total else 1.0)


# --- backoff weights and scores ---------------------------------------------------------------------------------

WEIGH = "level int, bucket int, block long, places binary, seen binary, lower binary, counts binary, wants binary"
WEIGHT = "level int, bucket int, block long, weights binary"
#: Sums of probabilities travel as whole numbers of this part, which is below any rounding that a score shows.
PART = 2.0**-32


class Scorer:
    """A block with the answers it got: probabilities of its n-grams, level by level."""

    def __init__(self, row: dict, answers: list[dict], weights: list[dict], order: int, told: list[Discounts]):
        self.block = Block(row, order)
        self.told = told
        levels = self.block.levels
        got = sorted(answers, key=lambda a: (a["level"], a["bucket"]))
        self.counts, self.own = [], []
        named = [unpacked_keys(a["places"]) for a in got if a["places"] is not None]
        self.places = np.concatenate(named) if named else None  # of the n-grams of the level below the last
        for n in range(1, order + 1):
            parts = [unpacked(a["counts"], "<u8").astype(np.int64) for a in got if a["level"] == n]
            bits = [a["own"] for a in got if a["level"] == n]
            own = [np.unpackbits(np.frombuffer(x, np.uint8))[: len(c)].astype(bool) for x, c in zip(bits, parts, strict=True) if x is not None]
            self.counts.append(np.concatenate(parts))
            self.own.append(np.concatenate(own) if own else None)  # of the last level only
        self.chance = [np.where(self.counts[0] > 0, told[0].kept(self.counts[0]) / max(told[0].total, 1), told[0].unknown)]
        self.weights = {n: [unpacked(w["weights"], "<f8") for w in sorted((w for w in weights if w["level"] == n), key=lambda w: w["bucket"])] for n in range(2, order + 1)}
        for n in range(2, order + 1):
            wants = self.wants(n)
            if not self.weights[n] and wants.any():
                break
            level, counts = levels[n - 1], self.counts[n - 1]
            alpha = np.ones(len(levels[n - 2].keys))
            if wants.any():
                alpha[wants] = np.concatenate(self.weights[n])
            below = self.counts[n - 2][level.context]
            with np.errstate(divide="ignore", invalid="ignore"):
                self.chance.append(np.where(counts > 0, told[n - 1].kept(counts) / np.maximum(below, 1), alpha[level.context] * self.chance[n - 2][level.suffix]))

    def wants(self, n: int) -> np.ndarray:
        """Contexts, among the level below n, that were learned and meet an n-gram that wasn't."""
        level, counts = self.block.levels[n - 1], self.counts[n - 1]
        out = np.zeros(len(self.block.levels[n - 2].keys), bool)
        out[level.context[counts == 0]] = True
        return out & (self.counts[n - 2] > 0)

    def sums(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(contexts, kept counts, lower-order chances) summed over the n-grams that this block owns."""
        level = self.block.levels[n - 1]
        own = np.flatnonzero(self.own[n - 1])
        size = len(self.block.levels[n - 2].keys)
        seen = np.bincount(level.context[own], weights=self.told[n - 1].kept(self.counts[n - 1][own]), minlength=size)
        lower = np.bincount(level.context[own], weights=self.chance[n - 2][level.suffix[own]], minlength=size)
        return np.flatnonzero((seen > 0) | self.wants(n)), seen, lower

    def scores(self, base_total: int, base_types: int) -> dict[str, list]:
        block, order = self.block, len(self.block.levels)
        place = np.flatnonzero(block.offset > 0)
        word = block.levels[0].at[place]
        logs = np.log10(np.maximum(self.chance[0][word], 1e-300))
        for n in range(2, order + 1):
            at = block.levels[n - 1].at[place]
            logs = np.where(at >= 0, np.log10(np.maximum(self.chance[n - 1][at], 1e-300)), logs)
        counts = self.counts[0][word]
        base = np.log10((counts + 1) / (base_total + base_types + 1))
        firsts = np.cumsum(block.lengths) - block.lengths
        add = lambda x: np.add.reduceat(x, firsts)  # noqa: E731  every document has its end
        return {
            "doc_id": block.ids,
            "learned": block.learn.tolist(),
            "n_tokens": block.lengths.tolist(),
            "n_known": add((counts > 0).astype(np.int64)).tolist(),
            "train_tokens": [base_total] * len(block.ids),
            "base_score": add(base).tolist(),
            "score": add(logs).tolist(),
        }


def ask_weights(n: int, told: list[Discounts], buckets: int):
    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        for row in left.to_pylist():
            block = _scorer(row, right, n, told)
            contexts, seen, lower = block.sums(n)
            places, counts, wants = block.places[contexts], block.counts[n - 2][contexts], block.wants(n)[contexts]
            edges = bucket_edges(block.block.levels[n - 2].keys[contexts], buckets)
            parts = np.minimum(np.rint(lower / PART), 2**32 - 1).astype("<u4")
            for b, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                if hi > lo:
                    at = contexts[lo:hi]
                    out.append((n, b, row["block"], packed_keys(places[lo:hi]), packed(seen[at]), packed(parts[at]), packed(counts[lo:hi].astype("<u8")), np.packbits(wants[lo:hi]).tobytes()))
        types = [pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 5]
        columns = list(zip(*out, strict=True)) or [[]] * 8
        return pa.table({x.split()[0]: pa.array(c, ty) for x, c, ty in zip(WEIGH.split(", "), columns, types, strict=True)})

    return run


def answer_weights(key: tuple, t: pa.Table) -> pa.Table:
    """alpha = (1 - seen / count) / (1 - lower) of each context, for the blocks that want it."""
    t = t.sort_by("block")
    places = [unpacked_keys(x).astype(np.int64) for x in t["places"].to_pylist()]
    seen = np.concatenate([unpacked(x, "<f8") for x in t["seen"].to_pylist()])
    lower = np.concatenate([unpacked(x, "<u4") for x in t["lower"].to_pylist()]) * PART
    counts = np.concatenate([unpacked(x, "<u8") for x in t["counts"].to_pylist()]).astype(np.float64)
    at = np.concatenate(places)
    n_places = int(at.max(initial=-1)) + 1
    total = np.zeros(n_places)
    total[at] = counts
    mass = np.bincount(at, weights=seen, minlength=n_places) / np.maximum(total, 1)
    rest = 1 - np.bincount(at, weights=lower, minlength=n_places)
    alpha = (1 - mass) / np.maximum(rest, 1e-12)
    blocks, weights, lo = [], [], 0
    for block, own, bits in zip(t["block"].to_pylist(), places, t["wants"].to_pylist(), strict=True):
        wants = np.unpackbits(np.frombuffer(bits, np.uint8))[: len(own)].astype(bool)
        blocks.append(block)
        weights.append(packed(alpha[at[lo : lo + len(own)][wants]]))
        lo += len(own)
    n = len(blocks)
    return pa.table({"level": pa.array([key[0].as_py()] * n, pa.int32()), "bucket": pa.array([key[1].as_py()] * n, pa.int32()), "block": pa.array(blocks, pa.int64()), "weights": pa.array(weights, pa.binary())})


#: What a block gets back: answers with counts and own, weights without.
REPLY = "block long, kind int, level int, bucket int, counts binary, own binary, places binary, weights binary"


def _scorer(row: dict, replies: pa.Table, order: int, told: list[Discounts]) -> Scorer:
    rows = replies.to_pylist()
    return Scorer(row, [r for r in rows if r["kind"] == 0], [r for r in rows if r["kind"] == 1], order, told)


SCORED = "doc_id long, learned boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_blocks(order: int, told: list[Discounts]):
    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        names = [x.split()[0] for x in SCORED.split(", ")]
        parts = [_scorer(row, right, order, told).scores(told[0].total, told[0].types) for row in left.to_pylist()]
        return pa.table({x: pa.array([v for part in parts for v in part[x]], ty) for x, ty in zip(names, types, strict=True)})

    return run


def katz_scores(docs: DataFrame, p: KatzParams = KatzParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of docs.

    Learned from the rows whose crc32(doc_id as text) mod p.folds isn't p.held; a row without id is learned from. Tokens are the
    words of the ASCII-lower-cased text and one end; a null text is an empty one with the end alone. score is the log10
    probability under the model, base_score that of counts plus one. The unknown word is one more type for both. Repeated
    rows are learned as often as they come; texts of any length are taken whole, one alone in a block if need be; other columns are ignored. Without rows to learn from, every token is the unknown word. An empty
    table gives no rows. N-grams are known by 64-bit hashes, words by 56-bit ones.
    """
    spark = docs.sparkSession
    space = Workspace(spark, "katz")
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    of_blocks = min(max(least, 4 * docs.rdd.getNumPartitions()), MOST_BUCKETED)  # so that a task gets a few blocks
    table = bucketed(space, blocks(docs, p, id_col, text_col), "blocks", of_blocks)
    tokens = table.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n")).first()["n"]
    buckets = max(12, -(-tokens // p.bucket_tokens))
    answers = None
    for lengths in (range(1, min(p.order, 2) + 1), *(range(n, n + 1) for n in range(3, p.order + 1))):
        # a task gets a bucket or a few, however many there are
        asked = ask_counts(table, lengths, buckets).repartition(max(least, buckets * len(lengths)), "level", "bucket")
        found = space.write(asked.groupBy("level", "bucket").applyInArrow(answer_counts, ANSWER), f"grams-{lengths[-1]}")
        space.release()
        answers = found if answers is None else answers.unionByName(found)
    figures = {r["level"]: r for r in answers.groupBy("level").agg(*[F.sum(c).alias(c) for c in ("total", "types", *STATS)]).collect()}  # a row per level
    told = [discounts(r["total"], r["types"], [r[s] for s in STATS]) if (r := figures.get(n)) else discounts(0, 0, [0] * len(STATS)) for n in range(1, p.order + 1)]
    none = F.lit(None).cast("binary")
    backoff = None

    def replies(n: int, sums: bool) -> DataFrame:
        """What a block has to know of levels up to n; for sums also what it owns of n and the places of the level below."""
        places, own = (F.when((F.col("level") == level) & F.lit(sums), F.col(c)).alias(c) for level, c in ((n - 1, "places"), (n, "own")))
        out = answers.where(F.col("level") <= n).select("block", F.lit(0).alias("kind"), "level", "bucket", "counts", own, places, none.alias("weights"))
        if backoff is not None:
            out = out.unionByName(backoff.select("block", F.lit(1).alias("kind"), "level", "bucket", none.alias("counts"), none.alias("own"), none.alias("places"), "weights"))
        return out.repartition(of_blocks, "block").groupBy("block")

    for n in range(2, p.order + 1):
        sums = table.groupBy("block").cogroup(replies(n, True)).applyInArrow(ask_weights(n, told, buckets), WEIGH)
        weights = space.write(sums.repartition(max(least, buckets), "level", "bucket").groupBy("level", "bucket").applyInArrow(answer_weights, WEIGHT), f"backoff-{n}")
        space.release()
        backoff = weights if backoff is None else backoff.unionByName(weights)
    scored = table.groupBy("block").cogroup(replies(p.order, False)).applyInArrow(score_blocks(p.order, told), SCORED)
    return scored.select("doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
