"""Quality classifier: supervised subword embeddings.

Words, their character n-grams and the n-grams of consecutive words are hashed into rows of an embedding matrix. A document
is the mean of its rows, followed by a softmax over the classes; both matrices are learned by numpy stochastic gradient descent on a bounded
sample of labelled rows. As the model is linear up to the softmax, each hashed row is folded into the one number it
adds to the class margin before scoring, so a text costs a few lookups per word and executors get a few MB.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionweave.llm.common import bounded_batches, crc_bucket, text_or_empty


@dataclass(frozen=True)
class ClassifierParams:
    buckets: int = 1 << 19
    dim: int = 4
    ngrams: tuple[int, ...] = (3, 4)  # characters
    word_ngrams: tuple[int, ...] = (2, 3, 4)
    epochs: int = 6
    rate: float = 2.0
    max_rows: int = 6_000  # documents to learn from at most, chosen by a hash of their id
    max_chars: int = 24_000_000  # and their characters in all
    cache: int = 150_000  # words that a worker remembers
    seed: int = 17


def word_features(words: list[str], p: ClassifierParams) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, sizes): the buckets of all words one after another, and how many each word has.

    A word has its own bucket and those of the character n-grams of `<word>`. All n-grams of all words are hashed at
    once over the code points of the joined words; those that would cross from one word into the next are left out.
    """
    marked = [f"<{w}>" for w in words]
    lengths = np.array([len(m) for m in marked], np.int64)
    points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.cumsum(lengths) - lengths
    owner = np.repeat(np.arange(len(words)), lengths)
    room = np.repeat(starts + lengths, lengths) - np.arange(len(points))  # characters from here to the word's end
    buckets = [word_hashes(words)]
    owners = [np.arange(len(words))]
    for n in p.ngrams:
        h = np.full(max(len(points) - n + 1, 0), n, np.uint32)
        for k in range(n):
            h = h * np.uint32(0x01000193) + points[k : len(points) - n + 1 + k]
            h ^= h >> np.uint32(13)
        h *= np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(15)
        inside = room[: len(h)] >= n
        buckets.append(h[inside])
        owners.append(owner[: len(h)][inside])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return (np.concatenate(buckets)[order] & np.uint32(p.buckets - 1)).astype(np.int32), np.bincount(owner, minlength=len(words))


def word_hashes(words: list[str]) -> np.ndarray:
    return np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words], np.uint32)


def word_ngram_buckets(hashes: np.ndarray, n: int, p: ClassifierParams) -> np.ndarray:
    """The bucket of the n-gram of words that begins at each place; hashes are the words' own."""
    count = max(len(hashes) - n + 1, 0)
    h = np.full(count, n, np.uint32)
    for k in range(n):
        h = (h ^ hashes[k : k + count]) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
    return (h & np.uint32(p.buckets - 1)).astype(np.int32)


def document_features(text: str, p: ClassifierParams) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, weights) of a document's mean; the weights add up to 1, or there are none.

    A word is the mean of its own bucket and its character n-grams'; words and n-grams of words weigh the same.
    """
    words = text.split()
    if not words:
        return np.empty(0, np.int32), np.empty(0, np.float32)
    number: dict[str, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words])
    buckets, sizes = word_features(list(number), p)
    hashes = word_hashes(list(number))[ids]
    grams = [word_ngram_buckets(hashes, n, p) for n in p.word_ngrams]
    every = np.concatenate([buckets, *grams])
    counts = np.ones(len(every))
    counts[: len(buckets)] = np.repeat(np.bincount(ids) / sizes, sizes)
    unique, at = np.unique(every, return_inverse=True)
    weights = np.bincount(at, weights=counts)
    return unique, (weights / weights.sum()).astype(np.float32)


@dataclass(frozen=True)
class FoldedModel:
    """What each bucket adds to the margin of class 1 over class 0, and the margin of a text without words."""

    margins: np.ndarray
    bias: float

    def save(self) -> bytes:
        return np.append(self.margins, self.bias).astype("<f4").tobytes()


def fit(texts: list[str], labels: list[int], p: ClassifierParams = ClassifierParams()) -> FoldedModel:
    """Learns from the texts in an order of its own. With labels of one class only, every score is that share."""
    share = (sum(labels) + 0.5) / (len(labels) + 1.0) if labels else 0.5
    prior = math.log(share / (1 - share))
    if len(set(labels)) < 2:
        return FoldedModel(np.zeros(p.buckets, np.float32), prior)
    rng = np.random.default_rng(p.seed)
    docs = [document_features(t, p) for t in texts]
    rows = rng.uniform(-1.0, 1.0, (p.buckets, p.dim)).astype(np.float32) / p.dim
    out = np.zeros((2, p.dim), np.float32)
    bias = np.array([0.0, prior], np.float32)
    steps, done = p.epochs * len(docs), 0
    for _ in range(p.epochs):
        for i in rng.permutation(len(docs)):
            rate = p.rate * (1 - done / steps)
            done += 1
            ids, weights = docs[i]
            if not len(ids):
                continue
            own = rows[ids]
            hidden = weights @ own
            logits = out @ hidden + bias
            chance = np.exp(logits - logits.max())
            chance /= chance.sum()
            error = -chance
            error[labels[i]] += 1.0
            back = error @ out
            # steps are divided by what they move the logits by, so that no document, however few or heavy its rows, overshoots
            step = rate / (1.0 + float(hidden @ hidden) + float((out * out).sum()) / 2)
            out += step * np.outer(error, hidden)
            bias += step * 0.1 * error
            rows[ids] = own + np.outer(weights * (step / float(weights @ weights)), back)
    if not np.isfinite(rows).all() or not np.isfinite(out).all():
        raise FloatingPointError("the classifier's weights are not finite")
    return FoldedModel(rows @ (out[1] - out[0]), float(bias[1] - bias[0]))


def training_sample(docs: DataFrame, labels: DataFrame, p: ClassifierParams, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> tuple[list[str], list[int]]:
    """At most p.max_rows whole texts with at most p.max_chars characters, in an order by hash of the id.

    Labels other than 0 and 1, and ids whose labels differ, aren't used. Of several texts of one id the shortest counts, then the one
    with the least hash. Only this bounded sample reaches the driver.
    """
    clear = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    clear = clear.groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.min(label_col).alias("y"), F.max(label_col).alias("y2")).where("y = y2")
    picked = clear.orderBy(F.xxhash64("doc_id", F.lit(p.seed)), "doc_id").limit(p.max_rows).select("doc_id", "y")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).withColumn("h", F.xxhash64("text"))
    found = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "y").agg(F.min(F.struct(F.length("text").alias("n"), "h")).alias("least"))
    sizes = found.select("doc_id", "y", "least.n", "least.h").orderBy(F.xxhash64("doc_id", F.lit(p.seed)), "doc_id").collect()
    take, total = [], 0
    for row in sizes:
        if total + row["n"] <= p.max_chars:
            total += row["n"]
            take.append((row["doc_id"], row["y"], row["h"]))
    if not take:
        return [], []
    chosen = F.broadcast(docs.sparkSession.createDataFrame(take, "doc_id long, y int, h long"))
    rows = {r["doc_id"]: r["text"] for r in texts.join(chosen, ["doc_id", "h"]).dropDuplicates(["doc_id"]).collect()}
    return [rows[i] for i, _, _ in take], [y for _, y, _ in take]


def _scorer(saved: bytes, p: ClassifierParams):
    """A function from texts to their scores. What words add is worked out for many new words at once, and remembered up to a bound."""
    values = np.frombuffer(saved, "<f4")
    bias, margin = float(values[-1]), values[:-1].astype(np.float64)
    number: dict[str, int] = {}
    means, hashes = np.empty(0), np.empty(0, np.uint32)  # of each word: the mean of what its buckets add, its hash

    def learn(words: list[str]) -> None:
        nonlocal means, hashes
        for at in range(0, len(words), 20_000):
            part = words[at : at + 20_000]
            buckets, own = word_features(part, p)
            number.update(zip(part, range(len(number), len(number) + len(part)), strict=True))
            means = np.append(means, np.add.reduceat(margin[buckets], np.cumsum(own) - own) / own)
            hashes = np.append(hashes, word_hashes(part))

    def score_of(texts: list[str]) -> list[float]:
        nonlocal means, hashes
        split = [text.split() for text in texts]
        wanted = set().union(*split)
        if len(number) + len(wanted) > p.cache:
            number.clear()
            means, hashes = means[:0], hashes[:0]
        learn([w for w in wanted if w not in number])
        out = []
        for words in split:
            ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
            total, n = float(means[ids].sum()), len(ids)
            own = hashes[ids]
            for size in p.word_ngrams:
                buckets = word_ngram_buckets(own, size, p)
                total += float(margin[buckets].sum())
                n += len(buckets)
            z = bias + (total / n if n else 0.0)
            out.append(1 / (1 + math.exp(-z)) if z > -700 else 0.0)
        return out

    return score_of


def score(docs: DataFrame, model: FoldedModel, p: ClassifierParams, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, score) for every row of docs; score is the softmax's chance of class 1."""
    bounded_batches(docs.sparkSession)
    saved = docs.sparkSession.sparkContext.broadcast(model.save())  # p.buckets floats, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score_of = _scorer(saved.value, p)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                scores = score_of(batch.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, model: FoldedModel, p: ClassifierParams, threshold: float, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose score reaches the threshold."""
    bounded_batches(docs.sparkSession)
    saved = docs.sparkSession.sparkContext.broadcast(model.save())
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score_of = _scorer(saved.value, p)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                scores = score_of([text or "" for text in batch.column(place).to_pylist()])
                yield batch.filter(pa.array([s >= threshold for s in scores], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def quality_classifier(docs: DataFrame, labels: DataFrame, p: ClassifierParams = ClassifierParams(), threshold: float = 0.7, folds: int = 4, held: int = 2) -> DataFrame:
    """One row (doc_id, held_out, score, predicted) for each row of docs, learned from the rows that aren't held out.

    held_out: crc32(doc_id as text) mod folds is `held`; a null id isn't held out and is scored. The score depends
    on the text alone; null and empty texts get the bias's score. Without labels of both classes all get the labels' share (0.5
    without any). Texts of any length are scored whole. Repeated rows are scored each; an empty table gives no rows; other columns
    are ignored.
    """
    out = F.coalesce(crc_bucket(F.col("doc_id"), folds) == held, F.lit(False))
    model = fit(*training_sample(docs, labels.where(~out), p), p)
    scored = score(docs, model, p)
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
