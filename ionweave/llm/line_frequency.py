"""Quality rules with cross-document line frequency.

A first pass over whole texts takes each document's own figures and the hashes of its normalised lines. Lines are
counted by the number of distinct documents of a host that hold them (copies of one text are one document); lines
above the limit are boilerplate. A second pass removes them from the texts, and a document that is left with too
little of its text is rejected.
"""

from __future__ import annotations

import re
from collections.abc import Container, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ionweave.llm.common import Workspace, text_or_empty

SYMBOLS = re.compile(r"[#*$%&|<>]")
DIGITS = re.compile(rb"[0-9]+")


@dataclass(frozen=True)
class LineParams:
    min_docs: int = 20  # a boilerplate line is in more distinct documents of its host than this
    min_share: float = 0.01  # and in more than this share of them
    min_left: float = 0.3  # a document that is left with less than this share of its words is rejected
    min_words: int = 20  # fewer words fail the base rules
    max_repeat: int = 30  # percent of words in repeated windows
    window: int = 8


def covered_by_repeats(ids: np.ndarray, window: int) -> int:
    """Words that stand in a window of that many words which the text has twice or more.

    ids: a number from 0, below their count, for each word, equal for equal words. A rolling hash finds texts without any repeat; others are
    compared exactly, by numbering the distinct pairs of ever longer windows.
    """
    n = len(ids)
    if n <= window:
        return 0
    mixed = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    rolled = np.zeros(n - window + 1, np.uint64)
    for k in range(window):
        rolled = rolled * np.uint64(0xD6E8FEB86659FD93) + mixed[k : n - window + 1 + k]
    rolled.sort()
    if not (rolled[1:] == rolled[:-1]).any():
        return 0
    level, span = ids.astype(np.int64), 1
    while span < window:
        more = min(span, window - span)
        pairs = level[: n - span - more + 1] * np.int64(n + 1) + level[more : n - span + 1]
        level = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
        span += more
    again = np.bincount(level)[level] > 1
    edge = np.zeros(n + 1, np.int64)
    starts = np.flatnonzero(again)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def normal_line(line: bytes) -> bytes:
    """Lower-case ASCII, single spaces, digits as one 0."""
    return DIGITS.sub(b"0", b" ".join(line.lower().split()))


def line_hash(line: bytes) -> int:
    return xxhash.xxh3_64_intdigest(normal_line(line)) - (1 << 63)


def without_lines(text: str, gone: Container[int]) -> str:
    """The text without its lines whose hash is in `gone`; all other lines stay as they are, blank ones too."""
    return b"\n".join(line for line in text.encode().split(b"\n") if not line.strip() or line_hash(line) not in gone).decode()


FACTS = "row_id long, doc_id long, host string, text string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, copy long, lines binary"
#: Boilerplate lines that are sent to every task as a set, about 20 MB; more of them are joined to the rows that hold them.
SENT_LINES = 200_000


def facts(docs: DataFrame, p: LineParams, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """A document's text and its own figures; `lines` are the 64-bit hashes of its distinct normalised lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        class Numbers(dict):
            def __missing__(self, word: bytes) -> int:
                n = self[word] = len(self)
                return n

        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                out: list[list] = [[] for _ in range(7)]
                for text in batch.column(3).to_pylist():
                    raw = text.encode()
                    words = raw.split()
                    numbers = Numbers()
                    ids = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
                    chars = len(raw) if text.isascii() else len(text)
                    spaces = len(raw) - sum(map(len, words))
                    seen: set[bytes] = set()
                    dup = 0
                    hashes: set[int] = set()
                    for line in raw.split(b"\n"):
                        if not line.strip():
                            continue
                        if line in seen:
                            dup += 1
                        else:
                            seen.add(line)
                            hashes.add(line_hash(line))
                    row = (
                        len(words),
                        chars - spaces,
                        len(SYMBOLS.findall(text)),
                        dup,
                        covered_by_repeats(ids, p.window) if len(numbers) < len(words) else 0,
                        xxhash.xxh3_64_intdigest(raw) - (1 << 63),
                        np.fromiter(hashes, "<i8", len(hashes)).tobytes(),
                    )
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                arrays = [pa.array(c, pa.int64() if k < 6 else pa.binary()) for k, c in enumerate(out)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], *arrays], names=[x.split()[0] for x in FACTS.split(", ")])

    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(id_col).cast("long").alias("doc_id"), F.col(host_col).cast("string").alias("host"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, FACTS)


def _line_rows(table: DataFrame) -> DataFrame:
    """(row_id, host_key, line) for each distinct line of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                lines = [np.frombuffer(x, "<i8") for x in batch.column(2).to_pylist()]
                sizes = np.array([len(x) for x in lines], np.int64)
                keys = [pa.array(np.repeat(batch.column(k).to_numpy(zero_copy_only=False), sizes)) for k in range(2)]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(np.concatenate([np.empty(0, "<i8"), *lines]))], names=["row_id", "host_key", "line"])

    return table.select("row_id", _host_key().alias("host_key"), "lines").mapInArrow(run, "row_id long, host_key long, line long")


def _host_key() -> Column:
    return F.xxhash64("host", F.col("host").isNull())


FIGURES = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def _cleaned(table: DataFrame, common: DataFrame, most_sent: int) -> DataFrame:
    """(FIGURES, text, n_left): each row's text without the boilerplate lines of its host, and the words that are left.

    The lines go to every task where they are counted at most_sent at most; else each row gets its own by a join on row_id.
    """
    spark = table.sparkSession
    names = [x.split()[0] for x in FIGURES.split(", ")]
    sent = None
    if common.limit(most_sent + 1).count() <= most_sent:
        of_host: dict[int, set[int]] = {}
        for host_key, line in common.collect():
            of_host.setdefault(host_key, set()).add(line)
        sent = spark.sparkContext.broadcast(of_host)
        rows = table.select(*names, "text", "lines", _host_key().alias("host_key"))
    else:  # a line in very many documents is split by the skew join
        gone = _line_rows(table).join(common, ["host_key", "line"]).groupBy("row_id").agg(F.collect_list("line").alias("gone"))
        rows = table.join(gone, "row_id", "left").select(*names, "text", "gone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                if sent is None:
                    found = [set(x) if x else set() for x in batch.column("gone").to_pylist()]
                else:
                    hosts = batch.column("host_key").to_pylist()
                    found = [sent.value.get(h, set()).intersection(np.frombuffer(x, "<i8").tolist()) for h, x in zip(hosts, batch.column("lines").to_pylist(), strict=True)]
                before = batch.column("n_words").to_pylist()
                texts, left = batch.column("text").to_pylist(), list(before)
                for k, gone in enumerate(found):
                    if gone:
                        texts[k] = without_lines(texts[k], gone)
                        left[k] = len(texts[k].encode().split())
                yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(texts, pa.string()), pa.array(left, pa.int64())], names=[*names, "text", "n_left"])

    return rows.mapInArrow(run, f"{FIGURES}, text string, n_left long")


def clean_documents(docs: DataFrame, p: LineParams = LineParams(), id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", most_sent: int = SENT_LINES) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, text, n_line_words, base_failed, kept.

    `text` is without the boilerplate lines of its host, which held n_line_words words; the corpus is `text` where
    `kept`. A null text is an empty one: no words, base_failed. A null host is a host of its own. Of equal texts one
    counts as a document of its host, so a group of exact copies doesn't make its lines boilerplate. Repeated rows are
    judged alike; texts and lines of any length are read whole; an empty table gives no rows; other columns are ignored.
    """
    space = Workspace(docs.sparkSession, "quality-rules")
    table = space.write(facts(docs, p, id_col, text_col, host_col), "facts")
    hosts = table.select(_host_key().alias("host_key"), "copy").distinct().groupBy("host_key").agg(F.count("*").alias("host_docs"))
    distinct = _line_rows(table.select("row_id", "host", "copy", "lines").dropDuplicates(["host", "copy"]))  # one document of each host's equal texts
    counts = distinct.groupBy("host_key", "line").agg(F.count("*").alias("n")).where(F.col("n") > p.min_docs)
    common = space.write(counts.join(hosts, "host_key").where(F.col("n") > F.col("host_docs") * p.min_share).select("host_key", "line"), "common")
    failed = (F.col("n_words") < p.min_words) | (100 * F.col("n_repeat_words") > p.max_repeat * F.col("n_words"))
    depleted = (F.col("n_line_words") > 0) & (F.col("n_left") < p.min_left * F.col("n_words"))
    judged = _cleaned(table, common, most_sent).withColumn("n_line_words", F.col("n_words") - F.col("n_left"))
    return judged.withColumn("base_failed", failed).withColumn("kept", ~failed & ~depleted).drop("n_left")


def quality_rules(docs: DataFrame, p: LineParams = LineParams(), id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The figures and verdicts of clean_documents, taken from the cleaned texts, without these."""
    return clean_documents(docs, p, id_col, text_col, host_col).drop("text")
