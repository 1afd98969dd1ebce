"""Token counts by a linear longest-match automaton.

Greedy word-piece splitting takes the longest vocabulary entry at the start of a word, then the longest continuation
piece again and again. Counting needs no pieces: a trie over both vocabularies gets failure links, and with each link
the number of pieces that it pops, so one walk over a word's bytes counts them (Song et al., "Fast WordPiece
Tokenization", 2021).
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionweave.llm.common import bounded_batches, text_or_empty

#: Distinct words that a worker remembers.
CACHE = 200_000


class LongestMatchCounter:
    """Counts greedy longest-match pieces of a word; a word that can't be split counts as one unknown piece.

    initial: pieces that may begin a word; continuation: those that may follow. Empty entries are ignored.
    """

    def __init__(self, initial: Iterable[bytes], continuation: Iterable[bytes]):
        self.next: dict[int, int] = {}  # node * 256 + byte -> node
        parent, byte, ends, self._size = [0, 0], [0, 0], [False, False], 2  # node 0 begins a word, node 1 a continuation
        for root, vocabulary in ((0, initial), (1, continuation)):
            for piece in vocabulary:
                if not piece:
                    continue
                node = root
                for b in piece:
                    key = node << 8 | b
                    if key not in self.next:
                        self.next[key] = len(parent)
                        parent.append(node)
                        byte.append(b)
                        ends.append(False)
                    node = self.next[key]
                ends[node] = True
        n = len(parent)
        self.link, self.pops = [-1] * n, [0] * n
        depth = [0] * n
        for v in range(2, n):  # a parent has the smaller number
            depth[v] = depth[parent[v]] + 1
        for v in sorted(range(2, n), key=depth.__getitem__):
            if ends[v]:  # the whole path is one piece
                self.link[v], self.pops[v] = 1, 1
                continue
            u, b, popped = parent[v], byte[v], self.pops[parent[v]]
            z = self.link[u]
            while z >= 0 and (z << 8 | b) not in self.next:
                popped += self.pops[z]
                z = self.link[z]
            if z >= 0:
                self.link[v], self.pops[v] = self.next[z << 8 | b], popped

    def count(self, word: bytes) -> int:
        follow, link, pops = self.next, self.link, self.pops
        node, total = 0, 0
        for b in word:
            while (to := follow.get(node << 8 | b)) is None:
                total += pops[node]
                node = link[node]
                if node < 0:
                    return 1
            node = to
        while node != 1:  # what is left is popped as far as it goes
            if node == 0:
                return total
            total += pops[node]
            node = link[node]
            if node < 0:
                return 1
        return total


def byte_bpe_vocabulary(ranks_path: str) -> tuple[list[bytes], list[bytes]]:
    """(initial, continuation) pieces of a byte-level vocabulary file of base64 tokens.

    Entries with a leading space begin words, the others continue them; every single byte may do both, so no word is unknown.
    """
    with open(ranks_path, "rb") as lines:
        tokens = [base64.b64decode(line.split()[0]) for line in lines if line.strip()]
    single = [bytes([b]) for b in range(256)]
    initial = [t[1:] for t in tokens if t[:1] == b" " and len(t) > 1]
    return single + initial, single + [t for t in tokens if t[:1] != b" "]


_COUNTERS: dict[bytes, LongestMatchCounter] = {}


def token_counts(docs: DataFrame, vocabulary: tuple[list[bytes], list[bytes]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (doc_id, n_bytes, n_words, n_tokens) for each row of docs.

    Words are runs without the six ASCII spaces, counted on their UTF-8 bytes. A null text is an empty one with no
    words; texts and words of any length are counted whole. Repeated rows are counted each; an empty table gives no rows; other
    columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # as large as the vocabulary, whatever the corpus
    name = hashlib.sha256(repr(vocabulary).encode()).digest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (counter := _COUNTERS.get(name)) is None:
            _COUNTERS.clear()
            counter = _COUNTERS[name] = LongestMatchCounter(*shared.value)

        class Known(dict):
            def __missing__(self, word: bytes) -> int:
                n = counter.count(word)
                if len(self) >= CACHE:
                    self.clear()
                if len(word) <= 64:
                    self[word] = n
                return n

        known = Known()
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                sizes, words, tokens = [], [], []
                for raw in batch.column(1).to_pylist():
                    parts = raw.split()
                    sizes.append(len(raw))
                    words.append(len(parts))
                    tokens.append(sum(map(known.__getitem__, parts)))
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (sizes, words, tokens))], names=["doc_id", "n_bytes", "n_words", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).cast("binary").alias("raw"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_words long, n_tokens long")
