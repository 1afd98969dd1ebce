import math
import zlib
from collections import Counter

import numpy as np
import pytest
from fixtures import documents, empty, rows

from ionweave.llm import katz
from ionweave.llm.katz import END, START, K, KatzParams, discounts, katz_scores, packed, packed_keys, unpacked, unpacked_keys


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def tokens(text):
    return [*(text or "").encode().lower().split(), END]


class Brute:
    """Katz backoff by dictionaries, recursively per token."""

    def __init__(self, texts, order):
        self.order = order
        self.counts = [Counter() for _ in range(order + 1)]
        for text in texts:
            seq = [START, *tokens(text)]
            for n in range(1, order + 1):
                self.counts[n].update(tuple(seq[i : i + n]) for i in range(len(seq) - n + 1))
        self.words = {g: c for g, c in self.counts[1].items() if g != (START,)} if order else {}
        self.told = []
        for n in range(1, order + 1):
            table = self.words if n == 1 else self.counts[n]
            ns = [sum(1 for c in table.values() if c == r) for r in range(1, K + 2)]
            self.told.append(discounts(sum(table.values()), len(table), ns))
        self.alphas = {}

    def kept(self, n, count):
        return float(self.told[n - 1].kept(np.array([count]))[0])

    def p(self, gram):
        n = len(gram)
        if n == 1:
            c = self.words.get(gram, 0)
            return self.kept(1, c) / self.told[0].total if c else self.told[0].unknown
        c = self.counts[n].get(gram, 0)
        context = self.counts[n - 1].get(gram[:-1], 0)
        if c:
            return self.kept(n, c) / context
        return (self.alpha(gram[:-1]) if context else 1.0) * self.p(gram[1:])

    def alpha(self, context):
        if context not in self.alphas:
            n = len(context) + 1
            seen = [g for g in self.counts[n] if g[:-1] == context]
            mass = sum(self.kept(n, self.counts[n][g]) for g in seen) / self.counts[n - 1][context]
            self.alphas[context] = (1 - mass) / (1 - sum(self.p(g[1:]) for g in seen))
        return self.alphas[context]

    def score(self, text):
        seq = [START, *tokens(text)]
        return sum(math.log10(self.p(tuple(seq[max(0, i - self.order + 1) : i + 1]))) for i in range(1, len(seq)))


def texts_of(table):
    return [(r[0], r[1]) for r in table if not r[1] or len(r[1]) < 20_000]


@pytest.mark.parametrize("order,block", [(1, 10**6), (2, 10**6), (2, 300), (3, 300)])
def test_against_brute_force(spark, order, block):
    table = texts_of(rows())
    model = Brute([t for i, t in table if not held(i)], order)
    docs = documents(spark).where("text is null or length(text) < 20000")
    found = katz_scores(docs, KatzParams(order=order, block_tokens=block, bucket_tokens=100)).collect()
    total, types = sum(model.words.values()), len(model.words)
    want = []
    for i, t in table:
        own = tokens(t)
        counts = [model.words.get((w,), 0) for w in own]
        want.append((i, held(i), len(own), sum(c > 0 for c in counts), total, sum(math.log10((c + 1) / (total + types + 1)) for c in counts), model.score(t)))
    key = lambda r: (repr(r[0]), r[2], r[3], round(r[5], 6))
    for a, b in zip(sorted((tuple(r) for r in found), key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5]
        assert a[5] == pytest.approx(b[5], rel=1e-9) and a[6] == pytest.approx(b[6], rel=1e-6)


def test_probabilities_add_up_to_one():
    table = texts_of(rows())
    model = Brute([t for i, t in table if not held(i)], 3)
    everything = [*model.words, ("unknown",)]
    for context in [(), (START,), *list(model.counts[1])[:6], *[g for g in list(model.counts[2])[:6] if g[-1] != END], ("never",)]:
        if context == (END,):
            continue
        assert sum(model.p((*context, *w)) for w in everything) == pytest.approx(1, abs=1e-9)


def test_cases(spark):
    assert katz_scores(empty(spark)).count() == 0
    only_held = spark.createDataFrame([(i, "a b") for i in range(200) if held(i)], "doc_id long, text string")
    found = katz_scores(only_held).collect()
    assert {(r["train_tokens"], r["n_known"], r["base_score"], r["score"]) for r in found} == {(0, 0, 0.0, 0.0)}


def test_better_than_the_base_on_held_out_texts(spark):
    found = katz_scores(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").collect()
    assert sum(r["score"] for r in found) > sum(r["base_score"] for r in found)


def test_packing():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 63, 1000, dtype=np.uint64) * np.uint64(2))
    assert (unpacked_keys(packed_keys(keys)) == keys).all()
    assert unpacked(packed(np.empty(0)), "<f8").shape == (0,)
    edges = katz.bucket_edges(keys, 7)
    assert edges[0] == 0 and edges[-1] == len(keys)


def test_the_query_sees_contexts_of_two_words(spark, tmp_path):
    from ionweave.llm.queries import op4_lm_scoring

    rows = [(i, t, "en", "s") for i, t in enumerate(["a x b", "c x d"] * 60)]
    rows += [(1000 + i, t, "en", "s") for i in range(60) for t in ("a x b", "c x b")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    found = {r["doc_id"]: r["score"] for r in op4_lm_scoring(spark, str(tmp_path)).collect()}
    b, d = found[0], found[1]
    want = katz_scores(spark.read.parquet(str(tmp_path / "documents.parquet")), KatzParams(order=3))
    assert {r["doc_id"]: r["score"] for r in want.collect()} == pytest.approx(found)
    pairs = katz_scores(spark.read.parquet(str(tmp_path / "documents.parquet")), KatzParams(order=2))
    assert abs({r["doc_id"]: r["score"] for r in pairs.collect()}[0] - b) > 0.05 and d != b
