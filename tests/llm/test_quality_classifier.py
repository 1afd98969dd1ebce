import math
import zlib

import numpy as np
import pytest
from fixtures import documents, empty, rows

from ionweave.llm.quality_classifier import ClassifierParams, FoldedModel, _scorer, document_features, fit, quality_classifier, word_features


def test_folded_score_is_the_models():
    p = ClassifierParams(buckets=1 << 10, epochs=2)
    model = fit(["good clean words here", "bad!! bad!! bad!!", "more good clean words", "bad!! junk!!"], [1, 0, 1, 0], p)
    score_of = _scorer(model.save(), p)
    for text in ("good words", "bad!! bad!!", "nothing seen", "a a a b"):
        ids, weights = document_features(text, p)
        z = float(weights @ model.margins[ids]) + model.bias
        assert abs(score_of([text])[0] - 1 / (1 + math.exp(-z))) < 1e-4
    texts = ["good words", "", "bad!! é 日本", " \n", "x" * 3000]
    assert score_of(texts) == [score_of([t])[0] for t in texts]
    assert score_of([""]) == score_of([" \n"])


def test_features_are_the_words_own():
    p = ClassifierParams(buckets=1 << 18)
    words = ["ab", "a", "日本語", "abc", "a"]
    buckets, sizes = word_features(words, p)
    parts = np.split(buckets, np.cumsum(sizes)[:-1])
    assert sizes.tolist() == [1 + len(w) + 2 - 2 + max(len(w) + 2 - 3, 0) for w in words]
    for w, part in zip(words, parts):
        assert part.tolist() == word_features([w], p)[0].tolist()
    assert parts[1].tolist() == parts[4].tolist() and parts[1].tolist() != parts[0].tolist()[:3]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    found = quality_classifier(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in found)
    good = [r["predicted"] for r in found if r["quality"] == 1]
    bad = [1 - r["predicted"] for r in found if r["quality"] == 0]
    assert sum(good) / len(good) > 0.95 and sum(bad) / len(bad) > 0.6
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in found)


def test_cases(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (6, 0), (13, 0), (None, 1), (99, 1), (5, None), (4, 7)], "doc_id long, quality int")
    p = ClassifierParams(buckets=1 << 10, epochs=2)
    found = quality_classifier(documents(spark), labels, p).collect()
    assert sorted((r["doc_id"] for r in found), key=repr) == sorted((r[0] for r in rows()), key=repr)
    assert len({r["score"] for r in found if r["doc_id"] in (7, 8, 9)}) == 1
    assert {r["held_out"] for r in found if r["doc_id"] is None} == {False}
    assert quality_classifier(empty(spark), labels, p).count() == 0
    alone = quality_classifier(documents(spark), labels.where("quality = 1"), p).collect()
    assert len({r["score"] for r in alone}) == 1
    assert {r["score"] for r in quality_classifier(documents(spark), labels.limit(0), p).collect()} == {0.5}


def test_bounds_of_the_sample(spark):
    from ionweave.llm.quality_classifier import training_sample

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    texts, ys = training_sample(docs, labels, ClassifierParams(max_rows=50, max_chars=20_000))
    assert 0 < len(texts) <= 50 and sum(map(len, texts)) <= 20_000 and len(texts) == len(ys)
    assert isinstance(fit([], []), FoldedModel)


def test_learning_stays_finite_on_heavy_documents():
    import random

    rng = random.Random(1)
    clean = [" ".join(f"{rng.choice('abcdefgh')}{rng.choice('aeiou')}{rng.choice('nrst')}" for _ in range(80)) for _ in range(150)]
    heavy = ["of " * rng.randrange(50, 4000) for _ in range(60)] + [("is onhe. " * 300) + c for c in clean[:20]] + ["x"] * 10
    model = fit(clean + heavy, [1] * len(clean) + [0] * len(heavy), ClassifierParams())
    assert np.isfinite(model.margins).all() and math.isfinite(model.bias)
    scores = _scorer(model.save(), ClassifierParams())(clean + heavy)
    assert min(scores[: len(clean)]) > 0.7 and max(scores[len(clean) :]) < 0.5


def plain_features(text, p):
    """Shares of a document's mean by bucket, one word and one n-gram at a time."""
    words, out = text.split(), {}

    def add(bucket, weight):
        out[bucket] = out.get(bucket, 0.0) + weight

    crc = lambda w: zlib.crc32(w.encode())
    for w in words:
        grams = [crc(w) & (p.buckets - 1)]
        marked = f"<{w}>"
        for n in p.ngrams:
            for i in range(len(marked) - n + 1):
                h = n
                for c in marked[i : i + n]:
                    h = (h * 0x01000193 + ord(c)) & 0xFFFFFFFF
                    h ^= h >> 13
                h = h * 0x85EBCA6B & 0xFFFFFFFF
                grams.append((h ^ h >> 15) & (p.buckets - 1))
        for g in grams:
            add(g, 1 / len(grams))
    for n in p.word_ngrams:
        for i in range(len(words) - n + 1):
            h = n
            for w in words[i : i + n]:
                h = (h ^ crc(w)) * 0x9E3779B1 & 0xFFFFFFFF
                h ^= h >> 15
            add(h & (p.buckets - 1), 1.0)
    total = sum(out.values())
    return {b: v / total for b, v in out.items()}


def plain_fit(texts, labels, p):
    """The same steps of gradient descent on a softmax, in loops over numbers."""
    rng = np.random.default_rng(p.seed)
    docs = [plain_features(t, p) for t in texts]
    rows = (rng.uniform(-1.0, 1.0, (p.buckets, p.dim)).astype(np.float32) / p.dim).astype(float).tolist()
    out = [[0.0] * p.dim for _ in range(2)]
    share = (sum(labels) + 0.5) / (len(labels) + 1)
    bias = [0.0, math.log(share / (1 - share))]
    done = 0
    for _ in range(p.epochs):
        for i in rng.permutation(len(docs)):
            rate = p.rate * (1 - done / (p.epochs * len(docs)))
            done += 1
            hidden = [sum(w * rows[b][k] for b, w in docs[i].items()) for k in range(p.dim)]
            logits = [sum(o * h for o, h in zip(out[c], hidden)) + bias[c] for c in range(2)]
            chance = [math.exp(z - max(logits)) for z in logits]
            error = [(c == labels[i]) - chance[c] / sum(chance) for c in range(2)]
            back = [error[0] * out[0][k] + error[1] * out[1][k] for k in range(p.dim)]
            step = rate / (1 + sum(h * h for h in hidden) + sum(o * o for r in out for o in r) / 2)
            for c in range(2):
                out[c] = [o + step * error[c] * h for o, h in zip(out[c], hidden)]
                bias[c] += 0.1 * step * error[c]
            size = sum(w * w for w in docs[i].values())
            for b, w in docs[i].items():
                rows[b] = [r + w * step / size * x for r, x in zip(rows[b], back)]
    return [sum(rows[b][k] * (out[1][k] - out[0][k]) for k in range(p.dim)) for b in range(p.buckets)], bias[1] - bias[0]


def test_the_trainer_against_a_plain_one():
    p = ClassifierParams(buckets=1 << 9, dim=3, epochs=3, word_ngrams=(2, 3))
    texts = ["good clean words here", "bad!! bad!! bad!! x", "more good clean words", "bad!! junk!! ü", "a", "words bad!! words"]
    labels = [1, 0, 1, 0, 1, 0]
    for text in texts:
        ids, weights = document_features(text, p)
        assert dict(zip(ids.tolist(), weights.tolist())) == pytest.approx(plain_features(text, p), rel=1e-5)
    model, (margins, bias) = fit(texts, labels, p), plain_fit(texts, labels, p)
    assert model.margins == pytest.approx(np.array(margins), abs=1e-4) and model.bias == pytest.approx(bias, abs=1e-4)


def test_one_text_of_each_id_in_a_fixed_order(spark):
    from ionweave.llm.quality_classifier import training_sample

    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    docs = spark.createDataFrame([(1, "long text"), (1, "b"), (1, "a"), (2, "z"), (2, "z"), (2, None)], "doc_id long, text string")
    found = {tuple(sorted(zip(*training_sample(docs.repartition(n), labels, ClassifierParams())))) for n in (1, 2, 5)}
    assert len(found) == 1 and dict((y, t) for t, y in found.pop())[0] == ""
