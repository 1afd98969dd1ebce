import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from fixtures import documents, empty
from test_exact_dedup import brute as brute_exact
from test_jaccard_join import brute as brute_near
from test_source_mixing import brute_targets

import corpus_pipeline
from ionweave.llm.best_fit_packing import cut
from ionweave.llm.quality_classifier import ClassifierParams, _scorer, fit, training_sample

STAGE = dict(corpus_pipeline.STAGES)


def as_rows(df):
    return [tuple(r) for r in df.collect()]


def ids(df):
    return sorted((r["doc_id"] for r in df.collect()), key=repr)


def test_stages_are_the_ones_asked_for():
    assert list(STAGE) == ["quality classifier", "exact dedup", "n-gram Jaccard join", "mixing sources to target weights", "best-fit packing"]


def test_quality_stage(spark, data_dir):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet")
    labels = spark.read.parquet(f"{data_dir}/labels.parquet")
    kept = STAGE["quality classifier"](spark, docs, data_dir)
    assert kept.schema == docs.schema
    p = ClassifierParams()
    train = [r["doc_id"] for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2]
    score_of = _scorer(fit(*training_sample(docs, labels.where(labels.doc_id.isin(train)), p), p).save(), p)
    want = [r["doc_id"] for r in docs.collect() if score_of([r["text"]])[0] >= corpus_pipeline.QUALITY_THRESHOLD]
    assert ids(kept) == sorted(want, key=repr) and 0 < len(want)


def test_dedup_stages(spark, data_dir):
    docs = documents(spark)
    kept = STAGE["exact dedup"](spark, docs, data_dir)
    assert kept.schema == docs.schema
    table = as_rows(docs)
    want = Counter(i for i, keep, _, flag, _ in brute_exact(table) if flag)
    # a row that repeats id and text is one document
    assert Counter(ids(kept)) == Counter(dict.fromkeys(want, 1))
    near = STAGE["n-gram Jaccard join"](spark, kept, data_dir)
    assert near.schema == docs.schema
    pairs = [(r[0], r[1]) for r in as_rows(kept)]
    classes = brute_near(pairs)
    with_words = {i for i, t in pairs if (t or "").split()}
    first = {i for i, c, _ in classes if i == c or (i not in with_words)}
    assert set(ids(near)) == first
    assert len(ids(near)) == len(first)


def test_mixing_and_packing_stages(spark, data_dir):
    docs = STAGE["exact dedup"](spark, documents(spark), data_dir)
    mixed = STAGE["mixing sources to target weights"](spark, docs, data_dir)
    assert mixed.schema == docs.schema
    size = lambda t: len((t or "").encode().split())
    source, sizes, took = {}, defaultdict(int), defaultdict(int)
    for r in docs.collect():
        source[r["doc_id"]] = r["source"]
        sizes[r["source"]] += size(r["text"])
    counts = Counter()
    for r in mixed.collect():
        counts[r["doc_id"]] += 1
        took[r["source"]] += size(r["text"])
    assert max(counts.values()) <= 2
    for s, want in brute_targets(sizes).items():
        largest = max([size(r["text"]) for r in docs.collect() if r["source"] == s], default=0)
        assert abs(took[s] - want) <= largest
    packed = STAGE["best-fit packing"](spark, mixed, data_dir).collect()
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(corpus_pipeline.tokenizer_files()["json"])
    want_pieces = Counter()
    for r in mixed.collect():
        tokens = np.array([*own.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        for n, (start, length) in enumerate(cut(len(tokens), 2048)):
            want_pieces[r["doc_id"], n, start, length, zlib.crc32(tokens[start : start + length].tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed) == want_pieces


def test_the_whole_pipeline_on_hard_rows(spark, tmp_path):
    from collections import Counter

    documents(spark).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(1, 1), (2, 1), (3, 1), (13, 1), (6, 1), (5, 1), (16, 0), (14, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    before = {repr(tuple(r)) for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == spark.read.parquet(str(tmp_path / "documents.parquet")).columns, name
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        # every column comes through as it was, those named like the stages' own too
        assert {repr(tuple(r)) for r in docs.collect()} <= before, name
    mixed = Counter(r["doc_id"] for r in docs.collect())
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert packed and Counter(r["doc_id"] for r in packed if r["piece"] == 0) == mixed


@pytest.mark.parametrize("name", list(STAGE))
def test_empty_tables(spark, data_dir, name):
    assert STAGE[name](spark, empty(spark), data_dir).count() == 0


def test_run(spark, data_dir):
    packed = corpus_pipeline.run(spark, data_dir)
    assert set(packed.columns) >= {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} and packed.count() > 0
