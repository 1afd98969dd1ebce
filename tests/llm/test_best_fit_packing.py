import os
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as files
import pytest
from fixtures import documents, empty, rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ionweave.llm.best_fit_packing import _coder, best_fit_decreasing, best_fit_packing, cut, layout, lower_bound, narrow, pack, packed_sequences, widened
from ionweave.llm.common import Workspace

os.environ["TOKENIZERS_PARALLELISM"] = "false"
JSON, RANKS = files.path("byte_bpe_50k.json"), files.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(JSON)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_quick_ids_are_the_tokenizers_ids(text):
    from tokenizers import Tokenizer

    test_quick_ids_are_the_tokenizers_ids.own = own = getattr(test_quick_ids_are_the_tokenizers_ids, "own", None) or Tokenizer.from_file(JSON)
    assert _coder(JSON, RANKS, files.PATTERN)(text).tolist() == own.encode(text, add_special_tokens=False).ids


def test_quick_ids_on_real_texts(spark, data_dir, tokenizer):
    texts = [r.text for r in spark.read.parquet(f"{data_dir}/documents.parquet").select("text").collect()]
    encode = _coder(JSON, RANKS, files.PATTERN)
    for text in texts:
        assert encode(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def check_layout(found, capacity):
    by_bin = defaultdict(list)
    for r in found:
        assert 1 <= r["length"] <= capacity
        by_bin[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by_bin.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_bin)


def test_documents(spark, tokenizer):
    packed, report = best_fit_packing(documents(spark), JSON, RANKS, files.PATTERN)
    found = packed.collect()
    assert check_layout(found, 2048) == report["bins"] >= report["lower_bound"]
    want = []
    for doc_id, text, *_ in rows():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(doc_id, n, s, size, zlib.crc32(ids[s : s + size].tobytes())) for n, (s, size) in enumerate(cut(len(ids), 2048))]
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found), key=repr) == sorted(want, key=repr)
    assert best_fit_packing(empty(spark), JSON, RANKS, files.PATTERN)[0].count() == 0


def test_sequences_hold_the_documents_ids(spark, tokenizer):
    sequences, report = packed_sequences(documents(spark), JSON, RANKS, files.PATTERN, 256)
    sequences = sequences.cache()
    parts = defaultdict(list)
    for r in sequences.collect():
        ids, at = np.frombuffer(r["ids"], "<u4").tolist(), 0
        for p in r["pieces"]:
            assert p["offset"] == at
            at += p["length"]
            parts[p["doc_id"], p["piece"], p["start"]].append(tuple(ids[p["offset"] : at]))
        assert at == len(ids) <= 256
    want = defaultdict(list)
    for doc_id, text, *_ in rows():
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for n, (s, size) in enumerate(cut(len(ids), 256)):
            want[doc_id, n, s].append(tuple(ids[s : s + size]))
    assert {k: sorted(v) for k, v in parts.items()} == {k: sorted(v) for k, v in want.items()}
    assert sequences.count() == report["bins"]
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    key = lambda df: sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
    assert key(layout(sequences)) == key(best_fit_packing(documents(spark), JSON, RANKS, files.PATTERN, 256)[0])
    assert layout(packed_sequences(empty(spark), JSON, RANKS, files.PATTERN)[0]).count() == 0


def test_ids_of_any_vocabulary_travel():
    for ids in ([], [0, 65_535], [65_536, 1], [4_294_967_295]):
        raw = np.array(ids, "<u4")
        assert widened(narrow(raw), len(ids)) == raw.tobytes()


def test_cut():
    assert cut(2048, 2048) == [(0, 2048)]
    assert cut(2049, 2048) == [(0, 1), (1, 2048)]
    assert cut(4096, 2048) == [(0, 2048), (2048, 2048)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 24), min_size=1, max_size=9))
def test_bounds_and_bins_against_the_optimum(lengths):
    capacity = 24

    def optimum(left: tuple, rooms: tuple, best: int) -> int:
        if len(rooms) >= best:
            return best
        if not left:
            return len(rooms)
        for k, room in enumerate(rooms):
            if room >= left[0] and room not in rooms[:k]:
                best = optimum(left[1:], (*rooms[:k], room - left[0], *rooms[k + 1 :]), best)
        return optimum(left[1:], (*rooms, capacity - left[0]), best)

    least = optimum(tuple(sorted(lengths, reverse=True)), (), len(lengths) + 1)
    sizes = np.array(lengths)
    bins, offsets, fill = best_fit_decreasing(sizes, capacity)
    assert lower_bound(np.bincount(sizes, minlength=capacity + 1), capacity) <= least <= len(fill)
    assert fill.sum() == sizes.sum() and fill.max() <= capacity
    for b in range(len(fill)):
        own = sorted((offsets[i], sizes[i]) for i in np.flatnonzero(bins == b))
        assert [o for o, _ in own] == list(np.cumsum([0, *[n for _, n in own[:-1]]]))


def test_exchange_between_groups_saves_bins(spark):
    space = Workspace(spark, "test-packing")
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 900, 3000).tolist()
    rows_ = [(i, 0, 0, n, 0, i) for i, n in enumerate(sizes)]
    table = space.write(spark.createDataFrame(rows_, "doc_id long, piece int, start long, length long, ids_crc32 long, uid long"), "pieces")
    alone = pack(table, space, 1024, group=200, rounds=0)[1]
    packed, report = pack(table, Workspace(spark, "test-packing"), 1024, group=200, rounds=3)
    found = packed.collect()
    assert check_layout(found, 1024) == report["bins"] <= alone["bins"]
    assert report["bins"] <= report["lower_bound"] * 1.02 and len(found) == 3000
    assert packed.agg(F.countDistinct("doc_id")).first()[0] == 3000
