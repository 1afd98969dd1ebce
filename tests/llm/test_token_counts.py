import random

import public_tokenizers
from fixtures import documents, empty, rows, tuples

from ionweave.llm.token_counts import LongestMatchCounter, byte_bpe_vocabulary, token_counts


def greedy(word: bytes, initial: set, continuation: set) -> int:
    at, n = 0, 0
    while at < len(word):
        vocabulary = continuation if at else initial
        end = next((e for e in range(len(word), at, -1) if word[at:e] in vocabulary), None)
        if end is None:
            return 1
        at, n = end, n + 1
    return n


def test_counter_against_greedy_splitting():
    rng = random.Random(5)
    for _ in range(300):
        pieces = lambda: {bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 12))}
        initial, continuation = pieces(), pieces()
        counter = LongestMatchCounter(initial, continuation)
        for _ in range(60):
            word = bytes(rng.choice(b"abcd" if rng.random() < 0.1 else b"abc") for _ in range(rng.randint(1, 14)))
            assert counter.count(word) == greedy(word, initial, continuation), (word, initial, continuation)


def test_documents(spark):
    vocabulary = byte_bpe_vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    initial, continuation = map(set, vocabulary)
    want = []
    for doc_id, text, *_ in rows():
        raw = (text or "").encode()
        parts = raw.split()
        n = sum(greedy(w, initial, continuation) for w in parts) if len(raw) < 50_000 or len(parts) > 1 else None
        want.append((doc_id, len(raw), len(parts), n))
    got = tuples(token_counts(documents(spark), vocabulary), "doc_id", "n_bytes", "n_words", "n_tokens")
    assert len(got) == len(want)
    assert [g for g in got if g[1] < 50_000 or g[2] > 1] == sorted((w for w in want if w[3] is not None), key=repr)
    assert token_counts(empty(spark), vocabulary).count() == 0
