from collections import Counter, defaultdict

import numpy as np
import pytest
from fixtures import documents, empty, rows
from hypothesis import given, settings
from hypothesis import strategies as st

from ionweave.llm.line_frequency import LineParams, clean_documents, covered_by_repeats, normal_line, quality_rules


def repeated(words, window=8):
    at = defaultdict(list)
    for i in range(len(words) - window + 1):
        at[tuple(words[i : i + window])].append(i)
    covered = set()
    for starts in at.values():
        if len(starts) > 1:
            for s in starts:
                covered.update(range(s, s + window))
    return len(covered)


def brute(table, p):
    lines_of, hosts = defaultdict(set), defaultdict(set)
    for _, text, _, host, *_ in table:
        hosts[host].add(text or "")
        for line in (text or "").encode().split(b"\n"):
            if line.split():
                lines_of[host, normal_line(line)].add(text or "")
    out = []
    for doc_id, text, _, host, *_ in table:
        text = text or ""
        words = text.encode().split()
        lines = [x for x in text.encode().split(b"\n") if x.split()]
        lost = sum(len(x.split()) for x in lines if len(lines_of[host, normal_line(x)]) > max(p.min_docs, p.min_share * len(hosts[host])))
        again = repeated(words)
        failed = len(words) < p.min_words or 100 * again > 30 * len(words)
        left = len(words) - lost
        kept = not failed and not (lost and left < p.min_left * len(words))
        out.append((doc_id, len(words), sum(len(w.decode()) for w in words), sum(text.count(c) for c in "#*$%&|<>"), sum(n - 1 for n in Counter(lines).values()), again, lost, failed, kept))
    return sorted(out, key=repr)


COLUMNS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_line_words", "base_failed", "kept")


@pytest.mark.parametrize("p", [LineParams(), LineParams(min_docs=1, min_share=0.0, min_words=2)])
def test_against_brute_force(spark, p):
    got = sorted((tuple(r) for r in quality_rules(documents(spark), p).select(*COLUMNS).collect()), key=repr)
    assert got == brute(rows(), p)
    assert quality_rules(empty(spark), p).count() == 0


def test_on_the_small_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    table = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source").collect()]
    p = LineParams(min_docs=2, min_share=0.0)
    got = sorted((tuple(r) for r in quality_rules(docs, p).select(*COLUMNS).collect()), key=repr)
    assert got == brute(table, p)


def test_boilerplate_is_removed_and_depleted_documents_go(spark):
    letters = lambda n: "".join("abcdefghij"[int(d)] for d in str(n))  # noqa: E731  numbers would be alike
    body = lambda i: " ".join(f"own{letters(i)}x{letters(k)}" for k in range(40))
    footer = "All   rights reserved 2024 by this host and by no other one at all in the whole wide world of words"
    table = [(i, f"{body(i)}\n{footer.replace('2024', str(2000 + i))}", "en", "h") for i in range(40)]
    table += [(100 + i, f"{footer}\nmore{i}", "en", "h") for i in range(3)] + [(200, f"{footer}\nmore", "en", "other")]
    found = {r["doc_id"]: r for r in quality_rules(spark.createDataFrame(table, "doc_id long, text string, lang string, source string")).collect()}
    assert all(found[i]["kept"] and found[i]["n_line_words"] == 21 for i in range(40))
    assert all(not found[100 + i]["kept"] and not found[100 + i]["base_failed"] for i in range(3))
    assert found[200]["kept"]


@pytest.mark.parametrize("most_sent", [200_000, 0])
def test_texts_lose_the_lines_and_nothing_else(spark, most_sent):
    own = lambda i: f"  Own {'abcdefghij'[i % 10]}{'abcdefghij'[i // 10]} first\t日本 {' '.join(f'k{chr(97 + k)}' for k in range(20))}"
    footer = "All   rights RESERVED 2024"
    table = [(i, f"{footer}\n{own(i)}\n\n \n{footer.lower()}\nlast {'abcdefghij'[i % 10]}{'abcdefghij'[i // 10]}\n", "en", "h") for i in range(30)]
    table += [(100, f"{footer}\n{own(50)}", "en", "other"), (101, None, "en", None), (102, footer, "en", "h"), (102, footer, "en", "h")]
    docs = spark.createDataFrame(table, "doc_id long, text string, lang string, source string")
    found = sorted((tuple(r) for r in clean_documents(docs, most_sent=most_sent).select("doc_id", "text", "n_words", "n_line_words", "kept").collect()), key=repr)
    want = [(i, f"{own(i)}\n\n \nlast {'abcdefghij'[i % 10]}{'abcdefghij'[i // 10]}\n", 34, 8, True) for i in range(30)]
    want += [(100, f"{footer}\n{own(50)}", 28, 0, True), (101, "", 0, 0, False), (102, "", 4, 4, False), (102, "", 4, 4, False)]
    assert found == sorted(want, key=repr)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60), st.integers(2, 8))
def test_covered_words(words, window):
    numbers = {w: n for n, w in enumerate(dict.fromkeys(words))}
    assert covered_by_repeats(np.array([numbers[w] for w in words], np.int64), window) == repeated(words, window)
