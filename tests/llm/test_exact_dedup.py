import hashlib
import re
from collections import defaultdict

from fixtures import documents, empty, rows, tuples
from pyspark.sql import functions as F

from ionweave.llm.exact_dedup import chunks, exact_dedup, exact_dedup_rows

COLUMNS = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def brute(table):
    groups = defaultdict(list)
    for doc_id, text, *_ in table:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((doc_id, text or ""))
    out = []
    for norm, members in groups.items():
        best = max(members, key=lambda m: (len(m[1]), m[0] is not None, -(m[0] or 0)))[0]
        out += [(i, best, len(members), i == best, hashlib.sha256(norm.encode()).hexdigest()) for i, _ in members]
    return sorted(out, key=repr)


def test_against_brute_force(spark):
    assert tuples(exact_dedup(documents(spark)), *COLUMNS) == brute(rows())


def test_hash_clashes_are_resolved(spark):
    docs = documents(spark)
    weak = exact_dedup_rows(docs, hash_of=lambda c: F.length(c).cast("long") % 2, min_chunk=3, max_chunk=50)
    assert tuples(weak, *COLUMNS) == brute(rows())


def test_chunks_join_to_the_text_and_resync(spark):
    a = "".join(f"{i}xyzxyz{'dcfa' if i * 7919 % 13 == 0 else ''}" for i in range(4000))
    table = spark.createDataFrame([(a, "zz" + a)], "a string, b string")
    one, two = table.select(chunks(F.col("a"), 16, 8192), chunks(F.col("b"), 16, 8192)).first()
    assert "".join(one) == a and "".join(two) == "zz" + a
    assert len(set(one) & set(two)) > 0.8 * len(set(one))


def test_empty_table(spark):
    assert exact_dedup(empty(spark)).count() == 0


def test_no_python_on_the_executors(spark):
    plan = exact_dedup(documents(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_least_and_largest_ids(spark):
    low, high = -(2**63), 2**63 - 1
    found = exact_dedup(spark.createDataFrame([(low, "a b"), (high, "a b"), (None, "ab "), (0, "a  b"), (low, "x"), (None, "x")], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["keep_id"]) for r in found if r["doc_id"] is not None) == [(low, low), (low, 0), (0, 0), (high, 0)]
