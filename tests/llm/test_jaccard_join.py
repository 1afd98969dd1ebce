import numpy as np
from fixtures import documents, empty, rows

from ionweave.llm import jaccard_join
from ionweave.llm.jaccard_join import JoinParams, near_duplicates, posterior, prune_table


def shingles(text, width=5):
    w = (text or "").encode().split()
    if not w:
        return frozenset()
    n = min(width, len(w))
    return frozenset((n, *w[i : i + n]) for i in range(len(w) - n + 1))


def brute(table, threshold=0.8):
    sets = [shingles(t) for _, t in table]
    n = len(table)
    linked = [[i != j and bool(sets[i]) and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-9 for j in range(n)] for i in range(n)]
    out, seen = [], {}
    for i in range(n):
        if i in seen:
            continue
        group, todo = {i}, [i]
        while todo:
            k = todo.pop()
            new = {j for j in range(n) if linked[k][j]} - group
            group |= new
            todo += new
        ids = [table[j][0] for j in group if table[j][0] is not None]
        seen |= dict.fromkeys(group, min(ids) if ids else None)
    for i in range(n):
        out.append((table[i][0], seen[i], sum(linked[i])))
    return sorted(out, key=repr)


COLUMNS = ("doc_id", "class_id", "n_links")


def got(docs, p=JoinParams()):
    return sorted((tuple(r) for r in near_duplicates(docs, p).select(*COLUMNS).collect()), key=repr)


def test_against_brute_force(spark):
    assert got(documents(spark)) == brute([r[:2] for r in rows()])
    assert near_duplicates(empty(spark)).count() == 0


def test_large_group_in_small_blocks(spark):
    rng = np.random.default_rng(4)
    base = [f"b{i}" for i in range(150)]
    table = []
    for i in range(120):
        w = list(base)
        for k in rng.integers(0, 150, rng.integers(0, 5)):
            w[k] = f"x{rng.integers(1000)}"
        table.append((i, " ".join(w)))
    table += [(1000 + i, " ".join(f"s{rng.integers(5000)}" for _ in range(30))) for i in range(50)]
    p = JoinParams(bucket_block=16, verify_rows=16)
    assert got(spark.createDataFrame(table, "doc_id long, text string"), p) == brute(table)


def test_small_tables(spark, data_dir):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet")
    assert got(docs) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_posterior():
    rng = np.random.default_rng(1)
    draws = rng.uniform(size=400_000)
    hits = rng.binomial(20, draws) == 15
    assert abs((draws[hits] >= 0.8).mean() - posterior(15, 20, 0.8)) < 0.02
    p = JoinParams()
    for n, least in prune_table(p):
        assert posterior(least, n, p.threshold) >= p.tolerance
        assert least == 0 or posterior(least - 1, n, p.threshold) < p.tolerance
    assert jaccard_join._intersections([np.array([1, 2, 3], np.uint64), np.array([2, 3, 9], np.uint64)]).tolist() == [[2, 2], [2, 2]]


def test_long_chains_of_small_buckets(spark):
    """One component of many sets that few others are linked with: it is verified bucket by bucket."""
    rng = np.random.default_rng(8)
    w = [f"c{i}" for i in range(400)]
    table = []
    for i in range(150):
        table.append((i, " ".join(w)))
        at = int(rng.integers(0, 380))
        w[at : at + 12] = [f"n{i}x{k}" for k in range(12)]
    p = JoinParams(bucket_block=8, verify_rows=8)
    found = got(spark.createDataFrame(table, "doc_id long, text string"), p)
    assert found == brute(table) and len({c for _, c, _ in found}) < 20
