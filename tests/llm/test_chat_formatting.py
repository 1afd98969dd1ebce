import hashlib

from fixtures import empty
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ionweave.llm.chat_formatting import CONTROL, chat_formatting, parse, read_back
from ionweave.llm.queries import conversation_rows, op6_chat_formatting

TREE = "tree_id long, node_id long, parent_id long, role string, text string, score double, uid string, leaf string, branch string"


def tree(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x") for r in rows], TREE)


def test_branches_are_ranked(spark):
    rows = [
        (1, 1, None, "user", "q", 0.0),
        (1, 2, 1, "assistant", "good", 2.0),
        (1, 3, 1, "assistant", "bad", -1.0),
        (1, 4, 2, "user", "more", 0.5),
        (1, 5, 4, "assistant", "yes", 1.0),
        (1, 6, 4, "assistant", "no", 0.0),
        (2, 9, 8, "user", "an orphan is a root", 1.0),
        (None, 1, None, None, None, None),
    ]
    found = chat_formatting(tree(spark, rows), score=F.col("score")).orderBy("tree_id", "branch").collect()
    texts = {(r["tree_id"], r["branch"]): [t for _, t in parse(r["formatted"])] for r in found}
    assert texts == {(None, 1): [""], (1, 1): ["q", "good", "more", "yes"], (1, 2): ["q", "good", "more", "no"], (1, 3): ["q", "bad"], (2, 1): ["an orphan is a root"]}
    best = chat_formatting(tree(spark, rows), score=F.col("score"), branches=1).collect()
    assert sorted((r["n_turns"] for r in best)) == [1, 1, 4]
    for r in found:
        losses = [r["formatted"][s["start"] : s["start"] + s["length"]] for s in r["loss"]]
        assert losses == [t for role, t in parse(r["formatted"]) if role == "assistant"]


def test_deep_paths_cycles_and_repeats(spark):
    chain = [(1, i, i - 1, "user" if i % 2 else "assistant", f"t{i}", 0.0) for i in range(77)]
    cycle = [(2, 1, 2, "user", "a", 0.0), (2, 2, 1, "user", "b", 0.0), (2, 3, 1, "user", "c", 0.0), (2, 4, 4, "user", "self", 0.0)]
    twice = [(3, 1, None, "user", "a", 0.0), (3, 1, None, "user", "a", 0.0), (3, 2, 1, "assistant", "b", 0.0)]
    found = {}
    for r in chat_formatting(tree(spark, chain + cycle + twice)).collect():
        found.setdefault(r["tree_id"], []).append([t for _, t in parse(r["formatted"])])
    assert found[1] == [[f"t{i}" for i in range(77)]]
    assert 2 not in found
    assert sorted(found[3]) == [["a"], ["a", "b"]]
    assert chat_formatting(tree(spark, []).limit(0)).count() == 0


ROLE = st.text(alphabet="ab\\n\n<|im_start>", max_size=8)
PIECE = st.one_of(st.sampled_from([*CONTROL, "<\\|im_end|>", "[\\\\INST]", "<", "[", "\\", "|im_end|>\n", "\n"]), st.text(max_size=4))


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(ROLE, st.lists(PIECE, max_size=6).map("".join)), min_size=1, max_size=6))
def test_escapes_are_reversible(spark, turns):
    turns = [(r.replace("\x00", ""), t.encode("utf-8", "ignore").decode()) for r, t in turns]
    rows = [(1, i, i - 1, role, text, 0.0) for i, (role, text) in enumerate(turns)]
    got = chat_formatting(tree(spark, rows)).first()["formatted"]
    assert parse(got) == turns
    for control in CONTROL[1:]:
        assert got.count(control) == (len(turns) if control == "<|im_end|>" else 0)


def test_query(spark, data_dir):
    found = {r["conv_id"]: r for r in op6_chat_formatting(spark, data_dir).collect()}
    table = spark.read.parquet(f"{data_dir}/conversations.parquet").collect()
    by = {}
    for r in sorted(table, key=lambda r: (r["turn"], r["role"], r["text"])):
        by.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    by[-1] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    assert set(by) == set(found)
    for i, turns in by.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert (found[i]["n_turns"], found[i]["loss_chars"]) == (len(turns), len(loss))
        assert found[i]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert found[i]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


def test_nulls(spark):
    rows = spark.createDataFrame([(1, None, None, None), (1, 0, "user", None), (None, 1, "assistant", "x"), (1, 0, "user", "a"), (1, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    found = {r["conv_id"]: r for r in read_back(chat_formatting(conversation_rows(rows))).withColumnRenamed("tree_id", "conv_id").collect()}
    assert {k: r["n_turns"] for k, r in found.items()} == {1: 4, None: 1, -1: 2}
    assert found[None]["loss_chars"] == 1
    assert empty(spark).count() == 0
