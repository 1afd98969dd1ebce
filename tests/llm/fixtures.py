"""Documents with the cases every operator has to stand: nulls, empty and long texts, ties, repeats, clashing columns."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, ids string, kept string, copies string, block string, score string, sid string, copy string, row_copies string, row_doc_id string, row_text_hash string, row_nth string, row_count string, seed string"
CLASH = (7, *["x"] * 13)


def words(seed: int, n: int, vocabulary: int = 400) -> list[str]:
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}{'abcde'[rng.randrange(5)]}" for _ in range(n)]


def rows() -> list[tuple]:
    base = words(1, 120)
    near = [*base[:117], "changed", *base[118:]]
    tail = [*base, "tail"]
    far = words(2, 120)
    texts: list[tuple[int | None, str | None]] = [
        (1, " ".join(base)),
        (2, " ".join(base)),
        (3, "\t".join(base) + "\n"),  # equal but for spaces, longer
        (4, " ".join(near)),
        (5, " ".join(tail)),
        (6, " ".join(far)),
        (7, None),
        (8, ""),
        (9, "   \n\t "),
        (10, "short"),
        (11, "short"),
        (12, "one two three four"),
        (13, " ".join(words(3, 9000))),
        (14, "x" * 70_000),
        (15, "Ünïcödé tëxt 日本語 😀 " * 30),
        (16, "same line here\n" * 40),
        (17, "<|endoftext|> and <|im_start|> </s>"),
        (None, "a text without an id, of more than five words"),
        (None, " ".join(base)),
        (19, "repeated row"),
        (19, "repeated row"),
        (20, " wide space\u0085next"),
    ]
    sources = ["b", "a", None, "", "é"]
    return [(i, t, "en", sources[n % 5], None, *CLASH) for n, (i, t) in enumerate(texts)]


def documents(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def tuples(df, *columns) -> list[tuple]:
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
