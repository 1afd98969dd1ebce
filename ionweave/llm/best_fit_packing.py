"""Best-fit packing of token sequences, certified by dual-feasible-function lower bounds.

Documents are tokenised and cut; of the pieces only (id, start, length) rows travel from there on. They are dealt
into groups of bounded size, each packed by best-fit decreasing. Dual feasible functions give each group a lower
bound on its number of bins: a group that meets its bound is proved optimal and settled. Groups with a gap settle
their well filled bins and exchange the documents of the others, which are dealt anew and packed again. A last bound
over the histogram of all lengths (at most `capacity` numbers) tells how far the whole result can be from the best.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionweave.llm.common import Workspace, text_or_empty

#: Pieces that one task packs.
GROUP = 65_536
#: An exchanged bin is filled to less than this share.
WELL_FILLED = 0.995

#: Beyond Latin letters, spaces and common punctuation, two regex engines may class a character differently.
PLAIN_TEXT = re.compile("[\x00-ɏ‐-‧‰-›€]*")

_CODERS: dict[str, tuple] = {}


def _coder(tokenizer_path: str, ranks_path: str | None, pattern: str | None):
    """(encode, end-of-text strings) of this process. The ranks hold the same vocabulary; they are quicker for plain text."""
    key = f"{tokenizer_path}\n{ranks_path}"
    if key not in _CODERS:
        import base64
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(tokenizer_path)
        added = [t.content for t in own.get_added_tokens_decoder().values()]
        quick = None
        if ranks_path:
            import tiktoken

            with open(ranks_path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            quick = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

        def encode(text: str) -> np.ndarray:
            if quick is not None and PLAIN_TEXT.fullmatch(text) and not any(t in text for t in added):
                return quick.encode_to_numpy(text, disallowed_special=())
            return np.array(own.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

        _CODERS[key] = (encode,)
    return _CODERS[key][0]


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces; the first one takes what the full ones leave."""
    first = length if length <= capacity else (length % capacity or capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, length, capacity)]


def narrow(ids: np.ndarray) -> bytes:
    return ids.astype("<u2").tobytes() if ids.max(initial=0) < 1 << 16 else ids.astype("<u4").tobytes()


def widened(raw: bytes, length: int) -> bytes:
    return np.frombuffer(raw, "<u2").astype("<u4").tobytes() if len(raw) == 2 * length else raw


def pieces(docs: DataFrame, tokenizer_path: str, ranks_path: str | None, pattern: str | None, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """A row (doc_id, piece, start, length, ids_crc32, ids) for each piece; the digest is of little-endian unsigned 32-bit ids.

    ids are those, or 16-bit where all of a piece's fit: half of what travels with any vocabulary of up to 65,536 entries.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _coder(tokenizer_path, ranks_path, pattern)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                out: list[list] = [[], [], [], [], [], []]
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    ids = np.append(encode(text), end_id).astype("<u4")
                    for n, (start, length) in enumerate(cut(len(ids), capacity)):
                        raw = ids[start : start + length].tobytes()
                        for column, value in zip(out, (doc_id, n, start, length, zlib.crc32(raw), narrow(ids[start : start + length])), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary")


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each piece and the fill of each bin. Bins stand by the room they have left; ties take any."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    room_of: list[list[int]] = [[] for _ in range(capacity + 1)]
    fill: list[int] = []
    open_rooms = 0  # bit r: there is a bin with room r
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fits = open_rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = room_of[room].pop()
            if not room_of[room]:
                open_rooms &= ~(1 << room)
        else:
            room, b = capacity, len(fill)
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += n
        room -= n
        if room:
            room_of[room].append(b)
            open_rooms |= 1 << room
    return bins, offsets, np.array(fill, np.int64)


def lower_bound(histogram: np.ndarray, capacity: int) -> int:
    """Least number of bins for histogram[length] pieces: the best of two families of dual feasible functions."""
    sizes = np.arange(capacity + 1, dtype=np.int64)
    total = histogram.astype(np.int64)
    best = -(-int((sizes * total).sum()) // capacity)
    above = np.concatenate([np.cumsum(total[::-1])[::-1], [0]])  # pieces of at least this length
    mass = np.concatenate([np.cumsum((sizes * total)[::-1])[::-1], [0]])
    small = np.arange(1, capacity // 2 + 1)
    # pieces above capacity - t count as whole bins, those below t as nothing
    large = above[capacity - small + 1]
    middle = mass[small] - mass[capacity - small + 1]
    best = max(best, int((large + -(-middle // capacity)).max(initial=0)))
    for k in range(1, 21):  # u_k(x) = x if (k + 1) x is whole, else floor((k + 1) x) / k, in units of 1 / (k (k + 1) capacity)
        scaled = (k + 1) * sizes
        value = np.where(scaled % capacity == 0, k * scaled, (k + 1) * capacity * (scaled // capacity))
        best = max(best, -(-int((value * total).sum()) // (k * (k + 1) * capacity)))
    return best


PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, uid long, sequence_id long, offset long, settled boolean"


def _pack(rows: DataFrame, groups: int, salt: int, capacity: int) -> DataFrame:
    """Packs each group; sequence ids are unique within and between rounds. settled: the bin isn't exchanged."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by([("length", "descending"), ("uid", "ascending")])
        lengths = t["length"].to_numpy()
        bins, offsets, fill = best_fit_decreasing(lengths, capacity)
        certified = len(fill) == lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        settled = (fill >= WELL_FILLED * capacity) | certified
        base = (salt * (1 << 26) + key[0].as_py()) * (1 << 30)
        return t.drop_columns(["grp"]).append_column("sequence_id", pa.array(base + bins)).append_column("offset", pa.array(offsets)).append_column("settled", pa.array(settled[bins]))

    dealt = rows.select("doc_id", "piece", "start", "length", "ids_crc32", "uid", F.pmod(F.xxhash64("uid", F.lit(salt)), F.lit(groups)).alias("grp"))
    return dealt.groupBy("grp").applyInArrow(run, PACKED)


def pack(table: DataFrame, space: Workspace, capacity: int, group: int = GROUP, rounds: int | None = None) -> tuple[DataFrame, dict]:
    """table (doc_id, piece, start, length, ids_crc32, uid; written) with sequence_id and offset, and a report.

    The pieces of unsettled bins are exchanged and packed anew for as long as that saves bins (rounds: that often at most); a round that
    saves none is not used. The report has the bins, the proven lower bound and, for each round, its settled bins and the bins left open.
    """
    histogram = np.zeros(capacity + 1, np.int64)
    for n, count in table.groupBy("length").count().collect():  # at most `capacity` rows
        histogram[n] = count
    bound, left = lower_bound(histogram, capacity), int(histogram.sum())
    done: list[DataFrame] = []
    report: dict = {"lower_bound": bound, "pieces": left, "rounds": [], "bins": 0}
    todo, before, settled_bins, k = table, None, 0, 0
    while True:
        packed = space.write(_pack(todo, max(1, -(-left // group)), k, capacity), f"packed-{k}")
        per = {r["settled"]: r for r in packed.groupBy("settled").agg(F.count("*").alias("n"), F.countDistinct("sequence_id").alias("bins")).collect()}
        settled, open_bins = (per[flag]["bins"] if flag in per else 0 for flag in (True, False))
        report["rounds"].append({True: settled, False: open_bins})
        if before is not None and settled + open_bins >= before[1]:
            done.append(before[0])
            report["bins"] = settled_bins + before[1]
            break
        settled_bins, total = settled_bins + settled, settled_bins + settled + open_bins
        # one group has nobody to exchange with, and fewer bins than the bound can't be reached
        if not open_bins or total == bound or left <= group or k == rounds:
            done.append(packed)
            report["bins"] = total
            break
        done.append(packed.where("settled"))
        todo, left, before, k = packed.where("not settled"), per[False]["n"], (packed.where("not settled"), open_bins), k + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.drop("settled"), report


SEQUENCES = "sequence_id long, ids binary, pieces array<struct<offset: long, length: long, doc_id: long, piece: int, start: long>>"


def packed_sequences(
    docs: DataFrame,
    tokenizer_path: str,
    ranks_path: str | None = None,
    pattern: str | None = None,
    capacity: int = 2048,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    group: int = GROUP,
) -> tuple[DataFrame, dict]:
    """The sequences that best_fit_packing lays out, with their token ids: rows (sequence_id, ids, pieces), and the report.

    ids are little-endian unsigned 32-bit, the pieces' ids in a row; pieces are structs (offset, length, doc_id, piece,
    start) by offset. At most `capacity` ids come together in a group, so no group is large.
    """
    space = Workspace(docs.sparkSession, "packing")
    cut_up = pieces(docs, tokenizer_path, ranks_path, pattern, capacity, end_id, id_col, text_col)
    # a written row keeps its number, whichever task reads it
    table = space.write(cut_up.withColumn("uid", F.monotonically_increasing_id()), "pieces")
    packed, report = pack(table.drop("ids"), space, capacity, group)
    placed = packed.drop("ids_crc32").hint("shuffle_merge").join(table.select("uid", "ids"), "uid")
    held = placed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "length", "doc_id", "piece", "start", "ids"))).alias("held"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                rows = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
                ids = [b"".join(widened(raw, n) for raw, n in zip(parts, lengths, strict=True)) for parts, lengths in rows]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), batch.column(3)], names=["sequence_id", "ids", "pieces"])

    parts = held.select("sequence_id", F.col("held.ids").alias("parts"), F.col("held.length").alias("lengths"), F.transform("held", lambda x: x.dropFields("ids")).alias("pieces"))
    return parts.mapInArrow(run, SEQUENCES), report


def layout(sequences: DataFrame) -> DataFrame:
    """A row (doc_id, piece, start, length, ids_crc32, sequence_id, offset) for each piece; the digest is taken from the sequence's ids."""
    rows = sequences.select("sequence_id", "ids", F.explode("pieces").alias("p")).select("sequence_id", "ids", "p.*")
    own = F.substring("ids", 4 * F.col("offset").cast("int") + 1, 4 * F.col("length").cast("int"))
    return rows.select("doc_id", "piece", "start", "length", F.crc32(own).alias("ids_crc32"), "sequence_id", "offset")


def best_fit_packing(
    docs: DataFrame,
    tokenizer_path: str,
    ranks_path: str | None = None,
    pattern: str | None = None,
    capacity: int = 2048,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    group: int = GROUP,
) -> tuple[DataFrame, dict]:
    """Packs all rows of docs into sequences of at most `capacity` tokens: a row for each piece, and a report.

    A document is its token ids and then end_id; a null text is an empty one and gives the one id. Only longer
    documents are cut, into pieces of `capacity` ids behind a first one with the rest, however long they are. Repeated rows are
    packed each for itself, null ids too; an empty table gives no rows; other columns are ignored. ranks_path: the same vocabulary as byte ranks,
    used where both agree by construction. The report's bins and lower_bound certify the result.
    """
    space = Workspace(docs.sparkSession, "packing")
    cut_up = pieces(docs, tokenizer_path, ranks_path, pattern, capacity, end_id, id_col, text_col).drop("ids")
    # a written row keeps its number, whichever task reads it
    table = space.write(cut_up.withColumn("uid", F.monotonically_increasing_id()), "pieces")
    packed, report = pack(table, space, capacity, group)
    return packed.drop("uid"), report
