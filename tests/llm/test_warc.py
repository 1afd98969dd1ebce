import base64
import gzip
import hashlib
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ionweave.llm import warc
from ionweave.llm.common import Workspace
from ionweave.llm.queries import op10_warc
from ionweave.llm.warc import chunked, parse_records, read_warc, records, round_trip, unchunked, write_warc

SCHEMA = "page_id long, url string, html string, name string, first string, total string"


def b32(raw: bytes) -> str:
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


def rows():
    rng = random.Random(2)
    long = "".join(rng.choice("añ日\r\n x") for _ in range(60_000))
    texts = [(1, "a"), (2, "b"), (3, "a"), (4, None), (5, ""), (6, long), (7, long), (8, "WARC/1.1\r\n\r\nx\r\n\r\n"), (9, "b"), (9, "b"), (None, "a"), (None, "only"), (10, "0\r\n\r\n"), (0, "z\r\n\r\n" * 9000)]
    return [(i, None if i == 2 else f"http://e/{i}\n", t, "x", "x", "x") for i, t in texts]


def expected(table):
    firsts = {}
    for i, _, t, *_ in table:
        raw = (t or "").encode()
        if i is not None:
            firsts[raw] = min(i, firsts.get(raw, i))
    out = []
    for i, _, t, *_ in table:
        raw = (t or "").encode()
        first = firsts.get(raw)
        response = first is None or i == first
        out.append((i, len(raw), b32(raw), "response" if response else "revisit", None if response else first))
    return sorted(out, key=repr)


COLUMNS = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@pytest.mark.parametrize("segment", [700, 16_384, 1 << 22])
def test_round_trip(spark, segment):
    pages = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    got = sorted((tuple(r) for r in round_trip(pages, segment_bytes=segment).select(*COLUMNS).collect()), key=repr)
    assert got == expected(rows())


def test_payloads_come_back(spark):
    pages = spark.createDataFrame(rows(), SCHEMA)
    space = Workspace(spark, "test-warc")
    write_warc(pages, space.path("archive"), space, segment_bytes=900)
    back = sorted(r["payload"] for r in read_warc(spark, space.path("archive")).collect() if r["record_type"] == "response")
    assert bytes(back[0]) == b"" and {bytes(b) for b in back} == {(t or "").encode() for _, _, t, *_ in rows()}


def test_references_name_records_and_members_hold_one_record_each(spark):
    pages = spark.createDataFrame(rows(), SCHEMA).repartition(2)
    space = Workspace(spark, "test-warc")
    write_warc(pages, space.path("archive"), space, segment_bytes=900)
    ids, refers = [], []
    for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(space.path("archive")).collect():
        data, at = bytes(r["content"]), 0
        while at < len(data):  # a reader that starts at any member finds one whole record
            inflate = zlib.decompressobj(31)
            record = inflate.decompress(data[at:])
            assert inflate.eof
            at = len(data) - len(inflate.unused_data)
            ((fields, _),) = parse_records(record)
            ids.append(fields["warc-record-id"])
            refers += [fields["warc-refers-to"]] if "warc-refers-to" in fields else []
    assert len(set(ids)) == len(ids) and refers and set(refers) <= set(ids)
    assert {r["refers_to"] for r in read_warc(spark, space.path("archive")).collect()} - {None} == {r.strip("<>") for r in refers}


def test_long_records_are_several_members():
    record = random.Random(1).randbytes(warc.MEMBER_BYTES + 5)
    data = warc.member(record)
    assert data[-1] == 0 and gzip.decompress(data) == record + b"\r\n\r\n"


def test_query_and_empty_table(spark, data_dir):
    table = [(r["page_id"], r["url"], r["html"]) for r in spark.read.parquet(f"{data_dir}/pages.parquet").collect()]
    got = sorted((tuple(r) for r in op10_warc(spark, data_dir).select(*COLUMNS).collect()), key=repr)
    assert got == expected(table)
    assert round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def test_small_payloads_are_all_responses(spark):
    pages = spark.createDataFrame([(1, "u", "aa"), (2, "u", "aa"), (3, "u", "a" * 50), (4, "u", "a" * 50)], "page_id long, url string, html string")
    assert [r["record_type"] for r in round_trip(pages, min_revisit=10).orderBy("page_id").collect()] == ["response", "response", "response", "revisit"]


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=400), st.integers(1, 50))
def test_chunks(payload, size):
    assert unchunked(chunked(payload, size)) == payload


def test_broken_archives(spark):
    parts = records("urn:page:1:0", "u", b"x" * 5000, None, 1000)
    data = b"".join(p + b"\r\n\r\n" for p in parts)
    assert len(list(parse_records(gzip.compress(data) + gzip.compress(data)))) == 2 * len(parts)
    with pytest.raises(ValueError):
        list(parse_records(data[:-100]))
    with pytest.raises(ValueError):
        unchunked(chunked(b"abc")[:-7])
    rows_ = [(k, part) for k, part in enumerate(parts) if k != 2]
    path = Workspace(spark, "test-warc").path("broken")
    lines = spark.createDataFrame(rows_, "k int, v binary").selectExpr("cast(v as string) as value")
    lines.write.option("lineSep", "\r\n\r\n").text(path)
    with pytest.raises(Exception, match="missing|announced"):
        read_warc(spark, path).collect()
    assert warc.http_payload(b"HTTP/1.1 200 OK\r\n\r\nplain") == b"plain"
