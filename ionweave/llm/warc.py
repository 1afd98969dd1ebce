"""WARC archives: writing with revisits and segments, reading with segment reassembly.

A record's HTTP block uses chunked transfer framing; a block above segment_bytes is split into a first record and
`continuation` records. Reading groups continuations by the identifier of their origin, orders them by segment number, checks the total
length and decodes the chunks. Archives are files of a bounded number of records, each record a gzip member of its own, written
and read through Spark's own file system layer, so any store that Spark reaches will do.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ionweave.llm.common import BROADCAST_IDS, Workspace

SEGMENT_BYTES, CHUNK_BYTES, RECORDS_PER_FILE = 16_384, 4_096, 4_096
#: A gzip member ends with the highest byte of its content's size, which is 0 below 16 MiB.
MEMBER_BYTES = 8 << 20
_HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
_DATE = "2000-01-01T00:00:00Z"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    out = b"".join(b"%x\r\n%b\r\n" % (len(part), part) for part in (payload[i : i + size] for i in range(0, len(payload), size)))
    return out + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if size == 0:
            return b"".join(out)
        part = body[end + 2 : end + 2 + size]
        if len(part) != size or body[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("a chunk is cut short")
        out.append(part)
        at = end + 4 + size


def http_payload(block: bytes) -> bytes:
    head, _, body = block.partition(b"\r\n\r\n")
    return unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def _clean(value: str) -> str:
    """A header's value stands on one line."""
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    """Without the two line ends behind a record, which the writer adds."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", kind), *fields, ("WARC-Date", _DATE), ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block


def member(record: bytes) -> bytes:
    """The record and its two line ends as a gzip member; one above MEMBER_BYTES as several, which read as one."""
    whole = record + b"\r\n\r\n"
    return b"".join(zlib.compress(whole[i : i + MEMBER_BYTES], 6, 31) for i in range(0, len(whole), MEMBER_BYTES))


def record_name(page: int | None, sha: bytes, url_hash: int, nth: int) -> str:
    """The record id of a page's row, the same whoever writes it; rows that are equal in all this are numbered."""
    return f"urn:page:{'' if page is None else page}:{sha.hex()[:16]}:{url_hash & 0xFFFFFFFFFFFFFFFF:x}" + (f":{nth}" if nth else "")


def records(name: str, url: str, payload: bytes, refers_to: str | None, segment_bytes: int) -> list[bytes]:
    """The records of one page: a revisit, or a response with its continuations."""
    fields = [("WARC-Record-ID", f"<{name}>"), ("WARC-Target-URI", _clean(url)), ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}")]
    if refers_to is not None:
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        return [_record("revisit", [*fields, ("WARC-Profile", profile), ("WARC-Refers-To", f"<{refers_to}>")], b"")]
    kind = ("Content-Type", "application/http; msgtype=response")
    block = _HTTP_HEAD + chunked(payload)
    if len(block) <= segment_bytes:
        return [_record("response", [*fields, kind], block)]
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    out = [_record("response", [*fields, kind, ("WARC-Segment-Number", "1")], parts[0])]
    for n, part in enumerate(parts[1:], 2):
        own = [("WARC-Record-ID", f"<{name}:{n}>"), ("WARC-Segment-Origin-ID", f"<{name}>"), ("WARC-Segment-Number", str(n))]
        out.append(_record("continuation", own + [("WARC-Segment-Total-Length", str(len(block)))] * (n == len(parts)), part))
    return out


def write_warc(
    pages: DataFrame, path: str, space: Workspace, id_col: str = "page_id", url_col: str = "url", payload: Column | None = None, min_revisit: int = 0, segment_bytes: int = SEGMENT_BYTES
) -> None:
    """Writes an archive folder with a record for each row of pages.

    Of rows with equal payloads of at least min_revisit bytes, those with the smallest id are responses and the others
    revisit one of these: its record id stands in their WARC-Refers-To. A null payload is an empty one, a null url an empty
    one; a null id comes after all others. Rows that repeat an id and a payload are all responses or all revisits.
    Payloads of any length are cut into segments. An empty table gives an empty folder; other columns are ignored.
    """
    body = F.coalesce(payload if payload is not None else F.col("html").cast("binary"), F.lit(b""))
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), url.alias("url"), body.alias("body"), F.unhex(F.sha1(body)).alias("sha"), F.xxhash64(url).alias("url_hash"))
    marks = space.write(rows.select("id", "sha", "url_hash", (F.octet_length("body") >= min_revisit).alias("large")), "marks")
    firsts = marks.where("large").groupBy("sha").agg(F.min(F.when(F.col("id").isNotNull(), F.struct("id", "url_hash"))).alias("first"), F.count("*").alias("n"))
    # written, so that the join deals both sides itself: many rows may share one payload, and the skew join then splits them
    firsts = space.write(firsts.where("n > 1 and first is not null").select("sha", "first"), "firsts")
    revisits = space.write(marks.join(firsts, "sha").where("not (id <=> first.id)").select("id", "sha", "first").distinct(), "revisits")
    # rows that repeat all of this are written from one of them, so that their numbers don't depend on who counts
    again = space.write(marks.groupBy("id", "sha", "url_hash").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "again")
    single = rows.withColumn("nth", F.lit(0).cast("long"))
    if not again.isEmpty():
        grouped = _beside(rows, again, ["id", "sha", "url_hash"], "left_semi").groupBy("id", "sha", "url_hash").agg(F.first("url").alias("url"), F.first("body").alias("body"), F.count("*").alias("n"))
        numbered = grouped.withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
        single = _beside(single, again, ["id", "sha", "url_hash"], "left_anti").unionByName(numbered.drop("n"))
    told = _beside(single, revisits, ["id", "sha"], "left")
    named = told.select("id", "url", "body", "sha", "url_hash", "nth", F.col("first.id").alias("first_id"), F.col("first.url_hash").alias("first_url"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                out: list[bytes] = []
                for page, address, raw, sha, url_hash, nth, first, first_url in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    refers = None if first is None else record_name(first, sha, first_url, 0)
                    out += [member(r)[:-1] for r in records(record_name(page, sha, url_hash, nth), address, raw, refers, segment_bytes)]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    lines = named.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
    # the zero byte that ends a member is the writer's line separator
    lines.write.mode("overwrite").option("lineSep", "\0").option("compression", "none").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def _beside(rows: DataFrame, keys: DataFrame, on: list[str], how: str) -> DataFrame:
    """rows joined with a written table of keys, nulls too; the keys are broadcast where they are counted at BROADCAST_IDS at most."""
    right = keys.select(*[F.col(c).alias(f"_{c}") for c in on], *[c for c in keys.columns if c not in on])
    equal = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in on]
    if keys.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        return rows.join(F.broadcast(right), equal, how)
    return rows.hint("shuffle_merge").join(right, equal, how)


def _inflated(data: bytes) -> Iterator[bytes]:
    """Pieces of a gzip file with any number of members; other files as they are."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    view, piece = memoryview(data), 1 << 16
    inflate = zlib.decompressobj(31)
    for at in range(0, len(view), piece):
        part: bytes = bytes(view[at : at + piece])
        while part:
            yield inflate.decompress(part)
            part = inflate.unused_data
            if inflate.eof:
                inflate = zlib.decompressobj(31)
    if tail := inflate.flush():
        yield tail


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields by lower-case name, block) of each record of an archive file."""
    buffer = bytearray()
    need = 0
    for piece in _inflated(data):
        buffer += piece
        at = 0
        while len(buffer) - at >= max(need, 1):
            end = buffer.find(b"\r\n\r\n", at)
            if end < 0:
                break
            head = bytes(buffer[at:end]).decode()
            fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.split("\r\n")[1:])}
            stop = end + 4 + int(fields["content-length"])
            if len(buffer) < stop + 4:
                need = stop + 4 - at
                break
            need = 0
            if not head.startswith("WARC/") or buffer[stop : stop + 4] != b"\r\n\r\n":
                raise ValueError("no record where one should begin or end")
            yield fields, bytes(buffer[end + 4 : stop])
            at = stop + 4
        if at:
            del buffer[:at]
    if buffer.strip():
        raise ValueError("an archive ends within a record")


DECODED = "name string, record_type string, url string, refers_to string, header_digest string, payload_bytes long, payload_digest string, payload binary"
#: Whole records are decoded where they are read; segments keep their blocks until they are joined.
PARSED = f"{DECODED}, origin string, number int, total long, block binary"


def _packed(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[kind]) for c, (_, kind) in zip(zip(*rows, strict=True), fields, strict=True)], names=[name for name, _ in fields])


def _decoded(head: tuple, block: bytes, with_payload: bool) -> tuple:
    """head (name, record_type, url, refers_to, header_digest) with the payload's size, digest and bytes; revisits have none of their own."""
    if head[1] == "revisit":
        return (*head, None, head[4], None)
    payload = http_payload(block)
    digest = base32_sha1(payload)
    if head[4] is not None and digest != head[4]:
        raise ValueError(f"payload digest {digest}, but {head[4]} was announced")
    return (*head, len(payload), digest, payload if with_payload else None)


def _parsed(spark: SparkSession, path: str, with_payload: bool) -> DataFrame:
    """The records of an archive folder, each file inflated once: whole ones decoded, segments as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            for k in range(batch.num_rows):
                for f, block in parse_records(batch.column(0)[k].as_py()):
                    name, refers, digest = f["warc-record-id"].strip("<>"), f.get("warc-refers-to"), f.get("warc-payload-digest")
                    head = (name, f["warc-type"], f.get("warc-target-uri"), refers and refers.strip("<>"), digest and digest.removeprefix("sha1:"))
                    if (number := f.get("warc-segment-number")) is None:
                        rows.append((*_decoded(head, block, with_payload), None, None, None, None))
                        size += len(block) * with_payload + 200
                    else:
                        total = f.get("warc-segment-total-length")
                        rows.append((*head, None, None, None, f.get("warc-segment-origin-id", name).strip("<>"), int(number), total and int(total), block))
                        size += len(block) + 200
                    if size > 8 << 20:
                        yield _packed(rows, PARSED)
                        rows, size = [], 0
        if rows:
            yield _packed(rows, PARSED)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(run, PARSED)


def _joined(segments: DataFrame, with_payload: bool) -> DataFrame:
    """Whole records out of segments: each origin's rows meet in one task, sorted, and are joined one record at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head: tuple | None = None
        origin, total = None, None
        blocks: list[bytes] = []

        def close() -> pa.RecordBatch:
            if total is None or sum(map(len, blocks)) != total:
                raise ValueError(f"{origin}: segments of {sum(map(len, blocks))} bytes, but {total} were announced")
            return _packed([_decoded(head, b"".join(blocks), with_payload)], DECODED)

        for batch in batches:
            for *fields, of, number, announced, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if head is None or of != origin:
                    if head is not None:
                        yield close()
                    head, origin, total, blocks = tuple(fields[:5]), of, None, []
                if number != len(blocks) + 1:
                    raise ValueError(f"{of}: segment {len(blocks) + 1} is missing")
                blocks.append(block)
                total = announced if announced is not None else total
        if head is not None:
            yield close()

    return segments.repartition("origin").sortWithinPartitions("origin", "number").mapInArrow(run, DECODED)


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """A row for each whole record of an archive folder; a revisit has no payload of its own.

    payload_digest is taken from the payload read; one that differs from the record's own field is an error, as are missing segments, a
    wrong total length and broken chunks.
    """
    table = Workspace(spark, "warc-read").write(_parsed(spark, path, with_payload), "records")
    whole = table.where("origin is null").drop("origin", "number", "total", "block")
    return whole.unionByName(_joined(table.where("origin is not null"), with_payload))


def round_trip(pages: DataFrame, id_col: str = "page_id", min_revisit: int = 0, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Writes pages to an archive in the shared folder and reads it back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A row for each row of pages. What a revisit refers to, and its size, are read from the record that its WARC-Refers-To
    names; a reference to no record of the archive is an error. Nulls, repeats, empty tables and other columns: as write_warc says.
    """
    space = Workspace(pages.sparkSession, "warc")
    write_warc(pages, space.path("archive"), space, id_col, min_revisit=min_revisit, segment_bytes=segment_bytes)
    page = F.expr("try_cast(nullif(regexp_extract(name, '^urn:page:(-?[0-9]*):', 1), '') as bigint)")
    read = space.write(read_warc(pages.sparkSession, space.path("archive"), with_payload=False).select(page.alias("page_id"), "name", "payload_bytes", "payload_digest", "record_type", "refers_to"), "read")
    # one row a payload that others refer to; written, so that the skew join can split the many rows that refer to one record
    wanted = read.where("refers_to is not null").select("refers_to").distinct().withColumnRenamed("refers_to", "name")
    origins = read.join(wanted, "name").select(F.col("name").alias("refers_to"), F.col("page_id").alias("origin_id"), F.col("payload_bytes").alias("origin_bytes"), F.lit(True).alias("found"))
    out = read.join(space.write(origins, "origins"), "refers_to", "left")
    named = F.when(F.col("refers_to").isNotNull() & F.col("found").isNull(), F.raise_error(F.concat(F.lit("no record is named "), "refers_to"))).otherwise(F.col("origin_id"))
    return out.select("page_id", F.coalesce("payload_bytes", "origin_bytes").alias("payload_bytes"), "payload_digest", "record_type", named.cast("long").alias("refers_to"))
