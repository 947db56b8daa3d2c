"""WARC archives of pages: a deduplicating writer and a salvage reader.

Writer: one gzip member per record. Of pages with equal payloads the one with the largest id is the response; the others
are revisits that carry its record id, their own payload's digest and length, and no payload.

Reader: checks each record (version line, lengths, closing lines, block and payload digests, gzip checksum). After a
failed check it looks for the next place where a member or a version line begins and a whole record checks, goes on from
there, and logs the bytes between as a quarantined gap. A member may hold any number of records; they are checked and
salvaged one by one in its content. Digests by another algorithm than SHA-1, or none, are not judged. Nothing raises for bad
bytes: what is not a number of 64 bits in ASCII digits is none, so another page id is null.

Null html is an empty payload; a null id counts as the smallest; rows repeated in full get the same kind of record each;
an empty table gives no archives; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm.common import filesystem, new_path, partitions

MOST_SHARD = 64_000_000
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
START = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
BLANK = re.compile(rb"\r\n\r\n")


NUMBER = re.compile(r"-?[0-9]{1,19}")


def number(x: str | None) -> int | None:
    n = int(x) if x and NUMBER.fullmatch(x) else None
    return n if n is not None and -(1 << 63) <= n < 1 << 63 else None


class Damaged(ValueError):
    """A record that fails a check."""


def digest32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def sha1_of(header: str | None) -> str:
    """The digest of a header by SHA-1, in base32 (which some writers give in hexadecimal); empty for others."""
    kind, _, value = (header or "").partition(":")
    if kind.strip().lower() not in ("sha1", "sha-1"):
        return ""
    value = value.strip().upper()
    return digest32(bytes.fromhex(value)) if re.fullmatch(r"[0-9A-F]{40}", value) else value


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def compose(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """A record, as one gzip member."""
    digest = digest32(hashlib.sha1(payload).digest())
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": record_id(page_id, digest),
        "WARC-Date": date,
        "WARC-Target-URI": re.sub(r"[\x00-\x20\x7f]", "", url or "") or "about:blank",
        "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Block-Digest": f"sha1:{digest32(hashlib.sha1(block).digest())}",
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
        "X-Page-ID": "" if page_id is None else str(page_id),
    }
    if revisit:
        head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": record_id(refers_to, digest), "X-Refers-To-Page-ID": str(refers_to)}
    raw = b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"
    gz = zlib.compressobj(4, zlib.DEFLATED, 31)
    return gz.compress(raw) + gz.flush()


def parse(raw: bytes | memoryview) -> tuple[dict, bytes, int]:
    """(headers, block, bytes read) of the plain record at the start of `raw`; raises Damaged."""
    raw = memoryview(raw)
    if not VERSION.match(raw):
        raise Damaged("no version line")
    blank = BLANK.search(raw)
    if blank is None:
        raise Damaged("headers without an end")
    end, head = blank.start(), {}
    for line in bytes(raw[:end]).split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("a header line without a colon")
        head[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    length = number(head.get("content-length"))
    if length is None or length < 0:
        raise Damaged("no content length")
    stop = end + 4 + length
    if len(raw) < stop + 4 or bytes(raw[stop : stop + 4]) != b"\r\n\r\n":
        raise Damaged("a block cut or without its end")
    block = bytes(raw[end + 4 : stop])
    said = sha1_of(head.get("warc-block-digest"))
    if said and said != digest32(hashlib.sha1(block).digest()):
        raise Damaged("wrong block digest")
    return head, block, stop + 4


def member(data: memoryview, at: int) -> tuple[bytes, int]:
    """(content, end) of the gzip member at `at`; raises Damaged."""
    gz, out, pos = zlib.decompressobj(31), [], at
    try:
        while not gz.eof:
            part = data[pos : pos + 65536]
            if not len(part):
                raise Damaged("a gzip member without its end")
            out.append(gz.decompress(part))
            pos += len(part)
    except zlib.error as e:
        raise Damaged(f"gzip: {e}") from None
    return b"".join(out), pos - len(gz.unused_data)


Row = tuple[dict | None, bytes, str]


def rows_at(data: memoryview, at: int, plain: bool = False) -> tuple[Iterator[Row], int]:
    """((headers, block, "") of each record and (None, b"", reason) of each gap, end) of the plain record or the gzip member
    at `at`; raises Damaged if it holds no whole record. With `plain` there are no members."""
    if plain or bytes(data[at : at + 3]) != b"\x1f\x8b\x08":
        head, block, used = parse(data[at:])
        return iter([(head, block, "")]), at + used
    raw, end = member(data, at)
    inside = (x[2:] for x in salvage(raw, True))
    held = []
    for row in inside:
        held.append(row)
        if row[0] is not None:
            return chain(held, inside), end
    raise Damaged(held[0][2] if held else "an empty member")


def salvage(data: bytes | memoryview, plain: bool = False) -> Iterator[tuple[int, int, dict | None, bytes, str]]:
    """(start, end, headers, block, "") of each record and (start, end, None, b"", reason) of each gap, in order; they
    cover the bytes without overlap, but that all rows of a gzip member have the member's start and end."""
    view, at = memoryview(data), 0
    start = VERSION if plain else START
    while at < len(view):
        try:
            rows, end = rows_at(view, at, plain)
        except Damaged as e:
            reason, nxt, found = str(e), at + 1, None
            while found is None and (m := start.search(view, nxt)):
                nxt = m.start() + 1
                try:
                    found = (m.start(), *rows_at(view, m.start(), plain))
                except Damaged:
                    continue
            if found is None:
                yield at, len(view), None, b"", reason
                return
            yield at, found[0], None, b"", reason
            at, rows, end = found
        for row in rows:
            yield at, end, *row
        at = end


def revisits(pages: DataFrame, key: str, html: str, least: int = 0) -> DataFrame:
    """page_id, sha, refers_to of the rows to be written as revisits. Only ids and digests are shuffled."""
    skinny = pages.select(F.col(key).alias("page_id"), F.sha1(F.coalesce(F.col(html), F.lit("")).cast("binary")).alias("sha"), F.octet_length(F.coalesce(F.col(html), F.lit(""))).alias("n"))
    last = skinny.where(F.col("n") >= least).groupBy("sha").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("rows")).where("rows > 1 AND refers_to IS NOT NULL")
    older = skinny.join(last, "sha").where("page_id IS NULL OR page_id < refers_to")
    return older.select("page_id", "sha", "refers_to").distinct()


def write(pages: DataFrame, path: str | None = None, key: str = "page_id", url: str = "url", html: str = "html", least: int = 0, date: str = "2024-01-01T00:00:00Z") -> list[str]:
    """Write the archives; their paths. Payloads of under `least` bytes are responses all. One shuffle of the pages, by
    id; a task closes an archive beyond 64 MB, and only those of a task's successful attempt are returned."""
    root = path or new_path(pages.sparkSession, "warc")
    fs, folder = filesystem(root)
    fs.create_dir(folder, recursive=True)

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = filesystem(root)
        name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        done, out, size = [], None, 0
        for batch in batches:
            for i in range(batch.num_rows):
                page, link, text, refers = (batch.column(c)[i].as_py() for c in range(4))
                if out is None:
                    done.append(f"{name}-{len(done):04d}.warc.gz")
                    out, size = files.open_output_stream(f"{base}/{done[-1]}", compression=None), 0
                data = compose(page, link, (text or "").encode(), refers, date)
                out.write(data)
                size += len(data)
                if size > MOST_SHARD:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        if done:
            yield pa.RecordBatch.from_pydict({"path": [f"{root}/{d}" for d in done]})

    own = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    old = revisits(own, "page_id", "html", least).select(F.col("page_id").alias("old_id"), F.col("sha").alias("old_sha"), "refers_to")
    sha = F.sha1(F.coalesce(F.col("html"), F.lit("")).cast("binary"))
    joined = own.withColumn("sha", sha).join(old, F.col("page_id").eqNullSafe(F.col("old_id")) & (F.col("sha") == F.col("old_sha")), "left")
    # a row for each archive
    return [r[0] for r in joined.select("page_id", "url", "html", "refers_to").mapInArrow(archive, "path string").collect()]


def read(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Rows of all records and gaps of the archives: kind (record or gap), path, start, end, reason, record_type, page_id,
    url, payload, payload_bytes, payload_digest, refers_to. A response whose payload does not have the digest that its
    header gives is a gap. A revisit's payload length and digest are those its headers give."""
    schema = "kind string, path string, start long, end long, reason string, record_type string, page_id long, url string, payload binary, payload_bytes long, payload_digest string, refers_to long"
    if not paths:
        return spark.createDataFrame([], schema)

    def rows(file: str) -> Iterator[dict]:
        fs, name = filesystem(file)
        with fs.open_input_file(name) as f:
            data = f.read_buffer()
        for start, end, head, block, reason in salvage(memoryview(data)):
            row = {"kind": "gap", "path": file, "start": start, "end": end, "reason": reason or None}
            if head is not None:
                http, _, payload = block.partition(b"\r\n\r\n")
                digest = sha1_of(head.get("warc-payload-digest"))
                kind = head.get("warc-type")
                said = re.search(rb"(?i)\r\ncontent-length:[ \t]*([0-9]+)", http)
                row |= {"kind": "record", "record_type": kind, "page_id": number(head.get("x-page-id")), "url": head.get("warc-target-uri")}
                if kind == "revisit":
                    row |= {"payload_bytes": number(said[1].decode()) if said else None, "payload_digest": digest or head.get("warc-payload-digest"), "refers_to": number(head.get("x-refers-to-page-id"))}
                else:
                    real = digest32(hashlib.sha1(payload).digest())
                    if digest and real != digest:
                        row = {"kind": "gap", "path": file, "start": start, "end": end, "reason": "wrong payload digest"}
                    else:
                        row |= {"payload": payload, "payload_bytes": len(payload), "payload_digest": real}
            yield row

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for file in part.column(0).to_pylist():
                held, size = [], 0
                for row in rows(file):
                    held.append(row)
                    size += row.get("payload_bytes") or 0
                    if size > 8_000_000 or len(held) > 5000:
                        yield pa.RecordBatch.from_pylist(held, schema=arrow)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=arrow)

    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    arrow = pa.schema([(n, kinds[t]) for n, t in (c.split() for c in schema.split(", "))])
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    return files.repartition(min(len(paths), 8 * partitions(spark))).mapInArrow(batches, schema)


#: DuckDB SQL for page_id, payload_bytes, payload_digest, record_type, refers_to of the records over the table `pages`. A
#: fifth of the digest's 40 hexadecimal digits is 20 bits, four characters of base32.
SQL = """
WITH d AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT h, max(page_id) AS last FROM d GROUP BY h),
r AS (SELECT d.*, CASE WHEN page_id IS NULL OR page_id < last THEN last END AS refers_to FROM d JOIN m USING (h))
SELECT page_id, n AS payload_bytes, refers_to, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, CAST((i // 4) * 5 + 1 AS INT), 5) AS INT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31 AS INT) + 1, 1)), '') AS payload_digest
FROM r
"""
