"""Token ids as length-delimited binary records with a separate offset index.

A shard is a run of records; a record is  u64 length | u32 masked checksum of those 8 bytes | payload | u32 masked
checksum of the payload, all little-endian. A checksum is CRC-32, masked as ((c >> 15 | c << 17) + 0xa282ead8) mod 2^32
so that a checksum of data that holds checksums stays sound. A payload is  u8 version | u8 bytes an id | u8 whether the
key is present | u8 0 | i64 key | u32 number of ids | ids. The index beside a shard has  u64 offset | u64 length | i64 key
for each record, so that readers can fetch records in any order.

Records are in ascending order of the key over all shards (null keys first, equal keys by a hash of the text, then the
text). A task closes a shard beyond `SHARD_BYTES`, so shards and the indexes that tasks hold are bounded. Null texts are
empty sequences (end id only); an empty table gives no shards; columns other than key and text are not read.
"""

from __future__ import annotations

import random
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm.common import filesystem, new_path, partitions, small_batches, tidy
from kinfold.llm.tokens import encoder, text_runs

HEAD, TAIL, META = "<QI", "<I", "<BBBBqI"
HEAD_SIZE, TAIL_SIZE, META_SIZE = map(struct.calcsize, (HEAD, TAIL, META))
SHARD_BYTES = 64_000_000
INDEX = np.dtype([("offset", "<u8"), ("length", "<u8"), ("key", "<i8")])


class Corrupt(ValueError):
    """A record whose length or checksum does not hold."""


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17 & 0xFFFFFFFF) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return struct.pack(HEAD, len(payload), masked(length)) + payload + struct.pack(TAIL, masked(payload))


def unframe(data: bytes | memoryview, at: int = 0) -> tuple[bytes, int]:
    """(payload, where the next record begins); raises Corrupt."""
    if at + HEAD_SIZE > len(data):
        raise Corrupt(f"record at {at}: cut in its head")
    length, check = struct.unpack_from(HEAD, data, at)
    if masked(bytes(data[at : at + 8])) != check:
        raise Corrupt(f"record at {at}: wrong checksum of its length")
    end = at + HEAD_SIZE + length
    if end + TAIL_SIZE > len(data):
        raise Corrupt(f"record at {at}: cut in its payload")
    payload = bytes(data[at + HEAD_SIZE : end])
    if masked(payload) != struct.unpack_from(TAIL, data, end)[0]:
        raise Corrupt(f"record at {at}: wrong checksum of its payload")
    return payload, end + TAIL_SIZE


def pack_ids(key: int | None, ids: np.ndarray) -> bytes:
    return struct.pack(META, 1, ids.dtype.itemsize, key is not None, 0, key or 0, len(ids)) + ids.tobytes()


def unpack_ids(payload: bytes) -> tuple[int | None, np.ndarray]:
    version, width, has, _, key, n = struct.unpack_from(META, payload)
    if version != 1 or len(payload) != META_SIZE + n * width:
        raise Corrupt("payload of another version or length")
    return key if has else None, np.frombuffer(payload, f"<u{width}", n, META_SIZE)


def crc_of(ids: np.ndarray) -> int:
    """Unsigned CRC-32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())


def write(docs: DataFrame, path: str | None, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int | None = 2) -> list[dict]:
    """Encode `text` of every row, append `end_id`, and write shards in ascending order of `key`.

    One range shuffle of (key, text); rows of one key are split by a hash of their text. Each attempt of a task writes files
    of its own name; only those of the attempt that ended well enter the manifest, which is returned in order: shard, index,
    records, ids, and ids before the shard. It has a row for each shard.
    """
    spark = docs.sparkSession
    root = path or new_path(spark, "records")
    fs, folder = filesystem(root)
    fs.create_dir(folder, recursive=True)

    def write_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, out, at, index, n_ids, turn = encoder(tokenizer), None, 0, [], 0, 0
        part = TaskContext.get().partitionId()
        name = f"{part:06d}-{uuid.uuid4().hex}"
        files, base = filesystem(root)
        end = np.array([] if end_id is None else [end_id], enc.dtype)

        def close() -> pa.RecordBatch:
            out.close()
            with files.open_output_stream(f"{base}/{name}-{turn:04d}.idx") as f:
                f.write(np.array(index, INDEX).tobytes())
            return pa.RecordBatch.from_pydict({"part": [part], "turn": [turn], "shard": [f"{root}/{name}-{turn:04d}.rec"], "index": [f"{root}/{name}-{turn:04d}.idx"], "records": [len(index)], "ids": [n_ids]})

        for batch in batches:
            for _, rows in text_runs(batch):
                ids, starts = enc.encode_arrow(rows.column("text"))
                for k, a, b in zip(rows.column("key").to_pylist(), starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                    if out is None:
                        out = files.open_output_stream(f"{base}/{name}-{turn:04d}.rec")
                    own = np.concatenate([ids[a:b], end])
                    data = frame(pack_ids(k, own))
                    index.append((at, len(data), k or 0))
                    out.write(data)
                    at, n_ids = at + len(data), n_ids + len(own)
                    if at > SHARD_BYTES:
                        yield close()
                        out, at, index, n_ids, turn = None, 0, [], 0, turn + 1
        if out is not None:
            yield close()

    n = partitions(spark)
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), F.xxhash64(text).alias("tie"))
    ordered = rows.repartitionByRange(n, "key", "tie").sortWithinPartitions("key", "tie", F.col("text").asc_nulls_first()).drop("tie")
    with small_batches(spark):
        found = ordered.mapInArrow(tidy(write_shards), "part long, turn long, shard string, index string, records long, ids long").collect()
    manifest, before = [], 0
    for r in sorted(found, key=lambda r: (r["part"], r["turn"])):
        manifest.append({**r.asDict(), "before": before})
        before += r["ids"]
    return manifest


def read(spark: SparkSession, manifest: list[dict]) -> DataFrame:
    """One row per record, read and checked from the shards: key, start (ids of all records before it), n_tokens,
    ids_crc32, shard, offset. Raises Corrupt on a record that does not check."""
    schema = "key long, start long, n_tokens long, ids_crc32 long, shard string, offset long"
    if not manifest:
        return spark.createDataFrame([], schema)

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                fs, file = filesystem(r["shard"])
                start, at, out = r["before"], 0, []
                with fs.open_input_stream(file, buffer_size=1 << 20) as f:
                    while head := f.read(HEAD_SIZE):
                        length, check = struct.unpack(HEAD, head) if len(head) == HEAD_SIZE else (0, -1)
                        if check != masked(head[:8]):
                            raise Corrupt(f"{file}: record at {at}: wrong checksum of its length")
                        body = f.read(length + TAIL_SIZE)
                        if len(body) < length + TAIL_SIZE:
                            raise Corrupt(f"{file}: record at {at}: cut in its payload")
                        payload, _ = unframe(head + body)
                        key, ids = unpack_ids(payload)
                        out.append((key, start, len(ids), crc_of(ids), r["shard"], at))
                        start, at = start + len(ids), at + HEAD_SIZE + len(body)
                        if len(out) == 20_000:
                            yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in out], schema=arrow)
                            out = []
                if len(out):
                    yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in out], schema=arrow)

    names = ["key", "start", "n_tokens", "ids_crc32", "shard", "offset"]
    arrow = pa.schema([(n, pa.string() if n == "shard" else pa.int64()) for n in names])
    shards = spark.createDataFrame([(m["shard"], m["before"]) for m in manifest], "shard string, before long")
    return shards.repartition(min(len(manifest), partitions(spark))).mapInArrow(tidy(records), schema)


def fetch(shard: str, offset: int, length: int) -> tuple[int | None, np.ndarray]:
    """One record by its place in the index."""
    fs, file = filesystem(shard)
    with fs.open_input_file(file) as f:
        return unpack_ids(unframe(f.read_at(length, offset))[0])


def shuffled(manifest: list[dict], seed: int = 0) -> Iterator[tuple[int | None, np.ndarray]]:
    """All records in a shuffled order: shards in random order, each shard's records in random order by its index."""
    rng = random.Random(seed)
    for m in rng.sample(manifest, len(manifest)):
        fs, file = filesystem(m["index"])
        with fs.open_input_stream(file) as f:
            index = np.frombuffer(f.read(), INDEX)
        for i in rng.sample(range(len(index)), len(index)):
            yield fetch(m["shard"], int(index["offset"][i]), int(index["length"][i]))
