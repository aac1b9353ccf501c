"""Media columns: content-addressed payloads in tar shards, rows that carry digest, offset and length, ranged reads."""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborix.llm.arrays import read_range, write_bytes
from arborix.llm.common import bloom, join_to_groups, materialize, scratch_dir, small_batches

#: Samples in a row of the image; payloads are padded with spaces to a positive multiple.
WIDTH = 192
#: Bytes after which a task begins a new shard, and bytes of a shard that one task reads back.
SHARD = 32 << 20
STRIPE = 8 << 20
#: Signature and header chunk of a PNG file.
HEADER = 33
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(payload: bytes) -> bytes:
    """A greyscale PNG with 8 bits a sample, WIDTH samples a row."""
    rows = np.frombuffer(payload, dtype=np.uint8).reshape(-1, WIDTH)
    filtered = np.zeros((len(rows), WIDTH + 1), dtype=np.uint8)
    filtered[:, 1:] = rows
    return _SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(filtered.tobytes(), 6)) + _chunk(b"IEND", b"")


def header(data: bytes) -> tuple[int, int, int]:
    """Width, height and bits a sample, from the first HEADER bytes."""
    if data[:8] != _SIGNATURE or data[12:16] != b"IHDR":
        raise ValueError("not a PNG header")
    return struct.unpack(">IIB", data[16:25])


def decode(data: bytes) -> bytes:
    """The payload of a file that :func:`encode` made; its checksums have to hold."""
    width, height, _ = header(data)
    at, packed = 8, []
    while at < len(data):
        (n,) = struct.unpack(">I", data[at : at + 4])
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("damaged chunk")
        if kind == b"IDAT":
            packed.append(body)
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), dtype=np.uint8).reshape(height, width + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows")
    return rows[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Rows, mean, deviation and the shares of sixteen ranges of samples."""
    x = np.frombuffer(payload, dtype=np.uint8)
    shares = np.bincount(x >> 4, minlength=16) / len(x)
    return f"{len(x) // WIDTH};{x.mean():.6f};{x.std():.6f};" + ",".join(f"{s:.5f}" for s in shares)


def payloads(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """``docs`` with n_bytes, payload (UTF-8, padded with spaces to a positive multiple of WIDTH) and payload_sha256."""
    whole = F.coalesce(F.col(text), F.lit(""))
    size = F.octet_length(whole)
    padded = F.concat(whole, F.repeat(F.lit(" "), F.greatest(F.ceil(size / WIDTH), F.lit(1)).cast("int") * WIDTH - size)).cast("binary")
    return docs.select("doc_id", size.cast("long").alias("n_bytes"), F.sha2(padded, 256).alias("payload_sha256"), padded.alias("payload"))


def store(rows: DataFrame, folder: str) -> DataFrame:
    """Writes each distinct payload once; a catalogue (payload_sha256, shard, offset, length, rows), ``rows`` being how often the payload occurs.

    A counting Bloom filter tells which digests may repeat. Payloads of all other rows go from their task straight into
    its shard; the rest meet by digest first. Shards have new names, so a task that runs again leaves whole files.
    """
    hashed = F.xxhash64("payload_sha256")
    repeats = bloom(rows.select(hashed.alias("h")), at_least=2)
    flagged = rows.select("payload_sha256", "payload", repeats.may_hold(hashed).alias("maybe"))
    once = flagged.where("maybe").groupBy("payload_sha256").agg(F.any_value("payload").alias("payload"), F.count(F.lit(1)).alias("rows"))

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        buffer, tar, placed, name = None, None, [], ""
        for frame in frames:
            for digest, payload, n in zip(frame["payload_sha256"], frame["payload"], frame["rows"], strict=True):
                if tar is None:
                    buffer, placed, name = io.BytesIO(), [], f"{folder}/shard-{uuid.uuid4().hex}.tar"
                    tar = tarfile.open(fileobj=buffer, mode="w", format=tarfile.USTAR_FORMAT)
                data = encode(payload)
                info = tarfile.TarInfo(f"{digest}.png")
                info.size = len(data)
                tar.addfile(info, io.BytesIO(data))
                placed.append((digest, name, buffer.tell() - -(-len(data) // 512) * 512, len(data), n))
                if buffer.tell() >= SHARD:
                    yield close(buffer, tar, placed, name)
                    tar = None
        if tar is not None:
            yield close(buffer, tar, placed, name)

    def close(buffer: io.BytesIO, tar: tarfile.TarFile, placed: list, name: str) -> pd.DataFrame:
        tar.close()
        write_bytes(name, buffer.getvalue())
        return pd.DataFrame(placed, columns=["payload_sha256", "shard", "offset", "length", "rows"])

    schema = "payload_sha256 string, shard string, offset long, length long, rows long"
    alone = flagged.where("not maybe").select("payload_sha256", "payload", F.lit(1).cast("long").alias("rows")).mapInPandas(write, schema)
    return materialize(alone.unionByName(once.mapInPandas(write, schema)))


def metadata(catalogue: DataFrame) -> DataFrame:
    """The catalogue with width, height and bits of each file, by reads of HEADER bytes; nothing else of a shard is read."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [header(read_range(shard, offset, HEADER)) for shard, offset in zip(frame["shard"], frame["offset"], strict=True)]
            yield frame.assign(**{c: pd.Series([x[i] for x in found], index=frame.index, dtype="int32") for i, c in enumerate(("width", "height", "bits"))})

    schema = "payload_sha256 string, shard string, offset long, length long, rows long, width int, height int, bits int"
    return catalogue.select("payload_sha256", "shard", "offset", "length", "rows").mapInPandas(read, schema)


def read_back(catalogue: DataFrame) -> DataFrame:
    """The catalogue with digests, lengths and features of what its shards hold, each file read whole and checked against its digest."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for digest, shard, offset, length in zip(*(frame[c] for c in ("payload_sha256", "shard", "offset", "length")), strict=True):
                data = read_range(shard, offset, length)
                payload = decode(data)
                if hashlib.sha256(payload).hexdigest() != digest:
                    raise ValueError(f"{shard} does not hold {digest} at {offset}")
                rows.append((len(payload), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature(payload)))
            made = pd.DataFrame(rows, columns=["payload_bytes", "tail_crc32", "media_bytes", "media_sha256", "feature"], index=frame.index)
            yield pd.concat([frame[kept], made], axis=1)

    kept = [c for c in catalogue.columns if c != "length"]
    types = dict(catalogue.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in kept) + ", payload_bytes long, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return catalogue.mapInPandas(read, schema)


def media_columns(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_bytes, digests, lengths and features of its payload as read back, and where it is stored.

    Null texts are empty; the empty text is one row of spaces. Rows with equal payloads share one stored copy (texts
    that differ in trailing spaces only may). Rows keep their number, null and repeated doc_ids included; extra columns
    play no part; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    rows = payloads(docs)
    catalogue = store(rows, f"{scratch_dir(docs.sparkSession)}/media")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    striped = catalogue.repartition(n, F.col("shard"), F.expr(f"offset div {STRIPE}")).sortWithinPartitions("shard", "offset")
    stored = read_back(metadata(striped))
    return join_to_groups(rows.select("doc_id", "n_bytes", "payload_sha256"), stored, "payload_sha256", "rows", sizes=catalogue).drop("rows")


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads of all documents, stored and read back: digests, lengths, features and header fields."""
    found = media_columns(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "bits")
