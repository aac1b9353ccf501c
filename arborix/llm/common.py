"""What several operators share: scratch tables, word arithmetic on UTF-8 bytes, sorted groups, a counting Bloom filter."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arborix.llm.arrays import open_array, write_array

# ---------------------------------------------------------------- scratch tables


_local_roots: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """A new folder name below the shared folder in ``spark.checkpoint.dir``.

    Where that is unset a local master gets a temporary folder that goes with the driver; on a cluster it is an error, as
    executors would write to disks that the driver does not see. The session's settings are not changed.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        context = spark.sparkContext
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        if context.applicationId not in _local_roots:
            folder = tempfile.mkdtemp(prefix="spark-arborix-")
            atexit.register(shutil.rmtree, folder, True)
            _local_roots[context.applicationId] = f"file://{folder}"
        root = _local_roots[context.applicationId]
    return f"{root.rstrip('/')}/arborix-{uuid.uuid4().hex}"


def materialize(df: DataFrame, *, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage ends there, so lost executors cost no recomputation."""
    path = scratch_dir(df.sparkSession)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    stored._stored_at = path
    return stored


def small_batches(spark: SparkSession, rows: int = 1024, size: int = 8 << 20) -> None:
    """Lets this session hand Python workers at most ``rows`` rows and about ``size`` bytes at once; a lower setting stays.

    The default of 10,000 rows is made for narrow rows; with whole texts it decides how much memory a worker holds. The
    setting is read when a plan runs, which is after an operator has returned, so it cannot be taken back here.
    """
    now = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if not 0 < now <= rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def discard(*tables: DataFrame) -> None:
    """Deletes tables that :func:`materialize` gave, once nothing reads them any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table._stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def crc_fold(column: str | Column, modulus: int) -> Column:
    """crc32 of the id as decimal text, modulo ``modulus``; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string") if isinstance(column, str) else column.cast("string"), F.lit(""))) % modulus


# ---------------------------------------------------------------- words on bytes

#: Word separators: space, tab, line feed, vertical tab, form feed, carriage return.
SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.ones(256, dtype=bool)
IS_WORD[list(SEPARATORS)] = False
BATCH_BYTES = 1 << 20


def mix64(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


_TABLE = np.random.default_rng(20240229).integers(0, 1 << 64, size=64 * 256, dtype=np.uint64)


def spans(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes of all texts, word starts and ends, the first word of each text (one more entry at the end), text starts."""
    raw = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", dtype=np.uint8)
    buf = LOWER[raw]
    word = IS_WORD[buf]
    edges = np.flatnonzero(word[1:] != word[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    at = np.concatenate(([1], 1 + np.cumsum(lengths + 1)))
    return buf, starts, ends, np.searchsorted(starts, at), at


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: position-wise random table entries, summed and mixed."""
    if not len(starts):
        return np.empty(0, np.uint64)
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    position = np.arange(lengths.sum(), dtype=np.int32) - np.repeat(first.astype(np.int32), lengths)
    index = position + np.repeat(starts.astype(np.int32), lengths)
    values = _TABLE[((position & 63) << 8) | buf[index]]
    if lengths.max() > 64:
        values *= ((position >> 6) * 2 + 1).astype(np.uint64)
    return mix64(np.add.reduceat(values, first) + lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def batches(texts: list[str | None], limit: int = BATCH_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts as UTF-8 with about ``limit`` bytes each, and where each run starts; null counts as empty."""
    run: list[bytes] = []
    size, begun = 0, 0
    for i, text in enumerate(texts):
        b = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""
        if run and size + len(b) > limit:
            yield begun, run
            run, size, begun = [], 0, i
        run.append(b)
        size += len(b)
    if run:
        yield begun, run


# ---------------------------------------------------------------- groups without a frame for each


def map_sorted_groups(
    df: DataFrame, keys: list[str], fn: Callable[[dict[str, np.ndarray]], pd.DataFrame | None], schema: str, order: list[str] | None = None, *, parts: int | None = None
) -> DataFrame:
    """``fn`` on each group of equal ``keys`` as a dict of column arrays.

    The rows are dealt out by key and sorted, and each task walks through its groups; only one group, whose size the
    caller bounds, is held at a time. Cheaper than applyInPandas where groups are many and small. Where groups are few
    and large, and the first key numbers them from 0 to ``parts``, each number gets a task of its own.
    """
    names = df.columns
    dealt = df.repartitionById(parts, keys[0]) if parts else df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), *keys)

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: dict[str, np.ndarray] | None = None
        for frame in frames:
            now = {c: frame[c].to_numpy() for c in names}
            if rest is not None:
                now = {c: np.concatenate([rest[c], now[c]]) for c in names}
            size = len(now[names[0]])
            if not size:
                continue
            change = np.zeros(size, dtype=bool)
            for k in keys:
                change[1:] |= now[k][1:] != now[k][:-1]
            cuts = np.flatnonzero(change)
            out = []
            for a, b in zip(np.concatenate(([0], cuts[:-1])) if len(cuts) else [], cuts, strict=True):
                made = fn({c: v[a:b] for c, v in now.items()})
                if made is not None and len(made):
                    out.append(made)
            rest = {c: v[cuts[-1] if len(cuts) else 0 :] for c, v in now.items()}
            if out:
                yield pd.concat(out, ignore_index=True)
        if rest is not None:
            made = fn(rest)
            if made is not None and len(made):
                yield made

    return dealt.sortWithinPartitions(*keys, *(order or [])).mapInPandas(walk, schema)


# ---------------------------------------------------------------- joins that one hot key does not stop

#: Parts into which all rows of a join are dealt at least, if one key holds most of them.
PIECES = 1024


def join_to_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, *, sizes: DataFrame | None = None, by: list[str] | None = None) -> DataFrame:
    """``rows`` with the columns of their group (one row for each ``key``, with the number of its rows in ``size``), by an inner join.

    A group with over 1/PIECES of all rows is dealt into pieces of about that size: its row is repeated for each of
    them, and its rows pick one by a hash of the columns ``by`` (all). There are fewer than PIECES such groups whatever the input, so the list of
    them is broadcast. ``rows`` and ``groups`` must share no other column names. ``sizes`` is a stored table with
    the keys and sizes of all groups, ``groups`` itself if not given.
    """
    sizes = groups if sizes is None else sizes
    total = sizes.agg(F.sum(size)).first()[0] or 0
    piece = max(1, -(-total // PIECES))
    pieces = F.ceil(F.col(size) / piece).cast("int")
    hot = F.broadcast(sizes.where(F.col(size) > piece).select(F.col(key).alias("_hot"), pieces.alias("_pieces")))
    own = F.coalesce(F.pmod(F.xxhash64(*(by or rows.columns)), F.col("_pieces")).cast("int"), F.lit(0))
    dealt = rows.join(hot, rows[key] == hot["_hot"], "left").withColumn("_piece", own).drop("_hot", "_pieces")
    repeated = groups.withColumn("_piece", F.explode(F.when(F.col(size) > piece, F.sequence(F.lit(0), pieces - 1)).otherwise(F.array(F.lit(0)))))
    return dealt.join(repeated, [key, "_piece"]).drop("_piece")


# ---------------------------------------------------------------- counting Bloom filter

HASHES = 3
#: Bits in a segment, which all slots of a hash lie in, and segments in a stored file.
SEGMENT_BITS = 1 << 18
FILE_SEGMENTS = 128


class Bloom:
    """Bits of a Bloom filter, and a Column that says if a hash may be in it.

    ``shared`` holds the bits themselves where they are few, else the names of the files that hold them, which workers
    map into memory: what is broadcast is bounded, while the filter grows with the rows.
    """

    def __init__(self, spark: SparkSession, segments: int, bits: np.ndarray | None, files: dict[int, str]):
        self.shared, self.segments = spark.sparkContext.broadcast((bits, files)), segments

    def prober(self) -> Callable[[np.ndarray], np.ndarray]:
        """A function from hashes to whether they may be held, for use inside tasks."""
        shared, segments = self.shared, self.segments

        def probe(h: np.ndarray) -> np.ndarray:
            bits, files = shared.value
            segment, at = segment_of(h, segments), slots(h)
            if bits is not None:
                return _all_set(bits, segment * (SEGMENT_BITS // 8), at)
            found, file = np.zeros(len(h), dtype=bool), segment // FILE_SEGMENTS
            for f in np.unique(file):
                if f in files:
                    own = np.flatnonzero(file == f)
                    found[own] = _all_set(open_array(files[f]), segment[own] % FILE_SEGMENTS * (SEGMENT_BITS // 8), [x[own] for x in at])
            return found

        return probe

    def may_hold(self, hashed: Column) -> Column:
        probe = self.prober()

        @F.pandas_udf(T.BooleanType())
        def held(h: pd.Series) -> pd.Series:
            return pd.Series(probe(h.to_numpy().view(np.uint64)))

        return held(hashed)


def _all_set(bits: np.ndarray, base: np.ndarray, at: list[np.ndarray]) -> np.ndarray:
    found = np.ones(len(base), dtype=bool)
    for x in at:
        found &= (bits[base + (x >> 3)] >> (x & 7).astype(np.uint8)) & 1 == 1
    return found


def segment_of(h: np.ndarray, segments: int) -> np.ndarray:
    """The segment of a hash, by its upper half."""
    return ((h >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)).astype(np.int64)


def slots(h: np.ndarray) -> list[np.ndarray]:
    """The slots of a hash in its segment, by a second hash of it."""
    own = mix64(h ^ np.uint64(0xD6E8FEB86659FD93))
    bits = np.uint64(SEGMENT_BITS.bit_length() - 1)
    return [((own >> (np.uint64(i) * bits)) & np.uint64(SEGMENT_BITS - 1)).astype(np.int64) for i in range(HASHES)]


def bloom(hashed: DataFrame, *, at_least: int = 1, broadcast_bits: int = 1 << 28, bits_per_row: int = 16) -> Bloom:
    """The filter of a DataFrame with one long column of hashes (no nulls).

    With ``at_least=2`` it holds what may occur twice: each slot has a counter that stops at two, and only slots that
    reached it stay. The filter has ``bits_per_row`` bits a row at any size, so the share of false positives does not
    grow with the rows. Up to ``broadcast_bits`` (32 MB by default) the driver gets it and broadcasts it; a larger one
    stays in files of the shared folder.
    """
    spark, name = hashed.sparkSession, hashed.columns[0]
    segments = max(1, -(-bits_per_row * hashed.count() // SEGMENT_BITS))
    stored = segments * SEGMENT_BITS > broadcast_bits
    folder = f"{scratch_dir(spark)}/bloom" if stored else ""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts: list[np.ndarray] = []
        pending = 0
        for frame in frames:
            h = frame[name].to_numpy().view(np.uint64)
            base = segment_of(h, segments) * SEGMENT_BITS
            parts += [base + at for at in slots(h)]
            pending += len(frame)
            if pending > 1 << 20:
                yield summed(parts)
                parts, pending = [], 0
        if pending:
            yield summed(parts)

    def summed(parts: list[np.ndarray]) -> pd.DataFrame:
        at, n = np.unique(np.concatenate(parts), return_counts=True)
        segment = at // SEGMENT_BITS
        cuts = np.flatnonzero(np.diff(segment)) + 1
        within = (at % SEGMENT_BITS).astype(np.uint32) << np.uint32(1) | (n > 1)
        own = segment[np.concatenate(([0], cuts))]
        return pd.DataFrame({"segment": own, "packed": [x.astype("<u4").tobytes() for x in np.split(within, cuts)]})

    def merged(group: dict[str, np.ndarray]) -> np.ndarray:
        n = np.zeros(SEGMENT_BITS, dtype=np.uint8)
        for packed in group["packed"]:
            x = np.frombuffer(packed, dtype="<u4")
            at = x >> np.uint32(1)
            n[at] = np.minimum(n[at] + 1 + (x & 1).astype(np.uint8), 2)
        return np.packbits(n >= at_least, bitorder="little")

    def one(group: dict[str, np.ndarray]) -> pd.DataFrame:
        return pd.DataFrame({"segment": group["segment"][:1], "bits": [merged(group).tobytes()]})

    def together(group: dict[str, np.ndarray]) -> pd.DataFrame:
        whole = np.zeros(FILE_SEGMENTS * SEGMENT_BITS // 8, dtype=np.uint8)
        for segment, bits in zip(group["segment"], group["bits"], strict=True):
            at = segment % FILE_SEGMENTS * (SEGMENT_BITS // 8)
            whole[at : at + SEGMENT_BITS // 8] = np.frombuffer(bits, dtype=np.uint8)
        file = int(group["segment"][0]) // FILE_SEGMENTS
        return pd.DataFrame([(file, write_array(folder, f"bits-{file}", whole))], columns=["file", "uri"])

    counted = hashed.mapInPandas(count, "segment long, packed binary")
    made = map_sorted_groups(counted, ["segment"], one, "segment long, bits binary")
    if stored:
        filed = map_sorted_groups(made.withColumn("file", F.expr(f"segment div {FILE_SEGMENTS}")), ["file"], together, "file long, uri string")
        return Bloom(spark, segments, None, {r["file"]: r["uri"] for r in filed.collect()})
    bits = np.zeros(segments * SEGMENT_BITS // 8, dtype=np.uint8)
    for row in made.collect():
        bits[row.segment * SEGMENT_BITS // 8 : (row.segment + 1) * SEGMENT_BITS // 8] = np.frombuffer(row.bits, dtype=np.uint8)
    return Bloom(spark, segments, bits, {})
