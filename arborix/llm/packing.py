"""Packing documents into fixed windows by non-negative least squares over the histogram of lengths."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborix.llm.common import materialize, small_batches
from arborix.llm.ranking import running

WINDOW = 1024
TOKENIZER = "byte_bpe_50k"
_encoders: dict[str, object] = {}


def encoder(name: str):
    """The public byte-level BPE ``name`` with the added tokens of its file, one for each worker process.

    The rank file of the same vocabulary gives the ids of ``name``.json several times faster, and added tokens part a
    text as they do there: ``<|endoftext|>`` in a text is one id. Tests hold the ids equal to those of the JSON file.
    """
    if name not in _encoders:
        import base64
        import json

        import public_tokenizers as public
        import tiktoken

        with open(public.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        with open(public.path(f"{name}.json"), encoding="utf-8") as f:
            added = json.load(f).get("added_tokens") or []
        if any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError(f"{name} has added tokens that take white space with them")
        _encoders[name] = tiktoken.Encoding(name, pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={t["content"]: t["id"] for t in added})
    return _encoders[name]


def token_ids(text: str | None, name: str, end: int = 0) -> np.ndarray:
    """The ids of a text (null: none) and then ``end``, as little-endian unsigned 32-bit integers."""
    if not isinstance(text, str) or not text:
        return np.array([end], dtype="<u4")
    text = text.encode("utf-8", "replace").decode("utf-8")
    return np.concatenate([encoder(name).encode_to_numpy(text, allowed_special="all").astype("<u4"), np.array([end], dtype="<u4")])


def pieces(docs: DataFrame, *, window: int = WINDOW, tokenizer: str = TOKENIZER) -> DataFrame:
    """Each document cut into full windows and what remains: row_key, doc_id, start, length, doc_tokens, crc, ids.

    ``ids`` holds the remainder's ids (little-endian, 32 bits each); full windows are never cut again and carry none.
    """

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows: list[tuple] = []
            for key, doc_id, text in zip(frame["row_key"], frame["doc_id"], frame["text"], strict=True):
                ids = token_ids(text, tokenizer)
                n = len(ids)
                for start in range(0, n, window):
                    part = ids[start : start + window]
                    whole = len(part) == window
                    rows.append((key, doc_id, start, len(part), n, zlib.crc32(part.tobytes()), None if whole else part.tobytes()))
                if len(rows) > 4096:
                    yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})

    names = ["row_key", "doc_id", "start", "length", "doc_tokens", "crc", "ids"]
    rows = docs.select(F.monotonically_increasing_id().alias("row_key"), "doc_id", "text")
    return rows.mapInPandas(cut, "row_key long, doc_id long, start long, length int, doc_tokens long, crc long, ids binary")


def combinations(window: int, lengths: np.ndarray, depth: int = 3) -> np.ndarray:
    """All non-increasing combinations of up to ``depth`` of ``lengths`` that fill the window exactly; rows padded with 0."""
    have = np.zeros(window + 1, dtype=bool)
    have[lengths] = True
    made = [np.array([[window, 0, 0]])] if have[window] else []
    a = lengths[lengths < window]
    b = window - a
    made.append(np.stack([a, b, np.zeros_like(a)], axis=1)[have[b] & (b <= a)])
    if depth >= 3:
        x, y = np.meshgrid(a, a, indexing="ij")
        z = window - x - y
        ok = (z > 0) & (y <= x) & (z <= y)
        ok &= have[np.where(z > 0, z, 0)]
        made.append(np.stack([x[ok], y[ok], z[ok]], axis=1))
    return np.concatenate(made).astype(np.int64)


def repeat_counts(histogram: np.ndarray, strategies: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative least squares for A x = histogram, where column j of A counts the lengths in strategy j, then rounding.

    Accelerated projected gradient steps; A has three entries a column at most, so it is applied by gathers and bincount.
    The rounded counts never use more of a length than there is.
    """
    window = len(histogram) - 1
    if not len(strategies):
        return np.empty(0, np.int64)
    weight = (strategies > 0).astype(float)
    target = histogram.astype(float)
    target[0] = 0

    def apply(x: np.ndarray) -> np.ndarray:
        return np.bincount(strategies.ravel(), weights=(weight * x[:, None]).ravel(), minlength=window + 1)

    def adjoint(r: np.ndarray) -> np.ndarray:
        return (r[strategies] * weight).sum(axis=1)

    v = np.ones(len(strategies))
    for _ in range(12):  # the largest eigenvalue of A'A
        v = adjoint(apply(v))
        bound = np.linalg.norm(v)
        v /= bound
    x, y, t = np.zeros(len(strategies)), np.zeros(len(strategies)), 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - adjoint(apply(y) - target) / bound)
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = new + (t - 1) / t_new * (new - x), new, t_new
    left, counts = histogram.astype(np.int64).copy(), np.zeros(len(strategies), np.int64)
    for wanted in (np.floor(x), np.full(len(x), np.inf)):  # what the solution says, then whatever still fits whole
        for j in np.argsort(-x, kind="stable"):
            used = np.bincount(strategies[j][strategies[j] > 0], minlength=window + 1)
            at = np.flatnonzero(used)
            most = int((left[at] // used[at]).min())
            n = int(min(wanted[j], most))
            if n > 0:
                counts[j] += n
                left[at] -= n * used[at]
    return counts


class Plan:
    """Where the piece with a given rank among those of its length goes."""

    def __init__(self, histogram: np.ndarray, window: int):
        self.window = window
        strategies = combinations(window, np.flatnonzero(histogram))
        counts = repeat_counts(histogram, strategies)
        strategies, counts = strategies[counts > 0], counts[counts > 0]
        firsts = np.cumsum(counts) - counts
        self.packed = int(counts.sum())
        used = np.zeros(window + 1, dtype=np.int64)
        runs: list[tuple[int, int, int, int]] = []  # length, first rank, first sequence, offset
        for lengths, n, first in zip(strategies.tolist(), counts.tolist(), firsts.tolist(), strict=True):
            at = 0
            for length in lengths:
                if length:
                    runs.append((length, int(used[length]), first, at))
                    used[length] += n
                    at += length
        runs.sort()
        self.runs = np.array(runs, dtype=np.int64).reshape(-1, 4)
        self.used = used
        left = histogram - used
        left[0] = 0
        amount = left * np.arange(window + 1)
        self.base = np.concatenate((np.cumsum(amount[::-1])[::-1][1:], [0]))  # longer pieces come first
        total = int(amount.sum())
        self.tail = total - total % window  # what follows is cut into powers of two, which need no padding
        bounds, at = [], self.tail
        while at < total:
            at += 1 << ((total - at).bit_length() - 1)
            bounds.append(at)
        self.tail_ends = np.array(bounds, dtype=np.int64)

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sequence and offset of planned pieces; for the others sequence -1 and the position in the residual stream."""
        planned = rank < self.used[length]
        sequence, offset = np.full(len(length), -1), np.zeros(len(length), np.int64)
        if planned.any():
            big = np.int64(1) << 50
            at = np.searchsorted(self.runs[:, 0] * big + self.runs[:, 1], length[planned] * big + rank[planned], side="right") - 1
            sequence[planned] = self.runs[at, 2] + rank[planned] - self.runs[at, 1]
            offset[planned] = self.runs[at, 3]
        stream = self.base[length] + (rank - self.used[length]) * length
        return sequence, offset, np.where(planned, -1, stream)

    def cuts(self, begin: int, end: int) -> list[tuple[int, int, int, int]]:
        """Parts of a stretch of the residual stream: begin, end, sequence, offset."""
        out = []
        while begin < end:
            if begin < self.tail:
                number, first, stop = begin // self.window, begin // self.window * self.window, (begin // self.window + 1) * self.window
            else:
                k = int(np.searchsorted(self.tail_ends, begin, side="right"))
                number, first, stop = self.tail // self.window + k, int(self.tail_ends[k - 1]) if k else self.tail, int(self.tail_ends[k])
            stop = min(stop, end)
            out.append((begin, stop, self.packed + number, begin - first))
            begin = stop
        return out


def packed(docs: DataFrame, *, window: int = WINDOW, tokenizer: str = TOKENIZER) -> DataFrame:
    """Per piece: doc_id, start, length, doc_tokens, crc, sequence_id, offset.

    A text gives the ids of the tokenizer, then one id 0; a null or empty text gives that id alone. Every id lies in
    exactly one piece. Documents are first cut into full windows and a remainder. On the histogram of lengths (one
    bounded array) the combinations of up to three lengths that fill a window are weighted by non-negative least
    squares and rounded; the pieces that no combination takes are laid end to end, longest first, and cut at window
    ends. Their last stretch of less than a window is cut into powers of two, so nothing is padded at all.
    Rows are told apart by themselves: repeated or null doc_ids are packed like any other. Extra columns play no part;
    an empty table gives an empty result.

    The driver holds the histogram and the plan (bounded by the window); ranks inside a length come from two-level sums.
    """
    small_batches(docs.sparkSession)
    cut = materialize(pieces(docs, window=window, tokenizer=tokenizer))
    histogram = np.zeros(window + 1, dtype=np.int64)
    for row in cut.groupBy("length").count().collect():
        histogram[row["length"]] = row["count"]
    plan = docs.sparkSession.sparkContext.broadcast(Plan(histogram, window))
    ranked = running(cut, "length", F.lit(1), ["row_key", "start"], F.xxhash64("row_key", "start"), count=int(histogram.sum()), name="rank")

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            length, rank = frame["length"].to_numpy().astype(np.int64), frame["rank"].to_numpy()
            sequence, offset, stream = plan.value.place(length, rank)
            whole = frame.assign(sequence_id=sequence, offset=offset)[stream < 0]
            yield whole[names]
            rows = []
            for at, doc_id, start, n, total, crc, ids in zip(stream[stream >= 0].tolist(), *(frame[c][stream >= 0] for c in ("doc_id", "start", "length", "doc_tokens", "crc", "ids")), strict=True):
                parts = plan.value.cuts(at, at + n)
                for a, b, number, place in parts:
                    if len(parts) > 1:
                        crc = zlib.crc32(ids[4 * (a - at) : 4 * (b - at)])
                    rows.append((doc_id, start + a - at, b - a, total, crc, number, place))
            if rows:
                yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})

    names = ["doc_id", "start", "length", "doc_tokens", "crc", "sequence_id", "offset"]
    slim = ranked.select("doc_id", "start", "length", "doc_tokens", "crc", "ids", "rank")
    return slim.mapInPandas(assign, "doc_id long, start long, length long, doc_tokens long, crc long, sequence_id long, offset long")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    found = packed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "start", "length", F.col("crc").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
