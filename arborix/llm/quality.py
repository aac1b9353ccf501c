"""Text quality by nearest-neighbour voting among labelled latent-semantic vectors."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborix.llm.common import IS_WORD, batches, crc_fold, small_batches
from arborix.llm.labelled import LONGEST, labelled_sample

#: Hashed features, dimensions of the latent vectors, neighbours that vote, and the power of the similarity that weighs a vote.
CELLS, DIMENSIONS, NEIGHBOURS, POWER = 4096, 64, 24, 16.0
#: At most so many labelled documents of each class are kept as neighbours (4000 x 64 numbers are broadcast).
SAMPLE = {1: 2400, 0: 1600}

#: Cells that each share of repeated words fills, so that one number weighs as much as many n-grams.
REPEAT_CELLS = 16

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[48:58], _SHAPE[65:91], _SHAPE[97:123], _SHAPE[128:] = ord("0"), ord("A"), ord("a"), ord("a")


def counts(texts: list[bytes]) -> np.ndarray:
    """Hashed features of each text (texts x CELLS): runs of three bytes, shapes of words, and the shares of words
    that repeat the one, two or three before.

    The shape of a word maps digits, capitals and other letters to one sign each; its last three signs and its length
    class count. Case matters throughout.
    """
    raw = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", dtype=np.uint8)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    doc = np.repeat(np.arange(len(texts)), lengths + 1)
    c = raw.astype(np.uint32)
    tri = (c[:-2] * np.uint32(0x01000193) ^ c[1:-1]) * np.uint32(0x01000193) ^ c[2:]
    tri = (tri * np.uint32(0x9E3779B1)) >> np.uint32(20)
    total = np.bincount(doc[: len(tri)] * CELLS + tri % np.uint32(CELLS // 2), minlength=len(texts) * CELLS).astype(np.float32)
    word = IS_WORD[raw]
    edges = np.flatnonzero(word[1:] != word[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]
    if len(starts):
        shape = _SHAPE[raw].astype(np.uint32)
        size = np.minimum(np.ceil(np.log2(ends - starts + 1)), 7).astype(np.uint32)
        last = np.uint32(7) * size
        for back in (1, 2, 3):
            sign = np.where(ends - back >= starts, shape[np.maximum(ends - back, 0)], np.uint32(0))
            last = (last ^ sign) * np.uint32(0x01000193)
        kind = (last * np.uint32(0x9E3779B1)) >> np.uint32(21)
        owner = doc[starts - 1]
        total += np.bincount(owner * CELLS + CELLS // 2 + kind % np.uint32(CELLS // 2 - 3 * REPEAT_CELLS), minlength=len(texts) * CELLS).astype(np.float32)
        plain = np.concatenate(([0], np.cumsum(c.astype(np.int64) ** 2)))
        each = np.maximum(np.bincount(owner, minlength=len(texts)), 1)
        total = total.reshape(len(texts), CELLS)
        for back in (1, 2, 3):
            same = (ends - starts)[back:] == (ends - starts)[:-back]
            same &= (plain[ends] - plain[starts])[back:] == (plain[ends] - plain[starts])[:-back]
            same &= owner[back:] == owner[:-back]
            repeats = np.bincount(owner[back:][same], minlength=len(texts)) / each
            total[:, CELLS - REPEAT_CELLS * back : CELLS - REPEAT_CELLS * (back - 1)] = (200 * repeats)[:, None]
    return total.reshape(len(texts), CELLS)


@dataclass
class Neighbours:
    """Weights of the features, the projection, and labelled unit vectors with their labels."""

    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float

    def embed(self, texts: list[bytes]) -> np.ndarray:
        x = np.log1p(counts(texts))
        x *= self.idf
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        z = x @ self.axes
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Share of label 1 among the nearest labelled vectors, by exact cosines in one matrix product, each weighted by its similarity.

        Vectors as near as the last neighbour all vote, so ties do not depend on an order.
        """
        out = np.full(len(texts), self.prior)
        full = np.array([i for i, t in enumerate(texts) if t.strip()], dtype=np.int64)
        if not len(full) or not len(self.labels):
            return out
        near = self.embed([texts[i] for i in full]) @ self.vectors.T
        k = min(NEIGHBOURS, near.shape[1])
        least = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k]
        row, at = np.nonzero(near >= least[:, None])
        weight = np.maximum(near[row, at], 1e-6).astype(float) ** POWER
        votes, total = (np.bincount(row, weights=w, minlength=len(full)) for w in (weight * self.labels[at], weight))
        out[full] = np.clip(votes / total, 0, 1)
        return out


def fit(texts: list[bytes], y: np.ndarray, *, seed: int = 3) -> Neighbours:
    """Inverse document frequencies and the leading right singular vectors of the sample, by randomised subspace iteration."""
    prior = float((y.sum() + 0.5) / (len(y) + 1)) if len(y) else 0.5
    if not len(y):
        return Neighbours(np.ones(CELLS, np.float32), np.zeros((CELLS, DIMENSIONS), np.float32), np.zeros((0, DIMENSIONS), np.float32), np.zeros(0), prior)
    x = np.concatenate([np.log1p(counts(run)) for _, run in batches([t.decode("utf-8", "surrogatepass") for t in texts])])
    idf = (np.log((1 + len(y)) / (1 + (x > 0).sum(axis=0))) + 1).astype(np.float32)
    x *= idf
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    basis = np.random.default_rng(seed).normal(size=(CELLS, DIMENSIONS + 16)).astype(np.float32)
    for _ in range(4):
        basis = np.linalg.qr(x.T @ (x @ basis))[0]
    _, _, vt = np.linalg.svd(x @ basis, full_matrices=False)
    model = Neighbours(idf, (basis @ vt.T)[:, :DIMENSIONS].astype(np.float32), np.zeros((0, DIMENSIONS), np.float32), y.astype(np.float32), prior)
    z = x @ model.axes
    model.vectors = (z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)).astype(np.float32)
    return model


def quality(docs: DataFrame, labels: DataFrame, *, sample: dict[int, int] | None = None, longest: int = LONGEST, folds: int = 5, held_out: int = 0) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted.

    The neighbours are a bounded sample of documents with ``labels.quality`` outside the held-out fold (``sample``:
    documents of each class, of ``longest`` characters at most); every document is compared with all of them, in blocks. Only the text enters a score.
    Null and blank texts, and all texts where nothing is labelled, get the share of label 1 in the sample. Repeated
    rows give the same values again; extra columns play no part; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    rows = labelled_sample(docs, labels, "quality", sample or SAMPLE, folds=folds, held_out=held_out, longest=longest)
    model = fit([t.encode("utf-8", "surrogatepass") for t in rows["text"]], rows["y"].to_numpy(dtype=np.int64))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        out = np.empty(len(text))
        for begun, run in batches(text.tolist(), 1 << 19):
            for i in range(0, len(run), 512):
                out[begun + i : begun + i + len(run[i : i + 512])] = shared.value.score(run[i : i + 512])
        return pd.Series(out)

    scored = docs.select("doc_id", (crc_fold("doc_id", folds) == held_out).alias("held_out"), score("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents: doc_id, held_out, score, predicted."""
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
