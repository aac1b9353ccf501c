"""Toxicity: each word's bag of subword embeddings, averaged into a linear softmax; a text pools its words; all trained jointly in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborix.llm.common import IS_WORD, batches, crc_fold, mix64, small_batches, spans, word_hashes
from arborix.llm.labelled import LONGEST, labelled_sample

BITS, DIMENSIONS = 16, 8
SUBWORDS = (3, 4, 5)
PREFIXES = (4, 5, 6, 7, 8)
#: Factor on a word's average before the softmax.
GAIN = 8.0
#: At most so many labelled documents of each class are fitted on.
SAMPLE = {1: 1500, 0: 2500}
EPOCHS = 8
#: Weight of a toxic document in the loss.
WEIGHT = 3.0
#: Step size, damping of the steps of rare features, and shrinkage of a cell each time it is used.
RATE, DAMPING, DECAY = 0.3, 1e-5, 0.0

_GRAM = mix64(np.arange(7, 7 + max(*SUBWORDS, *PREFIXES) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts: a hash of each word, first word of each text, and the cells of its features with the word of each.

    Features of a word are the word itself, its runs of 3 to 5 bytes with a space before and after it, and its first 4 to 8 bytes.
    """
    buf, starts, ends, first, _ = spans(texts)
    if not len(starts):
        return np.empty(0, np.uint64), first, np.empty(0, np.int64), np.empty(0, np.int64)
    word = IS_WORD[buf]
    buf = np.where(word, buf, np.uint8(32)).astype(np.uint64) + np.uint64(1)
    number = np.cumsum(np.bincount(starts, minlength=len(buf)))[: len(buf)] - 1
    breaks = np.concatenate(([0], np.cumsum(~word)))
    hashes = word_hashes((buf - np.uint64(1)).astype(np.uint8), starts, ends)
    cells, owner = [(hashes >> np.uint64(64 - BITS)).astype(np.int64)], [np.arange(len(starts))]
    lengths = ends - starts
    for n in PREFIXES:
        at = np.flatnonzero(lengths >= n)
        h = np.full(len(at), np.uint64(101 + n))
        for i in range(n):
            h = (h ^ buf[starts[at] + i]) * _GRAM[i]
        h ^= h >> np.uint64(29)
        cells.append(((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BITS)).astype(np.int64))
        owner.append(at)
    for n in SUBWORDS:
        m = len(buf) - n + 1
        if m <= 0:
            continue
        at = np.flatnonzero((breaks[n - 1 : n - 1 + m] == breaks[1 : 1 + m]))  # no separator between the ends
        h = np.full(len(at), np.uint64(n))
        for i in range(n):
            h = (h ^ buf[at + i]) * _GRAM[i]
        h ^= h >> np.uint64(29)
        cells.append(((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BITS)).astype(np.int64))
        owner.append(number[at + 1])
    return hashes, first, np.concatenate(cells), np.concatenate(owner)


def pooled(logit: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each document's logit from those of its words, and the weights that it gives them: e to the logit, and their sums (0 without words).

    The log-sum-exp lets a single toxic word count in a text of any length, and several weak ones together. Training and
    scoring pool alike.
    """
    top = np.full(n_docs, -np.inf)
    np.maximum.at(top, doc, logit)
    power = np.exp(logit - top[doc])
    mass = np.bincount(doc, weights=power, minlength=n_docs)
    has = mass > 0
    return np.where(has, top, 0) + np.log(np.where(has, mass, 1)), power, mass


@dataclass
class Model:
    """What is left of the trained embeddings for scoring: each cell's embedding times the difference of the softmax rows."""

    cell: np.ndarray
    bias: float
    base: float

    def score(self, texts: list[bytes]) -> np.ndarray:
        hashes, first, cells, owner = features(texts)
        out = np.full(len(texts), self.base)
        if not len(hashes):
            return out
        average = np.bincount(owner, weights=self.cell[cells], minlength=len(hashes)) / np.bincount(owner, minlength=len(hashes))
        doc = np.repeat(np.arange(len(texts)), np.diff(first))
        whole, _, mass = pooled(GAIN * average + self.bias, doc, len(texts))
        has = mass > 0
        out[has] = 1 / (1 + np.exp(-np.clip(whole[has], -40, 40)))
        return out


def fit(texts: list[bytes], y: np.ndarray, *, epochs: int = EPOCHS, rate: float = RATE, damping: float = DAMPING, decay: float = DECAY, seed: int = 5) -> Model:
    """Embeddings, softmax weights and bias by Adagrad on the log loss of documents, whose words are pooled as in scoring."""
    rng = np.random.default_rng(seed)
    base = float((y.sum() + 0.5) / (len(y) + 1)) if len(y) else 0.5
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(1 << BITS), float(np.log(base / (1 - base))), base)
    table = rng.normal(0, 0.1, (1 << BITS, DIMENSIONS)).astype(np.float32)
    softmax = rng.normal(0, 1, (2, DIMENSIONS)).astype(np.float32)
    bias, squares_table, squares_soft, square_bias = 0.0, np.full((1 << BITS, DIMENSIONS), damping, np.float32), np.full(DIMENSIONS, 1e-6), 1e-6
    order = np.arange(len(y))
    prepared: dict[int, tuple] = {}
    groups = [g for g in np.array_split(rng.permutation(order), max(1, len(order) // 64))]
    for k, g in enumerate(groups):
        hashes, first, cells, owner = features([texts[i] for i in g])
        unique, inverse = np.unique(hashes, return_inverse=True)
        _, example = np.unique(inverse, return_index=True)
        chosen = np.zeros(len(hashes), dtype=bool)
        chosen[example] = True
        keep = chosen[owner] if len(owner) else np.empty(0, bool)
        word_of, cell_of = inverse[owner[keep]], cells[keep]
        by_word = np.argsort(word_of, kind="stable")
        prepared[k] = (y[g], inverse, word_of[by_word].astype(np.int32), cell_of[by_word].astype(np.int32), np.repeat(np.arange(len(g)), np.diff(first)), len(unique), len(g))
    for epoch in range(epochs):
        pace = rate * (1 - epoch / epochs) + 0.02
        for k in rng.permutation(len(groups)):
            target, inverse, word_of, cell_of, doc, n_words, n_docs = prepared[k]
            if not len(inverse):
                continue
            used, local = np.unique(cell_of, return_inverse=True)
            first_feature = np.searchsorted(word_of, np.arange(n_words))
            n_features = np.diff(np.append(first_feature, len(word_of)))
            rows = table[used]
            words = np.add.reduceat(rows[local], first_feature, axis=0) / n_features[:, None]
            direction = softmax[1] - softmax[0]
            whole, power, mass = pooled((GAIN * words @ direction + bias)[inverse], doc, n_docs)
            has = mass > 0
            error = np.where(has, 1 / (1 + np.exp(-np.clip(whole, -40, 40))) - target, 0) * np.where(target == 1, WEIGHT, 1.0)
            push = (error[doc] * power / mass[doc] / n_docs).astype(np.float32)
            per_word = np.bincount(inverse, weights=push, minlength=n_words) * GAIN
            grad_direction = per_word @ words
            per_cell = np.bincount(local, weights=np.repeat(per_word / n_features, n_features), minlength=len(used))
            grad_rows = per_cell[:, None] * direction[None, :]
            squares_table[used] += grad_rows**2
            table[used] = rows * (1 - decay) - pace * grad_rows / np.sqrt(squares_table[used])
            squares_soft += grad_direction**2
            step = pace * 0.2 * grad_direction / np.sqrt(squares_soft)
            softmax[1] -= step.astype(np.float32)
            softmax[0] += step.astype(np.float32)
            square_bias += push.sum() ** 2
            bias -= float(pace * push.sum() / square_bias**0.5)
    return Model((table @ (softmax[1] - softmax[0])).astype(np.float64), bias, base)


def toxicity(docs: DataFrame, labels: DataFrame, *, sample: dict[int, int] | None = None, longest: int = LONGEST, folds: int = 5, held_out: int = 0) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted.

    Learns ``labels.toxic`` from a bounded sample (``sample``: documents of each class, of ``longest``
    characters at most) outside the held-out fold; only the text enters a score. All words of a text are scored and pooled; null texts and texts without words get
    the share of toxic documents in the sample. Without labels every score is that of no knowledge. Repeated rows give
    the same values again; extra columns play no part; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    rows = labelled_sample(docs, labels, "toxic", sample or SAMPLE, folds=folds, held_out=held_out, longest=longest)
    with np.errstate(over="ignore"):
        model = fit([t.encode("utf-8", "surrogatepass") for t in rows["text"]], rows["y"].to_numpy(dtype=np.int64))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        out = np.empty(len(text))
        with np.errstate(over="ignore"):
            for begun, run in batches(text.tolist(), 1 << 18):
                out[begun : begun + len(run)] = shared.value.score(run)
        return pd.Series(out)

    scored = docs.select("doc_id", (crc_fold("doc_id", folds) == held_out).alias("held_out"), score("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents: doc_id, held_out, score, predicted."""
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
