"""Language identification by multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborix.llm.common import crc_fold, map_sorted_groups, small_batches

BITS = 16
SIZES = (1, 2, 3)
CELLS = 4096
UNDETERMINED = "und"


@cache
def letters() -> np.ndarray:
    """For each code point, itself if it is a letter, else a space."""
    table = np.full(0x110000, 32, dtype=np.uint32)
    table[[c for c in range(0x110000) if chr(c).isalpha()]] = 0
    at = np.flatnonzero(table == 0)
    table[at] = at
    return table


def grams(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of texts: where the run starts, hashed n-grams of all of them, first n-gram of each text by size, letters in each.

    Texts are lower-cased; everything but letters counts as a space. Two spaces part the texts, so no n-gram holds both.
    """
    run: list[str] = []
    size, begun = 0, 0
    for i, text in enumerate(texts):
        t = text.lower() if isinstance(text, str) else ""
        if run and size + len(t) > 1 << 19:
            yield begun, *_hashed(run)
            run, size, begun = [], 0, i
        run.append(t)
        size += len(t)
    if run:
        yield begun, *_hashed(run)


def _hashed(run: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    joined = "  ".join(["", *run, ""])
    c = letters()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4")]
    at = 2 + np.concatenate(([0], np.cumsum([len(t) + 2 for t in run])))
    counts = np.add.reduceat((c != 32).astype(np.int64), at[:-1])
    hashed = []
    h = np.zeros(len(c), dtype=np.uint32)
    for n in range(1, max(SIZES) + 1):
        h = h[: len(c) - n + 1] * np.uint32(0x01000193) + (c[n - 1 :] + np.uint32(0x9E3779B9 * n & 0xFFFFFFFF))
        if n in SIZES:
            hashed.append(np.pad((h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS), (0, n - 1)))
    return np.stack(hashed), at, counts


def train(labelled: DataFrame, *, max_languages: int = 500) -> tuple[list[str], np.ndarray]:
    """Languages and log-probabilities (n-gram cells x languages) of rows (text, lang), counted over all of them.

    Tasks add up dense counts and hand on one row for each language and stretch of cells. The driver gets cells x
    languages numbers, ``max_languages`` at most (more raise an error).
    """

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for frame in frames:
            lang = frame["lang"].to_numpy()
            for begun, h, at, n in grams(frame["text"].tolist()):
                for i in range(len(n)):
                    if n[i]:
                        part = h[:, at[i] - 1 : at[i + 1] - 2].ravel()
                        total = sums.setdefault(lang[begun + i], np.zeros(1 << BITS, np.int64))
                        if len(part) < 1 << 12:
                            np.add.at(total, part, 1)
                        else:
                            total += np.bincount(part, minlength=1 << BITS)
            if len(sums) > 64:
                yield rows(sums)
                sums = {}
        if sums:
            yield rows(sums)

    def rows(sums: dict[str, np.ndarray]) -> pd.DataFrame:
        return pd.DataFrame([(k, i, v[i * CELLS : (i + 1) * CELLS].tobytes()) for k, v in sums.items() for i in range((1 << BITS) // CELLS)], columns=["lang", "part", "counts"])

    def added(group: dict[str, np.ndarray]) -> pd.DataFrame:
        total = np.zeros(CELLS, np.int64)
        for b in group["counts"]:
            total += np.frombuffer(b, np.int64)
        return pd.DataFrame({"lang": group["lang"][:1], "part": group["part"][:1], "counts": [total.tobytes()]})

    small_batches(labelled.sparkSession)
    docs = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().orderBy("lang").limit(max_languages + 1).collect()}
    if len(docs) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    counted = labelled.select("text", "lang").mapInPandas(count, "lang string, part int, counts binary")
    names = sorted(docs)
    table = np.zeros((1 << BITS, len(names)))
    for row in map_sorted_groups(counted, ["lang", "part"], added, "lang string, part int, counts binary").collect():
        table[row["part"] * CELLS : (row["part"] + 1) * CELLS, names.index(row["lang"])] = np.frombuffer(row["counts"], np.int64)
    table += 0.5
    logs = np.log(table / table.sum(axis=0, keepdims=True)).astype(np.float32)
    return names, logs


def predict(docs: DataFrame, names: list[str], logs: np.ndarray) -> DataFrame:
    """The rows of ``docs`` with lang_pred and score: the likeliest language and its posterior under equal priors.

    Null texts and texts without any letter give ``und`` and 0; so does a model without languages.
    """
    shared = docs.sparkSession.sparkContext.broadcast((names, logs))

    @F.pandas_udf("lang_pred string, score double")
    def judge(text: pd.Series) -> pd.DataFrame:
        names, logs = shared.value
        best, score = np.full(len(text), UNDETERMINED, dtype=object), np.zeros(len(text))
        for begun, h, at, n in grams(text.tolist()) if names else ():
            some = np.flatnonzero(n)
            if not len(some):
                continue
            inner = np.stack([at[some] - 1, at[some + 1] - 2], axis=1).ravel()
            total = np.zeros((len(some), len(names)))
            for k in range(len(h)):
                values = logs[h[k]]
                values[-1] = 0
                total += np.add.reduceat(values, inner, axis=0)[::2]
            total -= total.max(axis=1, keepdims=True)
            p = np.exp(total)
            p /= p.sum(axis=1, keepdims=True)
            at_best = p.argmax(axis=1)
            for i, j in zip(some.tolist(), at_best.tolist(), strict=True):
                best[begun + i] = names[j]
            score[begun + some] = p[np.arange(len(some)), at_best]
        return pd.DataFrame({"lang_pred": best, "score": score})

    return docs.withColumn("_judged", judge("text")).select(*docs.columns, "_judged.lang_pred", "_judged.score")


def language_id(docs: DataFrame, *, folds: int = 3, held_out: int = 1) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score.

    Learns from text and lang of rows with a lang whose crc32(doc_id as text) mod ``folds`` is not ``held_out``. Nothing
    but the text goes into a prediction. Rows repeated give the same values again; extra columns play no part; an empty
    table gives an empty result.
    """
    fold = crc_fold("doc_id", folds) == held_out
    model = train(docs.where("lang is not null").where(~fold).select("text", "lang"))
    return predict(docs.select("doc_id", fold.alias("held_out"), "text"), *model).drop("text")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents: doc_id, held_out, lang_pred, score."""
    return language_id(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def drop_undetermined(docs: DataFrame, *, folds: int = 3, held_out: int = 1, least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose language is determined: not ``und``, and with a posterior of ``least`` or more.

    The model learns as in :func:`language_id`; where no row has a lang, rows with any letter stay.
    """
    fold = crc_fold("doc_id", folds) == held_out
    names, logs = train(docs.where("lang is not null").where(~fold).select("text", "lang"))
    if not names:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    judged = predict(docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col("text")), names, logs)
    return judged.where(F.col("lang_pred") != UNDETERMINED).where(F.col("score") >= least).select("row.*")
