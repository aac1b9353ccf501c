"""Language-model scoring: an interpolated modified Kneser-Ney bigram model over hashed words.

Counted in Spark, stored as sorted arrays in the shared folder, memory-mapped by the workers that score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborix.llm.arrays import open_array, write_array
from arborix.llm.common import batches, crc_fold, map_sorted_groups, scratch_dir, small_batches, spans, word_hashes

END = np.uint64(0x5851F42D4C957F2D)
#: Tokens that a task gathers before it sorts and hands on counts.
GATHER = 1 << 22
#: Tokens for each file of the model, and the number of files at least; a file is merged by one task.
FILE_TOKENS, FILES = 1 << 20, 8
#: Bytes of text that a token takes, as the size of the input is known before its tokens are.
TOKEN_BYTES = 6
#: Distinct words in a stretch of ids.
STRETCH = 1 << 15
BATCH = 1 << 21


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts with an end token after each, and where each text starts (one more entry at the end)."""
    buf, starts, ends, first, _ = spans(texts)
    n = np.diff(first)
    at = np.concatenate(([0], np.cumsum(n + 1)))
    out = np.full(at[-1], END, dtype=np.uint64)
    keep = np.ones(at[-1], dtype=bool)
    keep[at[1:] - 1] = False
    out[keep] = word_hashes(buf, starts, ends)
    return out, at


def planes(values: np.ndarray) -> bytes:
    """Sorted integers as differences, one byte plane after the other: most planes are then zeros, which shuffles compress away."""
    gaps = np.diff(values.astype(np.uint64), prepend=np.uint64(0))
    return gaps.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unplaned(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, np.uint8).reshape(8, -1).T.copy().view("<u8").ravel().astype(np.uint64), dtype=np.uint64)


def small(counts: np.ndarray) -> bytes:
    return counts.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unsmall(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def split_rows(part: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> pd.DataFrame:
    """A row for each run of equal ``part``, with packed keys and counts."""
    cuts = np.flatnonzero(np.diff(part)) + 1
    return pd.DataFrame(
        {"part": part[np.concatenate(([0], cuts))].astype(np.int32), "keys": [planes(x) for x in np.split(keys, cuts)], "counts": [small(x) for x in np.split(counts, cuts)]}
    )


def discounts(n: np.ndarray) -> np.ndarray:
    """Discounts of counts 1, 2 and 3 or more, from the numbers of keys with counts 1, 2, 3 and 4."""
    n1, n2, n3, n4 = (float(x) for x in n)
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    raw = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return np.array([0.0, min(max(raw[0], 0.05), 0.95), min(max(raw[1], 0.05), 1.9), min(max(raw[2], 0.05), 2.85)])


@dataclass
class Model:
    """Where the arrays are. Words have ids in the order of their hashes; a pair's key is context * 2^32 + word."""

    words: list[tuple[int, str, str]] = field(default_factory=list)  # first id, hashes, counts
    word_bits: int = 0
    pairs: dict[int, tuple[str, str]] = field(default_factory=dict)
    spread: int = 1
    contexts: dict[int, str] = field(default_factory=dict)
    continuations: dict[int, str] = field(default_factory=dict)
    n_tokens: int = 0
    n_words: int = 0
    n_pairs: int = 0
    pair_discount: np.ndarray = field(default_factory=lambda: discounts(np.zeros(4)))
    word_discount: np.ndarray = field(default_factory=lambda: discounts(np.zeros(4)))
    word_left: float = 1.0

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: not in training) and training counts of sorted distinct hashes."""
        ids, counts = np.full(len(hashes), -1, dtype=np.int64), np.zeros(len(hashes), dtype=np.int64)
        part = (hashes >> np.uint64(64 - self.word_bits)).astype(np.int64) if self.word_bits else np.zeros(len(hashes), np.int64)
        for p in np.unique(part):
            if p >= len(self.words) or not self.words[p][1]:
                continue
            first, uri, counted = self.words[p]
            a, b = np.searchsorted(part, [p, p + 1])
            table = open_array(uri)
            at = np.minimum(np.searchsorted(table, hashes[a:b]), len(table) - 1)
            found = table[at] == hashes[a:b]
            ids[a:b][found] = first + at[found]
            counts[a:b][found] = open_array(counted)[at[found]]
        return ids, counts

    def dense(self, files: dict[int, str], ids: np.ndarray, width: int) -> np.ndarray:
        out = np.zeros((len(ids), width), dtype=np.int64)
        stretch = ids // STRETCH
        for s in np.unique(stretch):
            if s in files:
                own = stretch == s
                out[own] = open_array(files[s])[ids[own] % STRETCH].reshape(-1, width)
        return out

    def pair_counts(self, keys: np.ndarray) -> np.ndarray:
        """Training counts of sorted distinct pair keys."""
        out, part = np.zeros(len(keys), dtype=np.int64), pair_part(keys, self.spread)
        for p in np.unique(part):
            if p in self.pairs:
                own = np.flatnonzero(part == p)
                table, counted = map(open_array, self.pairs[p])
                at = np.minimum(np.searchsorted(table, keys[own]), len(table) - 1)
                found = table[at] == keys[own]
                out[own[found]] = counted[at[found]]
        return out

    def ids_of(self, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        distinct, inverse = np.unique(hashed, return_inverse=True)
        ids, counts = self.look_up(distinct)
        return ids[inverse], counts[inverse]

    def score(self, texts: list[bytes]) -> tuple[np.ndarray, ...]:
        """Per text: tokens, known tokens, base score and model score."""
        hashed, at = tokens(texts)
        words, inverse = np.unique(hashed, return_inverse=True)
        word_ids, word_counts = self.look_up(words)
        known = word_ids >= 0
        spread = np.zeros(len(words), dtype=np.int64)
        spread[known] = self.dense(self.continuations, word_ids[known], 1)[:, 0]
        lower = np.maximum(spread - self.word_discount[np.minimum(spread, 3)], 0) / max(self.n_pairs, 1) + self.word_left / (self.n_words + 1)
        base = np.log10((word_counts + 0.5) / (self.n_tokens + 0.5 * (self.n_words + 1)))
        ids = word_ids[inverse]
        context = np.concatenate(([self.n_words], ids[:-1]))
        context[at[:-1]] = self.n_words  # the id of the start
        own_contexts, context_inverse = np.unique(context, return_inverse=True)
        stats = np.zeros((len(own_contexts), 4), dtype=np.int64)
        there = own_contexts >= 0
        stats[there] = self.dense(self.contexts, own_contexts[there], 4)
        total = stats[:, 0]
        left = np.where(total > 0, stats[:, 1:] @ self.pair_discount[1:] / np.maximum(total, 1), 1.0)
        keys = (np.maximum(context, 0).astype(np.uint64) << np.uint64(32)) | np.maximum(ids, 0).astype(np.uint64)
        usable = (context >= 0) & (ids >= 0)
        distinct, pair_inverse = np.unique(keys[usable], return_inverse=True)
        count = np.zeros(len(keys), dtype=np.int64)
        count[usable] = self.pair_counts(distinct)[pair_inverse]
        seen = np.maximum(count - self.pair_discount[np.minimum(count, 3)], 0) / np.maximum(total[context_inverse], 1)
        logs = np.log10(seen + left[context_inverse] * lower[inverse])
        return np.diff(at), np.add.reduceat(known[inverse].astype(np.int64), at[:-1]), np.add.reduceat(base[inverse], at[:-1]), np.add.reduceat(logs, at[:-1])


def pair_part(keys: np.ndarray, spread: int) -> np.ndarray:
    """Which file holds a pair: by a mix of both words, so frequent contexts are dealt over all files."""
    return (((keys ^ (keys >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(33)) % np.uint64(spread)).astype(np.int64)


def train(texts: DataFrame, *, files: int | None = None) -> Model:
    """Counts every text of ``texts`` (column text; null: empty) and writes the model's arrays into the shared folder.

    First words, then pairs of word ids: tasks sort and count what they have read and hand on packed sorted arrays.
    Each file is merged by one task. A pass over the lengths of all texts says how many files there are, about one for
    FILE_TOKENS tokens, so what a task merges stays level however large the input is. What contexts and continuations add up to goes through a second such merge by stretches of ids.
    """
    spark = texts.sparkSession
    folder = scratch_dir(spark)
    files = files or max(FILES, (texts.agg(F.sum(F.octet_length("text") + TOKEN_BYTES)).first()[0] or 0) // (TOKEN_BYTES * FILE_TOKENS))
    bits = max(1, int(np.ceil(np.log2(files))))
    packed = "part int, keys binary, counts binary"

    def count_words(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from gathered(frames, lambda run: tokens(run)[0], lambda keys: (keys >> np.uint64(64 - bits)).astype(np.int64))

    def gathered(frames, keys_of, part_of) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []
        size = 0
        for frame in frames:
            for _, run in batches(frame["text"].tolist(), BATCH):
                held.append(keys_of(run))
                size += len(held[-1])
                if size >= GATHER:
                    yield counted(held, part_of)
                    held, size = [], 0
        if size:
            yield counted(held, part_of)

    def counted(held, part_of) -> pd.DataFrame:
        keys, counts = np.unique(np.concatenate(held), return_counts=True)
        part = part_of(keys)
        order = np.argsort(part, kind="stable")
        return split_rows(part[order], keys[order], counts[order])

    def merge(group: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return summed(np.concatenate([unplaned(x) for x in group["keys"]]), np.concatenate([unsmall(x) for x in group["counts"]]))

    def merge_words(group: dict[str, np.ndarray]) -> pd.DataFrame:
        keys, counts = merge(group)
        p = int(group["part"][0])
        return pd.DataFrame([(p, write_array(folder, f"words-{p}", keys), write_array(folder, f"counts-{p}", counts), len(keys), int(counts.sum()))])

    texts = texts.select("text")
    found = map_sorted_groups(texts.mapInPandas(count_words, packed), ["part"], merge_words, "part int, keys string, counts string, n long, tokens long", parts=1 << bits).collect()
    model = Model(word_bits=bits, spread=files, words=[(0, "", "")] * (1 << bits))
    for row in sorted(found, key=lambda r: r["part"]):
        model.words[row["part"]] = (model.n_words, row["keys"], row["counts"])
        model.n_words += row["n"]
        model.n_tokens += row["tokens"]
    if model.n_words >= 1 << 32:
        raise ValueError("more distinct words than ids")
    lookup = spark.sparkContext.broadcast(model)  # names of files only

    def pair_keys(run: list[bytes]) -> np.ndarray:
        hashed, at = tokens(run)
        ids, _ = lookup.value.ids_of(hashed)
        context = np.concatenate(([0], ids[:-1]))
        context[at[:-1]] = lookup.value.n_words
        return (context.astype(np.uint64) << np.uint64(32)) | ids.astype(np.uint64)

    def count_pairs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from gathered(frames, pair_keys, lambda keys: pair_part(keys, files))

    def merge_pairs(group: dict[str, np.ndarray]) -> pd.DataFrame:
        keys, counts = merge(group)
        p = int(group["part"][0])
        names = write_array(folder, f"pairs-{p}", keys), write_array(folder, f"pair-counts-{p}", counts.astype(np.uint32))
        rows = [(0, p, *names, [int((counts == k).sum()) for k in range(1, 5)], len(keys), None, None)]
        context, word = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1])))
        sums = np.stack([np.add.reduceat(x, first) for x in (counts, (counts == 1).astype(np.int64), (counts == 2).astype(np.int64), (counts > 2).astype(np.int64))])
        rows += stretches(1, context[first], sums)
        words, n = np.unique(word, return_counts=True)
        rows += stretches(2, words, n[None, :])
        return pd.DataFrame(rows, columns=["kind", "part", "keys", "counts", "histogram", "n", "ids", "sums"])

    def stretches(kind: int, ids: np.ndarray, sums: np.ndarray) -> list[tuple]:
        cuts = np.flatnonzero(np.diff(ids // STRETCH)) + 1
        return [
            (kind, int(i[0] // STRETCH), None, None, None, len(i), planes(i % STRETCH), b"".join(small(x) for x in s))
            for i, s in zip(np.split(ids, cuts), np.split(sums, cuts, axis=1), strict=True)
        ]

    def add_up(group: dict[str, np.ndarray]) -> pd.DataFrame:
        kind, s = int(group["kind"][0]), int(group["part"][0])
        if kind == 0:
            return pd.DataFrame([(0, int(p), k, c, h.tolist(), int(n)) for p, k, c, h, n in zip(*(group[x] for x in ("part", "keys", "counts", "histogram", "n")), strict=True)])
        width = 4 if kind == 1 else 1
        dense = np.zeros((STRETCH, width), dtype=np.int64)
        for ids, sums in zip(group["ids"], group["sums"], strict=True):
            at = unplaned(ids).astype(np.int64)
            step = 4 * len(at)
            for k in range(width):
                dense[at, k] += unsmall(sums[k * step : (k + 1) * step])
        histogram = [int((dense[:, 0] == k).sum()) for k in range(1, 5)] + ([int(dense[:, 0].sum()), int((dense[:, 0] > 2).sum())] if kind == 2 else [])
        return pd.DataFrame([(kind, s, write_array(folder, f"{'contexts' if kind == 1 else 'continuations'}-{s}", dense), None, histogram, 0)])

    partial = map_sorted_groups(
        texts.mapInPandas(count_pairs, packed), ["part"], merge_pairs, "kind int, part int, keys string, counts string, histogram array<long>, n long, ids binary, sums binary", parts=files
    )
    sizes, spreads = np.zeros(4, dtype=np.int64), np.zeros(6, dtype=np.int64)
    for row in map_sorted_groups(partial, ["kind", "part"], add_up, "kind int, part int, keys string, counts string, histogram array<long>, n long").collect():
        if row["kind"] == 0:
            model.pairs[row["part"]] = (row["keys"], row["counts"])
            model.n_pairs += row["n"]
            sizes += row["histogram"]
        elif row["kind"] == 1:
            model.contexts[row["part"]] = row["keys"]
        else:
            model.continuations[row["part"]] = row["keys"]
            spreads += row["histogram"]
    model.pair_discount, model.word_discount = discounts(sizes), discounts(spreads[:4])
    if model.n_pairs:
        d = model.word_discount
        model.word_left = float((d[1] * spreads[0] + d[2] * spreads[1] + d[3] * spreads[5]) / model.n_pairs)
    return model


def lm_scores(docs: DataFrame, *, folds: int = 5, held_out: int = 1) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Words are maximal runs without ASCII white space, A-Z lower-cased, then one end token; null texts are empty. The
    model learns from all rows whose crc32(doc_id as text) mod ``folds`` is not ``held_out`` (repeated rows count as
    often as they are there). ``score`` is the log10 probability under the bigram model, whose unknown words share the
    mass of one; ``base_score`` that of unigrams with half a count added. Without training rows each token has
    probability 1. Extra columns play no part; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    fold = crc_fold("doc_id", folds) == held_out
    model = train(docs.where(~fold))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("n_tokens long, n_known long, base_score double, score double")
    def score(text: pd.Series) -> pd.DataFrame:
        parts = [np.stack([x.astype(float) for x in shared.value.score(run)]) for _, run in batches(text.tolist(), BATCH)]
        n, known, base, own = np.concatenate(parts, axis=1) if parts else np.zeros((4, 0))
        return pd.DataFrame({"n_tokens": n.astype(np.int64), "n_known": known.astype(np.int64), "base_score": base, "score": own})

    scored = docs.select("doc_id", fold.alias("held_out"), score("text").alias("s"))
    return scored.select("doc_id", "held_out", "s.n_tokens", "s.n_known", F.lit(model.n_tokens).cast("long").alias("train_tokens"), "s.base_score", "s.score")


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model scores of all documents: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    return lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
