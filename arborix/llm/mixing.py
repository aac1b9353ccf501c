"""Mixing sources to target weights: blocks of words, multinomial draws a shard, pseudorandom index permutations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arborix.llm.common import IS_WORD, batches, materialize, mix64, small_batches
from arborix.llm.ranking import running

#: Weights of the sources in order of their names, repeating; the mix has SHARE times all words; no source more than CAP times its own.
WEIGHTS, SHARE, CAP = (5, 2, 1), 1.5, 2.0
#: Words in a block; what is left of a source is its last, shorter block.
BLOCK = 64
#: Slots of an output shard.
SHARD = 4096
ROUNDS = 24


@F.pandas_udf(T.LongType())
def word_count(text: pd.Series) -> pd.Series:
    """Number of maximal runs without ASCII white space; null: 0."""
    out = np.zeros(len(text), dtype=np.int64)
    for begun, run in batches(text.tolist()):
        word = IS_WORD[np.frombuffer(b"\n" + b"\n".join(run) + b"\n", dtype=np.uint8)]
        starts = np.concatenate(([0], np.cumsum(word[1:] & ~word[:-1])))
        at = np.concatenate(([0], np.cumsum([len(b) + 1 for b in run])))
        out[begun : begun + len(run)] = np.diff(starts[at])
    return pd.Series(out)


def targets(sizes: list[float], *, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> list[float]:
    """Each source's words in the mix: ``share`` of all by weight, at most ``cap`` times its size, the excess reshared by weight."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    total, fixed = share * sum(sizes), [False] * len(sizes)
    while True:
        free = sum(x for x, f in zip(w, fixed, strict=True) if not f)
        rest = total - sum(cap * s for s, f in zip(sizes, fixed, strict=True) if f)
        out = [cap * s if f else (rest * x / free if free else 0.0) for s, x, f in zip(sizes, w, fixed, strict=True)]
        over = [not f and o > cap * s for s, o, f in zip(sizes, out, fixed, strict=True)]
        if not any(over):
            return out
        fixed = [f or o for f, o in zip(fixed, over, strict=True)]


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A keyed permutation of range(size) for each element, by swap-or-not rounds: each swaps an index with its mirror or not."""
    x = index.astype(np.int64)
    for r in range(ROUNDS):
        turn = mix64(key + np.uint64(2 * r + 1))
        mirror = ((turn >> np.uint64(1)).astype(np.int64) - x) % size
        high = np.maximum(x, mirror).astype(np.uint64)
        swap = mix64(high * np.uint64(0x9E3779B97F4A7C15) + turn) >> np.uint64(63) == 1
        x = np.where(swap, mirror, x)
    return x


class Catalogue:
    """The sources in order of code points, null last: sizes, targets, full blocks, words of the last block, and slots.

    A source gives round(target) words: whole epochs over all its blocks, then single blocks, then the first words of
    one more (``part`` of them, 0 if none).
    """

    def __init__(self, found: list[tuple[str | None, int]], weights: tuple[float, ...], share: float, cap: float):
        found = sorted(found, key=lambda x: (x[0] is None, x[0] or ""))
        self.names = [x for x, _ in found]
        self.size = np.array([n for _, n in found], dtype=np.int64)
        self.target = np.array(targets([int(n) for n in self.size], weights=weights, share=share, cap=cap), dtype=float)
        self.full, self.tail = self.size // BLOCK, self.size % BLOCK
        self.blocks = self.full + (self.tail > 0)
        words = np.minimum(np.round(self.target), np.floor(cap * self.size)).astype(np.int64)
        epochs, rest = np.divmod(words, np.maximum(self.size, 1))
        single = np.minimum(rest // BLOCK, self.full)
        self.part = rest - single * BLOCK
        self.slots = epochs * self.blocks + single + (self.part > 0)


def placed(docs: DataFrame, *, weights: tuple[float, ...], share: float, cap: float, limit: int, text: bool) -> tuple[DataFrame | None, DataFrame, Catalogue]:
    """Rows with _row, _src, _size and where their words begin in their source's stream; with ``text``, also the documents by _row, as structs."""
    small_batches(docs.sparkSession)
    names = docs.columns if text else ["doc_id", "source"]
    tie = F.xxhash64("doc_id", "source", "text").alias("_tie")  # orders rows by what they hold, so reruns agree however files are split
    rows = materialize(docs.select(F.monotonically_increasing_id().alias("_row"), tie, word_count("text").alias("_size"), F.struct(*[docs[c] for c in names]).alias("_doc")))
    sums = rows.groupBy(F.col("_doc.source").alias("source")).agg(F.sum("_size").alias("n")).limit(limit + 1).collect()
    if len(sums) > limit:
        raise ValueError(f"more than {limit} sources, for which the driver plans")
    catalogue = Catalogue([(r["source"], r["n"]) for r in sums], weights, share, cap)
    spark = docs.sparkSession
    table = spark.createDataFrame(
        [(i, n, int(catalogue.size[i]), float(catalogue.target[i])) for i, n in enumerate(catalogue.names)], "_src int, _name string, _source_size long, _target double"
    )
    slim = rows.select("_row", "_tie", F.col("_doc.doc_id").alias("doc_id"), F.col("_doc.source").alias("source"), "_size")
    keyed = slim.join(F.broadcast(table), slim["source"].eqNullSafe(table["_name"])).drop("_name")  # at most ``limit`` sources
    spots = materialize(running(keyed, "_src", F.col("_size"), ["doc_id", "_tie", "_row"], F.xxhash64("doc_id", "_tie"), count=rows.count(), name="_before"))
    return (rows if text else None), spots, catalogue


def drawn_slots(spark: SparkSession, catalogue: Catalogue, seed: int) -> DataFrame:
    """(shard, src, epoch, block, words) of every slot of the mix: which block, and how many of its words from the first on.

    Each shard draws how many slots each source gets, independently of the others. A source's draws are then numbered
    over all shards; where the draws of a source exceed its slots, the excess goes to sources that drew too few, by
    number, so every source gets its slots exactly. In epoch q div blocks slot q shows block permutation(q mod blocks);
    the permutation is one of the full blocks, and the shorter last block follows them.
    """
    total = int(catalogue.slots.sum())
    share = catalogue.slots / max(total, 1)
    shards = -(-total // SHARD)

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for shard in frame["id"].tolist():
                n = np.random.default_rng([seed, shard]).multinomial(min(SHARD, total - shard * SHARD), share)
                at = np.flatnonzero(n)
                out.append(pd.DataFrame({"shard": shard, "src": at.astype(np.int32), "n": n[at]}))
            if out:
                yield pd.concat(out)

    parts = max(1, min(shards, int(spark.conf.get("spark.sql.shuffle.partitions", "200"))))
    counts = spark.range(0, shards, 1, parts).mapInPandas(draw, "shard long, src int, n long")
    numbered = running(counts, "src", F.col("n"), ["shard"], F.xxhash64("shard"), count=shards * min(SHARD, len(share)), name="first")
    drawn = np.zeros(len(catalogue.slots), dtype=np.int64)
    for row in counts.groupBy("src").agg(F.sum("n").alias("n")).collect():
        drawn[row["src"]] = row["n"]
    over, under = np.maximum(drawn - catalogue.slots, 0), np.maximum(catalogue.slots - drawn, 0)
    over_first, under_end = np.cumsum(over) - over, np.cumsum(under)

    def spread(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for begin in range(0, len(frame), 1000):
                part = frame.iloc[begin : begin + 1000]
                n = part["n"].to_numpy()
                src = np.repeat(part["src"].to_numpy().astype(np.int64), n)
                q = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(part["first"].to_numpy(), n)
                extra = q >= catalogue.slots[src]
                number = over_first[src[extra]] + q[extra] - catalogue.slots[src[extra]]
                to = np.searchsorted(under_end, number, side="right")
                src[extra], q[extra] = to, drawn[to] + number - (under_end[to] - under[to])
                last = (q == catalogue.slots[src] - 1) & (catalogue.part[src] > 0)
                epoch, at = np.divmod(q, catalogue.blocks[src])
                full = catalogue.full[src]
                inner = at < full
                with np.errstate(over="ignore"):
                    key = mix64(np.uint64(seed) * np.uint64(0xD1342543DE82EF95) + src.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + epoch.astype(np.uint64))
                    block = at.copy()
                    block[inner] = permuted(at[inner], full[inner], key[inner])
                words = np.where(last, catalogue.part[src], np.where(inner, BLOCK, catalogue.tail[src]))
                yield pd.DataFrame({"shard": np.repeat(part["shard"].to_numpy(), n), "src": src.astype(np.int32), "epoch": epoch.astype(np.int32), "block": block, "words": words.astype(np.int32)})

    return numbered.select("shard", "src", "n", "first").mapInPandas(spread, "shard long, src int, epoch int, block long, words int")


def block_overlaps(spots: DataFrame) -> DataFrame:
    """(_row, _size, src, block, at): documents with the blocks that hold words of theirs; the block begins at the document's word ``at`` (before it: negative)."""
    some = spots.where("_size > 0").withColumn("block", F.explode(F.sequence(F.expr(f"_before div {BLOCK}"), F.expr(f"(_before + _size - 1) div {BLOCK}"))))
    return some.select("_row", "_size", F.col("_src").alias("src"), "block", (F.col("block") * BLOCK - F.col("_before")).alias("at"))


#: The document's words from _FROM up to _TO are those that a slot takes of it; none if _TO is not the larger.
_FROM, _TO = "greatest(0L, at)", "least(_size, at + words)"


def mixed(
    docs: DataFrame, *, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = 11, limit: int = 100_000
) -> DataFrame:
    """Per row: doc_id, size, source_size, target, taken.

    ``size`` counts words (null text: 0), ``target`` is what the row's source should give and ``taken`` how many of the
    row's words the mix takes, repeats counted. A source gives its target, rounded to a whole word, and each of its words
    at most ceil(``cap``) times. Reruns agree. Rows with null or repeated doc_ids count on their own; a null source is a
    source; sources without words have target 0. Extra columns play no part; an empty table gives an empty result.
    The driver holds some numbers for each source, ``limit`` of them at most (more raise an error).
    """
    _, spots, catalogue = placed(docs, weights=weights, share=share, cap=cap, limit=limit, text=False)
    times = drawn_slots(docs.sparkSession, catalogue, seed).groupBy("src", "block", "words").agg(F.count(F.lit(1)).alias("times"))
    taken = block_overlaps(spots).join(times, ["src", "block"]).where(f"{_TO} > {_FROM}").groupBy("_row").agg(F.expr(f"sum(({_TO} - {_FROM}) * times) AS taken"))
    return spots.join(taken, "_row", "left").select(
        "doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), F.coalesce("taken", F.lit(0)).cast("long").alias("taken")
    )


@F.pandas_udf(T.StringType())
def _words_between(text: pd.Series, runs: pd.Series) -> pd.Series:
    """The text's words in the given runs [a, b), each run as it stands in the text, runs joined by line feeds."""
    out = []
    for t, spots in zip(text, runs, strict=True):
        raw = t.encode("utf-8", "surrogatepass")
        word = IS_WORD[np.frombuffer(b"\n" + raw + b"\n", dtype=np.uint8)]
        edges = np.flatnonzero(word[1:] != word[:-1])
        starts, ends = edges[::2], edges[1::2]
        joined: list[list[int]] = []
        for a, b in sorted((x["a"], x["b"]) for x in spots):
            if joined and joined[-1][1] == a:
                joined[-1][1] = b
            else:
                joined.append([a, b])
        whole = len(joined) == 1 and joined[0] == [0, len(starts)]
        out.append(t if whole else b"\n".join(raw[starts[a] : ends[b - 1]] for a, b in joined).decode("utf-8", "surrogatepass"))
    return pd.Series(out, dtype=object)


def mixed_documents(
    docs: DataFrame, *, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = 11, limit: int = 100_000
) -> DataFrame:
    """The mix itself, as rows with the columns of ``docs``: one for each document and epoch that the mix takes words from.

    ``text`` holds the taken words in their order (the whole text unchanged if all are taken); ``n_chars``, if there,
    its length. A document that is taken twice gives two rows. Rows without words cannot be taken. All columns of
    ``docs`` are kept, whatever their names; ties, nulls and repeats count as in :func:`mixed`.
    """
    rows, spots, catalogue = placed(docs, weights=weights, share=share, cap=cap, limit=limit, text=True)
    slots = drawn_slots(docs.sparkSession, catalogue, seed)
    met = block_overlaps(spots).join(slots, ["src", "block"]).where(f"{_TO} > {_FROM}")
    runs = met.groupBy("_row", "epoch").agg(F.collect_list(F.struct(F.expr(_FROM).alias("a"), F.expr(_TO).alias("b"))).alias("_runs"))
    taken = rows.select("_row", "_doc").join(runs.select("_row", "_runs"), "_row").withColumn("_taken", _words_between("_doc.text", "_runs"))
    made = {"text": F.col("_taken")}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.length("_taken").cast(docs.schema["n_chars"].dataType)
    return taken.select(*[made.get(c, F.col("_doc").getField(c)).alias(c) for c in docs.columns])


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents: doc_id, size, source_size, target, taken."""
    return mixed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
