"""Hard negatives by exact integer scores: matrix products modulo small primes in float32, put together by Chinese remainders."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arborix.llm.common import materialize

#: Components that one float32 product sums up; with residues of at most 125 either way the sum stays below 2^24, so it is exact.
INNER = 1024
#: Odd primes, largest first; as many are used as the scores need.
PRIMES = [p for p in range(251, 2, -2) if all(p % q for q in range(3, int(p**0.5) + 1, 2))]
#: Rows and anchors of a tile, and of the products that a task makes inside it.
TILE_ROWS, TILE_ANCHORS, PART_ROWS, PART_ANCHORS = 32_768, 4096, 8192, 256

# ---------------------------------------------------------------- residue number system


def moduli(bound: int) -> list[int]:
    """Primes whose product is above ``2 * bound``, so that every integer from -bound to bound has residues of its own."""
    product, taken = 1, []
    for p in PRIMES:
        if product > 2 * bound:
            break
        product *= p
        taken.append(p)
    return taken


def residues(matrix: np.ndarray, primes: list[int]) -> list[np.ndarray]:
    """The matrix modulo each prime as float32, between -p/2 and p/2."""
    out = []
    for p in primes:
        r = matrix % p
        out.append(np.where(r > p // 2, r - p, r).astype(np.float32))
    return out


def products(left: list[np.ndarray], right: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """Inner products of all rows of two matrices, given by their residues, as int64.

    The digits in mixed radix are balanced, so they stand for the signed score itself; sums of digits are taken modulo
    2^64, which leaves every score that a long can hold as it is.
    """
    shape = (left[0].shape[0], right[0].shape[0])
    digits: list[np.ndarray] = []
    total, weight = np.zeros(shape, dtype=np.int64), 1
    for k, p in enumerate(primes):
        rest = np.zeros(shape, dtype=np.int64)
        for a in range(0, left[k].shape[1], INNER):
            rest += (left[k][:, a : a + INNER] @ right[k][:, a : a + INNER].T).astype(np.int64) % p
        below = 1
        for q, digit in zip(primes, digits, strict=False):
            rest -= digit * (below % p)
            below *= q
        rest = rest * pow(below, -1, p) % p
        digit = np.where(rest > p // 2, rest - p, rest)
        digits.append(digit)
        total += digit * np.int64((weight + (1 << 63)) % (1 << 64) - (1 << 63))
        weight *= p
    return total


# ---------------------------------------------------------------- selection inside a task


def firsts(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (row, column) of the ``k`` largest allowed scores of each row; of equal ones the leftmost."""
    least = np.iinfo(np.int64).min
    masked = np.where(allowed, scores, least)
    n = masked.shape[1]
    edge = np.partition(masked, n - k, axis=1)[:, n - k] if n > k else np.full(len(masked), least)
    above = masked > edge[:, None]
    level = allowed & (masked == edge[:, None])
    room = k - above.sum(axis=1)
    return np.nonzero(above | level & (np.cumsum(level, axis=1) <= room[:, None]))


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), dtype=np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _least_id_first(rows: pd.DataFrame) -> pd.DataFrame:
    return rows.sort_values(["unnamed", "vec_id", "row"], kind="stable", ignore_index=True)


def _positives(width: int, primes: list[int], k: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def tile(anchors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        rows, out = _least_id_first(rows), []
        left = residues(_matrix(anchors["vector"], width), primes)
        for r in range(0, len(rows), PART_ROWS):
            part = rows.iloc[r : r + PART_ROWS]
            right = residues(_matrix(part["vector"], width), primes)
            for a in range(0, len(anchors), PART_ANCHORS):
                own = anchors.iloc[a : a + PART_ANCHORS]
                scores = products([x[a : a + PART_ANCHORS] for x in left], right, primes)
                allowed = own["label"].to_numpy()[:, None] == part["label"].to_numpy()[None, :]
                allowed &= own["row"].to_numpy()[:, None] != part["row"].to_numpy()[None, :]
                i, j = firsts(scores, allowed, k)
                out.append(pd.DataFrame({"anchor": own["row"].to_numpy()[i], "positive": part["row"].to_numpy()[j], "unnamed": part["unnamed"].to_numpy()[j], "positive_id": part["vec_id"].to_numpy()[j], "positive_score": scores[i, j]}))
        return pd.concat(out, ignore_index=True)

    return tile


def _negatives(width: int, primes: list[int], k: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def tile(anchors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        rows, out = _least_id_first(rows), []
        left = residues(_matrix(anchors["vector"], width), primes)
        limits = [[(int(lo), int(hi)) for lo, hi in zip(x, y, strict=True)] for x, y in zip(anchors["least"], anchors["most"], strict=True)]
        for r in range(0, len(rows), PART_ROWS):
            part = rows.iloc[r : r + PART_ROWS]
            right = residues(_matrix(part["vector"], width), primes)
            for a in range(0, len(anchors), PART_ANCHORS):
                own = anchors.iloc[a : a + PART_ANCHORS]
                scores = products([x[a : a + PART_ANCHORS] for x in left], right, primes)
                other = own["label"].to_numpy()[:, None] != part["label"].to_numpy()[None, :]
                for place in range(max(map(len, limits[a : a + PART_ANCHORS]))):
                    window = np.array([x[place] if place < len(x) else (1, 0) for x in limits[a : a + PART_ANCHORS]], dtype=np.int64)
                    i, j = firsts(scores, other & (scores >= window[:, :1]) & (scores <= window[:, 1:]), k)
                    out.append(pd.DataFrame({"anchor": own["row"].to_numpy()[i], "place": place, "negative": part["row"].to_numpy()[j], "unnamed": part["unnamed"].to_numpy()[j], "negative_id": part["vec_id"].to_numpy()[j], "negative_score": scores[i, j]}))
        return pd.concat(out, ignore_index=True)

    return tile


# ---------------------------------------------------------------- on tables


def integer_vectors(vectors: DataFrame) -> DataFrame:
    """Rows that take part: row (a number), vec_id (0 where it is null, and then unnamed), label (moved on where vec_id is divisible by 7), vector (longs)."""
    x = F.col("embedding")
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    whole = F.transform(x, lambda v: F.floor(v.cast("double") * 256))
    return vectors.where(F.col("label").isNotNull() & x.isNotNull() & ~odd).select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").isNull().alias("unnamed"), F.coalesce(F.col("vec_id").cast("long"), F.lit(0)).alias("vec_id"), label.alias("label"), whole.alias("vector"))


def _tiled(anchors: DataFrame, rows: DataFrame, across: int, down: int, fn: Callable, schema: str) -> DataFrame:
    """``fn`` on each block of anchors with each block of rows; blocks are dealt by row number, so no key makes one large."""
    a = anchors.withColumn("_a", F.pmod(F.xxhash64("row"), F.lit(across))).withColumn("_r", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(down - 1).cast("long"))))
    r = rows.select(*[F.col(c).alias(c) for c in rows.columns]).withColumn("_r", F.pmod(F.xxhash64("row"), F.lit(down))).withColumn("_a", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(across - 1).cast("long"))))
    names = [f.split()[0] for f in schema.split(", ")]

    def tile(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return fn(left, right) if len(left) and len(right) else pd.DataFrame({n: [] for n in names})

    return a.groupBy("_a", "_r").cogroup(r.groupBy("_a", "_r")).applyInPandas(tile, schema)


def _best(found: DataFrame, keys: list[str], order: list[Column | str], k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return found.withColumn("place_of", place).where(F.col("place_of") <= k)


def hard_negatives(vectors: DataFrame, *, anchor_step: int = 50, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95, tile_rows: int = TILE_ROWS, tile_anchors: int = TILE_ANCHORS) -> DataFrame:
    """Per anchor, positive and place: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors (vec_id divisible by ``anchor_step``) meet every row, tile by tile: a tile has about ``tile_anchors`` anchors
    and ``tile_rows`` rows whatever the keys are, and gives the best few of each anchor only, so tasks and what they
    return stay bounded. A positive is one of the first ``positives`` other rows of the anchor's label; its negatives are
    the first ``negatives`` rows of other labels with scores from ``least`` to ``most`` hundredths of its own.

    Rows with null labels or vectors, or with components that are null or not finite, take no part. Rows without vec_id
    can be found (last among ties), but aren't anchors. Repeated rows are rows of their own: each is an anchor, a
    positive and a negative. Vectors of unequal length count as filled up with zeros, so an empty one scores 0. Components
    beyond a long are cut to it; scores are sums of longs (modulo 2^64, as Spark's are without checks). Other columns
    play no part; an empty table, or one without anchors, gives an empty result. No texts are read.
    """
    rows = materialize(integer_vectors(vectors))
    isanchor = ~F.col("unnamed") & (F.col("vec_id") % anchor_step == 0)
    largest = F.greatest(F.coalesce(F.abs(F.array_max("vector").cast("decimal(20,0)")), F.lit(0)), F.coalesce(F.abs(F.array_min("vector").cast("decimal(20,0)")), F.lit(0)))
    total = rows.agg(F.count("*").alias("n"), F.count_if(isanchor).alias("anchors"), F.max(F.size("vector")).alias("width"), F.max(largest).alias("most"), F.max(F.when(isanchor, largest)).alias("own")).first()
    width, bound = max(total["width"] or 0, 1), int(total["own"] or 0) * int(total["most"] or 0) * max(total["width"] or 0, 1)
    primes = moduli(max(bound, 1))
    across, down = max(1, -(-total["anchors"] // tile_anchors)), max(1, -(-total["n"] // tile_rows))

    anchors = rows.where(isanchor)
    found = _tiled(anchors, rows, across, down, _positives(width, primes, positives), "anchor long, positive long, unnamed boolean, positive_id long, positive_score long")
    best = materialize(_best(found, ["anchor"], [F.desc("positive_score"), "unnamed", "positive_id", "positive"], positives))

    score = F.col("positive_score").cast("decimal(38,0)")
    lowest, highest = F.ceil(score * least / 100).cast("long"), F.floor(score * most / 100).cast("long")
    windows = best.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct((F.col("place_of") - 1).alias("place"), lowest.alias("least"), highest.alias("most")))).alias("w"))
    asking = anchors.join(windows, anchors["row"] == windows["anchor"]).select("row", "label", "vector", F.col("w.least").alias("least"), F.col("w.most").alias("most"))
    near = _tiled(asking, rows, across, down, _negatives(width, primes, negatives), "anchor long, place int, negative long, unnamed boolean, negative_id long, negative_score long")
    picked = _best(near, ["anchor", "place"], [F.desc("negative_score"), "unnamed", "negative_id", "negative"], negatives)
    named = best.join(anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor").select("anchor", (F.col("place_of") - 1).alias("place"), "anchor_id", F.when(~F.col("unnamed"), F.col("positive_id")).alias("positive_id"), "positive_score")
    negative = F.when(~F.col("unnamed"), F.col("negative_id")).alias("negative_id")
    return picked.join(named, ["anchor", "place"]).select("anchor_id", "positive_id", F.col("place_of").cast("int").alias("rank"), negative, "positive_score", "negative_score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth vector: anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP11_SQL = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id AS other_id, b.label AS other,
    CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM rows a JOIN rows b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
positives AS (
  SELECT anchor_id, own, other_id AS positive_id, score AS positive_score FROM scored WHERE own = other
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.other_id) AS INTEGER) AS rank,
  n.other_id AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND n.other <> p.own AND 50 * p.positive_score <= 100 * n.score AND 100 * n.score <= 95 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.other_id) <= 3
"""
