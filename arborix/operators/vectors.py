"""Nearest vectors, exact or by an index of cells, and the fusion of ranked lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Questions a pass over the rows; these are collected and broadcast.
QUESTIONS = 4096
#: Questions whose scores against a batch are held at once.
WIDTH = 256


def query_vector(vectors: DataFrame, key: str, value: int) -> list[float]:
    """One stored vector, on the driver: the query of a search."""
    row = vectors.where(F.col(key) == value).select("embedding").first()
    return [float(x) for x in row[0]] if row else []


def top(scored: DataFrame, key: str, k: int) -> DataFrame:
    """The k best rows; ties by key. Each task keeps k rows, and those alone are merged."""
    return scored.orderBy(F.desc("score"), key).limit(k)


def nearest(vectors: DataFrame, query: list[float], key: str, k: int) -> DataFrame:
    """The k rows with the highest cosine to ``query``, computed in the JVM as doubles in the order of the array."""
    q = F.array(*[F.lit(x) for x in query])
    zero = F.lit(0.0)
    dot = F.aggregate(F.zip_with("embedding", q, lambda a, b: a.cast("double") * b), zero, lambda s, x: s + x)
    norm = F.sqrt(F.aggregate("embedding", zero, lambda s, x: s + x.cast("double") * x.cast("double")))
    length = sum(x * x for x in query) ** 0.5
    return top(vectors.withColumn("score", F.round(F.try_divide(dot, norm * length), 6)), key, k)


def fused(first: DataFrame, second: DataFrame, *, constant: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of two short ranked lists (id, score)."""
    order = Window.orderBy(F.desc("score"), "id")  # over the k rows of a top list, which are few
    a = first.select("id", F.row_number().over(order).alias("ra"))
    b = second.select("id", F.row_number().over(order).alias("rb"))
    part = lambda r: F.coalesce(1.0 / (constant + F.col(r)), F.lit(0.0))
    return a.join(b, "id", "full").select("id", F.round(part("ra") + part("rb"), 6).alias("score"))


def _unit(vectors: pd.Series | list) -> np.ndarray:
    m = np.array([np.asarray(v, dtype=np.float64) for v in vectors])
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def usable(embedding: Column, dimension: int) -> Column:
    """Whether a vector has that many finite numbers that aren't all zero."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(embedding) == dimension) & finite & F.exists(embedding, lambda x: x != 0), F.lit(False))


def centres(rows: DataFrame, key: str, *, count: int, sample: int = 50_000) -> np.ndarray:
    """Centres of ``count`` cells at most, by Spark's k-means on the directions of ``sample`` rows at most, chosen by a hash of their keys."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    chosen = rows.orderBy(F.xxhash64(key), key).limit(sample).select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    return np.array(KMeans(k=count, seed=1, maxIter=10, distanceMeasure="cosine").fit(chosen).clusterCenters())


def with_cells(rows: DataFrame, centre: np.ndarray) -> DataFrame:
    """``rows`` with the column cell: the number of the centre with the highest cosine. Every row gets one."""
    directions = centre / np.sqrt((centre * centre).sum(axis=1, keepdims=True))

    @F.pandas_udf("int")
    def cell(vectors: pd.Series) -> pd.Series:
        return pd.Series((_unit(vectors) @ directions.T).argmax(axis=1) if len(vectors) else [], dtype="int32")

    return rows.withColumn("cell", cell("embedding"))


def save_index(rows: DataFrame, path: str, key: str, *, files: int) -> None:
    """Rows with cells as Parquet by ranges of (cell, key): a search reads the row groups of its cells, and a large cell spans several files."""
    rows.repartitionByRange(files, "cell", key).sortWithinPartitions("cell", key).write.mode("error").parquet(path)


def nearest_to_each(rows: DataFrame, questions: DataFrame, key: str, *, k: int, dimension: int, centre: np.ndarray | None = None, probes: int = 8) -> DataFrame:
    """(question, id, score, rank): for each question the ``k`` rows with the highest cosines (six digits), equal ones by id.

    ``questions`` has question and embedding; vectors that aren't :func:`usable` take no part on either side. Questions are
    taken in passes of about :data:`QUESTIONS`, broadcast, and multiplied with batches of rows; a task hands on ``k`` rows a
    question at most. With ``centre``, ``rows`` have :func:`with_cells` and each question is compared with the rows of
    its ``probes`` nearest cells only, exactly; other cells aren't read where rows are stored by cell. Without, the
    result is exact.
    """
    spark = rows.sparkSession
    asked = questions.where(usable(F.col("embedding"), dimension)).select("question", "embedding")
    passes = -(-asked.count() // QUESTIONS) or 1
    rows = rows.where(usable(F.col("embedding"), dimension)).select(F.col(key).alias("id"), "embedding", *(["cell"] if centre is not None else []))
    types = f"question {asked.schema['question'].dataType.simpleString()}, id {rows.schema['id'].dataType.simpleString()}, score double"
    made = None
    for number in range(passes):
        held = asked.where(F.pmod(F.xxhash64("question"), F.lit(passes)) == number).toPandas()
        names, directions = held["question"].to_numpy(), _unit(held["embedding"]) if len(held) else np.empty((0, dimension))
        probed = None
        if centre is not None:
            near = np.argsort(-(directions @ (centre / np.sqrt((centre * centre).sum(axis=1, keepdims=True))).T), axis=1, kind="stable")[:, :probes]
            probed = {int(c): np.flatnonzero((near == c).any(axis=1)) for c in np.unique(near)}
        shared = spark.sparkContext.broadcast((names, directions, probed))

        def best(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            names, directions, probed = shared.value
            for frame in frames:
                frame = frame.sort_values("id")
                parts = [(frame, np.arange(len(names)))] if probed is None else [(own, probed.get(int(c), np.empty(0, dtype=int))) for c, own in frame.groupby("cell")]
                for own, which in parts:
                    ids, vectors = own["id"].to_numpy(), _unit(own["embedding"]) if len(own) else None
                    for at in range(0, len(which) if len(own) else 0, WIDTH):
                        some = which[at : at + WIDTH]
                        scores = np.round(vectors @ directions[some].T, 6)
                        order = np.argsort(-scores, axis=0, kind="stable")[:k]
                        yield pd.DataFrame({"question": np.tile(names[some], len(order)), "id": ids[order].ravel(), "score": np.take_along_axis(scores, order, 0).ravel()})

        part = rows if probed is None else rows.where(F.col("cell").isin(list(probed)))
        part = part.mapInPandas(best, types)
        made = part if made is None else made.unionByName(part)
    place = F.row_number().over(Window.partitionBy("question").orderBy(F.desc("score"), "id"))
    return made.withColumn("rank", place.cast("long")).where(F.col("rank") <= k)


def probes_for(rows: DataFrame, key: str, *, k: int, dimension: int, centre: np.ndarray, recall: float = 0.95, sample: int = 256) -> int:
    """How many cells a question has to read to find that share of its ``k`` nearest rows.

    Measured by brute force over all ``rows`` (which have cells), for at most ``sample`` of them as questions, chosen by a hash of
    their keys. What the driver sees is a pair of small numbers for each of these and its neighbours.
    """
    chosen = rows.orderBy(F.xxhash64(key), key).limit(sample).select(F.col(key).alias("question"), "embedding").toPandas()
    if not len(chosen):
        return 1
    asked = rows.join(F.broadcast(rows.sparkSession.createDataFrame(chosen[["question"]])), F.col(key) == F.col("question"), "left_semi").select(F.col(key).alias("question"), "embedding")
    near = nearest_to_each(rows, asked, key, k=k, dimension=dimension)
    met = near.join(rows.select(F.col(key).alias("id"), "cell"), "id").select("question", "cell").toPandas()
    order = np.argsort(-(_unit(chosen["embedding"]) @ (centre / np.sqrt((centre * centre).sum(axis=1, keepdims=True))).T), axis=1, kind="stable")
    place = dict(zip(chosen["question"], np.argsort(order, axis=1)))
    needed = np.sort([place[q][c] + 1 for q, c in zip(met["question"], met["cell"])])
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)])


def fused_each(first: DataFrame, second: DataFrame, *, k: int, constant: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of two short ranked lists a question (question, id, rank): the ``k`` best of each (question, id, score, rank)."""
    a, b = (x.select("question", "id", F.col("rank").alias(f"r{i}")) for i, x in enumerate((first, second)))
    part = lambda r: F.coalesce(1.0 / (constant + F.col(r)), F.lit(0.0))
    both = a.join(b, ["question", "id"], "full").select("question", "id", F.round(part("r0") + part("r1"), 6).alias("score"))
    place = F.row_number().over(Window.partitionBy("question").orderBy(F.desc("score"), "id"))
    return both.withColumn("rank", place.cast("long")).where(F.col("rank") <= k)
