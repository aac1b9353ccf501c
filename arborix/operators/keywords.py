"""Ranking texts by the words of questions: postings, document frequencies, and scores with length normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Saturation of a word's count in one text, and how much a text's length counts.
K1, B = 1.2, 0.75
#: Bytes of the questions' distinct words up to which they are broadcast.
BROADCAST_BYTES = 32 << 20


def words(text: Column) -> Column:
    """Runs of letters and digits in lower case, in order; null has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(word, id, times, length): a row for each distinct word of each text. Words are counted within their task before the shuffle.

    A filter on ``word`` comes before the shuffle, so a question costs what its own words cost.
    """
    listed = docs.select(F.col(key).alias("id"), words(F.col(text)).alias("w"))
    rows = listed.select("id", F.size("w").cast("long").alias("length"), F.explode("w").alias("word"))
    return rows.groupBy("word", "id", "length").agg(F.count(F.lit(1)).alias("times"))


def save_postings(rows: DataFrame, path: str, *, files: int) -> None:
    """Postings as Parquet by ranges of (word, id): a filter on words skips files and row groups, and a frequent word spans several files."""
    rows.repartitionByRange(files, "word", "id").sortWithinPartitions("word", "id").write.mode("error").parquet(path)


def totals(docs: DataFrame, text: str) -> tuple[int, float]:
    """Number of texts and their mean length in words, those without words included."""
    n, mean = docs.select(F.size(words(F.col(text))).alias("n")).agg(F.count(F.lit(1)), F.avg("n")).first()
    return n, mean or 0.0


def ranked(rows: DataFrame, size: tuple[int, float], questions: DataFrame, key: str, text: str, *, k: int) -> DataFrame:
    """(question, id, score, rank): for each question the ``k`` texts with the highest scores; equal scores (six digits) by id.

    A word's part is ln(1 + (n - df + 0.5) / (df + 0.5)) * times * (K1 + 1) / (times + K1 * (1 - B + B * length / mean)),
    once for each time the question has it. Texts without any of the words aren't ranked; questions without words have no
    rows. Postings are cut down to the questions' words first, by a broadcast only while these are measured to be small.
    What is left of a text then meets in one task, where its scores for all questions are summed without another shuffle,
    and each task hands on ``k`` rows a question at most.
    """
    n, mean = size
    asked = questions.select(F.col(key).alias("question"), F.explode(words(F.col(text))).alias("word")).groupBy("word", "question").agg(F.count(F.lit(1)).alias("weight"))
    small = (asked.agg(F.sum(F.octet_length("word") + 32)).first()[0] or 0) <= BROADCAST_BYTES
    held = F.broadcast if small else (lambda df: df)
    met = rows.join(held(asked.select("word").distinct()), "word", "left_semi")
    known = met.groupBy("word").agg(F.count_if(F.col("times") > 0).alias("df"))  # asks for the counts as well, so that both uses share one shuffle
    weights = asked.join(known, "word").select("word", "question", (F.col("weight") * F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))).alias("weight"))
    damped = F.col("times") * (K1 + 1) / (F.col("times") + K1 * (1 - B + B * F.col("length") / mean))
    scored = met.repartition("id").join(held(weights), "word").groupBy("question", "id").agg(F.round(F.sum(F.col("weight") * damped), 6).alias("score"))
    place = F.row_number().over(Window.partitionBy("question").orderBy(F.desc("score"), "id"))
    return scored.withColumn("rank", place).where(F.col("rank") <= k).select("question", "id", "score", F.col("rank").cast("long").alias("rank"))
