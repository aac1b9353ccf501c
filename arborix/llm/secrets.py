"""Secrets in texts: three fixed patterns, and runs of signs that a battery of randomness tests takes for keys. Native expressions only."""

from __future__ import annotations

import math
import string
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arborix.llm.common import materialize

#: The patterns, in the order in which kinds are listed, with the least length of a match or of its second group.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = "AKIA[A-Z0-9]{16,}", "[0-9a-f]{24,}"  # as runs are maximal, a least length in the pattern drops the same matches
ASSIGN_PARTS, VALUE_LENGTH = ["passw", "secret", "token", "api"], 6
#: Runs that the tests judge; up to two signs of padding at the end are no part of what is tested.
LEAST_RUN = 16
RUN = f"[A-Za-z0-9+/_-]{{{LEAST_RUN},}}={{0,2}}"
KINDS = ["assign", "access", "hex", "random"]

#: Encodings, smallest alphabet first; a run has the first one that holds all its signs, letters of one case where case says nothing.
ENCODINGS = {
    "digits": string.digits,
    "hex": string.digits + "abcdef",
    "HEX": string.digits + "ABCDEF",
    "letters": string.ascii_lowercase,
    "LETTERS": string.ascii_uppercase,
    "base32": string.ascii_uppercase + "234567",
    "base36": string.digits + string.ascii_lowercase,
    "BASE36": string.digits + string.ascii_uppercase,
    "base62": string.digits + string.ascii_uppercase + string.ascii_lowercase,
    "base64": string.ascii_uppercase + string.ascii_lowercase + string.digits + "+/",
    "base64url": string.ascii_uppercase + string.ascii_lowercase + string.digits + "-_",
    "mixed": string.ascii_uppercase + string.ascii_lowercase + string.digits + "+/-_",
}
SIGNS = ENCODINGS["mixed"]
#: Share of false ones among the runs found, the level at which the battery rejects randomness, steps of a decade of the p-values that are counted.
FALSE_SHARE, REJECT, STEPS = 0.01, 0.001, 20
MOST_STEPS = 300 * STEPS

# ---------------------------------------------------------------- tails of the normal and the chi-squared distribution

#: A published fit of the complementary error function, relative error below 1.2e-7.
ERFC = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]


def erfc(x: Column) -> Column:
    t = 1 / (1 + 0.5 * F.abs(x))
    fit = reduce(lambda rest, c: rest * t + c, reversed(ERFC[:-1]), F.lit(ERFC[-1]))
    half = t * F.exp(-x * x + fit)
    return F.when(x >= 0, half).otherwise(2 - half)


def below(z: Column) -> Column:
    """Probability of a standard normal value of at most z."""
    return 0.5 * erfc(-z / math.sqrt(2))


def above_three(x: Column) -> Column:
    """Probability of a chi-squared value above x with three degrees of freedom."""
    return erfc(F.sqrt(x / 2)) + F.sqrt(2 * x / math.pi) * F.exp(-x / 2)


# ---------------------------------------------------------------- matches and their places


def _matches(kind: int, pattern: str) -> Column:
    """Structs (kind, pos, gap, hit, good) of the matches in a column of hits: the text between them gives their places, once it is summed up."""
    hits = F.col(f"hits{kind}")
    gaps = F.when(F.size(hits) > 0, F.transform(F.split("text", pattern, -1), F.char_length))
    good = (lambda hit: F.char_length(F.regexp_extract(hit, pattern, 2)) >= VALUE_LENGTH) if kind == 0 else lambda hit: F.lit(True)
    return F.transform(
        F.arrays_zip(hits.alias("hit"), F.slice(gaps, 1, F.size(hits)).alias("gap")),
        lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("pos"), x["gap"].cast("long").alias("gap"), x["hit"].alias("hit"), good(x["hit"]).alias("good")),
    )


def scanned(docs: DataFrame) -> DataFrame:
    """Per row: a number, doc_id, and the matches of all kinds in its whole text.

    Assignments are looked for where a text holds one of ASSIGN_PARTS in some case, access and hex keys where a run holds one.
    """
    text = F.coalesce("text", F.lit(""))
    lowered = F.lower(text)
    assigning = reduce(lambda a, b: a | b, [F.contains(lowered, F.lit(p)) for p in ASSIGN_PARTS])
    every = lambda pattern: F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    a = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", text.alias("text"), F.when(assigning, F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(0))).alias("hits0"), F.regexp_extract_all(text, F.lit(RUN), F.lit(0)).alias("hits3"))
    a = a.withColumn("hits1", F.when(F.exists("hits3", lambda r: r.rlike(ACCESS)), every(ACCESS))).withColumn("hits2", F.when(F.exists("hits3", lambda r: r.rlike(HEX)), every(HEX)))
    found = [F.coalesce(_matches(k, p), F.array()) for k, p in enumerate((ASSIGN, ACCESS, HEX, RUN))]
    return a.select("row", "doc_id", F.concat(*found).alias("found"))


def placed(scan: DataFrame) -> DataFrame:
    """A row for each match that counts: row, kind, start, stop, hit; places in code points."""
    each = scan.select("row", F.inline("found"))
    before = Window.partitionBy("row", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    stop = F.sum(F.col("gap") + F.char_length("hit")).over(before)
    return each.withColumn("stop", stop).where("good").select("row", "kind", (F.col("stop") - F.char_length("hit")).alias("start"), "stop", "hit")


# ---------------------------------------------------------------- the battery


def sign_counts(docs: DataFrame) -> dict[str, int]:
    """How often all texts hold each sign of the alphabets: what ordinary runs are made of."""
    words = docs.select(F.explode(F.split("text", " ")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    sums = [F.sum(F.col("n") * (F.octet_length("word") - F.octet_length(F.replace("word", F.lit(c))))).alias(f"s{i}") for i, c in enumerate(SIGNS)]
    row = words.agg(*sums).first()
    return {c: row[f"s{i}"] or 0 for i, c in enumerate(SIGNS)}


def ordinary(counts: dict[str, int]) -> list[tuple[str, str, float, float, float]]:
    """Per encoding: name, alphabet, number of signs, and the sums of squared and cubed shares that its signs have in all texts."""
    out = []
    for name, alphabet in ENCODINGS.items():
        total = sum(counts[c] for c in alphabet) + len(alphabet)
        shares = [(counts[c] + 1) / total for c in alphabet]
        out.append((name, alphabet, float(len(alphabet)), math.fsum(q**2 for q in shares), math.fsum(q**3 for q in shares)))
    return out


def encoding(run: Column) -> Column:
    """The first of ENCODINGS that holds all signs of the run."""
    name = F.lit("mixed")
    for key, alphabet in reversed(list(ENCODINGS.items())[:-1]):
        name = F.when(F.translate(run, alphabet, "") == "", key).otherwise(name)
    return name


def tested(runs: DataFrame, shares: list[tuple[str, str, float, float, float]]) -> DataFrame:
    """``runs`` (columns row, start, stop, hit) with their encoding and two p-values.

    p_random: probability that uniform signs look as little random as these by chi-squared uniformity (excess only), by the number of
    runs above and below the middle of the alphabet, and by serial correlation; the squares of the three standard
    values add up to chi-squared with three degrees of freedom. p_ordinary: probability that signs drawn as all texts hold them
    are spread as evenly. Both use the exact mean and variance at the run's own length, so a short run proves little.
    """
    spark = runs.sparkSession
    known = F.broadcast(spark.createDataFrame(shares, "encoding string, alphabet string, k double, squares double, cubes double"))
    bare = F.rtrim(F.col("hit"), F.lit("="))
    a = runs.withColumn("bare", bare).withColumn("encoding", encoding(F.col("bare"))).join(known, "encoding")
    a = a.withColumn("n", F.char_length("bare").cast("double"))
    a = a.withColumn("values", F.transform(F.split("bare", ""), lambda c: (F.instr(F.col("alphabet"), c) - 1).cast("double")))
    pairs = F.aggregate(F.split("alphabet", ""), F.lit(0.0), lambda s, c: s + F.pow(F.col("n") - F.char_length(F.replace(F.col("bare"), c)), F.lit(2))) - F.col("n")
    a = a.withColumn("pairs", pairs)
    middle = (F.col("k") - 1) / 2
    start = F.struct(F.lit(None).cast("double").alias("last"), F.lit(0.0).alias("product"), F.lit(1.0).alias("runs"))
    walk = F.aggregate(
        "values",
        start,
        lambda s, v: F.struct(
            (v - middle).alias("last"),
            (s["product"] + F.coalesce(s["last"] * (v - middle), F.lit(0.0))).alias("product"),
            (s["runs"] + F.when((s["last"] > 0) != (v - middle > 0), 1.0).otherwise(0.0)).alias("runs"),
        ),
    )
    a = a.withColumn("walk", walk)
    n, k, p2, p3 = F.col("n"), F.col("k"), F.col("squares"), F.col("cubes")
    upper = F.floor(k / 2)  # signs above the middle
    change = 2 * upper * (k - upper) / (k * k)
    uniform = (F.col("pairs") - n * (n - 1) / k) / F.sqrt(2 * n * (n - 1) / k * (1 - 1 / k))
    turns = (F.col("walk.runs") - 1 - (n - 1) * change) / F.sqrt((n - 1) * change * (1 - change) + 2 * (n - 2) * (change / 2 - change * change))
    serial = F.col("walk.product") / ((k * k - 1) / 12) / F.sqrt(n - 1)
    spread = 4 * n * (n - 1) * (n - 2) * (p3 - p2 * p2) + 2 * n * (n - 1) * (p2 - p2 * p2)
    even = (F.col("pairs") - n * (n - 1) * p2) / F.sqrt(spread)
    total = F.pow(F.greatest(uniform, F.lit(0.0)), F.lit(2)) + turns * turns + serial * serial
    return a.select("row", "start", "stop", "hit", "encoding", F.char_length("bare").alias("n"), above_three(total).alias("p_random"), below(even).alias("p_ordinary"))


def discovered(runs: DataFrame, *, false_share: float, reject: float) -> DataFrame:
    """The tested runs that pass for random: not rejected by the battery, and found not to be ordinary.

    The second is decided among all runs of a length class (powers of two) by the step-up rule that keeps the expected
    share of false ones at ``false_share``. P-values are counted on a grid of STEPS a decade and taken at the upper end of
    their step, so the rule needs a table of bounded size, not a ranking of all runs, and errs to the strict side.
    """
    step = F.least(F.floor(-STEPS * F.log10(F.greatest("p_ordinary", F.lit(1e-300)))), F.lit(MOST_STEPS)).cast("int")
    a = runs.withColumn("size", F.floor(F.log2("n")).cast("int")).withColumn("step", step)
    counted = a.groupBy("size", "step").agg(F.count(F.lit(1)).alias("n"))
    down = Window.partitionBy("size").orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.select("size", "step", F.sum("n").over(down).alias("found"), F.sum("n").over(Window.partitionBy("size")).alias("all"))
    limits = ranked.where(F.col("all") * F.pow(F.lit(10.0), -F.col("step") / STEPS) <= false_share * F.col("found")).groupBy("size").agg(F.min("step").alias("least"))
    return a.join(F.broadcast(limits), "size").where((F.col("step") >= F.col("least")) & (F.col("p_random") >= reject))  # a row for each power of two


def secrets(docs: DataFrame, *, false_share: float = FALSE_SHARE, reject: float = REJECT) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans.

    ``spans`` lists kind:start:end of all findings by start, then kind (assign, access, hex, random); places are code
    points, ends exclusive. Matches of the three patterns always stay; ``random`` are runs that the battery adds, also where a
    pattern has found them. base_sha256 is over the patterns' findings alone.

    Null texts count as empty; without findings the list is empty. Texts are scanned whole, however long: a row's matches
    are an array, their places sums in a window, so time grows with the text and not with its square. Repeated rows give
    the same values again, unless the corpus as a whole changes what is found: ordinary shares of signs and the limits of a
    length class are counted over all texts. Two findings at one place stand in the order of their kinds. Other columns play no
    part; an empty table gives an empty result.
    """
    scan = materialize(scanned(docs))
    found = materialize(placed(scan))
    runs = materialize(tested(found.where(f"kind = {KINDS.index('random')}"), ordinary(sign_counts(docs))))
    random = discovered(runs, false_share=false_share, reject=reject).select("row", F.lit(KINDS.index("random")).alias("kind"), "start", "stop")
    all_found = found.where(f"kind < {KINDS.index('random')}").select("row", "kind", "start", "stop").unionByName(random)
    name = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("kind") + 1)
    span = F.concat_ws(":", name, F.col("start").cast("string"), F.col("stop").cast("string"))
    listed = all_found.groupBy("row").agg(
        *[F.count_if(F.col("kind") == k).alias(f"n_{name}") for k, name in enumerate(KINDS)],
        F.array_sort(F.collect_list(F.struct("start", "kind", span.alias("span")))).alias("l"),
    )
    base = F.array_join(F.transform(F.filter("l", lambda x: x["kind"] < KINDS.index("random")), lambda x: x["span"]), ",")
    done = listed.select("row", *[f"n_{k}" for k in KINDS], base.alias("base"), F.array_join("l.span", ",").alias("spans"))
    numbers = [F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS]
    texts = [F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans")]
    return scan.select("row", "doc_id").join(done, "row", "left").select("doc_id", *numbers, *texts)


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents: doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans."""
    return secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
