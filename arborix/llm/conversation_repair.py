"""Repair of conversations: weighted CYK parsing over spans of turns, combined bottom-up by span length, block by block."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arborix.llm.common import join_to_groups, map_sorted_groups, materialize, small_batches

# ---------------------------------------------------------------- the grammar
#
# Roles have to give (s?(ua)+)?. Its states: nothing yet, after a system turn, after a user turn, after an assistant turn.
# A nonterminal is a pair of states, X_pq: "what this span becomes leads from p to q". The grammar is in Chomsky normal form:
# X_pq -> X_pr X_rq, and X_pq -> one turn, kept, reroled or deleted. Insertions are closed over at the turns: a turn stands
# for any insertions before it, its own edit and any insertions after it.

NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: What a role's initial leads to.
STEPS = {"s": {NOTHING: SYSTEM}, "u": {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: The price of edits, and what a truncated turn that stays adds.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Insertions that lead from a state to another: (price, audit).
INSERTED = {(p, p): (0, "") for p in range(4)}
for _ in range(4):  # closure: one more insertion each time, the cheapest stay
    for (p, q), (price, audit) in list(INSERTED.items()):
        for role in "ua":
            if q in STEPS[role]:
                to = (p, STEPS[role][q])
                INSERTED[to] = min(INSERTED.get(to, (1 << 30, "")), (price + INSERT, audit + "I"))
NAMES = sorted({*INSERTED, (NOTHING, SYSTEM)})  # a system turn is never inserted
#: Rules X_pq -> X_pr X_rq as places in a cell.
RULES = [(NAMES.index((p, q)), NAMES.index((p, r)), NAMES.index((r, q))) for p, q in NAMES for r in range(4) if (p, r) in NAMES and (r, q) in NAMES]
#: Turns or blocks that one parse spans at most.
SPAN_BITS = 3

Cell = tuple  # for each nonterminal the least (price, audit), or None


@lru_cache(maxsize=1024)
def turn_cell(initial: str, fault: str) -> Cell:
    """The cell of one turn; ``fault`` is blank, duplicate, truncated or empty."""
    own = {(p, p): [(DELETE, "D")] for p in range(4)}
    if fault not in ("blank", "duplicate"):
        more = TRUNCATED if fault == "truncated" else 0
        for role, price, audit in ((initial, 0, "K"), ("u", REROLE, "R"), ("a", REROLE, "R")):
            for p, q in STEPS.get(role, {}).items():
                own.setdefault((p, q), []).append((price + more, audit))
    closed: dict[tuple[int, int], tuple[int, str]] = {}
    for (p, a), before in INSERTED.items():
        for (b, c), edits in own.items():
            for (d, q), after in INSERTED.items():
                if a == b and c == d:
                    found = min((before[0] + price + after[0], before[1] + audit + after[1]) for price, audit in edits)
                    closed[p, q] = min(closed.get((p, q), found), found)
    return tuple(closed.get(name) for name in NAMES)


def parse(leaves: list[Cell]) -> Cell:
    """The cell of the whole sequence: all spans by length, all places where they can be cut.

    A cell holds the least (price, audit) of each nonterminal. That is enough: two audits of one span and price differ
    before either ends, as they hold as many kept, reroled and deleted turns and so as many insertions, hence the lesser
    one stays the lesser whatever follows.
    """
    n = len(leaves)
    chart: dict[tuple[int, int], Cell] = {(i, i + 1): leaf for i, leaf in enumerate(leaves)}
    for length in range(2, n + 1):
        for i in range(n - length + 1):
            best: list[tuple[int, str] | None] = [None] * len(NAMES)
            for cut in range(i + 1, i + length):
                left, right = chart[i, cut], chart[cut, i + length]
                for to, a, b in RULES:
                    x, y = left[a], right[b]
                    if x is not None and y is not None:
                        price, known = x[0] + y[0], best[to]
                        if known is None or price < known[0]:
                            best[to] = (price, x[1] + y[1])
                        elif price == known[0] and (audit := x[1] + y[1]) < known[1]:
                            best[to] = (price, audit)
            chart[i, i + length] = tuple(best)
    return chart[0, n]


@lru_cache(maxsize=1 << 16)
def parsed_turns(turns: tuple[tuple[str, str], ...]) -> str:
    """The cell of a block of turns, as text; blocks with the same initials and faults share it."""
    return written(parse([turn_cell(*t) for t in turns]))


def written(cell: Cell) -> str:
    return ";".join("" if x is None else f"{x[0]}:{x[1]}" for x in cell)


@lru_cache(maxsize=1 << 14)
def read(cell: str) -> Cell:
    return tuple((int(x.partition(":")[0]), x.partition(":")[2]) if x else None for x in cell.split(";"))


def illegal(pair: str) -> bool:
    return pair not in ("su", "ua", "au")


# ---------------------------------------------------------------- on tables

SEPARATED = r"[^\x20\x09-\x0D]"


def _spaced(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the damage that crc32 of ``conv_id:turn`` decides; null roles and texts become one space.

    The rest of the division by 20: 0 drops the row, 1 empties the text, 2 takes its full stops, exclamation and question
    marks away, 3 repeats the row, 4 makes the role user.
    """
    rest = F.crc32(F.concat(_spaced("conv_id"), F.lit(":"), _spaced("turn")).cast("binary")) % 20
    text = F.when(rest == 1, "").when(rest == 2, F.regexp_replace(_spaced("text"), "[.!?]", "")).otherwise(_spaced("text"))
    role = F.when(rest == 4, "user").otherwise(_spaced("role"))
    copies = F.when(rest == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return turns.where(rest != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("_copy")).drop("_copy")


def numbered(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` (stored) with the ids of monotonically_increasing_id made gapless: a number for each partition is all that is joined."""
    part = F.shiftright(column, 33)
    sizes = sorted((r["part"], r["n"]) for r in rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    offsets = np.concatenate(([0], np.cumsum([n for _, n in sizes])))
    known = [(p, int(o) - (p << 33)) for (p, _), o in zip(sizes, offsets, strict=False)]
    moves = F.broadcast(rows.sparkSession.createDataFrame(known, "_part long, _move long"))
    return rows.join(moves, part == moves["_part"]).withColumn(column, F.col(column) + F.col("_move")).drop("_part", "_move")


def _blocks(group: dict[str, np.ndarray]) -> pd.DataFrame:
    initials = group["initial"].tolist()
    pairs = sum(illegal(a + b) for a, b in zip(initials, initials[1:], strict=False))
    cell = parsed_turns(tuple(zip(initials, group["fault"].tolist(), strict=True)))
    return pd.DataFrame([(group["key"][0], group["at"][0], initials[0], initials[-1], pairs, cell)], columns=["key", "at", "first", "last", "illegal", "cell"])


def _joined(group: dict[str, np.ndarray]) -> pd.DataFrame:
    """Blocks of a conversation that follow each other, as one: their cells are the leaves of the next parse."""
    first, last = group["first"].tolist(), group["last"].tolist()
    pairs = int(group["illegal"].sum()) + sum(illegal(a + b) for a, b in zip(last, first[1:], strict=False))
    cell = group["cell"][0] if len(first) == 1 else written(parse([read(c) for c in group["cell"].tolist()]))
    return pd.DataFrame([(group["key"][0], group["at"][0], first[0], last[-1], pairs, cell)], columns=["key", "at", "first", "last", "illegal", "cell"])


BLOCK = "key string, at long, first string, last string, illegal long, cell string"


def _hashed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of the repaired turns of each conversation, fed turn by turn: a batch is all that is held.

    Rows come by key and place; the first of a key carries the audit as its text.
    """
    key, audit, at, last, digest, begun = None, "", 0, "", hashlib.sha256(), False

    def put(role: str, text: str) -> None:
        nonlocal last, begun
        digest.update((("\n" if begun else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
        last, begun = role[:1], True

    def due() -> str:
        return "assistant" if last == "u" else "user"

    def insertions() -> None:
        nonlocal at
        while at < len(audit) and audit[at] == "I":
            put(due(), "")
            at += 1

    for frame in frames:
        done = []
        for k, place, role, text in zip(frame["key"].tolist(), frame["at"].tolist(), frame["role"].tolist(), frame["text"].tolist(), strict=True):
            if place < 0:
                if key is not None:
                    insertions()
                    done.append((key, digest.hexdigest()))
                key, audit, at, last, digest, begun = k, text, 0, "", hashlib.sha256(), False
                continue
            insertions()
            if audit[at] != "D":
                put(role if audit[at] == "K" else due(), text)
            at += 1
        if done:
            yield pd.DataFrame(done, columns=["key", "repaired_sha256"])
    if key is not None:
        insertions()
        yield pd.DataFrame([(key, digest.hexdigest())], columns=["key", "repaired_sha256"])


def repaired(turns: DataFrame, *, harm: bool = True) -> DataFrame:
    """Per conv_id: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Turns stand in order of turn (nulls first); ties by role and text, so the result doesn't depend on the order of rows.
    ``harm=False`` repairs the turns as they are (null roles and texts still become one space). A null conv_id is a
    conversation like others. Empty and blank texts are faults to delete; repeated rows are duplicates. A conversation
    without rows after the damage has zeros, an empty audit and the hash of an empty text. Roles that don't begin with s,
    u or a can't be kept. Very long texts are whole. Other columns play no part; an empty table gives an empty result.

    Rows are dealt by key and turn, so a conversation with a third of all rows lies in many partitions. Blocks of up to
    2^SPAN_BITS consecutive turns are parsed first, then blocks of blocks, until one cell is left of each conversation;
    as cells hold all pairs of states, any bracketing gives the same parse. Duplicates are told by the first row of each
    (conversation, role, text), joined back by row number. A hash is one pass over a conversation by nature: its turns
    stream through one task, a batch at a time.
    """
    spark = turns.sparkSession
    small_batches(spark)
    key = F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("")).alias("key")
    hurt = damaged(turns) if harm else turns.select("conv_id", "turn", _spaced("role").alias("role"), _spaced("text").alias("text"))
    order = ["key", F.asc_nulls_first("turn"), "role", "text", "_n"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    placed = hurt.select(key, "turn", "role", "text", F.monotonically_increasing_id().alias("_n")).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ending = F.regexp_extract("text", rf"({SEPARATED})[\x20\x09-\x0D]*\z", 1)
    initial = F.when(F.substring("role", 1, 1).isin("s", "u", "a"), F.substring("role", 1, 1)).otherwise("o")
    stored = materialize(placed.select("key", F.monotonically_increasing_id().alias("at"), "turn", "role", "text", initial.alias("initial"), ending.alias("ending")))
    rows = numbered(stored, "at")

    firsts = rows.groupBy("key", "role", F.sha2("text", 256).alias("digest")).agg(F.min("at").alias("at")).select("at", F.lit(True).alias("is_first"))
    fault = F.when(F.col("ending") == "", "blank").when(F.col("is_first").isNull(), "duplicate").when(~F.col("ending").isin(".", "!", "?"), "truncated").otherwise("")
    judged = rows.select("key", "at", "initial", "ending").join(firsts, "at", "left").select("key", "at", "initial", fault.alias("fault"))
    starts = materialize(rows.groupBy("key").agg(F.min("at").alias("start"), F.count(F.lit(1)).alias("turns")))
    faulty = materialize(join_to_groups(judged, starts, "key", "turns").select("key", (F.col("at") - F.col("start")).alias("at"), "initial", "fault"))
    counts = faulty.groupBy("key").agg(*[F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")])
    turn = F.col("turn").cast("decimal(38,0)")
    spread = rows.groupBy("key", turn.alias("turn")).agg(F.lit(1)).groupBy("key").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("wide"))
    gaps = spread.select("key", F.coalesce(F.expr("try_cast(wide AS bigint)"), F.lit(0)).alias("gaps"))

    longest, bits = starts.agg(F.max("turns")).first()[0] or 0, SPAN_BITS
    cells = map_sorted_groups(faulty.withColumn("block", F.shiftright("at", bits)), ["key", "block"], _blocks, BLOCK, ["at"])
    while 1 << bits < longest:
        bits += SPAN_BITS
        cells = map_sorted_groups(materialize(cells).withColumn("block", F.shiftright("at", bits)), ["key", "block"], _joined, BLOCK, ["at"])
    cells = materialize(cells)

    ways = []
    for q in (NOTHING, ASSISTANT):
        found = F.element_at(F.split("cell", ";"), NAMES.index((NOTHING, q)) + 1)
        ways.append(F.when(found != "", F.struct(F.split_part(found, F.lit(":"), F.lit(1)).try_cast("long").alias("cost"), F.split_part(found, F.lit(":"), F.lit(2)).alias("audit"))))
    best = cells.select("key", "illegal", F.least(*ways).alias("best")).select("key", "illegal", "best.cost", "best.audit")
    headed = rows.select("key", "at", "role", "text").unionByName(best.select("key", F.lit(-1).cast("long").alias("at"), F.lit("").alias("role"), F.col("audit").alias("text")))
    hashes = headed.repartition(parts, "key").sortWithinPartitions("key", "at").mapInPandas(_hashed, "key string, repaired_sha256 string")

    every = turns.select("conv_id", key).distinct()
    joined = reduce(lambda a, b: a.join(b, "key", "left"), [every, gaps, counts, best, hashes])
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = hashlib.sha256(b"").hexdigest()
    return joined.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every conversation after the damage."""
    return repaired(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def _oracle() -> str:
    """A recursion over the turns of all conversations: the best (price, audit) of each state after each turn."""
    states = {"n": NOTHING, "s": SYSTEM, "u": USER, "a": ASSISTANT}
    named = {v: k for k, v in states.items()}
    wide = 8  # digits of the price before the audit

    def plus(x: str, price: str, audit: str) -> str:
        return f"(lpad(CAST(CAST(substr({x}, 1, {wide}) AS BIGINT) + ({price}) AS VARCHAR), {wide}, '0') || substr({x}, {wide + 1}) || '{audit}')"

    def edited(to: int) -> str:
        ways = [plus(named[to], "4", "D")]
        for role in "sua":
            for p, q in STEPS[role].items():
                if q == to:
                    ways.append(f"CASE WHEN r.initial = '{role}' AND NOT r.gone THEN {plus(named[p], 'r.more', 'K')} END")
                    if role != "s":
                        ways.append(f"CASE WHEN NOT r.gone THEN {plus(named[p], '3 + r.more', 'R')} END")
        return f"least({', '.join(ways)})" if len(ways) > 1 else ways[0]

    def inserted(to: int, prefix: str = "") -> str:
        ways = [prefix + named[to]] + [plus(prefix + named[p], str(price), audit) for (p, q), (price, audit) in INSERTED.items() if q == to and p != to]
        return f"least({', '.join(ways)})" if len(ways) > 1 else ways[0]

    start = {q: f"lpad('{INSERTED[NOTHING, q][0]}', {wide}, '0') || '{INSERTED[NOTHING, q][1]}'" if (NOTHING, q) in INSERTED else "CAST(NULL AS VARCHAR)" for q in range(4)}
    return rf"""
WITH RECURSIVE turns AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(k) + 1), lambda i: CAST(ascii(substr(k, CAST(i AS INTEGER), 1)) AS BIGINT))),
      lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1))))) % 20 AS rest
  FROM (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations)),
harmed AS (
  SELECT conv_id, turn, CASE WHEN rest = 4 THEN 'user' ELSE role END AS role,
    CASE rest WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM turns, LATERAL (SELECT unnest(CASE WHEN rest = 3 THEN [0, 1] ELSE [0] END) AS copy) WHERE rest <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place,
    regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS ending, substr(role, 1, 1) AS initial FROM harmed),
faulty AS (
  SELECT *, CASE WHEN ending = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 THEN 'duplicate' WHEN ending NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY place) || initial AS pair FROM placed),
r AS (SELECT *, fault IN ('blank', 'duplicate') AS gone, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS more FROM faulty),
steps(conv_id, place, n, s, u, a) AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT), {start[0]}, {start[1]}, {start[2]}, {start[3]} FROM r
  UNION ALL
  SELECT conv_id, place, {inserted(0, 'e')}, {inserted(1, 'e')}, {inserted(2, 'e')}, {inserted(3, 'e')} FROM (
    SELECT steps.conv_id, r.place, {edited(0)} AS en, {edited(1)} AS es, {edited(2)} AS eu, {edited(3)} AS ea
    FROM steps JOIN r ON r.conv_id IS NOT DISTINCT FROM steps.conv_id AND r.place = steps.place + 1)),
best AS (
  SELECT conv_id, CAST(substr(k, 1, {wide}) AS BIGINT) AS cost, substr(k, {wide + 1}) AS audit
  FROM (SELECT conv_id, least(n, a) AS k FROM steps QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY place DESC) = 1)),
edits AS (
  SELECT conv_id, i, substr(audit, CAST(i AS INTEGER), 1) AS edit, length(regexp_replace(substr(audit, 1, CAST(i AS INTEGER)), 'I', '', 'g')) AS place, length(regexp_replace(substr(audit, 1, CAST(i AS INTEGER)), 'D', '', 'g')) AS kept
  FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS i FROM best)),
lines AS (
  SELECT e.conv_id, e.i, e.edit, r.text, r.role, (e.kept + CASE WHEN bool_or(e.edit = 'K' AND r.initial = 's') OVER (PARTITION BY e.conv_id) THEN 1 ELSE 0 END) % 2 AS odd
  FROM edits e LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM e.conv_id AND r.place = e.place AND e.edit <> 'I' WHERE e.edit <> 'D'),
texts AS (
  SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN odd = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY i) AS whole FROM lines GROUP BY conv_id),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN texts ON texts.conv_id IS NOT DISTINCT FROM c.conv_id
"""


OP12_SQL = _oracle()
