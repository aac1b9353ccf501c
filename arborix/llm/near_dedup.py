"""Near duplicates by a chosen-path similarity join on word shingles.

Every document draws, for each of several independent trees, the path it takes: at a node it goes on by the token of
its set that has the smallest hash under that node's hash function, so two documents take the same branch with the
probability of their Jaccard similarity. Nodes with few documents are compared exhaustively by short sketches; larger
ones branch on. Each pair that a sketch lets through is confirmed on the full shingle sets, and links are what was confirmed.

Documents are told apart by a digest of their shingle set, never by doc_id, which may repeat or be null.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arborix.llm.common import batches, bloom, discard, join_to_groups, map_sorted_groups, materialize, mix64, small_batches, spans, word_hashes
from arborix.llm.components import connected_components

#: Branchings after which a node is no longer split.
DEPTH = 6
#: Share of pairs at the threshold that may part in every tree before they have branched JUDGED times together; sets the number of trees.
MISSED, JUDGED = 2.5e-4, 4
#: Documents in a node that are compared exhaustively.
NODE = 48
#: Bytes of a sketch (one minimum each), and the share that has to agree for similarity s: s less four standard deviations.
SKETCH = 64
#: Shingles of a crowd (documents that agreed at every branching) that one task compares; larger ones are thinned around pivots, then dealt out in pairs of blocks.
BLOCK = 1 << 20

_SKETCH_SEEDS = mix64(np.arange(1001, 1001 + SKETCH, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) | np.uint64(1)


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Each text's sorted distinct hashes of ``k`` successive words; with fewer words all of them as one; none without words."""
    buf, starts, ends, first, _ = spans(texts)
    words = word_hashes(buf, starts, ends)
    rolled = np.zeros(len(words), dtype=np.uint64)
    for i in range(k):
        rolled[: len(words) - i] = rolled[: len(words) - i] * np.uint64(0x9E3779B97F4A7C15) + mix64(words[i:] + np.uint64(i)) if len(words) > i else rolled[:0]
    rolled = mix64(rolled)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= k:
            out.append(np.unique(rolled[a : b - k + 1]))
        elif b > a:
            h = np.uint64(b - a)
            for w in words[a:b]:
                h = mix64(np.array([h * np.uint64(31) + w], dtype=np.uint64))[0]
            out.append(np.array([h], dtype=np.uint64))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def trees_for(similarity: float) -> int:
    """Independent trees that bring the recall of pairs at ``similarity`` to 1 - MISSED at branching JUDGED: 16 at 0.8."""
    apart = 1 - similarity**JUDGED
    return max(1, math.ceil(math.log(MISSED) / math.log(apart))) if apart > 0 else 1


def paths(tokens: np.ndarray, sizes: np.ndarray, trees: int) -> np.ndarray:
    """Node keys of each set's path through each tree, sets x (trees * DEPTH); ``tokens`` holds the sets one after the other.

    A node's hash function is a bijection, so its minimum stands for the token that has it.
    """
    first, keys = np.cumsum(sizes) - sizes, np.empty((len(sizes), trees * DEPTH), dtype=np.uint64)
    seeds = mix64(np.arange(1, trees + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    for t in range(trees):
        at = np.full(len(sizes), seeds[t])
        for level in range(DEPTH):
            h = tokens ^ np.repeat(at, sizes)
            h *= np.uint64(0x94D049BB133111EB)
            at = mix64(at * np.uint64(3) + np.minimum.reduceat(h, first))
            keys[:, t * DEPTH + level] = at
    return keys


def sketches(tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Eight bits of each of SKETCH minima, sets x SKETCH."""
    first, low = np.cumsum(sizes) - sizes, np.empty((len(sizes), SKETCH), dtype=np.uint8)
    for i in range(SKETCH):
        low[:, i] = (np.minimum.reduceat(tokens * _SKETCH_SEEDS[i], first) >> np.uint64(24)).astype(np.uint8)
    return low


def _digests(sets: list[np.ndarray]) -> list[bytes | None]:
    return [hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None for x in sets]


def signatures(docs: DataFrame, k: int, trees: int) -> DataFrame:
    """Per row: doc_id, n shingles, a digest of the set, and the paths and the sketch (null without words)."""

    @F.pandas_udf("n long, digest binary, path array<long>, sketch binary")
    def sign(text: pd.Series) -> pd.DataFrame:
        parts = []
        for _, run in batches(text.tolist()):
            with np.errstate(over="ignore"):
                sets = shingle_sets(run, k)
                full = [i for i, x in enumerate(sets) if len(x)]
                path, sketch = np.full((2, len(run)), None, dtype=object)
                if full:
                    tokens, sizes = np.concatenate([sets[i] for i in full]), np.array([len(sets[i]) for i in full])
                    for i, p, low in zip(full, paths(tokens, sizes, trees).view(np.int64), sketches(tokens, sizes), strict=True):
                        path[i], sketch[i] = p, low.tobytes()
            parts.append(pd.DataFrame({"n": [len(x) for x in sets], "digest": _digests(sets), "path": path, "sketch": sketch}))
        return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({"n": [], "digest": [], "path": [], "sketch": []})

    return docs.select("doc_id", sign("text").alias("s")).select("doc_id", "s.*")


def tree_nodes(reps: DataFrame, similarity: float) -> tuple[list[DataFrame], DataFrame]:
    """The nodes of all trees for representatives (rep, n, path, sketch), level by level.

    First stored tables (node, rep, n, sketch, path, count) of all nodes with two members or more, one a level, of which
    those with NODE members at most are to be compared; then (node, rep) of the crowds, nodes that are larger even below
    the last branching.
    """
    rows = reps.select(
        "rep", "n", "sketch", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(trees_for(similarity) - 1)), lambda t: F.slice("path", t * DEPTH + 1, DEPTH))).alias("tree", "path")
    ).select("rep", "n", "sketch", "path")
    levels = []
    for level in range(1, DEPTH + 1):
        keyed = rows.withColumn("node", F.element_at("path", level))
        sizes = materialize(keyed.groupBy("node").count().where("count > 1"))
        levels.append(materialize(join_to_groups(keyed, sizes, "node", "count", by=["rep"])))
        rows = levels[-1].where(F.col("count") > NODE).drop("node", "count")
        discard(sizes)
        if not rows.limit(1).count():
            break
    return levels, levels[-1].where(F.col("count") > NODE).select("node", "rep")


def crossing(nodes: DataFrame, similarity: float, *, every: bool) -> DataFrame:
    """Pairs inside nodes, rows (node, rep, n, sketch, label), that may be similar and have different labels.

    With ``every`` all such pairs, as (a, b), where a node gives less than NODE / 2 a member. Else the members of such
    pairs: node, rep, n, sketch, other, label_of_other, the last two being the partner with the smallest label, null if
    no partner's label is smaller than the own.
    """
    need = int((similarity - 4 * (similarity * (1 - similarity) / SKETCH) ** 0.5) * SKETCH)

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for frame in frames:
            frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            node = frame["node"].to_numpy()
            cut = np.searchsorted(node, node[-1]) if len(node) else 0
            rest = frame.iloc[cut:]
            if cut:
                yield met(frame.iloc[:cut])
        if rest is not None and len(rest):
            yield met(rest)

    def met(frame: pd.DataFrame) -> pd.DataFrame:
        node, rep, n, label = (frame[c].to_numpy() for c in ("node", "rep", "n", "label"))
        low = np.frombuffer(b"".join(frame["sketch"]), dtype=np.uint8).reshape(-1, SKETCH)
        left, right = [], []
        for d in range(1, NODE):
            i = np.flatnonzero(node[d:] == node[:-d])
            if not len(i):
                break
            i = i[label[i] != label[i + d]]
            i = i[np.minimum(n[i], n[i + d]) >= similarity * np.maximum(n[i], n[i + d]) - 1e-9]
            i = i[(low[i] == low[i + d]).sum(axis=1) >= need]
            left.append(i)
            right.append(i + d)
        a, b = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (left, right))
        if every:
            return pd.DataFrame({"a": np.minimum(rep[a], rep[b]), "b": np.maximum(rep[a], rep[b])})
        high, lower = np.where(label[a] > label[b], a, b), np.where(label[a] > label[b], b, a)
        order = np.argsort(-label[lower], kind="stable")  # of several partners the last one written has the smallest label
        best = np.full(len(node), -1)
        best[high[order]] = lower[order]
        some = np.unique(np.concatenate([a, b]))
        to = best[some]
        other = pd.array(np.where(to >= 0, rep[to], 0), dtype="Int64")
        low_label = pd.array(np.where(to >= 0, label[to], 0), dtype="Int64")
        other[to < 0] = pd.NA
        low_label[to < 0] = pd.NA
        return pd.DataFrame({"node": node[some], "rep": rep[some], "n": n[some], "sketch": frame["sketch"].to_numpy()[some], "other": other, "label_of_other": low_label})

    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    dealt = nodes.select("node", "rep", "n", "sketch", "label").repartition(parts, "node").sortWithinPartitions("node")
    return dealt.mapInPandas(compare, "a long, b long" if every else "node long, rep long, n long, sketch binary, other long, label_of_other long")


def sets_of(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(rep, n, tokens), a stored table: the sets of ``wanted`` representatives (rep, doc_id, digest).

    Only texts whose doc_id a Bloom filter lets through are cut into shingles again; they meet by digest.
    """

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for _, run in batches(frame["text"].tolist()):
                with np.errstate(over="ignore"):
                    sets = shingle_sets(run, k)
                yield pd.DataFrame({"digest": _digests(sets), "n": [len(x) for x in sets], "tokens": [x.tobytes() for x in sets]})

    held = bloom(wanted.select(F.xxhash64("doc_id").alias("h")))
    sets = docs.where(held.may_hold(F.xxhash64("doc_id"))).select("text").mapInPandas(cut, "digest binary, n long, tokens binary")
    met = sets.join(wanted.select("digest", "rep"), "digest").groupBy("rep").agg(F.any_value("n").alias("n"), F.any_value("tokens").alias("tokens"))
    return materialize(met)


@F.pandas_udf(T.LongType())
def _shared(mine: pd.Series, other: pd.Series) -> pd.Series:
    """Tokens that two sets share."""
    return pd.Series([len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True)) for x, y in zip(mine, other, strict=True)], dtype="int64")


def confirmed(pairs: DataFrame, pool: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) with ``linked``, whether their full sets are similar; a stored table. A representative is in few pairs, as nodes are small."""
    first, second = (pool.select(F.col("rep").alias(c), F.col("n").alias(f"n_{c}"), F.col("tokens").alias(f"tokens_{c}")) for c in ("a", "b"))
    both = pairs.join(first, "a").join(second, "b").withColumn("shared", _shared("tokens_a", "tokens_b"))
    return materialize(both.select("a", "b", (100 * F.col("shared") >= percent * (F.col("n_a") + F.col("n_b") - F.col("shared"))).alias("linked")))


def _exact(group: dict[str, np.ndarray], percent: int) -> pd.DataFrame | None:
    """A spanning forest of the links in one group: breadth first, each document against those not yet reached."""
    ids, sets = group["rep"], [np.frombuffer(b, dtype=np.uint64) for b in group["tokens"]]
    if len(ids) < 2:
        return None
    sizes = np.array([len(s) for s in sets])
    if len(ids) == 2:
        shared = len(np.intersect1d(*sets, assume_unique=True))
        return pd.DataFrame({"a": [ids.min()], "b": [ids.max()]}) if 100 * shared >= percent * (sizes.sum() - shared) else None
    vocabulary, index = np.unique(np.concatenate(sets), return_inverse=True)
    at = np.concatenate(([0], np.cumsum(sizes)))
    mark, left, a, b = np.zeros(len(vocabulary), dtype=np.int32), np.arange(len(ids)), [], []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            p = queue.pop()
            own = index[at[p] : at[p + 1]]
            mark[own] = 1
            tokens = np.concatenate([index[at[i] : at[i + 1]] for i in left])
            shared = np.add.reduceat(mark[tokens], np.cumsum(sizes[left]) - sizes[left])
            mark[own] = 0
            hit = 100 * shared >= percent * (sizes[p] + sizes[left] - shared)
            reached = left[hit]
            a += [ids[p]] * len(reached)
            b += ids[reached].tolist()
            queue += reached.tolist()
            left = left[~hit]
    return pd.DataFrame({"a": a, "b": b}) if a else None


def crowd_links(docs: DataFrame, reps: DataFrame, crowds: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) confirmed on full sets, a spanning forest of every true component inside each connected group of crowds.

    ``crowds`` is (node, rep). A group of over BLOCK shingles is first thinned: all its documents are compared with a
    pivot at once; those linked to it leave, unless the triangle inequality of the Jaccard distance leaves room for a
    link to one that is not. That goes on while it thins by a tenth or more, as copies do. What still exceeds BLOCK is
    dealt out in blocks, each pair of them a task of its own, so no link is lost and no task is large.
    """
    least = crowds.groupBy("node").agg(F.min("rep").alias("a"), F.count(F.lit(1)).alias("members"))
    stars = join_to_groups(crowds.withColumnRenamed("rep", "b"), materialize(least), "node", "members").where("a <> b").select("a", "b").distinct()
    groups = connected_components(stars).select(F.col("node").alias("rep"), F.col("component").alias("grp"))
    wanted = materialize(reps.select("rep", "doc_id", "digest").join(groups, "rep"))
    pool = materialize(sets_of(docs, wanted, k).join(wanted.select("rep", "grp"), "rep").select("rep", "grp", "n", "tokens"))
    links, before = None, None
    while True:
        sizes = materialize(pool.groupBy("grp").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("members")))
        marked = join_to_groups(pool, sizes, "grp", "members", by=["rep"])
        large = sizes.where(F.col("total") > BLOCK).agg(F.sum("members")).first()[0]
        if not large or before is not None and large > 0.9 * before:
            break
        before = large
        found, rest = _pivot_round(marked.where(F.col("total") > BLOCK), percent)
        links = found if links is None else links.unionByName(found)
        pool = materialize(marked.where(F.col("total") <= BLOCK).select("rep", "grp", "n", "tokens").unionByName(rest))
    blocks = F.ceil(F.col("total") / BLOCK).cast("int")
    placed = marked.where("members > 1").withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "grp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "rep", "tokens"
    )
    last = map_sorted_groups(dealt, ["grp", "i", "j"], lambda g: _exact(g, percent), "a long, b long")
    return materialize(last if links is None else links.unionByName(last))


def _pivot_round(hot: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links of each large group (grp, rep, n, tokens, total) to its pivot, and the rows that may still have links to find."""
    pieces = F.ceil(F.col("total") / BLOCK).cast("int")
    pivot = hot.groupBy("grp").agg(F.min_by(F.struct("rep", "n", "tokens"), F.xxhash64("rep", F.lit(7))).alias("p"), F.max(pieces).alias("pieces"))
    pivot = pivot.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).drop("pieces")
    both = hot.withColumn("piece", F.pmod(F.xxhash64("rep"), pieces).cast("int")).join(pivot, ["grp", "piece"]).withColumn("shared", _shared("tokens", "p.tokens"))
    union = F.col("n") + F.col("p.n") - F.col("shared")
    both = materialize(both.select("rep", "grp", "n", "tokens", F.col("p.rep").alias("pivot"), (1 - F.col("shared") / union).alias("far"), (100 * F.col("shared") >= percent * union).alias("linked")))
    links = both.where("linked and rep <> pivot").select(F.least("pivot", "rep").alias("a"), F.greatest("pivot", "rep").alias("b"))
    nearest = materialize(both.groupBy("grp").agg(F.min(F.when(~F.col("linked"), F.col("far"))).alias("nearest"), F.count(F.lit(1)).alias("members")))
    margin = 1 - percent / 100 + 1e-9
    rest = join_to_groups(both, nearest, "grp", "members", by=["rep"]).where((~F.col("linked")) | (F.col("far") + margin >= F.col("nearest"))).where(f"rep <> pivot or far + {margin!r} >= nearest")
    return links, rest.select("rep", "grp", "n", "tokens")


def confirmed_links(docs: DataFrame, reps: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) between representatives, confirmed on full sets, that connect all that is similar and met in a node.

    Crowds come first. Then the members of small nodes: each representative is confirmed with one partner, that of the
    smallest label, where a label is the component of the links so far; once more with the labels after that; and at
    last every pair that still lies in two components. So copies, however many, take about two comparisons each, and
    only pairs that look alike but are not are compared one by one; none twice.
    """
    levels, crowds = tree_nodes(reps, percent / 100)
    links = [crowd_links(docs, reps, crowds, k, percent)] if crowds.limit(1).count() else []
    small = reduce(DataFrame.unionByName, [t.where(F.col("count") <= NODE).select("node", "rep", "n", "sketch") for t in levels])
    members, tested, pool = None, None, None
    for every in (False, False, True):
        nodes = (small if members is None else members.select("node", "rep", "n", "sketch")).withColumn("label", F.col("rep"))
        if links:
            labels = connected_components(reduce(DataFrame.unionByName, links)).withColumnRenamed("node", "rep")
            nodes = nodes.drop("label").join(labels, "rep", "left").withColumn("label", F.coalesce("component", "rep"))
        found = crossing(nodes, percent / 100, every=every)
        if every:
            pairs = found.distinct()
        else:
            members = materialize(found)
            if pool is None:
                discard(*levels)
                pool = sets_of(docs, materialize(reps.select("rep", "doc_id", "digest").join(members.select("rep").distinct(), "rep", "left_semi")), k)
            best = members.where("other is not null").groupBy("rep").agg(F.min_by("other", F.struct("label_of_other", "other")).alias("other"))
            pairs = best.select(F.least("rep", "other").alias("a"), F.greatest("rep", "other").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        judged = confirmed(pairs, pool, percent)
        tested = judged.select("a", "b") if tested is None else tested.unionByName(judged.select("a", "b"))
        links.append(judged.where("linked").select("a", "b"))
    discard(pool, members)
    return reduce(DataFrame.unionByName, links)


def similar_classes(docs: DataFrame, shingle: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, n, digest, path, sketch) of all documents, and classes (digest, rows, comp, component_id, several), both stored tables.

    A class holds the rows with one shingle set. ``comp`` numbers its component, ``component_id`` is the smallest doc_id
    in it, ``several`` says whether the component has more rows than one.
    """
    if not 40 <= percent <= 100:
        raise ValueError("percent has to be 40 to 100")
    small_batches(docs.sparkSession)
    signed = materialize(signatures(docs, shingle, trees_for(percent / 100)))
    classes = signed.where("n > 0").groupBy("digest").agg(
        F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("rows"), F.first("n").alias("n"), F.first("path").alias("path"), F.first("sketch").alias("sketch")
    )
    reps = materialize(classes.withColumn("rep", F.monotonically_increasing_id()))
    joined = connected_components(confirmed_links(docs, reps, shingle, percent)).select(F.col("node").alias("rep"), F.col("component").alias("comp"))
    linked = materialize(reps.select("rep", "doc_id").join(joined, "rep"))
    names = materialize(linked.groupBy("comp").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("members")))
    named = join_to_groups(linked.select("rep", "comp"), names, "comp", "members").select("rep", "comp", "component_id")
    whole = reps.select("rep", "digest", "doc_id", "rows").join(named, "rep", "left").select(
        "digest", "rows", F.coalesce("comp", "rep").alias("comp"), F.coalesce("component_id", "doc_id").alias("component_id"), (F.col("comp").isNotNull() | (F.col("rows") > 1)).alias("several")
    )
    classes = materialize(whole)
    discard(reps, linked, names)
    return signed, classes


def near_duplicates(docs: DataFrame, *, shingle: int = 5, percent: int = 80) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept.

    Words are maximal runs without ASCII white space, A-Z lower-cased; a document's set holds its distinct runs of
    ``shingle`` words, with fewer words the whole sequence. Documents are linked if 100 times the intersection is at
    least ``percent`` times the union; component_id is the smallest doc_id reachable (null where no row of the component
    has one), and rows that have it as their own are kept. Null or blank texts have no shingles and stand alone. Rows
    are told apart by their sets: rows that repeat a doc_id, or have none, are linked by what each of them holds. Extra
    columns play no part; an empty table gives an empty result. ``percent`` is 40 to 100, as the trees that the wanted
    recall takes become too many below.

    Documents with equal sets are first merged to one representative, so copies cost one row.
    """
    rows, classes = similar_classes(docs, shingle, percent)
    met = join_to_groups(rows.where("n > 0"), classes.select("digest", "rows", "component_id"), "digest", "rows", sizes=classes, by=["doc_id"])
    alone = rows.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return (
        met.select("doc_id", "n", "component_id")
        .unionByName(alone)
        .select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
    )


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates of all documents by runs of two words: doc_id, n_shingles, component_id, kept."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=2, percent=80)


def drop_near_duplicates(docs: DataFrame, *, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, but of each component as in :func:`near_duplicates` only the row with the smallest doc_id.

    Of several with that doc_id the one with the smallest hash stays; null ids come last. Rows without words all stay.
    A Bloom filter of the ids in components of several rows lets most rows pass straight through; only the others are
    cut into shingles again and shuffled, after each task has kept one row of each set.
    """
    rows, classes = similar_classes(docs, shingle, percent)
    several = materialize(classes.where("several").select("digest", "comp"))
    known = bloom(several.select(F.xxhash64("digest").alias("h")))
    held = bloom(rows.where("n > 0").where(known.may_hold(F.xxhash64("digest"))).select(F.xxhash64("doc_id").alias("h")))
    discard(rows, classes)
    probe = held.prober()

    @F.pandas_udf("binary")
    def digest(h: pd.Series, text: pd.Series) -> pd.Series:
        """The digest of a text whose id is held, else null; one pass, so that a task has one Python worker only."""
        out = np.full(len(h), None, dtype=object)
        at = np.flatnonzero(probe(h.to_numpy().view(np.uint64)))
        for begun, run in batches(text.iloc[at].tolist()):
            with np.errstate(over="ignore"):
                out[at[begun : begun + len(run)]] = pd.Series(_digests(shingle_sets(run, shingle)), dtype=object).to_numpy()
        return pd.Series(out, dtype=object)

    marked = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), digest(F.xxhash64("doc_id"), "text").alias("digest"))
    first = F.min_by("row", F.struct(F.col("row.doc_id").isNull(), F.col("row.doc_id"), F.xxhash64("row"))).alias("row")
    met = marked.where("digest is not null").groupBy("digest").agg(first).join(several, "digest", "left")
    stay = [marked.where("digest is null"), met.where("comp is null"), met.where("comp is not null").groupBy("comp").agg(first)]
    return reduce(DataFrame.unionByName, [x.select("row.*") for x in stay])
