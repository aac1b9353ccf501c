import collections
import hashlib
import itertools
import math
import re
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import fixtures as fx

from arborix.llm import common, exact_dedup, labelled, kneser_ney, language, media, mixing, near_dedup, packing, quality, token_counts, toxicity
from arborix.llm.common import bloom
from arborix.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = {i: i + 32 for i in range(65, 91)}


def lowered(text):
    return WORD.findall((text or "").translate(UPPER))


def fold(doc_id, n):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % n


NO_LABELS = "doc_id long, quality int, toxic int"
ALL = {
    "toxicity": lambda s, d: toxicity.toxicity(d, s.createDataFrame([], NO_LABELS)),
    "media": lambda s, d: media.media_columns(d),
    "packing": lambda s, d: packing.packed(d),
    "language": lambda s, d: language.language_id(d),
    "lm": lambda s, d: kneser_ney.lm_scores(d),
    "exact": lambda s, d: exact_dedup.exact_duplicates(d),
    "near": lambda s, d: near_dedup.near_duplicates(d),
    "mixing": lambda s, d: mixing.mixed(d),
    "tokens": lambda s, d: token_counts.token_counts(d),
    "quality": lambda s, d: quality.quality(d, s.createDataFrame([], NO_LABELS)),
}


@pytest.mark.parametrize("name", list(ALL))
def test_empty_table(spark, name):
    assert ALL[name](spark, fx.empty(spark)).collect() == []


@pytest.mark.parametrize("name", [n for n in ALL if n not in ("packing", "near")])
def test_odd_rows_give_a_row_each(spark, name):
    rows = ALL[name](spark, fx.odd(spark)).collect()
    assert collections.Counter(r["doc_id"] for r in rows) == collections.Counter(r[0] for r in fx.odd_rows())
    if name in ("toxicity", "quality", "language"):
        assert all(0 <= r["score"] <= 1 for r in rows)


def test_filters_keep_columns(spark):
    docs = fx.odd(spark)
    for f in (exact_dedup.drop_exact_duplicates, near_dedup.drop_near_duplicates, language.drop_undetermined, mixing.mixed_documents):
        assert f(docs).columns == docs.columns and f(fx.empty(spark)).collect() == []


@pytest.mark.parametrize("broadcast_bits", [1 << 28, 1 << 10])
def test_bloom_misses_nothing_and_lets_little_else_through(spark, broadcast_bits):
    """Also where the filter is larger than what may be broadcast: it then lies in files and holds as many bits a row."""
    hashed = spark.range(200_000).select(F.xxhash64(F.col("id") % 150_000).alias("h"))
    repeated = bloom(hashed, at_least=2, broadcast_bits=broadcast_bits)
    rows = spark.range(150_000).select("id", repeated.may_hold(F.xxhash64("id")).alias("m")).where("m").collect()
    assert sum(r["id"] < 50_000 for r in rows) == 50_000 and len(rows) < 58_000


def test_hot_groups_are_dealt_into_pieces(spark, monkeypatch):
    monkeypatch.setattr(common, "PIECES", 8)
    rows = spark.createDataFrame([(i, "hot" if i % 3 == 0 else None if i % 50 == 0 else f"k{i % 40}") for i in range(900)], "id long, key string")
    groups = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top"))
    want = rows.join(groups, "key").select("id", "key", "n", "top")
    got = common.join_to_groups(rows, groups, "key", "n").select("id", "key", "n", "top")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 800


def test_scratch_needs_a_shared_folder_on_a_cluster():
    class Cluster:
        class conf:
            get = staticmethod(lambda key, default=None: None)

        class sparkContext:
            master = "local-cluster[2,1,1024]"

    with pytest.raises(ValueError):
        common.scratch_dir(Cluster)


def test_exact_duplicates(spark):
    want = collections.defaultdict(list)
    for doc_id, text, *_ in fx.odd_rows():
        want[hashlib.sha256((text or "").encode()).hexdigest()].append(doc_id)
    for r in exact_dedup.exact_duplicates(fx.odd(spark)).collect():
        group = want[r["text_sha256"]]
        top = max((i for i in group if i is not None), default=None)
        assert (r["keep_id"], r["group_size"], r["kept"]) == (top, len(group), r["doc_id"] == top)
    kept = exact_dedup.drop_exact_duplicates(fx.odd(spark)).collect()
    assert len(kept) == len(want)


def brute_components(rows, k):
    sets = {}
    for doc_id, text, *_ in rows:
        w = lowered(text)
        sets[doc_id] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if label[b] < label[a] and sets[a] and sets[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    label[a], changed = label[b], True
    return label, {i: len(s) for i, s in sets.items()}


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_like_all_pairs(spark, k):
    rows = [(i, t, "en", "s", 0) for i, t in enumerate([None, "", "x", "x", "A b", "a B", fx.words(9, 3000)])]
    for group in range(12):
        base = fx.words(100 + group, 120).split()
        for copy in range(5):
            cut = base.copy()
            for at in range(0, copy * (k + 1), k):
                cut[(at * 37 + group) % 120] = f"new{copy}"
            rows.append((len(rows), " ".join(cut), "en", "s", 0))
    want, sizes = brute_components(rows, k)
    got = {r["doc_id"]: r for r in near_dedup.near_duplicates(spark.createDataFrame(rows, fx.SCHEMA), shingle=k).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert {i: r["n_shingles"] for i, r in got.items()} == sizes


def test_large_groups_are_dealt_out_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 600)
    monkeypatch.setattr(near_dedup, "NODE", 4)
    base = fx.words(5, 100).split()
    rows = [(i, " ".join([*base[: i % 100], f"own{i}", *base[i % 100 + 1 :]]), "en", "s", 0) for i in range(60)]
    want, _ = brute_components(rows, 2)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, fx.SCHEMA), shingle=2).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def test_packing_round_trip(spark):
    rows = fx.odd_rows()
    from public_tokenizers import path
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path("byte_bpe_50k.json"))
    rows = [*rows, (50, "a <|endoftext|> b<|endoftext|>", "en", "s0", 0), (51, "<|endoftext|>", "en", "s0", 0)]
    assert tokenizer.encode(rows[-2][1], add_special_tokens=False).ids == [64, 220, 50256, 275, 50256]
    wanted = collections.Counter()
    for doc_id, text, *_ in rows:
        wanted[doc_id, tuple(tokenizer.encode(text or "", add_special_tokens=False).ids + [0])] += 1
    pieces = packing.packed(spark.createDataFrame(rows, fx.SCHEMA)).collect()
    ids = {d: list(t) for (d, t) in wanted}
    for (doc_id, tokens), n in wanted.items():
        own = [p for p in pieces if p["doc_id"] == doc_id and p["doc_tokens"] == len(tokens)]
        if doc_id is not None:
            assert sum(p["length"] for p in own) == n * len(tokens)
            assert all(p["crc"] == zlib.crc32(np.array(tokens[p["start"] : p["start"] + p["length"]], "<u4").tobytes()) for p in own)
    assert ids
    by = collections.defaultdict(list)
    for p in pieces:
        by[p["sequence_id"]].append((p["offset"], p["length"]))
    for spots in by.values():
        at = 0
        for offset, length in sorted(spots):
            assert offset == at
            at += length
        assert at == 1024 or at & (at - 1) == 0 and at < 1024


def test_counts_never_use_more_than_there_is():
    r = np.random.default_rng(0)
    histogram = np.concatenate(([0], r.integers(0, 50, 64)))
    plan = packing.Plan(histogram, 64)
    assert (plan.used <= histogram).all() and (plan.used * np.arange(65)).sum() == plan.packed * 64
    pairs = sum(min(histogram[a], histogram[64 - a]) for a in range(1, 32)) + histogram[32] // 2 + histogram[64]
    assert plan.packed >= pairs  # combinations of three fill windows that exact pairs cannot


def test_mixture_meets_targets(spark):
    rows = [(i, fx.words(i, 1 + i % 90), "en", None if i % 7 == 0 else f"s{i % 4}", 0) for i in range(900)]
    docs = spark.createDataFrame(rows, fx.SCHEMA)
    got = mixing.mixed(docs).collect()
    size, taken, target = collections.Counter(), collections.Counter(), {}
    source = {r[0]: r[3] for r in rows}
    for r in got:
        s = source[r["doc_id"]]
        assert r["size"] == len(lowered(rows[r["doc_id"]][1])) and r["taken"] <= 2 * r["size"]
        size[s] += r["size"]
        taken[s] += r["taken"]
        target[s] = r["target"]
    assert math.isclose(sum(target.values()), 1.5 * sum(size.values()))
    assert all(abs(taken[s] - target[s]) <= 0.02 * target[s] for s in target)
    again = mixing.mixed(docs.repartition(3)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    whole = mixing.mixed_documents(docs).groupBy("source").agg(F.sum(mixing.word_count("text")).alias("n")).collect()
    assert {r["source"]: r["n"] for r in whole} == dict(taken)


def test_targets_are_capped_and_reshared():
    assert mixing.targets([100, 100, 100]) == pytest.approx([200.0, 450 - 200 - 250 / 3, 250 / 3])
    assert mixing.targets([]) == [] and mixing.targets([0, 10]) == [0.0, 15.0]


def test_permutation():
    n = np.full(97, 97)
    assert sorted(mixing.permuted(np.arange(97), n, np.full(97, 5, np.uint64)).tolist()) == list(range(97))


def test_language_and_labels(spark):
    docs, labels = fx.speech(spark)
    by = {r["doc_id"]: r for r in docs.collect()}
    got = language.language_id(docs).collect()
    assert all(r["lang_pred"] == by[r["doc_id"]]["lang"] and r["held_out"] == (fold(r["doc_id"], 3) == 1) for r in got)
    none = language.language_id(fx.odd(spark)).where("doc_id in (0, 1, 2, 6)").collect()
    assert {r["lang_pred"] for r in none} == {"und"}
    y = {r["doc_id"]: r for r in labels.collect()}
    for name, rows, cut in (("toxic", toxicity.toxicity(docs, labels), 0.5), ("quality", quality.quality(docs, labels), 0.3)):
        held = [r for r in rows.collect() if r["held_out"]]
        assert len(held) > 20 and all(r["predicted"] == int(r["score"] >= cut) and fold(r["doc_id"], 5) == 0 for r in held)
        assert sum(r["predicted"] == y[r["doc_id"]][name] for r in held) >= 0.9 * len(held)


def test_kneser_ney_like_a_plain_version(spark):
    rows = [(i, t, "en", "s", 0) for i, t in enumerate([None, "", "A b a", *[fx.words(i, 80, "v") for i in range(40)]])]
    texts = {i: [*lowered(t), None] for i, t, *_ in rows}
    train = [t for i, t in texts.items() if fold(i, 5) != 1]
    one = collections.Counter(w for t in train for w in t)
    two = collections.Counter(p for t in train for p in zip(["<s>", *t[:-1]], t, strict=True))
    before, follow, total = collections.Counter(w for _, w in two), collections.defaultdict(collections.Counter), collections.Counter()
    for (h, _), c in two.items():
        follow[h][min(c, 3)] += 1
        total[h] += c
    d2 = kneser_ney.discounts(np.array([sum(c == k for c in two.values()) for k in range(1, 5)]))
    d1 = kneser_ney.discounts(np.array([sum(c == k for c in before.values()) for k in range(1, 5)]))
    left = sum(d1[min(c, 3)] for c in before.values()) / len(two)
    n, v = sum(one.values()), len(one)

    def p(h, w):
        lower = max(before[w] - d1[min(before[w], 3)], 0) / len(two) + left / (v + 1)
        if not total[h]:
            return lower
        return max(two[h, w] - d2[min(two[h, w], 3)], 0) / total[h] + sum(d2[k] * m for k, m in follow[h].items()) / total[h] * lower

    assert math.isclose(sum(p("<s>", w) for w in [*one, "unknown"]), 1)
    for r in kneser_ney.lm_scores(spark.createDataFrame(rows, fx.SCHEMA)).collect():
        t = texts[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(t), sum(one[w] > 0 for w in t), n)
        assert math.isclose(r["base_score"], sum(math.log10((one[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), rel_tol=1e-9)
        assert math.isclose(r["score"], sum(math.log10(p(h, w)) for h, w in zip(["<s>", *t[:-1]], t, strict=True)), rel_tol=1e-9)


def test_media_round_trip(spark):
    text = {}
    for doc_id, t, *_ in fx.odd_rows():
        text.setdefault(doc_id, []).append((t or "").encode())
    rows = media.media_columns(fx.odd(spark)).collect()
    for r in rows:
        own = [b for b in text[r["doc_id"]] if len(b) == r["n_bytes"]][0]
        payload = own.ljust(max(1, -(-len(own) // 192)) * 192)
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert media.decode(media.encode(payload)) == payload and r["width"] == 192 and r["height"] * 192 == len(payload)
    assert len({(r["shard"], r["offset"]) for r in rows}) == len({r["payload_sha256"] for r in rows})


def test_token_counts_like_the_tokenizer(spark):
    from tokenizers import Tokenizer, models, pre_tokenizers

    tokenizer = Tokenizer(models.Unigram(token_counts.vocabulary(), 0, True))
    tokenizer.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always", split=False)
    texts = [r[1] for r in fx.odd_rows()] + ["  a  b", "\n\nx ", "<s> </s> <0x0A>", "▁▁x▁", " " * 40]
    got = token_counts.token_counts(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")).collect()
    assert [r["n_tokens"] for r in sorted(got)] == [len(tokenizer.encode(t or "", add_special_tokens=False).ids) for t in texts]


def test_ids_over_sixteen_bits_are_kept(spark, monkeypatch):
    monkeypatch.setattr(packing, "token_ids", lambda text, name, end=0: np.array([70_000, 1 << 20, end], dtype="<u4"))
    cut = packing.pieces(spark.createDataFrame([(1, "x")], "doc_id long, text string")).collect()
    assert np.frombuffer(cut[0]["ids"], "<u4").tolist() == [70_000, 1 << 20, 0]


def test_toxicity_scores_like_a_plain_version():
    """A word's features are averaged, a text pools its words by log-sum-exp; ties of words and long texts included."""
    model = toxicity.Model(np.random.default_rng(3).normal(0, 3, 1 << toxicity.BITS), 0.1, 0.25)
    with np.errstate(over="ignore"):

        def logit(word):
            _, _, cells, _ = toxicity.features([word.encode()])
            return toxicity.GAIN * model.cell[cells].mean() + model.bias

        texts = ["word0", "word1 word1 Word1", " ".join(f"word{i % 17}" for i in range(9000)), "", " \n "]
        got = model.score([t.encode() for t in texts])
        for text, score in zip(texts, got, strict=True):
            words = lowered(text)
            want = 1 / (1 + math.exp(-min(40.0, np.log(sum(np.exp([logit(w) for w in words])))))) if words else 0.25
            assert score == pytest.approx(want, abs=1e-9)


def test_quality_votes_like_a_plain_version():
    """Exact cosines; all neighbours as near as the last one vote, so equal vectors in any order give equal scores."""
    texts = [fx.words(i % 30, 40).encode() for i in range(120)]
    y = np.arange(120) % 3 // 2
    model = quality.fit(texts, y)
    asked = [fx.words(500 + i, 30).encode() for i in range(6)] + texts[:3]
    got = model.score(asked)
    for q, score in zip(model.embed(asked), got, strict=True):
        near = np.array([float(q @ v) for v in model.vectors])
        least = np.sort(near)[-quality.NEIGHBOURS]
        votes = [(max(x, 1e-6) ** quality.POWER, label) for x, label in zip(near, model.labels, strict=True) if x >= least - 1e-6]
        assert len(votes) >= quality.NEIGHBOURS
        assert score == pytest.approx(sum(w * label for w, label in votes) / sum(w for w, _ in votes), abs=1e-4)
    turned = np.random.default_rng(1).permutation(120)
    other = quality.Neighbours(model.idf, model.axes, model.vectors[turned], model.labels[turned], model.prior)
    assert other.score(asked) == pytest.approx(got, abs=1e-6)


def test_language_like_a_plain_version(spark):
    """Posteriors of multinomial naive Bayes with the same cells, half a count added; equal posteriors take the first language."""
    docs, _ = fx.speech(spark, 40)
    extra = spark.createDataFrame([(1000, "der the der", "aa", "s", 0), (1001, "qqq", None, "s", 0)], fx.SCHEMA)
    rows = docs.unionByName(extra).collect()

    def cells(text):
        (_, h, at, _), = language.grams([text])
        return h[:, at[0] - 1 : at[1] - 2].ravel()

    counts = {}
    for r in rows:
        if r["lang"] is not None and fold(r["doc_id"], 3) != 1:
            counts.setdefault(r["lang"], np.full(1 << language.BITS, 0.5))
            np.add.at(counts[r["lang"]], cells(r["text"]), 1)
    names = sorted(counts)
    for r in language.language_id(docs.unionByName(extra)).collect():
        text = next(x["text"] for x in rows if x["doc_id"] == r["doc_id"])
        at = cells(text)
        total = np.array([np.log((counts[n] / counts[n].sum()).astype(np.float64))[at].sum() for n in names])
        p = np.exp(total - total.max())
        p /= p.sum()
        assert r["lang_pred"] == names[int(p.argmax())] and r["score"] == pytest.approx(p.max(), abs=1e-3)


def test_labelled_sample_fills_its_quota_from_rows_that_remain(spark):
    docs = spark.createDataFrame([(i, "x" * (60_000 if i % 2 else 10 + i)) for i in range(60)] + [(4, "twice"), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 3 // 2) for i in range(80)] + [(0, 1), (None, 1), (2, None)], "doc_id long, quality int")
    rows = labelled.labelled_sample(docs, labels, "quality", {1: 4, 0: 6})
    assert rows["y"].value_counts().to_dict() == {0: 6, 1: 4} and (rows["text"].str.len() <= labelled.LONGEST).all()
    assert all(fold(i, 5) != 0 for i in rows["doc_id"])
    both = labelled.labelled_sample(docs, labels, "quality", {1: 100, 0: 100}, longest=100_000)
    assert sorted(both["doc_id"]) == [i for i in range(60) if fold(i, 5) != 0]


def test_mixture_with_a_fractional_cap_and_clashing_columns(spark):
    rows = [(i, fx.words(i, 5 + i % 90), "en", f"s{i % 3}" if i < 890 else "tiny", 0) for i in range(900)] + [(9000, "one two three", "en", "word", 0)]
    docs = spark.createDataFrame(rows, fx.SCHEMA)
    size, taken = collections.Counter(), collections.Counter()
    for r in mixing.mixed(docs, cap=1.5).collect():
        source = "word" if r["doc_id"] == 9000 else rows[r["doc_id"]][3]
        size[source] += r["size"]
        taken[source] += r["taken"]
        assert r["taken"] <= 2 * r["size"]
    assert {s: taken[s] for s in size} == {s: math.floor(1.5 * size[s]) for s in size}  # 150 % of all words, so every source at its cap
    named = ["_row", "_tie", "_src", "_size", "_before", "_runs", "_doc", "block", "words", "at"]
    odd = docs.select("*", *[F.lit(c).alias(c) for c in named])
    made = mixing.mixed_documents(odd)
    assert made.columns == odd.columns
    assert {tuple(r) for r in made.select(*named).distinct().collect()} == {tuple(named)}
    with pytest.raises(ValueError, match="sources"):
        mixing.mixed(docs, limit=2)


def plain_mix(catalogue, seed=11):
    """Words taken of each block, one slot after the other."""
    total = int(catalogue.slots.sum())
    share, drawn = catalogue.slots / total, np.zeros(len(catalogue.slots), dtype=int)
    for shard in range(-(-total // mixing.SHARD)):
        drawn += np.random.default_rng([seed, shard]).multinomial(min(mixing.SHARD, total - shard * mixing.SHARD), share)
    assert drawn.sum() == total
    out = collections.Counter()
    for src, slots in enumerate(catalogue.slots.tolist()):
        full, tail, blocks = (int(x[src]) for x in (catalogue.full, catalogue.tail, catalogue.blocks))
        for q in range(slots):
            epoch, at = divmod(q, blocks)
            with np.errstate(over="ignore"):
                key = common.mix64(np.array([seed], np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(src) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(epoch))
            block = int(mixing.permuted(np.array([at]), np.array([full]), key)[0]) if at < full else full
            whole = mixing.BLOCK if at < full else tail
            out[src, block] += int(catalogue.part[src]) if q == slots - 1 and catalogue.part[src] else whole
    return out


def test_mixture_like_a_plain_draw(spark):
    rows = [(i, fx.words(i, 20 + i % 70), "en", f"s{i % 3}", 0) for i in range(400)]
    docs = spark.createDataFrame(rows, fx.SCHEMA)
    _, spots, catalogue = mixing.placed(docs, weights=mixing.WEIGHTS, share=1.5, cap=2.0, limit=10, text=False)
    slots = mixing.drawn_slots(spark, catalogue, 11).collect()
    got = collections.Counter()
    for r in slots:
        got[r["src"], r["block"]] += r["words"]
    assert got == plain_mix(catalogue)
    assert [sum(n for (s, _), n in got.items() if s == i) for i in range(3)] == np.round(catalogue.target).astype(int).tolist()


def test_near_duplicates_with_repeated_and_missing_ids(spark):
    a, b = fx.words(1, 60).split(), fx.words(2, 60).split()
    near = lambda w, n: " ".join([*w[:-1], f"end{n}"])
    rows = [(1, near(a, 0)), (1, near(b, 0)), (2, near(a, 1)), (3, near(b, 1)), (None, near(b, 2)), (None, "all alone here"), (7, near(a, 0)), (8, None)]
    want = [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (None, 1, False), (None, None, True), (7, 1, False), (8, 8, True)]
    key = lambda r: tuple((x is None, x) for x in r)
    for order in (rows, rows[::-1], rows[3:] + rows[:3]):
        docs = spark.createDataFrame(order, "doc_id long, text string")
        got = [(r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(docs, shingle=2).collect()]
        # sets A and B are not similar: what doc_id 1 names is the smallest id in both components
        assert sorted(got, key=key) == sorted(want, key=key)
        stay = near_dedup.drop_near_duplicates(docs, shingle=2).collect()
        assert sorted((r["doc_id"] is None, r["doc_id"]) for r in stay) == [(False, 1), (False, 1), (False, 8), (True, None)]


def test_near_duplicates_of_the_given_documents(spark):
    """Recall and precision on every row of sf0.01 against all pairs that share a shingle."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    sets, holders = {}, collections.defaultdict(list)
    for r in rows:
        w = lowered(r["text"])
        sets[r["doc_id"]] = {tuple(w[i : i + 2]) for i in range(len(w) - 1)} if len(w) > 1 else {tuple(w)} if w else set()
        for x in sets[r["doc_id"]]:
            holders[x].append(r["doc_id"])
    both = collections.Counter()
    for ids in holders.values():
        both.update(itertools.combinations(sorted(set(ids)), 2))
    label = {i: i for i in sets}

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    links = [(a, b) for (a, b), n in both.items() if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n)]
    for a, b in links:
        x, y = sorted((top(a), top(b)))
        label[y] = x
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.op7_near_dedup(spark, "/root/testdata/sf0.01").collect()}
    assert len(links) > 50 and sum(got[a] == got[b] for a, b in links) >= 0.99 * len(links)
    assert all(top(i) == top(c) for i, c in got.items())
