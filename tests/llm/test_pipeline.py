"""Each stage of the pipeline against a plain version of it, on its own input, as the pipeline hands it on."""

import collections
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
import fixtures as fx
from test_llm_operators import brute_components, lowered

import corpus_pipeline
from arborix.llm import near_dedup, packing
from arborix.llm.common import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows_of(df):
    return [tuple(r) for r in df.select(*COLUMNS).collect()]


@pytest.fixture(scope="module")
def stages(spark):
    """Rows before and after each stage."""
    base = fx.words(77, 200).split()
    near = [(200 + i, " ".join([*base[:90], f"n{i}", *base[91:]]), "en", f"s{i % 2}", 0) for i in range(4)]
    rows = fx.odd_rows() + near + [(300 + i, fx.words(300 + i, 30 + i), "en", f"s{i % 3}", 0) for i in range(40)]
    docs, out = spark.createDataFrame(rows, fx.SCHEMA), {}
    for name, stage in corpus_pipeline.STAGES:
        made = materialize(stage(spark, docs, ""))
        out[name] = (docs, made)
        docs = made
    return out


def test_language_stage_drops_texts_without_letters(stages):
    before, after = map(rows_of, stages["language_id"])
    assert collections.Counter(after) == collections.Counter(r for r in before if r[1] and any(c.isalpha() for c in r[1]))


def test_exact_stage_keeps_the_largest_id_of_equal_texts(stages):
    before, after = map(rows_of, stages["exact_dedup"])
    want = {}
    for doc_id, text, *_ in before:
        want[text] = max(want.get(text, -1), -1 if doc_id is None else doc_id)
    assert {r[1]: -1 if r[0] is None else r[0] for r in after} == want and len(after) == len(want)


def test_near_stage_keeps_one_of_each_component(stages):
    before, after = map(rows_of, stages["near_dedup"])
    keyed = [(i, *r[1:]) for i, r in enumerate(sorted(before, key=lambda r: (r[0] is None, r[0])))]
    label, sizes = brute_components(keyed, 5)
    ids = [r[0] for r in sorted(before, key=lambda r: (r[0] is None, r[0]))]
    assert collections.Counter(after) == collections.Counter((ids[r[0]], *r[1:]) for r in keyed if label[r[0]] == r[0] or not sizes[r[0]])
    assert sum(200 <= (r[0] or 0) < 204 for r in after) == 1


def test_mixing_stage_takes_words_of_its_documents_in_order(stages):
    before, after = map(rows_of, stages["mixing"])
    words = {(r[0], r[3]): lowered(r[1]) for r in before}
    times, size, taken = collections.Counter(), collections.Counter(), collections.Counter()
    for doc_id, text, _, source, n_chars in after:
        own, got = iter(words[doc_id, source]), lowered(text)
        assert got and all(w in own for w in got) and n_chars == len(text)
        times[doc_id] += 1
        taken[source] += len(got)
    for (_, source), w in words.items():
        size[source] += len(w)
    assert max(times.values()) <= 2
    total = sum(size.values())
    assert abs(sum(taken.values()) - 1.5 * total) <= 0.03 * total


def test_packing_stage_holds_every_token_once(stages):
    docs, pieces = stages["packing"]
    want = collections.Counter()
    for doc_id, text, *_ in rows_of(docs):
        want[doc_id] += len(packing.token_ids(text, packing.TOKENIZER))
    got, spots = collections.Counter(), collections.defaultdict(list)
    for p in pieces.collect():
        got[p["doc_id"]] += p["length"]
        spots[p["sequence_id"]].append((p["offset"], p["length"]))
    assert got == want
    for sequence in spots.values():
        at = 0
        for offset, length in sorted(sequence):
            assert offset == at
            at += length
        assert at <= 1024


def test_pipeline_of_no_documents(spark, tmp_path):
    fx.empty(spark).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_near_duplicates_of_odd_rows(spark):
    got = near_dedup.near_duplicates(fx.odd(spark)).collect()
    assert collections.Counter(r["doc_id"] for r in got) == collections.Counter(r[0] for r in fx.odd_rows())
    assert all(r["n_shingles"] == 0 and r["kept"] for r in got if r["doc_id"] in (0, 1, 2))


def test_trees_follow_the_recall_that_is_wanted():
    assert [near_dedup.trees_for(s) for s in (0.8, 1.0)] == [16, 1]
    for s in (0.5, 0.7, 0.9):
        n = near_dedup.trees_for(s)
        assert (1 - s**4) ** n <= near_dedup.MISSED < (1 - s**4) ** (n - 1)


def test_too_low_a_similarity_is_refused(spark):
    with pytest.raises(ValueError):
        near_dedup.near_duplicates(fx.empty(spark), percent=20)
