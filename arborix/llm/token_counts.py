"""Token counts of a unigram tokenizer without building its tokens: Aho-Corasick matches and a Viterbi pass that carries a count."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborix.llm.common import small_batches

VOCABULARY = "piece_bpe_32k.model"
SPACE = "▁"
#: How much worse than the worst piece an unknown character scores, as in the tokenizer.
UNKNOWN_PENALTY = 10.0
#: Words whose counts a worker remembers before it starts anew.
MEMORY = 400_000


def vocabulary(name: str = VOCABULARY) -> list[tuple[str, float]]:
    """Pieces and scores of a public vocabulary file, in the order of their ids."""
    import public_tokenizers as public
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public.path(name))
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class Counter:
    """Counts of the best segmentation into scored pieces.

    The best segmentation has the highest sum of scores; of equal ones the tokenizer keeps, at each position, the piece
    that starts first. A character that no piece covers alone may be unknown, and counts as its UTF-8 bytes.

    No piece has the space mark after another character, so segmentations of "mark word" stretches are independent and
    each distinct stretch is solved once; the same holds around characters that occur in no piece.
    """

    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in pieces) - UNKNOWN_PENALTY
        self.single = {p for p, _ in pieces if len(p) == 1}
        self.apart = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p, _ in pieces)
        self.line = self.apart and not any("\n" in p for p, _ in pieces)
        self.known: dict[str, int] = {}

    def solve(self, text: str) -> int:
        """Pieces in the best segmentation of ``text``."""
        n = len(text)
        best: list[float | None] = [0.0, *[None] * n]
        count = [0] * (n + 1)
        matches: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for end, match in self.automaton.iter(text):
            matches[end + 1].append(match)
        for end in range(1, n + 1):
            top, pieces = None, 0
            for length, score in sorted(matches[end], reverse=True) if len(matches[end]) > 1 else matches[end]:
                total = score + best[end - length]
                if top is None or total > top:
                    top, pieces = total, count[end - length] + 1
            last = text[end - 1]
            if last not in self.single:
                total = self.unknown + best[end - 1]
                if top is None or total > top:
                    top, pieces = total, count[end - 1] + len(last.encode("utf-8", "surrogatepass"))
            best[end], count[end] = top, pieces
        return count[n]

    def stretch(self, text: str) -> int:
        found = self.known.get(text)
        if found is None:
            found = self.solve(text)
            if len(self.known) >= MEMORY:
                self.known.clear()
            if len(text) <= 64:
                self.known[text] = found
        return found

    def count(self, text: str | None) -> int:
        """Tokens of a text, with spaces as marks and one mark before it; null and empty texts have none."""
        if not isinstance(text, str) or not text:
            return 0
        marked = text.replace(" ", SPACE)
        if not marked.startswith(SPACE):
            marked = SPACE + marked
        if not self.apart:
            return self.solve(marked)
        total = 0
        for i, line in enumerate(marked.split("\n") if self.line else [marked]):
            total += i > 0
            words = line.split(SPACE)
            if words[0]:
                total += self.stretch(words[0])
            rest = words[1:]
            if "" in rest:
                total += sum(map(self.stretch, re.findall(f"{SPACE}+[^{SPACE}]*", line)))
            else:
                total += sum([self.stretch(SPACE + w) for w in rest])
        return total


_counters: dict[str, Counter] = {}


def counter(name: str) -> Counter:
    """The counter of a vocabulary, one for each worker process."""
    if name not in _counters:
        _counters[name] = Counter(vocabulary(name))
    return _counters[name]


def token_counts(docs: DataFrame, *, vocabulary_file: str = VOCABULARY) -> DataFrame:
    """Per row: doc_id, n_tokens, n_bytes.

    ``n_tokens`` is what the unigram tokenizer with the pieces and scores of the file would give for the whole text, to
    the token. Null and empty texts have no tokens. Repeated rows give the same values again; extra columns play no
    part; an empty table gives an empty result. Nothing is shuffled.
    """

    small_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def count(text: pd.Series) -> pd.Series:
        return text.map(counter(vocabulary_file).count).astype("int64")

    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", count(text).alias("n_tokens"), F.octet_length(text).cast("long").alias("n_bytes"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents: doc_id, n_tokens, n_bytes."""
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
