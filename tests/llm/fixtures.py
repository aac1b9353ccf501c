"""Small tables with nulls, empty and long texts, ties, repeated rows and columns with clashing names."""

import itertools
import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(seed, n, prefix="w"):
    r = random.Random(seed)
    return " ".join(f"{prefix}{r.randrange(400)}" for _ in range(n))


def odd_rows():
    long = words(1, 6000)
    texts = [None, "", " \t\n ", "x", "one two", "one two", "123 !!", words(2, 40), words(2, 40), words(2, 39) + " end", long, long, "Ünïcode ☃ 漢字 " * 5, "a" * 3000]
    rows = [(i, t, None if i % 4 == 0 else "en", None if i % 5 == 0 else f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return rows + [(3, "x", "en", "s0", 1), (None, "no id", None, None, 5), (None, None, None, None, None)]


def odd(spark):
    """The odd rows, with extra columns named like those the operators use inside."""
    rows = [(*r, i, "z", 1.5) for i, r in enumerate(odd_rows())]
    return spark.createDataFrame(rows, SCHEMA + ", score long, kept string, n double")


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def speech(spark, n=240):
    """Documents in two invented languages, labelled toxic and of low quality by what they hold."""
    syllables = {"aa": ["the", "ing", "er", "and", "on"], "bb": ["lich", "keit", "sch", "der", "und"]}
    rows, labels = [], []
    for i in range(n):
        r = random.Random(i)
        lang = "aa" if i % 2 else "bb"
        body = ["".join(r.choices(syllables[lang], k=r.randint(1, 3))) for _ in range(60)]
        toxic, bad = i % 3 == 0, i % 4 == 0
        if toxic:
            for at in (10, 30, 50):
                body[at] = r.choice(["stupid", "idiot", "stup1d"])
        if bad:
            body = list(itertools.chain.from_iterable((w, w) for w in body[:40]))
        rows.append((i, " ".join(body), lang, "s", 0))
        labels.append((i, int(not bad), int(toxic)))
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
