"""Hard negatives, conversation repair and secrets against plain versions."""

import collections
import functools
import hashlib
import heapq
import itertools
import math
import random
import re
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import fixtures as fx

from arborix.llm import conversation_repair, hard_negatives, secrets

# ---------------------------------------------------------------- hard negatives

VECTORS = "vec_id long, embedding array<float>, label int, row string, vector int, place double"


def vector_rows():
    r = random.Random(5)
    rows = [(i, [r.uniform(-1, 1) if i % 9 else float(r.randrange(-2, 3)) / 4 for _ in range(6)], r.randrange(4)) for i in range(260)]
    rows += [(i, [0.5] * 6, 1) for i in range(300, 400)]  # one common vector
    rows += [(50, [0.25] * 6, 2), (50, [0.25] * 6, 2), (None, [0.5] * 6, 1), (None, [0.5] * 6, 3), (450, [], 1), (500, [0.5, 0.5], 1)]
    rows += [(550, None, 1), (600, [0.1] * 6, None), (650, [0.1, None], 1), (700, [float("nan")] * 6, 1), (750, [float("inf"), 0.1], 1), (800, [300.0, -5000.0, 1e6, 0.1, 0.2, 0.3], 2)]
    return rows


def plain_negatives(rows):
    use = []
    for vec_id, x, label in rows:
        if label is None or x is None or any(v is None or not math.isfinite(v) for v in x):
            continue
        label = (label + 1) % 10 if vec_id is not None and vec_id % 7 == 0 else label
        use.append((vec_id, [math.floor(256 * float(np.float32(v))) for v in x], label))
    last = lambda v: (v is None, v or 0)
    out = []
    for a, (anchor, x, own) in enumerate(use):
        if anchor is None or anchor % 50:
            continue
        scored = sorted(((-sum(p * q for p, q in zip(x, y)), last(i), b, i, c) for b, (i, y, c) in enumerate(use) if b != a))
        for p in [s for s in scored if s[4] == own][:5]:
            near = [s for s in scored if s[4] != own and 50 * -p[0] <= 100 * -s[0] <= 95 * -p[0]][:3]
            out += [(anchor, p[3], k + 1, s[3], -p[0], -s[0]) for k, s in enumerate(near)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("tiles", [{}, {"tile_rows": 40, "tile_anchors": 3}])
def test_hard_negatives_equal_a_plain_search(spark, tiles):
    """Negative and large components, ties, repeated rows, rows without an id, unequal lengths; in one tile and in many."""
    rows = vector_rows()
    df = spark.createDataFrame([(*r, "x", i, 0.5) for i, r in enumerate(rows)], VECTORS)
    got = hard_negatives.hard_negatives(df, **tiles)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_negatives(rows)
    assert len(plain_negatives(rows)) > 20


def test_hard_negatives_of_nothing(spark):
    assert hard_negatives.hard_negatives(spark.createDataFrame([], VECTORS)).collect() == []
    assert hard_negatives.hard_negatives(spark.createDataFrame([(1, [0.5], 1, "x", 1, 1.0)], VECTORS)).collect() == []


@pytest.mark.parametrize("size,width", [(1, 3), (300, 70), (2**20, 2500), (2**31, 40)])
def test_residue_products_are_exact(size, width):
    r = np.random.default_rng(size)
    a, b = (r.integers(-size, size + 1, (4, width)) for _ in range(2))
    a[0], b[0] = size, -size
    primes = hard_negatives.moduli(size * size * width)
    got = hard_negatives.products(hard_negatives.residues(a, primes), hard_negatives.residues(b, primes), primes)
    want = a.astype(object) @ b.T.astype(object)
    assert [[int(x) for x in row] for row in got] == [[(int(x) + 2**63) % 2**64 - 2**63 for x in row] for row in want]


# ---------------------------------------------------------------- conversations


def cheapest(turns):
    """Uniform-cost search over edits: all cheapest ways, the least audit, and the repaired turns. ``turns``: (role, text, fault)."""
    best = {}

    def after(last, initial):
        return (initial == "u" and last in ("", "s", "a")) or (initial == "a" and last == "u") or (initial == "s" and last == "")

    heap = [(0, "", 0, "", ())]
    while heap:
        price, audit, at, last, made = heapq.heappop(heap)
        if best.get((at, last), (price, audit)) < (price, audit):
            continue
        if at == len(turns) and last in ("", "a"):
            return price, audit, "\n".join(made)
        steps = [(3, "I", at, r, f"{r}:") for r in ("user", "assistant")]
        if at < len(turns):
            role, text, fault = turns[at]
            steps.append((4, "D", at + 1, None, None))
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                steps += [(more, "K", at + 1, role, f"{role}:{text}"), *((3 + more, "R", at + 1, r, f"{r}:{text}") for r in ("user", "assistant"))]
        for add, edit, to, role, line in steps:
            if role is not None and not after(last, role[:1]):
                continue
            now = (price + add, audit + edit, to, last if role is None else role[:1], made if line is None else (*made, line))
            if now[:2] < best.get((to, now[3]), (1 << 30, "")):
                best[to, now[3]] = now[:2]
                heapq.heappush(heap, now)


def plain_repair(rows, harm):
    word = re.compile(r"[^\x20\x09-\x0D]")
    out = {c: [] for c, *_ in rows}
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        rest = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20 if harm else 99
        if rest:
            text = "" if rest == 1 else re.sub("[.!?]", "", text) if rest == 2 else text
            out[c] += [(t is not None, t or 0, "user" if rest == 4 else role, text)] * (2 if rest == 3 else 1)
    done = []
    for c, turns in out.items():
        turns.sort()
        judged, seen = [], set()
        for _, _, role, text in turns:
            shown = word.findall(text)
            fault = "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else ""
            seen.add((role, text))
            judged.append((role, text, fault))
        numbers = [t for known, t, _, _ in turns if known]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        faults = [f for _, _, f in judged]
        pairs = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(judged, judged[1:]))
        price, audit, whole = cheapest(judged)
        done.append((c, gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], pairs, price, audit, hashlib.sha256(whole.encode()).hexdigest()))
    return sorted(done, key=repr)


def talk():
    r = random.Random(8)
    texts = ["yes.", "no!", "well", "what?  ", "", " \t", None, "a. b", "été…", "ok." * 50]
    roles = ["system", "user", "assistant", "tool", None, "", "user", "assistant"]
    rows = [(c, r.choice([None, *range(n + 2)]), r.choice(roles), r.choice(texts)) for c in range(60) for n in [r.randrange(1, 12)] for _ in range(n)]
    rows += [(100, t, ("user", "assistant")[t % 2] if r.random() < 0.8 else r.choice(roles), f"turn {t}." if r.random() < 0.8 else r.choice(texts)) for t in range(300)]  # long
    rows += [(None, t, "user", "hello.") for t in range(3)] + [(7, None, None, None)] * 2 + [(101, 1, "user", "long. " * 200_000)]
    return rows


@pytest.mark.parametrize("harm", [True, False])
def test_repair_equals_a_plain_search(spark, harm):
    rows = talk()
    df = spark.createDataFrame([(*x, "k", 5) for x in rows], "conv_id long, turn long, role string, text string, key string, at int")
    got = sorted((tuple(r) for r in conversation_repair.repaired(df, harm=harm).collect()), key=repr)
    assert got == plain_repair(rows, harm)


def test_repair_of_nothing(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversation_repair.repaired(df).collect() == []
    gone = next(c for c in itertools.count() if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    row = conversation_repair.repaired(spark.createDataFrame([(gone, 1, "user", "x.")], df.schema)).first()
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_any_bracketing_gives_the_same_cell():
    r = random.Random(3)
    for _ in range(60):
        leaves = [conversation_repair.turn_cell(r.choice("suao"), r.choice(["", "", "blank", "truncated"])) for _ in range(7)]
        k = r.randrange(1, 7)
        assert conversation_repair.parse(leaves) == conversation_repair.parse([conversation_repair.parse(leaves[:k]), conversation_repair.parse(leaves[k:])])


# ---------------------------------------------------------------- secrets


@functools.cache
def turning(k):
    """Share of three signs that cross the middle twice."""
    high = [v > (k - 1) / 2 for v in range(k)]
    return sum(a != b and b != c for a in high for b in high for c in high) / k**3


def plain_tests(run, counts):
    """Encoding, p of randomness and p of ordinary spread, from the definitions."""
    bare = run.rstrip("=")
    name = next(k for k, v in secrets.ENCODINGS.items() if set(bare) <= set(v))
    alphabet = secrets.ENCODINGS[name]
    n, k = len(bare), len(alphabet)
    total = sum(counts[c] + 1 for c in alphabet)
    q = [(counts[c] + 1) / total for c in alphabet]
    values = [alphabet.index(c) for c in bare]
    coincident = sum(x * x for x in collections.Counter(values).values()) - n
    z1 = (coincident - n * (n - 1) / k) / math.sqrt(2 * n * (n - 1) / k * (1 - 1 / k))
    high = [v > (k - 1) / 2 for v in values]
    p = sum((a > (k - 1) / 2) != (b > (k - 1) / 2) for a in range(k) for b in range(k)) / k**2
    both = turning(k)
    z2 = (sum(a != b for a, b in zip(high, high[1:])) - (n - 1) * p) / math.sqrt((n - 1) * p * (1 - p) + 2 * (n - 2) * (both - p * p))
    centred = [v - (k - 1) / 2 for v in values]
    z3 = sum(a * b for a, b in zip(centred, centred[1:])) / ((k * k - 1) / 12) / math.sqrt(n - 1)
    x = max(z1, 0) ** 2 + z2**2 + z3**2
    s2, s3 = sum(v**2 for v in q), sum(v**3 for v in q)
    spread = 4 * n * (n - 1) * (n - 2) * (s3 - s2 * s2) + 2 * n * (n - 1) * (s2 - s2 * s2)
    z4 = (coincident - n * (n - 1) * s2) / math.sqrt(spread)
    return name, n, math.erfc(math.sqrt(x / 2)) + math.sqrt(2 * x / math.pi) * math.exp(-x / 2), math.erfc(-z4 / math.sqrt(2)) / 2


def plain_secrets(texts):
    texts = ["" if t is None else t for t in texts]
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    counts = {c: sum(t.count(c) for t in texts) for c in secrets.SIGNS}
    found, runs = [], []
    for i, t in enumerate(texts):
        own = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 6]
        own += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        own += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        found.append(own)
        runs += [(i, m.start(), m.end(), *plain_tests(m[0], counts)) for m in re.finditer("[A-Za-z0-9+/_-]{16,}={0,2}", t)]
    base = [hashlib.sha256(",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(x)).encode()).hexdigest() for x in found]
    for size in {int(math.log2(r[4])) for r in runs}:
        own = [r for r in runs if int(math.log2(r[4])) == size]
        steps = [min(math.floor(-20 * math.log10(max(r[6], 1e-300))), 6000) for r in own]
        fit = [s for s in steps if len(own) * 10 ** (-s / 20) <= 0.01 * sum(x >= s for x in steps)]
        for r, s in zip(own, steps):
            if fit and s >= min(fit) and r[5] >= 0.001:
                found[r[0]].append((r[1], 3, r[2]))
    return [(*[sum(k == x for _, k, _ in f) for x in range(4)], b, ",".join(f"{secrets.KINDS[k]}:{a}:{e}" for a, k, e in sorted(f))) for f, b in zip(found, base)]


def keys_and_prose():
    r = random.Random(11)
    word = lambda: "".join(r.choices("etaoinshrdlu", weights=[12, 9, 8, 7, 7, 6, 6, 6, 6, 4, 4, 3], k=r.randint(2, 20)))
    texts = []
    for i in range(120):
        body = [word() for _ in range(60)]
        if i % 3 == 0:
            key = "".join(r.choices(secrets.ENCODINGS[r.choice(["hex", "HEX", "base32", "base62", "base64"])], k=r.choice([20, 40, 64])))
            body.insert(r.randrange(60), r.choice(["token = '{}'", "{}", "Secret:{}", "😀 {} é", "PASSWORD=abc {}", "api-key={}", "AKIA{}", "token: token: {}"]).format(key))
        texts.append(" ".join(body))
    texts += ["token=token=abcdef", "secret: token: abcdef", "AKIA" + "A1" * 9, "f" * 24 + "g" + "0" * 30, "api_key=\"x\" apikey: 'abcdef.g='", "password" * 3000 + "= 123456", "ſecret=abcdefg"]
    texts += ["0123456789abcdef" * 20_000 + " token=" + "é" + "x" * 9 + "AAAA==", *[t[1] for t in fx.odd_rows()]]
    return texts


def test_secrets_equal_a_plain_version(spark):
    """Places behind signs of several bytes, failing matches that hide others, nulls, repeated rows, a run of 320,000 signs."""
    texts = keys_and_prose()
    df = spark.createDataFrame([(i, t, "r", 1, "h") for i, t in enumerate(texts)], "doc_id long, text string, row string, start int, hit string")
    got = [tuple(r)[1:] for r in secrets.secrets(df).orderBy("doc_id").collect()]
    want = plain_secrets(texts)
    assert got == want
    assert sum(w[3] for w in want) >= 15 and all(w[3] <= 1 for w in want)


def test_secrets_of_nothing_and_odd_rows(spark):
    assert secrets.secrets(fx.empty(spark)).collect() == []
    rows = secrets.secrets(fx.odd(spark)).collect()
    assert len(rows) == len(fx.odd_rows()) and all(r["n_assign"] == 0 for r in rows)


def test_prose_alone_is_left_alone(spark):
    r = random.Random(2)
    texts = [" ".join("".join(r.choices("etaoinshrdlu", weights=[12, 9, 8, 7, 7, 6, 6, 6, 6, 4, 4, 3], k=r.randint(12, 30))) for _ in range(40)) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert secrets.secrets(df).agg(F.sum("n_random")).first()[0] <= 3
