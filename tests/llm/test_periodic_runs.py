import random
import re
import zlib

import numpy as np
from imgframe.llm.periodic_runs import Refinement, periodic_runs, repeated_tail, runs_of
from pyspark.sql import functions as F


def plain(w, least=12):
    """Runs from every period and place."""
    n, out = len(w), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least, 2 * q):
                out.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, m, q) for (s, m), q in out.items()), key=lambda r: (r[0], r[2]))


def some(rng):
    n, k = rng.choice([0, 1, 3, 20, 60, 200]), rng.choice([1, 2, 3, 10, 50])
    w = [rng.randrange(k) for _ in range(n)]
    if n and rng.random() < 0.7:
        a = rng.randrange(n)
        p = 1 + (n - a) // rng.randint(3, 10)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w + w[: rng.randrange(n)] + w if n and rng.random() < 0.3 else w


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def test_against_every_period():
    rng = random.Random(5)
    for _ in range(400):
        texts = [some(rng) for _ in range(rng.randint(1, 4))]
        least = rng.choice([12, 12, 2])
        codes = np.array([x for t in texts for x in t], np.int64)
        assert runs_of(codes, np.cumsum([len(t) for t in texts]), least) == [plain(t, least) for t in texts]


def test_words_with_many_runs():
    w = fibonacci(600)
    assert runs_of(np.array(w), np.array([600]), 2) == [plain(w, 2)]


def test_moves_are_few():
    """Places move only with the smaller parts: n log n times at most, where all levels are refined."""
    for w in (fibonacci(4000), [random.Random(6).randrange(2) for _ in range(4000)], [0] * 4000):
        moves = 0

        class Counted(Refinement):
            def refine(self):
                nonlocal moves
                moves += sum(map(len, self.small))
                super().refine()

        places = {}
        for i, x in enumerate(w):
            places.setdefault(x, []).append(i)
        for _ in Counted(len(w), 1, [p for p in places.values() if len(p) > 1]).squares():
            pass
        assert moves <= len(w) * 13


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_texts(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice([" ", "\n", " \t"]).join(f"é{x}" for x in some(rng))) for i in range(60)]
    rows += [(60, None), (61, ""), (62, " \n"), (63, "one"), (None, "a b " * 30), (64, "x " * 40), (64, "x " * 40), (65, "very long " * 300_000), (66, "a\0b   " * 20)]
    frame = spark.createDataFrame([(*r, 0, "clash") for r in rows], "doc_id long, text string, runs int, collapsed string")
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs(frame).collect()), key=str)
    want = []
    for d, t in rows:
        w = words(t)
        runs = [(0, 600_000, 2)] if d == 65 else plain(w)
        gone = {i for s, m, q in runs for i in range(s + q, s + m)}
        want.append((d, len(w), runs, " ".join(x for i, x in enumerate(w) if i not in gone)))
    assert got == sorted(want, key=str)
    assert not periodic_runs(frame.where("false")).collect()


def test_repeated_tail(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(f"w{rng.randrange(1000)}" for _ in range(rng.randrange(60)))) for i in range(300)] + [(7000, None), (7001, "")]
    number = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    got = {d: words(t) for d, t in spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", repeated_tail(F.col("text"), number)).collect()}
    for d, t in rows:
        h, w = zlib.crc32(str(d).encode()), words(t)
        n, g = len(w), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        assert got[d] == w
