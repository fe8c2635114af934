import random
from collections import defaultdict

import numpy as np
import pytest
from imgframe.llm import suffix_dedup as S
from imgframe.llm.suffix_dedup import common_prefix_starts, remove_repeated_bytes, suffix_order, window_runs


def plain(rows, length):
    """(doc_id, n_bytes, n_removed, n_spans, kept) from every window."""
    least, out = defaultdict(lambda: float("inf")), []
    texts = [(d, (t or "").encode()) for d, t in rows]
    for d, t in texts:
        for i in range(len(t) - length + 1) if d is not None else ():
            least[t[i : i + length]] = min(least[t[i : i + length]], d)
    for d, t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - length + 1) if d is not None else ():
            if least[t[i : i + length]] < d:
                gone[i : i + length] = [True] * length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(t), sum(gone), spans, bytes(b for b, g in zip(t, gone, strict=True) if not g)))
    return sorted(out, key=str)


def got(frame):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in frame.collect()), key=str)


def corpus(rng, n):
    """Texts with passages of each other, copies, near copies and periodic stretches."""
    passages = ["".join(rng.choices("abc é", k=rng.randrange(5, 300))) for _ in range(12)]
    texts = []
    for _ in range(n):
        parts = rng.choices(passages, k=rng.randrange(3)) + ["".join(rng.choices("abcdefgh ñ\n", k=rng.randrange(200)))]
        rng.shuffle(parts)
        texts.append("".join(parts))
    texts += rng.choices(texts, k=n // 4) + ["ab" * 400, "ab" * 300 + "c", "a" * 49, "a" * 50, "a" * 51, "a" * 2000]
    return texts


@pytest.mark.parametrize(("length", "hot", "symbols"), [(50, 10_000, 1 << 18), (50, 3, 2000), (8, 5, 500), (2, 10_000, 1 << 18)])
def test_against_every_window(spark, monkeypatch, length, hot, symbols):
    """Also with small blocks, small transforms, and hashes split by window once a few documents have them."""
    monkeypatch.setattr(S, "BLOCK_BYTES", 2000)
    rng = random.Random(length + hot)
    rows = list(enumerate(corpus(rng, 80)))
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(remove_repeated_bytes(frame, length, hot, symbols)) == plain(rows, length)


def test_cases(spark):
    long = "".join(random.Random(1).choices("abcdefghij", k=3_000_000))
    rows = [(1, None), (2, ""), (3, "short"), (4, long), (5, "x" + long[1_000_000:2_500_000]), (6, "n\0l" * 40), (7, "n\0l" * 40), (None, long[:100]), (None, long[:100]), (8, "r" * 60), (8, "r" * 60), (-9, "r" * 55)]
    frame = spark.createDataFrame([(*r, 0, "clash") for r in rows], "doc_id long, text string, block int, deal string")
    out = got(remove_repeated_bytes(frame))
    assert [r[:4] for r in out if r[0] in (4, 5)] == [(4, 3_000_000, 0, 0), (5, 1_500_001, 1_500_000, 1)]
    by_id = [(d, n, gone) for d, n, gone, _, _ in out if d not in (4, 5)]
    assert sorted(by_id, key=str) == sorted([(1, 0, 0), (2, 0, 0), (3, 5, 0), (6, 120, 0), (7, 120, 120), (None, 100, 0), (None, 100, 0), (8, 60, 60), (8, 60, 60), (-9, 55, 0)], key=str)
    assert not remove_repeated_bytes(frame.where("false")).collect()
    with pytest.raises(ValueError, match="length"):
        remove_repeated_bytes(frame, 1)


def test_values_of_common_prefixes():
    """The transform gives the same neighbours with few symbols in common as the sorted suffixes themselves."""
    rng = np.random.default_rng(3)
    for length in (1, 2, 7, 50):
        symbols = np.concatenate([rng.integers(1, 4, 300), [0], rng.integers(1, 4, 300), [0]]).astype(np.uint16)
        symbols[350:420] = symbols[20:90]
        order = suffix_order(symbols, length)
        first = [tuple(symbols[i : i + length]) for i in order]
        assert first == sorted(first)
        starts = set(common_prefix_starts(symbols, order, length).tolist())
        for k in range(1, len(order)):
            if 0 not in first[k] and len(first[k]) == length:
                assert (k in starts) == (first[k] != first[k - 1])


def test_the_extension_decides(spark, monkeypatch):
    """Without values of common prefixes nothing is the same, so nothing goes."""
    rows = [(1, "abcdefghij" * 6 + "x"), (2, "y" + "abcdefghij" * 6)]
    monkeypatch.setattr(S, "common_prefix_starts", lambda symbols, order, length: np.arange(len(order)))
    texts = [t.encode() for _, t in rows]
    assert S.least_owners(texts, np.array([1, 2]), 50).tolist() == [1] * 12 + [2] * 12


def test_equal_windows_have_equal_hashes():
    rng = random.Random(4)
    shared = bytes(rng.choices(range(256), k=90))
    hashes = defaultdict(set)
    for _ in range(30):
        text = bytes(rng.choices(range(256), k=rng.randrange(100))) + shared + bytes(rng.choices(range(256), k=rng.randrange(100)))
        at = 0
        for key, start, count in zip(*(x.tolist() for x in window_runs(text, 50)), strict=True):
            assert start == at
            at += count
            for i in range(start, start + count):
                hashes[text[i : i + 50]].add(key)
        assert at == len(text) - 49
    assert all(len(x) == 1 for x in hashes.values())
