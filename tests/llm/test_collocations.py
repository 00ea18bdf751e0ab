"""Phrases and filters against plain counting."""

import re
from collections import Counter

import numpy as np
import pytest

from barline.llm import collocations as c
from barline.llm import queries
from cases import empty, odd, odd_rows

SF = "/root/testdata/sf0.001"


def brute(rows, least, share=100, top=2000):
    """rows: (text, lang)."""
    f, n = Counter(), Counter()
    for t, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(x.lower() if "A" <= x <= "Z" else x for x in t or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            f.update((lang, *ws[i : i + k]) for k in range(1, 6) for i in range(len(ws) - k + 1))
    out = []
    for (lang, *ws), a in f.items():
        if len(ws) == 1 or a < least:
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, *ws[:k]] * f[lang, *ws[k:]]), k, f[lang, *ws[:k]], f[lang, *ws[k:]]) for k in range(1, len(ws))]
        score, _, left, right = min(cuts)
        out.append((lang, tuple(ws), a, left, right, n[lang], score))
    longest = Counter()
    for lang, ws, a, *_ in out:
        for k in range(2, len(ws)):
            for i in range(len(ws) - k + 1):
                longest[lang, ws[i : i + k]] = max(longest[lang, ws[i : i + k]], a)
    kept = [(lang, " ".join(ws), *rest) for lang, ws, *rest in out if 100 * longest[lang, ws] < share * rest[0]]
    kept.sort(key=lambda r: (r[0], -r[-1], -r[2], r[1].encode()))
    ranks, answer = Counter(), []
    for r in kept:
        ranks[r[0]] += 1
        if ranks[r[0]] <= top:
            answer.append((r[0], ranks[r[0]], *r[1:]))
    return answer


@pytest.mark.parametrize("size,width", [(2, 1), (2, 13), (3, 21), (4, 16), (5, 13), (5, 25)])
def test_filters_lose_nothing(size, width):
    r = np.random.default_rng(size * width)
    words = [r.integers(0, 1 << width, 3000) for _ in range(size)]
    left, right, half = c.packed(words, width)
    assert all((a == b).all() for a, b in zip(c.words_of(left, right, size, width), words))
    p = c.permuted(left, right, half)
    assert all((a == b).all() for a, b in zip(c.permuted(*p, half, back=True), (left, right)))
    assert max(int(x.max()) for x in p) < 1 << half
    n = r.choice([1, 2, 255, 256, 257, 10**9], 3000).astype(np.int64)
    a, b, total, order, first = c.summed(*p, n, half)
    want = Counter()
    for x, y, k in zip(*(z.tolist() for z in (*p, n))):
        want[x, y] += k
    assert dict(zip(zip(a.tolist(), b.tolist()), total.tolist())) == want and sorted(want) == list(zip(a.tolist(), b.tolist()))
    own = min(3, half)
    for k in range(1 << own):
        some = a >> np.uint64(half - own) == k
        back = c.pairs_of(c.filter_of(a[some], b[some], total[some], half, own), half, own, k)
        assert all((x == y[some]).all() for x, y in zip(back, (a, b, total)))


def test_runs():
    seq = np.array([1, 2, 3, -1, 4, 5, 6, 7])
    assert c.runs_of(seq, np.array([0, 4, 5, 6]), 2).tolist() == [4, 5, 6, 7, -1]
    assert c.runs_of(seq, np.array([0, 1, 4, 6]), 2).tolist() == [1, 2, 3, -1]
    assert c.runs_of(seq, np.zeros(0, np.int64), 2).tolist() == []


@pytest.mark.parametrize("least,share,small", [(3, 100, True), (2, 60, False), (1, 100, False), (10**6, 100, False)])
def test_odd_rows(spark, monkeypatch, least, share, small):
    if small:
        for name in ("CHUNK", "STEP", "MERGED"):
            monkeypatch.setattr(c, name, 300)
        monkeypatch.setattr(c, "LEAST_BUCKET", 3000)
    rows = [(r[1], r[2]) for r in odd_rows() if least > 1 or len(r[1] or "") < 9000]
    docs = odd(spark).selectExpr("*", "'x' as word", "1 as chunk", "2 as f", "3 as k", "4 as n", "array('q') as words")
    docs = docs if least > 1 else docs.where("length(text) < 9000 or text is null")
    got = [tuple(r) for r in c.collocations(docs, least=least, share=share).orderBy("lang", "rank").collect()]
    assert got == brute(rows, least, share)
    assert bool(got) == (least < 10**6)


def test_empty(spark):
    assert c.collocations(empty(spark)).count() == 0


def test_op11(spark):
    rows = [(r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert [tuple(r) for r in queries.op11(spark, SF).orderBy("lang", "rank").collect()] == brute(rows, 100)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [tuple(r) for r in c.collocations(docs, least=5, top=300).orderBy("lang", "rank").collect()] == brute(rows, 5, top=300)
