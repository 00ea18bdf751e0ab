"""Scores by prediction by partial matching against a plain trie that codes byte by byte."""

import math
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from barline.llm import ppm, queries
from cases import empty, odd, odd_rows

SF = "/root/testdata/sf0.001"


def plain(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    return [x for x in low.split(" ") if x]


def brute(rows, order=ppm.ORDER):
    """rows: (key, text, is for training). For each row: n_tokens, n_known, train_tokens, base_score, score."""
    tokens = [[*plain(t), None] for _, t, _ in rows]
    counts = Counter(x for ts, (_, _, own) in zip(tokens, rows) if own for x in ts)
    n, v = sum(counts.values()), len(counts)
    raw = [b"\n" * order + " ".join(ts[:-1]).encode() + b"\n" for ts in tokens]
    seen: dict[bytes, Counter] = {}
    for r, (_, _, own) in zip(raw, rows):
        if own:
            for i in range(order, len(r)):
                for k in range(order + 1):
                    seen.setdefault(r[i - k : i], Counter())[r[i]] += 1
    cache: dict[bytes, float] = {}

    def cost(context, byte):
        bits, refused = 0.0, set()
        for k in range(len(context), -1, -1):
            here = {b: c for b, c in seen.get(context[len(context) - k :], {}).items() if b not in refused}
            if not here:
                continue
            total = 2 * sum(here.values())
            if byte in here:
                return bits + math.log10(total / (2 * here[byte] - 1))
            bits += math.log10(total / len(here))
            refused |= set(here)
        return bits + math.log10(256 - len(refused))

    out = []
    for r, ts in zip(raw, tokens):
        total = 0.0
        for i in range(order, len(r)):
            g = r[i - order : i + 1]
            if g not in cache:
                cache[g] = cost(g[:-1], g[-1])
            total -= cache[g]
        base = sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in ts)
        out.append((len(ts), sum(counts[x] > 0 for x in ts), n, base, total))
    return out


def same(got, want):
    assert tuple(got[:3]) == want[:3]
    assert got[3] == pytest.approx(want[3], rel=1e-9) and got[4] == pytest.approx(want[4], rel=1e-9)


@pytest.mark.parametrize("chunk", [ppm.CHUNK, 2000])
def test_scores_of_odd_rows(spark, monkeypatch, chunk):
    monkeypatch.setattr(ppm, "CHUNK", chunk)
    monkeypatch.setattr(ppm, "STEP", chunk)
    rows = odd_rows()
    docs = odd(spark).selectExpr("*", "'x' as word", "1 as chunk", "2 as gram", "3 as cost", "4 as kind")
    for training, own in ((F.col("doc_id") % 3 != 0, lambda k: k is not None and k % 3 != 0), (F.lit(False), lambda k: False), (F.lit(True), lambda k: True)):
        got = ppm.score(docs, training).collect()
        want = {}
        for r, x in zip(rows, brute([(r[0], r[1], own(r[0])) for r in rows])):
            want.setdefault(r[0], []).append((own(r[0]), x))
        assert len(got) == len(rows)
        for r in got:
            flag, x = want[r.doc_id].pop()
            assert r.trained == flag
            same((r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score), x)
        assert not any(want.values())


def test_empty(spark):
    assert ppm.score(empty(spark), F.lit(True)).count() == 0


def test_op12(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = [(k, t, zlib.crc32(str(k).encode()) % 10 != 0) for k, t in docs]
    want = {k: (not own, x) for (k, _, own), x in zip(rows, brute(rows))}
    got = queries.op12(spark, SF).collect()
    assert len(got) == len(rows)
    for r in got:
        held, x = want.pop(r.doc_id)
        assert r.held_out == held
        same((r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score), x)
    assert any(r.held_out for r in got)
