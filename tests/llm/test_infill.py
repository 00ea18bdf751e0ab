"""Fill-in-middle texts against a plain version."""

import hashlib
import re

import pytest

from barline.llm import infill, queries
from cases import SCHEMA, empty, odd, odd_rows

SF = "/root/testdata/sf0.001"
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
HARD = ["<P> a b", "a <S> b", "x<M>", " lead and tail \n", "<P" * 50 + " <S " * 30, "> <S a < P> b c <M d", "日本 語é x\x85y \x1c z", "\n", "a" * 40_000 + " b " + "é" * 30_000, "<S a <P b M> c S> d >" * 9]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(key, text, options=infill.Options()):
    t = text or ""
    units = UNIT.findall(t)
    assert "".join(units) == t
    h = [int(sha(f"{options.seed}:{'' if key is None else key}")[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= options.plain:
        return n, "plain", None, None, t
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h[3] % 100 < options.spm else "psm"
    return n, form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def rows_of(spark, k=4):
    rows = odd_rows()
    rows += [(1000 * j + i, t, *rows[0][2:]) for j in range(1, k) for i, t in enumerate(HARD)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.mark.parametrize("options", [infill.Options(), infill.Options(7, 100, 30)])
@pytest.mark.parametrize("chunk", [5, infill.CHUNK])
def test_texts_and_digests(spark, monkeypatch, options, chunk):
    monkeypatch.setattr(infill, "CHUNK", chunk)
    docs = rows_of(spark) if chunk > 5 else rows_of(spark).where("length(text) < 9000 or text is null")
    rows = docs.collect()
    found = infill.pieces(docs, options=options)
    want = [(r.doc_id, *brute(r.doc_id, r.text, options)) for r in rows]
    order = lambda rows: sorted(map(tuple, rows), key=repr)
    assert order(infill.transformed(found).collect()) == order(want)
    assert order(infill.digests(found).collect()) == order([(*w[:-1], sha(w[-1]), sha(r.text or "")) for w, r in zip(want, rows)])
    assert {w[2] for w in want} == {"plain", "psm", "spm"}


def test_sections_at_any_cut():
    for form, out in (("psm", b"<P>ab<<S><SxS>c<M>q<"), ("spm", b"<S><P<P><S<M>"), ("psm", b"<P><S><M>")):
        want = {}
        s = infill._Sections(form)
        for order, part in [*s.feed(out), *s.close()]:
            want[order] = want.get(order, b"") + part
        for size in (1, 2, 3, 5):
            s, got = infill._Sections(form), {}
            for i in range(0, len(out), size):
                for order, part in s.feed(out[i : i + size]):
                    got[order] = got.get(order, b"") + part
            for order, part in s.close():
                got[order] = got.get(order, b"") + part
            assert got == want


def test_empty_and_clashing(spark):
    assert infill.digests(infill.pieces(empty(spark))).count() == 0 and infill.transformed(infill.pieces(empty(spark))).count() == 0
    docs = odd(spark).selectExpr("*", "1 as row", "2 as place", "'x' as form", "3 as n", "'z' as data")
    assert infill.digests(infill.pieces(docs)).count() == docs.count()


def test_op13(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op13(spark, SF).collect():
        n, form, p, m, out = brute(r.doc_id, docs[r.doc_id])
        assert tuple(r) == (r.doc_id, n, form, p, m, sha(out), sha(docs.pop(r.doc_id) or ""))
    assert not docs
