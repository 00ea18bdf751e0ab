"""Tokens, token files, languages, toxicity, licences, decontamination and the pipeline."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from barline.llm import bpe, decontaminate, langid, licences, queries, rangecoder, store, tokenfile, toxicity
from cases import empty, odd

FILE = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILE)


HARD = ["Hello <|startoftext|>world's ΑΣ ΑΣ. 12x!! é", "aaaaaaa aaaaaaaaaaaaab I'LL don't İstanbul ǅ ﬁ é x²³¼ªº×÷  b  \x85 c\x1cd \x00e 日本語テスト 👩‍👩‍👧 ½", "ŐŰ Ⅷ ١٢ <|endoftext|><|endoftext|> <|EndOfText|> a<b>c '''s're'VE", "́ á ́b", "  x y　z ﻿"]


def test_bpe_equals_the_library(spark, library):
    rows = odd(spark).unionByName(spark.createDataFrame([(900 + i, t) for i, t in enumerate(HARD)], "doc_id bigint, text string"), allowMissingColumns=True)
    out = bpe.decode(bpe.encode(rows, FILE), FILE)
    assert out.columns == [c for c in rows.columns if c != "ids"] + ["ids", "decoded"]
    for r in out.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == library.decode(ids, skip_special_tokens=False)
    assert bpe.encode(empty(spark), FILE).count() == 0
    few = spark.createDataFrame([(None,), ([],), ([320, -1, 10**6],)], "ids array<int>")
    assert [r.decoded for r in bpe.decode(few, FILE).collect()] == ["", "", "a</w>"]


def test_bpe_digests(spark, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op8(spark, SF).collect():
        ids = library.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_overlapping_pairs_merge_from_the_left(library):
    m = bpe.model(FILE)
    for n in range(1, 40):
        for c in ("a", "!", "é", "ha", "."):
            ids, sizes = m.encode_words([(c * n).encode()])
            assert ids.tolist() == library.encode(c * n, add_special_tokens=False).ids and sizes.tolist() == [len(ids)]


@pytest.mark.parametrize("n", [0, 1, 2, 255, 256, 257, 5000])
def test_coder_round_trip(n):
    r = np.random.default_rng(n)
    for ids in (r.integers(0, 300, n), np.zeros(n, np.int64), np.minimum(r.zipf(1.3, n), 299)):
        data = rangecoder.encode_block(ids, 300)
        assert (rangecoder.decode_block(data) == ids).all()
    if n >= 255:
        assert len(rangecoder.encode_block(np.zeros(n, np.int64), 300)) < n
        bad = bytearray(data)
        bad[-1] ^= 1
        with pytest.raises(ValueError):
            rangecoder.decode_block(bytes(bad))
    with pytest.raises(ValueError):
        rangecoder.decode_block(b"what")


def test_token_files(spark, library):
    docs = odd(spark)
    path = store.shared_path(spark, "tokens")
    tokenfile.write_tokens(docs, FILE, path, block_ids=3000)
    rows = sorted(tokenfile.read_tokens(spark, path).collect(), key=lambda r: r.start)
    texts = Counter((r.doc_id, tuple([*library.encode(r.text or "", add_special_tokens=False).ids, 1])) for r in docs.collect())
    assert Counter((r.doc_id, tuple(np.frombuffer(r.tokens, "<u4").tolist())) for r in rows) == texts
    keys = [r.doc_id for r in rows]
    assert keys[0] is None and keys[1:] == sorted(keys[1:])
    assert [r.start for r in rows] == [0, *np.cumsum([r.n_tokens for r in rows])[:-1].tolist()]
    assert spark.read.parquet(path).count() > 1
    nothing = store.shared_path(spark, "tokens")
    tokenfile.write_tokens(empty(spark), FILE, nothing)
    assert tokenfile.read_tokens(spark, nothing).count() == 0


def test_op1(spark, library):
    got, start = {r.doc_id: r for r in queries.op1(spark, SF).collect()}, 0
    for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect():
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 1]
        g = got.pop(r.doc_id)
        assert (g.start, g.n_tokens, g.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert not got


def brute_bits(word, words, order):
    """Code length of a word after training on ``words``, byte by byte."""
    seen = {}
    for w in words:
        s = b" " + w + b" "
        for i in range(1, len(s)):
            for k in range(min(order, i) + 1):
                seen.setdefault((k, s[i - k : i]), Counter())[s[i]] += 1
    s, bits = b" " + word + b" ", 0.0
    for i in range(1, len(s)):
        for k in range(min(order, i), -1, -1):
            c = seen.get((k, s[i - k : i]))
            if c is None:
                continue
            if s[i] in c:
                bits -= math.log2(c[s[i]] / (c.total() + len(c)))
                break
            bits -= math.log2(len(c) / (c.total() + len(c)))
        else:
            bits += 8
    return bits


def test_code_lengths_are_exact(spark, monkeypatch):
    monkeypatch.setattr(langid, "PRUNED_COUNT", 1)
    texts = {"xx": "the cat sat on the mat with that hat", "yy": "der hund und die katze und das haus"}
    docs = spark.createDataFrame([(i, t, k) for i, (k, t) in enumerate(texts.items())], "doc_id bigint, text string, lang string")
    trees = langid.train(docs)
    words = [b"the", b"hundehaus", b"q", "ß".encode()]
    got = trees.bits(words)
    for k, name in enumerate(trees.languages):
        for i, w in enumerate(words):
            assert abs(got[i, k] - brute_bits(w, texts[name].encode().split(), langid.ORDER)) < 1e-9


def test_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    out = queries.op2(spark, "/root/testdata/sf0.01").join(docs, "doc_id").where("held_out").collect()
    assert len(out) > 100 and sum(r.lang == r.lang_pred for r in out) > 0.97 * len(out) and all(0 <= r.score <= 1 for r in out)


def test_languages_of_odd_rows(spark):
    docs = odd(spark)
    out = langid.identify(docs, langid.train(docs))
    texts = docs.select("doc_id", "text").collect()
    und = Counter(r.doc_id for r in texts if not any(c.isalpha() for c in r.text or ""))
    rows = out.collect()
    assert len(rows) == len(texts) and Counter(r.doc_id for r in rows if r.lang_pred == "und") == und
    assert langid.identify(empty(spark), langid.train(empty(spark))).count() == 0
    assert {r.lang_pred for r in langid.identify(docs, langid.train(empty(spark))).collect()} == {"und"}


def test_toxicity(spark):
    path = "/root/testdata/sf0.01"
    out = queries.op3(spark, path).join(spark.read.parquet(f"{path}/labels.parquet"), "doc_id").where("held_out").collect()
    flagged, toxic = [r for r in out if r.predicted], [r for r in out if r.toxic]
    assert all(r.toxic for r in flagged) and len(flagged) >= 0.5 * len(toxic)
    assert all(r.predicted == int(r.score >= 0.7) for r in out)


def test_toxicity_of_odd_rows(spark):
    docs = odd(spark)
    labels = docs.where("doc_id is not null").select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("toxic"), F.lit("x").alias("text")).distinct()
    model = toxicity.train(docs, labels)
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    none = toxicity.train(docs, labels.where("false"))
    assert none.voters == [] and all(r.predicted == 0 for r in toxicity.score(docs, none).collect())
    assert toxicity.score(empty(spark), model).count() == 0


def test_votes_are_features():
    r = random.Random(4)
    m = toxicity.Model(["loser", "idio*", "path*", "été"], np.zeros(4), 0.0)
    a = m.automaton()
    parts = ["loser", "losers", "closer", "idiot", "idio", "pathetic", "path", "Path3tic", "été", "été2", "étés", ",", " ", "-", "7"]
    for _ in range(300):
        t = "".join(r.choice(parts) + r.choice(["", " "]) for _ in range(6))
        assert {m.voters[i] for i in toxicity.votes(t, a)} == toxicity.features(t) & set(m.voters)


def test_label_model_discounts_echoes():
    r = np.random.default_rng(0)
    y = (r.random(4000) < 0.3).astype(float)
    vote = lambda hit, noise: (r.random(4000) < np.where(y == 1, hit, noise)).astype(float)
    one, two = vote(0.6, 0.1), vote(0.7, 0.02)
    alone = toxicity.label_model(np.stack([one, two], 1), y)
    echoed = toxicity.label_model(np.stack([one, one, one, one, two], 1), y)
    assert ((alone > 0.5) == y).mean() > 0.8 and echoed[(one == 1) & (two == 0)].mean() < 0.95


def test_licences(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    rows = [("a/LICENSE", mit), ("a/b/c/x.py", "print"), ("a/b/LICENSE", gpl), ("a/y.py", "a b c"), ("z/q.py", f"{mit}\n" + "code and more code " * 20), ("z/r.py", None), ("top", ""), (None, gpl), ("a/y.py", "a b c"), ("a/b/c/d/v.py", "the licence of the house version")]
    filler = [(f"f/{i}", "some words of a plain text in the house") for i in range(20)]
    docs = spark.createDataFrame([(*r, "clash") for r in rows + filler], "path string, text string, licence string")
    out = licences.scan(docs).collect()
    got = {(r.path, r.own_licence, r.licence_file, r.licence, r.licence_from) for r in out if not (r.path or "").startswith("f/")}
    assert got == {
        ("a/LICENSE", "MIT", True, "MIT", "a/LICENSE"), ("a/b/c/x.py", None, False, "GPL-3.0", "a/b"), ("a/b/LICENSE", "GPL-3.0", True, "GPL-3.0", "a/b/LICENSE"),
        ("a/y.py", None, False, "MIT", "a"), ("z/q.py", "MIT", False, "MIT", "z/q.py"), ("z/r.py", None, False, None, None), ("top", None, False, None, None),
        (None, "GPL-3.0", True, "GPL-3.0", None), ("a/b/c/d/v.py", None, False, "GPL-3.0", "a/b"),
    }
    assert len(out) == len(rows) + 20
    assert licences.scan(docs.limit(0)).count() == 0


def test_licence_notices_inside_longer_lines(spark):
    notices = {
        "This project is licensed under the MIT License.": "MIT", "Released under the MIT License by Acme Corp.": "MIT",
        "Copyright 2020 Acme. Licensed under the Apache License, Version 2.0": "Apache-2.0",
        "All of the words before it, then: licensed under CC BY-NC 4.0, and all the words after it": "CC-BY-NC-4.0", "The licence of the MIT house and its version": None,
    }
    rows = [(f"{i}/x", t) for i, t in enumerate(notices)] + [(f"f/{i}", "some words of a plain text in the house") for i in range(300)]
    got = {r.text: r for r in licences.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert {t: got[t].own_licence for t in notices} == notices
    assert not got[list(notices)[3]].licence_file


def test_licence_words_beside_underscores_and_accents(spark):
    rows = [("a/x", "_Released_ _under_ _the_ _MIT_ _License_"), ("b/x", "éLicensedé_under_the_Apache_License_Version_2_0")]
    rows += [(f"f/{i}", "some words of a plain text in the house") for i in range(50)]
    got = {r.path: r.own_licence for r in licences.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert (got["a/x"], got["b/x"]) == ("MIT", "Apache-2.0")


def test_distances_are_edit_distances():
    r = random.Random(6)
    for _ in range(200):
        p, t = "".join(r.choice("ab ") for _ in range(r.randint(1, 20))), "".join(r.choice("abc ") for _ in range(r.randint(0, 40)))
        row = [0] * (len(t) + 1)
        for i, a in enumerate(p, 1):
            now = [i]
            for j, b in enumerate(t, 1):
                now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (a != b)))
            row = now
        assert decontaminate.distances(p, t) == row[1:]


def brute_matches(docs, items):
    out = set()
    for k, t in docs:
        for i, x in items:
            p = decontaminate.normalised(x)
            d = decontaminate.distances(p, decontaminate.normalised(t)) if p else []
            budget = int(decontaminate.SHARE * len(p)) if len(p) >= decontaminate.LEAST else 0
            if d and min(d) <= budget:
                out.add((k, i, min(d)))
    return out


@pytest.mark.parametrize("block", [8 << 20, 300])
def test_matches_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    r = random.Random(8)
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").limit(6).collect()
    items = [(x.item_id, x.text) for x in bench] + [(100, None), (101, ""), (102, "the short one"), (103, bench[0].text)]

    def edited(t, n):
        c = list(t)
        for _ in range(n):
            c[r.randrange(len(c))] = r.choice(["", "q", "zz"])
        return "".join(c)

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(15).collect()]
    docs += [(1000 + i, f"before {edited(x.text.upper(), n)} after") for i, (x, n) in enumerate((x, n) for x in bench for n in (0, 5, 12, 40))]
    docs += [(2000, None), (2001, ""), (2002, "it is The Short, one!"), (2003, bench[1].text * 3)]
    frame = spark.createDataFrame([(*d, "clash", 1) for d in docs], "doc_id bigint, text string, item_id string, start int")
    known = spark.createDataFrame([(*i, "c") for i in items], "item_id bigint, text string, doc_id string")
    got = decontaminate.matches(frame, known).collect()
    assert {(x.doc_id, x.item_id, x.edits) for x in got} == brute_matches(docs, items) and len(got) == len({(x.doc_id, x.item_id) for x in got})
    bad = {x.doc_id for x in got}
    left = decontaminate.decontaminated(frame, known)
    assert left.columns == frame.columns and {x.doc_id for x in left.collect()} == {k for k, _ in docs} - bad
    assert decontaminate.matches(frame, known.limit(0)).count() == 0 and decontaminate.matches(frame.limit(0), known).count() == 0


def test_licences_of_odd_rows_and_long_lines(spark):
    filler = [f"x{k % 997}" for k in range(20_000)]
    long = " ".join([*filler[:9000], "Licensed under the MIT License", *filler[9000:]])
    rows = odd(spark).selectExpr("*", "concat('d/', cast(doc_id as string)) as path", "1 as best")
    more = spark.createDataFrame([(900, long, "long/LICENSE"), (901, "nothing", "long/a.txt"), (902, long + "\nLicensed under the MIT License", "other/b")], "doc_id bigint, text string, path string")
    out = licences.scan(rows.unionByName(more, allowMissingColumns=True))
    got = {r.doc_id: r for r in out.collect()}
    assert out.count() == rows.count() + 3
    assert got[900].own_licence == got[902].own_licence == "MIT" and got[900].own_score == 1.0 and not got[900].licence_file
    assert all(got[k].own_licence is None for k in got if k is None or k < 900)


def test_pipeline_by_brute_force(spark, library):
    from test_dedup import brute_alike, brute_quality, brute_repeats

    from barline.llm.quality import Limits

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        sources = {r.doc_id: r.source for r in docs.collect()}
        docs = store.saved(stage(spark, docs, SF), name)
        after = {r.doc_id: r for r in docs.collect()}
        assert len(after) == docs.count()
        if name == "quality_rules":
            want = brute_quality([(k, t, sources[k]) for k, t in before], Limits())
            assert set(after) == {k for (k, _, _), v in want.items() if v[-1]}
        elif name == "near_dedup":
            assert set(after) == set(brute_alike(before)[0].values())
        elif name == "suffix_array_dedup":
            want = brute_repeats(before)
            assert set(after) == {k for k, _ in before}
            for k, t in before:
                assert (after[k].text == t) if not want[k][0] else len(after[k].text.encode()) <= len(t.encode()) - want[k][0]
        elif name == "benchmark_decontamination":
            bad = set()
            for k, t in before:
                text = decontaminate.normalised(t)
                bad |= {k for _, x in items if decontaminate.normalised(x) in text}
            assert bad <= {k for k, _ in before} - set(after)
            assert not brute_matches([(k, t) for k, t in before if k in list(after)[:6]], items)
        else:
            for k, t in before:
                assert after[k].ids == library.encode(t or "", add_special_tokens=False).ids
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == corpus_pipeline.DOCUMENT


def test_pipeline_of_an_empty_table(spark):
    docs = empty(spark).select(corpus_pipeline.DOCUMENT)
    for name, stage in corpus_pipeline.STAGES:
        docs = store.saved(stage(spark, docs, SF), name)
    assert docs.count() == 0
