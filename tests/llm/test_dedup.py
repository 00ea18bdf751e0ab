"""Near-duplicates, repeated substrings, components, sharding, quality rules against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from barline.llm import components, enhanced, quality, sharding, shingles, simhash, substrings
from cases import empty, odd

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def union(nodes, pairs):
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in pairs:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def test_components(spark):
    r = random.Random(1)
    pairs = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (7, None)]
    want = union({x for p in pairs for x in p if x is not None}, [p for p in pairs if None not in p])
    got = {x.node: x.label for x in components.components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert all(got.get(n, n) == want[n] for n in want)
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def brute_print(text):
    w = [x.encode() for x in WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))]
    if not w:
        return 0
    s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("few", [32, 1])
def test_simhash_equals_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(simhash, "PAIRWISE", few)
    docs = odd(spark)
    rows = docs.select("doc_id", "text").collect()
    prints = {(r.doc_id, r.text): brute_print(r.text) for r in rows}
    values = sorted(set(prints.values()))
    label = union(values, [(a, b) for i, a in enumerate(values) for b in values[i:] if (a ^ b).bit_count() <= 2])
    least = {}
    for (k, _), p in prints.items():
        if k is not None:
            least[label[p]] = min(least.get(label[p], k), k)
    want = Counter((r.doc_id, f"{prints[(r.doc_id, r.text)]:016x}", least.get(label[prints[(r.doc_id, r.text)]])) for r in rows)
    assert Counter(tuple(r) for r in simhash.near_duplicates(docs).collect()) == want
    assert simhash.near_duplicates(empty(spark)).count() == 0
    left = simhash.one_of_each(docs)
    assert left.columns == docs.columns and left.count() == len({label[p] for (k, _), p in prints.items() if k is not None}) + 1


def test_links_of_close_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PAIRWISE", 3)
    r = random.Random(3)
    base = [r.getrandbits(64) for _ in range(20)]
    values = sorted({b ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for b in base for _ in range(12)})
    want = union(values, [(a, b) for i, a in enumerate(values) for b in values[i:] if (a ^ b).bit_count() <= 2])
    signed = {v: v - (1 << 64) if v >> 63 else v for v in values}
    got = simhash.links(spark.createDataFrame([(s,) for s in signed.values()], "fp bigint")).collect()
    back = {s: v for v, s in signed.items()}
    assert union(values, [(back[x.a], back[x.b]) for x in got]) == want


def test_allocation_is_least():
    costs = np.array([[0, 5, 9, 20], [0, 1, 7, 30], [0, 2, 3, 4]], float)
    best = min(costs[0, a] + costs[1, b] + costs[2, c] for a in range(4) for b in range(4) for c in range(4) if a + b + c == 3)
    cost, chosen = simhash.allocate(costs, 3)
    assert cost == best and sum(t + 1 for t in chosen) == 3


def brute_repeats(rows):
    seen, out, by = set(), {}, {}
    for k, t in rows:
        by.setdefault(k, set()).add((t or "").encode())
    for k in sorted(by, key=lambda k: (k is None, k)):
        new = set()
        for raw in by[k]:
            mark = bytearray(len(raw))
            for i in range(len(raw) - 49):
                if k is not None and raw[i : i + 50] in seen:
                    mark[i : i + 50] = b"\1" * 50
                new.add(raw[i : i + 50])
            runs = sum(1 for i, m in enumerate(mark) if m and (i == 0 or not mark[i - 1]))
            out[k] = (sum(mark), runs, hashlib.sha256(bytes(b for b, m in zip(raw, mark) if not m)).hexdigest())
        if k is not None:
            seen |= new
    return out


@pytest.mark.parametrize("hot", [substrings.HOT, 2])
def test_repeats_equal_brute_force(spark, hot):
    docs = odd(spark)
    want = brute_repeats([tuple(r) for r in docs.select("doc_id", "text").collect()])
    out = substrings.remove_repeats(docs, hot=hot)
    assert [c for c in docs.columns if c != "kept"] == out.columns[:-3]
    got = out.select("doc_id", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    assert len(got) == docs.count() and all(tuple(r)[1:] == want[r[0]] for r in got)
    assert substrings.remove_repeats(empty(spark)).count() == 0


def test_text_longer_than_the_place_bits(monkeypatch):
    r = random.Random(5)
    raw = np.frombuffer(bytes(r.choice(b"abcd ") for _ in range(60_000)), np.uint8)
    whole = substrings.contexts(raw, np.array([len(raw)]))
    starts = set()
    for _, at, count, *_ in zip(*whole):
        starts |= set(range(at, at + count))
    assert starts == set(range(len(raw) - 49))


def test_messages_hold_every_window_once(monkeypatch):
    """Texts of any length are cut into parts of CHUNK bytes; places and bytes of all windows come back from the packed messages."""
    monkeypatch.setattr(substrings, "CHUNK", 5000)
    monkeypatch.setattr(substrings, "MESSAGE", 12_000)
    r = random.Random(8)
    texts = {k: "".join(r.choice("abcé ") for _ in range(n)) for k, n in ((3, 30_000), (1 << 40, 49), (-5, 50), (7, 5000), (8, 4990), (9, 700))}
    texts[11] = texts[7]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(texts), "text": list(texts.values())})
    seen = []
    for b in substrings._messages(7, np.zeros(0, np.uint64))(iter([batch])):
        for data in b.column("data").to_pylist():
            own, index, place, count, _, body = substrings._unpack(data, *substrings._KINDS)
            at = 0
            for k, p, n in zip(own[substrings._sums(index)].tolist(), substrings._sums(place).tolist(), count.tolist()):
                assert bytes(body[at : at + n + 49]) == texts[k].encode()[p : p + n + 49]
                seen += [(k, p + i) for i in range(n)]
                at += n + 49
            assert at == len(body)
    assert sorted(seen) == sorted((k, i) for k, t in texts.items() for i in range(len(t.encode()) - 49))


def test_repeat_groups_by_brute_force():
    r = random.Random(2)
    for _ in range(20):
        texts = [bytes(r.choice(b"ab") for _ in range(r.randint(6, 30))) for _ in range(6)]
        rows = np.zeros((6, enhanced.DEPTH), np.uint8)
        for i, t in enumerate(texts):
            rows[i, : len(t)] = list(t)
        sizes = np.array([len(t) for t in texts])
        row, start, lcp = enhanced.sort_suffixes(rows, sizes, 4)
        suffixes = [texts[a][b:] for a, b in zip(row, start)]
        assert suffixes == sorted(suffixes)
        left = np.array([rows[a, b - 1] if b else -1 - i for i, (a, b) in enumerate(zip(row, start))], np.int64)
        got = {(suffixes[f][:n], l - f + 1, w) for f, l, n, w, _ in enhanced.repeat_groups(lcp, row, left, 4).tolist()}
        want, places = set(), {}
        for i, t in enumerate(texts):
            for b in range(len(t) - 3):
                for n in range(4, len(t) - b + 1):
                    places.setdefault(t[b : b + n], []).append((i, b))
        for s, at in places.items():
            after = {texts[i][b + len(s) : b + len(s) + 1] or (i, b) for i, b in at}
            before = {texts[i][b - 1 : b] or (i, b) for i, b in at}
            if len(at) > 1 and len(after) > 1 and len(before) > 1:
                want.add((s, len(at), min(i for i, _ in at)))
        assert got == want


def test_shards(spark):
    docs = odd(spark)
    out = sharding.shard_documents(docs, shards=4, range_bytes=20_000)
    assert out.columns[: len(docs.columns) - 3] == [c for c in docs.columns if c not in ("size", "shard", "slot")]
    rows = out.collect()
    assert Counter((r.doc_id, r.text) for r in rows) == Counter((r.doc_id, r.text) for r in docs.collect())
    sizes = Counter()
    for s in range(4):
        mine = [r for r in rows if r.shard == s]
        assert sorted(r.slot for r in mine) == list(range(len(mine)))
    for r in rows:
        raw = (r.text or "").encode()
        assert r["size"] == len(raw) + 1 and r.text_crc32 == zlib.crc32(raw) and r.law == "bytes" and r.grown_shard is None
        sizes[r.shard] += r["size"]
    longest = max(r["size"] for r in rows)
    assert max(sizes.values()) - sum(sizes.values()) / 4 <= longest
    assert sharding.shard_documents(empty(spark)).count() == 0


def test_a_hot_group_is_split(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "the same text").otherwise(F.concat(F.lit("text "), "id")).alias("text"))
    rows = sharding.shard_documents(docs, shards=8, range_bytes=1000).groupBy("shard").agg(F.sum("size").alias("s")).collect()
    sizes = [r.s for r in rows]
    assert len(sizes) == 8 and max(sizes) - min(sizes) < 0.02 * sum(sizes) / 8 + 40


def brute_quality(rows, limits):
    lines = lambda t: [x for x in (t or "").split("\n") if WORD.search(x)]
    norm = lambda x: " ".join(WORD.findall(x)).lower()
    seen, texts = {}, {}
    for _, t, host in set(rows):
        texts.setdefault(host or "", set()).add(t or "")
        for x in lines(t):
            seen.setdefault((host or "", norm(x)), set()).add(t or "")
    gone = {k for k, v in seen.items() if len(v) >= limits.least and len(v) > limits.share * len(texts[k[0]])}
    out = {}
    for key, t, host in rows:
        w, ls = WORD.findall(t or ""), lines(t)
        win = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        cover = {i + j for i in range(len(w) - 4) if win[tuple(w[i : i + 5])] > 1 for j in range(5)}
        removed = sum(len(WORD.findall(x)) for x in ls if (host or "", norm(x)) in gone)
        failed = len(w) < 10 or 100 * len(cover) > 20 * len(w)
        depleted = removed > limits.depleted * len(w) or (removed > 0 and len(w) - removed < limits.words)
        out[(key, t, host)] = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(ls) - len(set(ls)), len(cover), failed, removed, not failed and not depleted)
    return out


def test_quality_equals_brute_force(spark):
    docs, limits = odd(spark), quality.Limits(least=3, share=0.2)
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    want = brute_quality(rows, limits)
    out = quality.quality(docs, limits=limits)
    got = out.withColumn("raw", F.lit(0)).select("doc_id", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed_words", "kept").collect()
    assert Counter((r[0], r[1], *tuple(r)[2:]) for r in got) == Counter((k, h, *want[(k, t, h)]) for k, t, h in rows)
    assert any(r.removed_words for r in got) and all("Shared closing line" not in (r.text or "") for r in out.where("source = 's0'").collect())
    assert quality.quality(empty(spark)).count() == 0
    assert out.where("kept").count() == sum(want[r][-1] for r in rows)


@pytest.mark.parametrize("name", ["op4_licence_scan", "op5_line_frequency", "op10_histogram_sort"])
def test_native_plans(spark, name):
    from barline.llm import queries

    plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not re.search(r"Python|Pandas|ArrowEval|MapInArrow", plan)


def brute_alike(rows):
    sets = {}
    for k, t in rows:
        w = [x.encode() for x in WORD.findall("".join(c.lower() if c.isascii() else c for c in t or ""))]
        sets[k] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))
    alike = [(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    return union(sorted(sets), alike), alike


@pytest.mark.parametrize("ranked", [shingles.RANKED, 0])
def test_stage_near_dedup_links_five_word_shingles(spark, monkeypatch, ranked):
    import corpus_pipeline

    monkeypatch.setattr(shingles, "RANKED", ranked)
    r = random.Random(11)
    base = [" ".join(f"w{r.randint(0, 5000)}" for _ in range(120)) for _ in range(3)]
    rows = [(None, b) for b in base]
    for b in base:
        for edits in [1] * 8 + [2] * 8 + [3] * 4 + [6] * 4:
            w = b.split()
            for _ in range(edits):
                w[r.randrange(len(w))] = f"new{r.randint(0, 10**9)}"
            rows.append((None, " ".join(w)))
    rows += [(None, t) for t in (None, "", "one", "One", "one two three four five six", base[0], base[1][:300])]
    r.shuffle(rows)
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    top, alike = brute_alike(rows)
    prints = dict((k, brute_print(t)) for k, t in rows)
    assert any((prints[a] ^ prints[b]).bit_count() > 2 for a, b in alike)
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(4)
    got = {x.doc_id: x.component_id for x in shingles.near_duplicates(docs).collect()}
    assert got == top
    assert {x.doc_id for x in corpus_pipeline.near_dedup(spark, docs, "").collect()} == set(top.values())


def test_near_dedup_leaves_no_candidates_behind(spark):
    import os

    from barline.session import work_dir

    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*words[:30], f"x{i % 3}", *words[30:]]), "en", "s", 0) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    folder = os.path.join(work_dir(spark), "barline-llm")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    shingles.near_duplicates(docs).collect()
    left = {x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before}
    assert not left & {"shingle-counts", "shingle-prefixes", "shingle-near", "shingle-pairs", "shingle-rest", "shingle-sets"}


def test_near_dedup_pairs_close_fingerprints(spark):
    words = [f"w{i}" for i in range(400)]
    apart = [f"v{i}" for i in range(300)]
    rows = [(i, " ".join([*words, *[f"x{j}" for j in range(i)]])) for i in range(3)] + [(10 + i, " ".join([*apart[: 300 - i], *[f"y{j}" for j in range(i)]])) for i in (0, 30)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    p = shingles.prints(docs, "text", "doc_id")
    nodes = p.selectExpr("node", "__key as first", "fp")
    fp = {x["first"]: (x["node"], x["fp"]) for x in nodes.collect()}
    assert all(fp[k][1] == simhash.majority(shingles.shingle_set(t.encode())) for k, t in rows)
    assert (fp[0][1] ^ fp[1][1]).bit_count() <= 2 < (fp[10][1] ^ fp[40][1]).bit_count()
    got = {(x.a, x.b) for x in shingles.simhash_pairs(nodes).collect()}
    assert got and got <= {(min(fp[a][0], fp[b][0]), max(fp[a][0], fp[b][0])) for a in (0, 1, 2) for b in (0, 1, 2) if a != b}
    assert {x.doc_id: x.component_id for x in shingles.near_duplicates(docs).collect()} == {0: 0, 1: 0, 2: 0, 10: 10, 40: 10 if brute_alike(rows[3:])[1] else 40}


def test_shared_prefixes_are_those_of_several_sets(spark):
    r = random.Random(5)
    rows = [(h, node, (h + node) % 3, 9) for h in range(40) for node in r.sample(range(8), r.randint(1, 4)) for _ in range(r.randint(1, 3))]
    want = set()
    for h in range(40):
        own = {x for x in rows if x[0] == h}
        least = min((pos, node, n) for _, node, pos, n in own)
        want |= {(*x, least) for x in own} if len({x[1] for x in own}) > 1 else set()
    d = shingles.shared_prefixes(spark.createDataFrame(rows, "h bigint, node bigint, pos int, n int"))
    assert d._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    got = [(x.h, x.node, x.pos, x.n, tuple(x.rep)) for x in d.collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) < len(set(rows))


@pytest.mark.parametrize("bits", [shingles.MARKS, 64])
def test_sets_are_found_without_a_shuffle_of_texts(spark, monkeypatch, bits):
    monkeypatch.setattr(shingles, "MARKS", bits)
    texts = {i: " ".join(f"w{i % 30}x{j}" for j in range(12 + i % 30)) for i in range(90)}  # three copies of each
    docs = spark.createDataFrame([*texts.items(), (None, texts[0])], "doc_id bigint, text string")
    nodes = spark.createDataFrame(shingles.prints(docs, "text", "doc_id").groupBy("node").agg(F.min("__key").alias("first")).collect(), "node bigint, first bigint")
    d = shingles.sets_of(docs, nodes.where("first % 7 = 3"), "text", "doc_id")
    shuffled = [line for line in d._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in line]
    assert shuffled and not any("text" in line for line in shuffled)
    got = {x.node: {v % 2**64 for v in x.own} for x in d.collect()}
    own = {i: shingles.shingle_set(texts[i].encode()) for i in range(3, 30, 7)}
    assert got == {np.uint64(shingles._node(s)).astype(np.int64).item(): set(s.tolist()) for s in own.values()}
