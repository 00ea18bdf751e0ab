"""Rows that are hard on every operator."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, slot string, kept string, score string, fp string, ids string, bucket string, size string, shard string, w string, line string"


def odd_rows():
    r = random.Random(7)
    words = ["alpha", "beta", "gamma", "delta", "épsilon", "zeta,", "eta.", "Theta", "#iota", "kappa|", "日本", "ß"]
    texts = [None, "", " \t\n\x0b\f\r ", "one", "one two", "A b c", "a B c", "  a b c ", "x" * 49, "x" * 50, "x" * 130, "\n\n", "12 34 !?"]
    texts += [" ".join(r.choice(words) for _ in range(r.randint(5, 60))) + "\n" + "Shared closing line of this host." for _ in range(30)]
    long = " ".join(r.choice(words) + str(r.randint(0, 999)) for _ in range(20_000))
    texts += [long, long[:5000] + " changed " + long[5000:], long]
    passage = " ".join(r.choice(words) for _ in range(60))
    texts += [f"before {k} {passage} after {k}" for k in range(4)]
    texts += ["the same words again and again " * 4, "a b c d e a b c d e", "l1 x\nl1 x\nl2 y\nl1 x"]
    rows = [(i, t, r.choice(["en", "fr", None]), r.choice(["s0", "s0", "s1", None]), None, "c", "c", None, "c", "c", "c", "c", "c", None, "c") for i, t in enumerate(texts)]
    rows.append(rows[20])  # a repeated row
    rows.append((None, "a text without an id " * 3, *rows[0][2:]))
    return rows


def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(5)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
