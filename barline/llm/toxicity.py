"""Toxicity by weak supervision.

Voters are words (lexicon) and word beginnings (patterns) that labelled texts tie to toxicity beyond chance. A generative
label model estimates how often each voter speaks in toxic and clean texts, and the correlations between voters given
the class, which lower the weight of voters that say the same. A linear classifier is fitted to its posterior labels.
"""

from __future__ import annotations

from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barline.llm.store import saved, slices

#: Labelled rows that the model is fitted on, picked by the hash of their id.
TRAINING_ROWS = 12_000
#: Most voters, and the chance that any voter is one by luck.
VOTERS, LUCK = 512, 0.05
#: Share of toxic texts that a voter needs.
PURE = 0.8
STEMS = (4, 5, 6)
ROUNDS = 30
#: Weight of posteriors against labels, which may be wrong, in the rates of the voters.
TRUST = 0.03
_WORD = regex.compile(r"\p{L}+")


def features(text: str) -> set[str]:
    """Lower-case words of letters, and their first characters with a star."""
    words = set(_WORD.findall(text.lower()))
    return words | {w[:n] + "*" for w in words for n in STEMS if len(w) > n}


def signature(text: str) -> int:
    """Three smallest hashes of three words in a row: equal in most near copies, which then count once in training."""
    w = _WORD.findall(text.lower())
    shingles = [" ".join(x) for x in zip(w, w[1:], w[2:])] or [" ".join(w)]
    least = [min(xxhash.xxh64_intdigest(x, seed) for x in shingles) for seed in (1, 2, 3)]
    return xxhash.xxh64_intdigest(repr(least)) - (1 << 63)


@dataclass
class Model:
    voters: list[str]
    weights: np.ndarray
    bias: float

    def automaton(self) -> ahocorasick.Automaton | None:
        if not self.voters:
            return None
        a = ahocorasick.Automaton()
        for i, v in enumerate(self.voters):
            stem = v.endswith("*")
            word = v.rstrip("*")
            before = a.get(word, ())
            a.add_word(word, (*before, (i, len(word), stem)))
        a.make_automaton()
        return a


def votes(text: str, automaton: ahocorasick.Automaton | None) -> set[int]:
    """The voters that speak: the same as the features that are voters."""
    if automaton is None:
        return set()
    t = text.lower()
    out = set()
    for end, found in automaton.iter(t):
        for i, size, stem in found:
            if i not in out and (end - size < 0 or not _letter(t[end - size])) and (end + 1 < len(t) and _letter(t[end + 1])) == stem:
                out.add(i)
    return out


def _letter(c: str) -> bool:
    return c.isalpha()


def choose_voters(candidates: list[tuple[str, int, int]], most: int = VOTERS) -> list[str]:
    """Voters from (feature, toxic texts, texts), the purest first.

    A feature below a chosen stem adds nothing. A stem above chosen ones must be pure in what it adds to them.
    """
    chosen: dict[str, tuple[int, int]] = {}
    for f, a, m in sorted(candidates, key=lambda c: (-c[1] / c[2], -c[1], len(c[0]), c[0])):
        word = f.rstrip("*")
        if any(c.endswith("*") and word.startswith(c[:-1]) for c in chosen):
            continue
        below = [n for c, n in chosen.items() if f.endswith("*") and c.startswith(word)]
        if below and a - sum(n[0] for n in below) < PURE * (m - sum(n[1] for n in below)):
            continue
        chosen[f] = (a, m)
        if len(chosen) == most:
            break
    return list(chosen)


def label_model(x: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Posterior chance of toxicity for each row of votes ``x``; ``seed`` starts the classes.

    Expectation maximisation with the rates of each voter in both classes, each row counted by its label and, with
    the share TRUST, by its posterior. A silent voter abstains, but the silence of all is a vote too. After each round the residual
    correlations given the class discount a voter's evidence by 1 / (1 + the sum of its squared correlations).
    """
    silent = ~x.any(axis=1)
    p = seed.astype(float)
    for _ in range(ROUNDS):
        c = TRUST * p + (1 - TRUST) * seed
        n1, n0 = c.sum(), (1 - c).sum()
        r1, r0 = (c @ x + 0.1) / (n1 + 1), ((1 - c) @ x + 0.1) / (n0 + 1)
        e1, e0 = x - r1, x - r0
        cov = (e1.T * c) @ e1 / max(n1, 1) + (e0.T * (1 - c)) @ e0 / max(n0, 1)
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        corr = cov / np.outer(sd, sd)
        np.fill_diagonal(corr, 0)
        w = 1 / (1 + (corr**2).sum(axis=1))
        none = np.log((c @ silent + 0.1) / (n1 + 1)) - np.log(((1 - c) @ silent + 0.1) / (n0 + 1))
        odds = np.log(n1 + 1) - np.log(n0 + 1) + x @ (w * np.log(r1 / r0)) + silent * none
        q = 1 / (1 + np.exp(-odds.clip(-30, 30)))
        if np.abs(q - p).max() < 1e-6:
            break
        p = q
    return p


def fit_linear(x: np.ndarray, p: np.ndarray, ridge: float = 0.02, steps: int = 60) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by Newton's method; a tie of signs can't make a voter speak against toxicity."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    penalty = np.full(a.shape[1], ridge)
    penalty[-1] = 1e-4
    for _ in range(steps):
        m = 1 / (1 + np.exp(-(a @ w).clip(-30, 30)))
        h = (a.T * np.maximum(m * (1 - m), 1e-6)) @ a + np.diag(penalty)
        step = np.linalg.solve(h, a.T @ (m - p) + penalty * w)
        w -= step.clip(-2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return np.maximum(w[:-1], 0), float(w[-1])


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic") -> Model:
    """A model from at most about TRAINING_ROWS labelled rows; near copies count once. No toxic rows: no voters."""
    known = labels.where(F.col(label).isNotNull()).select(key, F.col(label).cast("int").alias("__y"))
    count = known.count()
    share = min(1.0, TRAINING_ROWS / max(count, 1))
    picked = known.where(F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1_000_000)) < share * 1_000_000)
    sample = docs.select(key, text).where(F.col(text).isNotNull()).join(picked, key)

    def signed(batches):
        for b in slices(batches):
            texts = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([signature(t) for t in texts], pa.int64()), b.column(0), b.column(1)], names=["sig", "t", "y"])

    rows = saved(sample.select(F.col(text), "__y").mapInArrow(signed, "sig bigint, t string, y int").dropDuplicates(["sig"]).drop("sig"), "labelled")

    def spoken(batches):
        for b in slices(batches):
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                f = list(features(t))
                yield pa.RecordBatch.from_arrays([pa.array(f, pa.string()), pa.array([y] * len(f), pa.int32())], names=["f", "y"])

    n, n1 = rows.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not n1 or n1 == n:
        return Model([], np.zeros(0), -4.0)
    base = n1 / n
    counts = rows.mapInArrow(spoken, "f string, y int").groupBy("f").agg(F.sum("y").alias("a"), F.count("*").alias("m")).where("a >= 3")
    counts = saved(counts, "features")
    tried = counts.count()
    # a feature of m texts with a toxic ones is luck at most C(m, a) base ** a times, over all features tried
    luck = F.col("a") * np.log(base) + F.when(F.col("a") < F.col("m"), (F.col("m") - F.col("a")) * (1 + F.log(F.col("m") / (F.col("m") - F.col("a"))))).otherwise(0.0)
    good = counts.where((luck < float(np.log(LUCK / max(tried * 20, 1)))) & (F.col("a") >= PURE * F.col("m"))).orderBy(F.desc("a"), "m", "f").limit(8 * VOTERS)
    voters = choose_voters([tuple(r) for r in good.select("f", "a", "m").collect()])
    model = Model(voters, np.zeros(len(voters)), 0.0)

    def spoke(batches):
        a = model.automaton()
        for b in slices(batches):
            got = [sorted(votes(t, a)) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(got, pa.list_(pa.int32()))], names=["y", "v"])

    seen = rows.mapInArrow(spoke, "y int, v array<int>").collect()  # at most about TRAINING_ROWS rows of few numbers
    x, y = np.zeros((len(seen), len(voters))), np.zeros(len(seen))
    for i, r in enumerate(seen):
        x[i, r["v"]] = 1
        y[i] = r["y"]
    p = label_model(x, y)
    model.weights, model.bias = fit_linear(x, p)
    return model


def score(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, score, predicted) of every whole text; predicted is 1 from 0.7 on.

    Null and empty texts get the score of a text without votes. Repeated rows give equal results; other columns are not
    read; an empty table gives no rows.
    """
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches):
        a = model.automaton()
        for b in slices(batches):
            s = np.array([model.bias + model.weights[sorted(votes(t or "", a))].sum() for t in b.column(1).to_pylist()])
            s = 1 / (1 + np.exp(-s.clip(-30, 30)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), pa.array((s >= 0.7).astype(np.int32))], names=[key, "score", "predicted"])

    return docs.select(key, text).mapInArrow(run, schema)
