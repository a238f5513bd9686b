"""Toxic passages by maximum-scoring segments over token log-odds.

A bounded sample of labelled documents gives every word a log-odds ratio of toxic and other
documents under a Dirichlet prior: a word's prior is the estimate of its longest known
beginning, that one's of the next shorter, and the first's the share of all toxic documents.
Words of both kinds of evidence count, and words never seen are read by their beginnings.  A
constant is taken off every word's ratio so that words without evidence end a passage.  All
maximal scoring segments of a text are found in linear time (Ruzzo and Tompa, 1999), and
extreme-value statistics (Karlin and Altschul, 1990) turn segment sums into excesses over what
chance gives a text of that length.  A logistic curve over the best sum, the total excess and
the length maps a text to a score in [0, 1].  When documents of the sample are scored to fit
rate and curve, their own counts are left out.

Edge cases: null and empty texts have no words and the score of no evidence; repeated rows
score alike; labels for unknown documents, and null labels, are ignored; without any labelled
document of either kind every score is 0; an empty table gives no rows; extra columns are not
read.
"""

from __future__ import annotations

import functools
import itertools
import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.llm.common import checkpointed, mapped, packed, slices

#: Labelled documents to fit on at most, chosen by a hash of their id.
SAMPLE = 20_000
#: Lengths of word beginnings used beside whole words.
BEGINNINGS = (2, 3, 4, 5, 6, 8)
#: Documents that a prior counts for, the least documents of a feature (rarer ones are read by
#: their beginnings), and what is taken off every word's log-odds ratio.
PRIOR, LEAST_DOCS, DRIFT = 10.0, 5, 1.0
#: Karlin-Altschul constant K: chances for a segment to start, for each word.
START_RATE = 0.1

WORD = re.compile(r"\w+")


def features(word: str) -> list[str]:
    """The beginnings of a word, which carry a mark, from short to long, and the word itself."""
    return [*(f"{word[:k]}*" for k in BEGINNINGS if len(word) > k), word]


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def log_odds(share: float, root: float) -> float:
    """Log-odds ratio of a share of toxic documents to that of all, less the drift."""
    return math.log(share / (1 - share)) - math.log(root / (1 - root)) - DRIFT


@dataclass
class Lexicon:
    """Documents of each kind that have a feature (bounded by the sample), and of all."""

    counts: dict[str, tuple[int, int]] = field(default_factory=dict)
    other: int = 0
    toxic: int = 0

    @property
    def root(self) -> float:
        return self.toxic / (self.toxic + self.other)

    def ratio(self, word: str, own: int | None = None, prior: float = PRIOR) -> float:
        """A word's log-odds ratio; ``own`` is the kind of a document whose counts are left out."""
        share = self.root
        for f in features(word):
            known = self.counts.get(f)
            if known:
                b, a = known[0] - (own == 0), known[1] - (own == 1)
                share = (a + prior * share) / (a + b + prior)
        return log_odds(share, self.root)

    def values(self, prior: float = PRIOR) -> dict[str, float]:
        """The log-odds ratio of every feature, each below its longest known beginning."""
        shares = {"": self.root}
        for f in sorted(self.counts, key=lambda f: (not f.endswith("*"), len(f))):
            length = len(f) - f.endswith("*")
            parent = next((g for n in reversed(BEGINNINGS) if n < length and (g := f"{f[:n]}*") in shares), "")
            other, toxic = self.counts[f]
            shares[f] = (toxic + prior * shares[parent]) / (toxic + other + prior)
        return {f: log_odds(share, self.root) for f, share in shares.items()}


@dataclass
class Model:
    """What scoring needs: ratios by feature, the decay rate of segment sums, and the logistic curve."""

    values: dict[str, float] = field(default_factory=dict)
    rate: float = 1.0
    curve: tuple[float, ...] = ()

    def score(self, word: str) -> float:
        """A word's ratio, or that of its longest known beginning."""
        s = self.values.get(word)
        if s is None:
            s = next((self.values[f] for n in reversed(BEGINNINGS) if len(word) > n and (f := f"{word[:n]}*") in self.values), None)
        return self.values[""] if s is None else s

    def scores(self, words: list[str]) -> list[float]:
        known, score = self.values.get, self.score
        return [s if (s := known(w)) is not None else score(w) for w in words]

    def floor(self, n: int) -> float:
        """The sum, times the rate, that the best segment of ``n`` words without toxicity has by chance."""
        return math.log(START_RATE * max(n, 1) + 1)

    def evidence(self, segments: list[tuple[int, int, float]], n: int) -> tuple[float, float, float]:
        """Best sum and total excess of the significant segments, and the text's length, all on log scales."""
        sums, floor = [self.rate * s for *_, s in segments], self.floor(n)
        return max(sums, default=0.0), math.log1p(sum(x - floor for x in sums if x > floor)), math.log(max(n, 1))

    def probability(self, evidence: tuple[float, float, float]) -> float:
        if not self.curve:
            return 0.0
        x = sum(w * v for w, v in zip(self.curve, (*evidence, 1.0), strict=True))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, x))))

    def judged(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        """Score of a text and its significant passages as (start word, end word, excess)."""
        words = words_of(text)
        found, floor = maximal_segments(self.scores(words)) if self.curve else [], self.floor(len(words))
        return self.probability(self.evidence(found, len(words))), [(a, b, self.rate * s - floor) for a, b, s in found if self.rate * s > floor]


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments as (start, end, sum), by the linear scan of Ruzzo and Tompa.

    Every candidate names the last one before it that begins at a lower total, so a search hops
    over those in between; where there is none, all candidates so far are final.
    """
    total, final, stack = 0.0, [], []  # candidates: (start, end, total before, total after, place of the last that begins lower)
    for k, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        start = k
        j = len(stack) - 1
        while True:
            while j >= 0 and stack[j][2] >= before:
                j = stack[j][4]
            if j < 0:
                final += stack
                stack = [(start, k + 1, before, total, -1)]
                break
            if stack[j][3] >= total:
                stack.append((start, k + 1, before, total, j))
                break
            start, _, before, _, lower = stack[j]
            del stack[j:]
            j = lower
    return [(a, b, after - before) for a, b, before, after, _ in final + stack]


def held_out(doc_id: Column) -> Column:
    """Whether the id's CRC-32 leaves 0 when divided by 5; such rows are never learned from."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)) == 0


def _counted(sample: DataFrame) -> DataFrame:
    """For each feature the number of toxic and other documents that have it."""

    def made(part: pd.DataFrame) -> pd.DataFrame:
        found, forms = (Counter(), Counter()), functools.cache(features)
        for text, toxic in zip(part.text, part.toxic, strict=True):
            found[toxic].update(set(itertools.chain.from_iterable(map(forms, set(words_of(text))))))
        names = list(found[0] | found[1])
        return pd.DataFrame({"feature": names, "other": [found[0][f] for f in names], "toxic": [found[1][f] for f in names]})

    counts = mapped(sample, made, "feature string, other long, toxic long")
    return counts.groupBy("feature").agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic"))


def decay_rate(scores: Counter) -> float:
    """The root of E[exp(rate * score)] = 1 for word scores of texts without toxicity."""
    values = np.array(list(scores), float)
    shares = np.array(list(scores.values()), float) / max(1, sum(scores.values()))
    if not (values > 0).any() or values @ shares >= 0:
        return 1.0
    low, high = 1e-6, 1.0
    while shares @ np.exp(np.minimum(values * high, 700)) < 1 and high < 50:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if shares @ np.exp(np.minimum(values * mid, 700)) < 1 else (low, mid)
    return high


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, ...]:
    """Weights of the columns of ``x`` and the offset of a logistic curve, by Newton steps with a light ridge."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    u, w = np.column_stack([(x - mean) / scale, np.ones(len(x))]), np.zeros(x.shape[1] + 1)
    light = np.append(np.full(x.shape[1], ridge), 1e-6) * len(x)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(u @ w, -30, 30)))
        step = np.linalg.solve(u.T @ (u * (p * (1 - p))[:, None]) + np.diag(light), u.T @ (y - p) - light * w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    slopes = w[:-1] / scale
    return (*map(float, slopes), float(w[-1] - slopes @ mean))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from at most ``sample`` labelled documents that are not held out.

    They are those with the least hash of their id: the same share of every kind of document,
    and all of them where fewer are labelled.  The sample is read once; features, the histogram
    of word scores and one row of evidence for each document come back from the executors.
    """
    marked = labels.filter(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    ids = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    chosen = checkpointed(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text", "toxic"))
    kinds = {r["toxic"]: r["n"] for r in chosen.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not kinds.get(0) or not kinds.get(1):
        return Model()
    counts = _counted(chosen).filter(F.col("other") + F.col("toxic") >= LEAST_DOCS).collect()
    lexicon = Lexicon({r["feature"]: (r["other"], r["toxic"]) for r in counts}, kinds[0], kinds[1])
    model = Model()

    def tallied(part: pd.DataFrame) -> pd.DataFrame:
        words = Counter(itertools.chain.from_iterable(map(words_of, part.text)))
        found = Counter()
        for w, n in words.items():
            found[round(lexicon.ratio(w, 0), 1)] += n
        return pd.DataFrame({"score": list(found), "n": list(found.values())})

    tally = mapped(chosen.filter("toxic = 0"), tallied, "score double, n long").groupBy("score").agg(F.sum("n").alias("n")).collect()
    model.rate = decay_rate(Counter({r["score"]: r["n"] for r in tally}))

    def weighed(part: pd.DataFrame) -> pd.DataFrame:
        rows, ratio = [], functools.cache(lexicon.ratio)
        for text, toxic in zip(part.text, part.toxic, strict=True):
            words = words_of(text)
            rows.append((toxic, *model.evidence(maximal_segments([ratio(w, toxic) for w in words]), len(words))))
        return pd.DataFrame(rows, columns=["toxic", "best", "total", "length"])

    rows = mapped(chosen, weighed, "toxic int, best double, total double, length double").toPandas()
    rows = rows.sort_values(list(rows.columns))  # the order of tasks decides nothing
    curve = logistic(rows[["best", "total", "length"]].to_numpy(float), rows.toxic.to_numpy(float))
    return Model(lexicon.values(), model.rate, curve)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (doc_id, text) scored: score, predicted, and ``passages``, the significant segments as (start word, end word, excess)."""

    def made(part: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for doc_id, text in zip(part.doc_id, part.text, strict=True):
            p, passages = model.judged(text)
            rows.append((doc_id, p, int(p >= 0.5), [{"start": a, "end": b, "excess": x} for a, b, x in passages]))
        return pd.DataFrame(rows, columns=["doc_id", "score", "predicted", "passages"]).astype({"doc_id": "Int64"})

    schema = "doc_id long, score double, predicted int, passages array<struct<start:int,end:int,excess:double>>"
    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), made, schema)


def score_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    out = scored(docs, fit(docs, labels, sample))
    return out.select(
        "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted", F.size("passages").cast("long").alias("n_passages")
    )


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with all its columns, less the rows predicted toxic; texts are scored where they lie."""
    rows = packed(docs)

    def run(batches):
        for batch in slices(batches):
            mild = [model.judged(t)[0] < 0.5 for t in pc.struct_field(batch.column("row"), "text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row").filter(pa.array(mild, pa.bool_()))], names=["row"])

    return rows.mapInArrow(run, rows.schema).select("row.*")
