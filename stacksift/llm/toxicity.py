"""Toxicity by cumulative-link ordinal regression on sparse text features."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stacksift.llm.common import bounded_sample, forget, materialize, renamed, slices, tidy

#: Most training texts of each label.
SAMPLE = 6000
#: Most features: those that tell toxic texts best.
FEATURES = 4000
#: A feature must be this many times as frequent in toxic texts, with this log-likelihood ratio (G squared).
LIFT, EVIDENCE = 6.0, 25.0
#: Toxic texts with at most so many marked words have grade 1 and 2; the others have grade 3. See fit().
GRADE_BOUNDS = (2, 5)
PREFIXES = (4, 5, 6)
#: Words whose weights one Python worker keeps; a full memory is emptied.
MEMORY = 100_000

words = re.compile(r"[^\W\d_]+").findall


def features_of(word: str) -> list[str]:
    """The word itself and its first letters, marked by a star."""
    return [word, *(word[:k] + "*" for k in PREFIXES if len(word) >= k)]


def weighted_features(text: str | None) -> dict[str, float]:
    """Feature -> sum over its words of log(1 + count)."""
    out: dict[str, float] = {}
    for w, n in Counter(words((text or "").lower())).items():
        for f in features_of(w):
            out[f] = out.get(f, 0.0) + math.log1p(n)
    return out


@dataclass
class OrdinalModel:
    """P(grade > k) = sigmoid(w . x - thresholds[k]), with one weight vector and ascending thresholds.

    A text is called toxic where P(grade > 0) is cutoff or more.
    """

    weights: dict[str, float]
    thresholds: list[float]
    cutoff: float = 0.5

    def __post_init__(self) -> None:
        self.lengths = sorted({len(f) - 1 for f in self.weights if f.endswith("*")})
        self.memo: dict[str, float] = {}

    def weight(self, word: str) -> float:
        """Sum of the weights of a word's features."""
        get = self.weights.get
        return get(word, 0.0) + sum(get(word[:k] + "*", 0.0) for k in self.lengths if len(word) >= k)

    def link(self, text: str | None) -> float:
        if len(self.memo) > MEMORY:
            self.memo.clear()
        total, memo = 0.0, self.memo
        for w, n in Counter(words((text or "").lower())).items():
            found = memo.get(w)
            if found is None:
                found = memo[w] = self.weight(w)
            if found:
                total += found * math.log1p(n)
        return total

    def above(self, text: str | None) -> list[float]:
        """P(grade > k) for k = 0, 1, ...; they sum to the expected severity."""
        eta = self.link(text)
        return [1 / (1 + math.exp(-min(30.0, max(-30.0, eta - t)))) for t in self.thresholds]


def fit_ordinal(x: list[dict[int, float]], grade: np.ndarray, width: int, levels: int, l2: float = 0.002, rounds: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending thresholds that maximise the likelihood, by Adam on the whole sample."""
    row = np.repeat(np.arange(len(x)), [len(d) for d in x])
    col = np.array([k for d in x for k in d], dtype=np.int64)
    val = np.array([v for d in x for v in d.values()])
    weight = 1 / len(x)
    # thresholds = t0, t0 + exp(g1), ...: ordered whatever the parameters
    p = np.concatenate([np.zeros(width), [1.0], np.zeros(levels - 2)])
    m, v = np.zeros_like(p), np.zeros_like(p)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for step in range(1, rounds + 1):
        w, gaps = p[:width], np.exp(p[width + 1 :])
        theta = p[width] + np.concatenate([[0.0], gaps.cumsum()])
        eta = np.bincount(row, weights=w[col] * val, minlength=len(x))
        up = np.hstack([np.ones((len(x), 1)), sigmoid(eta[:, None] - theta), np.zeros((len(x), 1))])  # P(grade >= k)
        i = np.arange(len(x))
        a, b = up[i, grade], up[i, grade + 1]
        prob = np.maximum(a - b, 1e-9)
        da, db = a * (1 - a) / prob, b * (1 - b) / prob
        d_eta = -weight * (da - db)
        d_theta = np.zeros(levels - 1)
        np.add.at(d_theta, grade[grade > 0] - 1, weight * da[grade > 0])
        np.add.at(d_theta, grade[grade < levels - 1], -weight * db[grade < levels - 1])
        g = np.concatenate([np.bincount(col, weights=d_eta[row] * val, minlength=width) + l2 * w, [d_theta.sum()], d_theta[::-1].cumsum()[::-1][1:] * gaps])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        p = p - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return p[:width], p[width] + np.concatenate([[0.0], np.exp(p[width + 1 :]).cumsum()])


def best_cutoff(p: np.ndarray, toxic: np.ndarray) -> float:
    """The probability that tells the two labels best, both weighing alike: the middle, in log odds, of the widest best gap."""
    order = np.argsort(p, kind="stable")
    p, toxic = np.clip(p[order], 1e-9, 1 - 1e-9), toxic[order]
    missed, flagged = np.concatenate([[0], (toxic == 1).cumsum()]), np.concatenate([[0], (toxic == 0).cumsum()])
    right = (1 - missed / max(1, missed[-1])) + flagged / max(1, flagged[-1])  # with the first i texts called clean
    odds = np.concatenate([[-25.0], np.log(p / (1 - p)), [25.0]])
    gap = np.diff(odds)
    right[gap <= 0] = -1
    i = max(np.flatnonzero(right >= right.max() - 1e-12), key=lambda k: gap[k])
    return float(1 / (1 + np.exp(-(odds[i] + odds[i + 1]) / 2)))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> OrdinalModel:
    """Learns from a bounded sample: at most `sample` texts of each label (the first by a hash of doc_id).

    Features are those that are LIFT times as frequent in toxic texts. Labels say toxic or not; severity
    grades of toxic texts come from how many of their words carry a marking feature: GRADE_BOUNDS. The
    sample is halved by a hash of the text, and a text's words are counted with the features that mark
    toxicity in the other half, so a text never grades itself. The cutoff is the one that tells the labels best.

    A doc_id with both labels counts as toxic; null labels and texts are left out. Without toxic texts the
    model finds nothing toxic. The sample's texts are fetched once and their features are taken on the
    executors; the driver gets their counts and the sample's features, bounded as it is.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = F.broadcast(bounded_sample(known, "toxic", "doc_id", sample).drop("rn"))  # at most 2 * sample rows
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").where(F.col("text").isNotNull()).select("toxic", "text")
    rows = materialize(rows.withColumn("key", F.xxhash64("text")).dropDuplicates(["toxic", "key"]).withColumn("half", F.pmod("key", F.lit(2)).cast("int")), "sample")

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"toxic": b["toxic"], "half": b["half"], "f": [sorted(weighted_features(t)) for t in b["text"]]})

    size = {(r["toxic"], r["half"]): r["n"] for r in rows.groupBy("toxic", "half").agg(F.count("*").alias("n")).collect()}
    if not any(toxic for toxic, _ in size):
        forget(rows)
        return OrdinalModel({}, [30.0] * (len(GRADE_BOUNDS) + 1))
    each = rows.select("toxic", "half", "text").mapInPandas(extract, "toxic int, half int, f array<string>")
    cells = [(toxic, half) for toxic in (1, 0) for half in (0, 1)]
    seen = each.select("toxic", "half", F.explode("f").alias("f")).groupBy("f").agg(*[F.count_if((F.col("toxic") == t) & (F.col("half") == h)).alias(f"n{t}{h}") for t, h in cells])

    def marks(halves: tuple[int, ...]) -> tuple[Column, Column]:
        """Whether a feature marks toxic texts in these halves, and how much it tells."""
        bad, good = (sum(size.get((t, h), 0) for h in halves) for t in (1, 0))
        a, b = (sum((F.col(f"n{t}{h}") for h in halves), F.lit(0)) for t in (1, 0))
        lift = (a + 0.5) / (bad + 1) / ((b + 0.5) / (good + 1))
        rate = F.greatest(a + b, F.lit(1e-9)) / max(1, bad + good)
        part = lambda n, of: n * F.log(F.greatest(n, F.lit(1e-9)) / (rate * max(of, 1)))
        return (2 * (part(a, bad) + part(b, good)) >= EVIDENCE * len(halves) / 2) & (lift >= LIFT), a * F.log(lift)

    top = seen.where(marks((0, 1))[0]).orderBy(F.desc(marks((0, 1))[1]), "f").limit(FEATURES)
    found = sorted((r["f"], r["m0"], r["m1"]) for r in top.select("f", marks((0,))[0].alias("m0"), marks((1,))[0].alias("m1")).collect())
    place = {f: i for i, (f, _, _) in enumerate(found)}
    marking = [{f for f, *m in found if m[half]} for half in (0, 1)]

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            kept = [{place[f]: v for f, v in weighted_features(t).items() if f in place} for t in b["text"]]
            marked = [sum(n for w, n in Counter(words(t.lower())).items() if any(f in marking[1 - h] for f in features_of(w))) for t, h in zip(b["text"], b["half"], strict=True)]
            yield pd.DataFrame({"toxic": b["toxic"], "key": b["key"], "marked": marked, "k": [list(d) for d in kept], "v": [list(d.values()) for d in kept]})

    data = rows.mapInPandas(encode, "toxic int, key long, marked int, k array<int>, v array<double>").toPandas().sort_values(["toxic", "key"])
    forget(rows)
    toxic = data["toxic"].to_numpy()
    grade = np.where(toxic == 1, 1 + sum((data["marked"].to_numpy() > b).astype(int) for b in GRADE_BOUNDS), 0)
    x = [dict(zip(k, v, strict=True)) for k, v in zip(data["k"], data["v"], strict=True)]
    w, theta = fit_ordinal(x, grade, len(found), len(GRADE_BOUNDS) + 2)
    eta = np.array([sum(w[i] * v for i, v in d.items()) for d in x])
    cutoff = best_cutoff(1 / (1 + np.exp(-np.clip(eta - theta[0], -30, 30))), toxic)
    return OrdinalModel({f: float(w[i]) for f, i in place.items() if abs(w[i]) > 1e-4}, theta.tolist(), cutoff)


def score(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """docs with p_toxic = P(grade > 0), severity = expected grade, toxic (p_toxic of the model's cutoff or more) and grade: 0
    where not toxic, else the median grade (all k with P(grade > k) of a half or more), 1 at least.

    Null and empty texts get the scores of a text without features. Equal texts get equal scores; other
    columns, repeated rows and empty tables pass through, input columns named as the results as
    <name>_input. Nothing is shuffled; the model has a bounded size.
    """
    docs = renamed(docs, "p_toxic", "severity", "grade", "toxic")
    shared, names = docs.sparkSession.sparkContext.broadcast(model), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                up = np.array([shared.value.above(t) for t in b.column("text").to_pylist()]).reshape(b.num_rows, -1)
                grade = np.where(up[:, 0] >= shared.value.cutoff, np.maximum(1, (up >= 0.5).sum(axis=1)), 0).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(up[:, 0]), pa.array(up.sum(axis=1)), pa.array(grade), pa.array(grade > 0)], [*names, "p_toxic", "severity", "grade", "toxic"])

    fields = [("p_toxic", T.DoubleType()), ("severity", T.DoubleType()), ("grade", T.IntegerType()), ("toxic", T.BooleanType())]
    return docs.mapInArrow(tidy(run), T.StructType([*docs.schema.fields, *(T.StructField(*f) for f in fields)]))
