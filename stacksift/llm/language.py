"""Language identification: the language family first, then linear SVMs within it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stacksift.llm.common import bounded_sample, forget, give_back, materialize, renamed, slices, tidy

#: Families of languages by ISO 639-1 code. A language of no family here forms its own.
FAMILIES = {
    "germanic": "en de nl af sv da no nb nn is fy lb yi".split(),
    "romance": "fr es it pt ca gl ro oc".split(),
    "slavic": "ru uk be pl cs sk bg mk sr hr bs sl".split(),
    "uralic": "fi et hu".split(),
    "turkic": "tr az kk uz tk ky".split(),
    "celtic": "ga gd cy br".split(),
    "baltic": "lt lv".split(),
    "indo-aryan": "hi ur bn mr gu pa ne si".split(),
    "semitic": "ar he mt am".split(),
    "austronesian": "id ms jv su tl".split(),
}
UNKNOWN = "und"
#: Size of the hashed feature space.
WIDTH = 1 << 13
#: Most training documents of one language; the sample is taken by a hash of doc_id.
SAMPLE = 600
#: Most languages that are learned: those with most training documents.
LANGUAGES = 64
SCALE = 30.0


def family_of(language: str) -> str:
    return next((f for f, members in FAMILIES.items() if language in members), language)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


class Letters:
    """Maps code points to their lower-case letter, and all that are no letters to a space."""

    table: np.ndarray | None = None

    @classmethod
    def get(cls) -> np.ndarray:
        if cls.table is None:
            t = np.full(0x110000, 32, dtype=np.uint32)
            for c in np.flatnonzero(np.fromiter(map(str.isalpha, map(chr, range(0x110000))), dtype=bool, count=0x110000)).tolist():
                low = chr(c).lower()
                t[c] = ord(low) if len(low) == 1 else c
            cls.table = t
        return cls.table


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashed 1- to 3-grams of letters, their texts' numbers, whether a text has a letter).

    Runs of non-letters count as one space, and each text stands between two spaces.
    """
    whole = [" " + (t or "") + " " for t in texts]
    code = np.frombuffer("".join(whole).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    row = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) for t in whole])
    c = Letters.get()[code]
    keep = np.ones(len(c), dtype=bool)
    keep[1:] = (c[1:] != 32) | (c[:-1] != 32) | (row[1:] != row[:-1])
    c, row = c[keep], row[keep]
    letters = np.zeros(len(texts), dtype=bool)
    letters[row[c != 32]] = True
    shift = np.uint32(32 - WIDTH.bit_length() + 1)
    one = c * np.uint32(0x9E3779B1)
    two = (one[:-1] ^ (c[1:] + np.uint32(0x85EBCA6B))) * np.uint32(0xC2B2AE35)
    three = (two[:-1] ^ (c[2:] + np.uint32(0x27D4EB2F))) * np.uint32(0x165667B1)
    same2, same3 = row[1:] == row[:-1], row[2:] == row[:-2]
    alone = c != 32
    found = np.concatenate([one[alone], two[same2], three[same3]]) >> shift
    return found, np.concatenate([row[alone], row[:-1][same2], row[:-2][same3]]), letters


def frequencies(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, value, whether a text has a letter): sparse and in order of text and feature."""
    h, row, letters = grams(texts)
    count = np.bincount(row.astype(np.int64) * WIDTH + h, minlength=1)
    at = np.flatnonzero(count)
    text, feature = at // WIDTH, at % WIDTH
    total = np.maximum(1, np.bincount(row, minlength=len(texts)))
    return text, feature, count[at] * SCALE / total[text], letters


def train_svm(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, cost: float = 10.0, rounds: int = 12) -> np.ndarray:
    """Weights, with the bias last, of an L2-regularised hinge-loss SVM by dual coordinate descent.

    rows: (features, values) of each text. Classes weigh alike whatever their sizes. y holds -1 and 1.
    """
    w, alpha, norm = np.zeros(WIDTH + 1), np.zeros(len(rows)), np.array([v @ v + 1 for _, v in rows])
    top = cost * np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum())))
    order = np.random.default_rng(7)
    for _ in range(rounds):
        for i in order.permutation(len(rows)):
            f, v = rows[i]
            new = min(max(alpha[i] - (y[i] * (v @ w[f] + w[-1]) - 1) / norm[i], 0.0), top[i])
            step = (new - alpha[i]) * y[i]
            w[f] += step * v
            w[-1] += step
            alpha[i] = new
    return w


@dataclass
class LanguageModel:
    """columns[k] = (level, a, b): the k-th weight vector prefers a where positive, else b.

    At level "" a and b are families; b is None where a stands against all other families. Other levels
    are families, with pairs of their languages.
    """

    members: dict[str, list[str]]
    columns: list[tuple[str, str, str | None]] = field(default_factory=list)
    weights: np.ndarray | None = None

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        n = len(texts)
        if not self.members:  # nothing was learned
            return [UNKNOWN] * n, [0.0] * n
        text, feature, value, letters = frequencies(texts)
        families = sorted(self.members)
        family, sure = self.vote(self.margins("", text, feature, value, n), "", families, n)
        best, within = np.full(n, UNKNOWN, dtype=object), np.ones(n)
        for f in families:
            mine = np.array([x == f for x in family], dtype=bool)
            if mine.any():
                inside = mine[text]
                margin = self.margins(f, (mine.cumsum() - 1)[text[inside]], feature[inside], value[inside], int(mine.sum()))
                best[mine], within[mine] = self.vote(margin, f, self.members[f], int(mine.sum()))
        best[~letters] = UNKNOWN
        return best.tolist(), np.where(letters, sure * within, 0.0).tolist()

    def margins(self, level: str, text: np.ndarray, feature: np.ndarray, value: np.ndarray, n: int) -> dict[int, np.ndarray]:
        """Of each weight vector of this level, its margins for n texts."""
        mine = [k for k, c in enumerate(self.columns) if c[0] == level]
        return {k: np.bincount(text, weights=value * self.weights[k, feature], minlength=n) + self.weights[k, -1] for k in mine}

    def vote(self, margins: dict[int, np.ndarray], level: str, names: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
        """The name with most won comparisons (ties: larger sum of margins), and its confidence from 0.5 to 1."""
        won, total = np.zeros((n, len(names))), np.zeros((n, len(names)))
        least = np.full((n, len(names)), np.inf)
        for k, margin in margins.items():
            _, a, b = self.columns[k]
            for name, m in ((a, margin), (b, -margin)):
                if name is not None:
                    i = names.index(name)
                    won[:, i] += m > 0
                    total[:, i] += m
                    least[:, i] = np.minimum(least[:, i], m)
        top = np.lexsort((total, won), axis=1)[:, -1]
        sure = least[np.arange(n), top]
        return np.array(names, dtype=object)[top], np.where(np.isinf(sure), 1.0, 1 / (1 + np.exp(-np.clip(sure, 0, 30))))


def problems_of(members: dict[str, list[str]]) -> list[tuple[str, str, str | None]]:
    """The families against each other (two: one against the other; more: each against the rest), then all pairs of a family's languages."""
    names = sorted(members)
    first = [("", *names)] if len(names) == 2 else [("", f, None) for f in names if len(names) > 2]
    return first + [(f, a, b) for f in names for a, b in combinations(members[f], 2)]


def labelled(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "lang", "text").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))


def sample_features(rows: DataFrame, sample: int) -> DataFrame:
    """(lang, rn, k, features, values) of at most `sample` rows (doc_id, lang, text) of each language, by a hash of doc_id; k orders rows of one doc_id."""
    chosen = F.broadcast(bounded_sample(rows.select("lang", "doc_id"), "lang", "doc_id", sample))  # at most `sample` ids of a language
    texts = rows.join(chosen, ["lang", "doc_id"]).select("lang", "rn", F.xxhash64("text").alias("k"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                text, feature, value, _ = frequencies(b.column("text").to_pylist())
                edges = pa.array(np.concatenate([[0], np.bincount(text, minlength=b.num_rows).cumsum()]), pa.int32())
                lists = [pa.ListArray.from_arrays(edges, pa.array(x, t)) for x, t in ((feature, pa.int32()), (value, pa.float64()))]
                yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("rn"), b.column("k"), *lists], ["lang", "rn", "k", "features", "values"])

    return texts.mapInArrow(tidy(run), "lang string, rn int, k long, features array<int>, values array<double>")


def fit(docs: DataFrame, sample: int = SAMPLE, most_languages: int = LANGUAGES) -> LanguageModel:
    """Learns from doc_id (for the split), lang and text: SVMs of families, then one per pair of languages of a family.

    Bounds: the most_languages languages with most training documents, at most `sample` texts of each.
    Features are taken on the executors from the sample's texts; each SVM is trained there, from the features
    of at most 2 * sample texts (a few more where doc_ids repeat). Weights of a bounded size come to the driver.
    """
    rows = labelled(docs)
    top = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_languages)
    languages = sorted(r["lang"] for r in top.collect())
    members: dict[str, list[str]] = {}
    for name in languages:
        members.setdefault(family_of(name), []).append(name)
    problems = problems_of(members)
    model = LanguageModel(members, problems, np.zeros((len(problems), WIDTH + 1)))
    if not problems:
        return model
    sides = []  # which problems a language's texts take part in, on which side, and how many of them
    for k, (level, a, b) in enumerate(problems):
        for name, sign in ((a, 1), (b, -1)):
            who = [name] if level else [x for f in members if (f != a if name is None else f == name) for x in members[f]]
            sides += [(k, sign, x, -(-sample // len(who))) for x in who]
    plan = docs.sparkSession.createDataFrame(sides, "problem int, sign int, lang string, most int")

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["sign", "lang", "rn", "k"])
        w = train_svm(list(zip(pdf["features"], pdf["values"], strict=True)), pdf["sign"].to_numpy())
        out = pd.DataFrame({"problem": [int(pdf["problem"].iloc[0])], "w": [w.tobytes()]})
        del pdf
        give_back()
        return out

    features = materialize(sample_features(rows.where(F.col("lang").isin(languages)), sample), "features")
    found = features.join(F.broadcast(plan), "lang").where("rn <= most")
    for r in found.groupBy("problem").applyInPandas(train, "problem int, w binary").collect():
        model.weights[r["problem"]] = np.frombuffer(r["w"])
    forget(features)
    return model


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """docs with lang_pred and score: the text alone decides.

    Null, empty and letterless texts: `und` with score 0. Equal texts get equal results; other columns,
    repeated rows and empty tables pass through, input columns named lang_pred or score as <name>_input.
    Nothing is shuffled; the model has a bounded size.
    """
    docs = renamed(docs, "lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                best, score = shared.value.predict(b.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(best, pa.string()), pa.array(score, pa.float64())], [*names, "lang_pred", "score"])

    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(tidy(run), schema)
