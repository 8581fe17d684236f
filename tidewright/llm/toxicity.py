"""Toxicity by cumulative-link ordinal regression.

A text gets a severity grade 0 (harmless), 1 (toxic) or 2 (severe). One weight vector over sparse counts of words and
of word beginnings (4, 5 and 6 letters) is shared by both ordered thresholds: P(grade > k) = 1 / (1 + exp(bias_k - weights . x)), with bias_0 <= bias_1, and the
expected severity is P(grade > 0) + P(grade > 1). A text is toxic where P(grade > 0) is 0.5 or more.

Given tables label texts as toxic or not, and their quality as 0 or 1. The grade is taken from these labels alone: 0 where
a text isn't toxic, 1 where it is, 2 where it is toxic and its quality is labelled 0. Without a quality there is no 2.

The model is fitted on a bounded sample of labelled rows: at most `sample_rows` of each label, taken in the order of a
hash of the id; rows are weighted by what they stand for. At most `max_words` words become features.

Defined cases: null and empty texts have no words and get the severity of an empty text; rows whose label or id is
null are not used for fitting; a doc_id with several labels uses the highest; repeated rows are scored alike; with no
labels of both kinds, or no word that tells them apart, every severity is 0; a text of any length is scored whole.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, ragged, shielded, slices, table, texts_of, with_columns

WORD = re.compile(r"[^\W\d_]+")
STEMS = (4, 5, 6)
SAMPLE_ROWS, MAX_WORDS, LEAST_EVIDENCE, RIDGE = 10_000, 4_096, 10.8, 1e-3
#: Bytes of text whose features, as Python objects, are in memory at once.
COUNT_BYTES = 1 << 18
#: Counts of the sample that a step of the fit takes at once.
FIT_STEP = 1 << 16
GRADES = 3


def word_counts(raw: bytes) -> Counter:
    return Counter(WORD.findall(raw.decode("utf-8", "replace").lower()))


def features_of(word: str) -> list[str]:
    """The word and its beginnings, which inflected and joined words share."""
    return [word, *(word[:n] + "*" for n in STEMS if n <= len(word))]


def feature_counts(raw: bytes) -> Counter:
    found: Counter = Counter()
    for word, n in word_counts(raw).items():
        for f in features_of(word):
            found[f] += n
    return found


def known(raw: bytes, weights: dict) -> Counter:
    """feature_counts() of the features that have a weight."""
    found: Counter = Counter()
    for word, n in word_counts(raw).items():
        for f in features_of(word):
            if f in weights:
                found[f] += n
    return found


@dataclass
class Model:
    words: list[str] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: np.ndarray = field(default_factory=lambda: np.full(GRADES - 1, 40.0))

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k), a column for each threshold."""
        return 1 / (1 + np.exp(np.clip(self.bias[None, :] - score[:, None], -500, 500)))


def fit_ordinal(row: np.ndarray, col: np.ndarray, value: np.ndarray, grade: np.ndarray, weight: np.ndarray, n_words: int, rounds: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds of least weighted log loss, by Adam on all rows at once. Thresholds stay ordered as a first one and positive gaps."""
    n, k = len(grade), GRADES - 1
    weight = weight / weight.sum()
    free = np.zeros(n_words + k)
    free[n_words:] = [2.0] + [0.5] * (k - 1)
    m, v = np.zeros_like(free), np.zeros_like(free)
    over = grade[:, None] > np.arange(k)[None, :]
    parts = [(slice(at, at + FIT_STEP), int(row[at : at + FIT_STEP].min()), int(row[at : at + FIT_STEP].max()) + 1) for at in range(0, len(row), FIT_STEP)]
    for t in range(1, rounds + 1):
        w, raw = free[:n_words], free[n_words:]
        bias = np.concatenate([raw[:1], raw[:1] + np.cumsum(np.exp(raw[1:]))])
        score = np.zeros(n)
        for c, low, high in parts:
            score[low:high] += np.bincount(row[c] - low, value[c] * w[col[c]], high - low)
        p = np.clip(1 / (1 + np.exp(np.clip(bias[None, :] - score[:, None], -60, 60))), 1e-12, 1 - 1e-12)
        edge = np.concatenate([np.ones((n, 1)), p, np.zeros((n, 1))], axis=1)
        mass = np.maximum(edge[np.arange(n), grade] - edge[np.arange(n), grade + 1], 1e-12)
        slope = np.where(over & (grade[:, None] - 1 == np.arange(k)[None, :]), 1.0, 0.0) - np.where(grade[:, None] == np.arange(k)[None, :], 1.0, 0.0)
        g = weight[:, None] * slope * p * (1 - p) / mass[:, None]  # of the log likelihood, by score - bias_k
        by_row, gw = g.sum(axis=1), -2 * RIDGE / max(n_words, 1) * w
        for c, _, _ in parts:
            gw += np.bincount(col[c], value[c] * by_row[row[c]], n_words)
        gb = -g.sum(axis=0)
        graw = np.concatenate([[gb.sum()], [gb[j:].sum() * np.exp(raw[j]) for j in range(1, k)]])
        grad = np.concatenate([gw, graw])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        free = free + 0.05 * min(1.0, 3 * (1 - t / rounds)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    raw = free[n_words:]
    return free[:n_words], np.concatenate([raw[:1], raw[:1] + np.cumsum(np.exp(raw[1:]))])


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, max_words: int = MAX_WORDS) -> Model:
    """docs: doc_id, text; labels: doc_id, toxic, and quality if there is one."""
    low = F.coalesce(F.col("quality") <= 0, F.lit(False)) if "quality" in labels.columns else F.lit(False)
    known = labels.select(F.col("doc_id").alias("_id"), (F.col("toxic") > 0).cast("int").alias("_toxic"), low.alias("_low")).where("_id is not null and _toxic is not null")
    known = known.groupBy("_id").agg(F.max("_toxic").alias("_toxic"), F.max("_low").alias("_low")).select("_id", "_toxic", F.when(F.col("_low"), 2 * F.col("_toxic")).otherwise(F.col("_toxic")).alias("_grade"))
    totals = {r["_toxic"]: r["n"] for r in known.groupBy("_toxic").agg(F.count("*").alias("n")).collect()}
    if not (totals.get(0) and totals.get(1)):
        return Model()
    order = [F.xxhash64("_id"), F.col("_id")]
    sample = known.where("_toxic = 0").orderBy(*order).limit(sample_rows).unionByName(known.where("_toxic = 1").orderBy(*order).limit(sample_rows))
    # at most 2 * sample_rows ids, so the copy that each executor gets is of bounded size
    rows = docs.select(F.col("doc_id").alias("_id"), "text").join(F.broadcast(sample), "_id").select("_toxic", "_grade", "text")
    counts = T.MapType(T.StringType(), T.IntegerType())

    def count(_, data, starts):
        return {"words": pa.array([list(feature_counts(x).items()) for x in texts_of(data, starts)], pa.map_(pa.string(), pa.int32()))}

    rows = cut(with_columns(rows, count, [T.StructField("words", counts)], most=COUNT_BYTES).drop("text"))
    seen = {r["_toxic"]: r["n"] for r in rows.groupBy("_toxic").agg(F.count("*").alias("n")).collect()}
    a, b = seen.get(1, 0), seen.get(0, 0)
    if not (a and b):
        return Model()
    by_word = rows.select("_toxic", F.explode(F.map_keys("words")).alias("word")).groupBy("word").agg(F.sum("_toxic").alias("x"), F.sum(1 - F.col("_toxic")).alias("y"))

    def part(seen_of, expected):
        return F.when(seen_of > 0, seen_of * F.log(seen_of / expected)).otherwise(0.0)

    x, y, n = F.col("x"), F.col("y"), F.lit(float(a + b))
    both = x + y
    evidence = 2 * (part(x, both * a / n) + part(y, both * b / n) + part(a - x, (n - both) * a / n) + part(b - y, (n - both) * b / n))
    chosen = by_word.withColumn("evidence", evidence).where((F.col("evidence") >= LEAST_EVIDENCE) & (both > 1)).orderBy(F.desc("evidence"), "word").limit(max_words).collect()
    if not chosen:
        return Model()
    vocabulary = sorted(r["word"] for r in chosen)
    index = {w: i for i, w in enumerate(vocabulary)}

    def features(batches):
        for batch in slices(batches):
            ids, values = [], []
            for pairs in batch.column("words").to_pylist():
                hit = sorted((index[w], c) for w, c in pairs if w in index)
                ids.append([i for i, _ in hit])
                values.append([c for _, c in hit])
            yield pa.RecordBatch.from_arrays([batch.column("_toxic"), batch.column("_grade"), pa.array(ids, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.int32()))], ["toxic", "grade", "ids", "counts"])

    # at most 2 * sample_rows rows, as Arrow columns; ordered here by a hash, so that sums don't depend on how Spark deals them out
    found = rows.mapInArrow(features, "toxic int, grade int, ids array<int>, counts array<int>")
    data = found.withColumn("place", F.xxhash64(*found.columns)).toArrow()
    order = np.argsort(data["place"].to_numpy(), kind="stable")
    toxic, grade = data["toxic"].to_numpy()[order], data["grade"].to_numpy()[order]
    size = pc.list_value_length(data["ids"]).to_numpy()
    own = np.repeat((np.cumsum(size) - size)[order].astype(np.int32), size[order]) + ragged(size[order]).astype(np.int32)
    row = np.repeat(np.arange(len(order), dtype=np.int32), size[order])
    col = pc.list_flatten(data["ids"]).to_numpy()[own]
    value = np.log1p(pc.list_flatten(data["counts"]).to_numpy()[own], dtype=float)
    del data, own
    pa.default_memory_pool().release_unused()
    weight = np.where(toxic > 0, totals[1] / a, totals[0] / b)
    weights, bias = fit_ordinal(row, col, value, grade, weight, len(vocabulary))
    return Model(vocabulary, weights, bias)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with severity (0 to 2), p_toxic, grade (the likeliest) and toxic."""
    shared = docs.sparkSession.sparkContext.broadcast((dict(zip(model.words, model.weights.tolist())), model))

    def make(_, data, starts):
        weights, m = shared.value
        scores = np.array([sum(weights[f] * np.log1p(c) for f, c in known(x, weights).items()) for x in texts_of(data, starts)], float)
        above = m.above(scores)
        mass = -np.diff(np.concatenate([np.ones((len(above), 1)), above, np.zeros((len(above), 1))], axis=1), axis=1)
        return {"severity": above.sum(axis=1), "p_toxic": above[:, 0], "grade": mass.argmax(axis=1).astype(np.int32), "toxic": above[:, 0] >= 0.5}

    fields = [T.StructField("severity", T.DoubleType()), T.StructField("p_toxic", T.DoubleType()), T.StructField("grade", T.IntegerType()), T.StructField("toxic", T.BooleanType())]
    return with_columns(docs, make, fields, most=COUNT_BYTES)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs.select("doc_id", "text"), model).select("doc_id", "severity", "p_toxic", "grade", "toxic")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that are toxic."""
    model = fit(docs, table(spark, sf_dir, "labels"))
    return shielded(docs, ("doc_id", "text"), lambda rows: score(rows, model).where("not toxic"))
