"""Toxicity severity by cumulative-link ordinal regression over sparse text features.

P(severity > c) = sigmoid(w.x - theta_c): one weight vector for all thresholds theta_0 <= theta_1 <= ... The expected
severity is the sum of these probabilities. Features are the presence of hashed words and of longer words' first bytes.

Grades come from the labels alone, never from the texts: any whole numbers from 0, not toxic, up. Tables that only say toxic
or not, and good or not, give three: 0 not toxic, 1 toxic in a text of no quality, 2 toxic in a text of good quality, which
nothing else would keep out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triplane.llm.tables import arrow_batches, materialize, release
from triplane.llm.words import hash_words

BITS, PREFIX = 20, 5
#: The fit reads at most so many labelled rows, those with the least hash of their id; scoring reads all.
SAMPLE_ROWS = 20_000
#: A feature takes part in the fit if it is in SUPPORT rows of the sample at least and its count in toxic rows is Z standard
#: deviations from what chance would give.
SUPPORT, Z = 3, 4.0
#: A text goes when P(severity > 0) reaches this.
REJECT_AT = 0.2


@dataclass
class Model:
    """Weights of the features that have any, ascending by feature; ascending thresholds."""

    features: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def margins(self, rows: np.ndarray, features: np.ndarray, n: int) -> np.ndarray:
        if not len(self.features):
            return np.zeros(n)
        at = np.minimum(np.searchsorted(self.features, features), len(self.features) - 1)
        hit = self.features[at] == features
        return np.bincount(rows[hit], weights=self.weights[at[hit]], minlength=n)


def text_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature), each pair once, ordered."""
    words = hash_words(texts, PREFIX)
    owner = words.owners()
    shift = np.uint64(64 - BITS)
    pairs = (owner << BITS) | (words.hashes >> shift).astype(np.int64)
    if words.prefixes is not None:
        long = words.prefixes != 0
        pairs = np.concatenate([pairs, (owner[long] << BITS) | (words.prefixes[long] >> shift).astype(np.int64)])
    pairs = np.unique(pairs)
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_ordinal(rows: np.ndarray, features: np.ndarray, grades: np.ndarray, steps: int = 300, rate: float = 0.5, l2: float = 1e-5) -> Model:
    """Adagrad on the mean cumulative-link loss with an L2 penalty. (rows, features): the sparse 0/1 matrix."""
    n, top = len(grades), int(grades.max(initial=0))
    used, cols = np.unique(features, return_inverse=True)
    if top == 0 or not len(used):
        return Model(np.zeros(0, np.int64), np.zeros(0), np.array([np.inf]))
    w, gw = np.zeros(len(used)), np.full(len(used), 1e-8)
    freq = np.clip([(grades > c).mean() for c in range(top)], 1e-6, 1 - 1e-6)
    theta = np.log((1 - freq) / freq)
    gt = np.full(top, 1e-8)
    lower_i, upper_i = np.maximum(grades - 1, 0), np.minimum(grades, top - 1)
    for _ in range(steps):
        eta = np.bincount(rows, weights=w[cols], minlength=n)
        a = np.where(grades > 0, _sigmoid(eta - theta[lower_i]), 1.0)
        b = np.where(grades < top, _sigmoid(eta - theta[upper_i]), 0.0)
        p = np.maximum(a - b, 1e-12)
        g = np.bincount(cols, weights=(a + b - 1)[rows], minlength=len(w)) / n + l2 * w
        da, db = np.where(grades > 0, a * (1 - a) / p, 0), np.where(grades < top, b * (1 - b) / p, 0)
        dt = (np.bincount(lower_i, weights=da, minlength=top) - np.bincount(upper_i, weights=db, minlength=top)) / n
        gw += g * g
        gt += dt * dt
        w = w - rate / np.sqrt(gw) * g
        theta = np.maximum.accumulate(theta - rate / np.sqrt(gt) * dt)
    return Model(used, w, theta)


def label_grade(labels: DataFrame) -> Column:
    """The grade of a row of labels (toxic, and quality if there); null where toxic is."""
    worse = F.when(F.col("quality") > 0, 1).otherwise(0) if "quality" in labels.columns else F.lit(0)
    return F.when(F.col("toxic") > 0, 1 + worse).when(F.col("toxic").isNotNull(), 0)


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", grade: Column | None = None) -> Model:
    """Fits on a bounded sample of labelled rows. grade: a column over labels, ``label_grade`` unless given; several labels of an
    id count as the highest. Ids are whole numbers, or strings of them (others raise). Null ids, grades and texts are left out;
    documents that repeat count as often; labels of one class only, or none, give a model that finds every severity 0. Long texts
    are read whole; other columns play no part. The driver gets the features that pass the screen, no others."""
    arrow_batches(docs.sparkSession)
    of = (grade if grade is not None else label_grade(labels)).cast("int")
    asked = labels.select(F.col(id_col).cast("long").alias("id"), of.alias("grade")).where("id is not null and grade is not null").groupBy("id").agg(F.greatest(F.max("grade"), F.lit(0)).alias("grade"))
    sample = asked.orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    joined = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("text is not null").join(F.broadcast(sample), "id")

    def extract(batches):
        for batch in batches:
            rows, feats = text_features(batch.column("text").to_pylist())
            bounds = np.searchsorted(rows, np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("grade"), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(feats, pa.int32()))], ["id", "grade", "f"])

    held = materialize(joined.select("id", "grade", "text").mapInArrow(extract, "id long, grade int, f array<int>"))
    n, bad = held.agg(F.count(F.lit(1)), F.count_if(F.col("grade") > 0)).first()
    if not n or not bad or bad == n:
        release(held)
        return Model(np.zeros(0, np.int64), np.zeros(0), np.array([np.inf]))
    base = bad / n
    each = held.select(F.explode("f").alias("f"), F.col("grade").cast("boolean").cast("long").alias("t")).groupBy("f").agg(F.count(F.lit(1)).alias("c"), F.sum("t").alias("b"))
    far = F.abs(F.col("b") - F.col("c") * base) >= Z * F.sqrt(F.col("c") * (base * (1 - base)))
    chosen = each.where((F.col("c") >= SUPPORT) & far).select("f").toArrow().sort_by("f").column("f").to_numpy().astype(np.int64)

    def restrict(batches):
        for batch in batches:
            lists = batch.column("f")
            size = np.asarray(lists.value_lengths())
            feats = lists.flatten().to_numpy()
            owner = np.repeat(np.arange(len(size)), size)
            keep = np.isin(feats, chosen)
            bounds = np.searchsorted(owner[keep], np.arange(len(size) + 1))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("grade"), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(feats[keep], pa.int32()))], ["id", "grade", "f"])

    got = held.mapInArrow(restrict, "id long, grade int, f array<int>").toArrow().sort_by("id")
    release(held)
    lists = got.column("f").combine_chunks()
    rows = np.repeat(np.arange(n), np.asarray(lists.value_lengths()))
    return fit_ordinal(rows, lists.flatten().to_numpy().astype(np.int64), got.column("grade").to_numpy().astype(np.int64))


def severity(text: Column | str, model: Model) -> Column:
    """A struct column: expected severity and P(severity > 0)."""

    @F.arrow_udf("struct<expected:double,any:double>")
    def scored(batch: pa.Array) -> pa.Array:
        rows, feats = text_features(batch.to_pylist())
        over = _sigmoid(model.margins(rows, feats, len(batch))[:, None] - model.thresholds[None, :])
        over[:, np.isinf(model.thresholds)] = 0
        return pa.StructArray.from_arrays([pa.array(over.sum(1)), pa.array(over[:, 0])], ["expected", "any"])

    return scored(text)


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, expected_severity, toxic) for each row of docs. A null or empty text has no features: its severity is what
    the thresholds alone give. Long texts are read whole; repeated rows and null ids are scored like others; no docs give no
    rows; other columns play no part."""
    arrow_batches(docs.sparkSession)
    scored = docs.select(F.col(id_col).alias("doc_id"), severity(F.col(text_col), model).alias("s"))
    return scored.select("doc_id", F.col("s.expected").alias("expected_severity"), (F.col("s.any") >= REJECT_AT).alias("toxic"))


def filter_toxicity(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs, all columns, without toxic rows. Rows of null or empty text stay unless the thresholds alone reject them."""
    arrow_batches(docs.sparkSession)
    return docs.where(severity(F.col(text_col), model)["any"] < REJECT_AT)
