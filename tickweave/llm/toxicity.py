"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Per-coordinate learning rates suit features of very different frequency; the L1
term keeps weights at exactly zero until the evidence suffices, so that what is
sent to the workers is a short list of (index, weight).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickweave.llm.hashing import mix, word_hashes
from tickweave.runtime import ship_package, table, thrifty

WORD = re.compile(r"\w+")
#: Letters of a word that make its stem.
STEM = 5


@dataclass(frozen=True)
class Settings:
    """bits: log2 of the feature space, which bounds the number of weights; sample: labelled documents that are learnt from (about)."""

    bits: int = 22
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 10.0
    l2: float = 1.0
    epochs: int = 5
    sample: int = 12_000


def features(text: str | None, bits: int) -> np.ndarray:
    """Sorted indices of what a whole text has: words and their stems (upper half), pairs of words at distance one and two (lower half)."""
    found = WORD.findall((text or "").lower())
    if not found:
        return np.empty(0, np.int64)
    words = word_hashes(found)
    half = np.uint64(1 << (bits - 1))
    single = np.concatenate([mix(words), mix(word_hashes([w[:STEM] for w in found]) + np.uint64(5))]) % half + half
    pair = mix(words[:-1] * np.uint64(3) + mix(words[1:])) % half
    skip = mix(words[:-2] * np.uint64(7) + mix(words[2:] + np.uint64(1))) % half
    return np.unique(np.concatenate([single, pair, skip])).astype(np.int64)


class Ftrl:
    """The learner; one coordinate more than features, for the intercept."""

    def __init__(self, s: Settings):
        self.s, self.z, self.n = s, np.zeros((1 << s.bits) + 1), np.zeros((1 << s.bits) + 1)

    def weights(self, at) -> np.ndarray:
        s, z = self.s, self.z[at]
        return np.where(np.abs(z) <= s.l1, 0.0, (np.sign(z) * s.l1 - z) / ((s.beta + np.sqrt(self.n[at])) / s.alpha + s.l2))

    def learn(self, at: np.ndarray, label: int) -> None:
        at = np.append(at, 1 << self.s.bits)
        w = self.weights(at)
        g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        self.z[at] += g - (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.s.alpha * w
        self.n[at] += g * g


@dataclass(frozen=True)
class Model:
    bits: int
    index: np.ndarray
    weight: np.ndarray
    intercept: float

    def score(self, text: str | None) -> float:
        return self.of(features(text, self.bits))

    def of(self, at: np.ndarray) -> float:
        """Score of sorted features."""
        where = np.minimum(np.searchsorted(self.index, at), max(len(self.index) - 1, 0))
        total = self.intercept + (float(self.weight[where][self.index[where] == at].sum()) if len(self.index) else 0.0)
        return float(1.0 / (1.0 + np.exp(-np.clip(total, -35, 35))))


#: Parts of the hash range that samples are taken by.
TURNS = 1 << 62


def _sample(docs: DataFrame, label: DataFrame, settings: Settings, id_col: str, text_col: str) -> DataFrame:
    """turn, label, key and text of about ``settings.sample`` of the labelled documents (key, label)."""
    share = min(TURNS, settings.sample * TURNS // max(label.count(), 1))
    chosen = label.withColumn("turn", F.xxhash64(F.col("key"), F.lit(17))).where(F.pmod("turn", F.lit(TURNS)) < F.lit(share))
    return docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "key")


def _learnable(labels: DataFrame, held_out, id_col: str, label_col: str) -> DataFrame:
    """key and label of the labels that may be learnt from."""
    label = labels.select(F.col(id_col).alias("key"), F.col(label_col).cast("int").alias("label")).where("key is not null and label is not null").where(~held_out(F.col("key")))
    return label.groupBy("key").agg(F.max("label").alias("label"))


def _fitted(rows, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Indices and weights that are not zero, learnt from (label, features) in order."""
    learner = Ftrl(settings)
    for _ in range(settings.epochs):
        for y, at in rows:
            learner.learn(at.astype(np.int64), 1 if y else 0)
    at = np.flatnonzero(np.abs(learner.z) > settings.l1)
    return at, learner.weights(at)


def compare_settings(docs: DataFrame, labels: DataFrame, held_out, choices: list[Settings], folds: int = 4, id_col="doc_id", text_col="text", label_col="toxic") -> DataFrame:
    """choice, n, found, toxic, false, clean, loss of each of the settings by cross-validation.

    Folds are made of the rows that may be learnt from, by a hash of the id, so settings
    can be chosen without a look at held-out rows. A pair of settings and fold is a task.
    """
    ship_package(docs.sparkSession)
    rows = _sample(docs, _learnable(labels, held_out, id_col, label_col), max(choices, key=lambda s: s.sample), id_col, text_col)
    rows = rows.select("turn", "label", "text", F.explode(F.sequence(F.lit(0), F.lit(len(choices) * folds - 1))).alias("task"))

    def run(group: pa.Table) -> pa.Table:
        task = group.column("task")[0].as_py()
        s, fold = choices[task // folds], task % folds
        seen = [(t, y, features(x.as_py(), s.bits).astype(np.uint32)) for t, y, x in zip(group.column("turn").to_pylist(), group.column("label").to_pylist(), group.column("text"))]
        seen.sort(key=lambda x: (x[0], x[1], len(x[2])))
        at, weight = _fitted([x[1:] for x in seen if (x[0] >> 7) % folds != fold], s)
        last = 1 << s.bits
        model = Model(s.bits, at[at < last], weight[at < last], float(weight[at == last].sum()))
        out = [(y, model.of(at.astype(np.int64))) for t, y, at in seen if (t >> 7) % folds == fold]
        toxic, clean = [p for y, p in out if y], [p for y, p in out if not y]
        loss = -sum(np.log(max(p, 1e-12)) for p in toxic) - sum(np.log(max(1 - p, 1e-12)) for p in clean)
        hits = lambda x: sum(p >= THRESHOLD for p in x)
        return pa.table({"choice": [task // folds], "n": [len(out)], "found": [hits(toxic)], "toxic": [len(toxic)], "false": [hits(clean)], "clean": [len(clean)], "loss": [float(loss)]})

    each = rows.groupBy("task").applyInArrow(run, "choice long, n long, found long, toxic long, false long, clean long, loss double")
    return each.groupBy("choice").agg(*[F.sum(c).alias(c) for c in ("n", "found", "toxic", "false", "clean")], (F.sum("loss") / F.sum("n")).alias("loss"))


def train(docs: DataFrame, labels: DataFrame, held_out, settings: Settings = Settings(), id_col="doc_id", text_col="text", label_col="toxic") -> Model:
    """Learn from labelled documents whose id isn't held out.

    ``held_out`` maps an id column to a boolean column. About
    ``settings.sample`` labelled documents, taken by a hash of the id, are learnt
    from, in one task; that bound doesn't grow with the input. Null labels, and
    labels without a document, are left out; a document with several labels has
    the largest. Without any label every score is one half.
    """
    ship_package(docs.sparkSession)
    rows = _sample(docs, _learnable(labels, held_out, id_col, label_col), settings, id_col, text_col)

    def run(batches):
        seen = []
        for batch in batches:
            for turn, y, text in zip(batch.column("turn").to_pylist(), batch.column("label").to_pylist(), batch.column("text")):
                seen.append((turn, y, features(text.as_py(), settings.bits).astype(np.uint32)))
        seen.sort(key=lambda x: (x[0], x[1], len(x[2])))
        at, weight = _fitted([x[1:] for x in seen], settings)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(weight)], ["at", "weight"])

    found = rows.select("turn", "label", "text").repartition(1).mapInArrow(thrifty(run, "toxicity"), "at long, weight double").toPandas().sort_values("at")
    at, weight = found["at"].to_numpy(np.int64), found["weight"].to_numpy(np.float64)
    last = 1 << settings.bits
    return Model(settings.bits, at[at < last], weight[at < last], float(weight[at == last].sum()))


def score_texts(docs: DataFrame, model: Model, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` (default: all) as a struct ``row``, and ``score``.

    Whole texts of any length are scored; a null or empty text has no features
    and gets the model's base rate. Repeated rows get equal scores; an empty
    table gives no rows. Nothing is shuffled. The model has a bounded size.
    """
    spark = docs.sparkSession
    ship_package(spark)
    sent = spark.sparkContext.broadcast(model)
    row = F.struct(*[docs[f"`{c}`"] for c in (docs.columns if carry is None else carry)])
    rows = docs.select(row.alias("row"), F.col(text_col).alias("text"))

    def run(batches):
        own = sent.value
        for batch in batches:
            scores = [own.score(x.as_py()) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(scores, pa.float64())], ["row", "score"])

    from pyspark.sql.types import DoubleType, StructType

    return rows.mapInArrow(thrifty(run, "toxicity"), StructType().add("row", rows.schema["row"].dataType).add("score", DoubleType()))


#: Documents with this score or more count as toxic.
THRESHOLD = 0.3


def held_out(key):
    return F.crc32(key.cast("string").cast("binary")) % 4 == 2


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    """Score of every document by a model learnt from the labels that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"), held_out)
    scored = score_texts(docs, model, carry=["doc_id"])
    return scored.select(
        "row.doc_id", F.coalesce(held_out(F.col("row.doc_id")), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
