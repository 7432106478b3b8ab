"""Language identification by the nearest of several centroids per language.

A text is a normalised TF-IDF vector of hashed character n-grams (one to three
letters, words set apart by one space). Document frequencies are counted over all
training texts. A bounded sample of each language's training vectors is clustered by
spherical k-means; a text gets the language of the centroid with the largest cosine.
Texts far from every centroid, below a quantile of what all training texts reach with
their own language, can be rejected.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructType

from tickweave.runtime import ship_package, table

UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    """dims: hashed n-grams; clusters: centroids per language; sample: texts that are clustered, in all (about); reject: quantile of training cosines."""

    dims: int = 1 << 13
    clusters: int = 3
    rounds: int = 8
    sample: int = 4_000
    reject: float = 0.001


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


#: Characters that are counted at a time; the counts don't depend on it.
CHUNK = 1 << 20


def counts(text: str | None, dims: int) -> np.ndarray | None:
    """Counts of hashed n-grams of a whole text; None if it has no letter."""
    total, seen = np.zeros(dims), False
    low = (text or "").lower()
    shift = np.uint64(64 - (dims.bit_length() - 1))
    tail, after_letter = np.empty(0, np.uint64), True  # the last two codes of what came before
    for start in range(0, len(low), CHUNK):
        codes = np.frombuffer(low[start : start + CHUNK].encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _letters()[codes]
        seen = seen or bool(letter.any())
        codes = np.where(letter, codes, 32).astype(np.uint64)
        codes = codes[letter | np.concatenate([[after_letter], letter[:-1]])]  # of a run of others one space stays
        after_letter = bool(letter[-1])
        codes = np.concatenate([tail, codes])
        a = (codes + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        grams = [a]
        for back in (1, 2):
            if len(codes) > back:
                grams.append((grams[-1][:-1] ^ (grams[-1][:-1] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + a[back:])
        for k, g in enumerate(grams):
            g = g[max(len(tail) - k, 0) :]  # those that end in this part
            g = (g ^ (g >> np.uint64(32))) * np.uint64(0x94D049BB133111EB + 2 * k)
            total += np.bincount((g >> shift).astype(np.int64), minlength=dims)
        tail = codes[-2:]
    return total if seen else None


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


@dataclass(frozen=True)
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    limit: float

    def vector(self, found: np.ndarray) -> np.ndarray:
        return _unit((np.log1p(found) * self.idf).astype(np.float32))

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, largest cosine (0 to 1), and whether that is below the limit."""
        found = counts(text, len(self.idf))
        if found is None or not len(self.centroids):
            return UNKNOWN, 0.0, True
        near = self.centroids @ self.vector(found)
        best = int(near.argmax())
        score = float(min(max(near[best], 0.0), 1.0))
        return self.languages[self.owner[best]], score, score < self.limit


def inverse_frequencies(seen: np.ndarray, texts: int) -> np.ndarray:
    """Weights of n-grams from the number of texts that each is in."""
    return np.log((1 + texts) / (1 + seen)).astype(np.float32) + 1


def fit(rows: list[tuple[str, np.ndarray]], idf: np.ndarray, s: Settings) -> Model:
    """Centroids of (language, counts) pairs; deterministic for an order of rows. The model has no limit yet."""
    languages = sorted({lang for lang, _ in rows})
    if not rows:
        return Model([], idf, np.empty((0, s.dims), np.float32), np.empty(0, np.int64), 0.0)
    centroids, owner = [], []
    blank = Model(languages, idf, np.empty((0, s.dims)), np.empty(0), 0.0)
    for k, lang in enumerate(languages):
        x = np.stack([blank.vector(c) for name, c in rows if name == lang])
        centre = [x.mean(0)]
        while len(centre) < min(s.clusters, len(x)):  # farthest from those so far
            centre.append(x[int((x @ _unit(np.stack(centre)).T).max(1).argmin())])
        centre = _unit(np.stack(centre))
        for _ in range(s.rounds):
            at = (x @ centre.T).argmax(1)
            centre = _unit(np.stack([x[at == j].mean(0) if (at == j).any() else centre[j] for j in range(len(centre))]))
        centroids.append(centre)
        owner += [k] * len(centre)
    return Model(languages, idf, np.concatenate(centroids).astype(np.float32), np.array(owner), 0.0)


#: Parts of the hash range that samples are taken by, and of the range of cosines.
TURNS, STEPS = 1 << 62, 10_000


def _frequencies(rows: DataFrame, dims: int) -> tuple[np.ndarray, int]:
    """In how many texts each n-gram is, and the number of texts with letters; each task sends one number per n-gram."""

    def run(batches):
        seen, texts = np.zeros(dims + 1, np.int64), 0
        for batch in batches:
            for text in batch.column("text"):
                if (c := counts(text.as_py(), dims)) is not None:
                    seen[:-1] += c > 0
                    seen[-1] += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], ["at", "n"])

    found = rows.select("text").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(dims + 1)
    for r in found:
        out[r["at"]] = r["n"]
    return out[:-1], int(out[-1])


def _limit(rows: DataFrame, model: Model, share: float) -> float:
    """The quantile of the cosines of all training texts with their own language, to one part in STEPS."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own, found = sent.value, np.zeros(STEPS + 1, np.int64)
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                if (c := counts(text.as_py(), len(own.idf))) is not None and lang in own.languages:
                    near = (own.centroids @ own.vector(c))[own.owner == own.languages.index(lang)].max()
                    found[int(min(max(near, 0.0), 1.0) * STEPS)] += 1
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(found[at])], ["at", "n"])

    found = sorted((r["at"], r["n"]) for r in rows.select("lang", "text").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect())
    want, reached = share * sum(n for _, n in found), 0
    for at, n in found:
        reached += n
        if reached > want:
            return at / STEPS
    return 0.0


def train(docs: DataFrame, held_out, settings: Settings = Settings(), id_col="doc_id", text_col="text", lang_col="lang") -> Model:
    """Learn from labelled documents that aren't held out.

    Document frequencies and the limit of rejection come from all of them. About
    ``settings.sample`` texts, spread evenly over the languages and chosen by a hash of
    the id, are clustered, in one task; that number doesn't grow with the input. Null
    languages and texts, and texts without letters, are left out; without any training
    text nothing can be predicted but ``und``.
    """
    import pickle

    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang is not null and text is not null").where(~held_out(F.col("key")))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    seen, texts = _frequencies(rows, settings.dims) if sizes else (np.zeros(settings.dims), 0)
    idf = inverse_frequencies(seen, texts)
    if not texts:
        return fit([], idf, settings)
    each, share = max(1, settings.sample // len(sizes)), F.lit(0)
    for lang, n in sorted(sizes.items()):
        share = F.when(F.col("lang") == lang, F.lit(min(TURNS, each * TURNS // n))).otherwise(share)
    chosen = rows.withColumn("turn", F.xxhash64("key", F.lit(23))).where(F.pmod("turn", F.lit(TURNS)) < share)

    def run(batches):
        found = []
        for batch in batches:
            for turn, lang, text in zip(batch.column("turn").to_pylist(), batch.column("lang").to_pylist(), batch.column("text")):
                if (c := counts(text.as_py(), settings.dims)) is not None:
                    found.append((turn, lang, c.astype(np.float32)))
        found.sort(key=lambda x: (x[0], x[1], float(x[2].sum())))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit([x[1:] for x in found], idf, settings))], pa.binary())], ["model"])

    found = chosen.select("turn", "lang", "text").repartition(1).mapInArrow(run, "model binary").collect()
    model = pickle.loads(found[0]["model"]) if found else fit([], idf, settings)
    return replace(model, limit=_limit(rows, model, settings.reject)) if len(model.centroids) else model


def identify(docs: DataFrame, model: Model, text_col: str = "text", carry: list[str] | None = None, reject: bool = False) -> DataFrame:
    """The columns ``carry`` (default: all) as a struct ``row``, and lang_pred, score, rejected.

    Whole texts are read. A null text, or one without a letter, is ``und`` with
    score 0. With ``reject``, texts below the model's limit are ``und`` too. Ties
    between centroids go to the language that sorts first. Empty tables give no
    rows; repeated rows get equal results. Nothing is shuffled.
    """
    spark = docs.sparkSession
    ship_package(spark)
    sent = spark.sparkContext.broadcast(model)
    row = F.struct(*[docs[f"`{c}`"] for c in (docs.columns if carry is None else carry)])
    rows = docs.select(row.alias("row"), F.col(text_col).alias("text"))

    def run(batches):
        own = sent.value
        for batch in batches:
            found = [own.predict(x.as_py()) for x in batch.column("text")]
            langs = [UNKNOWN if reject and far else lang for lang, _, far in found]
            columns = [batch.column("row"), pa.array(langs, pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array([x[2] for x in found], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["row", "lang_pred", "score", "rejected"])

    kind = StructType().add("row", rows.schema["row"].dataType).add("lang_pred", StringType()).add("score", DoubleType()).add("rejected", BooleanType())
    return rows.mapInArrow(run, kind)


def held_out(key):
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op2_langid(spark, sf_dir: str) -> DataFrame:
    """Language of every document."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs, held_out)
    found = identify(docs, model, carry=["doc_id"])
    return found.select("row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
