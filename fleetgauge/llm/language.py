"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text is the average of the embeddings of its character n-grams (bytes of the lower-cased text, word ends
included), hashed into a fixed number of buckets; a linear layer and a softmax give a probability per language.
Both layers are trained together by stochastic gradient descent in numpy. The texts of the training sample are
counted into buckets on the executors, so only bounded vectors reach the driver.

Calibration: a part of the training sample is kept from the descent. On it the softmax temperature is fitted, and
the rejection threshold is the score that all but ``reject_share`` of its rightly labelled texts reach.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.llm.shared import configure, per_batch

BUCKETS = 4096
DIMENSIONS = 16
# Bound of the training sample: rows of each language, the first by a hash of the id.
ROWS_PER_LANGUAGE = 600
MAX_LANGUAGES = 200
UNDETERMINED = "und"
_LETTER = regex.compile(r"\p{L}")
# Multipliers of the n-gram hash: odd, with well-spread bits.
_MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], dtype=np.uint32)
# A long text is counted in slices of this many bytes to bound memory; n-grams across the cut are counted too.
_SLICE = 1 << 20


def bucket_counts(text: str, buckets: int = BUCKETS) -> np.ndarray:
    """How many 3- and 4-byte subwords of the whole text fall in each bucket; an empty text gives zeros."""
    data = f" {text.lower()} ".encode("utf-8", "replace")
    total = np.zeros(buckets, np.int64)
    shift = np.uint32(32 - int(buckets).bit_length() + 1)
    for start in range(0, len(data), _SLICE):
        part = np.frombuffer(data, np.uint8, min(_SLICE + 3, len(data) - start), start).astype(np.uint32)
        mixed = part[:-2] * _MIX[0] + part[1:-1] * _MIX[1] + part[2:] * _MIX[2]
        fours = mixed[:-1] + part[3:] * _MIX[3]
        limit = _SLICE if start + _SLICE + 3 <= len(data) else len(part)
        for hashed in (mixed[:limit], fours[:limit]):
            hashed = (hashed ^ (hashed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            total += np.bincount(hashed >> shift, minlength=buckets)
    return total


def has_letter(text: str | None) -> bool:
    return text is not None and _LETTER.search(text) is not None


@dataclass(frozen=True)
class LanguageModel:
    """Trained weights; ``embedding`` has a row per bucket, ``output`` a column per language."""

    languages: tuple[str, ...]
    embedding: np.ndarray
    output: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float

    def scores(self, counts: np.ndarray) -> np.ndarray:
        """Calibrated probabilities for rows of bucket counts."""
        shares = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
        return _softmax((shares @ self.embedding @ self.output + self.bias) / self.temperature)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score and whether it is rejected; ``und``, 0 and rejected for a text without a letter."""
        if not has_letter(text) or not self.languages:
            return UNDETERMINED, 0.0, True
        probabilities = self.scores(bucket_counts(text, len(self.embedding))[None, :])[0]
        best = int(probabilities.argmax())
        score = float(min(1.0, probabilities[best]))
        return self.languages[best], score, score < self.threshold


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def training_sample(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE) -> DataFrame:
    """``lang, counts`` of a bounded sample: in each language the rows with the smallest hash of their id."""
    known = docs.filter("lang IS NOT NULL AND text IS NOT NULL").select(
        "doc_id", "lang", F.xxhash64(F.col("doc_id").cast("string"), F.lit(7)).alias("draw")
    )
    # the smallest hashes are kept while partial results are combined: no language meets in one task
    spark = docs.sparkSession
    languages = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES).collect()
    picks = []
    for row in languages:
        share = min(1.0, 1.5 * rows_per_language / row["count"])
        cut = int(-(2**63) + share * (2**64 - 1))
        near = known.filter((F.col("lang") == row["lang"]) & (F.col("draw") <= min(cut, 2**63 - 1)))
        picks.append((row["lang"], near.select("draw").orderBy("draw").limit(rows_per_language).agg(F.max("draw")).first()[0]))
    limits = {lang: top for lang, top in picks if top is not None}
    if not limits:
        return spark.createDataFrame([], "lang string, counts binary")
    limit = F.lit(None).cast("bigint")
    for lang, top in limits.items():
        limit = F.when(F.col("lang") == lang, F.lit(top)).otherwise(limit)
    chosen = docs.filter("lang IS NOT NULL AND text IS NOT NULL").filter(
        F.xxhash64(F.col("doc_id").cast("string"), F.lit(7)) <= limit
    )

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts = [
                np.minimum(bucket_counts(t), 65535).astype(np.uint16).tobytes() if has_letter(t) else None
                for t in batch.column("text").to_pylist()
            ]
            return pa.record_batch({"lang": batch.column("lang"), "counts": pa.array(counts, pa.binary())})

        return step

    return per_batch(chosen.select("lang", "text"), "lang string, counts binary", make).filter("counts IS NOT NULL")


def train(
    sample: DataFrame, epochs: int = 30, rate: float = 4.0, batch: int = 64, reject_share: float = 0.001, seed: int = 11
) -> LanguageModel:
    """Fits the model on ``sample(lang, counts)``, at most ``MAX_LANGUAGES * ROWS_PER_LANGUAGE`` bounded rows."""
    rows = sorted((r["lang"], bytes(r["counts"])) for r in sample.collect())
    languages = tuple(sorted({lang for lang, _ in rows}))
    generator = np.random.default_rng(seed)
    embedding = generator.normal(0, 0.1, (BUCKETS, DIMENSIONS))
    output, bias = generator.normal(0, 0.1, (DIMENSIONS, len(languages))), np.zeros(len(languages))
    if not rows:
        return LanguageModel((), embedding, output, bias, 1.0, 0.0)
    counts = np.frombuffer(b"".join(c for _, c in rows), np.uint16).reshape(len(rows), BUCKETS).astype(np.float32)
    shares = counts
    shares /= np.maximum(counts.sum(axis=1, keepdims=True), 1)
    labels = np.searchsorted(languages, [lang for lang, _ in rows])
    order = generator.permutation(len(rows))
    held = order[: len(rows) // 5] if len(rows) >= 50 else order
    fitted = order[len(rows) // 5 :] if len(rows) >= 50 else order
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for part in np.array_split(generator.permutation(fitted), max(1, len(fitted) // batch)):
            x = shares[part]
            hidden = x @ embedding
            error = _softmax(hidden @ output + bias)
            error[np.arange(len(part)), labels[part]] -= 1
            error /= len(part)
            back = error @ output.T
            output -= step * (hidden.T @ error)
            bias -= step * 0.1 * error.sum(axis=0)
            # the embedding of a bucket moves by the share of a text it makes up; those shares are small
            embedding -= step * 20 * (x.T @ back)
    logits = shares[held] @ embedding @ output + bias
    temperature = _fit_temperature(logits, labels[held])
    probabilities = _softmax(logits / temperature)
    right = probabilities.argmax(axis=1) == labels[held]
    own = np.sort(probabilities.max(axis=1)[right])
    # split-conformal: no more than reject_share of rightly labelled texts lie below
    threshold = float(own[int(np.floor(reject_share * len(own)))]) if len(own) else 0.0
    return LanguageModel(languages, embedding.astype(np.float32), output.astype(np.float32), bias, temperature, threshold * 0.9)


def _fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the best likelihood, by golden-section search on its logarithm."""

    def loss(log_t: float) -> float:
        p = _softmax(logits / np.exp(log_t))[np.arange(len(labels)), labels]
        return float(-np.log(np.maximum(p, 1e-12)).mean())

    low, high, ratio = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def learnable(docs: DataFrame) -> DataFrame:
    """The rows the model may learn from: a crc32 of the id that 5 does not divide."""
    return docs.filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)


def predict_languages(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, rejected`` for every row of ``docs(doc_id, text)``.

    Only the text is looked at. Null texts, texts without a letter, and every text under a model without languages give
    ``und``, score 0, rejected. Rows with a null id have a null ``held_out``; repeated rows are judged each; other
    columns are ignored; an empty table gives no rows. Equal scores go to the language first by name.
    """
    configure(docs.sparkSession)

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [model.predict(t) for t in batch.column("text").to_pylist()]
            return pa.record_batch(
                {
                    "doc_id": batch.column("doc_id"),
                    "held_out": batch.column("held_out"),
                    "lang_pred": pa.array([f[0] for f in found], pa.string()),
                    "score": pa.array([f[1] for f in found], pa.float64()),
                    "rejected": pa.array([f[2] for f in found], pa.bool_()),
                }
            )

        return step

    rows = docs.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out"), "text")
    kind = dict(docs.dtypes)["doc_id"]
    return per_batch(rows, f"doc_id {kind}, held_out boolean, lang_pred string, score double, rejected boolean", make)


def accepted(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The rows of ``docs`` whose text the model does not reject, all columns as they are."""
    configure(docs.sparkSession)

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            kept = [not model.predict(t)[2] for t in batch.column("text").to_pylist()]
            return batch.filter(pa.array(kept, pa.bool_()))

        return step

    return per_batch(docs, ", ".join(f"`{n}` {t}" for n, t in docs.dtypes), make)


def identify_languages(docs: DataFrame) -> DataFrame:
    """Trains on the learnable rows of ``docs(doc_id, text, lang)`` and predicts every row."""
    configure(docs.sparkSession)
    return predict_languages(docs, train(training_sample(learnable(docs))))
