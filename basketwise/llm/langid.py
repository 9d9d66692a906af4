"""Language of a text: sparse multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketwise.llm.tables import id_text, small_batches, smallest_hashes

UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")


@dataclass(frozen=True)
class LangSpec:
    """Hashed 1- to 3-grams of lower-cased letters; FTRL with elastic net; then a temperature.

    Document frequencies cover every learnable text. The weights are fitted on a bounded sample: the
    ``per_language`` rows of smallest hash of every language and ``sample`` rows at most in all, of which every
    ``calibrate``-th is kept back to set the temperature.
    """

    features: int = 1 << 14
    per_language: int = 400
    sample: int = 4000
    epochs: int = 3
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.002
    l2: float = 0.01
    calibrate: int = 5


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def logits(self, where: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return tfidf(where, counts, self.idf) @ self.weights[where]

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, calibrated probability); a text without a letter is ``und`` with 0."""
        if not self.languages or not text or not LETTER.search(text):
            return UNKNOWN, 0.0
        share = softmax(self.logits(*gram_counts(text, len(self.idf))) / self.temperature)
        best = int(share.argmax())
        return self.languages[best], float(share[best])


_plain = np.arange(128, dtype=np.uint32)
_plain[:97] = 32
_plain[123:] = 32


def gram_counts(text: str, features: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and counts of the hashed 1-, 2- and 3-grams; ASCII other than letters counts as a blank."""
    shift = np.uint32(32 - (features - 1).bit_length())
    total = np.zeros(features, dtype=np.int64)
    step = 1 << 20
    for first in range(0, len(text), step):  # bounded memory; pieces overlap by two so that no n-gram is lost
        code = np.frombuffer(text[max(0, first - 2):first + step].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        skip = min(first, 2)
        code = np.where(code < 128, _plain[np.minimum(code, 127)], code)
        one = code * np.uint32(0x9E3779B1)
        two = (one[:-1] ^ np.uint32(0x5BD1E995)) * np.uint32(0x85EBCA6B) + code[1:] * np.uint32(0xC2B2AE35)
        three = (two[:-1] ^ np.uint32(0x27D4EB2F)) * np.uint32(0x165667B1) + code[2:] * np.uint32(0x9E3779B1)
        for grams, lost in ((one, skip), (two, max(0, skip - 1)), (three, 0)):
            grams = grams[lost:]
            total += np.bincount(((grams ^ (grams >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> shift, minlength=features)
    where = np.flatnonzero(total)
    return where, total[where]


def tfidf(where: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    value = (1.0 + np.log(counts)) * idf[where]
    return value / max(float(np.sqrt((value * value).sum())), 1e-12)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def learnable(docs: DataFrame, rest: int = 2, of: int = 4) -> Column:
    """Rows that may be learned from: crc32 of doc_id as text, modulo ``of``, is not ``rest``."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(of)) != rest, F.lit(True))


def document_frequencies(texts: DataFrame, features: int) -> tuple[np.ndarray, int]:
    """In how many texts each feature occurs, summed per task first (``features`` rows a task)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(features + 1, dtype=np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                total[gram_counts(text.as_py() or "", features)[0]] += 1
                rows += 1
        total[features] = rows
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["feature", "n"])

    found = texts.select("text").mapInArrow(count, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    out = np.zeros(features + 1, dtype=np.int64)
    for feature, n in found.collect():
        out[feature] = n
    return out[:features], int(out[features])


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int, features: int,
             spec: LangSpec) -> np.ndarray:
    """Follow the regularised leader, one pass of updates per epoch; weights under the L1 bound stay zero."""
    pulls, squares = np.zeros((features, classes)), np.zeros((features, classes))

    def weights(at) -> np.ndarray:
        z = pulls[at]
        w = -(z - np.sign(z) * spec.l1) / ((spec.beta + np.sqrt(squares[at])) / spec.alpha + spec.l2)
        return np.where(np.abs(z) > spec.l1, w, 0.0)

    rng = np.random.default_rng(3)
    for _ in range(spec.epochs):
        for i in rng.permutation(len(rows)):
            at, value = rows[i]
            w = weights(at)
            wrong = softmax(value @ w)
            wrong[labels[i]] -= 1.0
            grad = value[:, None] * wrong
            moved = (np.sqrt(squares[at] + grad * grad) - np.sqrt(squares[at])) / spec.alpha
            pulls[at] += grad - moved * w
            squares[at] += grad * grad
    return weights(slice(None))


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of smallest log loss, on a grid of factors refined once."""
    def loss(t: float) -> float:
        return float(-np.log(softmax(logits / t)[np.arange(len(labels)), labels] + 1e-300).mean())

    best = 1.0
    for span, steps in ((3.0, 61), (0.1, 41)):
        best = min(best * np.exp(np.linspace(-span, span, steps)), key=loss)
    return float(np.clip(best, 0.02, 50))


def train(docs: DataFrame, spec: LangSpec = LangSpec()) -> LanguageModel:
    """Fit on ``doc_id, text, lang``: learnable rows (see :func:`learnable`) with a language and a text."""
    small_batches(docs.sparkSession)
    typed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"),
                        F.col("lang").cast("string").alias("lang"))
    known = typed.filter(learnable(typed) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    df, n = document_frequencies(known, spec.features)
    idf = np.log((1.0 + n) / (1.0 + df)) + 1.0
    lettered = known.filter(F.col("text").rlike(r"\p{L}")).select("doc_id", "lang")
    ids = smallest_hashes(lettered, "lang", F.xxhash64("doc_id"), ["doc_id"], spec.per_language) \
        .orderBy("place", "lang").limit(spec.sample).select("doc_id", "lang")

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [gram_counts(t or "", spec.features) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([r[0] for r in rows], pa.list_(pa.int64())),
                 pa.array([r[1] for r in rows], pa.list_(pa.int64()))], names=["doc_id", "lang", "at", "n"])

    # spec.sample ids at most, so the broadcast is bounded
    picked = known.join(F.broadcast(ids), ["doc_id", "lang"], "left_semi").select("doc_id", "lang", "text") \
        .mapInArrow(grams, "doc_id long, lang string, at array<long>, n array<long>").collect()
    picked = sorted(picked, key=lambda r: (r["doc_id"] is None, r["doc_id"], r["lang"], r["at"]))
    languages = sorted({r["lang"] for r in picked})
    if not languages:
        return LanguageModel([], idf, np.zeros((spec.features, 0)), 1.0)
    rows, labels = [], np.array([languages.index(r["lang"]) for r in picked])
    for r in picked:
        at = np.array(r["at"])
        rows.append((at, tfidf(at, np.array(r["n"]), idf)))
    back = np.arange(len(rows)) % spec.calibrate == 0
    if back.all() or not back.any():
        back[:] = False
    fit = np.flatnonzero(~back)
    weights = fit_ftrl([rows[i] for i in fit], labels[fit], len(languages), spec.features, spec)
    held = np.flatnonzero(back) if back.any() else fit
    logits = np.stack([rows[i][1] @ weights[rows[i][0]] for i in held])
    return LanguageModel(languages, idf, weights, fit_temperature(logits, labels[held]))


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``doc_id, lang_pred, score`` of every row, from its whole text alone.

    A null text, or one without a letter, is ``und`` with score 0; so is every text if nothing was learned.
    Rows are independent; repeated rows, null ids and other columns change nothing.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.predict(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f[0] for f in found], pa.string()),
                 pa.array([f[1] for f in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return id_text(docs).mapInArrow(run, "doc_id long, lang_pred string, score double")


def accept(docs: DataFrame, model: LanguageModel, least: float = 0.4) -> DataFrame:
    """Rows of ``docs``, all columns, whose language is known with a calibrated score of ``least`` or more."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.predict(t.as_py()) for t in batch.column(at)]
            yield batch.filter(pa.array([f[0] != UNKNOWN and f[1] >= least for f in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
