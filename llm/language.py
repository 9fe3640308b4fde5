"""Language identification by string kernels: blended spectrum, Nyström landmarks, kernel ridge regression."""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import map_arrow
from llm.sampling import labelled, share_of, trimmed

UNKNOWN = "und"
#: Documents of each language that are fitted, and of these the landmarks.
FIT = 300
LANDMARKS = 24
RIDGE = 0.1
SHARPNESS = 6.0
#: Landmarks of all languages together, about.
MOST_LANDMARKS = 1536
#: N-grams are told apart by so many bits of a hash of their code points, whatever their script.
BITS = 20
ROWS = 128
#: A text counts as of a learned language from this share of the margin that all but TAIL of the fitted documents
#: have, and from this margin at least: text of another script has none.
CLAIM, TAIL, LEAST_MARGIN = 0.25, 0.005, 0.02


@dataclass
class Model:
    """The landmarks' n-grams and kernel weights, and the least margin at which a language claims a text."""

    languages: list[str]
    vocabulary: np.ndarray
    landmarks: np.ndarray
    norms: np.ndarray
    weights: np.ndarray
    floor: float = 0.0

    def kernels(self, texts: list[str]) -> np.ndarray:
        """The normalised presence kernel of each text with each landmark, one matrix product a batch.

        Marked are the landmarks' n-grams (1 to 3 symbols) that the whole text has; its norm counts all it has.
        """
        seen = np.zeros(1 << BITS, dtype=bool)
        rows, sizes = np.zeros((len(texts), len(self.vocabulary)), dtype=np.float32), np.ones(len(texts))
        for k, text in enumerate(texts):
            grams = _grams(text)
            seen[grams] = True
            rows[k] = seen[self.vocabulary]
            sizes[k] = max(1, np.count_nonzero(seen))
            seen[grams] = False
        return (rows @ self.landmarks) / np.sqrt(sizes)[:, None] / self.norms[None, :]

    def margins(self, texts: list[str]) -> np.ndarray:
        """One-versus-rest margins of each text, about 1 for its own language and -1 for others."""
        return self.kernels(texts) @ self.weights

    def told(self, texts: list[str | None]) -> list[int]:
        """The numbers of the texts that have a letter, if anything was learned."""
        return [k for k, t in enumerate(texts) if self.languages and _lettered(t)]

    def claimed(self, texts: list[str | None]) -> np.ndarray:
        """Whether a learned language claims each text: its margin, not its share among the languages, is ``floor`` or more.

        Where no language was learned, none can be told from another, and a letter is enough.
        """
        if not self.languages:
            return np.array([_lettered(t) for t in texts], dtype=bool)
        found = np.zeros(len(texts), dtype=bool)
        at = self.told(texts)
        for a in range(0, len(at), ROWS):
            some = at[a : a + ROWS]
            found[some] = self.margins([texts[k] for k in some]).max(axis=1) >= self.floor
        return found

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score of each text; ``und`` and 0 where there is no letter or nothing was learned."""
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        at = self.told(texts)
        for a in range(0, len(at), ROWS):
            some = at[a : a + ROWS]
            margin = SHARPNESS * self.margins([texts[k] for k in some])
            p = np.exp(margin - margin.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            best = p.argmax(axis=1)
            for k, b, s in zip(some, best.tolist(), p.max(axis=1).tolist()):
                names[k], scores[k] = self.languages[b], s
        return names, scores


def _lettered(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@functools.cache
def _letters() -> np.ndarray:
    """Each code point, if it is a letter, else 0."""
    points = np.arange(0x110000, dtype=np.uint64)
    points[[c for c in range(0x110000) if not chr(c).isalpha()]] = 0
    return points


def _grams(text: str) -> np.ndarray:
    """Hashes of all n-grams of one to three symbols, repeats included; all that is no letter is one symbol."""
    one = _letters()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)] + np.uint64(1)
    two = one[:-1] << np.uint64(21) | one[1:]
    all_of = np.concatenate([one, two, two[:-1] << np.uint64(21) | one[2:]])
    return (all_of * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS)).astype(np.int32)


def fit(texts: list[str], languages: list[str]) -> Model:
    """One-versus-rest kernel ridge regression on Nyström features of the landmarks."""
    names = sorted(set(languages))
    each = share_of(LANDMARKS, len(names), MOST_LANDMARKS)
    chosen, held = [], Counter()
    for text, name in zip(texts, languages):
        if held[name] < each:
            held[name] += 1
            chosen.append(np.unique(_grams(text)))
    vocabulary = np.unique(np.concatenate(chosen)) if chosen else np.zeros(0, dtype=np.int32)
    landmarks = np.zeros((len(vocabulary), len(chosen)), dtype=np.float32)
    for k, grams in enumerate(chosen):
        landmarks[np.searchsorted(vocabulary, grams), k] = 1.0
    norms = np.sqrt(np.maximum(1.0, np.array([len(g) for g in chosen], dtype=np.float64)))
    model = Model(names, vocabulary, landmarks, norms, np.zeros((len(chosen), len(names))))
    if not chosen:
        return model
    inner = (landmarks.T @ landmarks).astype(np.float64) / np.outer(norms, norms)
    values, vectors = np.linalg.eigh(inner)
    root = vectors @ np.diag(np.where(values > 1e-8, values, np.inf) ** -0.5) @ vectors.T
    kernels = np.concatenate([model.kernels(texts[a : a + ROWS]) for a in range(0, len(texts), ROWS)])
    features = kernels @ root
    target = np.where(np.array(languages)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    model.weights = root @ np.linalg.solve(features.T @ features + RIDGE * np.eye(len(root)), features.T @ target)
    best = (kernels @ model.weights).max(axis=1)[[_lettered(t) for t in texts]]
    model.floor = max(LEAST_MARGIN, CLAIM * float(np.quantile(best, TAIL))) if len(best) else LEAST_MARGIN
    return model


def train(rows: DataFrame, label: str = "lang", text: str = "text", ident: str = "doc_id", quota: int = FIT) -> Model:
    """Fit on about ``quota`` whole documents of each label, fewer where labels are many; every label is learned.

    Null labels and texts don't count, rows that repeat count once, and a text of two labels counts
    for each. Which rows are taken, and their order, only their ids and texts decide. An empty table makes a model that knows nothing.
    """
    rows = rows.select(F.col(f"`{ident}`").alias("id"), F.col(f"`{label}`").cast("string").alias("label"), F.col(f"`{text}`").cast("string").alias("text"))
    rows = rows.where("label is not null and text is not null")
    sample, _, quota = labelled(rows, "label", ("id", "text"), quota)
    frame = trimmed(sample.select("label", "text").toPandas(), "label", quota)
    return fit(frame["text"].tolist(), frame["label"].tolist())


def identify(docs: DataFrame, model: Model, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(ident, lang_pred, score) for each row, by its whole text alone. Null texts and those without a letter are ``und``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = shared.value.predict(batch.column(1).to_pylist())
            yield pa.record_batch([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["id", "lang_pred", "score"])

    kind = dict(docs.dtypes)[ident]
    found = map_arrow(docs.select(F.col(ident), F.col(text).cast("string")), run, f"id {kind}, lang_pred string, score double")
    return found.withColumnRenamed("id", ident)


def keep_identified(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` without those that no learned language claims: no letter, or margins under the model's floor; all columns stay.

    A model that has learned nothing claims all that have a letter.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(shared.value.claimed(batch.column(batch.schema.get_field_index(text)).to_pylist())))

    return map_arrow(docs, run, docs.schema)
