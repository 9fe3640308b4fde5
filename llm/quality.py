"""Quality classifier by compression: zstandard dictionaries of good and of bad text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import map_arrow
from llm.sampling import labelled, trimmed

#: Labelled documents of each class that are fitted: a third makes the dictionaries, the rest calibrates.
FIT = 4500
DICTIONARY = 32 << 10
#: Texts are compressed in pieces of so many bytes, lest a long text's own repeats hide the dictionary's part.
PIECE = 1 << 10
LEVEL = 3
THRESHOLD = 0.7


@dataclass
class Model:
    """Two dictionaries, and the calibration of what they measure."""

    good: bytes
    bad: bytes
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    learned: bool = True

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        return [_compressor(d) for d in (self.good, self.bad)]

    def measure(self, texts: list[str | None]) -> np.ndarray:
        """Of each whole text: the normalised difference of its compressed sizes, the size as a share, and products."""
        good, bad = (c.compress for c in self.compressors())
        rows = np.zeros((len(texts), 2))
        for k, text in enumerate(texts):
            data = (text or "").encode("utf-8", "surrogatepass")
            g = b = 0
            for a in range(0, max(1, len(data)), PIECE):
                piece = data[a : a + PIECE]
                g += len(good(piece))
                b += len(bad(piece))
            rows[k] = (b - g) / (b + g), (b + g) / 2 / (len(data) + 20)
        d, r = rows.T
        return np.column_stack([d, r, d * r, r * r])

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Probability of good quality; any text, an empty or null one too, has one."""
        x = np.column_stack([(self.measure(texts) - self.centre) / self.scale, np.ones(len(texts))])
        return 1.0 / (1.0 + np.exp(-np.clip(x @ self.weights, -30, 30)))


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    held = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    if held is not None:
        held.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_dict_id=False)


def _dictionary(texts: list[str]) -> bytes:
    """A trained dictionary; of too few texts to train on, their own bytes."""
    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    pieces = [d[a : a + PIECE] for d in data for a in range(0, len(d), PIECE)]
    try:
        return zstandard.train_dictionary(DICTIONARY, pieces).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(pieces)[-DICTIONARY:]


def fit(texts: list[str], labels: list[int], total: dict[int, int] | None = None) -> Model:
    """Dictionaries from a third of each class, logistic calibration on the rest, weighted to the classes' true ``total``."""
    by = {y: [t for t, own in zip(texts, labels) if own == y] for y in (0, 1)}
    third = {y: max(1, len(by[y]) // 3) for y in (0, 1)}
    model = Model(_dictionary(by[1][: third[1]]), _dictionary(by[0][: third[0]]), np.zeros(4), np.ones(4), np.zeros(5))
    rest = {y: by[y][third[y] :] or by[y] for y in (0, 1)}
    if not by[0] or not by[1]:  # one class: its share is certain, as far as it was seen
        model.learned = False
        model.weights = np.array([0, 0, 0, 0, 3.0 if by[1] else -3.0 if by[0] else 0.0])
        return model
    x = np.concatenate([model.measure(rest[y]) for y in (0, 1)])
    y = np.repeat([0.0, 1.0], [len(rest[0]), len(rest[1])])
    total = total or {k: len(by[k]) for k in by}
    share = np.where(y == 1, total[1] / len(rest[1]), total[0] / len(rest[0]))
    share *= len(y) / share.sum()
    model.centre, model.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([(x - model.centre) / model.scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    for _ in range(50):  # Newton's method, with a ridge
        p = 1.0 / (1.0 + np.exp(-np.clip(z @ w, -30, 30)))
        hessian = z.T @ (z * (share * p * (1 - p))[:, None]) + 0.05 * np.eye(len(w))
        w += np.linalg.solve(hessian, z.T @ (share * (y - p)) - 0.05 * w)
    model.weights = w
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", ident: str = "doc_id", text: str = "text", quota: int = FIT) -> Model:
    """Fit on about ``quota`` labelled documents of each class; ``labels`` must hold only rows that may be learned from.

    The sample of label rows is bounded by the quota, so it is sent to the documents, not they to it.
    Equal texts of a label count once, and a text of both labels for each; labels other than 0
    and 1, null ids and null texts don't count. The rows alone decide which are taken. Without documents
    of both labels nothing can be told apart: the model says so (``learned``).
    """
    rows = labels.select(F.col(f"`{ident}`").alias("_id"), F.col(f"`{label}`").cast("int").alias("_label")).where("_label in (0, 1) and _id is not null")
    sample, total, quota = labelled(rows, "_label", ("_id",), quota)
    texts = docs.select(F.col(f"`{ident}`").alias("_own"), F.col(f"`{text}`").cast("string").alias("text")).where("text is not null")
    frame = texts.join(F.broadcast(sample), F.col("_own") == F.col("_id")).select("text", F.col("_label").alias("label")).distinct()
    frame = frame.orderBy(F.xxhash64("text"), "label").limit(4 * quota).toPandas()  # many texts may have one id
    frame = trimmed(frame, "label", quota)
    return fit(frame["text"].tolist(), frame["label"].tolist(), {y: total.get(y, 0) for y in (0, 1)})


def score(docs: DataFrame, model: Model, ident: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(ident, score, predicted) for each row, by its whole text alone; null and empty texts are scored alike."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = shared.value.score(batch.column(1).to_pylist())
            yield pa.record_batch([batch.column(0), pa.array(scores, pa.float64()), pa.array((scores >= threshold).astype(np.int32))], names=["id", "score", "predicted"])

    kind = dict(docs.dtypes)[ident]
    found = map_arrow(docs.select(F.col(ident), F.col(text).cast("string")), run, f"id {kind}, score double, predicted int")
    return found.withColumnRenamed("id", ident)


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """``docs`` without those predicted 0; all columns stay, and so do all rows where the model has learned nothing."""
    if not model.learned:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = shared.value.score(batch.column(batch.schema.get_field_index(text)).to_pylist())
            yield batch.filter(pa.array(scores >= threshold))

    return map_arrow(docs, run, docs.schema)
