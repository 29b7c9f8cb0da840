"""Quality classification by attention-based multiple-instance learning.

A document is a bag of passages, runs of ``PASSAGE`` words that cover the
whole text. Each passage is described by its words and byte trigrams, hashed to
buckets, and by shares of character classes and word shapes, encoded by one
dense layer, and weighted by gated attention (tanh x sigmoid) that is softmaxed
over the passages of its document. The weighted sum of encodings is what the
last layer scores. Only documents have labels: the attention learns by itself
which passages decide.

Fitting takes a bounded sample of whole documents: labelled rows by hash of the
id, one of each id, at most ``max_docs`` and as many as have ``max_passages``
passages together, in numpy on the driver. Scoring covers every passage of every
document, in tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tokens
from .langid import BITS, trigrams
from .shingles import words
from .storage import Carried, cut, lists, pieces, rebuild, utf8

PASSAGE = 64
SPACES = "[\\x20\\x09-\\x0D]+"
_CLASSES = 12
_KIND = np.zeros(256, np.int64)
for _k, _set in enumerate(["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,;:", "!?", "|", "#$%&*@^~+=_", "'\"()-", "<>{}[]/\\`", "\n\r", " \t\v\f"]):
    for _c in _set:
        _KIND[ord(_c)] = _k
_KIND[128:] = _CLASSES - 1
_KIND[[b for b in range(32) if b not in b"\n\r\t\v\f"]] = 8
_UPPER = _KIND == 1
_SIGN = np.isin(_KIND, (4, 5, 6, 8))
_END = np.isin(np.arange(256), list(b".!?"))
_SHAPES = _CLASSES + 9
#: Bits of the buckets of words, and of trigrams.
HASHED = 6
FEATURES = _SHAPES + 2 * (1 << HASHED)


def _shares(owner: np.ndarray, code: np.ndarray, m: int) -> np.ndarray:
    """Square roots of the shares of each bucket, by passage."""
    counts = np.bincount((owner << HASHED) + code, minlength=m << HASHED).reshape(m, 1 << HASHED)
    return np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1))


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features of each passage, offsets by text) of the texts of a piece; every text has a passage."""
    n = len(offsets) - 1
    starts, ends, at = tokens.words(data, offsets)
    n_words = np.diff(at)
    each = np.maximum(1, -(-n_words // PASSAGE))
    first = np.concatenate([[0], np.cumsum(each)])
    doc = np.repeat(np.arange(n), each)
    rank = np.arange(first[-1]) - first[doc]
    word_from = at[doc] + rank * PASSAGE
    word_to = np.minimum(word_from + PASSAGE, at[doc + 1])
    begin = offsets[doc].copy()
    later = rank > 0
    begin[later] = starts[word_from[later]]
    sizes = np.diff(np.append(begin, offsets[-1]))
    m = len(doc)
    kinds = np.bincount(np.repeat(np.arange(m) * _CLASSES, sizes) + _KIND[data], minlength=m * _CLASSES).reshape(m, _CLASSES)
    out = np.zeros((m, FEATURES), np.float32)
    out[:, :_CLASSES] = kinds / np.maximum(sizes, 1)[:, None]
    count = word_to - word_from
    per = np.maximum(count, 1)
    own = np.repeat(np.arange(m), count)
    if len(starts):
        lengths = ends - starts
        upper = np.concatenate([[0], np.cumsum(_UPPER[data])])
        total = lambda x: np.bincount(own, weights=x, minlength=m)
        mean = total(lengths) / per
        out[:, _CLASSES] = mean / 10
        out[:, _CLASSES + 1] = np.sqrt(np.maximum(total(lengths.astype(float) ** 2) / per - mean**2, 0)) / 10
        out[:, _CLASSES + 2] = total((upper[ends] - upper[starts] == lengths) & (lengths > 1)) / per
        out[:, _CLASSES + 3] = total(_UPPER[data[starts]]) / per
        out[:, _CLASSES + 4] = total(_SIGN[data[ends - 1]]) / per
        out[:, _CLASSES + 5] = total(_END[data[ends - 1]]) / per
        code = tokens.word_codes(data, starts, ends)
        out[:, _SHAPES : _SHAPES + (1 << HASHED)] = _shares(own, (code >> np.uint64(64 - HASHED)).astype(np.int64), m)
        distinct = np.unique(tokens.mix(code ^ (own.astype(np.uint64) << np.uint64(40))) & np.uint64(0xFFFFFFFF00000000) | own.astype(np.uint64))
        out[:, _CLASSES + 6] = np.bincount((distinct & np.uint64(0xFFFFFFFF)).astype(np.int64), minlength=m) / per
    code, at = trigrams(data)
    out[:, _SHAPES + (1 << HASHED) :] = _shares(np.repeat(np.arange(m), sizes)[at], code >> (BITS - HASHED), m)
    out[:, _CLASSES + 7] = np.log1p(count) / 5
    out[:, _CLASSES + 8] = np.log1p(n_words[doc]) / 10
    return out, first


def _sum(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, first[:-1], axis=0)


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray]

    def _forward(self, x: np.ndarray, first: np.ndarray):
        p, doc = self.p, np.repeat(np.arange(len(first) - 1), np.diff(first))
        h = np.tanh(x @ p["e"] + p["e0"])
        t, g = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
        s = (t * g) @ p["w"]
        a = np.exp(s - np.maximum.reduceat(s, first[:-1])[doc])
        a = a / _sum(a, first)[doc]
        z = _sum(a[:, None] * h, first)
        return doc, h, t, g, a, z, 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["b"], -30, 30)))

    def score(self, features: np.ndarray, first: np.ndarray) -> np.ndarray:
        return self._forward((features - self.mean) / self.scale, first)[-1].astype(float)

    def gradients(self, x: np.ndarray, first: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        doc, h, t, g, a, z, out = self._forward(x, first)
        d_out = (out - y) / len(y)
        d_z = d_out[:, None] * p["c"]
        far = d_z[doc]
        d_a = (h * far).sum(axis=1)
        d_s = a * (d_a - _sum(a * d_a, first)[doc])
        d_tg = d_s[:, None] * p["w"]
        d_t, d_g = d_tg * g * (1 - t**2), d_tg * t * g * (1 - g)
        d_h = (a[:, None] * far + d_t @ p["v"].T + d_g @ p["u"].T) * (1 - h**2)
        return {"c": z.T @ d_out, "b": d_out.sum(), "w": (t * g).T @ d_s, "v": h.T @ d_t, "u": h.T @ d_g, "e": x.T @ d_h, "e0": d_h.sum(axis=0)}


def train(features: np.ndarray, first: np.ndarray, y: np.ndarray, hidden: int = 16, attention: int = 8, steps: int = 300, rate: float = 0.02, decay: float = 1e-4, seed: int = 3) -> QualityModel:
    """Full-batch Adam; without any row the model scores 0.5."""
    rng = np.random.default_rng(seed)
    shape = {"e": (FEATURES, hidden), "e0": (hidden,), "v": (hidden, attention), "u": (hidden, attention), "w": (attention,), "c": (hidden,), "b": ()}
    kind = features.dtype
    p = {k: (rng.normal(0, 1 / np.sqrt(s[0]), s) if len(s) == 2 or k in "wc" else np.zeros(s)).astype(kind) for k, s in shape.items()}
    if not len(y):
        return QualityModel(np.zeros(FEATURES), np.ones(FEATURES), p | {"c": np.zeros(hidden)})
    model = QualityModel(features.mean(axis=0), features.std(axis=0) + 1e-3, p)
    model.scale = model.scale.astype(kind)
    x, y = (features - model.mean) / model.scale, y.astype(kind)
    m, v = ({k: np.zeros(s, kind) for k, s in shape.items()} for _ in range(2))
    for step in range(1, steps + 1):
        for k, g in model.gradients(x, first, y).items():
            g = g + decay * p[k]
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g**2
            p[k] = (p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(kind)
    return model


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", ident: str = "doc_id", label: str = "quality", max_docs: int = 6000, max_passages: int = 60_000) -> QualityModel:
    """Learn from rows of ``docs`` that have a 0 or 1 in ``labels``: the sample described above.

    Rows with a null id or label are left out. Of rows with one id the one
    whose text has the least hash is taken, and of its labels the greatest. The
    sample is the rows whose id has the least hash, each with all its passages,
    so that reruns agree.
    """
    known = labels.select(F.col(ident).alias("id"), F.col(label).cast("double").alias("y")).where("id is not null and y in (0, 1)")
    texts = docs.select(F.col(ident).alias("id"), F.col(text).cast("string").alias("body"))
    ids = texts.select("id").join(known, "id").groupBy("id").agg(F.max("y").alias("y"))
    rank = [F.xxhash64("id"), F.col("id")]
    first = cut(ids.orderBy(*rank).limit(max_docs), "sample")  # one number and label for each of max_docs ids
    body = F.coalesce("body", F.lit(""))
    rows = cut(texts.join(F.broadcast(first), "id").groupBy("id", "y").agg(F.min_by(body, F.xxhash64(body)).alias("body")), "sample")
    n = F.greatest(F.ceil(F.size(words("body", SPACES)) / PASSAGE), F.lit(1))
    so_far = F.sum("n").over(Window.orderBy(*rank))  # max_docs rows
    rows = rows.join(F.broadcast(rows.select("id", n.alias("n")).withColumn("n", so_far).where(F.col("n") <= max_passages).select("id")), "id").select("id", "y", "body")
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("y", T.DoubleType()), T.StructField("x", T.ArrayType(T.FloatType()))])

    def describe(batches):
        for batch in batches:
            data, offsets, _ = utf8(batch.column(2))
            found = []
            for i, j in pieces(offsets):
                x, first = passages(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                found += [x[a:b].ravel() for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.float32()))], names=schema.names)

    got = rows.mapInArrow(describe, schema).orderBy("id").toArrow().combine_chunks()
    if not got.num_rows:
        return train(np.zeros((0, FEATURES)), np.zeros(1, np.int64), np.zeros(0))
    x, at = lists(got["x"].combine_chunks() if isinstance(got["x"], pa.ChunkedArray) else got["x"])
    return train(x.reshape(-1, FEATURES).astype(np.float32), at // FEATURES, got["y"].to_numpy())


def score(docs: DataFrame, model: QualityModel, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` with ``quality_score``, 0 to 1.

    A null or empty text is one empty passage. Columns named like the new one
    are replaced.
    """
    carried = Carried(docs, text, keep)
    order = carried.order
    schema = T.StructType([*carried.fields(), T.StructField("quality_score", T.DoubleType())])

    def run(batches):
        for batch in batches:
            data, offsets, _ = utf8(batch.column(batch.schema.get_field_index("body")))
            out = np.zeros(batch.num_rows)
            for i, j in pieces(offsets):
                out[i:j] = model.score(*passages(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))
            yield pa.RecordBatch.from_arrays([*rebuild(batch, order), pa.array(out)], names=schema.names)

    return carried.restore(carried.df.mapInArrow(run, schema), "quality_score", mapped=True)
