"""Language identification by error-correcting output codes.

Every language has a codeword. For each bit a binary naive Bayes classifier
over hashed byte trigrams predicts the bit: its weights are log odds of a
trigram under the languages whose codeword has the bit against the others.
Decoding sums a loss over the bits for every codeword, weighted by how well a
bit's classifier tells the languages apart, and takes the least; where the
runner-up is close, the text is flagged as ambiguous.

The classifiers need no more than trigram counts by language. Tasks count
whole texts and add up before the shuffle, so the driver gets at most
``languages x buckets`` sums, whatever the size of the corpus.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import Carried, pieces, rebuild, utf8

BITS = 15
_COUNT = T.StructType([T.StructField("label", T.StringType()), T.StructField("code", T.IntegerType()), T.StructField("n", T.LongType())])

# Lower-case letters and all bytes beyond ASCII stay; anything else is a space.
_FOLD = np.full(256, 32, np.uint8)
_FOLD[ord("a") : ord("z") + 1] = _FOLD[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[128:] = np.arange(128, 256)


def _spread(multiplier: int, fold: np.ndarray) -> np.ndarray:
    return (fold.astype(np.uint64) * np.uint64(multiplier) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


_FIRST, _SECOND, _THIRD = (_spread(m, _FOLD) for m in (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35))
_MIDDLE = _FOLD != 32


def trigrams(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, position) of each trigram around a letter; texts are padded with spaces."""
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero(_MIDDLE[data[1:-1]])
    code = _FIRST[data[at]] ^ _SECOND[data[at + 1]] ^ _THIRD[data[at + 2]]
    code ^= code >> np.uint32(15)
    code *= np.uint32(0x2C1B3C6D)
    return (code >> np.uint32(32 - BITS)).astype(np.int64), at + 1


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """One row of -1 and 1 per language.

    Up to five languages take the exhaustive code of 2^(n-1) - 1 bits. More
    take, of 64 random codes of ceil(10 log2 n) bits, the one whose closest
    codewords are furthest apart.
    """
    if n < 2:
        return np.ones((n, 0), np.int8)
    if n <= 5:
        bits = [[1] + [1 if k >> i & 1 else -1 for i in range(n - 1)] for k in range(2 ** (n - 1) - 1)]
        return np.array(bits, np.int8).T
    rng, best, far = np.random.default_rng(seed), None, -1
    size = int(np.ceil(10 * np.log2(n)))
    for _ in range(64):
        code = rng.choice(np.array([-1, 1], np.int8), (n, size))
        code = code[:, np.abs(code.sum(axis=0, dtype=np.int64)) < n]
        apart = (code[:, None, :] != code[None, :, :]).sum(axis=2)
        least = int(apart[~np.eye(n, dtype=bool)].min())
        if least > far:
            best, far = code, least
    return best


@dataclass
class LanguageModel:
    labels: list[str]
    code: np.ndarray  # languages x bits, -1 or 1
    weights: np.ndarray  # buckets x bits, log odds
    trust: np.ndarray  # bits

    def decode(self, total: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(best language, score, lead of the loss over the runner-up) of summed log odds over n trigrams."""
        if self.code.shape[1] == 0:
            return np.zeros(len(n), np.int64), np.ones(len(n)), np.full(len(n), np.inf)
        margin = total / np.maximum(n, 1)[:, None] * (np.minimum(n, 24) / 2)[:, None]
        loss = np.stack([(self.trust * np.logaddexp(0, -margin * word)).sum(axis=1) for word in self.code], axis=1)
        order = np.sort(loss, axis=1)
        share = np.exp(order[:, :1] - loss).sum(axis=1)
        return loss.argmin(axis=1), 1 / share, order[:, 1] - order[:, 0]


def fit(docs: DataFrame, text: str = "text", label: str = "lang") -> LanguageModel:
    """Learn from every row of ``docs`` with a label; its texts are read whole.

    Rows with a null label or text teach nothing. Without any labelled row the
    model has no language and predicts ``und`` only.
    """
    carried = Carried(docs, text, [label, text])
    c_label = carried.at(label)
    rows = carried.df.where(F.col(c_label).isNotNull()).select(F.col(c_label).cast("string").alias("label"), F.concat(F.lit(" "), "body", F.lit(" ")).alias("body"))

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            data, offsets, _ = utf8(batch.column(1))
            labels = np.array(batch.column(0).to_pylist(), object)
            for i, j in pieces(offsets):
                codes, at = trigrams(data[offsets[i] : offsets[j]])
                doc = np.searchsorted(offsets[i : j + 1] - offsets[i], at, "right") - 1
                names, which = np.unique(labels[i:j].astype(str), return_inverse=True)
                own = which[doc]
                for k, name in enumerate(names.tolist()):
                    got = np.bincount(codes[own == k] if len(names) > 1 else codes, minlength=1 << BITS)
                    sums[name] = sums[name] + got if name in sums else got
        for name, got in sums.items():
            seen = np.flatnonzero(got)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(seen), pa.string()), pa.array(seen.astype(np.int32)), pa.array(got[seen].astype(np.int64))], names=_COUNT.names)

    sums = rows.mapInArrow(count, _COUNT).groupBy("label", "code").agg(F.sum("n").alias("n")).toArrow()
    names, which = np.unique(np.array(sums["label"].to_pylist(), str), return_inverse=True)
    counts = np.zeros((len(names), 1 << BITS))
    counts[which, sums["code"].to_numpy()] = sums["n"].to_numpy()
    share = (counts + 0.5) / (counts + 0.5).sum(axis=1, keepdims=True)
    code = codewords(len(names))
    weights = np.stack([np.log(share[b > 0].mean(axis=0)) - np.log(share[b < 0].mean(axis=0)) for b in code.T], axis=1) if code.shape[1] else np.zeros((1 << BITS, 0))
    expected = (share @ weights) * code
    trust = np.maximum(expected.min(axis=0), 0.01) if code.shape[1] else np.zeros(0)
    return LanguageModel(names.tolist(), code, weights.astype(np.float32), trust / max(trust.mean(), 1e-9) if len(trust) else trust)


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", keep: list[str] | None = None, lead: float = 0.5) -> DataFrame:
    """The columns ``keep`` of ``docs`` with ``lang_pred``, ``lang_score`` and ``ambiguous``.

    Whole texts are scored. ``lang_pred`` is a learned label, or ``und`` with
    score 0 where the text is null or has no letter. ``ambiguous`` is set where
    the second-best codeword's loss is within ``lead`` of the best, and for
    ``und``. Equal losses go to the label that sorts first. Columns named like
    a new one are replaced.
    """
    carried = Carried(docs, text, keep)
    order = carried.order
    padded = carried.df.withColumn("padded", F.concat(F.lit(" "), "body", F.lit(" ")))
    schema = T.StructType([*carried.fields(), T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())])

    def run(batches):
        for batch in batches:
            padded = batch.column(batch.num_columns - 1)
            data, offsets, present = utf8(padded)
            total, n, lettered = np.zeros((batch.num_rows, model.code.shape[1])), np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, bool)
            for i, j in pieces(offsets):
                part = data[offsets[i] : offsets[j]]
                codes, at = trigrams(part)
                if not len(at):
                    continue
                edges = np.searchsorted(at, offsets[i : j + 1] - offsets[i])
                n[i:j] = np.diff(edges)
                full = np.flatnonzero(n[i:j])
                total[i:j][full] = np.add.reduceat(model.weights[codes], edges[full], axis=0) if model.code.shape[1] else 0
                plain = np.concatenate([[0], np.cumsum(part[at] < 128)])
                lettered[i:j] = np.diff(plain[edges]) > 0
            for d in np.flatnonzero(present & ~lettered & (n > 0)).tolist():  # only bytes beyond ASCII: letters or signs
                lettered[d] = any(map(str.isalpha, padded[d].as_py()))
            known = lettered if model.labels else np.zeros(batch.num_rows, bool)
            best, score, ahead = model.decode(total, n)
            names = np.array([*model.labels, "und"], object)[np.where(known, best, len(model.labels))]
            new = [pa.array(names.tolist(), pa.string()), pa.array(np.where(known, score, 0.0)), pa.array(~known | (ahead < lead))]
            yield pa.RecordBatch.from_arrays([*rebuild(batch, order), *new], names=schema.names)

    return carried.restore(padded.mapInArrow(run, schema), "lang_pred", "lang_score", "ambiguous", mapped=True)
