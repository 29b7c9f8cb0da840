"""Language identification, quality and mixing."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import langid, mixing, quality
from pulsegrid.llm.queries import held_out, op7_quality, op10_language_id

from .conftest import prose, split_words

SF = "/root/testdata/sf0.01"


def test_codewords_are_apart():
    for n in (2, 3, 4, 5, 6, 20):
        code = langid.codewords(n)
        apart = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
        assert min(apart) >= (2 ** (n - 2) if n <= 5 else 5) and (np.abs(code.sum(axis=0)) < n).all()
    assert langid.codewords(1).shape == (1, 0)


def test_decoding_corrects_a_wrong_bit():
    code = langid.codewords(4)
    model = langid.LanguageModel(list("abcd"), code, np.zeros((1 << langid.BITS, 7)), np.ones(7))
    for k, word in enumerate(code):
        for wrong in range(7):
            margin = word.astype(float).copy()
            margin[wrong] *= -1
            best, score, lead = model.decode(margin[None] * 100, np.array([100]))
            assert best[0] == k and 0 < score[0] <= 1 and lead[0] > 0


def test_language_accuracy_on_held_out_documents(spark):
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op10_language_id(spark, SF).where("held_out").collect()
    assert len(rows) > 100 and sum(r.lang_pred == langs[r.doc_id] for r in rows) / len(rows) > 0.98


def test_language_of_awkward_rows(spark, awkward, small):
    model = langid.fit(small)
    got = langid.identify(awkward, model)
    assert got.columns == [*awkward.columns, "lang_pred", "lang_score", "ambiguous"]
    rows = got.collect()
    assert len(rows) == awkward.count() and all(0 <= r.lang_score <= 1 for r in rows)
    by = {r.doc_id: r for r in rows}
    assert all(by[i].lang_pred == "und" and by[i].ambiguous for i in (0, 1, 2)) and by[3].lang_pred in model.labels
    signs = spark.createDataFrame([(1, "123 — … 4"), (2, "日本"), (3, "ж"), (4, "x")], "doc_id long, text string")
    assert [r.lang_pred == "und" for r in langid.identify(signs, model).orderBy("doc_id").collect()] == [True, False, False, False]
    assert langid.identify(awkward.limit(0), model).count() == 0
    nothing = langid.fit(small.limit(0))
    assert {r.lang_pred for r in langid.identify(awkward, nothing).collect()} == {"und"}
    single = langid.fit(small.where("lang = 'fr'"))
    assert {r.lang_pred for r in langid.identify(small, single).collect()} == {"fr"}


def test_mixed_text_is_ambiguous(spark, small):
    """German with more and more French behind it: the ends are sure, and where the prediction turns it is not."""
    model = langid.fit(small)
    a, b = (" ".join(small.where(F.col("lang") == x).where("n_chars > 900").first().text.split(" ")[:100]) for x in ("de", "fr"))
    texts = [f"{a[: len(a) // 2]} {b[:k]}" for k in range(len(b))]
    rows = sorted(langid.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect(), key=lambda r: r.doc_id)
    assert [(rows[k].lang_pred, rows[k].ambiguous) for k in (0, -1)] == [("de", False), ("fr", False)]
    turn = next(i for i, r in enumerate(rows) if r.lang_pred != "de")
    unsure = [i for i, r in enumerate(rows) if r.ambiguous]
    assert unsure and all(abs(i - turn) < 60 for i in unsure)


def test_decoding_against_its_definition(spark, small):
    """Every trigram of a text looked up and every codeword weighed in plain loops; ties go to the first label."""
    model = langid.fit(small)
    texts = [r.text for r in small.limit(40).collect()] + ["x", "zz top", "É", "12 a 34"]
    for text in texts:
        codes, _ = langid.trigrams(np.frombuffer(b" " + text.encode() + b" ", np.uint8))
        total = [sum(float(model.weights[c, bit]) for c in codes) for bit in range(model.code.shape[1])]
        n = len(codes)
        losses = []
        for word in model.code:
            losses.append(sum(t * math.log1p(math.exp(-(s / n * min(n, 24) / 2) * w)) for t, s, w in zip(model.trust, total, word)))
        best, score, lead = model.decode(np.array([total]), np.array([n]))
        ranked = sorted(losses)
        assert losses[best[0]] == ranked[0] and math.isclose(score[0], 1 / sum(math.exp(ranked[0] - x) for x in losses), rel_tol=1e-6)
        assert math.isclose(lead[0], ranked[1] - ranked[0], rel_tol=1e-6, abs_tol=1e-9)
        row = langid.identify(spark.createDataFrame([(text,)], "text string"), model).first() if len(text) < 10 else None
        assert row is None or (row.lang_pred == model.labels[best[0]] and math.isclose(row.lang_score, score[0], rel_tol=1e-4))
    tied = langid.LanguageModel(list("ba"), langid.codewords(2), np.zeros((1 << langid.BITS, 1)), np.ones(1))
    row = langid.identify(spark.createDataFrame([("some text",)], "text string"), tied).first()
    assert (row.lang_pred, row.lang_score, row.ambiguous) == ("b", 0.5, True)


def auc(y, s):
    order = np.argsort(np.argsort(s))
    return (order[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() - 1) / 2) / ((y == 1).sum() * (y == 0).sum())


def test_quality_on_held_out_documents(spark):
    rows = op7_quality(spark, SF).where("held_out").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    y, s = np.array([r.quality for r in rows]), np.array([r.score for r in rows])
    assert auc(y, s) > 0.95 and np.mean([r.predicted == r.quality for r in rows]) > 0.93


def test_gradients_by_finite_differences():
    rng = np.random.default_rng(0)
    x, first, y = rng.normal(size=(9, quality.FEATURES)), np.array([0, 1, 4, 9]), np.array([1.0, 0, 1])
    model = quality.train(x, first, y, steps=3)

    def loss():
        p = model._forward(x, first)[-1]
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    for name, grad in model.gradients(x, first, y).items():
        value = np.array(model.p[name], float)
        at = tuple(rng.integers(0, s) for s in value.shape)
        around = []
        for h in (1e-5, -1e-5):
            moved = value.copy()
            moved[at] += h
            model.p[name] = moved
            around.append(loss())
        model.p[name] = value
        assert math.isclose((around[0] - around[1]) / 2e-5, np.asarray(grad)[at], rel_tol=1e-3, abs_tol=1e-7), name


def test_scores_against_their_definition():
    """Gated attention in plain loops; repeated passages and equal documents score alike."""
    rng = np.random.default_rng(4)
    x, first = rng.normal(size=(12, quality.FEATURES)), np.array([0, 1, 4, 8, 12])
    x[8:] = x[4:8]
    model = quality.train(x, first, np.array([1.0, 0, 1, 0]), steps=5)
    p, expected = model.p, []
    for a, b in zip(first, first[1:]):
        hidden = [np.tanh(((row - model.mean) / model.scale) @ p["e"] + p["e0"]) for row in x[a:b]]
        weight = [math.exp(sum(math.tanh(h @ p["v"][:, k]) / (1 + math.exp(-(h @ p["u"][:, k]))) * p["w"][k] for k in range(len(p["w"])))) for h in hidden]
        z = sum(w / sum(weight) * h for w, h in zip(weight, hidden))
        expected.append(1 / (1 + math.exp(-(z @ p["c"] + p["b"]))))
    got = model.score(x, first)
    assert np.allclose(got, expected) and got[2] == got[3]


def test_the_sample_is_of_whole_documents(spark, small):
    """Bounded by passages together, not within a document; one row of each id."""
    long = spark.createDataFrame([(5, "word " * 9000), (5, "other " * 9000), (6, "a b c"), (7, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(5, 1), (6, 0), (7, 0), (7, 1)], "doc_id long, quality int")
    seen = []
    original, quality.train = quality.train, lambda x, first, y: seen.append((np.diff(first).tolist(), y.tolist())) or original(x, first, y)
    try:
        quality.fit(long, labels)
        quality.fit(long, labels, max_passages=3)
    finally:
        quality.train = original
    assert seen == [([141, 1, 1], [1, 0, 1]), ([1], [0])] or seen[0] == ([141, 1, 1], [1, 0, 1]) and 141 not in seen[1][0]


def test_attention_finds_the_deciding_passage():
    """One odd passage among many decides the label; its weight is learned from documents' labels alone."""
    rng = np.random.default_rng(1)
    docs, y = [], []
    for k in range(200):
        bag = rng.normal(size=(rng.integers(3, 15), quality.FEATURES))
        bag[:, 0] = 0
        y.append(k % 2)
        bag[rng.integers(len(bag)), 0] = 5 if k % 2 else 0
        docs.append(bag)
    x, first = np.concatenate(docs), np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    model = quality.train(x, first, np.array(y, float))
    assert np.mean((model.score(x, first) > 0.5) == np.array(y)) > 0.95


def test_quality_of_awkward_rows(spark, awkward, small):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(200)] + [(None, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(small, labels, max_docs=50)
    rows = quality.score(awkward, model).collect()
    assert len(rows) == awkward.count() and all(0 <= r.quality_score <= 1 for r in rows)
    assert quality.score(awkward.limit(0), model).count() == 0
    empty = quality.fit(small, labels.limit(0))
    assert {r.quality_score for r in quality.score(awkward, empty).collect()} == {0.5}


def test_passages_cover_whole_texts():
    rng = random.Random(3)
    texts = [prose(rng, n).encode() for n in (0, 1, 63, 64, 65, 500)]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    x, first = quality.passages(np.frombuffer(b"".join(texts), np.uint8), offsets)
    assert np.diff(first).tolist() == [1, 1, 1, 1, 2, 8] and len(x) == first[-1]


def filled(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """Targets by raising one common level until all is dealt."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    total, low, high = share * sum(sizes.values()), 0.0, 1e12
    for _ in range(200):
        level = (low + high) / 2
        given = sum(min(most * sizes[s], level * weight[s]) for s in order)
        low, high = (level, high) if given < total else (low, level)
    return {s: min(most * sizes[s], low * weight[s]) for s in order}


def test_targets_are_filled_to_one_level(spark):
    rng = random.Random(6)
    for _ in range(4):
        sizes = {f"s{i}": rng.choice([0, 1, 10, 500, 20000]) for i in range(7)} | {None: 40}
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in mixing.targets(df).collect()}
        assert all(math.isclose(got[s], t, rel_tol=1e-6, abs_tol=1e-6) for s, t in filled(sizes).items())


def test_mix(awkward, small):
    docs = small.select("doc_id", "text", F.when(F.col("source") != "src3", F.col("source")).alias("source"))
    rows = mixing.mix(docs).collect()
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs.repartition(7)).collect())) and len(rows) == docs.count()
    taken, target, largest = defaultdict(int), {}, defaultdict(int)
    for r in rows:
        assert r.size == len(split_words(r.text or "")) and 0 <= r.copies <= 2
        taken[r.source] += r.copies * r.size
        target[r.source] = r.target
        largest[r.source] = max(largest[r.source], r.size)
    assert all(abs(taken[s] - target[s]) <= 2 * largest[s] for s in target)
    assert abs(sum(target.values()) - 1.5 * sum(r.size for r in rows)) < 1
    got = mixing.mix(awkward)
    assert got.count() == awkward.count() and got.where("copies is null").count() == 0
    assert mixing.mix(awkward.limit(0)).count() == 0


def test_systematic_sample_is_even(spark):
    """Documents of one size: of any k in a row, copies differ from k steps by less than one."""
    df = spark.createDataFrame([(i, "a b c", "s") for i in range(500)] + [(1000 + i, "x y", "t") for i in range(900)], "doc_id long, text string, source string")
    rows = mixing.mix(df).collect()
    for source in "st":
        own = [r for r in rows if r.source == source]
        step = own[0].target / own[0].source_size
        assert abs(sum(r.copies for r in own) - step * len(own)) <= 1


@pytest.mark.parametrize("value, expected", [(None, True)])
def test_rows_without_id_teach_nothing(spark, value, expected):
    assert spark.createDataFrame([(value,)], "doc_id long").select(held_out()).first()[0] is expected
