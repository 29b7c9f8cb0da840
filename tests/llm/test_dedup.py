"""Near-duplicates, repeated windows and repeated bytes against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from pulsegrid.llm import near_dedup, substring_dedup, suffix_dedup
from pulsegrid.llm.graph import components

from .conftest import prose, split_words


def brute_simhash(text):
    words = split_words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    """rows of (id, fingerprint) -> component of each fingerprint's rows."""
    fps = sorted({f for _, f in rows})
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    least = {}
    for i, f in rows:
        if i is not None:
            least[find(f)] = min(i, least.get(find(f), i))
    return [(i, f, least.get(find(f))) for i, f in rows]


def near(df):
    return sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in near_dedup.near_duplicates(df).collect()), key=str)


def test_near_duplicates_of_awkward_rows(spark, awkward):
    rows = [(r.doc_id, brute_simhash(r.text)) for r in awkward.collect()]
    assert near(awkward) == sorted(brute_components(rows), key=str)
    assert near(awkward.limit(0)) == []


def test_near_duplicates_of_planted_edits(spark, small):
    rng = random.Random(3)
    texts = [r.text for r in small.limit(60).collect()]
    for t in list(texts):
        words = (t or "").split(" ")
        for _ in range(3):
            if len(words) > 30:
                words[rng.randrange(len(words))] = "edit"
                texts.append(" ".join(words))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    expected = brute_components([(i, brute_simhash(t)) for i, t in enumerate(texts)])
    assert near(df) == sorted(expected, key=str) and len({c for _, _, c in expected}) < len(texts) - 20


def test_every_link_within_the_distance(spark):
    """Fingerprints at distances 1 to 4 from each other; a chain links, a gap of four does not."""
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = set(base)
    for f in base:
        for d in (1, 2, 3, 4):
            g = f
            for b in rng.sample(range(64), d):
                g ^= 1 << b
            fps.add(g)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    found = near_dedup.links(spark.createDataFrame([(f,) for f in signed], "fp long"))
    got = {r.node: r.component for r in components(found).collect()}
    rows = [(f, f % (1 << 64)) for f in signed]
    expected = {f: c for f, _, c in brute_components(rows)}
    assert {f: got.get(f, f) for f in signed} == expected


def test_large_branches_are_split_into_shells(spark):
    """One branch of many near copies, blocks far smaller than it: every link is found, whatever block it crosses."""
    rng = random.Random(6)
    centre, fps = rng.getrandbits(64), set()
    while len(fps) < 900:
        f = centre
        for b in rng.sample(range(30, 64), rng.randrange(2, 9)):
            f ^= 1 << b
        fps.add(f)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    expected = {f: c for f, _, c in brute_components([(f, f % (1 << 64)) for f in signed])}
    for leaf in (16, 100, 5000):
        got = {r.node: r.component for r in components(near_dedup.links(df, leaf=leaf, small=8)).collect()}
        assert {f: got.get(f, f) for f in signed} == expected
    assert near_dedup.links(df.limit(0)).count() == 0


def test_groups_across_batches():
    """Groups are whole however batches are cut; those beyond the bound come in parts, all rows once."""
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 12, 60)
    key, value = np.repeat(np.arange(60), sizes), np.arange(sizes.sum())
    for _ in range(20):
        at = [0, *sorted(rng.choice(np.arange(1, len(key)), 15, replace=False).tolist()), len(key)]
        batches = [pa.RecordBatch.from_arrays([pa.array(key[a:b]), pa.array(value[a:b])], names=["k", "v"]) for a, b in zip(at, at[1:])]
        seen = []
        for most in (None, 7):
            whole, parts = [], []
            for k, v, large in near_dedup._groups(iter(batches), 1, lambda k, v: (k, v, False), most, lambda k, v: (k, v, True)):
                (parts if large else whole).append((k, v))
                assert large is False or len({*k.tolist()}) == 1
            k = [set(k.tolist()) for k, _ in whole]
            assert sum(map(len, k)) == len(set().union(*k)) if k else True
            assert not set().union(*k) & {x for p, _ in parts for x in p.tolist()}
            assert sorted(x for _, v in [*whole, *parts] for x in v.tolist()) == value.tolist()
            seen.append(len(parts))
        assert seen[0] == 0


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 95), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 90: 90, 95: 90, 100: 90}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_words(texts, window=35):
    words = [split_words(t or "") for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append((len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


def brute_bytes(texts, depth=400):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + depth] for d in data for i in range(len(d) - depth + 1))
    out = []
    for d in data:
        gone = [False] * len(d)
        for i in range(len(d) - depth + 1):
            if seen[d[i : i + depth]] > 1:
                gone[i : i + depth] = [True] * depth
        out.append((len(d), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), bytes(x for x, g in zip(d, gone) if not g)))
    return out


def tally(rows):
    return Counter(map(repr, rows))


def test_repeated_windows_of_awkward_rows(awkward):
    rows = awkward.collect()
    got = substring_dedup.remove_repeated(awkward)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "key", "body", "kept", "n_words", "n_removed", "kept_text"]
    expected = [(r.doc_id, *x) for r, x in zip(rows, brute_words([r.text for r in rows]))]
    assert tally((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got.collect()) == tally(expected)
    assert substring_dedup.remove_repeated(awkward.limit(0)).count() == 0


def test_repeated_bytes_of_awkward_rows(awkward):
    rows = awkward.collect()
    got = suffix_dedup.remove_repeated_bytes(awkward).collect()
    expected = [(r.doc_id, *x) for r, x in zip(rows, brute_bytes([r.text for r in rows]))]
    assert tally((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in got) == tally(expected)
    assert suffix_dedup.remove_repeated_bytes(awkward.limit(0)).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_in_small_alphabets(spark, seed):
    """Few words and short windows: every kind of overlap occurs."""
    rng = random.Random(seed)
    texts = [prose(rng, rng.randrange(1, 120), 4) for _ in range(40)] + [None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.remove_repeated(df, window=6, k=3).collect())
    assert got == [(i, *x) for i, x in enumerate(brute_words(texts, 6))]
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in suffix_dedup.remove_repeated_bytes(df, depth=24, digit=5).collect())
    assert got == [(i, *x) for i, x in enumerate(brute_bytes(texts, 24))]


def test_repeated_bytes_of_a_whole_table(spark):
    """Every 400-byte string of sf0.01 against a count of all of them."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    seen, again = set(), set()
    for _, d in rows:
        for i in range(len(d) - 399):
            h = hash(d[i : i + 400])
            (again if h in seen else seen).add(h)
    expected = {}
    for doc, d in rows:
        gone, end = 0, 0
        for i in range(len(d) - 399):
            if hash(d[i : i + 400]) in again:
                gone, end = gone + i + 400 - max(end, i), i + 400
        expected[doc] = (len(d), gone)
    got = {r.doc_id: (r.n_bytes, r.n_removed) for r in suffix_dedup.remove_repeated_bytes(docs, keep=["doc_id"]).collect()}
    assert got == expected and sum(n > 0 for _, n in got.values()) > 100


def test_cut_hashes_match(small):
    rows = small.collect()
    got = {r.doc_id: hashlib.sha256(r.kept_text.encode()).hexdigest() for r in substring_dedup.remove_repeated(small, keep=["doc_id"]).collect()}
    assert got == {r.doc_id: hashlib.sha256(x[2].encode()).hexdigest() for r, x in zip(rows, brute_words([r.text for r in rows]))}


def five_word_sets(texts):
    words = [split_words("".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) for t in texts]
    return [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]


def similar_groups(texts, least=0.8):
    sets = five_word_sets(texts)
    root = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or len(a & b) >= least * len(a | b):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return root


def grouped(keys, roots):
    groups = {}
    for k, r in zip(keys, roots):
        groups.setdefault(r, set()).add(k)
    return sorted(map(sorted, groups.values()))


def test_similar_texts_with_planted_copies(spark, small):
    """Copies at similarities 0.7 to 0.97, most of them beyond 3 bits of SimHash; one large group."""
    rng = random.Random(11)
    texts = [r.text for r in small.collect()]
    for t in [prose(rng, 300, 10**6) for _ in range(60)] + [texts[0]] * 40:
        words = t.split(" ")
        n = len(words)
        for at in rng.sample(range(n), max(1, round(n * rng.choice([0.005, 0.01, 0.015, 0.02, 0.03])))):
            words[at] = f"edit{rng.randrange(10**6)}"
        texts += [t, " ".join(words)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    roots = similar_groups(texts)
    assert grouped(*zip(*((r.doc_id, r.root) for r in near_dedup.similar(df).collect()))) == grouped(range(len(texts)), roots)
    bits = [brute_simhash(t) for t in texts]
    assert sum(roots[i] == roots[i + 1] and (bits[i] ^ bits[i + 1]).bit_count() > 3 for i in range(200, 320, 2)) > 10


def test_similar_texts_of_awkward_rows(spark, awkward):
    rows = near_dedup.similar(awkward).collect()
    assert len(rows) == awkward.count() and near_dedup.similar(awkward.limit(0)).count() == 0
    data = [r for r in awkward.collect() if r.doc_id is not None]
    known = dict(zip((r.doc_id for r in data), similar_groups([r.text for r in data])))
    assert grouped(*zip(*((r.doc_id, r.root) for r in rows if r.doc_id is not None))) == grouped(known, known.values())
