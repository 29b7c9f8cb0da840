"""The pipeline's stages, each against the brute-force version of its decision."""

import hashlib

import corpus_pipeline
from pyspark.sql import functions as F

from pulsegrid.llm.queries import ORACLES, QUERIES

from .conftest import split_words
from .test_dedup import brute_simhash, brute_words, similar_groups
from .test_text import brute_contamination

SF = "/root/testdata/sf0.001"


def test_stages_in_order(spark, tmp_path):
    docs, kept = spark.read.parquet(f"{SF}/documents.parquet"), []
    columns = docs.columns
    tests = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        assert name == corpus_pipeline.STAGES[i][0] and (i == 4 or out.columns == columns)
        out.write.parquet(str(tmp_path / name))
        before, after = {r.doc_id: r.text for r in docs.collect()}, spark.read.parquet(str(tmp_path / name))
        got = {r.doc_id: r["text"] if i < 4 else r for r in after.collect()}
        if i == 0:
            expected = before  # all of these texts are clean
        elif i == 1:
            least = {}
            for d, root in zip(before, similar_groups(list(before.values()))):
                least[root] = min(d, least.get(root, d))
            expected = {d: before[d] for d in least.values()}
        elif i == 2:
            cut = dict(zip(before, brute_words(list(before.values()))))
            expected = {d: (before[d] if not n else text) for d, (_, n, text) in cut.items() if not n or text}
        elif i == 3:
            expected = {d: t for d, t in before.items() if not brute_contamination(t, tests)[1]}
        else:
            assert all(r.taken == r.copies * len(split_words(before[d])) and r.text_sha256 == hashlib.sha256(before[d].encode()).hexdigest() for d, r in got.items())
            expected = got
        assert got == expected, name
        kept.append(len(got))
        docs = after
    assert kept == sorted(kept, reverse=True) and kept[1] < 200
    assert corpus_pipeline.run(spark, SF).count() == kept[-1]


def test_awkward_rows_pass_through(spark, awkward, tmp_path):
    docs = awkward.select("doc_id", "text", "lang", "source", "n_chars", "key", "body")
    for table in (docs, docs.limit(0)):
        now = table
        for _, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, SF).checkpoint()
        assert (now.count() > 0) == (table is docs)


def test_one_query_for_each_operator():
    names = [n for n in QUERIES if n.startswith("op")]
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 11)] and {*ORACLES} <= {*QUERIES}


def test_clean_documents_stay(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert corpus_pipeline.language(spark, docs, SF).count() == docs.count()
    assert corpus_pipeline.language(spark, docs.withColumn("text", F.lit("12 34")), SF).count() == 0


def test_near_copies_beyond_three_bits_go(spark, small):
    """A copy with two words of 100 changed: five-word similarity 0.82, SimHashes further apart than 3 bits."""
    text = " ".join(f"w{i}" for i in range(100))
    copies = [(10_000, text), (10_001, text.replace("w30 ", "x ").replace("w70 ", "y "))]
    a, b = map(brute_simhash, (copies[0][1], copies[1][1]))
    assert (a ^ b).bit_count() > 3
    planted = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in copies], "doc_id long, text string, lang string, source string, n_chars long")
    docs = small.limit(20).select(*planted.columns).union(planted)
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()} & {10_000, 10_001} == {10_000}


def test_each_group_keeps_its_own_row(spark):
    """Several null ids, and ids that are repeated with different texts."""
    text = lambda k: " ".join(f"{k}{i}" for i in range(60))
    rows = [(None, text("a")), (None, text("b")), (None, text("c")), (3, text("c") + " more"), (1, text("d")), (2, text("d") + " more"), (2, text("e")), (2, text("f")), (2, text("f")), (7, text("g")), (7, text("g") + " more")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()]
    assert len(got) == 7 and {(None, text("a")), (None, text("b")), (3, text("c") + " more"), (1, text("d")), (2, text("e")), (2, text("f"))} < {*got}
    assert sum(i == 7 for i, _ in got) == 1
