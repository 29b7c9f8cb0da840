"""Pages, licences, fingerprints and benchmark windows."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import decontaminate, fingerprint, html_text, licences

from .conftest import prose, split_words

ARTICLE = "<html><head><title>t</title><style>p{}</style></head><body><nav><a href='/'>Home</a></nav><div class='ad-box'>Buy</div><article><header><h1>Head</h1><p class='byline'>By X</p></header><p>One &amp; <b>two</b><br>three</p><aside>side</aside><p>four<script>var a='</p>'</script></p><form>f</form><section id='comments'><article>reply</article></section></article><footer>&copy; x</footer></body></html>"


def test_lines_by_structure():
    assert html_text.lines(ARTICLE) == [("Home", 0), ("Buy", 1), ("Head", 2), ("By X", 0), ("One & two three", 2), ("side", 0), ("four", 2), ("f", 0), ("reply", 0), ("© x", 0)]


@pytest.mark.parametrize("page, texts", [
    ("", []), ("plain", ["plain"]), ("a < b and c<d", ["a < b and c"]), ("<p>x<p>y", ["x", "y"]), ("<!-- c --><p>x<!-- open", ["x"]), ("<script>x", []), ("<p title='a>b'>x</p>", ["x"]), ("</", []), ("<p>\xa0 a\n\tb </p>", ["a b"]), ("<div hidden>h</div>v", ["v"]), ("<p style='display: none'>h</p>v", ["v"]), ('<p title="open>x', ["x"]),
])
def test_odd_markup(page, texts):
    assert [t for t, k in html_text.lines(page) if k] == texts


@pytest.mark.parametrize("page, texts", [
    ("<article class='post tags-news'><div class='entry-header'><h1 class='page-header'>T</h1></div><p class='notice-period'>x</p><div class='ad'>s</div><math><mi>y</mi></math></article>", ["T", "x", "y"]),
    ("<main><p>x</p><div id='comments'><p>c</p></div><article class='related'>r</article></main>", ["x"]),
    ("<body class='has-sidebar'><div class='notice'>n</div><div>x</div></body>", ["x"]),
    ("<article><table><tr><td>a</td><td>b</td></tr><tr><td>c</td></tr></table><ul><li>d<li>e</ul></article>", ["a b", "c", "d", "e"]),
    ("<article>x<br/>y<span>z</span>&nbsp;&#233;&lt;</article>", ["x yz é<"]),
])
def test_marks_in_classes(page, texts):
    found = html_text.lines(page)
    kind = 2 if any(k == 2 for _, k in found) else 1
    assert [t for t, k in found if k == kind] == texts


def test_unclosed_menu_does_not_swallow_the_article():
    assert [t for t, k in html_text.lines("<nav><ul><li>m<article><p>x</p></article>") if k == 2] == ["x"]


@pytest.mark.parametrize("page", [
    "<div class='has-sidebar'>{}</div>", "<div class='content-with-sidebar'>{}</div>", "<div id='layout-no-sidebar'>{}</div>", "<div class='widget-area-on'>{}</div>",
    "<form action='/'><p>in</p>{}</form>", "<div class='modal'>{}</div>", "<aside><p>s</p>{}", "<button>b{}", "<form><input>{}",
])
def test_wrappers_do_not_swallow_the_article(page):
    assert [t for t, k in html_text.lines(page.format("<article><p>x</p></article>")) if k == 2] == ["x"]


def test_articles_of_others_stay_boilerplate():
    other = "<article><p>o</p></article>"
    for page in (f"<aside>{other}</aside>", f"<div class='comments faces'>{other}</div>", f"<div class='related'>{other}</div>", f"<div hidden>{other}</div>"):
        assert not any(k for _, k in html_text.lines(page))
    assert [t for t, k in html_text.lines(f"<div class='sidebar'>{other}</div><main><p>x</p></main>") if k == 2] == ["x"]


def longest(a, b):
    table = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
    return table[-1, -1]


def test_common_subsequence_is_longest():
    rng = random.Random(0)
    for _ in range(400):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(12))] for _ in range(2))
        pairs = html_text.common(a, b)
        assert len(pairs) == longest(a, b) and all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))


def test_long_pages_align_in_seconds():
    """50,000 lines that alternate, against as many shifted ones: a pair for each equal line would be 10^9."""
    a, b = [1, 2] * 25_000, [3, *[2, 1] * 25_000]
    began = time.perf_counter()
    assert len(html_text.common(a, b)) == 49_999 and time.perf_counter() - began < 30


def test_pages_meet_their_neighbours(spark):
    own = lambda k: f"<p>{prose(random.Random(k), 12, 10**6)}</p><p>{prose(random.Random(-k), 9, 10**6)}</p>"
    text = lambda k: own(k)[3:-4].replace("</p><p>", "\n\n")
    page = lambda inner: f"<div>Site name</div><div>{inner}</div><div>All rights</div>"
    inside = lambda inner: f"<article><p>Read more on Site</p>{inner}<p>Share this text</p></article>"
    quoted = "<p>to be or not to be that is what was asked</p>"
    rows = [(i, f"http://a.org/x/{i}?q", page(own(i))) for i in range(5)]
    rows += [(10 + i, f"http://b.org/x/{i}", inside(own(10 + i) + (quoted if i in (2, 3) else ""))) for i in range(6)]
    rows += [(20, "http://c.org/", page(own(20))), (21, None, page(own(21))), (22, "http://a.org/y", None), (23, "nonsense", ""), (None, "http://G.org/x/3", ARTICLE)]
    rows += [(30 + i, f"http://d.org/p?{i}", page(own(30)).replace("rights", f"rights {i}")) for i in range(3)]  # near copies
    rows += [(40, "http://e.org/p", page(own(40))), (41, "http://e.org/p#t", page(own(40))), (40, "http://e.org/p", page(own(40)))]  # copies
    rows += [(50, "http://f.org/1", page(own(50))), (51, "http://f.org/2", page(own(51)))]  # two texts on a host
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumnRenamed("page_id", "main_text").withColumnRenamed("main_text", "key")
    assert html_text.extract(df).columns == ["key", "url", "html", "main_text", "n_template"]
    got = html_text.extract(df).collect()
    found = {r.key: r.main_text for r in got}
    assert len(got) == len(rows)
    for k in (*range(5), 11, 14, 50, 51):
        assert found[k] == text(k), k
    for k in (12, 13):
        assert found[k] == text(k) + "\n\n" + quoted[3:-4]
    for k in (10, 15):  # first and last of their host: two neighbours are not enough inside an article
        assert found[k] == f"Read more on Site\n\n{text(k)}\n\nShare this text"
    for k in (20, 21, 40, 41):
        assert found[k] == f"Site name\n\n{text(k // 10 * 10 if k > 21 else k)}\n\nAll rights"
    for i in range(3):
        assert found[30 + i] == f"Site name\n\n{text(30)}\n\nAll rights {i}"
    assert found[22] == found[23] == "" and found[None] == "Head\n\nOne & two three\n\nfour"
    assert sum(r.n_template for r in got) == 2 * (5 + 4 + 2)
    clashing = df.withColumnsRenamed({"key": "main_text", "url": "host"})
    assert html_text.extract(clashing, url="host").columns == ["host", "html", "main_text", "n_template"]
    assert html_text.extract(clashing.limit(0), url="host").count() == 0


def brute_licences(text, least=0.8):
    """Every passage against every template, by the definition."""
    best = {}
    tokens = licences.normal_words(text or "")
    own = [f"{a} {b}" for a, b in zip(tokens, tokens[1:])]
    for name, template in licences.TEMPLATES:
        wanted = licences.template_bigrams(template)
        n = wanted.total()
        starts = [i for i, g in enumerate(own) if g in wanted]
        for i in starts:
            left, shared = dict(wanted), 0
            for j in range(i, min(i + int(n * (2 - least) / least), len(own))):
                if left.get(own[j], 0):
                    left[own[j]] -= 1
                    shared += 1
                d = 2 * shared / (j - i + 1 + n)
                if d >= least:
                    best[name] = max(d, best.get(name, 0))
    return sorted(best.items(), key=lambda x: (-x[1], x[0]))


def test_licences(spark, awkward):
    rng = random.Random(2)
    texts = [r.text for r in awkward.collect()]
    for name, template in licences.TEMPLATES:
        words = template.split(" ")
        texts += [template, f"{prose(rng, 20)}\n{template.upper()}\n{prose(rng, 5)}", f"x\n\n{template}\n \n{prose(rng, 5)}"]
        for share in (0.05, 0.1, 0.2):
            texts.append(" ".join(w if rng.random() > share else "changed" for w in words))
        texts.append(f"{prose(rng, 9)} {template}")
    texts += ["Released under the MIT License.\n" * 300, licences._GPL * 5]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: [(x.licence, x.dice) for x in r.licences] for r in licences.scan(df).collect()}
    assert got == {i: brute_licences(t) for i, t in enumerate(texts)} and sum(map(bool, got.values())) > 60
    rows = licences.scan(awkward.withColumn("licence", F.lit(1))).collect()
    assert [x for x in rows[0].asDict() if x not in awkward.columns] == ["licence", "dice", "licences"] and len(rows) == awkward.count()
    assert all(r.licence is None and r.licences == [] for r in rows) and licences.scan(awkward.limit(0)).count() == 0
    with pytest.raises(ValueError):
        licences.scan(df, least=0)


def test_licences_anywhere_in_long_texts(spark):
    """Paragraphs apart, wrapped lines, and grants in the middle of a sentence, with prose on both sides."""
    rng = random.Random(4)
    around = lambda t: f"{prose(rng, 300)}\n{t}\n{prose(rng, 300)}"
    wrapped = lambda t: "\n# ".join(" ".join(t.split()[i : i + 9]) for i in range(0, len(t.split()), 9))
    cases = []
    for name, template in licences.TEMPLATES:
        if len(template) > 200:
            cases += [(name, around(template.replace("\n", "\n\n"))), (name, around(wrapped(template)))]
        else:
            cases.append((name, f"{prose(rng, 50)} and so {template.lower()} But {prose(rng, 50)}"))
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: r.licences for r in licences.scan(df).collect()}
    for i, (name, _) in enumerate(cases):
        assert max((x.dice for x in got[i] if x.licence == name), default=0) == 1, (name, got[i])


def low_shingles(spark, texts):
    """The sketch of each text by its definition; only the hash of a shingle is Spark's."""
    shingles = [[w[i : i + 5] for i in range(max(1, len(w) - 4))] if w else [] for w in (split_words(t or "") for t in texts)]
    rows = sorted({tuple(g) for text in shingles for g in text})
    whole = spark.createDataFrame([(list(g),) for g in rows], "g array<string>")
    df = fingerprint.sketches(whole.select("g", F.array_join("g", " ").alias("text")), "text", "s", fraction=1.0)
    known = {tuple(r.g): r.s[0] for r in df.collect()}
    return [{h for h in (known[tuple(g)] for g in text) if h < -(1 << 63) + (1 << 61)} for text in shingles]


def likeness(a, b):
    return len(a & b) / min(len(a), len(b)) if a and b else float(len(a) == len(b))


def test_fingerprints(spark, awkward):
    rows = fingerprint.fingerprints(awkward).collect()
    assert [r.sketch for r in rows] == [sorted(s) for s in low_shingles(spark, [r.text for r in rows])]
    assert rows and all(h < -(1 << 63) + (1 << 61) for r in rows for h in r.sketch)
    by = {r.doc_id: r.sketch for r in rows}
    assert by[0] == by[1] == by[2] == [] and by[6] == by[7] and abs(len(by[10]) - 5996 / 8) < 150
    assert fingerprint.fingerprints(awkward.limit(0)).count() == 0


def test_containment_of_unequal_documents_and_merging(spark):
    rng = random.Random(7)
    big, other = prose(rng, 8000, 10**6), prose(rng, 3000, 10**6)
    part = " ".join(big.split(" ")[1000:1800])
    df = spark.createDataFrame([(big, part, other, big + " " + other, None)], "big string, part string, other string, both string, none string")
    for c in df.columns:
        df = fingerprint.sketches(df, c, f"s_{c}")
    row = df.select(
        fingerprint.containment("s_part", "s_big").alias("inside"), fingerprint.containment("s_part", "s_other").alias("apart"),
        fingerprint.containment("s_none", "s_none").alias("empty"), fingerprint.containment("s_none", "s_big").alias("half"), fingerprint.merged("s_big", "s_other").alias("m"), "s_both",
    ).first()
    assert row.inside == 1 and row.apart < 0.05 and row.empty == 1 and row.half == 0
    assert len(set(row.m) ^ set(row.s_both)) <= 4 and row.m == sorted(row.m)  # the joint has four shingles of its own


def test_edits(spark, awkward):
    rows = awkward.where("doc_id is not null").dropDuplicates().collect()
    got = {r.doc_id: r for r in fingerprint.compared_with_edits(awkward.where("doc_id is not null")).collect()}
    ordered = sorted(rows, key=lambda r: -r.doc_id)
    texts = [r.text or "" for r in ordered]
    following = [*texts[1:], texts[0]]
    edited = [t[: len(t) - len(t) // 3] + f[: len(t) // 3] for t, f in zip(texts, following)]
    own, other = low_shingles(spark, texts), low_shingles(spark, edited)
    for i, r in enumerate(ordered):
        g = got[r.doc_id]
        assert (g.edited, g.n_chars, set(g.sketch), set(g.edited_sketch)) == (edited[i], len(texts[i]), own[i], other[i])
        assert (g.near_edited, g.near_next) == (likeness(own[i], other[i]), likeness(own[i], own[(i + 1) % len(own)]))
    assert fingerprint.compared_with_edits(awkward).count() == awkward.count()
    assert fingerprint.compared_with_edits(awkward.limit(0)).count() == 0
    alone = fingerprint.compared_with_edits(awkward.where("doc_id = 6")).first()
    assert alone.near_next == 1


def fold(text):
    import re

    return [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]


def brute_contamination(text, tests):
    words, hit, items = fold(text), set(), set()
    for item, test in tests:
        w = fold(test)
        size = min(10, len(w))
        known = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if w else set()
        for i in range(len(words) - size + 1):
            if known and tuple(words[i : i + size]) in known:
                hit |= {*range(i, i + size)}
                if item is not None:
                    items.add(str(item))
    return len(words), len(hit), sorted(items)


def test_contamination(spark, awkward):
    rng = random.Random(9)
    tests = [(10, prose(rng, 40)), (9, prose(rng, 10)), (8, "Short item, É9"), (7, "word"), (6, "two, words"), (5, None), (4, "..."), (3, prose(rng, 12)), (3, prose(rng, 9)), (None, prose(rng, 11)), (2, "z " * 15)]
    tests.append((1, tests[0][1]))
    words = [t.split(" ") for _, t in tests if t]
    texts = [r.text for r in awkward.collect()] + [t for _, t in tests]
    for w in words:
        a = rng.randrange(len(w))
        texts.append(" ".join([prose(rng, 8), *w, prose(rng, 8), *w[a : a + 10], "x", *w[a : a + 9], *w[:12]]))
        texts.append(", ".join(w).upper() + " Short ITEM É9 short item é9 TWO-words word")
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, at int")
    bench = spark.createDataFrame(tests, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontaminate.contamination(df, bench).collect()}
    assert got == {i: brute_contamination(t, tests) for i, t in enumerate(texts)}
    for d, b, n in ((awkward, bench, awkward.count()), (awkward, bench.limit(0), awkward.count()), (awkward.limit(0), bench, 0)):
        assert decontaminate.contamination(d, b).count() == n
    spans = [r.spans for r in decontaminate.contamination(df, bench).where("n_hit > 0").collect()]
    assert all(s.start < s.end for x in spans for s in x) and all(a.end < b.start for x in spans for a, b in zip(x, x[1:]))
