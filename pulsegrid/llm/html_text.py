"""Main-text extraction: page structure and nearest-URL page differencing.

Every page becomes lines, one per block of text, each marked by its tags as part
of the main element, outside of it, or inside a menu, header, footer, sidebar,
advert, form or comments. The text of a page is its main element, or all that is
outside of boilerplate where it has none.

Of that text, differencing decides. Pages of a host stand in order of URL path,
equal texts once; each is paired with the two before and the two after it, and
the lines of a pair are aligned by longest common subsequence. A line that the
page shares with two of them or more, and with more than half, is template and
is deleted; a line that it shares with one is a quotation. Inside a main element,
where sentences recur by chance, it takes all of them, and three or four. A page
of a host with two texts meets one other, and loses what it shares with it only
outside of main elements. No page loses more than half of its characters: pages
that share more are copies of each other.

Pages are parsed once, into a table; only line hashes meet their neighbours.
"""

from __future__ import annotations

import re
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .order import neighbours
from .storage import Carried, cut, joined, lists, rebuild

#: Kinds of lines.
BOILERPLATE, OUTSIDE, MAIN = 0, 1, 2

_BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav noframes noscript ol optgroup option p pre section select summary table tbody tfoot thead title tr ul".split())
_SPACED = frozenset("br td th wbr img input textarea button iframe video audio svg".split())
_RAW = frozenset("script style noscript template svg textarea title iframe xmp noembed noframes".split())
_DROPPED = frozenset("nav footer aside form select button menu dialog head".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
#: A class or id that is one of these words, not one that merely holds it, names a part that is no text.
_MARKS = frozenset("ad ads advert adverts advertisement comment comments footer header menu nav navigation notice notices related replies reply sidebar".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: On an article, main element or heading only these count: their classes often name what is around them.
_STRONG = frozenset("ad ads advert adverts advertisement comment comments related replies reply".split())
#: Of these, a main element inside undoes the mark: they may wrap a page, or lack an end.
_LAYOUT = frozenset("header nav menu banner navigation toolbar".split())
#: These hold main elements of others, also where a page has none elsewhere.
_OTHERS = _STRONG | {"dialog", "select", "head", "hidden", "complementary"}

_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
_REST = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*+)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?+""")
_HOST = r"(?s)^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)"


def _reason(name: str, attributes: str, inside: bool) -> str | None:
    """The word that marks an element as boilerplate; ``inside`` a main element a header's class does not."""
    if name in _DROPPED:
        return name
    if not attributes or name in ("html", "body"):
        return None
    marks = _STRONG if name in _HEADINGS or name in ("article", "main") else _MARKS - {"header"} if inside else _MARKS
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key == "hidden" or key == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return "hidden"
        if key == "role" and value.lower() in _ROLES:
            return value.lower()
        if key in ("class", "id"):
            for token in value.lower().split():
                if token in marks:
                    return token
    return None


def _is_main(name: str, attributes: str) -> bool:
    return name in ("article", "main") or bool(attributes) and bool(re.search(r"""role\s*=\s*["']?main\b|itemprop\s*=\s*["']?articleBody\b""", attributes, re.I))


def lines(html: str) -> list[tuple[str, int]]:
    """(text, kind) of each block of a page, in page order; white space is collapsed.

    If every main element of a page is inside boilerplate, what holds it is a
    wrapper, or lacks its end: the mark is then undone, but for comments,
    adverts and links to other texts, and an aside that has its end.
    """
    out = _lines(html)
    if any(kind == MAIN for _, kind in out):
        return out
    low = html.lower()
    if not re.search(r"<(?:article|main)\b|role\s*=\s*[\"']?main\b|articlebody", low):
        return out
    kept = _OTHERS if len(re.findall(r"<aside\b", low)) > low.count("</aside") else _OTHERS | {"aside"}
    again = _lines(html, kept)
    return again if any(kind == MAIN for _, kind in again) else out


def _lines(html: str, kept: frozenset[str] | None = None) -> list[tuple[str, int]]:
    """``lines`` of one pass, in which a main element undoes marks of ``_LAYOUT``, or all that are not ``kept``."""
    out: list[tuple[str, int]] = []
    parts: list[str] = []
    skip: list[str] = []  # [name, reason] of the outermost boilerplate element
    depth = main_depth = header_depth = heading = 0
    main_name = ""
    low = None

    def flush() -> None:
        text = " ".join(unescape("".join(parts)).split())
        parts.clear()
        if text:
            dropped = skip or header_depth and not (main_depth and heading)
            out.append((text, BOILERPLATE if dropped else MAIN if main_depth else OUTSIDE))

    at, n = 0, len(html)
    while at < n:
        tag = html.find("<", at)
        if tag < 0:
            parts.append(html[at:])
            break
        if tag > at:
            parts.append(html[at:tag])
        following = html[tag + 1 : tag + 2]
        if following in ("!", "?"):
            end = html.find("-->", tag + 4) if html.startswith("<!--", tag) else html.find(">", tag)
            at = n if end < 0 else end + (3 if html.startswith("<!--", tag) else 1)
            continue
        closing = following == "/"
        found = _NAME.match(html, tag + 1 + closing)
        if not found:
            parts.append("<" if not closing else "")
            at = tag + 1 if not closing else (html.find(">", tag) + 1 or n)
            continue
        name = found[0].lower()
        rest = _REST.match(html, found.end())
        end = rest.end() if rest else (html.find(">", found.end()) + 1 or n)
        attributes = html[found.end() : end - 1]
        at = end
        if not closing and name in _RAW:
            if not attributes.endswith("/"):
                low = html.lower() if low is None else low
                stop = low.find(f"</{name}", at) if len(low) == n else html.find(f"</{name}", at)
                at = n if stop < 0 else (html.find(">", stop) + 1 or n)
            parts.append(" ")
            continue
        if name in _BLOCKS:
            flush()
        elif name in _SPACED:
            parts.append(" ")
        if name in _VOID:
            continue
        if closing:
            if skip and name == skip[0]:
                depth -= 1
                if not depth:
                    flush()
                    skip = []
            elif not skip:
                if main_depth and name == main_name:
                    main_depth -= 1
                elif name == "header" and header_depth:
                    header_depth -= 1
            if name in _HEADINGS:
                heading = 0
            continue
        if name in _HEADINGS:
            heading = 1
        why = _reason(name, attributes, main_depth > 0)
        is_main = why is None and _is_main(name, attributes)
        if skip and is_main and (skip[1] in _LAYOUT or kept is not None and skip[1] not in kept):
            flush()
            skip = []
        if skip:
            depth += name == skip[0]
        elif why is not None and not (name == "header"):
            flush()
            skip, depth = [name, why], 1
        elif name == "header":
            header_depth += 1
        elif is_main and not main_depth:
            flush()
            main_name, main_depth, header_depth = name, 1, 0
        elif main_depth and name == main_name:
            main_depth += 1
    flush()
    return out


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """The length of a longest common subsequence of ``a`` and each prefix of ``b``, one bit of a number for each of ``b``."""
    places: dict[int, int] = {}
    for j, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << j
    full = now = (1 << len(b)) - 1
    for x in a:
        if x in places:
            met = now & places[x]
            now = (now + met | now - met) & full
    bits = np.frombuffer((full ^ now).to_bytes(len(b) // 8 + 1, "little"), np.uint8)
    return np.concatenate([[0], np.cumsum(np.unpackbits(bits, bitorder="little")[: len(b)], dtype=np.int64)])


def common(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Index pairs of a longest common subsequence, in linear space: ``a`` is halved, and ``b`` cut where the halves fit best."""
    both = set(a) & set(b)
    places = [i for i, x in enumerate(a) if x in both], [j for j, x in enumerate(b) if x in both]
    a, b = ([x[i] for i in at] for x, at in zip((a, b), places))
    found, open_ = [], [(0, len(a), 0, len(b))]
    while open_:
        i, i_end, j, j_end = open_.pop()
        while i < i_end and j < j_end and a[i] == b[j]:
            found.append((i, j))
            i, j = i + 1, j + 1
        while i < i_end and j < j_end and a[i_end - 1] == b[j_end - 1]:
            i_end, j_end = i_end - 1, j_end - 1
            found.append((i_end, j_end))
        if i == i_end or j == j_end:
            continue
        if i_end - i == 1:
            if a[i] in b[j:j_end]:
                found.append((i, b.index(a[i], j)))
            continue
        half, other = (i + i_end) // 2, b[j:j_end]
        fit = _lengths(a[i:half], other) + _lengths(a[half:i_end][::-1], other[::-1])[::-1]
        at = j + int(fit.argmax())
        open_ += [(i, half, j, at), (half, i_end, at, j_end)]
    return [(places[0][i], places[1][j]) for i, j in sorted(found)]


def template_lines(sizes: np.ndarray, main: bool, shared: list[np.ndarray]) -> np.ndarray:
    """The lines of a page that are template: of each page it met, ``shared`` has the lines it has in common."""
    if main:
        least = max(3, len(shared))
    else:
        least = max(2, len(shared) // 2 + 1) if len(shared) > 1 else 1
    lost = np.flatnonzero(np.bincount(np.concatenate(shared), minlength=len(sizes)) >= least)
    return lost if 2 * sizes[lost].sum() <= sizes.sum() else lost[:0]


_LONGS, _INTS, _TEXTS = T.ArrayType(T.LongType()), T.ArrayType(T.IntegerType()), T.ArrayType(T.StringType())
_PAGE = [T.StructField("host", T.StringType()), T.StructField("sig", T.LongType())]


def _templates(parsed: DataFrame) -> DataFrame:
    """``host, sig, lost``: of parsed pages, the lines that differencing deletes."""
    texts = parsed.where("host is not null and size(hashes) > 0").groupBy("host", "sig").agg(F.min("path").alias("path"), *[F.first(c).alias(c) for c in ("hashes", "sizes", "main")])
    texts = cut(texts, "texts")
    ordered = neighbours(texts.select("host", "path", "sig"), ["host", "path", "sig"], ["host", "sig"])
    ordered = ordered.where(F.col("after.host") == F.col("host")).select("host", "sig", F.col("after.sig").alias("next"))
    second = ordered.select("host", F.col("sig").alias("next"), F.col("next").alias("second"))
    pairs = ordered.union(ordered.join(second, ["host", "next"]).select("host", "sig", "second"))
    lines_of = lambda name, to: texts.select("host", F.col("sig").alias(name), F.col("hashes").alias(to))
    met = pairs.join(lines_of("sig", "one"), ["host", "sig"]).join(lines_of("next", "other"), ["host", "next"]).select("host", "sig", "next", "one", "other")
    schema = T.StructType([*_PAGE, T.StructField("shared", _INTS)])

    def align(batches):
        for batch in batches:
            host, sig, after, one, other = batch.columns
            found = [common(a, b) for a, b in zip(one.to_pylist(), other.to_pylist())]
            for page, side in ((sig, 0), (after, 1)):
                yield pa.RecordBatch.from_arrays([host, page, pa.array([[p[side] for p in pairs] for pairs in found], pa.list_(pa.int32()))], names=schema.names)

    votes = met.mapInArrow(align, schema).groupBy("host", "sig").agg(F.collect_list("shared").alias("shared"))  # four at most
    votes = votes.where("exists(shared, x -> size(x) > 0)").join(texts.select("host", "sig", "sizes", "main"), ["host", "sig"]).select("host", "sig", "shared", "sizes", "main")
    done = T.StructType([*_PAGE, T.StructField("lost", _INTS)])

    def decide(batches):
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns[2:]))
            lost = [template_lines(np.array(sizes), main, [np.array(x, np.int64) for x in shared]).tolist() for shared, sizes, main in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lost, pa.list_(pa.int32()))], names=done.names)

    return votes.mapInArrow(decide, done).where("size(lost) > 0")


def extract(pages: DataFrame, html: str = "html", url: str = "url", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``pages`` with ``main_text`` and ``n_template``, the lines that differencing deleted.

    Blocks are joined by two newlines; character references are decoded and
    white space inside a block is one space. Null and empty pages give an empty
    text. Pages without a host, or with the only text of their host, have no
    pair and are judged by structure alone. Rows that repeat a row, and all
    pages of a host with equal texts, are judged as one. Columns named like a
    new one are replaced.
    """
    keep = pages.columns if keep is None else keep
    carried = Carried(pages, html, list(dict.fromkeys([*keep, url, html])))
    kept = {n.lower() for n in keep} - {"main_text", "n_template"}
    order = [c for c, n in zip(carried.order, carried.names) if n.lower() in kept]
    fields = [T.StructField(c, t) for c, t in zip(carried.order, carried.types) if c in order]
    address = F.trim(F.col(carried.at(url)).cast("string")) if carried.at(url) in carried.columns else F.lit(None).cast("string")
    source = carried.df.withColumns({"host": F.nullif(F.lower(F.regexp_extract(address, _HOST, 1)), F.lit("")), "path": F.regexp_replace(address, _HOST, "")})
    schema = T.StructType([*_PAGE, T.StructField("path", T.StringType()), T.StructField("main", T.BooleanType()), T.StructField("hashes", _LONGS), T.StructField("sizes", _INTS), T.StructField("texts", _TEXTS), *fields])

    def parse(batches):
        for batch in batches:
            at = {n: i for i, n in enumerate(batch.schema.names)}
            pages = [lines(page or "") for page in batch.column(at["body"]).to_pylist()]
            main = [any(k == MAIN for _, k in page) for page in pages]
            texts = [[t for t, k in page if k == (MAIN if m else OUTSIDE)] for page, m in zip(pages, main)]
            hashes = [np.array([xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) for t in page], np.uint64).view(np.int64) for page in texts]
            sigs = [xxhash.xxh3_64_intdigest(h.tobytes()) - (1 << 63) for h in hashes]
            new = [pa.array(sigs, pa.int64()), batch.column(at["path"]), pa.array(main), pa.array(hashes, pa.list_(pa.int64())), pa.array([[*map(len, page)] for page in texts], pa.list_(pa.int32())), pa.array(texts, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(at["host"]), *new, *rebuild(batch, order)], names=schema.names)

    parsed = cut(source.mapInArrow(parse, schema), "pages")
    judged = joined(parsed.drop("path", "hashes", "sizes", "main"), cut(_templates(parsed), "templates"), ["host", "sig"], "left")
    done = T.StructType([*fields, T.StructField("main_text", T.StringType()), T.StructField("n_template", T.IntegerType())])

    def write(batches):
        for batch in batches:
            at = {n: i for i, n in enumerate(batch.schema.names)}
            out, lost, lost_at = [], *lists(batch.column(at["lost"]))
            for d, texts in enumerate(batch.column(at["texts"]).to_pylist()):
                gone = {*lost[lost_at[d] : lost_at[d + 1]].tolist()}
                out.append("\n\n".join(t for i, t in enumerate(texts) if i not in gone))
            yield pa.RecordBatch.from_arrays([*rebuild(batch, order), pa.array(out, pa.string()), pa.array(np.diff(lost_at).astype(np.int32))], names=done.names)

    names = dict(zip(carried.order, carried.names))
    return judged.mapInArrow(write, done).select(*[F.col(c).alias(names[c]) for c in order], "main_text", "n_template")
