"""Main text of web pages by nearest-URL page differencing.

Pages are sorted by host and URL path; a page is paired with the neighbour of its host whose path has
the longer common beginning, the text lines (blocks) of both are aligned by their longest common
subsequence, and shared lines are deleted: a template repeats on neighbouring pages, an article does
not. Two things are exact checks on top: lines inside a marked article (``article``, ``main`` and the
like) are never deleted, since neighbours may be copies or quote each other, and lines inside marked
page furniture (menus, headers, footers, sidebars, notices, adverts, forms, comments, by element, role
or class name) go even where the neighbour has others. A class or id counts by whole names, and not on a
main part or what holds it (an article in a box of related ones holds it only if no other is left). All other lines are decided by the differencing
alone, whether or not the page has marked ones. If two pages share nearly all of their unmarked lines,
and of their marked article if there is one, they are copies of each other, not a template, and nothing
is deleted.

Plan: one parsing pass gives a page's lines; pages are dealt into blocks of neighbouring URLs, whose
bounds come from a bounded sample of keys, and a streaming pass over the sorted blocks holds three
pages. A host with a third of all pages is many blocks. The first and last page of a block also go to
the blocks before and after it, as neighbours only, so no pair is lost at a block's end.

Defined cases: null html gives an empty text; null URLs have an empty host and path and are neighbours
of each other by id; unclosed and truncated markup is read as far as it goes; unknown references stay
as they are; repeated rows are neighbours. Extra columns are ignored.
"""

from __future__ import annotations

import html as html_lib
import os
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from featuremart.llm.common import map_batches, read_table
from featuremart.llm.op5_fingerprint import block_of

BLOCK_PAGES, BLOCKS = 400, 16384
COPY_SHARE = 0.8  # share of common unmarked lines from which two pages are copies

# Element names and the class, id and role words of page furniture.
RAW = ["script", "style", "noscript", "template", "textarea", "svg", "iframe", "object", "title"]
BLOCK_TAGS = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption "
                 "figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p "
                 "pre section select summary table tbody td tfoot th thead tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE = set("nav aside footer form head button select menu dialog".split())
MAIN = {"article", "main"}
WORDS = set("ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar "
            "navigation menu breadcrumb breadcrumbs sidebar aside footer masthead cookie cookies consent gdpr notice "
            "newsletter subscribe signup popup modal overlay share sharing social comment comments disqus respond "
            "related widget toolbar pagination pager login search skip".split())
ROLES = set("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
MAIN_ROLES = {"main", "article"}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?:svg|object)(?=[\s/>])(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+(?<=/)>"
    r"|<(?P<raw>" + "|".join(RAW) + r")(?=[\s/>])(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>"
    r".*?(?:</(?P=raw)(?=[\s/>])[^>]*>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)(?:>|\Z)",
    re.S | re.I)
_ATTR = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
OTHER, IN_MAIN, IN_FURNITURE = 0, 1, 2


def _marks(name: str, attrs: str, inside_main: bool) -> tuple[bool, bool, bool, bool]:
    """(page furniture, furniture by a class or id word, main part, main part other than an article) by
    an element's name and attributes."""
    main = name in MAIN
    body = name == "main"
    word = False
    out = name in FURNITURE or (name == "header" and not inside_main)
    if attrs.strip(" /\n\t"):
        for m in _ATTR.finditer(attrs):
            key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if key == "role":
                out |= value in ROLES
                main |= value in MAIN_ROLES
                body |= value == "main"
            elif key in ("class", "id") and name not in ("body", "html"):
                words = set(value.split())
                word |= bool(words & WORDS) or ("header" in words and not inside_main)
            elif key == "itemprop":
                main |= value == "articlebody"
                body |= value == "articlebody"
            elif key == "hidden" or (key == "aria-hidden" and value == "true"):
                out = True
            elif key == "style":
                out |= "display:none" in value.replace(" ", "")
    return out, word and not main, main, body


def lines_of(page: str | None) -> tuple[list[str], list[int]]:
    """The page's blocks in order, white space turned into single spaces, and each block's place."""
    texts: list[str] = []
    places: list[tuple] = []
    run: list[str] = []
    # (element, in furniture, in main, marks by words around: each a list of one flag, lifted later if
    # the element holds the main part)
    stack: list[tuple[str, bool, bool, tuple]] = []
    around_articles: list[tuple] = []
    page = page or ""

    def hidden(place: tuple) -> bool:
        return place[1] or any(m[0] for m in place[3])

    def close() -> None:
        if run:
            text = " ".join("".join(run).split())
            run.clear()
            if text:
                texts.append(text)
                places.append(stack[-1] if stack else ("", False, False, ()))

    def add(text: str) -> None:
        if text:
            run.append(html_lib.unescape(text) if "&" in text else text)

    at = 0
    for m in _TOKEN.finditer(page):
        add(page[at:m.start()])
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if name == "br":
            run.append(" ")
            continue
        block = name in BLOCK_TAGS
        if block:
            close()
        if m["end"]:
            if any(f[0] == name for f in stack):
                if not block:
                    close_inline = stack[-1][0] == name
                    if not close_inline:
                        continue
                    if hidden(stack[-1]) and not (len(stack) > 1 and hidden(stack[-2])):
                        run.clear()  # the text of inline furniture
                while stack.pop()[0] != name:
                    pass
            continue
        if name in VOID:
            continue
        if block and stack and stack[-1][0] == "p":
            stack.pop()  # a block ends an open paragraph
        above = stack[-1] if stack else ("", False, False, ())
        out, word, main, body = _marks(name, m["attrs"] or "", above[2])
        if not block:
            if not (out or word) or hidden(above):
                continue
            close()  # inline furniture inside a block parts it
        if main and above[3]:
            if body:
                for mark in above[3]:
                    mark[0] = False  # words do not hide what holds the main part
            else:
                around_articles.append(above[3])
        stack.append((name, above[1] or out, above[2] or main, (*above[3], [True]) if word else above[3]))
    add(page[at:])
    close()
    if not any(p[2] and not hidden(p) for p in places):  # no main part elsewhere: the articles are it
        for marks in around_articles:
            for mark in marks:
                mark[0] = False
    return texts, [IN_FURNITURE if hidden(p) else IN_MAIN if p[2] else OTHER for p in places]


def common_lines(a: list, b: list) -> list[tuple[int, int]]:
    """Places (i, j) of a longest common subsequence: bit-parallel rows over the lines both have."""
    both = set(a) & set(b)
    ia, ib = [i for i, x in enumerate(a) if x in both], [j for j, x in enumerate(b) if x in both]
    if not ia:
        return []
    where: dict = {}
    for k, j in enumerate(ib):
        where[b[j]] = where.get(b[j], 0) | 1 << k
    full = (1 << len(ib)) - 1
    v, rows = full, []
    for i in ia:
        u = v & where[a[i]]
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    out, r, c = [], len(ia), len(ib)
    while r and c:
        if rows[r - 1] >> c - 1 & 1:
            c -= 1
        else:
            r -= 1
            if not r or rows[r - 1] >> c - 1 & 1:
                c -= 1
                out.append((ia[r], ib[c]))
    return out[::-1]


def main_text(texts: list[str], kinds: list[int], other: tuple[list[str], list[int]] | None) -> str:
    """The page without furniture and without the unmarked lines shared with its neighbour."""
    shared: set[int] = set()
    if other is not None:
        shared = {i for i, _ in common_lines(texts, other[0])}
        loose = [i for i, k in enumerate(kinds) if k == OTHER]
        main = [i for i, k in enumerate(kinds) if k == IN_MAIN]  # copies share their marked article too
        if loose and sum(i in shared for i in loose) >= COPY_SHARE * len(loose) and len(loose) + len(main) > 1 \
                and sum(i in shared for i in main) >= COPY_SHARE * len(main) \
                and sum(k == OTHER for k in other[1]) <= len(loose) / COPY_SHARE:
            shared = set()
    keep = [t for i, (t, k) in enumerate(zip(texts, kinds)) if k == IN_MAIN or (k == OTHER and i not in shared)]
    return "\n".join(keep)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: page_id, url, text, n_chars, and the neighbour that it was compared with."""
    kind = dict(pages.dtypes)[id_col]
    url = F.coalesce(F.col(url_col), F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    path = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host.alias("host"),
                        path.alias("path"), F.col(html_col).alias("html"))
    # the id makes keys of one address differ, so that very many copies of it are several blocks too
    key = F.concat_ws("\u0001", "host", "path", F.lpad(F.coalesce(F.col("page_id").cast("string"), F.lit("")), 20, "0"))
    keys = rows.select(key.alias("key"))
    n = min(BLOCKS, keys.count() // BLOCK_PAGES)
    bounds = [r["key"] for r in keys.orderBy(F.xxhash64("key"), "key").limit(n).collect()]
    placed = rows.withColumn("key", key)
    block = block_of(sorted(set(bounds)), F.col("key"))
    guests = _guests(placed.select(block.alias("block"), "key"))

    def parse(blocks, ks, ids, urls, hosts, paths, htmls):
        made = [lines_of(h) for h in htmls]
        return blocks, ks, ids, urls, hosts, paths, [t for t, _ in made], [bytes(k) for _, k in made]

    parsed = map_batches(placed.select(block.alias("block"), "key", "page_id", "url", "host", "path", "html"), parse,
                         f"block int, key string, page_id {kind}, url string, host string, path string, "
                         "texts array<string>, kinds binary")
    parsed = parsed.join(F.broadcast(guests), F.col("key") == F.col("edge"), "left").drop("edge")
    also = F.coalesce("also", F.array().cast("array<int>"))
    parsed = parsed.withColumn("own", F.col("block")).withColumn("block", F.explode(F.concat(F.array("block"), also)))
    parsed = parsed.select("block", "key", "page_id", "url", "host", "path", "texts", "kinds",
                           (F.col("block") == F.col("own")).alias("own"))
    dealt = parsed.repartition("block").sortWithinPartitions("block", "key", "url")

    def run(batches):
        before = now = None
        for batch in batches:
            out = []
            for row in zip(*[batch.column(i).to_pylist() for i in range(batch.num_columns)]):
                if now is not None and now[8]:
                    out.append(_decided(before, now, row))
                before, now = now, row
            if out:
                yield _batch(out, batch.schema.field(2).type)
        if now is not None and now[8]:
            yield _batch([_decided(before, now, None)], batch.schema.field(2).type)

    return dealt.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long, compared_with string")


def _guests(keys: DataFrame) -> DataFrame:
    """Rows (edge, also) of rows (block, key): the least and greatest key of a block and the blocks next to it, of
    those with pages, that need their pages as neighbours; at most two rows a block."""
    ends = keys.groupBy("block").agg(F.min("key").alias("first"), F.max("key").alias("last"))
    near = Window.orderBy("block")  # over BLOCKS + 1 rows at most
    ends = ends.select("first", "last", F.lag("block").over(near).alias("before"), F.lead("block").over(near).alias("after"))
    pairs = F.array(F.struct(F.col("first").alias("edge"), F.col("before").alias("to")),
                    F.struct(F.col("last").alias("edge"), F.col("after").alias("to")))
    return (ends.select(F.inline(pairs)).where(F.col("to").isNotNull())
            .groupBy("edge").agg(F.collect_set("to").alias("also")))


def _batch(out: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    types = [kind, pa.string(), pa.string(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out), types)],
                                      names=["page_id", "url", "text", "n_chars", "compared_with"])


def _decided(before: tuple | None, now: tuple, after: tuple | None) -> tuple:
    """A page's result against the nearer of its neighbours on the same block and host."""
    best = None
    for other in (before, after):
        if other is not None and other[0] == now[0] and other[4] == now[4]:
            near = len(os.path.commonprefix([other[5], now[5]]))
            if best is None or near > best[0]:
                best = near, other
    other = best[1] if best else None
    text = main_text(now[6], list(now[7]), (other[6], list(other[7])) if other else None)
    return now[2], now[3], text, len(text), other[3] if other else None


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages"))
