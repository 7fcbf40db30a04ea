"""Main text of web pages with site templates removed.

Every page is read as a tree of elements. Each block element gets a hash of its whole subtree (tag,
text and children). Spark counts on how many pages of a host each subtree recurs; subtrees on at
least ``min_pages`` pages are template and are deleted, whatever the size of the host. Inside a marked article or main part
a subtree counts once for each different article around it, so what every article carries goes, and an article
published often stays whole; elements around an article are never template.

What the counts leave goes by its kind: navigation, headers and footers of the page, asides, forms, scripts, styles, and
elements whose class or id names an advert, notice, menu, sidebar or comment section; where a page marks its article or
main part, text outside it. Classes are judged when the page has been read: an element around the only article, or one
with most of the text that is named by a word within a class alone (``no-sidebar``), is not dropped.

Counting moves three hashes for each block; a host of any size is combined before it moves. The recurring (host, hash)
pairs are sent to the tasks up to ``max_sent`` of them; beyond, pages meet them by a join on host, hash and a salt.

Null html is empty and gives an empty text. A null or odd url belongs to a host named by what it
has. A null page_id keeps its row; repeated rows come out as often as they went in. Other columns are
never looked at. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stipple.llm.registry import named, table
from stipple.llm.shared import mixed, with_short_batches, written

MIN_PAGES = 5
MAX_SENT = 500_000  # recurring subtrees that are sent to all tasks; more are joined
SALTS = 16
TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|[!?][^>]*>|(/?)([A-Za-z][^\s/>]*)((?:[^"'>]|"[^"]*"|'[^']*')*)>)""", re.S)
NAMED = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
VOID = set("area base br col embed hr img input link meta source track wbr".split())
RAW = set("script style textarea title noscript template iframe svg xmp".split())
NEVER = RAW | set("head nav footer aside form button select option label fieldset menu dialog object canvas video audio".split())
BLOCK = set("html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption "
            "blockquote pre figure figcaption address details summary header footer nav aside form fieldset hr center".split())
#: A start of the first closes an open element of the second without an end tag.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPE = set("html body article main section div table td th ul ol dl nav aside footer header form blockquote".split())
#: Words in a class, id or role that name parts beside the main text.
BESIDE = set("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent notice "
             "alert popup modal menu nav navbar navigation breadcrumb breadcrumbs sidebar widget related recommended share sharing "
             "social comment comments disqus reply replies footer masthead newsletter subscribe signup login search pagination pager "
             "contentinfo complementary toolbar".split())


#: Words that open the class of a part beside the text which may be longer than the text.
COMMENTS = set("comment comments disqus reply replies".split())


class Element:
    __slots__ = ("tag", "hard", "soft", "main", "article", "scope", "above", "numbered", "parts", "size", "hash")

    def __init__(self, tag, above):
        self.tag, self.above, self.parts, self.size, self.hash = tag, above, [tag], 0, 0
        self.hard = above is not None and above.hard
        self.soft, self.main, self.numbered = 0, False, False
        #: The innermost marked part around the element, and whether an article is around it.
        self.scope = (above if above.main else above.scope) if above is not None else None
        self.article = above is not None and (above.article or (above.main and above.tag == "article"))

    def around(self):
        e = self.above
        while e is not None:
            yield e
            e = e.above


def beside(attributes: str) -> int:
    """2 where a whole class, id or role names a part beside the text, 1 where only a word within one does, else 0."""
    found = 0
    for m in NAMED.finditer(attributes):
        for name in (m[1] or m[2] or m[3] or "").lower().split():
            words = [w for w in re.split(r"[^a-z]+", name) if w]
            if name in BESIDE or (words and words[0] in COMMENTS):
                return 2
            found = found or int(any(w in BESIDE for w in words))
    return found


def spare(elements: list[Element], mains: list[Element]) -> None:
    """Takes the drop by class from elements that hold the article or most of the text.

    Where every article lies in such elements, those around the longest one are spared. Elements that only a
    word within a class names are spared where they hold more than half of the text of their marked part, or
    of a page without one.
    """
    free = lambda e: not e.soft and not any(x.soft for x in e.around())
    if mains and not any(free(e) for e in mains):
        longest = max(mains, key=lambda e: e.size)
        for e in (longest, *longest.around()):
            e.soft = 0
    marked = any(free(e) for e in mains)
    for e in elements:
        if e.soft == 1 and (e.scope is not None or not marked):
            whole = e.scope if e.scope is not None else list(e.around())[-1]
            if 2 * e.size > whole.size:
                e.soft = 0


def read(html: str) -> tuple[list[tuple[str, bool, bool, list[int]]], list[tuple[int, int | None]], bool]:
    """Blocks of (text, main text by its kind, in the marked part, indices of enclosing subtrees), subtrees, main part marked.

    Subtrees that may be template are numbered; the i-th is (signed 64-bit hash, hash of the innermost marked part around it).
    """
    found: list[tuple[str, Element]] = []
    root = Element("", None)
    stack = [root]
    numbered: list[Element] = []
    named_: list[Element] = []
    mains: list[Element] = []
    text: list[str] = []

    def flush() -> None:
        joined = " ".join(unescape("".join(text)).split()) if text else ""
        text.clear()
        if joined:
            top = stack[-1]
            top.parts.append(joined)
            top.size += 0 if top.hard else len(joined)
            found.append((joined, top))

    def close() -> None:
        element = stack.pop()
        digest = xxhash.xxh64_intdigest("\x1f".join(element.parts))
        stack[-1].parts.append(f"{digest:x}")
        stack[-1].size += element.size
        element.parts = []
        element.hash = digest - (1 << 64) if digest >> 63 else digest

    at = 0
    while True:
        m = TAG.search(html, at)
        if m is None:
            text.append(html[at:])
            break
        text.append(html[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            depth = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag), 0)
            if tag in BLOCK or tag in NEVER:
                flush()
                if depth:
                    while len(stack) > depth:
                        close()
            continue
        if tag in ("br", "wbr"):
            text.append(" " if tag == "br" else "")
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
            at = end.end() if end else len(html)
            continue
        if tag not in BLOCK and tag not in NEVER:
            continue
        flush()
        if tag in VOID:
            continue
        shut = CLOSES.get(tag, ())
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag == "p" or stack[k].tag in shut:
                while len(stack) > k:
                    close()
                if stack[-1].tag not in shut:
                    break
            elif stack[k].tag in SCOPE:
                break
        own = Element(tag, stack[-1])
        own.main = tag in ("article", "main") and not own.hard
        own.hard |= tag in NEVER or (tag == "header" and own.scope is None)
        if own.main:
            mains.append(own)
            for e in own.around():  # what is around an article is no template, or an article published often would go with it
                e.numbered = e.numbered and e.article
        elif not own.hard and tag not in ("html", "body"):
            own.soft = beside(m[3])
            if own.soft:
                named_.append(own)
        own.numbered = tag not in ("html", "body") and (tag not in ("article", "main") or own.article)
        if own.numbered:
            numbered.append(own)
        stack.append(own)
    flush()
    while len(stack) > 1:
        close()
    if named_:
        spare(named_, mains)
    numbered = [e for e in numbered if e.numbered]
    number = {id(e): k for k, e in enumerate(numbered)}
    known: dict[int, tuple[bool, bool, list[int]]] = {id(root): (True, False, [])}

    def state(e: Element) -> tuple[bool, bool, list[int]]:
        """Kept by kind, in a marked part that is kept, numbers of the subtrees around."""
        path = []
        while id(e) not in known:
            path.append(e)
            e = e.above
        got = known[id(e)]
        for x in reversed(path):
            kept = got[0] and not x.hard and not x.soft
            trees = [*got[2], number[id(x)]] if x.numbered else got[2]
            got = known[id(x)] = (kept, got[1] or (x.main and kept), trees)
        return got

    blocks = [(joined, *state(e)) for joined, e in found]
    marked = any(state(e)[1] for e in mains)
    return blocks, [(e.hash, e.scope.hash if e.scope is not None else None) for e in numbered], marked


def keyed(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    url, html = F.col(url_col).cast("string"), F.coalesce(F.col(html_col), F.lit(""))
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://)?([^/?#]*)", 1))
    return pages.select(F.col(id_col).alias("page_id"), url.alias("url"), F.xxhash64(host).alias("host"), html.alias("html"))


def subtrees(pages: DataFrame) -> DataFrame:
    """(host, hash, part) once for each page that has a subtree that may be template; part is the marked part around it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, found, parts = [], [], []
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = set(read(html.as_py())[1])
                hosts += [host] * len(own)
                found += [h for h, _ in own]
                parts += [p for _, p in own]
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.int64()), pa.array(found, pa.int64()), pa.array(parts, pa.int64())],
                                             names=["host", "hash", "part"])

    return pages.select("host", "html").mapInArrow(count, "host long, hash long, part long")


def recurring(pages: DataFrame, min_pages: int) -> DataFrame:
    """(host, hash) of subtrees on ``min_pages`` pages of a host; in marked parts, in as many different ones."""
    once = subtrees(pages).groupBy("host", "hash", "part").agg(F.count("*").alias("n"))
    n = F.sum(F.when(F.col("part").isNull(), F.col("n")).otherwise(1))
    return once.groupBy("host", "hash").agg(n.alias("n")).where(F.col("n") >= min_pages).select("host", "hash")


def pair_keys(host: int, hashes: list[int]) -> np.ndarray:
    """One 64-bit name of each (host, hash)."""
    step = np.uint64(host % (1 << 64) * 0x9E3779B97F4A7C15 % (1 << 64))
    return mixed(np.array(hashes, np.int64).view(np.uint64) + step)


def main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
              min_pages: int = MIN_PAGES, max_sent: int = MAX_SENT) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    rows = keyed(with_short_batches(pages), id_col, url_col, html_col)
    template = written(recurring(rows, min_pages))
    id_type = dict(rows.dtypes)["page_id"]
    listed = template.count() > max_sent
    if listed:
        rows = with_lists(rows, template)
        sent = None
    else:
        keys = np.sort(np.concatenate([np.empty(0, np.uint64)] + [
            pair_keys(host, group["hash"].tolist()) for host, group in template.toPandas().groupby("host")]))
        sent = pages.sparkSession.sparkContext.broadcast(keys)  # max_sent numbers at most

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for k, (host, html) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3))):
                blocks, own, marked = read(html.as_py())
                names = [h for h, _ in own]
                if sent is None:
                    listed_ = set(batch.column(4)[k].as_py() or ())
                    gone = [h in listed_ for h in names]
                else:
                    keys_ = pair_keys(host, names)
                    gone = (np.searchsorted(sent.value, keys_, "right") > np.searchsorted(sent.value, keys_)).tolist()
                texts.append("\n".join(t for t, kept, inside, trees in blocks
                                       if kept and (inside or not marked) and not any(gone[i] for i in trees)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    out = rows.mapInArrow(parse, f"page_id {id_type}, url string, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))


def with_lists(rows: DataFrame, template: DataFrame) -> DataFrame:
    """``rows`` with ``gone``, the recurring subtrees that a page itself has.

    Pages meet the recurring pairs subtree by subtree, salted by page, so neither a host nor a subtree on all of
    its pages lands in one task, and no list is longer than its page. Pages with the same html share a list.
    """
    page = [F.xxhash64("html").alias("__a"), F.xxhash64(F.lit(1), "html").alias("__b")]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, found = [], []
            for k, html in enumerate(batch.column(3)):
                own = {h for h, _ in read(html.as_py())[1]}
                of += [k] * len(own)
                found += own
            at = pa.array(of, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in range(3)), pa.array(found, pa.int64())],
                                             names=["host", "__a", "__b", "hash"])

    pairs = rows.select("host", *page, "html").mapInArrow(each, "host long, __a long, __b long, hash long")
    salts = template.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    own = pairs.withColumn("__salt", F.pmod("__a", F.lit(SALTS)).cast("int")).join(salts, ["host", "hash", "__salt"], "left_semi")
    lists = own.groupBy("host", "__a", "__b").agg(F.collect_set("hash").alias("gone"))
    return rows.select("*", *page).join(lists, ["host", "__a", "__b"], "left").select("page_id", "url", "host", "html", "gone")


@named("op5_site_templates")
def op5_site_templates(spark, sf_dir):
    return main_text(table(spark, sf_dir, "pages"))
