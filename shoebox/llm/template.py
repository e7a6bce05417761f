"""Main text of web pages: site templates are found by counting, and removed.

Every page is read into elements. The subtrees of elements that could be template are hashed and counted per
host, once a page; a subtree that recurs on ``least_pages`` pages of its host, whatever the host's size, is template.

Where template is found on a page (outside of its article, if it has one), the whole page is kept but for this template, for
what is no text (scripts, styles, forms, hidden parts), for reader comments and adverts, which differ from page to page, and
for blocks of mostly links outside of the article. What the page itself marks as menu, header, footer, sidebar or notice
and what recurs too rarely to be counted is left out as well, unless ``marks`` is false. On other pages, of small sites or
of a rare layout, these marks alone decide, and the article, if there is one, is the main text. Inside an article (or
main part) running text is never template, however often a site repeats it, so there only subtrees of mostly links can be.

Templates are joined to the subtrees of the pages, and a page is handed only those that it has itself; nothing of them goes
through the driver. Equal pages of a host are joined as one. Pages are read in batches of bounded size.

Defined results: null pages are empty; null urls and urls without ``://`` form one site. Repeated rows give a row
each and count as pages of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoebox.llm.html import INLINE, Element, parse, subtree_hashes
from shoebox.llm.urlrules import host_of
from shoebox.llm.words import pieces as pieces_of
from shoebox.session import cut


@dataclass(frozen=True)
class Template:
    """Pages of a host that make a subtree template, and whether a page's own marks count beside its templates."""

    least_pages: int = 5
    marks: bool = True

# What a page calls its parts.
LEFT_OUT = set("head nav header footer aside form script style noscript template iframe svg button select menu dialog object canvas audio video".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar note".split())
NAMES = set(
    "nav navbar navigation menu submenu sidebar aside ad ads advert adverts advertisement adsense banner sponsor sponsored promo cookie cookies consent gdpr notice popup modal overlay newsletter subscribe signup comment comments disqus breadcrumb breadcrumbs share sharing social related recommended widget toolbar pagination pager masthead skip login footer header".split()
)
STEMS = ("comment", "advert", "sidebar", "cookie", "breadcrumb", "newsletter", "sponsor")
COMMENTS = {"comment", "comments"}
VARYING = set("ad ads advert adverts advertisement adsense sponsor sponsored promo comment comments disqus".split())
VARYING_STEMS = ("comment", "advert", "sponsor")
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
HELD = {"article", "main"}
OPEN = {"", "html", "body"} | HELD
NO_TEXT = set("head form script style noscript template iframe svg button select dialog object canvas audio video".split())
RUNNING = set("p h1 h2 h3 h4 h5 h6 li td th dd dt pre blockquote figcaption caption".split())


@dataclass
class Page:
    elements: list[Element]
    roots: list[int]  # of the main text
    out: list[bool]  # left out by what the page says
    inside: list[bool]  # in an article
    bare: list[bool]  # left out however often it recurs
    article: bool  # there is one


def read(page: str) -> Page:
    elements = parse(page)
    holds = [False] * len(elements)
    for i in range(len(elements) - 1, 0, -1):
        e = elements[i]
        if e.tag in HELD or e.role in HELD or holds[i]:
            holds[e.parent] = True
    out, inside, bare = ([False] * len(elements) for _ in range(3))
    for i, e in enumerate(elements[1:], 1):
        inside[i] = inside[e.parent] or e.tag in HELD or e.role in HELD
        own = e.tag in LEFT_OUT or e.hidden or e.role in ROLES
        # The head of an article names it; it is no site header.
        names_it = inside[e.parent] and (e.tag in HEADINGS or any(isinstance(p, int) and elements[p].tag in HEADINGS for p in e.parts))
        own = own and not (e.tag == "header" and names_it)
        if not own and e.names and (e.tag not in OPEN or e.names & COMMENTS):
            said = e.names & NAMES or any(n.startswith(STEMS) for n in e.names)
            own = bool(said) and not (e.names & NAMES == {"header"} and names_it)
        varies = bool(e.names & VARYING) or any(n.startswith(VARYING_STEMS) for n in e.names)
        bare[i] = bare[e.parent] or e.tag in NO_TEXT or e.hidden or e.role == "form" or varies and (e.tag not in OPEN or bool(e.names & COMMENTS))
        out[i] = out[e.parent] or own and not (holds[i] and e.tag not in LEFT_OUT)
    for kind in ("article", "main"):
        found = [i for i, e in enumerate(elements) if (e.tag == kind or e.role == kind) and not out[i]]
        if found:
            break
    roots, last = [], -1
    for i in found:  # an article within another is part of it
        up = elements[i].parent
        while up > 0 and up not in roots:
            up = elements[up].parent
        if up <= 0:
            roots.append(i)
    return Page(elements, roots or [0], out, inside, bare, holds[0])


def _lengths(page: Page) -> tuple[list[int], list[int]]:
    """Characters of text of each subtree, and those within links."""
    text, links = [0] * len(page.elements), [0] * len(page.elements)
    for i in range(len(page.elements) - 1, -1, -1):
        e = page.elements[i]
        text[i] += sum(len(p.strip()) for p in e.parts if isinstance(p, str))
        if e.tag == "a":
            links[i] = text[i]
        if i:
            text[e.parent] += text[i]
            links[e.parent] += links[i]
    return text, links


def candidates(page: Page) -> dict[int, int]:
    """Elements whose subtrees may be template, with their hashes."""
    hashes = subtree_hashes(page.elements)
    text, links = _lengths(page)
    found = {}
    for i, e in enumerate(page.elements):
        if page.out[i] and page.out[max(e.parent, 0)] or e.tag in OPEN or e.tag in INLINE or not text[i]:
            continue
        if page.inside[i] and (e.tag in RUNNING or 2 * links[i] < text[i]):
            continue
        found[i] = hashes[i]
    return found


def _dropped(page: Page, template: set[int], whole: bool, marks: bool) -> set[int]:
    """Elements that are left out: ``template``, and what goes with it or what the page marks."""
    marked = {i for i, out in enumerate(page.out) if out and i not in page.roots}
    if not whole:
        return template | marked
    found = template | {i for i, bare in enumerate(page.bare) if bare} | (marked if marks else set())
    if page.article:
        text, links = _lengths(page)
        found |= {i for i, e in enumerate(page.elements) if e.tag not in OPEN | INLINE and not page.inside[i] and links[i] and 2 * links[i] >= text[i]}
    return found


def main_text(page: Page, recurring: frozenset[int] = frozenset(), marks: bool = True) -> tuple[str, int]:
    """Blocks of the main text, parted by one space, and the number of subtrees that counting removed."""
    template = {i for i, h in candidates(page).items() if h in recurring} if recurring else set()
    whole = any(not page.inside[i] for i in template)
    dropped = _dropped(page, template, whole, marks)
    pieces: list[str] = []
    # An explicit stack, as pages may be nested deeper than Python calls may be.
    todo: list = [0] if whole else list(reversed(page.roots))
    while todo:
        item = todo.pop()
        if isinstance(item, str):
            pieces.append(item)
            continue
        e = page.elements[item]
        if item in dropped or e.tag in ("title", "textarea"):
            pieces.append(" ")
            continue
        edge = "" if e.tag in INLINE else " "
        pieces.append(edge)
        todo.append(edge)
        todo.extend(reversed(e.parts))
    return " ".join("".join(pieces).split()), len(template)


def _hash_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces_of(batch, "html"):
            hosts, keys, hashes = [], [], []
            for host, key, page in zip(*(part.column(c).to_pylist() for c in ("host", "key", "html"))):
                own = set(candidates(read(page)).values())
                hosts += [host] * len(own)
                keys += [key] * len(own)
                hashes += own
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(keys, pa.int64()), pa.array(hashes, pa.int64())], names=["host", "key", "subtree"])


def site_templates(subtrees: DataFrame, spec: Template) -> DataFrame:
    """``host, subtree`` for every subtree that recurs on many pages of the host; ``subtrees`` has a row for each one of each page."""
    counts = subtrees.groupBy("host", "subtree").agg(F.count(F.lit(1)).alias("n"))
    return counts.filter(F.col("n") >= spec.least_pages).select("host", "subtree")


def _extract(marks: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces_of(batch, "html"):
                pages = zip(part.column("html").to_pylist(), part.column("subtrees").to_pylist())
                found = [main_text(read(page), frozenset(recurring or ()), marks) if page else ("", 0) for page, recurring in pages]
                texts, counts = [t for t, _ in found], [n for _, n in found]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("url"), pa.array(texts, pa.string()), pa.array(counts, pa.int64())], names=["id", "url", "text", "n_templates"])

    return run


def extract(pages: DataFrame, spec: Template = Template(), id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id, url, text, n_chars`` of every row, and ``n_templates``, the subtrees that counting removed."""
    rows = pages.select(
        F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), host_of(F.col(url_col)).alias("host"),
        F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"),
    )
    # Pages of a host with one key only share their own templates of that host, so a chance match of two hashes does no harm.
    rows = rows.withColumn("key", F.xxhash64("html"))
    subtrees = cut(rows.select("host", "key", "html").mapInArrow(_hash_rows, "host string, key long, subtree long"), "subtrees")
    met = subtrees.join(site_templates(subtrees, spec), ["host", "subtree"], "left_semi")
    met = met.groupBy("host", "key").agg(F.collect_set("subtree").alias("subtrees"))
    schema = T.StructType([rows.schema["id"], rows.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_templates", T.LongType())])
    whole = rows.join(met, ["host", "key"], "left").select("id", "url", "html", "subtrees").mapInArrow(_extract(spec.marks), schema)
    return whole.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.char_length("text").cast("long").alias("n_chars"), "n_templates")
