"""Main text of web pages, with nearest-URL page differencing.

A page is cut into lines: the text of its block elements, character references decoded, white space inside a line turned
into one space. Pages are put in the order of host and URL path; a page's nearest page is the one before or after it,
within its host, that shares more path folders with it (the one before if both share as many). The lines of both are
aligned by their longest common subsequence, and what both share is deleted, unless it is article text by its markup:
a paragraph, heading or list item inside an article or main element. Pages repeat articles of one another, in whole or in
part, and deleting what those share would lose article text.

What pages don't share is not all article text: lines in menus, headers, footers, sidebars, notices, adverts, forms and
comments, told by their elements and attributes, go as well, and where a page has an article or main element, so do lines
outside.

Defined cases: null and empty pages have no lines and an empty text, and are no page's nearest; a page without URL has no
host and is compared with no other; rows that repeat page_id, url and html get the same text; pages of one URL are each
other's neighbours; a page alone in its host keeps all lines that its markup leaves; markup that is cut short ends at its
last whole character; a page of any length is taken whole.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Spans, in_order, signed, table, utf8, with_neighbours

# HTML element names and usual attribute words.
RAW = "script style textarea title noscript template iframe select option svg math object".split()
BLOCKS = set("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = set("nav footer aside form dialog menu head button label".split())
WORDS = set("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice popup modal overlay newsletter subscribe subscription signup login sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar comment comments disqus share sharing social related recommended recommendations widget pagination pager toolbar skip".split())
HEADERS = set("header masthead".split())
ROLES = set("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
KEPT_IN = set("p h1 h2 h3 h4 h5 h6 li blockquote pre td th dd dt figcaption".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(" + "|".join(RAW) + r")\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*(?:>|\Z)|<[a-zA-Z/][^<>]*\Z", re.S | re.I)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_SPLIT = re.compile(r"[^a-z0-9]+")
GONE, OPEN, KEPT = 0, 1, 2


def is_dropped(tag: str, attributes: str, inside: bool) -> bool:
    """Whether an element holds no article text. inside: it lies in an article, whose own header holds its heading."""
    if tag in DROPPED or (tag == "header" and not inside):
        return True
    if not attributes.strip():
        return False
    found = {m[1].lower(): (m[2] or m[3] or m[4] or "").lower() for m in _ATTRIBUTE.finditer(attributes)}
    bare = set(_SPLIT.split(_ATTRIBUTE.sub(" ", attributes).lower()))
    if "hidden" in bare or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", ""):
        return True
    if tag in ("html", "body", "article", "main"):
        return False
    named = set(_SPLIT.split(f"{found.get('class', '')} {found.get('id', '')}"))
    return found.get("role") in ROLES or bool(named & WORDS) or (not inside and bool(named & HEADERS))


def lines(page: str) -> list[tuple[int, str]]:
    """(kind, text) of each line of the page that isn't empty, in order."""
    out: list[tuple[int, str]] = []
    buffer: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # tag, whether it starts a dropped part, whether it starts an article
    dropped = inside = at = kept = 0
    any_article = False

    def end_line():
        nonlocal buffer
        if buffer:
            text = " ".join(entities.unescape("".join(buffer)).split())
            if text:
                out.append((GONE if dropped else KEPT if inside and kept else OPEN if inside else -OPEN, text))
            buffer = []

    def pop():
        nonlocal dropped, inside, kept
        tag, was_dropped, was_article = stack.pop()
        dropped -= was_dropped
        inside -= was_article
        kept -= tag in KEPT_IN

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            buffer.append(page[at : m.start()])
        at = m.end()
        tag = m[3]
        if not tag:
            continue
        tag = tag.lower()
        if tag == "br":
            buffer.append(" ")
            continue
        if tag in BLOCKS:
            end_line()
        if m[2]:
            if any(t == tag for t, _, _ in stack):
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        if tag in VOID or m[4].endswith("/") and tag not in BLOCKS:
            continue
        if tag in BLOCKS:  # a new block ends an open paragraph, and a new item the item before
            while stack and (stack[-1][0] == "p" or stack[-1][0] == tag and tag in ("li", "dt", "dd", "td", "th", "tr", "option") or stack[-1][0] not in BLOCKS and any(t == "p" for t, _, _ in stack[-4:])):
                pop()
        drop = is_dropped(tag, m[4], inside > 0)
        article = tag in ("article", "main") or "articlebody" in m[4].lower() or bool(re.search(r"role\s*=\s*[\"']?main\b", m[4], re.I))
        any_article |= article and not dropped
        stack.append((tag, drop, article))
        dropped += drop
        inside += article
        kept += tag in KEPT_IN
    if at < len(page):
        buffer.append(page[at:])
    end_line()
    found_inside = any(k in (OPEN, KEPT) for k, _ in out)
    return [(GONE if k == -OPEN and found_inside else abs(k), t) for k, t in out]


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """Positions in a of a longest common subsequence with b (Hunt and Szymanski's method, after the common ends)."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    where: dict[int, list[int]] = {}
    for j in range(len(b) - tail - 1, head - 1, -1):
        where.setdefault(b[j], []).append(j)
    ends: list[int] = []  # the smallest end in b of a common subsequence of each length
    links: list[tuple] = []
    for i in range(head, len(a) - tail):
        for j in where.get(a[i], ()):
            k = bisect_left(ends, j)
            link = (i, links[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                links.append(link)
            else:
                ends[k] = j
                links[k] = link
    middle, link = [], links[-1] if links else None
    while link:
        middle.append(link[0])
        link = link[1]
    return [*range(head), *reversed(middle), *range(len(a) - tail, len(a))]


def place(url: str | None) -> tuple[str, str, list[str]]:
    """Host, path with query, and the path's folders from the host down."""
    try:
        parts = urlsplit((url or "").strip())
        host = (parts.hostname or "").lower()
    except ValueError:
        return "", "", []
    if not host:
        return "", "", []
    steps = [x for x in parts.path.split("/") if x]
    folders = ["/"] + ["/" + "/".join(steps[:i]) + "/" for i in range(1, len(steps))]
    return host, "/" + "/".join(steps) + ("?" + parts.query if parts.query else ""), folders


def page_key():
    return [F.xxhash64(F.lit(1), "page_id", "url", "html").alias("k1"), F.xxhash64(F.lit(2), "html", "url", "page_id").alias("k2")]


def line_hashes(pages: DataFrame) -> DataFrame:
    """k1, k2, host, path, folders and lines (their hashes) of each page with a host."""

    def run(batches):
        for batch in batches:
            hosts, paths, folders, hashes = [], [], [], []
            for url, page in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist()):
                host, path, own = place(url)
                hosts.append(host)
                paths.append(path)
                folders.append(own)
                texts = [t for _, t in lines(page or "")] if host else []
                data, starts = utf8(pa.array(texts, pa.string()))
                hashes.append(signed(Spans(data).hash(starts[:-1], starts[1:])))
            flat = pa.array(np.concatenate(hashes) if hashes else np.zeros(0, np.int64), pa.int64())
            ends = np.concatenate([[0], np.cumsum([len(h) for h in hashes])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(folders, pa.list_(pa.string())), pa.ListArray.from_arrays(pa.array(ends), flat)], ["k1", "k2", "host", "path", "folders", "lines"])

    return pages.select(*page_key(), "url", "html").mapInArrow(run, "k1 long, k2 long, host string, path string, folders array<string>, lines array<long>").where("host <> ''")


def shared_lines(pages: DataFrame) -> DataFrame:
    """k1, k2 and shared: the numbers of the lines that a page shares with its nearest page."""
    known = in_order(line_hashes(pages).where(F.size("lines") > 0).dropDuplicates(["k1", "k2"]), "host", "path", "k1", "k2")
    near = with_neighbours(known, F.struct("host", "folders", "lines"), "host", "path", "k1", "k2")

    def align(batches):
        for batch in batches:
            found = []
            for host, folders, lines_, before, after in zip(*(batch.column(c).to_pylist() for c in ("host", "folders", "lines", "previous", "next"))):
                best = max((sum(a == b for a, b in zip(folders, x["folders"])), -i) for i, x in enumerate((before, after)) if x and x["host"] == host) if any(x and x["host"] == host for x in (before, after)) else None
                found.append(common_lines(lines_, (before, after)[-best[1]]["lines"]) if best else [])
            yield pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), pa.array(found, pa.list_(pa.int32()))], ["k1", "k2", "shared"])

    return near.select("k1", "k2", "host", "folders", "lines", "previous", "next").mapInArrow(align, "k1 long, k2 long, shared array<int>")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_shared (lines that went because the nearest page shares them) and n_marked (other lines that went by their markup) of each row of pages (page_id, url, html)."""
    pages = pages.select("page_id", "url", "html")

    def pack(batches):
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            own = [[(k, t) for k, t in lines(page or "")] for page in batch.column("html").to_pylist()]
            kinds = [bytes(k for k, _ in x) for x in own]
            texts = [squeeze("\n".join(t if k else "" for k, t in x).encode("utf-8", "replace")) for x in own]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("page_id", "url", "k1", "k2")] + [pa.array(kinds, pa.binary()), pa.array(texts, pa.binary())], ["page_id", "url", "k1", "k2", "kinds", "packed"])

    def unpack(batches):
        grow = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            texts, counts, marked = [], [], []
            for kinds, packed, shared in zip(batch.column("kinds").to_pylist(), batch.column("packed").to_pylist(), batch.column("shared").to_pylist()):
                gone = set(shared or ())
                own = grow(packed).decode().split("\n") if kinds else []
                texts.append("\n".join(t for i, (k, t) in enumerate(zip(kinds, own)) if k == KEPT or k == OPEN and i not in gone))
                counts.append(sum(kinds[i] != KEPT for i in gone))
                marked.append(sum(k == GONE and i not in gone for i, k in enumerate(kinds)))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(marked, pa.int64())], ["page_id", "url", "text", "n_shared", "n_marked"])

    types = dict(pages.dtypes)
    # lines travel compressed: this is the one shuffle of the pages' texts
    packed = pages.select("page_id", "url", "html", *page_key()).mapInArrow(pack, f"page_id {types['page_id']}, url string, k1 long, k2 long, kinds binary, packed binary")
    return packed.join(shared_lines(pages), ["k1", "k2"], "left").mapInArrow(unpack, f"page_id {types['page_id']}, url string, text string, n_shared long, n_marked long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_shared", "n_marked")
