"""HTML extraction: a host suffix array over the token streams of pages, with markup as evidence.

Every page is parsed into two streams of blocks: its text (inside <article> or <main>; on a page
without such an element, all that isn't a menu, header, footer, sidebar, notice, advert, form,
script, style or comment by tag, role or class) and its frame (all else). The streams of all pages
of a host form one sparse suffix array: suffixes at minimiser positions and at block starts.
Suffixes that stand on at least `PAGES` distinct pages lead to the runs of `MIN_RUN` tokens around
them; every such run that as many pages have is boilerplate. Covered runs are removed, unique runs kept.

Markup weighs in twice. Text inside an article element goes only if it repeats what stands in the
frames of `PAGES` pages, as passages of articles do repeat. Text of a page without such an element
goes if it repeats anywhere on the host, and so does a whole block. Pages of equal text count as
one, so copies are no boilerplate.

Scale: pages are parsed where they are read. Only (host, key) rows are shuffled, counted by
map-side combine, so a host with a third of all pages isn't one task; lists of what repeats are
joined to the pages, broadcast where they are counted to be few.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import broadcast_if_few, cut, stored
from spanloom.llm.words import SPACED, Grams, words_of

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))|([^\s=/>]+)", re.S)
RAW = frozenset("script style title textarea noscript iframe noembed noframes template xmp svg math canvas object".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROP = frozenset("nav footer aside form button select option label fieldset legend input dialog menu datalist head audio video".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q ruby rb rp rt s samp "
                   "small span strike strong sub sup time tt u var wbr br".split())
#: Elements that an inline end tag, or an implied end of a paragraph, doesn't reach over.
STOPS = frozenset("html body div section article main nav aside header footer form table tr td th ul ol li dl dt dd "
                  "blockquote figure details".split())
LISTS = frozenset("ul ol dl table menu div section article".split())
#: Elements that the start of another one ends.
ENDED_BY_NEXT = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"),
                 "tr": ("tr",)}
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar "
                  "tooltip status".split())
#: Words of class and id that mark boilerplate.
MARKS = frozenset("nav navbar navigation menu submenu breadcrumb breadcrumbs sidebar rail masthead topbar footer ad ads adv "
                  "advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies "
                  "consent gdpr notice notices alert newsletter subscribe subscription signup paywall share sharing social "
                  "related recommended recommendations trending popular comment comments commentlist reply replies "
                  "respond disqus discussion popup modal overlay toast widget toolbar pagination pager login "
                  "search form copyright disclaimer skip".split())
COMMENTS = frozenset("comment comments commentlist reply replies respond disqus discussion".split())
#: Words that mark the frame of a page, which is kept whatever else its class says.
FRAMES = frozenset("content main article wrapper container layout page body post entry story has with no without".split())
ZONES = ("article", "main")

MIN_RUN = 32      # tokens of a long substring
GRAM = 8          # tokens of the compared prefix
PAGES = 3         # distinct pages of the host


def attributes(source: str) -> dict[str, str]:
    return {(m[1] or m[5]).lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(source)}


def dropped(tag: str, attrs: dict[str, str], in_zone: bool) -> bool:
    """Whether an element with all it holds is boilerplate by its tag, role, class or id."""
    if tag in DROP or tag == "header" and not in_zone:
        return True
    if not attrs:
        return False
    if ("hidden" in attrs or attrs.get("aria-hidden") == "true" or attrs.get("role", "").lower() in ROLES
            or re.search(r"display\s*:\s*none", attrs.get("style", ""))):
        return True
    if tag in ("html", "body", "main") or tag in INLINE - {"a", "span", "small"}:
        return False
    words = set(re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", f"{attrs.get('class', '')} {attrs.get('id', '')}").lower()))
    if tag == "article":
        return bool(words & COMMENTS) and not words & (FRAMES - {"body", "content"})
    if words & {"header", "head"} and not in_zone and not words & FRAMES:
        return True
    return bool(words & COMMENTS) or bool(words & MARKS) and not words & (FRAMES - {"content", "container", "wrapper", "body"})


class Open:
    """The open elements of a page, and where the last of each tag stands, so that nothing is searched for."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, bool, str]] = []     # tag, dropped, zone
        self.places: dict[str, list[int]] = {}

    def push(self, tag: str, gone: bool, zone: str) -> None:
        self.places.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, gone, zone))

    def close(self, tag: str, stops: frozenset[str]) -> None:
        """Pop the stack up to the last open `tag`, unless one of `stops` stands before it; nothing if it isn't open."""
        if not self.places.get(tag):
            return
        at = self.places[tag][-1]
        if any(self.places[s][-1] > at for s in stops if self.places.get(s)):
            return
        while len(self.stack) > at:
            self.places[self.stack.pop()[0]].pop()


class Page(NamedTuple):
    text: list[str]     # blocks of the article, or of all that isn't frame
    closed: bool        # whether an article or main element holds them
    frame: list[str]    # all other blocks


def parse(source: str | None) -> Page:
    """Blocks of a page in order.

    Text inside <article> goes before text inside <main>, and that before all other text that
    isn't dropped. A block is the text between block-level tags, its references decoded and its
    white space made single spaces.
    """
    source = source or ""
    found: dict[str, list[str]] = {"article": [], "main": [], "": [], "frame": []}
    elements = Open()
    stack = elements.stack
    parts: dict[bool, list[str]] = {False: [], True: []}
    state = (False, "")

    def flush() -> None:
        for gone, pieces in parts.items():
            text = " ".join(html.unescape("".join(pieces)).split()) if pieces else ""
            pieces.clear()
            if text:
                found["frame" if gone else state[1]].append(text)

    at = 0
    while at < len(source):
        m = TOKEN.search(source, at)
        parts[state[0]].append(source[at:m.start() if m else len(source)])
        if not m:
            break
        at = m.end()
        closing, tag, rest, end = (m[1], m[2], m[3], m[4]) if m[2] else (m[5], m[6], m[7], m[8])
        if not tag:
            continue
        tag = tag.lower()
        if tag == "br":
            parts[state[0]].append(" ")
        elif tag not in INLINE:
            flush()
        if closing:
            elements.close(tag, STOPS if tag in INLINE else frozenset())
        elif tag in RAW:
            if not rest.rstrip().endswith("/"):
                over = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(source, at)
                at = over.start() if over else len(source)
        elif tag not in VOID and end:
            if tag not in INLINE:
                elements.close("p", STOPS)
            if tag in ENDED_BY_NEXT:
                for other in ENDED_BY_NEXT[tag]:
                    elements.close(other, LISTS)
            gone, zone = (stack[-1][1], stack[-1][2]) if stack else (False, "")
            attrs = attributes(rest) if rest.strip() else {}
            gone = gone or dropped(tag, attrs, bool(zone))
            role = attrs.get("role")
            if tag == "article" or not zone and (tag == "main" or role in ZONES):
                zone = "article" if "article" in (tag, role) else "main"
            elements.push(tag, gone, zone)
        state = (stack[-1][1], stack[-1][2]) if stack else (False, "")
    flush()
    kind = next((z for z in ZONES if found[z]), "")
    return Page(found[kind], bool(kind), [t for k, blocks in found.items() if k != kind for t in blocks])


class Stream(NamedTuple):
    """The token stream of some blocks as a sparse suffix array: suffixes at block starts and at minimiser positions."""

    first: np.ndarray       # first token of each block, and the number of tokens
    grams: Grams
    blocks: np.ndarray      # key of each whole block
    at: np.ndarray          # positions of the least GRAM-token hash of every run of MIN_RUN tokens
    keys: np.ndarray


def stream(blocks: list[str]) -> Stream:
    first = np.zeros(len(blocks) + 1, np.int64)
    np.cumsum([b.count(" ") + 1 for b in blocks], out=first[1:])
    grams = Grams(words_of("\n".join(blocks), SPACED)[0])
    whole = grams.at(first[:-1], np.diff(first)) ^ np.uint64(1)
    if first[-1] < MIN_RUN:
        return Stream(first, grams, whole, first[:0], whole[:0])
    hashes = grams.every(GRAM)
    windows = np.lib.stride_tricks.sliding_window_view(hashes, MIN_RUN - GRAM + 1)
    at = np.unique(windows.argmin(axis=1) + np.arange(len(windows)))
    return Stream(first, grams, whole, at, hashes[at])


def runs_near(found: Stream, repeated: set[int]) -> tuple[np.ndarray, np.ndarray]:
    """(start, key) of every run of MIN_RUN tokens around a repeated suffix."""
    n = found.first[-1]
    near = np.zeros(n + 1, np.int64)
    for p, k in zip(found.at.tolist(), found.keys.view(np.int64).tolist()):
        if k in repeated:
            near[max(0, p - MIN_RUN + GRAM)] += 1
            near[min(n, p + 1)] -= 1
    hashes = found.grams.every(MIN_RUN)
    at = np.flatnonzero(np.cumsum(near)[:len(hashes)] > 0)
    return at, hashes[at] ^ np.uint64(2)


def unique_runs(page: Page, repeated: set[int]) -> list[str]:
    """The text blocks without what repeats on other pages of the host: runs of MIN_RUN tokens, and whole blocks of a page without article."""
    found = stream(page.text)
    covered = np.zeros(found.first[-1] + 1, bool)
    if not page.closed:
        for a, b, k in zip(found.first[:-1], found.first[1:], found.blocks.view(np.int64).tolist()):
            if k in repeated:
                covered[a:b] = True
    at, runs = runs_near(found, repeated)
    for p, k in zip(at.tolist(), runs.view(np.int64).tolist()):
        if k in repeated:
            covered[p:p + MIN_RUN] = True
    out = []
    for block, a, b in zip(page.text, found.first[:-1], found.first[1:]):
        kept = [w for w, c in zip(block.split(" "), covered[a:b].tolist()) if not c] if covered[a:b].any() else [block]
        if kept:
            out.append(" ".join(kept))
    return out


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


KEYED = "host string, page long, body long, framed boolean, closed boolean, whole boolean, key long"
COLUMNS = [c.split()[0] for c in KEYED.split(", ")]


def repeated_keys(keyed: DataFrame) -> DataFrame:
    """The rows of `keyed` whose key is boilerplate: on at least PAGES pages of the host, in the frames of as many for text of an article.

    Whole blocks of frames count for others, but lead nowhere themselves.
    """
    counted = keyed.where("framed or not closed").groupBy("host", "key").agg(
        F.countDistinct("body").alias("pages"), F.countDistinct(F.when(F.col("framed"), F.col("body"))).alias("frames")).where(F.col("pages") >= PAGES)
    hit = F.col("framed") | ~F.col("closed") | (F.col("frames") >= PAGES)
    sought = keyed.where("not (framed and whole)")
    return sought.join(broadcast_if_few(cut(counted)), ["host", "key"]).where(hit).select("host", "page", "framed", "key")


def listed(hits: DataFrame) -> DataFrame:
    """(host, page, keys, frame_keys): the repeated keys of each page's text and frame."""
    return hits.groupBy("host", "page").agg(F.collect_set(F.when(~F.col("framed"), F.col("key"))).alias("keys"),
                                            F.collect_set(F.when(F.col("framed"), F.col("key"))).alias("frame_keys"))


def rows_of(host: str, number: int, page: Page, framed: bool, whole: bool, keys: np.ndarray) -> list[tuple]:
    if not len(keys):
        return []
    body = xxhash.xxh64_intdigest("\n".join(page.text)) - (1 << 63)
    return [(host, number, body, framed, page.closed, whole, k) for k in set(keys.view(np.int64).tolist())]


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of `pages` (page_id, url, html).

    Null and empty pages have the empty text. Pages without url are one host. Repeated rows get
    the same text, and count as one page. A very long page is one row of its task. Other columns aren't read;
    an empty table gives no rows.
    """
    def suffixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for h, p, s in zip(batch["host"], batch["page"], batch["html"]):
                page = parse(s)
                text, frame = stream(page.text), stream(page.frame)
                out += rows_of(h, p, page, False, False, text.keys) + rows_of(h, p, page, True, False, frame.keys) + rows_of(h, p, page, True, True, frame.blocks)
                if not page.closed:     # inside an article only long runs can go
                    out += rows_of(h, p, page, False, True, text.blocks)
            yield pd.DataFrame(out, columns=COLUMNS)

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for h, p, s, keys, frame_keys in zip(batch["host"], batch["page"], batch["html"], batch["keys"], batch["frame_keys"]):
                page = parse(s)
                out += rows_of(h, p, page, False, False, runs_near(stream(page.text), set(keys))[1])
                out += rows_of(h, p, page, True, False, runs_near(stream(page.frame), set(frame_keys))[1])
            yield pd.DataFrame(out, columns=COLUMNS)

    @F.pandas_udf("string")
    def unique(sources: pd.Series, repeated: pd.Series) -> pd.Series:
        return pd.Series(["\n".join(unique_runs(page, set(r)) if r is not None and len(r) else page.text)
                          for page, r in ((parse(s), r) for s, r in zip(sources, repeated))], dtype=object)

    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumns(
        {"host": host_of(F.col("url")), "page": F.xxhash64("url", "html")})
    sources = rows.select("host", "page", "html")
    hits = cut(repeated_keys(stored(sources.mapInPandas(suffixes, KEYED))))
    around = sources.join(broadcast_if_few(cut(listed(hits))), ["host", "page"])
    # a run counts by itself; of the suffixes only whole blocks are removed
    hits = hits.union(repeated_keys(stored(around.mapInPandas(runs, KEYED))))
    gone = broadcast_if_few(cut(listed(hits).where("size(keys) > 0").select("host", "page", "keys")))
    text = rows.join(gone, ["host", "page"], "left").select("page_id", "url", unique("html", "keys").alias("text"))
    return text.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
