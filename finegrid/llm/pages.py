"""Main text of web pages: suffix arrays over a host's pages find what it repeats; markup checks the result."""

from __future__ import annotations

import html as entities
import re
import zlib
from collections import Counter
from collections.abc import Iterable
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finegrid.llm.common import saved, type_of, utf8

#: Least tokens of a substring that counts as boilerplate, and the least number and share of a host's different pages that hold it.
REPEAT, LEAST_PAGES, SHARE = 8, 3, 0.3
#: Characters of a host's pages to a suffix array; a larger host has several.
PIECE = 1 << 21

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp svg math".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
SKIP = frozenset("head nav header footer aside form button select menu dialog fieldset object audio video canvas".split()) | RAW
CONTAINER = frozenset(("article", "main"))
SKIP_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
#: Words of a class or id that mark what is not the article.
SKIP_WORDS = frozenset((
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus "
    "footer gdpr header masthead menu modal nav navbar navigation newsletter notice notification overlay pager pagination popup promo promotion "
    "recommendations recommended related respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget"
).split())
#: Words that may stand beside those in a hyphenated one (``share-buttons``); any other word (``share-price``) makes it something else.
FRAME_WORDS = frozenset("area bar bottom box button buttons container content global inner items left link links list main outer page posts primary right row secondary section site slot top unit wrap wrapper".split())
#: A start tag of these ends an open one of the group, as their end tags may be left out.
ENDS_SELF = {"li": "li", "dt": "d", "dd": "d", "tr": "tr", "td": "t", "th": "t", "option": "option"}

#: A quote opens directly after an equals sign only; elsewhere it is a character like any other.
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*"[^"]*"|=\s*'[^']*'|=(?!\s*["']))*+)>""")
#: For a tag with a quote that never closes.
PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|hidden|aria-hidden)(?![^\s=/>])(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.IGNORECASE)
WORDS = re.compile(r"[a-z0-9]+")


def _marked(value: str) -> bool:
    """Whether a class or id names what is not the article: by a whole token, or one made of such words and frames only."""
    for token in value.split():
        words = WORDS.findall(token)
        if words and all(w in SKIP_WORDS or w in FRAME_WORDS for w in words) and not SKIP_WORDS.isdisjoint(words):
            return True
    return False


def _apart(tag: str, attributes: str) -> tuple[bool, bool]:
    """Whether an element isn't part of the article, and whether it is a container of it.

    Classes and ids decide for blocks only, and never for a container or the whole page.
    """
    skip, container, marked = tag in SKIP, tag in CONTAINER, False
    if "=" in attributes or "hidden" in attributes.lower():
        for name, value in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'").lower()
            if name in ("class", "id"):
                marked = marked or _marked(value)
            elif name == "role":
                skip, container = skip or value in SKIP_ROLES, container or value in ("main", "article")
            elif name == "hidden" or value == "true":
                skip = True
    return skip or marked and not container and tag not in INLINE and tag not in ("body", "html"), container


def read_page(page: str) -> tuple[str | None, list[str], list[int], list[str]]:
    """A page's text by markup: ``(text, tokens, sizes, away)``.

    ``text`` is that of the article elements (None without any), ``tokens`` those of all text that markup doesn't rule
    out, ``sizes`` the number of tokens of each outermost article element, and ``away`` the stretches of text that
    markup rules out or, on a page with an article, leaves outside of it.

    One pass, linear in the page: end tags close what is open above their start, unknown ones are ignored, quotes
    that never close and tags cut off by the end are put up with.  Character references are decoded piece by piece.
    """
    articles: list[list[str]] = []
    anywhere: list[str] = []
    ruled_out: list[list[str]] = []
    outside: list[list[str]] = []
    last = -1
    stack: list[tuple[str, bool, bool]] = []
    open_tags: Counter = Counter()
    skips = containers = 0
    seen = False
    at, end = 0, len(page)

    def close(tag: str) -> None:
        nonlocal skips, containers
        if open_tags[tag]:
            while stack:
                top, skip, container = stack.pop()
                open_tags[top] -= 1
                skips -= skip
                containers -= container
                if top == tag:
                    break

    def put(text: str) -> None:
        nonlocal last
        if not text:
            return
        if "&" in text:
            text = entities.unescape(text)
        if skips:
            if last != 0:
                ruled_out.append([])
            last = 0
            ruled_out[-1].append(text)
            return
        anywhere.append(text)
        if containers:
            articles[-1].append(text)
            last = 1
        else:
            if last != 2:
                outside.append([])
            last = 2
            outside[-1].append(text)

    while at < end:
        left = page.find("<", at)
        if left < 0:
            put(page[at:])
            break
        put(page[at:left])
        if page.startswith("<!--", left):
            stop = page.find("-->", left + 4)
            at = end if stop < 0 else stop + 3
            continue
        if page[left + 1:left + 2] in ("!", "?"):
            stop = page.find(">", left)
            at = end if stop < 0 else stop + 1
            continue
        found = TAG.match(page, left)
        if not found:
            if not re.match(r"</?[a-zA-Z]", page[left:left + 3]):
                put("<")
                at = left + 1
                continue
            found = PLAIN_TAG.match(page, left)
            if not found:
                break
        at = found.end()
        closing, tag, attributes = found[1], found[2].lower(), found[3]
        if tag not in INLINE:
            put(" ")
        if closing:
            if tag in ENDS_SELF:
                tag = ENDS_SELF[tag]
            close(tag)
            continue
        if tag in VOID or attributes.endswith("/") and tag in ("svg", "math"):
            continue
        if tag in RAW:
            stop = re.compile(rf"</{tag}\b[^>]*>", re.IGNORECASE).search(page, at)
            at = stop.end() if stop else end
            continue
        if tag not in INLINE:
            if open_tags["p"] and _closes_p(stack):
                close("p")
            if tag in ENDS_SELF:
                tag = ENDS_SELF[tag]
                if stack and any(t == tag for t, _, _ in stack[-3:]):
                    close(tag)
        skip, container = _apart(tag, attributes)
        if container and not skips and not skip:
            seen = True
        if container and not containers:
            articles.append([])
        stack.append((tag, skip, container))
        open_tags[tag] += 1
        skips += skip
        containers += container
    away = [" ".join("".join(a).split()) for a in (ruled_out + outside if seen else ruled_out)]
    away = [a for a in away if a]
    if not seen:
        return None, "".join(anywhere).split(), [], away
    words = "".join("".join(a) for a in articles).split()
    sizes = [n for n in (len("".join(a).split()) for a in articles) if n]
    # inline elements may be articles by their role and share a word: then there is one
    return " ".join(words), "".join(anywhere).split(), sizes if sum(sizes) == len(words) else [len(words)], away


def _closes_p(stack: list[tuple[str, bool, bool]]) -> bool:
    """Whether an open paragraph lies above the last element that isn't inline."""
    for tag, _, _ in reversed(stack):
        if tag == "p":
            return True
        if tag not in INLINE:
            return False
    return False


def read_pages(df: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """``(id, url, text, sizes, away)``: every page parsed once, see `read_page`; ``sizes`` is null for a page without an article.

    ``text`` is the article's, or else all that markup doesn't rule out; ``away`` has a line per stretch.
    """

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                got = [read_page(t.decode("utf-8")) for t in utf8(part.column(2))]
                columns = [part.column(0), part.column(1), pa.array([" ".join(tokens) if text is None else text for text, tokens, _, _ in got], pa.string()),
                           pa.array([None if text is None else sizes for text, _, sizes, _ in got], pa.list_(pa.int32())), pa.array(["\n".join(away) for _, _, _, away in got], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "url", "text", "sizes", "away"])

    rows = df.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, f"id {type_of(df, id_col)}, url string, text string, sizes array<int>, away string")


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Starts of all suffixes of ``s`` in order, by prefix doubling over the suffixes that are still tied; the last value occurs once."""
    n = len(s)
    order = np.argsort(s, kind="stable")
    value = s[order]
    rank, at, reach = np.empty(n, np.int64), np.arange(n), 1
    new = np.concatenate(([True], value[1:] != value[:-1]))
    tied = order
    while True:
        rank[tied] = np.maximum.accumulate(np.where(new, at, 0))
        alone = new & np.concatenate((new[1:], [True]))
        at = at[~alone]
        if not len(at):
            return order
        tied = order[at]
        key = rank[tied] * n + rank[tied + reach]
        by = np.argsort(key, kind="stable")
        tied, key = tied[by], key[by]
        order[at] = tied
        new = np.concatenate(([True], key[1:] != key[:-1]))
        reach *= 2


def repeated_windows(codes: list[bytes], page: list[int], repeat: int, least: float) -> np.ndarray:
    """Digests (`windows`) of the prefixes of ``repeat`` codes that suffixes of at least ``least`` different pages share.

    ``codes`` are sequences that end in 0, ``page`` the page of each.  The sequences' suffixes are ordered; neighbours
    that share ``repeat`` codes or more make a class, and its suffixes' prefixes cover every longer shared substring.
    """
    text = np.frombuffer(b"".join(codes), np.uint8)
    ends = text == 0
    s = text.astype(np.int64)
    s[ends] = 256 + np.arange(int(ends.sum()))  # ends differ, so nothing is shared across them
    order, last = suffix_array(s), len(s) - 1
    shares = np.ones(len(order) - 1, bool)
    for k in range(repeat):
        shares &= s[np.minimum(order[:-1] + k, last)] == s[np.minimum(order[1:] + k, last)]
    of = np.concatenate(([0], np.cumsum(~shares)))
    long = np.repeat([len(c) for c in codes], [len(c) for c in codes]) - (np.arange(len(s)) - np.repeat(np.cumsum([0] + [len(c) for c in codes[:-1]]), [len(c) for c in codes])) > repeat
    held_by = np.repeat(np.array(page, np.int64), [len(c) for c in codes])[order]
    full = long[order]
    pages = int(max(page)) + 1
    held = np.bincount(np.unique(of[full] * pages + held_by[full]) // pages, minlength=int(of[-1]) + 1)
    first = np.concatenate(([True], ~shares)) & full
    starts = order[first & (held[of] >= least)]
    return windows(text, repeat)[starts] if len(starts) else np.empty(0, np.int64)


def windows(codes: np.ndarray, repeat: int) -> np.ndarray:
    """A number for every run of ``repeat`` codes."""
    n = max(0, len(codes) - repeat + 1)
    out = np.zeros(n, np.uint64)
    for k in range(repeat):
        out = out * np.uint64(0x9E3779B97F4A7C15) + codes[k:k + n].astype(np.uint64)
    return out.view(np.int64)


def coded(tokens: Iterable[str], known: dict[str, int]) -> bytes:
    """A byte from 1 to 255 for every word, equal for equal words; ``known`` remembers 200,000 words."""
    out = bytearray()
    for t in tokens:
        c = known.get(t)
        if c is None:
            c = zlib.crc32(t.encode("utf-8", "surrogatepass")) % 255 + 1
            if len(known) < 200_000:
                known[t] = c
        out.append(c)
    return bytes(out)


def heads_of(tokens: list[str], codes: np.ndarray, known: dict[str, int], repeat: int) -> list[tuple[int, int, int]]:
    """``(start, code, head)`` of the runs of ``repeat`` words whose codes are among ``codes``; ``head`` is a digest of the words."""
    if len(tokens) < repeat:
        return []
    runs = windows(np.frombuffer(coded(tokens, known), np.uint8), repeat)
    at = np.flatnonzero(np.isin(runs, codes)).tolist()
    return [(a, int(runs[a]), int.from_bytes(blake2b(" ".join(tokens[a:a + repeat]).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)) for a in at]


def numbers(column) -> list[np.ndarray | None]:
    """The lists of an Arrow column of whole numbers, as arrays."""
    return [None if v.values is None else v.values.to_numpy(zero_copy_only=False) for v in column]


def stretches(text: str | None, away: str | None) -> list[list[str]]:
    return [t for t in ((text or "").split(), *(a.split() for a in (away or "").split("\n"))) if t]


def host_repeats(pages: DataFrame, repeat: int, least: int, share: float, piece: int = PIECE) -> DataFrame:
    """``(host, text, away)`` -> ``(host, codes, heads)``: the runs of ``repeat`` words that a host repeats, see `heads_of`.

    Equal texts of a host count as one page, so copies prove nothing.  A substring of ``repeat`` words or more is
    repeated if at least ``least`` different pages, and a share of ``share`` of the host's different pages, hold it,
    whether in their text or in what markup put away.

    The suffixes of a host's pages are ordered by suffix arrays of about ``piece`` characters each; a host of more
    has several, with copies in the same one.  Pages travel there as a byte a word, and once per task.  What a share
    of all pages holds, the same share of some array's pages holds, so the arrays name all runs that can count, and,
    as different words may have the same byte, some more.  These are counted exactly, by words, over all of the host's pages.
    """
    pages = pages.filter("host <> ''").select("host", F.xxhash64("text").alias("stream"), "text", "away")

    def code(batches):
        known, sent = {}, set()
        for batch in batches:
            out = []
            for host, stream, text, away in zip(*(c.to_pylist() for c in batch.columns)):
                for tokens in stretches(text, away) or [[]]:
                    codes = coded(tokens, known) + b"\0"
                    key = hash((host, stream, codes))
                    if key not in sent:
                        if len(sent) < 500_000:
                            sent.add(key)
                        out.append((host, stream, codes))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.binary()))], ["host", "stream", "codes"])

    def candidates(table):
        page: dict[int, int] = {}
        seqs = set(zip(table.column("stream").to_pylist(), table.column("codes").to_pylist()))
        seqs = sorted(q for q in seqs if page.setdefault(q[0], len(page)) >= 0 and len(q[1]) > 1)
        alone = table.column("pieces")[0].as_py() == 1
        host, found = table.column("host")[0].as_py(), np.empty(0, np.int64)
        if seqs and (not alone or len(page) >= least):
            found = repeated_windows([c for _, c in seqs], [page[q] for q, _ in seqs], repeat, max(share * len(page) * (1 - 1e-9), least if alone else 1))
        return pa.table([pa.array([host] * len(found), pa.string()), pa.array(found, pa.int64())], ["host", "code"])

    def exact(batches):
        known, sent = {}, set()
        for batch in batches:
            out = []
            for host, stream, text, away, codes in zip(*(c.to_pylist() for c in batch.columns[:4]), numbers(batch.column(4))):
                for tokens in stretches(text, away):
                    out += [(host, stream, code, head) for _, code, head in heads_of(tokens, codes, known, repeat)]
            out = [r for r in dict.fromkeys(out) if hash(r) not in sent]
            if len(sent) < 500_000:
                sent.update(map(hash, out))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int64()))], ["host", "stream", "code", "head"])

    # as a table its size is known: it is sent to all tasks, and a host's arrays are dealt by number instead of staying together
    large = saved(pages.groupBy("host").agg(F.ceil(F.sum(F.length("text") + F.length("away")) / piece).cast("int").alias("pieces")).filter("pieces > 1"), "large")
    dealt = pages.mapInArrow(code, "host string, stream long, codes binary").join(large, "host", "left").withColumn("pieces", F.coalesce("pieces", F.lit(1)))
    named = dealt.withColumn("piece", F.pmod("stream", F.col("pieces"))).groupBy("host", "piece").applyInArrow(candidates, "host string, code long")
    named = saved(named.groupBy("host").agg(F.collect_set("code").alias("codes")), "candidates")
    enough = pages.groupBy("host").agg(F.count_distinct("stream").alias("pages"))
    held = pages.join(named, "host").mapInArrow(exact, "host string, stream long, code long, head long").distinct().groupBy("host", "code", "head").agg(F.count("*").alias("n"))
    shared = held.filter(F.col("n") >= least).join(enough, "host").filter(F.col("n") >= F.col("pages") * share)
    return saved(shared.groupBy("host").agg(F.collect_set("code").alias("codes"), F.collect_set("head").alias("heads")), "heads")


def repeated(tokens: list[str], codes: np.ndarray, heads: np.ndarray, known: dict[str, int], repeat: int) -> np.ndarray:
    """Which of a page's words lie in runs that the host repeats."""
    found = heads_of(tokens, codes, known, repeat)
    hidden = np.zeros(len(tokens), bool)
    for (start, _, _), held in zip(found, np.isin(np.array([head for _, _, head in found], np.int64), heads)):
        if held:
            hidden[start:start + repeat] = True
    return hidden


def checked(hidden: np.ndarray, sizes: list[int]) -> np.ndarray:
    """``hidden`` checked against markup: an article element keeps all its words, ``sizes`` are their numbers.

    Only of several elements, those that are hidden as a whole stay so, if another one is not: they are what the host
    shows beside the article.
    """
    parts = np.split(hidden, np.cumsum(sizes)[:-1])
    whole = [bool(p.all()) for p in parts]
    return np.concatenate([np.full(len(p), w and not all(whole)) for p, w in zip(parts, whole)])


def without_repeats(text: str, sizes: list[int] | None, codes: np.ndarray, heads: np.ndarray, known: dict[str, int], repeat: int) -> str:
    """``text`` without the runs that the host repeats (`repeated`), on every page; articles are `checked`."""
    tokens = text.split()
    hidden = repeated(tokens, codes, heads, known, repeat)
    if sizes is not None:
        hidden = checked(hidden, sizes)
    return " ".join([t for t, h in zip(tokens, hidden.tolist()) if not h])


def unique_runs(pages: DataFrame, repeat: int = REPEAT, least: int = LEAST_PAGES, share: float = SHARE, piece: int = PIECE) -> DataFrame:
    """``(rid, host, tokens)`` -> ``(rid, text)``: each page without the substrings that its host's pages repeat, see `host_repeats`.

    Pages of no known host (a null or relative url) keep everything, and so do pages of fewer than ``repeat`` words.
    """
    given = pages.select("rid", "host", F.concat_ws(" ", "tokens").alias("text"), F.lit("").alias("away"), F.lit(None).cast("array<int>").alias("sizes"))
    return cleared(given, host_repeats(given, repeat, least, share, piece), repeat).select("rid", "text")


def cleared(pages: DataFrame, repeats: DataFrame, repeat: int) -> DataFrame:
    """``pages`` with their ``text`` put through `without_repeats`."""
    schema = pages.schema
    names, text, sizes = schema.names, schema.names.index("text"), schema.names.index("sizes")

    def run(batches):
        known = {}
        for batch in batches:
            columns = batch.columns[:len(names)]
            rows = zip(columns[text].to_pylist(), columns[sizes].to_pylist(), *(numbers(c) for c in batch.columns[len(names):]))
            columns[text] = pa.array([t if h is None else without_repeats(t, n, c, h, known, repeat) for t, n, c, h in rows], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    return pages.join(repeats, "host", "left").select(*names, "codes", "heads").mapInArrow(run, schema)


def main_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", repeat: int = REPEAT, least: int = LEAST_PAGES, share: float = SHARE, piece: int = PIECE) -> DataFrame:
    """``(id, url, text, n_chars)`` for every row of ``df``.

    Suffix arrays over all text of all pages of a host, articles and what markup rules out included, find the
    substrings that the host repeats (`host_repeats`).  Every page loses those, and markup checks the result: it rules
    out scripts, styles, menus, headers, footers, sidebars, notices, adverts, forms and comments, and puts back what an
    article element holds, passages that other pages repeat included (`without_repeats`).  Null and empty
    pages give an empty text; repeated rows come back as often as they are there, with the same text; an empty table
    gives an empty one.  Other columns are not read.
    """
    read = saved(read_pages(df, id_col, url_col, html_col).withColumn("host", host_of(F.col("url"))), "pages")
    out = cleared(read, host_repeats(read, repeat, least, share, piece), repeat)
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))
