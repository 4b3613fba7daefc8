"""HTML extraction by equivalence-class template deduction over the pages of a host."""

from __future__ import annotations

import hashlib
import html as html_codec
import json
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from shelf.llm import textbytes as tb
from shelf.llm.skew import join_groups
from shelf.session import write_down

SUPPORT = 0.6
MIN_PAGES = 3
#: Inside articles a text must stand on this many different pages: fewer are as likely copies of one article.
MIN_ARTICLE_PAGES = 5
ONE_PAGE = 1 << 40
MAX_BROADCAST_HOSTS, MAX_BROADCAST_CHARS = 5_000, 32 << 20
#: Tokens of the start and the end of a page.
START, END = "", "."
FLUSH = 100_000
#: Orders of tokens of a host's pages that a task keeps at a time.
MAX_ORDERS = 1_000

_SCAN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>",
    re.S,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
_DIGITS = re.compile(r"[0-9]+")
_NAME = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template iframe textarea title svg math object select option button".split())
_INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
_CLOSED_BY = {x: frozenset(y.split()) for x, y in {
    "p": "p", "li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option",
}.items()}
_CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_CHROME_TAGS = frozenset("nav header footer aside form dialog menu head button select figure".split()) - {"figure"}
_CHROME_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar toolbar".split())
#: Words in class and id names that speak against an element. They are a vote only, see :func:`_voted_out`.
_CHROME_WORDS = frozenset(
    "ad ads advert advertisement adverts advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert popup "
    "modal overlay newsletter subscribe subscription signup login sidebar aside widget menu nav navbar navigation breadcrumb breadcrumbs "
    "pagination pager header masthead footer copyright share sharing social related recommended recommendations comment comments reply "
    "replies disqus toolbar search skip toc tags form".split()
)
_ARTICLE = frozenset(("article", "main"))


class Block:
    """Consecutive text of one block: its words, the number of start tags before it, the path of its container, whether it lies in
    chrome or in an article, and the suspect elements around it."""

    __slots__ = ("text", "at", "path", "chrome", "article", "suspects")

    def __init__(self, text: str, at: int, path: str, chrome: bool, article: bool, suspects: tuple[int, ...]):
        self.text, self.at, self.path, self.chrome, self.article, self.suspects = text, at, path, chrome, article, suspects


def _is_chrome(tag: str, attributes: str) -> bool:
    """The element itself says that it is no article: by its tag, role, or that it is hidden."""
    if tag in _CHROME_TAGS:
        return True
    for m in _ATTRIBUTE.finditer(attributes or ""):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" and tag not in _ARTICLE or name == "aria-hidden" and value.lower() == "true":
            return True
        if name == "role" and value.strip().lower() in _CHROME_ROLES:
            return True
    return False


def _is_suspect(tag: str, attributes: str) -> bool:
    """A word in its class or id speaks against the element."""
    if tag in ("html", "body"):
        return False
    for m in _ATTRIBUTE.finditer(attributes or ""):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id") and tag not in _ARTICLE and any(w.lower() in _CHROME_WORDS for w in _NAME.findall(value)):
            return True
        # themes put words such as comment-open on every article, so a whole name has to say what it is
        if name == "class" and tag == "article" and any(
            (words := _NAME.findall(x)) and all(w.lower() in _CHROME_WORDS for w in words) for x in value.split()
        ):
            return True
    return False


def _voted_out(blocks: list[Block], heads: set[int]) -> None:
    """Make blocks of suspect elements chrome, but for wrappers: those that hold more than half of the page's text with its heading
    or an article in it (``heads``). Where all text is suspect, what has the heading or an article is a wrapper whatever
    its length, and if nothing has, what holds more than half."""
    inside: dict[int, int] = {}
    total = free = 0
    for b in blocks:
        if not b.chrome:
            total += len(b.text)
            free += 0 if b.suspects else len(b.text)
            for k in b.suspects:
                inside[k] = inside.get(k, 0) + len(b.text)
    most = {k for k, n in inside.items() if 2 * n > total}
    wrappers = most & heads if free else (heads & set(inside)) or most
    for b in blocks:
        b.chrome = b.chrome or any(k not in wrappers for k in b.suspects)


def _step(tag: str, attributes: str) -> str:
    """The name of an element in paths: its tag, id and first class, with numbers in them as 0. Articles go by their
    tag, as their names often differ from page to page."""
    if not attributes or tag in _ARTICLE or tag in ("html", "body"):
        return tag
    named = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
    parts = [sign + _DIGITS.sub("0", words[0]) for sign, k in (("#", "id"), (".", "class")) if (words := named.get(k, "").split())]
    return (tag + "".join(parts)).replace("/", "")


def read_page(page: str) -> tuple[list[str], list[Block]]:
    """The start tags of a page as paths of open elements, and its blocks of text in order. Missing end tags are
    implied; comments, scripts, styles and form fields give no text; character references are decoded."""
    stack: list[tuple[str, str, bool, bool, tuple[int, ...]]] = [("", "", False, False, ())]
    heads: set[int] = set()
    n_suspects = 0
    tags: list[str] = []
    blocks: list[Block] = []
    parts: list[str] = []

    def flush() -> None:
        if parts:
            text = " ".join(html_codec.unescape("".join(parts)).split())
            parts.clear()
            if text:
                k = len(stack) - 1
                while stack[k][0] in _INLINE:
                    k -= 1
                blocks.append(Block(text, len(tags), stack[k][1], *stack[-1][2:]))

    def close(names: frozenset | tuple, stop: frozenset = frozenset()) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in names:
                flush()
                del stack[k:]
                return
            if stack[k][0] in stop:
                return

    at, end = 0, len(page)
    while at < end:
        m = _SCAN.search(page, at)
        if not m:
            parts.append(page[at:])
            break
        if m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            if page.startswith("<![CDATA[", m.start()):
                parts.append(html_codec.escape(page[m.start() + 9 : at].removesuffix("]]>"), quote=False))
            continue
        attributes = m[3] or m[6] or ""
        if m[1] or m[4]:
            if tag in _INLINE:
                if stack[-1][0] == tag:
                    stack.pop()
            else:
                flush()
                close((tag,))
            continue
        if tag not in _INLINE:
            flush()
            if tag in _CLOSES_P:
                close(("p",), frozenset(("td", "th", "div", "article", "section", "li", "blockquote")))
            if tag in _CLOSED_BY:
                close(_CLOSED_BY[tag], frozenset(("ul", "ol", "dl", "table", "article", "div", "section")))
        elif tag == "br":
            parts.append(" ")
        if tag in _VOID:
            continue
        if tag in _RAW:
            stop = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = stop.end() if stop else end
            continue
        above = stack[-1]
        chrome = above[2] or _is_chrome(tag, attributes)
        path = above[1] if tag in _INLINE else f"{above[1]}/{_step(tag, attributes)}"
        suspects = above[4]
        if tag == "h1" or tag in _ARTICLE:
            heads.update(suspects)
        if _is_suspect(tag, attributes):
            suspects = (*suspects, n_suspects)
            n_suspects += 1
        stack.append((tag, path, chrome, above[3] or tag in _ARTICLE, suspects))
        if tag not in _INLINE:
            tags.append(path)
    flush()
    _voted_out(blocks, heads)
    return tags, blocks


def page_host(url) -> F.Column:
    """The host of a URL in lower case; a URL without one is its own host '' with all such pages."""
    return F.coalesce(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def _text_token(block: Block) -> str:
    """The token of a block's whole text, one of its own inside articles."""
    return ("~" if block.article else "=") + hashlib.blake2b(block.text.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def _tokens(page: str) -> dict[str, int]:
    """Tokens of a page with their counts: its start and end, paths of tags, and texts."""
    tags, blocks = read_page(page)
    found = {START: 1, END: 1}
    for token in (*tags, *map(_text_token, blocks)):
        found[token] = found.get(token, 0) + 1
    return found


def _copies_shared(pages: DataFrame) -> DataFrame:
    """(host, page_hash, share, html): equal pages of a host count as one page, each for its ``share`` of ONE_PAGE."""
    named = pages.select(page_host(F.col("url")).alias("host"), "page_id", "url", "html", F.md5(F.coalesce("html", F.lit(""))).alias("digest"))
    copied = write_down(named.groupBy("host", "digest").agg(F.count("*").alias("copies")).filter("copies > 1"), "copied")
    share = F.coalesce(F.round(F.lit(ONE_PAGE) / F.col("copies")).cast("long"), F.lit(ONE_PAGE)).alias("share")
    return named.join(copied, ["host", "digest"], "left").select("host", F.xxhash64("page_id", "url").alias("page_hash"), share, "html")


def occurrence_vectors(pages: DataFrame) -> DataFrame:
    """(host, token, n_pages, signature, n_rows) of pages by :func:`_copies_shared`. The signature sums a hash of page and count over the
    pages with the token, so tokens with equal occurrence vectors, and only they, share it. Tasks add up before they send.
    START stands on every page. ``n_pages`` is in units of ONE_PAGE."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[str, str], list] = {}

        def sent() -> pa.RecordBatch:
            keys, rows = list(totals), list(totals.values())
            sign = [int(x) if x < 1 << 63 else int(x) - (1 << 64) for x in (r[1] & (1 << 64) - 1 for r in rows)]
            return pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([r[0] for r in rows], pa.int64()),
                 pa.array(sign, pa.int64()), pa.array([r[2] for r in rows], pa.int64())],
                ["host", "token", "n_pages", "signature", "n_rows"],
            )

        for batch in batches:
            hosts, numbers = batch.column("host").to_pylist(), batch.column("page_hash").to_pylist()
            shares = batch.column("share").to_pylist()
            for host, number, share, page in zip(hosts, numbers, shares, batch.column("html")):
                tokens = _tokens(page.as_py() or "")
                values = np.fromiter(tokens.values(), np.uint64, len(tokens))
                signs = tb.mixed(np.uint64(number & (1 << 64) - 1) + values * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(24)
                for token, sign in zip(tokens, signs.tolist()):
                    row = totals.setdefault((host, token), [0, 0, 0])
                    row[0] += share
                    row[1] += sign
                    row[2] += 1
                if len(totals) > FLUSH:
                    yield sent()
                    totals.clear()
        if totals:
            yield sent()

    rows = pages.mapInArrow(count, "host string, token string, n_pages long, signature long, n_rows long")
    exact = F.sum(F.col("signature").cast("decimal(28,0)")).alias("signature")
    return rows.groupBy("host", "token").agg(F.sum("n_pages").alias("n_pages"), exact, F.sum("n_rows").alias("n_rows"))


def _least(token: Column) -> Column:
    """How many pages a token must stand on."""
    # shares of copied pages are rounded, so a count may miss a whole number by less than a thousandth
    return F.when(token.startswith("~"), MIN_ARTICLE_PAGES).otherwise(MIN_PAGES) * F.lit(ONE_PAGE) - F.lit(ONE_PAGE // 1000)


def host_classes(vectors: DataFrame, support: float = SUPPORT) -> DataFrame:
    """(host, host_pages, host_rows, often): one row for each host. ``often`` is a list in JSON of its tokens on at least ``support`` of its pages and
    at least MIN_PAGES, MIN_ARTICLE_PAGES for texts in articles, for :class:`Classes`; at most the tokens of a page, divided by ``support``."""
    vectors = write_down(vectors, "vectors")
    pages = vectors.filter(F.col("token") == START).select("host", F.col("n_pages").alias("host_pages"), F.col("n_rows").alias("host_rows"))
    often = vectors.filter(F.col("n_pages") >= _least(F.col("token"))).join(pages, "host")
    often = write_down(often.filter(F.col("n_pages") >= F.col("host_pages") * support - F.lit(ONE_PAGE // 1000)), "often")
    row = F.struct("token", "n_pages", F.col("signature").cast("string").alias("signature"))
    return pages.join(often.groupBy("host").agg(F.to_json(F.collect_list(row)).alias("often")), "host", "left")


class Classes:
    """The equivalence classes of a host: frequent tokens with one occurrence vector, two at least, numbered from that of whole pages
    and then the most frequent and largest on; and its frequent texts. Tokens of classes and texts have numbers.

    A place on a page lies in one gap of each class: as many tokens of the class stand before it since the class began anew, 0 outside the class."""

    def __init__(self, often: str | None):
        rows = json.loads(often or "[]")
        sizes: dict[str, int] = {}
        for r in rows:
            sizes[r["signature"]] = sizes.get(r["signature"], 0) + 1
        whole = next((r["signature"] for r in rows if r["token"] == START), "")
        rows.sort(key=lambda r: (r["signature"] != whole, -r["n_pages"], -sizes[r["signature"]], r["signature"], r["token"]))
        names = {x: c for c, x in enumerate(dict.fromkeys(r["signature"] for r in rows if sizes[r["signature"]] > 1))}
        self.paths = frozenset(r["token"] for r in rows if r["token"].startswith("/"))
        kept = [r for r in rows if r["signature"] in names or r["token"].startswith(("=", "~"))]
        self.tokens = [r["token"] for r in kept]
        self.number = {token: k for k, token in enumerate(self.tokens)}
        self.of = np.array([names.get(r["signature"], -1) for r in kept], np.int64)
        self.sizes = np.array([sizes[x] for x in names], np.int64)

    def order(self, tags: list[str], blocks: list[Block]) -> tuple[tuple[int, ...], list[tuple[str, int]]]:
        """The numbers of a page's tokens in page order; for each block its token and how many numbers stand before it."""
        number, at = self.number, 0
        ids = [number[START]] if START in number else []
        where = []
        for b in blocks:
            ids += [number[x] for x in tags[at : b.at] if x in number]
            at = b.at
            token = _text_token(b)
            where.append((token, len(ids)))
            if token in number:
                ids.append(number[token])
        ids += [number[x] for x in (*tags[at:], END) if x in number]
        return tuple(ids), where

    def before(self, ids: tuple[int, ...]) -> np.ndarray:
        """For each class, how many of its tokens stand before each place of a page, the place behind the last token too."""
        seen = np.zeros((len(self.sizes), len(ids) + 1), np.int64)
        of = self.of[list(ids)] if ids else np.zeros(0, np.int64)
        at = np.nonzero(of >= 0)[0]
        seen[of[at], at + 1] = 1
        return np.cumsum(seen, axis=1)

    def gaps(self, ids: tuple[int, ...]) -> list[str]:
        """For each place of a page the classes and gaps that it lies in."""
        found = self.before(ids) % self.sizes[:, None]
        return [" ".join(f"{c}:{g}" for c, g in enumerate(x) if g) for x in found.T.tolist()]

    def facts(self, ids: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of class tokens, and the gap that each lies in, in all classes, -1 in those that are not on the page. In its own class that
        is its place among the class's tokens, the class's size where the class does not come whole before it begins anew."""
        seen = self.before(ids)
        gaps = np.where(seen[:, -1:] > 0, seen[:, :-1] % self.sizes[:, None], -1).T
        nth: dict[int, int] = {}
        for k, x in enumerate(ids):
            c, n = self.of[x], nth.get(x, 0)
            nth[x] = n + 1
            if c >= 0 and seen[c, k] // self.sizes[c] != n:
                gaps[k, c] = self.sizes[c]
        at = [k for k, x in enumerate(ids) if self.of[x] >= 0]
        return np.array(ids, np.int64)[at], gaps[at]


def valid_classes(often: str | None, ranges: str | None) -> str:
    """The classes of a host that are ordered and each two nested, as a list in JSON: class, places of its tokens, their numbers, and
    the classes and gaps that it lies in.

    Tokens that have one place in their class on all pages keep it, two at least; the others leave it, so what is left is ordered.
    Two classes are nested where they never overlap or where one lies in a single gap of the other; in the order of their
    numbers, a class that is not nested with those before it is none. ``ranges`` has the least and the largest gap in class y
    of token x; tokens and classes that share no page have none."""
    classes, known = Classes(often), {}
    for r in json.loads(ranges or "[]"):
        known[int(r["x"]), int(r["y"])] = r["lo"], r["hi"]
    found: dict[int, tuple[list[int], list[int], dict[int, int]]] = {}

    def gap(tokens: list[int], c: int, ranks: list[int]) -> int | None:
        at = {_kept_gap(ranks, x) for t in tokens for x in known.get((t, c), ())}
        return None if len(at) > 1 else at.pop() if at else 0

    for c, size in enumerate(classes.sizes.tolist()):
        place = {t: known[t, c] for t in np.nonzero(classes.of == c)[0].tolist() if (t, c) in known}
        tokens = sorted((t for t, (lo, hi) in place.items() if lo == hi < size), key=lambda t: place[t])
        ranks = [place[t][0] for t in tokens]
        if len(ranks) < 2 or len(set(ranks)) < len(ranks):
            continue
        pairs = {d: (gap(tokens, d, theirs), gap(others, c, ranks)) for d, (theirs, others, _) in found.items()}
        if any(a is None or b is None or a and b for a, b in pairs.values()):
            continue
        for d, (_, b) in pairs.items():
            if b:
                found[d][2][c] = b
        found[c] = ranks, tokens, {d: a for d, (a, _) in pairs.items() if a}
    return json.dumps([[c, ranks, tokens, list(outer.items())] for c, (ranks, tokens, outer) in found.items()])


def _kept_gap(ranks: list[int], gap: int) -> int:
    """A gap of all tokens of a class as one of those that stay in it."""
    return bisect_left(ranks, gap) % len(ranks)


class Nested:
    """The valid classes of a host (:func:`valid_classes`). A slot is the innermost gap of theirs that a place lies in."""

    def __init__(self, often: str | None, valid: str | None):
        self.classes = Classes(often)
        rows = json.loads(valid or "[]")
        self.ranks = {c: ranks for c, ranks, _, _ in rows}
        self.outer = {c: dict(map(tuple, outer)) for c, _, _, outer in rows}
        tokens = [self.classes.tokens[t] for _, _, numbers, _ in rows for t in numbers]
        self.texts = frozenset(x for x in tokens if x.startswith(("=", "~")))
        self.empty = all(x in (START, END) for x in tokens)
        self._seen: dict[str, str] = {}

    def slot(self, gaps: str) -> str:
        """The slot of a place in these gaps of all classes."""
        if gaps not in self._seen:
            inner, at = -1, 0
            for c, gap in (map(int, x.split(":")) for x in gaps.split()):
                if c in self.ranks and (k := _kept_gap(self.ranks[c], gap)) and (inner < 0 or inner in self.outer[c]):
                    inner, at = c, k
            self._seen[gaps] = f"{inner}:{at}" if at else ""
        return self._seen[gaps]

    def around(self, slot: str) -> frozenset[str]:
        """A slot and those that it lies in."""
        return frozenset([slot, *(f"{c}:{gap}" for c, gap in self.outer[int(slot.split(":")[0])].items())] if slot else [slot])


def _holder(block: Block, paths: frozenset[str]) -> str:
    """What holds a block: 'a' and its outermost article, 'c' and its container; where that is no frequent element, the innermost one
    around it with 'b' for articles and 'g' for containers."""
    article, container = _article_of(block.path), block.path.rpartition("/")[0]
    if article in paths:
        return "a" + article
    if not article and (container in paths or block.path in paths):
        return "c" + container
    while container and container not in paths:
        container = container.rpartition("/")[0]
    return ("b" if article else "g") + container


def _with_hosts(rows: DataFrame, hosts: DataFrame) -> DataFrame:
    """``rows`` with the columns of their host, from a written table with ``host_rows`` and texts."""
    chars = sum((F.length(F.coalesce(c, F.lit(""))).cast("long") for c, kind in hosts.dtypes if kind == "string"), F.lit(0))
    n_hosts, n_pages, size = hosts.agg(F.count("*"), F.sum("host_rows"), F.sum(chars)).first()
    if n_hosts <= MAX_BROADCAST_HOSTS and (size or 0) <= MAX_BROADCAST_CHARS:
        return rows.join(F.broadcast(hosts), "host", "left")
    return join_groups(rows, hosts, "host", "host_rows", n_pages or 0, "left")


_FACTS = "host string, kind string, x string, y string, z string, lo long, hi long, n long"


def class_facts(pages: DataFrame) -> DataFrame:
    """Where tokens and texts stand, from pages (host, share, html, often); (host, kind, x, y, z, lo, hi, n) with kind
    'R': token number x lies in the gaps lo to hi of class y;
    'T': frequent text x stands in the gaps y, one or more places of a page, on n pages in units of ONE_PAGE;
    'M': n characters outside chrome stand in x (:func:`_holder`) and in the gaps y; z is their token if it is frequent."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[str, str, str, str, str], int] = {}
        ranges: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        held = 0

        def sent() -> pa.RecordBatch:
            nonlocal held
            rows = [(*k, 0, 0, n) for k, n in totals.items()]
            for host, (lo, hi) in ranges.items():
                rows += [(host, "R", str(t), str(c), "", int(lo[t, c]), int(hi[t, c]), 0) for t, c in zip(*np.nonzero(hi >= 0))]
            totals.clear()
            ranges.clear()
            held = 0
            kinds = [pa.string()] * 5 + [pa.int64()] * 3
            names = [x.split()[0] for x in _FACTS.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

        for batch in batches:
            known: dict[str, tuple[Classes, dict]] = {}
            shares, often = batch.column("share").to_pylist(), batch.column("often")
            for k, (host, share, page) in enumerate(zip(batch.column("host").to_pylist(), shares, batch.column("html"))):
                if host not in known:
                    known[host] = Classes(often[k].as_py()), {}
                classes, orders = known[host]
                if not classes.tokens and not classes.paths:
                    continue
                tags, blocks = read_page(page.as_py() or "")
                ids, where = classes.order(tags, blocks)
                if ids not in orders:
                    if len(orders) > MAX_ORDERS:
                        orders.clear()
                    orders[ids] = classes.gaps(ids)
                    if host not in ranges:
                        shape = len(classes.tokens), len(classes.sizes)
                        ranges[host] = np.full(shape, 1 << 40, np.int64), np.full(shape, -1, np.int64)
                        held += shape[0] * shape[1]
                    numbers, gaps = classes.facts(ids)
                    np.minimum.at(ranges[host][0], numbers, np.where(gaps < 0, 1 << 40, gaps))
                    np.maximum.at(ranges[host][1], numbers, gaps)
                gaps, places = orders[ids], {}
                for b, (token, at) in zip(blocks, where):
                    frequent = token in classes.number
                    if frequent:
                        places.setdefault(token, set()).add(gaps[at])
                    if not b.chrome:
                        key = host, "M", _holder(b, classes.paths), gaps[at], token if frequent else ""
                        totals[key] = totals.get(key, 0) + len(b.text)
                for token, found in places.items():
                    key = host, "T", token, "|".join(sorted(found)), ""
                    totals[key] = totals.get(key, 0) + share
                if len(totals) + held > FLUSH:
                    yield sent()
        if totals or ranges:
            yield sent()

    rows = pages.mapInArrow(count, _FACTS)
    return rows.groupBy("host", "kind", "x", "y", "z").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"))


def host_templates(pages: DataFrame, classes: DataFrame, support: float = SUPPORT) -> DataFrame:
    """(host, host_rows, often, valid, texts, masses): one row for each host of ``classes`` (:func:`host_classes`), from pages by :func:`_copies_shared`.

    Its classes are checked for order and nesting on all pages (``valid``, see :func:`valid_classes`). A text outside valid
    classes is the template's in the slots in which it stands on as many pages as a frequent token, and not in others (``texts``); a
    page that lacks a class counts for the slots in it by the slot around it. ``masses`` has the length of the text that is not the
    template's by holder and slot. All are lists in JSON, as long as the tokens of a page divided by ``support``."""
    classes = write_down(classes, "classes")
    placed = _with_hosts(pages.select("host", "share", "html"), classes.select("host", "host_rows", "often"))
    facts = write_down(class_facts(placed), "facts")
    ranges = facts.filter("kind = 'R'").groupBy("host").agg(F.to_json(F.collect_list(F.struct("x", "y", "lo", "hi"))).alias("ranges"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            valid = [valid_classes(*x) for x in zip(batch.column("often").to_pylist(), batch.column("ranges").to_pylist())]
            names = ["host", "host_pages", "host_rows", "often"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(valid, pa.string())], [*names, "valid"])

    kinds = "host string, host_pages long, host_rows long, often string, valid string"
    hosts = write_down(classes.join(ranges, "host", "left").mapInArrow(judge, kinds), "valid")

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known, rows = {}, []
            for k, (host, kind, x, y, z, n) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("host", "kind", "x", "y", "z", "n")))):
                if host not in known:
                    known[host] = Nested(batch.column("often")[k].as_py(), batch.column("valid")[k].as_py())
                nested = known[host]
                if (x if kind == "T" else z) not in nested.texts:
                    rows.append((host, kind, x, "|".join(sorted({nested.slot(gaps) for gaps in y.split("|")})), z, n))
            names = ["host", "kind", "x", "slots", "z", "n"]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64() if name == "n" else pa.string()) for k, name in enumerate(names)], names)

    slots = _with_hosts(facts.filter("kind <> 'R'").select("host", "kind", "x", "y", "z", "n"), hosts.drop("host_pages"))
    slots = slots.mapInArrow(project, "host string, kind string, x string, slots string, z string, n long")
    slots = write_down(slots.groupBy("host", "kind", "x", "slots", "z").agg(F.sum("n").alias("n")), "slots")

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, known = [], {}
            for k, (host, text, least) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("host", "z", "least")))):
                if host not in known:
                    known[host] = Nested(batch.column("often")[k].as_py(), batch.column("valid")[k].as_py())
                places = [(frozenset(r["slots"].split("|")), r["n"]) for r in json.loads(batch.column("places")[k].as_py())]
                around = {x: known[host].around(x) for found, _ in places for x in found}
                for slot, outer in around.items():
                    if sum(n for found, n in places if any(x in outer or slot in around[x] for x in found)) >= least:
                        rows.append((host, text, slot))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(3)], ["host", "z", "slot"])

    least = F.greatest(_least(F.col("z")), (F.col("host_pages") * support).cast("long") - F.lit(ONE_PAGE // 1000)).alias("least")
    texts = slots.filter("kind = 'T'").groupBy("host", F.col("x").alias("z")).agg(F.to_json(F.collect_list(F.struct("slots", "n"))).alias("places"))
    texts = texts.join(hosts.drop("host_rows"), "host").select("host", "z", "places", least, "often", "valid")
    texts = write_down(texts.mapInArrow(settle, "host string, z string, slot string"), "texts")
    rest = slots.filter("kind = 'M'").withColumnRenamed("slots", "slot").join(texts, ["host", "z", "slot"], "left_anti")
    masses = rest.groupBy("host", "x", "slot").agg(F.sum("n").alias("n")).filter("n > 0")
    for name, rows, row in (("texts", texts, F.struct("z", "slot")), ("masses", masses, F.struct("x", "slot", "n"))):
        hosts = hosts.join(rows.groupBy("host").agg(F.to_json(F.collect_list(row)).alias(name)), "host", "left")
    return hosts.drop("host_pages")


def _article_of(path: str) -> str:
    """The path of the outermost article element that a path goes through, or ''."""
    steps = path.split("/")
    k = next((k for k, step in enumerate(steps) if step in _ARTICLE), -1)
    return "/".join(steps[: k + 1]) if k > 0 else ""


class Template:
    """The template of a host, and where its articles stand: in ``kind`` and ``at``, that of :func:`_holder` with the most text, articles first
    among equals. ``main`` is the container with the most text. ``slots`` are those in which the text of ``at`` outweighs all other."""

    def __init__(self, often: str | None, valid: str | None, texts: str | None, masses: str | None):
        self.nested = Nested(often, valid)
        self.texts = frozenset((r["z"], r["slot"]) for r in json.loads(texts or "[]"))
        held: dict[str, int] = {}
        whole: dict[str, int] = {}
        rows = json.loads(masses or "[]")
        for r in rows:
            held[r["x"]] = held.get(r["x"], 0) + r["n"]
            whole[r["slot"]] = whole.get(r["slot"], 0) + r["n"]
        most = [max(((n, x[1:], kind) for x, n in held.items() if x[0] == kind), default=(0, "", kind)) for kind in "abcg"]
        self.main = most[2][1]
        _, self.at, self.kind = max(most, key=lambda x: x[0])
        mine: dict[str, int] = {}
        for r in rows:
            if r["x"][0] == self.kind and (r["x"][1:] == self.at or self.kind == "c" and r["x"][1:].startswith(self.at + "/")):
                mine[r["slot"]] = mine.get(r["slot"], 0) + r["n"]
        self.slots = frozenset(x for x, n in mine.items() if 2 * n > whole[x])
        self._orders: dict[tuple[int, ...], list[str]] = {}

    def __bool__(self) -> bool:
        return bool(self.texts) or not self.nested.empty

    def left(self, tags: list[str], blocks: list[Block]) -> list[tuple[Block, str]]:
        """The blocks of a page outside chrome that are not texts of the template, each with its slot."""
        ids, where = self.nested.classes.order(tags, blocks)
        if ids not in self._orders:
            if len(self._orders) > MAX_ORDERS:
                self._orders.clear()
            self._orders[ids] = [self.nested.slot(gaps) for gaps in self.nested.classes.gaps(ids)]
        slots = self._orders[ids]
        return [
            (b, slots[at]) for b, (token, at) in zip(blocks, where)
            if not b.chrome and token not in self.nested.texts and (token, slots[at]) not in self.texts
        ]


def _main_text(page: str, template: Template) -> str:
    """Blocks of a page that hold the article: outside chrome, not texts of the template, and in the host's article or main
    container, or in its slots where most text stands in elements that only some pages have. On pages without
    them, those in articles where the host has its text in some, else those in the host's slots; then, and on hosts without
    template, those in any article, else in the main container, else all."""
    left = template.left(*read_page(page))
    rest = [b for b, _ in left]
    inside = lambda at: [b for b in rest if (b.path + "/").startswith(at + "/")]
    articles = [b for b in rest if b.article]
    chosen = []
    if template and (template.at or template.kind in "bg"):
        slots = [b for b, slot in left if slot in template.slots]
        if template.kind in "ac":
            chosen = inside(template.at)
        elif template.kind == "b":
            chosen = [b for b in slots if b.article]
        chosen = chosen or template.kind in "ab" and articles or slots
    chosen = chosen or articles or inside(template.main) or rest
    return "\n".join(b.text for b in chosen)


def extract_main_text(pages: DataFrame, support: float = SUPPORT) -> DataFrame:
    """(page_id, url, text, n_chars) of every page.

    Tokens that occur equally often on every page of a host form a class; ordered and nested classes on most of its pages make its
    template, and a text that stands on most pages in one slot is the template's there. What is left in the gaps between neighbouring tokens are slots; those of the article are the main text: not
    menus, headers, footers, sidebars, notices, adverts, forms, comments, scripts or styles (by element and role; words in
    class and id names are a vote that an element with most of the page's text overrules), nor texts of the template, inside articles or not. Articles are one kind of slot: where the
    host's other text outweighs them they are teasers. White space within a block becomes one space; blocks are
    joined by one newline in page order.

    Null or empty html gives '' and 0. A host with fewer than MIN_PAGES pages has no template; elements alone
    decide there. Pages of any length are read whole. Repeated pages give repeated rows; other columns are not read.
    """
    shared = _copies_shared(pages)
    templates = write_down(host_templates(shared, host_classes(occurrence_vectors(shared), support), support), "templates")
    rows = _with_hosts(pages.select("page_id", "url", "html", page_host(F.col("url")).alias("host")), templates)
    parts = ["often", "valid", "texts", "masses"]

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, seen = [], {}
            for k, (host, page) in enumerate(zip(batch.column("host").to_pylist(), batch.column("html"))):
                if host not in seen:
                    seen[host] = Template(*(batch.column(c)[k].as_py() for c in parts))
                texts.append(_main_text(page.as_py() or "", seen[host]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    kind = pages.schema["page_id"].dataType.simpleString()
    return rows.select("page_id", "url", "html", "host", *parts).mapInArrow(extract, f"page_id {kind}, url string, text string, n_chars long")
