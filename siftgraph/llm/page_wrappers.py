"""Main text of web pages by wrappers that are inferred per host.

A wrapper is a union-free regular expression over the tokens of a host's pages: tags, text
slots, optional parts and repeated groups. It is inferred without examples: a page is read as
a token stream, consecutive equal parts become repeated groups, and the streams of one host
are aligned one after another with the wrapper so far. Tokens that agree stay; texts that
differ become slots (texts that never differ are the template's); groups that begin and end
alike are aligned inside; what only one side has becomes optional (its support is below the
number of pages). A single part that the other side repeats counts as a group of one.

Every slot knows where it stands: inside ``article`` or ``main``, inside a menu, header, footer,
sidebar, form, notice, advert or comment section (by tag, role, class or id), or elsewhere,
then with the containers around it. A page is aligned with its host's wrapper, and the slots
its texts fall into decide: article texts if it has any, else texts of ``main``, else those of
the container that holds most of the host's non-template words outside links.

Scale: streams with one structure are added up per task before they move; a host's structures
are merged in ``SALTS`` parts first, so a hot host is spread and its last merge reads at most
``SALTS`` rows. Pages meet the wrappers in a join by host, which Spark broadcasts when the
wrappers are small and deals by host with skew splitting otherwise. Memory: one host's whole
wrapper, ``CELLS`` scores of an alignment (larger ones are done in halves) and the longest page.
A wrapper takes in every part of every page; it grows with a host's distinct structures, not pages.

Defined cases: a null or empty html has the empty text; a null url or one without a host forms
the host ''; a null page_id is kept; repeated rows give repeated results; malformed markup is
read as browsers do in outline (unclosed and stray tags, cut-off pages; a tag cut off by the
end is dropped). Headings in a header inside the article stay. White space is what Unicode
calls so. Extra columns are not read.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import spread
from .tables import stored
from .words import slices

SALTS = 64  # parts of one host that are merged apart
MOST_NODES = 4096  # nodes that are aligned at once; more are aligned in halves
LONGEST_GROUP = 64  # nodes of a repeated group, counted at its own level
CELLS = 20_000_000  # scores of an alignment in memory at once
HELD = 2000  # structures a task adds up before it hands them on

# Element names and the words that mark parts of a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|title|textarea|iframe|xmp|noembed|noframes"
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary "
    "table tbody td tfoot th thead tr ul".split()
)
NOISE_TAGS = frozenset("aside button dialog footer form head menu nav noscript object optgroup option select svg template".split())
NOISE_ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments commentlist "
    "consent cookie cookies copyright disqus footer login menu modal nav navbar navigation newsletter notice notices "
    "notification pager pagination popup promo promoted related replies respond share sharing sidebar signup skip social "
    "sponsor sponsored subscribe toolbar widget".split()
)
COMMENT_NAMES = frozenset("comment comments reply".split())  # of an article, as whole class names
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset("blockquote body center dd div dl fieldset figure li main ol section table tbody td tr ul".split())
CLOSED_BY = {
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]),
    "th": frozenset(["td", "th"]),
    "option": frozenset(["option"]),
}
SCOPES = frozenset("article aside body div dl footer form header html main nav ol section table td th ul".split())

# text, raw element, slash of an end tag, name, attributes, closing bracket, a bracket that opens nothing
_PIECES = re.compile(
    rf"([^<]+)|<!--.*?(?:-->|\Z)|<({RAW})(?=[\s/>])[^>]*>.*?(?:</\2\s*>|\Z)|<(?:[!?]|/(?![A-Za-z]))[^>]*(?:>|\Z)"
    r"""|<(/?)([A-Za-z][^\s/>]*)((?:=\s*(?:"[^"]*"|'[^']*')?|[^>=])*+)(>|\Z)|(<)""",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""")
_WORD = re.compile(r"[a-z]+")
_HOST = "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"


class Node:
    """A token (``items`` is None) or a repeated group of a stream or wrapper."""

    __slots__ = ("sym", "items", "lit", "words", "n", "at")

    def __init__(self, sym: str, items: list[Node] | None = None, lit: int = 0, words: int = 0, n: int = 1, at: tuple = ()):
        self.sym, self.items = sym, items
        self.lit, self.words = lit, words  # hash of the text, 0 where it differs; its words
        self.n, self.at = n, at  # pages that have it; its texts' numbers in a page

    def copied(self) -> Node:
        items = None if self.items is None else [x.copied() for x in self.items]
        return Node(self.sym, items, self.lit, self.words, self.n, self.at)

    def glue(self) -> str:
        """Nodes of equal glue may be aligned: tokens that agree, groups that begin and end alike."""
        if self.items is None:
            return self.sym
        first, last = self.items[0], self.items[-1]
        while first.items is not None:
            first = first.items[0]
        while last.items is not None:
            last = last.items[-1]
        return f"+{first.sym} {last.sym}"


def group(items: list[Node], n: int) -> Node:
    return Node(f"({' '.join(x.sym for x in items)})+", items, n=n)


class _Opened:
    """Open elements of a page: name, region and path of containers of each."""

    def __init__(self):
        self.names: list[str] = []
        self.places: list[tuple[str, str]] = [("o", "")]

    def cut(self, k: int) -> None:
        del self.names[k:], self.places[k + 1 :]

    def close_implied(self, name: str) -> None:
        """Close what a start tag of a block ends by itself: an open p, or an item of the same list."""
        names, closes = self.names, CLOSED_BY.get(name, ())
        for k in range(len(names) - 1, -1, -1):
            if names[k] in closes:
                self.cut(k)
            elif names[k] == "p":
                return self.cut(k)
            elif names[k] in SCOPES and names[k] not in ("td", "th"):
                return

    def close(self, name: str) -> None:
        names = self.names
        if names and names[-1] == name:
            return self.cut(len(names) - 1)
        for k in range(len(names) - 1, -1, -1):
            if names[k] == name:
                if name in BLOCKS or not BLOCKS.intersection(names[k + 1 :]):
                    self.cut(k)
                else:
                    del names[k], self.places[k + 1]
                return
            if names[k] in SCOPES and name not in BLOCKS:
                return


def _region(name: str, rest: str, inside: str) -> tuple[str, list[str]]:
    """(region of an element, its class and id words): a article, m main, o other, n noise, h header inside a or m."""
    words: list[str] = []
    names: list[str] = []
    role = prop = ""
    if rest and "=" in rest:
        for key, value in _ATTRIBUTE.findall(rest):
            key = key.lower()
            if key in ("class", "id"):
                words += _WORD.findall(value.lower())
                names += value.strip("\"'").lower().split()
            elif key == "role":
                role = value.strip("\"'").lower()
            elif key == "itemprop":
                prop = value.strip("\"'").lower()
    if inside == "n" or name in NOISE_TAGS or role in NOISE_ROLES:
        return "n", words
    if name in HEADINGS and inside in "AM":
        return inside.lower(), words
    marks = NOISE_WORDS.intersection(words) if words else ()
    if name in ("html", "body", "main", "article") or name in HEADINGS:
        marks = COMMENT_NAMES.intersection(names) if name == "article" else ()
    if marks:
        return "n", words
    if name == "header" or "header" in words and name in ("div", "section"):
        return ("n" if inside == "o" else inside.upper()), words
    if inside not in "AM":
        if name == "article" or role == "article" or prop == "articlebody":
            return "a", words
        if (name == "main" or role == "main") and inside == "o":
            return "m", words
    return inside, words


@lru_cache(maxsize=4096)
def _place(name: str, rest: str, inside: str, path: str) -> tuple[str, str]:
    """(region, path) inside an element."""
    region, words = _region(name, rest, inside)
    if region == "o" and name in CONTAINERS:
        path = f"{path}>{'.'.join([name, *sorted(set(words))])}"
    return region, path


@lru_cache(maxsize=4096)
def _text_symbol(region: str, path: str, linked: bool) -> str:
    if region == "o":
        return f"#{'l' if linked else 'o'}|{path}"
    return "#n" if region in "AM" else f"#{region}"


def read_page(html: str) -> tuple[list[Node], list[str], list[int]]:
    """(tokens, texts, block number of each text) of a page; a text's token knows its number."""
    tokens: list[Node] = []
    texts: list[str] = []
    block_of: list[int] = []
    waiting: list[tuple[Node, bool, str, str]] = []  # texts of the open block: token, in a link, region, path
    opened = _Opened()
    names, places = opened.names, opened.places
    block = 0

    def end_block() -> int:
        linked = all(w[1] for w in waiting)
        for node, _, region, path in waiting:
            node.sym = _text_symbol(region, path, linked)
        waiting.clear()
        return block + 1

    for text, _, end, name, rest, closing, stray in _PIECES.findall(html):
        if text or stray:
            text = unescape(text or stray)
            if not text.isspace():
                node = Node("", None, zlib.crc32(text.encode("utf-8", "replace")) + 1, text.count(" ") + 1, 1, (len(texts),))
                tokens.append(node)
                waiting.append((node, "a" in names, *places[-1]))
            texts.append(text)  # white space alone may part two words of a block
            block_of.append(block)
            continue
        if not name:
            continue
        if not closing:
            break
        name = name.lower()
        is_block = name in BLOCKS
        if is_block and waiting:
            block = end_block()
        if end:
            tokens.append(Node("/" + name))
            opened.close(name)
            continue
        if is_block:
            opened.close_implied(name)
        tokens.append(Node("<" + name))
        if name not in VOID:
            place = _place(name, rest if "=" in rest else "", *places[-1])
            names.append(name)
            places.append(place)
    end_block()
    return tokens, texts, block_of


def _same(a: list[Node], b: list[Node]) -> bool:
    return [x.sym for x in a] == [x.sym for x in b]


def add_in(into: Node, other: Node, pages: bool) -> None:
    """Add a node of the same structure: further pages, or another round of a group."""
    into.n = into.n + other.n if pages else max(into.n, other.n)
    into.words += other.words
    into.at += other.at
    if into.lit != other.lit:
        into.lit = 0
    if into.items is not None:
        for x, y in zip(into.items, other.items, strict=True):
            add_in(x, y, pages)


def fold(tokens: list[Node]) -> list[Node]:
    """The stream with consecutive equal parts as repeated groups, inner ones first."""
    out: list[Node] = []
    ends: list[str] = []  # last symbol of each node, inside its group
    for token in tokens:
        out.append(token)
        ends.append(token.sym)
        again = True
        while again:
            again = False
            n, last = len(out), ends[-1]
            for q in range(1, min(LONGEST_GROUP, n - 1) + 1):
                if ends[n - 1 - q] != last:
                    continue
                before, new = out[n - 1 - q], out[n - q :]
                if before.items is not None and len(before.items) == q and _same(before.items, new):
                    old, kept = before.items, n - q
                elif 2 * q <= n and _same(out[n - 2 * q : n - q], new):
                    old, kept = out[n - 2 * q : n - q], n - 2 * q + 1
                    out[kept - 1] = group(old, 1)
                    ends[kept - 1] = last
                else:
                    continue
                for x, y in zip(old, new, strict=True):
                    add_in(x, y, False)
                del out[kept:], ends[kept:]
                again = True
                break
    return out


def _wrapped(nodes: list[Node], other: list[Node]) -> list[Node]:
    """``nodes`` with each single part that ``other`` repeats as a group of one."""
    for g in sorted({x.sym: x for x in other if x.items is not None}.values(), key=lambda x: -len(x.items)):
        size, first, out, i = len(g.items), g.items[0].sym, [], 0
        while i < len(nodes):
            part = nodes[i : i + size]
            if nodes[i].sym == first and len(part) == size and _same(part, g.items):
                out.append(group(part, max(x.n for x in part)))
                i += size
            else:
                out.append(nodes[i])
                i += 1
        nodes = out
    return nodes


def align(a: list[Node], b: list[Node], most: int = MOST_NODES) -> list[tuple[int, int]]:
    """Pairs of places with equal glue, ascending on both sides, most tokens matched.

    Scores of more than ``most`` rows or ``CELLS`` cells are kept in halves, with the same result.
    """
    number: dict[str, int] = {}
    x, y = ([number.setdefault(node.glue(), len(number)) for node in side] for side in (a, b))
    head = 0
    while head < min(len(x), len(y)) and x[head] == y[head]:
        head += 1
    tail = 0
    while tail < min(len(x), len(y)) - head and x[-1 - tail] == y[-1 - tail]:
        tail += 1
    pairs = [(i, i) for i in range(head)]
    # what only one side has is matched with nothing
    ours, theirs = set(x[head : len(x) - tail]), set(y[head : len(y) - tail])
    rows = [i for i in range(head, len(x) - tail) if x[i] in theirs]
    columns = [j for j in range(head, len(y) - tail) if y[j] in ours]
    there = np.array([y[j] for j in columns], np.int64)

    def below(score: np.ndarray, i: int, out: np.ndarray) -> None:
        """Scores of the next row, the i-th of ``rows``, over as many columns as ``score`` has."""
        node = a[rows[i]]
        weight = 1 if node.items is None else 2 + len(node.items)
        same = there[: len(score) - 1] == x[rows[i]]
        best = np.maximum(score[1:], np.where(same, score[:-1] + weight, 0))
        np.maximum.accumulate(best, out=out[1:])

    def back(top: np.ndarray, low: int, high: int, j: int) -> int:
        """Matches of rows low to high with the first j columns, last first; the columns that are left."""
        if not j or low == high:
            return j
        top = top[: j + 1]
        if high - low > 1 and (high - low > most or (high - low) * j > CELLS):
            middle, at = (low + high) // 2, top.copy()
            for i in range(low, middle):
                row = np.zeros_like(at)
                below(at, i, row)
                at = row
            return back(top, low, middle, back(at, middle, high, j))
        score = np.zeros((high - low + 1, j + 1), np.int32)
        score[0] = top
        for i in range(low, high):
            below(score[i - low], i, score[i - low + 1])
        i = high - low
        while i and j:
            if score[i, j] == score[i - 1, j]:
                i -= 1
            elif score[i, j] == score[i, j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                matched.append((rows[low + i], columns[j]))
        return j

    matched: list[tuple[int, int]] = []
    back(np.zeros(len(columns) + 1, np.int32), 0, len(rows), len(columns))
    pairs += matched[::-1]
    return pairs + [(len(x) - k, len(y) - k) for k in range(tail, 0, -1)]


def unify(wrapper: list[Node], stream: list[Node], most: int = MOST_NODES) -> list[Node]:
    """The wrapper that also describes ``stream`` (another folded page, or another wrapper), all of it."""
    wrapper, stream = _wrapped(wrapper, stream), _wrapped(stream, wrapper)
    out, i, j = [], 0, 0
    for to, of in [*align(wrapper, stream, most), (len(wrapper), len(stream))]:
        out += wrapper[i:to]
        out += stream[j:of]
        if to < len(wrapper):
            w, s = wrapper[to], stream[of]
            if w.items is None or w.sym == s.sym:
                add_in(w, s, True)
                out.append(w)
            else:
                out.append(group(unify(w.items, s.items, most), w.n + s.n))
        i, j = to + 1, of + 1
    return out


def dumped(nodes: list[Node]) -> list:
    return [[x.sym, x.n, x.lit, x.words] if x.items is None else ["+", x.n, dumped(x.items)] for x in nodes]


def loaded(rows: list) -> list[Node]:
    return [group(loaded(r[2]), r[1]) if r[0] == "+" else Node(r[0], lit=r[2], words=r[3], n=r[1]) for r in rows]


def expression(nodes: list[Node], pages: int) -> str:
    """The wrapper as text: tags, ``#`` for a slot, ``'`` for the template's text, ``( )+`` and ``( )?``."""
    out, optional = [], False
    for x in nodes:
        if (x.n < pages) != optional:
            out.append(")?" if optional else "(")
            optional = not optional
        if x.items is not None:
            out.append(f"({expression(x.items, x.n)})+")
        elif x.sym.startswith("#"):
            out.append("'" if x.lit and x.n > 1 else "#")
        else:
            out.append(f"{x.sym}>" if x.sym[0] == "<" else f"<{x.sym}>")
    return " ".join([*out, ")?"] if optional else out)


def _slots(nodes: list[Node]) -> Iterator[Node]:
    for x in nodes:
        if x.items is not None:
            yield from _slots(x.items)
        elif x.sym.startswith("#"):
            yield x


def judge(wrapper: list[Node]) -> Callable[[Node], int]:
    """Rank of a slot: 3 article, 2 main, 1 the fullest container, 0 no main text."""
    other = [x for x in _slots(wrapper) if x.sym[1] == "o"]
    varies = any(not x.lit and x.n > 1 for x in other)
    words: dict[str, int] = {}
    for x in other:
        if not (varies and x.lit and x.n > 1):
            words[x.sym[3:]] = words.get(x.sym[3:], 0) + x.words
    best = min(words, key=lambda p: (-words[p], p)) if words else None

    def rank(x: Node) -> int:
        place = x.sym[1]
        if place in "am":
            return 3 if place == "a" else 2
        if place != "o" or best is None or varies and x.lit and x.n > 1 and x in known:
            return 0
        path = x.sym[3:]
        return int(path == best or path.startswith(best + ">"))

    known = set(other)
    return rank


def _ranks(wrapper: list[Node], stream: list[Node], rank: Callable[[Node], int]) -> list[int]:
    """Rank of every text of a folded page, by the slots it falls into."""
    stream, wrapper = _wrapped(stream, wrapper), _wrapped(wrapper, stream)
    to = dict((j, i) for i, j in align(wrapper, stream))
    out: list[int] = []
    for j, x in enumerate(stream):
        slot = wrapper[to[j]] if j in to else None
        if x.items is not None:
            out += _ranks([] if slot is None else slot.items, x.items, rank)
        elif x.sym.startswith("#"):
            out.append(rank(x if slot is None else slot))
    return out


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url.cast("string"), _HOST, 1), F.lit("")))


_STREAMS = "host string, shape bigint, n bigint, nodes string"


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names = [c.split()[0] for c in schema.split(", ")]
    types = [pa.int64() if c.endswith("bigint") else pa.string() for c in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Folded streams, pages of one host and structure added up."""
    held: dict[tuple[str, str], tuple[int, list[Node]]] = {}

    def handed() -> pa.RecordBatch:
        rows = [(host, zlib.crc32(shape.encode()), n, json.dumps(dumped(nodes))) for (host, shape), (n, nodes) in held.items()]
        held.clear()
        return _rows(rows, _STREAMS)

    for part in slices(batches, "html"):
        for host, html in zip(part.column("host").to_pylist(), part.column("html").to_pylist(), strict=True):
            nodes = fold(read_page(html or "")[0])
            for x in nodes:
                _forget(x)
            key = host, " ".join(x.sym for x in nodes)
            if key in held:
                n, known = held[key]
                for x, y in zip(known, nodes, strict=True):
                    add_in(x, y, True)
                held[key] = n + 1, known
            else:
                held[key] = 1, nodes
        if len(held) >= HELD:
            yield handed()
    if held:
        yield handed()


def _forget(x: Node) -> None:
    x.at = []
    for y in x.items or ():
        _forget(y)


def _unified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One wrapper per (host, shape column) of rows that come sorted by them."""
    key, pages, wrapper = None, 0, []
    for batch in batches:
        for host, shape, n, nodes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (host, shape) != key:
                if key is not None:
                    yield _rows([(*key, pages, json.dumps(dumped(wrapper)))], _STREAMS)
                key, pages, wrapper = (host, shape), n, loaded(json.loads(nodes))
            else:
                pages += n
                wrapper = unify(wrapper, loaded(json.loads(nodes)))
    if key is not None:
        yield _rows([(*key, pages, json.dumps(dumped(wrapper)))], _STREAMS)


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """(host, n pages, nodes): one wrapper per host of ``pages`` (url, html); ``nodes`` is JSON."""
    read = pages.select(host_of(F.col("url")).alias("host"), F.col("html").cast("string").alias("html"))
    streams = read.mapInArrow(_streams, _STREAMS)
    # one structure of a hot host comes from every task, so the task takes part in the salt
    salted = streams.withColumn("salt", (F.col("shape") + F.spark_partition_id()) % SALTS)
    parts = (
        salted.repartition("host", "salt")
        .sortWithinPartitions("host", "salt", "shape", "nodes")
        .select("host", F.col("salt").alias("shape"), "n", "nodes")
        .mapInArrow(_unified, _STREAMS)
    )
    one = parts.repartition("host").sortWithinPartitions("host", "shape")
    return one.select("host", F.lit(0).cast("bigint").alias("shape"), "n", "nodes").mapInArrow(_unified, _STREAMS).drop("shape")


@lru_cache(maxsize=64)
def _known(nodes: str) -> tuple[list[Node], Callable[[Node], int], dict[str, list[int]]]:
    wrapper = loaded(json.loads(nodes))
    return wrapper, judge(wrapper), {}


def main_text(html: str, nodes: str) -> str:
    """Main text of a page by its host's wrapper."""
    tokens, texts, blocks = read_page(html)
    stream = fold(tokens)
    wrapper, rank, seen = _known(nodes)
    shape = " ".join(x.sym for x in stream)
    ranks = seen.get(shape)
    if ranks is None:
        if len(seen) >= HELD:
            seen.clear()
        ranks = seen[shape] = _ranks(wrapper, [x.copied() for x in stream], rank)
    best = max(ranks, default=0)
    if not best:
        return ""
    keep = [not t.strip() for t in texts]  # white space between kept words
    for slot, r in zip(_slots(stream), ranks, strict=True):
        if r == best:
            for i in slot.at:
                keep[i] = True
    out: list[str] = []
    held, at = [], None
    for text, block, wanted in zip(texts, blocks, keep, strict=True):
        if block != at:
            out.append("".join(held))
            held, at = [], block
        if wanted:
            held.append(text)
    out.append("".join(held))
    return " ".join(" ".join(out).split())


EXTRACTED = "page_id bigint, url string, text string"


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "html"):
        html, nodes = part.column("html").to_pylist(), part.column("nodes").to_pylist()
        texts = [main_text(h, w or "[]") if h else "" for h, w in zip(html, nodes, strict=True)]
        yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of every row of ``pages`` (page_id, url, html)."""
    keyed = spread(
        pages.select(
            F.col("page_id").cast("bigint").alias("page_id"),
            F.col("url").cast("string").alias("url"),
            F.col("html").cast("string").alias("html"),
        ),
        "page_id",
    )
    wrappers = stored(infer_wrappers(keyed), "wrappers").select("host", "nodes")
    met = keyed.withColumn("host", host_of(F.col("url"))).join(wrappers, "host", "left")
    return met.select("page_id", "url", "html", "nodes").mapInArrow(_texts, EXTRACTED)
