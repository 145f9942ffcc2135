"""Main-text extraction by wrappers inferred from pages of the same host.

A page is a stream of tokens: block elements opening and closing, and text. Pages
of a host whose outermost containers are the same share a template, and each
template has a wrapper, a union-free regular expression over such streams: tokens,
text slots, optional groups ``(...)?`` and repeated groups ``(...)+``. It is
learned from the different streams, repeats folded, of all its pages: it starts as
the most frequent one of those with the fewest fixed texts and is aligned with each
further one that it does not accept: equal tokens
stay, text becomes a slot, a stretch that only one side has becomes
optional, and a stretch that repeats what stands beside it becomes a repeated
group. Where pages agree on so little that an expression outgrows GROWTH of its
longest streams, what lies between its outermost optional groups becomes a free
stretch, any row of the tokens seen there. Texts on every page of a template, of two different pages at least and in an
article or main part of three, are the expression's fixed texts. Each page's stream is matched with the
expression: what its fixed texts take is the site's own, what slots and groups
take is content unless it stands in a part that names itself a menu, form, advert
and so on. A page that the expression does not accept loses the fixed texts at
their places; a page without a second one of its template, what any template of
its host has fixed. Where a site marks an article or main part, content is what
stands in it; otherwise it is everything else.

Fixed texts are counted over all pages. Streams of a template beyond SHAPES are
learned in parts, whose expressions are then aligned with each other.

Edge cases: null and empty html give an empty text; pages without url share one
wrapper; unclosed and misnested elements close where HTML closes them; repeated
rows are extracted alike; other columns are ignored. Pages are read whole, however
long: matching keeps a few states a token, aligning takes memory linear in length.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_within, materialize

PERIOD, OUTER, GROWTH, SHAPES = 12, 3, 4, 256
#: Cells of a comparison above which a pair of streams is halved first.
CELLS = 1 << 16
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)")
SPACES = re.compile(r"\s+")
#: Fixed values of HTML.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "noembed", "noframes", "template"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "nobr"}
ENDS_PARAGRAPH = {"address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "thead": {"tr"}, "tfoot": {"tr", "td", "th", "tbody"}}
#: Elements and words of class, id and role that name a part as not the article.
ASIDE = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "head", "nav", "footer", "aside", "form", "button", "select", "option", "menu", "dialog", "svg", "object", "canvas", "audio", "video"}
PARTS = set("nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar aside footer foot masthead ad ads adv advert adverts advertisement advertising banner promo promotion sponsor sponsored cookie cookies consent notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social comment comments commentlist reply replies respond discussion disqus related recommended recommendations widget widgets pagination pager toolbar skip search contentinfo complementary form".split())
#: Words that leave such a name what it is, and words that make it tell of something else.
NEUTRAL = set("top left right bottom upper lower site page main list box section area wrap wrapper container block inner outer primary secondary global user reader body item items content bar row col column text link links button buttons icon icons post posts article articles story stories news topics entry field input unit slot panel group mobile desktop sticky fixed".split())
TELLS_OF = {"has", "with", "without", "no", "not"}
FLOW = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "dl", "dt", "dd", "pre", "blockquote", "table", "thead", "tbody", "tfoot", "tr", "td", "th", "figure", "figcaption"}
HEADER_PARTS = {"header", "topbar", "pageheader", "siteheader"}


def _marks(attributes: str) -> set[str]:
    """Class names, ids and roles in lower case, their words joined by hyphens."""
    out: set[str] = set()
    for k, v in ATTRIBUTE.findall(attributes):
        if k.lower() in ("class", "id", "role"):
            for name in v.strip("\"'").split():
                out.add("-".join(x for x in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", name).lower()) if x))
    return {x for x in out if len(x) > 1}


@lru_cache(maxsize=4096)
def names_part(mark: str) -> bool:
    """Whether a class name, id or role names a part that is not the article.

    Its last word does, or one of its words beside such as only say where or what kind.
    """
    words = mark.split("-")
    if not TELLS_OF.isdisjoint(words):
        return False
    return words[-1] in PARTS or (not PARTS.isdisjoint(words) and PARTS.union(NEUTRAL).issuperset(words))


@lru_cache(maxsize=4096)
def names_header(mark: str) -> bool:
    words = mark.split("-")
    return TELLS_OF.isdisjoint(words) and (words[-1] in HEADER_PARTS or "".join(words) in HEADER_PARTS)


class Page:
    """Blocks of a page in order: place (open block elements), text, characters inside links."""

    def __init__(self, source: str):
        self.tokens: list[str] = []  # of the stream; text as "\0" + text
        self.blocks: list[tuple[str, str, int]] = []  # place, text, link characters
        self.stack: list[str] = []
        self.text: list[str] = []
        self.linked = self.in_link = 0
        at, n = 0, len(source)
        while at < n:
            m = TAG.search(source, at)
            if not m:
                self._add(source[at:])
                break
            self._add(source[at : m.start()])
            at = m.end()
            if m[0].startswith("<![CDATA["):
                continue
            name = (m[2] or "").lower()
            if not name:
                continue
            if m[1]:
                self._close(name)
            elif name in RAW:  # never shown as text, and no break in what stands around it
                end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(source, at)
                at = end.end() if end else n
            else:
                self._open(name, m[3] or "")
        self._flush()

    def _add(self, raw: str) -> None:
        if raw:
            text = entities.unescape(raw)
            self.text.append(text)
            if self.in_link:
                self.linked += len(text.strip())

    def _flush(self) -> None:
        text = SPACES.sub(" ", "".join(self.text)).strip()
        if text:
            self.blocks.append((" ".join(self.stack), text, self.linked))
            self.tokens.append("\0" + text)
        self.text, self.linked = [], 0

    def _pop(self, k: int) -> None:
        self._flush()
        for x in reversed(self.stack[k:]):
            self.tokens.append("/" + x)
        del self.stack[k:]

    def _open(self, name: str, attributes: str) -> None:
        if name == "br":
            self.text.append(" ")
            return
        if name in INLINE:
            self.in_link += name == "a"
            return
        self._flush()
        if name in ENDS_PARAGRAPH or name in SIBLINGS:
            ends = SIBLINGS.get(name, {"p"})
            for k in range(len(self.stack) - 1, -1, -1):
                top = self.stack[k].partition(".")[0]
                if top in ends:
                    self._pop(k)
                    break
                if top not in ENDS_PARAGRAPH - {"ul", "ol", "dl", "table"} and top not in SIBLINGS:
                    break
                if top in ("div", "article", "section", "main", "ul", "ol", "dl", "table", "td", "th", "body"):
                    break
        if name in VOID:
            return
        label = name + "".join("." + x for x in sorted(_marks(attributes)))
        self.tokens.append(label)
        self.stack.append(label)

    def _close(self, name: str) -> None:
        if name in INLINE:
            self.in_link = max(0, self.in_link - (name == "a"))
            return
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k].partition(".")[0] == name:
                self._pop(k)
                return
        self._flush()


@lru_cache(maxsize=4096)
def set_apart(place: str) -> bool:
    """Whether a place lies in a part that is not the article by its own name.

    What names body, main or an article of its own tells of the page, not of a
    part; a form around an article is the page's.
    """
    inside = False
    labels = place.split()
    for k, label in enumerate(labels):
        name, *marks = label.split(".")
        if name == "form" and any(marked(x) for x in labels[k + 1 :]):
            continue
        whole = name in ("html", "body", "main") or (name == "article" and not inside)
        if name in ASIDE or (not whole and any(map(names_part, marks))):
            return True
        if not inside and not whole and (name == "header" or any(map(names_header, marks))):
            return True
        inside |= name in ("article", "main")
    return False


def marked(place: str) -> bool:
    """Whether a place lies in what the page marks as its article."""
    return any(x.partition(".")[0] in ("article", "main") for x in place.split())


def least(place: str) -> int:
    """How many different pages must share a text for it to be the site's."""
    return 3 if marked(place) else 2


def _number(*parts: str) -> int:
    return int.from_bytes(blake2b("\0".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _key(place: str, text: str) -> int:
    """The number of a text at a place; odd where ``least`` asks for three pages, and never 0."""
    return (_number(place, text) | 2) & ~1 | marked(place)


def template(page: Page) -> str:
    """The outermost containers of a page's texts: what its pages share if they come of one template."""
    out = set()
    for place, _, _ in page.blocks:
        held = []
        for label in place.split()[:OUTER]:
            if label.partition(".")[0] in FLOW:
                break
            held.append(label)
        out.add(" ".join(held))
    return "|".join(sorted(out))


# expressions: lists of tokens, SLOT, ["?", expression], ["+", expression] and ["*", free tokens]; a fixed text is FIXED + text
SLOT, FIXED = "\0", "\1"
#: A text in the streams of ``facts``.
TEXT = "#"


def _shape(token) -> str:
    return json.dumps(token) if isinstance(token, list) else token[:1] if token[:1] == "\0" else token


def fold(stream: list) -> list:
    """Adjacent repeats of up to PERIOD items as repeated groups, their texts as slots."""
    out: list = []
    for token in stream:
        out.append(token)
        shrunk = True
        while shrunk:
            shrunk = False
            for p in range(1, PERIOD + 1):
                if len(out) > p and isinstance(out[-p - 1], list) and out[-p - 1][0] == "+":
                    body = out[-p - 1][1]
                    if len(body) == p and [_shape(x) for x in body] == [_shape(x) for x in out[-p:]]:
                        del out[-p:]
                        shrunk = True
                        break
                if p > 1 and len(out) >= 2 * p and [_shape(x) for x in out[-p:]] == [_shape(x) for x in out[-2 * p : -p]]:
                    body = [SLOT if _shape(x) == "\0" else x for x in out[-p:]]
                    del out[-2 * p :]
                    out.append(["+", body])
                    shrunk = True
                    break
    return out


def _merge(a, b):
    """Two items of one shape: text that differs becomes a slot."""
    return a if a == b else SLOT


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of ``a`` and each prefix of ``b``."""
    row = np.zeros(len(b) + 1, np.int64)
    for x in a:
        row[1:] = np.maximum(row[1:], row[:-1] + (b == x))
        np.maximum.accumulate(row, out=row)
    return row


def _opcodes(a: list, b: list) -> Iterator[tuple[bool, int, int, int, int]]:
    """Stretches (equal, from and to in a, from and to in b) of whole streams, in memory linear in their length.

    Equal ends are taken off; what is left is halved at a point of a longest
    common subsequence until the halves are small enough to be compared at once.
    """
    number: dict[str, int] = {}
    x, y = (np.array([number.setdefault(t, len(number)) for t in s], np.int64) for s in (a, b))
    found: list[tuple[int, int, int]] = []  # equal stretches: from in a, from in b, length
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        n = min(j - i, m - k)
        ends = np.flatnonzero(x[i : i + n] != y[k : k + n])
        head = int(ends[0]) if len(ends) else n
        found.append((i, k, head))
        i, k, n = i + head, k + head, n - head
        ends = np.flatnonzero(x[j - n : j][::-1] != y[m - n : m][::-1])
        tail = int(ends[0]) if len(ends) else n
        found.append((j - tail, m - tail, tail))
        j, m = j - tail, m - tail
        if i == j or k == m:
            continue
        if (j - i) * (m - k) <= CELLS or j - i == 1:
            found += [(i + p, k + q, size) for p, q, size in SequenceMatcher(None, a[i:j], b[k:m], autojunk=False).get_matching_blocks()]
            continue
        half = (i + j) // 2
        at = k + int(np.argmax(_common(x[i:half], y[k:m]) + _common(x[half:j][::-1], y[k:m][::-1])[::-1]))
        todo += [(half, j, at, m), (i, half, k, at)]
    i = k = 0
    for p, q, size in [*sorted(f for f in found if f[2]), (len(a), len(b), 0)]:
        if i < p or k < q:
            yield False, i, p, k, q
        if size:
            yield True, p, p + size, q, q + size
        i, k = p + size, q + size


def align(wrapper: list, stream: list) -> list:
    """The wrapper widened to accept the stream as well."""
    out: list = []
    left, right = [_shape(x) for x in wrapper], [_shape(x) for x in stream]
    for equal, a, b, c, d in _opcodes(left, right):
        if equal:
            out += [_merge(x, y) for x, y in zip(wrapper[a:b], stream[c:d])]
            continue
        for part in (wrapper[a:b], stream[c:d]):
            part = [x for x in part]
            if not part:
                continue
            before = out[-1] if out and isinstance(out[-1], list) and out[-1][0] == "+" else None
            if before and len(part) % len(before[1]) == 0 and [_shape(x) for x in part] == [_shape(x) for x in before[1]] * (len(part) // len(before[1])):
                continue  # more of the repeated group before it
            if len(part) == 1 and isinstance(part[0], list) and part[0][0] == "?":
                out.append(part[0])
            else:
                out.append(["?", part])
    return out


@lru_cache(maxsize=4096)
def _tokens(item: str) -> frozenset:
    """The tokens of an item as JSON."""
    out, todo = set(), [json.loads(item)]
    while todo:
        x = todo.pop()
        for y in x[1]:
            todo.append(y) if isinstance(y, list) else out.add(_shape(y))
    return frozenset(out)


def _size(items: list) -> int:
    return sum(1 + _size(x[1]) if isinstance(x, list) and x[0] != "*" else 1 for x in items)


def loosen(items: list) -> list:
    """An expression with a free stretch from its first to its last optional group or free stretch."""
    at = [k for k, x in enumerate(items) if isinstance(x, list) and x[0] != "+"]
    if not at:
        return items
    return [*items[: at[0]], ["*", sorted(_tokens(json.dumps(["*", items[at[0] : at[-1] + 1]])))], *items[at[-1] + 1 :]]


def learn(shapes: dict[str, int]) -> list:
    """The expression that accepts all of some folded streams or expressions, given as JSON with the number of their pages.

    Those with the fewest fixed texts come first, so that one more in a slot stays content.
    """
    out: list | None = None
    program, longest = [], 0
    for shape in sorted(shapes, key=lambda x: (x.count("\\u0001"), -shapes[x], x)):
        items = json.loads(shape)
        longest = max(longest, _size(items))
        if out is None:
            out = items
        else:
            if match(program, [_shape(x) for x in items]) is not None:
                continue
            out = align(out, items)
            if _size(out) > GROWTH * longest:
                out = loosen(out)
        program = _program(out, True)
    return out or []


def _stream(page: Page, fixed) -> list[str]:
    """The tokens of a page with its fixed texts told apart."""
    blocks = iter(page.blocks)
    out = []
    for t in page.tokens:
        if t[:1] == SLOT:
            place, text, _ = next(blocks)
            t = (FIXED if (place, text) in fixed else SLOT) + text
        out.append(t)
    return out


def _program(items: list, whole: bool = False) -> list:
    """An expression as tokens, sets of free tokens, and tuples of places to go on from.

    With ``whole`` a group also takes itself, as JSON, in one step.
    """
    out: list = []

    def add(items: list) -> None:
        for x in items:
            at = len(out)
            if not isinstance(x, list):
                out.append(x)
            elif x[0] == "*":
                out.extend([(at + 1, at + 3), frozenset(x[1]), (at,)])
            else:
                out.extend([None, json.dumps(x), None] if whole else [None])
                body = len(out)
                add(x[1])
                if x[0] == "+":
                    out.append((body, len(out) + 1))
                after = (body, len(out)) if x[0] == "+" else (len(out),)
                enter = (body,) if x[0] == "+" else (body, len(out))
                out[at] = (at + 1, *enter) if whole else enter
                if whole:
                    out[at + 2] = after

    add(items)
    return out


def match(program: list, stream: list[str]) -> list[bool] | None:
    """Whether each text of a stream is taken by a fixed text; None where the expression does not accept the stream.

    Of several ways the one with the fewest fixed texts in slots counts.
    """
    end = len(program)

    def reach(states: list) -> list:
        seen: set[int] = set()
        out = []
        for cost, at, taken in sorted(states, key=lambda x: x[0]):
            todo = [at]
            while todo:
                at = todo.pop()
                if at in seen:
                    continue
                seen.add(at)
                if at < end and isinstance(program[at], tuple):
                    todo += program[at][::-1]
                else:
                    out.append((cost, at, taken))
        return out

    states = reach([(0, 0, None)])
    for t in stream:
        kind, step = t[:1], []
        for cost, at, taken in states:
            if at == end:
                continue
            x = program[at]
            if isinstance(x, frozenset):
                slot, same = SLOT in x, t in x or (kind == "[" and _tokens(t) <= x)
            else:
                slot, same = x[:1] == SLOT, x == t
            if kind == SLOT:
                if slot:
                    step.append((cost, at + 1, (taken, False)))
            elif same:
                step.append((cost, at + 1, (taken, True) if kind == FIXED else taken))
            elif kind == FIXED and slot:
                step.append((cost + 1, at + 1, (taken, False)))
        if not step:
            return None
        states = reach(step)
    for _, at, taken in states:
        if at == end:
            out = []
            while taken:
                taken, one = taken
                out.append(one)
            return out[::-1]
    return None


def infer(pages: list[str], keys: set[int] | None = None) -> str:
    """The wrapper of pages, as JSON: expression, and fixed texts by place, which are those of ``keys`` if given."""
    parsed = list({tuple(p.blocks): p for p in (Page(p or "") for p in pages)}.values())
    seen: dict[tuple[str, str], int] = {}
    for p in parsed:
        for block in {(place, text) for place, text, _ in p.blocks}:
            seen[block] = seen.get(block, 0) + 1
    fixed = sorted(b for b, n in seen.items() if (n == len(parsed) >= least(b[0]) if keys is None else _key(*b) in keys))
    constant = set(fixed)
    streams = Counter(json.dumps(fold([_shape(t) for t in _stream(p, constant)])) for p in parsed) if fixed else {}  # without fixed texts all is slots
    return json.dumps({"expression": learn(streams), "fixed": fixed})


@lru_cache(maxsize=256)
def _loaded(wrapper: str) -> tuple[frozenset, list]:
    w = json.loads(wrapper)
    return frozenset(tuple(x) for x in w["fixed"]), _program(w["expression"])


def extract(source: str | None, wrapper: str | None) -> str:
    """The main text of a page: its blocks in order, joined by one space."""
    return _content(Page(source or ""), wrapper)


def _content(page: Page, wrapper: str | None) -> str:
    fixed, program = _loaded(wrapper) if wrapper else (frozenset(), [])
    site = [(place, text) in fixed for place, text, _ in page.blocks]
    if any(site):  # without, every text is a slot's
        site = match(program, _stream(page, fixed)) or site
    open_ = [(place, text, own) for (place, text, _), own in zip(page.blocks, site) if not set_apart(place)]
    inside = [(text, own) for place, text, own in open_ if marked(place)]
    if inside:  # an article of fixed texts alone is no less an article
        return " ".join([text for text, own in inside if not own] or [text for text, _ in inside])
    return " ".join(text for _, text, own in open_ if not own)


def host(column: str = "url"):
    return F.lower(F.coalesce(F.regexp_extract(column, r"^[a-zA-Z][\w+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1), F.lit("")))


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        number, same, streams, keys = [], [], [], []
        for name, source in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
            page = Page(source or "")
            number.append(_number(name, template(page)))
            same.append(_number(*(x for place, text, _ in page.blocks for x in (place, text))))
            streams.append(" ".join(TEXT if t[:1] == SLOT else t for t in page.tokens))
            keys.append([_key(place, text) for place, text, _ in page.blocks])
        columns = [pa.array(number, pa.int64()), pa.array(same, pa.int64()), pa.array(streams, pa.string()), pa.array(keys, pa.list_(pa.int64()))]
        yield pa.record_batch([batch.column("page_id"), batch.column("h"), batch.column("host"), *columns], names=["page_id", "h", "host", "template", "same", "stream", "keys"])


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Folded streams as JSON; a fixed text is FIXED + its key."""
    for batch in batches:
        out = []
        for stream, own in zip(batch.column("stream").to_pylist(), batch.column("own").to_pylist()):
            left = iter(own)
            out.append(json.dumps(fold([(f"{FIXED}{k}" if (k := next(left)) else SLOT) if t == TEXT else t for t in stream.split(" ")])))
        yield pa.record_batch([batch.column("template"), pa.array(out, pa.string()), batch.column("n")], names=["template", "shape", "n"])


def _learn_group(group: pa.Table) -> pa.Table:
    shapes: Counter[str] = Counter()
    for shape, n in zip(group.column("shape").to_pylist(), group.column("n").to_pylist()):
        shapes[shape] += n
    return pa.table([group.column("template").slice(0, 1), pa.array([json.dumps(learn(shapes))], pa.string()), pa.array([shapes.total()], pa.int64())], names=["template", "shape", "n"])


def _made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Wrappers from expressions and keys, whose texts any page of a template has."""
    for batch in batches:
        out = []
        for source, keys, shape in zip(*(batch.column(c).to_pylist() for c in ("html", "keys", "shape"))):
            of_key = {_key(place, text): (place, text) for place, text, _ in Page(source or "").blocks}
            named = lambda x: [named(y) for y in x] if isinstance(x, list) else FIXED + of_key[int(x[1:])][1] if x[:1] == FIXED else x
            out.append(json.dumps({"expression": named(json.loads(shape or "[]")), "fixed": sorted(of_key[k] for k in keys or ())}))
        yield pa.record_batch([batch.column("host"), batch.column("template"), pa.array(out, pa.string())], names=["host", "template", "wrapper"])


def _identified(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", "html", host().alias("host"), F.xxhash64("html").alias("h"))


def facts(pages: DataFrame) -> DataFrame:
    """(page_id, h, host, template, same, stream, keys) of every page; pages of the same blocks have the same ``same``."""
    rows = _identified(pages).select("page_id", "h", "host", "html").mapInArrow(_facts, "page_id long, h long, host string, template long, same long, stream string, keys array<long>")
    return materialize(rows, "facts")


def expressions(known: DataFrame, fixed: DataFrame) -> DataFrame:
    """(template, shape) with the expression, as JSON, that accepts every page of a template."""
    rows = "template long, shape string, n long"
    own = F.expr("transform(keys, k -> if(array_contains(constant, k), k, 0L))")
    constant = fixed.filter("size(keys) > 0").select("template", F.col("keys").alias("constant"))  # without fixed texts all is slots
    constant = broadcast_within(constant, F.lit(16) + 8 * F.size("constant"))
    streams = known.join(constant, "template").select("template", "stream", own.alias("own")).groupBy("template", "stream", "own").agg(F.count("*").alias("n"))
    shapes = materialize(streams.mapInArrow(_folded, rows).groupBy("template", "shape").agg(F.sum("n").alias("n")), "shapes")
    pieces = shapes.groupBy("template").agg(F.ceil(F.count("*") / SHAPES).alias("pieces"))
    shapes = shapes.join(broadcast_within(pieces, F.lit(16)), "template").withColumn("piece", F.pmod(F.xxhash64("shape"), "pieces"))
    learned = shapes.groupBy("template", "piece").applyInArrow(_learn_group, rows)
    return learned.groupBy("template").applyInArrow(_learn_group, rows).select("template", "shape")


def wrappers(pages: DataFrame, known: DataFrame) -> DataFrame:
    """(host, template, wrapper) of every template with two different pages."""
    each = known.select("template", "same", F.explode(F.concat(F.array(F.lit(0).cast("long")), F.array_distinct("keys"))).alias("key")).distinct()
    counted = materialize(each.groupBy("template", "key").agg(F.count("*").alias("n")).filter("n > 1"), "counted")
    totals = counted.filter("key = 0").select("template", F.col("n").alias("total"))
    on_all = counted.filter("key != 0").join(totals, "template").filter("n = total and n >= 2 + (key & 1)")
    fixed = materialize(totals.join(on_all.groupBy("template").agg(F.sort_array(F.collect_list("key")).alias("keys")), "template", "left"), "fixed")
    learned = materialize(expressions(known, fixed), "expressions")
    one = known.groupBy("template").agg(F.min(F.struct("page_id", "h", "host")).alias("one")).select("template", "one.*")  # any page has all fixed texts
    ids = materialize(fixed.select("template", "keys").join(one, "template").join(learned, "template", "left"), "expressions")
    ids = broadcast_within(ids, F.lit(64) + F.length("host") + F.coalesce(F.octet_length("shape"), F.lit(0)) + 8 * F.coalesce(F.greatest(F.size("keys"), F.lit(0)), F.lit(0)))
    held = _identified(pages)
    same_page = [held["page_id"].eqNullSafe(ids["page_id"]), held["h"].eqNullSafe(ids["h"]), held["host"] == ids["host"]]
    chosen = held.join(ids, same_page).select("template", held["host"], "html", "keys", "shape").dropDuplicates(["template"])
    return chosen.mapInArrow(_made, "host string, template long, wrapper string")


def extract_pages(pages: DataFrame, most: int = 32 << 20) -> DataFrame:
    """(page_id, url, text, n_chars) of every page. Wrappers of at most ``most`` bytes go to every worker; beyond that pages are joined."""
    spark = pages.sparkSession
    known = facts(pages)
    made = materialize(wrappers(pages, known), "wrappers")
    of_host = made.select("host", F.explode(F.from_json("wrapper", "fixed array<array<string>>")["fixed"]).alias("x")).groupBy("host").agg(F.collect_set("x").alias("fixed"))
    of_host = materialize(of_host.select("host", F.to_json(F.struct(F.expr("cast(array() as array<string>)").alias("expression"), "fixed")).alias("wrapper")), "hosts")
    size = lambda df: df.agg(F.sum(F.length("host") + F.octet_length("wrapper"))).first()[0] or 0
    schema = "page_id long, url string, text string, n_chars long"

    def made_batch(batch: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        return pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    if size(made) + size(of_host) <= most:
        own = spark.sparkContext.broadcast({r.template: r.wrapper for r in made.select("template", "wrapper").collect()})
        shared = spark.sparkContext.broadcast({r.host: r.wrapper for r in of_host.collect()})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = []
                for name, source in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
                    page = Page(source or "")
                    texts.append(_content(page, own.value.get(_number(name, template(page))) or shared.value.get(name)))
                yield made_batch(batch, texts)

        return _identified(pages).select("page_id", "url", "html", "host").mapInArrow(run, schema)

    def run_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield made_batch(batch, [extract(x, w) for x, w in zip(batch.column("html").to_pylist(), batch.column("wrapper").to_pylist())])

    # every page with its template's wrapper; (page_id, h, host) is one page's
    of_page = known.select("page_id", "h", "host", "template").distinct().join(made.select("template", F.col("wrapper").alias("own")), "template", "left").join(of_host, "host", "left")
    of_page = of_page.select(F.col("page_id").alias("p"), F.col("h").alias("q"), F.col("host").alias("r"), F.coalesce("own", "wrapper").alias("wrapper"))
    rows = _identified(pages)
    rows = rows.join(of_page, [rows["page_id"].eqNullSafe(of_page["p"]), rows["h"].eqNullSafe(of_page["q"]), rows["host"] == of_page["r"]], "left")
    return rows.select("page_id", "url", "html", "wrapper").mapInArrow(run_joined, schema)
