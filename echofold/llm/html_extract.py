"""Main text of HTML pages by a linear-chain conditional random field over DOM leaf blocks.

A page is read into leaf blocks: the text between two borders of block elements, with the chain of
elements around it. A block's features are its enclosing elements (tags, words of class and id, the
nearest landmark) and its text (length, links, punctuation, place). Two labels, article and other,
are decoded together by Viterbi with learned transitions. The field is trained by maximum likelihood
on labelled pages: ``label_pages`` composes pages of many layouts and marks the blocks of the article.

Reading is linear in the page but for a logarithm. Scripts, styles, comments, templates and the head have no blocks; the head ends where
the first text or element that cannot be in it begins, and a silent element that is never closed silences nothing. One that may hold its own
kind ends with its own end tag, as far as there are enough of them. Silent elements and comments within a block
leave it whole. Character references are decoded, white
space in a block becomes one space (a line break element counts as white space), blocks are joined by a
line feed. Inline elements do not part words.

Defined results: null or empty html gives the empty text; unclosed or stray tags are tolerated; pages of
any length are whole; repeated rows give repeated rows; extra columns are ignored.
"""

from __future__ import annotations

import html
import random
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..runtime import text_batches

# Kinds of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr input".split())
MATH = frozenset("math mrow mi mo mn ms mtext mspace mfrac msqrt mroot msup msub msubsup munder mover munderover mmultiscripts mstyle mpadded mphantom menclose mtable mtr mtd semantics".split())
SILENT = frozenset("script style template noscript title iframe object svg canvas audio video annotation annotation-xml".split())
NESTING = frozenset("template object svg audio video".split())  # those of them that may hold their own kind
CLOSES_P = frozenset("address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SAME_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table div section article body select".split())
LANDMARKS = "nav header footer aside form article main section dialog figure table button select".split()
OTHER_BLOCKS = "html body caption center col colgroup dd dt fieldset legend li listing option optgroup plaintext search summary tbody td textarea tfoot th thead tr xmp".split()
# Words of class and id attributes, by what they usually mark.
HINTS = {
    "ad": "ad ads adv advert adverts advertisement advertising banner promo promotion sponsor sponsored sponsors adsbygoogle".split(),
    "menu": "nav navbar navigation menu menus breadcrumb breadcrumbs topbar toolbar tabs pagination pager skip".split(),
    "head": "header head masthead logo branding sitehead top".split(),
    "foot": "footer foot bottom copyright colophon legal".split(),
    "side": "sidebar side aside widget widgets related recommended trending popular more rail".split(),
    "notice": "cookie cookies consent gdpr notice notices alert popup modal overlay banner warning message toast disclaimer".split(),
    "comment": "comment comments reply replies respond discussion disqus feedback commentlist thread".split(),
    "form": "form search login signup subscribe subscription newsletter register contact".split(),
    "share": "share sharing social follow tweet facebook".split(),
    "body": "content article post entry story text body main maincontent articlebody postbody entrycontent page".split(),
}
HINT_OF = {w: k for k, ws in HINTS.items() for w in ws}

# A tag: its name, then attributes, in whose quoted values a > may stand; and the same without heed of quotes.
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>")
NAMED = re.compile("/?[a-zA-Z]")
LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
MARKS = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
IN_HEAD = frozenset("title noscript".split())  # at the latest they end with the head
PARTS = re.compile(r"[a-z]+")


KNOWN = VOID | CLOSES_P | SCOPES | frozenset(LANDMARKS) | frozenset(OTHER_BLOCKS)
DEEPEST = 512  # nesting beyond this is flattened, as browsers do
LONG_NUMBER = re.compile(r"&#(?:[0-9]{8,}|[xX][0-9a-fA-F]{8,});?")
ZEROS = re.compile(r"&#([xX]?)0+(?=[0-9a-fA-F])")


class Chain(NamedTuple):
    """What is known of a block from the elements around it."""

    tags: frozenset[str] = frozenset()
    last: str = ""
    above: str = ""
    hints: frozenset[str] = frozenset()
    near: str = "none"  # the nearest landmark, or word of a class or id
    in_body: bool = False
    inside: frozenset[str] = frozenset()  # words and landmarks within the innermost holder of the article
    depth: int = 0


@lru_cache(maxsize=1 << 16)
def within(chain: Chain, tag: str, marks: tuple[str, ...]) -> Chain:
    """The chain of what is in an element that is in ``chain``."""
    landmark = tag in LANDMARKS and tag != "section"
    near = tag if landmark else marks[0] if marks else chain.near
    holds = tag in ("article", "main") or "body" in marks
    own = frozenset([*marks, *([tag] if tag in LANDMARKS else [])])
    held = holds or chain.in_body or not chain.tags.isdisjoint(("article", "main"))
    inside = own if holds else chain.inside | own if held else frozenset()
    return Chain(chain.tags | {tag}, tag, chain.last, chain.hints | frozenset(marks), near, chain.in_body or "body" in marks, inside, min(chain.depth + 1, 8))


def marks_of(attributes: str) -> tuple[str, ...]:
    """What the class, id, role and style of an element say, in order."""
    marks = []
    for name, value in MARKS.findall(attributes) if attributes else ():
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            marks.append("hidden")
        elif name in ("class", "id", "role"):
            value = re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()
            marks += sorted({HINT_OF[w] for w in PARTS.findall(value) if w in HINT_OF})
    return tuple(marks)


class Block:
    __slots__ = ("chain", "linked", "text")

    def __init__(self, chain: Chain, text: str, linked: int):
        self.chain, self.text, self.linked = chain, text, linked


class Tags:
    """(start, end, name, whether it closes, attributes) of a page's tags from ``at`` on, which may be moved
    ahead; comments and the like have no name.

    Linear in the page: a search for the end of a tag that finds none is made again for later tags only
    until such searches have cost some passes over the page, then quotes are not heeded any more.
    """

    def __init__(self, page: str):
        self.page, self.at, self.last, self.left = page, 0, page.rfind(">"), 4 * len(page)

    def __iter__(self) -> Iterator[tuple[int, int, str, bool, str]]:
        page, n = self.page, len(self.page)
        while (start := page.find("<", self.at)) >= 0:
            if page.startswith("<!--", start):
                end = page.find("-->", start + 2)
                self.at = n if end < 0 else end + 3
                yield start, self.at, "", False, ""
                continue
            if start > self.last:
                return
            found = TAG.match(page, start) if self.left > 0 else None
            if found is None and NAMED.match(page, start + 1):
                self.left -= n - start
                found = LOOSE_TAG.match(page, start)
            if found is not None:
                self.at = found.end()
                yield start, self.at, found[2].lower(), found[1] == "/", found[3]
            elif page[start + 1] in "!?/":
                self.at = page.find(">", start) + 1
                yield start, self.at, "", False, ""
            else:
                self.at = start + 1


def raw_end(page: str, tag: str, at: int) -> int:
    """Where a script or style that starts at ``at`` is over, its end tag included."""
    found = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
    return page.find(">", found.end()) + 1 or len(page) if found else len(page)


def decoded(text: str) -> str:
    """With character references as characters; numbers beyond Unicode as U+FFFD, however long."""
    if "&" not in text:
        return text
    return html.unescape(LONG_NUMBER.sub("\ufffd", ZEROS.sub(r"&#\1", text)) if "&#" in text else text)


def blocks(page: str) -> list[Block]:
    """Leaf blocks in page order, with what is known from the elements around them."""
    out: list[Block] = []
    stack: list[str] = []
    chains = [Chain()]
    opened: Counter[str] = Counter()
    parts: list[str] = []
    linked, in_link, silent, level, at = 0, 0, "", 0, 0
    ends_of: dict[str, list[int]] = {}

    def ends_left(tag: str) -> int:
        """How many end tags of an element are still to come."""
        if tag not in ends_of:
            ends_of[tag] = [m.start() for m in re.finditer(rf"</{tag}[\s/>]", page, re.I)]
        return len(ends_of[tag]) - bisect_left(ends_of[tag], at)

    def text_of(raw: str) -> None:
        nonlocal linked
        if raw:
            parts.append(decoded(raw))
            if in_link:
                linked += len(raw)

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(chains[-1], text, linked))
            parts.clear()
        linked = 0

    def drop(i: int) -> None:
        """The elements from place i on are over."""
        for tag in stack[i:]:
            opened[tag] -= 1
        del stack[i:], chains[i + 1 :]

    read = Tags(page)
    for start, end, tag, closing, attributes in read:
        if not silent:
            text_of(page[at:start])
        at = end
        if not tag:
            continue
        if tag in ("script", "style") and not closing:  # raw text: nothing in it is a tag
            read.at = at = raw_end(page, tag, at)
            continue
        if silent:
            if tag == silent and tag in NESTING:
                if closing:
                    level -= 1
                elif not attributes.endswith("/") and ends_left(tag) > level:
                    level += 1
                if level:
                    continue
            if closing and tag in (silent, "head") or tag == "body":
                if tag == silent or silent in IN_HEAD:
                    silent = ""
            if silent or closing or tag != "body":
                continue
        if tag in SILENT:
            if closing:
                continue
            if not attributes.endswith("/"):
                if ends_left(tag):
                    silent, level = tag, 1
                elif tag == "title":  # never closed: its text ends with the next tag
                    following = page.find("<", at)
                    at = len(page) if following < 0 else following
            continue
        if tag == "head":  # what has no text there is silent by itself; other text is the body's
            flush()
            continue
        if tag in INLINE or tag in MATH:
            if tag == "a":
                in_link = 0 if closing else 1
            elif tag in ("br", "mtd"):
                parts.append(" ")
            continue
        flush()
        in_link = 0
        if closing:
            if opened[tag]:
                drop(len(stack) - 1 - stack[::-1].index(tag))
            continue
        if tag in CLOSES_P and stack and stack[-1] == "p":
            drop(len(stack) - 1)
        ends = SAME_CLOSES.get(tag)
        if ends and any(opened[t] for t in ends):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i] in ends:
                    drop(i)
                    break
                if stack[i] in SCOPES:
                    break
        if tag not in VOID and len(stack) < DEEPEST:
            stack.append(tag)
            opened[tag] += 1
            chains.append(within(chains[-1], tag if tag in KNOWN else "other", marks_of(attributes)))
    if not silent:
        text_of(page[at:])
    flush()
    return out


def chain_features(chain: Chain) -> tuple[str, ...]:
    found = {f"in:{t}" for t in chain.tags} | {f"hint:{m}" for m in chain.hints} | {f"inside:{x}" for x in chain.inside}
    if chain.last:
        found |= {f"tag:{chain.last}", f"pair:{chain.above}>{chain.last}"}
    inner = "article" if "article" in chain.tags else "main" if "main" in chain.tags else "body" if chain.in_body else "none"
    found |= {f"near:{chain.near}", f"holder:{inner}", f"holder:{inner}&near:{chain.near}", f"depth:{chain.depth}"}
    return tuple(sorted(found))


def text_features(block: Block, place: float) -> list[str]:
    text = block.text
    n = len(text)
    out = ["len:" + ("1" if n < 20 else "2" if n < 60 else "3" if n < 150 else "4" if n < 400 else "5"), f"links:{min(3, int(4 * block.linked / n))}", f"place:{min(4, int(5 * place))}"]
    if text[-1] in ".!?…\"”»:":
        out.append("ends")
    if "©" in text or "copyright" in text[:40].lower():
        out.append("copyright")
    if n > 60 and block.linked * 4 < n:
        out.append("prose")
    return out


class Field:
    """A two-label chain: score(labels) = sum of unary[i] where labelled 1, plus transitions."""

    def __init__(self):
        self.weights: dict[str, float] = {}
        self.trans = [[0.0, 0.0], [0.0, 0.0]]
        self.cache: dict[tuple, float] = {}

    def unary(self, found: list[Block]) -> list[float]:
        n, w, cache = len(found), self.weights, self.cache
        out = []
        for i, b in enumerate(found):
            base = cache.get(b.chain)
            if base is None:
                if len(cache) > 50_000:
                    cache.clear()
                base = cache[b.chain] = sum(w.get(f, 0.0) for f in chain_features(b.chain))
            out.append(base + sum(w.get(f, 0.0) for f in text_features(b, i / n)))
        return out

    def decode(self, found: list[Block]) -> list[int]:
        """The best labelling (Viterbi)."""
        (t00, t01), (t10, t11) = self.trans
        s0 = s1 = 0.0
        back = []
        for i, u in enumerate(self.unary(found)):
            if i:
                f0, f1 = s1 + t10 > s0 + t00, s1 + t11 > s0 + t01
                s0, s1 = (s1 + t10 if f0 else s0 + t00), (s1 + t11 if f1 else s0 + t01) + u
                back.append((int(f0), int(f1)))
            else:
                s1 = u
        label = int(s1 > s0)
        labels = [label] if found else []
        for step in reversed(back):
            label = step[label]
            labels.append(label)
        return labels[::-1]


def fit(pages: list[tuple[list[Block], list[int]]], rounds: int = 120, rate: float = 0.3, decay: float = 1e-4) -> Field:
    """Maximum likelihood by Adam on the exact gradient (forward-backward over padded pages)."""
    names: dict[str, int] = {}
    rows, cols = [], []
    longest = max(len(b) for b, _ in pages)
    y = np.zeros((len(pages), longest), dtype=np.int64)
    mask = np.zeros((len(pages), longest), dtype=bool)
    for p, (found, labels) in enumerate(pages):
        y[p, : len(labels)], mask[p, : len(labels)] = labels, True
        for i, b in enumerate(found):
            for f in [*chain_features(b.chain), *text_features(b, i / len(found))]:
                rows.append(p * longest + i)
                cols.append(names.setdefault(f, len(names)))
    rows, cols = np.array(rows), np.array(cols)
    w, t = np.zeros(len(names)), np.zeros((2, 2))
    state = [np.zeros_like(x) for x in (w, w, t, t)]
    pair_mask = mask[:, 1:]
    real = np.array([[((y[:, :-1] == a) & (y[:, 1:] == b) & pair_mask).sum() for b in (0, 1)] for a in (0, 1)], dtype=float)
    for k in range(1, rounds + 1):
        u = np.bincount(rows, weights=w[cols], minlength=y.size).reshape(y.shape)
        alpha, beta = np.zeros((*y.shape, 2)), np.zeros((*y.shape, 2))
        alpha[:, 0, 1] = u[:, 0]
        for i in range(1, longest):
            step = np.logaddexp(alpha[:, i - 1, 0, None] + t[0], alpha[:, i - 1, 1, None] + t[1])
            step[:, 1] += u[:, i]
            alpha[:, i] = np.where(mask[:, i, None], step, alpha[:, i - 1])
        for i in range(longest - 2, -1, -1):
            ahead = beta[:, i + 1] + np.stack([np.zeros(len(y)), u[:, i + 1]], axis=1)
            step = np.logaddexp(t[:, 0] + ahead[:, :1], t[:, 1] + ahead[:, 1:])
            beta[:, i] = np.where(mask[:, i + 1, None], step, 0)
        z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
        one = np.exp(alpha[:, :, 1] + beta[:, :, 1] - z[:, None]) * mask
        gw = np.bincount(cols, weights=((y * mask) - one).ravel()[rows], minlength=len(w)) / len(y) - decay * w
        want = np.zeros((2, 2))
        for a in (0, 1):
            for b in (0, 1):
                want[a, b] = (np.exp(alpha[:, :-1, a] + t[a, b] + beta[:, 1:, b] + b * u[:, 1:] - z[:, None]) * pair_mask).sum()
        gt = (real - want) / len(y) - decay * t
        for x, g, m, v in ((w, gw, state[0], state[1]), (t, gt, state[2], state[3])):
            m *= 0.9
            m += 0.1 * g
            v *= 0.999
            v += 0.001 * g * g
            x += rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    field = Field()
    field.weights = {f: float(w[i]) for f, i in names.items()}
    field.trans = t.tolist()
    return field


class Composer:
    """Pages of many layouts with the article's blocks marked: a block's text starts with a marker."""

    SYLLABLES = "ka lo mi ren tas ul vor ne sha di gor pel qua zin ter om bal fe ru stin".split()

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, low: int, high: int, stop: str = "") -> str:
        return " ".join("".join(self.r.choices(self.SYLLABLES, k=self.r.randint(1, 4))) for _ in range(self.r.randint(low, high))).capitalize() + stop

    def one(self, *options: str) -> str:
        return self.r.choice(options)

    def maybe(self, chance: float, make) -> str:
        return make() if self.r.random() < chance else ""

    def links(self, low: int, high: int) -> str:
        return "".join(f'<li><a href="/{i}">{self.words(1, 3)}</a></li>' for i in range(self.r.randint(low, high)))

    def box(self, hint: str, inside: str, tags: tuple[str, ...] = ("div", "section", "div")) -> str:
        tag, word = self.one(*tags), self.one(*HINTS[hint])
        attribute = self.one("class", "id", "class")
        shape = self.one("{}", "site-{}", "{}-box", "main {}" if hint not in ("body",) else "{}", "{}_1").format(word)
        return f'<{tag} {attribute}="{shape}">{inside}</{tag}>'

    def prose(self, mark: str) -> str:
        r, kind = self.r, self.r.random()
        text = mark + self.words(*r.choice([(1, 3), (4, 15), (20, 60), (40, 90)]), self.one(".", ".", ".", "", "!", "?"))
        if r.random() < 0.2:
            text += f' <a href="#">{self.words(1, 3)}</a> {self.words(2, 8, ".")}'
        if r.random() < 0.2:
            text = text.replace(" ", " <b>", 1) + "</b>" if " " in text else text
        if kind < 0.68:
            return self.one(f"<p>{text}</p>", f"<p>{text}</p>", f"<p>{text}", f"<p><b>{text}<br>", f"<div>{text}</div>")
        if kind < 0.78:
            tag = self.one("h2", "h3", "h4")
            return f"<{tag}>{mark}{self.words(1, 8)}</{tag}>"
        if kind < 0.88:
            tag = self.one("ul", "ol")
            return f"<{tag}>" + "".join(f"<li>{mark}{self.words(1, 12, self.one('.', ''))}</li>" for _ in range(r.randint(1, 5))) + f"</{tag}>"
        if kind < 0.94:
            return f"<blockquote>{self.one(f'<p>{text}</p>', text)}</blockquote>"
        if kind < 0.97:
            return f"<figure><img src=x><figcaption>{mark}{self.words(3, 12)}</figcaption></figure>"
        return f"<table><tr><td>{mark}{self.words(1, 4)}</td><td>{mark}{self.words(1, 4)}</td></tr></table>"

    def other(self) -> str:
        """Text of the kind that is around articles."""
        return self.one(*[self.words(*x) + self.one(".", "", "") for x in ((1, 4), (3, 12), (10, 40))])

    def noise(self, inside: bool) -> str:
        r = self.r
        make = [
            lambda: self.box("ad", self.one(self.other(), f"<p>{self.other()}</p>", f'<a href="#">{self.other()}</a>'), ("div", "div", "aside", "section")),
            lambda: self.box("share", f"<ul>{self.links(2, 4)}</ul>"),
            lambda: self.box("side", f"<h3>{self.words(1, 3)}</h3><ul>{self.links(2, 6)}</ul>"),
            lambda: self.box("notice", f"<p>{self.other()}</p>" + self.maybe(0.5, lambda: f"<button>{self.words(1, 2)}</button>")),
            lambda: self.box("form", self.form(), ("div", "section")),
            self.form,
            lambda: f"<aside{self.one('', ' class=box')}>" + self.one(f"<p>{self.other()}</p>", f"<h3>{self.words(1, 3)}</h3><p>{self.other()}</p>", f"<ul>{self.links(2, 5)}</ul>") + "</aside>",
        ]
        return r.choice(make[:2] + make[3:] if inside else make)()

    def form(self) -> str:
        return f"<form><label>{self.words(1, 4)}</label><input name=x>" + self.maybe(0.4, lambda: f"<p>{self.other()}</p>") + self.maybe(0.3, lambda: f"<select><option>{self.words(1, 2)}<option>{self.words(1, 2)}</select>") + f"<button>{self.words(1, 2)}</button></form>"

    def comments(self) -> str:
        one = lambda: self.one(f"<p>{self.words(5, 60, '.')}</p>", f"<div>{self.words(1, 2)}</div><p>{self.words(5, 60, '.')}</p>", f"<h4>{self.words(1, 2)}</h4><p>{self.words(3, 30, '.')}</p><p>{self.words(3, 30, '.')}</p>")
        each = "".join(self.one(self.box("comment", one(), ("div", "article", "li")), f"<div>{one()}</div>", one()) for _ in range(self.r.randint(1, 6)))
        return self.box("comment", self.maybe(0.6, lambda: f"<h3>{self.words(1, 3)}</h3>") + self.one(each, f"<ul>{each}</ul>", each), ("div", "section", "section", "aside"))

    def page(self, mark: str = "\x01") -> str:
        r = self.r
        head = f"<!DOCTYPE html><html><head><meta charset=utf-8><title>{self.words(2, 8)}</title>" + self.maybe(0.6, lambda: "<style>p{margin:0}</style>") + self.maybe(0.6, lambda: '<script>var t="</p>";go(1);</script>') + "</head><body>"
        menu = lambda: self.one(f"<nav><ul>{self.links(3, 8)}</ul></nav>", self.box("menu", f"<ul>{self.links(3, 8)}</ul>"), f"<ul{self.one('', ' class=menu')}>{self.links(3, 8)}</ul>", f'<nav><a href="/">{self.words(1, 2)}</a> | <a href="/b">{self.words(1, 2)}</a></nav>')
        top = self.one("", f"<header>{self.one(self.words(1, 4), f'<h1>{self.words(1, 4)}</h1>', f'<p>{self.words(2, 10)}</p>')}{self.maybe(0.6, menu)}</header>", menu(), menu(), self.box("head", self.one(self.words(1, 4), f"<p>{self.words(2, 8)}</p>") + self.maybe(0.5, menu)))
        top += self.maybe(0.25, lambda: self.box("notice", self.one(self.other(), f"<p>{self.other()}</p>") + self.maybe(0.5, lambda: f"<button>{self.words(1, 2)}</button>")))
        top += self.maybe(0.1, lambda: f'<div hidden>{self.other()}</div>') + self.maybe(0.4, lambda: self.noise(False)) + self.maybe(0.3, lambda: "<!-- ad -->")
        title = lambda: f"<{(h := self.one('h1', 'h1', 'h1', 'h2'))}>{mark}{self.words(2, 12, self.one('', '.'))}</{h}>"
        body = self.one(title(), title(), f"<header>{title()}</header>", "")
        for _ in range(r.choice([1, 2, 4, 8, 14, 25])):
            body += self.prose(mark) + self.maybe(0.06, lambda: self.noise(True))
        body += self.maybe(0.1, lambda: self.box("share", f"<ul>{self.links(2, 4)}</ul>"))
        kind = r.random()
        inner_comments = self.maybe(0.12, self.comments)
        if kind < 0.45:
            body = f"<article{self.one('', ' class=post', ' id=story')}>{body}{inner_comments}</article>"
        elif kind < 0.6:
            body = f"<main>{self.one(body, f'<article>{body}</article>', f'<div>{body}</div>')}{inner_comments}</main>"
        elif kind < 0.85:
            body = self.box("body", self.one(body, f"<div>{body}</div>", f"<section>{body}</section>") + inner_comments)
        elif kind < 0.95:
            body = self.one(f"<div>{body}</div>", f"<section>{body}</section>", f"<div><div>{body}</div></div>")
        side = "".join(self.noise(False) for _ in range(r.choice([0, 0, 1, 2, 3])))
        tail = self.maybe(0.3, self.comments)
        foot = self.one(f"<footer>{self.one('&copy; ', '', '&copy; 2020 ')}{self.words(1, 12, self.one('.', ''))}</footer>", f"<footer><p>{self.words(3, 20, '.')}</p><ul>{self.links(2, 5)}</ul></footer>", self.box("foot", self.one(f"<p>&copy; {self.words(2, 10)}</p>", self.words(3, 15, "."))), "")
        return head + top + self.one(side + body, body + side, body) + tail + foot + "</body></html>"


def label_pages(n: int = 700, seed: int = 5) -> list[tuple[list[Block], list[int]]]:
    """Labelled pages: blocks, and 1 where a block is of the article."""
    out = []
    composer = Composer(seed)
    for _ in range(n):
        found = blocks(composer.page())
        labels = [int("\x01" in b.text) for b in found]
        for b in found:
            b.text = b.text.replace("\x01", "") or "x"
        out.append((found, labels))
    return out


def trained(n: int = 700, seed: int = 5) -> Field:
    return fit(label_pages(n, seed))


def main_text(field: Field, page: str | None) -> str:
    found = blocks(page or "")
    return "\n".join(b.text for b, label in zip(found, field.decode(found)) if label)


def extract(pages: DataFrame, field: Field) -> DataFrame:
    """page_id, url, text, n_chars for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(field, page.as_py()) for page in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    text_batches(pages.sparkSession)
    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars bigint")
