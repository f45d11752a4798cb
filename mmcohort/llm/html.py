"""Operator 3: main-text extraction by a tree-structured graphical model.

A page is parsed to its tree of elements. Each element is main text or not: its
tag, all its class, id and role words, its text and its links give a unary potential, and
each parent-child pair a potential by the kind of child. Sum-product messages
pass from the leaves up and from the root down and give every element's exact
marginal; the text of elements of marginal 0.5 and more is kept, in page order.
The weights are fitted by gradient ascent on the likelihood (observed less
expected counts, the latter from the same messages) of labelled pages that a
seeded generator writes: layouts with and without semantic tags, with menus,
adverts, notices, forms, sidebars, comments and unclosed tags.

Defined results: a null or empty html, or a page without main text, gives an
empty string; repeated rows get the same answer each; null keys are kept; an
empty table gives an empty result; other columns are ignored. Pages of any
length are parsed whole, in linear time, broken ones too: a tag without its
">" is text, a quote that never ends is none. Form controls and what they hold
are never main text, inside a form or not.
"""

from __future__ import annotations

import html as H
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of HTML: elements without content, elements whose content is no
# markup, inline elements, and which open elements a start tag closes.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q s samp small span strike "
    "strong sub sup time tt u var wbr".split()
)
BLOCKY = "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul"
CLOSES = {t: {"p"} for t in BLOCKY.split()} | {
    "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"},
    "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}, "body": {"head"},
    "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"},
}
SCOPE = set("html body table td th ul ol dl div article section aside main nav header footer form blockquote object button".split())
LIST_SCOPE = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"},
              "tbody": {"table"}, "tfoot": {"table"}, "option": {"select"}}
CONTROL = set("button datalist input label legend optgroup option select textarea".split())
OPEN = re.compile(r"<(?=[a-zA-Z/!?])")
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>")
QUOTED = re.compile(r"(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+")
PLAIN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
DEEPEST = 512  # what is nested deeper hangs on the element of that depth
ATTR = re.compile(r"""(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
LABEL = re.compile(r'data-main="([01])"')  # of the generator's pages
NAME = re.compile(r"[a-z]+|[A-Z][a-z]*")
FEATURES = 4096
SLOTS = 9  # features every element has, besides its class, id and role words
KINDS = 6  # of edges: to an inline child, an ordinary block, a list part, a sectioning element, metadata, a form control
SILENT = 5  # a form control says nothing about the element it stands in: no potential
LIST_PART = set("ul ol li dl dt dd table tbody thead tfoot tr td th".split())
EVIDENCE = 100.0  # of a form control against main text
META = set("head title meta link style script noscript template base".split())
SECTION = set("article aside div footer form header main nav section body".split())


@lru_cache(1 << 16)
def _feature(name: str) -> int:
    return zlib.crc32(name.encode()) % (FEATURES - 1) + 1


def _attr_features(attrs: str) -> tuple[int, ...]:
    """Feature numbers of all class, id and role words."""
    return _known_attrs(attrs) if len(attrs) < 512 else _known_attrs.__wrapped__(attrs)


@lru_cache(1 << 14)
def _known_attrs(attrs: str) -> tuple[int, ...]:
    out = [_feature("word " + w.lower()) for v in ATTR.findall(attrs) for w in NAME.findall(v.strip("\"'"))]
    return tuple(dict.fromkeys(out))


class Page:
    """The elements of a page in document order, and its text as it flows:
    (element, text) pairs, None where a block begins or ends."""

    __slots__ = ("tag", "attrs", "parent", "flow", "chars", "linked", "stops")

    def __init__(self, source: str):
        self.tag, self.attrs, self.parent = ["#root"], [""], [-1]
        self.flow: list = []
        self.chars, self.linked, self.stops = [0], [0], [0]
        stack, links = [0], 0
        open_: dict[str, list[int]] = {}  # tag -> places in the stack

        def close(to: int) -> None:
            nonlocal links
            while len(stack) > to:
                t = self.tag[stack.pop()]
                open_[t].pop()
                links -= t == "a"
                if t not in INLINE:
                    self.flow.append(None)

        at, n = 0, len(source)
        last, plain = source.rfind(">"), 0
        while at < n:
            m = OPEN.search(source, at)
            start = m.start() if m else n
            if m and start > last:  # no tag ends from here on
                start = source.find("<!--", start)
                start = n if start < 0 else start
            if start > at:
                self._text(stack[-1], source[at:start], links)
            if start == n:
                break
            if source.startswith("<!--", start):
                end = source.find("-->", start + 4)
                at = n if end < 0 else end + 3
                continue
            m = TAG.match(source, start) if start >= plain else None
            if m is None:
                if start >= plain:  # a quote that never ends: up to it, tags end at the first ">"
                    plain = QUOTED.match(source, start).end()
                m = PLAIN.match(source, start)
            if m is None:  # "<!", "<?" or "</" and no name
                at = source.find(">", start) + 1
                continue
            at = m.end()
            name, attrs = m[2].lower(), m[3]
            if m[1]:  # an end tag closes what it names, if that is open
                if open_.get(name):
                    close(open_[name][-1])
                continue
            shut = CLOSES.get(name)
            if shut and any(open_.get(t) for t in shut):
                wall = max((open_[t][-1] for t in LIST_SCOPE.get(name, SCOPE) if open_.get(t)), default=0)
                found = [places[i] for t in shut if (places := open_.get(t)) and (i := bisect_right(places, wall)) < len(places)]
                if found:
                    close(min(found))
            node = len(self.tag)
            self.tag.append(name)
            self.attrs.append(attrs)
            self.parent.append(stack[min(len(stack), DEEPEST) - 1])
            self.chars.append(0)
            self.linked.append(0)
            self.stops.append(0)
            if name not in INLINE:
                self.flow.append(None)
            elif name == "br":
                self.flow.append((stack[-1], " "))
            if name in VOID:  # a slash before ">" means nothing elsewhere
                continue
            if name in RAW:
                end = re.compile(f"</{re.escape(name)}[\\s/>]", re.I).search(source, at)
                if name not in ("script", "style"):
                    self._text(node, source[at : end.start() if end else n], links)
                at = end.start() if end else n
                stop = source.find(">", at)
                at = n if stop < 0 else stop + 1
                self.flow.append(None)
                continue
            open_.setdefault(name, []).append(len(stack))
            stack.append(node)
            links += name == "a"

    def _text(self, node: int, raw: str, links: int) -> None:
        if "&" in raw:
            raw = H.unescape(raw)
        self.flow.append((node, raw))
        size = len(raw) if not raw.isspace() else 0
        if size:
            self.chars[node] += size
            self.linked[node] += size if links else 0
            self.stops[node] += raw.count(".") + raw.count(",")

    def labels(self) -> np.ndarray:
        """Per element of a training page: 1 main text, 0 not, -1 left open."""
        return np.array([int(m[1]) if (m := LABEL.search(a)) else -1 for a in self.attrs], np.int8)

    def features(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per element: feature numbers, kind of edge to the parent, depth,
        number of words; and the words of all elements, any number each."""
        n = len(self.tag)
        total, linked, depth = self.chars[:], self.linked[:], [0] * n
        for i in range(n - 1, 0, -1):
            total[self.parent[i]] += total[i]
            linked[self.parent[i]] += linked[i]
        every = max(1, total[0])
        out = np.zeros((n, SLOTS), np.int32)
        kind, many, words = np.zeros(n, np.int8), np.zeros(n, np.int64), []
        seen = 0
        for i in range(n):
            t, p = self.tag[i], self.parent[i]
            if i:
                depth[i] = depth[p] + 1
            if self.attrs[i]:
                own_words = _attr_features(self.attrs[i])
                many[i] = len(own_words)
                words += own_words
            own, sub = self.chars[i], total[i]
            density = linked[i] * 4 // sub if sub else 5
            out[i] = [
                _feature("tag " + t),
                _feature(f"in {self.tag[p]} {t}" if i else "root"),
                _feature(f"own {min(12, own.bit_length())}"),
                _feature(f"sub {min(15, sub.bit_length())}"),
                _feature(f"links {density}"),
                _feature(f"stops {min(4, self.stops[i])} {t in INLINE}"),
                _feature(f"at {seen * 4 // every}"),
                _feature(f"text {min(own, 200) // 50} {density} {t in INLINE}"),
                _feature("bias"),
            ]
            kind[i] = SILENT if t in CONTROL else 0 if t in INLINE else 2 if t in LIST_PART else 3 if t in SECTION else 4 if t in META else 1
            seen += own
        return out, kind, np.array(depth), many, np.array(words, np.int32)

    def controls(self) -> np.ndarray:
        """Elements that are form controls or lie in one."""
        out = [False] * len(self.tag)
        for i in range(1, len(out)):
            out[i] = self.tag[i] in CONTROL or out[self.parent[i]]
        return np.array(out)

    def text(self, main: np.ndarray) -> str:
        blocks, part = [], []
        for x in self.flow:
            if x is None:
                if part and (s := " ".join("".join(part).split())):
                    blocks.append(s)
                part = []
            elif main[x[0]]:
                part.append(x[1])
        if part and (s := " ".join("".join(part).split())):
            blocks.append(s)
        return "\n\n".join(blocks)


class Forest:
    """Several pages as one forest, level by level, for the messages. Only
    pages of the generator are ``labelled``: elsewhere data-main has no meaning."""

    def __init__(self, pages: list[Page], labelled: bool = True):
        feats = [p.features() for p in pages]
        self.at = np.concatenate([[0], np.cumsum([len(p.tag) for p in pages])])
        self.feat, self.kind, depth, many, self.word = (np.concatenate(x) for x in zip(*feats))
        self.word_of = np.repeat(np.arange(len(many)), many)  # the element of each word
        self.control = np.concatenate([p.controls() for p in pages])
        if labelled:  # what the generator says of its controls is learnt as of any block
            self.kind, self.control = np.where(self.kind == SILENT, 1, self.kind), np.zeros(len(self.kind), bool)
        self.label = np.concatenate([p.labels() for p in pages]) if labelled else None
        self.parent = np.concatenate([np.array(p.parent) + a for p, a in zip(pages, self.at)])
        order = np.argsort(depth, kind="stable")
        edges = np.searchsorted(depth[order], np.arange(1, depth.max() + 2))
        self.levels = [order[a:b] for a, b in zip(edges, np.append(edges[1:], len(order))) if b > a]
        self.roots = order[: edges[0]] if len(edges) else order


class Model:
    """weight: of each feature, for main against not; edge[kind, parent, child]."""

    def __init__(self):
        self.weight = np.zeros(FEATURES)
        self.edge = np.zeros((KINDS, 2, 2))

    def messages(self, f: Forest):
        """(log beliefs up, messages to parents, log beliefs): sum-product."""
        n = len(f.kind)
        up, sent = np.zeros((n, 2)), np.zeros((n, 2))
        up[:, 1] = self.weight[f.feat].sum(1) + np.bincount(f.word_of, self.weight[f.word], n)
        up[f.control, 1] -= EVIDENCE
        for rows in reversed(f.levels):
            m = np.logaddexp(*(self.edge[f.kind[rows], :, c] + up[rows, c, None] for c in (0, 1)))
            sent[rows] = m - m.max(1, keepdims=True)
            np.add.at(up, f.parent[rows], sent[rows])
        belief = up.copy()
        for rows in f.levels:
            rest = belief[f.parent[rows]] - sent[rows]
            down = np.logaddexp(*(self.edge[f.kind[rows], p, :] + rest[:, p, None] for p in (0, 1)))
            belief[rows] = up[rows] + down
            belief[rows] -= belief[rows].max(1, keepdims=True)
        return up, sent, belief

    def marginals(self, f: Forest) -> np.ndarray:
        b = self.messages(f)[2]
        return 1 / (1 + np.exp(np.clip(b[:, 0] - b[:, 1], -700, 700)))

    def fit(self, f: Forest, rounds: int = 200, rate: float = 0.05, decay: float = 2e-3) -> Model:
        y = (f.label == 1).astype(float)
        child = np.concatenate(f.levels)
        par, kind = f.parent[child], f.kind[child]
        seen = np.zeros((KINDS, 2, 2))
        np.add.at(seen, (kind, y[par].astype(int), y[child].astype(int)), 1)
        mean = [np.zeros(FEATURES), np.zeros((KINDS, 2, 2))]
        square = [np.zeros(FEATURES), np.zeros((KINDS, 2, 2))]
        for k in range(1, rounds + 1):
            up, sent, belief = self.messages(f)
            p = 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -700, 700)))
            g = np.bincount(f.feat.ravel(), np.repeat(y - p, SLOTS), FEATURES)
            g += np.bincount(f.word, (y - p)[f.word_of], FEATURES)
            pair = (belief[par] - sent[child])[:, :, None] + self.edge[kind] + up[child][:, None, :]
            pair = np.exp(pair - pair.max((1, 2), keepdims=True))
            pair /= pair.sum((1, 2), keepdims=True)
            hope = np.zeros((KINDS, 2, 2))
            np.add.at(hope, kind, pair)
            for i, (theta, grad) in enumerate(((self.weight, g), (self.edge, seen - hope))):
                grad = grad / len(y) * 100 - decay * theta
                mean[i] = 0.9 * mean[i] + 0.1 * grad
                square[i] = 0.99 * square[i] + 0.01 * grad**2
                theta += rate * (mean[i] / (1 - 0.9**k)) / (np.sqrt(square[i] / (1 - 0.99**k)) + 1e-8)
        return self


SYLLABLES = "ba co du en fi ga ho in ja ke lo ma ne or pa qui ra se ti un ve wo xi yl zo ar el is ot um".split()


def labelled_page(rng: np.random.Generator) -> str:
    """A random page whose elements carry ``data-main``: 1 for main text."""
    pick = lambda *x: x[rng.integers(len(x))]
    some = lambda p: rng.random() < p

    def words(lo: int, hi: int) -> str:
        w = ["".join(rng.choice(SYLLABLES, rng.integers(1, 5))) for _ in range(rng.integers(lo, hi))]
        w = [x + pick("", "", "", "", "", "", ",", "") for x in w]
        return " ".join(w).capitalize()

    def text(lo: int, hi: int) -> str:
        return " ".join(words(4, 20) + "." for _ in range(rng.integers(lo, hi)))

    def el(tag: str, main: int, inner: str, *names: str, close: bool = True) -> str:
        name = pick(*names) if names else ""
        attr = f' {pick("class", "id")}="{name}"' if name else ""
        return f'<{tag}{attr} data-main="{main}">{inner}' + (f"</{tag}>" if close else "")

    def links(lo: int, hi: int, main: int = 0) -> str:
        items = [el("li", main, el("a", main, words(1, 4))) for _ in range(rng.integers(lo, hi))]
        return el(pick("ul", "ul", "ol"), main, "".join(items))

    def inline(main: int) -> str:
        s = text(1, 5)
        if some(0.3):
            w = s.split(" ")
            k = rng.integers(len(w))
            w[k] = el(pick("b", "i", "em", "strong", "span", "a", "code"), main, w[k])
            s = " ".join(w)
        return s

    def paragraph(main: int) -> str:
        r = rng.random()
        if r < 0.08:
            return el("p", main, el("b", main, text(1, 4) + "<br>", close=False), close=False)
        if r < 0.14:
            return el("p", main, inline(main), close=False)
        if r < 0.20:
            return el(pick("ul", "ol"), main, "".join(el("li", main, inline(main)) for _ in range(rng.integers(2, 5))))
        if r < 0.25:
            return el("blockquote", main, inline(main) if some(0.5) else el("p", main, inline(main)))
        if r < 0.29:
            return el("pre", main, words(3, 20))
        if r < 0.33:
            rows = "".join(el("tr", main, "".join(el("td", main, words(1, 4)) for _ in range(3))) for _ in range(3))
            return el("table", main, rows)
        if r < 0.36:
            return el("div", main, inline(main))
        return el("p", main, inline(main) if some(0.9) else words(1, 6))

    ad = lambda: el(pick("div", "div", "aside", "section", "ins"), 0, pick(text(1, 3), el("p", 0, text(1, 3)), el("a", 0, words(2, 8))),
                    "ad", "ads", "advert", "sponsored", "promo", "ad-banner", "advertisement", "adsbygoogle")
    notice = lambda: el("div", 0, pick(text(1, 3), el("p", 0, text(1, 3))) + el("button", 0, words(1, 3)),
                        "notice", "cookie-notice", "cookies", "alert", "banner", "consent", "popup")
    form = lambda: el("form", 0, el("label", 0, words(1, 5)) + '<input data-main="0">' + pick("", el("p", 0, text(1, 2)))
                      + el(pick("button", "select", "textarea"), 0, words(1, 3)), "", "search", "newsletter", "signup", "subscribe")
    share = lambda: el("div", 0, links(2, 5) if some(0.5) else " ".join(el("a", 0, words(1, 2)) for _ in range(3)),
                       "share", "social", "tags", "breadcrumb", "related", "pagination", "meta")

    def sidebar() -> str:
        parts = [pick(lambda: el("h3", 0, words(1, 4)) + links(3, 8), lambda: el("p", 0, text(1, 3)), form, ad)() for _ in range(rng.integers(1, 4))]
        return el(pick("aside", "div", "section"), 0, "".join(parts), "sidebar", "side", "widget", "related", "aside", "rail") if some(0.7) else el(
            "aside", 0, "".join(parts))

    def comments() -> str:
        own = lambda: el(pick("div", "li", "article"), 0, el(pick("span", "b", "h4"), 0, words(1, 3)) + el("p", 0, text(1, 4)), "comment", "reply", "comment-body")
        return el(pick("section", "div", "ol"), 0, el("h3", 0, words(1, 3)) + "".join(own() for _ in range(rng.integers(1, 6))) + (form() if some(0.4) else ""),
                  "comments", "comment-list", "discussion", "replies", "responses")

    body = [el("h1", 1, words(3, 12))] if some(0.9) else []
    for _ in range(rng.integers(1, 60 if some(0.05) else 12)):
        body.append(paragraph(1))
        if some(0.1):
            body.append(el(pick("h2", "h3"), 1, words(2, 8)))
        if some(0.08):
            body.append(pick(ad, share, form, notice, sidebar)())
    main = "".join(body)
    shell = rng.random()
    if shell < 0.5:
        main = el("article", 1, main, "", "", "post", "article", "story")
    elif shell < 0.65:
        main = el("main", 1, main, "", "content", "main")
    else:
        main = el(pick("div", "div", "section"), 1, main, "content", "post", "article", "entry", "story", "main", "article-body", "post-content", "text")
    if some(0.25):
        main += comments()
    if some(0.4):
        main = el(pick("div", "main", "section"), 1, main, "wrapper", "container", "page", "content", "main")
    if some(0.35):
        main = main + sidebar() if some(0.6) else sidebar() + main
    head = f'<title data-main="0">{words(1, 12)}</title><style>p{{margin:0}}</style><script>var t="</p>";</script>'
    top = []
    if some(0.75):
        nav = el("nav", 0, links(3, 9)) if some(0.7) else el("div", 0, links(3, 9), "nav", "menu", "navbar", "navigation")
        top.append(el(pick("header", "div"), 0, el(pick("a", "h2", "p", "span"), 0, words(1, 4)) + nav, "header", "masthead", "top") if some(0.4) else nav)
    for make, p in ((ad, 0.5), (notice, 0.25), (share, 0.15), (form, 0.15)):
        if some(p):
            top.append(make())
    foot = []
    for make, p in ((share, 0.15), (ad, 0.15), (notice, 0.1)):
        if some(p):
            foot.append(make())
    if some(0.8):
        foot.append(el("footer", 0, "&copy; " + words(2, 12) + pick("", ".", el("p", 0, text(1, 3)), links(2, 5))) if some(0.7) else el(
            "div", 0, el("p", 0, words(3, 12)) + pick("", links(2, 5)), "footer", "foot", "bottom", "copyright"))
    end = "" if some(0.1) else "</body></html>"
    return f'<!DOCTYPE html><html data-main="1"><head data-main="0">{head}</head><body data-main="1">{"".join(top)}<!-- x -->{main}{"".join(foot)}{end}'


@lru_cache(4)
def trained(pages: int = 400, seed: int = 3) -> Model:
    rng = np.random.default_rng(seed)
    made = [Page(labelled_page(rng)) for _ in range(pages)]
    f = Forest(made)
    f.label[f.roots] = 1
    # what the generator leaves open (br) has its parent's label
    for rows in f.levels:
        own = f.label[rows]
        f.label[rows] = np.where(own < 0, f.label[f.parent[rows]], own)
    return Model().fit(f)


def extract_many(sources: list[str], model: Model) -> list[str]:
    pages = [Page(s) for s in sources]
    if not pages:
        return []
    f = Forest(pages, labelled=False)
    main = model.marginals(f) >= 0.5
    return [p.text(main[a:b]) for p, a, b in zip(pages, f.at, f.at[1:])]


def extract(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", model: Model | None = None,
    group_chars: int = 1 << 22,
) -> DataFrame:
    """Per page: page_id, url, text (main text, "" for none), n_chars."""
    src = pages.select(
        F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").alias("html")
    )
    held = pages.sparkSession.sparkContext.broadcast(model or trained())  # FEATURES numbers
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in src.schema.fields[:2])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, group, size = [], [], 0
            for x in b.column(2):
                s = x.as_py() or ""
                group.append(s)
                size += len(s)
                if size > group_chars:
                    texts += extract_many(group, held.value)
                    group, size = [], 0
            texts += extract_many(group, held.value)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return src.mapInArrow(run, f"{kinds}, text string, n_chars long")
