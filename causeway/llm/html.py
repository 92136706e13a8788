"""Operator 1, main text of HTML pages: a linear-chain conditional random field.

A page is cut into its DOM leaf blocks, runs of text between the edges of block elements.
Each block has features of its ancestors (tags, and words of their class, id and role) and
of its text; the field's transitions tie neighbours together, and Viterbi decoding takes
the best labelling of the page as a whole.  What is never text on the screen (scripts,
styles, comments, the head, drawings, notes of formulas) makes no block.

The field is trained by maximum likelihood on labelled pages that ``labelled_pages`` draws
from templates of articles, menus, headers, footers, sidebars, notices, adverts, forms and
reader comments: a fixed, bounded set, the same on every driver.
"""

from __future__ import annotations

import random
import re
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm.common import table

#: A comment, a declaration, or the beginning of a tag.
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)", re.S)
#: The rest of a tag; quotes count only where a value begins.  What doesn't match has no end.
_REST = re.compile(r"""((?:=\s*+(?:"[^"]*"|'[^']*')|[^>])*+)>""")
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title iframe noscript noembed noframes xmp".split())
#: Hidden up to their balanced closing tag; those of the second set may close themselves.
_NESTED = frozenset("template object svg annotation annotation-xml".split())
_FOREIGN = frozenset("svg annotation annotation-xml".split())
#: HTML tags that end a drawing which isn't closed.
_BREAKOUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
#: These close themselves by a slash at their end.
_CLOSABLE = frozenset("math mi mn mo mrow ms mspace mtext msub msup mfrac msqrt mroot mtable mtr mtd none mprescripts".split())
#: Share of a page's words (but for links) that its core holds.
CORE = 0.6
_POINTS = frozenset("foreignobject desc title".split())
_IN_HEAD = frozenset("html head base basefont bgsound link meta noframes noscript script style template title".split())
#: An opening tag closes the nearest of these, unless one of the second set lies between.
_IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
    "optgroup": ({"optgroup"}, {"select"}),
    "tbody": ({"thead", "tbody", "tfoot"}, {"table"}),
}
_P_CLOSERS = _BLOCK - {"body", "html", "li", "td", "th", "tr", "option", "optgroup", "caption", "tbody", "thead", "tfoot", "legend"}
_HIDDEN = frozenset(("head", *_RAW, *_NESTED))


class Path:
    """The open elements at some place: those around the innermost one, and the features that it adds to theirs.

    Blocks of a page share paths, and a path's weight is found once, so pages of any depth take time in proportion.
    """

    __slots__ = ("new", "number", "of", "outer", "tag", "weight")

    def __init__(self, outer: Path | None = None, new: tuple[str, ...] = (), tag: str = "", number: int = 0):
        self.outer, self.new, self.tag, self.number, self.of, self.weight = outer, new, tag, number, None, (0.0, 0.0)

    def features(self) -> list[str]:
        out, p = [], self
        while p is not None:
            out += p.new
            p = p.outer
        return out

    def weighted(self, field: Field) -> tuple[float, float]:
        """What the features of all open elements add to each label."""
        below, p = [], self
        while p is not None and p.of is not field:
            below.append(p)
            p = p.outer
        a, b = p.weight if p is not None else (0.0, 0.0)
        for p in reversed(below):
            for f in p.new:
                x, y = field.weights.get(f, (0.0, 0.0))
                a, b = a + x, b + y
            p.of, p.weight = field, (a, b)
        return a, b


class Block:
    """A leaf block: its text, the elements around it, and how much of it is links."""

    __slots__ = ("linked", "path", "text")

    def __init__(self, text: str, path: Path, linked: int):
        self.text, self.path, self.linked = text, path, linked


def _after_raw(html: str, pos: int, name: str) -> int:
    close = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(html, pos)
    return close.end() if close else len(html)


def _tag(html: str, pos: int) -> tuple[int, int, str | None, bool, str] | None:
    """The next markup from ``pos`` on: its begin and end, lower-case name (None: a comment), whether it closes, attributes."""
    m = _TAG.search(html, pos)
    if not m:
        return None
    if m[2] is None:
        return m.start(), m.end(), None, False, ""
    rest = _REST.match(html, m.end())
    return m.start(), rest.end() if rest else len(html), m[2].lower(), bool(m[1]), rest[1] if rest else ""


def _after(html: str, begin: int, name: str) -> int:
    """Where what an opening tag of _NESTED hides ends; ``begin`` is behind the tag."""
    depth, points, pos = 1, 0, begin
    while m := _tag(html, pos):
        at, pos, tag, closes, attributes = m
        alone = attributes.endswith("/")
        if tag == name and not (alone and not closes and name in _FOREIGN):
            depth += -1 if closes else 1
            if not depth:
                return pos
        elif name == "svg" and tag in _POINTS:
            points += (-1 if closes else 1) if not alone else 0
        elif name == "svg" and not points and (tag in _BREAKOUT and not closes or closes and tag in _BLOCK):
            return at
        elif tag in ("script", "style") and not closes and not alone:
            pos = _after_raw(html, pos, tag)
    return begin if name == "object" else len(html)


class _Stack:
    """The open elements; finding the nearest of some names doesn't walk through the others."""

    def __init__(self):
        self.open: list[tuple[str, Path]] = []
        self.at: dict[str, list[int]] = {}
        self.root, self.made = Path(), 0
        self.active: set[str] = set()

    def push(self, name: str, features: tuple[str, ...]) -> None:
        new = tuple(f for f in dict.fromkeys(features) if f not in self.active)
        self.active.update(new)
        self.made += 1
        self.at.setdefault(name, []).append(len(self.open))
        self.open.append((name, Path(self.path(), new, name, self.made)))

    def nearest(self, names: set[str] | frozenset[str]) -> int:
        return max((at[-1] for n in names if (at := self.at.get(n))), default=-1)

    def pop(self, names: set[str] | frozenset[str], until: set[str] | frozenset[str] = frozenset()) -> None:
        """Closes the nearest of ``names`` and what is open in it, unless one of ``until`` is nearer."""
        k = self.nearest(names)
        if k < 0 or k < self.nearest(until):
            return
        for name, path in reversed(self.open[k:]):
            self.at[name].pop()
            self.active.difference_update(path.new)
        del self.open[k:]

    def path(self) -> Path:
        return self.open[-1][1] if self.open else self.root


def leaf_blocks(html: str) -> list[Block]:
    """The leaf blocks of a page in order, with decoded references and single spaces.

    A tag without an end hides the rest of the page, as in browsers.
    """
    out: list[Block] = []
    stack = _Stack()
    parts: list[str] = []
    linked = objects = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, stack.path(), linked))
            parts.clear()
        linked = 0

    pos, end = 0, len(html)
    hidden = False
    while pos < end:
        m = _tag(html, pos)
        text = html[pos : m[0] if m else end]
        if hidden and text.strip():
            hidden = False
        if text and not hidden:
            text = unescape(text) if "&" in text else text
            parts.append(text)
            if stack.at.get("a"):
                linked += len(text)
        if not m:
            break
        _, pos, name, closes, attributes = m
        if name is None:
            continue
        if closes:
            if name in ("head", "body", "html"):
                hidden = False
            if name in _BLOCK:
                flush()
            stack.pop({name}, frozenset() if name in ("html", "body") else {"body"})
            continue
        if hidden and name not in _IN_HEAD:
            hidden = False
        if name in _RAW:
            pos = _after_raw(html, pos, name)
            continue
        if name in _NESTED:
            if name == "object":
                # After one that is never closed, others aren't looked for.
                to = _after(html, pos, name) if not objects else pos
                objects, pos = to == pos, to
            elif not (name in _FOREIGN and attributes.endswith("/")):
                pos = _after(html, pos, name)
            continue
        if name == "head":
            hidden = True
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in _BLOCK:
            flush()
            if name in _P_CLOSERS:
                stack.pop({"p"}, {"table", "td", "th", "button"})
            if name in _IMPLIED:
                stack.pop(*_IMPLIED[name])
        if name in _VOID or name in _CLOSABLE and attributes.endswith("/"):
            continue
        fs = [f"in:{name}"]
        if attributes:
            fs += [f"{'c' if a[0].lower() != 'role' else 'r'}:{w}" for a in _ATTRIBUTE.findall(attributes) for w in _WORD.findall((a[1] or a[2] or a[3]).lower())]
        stack.push(name, tuple(fs))
    flush()
    return out


_SIGNS = re.compile(r"©|\(c\)|all rights reserved|copyright|cookie|newsletter|subscribe|log ?in|sign ?up|privacy|sponsor|advert|reply|share", re.I)
_LENGTHS = (1, 2, 4, 7, 12, 20, 40, 80)


def _around(blocks: list[Block]) -> set[Path]:
    """All elements around the blocks."""
    out: set[Path] = set()
    for b in blocks:
        p = b.path
        while p is not None and p not in out:
            out.add(p)
            p = p.outer
    return out


def _below_core(paths: list[Path], words: list[int]) -> list[str]:
    """How far below the core each block lies, up to 3, or '-' outside: the core is the innermost element with CORE of the page's words."""
    if not paths:
        return []
    inside: dict[Path, int] = {}
    for p, w in zip(paths, words, strict=True):
        inside[p] = inside.get(p, 0) + w
        while (p := p.outer) is not None and p not in inside:
            inside[p] = 0
    order = sorted(inside, key=lambda p: p.number)
    for p in reversed(order):
        if p.outer is not None:
            inside[p.outer] += inside[p]
    core = max((p for p in order if inside[p] >= CORE * sum(words)), key=lambda p: p.number)
    far: dict[Path, int] = {}
    for p in order:
        far[p] = 0 if p is core else min(3, far[p.outer] + 1) if p.outer is not None and far[p.outer] >= 0 else -1
    return ["-" if far[p] < 0 else str(far[p]) for p in paths]


def features(blocks: list[Block]) -> list[tuple[Path, list[str]]]:
    """Of each block: ancestors, place among the page's blocks, shape of the text and of its neighbours."""
    out = []
    shapes = []
    for b in blocks:
        words = b.text.count(" ") + 1
        shapes.append((words, sum(words > n for n in _LENGTHS), min(4, 4 * b.linked // max(1, len(b.text)))))
    total = max(1, sum(w for w, _, link in shapes if link < 2))
    # Where no element says which the main text is, its place does.
    unsaid = not any(p.tag in ("article", "main") for p in _around(blocks))
    core = unsaid and _below_core([b.path for b in blocks], [w if link < 2 else 0 for w, _, link in shapes])
    for k, b in enumerate(blocks):
        words, size, link = shapes[k]
        fs = [f"{side}:{x[1] // 2}:{x[2] // 2}" if x else f"{side}:-" for side, x in (("before", shapes[k - 1] if k else None), ("after", shapes[k + 1] if k + 1 < len(shapes) else None))]
        fs += [f"n:{size}", f"a:{link}", f"n:{size}a:{link}", f"share:{min(4, 8 * words // total)}", "." if b.text[-1] in ".!?…\"'”:" else "-.", "A" if b.text[:1].isupper() else "-A"]
        if core:
            fs += ["unsaid", f"core:{core[k]}", f"leaf:{b.path.tag}:core:{core[k]}"]
        if k < 2:
            fs.append("first")
        if k >= len(blocks) - 2:
            fs.append("last")
        if s := _SIGNS.search(b.text) if words < 40 else None:
            fs.append(f"w:{s[0].lower().replace(' ', '')}")
        if "|" in b.text or "·" in b.text:
            fs.append("bar")
        fs.append("bias")
        out.append((b.path, fs))
    return out


class Field:
    """A linear-chain field with two labels, 1 for main text."""

    def __init__(self, weights: dict[str, tuple[float, float]], trans: np.ndarray):
        self.weights = weights
        self.trans = trans.tolist()

    def decode(self, rows: list[tuple[Path, list[str]]]) -> list[int]:
        """The best labelling (Viterbi); of equal ones that with more zeros from the end."""
        if not rows:
            return []
        get, none = self.weights.get, (0.0, 0.0)
        (t00, t01), (t10, t11) = self.trans
        s0 = s1 = 0.0
        back = []
        for k, (path, fs) in enumerate(rows):
            e0, e1 = path.weighted(self)
            for f in fs:
                a, b = get(f, none)
                e0 += a
                e1 += b
            if k:
                from0, from1 = s0 + t00 < s1 + t10, s0 + t01 < s1 + t11
                s0, s1 = (s1 + t10 if from0 else s0 + t00) + e0, (s1 + t11 if from1 else s0 + t01) + e1
                back.append((from0, from1))
            else:
                s0, s1 = e0, e1
        y = [int(s1 > s0)]
        for b in reversed(back):
            y.append(int(b[y[-1]]))
        return y[::-1]


def train(pages: list[tuple[list[list[str]], list[int]]], steps: int = 150, rate: float = 0.15, decay: float = 1e-3) -> Field:
    """Maximum likelihood by Adam over all pages at once; forward-backward in logs, padded to the longest page."""
    pages = [p for p in pages if p[1]]
    names = sorted({f for rows, _ in pages for r in rows for f in r})
    at = {f: i for i, f in enumerate(names)}
    n, longest = len(pages), max(len(y) for _, y in pages)
    block, feature = [], []
    mask, y = np.zeros((n, longest), bool), np.zeros((n, longest), int)
    for i, (rows, labels) in enumerate(pages):
        mask[i, : len(labels)], y[i, : len(labels)] = True, labels
        for k, r in enumerate(rows):
            block += [i * longest + k] * len(r)
            feature += [at[f] for f in r]
    block, feature = np.array(block), np.array(feature)
    gold = np.zeros((len(names), 2))
    np.add.at(gold, (feature, y.ravel()[block]), 1)
    pairs = mask[:, 1:]
    gold_t = np.zeros((2, 2))
    np.add.at(gold_t, (y[:, :-1][pairs], y[:, 1:][pairs]), 1)
    w = np.zeros(2 * len(names) + 4)
    m1, m2 = np.zeros_like(w), np.zeros_like(w)
    blocks = mask.sum()
    for step in range(1, steps + 1):
        weights, trans = w[:-4].reshape(-1, 2), w[-4:].reshape(2, 2)
        e = np.stack([np.bincount(block, weights[feature, c], n * longest) for c in (0, 1)], axis=1).reshape(n, longest, 2)
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[:, 0] = e[:, 0]
        for k in range(1, longest):
            v = np.logaddexp(alpha[:, k - 1, 0, None] + trans[0], alpha[:, k - 1, 1, None] + trans[1]) + e[:, k]
            alpha[:, k] = np.where(mask[:, k, None], v, alpha[:, k - 1])
        for k in range(longest - 2, -1, -1):
            v = e[:, k + 1] + beta[:, k + 1]
            v = np.logaddexp(trans[:, 0] + v[:, 0, None], trans[:, 1] + v[:, 1, None])
            beta[:, k] = np.where(mask[:, k + 1, None], v, 0)
        z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
        p = np.exp(alpha + beta - z[:, None, None]) * mask[..., None]
        expected = np.stack([np.bincount(feature, p[..., c].ravel()[block], len(names)) for c in (0, 1)], axis=1)
        q = np.exp(alpha[:, :-1, :, None] + trans + (e + beta)[:, 1:, None, :] - z[:, None, None, None]) * pairs[..., None, None]
        g = np.concatenate([(gold - expected).ravel(), (gold_t - q.sum(axis=(0, 1))).ravel()]) / blocks - decay * w / 10
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        w += rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
    return Field(dict(zip(names, map(tuple, w[:-4].reshape(-1, 2).tolist()), strict=True)), w[-4:].reshape(2, 2))


# Labelled pages -------------------------------------------------------------------------

_SYLLABLES = "an ber cor de el fi gra hu in jo ka lo mi nu or pa que ri so ta un vi wo xe ya zu st th qu ent ion er ung ado".split()


class _Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.labels: dict[str, int] = {}

    def words(self, low: int, high: int, title: bool = False) -> str:
        r = self.r
        out = ["".join(r.choices(_SYLLABLES, k=r.randint(1, 4))) for _ in range(r.randint(low, high))]
        return " ".join(w.capitalize() if title or not i else w for i, w in enumerate(out))

    def sentences(self, low: int, high: int) -> str:
        return " ".join(self.words(2, 18) + self.r.choice("...!?") for _ in range(self.r.randint(low, high)))

    def leaf(self, text: str, label: int) -> str:
        while self.labels.setdefault(" ".join(text.split()), label) != label:
            text += " " + self.words(1, 1)  # equal texts have one label
        return text

    def items(self, tag: str, n: int, label: int, link: bool = True, low: int = 1, high: int = 3) -> str:
        row = lambda t: f'<a href="/{self.r.randint(1, 99)}">{t}</a>' if link else t
        return "".join(f"<{tag}>{row(self.leaf(self.words(low, high, self.r.random() < 0.5), label))}</{tag}>" for _ in range(n))

    def box(self, tags: str, names: str, body: str) -> str:
        tag, name = self.r.choice(tags.split()), self.r.choice(names.split())
        mark = self.r.choice((f' class="{name}"', f' id="{name}"', f' class="x {name} y"')) if name != "-" else ""
        return f"<{tag}{mark}>{body}</{tag}>"

    def prose(self, label: int, low: int, high: int) -> str:
        r, out = self.r, []
        for _ in range(r.randint(low, high)):
            kind = r.random()
            if kind < 0.72:
                text = self.leaf(self.sentences(1, 6), label)
                if r.random() < 0.25:
                    a, b = text[: len(text) // 2], text[len(text) // 2 :]
                    text = f"{a}<{t}>{b}</{t}>" if (t := r.choice(("b", "em", 'a href="/x"'))) != 'a href="/x"' else f"{a}<{t}>{b}</a>"
                out.append(f"<p>{text}</p>" if r.random() < 0.85 else f"<p>{text}")
            elif kind < 0.82:
                t = r.choice(("h2", "h3"))
                out.append(f"<{t}>{self.leaf(self.words(1, 7), label)}</{t}>")
            elif kind < 0.88:
                t = r.choice(("ul", "ol"))
                out.append(f"<{t}>{self.items('li', r.randint(2, 5), label, False, 2, 14)}</{t}>")
            elif kind < 0.93:
                out.append(f"<blockquote>{self.leaf(self.sentences(1, 2), label)}</blockquote>")
            elif kind < 0.96:
                out.append(f"<pre>{self.leaf(self.words(3, 12), label)}</pre>")
            else:
                out.append(f"<table><tr>{self.items('td', r.randint(2, 4), label, False)}</tr></table>")
        return "".join(out)

    def page(self) -> str:
        r = self.r
        maybe = lambda p, f: f() if r.random() < p else ""
        menu = lambda: self.box("nav nav div ul", "menu nav navigation navbar main-menu breadcrumb -" if r.random() < 0.9 else "links", f"<ul>{self.items('li', r.randint(3, 9), 0)}</ul>")
        menu_nav = lambda: f"<nav><ul>{self.items('li', r.randint(3, 9), 0)}</ul></nav>"
        header = lambda: self.box("header header div", "header masthead site-header banner top", f"<h{(h := r.choice('123'))}>{self.leaf(self.words(1, 4, True), 0)}</h{h}>" + maybe(0.6, lambda: f"<p>{self.leaf(self.sentences(1, 1), 0)}</p>") + maybe(0.4, menu_nav))
        ad = lambda: self.box("div aside section ins", "ad ads advert advertisement promo sponsored banner-ad adbox", r.choice((self.leaf(self.sentences(1, 3), 0), f"<p>{self.leaf(self.sentences(1, 2), 0)}</p>", f'<a href="/b">{self.leaf(self.words(2, 9), 0)}</a>')))
        notice = lambda: self.box("div section aside", "notice cookie cookie-banner alert consent gdpr warning popup", f"<p>{self.leaf(self.sentences(1, 2), 0)}</p>" + maybe(0.5, lambda: f"<button>{self.leaf(self.words(1, 2), 0)}</button>"))
        form = lambda: f'<form action="/s">{self.leaf_p(0)}<label>{self.leaf(self.words(1, 3), 0)}</label><input name="q"><select>{self.items("option", 3, 0, False)}</select><div><button>{self.leaf(self.words(1, 2), 0)}</button></div></form>'
        side = lambda: self.box("aside aside div section", "sidebar side widget related rail recommended", f"<h3>{self.leaf(self.words(1, 3), 0)}</h3>" + r.choice((f"<ul>{self.items('li', r.randint(2, 7), 0, True, 2, 9)}</ul>", f"<p>{self.leaf(self.sentences(1, 3), 0)}</p>", f"<p>{self.leaf(self.sentences(1, 3), 0)}</p><p>{self.leaf(self.sentences(1, 2), 0)}</p>")))
        one = lambda: r.choice(("li", "div", "article", "p"))
        reply = lambda t: f'<{t} class="comment">' + maybe(0.6, lambda: f'<div class="author">{self.leaf(self.words(1, 2, True), 0)}</div>') + (f"<p>{self.leaf(self.sentences(1, 4), 0)}</p>" if t != "p" else self.leaf(self.sentences(1, 4), 0)) + f"</{t}>"
        comments = lambda: self.box("section div ol", "comments comment-list reader-comments responses discussion", maybe(0.7, lambda: f"<h2>{self.leaf(self.words(1, 3), 0)}</h2>") + "".join(reply(one()) for _ in range(r.randint(1, 5))) + maybe(0.3, form))
        year = r.randint(1990, 2030)
        footer = lambda: self.box("footer footer footer div", "footer site-footer bottom copyright -", r.choice((self.leaf(f"© {year} {self.words(1, 3)} · {self.sentences(1, 2)}", 0), f"<p>{self.leaf(self.sentences(1, 2), 0)}</p><ul>{self.items('li', r.randint(2, 5), 0)}</ul>", f"<p>© {self.leaf(f'{self.words(1, 3)} {year}', 0)}</p>")))
        share = lambda: self.box("div ul", "share social tags pagination", self.items("li", r.randint(2, 4), 0))
        head = lambda: (f"<header><h1>{t}</h1></header>" if r.random() < 0.25 else f"<h1>{t}</h1>") if (t := self.leaf(self.words(1, 12), 1)) else ""
        inner = maybe(0.85, head) + self.prose(1, 1, 12) + maybe(0.15, ad) + maybe(0.3, lambda: self.prose(1, 1, 4)) + maybe(0.15, share) + maybe(0.05, comments)
        kind = r.random()
        if kind < 0.35:
            main = f"<article>{inner}</article>"
        elif kind < 0.45:
            main = f"<main>{inner}</main>"
        elif kind < 0.55:
            main = f"<main><article>{inner}</article></main>"
        elif kind < 0.7:
            main = self.box("div div section td", "content main article post entry article-body story text", inner)
        elif kind < 0.85:
            main = f"<div>{inner}</div>"
        elif kind < 0.95:
            main = self.box("div div section td", "".join(r.choices(_SYLLABLES, k=2)) + " col row", inner)
        else:
            main = inner
        body = maybe(0.3, notice) + maybe(0.4, header) + maybe(0.75, menu) + maybe(0.3, ad) + maybe(0.15, form) + maybe(0.2, side) + main + maybe(0.2, ad) + maybe(0.35, comments) + maybe(0.3, side) + maybe(0.15, form) + maybe(0.8, footer) + maybe(0.1, notice)
        if r.random() < 0.25:
            body = r.choice((main, f"<div>{self.prose(1, 1, 3)}</div>"))  # nothing around it
        if r.random() < 0.3:
            body = f'<div class="{r.choice(("wrapper", "page", "container", "site", "x"))}">{body}</div>'
        if r.random() < 0.3:  # without marks, and some without elements that say what they hold
            body = _ATTRIBUTE.sub("", body)
            if r.random() < 0.6:
                body = re.sub(r"<(/?)(?:article|main)\b", r"<\1div", body)
        return f"<html><head><title>{self.words(1, 5)}</title></head><body>{body}</body></html>"

    def leaf_p(self, label: int) -> str:
        return f"<p>{self.leaf(self.words(2, 8), label)}</p>" if self.r.random() < 0.5 else ""


def labelled_pages(n: int, seed: int = 0) -> list[tuple[list[Block], list[int]]]:
    """Pages of the templates as blocks and their labels, 1 for main text."""
    out, maker = [], _Maker(seed)
    for _ in range(n):
        maker.labels.clear()
        blocks = leaf_blocks(maker.page())
        out.append((blocks, [maker.labels.get(b.text, maker.labels.get(b.text.removeprefix("© "), 0)) for b in blocks]))
    return out


@lru_cache(maxsize=2)
def trained_field(n: int = 1000, seed: int = 0) -> Field:
    return train([([path.features() + fs for path, fs in features(b)], y) for b, y in labelled_pages(n, seed)])


def extract(html: str, field: Field) -> str:
    blocks = leaf_blocks(html)
    return "\n".join(b.text for b, y in zip(blocks, field.decode(features(blocks)), strict=True) if y)


def main_text(html: Column, field: Field | None = None) -> Column:
    """The main text of each page, its blocks joined by one newline; null and empty pages give ''.

    A page of any length or depth takes time in proportion; repeated pages have equal texts; an
    empty table gives no rows.
    """
    field = field or trained_field()

    def text(pages: pa.Array) -> pa.Array:
        return pa.array([extract(p.as_py() or "", field) for p in pages], pa.string())

    return F.arrow_udf(text, "string")(html)


def extract_pages(df: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """``df`` with the main text in column ``out``, which replaces one of that name; other columns stay."""
    return df.withColumn(out, main_text(F.col(html)))


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page of ``pages``."""
    pages = extract_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
