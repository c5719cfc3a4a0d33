"""Main-text extraction: a bidirectional LSTM in numpy labels every block of a page.

A page is read into leaf blocks in order: runs of text between block-level tags, with their tag path (names, classes,
ids). Script, style and other non-text elements hold no blocks; an end tag of head may be left out, an open svg ends at the
next tag of the page itself, and an open object or template ends with its parent. Each block becomes a vector: hashed tag-path parts,
hashed words, and a few numbers (length, links, place). A bidirectional LSTM reads all vectors of a page, so each block
is judged with the whole document as context; blocks that it labels as main text are joined.

The network is trained on pages made here by rule (``training_pages``), with menus, adverts, sidebars, notices, forms,
legal lines and comments around articles of paragraphs, lists, tables, terms, figures and code, whose labels are known; fitting is deterministic, takes seconds, and depends on no table.

Defined cases: null or empty html gives an empty text; tags are read as the HTML standard reads them, so a tag, comment or
quoted value that is never closed reaches to the end of the page; a page of plain text without tags is one block; nested depth and length are not limited; repeated rows are extracted each; other columns
are ignored; null ids stay null.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm.common import parts, table

#: Elements that end a block, elements without text of the page, elements that never have an end tag.
BLOCKS = frozenset("address article aside blockquote body canvas center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
SILENT = frozenset("script style noscript template iframe object svg math head title textarea".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe".split())
#: Elements that may stand in head: any other start tag ends it, as its end tag may be left out.
HEAD = frozenset("meta link base basefont bgsound noframes title style script noscript template head html".split())
#: Start tags that end svg and math, except inside foreignObject, as browsers do.
BREAKING = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 hr i img li listing menu meta nobr ol p pre ruby s small span strike strong sub sup table tt u ul var".split())
#: An attribute as the HTML standard reads it: a quote only opens a value directly after the equals sign.
_ATTRIBUTE = r"""[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s>"'][^\s>]*+|(?=>)|\Z))?+"""
_TAG = re.compile(rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<(?:[!?]|/(?![a-zA-Z]))[^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|{_ATTRIBUTE})*+)(?:>|\Z)", re.S)
_NAMED = re.compile(r"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*)"?|'([^']*)'?|([^\s>"'][^\s>]*)))?+""")
_WORD = re.compile(r"[^\W_]+")

PATH, WORDS, NUMBERS, HIDDEN = 96, 32, 8, 12
WIDTH = PATH + WORDS + NUMBERS



class _Slots(dict):
    """The hashed place of each word or path part seen so far; begun anew when there are too many."""

    def __init__(self, size: int, salt: int):
        self.size, self.salt = size, salt

    def __missing__(self, text: str) -> int:
        if len(self) > 1 << 17:
            self.clear()
        self[text] = zlib.crc32(text.encode("utf-8", "replace"), self.salt) % self.size
        return self[text]


_PART_SLOTS, _WORD_SLOTS = _Slots(PATH, 1), _Slots(WORDS, 2)
_RAW_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*+(?:>|\Z)", re.I) for name in sorted(RAW)}
_PARTS: dict[tuple[str, str], tuple[str, ...]] = {}


def _path_parts(name: str, attributes: str) -> tuple[str, ...]:
    """A tag's name and the words of its class, id and role."""
    key = (name, attributes)
    if key not in _PARTS:
        if len(_PARTS) > 1 << 15:
            _PARTS.clear()
        parts, seen = [name], set()
        for attribute, *values in _NAMED.findall(attributes):
            attribute = attribute.lower()
            if attribute in ("class", "id", "role") and attribute not in seen:
                seen.add(attribute)
                parts += [f"@{w}" for w in _WORD.findall("".join(values).lower())]
        _PARTS[key] = tuple(parts)
    return _PARTS[key]


@dataclass
class Leaf:
    """A block: its text, how much of it is in links, and its tag path: hashed places, distinct parts, last part."""

    text: str
    linked: int
    slots: np.ndarray
    parts: int
    last: str


class _Stack:
    """Open elements, with counts of what is on the path, so neither a tag nor a block costs more where it is deep."""

    def __init__(self) -> None:
        self.names: list[str] = []
        self.own: list[tuple[str, ...]] = []
        self.open: dict[str, int] = {}
        self.parts: dict[str, int] = {}
        self.slots = np.zeros(PATH, np.int32)
        self.silent = 0

    def push(self, name: str, parts: tuple[str, ...]) -> None:
        self.names.append(name)
        self.own.append(parts)
        self.open[name] = self.open.get(name, 0) + 1
        self.silent += name in SILENT
        for part in parts:
            self.parts[part] = self.parts.get(part, 0) + 1
            self.slots[_PART_SLOTS[part]] += 1

    def cut(self, first: int) -> None:
        while len(self.names) > first:
            name = self.names.pop()
            self.open[name] -= 1
            self.silent -= name in SILENT
            for part in self.own.pop():
                self.slots[_PART_SLOTS[part]] -= 1
                if self.parts[part] == 1:
                    del self.parts[part]
                else:
                    self.parts[part] -= 1

    def leaf(self, text: str, linked: int) -> Leaf:
        return Leaf(text, linked, self.slots > 0, len(self.parts), self.own[-1][-1] if self.own and self.own[-1] else "")


def leaves(page: str) -> list[Leaf]:
    """Blocks of a page in order; white space inside a block is one space."""
    out: list[Leaf] = []
    stack = _Stack()
    names = stack.names
    held: list[str] = []
    linked = 0

    def close() -> None:
        nonlocal linked
        text = " ".join("".join(held).split())
        if text:
            out.append(stack.leaf(text, min(linked, len(text))))
        held.clear()
        linked = 0

    at = 0
    while at < len(page):
        found = _TAG.search(page, at)
        upto = found.start() if found else len(page)
        if upto > at:
            text = page[at:upto]
            if stack.silent and names[-1] == "head" and text.strip():
                stack.cut(len(names) - 1)
            if not stack.silent:
                text = html.unescape(text)
                held.append(text)
                if stack.open.get("a"):
                    linked += len(text)
        if not found:
            break
        at = found.end()
        name = (found[2] or "").lower()
        if not name:
            continue
        if found[1]:
            if name == "br" and not stack.silent:
                held.append(" ")
            if name in BLOCKS or name in SILENT:
                close()
            if stack.open.get(name):
                for i in range(len(names) - 1, -1, -1):
                    if names[i] == name:
                        stack.cut(i)
                        break
                    if name not in BLOCKS and name not in SILENT and names[i] in BLOCKS:
                        break  # a stray inline end tag ends no block
            continue
        if stack.silent:
            if name == "body" and stack.open.get("head"):
                stack.cut(names.index("head"))
            elif name not in HEAD and names[-1] == "head":
                stack.cut(len(names) - 1)
            elif name in BREAKING:
                for i in range(len(names) - 1, -1, -1):
                    silent = names[i] in SILENT or names[i] == "foreignobject"
                    if names[i] in ("svg", "math"):
                        stack.cut(i)
                    if silent:
                        break
        if name in BLOCKS or name in SILENT:
            close()
        if name in VOID:
            if name == "br":
                held.append(" ")
            continue
        if name in ("p", "li", "option", "dt", "dd", "tr", "td", "th"):
            for i in range(len(names) - 1, -1, -1):
                if names[i] == name:
                    stack.cut(i)
                    break
                if names[i] in SILENT or names[i] in BLOCKS and names[i] not in ("p", "li", "dt", "dd", "td", "th", "option"):
                    break
        elif name in BLOCKS:
            for i in range(len(names) - 1, -1, -1):
                if names[i] == "p":
                    stack.cut(i)
                    break
                if names[i] in BLOCKS or names[i] in SILENT:
                    break
        if found[3].rstrip().endswith("/") and name in ("svg", "math"):
            continue
        if name in RAW:
            end = _RAW_ENDS[name].search(page, at)
            at = end.end() if end else len(page)
            continue
        # html and body are there on every page, whether written or not
        stack.push(name, () if name in ("html", "body") else _path_parts(name, found[3]))
    close()
    return out


def vectors(blocks: list[Leaf]) -> np.ndarray:
    """One row a block: tag path, words and numbers."""
    x = np.zeros((len(blocks), WIDTH), np.float32)
    if not blocks:
        return x
    own = [leaf.text.lower().split() for leaf in blocks]
    sizes = np.array([len(w) for w in own])
    slots = np.array([_WORD_SLOTS[w] for words in own for w in words], np.int64)
    counts = np.bincount(np.repeat(np.arange(len(own)), sizes) * WORDS + slots, minlength=len(own) * WORDS).reshape(-1, WORDS).astype(np.float32)
    x[:, :PATH] = [leaf.slots for leaf in blocks]
    x[:, PATH : PATH + WORDS] = counts / np.maximum(np.sqrt((counts * counts).sum(1, keepdims=True)), 1.0)
    n = np.array([len(leaf.text) for leaf in blocks], float)
    last = np.array([(leaf.last == "p", leaf.last == "li", leaf.text[-1] in ".!?") for leaf in blocks], float)
    x[:, PATH + WORDS :] = np.column_stack([np.log1p(n) / 6, np.array([leaf.linked for leaf in blocks]) / n, np.minimum(sizes, 40) / 40, np.array([leaf.parts for leaf in blocks]) / 10, np.arange(len(blocks)) / max(len(blocks) - 1, 1), last])
    return x


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _init(rng: np.random.Generator) -> dict[str, np.ndarray]:
    p = {}
    for d in ("f", "b"):
        p[f"w{d}"] = rng.normal(0, 0.15, (WIDTH + HIDDEN, 4 * HIDDEN))
        p[f"c{d}"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])
    p["o"] = rng.normal(0, 0.2, 2 * HIDDEN)
    p["z"] = np.zeros(1)
    return p


def _run(x: np.ndarray, mask: np.ndarray, w: np.ndarray, b: np.ndarray, tape: bool):
    """One direction over a batch (pages, blocks, width): hidden states, and with ``tape`` what going back needs."""
    n, t, _ = x.shape
    h, c = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN))
    out, kept = np.zeros((n, t, HIDDEN)), []
    fed = x.astype(np.float64) @ w[:WIDTH] + b
    for k in range(t):
        g = fed[:, k] + h @ w[WIDTH:]
        i, f, o = (_sigmoid(g[:, s * HIDDEN : (s + 1) * HIDDEN]) for s in range(3))
        u = np.tanh(g[:, 3 * HIDDEN :])
        m = mask[:, k, None]
        new = f * c + i * u
        tanh = np.tanh(new)
        if tape:
            kept.append((h, c, i, f, o, u, tanh))
        c = m * new + (1 - m) * c
        h = m * o * tanh + (1 - m) * h
        out[:, k] = h
    return out, kept


def _back(x, mask, w, kept, dout):
    """Gradients of one direction's weights."""
    n, t, _ = x.shape
    dw, db = np.zeros_like(w), np.zeros(4 * HIDDEN)
    dh, dc = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN))
    dgs = np.zeros((n, t, 4 * HIDDEN))
    for k in range(t - 1, -1, -1):
        h, c, i, f, o, u, tanh = kept[k]
        m = mask[:, k, None]
        dh = dh + dout[:, k]
        dn = dc * m + dh * m * o * (1 - tanh**2)
        dg = np.concatenate([dn * u * i * (1 - i), dn * c * f * (1 - f), dh * m * tanh * o * (1 - o), dn * i * (1 - u**2)], 1)
        dgs[:, k] = dg
        dw[WIDTH:] += h.T @ dg
        dh = dh * (1 - m) + dg @ w[WIDTH:].T
        dc = dc * (1 - m) + dn * f
    flat = dgs.reshape(-1, 4 * HIDDEN)
    dw[:WIDTH] = x.reshape(-1, WIDTH).T.astype(np.float64) @ flat
    db = flat.sum(0)
    return dw, db


def _forward(p, x, mask, tape=False):
    hf, kf = _run(x, mask, p["wf"], p["cf"], tape)
    hb, kb = _run(x[:, ::-1], mask[:, ::-1], p["wb"], p["cb"], tape)
    both = np.concatenate([hf, hb[:, ::-1]], 2)
    return both @ p["o"] + p["z"], both, kf, kb


def batch(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Pages padded to the longest, and where their blocks are."""
    t = max((len(x) for x in pages), default=0)
    out, mask = np.zeros((len(pages), t, WIDTH), np.float32), np.zeros((len(pages), t))
    for i, x in enumerate(pages):
        out[i, : len(x)], mask[i, : len(x)] = x, 1
    return out, mask


def gradients(p: dict[str, np.ndarray], x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean log loss over all blocks of a batch."""
    odds, both, kf, kb = _forward(p, x, mask, tape=True)
    d = (_sigmoid(odds) - y) * mask / max(mask.sum(), 1)
    dboth = d[..., None] * p["o"]
    out = {"o": (both * d[..., None]).sum((0, 1)), "z": np.array([d.sum()])}
    out["wf"], out["cf"] = _back(x, mask, p["wf"], kf, dboth[..., :HIDDEN])
    out["wb"], out["cb"] = _back(x[:, ::-1], mask[:, ::-1], p["wb"], kb, dboth[:, ::-1, HIDDEN:])
    return out


def train(pages: list[np.ndarray], labels: list[np.ndarray], epochs: int = 20, size: int = 16, rate: float = 0.02, seed: int = 5) -> dict[str, np.ndarray]:
    """Adam on the log loss of all blocks."""
    rng = np.random.default_rng(seed)
    p = _init(rng)
    first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    step = 0
    order = np.argsort([len(x) for x in pages], kind="stable")
    groups = [order[i : i + size] for i in range(0, len(order), size)]
    for _ in range(epochs):
        for g in rng.permutation(len(groups)):
            x, mask = batch([pages[i] for i in groups[g]])
            y = np.zeros(mask.shape)
            for row, i in enumerate(groups[g]):
                y[row, : len(labels[i])] = labels[i]
            grads = gradients(p, x, mask, y)
            step += 1
            for k, grad in grads.items():
                grad = np.clip(grad, -1, 1) + 1e-4 * p[k] * (k[0] == "w")
                first[k] = 0.9 * first[k] + 0.1 * grad
                second[k] = 0.999 * second[k] + 0.001 * grad**2
                p[k] = p[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return p


_SYLLABLES = "ba ce do fi gu la me no pi ru sa te vo wi zu or en ti an el".split()
#: Parts of made pages: name of the tag, its attributes; what stands inside is not main text.
_AROUND = [
    ("nav", ""), ("nav", 'class="main-menu"'), ("ul", 'class="menu"'), ("div", 'id="navigation"'), ("div", 'class="breadcrumbs"'), ("header", ""), ("div", 'class="site-header"'), ("footer", ""), ("div", 'id="footer"'), ("aside", ""), ("aside", 'class="sidebar"'), ("div", 'class="sidebar widget"'), ("div", 'class="ad"'), ("div", 'class="ads banner"'), ("div", 'id="advert"'),
    ("div", 'class="sponsored promo"'), ("div", 'class="cookie-notice"'), ("div", 'id="cookie-banner" role="dialog"'), ("div", 'class="notice alert"'), ("div", 'class="newsletter signup"'), ("div", 'class="popup modal"'), ("form", 'action="/search"'), ("form", 'class="subscribe"'), ("div", 'class="social share"'), ("div", 'class="related links"'), ("section", 'class="comments"'), ("div", 'id="comments"'), ("div", 'class="comment reply"'), ("ol", 'class="comment-list"'), ("div", 'class="login form"'), ("div", 'class="legal copyright"'), ("section", 'class="recommended"'),
    ("section", 'class="kommentare"'), ("div", 'class="commentaires"'), ("div", 'id="comentarios"'), ("div", 'class="werbung"'), ("div", 'class="publicite"'), ("aside", 'class="anuncio"'), ("nav", 'class="navegacion"'),
]
#: What made footers say (fixed words).
_LEGAL = "copyright rights reserved terms privacy imprint contact all".split()
_MAIN = [("article", ""), ("main", ""), ("div", 'class="content"'), ("div", 'id="main"'), ("div", 'class="post entry"'), ("article", 'class="post"'), ("div", 'class="article-body text"'), ("section", 'id="content"'), ("div", 'class="story"'), ("div", "")]


def training_pages(n: int = 1200, seed: int = 11) -> list[tuple[str, list[bool]]]:
    """Made pages with the label of each of their blocks."""
    rng = np.random.default_rng(seed)
    pick = lambda x: x[int(rng.integers(len(x)))]

    def prose(few: int, many: int) -> str:
        words = ["".join(pick(_SYLLABLES) for _ in range(int(rng.integers(1, 4)))) for _ in range(int(rng.integers(few, many)))]
        words[0] = words[0].capitalize()
        return " ".join(words) + pick((".", ".", ".", "!", "?", ""))

    def cell() -> str:
        return pick((prose(1, 3), prose(1, 6), str(int(rng.integers(1, 3000))), f"{rng.integers(1, 99)}.{rng.integers(10)} %"))

    def grid(label: bool, labels: list[bool]) -> str:
        """Rows of cells, in one of the ways that tables are written."""
        rows, columns = int(rng.integers(1, 6)), int(rng.integers(1, 5))
        labels.extend([label] * (rows * columns))
        end = rng.random() < 0.7
        lines = "".join("<tr>" + "".join(f"<{t}>{cell()}{f'</{t}>' * end}" for t in (pick(("td", "td", "td", "th")) for _ in range(columns))) + "</tr>" for _ in range(rows))
        return f"<table>{lines}</table>" if rng.random() < 0.6 else f"<table><tbody>{lines}</tbody></table>"

    def terms(label: bool, labels: list[bool]) -> str:
        pairs = int(rng.integers(1, 5))
        labels.extend([label] * (2 * pairs))
        return "<dl>" + "".join(f"<dt>{prose(1, 4)}</dt><dd>{prose(1, 25)}</dd>" for _ in range(pairs)) + "</dl>"

    def legal() -> str:
        words = [pick(("\u00a9", "(c)", "\u00a9 copyright", "copyright")), str(int(rng.integers(1995, 2030))), *(pick(_LEGAL + ["ba", "do"]) for _ in range(int(rng.integers(0, 7))))]
        return " ".join(words) + pick((".", ""))

    out = []
    for _ in range(n):
        labels: list[bool] = []

        def around(where=_AROUND, labels=labels) -> str:
            tag, attrs = pick(where)
            kinds = ["list", "text", "text", "text", "links", "links", "fields"]
            if rng.random() < 0.1:  # a name that says nothing: what stands inside tells
                attrs, kinds = f'class="{prose(1, 2).strip(".!?").lower()}"', ["list", "links", "links", "legal"]
            elif rng.random() < 0.15:
                kinds = ["table", "terms", "legal"]
            kind = pick(kinds)
            if kind == "list" or tag in ("ul", "ol"):
                tag_in = tag if tag in ("ul", "ol") else "ul"
                items = [f"<li>{pick(('<a href=x>%s</a>', '%s', '<p>%s</p>')) % prose(1, 6)}</li>" for _ in range(int(rng.integers(1, 7)))]
                labels.extend([False] * len(items))
                inner = "".join(items)
                return f"<{tag} {attrs}>{inner}</{tag}>" if tag == tag_in else f"<{tag} {attrs}><{tag_in}>{inner}</{tag_in}></{tag}>"
            if kind in ("table", "terms"):
                return f"<{tag} {attrs}>{(grid if kind == 'table' else terms)(False, labels)}</{tag}>"
            if kind == "links":
                labels.append(False)
                return f"<{tag} {attrs}>" + " | ".join(f"<a href=x>{prose(1, 4)}</a>" for _ in range(int(rng.integers(1, 5)))) + f"</{tag}>"
            if kind == "fields":
                labels.extend([False, False])
                return f"<{tag} {attrs}><h3>{prose(1, 5)}</h3><p>{prose(2, 30)}</p></{tag}>"
            labels.append(False)
            return f"<{tag} {attrs}>{legal() if kind == 'legal' else prose(1, 40)}</{tag}>"

        def body(labels=labels) -> str:
            parts = []
            if rng.random() < 0.8:
                labels.append(True)
                parts.append(f"<h1>{prose(2, 12)}</h1>")
            for _ in range(int(rng.integers(1, 14))):
                r = rng.random()
                if r < 0.08:
                    labels.append(True)
                    parts.append(f"<h2>{prose(1, 8)}</h2>")
                elif r < 0.14:
                    k = int(rng.integers(1, 4))
                    labels.extend([True] * k)
                    parts.append("<ul>" + "".join(f"<li>{prose(2, 20)}</li>" for _ in range(k)) + "</ul>")
                elif r < 0.2:
                    labels.append(True)
                    parts.append(f"<blockquote>{prose(4, 40)}</blockquote>")
                elif r < 0.26:
                    parts.append(around([x for x in _AROUND if x[1] and x[0] == "div"]))
                elif r < 0.31:
                    parts.append(grid(True, labels))
                elif r < 0.35:
                    parts.append(terms(True, labels))
                elif r < 0.38:
                    labels.append(True)
                    parts.append(f"<figure><img src=x><figcaption>{prose(1, 15)}</figcaption></figure>")
                elif r < 0.41:
                    labels.append(True)
                    parts.append(f"<pre>{prose(2, 30)}\n  {prose(1, 9)}</pre>")
                elif r < 0.5:
                    labels.append(True)
                    parts.append(f"<p>{prose(1, pick((2, 4)))}</p>")
                elif r < 0.56:
                    labels.extend([True, True])
                    parts.append(f"<p><b>{prose(3, 30)}<br><p>{prose(5, 60)}</p>")
                else:
                    labels.append(True)
                    parts.append(f"<p>{prose(5, 80)}</p>")
            return "".join(parts)

        if rng.random() < 0.06:  # text without a tag
            labels.append(True)
            out.append((prose(1, 120), labels))
            continue
        page = "".join(around() for _ in range(int(rng.integers(0, 4))))
        tag, attrs = pick(_MAIN)
        if rng.random() < 0.15:
            attrs = f'class="{prose(1, 2).strip(".!?").lower()}"'
        page += f"<{tag} {attrs}>{body()}</{tag}>"
        page += "".join(around() for _ in range(int(rng.integers(0, 4))))
        if rng.random() < 0.15:  # a footer that is not called one
            labels.append(False)
            page += f"<{pick(('div', 'p', 'div', 'small'))}>{legal()}"
        elif rng.random() < 0.3:
            page = f'<div class="wrapper"><div id="page">{page}</div></div>'
        out.append((f"<!DOCTYPE html><html><head><title>x</title></head><body>{page}</body></html>", labels))
    return out


_MODEL: dict[str, dict[str, np.ndarray]] = {}


def model() -> dict[str, np.ndarray]:
    """The trained network; trained once in a driver."""
    if "p" not in _MODEL:
        made = [(leaves(page), labels) for page, labels in training_pages()]
        good = [(blocks, labels) for blocks, labels in made if len(blocks) == len(labels)]
        _MODEL["p"] = train([vectors(b) for b, _ in good], [np.array(y, float) for _, y in good])
    return _MODEL["p"]


def labelled(pages: list[list[Leaf]], p: dict[str, np.ndarray]) -> list[np.ndarray]:
    """Which blocks of each page are main text. Pages of like length are run together."""
    out = [np.zeros(0, bool)] * len(pages)
    order = sorted((i for i, x in enumerate(pages) if x), key=lambda i: len(pages[i]))
    first = 0
    while first < len(order):
        last = first + 1
        while last < len(order) and (last - first + 1) * len(pages[order[last]]) <= 4096:
            last += 1
        own = order[first:last]
        x, mask = batch([vectors(pages[i]) for i in own])
        odds = _forward(p, x, mask)[0]
        for row, i in enumerate(own):
            out[i] = odds[row, : len(pages[i])] > 0
        first = last
    return out


def main_texts(pages: list[str], p: dict[str, np.ndarray]) -> list[str]:
    blocks = [leaves(x) for x in pages]
    return ["\n".join(leaf.text for leaf, keep in zip(own, kept, strict=True) if keep) for own, kept in zip(blocks, labelled(blocks, p), strict=True)]


def extracted(pages: DataFrame, p: dict[str, np.ndarray]) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, 256):
            found = main_texts([x or "" for x in part.column(2).to_pylist()], p)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())], ["page_id", "url", "text", "n_chars"])

    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return own.mapInArrow(extract, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"), model())
