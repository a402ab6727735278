"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks at block-level tags (and at two or more line
breaks in a row). A block is described by its tag path, with the words of class,
id and role on it, by its words, both hashed into trained vectors, and by a few
ratios (length, share of links, place in the page). A bidirectional LSTM in
numpy reads the page's whole sequence of blocks and labels each one; blocks
labelled as main text are joined. The content of script, style, noscript, title,
textarea, iframe and svg elements is never text; that of math, object and template
is, for the labeller to judge.

The network is trained here on generated pages (``TRAINING_PAGES`` of them, a
fixed bound) whose blocks' roles are known, and sees a page of any length whole.

Defined results
    null or empty html: empty text. Broken markup: unclosed elements end with
    the page; a ``<`` that starts no tag is text; an unclosed comment hides the
    rest. Repeated rows: each gives a row. Empty table: empty result. Extra
    columns are not read. White space is what Unicode calls so. Very long pages
    are labelled whole; the network reads ``CELLS`` blocks at a time and hands its
    state on.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch

PATH_ROWS, PATH_DIM, WORD_ROWS, WORD_DIM, RATIOS, HIDDEN = 8192, 16, 16384, 8, 8, 16
#: Words on fewer training pages than this have no vector.
WORD_PAGES = 80
TRAINING_PAGES, EPOCHS, BATCH, STEP = 1600, 6, 16, 0.02
PAGES_AT_ONCE = 256
#: Blocks, with padding, whose gates are held at once.
CELLS = 65_536

_TOKEN = re.compile(
    r"""<!--(?:(?!-->).)*+(?:-->|\Z)|<svg\b(?:[^>"'/]|/(?!>)|"[^"]*"|'[^']*')*+/>|<(script|style|noscript|title|textarea|svg|iframe)\b(?:[^>"']|"[^"]*"|'[^']*')*+>(?:(?!</\1\b).)*+(?:</\1[^>]*>|\Z)"""
    r"""|<(/?)([a-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-z][^\s/>]*)([^>]*+)(?:>|\Z)|<[!?/][^>]*+>|[^<]++|<""",
    re.S | re.I,
)
_ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark meter nobr output progress q rp rt ruby s samp small source span strike strong sub sup time tt u var wbr link meta base param track embed picture video audio canvas map area math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mstyle mspace mfenced semantics annotation".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag ends open elements of these kinds, up to the element behind them.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


class Block:
    __slots__ = ("text", "path", "leaf", "linked")

    def __init__(self, text: str, path: tuple[str, ...], leaf: str, linked: int):
        self.text, self.path, self.leaf, self.linked = text, path, leaf, linked


@lru_cache(maxsize=20_000)
def _element(tag: str, attrs: str) -> tuple[str, ...]:
    """The path words of an element: its tag, the words of its names."""
    out = [f"<{tag}"]
    for name, value in _ATTR.findall(attrs) if attrs else ():
        name = name.lower()
        if "hidden" in name:
            out.append("hidden")
        else:
            out += [f"{'#' if name == 'role' else '.'}{w.lower()}" for w in _NAME.findall(value)]
    return tuple(dict.fromkeys(out))


def _joined(above: tuple[str, ...], own: tuple[str, ...]) -> tuple[str, ...]:
    new = tuple(w for w in own if w not in above)
    return above + new if new else above


def blocks_of(page: str | None) -> list[Block]:
    """The non-empty leaf blocks in page order."""
    out: list[Block] = []
    # Open elements: tag and the distinct path words down to it. A level that adds
    # no word shares the tuple of the one above, so depth costs nothing.
    stack: list[tuple[str, tuple[str, ...]]] = []
    opened: Counter[str] = Counter()
    parts: list[str] = []
    links = linked = breaks = 0

    def close() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                tag, words = stack[-1] if stack else ("", ())
                out.append(Block(text, words, f"leaf<{tag}", linked))
            parts, linked = [], 0

    def leave() -> str:
        tag = stack.pop()[0]
        opened[tag] -= 1
        return tag

    for m in _TOKEN.finditer(page or ""):
        tag = m[3] or m[6]
        if tag is None:
            raw = m[0]
            if raw[0] != "<" or raw == "<":
                parts.append(raw)
                if links:
                    linked += len(raw)
                if breaks and not raw.isspace():
                    breaks = 0
            elif m[1]:
                parts.append(" ")
            continue
        tag, ending = tag.lower(), (m[2] if m[3] else m[5]) == "/"
        if tag in INLINE:
            if tag == "br":
                breaks += 1
                parts.append(" ")
                if breaks > 1:
                    close()
            elif tag == "a":
                links = 0 if ending else 1
            continue
        close()
        breaks = 0
        if ending:
            if opened[tag] > 0:
                while leave() != tag:
                    pass
            continue
        if tag not in ("html", "body", "head"):
            ends = ENDS.get(tag)
            if ends:
                while stack and stack[-1][0] in ends | {"p"}:
                    leave()
            elif stack and stack[-1][0] == "p":
                leave()
        if tag not in VOID:
            above = stack[-1][1] if stack else ()
            stack.append((tag, _joined(above, _element(tag, (m[4] if m[3] else m[7]) or ""))))
            opened[tag] += 1
    close()
    return out


def _hash(word: str, rows: int) -> int:
    return zlib.crc32(word.encode("utf-8", "replace")) % rows


@lru_cache(maxsize=200_000)
def _word_row(word: str) -> int:
    return _hash(word, WORD_ROWS)


@lru_cache(maxsize=50_000)
def _path_rows(path: tuple[str, ...], leaf: str) -> np.ndarray:
    return np.array([_hash(w, PATH_ROWS) for w in [*path, leaf]])


def _ratios(block: Block, at: int, count: int) -> list[float]:
    n = len(block.text)
    return [min(n, 2000) / 500, n < 40, block.linked / (n + 1), at / count, 1 / (at + 1), 1 / (count - at), block.text.count(".") * 40 / (n + 40), block.text[-1] in ".!?:;\"'"]


class Labeller:
    """Vectors of path words and words, two LSTM directions, a label layer."""

    def __init__(self, p: dict[str, np.ndarray]):
        self.p = p

    @classmethod
    def fresh(cls, seed: int = 0) -> "Labeller":
        r, d, h = np.random.default_rng(seed), PATH_DIM + WORD_DIM + RATIOS, HIDDEN
        make = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        bias = np.zeros(4 * h, np.float32)
        bias[h : 2 * h] = 1
        return cls({"path": np.zeros((PATH_ROWS, PATH_DIM), np.float32), "word": np.zeros((WORD_ROWS, WORD_DIM), np.float32), "wf": make(d, 4 * h), "uf": make(h, 4 * h), "bf": bias, "wb": make(d, 4 * h), "ub": make(h, 4 * h), "bb": bias.copy(), "out": make(2 * h, 1), "skip": make(d, 1), "bias": np.zeros(1, np.float32)})

    def vectors(self, rows: "PageRows") -> np.ndarray:
        """One row per block."""
        x = np.zeros((rows.count, PATH_DIM + WORD_DIM + RATIOS), np.float32)
        if rows.count:
            x[:, :PATH_DIM] = np.add.reduceat(self.p["path"][rows.path], rows.path_start, axis=0)
            x[:, PATH_DIM:-RATIOS] = np.add.reduceat(self.p["word"][rows.word], rows.word_start, axis=0) * rows.scale
            x[:, -RATIOS:] = rows.ratios
        return x

    def run(self, x: np.ndarray, mask: np.ndarray, way: str, trace: list | None = None) -> np.ndarray:
        """States (pages, time, hidden); behind a page's end the state is zero."""
        h, n = HIDDEN, x.shape[1]
        span = max(1, CELLS // len(x))
        inner, held = None, -1
        state, cell = np.zeros((len(x), h), np.float32), np.zeros((len(x), h), np.float32)
        out = np.zeros((len(x), n, h), np.float32)
        for t in range(n) if way == "f" else range(n - 1, -1, -1):
            if t // span != held:
                held = t // span
                inner = x[:, held * span : (held + 1) * span] @ self.p["w" + way] + self.p["b" + way]
            a = inner[:, t - held * span] + state @ self.p["u" + way]
            gate = 1 / (1 + np.exp(-a[:, : 3 * h]))
            i, f, o = gate[:, :h], gate[:, h : 2 * h], gate[:, 2 * h :]
            g = np.tanh(a[:, 3 * h :])
            live = mask[:, t : t + 1]
            new = (f * cell + i * g) * live
            th = np.tanh(new)
            if trace is not None:
                trace.append((t, state, cell, i, f, o, g, th, live))
            state, cell = o * th * live, new
            out[:, t] = state
        return out

    def forward(self, x: np.ndarray, mask: np.ndarray, traces: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
        states = np.concatenate([self.run(x, mask, w, traces[w] if traces else None) for w in "fb"], axis=2)
        return states, 1 / (1 + np.exp(-(states @ self.p["out"] + x @ self.p["skip"] + self.p["bias"])[:, :, 0]))

    def gradient(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the parameters but the vectors, and of the inputs."""
        h, p, traces = HIDDEN, self.p, {"f": [], "b": []}
        states, prob = self.forward(x, mask, traces)
        d = ((prob - y) * mask / mask.sum())[:, :, None]
        g = {k: np.zeros_like(v) for k, v in p.items() if k not in ("path", "word")}
        g["out"] = np.einsum("bth,bto->ho", states, d)
        g["skip"] = np.einsum("btd,bto->do", x, d)
        g["bias"] = d.sum(axis=(0, 1))
        back, dx = d @ p["out"].T, d @ p["skip"].T
        for k, way in enumerate("fb"):
            ds, dc = np.zeros((len(x), h), np.float32), np.zeros((len(x), h), np.float32)
            da = np.zeros((*x.shape[:2], 4 * h), np.float32)
            for t, before, cell, i, f, o, gg, th, live in reversed(traces[way]):
                ds = (back[:, t, k * h : (k + 1) * h] + ds) * live
                dc = (dc + ds * o * (1 - th**2)) * live
                da[:, t] = np.concatenate([dc * gg * i * (1 - i), dc * cell * f * (1 - f), ds * th * o * (1 - o), dc * i * (1 - gg**2)], axis=1)
                g["u" + way] += before.T @ da[:, t]
                ds, dc = da[:, t] @ p["u" + way].T, dc * f
            g["w" + way] += np.einsum("btd,btg->dg", x, da)
            g["b" + way] += da.sum(axis=(0, 1))
            dx = dx + da @ p["w" + way].T
        return g, dx

    def label(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """Probability of main text for every block of every page."""
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
        k = len(order)
        while k:
            # The longest first; as many pages as stay below CELLS blocks with padding.
            n = max(1, min(64, CELLS // len(pages[order[k - 1]])))
            some, k = order[max(0, k - n) : k], max(0, k - n)
            x, mask = self.padded([PageRows(pages[i]) for i in some])
            prob = self.forward(x, mask)[1]
            for i, row in zip(some, prob):
                out[i] = row[: len(pages[i])]
        return out

    def padded(self, pages: list["PageRows"]) -> tuple[np.ndarray, np.ndarray]:
        longest = max(p.count for p in pages)
        x, mask = np.zeros((len(pages), longest, PATH_DIM + WORD_DIM + RATIOS), np.float32), np.zeros((len(pages), longest), np.float32)
        for i, p in enumerate(pages):
            x[i, : p.count], mask[i, : p.count] = self.vectors(p), 1
        return x, mask


class PageRows:
    """What a page's blocks look up: rows of path and word vectors, ratios."""

    def __init__(self, page: list[Block]):
        paths = [_path_rows(b.path, b.leaf) for b in page]
        words = [[_word_row(w) for w in set(b.text.lower().split())] for b in page]
        self.count = len(page)
        self.path = np.concatenate(paths) if page else np.zeros(0, int)
        self.word = np.array([w for ws in words for w in ws], int)
        path_n, word_n = np.array([len(p) for p in paths], int), np.array([len(w) for w in words], int)
        self.path_at, self.word_at = np.repeat(np.arange(len(page)), path_n), np.repeat(np.arange(len(page)), word_n)
        self.path_start, self.word_start = np.cumsum(path_n) - path_n, np.cumsum(word_n) - word_n
        self.scale = (1 / np.sqrt(np.maximum(word_n, 1)))[:, None]
        self.ratios = np.array([_ratios(b, i, len(page)) for i, b in enumerate(page)], np.float32).reshape(-1, RATIOS)


# --- generated pages ---------------------------------------------------------

ROLES = {
    "menu": (["nav", "div", "ul", "header"], "nav navbar navigation menu main-menu topmenu breadcrumb breadcrumbs pagination pager toc sitenav links skip tabs".split(), ["navigation", "menu", "menubar"]),
    "header": (["header", "div"], "header site-header masthead banner topbar logo branding page-header site-title tagline top".split(), ["banner"]),
    "footer": (["footer", "div"], "footer site-footer colophon copyright bottom legal credits imprint foot".split(), ["contentinfo"]),
    "sidebar": (["aside", "div", "section"], "sidebar side aside widget widgets related recommended rail secondary trending popular more-stories see-also tags taglist left-column right-column promo-box".split(), ["complementary"]),
    "notice": (["div", "section", "aside", "p"], "cookie cookies consent notice gdpr alert popup modal overlay newsletter subscribe paywall message banner privacy warning toast cookie-banner cookie-notice disclaimer".split(), ["alert", "dialog", "alertdialog", "status"]),
    "advert": (["div", "aside", "section", "ins"], "ad ads advert advertisement adslot ad-slot sponsored sponsor promo adsbygoogle banner-ad dfp commercial ad-container promoted".split(), ["complementary"]),
    "form": (["form", "div"], "form search searchbox login signup register contact-form subscribe-form newsletter-form searchform".split(), ["search", "form"]),
    "comments": (["section", "div", "aside", "ol", "article"], "comments comment commentlist comment-list disqus replies reply respond discussion reader-comments responses feedback user-comments".split(), []),
    "share": (["div", "ul"], "share social sharing share-buttons follow sharebar".split(), []),
}
CUES = {
    "menu": "home about contact news sport login archive next previous sitemap".split(),
    "footer": "© copyright all rights reserved privacy terms imprint 2024 impressum".split(),
    "notice": "cookies we use accept consent policy continue subscribe newsletter".split(),
    "advert": "advertisement sponsored buy now offer sale anzeige publicité".split(),
    "form": "search name e-mail password submit send log in".split(),
    "comments": "reply says comment comments likes ago report".split(),
    "sidebar": "related read more popular trending recommended tags".split(),
    "share": "share tweet facebook twitter email print".split(),
    "header": "welcome menu".split(),
}
#: Cue words stand in main text as well.
CUE_WORDS = sorted({w for words in CUES.values() for w in words})
CONTENT = "content main article post entry story body text article-body post-content entry-content page-content main-content article-content maincontent blog-post hentry".split()


def training_page(r: random.Random) -> tuple[str, list[int]]:
    """A page and the label of each of its blocks, in order."""
    out: list[str] = []
    labels: list[int] = []

    def word() -> str:
        return "".join(r.choice(["th", "er", "on", "an", "re", "ing", "is", "é", "au", "ch", "ei", "ung", "ó", "os", "la", "de", "que", "tion", "en", "st"]) for _ in range(r.randint(1, 4)))

    def words(n: int, role: str | None = None) -> str:
        own = [r.choice(CUES[role]) if role and r.random() < 0.3 else r.choice(CUE_WORDS) if not role and r.random() < 0.1 else word() for _ in range(n)]
        text = " ".join(own).capitalize() + r.choice([".", ".", ".", "", "!", "?"])
        return text.replace("is", "&amp;") if r.random() < 0.03 else text

    def attrs(names: list[str], roles: list[str], sure: bool) -> str:
        got = ""
        if sure or r.random() < 0.6:
            name = r.choice(names) + (r.choice(["-1", "", "", " clearfix", "_box", "-wrapper", "-area", " block", " inner"]))
            got += f' {r.choice(["class", "class", "id"])}="{name}"'
        if roles and r.random() < 0.25:
            got += f' role="{r.choice(roles)}"'
        return got

    def block(tag: str, text: str, label: int, close: bool = True) -> None:
        out.append(f"<{tag}>{text}" + (f"</{tag.split()[0]}>" if close else ""))
        labels.append(label)

    def aside(role: str) -> None:
        tags, names, roles = ROLES[role]
        tag = r.choice(tags)
        plain = tag in ("div", "section", "p", "article", "ol", "ul") or role in ("notice", "advert", "comments", "share") or tag == "aside" and role != "sidebar"
        if tag not in ("ul", "ol", "form") and r.random() < 0.3:
            block(f"{tag}{attrs(names, roles, plain)}", r.choice(["", "", "&copy; " * (role == "footer")]) + words(r.randint(1, 30), role if r.random() < 0.3 else None), 0)
            return
        out.append(f"<{tag}{attrs(names, roles, plain)}>")
        if role == "form":
            for _ in range(r.randint(1, 4)):
                block(r.choice(["p", "div", "li", "button", "fieldset"]), words(r.randint(1, 6), role), 0)
        elif role in ("menu", "share") or role in ("sidebar", "footer", "header") and r.random() < 0.5:
            inner = tag if tag in ("ul", "ol") else "ul"
            if inner != tag:
                out.append("<ul>")
            for _ in range(r.randint(2, 9)):
                block("li", f'<a href="/{word()}">{words(r.randint(1, 4), role).rstrip(".")}</a>', 0)
            if inner != tag:
                out.append("</ul>")
        elif role == "comments":
            if r.random() < 0.7:
                block(r.choice(["h2", "h3", "h4"]), words(r.randint(1, 3), role), 0)
            for _ in range(r.randint(1, 5)):
                kind = r.choice(["div", "article", "li", "section"])
                out.append(f'<{kind} class="{r.choice(["comment", "reply", "comment-body", "depth-1 comment", "user"])}">' if r.random() < 0.7 else f"<{kind}>")
                if r.random() < 0.5:
                    block(r.choice(["h4", "div", "cite", "header"]).replace("cite", "h5"), words(r.randint(1, 3)), 0)
                for _ in range(r.randint(1, 2)):
                    block("p", words(r.randint(3, 50), role if r.random() < 0.3 else None), 0)
                out.append(f"</{kind}>")
        else:
            for _ in range(r.randint(1, 3)):
                kind = r.choice(["p", "p", "div", "h3", "h2", "span"])
                text = words(r.randint(1, 40), role if r.random() < 0.5 else None)
                if r.random() < 0.2:
                    text = f'<a href="#">{text}</a>'
                if kind == "span":
                    block("div", f"<span>{text}</span>", 0)
                else:
                    block(kind, text, 0)
            if r.random() < 0.2 and role in ("sidebar", "header", "footer", "notice"):
                aside(r.choice(["form", "share", "menu"]))
        out.append(f"</{tag}>")

    def body_blocks() -> None:
        if r.random() < 0.85:
            wrap = r.random() < 0.2
            out.append("<header>" * wrap)
            block("h1", words(r.randint(2, 10)), 1)
            out.append("</header>" * wrap)
        for _ in range(r.choice([1, 2, 3, 4, 6, 8, 12, 20])):
            kind = r.random()
            if kind < 0.7:
                close = r.random() < 0.9
                text = words(r.choice([1, 4, 10, 25, 60, 120]))
                if r.random() < 0.15:
                    text = f"<b>{text}<br>" if r.random() < 0.5 else f'{text} <a href="/x">{word()}</a> {words(5)}'
                block("p" if r.random() < 0.95 else "div", text, 1, close)
            elif kind < 0.78:
                block(r.choice(["h2", "h3", "h4"]), words(r.randint(1, 8)), 1)
            elif kind < 0.85:
                inner = r.choice(["ul", "ol"])
                out.append(f"<{inner}>")
                for _ in range(r.randint(2, 6)):
                    block("li", words(r.randint(2, 25)), 1)
                out.append(f"</{inner}>")
            elif kind < 0.9:
                out.append("<blockquote>")
                block("p", words(r.randint(5, 40)), 1)
                out.append("</blockquote>")
            elif kind < 0.93:
                block(r.choice(["pre", "blockquote", "figcaption"]), words(r.randint(3, 30)), 1)
            elif kind < 0.96:
                out.append("<table><tr>")
                for _ in range(r.randint(2, 6)):
                    block(r.choice(["td", "th"]), words(r.randint(1, 5)), 1)
                out.append("</tr></table>")
            else:
                aside(r.choice(["advert", "advert", "sidebar", "notice", "share", "form"]))

    out.append(f"<!DOCTYPE html><html><head><title>{words(4)}</title><style>p{{margin:0}}</style></head><body>")
    shell = r.random() < 0.3
    out.append('<div class="%s">' % r.choice(["page", "wrapper", "container", "site", "layout", "row"]) * shell)
    for role in r.sample(["header", "menu", "notice", "advert", "form", "share", "sidebar"], r.randint(0, 5)):
        aside(role)
    outer = r.random() < 0.4
    out.append(r.choice(["<main>", '<main id="main">', f'<div id="{r.choice(CONTENT)}">', f'<div class="{r.choice(CONTENT)}">']) if outer else "")
    closing = "</main>" if outer and out[-1].startswith("<main") else "</div>" * outer
    style = r.random()
    tag = "article" if style < 0.65 else r.choice(["div", "section", "td"]) if style < 0.9 else None
    if tag == "td":
        out.append("<table><tr><td>")
    elif tag:
        out.append(f"<{tag}>" if tag == "article" and r.random() < 0.6 or outer and r.random() < 0.5 else f'<{tag} class="{r.choice(CONTENT)}">')
    body_blocks()
    if r.random() < 0.25:
        aside(r.choice(["comments", "share", "advert", "sidebar"]))
    if tag and r.random() < 0.95:
        out.append(f"</{tag}>" + "</tr></table>" * (tag == "td"))
    if outer and r.random() < 0.3:
        aside(r.choice(["comments", "sidebar"]))
    out.append(closing)
    for role in r.sample(["comments", "footer", "sidebar", "advert", "menu", "notice", "form", "share"], r.randint(0, 5)):
        aside(role)
    out.append("</div>" * shell + "</body></html>")
    return "".join(out), labels


def training_pages(n: int, seed: int) -> list[tuple[list[Block], np.ndarray]]:
    r, out = random.Random(seed), []
    while len(out) < n:
        page, labels = training_page(r)
        blocks = blocks_of(page)
        if len(blocks) == len(labels):
            out.append((blocks, np.array(labels, np.float32)))
    return out


@lru_cache(maxsize=2)
def train(pages: int = TRAINING_PAGES, seed: int = 5) -> Labeller:
    """Fits the network; once per process."""
    net, r = Labeller.fresh(seed), np.random.default_rng(seed)
    data = [(PageRows(blocks), labels) for blocks, labels in training_pages(pages, seed)]
    data.sort(key=lambda d: d[0].count)
    m, v = {n: np.zeros_like(x) for n, x in net.p.items()}, {n: np.zeros_like(x) for n, x in net.p.items()}
    seen = np.zeros(WORD_ROWS, int)
    for rows, _ in data:
        seen[np.unique(rows.word)] += 1
    groups, k = [data[i : i + BATCH] for i in range(0, len(data), BATCH)], 0
    for epoch in range(EPOCHS):
        for b in r.permutation(len(groups)):
            x, mask = net.padded([p for p, _ in groups[b]])
            # Words and ratios are blanked on many pages: the path must do alone.
            use_words, use_ratios = r.random((len(x), 1, 1)) < 0.4, r.random((len(x), 1, 1)) < 0.6
            x[:, :, PATH_DIM:-RATIOS] *= use_words
            x[:, :, -RATIOS:] *= use_ratios
            y = np.zeros(mask.shape, np.float32)
            for i, (_, labels) in enumerate(groups[b]):
                y[i, : len(labels)] = labels
            g, dx = net.gradient(x, mask, y)
            g["path"], g["word"] = np.zeros_like(net.p["path"]), np.zeros_like(net.p["word"])
            for i, (p, _) in enumerate(groups[b]):
                np.add.at(g["path"], p.path, dx[i, p.path_at, :PATH_DIM])
                np.add.at(g["word"], p.word, (dx[i, : p.count, PATH_DIM:-RATIOS] * (p.scale * use_words[i, 0, 0]))[p.word_at])
            g["word"][seen < WORD_PAGES] = 0
            k += 1
            rate = STEP * (1 - 0.9 * epoch / EPOCHS)
            for n in net.p:
                m[n] = 0.9 * m[n] + 0.1 * g[n]
                v[n] = 0.99 * v[n] + 0.01 * g[n] ** 2
                step = rate * (m[n] / (1 - 0.9**k)) / (np.sqrt(v[n] / (1 - 0.99**k)) + 1e-6)
                net.p[n] -= (step * (0.1 if n == "word" else 1)).astype(np.float32)
    return net


def extract(pages: DataFrame, net: Labeller, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_blocks (all blocks) and n_main of every row."""
    scratch.ship(pages.sparkSession)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    weights = pages.sparkSession.sparkContext.broadcast(net.p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Labeller(weights.value)
        for batch in batches:
            for k in range(0, batch.num_rows, PAGES_AT_ONCE):
                part = batch.slice(k, PAGES_AT_ONCE)
                blocks = [blocks_of(p) for p in part.column(2).to_pylist()]
                main = [[b.text for b, p in zip(bs, prob) if p >= 0.5] for bs, prob in zip(blocks, own.label(blocks))]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(["\n".join(t) for t in main], pa.string()), pa.array([len(b) for b in blocks], pa.int64()), pa.array([len(t) for t in main], pa.int64())],
                    ["page_id", "url", "text", "n_blocks", "n_main"],
                )

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_blocks long, n_main long")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages, train()).withColumn("n_chars", F.length("text").cast("long"))
