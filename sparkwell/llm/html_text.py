"""HTML extraction: a recurrent labeller keeps the blocks of the article and drops the rest.

A page is cut into leaf blocks: runs of text between block-level tags, each with the path of
open elements above it. A block's vector holds its hashed path (tags, and words of class, id
and role), its hashed words and a few shape features. A bidirectional LSTM in numpy reads all
blocks of a page in order, so that every block is classified knowing the whole document, and
the blocks labelled as article, joined by newlines, are the text.

The labeller is trained here, on ``TRAINING_PAGES`` generated pages of random layouts whose
blocks carry their labels: articles in semantic or anonymous containers, among menus, notices,
adverts, forms, sidebars, comments and footers. The pages are the same on every run; nothing
of the table is learned from.

Nulls and odd inputs: a null or empty page, or one without an article, has an empty text.
Markup that a page's end cuts off is dropped; the text before it stays. Character references
are decoded as browsers do. Any number of blocks is read. Further columns are carried along; a column
named like the result is replaced.
"""

from __future__ import annotations

import random
import re
import zlib
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, small_batches

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|textarea|select)\b.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|<[!?/a-zA-Z][^>]*(?:>|\Z)|[^<]+|<",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|(?<![\w-])(hidden)(?![\w-])", re.I)
#: What labels the training pages, and only those.
LABEL = re.compile(r" data-y=([01])")
WORD = re.compile(r"[a-z]+|[0-9]+")
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html label legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag ends an open element of these, unless one of the second stands between.
ENDS = {"p": (("p",), ()), "li": (("li", "p"), ("ul", "ol", "menu")), "dt": (("dt", "dd", "p"), ("dl",)), "dd": (("dt", "dd", "p"), ("dl",)), "td": (("td", "th", "p"), ("table",)), "th": (("td", "th", "p"), ("table",)), "tr": (("tr", "p"), ("table",)), "body": (("head",), ())}
PATH_BUCKETS, WORD_BUCKETS, SHAPES = 160, 64, 8
SIZE, HIDDEN = PATH_BUCKETS + WORD_BUCKETS + SHAPES, 24
TRAINING_PAGES = 480


@dataclass
class Block:
    path: tuple[str, ...]
    text: str
    linked: int
    label: int = -1


def blocks_of(html: str, labelled: bool = False) -> list[Block]:
    """Leaf blocks in page order. Of ``labelled`` (training) pages, ``data-y`` attributes label what is inside."""
    out: list[Block] = []
    stack: list[tuple[str, str, int]] = []  # tag, tag with its attribute words, label
    parts: list[str] = []
    links, linked, at_start = 0, 0, ((), -1)

    def flush() -> None:
        nonlocal linked
        if parts:
            text = "".join(parts)
            parts.clear()
            text = " ".join((unescape(text) if "&" in text else text).split())
            if text:
                out.append(Block(*at_start[:1], text, linked, at_start[1]))
            linked = 0

    def close(names: tuple[str, ...], walls: tuple[str, ...]) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in walls or (not walls and stack[i][0] in BLOCKS and stack[i][0] not in names and stack[i][0] not in ("p",)):
                return
            if stack[i][0] in names:
                del stack[i:]

    for m in TOKEN.finditer(html):
        name = m[3]
        if name is None:
            text = m[0]
            if text[0] != "<" or len(text) == 1:
                if not parts:
                    at_start = (tuple(x[1] for x in stack), stack[-1][2] if stack else -1)
                parts.append(text)
                if links:
                    linked += len(text)
            continue
        name = name.lower()
        block = name in BLOCKS
        if block:
            flush()
        elif name == "br":
            parts.append(" ") if parts else None
        if m[2]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    if not block and any(x[0] in BLOCKS for x in stack[i + 1 :]):
                        break  # an inline end tag closes no block
                    del stack[i:]
                    break
            if name == "a":
                links = 0
        elif name not in VOID:
            if name in ENDS:
                close(*ENDS[name])
            elif block and name != "html":
                close(("p",), ())
            if block:
                links = 0
            elif name == "a":
                links = 1
            attributes = m[4]
            full, label = name, stack[-1][2] if stack else -1
            if attributes and not attributes.isspace():
                words = [w for a in ATTRIBUTE.finditer(attributes) for w in WORD.findall((a[2] or a[3] or a[4] or a[5] or "").lower())]
                if words:
                    full = name + " " + " ".join(words)
                if labelled and (own := LABEL.search(attributes)):
                    label = int(own[1])
            if block or name == "a":
                stack.append((name, full, label))
            else:
                stack.append((name, "", label))
    flush()
    return out


_PATHS: dict[tuple[str, ...], np.ndarray] = {}


def path_buckets(path: tuple[str, ...]) -> np.ndarray:
    """Hashed tags and attribute words of a path, those of the innermost block apart."""
    found = _PATHS.get(path)
    if found is None:
        items, inner = set(), True
        for part in reversed([p for p in path if p]):
            tag, *words = part.split(" ")
            items.add(tag)
            items.update("." + w for w in words)
            if inner and tag != "a":
                items.add("@" + tag)
                inner = False
        found = np.array(sorted({zlib.crc32(x.encode()) % PATH_BUCKETS for x in items}), np.int64)
        if len(_PATHS) > 20_000:
            _PATHS.clear()
        _PATHS[path] = found
    return found


def vectors(pages: list[list[Block]]) -> list[np.ndarray]:
    """The feature vectors of each page's blocks."""
    n = sum(map(len, pages))
    x = np.zeros((n, SIZE), np.float32)
    at, own, words, shapes = [], [], [], []
    k = 0
    for page in pages:
        for i, b in enumerate(page):
            buckets = path_buckets(b.path)
            at.append(np.full(len(buckets), k))
            own.append(buckets)
            parts = b.text.lower().split(" ")
            words.append([zlib.crc32(w.strip(".,;:!?()\"'").encode()) % WORD_BUCKETS for w in parts])
            t = b.text
            chars = len(t)
            ends = sum(map(t.count, ".,;!?"))
            shapes.append((chars, len(parts), b.linked / chars, ends / len(parts), t[-1] in ".!?…", len(page), i / len(page), t[0].isupper()))
            k += 1
    if n:
        x[np.concatenate(at), np.concatenate(own)] = 1
        sizes = np.array([len(w) for w in words])
        flat = np.fromiter((v for w in words for v in w), np.int64, int(sizes.sum()))
        counts = np.bincount(np.repeat(np.arange(n), sizes) * WORD_BUCKETS + flat, minlength=n * WORD_BUCKETS).reshape(n, -1)
        x[:, PATH_BUCKETS : PATH_BUCKETS + WORD_BUCKETS] = np.log1p(counts) / np.sqrt(1 + sizes)[:, None]
        s = np.array(shapes, np.float32)
        s[:, :2] = np.log1p(s[:, :2]) / (8, 6)
        s[:, 2:4] = np.minimum(s[:, 2:4], 1)
        s[:, 5] = np.log1p(s[:, 5]) / 6
        x[:, -SHAPES:] = s
    ends = np.cumsum([len(p) for p in pages])
    return [x[e - len(p) : e] for e, p in zip(ends, pages, strict=True)]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Labeller:
    """A bidirectional LSTM with one hidden layer a direction and a logistic output."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        w = lambda *shape: (rng.standard_normal(shape) * (1.0 / np.sqrt(shape[0]))).astype(np.float32)
        self.p = {"out": w(2 * HIDDEN), "out_b": np.zeros(1, np.float32), "skip": np.zeros(SIZE, np.float32)}
        for d in "fb":
            self.p |= {f"x{d}": w(SIZE, 4 * HIDDEN), f"h{d}": w(HIDDEN, 4 * HIDDEN), f"b{d}": np.repeat(np.array([0, 1, 0, 0], np.float32), HIDDEN)}

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        """Hidden states of (pages, steps) in reading order of direction ``d``; what backward needs."""
        n, steps, _ = x.shape
        z = x.reshape(n * steps, -1) @ self.p[f"x{d}"] + self.p[f"b{d}"]
        z = z.reshape(n, steps, -1)
        h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        out, kept = np.zeros((n, steps, HIDDEN), np.float32), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            a = z[:, t] + h @ self.p[f"h{d}"]
            g = _sigmoid(a[:, : 3 * HIDDEN])
            i, f, o, u = g[:, :HIDDEN], g[:, HIDDEN : 2 * HIDDEN], g[:, 2 * HIDDEN :], np.tanh(a[:, 3 * HIDDEN :])
            m = mask[:, t, None]
            new = f * c + i * u
            tc = np.tanh(new)
            kept.append((t, h, c, i, f, o, u, tc, m))
            c = np.where(m, new, c)
            h = np.where(m, o * tc, h)
            out[:, t] = h
        return out, kept

    def forward(self, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, dict]:
        hf, kf = self._run(x, mask, "f")
        hb, kb = self._run(x, mask, "b")
        h = np.concatenate([hf, hb], 2)
        return _sigmoid(h @ self.p["out"] + x @ self.p["skip"] + self.p["out_b"]), {"h": h, "f": kf, "b": kb}

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, kept = self.forward(x, mask)
        err = ((p - y) * mask / mask.sum()).astype(np.float32)
        g = {"out": np.einsum("nt,nth->h", err, kept["h"]), "out_b": np.array([err.sum()], np.float32), "skip": np.einsum("nt,ntd->d", err, x)}
        for d, own in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, None))):
            dout = err[:, :, None] * self.p["out"][own]
            dz = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
            dh, dc, gh = np.zeros_like(dout[:, 0]), np.zeros_like(dout[:, 0]), np.zeros_like(self.p[f"h{d}"])
            for t, h, c, i, f, o, u, tc, m in reversed(kept[d]):
                total = dh + dout[:, t]
                live = total * m
                cell = dc * m + live * o * (1 - tc * tc)
                da = np.concatenate([cell * u * i * (1 - i), cell * c * f * (1 - f), live * tc * o * (1 - o), cell * i * (1 - u * u)], 1)
                dz[:, t] = da
                gh += h.T @ da
                dh = da @ self.p[f"h{d}"].T + total * (1 - m)
                dc = cell * f + dc * (1 - m)
            g |= {f"x{d}": x.reshape(-1, SIZE).T @ dz.reshape(-1, 4 * HIDDEN), f"h{d}": gh, f"b{d}": dz.sum((0, 1))}
        return g

    def train(self, pages: list[np.ndarray], labels: list[np.ndarray], epochs: int = 9, batch: int = 24, rate: float = 0.01, seed: int = 9) -> None:
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(v) for k, v in self.p.items()}
        t = 0
        for epoch in range(epochs):
            order = rng.permutation(len(pages))
            for s in range(0, len(order), batch):
                x, mask, y = pad([pages[i] for i in order[s : s + batch]], [labels[i] for i in order[s : s + batch]])
                t += 1
                for k, g in self.gradients(x, mask, y).items():
                    g = np.clip(g, -1, 1) + 1e-5 * self.p[k]
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] = (self.p[k] - rate * (0.3 if epoch > epochs - 3 else 1) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Whether each block of each page is article."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        s = 0
        while s < len(order):
            e = s + 1
            while e < len(order) and e - s < 128 and len(pages[order[e]]) * (e - s + 1) <= 20_000:
                e += 1
            x, mask, _ = pad([pages[i] for i in order[s:e]])
            p, _ = self.forward(x, mask)
            for k, i in enumerate(order[s:e]):
                out[i] = p[k, : len(pages[i])] >= 0.5
            s = e
        return out


def pad(pages: list[np.ndarray], labels: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = max(map(len, pages))
    x, mask, y = np.zeros((len(pages), n, SIZE), np.float32), np.zeros((len(pages), n), np.float32), np.zeros((len(pages), n), np.float32)
    for i, page in enumerate(pages):
        x[i, : len(page)] = page
        mask[i, : len(page)] = 1
        if labels is not None:
            y[i, : len(page)] = labels[i]
    return x, mask, y


# --- generated training pages -------------------------------------------------------------

MENU = "home about contact news products services blog shop help login register search archive sports world politics business careers press team events support account".split()
JUNK = "cookies we use accept privacy policy settings consent subscribe newsletter email sign up share tweet follow advertisement sponsored read more related posts popular copyright all rights reserved terms powered by comments reply leave a comment name posted on next previous".split()


class Pages:
    """Random pages; every text is inside an element with data-y=1 (article) or 0."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        r = self.r
        return "".join(r.choice(("an", "er", "on", "th", "ti", "in", "re", "es", "ou", "ea", "ly", "st", "en", "de", "la", "é", "ó", "ü", "ch", "sch", "ung", "que", "os", "k", "m", "p", "l", "s", "t")) for _ in range(r.randint(1, 4)))

    def sentence(self, low: int = 4, high: int = 18) -> str:
        words = [self.word() if self.r.random() < 0.8 else self.r.choice(("the", "of", "and", "to", "a", "in", "is", "it", *JUNK)) for _ in range(self.r.randint(low, high))]
        return " ".join(words).capitalize() + self.r.choice("....!?")

    def prose(self) -> str:
        r = self.r
        out = " ".join(self.sentence() for _ in range(r.choice((1, 1, 2, 3, 4, 6, 9))))
        if r.random() < 0.15:
            out = out[:-1]
        if r.random() < 0.1:
            out = self.sentence(1, 3)
        if r.random() < 0.15:
            k = r.randint(0, len(out))
            out = f"{out[:k]}<a href=/x>{self.word()}</a> {out[k:]}"
        return out

    def attrs(self, *words: str) -> str:
        r = self.r
        chosen = r.choice(words) if words else ""
        if not chosen or r.random() < 0.1:
            chosen = self.word() if r.random() < 0.5 else ""
        if not chosen:
            return ""
        if r.random() < 0.3:
            chosen += r.choice(("-", "_", " ")) + r.choice(("wrap", "box", "inner", "main", "1", "container", "block", "top", "list"))
        return f' {r.choice(("class", "class", "class", "id"))}="{chosen}"'

    def links(self, low: int = 3, high: int = 9) -> str:
        r = self.r
        texts = [r.choice(MENU) if r.random() < 0.5 else self.word() for _ in range(r.randint(low, high))]
        if r.random() < 0.75:
            return "<ul>" + "".join(f'<li{" class=item" if r.random() < 0.2 else ""}><a href="/{t}">{t}</a></li>' for t in texts) + "</ul>"
        return r.choice((" | ", " ")).join(f'<a href="/{t}">{t}</a>' for t in texts)

    def junk(self, low: int = 2, high: int = 10) -> str:
        r = self.r
        return " ".join(r.choice(JUNK) if r.random() < 0.6 else self.word() for _ in range(r.randint(low, high))).capitalize()

    def menu(self) -> str:
        r = self.r
        tag = r.choice(("nav", "nav", "nav", "div", "ul", "header"))
        return f"<{tag} data-y=0{self.attrs('menu', 'nav', 'navbar', 'navigation', 'topnav', 'breadcrumbs', 'breadcrumb') if tag != 'nav' or r.random() < 0.3 else ''}>{self.links()}</{tag}>"

    def header(self) -> str:
        return f"<header data-y=0{self.attrs('header', 'masthead', 'site-header', 'top')}><div>{self.sentence(1, 6)}</div>{self.links() if self.r.random() < 0.5 else ''}</header>"

    def advert(self) -> str:
        r = self.r
        tag = r.choice(("div", "div", "div", "aside", "section", "p"))
        return f"<{tag} data-y=0{self.attrs('ad', 'ad', 'ads', 'advert', 'advertisement', 'sponsor', 'sponsored', 'promo', 'banner')}>{self.junk() if r.random() < 0.3 else self.sentence() if r.random() < 0.6 else self.prose()}</{tag}>"

    def notice(self) -> str:
        r = self.r
        tag = r.choice(("div", "div", "section", "aside", "dialog"))
        return f"<{tag} data-y=0{self.attrs('cookie', 'cookies', 'consent', 'notice', 'gdpr', 'alert', 'popup', 'modal', 'paywall')}><p>{self.junk(4, 20) if r.random() < 0.6 else self.prose()}</p>{'<button>ok</button>' if r.random() < 0.5 else ''}</{tag}>"

    def form(self) -> str:
        r = self.r
        inner = f"<label>{self.junk(1, 4)}</label><input name=x><p>{self.junk(2, 8) if r.random() < 0.6 else self.sentence()}</p><button>{r.choice(('send', 'submit', 'search', 'go', 'sign up'))}</button>"
        return f"<form data-y=0{self.attrs('form', 'search', 'newsletter', 'subscribe', 'login', 'signup')}>{inner}</form>" if r.random() < 0.8 else f"<div data-y=0{self.attrs('newsletter', 'subscribe', 'signup', 'search', 'form')}>{inner}</div>"

    def sidebar(self) -> str:
        r = self.r
        tag = r.choice(("aside", "aside", "div", "section"))
        body = "".join(r.choice((lambda: f"<h3>{self.junk(1, 4)}</h3>", lambda: self.links(2, 6), lambda: f"<p>{self.prose()}</p>"))() for _ in range(r.randint(1, 4)))
        return f"<{tag} data-y=0{self.attrs('sidebar', 'sidebar', 'side', 'widget', 'related', 'popular', 'recommended', 'rail')}>{body}</{tag}>"

    def share(self) -> str:
        return f"<div data-y=0{self.attrs('share', 'social', 'related', 'tags', 'author', 'meta', 'byline', 'toolbar')}>{self.links(2, 5) if self.r.random() < 0.6 else self.junk(1, 5)}</div>"

    def comments(self) -> str:
        r = self.r
        tag, inner = r.choice(("div", "section", "ol", "aside")), ("li" if r.random() < 0.3 else "div")
        body = "".join(f"<{inner}{self.attrs('comment', 'reply', 'response')}><p>{self.prose()}</p>{'<span>' + self.junk(1, 3) + '</span>' if r.random() < 0.4 else ''}</{inner}>" for _ in range(r.randint(1, 6)))
        return f"<{tag} data-y=0{self.attrs('comments', 'comments', 'discussion', 'responses', 'replies', 'respond')}>{'<h3>Comments</h3>' if r.random() < 0.6 else ''}{body}</{tag}>"

    def footer(self) -> str:
        r = self.r
        tag = r.choice(("footer", "footer", "footer", "div"))
        text = r.choice(("&copy; ", "&copy; ", "© 2020 ", "")) + self.word() + r.choice((".com", ".org", "")) + r.choice((" &middot; ", " - ", " ")) + r.choice((self.sentence(), self.junk(), self.prose()))
        return f"<{tag} data-y=0{self.attrs('footer', 'foot', 'bottom', 'site-footer', 'copyright') if tag == 'div' or r.random() < 0.3 else ''}>{f'<p>{text}</p>' if r.random() < 0.4 else text}{self.links(2, 5) if r.random() < 0.3 else ''}</{tag}>"

    def article(self) -> str:
        r = self.r
        body, end = "", "</p>" if r.random() < 0.8 else ""
        if r.random() < 0.85:
            h = r.choice(("h1", "h1", "h1", "h2"))
            body += r.choice(("{}", "{}", "<header>{}</header>")).format(f"<{h}>{self.sentence(2, 10) if r.random() < 0.6 else self.prose()}</{h}>")
        bold = r.random() < 0.3
        for _ in range(r.choice((0, 1, 1, 2, 3, 4, 6, 9, 14))):
            kind = r.random()
            if kind < 0.78:
                body += f"<p>{'<b>' if bold and r.random() < 0.4 else ''}{self.prose()}{'<br>' if bold and r.random() < 0.4 else end}"
            elif kind < 0.84:
                body += f"<h{r.choice('23')}>{self.sentence(1, 6)[:-1]}</h2>"
            elif kind < 0.89:
                body += "<ul>" + "".join(f"<li>{self.prose()}</li>" for _ in range(r.randint(1, 4))) + "</ul>"
            elif kind < 0.92:
                body += f"<blockquote>{self.prose()}</blockquote>"
            elif kind < 0.94:
                body += "<table>" + "".join(f"<tr><td>{self.word()}</td><td>{self.sentence(1, 4)}</td></tr>" for _ in range(r.randint(1, 3))) + "</table>"
            elif kind < 0.96:
                body += f"<pre>{self.sentence()}</pre>"
            else:
                body += "</p>" + r.choice((self.advert, self.share, self.form))()
        for outer in r.choice((["article"], ["article"], ["article"], ["main"], ["main", "article"], ["div*"], ["div*"], ["section*"], ["div*", "article"], ["div*", "div*"], ["article", "div*"])):
            tag = outer.rstrip("*")
            words = self.attrs("content", "content", "post", "article", "entry", "story", "text", "body", "main") if outer[-1] == "*" or r.random() < 0.3 else ""
            body = f"<{tag} data-y=1{words}>{body}</{tag}>"
        return body

    def page(self) -> str:
        r = self.r
        title = self.sentence(2, 10)
        maybe = lambda p, f: f() if r.random() < p else ""
        head = f'<!DOCTYPE html><html lang="en"><head data-y=0><meta charset="utf-8"><title>{title}</title><style>p{{margin:0}}</style><script>var t="</p>";track(1);</script></head><body data-y=0{self.attrs() if r.random() < 0.2 else ""}>'
        before = [maybe(0.15, self.notice), maybe(0.3, self.header), maybe(0.75, self.menu), maybe(0.4, self.advert), maybe(0.15, self.form), maybe(0.15, self.sidebar)]
        after = [maybe(0.15, self.share), maybe(0.3, self.comments), maybe(0.3, self.sidebar), maybe(0.2, self.advert), maybe(0.2, self.form)]
        if r.random() < 0.3:
            r.shuffle(before)
            r.shuffle(after)
        article = self.article() if r.random() < 0.96 else ""
        whole = head + "".join(before) + article + "".join(after) + maybe(0.85, self.footer) + maybe(0.1, self.notice) + "</body></html>"
        if r.random() < 0.3 and article:
            whole = whole.replace(article, f"<div{self.attrs('page', 'wrapper', 'container', 'layout')}>{article}</div>")
        return whole[: r.randint(len(whole) // 3, len(whole))] if r.random() < 0.12 else whole


_TRAINED: dict[int, Labeller] = {}


def trained(pages: int = TRAINING_PAGES) -> Labeller:
    """The labeller of ``pages`` generated pages, fitted once a process."""
    if pages not in _TRAINED:
        make = Pages(17)
        cut = [b for b in (blocks_of(make.page(), labelled=True) for _ in range(pages)) if b]
        model = Labeller()
        model.train(vectors(cut), [np.array([max(b.label, 0) for b in page], np.float32) for page in cut])
        _TRAINED[pages] = model
    return _TRAINED[pages]


def main_texts(pages: list[str | None], model: Labeller) -> list[str]:
    cut = [blocks_of(p) if p else [] for p in pages]
    return ["\n".join(b.text for b, y in zip(page, keep, strict=True) if y) for page, keep in zip(cut, model.label(vectors(cut)), strict=True)]


def extract_text(pages: DataFrame, html: str = "html", into: str = "text") -> DataFrame:
    """``pages`` with the main text of each page."""
    small_batches(pages.sparkSession)
    sent = pages.sparkSession.sparkContext.broadcast(trained())

    @F.arrow_udf(T.StringType())
    def extracted(column: pa.Array) -> pa.Array:
        model = sent.value
        out: list[str] = []
        for s in range(0, len(column), 256):
            out += main_texts(column.slice(s, 256).to_pylist(), model)
        return pa.array(out, pa.string())

    return pages.withColumn(into, extracted(col(pages, html)))
