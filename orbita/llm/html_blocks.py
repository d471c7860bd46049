"""HTML main-text extraction: a recurrent block labeller.

A page is read into leaf blocks in page order: text between the boundaries of
block elements, with the path of open elements above it.  Each block becomes a
vector -- hashed tags, classes and ids of its path, hashed words, and some
shape figures -- and a bidirectional LSTM in numpy reads the whole sequence, so
every block is labelled in the context of its document.  Blocks labelled as
main text are joined by newlines.

The labeller is trained here, on a bounded sample of ``sample`` different pages (those with
an article or main element first, then by hash of the html; of each the first 200 blocks, of
variants 40 article blocks): where a page marks its article, blocks inside are main text
and others aren't.  To each sampled page come variants, made from a parameterised
set of page parts -- menus, notices, sidebars, forms, comments, adverts in and
around articles of several markups, and with marks left out.

Block rules: character references are decoded, white space inside a block is
one space, blocks are trimmed, empty ones go; scripts, styles, templates, drawings and
comments have no text, and what stands in a script or style is no markup; one of the
others that is left open is passed over; ``br`` is white space; an open ``p`` or ``li`` ends where
the next begins.

Defined results: null or empty html gives empty text; pages without blocks
too; broken markup is read as far as it goes, in time linear in its length; a ``<`` after the
last ``>`` is text; where no page marks its article, the variants are made of blocks that
look like text, and where there are none of these nothing is main text; repeated pages
are read each, equal pages alike; pages of any length are read whole, in bounded
batches of blocks; empty tables give no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from bisect import bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<([!?])[^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>])*+)>|([^<]+|<)", re.S)
REST = re.compile(r"(?:<!--.*|()()()()(.+))\Z", re.S)
NAMED = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
RAW = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>?|\Z", re.I) for t in ("script", "style")}
HIDDEN = {"script", "style", "template", "noscript", "svg", "iframe", "object", "canvas"}
#: Hidden elements that hold none of their kind: a second one says that the first was left open.
FLAT = {"noscript", "iframe"}
#: What can't stand in a drawing, and so ends one that was left open.
LEAVES_SVG = {"article", "aside", "blockquote", "body", "center", "dd", "div", "dl", "dt", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "tbody", "td", "th", "tr", "ul"}
SECTIONS = {"article", "section", "div", "main", "body", "aside", "nav"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
BOUNDS = {"li": {"ul", "ol"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}}
AWAY = {"nav", "header", "footer", "aside", "form", "title", "button", "select", "menu", "dialog", "head"}
AWAY_NAMES = re.compile(r"(?:^|[-_ ])(?:ad|ads|advert\w*|banner|comments?|cookie\w*|footer|header|menu|nav\w*|notice\w*|popup|promo\w*|related|share|sidebar|social|sponsor\w*|subscribe|widget|breadcrumbs?)(?:$|[-_ ])", re.I)

WORDS_, PATHS, SHAPE, HIDDEN_UNITS = 48, 64, 8, 20
SAMPLE, SAMPLE_CHARS, ROUNDS, SEED = 160, 200_000, 12, 7
PART, CELLS, DEPTH = 4096, 16_384, 64  # blocks that are made vectors of at once; blocks of a batch; elements of a path


class Block:
    __slots__ = ("path", "text", "links")

    def __init__(self, path, text, links):
        self.path, self.text, self.links = path, text, links


class Open:
    """Open elements, with the places of each tag, so that none is looked for by going through them."""

    def __init__(self):
        self.path: list[tuple[str, str]] = []
        self.places: dict[str, list[int]] = {}

    def push(self, tag: str, names: str) -> None:
        self.places.setdefault(tag, []).append(len(self.path))
        self.path.append((tag, names))

    def cut(self, at: int) -> None:
        for tag, _ in self.path[at:]:
            self.places[tag].pop()
        del self.path[at:]

    def last(self, tag: str) -> int:
        """Place of the innermost one, or -1."""
        return own[-1] if (own := self.places.get(tag)) else -1

    def first_above(self, tags: set[str], bounds: set[str]) -> int:
        """Place of the outermost of these tags that stands inside the innermost bound; the end, if none does."""
        bound = max(map(self.last, bounds), default=-1)
        found = len(self.path)
        for tag in tags:
            own = self.places.get(tag, [])
            if (k := bisect_right(own, bound)) < len(own):
                found = min(found, own[k])
        return found


def blocks(page: str) -> list[Block]:
    """Leaf blocks; path is a tuple of (tag, names) of open elements that aren't inline.

    A hidden element ends at its own closing tag, and a drawing also at a block that can't stand in
    one.  Where an element around it or the page ends first it was left open: then its tag alone is
    skipped, and what follows is read again, once.
    """
    out: list[Block] = []
    opened = Open()
    parts: list[str] = []
    links, in_link = 0, 0
    hidden, inner = "", []  # the hidden element that is open, and where its content and that of its kind in it begin
    ends_at: dict[str, int] = {}
    passed: set[int] = set()  # contents of elements that were left open

    def flush():
        nonlocal links
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                path = opened.path if len(opened.path) <= DEPTH else opened.path[: DEPTH // 4] + opened.path[-(DEPTH - DEPTH // 4) :]
                out.append(Block(tuple(path), text, links / max(1, len(text))))
            parts.clear()
        links = 0

    def closed_after(tag: str, at: int) -> bool:
        if tag not in ends_at:
            ends_at[tag] = max((m.start() for m in re.finditer(rf"</{tag}(?=[\s/>])", page, re.I)), default=-1)
        return ends_at[tag] >= at

    at, last = 0, page.rfind(">")
    while True:
        m = TOKEN.match(page, at) if at <= last else REST.match(page, at)  # no tag begins after the last >
        if m is None:
            if not hidden:
                break
            passed.update(inner)
            at, hidden, inner = inner[0], "", []
            continue
        at = m.end()
        _, close, tag, rest, text = m.groups()
        tag = tag or None
        if text is not None:
            if not hidden:
                parts.append(text)
                if in_link:
                    links += len(text)
            continue
        if tag is None:
            continue
        tag = tag.lower()
        if tag in RAW and not close and not rest.endswith("/"):  # no markup inside: on to its closing tag
            at = RAW[tag].search(page, at).end()
            continue
        if hidden:
            if tag == hidden and close:
                inner.pop()
                hidden = hidden if inner else ""
            elif tag == hidden and hidden not in FLAT:
                if not rest.endswith("/"):
                    inner.append(at)
            elif tag == hidden or (close and opened.last(tag) >= 0):  # it was left open
                passed.update(inner)
                at, hidden, inner = inner[0], "", []
            if not (hidden == "svg" and not close and tag in LEAVES_SVG):
                continue
            hidden, inner = "", []
        if tag in INLINE:
            if tag == "br":
                parts.append("\n")
            elif tag == "a":
                in_link = 0 if close else 1
            continue
        if tag in HIDDEN:
            if not close and not rest.endswith("/") and at not in passed and (tag == "svg" or closed_after(tag, at)):
                hidden, inner = tag, [at]
            continue
        flush()
        in_link = 0
        if close:
            if (place := opened.last(tag)) >= 0:
                opened.cut(place)
            continue
        if ends := CLOSES.get(tag, {"p"} if tag not in VOID else set()):
            opened.cut(opened.first_above(ends, BOUNDS.get(tag, set()) | SECTIONS))
        if tag not in VOID and not rest.endswith("/"):
            names = " ".join(a or b or c for a, b, c in NAMED.findall(rest)) if rest else ""
            opened.push(tag, names.lower())
    flush()
    return out


def marked(page: list[Block]) -> list[int] | None:
    """Labels where a page marks its article; None where it doesn't."""
    if not any(t in ("article", "main") for b in page for t, _ in b.path):
        return None
    out = []
    for b in page:
        inside = next((i for i, (t, _) in enumerate(b.path) if t in ("article", "main")), None)
        out.append(int(inside is not None and not any(t in AWAY or (n and AWAY_NAMES.search(n)) for t, n in b.path[inside + 1 :])))
    return out


def _slot(kind: str, name: str, size: int) -> tuple[int, float]:
    h = zlib.crc32(f"{kind}:{name}".encode())
    return h % size, 1.0 if h >> 31 else -1.0


@lru_cache(200_000)
def _word(w: str) -> int:
    """Slot of a word; those of negative sign come second."""
    s, sign = _slot("w", w, WORDS_)
    return s if sign > 0 else s + WORDS_


@lru_cache(20_000)
def _path(path: tuple) -> np.ndarray:
    v = np.zeros(PATHS, np.float32)
    for depth, (tag, names) in enumerate(path):
        for name in [tag, *re.split(r"[\s_-]+", names)] if names else [tag]:
            for kind in "tl" if depth == len(path) - 1 else "t":
                s, sign = _slot(kind, name, PATHS)
                v[s] += sign
    return v


def vectors(pages: list[list[Block]]) -> list[np.ndarray]:
    """(blocks, features) of each page."""
    every = [b for page in pages for b in page]
    if not every:
        return [np.zeros((0, PATHS + WORDS_ + SHAPE), np.float32) for _ in pages]
    place = np.concatenate([np.arange(len(p)) for p in pages]).astype(np.float32)
    long = np.concatenate([np.full(len(p), len(p)) for p in pages]).astype(np.float32)
    parts = [_vectors(every[at : at + PART], place[at : at + PART], long[at : at + PART]) for at in range(0, len(every), PART)]
    return np.split(np.concatenate(parts), np.cumsum([len(p) for p in pages])[:-1])


def _vectors(every: list[Block], place: np.ndarray, long: np.ndarray) -> np.ndarray:
    codes, uses, sizes = [], [], []
    for b in every:
        words = b.text.lower().split()
        own = set(words)
        codes += map(_word, own)
        uses.append(len(own))
        sizes.append((len(words), len(b.text), b.links, b.text.count(".") + b.text.count(",") + b.text.count(";"), len(b.path)))
    rows = np.repeat(np.arange(len(every)), uses)
    votes = np.bincount(rows * 2 * WORDS_ + np.array(codes), minlength=len(every) * 2 * WORDS_).reshape(-1, 2 * WORDS_)
    n, chars, links, stops, depth = np.array(sizes, np.float32).T
    shape = np.stack([np.log1p(n) / 5, np.log1p(chars) / 7, np.minimum(1, links), stops / (1 + n), depth / 8, place / long, 1 / (1 + place), 1 / (long - place)], 1)
    return np.concatenate([np.stack([_path(b.path) for b in every]), (votes[:, :WORDS_] - votes[:, WORDS_:]) / np.sqrt(1 + n)[:, None], shape], 1).astype(np.float32)


class Lstm:
    """One bidirectional layer and a logistic output."""

    def __init__(self, size: int, units: int, seed: int):
        rng = np.random.default_rng(seed)
        self.units = units
        self.w = {}
        for d in "fb":
            self.w[f"x{d}"] = rng.normal(0, 1 / np.sqrt(size), (size, 4 * units))
            self.w[f"h{d}"] = rng.normal(0, 1 / np.sqrt(units), (units, 4 * units))
            self.w[f"c{d}"] = np.r_[np.zeros(units), np.ones(units), np.zeros(2 * units)]  # gates: in, forget, out, new
        self.w["o"] = rng.normal(0, 0.3, 2 * units + size)
        self.w["ob"] = np.zeros(1)

    def _pass(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool):
        """x (steps, batch, size) -> hidden states; what backward needs, if kept."""
        u = self.units
        steps, batch, _ = x.shape
        h, c = np.zeros((batch, u), x.dtype), np.zeros((batch, u), x.dtype)
        wx, wc = self.w[f"x{d}"].astype(x.dtype), self.w[f"c{d}"].astype(x.dtype)
        pre, low = None, 0  # of some steps at a time
        wh = self.w[f"h{d}"].astype(x.dtype)
        out, kept = np.zeros((steps, batch, u), x.dtype), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            if pre is None or not low <= t < low + len(pre):
                low = t - t % PART
                pre = x[low : low + PART] @ wx + wc
            g = pre[t - low] + h @ wh
            s = 1 / (1 + np.exp(-np.clip(g[:, : 3 * u], -30, 30)))
            i, f, o, n = s[:, :u], s[:, u : 2 * u], s[:, 2 * u :], np.tanh(g[:, 3 * u :])
            m = mask[t][:, None]
            c2 = np.where(m, f * c + i * n, c)
            tc = np.tanh(c2)
            h2 = np.where(m, o * tc, h)
            if keep:
                kept.append((t, h, c, i, f, o, n, tc, m))
            h, c = h2, c2
            out[t] = h2
        return out, kept

    def _back(self, grad: np.ndarray, x: np.ndarray, kept: list, d: str, into: dict) -> None:
        u = self.units
        dh, dc = np.zeros(grad.shape[1:]), np.zeros(grad.shape[1:])
        for t, h, c, i, f, o, n, tc, m in reversed(kept):
            dh = dh + grad[t]
            live = np.where(m, dh, 0)
            do, dcn = live * tc, np.where(m, dc, 0) + live * o * (1 - tc**2)
            g = np.concatenate([dcn * n * i * (1 - i), dcn * c * f * (1 - f), do * o * (1 - o), dcn * i * (1 - n**2)], 1)
            into[f"x{d}"] += x[t].T @ g
            into[f"h{d}"] += h.T @ g
            into[f"c{d}"] += g.sum(0)
            dh = np.where(m, g @ self.w[f"h{d}"].T, dh)
            dc = np.where(m, dcn * f, dc)

    def _margins(self, x, mask, keep=False):
        f, kf = self._pass(x, mask, "f", keep)
        b, kb = self._pass(x, mask, "b", keep)
        if not keep:
            o, u = self.w["o"].astype(x.dtype), self.units
            return f @ o[:u] + b @ o[u : 2 * u] + x @ o[2 * u :] + self.w["ob"].astype(x.dtype), None, None, None
        every = np.concatenate([f, b, x], 2)
        return every @ self.w["o"].astype(x.dtype) + self.w["ob"].astype(x.dtype), every, kf, kb

    def fit(self, pages: list[np.ndarray], labels: list[np.ndarray], rounds: int, seed: int, batch: int = 16, rate: float = 0.01) -> Lstm:
        """Adam on the mean logistic loss."""
        rng = np.random.default_rng(seed)
        m1, m2, step = {k: 0.0 for k in self.w}, {k: 0.0 for k in self.w}, 0
        for _ in range(rounds):
            order = rng.permutation(len(pages))
            for at in range(0, len(order), batch):
                x, mask = padded([pages[i] for i in order[at : at + batch]])
                y, _ = padded([labels[i][:, None] for i in order[at : at + batch]])
                z, every, kf, kb = self._margins(x, mask, True)
                err = np.where(mask, 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[:, :, 0], 0) / mask.sum()
                grads = {k: np.zeros_like(v) for k, v in self.w.items()}
                grads["o"], grads["ob"] = np.einsum("tb,tbf->f", err, every), err.sum(keepdims=True)[0]
                u = self.units
                self._back(err[:, :, None] * self.w["o"][:u], x, kf, "f", grads)
                self._back(err[:, :, None] * self.w["o"][u : 2 * u], x, kb, "b", grads)
                step += 1
                for k, g in grads.items():
                    g = np.clip(g, -1, 1)
                    m1[k] = 0.9 * m1[k] + 0.1 * g
                    m2[k] = 0.99 * m2[k] + 0.01 * g * g
                    self.w[k] = self.w[k] - rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)
        return self

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """For each page whether its blocks are main text; pages of like length advance together."""
        out: list = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        while order:  # a batch holds CELLS blocks at most, padding included, or one page
            take = 1
            while take < min(64, len(order)) and (take + 1) * len(pages[order[take]]) <= CELLS:
                take += 1
            some, order = order[:take], order[take:]
            x, mask = padded([pages[i] for i in some])
            z = self._margins(x, mask)[0]
            for k, i in enumerate(some):
                out[i] = z[: len(pages[i]), k] > 0
        return out


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, pages))
    x = np.zeros((steps, len(pages), pages[0].shape[1]), np.float32)
    mask = np.zeros((steps, len(pages)), bool)
    for k, p in enumerate(pages):
        x[: len(p), k], mask[: len(p), k] = p, True
    return x, mask


# Parts of training variants: (path under the container, number of blocks).
PARTS = [
    [("nav", ""), ("ul", "menu"), ("li", "")], [("header", "site-header"), ("div", "logo"), ("p", "")], [("div", "cookie-notice"), ("p", "")], [("aside", "sidebar"), ("p", "")],
    [("aside", ""), ("ul", "related"), ("li", "")], [("form", "subscribe"), ("div", "")], [("form", ""), ("p", "")], [("section", "comments"), ("div", "comment"), ("p", "")],
    [("div", "comments"), ("p", "")], [("ol", "comment-list"), ("li", "comment"), ("p", "")], [("div", "ad"), ("p", "")], [("div", "advert sponsored"), ("p", "")], [("footer", ""), ("p", "")],
    [("div", "footer"), ("p", "")], [("div", "share social"), ("p", "")], [("div", "breadcrumbs"), ("p", "")], [("div", "sidebar widget"), ("h3", "")], [("div", "notice"), ("p", "")], [("div", "menu"), ("p", "")], [("div", "header"), ("p", "")],
]
BODIES = [[("article", "")], [("main", ""), ("article", "")], [("main", "")], [("div", "content")], [("div", "post entry-content")], [("article", "post"), ("div", "article-body")], [("div", "main-content"), ("section", "")], [("div", "article")], []]


def variant(page: list[Block], label: list[int], texts: list[str], rng: random.Random) -> tuple[list[Block], list[int]]:
    """The article in another body, with other parts around and inside it."""
    body = (("html", ""), ("body", ""), *([("div", "wrap")] if rng.random() < 0.3 else []))
    inner = (*body, *rng.choice(BODIES))
    article = [Block((*inner, b.path[-1] if b.path[-1][0] not in ("article", "main") else ("p", "")), b.text, b.links) for b, y in zip(page, label, strict=True) if y][:40]

    def part(under):
        path = (*under, *rng.choice(PARTS))
        return [Block(path, " ".join(rng.choice(texts).split()[: rng.choice((2, 5, 12, 40))]) or "x", rng.choice((0, 0, 0.9))) for _ in range(rng.choice((1, 2, 4)))]

    out = [(Block((("html", ""), ("head", ""), ("title", "")), page[0].text[:60], 0.0), 0)]
    for _ in range(rng.randint(1, 3)):
        out += [(b, 0) for b in part(body)]
    for b in article:
        if rng.random() < 0.15:
            out += [(x, 0) for x in part(inner)]
        out.append((b, 1))
    for _ in range(rng.choice((0, 1, 2))):
        out += [(x, 0) for x in part(inner)]
    for _ in range(rng.randint(1, 3)):
        out += [(b, 0) for b in part(body)]
    return [b for b, _ in out], [y for _, y in out]


def plausible(page: list[Block]) -> list[int]:
    """Labels where nothing is marked: blocks of eight words or more, hardly linked, that aren't under another part's name."""
    return [int(len(b.text.split()) >= 8 and b.links < 0.3 and not any(t in AWAY or (n and AWAY_NAMES.search(n)) for t, n in b.path)) for b in page]


def train(pages: list[str], variants: int = 3) -> Lstm | None:
    """None where no page has any text to learn from."""
    rng = random.Random(SEED)
    split = [b for b in map(blocks, pages) if b]
    read = [(b, y) for b in split if (y := marked(b)) and any(y)]
    own = [(b[:200], y[:200]) for b, y in read]
    if not read:  # no page marks its article: only variants, of what looks like text
        read = [(b, y) for b in split if any(y := plausible(b))]
    if not read:
        return None
    texts = [x.text for b, _ in read for x in b]
    some = own + [variant(b, y, texts, rng) for b, y in read for _ in range(variants)]
    xs, ys = vectors([b for b, _ in some]), [np.array(y, np.float32) for _, y in some]
    return Lstm(PATHS + WORDS_ + SHAPE, HIDDEN_UNITS, SEED).fit(xs, ys, max(ROUNDS, ROUNDS * SAMPLE // (2 * len(read))) if len(read) < SAMPLE // 2 else ROUNDS, SEED)


def main_texts(pages: list[str], model: Lstm | None) -> list[str]:
    out: list[str] = []
    held: list[list[Block]] = []

    def label() -> None:
        kept = model.label(vectors(held)) if model else [np.array(plausible(b), bool) for b in held]
        out.extend("\n".join(b.text for b, k in zip(page, keep, strict=True) if k) for page, keep in zip(held, kept, strict=True))
        held.clear()

    for page in pages:
        held.append(blocks(page) if page else [])
        if sum(map(len, held)) >= CELLS:
            label()
    label()
    return out


def fit(pages: DataFrame, sample: int = SAMPLE) -> Lstm | None:
    """Train on the driver on a bounded sample of different pages of at most ``SAMPLE_CHARS`` characters.

    Pages with an article or main element come first, then the others, each by hash of
    the html.  The hashes are ranked first, so no page but the chosen ones leaves its
    executor, and a page with many copies is one page.
    """
    some = pages.filter(f"html != '' and char_length(html) <= {SAMPLE_CHARS}").select("html", F.xxhash64("html").alias("h"))
    unmarked = (~F.col("html").rlike(r"(?i)<(?:article|main)[\s>]")).cast("int")
    ranked = some.groupBy("h").agg(F.min(unmarked).alias("unmarked")).orderBy("unmarked", "h").limit(sample)
    chosen = [r["h"] for r in ranked.collect()]
    rows = some.filter(F.col("h").isin(chosen)).groupBy("h").agg(F.min("html").alias("html")).collect()
    return train(sorted(r["html"] for r in rows))


def extracted(pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    shipped = pages.sparkSession.sparkContext.broadcast(fit(pages, sample))

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 64):
                some = b.slice(at, 64)
                texts = main_texts([h or "" for h in some.column(2).to_pylist()], shipped.value)
                yield pa.record_batch([some.column(0), some.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.selectExpr("cast(page_id as long) as page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
