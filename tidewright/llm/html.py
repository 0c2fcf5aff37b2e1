"""Main text of web pages by a recurrent block labeller.

A page becomes a sequence of leaf blocks, each with the path of tags above it. A bidirectional LSTM in numpy reads vectors of the
hashed path and of the hashed words, block by block, and labels every block with the whole page as context. It is trained here, on
pages that :func:`sample_page` writes, whose labels are known.
"""

from __future__ import annotations

import functools
import html as entities
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm import textnum as tn

PATHS, WORDS, WIDTH, HIDDEN, NUMBERS = 4096, 4096, 16, 24, 5
TRAIN_PAGES, EPOCHS, BATCH, SEED = 1600, 6, 32, 11
#: Elements that begin a block, whose content is no text, that have no end tag, and that end the open one of their kind.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
RAW = "script|style|noscript|template|iframe|textarea|svg|title"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ENDS = {"p": BLOCKS - {"body", "html"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "option": {"option"}}
SCOPE = frozenset("ul ol dl table select div section article aside nav".split())

#: The rest of a tag: quoted values of any length are skipped whole, and nothing is tried twice.
_ATTRS = r"""(?:[^<>"']++|"[^"]*+"|'[^']*+')*+"""
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<svg(?=[\s/>]){_ATTRS}(?<=/)>|<(?P<raw>{RAW})(?=[\s/>])(?:{_ATTRS}>|[^>]*>).*?(?:</(?P=raw)\s*>|\Z)|<[!?][^>]*(?:>|\Z)"
    rf"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>{_ATTRS})>|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)",
    re.S | re.I,
)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_PART = re.compile(r"[a-z]+")


@functools.lru_cache(1 << 14)
def _tokens(tag: str, attrs: str) -> tuple[int, ...]:
    """Hashed tag and parts of its class, id and role."""
    names = {p for m in _NAMED.finditer(attrs) for p in _PART.findall("".join(x or "" for x in m.groups()).lower())}
    return tuple(zlib.crc32(x.encode()) % PATHS for x in (tag, *(f".{n}" for n in sorted(names))))


def leaves(page: str) -> list[tuple[list[int], str, float]]:
    """(hashed path, text, share of it in links) of each block with text, in page order."""
    out: list[tuple[list[int], str, float]] = []
    stack: list[tuple[str, tuple[int, ...]]] = []
    held: list[str] = []
    linked, in_link, at = 0, 0, 0

    def flush() -> None:
        nonlocal linked
        if held:
            text = "".join(held)
            held.clear()
            text = " ".join((entities.unescape(text) if "&" in text else text).split())
            if text:
                out.append(([t for _, ts in stack for t in ts], text, min(1.0, linked / len(text))))
        linked = 0

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            piece = page[at : m.start()]
            held.append(piece)
            linked += len(piece) * (in_link > 0)
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if not tag:
            continue
        tag, end = tag.lower(), bool(m["end"] or m["end2"])
        if tag == "br":
            held.append(" ")
        elif tag == "a":
            in_link = 0 if end else 1
        elif tag in BLOCKS:
            flush()
            if end:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        del stack[k:]
                        break
            else:
                while stack and tag in ENDS.get(stack[-1][0], ()):
                    stack.pop()
                if tag in ("li", "dt", "dd", "td", "th", "tr"):
                    for k in range(len(stack) - 1, -1, -1):
                        if tag in ENDS.get(stack[k][0], ()):
                            del stack[k:]
                            break
                        if stack[k][0] in SCOPE:
                            break
                # a head holds no text of its own: what stands in it, closed or not, belongs to the body
                if tag not in VOID and tag != "head":
                    stack.append((tag, _tokens(tag, m["attrs"] or m["attrs2"] or "")))
    if at < len(page):
        held.append(page[at:])
    flush()
    return out


class Labeller:
    """Embeddings, one LSTM in each direction, and a logistic output that also sees the input."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        n = 2 * WIDTH + NUMBERS
        small = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        # unseen path parts and words stay at zero and say nothing
        self.p = {"path": np.zeros((PATHS, WIDTH), np.float32), "word": np.zeros((WORDS, WIDTH), np.float32), "skip": small(n), "out": small(2 * HIDDEN), "bias": np.zeros(1, np.float32)}
        for d in "fb":
            bias = np.zeros(4 * HIDDEN, np.float32)
            bias[HIDDEN : 2 * HIDDEN] = 1
            self.p |= {f"x{d}": small(n, 4 * HIDDEN), f"h{d}": small(HIDDEN, 4 * HIDDEN), f"b{d}": bias}
        self.p["path"] += rng.standard_normal(self.p["path"].shape).astype(np.float32) * 0.01

    def inputs(self, blocks: list[tuple[list[int], str, float]]) -> tuple[np.ndarray, tuple]:
        """Vectors of blocks, and what the gradient needs."""
        n = len(blocks)
        path = np.array([t for b in blocks for t in b[0]], np.int64)
        path_of = np.repeat(np.arange(n), [len(b[0]) for b in blocks])
        data = [b[1].encode() for b in blocks]
        at = np.concatenate([[0], np.cumsum([len(x) for x in data])]).astype(np.int64)
        buf = tn.lower_latin(np.frombuffer(b"".join(data), np.uint8))
        start, end, first = tn.words(buf, at, tn.PUNCT)
        word = (tn.span_hash(tn.prefix_hash(buf), start, end) % np.uint64(WORDS)).astype(np.int64)
        count = np.diff(first)
        word_of = np.repeat(np.arange(n), count)
        x = np.zeros((n, 2 * WIDTH + NUMBERS), np.float32)
        sums = np.zeros((len(path) + 1, WIDTH), np.float64)
        np.cumsum(self.p["path"][path], axis=0, out=sums[1:])
        cut = np.concatenate([[0], np.cumsum([len(b[0]) for b in blocks])])
        x[:, :WIDTH] = sums[cut[1:]] - sums[cut[:-1]]
        has = count > 0
        if len(word):
            x[has, WIDTH : 2 * WIDTH] = np.add.reduceat(self.p["word"][word], first[:-1][has], axis=0) / count[has, None]
        size = np.diff(at)
        x[:, 2 * WIDTH] = np.log1p(count) / 4
        x[:, 2 * WIDTH + 1] = [b[2] for b in blocks]
        stops = np.concatenate([[0], np.cumsum((buf == 0x2E) | (buf == 0x2C))])
        x[:, 2 * WIDTH + 2] = np.minimum((stops[at[1:]] - stops[at[:-1]]) / np.maximum(count, 1) * 4, 2)
        x[:, 2 * WIDTH + 3] = np.minimum(size / np.maximum(count, 1) / 8, 2)
        x[:, 2 * WIDTH + 4] = 1
        return x, (path, path_of, word, word_of, count)

    def logits(self, x: np.ndarray, mask: np.ndarray, steps: int = 4096) -> np.ndarray:
        """Logits for padded input (time, page, feature). Besides these and the input only the states of ``steps`` blocks are held, however long a page is."""
        z = x @ self.p["skip"] + self.p["bias"]
        starts = range(0, len(x), steps)
        for k, d in enumerate("fb"):
            h = np.zeros((x.shape[1], HIDDEN), np.float32)
            c = np.zeros_like(h)
            out = self.p["out"][k * HIDDEN : (k + 1) * HIDDEN]
            for a in starts if d == "f" else reversed(starts):
                zx = x[a : a + steps] @ self.p[f"x{d}"] + self.p[f"b{d}"]
                for t in range(len(zx)) if d == "f" else range(len(zx) - 1, -1, -1):
                    v = zx[t] + h @ self.p[f"h{d}"]
                    s = 1 / (1 + np.exp(-np.clip(v, -30, 30)))
                    m = mask[a + t][:, None]
                    new = np.where(m, s[:, HIDDEN : 2 * HIDDEN] * c + s[:, :HIDDEN] * np.tanh(v[:, 2 * HIDDEN : 3 * HIDDEN]), c)
                    h, c = np.where(m, s[:, 3 * HIDDEN :] * np.tanh(new), h), new
                    z[a + t] += h @ out
        return z

    def run(self, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, dict]:
        """Logits for padded input (time, page, feature), and the states, which the gradient needs."""
        kept: dict = {}
        both = []
        for d in "fb":
            steps = range(len(x)) if d == "f" else range(len(x) - 1, -1, -1)
            h = np.zeros((x.shape[1], HIDDEN), np.float32)
            c = np.zeros_like(h)
            zx = x @ self.p[f"x{d}"] + self.p[f"b{d}"]
            hs = np.zeros((*x.shape[:2], HIDDEN), np.float32)
            trace = [None] * len(x)
            for t in steps:
                z = zx[t] + h @ self.p[f"h{d}"]
                s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 3 * HIDDEN :]
                g = np.tanh(z[:, 2 * HIDDEN : 3 * HIDDEN])
                m = mask[t][:, None]
                new = np.where(m, f * c + i * g, c)
                th = np.tanh(new)
                trace[t] = (i, f, g, o, c, th, h)
                h, c = np.where(m, o * th, h), new
                hs[t] = h
            kept[d] = trace
            both.append(hs)
        h2 = np.concatenate(both, 2)
        kept["h2"] = h2
        return h2 @ self.p["out"] + x @ self.p["skip"] + self.p["bias"], kept

    def gradient(self, x: np.ndarray, mask: np.ndarray, kept: dict, e: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of the parameters and of x, from those of the logits."""
        g = {"out": np.einsum("tbh,tb->h", kept["h2"], e), "skip": np.einsum("tbn,tb->n", x, e), "bias": np.array([e.sum()], np.float32)}
        dx = e[..., None] * self.p["skip"]
        for k, d in enumerate("fb"):
            steps = range(len(x) - 1, -1, -1) if d == "f" else range(len(x))
            w = self.p["out"][k * HIDDEN : (k + 1) * HIDDEN]
            dh = np.zeros((x.shape[1], HIDDEN), np.float32)
            dc = np.zeros_like(dh)
            dz_all = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
            gh = np.zeros_like(self.p[f"h{d}"])
            for t in steps:
                i, f, gg, o, c0, th, h0 = kept[d][t]
                m = mask[t][:, None]
                dh = dh + e[t][:, None] * w
                own = np.where(m, dh, 0)
                dcell = np.where(m, dc + own * o * (1 - th * th), 0)
                dz = np.concatenate([dcell * gg * i * (1 - i), dcell * c0 * f * (1 - f), dcell * i * (1 - gg * gg), own * th * o * (1 - o)], 1)
                dz_all[t] = dz
                gh += h0.T @ dz
                dh = np.where(m, dz @ self.p[f"h{d}"].T, dh)
                dc = np.where(m, dcell * f, dc)
            g[f"h{d}"], g[f"x{d}"], g[f"b{d}"] = gh, np.einsum("tbn,tbz->nz", x, dz_all), dz_all.sum((0, 1))
            dx += dz_all @ self.p[f"x{d}"].T
        return g, dx

    @staticmethod
    def padded(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Time and page of each block, and the mask."""
        page = np.repeat(np.arange(len(lengths)), lengths)
        time = np.arange(len(page)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        mask = np.zeros((max(int(lengths.max(initial=0)), 1), len(lengths)), bool)
        mask[time, page] = True
        return time, page, mask

    def label(self, pages: list[list[tuple[list[int], str, float]]]) -> list[np.ndarray]:
        """Probability that each block of each page is main text."""
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
        k = 0
        while k < len(order):  # batches of about equal size, however long a page is
            n = max(1, min(256, 8192 // len(pages[order[k]])))
            own = order[k : k + n]
            k += len(own)
            lengths = np.array([len(pages[i]) for i in own])
            x, _ = self.inputs([b for i in own for b in pages[i]])
            time, page, mask = self.padded(lengths)
            padded = np.zeros((*mask.shape, x.shape[1]), np.float32)
            padded[time, page] = x
            z = self.logits(padded, mask)
            p = 1 / (1 + np.exp(-z[time, page]))
            for i, s in zip(own, np.split(p, np.cumsum(lengths)[:-1]), strict=True):
                out[i] = s
        return out

    def train(self, pages: list[list[tuple[list[int], str, float]]], labels: list[list[int]], epochs: int = EPOCHS, rate: float = 0.01) -> Labeller:
        rng = np.random.default_rng(SEED)
        mean = {k: np.zeros_like(v) for k, v in self.p.items()}
        square = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for epoch in range(epochs):
            for own in np.array_split(rng.permutation(len(pages)), -(-len(pages) // BATCH)):
                lengths = np.array([len(pages[i]) for i in own])
                x, (path, path_of, word, word_of, count) = self.inputs([b for i in own for b in pages[i]])
                y = np.array([v for i in own for v in labels[i]], np.float32)
                time, page, mask = self.padded(lengths)
                padded = np.zeros((*mask.shape, x.shape[1]), np.float32)
                padded[time, page] = x
                z, kept = self.run(padded, mask)
                e = np.zeros(mask.shape, np.float32)
                e[time, page] = (1 / (1 + np.exp(-z[time, page])) - y) / len(y)
                g, dx = self.gradient(padded, mask, kept, e)
                flat = dx[time, page]
                g["path"], g["word"] = np.zeros_like(self.p["path"]), np.zeros_like(self.p["word"])
                np.add.at(g["path"], path, flat[path_of, :WIDTH])
                np.add.at(g["word"], word, flat[word_of, WIDTH : 2 * WIDTH] / count[word_of, None])
                g["word"] += 1e-5 * self.p["word"]
                step += 1
                for k, v in g.items():
                    mean[k] = 0.9 * mean[k] + 0.1 * v
                    square[k] = 0.99 * square[k] + 0.01 * v * v
                    self.p[k] -= (rate * 0.6**epoch * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
        return self


_SYLLABLES = "an ba ché co de en er fü ga ho in je ka lo mi na os pe qui ra sch ti un vé wo xi yo ze tion able ment keit ción ou".split()
#: Furniture that real pages say, and class names that go with it, by kind.
_SAYS = {
    "menu": ("Home", "About", "Contact", "News", "Login", "Sign in", "Search", "Products", "Menu", "Blog", "Sitemap", "Careers"),
    "ad": ("Advertisement", "Sponsored", "Buy now", "Shop the sale", "Limited offer", "Promoted content"),
    "notice": ("We use cookies to improve your experience.", "Accept all cookies", "Please enable JavaScript.", "Your session has expired.", "Read our privacy policy."),
    "form": ("Email", "Subscribe", "Your name", "Sign up for our newsletter", "Leave a reply", "Post comment", "Send"),
    "aside": ("Related articles", "Most read", "Popular posts", "Recent comments", "Archives", "Tags", "Follow us"),
    "share": ("Share", "Tweet", "Facebook", "Print", "Share this article"),
    "comments": ("Reply", "Report", "3 comments", "Comments", "Great post!", "Thanks for sharing this.", "I disagree."),
    "footer": ("Copyright", "All rights reserved.", "Terms of use", "Privacy", "Imprint", "©"),
}
_CLASSES = {
    "menu": ("menu", "nav", "navbar", "navigation", "main-menu", "breadcrumb", "breadcrumbs", "topbar", "links", "pagination"),
    "head": ("header", "site-header", "masthead", "top", "branding", "logo"),
    "ad": ("ad", "ads", "advert", "advertisement", "ad-box", "sponsored", "sponsor", "promo", "banner", "google-ad"),
    "notice": ("cookie", "cookies", "notice", "consent", "alert", "gdpr", "warning", "message", "cookie-notice", "popup", "modal"),
    "form": ("newsletter", "signup", "search", "subscribe", "login", "search-form", "contact-form"),
    "aside": ("sidebar", "widget", "related", "side", "rail", "recommended", "popular", "more", "teaser"),
    "share": ("share", "social", "sharing", "share-buttons", "tools", "meta-links"),
    "comments": ("comments", "comment", "replies", "discussion", "comment-list", "reader-comments", "responses", "disqus", "commentlist", "comment-body", "thread", "reviews", "feedback", "guestbook", "kommentare", "commentaires", "comentarios"),
    "footer": ("footer", "site-footer", "bottom", "copyright", "legal", "credits"),
    "main": ("content", "post", "entry", "article", "entry-content", "article-body", "story", "post-content", "main", "text", "body"),
}


def sample_page(rng: np.random.Generator) -> tuple[str, list[int]]:
    """A page with known labels: one per block, 1 for main text. Kinds of furniture, markup and lengths vary at random."""
    parts: list[str] = []
    labels: list[int] = []
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    maybe = lambda p: rng.random() < p

    def word() -> str:
        return "".join(pick(_SYLLABLES) for _ in range(int(rng.integers(1, 4))))

    def prose(lo: int, hi: int) -> str:
        out = []
        for _ in range(int(np.exp(rng.uniform(np.log(lo), np.log(hi))))):
            w = word()
            out.append(w.capitalize() + pick((".", ",", "", "")) if maybe(0.15) else w)
        text = " ".join(out).capitalize() + pick((".", ".", ""))
        return text.replace(" ", " &amp; ", 1) if maybe(0.1) else text

    def block(tag: str, text: str, label: int, close: bool = True, attrs: str = "") -> None:
        inner = f"<{pick(('b', 'i', 'span', 'strong', 'font', 'u'))}>{text}" if maybe(0.08) else f"{text[: len(text) // 2]}<em>{text[len(text) // 2 :]}</em>" if maybe(0.05) and "&" not in text else text
        parts.append(f"<{tag}{attrs}>{inner}" + (f"</{tag}>" if close else ""))
        labels.append(label)

    def said(kind: str, lo: int = 1, hi: int = 25) -> str:
        return pick(_SAYS[kind]) if maybe(0.4) else prose(lo, hi)

    def opened(tag: str, kind: str, certain: bool) -> str:
        name = f' {pick(("class", "id"))}="{pick(_CLASSES[kind])}"' if certain or maybe(0.4) else ""
        parts.append(f"<{tag}{name}>")
        return f"</{tag}>"

    def links(kind: str, n: int) -> None:
        as_list = maybe(0.7)
        parts.append("<ul>" if as_list else "")
        for _ in range(n):
            text = said(kind, 1, 6)
            block("li" if as_list else "div", f'<a href="/{word()}">{text}</a>' if maybe(0.85) else text, 0)
        parts.append("</ul>" if as_list else "")

    def furniture(kind: str) -> None:
        tag = {"menu": "nav", "head": "header", "form": "form", "aside": "aside", "footer": "footer"}.get(kind, "div")
        if maybe(0.4):
            tag = pick(("div", "section") if tag != "div" else ("div", "section", "aside"))
        end = opened(tag, kind, tag in ("div", "section"))
        if kind in ("menu", "share") or kind in ("aside", "head") and maybe(0.5):
            links("menu" if kind == "head" else kind, int(rng.integers(1, 9)))
        elif kind == "form":
            for _ in range(int(rng.integers(1, 4))):
                block(pick(("p", "div", "fieldset")), said(kind, 1, 8), 0)
                parts.append('<input name="q">')
        elif kind == "comments":
            if maybe(0.5):
                block(pick(("h2", "h3")), said(kind, 1, 4), 0)
            for _ in range(int(rng.integers(1, 7))):
                inner = opened(pick(("div", "li", "article")), kind, maybe(0.6))
                for _ in range(int(rng.integers(1, 3))):
                    block("p", said(kind, 3, 80), 0)
                parts.append(inner)
        elif kind in ("ad", "notice", "footer") and maybe(0.5):
            labels.append(0)  # bare text
            parts.append(("&copy; " if kind == "footer" and maybe(0.6) else "") + said(kind, 2, 40))
        else:
            if maybe(0.3):
                block(pick(("h2", "h3", "h4")), said("menu" if kind == "head" else kind, 1, 5), 0)
            for _ in range(int(rng.integers(1, 4))):
                block(pick(("p", "div")), said("menu" if kind == "head" else kind, 2, 50), 0)
        parts.append(end)

    if maybe(0.8):
        parts.append(pick(("<!DOCTYPE html>", "<!doctype html>\n", "")) + pick((f'<html lang="{word()[:2]}">', "<html>", '<html class="no-js">')))
    if maybe(0.85):
        parts.append("<head>")
        for _ in range(int(rng.integers(0, 4))):
            parts.append(pick(("<title>{}</title>", "<style>.{}{{color:red}}</style>", '<meta name="description" content="{}">', "<script>let {0}=1;</script>", '<link rel="stylesheet" href="/{}.css">')).format(word()))
        parts.append(pick(("</head>", "</head>", "")))
    if maybe(0.8):
        parts.append(pick(("<body>", "<body>", f'<body class="{word()}">')))
    wrapper = opened("div", "main", False) if maybe(0.3) else ""
    for kind in ("head", "menu", "notice", "ad", "menu"):
        if maybe(0.5):
            furniture(kind)
    if maybe(0.3):
        furniture("aside")
    tag = pick(("article", "article", "main", "div", "section"))
    end = opened(tag, "main", tag in ("div", "section"))
    if tag == "main" and maybe(0.5):
        parts.append("<article>")
        end = "</article>" + end
    if maybe(0.85):
        wrapped = maybe(0.2)  # the article's own header holds its title
        parts.append("<header>" if wrapped else "")
        block(pick(("h1", "h1", "h2")), prose(1, 14), 1)
        parts.append("</header>" if wrapped else "")
    closes = maybe(0.7)
    for _ in range(int(rng.integers(1, 14))):
        kind = rng.random()
        if kind < 0.05:  # where a phrase stands says more than its words
            block("p", pick(_SAYS[pick(list(_SAYS))]), 1, closes)
        elif kind < 0.72:
            block("p", prose(1, 160), 1, closes)
        elif kind < 0.78:
            block(pick(("h2", "h3")), prose(1, 8), 1)
        elif kind < 0.84:
            parts.append("<ul>")
            for _ in range(int(rng.integers(1, 6))):
                block("li", prose(1, 25), 1)
            parts.append("</ul>")
        elif kind < 0.88:
            block(pick(("blockquote", "pre", "figcaption")), prose(2, 40), 1)
        elif kind < 0.90:
            parts.append("<table><tr>")
            for _ in range(int(rng.integers(2, 6))):
                block(pick(("td", "th")), prose(1, 4), 1)
            parts.append("</tr></table>")
        else:
            furniture(pick(("ad", "share", "aside", "form", "notice")))
    if maybe(0.25):
        furniture(pick(("share", "ad", "comments")))
    parts.append(end)
    for kind in ("comments", "aside", "form", "ad", "notice", "menu"):
        if maybe(0.3):
            furniture(kind)
    if tag in ("article", "main") and maybe(0.3):  # what stands outside the article under a name never seen
        outer = pick(("div", "section", "ol"))
        parts.append(f'<{outer} class="{word()}">')
        for _ in range(int(rng.integers(1, 4))):
            block("li" if outer == "ol" else "p", prose(2, 60), 0)
        parts.append(f"</{outer}>")
    parts.append("</div>" if wrapper else "")
    if maybe(0.85):
        furniture("footer")
    parts.append("</body></html>" if maybe(0.9) else "")
    return "".join(parts), labels


def training_set(n: int, seed: int) -> tuple[list, list[list[int]]]:
    rng = np.random.default_rng(seed)
    made = [sample_page(rng) for _ in range(n)]
    pages = [leaves(page) for page, _ in made]
    fit = [k for k in range(n) if len(pages[k]) == len(made[k][1])]
    return [pages[k] for k in fit], [made[k][1] for k in fit]


@functools.lru_cache(2)
def trained(n: int = TRAIN_PAGES, seed: int = SEED) -> Labeller:
    return Labeller(seed).train(*training_set(n, seed))


def extract(pages: DataFrame, model: Labeller | None = None) -> DataFrame:
    """page_id, url, text, n_chars: the blocks labelled main text of each whole page, joined by newlines in page order.

    A null or empty page, or one without main text, has an empty text; repeated rows are read each; null ids and urls stay; other
    columns are ignored. One narrow pass; the model is the only thing sent along.
    """
    model = model or trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: list[str] = []
            for a in range(0, batch.num_rows, 512):
                found = [leaves(x or "") for x in batch.column(2).slice(a, 512).to_pylist()]
                texts += ["\n".join(b[1] for b, p in zip(bs, ps, strict=True) if p >= 0.5) for bs, ps in zip(found, model.label(found), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
