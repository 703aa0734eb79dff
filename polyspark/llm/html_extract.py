"""Main-text extraction by a recurrent block labeller.

A page becomes the sequence of its leaf blocks (text between block-level tags). Each block is a vector: which structural
tags and class words are on its path, hashed counts of its words, and a few shares (links, length, place). A bidirectional
LSTM in numpy reads the whole sequence in both directions and labels every block as main text or not, so a block is judged
with all of its page around it. The model is trained when first needed, on pages from the generator in this module, with
fixed seeds; nothing of the tables is used for training.

Nulls and edges: a null or empty page has an empty text; markup that is cut off at the end of a page is dropped, text before
it stays; unknown tags count as inline; pages of any length are read whole; repeated rows give repeated results; an empty
table gives an empty result; other columns of the input are never read.
"""

from __future__ import annotations

import html as html_lib
import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk

BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements whose content is never text of the page.
RAW_TAGS = "script style template textarea noscript iframe svg math object canvas".split()
VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Tags and class words that have an input of their own; all other class words are hashed.
KNOWN = (
    "nav header footer aside form main article section p li ul ol h1 h2 h3 td pre blockquote figure figcaption title head button label select option dialog "
    "menu sidebar side ad ads advert advertisement banner sponsor sponsored promo cookie cookies notice consent alert popup modal newsletter subscribe comment comments reply replies discussion respond "
    "related share social breadcrumb breadcrumbs pagination pager tags widget search login signup toolbar copyright legal masthead navigation "
    "content entry post story body text page wrapper container layout row col lead intro paragraph"
).split()
PLACE = {w: i for i, w in enumerate(KNOWN)}
HASHED_PATH, HASHED_WORDS, SHARES = 16, 32, 8
INPUTS = len(KNOWN) + HASHED_PATH + HASHED_WORDS + SHARES
HIDDEN = 20

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>" + "|".join(RAW_TAGS) + r")\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z][^>]*\Z|</\Z|<\Z",
    re.S | re.I,
)
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
MARKED = re.compile(r'data-y="([01])"')
PARTS = re.compile(r"[a-z]+|[0-9]+")


@dataclass(slots=True)
class Block:
    text: str
    path: tuple
    linked: int
    label: int


def blocks_of(page: str) -> list[Block]:
    """The non-empty leaf blocks of a page, white space made single, character references decoded."""
    out: list[Block] = []
    stack: list[tuple[str, tuple, int]] = []
    parts: list[str] = []
    in_link, linked, at = 0, 0, 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html_lib.unescape("".join(parts)).split())
            parts.clear()
            if text:
                names = tuple(n for s in stack for n in (s[0], *s[1]))
                out.append(Block(text, names, min(linked, len(text)), stack[-1][2] if stack else 0))
        linked = 0

    def close(tag: str) -> None:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] == tag:
                del stack[k:]
                return

    for m in TOKEN.finditer(page):
        if m.start() > at:
            piece = page[at : m.start()]
            parts.append(piece)
            if in_link:
                linked += len(piece)
        at = m.end()
        tag = m["tag"]
        if not tag:
            continue
        tag = tag.lower()
        if tag == "a":
            in_link = 0 if m["end"] else 1
        elif tag == "br":
            parts.append(" ")
        if tag not in BLOCK_TAGS:
            continue
        flush()
        in_link = 0
        if m["end"]:
            close(tag)
            continue
        if tag == "p" or tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
            if stack and stack[-1][0] == tag:
                stack.pop()
        elif stack and stack[-1][0] == "p":
            stack.pop()
        if tag in VOID_TAGS:
            continue
        attrs = m["attrs"]
        names: tuple = ()
        label = stack[-1][2] if stack else 0
        if attrs:
            names = tuple(w for g in NAMES.findall(attrs) for w in PARTS.findall((g[0] or g[1] or g[2]).lower()))
            if y := MARKED.search(attrs):
                label = int(y[1])
        stack.append((tag, names, label))
    if at < len(page):
        parts.append(page[at:])
    flush()
    return out


@lru_cache(maxsize=4096)
def _path_vector(path: tuple) -> np.ndarray:
    v = np.zeros(len(KNOWN) + HASHED_PATH, np.float32)
    for w in path:
        if w in PLACE:
            v[PLACE[w]] = 1
        elif w not in BLOCK_TAGS and not w.isdigit():
            v[len(KNOWN) + sum(w.encode()) * 31 % HASHED_PATH] = 0.5
    return v


def features(pages: list[list[Block]]) -> list[np.ndarray]:
    """Inputs of every block of the pages."""
    every = [b for p in pages for b in p]
    if not every:
        return [np.zeros((0, INPUTS), np.float32) for _ in pages]
    x = np.zeros((len(every), INPUTS), np.float32)
    raw = [b.text.encode() for b in every]
    off = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    buf = np.frombuffer(b"".join(raw), np.uint8)
    base = len(KNOWN) + HASHED_PATH
    words = np.zeros(len(every))
    for i, j in tk.blocks(off):
        h, _, _, doc = tk.word_hashes(buf[off[i] : off[j]], off[i : j + 1] - off[i], tk.ALNUM)
        words[i:j] = np.bincount(doc, minlength=j - i)
        bag = np.bincount(doc * HASHED_WORDS + (h >> tk.U(59)).astype(np.int64), minlength=(j - i) * HASHED_WORDS).reshape(-1, HASHED_WORDS)
        x[i:j, base : base + HASHED_WORDS] = bag / np.maximum(words[i:j], 1)[:, None]
    k = 0
    for p in pages:
        for place, b in enumerate(p):
            x[k, :base] = _path_vector(b.path)
            size = len(b.text)
            x[k, base + HASHED_WORDS :] = (b.linked / size, math.log1p(words[k]) / 6, math.log1p(size) / 8, place / len(p), 1 / (1 + place), b.text[-1] in ".!?", len(b.path) / 10, 1)
            k += 1
    bound = np.cumsum([0] + [len(p) for p in pages])
    return [x[a:b] for a, b in zip(bound[:-1], bound[1:])]


def _sigmoid(v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(v, -30, 30)))


class BiLstm:
    """One LSTM layer in each direction and a logistic output for each step. Batches are [step, page, input] with a mask."""

    def __init__(self, inputs: int = INPUTS, hidden: int = HIDDEN, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        self.w = {}
        for d in "fb":
            self.w["x" + d] = rng.normal(0, 1 / math.sqrt(inputs), (inputs, 4 * hidden))
            self.w["h" + d] = rng.normal(0, 1 / math.sqrt(hidden), (hidden, 4 * hidden))
            self.w["c" + d] = np.concatenate([np.ones(hidden), np.zeros(3 * hidden)])
        self.w["o"] = rng.normal(0, 1 / math.sqrt(2 * hidden), (2 * hidden,))
        self.w["ob"] = np.zeros(1)

    def _run(self, d: str, x: np.ndarray, mask: np.ndarray, keep: list | None) -> np.ndarray:
        n = self.hidden
        pre = x @ self.w["x" + d] + self.w["c" + d]
        h = np.zeros((x.shape[1], n), x.dtype)
        c = np.zeros_like(h)
        out = np.zeros((*x.shape[:2], n), x.dtype)
        wh = self.w["h" + d]
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            g = pre[t] + h @ wh
            f, i, o = (_sigmoid(g[:, k * n : (k + 1) * n]) for k in range(3))
            u = np.tanh(g[:, 3 * n :])
            m = mask[t][:, None]
            c2 = f * c + i * u
            tc = np.tanh(c2)
            if keep is not None:
                keep.append((t, f, i, o, u, c, h, tc, m))
            c = np.where(m, c2, c)
            h = np.where(m, o * tc, h)
            out[t] = h
        return out

    def forward(self, x: np.ndarray, mask: np.ndarray, kept: dict | None = None) -> np.ndarray:
        outs = []
        for d in "fb":
            keep = [] if kept is not None else None
            outs.append(self._run(d, x, mask, keep))
            if kept is not None:
                kept[d] = keep
        both = np.concatenate(outs, 2)
        if kept is not None:
            kept["out"] = both
        return _sigmoid(both @ self.w["o"] + self.w["ob"])

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        kept: dict = {}
        p = self.forward(x, mask, kept)
        d_out = (p - y) * mask / max(mask.sum(), 1)
        grad = {"o": np.einsum("tb,tbh->h", d_out, kept["out"]), "ob": np.array([d_out.sum()])}
        n = self.hidden
        for k, d in enumerate("fb"):
            d_h_out = d_out[:, :, None] * self.w["o"][k * n : (k + 1) * n]
            gx, gh, gc = (np.zeros_like(self.w[v + d]) for v in "xhc")
            dh = np.zeros((x.shape[1], n))
            dc = np.zeros_like(dh)
            wh = self.w["h" + d]
            for t, f, i, o, u, c, h, tc, m in reversed(kept[d]):
                total = dh + d_h_out[t]
                dh_new = np.where(m, total, 0)
                do = dh_new * tc
                dc_new = np.where(m, dc, 0) + dh_new * o * (1 - tc * tc)
                g = np.concatenate([dc_new * c * f * (1 - f), dc_new * u * i * (1 - i), do * o * (1 - o), dc_new * i * (1 - u * u)], 1)
                gx += x[t].T @ g
                gh += h.T @ g
                gc += g.sum(0)
                dh = np.where(m, g @ wh.T, total)
                dc = np.where(m, dc_new * f, dc)
            grad |= {"x" + d: gx, "h" + d: gh, "c" + d: gc}
        return grad

    def fit(self, xs: list[np.ndarray], ys: list[np.ndarray], epochs: int, batch: int = 32, rate: float = 0.01, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        m1, m2, step = {k: np.zeros_like(v) for k, v in self.w.items()}, {k: np.zeros_like(v) for k, v in self.w.items()}, 0
        for epoch in range(epochs):
            order = rng.permutation(len(xs))
            for a in range(0, len(xs), batch):
                part = order[a : a + batch]
                x, mask = padded([xs[k] for k in part])
                y = np.zeros(mask.shape)
                for col, k in enumerate(part):
                    y[: len(ys[k]), col] = ys[k]
                step += 1
                for k, g in self.gradients(x.astype(np.float64), mask, y).items():
                    g = np.clip(g, -1, 1)
                    m1[k] = 0.9 * m1[k] + 0.1 * g
                    m2[k] = 0.99 * m2[k] + 0.01 * g * g
                    self.w[k] = self.w[k] - rate / (1 + 0.3 * epoch) * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)

    def label(self, xs: list[np.ndarray]) -> list[np.ndarray]:
        """Whether each block is main text; pages of similar length go through together."""
        out: list = [np.zeros(0, bool)] * len(xs)
        order = sorted((k for k in range(len(xs)) if len(xs[k])), key=lambda k: len(xs[k]))
        for a in range(0, len(order), 256):
            part = order[a : a + 256]
            x, mask = padded([xs[k] for k in part])
            p = self.forward(x, mask)
            for col, k in enumerate(part):
                out[k] = p[: len(xs[k]), col] > 0.5
        return out


def padded(xs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(x) for x in xs)
    out = np.zeros((steps, len(xs), INPUTS), np.float32)
    mask = np.zeros((steps, len(xs)), bool)
    for k, x in enumerate(xs):
        out[: len(x), k] = x
        mask[: len(x), k] = True
    return out, mask


def made_page(rng: random.Random) -> str:
    """A page with known labels: a main part among menus, notices, adverts, forms, sidebars, comments and footers."""

    def words(lo: int, hi: int) -> str:
        letters = rng.choice(["etaoinshrd", "eariotnslc", "aeiounrstl", "enisratdhu"])
        return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(lo, hi)))

    def sentence(lo: int, hi: int) -> str:
        t = words(lo, hi).capitalize()
        return t.upper() + "!!" if rng.random() < 0.05 else t + rng.choice([".", ".", ".", "!", "?", ""])

    def prose() -> str:
        return " ".join(sentence(1, 25) for _ in range(rng.choice([1, 1, 2, 3, 6])))

    def links(n: int) -> str:
        return "".join(f'<li><a href="/x">{words(1, 3)}</a></li>' for _ in range(n))

    def wrap(tag: str, name: str, inner: str) -> str:
        attr = "" if not name else f' {rng.choice(["class", "id", "class"])}="{name}"'
        return f'<{tag}{attr} data-y="0">{inner}</{tag}>'

    def paragraph() -> str:
        kind = rng.random()
        if kind < 0.7:
            return f"<p>{prose()}</p>"
        if kind < 0.78:
            return f"<p><b>{sentence(2, 9)}<br>"
        if kind < 0.86:
            return f"<h2>{words(1, 8)}</h2><p>{prose()}</p>"
        if kind < 0.92:
            return "<ul>" + "".join(f"<li>{sentence(2, 12)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>"
        if kind < 0.96:
            return f"<blockquote><p>{prose()}</p></blockquote>"
        return f'<p>{sentence(3, 9)} <a href="/y">{words(1, 4)}</a> {sentence(2, 9)}</p>'

    def junk() -> str:
        kind = rng.randrange(11)
        if kind == 0:
            return wrap("div", rng.choice(["ad", "ads", "advert", "ad-banner", "sponsored", "promo"]), rng.choice([sentence(2, 14), f"<p>{prose()}</p>"]))
        if kind == 1:
            return wrap("aside", rng.choice(["", "sidebar", "related"]), rng.choice([f"<ul>{links(4)}</ul>", f"<h3>{words(1, 3)}</h3><p>{prose()}</p>"]))
        if kind == 2:
            return wrap("div", rng.choice(["cookie-notice", "consent", "notice", "cookie banner", "alert"]), rng.choice([sentence(4, 20), f"<p>{prose()}</p><button>{words(1, 2)}</button>"]))
        if kind == 3:
            return wrap("form", rng.choice(["", "newsletter", "search", "login"]), f"<label>{words(1, 3)}</label><button>{words(1, 2)}</button>")
        if kind == 4:
            return wrap(rng.choice(["section", "div"]), rng.choice(["comments", "comment-list", "discussion", "replies"]), "".join(rng.choice([f"<p>{prose()}</p>", wrap("div", "comment", f"<p>{prose()}</p>")]) for _ in range(rng.randint(1, 5))))
        if kind == 5:
            return wrap("div", rng.choice(["sidebar", "side", "widget", "related"]), f"<h3>{words(1, 3)}</h3><ul>{links(3)}</ul>")
        if kind == 6:
            return wrap("div", rng.choice(["share", "social", "breadcrumbs", "pagination", "tags"]), f"<ul>{links(3)}</ul>")
        if kind == 7:
            return wrap("div", rng.choice(["newsletter", "subscribe", "popup", "modal"]), f"<p>{sentence(3, 12)}</p>")
        if kind == 8:
            return wrap(rng.choice(["nav", "ul", "div"]), rng.choice(["menu", "navigation", "toolbar"]), links(rng.randint(2, 6)))
        if kind == 9:
            return wrap("dialog", "", f"<p>{prose()}</p>")
        return wrap("header", rng.choice(["", "masthead"]), rng.choice([words(1, 4), f"<h2>{words(1, 4)}</h2><p>{sentence(2, 8)}</p>"]))

    body = [f"<h1>{words(1, 10)}</h1>"] * (rng.random() < 0.85) + [paragraph() for _ in range(rng.choice([1, 1, 2, 3, 5, 8, 14]))]
    for _ in range(rng.choice([0, 0, 0, 1, 2])):
        body.insert(rng.randint(1, len(body)), junk())
    tag, name = rng.choice([("article", ""), ("article", ""), ("article", "post"), ("main", ""), ("div", "content"), ("div", "entry-content"), ("section", "story"), ("div", "article-body")])
    main = f"<{tag}" + (f' class="{name}"' if name else "") + ' data-y="1">' + "".join(body) + f"</{tag}>"
    before = [wrap("nav", "", f"<ul>{links(rng.randint(2, 8))}</ul>")] * (rng.random() < 0.8) + [junk() for _ in range(rng.choice([0, 1, 1, 2]))]
    after = [junk() for _ in range(rng.choice([0, 0, 1, 2]))] + [wrap("footer", "", rng.choice([f"&copy; {words(1, 4)} &middot; {sentence(3, 14)}", f"<p>{prose()}</p>", f"<ul>{links(3)}</ul>"]))] * (rng.random() < 0.85)
    return f"<html><head><title>{words(1, 8)}</title></head><body>" + "".join(before) + main + "".join(after) + "</body></html>"


TRAIN_PAGES, EPOCHS = 900, 7


@lru_cache(maxsize=1)
def trained() -> BiLstm:
    rng = random.Random(97)
    pages = [blocks_of(made_page(rng)) for _ in range(TRAIN_PAGES)]
    model = BiLstm()
    model.fit(features(pages), [np.array([b.label for b in p], float) for p in pages], EPOCHS)
    model.w = {k: v.astype(np.float32) for k, v in model.w.items()}
    return model


def main_texts(pages: list[str], model: BiLstm) -> list[str]:
    blocks = [blocks_of(p) for p in pages]
    return ["\n".join(b.text for b, ok in zip(p, keep) if ok) for p, keep in zip(blocks, model.label(features(blocks)))]


def _extract(model_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of.value
        for batch in batches:
            pages = [p or "" for p in batch.column(2).to_pylist()]
            off = np.concatenate([[0], np.cumsum([len(p) for p in pages])])
            text = [t for i, j in tk.blocks(off, 4 << 20) for t in main_texts(pages[i:j], model)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, main text and its number of code points."""
    model_of = pages.sparkSession.sparkContext.broadcast(trained())
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(_extract(model_of), "page_id long, url string, text string, n_chars long")


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
