"""Main text of web pages by a recurrent block labeller.

A page is a sequence of leaf blocks. Each block is a vector of its hashed tag path, its
hashed words and a few ratios; a bidirectional LSTM reads the whole sequence, so a block
is judged by what stands before and after it, and the blocks labelled as content make
the text. The labeller is trained on a bounded sample of the pages themselves: blocks
inside an element that HTML reserves for content, and not inside one reserved for other
things, are content. The content of each sampled page is used again several times in
other shapes: in marked, named and nameless boxes, as lists, tables, quotations, code and
plain text, between menus, notices, forms, adverts, sidebars and comments of many names
and tags that are put in with what they are known to be, some of them in the words of
other pages' content. So neither a list of tags nor the words alone can tell.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayline.llm import bilstm, wordhash
from assayline.llm.htmlblocks import Block, blocks
from assayline.llm.shared import short_batches
from assayline.sources.tables import ship, table

#: Elements and class words that speak for content, and those that speak against it.
CONTENT = frozenset("article main maincontent content contents post postbody entry story articlebody prose".split())
OTHER = frozenset(
    "nav header footer aside menu form dialog sidebar navigation navbar breadcrumb breadcrumbs banner ad ads advert adverts advertisement sponsor sponsored promo cookie cookies consent notice alert"
    " comment comments reply replies respond discussion disqus related recommended share social subscribe newsletter signup login search popup modal copyright pagination widget toolbar".split()
)


@dataclass(frozen=True)
class ExtractConfig:
    """sample: pages learnt from; sample_chars: longer pages are not sampled. copies: renamed versions of each.
    path_size, word_size: lengths of the hashed vectors. hidden: states a direction. epochs: rounds over the sample,
    more where it is so small that they make fewer than steps updates."""

    sample: int = 128
    sample_chars: int = 60_000
    copies: int = 9
    path_size: int = 256
    word_size: int = 16
    hidden: int = 16
    epochs: int = 12
    steps: int = 480
    rate: float = 0.02
    seed: int = 5


# --- vectors ---------------------------------------------------------------------------

_NUMBERS = 8


class Vectors:
    """Blocks as rows of numbers."""

    def __init__(self, cfg: ExtractConfig):
        self.cfg = cfg
        self.known: dict[str, np.ndarray] = {}

    def name(self, token: str) -> np.ndarray:
        """The hashed vector of a tag or class word."""
        got = self.known.get(token)
        if got is None:
            if len(self.known) > 50_000:
                self.known.clear()
            got = self.known[token] = np.zeros(self.cfg.path_size)
            for part in (token, token + "$", "^" + token[:4]):  # names that begin alike share a place
                h = zlib.crc32(part.encode())
                got[h % self.cfg.path_size] += 1.0 if h >> 31 else -1.0
        return got

    def path(self, path: tuple[tuple[str, ...], ...]) -> np.ndarray:
        out = np.zeros(2 * self.cfg.path_size)
        for depth, names in enumerate(reversed(path)):
            for token in names:
                if depth < 2:
                    out[: self.cfg.path_size] += self.name(token)
                if token not in ("html", "body", "div"):
                    out[self.cfg.path_size :] += self.name(token)
        return np.clip(out, -3, 3)

    def rows(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """One matrix a page, blocks by numbers."""
        every = [b for p in pages for b in p]
        n, size = len(every), self.cfg.word_size
        if not n:
            return [np.zeros((0, self.width())) for _ in pages]
        counts = np.zeros((n, size))
        total = np.zeros(n)
        for first, data, offsets in wordhash.slices(pa.array([b.text for b in every])):
            h, owner = wordhash.words(data, offsets, wordhash.WORD_CLASSES, True)
            sign = np.where(h >> np.uint64(63), 1.0, -1.0)
            k = len(offsets) - 1
            counts[first : first + k] = np.bincount(owner * size + (h % np.uint64(size)).astype(np.int64), weights=sign, minlength=k * size).reshape(k, size)
            total[first : first + k] = np.bincount(owner, minlength=k)
        counts = np.clip(counts / np.sqrt(np.maximum(total, 1))[:, None], -2, 2)  # a word said over and over is no outlier
        cache: dict[tuple, np.ndarray] = {}
        paths = np.empty((n, 2 * self.cfg.path_size))
        for i, b in enumerate(every):
            if b.path not in cache:
                cache[b.path] = self.path(b.path)
            paths[i] = cache[b.path]
        length = np.array([len(b.text) for b in every], float)
        numbers = np.zeros((n, _NUMBERS))
        numbers[:, 0] = np.log1p(length) / 3
        numbers[:, 1] = np.log1p(total) / 2
        numbers[:, 2] = np.array([b.linked for b in every]) / length
        numbers[:, 3] = [b.text[-1] in ".!?…:\"'”»" for b in every]
        numbers[:, 4] = [b.text.count(",") + b.text.count(". ") for b in every] / np.maximum(total, 1)
        numbers[:, 5] = np.minimum([len(b.path) for b in every], 20) / 10
        ends = np.cumsum([len(p) for p in pages])
        for p, end in zip(pages, ends, strict=True):
            if p:
                own = slice(end - len(p), end)
                numbers[own, 6] = np.arange(len(p)) / len(p)
                numbers[own, 7] = length[own] / length[own].max()
        return np.split(np.hstack([paths, counts, numbers]), ends[:-1])

    def width(self) -> int:
        return 2 * self.cfg.path_size + self.cfg.word_size + _NUMBERS


# --- learning --------------------------------------------------------------------------


def marked(path: tuple[tuple[str, ...], ...]) -> bool:
    """Whether the elements that a block stands in say that it is content."""
    names = [set(n) for n in path]
    inside = [i for i, n in enumerate(names) if n & CONTENT]
    return bool(inside) and not any(n & OTHER for n in names)


#: Content stands in one of these, or in a box of neutral names.
_BODIES = (
    ("article",), ("article",), ("main",), ("div", "content"), ("div", "post", "body"), ("section", "article", "body"), ("div", "entry", "content"),
    ("div", "story"), ("div", "main", "content"), ("div", "prose"), ("div",), ("section",), ("td",), (),
)
#: Names that say nothing; boxes of both kinds carry them.
_NEUTRAL = "wrap wrapper container row col column inner outer block box area section page site layout grid left right center css main text body item group list panel clear fluid".split()
#: What a page has besides its content: tags and names of its boxes, the kind of its blocks, its places.
_KINDS = {
    "notice": ("div section p aside dialog", "cookie cookies consent gdpr ccpa privacy notice alert banner announcement warning overlay popup modal toast paywall", "said", "top mid mid end"),
    "ad": ("div aside ins section", "ad ads advert advertisement sponsored sponsor promo promotion adsbygoogle commercial affiliate partner teaser", "text", "top mid mid end"),
    "menu": ("nav div ul section", "nav menu navigation navbar topbar breadcrumb breadcrumbs pagination pager tabs sitemap links skip", "links", "top mid end"),
    "header": ("header div section", "header masthead top branding logo tagline", "head", "top"),
    "footer": ("footer div section", "footer bottom copyright colophon legal imprint disclaimer", "foot", "end"),
    "side": ("aside div section", "sidebar aside widget rail related recommended popular trending latest tags archive categories more", "mixed", "top mid mid end"),
    "form": ("form div section", "form newsletter signup subscribe login register search contact survey poll", "form", "top mid mid end"),
    "comments": ("section div ol ul", "comment comments commentlist respond responses reply replies discussion disqus thread reviews feedback guestbook reactions", "talk", "mid end end"),
    "share": ("div ul p", "share sharing social follow likes toolbar", "links", "mid end"),
}
#: Tags that need no name to tell their kind.
_TELLING = frozenset("nav header footer aside form ins dialog".split())
_SAYINGS = (
    "We use cookies to improve this site.", "This site asks for your consent.", "Accept all", "Reject", "Accept all cookies", "I agree", "We value your privacy", "Manage settings",
    "Please turn on JavaScript.", "This page is old.", "Read our privacy policy", "Continue", "Close", "You have one free text left.", "Scheduled maintenance tonight.",
)
_FORM = ("Subscribe to our newsletter", "Your e-mail address", "Send", "Search", "Name", "Password", "Sign in", "Sign up", "Your message", "Subscribe", "Log in", "Remember me", "Country")
_LINKS = ("Home", "News", "About", "Contact", "Share", "Tweet", "E-mail", "Print", "Next", "Previous", "Terms", "Privacy", "Archive", "Help", "Login", "Sport", "Shop", "RSS")


class _Maker:
    """Pages of many shapes around the texts of sampled ones."""

    def __init__(self, pool: list[str], menu: list[str], rng: np.random.Generator):
        self.pool, self.menu, self.rng = pool, menu, rng

    def pick(self, some):
        return some[self.rng.integers(len(some))]

    def chance(self, p: float) -> bool:
        return bool(self.rng.random() < p)

    def sentence(self) -> str:
        """A part of a content text, so that short blocks and other people's words are no tell-tale."""
        parts = self.pick(self.pool).split(". ")
        return self.pick(parts) or "text"

    def noise(self, names: tuple[str, ...], p: float) -> tuple[str, ...]:
        """Names with neutral or meaningless ones added to some."""
        while self.chance(p):
            made = "".join(self.pick("abcdefghijklmnopqrstuvwxyz") for _ in range(self.rng.integers(1, 7)))
            names = (*names, self.pick(_NEUTRAL) if self.chance(0.6) else made)
        return names

    def content(self, text: str, tag: str) -> list[tuple[str, tuple, int]]:
        """(text, path below the body, linked) of one content block, or of several of its kind."""
        if re.fullmatch("h[1-6]", tag):
            return [(text, (self.noise((tag,), 0.1),), 0)]
        made = self.rng.random()
        if made < 0.45:
            short = " ".join(text.split(" ")[: self.rng.integers(1, 6)]) if self.chance(0.15) else text
            return [(short, (self.noise((tag,), 0.1),), 0)]
        few = [self.sentence() for _ in range(self.rng.integers(1, 6))]
        if made < 0.58:
            outer, linked = self.pick((("ul",), ("ol",))), self.chance(0.45)
            return [(t, (self.noise(outer, 0.1), ("li",)) + ((("p",),) if self.chance(0.2) else ()), len(t) * linked) for t in few]
        if made < 0.68:
            cells = [(t, (("table",), *((("tbody",),) if self.chance(0.6) else ()), ("tr",), ("th",) if i == 0 and self.chance(0.6) else ("td",)), 0) for i, t in enumerate(few + few[:2])]
            return cells + [(text, (("p",),), 0)]
        if made < 0.74:
            return [(text, (("pre",),) if self.chance(0.5) else (("pre",), ("code",)), 0)]
        if made < 0.82:
            return [(text, (("blockquote",),) if self.chance(0.5) else (("blockquote",), ("p",)), 0)]
        if made < 0.87:
            return [(few[0], (("figure",), ("figcaption",)), 0), (text, (("p",),), 0)]
        if made < 0.92:
            return [(t, (("dl",), ("dt",) if i % 2 == 0 else ("dd",)), 0) for i, t in enumerate(few)]
        if made < 0.96:
            return [(text, (self.noise(("div",), 0.3),), 0)]
        head = (few[0], (self.pick((("h2",), ("h3",), ("h4",))),), 0)
        return [head, (text, (("section",), ("p",)), 0)] if self.chance(0.4) else [head, *((t, (("ul",), ("li",)), len(t)) for t in few)]

    def box(self, kind: str) -> list[tuple[str, tuple, int]]:
        """Blocks of something that is not content, with their paths below the place it is put."""
        tags, names, style, _ = _KINDS[kind]
        tag = self.pick(tags.split())
        known = names.split()
        outer = self.noise((tag,) if tag in _TELLING and self.chance(0.5) else (tag, self.pick(known)) + ((self.pick(known),) if self.chance(0.15) else ()), 0.25)
        base = (outer,) + ((self.noise(("div",), 0.5),) if self.chance(0.3) else ())
        n = self.rng.integers(1, 6)
        link = lambda: self.pick(_LINKS) if self.chance(0.4) else self.pick(self.menu)
        below: tuple = (("li",),) if outer[0] in ("ul", "ol") else ()
        lists = below or (("ul",), ("li",))
        if style == "links":
            inner = self.pick((lists, lists, (("span",),), ()))
            return [(t, (*base, *inner, *((("a",),) if self.chance(0.3) else ())), len(t)) for t in (link() for _ in range(n + 1))]
        if style == "said":
            said = [self.pick(_SAYINGS) if self.chance(0.75) else self.sentence() for _ in range(n)]
            return [(t, (*base, *below, *self.pick(((("p",),), (), (("button",),), (("div",),), (("h2",),)))), len(t) if self.chance(0.2) else 0) for t in said[:4]]
        if style == "form":
            return [(self.pick(_FORM), (*base, *self.pick(((("label",),), (("p",),), (("button",),), (("div",),), (("h3",),)))), 0) for _ in range(n)]
        if style == "foot":
            return [("\u00a9 " + self.sentence() if self.chance(0.5) else link(), (*base, *self.pick(((("p",),), (), (("ul",), ("li",)), (("div",),)))), 0) for _ in range(min(n, 3))]
        if style == "head":
            return [(self.sentence()[:60] or "Site", (*base, *self.pick(((("h1",),), (("h2",),), (("p",),), (), (("div", "title"),)))), 0) for _ in range(min(n, 3))]
        if style == "text":
            return [(self.pick(self.pool) if self.chance(0.5) else self.sentence(), (*base, *self.pick(((("p",),), (), (("h3",),), (("div",),)))), 0) for _ in range(min(n, 3))]
        if style == "mixed":
            out = [(self.sentence(), (*base, *self.pick(((("h2",),), (("h3",),)))), 0)] if self.chance(0.5) else []
            inner = self.pick((lists, (("p",),), ()))
            return out + [(t, (*base, *inner), len(t) if self.chance(0.6) else 0) for t in (self.sentence() if self.chance(0.6) else self.pick(self.pool) for _ in range(n))]
        inner = self.pick((below or (("div", "comment"),), (*below, ("p",)), (*below, ("div",), ("p",)), (*(below or (("article", "comment"),)), ("p",)), below))
        out = [(self.pick(("Comments", "Responses", "3 replies", "Discussion")), (*base, ("h3",)), 0)] if self.chance(0.4) else []
        for _ in range(n):
            if self.chance(0.3):
                out.append((self.sentence()[:20] or "Ann", (*base, *inner[:-1], *self.pick(((("span",),), (("cite",),), (("div", "author"),)))), 0))
            out.append((self.pick(self.pool) if self.chance(0.4) else self.sentence(), (*base, *inner), 0))
        return out

    def page(self, real: list[Block]) -> tuple[list[Block], list[int]]:
        """The content of a page in other tags and boxes, with other things around and inside it, and all labels."""
        body = self.pick(_BODIES)
        root = (("html",), ("body",))
        outer = tuple(self.noise(("div",), 0.5) for _ in range(self.rng.integers(0, 3)))
        home = (*root, *outer, *((self.noise(body, 0.45),) if body else ()))
        home = home + (self.noise(("div",), 0.4),) if self.chance(0.2) else home
        kinds = list(_KINDS)
        there = {k: self.pick(_KINDS[k][3].split()) for k in kinds if self.chance({"menu": 0.8, "footer": 0.7, "header": 0.4}.get(k, 0.45))}
        out: list[tuple[Block, int]] = []

        def put(these: list[str], base: tuple) -> None:
            for k in [these[i] for i in self.rng.permutation(len(these))]:
                out.extend((Block(t, (*base, *path), min(linked, len(t))), 0) for t, path, linked in self.box(k) if t.strip())

        around = home if self.chance(0.25) else (*root, *outer) if self.chance(0.4) else root
        put([k for k, place in there.items() if place == "top"], around)
        own = [b for b in real if marked(b.path)]
        if self.chance(0.05):
            own = own * int(self.rng.integers(5, 20))  # some pages are very long
        middle = {k: self.rng.integers(0, len(own) + 1) for k, place in there.items() if place == "mid"}
        for i, b in enumerate(own):
            put([k for k, at in middle.items() if at == i], home)
            tag = b.path[-1][0] if b.path[-1][0] in ("h1", "h2", "h3") else "p"
            out.extend((Block(t, (*home, *path), min(linked, len(t))), 1) for t, path, linked in self.content(b.text, tag) if t.strip())
        put([k for k, at in middle.items() if at == len(own)], home)
        put([k for k, place in there.items() if place == "end"], around)
        return [b for b, _ in out], [y for _, y in out]


def learn(pages: list[list[Block]], cfg: ExtractConfig) -> bilstm.Weights:
    """Weights from pages that mark their content; pages that don't are left out, and without any there are plain ones."""
    rng = np.random.default_rng(cfg.seed)
    usable_pages = [p for p in pages if any(marked(b.path) for b in p)]
    if len(usable_pages) < 8:
        filler = [f"The {a} {b} of the page is {c}." for a in ("first", "long", "old", "plain") for b in ("part", "line", "word") for c in ("here", "there", "gone", "new")]
        body = (("html",), ("body",))
        for _ in range(32):
            said = lambda k: [filler[rng.integers(len(filler))] for _ in range(k)]
            menu = [Block(t, (*body, ("nav",), ("ul",), ("li",)), len(t)) for t in ("Home", "News", "About", "Contact")]
            text = [Block(" ".join(said(3)), (*body, ("article",), ("p",)), 0) for _ in range(rng.integers(2, 9))]
            usable_pages.append([*menu, *text, Block("© " + said(1)[0], (*body, ("footer",)), 0)])
    pool = [b.text for p in usable_pages for b in p if marked(b.path) and len(b.text) < 600] or ["text"]
    menu = [b.text for p in usable_pages for b in p if b.linked >= len(b.text) and len(b.text) < 60] or list(_LINKS)
    maker = _Maker(pool, menu, rng)
    seen: list[list[Block]] = []
    labels: list[np.ndarray] = []
    for p in usable_pages:
        seen.append(p)
        labels.append(np.array([marked(b.path) for b in p], float))
        for _ in range(cfg.copies):
            q, y = maker.page(p)
            seen.append(q)
            labels.append(np.array(y, float))
    return bilstm.train(Vectors(cfg).rows(seen), labels, cfg.hidden, cfg.epochs, cfg.rate, cfg.seed, cfg.steps)


def fit(pages: DataFrame, cfg: ExtractConfig = ExtractConfig()) -> bilstm.Weights:
    """Weights learnt, in one task, from the cfg.sample pages whose ids hash lowest."""
    ship(pages.sparkSession)
    sample = pages.select("page_id", "html").where((F.col("html") != "") & (F.length("html") <= cfg.sample_chars)).orderBy(F.xxhash64("page_id"), "page_id", "html").limit(cfg.sample)

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(["page_id", "html"], kind="stable")["html"]
        return pd.DataFrame({"weights": [pickle.dumps(learn([list(blocks(x)) for x in rows], cfg))]})

    got = sample.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(train, "weights binary").collect()
    return pickle.loads(bytes(got[0][0])) if got else learn([], cfg)


def main_texts(htmls: list[str], weights: bilstm.Weights, vectors: Vectors) -> list[str]:
    """Content blocks of each page, joined by line ends."""
    pages = [list(blocks(h)) for h in htmls]
    chances = bilstm.predict(vectors.rows(pages), weights)
    return ["\n".join(b.text for b, p in zip(page, chance, strict=True) if p >= 0.5) for page, chance in zip(pages, chances, strict=True)]


def extract(pages: DataFrame, weights: bilstm.Weights, cfg: ExtractConfig = ExtractConfig()) -> DataFrame:
    """pages with main_text, which takes the place of a column of that name: never null; null and empty html, and pages
    without a content block, give ''. NUL and lone surrogates are left out, as is what is not shown as text: scripts,
    styles, and what stands in for them (noscript, object, iframe, svg, math, audio, video). Every row is read whole and
    alone, whatever its page_id, repeated or null."""
    spark = pages.sparkSession
    ship(spark)
    short_batches(spark)
    shipped = spark.sparkContext.broadcast(weights)

    @F.arrow_udf("string")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vectors = Vectors(cfg)
        for b in batches:
            yield pa.array(main_texts([re.sub("[\x00\ud800-\udfff]", "", h or "") for h in b.to_pylist()], shipped.value, vectors), pa.string())

    return pages.withColumn("main_text", of(F.col("html")))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = extract(pages, fit(pages))
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))
