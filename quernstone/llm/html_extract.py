"""Main text of web pages: a linear-chain conditional random field over their leaf blocks."""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html_blocks import Block, leaf_blocks

#: The field is fitted on so many pages at most, none of more characters than this; it is applied to all.
TRAINING_PAGES, TRAINING_CHARS = 300, 100_000
#: Layouts that each labelled page's blocks are set in, besides its own.
LAYOUTS = 4
ROUNDS, RATE, DECAY = 250, 0.15, 2e-4
_MARK = ""

# Names that pages commonly give to their parts.
CONTENT_NAMES = (
    "article", "article-body", "body", "content", "content-body", "entry", "entry-content", "main", "main-content",
    "page-content", "post", "post-body", "post-content", "prose", "rich-text", "story", "story-body", "text",
)
PART_NAMES = {
    "menu": ("breadcrumb", "breadcrumbs", "main-menu", "menu", "nav", "navbar", "navigation", "pager", "site-nav",
             "skip-links", "tabs", "toolbar", "topbar"),
    "header": ("banner", "branding", "header", "logo", "masthead", "page-header", "site-header", "top"),
    "footer": ("bottom", "colophon", "copyright", "footer", "footer-links", "legal", "page-footer", "site-footer"),
    "sidebar": ("aside", "popular", "rail", "recent-posts", "related", "related-posts", "sidebar", "tag-cloud",
                "trending", "widget", "widget-area"),
    "notice": ("alert", "consent", "cookie", "cookie-banner", "disclaimer", "gdpr", "info-bar", "message", "modal",
               "notice", "notification", "overlay", "paywall", "popup", "privacy", "toast", "warning"),
    "advert": ("ad", "ad-slot", "ads", "advert", "advertisement", "adsense", "banner-ad", "promo", "promotion",
               "promoted", "sponsor", "sponsored"),
    "form": ("contact-form", "form", "login", "newsletter", "register", "search", "search-form", "signup", "subscribe",
             "subscription"),
    "comments": ("comment", "comment-body", "comment-list", "comments", "comments-area", "discussion", "disqus",
                 "feedback", "replies", "reply", "respond", "reviews", "thread"),
    "share": ("author-box", "byline", "meta", "post-meta", "share", "share-buttons", "sharing", "social", "tags",
              "toolbox"),
}
PART_TAGS = {
    "menu": ("nav", "nav", "div", "ul"),
    "header": ("header", "header", "div"),
    "footer": ("footer", "footer", "div"),
    "sidebar": ("aside", "aside", "div", "section"),
    "notice": ("div", "section", "aside", "p", "dialog"),
    "advert": ("div", "aside", "section", "ins"),
    "form": ("form", "form", "div"),
    "comments": ("section", "div", "div", "aside", "ol"),
    "share": ("div", "div", "ul"),
}
CUES = re.compile(
    r"©|copyright|all rights reserved|cookie|privacy|subscribe|newsletter|sign up|log ?in|advert|sponsor|"
    r"repl(?:y|ies)|comment|share|read more|related|terms of",
    re.I,
)
_WORD = re.compile(r"\w+")
_CONTENT_WORDS = frozenset(w for n in CONTENT_NAMES for w in n.split("-")) - {"page", "body"}
_PART_WORDS = frozenset(w for names in PART_NAMES.values() for n in names for w in n.split("-")) - frozenset(
    "area author bar body bottom box cloud info links list main message page post posts recent site skip slot text top "
    "contact".split()
)


def _step(value: float, steps: tuple[float, ...]) -> int:
    return sum(value >= s for s in steps)


def page_features(blocks: list[Block]) -> list[list[str]]:
    """Features of each block: tags and names around it, and its text beside the page's longest block."""
    if not blocks:
        return []
    words = [{w.lower() for w in _WORD.findall(b.text)} for b in blocks]
    longest = words[max(range(len(blocks)), key=lambda k: len(blocks[k].text))]
    out = []
    for k, b in enumerate(blocks):
        n = b.text.count(" ") + 1
        found = {f"in:{t}" for t in b.tags} | {f"named:{w}" for w in b.names}
        tag = b.tags[-1] if b.tags else ""
        inside = "within" if {"article", "main"} & set(b.tags) or b.names & _CONTENT_WORDS else "without"
        found |= {f"tag:{tag}", f"{inside}:{tag}"} | {f"{inside}:in:{t}" for t in ("header", "li", "form") if t in b.tags}
        size = _step(n, (2, 4, 8, 15, 30, 60))
        found.add(f"size:{size}")
        found.add(f"link:{_step(b.linked / len(b.text), (0.01, 0.3, 0.7, 0.95))}")
        end = b.text[-1]
        found.add("end:" + (end if end in ".!?:;,…" else "word" if end.isalnum() else "sign"))
        shared = len(words[k] & longest) / max(1, len(words[k]))
        found.add(f"shared:{_step(shared, (0.1, 0.25, 0.5, 0.75, 1.0))}:{min(size, 3)}")
        if CUES.search(b.text):
            found.add(f"cue:{min(size, 4)}")
        if b.names & _PART_WORDS:
            found.add("part-name")
        kind = "part" if b.nearest & _PART_WORDS else "content" if b.nearest & _CONTENT_WORDS else "other"
        found.add(f"nearest:{kind if b.nearest else 'none'}")
        found.add("bias")
        out.append(sorted(found))
    return out


@dataclass
class Field:
    """A linear-chain field with two labels: weights for 'main' by feature, and of label pairs."""

    weights: dict[str, float]
    start: np.ndarray  # 2
    pairs: np.ndarray  # 2 x 2

    def decode(self, features: list[list[str]]) -> list[bool]:
        """The likeliest labels by Viterbi's algorithm; ties go to 'not main'."""
        if not features:
            return []
        get = self.weights.get
        (stay, go), (leave, keep) = self.pairs.tolist()
        out, main = float(self.start[0]), float(self.start[1]) + sum(get(f, 0.0) for f in features[0])
        back = []
        for own in features[1:]:
            score = sum(get(f, 0.0) for f in own)
            from_main_out, from_main = main + leave > out + stay, main + keep >= out + go
            back.append((from_main_out, from_main))
            out, main = (
                main + leave if from_main_out else out + stay,
                (main + keep if from_main else out + go) + score,
            )
        labels = [main > out]
        for choices in reversed(back):
            labels.append(choices[labels[-1]])
        return labels[::-1]


def fit(pages: list[tuple[list[list[str]], list[bool]]], rounds: int = ROUNDS) -> Field:
    """Maximum likelihood by Adam steps on the whole set, forward and backward over all pages at once.

    Pages stand in columns, the longest first, so that a step along the chains
    takes the pages that reach so far.
    """
    pages = sorted((page for page in pages if page[0]), key=lambda page: -len(page[0]))
    width, count = len(pages[0][0]) if pages else 0, len(pages)
    active = [sum(len(f) > k for f, _ in pages) for k in range(width)]
    seen: dict[str, int] = {}
    blocks, columns = [], []
    labels = np.zeros((width, count), dtype=int)
    mask = np.zeros((width, count), dtype=bool)
    for p, (features, y) in enumerate(pages):
        labels[: len(y), p] = y
        mask[: len(y), p] = True
        for k, own in enumerate(features):
            for f in own:
                blocks.append(k * count + p)
                columns.append(seen.setdefault(f, len(seen)))
    blocks, columns = np.array(blocks, dtype=int), np.array(columns, dtype=int)
    n = len(seen)
    theta = np.zeros(n + 6)  # weights, start, pairs
    first, second, gold = np.zeros_like(theta), np.zeros_like(theta), np.zeros_like(theta)
    gold[:n] = np.bincount(columns, weights=labels.reshape(-1)[blocks], minlength=n)
    if width:
        gold[n : n + 2] = np.bincount(labels[0], minlength=2)
        gold[n + 2 :] = np.bincount((2 * labels[:-1] + labels[1:])[mask[1:]], minlength=4)
    total = max(1, mask.sum())
    for turn in range(1, rounds + 1):
        score = np.bincount(blocks, weights=theta[columns], minlength=mask.size).reshape(mask.shape)
        top = np.maximum(score, 0)
        own = np.stack([np.exp(-top), np.exp(score - top)], axis=2)
        start, pairs = np.exp(theta[n : n + 2]), np.exp(theta[n + 2 :]).reshape(2, 2)
        expected = np.zeros_like(theta)
        forward, backward = np.zeros_like(own), np.ones_like(own)
        for k, m in enumerate(active):
            reached = (start if k == 0 else forward[k - 1, :m] @ pairs) * own[k, :m]
            forward[k, :m] = reached / reached.sum(axis=1, keepdims=True)
        for k in range(width - 2, -1, -1):
            m = active[k + 1]
            ahead = own[k + 1, :m] * backward[k + 1, :m]
            both = forward[k, :m, :, None] * pairs * ahead[:, None, :]
            expected[n + 2 :] += (both / both.sum(axis=(1, 2), keepdims=True)).sum(axis=0).reshape(-1)
            reached = ahead @ pairs.T
            backward[k, :m] = reached / reached.sum(axis=1, keepdims=True)
        one = forward * backward
        one /= np.maximum(one.sum(axis=2, keepdims=True), 1e-300)
        expected[:n] = np.bincount(columns, weights=one[:, :, 1].reshape(-1)[blocks], minlength=n)
        if width:
            expected[n : n + 2] = one[0].sum(axis=0)
        gradient = (gold - expected) / total - DECAY * theta
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        theta += RATE * (first / (1 - 0.9**turn)) / (np.sqrt(second / (1 - 0.999**turn)) + 1e-8)
    return Field({f: float(theta[k]) for f, k in seen.items()}, theta[n : n + 2], theta[n + 2 :].reshape(2, 2))


def own_labels(blocks: list[Block]) -> list[bool] | None:
    """Labels by a page's own markup; None where it marks no main part.

    Main is what stands in ``article`` or ``main``, but for menus, asides,
    footers, forms and parts that are named as such.
    """
    if not any({"article", "main"} & set(b.tags) for b in blocks):
        return None
    out = {"nav", "aside", "footer", "form", "dialog", "button"}
    return [
        bool({"article", "main"} & set(b.tags)) and not out & set(b.tags) and not b.names & _PART_WORDS for b in blocks
    ]


def relaid(main: list[tuple[str, str]], others: list[str], strangers: list[str], rng: random.Random) -> str:
    """A page of another layout: main blocks marked, other texts in parts that are named by chance.

    ``main`` are tags and texts, ``others`` short texts of the page's own parts,
    ``strangers`` running texts of other pages, as comments and teasers have.
    """
    text = lambda: rng.choice(others or strangers or ["..."])
    long = lambda: rng.choice(strangers or others or ["..."])

    def named(names) -> str:
        return rng.choice(("class", "class", "class", "id")) + f'="{rng.choice(names)}"' if rng.random() < 0.9 else ""

    def inner(part: str) -> str:
        if part in ("menu", "share"):
            items = "".join(f"<li><a href='/x'>{_short(text(), rng)}</a></li>" for _ in range(rng.randint(2, 7)))
            return rng.choice((f"<ul>{items}</ul>", items.replace("li>", "span>")))
        if part == "comments":
            wrap = rng.choice(("div", "li", "article", "div"))
            about = lambda: f"<{wrap} {named(PART_NAMES['comments'])}>"
            who = lambda: rng.choice(("", f"<h4>{_short(text(), rng)}</h4>", f"<span>{_short(text(), rng)}</span>"))
            return rng.choice(("", "<h3>Comments</h3>")) + "".join(
                f"{about()}{who()}<p>{long()}</p></{wrap}>" for _ in range(rng.randint(1, 4))
            )
        if part == "form":
            return f"<label>{_short(text(), rng)}</label><input type='text'><button>{_short(text(), rng)}</button>" + (
                f"<p>{text()}</p>" if rng.random() < 0.5 else ""
            )
        if part == "sidebar":
            items = "".join(f"<li><a href='/y'>{_short(long(), rng)}</a></li>" for _ in range(rng.randint(1, 5)))
            teaser = f"<p>{rng.choice((text(), long()))}</p>"
            return f"<h3>{_short(text(), rng)}</h3>" + rng.choice((f"<ul>{items}</ul>", teaser, teaser + items))
        if part == "footer":
            return rng.choice(("&copy; ", "", "&copy; ")) + text() + rng.choice(("", f"<p>{text()}</p>"))
        if part == "header":
            return rng.choice((f"<a href='/'>{_short(text(), rng)}</a>", f"<p>{text()}</p>",
                               f"<h1>{_short(text(), rng)}</h1>", f"<h2>{_short(text(), rng)}</h2>"))
        return rng.choice((text(), f"<p>{text()}</p>", f"<p>{long()}</p>", f"<a href='/z'>{text()}</a>"))

    def part(kind: str) -> str:
        tag = rng.choice(PART_TAGS[kind])
        return f"<{tag} {named(PART_NAMES[kind])}>{inner(kind)}</{tag}>"

    def kept(tag: str, t: str) -> str:
        """A main block: mostly as it was, else as a list, quotation, table or heading."""
        form = rng.random()
        if form < 0.75 or tag != "p":
            return f"<{tag}>{_MARK}{t}</{tag}>"
        if form < 0.85:
            items = "".join(f"<li>{_MARK}{s}</li>" for s in t.split(". ") if s.strip())
            return rng.choice((f"<ul>{items}</ul>", f"<ol>{items}</ol>"))
        if form < 0.9:
            cells = "".join(f"<td>{_MARK}{s}</td>" for s in t.split(". ")[:4] if s.strip())
            return f"<table><tr>{cells}</tr></table>"
        if form < 0.94:
            return f"<h2>{_MARK}{_short(t, rng)}</h2><p>{_MARK}{t}</p>"
        tag = rng.choice(("blockquote", "div", "pre", "dd", "figcaption"))
        return f"<{tag}>{_MARK}{t}</{tag}>"

    body = [kept(tag, t) for tag, t in main]
    for kind in ("advert", "notice", "share", "form"):
        if len(body) > 1 and rng.random() < 0.3:
            body.insert(rng.randint(1, len(body)), part(kind))
    tag = rng.choice(("article", "main", "div", "div", "section", "td", ""))
    content = f"<{tag} {named(CONTENT_NAMES)}>{''.join(body)}</{tag}>" if tag else "".join(body)
    if rng.random() < 0.3:
        content = f"<div {named(CONTENT_NAMES)}>{content}{part('comments') if rng.random() < 0.5 else ''}</div>"
    before = [part(k) for k in ("notice", "header", "menu", "advert", "sidebar", "form") if rng.random() < 0.45]
    after = [part(k) for k in ("share", "comments", "sidebar", "advert", "form", "menu", "notice") if rng.random() < 0.4]
    rng.shuffle(before)
    rng.shuffle(after)
    foot = part("footer") if rng.random() < 0.8 else ""
    return f"<html><body>{''.join(before)}{content}{''.join(after)}{foot}</body></html>"


def _short(text: str, rng: random.Random) -> str:
    return " ".join(text.split(" ")[: rng.randint(1, 5)])


def train(htmls: list[str], layouts: int = LAYOUTS, rounds: int = ROUNDS) -> Field:
    """Fit the field on labelled pages: those that mark their main part, as they are and in other layouts."""
    from html import escape

    rng = random.Random(11)
    examples, material = [], []
    for html in htmls:
        blocks = leaf_blocks(html)
        labels = own_labels(blocks)
        if labels is not None:
            examples.append((page_features(blocks), labels))
            material.append((blocks, labels))
    running = [escape(b.text) for blocks, labels in material for b, y in zip(blocks, labels) if y and b.text.count(" ") > 5]
    everyday = [escape(b.text) for blocks, labels in material for b, y in zip(blocks, labels) if not y]
    for blocks, labels in material:
        main = [(b.tags[-1] if b.tags and b.tags[-1] in ("h1", "h2", "h3", "p", "li") else "p", escape(b.text))
                for b, y in zip(blocks, labels) if y]
        others = [escape(b.text) for b, y in zip(blocks, labels) if not y] + rng.sample(everyday, min(3, len(everyday)))
        for _ in range(layouts):
            if main:
                page = leaf_blocks(relaid(main, others, rng.sample(running, min(12, len(running))), rng))
                labels_of = [b.text.startswith(_MARK) for b in page]
                for b in page:
                    b.text = b.text.removeprefix(_MARK) or "-"
                examples.append((page_features(page), labels_of))
    return fit(examples, rounds)


def train_on(pages: DataFrame, id_column: str = "page_id", html_column: str = "html",
             most_pages: int = TRAINING_PAGES, most_chars: int = TRAINING_CHARS) -> Field:
    """Fit the field on ``most_pages`` pages of up to ``most_chars`` characters, chosen by the hash of their id.

    Every task hands its first pages to the driver, so pages are thinned out by
    hash before, to about three times as many as are wanted in all.
    """
    place = F.pmod(F.xxhash64(id_column), F.lit(1 << 40))
    share = min(1.0, 3 * most_pages / max(1, pages.count()))
    usable = pages.where((place < int(share * (1 << 40))) & (F.length(html_column) <= most_chars))
    chosen = usable.orderBy(place, html_column).limit(most_pages).select(html_column)
    return train([r[0] for r in chosen.collect()])


def main_text(html: str, field: Field) -> str:
    blocks = leaf_blocks(html)
    labels = field.decode(page_features(blocks))
    return "\n".join(b.text for b, y in zip(blocks, labels) if y)


def extract_text(pages: DataFrame, field: Field, id_column: str = "page_id", html_column: str = "html") -> DataFrame:
    """``id, text``: the main text of each page, from its whole html.

    A row per row given; null and empty pages, and pages without main text,
    give an empty text. Repeated rows are alike. No rows give no rows; other columns are not read.
    """
    parts = (field.weights, field.start, field.pairs)
    kind = pages.schema[id_column].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = Field(*parts)
        for batch in batches:
            texts = [main_text(html or "", field) for html in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    chosen = pages.select(F.col(id_column).alias("id"), F.col(html_column).cast("string").alias("html"))
    return chosen.mapInArrow(work, f"id {kind}, text string")
