"""Main text of web pages: a linear-chain conditional random field over leaf blocks.

A page is read as a sequence of leaf blocks, the stretches of text between block
tags. A block's features are its ancestor tags, the words of their class, id and
role attributes, and properties of its text. The chain scores each block as
content or not from its features, and each pair of neighbours from their labels;
Viterbi decoding gives the best labelling of the whole page.

The field is trained on labelled pages: ``labelled_pages`` makes them, in many
layouts, with the label of every block known. Pages are decoded where they are
read, without a shuffle.

Null and empty pages, and pages without content blocks, give an empty text.
Unclosed tags, stray tags and cut-off pages are read as far as they go. Repeated
pages are taken as they come, other columns are ignored, an empty table gives no
rows.
"""

from __future__ import annotations

import html as entities
import random
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The kinds of element, as the markup language defines them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template svg math iframe object select".split())
INLINE = frozenset((
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span "
    "strike strong sub sup time tt u var wbr").split())
CLOSES = {  # an opening tag ends an open element of these, up to the nearest container
    "p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"},
    "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"},
}
ENDS_PARAGRAPH = frozenset((
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main "
    "nav ol pre section table ul").split())
BARRIER = frozenset("ul ol dl table div section article main nav aside header footer form body".split())

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)(?:>|\Z)",
                     re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop|hidden|style|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")


@dataclass
class Block:
    """A leaf block: its text, open elements (tag, names), and characters in links."""

    text: str
    path: tuple
    linked: int
    tags: frozenset


def leaf_blocks(page: str) -> list[Block]:
    """Leaf blocks of a page, in order; markup, scripts and styles are left out."""
    blocks, parts, stack, linked, links, inner = [], [], [], 0, 0, set()

    def flush():
        nonlocal linked
        text = _SPACE.sub(" ", entities.unescape("".join(parts))).strip()
        if text:
            blocks.append(Block(text, tuple(stack), linked, frozenset(inner)))
        parts.clear()
        inner.clear()
        linked = 0

    def pop(names, barrier):
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in names:
                del stack[i:]
                return
            if stack[i][0] in barrier:
                return

    at = 0
    while m := _MARKUP.search(page, at):
        if m.start() > at:
            parts.append(page[at:m.start()])
            linked += links * (m.start() - at)
        at = m.end()
        closing, tag, rest = m[1], (m[2] or "").lower(), m[3] or ""
        if not tag:
            continue
        if tag in RAW:
            if not closing and not rest.endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else len(page)
                parts.append(" ")
            continue
        if tag in INLINE:
            if tag == "a":
                links = 0 if closing else 1
            if tag in ("br", "img", "wbr"):
                parts.append(" " if tag == "br" else "")
            elif not closing:
                inner.add(tag)
            continue
        flush()
        if closing:
            pop({tag}, ())
        elif tag not in VOID:
            if tag in CLOSES:
                pop(CLOSES[tag], BARRIER - CLOSES[tag])
            if tag in ENDS_PARAGRAPH:
                pop({"p"}, BARRIER)
            links = 0
            stack.append((tag, _names(rest)))
    parts.append(page[at:])
    flush()
    return blocks


def _names(attributes: str) -> tuple:
    """Words of an element's class, id and role; ``hidden`` if it is not shown."""
    names = []
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(
                r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            names.append("hidden")
        elif key in ("class", "id", "role", "itemprop"):
            names += [w.lower() for w in _NAME.findall(value)]
    return tuple(dict.fromkeys(names))


def features(blocks: list[Block]) -> list[set[str]]:
    """Features of each block, from itself and from its place."""
    out = []
    for i, b in enumerate(blocks):
        n, words = len(b.text), b.text.count(" ") + 1
        found = {"bias", f"words{min(7, words.bit_length())}", f"linked{min(4, int(5 * b.linked / n))}",
                 f"stops{min(3, sum(b.text.count(c) for c in '.!?。'))}", f"commas{min(2, b.text.count(','))}",
                 f"end{b.text[-1] if b.text[-1] in '.!?:…”\"' else ''}",
                 f"place{min(4, 5 * i // len(blocks))}"}
        if re.search(r"[©®»]|\b(?:19|20)\d\d\b", b.text):
            found.add("marks")
        if not b.path:
            found.add("bare")
        for depth, (tag, names) in enumerate(reversed(b.path)):
            found.add(f"in:{tag}")
            found |= {f"name:{w}" for w in names}
            if depth == 0:
                found.add(f"parent:{tag}")
        found |= {f"has:{t}" for t in b.tags}
        out.append(found)
    for i, found in enumerate(out):
        found |= {f"before:{f}" for f in (out[i - 1] if i else ()) if f.startswith("parent:")}
    return out


@dataclass
class Field:
    """Weights of the chain: per feature and label, and per pair of labels."""

    index: dict[str, int]
    weights: np.ndarray
    pairs: np.ndarray

    def emissions(self, found: list[set[str]]) -> np.ndarray:
        return np.array([self.weights[[self.index[f] for f in x if f in self.index]].sum(0) for x in found])

    def decode(self, blocks: list[Block]) -> np.ndarray:
        """The best labels (1: content) of a page's blocks, by Viterbi."""
        if not blocks:
            return np.zeros(0, int)
        e = self.emissions(features(blocks))
        best, back = e[0], []
        for x in e[1:]:
            options = best[:, None] + self.pairs
            back.append(options.argmax(0))
            best = options.max(0) + x
        labels = [int(best.argmax())]
        for b in reversed(back):
            labels.append(int(b[labels[-1]]))
        return np.array(labels[::-1])


def train(pages: list[tuple[list[Block], list[int]]], *, epochs: int = 15, rate: float = 0.1,
          decay: float = 1e-3, seed: int = 2) -> Field:
    """Fits the field to labelled pages: stochastic ascent of the log-likelihood (Adagrad)."""
    seen = [(features(b), y) for b, y in pages if b]
    index = {f: i for i, f in enumerate(sorted({f for x, _ in seen for s in x for f in s}))}
    field = Field(index, np.zeros((len(index), 2)), np.zeros((2, 2)))
    rows = [([np.array([index[f] for f in s]) for s in x], np.array(y)) for x, y in seen]
    sums = [np.full_like(field.weights, 1e-6), np.full_like(field.pairs, 1e-6)]
    rng = random.Random(seed)
    for _ in range(epochs):
        rng.shuffle(rows)
        for at, y in rows:
            e = np.array([field.weights[a].sum(0) for a in at])
            n = len(y)
            ahead, behind = np.zeros((n, 2)), np.zeros((n, 2))
            ahead[0] = e[0]
            for i in range(1, n):
                ahead[i] = np.logaddexp.reduce(ahead[i - 1][:, None] + field.pairs, axis=0) + e[i]
            for i in range(n - 2, -1, -1):
                behind[i] = np.logaddexp.reduce(field.pairs + e[i + 1] + behind[i + 1], axis=1)
            total = np.logaddexp(*ahead[-1])
            slope = np.eye(2)[y] - np.exp(ahead + behind - total)
            g = -decay * field.pairs
            for i in range(1, n):
                g = g - np.exp(ahead[i - 1][:, None] + field.pairs + e[i] + behind[i] - total)
                g[y[i - 1], y[i]] += 1
            for a, s in zip(at, slope, strict=True):
                step = s - decay * field.weights[a]
                sums[0][a] += step * step
                field.weights[a] += rate * step / np.sqrt(sums[0][a])
            sums[1] += g * g
            field.pairs += rate * g / np.sqrt(sums[1])
    return field


# Labelled pages. Each part is (label, opening markup, kind of text, closing
# markup); a layout is a list of parts, and "*" repeats the part before it.
_PARTS = {
    "menu": [(0, '<nav><ul>', "links", '</ul></nav>'), (0, '<div class="menu"><ul>', "links", '</ul></div>'),
             (0, '<ul id="navbar">', "links", '</ul>'), (0, '<div role="navigation">', "links", '</div>'),
             (0, '<div class="breadcrumbs">', "link", '</div>'), (0, '<div class="top-nav topbar">', "links", '</div>')],
    "header": [(0, '<header><h1>', "title", '</h1></header>'), (0, '<div id="header"><h1>', "title", '</h1></div>'),
               (0, '<header class="site-header"><div>', "title", '</div></header>'),
               (0, '<div class="masthead"><p>', "sentence", '</p></div>'), (0, '<div class="banner"><h2>', "title", '</h2></div>')],
    "footer": [(0, '<footer>', "rights", '</footer>'), (0, '<footer><p>', "sentence", '</p></footer>'),
               (0, '<div id="footer"><p>', "rights", '</p></div>'), (0, '<div class="site-footer">', "links", '</div>'),
               (0, '<div role="contentinfo">', "rights", '</div>'), (0, '<footer><div><p>', "paragraph", '</p></div></footer>'),
               (0, '<div class="copyright legal">', "rights", '</div>')],
    "side": [(0, '<aside><p>', "paragraph", '</p></aside>'), (0, '<aside><h3>', "title", '</h3></aside>'),
             (0, '<aside class="sidebar"><ul>', "links", '</ul></aside>'), (0, '<div class="sidebar"><p>', "sentence", '</p></div>'),
             (0, '<div id="side-bar" class="widget"><h4>', "title", '</h4></div>'), (0, '<div role="complementary">', "paragraph", '</div>'),
             (0, '<div class="related"><h3>', "title", '</h3></div>'), (0, '<div class="recommended-posts more"><a href="/x">', "title", '</a></div>'),
             (0, '<section class="widget-area"><p>', "paragraph", '</p></section>'), (0, '<div class="tags">', "links", '</div>')],
    "advert": [(0, '<div class="ad">', "sentence", '</div>'), (0, '<div class="ads banner"><p>', "paragraph", '</p></div>'),
               (0, '<div id="advert">', "sentence", '</div>'), (0, '<div class="sponsored promo"><p>', "sentence", '</p></div>'),
               (0, '<aside class="advertisement"><p>', "paragraph", '</p></aside>'), (0, '<ins class="adsbygoogle"><p>', "sentence", '</p></ins>'),
               (0, '<div class="ad-slot ad-container">', "paragraph", '</div>'), (0, '<div class="sponsor">', "paragraph", '</div>')],
    "notice": [(0, '<div class="cookie-notice"><p>', "sentence", '</p></div>'), (0, '<div id="consent" class="cookies"><p>', "paragraph", '</p></div>'),
               (0, '<div class="alert" role="alert">', "sentence", '</div>'), (0, '<div class="notice">', "paragraph", '</div>'),
               (0, '<div class="popup modal overlay"><p>', "sentence", '</p></div>'), (0, '<div role="dialog"><p>', "paragraph", '</p></div>'),
               (0, '<div class="gdpr privacy-banner">', "paragraph", '</div>'), (0, '<div class="disclaimer">', "sentence", '</div>')],
    "form": [(0, '<form><label>', "title", '</label><input name="q"></form>'), (0, '<form class="newsletter subscribe"><p>', "sentence", '</p></form>'),
             (0, '<div class="search"><form>', "title", '</form></div>'), (0, '<form id="login"><p>', "paragraph", '</p></form>'),
             (0, '<div class="newsletter signup"><p>', "sentence", '</p></div>'), (0, '<form><fieldset><div>', "sentence", '</div></fieldset></form>')],
    "share": [(0, '<div class="share social"><ul>', "links", '</ul></div>'), (0, '<div class="byline meta">', "title", '</div>'),
              (0, '<div class="pagination">', "links", '</div>'), (0, '<div class="post-meta author">', "title", '</div>')],
    "comments": [(0, '<div class="comment"><p>', "paragraph", '</p></div>'), (0, '<section class="comments"><h3>', "title", '</h3></section>'),
                 (0, '<section id="comments"><p>', "paragraph", '</p></section>'), (0, '<ol class="commentlist"><li class="comment">', "sentence", '</li></ol>'),
                 (0, '<div id="disqus_thread" class="replies"><p>', "paragraph", '</p></div>'), (0, '<div class="comments"><article class="comment"><p>', "paragraph", '</p></article></div>'),
                 (0, '<ul class="reader-comments responses"><li>', "paragraph", '</li></ul>'), (0, '<div class="discussion reply"><p>', "sentence", '</p></div>')],
    "body": [(1, '<p>', "paragraph", '</p>'), (1, '<p>', "paragraph", ''), (1, '<p>', "sentence", '</p>'), (1, '<p><b>', "paragraph", '<br>'),
             (1, '<p>', "paragraph", '</p>'), (1, '<p>', "paragraph", '</p>'), (1, '<p>', "linked", '</p>'), (1, '<p>', "sentence", '</p>'),
             (1, '<h2>', "title", '</h2>'), (1, '<h3>', "title", '</h3>'), (1, '<ul><li>', "sentence", '</li></ul>'), (1, '<p>', "title", '</p>'),
             (1, '<blockquote><p>', "paragraph", '</p></blockquote>'), (1, '<pre>', "sentence", '</pre>'), (1, '<div>', "paragraph", '</div>'),
             (1, '<table><tr><td>', "title", '</td></tr></table>'), (1, '<figure><figcaption>', "sentence", '</figcaption></figure>'),
             (1, '<ol><li>', "paragraph", '</li></ol>'), (1, '<section><p>', "paragraph", '</p></section>')],
}
_SHELLS = [('<article>', '</article>', 6), ('<main>', '</main>', 2), ('<main><article>', '</article></main>', 3),
           ('<div class="content">', '</div>', 2), ('<div id="content"><div class="post">', '</div></div>', 2),
           ('<div id="main" role="main">', '</div>', 2), ('<div class="entry-content">', '</div>', 2),
           ('<div class="article-body story">', '</div>', 2), ('<section class="post-content text">', '</section>', 1),
           ('<div class="wrapper container"><div class="row">', '</div></div>', 1), ('<div>', '</div>', 2), ('', '', 1),
           ('<article itemprop="articleBody">', '</article>', 1), ('<table><tr><td class="body">', '</td></tr></table>', 1)]


def _text(rng: random.Random, kind: str) -> str:
    """Invented text: the field must not learn any word of a language."""
    def word():
        return "".join(rng.choice("aeiou") + rng.choice("bcdfglmnprstv") for _ in range(rng.randint(1, 4)))

    def words(low, high):
        return [word() for _ in range(rng.randint(low, high))]

    def sentence(low=4, high=18):
        found = words(low, high)
        if len(found) > 8 and rng.random() < 0.5:
            found[len(found) // 2] += ","
        odd = rng.random()
        if odd < 0.06:
            return rng.choice((" | ", " - ", "!! ", "%%% ", " / ")).join(found)
        if odd < 0.12:
            return " ".join(rng.choice((found, found[:1] * 12, [w.upper() for w in found],
                                        [str(rng.randint(0, 9999)) for _ in found])))
        return " ".join(found).capitalize() + rng.choice("...!?")

    def link():
        return f'<a href="/{word()}">{" ".join(words(1, 3))}</a>'

    if kind == "links":
        return "".join(f"<li>{link()}</li>" if rng.random() < 0.7 else link() + " " for _ in range(rng.randint(2, 8)))
    if kind == "link":
        return link()
    if kind == "title":
        return " ".join(words(1, 10)).capitalize() + rng.choice(["", "", "."])
    if kind == "rights":
        return f"&copy; {rng.choice(['2024 ', '', '2019 '])}{word()}.example &middot; {sentence(1, 6)}"
    if kind == "sentence":
        return sentence(1, 14)
    if kind == "linked":
        return f"{sentence()} {link()} {sentence()} {sentence()}"
    return " ".join(sentence() for _ in range(rng.randint(1, 9)))


def labelled_pages(n: int = 400, seed: int = 1) -> list[tuple[list[Block], list[int]]]:
    """``n`` pages in changing layouts, each as its blocks and their labels."""
    rng, pages = random.Random(seed), []
    for _ in range(n):
        pieces = []

        def put(name, pieces=pieces):
            label, opening, kind, closing = rng.choice(_PARTS[name])
            # A mark no text holds tells the label of the block it ends up in.
            mark = "\x01" if label else "\x02"
            filled = _text(rng, kind)
            filled = re.sub(r">([^<]+)<", lambda m: f">{mark}{m[1]}<", filled) if kind in ("links", "link") else mark + filled
            pieces.append(opening + filled + closing)

        def some(names, chance):
            for name in names:
                if rng.random() < chance:
                    put(name)

        shell = rng.choices(_SHELLS, [s[2] for s in _SHELLS])[0]
        some(["notice"], 0.3)
        some(["header"], 0.5)
        some(["menu"], 0.8)
        some(["form", "advert"], 0.35)
        before = rng.random() < 0.3
        if before:
            some(["side"], 0.8)
        pieces.append(shell[0])
        if rng.random() < 0.7:
            pieces.append(f"<h1>\x01{_text(rng, 'title')}</h1>")
        some(["share"], 0.3)
        for _ in range(rng.choice([1, 1, 2, 3, 5, 8, 12, 20])):
            put("body")
            some(["advert"], 0.08)
            some(["share", "notice", "form", "side"], 0.02)
        some(["share", "comments"], 0.2)
        pieces.append(shell[1])
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            put("comments")
        some(["side"] if not before else [], 0.5)
        some(["side", "advert", "form"], 0.25)
        some(["footer"], 0.85)
        page = "<html><body>" + "".join(pieces) + ("</body></html>" if rng.random() < 0.8 else "")
        blocks = leaf_blocks(page)
        labels = [int(b.text.count("\x01") > 0) for b in blocks]
        for b in blocks:
            b.text = _SPACE.sub(" ", re.sub("[\x01\x02]", "", b.text)).strip() or "-"
        pages.append((blocks, labels))
    return pages


def extract(pages: DataFrame, field: Field, *, id_col: str = "page_id", url_col: str = "url",
            html_col: str = "html") -> DataFrame:
    """Text of the content blocks of every page, blocks parted by an empty line."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"),
                        F.col(html_col).cast("string").alias("html"))

    def run(batches):
        for batch in batches:
            texts, kept, total = [], [], []
            for page in batch.column(2):
                blocks = leaf_blocks(page.as_py() or "")
                labels = field.decode(blocks)
                texts.append("\n\n".join(b.text for b, y in zip(blocks, labels, strict=True) if y))
                kept.append(int(labels.sum()))
                total.append(len(blocks))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64()), pa.array(kept, pa.int32()), pa.array(total, pa.int32())],
                ["page_id", "url", "text", "n_chars", "n_blocks_kept", "n_blocks"])

    return rows.mapInArrow(run, T.StructType([
        *rows.schema[:2], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType()),
        T.StructField("n_blocks_kept", T.IntegerType()), T.StructField("n_blocks", T.IntegerType())]))
