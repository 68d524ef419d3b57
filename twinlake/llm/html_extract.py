"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks."""

from __future__ import annotations

import functools
import html
import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlake.session import bound_batches

#: Fixed values of the HTML standard: elements without content, elements whose content is not markup,
#: elements that do not break a line of text, and elements that an opening tag of the same group ends.
VOID = "area base br col embed hr img input link meta source track wbr".split()
RAW = "script style textarea title iframe noscript template svg math xmp noembed noframes".split()
INLINE = "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
ENDS = [["p"], ["li"], ["dt", "dd"], ["tr"], ["td", "th"], ["option"]]
#: Fixed values of the HTML standard: block elements that end an open paragraph.
END_P = "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()

_VOID, _RAW, _INLINE, _END_P = set(VOID), set(RAW), set(INLINE), set(END_P)
_ENDS = {tag: set(group) for group in ENDS for tag in group}
_SCOPE = {"table", "ul", "ol", "dl", "div", "article", "section", "main", "body", "nav", "aside", "footer", "header", "form", "select", "blockquote"}
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(?:!|\?)[^>]*>|<(/?)([A-Za-z][^\s/<>]*+)((?:"[^"]*+"|'[^']*+'|[^<>"']++)*+)>|[^<]+|<""", re.S)
_RAW_END = {tag: re.compile(rf"</{tag}\b[^>]*>", re.I) for tag in RAW}
#: Of these an element may stand within another of its name.
_NESTED = {tag: re.compile(rf"<(/?){tag}\b((?:\"[^\"]*\"|'[^']*'|[^<>\"'])*)>", re.I) for tag in ("svg", "math", "template")}
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
BUCKETS = 1 << 12


def _raw_end(name: str, page: str, at: int) -> int:
    """Where what follows an opening tag without markup ends; the page's end if it is not closed."""
    if name not in _NESTED:
        end = _RAW_END[name].search(page, at)
        return end.end() if end else len(page)
    depth = 1
    for tag in _NESTED[name].finditer(page, at):
        if tag[1]:
            depth -= 1
        elif not tag[2].rstrip().endswith("/"):
            depth += 1
        if not depth:
            return tag.end()
    return len(page)


@dataclass
class Leaf:
    """A run of text between block boundaries, the features of the elements it stands in, and the share of it in
    links."""

    text: str
    context: list[int]
    linked: float


def _bucket(feature: str) -> int:
    return zlib.crc32(feature.encode()) % BUCKETS


@functools.lru_cache(1 << 16)
def _element(tag: str, names: tuple[str, ...]) -> tuple[int, ...]:
    return tuple({_bucket(f"in:{tag}"), *(_bucket(f"name:{w}") for w in names)})


@functools.lru_cache(1 << 12)
def _place(two: tuple[str, ...]) -> list[int]:
    return [_bucket(f"tag:{two[-1] if two else ''}"), _bucket(f"two:{'>'.join(two)}"), _bucket("bias")]


def leaf_blocks(page: str) -> list[Leaf]:
    """The DOM leaf blocks of a page in order. Broken markup is read leniently: unknown end tags are
    passed over, an end tag closes what is open inside it, the page's end closes everything."""
    stack: list[tuple[str, tuple[int, ...]]] = []
    blocks: list[str] = []
    out: list[Leaf] = []
    parts: list[str] = []
    links = 0
    opened: dict[str, int] = {}
    #: how many open elements have a feature; at most ``BUCKETS`` entries, however deep the page
    held: dict[int, int] = {}
    context: list[int] | None = None

    def close(k: int) -> None:
        nonlocal context
        for tag, own in stack[k:]:
            opened[tag] -= 1
            for x in own:
                held[x] -= 1
                if not held[x]:
                    del held[x]
            if tag not in _INLINE:
                blocks.pop()
        del stack[k:]
        context = None

    def flush() -> None:
        nonlocal links, context
        text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
        if text:
            if context is None:
                context = [*held, *_place(tuple(blocks[-2:]))]
            out.append(Leaf(text, context, min(1.0, links / len(text))))
        parts.clear()
        links = 0

    at, n = 0, len(page)
    while at < n:
        token = _TOKEN.match(page, at)
        at = token.end()
        name = token[2]
        if name is None:
            if not token[0].startswith(("<!", "<?")):
                parts.append(token[0])
                if opened.get("a"):
                    links += len(token[0].strip())
            continue
        name = name.lower()
        if token[1]:
            if name not in _INLINE:
                flush()
            for k in range(len(stack) - 1, -1, -1) if opened.get(name) else ():
                if stack[k][0] == name:
                    close(k)
                    break
                if name in _INLINE and stack[k][0] not in _INLINE:
                    break
            continue
        if name in ("svg", "math") and token[3].rstrip().endswith("/"):
            continue
        if name in _RAW:
            at = _raw_end(name, page, at)
            if name not in ("svg", "math", "template"):
                flush()
            continue
        if name not in _INLINE:
            flush()
            ends = _ENDS.get(name)
            for k in range(len(stack) - 1, -1, -1):
                tag = stack[k][0]
                if ends and tag in ends or tag == "p" and name in _END_P:
                    close(k)
                    break
                if tag in _SCOPE:
                    break
        elif name == "br":
            parts.append(" ")
        if name not in _VOID and not token[3].rstrip().endswith("/"):
            names = tuple(w for m in _NAMES.finditer(token[3]) for w in _WORD.findall((m[1] or m[2] or m[3] or "").lower())) if token[3] else ()
            own = _element(name, names)
            stack.append((name, own))
            opened[name] = opened.get(name, 0) + 1
            for x in own:
                held[x] = held.get(x, 0) + 1
            if name not in _INLINE:
                blocks.append(name)
            context = None
    flush()
    return out


def features(leaf: Leaf) -> list[int]:
    """Hashed features of a block: its ancestors' tags and names, and what its text looks like."""
    text, n = leaf.text, len(leaf.text)
    return leaf.context + [
        _bucket(f"length:{min(8, n.bit_length())}"), _bucket(f"linked:{int(leaf.linked * 4)}"), _bucket(f"ends:{text[-1] in '.!?:;'}"),
        _bucket(f"commas:{min(3, text.count(','))}"), _bucket(f"sign:{text[0] in '©&|#'}"),
    ]


@dataclass
class Crf:
    """Weights of block features for the labels (0: not main text, 1: main text) and of label pairs."""

    emit: np.ndarray
    move: np.ndarray
    begin: np.ndarray

    def viterbi(self, rows: list[list[int]]) -> list[int]:
        """The most likely labels of a page's blocks."""
        emit, move = self.emit, self.move.tolist()
        scores = [emit[r].sum(axis=0).tolist() for r in rows]
        a, b = self.begin[0] + scores[0][0], self.begin[1] + scores[0][1]
        back = []
        for x, y in scores[1:]:
            aa, ba, ab, bb = a + move[0][0], b + move[1][0], a + move[0][1], b + move[1][1]
            back.append((int(ba > aa), int(bb > ab)))
            a, b = max(aa, ba) + x, max(ab, bb) + y
        out = [int(b > a)]
        for step in reversed(back):
            out.append(step[out[-1]])
        return out[::-1]


def train(pages: list[tuple[list[list[int]], list[int]]], steps: int = 120, rate: float = 0.15, ridge: float = 1e-3) -> Crf:
    """Maximum likelihood by Adam; the gradient is that of forward-backward over all pages at once."""
    width, n = max(len(r) for r, _ in pages), len(pages)
    mask, gold = np.zeros((n, width), bool), np.zeros((n, width), int)
    items, owner = [], []
    for k, (rows, labels) in enumerate(pages):
        mask[k, : len(rows)] = True
        gold[k, : len(rows)] = labels
        for t, row in enumerate(rows):
            items += row
            owner += [k * width + t] * len(row)
    items, owner = np.array(items), np.array(owner)
    p = [np.zeros((BUCKETS, 2)), np.zeros((2, 2)), np.zeros(2)]
    m, v = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p]
    true = np.eye(2)[gold] * mask[..., None]
    pairs = (gold[:, :-1] * 2 + gold[:, 1:])[mask[:, 1:]]
    true_moves = np.bincount(pairs, minlength=4).reshape(2, 2)

    def total(x: np.ndarray, axis: int) -> np.ndarray:
        top = x.max(axis=axis, keepdims=True)
        return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)

    for step in range(1, steps + 1):
        emit = np.zeros((n * width, 2))
        for y in range(2):
            emit[:, y] = np.bincount(owner, p[0][items, y], n * width)
        emit = emit.reshape(n, width, 2)
        alpha, beta = np.zeros((n, width, 2)), np.zeros((n, width, 2))
        alpha[:, 0] = emit[:, 0] + p[2]
        for t in range(1, width):
            new = total(alpha[:, t - 1, :, None] + p[1], 1) + emit[:, t]
            alpha[:, t] = np.where(mask[:, t, None], new, alpha[:, t - 1])
        z = total(alpha[:, -1], 1)
        for t in range(width - 2, -1, -1):
            new = total(p[1] + (emit[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
            beta[:, t] = np.where(mask[:, t + 1, None], new, beta[:, t + 1])
        post = np.exp(alpha + beta - z[:, None, None]) * mask[..., None]
        joint = alpha[:, :-1, :, None] + p[1] + (emit[:, 1:] + beta[:, 1:])[:, :, None, :]
        joint = (np.exp(joint - z[:, None, None, None]) * mask[:, 1:, None, None]).sum(axis=(0, 1))
        off = (post - true).reshape(-1, 2)
        g = [np.stack([np.bincount(items, off[owner, y], BUCKETS) for y in range(2)], axis=1) / n, (joint - true_moves) / n, (post[:, 0] - true[:, 0]).sum(axis=0) / n]
        for k in range(3):
            d = g[k] + ridge * p[k]
            m[k] = 0.9 * m[k] + 0.1 * d
            v[k] = 0.99 * v[k] + 0.01 * d * d
            p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return Crf(*p)


# ---------------------------------------------------------------- labelled pages

#: Elements and names that labelled pages are made with.
MAIN_OPENINGS = ["article", "main", "main id=content", "div class=content", "div class=post", "div id=main-content", "section class=story", "div class=entry-content", "div class=article-body", "div itemprop=articleBody class=text", "article class=post", "div role=main"]
NOISE_OPENINGS = ["div class=ad", "div class=advert", "div class=banner-ad", "div class=promo", "aside", "aside class=sidebar", "div class=sidebar", "div id=sidebar", "div class=cookie-notice", "div class=notice", "div role=alert class=notice", "div class=newsletter", "section class=related", "div class=share", "div class=social", "div class=breadcrumbs", "div class=widget", "div class=popup", "ins class=adsbygoogle", "div class=sponsored", "div id=cookie-banner"]
COMMENT_OPENINGS = ["section class=comments", "div id=comments", "section id=comments", "div class=comment-list", "ol class=commentlist", "div class=reader-comments"]
#: Words that names of adverts and of reader comments are put together from.
AD_WORDS = "ad ads adslot adunit advert advertisement adsense banner dfp gpt slot sponsor sponsored promo promoted promotion outbrain taboola teads".split()
COMMENT_WORDS = "comment comments commentary reply replies respond response responses discussion disqus thread feedback remarks".split()
FILL_WORDS = "box block wrap wrapper container area item list unit inner section".split()
SYLLABLES = "the an in er re th on at en nd or le la de un que ie ung sch ver con do ra".split()


def labelled_page(rng: random.Random) -> list[tuple[str, int]]:
    """Pieces of an invented page's HTML; text pieces are marked 1 for main text, 0 for other text, and -1
    for markup."""

    def words(low: int, high: int) -> str:
        text = [("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4)))) + rng.choice(["", "", "", "", ",", "."]) for _ in range(rng.randint(low, high))]
        return " ".join(text).capitalize() + rng.choice([".", ".", "", "!"])

    out: list[tuple[str, int]] = []
    add = lambda text, label=-1: out.append((text, label))

    def around(opening: str, body) -> None:
        tag, _, rest = opening.partition(" ")
        add(f"<{tag}{' ' + rest if rest else ''}>")
        body()
        if rng.random() < 0.97:
            add(f"</{tag}>")

    def opening(known: list[str], parts: list[str]) -> str:
        """One of the known ones, or an element with a name that is put together."""
        if rng.random() < 0.6:
            return rng.choice(known)
        name = [rng.choice(parts), *rng.sample([*parts, *FILL_WORDS], rng.randint(0, 2))]
        return f"{rng.choice(['div', 'div', 'section', 'aside', 'ul'])} {rng.choice(['class', 'class', 'id'])}={rng.choice('-_').join(name)}"

    def paragraph(label: int, low: int = 1, high: int = 80) -> None:
        tag = rng.choice(["p"] * 8 + ["div", "blockquote", "li", "pre"])
        add(f"<{tag}>")
        if rng.random() < 0.2:
            add(rng.choice(["<b>", "<i>", "<span class=x>", "<strong>"]))
        add(words(low, high), label)
        if rng.random() < 0.25:
            add(f"<a href=/{rng.randint(0, 99)}>")
            add(words(1, 5), label)
            add("</a>")
            add(words(1, 30), label)
        if rng.random() < 0.2:
            add("<br>")
        if rng.random() < 0.85:
            add(f"</{tag}>")

    def links(n: int) -> None:
        add("<ul>")
        for _ in range(n):
            add("<li><a href=/x>")
            add(words(1, 3), 0)
            add("</a></li>")
        add("</ul>")

    def noise() -> None:
        kind = rng.random()
        if kind < 0.3:
            links(rng.randint(1, 6))
        elif kind < 0.8:
            add(words(2, 30), 0)
        else:
            paragraph(0, 2, 40)
            if rng.random() < 0.4:
                add("<h3>")
                add(words(1, 4), 0)
                add("</h3>")

    def form() -> None:
        add("<label>")
        add(words(1, 3), 0)
        add("</label><input><select><option>")
        add(words(1, 2), 0)
        add("</select><button>")
        add(words(1, 2), 0)
        add("</button>")

    def comments() -> None:
        add("<h2>")
        add(words(1, 2), 0)
        add("</h2>")
        for _ in range(rng.randint(1, 5)):
            around(opening(["div class=comment", "li class=comment", "article class=comment"], COMMENT_WORDS), lambda: paragraph(0, 2, 50))

    def article() -> None:
        wrapped = rng.random() < 0.25
        if wrapped:
            add("<header>")
        if rng.random() < 0.9:
            add("<h1>")
            add(words(2, 12), 1)
            add("</h1>")
        if wrapped:
            add("</header>")
        for _ in range(rng.randint(1, 14)):
            r = rng.random()
            if r < 0.8:
                paragraph(1)
            elif r < 0.86:
                add("<h2>")
                add(words(1, 8), 1)
                add("</h2>")
            elif r < 0.9:
                add("<ul>")
                for _ in range(rng.randint(2, 5)):
                    add("<li>")
                    add(words(1, 15), 1)
                add("</ul>")
            elif r < 0.92:
                add("<table><tr><td>")
                add(words(1, 5), 1)
                add("</td><td>")
                add(words(1, 5), 1)
                add("</td></tr></table>")
            else:
                around(opening(NOISE_OPENINGS, AD_WORDS), noise)
        if rng.random() < 0.15:
            around(opening(COMMENT_OPENINGS, COMMENT_WORDS), comments)
        if rng.random() < 0.1:
            around("footer", lambda: add(words(2, 12), 0))

    add("<html><head><title>x</title></head><body>")
    if rng.random() < 0.5:
        around(rng.choice(["header", "div class=header", "div id=header"]), noise)
    if rng.random() < 0.85:
        around(rng.choice(["nav", "nav class=menu", "div class=menu", "div class=navbar", "ul class=nav"]), lambda: links(rng.randint(2, 8)))
    for _ in range(rng.choice([0, 1, 1, 2])):
        around(opening(NOISE_OPENINGS, AD_WORDS), noise)
    around(rng.choice(MAIN_OPENINGS), article)
    for _ in range(rng.choice([0, 0, 1, 2])):
        around(opening(NOISE_OPENINGS, AD_WORDS), noise)
    if rng.random() < 0.3:
        around(opening(COMMENT_OPENINGS, COMMENT_WORDS), comments)
    if rng.random() < 0.3:
        around(rng.choice(["form", "form class=search", "div class=form"]), form)
    if rng.random() < 0.9:
        around(rng.choice(["footer", "footer", "div class=footer", "div id=footer"]), lambda: add("&copy; " + words(2, 15), 0) if rng.random() < 0.7 else links(3))
    if rng.random() < 0.8:
        add("</body></html>")
    return out


def labelled_blocks(pieces: list[tuple[str, int]]) -> tuple[list[list[int]], list[int]]:
    """The blocks' features and labels. Text pieces carry private-use marks through the parser."""
    page = "".join(text if label < 0 else text + chr(0xE000 + label) for text, label in pieces)
    rows, labels = [], []
    for leaf in leaf_blocks(page):
        labels.append(int(chr(0xE001) in leaf.text))
        leaf.text = leaf.text.translate({0xE000: None, 0xE001: None}).strip() or "."
        rows.append(features(leaf))
    return rows, labels


@functools.cache
def default_model(pages: int = 500, seed: int = 7) -> Crf:
    """The field trained on invented labelled pages of many layouts, once a process."""
    rng = random.Random(seed)
    return train([labelled_blocks(labelled_page(rng)) for _ in range(pages)])


def main_blocks(page: str, model: Crf) -> list[str]:
    leaves = leaf_blocks(page)
    if not leaves:
        return []
    return [x.text for x, y in zip(leaves, model.viterbi([features(x) for x in leaves])) if y]


def extract(pages: DataFrame, model: Crf, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars)``, one row per row of ``pages``: the blocks labelled main text,
    joined by line ends in page order. Null and empty pages, and pages without such blocks, have the empty
    text. Null and repeated ids and repeated rows are kept; pages of any length and depth are read whole; other
    columns are not read; an empty table gives an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = ["\n".join(main_blocks(page.as_py() or "", model)) for page in batch.column("html")]
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), sizes], names=["page_id", "url", "text", "n_chars"])

    bound_batches(pages.sparkSession)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
