"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the page.

A leaf block is the text between two borders of block elements.  Its features are the tags and class words of its
ancestors and simple facts of its text.  The model is trained on labelled pages: a bounded sample of the table,
labelled by their own <article>, and the same texts set into page layouts in which every part's label is known.
Viterbi's algorithm then labels the blocks of each page together.
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

from tidemark.llm.base import per_batch, texts_of

#: Comments, tags (quotes count only behind an equals sign; nothing is tried twice), declarations.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+)>|<[!?][^>]*>", re.S)
OPENS = re.compile(r"</?[a-zA-Z]|<!")
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
WORD = re.compile(r"[a-z]+")
#: Elements of HTML by what they do to a page's text (fixed values).
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Raw elements, each with the pattern of its end tag (ASCII letters of any case, in the page itself).
RAW = {t: re.compile(rf"</{t}(?![^\s/>])", re.I | re.A) for t in "script style title textarea noscript iframe".split()}
#: Elements of ordinary markup that hold no text of the page, up to their own end tag.
CONTROLS = set("template svg select button object canvas".split())
#: HTML elements that end an svg they begin in.
LEAVE_SVG = set("""b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span
                strong strike sub sup table tt u ul var article aside footer header main nav section form""".split())
INLINE = set("a abbr b bdi bdo big cite code del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
NEST = {"ul", "ol", "dl", "table", "body"}


def self_closed(attributes: str) -> bool:
    """Whether a tag ends in '/>', with the '/' outside an unquoted value."""
    return attributes.endswith("/") and "=" not in attributes.replace('"', " ").replace("'", " ").split()[-1]


@dataclass
class Block:
    text: str
    tags: tuple[str, ...]
    names: tuple[str, ...]  # class, id and role words of the ancestors, nearest last
    linked: int  # characters inside links


def blocks(page: str) -> list[Block]:
    """Leaf blocks in page order; scripts, styles, comments, controls and the head's texts are none.

    A control that its own end tag doesn't close says its text like any other element.
    """
    out: list[Block] = []
    # Open elements: tag, name words, and for controls what was said before them.
    stack: list[tuple[str, tuple[str, ...], tuple[int, list[str], int, int] | None]] = []
    parts: list[str] = []
    linked = at = 0
    controls = False  # whether the page has had any

    def flush() -> None:
        nonlocal parts, linked
        text = " ".join("".join(parts).split())
        if text:
            held = [x for x in stack if x[0] not in INLINE and x[0] not in CONTROLS]
            out.append(Block(text, tuple(t for t, *_ in held), tuple(n for _, names, _ in held for n in names), linked))
        parts, linked = [], 0

    def say(raw: str) -> None:
        nonlocal linked
        if raw:
            text = entities.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if any(t == "a" for t, *_ in stack):
                linked += len(text.strip())

    def last(tags: set[str]) -> int:
        return next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] in tags), -1) if controls else -1

    look = 0
    while (start := page.find("<", max(at, look))) >= 0:
        if not (m := TOKEN.match(page, start)):
            if not OPENS.match(page, start):
                look = start + 1  # a plain sign
                continue
            say(page[at:start])
            at = len(page)  # the page ends inside a tag, which says nothing
            break
        say(page[at:start])
        at = m.end()
        if m[2] is None:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if closing:
            if tag in CONTROLS:
                if (depth := last({tag})) >= 0:
                    n_out, parts, n_parts, linked = stack[depth][2]  # a flush leaves the list as it was
                    del out[n_out:], parts[n_parts:], stack[depth:]
                parts.append(" ")
                continue
            if tag not in INLINE:
                flush()
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if depth is not None and (tag not in INLINE or all(t in INLINE for t, *_ in stack[depth:])):
                del stack[depth:]
            continue
        if (svg := last({"svg"})) >= 0 and svg > last({"foreignobject", "desc"}):
            if tag in LEAVE_SVG:
                del stack[svg:]
            elif self_closed(m[3]):
                continue
        if tag in RAW:
            # Their content is no markup: go on behind the end tag, or at the end of the page.
            end = RAW[tag].search(page, at)
            at = len(page) if end is None else end.start()
            if end and (close := page.find(">", at)) >= 0:
                at = close + 1
            parts.append(" ")
            continue
        if tag in CONTROLS:
            if tag in ("button", "select") and (open_one := last({tag})) >= 0:
                del stack[open_one:]  # they hold none of their kind
            parts.append(" ")
            if tag != "svg" or not self_closed(m[3]):
                stack.append((tag, (), (len(out), parts, len(parts), linked)))
                controls = True
            continue
        if tag in VOID:
            if tag != "wbr":
                parts.append(" ")
            continue
        if tag not in INLINE:
            flush()
            floor = last(CONTROLS) + 1  # a block in a control ends nothing around it
            if (open_p := next((i for i in range(floor, len(stack)) if stack[i][0] == "p"), -1)) >= 0:  # an open paragraph ends where a block begins
                del stack[open_p:]
            if tag in CLOSES:
                for i in range(len(stack) - 1, floor - 1, -1):
                    if stack[i][0] in CLOSES[tag]:
                        del stack[i:]
                        break
                    if stack[i][0] in NEST:
                        break
        if m[3].rstrip().endswith("/") and tag not in INLINE and "=" not in m[3]:
            continue
        names = tuple(w for a in NAMES.findall(m[3]) for w in WORD.findall("".join(a).lower())) if m[3] else ()
        stack.append((tag, names, None))
    say(page[at:])
    flush()
    return out


# ---- features ----


def features(found: list[Block]) -> list[list[str]]:
    out = []
    for i, b in enumerate(found):
        words = b.text.split()
        n = len(words)
        ends = sum(w[-1] in ".!?;:" for w in words)
        out.append([
            "bias", *{f"in:{t}" for t in b.tags}, *{f"name:{w}" for w in b.names}, *(f"own:{t}" for t in b.tags[-1:]), *(f"under:{t}" for t in b.tags[-2:-1]),
            f"words:{min(8, n.bit_length())}", f"links:{min(4, 5 * b.linked // max(1, len(b.text)))}", f"ends:{min(3, ends)}",
            f"stop:{b.text[-1] in '.!?'}", f"mean:{min(12, len(b.text) // n)}", f"depth:{min(8, len(b.tags))}",
            f"digits:{4 * sum(c.isdigit() for c in b.text) // len(b.text)}", f"sign:{b.text[0] if not b.text[0].isalnum() else 'none'}",
            *(["first"] if i == 0 else []), *(["last"] if i == len(found) - 1 else [])])
    return out


# ---- model ----


@dataclass
class Chain:
    """Weights of two labels (0: other, 1: main text): by feature, from label to label, and at the ends of a page."""

    index: dict[str, int]
    state: np.ndarray  # features x 2
    move: np.ndarray  # 2 x 2
    start: np.ndarray
    end: np.ndarray

    def scores(self, page: list[list[str]]) -> np.ndarray:
        get = self.index.get
        return np.array([self.state[[j for f in block if (j := get(f)) is not None]].sum(axis=0) for block in page]).reshape(-1, 2)

    def decode(self, page: list[list[str]]) -> list[int]:
        """The most likely labels of all blocks together (Viterbi)."""
        if not page:
            return []
        s = self.scores(page)
        best, back = self.start + s[0], []
        for row in s[1:]:
            ways = best[:, None] + self.move
            back.append(ways.argmax(axis=0))
            best = ways.max(axis=0) + row
        label = int((best + self.end).argmax())
        out = [label]
        for step in reversed(back):
            out.append(label := int(step[label]))
        return out[::-1]


def train(pages: list[tuple[list[list[str]], list[int]]], rounds: int = 150, rate: float = 0.2, decay: float = 1e-3) -> Chain:
    """Maximum likelihood by gradient steps (Adam); forward and backward sums run over all pages at once."""
    pages = [p for p in pages if p[1]]
    index: dict[str, int] = {}
    for blocks_, _ in pages:
        for b in blocks_:
            for f in b:
                index.setdefault(f, len(index))
    n, longest, k = len(pages), max([1, *(len(y) for _, y in pages)]), len(index)
    lengths = np.array([len(y) for _, y in pages], int)
    # One row per (block, feature), to sum by block and by feature.
    block_of = np.array([i * longest + j for i, (x, _) in enumerate(pages) for j, b in enumerate(x) for _ in b], int)
    feature = np.array([index[f] for x, _ in pages for b in x for f in b], int)
    inside = np.arange(longest)[None, :] < lengths[:, None]
    gold = np.zeros((n, longest, 2))
    for i, (_, y) in enumerate(pages):
        gold[i, np.arange(len(y)), y] = 1
    rows = np.arange(n)
    moves = np.einsum("nla,nlb->ab", gold[:, :-1], gold[:, 1:])
    theta = np.zeros(2 * k + 8)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    lse = np.logaddexp.reduce
    for step in range(1, rounds + 1 if n else 1):
        state, move, start, end = theta[: 2 * k].reshape(k, 2), theta[2 * k : 2 * k + 4].reshape(2, 2), theta[-4:-2], theta[-2:]
        s = np.stack([np.bincount(block_of, state[feature, c], n * longest) for c in (0, 1)], axis=1).reshape(n, longest, 2)
        a, b = np.zeros_like(s), np.zeros_like(s)
        a[:, 0] = start + s[:, 0]
        for t in range(1, longest):
            a[:, t] = np.where(inside[:, t, None], s[:, t] + lse(a[:, t - 1, :, None] + move, axis=1), a[:, t - 1])
        z = lse(a[:, -1] + end, axis=1)
        b[:, -1] = end
        for t in range(longest - 2, -1, -1):
            b[:, t] = np.where(inside[:, t + 1, None], lse(move + (s[:, t + 1] + b[:, t + 1])[:, None, :], axis=2), end)
        p = np.exp(a + b - z[:, None, None]) * inside[:, :, None]
        pairs = np.exp(a[:, :-1, :, None] + move + (s + b)[:, 1:, None, :] - z[:, None, None, None]) * inside[:, 1:, None, None]
        more = (gold - p).reshape(-1, 2)
        g = np.concatenate([
            np.stack([np.bincount(feature, more[block_of, c], k) for c in (0, 1)], axis=1).ravel(), (moves - pairs.sum(axis=(0, 1))).ravel(),
            (gold[:, 0] - p[:, 0]).sum(axis=0), (gold[rows, lengths - 1] - p[rows, lengths - 1]).sum(axis=0)]) / n - decay * theta
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Chain(index, theta[: 2 * k].reshape(k, 2), theta[2 * k : 2 * k + 4].reshape(2, 2), theta[-4:-2], theta[-2:])


# ---- labelled pages ----

#: Ways to wrap the main text, and the other parts of a page: opening and closing markup around their blocks.
MAIN = ("<article>|</article>", "<main>|</main>", "<main><article class='post'>|</article></main>", "<div class='content'>|</div>", "<div id='main'><div class='entry'>|</div></div>",
        "<div class='article-body'>|</div>", "<section class='story'>|</section>", "<div>|</div>", "<table><tr><td>|</td></tr></table>", "<div class='post-text'>|</div>", "|", "|")
LINKS = ("<nav>|</nav>", "<div class='menu'>|</div>", "<ul class='navigation'>|</ul>", "<aside>|</aside>", "<div id='sidebar'>|</div>", "<div class='related'>|</div>",
         "<div class='breadcrumb'>|</div>", "<div role='navigation'>|</div>", "<div class='links tags'>|</div>", "<div class='share social'>|</div>")
NOTES = ("<header>|</header>", "<div class='header'>|</div>", "<div class='ad'>|</div>", "<div class='advert banner'>|</div>", "<div class='cookie notice'>|</div>",
         "<div role='alert'>|</div>", "<form>|</form>", "<div class='newsletter form'>|</div>", "<div class='promo sponsored'>|</div>", "<aside class='sidebar'>|</aside>",
         "<div class='popup consent'>|</div>", "<div class='login subscribe'>|</div>")
TALK = ("<section class='comments'>|</section>", "<div id='comments'>|</div>", "<div class='comment-list replies'>|</div>", "<ol class='commentlist'>|</ol>", "<div class='discussion'>|</div>")
FOOT = ("<footer>|</footer>", "<div class='footer'>|</div>", "<div id='bottom' class='copyright'>|</div>")


def layout(texts: list[str], seed: int) -> tuple[str, list[int]]:
    """A page made of given texts, and the label of each of its blocks."""
    r = random.Random(seed)
    page, labels = [], []
    safe = lambda t: t.replace("&", "&amp;").replace("<", "&lt;")
    some = lambda low, high: [safe(r.choice(texts)) for _ in range(r.randint(low, high))]
    short = lambda: safe(" ".join(r.choice(texts).split()[: r.randint(1, 4)]))

    def part(wraps: tuple[str, ...], body: list[str], label: int) -> str:
        left, right = r.choice(wraps).split("|")
        labels.extend([label] * len(body))
        return left + "".join(body) + right

    def links() -> str:
        wrap = r.choice(("<li><a href='/x'>{}</a></li>", "<div><a href='/x'>{}</a></div>", "<p><a href='/x'>{}</a></p>"))
        return part(LINKS, [wrap.format(short()) for _ in range(r.randint(2, 8))], 0)

    def notes() -> str:
        return part(NOTES, [r.choice(("<p>{}</p>", "<div>{}</div>")).format(t) for t in some(1, 2)], 0)

    def talk() -> str:
        return part(TALK, [r.choice(("<p>{}</p>", "<div class='comment'>{}</div>", "<li>{}</li>")).format(t) for t in some(1, 4)], 0)

    for _ in range(r.randint(0, 3)):
        page.append(r.choice((links, notes))())
    left, right = r.choice(MAIN).split("|")
    page.append(left)
    if r.random() < 0.7:
        page.append(f"<h1>{safe(r.choice(texts))[:60].replace('&', ' ')}x</h1>")
        labels.append(1)
    for t in some(2, 12):
        page.append(r.choice(("<p>{}</p>", "<p>{}</p>", "<p>{}</p>", "<p>{}", "<h2>{}</h2>", "<li>{}</li>", "<blockquote>{}</blockquote>", "<p><b>{}</b></p>", "<pre>{}</pre>")).format(t))
        labels.append(1)
        if r.random() < 0.06:
            page.append(r.choice((notes, links))())
    if r.random() < 0.25:
        page.append(talk())
    page.append(right)
    if r.random() < 0.4:
        page.append(talk())
    for _ in range(r.randint(0, 2)):
        page.append(r.choice((links, notes))())
    page.append(part(FOOT, [r.choice(("<p>&copy; {}</p>", "<div>{}</div>", "<p><a href='/'>{}</a></p>")).format(short()) for _ in range(r.randint(1, 3))], 0))
    return "<html><body>" + "".join(page) + "</body></html>", labels


#: Ancestors whose blocks are no main text even inside an <article>.
ASIDE = {"nav", "aside", "footer", "header", "form", "comment", "comments", "ad", "menu", "sidebar", "notice"}


def labelled(pages: list[str], layouts: int = 300) -> list[tuple[list[list[str]], list[int]]]:
    """Training pages: those with an <article>, by that, and layouts of their texts."""
    out, texts = [], []
    for page in pages:
        found = blocks(page)
        texts += [b.text for b in found if len(b.text) > 1]
        if any("article" in b.tags for b in found):
            out.append((features(found), [int("article" in b.tags and not ASIDE & {*b.tags, *b.names}) for b in found]))
    for seed in range(layouts if texts else 0):
        page, labels = layout(texts, seed)
        found = blocks(page)
        if len(found) == len(labels):
            out.append((features(found), labels))
    return out


# ---- operator ----


def fit(pages: DataFrame, html: str = "html", sample: int = 300, longest: int = 50_000) -> Chain:
    """Train on at most `sample` different pages of at most `longest` characters, the first by hash; both bounds are parameters.

    The hashes are read first, so no more pages than that leave the tasks, however many partitions there are.  Without any
    page the model has no features and calls nothing main text.
    """
    rows = pages.where(F.length(html).between(1, longest)).select(F.col(html).cast("string").alias("html"), F.xxhash64(F.col(html).cast("string")).alias("h"))
    last = rows.select("h").distinct().orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    chosen = rows.where(F.col("h") <= F.lit(last)).groupBy("h").agg(F.min("html").alias("html")).orderBy("h").collect() if last is not None else []
    return train(labelled([r["html"] for r in chosen], sample))


def main_text(page: str, model: Chain) -> str:
    found = blocks(page)
    return " ".join(b.text for b, label in zip(found, model.decode(features(found)), strict=True) if label)


def extract(pages: DataFrame, model: Chain, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page, from its whole html.

    Character references are decoded, white space inside a block becomes one blank, blocks are joined by one blank.
    A null or empty page, or one without main text, has an empty text.  One row per input row, repeated rows too.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)  # a few thousand weights
    held = pages.select(F.col(key), F.col(url), F.col(html).cast("string").alias("_html"))
    schema = T.StructType([held.schema[key], held.schema[url], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(p, shared.value) if p else "" for p in texts_of(batch.column(2))]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=schema.fieldNames())

    return per_batch(held, run, schema)
