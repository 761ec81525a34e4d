"""Main-text extraction by a linear-chain conditional random field over the leaf blocks of a page's DOM.

A leaf block is a run of text that no block-level boundary divides. Each has features of its ancestors (tags, roles, class
and id words), of its text (length, links, punctuation) and of its place. A two-state chain, main text or not, is trained
on labelled pages by maximum likelihood (forward-backward, Adam, quadratic penalty) and decoded by Viterbi. The labelled
pages come from a generator of page layouts that knows which blocks are the article; words are invented, and short and
long blocks occur on both sides, so that structure and neighbourhood decide rather than vocabulary.

Scripts, styles, comments, the head and the insides of form controls are no text at all and never become blocks.

Text. Character references are decoded; white space inside a block becomes one blank, the block is trimmed; the main
blocks are joined by a blank line, in page order; nothing else is dropped or cut.

Defined cases. Null or empty html, or no main block: empty text, 0 characters. Null or repeated page_id: rows like any
others. Repeated rows and clashing column names: every row is extracted by itself, and only page_id, url and html are
read. Ties of Viterbi: the state other wins. Very long or deep pages: time and memory grow with their length. Tag soup: open paragraphs, list items and cells end where the next begins; stray end tags are ignored; what is
open at the end of a page ends there. Extra columns are ignored.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from html import escape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("head script style noscript template title svg math iframe object canvas audio video select textarea button datalist".split())
BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr"
    " legend li main menu nav ol p pre section summary table caption tbody td tfoot th thead tr ul".split()
)
#: A start tag of the first kinds ends the open element of the second kinds, up to the nearest of the third.
IMPLIED = (
    (BLOCK, ("p",), ("table", "td", "th", "button", "object")),
    (("li",), ("li",), ("ul", "ol", "menu")),
    (("dt", "dd"), ("dt", "dd"), ("dl",)),
    (("td", "th"), ("td", "th"), ("tr", "table")),
    (("tr",), ("tr",), ("table",)),
    (("thead", "tbody", "tfoot"), ("thead", "tbody", "tfoot"), ("table",)),
)
_WORDS = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")


@dataclass
class Block:
    text: str
    tag: str
    within: frozenset[str]
    marks: frozenset[str]
    linked: int


@dataclass(slots=True)
class _Open:
    """An open element, with what its blocks inherit: block-level tags and marks of all ancestors, itself included.

    ends: for each row of IMPLIED the depth of the element that a start tag of its kinds would end, or -1.
    """

    tag: str
    block: str
    block_depth: int
    within: frozenset[str]
    marks: frozenset[str]
    ends: tuple[int, ...]


_ROOT = _Open("", "", -1, frozenset(), frozenset(), (-1,) * len(IMPLIED))


class BlockParser(HTMLParser):
    """Leaf blocks of one page, in page order; known: the marks to keep, all if None.

    Each tag costs the same whatever the depth: an element shares its parent's sets unless it adds to them, and what an
    end tag or an implied end would close is looked up.
    """

    def __init__(self, known: frozenset[str] | None = None) -> None:
        super().__init__(convert_charrefs=True)
        self.known = known
        self.blocks: list[Block] = []
        self.open: list[_Open] = []
        self.depths: dict[str, list[int]] = {}
        self.buffer: list[str] = []
        self.at = _ROOT
        self.linked = self.links = self.silent = 0

    def parse_html_declaration(self, i: int) -> int:
        if self.rawdata.startswith("<!--", i):
            return self.parse_comment(i)
        end = self.rawdata.find(">", i)
        return len(self.rawdata) if end < 0 else end + 1

    def flush(self) -> None:
        text = " ".join("".join(self.buffer).split())
        if text:
            self.blocks.append(Block(text, self.at.block, self.at.within, self.at.marks, self.linked))
        self.buffer.clear()
        self.linked = 0

    def _pop(self, depth: int) -> None:
        while len(self.open) > depth:
            tag = self.open.pop().tag
            self.depths[tag].pop()
            self.silent -= tag in SILENT
            self.links -= tag == "a"
            if tag in BLOCK:
                self.flush()

    def _push(self, tag: str, marks: set[str]) -> None:
        up, depth = self.open[-1] if self.open else _ROOT, len(self.open)
        ends = tuple(depth if tag in ended else -1 if tag in bounds else e for e, (_, ended, bounds) in zip(up.ends, IMPLIED, strict=True))
        block = tag in BLOCK
        within = up.within if not block or tag in up.within else up.within | {tag}
        self.open.append(_Open(tag, tag if block else up.block, depth if block else up.block_depth, within, up.marks if marks <= up.marks else up.marks | marks, ends))
        self.depths.setdefault(tag, []).append(depth)
        self.silent += tag in SILENT
        self.links += tag == "a"

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "body" and self.silent and self.depths.get("head"):
            self._pop(self.depths["head"][0])
        if tag in BLOCK:
            for k, (starts, _, _) in enumerate(IMPLIED):
                if tag in starts and self.open and self.open[-1].ends[k] >= 0:
                    self._pop(self.open[-1].ends[k])
            self.flush()
        elif tag == "br":
            self.handle_data("\n")
        if tag in VOID:
            return
        marks = set()
        for name, value in attrs:
            if name in ("class", "id") and value:
                marks.update(f"is={w.lower()}" for w in _WORDS.findall(value))
            elif name in ("role", "itemprop") and value:
                marks.add(f"{name}={value.lower()}")
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and value and "display:none" in value.replace(" ", ""):
                marks.add("hidden")
        self._push(tag, marks if self.known is None else marks & self.known)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # the slash has no meaning in HTML

    def handle_endtag(self, tag: str) -> None:
        if depths := self.depths.get(tag):
            # The end of an inline element doesn't reach beyond the block that it stands in.
            if tag in BLOCK or tag in SILENT or depths[-1] > self.open[-1].block_depth:
                self._pop(depths[-1])
        elif tag in BLOCK:
            self.flush()

    def handle_data(self, data: str) -> None:
        if self.silent:
            return
        if not self.buffer:
            self.at = self.open[-1] if self.open else _ROOT
        self.buffer.append(data)
        if self.links:
            self.linked += len("".join(data.split()))


def blocks(html: str | None, known: frozenset[str] | None = None) -> list[Block]:
    parser = BlockParser(known)
    parser.feed(html or "")
    parser.close()
    parser._pop(0)
    parser.flush()
    return parser.blocks


def _step(x: float, edges: tuple[float, ...]) -> int:
    return sum(x >= e for e in edges)


def features(b: Block, k: int, n: int) -> list[str]:
    """Features of block k of n."""
    words = b.text.count(" ") + 1
    out = [f"tag={b.tag}", f"words={_step(words, (3, 6, 12, 25, 50))}"]
    out += [f"in={t}" for t in sorted(b.within)]
    out += sorted(b.marks)
    density = b.linked / max(1, len("".join(b.text.split())))
    out += [f"links={_step(density, (0.01, 0.3, 0.6, 0.95))}", f"place={_step(k / max(1, n), (0.1, 0.3, 0.7, 0.9))}"]
    out.append("stop" if b.text[-1] in ".!?…:;\"”»" else "no_stop")
    if "©" in b.text or "copyright" in b.text.lower():
        out.append("copyright")
    if "article" in b.within or "main" in b.within:
        out.append(f"core_tag={b.tag}")
    return out


class Crf:
    """Two states (0 other, 1 main) with unary weights by feature name and a transition matrix."""

    def __init__(self, names: dict[str, int], unary: np.ndarray, change: np.ndarray):
        self.weights = {f: float(unary[i, 1] - unary[i, 0]) for f, i in names.items()}
        self.change = [[float(x) for x in row] for row in change]
        self.marks = frozenset(f for f in names if f == "hidden" or f.split("=")[0] in ("is", "role", "itemprop"))

    def decode(self, page: list[Block]) -> list[bool]:
        """Viterbi: the most probable sequence of states."""
        n = len(page)
        if not n:
            return []
        score, back = [0.0, 0.0], []
        for k, b in enumerate(page):
            main = sum(self.weights.get(f, 0.0) for f in features(b, k, n))
            if k:
                step = [[score[i] + self.change[i][j] for i in (0, 1)] for j in (0, 1)]
                back.append([int(s[1] > s[0]) for s in step])
                score = [max(step[0]), max(step[1]) + main]
            else:
                score = [0.0, main]
        state = int(score[1] > score[0])
        states = [state]
        for pointers in reversed(back):
            state = pointers[state]
            states.append(state)
        return [bool(s) for s in reversed(states)]


def train(pages: list[list[tuple[Block, bool]]], rounds: int = 300, rate: float = 0.05, penalty: float = 3e-4) -> Crf:
    """Maximum penalised likelihood over whole pages."""
    names: dict[str, int] = {}
    rows, columns, labels, lengths = [], [], [], []
    for page in pages:
        lengths.append(len(page))
        for k, (b, main) in enumerate(page):
            for f in features(b, k, len(page)):
                rows.append(len(labels))
                columns.append(names.setdefault(f, len(names)))
            labels.append(int(main))
    x = np.zeros((len(labels), len(names)), dtype=np.float32)
    x[rows, columns] = 1
    y = np.eye(2, dtype=np.float32)[labels]
    n, longest = len(lengths), max(lengths)
    page_of = np.repeat(np.arange(n), lengths)
    place = np.concatenate([np.arange(m) for m in lengths])
    inside = np.zeros((n, longest), dtype=bool)
    inside[page_of, place] = True
    true = np.zeros((n, longest), dtype=np.int64)
    true[page_of, place] = labels
    seen = np.zeros((2, 2))
    both = inside[:, 1:] & inside[:, :-1]
    np.add.at(seen, (true[:, :-1][both], true[:, 1:][both]), 1)
    unary, change = np.zeros((len(names), 2), dtype=np.float32), np.zeros((2, 2))
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in (unary, change)]
    add = lambda a: np.logaddexp(a[..., 0], a[..., 1])
    for t in range(1, rounds + 1):
        score = np.zeros((n, longest, 2))
        score[page_of, place] = x @ unary
        ahead, behind = np.empty_like(score), np.zeros_like(score)
        ahead[:, 0] = score[:, 0]
        for k in range(1, longest):
            step = score[:, k] + add((ahead[:, k - 1, :, None] + change).transpose(0, 2, 1))
            ahead[:, k] = np.where(inside[:, k, None], step, ahead[:, k - 1])
        for k in range(longest - 2, -1, -1):
            step = add(change[None] + (score[:, k + 1] + behind[:, k + 1])[:, None, :])
            behind[:, k] = np.where(inside[:, k + 1, None], step, 0)
        norm = add(ahead[:, -1])
        node = np.exp(ahead + behind - norm[:, None, None])[page_of, place]
        pair = np.exp(ahead[:, :-1, :, None] + change + (score + behind)[:, 1:, None, :] - norm[:, None, None, None])
        slopes = [x.T @ (node.astype(np.float32) - y) / n + penalty * unary, (pair[both].sum(axis=0) - seen) / n + penalty * change]
        for w, g, (m, v) in zip((unary, change), slopes, moments, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return Crf(names, unary, change)


class PageMaker:
    """Labelled pages: each text carries a private-use character where it belongs to the article."""

    MAIN = "\ue000"

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, low: int, high: int, stop: bool = True) -> str:
        r = self.r
        n = r.randint(low, high)
        out = ["".join(r.choice("aeiou") + r.choice("bcdfglmnprst") for _ in range(r.randint(1, 4))) for _ in range(n)]
        if r.random() < 0.2:
            out = [w + r.choice(["###", "&&&", "%%%"]) for w in out]
        return escape(" ".join(out).capitalize() + (r.choice(".!?") if stop and r.random() < 0.85 else ""))

    def links(self, n: int) -> list[str]:
        return [f'<a href="/{k}">{self.words(1, 3, False)}</a>' for k in range(n)]

    def wrap(self, tags: list[str], inner: str) -> str:
        """inner inside one of the tags, given as 'tag' or 'tag.class' or 'tag#id'."""
        chosen = self.r.choice(tags)
        m = re.fullmatch(r"(\w+)(?:([.#])(.*))?", chosen)
        attribute = "" if not m[2] else f' {"class" if m[2] == "." else "id"}="{m[3]}"'
        return f"<{m[1]}{attribute}>{inner}</{m[1]}>"

    def menu(self) -> str:
        items = self.links(self.r.randint(3, 9))
        inner = "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if self.r.random() < 0.8 else " | ".join(items)
        return self.wrap(["nav", "nav", "nav", "div.menu", "div#navigation", "div.navbar", "ul.nav", "div.breadcrumb", "nav.breadcrumbs", "header"], inner)

    def advert(self) -> str:
        inner = self.words(3, 40) if self.r.random() < 0.7 else f'<p>{self.words(3, 40)}</p><a href="/x">{self.words(1, 3, False)}</a>'
        return self.wrap(["div.ad", "div.ad", "div.ads", "div.advert", "aside.advertisement", "div.sponsored", "div.promo", "div.banner", "section.ad", "div#ad"], inner)

    def notice(self) -> str:
        inner = f"<p>{self.words(5, 40)}</p>" + (f'<a href="/ok">{self.words(1, 2, False)}</a>' if self.r.random() < 0.5 else "")
        return self.wrap(["div.cookie", "div.notice", "div.consent-banner", "div#cookie-notice", "section.alert", "div.popup", "aside.notice", "div.newsletter", "dialog", "div.paywall"], inner)

    def form(self) -> str:
        inner = f'<label>{self.words(1, 4, False)}<input name="q"></label><p>{self.words(2, 20)}</p><button>{self.words(1, 2)}</button>'
        return self.wrap(["form", "form.search", "form.subscribe", "form#login"], inner)

    def sidebar(self) -> str:
        r = self.r
        parts = [f"<h3>{self.words(1, 4, False)}</h3>"] + [r.choice([f"<p>{self.words(2, 60)}</p>", "<ul>" + "".join(f"<li>{x}</li>" for x in self.links(4)) + "</ul>", self.advert()]) for _ in range(r.randint(1, 4))]
        return self.wrap(["aside", "aside", "div.sidebar", "div#sidebar", "aside.widget", "section.related", "div.related-posts", "div.recommended"], "".join(parts))

    def comments(self) -> str:
        r = self.r
        one = lambda: self.wrap(["li.comment", "div.comment", "article.comment", "div.reply", "div", "li", "div.post-message", "div.response"], r.choice([f"<p>{self.words(2, 60)}</p>", f"<b>{self.words(1, 2, False)}</b><p>{self.words(2, 60)}</p>", self.words(2, 60)]))
        head = f"<h2>{self.words(1, 3, False)}</h2>" if r.random() < 0.7 else ""
        return self.wrap(["section.comments", "div#comments", "ol.commentlist", "div.comments", "section#comments", "div.discussion", "div#disqus_thread", "div.fb-comments", "section#respond", "ul.thread", "div.user-comments", "section.responses", "div.feedback", "div#reader-replies"], head + "".join(one() for _ in range(r.randint(1, 6))))

    def footer(self) -> str:
        inner = ("&copy; " if self.r.random() < 0.7 else "") + self.words(1, 25) + (" &middot; " + self.words(1, 20) if self.r.random() < 0.5 else "")
        if self.r.random() < 0.3:
            inner = f"<p>{inner}</p><p>{' '.join(self.links(3))}</p>"
        return self.wrap(["footer", "footer", "footer", "div.footer", "div#footer", "footer.site-footer"], inner)

    def header(self) -> str:
        inner = self.r.choice([f"<h1>{self.words(1, 4, False)}</h1>", f"<p>{self.words(1, 12)}</p>", f"<div>{self.words(1, 4, False)}</div><p>{self.words(2, 12)}</p>"])
        return self.wrap(["header", "header", "div.header", "div#masthead", "header.site-header"], inner + (self.menu() if self.r.random() < 0.4 else ""))

    def article(self) -> str:
        r, m = self.r, self.MAIN
        inline = lambda t: t if r.random() < 0.8 else re.sub(r"^(\S+ \S+)", lambda x: r.choice(['<b>{}</b>', '<em>{}</em>', '<a href="/y">{}</a>', '<b>{}']).format(x[1]), t)
        paragraph = lambda: r.choice(["<p>{}</p>", "<p>{}</p>", "<p>{}</p>", "<p>{}", "<p>{}<br>", "<div>{}</div>"]).format(m + inline(self.words(1, r.choice([4, 20, 120]))))
        parts = [f"<h1>{m}{self.words(1, 14)}</h1>"] if r.random() < 0.85 else []
        if parts and r.random() < 0.15:
            parts = [f"<header>{parts[0]}</header>"]
        for _ in range(r.randint(1, 14)):
            x = r.random()
            if x < 0.72:
                parts.append(paragraph())
            elif x < 0.79:
                parts.append(f"<h2>{m}{self.words(1, 8, False)}</h2>")
            elif x < 0.84:
                parts.append("<ul>" + "".join(f"<li>{m}{self.words(1, 20)}</li>" for _ in range(r.randint(2, 6))) + "</ul>")
            elif x < 0.87:
                parts.append(f"<blockquote><p>{m}{self.words(5, 60)}</p></blockquote>")
            elif x < 0.90:
                parts.append("<table><tr>" + "".join(f"<td>{m}{self.words(1, 6, False)}</td>" for _ in range(4)) + "</tr></table>")
            elif x < 0.92:
                parts.append(f"<pre>{m}{self.words(3, 30)}</pre>")
            elif x < 0.96:
                parts.append(self.advert())
            else:
                parts.append(r.choice([self.notice, self.sidebar, self.form])())
        return self.wrap(["article"] * 6 + ["main", "div.content", "div#content", "div.post", "section.article-body", "div.entry-content", "div.story", "div.main"], "".join(parts))

    def page(self) -> str:
        r = self.r
        top = [f() for f in r.sample([self.header, self.menu, self.notice, self.advert, self.menu, self.form], r.randint(0, 4))]
        middle = [self.article()] + [f() for f in r.sample([self.sidebar, self.comments, self.advert, self.form, self.comments, self.sidebar], r.randint(0, 3))]
        if r.random() < 0.2:
            middle.insert(0, self.sidebar())
        bottom = [f() for f in r.sample([self.footer, self.footer, self.menu, self.notice], r.randint(0, 2))]
        inner = "".join(middle)
        if r.random() < 0.25:
            inner = self.wrap(["div.wrapper", "main", "div#page", "div.container"], inner)
        return f"<!DOCTYPE html><html><head><title>{self.words(1, 9)}</title></head><body>{''.join(top)}{inner}{''.join(bottom)}" + r.choice(["</body></html>", ""])


def labelled(pages: int, seed: int) -> list[list[tuple[Block, bool]]]:
    out = []
    maker = PageMaker(seed)
    while len(out) < pages:
        found = []
        for b in blocks(maker.page()):
            main = PageMaker.MAIN in b.text
            b.text = b.text.replace(PageMaker.MAIN, "").strip()
            if b.text:
                found.append((b, main))
        if found:
            out.append(found)
    return out


@lru_cache(maxsize=2)
def default_model(pages: int = 700, seed: int = 5) -> Crf:
    return train(labelled(pages, seed))


def main_text(html: str | None, model: Crf) -> str:
    page = blocks(html, model.marks)
    return "\n\n".join(b.text for b, main in zip(page, model.decode(page), strict=True) if main)


def extract(pages: DataFrame, model: Crf | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page. The model, some hundred numbers, is broadcast."""
    shared = pages.sparkSession.sparkContext.broadcast(model or default_model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py(), shared.value) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    chosen = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return chosen.mapInArrow(run, "page_id long, url string, text string, n_chars long")
