"""Main text of web pages: a linear-chain conditional random field over the text blocks of the document tree.

A block is the text between two block-level tags. Its features are its own tag, the tags, classes and ids of its ancestors and again
those of the nearest telling one, and what its text looks like (length, share of links, last character, a few cues). The field has two labels, article and other, a weight
for each feature, and one for each pair of neighbouring labels. It is trained on labelled pages (:func:`labelled_pages`,
made by rule in many layouts), and decodes each page by Viterbi.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_rows

TRAINING_PAGES, TRAINING_SEED, TRAINING_STEPS = 400, 7, 150
RIDGE = 1e-3

_BLOCK_TAGS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noscript object ol optgroup option p pre search section select summary "
    "table tbody td textarea tfoot th thead title tr ul video".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page.
_SILENT = frozenset("script style template head title svg annotation annotation-xml canvas audio video object iframe noembed noframes".split())
#: Their content is text up to the end tag, whatever it looks like.
_RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
#: An open element of the second set ends where one of the first begins.
_CLOSED_BY = {
    "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "option": frozenset({"option"}),
    "tr": frozenset({"tr", "td", "th"}), "td": frozenset({"td", "th"}), "th": frozenset({"td", "th"}),
    "tbody": frozenset({"tr", "td", "th", "thead", "tbody"}), "tfoot": frozenset({"tr", "td", "th", "thead", "tbody"}),
    "body": frozenset({"head"}),
}
_LANDMARKS = frozenset("article aside body dialog fieldset footer form header main nav section".split())
_SCOPE = frozenset("ul ol dl table select".split())
_P_STAYS = _BLOCK_TAGS & frozenset("br button iframe noscript object option optgroup select textarea video title head".split())

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
#: Parts of a tag, each matched where the last one ended: no part is looked at twice, and no value is read for a name.
_GAP, _ATTRIBUTE, _EQUALS, _BARE = (re.compile(p) for p in (r"[\s/]*", r"[^\s/>][^\s/>=]*", r"\s*=\s*", r"[^\s>]+"))
_RAW_END = {tag: re.compile(f"</{tag}(?=[\\s/>])", re.I) for tag in _RAW}
_NAME_PART = re.compile(r"[a-z]+")


@dataclass
class Block:
    """A text block: its tag, the tags of its ancestors, the parts of their classes and ids, and how much of it is linked."""

    text: str
    tag: str
    path: frozenset[str]
    names: frozenset[str]
    #: The innermost element around it that has a class or id, or whose tag says what it is for.
    near: tuple[str, ...]
    linked: int


@dataclass
class _Element:
    tag: str
    names: tuple[str, ...]
    silent: bool
    #: The innermost block-level tag, and the innermost telling element, from here on outwards.
    own: str
    near: tuple[str, ...]


@dataclass
class _Reader:
    """The open elements and the text since the last block began.

    Where each tag is open, and how often each tag and name is, is kept up to date, so that no step looks through the stack. With ``known``
    only those tags and names are kept: a field has weights for no others.
    """

    known: frozenset[str] | None = None
    stack: list[_Element] = field(default_factory=list)
    where: dict[str, list[int]] = field(default_factory=dict)
    path: Counter = field(default_factory=Counter)
    names: Counter = field(default_factory=Counter)
    out: list[Block] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    linked: int = 0

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            own, near = (self.stack[-1].own, self.stack[-1].near) if self.stack else ("", ())
            self.out.append(Block(text, own, frozenset(self.path), frozenset(self.names), near, self.linked))
        self.parts, self.linked = [], 0

    def say(self, text: str) -> None:
        if text and not (self.stack and self.stack[-1].silent):
            text = html.unescape(text)
            self.parts.append(text)
            if self.where.get("a"):
                self.linked += len(text)

    def _last(self, tags: frozenset[str]) -> int:
        return max((self.where[t][-1] for t in tags if self.where.get(t)), default=-1)

    def close(self, tags: frozenset[str], stop: frozenset[str] = frozenset()) -> None:
        """Closes the innermost of ``tags`` with all in it, unless one of ``stop`` is open further in."""
        i = self._last(tags)
        if i < 0 or i < self._last(stop):
            return
        for e in self.stack[i:]:
            self.where[e.tag].pop()
            for counter, keys in ((self.path, (e.tag,)), (self.names, e.names)):
                for k in keys:
                    if k in counter:
                        counter[k] -= 1
                        if not counter[k]:
                            del counter[k]
        del self.stack[i:]

    def open(self, tag: str, attrs: list[tuple[str, str]]) -> None:
        if tag in _BLOCK_TAGS:
            self.flush()
            if tag not in _P_STAYS:
                self.close(frozenset({"p"}), _SCOPE | {"td", "th", "button"})
        if tag in _CLOSED_BY:
            self.close(_CLOSED_BY[tag], _SCOPE - _CLOSED_BY[tag])
        if tag in _VOID:
            return
        names, hidden, given = [], False, set()
        for name, value in attrs:
            # Of attributes of one name the first counts.
            if name in given:
                continue
            given.add(name)
            if name in ("class", "id", "role"):
                names += _NAME_PART.findall(value.lower())
            elif name == "hidden" or (name == "style" and "display:none" in value.lower().replace(" ", "")):
                hidden = True
        around = self.stack[-1] if self.stack else _Element("", (), False, "", ())
        kept = tuple(names if self.known is None else [x for x in names if x in self.known])
        near = (tag, *kept) if names or tag in _LANDMARKS else around.near
        own = tag if tag in _BLOCK_TAGS else around.own
        self.where.setdefault(tag, []).append(len(self.stack))
        self.stack.append(_Element(tag, kept, tag in _SILENT or hidden or around.silent, own, near))
        if self.known is None or tag in self.known:
            self.path[tag] += 1
        self.names.update(kept)

    def end(self, tag: str) -> None:
        if tag in _BLOCK_TAGS:
            self.flush()
        self.close(frozenset({tag}))


class _Page:
    """A page that is read forwards only."""

    def __init__(self, text: str):
        self.text, self.missing = text, set()

    def find(self, what: str, at: int) -> int:
        """Where ``what`` stands next, or -1; that it stands nowhere any more is looked up once."""
        if what in self.missing:
            return -1
        found = self.text.find(what, at)
        if found < 0:
            self.missing.add(what)
        return found

    def after(self, what: str, at: int) -> int:
        """The place after the next ``what``, the page's end without one."""
        found = self.find(what, at)
        return len(self.text) if found < 0 else found + len(what)

    def attributes(self, at: int) -> tuple[int, list[tuple[str, str]], bool]:
        """From within a tag: the place after it, its attributes, and whether it closes itself.

        A value whose quote is never closed ends with the tag, at the next ``>``. A tag that is never closed ends with the page.
        """
        text, n, attrs = self.text, len(self.text), []
        while True:
            gap = _GAP.match(text, at)
            at = gap.end()
            if at >= n:
                return n, attrs, False
            if text[at] == ">":
                return at + 1, attrs, gap[0].endswith("/")
            name = _ATTRIBUTE.match(text, at)
            value, at = "", name.end()
            if equals := _EQUALS.match(text, at):
                at = equals.end()
                if at < n and text[at] in "\"'":
                    close = self.find(text[at], at + 1)
                    if close < 0:
                        end = self.after(">", at + 1)
                        attrs.append((name[0].lower(), text[at + 1 : end - 1]))
                        return end, attrs, False
                    value, at = text[at + 1 : close], close + 1
                elif bare := _BARE.match(text, at):
                    value, at = bare[0], bare.end()
            attrs.append((name[0].lower(), value))


def blocks(text: str, known: frozenset[str] | None = None) -> list[Block]:
    """The text blocks of a page in order: white space made one blank, character references decoded, nothing invisible.

    The page is read once from left to right, however broken its markup. ``known`` limits the tags and names that blocks
    are described by.
    """
    reader, page, at, n, start = _Reader(known), _Page(text), 0, len(text), 0
    while (at := text.find("<", at)) >= 0:
        m = _TAG.match(text, at)
        if m is None and text[at + 1 : at + 2] not in ("!", "?", "/"):
            at += 1  # a sign, no markup
            continue
        reader.say(text[start:at])
        if m is None:
            if text.startswith("<!--", at):
                short = next((s for s in ("<!-->", "<!--->") if text.startswith(s, at)), None)
                at = at + len(short) if short else page.after("-->", at + 4)
            elif text.startswith("<![CDATA[", at) and (end := page.find("]]>", at)) >= 0:
                reader.say(text[at + 9 : end])
                at = end + 3
            else:
                at = page.after(">", at)
        else:
            tag = m[2].lower()
            at, attrs, closed = page.attributes(m.end())
            if m[1]:
                reader.end(tag)
            else:
                reader.open(tag, attrs)
                if tag in _RAW and not closed:
                    stop = _RAW_END[tag].search(text, at)
                    reader.say(text[at : stop.start() if stop else n])
                    at = page.after(">", stop.end()) if stop else n
                    reader.end(tag)
        start = at
    reader.say(text[start:])
    reader.flush()
    return reader.out


#: Words that tell what a block is for.
_CUES = {
    "cookie": r"\bcookies?\b", "copyright": r"©|\bcopyright\b", "subscribe": r"\b(?:subscribe|newsletter|sign up|log ?in|sign in)\b",
    "comment": r"\b(?:comments?|repl(?:y|ies)|posted by)\b", "advert": r"\b(?:advertisement|sponsored|promoted)\b", "share": r"\b(?:share|tweet|follow us)\b",
    "related": r"\b(?:related|read more|see also|popular)\b",
}
_CUE_PATTERNS = {name: re.compile(p, re.I) for name, p in _CUES.items()}


def features(block: Block) -> set[str]:
    """The features of one block."""
    words, n = block.text.count(" ") + 1, len(block.text)
    out = {"bias", f"tag {block.tag}", f"words {min(6, words.bit_length())}", f"links {min(3, 4 * block.linked // max(1, n))}"}
    out |= {f"in {t}" for t in block.path} | {f"name {x}" for x in block.names}
    out |= {f"near {x}" for x in block.near}
    out.add(f"ends {block.text[-1] in '.!?…\"”»:'}")
    out |= {f"cue {name}" for name, p in _CUE_PATTERNS.items() if words < 40 and p.search(block.text)}
    return out


@dataclass
class Field:
    """Weights of features for the label article (the other label has none), and of pairs of labels."""

    weights: dict[str, float]
    pairs: np.ndarray
    start: np.ndarray

    @cached_property
    def known(self) -> frozenset[str]:
        """The tags and names that features with a weight speak of."""
        return frozenset(x for kind, _, x in (f.partition(" ") for f in self.weights) if kind in ("in", "name", "near"))

    def decode(self, found: list[Block]) -> list[bool]:
        """The most likely labels of a page's blocks, by Viterbi."""
        if not found:
            return []
        get = self.weights.get
        unary = np.zeros((len(found), 2))
        unary[:, 1] = [sum(get(f, 0.0) for f in features(b)) for b in found]
        best, back = self.start + unary[0], []
        for u in unary[1:]:
            step = best[:, None] + self.pairs
            back.append(step.argmax(0))
            best = step.max(0) + u
        labels = [int(best.argmax())]
        for b in reversed(back):
            labels.append(int(b[labels[-1]]))
        return [x == 1 for x in reversed(labels)]


def train(pages: list[tuple[list[Block], list[bool]]], steps: int = TRAINING_STEPS) -> Field:
    """Maximises the likelihood of the labels by gradient steps; forward and backward sums run over all pages at once."""
    pages = [p for p in pages if p[0]]
    names = sorted({f for found, _ in pages for b in found for f in features(b)})
    number = {f: i for i, f in enumerate(names)}
    longest = max(len(found) for found, _ in pages)
    size = len(pages)
    mask, gold = np.zeros((size, longest), bool), np.zeros((size, longest), int)
    row, col = [], []
    for i, (found, labels) in enumerate(pages):
        mask[i, : len(found)], gold[i, : len(found)] = True, labels
        for t, b in enumerate(found):
            some = [number[f] for f in features(b)]
            row += [i * longest + t] * len(some)
            col += some
    row, col = np.array(row), np.array(col)
    n = len(names)
    both = mask[:, 1:] & mask[:, :-1]
    gold_pairs = np.array([[(both & (gold[:, :-1] == a) & (gold[:, 1:] == b)).sum() for b in (0, 1)] for a in (0, 1)], float)
    gold_start = np.array([(gold[:, 0] == a).sum() for a in (0, 1)], float)
    w, m, v = np.zeros(n + 6), np.zeros(n + 6), np.zeros(n + 6)
    for step in range(1, steps + 1):
        pairs, start = w[n : n + 4].reshape(2, 2), w[n + 4 :]
        unary = np.zeros((size, longest, 2))
        unary[:, :, 1] = np.bincount(row, w[col], minlength=size * longest).reshape(size, longest)
        forward, backward = np.zeros_like(unary), np.zeros_like(unary)
        forward[:, 0] = start + unary[:, 0]
        for t in range(1, longest):
            new = np.logaddexp.reduce(forward[:, t - 1, :, None] + pairs, axis=1) + unary[:, t]
            forward[:, t] = np.where(mask[:, t, None], new, forward[:, t - 1])
        for t in range(longest - 2, -1, -1):
            new = np.logaddexp.reduce(pairs + (unary[:, t + 1] + backward[:, t + 1])[:, None, :], axis=2)
            backward[:, t] = np.where(mask[:, t + 1, None], new, backward[:, t + 1])
        total = np.logaddexp.reduce(forward[:, -1], axis=1)
        p = np.exp(forward + backward - total[:, None, None])
        joint = forward[:, :-1, :, None] + pairs + (unary[:, 1:] + backward[:, 1:])[:, :, None, :] - total[:, None, None, None]
        expected = (np.exp(np.minimum(joint, 0)) * both[:, :, None, None]).sum((0, 1))
        error = np.where(mask, gold - p[:, :, 1], 0).ravel()
        g = np.concatenate((np.bincount(col, error[row], minlength=n), (gold_pairs - expected).ravel(), gold_start - p[:, 0].sum(0))) / size - RIDGE * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w + 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Field(dict(zip(names, w[:n].tolist())), w[n : n + 4].reshape(2, 2), w[n + 4 :])


class _Pages:
    """Makes labelled pages: markup in which every article text has a mark that no other text has."""

    MARK = "\x01"

    def __init__(self, seed: int):
        self.rng = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        draw = self.rng
        word = lambda: "".join(draw.choice("abcdeilmnoprstuéäñ") for _ in range(draw.randint(1, 9)))
        text = " ".join(word() for _ in range(draw.randint(low, high))).capitalize()
        return text + draw.choice([".", ".", ".", "", "!", "?"])

    def some(self, *choices: str) -> str:
        return self.rng.choice(choices)

    def wrapped(self, inside: str, *tags: str) -> str:
        """``inside`` in one of the tags, such as ``div.menu``, as a class or an id."""
        tag, _, name = self.some(*tags).partition(".")
        attr = f' {self.some("class", "id")}="{name}{self.some("", "", "-" + name, " box", "-wrap")}"' if name else ""
        return f"<{tag}{attr}>{inside}</{tag}>"

    def links(self, n: int) -> str:
        items = [f'<a href="/{i}">{self.words(1, 3)}</a>' for i in range(n)]
        return self.some("<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>", " ".join(items), "".join(f"<p>{x}</p>" for x in items))

    def prose(self, n: int, mark: str = "") -> str:
        out = ""
        for _ in range(n):
            text = f"{mark}{self.words(1, self.some(4, 30, 90))}"
            inner = self.some(text, text, f"<b>{text}</b>", f'{text}<a href="/z">{self.words(1, 2)}</a>', f"{text}<br>{mark}{self.words(2, 20)}")
            out += self.some(*["<p>{}</p>"] * 6, "<p>{}", "<blockquote>{}</blockquote>", "<ul><li>{}</li></ul>", "<div>{}</div>", "<pre>{}</pre>", "<h2>{}</h2>", "<table><tr><td>{}</td></tr></table>").format(inner)
        return out

    def other(self) -> str:
        """A part of the page that is no article."""
        cue = lambda *x: self.some("", "", *x)
        return self.some(
            self.wrapped(self.links(self.rng.randint(2, 9)), "nav", "nav", "nav.main", "div.menu", "div.nav", "div.navbar", "ul.breadcrumb", "div.navigation", "div.pagination"),
            self.wrapped(self.prose(self.rng.randint(1, 3)), "div.ad", "div.ad", "div.ads", "div.advert", "div.advertisement", "aside.ad", "div.banner", "div.promo", "div.sponsored", "section.sponsor"),
            self.wrapped(self.some(self.prose(2), f"<h3>{self.words(1, 4)}</h3>" + self.links(4)), "aside", "aside", "div.sidebar", "aside.sidebar", "div.related", "section.related", "div.widget", "div.popular"),
            self.wrapped(cue("<p>We use cookies.</p>") + self.prose(1), "div.cookie", "div.notice", "div.consent", "div.alert", "div.message", "dialog.popup", "div.modal", "div.disclaimer", "p.notice"),
            self.wrapped(f"<label>{self.words(1, 3)}</label><input><button>{self.words(1, 2)}</button>" + cue("<p>Subscribe to the newsletter</p>") + self.prose(self.rng.randint(0, 1)) + self.some("", f"<select><option>{self.words(1, 2)}</select>", f"<textarea>{self.words(2, 6)}</textarea>"), "form", "form", "form.search", "form.login", "div.newsletter", "div.subscribe", "fieldset"),
            self.comments(),
            self.wrapped(self.links(3) + cue("<p>Share</p>"), "div.share", "div.social", "div.toolbar", "div.tags", "ul.social"),
        )

    def comments(self) -> str:
        one = lambda: self.wrapped(f"<p>{self.words(1, 3)}</p>" + self.prose(self.rng.randint(1, 3)), "div.comment", "li.comment", "div.reply", "article.comment")
        inside = self.some("", "<h3>Comments</h3>", f"<h2>{self.words(1, 2)}</h2>") + "".join(one() for _ in range(self.rng.randint(1, 4)))
        return self.wrapped(inside, "section.comments", "div.comments", "div.comments", "ol.comments", "section.responses", "div.discussion", "div.disqus")

    def header(self) -> str:
        return self.wrapped(self.some("", f"<h1>{self.words(1, 4)}</h1>", f"<p>{self.words(2, 9)}</p>", f"<div>{self.words(1, 3)}</div>") + self.some("", self.links(4)), "header", "header", "div.header", "div.masthead", "header.site", "div.topbar")

    def footer(self) -> str:
        return self.wrapped(self.some("&copy; ", "", "Copyright ") + self.words(1, 40) + self.some("", self.links(3), self.prose(1)), "footer", "footer", "footer", "div.footer", "div.copyright", "footer.site", "div.bottom")

    def page(self) -> str:
        rng, mark = self.rng, self.MARK
        title = f"<{(h := self.some('h1', 'h1', 'h2'))}>{mark}{self.words(2, 9)}</{h}>"
        parts = [title if rng.random() < 0.8 else ""]
        for _ in range(rng.randint(1, 4)):
            parts.append(self.prose(rng.randint(1, 5), mark))
            if rng.random() < 0.25:
                parts.append(self.other())
        if rng.random() < 0.2:
            parts.append(self.some(self.comments(), self.footer()))
        inside = "".join(parts)
        body = self.wrapped(inside, "article", "article", "article", "article.post", "main", "main", "div.article", "div.content", "div.post", "div.entry", "section.story", "div.text", "div.main")
        if rng.random() < 0.3:
            body = self.wrapped(body, "main", "div.container", "div.wrapper", "div.page", "div.content", "div.main")
        before = "".join(self.some(self.header(), self.other(), self.other(), "") for _ in range(rng.randint(0, 3)))
        after = "".join(self.some(self.other(), self.other(), self.comments(), "") for _ in range(rng.randint(0, 3)))
        foot = self.footer() if rng.random() < 0.8 else ""
        return f"<html><head><title>{self.words(2, 8)}</title></head><body>{before}{body}{after}{foot}</body></html>"


def labelled_pages(n: int = TRAINING_PAGES, seed: int = TRAINING_SEED) -> list[tuple[list[Block], list[bool]]]:
    """Blocks and labels of ``n`` pages made by rule, the same for the same seed."""
    maker, out = _Pages(seed), []
    for _ in range(n):
        found = blocks(maker.page())
        labels = [maker.MARK in b.text for b in found]
        for b in found:
            b.text = b.text.replace(maker.MARK, "")
        out.append((found, labels))
    return out


def main_text(page: str | None, model: Field) -> str:
    """The article's blocks in page order, with one blank between them."""
    found = blocks(page or "", model.known)
    return " ".join(b.text for b, kept in zip(found, model.decode(found)) if kept)


def extract(pages: DataFrame, model: Field, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every page, from its whole html.

    Null or empty html gives an empty text, as does a page without an article; broken markup is read as far as it
    goes. Repeated rows and null ids stay rows of their own; other columns are not read; no rows give no rows.
    """
    sent = pages.sparkSession.sparkContext.broadcast(model)
    pages = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))

    def rows(c: dict[str, pa.Array]) -> dict[str, object]:
        texts = [main_text(h, sent.value) for h in c["html"].to_pylist()]
        return {"id": c["id"], "url": c["url"], "text": texts, "n_chars": [len(t) for t in texts]}

    ddl = f"id {pages.schema['id'].dataType.simpleString()}, url {pages.schema['url'].dataType.simpleString()}, text string, n_chars long"
    return map_rows(pages, ddl, rows, text="html").withColumnsRenamed({"id": id_col, "url": url_col})
