"""Main text of pages: a linear-chain conditional random field over leaf blocks, decoded by Viterbi."""

from __future__ import annotations

import math
import random
import re
import sys
from bisect import bisect_right
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from html import escape
from html.parser import HTMLParser

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

from flowspark.llm.common import map_rows, table

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed by HTML: elements that end the block before them, that have no end, that show no text.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary "
    "table tbody td tfoot th thead title tr ul".split()
)
EMPTY_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())
UNSEEN_TAGS = frozenset(
    "script style head title template noscript iframe object svg math textarea select option button canvas audio video datalist".split()
)
# What may stand in `head`: any other start tag, or text, ends it, since `</head>` may be left out.
_HEAD_TAGS = frozenset("base basefont bgsound head link meta noframes noscript script style template title".split())
# Foreign elements, the start tags that end them, and their elements that hold html themselves.
_FOREIGN = frozenset(("svg", "math"))
_ENDS_FOREIGN = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr "
    "ol p pre ruby s small span strong strike sub sup table tt u ul var".split()
)
_HOLDS_HTML = frozenset("foreignobject desc title annotation-xml mi mo mn ms mtext".split())
# A start tag of the group ends an open element of the group.
_CLOSED_BY_NEXT = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "button": {"button"}}
# Those that may not be closed across them.
_SCOPES = frozenset("table ul ol dl div article section main aside nav header footer form body html".split())
_CLOSES_P = BLOCK_TAGS - {"br", "html", "body", "title", "li", "td", "th", "tr", "caption", "legend", "summary", "dd", "dt", "tbody", "tfoot", "thead", "figcaption"}

_WORD = re.compile(r"[A-Za-z][a-z]+|[A-Z]+")


class Element:
    """An open element: `fresh` are the features that it has and the elements around it have not."""

    __slots__ = ("tag", "features", "fresh", "parent")

    def __init__(self, tag: str, features: tuple[str, ...], fresh: tuple[str, ...], parent: Element | None):
        self.tag, self.features, self.fresh, self.parent = tag, features, fresh, parent


@dataclass
class Block:
    text: str
    element: Element | None
    linked: int


class _Blocks(HTMLParser):
    """Leaf blocks in page order, each with its innermost element.

    Open elements are linked to those around them and shared by their blocks,
    and the places of the open ones are kept by name, so that a page of any
    depth takes time and memory in proportion to its length.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self.open: list[Element] = []
        self.places: dict[str, list[int]] = {}
        self.block_places: list[int] = []
        self.scope_places: list[int] = []
        self.held: dict[str, int] = {}
        self.unseen = self.links = self.linked = 0
        self.parts: list[str] = []

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.blocks.append(Block(text, self.open[-1] if self.open else None, self.linked))
        self.parts, self.linked = [], 0

    def _place(self, names: Iterable[str]) -> int:
        """Depth of the innermost open element of one of the names, -1 if there is none."""
        return max((self.places[name][-1] for name in names if self.places.get(name)), default=-1)

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK_TAGS:
            self.flush()
        if self.unseen:
            self._close_unseen(tag)
        if tag in EMPTY_TAGS or (tag == "head" and self.places.get("head")):
            return
        self._close_before(tag)
        words: list[str] = []
        for name, value in attrs:
            if value and name in ("class", "id", "role", "itemprop", "aria-label"):
                words += [w.lower() for w in _WORD.findall(value)]
            elif name == "hidden" or (name == "style" and value and "display:none" in value.replace(" ", "").lower()):
                words.append("hidden")
        self._push(tag, tuple(dict.fromkeys([f"in:{tag}", *(f"name:{word}" for word in words)])))

    def _push(self, tag: str, features: tuple[str, ...]) -> None:
        fresh = tuple(f for f in features if not self.held.get(f))
        for f in features:
            self.held[f] = self.held.get(f, 0) + 1
        depth = len(self.open)
        self.places.setdefault(tag, []).append(depth)
        if tag in BLOCK_TAGS:
            self.block_places.append(depth)
        if tag in _SCOPES:
            self.scope_places.append(depth)
        self.unseen += tag in UNSEEN_TAGS
        self.links += tag == "a"
        # What is around an element does not change while it is open.
        self.open.append(Element(tag, features, fresh, self.open[-1] if self.open else None))

    def _close_unseen(self, tag: str) -> None:
        """Ends an open `head`, `svg` or `math` in which the start tag cannot stand; `body` ends `head` whatever is open in it."""
        head, ended = self._place(("head",)), None
        if tag in _ENDS_FOREIGN:
            # The outermost one inside the innermost element that holds html.
            bound = max(head, self._place(_HOLDS_HTML))
            inside = [places[at] for places in map(self.places.get, _FOREIGN) if places and (at := bisect_right(places, bound)) < len(places)]
            ended = min(inside, default=None)
        if head >= 0 and (tag == "body" or (tag not in _HEAD_TAGS and (ended or len(self.open)) == head + 1)):
            ended = head
        if ended is not None:
            self._pop_to(ended)

    def _close_before(self, tag: str) -> None:
        ends = _CLOSED_BY_NEXT.get(tag, set()) | ({"p"} if tag in _CLOSES_P else set())
        depth = self._place(ends)
        if depth >= 0 and depth > (self.scope_places[-1] if self.scope_places else -1):
            self._pop_to(depth)

    def _pop_to(self, depth: int) -> None:
        for element in reversed(self.open[depth:]):
            for f in element.features:
                self.held[f] -= 1
            self.places[element.tag].pop()
            if element.tag in BLOCK_TAGS:
                self.block_places.pop()
            if element.tag in _SCOPES:
                self.scope_places.pop()
            self.unseen -= element.tag in UNSEEN_TAGS
            self.links -= element.tag == "a"
        del self.open[depth:]

    def handle_startendtag(self, tag, attrs):
        before = len(self.open)
        if self.unseen:
            self._close_unseen(tag)
            before = len(self.open)
        # Elsewhere in html the slash means nothing.
        empty = tag in UNSEEN_TAGS or self._place(_FOREIGN) >= 0
        self.handle_starttag(tag, attrs)
        if empty and len(self.open) > before:
            self._pop_to(before)

    def handle_endtag(self, tag):
        if tag in BLOCK_TAGS:
            self.flush()
        depth = self._place((tag,))
        # An inline end tag does not close the blocks around it; what shows no text ends with all that is open in it.
        inline = tag not in BLOCK_TAGS and tag not in UNSEEN_TAGS
        if depth >= 0 and not (inline and self.block_places and self.block_places[-1] > depth):
            self._pop_to(depth)

    def handle_data(self, data):
        if self.unseen and self.open[-1].tag == "head" and data.strip():
            self._pop_to(len(self.open) - 1)
        if not self.unseen:
            self.parts.append(data)
            if self.links:
                self.linked += len(data.strip())


def blocks_of(html: str | None) -> list[Block]:
    parser = _Blocks()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    return parser.blocks


# --- features ---------------------------------------------------------------


def structure_features(element: Element | None) -> list[str]:
    """What the elements around a block say: each feature once, however often it occurs."""
    found = ["bias", "own:" + (element.tag if element else "")]
    while element:
        found += element.fresh
        element = element.parent
    return found


def text_features(block: Block) -> tuple[str, ...]:
    words = block.text.count(" ") + 1
    size = "1" if words <= 2 else "3" if words <= 5 else "6" if words <= 15 else "16"
    share = block.linked / len(block.text)
    links = "none" if not share else "some" if share < 0.5 else "most"
    return f"words:{size}", f"links:{links}", "ends" if block.text[-1] in ".!?:;\"'" else "open", *(("copyright",) if "©" in block.text else ())


# --- the model ---------------------------------------------------------------


@dataclass
class Model:
    """Label 1 is main text. `weights` holds a feature's weight for label 1 against label 0."""

    weights: dict[str, float] = field(default_factory=dict)
    # moves[a][b]: from label a to label b.
    moves: list[list[float]] = field(default_factory=lambda: [[0.0, 0.0], [0.0, 0.0]])

    def emissions(self, blocks: Sequence[Block]) -> list[float]:
        # Sums from the outermost element inwards, each element once.
        known: dict[Element | None, float] = {None: self.weights.get("bias", 0.0)}
        out = []
        for block in blocks:
            chain, element = [], block.element
            while element not in known:
                chain.append(element)
                element = element.parent
            for inner in reversed(chain):
                known[inner] = known[inner.parent] + sum(self.weights.get(f, 0.0) for f in inner.fresh)
            own = self.weights.get("own:" + (block.element.tag if block.element else ""), 0.0)
            out.append(known[block.element] + own + sum(self.weights.get(f, 0.0) for f in text_features(block)))
        return out

    def decode(self, blocks: Sequence[Block]) -> list[int]:
        """The most likely labels (Viterbi); ties go to label 0."""
        if not blocks:
            return []
        emitted, back = self.emissions(blocks), []
        score = [0.0, emitted[0]]
        for value in emitted[1:]:
            step, origin = [], []
            for label in (0, 1):
                options = [score[a] + self.moves[a][label] for a in (0, 1)]
                best = int(options[1] > options[0])
                step.append(options[best] + value * label)
                origin.append(best)
            back.append(origin)
            score = step
        label = int(score[1] > score[0])
        labels = [label]
        for origin in reversed(back):
            label = origin[label]
            labels.append(label)
        return labels[::-1]


def _log_sum(a: float, b: float) -> float:
    high = max(a, b)
    return high + math.log(math.exp(a - high) + math.exp(b - high))


def _expectations(emitted: list[float], moves: list[list[float]]) -> tuple[list[float], list[list[float]]]:
    """Probability of label 1 per block and expected moves (forward-backward)."""
    n = len(emitted)
    forward = [[0.0, emitted[0]]]
    for value in emitted[1:]:
        last = forward[-1]
        forward.append([_log_sum(last[0] + moves[0][b], last[1] + moves[1][b]) + value * b for b in (0, 1)])
    backward = [[0.0, 0.0]]
    for value in reversed(emitted[1:]):
        ahead = backward[-1]
        backward.append([_log_sum(moves[a][0] + ahead[0], moves[a][1] + value + ahead[1]) for a in (0, 1)])
    backward.reverse()
    total = _log_sum(*forward[-1])
    ones = [math.exp(forward[k][1] + backward[k][1] - total) for k in range(n)]
    pairs = [[0.0, 0.0], [0.0, 0.0]]
    for k in range(n - 1):
        for a in (0, 1):
            for b in (0, 1):
                pairs[a][b] += math.exp(forward[k][a] + moves[a][b] + emitted[k + 1] * b + backward[k + 1][b] - total)
    return ones, pairs


def fit(pages: Iterable[tuple[str, str]], rounds: int = 6, rate: float = 0.4, decay: float = 1e-4, seed: int = 5) -> Model:
    """Maximum likelihood by AdaGrad over (html, main text) pages; a block whose text is a line of the text is main.

    Lines are used up in page order, so that a title that the menu repeats counts once.
    """
    examples = []
    for html, text in pages:
        blocks, lines = blocks_of(html), text.split("\n")
        labels, at = [], 0
        for block in blocks:
            hit = at < len(lines) and block.text == lines[at]
            labels.append(int(hit))
            at += hit
        if blocks:
            features = [(*structure_features(b.element), *text_features(b)) for b in blocks]
            examples.append((features, labels))
    model, order, sums = Model(), random.Random(seed), {}

    def move(kind, name, gradient, now):
        sums[kind, name] = total = sums.get((kind, name), 1e-3) + gradient * gradient
        return now + rate * gradient / math.sqrt(total) - decay * now

    for _ in range(rounds):
        order.shuffle(examples)
        for features, labels in examples:
            emitted = [sum(model.weights.get(f, 0.0) for f in fs) for fs in features]
            ones, pairs = _expectations(emitted, model.moves)
            gradients: dict[str, float] = {}
            for fs, label, one in zip(features, labels, ones):
                for f in fs:
                    gradients[f] = gradients.get(f, 0.0) + label - one
            for f, g in gradients.items():
                model.weights[f] = move("feature", f, g, model.weights.get(f, 0.0))
            for a, b in zip(labels, labels[1:]):
                pairs[a][b] -= 1
            for a in (0, 1):
                for b in (0, 1):
                    model.moves[a][b] = move("move", (a, b), -pairs[a][b], model.moves[a][b])
    return model


# --- labelled pages -----------------------------------------------------------

_SYLLABLES = "an be con de er for ge ha in jo ka le mo na or per qua re sta ti un ver wo zu".split()
_JUNK = ("***", "###", "%%%", "!!", "|", "")
_MENU = ("nav", "menu", "navigation", "navbar", "topnav", "breadcrumb", "breadcrumbs", "pagination", "pager", "toc")
_AD = ("ad", "ads", "advert", "advertisement", "adsense", "sponsored", "sponsor", "promo", "banner", "promotion")
_NOTICE = ("notice", "cookie-notice", "cookie-banner", "consent", "gdpr", "alert", "cookie", "cookies", "popup", "modal", "newsletter", "subscribe", "paywall", "disclaimer")
_SIDE = ("sidebar", "side-bar", "aside", "widget", "widgets", "related", "related-posts", "recommended", "trending", "popular", "share", "social", "author-bio", "tags", "meta", "secondary")
_COMMENTS = ("comments", "comment", "comment-list", "reader-comments", "disqus_thread", "respond", "replies", "discussion", "user-comments")
_MAIN = ("content", "post", "entry-content", "article-body", "article", "story", "post-content", "main", "main-content", "body-text", "page-content", "entry")


def labelled_pages(count: int, seed: int = 11) -> Iterable[tuple[str, str]]:
    """Pages of many invented layouts with their main text: what a person would have marked.

    Texts of all parts are drawn alike, clean and junk, so that the model has
    to go by where a block stands more than by what it says.
    """
    draw = random.Random(seed)

    def words(low, high):
        mark = draw.choice(_JUNK) if draw.random() < 0.3 else ""
        out = ["".join(draw.choices(_SYLLABLES, k=draw.randint(1, 4))) + mark for _ in range(draw.randint(low, high))]
        if draw.random() < 0.15:
            out = [w.upper() for w in out]
        return " ".join(out).capitalize() + draw.choice((".", ".", ".", "", "!", "?"))

    def any_length():
        return words(*draw.choice(((1, 2), (3, 6), (8, 20), (20, 60), (20, 60))))

    def links(low, high):
        return "".join(f'<li><a href="/{k}">{escape(words(1, 3))}</a></li>' for k in range(draw.randint(low, high)))

    def paragraphs(low, high):
        return "".join(f"<p>{escape(any_length())}</p>" for _ in range(draw.randint(low, high)))

    def named(names, inner, tags=("div", "div", "section", "aside")):
        tag, key = draw.choice(tags), draw.choice(("class", "class", "id"))
        return f'<{tag} {key}="{draw.choice(names)}">{inner}</{tag}>'

    def menu():
        inner = f"<ul>{links(2, 8)}</ul>"
        return draw.choice((f"<nav>{inner}</nav>", f"<header>{inner}</header>", named(_MENU, inner, ("div", "nav", "ul"))))

    def noise():
        kind = draw.randrange(7)
        if kind == 0:
            return named(_AD, draw.choice((escape(any_length()), paragraphs(1, 2), f"<a href='/x'>{escape(words(2, 9))}</a>")))
        if kind == 1:
            return named(_NOTICE, escape(any_length()) if draw.random() < 0.5 else paragraphs(1, 2))
        if kind == 2:
            inner = f"<h3>{escape(words(1, 3))}</h3>" + draw.choice((f"<ul>{links(2, 6)}</ul>", paragraphs(1, 2)))
            return draw.choice((f"<aside>{inner}</aside>", named(_SIDE, inner)))
        if kind == 3:
            field_ = f"<label>{escape(words(1, 3))}</label><input name=q><button>{escape(words(1, 1))}</button>"
            return f"<form action='/s'>{field_}{paragraphs(0, 1)}</form>"
        if kind == 4:
            return menu()
        if kind == 5:
            return f"<header><h1>{escape(words(1, 4))}</h1>{paragraphs(0, 1)}</header>" if draw.random() < 0.5 else named(_SIDE, paragraphs(1, 2))
        return comments()

    def comments():
        each = "".join(
            f'<div class="{draw.choice(("comment", "reply", "comment-body"))}"><b>{escape(words(1, 2))}</b><p>{escape(any_length())}</p></div>'
            for _ in range(draw.randint(1, 4))
        )
        return named(_COMMENTS, f"<h3>{escape(words(1, 3))}</h3>{each}", ("div", "section", "ol"))

    def main_part(lines):
        out = []
        title = words(2, 9)
        lines.append(title)
        out.append(f"<h1>{escape(title)}</h1>")
        for _ in range(draw.randint(1, 9)):
            kind = draw.random()
            if kind < 0.7:
                line = any_length()
                inner = escape(line)
                if draw.random() < 0.3:
                    inner = inner.replace(" ", " <b>", 1) + ("</b>" if draw.random() < 0.5 and " " in inner else "")
                elif draw.random() < 0.2:
                    inner = inner.replace(" ", ' <a href="/y">', 1) + ("</a>" if " " in inner else "")
                out.append(f"<p>{inner}</p>" if draw.random() < 0.8 else f"<p>{inner}<br>")
                lines.append(line)
            elif kind < 0.8:
                line = words(1, 5)
                tag = draw.choice(("h2", "h3", "blockquote", "pre", "div"))
                out.append(f"<{tag}>{escape(line)}</{tag}>")
                lines.append(line)
            elif kind < 0.9:
                items = [any_length() for _ in range(draw.randint(1, 4))]
                out.append("<ul>" + "".join(f"<li>{escape(i)}</li>" for i in items) + "</ul>")
                lines.extend(items)
            else:
                out.append(noise())
        return "".join(out)

    for _ in range(count):
        lines: list[str] = []
        inner = main_part(lines)
        if draw.random() < 0.3:
            inner += comments()
        shape = draw.randrange(4)
        if shape <= 1:
            main = f"<article>{inner}</article>"
        elif shape == 2:
            main = f"<main>{inner}</main>"
        else:
            main = named(_MAIN, inner, ("div", "div", "section"))
        if draw.random() < 0.3:
            main = named(_MAIN + ("container", "wrapper", "page"), main, ("div",))
        before = "".join(draw.choice((menu, noise))() for _ in range(draw.randint(0, 3)))
        after = "".join(noise() for _ in range(draw.randint(0, 3)))
        if draw.random() < 0.8:
            after += draw.choice(("<footer>{}</footer>", '<div class="footer">{}</div>', '<div id="footer">{}</div>')).format(
                escape("© " + any_length()) if draw.random() < 0.6 else paragraphs(1, 2)
            )
        head = f"<head><title>{escape(words(2, 6))}</title><style>p{{margin:0}}</style></head>"
        yield f"<!DOCTYPE html><html>{head}<body>{before}{main}{after}</body></html>", "\n".join(lines)


# Labelled pages that a model is fitted on; more do not change held-out accuracy.
TRAINING_PAGES = 600


def main_text(html: str | None, model: Model) -> str:
    blocks = blocks_of(html)
    return "\n".join(b.text for b, label in zip(blocks, model.decode(blocks)) if label)


def extract_text(
    pages: DataFrame, model: Model, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """One row per page: id, url, text, n_chars (code points).

    NULL or empty html gives an empty text, as does a page without a block of
    main text. Broken markup is read as far as it goes. Repeated pages each
    give a row; other columns are not read; an empty table gives no rows.
    """
    kinds = dict(pages.dtypes)

    def rows(key, url, html):
        text = main_text(html, model)
        yield key, url, text, len(text)

    schema = f"`{id_col}` {kinds[id_col]}, `{url_col}` {kinds[url_col]}, text string, n_chars bigint"
    return map_rows(pages, [id_col, url_col, html_col], rows, schema)


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = fit(labelled_pages(TRAINING_PAGES))
    return extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"), model)
