"""Main text of web pages by maximum-scoring subsequence.

A page is a sequence of tokens: words score positive and tags negative, by weights that are fitted
on labelled pages, and one linear scan finds the contiguous region with the greatest sum. Weights depend
on what a token is and where it stands: the tag's kind, for words the kind of the innermost telling container
(article, menu, advert, form, comments, ...), and whether the word is in a link. They are log-odds of "inside the main text" for the token's
feature in the labelled pages, made by ``labelled_pages()`` from a grammar of page layouts (no page of the data is used), so any region of
menus, headers, footers, sidebars, notices, adverts, forms or reader comments sums below zero, and
any region of prose above.

What a container is, its tag says (nav, aside, footer, ...), its ARIA role, or the first telling name among its classes or in its id. A name tells by its last
word that is not a generic one ("cookie-notice", "comment-list"); names that describe a state ("has-sidebar", "ad-free") tell nothing, and
classes of paragraphs, list items and cells never hide their text. A container that holds most of the page's words, with no main text beside it, is a
wrapper whatever its name: see read().

From the region the text of its blocks is taken: boilerplate containers inside it (an advert
between two paragraphs) are left out, character references are decoded, white space in a block becomes one
space, blocks are joined by one newline.

Defined cases: null or empty html, and pages without words in their body, give an empty text; unclosed,
crossed or cut-off tags close with the block that holds them; texts of any length are read whole; of equal sums the region that
ends first wins, and of these the one that begins last; repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import html as _html
import math
import random
import re
from collections.abc import Iterable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as K

RESULT = "page_id long, url string, text string, n_chars long"
ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

# Names of HTML elements, by what they do.
RAW = frozenset("script style noscript template textarea select svg math iframe object canvas audio video title".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q s samp small span strike strong sub sup time tt u var wbr img".split())
SELF_CLOSING = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CLOSES_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
# Words in tags, roles, classes and ids by the kind of container that they tell.
KINDS = {
    "menu": "nav menu navbar breadcrumb breadcrumbs pagination pager toc tabs toolbar skip navigation",
    "header": "header banner masthead topbar logo",
    "footer": "footer copyright colophon legal contentinfo bottom",
    "sidebar": "aside sidebar related related-posts related-articles recommended recommendations widget popular trending complementary sidenav rail",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup paywall disclaimer dialog announcement",
    "advert": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion promoted adsense banner-ad",
    "form": "form search login fieldset button input searchbox",
    "comments": "comment comments discussion disqus replies reply respond feedback reviews",
    "share": "share sharing social",
    "main": "article main content post entry story body-text articlebody",
}
_KIND = {w: k for k, ws in KINDS.items() for w in ws.split()}
# Parts of a name that say nothing of what it names, and those that make it describe a state.
GENERIC = frozenset("area bar block body box button buttons col column container content group holder inner item items left link links list main outer panel region right row section site top widget wrap wrapper".split())
STATES = frozenset("has with without no not is js hide hidden show free ready enabled disabled".split())
CONTAINERS = frozenset("div section article main aside nav header footer form ul ol dl table fieldset dialog details figure menu button label".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|([^<]+|<)", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
_SPACE = re.compile(r"\s+")


def _named(name: str) -> str | None:
    """The kind that one class or id tells."""
    words = [w for w in re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", name).lower()) if w]
    if not words or (len(words) > 1 and (words[0] in STATES or words[-1] in STATES)):
        return None
    whole = _KIND.get("-".join(words))
    if whole:
        return whole
    while len(words) > 1 and words[-1] in GENERIC:
        if words[-1] in _KIND and words[-2] not in _KIND:  # "main-content", "left-sidebar"
            break
        words.pop()
    return _KIND.get(words[-1])


def _kind(tag: str, attributes: str) -> str | None:
    """The kind of container that a start tag opens; None if it tells nothing."""
    own = _KIND.get(tag) if tag in CONTAINERS else None
    found: dict[str, str] = {}
    if attributes:
        for name, a, b, c in _ATTRIBUTE.findall(attributes):
            value, name = a or b or c, name.lower()
            if name == "hidden" and not value or name == "aria-hidden" and value.lower() == "true" or name == "style" and "display:none" in value.lower().replace(" ", ""):
                return "notice"
            if name in ("class", "id", "role") and tag in CONTAINERS:
                kind = next((k for k in map(_named, value.split()) if k), None)
                if kind:
                    found.setdefault(name, kind)
    if "role" in found:
        return found["role"]
    if own is not None and own != "main":  # <aside class="post"> is an aside
        return own
    kinds = list(found.values())
    return next((k for k in kinds if k != "main"), "main" if kinds else own)


class Inside:
    """A boilerplate container of a page: its kind, and the words (not of links) and the main words that stand in it."""

    __slots__ = ("kind", "main", "words")

    def __init__(self, kind: str, words: int, main: int):
        self.kind, self.words, self.main = kind, words, main


class Open:
    """The elements that are open, with the kind that each brought, and how many there are of each name."""

    def __init__(self):
        self.stack: list[tuple[str, Inside | None]] = []
        self.kinds = ["plain"]
        self.names: dict[str, int] = {}
        self.words = self.main = 0

    def push(self, tag: str, kind: str | None, container: Inside | None) -> None:
        self.stack.append((tag, container))
        self.kinds.append(_inherit(self.kinds[-1], kind))
        self.names[tag] = self.names.get(tag, 0) + 1

    def pop(self, names, inner: bool = False) -> None:
        """Close the innermost open element of these names and what is open in it."""
        if not any(self.names.get(n) for n in names):
            return
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] in names:
                self.cut(i)
                return
            if inner and self.stack[i][0] in ("ul", "ol", "dl", "table", "div", "article", "section"):
                return

    def cut(self, i: int) -> None:
        for tag, container in self.stack[i:]:
            self.names[tag] -= 1
            if container is not None:
                container.words, container.main = self.words - container.words, self.main - container.main
        del self.stack[i:]
        del self.kinds[i + 1 :]


def tokens(page: str, wrappers: frozenset[int] = frozenset(), found: list[Inside] | None = None):
    """Tokens of a page: (feature, is_word, text, block, container path's kind). A text piece is one token with its words counted.

    Yields (feature, n_words, raw text or None, block number, kind); tags have n_words 0. The boilerplate containers are told to `found` in order; those numbered
    in `wrappers` say nothing of what they hold.
    """
    open_ = Open()
    stack, kinds = open_.stack, open_.kinds
    found = [] if found is None else found
    block = 0
    in_link = 0
    raw_until: re.Pattern | None = None
    at, size = 0, len(page)
    while at < size:
        if raw_until is not None:
            m = raw_until.search(page, at)
            at = m.start() if m else size
            raw_until = None
            continue
        m = _TOKEN.match(page, at)
        if m is None:  # a start tag whose quotes do not close
            end = page.find(">", at)
            at = size if end < 0 else end + 1
            continue
        at = m.end()
        cdata, close, tag, attributes, text = m.groups()
        if text is not None or cdata is not None:
            text = cdata if text is None else text
            n = len(text.split())
            kind = kinds[-1]
            if n:
                if not in_link:
                    open_.words += n
                    open_.main += n * (kind == "main")
                yield ("link-word" if in_link else "word", kind), n, text, block, kind
            elif text:
                yield None, 0, text, block, kind
            continue
        if tag is not None:
            tag = tag.lower()
            if tag in RAW:
                if not attributes.rstrip().endswith("/"):
                    raw_until = re.compile(rf"</{re.escape(tag)}\b", re.I)
                yield ("tag", "raw", kinds[-1]), 0, None, block, kinds[-1]
                continue
            if tag not in INLINE and tag != "br":
                if tag in CLOSES_P:
                    open_.pop({"p"})
                if tag in SELF_CLOSING:
                    open_.pop(SELF_CLOSING[tag], inner=True)
                block += 1
                in_link = 0
            if tag not in VOID:
                kind, container = _kind(tag, attributes), None
                if kind not in (None, "main"):
                    container = Inside(kind, open_.words, open_.main)
                    found.append(container)
                    if len(found) - 1 in wrappers:
                        kind = None
                open_.push(tag, kind, container)
                if tag == "a":
                    in_link = 1
            yield ("tag", tag if tag in _KNOWN else "other", kinds[-1]), 0, " " if tag == "br" else None, block, kinds[-1]
            continue
        if close is not None:
            close = close.lower()
            if close == "a":
                in_link = 0
            inside = kinds[-1]
            open_.pop({close})
            if close not in INLINE and close not in RAW:
                block += 1
            yield LEAVE if inside == "main" and kinds[-1] != "main" else ("end", close if close in _KNOWN else "other", kinds[-1]), 0, None, block, kinds[-1]
    open_.cut(0)
    found.append(Inside("page", open_.words, open_.main))


#: What share of a page's words a container has to hold to be a wrapper of the page; words of readers' comments are often the most of a page.
MOST, MOST_COMMENTS = 0.5, 0.9
#: Words that a wrapper holds at least: a footer may be longer than a very short text.
LEAST = 50


def read(page: str) -> list:
    """The tokens of a page. A container that holds most of the page's words while there is no main text beside it (a form around the whole page, a main text in a
    "legal" box) is the page's wrapper and no boilerplate, whatever its name."""
    found: list[Inside] = []
    seen = list(tokens(page, found=found))
    whole = found.pop()
    large = [i for i, c in enumerate(found) if c.words >= LEAST and c.words > (MOST_COMMENTS if c.kind == "comments" else MOST) * whole.words]
    if not large:
        return seen
    again: list[Inside] = []  # they lie one in the other, so it is told at once what is main when none of them hides it
    list(tokens(page, frozenset(large), again))
    whole = again.pop()
    wrappers = []
    for i in large:
        if whole.main > again[i].main:
            break
        wrappers.append(i)
    return list(tokens(page, frozenset(wrappers))) if wrappers else seen


#: The tag that ends a container of main text: what follows may be another text, or a teaser of one.
LEAVE = ("leave", "main")
_KNOWN = frozenset("p li a div ul nav br h1 h2 h3 b td tr table span article section".split())


def _inherit(outer: str, own: str | None) -> str:
    """Boilerplate stays boilerplate inside, whatever it holds; the page's own header in an article is part of it."""
    if own is None:
        return outer
    if outer not in ("plain", "main"):
        return outer
    if outer == "main" and own == "header":
        return "main"
    return own


def labelled_pages(n: int = 60, seed: int = 3) -> list[tuple[str, list[tuple[int, int]]]]:
    """Pages with their main text's place, as (html, [(start, end)]): made from layouts, for the fit of the weights."""
    r = random.Random(seed)

    def words(k):
        return " ".join("".join(r.choice("aeiounrstl") for _ in range(r.randint(2, 8))) for _ in range(k))

    def links(k):
        return "<ul>" + "".join(f'<li><a href="/{i}">{words(r.randint(1, 3))}</a></li>' for i in range(k)) + "</ul>"

    out = []
    for _ in range(n):
        before = [f"<nav>{links(r.randint(3, 8))}</nav>", f"<header><div>{words(4)}</div></header>", f'<div class="ad">{words(r.randint(4, 14))}</div>', f'<div class="cookie-notice">{words(12)}</div>', f"<form><label>{words(2)}</label></form>"]
        after = [f"<footer><p>{words(r.randint(4, 15))}</p></footer>", f"<aside><h3>{words(2)}</h3>{links(4)}</aside>", f'<div id="comments">' + "".join(f"<p>{words(r.randint(5, 20))}</p>" for _ in range(3)) + "</div>", f'<div class="share">{links(3)}</div>']
        card = r.choice(["entry", "story", "post teaser", "entry-content"])
        teasers = [f'<div class="{card}"><h3>{words(3)}</h3><p>{words(r.randint(4, 25))}</p></div>' if r.random() < 0.3 else "" for _ in range(2)]
        r.shuffle(before)
        r.shuffle(after)
        paragraphs = [f"<p>{words(r.randint(8, 60))}</p>" for _ in range(r.randint(2, 8))]
        if r.random() < 0.3:
            paragraphs.insert(1, f"<ul><li>{words(9)}</li><li>{words(7)}</li></ul>")
        body = f"<h1>{words(6)}</h1>" + "".join(paragraphs)
        tag = r.choice(["article", "main", 'div class="content"', 'div id="main-content"', 'section class="story has-sidebar"', "div"])
        if tag == "div":  # nothing tells the teasers from such a text
            teasers = ["", ""]
        head = "<html><body>" + "".join(before[: r.randint(1, 5)]) + teasers[0] + f"<{tag}>"
        out.append((head + body + f"</{tag.split()[0]}>" + teasers[1] + "".join(after[: r.randint(1, 4)]) + "</body></html>", [(len(head), len(head) + len(body))]))
    return out


@lru_cache(maxsize=1)
def weights() -> dict:
    """Score of a token's feature: words their log-odds of standing in the main text (bounded), tags a penalty that is greater the rarer
    they are in it."""
    inside: dict = {}
    outside: dict = {}
    for page, spans in labelled_pages():
        marked = page[: spans[0][0]] + "\x00" + page[spans[0][0] : spans[0][1]] + "\x01" + page[spans[0][1] :]
        on = False
        for feature, n, text, _, _ in tokens(marked):
            if text and "\x00" in text:
                on = True
            if text and "\x01" in text:
                on = False
            if feature is not None:
                table = inside if on else outside
                table[feature] = table.get(feature, 0) + max(1, n)
    out = {}
    for f in inside.keys() | outside.keys():
        odds = math.log((inside.get(f, 0) + 1) / (outside.get(f, 0) + 1))
        out[f] = max(-6.0, min(3.0, odds)) if f[0] in ("word", "link-word") else min(-0.1, 0.25 * odds - 0.1)
    # the end of a main container outweighs the longest teaser of the labelled pages
    out[LEAVE] = -1.0 - max((sum(out[f] * max(1, n) for f, n, *_ in run) for page, spans in labelled_pages() for run in _beside(page, spans[0])), default=0.0)
    return out


def _beside(page: str, span: tuple[int, int]):
    """The main words right before and after the labelled text: a teaser's, or none."""
    found: list[list] = [[], []]
    side = 0
    for token in tokens(page[: span[0]] + "\x00" + page[span[0] : span[1]] + "\x01" + page[span[1] :]):
        if token[2] and "\x00" in token[2]:
            side = -1
        if token[2] and "\x01" in token[2]:
            side = 1
        if side >= 0 and token[0] in (("word", "main"), ("link-word", "main")):
            found[side].append(token)
    return found


def _score(feature, n: int, table: dict) -> float:
    """Words that the fit has not seen in this kind of container score by the container."""
    known = table.get(feature)
    if known is None:
        boiler = feature[-1] not in ("plain", "main")
        known = (-3.0 if boiler else 1.0 if feature[0] == "word" else 0.5) if feature[0] in ("word", "link-word") else -0.5
    return known * n if n else known


def region(scores: Iterable[float]) -> tuple[int, int]:
    """First and last place of the contiguous region with the greatest sum, by one scan; (-1, -1) if no sum is positive."""
    best = total = 0.0
    first = last = -1
    start = 0
    for i, score in enumerate(scores):
        total += score
        if total <= 0:
            total, start = 0.0, i + 1
        elif total > best:
            best, first, last = total, start, i
    return first, last


def extract(page: str | None) -> str:
    """The main text of one page."""
    if not page:
        return ""
    table = weights()
    seen = read(page)
    first, last = region(0.0 if feature is None else _score(feature, n, table) for feature, n, *_ in seen)
    if first < 0:
        return ""
    blocks: list[list[str]] = []
    now = None
    for _, _, text, block, kind in seen[first : last + 1]:
        if text is None or kind not in ("plain", "main"):
            continue
        if block != now:
            blocks.append([])
            now = block
        blocks[-1].append(text)
    lines = (_SPACE.sub(" ", _html.unescape("".join(b))).strip() for b in blocks)
    return "\n".join(x for x in lines if x)


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of rows (page_id, url, html)."""

    def run(batches):
        for b in K.slices(batches, "html"):
            text = [extract(x) for x in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], schema=ARROW)

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, RESULT)


def op6_html_extract(spark, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
