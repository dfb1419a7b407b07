"""The main text of web pages: two passes of block rules over stop-word density, length and link density.

A page is cut into blocks at block-level tags. First pass: a block that is mostly links, or lies in a menu, header, footer,
sidebar, advert, notice, form or among comments (by element, role, class or id) is boilerplate; a long block with many stop words
of the page's language is text; a long one with hardly any is boilerplate; the rest, short or of middling density, is ambiguous.
Second pass: an ambiguous block inherits the label of the nearest decided block. Inside an article or main element the rules
lean to text: low density alone decides nothing there, and the element's borders count as text. Where a page has such an
element with text, blocks outside it are boilerplate.

Character references are decoded, white space inside a block becomes one space, blocks are joined by line breaks in page order.

Nulls: a null html, like an empty one or one without text, gives an empty text; null ids and addresses are kept. Broken
markup is read as far as it goes: an unclosed quote or tag ends at the next ``>``, unclosed elements end with their parent. In
a language without a stop-word list length and links decide. Nearest neighbours at equal distance: the later one decides for a
heading, else both must be text. Repeated rows give repeated result rows; very long pages take time and memory in proportion to
their length. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footlog.llm.common import row_slices

#: Code points from which a block is long enough to be judged by its own words, and from which middling density is enough.
SHORT, LONG = 70, 200
#: Share of stop words from which a long block is text, and below which it is boilerplate.
HIGH, LOW = 0.25, 0.12
#: Share of characters inside links from which a block is boilerplate.
LINKED = 0.4

# Frequent function words, by language.
STOP_WORDS = {
    "en": "a about after all also an and any are as at be because been but by can could did do for from had has have he her his how i if in into is it "
    "its just like more my no not of on one only or other our out over she so some than that the their them then there these they this to up was we "
    "were what when which who will with would you your",
    "de": "aber alle als also am an auch auf aus bei bis da das dass dem den der des die doch durch ein eine einem einen einer er es für haben hat hier "
    "ich im in ist ja kann kein man mehr mit nach nicht noch nur oder sch sein sich sie sind so über um und uns unter vom von vor war was wenn "
    "werden wie wir wird zu zum zur",
    "fr": "à au aux avec ce ces cette comme dans de des deux du elle elles en est et eux fait il ils je la le les leur lui mais me même nous on ont ou où "
    "par pas plus pour qu que qui sa sans se ses si son sont sur ta te tout très tu un une vous était être",
    "es": "a al algo ante como con cuando de del desde donde dos el ella en entre era es esta este está fue ha hay la las le lo los más me mi muy no nos o "
    "os otra otro para pero por porque que se ser si sin sobre son su sus también te tiene todo un una uno y ya yo",
}
# Elements.
_BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre search section select summary table tbody td template tfoot th "
    "thead tr ul".split()
)
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_RAW = set("script style title textarea iframe noembed noframes xmp".split())
_ASIDE = set("nav footer aside form dialog menu search fieldset button select template noscript svg math canvas audio video object head".split())
_PLAIN = set("div section ul ol li table tbody tr td th dl dt dd blockquote figure h1 h2 h3 h4 h5 h6 pre".split())
_HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
_ASIDE_ROLES = set(
    "navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar tablist form status tooltip note".split()
)
# Words in class names and ids of what is not the article.
_ASIDE_NAMES = set(
    "ad ads adv advert adverts advertisement advertising adsense adbox banner breadcrumb breadcrumbs byline comment comments commentlist consent cookie cookies "
    "copyright disclaimer discussion disqus feedback foot footer footnav gdpr legal login masthead menu menus modal nav navbar navigation newsletter "
    "notice notices notification outbrain overlay pager pagination paywall popup promo promotion promoted recommended related replies reply respond "
    "share sharing sidebar sidenav signin signup social sponsor sponsored sponsors subscribe subscription taboola teaser teasers toolbar topbar trending "
    "widget widgets".split()
)
_MAIN_NAMES = set("article content main story entry post body".split())
_COMMENT_TITLE = re.compile(r"(?:\d+\s+)?(?:reader\s+)?(?:comments?|responses|replies|discussion|leave a (?:reply|comment)|kommentare?|commentaires?|comentarios?)\b[\s:(\d)]*", re.I)
_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+>""", re.S
)
_ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|style|hidden|aria-hidden)(?![^\s=/>])(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_NAME = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_WORD = re.compile(r"[^\W\d_]+")


class Block(NamedTuple):
    text: str
    tag: str
    linked: int  # code points inside links
    aside: bool  # inside what is not the article
    zone: int  # number of the article (2) or main (1) element it lies in, with its strength in the lowest digit; 0 for none


class _Open(NamedTuple):
    tag: str
    aside: str  # why all inside is not the article, or ''
    zone: int


def _named(value: str) -> tuple[bool, bool, bool]:
    """Whether the class names say: not the article; the article; comments."""
    aside = main = comments = False
    for name in value.split():
        words = [w.lower() for w in _NAME.findall(name)]
        if not words or words[0] in ("has", "with", "no", "without", "is", "js"):
            continue
        if words[-1] == "header" and words[0] not in ("article", "entry", "post", "story", "content", "section"):
            aside = True
        hits = _ASIDE_NAMES.intersection(words)
        aside |= bool(hits)
        comments |= any(w.startswith(("comment", "discussion", "disqus", "repl", "respon")) for w in hits)
        main |= words[-1] in _MAIN_NAMES and not hits
    return aside, main, comments


def _opened(tag: str, attributes: str, parent: _Open, number: int) -> _Open:
    """The state inside a new element."""
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)} if attributes else {}
    aside, main, comments = _named(f"{found.get('class', '')} {found.get('id', '')}") if found else (False, False, False)
    roles = set(found.get("role", "").lower().split())
    why, zone, strength = parent.aside, parent.zone, parent.zone % 10
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(found.get("style", "")):
        return _Open(tag, "hidden", zone)
    if tag in ("html", "body"):
        return _Open(tag, why, zone)
    if tag == "article" or "article" in roles:
        if why in ("", "form") and strength < 2 and not comments:
            return _Open(tag, "", number * 10 + 2)
        return _Open(tag, why or "comments", zone)  # an article inside an article is a comment on it
    if tag == "main" or "main" in roles:
        return _Open(tag, "", max(zone, number * 10 + 1) if strength < 2 else zone)
    if not why:
        if tag in _ASIDE or roles & _ASIDE_ROLES or aside or (tag == "header" and not strength):
            why = "form" if tag == "form" else tag
        elif main and not strength:
            zone = number * 10 + 1
    return _Open(tag, why, zone)


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order."""
    out: list[Block] = []
    stack, counts, titled = [_Open("", "", 0)], Counter(), None  # titled: the depth at which comments began
    pieces: list[str] = []
    linked, link_depth, breaks, number, tag = 0, 0, 0, 0, ""

    def flush() -> None:
        nonlocal linked, breaks, titled
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                here = stack[-1]
                if tag in _HEADINGS and titled is None and _COMMENT_TITLE.fullmatch(text):
                    titled = len(stack) - (here.tag == tag)
                out.append(Block(text, tag, linked, bool(here.aside) or titled is not None, here.zone))
            pieces.clear()
        linked, breaks = 0, 0

    def pop_to(depth: int) -> None:
        nonlocal link_depth, titled
        while len(stack) > depth:
            counts[stack.pop().tag] -= 1
        if link_depth > len(stack):
            link_depth = 0
        if titled is not None and len(stack) < titled:
            titled = None

    def say(text: str) -> None:
        nonlocal linked, breaks
        if "&" in text:
            text = html.unescape(text)
        if not text.isspace():
            breaks = 0
            if link_depth:
                linked += len(text.strip())
        pieces.append(text)

    end, at = page.rfind(">") + 1, 0
    while match := _TAG.search(page, at, end):
        if match.start() > at:
            say(page[at : match.start()])
        at = match.end()
        name = match[2] or match[5]
        if not name:
            if page.startswith("<!--", match.start()) and not page.endswith("-->", 0, at):
                at = end = len(page)
            continue
        name, closing = name.lower(), match[1] or match[4]
        if closing:
            if name == "a":
                link_depth = 0
            elif name == "p" or counts[name]:
                if name in _BLOCK:
                    flush()
                if counts[name]:
                    depth = len(stack) - 1
                    while stack[depth].tag != name:
                        depth -= 1
                    pop_to(depth)
                if name in _BLOCK:
                    link_depth, tag = (0 if name == "p" else link_depth), stack[-1].tag
            continue
        attributes = match[3] or match[6] or ""
        if name in _RAW:
            close = re.compile(rf"</{name}(?![^\s/>])", re.I).search(page, at)
            at = close.start() if close else len(page)
            end = max(end, at)
            continue
        if name == "br":
            breaks += 1
            if breaks > 1:
                flush()
            else:
                pieces.append(" ")
            continue
        if name in _BLOCK:
            flush()
            if counts["p"] and name not in ("html", "body"):  # a paragraph ends where a block begins
                pop_to(max(i for i in range(len(stack)) if stack[i].tag == "p"))
            tag = name
        if name in _VOID:
            continue
        if name == "a":
            link_depth = len(stack)
            continue
        number += 1
        if (name in _BLOCK and name != "p") or name in _ASIDE:
            plain = not attributes and name in _PLAIN
            state = _Open(name, *stack[-1][1:]) if plain else _opened(name, attributes, stack[-1], number)
        elif "=" in attributes or "hidden" in attributes:
            state = _opened(name, attributes, stack[-1], number)
            if state[1:] == stack[-1][1:]:
                continue  # an inline element or paragraph without a say
        else:
            continue
        if state[1:] != stack[-1][1:]:
            flush()
        stack.append(state)
        counts[name] += 1
    if at < len(page):
        say(page[at:])
    flush()
    return out


class Rules:
    """Both passes; one per Python worker."""

    def __init__(self, stop_words: dict[str, str]) -> None:
        self.langs = list(stop_words)
        self.known: dict[str, list[int]] = {}
        for i, words in enumerate(stop_words.values()):
            for word in words.split():
                self.known.setdefault(word, []).append(i)

    def densities(self, found: list[Block]) -> list[float | None]:
        """Each block's share of the page's language's stop words; all null where no language fits the page."""
        hits, sizes, total = [], [], [0] * len(self.langs)
        for block in found:
            words, mine = _WORD.findall(block.text.lower()), [0] * len(self.langs)
            for word in words:
                if word in self.known:
                    for i in self.known[word]:
                        mine[i] += 1
            hits.append(mine)
            sizes.append(len(words))
            if not block.aside:
                total = [a + b for a, b in zip(total, mine, strict=True)]
        best = max(range(len(total)), key=total.__getitem__) if total else 0
        judged = sum(n for n, block in zip(sizes, found, strict=True) if not block.aside)
        if not total or total[best] < LOW / 2 * judged:
            return [None] * len(found)
        return [mine[best] / n if n else 0.0 for mine, n in zip(hits, sizes, strict=True)]

    def first(self, block: Block, density: float | None) -> bool | None:
        """Text, boilerplate, or undecided."""
        size = len(block.text)
        if block.aside:
            return False
        share = block.linked / size
        if share >= LINKED:
            return None if block.zone and block.tag == "p" and size < LONG else False
        if not block.zone and "\N{COPYRIGHT SIGN}" in block.text and size < LONG:
            return False
        if size < SHORT:
            return None
        if density is None or density >= HIGH:
            return True
        if density >= LOW:
            return True if size >= LONG else None
        return None if block.zone else False

    def labels(self, found: list[Block]) -> tuple[list[float | None], list[bool | None], list[bool]]:
        """Densities, the first pass, the second pass."""
        density = self.densities(found)
        first = [self.first(b, d) for b, d in zip(found, density, strict=True)]
        border = [block.zone > 0 for block in found]
        before, after = _nearest(found, first, border, range(len(found))), _nearest(found, first, border, range(len(found) - 1, -1, -1))
        second = []
        for block, label, (back, left), (on, right) in zip(found, first, before, after, strict=True):
            if label is None:
                nearer = left if back < on else right if on < back or block.tag in _HEADINGS else left and right
                label = (right if block.tag in _HEADINGS and not block.zone else nearer) and not (block.linked and not block.zone)
            second.append(label)
        strength = max((b.zone % 10 for b, label in zip(found, second, strict=True) if label), default=0)
        return density, first, [label and block.zone % 10 >= strength for block, label in zip(found, second, strict=True)]


def _nearest(found: list[Block], first: list[bool | None], border: list[bool], order) -> list[tuple[int, bool]]:
    """For every block the distance and label of the last decided block met before it in this order; a zone's border
    counts as one, as text inside an article and as boilerplate elsewhere."""
    out: list[tuple[int, bool]] = [(0, False)] * len(found)
    away, label, zone = 0, False, None
    for i in order:
        if found[i].zone != zone and not found[i].aside:
            away, label, zone = 0, border[i], found[i].zone
        away += 1
        out[i] = (away, label)
        if first[i] is not None and not (found[i].aside and found[i].zone):  # an advert inside an article says nothing of its neighbours
            away, label = 0, first[i]
    return out


_rules: dict[int, Rules] = {}


def _rules_of(stop_words: dict[str, str]) -> Rules:
    key = hash(tuple(stop_words.items()))
    if key not in _rules:
        _rules[key] = Rules(stop_words)
    return _rules[key]


def _pages(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    return pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", stop_words: dict[str, str] = STOP_WORDS) -> DataFrame:
    """(page_id, url, text): the main text of every page."""
    rows = _pages(pages, id_col, url_col, html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = _rules_of(stop_words)
        for batch in batches:
            for part in row_slices(batch, "html"):
                texts = []
                for page in part.column("html"):
                    found = blocks(page.as_py() or "")
                    texts.append("\n".join(b.text for b, label in zip(found, rules.labels(found)[2], strict=True) if label))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    types = dict(rows.dtypes)
    return rows.mapInArrow(run, f"page_id {types['page_id']}, url {types['url']}, text string")


def labelled_blocks(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", stop_words: dict[str, str] = STOP_WORDS) -> DataFrame:
    """Every block with what the rules saw and said: (page_id, block, tag, text, linked, density, first_label, main)."""
    rows = _pages(pages, id_col, url_col, html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = _rules_of(stop_words)
        for batch in batches:
            for part in row_slices(batch, "html"):
                made = []
                for key, page in zip(part.column(0).to_pylist(), part.column("html"), strict=True):
                    found = blocks(page.as_py() or "")
                    for i, (b, d, one, two) in enumerate(zip(found, *rules.labels(found), strict=True)):
                        made.append((key, i, b.tag, b.text, b.linked, d, {True: "text", False: "boilerplate", None: "ambiguous"}[one], two))
                names = ["page_id", "block", "tag", "text", "linked", "density", "first_label", "main"]
                kinds = [part.schema.field(0).type, pa.int32(), pa.string(), pa.string(), pa.int64(), pa.float64(), pa.string(), pa.bool_()]
                columns = zip(*made, strict=True) if made else [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    kind = dict(rows.dtypes)["page_id"]
    return rows.mapInArrow(run, f"page_id {kind}, block int, tag string, text string, linked long, density double, first_label string, main boolean")
