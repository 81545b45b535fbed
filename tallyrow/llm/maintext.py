"""Main text of HTML pages by two passes of block rules.

The page is cut into blocks at block-level tags. The first pass decides what it can from the density of stop words,
the length and the density of links, and from the element a block stands in: menus, headers, footers, sidebars,
notices, adverts, forms and comments are bad, also where they are an ``article`` of their own. Short blocks, and long ones without clear evidence, stay ambiguous. In
the second pass these inherit the label of the nearest decided neighbour of their region, where an ``article`` or
``main`` element is a region of its own; one without any decided block is good inside such an element. Blocks outside
of all regions are judged by the same rules as those inside.

The stop words are of four languages. A page whose long blocks hold few of them is in another one; there long blocks with the marks of sentences are good.
Elements are known as bad by their name or by a class, id or role that is as a whole such a name ("comments", "site-footer", "ad-box-2"). A form
with more text than controls is none, and neither is a bad element around the page's title and four fifths of its text, as long as no article lies outside of it.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrow.llm.base import register, table

SHORT = 70  # characters
MOST_LINKS = 0.5
LEAST_STOP_WORDS = 0.15
LONG = 120  # characters of a block that shows the page's language
TEXT_PER_CONTROL = 140  # characters of good text that a form needs for each of its controls to be no form

STOP_WORDS = frozenset(
    "a an and are as at be but by for from has have he her his i if in is it its not of on or she that the their they this to "
    "was we were what when which who will with you "
    "aber als am auch auf aus bei bin das dass dem den der des die du durch ein eine einen er es fuer für hat ich im ist ja "
    "mit nach nicht noch nur oder sich sie sind so ueber über um und uns von vor war wie wir zu zum zur "
    "au aux avec ce ces dans de du elle en est et eux il je la le les leur lui mais me même mes moi ne nos nous ou par pas "
    "pour qu que qui sa se ses son sur ta te tes toi un une vos vous "
    "al como con del desde donde el ella ellos era esa ese eso esta este esto fue ha hay lo los las más mi muy nada no o para pero "
    "por porque sin sobre su sus también tanto una uno unos y ya".split()
)

#: Elements whose text is no text of the page: code, controls, drawings, and what only browsers without them show.
SILENT = frozenset("script style noscript template svg canvas iframe audio video head title textarea select option button datalist annotation annotation-xml".split())
#: Elements that leave a head open; all others, and text, begin the body.
IN_HEAD = frozenset("html head title meta link base basefont bgsound script style noscript noframes template".split())
#: Raw elements: no tags inside.
RAW = frozenset("script style textarea title noscript iframe template".split())
#: Elements that are never main text.
OUTSIDE = frozenset("nav header footer aside form menu dialog".split())
#: Elements that a reader fills in.
CONTROLS = frozenset("input select textarea button".split())
REGIONS = frozenset(["article", "main"])
#: Elements that end a block.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements whose nesting is followed.
NESTED = BLOCKS - {"p", "hr", "br", "li", "dd", "dt", "tr", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6"} | SILENT | {"span"}
#: Names in class, id or role that mark an element as boilerplate.
MARKS = frozenset(
    "ad ads adv advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments consent contentinfo cookie cookies "
    "disqus footer gdpr header menu modal nav navbar navigation newsletter notice notices popup promo promoted related replies reply "
    "respond search share sharing sidebar social sponsor sponsored subscribe toolbar widget".split()
)
#: What may stand in front of a mark in one name, and behind it.
BEFORE_MARK = frozenset("site global page top bottom left right main primary secondary sticky mobile desktop reader user post article blog third party web my the".split())
BEHIND_MARK = frozenset(
    "area bar block bottom box button buttons col column container content count desktop group icon icons inline inner item items left link links list "
    "main mobile outer panel primary right row secondary section slot small thread title toggle top unit wide wrap wrapper zone".split()
)
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
#: The end of a tag, or an attribute: its name and, behind "=", a quote or a value without quotes.
_ATTRIBUTE = re.compile(r"""[\s/]*+(?:(>)|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:(["'])|[^\s>]*+))?+)""", re.A)
_MARKED = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_LINK = re.compile(r"<(/?)a(?=[\s/>])", re.I)
_SENTENCE = re.compile(r"[.!?\u2026\u0589\u061f\u06d4\u0964\u3002\uff01\uff0e\uff1f](?:\W|$)|[\u3001\u3002\uff0c]")
#: Scripts without blanks between words; a sign counts as three characters.
_DENSE = re.compile(r"[\u0e00-\u0eff\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]")
_EDGE = re.compile(r"^\W+|\W+$")


class Outer:
    """An element that may make what it holds bad."""

    __slots__ = ("form", "controls", "titled", "good")

    def __init__(self, form: bool) -> None:
        self.form = form
        self.controls = 0
        self.titled = False  # holds an h1, a main or an article
        self.good = 0


class Block:
    __slots__ = ("pieces", "linked", "links", "outer", "outside", "region")

    def __init__(self, outer: tuple[Outer, ...], region: int) -> None:
        self.pieces: list[str] = []
        self.linked = 0
        self.links = 0
        self.outer = outer
        self.outside = False
        self.region = region


def _marked(attributes: str) -> bool:
    for name, value in _MARKED.findall(attributes):
        for token in value.strip("\"'").split():
            if token.lower() in MARKS:
                return True
            if name.lower() == "role":
                continue
            parts = [p.lower() for p in _PART.findall(token)]
            marks = [i for i, p in enumerate(parts) if p in MARKS]
            # a mark, with nothing but such words around it
            if marks and BEFORE_MARK.issuperset(parts[: marks[0]]) and all(p in MARKS or p in BEHIND_MARK for p in parts[marks[0] :]):
                return True
    return False


def _tag_end(page: str, at: int, last: dict[str, int], dead: set[int]) -> int:
    """The place of the ">" that ends the tag whose name ends at ``at``; the page's length if it ends first; -1 for an open quote.

    A quoted value of any length may hold ">"; quotes elsewhere than behind "=" are plain characters. ``last`` has the last
    place of each quote, ``dead`` the begins of values from which an open quote is reached: none is followed twice.
    """
    opened = []
    while match := _ATTRIBUTE.match(page, at):
        if match[1]:
            return match.end() - 1
        at = match.end()
        if match[2]:
            opened.append(at)
            if at in dead or at > last[match[2]]:
                dead.update(opened)
                return -1
            at = page.find(match[2], at) + 1
    return len(page)


def blocks(page: str) -> list[Block]:
    """The page's blocks of text in order. Unclosed elements end with the one around them, or with the page."""
    out: list[Block] = []
    stack: list[tuple[str, bool, tuple[Outer, ...], int]] = []  # name, silent, elements that may be bad, region
    none: tuple[bool, tuple[Outer, ...], int] = (False, (), 0)
    silent, outer, region = none
    regions, link = 0, 0  # link 2: one without an end, which ends with its block
    current = Block((), 0)
    at, end = 0, len(page)
    last, dead = {quote: page.rfind(quote) for quote in ("\"", "'", "-->", "--!>")}, set()

    def close() -> None:
        nonlocal current, link
        if current.pieces:
            out.append(current)
        if link == 2:
            link = 0
        current = Block(outer, region)

    while at < end:
        tag = page.find("<", at)
        if tag < 0:
            tag = end
        if tag > at:
            if stack and stack[-1][0] == "head" and not page[at:tag].isspace():
                stack.pop()
                silent, outer, region = stack[-1][1:] if stack else none
            if not silent:
                text = html.unescape(page[at:tag]) if "&" in page[at:tag] else page[at:tag]
                current.pieces.append(text)
                if link:
                    current.linked += len(text.strip())
            at = tag
            if at == end:
                break
        if page.startswith("<!--", at):
            if page.startswith((">", "->"), at + 4):
                at = page.find(">", at) + 1  # an empty comment
                continue
            ends = [page.find(mark, at + 4) + len(mark) for mark in ("-->", "--!>") if last[mark] >= at + 4]
            at = min(ends, default=end)
            continue
        if page.startswith(("<!", "<?"), at):
            behind = page.find(">", at)
            at = end if behind < 0 else behind + 1
            continue
        match = _TAG.match(page, at)
        if match is None:
            if not silent:
                current.pieces.append("<")
            at += 1
            continue
        closing, name = match[1] == "/", match[2].lower()
        behind = page.find(">", match.end())
        if behind < 0:
            break  # the page was cut inside a tag
        if '"' in (attributes := page[match.end() : behind]) or "'" in attributes:
            whole = _tag_end(page, match.end(), last, dead)  # a quoted value may hold ">"; a quote left open may not
            if whole == end:
                break
            behind = behind if whole < 0 else whole
            attributes = page[match.end() : behind]
        at = behind + 1
        if not closing and name not in IN_HEAD and stack and stack[-1][0] == "head":
            stack.pop()
            silent, outer, region = stack[-1][1:] if stack else none
        if name in BLOCKS:
            close()
        elif name == "br":
            current.pieces.append(" ")
        if name == "a":
            following = None if closing else _LINK.search(page, at)
            link = 0 if closing else 1 if following and following[1] else 2
            current.links += not closing
        if outer and not closing:
            if name in CONTROLS and "hidden" not in attributes.lower():
                for element in outer:
                    element.controls += 1
            elif name == "h1" or name in REGIONS:
                for element in outer:
                    element.titled = True
        if name in RAW and not closing:
            behind = re.compile(rf"</{re.escape(name)}\b", re.I).search(page, at)
            if behind is None:
                # without its end a script or style takes the rest of the page
                break
            skip = page.find(">", behind.end())
            at = end if skip < 0 else skip + 1
            continue
        if name not in NESTED:
            continue
        if closing:
            places = [i for i, s in enumerate(stack) if s[0] == name]
            if places:
                del stack[places[-1] :]
        elif not attributes.endswith("/"):
            inner = region
            if name in REGIONS:
                regions += 1
                inner = regions
            bad = name in OUTSIDE or (name not in ("main", "body", "html") and _marked(attributes))
            stack.append((name, silent or name in SILENT, (*outer, Outer(name == "form")) if bad else outer, inner))
        silent, outer, region = stack[-1][1:] if stack else none
        if name in BLOCKS:
            close()
    close()
    return out


def _weight(text: str) -> int:
    """Characters, where a sign of a script without blanks counts as three."""
    return len(text) + 2 * len(_DENSE.findall(text))


def _placed(found: list[tuple[Block, str]], good: list[bool]) -> None:
    """Sets ``outside`` of all blocks, by what the elements around them hold."""
    for (block, text), own in zip(found, good):
        if own:
            for element in block.outer:
                element.good += len(text)
    free = sum(len(text) for (block, text), own in zip(found, good) if own and not block.outer)
    articles = any(own and block.region and not block.outer for (block, _), own in zip(found, good))

    def holds_text(element: Outer) -> bool:
        if element.form and element.good >= TEXT_PER_CONTROL * max(element.controls, 1):
            return True
        return element.titled and not articles and element.good > 4 * free

    for block, _ in found:
        block.outside = not all(map(holds_text, block.outer))


def main_text(page: str) -> str:
    """The main text: good blocks in page order, one line each."""
    found = []
    for block in blocks(page):
        text = " ".join("".join(block.pieces).split())
        if text:
            found.append((block, text))
    weights, links, stops, counts = [], [], [], []
    for block, text in found:
        tokens = [_EDGE.sub("", t).lower() for t in text.split()]
        weights.append(_weight(text))
        links.append(block.linked / len(text))
        stops.append(sum(t in STOP_WORDS for t in tokens))
        counts.append(len(tokens))
    shown = [k for k, w in enumerate(weights) if w >= LONG and links[k] <= MOST_LINKS]
    foreign = sum(stops[k] for k in shown) < LEAST_STOP_WORDS * sum(counts[k] for k in shown)
    good = []
    for k, (_, text) in enumerate(found):
        worded = weights[k] >= SHORT and stops[k] >= LEAST_STOP_WORDS * counts[k]
        good.append(links[k] <= MOST_LINKS and (worded or (foreign and weights[k] >= LONG and _SENTENCE.search(text) is not None)))
    _placed(found, good)
    label: list[bool | None] = []
    for k, (block, _) in enumerate(found):
        linked = links[k] > MOST_LINKS and (block.links > 1 or not block.region)
        worded = weights[k] >= SHORT and stops[k] >= LEAST_STOP_WORDS * counts[k]
        label.append(False if block.outside or linked else True if good[k] or worded else None)
    before = _neighbours(label, found)
    after = _neighbours(label[::-1], found[::-1])[::-1]
    return "\n".join(
        text
        for (block, text), own, b, a in zip(found, label, before, after)
        if (_inherited(block.region, b, a) if own is None else own)
    )


def _neighbours(label: list[bool | None], found: list[tuple[Block, str]]) -> list[tuple[int, bool] | None]:
    """For each block (distance, label) of the decided block of its region that was last seen, reading in order."""
    last: dict[int, int] = {}
    out: list[tuple[int, bool] | None] = []
    for i, (block, _) in enumerate(found):
        at = last.get(block.region)
        out.append(None if at is None else (i - at, bool(label[at])))
        if label[i] is not None and not block.outside:
            last[block.region] = i
    return out


def _inherited(region: int, before: tuple[int, bool] | None, after: tuple[int, bool] | None) -> bool:
    """The label of the nearest decided neighbours."""
    near = [n for n in (before, after) if n is not None]
    if region:
        # the text of an article is left out only between two bad blocks
        return not near or any(good for _, good in near) or len(near) < 2
    if not near:
        return False
    nearest = min(d for d, _ in near)
    return all(good for d, good in near if d == nearest)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row.

    A null or empty page, and one without main text, gives an empty text. Repeated rows are parsed one by one, null ids
    are kept, other columns are ignored.
    """

    def scan(batches):
        for batch in batches:
            texts = [main_text(p) if p else "" for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    id_type = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", F.col("html").cast("string")).mapInArrow(scan, f"page_id {id_type}, url string, text string, n_chars bigint")


@register("op7_main_text")
def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
