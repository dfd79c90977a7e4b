"""Main text of web pages by two-pass block rules (operator 6).

The page is cut into blocks at block-level tags. The first pass decides each block by its own link density, length and
stop-word density; short blocks stay open. Tags, class names and ids are no verdict on a container, only a lean: what
looks like text inside one that is named for a side matter is dropped where the page has its text elsewhere, and kept
where that container holds most of it; for comments, navigation, adverts and consent: where there is nothing else. In the second pass open blocks inherit the label
of the nearest decided neighbours: kept between two kept ones, dropped between two dropped ones, and with unlike
neighbours as the nearer one, or dropped at equal distance; headings go with what follows. The ends of a page count as
dropped. Open blocks of an article look at the article's own blocks only, and are kept unless all those next to
them are dropped; open blocks outside look at blocks outside.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import limit_batches

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    "a about after all an and are as at be been but by can for from had has have he her his i in is it its more not of on or "
    "she so that the their they this to was we were which who will with you "
    "aber als am auch auf aus bei das dass dem den der des die ein eine einem einen einer er es für hat ich im ist mit nach "
    "nicht noch nur sich sie sind und von vor war wie wird zu zum zur "
    "au aux avec ce cette dans de des du elle en est et il je la le les leur lui ne nous on ou par pas plus pour qu que qui "
    "sa se ses son sur un une vous "
    "al como con del el ella en era es esta este ha hay la las lo los más me no o para pero por que se sin su sus también un "
    "una y ya".split()
)
BLOCK_TAGS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose inside is no markup; what doesn't end is skipped only where it is a program.
RAW_TAGS = frozenset("script style textarea template iframe noscript noembed noframes title xmp".split())
#: Elements whose inside is no text. A block-level tag ends them, closed or not.
MUTE_TAGS = frozenset("svg math canvas audio video object map".split())
ARTICLE_TAGS = frozenset(["article", "main"])
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
#: Elements that lean to a side matter; a header does outside an article.
SIDE_TAGS = frozenset("aside button dialog fieldset footer form head menu nav optgroup option select".split())
#: Words of class names, ids and roles that lean to a side matter. Those of the first two lines name readers' comments and
#: what never is a page's text: navigation, consent and adverts.
COMMENT_NAMES = frozenset("comment comments commentlist discussion disqus replies reply respond responses".split())
NEVER_NAMES = COMMENT_NAMES | frozenset("ad ads adv advert adverts advertisement breadcrumb breadcrumbs consent cookie cookies gdpr menu menubar nav navbar navigation".split())
SIDE_NAMES = NEVER_NAMES | frozenset(
    "alert alertdialog banner captcha complementary contentinfo copyright dialog disclaimer feedback footer form header legal "
    "login masthead modal newsletter notice notification overlay pager pagination popup popular promo promoted promotion "
    "recommended related search share sharing sidebar signup skip social sponsor sponsored subscribe subscription teaser "
    "toolbar tracking warning widget".split()
)
#: Words beside these that take the lean away: of something that only has, or lacks, a side matter.
HAS_NAMES = frozenset("has no with without".split())
MAX_LINK_DENSITY, SHORT, LONG = 0.5, 70, 200
STOP_HIGH, STOP_LOW = 0.2, 0.1
#: A page whose long blocks have a smaller share of stop words is in a language that the list doesn't know.
KNOWN_LANGUAGE = 0.15
#: A character of a script without blanks between words counts as so many.
WIDE = 3

_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_WORD = re.compile(r"\w+")
_WIDE_SCRIPT = re.compile("[฀-໿က-႟ក-៿぀-ヿ㐀-鿿豈-﫿]")
_TAG_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|\b(hidden)\b")


class _Markup:
    """Tags of a page, one after the other; every step goes on from where the last one ended."""

    def __init__(self, page: str):
        self.page, self.quotes, self.endless = page, True, set()
        self.last = {c: page.rfind(c) for c in ">\"'"}

    def tag_end(self, at: int) -> int:
        """Place of the > that ends the tag which ``at`` lies in; -1 if there is none."""
        if at > self.last[">"]:
            return -1
        start = at
        while self.quotes:
            end = self.page.find(">", at)
            equal = self.page.find("=", at, end if end >= 0 else len(self.page))
            if end >= 0 and equal < 0:
                return end
            if end < 0:
                self.quotes = False  # all later > lie in quotes that are never closed: from here on quotes don't count
                break
            at = equal + 1
            while at < end and self.page[at].isspace():
                at += 1
            quote = self.page[at]
            if quote in "\"'" and at < self.last[quote]:
                at = self.page.find(quote, at + 1) + 1
        return self.page.find(">", start)

    def raw_end(self, tag: str, at: int) -> int | None:
        """Place behind the end tag of a raw element; None if it doesn't end."""
        if tag in self.endless:
            return None
        found = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(self.page, at)
        if found is None:
            self.endless.add(tag)
        return found.end() if found else None


def _lean(tag: str, attributes: str, in_article: bool) -> int:
    """0 none, 1 side matter, 2 what counts only where a page has nothing else: comments, navigation, adverts, consent, hidden parts."""
    out = int(tag in SIDE_TAGS or tag == "header" and not in_article)
    if tag in ("html", "body") or not attributes.strip():
        return out
    for name, *values, hidden in _ATTRIBUTE.findall(attributes):
        value, name = "".join(values), name.lower()
        if hidden or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return 2
        if name not in ("class", "id", "role"):
            continue
        for whole in value.split():
            words = {x.lower() for x in _NAME.findall(whole)}
            if words & HAS_NAMES or words == {"header"} and in_article:
                continue
            if words & NEVER_NAMES and tag not in ARTICLE_TAGS or words & COMMENT_NAMES or words == {"hidden"}:
                return 2
            if words & SIDE_NAMES and tag not in ARTICLE_TAGS and not (in_article and "header" in words):
                out = 1
    return out


class Block:
    """Text between two block-level tags, its share in links, its containers that lean to a side, whether in an article."""

    __slots__ = ("parts", "linked", "side", "article", "heading", "text", "links", "size", "stops", "label")

    def __init__(self):
        self.parts, self.linked, self.side, self.article, self.heading = [], 0, -1, False, False


def blocks(page: str) -> tuple[list[Block], list[tuple[int, int]]]:
    """The blocks with text; and of each container with a lean the lean and the number of the next one around it.

    A block names the innermost of its containers with a lean, or -1.
    """
    out, leans, stack, open_at, block = [], [], [], {}, Block()
    # Numbers of the stack's entries: articles, those that end a paragraph's inline elements, mute ones.
    articles, outer, mute, side, link, at = [], [], [], -1, 0, 0
    markup, length = _Markup(page), len(page)

    def flush():
        nonlocal block
        block.text = " ".join("".join(block.parts).split())
        if block.text:
            block.links = min(1.0, block.linked / len(block.text))
            block.size = len(block.text) + (WIDE - 1) * len(_WIDE_SCRIPT.findall(block.text))
            words = _WORD.findall(block.text.lower())
            block.stops = (sum(w in STOP_WORDS for w in words), len(words))
            out.append(block)
        block = Block()

    def add(raw: str):
        if mute:
            return
        text = html.unescape(raw)
        block.parts.append(text)
        if text.strip():
            block.side, block.article = side if side >= 0 else block.side, block.article or bool(articles)
            block.heading = block.heading or bool(outer) and stack[outer[-1]][0] in HEADINGS
            if link:
                block.linked += len(" ".join(text.split()))

    def pop(to: int):
        nonlocal side, link
        while len(stack) > to:
            tag, before = stack.pop()
            side = before
            open_at[tag].pop()
            link -= tag == "a"
            for numbers in (articles, outer, mute):
                if numbers and numbers[-1] == len(stack):
                    numbers.pop()

    def innermost(tag: str) -> int:
        return open_at[tag][-1] if open_at.get(tag) else -1

    while at < length:
        start = page.find("<", at)
        if start < 0:
            break
        if start > at:
            add(page[at:start])
        at = start
        if page.startswith("<!--", at):
            end = page.find("-->", at + 2)
            at = end + 3 if end >= 0 else length
            continue
        found = _TAG_NAME.match(page, at + 1)
        if found is None:
            if page[at + 1 : at + 2] in ("!", "?", "/"):
                end = page.find(">", at)
                at = end + 1 if end >= 0 else length
            else:
                add("<")
                at += 1
            continue
        end = markup.tag_end(found.end())
        if end < 0:
            at = length
            break
        tag, attributes, closing, at = found[1].lower(), page[found.end() : end], page[at + 1] == "/", end + 1
        if tag in BLOCK_TAGS:
            if mute:
                pop(mute[0])
            flush()
        if tag == "br":
            block.parts.append(" ")
        if closing:
            k = innermost(tag)
            if k >= 0 and (not articles or k >= articles[-1] or tag in ("body", "html", "article", "main")):
                pop(k)
            continue
        if tag in RAW_TAGS and not attributes.rstrip().endswith("/"):
            end = markup.raw_end(tag, at)
            if end is not None or tag in ("script", "style"):
                at = end if end is not None else length
            block.parts.append(" ")
            continue
        if tag in VOID_TAGS:
            continue
        if tag in BLOCK_TAGS and outer and (stack[outer[-1]][0] == "p" or stack[outer[-1]][0] in HEADINGS and (tag == "p" or tag in HEADINGS)):
            pop(outer[-1])
        if tag in ("li", "dt", "dd", "option", "tr", "td", "th"):
            k = innermost(tag)
            if k > max(map(innermost, ("ul", "ol", "dl", "menu", "select", "table"))):
                pop(k)
        if tag == "a" and innermost("a") >= 0 and (not outer or innermost("a") > outer[-1]):
            pop(innermost("a"))
        own = _lean(tag, attributes, bool(articles))
        open_at.setdefault(tag, []).append(len(stack))
        if tag in ARTICLE_TAGS:
            articles.append(len(stack))
        if tag in BLOCK_TAGS:
            outer.append(len(stack))
        if tag in MUTE_TAGS and not attributes.rstrip().endswith("/"):
            mute.append(len(stack))
        stack.append((tag, side))
        link += tag == "a"
        if own:
            leans.append((own, side))
            side = len(leans) - 1
    if at < length:
        add(page[at:])
    flush()
    return out, leans


def _looks_like_text(b: Block, known: bool) -> int:
    """1 text, 0 none, -1 open, by link density, length and stop-word density alone."""
    if b.links > MAX_LINK_DENSITY or b.size < SHORT and 3 * b.links > 1:
        return 0
    if b.size < SHORT:
        return -1
    stops = b.stops[0] / max(1, b.stops[1])
    least = STOP_LOW if b.article or b.size >= LONG else STOP_HIGH
    return 1 if not known or stops >= least else -1


def _main_containers(found: list[Block], leans: list[tuple[int, int]]) -> list[bool]:
    """For each container with a lean whether it and those around it count as the page's main ones.

    One is when it holds more than twice as much text as stands outside all such containers; for comments, navigation,
    adverts, consent and hidden parts: when there is nothing else. Where an article has anything of its own, only containers inside it can be.
    """
    clear = [False] * len(leans)
    if any(b.article and b.side < 0 and b.label for b in found):
        found = [b for b in found if b.article]
    bare = not any(b.side < 0 and b.label for b in found)
    text = [b for b in found if b.label == 1 or b.article and b.label]
    plain, own = sum(b.size for b in text if b.side < 0), [0] * len(leans)
    for b in text:
        if b.side >= 0:
            own[b.side] += b.size
    held = list(own)
    for k in range(len(leans) - 1, -1, -1):
        if leans[k][1] >= 0:
            held[leans[k][1]] += held[k]
    for k in sorted(range(len(leans)), key=lambda k: -held[k]):  # outer ones come before those inside
        lean, around = leans[k]
        if held[k] and (around < 0 or clear[around]) and held[k] > 2 * plain and (lean == 1 or bare and not plain):
            clear[k] = True
            plain += own[k]
    return clear


def first_pass(found: list[Block], leans: list[tuple[int, int]]) -> None:
    """Labels of all blocks: 1 kept, 0 dropped, -1 open."""
    prose = [b.stops for b in found if b.size >= LONG and b.links <= MAX_LINK_DENSITY]
    known = not prose or sum(s for s, _ in prose) >= KNOWN_LANGUAGE * sum(n for _, n in prose)
    for b in found:
        b.label = _looks_like_text(b, known)
    clear = _main_containers(found, leans)
    for b in found:
        if b.side >= 0 and not clear[b.side]:
            b.label = 0


def _nearest(labels: list[int], k: int, near: list[int], ends: tuple[int, int]) -> int:
    place = bisect_left(near, k)
    around = [(k - near[place - 1], labels[near[place - 1]])] if place else [(k - ends[0], 0)]
    around.append((near[place] - k, labels[near[place]]) if place < len(near) else (ends[1] - k, 0))
    least = min(d for d, _ in around)
    return min(x for d, x in around if d == least)


def second_pass(found: list[Block]) -> list[int]:
    """Final labels: open blocks inherit."""
    labels = [b.label for b in found]
    final = list(labels)
    inside = [k for k, b in enumerate(found) if b.label >= 0 and b.article and b.side < 0]
    outside = [k for k, b in enumerate(found) if b.label >= 0 and not (b.article and b.side < 0)]
    for k, b in enumerate(found):
        if b.label >= 0:
            continue
        if b.article:
            place = bisect_left(inside, k)
            final[k] = max((labels[y] for y in inside[max(0, place - 1) : place + 1]), default=1)
        elif b.heading:
            place = bisect_left(outside, k)
            final[k] = labels[outside[place]] if place < len(outside) else 0
        else:
            final[k] = _nearest(labels, k, outside, (-1, len(found)))
    return final


def main_text(page: str) -> str:
    """Kept blocks in page order, joined by a line feed; empty if there are none."""
    found, leans = blocks(page)
    first_pass(found, leans)
    return "\n".join(b.text for b, x in zip(found, second_pass(found)) if x == 1)


def extract_pages(pages: DataFrame) -> DataFrame:
    """``pages(page_id, url, html)`` to page_id, url, text, n_chars (code points), one row for each input row.

    Null and empty pages, and pages without a kept block, give an empty text. Null ids and urls stay null; other
    columns are left out. Nothing is cut off: pages of any length are read whole, broken markup included, in time
    that grows with their length. An empty table gives no rows.
    """
    limit_batches(pages.sparkSession)
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x or "") for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, type=pa.string()), pa.array([len(x) for x in texts], type=pa.int64())], schema=schema)

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
