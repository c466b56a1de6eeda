"""Main text of web pages by two passes over blocks.

A page is cut into blocks at block-level tags. Menus, headers, footers,
sidebars, forms, comments and notices, known by element, class or id, are out.
The first pass classifies every other block by link density, stop-word density
and length, with a vote for text inside the page's article and one against text
outside of it: good, bad, or undecided for short blocks and for those whose
votes cancel out. In the second pass an undecided block inherits the label of
its nearest decided neighbours: their label if they agree, the nearer one's
where they differ, good if they are equally near or none is decided. Blocks
that are out say nothing about their neighbours and are passed over.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import as_bytes, blocks

# Elements whose content is no text, that end a block, and that hold site furniture.
SILENT = frozenset("script style noscript template svg iframe object head title select textarea button canvas audio video math".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset"
    " h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul br".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose end tag may be left out: what opening one closes, and where the search for it ends.
_LIST, _TABLE = frozenset("ul ol menu".split()), frozenset(("table",))
IMPLIED = {
    "p": (frozenset(("p",)), None),
    "li": (frozenset(("li",)), _LIST),
    **dict.fromkeys(("dt", "dd"), (frozenset(("dt", "dd")), frozenset(("dl",)))),
    **dict.fromkeys(("td", "th"), (frozenset(("td", "th")), _TABLE | {"tr"})),
    "tr": (frozenset(("tr",)), _TABLE),
    **dict.fromkeys(("tbody", "thead", "tfoot"), (frozenset(("tbody", "thead", "tfoot")), _TABLE)),
    "option": (frozenset(("option",)), frozenset(("optgroup", "datalist"))),
}
FURNITURE = frozenset("nav header footer aside form menu dialog".split())
# Words in class or id names that mark site furniture.
FURNITURE_NAME = re.compile(
    r"(?:^|[-_\s])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner\w*|cookies?|consent|notices?|gdpr|sidebar\w*|nav\w*|menu\w*|breadcrumb\w*|footer\w*|header\w*|masthead"
    r"|comments?|disqus|replies|share\w*|social\w*|related|recommend\w*|newsletter|subscribe|signup|login|popup|modal|widget\w*|pagination|pager|toolbar|copyright)(?:$|[-_\s])",
    re.IGNORECASE,
)
COMMENT_NAME = re.compile(r"(?:^|[-_\s])(?:comments?|reply|replies|disqus)(?:$|[-_\s])", re.IGNORECASE)
ARTICLE = frozenset(("article", "main"))
# Frequent function words of the languages that occur.
STOP_WORDS = frozenset(
    "the of and to in a is that it for on was with as be by at are this from or an which not have but had his they you were their one all we her she he"
    " der die das und ist von zu den mit sich auf für im nicht ein eine als auch es an dem des er sie war wird bei aus nach"
    " le la les de des et en un une du que qui est dans pour par sur au aux avec pas ce il elle ne se son plus"
    " el los las y o que en del se con por para una su al lo como más pero sus es no".split()
)
#: Link density above BAD_LINKS is bad, above SOME_LINKS a vote against; SHORT characters or less are undecided, LONG or more a vote for;
#: a stop-word density of HIGH_STOP or more is a vote for, in a long block one below LOW_STOP two against, on pages that reach LOW_STOP as a whole.
BAD_LINKS, SOME_LINKS, SHORT, LONG, LOW_STOP, HIGH_STOP = 0.35, 0.2, 70, 200, 0.02, 0.10

_TAG = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>")
#: A tag whose quotes don't close ends at the first bracket.
_LOOSE_TAG = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)([^>]*+)>")
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NOT_SHOWN = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.IGNORECASE)


def hidden(attributes: str) -> bool:
    """Whether an element is not shown: hidden as an attribute's own name, aria-hidden=true, or display:none as a style."""
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), next(filter(None, values), "")
        if name == "hidden" or name == "aria-hidden" and value.strip().lower() == "true" or name == "style" and _NOT_SHOWN.search(value):
            return True
    return False


def page_blocks(page: str) -> list[tuple[str, float, bool, bool, bool]]:
    """(text, share of characters in links, whether in site furniture, in a heading, in an article) of each block.

    A class or id marks no element that holds the first article or main element
    outside of furniture, or most of the page's text.
    """
    out: list[tuple[str, float, bool, bool, bool]] = []
    stack: list[tuple[str, bool, bool]] = []
    # Elements marked by class or id: the marked element around each, characters of text in it, whether it must not count; 0 is the page.
    around, held, void, named, of_block = [0], [0], [True], 0, []
    first_article = True
    opened: Counter[str] = Counter()
    text: list[str] = []
    linked = furniture = links = articles = 0
    heading = no_head_end = False
    last = page.rfind(">")

    def close() -> None:
        nonlocal linked, heading
        clean = " ".join("".join(text).split())
        if clean:
            of_block.append(named)
            held[named] += 0 if furniture else len(clean)
            out.append((clean, min(1.0, linked / len(clean)), furniture > 0, heading, articles > 0))
        text.clear()
        linked, heading = 0, any(n in ("h1", "h2", "h3", "h4", "h5", "h6") for n, *_ in stack[-3:])

    def say(raw: str) -> None:
        nonlocal linked
        if not raw:
            return
        said = html.unescape(raw) if "&" in raw else raw
        text.append(said)
        if links:
            linked += len(said.strip())

    def pop() -> str:
        nonlocal furniture, links, articles, named
        top, marked, by_name = stack.pop()
        opened[top] -= 1
        if by_name:
            named = around[named]
        furniture -= marked
        links -= top == "a"
        articles -= top in ARTICLE
        return top

    def imply(name: str) -> None:
        """Close the open predecessor of an element whose end tag was left out."""
        ends, scope = IMPLIED[name]
        if not any(opened[x] for x in ends):
            return
        if scope is None:
            if stack[-1][0] in ends:
                pop()
            return
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in ends:
                while len(stack) > k:
                    pop()
                return
            if stack[k][0] in scope:
                return

    at = start = 0
    while (start := page.find("<", start)) >= 0:
        # Markup that is not text: comments, sections, declarations. What does not close goes on to the end.
        if page.startswith("<!--", start):
            say(page[at:start])
            at = start = page.find("-->", start + 4) + 3 if page.find("-->", start + 4) >= 0 else len(page)
            continue
        if page.startswith("<![CDATA[", start):
            say(page[at:start])
            end = page.find("]]>", start)
            say(page[start + 9 : end if end >= 0 else len(page)])
            at = start = end + 3 if end >= 0 else len(page)
            continue
        # No tag can start behind the last bracket, so what is left is looked at once.
        if start > last:
            break
        if page[start + 1] in "!?":
            say(page[at:start])
            at = start = page.find(">", start) + 1
            continue
        found = _TAG.match(page, start) or _LOOSE_TAG.match(page, start)
        if not found:
            start += 1
            continue
        say(page[at:start])
        at = start = found.end()
        name, closing = found[1].lower(), found[0][1] == "/"
        if name in SILENT and not closing and not found[0].endswith("/>"):
            end = None if name == "head" and no_head_end else re.compile(rf"</{name}\s*>", re.IGNORECASE).search(page, at)
            # Without its end tag, head ends where body starts; another element ends with the page.
            if not end and name == "head":
                no_head_end = True
                continue
            at = start = end.end() if end else len(page)
            if name in ("title", "head"):
                close()
            continue
        if name in BLOCK:
            close()
        if name in VOID:
            continue
        if not closing:
            if found[0].endswith("/>"):
                continue
            if name in IMPLIED:
                imply(name)
            attributes = found[2] or ""
            marked = name in FURNITURE or (name not in ("html", "body") and bool(attributes) and hidden(attributes))
            by_name = not marked and name not in ("html", "body") and any((COMMENT_NAME if name in ARTICLE else FURNITURE_NAME).search(next(filter(None, x), "")) for x in _NAMES.findall(attributes))
            if name == "header" and opened["article"]:
                marked = by_name = False
            if name in ARTICLE and first_article and not (marked or by_name or furniture):
                void[named], first_article = True, False
            if by_name:
                around.append(named)
                held.append(0)
                void.append(False)
                named = len(around) - 1
            stack.append((name, marked, by_name))
            opened[name] += 1
            furniture += marked
            links += name == "a"
            articles += name in ARTICLE
        elif opened[name]:
            while pop() != name:
                pass
        if name in ("h1", "h2", "h3", "h4", "h5", "h6"):
            heading = not closing
    if at < len(page):
        say(page[at:])
    close()
    for k in range(len(around) - 1, 0, -1):
        held[around[k]] += held[k]
        void[around[k]] |= void[k]
    inside = [False] * len(around)
    for k in range(1, len(around)):
        inside[k] = inside[around[k]] or not (void[k] or 2 * held[k] > held[0])
    return [(t, share, out_of_place or inside[k], *rest) for (t, share, out_of_place, *rest), k in zip(out, of_block, strict=True)]


def stop_share(text: str) -> float:
    words = text.lower().split()
    return sum(w.strip(".,;:!?") in STOP_WORDS for w in words) / len(words)


def first_pass(text: str, link_share: float, furniture: bool, heading: bool, article: bool, has_article: bool, stop: float | None) -> str:
    """good, bad, out (by its place alone), or near (undecided). stop: the block's stop-word density; None where the page's language has no list."""
    if furniture:
        return "out"
    if link_share > BAD_LINKS:
        return "bad"
    outside = has_article and not article
    if heading or len(text) <= SHORT:
        return "out" if outside and not heading else "near"
    votes = (len(text) >= LONG) - (link_share > SOME_LINKS) + article - 2 * outside
    if stop is not None:
        votes += (stop >= HIGH_STOP) - 2 * (stop < LOW_STOP and len(text) >= LONG)
    if votes < 0:
        return "out" if outside and votes + 2 >= 0 else "bad"
    return "good" if votes else "near"


def main_text(page: str) -> str:
    """The article's blocks, joined by an empty line; empty if there are none."""
    found = page_blocks(page)
    has_article = any(b[4] and not b[2] and b[1] <= BAD_LINKS for b in found)
    stops = [0.0 if b[2] else stop_share(b[0]) for b in found]
    own = [len(b[0]) * (not b[2]) for b in found]
    known = sum(x * n for x, n in zip(stops, own, strict=True)) >= LOW_STOP * sum(own)
    labels = [first_pass(*b, has_article, x if known else None) for b, x in zip(found, stops, strict=True)]
    after: list[tuple[str, int] | None] = [None] * len(labels)
    nearest = None
    for i in range(len(labels) - 1, -1, -1):
        after[i] = nearest
        if labels[i] in ("good", "bad"):
            nearest = (labels[i], i)
    before, kept = None, []
    for i, label in enumerate(labels):
        if label in ("good", "bad"):
            before = (label, i)
        elif label == "near":
            sides = [x for x in (before, after[i]) if x]
            if len({x[0] for x in sides}) < 2:
                label = sides[0][0] if sides else "good"
            else:
                label = "good" if i - before[1] == after[i][1] - i else min(sides, key=lambda x: abs(x[1] - i))[0]
        if label == "good":
            kept.append(found[i][0])
    return "\n\n".join(kept)


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each page.

    Null and empty html give an empty text. Repeated rows give repeated
    results; null keys and urls stay null; other columns are not read.
    """

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "html"):
            texts = [main_text(x.decode()) for x in as_bytes(block.column("html"))]
            yield pa.RecordBatch.from_arrays(
                [block.column("page_id").cast(pa.int64()), block.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return pages.select("page_id", "url", "html").mapInArrow(extract, "page_id long, url string, text string, n_chars long")
