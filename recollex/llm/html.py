"""Main text of web pages by two-pass block rules.

The page is cut into blocks at block-level tags.  Pass one decides blocks by where they stand (inside scripts,
menus, footers, forms, adverts, reader comments and the like), by link density, by length in words and by
stop-word density.  Where text stands is looked at as it is read: a button or a marked span inside a paragraph goes
alone.  What is too short or too unlike prose to be decided waits for pass two, which gives it the
label of the nearest decided neighbour; between two at the same distance content wins.  On a page that marks
its article (article, main, role=main), blocks outside of it are furniture, and those in it that nothing decides
count as content.  A class or id names a box of furniture if one of its words is among STRONG, or if one is among HINTS and the others
only say what kind of box it is: ``hidden`` and ``share-buttons`` do, ``hidden-gems`` and ``share-price`` do not, and density decides
there.  One of DOUBTFUL words (promotion, related, social) makes furniture too, but in a marked article long prose without links stays.

Cases: a null or empty page gives the empty text; unclosed and misnested tags close at the next tag that implies
it; a page that is cut off ends its open blocks; a script or style that nothing closes ends the page, of other
elements without text (svg, object, iframe and the like) only the tag is skipped then, and a self-closed svg or math is
empty; very long pages are read in one linear pass; equal pages have equal texts; an empty table gives no rows; other columns are kept by
``extract_pages``, but for those that it adds, which replace columns of the same name.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from recollex.session import small_batches, table

#: Common words of the four languages of the pages.
STOP_WORDS = frozenset(
    """
    a an and are as at be by for from has have he in is it not of on or she that the they this to was were which will with you
    aber als am auf aus bei das dem den der des die ein eine einer er es für ich im ist mit nicht sich sie sind und von war wie zu zum zur
    au aux avec ce ces dans de des du elle en est et il je la le les leur mais ne nous par pas plus pour que qui sa se ses son sur un une vous
    al como con del el ella ellos en era es esta este fue ha hay las lo los más no para pero por que se si sin su sus un una y ya
    """.split()
)
#: Elements that begin and end blocks.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
#: Elements whose content is no text of the page.
RAW = frozenset("script style template noscript iframe object textarea svg math canvas video audio title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE = frozenset("nav footer aside form head header button select menu dialog search".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of a class or id that name furniture in any compound.
STRONG = frozenset(
    """
    adsense advert adverts advertisement advertising sponsored sidebar submenu navbar breadcrumb breadcrumbs masthead topbar cookies
    gdpr popup modal newsletter signup signin comments commentlist disqus toolbar pagination pager
    """.split()
)
#: Words that name it alone, or beside words for boxes.
HINTS = frozenset("ad ads sponsor promo aside menu nav navigation footer cookie consent notice notices notification subscribe login share sharing comment respond reply replies hidden".split())
#: Words for boxes, which say nothing of what is in them.
BOXES = frozenset(
    """
    area banner bar block body bottom box btn button buttons card col column container content div el fixed float form global group header icon
    icons id inline inner item items js label left link links list main message mobile module outer page panel post primary right row secondary
    section site slot small sticky text thread top unit user wrap wrapper widget
    """.split()
)
#: As likely the subject of an article as the name of a box beside it.
DOUBTFUL = frozenset("promotion banner overlay subscription social related recommended recommendations discussion widget copyright disclaimer form search".split())
#: Where text stands: in the page, in a box of doubtful name, in furniture.
OPEN, DOUBT, CLOSED = range(3)
#: A tag of these closes open elements of those, up to the nearest list, table or block that holds them.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
CONTAINERS = frozenset("table ul ol dl menu body article main section nav aside footer header div form blockquote".split())

LONG_WORDS, SHORT_WORDS, PROSE, LINKED = 25, 6, 0.12, 0.5

_QUOTE = re.compile("=\\s*([\"'])")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_WORD = re.compile(r"[^\W\d_]+")
#: Words of one name of a class or id: share-bar, shareBar and SHARE_BAR have the same.
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


@dataclass
class Block:
    text: str
    place: int
    main: bool
    heading: bool
    linked: int
    label: bool | None = None


def _tag_end(page: str, at: int) -> int:
    """Place after the > that ends the tag begun before ``at``; quotes are honoured where they close."""
    while True:
        close = page.find(">", at)
        if close < 0:
            return len(page)
        quote = _QUOTE.search(page, at, close)
        if quote is None:
            return close + 1
        end = page.find(quote[1], quote.end())
        if end < 0:
            return close + 1
        at = end + 1


def _self_closed(attributes: str) -> bool:
    """Whether a tag ends in a slash that is no part of an unquoted value."""
    last = attributes[-256:].split()[-1:]
    return bool(last) and last[0].endswith("/") and ("=" not in last[0] or last[0].endswith(("\"/", "'/")))


def _attributes(raw: str) -> dict[str, str]:
    return {k.lower(): (v or "").strip("\"'") for k, v in _ATTRIBUTE.findall(raw)} if raw.strip() else {}


def _place(name: str, found: dict[str, str], in_main: bool) -> int:
    """Where the text of an element stands by its name and attributes."""
    if name == "header" and in_main:
        return OPEN
    if name in FURNITURE:
        return CLOSED
    if not found or name in ("body", "html", "article", "main"):
        return OPEN
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or found.get("role", "").lower() in ROLES or re.search(r"display\s*:\s*none", found.get("style", "").lower()):
        return CLOSED
    where = OPEN
    for one in f"{found.get('class', '')} {found.get('id', '')}".split():
        words = {x.lower() for x in _PART.findall(one)}
        known = words <= HINTS | DOUBTFUL | BOXES
        if words & STRONG or (known and words & HINTS) or ("header" in words and not in_main):
            return CLOSED
        if known and words & DOUBTFUL:
            where = DOUBT
    return where


def blocks(page: str) -> list[Block]:
    """The page's blocks of text in order, white space folded, references decoded."""
    out: list[Block] = []
    stack: list[tuple[str, int, bool, bool]] = []  # name; place, main, link: its own or of what holds it
    parts: list[tuple[str, int]] = []
    state = [OPEN, False, False]  # of the top of the stack
    heading, linked, at, n = False, 0, 0, len(page)
    opened: Counter[str] = Counter()  # how often each name is on the stack, which is searched only for what is there
    endless: set[str] = set()  # names that nothing closes in the rest of the page

    def flush() -> None:
        nonlocal heading, linked
        # furniture inside a block goes; a block with nothing else is furniture, and keeps its place among the others
        shown = " ".join("".join(t if where != CLOSED else " " for t, where in parts).split())
        if shown:
            out.append(Block(shown, max(where for t, where in parts if where != CLOSED and t.strip()), state[1], heading, linked))
        elif text := " ".join("".join(t for t, _ in parts).split()):
            out.append(Block(text, CLOSED, state[1], heading, linked))
        parts.clear()
        heading, linked = False, 0

    def cut(k: int) -> None:
        """Ends the elements from place ``k`` of the stack on."""
        opened.subtract(x[0] for x in stack[k:])
        del stack[k:]
        look()

    def look() -> None:
        state[:] = stack[-1][1:] if stack else (OPEN, False, False)

    def words(raw: str) -> None:
        nonlocal linked
        text = entities.unescape(raw) if "&" in raw else raw
        if state[2] and state[0] != CLOSED:
            linked += len(text.strip())
        parts.append((text, state[0]))

    while at < n:
        open_ = page.find("<", at)
        if open_ < 0:
            words(page[at:])
            break
        if open_ > at:
            words(page[at:open_])
        if page.startswith("<!--", open_):
            end = page.find("-->", open_ + 4)
            at = n if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), open_):
            end = page.find(">", open_)
            at = n if end < 0 else end + 1
            continue
        closing = page.startswith("</", open_)
        m = _NAME.match(page, open_ + 1 + closing)
        if m is None:
            parts.append(("<", state[0]))
            at = open_ + 1
            continue
        name, at = m[0].lower(), _tag_end(page, m.end())
        if name == "br":
            parts.append((" ", state[0]))
            continue
        if name in BLOCKS:
            flush()
        if closing:
            for k in range(len(stack) - 1, -1, -1) if opened[name] else ():
                if stack[k][0] == name:
                    cut(k)
                    break
                if name not in BLOCKS and stack[k][0] in BLOCKS:
                    break
        elif name in RAW:
            if name in ("svg", "math") and _self_closed(page[m.end() : at - 1]):
                continue
            end = None if name in endless else re.compile(f"</{name}", re.IGNORECASE).search(page, at)
            if end is not None:
                at = _tag_end(page, end.end())
            elif name in ("script", "style"):
                at = n
            else:
                endless.add(name)
        elif name not in VOID:
            ends = CLOSES.get(name, ())
            for k in range(len(stack) - 1, -1, -1) if any(opened[x] for x in ends) else ():
                if stack[k][0] in ends:
                    cut(k)
                    break
                if stack[k][0] in CONTAINERS:
                    break
            attributes = _attributes(page[m.end() : at - 1])
            is_main = name in ("article", "main") or attributes.get("role", "").lower() == "main"
            stack.append((name, max(state[0], _place(name, attributes, state[1])), state[1] or is_main, state[2] or name == "a"))
            opened[name] += 1
            look()
            heading = heading or bool(re.fullmatch("h[1-6]", name))
    flush()
    return out


def label(found: list[Block]) -> None:
    """Both passes; afterwards every label is True (content) or False."""
    marked = any(b.main and b.place != CLOSED for b in found)
    for b in found:
        w = _WORD.findall(b.text.lower())
        prose = sum(x in STOP_WORDS for x in w) / max(len(w), 1)
        links = b.linked / max(len(b.text), 1)
        if b.place == CLOSED or (marked and not b.main):
            b.label = False
        elif b.place == DOUBT:
            b.label = marked and links == 0 and len(w) >= LONG_WORDS and prose >= PROSE
        elif links > LINKED:
            b.label = None if marked else False
        elif len(w) >= LONG_WORDS or (len(w) >= SHORT_WORDS and prose >= PROSE):
            b.label = True
    scope = [b for b in found if b.main] if marked else found
    undecided = [i for i, b in enumerate(scope) if b.label is None]
    before, after, last = {}, {}, None
    decided = [i for i, b in enumerate(scope) if b.label is not None and b.place == OPEN]
    for seq, to in ((range(len(scope)), before), (range(len(scope) - 1, -1, -1), after)):
        last, known = None, set(decided)
        for i in seq:
            if i in known:
                last = i
            else:
                to[i] = last
    for i in undecided:
        near = [(abs(i - k), not scope[k].label) for k in (before[i], after[i]) if k is not None]
        scope[i].label = not min(near)[1] if near else True


def extract(page: str | None) -> str:
    if not page:
        return ""
    found = blocks(page)
    label(found)
    return "\n".join(b.text for b in found if b.label)


def extract_pages(pages: DataFrame, html: str = "html", drop_html: bool = False) -> DataFrame:
    """Adds text and n_chars (code points).  One pass, no shuffle."""
    added = [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]
    kept = [f for f in pages.schema if f.name not in ("text", "n_chars") and not (drop_html and f.name == html)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(v.as_py()) for v in batch.column(html)]
            yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in kept] + [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[f.name for f in (*kept, *added)])

    return pages.mapInArrow(run, T.StructType([*kept, *added]))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return extract_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"), drop_html=True)
