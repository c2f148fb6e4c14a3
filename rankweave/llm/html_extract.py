"""HTML extraction: two-pass block rules.

A tolerant scanner cuts a page into blocks at block-level tags, leaving out what lies in scripts, styles, heads, comments and
containers that are never main text (navigation, header, footer, aside, form, or a class or id that names adverts,
notices, menus, sidebars or reader comments). Pass one classifies each block by its length, link density and stop-word
density as good, bad, short or near-good. Pass two gives short and near-good blocks the label of
their nearest decided neighbours: between two neighbours of one label, that label; between different ones, the nearer one's
(a tie goes to bad, unless the block is near-good; an undecided heading goes with the block after it). Where a page names its main element (article or main),
blocks outside it are left out, and inside it length or stop words alone make a block good. A class or id counts by whole words; if every block of a page is in containers
that only a class or id leaves out (reader comments aside), their good blocks count.

Defined results: null or empty html, or a page without main text, gives an empty text and n_chars 0. Character
references are decoded once. White space inside a block becomes one space; blocks are joined in page order by one space. Unclosed and
misnested tags never fail: an open container ends with its parent, or at the page's end. Repeated rows give equal rows.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from rankweave.llm.common import bound_batches, texts_of

# Element names by role.
BLOCK_TAGS = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav noscript ol option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split())
RAW_TAGS = frozenset("script style noscript template iframe svg math textarea title object canvas audio video xmp noembed noframes".split())
# Raw elements that hold nothing but text, and those in which a slash closes a tag.
TEXT_TAGS = frozenset("script style textarea title iframe xmp noembed noframes noscript".split())
FOREIGN_TAGS = frozenset("svg math".split())
DROPPED_TAGS = frozenset("nav header footer aside form head menu dialog button select option fieldset label input".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSED_BY = {
    "p": BLOCK_TAGS - {"br", "hr"} | {"hr"}, "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}),
    "td": frozenset({"td", "th", "tr"}), "th": frozenset({"td", "th", "tr"}), "tr": frozenset({"tr"}), "option": frozenset({"option"}),
}
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
# Parts of a class or id that name what is never main text, wherever they stand in it, and those that do so only at its end.
DROPPED_PARTS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsors sponsored cookie cookies consent gdpr popup modal overlay nav navbar navigation menu menus "
    "breadcrumb breadcrumbs sidebar comment comments commentlist disqus footer masthead newsletter pagination pager toolbar".split()
)
DROPPED_ENDS = frozenset(
    "promo promos promotion promotions banner notice notices side widget widgets related recommended share sharing social respond replies reply foot header subscribe signup login search skip".split()
)
# Those of them that name reader comments.
COMMENTS = frozenset("comment comments commentlist disqus respond replies reply".split())
_PARTS = re.compile(r"[a-z]+")
# Function words by which running text is told from lists of names.
STOP_WORDS = frozenset(
    "the of and to in is that it for was on are as with be by this from at or an a he not but have they which you "
    "le la les de des du un une et en est que qui dans pour par sur au avec il ne se ce pas plus "
    "el los las del y una es con para su al lo como más o pero sus "
    "der die das und ist ein eine zu den von mit sich auf dem nicht im für als auch es an werden aus er hat dass sie nach wird bei".split()
)

LENGTH_LOW, LENGTH_HIGH = 70, 200
STOPS_LOW, STOPS_HIGH = 0.12, 0.20
LINKS_HIGH = 0.33

_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|$|(?=<))", re.S
)
_ATTR = re.compile(r"(?<![a-zA-Z_:-])([a-zA-Z_:-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.S)


class Block:
    __slots__ = ("heading", "linked", "main", "named", "parts", "wanted")

    def __init__(self, wanted: bool, named: bool, main: bool, heading: bool) -> None:
        self.parts: list[str] = []
        self.linked = 0
        self.wanted, self.named, self.main, self.heading = wanted, named, main, heading


#: How a container is left out: not at all, by its class or id alone, or for certain.
KEPT, BY_NAME, CERTAIN = range(3)


def _by_name(names: str) -> int:
    """How a class or id leaves its element out."""
    found = KEPT
    for name in names.lower().split():
        parts = _PARTS.findall(name)
        if not parts:
            continue
        if not COMMENTS.isdisjoint(parts[-1:]) or parts[0] in ("comment", "comments", "disqus"):
            return CERTAIN
        if parts[-1] in DROPPED_ENDS or not DROPPED_PARTS.isdisjoint(parts):
            found = BY_NAME
    return found


def _dropped(name: str, attributes: str) -> int:
    if name in DROPPED_TAGS:
        return CERTAIN
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return KEPT
    if name in ("article", "main", "body", "html"):
        return KEPT
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(attributes)}
    if found.get("role", "").lower() in DROPPED_ROLES or found.get("aria-hidden", "").lower() == "true":
        return CERTAIN
    if "display:none" in found.get("style", "").replace(" ", "").lower() or re.search(r"(?:^|\s)hidden(?:\s|$|/)", _ATTR.sub(" ", attributes)):
        return CERTAIN
    return max(_by_name(found.get("class", "")), _by_name(found.get("id", "")))


#: A tag's slash that isn't part of an unquoted value.
_SELF_CLOSED = re.compile(r"(?:^|[\s\"'])/\s*$")


def _after(page: str, name: str, at: int, unclosed: set[str]) -> int:
    """The place after the end of a raw element whose content starts at `at`, elements of its name inside it included.

    Without an end, text-only elements reach to the page's end, and of others only the tag is left out.
    """
    if name not in unclosed:
        depth, first = 1, 0
        for m in re.compile(rf"<(/?){re.escape(name)}(?=[\s>/])([^>]*)>", re.I).finditer(page, at):
            if name in TEXT_TAGS:
                if m[1]:
                    return m.end()
                continue
            depth += -1 if m[1] else not _SELF_CLOSED.search(m[2])
            first = first or (m.end() if m[1] else 0)
            if not depth:
                return m.end()
        if first:  # more starts than ends
            return first
        unclosed.add(name)
    return len(page) if name in TEXT_TAGS else at


def blocks(page: str) -> list[Block]:
    """The page's text blocks in page order, in time linear in the page."""
    out: list[Block] = []
    stack: list[tuple[str, int, bool]] = []  # name, how it is left out, is the main element
    open_names: Counter[str] = Counter()
    open_blocks: list[int] = []  # places of block elements in the stack
    left_out = [0, 0, 0]  # open elements by how they are left out
    mains = links = headings = 0
    block: Block | None = None
    unclosed: set[str] = set()  # raw elements that have no end in the rest of the page
    at = 0

    def text(piece: str) -> None:
        nonlocal block
        if not piece:
            return
        if block is None:
            block = Block(not left_out[BY_NAME] and not left_out[CERTAIN], not left_out[CERTAIN], mains > 0, headings > 0)
            out.append(block)
        block.parts.append(piece)
        if links:
            block.linked += len(piece.strip())

    def pop() -> None:
        nonlocal mains, links, headings
        name, how, main = stack.pop()
        open_names[name] -= 1
        if open_blocks and open_blocks[-1] == len(stack):
            open_blocks.pop()
        left_out[how] -= 1
        mains -= main
        links -= name == "a"
        headings -= name in HEADINGS

    end = len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if name in BLOCK_TAGS:
                block = None
            if open_names[name]:
                while stack[-1][0] != name:
                    pop()
                pop()
            continue
        if name in BLOCK_TAGS:
            block = None
        while stack and name in CLOSED_BY.get(stack[-1][0], ()):
            pop()
        if (name == "p" or name in HEADINGS) and open_blocks and stack[open_blocks[-1]][0] == "p":
            k = open_blocks[-1]  # an open inline element doesn't reach over a new paragraph
            while len(stack) > k:
                pop()
        if name in RAW_TAGS:
            if name not in FOREIGN_TAGS or not _SELF_CLOSED.search(m[3]):
                at = _after(page, name, at, unclosed)
            continue
        if name in VOID_TAGS:
            continue
        how, main = _dropped(name, m[3]), name in ("article", "main")
        if main and mains and re.search(r"comment", m[3], re.I):
            how = CERTAIN
        if name == "header" and mains and not left_out[BY_NAME] and not left_out[CERTAIN]:
            how = KEPT  # the main element's own header has its title
        if name in BLOCK_TAGS:
            open_blocks.append(len(stack))
        stack.append((name, how, main))
        open_names[name] += 1
        left_out[how] += 1
        mains += main
        links += name == "a"
        headings += name in HEADINGS
    return out


def _squeezed(block: Block) -> str:
    return " ".join(_html.unescape("".join(block.parts)).split())


def first_pass(block: Block, text: str) -> str:
    """good, bad, near (near-good) or short, from length, link density and stop-word density."""
    if block.linked > LINKS_HIGH * len(text) and not (block.main and len(text) - block.linked >= LENGTH_LOW):
        return "bad"
    words = text.lower().split()
    density = sum(w.strip(".,;:!?()\"'") in STOP_WORDS for w in words) / len(words)
    if block.main:  # the page itself says that this is the article
        return "good" if len(text) >= LENGTH_LOW or density >= STOPS_HIGH else "short"
    if len(text) < LENGTH_LOW:
        return "bad" if block.linked or text[0] == "\xa9" else "short"
    if density >= STOPS_HIGH:
        return "good" if len(text) > LENGTH_HIGH else "near"
    if density >= STOPS_LOW:
        return "near"
    return "good" if len(text) > 2 * LENGTH_HIGH else "short"


def second_pass(found: list[tuple[Block, str]], labels: list[str], edge: str) -> list[bool]:
    """Which blocks to keep: undecided ones take the label of their nearest decided neighbours; edge is for pages without any."""
    n = len(labels)
    before, after = [-1] * n, [n] * n
    for i in range(n):
        before[i] = i if labels[i] in ("good", "bad") else before[i - 1] if i else -1
    for i in range(n - 1, -1, -1):
        after[i] = i if labels[i] in ("good", "bad") else after[i + 1] if i + 1 < n else n
    keep = [False] * n
    for i in range(n - 1, -1, -1):
        sides = [labels[k] for k in (before[i], after[i]) if 0 <= k < n] or [edge]
        left, right = sides[0], sides[-1]
        if left == right:
            keep[i] = left == "good"
        elif labels[i] == "near":
            keep[i] = True
        elif found[i][0].heading:
            keep[i] = i + 1 < n and keep[i + 1]
        else:
            to_left, to_right = i - before[i], after[i] - i
            keep[i] = to_left != to_right and (left if to_left < to_right else right) == "good"
    return keep


def extract(page: str) -> str:
    """The main text of a page."""
    found = [(b, s) for b in blocks(page) if (s := _squeezed(b))]
    if not any(b.wanted for b, _ in found):  # a name alone doesn't make all running text of a page something else
        for b, s in found:
            b.wanted = b.named and first_pass(b, s) == "good"
    main_found = any(b.main and b.wanted for b, _ in found)
    # neighbours are running text: not what stands in dropped containers, or outside a main element
    found = [(b, s) for b, s in found if b.wanted and (b.main or not main_found)]
    labels = [first_pass(b, s) for b, s in found]
    if "good" not in labels:
        labels = ["good" if x == "near" else x for x in labels]
    keep = second_pass(found, labels, "good" if main_found else "bad")
    return " ".join(s for (_, s), k in zip(found, keep, strict=True) if k)


_SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def extract_pages(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    bound_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [extract(x) for x in texts_of(batch, "html")]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.string()), pa.array([len(x) for x in made], pa.int64())], schema=_SCHEMA)

    return pages.selectExpr("cast(page_id as bigint) page_id", "cast(url as string) url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
