"""Main text of web pages by block rules in two passes.

A page is cut into blocks of text. What its elements name as navigation, header, footer, sidebar,
notice, advert, form or reader comment goes at once. The first pass judges every other block by
itself: its length, its share of linked characters and its share of stop words make it good, bad or
ambiguous. In the second pass ambiguous blocks take the label of the nearest decided neighbour.
Inside `article` or `main` length alone is enough for a good block; outside them stop words decide.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from claimcheck.llm.byte_bpe import slices


@dataclass(frozen=True)
class Rules:
    """Limits of the two passes; lengths in code points."""

    short: int = 70
    long: int = 200
    # Share of linked characters from which a block is bad.
    linked: float = 0.4
    # Share of stop words: from `few` a block may be good, from `many` a long one is.
    few: float = 0.08
    many: float = 0.15


RULES = Rules()

# Frequent function words of the four languages.
STOP_WORDS = frozenset(
    """
    a about after all also an and any are as at be because been but by can could did do does for from had has have
    he her his how i if in into is it its just me more most my no not of on one only or other our out over she so
    some than that the their them then there these they this those to under up was we were what when where which
    who will with would you your
    aber als am an auch auf aus bei bis da das dass dem den der des die doch du durch ein eine einem einen einer
    eines er es für hat ich ihr im in ist ja kann mit nach nicht noch nur oder schon sein sich sie sind so über um
    und uns vom von vor war was wenn wer wie wir wird zu zum zur
    au aux avec ce ces cette comme dans de des du elle en entre est et il ils je la le les leur lui mais même ne
    nous on ou où par pas plus pour qu que qui sa sans se ses si son sont sur tout un une vous y à été être
    al algo como con cuando de del desde donde el ella en entre era es esta este fue ha hasta hay la las lo los más
    me mi muy no nos o para pero por porque que se ser si sin sobre son su sus también te tiene un una y ya
    """.split()
)

# Elements of HTML by what they mean for blocks.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var".split()
)
RAW = frozenset("script style noscript template textarea title iframe xmp noembed noframes svg math object canvas audio video".split())
CLOSES_ITSELF = frozenset("p li dt dd tr td th option h1 h2 h3 h4 h5 h6".split())
HOLDERS = frozenset("div section article main ul ol dl table tbody thead body aside nav header footer form blockquote figure details".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPHS = HEADINGS | {"p"}
LIKE = {"td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
DROPPED = frozenset("head nav aside footer form header menu dialog select button fieldset datalist".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar tablist".split())
# Names that pages give to what is not the article.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion promoted banner banners "
    "sidebar sidebars nav navbar navigation menu menus submenu breadcrumb breadcrumbs header masthead topbar footer "
    "comment comments commentlist discussion disqus replies reply respond cookie cookies consent gdpr notice notices alert alerts "
    "notification notifications popup modal overlay toolbar share sharing social related recommended recommendations newsletter "
    "subscribe subscription signup login pagination pager paginator widget widgets form copyright disclaimer rail aside "
    "responses reactions".split()
)
# An article element of these names is not the page's article.
ASIDE_NAMES = NAMES - {"header", "form", "discussion", "notice", "notices", "alert", "alerts", "copyright", "disclaimer"}
BODY_NAMES = frozenset("article-body article-content articlebody post-content post-body entry-content story-body".split())

# A quote opens a value right after an equals sign only, and one that is not closed soon is a character.
TAG = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<([a-zA-Z][^\s/>]*)((?:[^>=]+|=\s*(?:\"[^\"]{0,65536}\"|'[^']{0,65536}')?+)*+)>"
    r"|</([a-zA-Z][^\s/>]*)[^>]*>|<[!?/][^>]*>|<[a-zA-Z/!?][^>]*\Z",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=\"'/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"']+))|([^\s=\"'/]+)")
PARTS = re.compile(r"[-_:]+|(?<=[a-z])(?=[A-Z])")
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in RAW}

# What a place in the page is; of the last three, blocks of the highest that occurs make the article.
GONE, FORM, OUTSIDE, MAIN, ARTICLE = range(5)
GOOD, BAD, OPEN, OPEN_HEADING, APART = "good", "bad", "open", "heading", "apart"


@dataclass
class Block:
    text: str
    linked: int
    place: int
    heading: bool


@dataclass
class Holder:
    """An open element: what its content is, and whether an article inside it counts all the same."""

    name: str
    place: int
    opens: bool = True


@dataclass
class Reader:
    """Blocks of one page, in order; content of dropped elements makes none."""

    blocks: list[Block] = field(default_factory=list)
    stack: list[Holder] = field(default_factory=list)
    pieces: list[str] = field(default_factory=list)
    linked: int = 0
    in_link: bool = False
    breaks: int = 0

    def place(self) -> int:
        return self.stack[-1].place if self.stack else OUTSIDE

    def flush(self) -> None:
        """The current block ends."""
        if self.pieces:
            text = " ".join("".join(self.pieces).split())
            if text:
                heading = any(h.name in HEADINGS for h in self.stack[-2:])
                self.blocks.append(Block(text, self.linked, self.place(), heading))
            self.pieces, self.linked = [], 0
        self.breaks = 0

    def add(self, raw: str) -> None:
        if self.place() == GONE:
            return
        text = references.unescape(raw) if "&" in raw else raw
        self.pieces.append(text)
        solid = len("".join(text.split()))
        if self.in_link:
            self.linked += solid
        if solid:
            self.breaks = 0

    def open(self, name: str, attributes: str) -> None:
        if name == "br":
            # A line break is white space; two in a row end the block.
            self.breaks += 1
            if self.breaks > 1:
                self.flush()
                self.breaks = 1
            elif self.pieces:
                self.pieces.append(" ")
            return
        if name in INLINE:
            if name == "a":
                self.in_link = bool(re.search(r"(?:^|\s)href\s*=", attributes, re.I))
            return
        self.flush()
        if name in VOID:
            return
        if self.stack and self.stack[-1].name == "head":
            self.stack.pop()
        if name in CLOSES_ITSELF or self.stack and self.stack[-1].name in PARAGRAPHS:
            self.close_open(name)
        self.stack.append(self.holder(name, attributes))

    def close_open(self, name: str) -> None:
        """The start of `name` ends an open paragraph or heading, and its like inside the same holder."""
        alike, ends = LIKE.get(name, {name}) if name in CLOSES_ITSELF else set(), len(self.stack)
        for k in range(len(self.stack) - 1, -1, -1):
            held = self.stack[k].name
            if held in HOLDERS:
                break
            if held in alike or held in PARAGRAPHS:
                ends = k
        del self.stack[ends:]

    def holder(self, name: str, attributes: str) -> Holder:
        place = self.place()
        found: dict[str, str] = {}
        if attributes.strip():
            for m in ATTRIBUTE.finditer(attributes):
                found.setdefault((m[1] or m[5]).lower(), m[2] or m[3] or m[4] or "")
        own = name in ("article", "main") or found.get("role", "").lower() == "main"
        if place == GONE and not (own and all(h.opens for h in self.stack if h.place == GONE)):
            return Holder(name, GONE, name not in ("aside", "footer"))
        if name in ("html", "body"):
            return Holder(name, place)
        if hidden(found):
            return Holder(name, GONE, False)
        if name == "article":
            return Holder(name, GONE, False) if named(found, ASIDE_NAMES) else Holder(name, ARTICLE)
        if own:
            return Holder(name, max(place, MAIN))
        if found.get("itemprop") == "articleBody" or BODY_NAMES.intersection(found.get("class", "").lower().split()):
            return Holder(name, ARTICLE)
        what = named(found, NAMES)
        # The heading of an article may stand in a header of its own.
        if place == ARTICLE and (name == "header" or what == "header"):
            return Holder(name, place)
        if name in DROPPED or found.get("role", "").lower() in DROPPED_ROLES or what:
            # A form may wrap a whole page.
            if name == "form" and place == OUTSIDE and not what:
                return Holder(name, FORM)
            return Holder(name, GONE, name in ("nav", "header", "form") and not what)
        return Holder(name, place)

    def close(self, name: str) -> None:
        if name in INLINE:
            if name == "a":
                self.in_link = False
            return
        self.flush()
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k].name == name:
                del self.stack[k:]
                self.in_link = self.in_link and (name == "div" or name not in HOLDERS)
                return
            # A stray end tag inside an element does not end what is around it.
            if name in CLOSES_ITSELF and self.stack[k].name in HOLDERS:
                return


def hidden(attributes: dict[str, str]) -> bool:
    style = re.sub(r"\s", "", attributes.get("style", "").lower())
    return (
        "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style
    )


def named(attributes: dict[str, str], names: frozenset[str]) -> str:
    """The name in id or class that begins or ends like one of `names`, or nothing."""
    for value in (attributes.get("class", ""), attributes.get("id", "")):
        for word in value.split():
            parts = [p for p in PARTS.split(word) if p]
            if not parts or parts[0].lower() in ("no", "has", "with", "without", "is"):
                continue
            for part in (word, parts[0], parts[-1]):
                if part.lower() in names:
                    return part.lower()
    return ""


def blocks(page: str) -> list[Block]:
    """All blocks of a page outside dropped elements, in page order."""
    reader, at = Reader(), 0
    page = page.replace("\0", "�") if "\0" in page else page
    while True:
        m = TAG.search(page, at)
        if m is None:
            reader.add(page[at:])
            break
        if m.start() > at:
            reader.add(page[at : m.start()])
        at = m.end()
        if m[1]:
            name = m[1].lower()
            if name in RAW:
                end = RAW_END[name].search(page, at)
                if not m[2].endswith("/") or name not in ("svg", "math"):
                    at = end.end() if end else len(page)
                continue
            reader.open(name, m[2])
        elif m[3]:
            reader.close(m[3].lower())
    reader.flush()
    return reader.blocks


def stop_share(text: str) -> float:
    words = [w.strip(".,;:!?\"'()") for w in text.lower().split()]
    return sum(w in STOP_WORDS for w in words) / len(words)


def first_label(block: Block, inside: bool, rules: Rules = RULES) -> str:
    """What a block is by itself. inside: it lies in the element that holds the article."""
    length = len(block.text)
    solid = sum(map(len, block.text.split()))
    if block.linked > rules.linked * solid:
        return BAD
    if block.heading:
        return OPEN_HEADING
    if inside:
        return GOOD if length >= rules.short or length >= rules.short // 2 and stop_share(block.text) >= rules.few else OPEN
    if length < rules.short:
        return BAD if block.linked or block.text[0] == "\xa9" else OPEN
    share = stop_share(block.text)
    if length >= rules.long:
        return GOOD if share >= rules.many else OPEN if share >= rules.few else BAD
    return OPEN if share >= rules.few and block.place != FORM and block.text[0] != "\xa9" else BAD


def final_labels(found: list[Block], rules: Rules = RULES) -> list[bool]:
    """Whether each block belongs to the main text.

    Where an article or main element holds blocks, those outside do not count, nor as neighbours, and as little do
    forms without a good block. An ambiguous block takes the label of the nearest decided one; a heading looks ahead first. At equal distance, and without any decided neighbour,
    a block inside is good, and one outside is bad.
    """
    top = max((b.place for b in found), default=OUTSIDE)
    inside = [b.place == top and top >= MAIN for b in found]
    labels = [APART if top >= MAIN and b.place <= OUTSIDE else first_label(b, i, rules) for b, i in zip(found, inside)]
    if not any(label == GOOD and b.place == FORM for b, label in zip(found, labels)):
        labels = [APART if b.place == FORM else label for b, label in zip(found, labels)]
    n = len(found)
    before, after = [(n, "")] * n, [(n, "")] * n
    seen: tuple[int, str] | None = None
    for k in range(n):
        before[k] = (k - seen[0], seen[1]) if seen else (n, "")
        if labels[k] in (GOOD, BAD):
            seen = (k, labels[k])
    seen = None
    for k in range(n - 1, -1, -1):
        after[k] = (seen[0] - k, seen[1]) if seen else (n, "")
        if labels[k] in (GOOD, BAD):
            seen = (k, labels[k])
    out = []
    for k, label in enumerate(labels):
        if label not in (OPEN, OPEN_HEADING):
            out.append(label == GOOD)
            continue
        (far, left), (near, right) = before[k], after[k]
        if not left and not right:
            out.append(inside[k])
        elif label == OPEN_HEADING and right:
            out.append(right == GOOD)
        elif left and right and far == near and left != right:
            out.append(inside[k])
        else:
            out.append((left if far <= near else right) == GOOD)
    return out


def main_text(page: str, rules: Rules = RULES) -> str:
    found = blocks(page)
    return "\n".join(b.text for b, keep in zip(found, final_labels(found, rules)) if keep)


def extract(pages: DataFrame, rules: Rules = RULES) -> DataFrame:
    """`pages` without html, with columns text and n_chars (its code points).

    Every row is one page, repeated rows too; null html is empty, a page without an article has an empty text.
    Columns already called text or n_chars are replaced, all others pass through. No shuffle; one page fits a task.
    """
    pages = pages.drop("text", "n_chars")
    names = [c for c in pages.columns if c != "html"]
    schema = StructType([*[pages.schema[c] for c in names], StructField("text", StringType()), StructField("n_chars", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            texts = [main_text(h or "", rules) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                [*names, "text", "n_chars"],
            )

    return pages.select(*names, F.col("html").cast("string")).mapInArrow(run, schema)
