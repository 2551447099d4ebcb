"""Main text of web pages by text-to-tag ratio.

The standard library's parser streams its events into lines, one for each
block of the page. A line's ratio is its characters outside links over its
tags. Menus, sidebars, notices, adverts, forms, comments and the like lower
the ratio of their lines, by element, role or name. A name of which only a part
says so lowers lines only where the element holds mostly links or the page has
several elements of that name; names of paragraphs, quotations and headings
never do. A lowered line starts from the mean ratio of the others if its own is
higher. An element that holds most of the page with its title lowers nothing,
whatever its name. The ratios are
smoothed by a Gaussian along the page and lines above a threshold form
clusters. The element that holds most of the clusters' text is where the
content region begins; it grows to the article or main element around it, and
to elements around it that hold further clusters or headings. Inside it the
clusters decide about every line that isn't plainly a paragraph, a heading or
an item: lowered lines, links without text and bare text at the region's ends
stay only where they are above the threshold. Links of an article or main
element, and those in a table beside text, are its lines like any other.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm.common import table

#: Elements that begin and end a block.
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
#: Elements whose text is never main text.
DROPPED = frozenset("audio button canvas datalist head iframe label math noscript object option script search select style svg template textarea title video".split())
#: Elements that lower the ratio of what they hold; those that a page may be wrapped in.
LOWERING, WRAPPING = frozenset("aside dialog footer form header menu nav".split()), frozenset(["form"])
#: Elements of which each is a paragraph, an item or the like by itself.
PROSE = frozenset("blockquote caption dd dt figcaption h1 h2 h3 h4 h5 h6 li p pre summary td th".split())
#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that may be the content region.
REGIONS = frozenset("article body center div main section table td".split())
#: Words before a name that take its meaning away.
NEGATED = frozenset("has hide is no with without".split())
#: Words in class or id of a block that is not main text.
NAMES = frozenset("ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright disclaimer disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notification pager pagination popup promo promoted recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget".split())
#: The same for role.
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Words beside those of NAMES in a name that is about nothing else.
NEUTRAL = frozenset("area bar block body bottom box col column container content foot global group head home inner item left line link links list main nav outer page panel post primary right row secondary section side site slot sub text thread title top unit wrap wrapper".split())
#: Elements that names don't drop.
NAMED_FREELY = frozenset("article blockquote body caption dd dt figcaption h1 h2 h3 h4 h5 h6 html main p pre td th".split())

#: Elements that the content region takes in whole if they are around it.
WHOLE = frozenset("article main".split())
#: Elements of a heading.
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())

SIGMA = 1.5
#: What is left of a lowered ratio.
LOWERED = 0.05
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


@dataclass
class Line:
    """A block of a page: its text, characters outside links, links, the tags since the line before, what lowers it, its innermost block element, the open regions around it with their elements, and whether it is in a heading."""

    text: str
    plain: int
    links: int
    tags: int
    lowered: tuple[int, ...]
    tag: str
    regions: tuple[int, ...]
    kinds: tuple[str, ...]
    heading: bool


@dataclass
class _Open:
    tag: str
    drops: bool
    region: int | None = None
    lowers: int | None = None


@dataclass
class Lines(HTMLParser):
    """Gathers a page's lines from the parser's events."""

    found: list[Line] = field(default_factory=list)

    def __post_init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[_Open] = []
        self.dropping = self.linking = 0
        self.regions = 0
        self.parts: list[str] = []
        self.plain: list[str] = []
        self.links = 0
        self.tags = 0
        #: What lowers: whether a page may be wrapped in it, whether it holds the page's title or main element, and its name if that says so only in part.
        self.lowering: list[list] = []

    def flush(self) -> None:
        text = _SPACE.sub(" ", "".join(self.parts)).strip()
        if text:
            plain = len(_SPACE.sub(" ", "".join(self.plain)).strip())
            around = [x for x in self.open if x.region is not None]
            block = next((x.tag for x in reversed(self.open) if x.tag in BLOCKS), "")
            lowered = tuple(x.lowers for x in self.open if x.lowers is not None)
            self.found.append(Line(text, plain, self.links, self.tags, lowered, block, tuple(x.region for x in around), tuple(x.tag for x in around), any(x.tag in HEADINGS for x in self.open)))
            self.tags = 0
        self.parts.clear(), self.plain.clear()
        self.links = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self.flush()
        elif tag == "br":
            self.parts.append(" "), self.plain.append(" ")
        elif tag == "a":
            self.links += 1
        if tag in VOID:
            return
        if tag == "body":
            while self.dropping and self.open:
                self._pop()
        names = dict(attrs)
        drops = tag in DROPPED or _hidden(names)
        region = lowers = None
        if tag in REGIONS:
            region, self.regions = self.regions, self.regions + 1
        inner = tag == "header" and any(x.tag in WHOLE for x in self.open)
        named = _named(tag, names) if attrs else None
        if tag in LOWERING and not inner or named is not None:
            lowers = len(self.lowering)
            self.lowering.append([tag in WRAPPING or tag not in LOWERING, False, "" if tag in LOWERING and not inner else named])
        if tag in ("h1", "main"):
            for x in self.open:
                if x.lowers is not None:
                    self.lowering[x.lowers][1] = True
        self.open.append(_Open(tag, drops, region, lowers))
        self.dropping += drops
        self.linking += tag == "a"

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self.flush()
        if any(x.tag == tag for x in self.open):
            while self._pop() != tag:
                pass

    def _pop(self) -> str:
        last = self.open.pop()
        self.dropping -= last.drops
        self.linking -= last.tag == "a"
        return last.tag

    def handle_data(self, data: str) -> None:
        if not self.dropping:
            self.parts.append(data)
            if not self.linking:
                self.plain.append(data)

    def weights(self) -> np.ndarray:
        """1, or LOWERED for lines that something lowers."""
        inside: dict[int, int] = {}
        linked: dict[int, int] = {}
        for x in self.found:
            for k in x.lowered:
                inside[k] = inside.get(k, 0) + x.plain
                linked[k] = linked.get(k, 0) + len(x.text) - x.plain
        total = sum(x.plain for x in self.found)
        idle = {k for k, n in inside.items() if all(self.lowering[k][:2]) and 2 * n >= total}
        several = Counter(name for _, _, name in self.lowering)
        idle |= {k for k, n in inside.items() if (name := self.lowering[k][2]) and several[name] < 2 and linked[k] <= n}
        if all(set(x.lowered) - idle for x in self.found):
            # Nothing else is there: what a page may be wrapped in lowers nothing if it holds paragraphs.
            idle |= {k for x in self.found if x.tag == "p" for k in x.lowered if self.lowering[k][0]}
        return np.array([LOWERED if set(x.lowered) - idle else 1.0 for x in self.found])


def _hidden(attrs: dict[str, str | None]) -> bool:
    return "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in (attrs.get("style") or "").replace(" ", "").lower()


def _named(tag: str, attrs: dict[str, str | None]) -> str | None:
    """Whether role, class or id name something that isn't main text: empty if all of a name does, the name if only a part of it, None if nothing; a name such as no-sidebar doesn't."""
    if (attrs.get("role") or "").lower() in ROLES:
        return ""
    if tag in NAMED_FREELY:
        return None
    part = None
    for name in f"{attrs.get('class') or ''} {attrs.get('id') or ''}".split():
        words = [w.lower() for w in _WORD.findall(name)]
        if words and words[0] not in NEGATED and any(w in NAMES for w in words):
            if all(w in NAMES or w in NEUTRAL or w.isdigit() for w in words):
                return ""
            part = name
    return part


def parsed(html: str) -> Lines:
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser.flush()
    return parser


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing along the lines; ends are weighted by what is there."""
    reach = int(3 * sigma + 0.5)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    middle = slice(reach, reach + len(ratios))
    return np.convolve(ratios, kernel)[middle] / np.convolve(np.ones(len(ratios)), kernel)[middle]


def clusters(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which lines are above the threshold when their ratios are smoothed, and which are by their own ratio too: the smoothed ratios' standard deviation, or their mean if that is less."""
    ratios = smoothed(own)
    chosen = ratios >= (least := min(ratios.std() or ratios.mean(), ratios.mean()))
    return chosen, chosen & (own >= least) & (own > 0)


def main_text(html: str | None, clusters=clusters) -> str:
    """The main text of a page: blocks with their white space folded, joined by an empty line. Null or no text: empty."""
    page = parsed(html) if html else Lines()
    lines = page.found
    if not lines:
        return ""
    weight = page.weights()
    plain = weight == 1
    ratio = np.array([x.plain / max(1, x.tags) for x in lines])
    usual = ratio[plain].mean() if plain.any() else 0.0
    chosen, strong = clusters(np.where(plain, ratio, LOWERED * np.minimum(ratio, usual)))
    if not (plain & chosen).any():
        return ""
    held: dict[int, int] = {}
    for line, take in zip(lines, chosen & plain, strict=True):
        for r in line.regions if take else ():
            held[r] = held.get(r, 0) + len(line.text)
    # The innermost region that holds more than half of the clusters' text; regions are numbered from outside in, the page is -1.
    half = sum(len(x.text) for x, take in zip(lines, chosen & plain, strict=True) if take) / 2
    region = max((r for r, w in held.items() if w > half), default=-1)
    if region >= 0:
        around = next(x for x in lines if region in x.regions)
        at = around.regions.index(region)
        # The outermost article or main around it, then what holds further headings or lines that are above the threshold themselves.
        at = next((k for k in range(at) if around.kinds[k] in WHOLE), at)
        region = around.regions[at]
        further = strong | [x.heading for x in lines]
        for outer in (*reversed(around.regions[:at]), -1):
            if any(take and region not in x.regions for x, take in zip(lines, further & plain, strict=True) if outer < 0 or outer in x.regions):
                region = outer
    bare = [x.plain == 0 and x.links > 0 for x in lines]
    firm = np.flatnonzero(strong | [x.tag in PROSE and not b for x, b in zip(lines, bare, strict=True)] & plain)
    first, last = (firm[0], firm[-1]) if len(firm) else (0, -1)

    def stays(k: int, x: Line) -> bool:
        if not plain[k]:
            return bool(strong[k])
        if bare[k] and not WHOLE.isdisjoint(x.kinds):
            return True
        if bare[k] and "table" in x.kinds:  # beside figures or text in its table
            table = x.regions[len(x.kinds) - 1 - x.kinds[::-1].index("table")]
            own = [y for y in lines if table in y.regions]
            return sum(y.plain for y in own) >= sum(len(y.text) - y.plain for y in own)
        if bare[k]:  # one link by itself among text, not a row or a list of them
            return bool(chosen[k]) and x.links == 1 and not any(bare[max(0, k - 1) : k]) and not any(bare[k + 1 : k + 2])
        return x.tag in PROSE or first <= k <= last or not WHOLE.isdisjoint(x.kinds)

    return "\n\n".join(x.text for k, x in enumerate(lines) if (region < 0 or region in x.regions) and stays(k, x))


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """``pages`` with text and n_chars (code points) in place of the html column; nothing is shuffled.

    Null or empty html, and html without main text, give an empty text. A page
    is parsed whole, however long, and by itself; repeated rows give repeated
    results. Columns text and n_chars of ``pages`` are replaced.
    """
    from pyspark.sql.types import LongType, StringType, StructType

    pages = pages.drop("text", "n_chars")
    at = pages.columns.index(column)
    kept = [f for f in pages.schema.fields if f.name != column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(batch.columns) if i != at), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*(f.name for f in kept), "text", "n_chars"])

    return pages.mapInArrow(run, StructType(list(kept)).add("text", StringType()).add("n_chars", LongType()))


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", F.col("html"))).select("page_id", "url", "text", "n_chars")
