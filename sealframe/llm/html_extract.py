"""Main text of web pages by tag-path ratios.

A page is cut into blocks of text. Blocks with the same root-to-leaf path of block elements (with their classes) form
a group, and paths form a tree. For each path

1. text length and punctuation per block are aggregated, of the path alone and of all paths below it;
2. both ratios are smoothed along the tree: a path's own with those of the subtrees that it lies in, with a Gaussian kernel over the
   levels between, so a heading next to long paragraphs is not judged by its own length alone;
3. they are fused into one score, and multiplied by one weight for what element names and classes say, and one for links;
4. paths whose score reaches a share of the reference are the content.

The reference is the best path's score. Where an ``article`` or ``main`` element holds a fair share of the page's text, it is the score of
that element's subtree: paths in it inherit that score, less a little for every level, unless they are mere lists of links, and paths beside
it weigh little. So a table of short cells in an article is not measured against its longest paragraph.

A class or id is read name by name. Words that always mean text beside the article mark it; other such words (``legal``, ``related``)
do so only if the name has no word of its own beside them (``legal-notice``, but not ``legal-text``); names like ``no-sidebar`` mark nothing.

Cases: null or empty html gives an empty text; a page without content gives an empty text;
unclosed, misnested and cut-off markup is read as browsers do it in the main; pages of any length and depth
are read whole, in time linear in their length; repeated rows give repeated results; an empty table gives an empty result; only
the named columns are read, so other columns may have any names.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_texts

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements whose text is never read.
SILENT = frozenset("script style noscript template head title svg math canvas iframe object audio video select datalist textarea button map".split())
#: Elements that hold no article text.
APART = frozenset("nav footer aside form menu dialog search fieldset".split())
#: An opening tag ends these open elements, up to the nearest element of the second set.
ENDS = (
    {t: ({"p"}, frozenset()) for t in BLOCK - {"html", "head", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "title"}}
    | {"li": ({"li", "p"}, frozenset({"ul", "ol", "menu"})), "dt": ({"dt", "dd", "p"}, frozenset({"dl"})), "dd": ({"dt", "dd", "p"}, frozenset({"dl"}))}
    | {t: ({"td", "th", "p"}, frozenset({"tr", "table"})) for t in ("td", "th")}
    | {"tr": ({"tr", "td", "th", "p"}, frozenset({"table"}))}
    | {t: ({"tbody", "thead", "tfoot", "tr", "td", "th", "p"}, frozenset({"table"})) for t in ("tbody", "thead", "tfoot")}
    | {"body": ({"head"}, frozenset())}
)
#: Words in a class, id or role that mark text beside the article, whatever stands with them.
BESIDE = frozenset(
    "ad ads advert adverts advertisement advertising adsense adbox promo sponsored nav navbar navigation breadcrumb breadcrumbs masthead "
    "footer sidebar comment comments disqus newsletter gdpr pagination outbrain taboola".split()
)
#: Words that mark it alone, or with words that say only where or what kind of box it is.
MAYBE = frozenset(
    "menu cookie cookies consent popup modal overlay share sharing social related recommended recommendations notice notices alert subscribe "
    "subscription signup login search form pager copyright legal disclaimer skip toolbar contentinfo complementary dialog rail respond replies "
    "promotion promoted sponsor widget widgets banner aside".split()
)
BOX = frozenset(
    "list box block section area wrapper wrap container inner outer item items post posts link links bar top bottom left right main site page button "
    "buttons panel group row col column unit slot fixed sticky icon icons module region holder info warning success danger error close us this".split()
)
HEADER = frozenset("header topbar".split())
NEGATED = frozenset("no without has with".split())
#: Elements that hold the article.
ROOTS = frozenset("article main".split())
PUNCTUATION = re.compile(r"[.,;:!?…。、，！？；：؟،।]")
TAG = re.compile(r"<[a-zA-Z!/?]")
WORD = re.compile(r"[a-z]+", re.I)
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

#: Spread, in levels, of the kernel that smooths the ratios along the tree, and the levels that it spans.
SMOOTHING, LEVELS = 1.0, 4
#: Share of the reference that content reaches.
SHARE = 0.12
#: Weights of paths that names mark, and of those that names may mark.
MARKED, DOUBTFUL = 0.005, 0.5
#: Weight of paths beside an article element that holds ``HOLDS`` of the text of unmarked paths.
OUTSIDE, HOLDS = 0.01, 0.2
#: What a path in an article inherits of the score of the path above.
INHERITED = 0.95
#: Weight of paths whose text is mostly links; a list of links is mere if its items are shorter than ``ITEM``, without punctuation.
LINKS, ITEM = 0.1, 40


def name_weight(name: str) -> float:
    """What one class or id says."""
    words = [w.lower() for w in WORD.findall(CAMEL.sub(" ", name))]
    if not words or words[0] in NEGATED:
        return 1.0
    if BESIDE.intersection(words):
        return MARKED
    if MAYBE.intersection(words):
        return MARKED if all(w in MAYBE or w in BOX for w in words) else DOUBTFUL
    return 1.0


class Frame:
    """An open block element: its tag, path, and the inline elements open in it."""

    __slots__ = ("tag", "path", "inline", "count", "silent")

    def __init__(self, tag: str, path: int, silent: bool):
        self.tag, self.path, self.silent = tag, path, silent
        self.inline: list[tuple[str, bool]] = []
        self.count: Counter = Counter()


class Blocks(HTMLParser):
    """The page's blocks in order, (path, text, characters in links), and the tree of its paths: of each path its
    parent, step, weight, and whether it lies in an article element. Every element is opened and closed once, so
    this takes time in proportion to the page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[int, str, int]] = []
        self.paths: list[tuple[int, str, float, bool]] = [(-1, "", 1.0, False)]
        self.number: dict[tuple, int] = {}
        self.frames = [Frame("", 0, False)]
        self.open: Counter = Counter()
        self.parts: list[str] = []
        self.linked = self.links = self.silent = 0

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.found.append((self.frames[-1].path, text, self.linked))
            self.parts = []
        self.linked = 0

    def below(self, path: int, tag: str, given: dict[str, str | None]) -> int:
        """The path of an element with this tag and attributes."""
        _, _, weight, within = self.paths[path]
        kind = given.get("class") or ""
        roles = f"{given.get('role') or ''} {given.get('itemprop') or ''}"
        names = [*kind.split(), *(given.get("id") or "").split(), *roles.split()]
        if tag not in ("html", "body"):
            hidden = "hidden" in given or given.get("aria-hidden") == "true" or "display:none" in (given.get("style") or "").replace(" ", "").lower()
            apart = tag in APART or hidden or (not within and (tag == "header" or any(HEADER.intersection(WORD.findall(n.lower())) for n in names)))
            weight *= MARKED if apart else min(map(name_weight, names), default=1.0)
            within = within or tag in ROOTS or "main" in roles.split() or "articleBody" in names
        key = (path, f"{tag}.{kind}" if kind else tag, weight, within)
        if key not in self.number:
            self.number[key] = len(self.paths)
            self.paths.append(key)
        return self.number[key]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK or tag in ("br", "hr"):
            self.flush()
        if tag in VOID:
            return
        if tag not in BLOCK:
            here = self.frames[-1]
            here.inline.append((tag, quiet := tag in SILENT))
            here.count[tag] += 1
            self.links += tag == "a"
            self.silent += quiet
            return
        if tag in ENDS:
            ended, stop = ENDS[tag]
            while (name := self.frames[-1].tag) in ended and name not in stop:
                self.pop()
        self.frames.append(Frame(tag, self.below(self.frames[-1].path, tag, dict(attrs)), tag in SILENT))
        self.open[tag] += 1
        self.silent += tag in SILENT

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in VOID:
            if tag == "br":
                self.flush()
        elif tag in BLOCK:
            self.flush()
            while self.open[tag]:
                if self.pop() == tag:
                    return
        else:
            here = self.frames[-1]
            while here.count[tag]:
                if self.leave(here) == tag:
                    return

    def leave(self, frame: Frame) -> str:
        """End the frame's last inline element."""
        tag, quiet = frame.inline.pop()
        frame.count[tag] -= 1
        self.links -= tag == "a"
        self.silent -= quiet
        return tag

    def pop(self) -> str:
        """End the last block element, with what is open in it."""
        frame = self.frames.pop()
        while frame.inline:
            self.leave(frame)
        self.open[frame.tag] -= 1
        self.silent -= frame.silent
        return frame.tag

    def parse_comment(self, i: int, report: bool = True) -> int:
        """The whole page is here, so a comment that has no end is the rest of it; looked for once, not from every later one."""
        return super().parse_comment(i, report) if self.rawdata.find("-->", i + 4) >= 0 else len(self.rawdata)

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.parts.append(data)
            if self.links:
                self.linked += len(data.strip())


def parse(html: str) -> Blocks:
    parser = Blocks()
    # A tag that the end of the page cuts off is no text.
    end = html.rfind(">") + 1
    parser.feed(html[:end] + TAG.split(html[end:], maxsplit=1)[0])
    parser.close()
    parser.flush()
    return parser


def fuse(length: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """One score of text length and punctuation per block."""
    return np.log1p(length) * (1 + np.log1p(marks))


def path_scores(page: Blocks) -> tuple[np.ndarray, float]:
    """The score of every path, and the reference."""
    n = len(page.paths)
    parent = np.array([p[0] for p in page.paths])
    weight = np.array([p[2] for p in page.paths])
    within = np.array([p[3] for p in page.paths])
    path = np.array([x[0] for x in page.found])
    # Blocks, characters, punctuation and characters in links, of each path alone and of its subtree.
    own = np.array([np.bincount(path, values, n) for values in (np.ones(len(path)), [len(x[1]) for x in page.found], [len(PUNCTUATION.findall(x[1])) for x in page.found], [x[2] for x in page.found])])
    below = own.copy()
    alike = weight == np.where(parent >= 0, weight[parent], 1)
    for i in range(n - 1, 0, -1):
        if alike[i]:  # text beside the article says nothing about what it stands in
            below[:, parent[i]] += below[:, i]
    ratio, around = own[1:3] / np.maximum(own[0], 1), below[1:3] / np.maximum(below[0], 1)
    total, share, above = ratio.copy(), np.ones(n), parent
    for level in range(1, LEVELS):
        near = np.exp(-0.5 * (level / SMOOTHING) ** 2) * (above >= 0)
        total += near * around[:, above]
        share += near
        above = np.where(above >= 0, parent[above], -1)
    fused = fuse(*(total / share))
    linked = own[3] > 0.5 * own[1]
    score = fused * weight * np.where(linked, LINKS, 1.0)
    plain = own[1] * (weight > MARKED)
    if not plain[within].sum() > HOLDS * plain.sum():
        return score, score[(own[0] > 0) & (weight > MARKED)].max(initial=np.inf if not plain.any() else 0)
    whole = fuse(*around)
    reference = 0.0
    mere = linked & (own[2] == 0) & (ratio[0] < ITEM)
    inherited = np.zeros(n)
    for i in range(1, n):
        if within[i]:
            root = not within[parent[i]]
            inherited[i] = whole[i] * weight[i] if root else INHERITED * inherited[parent[i]] * weight[i] / weight[parent[i]]
            if root and weight[i] > MARKED:
                reference = max(reference, inherited[i])
    score = np.where(within, np.where(mere, score, np.maximum(score, inherited)), score * OUTSIDE)
    return score, reference


def main_text(html: str) -> str:
    page = parse(html)
    if not page.found:
        return ""
    score, reference = path_scores(page)
    chosen = score >= SHARE * reference
    return "\n".join(text for path, text, _ in page.found if chosen[path])


def extract(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Per row of ``pages``: the columns ``keep``, ``text`` and ``n_chars`` (its code points)."""

    def run(pages: list[str]) -> list[pa.Array]:
        made = list(map(main_text, pages))
        return [pa.array(made, pa.string()), pa.array(list(map(len, made)), pa.int64())]

    return map_texts(pages, html, keep, run, {"text": "string", "n_chars": "bigint"})
