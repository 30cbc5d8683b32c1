"""Main text of web pages by tag-path ratios.

A page's text nodes are grouped by their tag path, from the root to the leaf, tags with their classes. A path has its mean text length and its
mean number of punctuation marks a node. Both are laid along the nodes in page order and smoothed with a Gaussian, so a heading
among paragraphs gains and a lone sentence among links loses; they are fused to one ratio, averaged by path, and paths
of at least ``least`` standard deviations are content. What the markup says by itself goes first: scripts, styles, forms and the like hold no
text; menus, headers, footers, sidebars, notices, adverts and comments, by tag, role, class or id, are not content (class and id count
on neither the body nor a wrapper of the page's text, and not at all where they leave nothing); and
where article and main elements hold at least half of the text outside links, their paths are raised by the edge.
In an article, words that its own parts may be called by (legal, notice, side and the like) count only as a whole name; an article that is called comment or reply is a comment.
A name that has a word of its own beside such a word (related-work, social-history, ad-hoc) decides nothing: its element is noise if it has no sentence or more text in links than outside.

The parser takes any text: tags that aren't closed, stray ends, cut pages, comments without an end. It works a page at
a time in Arrow batches; nothing is shuffled, and time is linear in the page.

Defined cases: null or empty html, and pages without content nodes, give an empty text; character references are decoded as browsers
do, also without semicolon; white space is what Unicode calls so, no-break spaces included; a line break element counts as a space;
repeated rows give equal rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RAW = "script|style|noscript|template|textarea|iframe|svg|title|select|xmp"
TOKEN = re.compile(
    rf"""<!--.*?(?:-->|\Z)|<svg(?=[\s/>])[^>]*/>|<(?P<raw>{RAW})(?=[\s/>])[^>]*+>.*?(?:</(?P=raw)\s*+>|\Z)|<[!?][^>]*+(?:>|\Z)
    |<(?P<end>/?)(?P<tag>[a-z][^\s/>]*+)(?P<attrs>(?:"[^"]*+"|'[^']*+'|[^"'>])*+)>|<(?P<end2>/?)(?P<tag2>[a-z][^\s/>]*+)(?P<attrs2>[^>]*+)(?:>|\Z)|(?P<text>[^<]++|<)""",
    re.X | re.S | re.I,
)
NAMES = re.compile(r"""(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Open tags that a new one of the first kind ends.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: What ends an open paragraph.
ENDS_P = BLOCK - {"body", "html", "head", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "legend", "option", "summary"}
#: What a new tag may end.
ENDED = {"p"}.union(*CLOSES.values())
#: No implied end reaches beyond these.
SCOPE = set("article aside body button div footer header html main nav section table td th ul ol dl".split())
ASIDE = set("nav header footer aside form button dialog head menu search figcaption label fieldset".split()) - {"figcaption"}
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Parts of class names and ids, between their separators.
NOISE = set(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar "
    "side aside footer foot header masthead comment comments reply replies discussion respond disqus notice notices cookie cookies consent gdpr alert popup modal overlay "
    "newsletter subscribe subscription signup login share sharing social related recommended widget toolbar pagination pager copyright legal disclaimer tags form search".split()
)
#: Of these, what an article's own parts may be called as well: within an article they count only in a name that has no other part.
WEAK = set("legal notice notices side aside tags form search disclaimer copyright alert header masthead banner discussion response menu overlay toolbar".split())
#: Whole names of articles that are readers' comments.
COMMENTS = set("comment comments reply replies".split())
#: Parts that say nothing about what an element holds.
PLAIN = set("container box wrapper wrap block slot unit list items item bar area section content inner outer top bottom left right links link buttons button btn icon icons title text panel group row col column head body article articles post posts story stories count toggle close js main page site global".split())
#: Names that begin so are lists of readers' comments.
OF_READERS = re.compile(r"(comment|reply|replies|disqus)[a-z]*$")
PUNCTUATION = re.compile(r"[.,;:!?…。，、！？；：]")


def noisy_names(names: str, inside: bool) -> tuple[bool, bool]:
    """Whether class names and ids call an element noise, and whether they may: a name that has a word of its own besides (related-work) leaves it to the text."""
    sure = maybe = False
    for name in names.split():
        parts = set(re.split(r"[_\-]+", name)) - {""}
        hit = parts & NOISE
        if inside:
            hit -= {"header", "masthead"} | (WEAK if parts - NOISE else set())
        if hit and all(x in NOISE or x in PLAIN or x.isdigit() for x in parts) or OF_READERS.match(name):
            sure = True
        elif hit:
            maybe = True
    return sure, maybe


class Node:
    __slots__ = ("block", "linked", "inside", "named", "noise", "path", "text")


def named_noise(found: list[Node], parent: list[int], whole: list[bool], maybe: list[bool]) -> None:
    """Marks the nodes in elements that their names (or being a form) call noise, unless such an element is a wrapper.

    parent: of each such element the next one around it; whole: whether it has an article or main within; maybe: whether its text decides. A wrapper is one that has,
    or that stands outside of those and holds, links aside, more than half of the page's text and four times that of articles elsewhere. An element whose text
    decides is noise unless it has sentences: a mark of punctuation, and no more text in links than outside. If nothing is left, names don't count.
    """
    size, linked, marks = ([0] * len(parent) for _ in range(3))
    for n in found:
        if not n.noise:
            (linked if n.linked else size)[n.named] += len(n.text.strip())
            if not n.linked and PUNCTUATION.search(n.text):
                marks[n.named] += 1
    for i in range(len(parent) - 1, 0, -1):
        for x in (size, linked, marks):
            x[parent[i]] += x[i]
        if whole[i] and whole[parent[i]] is False:
            whole[parent[i]] = True
    articles = sum(len(n.text.strip()) for n in found if n.inside and not n.noise and not n.linked and (not n.named or whole[n.named]))
    noisy = [False] * len(parent)
    for i in range(1, len(parent)):
        if maybe[i]:
            noisy[i] = noisy[parent[i]] or not whole[i] and (not marks[i] or linked[i] > size[i])
            continue
        # whole is None: in an article or main, where names always count
        noisy[i] = noisy[parent[i]] or whole[i] is None or not whole[i] and (2 * size[i] <= size[0] or size[i] <= 4 * articles)
    if any(not n.noise and not noisy[n.named] and not n.text.isspace() for n in found):
        for n in found:
            n.noise = n.noise or noisy[n.named]


def nodes(page: str) -> list[Node]:
    """The text nodes that hold more than white space, and white space between inline tags, in page order."""
    out: list[Node] = []
    ids: dict[tuple, int] = {}
    # open elements: tag, path, noise, linked, inside an article or main, the next element around that names call noise
    stack: list[tuple[str, int, bool, bool, bool, int]] = [("", 0, False, False, False, 0)]
    # how many are open by tag; for each open element, where the last tags that a new one may end stand, up to the border that no implied end crosses
    count: dict[str, int] = {}
    near: list[dict[str, int]] = [{}]
    parent, whole, maybe = [0], [False], [False]

    def cut(to: int) -> None:
        for x in stack[to:]:
            count[x[0]] -= 1
        del stack[to:], near[to:]

    block = 0
    for m in TOKEN.finditer(page):
        if (text := m["text"]) is not None:
            tag, path, noise, linked, inside, named = stack[-1]
            n = Node()
            n.text, n.path, n.block, n.noise, n.linked, n.inside, n.named = entities.unescape(text), path, block, noise, linked, inside, named
            out.append(n)
            continue
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue
        if m["end"] or m["end2"]:
            if tag in BLOCK:
                block += 1
            if count.get(tag):
                to = len(stack) - 1
                while stack[to][0] != tag:
                    to -= 1
                cut(to)
            continue
        if tag in BLOCK:
            block += 1
        if tag == "br" and out:
            n = Node()
            n.text, (_, n.path, n.noise, n.linked, n.inside, n.named), n.block = " ", stack[-1], block
            out.append(n)
        if tag in VOID:
            continue
        for gone in (CLOSES.get(tag), {"p"} if tag in ENDS_P else None):
            if gone and (to := max(near[-1].get(x, 0) for x in gone)):
                cut(to)
        attrs, names, roles = m["attrs"] or m["attrs2"] or "", "", set()
        if attrs:
            for key, value in NAMES.findall(attrs):
                value = value.strip("\"'").lower()
                if key.lower() == "role":
                    roles = set(value.split())
                else:
                    names += " " + value
        _, path, noise, linked, inside, named = stack[-1]
        here = tag in ("article", "main") or "main" in roles or "article" in roles
        called, perhaps = noisy_names(names, inside) if names and tag not in ("html", "body") else (False, False)
        said = here and bool(COMMENTS.intersection(names.split()))  # a reader's comment as an article
        here = here and not said
        noise = noise or not here and (tag in ASIDE and tag != "form" and not (tag == "header" and inside) or bool(roles & ROLES))
        if not here and (called or perhaps or tag == "form"):
            parent.append(named)
            sure = called or tag == "form"
            whole.append(None if sure and (inside or said) else False)
            maybe.append(not sure)
            named = len(parent) - 1
        elif here and not called and not noise and whole[named] is False:
            whole[named] = True
        key = (path, tag, names)
        stack.append((tag, ids.setdefault(key, len(ids) + 1), noise, linked or tag == "a", inside or here and not noise, named))
        count[tag] = count.get(tag, 0) + 1
        last = {} if tag in SCOPE else near[-1]
        near.append(last | {tag: len(stack) - 1} if tag in ENDED else last)
        if attrs.rstrip().endswith("/") and tag not in BLOCK:
            cut(len(stack) - 1)
    named_noise(out, parent, whole, maybe)
    return out


def smoothed(x: np.ndarray, radius: int = 2) -> np.ndarray:
    kernel = np.exp(-(np.arange(-radius, radius + 1) ** 2) / radius)
    return np.convolve(np.pad(x, radius, mode="edge"), kernel / kernel.sum(), mode="valid")


def content_paths(found: list[Node], least: float) -> set[int]:
    """The paths of the content nodes."""
    full = [n for n in found if not n.noise and not n.text.isspace()]
    if not full:
        return set()
    path = np.array([n.path for n in full])
    length = np.array([len(n.text.strip()) for n in full], float)
    marks = np.array([len(PUNCTUATION.findall(n.text)) for n in full], float)
    links = np.array([n.linked for n in full], float)
    inside = np.array([n.inside for n in full])
    paths, at, count = np.unique(path, return_inverse=True, return_counts=True)
    mean = lambda x: np.bincount(at, x) / count
    fused = np.sqrt(smoothed(mean(length)[at]) * (1 + smoothed(mean(marks)[at]))) * (1 - 0.9 * links)
    score = mean(fused)
    edge = min(least * fused.std(), 0.5 * score.max()) if len(paths) > 1 else 0.0
    own = length * (1 - links)
    if inside.any() and 2 * own[inside].sum() >= own.sum():
        # the element that holds most of the text lifts its paths to the edge
        score = np.where(mean(inside.astype(float)) > 0, score + edge, score)
    return {int(p) for p, s in zip(paths, score) if s >= edge}


def main_text(page: str | None, least: float = 1.0) -> str:
    if not page:
        return ""
    found = nodes(page)
    keep = content_paths(found, least)
    blocks: dict[int, list[str]] = {}
    for n in found:
        if not n.noise and (n.path in keep or n.text.isspace()):
            blocks.setdefault(n.block, []).append(n.text)
    joined = (" ".join("".join(b).split()) for b in blocks.values())
    return "\n".join(b for b in joined if b)


def extract(pages: DataFrame, least: float = 1.0) -> DataFrame:
    """page_id, url, text, n_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py(), least) for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
