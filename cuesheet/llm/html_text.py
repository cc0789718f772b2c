"""Main text of web pages by tag-path ratios.

Text length and punctuation are added up per tag path from the root to the text; the sums per occurrence of the
path are smoothed along the page, fused and held against a threshold. The region around the chosen paths, without
the parts that its tags or names mark as furniture, is the text.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuesheet.llm.common import read

# fixed values: element names of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select "
    "summary table tbody td tfoot th thead title tr ul".split()
)
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An open one of these ends where one of the others starts, up to the nearest container.
ENDS = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu"})), "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})), "tr": (frozenset({"tr", "td", "th"}), frozenset({"table"})),
    "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})), "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "option": (frozenset({"option"}), frozenset({"select"})),
}
FURNITURE = frozenset("head title nav footer aside form menu search dialog select button noscript template iframe object svg canvas audio video map".split())
RAW = "script|style|textarea|noscript|template|iframe|svg"
# fixed values: words of class, id and role names that mark furniture
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs byline comment comments consent cookie cookies "
    "copyright disqus footer gdpr login masthead menu menubar modal nav navbar navigation newsletter notice notices notification "
    "pagination pager popup promo promoted promotion recommended related reply replies respond share sharing sidebar signup "
    "skip social sponsor sponsored subscribe subscription tags toolbar toc widget widgets complementary contentinfo search "
    "alert discussion header topbar paywall".split()
)
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW})\b[^>]*?(?:/>|>.*?(?:</\1\s*>|\Z))|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z)",
    re.S | re.I,
)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_PUNCTUATION = re.compile(r"[.,;:!?…。、，；：！？]")


@dataclass
class Piece:
    """A run of text: the node of its path, the number of its block, whether furniture holds it, and whether a link does."""

    path: int
    block: int
    text: str
    furniture: bool
    link: bool


class Paths:
    """Paths of block elements from the root as nodes of a tree, each path once. Node 0 is the empty path."""

    def __init__(self) -> None:
        self.up, self.step, self.depth, self.tag = [0], [""], [0], [""]
        self._known: dict[tuple[int, str], int] = {}

    def below(self, node: int, step: str, tag: str) -> int:
        k = self._known.setdefault((node, step), len(self.up))
        if k == len(self.up):
            self.up.append(node)
            self.step.append(step)
            self.depth.append(self.depth[node] + 1)
            self.tag.append(tag)
        return k

    def has(self, tags: frozenset[str]) -> list[bool]:
        """Per node whether its path holds one of the tags; parents come before their children."""
        out: list[bool] = []
        for k, tag in enumerate(self.tag):
            out.append(tag in tags or bool(k) and out[self.up[k]])
        return out

    def line(self, node: int) -> list[int]:
        out = []
        while node:
            out.append(node)
            node = self.up[node]
        return out[::-1]


def _marked(name: str, attributes: str) -> tuple[str, bool, bool]:
    """Path step (the tag with its first class or id), whether the element is furniture, and whether its names say so."""
    bad, named, step = name in FURNITURE, False, name
    if attributes:
        for m in _NAMED.finditer(attributes):
            value = (m[1] or m[2] or m[3] or "").lower()
            step = f"{name}.{value.split()[0]}" if value.split() and step == name else step
            named = named or not NAMES.isdisjoint(_WORD.findall(value)) and name not in ("body", "html", "article", "main")
        bad = bad or bool(_HIDDEN.search(attributes))
    return step, bad, named


_P_FENCE = frozenset(("p", "button", "td", "th", "table"))
_LISTED = frozenset().union(ENDS, *(x for pair in ENDS.values() for x in pair))
#: An element whose names mark furniture is none if it holds this share of the text of the page's article and main elements,
#: or of all text if there are none; other furniture doesn't count.
MOST = 0.5


def pieces(page: str) -> tuple[list[Piece], Paths]:
    """The page's runs of text in order. Open p elements end at block starts, list items and cells at their like.

    Counters and indices of the open elements are kept beside the stack, so time grows with the page and not with its depth.
    """
    out: list[Piece] = []
    paths = Paths()
    stack: list[tuple[str, bool, int, int]] = []  # name, furniture, path node, named element
    fences: list[int] = []
    listed: list[int] = []
    open_ = Counter()
    bad_open = 0
    within: list[int] = []  # per piece the innermost open named element
    outer, began, held = [], [], []  # per named element: the one around it, text before it, text in it
    block, at, total = 0, 0, np.zeros(2, np.int64)  # total: of all text and of that in an article or main

    def text(value: str) -> None:
        if value:
            lone = open_["header"] and (not (open_["article"] or open_["main"]) or not any(open_[h] for h in HEADING))
            out.append(Piece(stack[-1][2] if stack else 0, block, html.unescape(value), bool(bad_open or lone), bool(open_["a"])))
            within.append(stack[-1][3] if stack else -1)
            if not out[-1].furniture:
                total[0] += len(value.strip())
                total[1] += len(value.strip()) if open_["article"] or open_["main"] else 0

    def close(k: int) -> None:
        nonlocal block, bad_open
        blocks = False
        while len(stack) > k:
            name, bad, _, named = stack.pop()
            blocks = blocks or name in BLOCK
            open_[name] -= 1
            bad_open -= bad
            if named >= 0 and (not stack or stack[-1][3] != named):
                held[named] = total - began[named]
            if fences and fences[-1] >= len(stack):
                fences.pop()
            if listed and listed[-1] >= len(stack):
                listed.pop()
        block += blocks

    for m in _TOKEN.finditer(page):
        text(page[at : m.start()])
        at = m.end()
        name = m[3].lower() if m[3] else None
        if name is None:
            if m[1]:
                text(" ") if m[1].lower() in ("textarea", "iframe", "svg") else None
            continue
        if m[2]:
            if open_[name]:
                close(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name))
            elif name in BLOCK:
                block += 1
            continue
        if name == "br":
            text(" ")
            continue
        if name in BLOCK:
            block += 1
            if fences and stack[fences[-1]][0] == "p":
                close(fences[-1])
        if name in ENDS:
            likes, fence = ENDS[name]
            for i in reversed(listed):
                if stack[i][0] in fence:
                    break
                if stack[i][0] in likes:
                    close(i)
                    break
        if name in VOID or m[4].endswith("/") and name not in BLOCK:
            continue
        step, bad, named = _marked(name, m[4])
        node, around = (stack[-1][2], stack[-1][3]) if stack else (0, -1)
        if named:
            outer.append(around)
            began.append(total.copy())
            held.append(total * 0)
            around = len(outer) - 1
        if name in _P_FENCE:
            fences.append(len(stack))
        if name in _LISTED:
            listed.append(len(stack))
        stack.append((name, bad, paths.below(node, step, name) if name in BLOCK else node, around))
        open_[name] += 1
        bad_open += bad
    text(page[at:])
    close(0)
    which = int(total[1] > 0)
    small = [h[which] < MOST * total[which] or not total[which] for h in held]
    for k, o in enumerate(outer):
        small[k] = small[k] or o >= 0 and small[o]
    for p, k in zip(out, within, strict=True):
        p.furniture = p.furniture or k >= 0 and small[k]
    return out, paths


def _smooth(values: np.ndarray, reach: int = 1) -> np.ndarray:
    if len(values) < 3:
        return values
    kernel = np.exp(-np.arange(-reach, reach + 1) ** 2 / 2.0)
    weight = np.convolve(np.ones(len(values)), kernel, "same")
    return np.convolve(values, kernel, "same") / weight


def content(found: list[Piece], paths: Paths, share: float = 0.5) -> list[Piece]:
    """The pieces that belong to the main text.

    Paths of text outside furniture get text length and punctuation per occurrence, both without links, smoothed
    over the neighbouring paths in page order; the geometric mean of the two, as shares of their sums, must reach
    `share` of the paths' mean. The region is the nearest article or main above the best path, else the deepest
    element that all chosen paths share. In an article or main all text outside furniture counts; elsewhere only
    chosen paths and headings.
    """
    good = [p for p in found if not p.furniture and p.text.strip()]
    used = list(dict.fromkeys(p.path for p in good))
    if not used:
        return []
    place = {p: k for k, p in enumerate(used)}
    length, stops, blocks = np.zeros(len(used)), np.zeros(len(used)), [set() for _ in used]
    for p in good:
        k = place[p.path]
        blocks[k].add(p.block)
        if not p.link:
            length[k] += len(p.text.strip())
            stops[k] += len(_PUNCTUATION.findall(p.text))
    count = np.array([max(1, len(b)) for b in blocks])
    ratio, pause = _smooth(length / count), _smooth(stops / count)
    fused = np.sqrt((ratio + 1) / (ratio + 1).sum() * (pause + 0.1) / (pause + 0.1).sum())
    chosen = {p for p, v in zip(used, fused, strict=True) if v >= share * fused.mean()}
    # the best path is the one with most text behind its ratio
    best = used[int(np.argmax(fused * np.sqrt(length + 1)))]
    framed, heading = paths.has(frozenset(("article", "main"))), paths.has(HEADING)
    inside = [p for p in used if framed[p]]
    if inside and best not in inside and max(length[place[p]] for p in inside) * 4 >= length[place[best]]:
        best = max(inside, key=lambda p: length[place[p]])
    line = paths.line(best)
    tops = [k for k in line if paths.tag[k] in ("article", "main")]
    if tops:
        root, all_of = tops[-1], True
    else:
        depth, all_of = len(line) - 1 if len(line) > 1 else len(line), False
        shared, on = [0] * len(paths.up), set(line)  # depth down to which a path agrees with the best one
        for k in range(1, len(shared)):
            shared[k] = paths.depth[k] if k in on else shared[paths.up[k]]
        for p in sorted(chosen):
            n = min(shared[p], depth)
            if n >= 3:
                depth = n
        root = line[depth - 1] if depth else 0
    under = [not root]
    for k in range(1, len(paths.up)):
        under.append(k == root or under[paths.up[k]])
    return [p for p in good if under[p.path] and (all_of or p.path in chosen or heading[p.path])]


def main_text(page: str | None) -> str:
    """Blocks of the main text, white space inside a block as one space, joined by line feeds; empty if none."""
    found, paths = pieces(page or "")
    kept = {id(p) for p in content(found, paths)}
    blocks: dict[int, list[str]] = {}
    for p in found:
        # white space between two kept runs of a block belongs to it
        if id(p) in kept or not p.furniture and not p.text.strip():
            blocks.setdefault(p.block, []).append(p.text)
    lines = (" ".join("".join(b).split()) for b in blocks.values())
    return "\n".join(x for x in lines if x)


def extract(pages: DataFrame, key: str = "page_id", page: str = "html") -> DataFrame:
    """Columns page_id, url, text, n_chars (code points), one row per row; null or empty html has the empty text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x.as_py()) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col(page).cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))
