"""Main text of web pages by tag-path ratios.

A page is read as blocks of text, each with the path of elements from the root to it (inline elements left out, classes
and ids kept). Text length, share of link text and punctuation are summed for each distinct path and divided by the
number of its blocks. In page order these ratios are smoothed over neighbours in the same container, fused into one figure
for each path, and paths above a share of the largest are content, inside an article too. On a page that marks no article
the figure is multiplied by the share that the path's container has of the text of the fullest one, so that a sentence of
an advert beside the article goes, and so does a lead that stands in a small container of its own. Paths below elements
that never hold the article (menus, footers, forms, scripts) or whose class or id says so (adverts, comments, notices) are left out beforehand, unless a form or a named
element holds the article itself or, without one, most of the page's text; where the page marks an
article only what is inside counts. Short paragraphs, list items and cells beside content, in the same parent, belong to
it, and so do headings of an article above content, linked or not.

Edge cases: null, empty or markup-free html gives an empty text or the text itself as one block; unclosed and crossed
tags are closed where an enclosing element ends or a block of the same kind begins; nothing is cut, at any length;
equal pages give equal texts; other columns are left alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docgauge.llm.byte_bpe import ship

# HTML element names by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg math iframe object canvas xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var img br wbr".split())
ASIDE = frozenset("nav footer header aside menu button select option dialog head fieldset".split())
CLOSES_ITSELF = frozenset("p li dt dd tr td th option thead tbody tfoot".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
FLOW = HEADINGS | frozenset("p li dt dd blockquote pre td figcaption".split())
# Words in a class or id of what is not the article.
NOT_ARTICLE = frozenset(
    "ad ads advert advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar "
    "aside widget related recommended recommendations trending popular share sharing social comment comments commentlist disqus reply replies respond discussion "
    "cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login search form pagination pager skip toolbar copyright legal disclaimer".split()
)

# Elements that group parts of the container they stand in.
GROUPS = frozenset("ul ol dl li dd table thead tbody tfoot tr td th blockquote figure header hgroup".split())
LISTS = frozenset("ul ol dl".split())

#: Weights of a block and its neighbours in smoothing; least share of the largest fused ratio for content; largest share of link text.
SMOOTH, LEAST, LINKS = (0.2, 0.6, 0.2), 0.15, 0.5

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*>|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORD = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")
_NUMBER = re.compile(r"\d+")
_SPACE = re.compile(r"\s+")
_PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")


class Block:
    __slots__ = ("path", "parts", "links", "out", "named", "inside", "text")

    def __init__(self, path: tuple, out: bool, named: tuple, inside: bool):
        self.path, self.out, self.named, self.inside = path, out, named, inside
        self.parts: list[str] = []
        self.links = 0


def blocks_of(html: str) -> list[Block]:
    """The blocks of a page that hold text, in page order."""
    found: list[Block] = []
    # Name, step of the path, left out, numbers of the forms and elements named as no article around it, in an article.
    stack: list[tuple[str, str, bool, tuple, bool]] = []
    n_named = 0
    current: Block | None = None
    at, links, raw_end = 0, 0, {}

    def text(piece: str) -> None:
        nonlocal current
        if not piece or (current is None and piece.isspace()):
            return
        if current is None:
            path = tuple(s for n, s, *_ in stack if n not in INLINE)
            current = Block(path, *(stack[-1][2:] if stack else (False, (), False)))
            found.append(current)
        piece = unescape(piece) if "&" in piece else piece
        current.parts.append(piece)
        if links:
            current.links += len(piece)

    def pop_to(depth: int) -> None:
        nonlocal links
        while len(stack) > depth:
            links -= stack.pop()[0] == "a"

    search = _TOKEN.search
    while True:
        m = search(html, at)
        if m is None:
            text(html[at:])
            break
        text(html[at : m.start()])
        at = m.end()
        if m["cdata"]:
            text(m["cdata"])
        if not m["name"]:
            continue
        name = m["name"].lower()
        if name not in INLINE:
            current = None
        if m["close"]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    pop_to(k)
                    break
                if name in INLINE and stack[k][0] not in INLINE:
                    break
            continue
        if name == "br":
            text(" ") if current is not None else None
            continue
        if name in VOID or m["rest"].endswith("/") and name in RAW:
            continue
        if name in RAW:
            end = raw_end.get(name)
            if end is None:
                end = raw_end[name] = re.compile(rf"</{name}\s*>", re.I)
            stop = end.search(html, at)
            at = stop.end() if stop else len(html)
            current = None if name not in INLINE else current
            continue
        if name in CLOSES_ITSELF:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    pop_to(k)
                    break
                if stack[k][0] not in INLINE and stack[k][0] not in CLOSES_ITSELF:
                    break
        elif name not in INLINE:  # a block ends an open paragraph
            k = len(stack) - 1
            while k >= 0 and stack[k][0] in INLINE:
                k -= 1
            if k >= 0 and stack[k][0] == "p":
                pop_to(k)
        names = " ".join(a or b or c for a, b, c in _NAMED.findall(m["rest"])) if m["rest"] else ""
        words = {w.lower() for w in _WORD.findall(names)} if names else ()
        *_, out, named, inside = stack[-1] if stack else (False, (), False)
        out = out or (name in ASIDE and not (name == "header" and inside))
        free = name in ("html", "body", "article", "main") or name in HEADINGS or name == "header" and inside  # headings have ids made of their words
        if name == "form" or not free and words and not NOT_ARTICLE.isdisjoint(words):
            named, n_named = (*named, n_named), n_named + 1
        inside = inside or name in ("article", "main") or "main" in words and "role" in m["rest"].lower()
        stack.append((name, f"{name}.{names}" if names and name not in INLINE else name, out, named, inside))
        links += name == "a"
    for b in found:
        b.text = _SPACE.sub(" ", "".join(b.parts)).strip()
    found = [b for b in found if b.text]
    _leave_out(found)
    return found


def _leave_out(blocks: list[Block]) -> None:
    """Leaves out what is in a form or a named element, from the outermost in, but for those that hold the article.

    Such an element holds it if all text marked as an article is in it or, on a page without such text, more than half of
    the text; but not if it has no first heading, and one is outside with a tenth as much text (long comments).
    """
    within: dict[int, list[Block]] = {}
    for b in blocks:
        if not b.out:
            for k in b.named:
                within.setdefault(k, []).append(b)
    left = [b for b in blocks if not b.out]
    marked, size = sum(b.inside for b in left), sum(len(b.text) for b in left)
    first = sum(_first(b) for b in left)
    for k in sorted(within):  # numbers rise inwards
        own = [b for b in within[k] if not b.out]
        n, n_marked, n_first = sum(len(b.text) for b in own), sum(b.inside for b in own), sum(_first(b) for b in own)
        holds = n_marked == marked if marked else 2 * n > size
        if not holds or (first and not n_first and 10 * (size - n) >= n):
            for b in own:
                b.out = True
            marked, size, first = marked - n_marked, size - n, first - n_first


def _first(b: Block) -> bool:
    return bool(b.path) and b.path[-1].split(".")[0] == "h1"


def content(blocks: list[Block]) -> list[Block]:
    """The blocks of the main text."""
    kept = [b for b in blocks if not b.out]
    if any(b.inside for b in kept):
        kept = [b for b in kept if b.inside]
    if not kept:
        return []
    sums: dict[tuple, list[float]] = {}
    for b in kept:
        s = sums.setdefault(b.path, [0, 0, 0, 0])
        for k, v in enumerate((1, len(b.text), b.links, len(_PUNCTUATION.findall(b.text)))):
            s[k] += v
    ratio = {p: (max(0.0, c - links) / n, marks / n) for p, (n, c, links, marks) in sums.items()}
    lengths, marks = ([ratio[b.path][k] for b in kept] for k in (0, 1))
    smoothed: dict[tuple, list[float]] = {}
    last, (w0, w1, w2) = len(kept) - 1, SMOOTH
    where = {p: _container(p) for p in sums}
    held: dict[tuple, float] = {}
    if not kept[0].inside:
        for p, (_, c, links, _) in sums.items():
            k = _pool(where[p])
            held[k] = held.get(k, 0) + max(0.0, c - links)
    for i, b in enumerate(kept):
        # A neighbour in another container says nothing about this block, which then stands in for it.
        a, z = (k if 0 <= k <= last and where[kept[k].path] == where[b.path] else i for k in (i - 1, i + 1))
        fused = (w0 * lengths[a] + w1 * lengths[i] + w2 * lengths[z]) * (1 + w0 * marks[a] + w1 * marks[i] + w2 * marks[z]) ** 0.5
        s = smoothed.setdefault(b.path, [0.0, 0.0])
        s[0] += fused
        s[1] += 1
    fused = {p: total / n * _weight(held, where[p]) for p, (total, n) in smoothed.items()}
    least = LEAST * max(fused.values())
    chosen = {p for p, f in fused.items() if f >= least and sums[p][2] <= LINKS * sums[p][1]}
    parents = {where[p] for p in chosen}
    above = {p[:k] for p in parents for k in range(len(p) + 1)}

    def beside(b: Block) -> bool:
        name = b.path[-1].split(".")[0] if b.path else ""
        if name in HEADINGS and b.inside and where[b.path] in above:
            return True
        return name in FLOW and where[b.path] in parents and b.links <= LINKS * max(1, sum(map(len, b.parts)))

    return [b for b in kept if b.path in chosen or beside(b)]


def _pool(container: tuple) -> tuple:
    """A container's path without sections' names and numbers in names, so that the sections of a text count as one."""
    return tuple("section" if step.startswith("section.") else _NUMBER.sub("", step) if "." in step else step for step in container)


def _weight(held: dict[tuple, float], container: tuple) -> float:
    """On pages that mark no article: a container's own text as a share of the fullest container's."""
    return held[_pool(container)] / (max(held.values()) or 1) if held else 1.0


def _container(path: tuple) -> tuple:
    """The path of what holds a block, without lists, tables and the like; a list with a class or id is a container."""
    k = len(path) - 1
    while k > 0 and (name := path[k - 1].split(".")[0]) in GROUPS and not (name in LISTS and path[k - 1] != name):
        k -= 1
    return path[: max(0, k)]


def main_text(html: str | None) -> str:
    return "\n\n".join(b.text for b in content(blocks_of(html or "")))


def extract(pages: DataFrame, html_col: str = "html", into: str = "text") -> DataFrame:
    """pages without the html, and its main text."""
    ship(pages.sparkSession)
    if into in pages.columns and into != html_col:
        raise ValueError(f"there is a column {into} already")
    at = pages.columns.index(html_col)
    rest = [f for f in pages.schema.fields if f.name != html_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                new = pa.array([main_text(x) for x in part.column(at).to_pylist()], pa.string())
                own = [c for i, c in enumerate(part.columns) if i != at]
                yield pa.RecordBatch.from_arrays([*own, new], names=[*[f.name for f in rest], into])

    return pages.mapInArrow(run, T.StructType([*rest, T.StructField(into, T.StringType())]))


def query(spark, sf_dir: str) -> DataFrame:
    texts = extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
