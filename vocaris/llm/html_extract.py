"""HTML extraction by the maximum-scoring contiguous subsequence.

A page is cut into tokens: runs of words, and tags. A word scores by where it stands in the markup,
a tag scores negative. The contiguous region of greatest score (one linear scan) is the content;
runs in it that lie in places which the weights rule out (an aside, an advert, reader comments) are
left out, and the rest is split into blocks.

Weights are log odds, learnt from pages that label themselves by one ``<article>`` (or, without any,
one ``<main>``) element. Inside it every element and class counts as content. Outside it, a word
counts for the outermost element around it that doesn't hold the label: a menu's list items are no
content because of the menu, and say nothing about lists elsewhere. Blocks that are links from end
to end count too. ``PRIOR_STRONG`` and ``PRIOR_WEAK`` are counts to start from, for what HTML itself
or common class names call no content; the label is read for learning alone and plays no part in
extraction.

Learning counts labelled pages, takes ``Settings.sample_pages`` of them (hash of the page id) and
keeps elements and classes found on ``Settings.least_pages`` of these or more; every page is
extracted whole.

Defined cases: null or empty html, or no words, gives an empty text; unclosed and stray tags are
tolerated; a comment or raw-text element that never ends runs to the end; repeated rows are each
extracted; without labelled pages the weights are their priors; null ids are sampled like any other
value; other columns pass through or, if named like an output column, are replaced.
"""

from __future__ import annotations

import html as html_module
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vocaris.llm.frames import append_columns, map_arrow, without


@dataclass(frozen=True)
class Settings:
    sample_pages: int = 4000
    least_pages: int = 2
    seed: int = 23
    base: float = 1.0  # score of a word about whose place nothing is known
    most: float = 2.0  # added at best by a place that speaks for content
    least: float = -6.0  # of one place that speaks against it
    floor: float = -0.25  # score of a word at worst, so that content goes on behind a long aside
    ruled_out: float = -3.0  # places at or below are left out inside the region
    tag_cost: float = 0.02  # least cost of a tag
    tag_most: float = 0.5


SETTINGS = Settings()

# HTML's elements by kind, and words that class names use for what is no content.
RAW = "script|style|noscript|template|svg|textarea|select|iframe|object|canvas|title"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
CELLS = frozenset(("td", "th"))
LABELS = ("article", "main")
SECTIONS = frozenset(("article", "main", "section"))
GENERIC = frozenset(("div", "span", "section", "center"))
PRIOR_STRONG = frozenset(
    "nav footer aside form dialog menu head fieldset header hidden "
    ".ad .ads .advert .adverts .advertisement .advertising .breadcrumb .breadcrumbs .comments .cookie .cookies .disqus .footer .gdpr .masthead .nav .navbar .navigation .newsletter .pagination .sidebar .sponsored .topbar "
    "role=navigation role=banner role=contentinfo role=complementary role=search role=dialog role=alert role=menu role=menubar".split()
)
PRIOR_WEAK = frozenset(
    ".adv .sponsor .promo .promotion .banner .header .menu .consent .notice .notices .popup .modal .overlay .subscribe .signup .login .share .sharing .social .related .recommended .comment .respond .reply .replies .toolbar .pager".split()
)
STRONG, WEAK = 400, 20  # words that a prior stands for

_TOKEN = re.compile(
    r"(?P<skip><!--.*?(?:-->|\Z)|<(?P<raw>" + RAW + r")\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=raw)\s*+>|\Z)|<[!?][^>]*+(?:>|\Z))"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*+(?:>|\Z))"
    r"|(?P<text>[^<]++|<)",
    re.S | re.I,
)
_ATTR = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")


def prior(mark: str) -> int:
    """Words outside content that a mark starts with. A compound class name takes the prior of a part
    that is strong, or of parts that are all known."""
    if mark in PRIOR_STRONG:
        return STRONG
    if mark in PRIOR_WEAK:
        return WEAK
    if mark.startswith("."):
        parts = {"." + p for p in re.split(r"[^a-z0-9]+", mark[1:]) if p}
        if len(parts) > 1:
            if parts & PRIOR_STRONG:
                return STRONG
            if parts <= PRIOR_WEAK:
                return WEAK
    return 0


@dataclass
class Element:
    """An open element: what speaks for or against it, and whether it holds a label."""

    name: str
    marks: tuple[str, ...]
    holds: set[str] = field(default_factory=set)


@dataclass
class Run:
    """A piece of text, the block it belongs to, and the elements it lies in, outermost first."""

    text: str
    block: int
    path: tuple[Element, ...]
    link: bool


@dataclass
class Tag:
    """A tag and the elements around what it begins or ends."""

    name: str
    path: tuple[Element, ...]


def marks_of(name: str, attrs: str, in_section: bool) -> tuple[str, ...]:
    found: list[str] = []
    if "=" in attrs:
        for key, a, b, c in _ATTR.findall(attrs):
            key, value = key.lower(), (a or b or c).lower()
            if key in ("class", "id"):
                found += ["." + v for v in value.split()]
            elif key == "role":
                found.append("role=" + value)
            elif key == "aria-hidden" and value == "true":
                found.append("hidden")
    if re.search(r"\shidden(?=[\s/>=])", attrs, re.I):
        found.append("hidden")
    if name in BLOCKS and not (found and name in GENERIC):
        found.append("section header" if name == "header" and in_section else name)
    return tuple(dict.fromkeys(found))


def tokens(page: str) -> list[Run | Tag]:
    """Runs of text, and the tags between them, in page order."""
    out: list[Run | Tag] = []
    path: tuple[Element, ...] = ()
    block, links = 0, 0
    for m in _TOKEN.finditer(page):
        text = m["text"]
        if text is not None:
            out.append(Run(text, block, path, links > 0))
            continue
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if name in BLOCKS:
            block += 1
        elif name in CELLS:
            out.append(Run(" ", block, path, links > 0))
        if m["close"]:
            for k in range(len(path) - 1, -1, -1):
                if path[k].name == name:
                    links -= sum(e.name == "a" for e in path[k:])
                    path = path[:k]
                    break
            out.append(Tag(name, path))
            continue
        if name in ("p", "li", "a") and path and path[-1].name == name:
            path, links = path[:-1], links - (name == "a")  # implied end
        out.append(Tag(name, path))
        if name not in VOID and not (m["attrs"].endswith("/>") and name not in BLOCKS):
            if name in LABELS:
                for e in path:
                    e.holds.add(name)
            path += (Element(name, marks_of(name, m["attrs"], any(e.name in SECTIONS for e in path))),)
            links += name == "a"
    return out


def link_blocks(found: list[Run | Tag]) -> set[int]:
    """Blocks whose words are all inside links."""
    linked: dict[int, bool] = {}
    for t in found:
        if isinstance(t, Run) and not t.text.isspace():
            linked[t.block] = linked.get(t.block, True) and t.link
    return {b for b, all_ in linked.items() if all_}


@dataclass
class Weights:
    """Log odds of marks, of link blocks and of tags."""

    settings: Settings = SETTINGS
    marks: dict[str, float] = field(default_factory=dict)
    links: float = -3.0
    tags: dict[str, float] = field(default_factory=dict)
    known: dict[tuple[str, ...], tuple[float, float]] = field(default_factory=dict, compare=False)

    def mark(self, mark: str) -> float:
        w = self.marks.get(mark)
        return -log(prior(mark) + 1) if w is None else w

    def place(self, path: tuple[Element, ...]) -> tuple[float, float]:
        """What speaks for a place (the best of its marks) and against it (all of them)."""
        key = tuple(m for e in path for m in e.marks)
        found = self.known.get(key)
        if found is None:
            if len(self.known) > 50_000:
                self.known.clear()
            each = [self.mark(m) for m in dict.fromkeys(key)]
            found = self.known[key] = (max([0.0, *each]), sum(w for w in each if w < 0))
        return found


def labels_of(found: list[Run | Tag]) -> str | None:
    """The element that labels a page's content: its only article or, without any, its only main."""
    for name in LABELS:
        n = len({id(e) for t in found if isinstance(t, Run) for e in t.path if e.name == name})
        if n:
            return name if n == 1 else None
    return None


def counts(page: str) -> Counter[tuple[str, str, bool]]:
    """Words by (mark, content or not), words of link blocks, and tags, of a page that labels itself."""
    out: Counter[tuple[str, str, bool]] = Counter()
    found = tokens(page)
    label = labels_of(found)
    if label is None:
        return out
    links = link_blocks(found)
    for t in found:
        at = next((k for k, e in enumerate(t.path) if e.name == label), None)
        inside = at is not None
        if isinstance(t, Tag):
            if t.name != label and (inside or all(label in e.holds for e in t.path)):  # a menu's own tags say nothing about lists
                out["tag", t.name, inside] += 1
            continue
        n = len(t.text.split())
        if not n:
            continue
        if inside:
            within = {m for e in t.path[at:] for m in e.marks} - {label}
            if any(prior(m) == STRONG for m in within):
                continue  # the label says nothing about an aside in it
        else:
            within = set(next((e.marks for e in t.path if label not in e.holds), ()))
        if t.block in links:
            out["links", "", inside] += n
        for m in within:
            out["mark", m, inside] += n
    return out


def weights_of(totals: dict[tuple[str, str, bool], int], settings: Settings = SETTINGS) -> Weights:
    """Smoothed log odds within their bounds; a tag never scores above its least cost."""
    out = Weights(settings)
    for kind, name in {(k, n) for k, n, _ in totals}:
        start = prior(name) if kind == "mark" else WEAK if kind == "links" else 0
        odds = log((totals.get((kind, name, True), 0) + 1) / (totals.get((kind, name, False), 0) + start + 1))
        if kind == "tag":
            out.tags[name] = max(-settings.tag_most, min(odds, -settings.tag_cost))
        elif kind == "links":
            out.links = max(settings.least, min(odds, 0.0))
        else:
            out.marks[name] = max(settings.least, min(odds, settings.most))
    return out


def scores(found: list[Run | Tag], weights: Weights) -> list[float]:
    s, links, out = weights.settings, link_blocks(found), []
    for t in found:
        if isinstance(t, Tag):
            out.append(weights.tags.get(t.name, -s.tag_cost))
            continue
        n = len(t.text.split())
        if n:
            up, down = weights.place(t.path)
            out.append(n * max(s.floor, s.base + up + down + (weights.links if t.block in links else 0.0)))
        else:
            out.append(0.0)
    return out


def best_region(values: list[float]) -> tuple[int, int]:
    """The contiguous stretch of greatest sum, first and shortest; empty if no sum is above 0."""
    best, span, total, start = 0.0, (0, 0), 0.0, 0
    for k, v in enumerate(values):
        if total <= 0:
            total, start = 0.0, k
        total += v
        if total > best:
            best, span = total, (start, k + 1)
    return span


def extract_text(page: str | None, weights: Weights) -> str:
    found = tokens(page or "")
    blocks: dict[int, list[str]] = {}
    for t in found[slice(*best_region(scores(found, weights)))]:
        if isinstance(t, Run) and weights.place(t.path)[1] > weights.settings.ruled_out:
            blocks.setdefault(t.block, []).append(t.text)
    lines = (" ".join(html_module.unescape("".join(parts)).split()) for parts in blocks.values())
    return "\n".join(x for x in lines if x)


def learn(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", settings: Settings = SETTINGS) -> Weights:
    labelled = pages.where(F.col(html_col).rlike(r"(?i)<(article|main)[\s>]"))
    share = min(1.0, settings.sample_pages / max(1, labelled.count()))
    picked = labelled.where(F.pmod(F.xxhash64(id_col, F.lit(settings.seed)), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).select(html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: Counter[tuple[str, str, bool]] = Counter()
        seen: Counter[tuple[str, str, bool]] = Counter()
        for batch in batches:
            for page in batch.column(0):
                found = counts(page.as_py() or "")
                totals.update(found)
                seen.update(found.keys())
        keys = list(totals)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([k[2] for k in keys], pa.bool_()), pa.array([totals[k] for k in keys], pa.int64()), pa.array([seen[k] for k in keys], pa.int64())],
            names=["kind", "name", "content", "n", "pages"],
        )

    counted = picked.mapInArrow(run, "kind string, name string, content boolean, n long, pages long")
    # what the bounded sample has
    summed = counted.groupBy("kind", "name", "content").agg(F.sum("n").alias("n"), F.sum("pages").alias("pages")).where(F.col("pages") >= settings.least_pages)
    return weights_of({(r.kind, r.name, r.content): r.n for r in summed.collect()}, settings)


def extract(pages: DataFrame, weights: Weights, html_col: str = "html", carry: list[str] | None = None) -> DataFrame:
    """pages (or only its columns named in carry) with text and n_chars."""
    rest = without(pages, "text", "n_chars")
    carried = [f for f in rest.schema.fields if carry is None or f.name in carry]
    names = [f.name for f in carried]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [extract_text(p.as_py(), weights) for p in part.column(part.schema.names.index(html_col))]
                yield append_columns(part.select(names), text=pa.array(texts, pa.string()), n_chars=pa.array([len(t) for t in texts], pa.int64()))

    return map_arrow(rest, run, [*carried, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
