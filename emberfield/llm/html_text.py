"""Main text of web pages: the maximum-scoring run of words and tags.

Words score positive and tags negative, by weights counted on labelled pages. One linear scan per page finds the
best contiguous region; its blocks, without nested boilerplate, are the text.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from html import unescape
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberfield.llm.cluster import map_arrow

# Labelled pages that weights are counted on at most (those of least hash).
SAMPLE_PAGES = 2_000

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()
)
BOILERPLATE = frozenset(
    "head nav header footer aside form button select dialog menu script style textarea title noscript template svg iframe object canvas xmp noembed noframes".split()
)
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar alert dialog".split())
# Words of class and id names, whole between separators, that mark boilerplate.
BOILERPLATE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adbox adsense sponsor sponsored sponsors promo promos promotion banner banners "
    "nav navbar navigation menu menus topnav breadcrumb breadcrumbs sidebar sidebars aside footer footers header headers masthead topbar "
    "cookie cookies consent gdpr notice notices disclaimer popup modal overlay newsletter subscribe subscription signup login paywall "
    "comment comments commentlist disqus reply replies respond discussion share sharing social related recommended recommendations widget widgets "
    "toolbar pagination pager skip tags toc copyright legal".split()
)
# Words before such a word that tell of a page's layout.
STATES = frozenset("has have with without no non not hide".split())
CONTENT = ("article", "main")
# Boilerplate that may hold a whole page, and the kinds that stand in a head.
WRAPPERS = frozenset(("form",))
HEAD = frozenset("title style script noscript template meta link base".split())
# An element named as boilerplate is a wrapper if it has so many times the words that stand free around it.
MOST_WORDS = 4

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*(?:>|\Z))",
    re.DOTALL,
)
NAMED = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?(?=[\s/>"']|$)""", re.IGNORECASE)
PARTS = re.compile(r"[a-z]+|[A-Z][a-z]*|\d+")

# Scores of tags that no labelled page has (inline, others) and of a word; bounds of learned ones.
UNSEEN_INLINE, UNSEEN_BLOCK, WORD = -0.1, -1.0, 0.7
LEAST_INLINE, LEAST_BLOCK, MOST = -0.5, -12.0, -0.02


def inline(kind: str) -> bool:
    return kind.removeprefix("/") in INLINE


def boilerplate(name: str, rest: str) -> str:
    """Whether an element is no part of an article: "sure" by its name, "named" by its class, id or role, or ""."""
    if name in BOILERPLATE:
        return "sure" if name not in WRAPPERS else "named"
    if name in ("html", "body") or "=" not in rest and "hidden" not in rest.lower():
        return ""
    for key, *values in NAMED.findall(rest):
        key, value = key.lower(), "".join(values)
        if key == "hidden" or key == "aria-hidden" and value == "true":
            return "sure"
        if key == "role" and value.lower() in BOILERPLATE_ROLES:
            return "named"
        if key in ("class", "id") and any(listed(v) for v in value.split()):
            return "" if name in CONTENT else "named"
    return ""


def listed(value: str) -> bool:
    """Whether a class or id has a boilerplate word that doesn't follow a word such as "has" or "no"."""
    parts = [p.lower() for p in PARTS.findall(value)]
    return any(p in BOILERPLATE_NAMES and before not in STATES for before, p in zip(["", *parts], parts))


@dataclass
class Drop:
    """The items of a boilerplate element, from its tag to its end tag."""

    start: int
    end: int
    name: str
    sure: bool
    closed: bool = False


def parsed(page: str) -> tuple[list[tuple[str, str]], list[Drop]]:
    """(tag kind or "", text or "") in page order, and the boilerplate elements.

    An end tag closes the nearest open element of its name with all in it; other stray end tags close nothing; what is
    never closed runs to the end of what holds it.
    """
    out: list[tuple[str, str]] = []
    drops: list[Drop] = []
    open_: list[tuple[str, Drop | None]] = []

    def close(at: int, closed: bool) -> str:
        name, drop = open_.pop()
        if drop:
            drop.end, drop.closed = at, closed
        return name

    at = 0
    while at < len(page):
        m = TAG.search(page, at)
        if m is None or m.start() > at:
            text = page[at : m.start() if m else len(page)]
            out.append(("", unescape(text) if "&" in text else text))
        if m is None:
            break
        at = m.end()
        name = m["name"]
        if name is None:
            if m.group().startswith("<![CDATA["):
                out.append(("", m.group()[9:].removesuffix("]]>")))
            continue
        name = name.lower()
        if m["close"]:
            if any(n == name for n, _ in open_):
                while open_[-1][0] != name:
                    close(len(out), False)
                close(len(out) + 1, True)
                out.append(("/" + name, ""))
            continue
        if name in ("p", "li") and open_ and open_[-1][0] == name:
            close(len(out), True)  # these end where the next one begins
        how = boilerplate(name, m["rest"])
        drop = Drop(len(out), len(out) + 1, name, how == "sure", True) if how else None
        if drop:
            drops.append(drop)
        out.append((name, ""))
        if name in RAW:  # its content is no markup; it ends at its own end tag only
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.IGNORECASE).search(page, at)
            at = end.end() if end else len(page)
        elif name not in VOID and not m["rest"].endswith("/>"):
            open_.append((name, drop))
    while open_:
        close(len(out), False)
    return out, drops


def close_at_content(seen: list[tuple[str, str]], drops: list[Drop]) -> None:
    """End boilerplate elements that are never closed where content starts in them."""
    wide = [d for d in drops if not d.closed]
    if not wide:
        return
    in_head = HEAD | {"/" + k for k in HEAD} | {""}
    starts = [[k for k, x in enumerate(seen) if x[0] in kinds] for kinds in (("body", *CONTENT), ("h1", "p"))]
    beyond_head = [k for k, x in enumerate(seen) if x[0] not in in_head]
    for d in wide:
        for places in [beyond_head] if d.name == "head" else starts:
            first = bisect_right(places, d.start)
            if first < len(places) and places[first] < d.end:
                d.end = places[first]
                break


def items(page: str) -> list[tuple[str, str, bool]]:
    """(tag kind or "", text or "", dropped) in page order; texts are decoded, tags are "p", "/p" and so on.

    What stands in boilerplate elements is marked as dropped, with these exceptions. One that is never closed ends
    where content starts. One so named only by class, id or role, or a form, is a wrapper and stays if it holds the
    page's label (a single main, or a single article of more words than stand free around it) or nearly all words.
    """
    seen, drops = parsed(page)
    close_at_content(seen, drops)
    sure = [d for d in drops if d.sure]
    named = [d for d in drops if not d.sure]

    def depth(among: list[Drop]) -> list[int]:
        """How many of the elements hold each item."""
        steps = [0] * (len(seen) + 1)
        for d in among:
            steps[d.start] += 1
            steps[d.end] -= 1
        return list(accumulate(steps))

    def marked() -> list[tuple[str, str, bool]]:
        return [(kind, text, n > 0) for (kind, text), n in zip(seen, depth(drops))]

    out = marked()
    if not named:
        return out
    if any(x[0] in CONTENT and x[2] for x in out):
        drops = sure + open_labels(seen, sure, named, depth)
        out = marked()
    start, end = labelled(out) or (0, len(seen))
    inside = sorted((d for d in drops if not d.sure and start <= d.start and d.end <= end), key=lambda d: (d.start, -d.end))
    if inside:
        upto = words_upto(seen, depth(sure))
        free = words_upto(seen, [x[2] for x in out])
        for d in inside:
            if upto[d.end] - upto[d.start] > MOST_WORDS * (free[end] - free[start]):
                drops = [x for x in drops if x is not d]
                out = marked()
                free = words_upto(seen, [x[2] for x in out])
    return out


def words_upto(seen: list[tuple[str, str]], dropped: list) -> list[int]:
    """The number of words that are not dropped before each item, and of all."""
    return list(accumulate((0 if kind or out else len(text.split()) for (kind, text), out in zip(seen, dropped)), initial=0))


def open_labels(seen: list[tuple[str, str]], sure: list[Drop], named: list[Drop], depth: Callable[[list[Drop]], list[int]]) -> list[Drop]:
    """The named elements without those that hold the page's label."""
    gone = depth(sure)

    def outermost(label: str) -> int | None:
        """The label that the fewest named elements hold, if it is one."""
        held = depth(named)
        places = [(held[k], k) for k, x in enumerate(seen) if x[0] == label and not gone[k]]
        fewest = min(places, default=(0, 0))[0]
        least = [k for n, k in places if n == fewest]
        return least[0] if len(least) == 1 else None

    main = outermost("main")
    if main is not None:
        named = [d for d in named if not d.start <= main < d.end]
    article = outermost("article")
    if article is None:
        return named
    inner = [d for d in named if not d.start <= article < d.end]
    if len(inner) < len(named):
        start, end = 0, len(seen)
        if main is not None and main < article < element_end(seen, main):
            start, end = main, element_end(seen, main)
        own = words_upto(seen, depth(sure + inner))
        free = words_upto(seen, depth(sure + named))
        if own[element_end(seen, article)] - own[article] > free[end] - free[start]:
            return inner
    return named


def element_end(seen: list[tuple], start: int) -> int:
    """The item of the end tag of the element that starts at an item, or the number of items."""
    label, depth = seen[start][0], 0
    for k in range(start, len(seen)):
        depth += (seen[k][0] == label) - (seen[k][0] == "/" + label)
        if not depth:
            return k
    return len(seen)


def labelled(seen: list[tuple[str, str, bool]]) -> tuple[int, int] | None:
    """The item range inside a page's single article (or else main) element, None without such a label."""
    for label in CONTENT:
        opens = [k for k, x in enumerate(seen) if x[0] == label and not x[2]]
        if len(opens) == 1:
            return opens[0] + 1, element_end(seen, opens[0])
    return None


def label_counts(page: str) -> Counter | None:
    """Counts of (kind, inside) over a labelled page; None for others.

    The labelling element's own tags count as outside, so leaving or entering it has its price.
    """
    seen = items(page)
    region = labelled(seen)
    if region is None:
        return None
    counts: Counter = Counter()
    for k, (kind, text, dropped) in enumerate(seen):
        if not dropped:
            counts[kind or "#word", region[0] <= k < region[1]] += 1 if kind else len(text.split())
    return counts


def weights_of(counts: dict[tuple[str, bool], int]) -> dict[str, float]:
    """Tag scores: log odds of a kind inside and outside the labelled regions, kept negative; the word's is positive."""
    total = {side: sum(n for (_, s), n in counts.items() if s == side) + 1 for side in (True, False)}
    out = {}
    for kind in sorted({k for k, _ in counts}):
        odds = float(np.log((counts.get((kind, True), 0) + 0.5) / total[True]) - np.log((counts.get((kind, False), 0) + 0.5) / total[False]))
        out[kind] = min(max(odds, 0.3), 1.0) if kind == "#word" else min(max(odds, LEAST_INLINE if inline(kind) else LEAST_BLOCK), MOST)
    return out


def best_run(seen: list[tuple[str, str, bool]], weights: dict[str, float]) -> tuple[int, int]:
    """The item range of the best score."""
    word = weights.get("#word", WORD)
    best, best_range = 0.0, (0, 0)
    run, start = 0.0, 0
    for k, (kind, text, dropped) in enumerate(seen):
        if run <= 0:
            run, start = 0.0, k
        if not dropped:
            run += weights.get(kind, UNSEEN_INLINE if inline(kind) else UNSEEN_BLOCK) if kind else word * len(text.split())
        if run > best:
            best, best_range = run, (start, k + 1)
    return best_range


def region(seen: list[tuple[str, str, bool]], weights: dict[str, float]) -> tuple[int, int]:
    """The item range of a page's text: the best-scoring run.

    A label (a single article or main) only chooses among runs and sets the ends: the best run that meets it, or else the
    best one inside it, becomes the label's whole inside. A label without any run leaves the page's best run.
    """
    best, label = best_run(seen, weights), labelled(seen)
    if label is None:
        return best
    start, end = label
    meets = max(best[0], start) < min(best[1], end)
    inner = best if meets else best_run(seen[start:end], weights)
    return label if inner[0] < inner[1] else best


def main_text(page: str, weights: dict[str, float]) -> str:
    """The text of the best region: its blocks with white space made single, joined by one space."""
    seen = items(page)
    blocks: list[str] = []
    held: list[str] = []
    for kind, text, dropped in seen[slice(*region(seen, weights))]:
        if kind and not inline(kind):
            blocks.append("".join(held))
            held = []
        elif not kind and not dropped:
            held.append(text)
    blocks.append("".join(held))
    return " ".join(b for b in (" ".join(x.split()) for x in blocks) if b)


def fit(pages: DataFrame, sample_pages: int = SAMPLE_PAGES, page_id: str = "page_id", html: str = "html") -> dict[str, float]:
    """Weights from at most ``sample_pages`` pages that label themselves with an article or main element."""
    chosen = pages.select(F.col(page_id).alias("page_id")).filter("page_id is not null").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(sample_pages)
    sample = pages.select(F.col(page_id).alias("page_id"), F.col(html).cast("string").alias("html")).filter("html is not null").join(F.broadcast(chosen), "page_id").select("html")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for page in batch.column(0).to_pylist():
                total.update(label_counts(page) or {})
        keys = sorted(total)
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.string()), pa.array([s for _, s in keys], pa.bool_()), pa.array([total[k] for k in keys], pa.int64())], ["kind", "inside", "n"])

    counts = map_arrow(sample, work, "kind string, inside boolean, n long").groupBy("kind", "inside").agg(F.sum("n").alias("n"))
    return weights_of({(r["kind"], r["inside"]): r["n"] for r in counts.collect()})  # one row per tag kind of the sample


def extract(pages: DataFrame, weights: dict[str, float], page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars: one row per page, without a shuffle.

    Null and empty pages, and pages without words outside boilerplate, have empty text. A page without labels or
    markup is its words. Repeated rows give repeated results; null page_id and url stay null; other columns are not
    read. Pages are read whole and nothing is cut off.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                texts = [main_text(p or "", weights) for p in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    frame = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    return map_arrow(frame, work, "page_id long, url string, text string, n_chars long")
