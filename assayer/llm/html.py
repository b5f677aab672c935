"""Main text of web pages: the best-scoring contiguous region of words and tags.

Words score positive and tags negative, with weights learned from labelled pages; one linear scan (best sum of a
contiguous stretch) finds the content region, and inside it the elements that are never content are left out. An element
that only its class, id, role or kind (a form, say) tells apart is content after all if no article stands outside of such elements and
its own words outweigh the best region of the rest by far: then it wraps the page. Where a page marks articles, and the best region
has not APART_COST words more outside of them than they hold, words outside count like those of elements told apart, and the region that is then
best grows to its article's bounds, but not over runs of links: a menu at an article's edge stays out, with or without a name. Inside an article a name tells an element apart only if
all its parts are such names or words of layout: ``cookie-banner`` does, ``social-history`` doesn't. Pages
whose markup names its article label themselves, so the weights are log-ratios of how often a kind of token stands
inside and outside of articles, over at most SAMPLE pages; with too few of them the default weights hold.

Defined results: null or empty html gives an empty text; unclosed and stray tags are taken as written; repeated rows get
equal results; extra columns are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.text import chunks, emit, rows

SAMPLE = 2000
#: Element names.
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
_RAW = ("script", "style", "noscript", "template", "textarea", "iframe", "object")
_NEVER = frozenset("head title nav aside footer form button select dialog menu canvas video audio map annotation annotation-xml".split())
#: Of those, the ones that may turn out to wrap the page, as may any element told apart by its attributes.
_MAY_WRAP = frozenset("aside footer form dialog header".split())
_NEVER_OUTSIDE = frozenset(["header"])
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_UNWANTED = frozenset(
    "ad ads advert advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert sidebar menu nav "
    "navbar navigation breadcrumb breadcrumbs footer share sharing social related recommended newsletter "
    "subscribe signup login popup modal widget pagination pager skip".split()
)
_COMMENTS = frozenset("comment comments commentlist reply replies disqus".split())
_UNWANTED_OUTSIDE = frozenset("header masthead topbar toolbar search".split())
#: Words of layout that say nothing of what an element holds.
_LAYOUT = frozenset(
    "article area bar block body bottom box btn button buttons card col column container content desktop div entry footer group holder icon icons "
    "inline inner item items js large left link links list main mobile module outer page panel post posts right row section site slot small sticky "
    "story text thread top unit widget wrap wrapper".split()
)
_NAME = re.compile(r"<(/?)([a-z][a-z0-9:-]*)", re.I)
_CLOSE = {x: re.compile(rf"</{x}\s*>", re.I) for x in (*_RAW, "svg")}
_STOP = re.compile(r">|=\s*([\"'])")
_NAMED = re.compile(r"""(?<![\w-])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_SPLIT = re.compile(r"[^a-z]+")

WORD, LINKED, APART = 0, 1, 2  # kinds of words: plain, in a link, in an element that is never content
DEFAULT_TAG = -0.4
#: So many links in neighbouring blocks of which more than half of the words are linked make a menu.
MENU_LINKS = 3
#: An element told apart wraps the page if its own words score more than so many times the best region of the rest, and so much besides.
APART_TIMES, APART_COST = 4, 20
#: The same for elements named as readers' comments, which may well be longer than the story.
COMMENT_TIMES = 100
DEFAULT = {"word": 1.0, "word in link": 0.1} | dict.fromkeys("article b blockquote br code em h1 h2 h3 h4 h5 h6 header i li main ol p pre section span strong ul".split(), -0.05)


def _marks(page: str) -> Iterator[tuple[int, int, bool, str | None, str]]:
    """(start, end, closing, name, attributes) of tags; comments, declarations and raw elements have no name. One scan, whatever is unclosed."""
    at, size, last = 0, len(page), {q: page.rfind(q) for q in "\"'"}
    while (start := page.find("<", at)) >= 0:
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = size if end < 0 else end + 3
            yield start, at, False, None, ""
        elif page[start + 1 : start + 2] in ("!", "?"):
            if (end := page.find(">", start)) < 0:
                return
            at = end + 1
            yield start, at, False, None, ""
        elif m := _NAME.match(page, start):
            if (end := _tag_end(page, m.end(), last)) < 0:
                return
            name, attributes, at = m[2].lower(), page[m.end() : end], end + 1
            if not m[1] and name in _CLOSE and not (name == "svg" and attributes.endswith("/")):
                close = _CLOSE[name].search(page, at)
                at = close.end() if close else size
                yield start, at, False, None, ""
            else:
                yield start, at, bool(m[1]), name, attributes
        else:
            at = start + 1


def _tag_end(page: str, at: int, last: dict[str, int]) -> int:
    """Place of the sign that closes a tag, -1 if there is none; a value's quote that nothing closes is an ordinary sign."""
    while m := _STOP.search(page, at):
        if not m[1]:
            return m.start()
        at = m.end()
        if m.end() <= last[m[1]]:
            at = page.find(m[1], m.end()) + 1
    return -1


def _parse(page: str) -> tuple[list[tuple[str, object, int, bool]], list[tuple[int, int]]]:
    """(kind, value, innermost element told apart, inside an article) in page order, and of each such element its parent and
    how many times the best region of the rest it must outweigh to wrap the page (0: it can't).

    kind is 'text', 'open' or 'close'; elements told apart count from 1, 0 is none.
    """
    found, elements = [], [(0, APART_TIMES)]
    at, article = 0, 0
    apart: list[list] = []  # name, open tags of that name, article depth outside, number
    named: dict[str, list[int]] = {}  # places in ``apart`` by name

    def leave(n: int) -> None:
        while len(apart) > n:
            named[apart.pop()[0]].pop()

    for start, end, closing, name, attributes in _marks(page):
        inner = apart[-1][3] if apart else 0
        if start > at:
            found.append(("text", page[at:start], inner, article > 0))
        at = end
        if name is None:
            continue
        times = 0 if closing or name in _VOID else _apart(name, attributes, article > 0)
        if name in ("article", "main") and times != COMMENT_TIMES and not named.get(name):
            article = max(0, article + (-1 if closing else 1))
            while closing and apart and apart[-1][2] > article:  # left open inside the article
                leave(len(apart) - 1)
        elif name == "body":
            leave(0)
        elif closing:
            if places := named.get(name):
                held = apart[places[-1]]
                held[1] -= 1
                if not held[1]:
                    article = min(article, held[2])
                    leave(places[-1])
        elif times:
            around = elements[inner][1]
            elements.append((inner, max(times, around) if times > 0 and around > 0 else 0))
            named.setdefault(name, []).append(len(apart))
            apart.append([name, 1, article, len(elements) - 1])
        elif places := named.get(name):
            apart[places[-1]][1] += 1
        found.append(("close" if closing else "open", name, apart[-1][3] if apart else 0, article > 0))
    if at < len(page):
        found.append(("text", page[at:], apart[-1][3] if apart else 0, article > 0))
    return found, elements


def _apart(name: str, attributes: str, in_article: bool) -> int:
    """-1 for kinds that are no content, 0 for content; for what may be a wrapper in spite of its kind or names, what it must outweigh."""
    if name in _NEVER or (name in _NEVER_OUTSIDE and not in_article):
        return APART_TIMES if name in _MAY_WRAP else -1
    if name in ("html", "body") or not attributes.strip():
        return 0
    times = 0
    for m in _NAMED.finditer(attributes):
        for name in (m[1] or m[2] or m[3] or "").lower().split():
            said = set(_SPLIT.split(name)) - {""}
            if in_article and not said <= _UNWANTED | _COMMENTS | _LAYOUT:
                continue
            if said & _COMMENTS:
                return COMMENT_TIMES
            if said & _UNWANTED or (not in_article and said & _UNWANTED_OUTSIDE):
                times = APART_TIMES
    return times


def _wrappers(found: list, elements: list[tuple[int, int]], weights: dict[str, float]) -> set[int]:
    """The element whose own words outweigh all else by far, with those around it; none where an article stands outside."""
    if len(elements) == 1 or any(inside and not e for _, _, e, inside in found):
        return set()
    own, holds, link = [0.0] * len(elements), set(), False
    for kind, value, e, inside in found:
        if kind == "text":
            own[e] += len(value.split()) * weights["word in link" if link else "word"]
        elif value == "a":
            link = kind == "open"
        if inside:
            holds.add(e)
    able = [e for e in range(1, len(elements)) if elements[e][1]]
    if not able:
        return set()
    scores = _scores([(k, v, e > 0, i) for k, v, e, i in found], weights)
    start, end = best_region(scores)
    rest = max(0.0, scores[start:end].sum())
    best = max(able, key=lambda e: own[e] - (0 if e in holds else APART_COST))
    if own[best] <= elements[best][1] * rest + (0 if best in holds else APART_COST):
        return set()
    lifted = set()
    while best:
        lifted.add(best)
        best = elements[best][0]
    return lifted


def tokens(page: str, weights: dict[str, float] | None = None) -> list[tuple[str, object, bool, bool]]:
    """(kind, value, apart, inside an article) in page order; kind is 'text', 'open' or 'close'."""
    found, elements = _parse(page)
    lifted = _wrappers(found, elements, weights or DEFAULT) | {0}
    return [(kind, value, e not in lifted, inside) for kind, value, e, inside in found]


def _scores(kept: list, weights: dict[str, float]) -> np.ndarray:
    """Scores of tokens: a stretch of text counts its words."""
    scores, link = [], 0
    for kind, value, apart, _ in kept:
        if kind == "text":
            n = len(value.split())
            w = -weights["word"] if apart else weights["word in link"] if link else weights["word"]
            scores.append(n * w)
        else:
            if value == "a":
                link = int(kind == "open")
            scores.append(weights.get(value, DEFAULT_TAG))
    return np.array(scores)


def best_region(scores: np.ndarray) -> tuple[int, int]:
    """[start, end) of the contiguous stretch with the largest sum, in one scan."""
    if not len(scores):
        return 0, 0
    sums = np.concatenate(([0.0], np.cumsum(scores)))
    low = np.minimum.accumulate(sums[:-1])
    end = int(np.argmax(sums[1:] - low))
    start = int(np.flatnonzero(sums[: end + 1] == low[end])[0])
    return start, end + 1


def content(kept: list, weights: dict[str, float]) -> tuple[int, int, bool]:
    """[start, end) of the content and whether marked articles hold it: they do unless more words of the best region stand outside."""
    scores = _scores(kept, weights)
    start, end = best_region(scores)
    text = np.array([kind == "text" and not apart for kind, _, apart, _ in kept], bool)
    article = np.array([inside and not apart for _, _, apart, inside in kept], bool)
    own, other = scores[text & article].sum(), scores[start:end][(text & ~article)[start:end]].sum()
    if not own or other > own + APART_COST:
        return start, end, False
    inner = best_region(np.where(text & ~article, -scores, scores))
    if not (text & article)[slice(*inner)].any():
        return start, end, False
    start, end = inner
    return _reach(kept, start, -1), _reach(kept, end - 1, 1) + 1, True


def _reach(kept: list, edge: int, step: int) -> int:
    """The last token from ``edge`` on that still belongs to its article: its bound, or the place where a menu begins."""
    at = reached = edge
    words = linked = links = run = 0
    while 0 <= at + step < len(kept) and kept[at + step][3]:
        at += step
        kind, value, apart, _ = kept[at]
        if kind == "text" and not apart:
            n = len(value.split())
            words += n
            linked += n if _in_link(kept, at) else 0
        elif kind == "open" and value == "a" and not apart:
            links += 1
        elif kind != "text" and value in _BLOCKS and words:
            run = run + links if 2 * linked > words else 0
            if run >= MENU_LINKS:
                return reached
            if not run:
                reached = at
            words = linked = links = 0
    return at


def _in_link(kept: list, at: int) -> bool:
    """Whether the nearest tags before a text, up to the bound of its block, leave a link open."""
    for kind, value, _, _ in reversed(kept[max(0, at - 8) : at]):
        if kind != "text" and (value == "a" or value in _BLOCKS):
            return kind == "open" and value == "a"
    return False


def extract(page: str | None, weights: dict[str, float]) -> str:
    if not page:
        return ""
    kept = tokens(page, weights)
    start, end, marked = content(kept, weights)
    blocks, now = [], []

    def close() -> None:
        if text := " ".join(entities.unescape("".join(now)).split()):
            blocks.append(text)
        now.clear()

    for kind, value, apart, inside in kept[start:end]:
        if kind == "text":
            if not apart and (inside or not marked):
                now.append(value)
        elif value in _BLOCKS:
            close()
        elif value == "br":
            now.append(" ")
    close()
    return "\n\n".join(blocks)


def token_counts(pages: DataFrame, most: int = SAMPLE) -> DataFrame:
    """token, inside, n over at most ``most`` pages whose markup names one article."""
    labelled = pages.select(F.col("page_id"), F.col("html").cast("string").alias("html")).where(F.lower("html").contains("<article") | F.lower("html").contains("<main"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for (page,) in rows(batches):
            link = 0
            for kind, value, apart, inside in tokens(page):
                inside = inside and not apart
                if kind == "text":
                    seen["word in link" if link else "word", inside] += len(value.split())
                else:
                    link = int(kind == "open") if value == "a" else link
                    seen[value, inside] += 1
        yield emit([(t, i, n) for (t, i), n in seen.items()], pa.schema([("token", pa.string()), ("inside", pa.bool_()), ("n", pa.int64())]))

    ids = labelled.select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(most)
    some = labelled.join(F.broadcast(ids), "page_id", "left_semi").select("html")  # ``most`` ids
    return some.mapInArrow(count, "token string, inside boolean, n long").groupBy("token", "inside").agg(F.sum("n").alias("n"))


def fit(pages: DataFrame, most: int = SAMPLE) -> dict[str, float]:
    """Weights by token: the log-ratio inside to outside, words held positive and tags negative."""
    seen = {(r["token"], r["inside"]): r["n"] for r in token_counts(pages, most).collect()}  # one row a tag name
    inside, outside = (sum(n for (_, i), n in seen.items() if i is side) for side in (True, False))
    weights = dict(DEFAULT)
    if inside < 1000 or outside < 100:
        return weights
    ratio = {t: np.log((seen.get((t, True), 0) + 1) / (inside + 1)) - np.log((seen.get((t, False), 0) + 1) / (outside + 1)) for t, _ in seen}
    for t, r in ratio.items():
        if t.startswith("word"):
            weights[t] = float(min(1.0, max(0.1, r)))
        else:  # tags of articles cost little, tags of their surroundings much
            weights[t] = float(-0.05 if r > 0 else max(-8.0, r))
    weights["word"] = 1.0
    return weights


def main_text(pages: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """page_id, url, text, n_chars."""
    weights = fit(pages) if weights is None else weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])
        for part in chunks(batches, 2):
            texts = [extract(h, weights) for _, _, h in part]
            yield emit([(p, u, t, len(t)) for (p, u, _), t in zip(part, texts, strict=True)], schema)

    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return source.mapInArrow(run, "page_id long, url string, text string, n_chars long")
