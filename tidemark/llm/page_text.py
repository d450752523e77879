"""HTML extraction by maximum-scoring subsequence.

A page is a sequence of words and tags. Words score by the element they stand in, as a rule positive, tags negative; the
contiguous part of the page with the largest sum, found in one linear scan, is its content. The weights come from
labelled pages: pages that mark their content with one <article> or <main> element label their own tokens, and the log
odds of a context inside against outside, over at most LABELLED such pages (lowest hash of the page's id), are the
weights; contexts that no labelled page shows keep a default by kind. Elements that are marked as boilerplate by name or
by a whole class, id or role (menus, forms, notices, adverts, comments) cost next to nothing and are left out of the
chosen part; the rest is written block by block. Marks do not hold on the page's root, headings, <main>, <article>, nor on
an element with most of the page's words unless an <article>, <main> or <h1> stands apart from it; <main> ends those
around it. A mark whose elements around labelled pages have more words of the content than others does not hold either.

Where the chosen part lies in <article> or <main>, other such elements add their own best parts, so that a page with
several of them, or with many tags in one, loses none.

Scripts, styles, comments and the like have no tokens. Null and empty pages give an empty text, as do pages without
positive words. Pages of any length and depth are read whole in linear time. Repeated rows and null ids are extracted one
by one; an empty table gives an empty result. Only page_id, url and html are read, so other columns cannot clash. Among
parts of equal sum the first and shortest is taken.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LABELLED = 500
SMOOTH = 1.0
LOW, HIGH = -3.0, 3.0

# Elements that end a block of text, that never have text, that have no end tag, and that are not content.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header"
    " hr html legend li main menu nav noscript ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
SILENT = frozenset("script style noscript template iframe object embed svg math canvas audio video textarea select button".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILERPLATE = frozenset("nav aside footer form menu dialog fieldset".split())
UNMARKED = frozenset("html body main article h1 h2 h3 h4 h5 h6".split())
NOISE = re.compile(
    r"ad|ads|advert\w*|adsense|sponsor\w*|promo\w*|banner|menu|nav(?:bar|igation|s)?|breadcrumbs?|sidebar|footer|masthead|cookies?|consent|notice|popup|modal|newsletter|subscribe|share|social"
    r"|related|recommended|comments?|disqus|replies|respond|login|signup|search|widget|pagination|pager|skip|toolbar"
)
#: A class of several words is a mark only where all others are of these: site-footer is one, no-sidebar and related-work are not.
QUALIFIERS = frozenset(
    "site page main global top bottom left right primary secondary header post posts entry article articles blog list item items box block container wrapper wrap inner outer area section panel bar"
    " button buttons link links form icons media message content text title to".split()
)
#: An id of a section of an article is mostly its heading's text; these are not.
DISCUSSION = frozenset("comment comments disqus replies respond".split())
DEFAULTS = {"word": 1.0, "tag": -0.5, "title": -1.0}
#: Boilerplate is left out of the output anyway; it costs this much a token, so that little of it cannot part an article.
BOILERPLATE_COST = -0.05

# A quote begins a value only after an equals sign, and only where another ends it.
_TAIL = r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]++)?+)*+"""
_TOKEN = re.compile(rf"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([A-Za-z][^\s/>]*)({_TAIL})(?:>|$)|([^<]+|<)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s/=>]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?+""")
_SPACE = re.compile(r"[\x20\x09-\x0D\x85\xA0]+")
_CLOSES = {"p": "p", "li": "li", "dd": "dd", "dt": "dt", "tr": "tr", "td": "td", "th": "th", "option": "option"}


def _named(token: str) -> str:
    """The word of boilerplate that a class, id or role stands for; empty if none."""
    parts = [p for p in re.split(r"[_-]+", token.lower()) if p]
    found = [p for p in parts if NOISE.fullmatch(p)]
    return found[0] if found and all(p in QUALIFIERS or NOISE.fullmatch(p) for p in parts) else ""


def _mark(name: str, attributes: str, content: bool) -> str:
    """What marks an element as boilerplate; empty if nothing does."""
    if name in UNMARKED:
        return ""
    if name in BOILERPLATE or name == "header" and not content:
        return name
    for attribute, a, b, c in _ATTRIBUTE.findall(attributes):
        if (attribute := attribute.lower()) in ("class", "id", "role"):
            for word in filter(None, map(_named, (a or b or c).split())):
                if word in DISCUSSION or not (content and name == "section" and attribute == "id"):
                    return word
    return ""


def tokens(page: str) -> Iterator[tuple[str, str, str, tuple[str, ...], bool]]:
    """(kind, text, context, noise, content) of the page's tags and texts: kind is 'tag', 'block' (a tag that ends a block) or
    'text'; context names the nearest block element or link; noise has the marks of boilerplate around, those inside the
    content with a star; content tells whether <article> or <main> is around."""
    marked = [("", 0)]  # a mark and the number of the marked element around it
    stream = list(_walk(page, marked))
    words, anchors = [0] * len(marked), [0] * len(marked)
    for kind, text, _, around, _ in stream:
        if kind == "text":
            words[around] += len(text.split())
        elif text in ("article", "main", "h1"):
            anchors[around] += 1
    total = sum(words)
    for i in range(len(marked) - 1, 0, -1):
        words[marked[i][1]] += words[i]
    # elements with most of the words lie in each other; they wrap the content as long as it does not begin outside
    apart, noise = anchors[0], [()]
    for i in range(1, len(marked)):
        mark, around = marked[i]
        if not noise[around] and 2 * words[i] > total and not apart:
            apart += anchors[i]
            noise.append(())
        else:
            noise.append(noise[around] if mark in noise[around] else (*noise[around], mark))
    for kind, text, context, around, content in stream:
        yield kind, text, context, noise[around], content


def _walk(page: str, marked: list[tuple[str, int]]) -> Iterator[tuple[str, str, str, int, bool]]:
    """The tokens with the number of the marked element around each, 0 for none; adds the marked elements to marked."""
    # open elements (name, marked element, inside content, context); blocks and by_name have their places in the stack
    stack: list[tuple[str, int, bool, str]] = [("", 0, False, "")]
    blocks: list[int] = []
    by_name: dict[str, list[int]] = {}

    def cut(level: int) -> None:
        while len(stack) > level:
            n = stack.pop()[0]
            by_name[n].pop()
            if n in BLOCKS:
                blocks.pop()

    at = 0
    while m := _TOKEN.match(page, at):
        at = m.end()
        close, name, attributes, text = m.group(1, 2, 3, 4)
        if name is None and text is None:
            continue
        _, noise, content, context = stack[-1]
        if text is not None:
            yield "text", text, context, noise, content
            continue
        name = name.lower()
        kind = "block" if name in BLOCKS else "tag"
        if close:
            level = by_name[name][-1] if by_name.get(name) else 0
            if level and (kind == "block" or not blocks or blocks[-1] < level):
                cut(level)
            yield kind, "/" + name, name, noise, content
            continue
        if kind == "block" and blocks:
            # a block ends a paragraph that was left open; an item of its own kind ends the last item
            last = stack[blocks[-1]][0]
            if last == "p" or last == name and name in _CLOSES:
                cut(blocks[-1])
                _, noise, content, context = stack[-1]
        if name == "main":
            noise = 0
        elif mark := _mark(name, attributes, content):
            marked.append((mark + "*" * content, noise))
            noise = len(marked) - 1
        content = content or name in ("article", "main")
        yield kind, name, name, noise, content
        if name in SILENT and not attributes.endswith("/"):
            end = re.compile(rf"</{name}(?=[\s/>]|$)[^>]*(?:>|$)", re.I).search(page, at)
            at = end.end() if end else len(page)
        elif name not in VOID:
            by_name.setdefault(name, []).append(len(stack))
            if kind == "block":
                blocks.append(len(stack))
            stack.append((name, noise, content, name if kind == "block" or name == "a" else context))


def _feature(kind: str, text: str, context: str) -> str:
    return f"word in {context}" if kind == "text" else f"tag {text.lstrip('/')}"


def _noisy(weights: dict[str, float], noise: tuple[str, ...]) -> bool:
    """Whether one of the marks holds."""
    return any(weights.get(f"mark {m}", BOILERPLATE_COST) <= 0 for m in noise)


def learn(pages: list[str]) -> dict[str, float]:
    """Weights from pages that have <article> or <main>."""
    inside, outside = Counter(), Counter()
    for page in pages:
        for kind, text, _, noise, content in tokens(page):
            if kind == "text":
                for m in noise:
                    if not m.endswith("*"):  # a mark inside the content is no sign that it belongs there
                        (inside if content else outside)[f"mark {m}"] += len(text.split())
    marks = {m: min(HIGH, max(LOW, math.log((inside[m] + SMOOTH) / (outside[m] + SMOOTH)))) for m in inside.keys() | outside.keys()}
    inside, outside = Counter(), Counter()
    for page in pages:
        for kind, text, context, noise, content in tokens(page):
            if not _noisy(marks, noise):
                (inside if content else outside)[_feature(kind, text, context)] += len(text.split()) if kind == "text" else 1
    weights = dict(marks)
    n, m = sum(inside.values()) + 1, sum(outside.values()) + 1
    for f in inside.keys() | outside.keys():
        odds = math.log((inside[f] + SMOOTH) / n) - math.log((outside[f] + SMOOTH) / m)
        odds = min(HIGH, max(LOW, odds))
        # tags stay negative, the less so the more they belong to content
        weights[f] = odds if f.startswith("word") else min(-0.1, odds / 2 - 1)
    return weights


def weight(weights: dict[str, float], kind: str, text: str, context: str, noise: tuple[str, ...]) -> float:
    if _noisy(weights, noise):
        return BOILERPLATE_COST
    found = weights.get(_feature(kind, text, context))
    if found is not None:
        return found
    if kind == "text":
        return DEFAULTS["title" if context in ("title", "head", "a") else "word"]
    return DEFAULTS["tag"]


def extract(page: str | None, weights: dict[str, float]) -> str:
    """The content of a page."""
    if not page:
        return ""
    stream, scores, within = [], [], []
    for kind, text, context, noise, content in tokens(page):
        score = weight(weights, kind, text, context, noise)
        stream.append((kind, text, _noisy(weights, noise)))
        scores.append(score * len(text.split()) if kind == "text" else score)
        within.append(content)
    begin, end = best_part(scores)
    parts = [(begin, end)]
    if any(within[begin:end]):
        # what a page marks as content is not lost for the tags between its parts
        for side in (range(begin), range(end, len(scores))):
            runs = [i for i in side if within[i] and (not i or not within[i - 1] or i == side.start)]
            for a in runs:
                z = a
                while z < side.stop and within[z]:
                    z += 1
                x, y = best_part(scores[a:z])
                parts.append((a + x, a + y))
    blocks: list[str] = []
    for begin, end in sorted(parts):
        held: list[str] = []
        for kind, text, noise in stream[begin:end]:
            if kind == "block":
                blocks.append("".join(held))
                held = []
            elif kind == "text":
                if not noise:
                    held.append(entities.unescape(text))
            elif text == "br":
                held.append(" ")
        blocks.append("".join(held))
    clean = (_SPACE.sub(" ", b).strip() for b in blocks)
    return "\n".join(b for b in clean if b)


def best_part(scores: list[float]) -> tuple[int, int]:
    """Where the contiguous part with the largest sum begins and ends, the first and shortest of equal ones; nothing if
    no sum is positive."""
    best, begin, end, total, start = 0.0, 0, 0, 0.0, 0
    for i, score in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += score
        if total > best + 1e-12:
            best, begin, end = total, start, i + 1
    return begin, end


def fit(pages: DataFrame) -> dict[str, float]:
    """Weights from a bounded sample of pages that label themselves."""
    marked = pages.where(F.col("html").rlike(r"(?i)<(article|main)[\s>]"))
    sample = marked.select("page_id", F.xxhash64(F.lit(11), "page_id").alias("_luck")).orderBy("_luck", "page_id").limit(LABELLED).select("page_id").distinct()
    rows = pages.select("page_id", "html").join(F.broadcast(sample), "page_id").orderBy("page_id", "html").limit(2 * LABELLED).collect()
    return learn([r["html"] for r in rows if r["html"]])


def texts(pages: DataFrame, weights: dict[str, float]) -> DataFrame:
    """page_id, url and text of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                out = [extract(p, weights) for p in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op5(pages: DataFrame) -> DataFrame:
    return texts(pages, fit(pages))
