"""Main text of web pages: the maximum-scoring contiguous run of words and tags.

A page becomes a sequence of text runs and tags. Words score positive, by the elements around them; tags score
negative, by the odds that they lie outside the content. A linear scan finds the best contiguous region. The weights
start from fixed values and are corrected by all pages that mark their article themselves: what is counted there is
compared with what the fixed values expect.
"""

from __future__ import annotations

import html
import math
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from weirflow.llm.common import small_batches

# ---- fixed values: elements of the HTML standard by role, and words of class, id and role names ----
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
UNREAD = frozenset("audio button canvas datalist head noscript object option select svg template video".split()) | RAW
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: A start tag of the first kind ends an open element of the second.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr"}, "option": {"option"}} | {
    x: {"p"} for x in BLOCKS - {"br", "body", "html", "caption", "legend", "li", "dt", "dd", "td", "th", "tr", "tbody", "thead", "tfoot"}
}
MARKERS = ("article", "main")
AROUND_NAMES = "aside dialog footer form header menu nav search"
AROUND_WORDS = (
    "ad ads adsense advert advertisement advertising adverts alert banner breadcrumb breadcrumbs comment commentlist comments complementary consent "
    "contentinfo cookie cookies copyright dialog discussion disqus disclaimer footer gdpr header hidden login masthead menu modal nav navbar navigation "
    "newsletter notice notices notification overlay pager pagination popup promo promotion recommendations recommended related replies reply respond "
    "search share sharing sidebar signup skip social sponsor sponsored sponsors subscribe subscription teaser toolbar topbar tracking widget widgets"
)
CONTENT_WORDS = "article body content entry main post story text"
WORD_BASE, AROUND, MARKED, NAMED_CONTENT, PARAGRAPH, LINK, LISTED_LINK = 1.0, -8.0, 4.0, 1.0, 1.5, -0.5, -2.5
TAG_ODDS, MARKER_ODDS = 0.1, 1e6
# ---- end of fixed values ----

_PRIOR_NAME = dict.fromkeys(AROUND_NAMES.split(), AROUND) | dict.fromkeys(MARKERS, MARKED) | {"p": PARAGRAPH, "a": LINK}
_PRIOR_WORD = dict.fromkeys(AROUND_WORDS.split(), AROUND) | dict.fromkeys(CONTENT_WORDS.split(), NAMED_CONTENT)
#: Counts are kept by hash of the feature's name, so the model is bounded whatever names pages use.
BUCKETS = 16_384
#: A feature's counts are smoothed by so many text runs, a tag's by so many tags.
SMOOTH = 20.0
#: A feature of which more runs than this share lie on either side, as body or div, tells nothing by itself.
MIXED = 0.05
_MOST_KNOWN = 20_000
_LEARNED = 4.0
#: What learning sees of a run's surroundings: so many elements outwards, and so many nested articles.
_MOST_AROUND, _MOST_MARKERS = 24, 4

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+)>""")
_NAMING = re.compile(r"""(?<![^\s"'/])(class|id|role|hidden|aria-hidden)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?+(?![^\s/])""", re.IGNORECASE)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_LETTERS = re.compile(r"[a-z]+")


def bucket(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "replace")) % BUCKETS


def naming_words(attributes: str) -> list[str]:
    """The distinct words of an element's class, id and role; a hidden element has the word hidden."""
    found: dict[str, None] = {}
    for name, *values in _NAMING.findall(attributes):
        value = next(filter(None, values), "")
        if name.lower() in ("hidden", "aria-hidden"):
            if value.lower() != "false":
                found["hidden"] = None
        else:
            found |= dict.fromkeys(_LETTERS.findall(_CAMEL.sub(" ", value).lower()))
    return list(found)


class Weights:
    """What open elements add to the score of words, and what tags cost."""

    def __init__(self, elements: np.ndarray | None = None, tags: np.ndarray | None = None) -> None:
        self.elements, self.tags = elements, tags
        self._known: dict[tuple[str, str], tuple[float, tuple[int, ...]]] = {}
        self._costs: dict[str, float] = {}

    def of_element(self, name: str, attributes: str) -> tuple[float, tuple[int, ...]]:
        """An element's weight, and the buckets of its features."""
        key = (name, attributes)
        found = self._known.get(key)
        if found is None:
            words = naming_words(attributes) if attributes else []
            features = tuple(bucket(x) for x in (f"<{name}>", *(f".{w}" for w in words)))
            weight = _PRIOR_NAME.get(name, 0.0) + sum(sorted({_PRIOR_WORD.get(w, 0.0) for w in words}))
            if self.elements is not None:
                weight += float(sum(self.elements[list(features)]))
            found = weight, features
            if len(attributes) < 200:
                if len(self._known) > _MOST_KNOWN:
                    self._known.clear()
                self._known[key] = found
        return found

    def of_tag(self, name: str) -> float:
        cost = self._costs.get(name)
        if cost is None:
            cost = MARKER_ODDS if name in MARKERS else TAG_ODDS
            if self.tags is not None and name not in MARKERS:
                cost = float(self.tags[bucket(name)])
            if len(self._costs) < _MOST_KNOWN:
                self._costs[name] = cost
        return cost


class Page:
    """A page as parallel lists: text (None for a tag), score of a run's words, tag, and the marker elements around it.

    Runs inside elements that are never read (scripts, styles, controls) are left out, and so are their tags.
    """

    def __init__(self, source: str, weights: Weights) -> None:
        self.texts: list[str | None] = []
        self.scores: list[float] = []
        self.tags: list[str] = []
        self.features: list[tuple | None] = []  # of the innermost element, and those of the one around it
        self.inside: list[tuple[int, ...]] = []
        self._walk(source, weights)

    def _add(self, text: str | None, score: float, tag: str, stack: list, markers: tuple[int, ...]) -> None:
        self.texts.append(text)
        self.scores.append(score)
        self.tags.append(tag)
        self.features.append(stack[-1][3] if stack else None)
        self.inside.append(markers)

    def _walk(self, source: str, weights: Weights) -> None:
        stack: list[tuple[str, float, int, tuple, tuple[int, ...]]] = []  # name, score inside, unread depth, features, markers
        open_names: dict[str, int] = defaultdict(int)
        at, begun, size, n_markers = 0, 0, len(source), 0
        held: list[str] = []

        def say(end: int) -> None:
            if begun < end:
                held.append(source[begun:end])
            if held:
                if not stack or not stack[-1][2]:
                    score = stack[-1][1] if stack else WORD_BASE
                    self._add("".join(held), score, "", stack, stack[-1][4] if stack else ())
                held.clear()

        def close(upto: int) -> None:
            while len(stack) > upto:
                open_names[stack.pop()[0]] -= 1

        while at < size:
            left = source.find("<", at)
            if left < 0 or left + 1 >= size:
                break
            after = source[left + 1]
            if source.startswith("<!--", left):
                end = left + 5 if source.startswith(">", left + 4) else source.find("-->", left + 4) + 3
            elif after in "!?" or after == "/" and not source[left + 2 : left + 3].isalpha():
                end = source.find(">", left) + 1
            elif after != "/" and not (after.isascii() and after.isalpha()):
                at = left + 1
                continue
            else:
                match = _TAG.match(source, left)
                end = match.end() if match else 0
                if match:
                    closing, name, attributes = match[1], match[2].lower(), match[3]
                    say(left)
                    self._tag(closing, name, attributes, stack, open_names, weights, close)
                    if not closing and name in MARKERS and stack and stack[-1][0] == name:
                        n_markers += 1
                        top = stack.pop()
                        stack.append((*top[:4], (*top[4], n_markers if name == "article" else -n_markers)[:_MOST_MARKERS]))
                    if not closing and name in RAW:
                        over = re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE).search(source, end)
                        end = over.start() if over else size
                    at = begun = end
                    continue
            if end < left + 2:  # never closed: nothing behind it is text
                say(left)
                begun = size
                break
            if begun < left:
                held.append(source[begun:left])
            at = begun = end
        say(size)

    def _tag(self, closing, name, attributes, stack, open_names, weights, close) -> None:
        if closing:
            if open_names[name] > 0:
                place = next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name)
                unread, within = stack[place - 1][2] if place else 0, stack[place][1]
                close(place)
                if not unread and name not in UNREAD:
                    self._add(None, min(within, stack[-1][1] if stack else WORD_BASE), name, stack, stack[-1][4] if stack else ())
            elif name in BLOCKS and not (stack and stack[-1][2]):
                self._add(None, stack[-1][1] if stack else WORD_BASE, name, stack, stack[-1][4] if stack else ())
            return
        ended = ENDS.get(name, ())
        if stack and stack[-1][0] in ended:
            close(len(stack) - 1)
        elif ended == {"p"} and open_names["p"] > 0:
            for i in range(len(stack) - 1, max(-1, len(stack) - 9), -1):
                if stack[i][0] == "p":
                    close(i)
                    break
                if stack[i][0] in BLOCKS:
                    break
        outer_score, unread, markers = (stack[-1][1], stack[-1][2], stack[-1][4]) if stack else (WORD_BASE, 0, ())
        weight, features = weights.of_element(name, attributes)
        if name == "a" and stack and stack[-1][0] == "li":
            weight += LISTED_LINK
        if not unread and name not in UNREAD:  # the tags of an element that scores below zero are as good as inside it
            self._add(None, min(outer_score, outer_score + weight), name, stack, markers)
        if name in VOID or attributes.endswith("/") and name in ("svg", "path"):
            return
        stack.append((name, outer_score + weight, unread + (name in UNREAD), (features, stack[-1][3] if stack else None), markers))
        open_names[name] += 1


def best_region(gains: list[float]) -> tuple[int, int]:
    """[start, end) of the contiguous run with the greatest sum, the first of equals; empty if no gain is positive."""
    best, start, end = 0.0, 0, 0
    total, begun = 0.0, 0
    for place, gain in enumerate(gains):
        if total <= 0:
            total, begun = 0.0, place
        total += gain
        if total > best:
            best, start, end = total, begun, place + 1
    return start, end


def main_text(source: str, weights: Weights) -> str:
    """The text of the best region: runs that score, blocks parted by one space."""
    page = Page(source, weights)
    gains = []
    for text, score, tag in zip(page.texts, page.scores, page.tags):
        if text is None:
            gains.append(-weights.of_tag(tag) if score > 0 or tag in MARKERS else -TAG_ODDS)
        else:
            gains.append(len(text.split()) * (2 / (1 + math.exp(-min(score, 30.0))) - 1) if score > 0 else 0.0)
    start, end = best_region(gains)
    parts = []
    for place in range(start, end):
        text = page.texts[place]
        if text is None:
            if page.tags[place] in BLOCKS:
                parts.append(" ")
        elif page.scores[place] > 0:
            parts.append(html.unescape(text))
    return " ".join("".join(parts).split())


_COUNTS = "kind string, bucket int, seen_in long, seen_out long, expected_in long"
#: Expected counts are added as thousandths, so that their sum doesn't depend on the order.
_UNIT = 1000


def _label_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    weights = Weights()
    counts: dict[tuple[str, int], list[int]] = defaultdict(lambda: [0, 0, 0])
    for batch in small_batches(batches):
        for source in batch.column("text").to_pylist():
            _count_page(Page(source or "", weights), counts)
    rows = [(kind, at, *seen) for (kind, at), seen in counts.items()]
    types = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    columns = zip(*rows) if rows else [[]] * 5
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [x.split()[0] for x in _COUNTS.split(", ")])


def _count_page(page: Page, counts: dict[tuple[str, int], list[int]]) -> None:
    """Adds what a page that marks its one article, or else its one main element, shows about features and tags."""
    good = [inside for inside, score in zip(page.inside, page.scores) if inside and score > 0]
    articles = {x for inside in good for x in inside if x > 0}
    mains = {x for inside in good for x in inside if x < 0}
    marked = articles if len(articles) == 1 else mains if len(mains) == 1 and not articles else None
    if not marked:
        return
    (marker,) = marked
    for text, score, tag, features, inside in zip(page.texts, page.scores, page.tags, page.features, page.inside):
        within = marker in inside
        if text is None:
            if score > 0:  # tags within menus and the like tell nothing about such tags in texts
                counts["tag", bucket(tag)][0 if within else 1] += 1
        elif text.strip() and (score > 0 or not within):
            expected = round(_UNIT / (1 + math.exp(-max(-30.0, min(score, 30.0)))))
            around: set[int] = set()
            for _ in range(_MOST_AROUND):
                if features is None:
                    break
                around.update(features[0])
                features = features[1]
            for at in around:
                seen = counts["element", at]
                seen[0 if within else 1] += 1
                seen[2] += expected


def fit(pages: DataFrame) -> Weights:
    """Weights from all pages that mark their article; the fixed values alone where no page does.

    A feature's weight is corrected by how much oftener it is seen in articles, and more rarely outside, than the fixed
    values expect, at most by a factor e^4 each way; a feature seen on both sides is left as it is. At most 2 x BUCKETS sums come to the driver, whatever the corpus.
    """
    sums = _sources(pages).mapInArrow(_label_batches, _COUNTS).groupBy("kind", "bucket").agg(*(F.sum(c).alias(c) for c in ("seen_in", "seen_out", "expected_in")))
    elements, tags = np.zeros(BUCKETS), np.full(BUCKETS, TAG_ODDS)
    for row in sums.collect():
        if row.kind == "tag":
            tags[row.bucket] = max(1e-4, (row.seen_out + TAG_ODDS * SMOOTH) / (row.seen_in + SMOOTH))
        elif min(row.seen_in, row.seen_out) <= MIXED * (row.seen_in + row.seen_out):
            expected = row.expected_in / _UNIT
            missing = row.seen_in + row.seen_out - expected
            change = math.log((row.seen_in + SMOOTH) / (expected + SMOOTH)) - math.log((row.seen_out + SMOOTH) / (missing + SMOOTH))
            elements[row.bucket] = max(-_LEARNED, min(_LEARNED, change))
    return Weights(elements, tags)


def _sources(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("html").cast("string").alias("text"))


_RESULT = "page_id long, url string, text string, n_chars long"


def _text_batches(elements: np.ndarray, tags: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = Weights(elements, tags)
        for batch in small_batches(batches):
            found = [main_text(x or "", weights) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())],
                [x.split()[0] for x in _RESULT.split(", ")],
            )

    return run


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages(page_id, url, html).

    A null html is the empty page, whose text is empty; so is that of a page without a word that scores. Of regions of
    equal score the first counts. Repeated rows give repeated rows, an empty table none; null ids and addresses stay
    null; other columns are not read, whatever their names. A page is read whole, whatever its length, in linear time.
    """
    weights = fit(pages)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("text"))
    return rows.mapInArrow(_text_batches(weights.elements, weights.tags), _RESULT)
