"""Toxicity through a noisy channel: disguised words are restored under a character language model, then scored.

A token with leetspeak, lookalikes, separators or repetition in it becomes a lattice: each observed character may stand for
itself, for the letters that it resembles, or for nothing. Viterbi decoding over the lattice, with trigram
probabilities counted from the whole corpus, gives the restored word. A logistic model over restored words and
their prefixes, fitted on labelled documents, scores the text.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from weirflow.llm.common import Memory, bytes_of, small_batches, staged, texts_of

#: Labelled documents that the model is fitted on: of more, those with the least hash of their id.
MOST_LABELLED = 10_000
#: A feature must be in so many fitted documents, more often in toxic ones, by so much log-likelihood ratio. All such
#: features count; the bound on the documents bounds them.
LEAST_DOCUMENTS = 3
LEAST_TELLING = 7.0
PREFIXES = (4, 5, 6)
#: One part in this many documents is held out.
FOLDS = 5

#: What a worker remembers of tokens; where all features are named, their names come on top, about twice as much.
TOKEN_BYTES = 24 << 20

# ---- the language model: codes 0 boundary, 1-26 the letters, 27 any other letter, 28 a figure or sign ----
_CODES = 32
_OTHER, _SIGN = 27, 28
_BYTE_CODES = np.zeros(256, dtype=np.int64)
_BYTE_CODES[97:123] = np.arange(1, 27)
_BYTE_CODES[0xC2:0xF5] = _OTHER  # the first byte of a longer character; those that follow are left out
_BYTE_CODES[0x80:0xC0] = -1


def _code(char: str) -> int:
    return ord(char) - 96 if "a" <= char <= "z" else _OTHER if char.isalpha() else _SIGN


def _trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(_CODES**3, dtype=np.int64)
    for batch in small_batches(batches):
        for text in bytes_of(batch, "text"):
            codes = _BYTE_CODES[np.frombuffer(b"  " + text.lower() + b" ", dtype=np.uint8)]
            codes = codes[codes >= 0]
            before = codes[1:-1]
            context = np.where(before == 0, 0, codes[:-2])  # a word starts from an empty context
            total += np.bincount((context << 10) | (before << 5) | codes[2:], minlength=_CODES**3)
    found = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["gram", "n"])


def trigram_counts(docs: DataFrame) -> DataFrame:
    """(gram, n) of the character trigrams of all texts: 32768 rows at most, whatever the corpus."""
    part = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_trigrams, "gram long, n long")
    return part.groupBy("gram").agg(F.sum("n").alias("n"))


def language_model(docs: DataFrame) -> np.ndarray:
    """Costs -log P(c | a, b) at a << 10 | b << 5 | c, by interpolation of the three orders."""
    counts = np.zeros(_CODES**3)
    for row in trigram_counts(docs).collect():
        counts[row.gram] = row.n
    counts = counts.reshape(_CODES, _CODES, _CODES)
    pairs, ones = counts.sum(0), counts.sum((0, 1))
    share = lambda c: c / np.maximum(c.sum(-1, keepdims=True), 1)
    mixed = 0.7 * share(counts) + 0.2 * share(pairs)[None] + 0.09 * share(ones)[None, None] + 0.01 / _CODES
    return (-np.log(mixed)).astype(np.float32).ravel()


# ---- fixed values: letters that signs resemble, and the costs of the channel ----
RESEMBLES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "а": "a", "е": "e", "о": "o", "і": "i", "с": "c", "р": "p",
}
SEPARATORS = frozenset(".-_*~'`^:,/\\ ")
COST_RESEMBLING, COST_SEPARATOR, COST_REPEATED, COST_LONG_RUN, COST_AS_IS, COST_GAP = 1.0, 0.2, 2.5, 0.2, 9.0, 3.0
# ---- end of fixed values ----

_LETTERS_ONLY = re.compile(r"[^\W\d_]*")
#: What makes letters a disguise: one that is written twice, or looks like another.
_NOISY = re.compile(rf"(.)\1|[{''.join(filter(str.isalpha, RESEMBLES))}]")
_SIGNS = re.escape("".join(c for c in RESEMBLES if not c.isalpha()))
#: A sign or figure in a word.
_SIGNED = re.compile(rf"[^\W\d_][{_SIGNS}]|[{_SIGNS}][^\W\d_]")
_EDGES = ".,;:!?\"'()[]{}<>|*#%&~^`_-=+/\\…«»„“”‘’¿¡"
_SPELLED_OUT = re.compile(r"[^\W_](?:[.\-_*~'/,:]+[^\W_])+")
_INNER_BREAK = re.compile(r"[.\-_*~'`^:,/\\=;&?#%()\[\]{}<>\"]+")
_SPACED_RUN = re.compile(r"(?<!\S)\S(?:\s++\S){2,}(?!\S)")
_SPACED_HINT = re.compile(r"\s\S\s++\S\s")
#: Words of no channel: an e-mail address, a URL, a hash that has a digit.
_SKIPPED = re.compile(r"[\w.%+-]+@[\w-]+(?:\.[\w-]+)*\.[a-z]{2,}|(?:[a-z][a-z0-9+.-]*://|www\.)\S+|(?=[a-f-]*+[0-9])(?:[0-9a-f]{12,}|[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12})")


def decode(observed: str, costs: list[float]) -> str:
    """The cheapest reading of an observed string through the lattice, by Viterbi over the last two codes."""
    states: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}  # cost, and (what came before, what is written last)
    for place, char in enumerate(observed):
        run = place and observed[place - 1] == char
        long_run = run and (place > 1 and observed[place - 2] == char or observed[place + 1 : place + 2] == char)
        options: list[tuple[str, int, float]] = []  # what is written, its code, what the channel asks for it
        if char.isalpha():
            options.append((char, _code(char), 0.0))
        options += [(c, _code(c), COST_RESEMBLING) for c in RESEMBLES.get(char, "")]
        if char in SEPARATORS:
            options.append(("", -1, COST_SEPARATOR))
            if char == " ":
                options.append((" ", 0, COST_GAP))
        elif run:
            options.append(("", -1, COST_LONG_RUN if long_run else COST_REPEATED))
        if not options or char in RESEMBLES and not char.isalpha():
            options.append((char, _SIGN, COST_AS_IS))
        reached: dict[int, tuple[float, tuple | None]] = {}
        for state, (cost, path) in states.items():
            for written, code, asked in options:
                if code < 0:
                    after, total = state, cost + asked
                else:
                    after = (state & 31) << 5 | code if code else 0
                    total = cost + asked + costs[state << 5 | code]
                known = reached.get(after)
                if known is None or total < known[0]:
                    reached[after] = (total, (path, written) if written else path)
        states = reached
    ends = [(cost + costs[state << 5], path) for state, (cost, path) in states.items()]
    least = min(cost for cost, _ in ends)
    return min(_written(path) for cost, path in ends if cost == least)


def _written(path: tuple | None) -> str:
    out = []
    while path:
        path, last = path
        out.append(last)
    return "".join(reversed(out))


def restore(token: str, costs: list[float]) -> list[str]:
    """The words that a lower-case token stands for."""
    if _LETTERS_ONLY.fullmatch(token) and not _NOISY.search(token):
        return [token] if token else []
    core = token.rstrip(_EDGES).lstrip(_EDGES)
    if core[:1] in "@$" and (core[1:2] in "@$" or not core[1:2].isalnum()):
        core = core.lstrip("@$")
    if core[-3:] == "$$$":
        core = core.rstrip("$")
    if not core or _LETTERS_ONLY.fullmatch(core) and not _NOISY.search(core):
        return [core] if core else []
    letters = sum(map(str.isalpha, core))
    if not letters or _SKIPPED.fullmatch(core):
        return [core]
    if _SPELLED_OUT.fullmatch(core) and len(core) >= 5:
        return decode(core, costs).split()
    parts = [x for x in _INNER_BREAK.split(core) if x]
    if len(parts) > 1:
        joined = decode("".join(parts), costs).split() if "*" in core or any(len(x) == 1 or _SIGNED.search(x) for x in parts) else []
        return [w for part in parts for w in restore(part, costs)] + joined
    return decode(core, costs).split()


class _Features:
    """The features of tokens and texts. chosen: those that count, all where None."""

    def __init__(self, costs: np.ndarray, chosen: dict[str, int] | None) -> None:
        self.costs, self.chosen, self.memory = costs.tolist(), chosen, Memory(TOKEN_BYTES)

    def of_words(self, words: list[str]) -> tuple:
        named = {f"={w}" for w in words} | {f"^{w[:n]}" for w in words for n in PREFIXES if len(w) > n}
        return tuple(named if self.chosen is None else (self.chosen[x] for x in named if x in self.chosen))

    def _learn(self, tokens: list[str]) -> Iterator[tuple]:
        return (self.of_words(restore(token, self.costs)) for token in tokens)

    def of_text(self, text: str) -> set:
        lowered = text.lower()
        found: set = set()
        tokens = set(lowered.split())
        found.update(*map(self.memory.recall(tokens, self._learn).__getitem__, tokens))
        if _SPACED_HINT.search(f" {lowered} "):
            for match in _SPACED_RUN.finditer(lowered):
                found.update(self.of_words(decode(" ".join(match[0].split()), self.costs).split()))
        return found


def _features_batches(costs: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = _Features(costs, None)
        for batch in small_batches(batches):
            column = [sorted(features.of_text(x)) for x in texts_of(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column("_toxic"), pa.array(column, pa.list_(pa.string()))], ["toxic", "features"])

    return run


def held_out() -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == 0


class Model:
    """A character language model, the features that count, their weights and the intercept."""

    def __init__(self, costs: np.ndarray, names: list[str], weights: list[float], intercept: float) -> None:
        self.costs, self.names, self.weights, self.intercept = costs, names, weights, intercept


def fit(docs: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED) -> Model:
    """The model from docs(doc_id, text), all texts for the language model, and labels(doc_id, toxic) outside the held-out fold.

    At most most_labelled labelled documents count, so their ids may be broadcast; repeated texts count once. A
    document labelled more than once is toxic if any label says so. Without both classes the model is the bare share.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import CountVectorizerModel

    costs = language_model(docs)
    marked = labels.where(~held_out()).groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max("toxic").alias("_toxic")).dropna()
    chosen = marked.orderBy(F.xxhash64("_id"), "_id").limit(most_labelled)
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sample = texts.join(F.broadcast(chosen), "_id").select("_toxic", "text").dropDuplicates(["_toxic", "text"])
    rows = staged(sample.mapInArrow(_features_batches(costs), "toxic int, features array<string>"), "toxic-features")
    n_docs, n_toxic = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not 0 < n_toxic < n_docs:
        odds = (n_toxic + 0.5) / (n_docs + 1)
        return Model(costs, [], [], math.log(odds / (1 - odds)) if n_docs else -20.0)
    each = rows.select("toxic", F.explode("features").alias("feature")).groupBy("feature").agg(F.count("*").alias("n"), F.sum("toxic").alias("k"))
    part = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(F.lit(0.0))
    rate, n, k = F.lit(n_toxic / n_docs), F.col("n"), F.col("k")
    rest, rest_k = F.lit(n_docs) - n, F.lit(n_toxic) - k
    telling = part(k, n * rate) + part(n - k, n * (1 - rate)) + part(rest_k, rest * rate) + part(rest - rest_k, rest * (1 - rate))
    best = each.where((n >= LEAST_DOCUMENTS) & (k > n * rate)).select("feature", telling.alias("t")).where(F.col("t") >= LEAST_TELLING)
    names = sorted(r.feature for r in best.collect())
    if not names:
        return Model(costs, [], [], math.log(n_toxic / (n_docs - n_toxic)))
    vectors = CountVectorizerModel.from_vocabulary(names, "features", "vector")
    fitted = LogisticRegression(
        featuresCol="vector", labelCol="label", maxIter=100, regParam=0.0001, standardization=False, family="binomial"
    ).fit(vectors.transform(rows).select(F.col("toxic").cast("double").alias("label"), "vector").coalesce(4))
    return Model(costs, names, fitted.coefficients.toArray().tolist(), float(fitted.intercept))


def _scores(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = _Features(model.costs, {name: place for place, name in enumerate(model.names)})
        weights, intercept = model.weights, model.intercept
        for batch in small_batches(batches):
            sums = [intercept + math.fsum(weights[i] for i in features.of_text(x)) for x in texts_of(batch, "text")]
            score = [1 / (1 + math.exp(-min(max(s, -500.0), 500.0))) for s in sums]
            names = [x for x in batch.schema.names if x != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), pa.array(score, pa.float64())], [*names, "score"])

    return run


def score(docs: DataFrame, labels: DataFrame, **bounds: int) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs(doc_id, text).

    The score depends on the text alone: a null text is the empty text, which has the model's intercept. A null id
    counts as the empty string, so it is held out. Repeated rows give repeated rows; an empty table none.
    """
    model = fit(docs, labels, **bounds)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = rows.mapInArrow(_scores(model), "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _keeps(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = _Features(model.costs, {name: place for place, name in enumerate(model.names)})
        for batch in small_batches(batches):
            kept = [model.intercept + math.fsum(model.weights[i] for i in features.of_text(x)) < 0 for x in texts_of(batch, "text")]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return run


def keep(docs: DataFrame, labels: DataFrame, **bounds: int) -> DataFrame:
    """The rows of docs, all columns, whose score is below 0.5.

    A null text is the empty text. Repeated rows score alike, so all stay or all go; a score of exactly 0.5 goes. An
    empty table gives no rows. Only doc_id and text are read by name, so no other column can clash. Labels with a null
    id or class are ignored.
    """
    return docs.mapInArrow(_keeps(fit(docs, labels, **bounds)), docs.schema)
