"""Token counts by trie-shared dynamic programming.

The distinct words of a batch of texts are sorted, which lays them out as a trie: words that begin alike are
neighbours. The unigram forward scores are computed level by level for all nodes of the trie at once, so a prefix
that many words share is computed once; the number of tokens at a word's last node is the word's count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from weirflow.llm import encoding, pieces as P
from weirflow.llm.common import Memory, small_batches, texts_of

LONG_WORD = 160
#: Words that make one trie: those of a block, in order, so that neighbours share their prefixes.
BLOCK = 8_192


def _trie_counts(words: list[bytes], vocabulary: P.Pieces) -> np.ndarray:
    """Tokens of each of the sorted, distinct words."""
    sizes = np.array([len(w) for w in words])
    count, longest = len(words), int(sizes.max())
    data = np.full((count, longest), -1, dtype=np.int16)
    for row, word in enumerate(words):
        data[row, : len(word)] = np.frombuffer(word, dtype=np.uint8)
    differs = data[1:] != data[:-1]
    shared = np.r_[0, np.where(differs.any(1), differs.argmax(1), longest)]  # bytes in common with the word before
    base, check, leaf, score = vocabulary.base, vocabulary.check, vocabulary.leaf, vocabulary.score
    result = np.zeros(count, dtype=np.int64)
    node_of = np.zeros(count, dtype=np.int64)  # each word's node at the level reached
    rows = np.arange(count)
    # Per node of the level: the place where its last character began, bytes that this still lacks; and for each start
    # from which a piece may still reach here: the trie's state, and the score and tokens of the path up to the start.
    lacks, began = np.zeros(1, np.int64), np.zeros(1, np.int64)
    starts: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {0: (np.zeros(1, np.int64), np.zeros(1), np.zeros(1, np.int64))}
    for depth in range(1, longest + 1):
        rows = rows[sizes[rows] >= depth]
        fresh = np.r_[True, shared[rows[1:]] < depth]
        # A row that shares its prefix with the row before shares the node, if no row between them was left out: those
        # are shorter, so they share less.
        leaders = rows[fresh]
        parent = node_of[leaders]
        node_of[rows] = np.cumsum(fresh) - 1
        byte = data[leaders, depth - 1].astype(np.int64)
        width = np.maximum(P.WIDTH[byte], 1)
        first = lacks[parent] == 0
        began = np.where(first, depth - 1, began[parent])
        lacks = np.where(first, width, lacks[parent]) - 1
        ends = lacks == 0
        best, tokens = np.full(len(leaders), -np.inf), np.zeros(len(leaders), np.int64)
        single = np.zeros(len(leaders), dtype=bool)
        kept = {}
        for start in sorted(starts):
            states, scores, counts = starts[start]
            state, before, so_far = states[parent], scores[parent], counts[parent]
            after = base[np.maximum(state, 0)] + byte
            state = np.where((state >= 0) & (check[after] == state), after, -1)
            piece = np.where(state >= 0, leaf[np.maximum(state, 0)], -1)
            total = np.where(piece >= 0, before + score[np.maximum(piece, 0)], -np.inf)
            better = total > best
            best, tokens = np.where(better, total, best), np.where(better, so_far + 1, tokens)
            own = ends & (began == start)
            single |= own & (piece >= 0)
            unknown = own & (piece < 0) & (before + vocabulary.unknown > best)
            if unknown.any():
                spelled = np.where(byte == P._OWN_MARK[0], len(P.MARK.encode()), depth - start)
                best, tokens = np.where(unknown, before + vocabulary.unknown, best), np.where(unknown, so_far + spelled, tokens)
            if (state >= 0).any() or (~ends & (began == start)).any():
                kept[start] = (state, before, so_far)
        kept[depth] = (np.where(ends, 0, -1), best, tokens)
        starts = kept
        over = rows[sizes[rows] == depth]
        result[over] = tokens[node_of[over]]
    return result


class Counter:
    """Counts the tokens of texts; each distinct word is inserted once and its count remembered."""

    def __init__(self, vocabulary: P.Pieces) -> None:
        self.vocabulary, self.memory = vocabulary, Memory()

    def _learn(self, new: list[str]) -> list[int]:
        marked = sorted((P.marked(w), w) for w in new)
        found: dict[str, int] = {}
        short = [x for x in marked if len(x[0]) <= LONG_WORD]
        for start in range(0, len(short), BLOCK):
            part = short[start : start + BLOCK]
            found.update(zip((w for _, w in part), _trie_counts([d for d, _ in part], self.vocabulary).tolist()))
        for data, word in marked:
            if len(data) > LONG_WORD:
                path = encoding.best_path(data, self.vocabulary)
                found[word] = sum(1 if piece >= 0 else len(P.fallback(data[a:b])) for piece, a, b in path)
        return [found[w] for w in new]

    def count(self, texts: list[str]) -> list[tuple[int, int]]:
        """(words, tokens) of each text."""
        cut = [P.words_of(text) for text in texts]
        get = self.memory.recall(set().union(*cut), self._learn).__getitem__
        return [(len(words), sum(map(get, words))) for words in cut]


def _count_batches(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(P.load(path))
        for batch in small_batches(batches, 1024):
            words, tokens = zip(*counter.count(texts_of(batch, "text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_pre_tokens", "n_tokens"])

    return run


def token_counts(docs: DataFrame, model: str = P.MODEL) -> DataFrame:
    """doc_id, n_pre_tokens, n_tokens for each row of docs(doc_id, text).

    The count is that of the best unigram path, byte pieces of unknown characters one each; of paths of equal score
    the first found counts, as in encoding. A null text is the empty text, which has none. Repeated rows give repeated
    rows; an empty table none; other columns are not read. Memory is bounded by BATCH_BYTES of text, BLOCK words and
    MEMORY_BYTES of remembered counts, or by one text's own words where that is longer.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_count_batches(model), "doc_id long, n_pre_tokens long, n_tokens long")
