"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie, with byte fallback."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from weirflow.llm import pieces as P
from weirflow.llm.common import Memory, small_batches, texts_of

#: Words of more bytes are encoded one by one, others many at a time.
LONG_WORD = 160
BLOCK = 4_096


def best_path(data: bytes, vocabulary: P.Pieces) -> list[tuple[int, int, int]]:
    """(piece, start, end) along the best path of one word; piece -1 is an unknown character."""
    base, check, leaf, score = vocabulary.base.item, vocabulary.check.item, vocabulary.leaf.item, vocabulary.score.item
    size = len(data)
    best, back = [-np.inf] * (size + 1), [(-1, 0)] * (size + 1)
    best[0] = 0.0
    at = 0
    while at < size:
        width = min(int(P.WIDTH[data[at]]) or 1, size - at)
        here, state, end, single = best[at], 0, at, False
        while end < size:
            after = base(state) + data[end]
            if check(after) != state:
                break
            state, end = after, end + 1
            piece = leaf(state)
            if piece >= 0:
                single |= end == at + width
                if here + score(piece) > best[end]:
                    best[end], back[end] = here + score(piece), (piece, at)
        if not single and here + vocabulary.unknown > best[at + width]:
            best[at + width], back[at + width] = here + vocabulary.unknown, (-1, at)
        at += width
    path, end = [], size
    while end:
        piece, start = back[end]
        path.append((piece, start, end))
        end = start
    return path[::-1]


def _ids(data: bytes, path: list[tuple[int, int, int]], vocabulary: P.Pieces) -> bytes:
    ids: list[int] = []
    for piece, start, end in path:
        ids += [piece] if piece >= 0 else vocabulary.byte_ids[list(P.fallback(data[start:end]))].tolist()
    return np.array(ids, dtype="<u4").tobytes()


def _block(words: list[bytes], vocabulary: P.Pieces) -> list[bytes]:
    """Ids of many words, all advancing together: one step of the trie for all of them at a time."""
    sizes = np.array([len(w) for w in words])
    longest, count = int(sizes.max()), len(words)
    data = np.zeros((count, longest + 1), dtype=np.int64)
    for row, word in enumerate(words):
        data[row, : len(word)] = np.frombuffer(word, dtype=np.uint8)
    best = np.full((count, longest + 5), -np.inf)
    best[:, 0] = 0.0
    piece_at = np.full((count, longest + 5), -2, dtype=np.int64)
    start_at = np.zeros((count, longest + 5), dtype=np.int64)
    base, check, leaf, score = vocabulary.base, vocabulary.check, vocabulary.leaf, vocabulary.score
    for at in range(longest):
        rows = np.flatnonzero((at < sizes) & (best[:, at] > -np.inf))
        if not len(rows):
            continue
        width = np.minimum(np.maximum(P.WIDTH[data[rows, at]], 1), sizes[rows] - at)
        single = np.zeros(len(rows), dtype=bool)
        live, state = np.arange(len(rows)), np.zeros(len(rows), dtype=np.int64)
        for end in range(at, longest):
            after = base[state] + data[rows[live], end]
            ok = (check[after] == state) & (end < sizes[rows[live]])
            live, state = live[ok], after[ok]
            if not len(live):
                break
            piece = leaf[state]
            found = piece >= 0
            if found.any():
                hit, which = live[found], piece[found]
                single[hit] |= width[hit] == end + 1 - at
                where = rows[hit]
                total = best[where, at] + score[which]
                better = total > best[where, end + 1]
                where = where[better]
                best[where, end + 1], piece_at[where, end + 1], start_at[where, end + 1] = total[better], which[better], at
        alone = np.flatnonzero(~single)
        where, end = rows[alone], at + width[alone]
        total = best[where, at] + vocabulary.unknown
        better = total > best[where, end]
        where, end = where[better], end[better]
        best[where, end], piece_at[where, end], start_at[where, end] = total[better], -1, at
    steps, ends = [], sizes.copy()
    unknown: dict[int, list[tuple[int, int, int]]] = {}
    every = np.arange(count)
    while ends.any():
        piece = np.where(ends > 0, piece_at[every, ends], -2)
        start = start_at[every, ends]
        for row in np.flatnonzero(piece == -1).tolist():
            unknown[row] = []
        steps.append((piece, np.where(ends > 0, start, 0), ends.copy()))
        ends = np.where(ends > 0, start, 0)
    chosen = np.stack([s[0] for s in steps[::-1]], axis=1).astype("<i4")
    out = []
    for row in range(count):
        if row in unknown:
            path = [(int(p[row]), int(s[row]), int(e[row])) for p, s, e in steps[::-1] if p[row] != -2]
            out.append(_ids(words[row], path, vocabulary))
        else:
            line = chosen[row]
            out.append(line[line >= 0].tobytes())
    return out


class Encoder:
    """Encodes texts; each distinct word is encoded once and remembered."""

    def __init__(self, vocabulary: P.Pieces) -> None:
        self.vocabulary, self.memory = vocabulary, Memory()

    def _learn(self, new: list[str]) -> list[bytes]:
        marked = sorted(((P.marked(w), w) for w in new), key=lambda x: len(x[0]))
        found: dict[str, bytes] = {}
        for data, word in marked:
            if len(data) > LONG_WORD:
                found[word] = _ids(data, best_path(data, self.vocabulary), self.vocabulary)
        short = [x for x in marked if len(x[0]) <= LONG_WORD]
        for start in range(0, len(short), BLOCK):
            part = short[start : start + BLOCK]
            found.update(zip((w for _, w in part), _block([d for d, _ in part], self.vocabulary)))
        return [found[w] for w in new]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Piece ids of each text as little-endian 32-bit numbers."""
        cut = [P.words_of(text) for text in texts]
        get = self.memory.recall(set().union(*cut), self._learn).__getitem__
        return [b"".join(map(get, words)) for words in cut]

    def decode(self, ids: bytes) -> str:
        """The text of piece ids: marks as spaces, without the one in front, runs of byte pieces as UTF-8."""
        written = b"".join(map(self.vocabulary.written.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))
        return (written[1:] if written[:1] == b" " else written).decode("utf-8", "replace")


_RESULT = "doc_id long, n_pieces long, n_byte_pieces long, ids_crc32 long, decoded_sha256 string, round_trip boolean"


def _encode_batches(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(P.load(path))
        is_byte = np.zeros(encoder.vocabulary.count, dtype=bool)
        is_byte[encoder.vocabulary.byte_ids] = True
        for batch in small_batches(batches):
            texts = texts_of(batch, "text")
            rows = []
            for text, ids in zip(texts, encoder.encode(texts)):
                back = encoder.decode(ids)
                rows.append((len(ids) // 4, int(is_byte[np.frombuffer(ids, "<u4")].sum()), zlib.crc32(ids), hashlib.sha256(back.encode()).hexdigest(), back == text))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, zip(*rows), types)], [x.split()[0] for x in _RESULT.split(", ")])

    return run


def encode_documents(docs: DataFrame, model: str = P.MODEL) -> DataFrame:
    """For each row of docs(doc_id, text): doc_id, number of pieces and byte pieces, CRC-32 of the ids, and the text decoded again.

    A null text is the empty text, which has no pieces. Every text decodes to itself: unknown characters, and the
    white-space mark where a text has it, are written as bytes. Repeated rows give repeated rows; other columns are
    not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_encode_batches(model), _RESULT)


def _id_batches(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(P.load(path))
        for batch in small_batches(batches):
            ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in encoder.encode(texts_of(batch, "text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return run


def ids(docs: DataFrame, model: str = P.MODEL) -> DataFrame:
    """(doc_id, ids) of docs(doc_id, text): the piece ids, none for a null or empty text.

    Of paths of equal score the first found counts. Repeated rows give repeated rows, an empty table none; other
    columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_id_batches(model), "doc_id long, ids array<int>")


def _text_batches(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(P.load(path))
        for batch in small_batches(batches):
            texts = [encoder.decode(np.array([i for i in x or [] if i is not None], "<u4").tobytes()) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return run


def texts(encoded: DataFrame, model: str = P.MODEL) -> DataFrame:
    """(doc_id, text) of encoded(doc_id, ids): the inverse of ids().

    Null ids are the empty text, a null id inside is left out, bytes that are no UTF-8 become replacement characters.
    Repeated rows give repeated rows, an empty table none; other columns are not read.
    """
    return encoded.select("doc_id", "ids").mapInArrow(_text_batches(model), "doc_id long, text string")
