"""A vocabulary of pieces with log scores, in a double-array trie over UTF-8 bytes.

Shared by the encoder, which finds the best path of each word, and by the counter, which shares work between words.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import public_tokenizers

MODEL = public_tokenizers.path("piece_bpe_32k.model")
MARK = "▁"
#: The file ranks its pieces but has no probabilities, so a piece of rank r has a share in proportion to 1 / (r + ZIPF_SHIFT).
ZIPF_SHIFT = 10
#: A character that no piece covers scores so much below the lowest piece.
UNKNOWN_PENALTY = 10.0


class Pieces:
    """Pieces by id, their log scores, and the trie: from state s, byte b leads to base[s] + b if check there is s."""

    def __init__(self, pieces: list[str], scores: dict[int, float], byte_ids: list[int]) -> None:
        self.count, self.byte_ids = len(pieces), np.array(byte_ids, dtype=np.int32)
        self.score = np.full(len(pieces), -np.inf)
        for number, score in scores.items():
            self.score[number] = score
        self.unknown = min(scores.values(), default=0.0) - UNKNOWN_PENALTY
        self.written = [pieces[i].replace(MARK, " ").encode() if i in scores else b"" for i in range(len(pieces))]
        for value, number in enumerate(byte_ids):
            self.written[number] = bytes([value])
        self.base, self.check, self.leaf = double_array({pieces[i].encode(): i for i in scores})
        self.longest = max((len(pieces[i].encode()) for i in scores), default=1)


def double_array(keys: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base, check and leaf (the key's number, -1 where none ends) of a trie; state 0 is the root, check -1 is free."""
    children: list[dict[int, int]] = [{}]
    ends = [-1]
    for key, number in keys.items():
        node = 0
        for byte in key:
            if byte not in children[node]:
                children[node][byte] = len(children)
                children.append({})
                ends.append(-1)
            node = children[node][byte]
        ends[node] = number
    # Families get places of their own, side by side; only children fill the gaps between them.
    spans = sum(max(own) - min(own) + 1 for own in children if len(own) > 1)
    size = spans + len(children) + 1024
    base, check, leaf = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    taken = bytearray(size)
    taken[:257] = b"\x01" * 257  # so that no base is below 1
    top = 257
    families = [(node, min(own), max(own)) for node, own in enumerate(children) if len(own) > 1]
    first_of = {}
    for node, low, high in families:
        first_of[node] = top - low
        for byte in children[node]:
            taken[top - low + byte] = 1
        top += high - low + 1
    free, queue = 257, [(0, 0)]
    for node, state in queue:
        leaf[state] = ends[node]
        if not children[node]:
            continue
        if node not in first_of:
            free = taken.index(0, free)
            taken[free] = 1
            first_of[node] = free - next(iter(children[node]))
        base[state] = first_of[node]
        for byte, child in children[node].items():
            check[first_of[node] + byte] = state
            queue.append((child, first_of[node] + byte))
    used = max(i for i, t in enumerate(taken) if t) + 257
    return base[:used].copy(), check[:used].copy(), leaf[:used].copy()


@lru_cache(maxsize=2)
def load(path: str = MODEL) -> Pieces:
    """The pieces of a model file; control and unknown pieces are never written."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    byte_ids = sorted((i for i in range(len(pieces)) if model.is_byte(i)), key=lambda i: int(pieces[i][3:5], 16))
    normal = [i for i in range(len(pieces)) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    whole = math.log(sum(1 / (rank + ZIPF_SHIFT) for rank in range(len(normal))))
    return Pieces(pieces, {i: -math.log(rank + ZIPF_SHIFT) - whole for rank, i in enumerate(normal)}, byte_ids)


def words_of(text: str) -> list[str]:
    """The text cut before each run of spaces; each word stands for a space, the first an added one, and itself.

    No piece has a space behind another character, so the best path of a text is those of its words in a row.
    """
    if not text:
        return []
    if "  " not in text and text[-1] != " ":
        return text.split(" ") if text[0] != " " else [text] if " " not in text[1:] else [text[: text.index(" ", 1)], *text[text.index(" ", 1) + 1 :].split(" ")]
    words, start, at = [], 0, 0
    spaced = " " + text
    while start < len(spaced):
        at = start
        while at < len(spaced) and spaced[at] == " ":
            at += 1
        end = spaced.find(" ", at)
        end = len(spaced) if end < 0 else end
        words.append(spaced[start + 1 : end])
        start = end
    return words


#: A mark in the text itself must not read as a space, so it becomes a byte that no text has, and is written as bytes.
_OWN_MARK = b"\xff"


def marked(word: str) -> bytes:
    """The bytes that the trie reads for a word: spaces as marks, the word's own marks each as one byte unknown to it."""
    return (" " + word).encode("utf-8", "surrogatepass").replace(MARK.encode(), _OWN_MARK).replace(b" ", MARK.encode())


#: Bytes of the character that starts with a byte; 0 within a character.
WIDTH = np.array([1] * 128 + [0] * 64 + [2] * 32 + [3] * 16 + [4] * 8 + [1] * 8, dtype=np.int64)


def fallback(char: bytes) -> bytes:
    """The bytes that stand for an unknown character."""
    return MARK.encode() if char == _OWN_MARK else char
