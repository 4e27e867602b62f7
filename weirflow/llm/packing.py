"""Best-fit packing of token sequences with swap-based local search.

Every document becomes token ids with an end id. A document longer than a sequence is cut into pieces, of which the
first may be shorter; pieces are packed whole. The pieces are dealt into groups of bounded size, and each group is
packed by best fit decreasing and then improved: moving one or two pieces, or exchanging one for one or two for one,
between any two underfull bins, each step increasing the sum of squared fills, until no step is left.
"""

from __future__ import annotations

import array
import base64
import bisect
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, functions as F

from weirflow.llm.common import Memory, small_batches, staged, texts_of

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
CAPACITY = 2048
END_ID = 0
#: Pieces that one task packs at a time.
GROUP_PIECES = 20_000
#: The same vocabulary as ranks: merges the common chunks several times as fast, to the same ids.
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")

_tokenizers: dict[str, object] = {}
_chunks: dict[tuple[str, str], Memory] = {}
#: White space and controls other than single spaces and line ends between words.
_ODD_PAIRS = ("  ", " \n", "\n ", "\n\n")
_ODD_SIGNS = tuple("\x00\t\x0b\x0c\r\x1c\x1d\x1e\x1f")
_ODD_WIDE = re.compile("[\x85\xa0\u1680\u2000-\u200f\u2028-\u202f\u205f-\u206f\u3000\ufeff]")


def _oddly_spaced(text: str) -> bool:
    if not text or text[0] != " " and text[0].isspace() or text[-1].isspace() or any(x in text for x in _ODD_PAIRS) or any(x in text for x in _ODD_SIGNS):
        return True
    return not text.isascii() and _ODD_WIDE.search(text) is not None


def _tokenizer(path: str):
    if path not in _tokenizers:
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(path)
        found.encode_special_tokens = True
        _tokenizers[path] = found
    return _tokenizers[path]


def _ranked(path: str):
    if path not in _tokenizers:
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, file)}
        _tokenizers[path] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _tokenizers[path]


def _packed(ids: list[int]) -> bytes:
    return array.array("I", ids).tobytes()


#: The two libraries know the letters up to here alike; chunks with others go to the tokenizer itself.
_PLAIN = re.compile("[\x00-\u024f]*")


def encode(texts: list[str], tokenizer: str = TOKENIZER, ranks: str = RANKS) -> list[bytes]:
    """Token ids of each text as little-endian unsigned 32-bit numbers.

    Texts of plain letters are encoded by the rank file of the same vocabulary, which merges several times as fast.
    The tokenizer splits others before each space that a word follows and around each line end before it merges
    anything, so chunks cut there are encoded by themselves, each distinct one once. Texts with other white space
    are encoded whole by the tokenizer itself.
    """
    whole, fast, memory = _tokenizer(tokenizer), _ranked(ranks), _chunks.setdefault((tokenizer, ranks), Memory())
    cut: list[list[str] | None] = []
    done: dict[int, bytes] = {}
    for place, text in enumerate(texts):
        if _oddly_spaced(text):
            cut.append(None)
            done[place] = _packed(whole.encode(text, add_special_tokens=False).ids)
        elif _PLAIN.fullmatch(text):
            cut.append(None)
            done[place] = _packed(fast.encode_ordinary(text))
        else:  # a chunk is a word with the space before it, a word at a line's start, or a line end
            cut.append(text.replace("\n", "\x00\n\x00").replace(" ", "\x00 ").split("\x00"))

    def learn(new: list[str]) -> Iterator[bytes]:
        for chunk in new:
            plain = _PLAIN.fullmatch(chunk)
            yield _packed(fast.encode_ordinary(chunk) if plain else whole.encode(chunk, add_special_tokens=False).ids)

    get = memory.recall(set().union(*filter(None, cut)), learn).__getitem__
    return [done[place] if chunks is None else b"".join(map(get, chunks)) for place, chunks in enumerate(cut)]


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_END = _packed([END_ID])


def _cut_batches(tokenizer: str, ranks: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 256):
            rows = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode(texts_of(batch, "text"), tokenizer, ranks)):
                ids += _END
                total, at, piece = len(ids) // 4, 0, 0
                while at < total:
                    length = (total % capacity or capacity) if not at else capacity
                    rows.append((doc_id, piece, at, length, zlib.crc32(ids[4 * at : 4 * (at + length)])))
                    at, piece = at + length, piece + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                [x.split()[0] for x in _PIECES.split(", ")],
            )

    return run


def pieces(docs: DataFrame, tokenizer: str = TOKENIZER, ranks: str = RANKS, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece of each row of docs(doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_cut_batches(tokenizer, ranks, capacity), _PIECES)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of piece numbers: the longest first, each into the fullest bin that has room."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms: list[int] = []  # sorted, those with a bin
    for number in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        length = lengths[number]
        place = bisect.bisect_left(rooms, length)
        if place == len(rooms):
            room, target = capacity, len(bins)
            bins.append([])
        else:
            room = rooms[place]
            target = by_room[room].pop()
            if not by_room[room]:
                rooms.pop(place)
        bins[target].append(number)
        room -= length
        if room:
            if not by_room[room]:
                bisect.insort(rooms, room)
            by_room[room].append(target)
    return bins


class _Bins:
    """Underfull bins as partners, to be searched by what they can take.

    A bin with free room r that gives a piece of length b (0: none) takes up to b + r, its reach. by_reach[b + r] has
    the bit b set for each such offer, reaches the bit b + r; holders tells whose the offers are.
    """

    def __init__(self, lengths: list[int], bins: list[list[int]], capacity: int) -> None:
        self.lengths, self.capacity, self.bins = lengths, capacity, bins
        self.room = [capacity - sum(lengths[i] for i in b) for b in bins]
        self.by_reach, self.reaches = [0] * (capacity + 1), 0
        self.holders: dict[tuple[int, int], dict[int, None]] = {}
        for b in range(len(bins)):
            self.offer(b)

    def _offers(self, bin_: int) -> set[int]:
        return {0, *(self.lengths[i] for i in self.bins[bin_])} if self.bins[bin_] and self.room[bin_] > 0 else set()

    def offer(self, bin_: int) -> None:
        for back in self._offers(bin_):
            reach = back + self.room[bin_]
            self.by_reach[reach] |= 1 << back
            self.reaches |= 1 << reach
            self.holders.setdefault((reach, back), {})[bin_] = None

    def withdraw(self, bin_: int) -> None:
        for back in self._offers(bin_):
            reach = back + self.room[bin_]
            held = self.holders[reach, back]
            del held[bin_]
            if not held:
                self.by_reach[reach] &= ~(1 << back)
                if not self.by_reach[reach]:
                    self.reaches &= ~(1 << reach)

    def put(self, bin_: int, numbers: list[int], out: list[int]) -> None:
        for i in out:
            self.bins[bin_].remove(i)
        self.bins[bin_] += numbers
        self.room[bin_] += sum(self.lengths[i] for i in out) - sum(self.lengths[i] for i in numbers)


def improve(lengths: list[int], bins: list[list[int]], capacity: int) -> list[list[int]]:
    """Fewer bins, if local search finds a way.

    All underfull bins are victims in turn, the least full first. One or two pieces of the victim move to the
    underfull bin that they fill best, or are exchanged for one piece shorter than they are together, such that the
    other bin becomes fuller. As the partner is at least as full as the victim, each step increases the sum of squared
    fills, so the search ends; a victim that empties is a bin less. Passes over all underfull bins are repeated until
    one takes no step, or no fewer bins could hold the pieces.
    """
    state = _Bins(lengths, [list(b) for b in bins], capacity)
    left, least = len(bins), -(-sum(lengths) // capacity)
    moved = True
    while moved and left > least:
        moved = False
        for victim in sorted((b for b in range(len(bins)) if state.bins[b] and state.room[b] > 0), key=lambda b: -state.room[b]):
            if not state.room[victim]:  # filled up meanwhile
                continue
            state.withdraw(victim)
            while state.bins[victim] and (step := _best_step(state, victim)):
                partner, given, taken = step
                state.withdraw(partner)
                state.put(partner, given, taken)
                state.put(victim, taken, given)
                state.offer(partner)
                moved = True
            state.offer(victim)
            if not state.bins[victim]:
                left -= 1
                if left == least:
                    break
    return [b for b in state.bins if b]


def _best_step(state: _Bins, victim: int) -> tuple[int, list[int], list[int]] | None:
    """The step that leaves the partner fullest: (partner, given to it, taken from it)."""
    lengths, room = state.lengths, state.room[victim]
    own: dict[int, list[int]] = {}
    for i in state.bins[victim]:
        own.setdefault(lengths[i], []).append(i)
    sizes = sorted(own, reverse=True)  # few: the distinct lengths in a bin add up to its capacity at most
    wanted = {size: (size,) for size in sizes}
    for place, size in enumerate(sizes):
        if len(own[size]) > 1:
            wanted.setdefault(2 * size, (size, size))
        for other in sizes[place + 1 :]:
            wanted.setdefault(size + other, (size, other))
    best, least = None, state.capacity + 1
    for gain, parts in wanted.items():
        reaches, over = state.reaches >> gain, 0
        while reaches:
            skip = (reaches & -reaches).bit_length() - 1
            over += skip
            if over >= least:
                break
            # what comes back is shorter than what is given, and the partner's room no more than the victim's
            low = max(0, gain + over - room)
            fit = (state.by_reach[gain + over] >> low) & ((1 << (gain - low)) - 1) if low < gain else 0
            if fit:
                best, least = (gain + over, low + (fit & -fit).bit_length() - 1, parts), over
                break
            reaches >>= skip + 1
            over += 1
        if not least:
            break
    if best is None:
        return None
    reach, back, parts = best
    partner = next(iter(state.holders[reach, back]))
    given = own[parts[0]][:2] if len(parts) == 2 and parts[0] == parts[1] else [own[size][0] for size in parts]
    return partner, given, [next(i for i in state.bins[partner] if lengths[i] == back)] if back else []


def pack_lengths(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    return improve(lengths, best_fit(lengths, capacity), capacity)


def _pack_group(capacity: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.drop_columns("_group").sort_by([(c, "ascending") for c in ("length", "doc_id", "piece")])
        sequence, offset = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        lengths = rows["length"].to_pylist()
        for number, bin_ in enumerate(pack_lengths(lengths, capacity)):
            at = 0
            for i in bin_:
                sequence[i], offset[i] = (key[0].as_py() << 24) + number, at
                at += lengths[i]
        return rows.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    return run


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, ranks: str = RANKS, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    The pieces are staged once, then dealt evenly into ceil(n / group_pieces) groups by their place in the staged
    table, whatever their documents' ids, so no group is large. A null text is the empty text: one piece of the end
    id alone. Repeated rows are packed each for itself, null ids stay null, an empty table gives no rows.
    """
    found = staged(pieces(docs, tokenizer, ranks, capacity), "pieces")
    groups = max(1, -(-found.count() // group_pieces))
    dealt = found.withColumn("_group", F.pmod(F.monotonically_increasing_id(), F.lit(groups)))
    return dealt.groupBy("_group").applyInArrow(_pack_group(capacity), f"{_PIECES}, sequence_id long, offset long")
