import math
import random
import zlib

import numpy as np
import pytest

from weirflow.llm import counting, encoding, pieces as P

TEXTS = [
    "", " ", "  ", "a", " a", "a ", "Hello  world\n ok", "▁marks▁ stay ▁", "tabs\tand\r\nlines", "é ü 漢字 😀 😀😀", "\x00\x7f", "    four    ", "x" * 700,
    "naïve façade — “quoted”", "the the the", "​﻿", "end▁", "<0x0A> <s> </s> <unk>",
]


def random_texts(count, seed):
    draw = random.Random(seed)
    pool = ["the", "ing", "tion", " ", " ", "  ", "\n", "é", "ß", "▁", "漢", "😀", "q", "zx", "12", "Straße", "\t", "…"]
    return ["".join(draw.choice(pool) for _ in range(draw.randint(0, 30))) for _ in range(count)]


def plain_path_score(text, vocabulary, pieces):
    """The best score of a whole text by dynamic programming over characters and a plain dictionary."""
    shown = (" " + text).replace(P.MARK, "\U0010ffff").replace(" ", P.MARK)
    best = [0.0] + [-math.inf] * len(shown)
    for end in range(1, len(shown) + 1):
        for start in range(max(0, end - 16), end):
            piece = shown[start:end]
            if piece in pieces:
                best[end] = max(best[end], best[start] + vocabulary.score[pieces[piece]])
        if shown[end - 1] not in pieces:
            best[end] = max(best[end], best[end - 1] + vocabulary.unknown)
    return best[-1] if text else 0.0


@pytest.fixture(scope="module")
def vocabulary():
    return P.load()


@pytest.fixture(scope="module")
def by_piece(vocabulary):
    return {w.decode().replace(" ", P.MARK): i for i, w in enumerate(vocabulary.written) if vocabulary.score[i] > -math.inf}


def test_the_double_array_holds_exactly_its_keys():
    draw = random.Random(1)
    keys = {bytes(draw.choice(b"abc\xff") for _ in range(draw.randint(1, 6))): i for i in range(400)}
    base, check, leaf = P.double_array(keys)

    def look(key):
        state = 0
        for byte in key:
            after = base[state] + byte
            if check[after] != state:
                return -1
            state = after
        return leaf[state]

    for _ in range(5000):
        key = bytes(draw.choice(b"abcd\xff") for _ in range(draw.randint(1, 7)))
        assert look(key) == keys.get(key, -1)
    assert all(look(k) == i for k, i in keys.items())


def test_words_put_together_are_the_text():
    for text in TEXTS + random_texts(2000, 3):
        words = P.words_of(text)
        assert "".join(" " + w for w in words)[1:] == text
        assert all(" " not in w.lstrip(" ") for w in words)


def test_blocks_and_single_words_agree_and_scores_are_best(vocabulary, by_piece):
    encoder = encoding.Encoder(vocabulary)
    texts = TEXTS + random_texts(600, 5)
    for text, ids in zip(texts, encoder.encode(texts)):
        alone = b"".join(encoding._ids(P.marked(w), encoding.best_path(P.marked(w), vocabulary), vocabulary) for w in P.words_of(text))
        assert ids == alone, repr(text)
        score, numbers, at = 0.0, np.frombuffer(ids, "<u4").tolist(), 0
        is_byte = set(vocabulary.byte_ids.tolist())
        while at < len(numbers):
            if numbers[at] in is_byte:
                width = int(P.WIDTH[vocabulary.written[numbers[at]][0]])
                score += vocabulary.unknown
                at += width
            else:
                score += vocabulary.score[numbers[at]]
                at += 1
        assert math.isclose(score, plain_path_score(text, vocabulary, by_piece), rel_tol=1e-9, abs_tol=1e-6), repr(text)


def test_every_text_decodes_to_itself(vocabulary):
    encoder = encoding.Encoder(vocabulary)
    texts = TEXTS + random_texts(2000, 9)
    assert [encoder.decode(x) for x in encoder.encode(texts)] == texts


def test_same_ids_as_the_library_with_these_scores(vocabulary):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(P.MODEL, "rb") as file:
        model.ParseFromString(file.read())
    model.trainer_spec.model_type = pb.TrainerSpec.UNIGRAM
    for number, piece in enumerate(model.pieces):
        if vocabulary.score[number] > -math.inf:
            piece.score = float(vocabulary.score[number])
    library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    texts = [t for t in TEXTS + random_texts(800, 11) if P.MARK not in t and "\x00" not in t]
    same = sum(np.frombuffer(ids, "<u4").tolist() == library.encode(text) for text, ids in zip(texts, encoding.Encoder(vocabulary).encode(texts)))
    assert same >= 0.995 * len(texts)  # single-precision ties may fall otherwise


def test_trie_counts_are_the_encoder_s(vocabulary):
    texts = TEXTS + random_texts(3000, 13)
    found = counting.Counter(vocabulary).count(texts)
    assert [n for _, n in found] == [len(x) // 4 for x in encoding.Encoder(vocabulary).encode(texts)]
    assert [w for w, _ in found] == [len(P.words_of(t)) for t in texts]


def test_queries(spark, vocabulary):
    rows = list(enumerate(TEXTS)) + [(0, ""), (None, "null id"), (50, None)]
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, ids int")
    encoded = {(r.doc_id, r.ids_crc32): r for r in encoding.encode_documents(docs).collect()}
    encoder = encoding.Encoder(vocabulary)
    for doc_id, text in rows:
        ids = encoder.encode([text or ""])[0]
        assert encoded[(doc_id, zlib.crc32(ids))].n_pieces == len(ids) // 4 and encoded[(doc_id, zlib.crc32(ids))].round_trip
    counted = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens) for r in counting.token_counts(docs).collect())
    assert counted == sorted((d is None, d or 0, len(encoder.encode([t or ""])[0]) // 4) for d, t in rows)
    back = {(r.doc_id, r.text) for r in encoding.texts(encoding.ids(docs)).collect()}
    assert back == {(d, t or "") for d, t in rows}
    assert encoding.encode_documents(docs.limit(0)).count() == counting.token_counts(docs.limit(0)).count() == 0


def test_long_random_words_take_bounded_memory():
    import tracemalloc

    draw = np.random.default_rng(3)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyzäß0123456789"))
    words = ["".join(draw.choice(letters, size=110)) for _ in range(40_000)]
    counter = counting.Counter(P.load(P.MODEL))
    tracemalloc.start()
    counted = counter.count([" ".join(words)])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert counted[0][0] == len(words) and peak < 120 << 20, peak
    few = words[::2000]
    encoder = encoding.Encoder(P.load(P.MODEL))
    assert [n for _, n in counter.count(few)] == [len(x) // 4 for x in encoder.encode(few)]
