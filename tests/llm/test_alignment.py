import hashlib
import itertools
import random
import tracemalloc
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from weirflow.llm import alignment, packing, queries

SF = "/root/testdata/sf0.001"
A = Tokenizer.from_file(packing.TOKENIZER)
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=alignment.PIECES)


def b_bytes(i):
    return bytes([int(B.id_to_piece(i)[3:5], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode()


def plain_groups(text):
    """Groups by the ends that both sides share, from the libraries themselves; None for a text without tokens."""
    spelled = (" " + (text or "")).encode()
    made = A.encode(" " + (text or ""), add_special_tokens=False)
    a, b = made.ids, B.encode(text or "")
    if not text or b"".join(map(b_bytes, b)) != spelled:
        return None
    signs = {c: n for n, c in alignment._byte_of_sign().items()}
    assert "".join(map(A.id_to_token, a)) == "".join(signs[x] for x in spelled)
    ends = [list(itertools.accumulate(len(A.id_to_token(i)) for i in a)), list(itertools.accumulate(len(b_bytes(i)) for i in b))]
    shared = sorted(set(ends[0]) & set(ends[1]))
    out, at = [], [0, 0]
    for end in shared:
        group = []
        for side, ids in enumerate((a, b)):
            start = at[side]
            while at[side] < len(ids) and ends[side][at[side]] <= end:
                at[side] += 1
            group.append(ids[start : at[side]])
        out.append(group)
    assert at == [len(a), len(b)]
    return out


def plain_rows(rows):
    found = [(i, plain_groups(t)) for i, t in rows]
    held = [Counter((x, y) for a, b in g or [] for x in a for y in b) for _, g in found]
    count = Counter(pair for h in held for pair in h)
    most = defaultdict(int)
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    out = []
    for (i, g), h in zip(found, held):
        written = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g or [])
        out.append(
            (-1 if i is None else i, sum(len(a) for a, _ in g or []), sum(len(b) for _, b in g or []), len(g or []), sum(h.values()), sum(n for p, n in h.items() if count[p] == most[p[0]]),
             sum(n * count[p] for p, n in h.items()), hashlib.sha256(written.encode()).hexdigest() if g else "")
        )
    return sorted(out)


def rows_of(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect())


def drawn_texts():
    draw = random.Random(6)
    pool = ["a", "the", "The ", " ", "  ", "\n", "\n\n", "\t", "é", "😀", "don't", "12,345.", "***", "日本語", "　", "\x85", "\x00", "<|endoftext|>", "</s>", "<0x41>", "_x", "\r\n", "ß's", "▁", "ﬁ"]
    return ["", " ", "\n", "a", "▁", *("".join(draw.choice(pool) for _ in range(draw.randint(1, 14))) for _ in range(400)), "aaaa" * 3000, "日本" * 800, "x " * 3000, "=" * 777]


def test_whole_table(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    found = rows_of(queries.queries()["op13_token_alignment"](spark, SF))
    assert found == plain_rows(rows) and len(found) == len(rows)


def test_edges(spark, monkeypatch):
    rows = list(enumerate(drawn_texts())) + [(None, "null id"), (7, None), (7, "again"), (7, "again")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, chunk int, pair int")
    assert rows_of(alignment.digest(docs.repartition(3))) == plain_rows(rows)
    assert alignment.digest(docs.limit(0)).count() == 0
    assert rows_of(alignment.digest(docs.where("text IS NULL"))) == [(7, 0, 0, 0, 0, 0, 0, "")]


def test_links_in_slabs(monkeypatch):
    aligner = alignment.Aligner(packing.TOKENIZER, packing.RANKS, alignment.PIECES)
    found = aligner.align([t for t in drawn_texts() if t][:200])
    whole = found.links()
    monkeypatch.setattr(alignment, "SLAB", 7)
    assert all((a == b).all() for a, b in zip(whole, found.links()))


def test_groups_as_rows(spark):
    texts = drawn_texts()
    out = {r.doc_id: r.groups for r in alignment.groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, text in enumerate(texts):
        assert [[g.a_ids, g.b_ids] for g in out[i]] == (plain_groups(text) or [])
        assert [g.start for g in out[i]] == [0, *(g.end for g in out[i])][: len(out[i])]
        assert not out[i] or out[i][-1].end == len((" " + text).encode())


def test_words_encode_as_whole_texts():
    encoder = alignment.PieceEncoder(alignment.PIECES)
    texts = [t for t in drawn_texts() if "▁" not in t]
    for text, found in zip(texts, encoder.encode(texts)):
        assert (found.tolist() if found is not None else None) == (B.encode(text) if plain_groups(text) or not text else None), repr(text)
    assert all(isinstance(x, np.ndarray) for x in encoder.encode([""]))


@pytest.fixture
def chunks_of(monkeypatch):
    """The rows that a task makes of texts."""
    monkeypatch.setattr(alignment.TaskContext, "get", lambda: type("Task", (), {"partitionId": lambda self: 3})())

    def run(texts):
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])
        return list(alignment._chunk_batches(packing.TOKENIZER, packing.RANKS, alignment.PIECES)(iter([batch])))

    return run


def test_chunks_by_parts(chunks_of, monkeypatch):
    texts = [*drawn_texts(), None]
    whole = chunks_of(texts)
    assert len(whole) == 2 and whole[0].num_rows == len(texts)
    monkeypatch.setattr(alignment, "PART_BYTES", 100)
    assert chunks_of(texts) == whole


def test_memory_of_a_chunk(chunks_of):
    draw = random.Random(7)
    words = ["".join(draw.choices("abcdefghij", k=draw.randint(2, 7))) for _ in range(3000)]
    texts = [" ".join(draw.choices(words, k=250)) for _ in range(1500)]
    assert 1 << 20 < sum(map(len, texts)) < alignment.CHUNK_BYTES
    chunks_of(texts[:1])
    tracemalloc.start()
    found = chunks_of(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == 2 and peak < 60 << 20, peak
