import hashlib
import random

import numpy as np
import xxhash

from weirflow.llm import spotsigs


def plain_chains(text):
    words = [w.strip(spotsigs._PUNCTUATION) for w in text.lower().split()]
    words = [w for w in words if w]
    chains = set()
    for i, word in enumerate(words):
        if word in spotsigs.ANCHORS:
            behind = [w for w in words[i + 1 :] if w not in spotsigs.ANCHORS][:2]
            if len(behind) == 2:
                chains.add((word, *behind))
    return chains


def random_text(draw, size):
    pool = ["the", "of", "and", "la", "der", *[f"w{i}" for i in range(50)], "w1,", "***", "É."]
    return draw.choice([" ", "\n"]).join(draw.choice(pool) for _ in range(size))


def test_signatures_are_the_chains():
    draw = random.Random(1)
    with np.errstate(over="ignore"):
        for _ in range(400):
            a, b = random_text(draw, draw.randint(0, 60)), random_text(draw, draw.randint(0, 60))
            x, y = plain_chains(a), plain_chains(b)
            if x and y:
                assert len(spotsigs.signatures(a)) == len(x)
                assert spotsigs.likeness(spotsigs.signatures(a), spotsigs.signatures(b)) == len(x & y) / len(x | y)
        assert len(spotsigs.signatures("")) == len(spotsigs.signatures("the of")) == len(spotsigs.signatures("***")) == 1
        assert spotsigs.signatures("one two")[0] != spotsigs.signatures("two one")[0]


def test_pruning_loses_nothing():
    draw = np.random.default_rng(2)
    for _ in range(600):
        a = np.unique(draw.integers(0, 400, size=draw.integers(1, 300))).astype("<u4")
        b = np.unique(np.r_[a[draw.random(len(a)) < draw.choice([0.2, 0.9, 1.0])], draw.integers(0, 400, size=draw.integers(1, 30))]).astype("<u4")
        exact = spotsigs.likeness(a, b)
        for threshold in (0.5, 0.8):
            assert spotsigs.pruned_likeness(a, b, threshold, step=16) == (exact if exact >= threshold else None)


def test_rows_match_brute_force(spark):
    draw = random.Random(5)
    rows = [(draw.randint(-500, 5000), random_text(draw, draw.choice([0, 1, 3, 80, 400]))) for _ in range(150)]
    rows = list({i: (i, t) for i, t in rows}.values()) + [(9001, None), (9000, "😀" * 7), (None, "no id"), (8999, "the same text, of course and more"), (8998, "the same text, of course and more")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, _bucket string")
    ordered = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    found = {r.doc_id: r for r in spotsigs.fingerprint_documents(docs).collect()}
    assert len(found) == len(rows)
    for place, (doc_id, text) in enumerate(ordered):
        text, following = text or "", ordered[(place + 1) % len(ordered)][1] or ""
        third = len(text) // 3
        changed = text[: len(text) - third] + following[:third]
        r = found[doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        a, b, c = (plain_chains(t) for t in (text, changed, following))
        if a and b and c:
            assert abs(r.near_edited - len(a & b) / len(a | b)) < 1e-9 and abs(r.near_next - len(a & c) / len(a | c)) < 1e-9
            assert r.match_edited == (r.near_edited >= 0.8) and r.match_next == (r.near_next >= 0.8)
        assert 0 <= r.near_edited <= 1 and spotsigs.told(spotsigs.read(r.fingerprint)) == r.fingerprint
    assert found[8999].fingerprint == found[8998].fingerprint and found[8999].near_next == 1.0


def test_one_row_repeated_rows_and_no_row(spark):
    one = spark.createDataFrame([(7, "the cat sat of them all")], "doc_id long, text string")
    row = spotsigs.fingerprint_documents(one).first()
    assert row.near_next == 1.0 and row.doc_id == 7
    assert spotsigs.fingerprint_documents(one.unionByName(one).unionByName(one)).count() == 3
    assert spotsigs.fingerprint_documents(one.limit(0)).count() == 0
    assert xxhash.xxh64_intdigest("a") != 0


def test_many_ranges_hot_ids_and_rows_without_id(spark):
    draw = random.Random(9)
    rows = [(draw.randint(-50, 50), random_text(draw, 12)) for _ in range(200)] + [(7, random_text(draw, 12)) for _ in range(300)] + [(None, random_text(draw, 12)) for _ in range(150)]
    rows += [rows[0]] * 5 + [(1 << 62, "far up of all there"), (-(1 << 63), "far down of all there"), (0, None)]
    tie = lambda text: (xxhash.xxh64_intdigest(text, 42) + (1 << 63)) % (1 << 64)
    ordered = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), tie(r[1])))
    expected = sorted(
        (r[0] is None, r[0] or 0, hashlib.sha256(spotsigs.edited(r[1], ordered[(k + 1) % len(ordered)][1]).encode()).hexdigest()) for k, r in enumerate(ordered)
    )
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for size in (200, 2_000, 1 << 30):
        found = spotsigs.fingerprint_documents(docs, range_bytes=size).collect()
        assert sorted((r.doc_id is None, r.doc_id or 0, r.edited_sha256) for r in found) == expected
    assert spotsigs._Ranges(docs.withColumn("_tie", docs.doc_id), 200, 1000).count > 100
