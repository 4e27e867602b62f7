import itertools
import math
import random
import zlib

import numpy as np
import pytest

from weirflow.llm import toxicity

WORDS = ["water", "river", "stone", "green", "table", "paper", "window", "garden", "summer", "letter", "number", "people"]
BAD = ["villain", "rotten", "dreadful", "wretch"]


def corpus(size=700, seed=3):
    draw = random.Random(seed)
    rows, labels = [], []
    for i in range(size):
        words = [draw.choice(WORDS) for _ in range(draw.randint(5, 40))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(2):
                words.insert(draw.randrange(len(words)), draw.choice(BAD))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def fitted(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marked = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return docs, marked, toxicity.fit(docs, marked)


def test_trigram_counts_match_brute_force(spark):
    texts = ["Ab c", "é", None, "", "ab  ab!", "x" * 5000]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    expected = {}
    for text in texts:
        codes = [0, 0]
        for c in (text or "").lower() + " ":
            codes.append(ord(c) - 96 if "a" <= c <= "z" else 27 if ord(c) > 127 else 0)
        for a, b, c in zip(codes, codes[1:], codes[2:]):
            key = (0 if b == 0 else a) << 10 | b << 5 | c
            expected[key] = expected.get(key, 0) + 1
    assert {r.gram: r.n for r in toxicity.trigram_counts(docs).collect()} == expected


def test_decoding_finds_the_cheapest_reading(fitted):
    costs = fitted[2].costs.tolist()

    def cheapest(observed):
        choices = []
        for i, c in enumerate(observed):
            run = i and observed[i - 1] == c
            long_run = run and (i > 1 and observed[i - 2] == c or observed[i + 1 : i + 2] == c)
            options = [(c, 0.0)] if c.isalpha() else []
            options += [(x, toxicity.COST_RESEMBLING) for x in toxicity.RESEMBLES.get(c, "")]
            if c in toxicity.SEPARATORS:
                options.append(("", toxicity.COST_SEPARATOR))
            elif run:
                options.append(("", toxicity.COST_LONG_RUN if long_run else toxicity.COST_REPEATED))
            if not options or c in toxicity.RESEMBLES and not c.isalpha():
                options.append((c, toxicity.COST_AS_IS))
            choices.append(options)
        readings = {}
        for path in itertools.product(*choices):
            a = b = 0
            total = 0.0
            for written, asked in path:
                total += asked
                for x in written:
                    total += costs[a << 10 | b << 5 | toxicity._code(x)]
                    a, b = b, toxicity._code(x)
            reading = "".join(written for written, _ in path)
            readings[reading] = min(readings.get(reading, math.inf), total + costs[a << 10 | b << 5])
        return readings

    for observed in ["v1lla1n", "r.o.t.t.e.n", "dreadfuuul", "w|2", "wr3tch", "11", "aab", "st0n3", "5umm3r", "+a813", "lleett", "s-s", "0o0", "b@@d"]:
        readings = cheapest(observed)
        least = min(readings.values())
        # language and channel costs of the whole path: no other reading costs less, and this one costs no more
        assert toxicity.decode(observed, costs) in {x for x, total in readings.items() if total <= least + 1e-5}, observed


def test_scores_match_a_plain_sum(spark, fitted):
    docs, _, model = fitted
    weight = dict(zip(model.names, model.weights))
    costs = model.costs.tolist()
    rows = docs.limit(80).collect()
    found = {r.doc_id: r.score for r in spark.createDataFrame(rows, docs.schema).select("doc_id", "text").mapInArrow(toxicity._scores(model), "doc_id long, score double").collect()}
    told = 0
    for row in rows:
        words = [w for token in row.text.lower().split() for w in toxicity.restore(token, costs)]
        named = {f"={w}" for w in words} | {f"^{w[:n]}" for w in words for n in toxicity.PREFIXES if len(w) > n}
        total = model.intercept + sum(weight.get(x, 0.0) for x in named)
        told += any(x in weight for x in named)
        assert abs(found[row.doc_id] - 1 / (1 + math.exp(-total))) < 1e-9
    assert told > 5


@pytest.mark.parametrize(
    ("shown", "meant"),
    [("v1ll@in", "villain"), ("r0tt3n", "rotten"), ("dreadfuuuul", "dreadful"), ("w.r.e.t.c.h", "wretch"), ("w-r-3-t-c-h!", "wretch"), ("stone***", "stone"), ("river,", "river")],
)
def test_disguises_are_restored(fitted, shown, meant):
    assert toxicity.restore(shown, fitted[2].costs.tolist()) == [meant]


@pytest.mark.parametrize(
    ("shown", "meant"),
    [
        ("w-r-e-t-c-h-w-r-e-t-c-h-w-r-e-t-c-h", "wretchwretchwretch"), ("rotte" + "n" * 30, "rotten"), ("vviillllaaiinn", "villain"), ("dre@d.fu1", "dreadful"), ("dreаdful", "dreadful"),
        ("letter", "letter"), ("summer", "summer"), ("some.one@mail.example.org", "some.one@mail.example.org"), ("https://a.b/vv11", "https://a.b/vv11"), ("0badc0ffee0badc0ffee", "0badc0ffee0badc0ffee"),
    ],
)
def test_every_disguise_reaches_the_lattice(fitted, shown, meant):
    costs = fitted[2].costs.tolist()
    assert toxicity.restore(shown, costs)[-1] == meant


def test_hex_letters_are_words_and_spaced_runs_are_joined(fitted):
    costs = fitted[2].costs
    assert toxicity.restore("baaaaaaaaaaaad", costs.tolist()) != ["baaaaaaaaaaaad"]
    features = toxicity._Features(costs, None)
    assert all("=rotten" in features.of_text(x) for x in ("the r o t t e n one", "r  o t\tt\ne n", "r o t t e n"))
    assert "=wet" in features.of_text("some w e t river")


def test_held_out_accuracy_and_disguised_texts(spark, fitted):
    docs, labels, _ = fitted
    disguised = [(10_000 + i, f"the {x} of people and water") for i, x in enumerate(["v1ll@in", "r o t t e n", "dreadfuuul", "w.r.e.t.c.h", "garden", "w1nd0w"])]
    more = docs.unionByName(spark.createDataFrame(disguised, "doc_id long, text string"))
    out = {r.doc_id: r for r in toxicity.score(more, labels).collect()}
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [i for i in truth if out[i].held_out]
    assert held == [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([out[i].predicted == truth[i] for i in held]) > 0.97
    assert [out[i].predicted for i, _ in disguised] == [1, 1, 1, 1, 0, 0]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out.values())


def test_edge_rows(spark, fitted):
    _, labels, _ = fitted
    docs, _, _ = fitted
    odd = spark.createDataFrame([(None, "river", "c"), (1, None, "c"), (1, "", "c"), (2, "a" * 100_000, "c"), (3, "$@!|+ 1 2 3 \x00 . . .", "c")], "doc_id long, text string, score string")
    everything = docs.selectExpr("doc_id + 100000 as doc_id", "text", "'c' as score").unionByName(odd)
    out = toxicity.score(everything, labels.selectExpr("doc_id + 100000 as doc_id", "toxic")).where("doc_id is null or doc_id < 10").collect()
    assert len(out) == 5 and len({r.score for r in out if r.doc_id == 1}) == 1
    assert [r.held_out for r in out if r.doc_id is None] == [True]
    kept = toxicity.keep(everything, labels.selectExpr("doc_id + 100000 as doc_id", "toxic"))
    assert kept.columns == everything.columns and kept.count() < everything.count()
    assert toxicity.score(odd, labels.limit(0)).where("predicted = 1").count() == 0
    assert toxicity.score(odd.limit(0), labels).count() == 0
