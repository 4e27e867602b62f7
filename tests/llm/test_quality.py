import collections
import math
import random
import re

from weirflow.llm import quality

SCHEMA = "doc_id long, text string, _words string"


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = collections.Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), failed


def corpus():
    draw = random.Random(6)
    good = [f"word{i}" for i in range(60)]
    junk = [f"##{i}" for i in range(60)]
    rows, labels = [], []
    for i in range(80):
        vocabulary = junk if i % 4 == 0 else good
        words = [draw.choice(vocabulary[: draw.choice([5, 60])]) for _ in range(draw.choice([3, 9, 10, 60, 300]))]
        rows.append((i, draw.choice([" ", "\n", " \n\t"]).join(words)))
        labels.append((i, int(i % 4 != 0), 0))
    rows += [(100, None), (101, ""), (102, " \n \t"), (103, "a b c d e " * 40), (104, "x" * 30_000), (104, "x" * 30_000), (None, "é ü ß |"), (105, "a\r\nb\x0bc\x0cd")]
    return rows, labels


def plain_ratio(spark, rows, labels, buckets):
    """Counts by brute force; only the hash of a word and of a pair is Spark's."""
    trusted = {i for i, q, _ in labels if q == 1}
    words = {w for _, t in rows for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")}
    hashed = {r.w: r.h for r in spark.createDataFrame([(w,) for w in words], "w string").selectExpr("w", "xxhash64(w) h").collect()}
    pairs = {(hashed[a], hashed[b]) for _, t in rows for w in [re.findall(r"[^\x20\x09-\x0D]+", t or "")] for a, b in zip(w, w[1:])}
    paired = {(r.a, r.b): r.h for r in spark.createDataFrame(list(pairs), "a long, b long").selectExpr("a", "b", "xxhash64(a, b) h").collect()}
    raw, target, grams = collections.Counter(), collections.Counter(), []
    for doc_id, text in rows:
        w = [hashed[x] for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
        found = [x % buckets for x in w + [paired[p] for p in zip(w, w[1:])]]
        grams.append(found)
        raw.update(found)
        if doc_id in trusted:
            target.update(found)
    share = lambda c, b: (c[b] + quality.SMOOTHING) / (c.total() + quality.SMOOTHING * buckets)
    return [sum(math.log(share(target, b) / share(raw, b)) for b in g) / len(g) if g else 0.0 for g in grams]


def test_counts_scores_and_verdicts_match_brute_force(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    marked = spark.createDataFrame(labels + labels[:5] + [(None, 1, 0), (999, 1, None)], "doc_id long, quality int, toxic int")
    out = quality.score(docs, marked, buckets=512).collect()
    scores = plain_ratio(spark, rows, labels, 512)
    expected = sorted(
        (d is None, d or 0, *plain_counts(t), not plain_counts(t)[5] and s >= quality.THRESHOLD, round(s, 9)) for (d, t), s in zip(rows, scores)
    )
    found = sorted((r.doc_id is None, r.doc_id or 0, *r[1:8], round(r.score, 9)) for r in out)
    assert found == expected
    assert {r.kept for r in out} == {True, False} and any(not r.base_failed and not r.kept for r in out)


def test_stage_keeps_whole_rows(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    marked = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    kept = quality.keep(docs, marked, buckets=512)
    assert kept.columns == docs.columns
    wanted = {r.doc_id for r in quality.score(docs, marked, buckets=512).where("kept").collect()}
    assert {r.doc_id for r in kept.collect()} == wanted and all(r._words == "clash" for r in kept.collect())


def test_no_python_on_the_main_path_and_empty_tables(spark):
    rows, labels = corpus()
    marked = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(*r, "") for r in rows], SCHEMA)
    plan = quality.score(docs, marked)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert quality.score(docs.limit(0), marked).count() == 0
    none = quality.score(docs, marked.limit(0))
    assert none.where("score <> 0").count() == 0 and none.count() == len(rows)
