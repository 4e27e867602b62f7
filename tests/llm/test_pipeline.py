"""Each stage of the pipeline against what its operator is held to by brute force elsewhere, on its own input."""

import random
import zlib

import corpus_pipeline
from tests.llm.test_packing import plain_ids
from tests.llm.test_pii import plain_base
from tests.llm.test_quality import plain_counts
from tests.llm.test_simhash import plain_components
from weirflow.llm import pii, quality, toxicity


def write_tables(spark, folder):
    draw = random.Random(11)
    good = [f"word{i}" for i in range(80)]
    rows, labels = [], []
    for i in range(240):
        words = [draw.choice(good) for _ in range(draw.randint(20, 120))]
        if i % 6 == 0:
            words[3:3] = ["villain", "rotten"]
        if i % 10 == 1:
            words = [w + "###" for w in words]
        if i % 7 == 2:
            words.insert(5, "mail me: jane.doe@example.com or +1 (555) 010-9999")
        if i % 12 == 5:
            words = words[:6]
        text = " ".join(words)
        rows.append((i, rows[i - 1][1] if i % 15 == 14 else text, "en", f"src{i % 3}", None))
        labels.append((i, int(i % 10 != 1), int("villain" in rows[-1][1])))
    rows += [(400, None, "en", None, 0), (401, "", None, "s", 0), (None, "no id " + " ".join(good), "en", "s", 0), (rows[0][0], *rows[0][1:])]
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, columns).selectExpr("doc_id", "text", "lang", "source", "cast(length(text) as long) n_chars").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_stages_take_effect_and_keep_the_rest(spark, tmp_path):
    write_tables(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.read.parquet(f"{tmp_path}/labels.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    stages = dict(corpus_pipeline.STAGES)
    assert names == ["quality_rules", "toxicity", "simhash_dedup", "pii", "packing"]
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.text or "")
    seen = {"documents": sorted(map(key, docs.collect()))}
    at = docs
    for name in names:
        out = stages[name](spark, at, str(tmp_path))
        if name == "packing":
            break
        out.write.parquet(f"{tmp_path}/{name}")
        at = spark.read.parquet(f"{tmp_path}/{name}")
        assert at.columns == docs.columns
        seen[name] = sorted(map(key, at.collect()))
    judged = {(r.doc_id, r.n_words): r for r in quality.score(docs, labels).collect()}
    kept = [k for k in seen["documents"] if judged[(None if k[0] else k[1], plain_counts(k[2])[0])].kept and not plain_counts(k[2])[5]]
    assert seen["quality_rules"] == kept and 150 < len(kept) < 240
    second = spark.read.parquet(f"{tmp_path}/quality_rules")
    scores = {(r.doc_id is None, r.doc_id or 0): r.predicted for r in toxicity.score(second, labels).collect()}
    assert seen["toxicity"] == [k for k in seen["quality_rules"] if not scores[k[:2]]]
    assert not any("villain" in k[2] for k in seen["toxicity"])
    components = plain_components([(None if k[0] else k[1], k[2]) for k in seen["toxicity"]])
    assert {k[1] for k in seen["simhash_dedup"] if not k[0]} == {c[3] for c in components if c[3] is not None}
    assert len(seen["simhash_dedup"]) == len(set(seen["simhash_dedup"])) < len(seen["toxicity"])
    assert seen["pii"] == sorted((*k[:2], pii.redacted(k[2])) for k in seen["simhash_dedup"])
    assert not any(any(plain_base(k[2]).values()) for k in seen["pii"]) and any("[EMAIL]" in k[2] for k in seen["pii"])
    assert at.where("n_chars <> length(text)").count() == 0
    pieces = {(r.doc_id, r.ids_crc32) for r in out.collect()}
    import numpy as np

    assert pieces == {(None if k[0] else k[1], zlib.crc32(np.array(plain_ids(k[2]), "<u4").tobytes())) for k in seen["pii"]}
    whole = {(r.doc_id, r.ids_crc32) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert whole == pieces
