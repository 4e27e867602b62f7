import struct
import time

from pyspark.sql import functions as F

from weirflow.operators import ordering
from weirflow.plans import fixpoint
from weirflow.sources import container, export, ingest
from weirflow.streaming import ingest as stream


def varint(value):
    out = b""
    while True:
        out += bytes([value & 127 | (128 if value > 127 else 0)])
        value >>= 7
        if not value:
            return out


def sample():
    strings = [b"alpha", b"caf\xc3\xa9", b"x" * 200]
    constants = b"".join(
        [b"\x00", b"\x01\x01", b"\x02" + struct.pack("<d", 2.5), b"\x03" + varint(3), b"\x04" + struct.pack("<I", 1 << 30), b"\x05" + varint(2) + varint(0) + varint(1), b"\x06" + varint(0), b"\x07" + struct.pack("<4f", 1, 2, 3, 4), b"\x09\x01" + varint(1 << 40)]
    )
    function = bytes([5, 2, 1, 1, 7]) + varint(3) + b"\x01\x02\x03" + varint(3) + struct.pack("<3I", 1, 2, 1 << 31) + varint(9) + constants + varint(1) + varint(0) + varint(300) + varint(1)
    function += b"\x01\x01" + b"\x01\x00\xff" + struct.pack("<2i", 10, 20) + b"\x01" + varint(1) + varint(1) + varint(0) + varint(200) + b"\x04" + varint(1) + varint(2)
    table = varint(len(strings)) + b"".join(varint(len(s)) + s for s in strings)
    return bytes([6, 3]) + table + b"\x01" + varint(1) + b"\x00" + varint(1) + function + varint(0)


def test_containers_and_every_prefix(spark):
    whole = sample()
    chunks = [(0, whole), (1, b""), (2, b"\x00boom"), (3, b"\x63"), (4, b"\x06\x09"), (5, None)] + [(100 + i, whole[:i]) for i in range(len(whole))]
    rows = container.decode_chunks(spark.createDataFrame(chunks, "chunk_id long, content binary")).cache()
    units = {r.chunk_id: r for r in container.units(rows).collect()}
    assert (units[0].status, units[0].version, units[0].types_version, units[0].main_fid) == ("ok", 6, 3, 0)
    assert [units[i].status for i in (1, 2, 3, 4, 5)] == ["damaged", "compile_error", "unsupported", "unsupported_types", "damaged"]
    assert units[2].message == "boom" and all(units[100 + i].status == "damaged" for i in range(2, len(whole)))
    assert {r.chunk_id for r in rows.where("tag <> 'unit'").select("chunk_id").distinct().collect()} == {0}
    assert [r.word for r in container.words(rows).orderBy("pos").collect()] == [1, 2, 1 << 31]
    found = {r.k: r for r in container.constants(rows).collect()}
    assert [found[k].kind for k in range(9)] == ["nil", "boolean", "number", "string", "path", "template", "function", "vector", "integer"]
    assert found[2].num == 2.5 and found[3].text == "x" * 200 and found[5].text == "0,1" and found[8].whole == -(1 << 40)
    assert rows.where("tag = 'line_base'").count() == 2 and rows.where("tag = 'local'").first().b == 200


def test_files_versions_and_quarantine(spark, tmp_path):
    for name, data in (("a.bin", sample()), ("b.bin", b""), ("c.bin", b"\x00x"), ("d e%.bin", b"\x00"), ("f+ g.bin", b"")):
        (tmp_path / name).write_bytes(data)
    chunks = ingest.read_chunks(spark, str(tmp_path))
    assert {r.path.rsplit("/", 1)[1] for r in chunks.collect()} == {"a.bin", "b.bin", "c.bin", "d e%.bin", "f+ g.bin"}
    gated = {r.path[-5:]: r.status for r in ingest.gate_versions(chunks).collect()}
    assert gated == {"a.bin": "ok", "b.bin": "empty", "c.bin": "compile_error", "%.bin": "compile_error", "g.bin": "empty"}
    assert {r.path[-5:]: (r.status, r.length, r.content is None) for r in chunks.where("path like '%b.bin' or path like '%c.bin'").collect()} == {"b.bin": ("empty", 0, True), "c.bin": ("ok", 2, False)}
    none = spark.createDataFrame([(b"",), (None,)], "content binary")
    assert [r.status for r in ingest.gate_versions(none).collect()] == ["empty", "empty"]
    rows = spark.createDataFrame([(1, "a"), (2, None)], "id long, v string")
    good, failed = ingest.quarantine(rows, F.col("v") == "a")
    assert [r.id for r in good.collect()] == [1] and [r.id for r in failed.collect()] == [2]


def test_base64_of_odd_texts(spark):
    rows = spark.createDataFrame([("aGk=",), ("a G k",), ("",), (None,), ("!!",), ("aGk=ignored",), ("a",)], "t string")
    assert [bytes(r.content).decode() for r in ingest.decode_base64(rows, "t").collect()] == ["hi", "hi", "", "", "", "hi", ""]


def test_stream_equals_batch(spark, tmp_path):
    source = "/root/testdata/sf0.001/events.parquet"
    batch = spark.read.parquet(source).withColumn("props", F.expr("if(event_id % 7 = 0, 'broken', props)"))
    batch.repartition(5).write.parquet(f"{tmp_path}/in")
    events = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in")
    query = stream.stream_ingest(events, "props", f"{tmp_path}/good", f"{tmp_path}/failed", f"{tmp_path}/cp")
    query.awaitTermination(120)
    told = lambda df: sorted((r.event_id, r.k, r.status) for r in df.collect())
    expected = stream.judged(batch, "props")
    assert told(spark.read.parquet(f"{tmp_path}/good")) == told(expected.where("status = 'ok'"))
    assert told(spark.read.parquet(f"{tmp_path}/failed")) == told(expected.where("status <> 'ok'")) != []


def test_metrics_and_bounded_search(spark, tmp_path):
    row = export.stage_metrics(spark.range(42).toDF("id"), "count", f"{tmp_path}/out").first()
    assert (row.stage, row.rows) == ("count", 42) and 0 < row.seconds < time.time()
    edges = spark.createDataFrame([(1, f"n{i}", f"n{i + 1}") for i in range(9)] + [(2, "a", "b"), (2, "b", "a")], "g long, src string, dst string")
    entries = spark.createDataFrame([(1, "n0"), (2, "a")], "g long, node string")
    assert {r.g: (r.n, r.truncated) for r in ordering.bounded_reach(edges, entries, 3).collect()} == {1: (3, True), 2: (2, False)}


def test_pointer_jumping_on_chains_and_cycles(spark):
    links = [(1, f"{i:02d}", f"{i + 1:02d}") for i in range(20)] + [(2, "a", "b"), (2, "b", "c"), (2, "c", "b"), (3, "x", "x"), (3, "y", "x")]
    found = {(r.g, r.node): (r.top, r.steps) for r in fixpoint.jump(spark.createDataFrame(links, "g long, node string, next string")).collect()}
    assert all(found[(1, f"{i:02d}")] == ("20", 20 - i) for i in range(21))
    assert found[(2, "b")][0] == found[(2, "c")][0] == "b" and found[(3, "y")] == ("x", 1) and found[(3, "x")] == ("x", 0)


def test_a_file_that_cannot_be_read_has_a_status(spark, tmp_path):
    (tmp_path / "good.bin").write_bytes(b"abc")
    (tmp_path / "bad.bin").write_bytes(b"0123456789")
    (tmp_path / ".bad.bin.crc").write_bytes(b"crc\x00\x00\x00\x02\x00\x00\x00\x00\x00")  # a checksum that the bytes don't have
    (tmp_path / "none.bin").write_bytes(b"")
    found = {r.path.rsplit("/", 1)[1]: (r.status, r.length, r.content) for r in ingest.read_chunks(spark, str(tmp_path)).collect()}
    assert {k: v[:2] for k, v in found.items()} == {"good.bin": ("ok", 3), "bad.bin": ("unreadable", 10), "none.bin": ("empty", 0)}
    assert bytes(found["good.bin"][2]) == b"abc" and found["bad.bin"][2] is None


def test_units_behind_their_parents(spark):
    units = [(1, None, "a"), (2, 1, "b"), (10, 1, "c"), (3, 2, "d"), (5, None, "e"), (9, 77, "lost")]
    df = spark.createDataFrame(units, "id long, parent long, text string")
    for hot in (10**6, 2):
        out = export.nested_listing(df, hot).orderBy("root", "ord").collect()
        assert [(r.root, r.ord, r.text, r.depth) for r in out] == [(1, 0, "a", 0), (1, 1, "b", 1), (1, 2, "d", 2), (1, 3, "c", 1), (5, 0, "e", 0)]


def test_scratch_of_one_thread_leaves_another_alone(spark):
    import threading

    kept = []

    def other():
        with fixpoint.scratch(spark) as keep:
            kept.append(keep(fixpoint.settled(spark.range(5).toDF("id"))))

    with fixpoint.scratch(spark):
        mine = fixpoint.settled(spark.range(3).toDF("id"))
        worker = threading.Thread(target=other)
        worker.start()
        worker.join()
        assert mine.count() == 3
    assert kept[0].count() == 5
