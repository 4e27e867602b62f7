"""Decoding of binary containers into tables: one Arrow job makes tagged rows, native projections split them.

A container is: a version byte, from version 4 on a types version byte, a string table (a count, then a length and
bytes each), for types version 3 pairs of a byte and a string id up to a zero byte, functions, and the main
function's id. Counts, lengths and ids are little-endian base-128 numbers.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

ROWS = "chunk_id long, tag string, fid int, pos int, kind string, num double, whole long, text string, a int, b int, c int, d int"
_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}
_SCHEMA = pa.schema([(name, _ARROW[kind]) for name, kind in (x.split() for x in ROWS.split(", "))])
ROWS_AT_ONCE = 8_192
#: The kinds of constants by their tags.
KINDS = {0: "nil", 1: "boolean", 2: "number", 3: "string", 4: "path", 5: "template", 6: "function", 7: "vector", 9: "integer"}


class _Reader:
    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def take(self, size: int) -> bytes:
        if size < 0 or self.at + size > len(self.data):
            raise ValueError(f"ends at byte {len(self.data)}, {size} more wanted at {self.at}")
        self.at += size
        return self.data[self.at - size : self.at]

    def byte(self) -> int:
        return self.take(1)[0]

    def number(self, most: int = 5) -> int:
        value = 0
        for place in range(most):
            byte = self.byte()
            value |= (byte & 127) << (7 * place)
            if byte < 128:
                return value
        raise ValueError(f"a number of more than {most} bytes at {self.at}")

    def unpack(self, form: str) -> tuple:
        return struct.unpack(form, self.take(struct.calcsize(form)))


class _Columns:
    """The rows of containers, column by column."""

    def __init__(self) -> None:
        self.lists: dict[str, list] = {name: [] for name in _SCHEMA.names}
        self.size = 0

    def add(self, count: int, **values) -> None:
        """count rows more: a list has a value for each of them, anything else is the same for all, and what isn't named is null."""
        for name, column in self.lists.items():
            value = values.get(name)
            column.extend(value if isinstance(value, list) else [value] * count)
        self.size += count

    def cut(self, size: int) -> None:
        """Forget the rows behind the first size."""
        for column in self.lists.values():
            del column[size:]
        self.size = size

    def batch(self) -> pa.RecordBatch:
        """What was gathered, which is forgotten then."""
        out = pa.RecordBatch.from_arrays([pa.array(self.lists[f.name], f.type) for f in _SCHEMA], schema=_SCHEMA)
        self.cut(0)
        return out


def _constant(r: _Reader) -> tuple:
    """(kind, num, whole, text)."""
    tag = r.byte()
    if tag not in KINDS:
        raise ValueError(f"constant of unknown kind {tag}")
    num = whole = text = None
    if tag == 1:
        whole = r.byte()
    elif tag == 2:
        num = r.unpack("<d")[0]
    elif tag in (3, 6):
        whole = r.number()
    elif tag == 4:
        whole = r.unpack("<I")[0]
    elif tag == 5:
        text = ",".join(str(r.number()) for _ in range(r.number()))
    elif tag == 7:
        text = ",".join(map(repr, r.unpack("<4f")))
    elif tag == 9:
        negative = r.byte()
        value = r.number(10)
        whole = -value if negative else value
    return KINDS[tag], num, whole, text


def _function(r: _Reader, chunk_id: int, fid: int, version: int, out: _Columns) -> None:
    def many(tag: str, count: int, **values) -> None:
        out.add(count, chunk_id=chunk_id, tag=tag, fid=fid, pos=list(range(count)), **values)

    stack, params, captured, variadic = r.take(4)
    flags = r.byte() if version >= 4 else 0
    types = r.take(r.number()).hex() if version >= 4 else ""
    size = r.number()
    many("word", size, whole=list(r.unpack(f"<{size}I")))
    constants = [_constant(r) for _ in range(r.number())]
    kinds, nums, wholes, texts = map(list, zip(*constants)) if constants else ([], [], [], [])
    many("constant", len(constants), kind=kinds, num=nums, whole=wholes, text=texts)
    children = [r.number() for _ in range(r.number())]
    many("child", len(children), whole=children)
    line, name = r.number(), r.number()
    if r.byte():
        gap = r.byte()
        many("line_delta", size, whole=list(r.take(size)))
        bases = ((size - 1) >> gap) + 1 if size else 0
        many("line_base", bases, whole=list(r.unpack(f"<{bases}i")), a=gap)
    if r.byte():
        found = [(r.number(), r.number(), r.number(), r.byte()) for _ in range(r.number())]
        names, begins, ends, registers = map(list, zip(*found)) if found else ([], [], [], [])
        many("local", len(found), whole=names, a=begins, b=ends, c=registers)
        captures = [r.number() for _ in range(r.number())]
        many("capture", len(captures), whole=captures)
    many("function", 1, whole=line, num=float(name), text=types, kind="variadic" if variadic else "fixed", a=stack, b=params, c=captured, d=flags)


def decode(chunk_id: int, data: bytes, out: _Columns) -> None:
    """Adds the tagged rows of one container; one that can't be read adds its unit row alone, with the reason."""
    r, before = _Reader(data or b""), out.size
    unit = lambda **values: out.add(1, chunk_id=chunk_id, tag="unit", **values)
    try:
        version = r.byte()
        if not version:
            return unit(kind="compile_error", text=r.data[1:].decode("utf-8", "replace"), a=0)
        if not 3 <= version <= 11:
            return unit(kind="unsupported", text=f"version {version}", a=version)
        types = r.byte() if version >= 4 else 0
        if version >= 4 and not 1 <= types <= 3:
            return unit(kind="unsupported_types", text=f"types version {types}", a=version, b=types)
        strings = [r.take(r.number()).decode("latin-1") for _ in range(r.number())]
        out.add(len(strings), chunk_id=chunk_id, tag="string", pos=list(range(1, len(strings) + 1)), text=strings)
        while types == 3 and (index := r.byte()):
            out.add(1, chunk_id=chunk_id, tag="userdata", pos=index, whole=r.number())
        for fid in range(r.number()):
            _function(r, chunk_id, fid, version, out)
        unit(kind="ok", a=version, b=types, whole=r.number())
    except (ValueError, struct.error) as problem:
        out.cut(before)
        unit(kind="damaged", text=str(problem))


def decode_chunks(chunks: DataFrame) -> DataFrame:
    """Tagged rows of chunks(chunk_id, content): unit, string, userdata, function, word, constant, child, line_delta, line_base, local, capture."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _Columns()
        for batch in batches:
            for chunk_id, content in zip(batch.column("chunk_id").to_pylist(), batch.column("content")):
                decode(chunk_id, content.as_py(), rows)
                if rows.size >= ROWS_AT_ONCE:  # a large container may be more, but no two of them are held
                    yield rows.batch()
        yield rows.batch()

    return chunks.select(F.col("chunk_id").cast("long").alias("chunk_id"), F.col("content").cast("binary").alias("content")).mapInArrow(run, ROWS)


def units(rows: DataFrame) -> DataFrame:
    return rows.where("tag = 'unit'").select("chunk_id", F.col("kind").alias("status"), F.col("a").alias("version"), F.col("b").alias("types_version"), F.col("whole").alias("main_fid"), F.col("text").alias("message"))


def words(rows: DataFrame) -> DataFrame:
    return rows.where("tag = 'word'").select("chunk_id", "fid", "pos", F.col("whole").alias("word"))


def constants(rows: DataFrame) -> DataFrame:
    """(chunk_id, fid, k, kind, num, whole, text), string constants by their text."""
    strings = rows.where("tag = 'string'").select("chunk_id", F.col("pos").cast("long").alias("whole"), F.lit("string").alias("kind"), F.col("text").alias("_s"))
    own = rows.where("tag = 'constant'").select("chunk_id", "fid", F.col("pos").alias("k"), "kind", "num", "whole", "text")
    return own.join(strings, ["chunk_id", "whole", "kind"], "left").select("chunk_id", "fid", "k", "kind", "num", "whole", F.coalesce("text", "_s").alias("text"))
