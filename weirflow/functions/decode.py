"""Projections that decode words, names and constants."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from weirflow.plans.scan import HOT_ROWS, latest, previous, running

# ---- fixed values: the multiplier of the permuted low byte; 227 undoes it modulo 256 ----
PERMUTATION = 203
# ---- end of fixed values ----


def permuted(op: Column) -> Column:
    return F.pmod(op * PERMUTATION, F.lit(256))


def _field(word: Column, low: int, bits: int) -> Column:
    return F.shiftrightunsigned(word, low).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))


def _signed(value: Column, bits: int) -> Column:
    return F.when(value >= 1 << (bits - 1), value - (1 << bits)).otherwise(value)


def decode_words(words: DataFrame, word: str = "word", decoder: Callable[[Column], Column] | None = None) -> DataFrame:
    """words with op, a, b, c (bytes), d (signed high 16 bits) and e (signed high 24 bits); decoder maps the low byte."""
    w = F.col(word)
    low = _field(w, 0, 8)
    return words.withColumns(
        {"op": decoder(low) if decoder else low, "a": _field(w, 8, 8), "b": _field(w, 16, 8), "c": _field(w, 24, 8), "d": _signed(_field(w, 16, 16), 16), "e": _signed(_field(w, 8, 24), 24)}
    )


def split_aux(words: DataFrame, two_word: Column, hot: int = HOT_ROWS) -> DataFrame:
    """(g, pos, word, is_data, aux): which words are data of the one before, and each record's own data word.

    A word is data if the one before is a two-word record and no data itself. Within a run of two-word-looking words
    data alternates, so a word is data if the run that ends before it has an odd length up to there. A sequence of more
    than hot words is cut into stretches.
    """
    rows = words.select("g", "pos", "word", two_word.alias("_two"))
    # The last word before here that does not look two-word: the run begins behind it.
    rows = running(rows, ["g"], ["pos"], hot, _stop=latest(F.when(~F.col("_two"), F.col("pos")), own=False))
    # the word behind is the one before when words are read from behind
    rows = running(rows.withColumn("_back", -F.col("pos")), ["g"], ["_back"], hot, _behind=previous(F.col("word")))
    rows = rows.withColumn("is_data", F.pmod(F.col("pos") - F.coalesce("_stop", F.lit(-1)) - 1, F.lit(2)) == 1)
    return rows.select("g", "pos", "word", "is_data", F.when(F.col("_two") & ~F.col("is_data"), F.col("_behind.v")).alias("aux"))


def unpack_path(word: Column) -> Column:
    """The 10-bit ids of a packed path, as many as the top two bits say; null for none."""
    count = _field(word, 30, 2).cast("int")
    return F.when(count > 0, F.slice(F.array(_field(word, 20, 10), _field(word, 10, 10), _field(word, 0, 10)), F.lit(1), count))


def signed_magnitude(negative: Column, magnitude: Column) -> Column:
    return F.when(negative, -magnitude).otherwise(magnitude)


def escape_non_ascii(text: Column) -> Column:
    """Each byte beyond ASCII as a backslash and its decimal value; other texts pass as they are."""
    pairs = F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit("(..)"), F.lit(1))
    shown = F.transform(pairs, lambda h: F.when(h >= "80", F.concat(F.lit("\\"), F.conv(h, 16, 10))).otherwise(F.decode(F.unhex(h), "UTF-8")))
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.array_join(shown, "")).otherwise(text)


# ---- fixed values: names of the declared type byte ----
TYPE_NAMES = ("nil", "boolean", "number", "string", "table", "function", "thread", "userdata", "vector", "buffer")
ANY_BYTE, OPTIONAL_BIT, TAGGED_FROM, TAGGED_TO = 15, 128, 64, 96
# ---- end of fixed values ----


def type_name(byte: Column) -> Column:
    """The name of a declared type byte, with ? behind it when the optional bit is set."""
    base = byte.bitwiseAND(F.lit(OPTIONAL_BIT - 1))
    name = F.when((base >= TAGGED_FROM) & (base < TAGGED_TO), "any").when(base == ANY_BYTE, "any")
    for number, text in enumerate(TYPE_NAMES):
        name = name.when(base == number, text)
    return F.concat(name.otherwise("unknown"), F.when(byte.bitwiseAND(F.lit(OPTIONAL_BIT)) != 0, "?").otherwise(""))


def param_type(types: Column, i: Column, default: str = "any") -> Column:
    """Element i, from 0, of a list of types; the default beyond its end."""
    return F.coalesce(F.get(types, i), F.lit(default))


def classify(records: DataFrame, catalog: DataFrame) -> DataFrame:
    """records with the flags of their op; catalog is a dimension of one row per op."""
    return records.join(catalog, "op", "left")


def jump_target(pc: Column, offset: Column, bias: Column) -> Column:
    return pc + offset + bias


def drop_noop_jumps(op: Column, pc: Column, target: Column) -> Column:
    return F.when(target == pc + 1, "NOP").otherwise(op)


# ---- fixed values: comparisons and what they invert to ----
INVERSE = {"==": "~=", "~=": "==", "<": ">=", ">=": "<", ">": "<=", "<=": ">"}
# ---- end of fixed values ----


def invert_condition(op: Column) -> Column:
    chain = F.when(op.startswith("not "), F.substring(op, 5, 1 << 30))
    for one, other in INVERSE.items():
        chain = chain.when(op == one, other)
    return chain.otherwise(F.concat(F.lit("not "), op))


# ---- fixed values: conditional records and the comparison that each makes ----
COMPARISONS = {"JUMPIFEQ": "==", "JUMPIFNOTEQ": "~=", "JUMPIFLT": "<", "JUMPIFNOTLT": ">=", "JUMPIFLE": "<=", "JUMPIFNOTLE": ">"}
TRUTH, FALSEHOOD, CONSTANT = "JUMPIF", "JUMPIFNOT", "JUMPXEQK"
# ---- end of fixed values ----


def condition_of(op: Column, left: Column, right: Column, constant: Column, negated: Column) -> Column:
    """(comparison, left, right) of a conditional record: two operands compared, a plain truth test, or one against a constant.

    A truth test is truth or not and has no right side. A constant's comparison is turned by negated; a null constant
    is nil. Another record is no condition: false, without sides.
    """
    told = lambda sign, a, b: F.struct(sign.alias("comparison"), a.alias("left"), b.alias("right"))
    none = F.lit(None).cast("string")
    chain = F.when(op == TRUTH, told(F.lit("truth"), left, none)).when(op == FALSEHOOD, told(F.lit("not"), left, none))
    chain = chain.when(op == CONSTANT, told(F.when(F.coalesce(negated, F.lit(False)), "~=").otherwise("=="), left, F.coalesce(constant, F.lit("nil"))))
    for name, sign in COMPARISONS.items():
        chain = chain.when(op == name, told(F.lit(sign), left, right))
    return chain.otherwise(told(F.lit("false"), none, none))


def is_identifier(text: Column) -> Column:
    return text.rlike(r"^[A-Za-z_][A-Za-z0-9_]*\z")


def sanitize_identifier(text: Column) -> Column:
    """Other characters become _, a leading digit gets one in front; the empty text stays."""
    return F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9_]", "_"), "^([0-9])", "_$1")


def is_generated_name(text: Column) -> Column:
    return text.rlike(r"^((uv_|arg|anon_|i_)[0-9].*|[va][0-9]+)\z")


def default_name(kind: Column, number: Column) -> Column:
    shown = number.cast("string")
    return F.coalesce(
        F.when(kind == "register", F.concat(F.lit("v"), shown)), F.when(kind == "argument", F.concat(F.lit("arg"), shown)), F.when(kind == "capture", F.concat(F.lit("uv_"), shown)),
        F.when(kind == "index", F.concat(F.lit("i_"), shown)), F.when(kind == "function", F.concat(F.lit("f"), shown)), F.lit("_start"),
    )


def constant_value(text: Column) -> Column:
    """(value, type) of a constant as text: nil, boolean, number or string."""
    kind = F.when(text.isNull() | (text == "nil"), "nil").when(text.isin("true", "false"), "boolean").when(text.rlike(r"^-?[0-9]+(\.[0-9]+)?\z"), "number").otherwise("string")
    return F.struct(F.coalesce(text, F.lit("nil")).alias("value"), kind.alias("type"))


# ---- fixed values: the builtins by their numbers, from 0 on ----
BUILTINS = """
    none assert math.abs math.acos math.asin math.atan2 math.atan math.ceil math.cosh math.cos math.deg math.exp math.floor math.fmod math.frexp
    math.ldexp math.log10 math.log math.max math.min math.modf math.pow math.rad math.sinh math.sin math.sqrt math.tanh math.tan bit32.arshift
    bit32.band bit32.bnot bit32.bor bit32.bxor bit32.btest bit32.extract bit32.lrotate bit32.lshift bit32.replace bit32.rrotate bit32.rshift type
    string.byte string.char string.len typeof string.sub math.clamp math.sign math.round rawset rawget rawequal table.insert table.unpack Vector3.new
    bit32.countlz bit32.countrz select rawlen bit32.extract getmetatable setmetatable tonumber tostring bit32.byteswap buffer.readi8 buffer.readu8
    buffer.writeu8 buffer.readi16 buffer.readu16 buffer.writeu16 buffer.readi32 buffer.readu32 buffer.writeu32 buffer.readf32 buffer.writef32
    buffer.readf64 buffer.writef64 vector.magnitude vector.normalize vector.cross vector.dot vector.floor vector.ceil vector.abs vector.sign
    vector.clamp vector.min vector.max math.lerp vector.lerp math.isnan math.isinf math.isfinite buffer.readinteger buffer.writeinteger integer.create
    integer.tonumber integer.neg integer.add integer.sub integer.mul integer.div integer.min integer.max integer.rem integer.idiv integer.udiv
    integer.urem integer.mod integer.clamp integer.band integer.bor integer.bnot integer.bxor integer.lt integer.le integer.ult integer.ule integer.gt
    integer.ge integer.ugt integer.uge integer.lshift integer.rshift integer.arshift integer.lrotate integer.rrotate integer.extract integer.btest
    integer.countrz integer.countlz integer.bswap
""".split()
# ---- end of fixed values ----


def builtin_name(records: DataFrame, number: str, names: DataFrame) -> DataFrame:
    """records with builtin: the name of their number in names(id, name), or Unknown_BFID_n."""
    known = names.select(F.col("id").alias("_id"), F.col("name").alias("_name"))
    return records.join(known, records[number] == F.col("_id"), "left").withColumn("builtin", F.coalesce("_name", F.concat(F.lit("Unknown_BFID_"), F.col(number).cast("string")))).drop("_id", "_name")


def const_bool(text: Column) -> Column:
    """Truth of a literal and of not literal; null for anything else."""
    return F.when(text.isin("true", "not false", "not nil"), True).when(text.isin("false", "nil", "not true"), False)


def sole_position(values: Column, wanted: Column) -> Column:
    """Place, from 1, of the one element that equals wanted; null unless there is exactly one."""
    return F.when(F.size(F.filter(values, lambda v: v == wanted)) == 1, F.array_position(values, wanted))
