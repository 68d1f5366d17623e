"""Trace records: rendering and parsing of the call-log text format.

A record is ``{ "name": "N", "args": {"k" : "v", ...}, "return": ["r"] },``
followed by a newline (named arguments), or with ``"args": ["v", ...]``
(positional, older logs). Strings are written unescaped and may hold raw
newlines and quotes, so this is not JSON: a record is cut at the fixed texts
around its name and its return values, entirely in JVM expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the log format.
RECORD_END = "] },\n"
UNSUPPORTED = "<unsupported>"
NULL_POINTER = "(nil)"
REDACTED = "<redacted>"
RUN_MARKER = "set_program_name"
ENTRY = "main"
INTEGER_TYPES = ["int", "long", "short", "unsigned", "unsigned int", "long long", "size_t", "ssize_t", "char"]
FLOAT_TYPES = ["float", "double"]

_HEAD = '{ "name": "'
_ARGS = '", "args": '
BLANKS = " \t\n\x0b\f\r"
_KEY_SPLIT = r'(?:^|", )"[^"]*" : "'
_KEY_RE = r'(?:^|", )"([^"]*)" : "'


def _quote(c: Column) -> Column:
    return F.concat(F.lit('"'), c, F.lit('"'))


def render_record(name: Column, ret: Column, keys: Column | None = None, values: Column | None = None,
                  positional: Column | None = None, terminator: bool = True) -> Column:
    """One record. ``keys``/``values`` for named args, ``positional`` for the old form.

    With ``terminator=False`` the text stops before ``] },\\n`` (the text sink
    appends it as its line separator).
    """
    if positional is not None:
        args = F.concat(F.lit("["), F.array_join(F.transform(positional, _quote), ", "), F.lit("]"))
    else:
        pairs = F.transform(F.arrays_zip(keys.alias("k"), values.alias("v")),
                            lambda p: F.concat(_quote(p["k"]), F.lit(" : "), _quote(p["v"])))
        args = F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}"))
    rets = F.array_join(F.transform(ret, _quote), ", ")
    body = F.concat(F.lit('{ "name": "'), name, F.lit('", "args": '), args, F.lit(', "return": ['), rets)
    return F.concat(body, F.lit(RECORD_END)) if terminator else body


def _from(text: Column, start: Column | int, length: Column | None = None) -> Column:
    start = F.lit(start) if isinstance(start, int) else start
    return F.substr(text, start, length) if length is not None else F.substr(text, start)


def _strip_end(rec: Column) -> Column:
    return (F.when(rec.endswith(RECORD_END), _from(rec, 1, F.length(rec) - len(RECORD_END)))
            .when(rec.endswith(RECORD_END[:-1]), _from(rec, 1, F.length(rec) - len(RECORD_END) + 1)).otherwise(rec))


def _after_head(body: Column) -> Column:
    """What follows ``{ "name": "``; NULL without it."""
    head = F.ltrim(body, F.lit(BLANKS))
    return F.when(head.startswith(_HEAD), _from(head, len(_HEAD) + 1))


def record_name(record: Column) -> Column:
    """The function name of a record, read without its arguments; NULL for a
    piece without one."""
    rest = _after_head(record)
    end = F.locate(_ARGS, rest)
    return F.when(end > 0, _from(rest, 1, end - 1))


def _split_quoted(block: Column) -> Column:
    """``"a", "b"`` -> [a, b]; empty block -> []; tolerates a trailing comma."""
    bare = F.rtrim(block, F.lit(BLANKS))
    cleaned = F.when(bare.endswith(","), _from(bare, 1, F.length(bare) - 1)).otherwise(block)
    inner = F.when(cleaned.startswith('"'), _from(cleaned, 2)).otherwise(cleaned)
    inner = F.when(inner.endswith('"'), _from(inner, 1, F.length(inner) - 1)).otherwise(inner)
    return F.when(F.trim(cleaned) == "", F.array().cast("array<string>")).otherwise(F.split(inner, '", "'))


def _cut_args(get: Get) -> dict[str, Column]:
    args, opened = get("args"), F.coalesce(get("args").startswith("{"), F.lit(False))
    before_return = F.when(opened, F.lit('}, "return": [')).otherwise(F.lit('], "return": ['))
    tail = F.when(opened | args.startswith("["), F.call_function("substring_index", args, before_return, F.lit(-1)))
    return {"named": opened, "before_return": before_return, "tail": tail}


def _cut_block(get: Get) -> dict[str, Column]:
    # the block lies between the bracket and the last start of return values
    args, size = get("args"), F.length(get("args")) - F.length(get("tail")) - F.length(get("before_return")) - 1
    return {"block": F.when(size >= 0, _from(args, 2, size))}


def _cut_pairs(get: Get) -> dict[str, Column]:
    named, block = get("named"), get("block")
    return {"keys": F.when(named, F.regexp_extract_all(block, F.lit(_KEY_RE), 1)), "parts": F.when(named, F.split(block, _KEY_SPLIT))}


def _cut_values(get: Get) -> dict[str, Column]:
    # a block starts with a key, so what lies before the first key is empty
    parts = get("parts")
    last = F.element_at(parts, -1)
    bare = F.when(last.endswith('"'), _from(last, 1, F.length(last) - 1)).otherwise(last)
    several = F.concat(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))), F.array(bare))
    return {"vals": F.when(F.size(parts) > 1, several).when(F.size(parts) >= 0, F.array().cast("array<string>"))}


def _cut_check(get: Get) -> dict[str, Column]:
    # a repeated or unpaired key can't be a map: such a record is not ok
    keys, vals = get("keys"), get("vals")
    return {"fine": (F.size(F.array_distinct(keys)) == F.size(keys)) & (F.size(keys) == F.size(vals))}


Get = Callable[[str], Column]

#: T11 in steps: a record is cut once, from the left at its name and from the
#: right at its return values, and the parts are taken by position. A step
#: reads what the steps before it have named.
CUT_STEPS: list[Callable[[Get], dict[str, Column]]] = [
    lambda get: {"body": _strip_end(get("record"))},
    lambda get: {"rest": _after_head(get("body"))},
    lambda get: {"end": F.locate(_ARGS, get("rest"))},
    lambda get: {"args": F.when(get("end") > 0, _from(get("rest"), get("end") + len(_ARGS)))},
    _cut_args, _cut_block, _cut_pairs, _cut_values, _cut_check]


def cut_result(get: Get) -> Column:
    """struct(name, named, args MAP, pos_args ARRAY, ret ARRAY, ok) of the steps."""
    named, block, fine = get("named"), get("block"), get("fine")
    ok = F.coalesce(block.isNotNull() & (~named | fine), F.lit(False))
    return F.struct(F.when(get("end") > 0, _from(get("rest"), 1, get("end") - 1)).alias("name"), named.alias("named"),
                    F.when(fine, F.map_from_arrays(get("keys"), get("vals"))).alias("args"),
                    F.when(~named, _split_quoted(block)).alias("pos_args"),
                    F.when(block.isNotNull(), _split_quoted(get("tail"))).alias("ret"), ok.alias("ok"))


def parse_trace(record: Column) -> Column:
    """struct(name, named, args MAP, pos_args ARRAY, ret ARRAY, ok).

    Records that do not match (e.g. nameless pieces left by a function with
    several returns) come back with ``ok = false`` for routing to rejects.
    Each step is the one element of an array that the next step transforms, so
    it is worked out once; ``parse_records`` holds the steps in a frame, which
    Spark compiles.
    """
    def let(value: Column, then: Callable[[Column], Column]) -> Column:
        return F.get(F.transform(F.array(value), then), F.lit(0))

    def adding(step: Callable[[Get], dict[str, Column]], names: list[str]) -> Callable[[Column], Column]:
        def add(x: Column) -> Column:
            new = step(lambda n: x[n])
            known = [x[n].alias(n) for n in names]
            names.extend(new)
            return F.struct(*known, *[c.alias(n) for n, c in new.items()])
        return add

    names, state = ["record"], F.struct(record.alias("record"))
    for step in CUT_STEPS:
        state = let(state, adding(step, names))
    return let(state, lambda x: cut_result(lambda n: x[n]))


def render_value(ctype: Column, value: Column, max_text: int | None = None) -> Column:
    """How the instrumentation prints one value of C type ``ctype``.

    Integers ``%d``, floating point ``%f``, ``char*`` its text (cut at
    ``max_text`` characters where that is given), other pointers their address
    (``(nil)`` for 0), anything else ``<unsupported>``. ``value`` is the raw
    value as text; one that is no number of its type gives NULL. Unsigned
    64-bit values fit.
    """
    t = F.trim(ctype)
    is_ptr = t.endswith("*")
    whole = F.when(value.rlike(r"^[+-]?[0-9]{1,20}\z"), value.try_cast("decimal(20,0)"))
    address = F.when(whole >= 0, F.lower(F.conv(whole.cast("string"), 10, 16)))
    text = value if max_text is None else F.substring(value, 1, max_text)
    real = value.try_cast("double")
    return (F.when(t.isin(*INTEGER_TYPES), whole.cast("string"))
            .when(t.isin(*FLOAT_TYPES), F.when(real.isNotNull(), F.format_string("%f", real)))
            .when(t == "char*", text)
            .when(is_ptr & (whole == 0), F.lit(NULL_POINTER))
            .when(is_ptr, F.concat(F.lit("0x"), address))
            .otherwise(F.lit(UNSUPPORTED)))


def classify_value(text: Column) -> Column:
    """T4: inverse of T3 on logged text (first matching rule wins)."""
    return (F.when(text.isNull(), F.lit(None))
            .when(text == UNSUPPORTED, "unsupported")
            .when((text == NULL_POINTER) | (text == "0x0"), "null pointer")
            .when(text.rlike(r"^0x[0-9a-f]+\z"), "address")
            .when(text.rlike(r"^-?[0-9]+\z"), "integer")
            .when(text.rlike(r"^-?[0-9]+\.[0-9]{6}\z"), "float")
            .otherwise("text"))
