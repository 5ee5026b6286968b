"""Loosely typed values: kinds, truthiness, coercion, comparison and text casts.

A dynamic value is a :class:`Dyn`: a bundle of native columns (kind, text, number, flag).
Built from a VARIANT the kind is read per row; built from a typed column or a Python literal
the kind is a constant, so Catalyst folds the branches away and a plain comparison remains.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cilake.operators.binding import bind

# Text that counts as a number (no blanks, no type suffix), and infinities.
NUMBER_RE = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
INFINITY_RE = r"^[+-]?(inf|infinity)$"
# Spellings of booleans.
TRUE_WORDS = ["1", "t", "T", "TRUE", "true", "True"]
FALSE_WORDS = ["0", "f", "F", "FALSE", "false", "False"]

_STR, _DBL, _BOOL = "string", "double", "boolean"


def _null(kind: str) -> Column:
    return F.lit(None).cast(kind)


# Kinds by a scalar VARIANT's type name; every other type is a number.
_KINDS = {"VOID": "null", "STRING": "string", "BOOLEAN": "boolean"}


def kind_of(v: Column) -> Column:
    """Kind of a VARIANT: undefined (SQL NULL), null, boolean, number, string, array, object.

    Containers are told by casts that build nothing of what lies in them (a cast to a container of VARIANTs writes all levels
    below anew); only scalars are asked for their type name, so the cost does not grow with the levels below.
    """
    table = F.create_map(*[F.lit(x) for pair in _KINDS.items() for x in pair])
    scalar = F.coalesce(F.try_element_at(table, F.schema_of_variant(v)), F.lit("number"))
    return (F.when(v.isNull(), "undefined").when(v.try_cast("struct<>").isNotNull(), "object")
            .when(v.try_cast("array<struct<>>").isNotNull(), "array").otherwise(scalar))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value computed once, inside an expression."""
    return F.get(F.transform(F.array(value), use), 0)


@dataclass(frozen=True)
class Dyn:
    """One dynamic value as native columns.

    `coerced` is the value as a number (NULL when it has none), `empty` tells an empty array or
    object, and `known` is the kind where Python already knows it (literals).
    """

    kind: Column
    text: Column
    num: Column
    flag: Column
    empty: Column
    coerced: Column
    known: str | None = None

    @staticmethod
    def _of_parts(kind: Column, text: Column, num: Column, flag: Column, empty: Column) -> "Dyn":
        coerced = (
            F.when(kind == "number", num)
            .when(kind == "string", coerce_number(text))
            .when(kind == "boolean", F.when(flag, 1.0).otherwise(0.0))
            .when(kind.isin("null", "undefined"), F.lit(0.0))
        )
        return Dyn(kind, text, num, flag, empty, coerced)

    @staticmethod
    def variant(v: Column, kind: Column | None = None) -> "Dyn":
        kind = kind_of(v) if kind is None else kind
        return Dyn._of_parts(
            kind,
            F.when(kind == "string", F.try_variant_get(v, "$", _STR)),
            F.when(kind == "number", F.try_variant_get(v, "$", _DBL)),
            F.when(kind == "boolean", F.try_variant_get(v, "$", _BOOL)),
            F.when(kind.isin("array", "object"), F.to_json(v).isin("[]", "{}")),
        )

    @staticmethod
    def leaf(kind: Column, text: Column) -> "Dyn":
        """From an exploded document row: its kind and its scalar as text (see `explode_paths`)."""
        return Dyn._of_parts(
            kind,
            F.when(kind == "string", text),
            F.when(kind == "number", text.try_cast(_DBL)),
            F.when(kind == "boolean", text == "true"),
            F.when(kind.isin("array", "object"), text.isin("[]", "{}")),
        )

    def struct(self) -> Column:
        """As one struct column, to be bound once and read back with `bound`."""
        return F.struct(self.kind.alias("kind"), self.text.alias("text"), self.num.alias("num"),
                        self.flag.alias("flag"), self.empty.alias("empty"), self.coerced.alias("coerced"))

    @staticmethod
    def bound(c: Column) -> "Dyn":
        return Dyn(c["kind"], c["text"], c["num"], c["flag"], c["empty"], c["coerced"])

    @staticmethod
    def string(c: Column) -> "Dyn":
        return Dyn(_kind_or_undefined(c, "string"), c, _null(_DBL), _null(_BOOL), _null(_BOOL),
                   F.when(c.isNull(), F.lit(0.0)).otherwise(coerce_number(c)))

    @staticmethod
    def number(c: Column) -> "Dyn":
        return Dyn(_kind_or_undefined(c, "number"), _null(_STR), c.cast(_DBL), _null(_BOOL), _null(_BOOL),
                   F.coalesce(c.cast(_DBL), F.lit(0.0)))

    @staticmethod
    def boolean(c: Column) -> "Dyn":
        return Dyn(_kind_or_undefined(c, "boolean"), _null(_STR), _null(_DBL), c, _null(_BOOL),
                   F.when(c, 1.0).otherwise(0.0))

    @staticmethod
    def of(x) -> "Dyn":
        """A Python literal, or a Dyn as it is."""
        if isinstance(x, Dyn):
            return x
        text, num, flag, empty = _null(_STR), _null(_DBL), _null(_BOOL), _null(_BOOL)
        if x is None:
            return Dyn(F.lit("null"), text, num, flag, empty, F.lit(0.0), "null")
        if isinstance(x, bool):
            return Dyn(F.lit("boolean"), text, num, F.lit(x), empty, F.lit(float(x)), "boolean")
        if isinstance(x, (int, float)):
            return Dyn(F.lit("number"), text, F.lit(float(x)), flag, empty, F.lit(float(x)), "number")
        return Dyn(F.lit("string"), F.lit(str(x)), num, flag, empty, coerce_number(F.lit(str(x))), "string")


def bind_values(df: DataFrame, **values: Column) -> DataFrame:
    """Bind VARIANT columns as dynamic values (read back with `Dyn.bound`), each taken apart once."""
    kinds = bind(df, **{f"_k_{n}": kind_of(v) for n, v in values.items()})
    out = bind(kinds, **{n: Dyn.variant(v, F.col(f"_k_{n}")).struct() for n, v in values.items()})
    return out.drop(*[f"_k_{n}" for n in values])


def _kind_or_undefined(c: Column, kind: str) -> Column:
    return F.when(c.isNull(), "undefined").otherwise(kind)


def truthy(x) -> Column:
    """False for null, undefined, false, 0 and ''; true for everything else."""
    d = Dyn.of(x)
    return (
        F.when(d.kind.isin("array", "object"), True)
        .when(d.kind == "boolean", d.flag)
        .when(d.kind == "number", d.num != 0)
        .when(d.kind == "string", d.text != "")
        .otherwise(False)
    )


def variant_truthy(v: Column) -> Column:
    return let(kind_of(v), lambda k: truthy(Dyn.variant(v, k)))


def not_(x) -> Column:
    return ~truthy(x)


def coerce_number(text: Column) -> Column:
    """'' is 0, a numeric text its value, anything else NULL ("not a number")."""
    low = F.lower(text)
    return (
        F.when(text == "", F.lit(0.0))
        .when(text.rlike(NUMBER_RE), text.try_cast(_DBL))
        .when(low.rlike(INFINITY_RE), F.when(text.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf"))))
    )


def number_of(x) -> Column:
    """Coercion of any kind to a number; NULL for arrays, objects and unparsable text."""
    return Dyn.of(x).coerced


def _sign(a: Column, b: Column) -> Column:
    return F.when(a < b, -1).when(a > b, 1).otherwise(0)


def compare(x, y) -> Column:
    """-1, 0, 1, or NULL when the two values cannot be compared.

    Strings compare by bytes; two different booleans compare as +1 whichever comes first;
    arrays and objects are equal only when both are empty; mixed kinds compare as numbers.
    """
    a, b = Dyn.of(x), Dyn.of(y)
    mixed = F.when(a.coerced.isNotNull() & b.coerced.isNotNull(), _sign(a.coerced, b.coerced))
    alike = {
        "string": lambda: _sign(a.text, b.text),
        "boolean": lambda: F.when(a.flag == b.flag, 0).otherwise(1),
        "array": lambda: F.when(a.empty & b.empty, 0),
        "object": lambda: F.when(a.empty & b.empty, 0),
    }
    known = a.known or b.known
    if known:  # numbers, null and undefined compare by their coerced value whatever the other kind
        return F.when(a.kind == b.kind, alike[known]()).otherwise(mixed) if known in alike else mixed
    same = F.when(a.kind != b.kind, mixed)
    for kind, outcome in alike.items():
        same = same.when(a.kind == kind, outcome())
    return same.otherwise(mixed)


def loose_eq(x, y) -> Column:
    return F.coalesce(compare(x, y) == 0, F.lit(False))


def loose_ne(x, y) -> Column:
    """False, not true, when the two cannot be compared."""
    return F.coalesce(compare(x, y) != 0, F.lit(False))


def loose_lt(x, y) -> Column:
    return F.coalesce(compare(x, y) < 0, F.lit(False))


def loose_le(x, y) -> Column:
    return F.coalesce(compare(x, y) <= 0, F.lit(False))


def loose_gt(x, y) -> Column:
    return F.coalesce(compare(x, y) > 0, F.lit(False))


def loose_ge(x, y) -> Column:
    return F.coalesce(compare(x, y) >= 0, F.lit(False))


def and_(v: Column, w: Column) -> Column:
    """`v && w` on VARIANT columns: the first operand when falsy, else the second."""
    return F.when(variant_truthy(v), w).otherwise(v)


def or_(v: Column, w: Column) -> Column:
    """`v || w` on VARIANT columns: the first operand when truthy, else the second."""
    return F.when(variant_truthy(v), v).otherwise(w)


def float_text(f: Column) -> Column:
    """A double as text: plain digits, or e-notation from 1e15 up and below 1e-4."""
    raw = f.cast("string")
    plain = F.rtrim(F.rtrim(raw.try_cast("decimal(38,22)").cast("string"), F.lit("0")), F.lit("."))
    mantissa = F.regexp_replace(F.regexp_extract(raw, r"^(-?[0-9.]+)E", 1), r"\.0$", "")
    exponent = F.regexp_extract(raw, r"E(-?[0-9]+)$", 1).try_cast("int")
    digits = F.abs(exponent).cast("string")
    digits = F.when(F.abs(exponent) < 10, F.concat(F.lit("0"), digits)).otherwise(digits)
    scientific = F.concat(mantissa, F.when(exponent < 0, "e-").otherwise("e+"), digits)
    size = F.abs(f)
    return (
        F.when(F.isnan(f), "NaN")
        .when(size == float("inf"), F.when(f > 0, "+Inf").otherwise("-Inf"))
        .when((size >= 1e15) | ((size < 1e-4) & (f != 0)), scientific)
        .otherwise(plain)
    )


def str_(x) -> Column:
    """Text of a scalar; '' for null and undefined; NULL for arrays and objects."""
    d = Dyn.of(x)
    return (
        F.when(d.kind.isin("null", "undefined"), "")
        .when(d.kind == "boolean", F.when(d.flag, "true").otherwise("false"))
        .when(d.kind == "string", d.text)
        .when(d.kind == "number", float_text(d.num))
    )


def variant_text(v: Column) -> Column:
    """`str_` of a VARIANT inside an expression (array elements), its kind read once."""
    return let(kind_of(v), lambda k: F.when(k.isin("null", "undefined"), "").when(
        k.isin("string", "boolean"), F.try_variant_get(v, "$", _STR)).when(
        k == "number", let(F.try_variant_get(v, "$", _DBL), float_text)))


def contains_(s, x) -> Column:
    """Case-insensitive substring; NULL when an operand has no text."""
    return F.contains(F.lower(str_(s)), F.lower(str_(x)))


def array_contains_(items: Column, x) -> Column:
    """Element test on an ARRAY<VARIANT>: equal as text, ignoring case."""
    want = F.lower(str_(x))
    hit = F.exists(items, lambda e: F.coalesce(F.lower(variant_text(e)) == want, F.lit(False)))
    return F.coalesce(hit, F.lit(False))


def starts_with(s, x) -> Column:
    return F.startswith(F.lower(str_(s)), F.lower(str_(x)))


def ends_with(s, x) -> Column:
    return F.endswith(F.lower(str_(s)), F.lower(str_(x)))


def join_(v: Column, sep: str = ",") -> Column:
    """Array elements as one text; a scalar is cast; NULL when an element has no text."""
    parts = F.transform(v.try_cast("array<variant>"), variant_text)
    joined = F.when(~F.exists(parts, lambda p: p.isNull()), F.array_join(parts, sep))
    return F.when(kind_of(v) == "array", joined).otherwise(variant_text(v))


def format_(template: str | Column, *args: Column) -> Column:
    """`{N}` placeholders over text arguments, `{{`/`}}` for braces; NULL for a bad template.

    The template is cut into tokens natively, so it may be a column; argument text that looks
    like a placeholder is never expanded again.
    """
    t = F.lit(template) if isinstance(template, str) else template
    held = F.replace(F.replace(t, F.lit("{{"), F.lit("\u0001")), F.lit("}}"), F.lit("\u0002"))
    tokens = F.regexp_extract_all(held, F.lit(r"(?s)\{[^}]*\}|[^{]+|\{"), F.lit(0))
    values = F.array(*[a.cast("string") for a in args]) if args else F.array().cast("array<string>")

    def piece(tok: Column) -> Column:
        index = F.when(tok.rlike(r"^\{[+]?[0-9]+\}$"), F.regexp_extract(tok, r"([0-9]+)", 1).try_cast("int"))
        return F.when(~tok.startswith("{"), tok).otherwise(F.get(values, index))

    parts = F.transform(tokens, piece)
    text = F.when(~F.exists(parts, lambda p: p.isNull()), F.array_join(parts, ""))
    return F.replace(F.replace(text, F.lit("\u0001"), F.lit("{")), F.lit("\u0002"), F.lit("}"))


def to_json_(v: Column) -> Column:
    """Compact JSON with sorted keys; 'null' for undefined."""
    return F.coalesce(F.to_json(v), F.lit("null"))


_END = "\u241ecilake-end"


def from_json_(text: Column) -> Column:
    """Text to VARIANT; NULL when it is not one JSON value.

    Spark's parser stops after the first value; wrapping the text in an array with an end mark
    makes trailing text fail too.
    """
    wrapped = F.try_parse_json(F.concat(F.lit("["), text, F.lit(f',"{_END}"]')))
    return let(wrapped, lambda v: F.when(
        F.try_variant_get(v, "$[1]", "string") == _END, F.try_variant_get(v, "$[0]", "variant")))


def nesting(text: Column) -> Column:
    """How many containers nest in a JSON text: the deepest count of open brackets outside strings."""
    plain = F.replace(F.replace(text, F.lit("\\\\"), F.lit("")), F.lit('\\"'), F.lit(""))
    brackets = F.regexp_replace(F.regexp_replace(plain, '"[^"]*"', ""), r"[^\[\]{}]", "")
    start = F.struct(F.lit(0).alias("open"), F.lit(0).alias("most"))

    def step(acc: Column, c: Column) -> Column:
        now = acc["open"] + F.when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0)
        return let(now, lambda n: F.struct(n.alias("open"), F.greatest(acc["most"], n).alias("most")))

    return F.aggregate(F.split(brackets, ""), start, step, lambda acc: acc["most"])


def lower_keys(text: Column) -> Column:
    """JSON text with every object key lower-cased; values stay as they are.

    In JSON a quoted text followed by a colon is always a key, so one tokenising pass is enough.
    """
    tokens = F.regexp_extract_all(text, F.lit(r'(?s)"(?:[^"\\]++|\\.)*+"\s*:?|[^"]+'), F.lit(0))
    return F.array_join(F.transform(tokens, lambda t: F.when(
        t.startswith('"') & t.endswith(":"), F.lower(t)).otherwise(t)), "")


def load_dynamic(text: Column) -> Column:
    """JSON text to a VARIANT with lower-cased keys (what `path` expects)."""
    return from_json_(lower_keys(text))


def _jsonpath(path: str) -> str:
    """`a.b[0]['C']` to a JSONPath: dotted names are lower-cased, bracketed ones kept."""
    out, rest = "$", path
    while rest:
        if rest.startswith("["):
            inner, rest = rest[1:].split("]", 1)
            out += f"[{inner}]" if inner.isdigit() else f"['{inner.strip(chr(39))}']"
        else:
            rest = rest.lstrip(".")
            cut = min([i for i in (rest.find("."), rest.find("[")) if i >= 0] or [len(rest)])
            out += f"['{rest[:cut].lower()}']"
            rest = rest[cut:]
    return out


def path(v: Column, where: str, kind: str = "variant") -> Column:
    """Value under a property/index path; NULL when missing, out of range or below a scalar.

    A last index into a string gives its character.
    """
    found = F.try_variant_get(v, _jsonpath(where), kind)
    head, bracket, last = where.rpartition("[")
    if not bracket or not last.rstrip("]").isdigit():
        return found
    text = Dyn.variant(F.try_variant_get(v, _jsonpath(head), "variant")).text
    char = F.nullif(F.substring(text, int(last.rstrip("]")) + 1, 1), F.lit(""))
    return F.coalesce(found, char.try_cast(kind))


def star(v: Column, rest: str, kind: str = "string") -> Column:
    """`v.*.rest`: an array with the rest of the path for each element, or each value by key."""
    items = F.coalesce(
        v.try_cast("array<variant>"),
        F.transform(F.array_sort(F.map_keys(v.try_cast("map<string,variant>"))),
                    lambda k: F.element_at(v.try_cast("map<string,variant>"), k)),
    )
    return F.transform(items, lambda e: path(e, rest, kind))


def parse_bool(c: Column) -> Column:
    """Boolean spellings only; NULL for anything else."""
    return F.when(c.isin(TRUE_WORDS), True).when(c.isin(FALSE_WORDS), False)


def string_slice(v: Column) -> Column:
    """A scalar as a one-element list, a list as it is, anything else empty."""
    return let(kind_of(v), lambda kind: (
        F.when(kind == "array", v.try_cast("array<string>"))
        .when(kind.isin("string", "number", "boolean"), F.array(F.try_variant_get(v, "$", "string")))
        .otherwise(F.array().cast("array<string>"))
    ))


def fail_fast(c: Column) -> Column:
    """True unless given; a text that is no boolean counts as false."""
    return F.when(F.coalesce(c, F.lit("")) == "", True).otherwise(F.coalesce(parse_bool(c), F.lit(False)))


def max_parallel(c: Column) -> Column:
    """4 unless given; a text that is no integer counts as 0."""
    whole = F.when(c.rlike(r"^[+-]?[0-9]+$"), c.try_cast("int"))
    return F.when(F.coalesce(c, F.lit("")) == "", 4).otherwise(F.coalesce(whole, F.lit(0)))
