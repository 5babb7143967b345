"""Typed reads of semi-structured feed values held as VARIANT.

Bronze responses are parsed with ``try_parse_json`` (no schema inference, so
the same code reads every batch whatever shape a field takes).  These
helpers turn a VARIANT column into typed columns with the feeds' loose
rules.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from metroscope.functions.text import strip

_INT_TYPES = ("BIGINT", "INT", "SMALLINT", "TINYINT")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def vget(v, path: str, typ: str = "variant") -> Column:
    return F.try_variant_get(_c(v), path, typ)


def vtype(v) -> Column:
    """Top-level kind of a VARIANT value: OBJECT, ARRAY, STRING, BIGINT, ...
    (the schema text up to its first '<' or '(', no regex)."""
    return F.substring_index(F.substring_index(F.schema_of_variant(_c(v)), "<", 1), "(", 1)


# Texts of a VARIANT that may come from a number or a literal instead of a string.
_BARE = r"^(?:-?[0-9]+(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?|true|false)$"
# A JSON string, and every character that is not a bracket.
_QUOTED, _NO_BRACKET = r'"(?:[^"\\]|\\.)*"', r"[^\[\]{}]"


def _text(s: Column) -> Column:
    """Stripped text; blank -> NULL."""
    t = strip(s)
    return F.when(t != "", t)


def _depth(s) -> Column:
    """Deepest nesting of lists and objects in a JSON text (brackets inside its strings do not count)."""
    marks = F.split(F.regexp_replace(F.regexp_replace(s, _QUOTED, ""), _NO_BRACKET, ""), "")
    zero = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(acc, mark):
        now = acc["now"] + F.when(mark.isin("[", "{"), 1).when(mark.isin("]", "}"), -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(acc["most"], now).alias("most"))

    return F.aggregate(marks, zero, step, lambda acc: acc["most"])


def _opened(node) -> Column:
    """What a node stands for, in document order: a list's elements, an object's ``value``, itself."""
    kind = vtype(node)
    return (F.when(kind == "ARRAY", vget(node, "$", "array<variant>"))
            .when(kind == "OBJECT", F.array(vget(node, "$.value")))
            .otherwise(F.array(node)))


def _first_leaf(v, s) -> Column:
    """``json_value`` at any depth: open all nodes level by level, as often as the text nests, and take the first text."""
    leaves = F.aggregate(F.sequence(F.lit(1), _depth(s)), F.array(v), lambda nodes, _: F.flatten(F.transform(nodes, _opened)))
    texts = F.transform(leaves, lambda x: F.when(vtype(x) == "STRING", _text(vget(x, "$", "string"))))
    return F.get(F.filter(texts, lambda t: t.isNotNull()), 0)


def json_value(v) -> Column:
    """Polymorphic feed value as stripped text.

    A string gives itself without white space at its ends (blank -> NULL); an
    object gives its ``value`` member, read the same way; an array gives the
    first element that yields a value; anything else gives NULL.  Nesting is
    followed to any depth.

    Plain strings, value objects holding a string and lists that begin with
    either are read directly; only other shapes and ambiguous texts (numbers,
    literals) are opened level by level.

    Pass a column that already holds the member's VARIANT (not an expression
    re-reading the document): the member is referenced several times.
    """
    v = _c(v)
    s, inner = vget(v, "$", "string"), vget(v, "$.value", "string")
    first = F.coalesce(vget(v, "$[0].value", "string"), vget(v, "$[0]", "string"))
    plain = lambda t: t.isNotNull() & ~t.startswith("{") & ~t.startswith("[") & ~t.rlike(_BARE)
    return (F.when(v.isNull(), F.lit(None).cast("string"))
            .when(plain(inner), _text(inner))
            .when(plain(first) & (strip(first) != ""), _text(first))
            .when(s.isNull(), F.lit(None).cast("string"))
            .when(plain(s), _text(s))
            .otherwise(_first_leaf(v, s)))


# A value held by an object of one member or by a list's first element; shapes that hold no text at all.
_HELD = (r'^(?:\[\s*+"|\[\s*+\{\s*+"value"\s*+:\s*+"(?=[^"\\]*+"\s*+\})|\{\s*+"value"\s*+:\s*+"(?=[^"\\]*+"\s*+\}$))'
         r'([^"\\]*+)"\s*+\}?+\s*+(?:$|[,\]])')
_NO_TEXT = (r'^(?:\[\s*+\]|\{\s*+"value"\s*+:\s*+(?:null|"\s*+")\s*+\}|'
            r'\{(?:\s*+"(?!value")[^"\\]*+"\s*+:\s*+(?:null|true|false|-?[0-9][0-9.eE+-]*+|"[^"\\]*+"|\{[^{}\[\]\\]*+\})\s*+,?+)*+\s*+\})$')


def texts_are_plain(raw) -> Column:
    """No string of the document begins with a bracket: a member read as text that does is a list or an object.
    (A string in single quotes, or one that begins with an escaped bracket, may hide one.)"""
    raw = _c(raw)
    return (~raw.contains('"{') & ~raw.contains('"[') & ~(raw.contains("\\u00") & raw.rlike(r'"\\u00[57][bB]'))
            & ~(raw.contains("'") & raw.rlike(r"[:\[,{]\s*'")))


def plain_values(texts) -> Column:
    """``json_value`` of members read as JSON texts, in a document whose ``texts_are_plain``: an array of ``(text, odd)``.

    ``odd`` marks what a text cannot tell or hides deeper: a number or a
    literal (it may have been a string), and nested or escaped values.
    Every step is computed once per member.
    """
    steps = F.transform(texts, lambda t: F.struct(t.alias("raw"), (t.startswith("{") | t.startswith("[")).alias("open")))
    steps = F.transform(steps, lambda x: F.struct(x["raw"].alias("raw"), x["open"].alias("open"), strip(
        F.when(x["open"], F.regexp_extract(x["raw"], _HELD, 1)).otherwise(x["raw"])).alias("text")))
    return F.transform(steps, lambda x: F.struct(
        F.when(x["text"] != "", x["text"]).alias("text"),
        F.when(x["open"], (x["text"] == "") & ~x["raw"].rlike(_NO_TEXT)).when(x["raw"].isNull(), F.lit(False)).otherwise(x["raw"].rlike(_BARE)).alias("odd")))


def parse_iso_ts(s) -> Column:
    """ISO-8601 text (``Z`` or offset or naive = session zone) -> TIMESTAMP.

    Minute-precision times get ``:00`` seconds first (the engine's cast needs
    seconds when an offset follows); unparseable text -> NULL.
    """
    raw = strip(s)
    t = F.regexp_replace(F.replace(raw, F.lit("Z"), F.lit("+00:00")), r"^(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2})([+-]\d{2}:?\d{2})?$", "$1:00$2")
    # a text with seconds is cast as it stands
    return F.when(raw.substr(17, 1) == ":", raw.try_cast("timestamp")).when(t != "", t.try_cast("timestamp"))


def json_num(v, member: str = "v") -> Column:
    """``{"v": x}`` -> DOUBLE; numbers or numeric text, else NULL."""
    v = _c(v)
    return F.when(vtype(v) == "OBJECT", vget(v, f"$.{member}", "double"))


def json_loose_int(v) -> Column:
    """Integer or integer text (``-`` sentinel, decimals and values beyond 32 bits give NULL)."""
    v = _c(v)
    kind = vtype(v)
    text = vget(v, "$", "string")
    return (F.when(kind.isin(*_INT_TYPES), vget(v, "$", "bigint"))
            .when((kind == "STRING") & text.rlike(r"^-?[0-9]+$"), text.try_cast("bigint"))
            .try_cast("int"))


def safe_double(v) -> Column:
    """Number, boolean or numeric text -> DOUBLE, else NULL."""
    return vget(v, "$", "double")


def safe_int(v) -> Column:
    """Integer; decimals truncate; integer text only; else NULL (also beyond 64 bits)."""
    v = _c(v)
    kind = vtype(v)
    text = vget(v, "$", "string")
    return (F.when(kind.isin(*_INT_TYPES, "DECIMAL", "DOUBLE", "FLOAT", "BOOLEAN"), vget(v, "$", "bigint"))
            .when((kind == "STRING") & text.rlike(r"^\s*[+-]?[0-9]+\s*$"), strip(text).try_cast("bigint")))


def safe_bool(v) -> Column:
    """Boolean, or integer (non-zero = true); anything else NULL."""
    v = _c(v)
    kind = vtype(v)
    return (F.when(kind == "BOOLEAN", vget(v, "$", "boolean"))
            .when(kind.isin(*_INT_TYPES), vget(v, "$", "bigint") != 0))
