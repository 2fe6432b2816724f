"""JSON parsing and "text at path" on VARIANT columns.

Parsing happens once per row into a VARIANT column; every later read is a
native ``try_variant_get`` on that column, so nothing re-parses the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BLANK = r"^\s*$"


def pointer_to_path(pointer: str) -> str:
    """JSON pointer ``/a/b`` -> variant path ``$['a']['b']``."""
    if pointer in ("", "/"):
        return "$"
    parts = pointer.lstrip("/").split("/")
    quoted = "".join("['" + p.replace("~1", "/").replace("~0", "~").replace("'", "\\'") + "']" for p in parts)
    return "$" + quoted


def parse_json(text: Column) -> Column:
    """Lenient parse: NULL for empty or malformed text (never raises)."""
    return F.try_parse_json(text)


def is_blank(s: Column) -> Column:
    """NULL-safe whitespace-only test (NULL counts as blank)."""
    return s.isNull() | s.rlike(_BLANK)


def fields_at(v: Column, types: dict[str, str]) -> Column:
    """The values at these JSON pointers, of these types, as one struct: NULL where the path is missing or the type does not fit.

    One walk over the value, in place of one per path; a path that is missing costs nothing
    (``try_variant_get`` at a path leaves its loop by an exception). No pointer may lead on from another.
    """
    tree: dict = {}
    for pointer, kind in types.items():
        *parents, leaf = pointer.lstrip("/").split("/")
        node = tree
        for part in parents:
            node = node.setdefault(part, {})
        node[leaf] = kind

    def ddl(node) -> str:
        if isinstance(node, str):
            return node
        return "struct<" + ",".join(f"`{name}`:{ddl(inner)}" for name, inner in node.items()) + ">"

    return F.try_variant_get(v, "$", ddl(tree))


def field_at(fields: Column, pointer: str) -> Column:
    """The value at ``pointer`` of a struct of ``fields_at``."""
    for part in pointer.lstrip("/").split("/"):
        fields = fields.getField(part)
    return fields


def text_at(v: Column, pointer: str, fields: Column | None = None) -> Column:
    """Text of the JSON value at ``pointer``, NULL when it is not usable.

    Missing paths, JSON ``null``, objects, arrays and whitespace-only strings
    give NULL; numbers and booleans give their text. JSON ``null`` counts as
    missing on purpose: treating it as the literal text "null" would merge
    unrelated calls under one id. ``fields``: of ``fields_at``, where the text
    is read already.
    """
    path = pointer_to_path(pointer)
    text = F.try_variant_get(v, path, "string") if fields is None else field_at(fields, pointer)
    return _usable(text, lambda: F.try_variant_get(v, path, "variant"))


def text_at_one_of(v: Column, pointer: Column, pointers: list[str], fields: Column | None = None) -> Column:
    """``text_at`` at the one of ``pointers`` that the row's ``pointer`` is; NULL if it is none of them.

    The value is read once: a branch per pointer with the whole of ``text_at`` reads it at every reference.
    """
    def read(kind: str) -> Column:
        expr = None
        for p in pointers:
            known = fields is not None and kind == "string"
            branch = field_at(fields, p) if known else F.try_variant_get(v, pointer_to_path(p), kind)
            expr = F.when(pointer == p, branch) if expr is None else expr.when(pointer == p, branch)
        return expr

    return _usable(read("string"), lambda: read("variant"))


def _usable(s: Column, value) -> Column:
    """The text ``s`` of a value, NULL where it is blank or an object's or array's."""
    container = (s.startswith("{") | s.startswith("[")) & F.schema_of_variant(value()).rlike("^(OBJECT|ARRAY)")
    return F.when(s.isNull() | container | s.rlike(_BLANK), F.lit(None).cast("string")).otherwise(s)


def computed_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with ``columns`` added or replaced, each evaluated exactly once per row.

    They are emitted by a one-element generator: Catalyst never inlines a
    generator's output, so filters and later projections read the value
    instead of repeating the expression at every reference. The values are
    made in a projection below the generator: a projection is compiled, while
    a generator in a stage that is too large to be compiled as one is
    interpreted, expression by expression. Outer, as Spark would otherwise
    test the array's size first, and make the values for that.
    """
    kept = [F.col(c) for c in df.columns if c not in columns]
    row = F.struct(*(c.alias(name) for name, c in columns.items()))
    made = df.select(*kept, F.array(row).alias("_made")).select(*kept, F.explode_outer("_made").alias("_once"))
    return made.select(*kept, *(F.col(f"_once.{name}").alias(name) for name in columns))


def with_parsed(df: DataFrame, text_col: str, out: str) -> DataFrame:
    """Add ``out`` = parsed ``text_col``, evaluated exactly once per row.

    The parse is emitted by a one-element generator: Catalyst never inlines a
    generator's output, so filters on columns derived from the VARIANT (which
    are pushed down and would otherwise re-parse the text once per
    reference) read the parsed value instead of repeating the parse.
    """
    kept = [F.col(c) for c in df.columns if c != out]
    return df.select(*kept, F.array(parse_json(F.col(text_col))).alias("_made")).select(*kept, F.explode_outer("_made").alias(out))


def parse_messages(df: DataFrame, text_col: str = "raw", out: str = "msg") -> DataFrame:
    """Parse the JSON text once; unparseable rows are kept and flagged ``malformed``."""
    return with_parsed(df, text_col, out).withColumn("malformed", F.col(out).isNull())
