"""Fields and merges of JSON texts through variants, so that values keep their types."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_OBJECT = "map<string,variant>"


def parsed(c: Column) -> Column:
    """A JSON text as a variant; null for null and for what isn't JSON."""
    return F.try_parse_json(c)


def field(c: Column, path: str, kind: str) -> Column:
    """What stands at ``path`` (``$.a.b[0]``) of a JSON text, as ``kind``; null if it isn't there or isn't of that kind."""
    return F.try_variant_get(parsed(c), path, kind)


def is_object(v: Column) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), F.lit(False))


def _merged(a: Column, b: Column, depth: int) -> Column:
    def one(_, x: Column, y: Column) -> Column:
        chosen = F.when(y.isNull(), x)
        if depth > 1:
            inner = F.to_variant_object(_merged(F.try_variant_get(x, "$", _OBJECT), F.try_variant_get(y, "$", _OBJECT), depth - 1))
            chosen = chosen.when(is_object(x) & is_object(y), inner)
        return chosen.otherwise(y)

    return F.map_zip_with(a, b, one)


def merge(a: Column, b: Column, depth: int = 1) -> Column:
    """Two JSON objects as one JSON text: keys of both, with the second one's value where both have a key.

    With ``depth`` over 1, values that are objects on both sides are merged likewise, so many levels down. A JSON null is
    a value. A text that is null or no object counts as an object without keys.
    """
    own = lambda c: F.coalesce(F.try_variant_get(parsed(c), "$", _OBJECT), F.from_json(F.lit("{}"), _OBJECT))
    return F.to_json(_merged(own(a), own(b), depth))
