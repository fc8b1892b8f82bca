"""Predicates on vector metadata, in plain typed columns.

A missing field makes any comparison false, ``ne`` too (so it is not the negation of ``eq``). A vector
without any metadata passes every filter: join metadata on the left and use ``passes``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _number(field: Column, value) -> Column:
    """No number compares with NaN."""
    return ~F.isnan(field.cast("double")) & F.lit(not (isinstance(value, float) and value != value))


def _alike(field: Column, value) -> Column:
    """Whether the field has the value's type: an integer equals no float, nor a number a text."""
    kinds = {bool: ("boolean",), int: ("tinyint", "smallint", "int", "bigint"), float: ("float", "double"), str: ("string",), bytes: ("binary",)}
    return F.typeof(field).isin(*kinds[type(value)])


def eq(field: Column, value) -> Column:
    """Same type and same value; NaN equals nothing."""
    if value != value:
        return F.lit(False)
    return _sure(F.when(_alike(field, value), field.cast("string" if isinstance(value, str) else "binary" if isinstance(value, bytes) else "double" if isinstance(value, float) else "boolean" if isinstance(value, bool) else "long") == F.lit(value)))


def ne(field: Column, value) -> Column:
    return field.isNotNull() & ~eq(field, value)


def _ordered(op: str):
    def compare(field: Column, value, text: bool | None = None) -> Column:
        """Numbers compare as doubles, text as text; ``text`` says which the field is (default: as the value)."""
        is_text = isinstance(value, str)
        if isinstance(value, bool) or (text is not None and text != is_text):
            return F.lit(False)
        a, b = (field, F.lit(value)) if is_text else (field.cast("double"), F.lit(float(value)))
        found = {"lt": a < b, "le": a <= b, "gt": a > b, "ge": a >= b}[op]
        return _sure(found if is_text else found & _number(field, value))

    return compare


lt, le, gt, ge = (_ordered(op) for op in ("lt", "le", "gt", "ge"))


def all_of(*parts: Column) -> Column:
    out = F.lit(True)
    for p in parts:
        out = out & p
    return out


def any_of(*parts: Column) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | p
    return out


def passes(predicate: Column, has_metadata: Column) -> Column:
    return ~_sure(has_metadata) | _sure(predicate)
