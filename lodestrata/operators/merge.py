"""Merge operators: the fold of all operands of a key.

Integers are unsigned of ``width`` bytes. Sums run in decimals, so that they neither overflow nor depend on
order; every operator but ``bytes_append`` and ``fold`` combines before the shuffle, so hot keys are
harmless. A key without a row in the base takes its first operand as it is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WIDTHS = (1, 2, 4, 8)


def _whole(n: int) -> Column:
    return F.lit(str(n)).cast("decimal(38,0)")


def _unsigned(c: Column, width: int) -> Column:
    if width not in WIDTHS:
        raise ValueError(f"width {width}: existing values are kept, so there is nothing to fold")
    return F.pmod(c.cast("decimal(38,0)"), _whole(1 << (8 * width)))


def numeric_add(operand: Column, width: int = 8) -> Column:
    """Wrapping sum modulo 2^(8 width)."""
    return F.pmod(F.sum(_unsigned(operand, width).cast("decimal(28,0)")), _whole(1 << (8 * width))).cast("decimal(20,0)")


def saturating_add(operand: Column, width: int = 8) -> Column:
    """Sum held at the largest value: for unsigned operands the same as holding each step."""
    return F.least(F.sum(_unsigned(operand, width).cast("decimal(28,0)")), _whole((1 << (8 * width)) - 1)).cast("decimal(20,0)")


def float_add(operand: Column) -> Column:
    """Sum in double precision; the last bits depend on the order of addition."""
    return F.sum(operand.cast("double"))


def numeric_max(operand: Column, width: int = 8) -> Column:
    return F.max(_unsigned(operand, width)).cast("decimal(20,0)")


def numeric_min(operand: Column, width: int = 8) -> Column:
    return F.min(_unsigned(operand, width)).cast("decimal(20,0)")


def bitwise_or(operand: Column) -> Column:
    return F.bit_or(operand)


def bitwise_or_bytes(df: DataFrame, keys: list[str], operand: str, order: str, out: str) -> DataFrame:
    """Bitwise or of byte strings of any length, in order; one of another length than the value before changes nothing."""

    def step(key: tuple, old: bytes | None, new: bytes | None) -> bytes | None:
        if old is None or new is None:
            return new if old is None else old
        return (int.from_bytes(old) | int.from_bytes(new)).to_bytes(len(old)) if len(old) == len(new) else old

    return fold_python(df, keys, operand, order, T.StructField(out, T.BinaryType()), step)


def bytes_append(df: DataFrame, keys: list[str], operand: str, order: str, out: str, run: int = 1 << 16) -> DataFrame:
    """Operands of a key joined in order.

    Runs of neighbouring order values are joined first, many to a key, and the runs then; so a hot
    key's operands are spread, and only its result, which is one value by nature, meets in one place.
    """
    part = F.call_function("div", F.col(order), F.lit(run))
    joined = lambda v, o: F.expr(f"listagg({v}) WITHIN GROUP (ORDER BY {o})")
    rows = df.filter(F.col(operand).isNotNull()).select(*keys, part.alias("__part"), F.col(order).alias("__o"), F.col(operand).cast("binary").alias("__v"))
    runs = rows.groupBy(*keys, "__part").agg(joined("__v", "__o").alias("__v"))
    return runs.groupBy(*keys).agg(joined("__v", "__part").alias(out))


def fold(df: DataFrame, keys: list[str], operand: str, order: str, out: str, start: Column, step: Callable[[Column, Column], Column], finish: Callable[[Column], Column] | None = None) -> DataFrame:
    """A custom merge as column expressions: ``step(existing, operand)`` in order. A null result deletes the key.

    An order-dependent fold needs a key's operands in one place; they are gathered as one array.
    """
    listed = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(operand).alias("v")))), lambda x: x["v"])
    done = F.aggregate(listed, start, step, finish) if finish else F.aggregate(listed, start, step)
    return df.groupBy(*keys).agg(done.alias(out)).filter(F.col(out).isNotNull())


def fold_python(df: DataFrame, keys: list[str], operand: str, order: str, out: T.StructField, merge: Callable) -> DataFrame:
    """A custom merge ``merge(key, existing, operand) -> new or None`` in Python, for what no expression can say.

    Rows are dealt and sorted by key, and folded as a stream of Arrow batches: a key's operands needn't
    fit in memory. None deletes the key.
    """
    import pyarrow as pa

    schema = T.StructType([*[df.schema[k] for k in keys], out])

    def run(batches):
        key, value, some = None, None, False
        for b in batches:
            rows = b.to_pydict()
            done = []
            for *k, v in zip(*[rows[c] for c in keys], rows[operand], strict=True):
                if some and k != key:
                    if value is not None:
                        done.append((*key, value))
                    value = None
                key, some = k, True
                value = merge(tuple(k), value, v)
            if done:
                yield pa.RecordBatch.from_pydict({n: [d[i] for d in done] for i, n in enumerate(schema.names)})
        if some and value is not None:
            yield pa.RecordBatch.from_pydict({n: [x] for n, x in zip(schema.names, (*key, value), strict=True)})

    return df.select(*keys, operand, order).repartition(*keys).sortWithinPartitions(*keys, order).mapInArrow(run, schema)
