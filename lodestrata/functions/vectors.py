"""Vector scalar functions on ARRAY<FLOAT> columns, as column expressions in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The distance that stands for "not comparable": the largest 32-bit float.
FAR = 3.4028234663852886e38


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda x, y: x + y)


def _pairs(a: Column, b: Column, f) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: f(x.cast("double"), y.cast("double"))))


def dot(a: Column, b: Column) -> Column:
    return _pairs(a, b, lambda x, y: x * y)


def euclidean_sq(a: Column, b: Column) -> Column:
    return _pairs(a, b, lambda x, y: (x - y) * (x - y))


def manhattan(a: Column, b: Column) -> Column:
    return _pairs(a, b, lambda x, y: F.abs(x - y))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine_similarity(a: Column, b: Column) -> Column:
    """0 where either norm is 0; held to [-1, 1]."""
    size = norm(a) * norm(b)
    raw = dot(a, b) / F.nullif(size, F.lit(0.0))
    return F.when(size == 0, F.lit(0.0)).when(F.isnan(raw), raw).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), raw)))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - cosine_similarity(a, b)


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two byte strings, over the shorter length."""
    n = F.least(F.octet_length(a), F.octet_length(b))
    byte = lambda c, i: F.conv(F.substring(F.hex(c), 2 * i + 1, 2), 16, 10).cast("int")
    each = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.bit_count(byte(a, i).bitwiseXOR(byte(b, i))))
    return F.when(n == 0, F.lit(0)).otherwise(F.aggregate(each, F.lit(0), lambda x, y: x + y)).cast("long")


METRICS = {"euclidean_sq": euclidean_sq, "cosine": cosine_distance, "dot": lambda a, b: -dot(a, b), "manhattan": manhattan}


def distance(metric: str, a: Column, b: Column) -> Column:
    """The metric's distance (dot: negated); FAR for unequal lengths or a result that is no number."""
    d = METRICS[metric](a, b)
    return F.when((F.size(a) != F.size(b)) | d.isNull() | F.isnan(d), F.lit(FAR)).otherwise(d)


def normalize(a: Column) -> Column:
    """Unit length; a zero vector is unchanged."""
    n = norm(a)
    return F.when(n == 0, F.transform(a, lambda x: x.cast("double"))).otherwise(F.transform(a, lambda x: x.cast("double") / F.nullif(n, F.lit(0.0))))


# ---- quantizers --------------------------------------------------------------------------------


def quantize_binary(a: Column) -> Column:
    """One bit an element, set where it is above 0 (not for NaN), first element in the highest bit; whole bytes."""
    bits = F.concat_ws("", F.transform(a, lambda x: F.when((x > 0) & ~F.isnan(x), F.lit("1")).otherwise(F.lit("0"))))
    padded = F.rpad(bits, F.ceil(F.size(a) / 8).cast("int") * 8, "0")
    byte = lambda i: F.lpad(F.conv(F.substring(padded, i * 8 + 1, 8), 2, 16), 2, "0")
    return F.when(F.size(a) == 0, F.lit(b"")).otherwise(F.unhex(F.concat_ws("", F.transform(F.sequence(F.lit(0), F.ceil(F.size(a) / 8).cast("int") - 1), byte))))


def quantize_scalar(a: Column) -> Column:
    """struct(min, max, codes): code = trunc((x - min) * 255 / (max - min) + 0.5); codes 0 where the range is nil; all 0 where it isn't finite."""
    v = F.transform(a, lambda x: x.cast("double"))
    lo, hi = F.array_min(v), F.array_max(v)
    span = hi - lo
    bad = F.isnan(span) | (F.abs(span) > FAR) | F.exists(v, F.isnan)
    codes = F.transform(v, lambda x: F.when(span < 1.1754943508222875e-38, F.lit(0)).otherwise(F.least(F.lit(255), F.floor((x - lo) * 255 / F.nullif(span, F.lit(0.0)) + 0.5).cast("int"))))
    none = F.transform(v, lambda x: F.lit(0))
    return F.struct(F.when(bad, F.lit(0.0)).otherwise(lo).alias("min"), F.when(bad, F.lit(0.0)).otherwise(hi).alias("max"), F.when(bad, none).otherwise(codes).alias("codes"))


def dequantize_scalar(q: Column) -> Column:
    """min + code * range / 255."""
    return F.transform(q["codes"], lambda c: q["min"] + c * (q["max"] - q["min"]) / 255)


def sq_euclidean_sq(q: Column, b: Column) -> Column:
    """Squared distance of a query to a quantised vector; FAR where it is no finite number."""
    d = euclidean_sq(dequantize_scalar(q), b)
    return F.when(d.isNull() | F.isnan(d) | (d > FAR), F.lit(FAR)).otherwise(d)


def sq_dot(q: Column, b: Column) -> Column:
    """Dot product with a quantised vector; 0 where it is no finite number."""
    d = dot(dequantize_scalar(q), b)
    return F.when(d.isNull() | F.isnan(d) | (F.abs(d) > FAR), F.lit(0.0)).otherwise(d)


def literal(values: list[float]) -> Column:
    """A vector given on the driver."""
    return F.array(*[F.lit(float(x)) for x in values])


def write_f32_le(a: Column) -> Column:
    """A vector as little-endian 32-bit floats. Arrow batches through numpy: no expression gives a float's bits."""
    import numpy as np

    def pack(s):
        return s.map(lambda x: None if x is None else np.asarray(x, "<f4").tobytes())

    return F.pandas_udf(pack, "binary", F.PandasUDFType.SCALAR)(a)


def read_f32_le(b: Column) -> Column:
    import numpy as np

    def unpack(s):
        return s.map(lambda x: None if x is None else np.frombuffer(x, "<f4"))

    return F.pandas_udf(unpack, "array<float>", F.PandasUDFType.SCALAR)(b)
