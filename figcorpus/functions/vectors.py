"""Column expressions over embedding arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from figcorpus.functions.text import _c


def to_double(vec) -> Column:
    return F.transform(_c(vec), lambda x: x.cast("double"))


def norm(vec) -> Column:
    return F.sqrt(F.aggregate(_c(vec), F.lit(0.0), lambda s, x: s + x * x))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def unit(vec) -> Column:
    """Vector of length 1; NULL for the zero vector, whose similarity is 0 by definition."""
    v = to_double(vec)
    return F.transform(
        F.array(F.struct(v.alias("v"), norm(v).alias("n"))),
        lambda s: F.when(s["n"] > 0, F.transform(s["v"], lambda x: x / s["n"])),
    )[0]


def signature(vec, kind: str = "mean") -> Column:
    """64-bit signature of a 64-dimensional vector: bit i tells whether component i is above
    the mean (``mean``) or above the next component, the last compared with the first (``next``)."""
    v = to_double(vec)

    def bits(threshold):
        flags = F.transform(v, lambda x, i: (x > threshold(i)).cast("bigint"))
        return F.aggregate(
            F.transform(flags, lambda b, i: F.call_function("shiftleft", b, i)),
            F.lit(0).cast("bigint"),
            lambda acc, b: acc.bitwiseOR(b),
        )

    if kind == "mean":
        mean = F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size(v)
        return F.transform(F.array(mean), lambda m: bits(lambda i: m))[0]
    if kind == "next":
        return bits(lambda i: F.get(v, (i + 1) % F.size(v)))
    raise ValueError(f"unknown kind {kind!r}")
