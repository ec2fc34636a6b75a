"""Vector measures and scalar quantisation, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(v: Column, q: list[float]) -> Column:
    """Inner product with a given vector, in double precision; null where the vector is null or of another size."""
    query = F.lit(None) if not q else F.array(*[F.lit(float(x)) for x in q])
    s = F.aggregate(F.zip_with(v, query, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(v) == len(q), s)


def similarity(v: Column, q: list[float], distance: str) -> Column:
    """(1 + dot) / 2, or (1 + cosine) / 2."""
    if distance == "dot":
        return (1 + dot(v, q)) / 2
    norm = sum(x * x for x in q) ** 0.5
    own = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return (1 + F.coalesce(dot(v, q) / F.nullif(own * F.lit(norm), F.lit(0.0)), F.lit(0.0) * dot(v, q))) / 2


#: Largest code by kind of quantisation.
STEPS = {"int8": 127, "int4": 7, "int1": 1}


def codes(v: Column, kind: str) -> Column:
    """(q, scale): a vector as whole numbers of one byte and what one of them stands for; int8 and int4 by the largest component, int1
    by sign. Null stays null."""
    if kind == "int1":
        q, scale = F.transform(v, lambda x: F.when(x > 0, 1).otherwise(-1).cast("tinyint")), F.lit(1.0)
    else:
        steps = float(STEPS[kind])

        def scaled(top: Column) -> Column:
            return F.transform(v, lambda x: F.when(top == 0, F.lit(0.0)).otherwise(F.round(x.cast("double") * steps / top)).cast("tinyint"))

        top = F.array_max(F.transform(v, lambda x: F.abs(x.cast("double"))))
        q, scale = F.transform(F.array(top), scaled)[0], top / steps
    return F.when(v.isNotNull(), F.struct(q.alias("q"), scale.alias("scale")))


def restored(stored: Column) -> Column:
    """The vector that stored codes stand for."""
    return F.transform(stored["q"], lambda x: x.cast("double") * stored["scale"])


def quantize(v: Column, kind: str) -> Column:
    """The vector as a quantised copy gives it back."""
    return v.cast("array<float>") if kind == "float32" else restored(codes(v, kind))
