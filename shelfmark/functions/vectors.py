"""Column expressions over ARRAY<FLOAT|DOUBLE> vectors, all in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, where a lambda would compute a
    captured expression again for every array entry."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dense(sparse: Column, dim: int) -> Column:
    """A MAP<INT, DOUBLE> as an array of ``dim`` entries, absent = 0."""
    places = F.sequence(F.lit(0), F.lit(dim - 1))
    return let(sparse, lambda m: F.transform(places, lambda d: F.coalesce(F.try_element_at(m, d), F.lit(0.0))))


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(as_double(a), as_double(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(as_double(v), F.lit(0.0), lambda acc, x: acc + x * x))


def l2_normalize(v: Column) -> Column:
    """v / |v|; NULL for a zero vector."""
    return let(norm(v), lambda length: F.when(length > 0, F.transform(as_double(v), lambda x: x / length)))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.nullif(norm(a) * norm(b), F.lit(0.0)))


def fuse(image: Column, image_text: Column, sentence: Column) -> Column:
    """Query vector by what the query has: an image alone stays as it is, everything
    else is the image vector (or its text twin) followed by the sentence vector."""
    joined = l2_normalize(F.concat(F.coalesce(image, image_text), sentence))
    return F.when(sentence.isNull() & image.isNotNull(), as_double(image)).otherwise(joined)
