"""Vectors and embeddings as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column | str) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(v: Column | str) -> Column:
    """The vector at length 1, in doubles; a zero vector stays."""
    # as variables of outer lambdas the vector and its length are computed once, not once a place
    sized = F.transform(F.array(v), lambda u: F.struct(u.alias("v"), norm(u).alias("size")))
    scaled = lambda s: F.transform(s["v"], lambda x: F.when(s["size"] == 0, x.cast("double")).otherwise(x.cast("double") / s["size"]))
    return F.element_at(F.transform(sized, scaled), 1)


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity; 0 where either vector is zero."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


#: A token of lower-case text: no white space, dots or underscores.
TOKEN = r"[^\x20\x09-\x0D._]+"


def tokens(text: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def has_tokens(text: Column | str) -> Column:
    """Whether a text has a token, found without looking through all of it; null has none."""
    return F.coalesce(F.rlike(text, F.lit(TOKEN)), F.lit(False))


def crc_bucket(dimension: int):
    return lambda t: F.pmod(F.crc32(t.cast("binary")), F.lit(dimension)).cast("int")


def md5_bucket(dimension: int):
    """A bucket that any SQL engine with MD5 can compute."""
    return lambda t: F.pmod(F.conv(F.substring(F.md5(t.cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(dimension)).cast("int")


def hashed(text: Column | str, dimension: int = 16, bucket=crc_bucket) -> Column:
    """Bag-of-tokens vector: how many tokens fall in each bucket; without tokens, 1 in the first."""
    found = F.transform(tokens(F.coalesce(text if isinstance(text, Column) else F.col(text), F.lit(""))), bucket(dimension))
    places = F.sequence(F.lit(0), F.lit(dimension - 1))

    def counted(b: Column) -> Column:
        return F.transform(places, lambda i: F.when(F.size(b) > 0, F.size(b) - F.size(F.array_remove(b, i))).otherwise((i == 0).cast("int")).cast("double"))

    # as the variable of an outer lambda the buckets are computed once, not once a place
    return F.element_at(F.transform(F.array(found), counted), 1)
