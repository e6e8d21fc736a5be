"""Vector expressions over array<float> columns."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Rounded to 6 places, so that ranks do not hang on the last bits; null for zero vectors."""
    return F.round(dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0)), 6)


def hashed_embedding(tokens: Column, dims: int = 64) -> Column:
    """A deterministic stand-in for an embedding model: signed counts of hashed tokens. Each token is hashed once, to a place and a sign."""
    places = F.transform(tokens, lambda t: F.pmod(F.xxhash64(t), F.lit(2 * dims)))
    of = lambda all_, place: F.size(F.filter(all_, lambda x: x == place))
    spread = lambda all_: F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda d: (of(all_, 2 * d) - of(all_, 2 * d + 1)).cast("float"))
    return F.get(F.transform(F.array(places), spread), 0)
