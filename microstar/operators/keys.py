"""Keys against keys that are stored already (K5 across loads).

Each load keeps a Bloom filter of its keys beside its rows: bitmaps of 32,768
bits, one for each bucket of hashes, built by a partial aggregate.  The keys
of a new load look up their bits; only those that may be stored are compared
with the stored keys themselves, whose scan reads the key column and is not
shuffled while the hits are few.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, functions as F

from microstar.operators.join import bounded_broadcast

BUCKET_BITS = 32_768
BITS_PER_KEY = 16


def buckets_for(n_keys: int) -> int:
    return max(1, ceil(n_keys * BITS_PER_KEY / BUCKET_BITS))


def _hash(keys: list[str]) -> Column:
    return F.xxhash64(F.lit("key filter"), *[F.col(k) for k in keys])


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(_hash(keys), F.lit(buckets)).cast("int")


def _places(keys: list[str]) -> list[Column]:
    """Two bits of a bucket's bitmap."""
    second = F.xxhash64(F.lit("places"), *[F.col(k) for k in keys])
    return [F.shiftrightunsigned(second, shift).bitwiseAND(F.lit(BUCKET_BITS - 1)).cast("long") for shift in (0, 32)]


def key_filter(df: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    """(bucket, bits): the filter of the keys of ``df``; two bytes a key if sized by ``buckets_for``."""
    bits = df.select(_bucket(keys, buckets).alias("bucket"), F.explode(F.array(*_places(keys))).alias("place"))
    return bits.groupBy("bucket").agg(F.bitmap_construct_agg("place").alias("bits"))


def maybe_in(df: DataFrame, keys: list[str], stored: DataFrame, buckets: int) -> DataFrame:
    """Distinct keys of ``df`` that the filter ``stored`` may hold: all that it holds and under 2 % of the others."""
    probe = df.select(*keys, _bucket(keys, buckets).alias("bucket"), *[p.alias(f"_p{i}") for i, p in enumerate(_places(keys))])
    met = probe.join(bounded_broadcast(stored), "bucket")

    def is_set(place: str) -> Column:
        byte = F.conv(F.hex(F.expr(f"substring(bits, CAST({place} DIV 8 AS INT) + 1, 1)")), 16, 10).cast("int")
        return F.expr(f"shiftleft(1, CAST({place} % 8 AS INT))").bitwiseAND(byte) > 0

    return met.where(is_set("_p0") & is_set("_p1")).select(*keys).distinct()


def stored_keys(candidates: DataFrame, keys: list[str], stored: DataFrame) -> DataFrame:
    """The candidates that ``stored`` holds; its rows stay where they are while the candidates are few."""
    return stored.select(*keys).join(bounded_broadcast(candidates), keys, "left_semi").distinct()
