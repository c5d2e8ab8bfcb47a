"""A bounded filter of keys, broadcast, so that rows which surely have no match need no exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import fresh

#: Bits of a filter: 131,072 words at most. Beyond as many keys it lets all rows pass, and only the exchange it spares is lost.
BITS = 1 << 23


def sieve(keys: DataFrame, key: str) -> DataFrame:
    """(word, bits) of a filter that holds every value of ``key``."""
    spots = keys.select(F.pmod(F.xxhash64(key), F.lit(BITS)).alias("spot"))
    return spots.groupBy(F.expr("spot div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(spot % 64 as int)))").alias("bits"))


def sifted(df: DataFrame, key: str, words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of ``df`` whose key may be in the filter, and those whose key surely is not."""
    spot, word, bits = (fresh(f"sieve_{c}", df) for c in ("spot", "word", "bits"))
    table = F.broadcast(words.select(F.col("word").alias(word), F.col("bits").alias(bits)))
    marked = df.withColumn(spot, F.pmod(F.xxhash64(key), F.lit(BITS))).withColumn(word, F.expr(f"`{spot}` div 64")).join(table, word, "left")
    may_be = F.expr(f"coalesce(shiftright(`{bits}`, cast(`{spot}` % 64 as int)) & 1L, 0L) = 1")
    return marked.where(may_be).drop(spot, word, bits), marked.where(~may_be).drop(spot, word, bits)
