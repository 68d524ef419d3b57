"""Which rows may have a key of a relation: a blocked Bloom filter that is sized from the number of keys and broadcast
under a bound of its bytes, and an exact partitioned join beyond that bound."""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinlake.checkpoints import cut

#: A block is a word of 64 bits, in which a key has ``PROBES`` bits.
BITS_PER_KEY, PROBES = 16, 4
#: Words of a page; a page is a row of the filter.
PAGE = 1024
#: Bytes of a filter, at most. More keys than fit are told by an exact join.
MOST_BYTES = 64 << 20


def _spot(keys: list[Column], words: int) -> tuple[Column, Column]:
    """The word of a key, and its bits in it. Word and bits come from two hashes, so keys that share a word have
    bits of their own."""
    code = F.xxhash64(*keys)
    other = F.xxhash64(code, F.lit("bits"))
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(other, 6 * k).bitwiseAND(F.lit(63)).cast("int")) for k in range(PROBES)]
    return F.pmod(code, F.lit(words).cast("long")), functools.reduce(lambda a, b: a.bitwiseOR(b), bits)


def filter_words(count: int) -> int:
    """Words of a filter of ``count`` keys, in whole pages."""
    return PAGE * max(1, math.ceil(count * BITS_PER_KEY / (64 * PAGE)))


def filter_pages(wanted: DataFrame, keys: list[str], words: int) -> DataFrame:
    """The filter as ``(filter_page, filter_words)``, ``PAGE`` words a row. Bits of a word are combined before they are
    shuffled; every word has a row, so a page's words stand at their places."""
    word, bits = _spot([F.col(k) for k in keys], words)
    empty = wanted.sparkSession.range(words).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
    marks = wanted.select(word.alias("word"), bits.alias("bits")).unionByName(empty).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    page = marks.groupBy(F.expr(f"cast(word div {PAGE} AS int)").alias("filter_page"))
    return page.agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("found")).select("filter_page", F.col("found.bits").alias("filter_words"))


def flagged(rows: DataFrame, wanted: DataFrame, keys: list[str], name: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """``rows`` and whether their ``keys`` may be in ``wanted``, null being a key like any other: true for all that are
    and, by the filter, for under 1 % of the others.

    The filter has 16 bits a key and is all that is broadcast, so nothing of ``rows`` is shuffled. Keys whose filter
    would exceed ``most_bytes`` are told by a join on the keys, which is exact and shuffles the rows."""
    return _told(rows, cut(wanted.select(*keys).distinct()), keys, name, most_bytes)


def _told(rows: DataFrame, wanted: DataFrame, keys: list[str], name: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """``flagged`` by distinct keys that are read more than once."""
    count = wanted.count()
    if not count:
        return rows.withColumn(name, F.lit(False))
    words = filter_words(count)
    if words * 8 > most_bytes:
        other = wanted.select(*(F.col(k).alias(f"wanted_{k}") for k in keys), F.lit(True).alias(name))
        same = functools.reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"wanted_{k}")) for k in keys])
        return rows.join(other, same, "left").drop(*(f"wanted_{k}" for k in keys)).withColumn(name, F.coalesce(name, F.lit(False)))
    word, bits = _spot([rows[k] for k in keys], words)
    pages = filter_pages(wanted, keys, words)
    at = F.shiftright(word, PAGE.bit_length() - 1).cast("int")
    joined = rows.join(F.broadcast(pages), at == F.col("filter_page"), "left")
    place = word.bitwiseAND(F.lit(PAGE - 1)).cast("int")
    return joined.withColumn(name, F.coalesce(F.get("filter_words", place).bitwiseAND(bits) == bits, F.lit(False))).drop("filter_page", "filter_words")


def marked_rows(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """The rows that ``flagged`` tells to be in ``wanted``."""
    return flagged(rows, wanted, keys, "mark_flag").where("mark_flag").drop("mark_flag")


def without(rows: DataFrame, gone: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """The rows, with all their columns, whose ``keys`` are not a row of ``gone``, which has columns of those names;
    null agrees with null. Only rows that the filter tells to be in ``gone`` are shuffled, with what they hold."""
    gone = cut(gone.select(*keys).distinct())
    held = rows.select(F.struct("*").alias("row"), *(c.alias(k) for k, c in keys.items()))
    told = _told(held, gone, list(keys), "told")
    some, other = told.where("told"), gone.select(*(F.col(k).alias(f"gone_{k}") for k in keys))
    same = [F.col(k).eqNullSafe(F.col(f"gone_{k}")) for k in keys]
    left = some.join(other, functools.reduce(lambda a, b: a & b, same), "left_anti")
    return left.select("row.*").unionByName(told.where("not told").select("row.*"))
