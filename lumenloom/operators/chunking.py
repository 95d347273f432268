"""Sentence-aware packing of texts into bounded units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenloom.functions import text as X

_DONE = "array<struct<text:string,first:int,last:int>>"
_UNIT = f"struct<done:{_DONE},buffer:string,first:int,last:int>"
#: Bytes that one estimated token stands for, see ``token_estimate``.
BYTES = 3.5


def slices(sentence: Column, cap: int) -> Column:
    """A sentence as it is, or in slices of at most ``cap`` estimated tokens, cut between characters.

    A slice has as many characters as fit if all were as wide as the widest of the sentence.
    """
    width = F.when(sentence.rlike("[\\x{10000}-\\x{10FFFF}]"), 4).when(sentence.rlike("[\\x{0800}-\\x{FFFF}]"), 3).when(sentence.rlike("[\\x{0080}-\\x{07FF}]"), 2).otherwise(1)
    size = F.greatest(F.lit(1), F.floor(F.lit(cap * BYTES) / width).cast("int"))
    return F.when(X.token_estimate(sentence) <= cap, F.array(sentence)).otherwise(F.transform(F.sequence(F.lit(1), F.length(sentence), size), lambda k: F.substring(sentence, k, size)))


def chunks(text: Column, cap: int) -> Column:
    """Units of whole sentences of at most ``cap`` estimated tokens, with the numbers of their first and last sentence.

    A greedy fold in the JVM; blanks between sentences count. '' and NULL give no unit.
    """
    flat = F.flatten(F.transform(X.sentences(text), lambda s, i: F.transform(slices(s, cap), lambda p: F.struct(p.alias("s"), i.cast("int").alias("i")))))
    unit = lambda acc: F.array(F.struct(acc["buffer"].alias("text"), acc["first"].alias("first"), acc["last"].alias("last")))
    start = F.struct(F.array().cast(_DONE).alias("done"), F.lit("").alias("buffer"), F.lit(-1).alias("first"), F.lit(-1).alias("last")).cast(_UNIT)

    def step(acc, x):
        longer = F.when(acc["buffer"] == "", x["s"]).otherwise(F.concat(acc["buffer"], F.lit(" "), x["s"]))
        fits = (acc["buffer"] == "") | (X.token_estimate(longer) <= cap)
        kept = F.struct(acc["done"].alias("done"), longer.alias("buffer"), F.when(acc["buffer"] == "", x["i"]).otherwise(acc["first"]).alias("first"), x["i"].alias("last"))
        closed = F.struct(F.concat(acc["done"], unit(acc)).alias("done"), x["s"].alias("buffer"), x["i"].alias("first"), x["i"].alias("last"))
        return F.when(fits, kept).otherwise(closed).cast(_UNIT)

    return F.aggregate(flat, start, step, lambda acc: F.when(acc["buffer"] == "", acc["done"]).otherwise(F.concat(acc["done"], unit(acc))))


def units(df: DataFrame, id_col: str, text: str, cap: int) -> DataFrame:
    """One row per unit with its place and estimated tokens; texts within the cap are one unit as they are."""
    t = F.col(text)
    one = F.array(F.struct(X.collapse(t).alias("text"), F.lit(0).alias("first"), F.greatest(F.lit(0), F.size(X.sentences(t)) - 1).alias("last")))
    arr = F.when(X.token_estimate(t) <= cap, one).otherwise(chunks(t, cap))
    u = df.filter(F.length(F.trim(t)) > 0).select(id_col, F.posexplode(arr).alias("chunk_index", "u"))
    return u.select(id_col, "chunk_index", F.col("u.first").alias("sentence_start"), F.col("u.last").alias("sentence_end"), X.token_estimate(F.col("u.text")).alias("tokens"), F.col("u.text").alias("text"))
