"""Problem 4: duplicates hidden by formatting differences.

Records get a canonical key of their letters and digits. Keys of hot groups
are found exactly by partial counts and their rows are aggregated in two
levels over salts; all other keys take one shuffle. The representative of a
group is its smallest identifier. What is hot is a fixed number of rows, so no
task ever holds a larger group, however many rows there are.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

#: Groups above this many rows are hot.
HOT_ROWS = 100_000
#: Where this many keys at most can be hot, as the number of rows shows, their list is broadcast (16 bytes each); else it is joined by a shuffle.
MAX_HOT_KEYS = 500_000
SALTS = 64


def letters_and_digits(text: Column) -> Column:
    """Letters (with their marks) and digits of a text in order, case set aside; NULL like ''.

    Upper case first, as several small letters share a capital; the one letter that is written as two in capitals is written out.
    """
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{M}\p{N}]+", "")
    return F.lower(F.upper(F.regexp_replace(bare, "[ßẞ]", "ss")))


def _fields(value, path: str, out: list[tuple[str, str]]) -> None:
    if isinstance(value, dict):
        out.append((path, "{}"))
        for k, v in value.items():
            _fields(v, f"{path}/{k.replace('~', '~0').replace('/', '~1')}", out)
    elif isinstance(value, list):
        out.append((path, f"[{len(value)}]"))
        for i, v in enumerate(value):
            _fields(v, f"{path}/{i}", out)
    elif value is None:
        out.append((path, "~"))
    else:
        out.append((path, "=" + str(value)))


def flat_fields(payload: str) -> list[tuple[str, str]]:
    """All fields of a JSON object, nested ones by path, in order of their paths; numbers as written.

    Text that is no JSON is one field named '!'.
    """
    try:
        value = json.loads(payload, parse_float=str, parse_int=str, parse_constant=str)
    except (ValueError, RecursionError):
        return [("!", "=" + payload)]
    out: list[tuple[str, str]] = []
    _fields(value, "", out)
    return sorted(out)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("path", T.StringType()), T.StructField("value", T.StringType())])))
def _flat(payloads: pd.Series) -> pd.Series:
    return payloads.map(lambda p: None if p is None else [{"path": a, "value": b} for a, b in flat_fields(p)])


def json_key(payload: Column) -> Column:
    """Canonical text of a JSON object: paths with the letters and digits of their values, whatever the order of fields; NULL for NULL."""
    one = lambda f: F.concat(f["path"], F.lit("\u0001"), F.when(f["value"].startswith("="), F.concat(F.lit("="), letters_and_digits(f["value"]))).otherwise(f["value"]))
    return F.array_join(F.transform(_flat(payload), one), "\u0002")


def group_copies(df: DataFrame, id_col: str, key: Column, hot_rows: int = HOT_ROWS, max_hot_keys: int = MAX_HOT_KEYS, salts: int = SALTS) -> DataFrame:
    """Every row of a group of copies: ``member_id``, ``keep_id`` (the smallest id), ``copies`` (rows with distinct ids).

    Rows with a NULL id or NULL key belong to no group; an id given twice with the same key counts once.
    An empty input gives an empty result; extra columns of ``df`` are dropped.
    """
    keyed = df.select(F.col(id_col).alias("member_id"), key.alias("__k")).filter(F.col("member_id").isNotNull() & F.col("__k").isNotNull())
    # 128 bits stand for the key in every shuffle
    keyed = keyed.select("member_id", F.xxhash64("__k").alias("k1"), F.xxhash64(F.reverse("__k"), F.length("__k")).alias("k2"))
    key_ = ["k1", "k2"]
    keyed = keyed.groupBy("member_id", *key_).agg(F.lit(1).alias("__one")).drop("__one")  # each delivery once; used twice, shuffled once
    salt = F.pmod(F.xxhash64("member_id"), F.lit(salts))
    # exact counts, summed before the shuffle
    hot = keyed.groupBy(*key_).agg(F.count("*").alias("__n")).filter(F.col("__n") >= hot_rows).select(*key_)
    few = df.count() // hot_rows <= max_hot_keys  # no more keys than that can have so many rows
    if few:
        of_hot, rest = keyed.join(F.broadcast(hot), key_, "left_semi"), keyed.join(F.broadcast(hot), key_, "left_anti")
    else:
        # the list over all salts, so that the rows of one key are spread in the join as well
        spread = hot.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
        marked = keyed.withColumn("salt", salt)
        of_hot, rest = marked.join(spread, [*key_, "salt"], "left_semi").drop("salt"), marked.join(spread, [*key_, "salt"], "left_anti").drop("salt")
    w = W.partitionBy(*key_)
    from_rest = rest.select("member_id", F.min("member_id").over(w).alias("keep_id"), F.count("*").over(w).alias("copies"))
    # rows of hot keys inside their salt, then heads over the salts
    of_hot = of_hot.withColumn("salt", salt)
    salted = of_hot.groupBy(*key_, "salt").agg(F.min("member_id").alias("m"), F.count("*").alias("n"))
    heads = salted.groupBy(*key_).agg(F.min("m").alias("keep_id"), F.sum("n").alias("copies"))
    if few:
        from_hot = of_hot.join(F.broadcast(heads), key_)
    else:
        heads = heads.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
        from_hot = of_hot.join(heads, [*key_, "salt"])
    return from_rest.unionByName(from_hot.select("member_id", "keep_id", "copies"))


def copy_pairs(df: DataFrame, id_col: str, key: Column, **how) -> DataFrame:
    """(keep_id, copy_id) for each member of a group but the smallest."""
    return group_copies(df, id_col, key, **how).filter(F.col("member_id") != F.col("keep_id")).select("keep_id", F.col("member_id").alias("copy_id"))


def caption_key(original: str = "original_text", linguistic: str = "linguistic_text") -> Column:
    """Key of a caption; NULL where neither text holds a letter or digit in ``original``."""
    o = letters_and_digits(F.col(original))
    return F.when(o != "", F.concat(o, F.lit("\u0001"), letters_and_digits(F.col(linguistic))))
