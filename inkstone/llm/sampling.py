"""Bounded samples per group."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BINS = 1024


def least_hashed(rows: DataFrame, key: str, group: str, k: int, seed: str) -> DataFrame:
    """At most ``k`` rows of each group: those whose keys hash least, ties to the smaller key. Null groups take no part.

    No group is gathered anywhere. The groups are counted, which gives each a bound on the hash that about twice ``k`` rows
    stay below; the rows below it are counted in ``BINS`` bins of the hash. The driver (which gets a row for each group and
    then each bin, so groups must be few, as classes of a model are) finds the bin in which the k-th row is. Rows in lower
    bins are taken where they are read; only those of that bin, some k / ``BINS`` a group, are ranked.
    """
    rows = rows.where(F.col(group).isNotNull())
    h = F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 1) * F.lit(2.0**-63)
    sizes = {r[0]: r[1] for r in rows.groupBy(group).agg(F.count("*")).collect()}
    rates = {g: min(1.0, (2 * k + 100) / n) for g, n in sizes.items()}
    if not rates:
        return rows
    is_group = {g: F.col(group) == F.lit(g) for g in rates}
    rate = reduce(lambda c, g: c.when(is_group[g], F.lit(rates[g])), rates, F.when(F.lit(False), F.lit(0.0)))
    few = rows.withColumns({"__h": h, "__rate": rate}).where(F.col("__h") <= F.col("__rate"))
    few = few.withColumn("__bin", F.least(F.floor(F.col("__h") / F.col("__rate") * BINS), F.lit(BINS - 1)).cast("int"))
    counts: dict = {g: [0] * BINS for g in rates}
    for r in few.groupBy(group, "__bin").agg(F.count("*").alias("n")).collect():
        counts[r[0]][r["__bin"]] = r["n"]
    whole, part = [], []
    for g, n in counts.items():
        taken = 0
        for b, here in enumerate(n):
            if taken + here > k:
                whole.append(is_group[g] & (F.col("__bin") < b))
                part.append((is_group[g] & (F.col("__bin") == b), k - taken))
                break
            taken += here
        else:
            whole.append(is_group[g])
    out = few.where(reduce(or_, whole))
    if part:
        left = reduce(lambda c, p: c.when(*p), part, F.when(F.lit(False), 0))
        ranked = few.withColumn("__left", left).where(F.col("__left").isNotNull()).withColumn("__k", F.row_number().over(Window.partitionBy(group).orderBy("__h", key)))
        out = out.unionByName(ranked.where(F.col("__k") <= F.col("__left")).drop("__left", "__k"))
    return out.drop("__h", "__rate", "__bin")
