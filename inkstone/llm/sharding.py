"""Sharding by a hierarchical weighted hash tree: region, then rack, then shard.

At each level every child makes a draw ``-ln(u) / weight`` from a hash of the key and the child's name, and the least draw
wins. A child is chosen in proportion to its weight, and a change of one weight moves keys only into or out of that child:
no other subtree sees any movement. All of it is DataFrame expressions, evaluated in the scan's stage.

Defined cases: a null key is a key like any other (all nulls share one shard); a null text has no bytes; an empty table
gives an empty result; repeated rows go to the same shard and get slots of their own; other columns are ignored by the
draws and pass through, and output columns replace input columns of the same name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Shard:
    shard: int
    region: str
    rack: str
    weight: float = 1.0


@dataclass(frozen=True)
class Topology:
    """The tree, given by its leaves. Names are what the hash draws on, so they must stay the same for keys to stay."""

    shards: tuple[Shard, ...]

    def __post_init__(self):
        if not self.shards or len({s.shard for s in self.shards}) != len(self.shards):
            raise ValueError("a topology needs shards with distinct numbers")
        if any(not s.weight > 0 for s in self.shards):
            raise ValueError("weights must be positive")

    @staticmethod
    def regular(regions: int, racks: int, shards: int) -> Topology:
        """Equal weights; shard numbers from 0 in order."""
        return Topology(tuple(Shard((r * racks + k) * shards + s, f"region{r}", f"rack{k}") for r in range(regions) for k in range(racks) for s in range(shards)))

    def with_region(self, weight: float = 1.0) -> Topology:
        """One more shard in a region of its own: the only subtree whose weight changes, so keys move only into it."""
        n = max(s.shard for s in self.shards) + 1
        return Topology((*self.shards, Shard(n, f"region+{n}", "rack0", weight)))

    def children(self, *path: str) -> dict[str, float]:
        """Weights of the children below a path of names."""
        out: dict[str, float] = {}
        for s in self.shards:
            names = (s.region, s.rack, str(s.shard))
            if names[: len(path)] == path:
                out[names[len(path)]] = out.get(names[len(path)], 0.0) + s.weight
        return out


def hashed(label: Column, key: Column) -> Column:
    """52 bits of the MD5 of a label and a key: a hash that other engines have too."""
    return F.conv(F.substring(F.md5(F.concat(label, F.lit("/"), F.coalesce(key.cast("string"), F.lit("")))), 1, 13), 16, 10).cast("long")


def draw(key: Column, path: Column, weight: Column) -> Column:
    """An exponential variable of the given rate, a function of the key and the node's path alone."""
    return -F.log((hashed(path, key) + F.lit(0.5)) * F.lit(2.0**-52)) / weight


def _nodes(tree: Topology, *path: str) -> Column:
    """The children below a path, as a constant array of structs with their own children inside."""
    nodes = []
    for name, weight in sorted(tree.children(*path).items()):
        below = (*path, name)
        if len(below) == 3:
            fields = [F.lit(int(name)).alias("shard")]
        else:
            fields = [F.lit(name).alias("name"), _nodes(tree, *below).alias("children")]
        nodes.append(F.struct(F.lit("/".join(below)).alias("path"), F.lit(float(weight)).alias("weight"), *fields))
    return F.array(*nodes)


def _least(key: Column, nodes: Column) -> Column:
    """The node with the least draw; equal draws go to the lesser path."""
    return F.array_min(F.transform(nodes, lambda n: F.struct(draw(key, n["path"], n["weight"]).alias("draw"), n["path"].alias("path"), n.alias("node"))))["node"]


def place(df: DataFrame, key: str, tree: Topology, out: str = "shard") -> DataFrame:
    """``df`` with the shard of each row."""
    k = F.col(key)
    region = _least(k, _nodes(tree))
    rack = _least(k, region["children"])
    return df.withColumn(out, _least(k, rack["children"])["shard"])


def number(df: DataFrame, key: str, shard: str = "shard", out: str = "slot", buckets: int = 256) -> DataFrame:
    """Gapless slots from 0 in each shard.

    A shard's rows are numbered in ``buckets`` parts, so that no task has to sort a whole shard: the parts' counts, at
    most shards times ``buckets`` rows, give each part its offset.
    """
    parts = df.withColumn("__part", (hashed(F.lit("slot"), F.col(key)) % buckets).cast("int"))
    before = Window.partitionBy(shard).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.groupBy(shard, "__part").count().withColumn("__offset", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    within = Window.partitionBy(shard, "__part").orderBy(key)
    numbered = parts.withColumn("__n", F.row_number().over(within))
    joined = numbered.join(offsets, [shard, "__part"])
    return joined.withColumn(out, F.col("__offset") + F.col("__n") - 1).drop("__part", "__n", "__offset")


def shard_documents(docs: DataFrame, tree: Topology, grown: Topology | None = None, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16) -> DataFrame:
    """One row per document: its size, shard, slot in the shard and, with ``grown``, its shard in that tree."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col), (F.octet_length(text) + overhead).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    rows = place(rows, id_col, tree)
    if grown is not None:
        rows = place(rows, id_col, grown, "grown_shard")
    return number(rows, id_col)
