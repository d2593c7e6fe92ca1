"""Near-duplicate detection by MinHash bands, odd sketches and exact verification.

A document's set is that of its five-word shingles (hashed to 64 bits). Documents with equal sets form a class, of which one
member stands for all, so exact copies cost one group-by however many they are. Each class has ``BANDS`` x ``ROWS`` MinHash
values; a band's values hashed together are a bucket, and only classes that share a bucket are compared. The ``SAMPLES``
least shingle hashes, a bottom-k MinHash sample that is the whole set of a shorter text, are folded into an *odd sketch*:
each flips one bit of a bitmap, so that the exclusive or of two bitmaps counts the samples in which the sets differ. The
number of its bits estimates high similarities closely, and pairs that it puts clearly below the threshold (``MARGIN``
standard deviations) are dropped. Pairs that remain are verified on their full sets.

Groups never turn into all their pairs. In each bucket every class is compared with one pivot, the least class: first over a
few bands, which join a group of near copies by few pairs a member; then, over all bands, where class and pivot are not in
one component yet. What is left are buckets that still hold more than one component, as those of texts on one template that
are not similar enough to be linked. Their classes are compared by a *prefix filter* and not by bucket. Sets of n <= m shingles
that are similar enough share 6/7 n and 3/4 m at least (of which 0.75 x (n + m) / 1.75 is more than either). So with the
shingles of all of them ordered from the rarest, one of the first ``n - ceil(6/7 n) + 1`` of the smaller set is among the
first ``m - ceil(3/4 m) + 1`` of the larger; and where the first that they share has its place late in either order, too few
are left after it, so the pair is not made. What many have in common makes no pair then, and no pair is lost. Of the classes
that share a rare shingle, those of its largest component are not compared with each other.

Components come from repeated min-label joins on the verified links; nothing of this goes through the driver but counts (of
shingles, in ``RARITY`` hash buckets; they order the shingles, and any order gives the same links).

A pair at exactly the threshold shares no bucket with probability (1 - 0.75^5)^50, about 1.3e-6; pairs above it still less.

Defined cases: null texts and texts without words have an empty set and are linked with nothing; a text of fewer than five
words has its whole sequence as its one shingle; documents with equal ids are rows of one component, also if their texts
differ, and of these texts the one of least hash is compared with other ids; an empty table gives an empty result; only the
id and text columns are read, and :func:`near_duplicates` returns its own columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstone.llm.memory import modest_batches, release
from inkstone.llm.scratch import Scratch

SHINGLE = 5
BANDS, ROWS = 50, 5
#: Bands that are looked at before the others: enough to join most groups of near copies.
FIRST_BANDS = 5
SAMPLES, SKETCH_BITS = 1024, 2048
#: Jaccard similarity of linked documents, as a fraction.
LINK = (75, 100)
MARGIN = 5.0
#: Hash buckets in which the shingles of templates are counted, to know the rare ones.
RARITY = 1 << 18
#: Shingles that are hashed at a time, to bound the memory of long documents.
BLOCK = 1 << 10
FEATURES = "struct<n:long,f1:long,f2:long,buckets:array<long>,sketch:array<long>>"
_FEATURES = pa.struct([("n", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("buckets", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int64()))])
_MIX = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


class Shingler:
    """Sets of shingle hashes of whole texts."""

    def __init__(self, most_words: int = 100_000):
        self.hashes, self.most_words = WordHashes(), most_words

    def of(self, text: bytes | None) -> np.ndarray:
        """The distinct shingles, sorted."""
        words = text.lower().split() if text else []  # of bytes: A-Z, and white space as the contract has it
        if not words:
            return np.zeros(0, np.uint64)
        if len(self.hashes) > self.most_words:
            self.hashes.clear()
        h = np.fromiter(map(self.hashes.__getitem__, words), np.uint64, len(words))
        k = min(SHINGLE, len(h))
        out = np.full(len(h) - k + 1, k, np.uint64)
        for i in range(k):
            out = mix((out * _MIX) ^ h[i : len(h) - k + 1 + i])
        return np.unique(out)


@lru_cache(maxsize=1)
def _family() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(11)
    n = BANDS * ROWS
    return rng.integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, dtype=np.uint64)


def minhash(shingles: np.ndarray) -> np.ndarray:
    """The least value of each hash function: the high 32 bits of a multiply-add."""
    a, b = _family()
    least = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for low in range(0, len(shingles), BLOCK):
        work = np.multiply.outer(a, shingles[low : low + BLOCK])
        work += b[:, None]
        np.minimum(least, work.min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def buckets(least: np.ndarray) -> np.ndarray:
    """One number for each band, the band's own number mixed in."""
    rows = least.reshape(BANDS, ROWS).astype(np.uint64)
    out = np.arange(BANDS, dtype=np.uint64) + np.uint64(1)
    for i in range(ROWS):
        out = mix((out * _MIX) ^ rows[:, i])
    return out


def odd_sketch(shingles: np.ndarray) -> np.ndarray:
    """Each of the bottom ``SAMPLES`` shingles flips one of ``SKETCH_BITS`` bits."""
    at = mix(shingles[:SAMPLES] ^ _MIX) % np.uint64(SKETCH_BITS)
    bits = (np.bincount(at.astype(np.int64), minlength=SKETCH_BITS) & 1).astype(np.uint8)
    return np.packbits(bits).view(np.int64)


def most_different(n: Column, m: Column) -> Column:
    """Bits in the exclusive or of the sketches of sets of n and m shingles beyond which they are clearly below the threshold.

    Linked sets share at least ``share`` = j (n + m) / (1 + j) shingles. Of these, the part within both samples' range is
    common to the samples; all of them are where the samples are the whole sets. The samples' other members, ``differ``,
    flip one bit each, of which pairs in one bit cancel.
    """
    j, bits = LINK[0] / LINK[1], float(SKETCH_BITS)
    small, large = F.least(n, m).cast("double"), F.greatest(n, m).cast("double")
    taken, other = F.least(small, F.lit(float(SAMPLES))), F.least(large, F.lit(float(SAMPLES)))
    reach = F.least(F.lit(1.0), SAMPLES / large)
    common = F.least(taken, (n + m) * (j / (1 + j)) * reach)
    spread = F.sqrt(common * (1 - common / (taken + 1)) * (1 - reach))
    differ = taken + other - 2 * F.greatest(F.lit(0.0), common - MARGIN * spread)
    mean = bits / 2 * (1 - F.exp(-2 * differ / bits))
    variance = F.greatest(F.lit(0.0), bits / 4 * (1 - F.exp(-4 * differ / bits)) - differ * F.exp(-4 * differ / bits))
    return F.least(differ, mean + MARGIN * F.sqrt(variance) + 1)


def features(text: Column) -> Column:
    @F.arrow_udf(FEATURES)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        shingler, none = Shingler(), np.zeros(0, np.int64)
        for batch in batches:
            sums, bands, sketches = np.zeros((len(batch), 3), np.int64), [], []
            for i, value in enumerate(batch.to_pylist()):
                s = shingler.of(value)
                if len(s):
                    with np.errstate(over="ignore"):
                        f1, f2 = s.sum(dtype=np.uint64), np.bitwise_xor.reduce(mix(s + _MIX))
                    sums[i] = len(s), f1.view(np.int64), f2.view(np.int64)
                bands.append(buckets(minhash(s)).view(np.int64) if len(s) else none)
                sketches.append(odd_sketch(s) if len(s) else none)
            yield pa.StructArray.from_arrays([*(pa.array(sums[:, k]) for k in range(3)), _lists(bands), _lists(sketches)], fields=list(_FEATURES))
        del shingler
        release()

    return run(F.encode(text, "UTF-8"))


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int64), *arrays])))


def _of_sets(text: Column, choose: Callable[[np.ndarray], np.ndarray]) -> Column:
    """An array of what is chosen from the set of each text."""

    @F.arrow_udf("array<long>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        shingler = Shingler()
        for batch in batches:
            yield _lists([choose(shingler.of(v)).view(np.int64) for v in batch.to_pylist()])
        del shingler
        release()

    return run(F.encode(text, "UTF-8"))


def shingles(text: Column) -> Column:
    """The full set of a text as an array of hashes."""
    return _of_sets(text, lambda s: s)


def _place(s: np.ndarray) -> np.ndarray:
    return (mix(s) >> np.uint64(46)).astype(np.int64)


def rarity(texts: DataFrame) -> np.ndarray:
    """How many sets hold a shingle of each hash bucket: sums of ``RARITY`` numbers, made in the tasks."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, total = Shingler(), np.zeros(RARITY, np.int64)
        for batch in batches:
            for value in batch.column(0).to_pylist():
                at = _place(shingler.of(value))
                if len(at) * 8 > RARITY:
                    total += np.bincount(at, minlength=RARITY)
                else:
                    np.add.at(total, at, 1)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(total[found])], ["bucket", "n"])
        del shingler
        release()

    sums = texts.select(F.encode("text", "UTF-8").alias("text")).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(RARITY, np.int32)
    out[sums["bucket"].to_numpy()] = np.minimum(sums["n"].to_numpy(), np.iinfo(np.int32).max)
    return out


def prefix(text: Column, counts: np.ndarray) -> Column:
    """The rarest shingles of a set, one of which any similar set holds too, each with its place in the set ordered from the
    rarest. Shingles that are in no other set are left out, but have their places."""
    kind = pa.struct([("places", pa.list_(pa.int64())), ("tokens", pa.list_(pa.int64()))])

    @F.arrow_udf("struct<places:array<long>,tokens:array<long>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        shingler = Shingler()
        for batch in batches:
            places, tokens = [], []
            for value in batch.to_pylist():
                s = shingler.of(value)
                n = counts[_place(s)]
                first = np.lexsort((s, n))[: len(s) - -(-LINK[0] * len(s) // LINK[1]) + 1]
                shared = np.flatnonzero(n[first] > 1)
                places.append(shared)
                tokens.append(s[first[shared]].view(np.int64))
            yield pa.StructArray.from_arrays([_lists(places), _lists(tokens)], fields=list(kind))
        del shingler
        release()

    return run(F.encode(text, "UTF-8"))


#: Parts of the pairs that name one class.
SPREAD = 1024


def reachable(n: Column, place: Column, m: Column, other: Column) -> Column:
    """Sets of n and m shingles whose first common shingle has these places share no more than what comes after it in either
    set, and linked sets share ``LINK[0] * (n + m) / (LINK[0] + LINK[1])`` at least."""
    return (LINK[0] + LINK[1]) * F.least(n - place, m - other) >= LINK[0] * (n + m)


def sized_alike(n: Column, m: Column) -> Column:
    """Sets of which one is too small for the other cannot be linked."""
    return LINK[1] * F.least(n, m) >= LINK[0] * F.greatest(n, m)


def sketched_alike(a: Column, b: Column, n: Column, m: Column) -> Column:
    differ = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return differ <= most_different(n, m)


def attached(pairs: DataFrame, side: str, rows: DataFrame) -> DataFrame:
    """Pairs (a, b) with the columns of ``rows``, by ``id``, of one side. A large group names one class in all its pairs: its row is
    copied, once for each of ``SPREAD`` parts of the pairs that there are, so that no task gets more than a part."""
    other = "a" if side == "b" else "b"
    parted = pairs.withColumn("part", F.pmod(F.xxhash64(other), F.lit(SPREAD)))
    copies = parted.select(side, "part").distinct().join(rows.withColumnRenamed("id", side), side)
    return parted.join(copies, [side, "part"]).drop("part")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of pairs (a, b) those whose full sets are similar enough. ``sets``: (id, s)."""
    both = attached(attached(pairs, "a", sets.withColumnRenamed("s", "sa")), "b", sets.withColumnRenamed("s", "sb"))
    common = F.size(F.array_intersect("sa", "sb"))
    return both.where(LINK[1] * common >= LINK[0] * (F.size("sa") + F.size("sb") - common)).select("a", "b")


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(id, component) of every id that a link (a, b) names: the least id that can be reached.

    In each round every label points to its least smaller neighbour; the pointers are doubled until they reach the roots of
    their trees, and the links are drawn anew between roots. Links inside a tree are gone then; when none is left, the
    roots are the components.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    labels = edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct().withColumn("component", F.col("id"))
    old: list[str] = []
    for i in range(64):
        roots = scratch.keep(edges.groupBy("a").agg(F.min("b").alias("to")), f"{name}-roots{i}-0")
        made = [f"{name}-roots{i}-0"]
        for j in range(1, 64):
            x, y = roots.alias("x"), roots.alias("y")
            doubled = x.join(y, F.col("x.to") == F.col("y.a"), "left").select("x.a", F.coalesce("y.to", "x.to").alias("to"), F.col("y.to").isNotNull().alias("moved"))
            doubled = scratch.keep(doubled, f"{name}-roots{i}-{j}")
            made.append(f"{name}-roots{i}-{j}")
            roots = doubled.select("a", "to")
            if doubled.where("moved").isEmpty():
                break
        labels = labels.join(roots, labels["component"] == roots["a"], "left").select("id", F.coalesce("to", "component").alias("component"))
        labels = scratch.keep(labels, f"{name}-labels{i}")
        ends = edges.join(roots.withColumnRenamed("to", "ta"), "a", "left").join(roots.select(F.col("a").alias("b"), F.col("to").alias("tb")), "b", "left")
        ends = ends.select(F.coalesce("ta", "a").alias("x"), F.coalesce("tb", "b").alias("y")).where("x != y")
        edges = scratch.keep(ends.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), f"{name}-edges{i}")
        scratch.drop(*made, *old)
        old = [f"{name}-labels{i}", f"{name}-edges{i}"]
        if edges.isEmpty():
            return labels
    raise RuntimeError("components did not settle")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``n_shingles``, ``component_id`` and ``kept``."""
    modest_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "neardup")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("h"))
    made = rows.select("id", "h", features(F.col("text")).alias("f")).select("id", "h", "f.*")
    made = scratch.keep(made, "features")
    full = made.where("n > 0")
    classes = full.groupBy("n", "f1", "f2").agg(F.min("id").alias("class"))
    classes = scratch.keep(classes, "classes")
    # of rows with one id, the one whose text has the least hash
    one = full.join(classes.select("class").distinct(), full["id"] == classes["class"], "left_semi").groupBy("id").agg(F.min_by(F.struct("n", "buckets", "sketch", "h"), "h").alias("f")).select("id", "f.*")
    one = scratch.keep(one, "representatives")
    sums = scratch.keep(made.select("id", "n", "f1", "f2"), "sums")
    scratch.drop("features")

    def linked(pairs: DataFrame, name: str) -> DataFrame:
        """Of pairs (a, an, b, bn) those that are similar enough."""
        alike = scratch.keep(_alike(pairs.distinct(), meeting.select("id", "n", "sketch")), f"pairs{name}")
        ends = alike.select(F.col("a").alias("id")).union(alike.select("b")).distinct()
        return scratch.keep(verified(alike, texts.join(ends, "id", "left_semi").select("id", shingles(F.col("text")).alias("s"))), f"links{name}")

    def with_pivots(members: DataFrame) -> DataFrame:
        """Pairs of each class and its bucket's least."""
        return members.where((F.col("id") != F.col("pivot")) & sized_alike(F.col("n"), F.col("pivot_n"))).select(F.col("id").alias("a"), F.col("n").alias("an"), F.col("pivot").alias("b"), F.col("pivot_n").alias("bn"))

    def mixed(members: DataFrame, found: DataFrame, name: str) -> DataFrame:
        """The members of buckets that hold several components, each with its component and the bucket's least class."""
        labelled = members.select("bucket", "id", "n").join(found, "id", "left").select("bucket", "id", "n", F.coalesce("component", "id").alias("component"))
        several = labelled.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min(F.struct("id", "n", "component")).alias("least")).where("low != high")
        return scratch.keep(labelled.join(several.select("bucket", F.col("least.id").alias("pivot"), F.col("least.n").alias("pivot_n"), F.col("least.component").alias("pivot_component")), "bucket"), name)

    # 1. each class of a bucket with the bucket's least, over the first bands
    members = one.select("id", "n", F.posexplode("buckets").alias("band", "bucket"))
    # kept, so that the join reads two tables and a bucket of very many classes can be split
    pivots = members.groupBy("bucket").agg(F.min(F.struct("id", "n")).alias("least"), F.count("*").alias("size")).where("size > 1").select("bucket", F.col("least.id").alias("pivot"), F.col("least.n").alias("pivot_n"))
    shared = scratch.keep(members.join(scratch.keep(pivots, "pivots"), "bucket"), "shared")
    # whole texts travel once, and those alone that share a bucket with another
    meeting = scratch.keep(one.join(shared.select("id").distinct(), "id", "left_semi").select("id", "n", "sketch", "h"), "meeting")
    scratch.drop("representatives", "pivots")
    # by the id alone, so that the groups need no exchange of their own
    chosen = F.when(F.col("h") == F.col("of_h"), F.col("text"))
    texts = rows.select("id", "h", "text").join(meeting.select("id", F.col("h").alias("of_h")), "id").groupBy("id").agg(F.any_value(chosen, ignoreNulls=True).alias("text"))
    texts = scratch.keep(texts, "texts")
    links = linked(with_pivots(shared.where(F.col("band") < FIRST_BANDS)), "1")
    found = components(links, scratch, "components1")

    # 2. the same over all bands, where the two are still in different components
    held = mixed(shared, found, "mixed1")
    links = links.union(linked(with_pivots(held.where("component != pivot_component")), "2"))
    found = components(links, scratch, "components2")

    # 3. classes of different components that met in a bucket, by their rare shingles
    held = scratch.keep(mixed(held, found, "mixed2").select("id", "n", "component").distinct(), "held")
    if not held.isEmpty():
        rare = linked(sharing_rare(held, scratch.keep(texts.join(held.select("id"), "id", "left_semi"), "held_texts"), scratch), "3")
        found = components(links.union(rare), scratch, "components3")

    of_class = classes.join(found, classes["class"] == found["id"], "left").select("n", "f1", "f2", F.coalesce("component", "class").alias("component"))
    # documents without shingles are linked with nothing, and would all be one key
    out = sums.where("n > 0").join(of_class, ["n", "f1", "f2"], "left").unionByName(sums.where("n = 0"), allowMissingColumns=True)
    out = out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
    out = scratch.keep(out.withColumn("kept", F.col(id_col) == F.col("component_id")), "result")
    scratch.drop_all_but("result")
    return out


def sharing_rare(held: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs (a, an, b, bn) of classes (id, n, component) that may be similar enough: of different components, with a shingle of
    both prefixes in common, and alike in size. ``texts``: (id, text) of the classes.

    For each shingle, the classes outside its largest component are joined with all, and those inside with those outside; so a
    large group of near copies is never joined with itself.
    """
    found = texts.select("id", prefix(F.col("text"), rarity(texts)).alias("p")).select("id", F.explode(F.arrays_zip("p.places", "p.tokens")).alias("p")).select("id", "p.*")
    tokens = found.select("id", F.col("places").alias("place"), F.col("tokens").alias("token")).join(held, "id")
    tokens = scratch.keep(tokens.withColumn("short", reachable(F.col("n"), F.col("place"), F.col("n"), F.col("place"))), "tokens")
    by_component = tokens.groupBy("token", "component").agg(F.count("*").alias("size"), F.max("short").alias("short"))
    main = by_component.groupBy("token").agg(F.max(F.struct("size", "component"))["component"].alias("main"), F.count("*").alias("components"), F.max("short").alias("short")).where("components > 1 and short").select("token", "main")
    met = scratch.keep(tokens.join(main, "token"), "met")
    small = met.where("short").drop("short")
    large = met.select("token", *[F.col(c).alias(f"o_{c}") for c in ("id", "n", "component", "place")])
    inside = F.col("component") == F.col("main")
    across = small.where(~inside).join(large, "token").unionByName(small.where(inside).join(large.join(main, "token").where("o_component != main").drop("main"), "token"))
    across = across.where((F.col("component") != F.col("o_component")) & (F.col("n") <= F.col("o_n")) & sized_alike(F.col("n"), F.col("o_n")))
    across = across.where(reachable(F.col("n"), F.col("place"), F.col("o_n"), F.col("o_place")))
    first = F.col("id") > F.col("o_id")
    side = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    return across.select(side("id", "o_id").alias("a"), side("n", "o_n").alias("an"), side("o_id", "id").alias("b"), side("o_n", "n").alias("bn"))


def _alike(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Of pairs (a, an, b, bn) those that odd sketches leave."""
    both = attached(attached(pairs, "a", sketches.select("id", F.col("sketch").alias("as"))), "b", sketches.select("id", F.col("sketch").alias("bs")))
    return both.where(sketched_alike(F.col("as"), F.col("bs"), F.col("an"), F.col("bn"))).select("a", "b")


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stand for their component: all but the one of least id go, and so do repeats of that row. Rows without an
    id stay. Documents meet their verdicts in one join on the id, and what is dealt by the id needs no other exchange to drop repeats."""
    kept = near_duplicates(docs, id_col, text_col).where("kept").select(F.col(id_col).alias("__kept"))
    left = docs.join(kept, docs[id_col] == kept["__kept"], "left_semi").dropDuplicates([id_col])
    return left.unionByName(docs.where(F.col(id_col).isNull())).select(*docs.columns)
