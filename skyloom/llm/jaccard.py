"""Exact Jaccard links between documents' n-gram sets, by vertical partitioning.

N-grams have a global order: rare ones before frequent ones, then by their
64-bit hashes.  The order is cut into fragments, so a set becomes one segment
per fragment.  Two uses:

* candidates: sets whose Jaccard is at least the threshold differ in at most d
  n-grams, so among the first d + 1 segments of each some are equal; sets meet
  on the hashes of these (sizes are grouped, so d is tight).  Passages that
  many documents share stand in the last fragments, so sets that have enough
  else don't meet on them;
* counting: the overlaps of a candidate pair are counted fragment by fragment
  in separate rows and summed per pair, so a set never has to be in one row.

Which n-grams count as frequent is estimated from a share of the documents.
Any choice gives the same links; a good one makes fewer false candidates.

Copies are one vertex: documents with equal sets share a class.  A group of
near copies is not expanded into its pairs: in rounds, each class is tested
with the outermost classes of other components in its segments, two in each,
until a round links nothing.  Only pairs that are still in different components are
tested after that, all that a segment of few classes holds.  Where many meet,
they are told apart by what sets them off from one pivot (``_crowd``).  Parity
sketches inside the joins bound a pair's difference from below, so hardly any
false pair leaves them.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import folder
from .common import components, cut, few, fresh, map_slices, may_hold, short_shuffles, small, table, without
from .shingles import Shingler, mix

#: Ratio of the sizes at the two ends of a size group.
GROUP = 1.4
#: Fragments in which overlaps are counted, and bits of a sketch at most; it has about four for each n-gram in which a linked pair may differ.
FRAGMENTS, SKETCH_BITS = 8, 2048
#: N-grams are frequent if at least ``FREQUENT`` documents of one in ``SHARE`` have them; at most ``MOST_FREQUENT`` are, the most frequent ones.
SHARE, FREQUENT, MOST_FREQUENT = 16, 4, 1_000_000
#: One long numbers a class and one of its size groups, of which it has fewer than so many.
GROUPS = 16
#: In segments of at most so many classes those still apart meet in pairs; in larger ones by their differences from a pivot.
CROWD = 256


class Cuts:
    """How sets of a size are cut, for links of num/den or more; ``frequent`` n-grams (sorted hashes) stand last."""

    def __init__(self, num: int, den: int, frequent: np.ndarray | None = None):
        self.num, self.den = num, den
        self.frequent = frequent if frequent is not None else np.empty(0, np.uint64)
        self.starts = [1]
        self.plans: dict[int, tuple[int, int]] = {}

    def group(self, n: int) -> int:
        while self.starts[-1] <= n:
            self.starts.append(max(self.starts[-1] + 1, int(self.starts[-1] * GROUP)))
        return int(np.searchsorted(self.starts, n, "right")) - 1

    def groups(self, n: int) -> range:
        """The size groups in which a set of n n-grams may meet another: its own, and those of larger sets."""
        return range(self.group(n), self.group(n * self.den // self.num) + 1)

    def plan(self, group: int) -> tuple[int, int]:
        """(fragments, largest difference of a linked pair) of a size group; enough fragments that hardly any set leaves too many of them empty."""
        if group not in self.plans:
            while len(self.starts) <= group + 1:
                self.group(self.starts[-1])
            least, most = max(1, self.starts[group] * self.num // self.den), self.starts[group + 1] - 1
            differ = 2 * most * (self.den - self.num) // (self.den + self.num)
            k = differ + 1
            while k < 4 * differ + 4 and k * (1 - math.exp(-least / k)) < differ + 1 + 3 * math.sqrt(k * math.exp(-least / k)):
                k += 1
            self.plans[group] = k, differ
        return self.plans[group]

    def segments(self, hashes: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For each size group of this sorted set: hashes of the segments on which it may meet a linked one, the first d + 1, those of rare n-grams and the others.

        Rare n-grams fill the fragments 0 to k - 1, frequent ones k to 2k - 1.
        Let a pair differ in at most d n-grams, and look at the first segment
        that is equal in both.  Each fragment before it that either fills holds
        a difference, so there are at most d of them: the segment is among the
        first d + 1 of both.  It exists if either set fills more than d
        fragments; sets that don't also list their empty fragments.
        """
        n = len(hashes)
        if len(self.frequent):
            at = np.searchsorted(self.frequent, hashes)
            late = self.frequent[np.minimum(at, len(self.frequent) - 1)] == hashes
        else:
            late = np.zeros(n, bool)
        hashes = np.concatenate([hashes[~late], hashes[late]])
        last = np.arange(n) >= n - late.sum()
        rare, others = [], []
        for g in self.groups(n):
            k, _ = self.plan(g)
            differ = (n + min(self.starts[g + 1] - 1, n * self.den // self.num)) * (self.den - self.num) // (self.den + self.num)
            where = (((hashes >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)) + np.uint64(k) * last
            held, first = np.unique(where, return_index=True)
            sums = np.add.reduceat(mix(hashes + np.uint64(g + 1)), first)[: differ + 1]
            listed = mix(sums ^ mix(held[: differ + 1] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(g)))
            early = int(np.searchsorted(held[: differ + 1], k))
            rare.append(listed[:early])
            rest = [listed[early:]]
            if len(held) <= differ:
                empty = np.setdiff1d(np.arange(2 * k, dtype=np.uint64), held)
                rest.append(mix(mix(empty * np.uint64(0x9E3779B97F4A7C15) + np.uint64(g)) + np.uint64(1)))
            others.append(np.concatenate(rest))
        return rare, others

    def sketches(self, hashes: np.ndarray) -> list[np.ndarray]:
        """For each size group of this set: its parities over places, whose number the group alone gives."""
        out = []
        for g in self.groups(len(hashes)):
            bits = min(SKETCH_BITS, 1 << max(6, (4 * self.plan(g)[1]).bit_length()))
            odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
            out.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
        return out


def _signed(x: np.ndarray) -> list[int]:
    return x.view(np.int64).tolist()


def _key(h: np.ndarray) -> int:
    """The class of a set: 64 bits of all its n-grams."""
    return int(_signed(mix(np.array([np.add.reduce(mix(h ^ np.uint64(0xA5A5))) + np.uint64(len(h))])))[0])


def frequent_grams(docs: DataFrame, size: int, share: int, least: int, most: int) -> np.ndarray:
    """Sorted hashes of the n-grams that at least ``least`` documents of one in ``share`` (by the hash of the text) have; the ``most`` of the highest counts if there are more."""

    def make():
        shingle = Shingler(size)
        return lambda cols: {"gram": np.concatenate([np.empty(0, np.uint64), *map(shingle, cols["text"])]).view(np.int64)}

    chosen = docs.select(F.col("text").cast("string").alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(share)) == 0)
    counted = map_slices(chosen, make, "gram long").groupBy("gram").count().where(F.col("count") >= least)
    top = counted.orderBy(F.desc("count"), "gram").limit(most).select("gram").toArrow().column(0)
    return np.sort(top.to_numpy().astype(np.int64).view(np.uint64))


def _sets(docs: DataFrame, size: int, num: int, den: int, frequent) -> DataFrame:
    """Rows (doc_id, n_shingles, k, v, rare, others, sketches).

    ``k`` is the class of equal sets.  A task lists the segments of equal sets
    once, with ``v``, its own short number for the class.
    """

    def make():
        shingle, cuts, seen = Shingler(size), Cuts(num, den, frequent.value), set()
        number = TaskContext.get().partitionId() << 32

        def work(cols):
            nonlocal number
            once = ("v", "rare", "others", "sketches")
            out = {n: [] for n in ("n_shingles", "k", *once)}
            for text in cols["text"]:
                h = shingle(text)
                out["n_shingles"].append(len(h))
                key = _key(h) if len(h) else None
                out["k"].append(key)
                if key is None or key in seen:
                    for n in once:
                        out[n].append(None)
                    continue
                if len(seen) > 1_000_000:
                    seen.clear()
                seen.add(key)
                number += 1
                rare, others = cuts.segments(h)
                row = (number, [x.view(np.int64) for x in rare], [x.view(np.int64) for x in others], cuts.sketches(h))
                for n, value in zip(once, row, strict=True):
                    out[n].append(value)
            return {"doc_id": cols["doc_id"]} | out

        return work

    schema = "doc_id long, n_shingles long, k long, v long, rare array<array<long>>, others array<array<long>>, sketches array<array<long>>"
    return map_slices(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), make, schema)


def _fragments(docs: DataFrame, size: int) -> DataFrame:
    """Rows (k, fragment, hashes): the non-empty fragments of each set, cut at fixed hashes."""

    def make():
        shingle = Shingler(size)
        shift = np.uint64(64 - int(math.log2(FRAGMENTS)))

        def work(cols):
            keys, at, parts = [], [], []
            for text in cols["text"]:
                h = shingle(text)
                if not len(h):
                    continue
                key = _key(h)
                held, first = np.unique(h >> shift, return_index=True)
                for f, part in zip(held.tolist(), np.split(h, first[1:]), strict=True):
                    keys.append(key), at.append(f), parts.append(part.view(np.int64))
            return {"k": keys, "fragment": at, "hashes": parts}

        return work

    return map_slices(docs.select(F.col("text").cast("string")), make, "k long, fragment int, hashes array<long>")


def _may_link(num: int, den: int) -> Column:
    """Necessary for a link of a and b: sizes that are near enough, and sketches that differ in few places; the sets differ in no fewer."""
    n1, n2 = F.col("n_a"), F.col("n_b")
    far = F.aggregate(F.zip_with("s_a", "s_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, x: total + x)
    return (F.least(n1, n2) * den >= F.greatest(n1, n2) * num) & (far * (den + num) <= (n1 + n2) * (den - num))


def _sets_of(needed: DataFrame, classes: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """The fragments of the ``needed`` classes (k), and perhaps of some others; a class may come more than once.

    Texts are read again for the classes at hand only; sets move, texts don't.
    """
    one = few(cut(classes.join(small(needed), "k", "left_semi").select("doc_id").distinct()))
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    sets = _fragments(may_hold(rows, "doc_id", one.where("doc_id IS NOT NULL")), size)
    if not one.where("doc_id IS NULL").isEmpty():  # classes of rows without ids only: their sets are among those of all such rows
        nameless = _fragments(rows.where("doc_id IS NULL"), size).join(small(needed), "k", "left_semi")
        sets = sets.unionByName(nameless).groupBy("k", "fragment").agg(F.first("hashes").alias("hashes"))
    return sets


def _linked(pairs: DataFrame, classes: DataFrame, docs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """Those of the stored pairs (a, b, n_a, n_b) of classes that are links, by partial overlaps summed over fragments."""
    needed = few(cut(pairs.select(F.explode(F.array("a", "b")).alias("k")).distinct()))
    sets = _sets_of(needed, classes, docs, size)
    # the same exchange of the sets serves both joins
    each = pairs.withColumn("fragment", F.explode(F.sequence(F.lit(0), F.lit(FRAGMENTS - 1))))
    left = each.join(sets.select(F.col("k").alias("a"), "fragment", F.col("hashes").alias("ha")), ["a", "fragment"])
    both = left.join(sets.select(F.col("k").alias("b"), "fragment", F.col("hashes").alias("hb")), ["b", "fragment"])
    partial = both.select("a", "b", "n_a", "n_b", "fragment", F.size(F.array_intersect("ha", "hb")).alias("part"))
    # rows that repeat an id may bring a set twice; it counts once
    overlap = partial.groupBy("a", "b", "n_a", "n_b", "fragment").agg(F.max("part").alias("part")).groupBy("a", "b", "n_a", "n_b").agg(F.sum("part").alias("i"))
    return overlap.where(F.col("i") * den >= (F.col("n_a") + F.col("n_b") - F.col("i")) * num).select("a", "b")


def _crowd(members: DataFrame, classes: DataFrame, docs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """Pairs (o_a, o_b) of different components, every link among the members of each pivot included.

    Rows of ``members``: (p, q, n_q, top), a pivot's number, class, size and
    component, and (o, k, n, c), a member's.  All links with pivots must be known.

    Let A be the n-grams that only one of a and the pivot has, m_a their number,
    and B those of b: a and b differ in m_a + m_b - 2|A & B|.  With
    r = (den - num) / (den + num), sets of n_a and n_b are linked if they differ
    in at most r (n_a + n_b).  Of a pair at least one, say a, is in another
    component than the pivot, so m_a > r (n_a + n_q).  Therefore

    * 2|A & B| > m_b - r (n_b - n_q), which is not negative: b shares half of
      what sets it off, or more;
    * |A & B| >= m_a - d, where d is the most in which a may differ from a
      linked set.

    Sets that share t elements share one among the first m - t + 1 of each in
    any common order, so a's first d + 1 meet b's first half.  Rare ones come
    first: a change that one text alone has meets nothing.  The first shared
    element leaves only as many for the overlap as come after it in both.
    """
    least, most = den - num, den + num
    needed = few(cut(members.select(F.explode(F.array("k", "q")).alias("k")).distinct()))
    sets = _sets_of(needed, classes, docs, size).join(small(needed), "k", "left_semi").groupBy("k", "fragment").agg(F.first("hashes").alias("hashes"))
    each = members.select("p", "q", "o", "k", F.explode(F.sequence(F.lit(0), F.lit(FRAGMENTS - 1))).alias("fragment"))
    both = each.join(sets.withColumnRenamed("hashes", "own"), ["k", "fragment"], "left").join(sets.select(F.col("k").alias("q"), "fragment", F.col("hashes").alias("its")), ["q", "fragment"], "left")
    own, its = (F.coalesce(x, F.array().cast("array<long>")) for x in ("own", "its"))
    changes = cut(both.select("p", "o", F.explode(F.concat(F.array_except(own, its), F.array_except(its, own))).alias("h")))
    held = changes.groupBy("p", "h").agg(F.count("*").alias("f")).where("f > 1")  # what one member alone has comes first, and meets none
    shared = changes.join(held, ["p", "h"]).groupBy("p", "o").agg(F.sort_array(F.collect_list(F.struct("f", "h"))).alias("shared"))
    lists = changes.groupBy("p", "o").agg(F.count("*").alias("m")).join(shared, ["p", "o"]).join(members.select("p", "o", "n_q", "top", "n", "c"), ["p", "o"])
    away = F.expr(f"(n + n * {den} div {num}) * {least} div {most}") + 1
    half = F.col("m") - F.expr(f"(m * {most} - (n - n_q) * {least}) div {2 * most}")
    lists = lists.select("p", "o", "c", "n", "m", F.when(F.col("c") != F.col("top"), away).otherwise(0).alias("outer"), half.alias("inner"), (F.col("m") - F.size("shared")).alias("alone"), F.posexplode("shared").alias("i", "e"))
    listed = cut(lists.withColumn("i", F.col("i") + F.col("alone")).where(F.col("i") < F.greatest("outer", "inner")).select("p", F.col("e.h").alias("h"), "o", "c", "n", "m", "i", "outer", "inner"))
    a = listed.where("i < outer").select("p", "h", *(F.col(x).alias(f"{x}_a") for x in ("o", "c", "n", "m", "i")))
    b = listed.where("i < inner").select("p", "h", *(F.col(x).alias(f"{x}_b") for x in ("o", "c", "n", "m", "i")))
    near = F.least("n_a", "n_b") * den >= F.greatest("n_a", "n_b") * num
    enough = 2 * most * F.least(F.col("m_a") - F.col("i_a"), F.col("m_b") - F.col("i_b")) >= (F.col("m_a") + F.col("m_b")) * most - (F.col("n_a") + F.col("n_b")) * least
    return a.join(b, ["p", "h"]).where((F.col("c_a") != F.col("c_b")) & near & enough).select("o_a", "o_b").distinct()


def _stored(df: DataFrame, paths: list[str]) -> DataFrame:
    """``df`` as a table in the shared checkpoint folder, so that later steps read only the columns they need; ``paths`` gets its path."""
    spark = df.sparkSession
    paths.append(f"{folder(spark)}/sets-{uuid.uuid4().hex}")
    df.write.parquet(paths[-1])
    return spark.read.parquet(paths[-1])


def _remove(spark, paths: list[str]) -> None:
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def near_duplicates(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100, share: int = SHARE, least: int = FREQUENT) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id) of (doc_id, text): components of links with Jaccard num/den or more.

    Every row counts as a document of its own; rows that repeat an id are
    linked only by their texts.  Texts without words, and null texts, have an
    empty set and are linked with nothing: their component is their own id.  A
    null id never becomes a component's name while another is there.

    ``share`` and ``least`` say which n-grams count as frequent; they change
    the candidates, never the links.
    """
    paths: list[str] = []
    try:
        with short_shuffles(docs.sparkSession):
            return _grouped(docs, size, num, den, share, least, paths)[0]
    finally:
        _remove(docs.sparkSession, paths)


def _met(sets: DataFrame, classes: DataFrame, paths: list[str]) -> DataFrame:
    """Rows (segment, o): classes that share a segment with another, by ``o``, their number and size group; of segments with equal classes one stays.

    Segments of rare n-grams are in few classes each, so they are gathered.
    Others may be in any share of all classes: they are counted before a
    shuffle, and Spark may split their rows in the join.
    """
    owner = F.col("v") * GROUPS + F.col("j")

    def listed(column: str) -> DataFrame:
        lists = sets.where("v IS NOT NULL").select("v", F.posexplode(column).alias("j", "list"))
        return lists.select(F.explode("list").alias("segment"), owner.alias("o"))

    by = Window.partitionBy("segment")
    frequent = listed("others")
    shared = frequent.groupBy("segment").agg(F.min("o").alias("x"), F.max("o").alias("y")).where("x < y").select("segment")
    gathered = listed("rare").withColumns({"x": F.min("o").over(by), "y": F.max("o").over(by)}).where("x < y").select("segment", "o")
    met = gathered.withColumn("rare", F.lit(True)).unionByName(frequent.join(shared, "segment", "left_semi").withColumn("rare", F.lit(False)))
    own = _stored(met.join(classes.select("v"), F.shiftright("o", int(math.log2(GROUPS))) == F.col("v"), "left_semi"), paths)
    mark = F.xxhash64("o").cast("decimal(38,0)")
    rare = own.where("rare").select("segment", "o").withColumns({"size": F.count("*").over(by), "mark": F.sum(mark).over(by)}).where("size > 1")
    chosen = rare.groupBy("size", "mark").agg(F.min("segment").alias("segment")).select("segment")
    return rare.select("segment", "o").join(chosen, "segment", "left_semi").unionByName(own.where("NOT rare").select("segment", "o"))


def _grouped(docs: DataFrame, size: int, num: int, den: int, share: int, least: int, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows of ``near_duplicates``, and a stored table (k, least, group): each class's component by name and by a number of its own."""
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_grams(docs, size, share, least, MOST_FREQUENT))
    sets = _stored(_sets(docs, size, num, den, frequent), paths)
    classes = cut(sets.where("k IS NOT NULL").groupBy("k").agg(F.min("doc_id").alias("doc_id"), F.min("v").alias("v"), F.first("n_shingles").alias("n")))
    sketched = sets.where("v IS NOT NULL").select("v", "sketches").join(classes.select("v", "k", "n"), "v")
    sketches = _stored(sketched.select("v", "k", "n", F.posexplode("sketches").alias("j", "s")).select((F.col("v") * GROUPS + F.col("j")).alias("o"), "k", "n", "s"), paths)
    met = _stored(_met(sets, classes, paths), paths)
    number = F.shiftright("o", int(math.log2(GROUPS)))
    component = classes.select("k", "v", F.col("k").alias("c"))

    def joined(found: DataFrame) -> DataFrame:
        """The components once the links (a, b) of classes are in: those of the links between components so far."""
        ends = found
        for side in "ab":
            ends = ends.join(component.select(F.col("k").alias(side), F.col("c").alias(f"c_{side}")), side)
        label = components(ends.select(F.col("c_a").alias("a"), F.col("c_b").alias("b")).distinct())
        return cut(component.join(small(label.withColumnRenamed("id", "c").withColumnRenamed("component", "to")), "c", "left").select("k", "v", F.coalesce("to", "c").alias("c")))

    def labelled(met: DataFrame) -> DataFrame:
        """Rows (segment, o, c, x, y) of those segments in which components still meet; c is the row's own, x and y the outermost (component, o)."""
        owned = cut(met.select("segment", "o", number.alias("v")).join(component.select("v", "c"), "v").select("segment", "o", "c"))
        ends = owned.groupBy("segment").agg(F.min(F.struct("c", "o")).alias("x"), F.max(F.struct("c", "o")).alias("y")).where("x.c < y.c")
        return owned.join(ends, "segment")

    def sides(pairs: DataFrame) -> DataFrame:
        """Pairs (o_a, o_b) with sizes, sketches and keys of both."""
        for side in "ab":
            pairs = pairs.join(sketches.select(F.col("o").alias(f"o_{side}"), F.col("k").alias(side), F.col("n").alias(f"n_{side}"), F.col("s").alias(f"s_{side}")), f"o_{side}")
        return pairs

    def ordered(pairs: DataFrame) -> DataFrame:
        flip = F.col("a") > F.col("b")
        return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(flip, F.col("n_b")).otherwise(F.col("n_a")).alias("n_a"), F.when(flip, F.col("n_a")).otherwise(F.col("n_b")).alias("n_b")).distinct()

    tested = None

    def untested(pairs: DataFrame) -> DataFrame:
        """Stored pairs, without those of earlier rounds."""
        return few(cut(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti")))

    while True:
        met = rows = labelled(met)  # a segment within one component stays so
        stars = rows.where("c <> x.c").select(F.col("o").alias("o_a"), F.col("x.o").alias("o_b")).union(rows.where("c <> y.c").select(F.col("o").alias("o_a"), F.col("y.o").alias("o_b"))).distinct()
        likely = untested(ordered(sides(stars).where(_may_link(num, den))))
        if likely.isEmpty():
            break
        found = few(cut(_linked(likely, classes, docs, size, num, den)))
        tested = likely.select("a", "b") if tested is None else tested.union(likely.select("a", "b"))
        if found.isEmpty():
            break
        component = joined(found)

    # what is still apart: in segments of many classes, by their differences from a pivot, the class with which most such segments can be compared
    open_ = cut(rows.select("segment", "o"))
    many = few(cut(open_.groupBy("segment").count().where(F.col("count") > CROWD).select("segment")))
    apart = None
    if not many.isEmpty():
        crowd = cut(open_.join(small(many), "segment"))
        pivots = crowd.join(crowd.groupBy("o").count(), "o").groupBy("segment").agg(F.max_by("o", F.struct("count", "o")).alias("p"))
        members = few(cut(crowd.join(pivots, "segment").where("o <> p").select("p", "o").distinct()))
        likely = untested(ordered(sides(members.select(F.col("o").alias("o_a"), F.col("p").alias("o_b"))).where(_may_link(num, den))))
        if not likely.isEmpty():
            found = few(cut(_linked(likely, classes, docs, size, num, den)))
            tested = likely.select("a", "b") if tested is None else tested.union(likely.select("a", "b"))
            component = component if found.isEmpty() else joined(found)
        known = sketches.select("o", "k", "n").join(component.select("k", "c"), "k")
        heads = known.select(F.col("o").alias("p"), F.col("k").alias("q"), F.col("n").alias("n_q"), F.col("c").alias("top"))
        members = cut(members.join(known, "o").join(heads, "p"))
        split = members.where("c <> top").select("p").distinct()
        members = few(cut(members.join(small(split), "p", "left_semi")))
        if not members.isEmpty():
            apart = ordered(sides(_crowd(members, classes, docs, size, num, den)).where(_may_link(num, den)))
        open_ = open_.join(small(many), "segment", "left_anti")

    # in the other segments, all pairs of different components; the largest component's rows meet the others' only
    open_ = cut(labelled(open_).select("segment", "o", "c"))
    largest = open_.groupBy("segment", "c").count().groupBy("segment").agg(F.max_by("c", F.struct("count", "c")).alias("most"))
    carried = open_.join(sketches, "o")
    a = carried.join(largest, "segment").where("c <> most").select("segment", "most", F.col("o").alias("o_a"), F.col("c").alias("c_a"), F.col("k").alias("a"), F.col("n").alias("n_a"), F.col("s").alias("s_a"))
    b = carried.select("segment", F.col("o").alias("o_b"), F.col("c").alias("c_b"), F.col("k").alias("b"), F.col("n").alias("n_b"), F.col("s").alias("s_b"))
    once = (F.col("c_b") == F.col("most")) | (F.col("o_a") < F.col("o_b"))
    pairs = ordered(a.join(b, "segment").where((F.col("c_a") != F.col("c_b")) & once & _may_link(num, den)))
    rest = untested(pairs if apart is None else pairs.union(apart).distinct())
    if not rest.isEmpty():
        found = few(cut(_linked(rest, classes, docs, size, num, den)))
        component = component if found.isEmpty() else joined(found)
    frequent.destroy()

    # names are settled among classes first; a stored table lets Spark split the rows of a class with many copies
    owned = component.select("k", "c").join(classes.select("k", F.col("doc_id").alias("own")), "k")
    names = owned.groupBy("c").agg(F.min("own").alias("least"))
    named = _stored(owned.join(names, "c").select("k", "least", F.col("c").alias("group")), paths)
    out = cut(sets.select("doc_id", "n_shingles", "k").join(named.drop("group"), "k", "left").select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id")))
    return out, named


def keep_one(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100, share: int = SHARE, least: int = FREQUENT) -> DataFrame:
    """``docs`` without all but the least-id document of each group of near duplicates; rows with a null id stay.

    Rows that share an id are told apart by their texts: one row of each group
    stays.  Of those without words, one of each id and text stays.
    """
    paths: list[str] = []
    try:
        with short_shuffles(docs.sparkSession):
            groups, classes = _grouped(docs, size, num, den, share, least, paths)
        own, key, name, group = (fresh(n, docs) for n in ("_id", "_k", "_least", "_group"))
        every = groups.where("doc_id IS NOT NULL").select("doc_id")
        repeated = cut(every.groupBy(F.col("doc_id").alias(own)).count().where("count > 1").select(own))
        gone = cut(groups.where("doc_id <> component_id").select(F.col("doc_id").alias(own)).distinct())
        if repeated.isEmpty():
            return without(docs, "doc_id", gone, every)
        left = without(docs, "doc_id", cut(gone.union(repeated).distinct()), every)
        keyed = may_hold(docs, "doc_id", repeated).join(small(repeated), F.col("doc_id") == F.col(own), "left_semi").withColumn(key, _class_of(size)(F.col("text").cast("string")))
        blank = keyed.where(F.col(key).isNull()).drop(key).dropDuplicates(["doc_id", "text"])
        known = keyed.where(F.col(key).isNotNull()).dropDuplicates(["doc_id", key])
        known = known.join(classes.select(F.col("k").alias(key), F.col("least").alias(name), F.col("group").alias(group)), key).where(F.col("doc_id") == F.col(name))
        return cut(left.unionByName(blank).unionByName(known.dropDuplicates(["doc_id", group]).select(*docs.columns)))
    finally:
        _remove(docs.sparkSession, paths)


def _class_of(size: int):
    """A function of texts: the class of each, null for those without words."""

    @F.pandas_udf("long")
    def class_of(texts):
        sets = map(Shingler(size), texts)
        return pd.Series([_key(h) if len(h) else None for h in sets], dtype="Int64")

    return class_of.asNondeterministic()  # else each filter on it measures again


def op2_jaccard(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), size=3, num=90)


OP2_SQL = r"""
WITH RECURSIVE tokens AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' '))) END AS s FROM tokens
), grams AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
), df AS (
  SELECT g, COUNT(*) AS f FROM grams GROUP BY g
), ranked AS (
  SELECT doc_id, n, grams.g, ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY f, grams.g) AS r FROM grams JOIN df ON grams.g = df.g
), prefix AS (
  SELECT doc_id, n, g FROM ranked WHERE r <= n - (n * 90 + 99) // 100 + 1
), candidates AS (
  SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM prefix x JOIN prefix y ON x.g = y.g AND x.doc_id < y.doc_id AND 100 * LEAST(x.n, y.n) >= 90 * GREATEST(x.n, y.n)
), links AS (
  SELECT a, b FROM (SELECT a, b, x.n AS na, y.n AS nb, COUNT(*) AS i FROM candidates JOIN grams x ON x.doc_id = a JOIN grams y ON y.doc_id = b AND y.g = x.g GROUP BY a, b, x.n, y.n)
  WHERE 100 * i >= 90 * (na + nb - i)
), edges AS (
  SELECT a, b FROM links UNION SELECT b, a FROM links
), reach AS (
  SELECT a AS doc_id, LEAST(a, b) AS c FROM edges UNION SELECT e.b, r.c FROM reach r JOIN edges e ON e.a = r.doc_id
), least AS (
  SELECT doc_id, MIN(c) AS c FROM reach GROUP BY doc_id
)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, COALESCE(l.c, s.doc_id) AS component_id FROM sets s LEFT JOIN least l ON s.doc_id = l.doc_id
"""
