"""What the training-data operators share: Arrow batches, cut lineage, checked broadcasts, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..checkpoints import cut

#: Fixed values of the contracts: a word, and white space inside a text.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

#: Rows that Python works on at once, so that a batch's temporary arrays stay small.
SLICE_ROWS = 256

#: Arrow batches between the JVM and Python, in rows and bytes at most; Spark's own 10,000 rows and 64 MB are held several times over in each task.
BATCH_ROWS, BATCH_BYTES = 512, 4 << 20

#: A side with at most so many rows may be broadcast; a larger one is shuffled.
BROADCAST_ROWS = 200_000

#: Narrow rows of a stored table in a partition.
PARTITION_ROWS = 100_000

#: Words of 64 bits of a Bloom filter, which is broadcast as so many rows at most (some 50 MB).
BLOOM_WORDS = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(df: DataFrame) -> DataFrame:
    """``df``; from now on its session sends batches of at most ``BATCH_ROWS`` rows and about ``BATCH_BYTES`` to Python, or smaller ones if it is set so."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def map_slices(df: DataFrame, make: Callable[[], Callable[[dict[str, list]], dict[str, list]]], schema: str | StructType) -> DataFrame:
    """Run Python over slices of Arrow batches.

    ``make()`` is called once in each task and returns the function that turns
    the columns of a slice (lists) into the columns of its result.
    """
    out = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                cols = work({n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) for f in arrow], schema=arrow)

    return small_batches(df).mapInArrow(run, out)


def map_whole_rows(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: StructType) -> DataFrame:
    """Like ``map_slices`` for functions that pass other columns on: slices of Arrow batches in, batches of ``schema`` out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                yield work(batch.slice(at, SLICE_ROWS))

    return small_batches(df).mapInArrow(run, schema)


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Hint a broadcast if ``df`` has at most ``rows`` (``BROADCAST_ROWS``) narrow rows; otherwise leave the join to shuffle both sides."""
    rows = BROADCAST_ROWS if rows is None else rows
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def _marks(column: str) -> tuple[Column, Column]:
    """Where an id stands in a Bloom filter of ``BLOOM_WORDS`` words: its word, and two bits of it."""
    h = F.xxhash64(F.col(column).cast("long"))
    bit = lambda shift: F.call_function("shiftleft", F.lit(1).cast("long"), (F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(63))).cast("int"))
    return F.pmod(h, F.lit(BLOOM_WORDS)), bit(50).bitwiseOR(bit(56))


def fresh(name: str, *frames: DataFrame) -> str:
    """``name``, or the first longer one that is no column of ``frames``."""
    held = {c.lower() for f in frames for c in f.columns}
    while name.lower() in held:
        name += "_"
    return name


def _flagged(df: DataFrame, column: str, ids: DataFrame) -> tuple[DataFrame, str]:
    """``df`` with one more column, and its name: whether ``column`` may be among ``ids`` (one column); false only for those that are not.

    The filter is a broadcast table of at most ``BLOOM_WORDS`` rows however
    many ids there are; more ids let more others through.
    """
    (name,) = ids.columns
    hit, at_word, held = (fresh(n, df) for n in ("_hit", "_word", "_bits"))
    word, bits = _marks(name)
    words = ids.select(word.alias(at_word), bits.alias(held)).groupBy(at_word).agg(F.bit_or(held).alias(held))
    at, own = _marks(column)
    return df.join(F.broadcast(words), at == F.col(at_word), "left").withColumn(hit, F.coalesce(F.col(column).isNotNull() & (F.col(held).bitwiseAND(own) == own), F.lit(False))).drop(at_word, held), hit


def may_hold(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """The rows of ``df`` whose ``column`` is among ``ids`` (one column, distinct), and perhaps a few others; no row of ``df`` is shuffled."""
    (name,) = ids.columns
    known = small(ids)
    if known is not ids:
        own = fresh("_id", df)
        return df.join(known.withColumnRenamed(name, own), F.col(column) == F.col(own), "left_semi")
    flagged, hit = _flagged(df, column, ids)
    return flagged.where(F.col(hit)).drop(hit)


def without(df: DataFrame, column: str, gone: DataFrame, every: DataFrame) -> DataFrame:
    """The rows of ``df`` whose ``column`` is null or not among ``gone`` (one column, distinct).

    ``every`` has all values of the column.  Beyond a broadcast, a Bloom filter
    lets most rows pass; ids that it holds by mistake are sought among
    ``every`` and broadcast.  Only if those are too many, the rows it holds are
    shuffled; the others never are.
    """
    (name,), (own,) = gone.columns, every.columns
    left, kept, stays = (fresh(n, df) for n in ("_gone", "_kept", "_stays"))
    gone = gone.withColumnRenamed(name, left)
    known, same = small(gone), F.col(column) == F.col(left)
    if known is not gone:
        return df.join(known, same, "left_anti")
    asked, hit = _flagged(every.withColumnRenamed(own, kept), kept, gone)
    mistaken = cut(asked.where(F.col(hit)).select(kept).distinct().join(gone, F.col(kept) == F.col(left), "left_anti"))
    flagged, hit = _flagged(df, column, gone)
    few = small(mistaken)
    if few is not mistaken:
        marked = flagged.join(few.withColumn(stays, F.lit(True)), F.col(column) == F.col(kept), "left")
        return marked.where(~F.col(hit) | F.coalesce(stays, F.lit(False))).select(df.columns)
    return flagged.where(~F.col(hit)).select(df.columns).unionByName(flagged.where(F.col(hit)).select(df.columns).join(gone, same, "left_anti"))


#: Spark's setting by which a query's shuffle files are deleted on all executors when the query ends.
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def short_shuffles(spark: SparkSession) -> Iterator[None]:
    """Inside, each query's shuffle files go when the query ends, so a loop of stored steps holds those of one step on disk.

    Otherwise they stay until the driver happens to collect the objects that
    stand for them.  Steps must be stored by ``cut`` or as a table: what is run
    twice is computed twice.  The session's setting is put back afterwards.
    """
    before = spark.conf.get(CLEAN_SHUFFLES, None)
    spark.conf.set(CLEAN_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEAN_SHUFFLES)
        else:
            spark.conf.set(CLEAN_SHUFFLES, before)


def few(df: DataFrame) -> DataFrame:
    """A stored ``df`` in no more partitions than its narrow rows need, so that small tables cost few tasks and files."""
    return df.coalesce(1 + df.count() // PARTITION_ROWS)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected ``edges`` (a long, b long): rows (id, component), the smallest id of each.

    Alternating large-star and small-star rounds: every vertex hangs its larger
    (then its smaller) neighbours on the least vertex it sees.  Minima are
    pre-aggregated before each shuffle, and no vertex's neighbours are gathered.
    Ids without edges don't appear; loops and repeated edges are ignored.
    """
    now = few(cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()))
    mark = None
    while True:
        both = now.select("u", "v").union(now.select(F.col("v"), F.col("u")))
        hint = F.broadcast if mark is not None and mark[0] <= BROADCAST_ROWS else lambda df: df
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(hint(least), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(hint(down), "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        stars = hung.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct()
        now = cut(stars if mark is None else stars.coalesce(1 + mark[0] // PARTITION_ROWS))
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
        now = now.coalesce(1 + mark[0] // PARTITION_ROWS)
    return now.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("id"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
