"""Mixing sources to target weights.

Tokens are summed per source, each source's target follows from the weights
(targets above ``cap`` times a source's size are cut there and the excess is
shared out again by weight), and the repetition rate of a source is its target
by its size.  A document is emitted floor(rate) times, plus one copy if a
number in [0, 1) hashed from its id and the seed is below the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, small, table

SEED = "mix-1"
WEIGHTS = (1, 2, 3)
CAP = 3


def words(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(key: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from 52 bits of the MD5 of seed and key; a null key draws as the empty text."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), key.cast("string"))), 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Rows (source, source_size, target) of (source, size).

    Sources in code point order, null last, take ``weights`` in turn, and share
    the sum of all sizes.  The shares settle in closed form: sources are ordered
    by cap * size / weight; those before the first that stays below its cap get
    the cap, the others share what is left by weight.  A source of size 0 gets 0.
    The windows run over one row per source, after the sums.
    """
    by = cut(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    weighed = by.withColumn("w", F.element_at(F.array(*[F.lit(w) for w in weights]), (turn + 1).cast("int")).cast("long")).withColumn("most", F.col("source_size") * cap)
    # exact order of most / w: cross products of integers stay exact in decimals
    full = Window.orderBy((F.col("most").cast("decimal(38,12)") / F.col("w")), F.col("source").asc_nulls_last())
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    everything = full.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0))
    heavy = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0))
    # the level at which this and all later sources would share what is left
    found = weighed.withColumn("left", left).withColumn("heavy", heavy).withColumn("pos", F.row_number().over(full))
    open_ = F.col("left") * F.col("w") < F.col("most") * F.col("heavy")
    # the first open source in that order: of tied ones, that before whose caps are taken off
    level = found.withColumn("level", F.min(F.when(open_, F.struct("pos", "left", "heavy"))).over(everything))
    share = F.col("w") * F.col("level.left").cast("double") / F.col("level.heavy").cast("double")
    return level.select("source", "source_size", F.when(F.col("level").isNull(), F.col("most").cast("double")).otherwise(F.least(F.col("most").cast("double"), share)).alias("target"))


def mixing_copies(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = SEED, key: str = "doc_id") -> DataFrame:
    """``docs`` with size, source_size, target and copies appended.

    Input columns of those names are replaced.  Null and empty texts have size
    0; rows that repeat a key draw alike; an empty table gives no rows.  The
    targets' table joins by broadcast only if it is small, else by a shuffle
    whose hot sources Spark's skew join splits.
    """
    sized = docs.drop("size", "source_size", "target", "copies").withColumn("size", words(F.col("text")))
    targets = source_targets(sized.select("source", "size"), weights, cap)
    joined = sized.join(small(cut(targets.withColumnRenamed("source", "_mix_source"))), F.col("source").eqNullSafe(F.col("_mix_source")), "inner").drop("_mix_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    return joined.withColumn("copies", (whole + F.when(draw(F.col(key), seed) < rate - whole, 1).otherwise(0)).cast("long"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """The mix itself: every document as often as it is to be taken, with the columns of ``docs``.

    A column of ``docs`` named size, source_size, target or copies is kept as it is.
    """
    held = F.struct(*docs.columns).alias("_held")
    copies = mixing_copies(docs.select("doc_id", "text", "source", held), weights, cap, seed)
    return copies.select("_held", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select("_held.*")


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing_copies(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP1_SQL = """
WITH sized AS (
  SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents
), by_source AS (
  SELECT source, SUM(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, 1 + (ROW_NUMBER() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS w, 3 * source_size AS most FROM by_source
), steps AS (
  SELECT *, (SUM(source_size) OVER ())::BIGINT - COALESCE(SUM(most) OVER before, 0)::BIGINT AS rest,
         (SUM(w) OVER ())::BIGINT - COALESCE(SUM(w) OVER before, 0)::BIGINT AS heavy,
         ROW_NUMBER() OVER (ORDER BY most::DOUBLE / w, source ASC NULLS LAST) AS pos
  FROM weighed WINDOW before AS (ORDER BY most::DOUBLE / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT rest, heavy FROM steps WHERE rest * w < most * heavy ORDER BY pos LIMIT 1
), targets AS (
  SELECT source, source_size, CASE WHEN (SELECT COUNT(*) FROM level) = 0 THEN most::DOUBLE
         ELSE LEAST(most::DOUBLE, w * (SELECT rest::DOUBLE FROM level) / (SELECT heavy::DOUBLE FROM level)) END AS target
  FROM steps
), rated AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (size * (FLOOR(rate)::BIGINT + CASE WHEN ('0x' || substr(md5('mix-1' || COALESCE(':' || doc_id, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE < rate - FLOOR(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM rated
"""
