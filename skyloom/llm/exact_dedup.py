"""Exact deduplication by Grace hashing.

Records are dealt by the leading bits of their hash into buckets, each bucket
that fits is read into an open-addressing table that compares complete
contents, and buckets that don't fit are dealt again by more bits.  What more
bits can't part (one hash with too many records) is dealt by chance instead,
so that copies melt together in many tasks before they meet.  The spill files
are Spark's shuffle files, and what waits for the next level lies in the shared
checkpoint folder.

Equal means identical after lower-casing A-Z.  Copies are merged in each scan
task first: one record of a task's copies travels with its text (compressed),
the others only with its number, so a text of a third of all rows is no large
group anywhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoints import cut
from .common import small_batches, table

#: Bytes of contents that an open-addressing table may hold; a single longer record has a table of its own.
TABLE_BYTES = 16 << 20
#: Bytes of distinct contents a scan task keeps to merge copies; then it starts anew.
SCAN_BYTES = 32 << 20
#: Records of a table at most, whatever their size.
TABLE_RECORDS = 200_000
#: Shuffle partitions of a level at most; each streams its buckets one after another.
PARTITIONS_AT_MOST = 20_000
#: Bits that one level adds to split a bucket that did not fit.
LEVEL_BITS = 5


class ContentTable:
    """Open addressing with linear probing; two records are the same only if their complete contents are."""

    def __init__(self, capacity: int = 1 << 10):
        self.slots = [-1] * capacity
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.bytes = 0

    def __len__(self) -> int:
        return len(self.contents)

    def _grow(self) -> None:
        mask = 2 * len(self.slots) - 1
        self.slots = slots = [-1] * (mask + 1)
        for number, h in enumerate(self.hashes):
            at = h & mask
            while slots[at] >= 0:
                at = (at + 1) & mask
            slots[at] = number

    def place(self, h: int, content: bytes) -> tuple[int, bool]:
        """The number of ``content`` in order of first sight, and whether it is new."""
        slots, hashes, contents = self.slots, self.hashes, self.contents
        mask = len(slots) - 1
        at = h & mask
        while (number := slots[at]) >= 0:
            if hashes[number] == h and contents[number] == content:
                return number, False
            at = (at + 1) & mask
        slots[at] = number = len(contents)
        hashes.append(h)
        contents.append(content)
        self.bytes += len(content)
        if 2 * len(contents) > len(slots):
            self._grow()
        return number, True


def signed(h: int) -> int:
    return h - (1 << 64) if h >= 1 << 63 else h


def _scan(rows: DataFrame, scan_bytes: int) -> DataFrame:
    """One row for each of (row, id, text): the first of a task's copies has their hash, size and packed content, all point to it by ``first``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, firsts = ContentTable(), []
        packed = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            rows, texts = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            first, hashes, sizes, contents = [], [], [], []
            for row, content in zip(rows, texts, strict=True):
                content = (content or b"").lower()
                if seen.bytes + len(content) > scan_bytes or len(seen) >= TABLE_RECORDS:
                    seen, firsts = ContentTable(), []
                h = xxhash.xxh3_64_intdigest(content)
                number, new = seen.place(h, content)
                if new:
                    firsts.append(row)
                first.append(firsts[number])
                hashes.append(signed(h) if new else None)
                sizes.append(len(content) if new else None)
                contents.append(packed.compress(content) if new else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(first, pa.int64()), pa.array(hashes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(contents, pa.binary())], names=["row", "id", "first", "h", "size", "content"])

    return small_batches(rows).mapInArrow(run, "row long, id long, first long, h long, size long, content binary")


def _bucket(bits: int):
    """The leading ``bits`` of the hash."""
    return F.shiftrightunsigned("h", 64 - bits) if bits else F.lit(0).cast("long")


def _melted(records: DataFrame, partitions: int) -> DataFrame:
    """Rows (key, upper, sha256) for each record of (bucket, key, h, content): the first record of its bucket with the same content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = zstandard.ZstdDecompressor()
        at, seen, uppers, shas = None, ContentTable(), [], []
        for batch in batches:
            buckets, keys, hashes, contents = (batch.column(i).to_pylist() for i in range(4))
            upper, sha = [], []
            for bucket, key, h, content in zip(buckets, keys, hashes, contents, strict=True):
                if bucket != at:
                    at, seen, uppers, shas = bucket, ContentTable(), [], []
                content = plain.decompress(content)
                number, new = seen.place(h & (1 << 64) - 1, content)
                if new:
                    uppers.append(key)
                    shas.append(hashlib.sha256(content).digest())
                upper.append(uppers[number])
                sha.append(shas[number])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(upper, pa.int64()), pa.array(sha, pa.binary())], names=["key", "upper", "sha"])

    dealt = records.select("bucket", "key", "h", "content").repartition(partitions, "bucket").sortWithinPartitions("bucket")
    return small_batches(dealt).mapInArrow(run, "key long, upper long, sha binary")


def _classes(records: DataFrame, table_bytes: int, level_bits: int) -> DataFrame:
    """Rows (key, class, sha) of stored (key, h, size, content): equal contents have the same class, the key of one of them.

    Each round melts the buckets that fit and splits the others; rounds end, as
    a bucket either shrinks with more bits or has one hash, and then its records
    are dealt by chance into tables of some eight records or more, of which one
    record for each content is left.
    """
    done, links, bits = [], [], None
    todo, n, size = records, *records.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    while n:
        need = max(-(-int(size) // (table_bytes // 2)), -(-n // (TABLE_RECORDS // 2)), 1)
        bits = min((need - 1).bit_length(), 40) if bits is None else min(bits + level_bits, 64)
        partitions = min(need, PARTITIONS_AT_MOST)
        bucket = _bucket(bits).alias("bucket")
        sizes = todo.groupBy(bucket).agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), (F.min("h") == F.max("h")).alias("one"))
        # records of one hash are mostly copies, which a table holds once: eight or more of them meet in each
        parts = F.least(F.greatest(F.ceil(F.col("bytes") / table_bytes), F.ceil(F.col("n") / TABLE_RECORDS)), F.when(F.col("one"), F.ceil(F.col("n") / 8)).otherwise(F.col("n")))
        large = cut(sizes.select("bucket", "one", parts.alias("parts")).where("parts > 1"))
        if large.isEmpty():
            done.append(_melted(todo.withColumn("bucket", _bucket(bits)), partitions).select("key", F.col("upper").alias("class"), "sha"))
            break
        # buckets over the size of a table are few where hashes are spread; the join stays a shuffle of both sides if they aren't
        marked = todo.withColumn("bucket", _bucket(bits)).join(large.hint("shuffle_hash") if large.count() > PARTITIONS_AT_MOST else F.broadcast(large), "bucket", "left")
        done.append(cut(_melted(marked.where("parts IS NULL"), partitions)).select("key", F.col("upper").alias("class"), "sha"))
        chance = F.pmod(F.xxhash64("key", F.lit(bits)), F.col("parts")).cast("long")
        melted = cut(_melted(marked.where("one").withColumn("bucket", F.xxhash64("h", chance)), partitions))
        links.append(melted.where("key <> upper").select("key", "upper"))
        left = marked.where("NOT one").select("key", "h", "size", "content").unionByName(marked.where("one").join(melted.where("key = upper").select("key"), "key", "left_semi").select("key", "h", "size", "content"))
        todo, before = cut(left), n
        n, size = todo.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
        if n == before and bits == 64:  # one hash, only different contents: chance can't help any more, a single table holds them
            done.append(_melted(todo.withColumn("bucket", F.col("h")), partitions).select("key", F.col("upper").alias("class"), "sha"))
            break
    if not done:
        return records.select("key", F.col("key").alias("class"), F.lit(None).cast("binary").alias("sha"))
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    for link in reversed(links):
        found = found.unionByName(link.join(found.withColumnRenamed("key", "upper"), "upper").select("key", "class", "sha"))
    return found


def _groups(rows: DataFrame, table_bytes: int, scan_bytes: int, level_bits: int) -> DataFrame:
    """Rows (row, id, keep_id, group_size, kept, text_sha256) of (row, id, text as bytes); ``row`` is unique."""
    scanned = cut(_scan(rows, scan_bytes))
    classes = cut(_classes(scanned.where("content IS NOT NULL").select(F.col("first").alias("key"), "h", "size", "content"), table_bytes, level_bits))
    members = scanned.select("row", "id", "first")
    # the best row of a task's copies, then the best of a class
    best = F.max(F.struct(F.col("id").isNotNull().alias("known"), F.coalesce("id", F.lit(0)).alias("id"), (-F.col("row")).alias("place"))).alias("best")
    totals = members.groupBy("first").agg(F.count("*").alias("n"), best).join(classes, F.col("first") == F.col("key"))
    groups = totals.groupBy("class").agg(F.sum("n").alias("group_size"), F.max("best").alias("best"), F.max("sha").alias("sha"))
    known = totals.select("first", "class").join(groups, "class").select("first", "group_size", "best", F.lower(F.hex("sha")).alias("text_sha256"))
    return members.join(known, "first").select("row", "id", F.when(F.col("best.known"), F.col("best.id")).alias("keep_id"), "group_size", (F.col("best.place") == -F.col("row")).alias("kept"), "text_sha256")


def exact_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", table_bytes: int = TABLE_BYTES, scan_bytes: int = SCAN_BYTES, level_bits: int = LEVEL_BITS) -> DataFrame:
    """Rows (doc_id, keep_id, group_size, kept, text_sha256), one for each row of ``docs``.

    The row with the largest id of a group stays; a null id is less than any
    other, and of rows with the same id the first one stays, so exactly one row
    of each group is kept.  A null text is an empty one.  An empty table gives
    no rows; other columns aren't read, whatever their names; a text longer
    than a table's bytes has a table of its own.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").cast("binary").alias("text"))
    return _groups(rows, table_bytes, scan_bytes, level_bits).select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


def drop_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with all its columns and one row of each group of equal texts, the one that ``exact_groups`` keeps."""
    taken = {c.lower() for c in docs.columns}
    place = next(n for i in range(len(taken) + 1) if (n := f"place{i}") not in taken)
    numbered = cut(docs.withColumn(place, F.monotonically_increasing_id()))
    rows = numbered.select(F.col(place).alias("row"), F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").cast("binary").alias("text"))
    kept = _groups(rows, TABLE_BYTES, SCAN_BYTES, LEVEL_BITS).where("kept").select(F.col("row").alias(place))
    return numbered.join(kept, place, "left_semi").select(docs.columns)


def op11_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


OP11_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM d
"""
