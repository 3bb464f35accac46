"""Collocations by frequent-phrase mining in passes, as PCY and DHP count item sets.

Pass k counts phrases of k words exactly, but only where three filters let them
through: both phrases of k - 1 words inside are frequent (Apriori), and the
phrase's hash bucket, filled in the pass before, reached the least count (PCY).
In the same pass the phrases of k + 1 words whose two halves are still alive
are counted into buckets for the next one (DHP).  Filters are bitmaps of fixed
size, so what is broadcast doesn't grow with the corpus; a full bitmap lets more
through to the exact count, never less.  Texts are cut into words once, in the
first pass, which stores them as blocks of word numbers for the others.

Counts of buckets and of phrases travel together, one row for each task and
part of the hashes, not one for each phrase: a part's rows meet in one task,
which sums both and knows the part's bits of the two next filters.

A piece is text between ``[.,;:!?\\x0A-\\x0D]``, words are ``[^\\x20\\x09]+`` in it,
lower-cased over A-Z.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

from ..checkpoints import cut
from .common import small, small_batches, table
from .shingles import mix

#: A phrase is a candidate with so many occurrences in its language.
LEAST = 100
#: Words of a phrase at most.
LONGEST = 5
#: Phrases returned for each language.
TOP = 2000
#: Hash buckets of each pass, a power of two: 2 MB as a bitmap.
BUCKETS = 1 << 24
#: Counters that travel together, and the phrases whose hashes fall on them; their places fit into two bytes.
CHUNK = 1 << 16
#: Phrases that a task gathers, or sums in a chunk; then it hands their counts on and starts anew.
HELD = 1 << 19
#: Bytes of text a task works on at once.
FLUSH_BYTES = 8 << 20
#: Words a task numbers; then it hands their counts on and starts anew.
VOCABULARY = 1 << 19
#: Parts in which a language's counts meet a phrase's parts, when they are not broadcast.
SALTS = 16

#: Fixed values of the contract: what ends a piece, and what parts words.
_ENDS, _TAB = b".,;:!?\n\x0b\x0c\r", b"\t"
_MARK = b"\xff"  # stands in no UTF-8 text
_AFTER_LANG = b"\xfe"  # nor does this
_TABLE = bytes.maketrans(_ENDS + _TAB, _MARK * len(_ENDS) + b" ")
_PRIME = np.uint64(0x9E3779B97F4A7C15)


class Words(dict):
    """Numbers of words in order of first sight, with their hashes and counts; the end of a piece has number 0."""

    def __init__(self):
        super().__init__({_MARK: 0})
        self.names = [_MARK]
        self.hashes = [0]

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self.names)
        self.names.append(word)
        self.hashes.append(xxhash.xxh64_intdigest(word))
        return number

    def numbers(self, texts: list[bytes]) -> np.ndarray:
        """The words of whole texts, one after another, with 0 between pieces and behind each text."""
        words = (_MARK.join(texts) + _MARK).lower().translate(_TABLE).replace(_MARK, b" " + _MARK + b" ").split()
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def _seed(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(lang.encode(), seed=1))


def _longer(h: np.ndarray, words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of phrases of k words from those of their first k - 1 (``h``) and the words' hashes."""
    return mix(h[: len(words) - k + 1] * _PRIME + words[k - 1 :])


class Counters:
    """Bucket counts of one task, held at the least count that matters."""

    def __init__(self, buckets: int, least: int):
        self.least, self.counts = least, np.zeros(buckets, np.uint8 if least < 256 else np.uint32)

    def add(self, hashes: np.ndarray) -> None:
        at, n = np.unique((hashes & np.uint64(len(self.counts) - 1)).astype(np.uint32), return_counts=True)
        self.counts[at] = np.minimum(self.counts[at] + n, self.least)

    def chunks(self) -> Iterator[tuple[int, bytes]]:
        """Filled chunks as (number, places and counts of what is filled)."""
        size = min(CHUNK, len(self.counts))
        for number, part in enumerate(self.counts.reshape(-1, size)):
            (at,) = np.nonzero(part)
            if len(at):
                yield number, at.astype("<u2").tobytes() + part[at].tobytes()


class Phrases:
    """Phrases of one task with counts and hashes, until they are handed on in rows."""

    def __init__(self, buckets: int):
        self.buckets, self.names, self.n, self.hashes = buckets, [], [], []

    def add(self, lang: str, phrases: list[bytes], n: np.ndarray, hashes: np.ndarray) -> None:
        before = lang.encode() + _AFTER_LANG
        self.names += [before + p for p in phrases]
        self.n.append(n.astype("<i8"))
        self.hashes.append(hashes)

    def rows(self, columns: list[str]) -> Iterator[pa.RecordBatch]:
        """One row for each chunk of buckets on which phrases fall; afterwards none are held."""
        if not self.names:
            return
        n, chunk = np.concatenate(self.n), (np.concatenate(self.hashes) & np.uint64(self.buckets - 1)) // np.uint64(min(CHUNK, self.buckets))
        order = np.argsort(chunk, kind="stable")
        numbers, first = np.unique(chunk[order], return_index=True)
        parts = np.split(order, first[1:])
        blobs = [_MARK.join([self.names[i] for i in part.tolist()]) for part in parts]
        yield _batch(columns, chunk=numbers.astype(np.int32), phrases=blobs, counts=[n[part].tobytes() for part in parts])
        self.names, self.n, self.hashes = [], [], []


_TYPES = {"chunk": pa.int32(), "filled": pa.binary(), "phrases": pa.binary(), "counts": pa.binary(), "lang": pa.string(), "n": pa.int64(), "names": pa.binary(), "hashes": pa.binary(), "numbers": pa.binary()}
#: What a pass finds: counts of buckets, and phrases with theirs.
_FOUND = ["chunk", "filled", "phrases", "counts"]
#: Blocks of texts: ``n`` word numbers with the words and their hashes.
_BLOCK = ["lang", "n", "names", "hashes", "numbers"]
_FIRST = _FOUND + _BLOCK


def _schema(columns: list[str]) -> StructType:
    return from_arrow_schema(pa.schema([(c, _TYPES[c]) for c in columns]))


def _batch(columns: list[str], **held) -> pa.RecordBatch:
    """Rows with these columns, null where nothing is given."""
    m = len(next(iter(held.values())))
    return pa.RecordBatch.from_arrays([pa.array(held[c], _TYPES[c]) if c in held else pa.nulls(m, _TYPES[c]) for c in columns], names=columns)


def _summed(found: DataFrame, buckets: int, least: int) -> DataFrame:
    """Counts of chunks summed, each chunk in one task: rows (lang, phrase, n), (lang, n) of all phrases, and (chunk, full, alive).

    ``full`` are the bits of buckets that reached the least count, ``alive``
    those of frequent phrases.  Of a chunk with more than ``HELD`` phrases all
    are handed on with their counts so far, and their bits are set.
    """
    size, low = min(CHUNK, buckets), np.uint64(buckets - 1)
    item = Counters(8, least).counts.dtype

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, int] = {}
        n: dict[bytes, int] = {}

        def handed_on(alive: np.ndarray, from_: int) -> Iterator[pa.RecordBatch]:
            by: dict[str, list[bytes]] = {}
            for key, count in n.items():
                lang = key[: key.index(_AFTER_LANG)].decode()
                words[lang] = words.get(lang, 0) + count
                if count >= from_:
                    by.setdefault(lang, []).append(key)
            for lang, keys in by.items():
                for i in range(0, len(keys), 50_000):
                    phrases = [key[len(lang.encode()) + 1 :] for key in keys[i : i + 50_000]]
                    alive[_hashes(lang, phrases) & low & np.uint64(size - 1)] = True
                    yield _result([lang] * len(phrases), phrases, [n[key] for key in keys[i : i + 50_000]])
            n.clear()

        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for number, of_chunk in groupby(rows, lambda row: row[0]):
            total, alive, from_ = np.zeros(size, np.uint32), np.zeros(size, bool), least
            for _, filled, phrases, counts in of_chunk:
                if filled is not None:
                    m = len(filled) // (2 + item.itemsize)
                    at = np.frombuffer(filled, "<u2", m)
                    total[at] = np.minimum(total[at] + np.frombuffer(filled, item, m, 2 * m), least)
                    continue
                for key, count in zip(phrases.split(_MARK), np.frombuffer(counts, "<i8").tolist(), strict=True):
                    n[key] = n.get(key, 0) + count
                if len(n) > HELD:
                    from_ = 0
                    yield from handed_on(alive, from_)
            yield from handed_on(alive, from_)
            yield _result([None], [None], [None], [number], [np.packbits(total >= least).tobytes()], [np.packbits(alive).tobytes()])
        yield _result(list(words), [None] * len(words), list(words.values()))

    n = min(int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")), buckets // size)
    dealt = found.select(*_FOUND).repartition(n, "chunk").sortWithinPartitions("chunk")
    return small_batches(dealt).mapInArrow(run, "lang string, phrase binary, n long, chunk int, full binary, alive binary")


def _result(lang: list, phrase: list, n: list, chunk: list | None = None, full: list | None = None, alive: list | None = None) -> pa.RecordBatch:
    rest = [pa.nulls(len(lang), t) if c is None else pa.array(c, t) for c, t in ((chunk, pa.int32()), (full, pa.binary()), (alive, pa.binary()))]
    return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(phrase, pa.binary()), pa.array(n, pa.int64()), *rest], names=["lang", "phrase", "n", "chunk", "full", "alive"])


def _bitmaps(summed: DataFrame, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The bits ``full`` and ``alive`` of all chunks, ``buckets`` / 8 bytes each."""
    size = min(CHUNK, buckets) // 8
    full, alive = np.zeros(buckets // 8, np.uint8), np.zeros(buckets // 8, np.uint8)
    for row in summed.where("chunk IS NOT NULL").select("chunk", "full", "alive").collect():
        at = slice(row.chunk * size, (row.chunk + 1) * size)
        full[at], alive[at] = np.frombuffer(row.full, np.uint8), np.frombuffer(row.alive, np.uint8)
    return full, alive


def _by_language(batches: Iterator[pa.RecordBatch], flush: int) -> Iterator[tuple[str, list[bytes]]]:
    """Texts of Arrow batches (lang, text), some ``flush`` bytes at a time, those of a language together."""
    held: dict[str, list[bytes]] = {}
    size = 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if text:
                held.setdefault(lang, []).append(text)
                size += len(text)
                if size >= flush:
                    yield from held.items()
                    held, size = {}, 0
    yield from held.items()


def _block(lang: str, words: Words, hashes: np.ndarray, t: np.ndarray) -> pa.RecordBatch:
    """Texts as the numbers ``t``, told anew among the words that occur here; the end of a piece stays 0."""
    here = np.zeros(len(words.names), bool)
    here[0] = here[t] = True
    (own,) = np.nonzero(here)
    place = np.zeros(len(here), "<i4")
    place[own] = np.arange(len(own))
    names = _MARK.join([words.names[i] for i in own[1:].tolist()])
    numbers = pa.compress(place[t].tobytes(), codec="zstd", asbytes=True)
    return _batch(_FIRST, lang=[lang], n=[len(t)], names=[names], hashes=[hashes[own].astype("<u8").tobytes()], numbers=[numbers])


def _filled(counters: Counters, columns: list[str]) -> Iterator[pa.RecordBatch]:
    chunks = list(counters.chunks())
    if chunks:
        yield _batch(columns, chunk=[number for number, _ in chunks], filled=[blob for _, blob in chunks])


def _first_pass(buckets: int, least: int, flush: int) -> Callable:
    """Counts words, and pairs of words into buckets; stores the texts as blocks of numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters, phrases = Counters(buckets, least), Phrases(buckets)
        tables: dict[str, tuple[Words, np.ndarray]] = {}

        def handed_on():
            for lang, (words, counts) in tables.items():
                seen = np.flatnonzero(counts[1:]) + 1
                phrases.add(lang, [words.names[i] for i in seen.tolist()], counts[seen], mix(np.array(words.hashes, np.uint64)[seen] + _seed(lang)))
            tables.clear()
            yield from phrases.rows(_FIRST)

        for lang, texts in _by_language(batches, flush):
            words, counts = tables.get(lang, (Words(), np.zeros(0, np.int64)))
            t = words.numbers(texts)
            new = np.bincount(t, minlength=len(words.names))
            new[: len(counts)] += counts
            tables[lang] = words, new
            hashes = np.array(words.hashes, np.uint64)
            yield _block(lang, words, hashes, t)
            h = hashes[t]
            pairs = _longer(mix(h + _seed(lang)), h, 2)
            counters.add(pairs[(t[:-1] > 0) & (t[1:] > 0)])
            if sum(len(w) for w, _ in tables.values()) > VOCABULARY:
                yield from handed_on()
        yield from handed_on()
        yield from _filled(counters, _FIRST)

    return run


def _next_pass(k: int, last: bool, full: Broadcast, shorter: Broadcast, buckets: int, least: int) -> Callable:
    """Counts phrases of k words in blocks (lang, n, names, hashes, numbers) that pass the filters, and those of k + 1 with two such parts into buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters, phrases = None if last else Counters(buckets, least), Phrases(buckets)
        full_bits, shorter_bits = np.unpackbits(full.value).view(bool), np.unpackbits(shorter.value).view(bool)
        low = np.uint64(buckets - 1)
        for lang, size, blob, hashes, numbers in (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)):
            if size < k:
                continue
            t = np.frombuffer(pa.decompress(numbers, 4 * size, codec="zstd"), "<i4").astype(np.int64)
            names = [_MARK, *blob.split(_MARK)]
            one = np.frombuffer(hashes, "<u8")[t]
            h = mix(one + _seed(lang))
            for j in range(2, k):
                h = _longer(h, one, j)
            parts = shorter_bits[h & low]
            hit = parts[: len(t) - k + 1] & parts[1 : len(t) - k + 2]
            end = np.append(np.flatnonzero(t == 0), len(t))  # a phrase lies before the next end of a piece
            (at,) = np.nonzero(hit)
            at = at[at + k <= end[np.searchsorted(end, at)]]
            own = mix(h[at] * _PRIME + one[at + k - 1])
            passed = full_bits[own & low]
            at, own = at[passed], own[passed]
            if counters:
                both = np.flatnonzero(np.diff(at) == 1)  # places whose next place is alive too; within a piece if the longer phrase is
                both = both[at[both] + k + 1 <= end[np.searchsorted(end, at[both])]]
                counters.add(mix(own[both] * _PRIME + one[at[both] + k]))
            # numbers of words as digits: no two phrases of a language have the same key
            key, digit, bound = np.zeros(len(at), np.int64), len(names), 1
            for j in range(k):
                if bound * digit >= 1 << 62:
                    key, bound = np.unique(key, return_inverse=True)[1], len(at)
                key, bound = key * digit + t[at + j], bound * digit
            _, first, n = np.unique(key, return_index=True, return_counts=True)
            place = at[first]
            for i in range(0, len(place), 50_000):
                some = slice(i, i + 50_000)
                cols = [t[place[some] + j].tolist() for j in range(k)]
                phrases.add(lang, [b" ".join([names[w] for w in row]) for row in zip(*cols, strict=True)], n[some], own[first[some]])
                if len(phrases.names) > HELD:
                    yield from phrases.rows(_FOUND)
        yield from phrases.rows(_FOUND)
        if counters:
            yield from _filled(counters, _FOUND)

    return run


def _hashes(lang: str, phrases: list[bytes]) -> np.ndarray:
    """Hashes of phrases that have equally many words."""
    words = np.array([xxhash.xxh64_intdigest(w) for p in phrases for w in p.split(b" ")], np.uint64).reshape(len(phrases), -1)
    h = mix(words[:, 0] + _seed(lang))
    for more in words.T[1:]:
        h = mix(h * _PRIME + more)
    return h


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, buckets: int = BUCKETS, flush: int = FLUSH_BYTES) -> tuple[DataFrame, DataFrame]:
    """All phrases of 1 to ``longest`` words with at least ``least`` occurrences, as (lang, k, phrase, f), and (lang, n), the words of each language.

    ``docs`` has (lang, text) without nulls, text as bytes.
    """
    if buckets & (buckets - 1) or buckets < 8:
        raise ValueError("buckets must be a power of two, 8 at least")
    context = docs.sparkSession.sparkContext
    stored = cut(small_batches(docs).mapInArrow(_first_pass(buckets, least, flush), _schema(_FIRST)))
    blocks = small_batches(stored.where("numbers IS NOT NULL").select(*_BLOCK))
    found, filters, levels, totals = stored.where("chunk IS NOT NULL"), [], [], None
    for k in range(1, longest + 1):
        summed = cut(_summed(found, buckets, least))
        for used in filters:
            used.destroy()
        if k == 1:
            totals = summed.where("lang IS NOT NULL AND phrase IS NULL").groupBy("lang").agg(F.sum("n").alias("n"))
        levels.append(summed.where("phrase IS NOT NULL").groupBy("lang", "phrase").agg(F.sum("n").alias("f")).where(F.col("f") >= least))
        full, alive = _bitmaps(summed, buckets)
        if k == longest or not (full.any() and alive.any()):
            break
        filters = [context.broadcast(full), context.broadcast(alive)]
        found = blocks.mapInArrow(_next_pass(k + 1, k + 1 == longest, *filters, buckets, least), _schema(_FOUND))
    every = reduce(DataFrame.unionByName, [level.select("lang", F.lit(k).alias("k"), "phrase", "f") for k, level in enumerate(levels, 1)])
    return cut(every), cut(totals)


def _with_count(df: DataFrame, part: str, counts: DataFrame, name: str) -> DataFrame:
    """``df`` with the count of its phrase in ``part``; a first word that opens a third of all phrases is dealt over ``SALTS`` parts."""
    known = counts.select(F.col("lang").alias("_l"), F.col("phrase").alias("_p"), F.col("f").alias(name))
    hinted = small(known)
    if hinted is not known:
        return df.join(hinted, (F.col("lang") == F.col("_l")) & (F.col(part) == F.col("_p"))).drop("_l", "_p")
    spread = known.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumn("_s", F.col("_s").cast("long"))
    salted = df.withColumn("_own", F.pmod(F.xxhash64("phrase", "cut"), F.lit(SALTS)))
    return salted.join(spread, (F.col("lang") == F.col("_l")) & (F.col(part) == F.col("_p")) & (F.col("_own") == F.col("_s"))).drop("_l", "_p", "_s", "_own")


def scored(phrases: DataFrame, totals: DataFrame) -> DataFrame:
    """Rows (lang, phrase, k, a, l, r, n, score) of the candidates that no longer one with the same count holds, with their lowest-scoring cut.

    Products have up to 38 digits, enough for counts up to 10^17 each way.
    """
    several = phrases.where("k > 1").select("lang", "phrase", "k", F.col("f").alias("a"), F.split(F.col("phrase").cast("string"), " ").alias("w"))
    inside = several.where("k > 2").select("lang", "a", F.explode(F.array(F.slice("w", F.lit(1), F.col("k") - 1), F.slice("w", F.lit(2), F.col("k") - 1))).alias("w"))
    covered = inside.groupBy("lang", F.array_join("w", " ").cast("binary").alias("phrase")).agg(F.max("a").alias("longer"))
    alone = several.join(covered, ["lang", "phrase"], "left").where("longer IS NULL OR longer < a").drop("longer")
    cuts = alone.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    piece = lambda start, length: F.array_join(F.slice("w", start, length), " ").cast("binary")
    cuts = cuts.select("lang", "phrase", "k", "a", "cut", piece(F.lit(1), F.col("cut")).alias("left"), piece(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("right"))
    both = _with_count(_with_count(cuts, "left", phrases, "l"), "right", phrases, "r").join(small(totals), "lang")
    score = F.expr("(CAST(1000 AS DECIMAL(4, 0)) * CAST(a AS DECIMAL(16, 0)) * CAST(n AS DECIMAL(16, 0))) DIV (CAST(l AS DECIMAL(18, 0)) * CAST(r AS DECIMAL(18, 0)))")
    lowest = both.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "k", "a", "l", "r", "n")).alias("x"))
    return lowest.select("lang", F.col("phrase").cast("string").alias("phrase"), "x.k", "x.a", "x.l", "x.r", "x.n", "x.score")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, top: int = TOP, buckets: int = BUCKETS, flush: int = FLUSH_BYTES) -> DataFrame:
    """Rows (lang, rank, phrase, a, l, r, n, score): each language's first ``top`` collocations.

    A null text is empty, a null language is ``und``.  Repeated rows count
    again; an empty table, or one whose phrases are all rare, gives no rows;
    other columns aren't read, whatever their names; whole texts are read,
    however long.  Ties are broken by count and then by phrase.
    """
    plain = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("text"))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = scored(*frequent_phrases(plain, least, longest, buckets, flush)).withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), words AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), totals AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang
), grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM words, range(1, 6) ks(k), LATERAL (SELECT unnest(range(1, len(w) - k + 2)) AS i) WHERE len(w) >= k
), f AS (
  SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100
), candidates AS (
  SELECT lang, k, phrase, f AS a FROM f WHERE k > 1
), alone AS (
  SELECT * FROM candidates c WHERE NOT EXISTS (
    SELECT 1 FROM candidates d WHERE d.lang = c.lang AND d.k > c.k AND 100 * d.a >= 100 * c.a AND contains(' ' || d.phrase || ' ', ' ' || c.phrase || ' '))
), cuts AS (
  SELECT c.lang, c.phrase, c.a, x.cut, array_to_string(string_split(c.phrase, ' ')[1:x.cut], ' ') AS p, array_to_string(string_split(c.phrase, ' ')[x.cut + 1:], ' ') AS q
  FROM alone c, range(1, 5) x(cut) WHERE x.cut < c.k
), scored AS (
  SELECT c.lang, c.phrase, c.a, c.cut, l.f AS l, r.f AS r, t.n, ((1000::HUGEINT * c.a * t.n) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = c.p JOIN f r ON r.lang = c.lang AND r.phrase = c.q JOIN totals t ON t.lang = c.lang
), lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM lowest QUALIFY rank <= 2000
"""
