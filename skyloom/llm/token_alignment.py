"""Alignment of two tokenizers by deduplicated segments.

A text is cut before runs of spaces.  A cut is certain where no token of
either vocabulary has a space behind the character before the cut: no merge
can reach across it, so segments are tokenised on their own and the tokens of
a text are those of its segments, one after another.  Both tokenizers have a
token's end at each cut, so alignments of segments compose to that of the text.

Texts are worked on in blocks.  A block asks for its distinct segments once
(a packed list for each bucket of the segments' hashes), a bucket tokenises and
aligns its distinct segments once, whichever blocks they came from, and sends
each block the alignments in the order of its list.  The texts themselves are
kept as places in these lists; neither texts nor single words are shuffled.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import sentencepiece
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ..checkpoints import cut
from .common import small_batches, table

#: Characters of the texts of a block.
BLOCK_CHARS = 24_000_000
#: Characters given to a tokenizer at once; a longer segment stays whole.
ENCODE_CHARS = 1 << 14
#: Segments that are aligned at once.
ALIGN_SEGMENTS = 50_000
#: Names of byte pieces.
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")


def byte_symbols() -> dict[str, int]:
    """The byte that each symbol of a byte-level vocabulary stands for: printable bytes for themselves, the others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class TwoTokenizers:
    """A byte-level BPE (A) and a piece model with byte fallback (B), the bytes of their tokens, and where texts may be cut."""

    def __init__(self, path_a: str, path_b: str):
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.no_padding()
        self.a.no_truncation()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        symbols = byte_symbols()
        vocab = self.a.get_vocab(with_added_tokens=False)
        bytes_a = {i: bytes(symbols[c] for c in t) for t, i in vocab.items() if all(c in symbols for c in t)}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        bytes_b = {i: bytes([int(m[1], 16)]) if self.b.is_byte(i) and (m := _BYTE.fullmatch(p)) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)}
        self.bytes_a, self.bytes_b = ([x.get(i, b"") for i in range(max(x) + 1)] for x in (bytes_a, bytes_b))
        self.length_a, self.length_b = (np.array([len(x) for x in y], np.int64) for y in (self.bytes_a, self.bytes_b))
        self.name_a, self.name_b = [str(i) for i in range(len(self.bytes_a))], [str(i) for i in range(len(self.bytes_b))]
        # characters that some token has before a space: no cut behind them, nor behind white space
        before = {t[:i].decode(errors="replace")[-1] for t in [*self.bytes_a, *self.bytes_b] for i in range(1, len(t)) if t[i : i + 1] == b" "}
        if "\ufffd" in before:
            raise ValueError("a token has a space behind part of a character")
        kept = "".join(re.escape(c) for c in sorted(before) if not c.isspace())
        self._plain = re.compile(rf"(?:[\s{kept}]|^) ")
        self._cut = re.compile(rf"(?<=[^\s{kept}]) ")
        self._whole = re.compile(rf"[^\s{kept}]\Z")
        self._check_rules(path_a, path_b, set(vocab))

    def _check_rules(self, path_a: str, path_b: str, vocab: set[str]) -> None:
        """What the cuts and ``whole`` rely on beside the vocabularies."""
        from sentencepiece import sentencepiece_model_pb2 as proto

        file = json.loads(Path(path_a).read_text())
        step = file["pre_tokenizer"] or {}
        model = proto.ModelProto.FromString(Path(path_b).read_bytes())
        rule = model.normalizer_spec
        if step.get("type") != "ByteLevel" or step.get("add_prefix_space") or not rule.add_dummy_prefix or model.trainer_spec.model_type != 2:
            raise ValueError("A must be a byte-level BPE without prefix space, B a BPE piece model that adds a space")
        self.faithful_a = file["normalizer"] is None and file["model"].get("dropout") is None and set(byte_symbols()) <= vocab
        self.faithful_b = not rule.precompiled_charsmap and not rule.remove_extra_whitespaces and model.trainer_spec.byte_fallback and not any(p.type == 4 for p in model.pieces)
        if not (self.faithful_a and self.faithful_b):
            raise ValueError("a vocabulary that changes texts can't be aligned by segments")

    def whole(self, text: str | None) -> bool:
        """Whether the joined bytes of both are those of space + text: B takes U+2581 for a space, all else is kept by both."""
        return bool(text) and "▁" not in text

    def segments(self, text: str) -> list[str]:
        """The segments of space + text, each without the space that it starts with."""
        return text.split(" ") if not self._plain.search(text) else self._cut.split(text)

    def encode(self, segments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of A and of B of space + segment, for all segments one after another.

        Segments are encoded many at once, as a text that is cut behind each;
        one behind which no cut is certain ends its text.
        """
        texts, held, size = [], [], 0
        for s in segments:
            held.append(s.decode())
            size += len(s) + 1
            if size >= ENCODE_CHARS or not self._whole.search(held[-1]):
                texts.append(" ".join(held))
                held, size = [], 0
        if held:
            texts.append(" ".join(held))
        a = [np.array(e.ids, np.int64) for e in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
        b = [np.array(x, np.int64) for x in self.b.encode(texts, num_threads=1)]
        return np.concatenate(a), np.concatenate(b)

    def align(self, segments: list[bytes]) -> dict[str, np.ndarray | list]:
        """The alignments of segments.

        Sums for each segment (n_a, n_b, n_groups, n_links), its groups as
        text, and its links as ``id of A << 32 | id of B``, all segments' one
        after another.
        """
        a, b = self.encode(segments)
        end_a, end_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        ends = np.cumsum([len(s) + 1 for s in segments])
        if not (end_a[-1] == end_b[-1] == ends[-1] and np.isin(ends, end_a).all() and np.isin(ends, end_b).all()):
            raise ValueError("tokens reach across a cut, or don't give the text back")
        common, every = np.intersect1d(end_a, end_b, assume_unique=True), np.union1d(end_a, end_b)
        of = lambda at: np.bincount(np.searchsorted(ends, at), minlength=len(ends))
        # between two neighbouring ends lies one token of each: one link
        links = a[np.searchsorted(end_a, every)] << 32 | b[np.searchsorted(end_b, every)]
        group_a, group_b = np.searchsorted(common, end_a), np.searchsorted(common, end_b)
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        last_a, last_b = np.isin(end_a, common), np.isin(end_b, common)
        mark = np.concatenate([np.where(last_a, 1, 0), np.where(np.isin(end_b, ends), 3, np.where(last_b, 2, 0))])[order]
        ids = np.concatenate([a, b])[order]
        names = [self.name_a, self.name_b]
        side = (order >= len(a)).astype(np.int64)
        text = "".join([names[s][i] + ",|;\n"[m] for s, i, m in zip(side.tolist(), ids.tolist(), mark.tolist(), strict=True)])
        return {"n_a": of(end_a), "n_b": of(end_b), "n_groups": of(common), "n_links": of(every), "groups": text.split("\n")[:-1], "links": links}


@cache
def tokenizers(path_a: str, path_b: str) -> TwoTokenizers:
    return TwoTokenizers(path_a, path_b)


def _pack(*parts: bytes) -> bytes:
    """Parts behind their lengths, compressed."""
    head = np.array([len(parts), *map(len, parts)], "<i8").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(parts))


def _unpack(blob: bytes) -> list[bytes]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(data, "<i8", 1)[0])
    ends = (8 * (n + 1) + np.cumsum(np.frombuffer(data, "<i8", n, 8))).tolist()
    return [data[a:b] for a, b in zip([8 * (n + 1), *ends], ends, strict=False)]


def _ints(x: np.ndarray) -> bytes:
    return x.astype("<u4").tobytes()


def _list(segments: list[bytes]) -> bytes:
    """Segments behind their lengths; they may hold any byte."""
    return _ints(np.array(list(map(len, segments)), np.int64)) + b"".join(segments)


def _unlist(data: bytes, n: int) -> list[bytes]:
    ends = (4 * n + np.cumsum(np.frombuffer(data, "<u4", n).astype(np.int64))).tolist()
    return [data[a:b] for a, b in zip([4 * n, *ends], ends, strict=False)]


#: ``block`` and ``bucket`` say where a row goes: a text has no bucket, a request and its reply have both, an alignment has no block.
_ROWS = "block long, bucket int, doc_id long, n long, body binary"


def _batch(block, bucket, doc_id, n, body) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(bucket, pa.int32()), pa.array(doc_id, pa.int64()), pa.array(n, pa.int64()), pa.array(body, pa.binary())], names=["block", "bucket", "doc_id", "n", "body"])


def _asked(docs: DataFrame, buckets: int, block_chars: int, paths: tuple[str, str]) -> DataFrame:
    """Texts of (row, doc_id, text) as places in their block's lists, and the lists by bucket with the segments' counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = tokenizers(*paths)
        numbers: dict[str, int] = {}
        held: list[tuple[int, np.ndarray]] = []
        size, block = 0, None

        def finished():
            words = [s.encode() for s in numbers]
            bucket = np.array([xxhash.xxh3_64_intdigest(w) % buckets for w in words], np.int64)
            order = np.argsort(bucket, kind="stable")
            place = np.empty(len(words), np.int64)
            place[order] = np.arange(len(words))
            counts = np.bincount(np.concatenate([at for _, at in held]), minlength=len(words))
            for i in range(0, len(held), 256):
                part = held[i : i + 256]
                yield _batch([block] * len(part), [-1] * len(part), [d for d, _ in part], [len(at) for _, at in part], [_pack(_ints(place[at])) for _, at in part])
            for own in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(words) else []:
                yield _batch([block], [bucket[own[0]]], [None], [len(own)], [_pack(_list([words[i] for i in own.tolist()]), _ints(counts[own]))])

        for batch in batches:
            for row, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                block = row if block is None else block
                at = np.empty(0, np.uint32)
                if both.whole(text):
                    segments = both.segments(text)
                    for s in segments:
                        if s not in numbers:
                            numbers[s] = len(numbers)
                    at = np.fromiter(map(numbers.__getitem__, segments), np.uint32, len(segments))
                    size += len(text)
                held.append((doc_id, at))
                if size >= block_chars or len(held) >= 100_000:
                    yield from finished()
                    numbers, held, size, block = {}, [], 0, None
        if held:
            yield from finished()

    return small_batches(docs).mapInArrow(run, _ROWS)


def _aligned(requests: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """For each bucket, dealt and sorted by it: its distinct segments aligned once, and how often its segments link each pair.

    Rows with a null body are pairs: ``doc_id`` is the pair, ``n`` its count in
    the bucket.  The other row of a bucket has its alignments.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = tokenizers(*paths)
        bucket, counts = None, {}

        def finished():
            segments = list(counts)
            found, at_links = [], []
            for i in range(0, len(segments), ALIGN_SEGMENTS):
                found.append(both.align(segments[i : i + ALIGN_SEGMENTS]))
                at_links.append(found[-1]["links"])
            links = np.concatenate(at_links)
            sums = [np.concatenate([f[name] for f in found]) for name in ("n_a", "n_b", "n_groups", "n_links")]
            pairs, at = np.unique(links, return_inverse=True)
            seen = np.zeros(len(pairs), np.int64)
            np.add.at(seen, at, np.repeat(np.fromiter(counts.values(), np.int64, len(counts)), sums[3]))
            groups = _list([g.encode() for f in found for g in f["groups"]])
            yield _batch([None], [bucket], [None], [len(segments)], [_pack(_list(segments), *map(_ints, sums), groups, _ints(at), pairs.astype("<i8").tobytes())])
            for i in range(0, len(pairs), 50_000):
                part = pairs[i : i + 50_000]
                yield _batch(pa.nulls(len(part), pa.int64()), np.full(len(part), bucket), part, seen[i : i + 50_000], pa.nulls(len(part), pa.binary()))

        for batch in batches:
            for own, n, body in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if own != bucket and counts:
                    yield from finished()
                    counts = {}
                bucket = own
                listed, seen = _unpack(body)
                for s, c in zip(_unlist(listed, n), np.frombuffer(seen, "<u4").tolist(), strict=True):
                    counts[s] = counts.get(s, 0) + c
        if counts:
            yield from finished()

    return small_batches(requests).mapInArrow(run, _ROWS)


def _answered(rows: DataFrame) -> DataFrame:
    """The blocks' lists answered in order.  For each bucket come its alignments, then its pairs with their counts, then the requests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, sums, groups, links_at, pairs = {}, [], [], None, None
        count = best = None
        per_segment: list[np.ndarray] | None = None
        for batch in batches:
            kinds, blocks, buckets, pair, n, hit, body = (batch.column(i).to_pylist() for i in range(7))
            out = []
            for kind, block, bucket, p, m, b, blob in zip(kinds, blocks, buckets, pair, n, hit, body, strict=True):
                if kind == 0:
                    segments, *numbers, listed, at, known = _unpack(blob)
                    place = {s: i for i, s in enumerate(_unlist(segments, m))}
                    sums = [np.frombuffer(x, "<u4").astype(np.int64) for x in numbers]
                    groups = _unlist(listed, m)
                    links_at, pairs = np.frombuffer(at, "<u4"), np.frombuffer(known, "<i8")
                    count, best, per_segment = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64), None
                elif kind == 1:
                    i = np.searchsorted(pairs, p)
                    count[i], best[i] = m, b
                else:
                    if per_segment is None:
                        starts = np.cumsum(sums[3]) - sums[3]
                        per_segment = [*sums, np.add.reduceat(best[links_at], starts), np.add.reduceat(count[links_at], starts)]
                    listed, _ = _unpack(blob)
                    at = np.array([place[s] for s in _unlist(listed, m)], np.int64)
                    out.append((block, bucket, m, _pack(*(_ints(x[at]) for x in per_segment[:5]), per_segment[5][at].astype("<i8").tobytes(), _list([groups[i] for i in at.tolist()]))))
            if out:
                yield _batch([o[0] for o in out], [o[1] for o in out], [None] * len(out), [o[2] for o in out], [o[3] for o in out])

    return small_batches(rows).mapInArrow(run, _ROWS)


_DIGEST = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _composed(rows: DataFrame, digest: bool) -> DataFrame:
    """Texts' alignments from the replies to their block, which come first, in order of buckets."""
    schema = _DIGEST if digest else _DIGEST.replace("groups_sha256", "groups")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_block, sums, groups = None, [[] for _ in range(6)], []
        whole: list[np.ndarray] | None = None
        for batch in batches:
            blocks, buckets, docs, n, body = (batch.column(i).to_pylist() for i in range(5))
            out: list[list] = [[] for _ in range(8)]
            for block, bucket, doc_id, m, blob in zip(blocks, buckets, docs, n, body, strict=True):
                if block != at_block:
                    at_block, sums, groups, whole = block, [[] for _ in range(6)], [], None
                if bucket is not None and bucket >= 0:
                    *numbers, last, listed = _unpack(blob)
                    for held, x in zip(sums, [*(np.frombuffer(x, "<u4").astype(np.int64) for x in numbers), np.frombuffer(last, "<i8")], strict=True):
                        held.append(x)
                    groups += _unlist(listed, m)
                    continue
                if whole is None:
                    whole = [np.concatenate(x) if x else np.empty(0, np.int64) for x in sums]
                at = np.frombuffer(_unpack(blob)[0], "<u4")
                out[0].append(doc_id)
                for held, x in zip(out[1:7], whole, strict=True):
                    held.append(int(x[at].sum()))
                text = b";".join([groups[i] for i in at.tolist()])
                out[7].append("" if not len(at) else hashlib.sha256(text).hexdigest() if digest else text.decode())
            if out[0]:
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in out[:7]), pa.array(out[7], pa.string())], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256" if digest else "groups"])

    return small_batches(rows).mapInArrow(run, schema)


def aligned_texts(docs: DataFrame, path_a: str, path_b: str, digest: bool = True, text: str = "text", doc_id: str = "doc_id", buckets: int | None = None, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Rows (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every whole text.

    Null and empty texts, and those that a tokenizer changes, have no tokens:
    zeros and ''.  Repeated rows give repeated rows and count again; a null id
    stays null; an empty table gives no rows; other columns aren't read,
    whatever their names.  With ``digest=False`` the groups come as text in
    ``groups``.  ``buckets`` is the session's number of shuffle partitions if
    it isn't given.
    """
    paths = (path_a, path_b)
    n = buckets or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    asked = cut(_asked(rows, n, block_chars, paths))
    requests = asked.where("bucket >= 0")
    dealt = requests.select("bucket", "n", "body").repartition(n, "bucket").sortWithinPartitions("bucket")
    aligned = cut(_aligned(dealt, paths))
    links = aligned.where("body IS NULL").select("bucket", F.col("doc_id").alias("pair"), "n")
    counts = cut(links.groupBy("pair").agg(F.sum("n").alias("n")).withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))))
    most = counts.groupBy("b").agg(F.max("n").alias("most"))
    known = counts.join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).cast("int").alias("best"))
    none = lambda kind: F.lit(None).cast(kind)
    parts = [
        aligned.where("body IS NOT NULL").select(F.lit(0).alias("kind"), none("long").alias("block"), "bucket", none("long").alias("pair"), "n", none("int").alias("best"), "body"),
        links.select("bucket", "pair").join(known, "pair").select(F.lit(1).alias("kind"), none("long").alias("block"), "bucket", "pair", "n", "best", none("binary").alias("body")),
        requests.select(F.lit(2).alias("kind"), "block", "bucket", none("long").alias("pair"), "n", none("int").alias("best"), "body"),
    ]
    replies = _answered(parts[0].unionByName(parts[1]).unionByName(parts[2]).repartition(n, "bucket").sortWithinPartitions("bucket", "kind"))
    ordered = replies.unionByName(asked.where("bucket < 0")).withColumn("text", (F.col("bucket") < 0).cast("int"))
    return _composed(ordered.repartition("block").sortWithinPartitions("block", "text", "bucket").drop("text"), digest)


def vocabularies() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def op13_alignment(spark, sf_dir: str) -> DataFrame:
    return aligned_texts(table(spark, sf_dir, "documents"), *vocabularies())
