"""BPE encoding and decoding by forced cuts.

A byte pair that occurs inside no vocabulary token can never be merged, so each
such pair is a certain cut: the fragments between cuts are encoded on their
own and their ids joined.  Fragments repeat far more often than words, so their
ids are kept in a bounded table.  The vocabulary file names the normaliser, the
word pattern and the merges; the tokenizers library reads them.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models

from .common import map_slices, table

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism

#: Pieces whose ids a task keeps; beyond that it starts anew.
KEPT = 250_000
#: Outside Latin-1, or white space to one library and not to the other.
_UNUSUAL = re.compile("[^\x00-\x1b\x20-\xff]")


class ForcedCutEncoder:
    """Encodes texts as ``Tokenizer.encode(text, add_special_tokens=False)`` does, and decodes as ``decode(ids, skip_special_tokens=False)``."""

    def __init__(self, path: str):
        self.whole = Tokenizer.from_file(path)
        self.whole.no_padding()
        self.whole.no_truncation()
        data = json.loads(self.whole.to_str())
        model = data["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        added = data["added_tokens"]
        # under a key with a space, which no other piece has
        self.specials = {" " + t["content"]: np.array([t["id"]], "<u4").tobytes() for t in added}
        # found in the raw text before anything else, the first and longest ones
        self.special = re.compile("(" + "|".join(re.escape(t["content"]) for t in sorted(added, key=lambda t: -len(t["content"]))) + ")") if added else None
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
            raise ValueError("the vocabulary's special tokens must be found as they stand")
        self.inside = self._inside(model["vocab"])
        # the model alone, without normaliser, word pattern and special tokens
        self.vocab = model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        known = dict(self.vocab)
        self.ends = Tokenizer(models.BPE(known, merges, end_of_word_suffix=self.suffix))
        # a fragment that doesn't end its word takes the plain merges
        self.plain = Tokenizer(models.BPE(known, merges))
        self.words: dict[str, bytes] = {}
        # lower-casing and white space are all that happens to Latin-1 texts under this normaliser
        self.plain_latin = [n["type"] for n in (data["normalizer"] or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        # without a decoder in the file, decoding joins the tokens by spaces
        self.joined = {i: t for t, i in self.whole.get_vocab(with_added_tokens=True).items()} if data["decoder"] is None else None
        if not self.whole.normalizer or "\\s+" not in json.dumps(data["normalizer"]).replace("\\\\", "\\"):
            raise ValueError("the vocabulary must turn white space into single spaces")

    def _inside(self, vocab: dict[str, int]) -> set[tuple[str, str]]:
        """All pairs of neighbouring byte symbols inside any token."""
        pairs = set()
        for token in vocab:
            token = token.removesuffix(self.suffix) if self.suffix and token != self.suffix else token
            pairs.update(zip(token, token[1:], strict=False))
        return pairs

    def fragments(self, word: str) -> list[tuple[str, bool]]:
        """The pieces of a word of byte symbols between forced cuts, each with whether it ends the word."""
        inside = self.inside
        cuts = [i for i, pair in enumerate(zip(word, word[1:], strict=False), 1) if pair not in inside]
        if not cuts:
            return [(word, True)]
        return [(word[a:b], b == len(word)) for a, b in zip([0, *cuts], [*cuts, len(word)], strict=True)]

    def _learn(self, pieces: list[str]) -> None:
        """Puts the ids of new white-space-free pieces into the table, all of a slice at once."""
        if not pieces:
            return
        starts = np.cumsum([0, *(len(p) + 1 for p in pieces)])
        found = self.whole.pre_tokenizer.pre_tokenize_str(" ".join(pieces))
        owner = np.searchsorted(starts, [span[0] for _, span in found], "right") - 1
        cut = {word: self.fragments(word) for word in {w for w, _ in found}}
        needed = {p for parts in cut.values() for p in parts}
        ids: dict[tuple[str, bool], bytes] = {}
        for last, tokenizer in ((True, self.ends), (False, self.plain)):
            new = [p for p in needed if p[1] == last]
            made = tokenizer.encode_batch_fast([t for t, _ in new], add_special_tokens=False)
            ids.update(zip(new, (np.array(e.ids, "<u4").tobytes() for e in made), strict=True))
        of_word = {word: b"".join([ids[p] for p in parts]) for word, parts in cut.items()}
        got = dict.fromkeys(range(len(pieces)), b"")
        for at, (word, _) in zip(owner.tolist(), found, strict=True):
            got[at] += of_word[word]
        self.words.update(zip(pieces, got.values(), strict=True))

    def _pieces(self, text: str) -> list[str]:
        """The normalised text's white-space-free pieces, and special tokens behind a space."""
        if self.special and self.special.search(text):
            return [p for i, part in enumerate(self.special.split(text)) for p in ([" " + part] if i % 2 else self._pieces(part))]
        if self.plain_latin and not _UNUSUAL.search(text):  # the file's normaliser, for characters below 256
            return text.lower().split()
        return [p for p in self.whole.normalizer.normalize_str(text).split(" ") if p]

    def encode_bytes(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        clean = [self._pieces(text or "") for text in texts]
        seen = {p for pieces in clean for p in pieces}
        new = [p for p in seen if p not in self.words]
        if len(self.words) + len(new) > KEPT:
            self.words.clear()
            new = list(seen)
        if new:
            self.words.update({p: self.specials[p] for p in new if p in self.specials})
            self._learn([p for p in new if p not in self.specials])
        words = self.words
        return [b"".join([words[p] for p in pieces]) for pieces in clean]

    def encode_all(self, texts: list[str | None]) -> list[list[int]]:
        return [np.frombuffer(x, "<u4").tolist() for x in self.encode_bytes(texts)]

    def encode(self, text: str | None) -> list[int]:
        return self.encode_all([text])[0]

    def decode(self, ids: list[int]) -> str:
        if self.joined is None:
            return self.whole.decode(ids, skip_special_tokens=False)
        tokens = self.joined
        return " ".join([tokens[i] for i in ids])


@cache
def encoder(path: str) -> ForcedCutEncoder:
    return ForcedCutEncoder(path)


def encode_texts(docs: DataFrame, path: str) -> DataFrame:
    """Rows (doc_id, ids array<int>) of every whole text; null and empty texts give an empty array."""

    def make():
        encode = encoder(path).encode_all
        return lambda cols: {"doc_id": cols["doc_id"], "ids": encode(cols["text"])}

    return map_slices(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), make, "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """Rows (doc_id, text) of (doc_id, ids); a null array gives an empty text."""

    def make():
        decode = encoder(path).decode
        return lambda cols: {"doc_id": cols["doc_id"], "text": [decode(ids or []) for ids in cols["ids"]]}

    return map_slices(encoded.select("doc_id", "ids"), make, "doc_id long, text string")


def round_trip_digest(docs: DataFrame, path: str) -> DataFrame:
    """Encode and decode every whole text and return the digests of both results.

    Repeated rows give repeated rows; other columns aren't read.
    """

    def make():
        coder = encoder(path)

        def work(cols):
            ids = coder.encode_bytes(cols["text"])
            decoded = (coder.decode(np.frombuffer(x, "<u4").tolist()) for x in ids)
            return {"doc_id": cols["doc_id"], "n_tokens": [len(x) // 4 for x in ids], "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids], "decoded_sha256": [hashlib.sha256(x.encode()).hexdigest() for x in decoded]}

        return work

    return map_slices(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_bpe(spark, sf_dir: str) -> DataFrame:
    return round_trip_digest(table(spark, sf_dir, "documents"), vocabulary())
