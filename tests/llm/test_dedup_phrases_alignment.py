"""Operators 11 to 13 against plain versions."""

import hashlib
import os
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from skyloom.llm import collocations, exact_dedup, token_alignment

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
public_tokenizers = pytest.importorskip("public_tokenizers")


# --- 11: exact dedup


def plain_groups(rows):
    groups = defaultdict(list)
    for i, (doc_id, text) in enumerate(rows):
        groups[(text or "").encode().lower()].append((doc_id is not None, doc_id or 0, -i, doc_id))
    out = []
    for content, members in groups.items():
        best = max(members)
        out += [(m[3], best[3], len(members), m == best, hashlib.sha256(content).hexdigest()) for m in members]
    return sorted(out, key=repr)


def documents(spark, rows, parts=3):
    return spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string").repartition(parts) if rows else spark.createDataFrame([], "doc_id long, text string")


@pytest.mark.parametrize(("table_bytes", "scan_bytes", "level_bits"), [(16 << 20, 32 << 20, 5), (600, 50, 9)])
def test_groups_equal_plain_ones(spark, table_bytes, scan_bytes, level_bits):
    rnd = random.Random(table_bytes)
    texts = ["", "A", "a", "Ä", "ä", "a ", "x" * 500, "X" * 499 + "y", *("".join(rnd.choice("aAbB") for _ in range(rnd.randint(1, 6))) for _ in range(60))]
    rows = [(i, rnd.choice([None, *texts])) for i in range(300)] + [(1000 + i, "The Same Text, Over And Over") for i in range(200)]
    got = exact_dedup.exact_groups(documents(spark, rows), table_bytes=table_bytes, scan_bytes=scan_bytes, level_bits=level_bits)
    assert sorted(map(tuple, got.collect()), key=repr) == plain_groups(rows)


def test_one_row_of_each_group_stays(spark):
    rows = [(1, "a"), (1, "a"), (1, "A"), (None, "a"), (None, "b"), (None, "B"), (2, None), (3, "")]
    got = exact_dedup.exact_groups(documents(spark, rows, 1)).collect()
    assert len(got) == len(rows)
    assert sorted((r.text_sha256, r.keep_id, r.group_size) for r in got if r.kept) == sorted((hashlib.sha256(t).hexdigest(), i, n) for t, i, n in [(b"a", 1, 4), (b"b", None, 2), (b"", 3, 2)])


def test_dedup_of_empty_tables_and_other_columns(spark):
    assert exact_dedup.exact_groups(documents(spark, [])).count() == 0
    docs = documents(spark, [(1, "x"), (2, "X"), (3, None), (4, "y")]).select("*", *(F.lit(7).alias(c) for c in ("row", "h", "id", "place0", "content", "first", "bucket")))
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4]
    assert exact_dedup.exact_groups(docs).count() == 4


def test_table_compares_complete_contents():
    seen = exact_dedup.ContentTable(2)
    words = [b"%d" % i for i in range(500)]
    assert [seen.place(5, w) for w in words] == [(i, True) for i in range(500)]
    assert [seen.place(5, w) for w in words] == [(i, False) for i in range(500)]


# --- 12: collocations


def plain_collocations(rows, least, top):
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in range(1, 6) for i in range(len(w) - k + 1))
    several = {p: c for p, c in f.items() if len(p) > 2 and c >= least}
    covered = {(p[0], *p[i:j]) for p, c in several.items() for i in range(1, len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) - 1 and c >= f[(p[0], *p[i:j])]}
    out = defaultdict(list)
    for p, a in several.items():
        if p not in covered:
            lang, w = p[0], p[1:]
            score, _, left, right = min((1000 * a * n[lang] // (f[(lang, *w[:k])] * f[(lang, *w[k:])]), k, f[(lang, *w[:k])], f[(lang, *w[k:])]) for k in range(1, len(w)))
            out[lang].append((-score, -a, " ".join(w), left, right))
    return sorted((lang, i, w, -a, left, right, n[lang], -s) for lang, found in out.items() for i, (s, a, w, left, right) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2].encode()))[:top], 1))


def phrases(seed, n=300):
    rnd = random.Random(seed)
    words = ["new", "York", "new york", "the", "a", "of", "é", "日本", "x y", "NEW", "fixed phrase of five words", "\t", "  "]
    return [(rnd.choice(["en", "de", None]), "".join(rnd.choice(words) + rnd.choice([" ", " ", " ", ", ", ".", "\n", "\x0b", ": "]) for _ in range(rnd.randint(0, 40)))) for _ in range(n)] + [("en", None), (None, ""), ("fr", "one two")]


@pytest.mark.parametrize(("buckets", "flush", "vocabulary"), [(1 << 24, 8 << 20, 1 << 19), (8, 500, 20), (1 << 12, 3000, 1 << 19)])
def test_collocations_equal_plain_counts(spark, monkeypatch, buckets, flush, vocabulary):
    """Bitmaps that are full (8 buckets), texts in small lots and tables begun anew change nothing."""
    monkeypatch.setattr(collocations, "VOCABULARY", vocabulary)
    rows = phrases(buckets)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    got = collocations.collocations(docs, least=7, top=25, buckets=buckets, flush=flush)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == plain_collocations(rows, 7, 25)


@pytest.mark.parametrize("held", [3, 1 << 19])
def test_counts_of_many_phrases_travel_in_few_rows(spark, monkeypatch, held):
    """A task's rows are as many as chunks, not as phrases; chunks with more phrases than are held hand on parts of counts, which are summed."""
    from skyloom.checkpoints import cut

    monkeypatch.setattr(collocations, "HELD", held)
    rows, made = phrases(5), []
    monkeypatch.setattr(collocations, "cut", lambda df: made.append(cut(df)) or made[-1])
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(2)
    assert sorted(map(tuple, collocations.collocations(docs, least=7, buckets=8).collect())) == plain_collocations(rows, 7, 2000)
    assert made[0].where("numbers IS NULL").count() <= 4  # two parts, each with a row of words and one of buckets


def test_scores_pass_64_bits(spark):
    big = 9 * 10**14
    phrases = spark.createDataFrame([("en", 1, b"a", big), ("en", 1, b"b", big + 1), ("en", 2, b"a b", big - 3)], "lang string, k int, phrase binary, f long")
    totals = spark.createDataFrame([("en", 5 * 10**15)], "lang string, n long")
    (row,) = collocations.scored(phrases, totals).collect()
    assert row.score == 1000 * (big - 3) * 5 * 10**15 // (big * (big + 1))


def test_scores_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr("skyloom.llm.common.BROADCAST_ROWS", 0)
    rows = phrases(3)
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert sorted(map(tuple, collocations.collocations(docs, least=7, buckets=1 << 10).collect())) == plain_collocations(rows, 7, 2000)


def test_collocations_of_nothing(spark):
    docs = spark.createDataFrame([], "text string, lang string, n int, phrase int, chunk int")
    assert collocations.collocations(docs).count() == 0
    rare = spark.createDataFrame([("a b c", "en", 1)], "text string, lang string, f int")
    assert collocations.collocations(rare).count() == 0
    with pytest.raises(ValueError, match="power of two"):
        collocations.collocations(rare, buckets=100)


# --- 13: alignment


def plain_alignment(rows):
    """Every text encoded as a whole, links by walking along both token lists."""
    both = token_alignment.tokenizers(*token_alignment.vocabularies())
    counts, docs = Counter(), []
    for doc_id, text in rows:
        a, b = (both.a.encode(" " + text, add_special_tokens=False).ids, both.b.encode(text)) if text else ([], [])
        whole = (" " + (text or "")).encode()
        if b"".join(both.bytes_a[i] for i in a) != whole or b"".join(both.bytes_b[i] for i in b) != whole:
            docs.append((doc_id, [], [], [], []))
            continue
        links, groups, i, j, at_a, at_b, first = [], [], 0, 0, 0, 0, (0, 0)
        while i < len(a):
            links.append((a[i], b[j]))
            end_a, end_b = at_a + len(both.bytes_a[a[i]]), at_b + len(both.bytes_b[b[j]])
            i, at_a, j, at_b = (i + 1, end_a, j, at_b) if end_a < end_b else (i, at_a, j + 1, end_b) if end_b < end_a else (i + 1, end_a, j + 1, end_b)
            if end_a == end_b:
                groups.append(",".join(map(str, a[first[0] : i])) + "|" + ",".join(map(str, b[first[1] : j])))
                first = (i, j)
        counts.update(links)
        docs.append((doc_id, a, b, groups, links))
    most = Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    return sorted(((d, len(a), len(b), len(g), len(x), sum(counts[p] == most[p[1]] for p in x), sum(counts[p] for p in x), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for d, a, b, g, x in docs), key=repr)


ODD = [
    None, "", " ", "   ", " a", "a ", "a  b", "trail   ", "  lead", "a▁b", "▁", "<|endoftext|> <s> <unk> <0x41> </s>", "\n\n a\n b\t c", "x\r\n y",
    "日本語 テキスト  😀 ok", "'s don't  we'll", "\x00 \x01", "a" * 5000, "a　 b   c \x85 d", "\x1c \x1d y", "é ​ z", "word " * 300,
]


def test_alignment_equals_whole_texts(spark):
    rnd = random.Random(1)
    parts = [" ", " ", "  ", "a", "the", "é", "\n", "\t", "日", "😀", "'s", "1", "!", "<", "　", "\x00", "\x85", "  ", "▁" * 0]
    texts = ODD + ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 60))) for _ in range(400)]
    rows = [*enumerate(texts), (3, " a"), (None, "the same row"), (None, "the same row")]
    docs = documents(spark, rows, 5)
    for block in (2000, 24_000_000):
        got = token_alignment.aligned_texts(docs, *token_alignment.vocabularies(), block_chars=block, buckets=3)
        assert sorted(map(tuple, got.collect()), key=repr) == plain_alignment(rows)


@needs_data
def test_alignment_of_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, token_alignment.op13_alignment(spark, DATA).collect()), key=repr) == plain_alignment(rows)


def test_alignment_as_text_and_other_columns(spark):
    docs = documents(spark, [(1, "Hello world"), (2, None)]).select("*", *(F.lit(1).alias(c) for c in ("block", "bucket", "row", "n", "body", "kind")))
    got = {r.doc_id: r for r in token_alignment.aligned_texts(docs, *token_alignment.vocabularies(), digest=False).collect()}
    assert got[1].groups.count(";") == got[1].n_groups - 1 and got[2].groups == "" and got[2].n_a == 0
    assert token_alignment.aligned_texts(documents(spark, []), *token_alignment.vocabularies()).count() == 0


def test_cuts_are_where_nothing_merges():
    both = token_alignment.tokenizers(*token_alignment.vocabularies())
    assert both.segments("a b") == ["a", "b"] and both.segments(" a  b\n c ") == [" a", " b\n c", ""]
    with pytest.raises(ValueError, match="byte-level"):
        token_alignment.TwoTokenizers(public_tokenizers.path("word_bpe_49k.json"), token_alignment.vocabularies()[1])


def test_first_pass_stores_texts_as_word_numbers():
    """Later passes read blocks of numbers, so texts are cut into words once."""
    import numpy as np
    import pyarrow as pa

    from skyloom.llm import collocations as c

    texts = [b"A b, a\tB. \xc3\xa4", b"", b"c", b"b b\n\nc"]
    batch = pa.RecordBatch.from_arrays([pa.array(["x"] * 4), pa.array(texts, pa.binary())], names=["lang", "text"])
    blocks = [row for out in c._first_pass(64, 2, 12)(iter([batch])) for row in out.to_pylist() if row["numbers"] is not None]
    words = []
    for row in blocks:
        t = np.frombuffer(pa.decompress(row["numbers"], 4 * row["n"], codec="zstd"), "<i4").tolist()
        names = [b"|", *row["names"].split(c._MARK)]
        assert len(row["hashes"]) == 8 * len(names) and row["lang"] == "x" and row["phrase"] is None and row["chunk"] is None
        words += [names[i] for i in t]
    assert len(blocks) > 1 and b" ".join(words) == b"a b | a b | \xc3\xa4 | c | b b | | c |"
