"""The corpus pipeline's stages, each against its own input."""

import random

from corpus_pipeline import STAGES, run

from skyloom.llm import bpe, pii

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(spark, folder):
    r = random.Random(1)
    prose = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(r.randint(30, 60))) + "."
    texts = [prose() for _ in range(120)]
    texts += [" ".join(w + "###" for w in prose().split()) for _ in range(40)]  # junk
    texts += texts[:6] + [texts[6] + " tail", None, ""]  # copies, a near copy, empty ones
    texts += [f"{prose()} mail someone.{i:02d}@mail3.example.com about {prose()}" for i in range(5)]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int(not 120 <= i < 160), 0) for i in range(160) if i % 2]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows


def test_stages(spark, tmp_path):
    folder = str(tmp_path)
    rows = corpus(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = [docs]
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, seen[-1], folder).write.parquet(f"{folder}/stage{i}")
        seen.append(spark.read.parquet(f"{folder}/stage{i}"))
    assert all(df.columns == docs.columns for df in seen[:-1])
    good, unique, private, mixed = ([tuple(r) for r in df.collect()] for df in seen[1:5])
    junk = set(range(120, 160))
    assert not junk & {r[0] for r in good} and len([r for r in good if r[0] < 120]) == 120
    ids = {r[0] for r in unique}
    assert set(range(120)) <= ids and not {160, 161, 162, 163, 164, 165, 166} & ids
    assert {r[0] for r in good if r[1]} - ids == {160, 161, 162, 163, 164, 165, 166}
    before = {r[0]: r[1] for r in unique}
    assert {r[0] for r in private} == ids
    for r in private:
        assert r[4] == (len(r[1]) if r[1] is not None else r[4])
        assert (r[1] == before[r[0]]) == (not pii.entities(before[r[0]]))
    copies = {i: [r[0] for r in mixed].count(i) for i in ids}
    assert max(copies.values()) <= 3 and set(mixed) <= set(private)
    words = lambda rs: sum(len((r[1] or "").split()) for r in rs)
    assert abs(words(mixed) / words(private) - 1) < 0.2
    coder = bpe.encoder(bpe.vocabulary())
    assert sorted((r.doc_id, r.n_tokens) for r in seen[5].collect()) == sorted((r[0], len(coder.encode(r[1]))) for r in mixed)
    assert len(rows) == docs.count() and seen[5].count() == run(spark, folder).count()
