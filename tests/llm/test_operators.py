"""The training-data operators against brute force, round trips and held-out accuracy, with the awkward inputs of each."""

import hashlib
import ipaddress
import random
import re
import time
import zlib
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from skyloom.llm import bpe, common, html_extract, jaccard, language_id, licenses, media, mixing, pii, quality_model, quality_rules

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "alpha beta gamma delta " * 20_000


def frame(spark, texts, extra="", values=()):
    """Documents with ids from 0; a column whose name the operators use themselves is added."""
    rows = [(i, t, "en", "src0" if i % 3 else None, None if t is None else len(t), 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS + ", score int")


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


AWKWARD = [None, "", " \t\n", "one", "two words", LONG, "same text here ok", "same text here ok", "é ß 漢字 🙂", "a\x00b \x1c c"]


# 1: mixing


def waterfill(sizes, weights, cap):
    """Targets by sharing again and again until none is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, target = sum(sizes.values()), set(order), {}
    while open_:
        unit = left / sum(w[s] for s in open_)
        full = {s for s in open_ if unit * w[s] >= cap * sizes[s]}
        if not full:
            return target | {s: unit * w[s] for s in open_}
        for s in full:
            target[s] = float(cap * sizes[s])
        left -= sum(target[s] for s in full)
        open_ -= full
    return target


@pytest.mark.parametrize("seed", range(3))
def test_mixing_targets_and_copies(spark, seed):
    r = random.Random(seed)
    rows = [(i, " ".join("w" * r.randint(0, int(60 * r.random() ** 3) + 1)) if r.random() > 0.05 else None, r.choice([None, "é", "z", "a", "b", "c", "c", "c", "c"])) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mixing_copies(docs).collect()
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len(WORD.findall(text or ""))
    want = waterfill(sizes, (1, 2, 3), 3)
    assert len(out) == len(rows)
    for x in out:
        assert x.size == len(WORD.findall(x.text or "")) and x.source_size == sizes[x.source]
        assert x.target == pytest.approx(want[x.source])
        rate = x.target / x.source_size if x.source_size else 0
        assert int(rate) <= x.copies <= min(3, int(rate) + 1)
    taken = sum(x.copies * x.size for x in out)
    assert taken == pytest.approx(sum(sizes.values()), rel=0.15)
    assert got(mixing.mixing_copies(docs)) == got(mixing.mixing_copies(docs.repartition(3)))


def test_mixing_awkward(spark):
    docs = frame(spark, AWKWARD).withColumnRenamed("score", "size")
    out = mixing.mix_sources(docs)
    assert out.columns == docs.columns
    counted = {r.doc_id: r.copies for r in mixing.mixing_copies(docs).collect()}
    rows = [r.doc_id for r in out.collect()]
    assert {i: rows.count(i) for i in counted} == counted
    assert mixing.mixing_copies(docs.limit(0)).count() == 0
    blank = mixing.mixing_copies(frame(spark, [None, "", None])).collect()
    assert [(x.size, x.target, x.copies) for x in blank] == [(0, 0.0, 0)] * 3


@pytest.mark.parametrize("sizes", [{"a": 1000, "b": 2000, "c": 3000}, {"a": 1000, "b": 2000}, {"a": 10, "b": 20, "c": 3000, "d": 1000, "e": 2000}, {"a": 0, "b": 0, "c": 0}])
def test_mixing_targets_of_tied_sources(spark, sizes):
    rows = [(s, n) for s, n in sizes.items()]
    out = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(rows, "source string, size long")).collect()}
    assert out == pytest.approx(waterfill(sizes, mixing.WEIGHTS, mixing.CAP))
    assert sum(out.values()) == pytest.approx(sum(sizes.values()))


# 2: Jaccard


def components_by_hand(texts, size, num, den):
    sets = []
    for t in texts:
        w = [x.encode().lower().decode() for x in WORD.findall(t or "")]
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(texts)), 2):
        if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return sorted(((i, len(s), find(i)) for i, s in enumerate(sets)), key=repr)


def variants(r, n):
    """Texts that are copies of each other with few or many words changed, short ones included."""
    base = [[r.choice("abcdefghijklmnop") * r.randint(1, 3) for _ in range(r.choice([2, 5, 8, 12, 40, 90]))] for _ in range(6)]
    out = []
    for _ in range(n):
        words = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
            words[r.randrange(len(words))] = "x" + str(r.randint(0, 5))
        if r.random() < 0.3:
            words += [f"tail{r.randint(0, 3)}"] * r.randint(1, 4)
        out.append(" ".join(words).title() if r.random() < 0.2 else "  ".join(words))
    return out


@pytest.mark.parametrize("seed, size, num, share, least", [(1, 3, 90, 16, 4), (2, 5, 80, 1, 3), (3, 1, 50, 1, 3)])
def test_jaccard_is_exact(spark, seed, size, num, share, least):
    texts = [*variants(random.Random(seed), 140), *AWKWARD]
    assert got(jaccard.near_duplicates(frame(spark, texts), size, num, 100, share, least)) == components_by_hand(texts, size, num, 100)


@pytest.mark.parametrize("seed, size, num, crowd", [(11, 3, 90, 1), (12, 5, 80, 2), (13, 1, 50, 1), (14, 2, 60, 3)])
def test_jaccard_pivots_are_exact(spark, monkeypatch, seed, size, num, crowd):
    """Where even few classes count as many, all that is still apart is told by its differences from pivots."""
    monkeypatch.setattr(jaccard, "CROWD", crowd)
    texts = [*variants(random.Random(seed), 140), *AWKWARD]
    assert got(jaccard.near_duplicates(frame(spark, texts), size, num, 100, 1, 3)) == components_by_hand(texts, size, num, 100)


def edited(r, n):
    """Near copies of one text, each with one to seven words changed: many differ too much to be linked with most others."""
    base = [f"w{r.randint(0, 10**6)}" for _ in range(150)]
    out = []
    for _ in range(n):
        words = list(base)
        for at in r.sample(range(150), r.choice([1, 2, 3, 4, 4, 5, 7])):
            words[at] = f"x{r.randint(0, 10**9)}"
        out.append(" ".join(words))
    return out


def test_jaccard_does_not_pair_a_crowd(spark, monkeypatch):
    """Joins of near copies that can't all be linked make rows in proportion to the copies, not to their square."""
    monkeypatch.setattr(jaccard, "CROWD", 64, raising=False)
    made = {}
    for n in (150, 600):
        texts = edited(random.Random(n), n)
        store = spark._jsparkSession.sharedState().statusStore()
        begun = store.executionsCount()
        assert got(jaccard.near_duplicates(frame(spark, texts), 5, 80)) == components_by_hand(texts, 5, 80, 100)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        found = []
        runs = store.executionsList()
        for i in range(runs.size()):
            run = runs.apply(i).executionId()
            if run < begun:
                continue
            values = store.executionMetrics(run)
            nodes = store.planGraph(run).allNodes()
            for node in (nodes.apply(k) for k in range(nodes.size())):
                for m in (node.metrics().apply(k) for k in range(node.metrics().size())) if "Join" in node.name() else ():
                    if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                        found.append((int(values.apply(m.accumulatorId()).replace(",", "")), node.desc()[:150]))
        made[n] = max(found)
    assert made[600][0] <= 6 * made[150][0], made


def test_jaccard_without_broadcasts(spark, monkeypatch):
    """Beyond the size of a broadcast the rows are the same, and no text is shuffled."""
    texts = [*variants(random.Random(9), 120), *AWKWARD]
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    kept = jaccard.keep_one(frame(spark, texts))
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, _, c in sorted(components_by_hand(texts, 5, 80, 100)) if i == c]
    assert "LeftAnti" not in plan and not re.search(r"Exchange hashpartitioning|Exchange rangepartitioning", plan.split("BroadcastExchange")[0])


def test_bloom_filters_are_exact_in_the_end(spark, monkeypatch):
    """A filter of very few words holds many ids by mistake; these stay all the same."""
    docs = spark.range(2000).select(F.when(F.col("id") % 50 == 3, None).otherwise(F.col("id")).alias("doc_id"), F.lit("t").alias("text"))
    gone = spark.range(0, 2000, 7).withColumnRenamed("id", "g")
    want = {i for i in range(2000) if i % 7 and i % 50 != 3}
    monkeypatch.setattr(common, "BLOOM_WORDS", 64)
    every = docs.select("doc_id").where("doc_id IS NOT NULL")
    for rows in (0, 1000, 5000):
        monkeypatch.setattr(common, "BROADCAST_ROWS", rows)
        left = [r.doc_id for r in common.without(docs, "doc_id", gone, every).collect()]
        assert left.count(None) == 40 and set(left) - {None} == want and len(left) == len(want) + 40
        held = {r.doc_id for r in common.may_hold(docs, "doc_id", gone).collect()}
        assert {i for i in range(0, 2000, 7) if i % 50 != 3} <= held and None not in held


def test_jaccard_segments_meet():
    """Any two sets that link share a segment: tried on random sets at the very edge."""
    r = np.random.default_rng(5)
    for num, frequent in ((80, 0), (90, 0), (80, 3), (90, 2), (80, 1)):
        for n in [*range(1, 60), 200, 900]:
            a = np.unique(r.integers(0, 2**63, n, np.uint64))
            cuts = jaccard.Cuts(num, 100, np.sort(a[::frequent]) if frequent else None)
            listed = lambda h: np.concatenate([*cuts.segments(h)[0], *cuts.segments(h)[1]])  # noqa: B023, E731
            most = (100 - num) * 2 * n // (100 + num)
            for cut in {0, most // 2, most}:
                b = np.unique(np.concatenate([a[cut // 2 :], r.integers(0, 2**63, cut - cut // 2, np.uint64)]))
                same = len(np.intersect1d(a, b))
                if len(b) and 100 * same >= num * (len(a) + len(b) - same):
                    assert np.intersect1d(listed(a), listed(b)).size, (num, n, cut)


def test_jaccard_sketches_bound_the_difference():
    r = np.random.default_rng(3)
    cuts = jaccard.Cuts(80, 100)
    for n, m in ((5, 5), (40, 44), (900, 1000), (3000, 3001)):
        a = np.unique(r.integers(0, 2**63, n, np.uint64))
        b = np.unique(np.concatenate([a[: n // 2], r.integers(0, 2**63, m - n // 2, np.uint64)]))
        mine, other = ({g: s for g, s in zip(cuts.groups(len(x)), cuts.sketches(x), strict=True)} for x in (a, b))
        shared = mine.keys() & other.keys()
        assert shared
        for g in shared:
            far = sum(int(x).bit_count() for x in (mine[g] ^ other[g]).view(np.uint64))
            assert 0 < far <= len(np.setxor1d(a, b))


def test_short_shuffles_put_the_setting_back(spark):
    was = spark.conf.get(common.CLEAN_SHUFFLES, None)
    with pytest.raises(ZeroDivisionError), common.short_shuffles(spark):
        assert spark.conf.get(common.CLEAN_SHUFFLES) == "true"
        df = spark.range(1000).groupBy(F.col("id") % 7).count()
        assert len(df.collect()) == len(df.collect()) == 7
        1 / 0
    assert spark.conf.get(common.CLEAN_SHUFFLES, None) == was


def test_jaccard_keeps_one(spark):
    texts = ["a b c d e f g", None, "q r s t u v w", "a b c d e f g", "", "A B C D E F G"]
    docs = frame(spark, texts)
    assert sorted(x.doc_id for x in jaccard.keep_one(docs).collect()) == [0, 1, 2, 4]
    assert sorted(x.doc_id for x in jaccard.keep_one(docs.union(docs)).collect()) == [0, 1, 2, 4]
    assert jaccard.near_duplicates(docs.limit(0)).count() == 0
    without_id = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (None, None)], "doc_id long, text string")
    assert got(jaccard.near_duplicates(without_id)) == sorted([(None, 2, 4), (4, 2, 4), (None, 0, None)], key=repr)


def test_jaccard_links_rows_without_ids(spark):
    w = [f"w{i}" for i in range(60)]
    texts = [(7, w[:50]), (None, w[2:52]), (None, w[2:52]), (9, w[4:54]), (None, w[:10][::-1])]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in texts], "doc_id long, text string")
    out = got(jaccard.near_duplicates(docs, 3, 90, 100))
    assert out == sorted([(7, 48, 7), (None, 48, 7), (None, 48, 7), (9, 48, 7), (None, 8, None)], key=repr)


def test_jaccard_keeps_texts_that_share_an_id(spark):
    rows = [(1, "a b c d e f g"), (1, "q r s t u v w"), (2, "A b c d e f g"), (2, "k l m n o p q"), (3, "one"), (3, None), (3, None), (3, ""), (4, "two"), (None, "two"), (None, "two"), (5, "one"), (3, "One")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [(i, t and t.lower()) for i, t in got(jaccard.keep_one(docs))]
    want = [(1, "a b c d e f g"), (1, "q r s t u v w"), (2, "k l m n o p q"), (3, "one"), (3, None), (3, ""), (4, "two"), (None, "two"), (None, "two")]
    assert sorted(kept, key=repr) == sorted(want, key=repr)


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 160)] + [(7, 7), (1, 0)]
    out = common.components(spark.createDataFrame(edges, "a long, b long"))
    want = [(i, 0) for i in range(31)] + [(i, 100) for i in range(100, 160)]
    assert sorted(map(tuple, out.collect())) == sorted(want)


# 3: quality rules


def rules_by_hand(text):
    text = text or ""
    words = WORD.findall(text)
    windows = {}
    for i in range(len(words) - 4):
        windows.setdefault(tuple(words[i : i + 5]), []).append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_quality_rules_base(spark):
    r = random.Random(4)
    texts = [*AWKWARD, *["".join(r.choice(["ab ", "c ", "d ", "é\n", "\t", "# ", "x y z w v "]) for _ in range(r.randint(1, 80))) for _ in range(60)]]
    out = {x.doc_id: x for x in quality_rules.judge(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        x = out[i]
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == rules_by_hand(t), t
        assert x.base_failed == (x.n_words < 10 or 100 * x.n_repeat_words > 20 * x.n_words)
        assert not (x.base_failed and x.kept)


def test_quality_rules_lines(spark):
    good = "This is a line of ordinary prose that ends as it should.\nAnd here is one more of them, with a comma.\nThe third line tells a little more, and then the text is over."
    texts = [good, good + "\nhome | about | news | contact | help\nWe use cookies. Privacy policy.", "a | b | c | d | e | f | g | h | i | j | k | l\nq", "WHAT!! NOW!! YES!! NO!! ONE!! TWO!! THREE!! FOUR!! FIVE!! SIX!!"]
    rows = quality_rules.judge(frame(spark, texts)).orderBy("doc_id").collect()
    assert [x.kept for x in rows] == [True, True, False, False]
    assert rows[0].clean_text == good and rows[1].clean_text == good
    assert quality_rules.clean(frame(spark, texts)).count() == 2
    assert quality_rules.judge(frame(spark, texts).limit(0)).count() == 0


def test_quality_rules_boilerplate_in_four_languages(spark):
    lines = ["Accepter les cookies", "Tous droits réservés", "Lire la suite", "Alle Rechte vorbehalten", "Datenschutzerklärung und Impressum", "Weiterlesen", "Aceptar todas las cookies", "Política de privacidad", "Leer más", "Read more", "Accept all cookies"]
    prose = ["Il a fermé la porte sans dire un mot.", "Sie ging langsam durch den alten Garten.", "La casa estaba vacía desde hacía años.", "He walked along the river for an hour."]
    docs = spark.createDataFrame([(0, "\n".join([*lines, *prose]))], "doc_id long, text string")
    assert quality_rules.judge(docs).first().clean_text.split("\n") == prose


# 4: language


def test_language_held_out(spark):
    r = random.Random(2)
    syllables = {"aa": "ka lo mi ren tu".split(), "bb": "schi wöl dar eng pf".split(), "cc": "ção nh lha õe gui".split()}
    word = lambda s: "".join(r.choice(s) for _ in range(r.randint(1, 3)))
    rows = []
    for i in range(240):
        lang = r.choice(list(syllables))
        rows.append((i, " ".join(word(syllables[lang]) for _ in range(r.randint(15, 60))), lang if r.random() > 0.1 else None))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.learn(docs.where("doc_id % 4 <> 0"))
    assert model.languages == ["aa", "bb", "cc"]
    pred = {x.doc_id: x for x in language_id.predict(docs, model).collect()}
    held = [(i, lang) for i, _, lang in rows if i % 4 == 0 and lang]
    assert np.mean([pred[i].lang_pred == lang for i, lang in held]) > 0.95
    assert all(0 <= x.score <= 1 for x in pred.values())


def test_language_awkward(spark):
    docs = frame(spark, [*AWKWARD, "123 456 !!"])
    out = {x.doc_id: x.lang_pred for x in language_id.predict(docs, language_id.learn(docs)).collect()}
    assert [out[i] for i in (0, 1, 2, 10)] == ["und"] * 4 and out[3] == "en" and out[8] == "en"
    assert language_id.learn(docs.limit(0)) is None
    assert {x.lang_pred for x in language_id.predict(docs, None).collect()} == {"und"}


def test_language_vector_is_the_bundle():
    bundle = language_id.Bundler(64)
    total, letters = bundle(["Ab a", "", "12"])
    v = lambda c, place: np.roll(bundle.letter(ord(c)).astype(int), place)
    want = sum(np.prod([v(c, i) for i, c in enumerate(g)], axis=0) for g in (" ab", "ab ", "b a", " a "))
    assert letters.tolist() == [True, False, False] and np.array_equal(total[0], want)


# 5: BPE


def test_bpe_is_the_library(spark):
    library = Tokenizer.from_file(bpe.vocabulary())
    r = random.Random(3)
    letters = "ab'stred lvmÉ éßñ  \t\n\xa0　日本0123½²Ⅷ<|>endoftext'ſİǅ#$%%é́̂ﬁ🙂👍🏽\x00\x85\x1c​"
    texts = [*AWKWARD, "<|endoftext|> x", "don't we'll I'M", *["".join(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(400)]]
    out = {x.doc_id: x for x in bpe.round_trip_digest(frame(spark, texts), bpe.vocabulary()).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert out[i].n_tokens == len(ids), t
        assert out[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), t
        assert out[i].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest(), t
    encoded = bpe.encode_texts(frame(spark, texts), bpe.vocabulary())
    assert bpe.decode_ids(encoded, bpe.vocabulary()).count() == len(texts)
    assert bpe.encode_texts(frame(spark, texts).limit(0), bpe.vocabulary()).count() == 0


def test_bpe_cuts_are_never_inside_a_token():
    coder = bpe.encoder(bpe.vocabulary())
    tokens = [t.removesuffix(coder.suffix) for t in coder.vocab if len(t) > 6]
    assert all(len(coder.fragments(t)) == 1 for t in tokens[:5000])
    assert any(len(coder.fragments(w)) > 1 for w in ("zqxjk", "thwvxq"))


# 6: personal data


def test_pii_surrogates(spark):
    mail, card, phone, ip, key = "ann.lee42@mail7.example.com", "4111 1111 1111 1111", "+1 (017) 555-7713", "97.51.17.173", "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    prose = "The secret is understanding, a token: nothing more; the password is, well, forgotten."
    assert pii.entities(prose) == [] and [e[3] for e in pii.entities('password is hunter2222, api_key="abcdefghij"')] == ["hunter2222", "abcdefghij"]
    littered = 'token### =%%% "04dbebab91ab85687d33eeaaf9ac699e1188f962"*** +1$$$ (017)&&& 555-7713###'
    assert [e[2] for e in pii.entities(littered)] == ["secret", "phone"]
    texts = [f'Write {mail} or {mail.upper()}, pay {card}.', f'Call {phone}, {ip}, token = "{key}". {mail}', "No data here, only 12 words and 3.14.", None, "", "Dear Mrs. Anna Schmidt, meet Paul Weber and госпожа. Господин Иван Петров."]
    docs = frame(spark, texts).withColumnRenamed("score", "n_entities")
    out = {x.doc_id: x for x in pii.pseudonymise(docs).collect()}
    for secret in (mail, card, phone, ip, key):
        assert all(secret not in (x.text or "") for x in out.values())
    new = re.search(r"Write (\S+) or (\S+),", out[0].text)
    assert new[2].lower() == new[1] and new[1] in out[1].text and new[1].endswith(".com")
    number = re.search(r"pay ([\d ]+)\.", out[0].text)[1]
    digits = number.replace(" ", "")
    assert re.fullmatch(r"\d{4} \d{4} \d{4} \d{4}", number) and pii._luhn(digits[:-1]) == int(digits[-1])
    assert re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}, \d+\.\d+\.\d+\.\d+, token = \"[0-9a-f]{40}\"", out[1].text)
    assert out[2].text == texts[2] and out[3].text is None and out[4].text == ""
    first, second = re.match(r"Dear Mrs\. (\S+) \S+, meet (\S+) \S+ and", out[5].text).groups()
    assert first in pii.GIVEN["latin", "f"] and second in pii.GIVEN["latin", "m"]
    assert re.search(r"Господин (\S+) ", out[5].text)[1] in pii.GIVEN["cyrillic", "m"]
    assert pii.pseudonymise(docs.limit(0)).count() == 0


def test_pii_keeps_entities_apart(spark):
    values = [f"{a}{b}.{i:02d}@x.com" for i in range(40) for a in "ab" for b in "cd"]
    docs = frame(spark, [f"mail {v} now" for v in values] + ["mail ac.00@x.com now"])
    out = {x.doc_id: x.text.split()[1] for x in pii.pseudonymise(docs).collect()}
    assert len({out[i] for i in range(len(values))}) == len(values) and out[len(values)] == out[0]
    assert not set(out.values()) & set(values)


def test_pii_collisions_are_drawn_again(spark):
    names = [("name-f", f"Anna {s}") for s in ("Aaa", "Bbb")] + [("email", f"{a}@{d}.co") for d in "abcdefghijklmnopqrstuvwxyz" for a in "abcdefghijklmnopqrstuvwxyz"]
    found = spark.createDataFrame(names, "kind string, value string")
    later = {(r.kind, r.value): r.attempt for r in pii.collisions(found).collect()}
    made = [pii.surrogate(k, v, pii.KEY, later.get((k, v), 0)) for k, v in names if k != "email"]
    assert len(set(made)) == len(made)
    short = [pii.surrogate(k, v, pii.KEY, later.get((k, v), 0)) for k, v in names if k == "email"]
    assert len(later) > 0 and len(set(short)) == 26 * 26 and not {k for _, k in names} & {*short, *made}


def test_pii_people_keep_one_surrogate():
    text = "Mrs. Anna Schmidt met Dr. Schmidt and John  Smith. ANNA SCHMIDT, Schmidt, Ms Wei Zhang. My name is Wei Zhang; Zhang left. José García. Smithers, Schmidtke."
    out, n = pii._replace(text, {}, pii.KEY, {})
    x = re.fullmatch(r"Mrs\. (\w+) (\w+) met Dr\. (\w+) and (\w+)  (\w+)\. (\w+) (\w+), (\w+), Ms (\w+) (\w+)\. My name is (\w+) (\w+); (\w+) left\. (\w+) (\w+)\. Smithers, Schmidtke\.", out).groups()
    assert x[1] == x[2] == x[7] and x[5:7] == (x[0].upper(), x[1].upper()) and x[8:10] == x[10:12] and x[9] == x[12] and n == 15
    assert x[0] in pii.GIVEN["latin", "f"] and x[3] in pii.GIVEN["latin", "m"] and x[13] in pii.GIVEN["latin", "m"]
    assert not {"Anna", "Schmidt", "John", "Smith", "Wei", "Zhang", "José", "García"} & set(x)


def test_pii_spellings_of_one_number():
    cards = ["4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111111"]
    out = [pii.surrogate("card", c) for c in cards]
    assert len({pii._canonical("card", x) for x in out}) == 1 and [re.sub(r"\d", "0", x) for x in out] == [re.sub(r"\d", "0", c) for c in cards]
    phones = ["+44 20 7946 0958", "+44 (20) 7946-0958", "+442079460958"]
    out = [pii.surrogate("phone", c) for c in phones]
    assert len({pii._canonical("phone", x) for x in out}) == 1 and all(x.startswith("+44") for x in out)
    assert [e[3] for e in pii.entities("office 020 7946 0958, call me on 555-0123; years 1990-2005, 300-4000 units")] == ["020 7946 0958", "555-0123"]


@pytest.mark.parametrize("kind, values", [("email", [f"{a}{b}@c.de" for a in "abcdefghijklmnopqrstuvwxyz" for b in "0123456789"]), ("name", [a + b for a in "ABCDEFGH" for b in "aeiouy"]), ("phone", [f"+44 {i:03d}" for i in range(1000)]), ("given-f", pii.GIVEN["latin", "f"])])
def test_pii_forms_are_permuted(kind, values):
    """Values of one form have surrogates of that form, all different."""
    made = [pii.surrogate(kind, v) for v in values]
    assert len(set(made)) == len(values) and {len(m) for m in made} == {len(v) for v in values} or kind == "given-f"
    assert len(set(made)) == len(values)


@pytest.mark.parametrize("rows", [200_000, 0])
def test_pii_against_plain_replacement(spark, monkeypatch, rows):
    """Texts are what replacing span by span with the corpus' own draws gives; with more draws than are broadcast too."""
    monkeypatch.setattr(pii, "BROADCAST_ROWS", rows)
    r = random.Random(8)
    people = ["Mrs Anna", "Dr. Ab", "Dr. Eb", "Frau Ob", "Paul Ib", "a@b.co", "B@b.co", "c@b.co", "x y", "token: 'abcd1234'", "+1 22 33 44", "10.0.0.1"]
    texts = [" ".join(f"{r.choice(people)}," for _ in range(r.randint(1, 6))) for _ in range(60)] + [*AWKWARD, "mail a@b.co " * 5000] + [f"Mrs {g} Ab" for g in pii.GIVEN["latin", "f"]]
    docs = frame(spark, [*texts, *texts[:10]])
    draws = {(x.kind, x.value): x.attempt for x in pii.collisions(pii.found_entities(docs)).collect()}
    assert draws
    mapped = {}
    for x in pii.pseudonymise(docs).collect():
        t = ([*texts, *texts[:10]])[x.doc_id]
        want, at, spans = "", 0, pii.entities(t)
        for a, b, kind, value in spans:
            made = pii.surrogate(kind, value, pii.KEY, draws.get((kind, pii._canonical(kind, value)), 0))
            want, at = want + t[at:a] + made, b
            mapped.setdefault((kind, pii._canonical(kind, value)), set()).add(pii._canonical(kind, made))
        assert x.text == (None if t is None else want + t[at:]) and x.n_entities == len(spans)
    assert all(len(m) == 1 for m in mapped.values())
    made = [m for v in mapped.values() for m in v]
    assert len(set(made)) == len(made) and not set(made) & {v for _, v in mapped}


def test_pii_collisions_are_settled_in_full_spaces(spark):
    boxes = [f"{a}@{d}.co" for d in "bc" for a in "abcdefghijklmnopqrstuvwxyz"]
    given = pii.GIVEN["latin", "f"]
    marks = ["--------", "-------1", "-------2"]
    texts = [f"mail {b} now" for b in boxes] + [f"dear Mrs {g}, hello" for g in given] + [f'password="{m}" 1' for m in marks] + [f"MAIL {boxes[0].upper()} NOW"]
    out = {x.doc_id: x.text for x in pii.pseudonymise(frame(spark, texts)).collect()}
    made = [out[i].split()[1] for i in range(len(boxes))] + [re.search("Mrs (.*),", out[i])[1] for i in range(len(boxes), len(boxes) + len(given))]
    made += [re.search('"(.*)"', out[i])[1] for i in range(len(made), len(made) + len(marks))]
    assert len(set(made)) == len(made) and not set(made) & {*boxes, *given, *marks}
    assert out[len(texts) - 1] == f"MAIL {made[0].upper()} NOW"
    assert all(m.split("-")[0] in given for m in made[len(boxes) : len(boxes) + len(given)])


def test_pii_late_draws_are_longer():
    for kind, value in (("phone", "+352 12 34"), ("ssn", "123-45-6789"), ("email", "a@b.co"), ("name-f", "Anna"), ("secret", "--------")):
        late = [pii.surrogate(kind, value, pii.KEY, pii.ROUNDS + n) for n in range(5)]
        assert len(late[0]) == len(value) or kind.startswith("name")
        assert len(set(late)) == 5 and len(late[4]) > len(late[1]) > len(value)
    late = {pii.surrogate("phone", f"+352 {i // 100:02d} {i % 100:02d}", pii.KEY, pii.ROUNDS + 2) for i in range(10_000)}
    assert len(late) == 10_000 and all(re.fullmatch(r"\+352 \d\d \d{4}", x) for x in late)


@pytest.mark.parametrize(
    ("text", "values"),
    [
        ("host 2001:db8::1, and 2001:0db8:0:0:0:0:0:1 too", ["2001:db8::1", "2001:0db8:0:0:0:0:0:1"]),
        ("at 12:30:45 in std::vector, a::b, dead::beef, 1:2:3", []),
        ("passport C01X00T47; Passport No: AB1234567; pass the passport Please", ["C01X00T47", "AB1234567"]),
        ("Bye.\nBest regards,\nOlaf Scholz\nwith Scholz's car", ["Olaf", "Scholz", "Scholz"]),
        ("Kind regards,\nThe Team\n", []),
        ("From: Priya Patel <p@x.org>, Customer Support <help@x.org>", ["Priya", "Patel", "p@x.org", "help@x.org"]),
    ],
)
def test_pii_found_by_context(text, values):
    found = pii.entities(text)
    assert [v for *_, v in found] == values and all(text[a:b] == v for a, b, _, v in found)
    out = pii._replace(text, {}, pii.KEY, {})[0]
    assert not any(v in out for v in values)


def test_pii_addresses_of_six():
    """One address in two spellings is one entity; surrogates are addresses of the same form, distinct, and late ones are spelt out."""
    out = pii._replace("host 2001:db8::1, and 2001:0db8:0:0:0:0:0:1 too, FE80::AB1", {}, pii.KEY, {})[0]
    one, two, big = re.findall(r"[0-9A-Fa-f]*:[0-9A-Fa-f:]*", out)
    assert one == two and re.fullmatch("2[0-9a-f]{3}:[1-9a-f][0-9a-f]{2}::[1-9a-f]", one) and re.fullmatch("F[0-9A-F]{3}::[0-9A-F]{3}", big)
    made = {pii.surrogate("ipv6", f"2001::{i:x}:0:5") for i in range(1, 3000)}
    assert len(made) == 2999 and all(str(ipaddress.IPv6Address(x)) == x and x.split(":")[-2] == "0" for x in made)
    assert len(pii.surrogate("ipv6", "1::2:3", attempt=pii.ROUNDS + 1)) == 39


@pytest.mark.parametrize("rows", [common.BROADCAST_ROWS, 0])
def test_columns_with_clashing_names_pass_through(spark, monkeypatch, rows):
    monkeypatch.setattr(common, "BROADCAST_ROWS", rows)
    monkeypatch.setattr(pii, "BROADCAST_ROWS", rows)
    names = ["_row", "_LATER", "_hit", "_word", "_bits", "_id", "_k", "_least", "_group", "_gone", "_kept", "_stays", "kind", "value"]
    copies = "one two three four five six seven"
    texts = [(1, copies), (2, copies), (3, "mail a@b.co, Mrs Alice Miller"), (3, "another text of the same id, long enough"), (4, None), (5, "")]
    docs = spark.createDataFrame([(i, t, *[f"{n}{i}" for n in names]) for i, t in texts], "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    kept = jaccard.keep_one(docs).collect()
    assert sorted(r.doc_id for r in kept) == [1, 3, 3, 4, 5] and all(r[n] == f"{n}{r.doc_id}" for r in kept for n in names)
    out = pii.pseudonymise(docs)
    assert out.columns == [*docs.columns, "n_entities"] and all(r[n] == f"{n}{r.doc_id}" for r in out.collect() for n in names)
    gone = spark.createDataFrame([(1,), (5,)], "g long")
    left = common.without(docs, "doc_id", gone, docs.select("doc_id")).collect()
    assert sorted(r.doc_id for r in left) == [2, 3, 3, 4] and all(r[n] == f"{n}{r.doc_id}" for r in left for n in names)


@pytest.mark.parametrize("size", [10, 97, 1000])
def test_pii_permutation(size):
    assert sorted(pii.permute(i, size, b"k") for i in range(size)) == list(range(size))


# 7: licences


def test_license_base_by_hand(spark):
    r = random.Random(9)
    parts = ["cc", "by", "CC-BY", "general public license", "All rights reserved", "license", "é", "x_y", ".", "rights", "\n", "general", "public"]
    texts = [*AWKWARD, *[" ".join(r.choice(parts) for _ in range(r.randint(0, 60))) for _ in range(150)]]
    out = {x.doc_id: x for x in licenses.scan_licenses(frame(spark, texts)).collect()}
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for i, t in enumerate(texts):
        w = word.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
        places = [(k, label) for p, label in licenses.BASE.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        x = out[i]
        assert (x.n_words, x.n_base) == (len(w), len(places))
        assert (x.first_word, x.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert x.base_labels == ",".join(sorted({label for _, label in places}))
        assert set(x.base_labels.split(",")) <= set(x.labels.split(",")) | {""} and 0 <= x.score <= 1
    assert licenses.scan_licenses(frame(spark, texts).limit(0)).count() == 0


def test_license_automaton_matches_by_hand():
    r = random.Random(1)
    sequences = [[r.randint(0, 3) for _ in range(r.randint(3, 15))] for _ in range(5)]
    auto = licenses.Automaton(sequences)
    inside = {tuple(s[i:j]) for s in sequences for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    run = [r.randint(0, 3) for _ in range(200)]
    longest = [max(k for k in range(i + 1) if k == 0 or tuple(run[i - k : i]) in inside) for i in range(1, len(run) + 1)]
    want = [(i + 1, n) for i, n in enumerate(longest) if n >= licenses.MIN_MATCH and (i + 1 == len(longest) or longest[i + 1] <= n)]
    assert [(e, n) for e, n, _ in auto.matches(run, 0)] == want


def test_license_templates_with_changes():
    scan = licenses.scanner()
    apache = next(t for label, t in licenses.TEMPLATES if label == "apache-2.0" and len(t) > 100)
    words = apache.split()
    words[20] = "oddword"
    assert scan("x y z " + " ".join(words) + " and so on")[5] == "apache-2.0"
    assert scan("Released under the MIT License.")[5] == "mit"
    assert scan(" ".join(words[:15]))[5] == ""
    assert scan("x y z " + " ".join(words) + " and so on")[7] == f"apache-2.0:3-{3 + len(words)}"


def test_license_best_chains_by_brute_force(monkeypatch):
    """Small random automata: for each end of a match, the best of all chains that end there."""
    monkeypatch.setattr(licenses, "COVERED", 0)
    r = random.Random(2)
    for _ in range(60):
        scan = object.__new__(licenses.Scanner)
        sequences = [[r.randint(0, 4) for _ in range(r.randint(6, 14))] for _ in range(3)]
        scan.sizes, scan.automaton = [len(x) for x in sequences], licenses.Automaton(sequences)
        run = [w for _ in range(3) for w in (lambda x, i: x[i : i + r.randint(3, 7)])(r.choice(sequences), r.randint(0, 6)) + [r.randint(0, 4)] * r.randint(0, 4)]
        matches = scan.automaton.matches(run, 0)
        nodes = [(end, size, t, at) for end, size, _ in matches for t, x in enumerate(sequences) for at in range(size, len(x) + 1) if x[at - size : at] == run[end - size : end]]

        def best(node):
            end, size, t, at = node
            before = [n for n in nodes if n[2] == t and n[0] < end and n[3] < at and n[0] + licenses.MAX_GAP >= end - size]
            return max([(size, end - size), *((c + size - max(0, n[3] - at + size, n[0] - end + size), first) for n in before for c, first in [best(n)])])

        want = {}
        for node in nodes:
            key = node[0], node[2]
            want[key] = max(want.get(key, (0, 0)), best(node))
        assert {(end, t): (covered, start) for covered, start, end, t in scan.chains(matches)} == want


def test_license_settled_chains_by_brute_force():
    r = random.Random(3)
    scan = object.__new__(licenses.Scanner)
    scan.sizes = [40, 60, 90]
    for _ in range(200):
        chains = [(r.randint(1, n), a, a + n, r.randint(0, 2)) for n, a in ((r.randint(1, 40), r.randint(0, 150)) for _ in range(r.randint(0, 40)))]
        kept = []
        for c in sorted(chains, key=lambda c: (-c[0], -c[0] / scan.sizes[c[3]], c[2] - c[1], c[1], c[3])):
            if all(2 * len(set(range(c[1], c[2])) & set(range(k[1], k[2]))) <= c[2] - c[1] for k in kept):
                kept.append(c)
        assert sorted(scan.settled(chains)) == sorted(kept)


@pytest.mark.parametrize(
    ("text", "label"),
    [
        ("SPDX-License-Identifier: Apache-2.0", "apache-2.0"),
        ("// SPDX-License-Identifier: GPL-2.0-or-later", "gpl-2.0"),
        ("Released under MIT license", "mit"),
        ("CC BY-NC-SA 4.0", "cc-by,cc-by-nc-sa-4.0"),
        ("a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", "cc-by-nc-sa-4.0"),
        ("a Creative Commons Attribution-Share Alike 3.0 Unported License.", "cc-by-sa-3.0"),
        ("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "mit"),
    ],
)
def test_license_short_forms(text, label):
    assert licenses.scanner()(f"so: {text} and so on")[5] == label


def test_license_versions_and_clauses_give_way():
    """Notices that differ in a word or a clause: only the one that covers more stands, and each of two in one text is found."""
    scan = licenses.scanner()
    of = {label: text for label, text in licenses.NOTICES if label in ("gpl-2.0", "bsd-2-clause", "bsd-3-clause", "agpl-3.0")}
    third = next(t for label, t in licenses.NOTICES if label == "gpl-3.0" and len(t) > 100)
    assert scan(third)[5] == "gpl,gpl-3.0" and scan(of["gpl-2.0"])[5] == "gpl,gpl-2.0"
    assert scan(f"{third} {'word ' * 20} {of['gpl-2.0']}")[5] == "gpl,gpl-2.0,gpl-3.0"
    assert scan(of["bsd-2-clause"])[5] == "bsd-2-clause" and scan(of["bsd-3-clause"])[5] == "bsd-3-clause"


def test_license_full_notices_are_told_apart():
    """Every template is found in a text of its own with its span, and none of the others that are no part of it."""
    scan = licenses.scanner()
    for label, text in licenses.TEMPLATES:
        found = scan(f"{'filler ' * 5}{text} {'end ' * 5}")
        assert f"{label}:5-{5 + len(text.split())}" in found[7].split(","), label
    lesser = next(t for label, t in licenses.TEMPLATES if label == "lgpl-3.0")
    assert scan(lesser)[7].split(",")[-1].startswith("lgpl-3.0:0-")


# 8: pages


def test_html_main_text(spark):
    long = "Some words of a story, told at length, so that it scores. " * 3
    page = f"""<html><head><title>T</title><script>var x="</p>"</script></head><body><nav><a href=x>menu, menu, menu, menu, menu, menu</a></nav>
    <div class="cookie-notice"><p>{long}</p></div><div id="content"><h1>Head &amp; line</h1><p>{long}&eacute; <b>bold<br>next</b><p>unclosed,
    and more words that go on for a while here<ul><li>item one</ul></div><div class="comments"><p>{long}</p></div><footer>foot</footer>"""
    want = "\n".join(["Head & line", " ".join(long.split()) + " é bold next", "unclosed, and more words that go on for a while here", "item one"])
    assert html_extract.main_text(page) == want
    rows = [(1, "u", page), (2, None, None), (3, "v", ""), (4, "w", "<nav>menu</nav>"), (5, "x", "<p>a < b"), (6, "y", "<article>short</article>"), (1, "u", page)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, text int")
    out = [(x.page_id, x.text, x.n_chars) for x in html_extract.extract_pages(pages).collect()]
    assert sorted(out)[:2] == [(1, want, len(want))] * 2 and (2, "", 0) in out and (3, "", 0) in out and (4, "", 0) in out and (6, "short", 5) in out
    framed = f'<body><header><p>{long}</p></header><div class="with-sidebar"><article><h1>A</h1><p>{long}</p></article><ul class="commentlist"><li><article class="comment"><p>{long}</p></article></ul></div></body>'
    assert html_extract.main_text(framed) == "A\n" + " ".join(long.split())
    assert html_extract.main_text("<div>" * 20_000 + "deep " * 30)


def test_html_keeps_what_stands_beside_the_container():
    long = " ".join(["Some words of a story, told at length, so that it scores."] * 40)
    links = "".join(f"<li><a href=x>Another story, number {i}, with a long title</a></li>" for i in range(9))
    page = f"""<body><nav>menu</nav><div id="post"><h1><a href=self>Head</a></h1>Bare <b>text</b> with <a href=x>a link</a>.<p>By one.</p>
    <div class="body"><p>{long}</p><p>{long}</p></div><h2>Later</h2><div><p>A short section.</p></div><p>So it ends.</p>
    <ul>{links}</ul><a href=x>Next</a> | <a href=x>Last</a><p class="promo">Buy</p></div><footer>foot</footer>"""
    want = ["Head", "Bare text with a link.", "By one.", long, long, "Later", "A short section.", "So it ends."]
    assert html_extract.main_text(page).split("\n") == want
    parts = f"<main><article><p>{long}</p></article><article><p>Short end.</p></article></main>"
    assert html_extract.main_text(parts).split("\n")[-2:] == [long, "Short end."]


def test_html_keeps_the_whole_of_the_container():
    long = " ".join(["Some words of a story, told at length, so that it scores."] * 5)
    body = f"<p>{long}</p><p>{long}</p>"
    pages = {
        f"<div id=wrap><h1>Title</h1><div class=body>{body}</div></div>": ["Title", long, long],
        f"<div><h1>T</h1><p>By A. Author</p><div>{body}</div><p>Short end.</p></div>": ["T", "By A. Author", long, long, "Short end."],
        f"<div><section>{body}</section><section><h2>Two</h2><p>Short.</p></section></div>": [long, long, "Two", "Short."],
        f'<div class="story-share"><p>{long}</p></div>': [long],
        f'<div class="comments"><p>{long}</p></div>': [""],
    }
    for page, want in pages.items():
        assert html_extract.main_text(page).split("\n") == want


def test_html_story_from_headline_to_end():
    """The way up to the headline, several articles in a page, comments and notices with articles in them."""
    long = " ".join(["Some words of a story, told at length, so that it scores."] * 6)
    other = " ".join(["Another thing was said, by others, in a different place."] * 4)
    body, second = f"<p>{long}</p>", f"<h3>Other</h3><p>{other}</p>"
    pages = {
        f"<main><h1>Head</h1><p>By A</p><article>{body}</article></main>": ["Head", "By A", long],
        f"<div id=logo>Site</div><div id=wrap><div class=intro><h1>Head</h1><p>Lead text.</p></div><div class=content><div class=text>{body}{body}</div></div><p>End.</p></div><div>bottom</div>": ["Head", "Lead text.", long, long, "End."],
        f"<article><div class=hd><h1>T</h1></div><div class=bd><div class=text>{body}{body}</div><p>x</p></div><p>note</p></article>": ["T", long, long, "x", "note"],
        f"<div class=post>{body}</div><section id=comments><article><p>{other}</p></article></section>": [long],
        f"<div class=post><h1>A</h1>{body}</div><section id=comments><article><h4>Bob</h4><p>{other}{other}</p></article></section>": ["A", long],
        f"<article>{body}</article><article>{second}</article>": [long],
        f"<main><article><h1>T</h1>{body}</article><article>{second}</article><article>{second}</article></main>": ["T", long],
        f"<div id=w><div class=story><h1>T</h1>{body}{body}</div><section class=more><article>{second}</article></section></div>": ["T", long, long],
        f"<main><h1>T</h1>{body}</main><div class=sidebar><article>{second}</article></div>": ["T", long],
        f"<div class=post>{body}</div><div class=copyright>(c) 2024 X All rights reserved</div>": [long],
    }
    for page, want in pages.items():
        assert html_extract.main_text(page).split("\n") == want, page


@pytest.mark.parametrize("page", ["<div>text words here, and more of them, so that it scores" * 20_000, "<p><td>" + "<span>" * 20_000 + "<div></div>" * 20_000, "<div>" * 50_000 + "</b>" * 50_000, "<li><ul>" + "<div>" * 20_000 + "<li></li>" * 20_000, "<header>" * 20_000 + "x" * 40, "word " * 500_000, "<article>" * 20_000 + "text words " * 9, "<div class=sidebar><article>" * 20_000 + "x" * 50])
def test_html_time_is_linear_in_depth_and_width(page):
    began = time.process_time()
    html_extract.main_text(page)
    assert time.process_time() - began < 15


def test_html_of_known_articles():
    """Random pages whose article is known by construction."""
    r = random.Random(6)
    words = lambda n: " ".join(r.choice("river stone light after before, under while often, small gold".split()) for _ in range(n))
    for _ in range(60):
        blocks, parts = [], []
        for _ in range(r.randint(3, 9)):
            kind, text = r.choice(["p", "p", "p", "h2", "blockquote", "li"]), words(r.randint(4, 60))
            blocks.append(text)
            if kind == "p" and r.random() < 0.4:
                cut = r.randint(1, 3)
                text = " ".join(text.split()[:cut]) + r.choice([" <b>", " <i>", '\n<span class="x">']) + " ".join(text.split()[cut:]) + r.choice(["</b>", "</i>", "</span>", ""])
            parts.append(f"<ul><li>{text}</ul>" if kind == "li" else f"<{kind}>{text}" + r.choice(["", f"</{kind}>"] if kind == "p" else [f"</{kind}>"]))
        blocks.append(words(80)), parts.append(f"<p>{blocks[-1]}</p>")
        frame_ = r.choice(["article", "main", "div class=content", "div", "section id=story"])
        story = f"<{frame_}><h1>Head &amp; more</h1>{''.join(parts)}</{frame_.split()[0]}>"
        around = [f"<nav><ul><li><a href=/>{words(5)}</a></ul></nav>", f'<div class="sidebar"><p>{words(50)}</p></div>', f"<footer><p>{words(30)}</p></footer>", f"<form>{words(9)}</form>", f"<script>var a = '<p>{words(40)}</p>'</script>", f'<div id="comments"><p>{words(40)}</p></div>', f"<!-- <p>{words(40)}</p> -->", f'<aside>{words(40)}</aside>']
        r.shuffle(around)
        cut = r.randint(0, len(around))
        page = f"<html><body>{''.join(around[:cut])}{story}{''.join(around[cut:])}</body></html>"
        assert html_extract.main_text(page).split("\n") == ["Head & more", *(" ".join(b.split()) for b in blocks)], page


# 9: quality classifier


def test_quality_model_held_out(spark):
    r = random.Random(8)
    rows = []
    for i in range(500):
        good = r.random() < 0.7
        words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(r.randint(10, 60))]
        rows.append((i, " ".join(words) + "." if good else " ".join(w + r.choice(["###", "%%%", "!!"]) for w in words), int(good)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows if i % 3], "doc_id long, label int")
    model = quality_model.fit(docs, labels)
    scored = {x.doc_id: x.score for x in quality_model.score(docs, model).collect()}
    held = [(scored[i], q) for i, _, q in rows if i % 3 == 0]
    assert np.mean([(s >= 0.5) == q for s, q in held]) > 0.97 and all(0 <= s <= 1 for s, _ in held)
    awkward = frame(spark, AWKWARD)
    assert quality_model.score(awkward, model).count() == len(AWKWARD)
    kept = quality_model.keep_good(awkward, model)
    assert kept.columns == awkward.columns
    assert quality_model.fit(docs, labels.limit(0)) is None
    assert {x.score for x in quality_model.score(awkward, None).collect()} == {0.5}


def test_isotonic_by_hand():
    knots, values = quality_model.isotonic(np.array([1.0, 1, 2, 1]), np.array([1.0, 0, 1, 1]), np.array([0.0, 1, 2, 3]))
    assert (np.diff(values) >= 0).all() and values.tolist() == [0.5, 1.0] and knots.tolist() == [1.25, 3.0]


# 10: media


def test_media_round_trip(spark):
    out = {x.doc_id: x for x in media.media_digest(media.text_media(frame(spark, AWKWARD))).collect()}
    for i, t in enumerate(AWKWARD):
        raw = (t or "").encode()
        padded = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        x = out[i]
        assert (x.n_bytes, x.payload_bytes, x.payload_sha256, x.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
    assert out[6].feature == out[7].feature


def test_media_formats():
    r = np.random.default_rng(0)
    colour, flat = r.integers(0, 256, (5, 7, 3), np.uint8), r.integers(0, 256, (5, 7), np.uint8)
    assert np.array_equal(media.decode(media.encode_bmp(colour)), colour)
    assert np.array_equal(media.decode(media.encode_pgm(flat)), flat)
    assert np.array_equal(media.decode(b"P6\n# note\n7 5 255\n" + colour.tobytes()), colour)
    assert np.array_equal(media.decode(b"P2 7 5 255 " + b" ".join(b"%d" % x for x in flat.ravel())), flat)
    assert media.decode(b"P1 3 2\n1 0 1\n010").tolist() == [[0, 255, 0], [255, 0, 255]]
    assert media.decode(b"P4 3 2\n" + bytes([0b10100000, 0b01000000])).tolist() == [[0, 255, 0], [255, 0, 255]]
    for bad in (b"", b"BM", b"P5", b"GIF89a", b"P5 9 9 255 x"):
        with pytest.raises(ValueError):
            media.decode(bad)


def test_media_resize_by_hand():
    r = np.random.default_rng(1)
    for h, w, a, b in ((12, 9, 4, 3), (5, 7, 3, 4), (3, 64, 8, 9), (20_000, 64, 8, 9), (1, 1, 2, 2)):
        image = r.integers(0, 256, (h, w), np.uint8)
        rows = np.array([[max(0, min(i + 1, (k + 1) * h / a) - max(i, k * h / a)) for i in range(h)] for k in range(a)]) / (h / a)
        cols = np.array([[max(0, min(j + 1, (k + 1) * w / b) - max(j, k * w / b)) for j in range(w)] for k in range(b)]) / (w / b)
        assert np.abs(media.resize(image, a, b).astype(int) - rows @ image @ cols.T).max() <= 0.51


def test_media_columns(spark):
    rows = [(1, media.encode_pgm((4 * np.arange(64)).astype(np.uint8).reshape(8, 8))), (2, None), (3, b"no image")]
    out = {x.id: x for x in media.media_columns(spark.createDataFrame(rows, "id long, picture binary"), "id", "picture").collect()}
    assert (out[1].height, out[1].width, out[1].channels, out[1].dhash) == (8, 8, 1, "ff" * 8) and out[2].tile is None and out[3].dhash is None
    assert np.load(__import__("io").BytesIO(out[1].tile)).shape == (16, 16)
