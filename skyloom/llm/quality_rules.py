"""Quality rules, line first: bad lines go, then documents that lose too much.

Every line of a text is judged by rules on punctuation, navigation and
boilerplate; failing lines are removed, and a document is rejected if too
little of its text is left.  Before that, base rules look at the whole text.
All of it is DataFrame functions: each document is worked on in its own row,
without a shuffle, and a text's repeated windows are found by sorting their
hashes, only where there are any.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD, table

#: Words of a window, and the least number of words of a document.
WINDOW, LEAST_WORDS = 5, 10
#: A document must keep this share of its text's characters in words (in per cent).
LEAST_LEFT = 60

# Phrases of page furniture in English, French, German and Spanish that mark a short line as boilerplate; a dot stands for an accented letter.
PHRASES = [
    "accept (all )?cookies", "use of cookies", "cookie policy", "privacy policy", "terms (of use|of service|and conditions)", "enable javascript",
    "all rights reserved", "click here", "read more", "sign (in|up)", "log ?in", "subscribe (now|to)", "share (this|on)", "follow us",
    "back to top", "powered by", "skip to (main )?content",
    "accepter les cookies", "politique de confidentialit", "mentions l.gales", "tous droits r.serv", "cliquez ici", "lire la suite", "partager sur",
    "cookies akzeptieren", "datenschutzerkl", "impressum", "alle rechte vorbehalten", "hier klicken", "mehr lesen", "weiterlesen", "teilen auf",
    "aceptar (todas las )?cookies", "pol.tica de (cookies|privacidad)", "aviso legal", "todos los derechos reservados", "haga clic", "leer m.s", "compartir en",
]
BOILERPLATE = f"(?i)({'|'.join(PHRASES)})"
NAVIGATION = r"[|»›>•·]"
SYMBOL = "[#*$%&|<>]"
END = r"[.!?:;…。！？][\"'”’»)\]]*[\x20\x09-\x0D]*$"


def bad_line(line: Column) -> Column:
    """Whether a line with words fails: symbols or shouting marks for punctuation, menu separators, boilerplate, or a stub without an end mark."""
    n = F.regexp_count(line, F.lit(WORD))
    chars = F.length(line)
    symbols = F.regexp_count(line, F.lit(SYMBOL))
    marks = F.regexp_count(line, F.lit("[!?]{2,}"))
    separators = F.regexp_count(line, F.lit(NAVIGATION))
    return (
        (F.lit(20) * symbols > chars)
        | ((marks >= 3) & (5 * marks > n))
        | ((separators >= 2) & (5 * separators > n))
        | ((n < 3) & ~line.rlike(END))
        | ((n <= 20) & line.rlike(BOILERPLATE))
    )


def judge(docs: DataFrame) -> DataFrame:
    """``docs`` with the base statistics, ``clean_text``, ``base_failed`` and ``kept`` appended.

    Null texts count as empty: no words, so they fail the base rules.  Repeated
    rows are judged alike; input columns with an appended name are replaced.
    """
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "clean_text", "base_failed", "kept"]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    has_word = lambda x: x.rlike(WORD)
    base = docs.drop(*added).withColumns(
        {
            "_qr_words": F.filter(F.split(text, SPACE), lambda w: w != ""),
            "_qr_lines": F.filter(F.split(text, "\n"), has_word),
            "n_symbols": F.regexp_count(text, F.lit(SYMBOL)).cast("long"),
        }
    )
    base = base.withColumns(
        {
            "n_words": F.size("_qr_words").cast("long"),
            "word_chars": F.aggregate("_qr_words", F.lit(0).cast("long"), lambda s, w: s + F.length(w)),
            "_qr_hashes": F.transform("_qr_words", lambda w: F.xxhash64(w)),
            "n_dup_lines": (F.size("_qr_lines") - F.size(F.array_distinct("_qr_lines"))).cast("long"),
            "_qr_good": F.filter("_qr_lines", lambda x: ~bad_line(x)),
        }
    ).drop("_qr_words", "_qr_lines")
    h = lambda i: F.get("_qr_hashes", i)
    windows = F.transform(
        F.slice("_qr_hashes", 1, F.greatest(F.size("_qr_hashes") - (WINDOW - 1), F.lit(0))),
        lambda first, i: F.xxhash64(first, *[h(i + k) for k in range(1, WINDOW)]),
    )
    base = base.withColumn("_qr_windows", windows).drop("_qr_hashes")
    twice = F.size(F.array_distinct("_qr_windows")) < F.size("_qr_windows")
    base = base.withColumn("_qr_sorted", F.when(twice, F.array_sort(F.transform("_qr_windows", lambda x, i: F.struct(x.alias("h"), i.alias("i")))))).drop("_qr_windows")
    same = lambda x, j: F.coalesce(F.get("_qr_sorted", j)["h"] == x["h"], F.lit(False))
    base = base.withColumn("_qr_starts", F.array_sort(F.transform(F.filter("_qr_sorted", lambda x, i: ((i > 0) & same(x, F.greatest(i - 1, F.lit(0)))) | same(x, i + 1)), lambda x: x["i"]))).drop("_qr_sorted")
    covered = F.transform("_qr_starts", lambda at, i: F.least(F.lit(WINDOW), F.coalesce(F.get("_qr_starts", i + 1) - at, F.lit(WINDOW))))
    base = base.withColumn("n_repeat_words", F.coalesce(F.aggregate(covered, F.lit(0).cast("long"), lambda s, x: s + x), F.lit(0)).cast("long")).drop("_qr_starts")
    left = F.aggregate("_qr_good", F.lit(0).cast("long"), lambda s, x: s + F.length(F.regexp_replace(x, SPACE, "")))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    judged = base.withColumns({"clean_text": F.array_join("_qr_good", "\n"), "base_failed": failed, "_qr_left": left})
    judged = judged.withColumn("kept", ~F.col("base_failed") & (100 * F.col("_qr_left") >= LEAST_LEFT * F.col("word_chars")))
    return judged.select(*[c for c in docs.columns if c not in added], *added)


def clean(docs: DataFrame) -> DataFrame:
    """The kept documents, with their failing lines removed; the columns of ``docs``."""
    return judge(docs).where("kept").select(*[F.col("clean_text").alias("text") if c == "text" else F.col(c) for c in docs.columns])


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP3_SQL = r"""
WITH base AS (
  SELECT ROW_NUMBER() OVER () AS rn, doc_id, COALESCE(text, '') AS t FROM documents
), parts AS (
  SELECT rn, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM base
), windows AS (
  SELECT rn, i, w[i:i+4] AS win FROM (SELECT rn, w, unnest(range(1, len(w) - 3)) AS i FROM parts WHERE len(w) >= 5)
), twice AS (
  SELECT rn, i FROM (SELECT rn, i, COUNT(*) OVER (PARTITION BY rn, win) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT rn, SUM(LEAST(5, COALESCE(nxt - i, 5)))::BIGINT AS n FROM (SELECT rn, i, LEAD(i) OVER (PARTITION BY rn ORDER BY i) AS nxt FROM twice) GROUP BY rn
), judged AS (
  SELECT p.rn, doc_id, len(w)::BIGINT AS n_words, COALESCE(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         COALESCE(c.n, 0)::BIGINT AS n_repeat_words,
         COALESCE(list_sum(list_transform(list_filter(lines, lambda x: NOT (
             20 * len(regexp_extract_all(x, '[#*$%&|<>]')) > length(x)
             OR (len(regexp_extract_all(x, '[!?]{2,}')) >= 3 AND 5 * len(regexp_extract_all(x, '[!?]{2,}')) > len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')))
             OR (len(regexp_extract_all(x, '[|»›>•·]')) >= 2 AND 5 * len(regexp_extract_all(x, '[|»›>•·]')) > len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')))
             OR (len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) <= 20 AND regexp_matches(x, '@BOILERPLATE@'))
             OR (len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) < 3 AND NOT regexp_matches(x, '@END@'))
         )), lambda x: length(regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g')))), 0)::BIGINT AS kept_chars
  FROM parts p LEFT JOIN covered c ON p.rn = c.rn
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND 100 * kept_chars >= 60 * word_chars AS kept
FROM (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM judged)
""".replace("@BOILERPLATE@", BOILERPLATE).replace("@END@", END.replace("'", "''"))
