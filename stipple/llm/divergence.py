"""Quality rules by distribution divergence.

Each document is reduced to counts: words, character classes, the common words of its language,
repeated lines and words in repeated 5-word windows. The reference of a language is the sum of these
counts over all its documents of at least ``min_words`` words. A document fails when the
Jensen-Shannon distance (the root of the divergence in bits) of its character classes or of its
common words from the reference of its language passes a limit. Documents below ``min_words`` are not
held against the character limit, and documents below ``min_common`` words and languages without a
list of common words not against the word limit, since so few counts say nothing.

Only DataFrame operations are used: texts become counts in their own row, references are sums
that are combined before they move, and no row is shuffled with its text.

Null and empty texts have no words and fail the base rule. A null language is a language of its own
without common words. A null doc_id keeps its row; repeated rows are judged alike. Other columns are
never looked at. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stipple.llm.registry import named, table
from stipple.llm.shared import written

WORD = r"[^\x20\x09-\x0D]+"
MIN_WORDS = 50
CHAR_LIMIT = 0.25
WORD_LIMIT = 0.28
MIN_COMMON = 100
CLASSES = ("upper", "digit", "stop", "symbol", "space", "other")
#: Function words that are common in any prose of the language.
COMMON = {
    "en": "the of and to in is that for on with as it at by be this are from was or".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split(),
    "fr": "de la le et les des en un une est que dans qui par pour au sur pas plus ce".split(),
    "es": "de la que el en y los del se las por un para con no una su al lo como".split(),
}


def removed_by(text: Column, pattern: str) -> Column:
    """Characters of the text that belong to matches of the pattern."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def with_counts(docs: DataFrame, *, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """doc_id, lang, the base counts, ``chars`` (by CLASSES) and ``common`` (by the language's list, then the rest)."""
    lists = reduce(lambda e, kv: e.when(F.col("lang") == kv[0], F.array(*map(F.lit, kv[1]))), COMMON.items(), F)
    first = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"),
                        F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    split = first.select(
        "doc_id", "lang", F.regexp_extract_all("t", F.lit(WORD), F.lit(0)).alias("words"),
        F.length("t").alias("n_chars"), removed_by(F.col("t"), r"[\x20\x09-\x0D]+").alias("space"),
        removed_by(F.col("t"), r"[#*$%&|<>]+").alias("symbol"), removed_by(F.col("t"), "[A-ZÀ-ÖØ-Þ]+").alias("upper"),
        removed_by(F.col("t"), "[0-9]+").alias("digit"), removed_by(F.col("t"), "[.,;:!?'\"()-]+").alias("stop"),
        F.filter(F.split("t", "\n", -1), lambda x: x.rlike(WORD)).alias("lines"), lists.alias("list"))
    sized = split.select("*", F.size("words").alias("n_words"),
                         (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"))
    at = lambda i: F.xxhash64(*[F.get(F.col("words"), i + k) for k in range(5)])
    windows = F.when(F.col("n_words") >= 5, F.transform(F.sequence(F.lit(0), F.col("n_words") - 5), at))
    hashed = sized.select(
        "doc_id", "lang", "n_words", "n_dup_lines", "n_chars", "space", "symbol", "upper", "digit", "stop", "list",
        windows.alias("windows"), F.filter("words", lambda w: F.array_contains(F.col("list"), w)).alias("hits"))
    repeated = hashed.select("*", F.when(
        F.size("windows") > F.size(F.array_distinct("windows")),
        F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("sorted"))
    same = lambda x, k: (x["h"] == F.get(F.col("sorted"), k - 1)["h"]) | (x["h"] == F.get(F.col("sorted"), k + 1)["h"])
    places = repeated.select("*", F.sort_array(F.transform(
        F.filter("sorted", lambda x, k: F.coalesce(same(x, k), F.lit(False))), lambda x: x["i"])).alias("at"))
    step = lambda x, k: F.least(F.lit(5), F.coalesce(F.get(F.col("at"), k + 1) - x, F.lit(5)))
    covered = F.aggregate(F.transform("at", step), F.lit(0).cast("long"), lambda a, x: a + x)
    counts = F.transform("list", lambda w: F.size(F.filter("hits", lambda x: x == w)).cast("long"))
    other = F.col("n_chars") - F.col("space") - F.col("symbol") - F.col("upper") - F.col("digit") - F.col("stop")
    return places.select(
        "doc_id", "lang", F.col("n_words").cast("long").alias("n_words"),
        (F.col("n_chars") - F.col("space")).cast("long").alias("word_chars"), F.col("symbol").cast("long").alias("n_symbols"),
        F.col("n_dup_lines").cast("long").alias("n_dup_lines"), F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.array(*[F.col(c).cast("long") for c in CLASSES[:-1]], other.cast("long")).alias("chars"),
        F.concat(counts, F.array((F.col("n_words") - F.size("hits")).cast("long"))).alias("common"))


def js_distance(p: Column, q: Column) -> Column:
    """Root of the Jensen-Shannon divergence in bits of two arrays of counts; NULL where one is all zero."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, v: a + v)
    n, m = total(p), total(q)
    side = lambda a, b: F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)
    shares = F.zip_with(F.transform(p, lambda x: x / n), F.transform(q, lambda y: y / m),
                        lambda a, b: (side(a, b) + side(b, a)) / 2)
    return F.when((n > 0) & (m > 0), F.round(F.sqrt(F.greatest(total(shares), F.lit(0.0))), 9) + 0.0)


def judged(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
           min_words: int = MIN_WORDS, min_common: int = MIN_COMMON, char_limit: float = CHAR_LIMIT,
           word_limit: float = WORD_LIMIT) -> DataFrame:
    """One row per document: the base counts, base_failed, js_chars, js_words and kept."""
    counted = written(with_counts(docs, id_col=id_col, text_col=text_col, lang_col=lang_col))
    n_common = max(map(len, COMMON.values())) + 1
    long_enough = F.col("n_words") >= min_words
    sums = lambda name, n: F.array(*[F.coalesce(F.sum(F.get(name, F.lit(k))), F.lit(0)).cast("double") for k in range(n)])
    reference = written(counted.where(long_enough).groupBy(F.col("lang").alias("of")).agg(
        sums("chars", len(CLASSES)).alias("rc"), sums("common", n_common).alias("rw")))
    both = counted.join(reference, counted["lang"].eqNullSafe(reference["of"]), "left").select(
        counted["*"], "rc", "rw", F.col("chars").cast("array<double>").alias("dc"), F.col("common").cast("array<double>").alias("dw"))
    js_chars, js_words = js_distance(F.col("dc"), F.col("rc")), js_distance(F.col("dw"), F.col("rw"))
    known = F.col("common").isNotNull()
    result = both.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))).alias("base_failed"),
        F.when(long_enough, js_chars).alias("js_chars"), F.when((F.col("n_words") >= min_common) & known, js_words).alias("js_words"))
    far = (F.coalesce(F.col("js_chars") > char_limit, F.lit(False)) | F.coalesce(F.col("js_words") > word_limit, F.lit(False)))
    return result.withColumn("kept", ~F.col("base_failed") & ~far)


def oracle() -> str:
    lists = " ".join("WHEN '{}' THEN [{}]".format(k, ", ".join(f"'{w}'" for w in v)) for k, v in COMMON.items())
    n_common = max(map(len, COMMON.values())) + 1

    def js(p: str, q: str, n: int, least: str) -> str:
        a = [f"(coalesce({p}[{k + 1}], 0) / p_{p})" for k in range(n)]
        b = [f"(coalesce({q}[{k + 1}], 0) / q_{p})" for k in range(n)]
        terms = " + ".join(f"(CASE WHEN {x} > 0 THEN {x} * log2(2 * {x} / ({x} + {y})) ELSE 0 END + CASE WHEN {y} > 0 THEN {y} * log2(2 * {y} / ({x} + {y})) ELSE 0 END) / 2"
                           for x, y in zip(a, b))
        return f"CASE WHEN {least} AND p_{p} > 0 AND q_{p} > 0 THEN round(sqrt(greatest({terms}, 0)), 9) + 0.0 END"

    ref_c = ", ".join(f"CAST(sum(chars[{k + 1}]) AS DOUBLE)" for k in range(len(CLASSES)))
    ref_w = ", ".join(f"CAST(coalesce(sum(common[{k + 1}]), 0) AS DOUBLE)" for k in range(n_common))
    return rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents),
w AS (SELECT doc_id, lang, r, t, regexp_extract_all(t, '{WORD}') AS words, CASE lang {lists} END AS list,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines FROM d),
pos AS (SELECT r, i, words[i], words[i + 1], words[i + 2], words[i + 3], words[i + 4],
  count(*) OVER (PARTITION BY r, words[i], words[i + 1], words[i + 2], words[i + 3], words[i + 4]) AS c
  FROM w, unnest(range(1, len(words) - 3)) u(i)),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM pos, range(5) v(k) WHERE c > 1 GROUP BY r),
counted AS (
  SELECT w.r, doc_id, lang, len(words) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(rep.n, 0) AS n_repeat_words,
    [length(t) - length(regexp_replace(t, '[A-ZÀ-ÖØ-Þ]', '', 'g')), length(t) - length(regexp_replace(t, '[0-9]', '', 'g')),
     length(t) - length(regexp_replace(t, '[.,;:!?''"()-]', '', 'g')), length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')),
     length(t) - length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))] AS five, length(t) AS n_chars,
    list_concat(list_transform(list, lambda x: len(list_filter(words, lambda y: y = x))),
      [len(words) - len(list_filter(words, lambda y: list_contains(list, y)))]) AS common, list
  FROM w LEFT JOIN rep USING (r)),
full_ AS (SELECT * REPLACE (CASE WHEN list IS NOT NULL THEN common END AS common), list_concat(five, [n_chars - list_sum(five)]) AS chars FROM counted),
ref AS (SELECT lang, [{ref_c}] AS rc, [{ref_w}] AS rw FROM full_ WHERE n_words >= {MIN_WORDS} GROUP BY lang),
both_ AS (SELECT f.*, rc, rw, CAST(list_sum(chars) AS DOUBLE) AS p_chars, list_sum(rc) AS q_chars, CAST(list_sum(common) AS DOUBLE) AS p_common, list_sum(rw) AS q_common
  FROM full_ f LEFT JOIN ref ON f.lang IS NOT DISTINCT FROM ref.lang),
s AS (SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  {js('chars', 'rc', len(CLASSES), f'n_words >= {MIN_WORDS}')} AS js_chars,
  {js('common', 'rw', n_common, f'n_words >= {MIN_COMMON} AND common IS NOT NULL')} AS js_words FROM both_)
SELECT *, NOT base_failed AND NOT coalesce(js_chars > {CHAR_LIMIT}, false) AND NOT coalesce(js_words > {WORD_LIMIT}, false) AS kept FROM s"""


@named("op3_distribution_divergence", oracle())
def op3_distribution_divergence(spark, sf_dir):
    return judged(table(spark, sf_dir, "documents"))
