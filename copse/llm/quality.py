"""Line-first quality cleaning with DataFrame functions only.

Each line of a text is judged on its own by three rules (punctuation, navigation, boilerplate); lines that fail are
removed, and a document that loses more than MAX_LOST of its characters is rejected. Before that, base measures of
the whole text reject documents that are too short or that repeat themselves.

Defined results: null and empty texts have no word, so they fail the base measures and their cleaned text is empty;
blank lines never fail; repeated rows are judged alike; an empty table gives an empty result; further columns pass
through clean() unless they carry one of the names that it adds, which it then replaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from copse.llm.common import free_name, read

SPACE = "[ \\t\\n\\x0B\\f\\r]"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 10
#: Most words in repeated windows, in hundredths of all words.
MAX_REPEATED = 20
WINDOW = 5
#: Most of a document's characters, in hundredths, that failing lines may hold.
MAX_LOST = 50

#: A line passes the punctuation rule if it ends a sentence or has so many words.
ENDS = "[.!?:;\\u2026\\u3002\\uff01\\uff1f][\"'\\u00bb\\u201d\\u2019)\\]]*[ \\t\\x0B\\f\\r]*\\z"
MIN_LINE_WORDS = 3
#: A line is navigation with so many separators, if there is one for every two words at least.
SEPARATORS = "[|\\u00bb\\u203a\\u2022\\u00b7]"
MIN_SEPARATORS = 3
#: A line of so few words is boilerplate if it has one of these phrases.
MAX_BOILERPLATE_WORDS = 25
BOILERPLATE = "(?i)(lorem ipsum|enable javascript|javascript is disabled|accept (all )?cookies|cookie (policy|settings)|uses cookies|privacy policy|terms of (use|service)|all rights reserved|subscribe to our|sign up for|log ?in to|click here|read more|share this|follow us|back to top|skip to content)"


def bound(value: Column, use) -> Column:
    """use(value), where value is computed once however often use reads it."""
    return F.transform(F.array(value), use)[0]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE + "+"), "")


def repeated_words(words: Column) -> Column:
    """How many words stand in windows of WINDOW words that the text has twice or more.

    Windows are compared by 64-bit hashes; only texts with some repeated window sort them.
    """

    def windows(h: Column) -> Column:
        return F.transform(F.slice(h, 1, F.greatest(F.size(h) - (WINDOW - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, WINDOW)]))

    def covered(at: Column) -> Column:
        return F.aggregate(F.transform(at, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1) - p, F.lit(WINDOW)))), F.lit(0).cast("long"), lambda a, x: a + x)

    def positions(s: Column) -> Column:
        twice = F.filter(s, lambda x, i: F.coalesce(x["h"] == F.get(s, i - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(s, i + 1)["h"], F.lit(False)))
        return F.sort_array(F.transform(twice, lambda x: x["p"]))

    def count(w: Column) -> Column:
        pairs = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(bound(bound(pairs, positions), covered))

    return bound(bound(F.transform(words, lambda w: F.xxhash64(w)), windows), count)


def line_fails(line: Column) -> Column:
    def fails(x: Column) -> Column:
        n, separators = x["n"], x["separators"]
        punctuation = (n < MIN_LINE_WORDS) & ~line.rlike(ENDS)
        navigation = (separators >= MIN_SEPARATORS) & (2 * separators >= n - separators)
        boilerplate = (n <= MAX_BOILERPLATE_WORDS) & line.rlike(BOILERPLATE)
        return (n > 0) & (punctuation | navigation | boilerplate)

    return bound(F.struct(F.size(words_of(line)).alias("n"), F.regexp_count(line, F.lit(SEPARATORS)).alias("separators")), fails)


def clean(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lost, base_failed, kept, clean_text."""
    t, w, lines, bad = (free_name(docs.columns, f"_{x}") for x in ("t", "w", "lines", "bad"))
    df = docs.withColumn(t, F.coalesce(docs[text].cast("string"), F.lit("")))
    df = df.withColumn(w, words_of(F.col(t))).withColumn(lines, F.split(F.col(t), "\n"))
    df = df.withColumn(bad, F.transform(F.col(lines), line_fails))
    full = lambda ls: F.filter(ls, lambda x: x.rlike("[^ \\t\\n\\x0B\\f\\r]"))
    df = (
        df.withColumn("n_words", F.size(w).cast("long"))
        .withColumn("word_chars", F.length(F.concat_ws("", F.col(w))).cast("long"))
        .withColumn("n_symbols", F.regexp_count(F.col(t), F.lit(f"[{SYMBOLS}]")).cast("long"))
        .withColumn("n_dup_lines", bound(full(F.col(lines)), lambda ls: (F.size(ls) - F.size(F.array_distinct(ls))).cast("long")))
        .withColumn("n_repeat_words", repeated_words(F.col(w)))
        .withColumn("n_lost", F.aggregate(F.zip_with(lines, bad, lambda x, b: F.when(b, F.length(x)).otherwise(0)), F.lit(0).cast("long"), lambda a, x: a + x))
        .withColumn("clean_text", F.concat_ws("\n", F.transform(F.filter(F.arrays_zip(F.col(lines).alias("l"), F.col(bad).alias("b")), lambda x: ~x["b"]), lambda x: x["l"])))
    )
    df = df.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words")))
    df = df.withColumn("kept", ~F.col("base_failed") & (100 * F.col("n_lost") <= MAX_LOST * F.length(t)))
    return df.drop(t, w, lines, bad)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return clean(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _re2(pattern: str) -> str:
    """A Java pattern of this module for DuckDB."""
    import re

    return re.sub(r"\\u([0-9a-f]{4})", r"\\x{\1}", pattern).replace("'", "''")


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS ws, string_split(t, chr(10)) AS ls FROM d),
g AS (SELECT r, i, list_aggregate(ws[i:i + 4], 'string_agg', ' ') AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
c AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g),
p AS (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS j FROM c WHERE n > 1),
n AS (SELECT r, sum(least(5, coalesce(j - i, 5))) AS n FROM p GROUP BY r),
m AS (SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
        length(t) - length(regexp_replace(t, '[{SYMBOLS}]', '', 'g')) AS n_symbols,
        len(list_filter(ls, lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]'))) - len(list_distinct(list_filter(ls, lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]')))) AS n_dup_lines,
        CAST(coalesce(n.n, 0) AS BIGINT) AS n_repeat_words, length(t) AS n_chars,
        coalesce(list_sum(list_transform(list_filter(ls, lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]') AND (
            (len(list_filter(string_split_regex(x, '[ \t\n\x0B\f\r]+'), lambda y: y <> '')) < {MIN_LINE_WORDS} AND NOT regexp_matches(x, '{_re2(ENDS)}'))
            OR (len(regexp_extract_all(x, '{_re2(SEPARATORS)}')) >= {MIN_SEPARATORS}
                AND 3 * len(regexp_extract_all(x, '{_re2(SEPARATORS)}')) >= len(list_filter(string_split_regex(x, '[ \t\n\x0B\f\r]+'), lambda y: y <> '')))
            OR (len(list_filter(string_split_regex(x, '[ \t\n\x0B\f\r]+'), lambda y: y <> '')) <= {MAX_BOILERPLATE_WORDS} AND regexp_matches(x, '{_re2(BOILERPLATE)}')))), lambda x: length(x))), 0) AS n_lost
      FROM w LEFT JOIN n USING (r)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND 100 * n_lost <= {MAX_LOST} * n_chars AS kept FROM b
"""
