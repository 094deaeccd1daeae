"""Line-first quality rules, in DataFrame functions only.

Each line with a word is judged by itself: no closing punctuation on a short line, navigation, boilerplate, or mostly
symbols. Failing lines are removed; a document that loses too much text is rejected. Document statistics (repeated
lines, repeated eight-word windows, symbols) are taken on the whole text.

Defined results: null and empty texts have no words, all counts 0, and fail. Repeated rows give equal rows, null ids
pass through, an empty table gives no rows. Eight-word windows are compared by a 64-bit hash of 64-bit word hashes,
always within one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_RUN, word_list

WINDOW = 8
MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30
SYMBOLS = "#*$%&|<>"
#: A line shorter than this many words needs closing punctuation.
SHORT_LINE = 8
#: A document may lose this share of the code points of its lines, in percent.
MAX_LOST_PERCENT = 60
MAX_SYMBOL_PERCENT = 8

# Marks that close a line, marks that separate menu entries, phrases of boilerplate (in lower case).
CLOSING = ".!?:;\"')]}…”’»。！？"
SEPARATORS = "|»›•·"
BOILERPLATE = (
    "all rights reserved",
    "licensed under the",
    "terms of use",
    "privacy policy",
    "accept cookies",
    "enable javascript",
    "lorem ipsum",
    "click here to",
)
ASCII_SPACES = " \t\n\x0b\x0c\r"


def _count_of(text: Column, chars: str) -> Column:
    """How many code points of ``text`` are among ``chars``."""
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _line_fails(line: Column, symbols: Column) -> Column:
    """Whether a line with a word is to be removed; ``symbols``: how many the whole text has."""
    ending = F.right(F.rtrim(line, F.lit(ASCII_SPACES)), F.lit(1))
    low = F.lower(line)
    boilerplate = F.lit(False)
    for phrase in BOILERPLATE:
        boilerplate = boilerplate | low.contains(phrase)
    few_words = F.size(F.split(F.trim(line, F.lit(ASCII_SPACES)), SPACE_RUN)) < SHORT_LINE
    open_end = ~ending.isin(*CLOSING) & few_words
    menu = _count_of(line, SEPARATORS) >= 2
    noisy = F.when(symbols > 0, _count_of(line, SYMBOLS) * 100 > F.length(line) * MAX_SYMBOL_PERCENT).otherwise(F.lit(False))
    return boilerplate | open_end | menu | noisy


def rules(docs: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The statistics and the verdict for every row, with the cleaned text as ``clean_text``."""
    first = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    split = first.select(
        "doc_id",
        "t",
        word_list(F.col("t")).alias("words"),
        F.filter(F.split("t", "\n"), lambda l: F.trim(l, F.lit(ASCII_SPACES)) != "").alias("lines"),
        _count_of(F.col("t"), SYMBOLS).cast("long").alias("n_symbols"),
    )
    hashed = split.select(
        "doc_id",
        "lines",
        "n_symbols",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.filter("lines", lambda l: ~_line_fails(l, F.col("n_symbols"))).alias("good"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("h"),
    )
    starts = F.when(F.size("h") >= WINDOW, F.sequence(F.lit(0), F.size("h") - WINDOW)).otherwise(F.array().cast("array<int>"))
    windows = hashed.withColumn("win", F.transform(starts, lambda i: F.xxhash64(*[F.get("h", i + k) for k in range(WINDOW)]))).drop("h")
    # Few documents repeat a window: only they pay for the sort that finds which ones.
    ranked = windows.withColumn(
        "ranked",
        F.when(F.size(F.array_distinct("win")) < F.size("win"), F.sort_array(F.transform("win", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))),
    ).drop("win")
    same = lambda a, b: F.get("ranked", a)["x"] == F.get("ranked", b)["x"]
    twice = ranked.withColumn(
        "at",
        F.when(
            F.col("ranked").isNotNull(),
            F.sort_array(
                F.transform(
                    F.filter(
                        F.sequence(F.lit(0), F.size("ranked") - 1),
                        lambda i: F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False)),
                    ),
                    lambda i: F.get("ranked", i)["i"],
                )
            ),
        ),
    ).drop("ranked")
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate(
        "at",
        zero,
        lambda s, p: F.struct((s["n"] + p + WINDOW - F.greatest(s["end"], p)).alias("n"), (p + WINDOW).alias("end")),
        lambda s: s["n"],
    )
    counted = twice.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    long_of = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, l: s + F.length(l))
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEATED_PERCENT)
    judged = counted.select("*", failed.alias("base_failed"), long_of("lines").alias("line_chars"), long_of("good").alias("good_chars"))
    loses = (F.col("line_chars") - F.col("good_chars")) * 100 > F.col("line_chars") * MAX_LOST_PERCENT
    return judged.select(
        F.col("doc_id").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~loses).alias("kept"), F.array_join("good", "\n").alias("clean_text"),
    )


def quality_table(docs: DataFrame) -> DataFrame:
    """The contract's digest."""
    return rules(docs).drop("clean_text")


def quality_sql() -> str:
    """The same for DuckDB."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    chars = lambda s: "[" + "".join(f"\\x{{{ord(c):x}}}" for c in s) + "]"
    symbols, menu = q(chars(SYMBOLS)), q(chars(SEPARATORS))
    phrases = " OR ".join(f"contains(lower(l), {q(p)})" for p in BOILERPLATE)
    spaces = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
             list_filter(string_split(t, chr(10)), lambda x: trim(x, {spaces}) <> '') AS lines FROM d),
win AS (SELECT r, i, words[i:i+{WINDOW - 1}] AS g FROM (SELECT r, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM w)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM win) WHERE n >= 2),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, range(0, {WINDOW}) AS o(k) GROUP BY r),
lines AS (SELECT r, l, regexp_replace(l, {symbols}, '', 'g') AS bare FROM (SELECT r, unnest(lines) AS l FROM w)),
judged AS (SELECT r, length(l) AS n,
    ({phrases})
    OR (NOT contains({q(CLOSING)}, right(rtrim(l, {spaces}), 1)) AND len(string_split_regex(trim(l, {spaces}), '[\x20\x09-\x0D]+')) < {SHORT_LINE})
    OR length(l) - length(regexp_replace(l, {menu}, '', 'g')) >= 2
    OR (length(l) - length(bare)) * 100 > length(l) * {MAX_SYMBOL_PERCENT} AS fails FROM lines),
lost AS (SELECT r, sum(n) AS total, sum(CASE WHEN fails THEN n ELSE 0 END) AS lost FROM judged GROUP BY r),
s AS (SELECT w.r, doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, {symbols}, '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, coalesce(total, 0) AS total, coalesce(lost, 0) AS lost
    FROM w LEFT JOIN rep USING (r) LEFT JOIN lost USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words AS base_failed,
    NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words) AND NOT (lost * 100 > total * {MAX_LOST_PERCENT}) AS kept
FROM s"""
