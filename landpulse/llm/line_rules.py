"""Line-first quality rules: judge every line, remove the lines that fail, reject documents that lose too much.

Only built-in functions; every document is judged inside its own row, so nothing is shuffled and no key can be hot.
Repeated three-word windows are found by sorting one 64-bit value per window (a hash above, the position below) and
comparing neighbours, whose words are then compared too.

A null or empty text has no words, fails the base rule and is not kept; its cleaned text is empty. A text of one long
line is one line. Repeated rows are judged alike. The input's other columns are kept by ``clean_documents``; working
columns are named ``__…`` and never meet them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from landpulse.llm.tables import documents, query

# Fixed values of the base measures.
INK = r"[^\x20\x09-\x0D]"
WORD_GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
LEAST_WORDS, MOST_REPEATED = 50, 50

# Line rules.
SYMBOL_SHARE = 12  # per cent of a line's characters that are symbols or exclamation marks
MENU_MARKS = "|»›•"
LEAST_MENU_MARKS = 3
LONG_LINE = 60  # characters; a line of prose of this length has some punctuation
PUNCTUATION = ".,;:!?"
BOILERPLATE = [
    "all rights reserved", "licensed under the", "released under the", "general public license", "terms of use", "terms of service",
    "privacy policy", "cookie policy", "accept cookies", "enable javascript", "click here", "subscribe to our", "sign up for", "skip to content",
]
MOST_LOST = 35  # per cent of the characters in words


def count_of(text: Column, characters: str) -> Column:
    return F.regexp_count(text, F.lit(f"[{characters}]"))


def inked(line: Column) -> Column:
    return line.rlike(INK)


def line_fails(line: Column, marked: Column, phrased: Column) -> Column:
    """Too many symbols, a menu, long without punctuation, or a stock phrase. Lines without a word pass.

    ``marked`` and ``phrased`` say whether the whole text has such a character or phrase at all; most texts have
    neither, so most lines are looked at once.
    """
    low = F.lower(line)
    return inked(line) & (
        ((F.length(line) >= LONG_LINE) & ~line.rlike(f"[{PUNCTUATION}]"))
        | (marked & ((count_of(line, SYMBOLS + "!") * 100 > F.length(line) * SYMBOL_SHARE) | (count_of(line, MENU_MARKS) >= LEAST_MENU_MARKS)))
        | (phrased & _any(low.contains(p) for p in BOILERPLATE)))


def _any(tests) -> Column:
    out = F.lit(False)
    for test in tests:
        out = out | test
    return out


def repeated_words(words: Column, positions: Column, bits: Column) -> Column:
    """Words inside three-word windows that occur twice or more; ``positions`` are the sorted window values."""
    low = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
    at = lambda x: x.bitwiseAND(low).cast("int")

    def same(x: Column, other: Column) -> Column:
        return F.coalesce(
            (F.call_function("shiftright", x, bits) == F.call_function("shiftright", other, bits))
            & (F.get(words, at(x)) == F.get(words, at(other))) & (F.get(words, at(x) + 1) == F.get(words, at(other) + 1))
            & (F.get(words, at(x) + 2) == F.get(words, at(other) + 2)), F.lit(False))

    twice = F.filter(positions, lambda x, j: same(x, F.get(positions, j - 1)) | same(x, F.get(positions, j + 1)))
    return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(at(x), at(x) + 1, at(x) + 2)))))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns of ``docs`` and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, and working columns."""
    words = F.array_remove(F.split(F.col("__text"), WORD_GAP), "")
    split = docs.withColumn("__text", F.coalesce(F.col(text), F.lit(""))).withColumns({
        "__words": words, "__lines": F.split(F.col("__text"), "\n", -1)})
    hashed = split.withColumn("__bits", F.length(F.bin(F.size("__words").cast("long")))).withColumns({
        "__full": F.filter("__lines", inked),
        "__marked": F.col("__text").rlike(f"[{SYMBOLS}!{MENU_MARKS}]"),
        "__low": F.lower("__text"),
        "__windows": F.when(F.size("__words") >= 3, F.sort_array(F.transform(
            F.sequence(F.lit(0), F.size("__words") - 3),
            lambda i: F.call_function("shiftleft", F.xxhash64(F.get("__words", i), F.get("__words", i + 1), F.get("__words", i + 2)), F.col("__bits"))
            .bitwiseOR(i.cast("long"))))),
    })
    # Not deterministic, so the test of the whole text stays a column of its own and is not worked out anew for every line.
    flagged = hashed.withColumn("__phrased", F.when(F.spark_partition_id() >= 0, _any(F.col("__low").contains(p) for p in BOILERPLATE)).otherwise(False))
    judged = flagged.withColumn("__failed", F.filter("__lines", lambda x: line_fails(x, F.col("__marked"), F.col("__phrased"))))
    counted = judged.withColumns({
        "n_words": F.size("__words").cast("long"),
        "word_chars": F.length(F.array_join("__words", "")).cast("long"),
        "n_symbols": F.when(F.col("__marked"), count_of(F.col("__text"), SYMBOLS)).otherwise(0).cast("long"),
        "n_dup_lines": (F.size("__full") - F.size(F.array_distinct("__full"))).cast("long"),
        "n_repeat_words": F.when(F.size("__words") >= 3, repeated_words(F.col("__words"), F.col("__windows"), F.col("__bits"))).otherwise(0).cast("long"),
        "__part": F.spark_partition_id(),  # not deterministic, so a filter on the verdict is not moved below and worked out anew there
        "__lost": F.when(F.size("__failed") > 0, F.length(F.regexp_replace(F.array_join("__failed", ""), WORD_GAP, ""))).otherwise(0),
    })
    lost = F.col("__lost") * 100 > F.col("word_chars") * MOST_LOST
    failed = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED)
    return counted.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & ~lost)


def judge(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document with the measures and the verdict."""
    return measure(docs.select(F.col(ident).alias("doc_id"), F.col(text).alias("__source")), "__source").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def clean_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that are kept, with all their columns and the failing lines gone from ``text``."""
    own = docs.columns
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("__row"), F.col(f"`{text}`").alias("__source"))
    kept = measure(inner, "__source").filter("kept and __part >= 0")
    clean = F.when(F.size("__failed") == 0, F.col("__text")).otherwise(F.array_join(
        F.filter("__lines", lambda x: ~line_fails(x, F.col("__marked"), F.col("__phrased"))), "\n"))
    return kept.select(*[(clean if c == text else F.col("__row").getField(c)).alias(c) for c in own])


def _sql_count(value: str, characters: str) -> str:
    return f"(length({value}) - length(translate({value}, '{characters}', '')))"


def sql_line_fails(line: str) -> str:
    phrases = " or ".join(f"contains(lower({line}), '{p}')" for p in BOILERPLATE)
    return f"""(regexp_matches({line}, '{INK}') and ((length({line}) >= {LONG_LINE} and {_sql_count(line, PUNCTUATION)} = 0)
        or {_sql_count(line, SYMBOLS + '!')} * 100 > length({line}) * {SYMBOL_SHARE} or {_sql_count(line, MENU_MARKS)} >= {LEAST_MENU_MARKS} or {phrases}))"""


def sql_measures(source: str = "documents", ident: str = "doc_id") -> str:
    """CTEs ending in ``measured``: the columns of ``judge`` and ``clean``, with every column of the table."""
    return f"""split AS (SELECT *, coalesce(text, '') AS t FROM {source}),
        listed AS (SELECT *, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w, string_split(t, chr(10)) AS lines FROM split),
        grams AS (SELECT {ident}, unnest(range(1, len(w) - 1)) AS i, unnest(w[1:len(w) - 2]) AS a, unnest(w[2:len(w) - 1]) AS b, unnest(w[3:len(w)]) AS c
            FROM listed WHERE len(w) >= 3),
        counted AS (SELECT {ident}, i, count(*) OVER (PARTITION BY {ident}, a, b, c) AS n FROM grams),
        twice AS (SELECT {ident}, count(DISTINCT p) AS n_repeat FROM (SELECT {ident}, unnest([i, i + 1, i + 2]) AS p FROM counted WHERE n > 1) GROUP BY 1),
        base AS (SELECT l.*, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, {_sql_count('t', SYMBOLS)} AS n_symbols,
            len(list_filter(lines, lambda x: regexp_matches(x, '{INK}'))) - len(list_distinct(list_filter(lines, lambda x: regexp_matches(x, '{INK}')))) AS n_dup_lines,
            coalesce(n_repeat, 0) AS n_repeat_words, coalesce(array_to_string(list_filter(lines, lambda x: NOT {sql_line_fails('x')}), chr(10)), '') AS clean,
            length(regexp_replace(coalesce(array_to_string(list_filter(lines, lambda x: {sql_line_fails('x')}), ''), ''), '[\\x20\\x09-\\x0D]+', '', 'g')) AS lost
            FROM listed l LEFT JOIN twice USING ({ident})),
        measured AS (SELECT *, n_words < {LEAST_WORDS} OR n_repeat_words * 100 > n_words * {MOST_REPEATED} AS base_failed,
            NOT (n_words < {LEAST_WORDS} OR n_repeat_words * 100 > n_words * {MOST_REPEATED})
            AND NOT lost * 100 > word_chars * {MOST_LOST} AS kept FROM base)"""


SQL = f"""WITH {sql_measures()} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
    base_failed, kept FROM measured"""


@query("op7_line_rules", SQL)
def op7_line_rules(spark: SparkSession, folder: str) -> DataFrame:
    return judge(documents(spark, folder))
