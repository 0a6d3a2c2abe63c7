"""Quality rules that work line by line first, then on what the lines leave of a document."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, words_of

#: Fixed values of the query contract.
SYMBOLS = "#*$%&|<>"
#: Marks between the items of a menu.
SEPARATORS = "|»›•·"
#: Phrases of pages rather than of prose; a line of at most BOILERPLATE_CHARS characters that holds one fails.
BOILERPLATE = (
    r"(?i)all rights reserved|terms of (use|service)|privacy policy|accept (all )?cookies|enable javascript|click here|"
    r"sign (in|up) (to|for|now)|log ?in to|subscribe to|copyright (\(c\)|©|\d{4})|follow us|share this|read more|skip to content"
)
BOILERPLATE_CHARS = 200
#: A line of at least so many words must hold a mark of punctuation after one of them.
SENTENCE_WORDS = 12
#: Marks that end or part sentences, of Latin, Greek, Armenian, Hebrew, Arabic, Syriac, Indic, Ethiopic,
#: Mongolian and East Asian writing.
MARKS = ".!?…:;," + "·;" + "։՜՝՞" + "׃" + "،؛؟۔" + "܀܂" + "।॥" + "።፣፤፥፦፧" + "᠂᠃" + "。！？，、；：｡､" + "‼⁇⁈⁉—–"
MARK = rf"""[{MARKS}]["'”’»)\]]*(\s|$)"""
#: Thai, Lao, Tibetan, Burmese and Khmer part sentences by spaces or by marks inside the run of letters.
UNMARKED = "\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff"
#: Most of a document's characters (white space aside) that failing lines may take with them.
MAX_LOST = 0.3


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def line_fails(line: Column) -> Column:
    """True for a line that is navigation, boilerplate, symbols or shouting, or a long one without punctuation."""
    # each rule begins with a cheap test that spares most lines its patterns
    n = F.regexp_count(line, F.lit(WORD))
    bars = F.regexp_count(line, F.lit(rf"(^|\s)[{SEPARATORS}](\s|$)"))
    navigation = (_count_of(line, SEPARATORS) >= 3) & (bars >= 3) & (bars * 4 >= n)
    boilerplate = (F.char_length(line) <= BOILERPLATE_CHARS) & line.rlike(BOILERPLATE)
    symbols = line.rlike(f"[{SYMBOLS}]") & (_count_of(line, SYMBOLS) * 10 > _chars(line))
    shouting = F.contains(line, F.lit("!!")) & (F.regexp_count(line, F.lit(r"!!(\s|$)")) * 3 > n)
    unmarked = ~line.rlike(MARK) & (n >= SENTENCE_WORDS) & ~line.rlike(f"[{UNMARKED}]")
    return navigation | boilerplate | symbols | shouting | unmarked


def _chars(text: Column) -> Column:
    return F.char_length(F.translate(text, " \t\n\x0b\x0c\r", ""))


def _count_of(text: Column, chars: str) -> Column:
    """How often any of the characters occurs; the pattern spares most texts the slower count."""
    return F.when(text.rlike(f"[{chars}]"), F.char_length(text) - F.char_length(F.translate(text, chars, ""))).otherwise(F.lit(0))


def repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the text, each word once.

    Windows are sorted by a 64-bit hash together with their position, so the work is n log n however much repeats.
    """

    def marked(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))
        return _let(F.sort_array(windows), starts)

    def starts(s: Column) -> Column:
        def same(k: Column, h: Column) -> Column:
            return F.coalesce(F.get(s, k)["h"] == h, F.lit(False))

        hit = F.transform(s, lambda x, k: F.when(same(k - 1, x["h"]) | same(k + 1, x["h"]), x["i"]))
        return _let(F.sort_array(F.array_compact(hit)), covered)

    def covered(p: Column) -> Column:
        reach = F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3))))
        return F.aggregate(reach, F.lit(0), lambda a, x: a + x)

    return F.when(F.size(words) >= 4, _let(words, marked)).otherwise(F.lit(0)).cast("long")


def measure(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, cleaned and kept.

    cleaned is the text without its failing lines (line breaks in between stay); kept is false if base_failed or if the
    failing lines hold more than MAX_LOST of the characters. Null and blank texts count nothing and fail; cleaned stays
    null for a null text. Rows are judged on their own in one narrow pass: repeated rows give repeated results, no row
    leaves its partition, and an empty table gives none. A text of any length is one row in memory with its words and lines. Columns of ``df`` with the names of results are replaced.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    good = F.filter(F.split(t, "\n"), lambda x: ~line_fails(x))
    words = F.col("__words")
    base = df.withColumn("__words", words_of(t)).withColumns(
        {
            "n_words": F.size(words).cast("long"),
            "word_chars": F.char_length(F.array_join(words, "")).cast("long"),
            "n_symbols": _count_of(t, SYMBOLS).cast("long"),
            "n_dup_lines": _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
            "n_repeat_words": repeat_words(words),
            "cleaned": F.when(F.col(text).isNotNull(), F.array_join(good, "\n")),
        }
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    cleaned = F.coalesce("cleaned", F.lit(""))
    left = F.when(cleaned == t, F.col("word_chars")).otherwise(_chars(cleaned))
    lost = F.col("word_chars") - left
    return base.drop("__words").withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (lost <= MAX_LOST * F.col("word_chars")))


def op7_line_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return measure(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql_chars(x: str) -> str:
    return f"length(regexp_replace({x}, '[\\x20\\x09-\\x0D]', '', 'g'))"


def _sql_count(x: str, chars: str) -> str:
    return f"(length({x}) - length(translate({x}, '{chars}', '')))"


def _sql_hits(x: str, pattern: str) -> str:
    quoted = pattern.replace("'", "''")
    return f"len(regexp_extract_all({x}, '{quoted}'))"


_BARS = _sql_hits("x", rf"(^|\s)[{SEPARATORS}](\s|$)")
_FAILS = f"""({_sql_count("x", SEPARATORS)} >= 3 AND {_BARS} >= 3 AND {_BARS} * 4 >= {_sql_hits("x", WORD)}
  OR length(x) <= {BOILERPLATE_CHARS} AND regexp_matches(x, '{BOILERPLATE}')
  OR {_sql_count("x", SYMBOLS)} * 10 > {_sql_chars("x")}
  OR {_sql_hits("x", r"!!(\s|$)")} * 3 > {_sql_hits("x", WORD)}
  OR NOT regexp_matches(x, '{MARK.replace("'", "''")}') AND {_sql_hits("x", WORD)} >= {SENTENCE_WORDS} AND NOT regexp_matches(x, '[{UNMARKED}]'))"""
OP7_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) >= 3),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) > 1 AS again FROM p),
c AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM g WHERE again) GROUP BY doc_id),
b AS (SELECT doc_id, t, len(w) AS n_words, {_sql_chars("t")} AS word_chars, {_sql_count("t", SYMBOLS)} AS n_symbols, coalesce(n, 0) AS n_repeat_words,
  len(list_filter(lines, lambda x: regexp_matches(x, '{WORD}'))) - len(list_distinct(list_filter(lines, lambda x: regexp_matches(x, '{WORD}')))) AS n_dup_lines,
  array_to_string(list_filter(lines, lambda x: NOT {_FAILS}), chr(10)) AS cleaned FROM d LEFT JOIN c USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND word_chars - {_sql_chars("cleaned")} <= {MAX_LOST} * word_chars AS kept FROM b
"""
