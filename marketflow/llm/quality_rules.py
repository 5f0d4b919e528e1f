"""Line-first quality rules, as DataFrame expressions only.

Every line of a text is judged by punctuation, navigation and boilerplate rules; failing lines are
removed; a document is rejected when it fails a base rule or loses more than half of its characters.

Defined cases: a null or empty text has no words, counts 0 everywhere, fails the base rule (fewer than
``MIN_WORDS`` words) and is not kept; its clean text is empty. Rows are judged one by one, so repeated
rows give repeated results and an empty table an empty result. Columns of the input keep their place
(``quality_rules`` adds its own under the names below and replaces columns of the same name).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_WORDS = 50
#: Per cent of words in repeated three-word windows above which a text fails.
MAX_REPEAT_PCT = 50
#: Per cent of characters that line cleaning may take before a text is rejected.
MAX_LOST_PCT = 50
#: White space between words (a fixed value of the contract).
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
SEPARATORS = "|>»›•·"
BOILERPLATE = ("all rights reserved", "privacy policy", "terms of use", "terms of service", "cookie policy",
               "accept cookies", "use of cookies", "enable javascript", "lorem ipsum", "click here",
               "sign up for our newsletter", "subscribe to our newsletter")
NAVIGATION = ("home", "menu", "search", "login", "log in", "sign in", "sign up", "register", "next", "previous",
              "back to top", "skip to content", "read more", "share", "contact us", "about us", "sitemap")
MARKS = r"[#*$%&|<>{}\\^~=»›•·]|!!"
PUNCTUATION = "[.!?…,;:。]"
#: Bits of a packed window key that hold its position (texts of up to 16 million words).
_POS_BITS = 24

COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "clean_text")


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def _bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it in ``body`` (a one-element array as a let-binding)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    trimmed = F.trim(text, F.lit(SPACES))
    return F.when(F.length(trimmed) == 0, F.array().cast("array<string>")).otherwise(
        F.split(trimmed, "[\\x20\\x09-\\x0D]+", -1))


def line_fails(line: Column) -> Column:
    """Punctuation, navigation and boilerplate rules on one line.

    Cheap tests come first, so that an ordinary line costs one scan for the marks the rules count.
    """
    count = lambda chars: F.length(line) - F.length(_without(line, chars))
    low = F.lower(F.trim(line, F.lit(SPACES)))
    n = F.length(line)
    bangs = n - F.length(F.replace(line, F.lit("!!"), F.lit("!")))
    marked = line.rlike(MARKS) & (((count(SYMBOLS + "{}\\^~=") + bangs) * 8 > n)
                                  | ((count(SEPARATORS) >= 3) & (count(SEPARATORS) * 25 > n)))
    unpunctuated = (n > 100) & ~line.rlike(PUNCTUATION)
    boilerplate = F.lit(False)
    for phrase in BOILERPLATE:
        boilerplate = boilerplate | F.contains(low, F.lit(phrase))
    return marked | unpunctuated | ((n < 40) & low.isin(*NAVIGATION)) | ((n < 200) & boilerplate)


def _repeat_words(words: Column) -> Column:
    """Words inside three-word windows that occur at least twice.

    Windows become packed longs (hash, position) that are sorted once; equal neighbours, confirmed on
    the words themselves, are the repeated windows; their union is measured from the sorted positions.
    """
    mask = (1 << _POS_BITS) - 1

    def same(w, a, b):
        p, q = a.bitwiseAND(F.lit(mask)).cast("int"), b.bitwiseAND(F.lit(mask)).cast("int")
        return ((F.shiftright(a, _POS_BITS) == F.shiftright(b, _POS_BITS)) & (F.get(w, p) == F.get(w, q))
                & (F.get(w, p + 1) == F.get(w, q + 1)) & (F.get(w, p + 2) == F.get(w, q + 2)))

    def windows(w):
        pack = lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).bitwiseAND(
            F.lit(~mask)).bitwiseOR(i.cast("long"))
        keys = F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - 3), pack))
        return _bind(keys, lambda k: F.sort_array(F.transform(
            F.filter(k, lambda x, j: F.coalesce(same(w, x, F.get(k, j + 1)), F.lit(False))
                     | ((j > 0) & F.coalesce(same(w, x, F.get(k, F.greatest(j - 1, F.lit(0)))), F.lit(False)))),
            lambda x: x.bitwiseAND(F.lit(mask)))))

    start = F.struct(F.lit(-3).cast("long").alias("last"), F.lit(0).cast("long").alias("n"))
    covered = lambda pos: F.aggregate(pos, start, lambda acc, p: F.struct(
        p.alias("last"), (acc["n"] + F.least(F.lit(3).cast("long"), p - acc["last"])).alias("n")), lambda acc: acc["n"])
    return _bind(words, lambda w: F.when(F.size(w) < 4, F.lit(0).cast("long")).otherwise(covered(windows(w))))


def quality_rules(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` plus the columns of ``COLUMNS`` (see the module text)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    has_word = lambda x: F.length(_without(x, SPACES)) > 0
    lines = F.split(text, "\n", -1)
    counted = docs.drop(*COLUMNS).withColumns({
        "__m": _bind(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeat_words(w).alias("r"))),
        "word_chars": F.length(_without(text, SPACES)).cast("long"),
        "n_symbols": (F.length(text) - F.length(_without(text, SYMBOLS))).cast("long"),
        "n_dup_lines": _bind(F.filter(lines, has_word), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "clean_text": F.array_join(F.filter(lines, lambda x: ~line_fails(x)), "\n"),
    })
    n, repeated = F.col("__m.n"), F.col("__m.r")
    left = F.when(F.col("clean_text") == text, F.col("word_chars")).otherwise(
        F.length(_without(F.col("clean_text"), SPACES)))
    judged = counted.withColumns({
        "n_words": n, "n_repeat_words": repeated,
        "base_failed": (n < MIN_WORDS) | (100 * repeated > MAX_REPEAT_PCT * n),
        "__lost": (100 * (F.col("word_chars") - left)) > MAX_LOST_PCT * F.col("word_chars"),
    })
    return judged.withColumn("kept", ~F.col("base_failed") & ~F.col("__lost")).drop("__m", "__lost")


def _sql(table: str) -> str:
    """DuckDB SQL of doc_id, base counts, verdict and clean text over ``table`` (doc_id, text)."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    ws = r"[\x20\x09-\x0D]"
    bare = f"regexp_replace(x, '{ws}', '', 'g')"
    count = lambda chars: f"(length(x) - length(regexp_replace(x, '[{chars}]', '', 'g')))"
    low = f"lower(regexp_replace(x, '^{ws}+|{ws}+$', '', 'g'))"
    boiler = " OR ".join(f"contains({low}, {q(p)})" for p in BOILERPLATE)
    fails = f"""(({count('#*$%&|<>{}' + chr(92) * 2 + '^~=')} + length(x) - length(replace(x, '!!', '!'))) * 8 > length(x)
        OR ({count('|>»›•·')} >= 3 AND {count('|>»›•·')} * 25 > length(x))
        OR (length(x) > 100 AND NOT regexp_matches(x, '{PUNCTUATION}'))
        OR (length(x) < 40 AND {low} IN ({', '.join(map(q, NAVIGATION))}))
        OR (length(x) < 200 AND ({boiler})))"""
    return f"""
    WITH base AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM {table}),
    w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words FROM base),
    tri AS (SELECT rid, unnest(range(1, len(words) - 1)) AS p, words FROM w),
    tr AS (SELECT rid, p, count(*) OVER (PARTITION BY rid, words[p], words[p + 1], words[p + 2]) AS c FROM tri),
    rep AS (SELECT rid, count(DISTINCT p + k) AS n_repeat_words FROM tr, (VALUES (0), (1), (2)) v(k) WHERE c > 1 GROUP BY rid),
    m AS (SELECT w.rid, doc_id, len(words)::BIGINT AS n_words,
        length(regexp_replace(text, '{ws}', '', 'g'))::BIGINT AS word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (len(list_filter(string_split(text, chr(10)), lambda x: length({bare}) > 0))
         - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: length({bare}) > 0))))::BIGINT AS n_dup_lines,
        coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
        coalesce(array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT {fails}), chr(10)), '') AS clean_text
        FROM w LEFT JOIN rep USING (rid)),
    f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PCT} * n_words AS base_failed FROM m)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
        NOT base_failed AND NOT (100 * (word_chars - length(regexp_replace(clean_text, '{ws}', '', 'g')))
            > {MAX_LOST_PCT} * word_chars) AS kept, clean_text FROM f"""


ORACLE = f"SELECT * EXCLUDE (clean_text) FROM ({_sql('documents')})"
