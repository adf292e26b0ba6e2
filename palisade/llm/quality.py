"""Quality rules, line first: lines are judged one by one, failures are removed, and a document that loses too much goes.

DataFrame functions only. A line is a part of the text between newlines; lines without a word are neither judged
nor removed. A line with words fails when it

- ``symbols``: has at least one symbol of ``[#*$%&|<>]`` for every two words,
- ``navigation``: is split by two or more bars or arrows with at most four words in a piece on average,
- ``shouting``: has three or more words and letters, all of them capitals,
- ``boilerplate``: holds one of the stock phrases of web pages,
- ``punctuation``: has four or more words and no closing mark at its end.

NULL texts count as empty: no words, rejected as too short. Repeated rows and ties are judged alike, row by row; an
empty table gives an empty table. Extra columns stay; result columns whose names clash get a trailing underscore.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from palisade.llm.common import GAP, WORD, free_name, query, table

# Stock phrases of web pages, matched without regard to case.
PHRASES = (
    "all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service", "click here",
    "enable javascript", "sign up for", "subscribe to our", "lorem ipsum", "powered by", "skip to content",
)
SYMBOLS = r"[#*$%&|<>]"
BARS = "[|»›>]"
CLOSERS = tuple(".!?:;…。！？")
QUOTES = "\"')]»”’"
BLANKS = " \t\n\x0b\f\r"
EDGE = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"
MIN_WORDS, MAX_REPEAT, MAX_LOSS = 50, 0.5, 0.4
FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def words_in(line: Column) -> Column:
    trimmed = F.btrim(line, F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, GAP))


def line_fails(line: Column, n: Column, symbols: Column, any_bar: Column, any_phrase: Column) -> Column:
    """Whether one line of ``n`` words breaks a rule; false for lines without a word.

    ``any_bar`` and ``any_phrase`` say whether the whole text has a bar or a phrase at all; mostly it has not, and
    then no line is searched for one.
    """
    bars = F.length(line) - F.length(F.regexp_replace(line, BARS, ""))
    last = F.substring(F.rtrim(F.rtrim(line, F.lit(BLANKS)), F.lit(QUOTES)), -1, 1)
    return (n > 0) & (
        (symbols * 2 >= n)
        | ((n >= 4) & ~last.isin(*CLOSERS))
        | ((n >= 3) & (F.upper(line) == line) & (F.lower(line) != line))
        | (any_bar & (bars >= 2) & (n <= 4 * (bars + 1)))
        | (any_phrase & F.lower(line).rlike("|".join(PHRASES)))
    )


def judged(docs: DataFrame, text: str = "text", min_words: int = MIN_WORDS, max_repeat: float = MAX_REPEAT,
           max_loss: float = MAX_LOSS) -> DataFrame:
    """Each row of ``docs`` with its counts, the cleaned text, the words lost and the verdict.

    Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, words_lost (long), base_failed and kept
    (boolean) and clean_text. ``kept`` is false when the text has fewer than ``min_words`` words, when more than
    ``max_repeat`` of its words lie in repeated three-word windows, or when failing lines hold more than ``max_loss``
    of its words.

    Words in repeated windows: windows are named by 64-bit hashes. Where a text has equal names at all, sorting
    (name, place) puts them side by side, so the work is n log n for any text, and no row leaves its task.
    """
    name = {c: free_name(docs, c) for c in [*FEATURES, "words_lost", "base_failed", "kept", "clean_text"]}
    t, w, l, c, h, s, has = (free_name(docs, x) for x in ("_t", "_w", "_l", "_c", "_h", "_s", "_has"))
    # Each step is a projection of its own, so that no array is built twice.
    step = docs.withColumn(t, F.coalesce(F.col(f"`{text}`"), F.lit("")))
    step = step.withColumn(has, F.struct(
        F.col(t).rlike(SYMBOLS).alias("symbol"), F.col(t).rlike(BARS).alias("bar"),
        reduce(lambda a, b: a | b, [F.contains(F.lower(t), F.lit(p)) for p in PHRASES]).alias("phrase")))
    step = step.withColumn(l, F.transform(F.split(F.col(t), "\n"), lambda x: F.struct(
        x.alias("line"), words_in(x).alias("words"),
        F.when(F.col(f"{has}.symbol"), F.length(x) - F.length(F.regexp_replace(x, SYMBOLS, ""))).otherwise(0).alias("symbols"))))
    step = step.withColumn(w, F.flatten(F.transform(l, lambda x: x["words"])))
    step = step.withColumn(l, F.transform(l, lambda x: F.struct(
        x["line"].alias("line"), F.size(x["words"]).alias("n"), x["symbols"].alias("symbols"),
        line_fails(x["line"], F.size(x["words"]), x["symbols"], F.col(f"{has}.bar"), F.col(f"{has}.phrase")).alias("bad"))))
    step = step.withColumn(c, F.transform(w, lambda x: F.xxhash64(x)))
    step = step.withColumn(h, F.transform(F.slice(c, 1, F.greatest(F.size(c) - 2, F.lit(0))), lambda x, i: F.xxhash64(
        x, F.get(c, i + 1), F.get(c, i + 2))))
    step = step.withColumn(s, F.when(F.size(F.array_distinct(h)) < F.size(h), F.array_sort(
        F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    pairs = F.arrays_zip(F.slice(s, 1, F.size(s) - 1).alias("a"), F.slice(s, 2, F.size(s) - 1).alias("b"))
    equal = F.filter(pairs, lambda p: p["a"]["h"] == p["b"]["h"])
    places = F.flatten(F.transform(equal, lambda p: F.array(
        p["a"]["i"], p["a"]["i"] + 1, p["a"]["i"] + 2, p["b"]["i"], p["b"]["i"] + 1, p["b"]["i"] + 2)))
    full = F.transform(F.filter(l, lambda x: x["n"] > 0), lambda x: x["line"])
    good = F.transform(F.filter(l, lambda x: ~x["bad"]), lambda x: x["line"])
    total = lambda xs, f: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + f(x))
    step = step.withColumns({
        name["n_words"]: F.size(w).cast("long"),
        name["word_chars"]: F.length(F.array_join(w, "")).cast("long"),
        name["n_symbols"]: total(l, lambda x: x["symbols"]),
        name["n_dup_lines"]: (F.size(full) - F.size(F.array_distinct(full))).cast("long"),
        name["n_repeat_words"]: F.when(F.col(s).isNotNull(), F.size(F.array_distinct(places))).otherwise(0).cast("long"),
        name["words_lost"]: total(l, lambda x: F.when(x["bad"], x["n"]).otherwise(0)),
        name["clean_text"]: F.array_join(good, "\n"),
    })
    count, repeat = F.col(name["n_words"]), F.col(name["n_repeat_words"])
    failed = (count < min_words) | (repeat > count * F.lit(max_repeat))
    kept = ~failed & (F.col(name["words_lost"]) <= count * F.lit(max_loss))
    found = F.struct(*(F.col(name[x]) for x in (*FEATURES, "words_lost", "clean_text")), failed.alias(name["base_failed"]), kept.alias(name["kept"]))
    # inline ends the projections: a later filter on a result is not copied down through all of them
    return step.select(*(f"`{x}`" for x in docs.columns), F.inline(F.array(found)))


ORACLE = f"""
WITH base AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
listed AS (SELECT doc_id, t, regexp_extract_all(t, '{WORD}') AS w, string_split(t, chr(10)) AS l FROM base),
numbered AS (SELECT row_number() OVER () AS rid, * FROM listed),
wins AS (
  SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM numbered WHERE len(w) >= 3)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM wins) WHERE n > 1),
covered AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY rid),
lines AS (
  SELECT rid, line, regexp_replace(line, '{EDGE}', '', 'g') AS trimmed FROM (SELECT rid, unnest(l) AS line FROM numbered)),
counted AS (
  SELECT rid, line, trimmed, len(regexp_extract_all(line, '{WORD}')) AS n,
    length(line) - length(regexp_replace(line, '{SYMBOLS}', '', 'g')) AS symbols,
    length(line) - length(regexp_replace(line, '{BARS}', '', 'g')) AS bars
  FROM lines WHERE trimmed <> ''),
failed AS (
  SELECT rid, sum(n) AS words_lost FROM counted
  WHERE symbols * 2 >= n OR (bars >= 2 AND n <= 4 * (bars + 1)) OR (n >= 3 AND upper(line) = line AND lower(line) <> line)
    OR regexp_matches(lower(line), '{"|".join(PHRASES)}')
    OR (n >= 4 AND NOT regexp_matches(trimmed, '[.!?:;…。！？]["'')\\]»”’]*$'))
  GROUP BY rid),
dups AS (SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines WHERE trimmed <> '' GROUP BY rid),
flat AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '{GAP}', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '{SYMBOLS}', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
    CAST(coalesce(words_lost, 0) AS BIGINT) AS words_lost
  FROM numbered LEFT JOIN covered USING (rid) LEFT JOIN failed USING (rid) LEFT JOIN dups USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, words_lost,
  n_words < {MIN_WORDS} OR 100 * n_repeat_words > {round(100 * MAX_REPEAT)} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {round(100 * MAX_REPEAT)} * n_words)
    AND 10 * words_lost <= {round(10 * MAX_LOSS)} * n_words AS kept
FROM flat
"""


@query("op10_quality_rules", ORACLE)
def op10(spark, sf_dir):
    """Counts and verdict of every document; a verdict needs the base rules and the line rules."""
    done = judged(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", *FEATURES, "words_lost", "base_failed", "kept")
