"""Line dedup with a suffix array over line-id sequences, sorted by distributed prefix doubling.

Lines without a word are no content: they are kept and not counted. Documents are ordered by doc_id (NULL first) and a
hash of their text, lines by their place. A run of consecutive lines is a copy when it holds at least ``min_words``
words and the same run of lines begins earlier in that order, in the same document or another. All lines of copies are
deleted; every deleted line has an equal line before it that stays. By default one line with a word is a run.

1. Line ids: equal lines get the same rank. A line that occurs once ends every run, so only repeated lines go on.
2. Prefix doubling: the rank of 2n lines from a place on is the place of the pair (rank of n lines here, rank of n
   lines n places on) in the sorted list of all distinct pairs. A round is one sort of distinct pairs and a join; nothing
   but ranks moves. Runs that occur once are told apart and leave. It ends when no run is left that occurs twice,
   whatever ``min_words`` is.
3. A run of 2^k lines that is not the first of its rank is a copy. A copy of any length is the union of the two largest
   such runs that it begins and ends with. Where these hold too few words, the shortest windows with ``min_words`` words
   from each first line forwards and from each last line backwards, named by two ranks, find it.
4. The lines below a copy are those that the furthest end of the copies begun so far lies behind.

Rows that agree in doc_id and text count as one document and get the same result. NULL and empty texts have no lines to
delete. Extra columns stay; result names that clash get a trailing underscore. Empty tables give empty tables.
"""

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from palisade.llm.common import GAP, WORD, free_name, query, stored, table

MIN_WORDS = 1  # one line with a word is a run; a larger least length is the caller's option
PLACE = ["d", "x", "j"]


def numbered_lines(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """d, x (document), j (place among lines with a word), i (place among all), a, b (128-bit content), n (words)."""
    words = lambda line: F.size(F.filter(F.split(line, GAP), lambda w: w != ""))
    listed = F.transform(F.split(F.col("t"), "\n"), lambda line, i: F.struct(line.alias("line"), i.alias("i")))
    rows = docs.select(F.col(f"`{doc_id}`").alias("d"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    each = rows.select("d", F.xxhash64("t").alias("x"), F.posexplode(F.filter(listed, lambda s: s["line"].rlike(WORD))).alias("j", "s"))
    return each.select(
        "d", "x", F.col("j").cast("long").alias("j"), F.col("s.i").alias("i"), F.xxhash64("s.line").alias("a"),
        F.xxhash64(F.lit(1), "s.line").alias("b"), words(F.col("s.line")).alias("n"))


def ranked(pairs: DataFrame, name: str) -> DataFrame:
    """Distinct (a, b) with a rank that grows in their order; stored, so that ranks never change."""
    ordered = pairs.orderBy("a", "b")
    return stored(ordered.withColumn("r", F.monotonically_increasing_id()), name)


def repeated_lines(lines: DataFrame) -> DataFrame:
    """Lines whose content occurs more than once: d, x, j, i, n, the rank r of the line, and whether it is a later one."""
    # documents that agree in id and text are one
    lines = lines.dropDuplicates(PLACE)
    lines = stored(lines, "lines")
    return stored(with_ranks(lines, "ids").select(*PLACE, "i", "n", "r", "later"), "repeated")


def with_ranks(pairs: DataFrame, name: str) -> DataFrame:
    """Rows whose (a, b) occurs more than once, with its rank r, and whether the row is not its first place."""
    groups = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct(*PLACE)).alias("first"))
    ranks = ranked(groups.where("c > 1").select("a", "b", "first"), name)
    return pairs.join(ranks, ["a", "b"]).withColumn("later", ~F.struct(*PLACE).eqNullSafe(F.col("first")))


def doubled(level: DataFrame, size: int, name: str) -> DataFrame:
    """d, x, j, n, r, later for repeated runs of twice ``size`` lines, from the ranks of runs of ``size`` lines."""
    ahead = Window.partitionBy("d", "x").orderBy("j").rangeBetween(size, size)
    pairs = level.select(*PLACE, (F.col("n") + F.first("n").over(ahead)).alias("n"), F.col("r").alias("a"),
                         F.first("r").over(ahead).alias("b")).where("b IS NOT NULL")
    pairs = stored(pairs, name)
    return stored(with_ranks(pairs, name).select(*PLACE, "n", "r", "later"), name)


def doublings(repeated: DataFrame) -> list[DataFrame]:
    """Repeated runs of 1, 2, 4, ... lines, up to the last length that has some."""
    levels, level, size = [], repeated.select(*PLACE, F.col("n").cast("long").alias("n"), "r", "later"), 1
    while not level.isEmpty():
        levels.append(level)
        level = doubled(level, size, f"level{len(levels)}")
        size *= 2
    return levels


def shortest_windows(repeated: DataFrame, min_words: int) -> DataFrame:
    """d, x, j, len: shortest windows of repeated lines with enough words, from each first and from each last line."""
    rows = repeated.groupBy("d", "x").agg(F.sort_array(F.collect_list(F.struct("j", "n"))).alias("l"))
    kind = repeated.schema["d"].dataType

    def find(batches):
        for batch in batches:
            out = []
            for row, lines in enumerate(batch.column(2).to_pylist()):
                out += [(row, j, n) for j, n in windows([(s["j"], s["n"]) for s in lines], min_words)]
            rows_at = pa.array([o[0] for o in out], pa.int64())
            yield pa.record_batch(
                [batch.column(0).take(rows_at), batch.column(1).take(rows_at), pa.array([o[1] for o in out], pa.int64()),
                 pa.array([o[2] for o in out], pa.int64())], names=["d", "x", "j", "len"])

    return rows.mapInArrow(find, f"d {kind.simpleString()}, x long, j long, len long")


def windows(lines: list[tuple[int, int]], min_words: int) -> set[tuple[int, int]]:
    """(first line, lines) of the shortest windows; places that are not consecutive end a window."""
    found, at = set(), 0
    while at < len(lines):
        end = at + 1
        while end < len(lines) and lines[end][0] == lines[end - 1][0] + 1:
            end += 1
        j, n = [x[0] for x in lines[at:end]], [x[1] for x in lines[at:end]]
        total, last = 0, 0  # words of [first, last)
        for first in range(len(j)):
            while total < min_words and last < len(j):
                total, last = total + n[last], last + 1
            if total < min_words:
                break
            found.add((j[first], last - first))
            total -= n[first]
        total, first = 0, len(j) - 1  # words of (first, last]
        for last in reversed(range(len(j))):
            while total < min_words and first >= 0:
                total, first = total + n[first], first - 1
            if total < min_words:
                break
            found.add((j[first + 1], last - first))
            total -= n[last]
        at = end
    return found


def copies(repeated: DataFrame, min_words: int) -> DataFrame:
    """d, x, j, len of runs with enough words that begin earlier, too; together they hold all lines of copies."""
    levels = doublings(repeated)
    if not levels:
        return repeated.select(*PLACE, F.lit(0).cast("long").alias("len")).where("false")
    found, ranks = None, None
    for k, level in enumerate(levels):
        later = level.where(F.col("later") & (F.col("n") >= min_words)).select(*PLACE, F.lit(2 ** k).cast("long").alias("len"))
        named = level.select(F.lit(k).alias("k"), *PLACE, "r")
        found, ranks = (later, named) if found is None else (found.unionByName(later), ranks.unionByName(named))
    # with one word as the least, every run of 1, 2, 4, ... lines holds enough
    return found if min_words <= 1 else found.unionByName(copied_windows(repeated, ranks, min_words))


def copied_windows(repeated: DataFrame, ranks: DataFrame, min_words: int) -> DataFrame:
    """d, x, j, len of the shortest windows that begin earlier, too."""
    found = shortest_windows(repeated, min_words)
    # a window is named by the ranks of the two largest runs that it begins and ends with
    k = F.floor(F.log2("len") + F.lit(1e-9)).cast("int")
    named = found.withColumn("k", k).withColumn("j2", F.col("j") + F.col("len") - F.expr("shiftleft(1L, k)"))

    def with_rank(df, place, name):
        side = ranks.select(*(F.col(c).alias(f"_{c}") for c in ("k", *PLACE)), F.col("r").alias(name))
        on = (df.d.eqNullSafe(side["_d"])) & (df.x == side["_x"]) & (df[place] == side["_j"]) & (df.k == side["_k"])
        return df.join(side, on).drop("_k", "_d", "_x", "_j")

    named = stored(with_rank(with_rank(named, "j", "a"), "j2", "b"), "named")
    groups = stored(named.groupBy("len", "a", "b").agg(
        F.count(F.lit(1)).alias("c"), F.min(F.struct(*PLACE)).alias("first")).where("c > 1"), "groups")
    joined = named.join(groups, ["len", "a", "b"])
    return joined.where(~F.struct(*PLACE).eqNullSafe(F.col("first"))).select(*PLACE, "len")


def covered(repeated: DataFrame, gone: DataFrame) -> DataFrame:
    """d, x, i of the lines inside of runs; a line inside of a run is a repeated one."""
    begun = Window.partitionBy("d", "x").orderBy("j").rangeBetween(Window.unboundedPreceding, 0)
    rows = repeated.select(*PLACE, "i", F.lit(None).cast("long").alias("end")).unionByName(
        gone.select(*PLACE, F.lit(None).cast("int").alias("i"), (F.col("j") + F.col("len")).alias("end")))
    return rows.withColumn("end", F.max("end").over(begun)).where("i IS NOT NULL AND end > j").select("d", "x", "i")


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with kept_text, n_lines (lines with a word) and n_removed."""
    name = {c: free_name(docs, c) for c in ("kept_text", "n_lines", "n_removed")}
    repeated = repeated_lines(numbered_lines(docs, doc_id, text))
    gone = copies(repeated, min_words)
    lost = stored(covered(repeated, gone).groupBy("d", "x").agg(F.collect_list("i").alias("lost")), "lost")

    d, x, t = F.col(f"`{doc_id}`"), free_name(docs, "_x"), free_name(docs, "_t")
    read = docs.withColumn(t, F.coalesce(F.col(f"`{text}`"), F.lit("")))
    read = read.withColumn(x, F.xxhash64(F.col(t)))
    gone, gone_d, gone_x = (free_name(read, c) for c in ("_lost", "_lost_d", "_lost_x"))
    lost = lost.select(F.col("d").alias(gone_d), F.col("x").alias(gone_x), F.col("lost").alias(gone))
    done = read.join(lost, d.eqNullSafe(F.col(gone_d)) & (F.col(x) == F.col(gone_x)), "left")
    lines = F.split(F.col(t), "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    kept = F.when(F.col(gone).isNull(), F.col(t)).otherwise(F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n"))
    return done.withColumns({
        name["kept_text"]: kept,
        name["n_lines"]: F.size(F.filter(lines, lambda line: line.rlike(WORD))).cast("long"),
        name["n_removed"]: F.coalesce(F.size(gone), F.lit(0)).cast("long"),
    }).drop(x, t, gone, gone_d, gone_x)


ORACLE = f"""
WITH base AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
full_lines AS (SELECT doc_id, l, list_filter(range(1, len(l) + 1), lambda i: regexp_matches(l[i], '{WORD}')) AS pos FROM base),
lists AS (SELECT doc_id, l, pos, list_transform(pos, lambda i: l[i]) AS f FROM full_lines),
each AS (SELECT doc_id, j, pos[j] AS i, len(regexp_extract_all(f[j], '{WORD}')) AS n FROM (SELECT *, unnest(range(1, len(pos) + 1)) AS j FROM lists)),
sums AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY j) AS upto FROM each),
spans AS (
  SELECT a.doc_id, a.j AS s, min(b.j) AS e FROM sums a JOIN sums b
    ON a.doc_id = b.doc_id AND b.j BETWEEN a.j AND a.j + {MIN_WORDS} AND b.upto - a.upto + a.n >= {MIN_WORDS} GROUP BY a.doc_id, a.j
  UNION
  SELECT b.doc_id, max(a.j), b.j FROM sums a JOIN sums b
    ON a.doc_id = b.doc_id AND a.j BETWEEN b.j - {MIN_WORDS} AND b.j AND b.upto - a.upto + a.n >= {MIN_WORDS} GROUP BY b.doc_id, b.j),
keyed AS (SELECT s.*, f[s:e] AS run FROM spans s JOIN lists USING (doc_id)),
later AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, s) AS k FROM keyed) WHERE k > 1),
lost AS (SELECT DISTINCT doc_id, unnest(range(s, e + 1)) AS j FROM later),
gone AS (SELECT doc_id, list(i) AS gone FROM lost JOIN each USING (doc_id, j) GROUP BY doc_id),
kept AS (
  SELECT doc_id, len(pos) AS n_lines, coalesce(len(gone), 0) AS n_removed,
    array_to_string(list_transform(list_filter(range(1, len(l) + 1), lambda i: NOT list_contains(coalesce(gone, []), i)), lambda i: l[i]), chr(10)) AS t
  FROM lists LEFT JOIN gone USING (doc_id))
SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_removed AS BIGINT) AS n_removed, CAST(length(t) AS BIGINT) AS kept_chars,
  sha256(t) AS kept_sha256 FROM kept
"""


@query("op1_line_dedup", ORACLE)
def op1(spark, sf_dir):
    """Every document without the line runs that occur earlier: numbers of lines and a digest of what stays."""
    done = deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select(
        "doc_id", "n_lines", "n_removed", F.length("kept_text").cast("long").alias("kept_chars"),
        F.sha2("kept_text", 256).alias("kept_sha256"))
