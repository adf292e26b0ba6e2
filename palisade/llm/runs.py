"""Periodic runs of words by an online sparse dynamic program over diagonals.

A run is a stretch of words with smallest period q (words q apart are equal) of at least max(``least``, ``times`` * q) words
that no neighbour extends. On the diagonal of lag q it is a row of matches word i = word i - q: ``length - q`` of them.

The program reads the words once and keeps, for each active lag, the number of matches up to here. A word that equals the
one its lag before lengthens that diagonal; one that differs ends it, and a diagonal that was long enough gives its run at
once. Listing all earlier occurrences of each word would be quadratic for frequent words, so only those that can begin a
run open a lag: with a gram of g >= q words inside a run of smallest period q, the nearest earlier occurrence of the gram
is exactly q words back (a nearer one would give the stretch a smaller period). So grams of 8, 16, 32, ... words serve the
periods up to 8, 9-16, 17-32, ..., each word looks at the nearest earlier occurrence of its gram only, and a run of 3 * q
words has one such word at least. Grams are named by 64-bit codes, doubled from level to level, and a place whose gram is
single in its text drops out, so text without repeats costs one sort. A lag that opens at level g is the smallest period
of its stretch by the same argument.

Work and memory of a task are linear in a batch of texts (times the levels that still repeat); nothing is shuffled. NULL and empty
texts have no words and no runs; repeated rows are judged alike; equal exponents: the smallest start, then period; an
empty table gives an empty table; columns other than the two named ones are left out.
"""

from collections import defaultdict
from fractions import Fraction
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from palisade.llm.common import GAP, WORD, byte_words, mix, query, table

LEAST, TIMES = 24, 3  # words of the shortest run, periods of the shortest run
GRAM = 8  # words of the shortest gram; runs of period up to 8 have 24 words, so 9 of their grams repeat
ODD = np.uint64(0x9E3779B97F4A7C15)


def paired(left, right):
    return mix(left * ODD + mix(right))


def openings(ids: np.ndarray, ends: np.ndarray):
    """Places and lags at which a run may be under way: the nearest earlier occurrence of the gram, by level.

    ``ids`` holds the words of several texts, ``ends`` for each word where its text ends.
    """
    starts = np.r_[0, np.unique(ends)][:-1] if len(ids) else np.empty(0, np.int64)
    size = ends - starts[np.searchsorted(starts, np.arange(len(ids)), "right") - 1]
    code = mix(ids.astype(np.uint64) + (ends.astype(np.uint64) << np.uint64(32)))
    gram = 1
    while gram < GRAM:
        code = paired(code, np.r_[code[gram:], code[:gram]])
        gram *= 2
    at = np.flatnonzero((np.arange(len(ids)) + gram <= ends) & (size >= LEAST))
    low, out = 0, []
    while len(at):
        order = np.argsort(code[at], kind="stable")
        place, value = at[order], code[at][order]
        same = value[1:] == value[:-1]
        lag = place[1:] - place[:-1]
        mine = same & (lag > low) & (lag <= gram)
        out.append(np.c_[place[1:][mine], lag[mine]])
        repeated = np.zeros(len(ids) + 1, bool)
        repeated[place[np.r_[same, False] | np.r_[False, same]]] = True
        at = np.flatnonzero(repeated)
        at = at[(at + 2 * gram <= ends[at]) & (size[at] > TIMES * gram)]
        at = at[repeated[at + gram]]
        longer = np.zeros(len(ids), np.uint64)
        longer[at] = paired(code[at], code[at + gram])
        code, low, gram = longer, gram, 2 * gram
    found = np.concatenate(out) if out else np.empty((0, 2), np.int64)
    found = found[np.lexsort((found[:, 0], found[:, 1]))]
    # one opening for consecutive places with the same lag
    fresh = np.ones(len(found), bool)
    fresh[1:] = (np.diff(found[:, 0]) != 1) | (np.diff(found[:, 1]) != 0)
    found = found[fresh]
    return found[np.lexsort((found[:, 1], found[:, 0]))]


def runs_of(words: list, opened: list, least: int = LEAST, times: int = TIMES) -> list[tuple]:
    """(start, length, period) by start, then period: one step a word over the active lags."""
    active, found, n = {}, [], len(words)  # lag: matches on its diagonal up to here
    i = k = 0
    while active or k < len(opened):
        if not active:
            i = opened[k][0]
        while k < len(opened) and opened[k][0] == i:
            lag = opened[k][1]
            k += 1
            if lag not in active:
                back = i
                while back > lag and words[back - 1] == words[back - 1 - lag]:
                    back -= 1
                active[lag] = i - back
        for lag in list(active):
            if i < n and words[i] == words[i - lag]:
                active[lag] += 1
                continue
            length = active.pop(lag) + lag
            if length >= max(least, times * lag):
                found.append((i - length, length, lag))
        i += 1
    return sorted((s, length, q) for s, length, q in found)


def strongest(runs: list[tuple]):
    """The run with the greatest length / period; ties: the smallest start, then period."""
    return max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)


def collapsed(words: list[bytes], runs: list[tuple]) -> str:
    """The words without what a run repeats after its first period, joined by one space."""
    dropped = bytearray(len(words))
    for start, length, period in runs:
        dropped[start + period:start + length] = b"\1" * (length - period)
    return b" ".join(w for w, gone in zip(words, dropped) if not gone).decode()


def periodic_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, runs (start, length, period), strongest (one of them or NULL) and collapsed_text."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("t"))
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    named = lambda r: r and dict(zip(("start", "length", "period"), r))

    def scan(batches):
        for batch in batches:
            known = defaultdict(count().__next__)
            texts = [byte_words(t) for t in batch.column(1).to_pylist()]
            sizes = np.array([len(t) for t in texts], np.int64)
            ids = np.fromiter(map(known.__getitem__, chain.from_iterable(texts)), np.int64, int(sizes.sum()))
            until = np.cumsum(sizes)
            opened = openings(ids, np.repeat(until, sizes))
            first = np.searchsorted(opened[:, 0], until - sizes)
            last = np.searchsorted(opened[:, 0], until)
            runs, best, kept = [], [], []
            for words, a, b, end in zip(texts, first, last, until):
                mine = []
                if a < b:
                    begin = end - len(words)
                    mine = runs_of(ids[begin:end].tolist(), (opened[a:b] - [begin, 0]).tolist())
                runs.append([named(r) for r in mine])
                best.append(named(strongest(mine)))
                kept.append(collapsed(words, mine))
            yield pa.record_batch(
                [batch.column(0), pa.array(sizes), pa.array(runs, pa.list_(run)), pa.array(best, run), pa.array(kept, pa.string())],
                names=["doc_id", "n_words", "runs", "strongest", "collapsed_text"])

    one = "struct<start: long, length: long, period: long>"
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(scan, f"doc_id {kind}, n_words long, runs array<{one}>, strongest {one}, collapsed_text string")


def folded(docs: DataFrame) -> DataFrame:
    """doc_id and text of the query's input: one document in ten repeats its words from a place on."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    parts = F.filter(F.split(F.coalesce("text", F.lit("")), GAP), lambda w: w != "")
    chosen = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, parts).alias("w"))
    g, n = F.floor(F.col("h") / 10).cast("long"), F.size("w").cast("long")
    placed = chosen.withColumn("a", g % F.greatest(n, F.lit(1)))
    placed = placed.withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + g % 8)).cast("long"))
    word = lambda w, i: F.when(i >= F.col("a"), F.get("w", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))).otherwise(w)
    text = F.when(F.col("w").isNull() | (n <= 0), F.col("text")).otherwise(F.array_join(F.transform("w", word), " "))
    return placed.select("doc_id", text.alias("text"))


ORACLE = rf"""
WITH texts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS o, CAST(doc_id AS VARCHAR) AS s FROM documents),
bits AS (
  SELECT doc_id, o, flatten(list_transform(range(1, len(s) + 1), lambda i: list_transform(range(8), lambda k: (ascii(s[i]) >> CAST(k AS INTEGER)) & 1))) AS b
  FROM texts),
hashed AS (
  SELECT doc_id, o, CAST(len(o) AS BIGINT) AS n, xor(4294967295, list_reduce(
    list_concat([CAST(4294967295 AS BIGINT)], list_transform(b, lambda x: CAST(x AS BIGINT))),
    lambda c, x: xor(c >> 1, CASE WHEN xor(c, x) & 1 = 1 THEN 3988292384 ELSE 0 END))) AS h FROM bits),
placed AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n END AS a FROM hashed),
periods AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM placed),
folded AS (
  SELECT doc_id, n, CASE WHEN a IS NULL THEN o
    ELSE list_transform(range(n), lambda i: CASE WHEN i >= a THEN o[a + (i - a) % p + 1] ELSE o[i + 1] END) END AS w FROM periods),
words AS (SELECT doc_id, n, unnest(w) AS word, unnest(range(n)) AS i FROM folded WHERE n >= {LEAST}),
matches AS (
  SELECT x.doc_id, x.i, x.i - y.i AS q FROM words x JOIN words y
    ON x.doc_id = y.doc_id AND x.word = y.word AND y.i < x.i AND {TIMES} * (x.i - y.i) <= x.n),
islands AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS pos FROM matches),
diagonals AS (
  SELECT doc_id, q, min(i) - q AS s, count(*) + q AS m FROM islands GROUP BY doc_id, q, pos
  HAVING count(*) + q >= greatest({LEAST}, {TIMES} * q)),
runs AS (
  SELECT d.* FROM diagonals d WHERE NOT EXISTS (
    SELECT 1 FROM diagonals e WHERE e.doc_id = d.doc_id AND e.q < d.q AND e.s <= d.s AND e.s + e.m >= d.s + d.m)),
named AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || m || ',' || q || chr(10), '' ORDER BY s, q) AS listed FROM runs GROUP BY doc_id),
ranked AS (
  SELECT r.doc_id, r.s, r.m, r.q, row_number() OVER (PARTITION BY r.doc_id ORDER BY (CAST(r.m AS DOUBLE) / r.q) DESC, r.s, r.q) AS k FROM runs r),
dropped AS (SELECT doc_id, list(DISTINCT i) AS gone FROM (SELECT doc_id, unnest(range(s + q, s + m)) AS i FROM runs) GROUP BY doc_id)
SELECT f.doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(r.s AS BIGINT) AS "start", CAST(r.m AS BIGINT) AS length,
  CAST(r.q AS BIGINT) AS period, CAST(1000 * r.m // r.q AS BIGINT) AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN f.w
    ELSE list_transform(list_filter(range(f.n), lambda i: NOT list_contains(gone, i)), lambda i: f.w[i + 1]) END, ' ')) AS collapsed_sha256
FROM folded f LEFT JOIN named USING (doc_id) LEFT JOIN (SELECT * FROM ranked WHERE k = 1) r USING (doc_id) LEFT JOIN dropped USING (doc_id)
"""


@query("op13_periodic_runs", ORACLE)
def op13(spark, sf_dir):
    """Periodic runs of every document: number, the strongest one, digests of all runs and of the collapsed text."""
    done = periodic_runs(folded(table(spark, sf_dir, "documents")))
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    best = F.col("strongest")
    return done.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"),
        best["period"].alias("period"), F.floor(1000 * best["length"] / best["period"]).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed_text", 256).alias("collapsed_sha256"))
