"""Substring dedup by recompression: words covered by a window that occurs elsewhere, too, are removed.

A window is ``window`` consecutive words of one document. It is repeated when its words also start anywhere else, in
the same document or another; all words of all repeated windows go, judged on the input.

1. Recompression. Round by round, runs of one symbol and then pairs of symbols are replaced by new symbols. A pair is
   joined when a coin of its left symbol says left and that of its right symbol says right; a round joins up to a cap
   of words, and members of longer runs stay as they are. Names are 64-bit codes of what a symbol holds, so all tasks
   give equal strings equal names without an exchange. Whether symbols are joined depends on them alone (and on their
   run), so a round blurs at most its cap of words at either end of a repeated string: 35 words keep at least 23 words
   inside whose symbols are the same wherever they occur.
2. High-level symbols. From each symbol on, symbols are put together until they hold 8 words. In every stretch of 13
   places the one with the smallest name is an anchor; every window has one that its inner words determine. One
   shuffle finds anchors whose name occurs twice. No repeated window is without one.
3. Verification. Windows whose anchor is repeated are compared by 128-bit codes of all their words; one shuffle.
   Exact copies of whole texts are known by their own codes and need no windows but those of the first one.

Names that a task has seen twice in a batch are settled there: one of them goes to the shuffle, the others do not, so
a passage that a third of all documents hold thins out before it meets in one task.

Rows that agree in doc_id and text are different places (both lose their words). NULL and empty texts have no words.
Empty tables give empty results. Columns other than the two named ones are left out.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from palisade.llm.common import WORD, WordCodes, byte_words, mix, query, stored, table

WINDOW, CAPS, REACH = 35, (2, 4), 8
_CODES = WordCodes()
LAST = np.uint64(0xFFFFFFFFFFFFFFFF)


def recompressed(codes: np.ndarray, borders: np.ndarray, caps=CAPS):
    """(name, first word) of the symbols; ``borders``: words that never join (document ends)."""
    name, size, at = codes.copy(), np.ones(len(codes), np.int64), np.arange(len(codes))
    size[borders] = 1 << 20
    for number, cap in enumerate(caps, 1):
        # runs of one symbol
        new = np.ones(len(name), bool)
        new[1:] = name[1:] != name[:-1]
        run = np.cumsum(new) - 1
        count = np.bincount(run)
        first = np.nonzero(new)[0]
        joined = (count > 1) & (count * size[first] <= cap)
        loose = ((count > 1) & ~joined)[run]
        heads = first[joined]
        name[heads] = mix(name[heads] ^ mix(count[joined].astype(np.uint64) + np.uint64(number << 20)))
        size[heads] *= count[joined]
        keep = new | ~joined[run]
        name, size, at, loose = name[keep], size[keep], at[keep], loose[keep]
        # pairs of a left and a right symbol
        left = (mix(name + np.uint64(number * 0x9E3779B97F4A7C15 % (1 << 64))) >> np.uint64(63)).astype(bool)
        pair = left[:-1] & ~left[1:] & ~loose[:-1] & ~loose[1:] & (size[:-1] + size[1:] <= cap)
        heads = np.nonzero(pair)[0]
        name[heads] = mix(mix(name[heads] + np.uint64(number)) * np.uint64(0xC2B2AE3D27D4EB4F) ^ name[heads + 1])
        size[heads] += size[heads + 1]
        keep = np.ones(len(name), bool)
        keep[heads + 1] = False
        name, size, at = name[keep], size[keep], at[keep]
    return name, size, at


def anchors(codes: np.ndarray, borders: np.ndarray, window: int = WINDOW, caps=CAPS, reach: int = REACH):
    """(place of the anchor of the window that begins at each word, name at each word).

    ``codes`` holds the words of many documents, each followed by a border. Places of windows that do not fit into
    their document have no meaning.
    """
    lost = sum(caps)
    span = reach - 1 + max(caps)  # most words of a high-level symbol
    stretch = window - 2 * lost - span + 1
    if stretch < max(caps):
        raise ValueError("the window is too short for these caps")
    name, size, at = recompressed(codes, borders, caps)
    total, high = size.copy(), mix(name)
    for ahead in range(1, reach):
        more = np.zeros(len(name), np.int64)
        more[:-ahead] = np.where(total[:-ahead] < reach, size[ahead:], 0)
        if not more.any():
            break
        high[:-ahead] = np.where(more[:-ahead] > 0, mix(high[:-ahead] * np.uint64(0x9E3779B97F4A7C15) ^ name[ahead:]), high[:-ahead])
        total += more
    names = np.full(len(codes) + window, LAST, np.uint64)
    good = (total >= reach) & (total <= span)
    names[at[good]] = high[good]
    n = len(codes)
    best, place = np.full(n, LAST, np.uint64), np.zeros(n, np.int64)
    for step in range(stretch):
        here = names[lost + step:lost + step + n]
        better = here < best
        best = np.where(better, here, best)
        place = np.where(better, np.arange(lost + step, lost + step + n), place)
    return place, names


def window_codes(codes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit codes of the window from each word on (the first len - window + 1 are meant)."""
    n = len(codes) - window + 1
    out = []
    for salt, base in ((0x1234567, 0x9E3779B97F4A7C15), (0x89ABCDE, 0xD1B54A32D192ED03)):
        powers, backs = (np.full(len(codes), b, np.uint64) for b in (base, pow(base, -1, 1 << 64)))
        powers[0] = backs[0] = 1
        powers, backs = np.cumprod(powers, dtype=np.uint64), np.cumprod(backs, dtype=np.uint64)
        upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(codes + np.uint64(salt)) * powers, dtype=np.uint64)])
        out.append(mix((upto[window:] - upto[:n]) * backs[:n]))
    return out[0], out[1]


class Batch:
    """Words of the texts of a batch in one array, each text followed by a border of its own."""

    def __init__(self, texts: list[str], window: int):
        lists = [byte_words(t) for t in texts]
        n = np.array([len(w) for w in lists], np.int64)
        self.ends = np.cumsum(n + 1) - 1
        self.first = self.ends - n
        border = mix(np.arange(len(lists), dtype=np.uint64) + np.uint64(0xB0BDE2))
        parts = [x for k, w in enumerate(lists) for x in (_CODES.of(w), border[k:k + 1])]
        self.codes = np.concatenate([np.zeros(0, np.uint64), *parts])
        self.doc = np.repeat(np.arange(len(lists)), n + 1)
        self.fits = np.arange(len(self.codes)) + window <= self.ends[self.doc] if len(self.codes) else np.zeros(0, bool)

    def place(self, word: np.ndarray) -> np.ndarray:
        return word - self.first[self.doc[word]]


def settled(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows with these keys: is it the first of its equals, and are there others?"""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    equal = new[1:].copy()
    for key in keys:
        equal &= key[order][1:] == key[order][:-1]
    new[1:] = ~equal
    group = np.cumsum(new) - 1
    many = np.bincount(group)[group] > 1 if len(order) else np.zeros(0, bool)
    first, others = np.empty(len(order), bool), np.empty(len(order), bool)
    first[order], others[order] = new, many
    return first, others


def rows_of(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """d (the id), k and x (together they name a document; never NULL, so that all joins share one shuffle) and t."""
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("d"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    code = F.xxhash64("t").cast("string").substr(-9, 9).cast("int")
    return rows.select("d", F.coalesce("d", F.lit(-(1 << 63))).alias("k"), F.coalesce(code, F.lit(0)).alias("x"), "t")


def found_twice(rows: DataFrame, keys: list[str], kind: str) -> DataFrame:
    """Rows (k, x, i, e) that are settled, or whose keys occur in two rows or in one marked as known.

    ``kind``: 0 unknown, 1 known to have an equal, 2 settled (their keys only spread them).
    """
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(n, keys[0]).sortWithinPartitions(*keys)
    schema = T.StructType([f for f in rows.schema.fields if f.name in ("k", "x", "i", "e")])
    where = {c: rows.columns.index(c) for c in rows.columns}

    def run(batches):
        held = None
        for batch in batches:
            settled_rows = batch.column(where[kind]).to_numpy() == 2
            if settled_rows.any():
                yield out(batch.filter(pa.array(settled_rows)))
            part = pa.Table.from_batches([batch.filter(pa.array(~settled_rows))])
            held = part if held is None else pa.concat_tables([held, part])
            if not held.num_rows:
                continue
            new = changes(held)
            cut = int(np.nonzero(new)[0][-1])
            yield from repeated(held.slice(0, cut), new[:cut])
            held = held.slice(cut)
        if held is not None and held.num_rows:
            yield from repeated(held, changes(held))

    def changes(part):
        new = np.zeros(part.num_rows, bool)
        for k in keys:
            values = part[k].to_numpy()
            new[1:] |= values[1:] != values[:-1]
        new[:1] = True
        return new

    def repeated(part, new):
        if part.num_rows:
            group = np.cumsum(new) - 1
            known = np.bincount(group, part[kind].to_numpy() + 0.5)[group] >= 1
            for batch in part.filter(pa.array(known)).combine_chunks().to_batches():
                yield out(batch)

    def out(batch):
        return pa.record_batch([batch.column(where[f.name]) for f in schema.fields], names=[f.name for f in schema.fields])

    return dealt.mapInArrow(run, schema)


def anchor_rows(rows: DataFrame, window: int) -> DataFrame:
    """key, kind, k, x, i: the anchors of all documents."""

    def run(batches):
        for batch in batches:
            b = Batch(batch.column(2).to_pylist(), window)
            if not b.fits.any():
                continue
            place, names = anchors(b.codes, b.ends, window)
            at = np.unique(place[b.fits])
            key = names[at]
            first, others = settled(key)
            kind = np.where(first, others.astype(np.int32), 2)
            key = np.where(kind == 2, mix(at.astype(np.uint64) ^ key), key)
            owner = pa.array(b.doc[at])
            yield pa.record_batch(
                [pa.array(key.view(np.int64)), pa.array(kind.astype(np.int32)), batch.column(0).take(owner), batch.column(1).take(owner),
                 pa.array(b.place(at).astype(np.int32))], names=["key", "kind", "k", "x", "i"])

    return rows.mapInArrow(run, "key long, kind int, k long, x int, i int")


def window_rows(rows: DataFrame, window: int) -> DataFrame:
    """k1, k2, kind, k, x, i, e: windows with a repeated anchor; settled ones as stretches from i to e."""

    def run(batches):
        for batch in batches:
            b = Batch(batch.column(2).to_pylist(), window)
            hot = batch.column(3)
            marked = np.zeros(len(b.codes) + window, bool)
            marked[hot.flatten().to_numpy() + np.repeat(b.first, np.diff(hot.offsets.to_numpy()))] = True
            if not b.fits.any():
                continue
            place, _ = anchors(b.codes, b.ends, window)
            at = np.nonzero(b.fits & marked[place])[0]
            if not len(at):
                continue
            one, two = (c[at] for c in window_codes(b.codes, window))
            first, others = settled(one, two)
            sure = at[others]
            # stretches of consecutive settled windows
            new = np.ones(len(sure), bool)
            new[1:] = (sure[1:] != sure[:-1] + 1) | (b.doc[sure[1:]] != b.doc[sure[:-1]])
            start = sure[new]
            end = sure[np.append(np.nonzero(new)[0][1:] - 1, len(sure) - 1)] if len(sure) else sure
            word = np.concatenate([at[first], start])
            stop = np.concatenate([at[first], end])
            kind = np.concatenate([others[first].astype(np.int32), np.full(len(start), 2, np.int32)])
            spread = mix(start.astype(np.uint64) + one[:1])
            owner = pa.array(b.doc[word])
            yield pa.record_batch(
                [pa.array(np.concatenate([one[first], spread]).view(np.int64)), pa.array(np.concatenate([two[first], spread]).view(np.int64)),
                 pa.array(kind), batch.column(0).take(owner), batch.column(1).take(owner),
                 pa.array(b.place(word).astype(np.int32)), pa.array(b.place(stop).astype(np.int32))],
                names=["k1", "k2", "kind", "k", "x", "i", "e"])

    return rows.mapInArrow(run, "k1 long, k2 long, kind int, k long, x int, i int, e int")


def removed_stretches(rows: DataFrame, window: int) -> DataFrame:
    """k, x, gone: array of (i, e), first and last start of repeated windows. Whole copies: from 0 to the largest int."""
    place = ["k", "x"]
    digest = rows.select(*place, F.xxhash64("t").alias("a"), F.xxhash64(F.lit(1), "t").alias("b"))
    digest = stored(digest.where("a <> xxhash64('')"), "digests")
    twice = stored(digest.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*place)).alias("f")).where("n > 1"), "twice")
    copies = stored(digest.join(twice, ["a", "b"]).select(*place, (F.struct(*place) == F.col("f")).alias("first")), "copies")
    later = copies.where("NOT first").select(*place).distinct()

    hot = found_twice(anchor_rows(rows.select(*place, "t"), window), ["key"], "kind").join(later, place, "left_anti")
    hot = stored(hot.groupBy(*place).agg(F.collect_set("i").alias("hot")), "hot")
    asked = rows.join(hot, place).select(*place, "t", "hot", "d")
    found = found_twice(window_rows(asked, window), ["k1", "k2"], "kind")
    whole = copies.select(*place, F.lit(0).alias("i"), F.lit((1 << 31) - 1).alias("e"))
    return found.unionByName(whole).groupBy(*place).agg(F.collect_set(F.struct("i", "e")).alias("gone"))


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words that stay, joined by one space) of every row."""
    rows = rows_of(docs, doc_id, text)
    gone = removed_stretches(rows, window)
    both = rows.join(gone, ["k", "x"], "left").select("d", "t", "gone")

    def run(batches):
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for t, stretches in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words, lost = byte_words(t), 0
                if stretches and len(words) >= window:
                    mark = np.zeros(len(words) + 1, np.int64)
                    for s in stretches:
                        mark[s["i"]] += 1
                        mark[min(s["e"] + window, len(words))] -= 1
                    stay = np.cumsum(mark)[:-1] == 0
                    lost, left = int((~stay).sum()), [w for w, s in zip(words, stay) if s]
                else:
                    left = words
                n_words.append(len(words))
                n_removed.append(lost)
                kept.append(b" ".join(left))
            yield pa.record_batch(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept"])

    return both.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


ORACLE = f"""
WITH lists AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
wins AS (SELECT r, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM lists WHERE len(w) >= {WINDOW})),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY g) AS n FROM wins) WHERE n > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + {WINDOW})) AS p FROM twice),
lost AS (SELECT r, count(*) AS n, list(p) AS ps FROM gone GROUP BY r),
each AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM lists),
kept AS (SELECT e.r, string_agg(word, ' ' ORDER BY e.p) AS t FROM each e LEFT JOIN gone g ON e.r = g.r AND e.p = g.p WHERE g.p IS NULL GROUP BY e.r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM lists LEFT JOIN lost ON lists.r = lost.r LEFT JOIN kept ON lists.r = kept.r
"""


@query("op6_substring_dedup", ORACLE)
def op6(spark, sf_dir):
    """Every document without the words of repeated windows: numbers of words and a digest of what stays."""
    done = deduplicated(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
