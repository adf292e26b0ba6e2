"""Benchmark decontamination: CGK random-walk embedding, bit-sampling LSH, exact edit verification.

Texts are compared as sequences of words (runs of letters, digits and underscores, lower case). A document is
contaminated by an item of n words when a passage of it, of whatever length (``spans``, as op3 and the pipeline ask), is
within k = ``edits * n`` insertions, deletions and replacements of the item, rounded down; items of fewer than six words
must occur exactly. Items without a word match nothing. Without ``spans`` a passage is a window of exactly n words
(shorter only at the end of the document), which a net insertion or deletion costs about two edits.

1. Windows: k edits destroy at most 3k of the n - 2 three-word grams of an item, so a passage needs n - 2 - 3k grams
   that occur in some item. One pass counts such grams in n + k words; only windows of n words that begin where such a
   passage may begin go on. This loses nothing.
2. Embedding: a walk over 3n steps copies the word under its pointer and moves on or stays, as a random bit of (step,
   word) says. Two sequences that differ by few edits fall into step again, so their walks differ in few places.
3. LSH: a table's key is a few sampled places of a walk. Walks are added until the share of edited copies (the allowed
   number of random edits in items of the benchmark) that meet their item in some table reaches ``recall``; it is
   measured on ``trials`` copies.
4. Every candidate is verified by its exact edit distance (bit-parallel); with ``spans`` the text from k words before to
   k words behind the windows that met an item is searched for the nearest passage, with free start and end.

The benchmark is taken in blocks of about ``block_chars`` characters, each sent to all tasks; all rows meet all blocks.
Document rows never move. NULL and empty texts match nothing; repeated rows get equal results; extra columns stay and
a clashing result name gets a trailing underscore. Empty tables give empty results.
"""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from palisade.llm.common import free_name, mix, query, table

TOKEN = re.compile(r"\w+")
EDITS, RECALL, SAMPLE, PER_WALK, TRIALS, BLOCK_CHARS = 0.2, 0.995, 3, 4, 400, 4_000_000
CHUNK, MOST_WALKS = 4096, 24  # windows embedded at once; walks at most
MATCH = T.ArrayType(T.StructType([
    T.StructField("item_id", T.LongType()), T.StructField("distance", T.IntegerType()), T.StructField("start", T.IntegerType())]))


def words(text: str | None) -> list[str]:
    return TOKEN.findall((text or "").lower())


def allowed(n: int, edits: float) -> int:
    return int(edits * n + 1e-9) if n >= 6 else 0


class Vocabulary(dict):
    def __missing__(self, word):
        return -1


def distance(a, b) -> int:
    """Edit distance of two sequences, one machine operation for a row of the table."""
    m = len(b)
    if not m:
        return len(a)
    where: dict = {}
    for k, c in enumerate(b):
        where[c] = where.get(c, 0) | 1 << k
    full, top, up, down, score = (1 << m) - 1, 1 << (m - 1), (1 << m) - 1, 0, m
    for c in a:
        eq = where.get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph, mh = (down | ~(xh | up)) & full, up & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = (ph << 1 | 1) & full, mh << 1 & full
        up, down = (mh | ~(xv | ph)) & full, ph & xv
    return score


def nearest(text, item) -> tuple[int, int]:
    """(distance, start) of the passage of ``text`` that is nearest to ``item``, the first one of equals.

    Both are read backwards, so that the score at a place is that of the best passage which begins there.
    """
    m = len(item)
    where: dict = {}
    for k, c in enumerate(reversed(item)):
        where[c] = where.get(c, 0) | 1 << k
    full, top, up, down, score = (1 << m) - 1, 1 << (m - 1), (1 << m) - 1, 0, m
    best = (m, 0)
    for start in reversed(range(len(text))):
        eq = where.get(text[start], 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph, mh = (down | ~(xh | up)) & full, up & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = ph << 1 & full, mh << 1 & full
        up, down = (mh | ~(xv | ph)) & full, ph & xv
        if score <= best[0]:
            best = (score, start)
    return best


class Index:
    """All that a task needs for one block of items."""

    def __init__(self, items: list[tuple[int, str]], edits: float = EDITS, recall: float = RECALL, trials: int = TRIALS, seed: int = 7,
                 spans: bool = False):
        self.edits, self.seed, self.spans, self.vocabulary = edits, seed, spans, Vocabulary()
        self.ids, self.words = [], []
        for item_id, text in items:
            found = words(text)
            if found:
                self.ids.append(item_id)
                self.words.append([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in found])
        self.longest, self.drawn = max(map(len, self.words), default=0), {}
        self.lengths = np.array([len(w) for w in self.words], np.int64)
        self.width = np.minimum(3, self.lengths)
        self.most = np.array([allowed(n, edits) for n in self.lengths.tolist()], np.int64)
        self.slack = self.most if spans else np.zeros_like(self.most)  # words of a passage beyond those of its item
        self.need = np.maximum(1, self.lengths - self.width + 1 - self.width * self.most)
        # grams of each width with the items that hold them: sorted codes, first posting of each, postings
        self.grams = {}
        for q in sorted(set(self.width.tolist())):
            posts = sorted({(self.code(w[k:k + q]), i) for i, w in enumerate(self.words) if self.width[i] == q
                            for k in range(len(w) - q + 1)})
            codes, first = np.unique(np.array([c for c, _ in posts], np.int64), return_index=True)
            self.grams[q] = codes, np.append(first, len(posts)), np.array([i for _, i in posts], np.int64)
        self.walks = 0
        if self.words:
            self.calibrate(recall, trials)
        keys, owners = [], []
        if self.words:
            matrix, lengths = self.matrix(self.words)
            for first in range(0, len(matrix), CHUNK):
                part = self.keys(matrix[first:first + CHUNK], lengths[first:first + CHUNK], self.walks)
                keys.append(part.ravel())
                owners.append(np.repeat(np.arange(first, first + len(part)), part.shape[1]))
        self.key = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        owner = np.concatenate(owners) if owners else np.zeros(0, np.int64)
        order = np.argsort(self.key, kind="stable")
        self.key, self.owner = self.key[order], owner[order]

    def code(self, gram) -> int:
        made = 0
        for w in gram:
            made = made * 2_000_003 + w + 1
        return made % (1 << 62)

    def codes(self, ids: np.ndarray, q: int) -> np.ndarray:
        """Codes of the grams that begin at each place; -1 where a word is unknown."""
        n = len(ids) - q + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        made, known = np.zeros(n, np.int64), np.ones(n, bool)
        for k in range(q):
            part = ids[k:k + n]
            made = (made * 2_000_003 + part + 1) & ((1 << 62) - 1)
            known &= part >= 0
        return np.where(known, made, -1)

    def matrix(self, lists) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.array([len(w) for w in lists])
        out = np.full((len(lists), self.longest), -3, np.int64)
        for k, w in enumerate(lists):
            out[k, :len(w)] = w
        return out, lengths

    def places(self, size: int) -> np.ndarray:
        """(walk, table, sample) places in walks of 3 * size steps."""
        if size not in self.drawn:
            draw = np.random.default_rng([self.seed, size])
            self.drawn[size] = np.sort(draw.integers(0, 3 * size, (MOST_WALKS, PER_WALK, SAMPLE)), axis=2)
        return self.drawn[size]

    def keys(self, matrix: np.ndarray, sizes: np.ndarray, walks: int) -> np.ndarray:
        """(row, walk and table) keys; ``sizes`` are the sizes of the items that the rows are held against."""
        rows, steps, limit = len(matrix), 3 * int(sizes.max()), matrix.shape[1]
        at = np.zeros((rows, walks), np.int64)
        line = np.arange(rows)[:, None]
        salt = mix(np.arange(1, walks + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(self.seed))[None, :]
        seen = np.empty((rows, walks, steps), np.int32)
        for step in range(steps):
            word = np.where(at < limit, matrix[line, np.minimum(at, limit - 1)], -3)
            seen[:, :, step] = word
            turn = np.uint64((step + 1) * 0xA0761D6478BD642F % (1 << 64))
            bits = mix((word.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + turn) ^ salt)
            at += (bits >> np.uint64(63)).astype(np.int64)
        known, which = np.unique(sizes, return_inverse=True)
        places = np.stack([self.places(int(n))[:walks] for n in known])[which]
        picked = seen[line[:, :, None, None], np.arange(walks)[None, :, None, None], places].astype(np.int64).astype(np.uint64)
        table_no = np.arange(walks * PER_WALK, dtype=np.uint64).reshape(1, walks, PER_WALK)
        code = mix(sizes.astype(np.uint64)[:, None, None] * np.uint64(0x9E3779B97F4A7C15) + table_no + np.uint64(1))
        for sample in range(SAMPLE):
            code = mix(code ^ picked[:, :, :, sample])
        return code.reshape(rows, walks * PER_WALK)

    def calibrate(self, recall: float, trials: int) -> None:
        """Choose the number of walks by edited copies of items."""
        draw = np.random.default_rng(self.seed)
        able = [k for k, w in enumerate(self.words) if allowed(len(w), self.edits)]
        if not able:
            self.walks, self.measured = 1, 1.0
            return
        chosen = [able[k] for k in draw.integers(0, len(able), trials)]
        copies = []
        for k in chosen:
            w, n = list(self.words[k]), len(self.words[k])
            for _ in range(allowed(n, self.edits)):
                kind, place = draw.integers(0, 3), int(draw.integers(0, len(w)))
                other = int(draw.integers(0, len(self.vocabulary)))
                w[place:place + (kind != 0)] = [] if kind == 2 else [other]
            copies.append((w + [-1] * n)[:n])
        sizes = np.array([len(self.words[k]) for k in chosen])
        step = 4
        own, _ = self.matrix([self.words[k] for k in chosen])
        edited, _ = self.matrix(copies)
        same = self.keys(own, sizes, MOST_WALKS) == self.keys(edited, sizes, MOST_WALKS)
        for walks in range(step, MOST_WALKS + 1, step):
            met = same[:, :walks * PER_WALK].any(axis=1)
            self.walks, self.measured = walks, float(met.mean())
            if self.measured >= recall:
                break

    def search(self, texts: list[str | None]) -> list[list[dict]]:
        """Matches of each text: the nearest passage of each item that is near enough."""
        lists = [words(t) for t in texts]
        ids = [np.fromiter(map(self.vocabulary.__getitem__, w), np.int64, len(w)) for w in lists]
        found: list[dict] = [{} for _ in texts]
        if self.words and texts:
            whole = np.concatenate([x for w in ids for x in (w, np.array([-2]))])
            ends = np.cumsum([len(w) + 1 for w in ids]) - 1  # place of each separator
            self.verify(whole, ends, *self.windows(whole, ends), found)
        return [[{"item_id": self.ids[k], "distance": d, "start": s} for k, (d, s) in sorted(f.items())] for f in found]

    def windows(self, whole: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, size) of the windows that may begin a passage with as many grams of one item as a near copy must have."""
        out = []
        for q, (grams, first, posts) in self.grams.items():
            codes = self.codes(whole, q)
            spot = np.minimum(np.searchsorted(grams, codes), len(grams) - 1)
            place = np.nonzero(grams[spot] == codes)[0]
            spot = spot[place]
            many = first[spot + 1] - first[spot]
            item = posts[np.repeat(first[spot], many) + ranges(many)]
            place = np.repeat(place, many)
            doc = np.searchsorted(ends, place)
            order = np.lexsort((place, item, doc))
            place, item, doc = place[order], item[order], doc[order]
            last = np.arange(len(place)) + self.need[item] - 1
            safe = np.minimum(last, max(len(place) - 1, 0))
            size, most = self.lengths[item], self.lengths[item] + self.slack[item]
            good = (last < len(place)) & (item[safe] == item) & (doc[safe] == doc) & (place[safe] - place <= most - q)
            low = np.maximum(place[safe] + q - most, np.concatenate([[0], ends + 1])[doc])[good]
            high, size = place[good], size[good]
            span = np.maximum(high - low + 1, 0)
            out.append(np.stack([np.repeat(low, span) + ranges(span), np.repeat(size, span)], axis=1))
        both = np.unique(np.concatenate(out), axis=0)
        return both[:, 0], both[:, 1]

    def verify(self, whole, ends, starts, size, found) -> None:
        """Embed the windows, look their keys up and measure every pair that meets in a table."""
        doc = np.searchsorted(ends, starts)
        length = np.minimum(size, ends[doc] - starts)
        base = np.concatenate([[0], ends + 1])
        met: dict = {}  # (document, item): starts of windows that met
        column = np.arange(self.longest)[None, :]
        for first in range(0, len(starts), CHUNK):
            s, n, d, z = (x[first:first + CHUNK] for x in (starts, length, doc, size))
            matrix = np.where(column < n[:, None], whole[np.minimum(s[:, None] + column, len(whole) - 1)], -3)
            keys = self.keys(matrix, z, self.walks)
            low, high = np.searchsorted(self.key, keys, "left"), np.searchsorted(self.key, keys, "right")
            pairs = set()
            for row, col in zip(*np.nonzero(high > low)):
                pairs.update((int(row), int(o)) for o in self.owner[low[row, col]:high[row, col]])
            for row, item in sorted(pairs):
                most = int(self.most[item])
                if len(self.words[item]) != z[row] or abs(int(n[row] - z[row])) > most:
                    continue
                if self.spans:
                    met.setdefault((int(d[row]), item), []).append(int(s[row]))
                    continue
                apart = distance(matrix[row, :n[row]].tolist(), self.words[item])
                best = (apart, int(s[row] - base[d[row]]))
                if apart <= most and best < found[d[row]].get(item, (most + 1, 0)):
                    found[d[row]][item] = best
        for (row, item), at in met.items():
            most, reach = int(self.most[item]), int(self.lengths[item] + self.most[item])
            best, first = (most + 1, 0), 0
            for k in range(1, len(at) + 1):  # stretches of text whose windows overlap are searched at once
                if k < len(at) and at[k] - most <= at[k - 1] + reach:
                    continue
                low, high = max(at[first] - most, int(base[row])), min(at[k - 1] + reach, int(ends[row]))
                apart, start = nearest(whole[low:high].tolist(), self.words[item])
                best, first = min(best, (apart, low - int(base[row]) + start)), k
            if best[0] <= most:
                found[row][item] = best


def ranges(counts: np.ndarray) -> np.ndarray:
    """0 .. n-1 for each n of ``counts``, one behind the other."""
    total = int(counts.sum())
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)


def blocks(benchmark: DataFrame, item_id: str, text: str, block_chars: int):
    """Lists of (id, text), each about as long as the bound."""
    rows = benchmark.select(F.col(f"`{item_id}`").cast("long").alias("i"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    total = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    count = int(total // block_chars) + 1
    for block in range(count):
        mine = rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(count)) == block)
        yield sorted(((r.i, r.t) for r in mine.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))


def matched(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
            edits: float = EDITS, recall: float = RECALL, block_chars: int = BLOCK_CHARS, out: str = "matches",
            spans: bool = False) -> DataFrame:
    """``docs`` with ``matches``: array of (item_id, distance, start) with the nearest passage of each item."""
    name = free_name(docs, out)
    done, at = docs.withColumn(name, F.array().cast(MATCH)), docs.columns.index(text)
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("start", pa.int32())]))
    for items in blocks(benchmark, item_id, item_text, block_chars):
        sent = docs.sparkSession.sparkContext.broadcast(Index(items, edits, recall, spans=spans))

        def run(batches, sent=sent):
            for batch in batches:
                old, new = batch.column(batch.num_columns - 1).to_pylist(), sent.value.search(batch.column(at).to_pylist())
                merged = pa.array([a + b for a, b in zip(old, new)], kind)
                yield pa.record_batch([*batch.columns[:-1], merged], names=batch.schema.names)

        done = done.mapInArrow(run, done.schema)
    return done


@query("op3_decontamination")
def op3(spark, sf_dir):
    """Documents with passages of benchmark items: one row for each document and item, with the nearest passage."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = matched(docs, table(spark, sf_dir, "benchmark"), spans=True)
    return found.select("doc_id", F.explode("matches").alias("m")).select(
        "doc_id", "m.item_id", F.col("m.distance").cast("long").alias("distance"), F.col("m.start").cast("long").alias("start"))
