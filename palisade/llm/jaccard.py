"""N-gram Jaccard join with count-vector R-trees.

Words are runs of anything but ASCII white space, A-Z lower-cased; a document's set holds its distinct shingles of
``width`` words (with fewer words the whole sequence, without words nothing). Two documents link when their sets have
a Jaccard similarity of at least ``percent`` / 100. The result has one row per document with its class; links between
copies are not listed.

Tokens are hashed into groups, and a document is the point of its counts per group. The overlap of two sets is at most
the sum of the smaller counts, and so is the overlap with anything in a tree node, by the node's largest counts. In
that many dimensions the boxes of one tree over all documents overlap, and a search would visit most of it. So the
trees are built in blocks that lose no link:

- Sizes fall into bands. A pair of a band differs in at most k shingles, so with more than k groups some group holds
  the same shingles in both: documents with the same content of a group form a block. The number of groups leaves room
  for groups that are empty, for every size that uses the band; a document that still has no more full groups than a
  partner may differ in also joins a block of such documents.
- Blocks with the same members are one.
- In a block the members are packed into an R-tree by their counts (sort-tile, largest spread first). Gathering rounds
  come first: each member asks for the smallest member of its block that the bound admits; links are verified exactly
  and form classes; then one member of each class in a block asks in the same way. A block is cut into parts of bounded size there, and parts grow together through their classes. So a clique
  of near copies costs about one candidate per member.
- What gathering has not joined is decided by a last round in the blocks that still hold several classes: every member
  outside the largest class of its block asks in all parts for all members of other classes. No link is lost.

Copies of one text that a task meets are represented by the first of them, so a large group of copies is thinned out
before the shuffle. Shingles are compared by 64-bit codes. Rows are told apart by doc_id (repeated ids are united by
their smallest class). NULL ids and texts: a NULL text has an empty set; rows with a NULL id are left out of the join
and get no class. Empty tables give empty results. Extra columns stay; clashing result names get an underscore.
"""

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from palisade.llm.common import WORD, discard, free_name, mix, query, stored, table
from palisade.llm.components import components

WIDTH, PERCENT, LEAF, PART_ROWS = 4, 85, 32, 2_000
MOST_TURNS = 2  # gathering rounds; what they leave is for the last round
FEWEST, MOST, PER_GROUP = 64, 8192, 4  # groups of a point, and shingles per group between the two
FINER = 32  # groups of the finer point of the last round, for each group of the point
LONG, BLOCK = 64, 1 << 15  # bytes of a word that is coded by itself, words coded at a time
SPACES = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
POWERS = np.cumprod(np.full(LONG, 0x9E3779B97F4A7C15, np.uint64))
LETTERS = np.where(SPACES, np.uint64(0), mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)))


class Bands:
    """Size bands and the number of groups of each."""

    def __init__(self, percent: int, ratio: float = 1.5, largest: int = 1 << 40):
        self.percent, low = percent, [1]
        while low[-1] < largest:
            low.append(int(low[-1] * max(ratio, 100 / percent + 0.05)) + 1)
        self.low = np.array(low, np.int64)
        self.high = self.low[1:] - 1
        self.groups = np.array([self.enough(int(a), int(b)) for a, b in zip(self.low, self.high)], np.int64)

    def differ(self, n, high):
        """Shingles at most in which a set of ``n`` and a partner of at most ``high`` differ."""
        return (n + np.minimum(high, 100 * n // self.percent)) * (100 - self.percent) // (100 + self.percent)

    def enough(self, low: int, high: int) -> int:
        """Groups of a band, so that sets of every size that uses it have more full ones than they may differ in.

        Four deviations of the number of full groups are left; at most 64 groups a shingle, where that cannot be reached.
        """
        if self.differ(high, high) == 0:
            return 1

        def fits(groups: int, n: int) -> bool:
            load = n / groups
            empty = math.exp(-load)
            spread = math.sqrt(max(0.0, groups * (empty - (1 + load) * empty * empty)))
            return groups * -math.expm1(-load) - 4 * spread >= self.differ(n, high) + 1

        least = 2
        for n in (max(1, -(-low * self.percent // 100)), low, high):
            few, many = least - 1, least
            while many < 64 * high and not fits(many, n):
                few, many = many, 2 * many
            while many - few > 1:
                half = (few + many) // 2
                few, many = (few, half) if fits(half, n) else (half, many)
            least = max(least, min(many, 64 * high))
        return least

    def of(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.low, n, "right") - 1


def word_codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(codes of all words, words of each text); equal words have equal 64-bit codes in every task.

    The code of a word adds up a number for each byte times a power for its place; a word of more than ``LONG`` bytes has
    a hash of its own.
    """
    import xxhash

    parts = [(t or "").encode().lower() for t in texts]  # bytes: A-Z only
    whole = np.frombuffer(b" ".join([*parts, b""]), np.uint8)
    ends = np.cumsum(np.array([len(p) + 1 for p in parts], np.int64))
    inside = np.concatenate([[False], ~SPACES[whole], [False]])  # ASCII white space only
    turns = np.flatnonzero(inside[1:] != inside[:-1])
    starts, stops = turns[::2], turns[1::2]
    size = stops - starts
    codes = np.empty(len(starts), np.uint64)
    short = np.flatnonzero(size <= LONG)
    for at in range(0, len(short), BLOCK):
        some = short[at:at + BLOCK]
        first = np.cumsum(size[some]) - size[some]
        place = np.arange(first[-1] + size[some[-1]]) - np.repeat(first, size[some])
        letters = whole[np.repeat(starts[some], size[some]) + place]
        codes[some] = mix(np.add.reduceat(LETTERS[letters] * POWERS[place], first))
    for k in np.flatnonzero(size > LONG).tolist():
        codes[k] = xxhash.xxh3_64_intdigest(whole[starts[k]:stops[k]].tobytes())
    return codes, np.diff(np.searchsorted(starts, ends), prepend=0)


def shingle_sets(texts: list[str | None], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, code) of the distinct shingles of each text, sorted by row and code."""
    codes, n = word_codes(texts)
    row = np.repeat(np.arange(len(n)), n)
    first = np.cumsum(n) - n
    place = np.arange(len(codes)) - first[row]
    size = np.minimum(width, n)[row]  # words of the shingle that begins here, if it fits
    begins = place + size <= n[row]
    made = mix(size.astype(np.uint64) + np.uint64(0x51ED27))
    for k in range(width):
        ahead = np.zeros(len(codes), np.uint64)
        ahead[:max(0, len(codes) - k)] = codes[k:]
        made = np.where(k < size, mix(made * np.uint64(0x9E3779B97F4A7C15) ^ ahead), made)
    row, made = row[begins], made[begins]
    order = np.argsort(made)
    kind = np.uint16 if len(n) < 1 << 16 else np.int64  # short numbers are sorted by their digits
    order = order[np.argsort(row[order].astype(kind), kind="stable")]
    row, made = row[order], made[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (made[1:] != made[:-1])
    return row[new], made[new]


def sums(values: np.ndarray, slot: np.ndarray, size: int) -> np.ndarray:
    """64-bit content of each slot, whatever the order of its values."""
    low = np.bincount(slot, (values & np.uint64(0xFFFFFFFF)).astype(np.float64), size).astype(np.uint64)
    high = np.bincount(slot, (values >> np.uint64(32)).astype(np.float64), size).astype(np.uint64)
    return mix(low * np.uint64(0x9E3779B97F4A7C15) + mix(high + np.uint64(0xC2B2AE35)))


def block_keys(row: np.ndarray, code: np.ndarray, n: np.ndarray, bands: Bands, band: np.ndarray):
    """(row, key) of the blocks of each document in its ``band`` (-1: none)."""
    groups = np.where(band >= 0, bands.groups[np.maximum(band, 0)], 0)
    first = np.cumsum(groups) - groups
    use = groups[row] > 0
    row, code = row[use], code[use]
    group = (mix(code ^ np.uint64(0xA5A5A5A5)) % np.maximum(groups[row], 1).astype(np.uint64)).astype(np.int64)
    slot, total = first[row] + group, int(groups.sum())
    count, content = np.bincount(slot, minlength=total), sums(mix(code), slot, total)
    owner = np.repeat(np.arange(len(n)), groups)
    number = (np.arange(total) - first[owner]).astype(np.uint64)
    key = mix(content + number * np.uint64(0x632BE59BD9B4E019) + band[owner].astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
    full = count > 0
    empties = np.bincount(owner[~full], minlength=len(n))
    odd = np.nonzero((band >= 0) & (groups - empties <= bands.differ(n, bands.high[np.maximum(band, 0)])))[0]
    spare = mix(band[odd].astype(np.uint64) + np.uint64(0xE7037ED1A0B428DB))
    return np.concatenate([owner[full], odd]), np.concatenate([key[full], spare])


def keyed(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """key, doc, n, rep: one row with n and rep (first copy that the task met) for each document, (key, doc) for blocks."""

    def run(batches):
        bands, seen = Bands(percent), {}
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            row, code = shingle_sets(batch.column(1).to_pylist(), width)
            n = np.bincount(row, minlength=len(ids))
            whole = sums(mix(code), row, len(ids))
            rep = ids.copy()
            fresh = np.zeros(len(ids), bool)
            if len(seen) > 500_000:
                seen.clear()
            for k in range(len(ids)):
                if n[k]:
                    rep[k] = seen.setdefault((int(whole[k]), int(n[k])), int(ids[k]))
                    fresh[k] = rep[k] == ids[k]
            own = np.where(fresh, bands.of(np.maximum(n, 1)), -1)
            above = np.where(fresh & (100 * n >= percent * bands.low[own + 1]), own + 1, -1)
            rows, keys = zip(*(block_keys(row, code, n, bands, b) for b in (own, above)))
            rows, keys = np.concatenate(rows), np.concatenate(keys)
            listed = np.arange(len(ids) + len(rows)) < len(ids)
            yield pa.record_batch([
                pa.array(np.concatenate([np.zeros(len(ids), np.uint64), keys]).view(np.int64), mask=listed),
                pa.array(np.concatenate([ids, ids[rows]])),
                pa.array(np.concatenate([n, np.zeros(len(rows), np.int64)]), mask=~listed),
                pa.array(np.concatenate([rep, np.zeros(len(rows), np.int64)]), mask=~listed)], names=["key", "doc", "n", "rep"])

    return docs.mapInArrow(run, "key long, doc long, n long, rep long")


def blocks(rows: DataFrame) -> DataFrame:
    """The document rows, and (key, doc) of blocks with two members or more, the key being a name of the member set.

    ``rows`` are read twice. Most keys have one member only; they are told by the smallest and largest member and go first,
    so that nothing else of them is shuffled. Names are aggregates of hashes of the members, added up before they are
    shuffled, and are joined back: no task needs a whole block, and a join can split a key that many documents share.
    """
    keys = rows.where("rep IS NULL").select("key", "doc")
    several = keys.groupBy("key").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high")
    shared = stored(keys.join(several.select("key"), "key", "left_semi"), "shared")
    code = F.xxhash64("doc")
    names = shared.groupBy("key").agg(
        F.min("doc").alias("low"), F.max("doc").alias("high"), F.bit_xor(code).alias("x"), F.sum(F.shiftright(code, 32)).alias("s"))
    names = names.select(F.col("key").alias("_key"), F.xxhash64("low", "high", "x", "s").alias("name"))
    named = shared.join(names, shared["key"] == names["_key"]).select(F.col("name").alias("key"), "doc").distinct()
    return rows.where("rep IS NOT NULL").unionByName(named, allowMissingColumns=True)


class RTree:
    """Points of one block; nodes keep the largest counts, the sizes and the smallest id below them."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, ids: np.ndarray, percent: int, leaf: int = LEAF):
        self.points, self.sizes, self.ids, self.t, self.leaf = points, sizes, ids, percent, leaf
        self.root = self.build(np.arange(len(ids)))

    def build(self, at: np.ndarray):
        points, sizes = self.points[at], self.sizes[at]
        top = (points.max(axis=0), int(sizes.min()), int(sizes.max()), int(self.ids[at].min()))
        if len(at) <= self.leaf:
            return (*top, at, None)
        axis = int(np.argmax(points.max(axis=0) - points.min(axis=0)))
        order = at[np.argsort(points[:, axis], kind="stable")]
        half = len(order) // 2
        below = sorted((self.build(order[:half]), self.build(order[half:])), key=lambda node: node[3])
        return (*top, None, below)

    def search(self, point: np.ndarray, size: int, smallest: bool) -> np.ndarray:
        """Members whose bound admits a link; with ``smallest`` only the one with the smallest id."""
        found, best, todo = [], None, [self.root]
        t = self.t
        while todo:
            top, least, most, first, at, below = todo.pop()
            if best is not None and first >= best[0]:
                continue
            if 100 * most < t * size or 100 * size < t * least:
                continue
            if (100 + t) * int(np.minimum(point, top).sum()) < t * (size + least):
                continue
            if below:
                todo += below[::-1]
                continue
            other = self.sizes[at]
            bound = np.minimum(self.points[at], point).sum(axis=1)
            good = at[((100 + t) * bound >= t * (size + other)) & (100 * np.minimum(other, size) >= t * np.maximum(other, size))]
            if not len(good):
                continue
            if smallest:
                k = good[np.argmin(self.ids[good])]
                best = min(best, (int(self.ids[k]), k)) if best else (int(self.ids[k]), k)
            else:
                found.append(good)
        if smallest:
            return np.array([best[1]] if best else [], np.int64)
        return np.concatenate(found) if found else np.zeros(0, np.int64)


def candidate_pairs(members: DataFrame, points: DataFrame, percent: int, smallest: bool) -> DataFrame:
    """Distinct (a, b), a < b, of different classes that the trees of the blocks admit.

    ``members``: key, doc, class, c (members of the block) and asks. With ``smallest`` each asks in its own part for the
    smallest member that it may link to; otherwise each that asks does so in all parts, for all members. What the trees
    admit there must also fit by the finer points: the bound of the trees leaves a share of all pairs of a large group.
    """
    columns = ["point"] if smallest else ["point", "fine"]
    dealt = members.withColumn("parts", F.ceil(F.col("c") / PART_ROWS).cast("int"))
    dealt = dealt.withColumn("home", F.pmod(F.xxhash64("doc"), F.col("parts")).cast("int"))
    if smallest:
        dealt = dealt.select("key", "doc", "class", "asks", F.col("home").alias("part"), F.lit(True).alias("kept"))
    else:
        at = F.when(F.col("asks"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array("home"))
        dealt = dealt.select("key", "doc", "class", "asks", "home", F.explode(at).alias("part"))
        dealt = dealt.withColumn("kept", F.col("home") == F.col("part")).drop("home")
    rows = dealt.join(points, "doc").select("key", "part", "doc", "n", "class", "asks", "kept", *columns)
    spark = members.sparkSession
    rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "key", "part").sortWithinPartitions("key", "part", "doc")

    def run(batches):
        held = None
        for batch in batches:
            whole = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            key, part = whole["key"].to_numpy(), whole["part"].to_numpy()
            change = np.nonzero((key[1:] != key[:-1]) | (part[1:] != part[:-1]))[0] + 1
            for first, last in zip(np.concatenate([[0], change[:-1]]), change) if len(change) else ():
                yield from block(whole.slice(first, last - first))
            held = whole.slice(change[-1] if len(change) else 0)
        if held is not None and held.num_rows:
            yield from block(held)

    def block(part):
        doc, n, cls = (part[c].to_numpy() for c in ("doc", "n", "class"))
        kept, asks = (part[c].to_numpy().astype(bool) for c in ("kept", "asks"))
        if not kept.any() or not asks.any() or (cls == cls[0]).all():
            return
        points = folded(part["point"].to_pylist())
        fine = None if smallest else Finer(part["fine"].to_pylist(), n, percent)
        home = np.nonzero(kept)[0]
        tree = RTree(points[home], n[home], doc[home], percent)
        a, b = [], []
        for k in np.nonzero(asks)[0]:
            hits = home[tree.search(points[k], int(n[k]), smallest)]
            hits = hits[cls[hits] != cls[k]]
            if fine and len(hits):
                hits = fine.fitting(k, hits)
            a += [int(doc[k])] * len(hits)
            b += doc[hits].tolist()
        if a:
            x, y = np.array(a), np.array(b)
            yield pa.record_batch([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long").distinct()


class Finer:
    """Finer points of a block, unpacked when they are first needed; those in use are kept up to a bound."""

    def __init__(self, packed: list[bytes], sizes: np.ndarray, percent: int, most_bytes: int = 64 << 20):
        self.packed, self.sizes, self.t, self.most = packed, sizes, percent, most_bytes
        self.open, self.held = {}, 0

    def point(self, k: int) -> np.ndarray:
        if k not in self.open:
            if self.held > self.most:
                self.open, self.held = {}, 0
            self.open[k] = np.frombuffer(zlib.decompress(self.packed[k]), "<u2")
            self.held += self.open[k].nbytes
        return self.open[k]

    def fitting(self, k: int, hits: np.ndarray) -> np.ndarray:
        """The ``hits`` whose finer points admit a link with ``k``."""
        own, good = self.point(int(k)), np.zeros(len(hits), bool)
        for i, h in enumerate(hits.tolist()):
            other = self.point(h)
            size = min(len(own), len(other))
            x, y = (p if len(p) == size else p.reshape(-1, size).sum(axis=0) for p in (own, other))
            good[i] = (100 + self.t) * int(np.minimum(x, y).sum()) >= self.t * int(self.sizes[k] + self.sizes[h])
        return hits[good]


def groups_for(n: np.ndarray) -> np.ndarray:
    """Groups of the point of a set of ``n``: a power of two, so that a finer point folds into a coarser one."""
    wanted = np.ceil(np.log2(np.maximum(n, 1) / PER_GROUP)).clip(np.log2(FEWEST), np.log2(MOST))
    return np.left_shift(1, wanted.astype(np.int64))


def folded(points: list[bytes]) -> np.ndarray:
    """The points of a block with as many groups as the coarsest has."""
    points = [zlib.decompress(p) for p in points]
    size = min(map(len, points)) // 2
    return np.stack([np.frombuffer(p, "<u2").reshape(-1, size).sum(axis=0, dtype=np.int32) for p in points])


def count_points(texts: DataFrame, width: int) -> DataFrame:
    """doc, n, point, fine: counts of the shingles of each group, as packed 16-bit numbers; larger sets have more groups."""

    def packed(row, code, groups):
        ends = np.concatenate([[0], np.cumsum(groups)])
        slot = ends[row] + (mix(code ^ np.uint64(0x3C3C3C3C)) % groups[row].astype(np.uint64)).astype(np.int64)
        counts = np.bincount(slot, minlength=int(ends[-1]))
        if counts.max(initial=0) > 65535:
            raise ValueError("a text has more shingles than a point can count")
        counts = counts.astype("<u2")
        return pa.array([zlib.compress(counts[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:])], pa.binary())

    def run(batches):
        for batch in batches:
            row, code = shingle_sets(batch.column(1).to_pylist(), width)
            n = np.bincount(row, minlength=batch.num_rows)
            groups = groups_for(n)
            yield pa.record_batch([
                batch.column(0), pa.array(n), packed(row, code, groups), packed(row, code, np.minimum(FINER * groups, np.maximum(groups, MOST)))],
                names=["doc", "n", "point", "fine"])

    return texts.mapInArrow(run, "doc long, n long, point binary, fine binary")


def verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs whose sets are similar enough."""
    # only texts that some pair needs are moved
    asked = lambda side: pairs.select(F.col(side).alias("doc")).distinct()
    left = texts.join(asked("a"), "doc", "left_semi").select(F.col("doc").alias("a"), F.col("t").alias("ta"))
    right = texts.join(asked("b"), "doc", "left_semi").select(F.col("doc").alias("b"), F.col("t").alias("tb"))
    # joined by a last, so that the pairs of one a lie together and its set is made once in a batch
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "ta", "tb")

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            ids = np.concatenate([batch.column(0).to_numpy(), batch.column(1).to_numpy()])
            known, first, which = np.unique(ids, return_index=True, return_inverse=True)
            texts = [batch.column(2 + int(k >= n))[int(k % n)].as_py() for k in first]
            row, code = shingle_sets(texts, width)
            ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(known)))])
            sets = [code[ends[k]:ends[k + 1]] for k in range(len(known))]
            good = []
            for a, b in zip(which[:n], which[n:]):
                same = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                good.append(100 * same >= percent * (len(sets[a]) + len(sets[b]) - same))
            yield pa.record_batch([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good))

    return both.mapInArrow(run, "a long, b long")


def with_classes(members: DataFrame, known: DataFrame) -> DataFrame:
    """key, doc, class of the blocks that hold several classes."""
    named = members.join(known, members.doc == known.node, "left").select("key", "doc", F.coalesce("component", "doc").alias("class"))
    several = named.groupBy("key").agg(F.min("class").alias("l"), F.max("class").alias("h")).where("l <> h").select("key")
    return named.join(several, "key", "left_semi")


def gathered(members: DataFrame, points: DataFrame, texts: DataFrame, copies: DataFrame, width: int, percent: int) -> DataFrame:
    """node, component: classes from copies and from links between the smallest members that the trees admit."""
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("c"))
    asked = members.join(sizes, "key").select("key", "doc", F.col("doc").alias("class"), "c", F.lit(True).alias("asks"))
    links, known = copies, None
    for turn in range(MOST_TURNS):
        pairs = stored(candidate_pairs(asked, points, percent, True), f"pairs{turn}")
        fresh = stored(verified(pairs, texts, width, percent), f"links{turn}")
        discard(pairs)
        merged = stored(components(links.unionByName(fresh)), f"known{turn}")
        empty = fresh.isEmpty()
        discard(fresh)
        if known is not None:
            discard(known)
        known, links = merged, merged.select(F.col("node").alias("a"), F.col("component").alias("b"))
        if empty:
            break
        # one member of each class in a block
        few = with_classes(members, known).groupBy("key", "class").agg(F.min("doc").alias("doc"))
        few = stored(few, f"few{turn}")
        counts = few.groupBy("key").agg(F.count(F.lit(1)).alias("c"))
        asked = few.join(counts, "key").select("key", "doc", "class", "c", F.lit(True).alias("asks"))
    return known


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row with an id."""
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    rows = rows.where("doc IS NOT NULL")
    found = stored(keyed(rows, width, percent), "keyed")
    made = blocks(found)
    listed = stored(made.where("rep IS NOT NULL").select("doc", "n", "rep"), "listed")
    members = stored(made.where("rep IS NULL").select("key", "doc"), "members")
    discard(found)
    near = members.select("doc").distinct()
    texts = stored(rows.join(near, "doc", "left_semi").dropDuplicates(["doc", "t"]), "texts")
    points = stored(count_points(texts, width), "points")

    copies = listed.select(F.col("rep").alias("a"), F.col("doc").alias("b"))
    known = gathered(members, points, texts, copies, width, percent)
    # what is left: blocks with several classes, in which all but the largest class ask for everything
    left = stored(with_classes(members, known), "left")
    discard(members)
    per_class = left.groupBy("key", "class").agg(F.count(F.lit(1)).alias("m"))
    most = per_class.groupBy("key").agg(F.sum("m").alias("c"), F.max(F.struct("m", "class")).alias("top"))
    asked = left.join(most, "key").select("key", "doc", "class", "c", (F.col("class") != F.col("top.class")).alias("asks"))
    rest = stored(candidate_pairs(asked, points, percent, False), "rest")
    discard(points, left)
    more = stored(verified(rest, texts, width, percent), "more")
    discard(texts, rest)
    # classes found so far are stars on their smallest member
    star = known.select(F.col("node").alias("a"), F.col("component").alias("b"))
    final = stored(components(star.unionByName(more)), "final")
    return listed.join(final, listed.doc == final.node, "left").select(
        F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "doc").alias("component_id"))


def representatives(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each class: the row whose id is the class. Rows without an id stay."""
    found = classes(docs, doc_id, text, width, percent)
    name = free_name(docs, "_gone")
    gone = stored(found.where("doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct(), "gone")
    return docs.join(gone, F.col(f"`{doc_id}`") == F.col(f"`{name}`"), "left_anti")


ORACLE = f"""
WITH lists AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {WIDTH} THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - {WIDTH - 2}), lambda i: array_to_string(w[i:i + {WIDTH - 1}], ' ')) END) AS s FROM lists),
each AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS o
  FROM each a JOIN each b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM shared WHERE 100 * o >= {PERCENT} * (na + nb - o)),
ways AS (SELECT a AS x, b AS y FROM links UNION SELECT b, a FROM links UNION SELECT doc_id, doc_id FROM sets),
reach AS (WITH RECURSIVE r(x, y) AS (SELECT x, y FROM ways UNION SELECT r.x, ways.y FROM r JOIN ways ON r.y = ways.x) SELECT x, min(y) AS c FROM r GROUP BY x)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, c AS component_id FROM sets JOIN reach ON doc_id = x
"""


@query("op9_ngram_join", ORACLE)
def op9(spark, sf_dir):
    """Size of the shingle set and class of every document."""
    return classes(table(spark, sf_dir, "documents"))
