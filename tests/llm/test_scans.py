"""License scans, centroid clustering and periodic runs: brute-force twins and odd inputs."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import types as T

from palisade.llm import centroids, common, licenses, runs

ODD = [None, "", " \n\t ", "one", "x" * 3000, "a " * 4000, "é à ü", "a\x00b c\x1fd"]


@pytest.fixture(scope="module")
def llm(spark):
    common.ready(spark)
    return spark


def frame(spark, rows, extra=("t", "found", "n_words", "runs", "doc_id_")):
    """Rows with extra columns whose names clash with those of the results."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                           *(T.StructField(c, T.StringType()) for c in extra)])
    return spark.createDataFrame([(*r, *extra) for r in rows], schema)


# --- license scans ---------------------------------------------------------------------------------------------------

def brute_licenses(text):
    """Every offset of every template, by definition."""
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    starts = lambda p: [i for i in range(len(words)) if words[i:i + len(p)] == p]
    base = sorted((i, label) for p, label in licenses.BASE for i in starts(p.split()))
    labels, score = {label for _, label in base}, 1.0 if base else 0.0
    for label, notice, phrases in licenses.TEMPLATES:
        notice, s = notice.split(), licenses.SLACK
        need = math.ceil(round(licenses.LEAST * len(notice), 9))
        if not all(starts(p.split()) for p in phrases):
            continue
        for d in range(-len(notice) - s, len(words) + s):
            stretch = all(any(d - s <= i <= d + len(notice) - len(p.split()) + s for i in starts(p.split())) for p in phrases)
            if stretch:
                c = sum(w in words[max(0, d + q - s):max(0, d + q + s + 1)] for q, w in enumerate(notice))
                if c >= need:
                    labels.add(label)
                    score = max(score, c / len(notice))
    return len(words), base, sorted(labels), score


def license_rows():
    draw = random.Random(2)
    rows = [(k, t) for k, t in enumerate(ODD)] + [(None, "All rights reserved."), (3, "one"), (3, "one")]
    filler = "the of license and to under work stone river public software cc by general version".split()
    for k, (_, notice, _) in enumerate(licenses.TEMPLATES):
        for edits in (0, 1, 2, 4, 7):
            words = notice.split()
            for _ in range(edits):
                at = draw.randrange(len(words))
                kind = draw.randrange(3)
                words[at:at + 1] = [[words[at], "extra"], [], ["other"]][kind]
            around = [draw.choice(filler) for _ in range(30)]
            text = " ".join([*around[:15], *words, *around[15:]])
            rows.append((1000 + 10 * k + edits, draw.choice([text, text.title(), text.replace(" ", ", ")])))
    rows += [(5000, "cc by cc by CC-BY 4.0 General Public License, all rights reserved"), (5001, "cc bye xcc by"),
             (5002, "License " * 2000 + "mit license released under the mit license")]
    return rows


def test_license_scan(llm):
    rows = license_rows()
    done = {(r.doc_id, r.n_words): r for r in licenses.scanned(frame(llm, rows)).collect()}
    partial = 0
    for doc_id, text in rows:
        n, base, labels, score = brute_licenses(text)
        r = done[doc_id, n]
        assert sorted((h.start, h.label) for h in r.found if h.base) == base, doc_id
        assert sorted({h.label for h in r.found}) == labels, doc_id
        assert max((h.score for h in r.found), default=0.0) == pytest.approx(score), doc_id
        partial += 0 < score < 1
    assert partial > 10  # notices with edits are found, too
    assert licenses.scanned(frame(llm, rows)).count() == len(rows)
    assert licenses.scanned(frame(llm, [])).count() == 0


def test_rare_words_lose_nothing():
    """Whatever the frequencies say is rare, the same alignments are found."""
    made = [licenses.Template(*t, licenses.LEAST) for t in licenses.TEMPLATES]
    vocabulary = sorted({w for t in made for w in t.words})
    draw, seen = random.Random(4), set()
    for _ in range(4):
        index = licenses.RareIndex(made, {w: draw.randrange(1000) for w in vocabulary}, licenses.SLACK)
        found = []
        for _, text in license_rows():
            words = licenses.license_words(text)
            found.append(tuple(index.found(words, set(words))))
        seen.add(tuple(found))
    assert len(seen) == 1


# --- centroid clustering ---------------------------------------------------------------------------------------------

def brute_clusters(rows, dims, k, rounds):
    kept = [(i, [max(-centroids.BOUND, min(centroids.BOUND, math.floor(64 * x))) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    middle = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(middle))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        middle = [[sum(x) // len(groups[n]) for x in zip(*groups[n])] if n in groups else c for n, c in enumerate(middle)]
    out = [(i, *nearest(v)[::-1]) for i, v in kept]
    cost = {}
    for _, n, d in out:
        cost[n] = cost.get(n, 0) + d
    return sorted(((i, n, d, cost[n], sum(cost.values()), tuple(middle[n])) for i, n, d in out), key=repr)


def vectors(draw, n, dims):
    rows = []
    for k in range(n):
        v = [float(np.float32(draw.gauss(k % 5, 1.5))) for _ in range(dims)]
        rows.append((k, v))
    hot = rows[7][1]
    rows += [(n + k, hot) for k in range(n // 2)]  # one vector in a third of all rows
    rows += [(3, rows[3][1]), (3, rows[3][1]), (None, rows[4][1])]
    rows += [(900, None), (901, []), (902, [1.0] * (dims - 1)), (903, [None] * dims), (904, [float("nan")] * dims),
             (905, [float("inf")] + [0.0] * (dims - 1)), (906, [0.0] * dims), (907, [-0.001] * dims), (908, [1e30, -1e30] + [0.0] * (dims - 2))]
    return rows


@pytest.mark.parametrize("dims,k", [(4, 7), (64, 16), (4, 500)])
def test_clusters(llm, dims, k):
    rows = vectors(random.Random(dims), 150, dims)
    schema = "vec_id long, embedding array<float>, cluster string, v string"
    made = llm.createDataFrame([(*r, "x", "y") for r in rows], schema).repartition(5)
    done = centroids.clustered(made, dims=dims, k=k).collect()
    got = sorted(((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, tuple(r.centroid)) for r in done), key=repr)
    assert got == brute_clusters(rows, dims, k, 3)
    assert centroids.clustered(made.where("vec_id = 901"), dims=dims, k=k).count() == 0


def test_search_skips_and_keeps_ties():
    draw = np.random.default_rng(1)
    points = draw.integers(-300, 300, (200, 16)) + draw.integers(-2000, 2000, (200, 1))
    points[50] = points[150]  # equal centroids: the smaller number
    points[20] = points[21][::-1]  # equal mean and deviation
    x = np.concatenate([points, draw.integers(-2500, 2500, (300, 1)) + draw.integers(-300, 300, (300, 16)), (points[20] + points[21])[None] // 2])
    number, distance, computed = centroids.SortedCentroids(points).nearest(x)
    each = ((x[:, None, :] - points[None]) ** 2).sum(-1)
    assert (number == each.argmin(1)).all() and (distance == each.min(1)).all()
    assert computed < len(x) * len(points) / 10


# --- periodic runs ---------------------------------------------------------------------------------------------------

def brute_runs(words):
    n, stretches = len(words), []
    for q in range(1, n // 3 + 1):
        i = q
        while i < n:
            if words[i] != words[i - q]:
                i += 1
                continue
            first = i
            while i < n and words[i] == words[i - q]:
                i += 1
            if i - first + q >= max(24, 3 * q):
                stretches.append((first - q, i - first + q, q))
    covers = lambda a, b: a[2] < b[2] and a[0] <= b[0] and a[0] + a[1] >= b[0] + b[1]
    return sorted(r for r in stretches if not any(covers(o, r) for o in stretches))


def run_rows():
    draw = random.Random(8)
    texts = list(ODD)
    for k in range(500):
        letters = "abcdefgh"[:draw.choice([1, 2, 2, 3, 8])]
        words = []
        while len(words) < draw.choice([10, 40, 150, 400, 600]):
            unit = [draw.choice(letters) for _ in range(draw.choice([1, 2, 3, 5, 8, 9, 16, 17, 30]))]
            if draw.random() < 0.3 and len(unit) > 2:
                unit = unit + unit[:2] + unit  # nested repeats
            words += unit * draw.choice([1, 2, 3, 4, 12])
            words = words[:len(words) - draw.randrange(3)]
        texts.append(draw.choice([" ", "\n", " \t"]).join(words))
    return [(k, t) for k, t in enumerate(texts)] + [(None, "a b " * 20), (9, "a"), (9, "a")]


def test_periodic_runs(llm):
    rows = run_rows()
    done = runs.periodic_runs(frame(llm, rows)).collect()
    assert len(done) == len(rows)
    by_id = {}
    for r in done:
        by_id.setdefault((r.doc_id, r.n_words), r)
    several = 0
    for doc_id, text in rows:
        words = re.findall(common.WORD, text or "")
        r = by_id[doc_id, len(words)]
        want = brute_runs(words)
        assert [tuple(x) for x in r.runs] == want, doc_id
        best = max(want, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=None)
        assert (tuple(r.strongest) if r.strongest else None) == best
        gone = {i for s, m, q in want for i in range(s + q, s + m)}
        assert r.collapsed_text == " ".join(w for i, w in enumerate(words) if i not in gone)
        several += len(want) > 1
    assert several > 50
    assert runs.periodic_runs(frame(llm, [])).count() == 0


def test_openings_stay_few():
    """A text of one word, and one of a few frequent words, open few lags though all pairs of places match."""
    one = np.zeros(50_000, np.int64)
    assert len(runs.openings(one, np.full(50_000, 50_000))) <= 1
    few = np.random.default_rng(0).integers(0, 3, 50_000)
    assert len(runs.openings(few, np.full(50_000, 50_000))) < 500


def test_folded_documents(llm):
    rows = [(k, " ".join(f"w{j}" for j in range(k % 90))) for k in range(400)] + [(None, "a b c"), (4000, None)]
    got = {r.doc_id: r.text for r in runs.folded(frame(llm, rows)).collect()}
    changed = 0
    for doc_id, text in rows:
        words = (text or "").split()
        n, h = len(words), zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
            changed += 1
        assert (got[doc_id] or "").split() == words, doc_id
    assert changed > 20
