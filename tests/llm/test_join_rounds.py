"""Rounds of the n-gram join: large groups of near copies, chains over several classes, clashing names."""

import random

import pytest
from pyspark.sql import functions as F

from palisade.llm import common, jaccard
from tests.llm.test_llm import WORDS, brute_classes, frame


@pytest.fixture(scope="module")
def llm(spark):
    common.ready(spark)
    return spark


def candidates(monkeypatch):
    """Numbers of candidate rows of each round."""
    counts, made = [], jaccard.candidate_pairs

    def counted(*args):
        pairs = common.stored(made(*args), "counted")
        counts.append(pairs.count())
        return pairs

    monkeypatch.setattr(jaccard, "candidate_pairs", counted)
    return counts


def near_copies(draw, size, edits, n=120):
    base = [f"{draw.choice(WORDS)}{k}" for k in range(n)]
    for _ in range(size):
        w = list(base)
        for _ in range(draw.randrange(edits + 1)):
            w[draw.randrange(n)] = f"x{draw.randrange(10 ** 6)}"
        yield " ".join(w)


def test_a_large_group_of_near_copies(llm, monkeypatch):
    """Candidate rows grow in proportion to the members of a group, not with their pairs."""
    monkeypatch.setattr(jaccard, "PART_ROWS", 100)
    counts = candidates(monkeypatch)
    for size in (200, 600):
        draw = random.Random(2)
        rows = list(enumerate(near_copies(draw, size, 3)))
        rows += [(5000 + k, t) for k, t in enumerate(near_copies(draw, 3, 2))]
        counts.clear()
        done = jaccard.classes(frame(llm, rows)).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in done} == brute_classes(rows, 4, 85)
        assert sum(counts) <= 4 * len(rows), counts


def test_the_last_round_of_near_copies_that_do_not_link(llm, monkeypatch):
    """The last round lists few pairs that are no links, and each key with one member only is left out of the names."""
    counts = candidates(monkeypatch)
    draw = random.Random(2)
    rows = list(enumerate(near_copies(draw, 400, 3)))
    done = jaccard.classes(frame(llm, rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in done} == brute_classes(rows, 4, 85)
    assert len(counts) > 1 and counts[-1] <= 40, counts


def test_finer_points_lose_no_link():
    """Whatever two sets share, their finer points admit it; unlike sizes are folded."""
    draw = random.Random(8)
    for n in (30, 300, 3000):
        base = [f"w{draw.randrange(10 ** 9)}" for _ in range(n)]
        texts = [" ".join(base), " ".join(base[n // 50:]), " ".join(f"v{k}" for k in range(n))]
        row, code = jaccard.shingle_sets(texts, 4)
        sets = [set(code[row == k].tolist()) for k in range(3)]
        groups = [512, 1024, 2048]
        packed = [jaccard.zlib.compress(jaccard.np.bincount(
            [int(c) % g for c in s], minlength=g).astype("<u2").tobytes()) for s, g in zip(sets, groups)]
        sizes = jaccard.np.array([len(s) for s in sets])
        hits = jaccard.Finer(packed, sizes, 85).fitting(0, jaccard.np.array([1, 2])).tolist()
        assert 1 in hits and (n > 300 or 2 not in hits)


def test_chains_of_classes(llm, monkeypatch):
    """Texts that drift word by word: neighbours link, the ends do not; gathering needs several rounds."""
    draw, rows, w = random.Random(5), [], [f"{WORDS[k % len(WORDS)]}{k}" for k in range(90)]
    for k in range(160):
        rows.append((draw.randrange(10 ** 6) * 1000 + k, " ".join(w)))
        w = list(w)
        w[(7 * k) % 90] = f"new{k}"
    want = brute_classes(rows, 4, 85)
    for turns in (2,):
        monkeypatch.setattr(jaccard, "MOST_TURNS", turns)
        done = jaccard.classes(frame(llm, rows)).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in done} == want
    assert len({c for _, c in want.values()}) < len(rows) / 2


def test_clashing_names_of_the_representatives(llm):
    text = " ".join(f"word{k}" for k in range(30))
    docs = frame(llm, [(1, text), (2, text), (None, text), (3, None)], ("_gone", "key", "rep", "node"))
    kept = jaccard.representatives(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "None"]
    assert kept.where(F.col("_gone") == "_gone").count() == 3


def test_clashing_names_of_line_dedup(llm):
    from palisade.llm import lines

    extra = ("_lost", "_lost_d", "_lost_x", "_x", "_t", "d", "x")
    docs = frame(llm, [(1, "same line here\nown one"), (2, "same line here\nother"), (3, None)], extra)
    done = {r.doc_id: r for r in lines.deduplicated(docs).collect()}
    assert (done[1].kept_text, done[2].kept_text, done[2].n_removed) == ("same line here\nown one", "other", 1)
    assert all(r[c] == c for r in done.values() for c in extra)


def test_clashing_names_of_the_url_filter(llm):
    from palisade.llm import hosts

    rows = [(1, "http://a.org/x", "<a>", "h", "s", "t"), (2, "http://example.org/es/1", None, "h", "s", "t"), (3, None, "", "h", "s", "t")]
    pages = llm.createDataFrame(rows, "page_id long, url string, html string, _host string, host_ string, trust string")
    done = {r.page_id: r for r in hosts.judged(pages).collect()}
    assert [done[k].verdict for k in (1, 2, 3)] == ["allow", "block", "allow"]
    assert all((r._host, r.host_, r.trust) == ("h", "s", "t") for r in done.values())


def doubled_sizes(monkeypatch):
    """Lengths of the runs that are doubled."""
    from palisade.llm import lines

    sizes, made = [], lines.doubled
    monkeypatch.setattr(lines, "doubled", lambda level, size, name: sizes.append(size) or made(level, size, name))
    return sizes


@pytest.mark.parametrize("least", [1, 7, 40])
def test_runs_are_doubled_until_none_repeats(llm, monkeypatch, least):
    """The least length decides which copies go, not how far runs are sorted."""
    from palisade.llm import lines
    from tests.llm.test_llm import brute_lines

    draw, sizes = random.Random(4), doubled_sizes(monkeypatch)
    base = [f"line {k} {draw.choice(WORDS)}" for k in range(11)]
    rows = [(1, "\n".join(base)), (2, "\n".join(["own", *base[1:10], "", "", base[10]])), (3, "\n".join(base[4:8] + ["x"] + base[:3])),
            (4, "\n".join(["same"] * 6)), (5, "\n".join(base[2:5])), (None, "\n".join(["same", "same", "own"]))]
    done = {r.doc_id: r.kept_text for r in lines.deduplicated(frame(llm, rows), min_words=least).collect()}
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert [done[k] for k, _ in ordered] == brute_lines(ordered, least)
    assert sizes == [1, 2, 4, 8]  # ten lines repeat, sixteen do not
