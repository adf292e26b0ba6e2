"""Corpus operators on small tables: brute-force twins, round trips and odd inputs."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F, types as T

import corpus_pipeline
from palisade.llm import (
    chat, common, decontaminate, hosts, jaccard, lines, pieces, pii, quality, substrings, tokens)
from palisade.llm.components import components
from palisade.session import scratch_path
from tests.conftest import SMALL

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and in to that was for alpha beta gamma delta river stone cloud tree lamp door seven nine".split()


@pytest.fixture(scope="module")
def llm(spark):
    common.ready(spark)
    return spark


def prose(draw, n, line=12):
    words = [draw.choice(WORDS) + draw.choice(["", "a", "en", "is", "or"]) for _ in range(n)]
    return "\n".join(" ".join(words[k:k + line]) + "." for k in range(0, n, line))


def odd_rows():
    """NULLs, empty and long texts, repeated rows and near copies."""
    draw = random.Random(3)
    long = prose(draw, 3000)
    base = prose(draw, 120)
    near = base.replace(base.split()[60], "changed", 1)
    return [
        (1, base), (2, near), (3, base), (3, base), (None, "some words here. And more of it."), (4, None), (5, ""), (6, " \n\t\n "),
        (7, long), (8, "a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a"), (9, "one"),
        (10, prose(draw, 60) + "\n" + base), (11, None), (12, "x" * 5000),
    ]


def frame(spark, rows, extra=("kept", "matches", "piece_ids", "n_words")):
    """Rows with extra columns whose names clash with those of the results."""
    names = ["doc_id", "text", *extra]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                           *(T.StructField(c, T.StringType()) for c in extra)])
    return spark.createDataFrame([(*r, *extra) for r in rows], schema).select(*names)


def empty(spark):
    return frame(spark, [])


def words(text):
    return re.findall(common.WORD, text or "")


# --- quality rules ---------------------------------------------------------------------------------------------------

def brute_quality(text):
    w, t = words(text), text or ""
    grams = [tuple(w[k:k + 3]) for k in range(len(w) - 2)]
    twice = {g for g in grams if grams.count(g) > 1}
    covered = {p for k, g in enumerate(grams) if g in twice for p in (k, k + 1, k + 2)}
    full = [x for x in t.split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(quality.SYMBOLS, t)), len(full) - len(set(full)), len(covered)


def test_quality_counts(llm):
    rows = [r for r in odd_rows() if len(r[1] or "") < 6000] + [(20, "Menu | Home | About | Help\nA full line of text ends here."), (21, "a b c a b c")]
    done = quality.judged(frame(llm, rows)).select("doc_id", "text", "n_words_", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
    assert len(done) == len(rows)
    for r in done:
        assert tuple(r)[2:] == brute_quality(r.text), r.doc_id
    assert quality.judged(empty(llm)).count() == 0


def test_quality_lines(llm):
    draw = random.Random(1)
    good = [" ".join(f"{draw.choice(WORDS)}{k}{n}" for n in range(9)).capitalize() + "." for k in range(20)]
    bad = ["Menu | Home | About | Help", "BUY THIS THING NOW!", "win### now### big%%%", "Click here to read the rest.", "a line that never comes to an end"]
    made = lambda *parts: llm.createDataFrame([(1, "\n".join(x for p in parts for x in p))], "doc_id long, text string")
    r = quality.judged(made(good, bad, ["", "Short"])).first()
    assert r.kept and r.words_lost == sum(len(words(x)) for x in bad)
    assert r.clean_text == "\n".join([*good, "", "Short"])
    many = [" ".join(f"open{k}{n}" for n in range(9)) for k in range(9)]
    lost = quality.judged(made(good[:5], many)).first()
    assert not lost.kept and not lost.base_failed


# --- line dedup ------------------------------------------------------------------------------------------------------

def brute_lines(rows, least):
    """Delete every run of lines with enough words that begins earlier; rows in order of the table's documents."""
    docs = [[(i, x) for i, x in enumerate((t or "").split("\n")) if words(x)] for _, t in rows]
    order = [(d, s) for d, f in enumerate(docs) for s in range(len(f))]
    gone = [set() for _ in rows]
    for n, (d, s) in enumerate(order):
        for d2, s2 in order[:n]:
            k = 0
            while s + k < len(docs[d]) and s2 + k < len(docs[d2]) and docs[d][s + k][1] == docs[d2][s2 + k][1]:
                k += 1
            if sum(len(words(x)) for _, x in docs[d][s:s + k]) >= least:
                gone[d].update(i for i, _ in docs[d][s:s + k])
    return ["\n".join(x for i, x in enumerate((t or "").split("\n")) if i not in g) for (_, t), g in zip(rows, gone)]


def test_line_dedup(llm):
    draw = random.Random(5)
    pool = [" ".join(draw.choice(WORDS) for _ in range(draw.choice([1, 2, 3, 12]))) for _ in range(12)]
    rows = [(k, "\n".join(draw.choice([*pool, "", f"unique line {k} {j}"]) for j in range(draw.randrange(1, 25)))) for k in range(40)]
    rows += [(100, None), (101, "")]
    done = {r.doc_id: r.kept_text for r in lines.deduplicated(frame(llm, rows, ("n_lines", "r"))).collect()}
    assert [done[k] for k, _ in rows] == brute_lines(rows, lines.MIN_WORDS)


def test_line_dedup_short_lines(llm):
    """Later copies of short lines go, however short and frequent; a larger least length is an option."""
    draw = random.Random(8)
    short = ["Home", "Read more here", "one two three four five six seven eight nine", "--"]
    rows = [(k, "\n".join([short[0], f"only here {k}", draw.choice(short), "", draw.choice(short)])) for k in range(60)]
    done = {r.doc_id: r for r in lines.deduplicated(frame(llm, rows)).collect()}
    assert [done[k].kept_text for k, _ in rows] == brute_lines(rows, 1)
    left = [x for r in done.values() for x in r.kept_text.split("\n")]
    assert all(left.count(x) == 1 for x in short) and sum(r.n_removed for r in done.values()) == 3 * 60 - len(short)
    longer = {r.doc_id: r.kept_text for r in lines.deduplicated(frame(llm, rows), min_words=5).collect()}
    assert [longer[k] for k, _ in rows] == brute_lines(rows, 5)


def test_line_dedup_odd_rows(llm):
    done = lines.deduplicated(frame(llm, odd_rows())).collect()
    assert len(done) == len(odd_rows())
    repeated = [r for r in done if r.doc_id == 3]
    assert len(repeated) == 2 and repeated[0].kept_text == repeated[1].kept_text == ""
    assert lines.deduplicated(empty(llm)).count() == 0


# --- tokens ----------------------------------------------------------------------------------------------------------

def test_token_files(llm, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows = [r for r in odd_rows() if r != (3, odd_rows()[2][1])] + [(13, "Émile  <|endoftext|>x é   ÅΣ ﬁn\x85y \x1c z ΑΣ."), (14, "don't 'S \U0001f600")]
    docs = frame(llm, rows)
    folder = f"file://{tmp_path}/tokens"
    done = tokens.token_table(docs, folder, path, length=64, rows_per_batch=4, parts=3).collect()
    expected, start = [], 0
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        expected.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(tuple(r)[:4] for r in done if r.doc_id is not None) == [e for e in expected if e[0] is not None]
    assert expected[0] in [tuple(r)[:4] for r in done]
    # random access to a sequence, without a copy
    name = next(r.file for r in done if r.doc_id == 7)
    file = tokens.TokenFile(f"{tmp_path}/tokens/{name}")
    row = next(r for r in done if r.doc_id == 7)
    ids = np.concatenate([file.ids(n) for n in range(len(file))])
    long = [*library.encode(dict(rows)[7], add_special_tokens=False).ids, 1]
    assert ids[row.place:row.place + row.n_tokens].tolist() == long
    mask = np.concatenate([file.mask(n) for n in range(len(file))])
    assert mask.sum() == sum(r.n_tokens for r in done if r.file == name) and not mask[mask.sum():].any()
    assert tokens.token_table(empty(llm), f"file://{tmp_path}/none", path).count() == 0


# --- decontamination -------------------------------------------------------------------------------------------------

def brute_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_distance():
    draw = random.Random(1)
    for _ in range(200):
        a, b = ([draw.randrange(4) for _ in range(draw.randrange(12))] for _ in range(2))
        assert decontaminate.distance(a, b) == brute_distance(a, b)


def edited(draw, w, k):
    w = list(w)
    for _ in range(k):
        p, kind = draw.randrange(len(w)), draw.randrange(3)
        w[p:p + (kind != 0)] = [] if kind == 2 else [draw.choice(WORDS) + "x"]
    return w


def test_decontamination(llm):
    draw = random.Random(7)
    items = [(k, " ".join(draw.choice(WORDS) + draw.choice(["", "s", "ed"]) for _ in range(draw.randrange(15, 50)))) for k in range(20)]
    items += [(50, None), (51, ""), (52, "only three words"), (53, "zz yy")]
    rows, planted = [], 0
    for k in range(60):
        w = prose(draw, 80).split()
        if k % 2:
            item = draw.choice(items[:20])[1].split()
            w[40:40] = edited(draw, item, draw.randrange(0, decontaminate.allowed(len(item), 0.2) + 1))
            planted += 1
        rows.append((k, " ".join(w)))
    rows += [(100, None), (101, ""), (102, "here are Only three, WORDS again"), (103, "zz"), (None, items[0][1])]
    bench = llm.createDataFrame(items, "item_id long, text string")
    done = decontaminate.matched(frame(llm, rows), bench)
    assert "matches_" in done.columns and "matches" in done.columns
    found = {(r.doc_id, m.item_id): m.distance for r in done.collect() for m in r.matches_}
    expected = {}
    for d, t in rows:
        text = decontaminate.words(t)
        for i, it in items:
            w = decontaminate.words(it)
            most = decontaminate.allowed(len(w), 0.2)
            spans = [text[s:s + len(w)] for s in range(len(text)) if len(text[s:s + len(w)]) >= len(w) - most] if w else []
            best = min((brute_distance(s, w) for s in spans if len(set(s) & set(w)) * 2 >= len(set(w))), default=99)
            if w and best <= most:
                expected[d, i] = best
    assert set(found) <= set(expected) and all(found[k] >= expected[k] for k in found)
    assert len(found) >= 0.97 * len(expected) and len(expected) >= planted * 0.6
    assert (102, 52) in found and (None, 0) in found and not any(k[0] in (100, 101, 103) for k in found)
    assert decontaminate.matched(empty(llm), bench).count() == 0
    assert decontaminate.matched(frame(llm, rows), bench.limit(0)).where("size(matches_) > 0").count() == 0
    blocks = decontaminate.matched(frame(llm, rows), bench, block_chars=700).collect()
    assert {(r.doc_id, m.item_id) for r in blocks for m in r.matches_} >= {k for k in found if found[k] == 0}


def test_nearest_passage():
    draw = random.Random(2)
    for _ in range(100):
        a, b = ([draw.randrange(3) for _ in range(draw.randrange(1, 9))] for _ in range(2))
        spans = [(brute_distance(a[s:e], b), s) for s in range(len(a)) for e in range(s, len(a) + 1)]
        assert decontaminate.nearest(a, b) == min(spans) or min(spans)[0] == len(b)


def test_passages_of_any_length():
    """All copies within the allowed edits are found, also those that inserted or deleted words make longer or shorter."""
    draw = random.Random(11)
    items = [(k, " ".join(draw.choice(WORDS) + draw.choice(["", "s", "ed", "er"]) for _ in range(16 + k))) for k in range(40)]
    index, lost = decontaminate.Index(items, spans=True), []
    for kind in (0, 1, 2, 3):  # inserted, replaced, deleted, mixed
        for item_id, item in items:
            w = item.split()
            most = decontaminate.allowed(len(w), 0.2)
            for _ in range(most):
                p, way = draw.randrange(len(w)), kind if kind < 3 else draw.randrange(3)
                w[p:p + (way != 0)] = [] if way == 2 else [f"foreign{draw.randrange(99)}"]
            text = [f"around{draw.randrange(99)}" for _ in range(30)]
            text[15:15] = w
            best = min(brute_distance(w[s:], item.split()) for s in range(len(w)))
            got = {m["item_id"]: m for m in index.search([" ".join(text)])[0]}
            if item_id not in got or got[item_id]["distance"] > best:
                lost.append((kind, item_id))
    assert not lost


# --- URL filters -----------------------------------------------------------------------------------------------------

def test_url_rules(llm):
    rows = [
        (1, "http://a.example.ORG/x", None), (2, "https://www.example.org/es/1", ""), (3, "https://example.org/en/19?x", ""),
        (4, "https://example.org/en/2", ""), (5, "http://b.com/de/1", ""), (6, "http://b.com/fr/1#t", ""), (7, "no url", ""), (8, None, None),
        (9, "http://org", ""), (10, "ftp://notorg/", ""), (10, "ftp://notorg/", ""),
    ]
    done = {r.page_id: r for r in hosts.judged(llm.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    got = {k: (r.host, r.path, r.rule, r.verdict) for k, r in done.items()}
    assert got[1] == ("a.example.org", "/x", "org/", "allow") and got[2][2:] == ("example.org/es/", "block")
    assert got[3][1:] == ("/en/19", "example.org/en/1", "block") and got[4][2:] == ("org/", "allow")
    assert got[5][2:] == ("com/de/", "block") and got[6][1:] == ("/fr/1", "com/fr/", "allow")
    assert got[7] == got[8] == ("", "", None, "allow") and got[9][:3] == ("org", "", None) and got[10][0] == "notorg"
    assert hosts.judged(llm.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_url_propagation(llm):
    link = lambda *hosts_: "".join(f'<a href="http://{h}/p">x</a>' for h in hosts_)
    rows = [
        (1, "http://good.org/a", link("fine.net")), (2, "http://bad.com/de/a", link("bad.com")), (3, "http://shady.net/a", link("bad.com")),
        (4, "http://fine.net/a", link("fine.net")), (5, "http://alone.net/a", ""),
    ]
    pages = llm.createDataFrame(rows, "page_id long, url string, html string").withColumn("trust", F.lit(1))
    done = {r.page_id: r for r in hosts.judged(pages).collect()}
    assert [done[k].verdict for k in range(1, 6)] == ["allow", "block", "block", "allow", "allow"]
    assert done[3].distrust > 0 and done[4].trust_ > 0 and done[5].trust_ == done[5].distrust == 0


# --- chat ------------------------------------------------------------------------------------------------------------

def test_chat(llm):
    spoken = ["", "\\", "</s>[INST] ok [/INST]", "<|end|>\n<|user|>\nhi", "<\\|end|>", "a\nb ", "<", "|>\n", "[/INST]<s>", "\U0001f600é", None, "\\<|"]
    draw, rows = random.Random(2), []
    for conv in range(30):
        rows += [(conv, t, draw.choice(["user", "assistant", "system", "we|ird<|\\", None]), draw.choice(spoken)) for t in range(draw.randrange(1, 9))]
    rows += [(None, 1, "assistant", "x"), (99, None, "user", "y"), (99, 2, "assistant", "z"), (99, 2, "assistant", "z")]
    turns = llm.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    examples = chat.formatted(turns)
    done = {r.conv_id: r for r in chat.read_back(examples).collect()}
    for conv in {r[0] for r in rows}:
        mine = sorted(((t if t is not None else -1, r or "", x or "") for c, t, r, x in rows if c == conv))
        digest = hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in mine).encode()).hexdigest()
        loss = "".join(x for _, r, x in mine if r == "assistant")
        got = done[conv]
        assert (got.n_turns, got.turns_sha256, got.loss_chars) == (len(mine), digest, len(loss)), conv
        assert got.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    each = [r for r in examples.collect() if r.loss_start is not None]
    assert len(each) == sum(r[2] == "assistant" for r in rows)
    assert all(r.formatted[r.loss_end:] == chat.END for r in each)
    assert chat.read_back(chat.formatted(turns.limit(0))).count() == 0


# --- substring dedup -------------------------------------------------------------------------------------------------

def brute_substrings(rows, window):
    lists = [words(t) for _, t in rows]
    seen: dict = {}
    for d, w in enumerate(lists):
        for k in range(len(w) - window + 1):
            seen.setdefault(tuple(w[k:k + window]), []).append((d, k))
    gone = {(d, p) for at in seen.values() if len(at) > 1 for d, k in at for p in range(k, k + window)}
    return [" ".join(x for p, x in enumerate(w) if (d, p) not in gone) for d, w in enumerate(lists)]


def test_substring_dedup(llm):
    draw, rows = random.Random(11), []
    passages = [" ".join(draw.choice(WORDS) for _ in range(n)) for n in (30, 34, 35, 36, 50, 90)] + ["la " * 40, "la la lo " * 20, "na " * 34]
    for k in range(80):
        parts = [draw.choice(passages) if draw.random() < 0.4 else prose(draw, draw.randrange(5, 60)) for _ in range(3)]
        rows.append((k, " ".join(parts)))
    rows += odd_rows() + [(200, rows[0][1]), (201, rows[0][1])]
    done = substrings.deduplicated(frame(llm, rows)).collect()
    expected = brute_substrings(rows, 35)
    got = sorted((str(r.doc_id), r.n_words, r.kept) for r in done)
    assert got == sorted((str(d), len(words(t)), e) for (d, t), e in zip(rows, expected))
    assert substrings.deduplicated(empty(llm)).count() == 0


def test_anchors_are_shared():
    """Equal windows have equal anchors, whatever is around them."""
    draw = np.random.default_rng(4)
    for trial in range(300):
        alphabet = draw.integers(0, 1 << 62, draw.integers(1, 8), dtype=np.uint64)
        inner = draw.choice(alphabet, 35)
        at, names = [], []
        for _ in range(2):
            before, after = (draw.choice(alphabet, draw.integers(0, 30)) for _ in range(2))
            codes = np.concatenate([before, inner, after, [np.uint64(5)]]).astype(np.uint64)
            place, name = substrings.anchors(codes, np.array([len(codes) - 1]))
            at.append(int(place[len(before)]) - len(before))
            names.append(int(name[place[len(before)]]))
        assert at[0] == at[1] and names[0] == names[1] != int(substrings.LAST)


# --- pieces ----------------------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def model():
    import public_tokenizers

    return pieces.load_model(public_tokenizers.path("piece_bpe_32k.model"))


def proto(model, names):
    """The same pieces as a unigram model file of the library."""
    import struct

    field = lambda tag, data: bytes([tag]) + varint(len(data)) + data

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    made = b""
    for i, name in enumerate(names):
        kind = 2 if i == 0 else 3 if i < 3 else 6 if i in model.byte_ids else 1
        made += field(0x0A, field(0x0A, name.encode()) + b"\x15" + struct.pack("<f", model.scores[i]) + b"\x18" + varint(kind))
    trainer = b"\x18\x01" + b"\x98\x02\x01"  # unigram, byte fallback
    normalizer = field(0x0A, b"identity") + b"\x18\x01" + b"\x20\x00" + b"\x28\x01"
    return made + field(0x12, trainer) + field(0x1A, normalizer)


def test_viterbi_against_the_library(model):
    import public_tokenizers
    import sentencepiece

    given = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    names = [given.id_to_piece(i) for i in range(given.get_piece_size())]
    unigram = sentencepiece.SentencePieceProcessor(model_proto=proto(model, names))
    say, draw = pieces.Speaker(model), random.Random(8)
    score = lambda ids: sum(model.scores[i] for i in ids if i not in model.byte_ids)
    for _ in range(300):
        text = " ".join("".join(draw.choice("thaeinorzß梦éx1.") for _ in range(draw.randrange(1, 9))) for _ in range(draw.randrange(1, 12)))
        ours, theirs = say.encode(text).tolist(), unigram.encode(text)
        assert sum(i in model.byte_ids for i in ours) == sum(i in model.byte_ids for i in theirs)
        assert abs(score(ours) - score(theirs)) < 1e-2
        assert say.decode(np.array(ours)) == text


def test_pieces_round_trip(llm, model):
    rows = odd_rows() + [(30, "  two  spaces "), (31, "▁ marker ▁▁x"), (32, "\n\n\ttab\r\n"), (33, "\U0001f600\x00ÿ"), (34, " ")]
    done = pieces.checked(frame(llm, rows), model).collect()
    assert len(done) == len(rows) and all(r.round_trip for r in done)
    assert all(r.piece_ids == "piece_ids" for r in done) and all((r.piece_ids_ == []) == (not r.text) for r in done)
    assert pieces.checked(empty(llm), model).count() == 0


def test_double_array():
    keys = {w.encode(): k for k, w in enumerate(["a", "ab", "abc", "b", "bcd", "é", "ê", "z" * 40])}
    trie = pieces.DoubleArray(keys)
    for key, value in keys.items():
        state = 0
        for c in key:
            nxt = trie.base[state] + c + 1
            assert trie.check[nxt] == state
            state = nxt
        assert trie.value[state] == value


# --- personal data ---------------------------------------------------------------------------------------------------

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_base(text):
    found = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub(r"\D", "", m[0])
            good = {
                "email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True,
                "card": 12 <= len(digits) <= 19 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(digits[::-1])) % 10 == 0,
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                found.append((m.start(), list(PATTERNS).index(kind), f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(found)]


def test_pii(llm):
    draw = random.Random(9)
    bits = ["a.b@c.de", "@", "x@y", "a@b@c.org.", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112",
            "+49 (30) 123.456-78", "+1", "é", " ", "\n", "0000256", "..", "-", "+", "12", "0.0.0.0", "%+-@a-b.c-d", "\U0001f600", "378282246310005"]
    rows = [(1000 + k, "".join(draw.choice(bits) + draw.choice(["", " "]) for _ in range(draw.randrange(30)))) for k in range(300)] + odd_rows()
    rows += [(400, "IBAN DE89 3704 0044 0532 0130 00 and DE88 3704 0044 0532 0130 00"), (401, "ssn 123-45-6789, not 000-12-3456 nor 987-65-4321"), (402, "code 123-45-6789")]
    done = pii.personal_data(frame(llm, rows)).collect()
    texts = {}
    for d, t in rows:
        texts.setdefault(d, t)
    for r in done:
        spans = [f"{s.kind}:{s.start}:{s.end}" for s in r.found if s.kind in pii.BASE]
        assert spans == brute_base(texts[r.doc_id]), texts[r.doc_id]
    extra = {r.doc_id: [s.kind for s in r.found if s.kind not in pii.BASE] for r in done}
    assert extra[400] == ["iban"] and extra[401] == ["ssn"] and extra[402] == []
    assert pii.personal_data(empty(llm)).count() == 0


# --- n-gram join -----------------------------------------------------------------------------------------------------

def brute_classes(rows, width, percent):
    sets = {}
    for d, t in rows:
        w = [x.translate({k: k + 32 for k in range(65, 91)}) for x in words(t)]
        sets[d] = {tuple(w[k:k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    best = {d: d for d in sets}
    near = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b]
            and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in near:
            low = min(best[a], best[b])
            changed |= best[a] != low or best[b] != low
            best[a] = best[b] = low
    return {d: (len(sets[d]), best[d]) for d in sets}


def jaccard_rows():
    draw, rows = random.Random(21), []
    for group in range(14):
        base = prose(draw, draw.choice([1, 2, 3, 4, 5, 6, 7, 8, 12, 30, 60, 150, 400])).split()
        for _ in range(draw.randrange(1, 14)):
            w = list(base)
            for _ in range(draw.choice([0, 0, 1, 1, 2, 3, len(w) // 40])):
                w[draw.randrange(len(w))] = draw.choice(WORDS)
            rows.append((len(rows), " ".join(w)))
            if draw.random() < 0.5:
                base = w
    return rows + [(900, None), (901, ""), (902, "one two three four five"), (903, "ONE Two three four  five")]


@pytest.mark.parametrize("width,percent", [(4, 85), (5, 80)])
def test_jaccard_classes(llm, width, percent):
    rows = jaccard_rows()
    done = jaccard.classes(frame(llm, rows), width=width, percent=percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in done} == brute_classes(rows, width, percent)


def test_jaccard_parts_and_odd_rows(llm, monkeypatch):
    monkeypatch.setattr(jaccard, "PART_ROWS", 3)
    rows = jaccard_rows()
    done = jaccard.classes(frame(llm, rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in done} == brute_classes(rows, 4, 85)
    docs = frame(llm, odd_rows())
    kept = jaccard.representatives(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "None", "4", "5", "6", "7", "8", "9", "10", "11", "12"])
    assert jaccard.representatives(empty(llm)).count() == 0


def test_blocks_lose_no_pair():
    """Every pair above the threshold meets in a block."""
    draw, bands = np.random.default_rng(6), jaccard.Bands(85)
    for _ in range(200):
        n = int(draw.integers(1, 400))
        a = draw.integers(0, 1 << 62, n, dtype=np.uint64)
        drop, add = draw.integers(0, max(1, n // 14) + 1, 2)
        b = np.concatenate([a[drop:], draw.integers(0, 1 << 62, add, dtype=np.uint64)])
        if not len(b) or 100 * (n - drop) < 85 * (n + add):
            continue
        keys = []
        for s in (a, b):
            size = np.array([len(s)])
            own = bands.of(size)
            above = np.where(100 * size >= 85 * bands.low[own + 1], own + 1, -1)
            row = np.zeros(len(s), np.int64)
            keys.append({int(k) for band in (own, above) for k in jaccard.block_keys(row, np.sort(s), size, bands, band)[1]})
        assert keys[0] & keys[1]


@pytest.mark.parametrize("percent", [70, 80, 85, 95])
def test_spare_blocks_stay_near_empty(percent):
    """Hardly any document needs the block that says nothing about content, whatever the size; no pair is lost."""
    draw, bands, spares, uses = np.random.default_rng(4), jaccard.Bands(percent), 0, 0
    t = percent / 100

    def keys(s):
        size = np.array([len(s)])
        found = []
        for band in (bands.of(size), np.where(percent * bands.low[bands.of(size) + 1] <= 100 * size, bands.of(size) + 1, -1)):
            if band[0] >= 0:
                spare = common.mix(band.astype(np.uint64) + np.uint64(0xE7037ED1A0B428DB))[0]
                found.append([int(k) for k in jaccard.block_keys(np.zeros(len(s), np.int64), np.sort(s), size, bands, band)[1]])
                found.append(int(spare) in found[-1])
        return {k for f in found[::2] for k in f}, found[1::2]

    for n in [*range(1, 60), *range(60, 1500, 9)]:
        whole = draw.integers(0, 1 << 62, 2 * n, dtype=np.uint64)
        gone = int(n * (1 - t) / (1 + t))  # as many leave as come
        a, b = whole[:n], whole[gone:n + gone]
        cut = whole[:-(-n * percent // 100)]
        (one, spare), (two, _), (three, _) = keys(a), keys(b), keys(cut)
        assert one & two and one & three
        spares, uses = spares + sum(spare), uses + len(spare)
    assert spares <= 0.01 * uses


def test_blocks_are_named_without_being_held(llm):
    """Blocks get one name for each member set; their rows go through no worker that holds a block."""
    draw = random.Random(12)
    sets = {k: draw.sample(range(30), draw.choice([1, 2, 3, 20])) for k in range(40)} | {40: [1, 2], 41: [2, 1], 42: [5], 43: list(range(500))}
    rows = [(k, d, 9, None) for k, docs in sets.items() for d in docs] + [(0, d, 9, d) for d in range(500)] + [(42, 5, 9, None)]
    made = jaccard.blocks(llm.createDataFrame(rows, "key long, doc long, n long, rep long"))
    assert "InArrow" not in made._jdf.queryExecution().executedPlan().toString()
    found = made.collect()
    assert sorted(r.doc for r in found if r.rep is not None) == list(range(500))
    named = {}
    for r in found:
        if r.rep is None:
            named.setdefault(r.key, set()).add(r.doc)
    assert sorted(map(sorted, named.values())) == sorted(map(list, {tuple(sorted(m)) for m in sets.values() if len(m) > 1}))


def test_rtree():
    draw = np.random.default_rng(2)
    points = draw.integers(0, 6, (300, 16)).astype(np.int32)
    sizes, ids = points.sum(axis=1), draw.permutation(300)
    tree = jaccard.RTree(points, sizes, ids, 80, leaf=8)
    for k in range(0, 300, 7):
        bound = np.minimum(points, points[k]).sum(axis=1)
        good = (180 * bound >= 80 * (sizes + sizes[k])) & (100 * np.minimum(sizes, sizes[k]) >= 80 * np.maximum(sizes, sizes[k]))
        assert sorted(tree.search(points[k], int(sizes[k]), False)) == np.nonzero(good)[0].tolist()
        assert ids[tree.search(points[k], int(sizes[k]), True)[0]] == ids[good].min()


def test_components(llm):
    draw = random.Random(3)
    links = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 160)] + [(draw.randrange(200, 300), draw.randrange(200, 300)) for _ in range(60)]
    got = {r.node: r.component for r in components(llm.createDataFrame(links, "a long, b long")).collect()}
    best = {n: n for ab in links for n in ab if ab[0] != ab[1]}
    for _ in range(len(best)):
        for a, b in links:
            if a != b:
                best[a] = best[b] = min(best[a], best[b])
    assert got == best


# --- pipeline --------------------------------------------------------------------------------------------------------

def test_pipeline(llm, model):
    """Each stage against a brute-force version of its decision, on the rows that it gets."""
    docs = llm.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    bench = [(r.item_id, r.text) for r in llm.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        docs = common.stored(stage(llm, docs, SMALL), "test")
        after = {r.doc_id: r for r in docs.collect()}
        assert set(after) <= set(before) and (docs.columns == columns or k == 4)
        rows = sorted((d, r.text) for d, r in before.items())
        if name == "quality_rules":
            for d, t in rows:
                n, _, _, _, repeat = brute_quality(t)
                assert d not in after or (n >= 50 and 2 * repeat <= n)
            assert len(after) > 0.5 * len(before)
        elif name == "line_dedup":
            texts = dict(zip((d for d, _ in rows), brute_lines(rows, lines.MIN_WORDS)))
            assert {d: r.text for d, r in after.items()} == {d: t for d, t in texts.items() if words(t)}
            assert all(r.n_chars == len(r.text) for r in after.values())
        elif name == "ngram_jaccard_join":
            assert set(after) == {d for d, (_, c) in brute_classes(rows, 5, 80).items() if d == c}
        elif name == "decontamination":
            exact = {d for d, t in rows for _, it in bench if " ".join(decontaminate.words(it)) in " ".join(decontaminate.words(t))}
            assert not exact & set(after) and len(set(before) - set(after)) <= len(exact) + 3
        else:
            assert set(after) == set(before) and all(r.round_trip for r in after.values())
            say = pieces.Speaker(model)
            assert all(say.decode(np.array(r.piece_ids)) == r.text for r in after.values())
    whole = corpus_pipeline.run(llm, SMALL)
    assert {r.doc_id: r.text for r in whole.collect()} == {d: r.text for d, r in after.items()}


def test_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(q.startswith(f"op{n}_") for q in names) for n in range(1, 11))
    assert scratch_path is not None
