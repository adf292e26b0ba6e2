"""Words are encoded and coded many at a time, with the same results."""

import random

import pytest

from palisade.llm import jaccard, tokens


@pytest.fixture(scope="module")
def path():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def new_words(draw, n):
    return ["".join(draw.choice("abcdefghijklmnopqrstuvwxyzABC") for _ in range(draw.randrange(1, 12))) for _ in range(n)]


ODD = ["", " ", "don't a.b . .. ,x; y!", "İstanbul ß ẞ Ǆ áb 한글 ㄱ", "x\x1cy 12 a1b", "z" * 300, "Z Été."]


def test_words_of_letters_share_a_text(path, monkeypatch):
    encode, texts = tokens.Encoder(path), []
    plain = encode.plain
    monkeypatch.setattr(encode, "plain", lambda t: texts.extend(t) or plain(t))
    words = new_words(random.Random(1), 3000)
    given = [" ".join(words[i:i + 50]) for i in range(0, len(words), 50)] + ODD
    assert encode(given) == tokens.Encoder(path, by_word=False)(given)
    assert len(texts) < 200


def test_a_mark_inside_words_is_not_cut(path, monkeypatch):
    monkeypatch.setattr(tokens, "JOINT", " a ")
    words = ["a", "stone", "river", "A"]
    assert tokens.Encoder(path)([" ".join(words)]) == tokens.Encoder(path, by_word=False)([" ".join(words)])


def test_word_codes_tell_words_apart(monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 7)
    texts = [*ODD, None, " \t\n\v\f\r", "a\x00 a A \x00", "w" * 64 + " " + "w" * 65 + " " + "w" * 66, " ".join(new_words(random.Random(2), 500))]
    codes, n = jaccard.word_codes(texts)
    lists = [(t or "").encode().lower().split() for t in texts]
    assert n.tolist() == [len(w) for w in lists]
    pairs = set(zip((w for x in lists for w in x), codes.tolist()))
    assert len(pairs) == len({w for w, _ in pairs}) == len({c for _, c in pairs})
    assert [len(x) for x in jaccard.word_codes([])] == [0, 0]
