import random

import pytest

P = pytest.importorskip("public_tokenizers")
from codequarry.llm import tokencounts as C  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

PATH = P.path("word_bpe_49k.json")
ODD = ["J\u030c a", "", None, " ", "Hello World", "don't  we'll\tI'm", "<|endoftext|> a<|startoftext|>b <|endoftext |>", "Straße ΟΔΟΣ İstanbul", "e\u0301 e \u0301a", "a\u00a0b\u2003c\u0085d\x1ce", "日本語 テキスト 123 4.5", "👩‍👩‍👧 ok", "x" * 5000, "a\x00b \x1f", "'s 's't're", "\u1680\u3000!\x1c!"]


def library(texts):
    t = Tokenizer.from_file(PATH)
    return [len(e) for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_counts_equal_the_library(make):
    rng = random.Random(2)
    pool = "aàÀb ß.,'!\n\t9ΣσςÅ\u030a\u200bи<|>"
    texts = ODD + ["".join(rng.choice(pool) for _ in range(rng.randrange(400))) for _ in range(60)]
    out = {r.doc_id: r for r in C.count(make(list(enumerate(texts))), PATH, limit=100).collect()}
    for i, n in enumerate(library(texts)):
        assert (out[i].n_tokens, out[i].n_bytes, out[i].over_limit) == (n, len((texts[i] or "").encode()), n > 100), texts[i]
    assert C.count(make([]), PATH).collect() == []


def test_every_prefix_is_exact():
    tokens = C.counter(PATH)
    rng = random.Random(4)
    made = ["".join(rng.choice(pool) for _ in range(rng.randrange(120))) for pool in ("abcdeinorst'", "aehilnorstuvé ñß.,-'", "'srevlmtdabc09!?-", "xX' ", "日本語テキストab") for _ in range(12)]
    for text in ["The quick browné fox, don't jump! 42 times\n over it's", "ab<|endoftext|>cd ef", "ΟΔΟΣ x", "they'reality we'll'd ''s--'ve", "J\u030c a", "e\u0301e", *made]:
        table = C.PrefixTable(text, tokens)
        want = library([text[:n] for n in range(len(text) + 1)])
        assert [table.at(n) for n in range(len(text) + 1)] == want
        for budget in range(max(want) + 1):
            assert table.longest(budget) == max(n for n, k in enumerate(want) if k <= budget)


def test_tables_hold_borders_and_counts(make):
    text = " ab  cd\nef"
    rows = C.prefix_tables(make([(1, text), (2, None), (3, "x" * 3000)]), PATH).collect()
    by = {r.doc_id: r for r in rows}
    assert (by[1].n_bytes, by[1].ends, by[1].counts[-1]) == (10, [3, 7, 10], library([text])[0])
    assert by[1].prefix_counts == library([text[:n] for n in range(len(text) + 1)]) and by[2].prefix_counts == [0]
    assert by[3].prefix_counts[::500] == library(["x" * n for n in range(0, 3001, 500)])
    for budget in (0, 1, 2, 99):
        want = {i: max(n for n, k in enumerate(r.prefix_counts) if k <= budget) for i, r in by.items()}
        assert {r.doc_id: r.n_chars for r in C.truncated(C.prefix_tables(make([(1, text), (2, None), (3, "x" * 3000)]), PATH), budget).collect()} == want


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        C.Counter(P.path("byte_bpe_50k.json"))


def test_a_full_store_starts_anew(monkeypatch):
    monkeypatch.setattr(C, "CACHE", 3)
    tokens = C.Counter(PATH)
    text = "one two three four five six one two"
    assert int(tokens.of(text.encode()).sum()) == library([text])[0]
