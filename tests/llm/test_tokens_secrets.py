import random
import re

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from layerlab.llm import prefix_bpe, secret_scan
from layerlab.llm.queries import TOKENIZER, tokenizer_path

ODD = ["", " ", None, "<|endoftext|>", "a<|startoftext|>b", "it's they'RE", "é \x1c\x85 x", "ΑΣ Σ ΟΔΟΣ",
       "İ ǅ ß ﬁ", "日本語テキスト", "👍🏽 😀", "a" * 5000, "\x00\x7f", "x²½٣", "Ƛ\U00010d50 \U00016ea0", "-" * 300]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(TOKENIZER))


@pytest.fixture(scope="module")
def encoder():
    return prefix_bpe.WordEncoder(prefix_bpe.Vocabulary(tokenizer_path()))


def test_same_ids_as_the_library(encoder, library):
    r = random.Random(5)
    parts = ["the", "ing", "éè", "Ünder", "1234", " ", "\n", "'ll", "…", "zx", "qqq", "ção", "<|", "|>", "名", "𝒳"]
    texts = [t or "" for t in ODD]
    texts += ["".join(r.choice(parts) for _ in range(r.randrange(1, 40))) for _ in range(3000)]
    texts += ["".join(chr(r.randrange(97, 123)) for _ in range(r.randrange(1, 30))) for _ in range(3000)]
    for text in texts:
        ids = encoder.encode(text)
        assert ids == library.encode(text, add_special_tokens=False).ids, text
        assert encoder.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_words_made_of_two_tokens(encoder, library):
    r = random.Random(6)
    known = [s.removesuffix("</w>") for s in encoder.v.strings if s.isascii() and s.isalpha()]
    for _ in range(5000):
        word = r.choice(known) + r.choice(known)
        assert list(encoder.tokens(word.lower())) == library.encode(word, add_special_tokens=False).ids


def test_encode_rows(docs, library):
    rows = list(enumerate(ODD)) + [(None, "again"), (3, "same id")]
    out = prefix_bpe.encode(docs(rows), tokenizer_path()).collect()
    want = sorted((i if i is not None else -1, library.encode(t or "", add_special_tokens=False).ids) for i, t in rows)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.ids) for r in out) == want
    assert prefix_bpe.encode(docs([]), tokenizer_path()).count() == 0


def test_remembered_words_may_run_out(monkeypatch, encoder, library):
    monkeypatch.setattr(prefix_bpe, "REMEMBERED_WORDS", 3)
    monkeypatch.setattr(prefix_bpe, "REMEMBERED_PAIRS", 5)
    small = prefix_bpe.WordEncoder(encoder.v)
    text = "one two three four five six one two three four"
    assert small.encode(text) == library.encode(text, add_special_tokens=False).ids


# ---- secrets ----------------------------------------------------------------------

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)


def brute_spans(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(found)


def spans_of(docs, texts, **more):
    rows = secret_scan.secret_spans(docs(list(enumerate(texts))), **more).collect()
    return [[(s.kind, s.start, s.end) for s in r.spans] for r in sorted(rows, key=lambda r: r.doc_id)]


def test_base_rules_equal_regular_expressions(docs):
    r = random.Random(8)
    parts = ["password", "SECRET", "token", "api_key", "apikey", "passwd", '"', "'", " ", ":", "=", "AKIA", "é", "\n",
             "0123456789abcdef", "deadbeef", "ABCDEFGH12", "abcdefghijklmno", "x", ".", "-", "/", "KIA", "👍"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(0, 16))) for _ in range(3000)]
    texts += ["token=password :abcdefghijklmnop", "a" * 100_000, "password=" + "x" * 50_000, "tokentoken==abcdefghijkl"]
    kinds = [rule.kind for rule in secret_scan.BASE_RULES]
    for text, found in zip(texts, spans_of(docs, texts)):
        base = [(kinds.index(k), s, e) for k, s, e in found if k in kinds]
        assert [(s, k, e) for k, s, e in base] == brute_spans(text), text


def test_more_rules(docs):
    texts = ["ghp_" + "a1" * 18, "ghp_short", "xoxb-1234567890-abc", "-----BEGIN RSA PRIVATE KEY-----", "eyJhb.eyJz.c2ln", "eyJhb.c2ln"]
    kinds = [[k for k, _, _ in s if k != "hex"] for s in spans_of(docs, texts)]
    assert kinds == [["github"], [], ["slack"], ["pem"], ["jwt"], []]


def test_null_empty_and_repeated(docs):
    assert spans_of(docs, [None, ""]) == [[], []]
    rows = secret_scan.secret_spans(docs([(1, "AKIA" + "B" * 20)] * 3)).collect()
    assert [len(r.spans) for r in rows] == [1, 1, 1]
    assert secret_scan.secret_spans(docs([])).count() == 0


def test_minimal_automaton_is_small():
    auto = secret_scan.Automaton([r.pattern for r in secret_scan.BASE_RULES], anywhere=True)
    assert len(auto.accepts) < 300
