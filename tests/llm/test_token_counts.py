"""Token counts against the library itself."""

import pytest
import regex

from feedpulse.llm import queries as Q
from feedpulse.llm import token_counts as T

from .conftest import ODD_ROWS

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(PATH)


def expected(library, text):
    return len(library.encode(text or "", add_special_tokens=False))


def test_whole_table(spark, table, library):
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in Q.op13_token_counts(spark, "/root/testdata/sf0.001").collect()}
    docs = table("documents").collect()
    assert len(got) == len(docs)
    for r in docs:
        n = expected(library, r.text)
        assert got[r.doc_id] == (len((r.text or "").encode()), n, n > 512)


HARD = ["a<|endoftext|>b", "<|endoftext|>", "<|endoftext|><|endoftext|> x", "<|endoftext|", "don't  stop\n\n\t x  ", "  lead", "x" * 5000,
        "١٢٣ नमस्ते दुनिया 你好世界 ", "𝔘𝔫𝔦 🜚 ⅷ ꟗ ꟎", "​   x\u0085y\u001cz", "tail \r\n", "½ ² 3rd ¼x", "I'LL we'll 'tis"]


def test_hard_texts_parts_and_repeats(spark, frame, library):
    rows = [*ODD_ROWS, *[(100 + i, t) for i, t in enumerate(HARD)], (50, "same words again " * 40), (51, "same words again " * 40), (51, "same zzyzx qwrt"), (52, "qwrt zzyzx zzyzx")]
    want = sorted((repr(i), len((t or "").encode()), expected(library, t)) for i, t in rows)
    for part_bytes in (1, 200, 1 << 24):
        out = T.token_counts(frame(rows), PATH, part_bytes=part_bytes).collect()
        assert sorted((repr(r.doc_id), r.n_bytes, r.n_tokens) for r in out) == want


def test_agreed_characters(library):
    cut, pattern, agreed = T.PreTokens(open(PATH, encoding="utf-8").read()), regex.compile(T.BYTE_LEVEL), regex.compile(T.AGREED)
    for base in range(0, 0x110000, 256):
        some = [chr(c) for c in range(base, base + 256) if not 0xD800 <= c < 0xE000 and agreed.fullmatch(chr(c))]
        text = " ".join(f"a{c}{c}1{c} {c}a {c} {c}  b" for c in some)
        assert pattern.findall(text) == [text[a:b] for _, (a, b) in cut.tokenizer.pre_tokenizer.pre_tokenize_str(text)]


def test_other_definitions(spark, frame):
    """A tokenizer that normalises: pre-tokens are not the text's own substrings."""
    from tokenizers import Tokenizer
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    texts = [t for t in HARD if "<|" not in t]
    out = T.token_counts(frame(list(enumerate(texts))), path).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in out) == [(i, len(library.encode(t, add_special_tokens=False))) for i, t in enumerate(texts)]


def test_empty_table(spark, frame):
    assert T.token_counts(frame([(1, "x")]).filter("false"), PATH).count() == 0
