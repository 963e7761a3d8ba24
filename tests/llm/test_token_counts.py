import public_tokenizers
from tokenizers import Tokenizer

from sluice.llm import token_counts as t

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def check(docs):
    got = sorted(map(str, map(tuple, t.count_tokens(docs, PATH).collect())))
    expected = []
    for r in docs.collect():
        text = r["text"] or ""
        n = len(LIBRARY.encode(text, add_special_tokens=False).ids)
        expected.append((r["doc_id"], len(text.encode()), n, n > 2048))
    assert got == sorted(map(str, expected))


def test_counts_match_the_library(make_docs, odd_rows, rnd):
    mixed = ["".join(chr(rnd.choice([rnd.randint(1, 0x7F), rnd.randint(0x80, 0x2FFF), rnd.randint(0x3000, 0xD7FF)]))
                     for _ in range(60)) for _ in range(80)]
    extra = ["ΟΔΥΣΣΕΥΣ Σ", "a<|endoftext|>b <|ENDOFTEXT|><|startoftext|>", "don't I'LL 'S", "İ J̌ x²½Ⅷ \x1c\x85 k",
             "é é" * 40, "<|", "<|endoftext", "word " * 2049]
    check(make_docs(odd_rows + [(100 + i, x, "en", "a") for i, x in enumerate(mixed + extra)]))


def test_small_blocks_and_no_rows(make_docs, odd_rows, monkeypatch):
    monkeypatch.setattr(t, "BLOCK_BYTES", 100)
    check(make_docs(odd_rows))
    assert t.count_tokens(make_docs(odd_rows).limit(0), PATH).count() == 0
