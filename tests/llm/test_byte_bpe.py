import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from sluice.llm import byte_bpe as b

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
RANKS = b.read_ranks(PATH)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def check(docs, library):
    got = b.digests(docs, PATH, public_tokenizers.PATTERN).collect()
    expected = []
    for r in docs.collect():
        ids = library.encode_ordinary(r["text"] or "")
        expected.append((r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                         hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, expected))


def test_ids_and_bytes_match_the_library(make_docs, odd_rows, rnd, library):
    mixed = ["".join(chr(rnd.choice([rnd.randint(9, 0x7F), rnd.randint(0x80, 0x2FFF), rnd.randint(0x1F300, 0x1F9FF)]))
                     for _ in range(80)) for _ in range(60)]
    extra = ["<|endoftext|>", "a" * 191, "a" * 192, "é" * 150, "ab" * 5000, "don't we'll I'M 12345", "\n\n  x \t y  "]
    rows = odd_rows + [(100 + i, t, "en", "a") for i, t in enumerate(mixed + extra)]
    check(make_docs(rows), library)


def test_small_blocks_give_the_same(make_docs, odd_rows, library, monkeypatch):
    monkeypatch.setattr(b, "BLOCK_BYTES", 100)
    check(make_docs(odd_rows), library)


def test_no_rows(make_docs, odd_rows):
    assert b.digests(make_docs(odd_rows).limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_the_heap_merges_as_the_library(rnd, library):
    for n in (1, 2, 3, 10, 400, 3000):
        piece = bytes(rnd.choice(b"abcdefgh th") for _ in range(n))
        assert b.merge_long(piece, RANKS) == library.encode_single_piece(piece) if hasattr(library, "encode_single_piece") \
            else b.merge_long(piece, RANKS) == library._encode_single_piece(piece)


def test_ids_and_decoding_apart(make_docs, odd_rows, library):
    docs = make_docs(odd_rows)
    got = b.decode(b.encode(docs, PATH, public_tokenizers.PATTERN), PATH).collect()
    texts = sorted((str(r["doc_id"]), r["text"] or "") for r in docs.collect())
    assert sorted((str(r["doc_id"]), bytes(r["decoded"]).decode()) for r in got) == texts
    want = sorted(str((r["doc_id"], library.encode_ordinary(r["text"] or ""))) for r in docs.collect())
    assert sorted(str((r["doc_id"], list(r["ids"]))) for r in got) == want


def test_every_pair_is_found_and_no_other(rnd):
    entries, moves = b.pair_table(RANKS)
    size = len(entries)

    def look(left, right):
        home = left * b.LEFT + right * b.RIGHT + int(moves[((left << 7) ^ right) & (size // 4 - 1)])
        entry = int(entries[home & (size - 1)])
        return entry & b.PIECE if entry >> b.ENTRY_SHIFT == (left << b.PLACE_SHIFT | right) else None

    tokens = list(RANKS)
    for _ in range(20_000):
        a, c = rnd.choice(tokens), rnd.choice(tokens)
        assert look(RANKS[a], RANKS[c]) == RANKS.get(a + c)
    for piece in tokens[:20_000]:
        for cut in range(1, len(piece)):
            if piece[:cut] in RANKS and piece[cut:] in RANKS:
                assert look(RANKS[piece[:cut]], RANKS[piece[cut:]]) == RANKS[piece]


def test_the_pairs_of_the_fold_are_found_and_no_other(rnd):
    entries, moves = b.pair_rows(RANKS)
    edge = max(RANKS.values()) + 1

    def look(left, right):
        found = int(entries[int(moves[left]) ^ right]) ^ left << b.FOLD_LEFT
        return found >> b.FOLD_RANK if found < b.NONE else None

    tokens = list(RANKS)
    for _ in range(20_000):
        a, c = rnd.choice(tokens), rnd.choice(tokens)
        assert look(RANKS[a], RANKS[c]) == RANKS.get(a + c)
        assert look(edge, RANKS[a]) is None and look(RANKS[a], edge) is None
    for left, right, rank in b._pairs(RANKS):
        assert look(left, right) == rank


def test_words_of_any_number_of_pieces_are_folded(make_docs, rnd, library):
    # up to 64 pieces have their places in one number's bits, more are counted
    words = ["".join(rnd.choices("aeinrstß", k=n)) for n in (1, 2, 31, 32, 33, 62, 63, 64, 65, 66, 67, 95, 96, 130) for _ in range(3)]
    words += [c * n for c in ("a", "ab", "é", "字") for n in (31, 32, 33, 63, 64)] + ["", "!" * 64, "!" * 65]
    check(make_docs([(i, w, "en", "a") for i, w in enumerate(words)]), library)
