import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from codescout.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["'s", "'", "r", "e", " ", "  ", "\n", "\t", "a", " the", "<|endoftext|>", "<|endof", "é", "日本", "\u0301", "\x1c", "\x85"]
PARTS += ["\xa0", "1", "²", "½", "!!", "😀", "\u3000", "ʹ", "ǅ", "٣", "\u2009", "ª", "_"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    with open(PATH, "rb") as file:
        return bpe.TextEncoder(bpe.MergeTable(file.read()))


def test_lookahead_of_small_lists():
    assert bpe.sufficient_lookahead([]) == 0
    assert bpe.sufficient_lookahead([("a", "b")]) == 1
    # c d decides about b (cd), which decides about a b.
    assert bpe.sufficient_lookahead([("c", "d"), ("b", "c"), ("a", "b")]) == 3
    with pytest.raises(ValueError):
        bpe.sufficient_lookahead([("ab", "c")])


def test_random_texts_in_small_parts(library, encoder, monkeypatch):
    monkeypatch.setattr(bpe, "SLICE", 7)
    monkeypatch.setattr(bpe, "LONG_PIECE", 5)
    draw = random.Random(5)
    for _ in range(3000):
        text = "".join(draw.choice(PARTS) * draw.choice([1, 1, 2, 9]) for _ in range(draw.randint(0, 14)))
        ids = encoder.encode(text)
        assert ids == library.encode(text, add_special_tokens=False).ids, text
        decoder = bpe.StreamDecoder(encoder.table)
        assert "".join(decoder.feed([i]) for i in ids) + decoder.finish() == text


@pytest.mark.parametrize("piece", ["a", "=", " ", "\n", "the", "0", "ïve"])
def test_pieces_longer_than_the_window(library, encoder, piece):
    text = piece * 30_000 + "x"
    assert encoder.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_window_is_bounded(encoder):
    stream, table = bpe.StreamEncoder(encoder.table), encoder.table
    for _ in range(50):
        stream.feed(b"etaoinshrdlu" * 100)
        assert len(stream.held) < table.lookahead + stream.block


def test_broken_bytes_decode_like_the_library(library, encoder):
    draw = random.Random(6)
    for _ in range(300):
        ids = [draw.choice(encoder.table.byte_ids) for _ in range(draw.randint(0, 9))]
        assert bpe.StreamDecoder(encoder.table).decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_documents(library, awkward, no_rows):
    encoded = bpe.encode_documents(awkward, PATH, decode=True)
    assert encoded.columns == ["doc_id", "ids", "decoded"]
    want = sorted((str(r.doc_id), library.encode(r.text or "", add_special_tokens=False).ids, r.text or "") for r in awkward.collect())
    assert sorted((str(r.doc_id), r.ids, r.decoded) for r in encoded.collect()) == want
    back = bpe.decode_documents(bpe.encode_documents(awkward, PATH), PATH)
    assert sorted((str(r.doc_id), r.decoded) for r in back.collect()) == sorted((a, c) for a, _, c in want)
    digests = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(encoded).collect())
    hexes = [[hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, b)), c)] for _, b, c in want]
    assert digests == sorted((a, len(b), *h) for (a, b, _), h in zip(want, hexes))
    assert bpe.digests(bpe.encode_documents(no_rows, PATH, decode=True)).count() == 0
