import json
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from codescout.llm import token_counts

PATH = public_tokenizers.path("word_bpe_49k.json")
PARTS = ["'s", "'", "r", " ", "  ", "\n", "\t", "a", "the", "<|endoftext|>", "<|endof", "É", "日本", "\u0301", " \u0301", "\x1c", "\x85", "\xa0"]
PARTS += ["1", "²", "!!", "😀", "\u3000", "Σ ", "ΑΣ", "İ", "\u2009", "_"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def file():
    with open(PATH, "rb") as held:
        return held.read()


@pytest.mark.parametrize(("chunk", "overlap"), [(16, 4), (64, 1), (1 << 15, 256)])
def test_random_texts(library, file, chunk, overlap):
    counter, draw = token_counts.WordCounter(file, chunk, overlap), random.Random(chunk)
    texts = ["".join(draw.choice(PARTS) * draw.choice([1, 1, 2, 9]) for _ in range(draw.randint(0, 40))) for _ in range(1500)]
    want = [(len(t.encode()), len(library.encode(t, add_special_tokens=False).ids)) for t in texts]
    assert counter.count_many(texts) == want


def test_words_longer_than_a_chunk(library, file):
    counter = token_counts.WordCounter(file, 32, 4)
    text = "x" * 1000 + " " + "y" * 40 + " z " * 50 + "w" * 333
    assert counter.spliced(text) == len(library.encode(text, add_special_tokens=False).ids)


def test_other_tokenizers_are_refused():
    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as held:
        assert not token_counts.white_space_separates(json.loads(held.read()))


def test_documents(library, awkward, no_rows):
    counts = token_counts.count_tokens(awkward, PATH, chunk=512, overlap=16)
    want = sorted((str(r.doc_id), len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in awkward.collect())
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in counts.collect()) == want
    assert token_counts.count_tokens(no_rows, PATH).count() == 0
