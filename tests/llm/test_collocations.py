"""Phrases against counts of all windows by a dictionary, also with dictionaries and corners too small for the words."""

import random
import re
from collections import Counter

import pytest

from codescout.llm import collocations

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=10, longest=3, share=50, top=2000):
    counts = {}
    for lang, text in rows:
        counter = counts.setdefault(lang or "und" if lang != "" else "", Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            for size in range(1, longest + 1):
                counter.update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, counter in counts.items():
        n = sum(f for phrase, f in counter.items() if len(phrase) == 1)
        candidates = {p: f for p, f in counter.items() if len(p) > 1 and f >= least}
        dropped = set()
        for p, f in candidates.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    if 100 * f >= share * counter[p[i : i + size]]:
                        dropped.add(p[i : i + size])
        scored = []
        for p, a in candidates.items():
            if p not in dropped:
                score, _, l, r = min((10**6 * a * a // (counter[p[:k]] * counter[p[k:]]), k, counter[p[:k]], counter[p[k:]]) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n, -score))
    return sorted(out)


def corpus(seed, count=150):
    draw = random.Random(seed)
    words = ["the", "Of", "ünd", "x\x00y", "12", "w-w", "'", "É", "a b"] + [f"w{i}" for i in range(60)]
    rows = []
    for _ in range(count):
        text = []
        for _ in range(draw.randrange(60)):
            text.append(draw.choice(words[: draw.choice([3, 9, 69])]))
            if draw.random() < 0.2:
                text += ["New", "York", *draw.choice([["city"], ["City", "hall"], []])]
            text.append(draw.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", " ; "]))
        rows.append((draw.choice(["en", "en", "en", "de", None, "und", ""]), " ".join(text)))
    return rows + [("en", None), ("fr", ""), (None, None), ("xx", "one two " * 30), ("en", "q " * 5000), ("en", "z" * 100 + " end. " + ("z" * 100 + " end. ") * 20)]


def got(frame):
    return sorted(tuple(r) for r in frame.collect())


@pytest.mark.parametrize(
    "dictionary, units, least, words, share, top",
    [(1 << 19, 1 << 21, 10, 3, 50, 2000), (12, 5, 10, 3, 50, 2000), (0, 0, 5, 3, 80, 20), (40, 30, 4, 4, 60, 50), (1 << 19, 1 << 21, 4, 2, 50, 7)],
)
def test_every_path_counts_alike(spark, monkeypatch, dictionary, units, least, words, share, top):
    if dictionary < 100:
        for name, value in {"HEAVY": 3, "STRETCH": 50}.items():
            monkeypatch.setattr(collocations, name, value)
    rows = corpus(3)
    frame = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    result = collocations.collocations(frame, least=least, words=words, share=share, top=top, dictionary=dictionary, units=units)
    assert result.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert got(result) == brute(rows, least, words, share, top)


def test_stretches_lose_no_window(monkeypatch):
    words = [b"a", b"b", b"c"]
    ranks = collocations.Ranks({"en": words}, None)
    draw = random.Random(1)
    texts = ["".join(draw.choices("abc   ., \n", k=200)) for _ in range(20)]
    for size in (1, 5, 64, 1 << 20):
        monkeypatch.setattr(collocations, "STRETCH", size)
        seen = Counter()
        for found, units, last in collocations.windows(texts, "en", ranks, []):
            seen.update((u, w) for u, w in zip(units.tolist(), last.tolist()) if u >= 0 and w >= 0)
        if size == 1:
            first = seen
        assert seen == first


def test_tiles_and_sorted_codes(monkeypatch):
    monkeypatch.setattr(collocations, "AT_ONCE", 100)
    draw = random.Random(2)
    tiles, want = collocations.Tiles(5), Counter()
    batches = []
    import numpy as np

    for _ in range(30):
        pairs = [(draw.choice([3, 500, 1023, 1024, 70_000]), draw.choice([0, 31, 32, 1023, 5000])) for _ in range(50)]
        want.update(pairs)
        tiles.add("en", np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs]))
        if tiles.size > 100:
            batches += tiles.count()
    batches += [*tiles.count(), *tiles.emptied()]
    seen = Counter()
    for batch in batches:
        for _, part, codes, counts in zip(*(c.to_pylist() for c in batch.columns)):
            kind = np.uint16 if part < collocations._TILES else np.int64
            for code, n in zip(np.frombuffer(codes, kind).tolist(), np.frombuffer(counts, np.int64).tolist()):
                if part < collocations._TILES:
                    side = collocations.HEAD // collocations.TILE
                    seen[part // side * 32 + code // 32, part % side * 32 + code % 32] += n
                else:
                    seen[code >> collocations.RANK_BITS, code & ((1 << collocations.RANK_BITS) - 1)] += n
    assert seen == want


def test_awkward_rows(spark, awkward, no_rows):
    rows = [(r.lang, r.text) for r in awkward.collect()]
    clashing = awkward.withColumnRenamed("token", "phrase").withColumnRenamed("n_chars", "score").withColumnRenamed("source", "n")
    assert got(collocations.collocations(clashing)) == brute(rows)
    assert collocations.collocations(no_rows).count() == 0
    few = spark.createDataFrame([("en", "a b c")], "lang string, text string")
    assert collocations.collocations(few).count() == 0


def test_counts_beyond_64_bits(spark):
    big = 3_000_000_007
    schema = "lang string, phrase string, a long"
    phrases = spark.createDataFrame([("en", "a b", big)], schema)
    known = spark.createDataFrame([("en", "a", big + 5), ("en", "b", 2 * big)], "lang string, phrase string, n long")
    row = collocations._scored(phrases, 2, known, known.limit(0)).collect()[0]
    assert row.score == 10**6 * big * big // ((big + 5) * 2 * big)
