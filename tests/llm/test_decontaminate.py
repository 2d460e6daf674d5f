"""Windows found by the automaton against a search of every window in every text."""

import hashlib
import random
import re

import pytest

from codescout.llm import decontaminate, entry

ITEMS = "item_id long, text string"


def words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute(docs, items, length=10, coverage=1.0):
    windows = []
    for item, text in items:
        found = words(text)
        if found:
            size = min(length, len(found), max(1, -int(-len(found) * coverage // 1)))
            windows += [(found[i : i + size], item) for i in range(len(found) - size + 1)]
    out = []
    for doc, text in docs:
        found, hit, named = words(text), set(), set()
        for window, item in windows:
            for i in range(len(found) - len(window) + 1):
                if found[i : i + len(window)] == window:
                    hit |= set(range(i, i + len(window)))
                    if item is not None:
                        named.add(str(item))
        digest = hashlib.sha256(",".join(sorted(named)).encode()).hexdigest()
        out.append((doc, len(found), len(hit), len(named), digest, bool(hit)))
    return sorted(out, key=str)


def got(frame):
    return sorted((tuple(r) for r in decontaminate.digests(frame).collect()), key=str)


def made(seed, count=60):
    """Texts over few words, so that runs of all lengths are shared; items of 1 to 30 words."""
    draw = random.Random(seed)
    vocabulary = ["a", "B", "c3", "ä", "Ä", "ß", "dd"]
    items = [(i, " ".join(draw.choices(vocabulary, k=draw.choice([1, 3, 8, 9, 10, 11, 30])))) for i in range(100, 120)]
    items = [x for x in items if len(words(x[1])) > 3 or x[0] % 5 == 0] + [(7, items[3][1]), (7, "zz yy xx"), (None, "only nameless words"), (8, None), (9, " .,-")]
    docs = []
    for i in range(count):
        text = draw.choices(vocabulary, k=draw.randrange(40))
        for _ in range(draw.randrange(3)):
            found = words(draw.choice(items)[1])
            cut = draw.randrange(len(found) + 1)
            text += found[cut : cut + draw.randint(5, 15)] + draw.choices(["q", "w"], k=draw.randrange(3))
        docs.append((i, draw.choice([" ", ", ", "\n", "_"]).join(text)))
    return docs + [(900, None), (901, ""), (None, "x ONLY  nameless-words zz yy xx"), (902, docs[0][1]), (902, docs[0][1])], items


@pytest.mark.parametrize("length, coverage", [(10, 1.0), (4, 0.5), (30, 0.7)])
def test_automaton_finds_every_window(length, coverage):
    for seed in range(5):
        docs, items = made(seed)
        automaton = decontaminate.Automaton()
        windows = []
        for item, text in items:
            found = [w.encode() for w in words(text)]
            if found:
                automaton.add(found)
                windows.append((found, decontaminate.window_of(len(found), length, coverage), item))
        automaton.mark(windows)
        assert len(automaton.link) <= 2 * sum(len(w) for w, _, _ in windows)
        rows = []
        for doc, text in docs:
            n, spans, named = automaton.matches((text or "").encode())
            named = sorted(str(x) for x in named if x is not None)
            assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
            rows.append((doc, n, sum(e - s for s, e in spans), len(named), hashlib.sha256(",".join(named).encode()).hexdigest(), bool(spans)))
        assert sorted(rows, key=str) == brute(docs, items, length, coverage)


def test_long_texts_are_read_in_stretches(monkeypatch):
    text = "Ab c" + "ä" * 50 + ", " + " ".join(f"w{i}" for i in range(500)) + "  "
    whole = [w for stretch in decontaminate.words(text.encode()) for w in stretch]
    for size in (1, 2, 7, 64):
        monkeypatch.setattr(decontaminate, "STRETCH", size)
        assert [w for stretch in decontaminate.words(text.encode()) for w in stretch] == whole == [w.encode() for w in words(text)]


@pytest.mark.parametrize("round_words, piece_words", [(decontaminate.ROUND_WORDS, decontaminate.PIECE_WORDS), (120, 5)])
def test_rounds_and_pieces(spark, round_words, piece_words):
    docs, items = made(11)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    found = decontaminate.find(frame, spark.createDataFrame(items, ITEMS), round_words=round_words, piece_words=piece_words)
    assert got(found) == brute(docs, items)


def test_awkward_rows(spark, awkward, no_rows):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    items = [(1, " ".join(words(rows[5][1])[3:40])), (2, "first line"), (3, "a" * 70_000), (4, "12 34")]
    clashing = awkward.withColumnRenamed("token", "n_words")
    found = decontaminate.find(clashing, spark.createDataFrame(items, ITEMS))
    assert found.columns == ["doc_id", "text", "lang", "source", "n_chars", "n_words", "hit_spans", "hit_items"]
    assert got(found) == brute(rows, items)
    assert decontaminate.find(no_rows, spark.createDataFrame(items, ITEMS)).count() == 0
    clean = decontaminate.find(awkward, spark.createDataFrame([], ITEMS))
    assert got(clean) == brute(rows, [])


def test_spans_are_cut_out(spark):
    items = [(1, " ".join(f"w{i}" for i in range(12))), (2, "short Item")]
    docs = [
        (1, "Keep this, " + " ".join(f"W{i}" for i in range(12)) + "! And this."),
        (2, "w0 w1 w2 w3 stays"),
        (3, "a short  item, b short item"),
        (4, "short item"),
        (5, None),
    ]
    found = decontaminate.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, ITEMS))
    rest = {r.doc_id: (r.text, r.words_removed) for r in decontaminate.remove(found).collect()}
    assert rest == {1: ("Keep this, ! And this.", 12), 2: (docs[1][1], 0), 3: ("a , b ", 4), 4: ("", 2), 5: (None, 0)}
    assert sorted(r.doc_id for r in decontaminate.remove(found, most_hit=0.7).collect()) == [2, 3, 5]


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in entry.table(spark, folder, "documents").collect()]
    items = [(r.item_id, r.text) for r in entry.table(spark, folder, "benchmark").collect()]
    got_rows = sorted((tuple(r) for r in entry.op12_decontamination(spark, folder).collect()), key=str)
    assert got_rows == brute(docs, items) and any(r[-1] for r in got_rows)
