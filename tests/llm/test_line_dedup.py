import random

from codescout.llm import line_dedup


def brute(rows):
    count, first, cut = {}, {}, []
    for key, text in rows:
        found = []
        if text is not None:
            lines = text.encode().split(b"\n")
            for start, end in line_dedup.chunks(lines):
                if sum(1 for x in lines[start:end] if x.strip()) >= 2:
                    body = b"\n".join(lines[start:end])
                    found.append((start, end, body))
                    count[body] = count.get(body, 0) + 1
                    if key is not None:
                        first[body] = min(first.get(body, key), key)
        cut.append(found)
    out = []
    for (key, text), found in zip(rows, cut):
        gone, seen = set(), set()
        for start, end, body in found:
            if count[body] > 1 and (body in seen or first.get(body) != key):
                gone |= set(range(start, end))
            seen.add(body)
        left = None if text is None else "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)
        out.append((str(key), left, len(gone)))
    return sorted(out, key=str)


def brute_finest(rows):
    """``brute`` over chunks and windows, where a place in the same text counts as another one if it doesn't overlap the first."""
    count, first, cut = {}, {}, []
    for key, text in rows:
        found = []
        if text is not None:
            ends = {}
            for start, end, body in sorted(line_dedup._spans(text.encode().split(b"\n"), True)):
                found.append((start, end, body, start >= ends.setdefault(body, end)))
                count[body] = count.get(body, 0) + 1
                if key is not None:
                    first[body] = min(first.get(body, key), key)
        cut.append(found)
    out = []
    for (key, text), found in zip(rows, cut):
        gone = {i for s, e, body, again in found if count[body] > 1 and (again or first.get(body) != key) for i in range(s, e)}
        left = None if text is None else "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)
        out.append((str(key), left, len(gone)))
    return sorted(out, key=str)


def test_cuts_follow_the_content():
    draw = random.Random(1)
    lines = [b"line %d" % draw.randrange(50) for _ in range(2000)]
    cuts = {e for _, e in line_dedup.chunks(lines)}
    shifted = {e - 3 for _, e in line_dedup.chunks([b"new", b"new 2", b"new 3", *lines])}
    assert len(cuts & shifted) > 0.9 * len(cuts)
    spans = line_dedup.chunks(lines)
    assert [s for s, _ in spans] == [0, *[e for _, e in spans[:-1]]] and spans[-1][1] == len(lines)


def test_documents(spark, awkward, no_rows):
    draw = random.Random(2)
    passage = "\n".join(f"common {i} {i * i}" for i in range(30))
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    rows += [(300 + i, f"own {draw.random()}\n" * draw.randrange(4) + passage + f"\nend {i}") for i in range(40)]
    rows += [(400, "x y\n" * 30), (401, "\n\n\n\n"), (None, "null only\nnull two\n" * 5), (None, "null only\nnull two\n" * 5)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = line_dedup.remove_repeated(frame).collect()
    want = brute(rows)
    assert sorted(((str(r.doc_id), r.text, r.lines_removed) for r in got), key=str) == want
    assert sum(1 for key, text, _ in want if text and "common 15" in text) == 1
    kept = line_dedup.remove_repeated(awkward)
    assert kept.columns == [*awkward.columns, "lines_removed"] and kept.count() == awkward.count()
    again = line_dedup.remove_repeated(awkward.withColumnRenamed("token", "lines_removed"))
    assert again.columns == [*awkward.columns[:-1], "lines_removed"]
    assert line_dedup.remove_repeated(no_rows).count() == 0


def test_equal_hashes_of_different_bytes_remove_nothing(spark, monkeypatch):
    text = ["\n".join(f"{word} {i}" for i in range(8)) for word in ("one", "two")]
    frame = spark.createDataFrame([(1, text[0]), (2, text[1])], "doc_id long, text string")
    places = line_dedup._places(frame, "doc_id", "text", True)
    assert places.count() > 0
    assert line_dedup.repeated_places(frame).count() == 0


def left(rows):
    """Texts after every run of two or more non-blank lines that an earlier text has is taken out, found by comparing all pairs of texts."""
    out = []
    for n, (key, text) in enumerate(rows):
        lines = text.split("\n")
        full = [i for i, x in enumerate(lines) if x.strip()]
        gone = set()
        for _, earlier in rows[:n]:
            other = [x for x in earlier.split("\n") if x.strip()]
            for i in range(len(full)):
                for j in range(len(other)):
                    n_same = 0
                    while i + n_same < len(full) and j + n_same < len(other) and lines[full[i + n_same]] == other[j + n_same]:
                        n_same += 1
                    if n_same >= 2:
                        gone |= set(range(full[i], full[i + n_same - 1] + 1))
        out.append((key, "\n".join(x for i, x in enumerate(lines) if i not in gone), len(gone)))
    return out


def test_finest_level_takes_whole_passages_of_any_length(spark):
    draw = random.Random(6)
    rows, planted = [], []
    for length in (2, 3, 4, 5, 6, 8, 10, 15):
        for copy in range(5):
            passage = [f"passage {length} {copy} line {i}" for i in range(length)]
            planted.append(passage)
            for where in range(3):
                between = [x for line in passage for x in (line, *[""] * (where == 2))]
                own = [[f"own {draw.random()}" for _ in range(draw.randint(1, 6))] for _ in range(2)]
                rows.append((len(rows), "\n".join([*own[0], *between, *own[1]])))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(tuple(r) for r in line_dedup.remove_repeated(frame, finest=True).collect())
    # Trailing blank lines of a passage may stay or go with a chunk.
    assert [(k, [x for x in t.split("\n") if x]) for k, t, _ in got] == [(k, [x for x in t.split("\n") if x]) for k, t, _ in left(rows)]
    for number, passage in enumerate(planted):
        first, *others = (t.split("\n") for _, t, _ in got[3 * number : 3 * number + 3])
        assert "\n".join(passage) in "\n".join(first)
        assert not any(set(passage) & set(x) for x in others)
    assert all(n == len(t.split("\n")) - len(new.split("\n")) for (_, t), (_, new, n) in zip(rows, got))


def test_finest_level_keeps_first_places(spark, awkward, no_rows):
    rows = [
        (1, "a a\na a\na a"),  # overlaps itself only
        (2, "x x\n" * 6),
        (3, "p\nq\nr\np\nq\ns"),  # again in the same text
        (4, "head\na a\na a\ntail"),
        (None, "u\nv\nw"),
        (None, "u\nv\nw"),
        (5, None),
        (6, ""),
        (7, "single\n\n\nlines"),
        (8, "single\nlines\nx x"),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.text) for r in line_dedup.remove_repeated(frame, finest=True).collect() if r.text is not None)
    # A line repeated through a text keeps its first two places.
    want = [("1", "a a\na a\na a"), ("2", "x x\nx x\n"), ("3", "p\nq\nr\ns"), ("4", "head\ntail"), ("6", ""), ("7", "single\n\n\nlines"), ("8", "x x"), ("None", "u\nv\nw"), ("None", "u\nv\nw")]
    assert got == want
    kept = line_dedup.remove_repeated(awkward, finest=True)
    assert kept.columns == [*awkward.columns, "lines_removed"]
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    assert sorted(((str(r.doc_id), r.text, r.lines_removed) for r in kept.collect()), key=str) == brute_finest(rows)
    assert line_dedup.remove_repeated(no_rows, finest=True).count() == 0
