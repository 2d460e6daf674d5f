"""Column functions on literal cases."""

import pytest
from pyspark.sql import functions as F

from codescout.functions import text
from codescout.operators.embed import split_tokenizer, token_lengths


def values(spark, function, rows, columns="x string"):
    df = spark.createDataFrame([row if isinstance(row, tuple) else (row,) for row in rows], columns)
    names = df.columns
    out = df.withColumn("_i", F.monotonically_increasing_id()).select("_i", function(*[F.col(c) for c in names]).alias("y"))
    return [r.y for r in out.orderBy("_i").collect()]


def test_code_family(spark):
    got = values(spark, text.code_family, ["F32.44", "F32", "D3A", "abc", ".5", "F32.4.1", "", "A٣4x"])
    assert got == ["F32", "F32", "D3", "abc", "", "F32", "", "A٣4"]


def test_keyed_and_file_safe(spark):
    rows = [("Allergy & Immunology", "Allergy"), ("A/B", "C/D"), (None, "X"), ("Y", None)]
    assert values(spark, text.keyed_specialty, rows, "a string, b string") == [
        "allergy & immunology_allergy", "ab_cd", "_x", "y_",
    ]
    assert values(spark, text.file_safe, ["a/b/c", "ab"]) == ["a_b_c", "ab"]


def test_parse_code_list(spark):
    got = values(spark, text.parse_code_list, ["A00.1,Y38.2", " [] ", "[A00.1, Y38.2]", " A , A ", None, ""])
    assert got == [["A00.1", "Y38.2"], [], ["[A00.1", "Y38.2]"], ["A", "A"], [], [""]]


@pytest.mark.parametrize("cell", ["a b  c", " a\tb\n", "", "   ", "x y z", "one\x85two three\x1cfour", "é à"])
def test_word_count_matches_python(spark, cell):
    assert values(spark, text.word_count, [cell]) == [len(cell.split())]
    assert values(spark, text.strip_space, [cell]) == [cell.strip()]


def test_null_text_is_counted_not_raised(spark):
    rows = [("a b", None, "c"), (None, None, None)]
    columns = "a string, b string, c string"
    assert values(spark, text.triplet_word_length, rows, columns) == [3, 0]
    assert values(spark, text.triplet_length, rows, columns) == [2, 0]
    assert values(spark, token_lengths(split_tokenizer), ["a b c", None, ""]) == [3, 0, 0]


def test_instruction_anchor(spark):
    got = values(spark, text.instruction_anchor, [("cardiology", "chest pain"), (None, None)], "s string, q string")
    assert got[0] == (
        "Instruct: Given a medical query in the field of cardiology, retrieve the relevant ICD description\n"
        "Query: chest pain"
    )
    assert got[1].endswith("\nQuery: ")
    assert values(spark, text.query_prefix, ["flu"]) == ["query: flu"]


def test_relevance_label(spark):
    got = values(spark, text.parse_relevance_label, [" relevant\n", "non-relevant", "CANNOT_DECIDE", "Relevant", "yes", None])
    assert got == ["relevant", "non-relevant", "CANNOT_DECIDE", None, None, None]


def test_classification(spark):
    rows = ["classification: diagnostic\nreason: a symptom", "→ classification: procedural\n→ reason: surgery", "classification: other", None]
    got = values(spark, text.parse_classification, rows)
    assert [(r.classification, r.reason) for r in got] == [
        ("diagnostic", "a symptom"), ("procedural", "surgery"), ("exclude", ""), ("exclude", ""),
    ]


def test_query_list(spark):
    long = "x" * 200_000
    got = values(spark, text.parse_query_list, ["""["chest pain", 'it\\'s sore', "a, b"]""", "[]", f"['{long}']", "['" + "\\'" * 50_000 + "']"])
    assert got == [["chest pain", "it's sore", "a, b"], [], [long], ["'" * 50_000]]


def test_procedural_terms(spark):
    rows = ["knee replacement cost", "brain mri", "chest pain", "replacements", "rehab"]
    assert values(spark, text.has_procedural_term, rows) == [True, True, False, False, True]


def test_next_status(spark):
    rows = [(True, 3), (False, 1), (False, 2), (False, 3), (False, 4), (True, 9)]
    got = values(spark, text.next_status, rows, "ok boolean, n int")
    assert got == ["completed", "pending", "pending", "failed", "failed", "completed"]


def test_fill_template_never_reads_its_own_output(spark):
    got = values(
        spark,
        lambda a, b: text.fill_template("{q} in {s}: {q}", {"q": a, "s": b}),
        [("{s}", "x"), ("y", None)],
        "a string, b string",
    )
    assert got == ["{s} in x: {s}", "y in : y"]


def test_keyword_codes(spark):
    rows = [("heart attack symptoms", "Cardiology"), ("Skin RASH identification", "Dermatology"),
            ("checkup", "Pediatric Cardiology"), ("checkup", "Dermatology"), ("checkup", "Other")]
    got = values(spark, lambda q, s: text.keyword_codes(q, text.KEYWORD_CODES, text.default_code(s)), rows, "q string, s string")
    assert got == [["I21", "I25"], ["L30.9"], ["I99"], ["L99"], ["R69"]]


def closest_by_hand(predicted, labels):
    low = predicted.lower()
    for label in labels:
        if low in label.lower() or label.lower() in low:
            return label
    words, best, score = set(low.split()), labels[0], 0
    for label in labels:
        other = set(label.lower().split())
        share = len(words & other) / max(len(words), len(other))
        if share > score:
            best, score = label, share
    return best


def test_closest_label(spark):
    labels = ["general practice", "Sports Medicine physician", "medicine physician", "oral surgery", "surgery"]
    rows = ["Sports", "physician of medicine", "ORAL SURGERY clinic", "nothing here", "physician", "practice general", "", "surgery"]
    expected = [closest_by_hand(p, labels) for p in rows]
    assert values(spark, lambda p: text.closest_label(p, labels), rows) == expected
    assert values(spark, lambda p: text.validate_label(p, labels), ["surgery", None]) == ["surgery", labels[0]]
    assert values(spark, lambda p: text.validate_label(p, []), ["surgery", None]) == ["general_practice"] * 2


def test_top_labels(spark):
    got = values(spark, lambda r: text.parse_top_labels(r, ["a b", "c", "d"]), ["a b, c, d", "c, x, d", None, "d,c,a b,c"])
    assert [(r.labels, r.complete) for r in got] == [(["a b", "c", "d"], True), (["c", "d"], False), ([], False), (["d", "c", "a b", "c"], False)]
