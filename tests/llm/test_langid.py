import zlib

import numpy as np

from codescout.llm import entry, langid


def test_held_out_documents(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    got = entry.op5_language_id(spark, "/root/testdata/sf0.01").join(documents, "doc_id").collect()
    assert len(got) == documents.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert all(0 <= r.score <= 1 for r in got)
    unseen = [r for r in got if r.held_out and r.lang]
    assert sum(r.lang == r.lang_pred for r in unseen) / len(unseen) >= 0.95


def test_mixtures(spark, texts):
    rows = [(t, lang) for _, t, lang, _ in texts if lang]
    model = langid.train(spark.createDataFrame(rows, "text string, lang string"))
    assert model.languages == sorted({lang for _, lang in rows})
    pure = {lang: next(t for t, x in rows if x == lang and len(t) > 1500)[:1500] for lang in ("en", "de")}
    for lang, text in pure.items():
        shares = model.mixture(text)
        assert shares[model.languages.index(lang)] > 0.95
    both = model.mixture(pure["en"] + " " + pure["de"])
    assert abs(both.sum() - 1) < 1e-9 and all(0.35 < both[model.languages.index(x)] < 0.65 for x in pure)


def test_mixture_is_a_maximum():
    draw = np.random.default_rng(1)
    likely = draw.random((200, 3)) ** 4
    value, weights = langid._fit(likely)
    for _ in range(50):
        other = np.abs(weights + draw.normal(0, 0.02, 3))
        assert np.log(likely @ (other / other.sum())).sum() <= value + 1e-2


def test_counts_do_not_depend_on_partitions(spark, awkward):
    one, many = (langid.train(awkward.repartition(n)) for n in (1, 7))
    assert one.languages == many.languages and np.array_equal(one.table, many.table)


def test_awkward_rows(awkward, no_rows, monkeypatch):
    model = langid.train(awkward)
    got = langid.identify(awkward, model).collect()
    assert len(got) == awkward.count()
    und = {str(r.doc_id) for r in got if r.lang_pred == "und"}
    assert und == {"9000", "9001", "9002", "9003"} and all(r.score == 0 for r in got if r.lang_pred == "und")
    same = [(r.lang_pred, r.score) for r in got if r.doc_id == 9004]
    assert same[0] == same[1]
    whole = langid.identify(awkward, model, rows=True)
    assert whole.select("row.*").columns == awkward.columns
    assert sorted(str((r.row.doc_id, r.lang_pred, r.score)) for r in whole.collect()) == sorted(str(tuple(r)[:3]) for r in got)
    signs = awkward.sparkSession.createDataFrame([(1, "² ½ Ⅷ ٣ _"), (2, "² é")], "doc_id long, text string")
    assert [r.lang_pred == "und" for r in langid.identify(signs, model).orderBy("doc_id").collect()] == [True, False]
    empty = langid.train(no_rows)
    assert {r.lang_pred for r in langid.identify(awkward, empty).collect()} == {"und"}
    assert langid.identify(no_rows, model).count() == 0
