"""Language identification: held-out accuracy, spans, and texts without letters."""

import random

import pytest

from linkstats.llm.language import SCRIPT_NAMES, _prepared, _words, fit_language, predict_language

PARTS = {"aa": "ba be bi bo tan ten".split(), "bb": "krz szcz prz nik wie".split(), "gr": "αλ βε γα δο".split()}


def text(rng, lang, words):
    return " ".join("".join(rng.choice(PARTS[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(words))


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(1)
    rows = [(i, text(rng, lang, 30), lang) for i in range(150) for lang in [sorted(PARTS)[i % 3]]]
    rows += [(500, None, "aa"), (501, "", "bb"), (502, "kein", None), (None, "krz", "aa")]
    return fit_language(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_held_out_texts_and_spans(spark, model):
    rng = random.Random(2)
    rows = [(i, text(rng, lang, 25), lang) for i in range(90) for lang in [sorted(PARTS)[i % 3]]]
    mixed = text(rng, "aa", 10) + " 17, " + text(rng, "bb", 20).upper() + "! " + text(rng, "gr", 5)
    rows += [(200, mixed, ""), (201, None, ""), (202, "", ""), (203, " 12 -- ²", ""), (204, text(rng, "bb", 30_000), "bb")]
    got = {r.doc_id: r for r in predict_language(spark.createDataFrame(rows, "doc_id long, text string, lang_pred string"),
                                                 model).collect()}
    assert len(got) == len(rows)
    assert all(got[i].lang_pred == lang for i, _, lang in rows if lang)
    assert got[200].span_lang == ["aa", "bb", "gr"] and got[200].lang_pred == "bb"
    assert got[200].span_from == [0, 10, 30] and got[200].span_to == [10, 30, 35] and 0.3 < got[200].score < 0.9
    for i in (201, 202, 203):
        assert tuple(got[i])[1:] == ("und", 0.0, [], [], [])


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert fit_language(df) is None
    assert predict_language(df, None).first().lang_pred == "und"
    assert predict_language(df.limit(0), None).count() == 0


def test_words_and_scripts():
    words = _words([_prepared("Ab, cdé 3"), b"", _prepared("привет 世界")])
    assert words.counts.tolist() == [2, 0, 2] and words.sizes.tolist() == [2, 4, 12, 6]
    assert [SCRIPT_NAMES[s] for s in words.scripts] == ["Latin", "Latin", "Cyrillic", "Han"]
