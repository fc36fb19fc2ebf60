"""Toxicity: folding, exceptions, and a lexicon learned from labels."""

import random
import time

import numpy as np

from linkstats.llm.toxicity import ToxicityModel, fit_toxicity, fold, score_toxicity
from tests.llm.helpers import prose

DOCS = "doc_id long, text string, score string"
LABELS = "doc_id long, toxic int, text string"


def test_folding():
    assert fold("1d10t M0R0N $tupid cl0wn!! 2018 é Ångström сlоwn") == " idiot moron stupid clown 2018 e angstrom clown "
    assert fold(None) == fold("") == fold(" \n") == " "
    assert fold("ho$$$ 100$ a@b") == " ho 100 aab "


def test_exceptions_shelter_hits():
    model = ToxicityModel((" clown ", "idio"), (2.0, 2.0), -4.0, ("clown fish",))
    rates = [model.rates(model.automaton(), t).tolist() for t in ("a clown fish", "a clown, a clown fish", "idiotic")]
    assert rates[0] == [0.0, 0.0] and rates[1][0] > 0 and rates[2][1] > 0
    assert not ToxicityModel(exceptions=()).rates(ToxicityModel(exceptions=()).automaton(), "x").size


def test_rates_against_a_plain_search():
    rng = random.Random(2)
    model = ToxicityModel((" ab ", "abc", "bcab", " ca "), (1.0,) * 4, 0.0, ("ab ca", "abc", "ca ab ab", "bc"))
    automaton = model.automaton()
    for _ in range(300):
        text = " ".join(rng.choice(["ab", "abc", "ca", "bcabc", "bc", "c"]) for _ in range(rng.randrange(30)))
        folded = fold(text)
        spans = [(i, i + len(e) + 2) for e in model.exceptions for i in range(len(folded)) if folded.startswith(f" {e} ", i)]
        counts = [sum(not any(a <= i and i + len(p) <= b for a, b in spans) for i in range(len(folded))
                      if folded.startswith(p, i)) for p in model.patterns]
        assert np.allclose(model.rates(automaton, text), np.log1p(1000.0 * np.array(counts) / (len(folded) + 200.0)))


def test_a_long_text_of_exceptions_takes_time_in_proportion():
    model = ToxicityModel((" clown ",), (1.0,), 0.0, ("clown fish",))
    automaton, took = model.automaton(), []
    for n in (20_000, 20_000, 80_000):
        begin = time.perf_counter()
        assert model.rates(automaton, "clown fish " * n)[0] == 0.0
        took.append(time.perf_counter() - begin)
    assert took[2] < 12 * max(took[1], 0.02)


def test_hundreds_of_words_are_all_learned(spark):
    rng = random.Random(9)
    vile = ["".join(rng.choice("bcdfghjklmnpqrstvwxyz") for _ in range(9)) for _ in range(300)]
    docs = []
    for i in range(3000):
        words = prose(rng, 40).split()
        if i % 2:
            for _ in range(3):
                words[rng.randrange(40)] = vile[i % 300]
        docs.append((i, " ".join(words), ""))
    df = spark.createDataFrame(docs, DOCS)
    model = fit_toxicity(df, spark.createDataFrame([(i, i % 2, "") for i in range(3000)], LABELS))
    tested = [r for r in score_toxicity(df.filter("crc32(cast(doc_id as string)) % 5 = 0"), model).collect()]
    toxic = [r.predicted for r in tested if r.doc_id % 2]
    assert sum(toxic) >= 0.95 * len(toxic) and not any(r.predicted for r in tested if r.doc_id % 2 == 0)


def test_learned_lexicon_and_edges(spark):
    rng = random.Random(4)
    docs = []
    for i in range(400):
        words = prose(rng, 60).split()
        if i % 5 == 2:
            for _ in range(4):
                words[rng.randrange(60)] = rng.choice(["vilewort", "VILEW0RT", "грubbish", "nastyish"])
        docs.append((i, " ".join(words), "clash"))
    extra = [(900, None, ""), (901, "", ""), (902, "12 34", ""), (903, prose(rng, 20_000), ""), (3, docs[3][1], "again"),
             (None, "vilewort", "")]
    df = spark.createDataFrame(docs + extra, DOCS)
    labels = spark.createDataFrame([(i, int(i % 5 == 2), "clash") for i in range(300)]
                                   + [(None, 1, ""), (350, None, ""), (2, 0, "")], LABELS)
    model = fit_toxicity(df, labels)
    assert any("vilew" in p for p in model.patterns) and min(model.weights) > 0
    got = score_toxicity(df, model).collect()
    assert len(got) == len(docs) + len(extra)
    by = {r.doc_id: r for r in got}
    assert sum(by[i].predicted == int(i % 5 == 2) for i in range(300, 400)) >= 98
    assert by[900].score == by[901].score < 0.5 and by[903].predicted == 0
    assert fit_toxicity(df, labels, max_labelled=50).patterns == fit_toxicity(df, labels, max_labelled=50).patterns


def test_no_labels_and_no_documents(spark):
    df, labels = spark.createDataFrame([(1, "a", "")], DOCS), spark.createDataFrame([(1, 1, "")], LABELS)
    model = fit_toxicity(df, labels.limit(0))
    assert model.patterns == () and score_toxicity(df, model).first().predicted == 0
    assert score_toxicity(df.limit(0), model).count() == 0
