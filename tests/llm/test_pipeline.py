"""Queries against their SQL or a plain computation, and the pipeline stage by stage."""

import hashlib
import itertools
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

import corpus_pipeline
from checks.compare import difference, duckdb_tables
from linkstats.llm import queries
from linkstats.llm.decontaminate import words_of
from linkstats.llm.near_dedup import shingles
from linkstats.llm.toxicity import fit_toxicity, score_toxicity

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="given tables are not here")


@pytest.mark.parametrize("name", sorted(queries.all_sql()))
def test_query_agrees_with_sql(spark, name):
    assert difference(spark, duckdb_tables(SF), queries.all_queries()[name], queries.all_sql()[name], SF) is None


def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def components(sets, percent):
    least = {i: i for i in sets}

    def root(i):
        while least[i] != i:
            i = least[i]
        return i
    for a, b in itertools.combinations(sorted(sets), 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
            x, y = root(a), root(b)
            least[max(x, y)] = min(x, y)
    return {i: root(i) for i in sets}


def test_near_dedup_query(spark):
    sets = {i: shingles(t, 2) for i, t in texts(spark).items()}
    want = components(sets, 80)
    got = {r.doc_id: r for r in queries.op1_near_dedup(spark, SF).collect()}
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {
        i: (len(sets[i]), want[i], want[i] == i) for i in sets}


def test_suffix_dedup_query(spark):
    data = {i: t.encode() for i, t in texts(spark).items()}
    count = Counter(hashlib.md5(b[i:i + 400]).digest() for b in data.values() for i in range(len(b) - 399))
    for r in queries.op6_suffix_dedup(spark, SF).collect():
        b = data[r.doc_id]
        gone = bytearray(len(b))
        for i in range(len(b) - 399):
            if count[hashlib.md5(b[i:i + 400]).digest()] > 1:
                gone[i:i + 400] = b"\1" * 400
        kept = bytes(x for x, g in zip(b, gone) if not g)
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (
            len(b), sum(gone), sum(k for k, _ in itertools.groupby(gone)), hashlib.sha256(kept).hexdigest())


def test_vector_search_query(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    ids, v = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    hits = asked = 0
    found = queries.op2_vector_search(spark, SF).collect()
    for q in ids[ids % 20 == 0]:
        scores = (v * v[ids == q]).sum(1)
        best = [i for i in ids[np.lexsort((ids, -scores))] if i != q][:20]
        hits += len(set(best) & {r.vec_id for r in found if r.query_id == q})
        asked += len(best)
    assert hits / asked >= 0.97


def test_held_out_accuracy(spark):
    big = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{big}/documents.parquet").select("doc_id", "lang")
    found = [r for r in queries.op3_language(spark, big).join(docs, "doc_id").collect() if r.held_out]
    assert sum(r.lang == r.lang_pred for r in found) / len(found) > 0.98
    labels = spark.read.parquet(f"{big}/labels.parquet")
    judged = [r for r in queries.op10_toxicity(spark, big).join(labels, "doc_id").collect() if r.held_out]
    assert sum(r.toxic == r.predicted for r in judged) / len(judged) > 0.9


def test_every_operator_has_a_query():
    names = set(queries.all_queries())
    assert len(names) == 14 and "pipeline" in names
    assert sorted(int(n[2:].split("_")[0]) for n in names - {"pipeline"}) == list(range(1, 14))


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "near dedup", "decontamination", "mixing"]
    items = [words_of(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        path = str(tmp_path / name)
        stage(spark, docs, SF).write.parquet(path)
        out = spark.read.parquet(path)
        after = {r.doc_id: r for r in out.collect()}
        if name != "mixing":
            assert out.columns == docs.columns
        if name == "toxicity":
            model = fit_toxicity(docs, spark.read.parquet(f"{SF}/labels.parquet"))
            assert set(after) == {r.doc_id for r in score_toxicity(docs, model).collect() if not r.predicted}
        elif name == "line dedup":
            assert set(after) == set(before)
            lines = Counter(x for r in after.values() for x in {y.strip().lower() for y in r.text.split("\n")} if len(x) >= 40)
            assert max(lines.values(), default=0) < 5
            assert all(r.n_chars == len(r.text) for r in after.values())
        elif name == "near dedup":
            want = components({i: shingles(r.text, 5) for i, r in before.items()}, 80)
            assert set(after) == set(want.values())
        elif name == "decontamination":
            def holds(text, item):
                words = words_of(text)
                return any(words[i:i + len(item)] == item for i in range(len(words) - len(item) + 1))
            leaks = {i for i, r in before.items() if any(holds(r.text, item) for item in items if len(item) >= 5)}
            assert set(before) - set(after) >= leaks and len(set(before) - set(after) - leaks) <= 1
        else:
            share = np.array([r.posterior for r in after.values()])
            rates, tokens = (np.array([r[c] for r in after.values()]) for c in ("rate", "tokens"))
            assert set(after) == set(before) and (rates >= 0).all()
            assert abs((rates * tokens).sum() / tokens.sum() - 1) < 0.02 and np.allclose(share.sum(1), 1)
        docs = out


def test_pipeline_of_no_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.count() == 0
