"""The corpus pipeline: every stage against a plain restatement on the smallest table and on odd rows."""
import hashlib
import itertools
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from conftest import SF_SMALL
from runlens.llm import decontaminate as D, langid, pii
from runlens.llm._common import written


@pytest.fixture(scope="module")
def stages(spark):
    """Input and result of each stage."""
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    out = [docs]
    for name, stage in C.STAGES:
        out.append(written(stage(spark, out[-1], SF_SMALL), f"test-{name}"))
    return out


def _rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages_keep_the_columns(stages):
    for df in stages[1:-1]:
        assert df.dtypes == stages[0].dtypes


def test_language_stage_keeps_what_is_identified(spark, stages):
    model = langid.fit(stages[0])
    rows = stages[0].collect()
    names, scores = langid.predict_batch(model, [r.text for r in rows])
    assert set(_rows(stages[1])) == {r.doc_id for r, n, s in zip(rows, names, scores) if n != "und" and s >= langid.least_score(model)}


def test_near_duplicate_stage_keeps_the_first_of_each_group(stages):
    rows, kept = _rows(stages[1]), _rows(stages[2])
    sets, up = {}, {d: d for d in rows}
    for d, r in rows.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (r.text or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[d] = {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(rows, 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            p, q = root(a), root(b)
            up[max(p, q)] = min(p, q)
    assert set(kept) == {d for d in rows if root(d) == d} and all(kept[d] == rows[d] for d in kept)


def test_benchmark_stage_leaves_no_window(spark, stages):
    items = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    windows = {tuple(w[i:i + 10]) for _, t in items if (w := D.words_of(t)) for i in range(max(1, len(w) - 9))}
    sizes = {len(w) for w in windows}

    def hit(text):
        w = D.words_of(text)
        return any(tuple(w[i:i + n]) in windows for n in sizes for i in range(len(w) - n + 1))

    before, after = _rows(stages[2]), _rows(stages[3])
    assert any(hit(r.text) for r in before.values()) and not any(hit(r.text) for r in after.values())
    for d, r in before.items():
        if not hit(r.text):
            assert after[d] == r
        elif d in after:
            assert after[d].n_chars == len(after[d].text) < len(r.text)


def test_personal_data_stage_leaves_none(stages):
    before, after = _rows(stages[3]), _rows(stages[4])
    assert set(before) == set(after) and any(pii.base_spans(r.text) for r in before.values())
    for d, r in after.items():
        assert not pii.base_spans(r.text) and r.n_chars == len(r.text)
        if not pii._DIGIT.search(before[d].text) and "@" not in before[d].text:
            assert r == before[d]


def test_tokens_decode_to_the_texts(stages):
    docs, tokens = _rows(stages[4]), _rows(stages[5])
    assert set(docs) == set(tokens)
    for d, r in tokens.items():
        assert r.decoded_sha256 == hashlib.sha256(docs[d].text.encode()).hexdigest() and r.n_tokens == len(r.ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, r.ids)).encode()).hexdigest()


def test_run_is_the_stages(spark, stages):
    assert {tuple(r) for r in C.run(spark, SF_SMALL).drop("ids").collect()} == {tuple(r) for r in stages[-1].drop("ids").collect()}


def test_stages_on_odd_rows(spark, stages):
    rows = [(1, None, "en"), (2, "", None), (3, "12 !!", "de"), (4, "the the of and that with the in on er of to", "en"),
            (4, "the the of and that with the in on er of to", "en"), (5, "the the of and that with the in on er of to", "en"),
            (None, "of the and that in with er on to mail a.b@c.example.com", "en")]
    docs = (spark.createDataFrame(rows, "doc_id long, text string, lang string")
            .withColumns({"row": F.lit(1), "digest": F.lit("x"), "component": F.lit(2), "n_chars": F.length("text").cast("long")}))
    for frame, n in ((docs, 2), (docs.where("1 = 0"), 0)):
        out = frame
        for name, stage in C.STAGES:
            # The byte network needs labelled rows: it learns from the whole table here.
            out = langid.keep_identified(out, langid.fit(stages[0])) if name == "language_id" else stage(spark, out, SF_SMALL)
            out = written(out, "test-odd")
        got = sorted((r.doc_id or -1) for r in out.collect())
        assert got == [-1, 4][:n]
    empty_model = C.identify_language(spark, docs.where("1 = 0"), SF_SMALL)
    assert empty_model.count() == 0


def test_any_number_of_languages_is_learned(spark, stages):
    n = 150
    letters = [chr(0x4E00 + i) for i in range(n)]
    rows = [(i, letters[i % n] * 40, f"l{i % n:03}") for i in range(30 * n)] + [(30 * n + i, "1 2 3", "digits") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert model.languages == sorted({r[2] for r in rows} - {"digits"})
    assert {r.lang_pred for r in langid.predict(docs, model).collect()} <= {*model.languages, "und"}
    assert langid.keep_identified(docs, model).count() > 0
    few = langid.fit(docs.withColumn("doc_id", F.col("doc_id") % 3), train_docs=1)                         # less than one document for each: one is taken
    assert few.languages == model.languages


def test_predictions_in_parts_are_the_same(stages, monkeypatch):
    model = langid.fit(stages[0], train_docs=40)
    texts = [r.text for r in stages[0].limit(40).collect()] + ["word and more " * 3000, None, "a"]
    names, scores = langid.predict_batch(model, texts)
    monkeypatch.setattr(langid, "_CELLS", 1)
    parts, close = langid.predict_batch(model, texts)
    assert parts == names and all(abs(a - b) < 1e-9 for a, b in zip(scores, close))
