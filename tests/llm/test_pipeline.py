"""Each stage of the pipeline against a plain version on its own input."""

from __future__ import annotations

import random
import re

import corpus_pipeline
import pytest
from test_filters import MEDIUM, SPACE, plain_counts
from test_simhash import plain_components, plain_fingerprint
from test_tokens import check_packed
from tokenizers import Tokenizer

from rainledger.llm import language_id
from rainledger.llm.columns import table
from rainledger.llm.queries import vocabulary
from rainledger.sinks.shared import stored


@pytest.fixture(scope="module")
def outputs(spark):
    docs = table(spark, MEDIUM, "documents")
    found = [docs]
    for _, stage in corpus_pipeline.STAGES:
        found.append(stored(stage(spark, found[-1], MEDIUM)))
    return found


def texts(df):
    return {r.doc_id: r.text or "" for r in df.select("doc_id", "text").collect()}


def test_quality_stage(outputs, spark):
    before, after = texts(outputs[0]), texts(outputs[1])
    labels = {r.doc_id: r.quality for r in table(spark, MEDIUM, "labels").collect()}
    passed = {i for i, t in before.items() if not plain_counts(t)[5]}
    assert after.keys() <= passed
    assert sum(labels.get(i) == 1 for i in passed - after.keys()) <= 0.02 * len(passed)
    assert sum(labels.get(i) == 0 for i in after) <= 0.2 * sum(labels.get(i) == 0 for i in passed)


def test_language_stage(outputs):
    docs = outputs[1]
    model = language_id.Classifier(language_id.dictionaries(language_id.training_sample(docs, "text", "lang", "doc_id")))
    want = {i for i, t in texts(docs).items() if model.predict(t)[1] >= language_id.MIN_MARGIN}
    assert texts(outputs[2]).keys() == want and len(want) > 0.98 * docs.count()


def test_exact_stage(outputs):
    first = {}
    for i, t in sorted(texts(outputs[2]).items()):
        first.setdefault(re.sub(SPACE, " ", t), i)
    assert texts(outputs[3]).keys() == set(first.values())


def test_near_stage(outputs):
    comps = plain_components({i: plain_fingerprint(t) for i, t in texts(outputs[3]).items()}, 4)
    assert texts(outputs[4]).keys() == set(comps.values())


def test_packing_stage(outputs):
    model = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    check_packed(outputs[5].collect(), {i: model.encode(t, add_special_tokens=False).ids + [2] for i, t in texts(outputs[4]).items()}, 4096)


def test_stages_keep_the_columns(outputs):
    assert all(df.columns == outputs[0].columns for df in outputs[:-1])


def test_run(spark, outputs):
    assert sorted(map(tuple, corpus_pipeline.run(spark, MEDIUM).collect())) == sorted(map(tuple, outputs[-1].collect()))


def odd_tables(spark, folder, rows, labels):
    fields = "doc_id long, text string, lang string, source string, n_chars long, counts string, lang_pred string, score int, row_key int"
    spark.createDataFrame([(i, t, lang, "s", len(t or ""), "own", "own", 1, 2) for i, t, lang in rows], fields).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_odd_rows_through_all_stages(spark, tmp_path):
    def words(k, n=40):
        rng = random.Random(k)
        return " ".join(("wort" if k % 2 else "parole") + "".join(rng.choices("abcdefghij" if k % 2 else "qrstuvwxyz", k=4)) for _ in range(n))

    rows = [(k, words(k), "de" if k % 2 else "fr") for k in range(40)]
    rows += [(100, None, "de"), (101, "", "fr"), (None, words(50), "fr"), (7, words(7), "de"), (7, words(7), "de"), (3, words(60), None),
             (102, words(5).replace(" ", "  "), "de"), (103, words(9, 60_000), None), (104, "too short", "de")]
    folder = odd_tables(spark, tmp_path / "odd", rows, [(k, 1, 0) for k in range(20)] + [(None, 0, 0), (500, 0, None), (3, None, None)])
    docs = table(spark, folder, "documents")
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, folder))
        assert docs.columns == table(spark, folder, "documents").columns
        assert {(r.counts, r.lang_pred, r.score, r.row_key) for r in docs.collect()} == {("own", "own", 1, 2)}
        kept.append(sorted((str(r.doc_id), re.sub(SPACE, " ", r.text)) for r in docs.collect()))
    assert not {"100", "101", "104"} & {i for i, _ in kept[0]} and ("7", words(7)) in kept[2]
    assert kept[2].count(("7", words(7))) == 1 and len({t for _, t in kept[2]}) == len(kept[2])
    model = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    pieces = corpus_pipeline.run(spark, folder).collect()
    want = sum(len(model.encode(r.text, add_special_tokens=False).ids) + 1 for r in docs.collect())
    assert sum(p.length for p in pieces) == want and len({p.doc_id for p in pieces}) == len({r.doc_id for r in docs.collect()})


def test_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, odd_tables(spark, tmp_path / "none", [], [])).count() == 0
