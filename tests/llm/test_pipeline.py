import random

import pytest

import __spark_entry__
import corpus_pipeline
from anontext.llm import best_fit, fingerprint_dedup, span_dedup, toxicity
from tests.llm.test_fingerprint_dedup import groups
from tests.llm.test_similar_dedup import jaccard
from tests.llm.test_span_dedup import brute as repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def tables(spark, make, words, tmp_path_factory):
    r, texts, labels = random.Random(1), [], []
    passage = words(70, 999)
    for i in range(160):
        w = words(r.randint(60, 160), i)
        toxic = i % 4 == 0
        if toxic:
            for _ in range(4):
                w.insert(r.randrange(len(w)), r.choice(["idiot", "scum", "moron"]))
        if i % 10 == 1:
            w[5:5] = passage
        texts.append(" ".join(w))
        labels.append((i, int(toxic)))
    texts += [texts[1], texts[2] + "\n", texts[3].upper(), None, "", ""]
    path = str(tmp_path_factory.mktemp("tables"))
    make(texts, extra=False).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, texts, labels


def test_stages(spark, tables, monkeypatch):
    path, texts, labels = tables
    monkeypatch.setattr(toxicity, "STEPS", 150)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "repeated_spans", "packing"]
    docs = spark.read.parquet(f"{path}/documents.parquet")
    first, second, third, fourth = [f for _, f in corpus_pipeline.STAGES]

    clean = first(spark, docs, path).cache()
    assert clean.columns == COLUMNS
    kept = {r.doc_id: r.text for r in clean.collect()}
    toxic = {i for i, y in labels if y}
    assert len(toxic & set(kept)) <= 1 and len({i for i in range(160) if i not in toxic} - set(kept)) <= 1
    assert {i: t for i, t in enumerate(texts) if i in kept} == kept

    single = second(spark, clean, path).cache()
    assert single.columns == COLUMNS
    root = groups(list(kept), lambda a, b: jaccard(kept[a], kept[b]) >= 0.8)
    left = {r.doc_id: r.text for r in single.collect()}
    assert set(left) == set(root.values()) and all(kept[i] == t for i, t in left.items())

    cut = third(spark, single, path).cache()
    assert cut.columns == COLUMNS
    want = repeats(list(left.items()))
    for r in cut.collect():
        n, gone, words_left = want[r.doc_id]
        assert r.text == (words_left.decode() if gone else left[r.doc_id] or "") and r.n_chars == len(r.text)
    assert any(gone for _, gone, _ in want.values())

    packed = fourth(spark, cut, path).collect()
    assert {r.doc_id for r in packed} == set(left)
    clean.unpersist(), single.unpersist(), cut.unpersist()


def test_run_and_registration(spark, tables, monkeypatch):
    path, _, _ = tables
    monkeypatch.setattr(toxicity, "STEPS", 150)
    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    assert "pipeline" not in __spark_entry__.oracle_sql()
    assert {f"op{n}" for n in range(1, 11)} <= {k.split("_")[0] for k in __spark_entry__.queries()}
    rows = corpus_pipeline.run(spark, path).collect()
    assert rows and all(r.offset + r.length <= best_fit.CAPACITY for r in rows)


def test_empty_documents_pass_through(spark, make, tables):
    path, _, _ = tables
    docs = make([], extra=False)
    for _, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, docs, path).count() == 0
    assert toxicity.score(docs, 0.0).count() == fingerprint_dedup.keep_one(docs).count() == 0
    assert span_dedup.remove_repeats(docs, ["doc_id"], {"text": "string"}).count() == 0
