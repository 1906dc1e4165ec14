"""The pipeline against plain Python stage by stage, and on odd rows."""

import hashlib

import corpus_pipeline as pipeline
from lithos.llm import secrets, toxicity
from lithos.llm.registry import fold_of
from lithos.sources.tables import read_table

from .helpers import groups, odd_docs
from .test_documents import _fingerprint, _plain_score


def test_stages(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    kept = {}
    for name, stage in pipeline.STAGES[:-1]:
        before, docs = docs, pipeline.written(stage(spark, docs, sf_dir), name)
        assert docs.columns == before.columns
        old, kept[name] = {r["doc_id"]: r["text"] for r in before.collect()}, {r["doc_id"]: r["text"] for r in docs.collect()}
        assert docs.count() == len(kept[name])
        if name == "toxicity":
            labels = read_table(spark, sf_dir, "labels").where(fold_of("doc_id", 5) != 0)
            model = toxicity.fit(before, labels, "doc_id", "text", "toxic")
            scores = {i: _plain_score(t, model) for i, t in old.items()}
            assert min(abs(x - 0.5) for x in scores.values()) > 1e-5 and 0 < len(kept[name]) < len(old)
            assert set(kept[name]) == {i for i, x in scores.items() if x < 0.5}
        elif name == "simhash_near_dedup":
            fps = {i: _fingerprint(t) for i, t in old.items()}
            ids = sorted(fps)
            links = [(a, b) for a in ids for b in ids if a < b and (fps[a] ^ fps[b]).bit_count() <= 4]
            assert set(kept[name]) == {i for i, g in groups(links, ids).items() if i == g}
        elif name == "benchmark_decontamination":
            items = [r["text"] for r in read_table(spark, sf_dir, "benchmark").collect()]
            assert not any(x in t for t in kept[name].values() for x in items)
            assert set(kept[name]) <= set(old)
        elif name == "secret_scan":
            assert set(kept[name]) == set(old)
            assert secrets.scan(docs, "doc_id", "text").where("n_spans > 0").count() == 0
    last = {r["doc_id"]: r for r in pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()}
    assert set(last) == set(kept["secret_scan"])
    for i, text in kept["secret_scan"].items():
        assert last[i]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()


def test_odd_rows_and_empty(spark, sf_dir):
    for docs in (odd_docs(spark), odd_docs(spark).limit(0)):
        columns = docs.columns
        for name, stage in pipeline.STAGES:
            docs = stage(spark, docs, sf_dir)
            if name != "byte_bpe":
                docs = pipeline.written(docs, "odd")
                assert docs.columns == columns
        docs.collect()


def test_registered():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert toxicity.LANGUAGES[0] == "other"
