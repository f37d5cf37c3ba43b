"""The pipeline's stages against brute force, each on its own input."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F
from test_decontaminate import by_hand as leaks_by_hand
from test_dedup import lines_by_hand
from test_near_copies import kept_by_hand
from test_toxicity import corpus

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rows, labels = corpus(7, 300)
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    texts = [(k, f"{t}\nsite notice\n" if k % 2 else t) for k, t in rows]
    texts += [(1000 + k, f"fine text number {k} of its own kind {item.upper()} and more") for k in range(3)]
    texts += [(2000 + k, rows[5][1]) for k in range(4)] + [(3000, ""), (3001, None)]
    full = [(k, t, "en", f"src{k % 2}", len(t or ""), "extra") for k, t in texts]
    d = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, more string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages(spark, tables):
    from topoeval.llm import line_dedup, queries, toxicity
    from topoeval.llm.common import written

    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{tables}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{tables}/labels.parquet"))
    library = Tokenizer.from_file(queries.tokenizer("word_bpe_49k.json"))
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        docs = written(stage(spark, docs, tables), f"test-{name}")
        after = {r.doc_id: r for r in docs.collect()}
        if name == "toxicity":
            want = {i for i, r in before.items() if model.score(r.text or "") < 0.5}
        elif name == "line_dedup":
            rows = [(i, r.text, r.source) for i, r in before.items()]
            want = {x[0]: x[1] for x in lines_by_hand(rows, line_dedup.MAX_RATIO, line_dedup.MIN_PAGES)}
            assert {i: r.text for i, r in after.items()} == want
            assert any("site notice" in (r.text or "") for r in before.values()) and not any("site notice" in (r.text or "") for r in after.values())
            want = set(before)
        elif name == "near_dedup":
            want = set(kept_by_hand([(i, r.text) for i, r in before.items()]))
            assert len(want) < len(before)
        elif name == "decontaminate":
            want = {x[0] for x in leaks_by_hand([(i, r.text) for i, r in before.items()], [(1, " ".join(["alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"]))]) if not x[2]}
            assert {1000, 1001, 1002} & set(before) and not {1000, 1001, 1002} & want
        else:
            want = set(before)
            for i, r in after.items():
                ids = library.encode(before[i].text or "", add_special_tokens=False).ids
                assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert set(after) == want, name
        if name != "bpe":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_run(spark, tables):
    out = corpus_pipeline.run(spark, tables)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert 0 < out.count() < 300 and out.select(F.count_distinct("doc_id")).first()[0] == out.count()
