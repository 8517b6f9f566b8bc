"""The pipeline's stages take effect, keep columns, and equal the operators' plain versions."""

import re

import corpus_pipeline
from test_groups import classes_of
from test_maps import ITEM, LONG, documents, stats_of

from ledgerlake.llm import decontam, secrets

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near duplicates", "benchmark decontamination", "secret scans", "byte-level BPE"] and corpus_pipeline.ORACLE_SQL is None
    docs = documents(spark)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF).cache()
        before, after = {r.doc_id: r for r in docs.collect()}, {r.doc_id: r for r in out.collect()}
        assert set(after) <= set(before) and out.count() == len(after)
        if k < 4:
            assert out.columns == docs.columns
        gone = {i: before[i].text for i in set(before) - set(after)}
        if name == "quality rules":
            kept = {i: stats_of(r.text) for i, r in after.items()}
            assert all(s[0] >= 50 and 2 * s[4] <= s[0] for s in kept.values())
        elif name == "near duplicates":
            classes = classes_of([(i, r.text) for i, r in before.items()])
            assert set(after) == {min(i for i, r in before.items() if classes[r.text] == c) for c in set(classes.values())}
        elif name == "benchmark decontamination":
            items = [b" ".join(decontam.tokens(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            leaks = lambda t: any(item in b" ".join(decontam.tokens(t)) for item in items)  # noqa: B023, E731
            assert all(leaks(t) for t in gone.values()) and not any(leaks(r.text) for r in after.values())
        elif name == "secret scans":
            assert not gone and not any(secrets.base_spans(r.text) for r in after.values())
        else:
            assert not gone and all(r.text == before[i].text and r.n_tokens == len(r.ids.split()) for i, r in after.items())
        docs = out


def test_run_equals_its_stages(spark):
    got = corpus_pipeline.run(spark, SF)
    docs = documents(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, docs.collect()))


def test_pipeline_of_edge_cases(spark, edge, empty, tmp_path):
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for docs in (edge, empty):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, str(tmp_path))
        assert {"doc_id", "text", "lang", "n_tokens", "ids", "fp", "part"} <= set(docs.columns)
        docs.collect()


def test_planted_documents(spark, tmp_path):
    """Copies, a leak, a secret and junk among clean documents: all are caught, the clean ones stay as they are."""
    words = re.findall(r"\w+", LONG)
    clean = [" ".join(f"{words[(k + n) % len(words)]}{n}x{k % 97}" for k in range(90)) for n in range(12)]
    near = clean[0].replace("0x40 ", "0x41 ", 1)
    texts = [*clean, clean[1], near, clean[2] + " " + ITEM, clean[3] + ' token = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b" end', "### $$$ " * 60, "short"]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 12), 0) for i in range(18)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = {r.doc_id: r.text for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert all(out.get(i) == clean[i] for i in (0, 1, 4, 5, 6, 7, 8, 9, 10, 11)) and not {12, 13, 16, 17} & set(out)
    assert 14 not in out and "9f86d081" not in " ".join(out.values())
