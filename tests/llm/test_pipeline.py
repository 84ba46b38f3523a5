import re
from collections import defaultdict

import corpus_pipeline
import brute
from redline.llm import queries
from redline.llm.common import table


def test_stages_against_brute_force(spark):
    d = "/root/testdata/sf0.001"
    docs = table(spark, d, "documents")
    columns = docs.columns
    labels = {r["doc_id"]: r["toxic"] for r in table(spark, d, "labels").collect()}
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        out = stage(spark, docs, d)
        if name == "packing":
            tokens = defaultdict(int)
            for r in out.collect():
                tokens[r["doc_id"]] += r["length"]
            assert set(tokens) == set(before)
            break
        assert out.columns == columns
        out = out.cache()
        after = {r["doc_id"]: r for r in out.collect()}
        order = sorted(before)
        if name == "toxicity":
            gone = set(before) - set(after)
            assert all(labels.get(i, 1) for i in gone)
        elif name == "line_dedup":
            cut = dict(zip(order, brute.cut_lines([before[i]["text"] for i in order])))
            assert {i: r["text"] for i, r in after.items()} == {i: t for i, t in cut.items() if t or not before[i]["text"]}
        elif name == "near_dedup":
            first = brute.components([before[i]["text"] for i in order])
            assert set(after) == {order[k] for k in set(first)}
        elif name == "secrets":
            assert set(after) == set(before)
            assert not any(re.search(r'(?i)token = "[0-9a-f]{40}"', r["text"]) for r in after.values())
        assert all(r["n_chars"] == len(r["text"]) for r in after.values())
        seen[name] = len(after)
        docs = out
    assert list(seen) == ["toxicity", "line_dedup", "near_dedup", "secrets"]
    total = queries.pipeline(spark, d).agg({"length": "sum"}).first()[0]
    assert total == sum(tokens.values())


def test_pipeline_edges(spark, edge_docs, empty_docs, scratch):
    for docs in (edge_docs, empty_docs):
        columns = docs.columns
        labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
        labels.write.mode("overwrite").parquet(f"{scratch}/labels.parquet")
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, scratch)
            rows = out.collect()
            if name != "packing":
                assert out.columns == columns
                docs = spark.createDataFrame(rows, out.schema)
