import brute
import corpus_pipeline as P
from codequarry.llm import decontam, toxicity
from codequarry.llm.secrets import with_spans


def test_stages_take_effect(spark, small):
    d = small.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{d}/documents.parquet").cache()
    columns, seen = docs.columns, docs
    labels, bench = spark.read.parquet(f"{d}/labels.parquet"), spark.read.parquet(f"{d}/benchmark.parquet")
    for name, stage in P.STAGES[:-1]:
        before, after = seen, stage(spark, seen, d).cache()
        assert after.columns == columns
        old, new = ({r.doc_id: r.text for r in x.select("doc_id", "text").collect()} for x in (before, after))
        gone = set(old) - set(new)
        if name == "toxicity":
            assert gone == {r.doc_id for r in toxicity.judge(before, labels).where("toxic").collect()} and gone
        elif name == "minhash_near_dedup":
            classes = brute.near_classes(list(old.items()))
            assert set(new) == {i for i, (_, c) in classes.items() if i == c} and gone
        elif name == "benchmark_decontamination":
            assert gone == {r.doc_id for r in decontam.contaminated(before, bench).collect()} and gone
        else:
            assert not gone and new != old and with_spans(after).where("size(base_spans) > 0").count() == 0
        seen = after
    last = P.STAGES[-1][1](spark, seen, d).collect()
    assert {r.doc_id for r in last} == {r.doc_id for r in seen.select("doc_id").collect()}
    assert sorted(map(tuple, P.run(spark, d).collect())) == sorted(map(tuple, last))


def test_shape():
    assert [n for n, _ in P.STAGES] == ["toxicity", "minhash_near_dedup", "benchmark_decontamination", "secret_scan", "source_mixing"]
    assert P.ORACLE_SQL is None and P.QUERIES["pipeline"] is P.run


def test_empty_and_odd_documents(spark, make, small):
    for rows in ([], [(1, None), (2, ""), (None, "a b c"), (3, "same text of words"), (3, "same text of words")]):
        docs = make(rows)
        for _, stage in P.STAGES[:-1]:
            docs = stage(spark, docs, small)
            assert docs.columns == make([]).columns
        out = P.STAGES[-1][1](spark, docs, small).collect()
        assert len(out) == (4 if rows else 0)
