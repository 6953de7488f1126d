"""The corpus pipeline stage by stage against brute force."""

from fixtures import SCHEMA, awkward, linked, repeated, words

import corpus_pipeline
from sessionlode.llm import bpe, mixing, quality_rules
from sessionlode.llm.queries import tokenizer_path


def test_stages(spark, tmp_path):
    rows = [r for r in awkward(7, 40) if r[0] is not None]
    docs = spark.createDataFrame(rows, SCHEMA)
    columns = docs.columns
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "n-gram Jaccard join", "mixing sources to target weights", "BPE encoding and decoding"]
    stages = [f for _, f in corpus_pipeline.STAGES]
    before = {r["doc_id"] for r in quality_rules.judge(docs).where("kept").collect()}
    out = stages[0](spark, docs, str(tmp_path))
    assert out.columns == columns
    kept = [tuple(r) for r in out.collect()]
    assert {r[0] for r in kept} == before and all(r[4] == len(r[1]) for r in kept)
    out = stages[1](spark, spark.createDataFrame(kept, SCHEMA), str(tmp_path))
    gone, left = repeated(kept), {}
    for d, text, *_ in kept:
        t = "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone.get(d, []))
        if d not in gone or words(t):
            left[d] = t
    kept = [tuple(r) for r in out.collect()]
    assert {r[0]: r[1] for r in kept} == left and out.columns == columns
    out = stages[2](spark, spark.createDataFrame(kept, SCHEMA), str(tmp_path))
    want = {d for d, (_, c) in linked(kept, 5, 8, 10).items() if c == d}
    kept = [tuple(r) for r in out.collect()]
    assert {r[0] for r in kept} == want
    out = stages[3](spark, spark.createDataFrame(kept, SCHEMA), str(tmp_path))
    assert sorted(map(tuple, out.collect()), key=str) == sorted(kept, key=str) and out.columns == columns
    final = stages[4](spark, out, str(tmp_path))
    assert {r["doc_id"] for r in final.collect()} == want
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(map(tuple, final.collect()))


def test_run_is_in_the_order_of_the_mix(spark, tmp_path):
    rows = awkward(9, 60)
    rows += [(3, "Another text that has the number of an earlier one, with quite different words in it.", "en", "s1", 0)]
    rows += [(None, f"A text without a number, the {w} one of them, and long enough to stay where it is.", "en", "s1", 0) for w in ("first", "second", "third")]
    spark.createDataFrame(rows, SCHEMA).repartition(6).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, docs, str(tmp_path))
        docs = spark.createDataFrame(out.collect(), out.schema)
    want = bpe.round_trip(mixing.schedule(docs), tokenizer_path()).collect()
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    key = lambda r: (r["mix_position"], r["doc_id"], r["ids_sha256"])
    assert len(want) > 30 and list(map(key, got)) == sorted(map(key, want))
