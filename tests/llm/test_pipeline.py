"""The pipeline's stages against brute force on a small table, and the registered queries."""

import corpus_pipeline
import __spark_entry__ as entry
from pyspark.sql import functions as F

from vaultlens.llm import queries, quality, simhash


def test_registered():
    known = entry.queries()
    for n in range(1, 11):
        assert sum(q.startswith(f"op{n}_") for q in known) == 1
    assert known["pipeline"] is corpus_pipeline.run
    assert set(queries.oracle_sql()) < set(queries.queries())


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    seen = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf)
        if k + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == columns, name
        docs = docs.cache()
        seen.append({r.doc_id: r for r in docs.collect()})
    first = {r.doc_id for r in quality.judged(spark.read.parquet(f"{sf}/documents.parquet")).where(F.col("kept")).collect()}
    assert set(seen[0]) == first
    fps = {d: simhash.fingerprint(r.text) for d, r in seen[1].items()}
    left = set(seen[2])
    for d in seen[1]:
        near = [e for e in fps if e < d and (fps[e] ^ fps[d]).bit_count() <= 3]
        assert (d in left) == (not near)
    bench = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]

    def shingles(t):
        ws = t.lower().split()
        return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))}

    items = [shingles(t) for t in bench]
    for d, r in seen[2].items():
        s = shingles(r.text)
        assert (d not in seen[3]) == any(5 * len(s & i) >= 4 * len(i) for i in items)
    assert set(seen[4]) == set(seen[3])
    assert all(r.n_chars == len(r.text) for r in seen[1].values())


def test_empty_table(spark, sf, tmp_path):
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{sf}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
