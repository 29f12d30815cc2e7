"""The pipeline's stages, each against what it should keep of its own input."""

from __future__ import annotations

from pathlib import Path

import corpus_pipeline as p
from quillspark.llm import near_dedup
from tests.llm.test_operators import brute_spans


def test_stages(spark, docs, corpus):
    at, before = docs, docs
    seen = {}
    for name, stage in p.STAGES:
        out = stage(spark, at, "")
        rows = out.collect()
        seen[name] = rows
        if name != p.STAGES[-1][0]:
            assert out.columns == docs.columns, name
            before, at = at, spark.createDataFrame(rows, docs.schema)
        if name == "near_duplicates":
            kept = {r["doc_id"] for r in near_dedup.near_duplicates(before).collect() if r["kept"]}
            assert {r["doc_id"] for r in rows} - {None} == kept - {None}
    assert len(seen["language"]) == sum(any(c.isalpha() for c in r[1] or "") for r in corpus)
    assert all(not brute_spans(r["text"]) for r in seen["personal_data"]) and all(r["n_chars"] == len(r["text"]) for r in seen["personal_data"])
    assert {r["doc_id"] for r in seen["mixing"]} <= {r["doc_id"] for r in seen["personal_data"]}
    assert len(seen["encoding"]) == len(seen["mixing"]) and all(r["n_tokens"] == len(r["ids"].split()) for r in seen["encoding"])


def test_run(spark, docs, tmp_path: Path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert p.run(spark, str(tmp_path)).count() > 0
