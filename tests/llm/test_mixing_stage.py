"""The mixing stage takes its leaves' budgets to the token, and rows without a doc_id one by one."""

from __future__ import annotations

import collections

import corpus_pipeline
from quillspark.llm import mixing
from tests.llm.conftest import SCHEMA


def test_mixing_stage_takes_what_is_due(spark):
    texts = [" ".join(f"w{i}x{k}" for k in range(n)).replace(" ", "\n  ", 3) for i, n in enumerate((7, 1000, 301, 44, 5, 90, 13))]
    for ids in (list(range(7)), [None] * 7):
        rows = [(i, t, "en", "src0", len(t), "d", "k") for i, t in zip(ids, texts)]
        out = corpus_pipeline.mixed(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
        total = sum(len(t.split()) for t in texts)
        assert sum(len(r["text"].split()) for r in out) == total * mixing.BUDGET_PERCENT // 100
        assert all(any(t.startswith(r["text"]) for t in texts) and r["n_chars"] == len(r["text"]) for r in out)
        assert sum(r["text"] not in texts for r in out) <= 1 and max(collections.Counter(r["text"] for r in out).values()) <= mixing.MAX_EPOCHS
