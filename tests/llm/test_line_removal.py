"""Lines above the limits leave the text; the other lines stay as they are."""

from __future__ import annotations

import pytest

from quillspark.llm import line_quality


@pytest.mark.parametrize("few", [0, 10_000])
def test_frequent_lines_leave_the_text(spark, monkeypatch, few):
    monkeypatch.setattr(line_quality, "BROADCAST_LINES", few)
    rows = [(i, f"Terms  of\tUse\nown {i} Line\n\n  kept as is \r\nterms of use", "a", "x") for i in range(11)]
    rows += [(50, "terms of use\nother host", "b", "x"), (51, None, "a", "x"), (52, "", None, "x"), (None, "terms of use\nterms", "a", "x"), (3, "terms of use", "a", "x"), (3, "terms of use\nz", "b", "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, _note string")
    got = sorted((str(r["doc_id"]), str(r["source"]), r["text"]) for r in line_quality.cleaned(d).collect())
    # "kept as is" stands in 11 documents of host a as well, so it goes; blank lines and the other host's lines stay.
    want = [(str(i), "a", f"own {i} Line\n") for i in range(11)]
    want += [("50", "b", "terms of use\nother host"), ("51", "a", None), ("52", "None", ""), ("None", "a", "terms"), ("3", "a", ""), ("3", "b", "terms of use\nz")]
    assert got == sorted(want, key=lambda x: (x[0], x[1], x[2]) if x[2] is not None else (x[0], x[1], ""))
    assert line_quality.cleaned(d).columns == d.columns
    rows = {(r["doc_id"], r["n_words"]): r["removed_words"] for r in line_quality.quality(d).collect()}
    assert rows[0, 12] == 9 and rows[50, 5] == 0 and rows[3, 12] == rows[3, 3] == rows[3, 4] == 12
