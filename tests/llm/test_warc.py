from __future__ import annotations

import gzip
import hashlib
import json
from pathlib import Path

from quillspark.llm import warc

SCHEMA = "page_id long, url string, html string, digest string, first long"


def rows():
    out = [(i, f"http://h/{i}", f"<p>{i % 7} é</p>" * (i % 5 + 1)) for i in range(60)]
    out += [(60, None, None), (61, "http://x\r\nEvil: 1", ""), (62, "u", "big " * 300_000), (5, "http://h/5", "<p>5 é</p>"), (None, "n", "<p>0 é</p>"), (None, "n", "alone")]
    return [(*r, "d", 1) for r in out]


def brute(data):
    first = {}
    for p, _, h, *_ in data:
        if p is not None:
            first[h or ""] = min(p, first.get(h or "", p))
    out = []
    for p, _, h, *_ in data:
        b = (h or "").encode()
        f = first.get(h or "")
        revisit = f is not None and f != p
        out.append((p, len(b), warc.base32_sha1(b), "revisit" if revisit else "response", f if revisit else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    got = warc.archived(spark.createDataFrame(rows(), SCHEMA).repartition(5)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows())


def test_files_do_not_depend_on_partitions(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "SHARD_BYTES", 300)
    monkeypatch.setattr(warc, "ROLL_BYTES", 700)
    d = spark.createDataFrame(rows(), SCHEMA)
    made = [warc.write(d.repartition(n), (tmp_path / str(n)).as_uri()) for n in (1, 6)]
    assert made[0] == made[1] and len(made[0]) > 3
    for x in made[0]:
        data = (tmp_path / "1" / x["file"]).read_bytes()
        assert hashlib.sha256(data).hexdigest() == x["sha256"] and gzip.decompress(data).count(b"WARC/1.1\r\n") == x["records"]
    assert json.loads((tmp_path / "1" / "_manifest.json").read_text()) == made[0]
    assert not (tmp_path / "1" / "_temporary").exists()
    ids = [int(m.split(b"Page-Id: ")[1].split(b"\r\n")[0] or -1) for x in made[0] for m in warc.members((tmp_path / "1" / x["file"]).read_bytes())]
    assert ids == sorted(ids)


def test_headers_and_damage():
    r = warc.record(9, "http://a b", b"body", 3)
    head = r.split(b"\r\n\r\n")[0].decode()
    assert "WARC-Type: revisit" in head and "WARC-Target-URI: http://a%20b" in head and "Refers-To-Page: 3" in head
    full = warc.record(3, "u", b"body", 3)
    assert warc.parsed(full)[:5] == (3, 4, warc.base32_sha1(b"body"), "response", None)
    try:
        warc.parsed(full.replace(b"body", b"bodx"))
    except ValueError:
        pass
    else:
        raise AssertionError("damage isn't seen")


def test_shards(spark):
    ids = [-1, 4, 5, 8, 9, 99, 100, 101, 500]
    frame = spark.createDataFrame([(i,) for i in ids], "x long")
    for bounds in ([], [5], [5, 9, 100], [5, 9, 100, 101]):
        assert [r[0] for r in frame.select(warc.place("x", bounds)).collect()] == [warc.shard_of(i, bounds) for i in ids]


def test_heavy_ranges_of_ids_are_cut(spark, monkeypatch):
    """Ids in a hundred dense clumps far apart, and one id with many rows: no shard but that id's holds more than its size."""
    ids = [c * 10**12 + i for c in range(100) for i in range(40)] + [7 * 10**13 + 5] * 300
    sizes = spark.createDataFrame([(i, 10) for i in ids], "page_id long, bytes long")
    monkeypatch.setattr(warc, "BINS", 8)
    bounds = warc._bounds(sizes, 100)
    held = {}
    for i in ids:
        held[warc.shard_of(i, bounds)] = held.get(warc.shard_of(i, bounds), 0) + 10
    assert sorted(held.values())[-2] <= 100 and max(held.values()) <= 3100 and len(held) >= 400


def test_empty(spark, tmp_path: Path):
    assert warc.archived(spark.createDataFrame([], SCHEMA)).collect() == []
