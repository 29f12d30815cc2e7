"""Vector codes, SimHash near duplicates and the prefix trie against brute force, with nulls, ties, empty tables and clashing names."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillspark.llm import prefix_trie, simhash, vector_codes


def _full(x, book):
    d = ((x[:, None, :] - book[None, :, :]) ** 2).sum(2)
    return d.argmin(1), d.min(1)


@pytest.mark.parametrize("width", [1, 3, 16])
def test_partial_distance_equals_full_search(width):
    """Ties included: few distinct values make many equal distances."""
    rnd = np.random.default_rng(width)
    for top in (2, 5, 1000):
        x, book = (rnd.integers(-top, top + 1, (n, width)).astype(np.int64) for n in (700, 50))
        found, wanted = vector_codes.nearest(x, book), _full(x, book)
        assert (found[0] == wanted[0]).all() and (found[1] == wanted[1]).all()


def _codes(rows):
    """Vectors as dealt: (vec_id, vector, label) to what the query returns."""
    kept = [(i, np.array([math.floor(1024 * c) for c in v], np.int64), x) for i, v, x in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1].tolist()))
    m = np.stack([v for _, v, _ in kept]).reshape(len(kept), 4, -1)
    book = m[:256].transpose(1, 0, 2).copy()
    for _ in range(4):
        for p in range(4):
            near = _full(m[:, p], book[p])[0]
            for e in set(near.tolist()):
                mine = m[near == e, p]
                book[p, e] = mine.sum(0) // len(mine)
    found = [_full(m[:, p], book[p]) for p in range(4)]
    digest = hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()
    error = sum(f[1] for f in found)
    by_label = defaultdict(int)
    for (_, _, x), e in zip(kept, error.tolist(), strict=True):
        by_label[x] += e
    return sorted((str(i), bytes(int(f[0][k]) for f in found).hex(), int(error[k]), by_label[x], digest) for k, (i, _, x) in enumerate(kept))


VECTORS = "vec_id long, embedding array<float>, label int, code string, of string, v int"


def test_vector_codes(spark):
    rnd = random.Random(3)
    pick = lambda: [float(np.float32(rnd.choice([rnd.gauss(0, 0.3), 0.5, -0.25]))) for _ in range(8)]
    same = pick()
    rows = [(i, same if i % 3 == 0 else pick(), [0, 1, None][i % 7 % 3]) for i in range(420)]
    rows += [(7, pick(), 1), (None, pick(), None), (500, None, 1), (501, [*pick()[:7], None], 1), (502, [*pick()[:7], float("nan")], 1), (503, [*pick()[:7], float("-inf")], 1), (504, [], 1)]
    d = spark.createDataFrame([(*r, "c", "o", 1) for r in rows], VECTORS).repartition(5)
    found = sorted((str(r["vec_id"]), r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in vector_codes.compressed(d).collect())
    assert found == _codes(rows)
    few = rows[:20]
    found = sorted((str(r["vec_id"]), r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in vector_codes.compressed(spark.createDataFrame([(*r, "c", "o", 1) for r in few], VECTORS)).collect())
    assert found == _codes(few)
    odd = spark.createDataFrame([(1, [0.5] * 8, 1, "c", "o", 1), (2, [0.5] * 12, 1, "c", "o", 1), (3, [3e38] * 8, 1, "c", "o", 1)], VECTORS)
    assert sorted(r["vec_id"] for r in vector_codes.compressed(odd).collect()) == [1, 3]


def test_vector_codes_of_nothing(spark):
    out = vector_codes.compressed(spark.createDataFrame([], VECTORS))
    assert out.count() == 0 and out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def _fingerprint(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    s = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _grouped(prints, distance=4):
    """Smallest reachable id of each (id, fingerprint), by comparing all."""
    up = list(range(len(prints)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, (a, x) in enumerate(prints):
        for j in range(i):
            b, y = prints[j]
            if (x ^ y).bit_count() <= distance or (a is not None and a == b):
                up[root(i)] = root(j)
    low = {}
    for i, (a, _) in enumerate(prints):
        if a is not None:
            low[root(i)] = min(a, low.get(root(i), a))
    return [low.get(root(i)) for i in range(len(prints))]


def test_fingerprints_by_pieces():
    rnd = random.Random(1)
    for n in (0, 1, 3, 4, 5, 200):
        text = "".join(rnd.choice(["Ab", "c", "dé", "ééé"]) + rnd.choice([" ", "\n", "  ", "\t\x0b", "\x0c\r"]) for _ in range(n))
        for piece in (3, 17, 1 << 20):
            assert simhash.fingerprint(text.encode(), piece) % (1 << 64) == _fingerprint(text), (n, piece)
    assert simhash.fingerprint(b" \n") == 0


def test_simhash_documents(spark, docs, corpus, nothing):
    rows = [(r[0], r[1]) for r in corpus]
    prints = [(i, _fingerprint(t)) for i, t in rows]
    wanted = sorted((str(i), f"{x:016x}", str(c)) for (i, x), c in zip(prints, _grouped(prints), strict=True))
    clash = docs.select("*", *[F.lit("own").alias(x) for x in ("fp", "seg", "comp", "fingerprint", "component_id")])
    for d in (docs, clash):
        out = simhash.near_duplicates(d)
        assert out.columns == ["doc_id", "fingerprint", "component_id"]
        assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in out.collect()) == wanted
    assert simhash.near_duplicates(nothing).count() == 0


@pytest.mark.parametrize(("hot", "many"), [(512, 1 << 25), (3, 1 << 25), (512, 1), (3, 1)])
def test_links_connect_what_is_near(spark, hot, many):
    """Chains of flips, distances around the limit, crowded segments (sent to midpoints) and either number of segments give the components of all pairs."""
    rnd = random.Random(9)
    prints = {rnd.getrandbits(64) for _ in range(60)}
    for start in list(prints)[:6]:
        x = start
        for _ in range(12):
            for b in rnd.sample(range(64), rnd.choice([3, 4, 5])):
                x ^= 1 << b
            prints.add(x)
    heart = rnd.getrandbits(64)
    for k in range(60):  # near copies of one text: a crowd in every segment
        prints.add(heart ^ sum(1 << b for b in rnd.sample(range(64), 1 + k % 5)))
    prints = sorted(prints | {0, 1, (1 << 64) - 1, 0b11110, 0b1111100000})
    signed = [(simhash._long(x),) for x in prints]
    found = simhash.components(simhash.links(spark.createDataFrame(signed, "fp long"), hot=hot, many=many)).collect()
    label = {r["id"] % (1 << 64): r["comp"] for r in found}
    wanted = _grouped(list(enumerate(prints)))
    groups, own = defaultdict(set), defaultdict(set)
    for x, w in zip(prints, wanted, strict=True):
        groups[w].add(x)
        own[label.get(x, f"alone {x}")].add(x)
    assert sorted(map(sorted, own.values())) == sorted(map(sorted, groups.values()))


def _trie(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            key = f"{len((role or '').encode())}:{role or ''}{text or ''}"
            convs[c].append(((turn is not None, turn or 0), hashlib.md5(key.encode()).digest(), role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in convs.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        seq = tuple(own.get(base, [])[:h] + turns[h:])
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
        ends[seq].append(c)
    kids = defaultdict(set)
    for s in members:
        if s:
            kids[s[:-1]].add(s)
    leaves, saved = defaultdict(int), defaultdict(int)
    for s in members:
        for d in range(len(s) + 1):
            leaves[s[:d]] += not kids[s]
            saved[s[:d]] += (len(members[s]) - 1) * (len(s[-1][1]) if s else 0)
    return sorted(
        (min(m), len(s), str(min(members[s[:-1]]) if s else None), len(m), len(kids[s]), leaves[s], saved[s], hashlib.sha256(",".join(map(str, sorted(ends.get(s, [])))).encode()).hexdigest()) for s, m in members.items()
    )


TURNS = "conv_id long, turn long, role string, text string, g string, up string, key string"


@pytest.fixture(scope="module")
def turns():
    rnd = random.Random(4)
    say = lambda: rnd.choice(["hi", "hello there", "", None, "ünï 😀", "yes"])
    rows = []
    for c in range(0, 420, 3):
        rows += [(c, t, rnd.choice(["user", "assistant"]), say()) for t in range(rnd.choice([0, 1, 3, 4, 7, 9]))]
    for c in range(1001, 1300, 2):  # copies, and one beginning for many
        rows += [(c, t, "user", f"turn {t}") for t in range(8)] + ([(c, 8, "user", f"{c % 3}"), (c, 9, None, "end")] if c % 5 else [])
    rows += [(2000, t, "user", str(t % 5)) for t in range(300)] + [(2000, None, "system", None), (2000, 7, "user", "again"), (2000, 7, "user", "again")]
    rows += [(None, 1, "user", "nobody"), (-7, 1, "user", "below zero"), (-100, 1, "user", "base below zero"), (-100, 2, "user", "two")]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("limit", [2000, 60, 1])
def test_prefix_trie(spark, turns, limit):
    d = spark.createDataFrame([(*r, "own", "own", "own") for r in turns], TURNS).repartition(5)
    out = prefix_trie.prefix_trie(d, limit)
    found = sorted((r["conv_id"], r["depth"], str(r["parent_conv_id"]), r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in out.collect())
    assert found == _trie(turns)


def test_prefix_trie_of_nothing_and_of_turnless(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], TURNS)).count() == 0
    # 3 % 6 shared turns of an absent family replace its only turn: it has none.
    c = next(i for i in range(1, 100) if zlib.crc32(str(i).encode()) % 6 >= 1)
    rows = [(c, 1, "user", "gone")]
    out = prefix_trie.prefix_trie(spark.createDataFrame([(*r, "", "", "") for r in rows], TURNS)).collect()
    assert [tuple(r) for r in out] == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]
