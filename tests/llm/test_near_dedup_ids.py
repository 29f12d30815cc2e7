"""Near duplicates where ids repeat with other texts: every text of an id links, against all pairs."""

from __future__ import annotations

import collections
import random

from quillspark.llm import near_dedup
from tests.llm.test_operators import shingles


def components(rows):
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    sets = [shingles(t) for _, t in rows]
    for i, (a, _) in enumerate(rows):
        for j, (b, _) in enumerate(rows[:i]):
            if a == b or sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    low = collections.defaultdict(list)
    for i, (a, _) in enumerate(rows):
        low[find(i)].append(a)
    return collections.Counter((a, len(sets[i]), min(low[find(i)])) for i, (a, _) in enumerate(rows))


def test_repeated_ids_with_near_copies(spark):
    rnd = random.Random(3)
    vocab = [f"w{i}" for i in range(400)]
    text = lambda n: [rnd.choice(vocab) for _ in range(n)]
    a, b, c = text(100), text(100), text(100)
    other = [*a[:50], "changed", *a[51:]]
    rows = [(1, a), (2, other), (1, b), (2, c), (7, [*b[:30], "odd", *b[31:]]), (8, text(80)), (9, [*c[:80], "last", *c[81:]]), (9, text(40)), (9, text(40))]
    rows = [(i, " ".join(w)) for i, w in rows]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()) == components(rows)
    assert components(rows)[(9, len(shingles(rows[6][1])), 1)] == 1


def test_groups_around_the_threshold(spark):
    """One template whose copies lie on both sides of the similarity, so that buckets hold many components."""
    rnd = random.Random(4)
    vocab = [f"v{i}" for i in range(500)]
    base = [rnd.choice(vocab) for _ in range(120)]
    rows = []
    for i in range(160):
        w = list(base)
        for k in rnd.sample(range(120), rnd.randint(1, 8)):
            w[k] = rnd.choice(vocab)
        rows.append((i + 1, " ".join(w)))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()) == components(rows)
