"""Each operator against a plain brute-force version, on rows with every awkward case."""

from __future__ import annotations

import collections
import hashlib
import math
import re
import zlib

import pytest

from quillspark.llm import bpe, chunk_store, hmm, lang_id, line_quality, mixing, near_dedup, pii, token_count
from quillspark.llm.registry import PIECES, WORD_BPE, tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return WORD.findall((t or "").translate(LOWER))


def shingles(t):
    w = words(t)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def sha(x):
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def test_near_duplicates(docs, corpus):
    sets = [(r[0], shingles(r[1])) for r in corpus]
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (a, x) in enumerate(sets):
        for j, (b, y) in enumerate(sets[:i]):
            if (a is not None and a == b) or (x and y and 100 * len(x & y) >= 75 * len(x | y)):
                if a is not None and b is not None or x == y:
                    parent[find(i)] = find(j)
    groups = collections.defaultdict(list)
    for i, (a, _) in enumerate(sets):
        groups[find(i)].append(a)
    want = collections.Counter()
    for i, (a, x) in enumerate(sets):
        comp = min((v for v in groups[find(i)] if v is not None), default=None)
        want[(a, len(x), comp, a == comp)] += 1
    got = collections.Counter(tuple(r) for r in near_dedup.near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept").collect())
    assert got == want


def test_sketch_estimates_similarity():
    import numpy as np

    rng = np.random.default_rng(1)
    for j in (0.6, 0.75, 0.9):
        n = 3000
        both = int(n * j)
        x = rng.integers(0, 1 << 63, 2 * n - both, dtype=np.uint64)
        a, b = x[:n], x[n - both :]
        true = both / len(x)
        ra, rb = near_dedup.registers([a]), near_dedup.registers([b])
        assert abs((ra == rb).mean() - true) < 0.15
        merged = np.maximum(ra, rb)
        assert (merged == near_dedup.registers([x])).all()
        assert near_dedup.may_link(ra, rb, np.array([float(n)]), np.array([float(n)]))[0] == (true > 0.6) or true < 0.75


def test_line_quality(docs, corpus):
    got = collections.Counter(tuple(r) for r in line_quality.quality(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect())
    norm = lambda x: " ".join(WORD.findall(x.translate(LOWER)))
    host = collections.defaultdict(set)
    for i, t, _, s, *_ in corpus:
        for x in (t or "").split("\n"):
            if norm(x):
                host[s, norm(x)].add(i)
    often = {k for k, v in host.items() if len(v) > 10}
    total, gone = collections.Counter(), collections.Counter()
    for i, t, _, s, *_ in corpus:
        for x in (t or "").split("\n"):
            n = len(norm(x).split(" ")) if norm(x) else 0
            total[i] += n
            gone[i] += n if (s, norm(x)) in often else 0
    want = collections.Counter()
    for i, t, *_ in corpus:
        t = t or ""
        w = WORD.findall(t)
        at = collections.defaultdict(list)
        for k in range(len(w) - 2):
            at[tuple(w[k : k + 3])].append(k)
        rep = len({k + d for v in at.values() if len(v) > 1 for k in v for d in range(3)})
        ls = [x for x in t.split("\n") if WORD.search(x)]
        failed = len(w) < 50 or 100 * rep > 50 * len(w)
        want[(i, len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(ls) - len(set(ls)), rep, failed, not failed and not gone[i] * 100 > total[i] * 50)] += 1
    assert got == want


def brute_spans(t):
    t = t or ""
    out = []
    for kind, p in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            ok = kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "phone" and 9 <= len(d) <= 15
            if kind == "card" and 13 <= len(d) <= 19:
                ok = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def test_pii(spark, docs, corpus):
    got = collections.Counter((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in pii.digests(pii.spans(docs)).collect())
    want = collections.Counter()
    for i, t, *_ in corpus:
        b = brute_spans(t)
        want[(i, *(sum(x[0] == k for x in b) for k in pii.KINDS), sha(",".join(f"{k}:{s}:{e}" for k, s, e in b)))] += 1
    assert got == want
    rows = {r["doc_id"]: r for r in pii.spans(docs).collect() if r["_text"]}
    found = {r["_text"][x["s"] : x["e"]].lower() for r in rows.values() for x in r["term"]}
    assert found == {"zorblax", "met", "near", "quibblewick", "today"}
    clean = {r["doc_id"]: r["text"] for r in pii.sanitised(docs).collect()}
    assert all("@" not in (t or "") for t in clean.values())
    assert clean[7] == corpus[7][1]
    odd = ["a@b.c_foo@bar.com x@y", "a@b.c.d-e@f.g", "1.2.3.4.5.6.7.8 01.02.03.004 1.2.3.999", "++1 234 567 890 12 34", "é a@b.co 😀 c@d.eu", "1" * 30 + " " + "4111-1111 1111-1111", "+123456789+1234567890"]
    frame = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    for r in pii.digests(pii.spans(frame)).collect():
        assert r["base_sha256"] == sha(",".join(f"{k}:{s}:{e}" for k, s, e in brute_spans(odd[r["doc_id"]]))), odd[r["doc_id"]]


def test_language(spark):
    import random

    rnd = random.Random(3)
    say = {"en": ["the", "house", "with", "water", "thing", "and"], "fr": ["maison", "avec", "été", "eau", "les", "du"], "ru": ["дом", "вода", "это", "с", "и"]}
    rows = [(i, " ".join(rnd.choice(say[x]) for _ in range(40)) + ".", x) for i, x in enumerate(list(say) * 60)]
    mixed = "the house and the water with thing " * 3 + "дом это вода и дом с вода это " * 3
    rows += [(900, None, "en"), (901, "", None), (902, "123 !!", "fr"), (903, mixed, None), (None, "the water", None), (904, "house " * 30000, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in lang_id.cross_fitted(d).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (900, 901, 902))
    assert all(r["held_out"] == (zlib.crc32(str("" if i is None else i).encode()) % 3 == 1) for i, r in got.items())
    assert all(got[i]["lang_pred"] == x for i, _, x in rows[:180]) and got[904]["lang_pred"] == "en" and got[None]["lang_pred"] == "en"
    model = lang_id.fitted(d.where("doc_id < 900"))
    spans = {r["doc_id"]: [(mixed[x["s"] : x["e"]], x["lang"]) for x in r["spans"]] for r in lang_id.identified(d, model).collect()}[903]
    assert [x for _, x in spans] == ["en", "ru"] and spans[0][0].endswith("thing") and spans[1][0].startswith("дом")


def test_viterbi_matches_brute_force():
    import itertools

    import numpy as np

    rng = np.random.default_rng(0)
    for n in (1, 2, 5):
        s = rng.normal(size=(n, 3)) * 10
        cost = lambda path: sum(s[i, x] for i, x in enumerate(path)) - 8 * sum(a != b for a, b in zip(path, path[1:]))  # noqa: B023, E731
        best = max(itertools.product(range(3), repeat=n), key=cost)
        assert lang_id.labelled(s, np.array([n]), 8).tolist() == list(best)


def test_mixing(docs, corpus):
    rows = mixing.mixed(docs).collect()
    assert len(rows) == len(corpus)
    total, taken = sum(r["n_tokens"] for r in rows), sum(r["taken_tokens"] for r in rows)
    budget = total * mixing.BUDGET_PERCENT // 100
    assert budget - 20 <= taken <= budget
    assert all(0 <= r["epochs"] <= mixing.MAX_EPOCHS and r["taken_tokens"] <= r["epochs"] * r["n_tokens"] for r in rows)
    leaves = collections.defaultdict(list)
    for r in rows:
        leaves[r["domain"], r["lang"], r["source"]].append(r)
    for leaf in leaves.values():  # a prefix of one seeded order: at most one document in part, none after it
        n = min(r["taken_tokens"] // r["n_tokens"] for r in leaf if r["n_tokens"]) if any(r["n_tokens"] for r in leaf) else 0
        order = sorted((hashlib.md5(f"7:{n}:{'' if r['doc_id'] is None else r['doc_id']}".encode()).hexdigest(), r["n_tokens"], r["taken_tokens"] - n * r["n_tokens"]) for r in leaf)
        more = [(x, y) for _, x, y in order if x]
        cut = [k for k, (x, y) in enumerate(more) if y < x]
        assert not cut or all(y == 0 for _, y in more[cut[0] + 1 :])


def test_chunks_round_trip(docs, corpus):
    want = collections.Counter()
    for i, t, *_ in corpus:
        b = (t or "").encode()
        p = b.ljust(max(64, -(-len(b) // 64) * 64), b"\0")
        want[(i, len(b), len(p), sha(p), zlib.crc32(p[-64:]))] += 1
    rows = chunk_store.round_trip(docs).collect()
    assert collections.Counter(tuple(r)[:5] for r in rows) == want
    by_text = collections.defaultdict(set)
    for r in rows:
        by_text[r["payload_sha256"]].add((r["media_bytes"], r["media_sha256"], r["feature"]))
    assert all(len(v) == 1 for v in by_text.values())


def plain_media(p):
    """The stored form and the feature of a payload, byte by byte."""
    h, start, parts = 0, 0, []
    for i, b in enumerate(p):
        h = ((h << 1) + int(chunk_store.gear()[b])) & 0xFFFFFFFF
        size = i + 1 - start
        if size == chunk_store.MOST or i + 1 == len(p) or size >= chunk_store.LEAST and h >> (32 - chunk_store.MASK) == 0:
            parts.append(p[start : i + 1])
            start = i + 1
    stored = b"CDC1" + len(parts).to_bytes(4, "little") + b"".join(len(x).to_bytes(4, "little") + hashlib.sha256(x).digest() for x in parts) + p
    n = collections.Counter(p)
    entropy = -sum(v / len(p) * math.log2(v / len(p)) for v in n.values())
    return len(stored), sha(stored), f"chunks={len(parts)};distinct={len(set(parts))};longest={max(map(len, parts))};sum={sum(p)};bytes={len(n)};entropy={abs(entropy):.4f}"


def test_stored_form_and_feature(docs, corpus):
    want = {}
    for _, t, *_ in corpus:
        b = (t or "").encode()
        p = b.ljust(max(64, -(-len(b) // 64) * 64), b"\0")
        want[sha(p)] = plain_media(p)
    for r in chunk_store.round_trip(docs).collect():
        size, digest, feature = want[r["payload_sha256"]]
        assert (r["media_bytes"], r["media_sha256"]) == (size, digest)
        assert r["feature"].rsplit("=", 1)[0] == feature.rsplit("=", 1)[0] and abs(float(r["feature"].rsplit("=", 1)[1])) == pytest.approx(float(feature.rsplit("=", 1)[1]), abs=1.5e-4)


def test_gear_hash_is_the_rolling_one():
    data = bytes(range(256)) * 70
    h, want = 0, []
    for i, b in enumerate(data):
        h = ((h << 1) + int(chunk_store.gear()[b])) & 0xFFFFFFFF
        if h >> (32 - chunk_store.MASK) == 0:
            want.append(i + 1)
    assert chunk_store.marks(data).tolist() == want
    block, chunk_store.BLOCK = chunk_store.BLOCK, 1000
    assert chunk_store.marks(data).tolist() == want
    chunk_store.BLOCK = block
    ends = chunk_store.cuts(data)
    assert ends[-1] == len(data) and all(b - a <= chunk_store.MOST for a, b in zip([0, *ends], ends))


def test_store_holds_each_chunk_once(docs):
    found = chunk_store.index(docs)
    stored, _ = chunk_store.store(docs, found)
    own = collections.Counter()
    for r in stored.select("pid", "manifest", "own").distinct().collect():
        own.update(d for d, mine in zip(chunk_store.listed(bytes(r["manifest"]))[0], r["own"]) if mine)
    every = {bytes(d) for r in found.collect() for d in r["digests"]}
    assert set(own) == every and max(own.values()) == 1


def test_token_counts(docs, corpus):
    from tokenizers import Tokenizer, models, pre_tokenizers

    path = tokenizer_path(PIECES)
    t = Tokenizer(models.Unigram(token_count.vocabulary(path), unk_id=0, byte_fallback=True))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    want = collections.Counter((r[0], len(t.encode(r[1] or "", add_special_tokens=False).ids)) for r in corpus)
    assert collections.Counter(tuple(r) for r in token_count.counted(docs, path).collect()) == want
    c = token_count.counts(path)
    for x in ("▁a ▁▁ b", "日本 語\n\n x", " ", "a  b", "\n", "<s> <unk> <0x41>", "Ω≈ç√∫ ﷺ"):
        assert c.text(x) == len(t.encode(x, add_special_tokens=False).ids), x


def test_language_model(docs, corpus):
    count = collections.Counter()
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 7 == 2
    for r in corpus:
        if not held(r[0]):
            count.update([*words(r[1]), None])
    n, v = sum(count.values()), len(count)
    rows = hmm.language_model(docs).collect()
    want = collections.defaultdict(list)
    for r in corpus:
        w = [*words(r[1]), None]
        want[r[0]].append((held(r[0]), len(w), sum(count[x] > 0 for x in w), sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w)))
    got = collections.defaultdict(list)
    for r in rows:
        assert r["train_tokens"] == n and r["score"] < 0
        got[r["doc_id"]].append((r["held_out"], r["n_tokens"], r["n_known"], r["base_score"]))
    assert set(got) == set(want)
    for k in want:
        for a, b in zip(sorted(got[k]), sorted(want[k]), strict=True):
            assert a[:3] == b[:3] and a[3] == pytest.approx(b[3])


def chain():
    import numpy as np

    rng = np.random.default_rng(4)
    norm = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    return hmm.Chain(norm(rng.random(hmm.STATES), 0), norm(rng.random((hmm.STATES, hmm.STATES)), 1), norm(rng.random((6, hmm.STATES)), 0), np.full(hmm.STATES, 1 / hmm.STATES))


def test_forward_and_expectations_match_enumeration():
    import itertools

    import numpy as np

    m = chain()
    texts = [[0, 3, 5, 1], [2], [4, 4, 0]]
    weight = {}
    for k, o in enumerate(texts):
        weight[k] = {p: m.start[p[0]] * m.emit[o[0], p[0]] * np.prod([m.move[a, b] * m.emit[x, b] for a, b, x in zip(p, p[1:], o[1:])]) for p in itertools.product(range(hmm.STATES), repeat=len(o))}
    sym, sizes = np.concatenate(texts), np.array([4, 1, 3])
    assert np.allclose(hmm.forward(sym, sizes, m), [np.log10(sum(weight[k].values())) for k in range(3)])
    first = np.array([1, 0, 0, 0, 1, 1, 0, 0], dtype=bool)
    emitted, moves, start, share, logs = hmm.expected(sym, first, m)
    assert np.isclose(logs, sum(np.log10(sum(weight[k].values())) for k in range(3)))
    e, a, s = np.zeros((6, hmm.STATES)), np.zeros((hmm.STATES, hmm.STATES)), np.zeros(hmm.STATES)
    for k, o in enumerate(texts):
        z = sum(weight[k].values())
        for p, w in weight[k].items():
            s[p[0]] += w / z
            for x, y in zip(o, p):
                e[x, y] += w / z
            for x, y in zip(p, p[1:]):
                a[x, y] += w / z
    assert np.allclose(emitted, e) and np.allclose(moves, a) and np.allclose(start, s) and np.allclose(share, e.sum(0))


def test_training_raises_the_likelihood(docs):
    train = docs.select("doc_id", "text")
    counts = hmm.token_counts(train)
    v = hmm.vocabulary(counts)
    scores = [hmm.scored(train, counts, v, hmm.trained(train, v, k)).groupBy().sum("score").first()[0] for k in (0, 1, 3)]
    assert scores[0] < scores[1] < scores[2]


def test_bpe(docs, corpus):
    from tokenizers import Tokenizer

    path = tokenizer_path(WORD_BPE)
    t = Tokenizer.from_file(path)
    want = collections.Counter()
    for r in corpus:
        ids = t.encode(r[1] or "", add_special_tokens=False).ids
        want[(r[0], len(ids), sha(" ".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False)))] += 1
    assert collections.Counter(tuple(r) for r in bpe.digests(bpe.encoded(docs, path)).collect()) == want
    odd = ["Σίσυφος ΟΔΟΣ.", "<|endoftext|>hi a<|startoftext|>b", "it's we'll 123 ４５", "é ́x İ ǅ ß", "a\x85b\xa0c d\x1ce", "😀👍🏽 日本語", "</w> <w>", "ﬁ ＡＢＣ ﻿", "x" * 300]
    own = bpe.Codec(path)
    for x in odd:
        ids = t.encode(x, add_special_tokens=False).ids
        got, text = own.encode([x])
        assert got[0].decode() == " ".join(map(str, ids)) and text[0].decode() == t.decode(ids, skip_special_tokens=False), x


def test_bpe_with_a_full_cache(monkeypatch, corpus):
    own, small = bpe.Codec(tokenizer_path(WORD_BPE)), bpe.Codec(tokenizer_path(WORD_BPE))
    texts = [r[1] or "" for r in corpus]
    want = own.encode(texts)
    monkeypatch.setattr(bpe, "CACHE", 40)
    parts = [small.encode(texts[i : i + 5]) for i in range(0, len(texts), 5)]
    assert [x for p in parts for x in p[0]] == want[0] and [x for p in parts for x in p[1]] == want[1]


def test_empty_tables(nothing):
    path, pieces = tokenizer_path(WORD_BPE), tokenizer_path(PIECES)
    for f in (near_dedup.near_duplicates, line_quality.quality, pii.spans, pii.sanitised, lang_id.cross_fitted, mixing.mixed, chunk_store.round_trip, hmm.language_model):
        assert f(nothing).collect() == []
    assert bpe.encoded(nothing, path).collect() == [] and token_count.counted(nothing, pieces).collect() == []
