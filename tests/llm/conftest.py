from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, key string"


@pytest.fixture(scope="session")
def corpus():
    """Rows with copies, near copies, nulls, empty and long texts, ties, personal data, and columns whose names could clash."""
    rnd = random.Random(5)
    vocab = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 7))) for _ in range(300)]
    base = [" ".join(rnd.choice(vocab) for _ in range(rnd.randint(60, 120))) for _ in range(12)]
    texts: list[str | None] = [None, "", "   \n\t", "one", "Two words", "a b c d e", "A B C D E"]
    texts += base
    for b in base[:6]:  # near copies: one word in fifty changed
        w = b.split()
        for _ in range(4):
            v = list(w)
            for i in rnd.sample(range(len(v)), max(1, len(v) // 50)):
                v[i] = rnd.choice(vocab)
            texts.append(" ".join(v))
    texts += [base[0]] * 6 + [base[1].upper()]
    texts += ["license line here for all\n" + " ".join(rnd.choice(vocab) for _ in range(70)) for _ in range(14)]
    texts += [" ".join(rnd.choice(vocab) for _ in range(9000)), "x" * 40000, "same words again " * 40]
    texts += [f"Zorblax met {x} near Quibblewick today" for x in ("a.b@c.example.org", "a.b@c.example.org", "a.b@c.example.org", "a.b@c.example.org")]
    texts += ["call +1 (234) 555-0199 or 10.0.0.255 and 300.1.1.1, card 4111 1111 1111 1111 not 4111111111111112", "é😀 mail: x@y.z.org; ünï +33 6 12 34 56 78 90"]
    rows = [(i, t, ["en", "fr", None][i % 3], ["src0", "src1", None][i % 4 // 2 if i % 5 else 2], len(t or ""), "d", "k") for i, t in enumerate(texts)]
    rows += [(3, "one", "en", "src0", 3, "d", "k"), (None, "no id here", "en", "src0", 10, "d", "k"), (None, base[0], None, None, 9, "d", "k")]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("data") / "documents.parquet")
    spark.createDataFrame(corpus, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
