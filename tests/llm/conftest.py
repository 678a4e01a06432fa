import random

import pytest

WORDS = [a + b for a in ("ka", "lo", "mi", "ne", "po", "ru", "sa", "ti", "vu", "Ze") for b in ("ra", "ne", "lo", "st", "ve", "é", "ßa", "n,", "d.", "k")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + ("\n" if rng.random() < 0.08 else "") for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text, lang, source, n_chars): copies, near copies, nulls, blanks, repeats of rows and ids, long texts."""
    rng = random.Random(5)
    texts = [prose(rng, rng.randint(3, 160)) for _ in range(120)]
    for k in range(12):
        words = texts[k].split(" ")
        for j in range(3):
            other = list(words)
            for _ in range(j):
                other[rng.randrange(len(other))] = rng.choice(WORDS)
            texts.append(" ".join(other))
    texts += [None, "", "   \n \t ", "one", "two words", "a b c d e", "A B C D E", prose(rng, 6000), "\n".join(["the same line that repeats often enough"] * 40), "x" * 9000, "emoji 😀 𝟘   end", "tail\n", "\n\nlead"]
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["s1", "s1", "s1", "s2", "s3", None, "é"]), None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (5, "another text under a known id", "en", "s2", 28), (None, texts[1], "en", "s1", 5), (None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus with extra columns whose names clash with the operators' own."""
    extra = ("item", "part", "mark", "class", "size", "slot", "shard", "taken", "weight", "a", "b", "component", "text_", "words", "copy", "key")
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in extra)
    return spark.createDataFrame([(*r, *[f"x{i}" for i, _ in enumerate(extra)]) for r in corpus], schema).repartition(3)


@pytest.fixture(scope="session")
def plain_docs(spark, corpus):
    return spark.createDataFrame(corpus, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
