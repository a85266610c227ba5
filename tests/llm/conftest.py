import random

import pytest

#: Columns of documents, and some with names that the operators use themselves.
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, fp long, score double, row long, range long, shard int, ids binary, root long, key string"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeéü") for _ in range(rng.randrange(1, 9))) for _ in range(n))


def odd_texts():
    """Texts with every awkward case: null, empty, white space, one word, repeats, near copies, special strings, other scripts, long ones."""
    rng = random.Random(1)
    base = words(rng, 300)
    near = base.replace(base.split()[150], "changed", 1)
    return [None, "", " ", "\n\n  \t", "word", "Word", "two words", base, base, near, base.upper(), "a  b\n\n c ", "x<|endoftext|>y <s> </s>", "日本語 のテキスト です", "emoji 🙂 text ﬁ ①", "it's we'll\tdon't é\xa0b",
            "\x01 odd \x01\x01", "▁under ▁▁x", "same " * 500, words(rng, 6000), "nospace" * 2000, *(words(rng, rng.randrange(1, 900)) for _ in range(12))]


@pytest.fixture(scope="session")
def odd_docs(spark):
    texts = odd_texts()
    ids = [None if i == 3 else 7 if i in (7, 8) else i for i in range(len(texts))]
    rows = [(k, t, "en", f"s{i % 3}", None, 1, 0.5, i, i, 3, b"x", 2, "k") for i, (k, t) in enumerate(zip(ids, texts))]
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], COLUMNS)
