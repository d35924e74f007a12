import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))


@pytest.fixture(scope="session")
def corpus():
    """Texts with nulls, empty and odd ones, exact and near copies, repeats and a very long one."""
    import random

    rnd = random.Random(5)
    words = ["".join(rnd.choices("aeinrstdöé", k=rnd.randint(2, 7))) for _ in range(300)]

    def prose(n):
        return " ".join(rnd.choices(words, k=n)) + "."

    base, passage = prose(120), prose(90)
    near = base.split(" ")
    near[60] = "changed"
    texts = [
        None, "", " ", "\n\t \n", "one", "Two words", "a b c d e", base, base, " ".join(near), prose(80) + "\n" + passage,
        passage + "\n" + prose(70), prose(3000), "x" * 3000, "ab " * 700, "<|endoftext|> inside <|startoftext|>",
        "It's  we'll don't\x1c x y", "日本語のテキスト 😀😀", "same line\nsame line\nsame line\n" * 10,
        "LOUD! " * 40, "Licensed under the Apache License, Version 2.0.", "# $ % & | < > *" * 20,
    ]
    return [(i, t, "en", f"src{i % 3}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def documents(spark, corpus):
    schema = "doc_id long, text string, lang string, source string, n_chars int"
    return spark.createDataFrame(corpus, schema).repartition(3)
