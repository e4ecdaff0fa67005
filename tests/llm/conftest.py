import random

import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def messy(spark):
    """Documents with nulls everywhere, empty and long texts, repeated rows, shared passages, and clashing extra columns."""
    rnd = random.Random(7)
    vocab = ["wort%d" % i for i in range(300)] + ["né", "Ünd", "###", "a|b"]

    def some(n):
        return " ".join(rnd.choice(vocab) for _ in range(n))

    shared = some(70)
    rows = [(0, some(120)), (1, None), (2, ""), (3, " \n\t "), (None, some(60)), (None, None), (4, "x"), (5, "Und " * 300)]
    rows += [(i, some(40) + "  " + shared + "\n" + some(30)) for i in range(6, 14)]
    rows += [(14, shared), (15, "Und " * 200 + "x"), (16, "ab" * 400), (17, "ab" * 300), (3, "  " + shared), (3, some(80))]
    base = some(200)
    rows += [(20, base), (21, base), (22, base.upper()), (23, base.replace("wort1 ", "wort2 ", 1)), (24, base + " x")]
    rows += [(25, base), (25, base), (19, base[:600]), (26, "one two three"), (27, "One  two three"), (28, some(30000))]
    rows += [(29, "\n".join([some(5)] * 6) + "\n\nx")]
    full = [(d, t, None if (d or 0) % 3 == 0 else "en", [None, "a", "b", "c"][(d or 0) % 4], len(t) if t else None) for d, t in rows]
    return spark.createDataFrame(full, DOC).selectExpr("*", "1 AS id", "'x' AS key", "2 AS __text", "3 AS n_words", "'q' AS part")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC)
