import pytest

PROSE = "The first line of the text stands here and says nothing much about anything at all, but it goes on. "
#: Names that the operators use themselves.
CLASHES = ["row", "gone", "_gone", "_id", "_lines", "_words", "_full", "_kept", "k1", "k2", "key", "shard", "slot", "class", "component", "n_words", "id", "pos", "_row"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, equal texts, and columns whose names the operators use."""
    rows = [
        (1, PROSE * 5 + "Licensed under the Apache License, Version 2.0."), (2, PROSE * 5 + "Licensed under the Apache License, Version 2.0."), (3, None), (4, ""), (5, " \n\t\n "), (None, "a null id with a few words"),
        (6, "one"), (6, "one"), (7, "MIT license mit LICENSE\nÄpfel ıK"), (8, "word " * 3000), (12, " ".join(f"long{k % 9000} {k}" for k in range(60_000))), (9, "\n".join(f"line {i} of a longer text, with words." for i in range(300))), (10, "a b c a b c a b c"), (11, PROSE * 5 + "x"),
    ]
    return spark.createDataFrame([(i, t, None, "s", None if t is None else len(t), *["clash"] * len(CLASHES)) for i, t in rows], SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
