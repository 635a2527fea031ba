import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = "the of and to in that it was for on are with as his they at be this from have or by one had not but what all were".split()


def prose(draw: random.Random, n: int) -> str:
    return " ".join(draw.choice(WORDS) + draw.choice(["", "", "er", "ing", "tion", str(draw.randint(0, 9))]) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Texts with copies, near copies, shared lines, odd characters, one long text, nulls and empty ones."""
    draw = random.Random(11)
    rows = [prose(draw, draw.randint(1, 120)) for _ in range(60)]
    rows += [rows[0]] * 15 + [rows[1].replace("the", "a", 1), rows[2] + " end"]
    rows += ["All rights reserved\n" + prose(draw, 30) + "\n  ALL RIGHTS reserved \t\n\n" + prose(draw, 5) for _ in range(12)]
    rows += ["\n".join(prose(draw, 8) for _ in range(40)), prose(draw, 6_000)]
    rows += ["", None, " \n\t ", "É\u00a0ÀB \u2003 ς \U0001f600 x\u0301 ＡＢ", "a", "A B\x0bC\x1cD", "<|endoftext|> it's 12"]
    return [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(rows)]


@pytest.fixture
def documents(spark, corpus):
    """The corpus with repeated rows, two rows without id, and columns named like inner ones."""
    from pyspark.sql import functions as F

    rows = corpus + [corpus[3], corpus[3], (None, corpus[5][1], "en", "x", 0), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    return df.withColumns({c: F.lit("other") for c in ("_row", "shard", "size", "score", "spans", "_key", "n_words", "_rid", "_nth")})


@pytest.fixture
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
