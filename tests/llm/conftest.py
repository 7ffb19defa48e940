import random

import pytest

WORDS = "alpha beta gamma delta river stone cloud paper window garden letter market simple quiet green summer winter bridge".split()


@pytest.fixture(scope="session")
def texts():
    """Nulls, empties, ties, repeats, a very long text, near copies and shared passages."""
    rng = random.Random(5)
    say = lambda n: " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))
    passage = say(40)
    base = say(300)
    rows = [None, "", "   ", "one", "one", "Un été à l'école", "%%% 123", base, base, base.replace("alpha", "omega", 1), say(20) + " " + passage + " " + say(15), passage + " " + say(30)]
    rows += [say(rng.randrange(1, 200)) for _ in range(25)]
    rows += ["line of text that repeats itself\n" * 30, say(9000)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    """``part``, ``h`` and ``id`` clash with names used inside the operators."""
    return spark.createDataFrame([(i * 3, t, "x", i, None) for i, t in enumerate(texts)], "doc_id bigint, text string, part string, h int, id string")
