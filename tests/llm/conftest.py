import random

import pytest

WORDS = [a + b for a in ("ba", "de", "fi", "go", "lu", "mi", "no", "pa", "re", "su") for b in ("", "n", "r", "st", "ta", "lo")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, v string, component string, id string"


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + str(rng.randrange(400)) for _ in range(n))


@pytest.fixture(scope="session")
def corpus() -> list[tuple]:
    """Documents with copies, near copies, a shared passage, nulls, empty, short and long texts, ties and repeated rows."""
    rng = random.Random(7)
    texts: list[str | None] = [None, "", " \t\n", "one", "One two", "x", "x"]
    base = sentence(rng, 120)
    texts += [base] * 3
    for _ in range(12):  # a group of near copies, some beyond the threshold from each other
        w = base.split()
        for _ in range(rng.randrange(1, 6)):
            w[rng.randrange(len(w))] = "edit" + str(rng.randrange(10**6))
        texts.append(" ".join(w))
    passage = sentence(rng, 70)
    for _ in range(10):
        texts.append(sentence(rng, rng.randrange(5, 90)) + "\n" + passage + "\n" + sentence(rng, rng.randrange(3, 60)))
    line = "The quick Brown fox number 12 jumps over 3 lazy dogs near the old river bank"
    for i in range(6):
        texts.append(sentence(rng, 30) + "\n" + line.replace("12", str(i)) + "!\n" + sentence(rng, 12))
    texts.append(sentence(rng, 5000))
    texts += [" ".join(["loop"] * 130), " ".join(["loop"] * 90) + " " + sentence(rng, 20), " ".join(["tick tock tack"] * 40)]  # windows that repeat inside
    for _ in range(20):
        texts.append("\n".join(sentence(rng, rng.randrange(4, 40)) for _ in range(rng.randrange(1, 4))))
    rows = [(i, t, "en", ["a", "b", None, "c"][i % 4], len(t or ""), i, "v", "c", "id") for i, t in enumerate(texts)]
    rows += [rows[8], rows[40]]  # repeated rows
    rows.append((None, base, "en", "a", 1, 1, "v", "c", "id"))
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
