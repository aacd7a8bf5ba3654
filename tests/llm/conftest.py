import random

import pytest

EDGES = [(900, None, "en", "s1", None), (901, "", "en", None, 0), (902, " \n\t ", None, "s2", 4), (None, "some words without an id here", "en", "s1", 29), (903, "word", "en", "s1", 4)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng: random.Random, n: int) -> str:
    syllables = "ba ne ti ro lu ka mi so de fu".split()
    words = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    return " ".join(w + (".\n" if k % 13 == 12 else "") for k, w in enumerate(words))


@pytest.fixture(scope="session")
def rows():
    rng = random.Random(3)
    out = [(k, prose(rng, rng.choice([8, 30, 60, 150])), rng.choice(["en", "fr"]), rng.choice(["s1", "s1", "s2", "s3"]), 0) for k in range(60)]
    texts = [r[1] for r in out]
    out += [(100 + k, texts[k], "en", "s1", 0) for k in range(6)]  # exact copies
    for k in range(12):  # near copies: a word changed, of one text many times
        words = texts[7 if k > 3 else k].split(" ")
        words[rng.randrange(len(words))] = f"changed{k}"
        out.append((200 + k, " ".join(words), "en", "s2", 0))
    shared = prose(rng, 60)
    out += [(300 + k, prose(rng, 40) + "\n" + shared + "\n" + prose(rng, 40), "en", "s3", 0) for k in range(25)]  # a passage that many share
    line = prose(rng, 60).replace("\n", "")
    out += [(400 + k, f"{prose(rng, 20)}\n{line} ending{k}", "en", "s1", 0) for k in range(8)]  # lines that differ in a word
    return [(i, t, a, b, len(t)) for i, t, a, b, _ in out] + EDGES


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
