import random

import pytest

DOC = "doc_id long, text string, lang string, n_chars long, node long, bucket string, _cut int, shard string, slot int, kept int"


def words(rng, n, size=4000):
    return " ".join(f"w{rng.randrange(size)}{rng.choice(['', '', '', ',', '.'])}" for _ in range(n))


def paragraph(rng, n):
    return words(rng, n) + "."


@pytest.fixture(scope="session")
def texts():
    """Made texts by id: copies, near copies, shared passages, odd ones."""
    rng = random.Random(7)
    base = paragraph(rng, 200)
    near = base.split(" ")
    near[100] = "changed"
    passage = paragraph(rng, 60)
    out = {
        1: base, 2: base, 3: " ".join(near), 4: base.upper(), 5: None, 6: "", 7: " \n\t ", 8: "One two three.",
        9: "one TWO three.", 10: paragraph(rng, 80) + " " + passage + " " + paragraph(rng, 80),
        11: paragraph(rng, 120) + "\n" + paragraph(rng, 30) + " " + passage + " " + paragraph(rng, 40),
        12: "Ünïcode 🙂 wörds\u00a0ärger <|im_end|> {x} \\ \"q\" MIT License here.", 13: paragraph(rng, 60_000),
        14: "same word " * 300, 15: paragraph(rng, 90), 16: "a" * 50_000, 17: "<\\|x|> <|im_start|>\r\n \x0b",
    }
    return out | {100 + i: paragraph(rng, rng.randrange(1, 400)) for i in range(60)}


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts as a table whose further columns have names that operators use, with a repeated row and a null id."""
    rows = [(i, t, "en", len(t or ""), i, "b", 0, "s", 1, 0) for i, t in texts.items()]
    rows += [rows[0], (None, "no id " * 60, "en", 1, 1, "b", 0, "s", 1, 0)]
    return spark.createDataFrame(rows, DOC).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOC)
