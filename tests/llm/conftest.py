import random

import pytest

WORDS = [a + b for a in ("ba", "ko", "lu", "mi", "ne", "ro", "su", "ta") for b in ("", "n", "rel", "sti", "vo", "x1")]


def prose(rnd, n, end=". "):
    return " ".join(" ".join(rnd.choice(WORDS) for _ in range(9)) + end.strip() for _ in range(n))


def corpus():
    """Texts with copies, near copies, shared passages, odd and empty texts, repeated ids, a missing id."""
    rnd = random.Random(11)
    base = [prose(rnd, rnd.randint(2, 14)) for _ in range(40)]
    shared = prose(rnd, 9)
    out = [(k, t) for k, t in enumerate(base)]
    out += [(100, base[3]), (101, base[3]), (102, base[4].replace("ba", "be", 2)), (103, base[5] + " extra words at the end."), (104, base[5].upper())]
    out += [(110, prose(rnd, 3) + " " + shared + " " + prose(rnd, 3)), (111, shared + " " + prose(rnd, 4)), (112, prose(rnd, 5) + shared)]
    out += [(120, None), (121, ""), (122, ""), (123, " \n\t "), (124, "one"), (125, "one two"), (126, "one"), (127, "é中🙂 ÀÉ\x00\x85 nbsp x"), (128, "a" * 900), (129, "ab " * 400), (130, "%" * 3000)]
    out += [(131, prose(rnd, 900)), (100, base[3]), (7, base[8]), (None, base[9]), (None, None), (132, "# menu | home | about\n" + base[11]), (133, "x\n\ny\n"), (134, "\n")]
    return out


@pytest.fixture(scope="session")
def texts():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, texts):
    """With columns whose names the operators use themselves."""
    rows = [(i, t, "en", "s", None if t is None else len(t), 1, 2, 3) for i, t in texts]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id int, mark int, band int").repartition(5)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
