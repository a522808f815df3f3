import random

import pytest

WORDS = "the and of to in that erst onle thion ander moron lyble ouning heren stand".split()


def prose(rng: random.Random, n: int) -> str:
    out = []
    while len(out) < n:
        k = rng.randint(6, 12)
        line = [rng.choice(WORDS) + rng.choice(["", "a", "en", "ing", "st", "o"]) for _ in range(k)]
        out += [line[0].capitalize(), *line[1:-1], line[-1] + "."]
    return " ".join(out[:n])


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, shard string, kept string"


@pytest.fixture(scope="session")
def texts() -> list[tuple[int, str | None]]:
    rng = random.Random(5)
    base = [prose(rng, rng.randint(25, 90)) for _ in range(60)]
    rows: list[tuple[int, str | None]] = list(enumerate(base))
    for k in range(40):  # near copies, some with too many changes
        words = base[k % 6].split()
        for _ in range(rng.randint(1, 4)):
            words[rng.randrange(len(words))] = "edit" + str(rng.randint(0, 99))
        rows.append((100 + k, " ".join(words)))
    rows += [(200 + k, base[7]) for k in range(12)]
    rows += [(300, None), (301, ""), (302, " \n\t "), (303, "one two"), (304, "One TWO"), (305, "é ß 𝄞 x\x00y  z \n\n end"), (306, "!!! ??? ..."), (307, " ".join(prose(rng, 50) for _ in range(300)))]
    rows += [(7, base[7]), (8, base[8])]  # repeated rows
    rows.append((None, base[9]))
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, "en", None if (i or 0) % 7 == 0 else f"s{(i or 0) % 3}", len(t or ""), "clash", "clash", "clash") for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
