import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, grams string, n long, row long"


def made_texts(seed: int = 7) -> list[tuple[int, str | None]]:
    """Documents with copies, near copies, shared passages, empty, blank, null, short and long texts."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["an", "do", "ré", "Ka", "lo", "st"]) for _ in range(r.randint(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, base = text(70), text(120).split()
    out: list[str | None] = [None, "", " \t\n ", "one", "one two three", text(3000)]
    out += [text(r.randint(5, 150)) for _ in range(25)]
    out += [" ".join(base[:k] + ["edit"] + base[k + 1 :]) for k in (5, 40, 80, 100)] + [" ".join(base), "\n".join(base)]
    out += [text(20) + "\n" + passage + " " + text(15) for _ in range(5)]
    out += [text(30) + " " + " ".join(passage.split()[:49]), " ".join(passage.split()[10:65]), "la " * 200, "la " * 130]
    out += [out[10], out[11], out[11]]
    ids = r.sample(range(500), len(out))
    return list(zip(ids, out, strict=True))


@pytest.fixture(scope="session")
def rows():
    return made_texts()


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, "src0", None, "g", 1, 2) for i, t in rows], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, rows):
    return frame(spark, rows).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return frame(spark, []).limit(0)
