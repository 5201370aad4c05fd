import random

import pytest

LONG = " ".join(f"w{i % 997}x{i // 997}" for i in range(30_000))
LICENSE = "This work is licensed under the GNU General Public License, version 3. "


def texts():
    """Texts with nulls, empties, white space, one word, ties, near copies, repeated passages and a very long one."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 6)))
    base = [word() for _ in range(120)]
    out = [None, "", " \t\n\r\x0b\x0c ", "one", "one", "four words are here", "a " * 60, LONG, LICENSE + "MIT License apache license cc-by", "É ñ   x y 日本語 " * 9]
    for k in range(14):
        near = list(base)
        for _ in range(k % 5):
            near[r.randrange(120)] = word()
        out.append(" ".join(near))
    for _ in range(8):
        out.append(" ".join([word() for _ in range(30)] + base[40:75] + [word() for _ in range(30)]))
    return out + [out[-1], out[12]]


@pytest.fixture(scope="session")
def docs(spark):
    """documents with extra columns whose names clash with those that the operators use."""
    rows = [(i, t, "en", [None, "a", "b", ""][i % 4] if i % 3 else "hot", len(t or ""), 1.5, "x", 7, "k", [1], i) for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, label string, component_id long, key string, draws array<int>, bucket long").repartition(3).cache()


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0).cache()


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, i % 2 if i % 5 else None, int(i % 7 == 0) if i % 4 else None) for i in range(40)] + [(3, 1, 0), (None, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
