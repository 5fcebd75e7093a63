import os
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, node long, key string, n_words long, kept boolean, batch string"


def make_texts():
    """Near and exact copies, shared passages, repeated lines, odd white space, long and short texts."""
    rng = np.random.default_rng(5)
    vocabulary = [f"w{k}" for k in range(400)] + ["été", "naïve", "日本", "Straße"]
    text = lambda n: " ".join(rng.choice(vocabulary, n))
    base = [text(60 + 10 * k) for k in range(6)]
    passage = text(90)
    out = []
    for b in base:
        out += [b, b.upper() if b.isascii() else b, b]
        w = b.split(" ")
        for n in (1, 2, 4, 12):
            v = list(w)
            for k in rng.choice(len(v), n, replace=False):
                v[k] = "edit" + str(k)
            out.append(" ".join(v))
    for k in range(6):
        out.append(f"{text(40)}\n{passage}\n{text(30 + k)}")
    line = "This very line is printed on every page of the archive, number 7."
    out += [f"{line}\n{text(20)}\n{line.upper()}\nEnd.", f"{text(25)}\r\n{line}\t\n\n{line[:-2]}8.", line]
    out += ["x", "a b c d", "a  b\tc\nd", "one two three four five", " \n\t ", text(3000), "solid" * 3000, "### $$$ %%% " * 30, "same same same " * 40]
    return out


@pytest.fixture(scope="session")
def texts():
    return make_texts()


@pytest.fixture
def docs(spark, texts):
    rows = [(i, t, ["en", "fr"][i % 2], f"s{i % 3}", len(t), 0, "k", 1, False, "b") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


#: Nulls in any column, empty text, repeated rows and ids.
ODD = [
    (None, "a text without an id of some length for all", "en", "s", 1), (1, None, "en", "s", None), (2, "", None, "s", 0), (3, "short text", "en", None, 3),
    (4, "the same row stands here twice or more", "en", "s", 9), (4, "the same row stands here twice or more", "en", "s", 9), (4, "but the id has another text too", None, None, None), (None, None, None, None, None),
]


@pytest.fixture
def odd(spark):
    return spark.createDataFrame([(*r, 0, "k", 1, False, "b") for r in ODD], COLUMNS)


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], COLUMNS)
