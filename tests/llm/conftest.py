import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

WORDS = "the of and to in is on that for it was with as be by at from hand river stone green table light window market".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """(doc_id, text): ordinary texts, exact and near copies, and all odd cases."""
    rng = random.Random(1)
    out = [(i, prose(rng, rng.choice([1, 2, 5, 30, 120, 400]))) for i in range(120)]
    base = prose(rng, 300).split()
    for i in range(120, 150):  # near copies, around the limit
        own = list(base)
        for k in rng.sample(range(300), rng.randrange(0, 14)):
            own[k] = f"new{i}x{k}"
        out.append((i, " ".join(own)))
    out += [(150 + k, out[3][1]) for k in range(20)]  # exact copies
    out += [(200, None), (201, ""), (202, " \n\t "), (203, "one"), (204, "One two"), (205, "one TWO"), (206, "É é ñ 漢字 🙂"), (None, "a row without an id"), (207, out[4][1]), (207, out[4][1]), (207, "another text of the same id")]
    out.append((208, prose(rng, 60_000)))  # a very long text
    out.append((209, "x" * 300_000))  # one very long word
    out.append((210, prose(rng, 90) + " one, two " + prose(rng, 90)))
    return out


def table(spark, rows, schema="doc_id long, text string"):
    """With columns whose names operators use inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, schema)
    own = {"lang": "en", "source": "s", "size": 1, "node": 2, "kind": 3, "label": "x", "line": 4, "component": 5, "block": 6, "slot": 7, "family": "y", "weight": 8, "row": 9}
    return df.withColumns({k: F.lit(v) for k, v in own.items() if k not in df.columns})


@pytest.fixture(scope="session")
def docs(spark, rows):
    return table(spark, rows).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return table(spark, [])
