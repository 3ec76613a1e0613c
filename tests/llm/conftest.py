from __future__ import annotations

import os
import random

import pytest

DATA = "/root/testdata/sf0.001"
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def data():
    if not os.path.isdir(DATA):
        pytest.skip("the driver's tables are not here")
    return DATA


@pytest.fixture(scope="session")
def prose():
    """prose(seed, n): n words of invented text."""

    def make(seed, n, vocabulary=4000):
        r = random.Random(seed)
        return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))

    return make


@pytest.fixture(scope="session")
def docs_of(spark):
    def make(rows):
        """rows: texts, or (doc_id, text), or whole rows."""
        full = []
        for k, r in enumerate(rows):
            r = r if isinstance(r, tuple) else (k, r)
            full.append(r if len(r) == 5 else (*r, "en", "s", None if r[1] is None else len(r[1])))
        return spark.createDataFrame(full, DOCUMENTS)

    return make


@pytest.fixture(scope="session")
def odd(spark, prose):
    """Nulls in every column, empty and very long texts, repeated rows, and extra columns named as operators name theirs."""
    rows = [
        (1, prose(1, 80), "en", "a", 1),
        (1, prose(1, 80), "en", "a", 1),
        (2, None, None, None, None),
        (None, prose(1, 80), "fr", "b", 2),
        (None, None, None, None, None),
        (3, "", "en", "a", 0),
        (4, " \n\t\n ", "en", "a", 5),
        (5, prose(5, 300_000), "en", None, 9),
        (6, "\n".join([prose(6, 12)] * 50), "de", "c", 9),
        (7, "é" * 5000 + "\n" + "𝄞" * 3000, "de", "c", 8000),
        (8, "!?.," * 30, None, "c", 120),
        (-9, prose(1, 80), "", "", -1),
    ]
    names = "h line node shard part drops keeper suffix places tokens topic id y fp whole words key path score toxic text_b".split()
    df = spark.createDataFrame([(*r, *range(len(names))) for r in rows], DOCUMENTS + ", " + ", ".join(f"`{n}` int" for n in names))
    return df.select(*names[:10], *DOCUMENTS.replace(",", "").split()[::2], *names[10:])


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCUMENTS)
