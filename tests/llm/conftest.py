import random

import pytest

from feedpulse.llm.queries import read

CLASHING = ["id", "key", "sig", "size", "part", "group", "doc", "twin", "place", "label", "score", "row", "host", "prior"]


@pytest.fixture(scope="session")
def frame(spark):
    """A table of documents with further columns whose names operators use inside."""
    def make(rows, id_col="doc_id", **more):
        rows = [(i, t, more.get("lang", "en"), more.get("source", f"s{n % 3}"), len(t or "")) for n, (i, t) in enumerate(rows)]
        df = spark.createDataFrame(rows, f"{id_col} long, text string, lang string, source string, n_chars long")
        for c in CLASHING:
            if c not in df.columns:
                df = df.selectExpr("*", f"'x' AS `{c}`")
        return df
    return make


@pytest.fixture(scope="session")
def table(spark):
    return lambda name, sf="sf0.001": read(spark, f"/root/testdata/{sf}", name)


def words(seed, n, vocabulary=40):
    r = random.Random(str(seed))
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


#: Nulls, empty and blank texts, repeated ids and rows, one very long text.
ODD_ROWS = [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (4, "one"), (5, "two words"), (None, "one"), (6, "ünï çødé  text\u00a0x"),
            (7, " ".join(words(1, 30000, 5000))), (8, "a " * 500), (9, "<b>&amp;</b> \x0b x"), (4, "another text of id four")]
