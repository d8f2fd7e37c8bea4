import random
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from objectlake.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, sf, name):
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    rel = con.sql(queries.ORACLES[name])
    df = queries.QUERIES[name](spark, sf)
    assert sorted(rel.columns) == sorted(df.columns)
    assert Counter(map(tuple, df.select(*rel.columns).collect())) == Counter(rel.fetchall())


def test_secrets_sql_on_many_parts(spark, lake):
    """The given tables hold few weak parts; these texts hold all kinds, next to letters beyond ASCII, too."""
    bits = ["password = hunter2hunter2x", "token:abc", "login: bob", "AKIA" + "Q" * 16, "AKIAQ", "0123456789abcdef0123", "client_id=my-app-17", "https://h.example/x?y", "Zz9+" * 10, "Zz9+" * 9 + "Zz9=", "z" * 250, "é日本", "\n", "API_KEY=\"short\"", "SECRET : A1b2C3d4E5f6"]
    draw = random.Random(5)
    texts = ["".join(draw.choice(bits) + draw.choice([" ", ", ", "", "\n"]) for _ in range(draw.randrange(14))) for _ in range(1500)]
    folder = lake(documents=spark.createDataFrame(list(enumerate([*texts, None, ""])), "doc_id long, text string"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    rel = con.sql(queries.SECRETS_SQL)
    rows = rel.fetchall()
    assert {k for r in rows for k in ("client", "endpoint", "opaque", "short") if k in r[-1]} == {"client", "endpoint", "opaque", "short"}
    assert Counter(map(tuple, queries.secrets_query(spark, folder).select(*rel.columns).collect())) == Counter(rows)
