"""Figures are rounded as the SQL twins round them."""

import duckdb

from spanframe.functions.rounding import round_double
from spanframe.plans import catalog


def test_rounds_like_sql(spark):
    values = [float("nan"), float("inf"), None, -41 / 5120, 0.0, -0.5e-9] + [(2 * i + 1) / 2e9 for i in range(0, 40000, 7)] + [k / 5120 for k in range(5120)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", round_double("v", 9).alias("v"))
    con = duckdb.connect()
    con.execute("create table t (i int, v double)")
    con.executemany("insert into t values (?, ?)", list(enumerate(values)))
    want = con.execute("select i, round(v, 9) from t order by i").fetchall()
    got = [tuple(r) for r in df.orderBy("i").collect()]
    assert [str(x) for _, x in got[:3]] == [str(x) for _, x in want[:3]]
    assert got[3:] == want[3:]


def test_shares_and_routing_scores_equal_sql(spark, tmp_path):
    """41 of 5,120 symbols are a share a hair under 0.0080078125; entropies of whole bits give coarse scores that end in 5."""
    texts = ["b" * 41 + "a" * 5079] + ["".join("ab"[j % 2] * (i + 1) + "c" for j in range(200 + 13 * i)) for i in range(40)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("e1_symbol_probabilities", "e2_entropy_guide", "f14_routing_scores"):
        cur = con.execute(catalog.oracle_sql()[name])
        names = [d[0] for d in cur.description]
        rows = catalog.queries()[name](spark, str(tmp_path)).collect()
        assert sorted(tuple(r[c] for c in names) for r in rows) == sorted(cur.fetchall()), name
    p = {r.code: r.p for r in catalog.queries()["e1_symbol_probabilities"](spark, str(tmp_path)).filter("sample_id = 0").collect()}
    assert p[ord("b")] == 0.008007812
