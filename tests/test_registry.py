"""Every query runs on the smallest tables; those with SQL agree with DuckDB."""

import os

import pytest

from palimpsest.plans import registry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_oracles_belong_to_queries():
    assert set(registry.oracles()) <= set(registry.queries())


def test_entry_imports():
    import __spark_entry__ as e

    assert set(registry.queries()) <= set(e.queries())


def canonical(df):
    """Rows as sorted text; a missing value of any kind is ''."""
    import pandas as pd

    def text(v):
        if not hasattr(v, "__len__") and pd.isna(v):
            return ""
        return f"{float(v):.6g}" if hasattr(v, "__float__") and not isinstance(v, str) else str(v)

    return sorted(tuple(map(text, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def tables():
    import duckdb

    con = duckdb.connect()
    for t in os.listdir(DATA):
        con.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{DATA}/{t}'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_query_against_sql(spark, tables, name):
    got = registry.queries()[name](spark, DATA).toPandas()
    want = tables.execute(registry.oracles()[name]).df()
    assert canonical(got) == canonical(want)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracles())))
def test_query_without_sql_runs(spark, name):
    df = registry.queries()[name](spark, DATA)
    assert len(df.columns) == len(set(df.columns)) and df.count() >= 0


def test_queries_that_find_nothing_in_the_tables(spark, tmp_path):
    """Rows made for those that return none on the tables given; the SQL agrees."""
    import duckdb
    import pandas as pd

    doc = pd.DataFrame({"id": ["a:1", "b:2", "c:3", "d:4"], "status": ["ok", "ok", "ok", "pending"]})
    long = "the quiet theory of wetland birds and rivers"
    made = {
        "documents": pd.DataFrame({"source": ["dunmarrow", "aldermoor"]}), "doc": doc, "srcstat": pd.DataFrame({"src": ["a:1"], "ref_words": [9], "entries": [1], "parsed": [1]}),
        "work": pd.DataFrame({"key": ["w1", "w2"], "title": [long, "short"]}), "docs": pd.DataFrame({"docid": [1, 2], "id": ["a:1", "x:9"], "repo": ["aldermoor", "kestrelton"], "title": ["On " + long + " again", "else"]}),
        "cite": pd.DataFrame({"src": ["a:1"], "surname": [" Marchetti "], "year": pd.array([2004], "int32")}),
        "sentences": pd.DataFrame({"doc_id": ["a:1", "a:1"], "idx": pd.array([0, 1], "int32"), "text": ["As Marchetti (2004) shows, birds return.", "Nothing here."], "page": pd.array([3, 3], "int32"), "excl": [[], []]}),
    }
    con = duckdb.connect()
    for name, df in made.items():
        spark.createDataFrame(df).write.parquet(f"{tmp_path}/{name}.parquet") if name != "sentences" else spark.createDataFrame(df, "doc_id string, idx int, text string, page int, excl array<string>").write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    for name in ("src_resume", "release_longest_run", "set_symmetric_difference"):
        got = registry.queries()[name](spark, str(tmp_path)).toPandas()
        assert len(got) and canonical(got) == canonical(con.execute(registry.oracles()[name]).df()), name
    ctx = registry.queries()["bridge_contexts"](spark, str(tmp_path)).collect()
    assert [(r["doc_id"], r["surname"], r["year"], r["page"]) for r in ctx] == [("a:1", "marchetti", 2004, 3)]


def test_imports_above_chance(spark):
    """Two fields that cite each other's works far more than chance have it, and one that does not."""
    from palimpsest.operators import graph as G

    rows = []
    for field, home in (("law", "law"), ("art", "art"), ("bio", "bio")):
        rows += [(field, f"{home}{k}", 2000, 30) for k in range(60 if home == "bio" else 12)]
    rows += [("law", f"art{k}", 2000, 25) for k in range(12)]
    fc = spark.createDataFrame(rows, "field string, surname string, year int, n long")
    f = G.flow(fc, G.placements(fc, True, 3)).where("lower > 1 and citing <> home").collect()
    assert [(r["citing"], r["home"]) for r in f] == [("law", "art")]
