"""Filters, orders, stemming, stemmed search, trees, shared references, exclusions."""

import pytest
from pyspark.sql import functions as F

from palimpsest.functions.stemming import plain_word, porter
from palimpsest.operators import search as R, study as Y

# the examples of the paper, as whole words
PAPER = "caresses caress ponies poni cats cat agreed agre plastered plaster motoring motor conflated conflat hopping hop falling fall filing file happy happi sky sky relational relat rational ration digitizer digit vietnamization vietnam operator oper hopefulness hope triplicate triplic electrical electr goodness good revival reviv adjustable adjust replacement replac adoption adopt effective effect probate probat rate rate controll control roll roll"


def test_porter():
    words = PAPER.split()
    assert [porter(w) for w in words[::2]] == words[1::2]
    assert porter("be") == "be" and porter("x1") == "x1" and plain_word("René") == "rene"


DOCS = "docid long, title string, abstract string, creator string, year int, words int, discipline string, subfield string, status string, repo string"


def docs(spark):
    rows = [(1, "Labour market policy", "Quantum dots", "René Dupont", 1999, 10, "Law", "x", "ok", "a"), (2, "Markets of labour", None, "b", 2001, None, "law ", "y", "ok", "a"), (3, "The labour markets", "schooling", None, None, 30, None, None, "skipped", "b"), (4, "", "", "", 2005, 5, "art", "x", "ok", "b")]
    return spark.createDataFrame(rows, DOCS)


def keys(df):
    return sorted(r[0] for r in df.select("docid").collect())


def test_filters(spark):
    d = docs(spark)
    assert keys(Y.record_filter(d, disciplines=["LAW"])) == [1, 2]
    assert keys(Y.record_filter(d, years=(2000, None), status="ok")) == [2, 4]
    assert keys(Y.record_filter(d, creator="dupont")) == [1] and keys(Y.record_filter(d)) == [1, 2, 3, 4]
    for bad in ({"years": (2005, 2000)}, {"words": (9, 3)}, {"years": (2000, 2001), "not_years": [2000, 2001]}):
        with pytest.raises(Y.Contradiction):
            Y.record_filter(d, **bad)


def test_orders_and_totals(spark):
    d = docs(spark)
    order = lambda o, n=9: [r["docid"] for r in Y.ordered(d, o, "docid", n).orderBy("place").collect()]
    assert order("year") == [4, 2, 1, 3] and order("oldest") == [1, 2, 4, 3] and order("words") == [3, 1, 4, 2] and order("id", 0) == []
    with pytest.raises(ValueError):
        order("relevance")
    with pytest.raises(ValueError):
        order("colour")
    t = Y.totals(d).first()
    assert (t["total"], t["first_year"], t["last_year"], t["words"]) == (4, 1999, 2005, 45)
    assert Y.totals(d.limit(0)).first()["words"] == 0


@pytest.mark.parametrize("query, want", [('"labour market"', [1, 3]), ("market", [1, 2, 3]), ("market -school", [1, 2]), ("rene", [1]), ("title:quantum", []), ("abstract:dot", [1]), ("schoo*", [3]), ("dots OR school", [1, 3])])
def test_stemmed_search(spark, query, want):
    p = Y.stemmed_postings(docs(spark), "docid", list(R.FIELDS))
    assert keys(Y.stemmed_search(p, "docid", R.parse_query(query))) == want


def test_tree_and_node_works(spark):
    rows = [(i, [1.0 if j == i % 4 else 0.05 * ((i * 7 + j) % 3) for j in range(4)]) for i in range(240)]
    v = spark.createDataFrame(rows, "id long, v array<double>")
    got = {r["id"]: r["node"] for r in Y.tree(v, "id", "v", split=60, per_child=60, least=20, depth=1).collect()}
    assert len(got) == 240 and len(set(got.values())) == 4
    assert all(len({got[i] for i in range(k, 240, 4)}) == 1 for k in range(4))
    assert {r["node"] for r in Y.tree(v.limit(30), "id", "v").collect()} == {"0"}
    placed = spark.createDataFrame([("a", "0.1"), ("b", "0.1"), ("c", "0.2")], "src string, node string")
    cites = spark.createDataFrame([("a", "x", 1), ("b", "x", 1), ("c", "x", 1), ("c", "y", 2), ("c", "y", 2)], "src string, surname string, year int")
    assert {tuple(r) for r in Y.node_works(placed, cites).select("node", "records", "works", "citations").collect()} == {("0", 3, 2, 4), ("0.1", 2, 1, 2), ("0.2", 1, 2, 2)}


def test_shared_references(spark):
    cites = spark.createDataFrame([("a", "x", 1), ("a", "y", 1), ("b", "x", 1), ("b", "x", 1)], "src string, surname string, year int")
    p = spark.createDataFrame([("a", "b"), ("a", "c")], "q string, h string")
    got = {r["h"]: (r["shared"], r["jaccard"]) for r in Y.shared_references(p, cites).collect()}
    assert got == {"b": (1, 0.5), "c": (0, 0.0)}
    s = spark.createDataFrame([(0, "a"), (1, "b")], "i int, q string")
    pool = spark.createDataFrame([(k, c) for k, c in enumerate("abcde")], "place int, h string")
    want = {(q, "abcde"[(i * 7919 + j * 1327) % 5]) for i, q in ((0, "a"), (1, "b")) for j in range(1, 4)}
    assert {tuple(r) for r in Y.unrelated(s, pool, 3).collect()} == {(q, h) for q, h in want if q != h}


def test_exclusions(spark):
    rows = [("d", i, f"Smith{i}, J. (199{i}) A long entry of a list.", 9, "Results") for i in range(6)] + [("d", 7, "Table 3 Values", 1, "Results"), ("d", 8, "I hereby declare that this is mine.", 1, "Preface"), ("d", 9, "Plain row of text.", 1, "References"), ("d", 10, None, None, None)]
    s = spark.createDataFrame(rows, "doc_id string, idx int, text string, page int, heading string")
    got = {r["idx"]: r["excl"] for r in Y.exclusions(s).collect()}
    assert all(got[i] == ["references"] for i in range(6)) and got[7] == ["caption"] and got[8] == ["boilerplate"] and got[9] == ["references"] and got[10] == []
