"""Match records against small brute force."""

from palimpsest.operators import matches as M, overlap as O, streams as S

RUN = "a string, b string, a0 long, a1 long, b0 long, b1 long"


def test_fragments_do_not_overlap(spark):
    r = spark.createDataFrame([("x", "y", 0, 10, 0, 10), ("x", "y", 50, 75, 5, 30), ("x", "y", 90, 100, 40, 50), ("x", "z", 0, 9, 0, 9)], RUN)
    got = [(x["a"], x["b"], x["place"], x["b0"], x["b1"]) for x in M.shown_fragments(r).orderBy("b", "place").collect()]
    assert got == [("x", "y", 1, 5, 30), ("x", "y", 2, 40, 50), ("x", "z", 1, 0, 9)]
    assert M.shown_fragments(r, 1).count() == 2 and M.shown_fragments(r.limit(0)).count() == 0
    assert {(x["a"], x["b"], x["passages"]) for x in M.distinct_passages(r).collect()} == {("x", "y", 2), ("x", "z", 1)}


def test_highlight_segments(spark):
    d = spark.createDataFrame([("d", "p", 0, 10), ("d", "q", 5, 15), ("d", "r", 15, 20), ("e", "p", 1, 2)], "doc string, id string, start long, end long")
    got = [(x["doc"], x["start"], x["end"], x["ids"]) for x in M.highlight_segments(d, ["doc"]).orderBy("doc", "start").collect()]
    assert got == [("d", 0, 5, ["p"]), ("d", 5, 10, ["p", "q"]), ("d", 10, 15, ["q"]), ("d", 15, 20, ["r"]), ("e", 1, 2, ["p"])]


def test_records_of_a_planted_passage(spark):
    """Citation inside, next to and far from the passage; quoted on both sides; error carried over; distinct display words."""
    passage = "the questionaire returns of well-known wetlands were counted every single morning by trained volunteers near the river"
    filler = [f"Row {k} speaks of matter number {k} and nothing else at all." for k in range(12)]
    a = ["This study began early.", passage.capitalize() + ".", "Nothing more follows."]
    rows = []
    for doc, text in (("a", a), ("in", [f"As Marchetti (2004) wrote, {passage}."] + filler), ("near", [passage + "."] + filler[:2] + ["See Marchetti for more."] + filler[3:]), ("far", [passage + "."] + filler[:8] + ["See Marchetti for more."])):
        rows += [(doc, i, t, [], 1, "", "results", "Results") for i, t in enumerate(text)]
    s = spark.createDataFrame(rows, "doc_id string, idx int, text string, excl array<string>, page int, printed string, bucket string, heading string")
    tok = S.token_rows(s)
    g = S.grams(S.token_stream(tok))
    pairs = spark.createDataFrame([("a", "in"), ("a", "near"), ("a", "far")], "a string, b string")
    runs = O.maximal_runs(O.matches(pairs, g)).where("a1 - a0 >= 15")
    texts = M.one_text(s)
    words = M.display_words(tok, texts)
    spans = M.sides(runs, words)
    names = spark.createDataFrame([("a", "Marchetti")], "doc_id string, surname string")
    rec = {r["b"]: r for r in M.records(spans, texts, names).collect()}
    assert {k: r["citation"] for k, r in rec.items()} == {"in": "attributed", "near": "adjacent-but-unattributed", "far": "unattributed"}
    assert all(r["errors"] == "misspelling:questionaire" and r["bucket_b"] == "results" for r in rec.values())
    assert M.covered_words(runs, words, "b").groupBy("b").count().where("b = 'near'").first()["count"] == len(passage.split())
    assert M.quoted_runs(spans, texts).count() == 0


def test_self_pairs_by_digest(spark):
    p = spark.createDataFrame([("x", "y"), ("x", "z"), ("u", "v")], "a string, b string")
    d = spark.createDataFrame([("x", "1"), ("y", "1"), ("z", "2"), ("u", None), ("v", "")], "doc_id string, sha256 string")
    assert {(r["a"], r["b"]) for r in M.without_self(p, d).collect()} == {("x", "z"), ("u", "v")}


def test_seeds_are_capped_but_runs_are_whole(spark):
    """A gram repeated over and over in both records: runs from seeds alone equal those from all matches."""
    text = " ".join(["a b c d e f g h i"] * 12)
    rows = spark.createDataFrame([("x", 0, text, []), ("y", 0, "z " + text, [])], "doc_id string, idx int, text string, excl array<string>")
    g = S.grams(S.token_stream(S.token_rows(rows)))
    pairs = spark.createDataFrame([("x", "y")], "a string, b string")
    capped, full = (sorted(map(tuple, O.maximal_runs(O.matches(pairs, g, cap), cap=cap).collect())) for cap in (2, 10**6))
    assert max(r[3] - r[2] for r in capped) == max(r[3] - r[2] for r in full) == 108
