"""Readers, layout, search, release checks, vectors and ingest on inline fixtures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.operators import citations as C, release as R, search, vectors as V
from palimpsest.sources import layout as L, records as X
from palimpsest.streaming import ingest

OAI = """<ListRecords><record><header><identifier>oai:x.org:1</identifier></header><metadata><dc:title>A thesis &amp; more</dc:title><dc:creator>Doe, J.</dc:creator><dc:creator>Roe, K.</dc:creator>
<dc:description>On teaching.</dc:description><dc:date>2011-05</dc:date><dc:type>PhD Thesis</dc:type><dc:identifier>https://x.org/id/eprint/1/</dc:identifier><dc:identifier>https://x.org/1/a.pdf</dc:identifier><dc:identifier>https://x.org/1/final.pdf</dc:identifier></metadata></record>
<record><header status="deleted"><identifier>oai:x.org:2</identifier></header></record><record><header></header><metadata><dc:title>no id</dc:title></metadata></record><resumptionToken>abc</resumptionToken></ListRecords>"""


def test_oai(spark):
    r = X.oai_records(spark.createDataFrame([(OAI,), (None,)], "xml string")).collect()
    assert len(r) == 1
    assert r[0].asDict() == {"id": "oai:x.org:1", "title": "A thesis & more", "creator": "Doe, J.; Roe, K.", "abstract": "On teaching.", "year": 2011, "publisher": None, "dctype": "PhD Thesis", "landing": "https://x.org/id/eprint/1/", "pdf_url": "https://x.org/1/final.pdf", "is_doctoral": 1, "is_education": 1}
    assert spark.createDataFrame([(OAI,)], "xml string").select(X.resumption_token(F.col("xml"))).first()[0] == "abc"


def test_tei(spark):
    t = '<listBibl><biblStruct><analytic><title level="a">On Things</title><author><surname>Smith</surname></author></analytic><date when="1999-01"/><idno type="DOI">10.1/x</idno></biblStruct><biblStruct><title level="m">No year</title><surname>Jones</surname></biblStruct></listBibl>'
    assert [tuple(r) for r in X.tei_references(spark.createDataFrame([("d", t)], "src string, tei string")).collect()] == [("d", "smith", 1999, "On Things", None, "10.1/x")]


def test_label_lines(spark):
    lines = ['{"id": "a", "ok": true, "response": "method, surely"}', "broken", '{"id": "b", "ok": false, "response": "THEORY"}', '{"id": "a", "ok": true, "response": "THEORY"}', '{"id": "c", "ok": true, "response": ""}', '{"id": "d", "ok": true, "response": "unknown"}']
    d = spark.createDataFrame(list(enumerate(lines)), "o int, value string")
    assert [tuple(r) for r in X.label_lines(d, ["METHOD", "THEORY"], order="o").collect()] == [("a", "THEORY")]


def test_sentence_payload(spark):
    six, four = '[["t", "3", "iii", "method", "Method", "caption;references"]]', '[["u", "4", "intro", ""]]'
    r = {x["doc_id"]: x for x in X.sentence_payload(spark.createDataFrame([("a", six), ("b", four)], "doc_id string, payload string")).collect()}
    assert r["a"]["excl"] == ["caption", "references"] and r["a"]["page"] == 3 and r["a"]["bucket"] == "method"
    assert r["b"]["excl"] == [] and r["b"]["bucket"] == "intro" and r["b"]["heading"] is None


def test_registry(spark):
    ok = spark.createDataFrame([("a", "focal-earlier"), ("b", "focal-later"), ("c", "control")], "key string, role string")
    assert X.registry(ok).count() == 3
    with pytest.raises(ValueError):
        X.registry(ok.where("role <> 'focal-later'"))


def test_pdf_links_and_files(spark, tmp_path):
    p = spark.createDataFrame([("<a href='x/y.pdf'>t</a>",), ("none",)], "html string")
    assert [r["pdf"] for r in X.pdf_links(p).collect()] == ["x/y.pdf", None]
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4 x")
    (tmp_path / "b.pdf").write_bytes(b"<html>")
    f = spark.read.format("binaryFile").load(str(tmp_path))
    assert {r["path"][-5:]: r["valid"] for r in X.valid_pdfs(f).collect()} == {"a.pdf": True, "b.pdf": False}
    assert R.manifest(spark, str(tmp_path)).count() == 2


def test_ordered_files_repeat(spark, tmp_path):
    d = spark.range(100).select(F.col("id"), (F.col("id") % 7).alias("k"))
    out = []
    for n in ("a", "b"):
        X.write_csv(d.repartition(3), str(tmp_path / n), ["k", "id"])
        out.append(b"".join(p.read_bytes() for p in sorted((tmp_path / n).glob("part*"))))
    assert out[0] == out[1]


def test_lines_and_paragraphs(spark):
    words = [("d", 1, "Hello", 10.0, 100.0, 110.0), ("d", 1, "world", 40.0, 101.0, 111.0), ("d", 1, "next", 10.0, 113.0, 123.0)]
    w = spark.createDataFrame(words, "doc_id string, page int, text string, x0 double, top double, bottom double")
    assert [r["text"] for r in L.lines_from_words(w).orderBy("n").collect()] == ["Hello world", "next"]
    lines = [("d", 1, 0, "The trans-", 10.0, 100.0, 110.0), ("d", 1, 1, "lation ended here.", 10.0, 112.0, 122.0), ("d", 1, 2, "A new one", 30.0, 124.0, 134.0), ("d", 1, 3, "by Anglo-", 10.0, 136.0, 146.0), ("d", 1, 4, "Saxon hands", 10.0, 148.0, 158.0)]
    x = spark.createDataFrame(lines, "doc_id string, page int, n int, text string, x0 double, top double, bottom double")
    assert [r["text"] for r in L.paragraphs(x, 12.0).orderBy("para").collect()] == ["The translation ended here.", "A new one by Anglo-Saxon hands"]


def test_folios_headings_references(spark):
    rows = [("d", p, 0, t, 10.0, top, top + 10, 10.0, False) for p, t, top in ((1, "iii", 800.0), (2, "iv", 800.0), (2, "7", 20.0), (3, "References", 100.0), (4, "Smith, J. (1999)", 100.0), (5, "Appendix A", 100.0))]
    x = spark.createDataFrame(rows, "doc_id string, page int, n int, text string, x0 double, top double, bottom double, size double, bold boolean")
    assert {(r["page"], r["printed"]) for r in L.folios(x).collect()} == {(1, "iii"), (2, "iv")}
    assert [r["in_refs"] for r in L.reference_state(x.where("page >= 3")).orderBy("page").collect()] == [True, True, False]
    h = x.select("text", L.is_heading(F.col("text"), F.col("size"), F.col("bold"), F.lit(10.0)).alias("h")).collect()
    assert {r["text"] for r in h if r["h"]} == {"References", "Appendix A"}
    assert L.modal_geometry(x.withColumn("text", F.lit("abc"))).first()["size"] == 10.0


def test_query_parser():
    assert search.parse_query('cats "big dogs" -fish') == [("AND", None, "cats", False), ("AND", None, "big dogs", False), ("NOT", None, "fish", False)]
    assert search.parse_query("title:law* OR x") == [("AND", "title", "law", True), ("OR", None, "x", False)]
    for bad in ("-first", "", '""'):
        with pytest.raises(search.QueryError):
            search.parse_query(bad)


def test_search_narrows(spark):
    d = spark.createDataFrame([(1, "big dogs bark", "a", None), (2, "dogs big", "b", "fish"), (3, None, None, None)], "docid int, title string, creator string, abstract string")
    ids = lambda q: {r["docid"] for r in search.boolean(d, "docid", q).collect()}
    assert ids("dogs") == {1, 2} and ids('"big dogs"') == {1} and ids("dogs -fish") == {1} and ids("ba*") == {1}
    s = search.bm25(d, "docid", ["dogs"]).collect()
    assert {r["docid"] for r in s} == {1, 2} and all(r["score"] <= 0 for r in s)


def test_release_problems(spark):
    d = spark.createDataFrame([("a b", "x", "12"), ("ok", "y", "n"), (None, "", None)], "i string, e string, n string")
    got = {(r["column"], r["problem"]): r["n"] for r in R.column_problems(d, {"i": R.Policy("id"), "e": R.Policy("enum", max_distinct=1), "n": R.Policy("int")}).collect()}
    assert got == {("i", "not id"): 1, ("n", "not int"): 1, ("e", "too many values"): 3}
    assert R.header_problems(["a", "Raw"], ["a", "b"], ["raw"]) == ["missing b", "unexpected Raw", "forbidden raw"]
    listed, present = spark.createDataFrame([("p", "1"), ("q", "2")], "path string, sha256 string"), spark.createDataFrame([("q", "3"), ("r", "4")], "path string, sha256 string")
    assert {tuple(r) for r in R.compare_listing(listed, present).collect()} == {("p", "missing"), ("q", "mismatch"), ("r", "unlisted")}


def test_top_k_equals_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    v = spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(x)] + [(99, None)], "k int, v array<double>")
    got = {(r["query"], r["place"]): r["hit"] for r in V.top_k(v.where("k % 20 = 0"), v, "k", "v", 3).collect()}
    s = np.round(x @ x.T, 6)
    for q in (0, 20, 40):
        best = [i for i in np.lexsort((np.arange(60), -s[q])) if i != q][:3]
        assert [got[q, p] for p in (1, 2, 3)] == best


def test_kmeans_is_deterministic(spark):
    rng = np.random.default_rng(1)
    c = np.eye(4)
    x = np.vstack([c[i % 4] + 0.05 * rng.normal(size=4) for i in range(40)])
    v = spark.createDataFrame([(i, [float(a) for a in r / np.linalg.norm(r)]) for i, r in enumerate(x)], "k int, v array<double>")
    a = {r["key"]: r["cluster"] for r in V.spherical_kmeans(v, "k", "v", 4).collect()}
    b = {r["key"]: r["cluster"] for r in V.spherical_kmeans(v.repartition(3), "k", "v", 4).collect()}
    assert a == b and len(set(a.values())) == 4 and all(a[i] == a[i % 4] for i in a)


def test_title_clusters(spark):
    rows = [(f"s{i}", "Smith", 1999, t) for i, t in enumerate(["theory of justice and fairness", "theory justice and fairness", "another book entirely different", "x", "theory of justice and fairness"])]
    d = spark.createDataFrame(rows + [(None, "a", 1, "b"), ("s", None, 1, "c")], "src string, surname string, year int, title string")
    got = {r["title"]: r["cluster"] for r in C.title_clusters(d).collect()}
    assert got["theory justice and fairness"] == 0 and got["another book entirely different"] == 1 and got[""] == -1
    assert C.resolved_works(C.title_clusters(d)).count() == 2


def test_ingest_is_idempotent(spark, tmp_path):
    src, dst = str(tmp_path / "src"), str(tmp_path / "dst")
    spark.range(10).selectExpr("id", "id * 2 as v").write.parquet(src)
    s = spark.read.parquet(src).schema
    for n in ("c1", "c2"):  # a second run with an own checkpoint replays every file
        ingest.ingest_once(ingest.stream_table(spark, src, s), ["id"], dst, str(tmp_path / n)).awaitTermination()
    assert spark.read.parquet(dst).count() == 10


def test_near_verbatim_is_complete(spark, monkeypatch):
    import random

    monkeypatch.setattr(C, "CELL", 40)
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdeiorst") for _ in range(rng.randrange(2, 11))) for _ in range(60)]
    rows = [" ".join(rng.choice(vocab) for _ in range(rng.randrange(6, 16))) for _ in range(90)]
    for t in rows[:60]:
        w = t.split()
        rows.append(" ".join(x[:-1] + "x" if len(x) > 5 else x for x in w))  # every long word misread
        rows.append(" ".join(sorted(w, key=len)[:-2]))
        rows.append(" ".join(w + rng.sample(vocab, 3)))
    d = spark.createDataFrame([(str(i), t) for i, t in enumerate(rows)], "key string, text string")
    got = {(r["ka"], r["kb"]) for r in C.near_verbatim(d, d).collect()}
    long = [(str(i), t) for i, t in enumerate(rows) if len(t.split()) >= 8]
    want = {(i, j) for i, s in long for j, t in long if C.token_set_ratio(s, t) >= 85}
    three = lambda t: set(sorted(set(t.split()), key=lambda w: (-len(w), w))[:3])
    assert got == want and any(not three(s) & three(t) for i, s in long for j, t in long if (i, j) in want)


def test_bounds_leave_only_near_texts(monkeypatch):
    """Misread, shortened and lengthened texts of all sizes: no near pair is missed, and hardly another is left for the exact ratio."""
    import random

    rng = random.Random(11)
    vocab = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(1, 12))) for _ in range(400)]
    plain = lambda words: " ".join(sorted(set(words)))
    a = [plain(rng.choice(vocab) for _ in range(rng.choice((8, 12, 16, 16, 16, 40, 90, 300)))) for _ in range(120)]
    b = [plain(rng.choice(vocab) for _ in range(rng.choice((8, 14, 16, 16, 60)))) for _ in range(120)]
    for t in a:
        w = t.split()
        b += [plain(x[:-1] + "z" if len(x) > 5 and rng.random() < 0.7 else x for x in w), plain(w[: rng.randrange(1, len(w) + 1)]), plain(w + rng.choice(a).split()), plain(rng.sample(w, len(w) * 3 // 4) + rng.choice(b).split()[:2])]
    b = sorted(set(b))
    assert max(map(len, a)) > C.LONG and min(map(len, b)) < 10
    want = {(i, j) for i, s in enumerate(a) for j, t in enumerate(b) if C.token_set_ratio(s, t) >= 85}
    got = list(C.possible(a, b, 85))
    assert len(got) == len(set(got)) and want <= set(got) and len(want) > 300
    short = {(i, j) for i, j in got if len(a[i]) < C.LONG and len(b[j]) < C.LONG}
    assert short <= want
    monkeypatch.setattr(C, "COLUMNS", 20), monkeypatch.setattr(C, "RARE", 5)
    assert want <= set(C.possible(a, b, 85)) and list(C.possible([], b, 85)) == list(C.possible(a, [], 85)) == []


def test_work_titles_meet_whole_texts(spark, tmp_path):
    from palimpsest.operators import release_queries as Q

    spark.createDataFrame([("w1", "A plain theory of narrow bridges under load"), ("w2", "Four words of it")], "key string, title string").write.parquet(f"{tmp_path}/work.parquet")
    spark.createDataFrame([("d1", "Other title", "We use a plain theory of narrow beams."), ("d2", "Other title", None)], "id string, title string, abstract string").write.parquet(f"{tmp_path}/docs.parquet")
    rows = [("d2", 0, "As in a plain theory of", []), ("d2", 1, "narrow bridges under load, four words of it.", []), ("d3", 0, "four words of nothing", [])]
    spark.createDataFrame(rows, "doc_id string, idx int, text string, excl array<string>").write.parquet(f"{tmp_path}/sentences.parquet")
    got = {tuple(r) for r in Q.release_longest_run_text(spark, str(tmp_path)).collect()}
    assert got == {("w1", "d1", 5), ("w1", "d2", 8)}


def test_verbatim_grams_go_over_rows_and_blocks_in_one_shuffle(spark, monkeypatch):
    """Grams over several rows, empty rows and the ends of blocks, against the token stream; private rows are shuffled once."""
    import random

    from palimpsest.operators import streams as S

    monkeypatch.setattr(S, "BLOCK", 4)
    rng = random.Random(3)
    rows = [(d, 2 * i if d == "b" else i, " ".join(rng.choice("ab") for _ in range(rng.choice((0, 0, 1, 2, 5, 9)))), ["x"] if rng.random() < 0.1 else []) for d in "abc" for i in range(60 if d != "c" else 3)]
    rows += [("a", 5, "b b b", []), ("a", 6, "", None), (None, 1, "a b a b a b a b", []), ("d", 0, None, [])]
    private = spark.createDataFrame(rows, "doc_id string, idx int, text string, excl array<string>")
    published = spark.createDataFrame([(i % 28, " ".join(rng.choice("ab") for _ in range(i * 3))) for i in range(30)] + [(None, "a b a b a b a b"), (99, None)], "k long, t string")
    pub = S.grams(S.token_stream(S.token_rows(published.select(F.col("k").cast("string").alias("doc_id"), F.lit(0).alias("idx"), F.col("t").alias("text"), F.array().cast("array<string>").alias("excl")))))
    own = S.grams(S.token_stream(S.token_rows(private))).select("g").distinct()
    want = {tuple(r) for r in pub.join(own, "g", "left_semi").groupBy("doc_id").agg(F.count_distinct("g")).collect()}
    got = R.verbatim_grams(published, private, "k", "t")
    assert {tuple(r) for r in got.collect()} == want and len(want) > 5
    assert S.row_grams(private).distinct().count() == own.count()
    monkeypatch.setattr(S, "BLOCK", 512)
    plan = R.verbatim_grams(published.where("k > 1"), private, "k", "t")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(doc_id") == 1 and plan.count("Exchange") <= 6


def test_no_entry_is_cut_between_parts(spark):
    """Entries over several rows, parts of three rows: the same references as in one part."""
    rows = []
    for k in range(9):
        rows += [f"Smith{chr(97 + k)}, J. ({1990 + k})", f"A theory of things number {chr(97 + k)} and more.", "Oxford: Press."]
    s = spark.createDataFrame([("d", i, x, [], "references") for i, x in enumerate(rows)], "doc_id string, idx int, text string, excl array<string>, bucket string")
    found = lambda n: sorted(map(tuple, C.parse_author_date(C.reference_blobs(s, n)).collect()))
    assert found(4) == found(10_000) and len(found(4)) == 9
    assert C.reference_blobs(s, 4).count() > 1


def test_oai_chains(spark, tmp_path):
    """Pages by tokens, several chains at once; a token given twice is an error."""
    from palimpsest.sources import oai

    for name, n in (("a", 3), ("b", 1)):
        d = tmp_path / name
        d.mkdir()
        for k in range(n):
            token = f"<resumptionToken>t{k + 1}</resumptionToken>" if k + 1 < n else "<resumptionToken/>"
            (d / f"{'t' + str(k) if k else 'first'}.xml").write_text(f"<r>{name}{k}</r>{token}")
    spark.dataSource.register(oai.OaiDataSource)
    got = spark.read.format("oai").option("folders", f"{tmp_path}/a,{tmp_path}/b").load()
    assert sorted((r["source"][-1], r["page"], r["xml"][3:5]) for r in got.collect()) == [("a", 0, "a0"), ("a", 1, "a1"), ("a", 2, "a2"), ("b", 0, "b0")]
    assert spark.read.format("oai").option("folders", f"{tmp_path}/a").option("max_pages", 2).load().count() == 2
    with pytest.raises(ValueError, match="twice"):
        list(oai.follow(lambda token: "<resumptionToken>x</resumptionToken>"))


def test_pdf_pages(spark):
    pdf = b"%PDF-1.4 1 0 obj << /Type /Pages /Count 2 >> endobj << /Type /Page /Parent 1 >> << /Type/Page >> \xff"
    f = spark.createDataFrame([("x.pdf", bytearray(pdf)), ("y.pdf", None)], "path string, content binary")
    e = spark.createDataFrame([("x.pdf", 2)], "path string, expected_pages int")
    assert {r["path"]: r["pages"] for r in X.expected_pages(f, e).collect()} == {"x.pdf": 2, "y.pdf": None}
    with pytest.raises(Exception, match="unexpected number of pages"):
        X.expected_pages(f, spark.createDataFrame([("x.pdf", 3)], "path string, expected_pages int")).collect()


def test_gz_csv_is_the_same_every_time(spark, tmp_path):
    """No time stands in the header of the packed files, and the same rows give the same bytes."""
    d = spark.createDataFrame([(k, f"v{k % 7}") for k in range(50)], "k int, v string")
    packs = []
    for name in ("p", "q"):
        X.write_csv(d, f"{tmp_path}/{name}", ["v", "k"], gzip=True)
        packs.append([f.read_bytes() for f in sorted((tmp_path / name).glob("*.gz"))])
    assert packs[0] == packs[1] and all(b[4:8] == bytes(4) for b in packs[0])


def test_large_keys_cluster_as_small_ones_do(spark):
    import random

    rng = random.Random(5)
    words = "theory wetland birds rivers policy market school law study history method field growth change".split()
    rows = [(f"s{k}", rng.choice(["smith", "jones"]), 1990, " ".join(rng.sample(words, rng.randrange(1, 6)))) for k in range(300)]
    rows += [(f"q{k}", "smith", 1990, t) for k, t in enumerate(["theori wetland birds", "wetland theory birds", "", None, "rivers"])]
    d = spark.createDataFrame(rows, "src string, surname string, year int, title string")
    whole, parts = (sorted(map(tuple, C.title_clusters(d, per_key=n).collect())) for n in (10_000, 10))
    assert whole == parts and len({r[4] for r in whole}) > 5
