"""Text functions against plain values."""

import re

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.operators import citations as C


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "x string").select(fn(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("value, want", [("Well-known facts – plainly", ["wellknown", "facts", "plainly"]), ("café", ["caf"]), ("", []), (None, []), ("a-b-c d", ["abc", "d"])])
def test_match_tokens(spark, value, want):
    assert one(spark, value, T.match_tokens) == want


def test_normalise(spark):
    assert one(spark, "ﬁne “text” – with odd…", T.normalise) == 'fine "text" – with odd...'


@pytest.mark.parametrize("value, want", [("3 Methodology", "methodology"), ("References", "references"), ("Discussion of Results", "discussion"), ("Something", "unclassified"), (None, "unclassified"), ("Appendix B: Results", "appendix")])
def test_heading_bucket(spark, value, want):
    assert one(spark, value, T.heading_bucket) == want


@pytest.mark.parametrize("value, want", [("e\ufb03cient \ufb01nal", "efficient final"), ("\u201cquoted\u201d \u2018single\u2019", "\"quoted\" 'single'"), ("1990\u20132000 and dash \u2014 here", "1990\u20132000 and dash \u2013 here"), ("cafe\u0301 A\u030a", "caf\u00e9 \u00c5"), ("  a\u00a0\u00a0b ", "a b"), (None, None)])
def test_normalise_shapes(spark, value, want):
    assert one(spark, value, T.normalise) == want


SENTENCES = [
    ("Smith et al. found that it worked. The next claim follows.", 2), ("This holds, i.e. always. Then something else happens.", 2), ("See pp. 23-45. The argument resumes there.", 2),
    ("Reported by Fairweather-Blake, P. A. Smith agreed with that.", 1), ("1. Introduction to the area. The topic is broad.", 2), ("It was published in 2009. The sequel came later.", 2),
    ("Dr. Jones disagreed with that view entirely.", 1), ('He said "it works." "Then" she left.', 2), ("no capital. follows here", 1), ("", 0), (None, 0), ("A word in 12. Then more!  (Next) one?", 2),
]


@pytest.mark.parametrize("value, want", SENTENCES)
def test_sentences(spark, value, want):
    got = one(spark, value, T.sentences)
    assert len(got) == want and " ".join(got).split() == (value or "").split()


@pytest.mark.parametrize("value, want", [("CHAPTER TWO: LITERATURE REVIEW", "literature_review"), ("Chapter 6: Discussion and implications of research findings", "discussion"), ("Appendix 3: Findings tables", "appendix"), ("Some unusual chapter name", "unclassified")])
def test_heading_bucket_earliest_wins(spark, value, want):
    assert one(spark, value, T.heading_bucket) == want


def test_sentence_flags(spark):
    flag = lambda text, name: one(spark, text, lambda c: T.flags(c)[name])
    assert flag("(Marchetti, 2004, p. 88)", "attribution") and flag("as Marchetti (2004) argued", "attribution") and not flag("the cohort numbered 2004 trainees", "attribution")
    assert flag("Table 4.2 Distribution of responses", "caption") and flag("I hereby declare that this thesis is my own work.", "boilerplate")
    assert one(spark, "This study examined 120 student teachers who were recruited from four schools.", T.directions) == ["own_participants", "own_study"]
    assert one(spark, "The weather in April is variable.", T.directions) == []


@pytest.mark.parametrize("value, want", [(0.1, "0.1"), (1e300, "1e+300"), (12345678.0, "12345678"), (1.5, "1.5"), (0.0, "0"), (None, ""), (float("nan"), ""), (float("inf"), ""), (100.0, "100"), (1 / 3, "0.3333333333")])
def test_number_text(spark, value, want):
    assert spark.createDataFrame([(value,)], "x double").select(T.number_text(F.col("x"))).first()[0] == want


def test_error_signatures(spark):
    got = one(spark, "The the seperate thing ,then camelCase end- ing no;space !!", T.error_signatures)
    assert set(got) == {"doubled_word:the", "misspelling:seperate", "spaced_punct:,", "spaced_punct:!", "internal_caps:camelcase", "split_hyphen:end-ing", "missing_space:no;space", "doubled_punct:!"}
    assert one(spark, None, T.error_signatures) == []


@pytest.mark.parametrize("value, want", [("Smith, John; Other, A.", "smith|j"), ("John van Smith", "smith|j"), ("", ""), (None, ""), ("Madonna", "madonna|")])
def test_author_key(spark, value, want):
    assert one(spark, value, T.author_key) == want


def test_directions(spark):
    assert one(spark, "In this study the sample comprised 20 pupils; this chapter ends.", T.directions) == ["own_chapter_structure", "own_participants", "own_study"]


def test_prose(spark):
    x = lambda c: T.is_prose(T.match_tokens(c))
    assert one(spark, "several longer words make readable prose here", x) is True
    assert one(spark, "a b c d e f 1 2 3", x) is False
    assert one(spark, "", x) is False


def test_chunks_cover_all_words(spark):
    words = [f"w{i}" for i in range(300)]
    got = one(spark, " ".join(words), T.chunks)
    assert [len(c.split()) for c in got] == [140, 140, 80]
    assert set(" ".join(got).split()) == set(words)
    assert one(spark, "", T.chunks) == []


STYLES = {
    "bracket": "[1] Smith J. The theory of things. Press 1999. [2] Jones K. Another theory of many things 2001. [3] Brown L. Third work on the matter 2005.",
    "number": "1. Smith J. The theory of things. Press 1999. 2. Jones K. Another theory of many things 2001. 3. Brown L. Third work on the matter 2005.",
    "author_date": "Smith, J. (1999) The theory of things. Press. Jones, K. (2001) Another theory of things. Press. Brown, L. (2005) Third work on the matter. Press.",
}


@pytest.mark.parametrize("style", STYLES)
def test_segment(spark, style):
    assert len(one(spark, STYLES[style], C.segment)) == 3


def test_segment_rejects(spark):
    assert one(spark, "", C.segment) == [] and one(spark, None, C.segment) == []


def test_parse_author_date(spark):
    b = spark.createDataFrame([("d", 0, STYLES["author_date"]), ("e", 0, None)], "doc_id string, part int, blob string")
    got = {(r["surname"], r["year"], r["title"]) for r in C.parse_author_date(b).collect()}
    assert got == {("smith", 1999, "the theory things"), ("jones", 2001, "another theory things"), ("brown", 2005, "third work the matter")}


def test_looks_bibliographic(spark):
    blob = " ".join([STYLES["author_date"]] * 4)
    f = lambda c: C.looks_bibliographic(c, C.segment(c))
    assert one(spark, blob, f) == "ok"
    assert one(spark, "short", f) == "too short"
    assert one(spark, "word and more prose without any year at all " * 12, f) == "almost no years"


def test_clean_title(spark):
    d = spark.createDataFrame([("Smith, J. (1999) A theory of justice. Oxford: Press, 12.", 1999), ("nothing", 1999), (None, None)], "raw string, year int")
    assert [r[0] for r in d.select(C.clean_title(F.col("raw"), F.col("year"))).collect()] == ["A theory of justice", "", ""]


def test_ratios():
    assert C.token_set_ratio("a b c", "c b a d") == 100.0
    assert C.token_sort_ratio("b a", "a b") == 100.0
    assert C.token_set_ratio("", "x") == 0.0
    assert re.match("x", "x")
