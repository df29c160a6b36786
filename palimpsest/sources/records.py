"""Readers for harvested XML, label lines, reference XML and pages; writers of ordered files.

XML is cut into records and read with expressions, so a batch of any size stays distributed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from palimpsest.functions import text as T


def _all(tag: str, c: Column) -> Column:
    raw = F.regexp_extract_all(c, F.lit(rf"(?s)<(?:\w+:)?{tag}(?:\s[^>]*)?>(.*?)</(?:\w+:)?{tag}>"), F.lit(1))
    return F.filter(F.transform(raw, lambda x: unescape(F.trim(x))), lambda x: x != "")


def unescape(c: Column) -> Column:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def oai_records(xml: DataFrame, column: str = "xml") -> DataFrame:
    """Rows of OAI-PMH ListRecords answers: deleted records and those without an identifier are skipped.

    Creators are joined by '; ', descriptions cut at 4,000 characters, the year is the leading four
    digits of the first date, the landing page the first id that is a record page, the file the best
    PDF (one named whole, full, thesis, final or complete first, the longest of them).
    """
    r = xml.select(F.explode(F.regexp_extract_all(F.col(column), F.lit(r"(?s)<record>(.*?)</record>"), F.lit(1))).alias("r")).where(~F.col("r").rlike(r'<header[^>]*status="deleted"'))
    c = F.col("r")
    ids = _all("identifier", F.regexp_replace(c, r"(?s)<header.*?</header>", ""))
    links = F.array_distinct(F.concat(ids, _all("relation", c)))
    pdfs = F.filter(links, lambda x: x.rlike(r"(?i)^https?://.*\.pdf$"))
    ranked = F.array_sort(F.transform(pdfs, lambda x: F.struct((~x.rlike("(?i)whole|full|thesis|final|complete")).cast("int").alias("k"), (-F.length(x)).alias("l"), x.alias("x"))))
    out = r.select(
        F.regexp_extract(c, r"(?s)<header.*?<identifier>(.*?)</identifier>", 1).alias("id"), F.get(_all("title", c), F.lit(0)).alias("title"), F.array_join(_all("creator", c), "; ").alias("creator"),
        F.substring(F.array_join(_all("description", c), ""), 1, 4000).alias("abstract"), F.nullif(F.regexp_extract(F.coalesce(F.get(_all("date", c), F.lit(0)), F.lit("")), r"^(\d{4})", 1), F.lit("")).cast("int").alias("year"),
        F.get(_all("publisher", c), F.lit(0)).alias("publisher"), F.array_join(_all("type", c), "; ").alias("dctype"), F.coalesce(F.get(F.filter(ids, lambda x: x.contains("/id/eprint/") & ~x.rlike("(?i)pdf$")), F.lit(0)), F.lit("")).alias("landing"), F.coalesce(F.get(ranked, F.lit(0))["x"], F.lit("")).alias("pdf_url"),
    ).where(F.col("id") != "")
    return out.withColumn("is_doctoral", T.doctoral(F.col("title"), F.col("abstract"), F.col("dctype")).cast("int")).withColumn("is_education", T.education(F.col("title"), F.col("abstract")).cast("int"))


def resumption_token(c: Column) -> Column:
    """Token of the next page, or null at the end."""
    return F.nullif(F.regexp_extract(c, r"(?s)<resumptionToken[^>]*>(.*?)</resumptionToken>", 1), F.lit(""))


def tei_references(tei: DataFrame, src: str = "src", column: str = "tei") -> DataFrame:
    """(src, surname, year, title, venue, doi) of biblStruct elements with a surname, a year of 1500 to 2027 and a title or venue."""
    b = tei.select(src, F.explode(F.regexp_extract_all(F.col(column), F.lit(r"(?s)<biblStruct.*?</biblStruct>"), F.lit(0))).alias("b"))
    c = F.col("b")
    g = lambda rx: F.nullif(unescape(F.trim(F.regexp_extract(c, rx, 1))), F.lit(""))
    title = F.coalesce(g(r'(?s)<title[^>]*level="a"[^>]*>(.*?)</title>'), g(r'(?s)<title[^>]*level="m"[^>]*>(.*?)</title>'))
    x = b.select(src, F.lower(g(r"(?s)<surname>(.*?)</surname>")).alias("surname"), F.nullif(F.regexp_extract(c, r'<date[^>]*when="(\d{4})', 1), F.lit("")).cast("int").alias("year"), title.alias("title"), g(r'(?s)<title[^>]*level="j"[^>]*>(.*?)</title>').alias("venue"), g(r'(?s)<idno[^>]*type="DOI"[^>]*>(.*?)</idno>').alias("doi"))
    return x.where(F.col("surname").isNotNull() & (F.length("surname") > 1) & F.col("surname").rlike(r"^[\p{L}][\p{L}'’ \-]+$") & F.col("year").between(1500, 2027) & (F.col("title").isNotNull() | F.col("venue").isNotNull()))


def label_lines(lines: DataFrame, labels: list[str], column: str = "value", order: str | None = None) -> DataFrame:
    """(id, label) of JSON lines {id, ok, response}: bad lines, failed or empty answers and unknown labels are skipped, the last line of an id wins."""
    j = F.from_json(F.col(column), "id string, ok boolean, response string", {"mode": "PERMISSIVE"})
    o = F.col(order) if order else F.monotonically_increasing_id()
    x = lines.select(j.alias("j"), o.alias("o")).where("j.id is not null and coalesce(j.ok, false) and trim(coalesce(j.response, '')) <> ''")
    word = F.upper(F.regexp_extract("j.response", r"([A-Za-z_]+)", 1))
    return x.where(word.isin(*labels)).groupBy(F.col("j.id").alias("id")).agg(F.max_by(word, "o").alias("label"))


def sentence_payload(payload: DataFrame, doc: str = "doc_id", column: str = "payload") -> DataFrame:
    """Rows of the stored sentence arrays, of six fields or the older four (text, page, bucket, excl)."""
    a = payload.select(doc, F.posexplode(F.from_json(F.col(column), "array<array<string>>")).alias("idx", "r"))
    six = F.size("r") >= 6
    at = lambda i, j: F.when(six, F.get("r", F.lit(i))).otherwise(F.get("r", F.lit(j)) if j is not None else F.lit(None))
    excl = F.filter(F.split(F.coalesce(at(5, 3), F.lit("")), ";"), lambda x: x != "")
    return a.select(doc, "idx", at(0, 0).alias("text"), at(1, 1).cast("int").alias("page"), at(2, None).alias("printed"), at(3, 2).alias("bucket"), at(4, None).alias("heading"), excl.alias("excl"))


def registry(docs: DataFrame) -> DataFrame:
    """A document registry, unchanged; raises unless it has exactly one earlier and one later focal document."""
    n = {r["role"]: r["n"] for r in docs.groupBy("role").agg(F.count("*").alias("n")).collect()}  # three roles
    bad = [r for r in ("focal-earlier", "focal-later") if n.get(r, 0) != 1]
    if bad or set(n) - {"focal-earlier", "focal-later", "control"}:
        raise ValueError(f"registry needs exactly one document of each focal role, has {n}")
    return docs


def pdf_links(pages: DataFrame, html: str = "html") -> DataFrame:
    """Pages with ``pdf``, the first link to a PDF or null."""
    return pages.withColumn("pdf", F.nullif(F.regexp_extract(html, r"""(?i)href\s*=\s*["']([^"']+\.pdf)["']""", 1), F.lit("")))


def valid_pdfs(files: DataFrame) -> DataFrame:
    """(path, sha256, valid) of a binaryFile read: a PDF begins with its mark."""
    return files.select("path", F.sha2("content", 256).alias("sha256"), (F.substring("content", 1, 5) == F.lit(b"%PDF-")).alias("valid"))


def pdf_pages(content: Column) -> Column:
    """Number of page objects of a PDF that are not packed in object streams."""
    return F.regexp_count(F.decode(content, "ISO-8859-1"), F.lit(r"/Type\s*/Page(?![A-Za-z])"))


def expected_pages(files: DataFrame, expected: DataFrame) -> DataFrame:
    """Files (path, content) with ``pages``; a PDF whose page count is not the one expected (path, expected_pages) stops the job."""
    x = files.join(expected, "path", "left").withColumn("pages", pdf_pages(F.col("content")))
    wrong = F.col("expected_pages").isNotNull() & (F.col("pages") != F.col("expected_pages"))
    stop = F.raise_error(F.concat(F.lit("unexpected number of pages in "), "path")).cast("int")
    return x.withColumn("pages", F.when(wrong, stop).otherwise(F.col("pages"))).drop("expected_pages")


def write_csv(df: DataFrame, path: str, order: list[str], gzip: bool = False) -> None:
    """One file per range of the total order ``order``, LF line ends: the same rows give the same bytes."""
    w = df.orderBy(*order).write.mode("errorifexists").option("header", True).option("lineSep", "\n")
    (w.option("compression", "gzip") if gzip else w).csv(path)


def write_json(df: DataFrame, path: str, order: list[str]) -> None:
    """JSON lines with keys in name order, rows in ``order``."""
    df.orderBy(*order).select(F.to_json(F.struct(*sorted(df.columns))).alias("value")).write.mode("errorifexists").text(path)


def payload_text(pages: DataFrame, html: str = "html") -> Column:
    """Visible text and script strings of a page: tags dropped, entities decoded."""
    return T.normalise(unescape(F.regexp_replace(F.col(html), r"<[^>]+>", " ")))
