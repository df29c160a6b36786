"""Scalar text functions as Column expressions (JVM side, no Python per row).

A null input gives null, or the neutral value named in the docstring.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, functions as F

from palimpsest.functions import patterns as P


def _composed() -> dict[str, str]:
    """Decomposed spelling of every Latin letter with marks that has a composed one."""
    out = {}
    for code in [*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)]:
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1 and unicodedata.normalize("NFC", parts) == chr(code):
            out[parts] = chr(code)
    return out


def composed(c: Column) -> Column:
    """Latin letters followed by combining marks as one character each (NFC); texts without such marks pass as they are."""
    table = F.create_map(*[F.lit(x) for kv in _composed().items() for x in kv])
    letters = F.transform(F.regexp_extract_all(c, F.lit(r"(?s)[^\u0300-\u036f][\u0300-\u036f]*|[\u0300-\u036f]+"), F.lit(0)), lambda x: F.when(F.length(x) > 1, F.coalesce(F.try_element_at(table, x), x)).otherwise(x))
    return F.when(c.rlike(r"[\u0300-\u036f]"), F.array_join(letters, "")).otherwise(c)


def normalise(c: Column) -> Column:
    """Composed letters; ligatures, quotes, dashes, odd spaces and zero-width marks to plain characters; runs of blanks collapse."""
    c = F.translate(composed(c), P.ONE_TO_ONE_FROM, P.ONE_TO_ONE_TO)
    for a, b in P.ONE_TO_MANY.items():
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.regexp_replace(F.regexp_replace(c, " {2,}", " "), r"^\s+|\s+$", "")


def match_tokens(c: Column) -> Column:
    """Lower-case ASCII word list: en dash parts, hyphen inside a word is dropped, all else parts. Null gives []."""
    c = F.replace(F.lower(F.coalesce(c, F.lit(""))), F.lit("–"), F.lit(" "))
    c = F.regexp_replace(c, "(?<=[a-z0-9])-(?=[a-z0-9])", "")
    c = F.regexp_replace(c, "[^a-z0-9]+", " ")
    return F.filter(F.split(c, " "), lambda x: x != "")


def norm_title(c: Column) -> Column:
    """First eight words of more than two letters."""
    words = F.split(F.regexp_replace(F.lower(normalise(F.coalesce(c, F.lit("")))), "[^a-z0-9 ]", " "), " +")
    return F.array_join(F.slice(F.filter(words, lambda x: F.length(x) > 2), 1, 8), " ")


def mark_sentences(c: Column, mark: str = "\u0001") -> Column:
    """The text with ``mark`` after each sentence end.

    An end is a run of . ! ? with its closing quotes, followed by blanks and a capital or digit (one opening quote may stand
    before it), unless an abbreviation, an initial or a number of up to three digits stands before it.
    """
    ends = F.regexp_replace(c, r"""([.!?]+["')\]’”]*)(\s+)(?=["'(\[‘“]?[\p{Lu}\p{Nd}])""", f"$1{mark}$2")
    words = "|".join(sorted((re.escape(w) for w in P.ABBREVIATIONS), key=lambda w: (-len(w), w)))
    close = rf"""(\s*[.!?]+["')\]’”]*){mark}"""
    kept = F.regexp_replace(ends, rf"(?<![A-Za-z])(?<![A-Za-z]\.{{1,9}})((?i:{words})|[A-Za-z](?:\.[A-Za-z])?){close}", "$1$2")
    return F.regexp_replace(kept, rf"((?:^|\s)\d{{1,3}}){close}", "$1$2")


def sentences(c: Column) -> Column:
    """The sentences of a text, in order, without blanks around; [] for null and blank texts."""
    parts = F.transform(F.split(mark_sentences(F.coalesce(c, F.lit(""))), "\u0001"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.filter(parts, lambda x: x != "")


def heading_boilerplate(c: Column) -> Column:
    return F.coalesce(c.rlike(P.BOILERPLATE_HEADING), F.lit(False))


def document_key(id_: Column) -> Column:
    """A short key of a record: letters and digits of its id, and a digest that tells ids apart."""
    return F.concat_ws("-", F.substring(F.trim(F.regexp_replace(F.lower(F.coalesce(id_, F.lit(""))), "[^a-z0-9]+", " ")), 1, 40), F.substring(F.sha2(F.coalesce(id_, F.lit("")), 256), 1, 8))


def archive_number(id_: Column) -> Column:
    """The number at the end of an archive id ``oai:host:number``; '' if there is none."""
    return F.coalesce(F.regexp_extract(id_, r"^oai:[^:]+:(\d+)$", 1), F.lit(""))


def number_text(c: Column) -> Column:
    """A number as text, ten digits at most, no trailing zeros; '' for null, NaN and infinities."""
    x = c.cast("double")
    plain = F.format_string("%.10g", x)
    plain = F.when(plain.contains(".") & ~plain.contains("e"), F.regexp_replace(plain, r"\.?0+$", "")).otherwise(F.regexp_replace(plain, r"\.?0+e", "e"))
    return F.when(c.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit("")).when(x == 0, F.lit("0")).otherwise(plain)


def like_literal(c: Column) -> Column:
    """A string as a LIKE pattern that matches nothing but itself (escape character a backslash)."""
    return F.regexp_replace(c, r"([\\%_])", r"\\$1")


def ordinal(n: Column) -> Column:
    """1st, 2nd, 3rd, 4th, 11th ..."""
    end = F.when((n % 100).between(11, 13), "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), end)


def plural(n: Column, one: str, many: str | None = None) -> Column:
    return F.concat(n.cast("string"), F.when(n == 1, F.lit(f" {one}")).otherwise(F.lit(f" {many or one + 's'}")))


def markdown_literal(c: Column) -> Column:
    """A string for a cell of a Markdown table: bars escaped, line ends as blanks."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"\|", r"\\|"), r"[\r\n]+", " ")


def html_literal(c: Column) -> Column:
    """A string for HTML text and attributes."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda x: x != ""))


def syllables(word: Column) -> Column:
    """Vowel groups of a lower-case word, at least one."""
    return F.greatest(F.lit(1), F.regexp_count(word, F.lit("[aeiouy]+")))


def flags(c: Column) -> dict[str, Column]:
    """Caption, boilerplate, attribution and reference-entry tests of a sentence."""
    return {name: F.coalesce(c.rlike(rx), F.lit(False)) for name, rx in P.FLAGS.items()}


def directions(c: Column) -> Column:
    """Sorted names of the self-descriptions found in a sentence."""
    return F.array_sort(F.array_compact(F.array(*[F.when(c.rlike(rx), F.lit(name)) for name, rx in P.DIRECTIONS.items()])))


def heading_bucket(c: Column) -> Column:
    """Kind of chapter a heading opens: structural kinds first, else the earliest match (ties by order), else unclassified."""
    low = F.lower(F.coalesce(c, F.lit("")))
    out = F.lit(None).cast("string")
    spots = []
    for k, (name, rx) in enumerate(P.CHAPTERS):
        at = F.length(F.regexp_extract(low, rf"^(.*?)(?:{rx})", 1))
        spots.append(F.when(low.rlike(rx), F.struct(at.alias("at"), F.lit(k).alias("k"), F.lit(name).alias("name"))))
    best = F.array_min(F.array_compact(F.array(*spots)))
    for name, rx in reversed(P.STRUCTURAL):
        out = F.when(low.rlike(rx), F.lit(name)).otherwise(out)
    return F.coalesce(out, best["name"], F.lit("unclassified"))


def _labelled(values: Column, name: str, low: bool) -> Column:
    return F.transform(values, lambda x: F.concat(F.lit(f"{name}:"), F.lower(x) if low else x))


def error_signatures(c: Column) -> Column:
    """Sorted oddities a copy would carry over: doubled words, split hyphens, spaced or doubled punctuation, missing spaces, inner capitals, usual misspellings."""
    c = F.coalesce(c, F.lit(""))
    found = []
    for name, (rx, groups, low) in P.ERRORS.items():
        parts = [F.regexp_extract_all(c, F.lit(rx), F.lit(g)) for g in groups]
        one = parts[0] if len(parts) == 1 else F.zip_with(parts[0], parts[1], lambda a, b: F.concat_ws("-", a, b))
        found.append(_labelled(one, name, low))
    words = F.transform(F.regexp_extract_all(c, F.lit("([A-Za-z]{4,})"), F.lit(1)), lambda x: F.lower(x))
    typos = F.array_intersect(words, F.array(*[F.lit(x) for x in P.MISSPELT]))
    found.append(F.transform(typos, lambda x: F.concat(F.lit("misspelling:"), x)))
    return F.array_sort(F.array_distinct(F.concat(*found)))


def is_prose(tokens: Column) -> Column:
    """At most 30 % one-letter tokens and enough tokens of four letters (five, pro rata below twenty). [] is no prose."""
    n = F.size(tokens)
    single = F.size(F.filter(tokens, lambda x: F.length(x) == 1))
    need = F.least(F.lit(5), F.greatest(F.lit(2), F.bround(n * 5 / 20).cast("int")))
    return (n > 0) & (single / F.greatest(n, F.lit(1)) <= 0.30) & (F.size(F.filter(tokens, lambda x: F.length(x) >= 4)) >= need)


def is_prose_run(tokens: Column) -> Column:
    """The plain test: at most 30 % one-letter tokens and five of four letters or more, however short the run."""
    n = F.size(tokens)
    single = F.size(F.filter(tokens, lambda x: F.length(x) == 1))
    return (n > 0) & (single / F.greatest(n, F.lit(1)) <= 0.30) & (F.size(F.filter(tokens, lambda x: F.length(x) >= 4)) >= 5)


# lower ends of run lengths and their labels: of the pair tables, and of the check of one record against all
BANDS = ((50, "50+"), (30, "30-49"), (20, "20-29"), (16, "16-19"), (12, "12-15"), (8, "8-11"))
FOCAL_BANDS = ((30, "30-999"), (20, "20-29"), (16, "16-19"), (12, "12-15"), (8, "8-11"))


def run_band(n: Column, bands: tuple[tuple[int, str], ...] = BANDS) -> Column:
    """Length band of a shared run."""
    out = F.when(n >= bands[0][0], bands[0][1])
    for lo, name in bands[1:]:
        out = out.when(n >= lo, name)
    return out.otherwise("no match")


def author_key(c: Column) -> Column:
    """Surname and first initial of the first author; '' if there is none."""
    s = F.regexp_replace(F.lower(normalise(F.split_part(F.coalesce(c, F.lit("")), F.lit(";"), F.lit(1)))), r"[^a-z,\s'\-]", " ")
    words = F.filter(F.split(s, r"\s+"), lambda x: x != "")
    comma = s.contains(",")
    sur = F.when(comma, F.regexp_replace(F.split_part(s, F.lit(","), F.lit(1)), r"\s+", "")).otherwise(F.coalesce(F.try_element_at(words, F.lit(-1)), F.lit("")))
    rest = F.when(comma, F.regexp_replace(s, "^[^,]*,", "")).otherwise(F.array_join(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), " "))
    return F.when(sur != "", F.concat(sur, F.lit("|"), F.substring(F.trim(rest), 1, 1))).otherwise("")


def surname_of(c: Column) -> Column:
    first = F.trim(F.split_part(F.coalesce(c, F.lit("")), F.lit(";"), F.lit(1)))
    last = F.coalesce(F.try_element_at(F.filter(F.split(first, r"\s+"), lambda x: x != ""), F.lit(-1)), F.lit(""))
    return F.regexp_replace(F.when(first.contains(","), F.trim(F.split_part(first, F.lit(","), F.lit(1)))).otherwise(last), "[^A-Za-z'’-]", "")


def landing_url(id_: Column, landing: Column, pdf_url: Column) -> Column:
    """A page of the record: from its archive id, else from its file's URL, else what is stored."""
    rx = r"^oai:([^:]+):(\d+)$"
    host, num = F.regexp_extract(id_, rx, 1), F.regexp_extract(id_, rx, 2)
    rec = F.regexp_extract(pdf_url, r"^(https?://[^/]+/id/eprint/\d+)/", 1)
    return F.coalesce(F.when(host != "", F.concat(F.lit("https://"), host, F.lit("/id/eprint/"), num, F.lit("/"))), F.when(rec != "", F.concat(rec, F.lit("/"))), F.nullif(landing, F.lit("")), F.nullif(pdf_url, F.lit("")), F.lit(""))


def landing_of_search(id_: Column, landing: Column, pdf_url: Column) -> Column:
    """As ``landing_url`` without the guess from the file's URL: the archive id, else what is stored."""
    rx = r"^oai:([^:]+):(\d+)$"
    host, num = F.regexp_extract(id_, rx, 1), F.regexp_extract(id_, rx, 2)
    return F.coalesce(F.when(host != "", F.concat(F.lit("https://"), host, F.lit("/id/eprint/"), num, F.lit("/"))), F.nullif(F.trim(landing), F.lit("")), F.nullif(F.trim(pdf_url), F.lit("")), F.lit(""))


def landing_of_release(repo: Column, id_: Column, templates: dict[str, str]) -> Column:
    """A page from a repository's template, with {n} for the archive number; '' where either is missing."""
    n, out = archive_number(id_), F.lit(None).cast("string")
    for name, t in templates.items():
        out = F.when(repo == name, F.replace(F.lit(t), F.lit("{n}"), n)).otherwise(out)
    return F.when((n != "") & out.isNotNull(), out).otherwise("")


def work_key(doi: Column, surname: Column, year: Column, title: Column) -> Column:
    joined = F.concat_ws("|", F.coalesce(surname, F.lit("")), F.coalesce(year.cast("string"), F.lit("")), F.lower(F.substring(F.coalesce(title, F.lit("")), 1, 80)))
    return F.when(F.coalesce(doi, F.lit("")) != "", doi).otherwise(joined)


def clip(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.rtrim(F.substring(c, 1, n - 1)), F.lit("…"))).otherwise(c)


def snippet(c: Column, words: int = 38) -> Column:
    parts = F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda x: x != "")
    return F.concat(F.array_join(F.slice(parts, 1, words), " "), F.when(F.size(parts) > words, F.lit(" …")).otherwise(""))


def chunks(c: Column, size: int = 140, overlap: int = 30, most: int = 6) -> Column:
    """Overlapping word windows, at most ``most``; [] for a text without words."""
    words = F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda x: x != "")
    starts = F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0)), F.lit(size - overlap))
    out = F.transform(F.slice(starts, 1, most), lambda i: F.array_join(F.slice(words, i + 1, size), " "))
    return F.when(F.size(words) > 0, out).otherwise(F.array().cast("array<string>"))


def title_tokens(c: Column) -> Column:
    """Set of title words without accents, function words and single letters."""
    low = F.lower(F.translate(F.coalesce(c, F.lit("")), P.ACCENTS_FROM, P.ACCENTS_TO))
    words = F.split(F.regexp_replace(low, "[^a-z0-9_]+", " "), " ")
    return F.array_distinct(F.filter(words, lambda x: (F.length(x) > 1) & ~x.isin(*P.TITLE_STOP)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 0.0 if either is empty."""
    inter, union = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), inter / F.greatest(union, F.lit(1))).otherwise(F.lit(0.0))


def candidate_score(title: Column, surname: Column, year: Column, cand: Column) -> tuple[Column, Column]:
    """(score, surname hit) of a candidate struct (title, year, authors) for a cited work."""
    gap = F.abs(cand["year"] - year)
    bonus = F.when(gap == 0, 0.12).when(gap == 1, 0.05).when(gap > 3, -0.10).otherwise(0.0)
    fold = lambda c: F.trim(F.regexp_replace(F.lower(F.translate(F.coalesce(c, F.lit("")), P.ACCENTS_FROM, P.ACCENTS_TO)), "[^a-z0-9_]+", " "))
    sur = fold(surname)
    hit = F.coalesce((sur != "") & F.exists(F.slice(cand["authors"], 1, 12), lambda a: fold(a).contains(sur)), F.lit(False))
    s = jaccard(title_tokens(title), title_tokens(cand["title"])) + F.coalesce(bonus, F.lit(0.0)) + F.when(hit, 0.18).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), s)), hit


def candidate_verdict(score: Column, hit: Column) -> Column:
    return F.when(score < 0.45, "reject").when((score >= 0.72) & hit, "accept").otherwise("ambiguous")


def doctoral(title: Column, descr: Column, types: Column) -> Column:
    text = F.concat_ws(" ", title, descr, types)
    return F.coalesce(text.rlike(P.DOCTORAL) | (~text.rlike(P.MASTERS) & F.lower(types).contains("thesis")), F.lit(False))


def education(title: Column, descr: Column) -> Column:
    return F.coalesce(F.concat_ws(" ", title, descr).rlike(P.EDUCATION), F.lit(False))
