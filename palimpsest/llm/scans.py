"""Text from scanned pages: finding and repairing what the scan broke.

The lexicon is counted over all distinct rows (words of at least ``max(least, share * all words)``
uses, a bounded number).  Where it is known which records were scanned, a word must also be used
elsewhere: one that stands in scans more than ``APART`` times as often as in other text is taken
for noise, however large the corpus.  A row is de-lined to one stream and decoded: a Viterbi search over the stream
spells every stretch around an unknown word with lexicon words, at a price for

* a break inside a word (line-end hyphen, soft hyphen, blank, blanks between all letters),
* a missing blank between words,
* a confusion of characters (``CONFUSIONS``), a stray mark,
* a word the lexicon does not have, as read or healed in the same ways.

Patterns only choose the stretches; a row is noisy if the best reading differs from the text as it stands.

A word is *unknown* if it is not in the lexicon, or if a confusion leads to a word used ``RATIO``
times as often, so frequent misreadings are not learned as words.  The method says nothing of page furniture: it (running heads,
chapter lines, page numbers in their usual dress) is taken out first, by its form and, for the running
head, by the beginning of the record's title; references by the author ("p. 61", "[112]",
"see Chapter 5") stay.

The repaired rows of a record become paragraphs by dynamic programming over sentence
boundaries: a break costs less where heading, bucket or page changes, and a paragraph pays for
being far from the usual length.

Null and empty text is clean and repairs to itself; repeated rows are decided alike; empty
tables give empty results.
"""

from __future__ import annotations

import bisect
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from palimpsest.plans.runtime import cut, widen

LEAST, SHARE, RATIO, MIN_BASE, APART = 3, 1e-6, 20, 10, 5
# fixed values: what a scan makes of characters (read -> meant)
CONFUSIONS = {
    "f": ["t"], "c": ["e"], "b": ["h"], "!": ["i", "l"], "1": ["l", "i"], "0": ["o"], "5": ["s"], "9": ["g"], "8": ["b"], "6": ["b"], "ɑ": ["a"], "|": ["l", "i"], "$": ["s"], "q": ["g"],
    "ri": ["n"], "ii": ["u"], "rn": ["m"], "cl": ["d"], "h": ["li"], "vv": ["w"], "!i": ["u"], "i!": ["u"], "!!": ["u"], "m": ["rn", "in"], "d": ["cl"], "u": ["ii"], "t": ["f"], "e": ["c"], "li": ["h"], "r!": ["n"],
}
SOFT = "­¬‐"  # hyphens only a scan leaves
HEAD = 20  # letters a running head shares with the beginning of the title; all of a shorter title, if it has two words
WORD_COST, CONFUSION, BROKEN, SPACED, MERGED, UNKNOWN, LETTER = 0.25, 3.0, 0.7, 3.5, 3.5, 9.0, 0.8
KEEP, SUSPECT = 4.0, 4.0  # leaving a mark only a scan makes, and a word that is far likelier another one misread
MOST_WRONG, FRAGMENT = 2, 4  # confusions within one word; letters of a fragment that fell off a name

_ROMAN = r"(?=[ivxlc1])(?:x{0,3}(?:[i1!]x|[i1!]v|v?[i1!]{0,3}))"
_LABEL = rf"(?:\d{{1,4}}|{_ROMAN}|[0-9!lioO]{{1,3}})"
_NUMBER_ROW = re.compile(rf"^\W*(?:page\s+|pagc\s+|p\.\s*|\[p\.\s*)?{_LABEL}\W*$", re.I)
_DRESSED = re.compile(rf"\[[pq]\.?\s*{_LABEL}\]|(?<![\w(])[-–—]\s{_LABEL}\s[-–—](?!\w)|\|\s*{_LABEL}\b|\b(?-i:P[aɑ]g[ec]|PAGE)\s+{_LABEL}(?![\w)])", re.I)
_LINE_LABEL = re.compile(rf"\n\s*{_LABEL}\s*(?:\n|$)", re.I)
_CHAPTER = re.compile(r"(?<!see )(?<!in )(?<!See )(?<!In )\bC[h][aɑ]p[tf][ec]r\s+[\dlOo!]+\s*:?\s+[A-Z][\w!ɑ]+|\bCHAPTER\s+[\dlOI!]+\b", 0)
_CAPITALS = re.compile(r"(?:\b[A-Z][A-Z0-9!'-]{1,}\b[\s:,]*){3,}")
_BROKEN = re.compile(rf"[^\W\d_]\s?[{SOFT}]\s*[^\W\d_]|[{SOFT}]|[^\W\d_]-\n\s*[a-z]|[a-z]\s-\n\s*[a-z]|[^\W\d_]-[ ]+(?!and\b|or\b|to\b|nor\b)[a-z]|[a-z] -[ ]?\n?[a-z]")
_MIXED = re.compile(r"[^\W\d_][0-9!$|][^\W\d_]|\b[0-9!][a-z]{2,}|[^\W\d_]{2,}[0-9!](?=\s|[^\w]|$)|ɑ|[a-z]{2,}[!|][a-z]*|(?<!\w)[!|](?!\w)|[a-z]+[0-9]\b")
_ORDINAL = re.compile(r"^\d+(?:st|nd|rd|th|s|a|b|mm|cm|km|m|kg|g|ms)$")
_SPACED = re.compile(r"(?<![\w.])(?:[^\W\d_] ){3,}[^\W\d_](?![\w.])")
_STRAY = re.compile(r"(?<=\s)[|*•·~^_`´¦§°=<>\\{}#@+%]+(?=\s|$)|^[|*•·~^_`´¦§°=<>\\{}#@]+\s")


_GAP = re.compile(rf"\s?[-{SOFT}]\s*|\s+")
_HYPHEN = re.compile(rf"[-{SOFT}]")
_LETTERS = re.compile(r"[^\W\d_]+")
_JOINT = re.compile(rf"\s?[{SOFT}]\s*|-\s+|\s-\s*")  # a break no author writes inside a word
_PULLED = re.compile(r"(?:[^\W\d_] ){3,}[^\W\d_](?![^\W\d_])")
_FOREIGN = re.compile(rf"[!|$ɑ](?=[^\W\d_])|(?<=[^\W\d_])[!|$ɑ]|(?<=[^\W\d_])\d(?=[^\W\d_])|[{SOFT}]")
_LONE = re.compile(r"[|*•·~^_`´¦§°=<>\\{}#@+%]+(?=\s|$)")


def _lower(s: str) -> str:
    return s.lower() if len(s.lower()) == len(s) else "".join(c.lower() if len(c.lower()) == 1 else c for c in s)


class Decoder:
    """Viterbi over a stretch of text with a lexicon trie; words outside the lexicon are spelled letter by letter at a price."""

    def __init__(self, counts: dict[str, int]):
        self.counts, self.total = counts, max(1, sum(counts.values()))
        self.trie: dict = {}
        for w, n in counts.items():
            node = self.trie
            for c in w:
                node = node.setdefault(c, {})
            node["$"] = WORD_COST * -math.log(n / self.total)
        self.memo: dict[str, tuple[str, bool]] = {}
        self.base_memo: dict[str, str] = {}

    def spellings(self, s: str, i: int):
        """(end, word, cost, changed) of lexicon words read from s at i; blanks inside cost SPACED, hyphen breaks BROKEN."""
        out, todo = [], [(i, self.trie, "", 0.0, 0, 0, False)]
        while todo:
            j, node, word, cost, wrong, gaps, changed = todo.pop()
            if "$" in node:
                out.append((j, word, cost + node["$"], changed))
            if j >= len(s):
                continue
            c = s[j]
            if c in node:
                todo.append((j + 1, node[c], word + c, cost, wrong, gaps, changed))
            if word and not c.isalnum() and (m := _GAP.match(s, j)) and m.end() < len(s):
                price = BROKEN if _HYPHEN.search(m.group()) else SPACED / (1 + gaps)
                todo.append((m.end(), node, word, cost + price, wrong, gaps + 1, True))
            if wrong < MOST_WRONG:
                for read in (s[j : j + 2], c):
                    for meant in CONFUSIONS.get(read, ()):
                        n = node
                        for m in meant:
                            n = n.get(m)
                            if n is None:
                                break
                        if n is not None and len(read) + j <= len(s):
                            todo.append((j + len(read), n, word + meant, cost + CONFUSION, wrong + 1, gaps, True))
        return out

    def strangers(self, s: str, low: str, i: int):
        """(end, word, cost, changed) of words the lexicon does not have: as read, healed over breaks, letters drawn together, marks replaced, or a fragment joined to a name."""
        j = i
        while j < len(s) and not s[j].isspace():
            j += 1
        marks = len(_FOREIGN.findall(s[i:j]))
        out = [(j, low[i:j], UNKNOWN + LETTER * (j - i) + KEEP * marks, False)]
        if marks:
            healed, k = _FOREIGN.subn(lambda m: CONFUSIONS.get(m.group(), [""])[0], low[i:j])
            out.append((j, healed, UNKNOWN + LETTER * len(healed) + CONFUSION * k, True))
        if m := _PULLED.match(s, i):
            word = low[i : m.end()].replace(" ", "")
            out.append((m.end(), word, UNKNOWN + LETTER * len(word) + SPACED, True))
        if m := _LETTERS.match(s, i):
            word, breaks, e = low[i : m.end()], 0, m.end()
            while (gap := _JOINT.match(s, e)) and (part := _LETTERS.match(s, gap.end())) and part.group()[0].islower():
                word, breaks, e = word + low[part.start() : part.end()], breaks + 1, part.end()
                out.append((e, word, UNKNOWN + LETTER * len(word) + BROKEN * breaks, True))
            e = m.end()
            if s[i].isupper() and s[e : e + 1] == " " and (part := _LETTERS.match(s, e + 1)) and part.end() - part.start() <= FRAGMENT and part.group().islower() and low[i:e] not in self.counts and part.group() not in self.counts:
                out.append((part.end(), low[i:e] + part.group(), UNKNOWN + LETTER * (part.end() - i - 1) + SPACED, True))
        return out

    def decode(self, s: str) -> tuple[str, bool]:
        """Best reading of a stretch in lower case, and whether it differs from the plain one."""
        if s in self.memo:
            return self.memo[s]
        n, low = len(s), _lower(s)
        best: list = [None] * (n + 1)
        best[0] = (0.0, "", False)
        for i in range(n):
            if best[i] is None:
                continue
            cost, text, changed = best[i]

            def offer(j, c, t, ch):
                if best[j] is None or c < best[j][0]:
                    best[j] = (c, t, ch)

            if not s[i].isalnum() and s[i] not in "!|ɑ$":
                offer(i + 1, cost, text + s[i], changed)
                if (i == 0 or s[i - 1].isspace()) and (m := _LONE.match(s, i)):
                    best[i + 1] = (cost + KEEP, text + s[i], changed)
                    offer(m.end(), cost + BROKEN, text.rstrip(), True)
                continue
            if s[i] in "!|" and (i == 0 or s[i - 1].isspace()) and (m := _LONE.match(s, i)):
                offer(m.end(), cost + BROKEN, text.rstrip(), True)
            glued = i > 0 and (s[i - 1].isalnum() or s[i - 1] in "!|ɑ")
            for j, w, c, ch in self.spellings(low, i):
                if len(w) == 1 and w not in "ai" and j < n and s[j].isalnum():
                    continue
                if not ch and self.misread(w):
                    c += SUSPECT
                offer(j, cost + c + (MERGED if glued else 0), text + (" " if glued else "") + w, changed or ch or glued)
            if not glued:
                for j, w, c, ch in self.strangers(s, low, i):
                    offer(j, cost + c, text + w, changed or ch)
        out = (best[n][1], best[n][2]) if best[n] else (low, False)
        self.memo[s] = out
        return out

    def misread(self, w: str) -> str:
        """The far more frequent word that w is a confusion of, or ''."""
        if w not in self.base_memo:
            n, top = self.counts.get(w, 0), ""
            for j, word, _, changed in self.spellings(w, 0):
                if j == len(w) and changed and word != w and self.counts[word] >= max(MIN_BASE, RATIO * n) and (not top or self.counts[word] > self.counts[top]):
                    top = word
            self.base_memo[w] = top
        return self.base_memo[w]

    def unknown(self, w: str) -> bool:
        return w not in self.counts or bool(self.misread(w))


def head_of(title: str | None) -> str:
    """The letters that tell a running head, in lower case; '' for a title too short to tell anything."""
    t = re.sub(r"\s+", " ", title or "").strip()
    return _lower(t)[:HEAD] if len(t) >= HEAD or " " in t and len(t) >= HEAD // 2 else ""


def furniture(text: str, title: str | None) -> list[tuple[int, int]]:
    """Places of running heads, chapter lines and page numbers in a row."""
    if _NUMBER_ROW.match(text) and re.search(r"\w", text):
        return [(0, len(text))]
    spots = [m.span() for r in (_DRESSED, _CHAPTER, _LINE_LABEL, _CAPITALS) for m in r.finditer(text)]
    if head := head_of(title):
        flat, low = _lower(text).replace("\n", " "), _lower(re.sub(r"\s+", " ", title).strip())
        k = flat.find(head)
        while k >= 0:
            e = k + len(head)
            while e < len(flat) and e - k < len(low) and flat[e] == low[e - k]:
                e += 1
            if text[k].isupper():
                spots.append((k, e))
            k = flat.find(head, k + 1)
    if not spots:
        return []
    spots.sort()
    merged = [list(spots[0])]
    for a, b in spots[1:]:
        if a <= merged[-1][1] + 3:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    out = []
    for a, b in merged:  # a label right after or before the head belongs to it
        m = re.match(rf"\s*[|\-–—]?\s*{_LABEL}(?=\s|$)", text[b:], re.I)
        out.append((a, b + (m.end() if m and m.end() else 0)))
    return out


def _names(text: str) -> set[str]:
    """Capitalised words that stand where a name stands."""
    return set(re.findall(r"\b([A-Z][^\W\d_'-]*(?:['-][A-Z]?[^\W\d_]+)*)(?=\s*(?:\(\d{4}|,\s*(?:\d{4}|[A-Z]\.)|,\s))", text)) | set(re.findall(r"(?:Following|after|by|and)\s+([A-Z][^\W\d_]+)", text))


# one cheap look decides that most rows need no decoding
_SUSPECT = re.compile(rf"[|!ɑ$@#*^_~•·<>=\\{{}}{SOFT}]|\[p|[^\W\d_]-\s|\s-|Pag|PAG|Ch[aɑ]p|[A-Z]{{2}}|[^\W\d_]\d|\d[^\W\d_]|\n\s*\S{{1,5}}\s*(?:\n|$)|(?<![\w.'])[b-z] [a-z] ", 0)
_WORDS = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_MARKS = {"p", "pp", "s"}  # of references and genitives


def plain(text: str, title: str | None, dec: Decoder, fine: dict[str, bool]) -> bool:
    """True if nothing in a row calls for decoding; ``fine`` remembers the words looked up."""
    if len(text) < 40 or _SUSPECT.search(text) or (title and (head := head_of(title)) and head in _lower(text)):
        return False
    for w in _WORDS.findall(text):
        ok = fine.get(w)
        if ok is None:
            low = w.lower()
            name = w[0].isupper() and (len(w) == 1 or (low not in dec.counts and w[1:].islower()))
            ok = fine[w] = low in _MARKS or (low in dec.counts or name) and not (len(w) > 1 and dec.misread(low))
        if not ok:
            return False
    return True


_TOKEN = re.compile(r"[^\W\d_]*[\d!ɑ|]+[^\W_!|]*[^\W\d_][^\W_]*|[^\W\d_]+\d+(?!\w)|[^\W\d_]+(?:['][^\W\d_]+)?")
_BETWEEN = re.compile(rf"[\s\-{SOFT}|*•·~^_`´¦§°=<>\\{{}}#@+%]*")
_REFERENCE = re.compile(r"\[\d+(?:[,–-]\s*\d+)*\]|\(pp?\.\s*\d+(?:[–-]\d+)?\)")


def doubtful(text: str, dec: Decoder) -> list[tuple[int, int]]:
    """Stretches to decode: places around unknown words and unusual marks, with a word on either side."""
    body = _REFERENCE.sub(lambda m: " " * len(m.group()), text)
    names = _names(body)
    tokens = [(m.group(), m.start(), m.end()) for m in _TOKEN.finditer(text)]
    spots = [m.span() for r in (_BROKEN, _SPACED, _STRAY) for m in r.finditer(body)] + [m.span() for m in _MIXED.finditer(body) if not _ORDINAL.match(m.group())]
    for w, a, b in tokens:
        low = w.lower()
        if w in names or (len(w) == 1 and (not w.islower() or w in "ai")) or low in _MARKS:
            continue
        if not (w[0].isupper() and w[1:].islower() and low not in dec.counts and not dec.misread(low)) and dec.unknown(low):
            spots.append((a, b))
    starts, out = [a for _, a, _ in tokens], []
    for a, b in sorted(spots):
        i = max(0, bisect.bisect_right(starts, a) - 1)
        j = max(i, bisect.bisect_left(starts, b) - 1)
        if i and _BETWEEN.fullmatch(text, tokens[i - 1][2], tokens[i][1]):
            i -= 1
        if j + 1 < len(tokens) and _BETWEEN.fullmatch(text, tokens[j][2], tokens[j + 1][1]):
            j += 1
        a, b = (min(a, tokens[i][1]), max(b, tokens[j][2])) if tokens else (a, b)
        while b < len(text) and not text[b].isspace() and text[b].isalnum():
            b += 1
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def read_row(text: str, title: str | None, dec: Decoder) -> tuple[str, list[str]]:
    """(repaired text, what was found) of one row."""
    found: list[str] = []
    spots = furniture(text, title)
    if spots:
        found.append("furniture")
        for a, b in reversed(spots):
            text = text[:a].rstrip() + " " + text[b:].lstrip()
        if not re.search(r"[^\W\d_]", text):
            return "", found
    out, last = [], 0
    for a, b in doubtful(text, dec):
        fixed, changed = dec.decode(text[a:b])
        if changed:
            found.append("decoded")
            out.append(text[last:a] + (fixed[:1].upper() + fixed[1:] if text[a].isupper() else fixed))
            last = b
    return re.sub(r"\s+", " ", "".join(out) + text[last:]).strip(), found


def lexicon(sentences: DataFrame, least: int = LEAST, share: float = SHARE) -> dict[str, int]:
    """Counts of the words used at least max(least, share * all words) times: at most 1 / share of them.

    With a column ``scanned`` the rate of a word in scanned rows may be at most APART times its rate in the others, so
    what only scans contain never becomes a word; where either kind is missing there is nothing to compare.
    """
    scanned = F.col("scanned") if "scanned" in sentences.columns else F.lit(False)
    words = sentences.where(F.col("text").isNotNull()).select(scanned.alias("scanned"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)[\p{L}]+(?:'[\p{L}]+)?"), 0)).alias("w"))
    counts = cut(words.groupBy("w").agg(F.count("*").alias("n"), F.count_if("scanned").alias("scans")), "words")
    total, scans = (x or 0 for x in counts.agg(F.sum("n"), F.sum("scans")).first())
    rows = counts.where((F.col("n") >= max(least, share * total)) & ((F.length("w") > 1) | F.col("w").isin("a", "i")))
    if 0 < scans < total:
        rows = rows.where(F.col("scans") / float(scans) <= APART * (F.col("n") - F.col("scans")) / float(total - scans))
    rows = rows.select("w", "n").toPandas()
    return dict(zip(rows["w"], rows["n"].astype(int)))


def repair(sentences: DataFrame, titles: DataFrame) -> DataFrame:
    """(doc_id, idx, text, repaired, found, page, bucket, heading) of every distinct row; ``titles`` is (doc_id, title) and may have ``scanned``."""
    rows = sentences.select("doc_id", "idx", "text", "page", "bucket", "heading").distinct()
    known = [F.max("scanned").alias("scanned")] if "scanned" in titles.columns else []
    titled = rows.join(titles.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("title").alias("title"), *known), "doc_id", "left")
    if known:
        titled = titled.withColumn("scanned", F.coalesce("scanned", F.lit(True)))
    titled = cut(titled, "titled")
    counts = lexicon(titled)
    titled = widen(titled.drop("scanned"))
    sent = sentences.sparkSession.sparkContext.broadcast(counts)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        dec, fine = Decoder(sent.value), {}
        for pdf in batches:
            got = [(t and t.replace("\n", " "), []) if not t or plain(t, h, dec, fine) else read_row(t, h, dec) for t, h in zip(pdf["text"], pdf["title"])]
            pdf = pdf.drop(columns=["title"])
            pdf["repaired"], pdf["found"] = [g[0] for g in got], [sorted(set(g[1])) for g in got]
            yield pdf[["doc_id", "idx", "text", "repaired", "found", "page", "bucket", "heading"]]
            if len(dec.memo) + len(fine) > 1_000_000:
                dec.memo.clear(), fine.clear()

    return titled.mapInPandas(each, "doc_id string, idx int, text string, repaired string, found array<string>, page int, bucket string, heading string")


# ---- paragraphs

USUAL, BREAK = 90, 6.0


class Breaks:
    """Least sum of break prices and squared deviations from the usual length (in words), sentence by sentence.

    A start is given up only when the paragraph from it holds a place whose break would save more than it costs; longer
    paragraphs hold that place too, so nothing is lost.  A break is final once all starts still open agree on it.
    """

    def __init__(self, usual: int = USUAL):
        self.usual, self.n, self.words = usual, 0, 0.0
        self.first, self.done = 0, 0  # the first open start; sentences before ``done`` have been handed out
        self.at: list[tuple[float, float, bool]] = []  # of each open start: words before it, price of a break there, whether it is hard
        self.best: list[float] = []
        self.back: dict[int, int] = {0: 0}
        self.pending = 0.0

    def add(self, words: float, change: float) -> None:
        """One more sentence; ``change`` of 1 is a break that must be."""
        self.at.append((self.words, BREAK * (1 - min(max(change, 0), 1)) if self.n else 0.0, change >= 1 and self.n > 0))
        self.best.append(self.pending)
        if change >= 1 and self.n:  # no paragraph runs across
            self._drop(self.n)
        self.n, self.words = self.n + 1, self.words + words
        before = np.array([x[0] for x in self.at])
        size = (self.words - before) / self.usual
        cost = np.array(self.best) + 4 * (size - 1) ** 2 + np.array([x[1] for x in self.at])
        k = int(cost.argmin())
        self.pending, self.back[self.n] = float(cost[k]), self.first + k
        left = before[None, :] - before[:, None]  # words from a start to a later one
        saves = (left / self.usual * size[None, :] > 0.5 + BREAK / 8).any(axis=1)
        if saves.any():
            self._drop(self.first + int(np.flatnonzero(saves)[-1]) + 1)

    def _drop(self, to: int) -> None:
        self.at, self.best, self.first = self.at[to - self.first :], self.best[to - self.first :], to

    def settled(self, end: bool = False) -> list[int]:
        """Ends of the paragraphs that are certain and have not been told; all of them at the end."""
        paths = []
        for j in [self.n] if end else [*range(self.first, self.n + 1)]:
            ends = []
            while j > self.done:
                ends.append(j)
                j = self.back[j]
            paths.append(ends[::-1])
        same = 0
        while all(len(p) > same for p in paths) and len({p[same] for p in paths}) == 1:
            same += 1
        out = paths[0][:same]
        if out:
            self.done = out[-1]
            self.back = {j: i for j, i in self.back.items() if j >= self.done}
        return out


def best_breaks(words: np.ndarray, change: np.ndarray, usual: int = USUAL) -> np.ndarray:
    """Paragraph number of each sentence."""
    b = Breaks(usual)
    for w, c in zip(words, change):
        b.add(float(w), float(c))
    out = np.zeros(len(words), "int64")
    for e in b.settled(end=True) if len(words) else []:
        out[e:] += 1
    return out


def paragraphs(repaired: DataFrame) -> DataFrame:
    """(doc_id, paragraph, first_idx, last_idx, text) of the repaired rows; records go by in order and are never held as a whole."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        doc, b, held, number, last = None, Breaks(), [], 0, None
        out: list[tuple] = []

        def hand(end: bool) -> None:
            nonlocal held, number
            begin = b.done
            for e in b.settled(end):
                part, held = held[: e - begin], held[e - begin :]
                out.append((doc, str(number), part[0][0], part[-1][0], " ".join(x[1] for x in part)))
                number, begin = number + 1, e

        for pdf in batches:
            for d, idx, text, page, bucket, heading in zip(*(pdf[c].astype(object).where(pdf[c].notna(), None) for c in ("doc_id", "idx", "repaired", "page", "bucket", "heading"))):
                if d != doc:
                    if held:
                        hand(True)
                    doc, b, held, number, last = d, Breaks(), [], 0, None
                now = (heading or "", bucket or "", page)
                new = last is None or (now[0] != last[0] and now[0] != "") or now[1] != last[1]
                b.add(len(text.split()), 1.0 if new else 0.3 if page is None or page != last[2] else 0.0)
                last = now
                held.append((idx, text))
                if len(held) % 256 == 0:
                    hand(False)
            if out:
                yield pd.DataFrame(out, columns=["doc_id", "paragraph", "first_idx", "last_idx", "text"])
                out.clear()
        if held:
            hand(True)
            yield pd.DataFrame(out, columns=["doc_id", "paragraph", "first_idx", "last_idx", "text"])

    rows = repaired.where(F.coalesce("repaired", F.lit("")) != "").select("doc_id", "idx", "repaired", "page", "bucket", "heading")
    ordered = rows.repartition("doc_id").sortWithinPartitions("doc_id", "idx", "repaired")
    return ordered.mapInPandas(each, "doc_id string, paragraph string, first_idx int, last_idx int, text string")
