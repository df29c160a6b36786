"""Template residue and site messages: positive-unlabelled naive Bayes by EM over passages.

A record is cut into passages (lines and sentences).  A few shapes are trusted: unfilled slots
with little else around them, status codes with their standard phrase, page mark-up, filler text, and
the commonest short site messages.  Passages of these shapes are the labelled positives; all others are
unlabelled.  They only train: every decision is by log-odds, also that on a trusted passage.

Features are words, pairs of neighbouring words, the shapes of slots, the length of the passage and
the size of its record, hashed to a fixed number of buckets, so the model is one array of fixed size however
large the corpus.  A bucket counts by its share of positives, shrunk to the overall share by a
pseudo-count in proportion to the corpus (``STRENGTH``): what is rare says little, so a message in new words
is found by the words it shares with known ones, and what is frequent and never positive counts against
it, which keeps sentences *about* errors or templates out.  A single feature counts ``CLIP`` at most either way.

EM starts with the unlabelled as negative, then scores them and counts those above ``SURE`` with ``UNLABELLED``
times their posterior; small posteriors of frequent furniture (menus, item captions) would otherwise pull it over.

A record's score is the highest log-odds of its passages; it is excluded above zero.

Every pass runs over all passages; counts are summed in each partition before the shuffle.
Null and empty texts have no passage and are kept; repeated texts get the same score; an
empty table gives an empty result.  Without any trusted passage nothing is excluded.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from http import HTTPStatus

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from palimpsest.plans.runtime import cut, widen

BUCKETS, ROUNDS, STRENGTH, MIN_PRIOR, CLIP, UNLABELLED, SURE = 1 << 18, 4, 1e-3, 1e-4, 4.0, 0.1, 0.95

_SPLIT = re.compile(r"(?<=[.!?…])\s+|\n+")
# shapes of unfilled slots, each a feature of its own
SLOTS = {
    "braces": r"\{\{[^{}]*\}\}|\{%[^{}]*%\}", "angle": r"<<[^<>]*>>|<%[^<>]*%>|<[A-Za-z]+:[^<>]*/>|<(?:insert|enter|type|your|name|title|date|add)\b[^<>]*>", "dollar": r"\$\{[^{}]*\}|\$[A-Za-z_]+\$",
    "guillemets": r"«\w+»", "capitals": r"\[[A-Z][A-Z_]{3,}\]", "percent": r"%%\w+%%|%\([a-z_]+\)s", "at": r"@@\w+@@", "hash": r"#[A-Za-z_]{3,}#", "under": r"__[A-Za-z_]+?__(?!_)", "bracket": r"\[(?:insert|enter|type|your|name|title|date|add|todo|tbc|citation|placeholder)\b[^\]]*\]",
    "blank": r"_{4,}|…{3,}|\.{6,}", "void": r"\[object Object\]|#REF!|\bNaN\b|\bundefined\b|\bnull\b|#N/A|\bN/A\b|(?<=[:=(] )None\b|(?<=[=(])None\b|0000-00-00|\b1970-01-01\b", "tag": r"</?(?:html|head|body|title|noscript|script|div|p|a|h1)\b[^>]*>", "xxxx": r"\bX{4,}\b|\bTBC\b|\bTODO\b|\bTBA\b",
}
_SLOT = {k: re.compile(v) for k, v in SLOTS.items()}
# fixed values: short messages trusted wherever they stand nearly alone, and wording of filler and of form fields
MESSAGES = ["page not found", "access denied", "enable javascript", "something went wrong", "session has expired", "try again later", "verify you are human", "temporarily unavailable", "could not be loaded", "cannot be displayed"]
FILLER = ["lorem ipsum", "dummy text", "sample text", "placeholder text", "test record", "goes here", "click or tap here", "type your"]
# fixed values: the usual Latin filler
LOREM = """lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua ut enim ad minim veniam quis nostrud exercitation ullamco laboris
nisi ut aliquip ex ea commodo consequat duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt in
culpa qui officia deserunt mollit anim id est laborum"""
LATIN = {w[:4] for w in LOREM.split() if len(w) >= 4}
ALONE, AROUND = 13, 7  # words of a trusted message, and words around a slot

_STATUS = re.compile("|".join(rf"\b{s.value}\b\W+{re.escape(s.phrase.lower())}" for s in HTTPStatus if s.value >= 400))
_MARKUP = re.compile(r"\s*<(?:html|head|body|noscript|script|title)\b", re.I)
_TRACE = re.compile(r"\bin /\S+ on line \d+")
_SHORT = re.compile("|".join(rf"\b{p}\b" for p in MESSAGES + FILLER))
_KEYBOARD = re.compile("asdf|qwer|zxcv|hjkl")
_WORD = re.compile(r"[^\W\d_]+")
# a slot needs one of these; most passages have none and are done
_HINT_MARKS = re.compile(r"[{}<>$%@#_\[\]«»…]")
_HINT_WORDS = ("null", "undefined", "NaN", "None", "N/A", "XXXX", "TBC", "TODO", "TBA", "0000-00-00", "1970-01-01", "......")


def _hint(passage: str) -> bool:
    return _HINT_MARKS.search(passage) is not None or any(w in passage for w in _HINT_WORDS)


def passages(text: str) -> list[str]:
    return [p for p in (s.strip() for s in _SPLIT.split(text)) if p]


def trusted(passage: str) -> bool:
    """A passage of one of the trusted shapes."""
    low = passage.lower()
    words = _WORD.findall(low)
    if len(words) >= 5:
        some = set(words)
        if len(some) <= len(words) / 3 and len(words) >= 6:  # the same few words over and over
            return True
        if len([w for w in words if w[:4] in LATIN]) >= 0.5 * len(words):
            return True
    if len(words) <= ALONE and (_STATUS.search(low) or _SHORT.search(low) or _KEYBOARD.search(low)) or len(words) <= 2 * ALONE and " on line " in low and _TRACE.search(low):
        return True
    if not _hint(passage):
        return False
    if _MARKUP.match(passage):
        return True
    slots, rest = 0, passage
    for k, r in _SLOT.items():
        slots += 0 if k == "tag" else len(r.findall(passage))
        rest = r.sub(" ", rest)
    return slots > 0 and len(_WORD.findall(rest)) <= AROUND * slots


_DIGIT = re.compile(r"\d")
_TOKEN = re.compile(r"\x01[a-z]+|[^\W\d_]+|\d+")


def _hash(words: list[str]) -> np.ndarray:
    return np.fromiter((zlib.crc32(w.encode()) for w in words), "uint64", len(words))


def features(ps: list[str], record: np.ndarray) -> list[np.ndarray]:
    """Distinct feature buckets of each passage; ``record`` is the number of words of its record."""
    toks: list[list[str]] = []
    for p in ps:
        found, body = [], p
        if _hint(p):
            found = [f"\x01{k}" for k, r in _SLOT.items() if r.search(p)]
            for k, r in _SLOT.items():
                body = r.sub(f" \x01{k} ", body)
        w = _TOKEN.findall(body.lower())
        if _DIGIT.search(body):
            w = ["\x020" if x.isdigit() and len(x) != 3 else x for x in w]
        toks.append(w + found)
    # all passages at once: words between a start and an end mark, numbered by passage
    flat = [w for t in toks for w in ("\x03<", *t, "\x03>")]
    sizes = np.array([len(t) for t in toks], "int64")
    who = np.repeat(np.arange(len(toks)), sizes + 2)
    codes, uniq = pd.factorize(np.array(flat, object))
    h = _hash(list(uniq))[codes]
    mark = np.array([u.startswith("\x03") for u in uniq])[codes]
    pair = who[:-1] == who[1:]
    two = (h[:-1] * np.uint64(0x9E3779B1) + h[1:] * np.uint64(31))[pair]
    length = _hash([f"n{k}" for k in range(9)])[np.minimum(sizes, 24) // 3]
    whole = _hash([f"r{k}" for k in range(9)])[np.minimum(np.log2(record + 1).astype("int64"), 8)]
    bucket = np.concatenate([h[~mark], two, length, whole]) % np.uint64(BUCKETS)
    key = np.sort(np.concatenate([who[~mark], who[:-1][pair], np.arange(len(toks)), np.arange(len(toks))]) * BUCKETS + bucket.astype("int64"))
    key = key[np.append(True, key[1:] != key[:-1])]
    return np.split((key % BUCKETS).astype("int32"), np.searchsorted(key, np.arange(1, len(toks)) * BUCKETS))


def featurise(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, place, seed, f): one row per passage."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k in range(0, len(pdf), 500):
                part = pdf.iloc[k : k + 500]
                ps = [passages(t) for t in part["text"]]
                flat = [p for x in ps for p in x]
                if flat:
                    n = [len(x) for x in ps]
                    record = np.repeat([sum(len(p.split()) for p in x) for x in ps], n)
                    yield pd.DataFrame({"doc": np.repeat(part["doc"].to_numpy(), n), "place": np.concatenate([np.arange(k) for k in n]).astype("int32"), "seed": [trusted(p) for p in flat], "f": [f.tobytes() for f in features(flat, record)]})

    kept = docs.where(F.col(doc).isNotNull() & (F.length(F.trim(text)) > 0)).select(F.col(doc).cast("bigint").alias("doc"), F.col(text).alias("text"))
    return widen(kept).mapInPandas(each, "doc bigint, place int, seed boolean, f binary")


def _scores(pdf: pd.DataFrame, model) -> np.ndarray:
    """Log-odds of each passage."""
    ratio, prior = model
    parts = [np.frombuffer(b, "int32") for b in pdf["f"]]
    sizes = np.array([len(p) for p in parts])
    at = np.repeat(np.arange(len(parts)), sizes)
    return prior + np.bincount(at, weights=ratio[np.concatenate(parts)], minlength=len(parts)) if len(parts) else np.zeros(0)


def fit(feats: DataFrame, rounds: int = ROUNDS):
    """(log ratio per bucket, log prior odds) by EM; None without a trusted passage."""
    sc = feats.sparkSession.sparkContext
    model = None
    for _ in range(rounds):
        sent = sc.broadcast(model)

        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            pos, every = np.zeros(BUCKETS), np.zeros(BUCKETS)
            n_pos = n = 0.0
            for pdf in batches:
                seed = pdf["seed"].to_numpy().astype("float64")
                if sent.value is None:
                    w = seed
                else:
                    s = np.clip(_scores(pdf, sent.value), -30, 30)
                    post = 1 / (1 + np.exp(-s))
                    w = np.maximum(seed, np.where(post > SURE, UNLABELLED * post, 0))
                parts = [np.frombuffer(b, "int32") for b in pdf["f"]]
                if not parts:
                    continue
                ids = np.concatenate(parts)
                pos += np.bincount(ids, weights=np.repeat(w, [len(p) for p in parts]), minlength=BUCKETS)
                every += np.bincount(ids, minlength=BUCKETS)
                n_pos, n = n_pos + w.sum(), n + len(pdf)
            at = np.flatnonzero(every)
            yield pd.DataFrame({"b": np.append(at, -1), "pos": np.append(pos[at], n_pos), "every": np.append(every[at], n)})

        # at most BUCKETS + 1 rows
        got = feats.select("seed", "f").mapInPandas(count, "b int, pos double, every double").groupBy("b").agg(F.sum("pos").alias("pos"), F.sum("every").alias("every")).toPandas()
        total = got[got["b"] < 0]
        n_pos, n = (float(total["pos"].iloc[0]), float(total["every"].iloc[0])) if len(total) else (0.0, 0.0)
        if n_pos < 1:
            return None
        got = got[got["b"] >= 0]
        pos, every = np.zeros(BUCKETS), np.zeros(BUCKETS)
        pos[got["b"]], every[got["b"]] = got["pos"], got["every"]
        share = min(max(n_pos / n, MIN_PRIOR), 0.5)
        strength = max(1.0, STRENGTH * n)
        is_pos = (pos + strength * share) / (every + strength)
        odds = float(np.log(share / (1 - share)))
        model = (np.clip(np.log(is_pos / np.maximum(1 - is_pos, 1e-9)) - odds, -CLIP, CLIP), odds)
    return model


def score_passages(feats: DataFrame, model) -> DataFrame:
    """(doc, place, seed, log_odds)."""
    if model is None:
        return feats.select("doc", "place", "seed", F.lit(-30.0).alias("log_odds"))
    sent = feats.sparkSession.sparkContext.broadcast(model)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc": pdf["doc"], "place": pdf["place"], "seed": pdf["seed"], "log_odds": _scores(pdf, sent.value)})

    return feats.mapInPandas(each, "doc bigint, place int, seed boolean, log_odds double")


def residue_records(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, log_odds, place, passages): each record with a passage above zero, its best score and where."""
    feats = cut(featurise(docs, doc, text), "passages")
    scored = score_passages(feats, fit(feats))
    hit = F.col("log_odds") > 0  # trusted patterns only train
    best = scored.groupBy("doc").agg(F.max(F.struct(hit.alias("hit"), "log_odds", "place")).alias("m"), F.count_if(hit).alias("passages"))
    return best.where("m.hit").select("doc", "m.log_odds", "m.place", "passages")
