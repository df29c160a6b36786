"""Evaluation passages in a corpus: one FM-index per shard of texts, searched backwards.

Alphabet: the words of the passages, numbered from 2; 1 stands for any other word and 0 ends
the shard.  A passage window has no 1, so stretches of other words and ends of texts may shrink
to a single 1 without a change of any answer, and stretches of fewer than ``size`` passage words
cannot hold a window and shrink too.  Each shard then gets

* a suffix array (prefix doubling) and the Burrows-Wheeler transform taken from it,
* a wavelet matrix over the transform, whose bit planes answer rank queries,
* sampled suffix positions, from which an occurrence is located by last-to-first steps.

All windows of all passages are searched at once, a word at a time from the back; windows met
are located, mapped to (text, word) and merged to removal spans per (passage, text).

The passages are the bounded side (a fixed held-out set; ``max_query_words`` is checked) and go
to every task; no corpus text is shuffled or collected.  A shard holds at most ``shard_words``
symbols, or a single longer text.

Null and empty texts or passages, and passages shorter than ``size`` words, match nothing;
repeated texts are reported each by their own id; repeated passages each by their item.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, functions as F

from palimpsest.plans.runtime import widen

SIZE, SHARD_WORDS, SAMPLE, MAX_QUERY_WORDS = 13, 400_000, 8, 2_000_000
_WORD = regex.compile(r"[\p{L}\p{Nd}\p{Nl}\p{No}]+")


def words(text: str | None) -> list[str]:
    """Maximal runs of letters or digits after NFKC and lower-casing."""
    return _WORD.findall(unicodedata.normalize("NFKC", text).lower()) if text else []


def suffix_array(s: np.ndarray) -> np.ndarray:
    """By prefix doubling; s ends with a unique least symbol."""
    rank, k = np.unique(s, return_inverse=True)[1].astype("int64"), 1
    while True:
        nxt = np.zeros(len(s), "int64")
        nxt[:-k] = rank[k:] + 1
        key = rank * (len(s) + 2) + nxt
        sa = np.argsort(key, kind="stable")
        change = np.empty(len(s), "int64")
        change[0] = 0
        np.cumsum(key[sa][1:] != key[sa][:-1], out=change[1:])
        rank[sa] = change
        if change[-1] == len(s) - 1:
            return sa
        k *= 2


class WaveletMatrix:
    """Rank of a symbol in a prefix, by one bit plane per binary digit."""

    def __init__(self, s: np.ndarray, sigma: int):
        self.bits, self.zeros = max(1, int(sigma - 1).bit_length()), []
        self.ones = []
        for b in range(self.bits - 1, -1, -1):
            one = ((s >> b) & 1).astype("int32")
            self.ones.append(np.concatenate([[0], np.cumsum(one)]).astype("int32"))
            self.zeros.append(int(len(s) - one.sum()))
            s = np.concatenate([s[one == 0], s[one == 1]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of c in the first i symbols, for arrays."""
        lo, hi = np.zeros_like(i), i.copy()
        for level, b in enumerate(range(self.bits - 1, -1, -1)):
            one, up = self.ones[level], ((c >> b) & 1).astype(bool)
            l1, h1 = one[lo], one[hi]
            lo = np.where(up, self.zeros[level] + l1, lo - l1)
            hi = np.where(up, self.zeros[level] + h1, hi - h1)
        return hi - lo

    def access(self, i: np.ndarray) -> np.ndarray:
        c = np.zeros_like(i)
        for level in range(self.bits):
            one = self.ones[level]
            bit = one[i + 1] - one[i]
            c = c << 1 | bit
            i = np.where(bit == 1, self.zeros[level] + one[i], i - one[i])
        return c


class FMIndex:
    """Backward search and location over one shard of symbols (0 is appended as its end)."""

    def __init__(self, s: np.ndarray, sigma: int, sample: int = SAMPLE):
        s = np.append(s, 0).astype("int64")
        sa = suffix_array(s)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=sigma))])
        self.wm = WaveletMatrix(s[sa - 1], sigma)
        self.n, self.sample = len(s), sample
        self.marked = sa % sample == 0
        self.before = np.concatenate([[0], np.cumsum(self.marked)])
        self.positions = sa[self.marked]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of the rows of ``patterns`` (all of one length)."""
        lo, hi = np.zeros(len(patterns), "int64"), np.full(len(patterns), self.n, "int64")
        alive = np.arange(len(patterns))
        for col in patterns.T[::-1]:
            c = col[alive]
            a = self.first[c] + self.wm.rank(c, lo[alive])
            b = self.first[c] + self.wm.rank(c, hi[alive])
            lo[alive], hi[alive] = a, b
            alive = alive[a < b]
            if not len(alive):
                break
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix array rows."""
        rows, steps, out = rows.copy(), np.zeros(len(rows), "int64"), np.full(len(rows), -1, "int64")
        open_ = np.arange(len(rows))
        while len(open_):
            r = rows[open_]
            hit = self.marked[r]
            out[open_[hit]] = self.positions[self.before[r[hit]]] + steps[open_[hit]]
            open_ = open_[~hit]
            c = self.wm.access(rows[open_])
            rows[open_] = self.first[c] + self.wm.rank(c, rows[open_])
            steps[open_] += 1
        return out


def _merge(item: np.ndarray, doc: np.ndarray, word: np.ndarray, size: int) -> pd.DataFrame:
    """Windows to maximal spans of words per (item, doc)."""
    f = pd.DataFrame({"item": item, "doc": doc, "word": word}).drop_duplicates().sort_values(["item", "doc", "word"])
    new = (f["item"] != f["item"].shift()) | (f["doc"] != f["doc"].shift()) | (f["word"] - f["word"].shift() > size)
    g = f.groupby(new.cumsum())
    return pd.DataFrame({"item": g["item"].first(), "doc": g["doc"].first(), "from_word": g["word"].first(), "to_word": g["word"].last() + size})


def leaked_spans(corpus: DataFrame, doc: str, text: str, queries: list[tuple[int, str]], size: int = SIZE, shard_words: int = SHARD_WORDS, max_query_words: int = MAX_QUERY_WORDS) -> DataFrame:
    """(item_id, doc_id, from_word, to_word): spans of ``size`` words or more of an item's passage in a text.

    ``queries`` are (item id, passage); to_word is exclusive.
    """
    spark = corpus.sparkSession
    streams = [(i, words(p)) for i, p in queries]
    if sum(len(w) for _, w in streams) > max_query_words:
        raise ValueError("the held-out set exceeds max_query_words; search it in parts")
    ids: dict[str, int] = {}
    for _, w in streams:
        for x in w:
            ids.setdefault(x, len(ids) + 2)
    wins = [(tuple(ids[x] for x in w[k : k + size]), i) for i, w in streams for k in range(len(w) - size + 1)]
    distinct = sorted({w for w, _ in wins})
    at = {w: k for k, w in enumerate(distinct)}
    owners = pd.DataFrame(sorted({(at[w], i) for w, i in wins}), columns=["win", "item"])
    sent = spark.sparkContext.broadcast((ids, np.array(distinct, "int64").reshape(-1, size), owners))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, patterns, owners = sent.value
        sigma = len(ids) + 2

        def shard(syms, docs, places) -> pd.DataFrame:
            s, d, p = np.concatenate(syms), np.concatenate(docs), np.concatenate(places)
            fm = FMIndex(s, sigma)
            lo, hi = fm.search(patterns)
            n = np.maximum(hi - lo, 0)
            win = np.repeat(np.arange(len(patterns)), n)
            rows = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            pos = fm.locate(rows)
            f = pd.DataFrame({"win": win, "doc": d[pos], "word": p[pos]}).merge(owners, on="win")
            return _merge(f["item"].to_numpy(), f["doc"].to_numpy(), f["word"].to_numpy(), size)

        syms, docs, places, held = [], [], [], 0
        for pdf in batches:
            for key, t in zip(pdf["doc"].to_numpy(), pdf["text"]):
                s = np.fromiter((ids.get(x, 1) for x in words(t)), "int64")
                # ends of stretches of passage words; the short ones cannot hold a window
                edge = np.flatnonzero(np.diff(np.concatenate([[0], s > 1, [0]])))
                for a, b in zip(edge[::2], edge[1::2]):
                    if b - a >= size:
                        syms += [s[a:b], np.ones(1, "int64")]
                        docs.append(np.full(b - a + 1, key, "int64"))
                        places.append(np.arange(a, b + 1))
                        held += b - a + 1
                if held >= shard_words:
                    yield shard(syms, docs, places)
                    syms, docs, places, held = [], [], [], 0
        if held:
            yield shard(syms, docs, places)

    if not len(distinct):
        return spark.createDataFrame([], "item_id bigint, doc_id bigint, from_word bigint, to_word bigint")
    got = corpus.where(F.col(doc).isNotNull() & F.col(text).isNotNull()).select(F.col(doc).cast("bigint").alias("doc"), F.col(text).alias("text"))
    return widen(got).mapInPandas(search, "item bigint, doc bigint, from_word bigint, to_word bigint").select(F.col("item").alias("item_id"), F.col("doc").alias("doc_id"), "from_word", "to_word")
