"""Subject areas: bisecting k-means over document vectors, leaf labels, leaf mixtures.

1. Terms are pairs of neighbouring words without function words, in at least ``min_share`` of the
   records; a record has a bounded number of pairs, so there are at most (pairs per record /
   min_share) terms.  A record's vector has idf weights, a title counting ``title_weight`` times,
   and unit length.
2. Bisecting k-means: level by level every leaf that is large (``FAIR`` of the records) and loose
   is cut in two, the largest first, up to ``max_leaves`` leaves.  Size and looseness are those of all records.  Only the
   first centres of a cut come from a bounded sample of ``SAMPLE`` vectors; all passes over centres run over all records,
   with sums taken in each partition.
3. A leaf is labelled by its ``LABEL_TERMS`` most discriminative terms.  What a term says comes from the words it shares with
   the subjects' descriptions and from the hints of all records that use it, against their overall rate (an
   earlier guess, weighted by its confidence); a term used with few hints follows the descriptions.
4. A record is a mixture of leaves: every mention of a term counts for the leaves the term belongs to,
   and through them for their subjects.  Subjects with at least ``main`` of the whole are
   assigned, one or more.

Null title and abstract, or no term that tells a subject: the hint is taken if it names a subject, else none.
Repeated ids count once (the least row); empty tables give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from palimpsest.llm.names import fold
from palimpsest.plans.runtime import cut

MIN_SHARE, TITLE_WEIGHT, MAX_LEAVES, DEPTH, LLOYD, SAMPLE, FAIR, MAIN = 0.002, 2.0, 96, 14, 4, 4000, 1 / 30, 0.3
LABEL_TERMS, FEW_HINTS, ROWS = 12, 2.0, 1024  # terms that label a leaf; hints that weigh as much as a description; rows made dense at once
# fixed values: function words, which end a pair
FUNCTION_WORDS = set(
    "a an the of in on at to for from by with without and or but nor as is was were are be been had has have that which whose what than rather into under against between over after before because although where when if each every any no not neither nor it its this these those their there most half earlier later once across following having until through about per cent".split()
)


def terms_of(text: str | None) -> list[str]:
    """Pairs (and the triples that warm-up phrases form) of neighbouring content words."""
    out = []
    for piece in re.split(r"[^\w\s'-]+|\d+", fold(text or "")):
        run: list[str] = []
        for w in [*re.findall(r"[a-z]+", piece), "the"]:
            if w in FUNCTION_WORDS or len(w) < 2:
                out += [f"{a} {b}" for a, b in zip(run, run[1:])]
                run = []
            else:
                run.append(w)
    return out


def prepare(docs: DataFrame, doc: str, title: str, abstract: str, hint: str, conf: str) -> DataFrame:
    """(doc, title_terms, terms, hint, conf)"""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc": pdf["doc"], "tt": [terms_of(x) for x in pdf["title"]], "at": [terms_of(x) for x in pdf["abstract"]], "hint": pdf["hint"], "conf": pdf["conf"]})

    row = F.struct(F.col(title).alias("title"), F.col(abstract).alias("abstract"), F.lower(F.trim(hint)).alias("hint"), F.col(conf).cast("double").alias("conf"))
    one = docs.where(F.col(doc).isNotNull()).groupBy(F.col(doc).cast("bigint").alias("doc")).agg(F.min(row).alias("r")).select("doc", "r.*")
    return one.mapInPandas(each, "doc bigint, tt array<string>, at array<string>, hint string, conf double")


def vocabulary(prepared: DataFrame, n: int, min_share: float = MIN_SHARE) -> pd.DataFrame:
    """(term, df) of the terms in at least ``min_share`` of the records: a bounded number."""
    t = prepared.select(F.explode(F.array_distinct(F.concat("tt", "at"))).alias("term"))
    return t.groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") >= max(3, min_share * n)).orderBy("term").toPandas()


def vectors(prepared: DataFrame, vocab: pd.DataFrame, n: int, title_weight: float = TITLE_WEIGHT) -> DataFrame:
    """(doc, ids, tf, w, hint, conf): term numbers, weighted mentions and unit weights."""
    at = {t: i for i, t in enumerate(vocab["term"])}
    idf = np.log((n + 1) / (vocab["df"].to_numpy() + 0.5))
    sent = prepared.sparkSession.sparkContext.broadcast((at, idf))

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, idf = sent.value
        for pdf in batches:
            ids, tfs, ws = [], [], []
            for tt, ab in zip(pdf["tt"], pdf["at"]):
                tf: dict[int, float] = {}
                for words, x in ((tt, title_weight), (ab, 1.0)):
                    for t in words:
                        if t in at:
                            tf[at[t]] = tf.get(at[t], 0.0) + x
                i, f = np.fromiter(tf, "int32", len(tf)), np.fromiter(tf.values(), "float64", len(tf))
                w = np.sqrt(f) * idf[i] if len(i) else f
                norm = np.sqrt((w**2).sum())
                ids.append(i), tfs.append(f), ws.append(w / norm if norm else w)
            yield pd.DataFrame({"doc": pdf["doc"], "ids": ids, "tf": tfs, "w": ws, "hint": pdf["hint"], "conf": pdf["conf"]})

    return prepared.mapInPandas(each, "doc bigint, ids array<int>, tf array<double>, w array<double>, hint string, conf double")


def _dense(pdf: pd.DataFrame, dims: int, weight: str = "w") -> np.ndarray:
    m = np.zeros((len(pdf), dims), "float32")
    if len(pdf):
        sizes = [len(x) for x in pdf["ids"]]
        if sum(sizes):
            m[np.repeat(np.arange(len(pdf)), sizes), np.concatenate(list(pdf["ids"]))] = np.concatenate(list(pdf[weight]))
    return m


def _walk(x: np.ndarray, tree: dict[int, tuple[np.ndarray, np.ndarray] | None]) -> np.ndarray:
    """Leaf of each row: node 1 is the root, node k has children 2k and 2k + 1."""
    at = np.ones(len(x), "int64")
    while True:
        moved = False
        for node in np.unique(at):
            pair = tree.get(int(node))
            if pair is not None:
                rows = np.flatnonzero(at == node)
                at[rows] = 2 * node + (x[rows] @ pair[1] > x[rows] @ pair[0])
                moved = True
        if not moved:
            return at


def _seeds(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two far apart members: the least like the mean, then the least like that one, each smoothed by its neighbours."""
    mean = x.mean(axis=0)
    a = int((x @ mean).argmin())
    near = lambda i: x[np.argsort(-(x @ x[i]), kind="stable")[: max(3, len(x) // 20)]].mean(axis=0)
    ca = near(a)
    cb = near(int((x @ ca).argmin()))
    for _ in range(5):
        side = x @ cb > x @ ca
        if side.all() or not side.any():
            break
        ca, cb = x[~side].mean(axis=0), x[side].mean(axis=0)
        ca, cb = ca / max(np.linalg.norm(ca), 1e-9), cb / max(np.linalg.norm(cb), 1e-9)
    return ca, cb


def _parts(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
    for k in range(0, len(pdf), ROWS):
        yield pdf.iloc[k : k + ROWS]


def _child_sums(vecs: DataFrame, tree: dict, grown: set[int], dims: int) -> dict[int, tuple[float, np.ndarray]]:
    """(records, sum of vectors) of each child of the nodes in ``grown``, over all records."""
    sent = vecs.sparkSession.sparkContext.broadcast((tree, grown))

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree, new = sent.value
        total: dict[int, np.ndarray] = {}
        for pdf in batches:
            for part in _parts(pdf):
                x = _dense(part, dims + 1)
                x[:, dims] = 1  # counts the records
                leaf = _walk(x[:, :dims], tree)
                for k in np.unique(leaf):
                    if int(k) // 2 in new:
                        total[int(k)] = total.get(int(k), 0) + x[leaf == k].sum(axis=0, dtype="float64")
        yield pd.DataFrame({"leaf": list(total), "s": list(total.values())})

    got = vecs.where(F.size("ids") > 0).select("ids", "w").mapInPandas(sums, "leaf long, s array<double>")
    rows = got.select("leaf", F.posexplode("s").alias("i", "x")).where("x <> 0").groupBy("leaf", "i").agg(F.sum("x").alias("x")).toPandas()  # at most leaves x dims
    out = {}
    for k in [c for n in grown for c in (2 * n, 2 * n + 1)]:
        part, v = rows[rows["leaf"] == k], np.zeros(dims + 1)
        v[part["i"].to_numpy()] = part["x"].to_numpy()
        out[k] = (float(v[dims]), v[:dims])
    return out


def bisect(vecs: DataFrame, dims: int, n: int, max_leaves: int = MAX_LEAVES, depth: int = DEPTH, lloyd: int = LLOYD):
    """The tree of centre pairs by bisecting k-means over all records."""
    known = vecs.where(F.size("ids") > 0)
    sample = _dense(known.orderBy(F.xxhash64("doc")).limit(SAMPLE).select("ids", "w").toPandas(), dims)
    tree: dict = {}
    if len(sample) < 4:
        return tree
    whole = float(known.count())
    # of each leaf that may be cut: its records and the length of their mean
    open_leaves = {1: (whole, float(np.linalg.norm(sample.mean(axis=0))))}
    leaves = 1
    for _ in range(depth):
        where = _walk(sample, tree)
        # worth a cut: holds more than a fair share of records and is loose
        fit = sorted((k for k, (size, tight) in open_leaves.items() if size >= max(8, whole * FAIR) and tight < 0.75), key=lambda k: (-open_leaves[k][0], k))
        grown = {k: _seeds(sample[where == k]) for k in fit[: max(0, max_leaves - leaves)] if (where == k).sum() >= 4}
        if not grown:
            break
        for _ in range(lloyd):  # all new pairs at once, over all records
            sums = _child_sums(vecs, tree | grown, set(grown), dims)
            fresh = {}
            for node, pair in grown.items():
                norms = [np.linalg.norm(sums[2 * node + j][1]) for j in (0, 1)]
                fresh[node] = tuple((sums[2 * node + j][1] / norms[j]).astype("float32") if norms[j] else pair[j] for j in (0, 1))
            shift = max(float(np.abs(fresh[k][j] - grown[k][j]).max()) for k in grown for j in (0, 1))
            grown = fresh
            if shift < 1e-3:
                break
        tree |= grown
        leaves += len(grown)
        open_leaves = {k: (size, float(np.linalg.norm(v)) / max(size, 1.0)) for k, (size, v) in sums.items()} | {k: x for k, x in open_leaves.items() if k not in grown and k in fit}
    return tree


def leaf_statistics(vecs: DataFrame, tree: dict, dims: int, subjects: list[str]):
    """(leaf numbers, mass leaf x term, hint weight term x subject), over all records."""
    sent = vecs.sparkSession.sparkContext.broadcast(tree)
    of = {s: i for i, s in enumerate(subjects)}

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        term, hint = {}, np.zeros((dims, len(of)))
        for pdf in batches:
            for part in _parts(pdf):
                x = _dense(part, dims)
                leaf = _walk(x, sent.value)
                for k in np.unique(leaf):
                    term[int(k)] = term.get(int(k), 0) + x[leaf == k].sum(axis=0, dtype="float64")
                named = np.array([of.get(h, -1) for h in part["hint"]])
                trust = np.where(part["conf"].isna(), 0.3, np.maximum(part["conf"].astype("float64").fillna(0), 0.05))
                for j in np.unique(named[named >= 0]):
                    rows = named == j
                    hint[:, j] += trust[rows] @ x[rows]
        # leaves, then minus one less the subject
        yield pd.DataFrame({"k": [*term, *(-1 - j for j in range(len(of)))], "t": [*term.values(), *hint.T]})

    got = vecs.where(F.size("ids") > 0).select("ids", "w", "hint", "conf").mapInPandas(each, "k long, t array<double>")
    rows = got.select("k", F.posexplode("t").alias("i", "x")).where("x <> 0").groupBy("k", "i").agg(F.sum("x").alias("x")).toPandas()  # at most (leaves + subjects) x dims
    leaves = sorted({int(k) for k in rows["k"] if k > 0})
    at = {k: i for i, k in enumerate(leaves)}
    terms, hints = np.zeros((len(leaves), dims)), np.zeros((dims, len(subjects)))
    t, h = rows[rows["k"] > 0], rows[rows["k"] < 0]
    terms[[at[k] for k in t["k"]], t["i"].to_numpy()] = t["x"].to_numpy()
    hints[h["i"].to_numpy(), -1 - h["k"].to_numpy()] = h["x"].to_numpy()
    return leaves, terms, hints


def _distinct(terms: np.ndarray) -> np.ndarray:
    """How far each term sets each leaf apart: its share times log of that against the whole, never below zero."""
    whole = terms.sum(axis=0) / max(terms.sum(), 1e-9)
    share = terms / np.maximum(terms.sum(axis=1, keepdims=True), 1e-9)
    return np.maximum(share * np.log((share + 1e-6) / (whole + 1e-6)), 0)


def discriminative(terms: np.ndarray, vocab: pd.DataFrame, top: int = 8) -> list[list[str]]:
    """The terms that set each leaf apart."""
    names = vocab["term"].to_numpy()
    return [[str(names[j]) for j in np.argsort(-s, kind="stable")[:top] if s[j] > 0] for s in _distinct(terms)]


def _stem(word: str) -> str:
    for end in ("ings", "ing", "ers", "er", "ies", "es", "s"):
        if word.endswith(end) and len(word) - len(end) >= 4:
            return word[: -len(end)]
    return word


def described(vocab: pd.DataFrame, subjects: list[str], about: list[str]) -> np.ndarray:
    """Share of each subject in each term by the words it has in common with names and descriptions."""
    words = [{_stem(w) for w in re.findall(r"[a-z]{4,}", fold(f"{s} {d}"))} for s, d in zip(subjects, about)]
    m = np.array([[len({_stem(w) for w in t.split()} & ws) for ws in words] for t in vocab["term"]], "float64").reshape(len(vocab), len(subjects))
    return m / np.maximum(m.sum(axis=1, keepdims=True), 1e-9)


def label_leaves(terms: np.ndarray, hints: np.ndarray, vocab: pd.DataFrame, subjects: list[str], about: list[str], top: int = LABEL_TERMS) -> np.ndarray:
    """Share of each subject in each leaf, by what its discriminative terms say."""
    base = hints.sum(axis=0) / max(hints.sum(), 1e-9)
    lift = hints / np.maximum(base, 1e-3)[None, :]
    lift = lift / np.maximum(lift.sum(axis=1, keepdims=True), 1e-9)
    known = hints.sum(axis=1, keepdims=True) / (hints.sum(axis=1, keepdims=True) + FEW_HINTS)
    says = known * lift + (1 - known) * described(vocab, subjects, about)
    score = _distinct(terms)
    for row in score:
        row[np.argsort(-row, kind="stable")[top:]] = 0
    mixed = score / np.maximum(score.sum(axis=1, keepdims=True), 1e-9) @ says
    sharp = mixed**3  # the majority of a leaf is its subject; a wrong guess now and then is not
    return sharp / np.maximum(sharp.sum(axis=1, keepdims=True), 1e-12)


def term_subjects(terms: np.ndarray, leaf_share: np.ndarray) -> np.ndarray:
    """Subject shares of each term through the leaves it belongs to, cleared of generic terms (they spread over all leaves)."""
    size = np.maximum(terms.sum(axis=1, keepdims=True), 1e-9)
    belong = (terms / size) ** 2
    belong = belong / np.maximum(belong.sum(axis=0, keepdims=True), 1e-12)
    shares = belong.T @ leaf_share
    focus = np.clip((shares.max(axis=1) - 0.4) / 0.3, 0, 1)
    return shares * focus[:, None]


def assign(vecs: DataFrame, by_term: np.ndarray, subjects: list[str], main: float = MAIN) -> DataFrame:
    """(doc, subject, share): subjects of at least ``main`` of a record's mentions."""
    sent = vecs.sparkSession.sparkContext.broadcast((by_term, subjects))

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by_term, subjects = sent.value
        for pdf in batches:
            out = []
            for doc, ids, tf, hint in zip(pdf["doc"].to_numpy(), pdf["ids"], pdf["tf"], pdf["hint"]):
                mass = np.asarray(tf) @ by_term[np.asarray(ids)] if len(ids) else np.zeros(len(subjects))
                if mass.sum() <= 0:
                    if hint in subjects:
                        out.append((doc, hint, 0.0))
                    continue
                share = mass / mass.sum()
                keep = set(np.flatnonzero(share >= main)) | {int(share.argmax())}
                out += [(doc, subjects[j], float(share[j])) for j in sorted(keep)]
            yield pd.DataFrame(out, columns=["doc", "subject", "share"])

    return vecs.mapInPandas(each, "doc bigint, subject string, share double")


def fit(docs: DataFrame, subject_rows: list[tuple[str, str]], columns: tuple[str, str, str, str, str]):
    """Vectors, vocabulary, tree and leaf figures of ``docs``."""
    prepared = cut(prepare(docs, *columns), "terms")
    n = prepared.count()
    vocab = vocabulary(prepared, max(n, 1))
    vecs = cut(vectors(prepared, vocab, n), "vectors")
    subjects = [s.strip().lower() for s, _ in subject_rows]
    if len(set(subjects)) < len(subjects):
        raise ValueError("a subject is listed twice")
    tree = bisect(vecs, len(vocab), n)
    leaves, terms, hints = leaf_statistics(vecs, tree, len(vocab), subjects)
    return vecs, vocab, tree, leaves, terms, hints, subjects


def subject_areas(docs: DataFrame, subject_rows: list[tuple[str, str]], columns: tuple[str, str, str, str, str], main: float = MAIN) -> DataFrame:
    vecs, vocab, _, _, terms, hints, subjects = fit(docs, subject_rows, columns)
    shares = label_leaves(terms, hints, vocab, subjects, [d for _, d in subject_rows])
    return assign(vecs, term_subjects(terms, shares), subjects, main)
