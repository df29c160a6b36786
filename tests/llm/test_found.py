"""Operators for training data against brute force, round trips and planted cases."""

import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import cooccur, fmindex, names, packing, q_softlink, residue, scans, softlink, spans, subjects
from palimpsest.llm.q_packing import TOKENIZERS, TOKENIZER as TOKENIZER_FILE

TOKENIZER = f"{TOKENIZERS}/{TOKENIZER_FILE}"

# ---- items that appear together


def brute_pairs(rows, least, lift):
    baskets = defaultdict(set)
    for b, i, y in rows:
        if b is not None and i is not None and y is not None:
            baskets[b].add((i, y))
    n1, n2, n = Counter(), Counter(), len(baskets)
    for s in baskets.values():
        n1.update(s)
        n2.update(itertools.combinations(sorted(s), 2))
    return {(*a, *b, k) for (a, b), k in n2.items() if k >= least and k * n >= lift * n1[a] * n1[b]}


@pytest.mark.parametrize("giant, share", [(4096, 1 / 32), (6, 1 / 32), (6, 0.9), (4096, 0.9), (3, 0.05)])
def test_cooccurrence(spark, giant, share):
    rng = random.Random(7)
    rows = [(f"b{rng.randrange(60)}", f"i{min(int(rng.expovariate(0.08)), 60)}", rng.randrange(2)) for _ in range(900)]
    rows += [("big", f"i{k}", 0) for k in range(50)] + [(f"big{j}", f"i{k}", 0) for j in range(8) for k in range(40, 60)]
    rows += rows[:50] + [(None, "x", 1), ("b1", None, 1), ("b1", "x", None)]
    d = spark.createDataFrame(rows, "src string, name string, year int")
    got = {(r["name_1"], r["year_1"], r["name_2"], r["year_2"], r["n_ab"]) for r in cooccur.cooccurrence(d, "src", ["name", "year"], 4, 1.2, heavy_share=share, giant=giant, pairs_per_group=500).collect()}
    assert got == brute_pairs(rows, 4, 1.2)


def test_a_hot_item_is_counted_by_several_groups(spark):
    """One item in a tenth of the baskets: its owners share it, and the counts are those of brute force."""
    rng = random.Random(3)
    rows = [(f"b{k}", f"i{rng.randrange(300)}", 0) for k in range(1000) for _ in range(6)] + [(f"b{k}", "hot", 0) for k in range(0, 1000, 10)]
    d = spark.createDataFrame(rows, "src string, name string, year int")
    got = {(r["name_1"], r["year_1"], r["name_2"], r["year_2"], r["n_ab"]) for r in cooccur.cooccurrence(d, "src", ["name", "year"], 2, 1.0, heavy_share=0.5, pairs_per_group=200, shares=400).collect()}
    assert got == brute_pairs(rows, 2, 1.0)


def test_cooccurrence_with_clashing_names(spark):
    d = spark.createDataFrame([(b, i, "extra") for b in range(8) for i in ("x", "y")], "id int, basket string, cnt string")
    r = cooccur.cooccurrence(d, "id", ["basket"], 2, 0.5).collect()
    assert [(x["basket_1"], x["basket_2"], x["n_ab"]) for x in r] == [("x", "y", 8)]


def test_cooccurrence_empty(spark):
    d = spark.createDataFrame([], "src string, name string, year int")
    assert cooccur.cooccurrence(d, "src", ["name", "year"]).count() == 0


# ---- shared spans

SENT = "doc_id string, idx int, text string, excl array<string>"


def brute_spans(rows, n=20):
    win = defaultdict(set)
    docs = defaultdict(dict)
    for d, i, t, e in rows:
        if d is not None and i is not None and not e:
            docs[d][i] = t
    import re

    for d, r in docs.items():
        words, last = [], None
        for i in sorted(r):
            if last is not None and i != last + 1:
                words.append(None)
            words += re.findall("[a-z0-9]+", (r[i] or "").lower())
            last = i
        for k in range(len(words) - n + 1):
            w = tuple(words[k : k + n])
            if None not in w:
                win[w].add(d)
    return {p for s in win.values() for p in itertools.combinations(sorted(s), 2)}


def span_rows(seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(500)}"
    rows, shared = [], [word() for _ in range(60)]
    for k in range(8):
        ws = [word() for _ in range(300)]
        if k % 2 == 0:
            m = 19 + k
            ws[100:100] = shared[:m]
        i, idx = 0, 0
        while i < len(ws):
            n = rng.randrange(1, 25)
            rows.append((f"d{k}", idx, " ".join(ws[i : i + n]).title() + ".", [] if rng.random() < 0.97 else ["caption"]))
            if rng.random() < 0.1:
                idx += 1
                rows.append((f"d{k}", idx, rng.choice(["", None, "—"]), []))
            idx += 1 if rng.random() < 0.98 else 2
            i += n
    return rows + rows[:20] + [(None, 1, "x", []), ("d1", None, "x", [])]


@pytest.mark.parametrize("seed, block, tail", [(1, 256, 32), (2, 4, 2), (3, 3, 1)])
def test_sharing_pairs(spark, monkeypatch, seed, block, tail):
    monkeypatch.setattr(spans, "BLOCK", block)
    monkeypatch.setattr(spans, "TAIL", tail)
    rows = span_rows(seed)
    d = spark.createDataFrame(rows, SENT)
    got = {(r["a"], r["b"]) for r in spans.sharing_pairs(spans.shared_windows(d)).collect()}
    assert got == brute_spans(rows) and got


def test_span_figures(spark):
    w = [f"v{i}" for i in range(50)]
    rows = [("a", 0, " ".join(w), []), ("b", 0, "x " + " ".join(w[:15]), []), ("b", 1, " ".join(w[15:30]) + " y", []), ("c", 0, "nothing shared", [])]
    d = spark.createDataFrame(rows, SENT)
    win = spans.shared_windows(d)
    r = spans.word_rows(d)
    at = spans.placed(win, r)
    p = spans.pair_figures(r, at).first()
    assert (p["a"], p["b"], p["max_run"], p["matched_words"]) == ("a", "b", 30, 30)
    share = {x["doc"]: x["shared_words"] for x in spans.shared_per_record(r, at).collect()}
    assert share == {"a": 30, "b": 30, "c": 0}
    s = spans.removable_spans(win).first()
    assert (s["doc"], s["from_idx"], s["from_off"], s["to_idx"], s["to_off"]) == ("b", 0, 1, 1, 14)


def test_spans_empty(spark):
    assert spans.sharing_pairs(spans.shared_windows(spark.createDataFrame([], SENT))).count() == 0


# ---- FM-index


def test_fm_index_equals_scan():
    rng = np.random.default_rng(3)
    s = rng.integers(1, 9, 700)
    fm = fmindex.FMIndex(s, 10)
    pat = np.array([s[i : i + 4] for i in range(0, 600, 7)] + [[9, 9, 9, 9], [1, 1, 1, 1]])
    lo, hi = fm.search(pat)
    for p, a, b in zip(pat, lo, hi):
        want = [i for i in range(len(s) - 3) if (s[i : i + 4] == p).all()]
        assert sorted(fm.locate(np.arange(a, max(a, b)))) == want


def test_leaks(spark):
    p = " ".join(f"word{i}" for i in range(40))
    docs = [(1, "before " + p + " after"), (2, "x " + " ".join(p.split()[5:18]) + " y"), (3, " ".join(p.split()[5:17])), (4, None), (5, ""), (6, p.upper().replace(" ", " \n"))]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = {tuple(r) for r in fmindex.leaked_spans(d, "doc_id", "text", [(7, p), (8, "too short"), (9, p)], shard_words=30).collect()}
    assert got == {(i, 1, 1, 41) for i in (7, 9)} | {(i, 2, 1, 14) for i in (7, 9)} | {(i, 6, 0, 40) for i in (7, 9)}
    assert fmindex.leaked_spans(d, "doc_id", "text", []).count() == 0


def test_decoder_heals_words_outside_the_lexicon():
    """Names broken by a hyphen, letters drawn apart, marks inside a word; a suspended hyphen stays."""
    dec = scans.Decoder({w: 50 for w in "the measure spaces of pre and post tests were small because".split()})
    for text, want in (("the Lour-  taelt tests", "the lourtaelt tests"), ("the m e a s u r e spaces", "the measure spaces"), ("Yaend!sk tests", "yaendisk tests"), ("pre- and post tests", "pre- and post tests"), ("the B r i l n u l l tests", "the brilnull tests")):
        got = dec.decode(text)
        assert got == (want, want != text.lower()), (text, got)


def test_a_passage_in_many_records_meets_in_blocks(spark):
    d = spark.createDataFrame([(7, 7, f"r{k}") for k in range(90)] + [(8, 8, "r1"), (8, 8, "r2"), (9, 9, "r3")], "d1 long, d2 long, doc string")
    a, b = d.withColumnRenamed("doc", "a"), d.withColumnRenamed("doc", "b")
    got = spans.meet(a, b, ["d1", "d2"], block=20)
    assert sorted(map(tuple, got.select("d1", "a", "b").collect())) == sorted((x[0], x[2], y[2]) for x in d.collect() for y in d.collect() if x[0] == y[0])
    text = " ".join(f"w{k}" for k in range(22))
    rows = spark.createDataFrame([(f"t{k}", 0, text, []) for k in range(60)], "doc_id string, idx int, text string, excl array<string>")
    assert spans.sharing_pairs(spans.shared_windows(rows)).count() == 60 * 59 // 2


# ---- packing


def test_best_fit_never_overfills():
    rng = np.random.default_rng(0)
    s = rng.integers(1, 100, 500)
    b = packing.best_fit(s, 100)
    used = np.bincount(b, weights=s)
    assert used.max() <= 100 and len(used) <= 1.25 * np.ceil(s.sum() / 100)


def test_pack_is_whole(spark):
    rng = random.Random(1)
    items = [(f"i{k}", 100, rng.randrange(1, 60)) for k in range(400)] + [(f"j{k}", 50, rng.randrange(1, 51)) for k in range(90)]
    d = spark.createDataFrame(items, "item string, capacity int, tokens int")
    got = packing.pack(d, per_cell=40, fan_in=3).collect()
    assert sorted((r["item"], r["tokens"]) for r in got) == sorted((i, t) for i, _, t in items)
    used = Counter()
    cap = {}
    for r in got:
        used[r["bin"]] += r["tokens"]
        assert cap.setdefault(r["bin"], r["capacity"]) == r["capacity"]
    assert all(used[b] <= cap[b] for b in used)
    for c in (50, 100):
        assert sum(v for b, v in used.items() if cap[b] == c) >= 0.9 * c * (sum(cap[b] == c for b in used) - 1)
    assert packing.pack(d.limit(0)).count() == 0


def test_pack_rounds_shrink(spark):
    """Three rounds or more, a residual that shrinks, no cell beyond its size, and a fill close to one best fit over everything."""
    rng = random.Random(2)
    sizes = [min(256, max(1, int(rng.lognormvariate(3.6, 0.8)))) for _ in range(3000)]
    d = spark.createDataFrame([(f"i{k}", 256, t) for k, t in enumerate(sizes)], "item string, capacity int, tokens int")
    rounds = [r.toPandas() for r in packing.pack_rounds(d, per_cell=100, fan_in=3)]
    assert len(rounds) >= 3 and all(len(a) > len(b) for a, b in itertools.pairwise(rounds))
    assert all(r.groupby(r["bin"].str.rsplit("-", n=1).str[0]).size().max() <= 170 for r in rounds)
    used = packing.pack(d, per_cell=100, fan_in=3).groupBy("bin").agg(F.sum("tokens").alias("t")).toPandas()
    assert used["t"].max() <= 256 and len(used) <= 1.02 * (packing.best_fit(np.array(sizes), 256).max() + 1)


def test_pack_of_items_that_never_share(spark):
    """Bins that nothing can join are final at once and do not pile up in the last task."""
    d = spark.createDataFrame([(f"i{k}", 512, 280 + k % 40) for k in range(4000)], "item string, capacity int, tokens int")
    rounds = packing.pack_rounds(d, per_cell=100)
    assert len(rounds) == 1 and rounds[0].select("bin").distinct().count() == 4000


def test_pieces_split_only_the_large_and_keep_every_character(spark):
    texts = {1: "one two three", 2: "łódź 北京 🎓🎓🎓 zażółć gęślą " * 9, 3: "", 4: None, 5: "x" * 3, 6: " plain words and more words" * 40}
    d = spark.createDataFrame(list(texts.items()), "doc long, text string")
    got = packing.pieces(d, "doc", "text", TOKENIZER, [16, 64]).orderBy("doc", "piece").collect()
    for k in (1, 2, 5, 6):
        mine = [r for r in got if r["doc"] == k]
        assert "".join(texts[k][r["from_char"] : r["to_char"]] for r in mine) == texts[k]
        assert [r["from_token"] for r in mine] == [sum(x["tokens"] for x in mine[:i]) for i in range(len(mine))]
        assert all(0 < r["tokens"] <= r["capacity"] for r in mine) and (len(mine) == 1) == (sum(r["tokens"] for r in mine) <= 64)
    assert {r["doc"] for r in got} == {1, 2, 5, 6}


# ---- names


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


@pytest.mark.parametrize("block", [3000, 7])
def test_radius_join_is_exact(spark, block, monkeypatch):
    rng = random.Random(2)
    keys = {"".join(rng.choice("abcde") for _ in range(rng.randrange(1, 9))) for _ in range(250)}
    monkeypatch.setattr(names, "LEAF", 10)
    monkeypatch.setattr(names, "GAIN", 2.5)  # split even where it does not pay
    d = spark.createDataFrame([(k,) for k in keys] * 2 + [("",), (None,)], "key string")
    got = {(r["ka"], r["kb"], r["d"]) for r in names.radius_join(d, 2, block).collect()}
    assert got == {(a, b, lev(a, b)) for a, b in itertools.combinations(sorted(keys), 2) if lev(a, b) <= 2}


def test_person_pairs(spark):
    base = [f"{s}, {g}" for s in ("kolvarenstad", "brimoukessis", "tallvarendoum") for g in ("matthew", "rebecca", "jürgen", "susannah")] * 1
    filler = [f"x{i}elvarkos{i % 7}, {g}" for i, g in enumerate(["matthew", "rebecca", "jürgen", "susannah"] * 8)]
    variants = ["dr rebecca kolvarenstad", "becky kolvarenstad", "kolvarensatd, rebecca", "kolvarenstad, r.", "kolvarenstad,rm", "tallvarendoum, jurgen (author)", ""]
    d = spark.createDataFrame([(x,) for x in base + filler + variants] + [(None,)], "name string")
    got = {(r["name_1"], r["name_2"]) for r in names.person_pairs(d).collect()}
    assert {("dr rebecca kolvarenstad", "kolvarenstad, rebecca"), ("becky kolvarenstad", "kolvarenstad, rebecca"), ("kolvarensatd, rebecca", "kolvarenstad, rebecca"), ("kolvarenstad, r.", "kolvarenstad, rebecca"), ("kolvarenstad, rebecca", "kolvarenstad,rm"), ("tallvarendoum, jurgen (author)", "tallvarendoum, jürgen")} <= got
    assert not any({"kolvarenstad, matthew", "kolvarenstad, rebecca"} == set(p) for p in got)
    assert names.person_pairs(d.limit(0)).count() == 0


def test_surname_pairs(spark):
    rows = [("kolvarenstad", "1999 a"), ("kolvarenstda", "2000 b"), ("malvall", "1 x"), ("zalvall", "2 y"), ("renka", "3 z"), ("renks", "3 z"), ("kolvaren.", "1999 a"), ("k. kolvarenstad", "4"), ("", "1"), (None, "2")]
    got = {(r[0], r[1]) for r in names.surname_pairs(spark.createDataFrame(rows, "name string, evidence string")).collect()}
    assert {("kolvarenstad", "kolvarenstda"), ("k. kolvarenstad", "kolvarenstad"), ("renka", "renks"), ("kolvaren.", "kolvarenstad")} <= got
    assert ("malvall", "zalvall") not in got


# ---- linkage


def test_soft_linkage(spark):
    w = [("k1", "smithson", 1999, "the clear theory metal bridges under heavy loads"), ("k2", "jonesby", 2001, "novel account river sediment with plain methods"), ("k3", "", 2005, "strict tensions database indexes standard dependence"), ("k4", None, None, None)]
    a = [("A1", "The clear theory of metal bridges under heavy loads (2nd ed.)", 2000, ["J. Smithson", "K. Other"]), ("A2", "THE CLEAR THOERY OF METAL BRIDGES", 1999, ["Smitshon, Jane"]), ("A3", "The clear theory of metal bridges under heavy loads", 1960, ["R. Different"]), ("A4", "Novel account of stellar spectra with plain methods", 2001, ["Jonesby, A."]), ("A5", "Strict tensions in database indexes: standard dependence", 2005, []), ("A6", None, None, None)]
    works = softlink.prepare_works(spark.createDataFrame(w, "key string, surname string, year int, title string"), "key", "surname", "year", "title")
    recs = softlink.prepare_records(spark.createDataFrame(a, "openalex string, title string, year int, authors array<string>"), "openalex", "authors", "year", "title")
    got = {(r["key"], r["rid"]): r["confidence"] for r in softlink.infer(softlink.ground(softlink.candidates(works, recs)), rounds=4).collect()}
    yes = {k for k, c in got.items() if c >= 0.5}
    assert yes == {("k1", "A1"), ("k1", "A2"), ("k3", "A5")}
    assert all(0 <= c <= 1 for c in got.values())
    assert softlink.infer(softlink.ground(softlink.candidates(works.limit(0), recs)), rounds=2).count() == 0


def test_components_are_solved_in_one_task(spark, monkeypatch):
    """Stars, chains longer than the labels reach and unlike titles: no round is written out, and the result is that of rounds over all."""
    import random

    rng = random.Random(4)
    edges = {(w, w + k) for w in range(0, 60, 2) for k in range(2)} | {(w, w + k) for w in range(100, 130) for k in (0, 1)} | {(200 + i // 9, 200 + i % 7) for i in range(40)}
    rows = [(w, f"w{w}", f"{w % 5} alpha beta", r, f"r{r}", f"{r % 5} alpha gamma", round(rng.random(), 3), rng.choice((0.0, 0.7, 0.9, 1.0)), rng.choice((0.2, 0.5, 1.0))) for w, r in sorted(edges)]
    cands = spark.createDataFrame(rows, "wid long, key string, ww string, rno long, rid string, rw string, t double, s double, y double")
    written, write = [], softlink.cut
    monkeypatch.setattr(softlink, "cut", lambda df, name="part": written.append(name) or write(df, name))
    found = lambda: {(r["key"], r["rid"]): r["confidence"] for r in softlink.infer(softlink.ground(cands), tolerance=1e-5).collect()}
    got = found()
    assert "admm" not in written and len(got) == len(rows)
    monkeypatch.setattr(softlink, "PER_TASK", 1)
    assert (want := found()).keys() == got.keys() and "admm" in written
    assert max(abs(got[k] - want[k]) for k in want) < 1e-3 and sum(x > 0.5 for x in want.values()) > 10
    assert all(got[f"w{w}", f"r{r}"] < 1e-3 for w, _, _, r, _, _, t, _, _ in rows if t <= softlink.UNLIKE and all(x[0] != w and x[3] != r for x in rows if x[6] > softlink.UNLIKE))


def test_near_names_are_those_of_brute_force(spark):
    """Every name within reach on either side of LONG letters, and no other."""
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdeé") for _ in range(rng.choice([4, 5, 7, 8, 9, 12, 22, 23, 24, 25, 26, 27, 40]))) for _ in range(130)]

    def edit(w):
        i, how = rng.randrange(len(w)), rng.randrange(4)
        return w[:i] + w[i + 1 :] if how == 0 else w[:i] + rng.choice("abxé") + w[i:] if how == 1 else w[:i] + "x" + w[i + 1 :] if how == 2 else w[:i] + w[i : i + 2][::-1] + w[i + 2 :]

    every = sorted({w for b in base for w in (b, edit(b), edit(edit(b)), edit(edit(edit(b))))})
    rows = [(w, k % 3 != 0, k % 3 != 1) for k, w in enumerate(every)]

    def within(a, b):
        d = lev(a, b)
        apart = [i for i in range(min(len(a), len(b))) if a[i] != b[i]]
        swap = len(a) == len(b) and len(apart) == 2 and apart[1] == apart[0] + 1
        return d if min(len(a), len(b)) >= 4 and (d == 1 or d == 2 and (swap or min(len(a), len(b)) >= 8)) else None

    want = {(a, b, d) for a, ours, _ in rows if ours for b, _, theirs in rows if theirs and a != b and (d := within(a, b))}
    got = [tuple(r) for r in names.near_names(spark.createDataFrame(rows, "name string, ours boolean, theirs boolean")).collect()]
    assert len(want) > 200 and set(got) == want and len(got) == len(want)


def test_linkage_of_common_names_is_spread(spark, monkeypatch):
    """Names whose rows do not fit in a task give the same candidates as those that do."""
    rng = random.Random(9)
    words = "clear theory metal bridges heavy loads river sediment plain methods strict tensions".split()
    title = lambda: " ".join(rng.sample(words, 5))
    w = [(f"k{k}", rng.choice(["smithson", "smitshon", "jonesby", "stavr.", ""]), 1999, title()) for k in range(60)]
    a = [(f"A{k}", title(), 1999 + k % 9, rng.choice([["J. Smithson", "K. Jonesby"], ["Stavroula, K."], []])) for k in range(60)]
    works = softlink.prepare_works(spark.createDataFrame(w, "key string, surname string, year int, title string"), "key", "surname", "year", "title")
    recs = softlink.prepare_records(spark.createDataFrame(a, "openalex string, title string, year int, authors array<string>"), "openalex", "authors", "year", "title")
    found = lambda: sorted((r["key"], r["rid"], r["t"], r["s"], r["y"]) for r in softlink.candidates(works, recs).collect())
    plain = found()
    monkeypatch.setattr(softlink, "MOST", 3)
    spread = found()
    # by brute force
    bare = lambda t: [x for x in softlink.title_words(t)]
    near = lambda x, y: x == y or {x, y} == {"smithson", "smitshon"}
    want = set()
    for key, name, _, t in w:
        for rid, u, year, people in a:
            keys = {k for p in people for k in softlink.author_keys(p)}
            if name and people:
                met = any(near(name, k) or name == "stavr." and k == "stavroula" for k in keys) and not softlink._near_pairs(bare(t)).isdisjoint(softlink._near_pairs(bare(u)))
            else:
                met = abs(1999 - year) <= 5 and not softlink._triples(bare(t)).isdisjoint(softlink._triples(bare(u)))
            if met:
                want.add((key, rid))
    assert plain == spread and len(plain) > 100 and {x[:2] for x in plain} == want


def test_linkage_shuffles_in_proportion_to_its_rows(spark):
    """No strings of word pairs and triples go through the shuffle: less than 800 bytes for each row of the input."""
    sf, context = "/root/testdata/sf0.1", spark.sparkContext
    rows = sum(spark.read.parquet(f"{sf}/{t}.parquet").count() for t in ("work", "authority"))

    def stages():
        context._jsc.sc().listenerBus().waitUntilEmpty()
        got = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), None)
        return {x.stageId(): x.shuffleWriteBytes() for x in (got.apply(i) for i in range(got.size()))}

    before = stages()
    q_softlink.p2_found(spark, sf).count()
    assert 0 < sum(n for k, n in stages().items() if k not in before) < 800 * rows


def test_names_in_other_scripts(spark):
    """Equal or near family names link in every script; different ones, and names without letters, never do."""
    d = spark.createDataFrame([(x,) for x in ("Иванов, Пётр", "Иваноф, Пётр", "Сидоров, Пётр", "王, 伟", "李, 伟", "?, ?", "--, --", "Smithson, J", "Smithson, John", "Smithson, Mary")], "name string")
    got = {(r["name_1"], r["name_2"]) for r in names.person_pairs(d).collect()}
    assert got == {("Иванов, Пётр", "Иваноф, Пётр"), ("Smithson, J", "Smithson, John")}
    uses = spark.createDataFrame([("иванов", "w"), ("иванав", "w"), ("сидоров", "w"), ("王", "w"), ("李", "w"), ("stavr.", "w"), ("stavroula", "w"), ("stavrinou", None)], "name string, evidence string")
    assert {(r["name_1"], r["name_2"]) for r in names.surname_pairs(uses).collect()} == {("иванав", "иванов"), ("stavr.", "stavroula")}


# ---- residue


def test_trusted_passages():
    for p in ("404 Not Found", "Please enable JavaScript to view this document.", "Dear {{name}},", "Title: TBC", "[object Object]", "Lorem ipsum dolor sit amet consectetur adipiscing", "Verify you are human by completing the action below.", "<insert abstract here>"):
        assert residue.trusted(p), p
    for p in ("An internal server error interrupted the survey for 3 minutes and the wave was repeated.", "The templating layer replaces tokens such as {{name}} at build time, which took 3 ms.", "Students often left the prompt '[insert title]' in drafts, and 3 cases were coded by hand.", "A plain sentence about bridges."):
        assert not residue.trusted(p), p


def test_residue_records(spark):
    rng = random.Random(0)
    good = lambda: " ".join(f"The {rng.choice('abcdefgh')}{rng.randrange(60)}word studied term{rng.randrange(90)} with care." for _ in range(4))
    rows = [(i, good()) for i in range(300)] + [(1000 + i, good() + "\n" + rng.choice(["Page not found.", "Access denied.", "Your deposit {{title}} is open."])) for i in range(20)] + [(2000, None), (2001, ""), (2002, "  ")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc"] for r in residue.residue_records(d, "doc_id", "text").collect()} == set(range(1000, 1020))
    assert residue.residue_records(d.where("doc_id < 300"), "doc_id", "text").count() == 0
    assert residue.residue_records(d.limit(0), "doc_id", "text").count() == 0


def test_residue_is_decided_by_the_model(spark):
    """An author's sentence that happens to match a trusted pattern is kept if its log-odds say so."""
    rng = random.Random(0)
    good = lambda: " ".join(f"The {rng.choice('abcdefgh')}{rng.randrange(60)}word studied term{rng.randrange(90)} with care." for _ in range(4))
    odd = "The a1word studied access denied term5 with care."
    assert residue.trusted(odd)
    rows = [(i, good()) for i in range(300)] + [(1000 + i, good() + "\n" + ("Page not found.", "Access denied.")[i % 2]) for i in range(20)] + [(3000, good() + "\n" + odd)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = residue.residue_records(d, "doc_id", "text").collect()
    assert {r["doc"] for r in got} == set(range(1000, 1020)) and all(r["log_odds"] > 0 for r in got)


def test_residue_without_any_pattern_is_found(spark):
    """Messages of no trusted shape come out by the words they share with trusted ones."""
    rng = random.Random(0)
    good = lambda: " ".join(f"The {rng.choice('abcdefgh')}{rng.randrange(60)}word studied term{rng.randrange(90)} with care." for _ in range(4))
    known = ["Sorry, something went wrong on our server.", "Your session has expired.", "Please try again later.", "Page not found on this server."]
    new = "Sorry, your page has expired, please try our server."
    assert not residue.trusted(new)
    d = spark.createDataFrame([(i, good()) for i in range(300)] + [(1000 + i, known[i % 4]) for i in range(20)] + [(4000, new)], "doc_id long, text string")
    assert {r["doc"] for r in residue.residue_records(d, "doc_id", "text").collect()} == {*range(1000, 1020), 4000}


# ---- subjects


def test_subjects(spark):
    rng = random.Random(4)
    topics = {"law": ["bail decisions", "jury trials", "legal aid", "privacy torts"], "sport": ["judo throws", "rowing crews", "sprint starts", "goal kicking"], "arts": ["oral poetry", "stage lighting", "folk melodies", "script fonts"]}
    rows, truth = [], {}
    for i in range(240):
        own = rng.sample(sorted(topics), 2 if i % 8 == 0 else 1)
        truth[i] = set(own)
        said = [rng.choice(topics[own[k % len(own)]]) for k in range(6)]
        rows.append((i, f"On {said[0]} and {said[1]}", ". ".join(f"The {t} of x{rng.randrange(999)}" for t in said) + ".", rng.choice(own) if rng.random() < 0.7 else rng.choice(["", None, "Law", "unknown"]), 0.6))
    rows += [(900, None, None, "sport", None), (901, None, None, None, None)]
    d = spark.createDataFrame(rows, "docid int, title string, abstract string, discipline string, discipline_conf double")
    got = defaultdict(set)
    for r in subjects.subject_areas(d, [("law", "courts"), ("sport", "games"), ("arts", "stage")], ("docid", "title", "abstract", "discipline", "discipline_conf")).collect():
        got[r["doc"]].add(r["subject"])
    assert sum(got[i] == truth[i] for i in range(240)) >= 228
    assert got[900] == {"sport"} and 901 not in got
    # leaves are labelled by their terms: a few hints do, and without any the descriptions
    bare = d.withColumn("discipline", F.when(F.col("docid") % 20 == 0, F.col("discipline")))
    for rows, about in ((bare, [("law", "courts"), ("sport", "games"), ("arts", "stage")]), (d.withColumn("discipline", F.lit(None).cast("string")), [("law", "trials and torts"), ("sport", "throwing, rowing, kicking and sprints"), ("arts", "stage lights, melodies and poetry")])):
        got = defaultdict(set)
        for r in subjects.subject_areas(rows, about, ("docid", "title", "abstract", "discipline", "discipline_conf")).collect():
            got[r["doc"]].add(r["subject"])
        assert sum(got[i] == truth[i] for i in range(240)) >= 216


# ---- scans


def decoder():
    words = "the an and of a narrow framework supported river sediment regular conflicts with internal baselines household savings in".split()
    return scans.Decoder({w: 400 for w in words})


@pytest.mark.parametrize("text, want", [
    ("The frame¬\nwork supported river sediment with internal baselines.", "The framework supported river sediment with internal baselines."),
    ("The narrow f r a m e w o r k supported river sediment and savings.", "The narrow framework supported river sediment and savings."),
    ("The narrowframework supported river sediment and household savings.", "The narrow framework supported river sediment and household savings."),
    ("The narrow framcwork supported rivcr sedimerit and household savings.", "The narrow framework supported river sediment and household savings."),
    ("The narrow framework - iv - supported river sediment and savings.", "The narrow framework supported river sediment and savings."),
    ("The narrow framework Chapter 2 Scope | v supported river sediment.", "The narrow framework supported river sediment."),
])
def test_repairs(text, want):
    got, found = scans.read_row(text, None, decoder())
    assert got == want and found


@pytest.mark.parametrize("text", ["The narrow framework supported river sediment\nwith internal baselines (p. 61).", "The narrow framework supported river sediment; see Chapter 5.", "Following Salminn, the narrow framework supported savings [112].", "The narrow framework supported river sediment on page 29."])
def test_clean_rows_stay(text):
    got, found = scans.read_row(text, "A title of some length here", decoder())
    assert not found


def test_number_rows():
    for t in ("v", "- iv -", "[p. 12]", "Page 3"):
        assert scans.read_row(t, None, decoder())[1] == ["furniture"]


def test_paragraph_breaks_follow_headings():
    p = scans.best_breaks(np.array([30] * 8), np.array([0, 0, 0, 1, 0, 0, 0, 0.0]))
    assert p[2] != p[3] and len(set(p)) < 8


def test_scan_tables(spark):
    rows = [("d", i, t, 1, None, "x", "h", []) for i, t in enumerate(["The narrow framework supported the river sediment with savings."] * 12 + [None, "", "iv", "The narrow framewo¬\nrk supported the river sediment with savings."])]
    s = spark.createDataFrame(rows + rows[:3], "doc_id string, idx int, text string, page int, printed string, bucket string, heading string, excl array<string>")
    titles = spark.createDataFrame([("d", "On things"), ("d", None)], "doc_id string, title string")
    r = scans.repair(s, titles)
    assert {x["idx"] for x in r.where("size(found) > 0").collect()} == {14, 15}
    p = scans.paragraphs(r).collect()
    assert " ".join(x["text"] for x in sorted(p, key=lambda x: x["first_idx"])).count("framework") == 13
    assert scans.repair(s.limit(0), titles).count() == 0


def test_lexicon_leaves_out_what_only_scans_contain(spark):
    """Noise stays noise however often a larger corpus repeats it."""
    clean = "The narrow framework supported the river sediment rather than a remote expansion of savings."
    noisy = "The narrow framework supported the river sediment ratherthana remote expansion ofthe savings."
    rows = [(f"c{k}", i, clean, 1, "x", "h") for k in range(20) for i in range(5)] + [(f"s{k}", i, noisy if i == 0 else clean, 1, "x", "h") for k in range(8) for i in range(5)]
    s = spark.createDataFrame(rows, "doc_id string, idx int, text string, page int, bucket string, heading string")
    titles = spark.createDataFrame([(f"{c}{k}", None, c == "s") for c, n in (("c", 20), ("s", 8)) for k in range(n)], "doc_id string, title string, scanned boolean")
    got = scans.repair(s, titles).where("size(found) > 0").collect()
    assert {(r["doc_id"], r["idx"]) for r in got} == {(f"s{k}", 0) for k in range(8)}
    assert all("rather than a remote" in r["repaired"] for r in got)


def test_paragraphs_of_long_records(spark):
    """No break is forced at a multiple of 400 rows, nor after 60 short sentences."""
    rng = random.Random(3)
    long = [rng.choice([4, 9, 17, 30, 140]) for _ in range(900)]
    for words in ([1] * 160, long[:130]):
        change = np.array([rng.choice([0, 0, 0.3, 0, 0]) for _ in words])
        total, n = np.cumsum([0, *words]), len(words)
        best, back = [0.0] + [np.inf] * n, [0] * (n + 1)
        for j in range(1, n + 1):  # brute force over all starts
            cost = [best[i] + 4 * ((total[j] - total[i]) / 90 - 1) ** 2 + (6 * (1 - change[i]) if i else 0) for i in range(j)]
            best[j], back[j] = min(cost), int(np.argmin(cost))
        got = scans.best_breaks(np.array(words), change)
        starts = [i for i in range(n) if i == 0 or got[i] != got[i - 1]]
        price = sum(4 * ((total[b] - total[a]) / 90 - 1) ** 2 + (6 * (1 - change[a]) if a else 0) for a, b in zip(starts, starts[1:] + [n]))
        assert abs(price - best[n]) < 1e-9
    rows = [("d", i, "w " * k, 1, "x", "h") for i, k in enumerate(long)]
    d = spark.createDataFrame(rows, "doc_id string, idx int, repaired string, page int, bucket string, heading string")
    want = scans.best_breaks(np.array(long), np.zeros(900))
    got = sorted((r["first_idx"], r["last_idx"]) for r in scans.paragraphs(d).collect())
    assert got == [(int(np.flatnonzero(want == p)[0]), int(np.flatnonzero(want == p)[-1])) for p in range(want.max() + 1)]
