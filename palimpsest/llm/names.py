"""Variant spellings of names: metric-space partitioning and exact radius joins.

1. Names are parsed to a *key* (folded letters of the family name, without particles) and given
   names; only distinct keys are joined.
2. A tree of pivots splits the keys by their edit distance to a pivot: at a node with pivot p
   and cut m, keys with d <= m + r go inside and keys with d > m outside.  A pair within r of each
   other then meets in a common leaf, by the triangle inequality; the keys between m and m + r
   stand on both sides.  Pivots need not be names: the empty string (distance = length) and long
   strings of one letter (distance = length less the count of that letter) spread names best.
   The tree is built from a bounded sample; a node is split only while that pays.
3. Each leaf is cut into blocks and joined block against block, so no task holds a whole
   leaf.  In a block pair, distances to the reference pivots and letter counts drop pairs that
   cannot be within r (exact lower bounds), and the Levenshtein distance decides the rest.

The key pairs then lead to name pairs, whose given names must agree.

Null and blank names are left out; empty tables give empty results; repeated names count once.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from palimpsest.plans.runtime import cut, partitions

RADIUS, SAMPLE, LEAF, GAIN, BLOCK = 2, 2000, 60, 0.9, 3000
LONG = 24  # letters up to which near names are looked for by letters taken out
LEAST_ONE, LEAST_TWO, STEM = 5, 8, 4  # letters of a family name one and two edits from another; letters of one cut short

# fixed values: letters without a decomposition, particles, titles
_LETTERS = str.maketrans({"ø": "o", "æ": "ae", "œ": "oe", "ß": "ss", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "ı": "i"})
PARTICLES = {"van", "von", "de", "der", "den", "di", "da", "du", "del", "della", "la", "le", "ter", "ten", "zu", "af", "av"}
TITLES = {"dr", "prof", "professor", "mr", "mrs", "ms", "miss", "sir", "dame", "rev", "phd", "author"}
# fixed values: usual short forms of given names
NICKNAMES = {
    "alexander": "alex al sandy xander lex", "andrew": "andy drew", "barbara": "barb babs barbie", "benjamin": "ben benny benji", "catherine": "cathy kate katie cath kitty",
    "christina": "chris tina chrissie christy", "christopher": "chris kit", "daniel": "dan danny", "dorothy": "dot dottie dolly dora", "edward": "ed eddie ted ned teddy", "elizabeth": "liz beth betty eliza lizzie bess libby",
    "francesca": "fran frankie chess cesca", "frederick": "fred freddie freddy", "gabriel": "gabe", "gregory": "greg", "harold": "harry hal", "henrietta": "hettie etta hattie henny", "inés": "inez nes", "isabella": "bella izzy isa belle",
    "james": "jim jimmy jamie", "john": "jack johnny", "jonathan": "jon jonny jonty", "joseph": "joe joey", "josephine": "josie jo", "jürgen": "jupp juergen jogi", "kimberley": "kim kimmy", "lawrence": "larry laurie lawrie", "leonard": "len lenny leo",
    "margaret": "maggie meg peggy peg marge madge", "matthew": "matt matty", "michael": "mike mick mickey", "nathaniel": "nat nate nathan", "nicholas": "nick nicky nico", "oliver": "ollie olly", "patricia": "pat patty trish tricia patsy", "penelope": "penny pen nell",
    "peter": "pete", "philip": "phil pip", "quentin": "quin quent", "rebecca": "becky becca beck", "rené": "ren", "richard": "rick dick rich", "robert": "rob bob bobby robbie bert", "samantha": "sam sammy", "samuel": "sam sammy", "stephen": "steve", "susannah": "sue susie suzy susan sukie",
    "theodore": "theo ted teddy", "thomas": "tom tommy", "ursula": "ursi ulla", "victoria": "vicky vic tori vicki", "vincent": "vince vinnie vin", "william": "will bill billy liam willie", "winifred": "win winnie freda", "yolanda": "yola yoli landa", "zachary": "zach zack zac zak", "zoë": "zoe zo",
}


def fold(s: str) -> str:
    if s.isascii():
        return s.lower()
    s = unicodedata.normalize("NFKD", s.lower().translate(_LETTERS))
    return "".join(c for c in s if not unicodedata.combining(c))


_FULL: dict[str, set[str]] = {}
for _name, _short in NICKNAMES.items():
    for _s in _short.split():
        _FULL.setdefault(_s, set()).add(fold(_name))


def key_of(s: str) -> str:
    """Letters of a family name in any script, without particles; '' if it has none."""
    if s.isascii() and s.isalpha():
        return s.lower()
    parts = [w for w in re.split(r"(?:[^\w']|[\d_])+", fold(s)) if w]
    kept = [w for w in parts if w not in PARTICLES] or parts
    return "".join(kept).replace("'", "")


def parse_person(name: str, givens: set[str]) -> tuple[str, str, str, bool]:
    """(key, given, middle, abbreviated key) of a person's name in any usual form; ``givens`` are known given names."""
    s = re.sub(r"\([^)]*\)|\[[^]]*\]", " ", fold(name)).strip()
    if "," in s:
        family, _, rest = s.partition(",")
        rest_words = [w for w in re.split(r"[\s.,]+", rest) if w]
        if len(rest_words) > 1 or (rest_words and rest.startswith(" ")):  # ",dr" without a blank is a pair of initials
            rest_words = [w for w in rest_words if w not in TITLES]
        family = " ".join(w for w in family.split() if w.strip(".") not in TITLES)
    else:
        words = [w for w in re.split(r"[\s.]+", s) if w and w not in TITLES]
        known = [w in givens or w in _FULL for w in words]
        if len(words) < 2:
            return key_of(s), "", "", s.endswith(".")
        if known[-1] and not known[0] and len(words[0]) > 1:  # family name first
            at = next(i for i in range(len(words)) if known[i] and all(known[i:]) or i == len(words) - 1)
            family, rest_words = " ".join(words[:at]), words[at:]
        elif len(words[-1]) == 1 and len(words[0]) > 1 and not known[0]:
            at = next(i for i in range(1, len(words)) if len(words[i]) == 1)
            family, rest_words = " ".join(words[:at]), words[at:]
        else:
            at = len(words) - 1
            while at > 1 and words[at - 1] in PARTICLES:
                at -= 1
            family, rest_words = " ".join(words[at:]), words[:at]
    if len(rest_words) == 1 and len(rest_words[0]) == 2 and rest_words[0] not in givens and rest_words[0] not in _FULL:
        rest_words = list(rest_words[0])
    given = rest_words[0] if rest_words else ""
    middle = rest_words[1][:1] if len(rest_words) > 1 else ""
    return key_of(family), given, middle, False


def parse_surname(name: str) -> tuple[str, bool]:
    """(key, abbreviated) of a family name that may carry initials."""
    s = fold(name)
    words = [w for w in re.split(r"[\s,]+", s) if w and not re.fullmatch(r"(?:[a-z]\.?){1}(?:[a-z]\.)*", w) and w.strip(".") not in TITLES]
    return key_of(" ".join(words) or s), bool(words) and words[-1].endswith(".") and len(words[-1]) > 4


# ---- the metric


def _codes(keys) -> tuple[np.ndarray, np.ndarray]:
    n = np.array([len(k) for k in keys], "int64")
    out = np.zeros((len(keys), max(1, n.max(initial=0))), "uint8" if all(map(str.isascii, keys)) else "uint32")
    for i, k in enumerate(keys):
        out[i, : len(k)] = np.frombuffer(k.encode("ascii"), "uint8") if out.dtype == "uint8" else np.frombuffer(k.encode("utf-32-le"), "uint32")
    return out, n


def levenshtein(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Row-wise distances of padded code rows."""
    wide = b.shape[1]
    row = np.tile(np.arange(wide + 1, dtype="int16"), (len(a), 1))
    out = np.where(na == 0, nb, 0).astype("int16")
    step = np.arange(wide + 1, dtype="int16")
    for i in range(a.shape[1]):
        diff = np.minimum(row[:, 1:] + 1, row[:, :-1] + (a[:, i : i + 1] != b))
        new = np.concatenate([np.full((len(a), 1), i + 1, "int16"), diff], axis=1)
        row = (np.minimum.accumulate(new - step, axis=1) + step).astype("int16")  # insertions along the row
        done = na == i + 1
        if done.any():
            out[done] = row[done, nb[done]]
    return out


def to_pivot(keys, pivot: str) -> np.ndarray:
    a, na = _codes(keys)
    b, nb = _codes([pivot])
    out = np.zeros(len(keys), "int16")
    for k in range(0, len(keys), 20_000):
        s = slice(k, k + 20_000)
        out[s] = levenshtein(a[s], na[s], np.repeat(b, len(a[s]), 0), np.repeat(nb, len(a[s])))
    return out


def transposed(a: str, b: str) -> bool:
    """One swap of neighbours makes a into b."""
    d = [i for i in range(len(a)) if len(a) == len(b) and a[i] != b[i]]
    return len(a) == len(b) and len(d) == 2 and d[1] == d[0] + 1 and a[d[0]] == b[d[1]] and a[d[1]] == b[d[0]]


def build_tree(sample: list[str], r: int, leaf: int = LEAF, gain: float = GAIN, depth: int = 7):
    """None (a leaf) or (pivot, cut, inside, outside)."""
    if len(sample) <= leaf or depth == 0:
        return None
    longest = max(map(len, sample))
    tries = ["", *[c * longest for c in "aeioustrnlm"], *sorted(sample)[:: max(1, len(sample) // 6)]]
    best, cost0 = None, float(len(sample)) ** 2
    for p in tries:
        d = to_pivot(sample, p)
        for m in np.unique(np.quantile(d, [0.3, 0.4, 0.5, 0.6]).astype(int)):
            a, b = int((d <= m + r).sum()), int((d > m).sum())
            cost = float(a) ** 2 + float(b) ** 2
            if best is None or cost < best[0]:
                best = (cost, p, int(m), d)
    if best[0] > gain * cost0:
        return None
    _, p, m, d = best
    x = np.array(sample, object)
    return p, m, build_tree(list(x[d <= m + r]), r, leaf, gain, depth - 1), build_tree(list(x[d > m]), r, leaf, gain, depth - 1)


def leaves(keys: np.ndarray, tree, r: int, path: int = 1) -> list[tuple[np.ndarray, int]]:
    """(positions, leaf number) of all keys, boundary keys on both sides."""
    at = np.arange(len(keys))
    out: list[tuple[np.ndarray, int]] = []
    todo = [(at, tree, path)]
    while todo:
        at, node, path = todo.pop()
        if not len(at):
            continue
        if node is None:
            out.append((at, path))
            continue
        p, m, inside, outside = node
        d = to_pivot(list(keys[at]), p)
        todo += [(at[d <= m + r], inside, path * 2), (at[d > m], outside, path * 2 + 1)]
    return out


def _within(x: list[str], y: list[str], r: int, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions and distances of pairs within r, by lower bounds and then the distance itself."""
    a, na = _codes(x)
    b, nb = _codes(y)

    def marks(c: np.ndarray) -> np.ndarray:
        """Bits for a class of letters (by code, modulo 26) that occurs, and that occurs twice: an edit changes at most two."""
        out = np.zeros(len(c), "uint64")
        kind = np.where(c > 0, c % 26, 26)
        for k in range(26):
            n = (kind == k).sum(axis=1)
            out |= (n > 0).astype("uint64") << np.uint64(k)
            out |= (n > 1).astype("uint64") << np.uint64(26 + k)
        return out

    ma, mb = marks(a), marks(b)
    out = []
    for i in range(0, len(x), 512):
        near = np.bitwise_count(ma[i : i + 512, None] ^ mb[None, :]) <= 2 * r
        near &= np.abs(na[i : i + 512, None] - nb[None, :]) <= r
        p, q = np.nonzero(near)
        p = p + i
        if same:
            keep = p < q
            p, q = p[keep], q[keep]
        for k in range(0, len(p), 100_000):
            pp, qq = p[k : k + 100_000], q[k : k + 100_000]
            d = levenshtein(a[pp], na[pp], b[qq], nb[qq])
            hit = d <= r
            out.append((pp[hit], qq[hit], d[hit]))
    if not out:
        e = np.zeros(0, "int64")
        return e, e, e
    return tuple(np.concatenate(z) for z in zip(*out))


def radius_join(keys: DataFrame, r: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """(ka, kb, d): pairs of distinct keys (column ``key``) within Levenshtein distance r, ka < kb."""
    spark = keys.sparkSession
    keys = cut(keys.select("key").where(F.length("key") > 0).distinct(), "keys")
    sample = [r_["key"] for r_ in keys.orderBy(F.xxhash64("key")).limit(SAMPLE).collect()]
    tree = build_tree(sample, r)

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            k = pdf["key"].to_numpy()
            for at, leaf in leaves(k, tree, r):
                yield pd.DataFrame({"leaf": leaf, "key": k[at]})

    routed = cut(keys.repartition(partitions(spark)).mapInPandas(route, "leaf long, key string"), "routed")
    sizes = routed.groupBy("leaf").agg(F.ceil(F.count("*") / block).cast("int").alias("nb"))
    home = routed.join(F.broadcast(sizes), "leaf").withColumn("blk", F.pmod(F.xxhash64("key"), "nb").cast("int"))
    cells = home.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    cells = cells.select("leaf", F.least("blk", "o").alias("x"), F.greatest("blk", "o").alias("y"), "blk", "key")

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf["x"].iloc[0], pdf["y"].iloc[0]
        k, blk = pdf["key"].to_numpy(), pdf["blk"].to_numpy()
        kx = sorted(set(k[blk == x]))
        ky = kx if x == y else sorted(set(k[blk == y]))
        if not kx or not ky:
            return pd.DataFrame({"ka": [], "kb": [], "d": []})
        p, q, d = _within(kx, ky, r, x == y)
        a, b = np.array(kx, object)[p], np.array(ky, object)[q]
        return pd.DataFrame({"ka": np.where(a < b, a, b), "kb": np.where(a < b, b, a), "d": d.astype("int32")})

    return cells.groupBy("leaf", "x", "y").applyInPandas(meet, "ka string, kb string, d int").distinct()


def _signs(keys: list[str], n: int) -> np.ndarray:
    """Hashes of the strings left when no letter, one or two (below 8 letters: two that adjoin) are taken from keys of n letters, a row for each key."""
    c = _codes(keys)[0].astype("uint64")
    v = (c + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    v = (v ^ (v >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    power = np.cumprod(np.full(n, 0x94D049BB133111EB, "uint64")) if n else np.zeros(0, "uint64")
    # sums[d][:, k]: letters before k, moved by d places to the front
    sums = []
    for d in range(3):
        t = np.zeros((len(keys), n + 1), "uint64")
        t[:, d + 1 :] = np.cumsum(v[:, d:] * power[: n - d], axis=1, dtype="uint64")
        sums.append(t)
    s0, s1, s2 = sums
    i = np.arange(n)
    out = [s0[:, n:], s0[:, i] + s1[:, n:] - s1[:, i + 1]]
    i, j = np.triu_indices(n, 1) if n >= LEAST_TWO else (i[:-1], i[1:])
    out.append(s0[:, i] + s1[:, j] - s1[:, i + 1] + s2[:, n:] - s2[:, j + 1])
    size = n - np.repeat(np.arange(len(out)), [o.shape[1] for o in out])
    return (np.concatenate(out, axis=1) + size.astype("uint64") * np.uint64(0xD6E8FEB86659FD93)).view("int64")


def _pieces(n: int) -> list[tuple[int, int]]:
    """(start, end) of the three parts of a string of n letters."""
    at = [0, n // 3, 2 * n // 3, n]
    return list(zip(at, at[1:]))


def near_names(names: DataFrame) -> DataFrame:
    """(name, other, d): names (``name``, ``ours``, ``theirs``; distinct) of ours and different ones of theirs, of 4 letters or more,
    one edit apart, or different at two adjoining places (as after a swap), or two edits apart from 8 letters on.

    Exact, and linear in the names: strings so near have a string in common that both become when letters are taken out, one of each
    (two of each for two edits).  Names of theirs above ``LONG`` letters have one of three parts unchanged, moved by two places
    at most, as two edits touch two parts.  Hashes of these only choose the pairs; the distance decides.
    """
    names = names.where(F.length("name") >= STEM).select("name", "ours", "theirs").repartition(partitions(names.sparkSession))
    names = cut(names.withColumn("no", F.monotonically_increasing_id()), "numbered")

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            lengths = pdf["name"].str.len().to_numpy()
            # the number of a name, whether it asks, whether it answers
            code = pdf["no"].to_numpy() * 4 + pdf["ours"].to_numpy() * 2 + pdf["theirs"].to_numpy()
            for n in np.unique(lengths):
                at = np.flatnonzero(lengths == n)
                if n <= LONG + RADIUS:
                    for k in range(0, len(at), 5000):
                        p = at[k : k + 5000]
                        h = _signs(list(pdf["name"].iloc[p]), int(n))
                        yield pd.DataFrame({"h": h.ravel(), "code": np.repeat(code[p] & (-1 if n <= LONG else -2), h.shape[1])})
                if n > LONG - RADIUS:
                    rows = []
                    for name, c in zip(pdf["name"].iloc[at], code[at]):
                        if c & 1 and n > LONG:
                            rows += [(n, k, name[a:b], c & -3) for k, (a, b) in enumerate(_pieces(n))]
                        if c & 2:
                            wanted = {(m, k, name[a + by : b + by]) for m in range(max(n - RADIUS, LONG + 1), n + RADIUS + 1) for k, (a, b) in enumerate(_pieces(m)) for by in range(-RADIUS, RADIUS + 1) if 0 <= a + by and b + by <= n}
                            rows += [(*w, c & -2) for w in wanted]
                    if rows:
                        yield pd.DataFrame({"h": [(int(m) * 3 + k << 32) + zlib.crc32(part.encode()) for m, k, part, _ in rows], "code": [r[3] for r in rows]})

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = list(batches)
        if not got:
            return
        h, code = (np.concatenate([x[c].to_numpy() for x in got]) for c in ("h", "code"))
        order = np.argsort(h, kind="stable")
        h, code = h[order], code[order]
        i, step, found, n = np.arange(len(h)), 1, [], 0
        while len(i):  # rows with a row of the same hash ``step`` further on
            i = i[i + step < len(h)]
            i = i[h[i] == h[i + step]]
            a, b = code[i], code[i + step]
            one, two = (a & 2 > 0) & (b & 1 > 0), (b & 2 > 0) & (a & 1 > 0)
            x, y = np.concatenate([a[one], b[two]]) >> 2, np.concatenate([b[one], a[two]]) >> 2
            found.append(np.stack([x[x != y], y[x != y]], axis=1))
            n, step = n + len(found[-1]), step + 1
            if n > 1_000_000 or not len(i):
                p = np.unique(np.concatenate(found), axis=0)
                yield pd.DataFrame({"x": p[:, 0], "y": p[:, 1]})
                found, n = [], 0

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            (a, na), (b, nb) = _codes(list(pdf["name"])), _codes(list(pdf["other"]))
            d = levenshtein(a, na, b, nb)
            wide = min(a.shape[1], b.shape[1])
            apart = a[:, :wide] != b[:, :wide]
            swap = (na == nb) & (apart.sum(axis=1) == 2) & (apart[:, 1:] & apart[:, :-1]).any(axis=1)
            keep = (d == 1) | ((d == 2) & (swap | (np.minimum(na, nb) >= LEAST_TWO)))
            yield pdf.assign(d=d.astype("int32"))[keep]

    signed = names.mapInPandas(sign, "h long, code long")
    parts = max(partitions(names.sparkSession), names.count() // 20_000)
    met = signed.repartition(parts, "h").mapInPandas(meet, "x long, y long").distinct()
    met = met.join(names.select(F.col("no").alias("x"), "name"), "x").join(names.select(F.col("no").alias("y"), F.col("name").alias("other")), "y").select("name", "other")
    return met.mapInPandas(decide, "name string, other string, d int")


# ---- names


def known_givens(people: DataFrame, share: float = 0.0005, least: int = 5) -> set[str]:
    """Given names in at least ``share`` of the names: at most a few / share of them."""
    total = people.count()
    words = people.select(F.explode(F.split(F.lower("name"), r"[\s.,()]+")).alias("w")).where(F.length("w") > 2)
    rows = words.groupBy("w").agg(F.count("*").alias("n")).where(F.col("n") >= max(least, share * total)).collect()
    return {fold(r["w"]) for r in rows} - TITLES - PARTICLES


def full_forms(given: str, givens: set[str]) -> list[str]:
    """Known given names that ``given`` may stand for; itself if none."""
    if len(given) < 2:
        return [given]
    if given in givens:
        return [given]
    out = {g for g in _FULL.get(given, ()) if g in givens}
    if not out and len(given) > 2:
        out = {g for g in givens if g.startswith(given)}
    if not out:
        c, n = _codes([given])
        near = [g for g in sorted(givens) if abs(len(g) - len(given)) <= 2]
        if near:
            b, nb = _codes(near)
            d = levenshtein(np.repeat(c, len(near), 0), np.repeat(n, len(near)), b, nb)
            out = {g for g, x in zip(near, d) if x <= (1 if len(given) < 6 else 2) or transposed(given, g)}
    if not out and len(given) > 2:
        out = {g for g in givens if given in g or (g[0] == given[0] and len(given) <= 5)}
    return sorted(out) or [given]


def person_pairs(people: DataFrame, r: int = RADIUS) -> DataFrame:
    """(name_1, name_2): names (column ``name``) of one person: family names within r, given names that agree."""
    people = cut(people.select("name").where(F.length("name") > 0).distinct(), "people")
    givens = known_givens(people)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for name in pdf["name"]:
                key, given, middle, _ = parse_person(name, givens)
                for g in full_forms(given, givens):
                    rows.append((name, key, g, g[:1], middle, len(given) > 1))
            yield pd.DataFrame(rows, columns=["name", "key", "given", "initial", "middle", "spelt"])

    parsed = cut(people.mapInPandas(parse, "name string, key string, given string, initial string, middle string, spelt boolean"), "parsed")
    parsed = parsed.where(F.col("key") != "")  # a name without letters is no one's spelling
    near = radius_join(parsed.select("key"), r)
    long_enough = F.least(F.length("ka"), F.length("kb")) >= F.when(F.col("d") == 1, LEAST_ONE).otherwise(LEAST_TWO)
    near = near.where(long_enough)
    both = near.select("ka", "kb").unionByName(near.select(F.col("kb").alias("ka"), F.col("ka").alias("kb"))).unionByName(parsed.select(F.col("key").alias("ka"), F.col("key").alias("kb")).distinct())
    a = parsed.select(F.col("key").alias("ka"), F.col("name").alias("na"), F.col("given").alias("ga"), "initial", F.col("middle").alias("ma"), F.col("spelt").alias("sa"))
    b = parsed.select(F.col("key").alias("kb"), F.col("name").alias("nb"), F.col("given").alias("gb"), "initial", F.col("middle").alias("mb"), F.col("spelt").alias("sb"))
    linked = a.join(both, "ka")
    # spelt names meet on the given name, an initial meets every given name it may stand for: no other pairs are looked at
    spelt = linked.where("sa").join(b.where("sb").select("kb", "nb", F.col("gb").alias("ga"), "mb"), ["kb", "ga"]).select("na", "nb", "ma", "mb")
    begun = linked.where(~F.col("sa")).join(b, ["kb", "initial"]).select("na", "nb", "ma", "mb")
    met = spelt.unionByName(begun).where(F.col("na") != F.col("nb"))
    middles = (F.col("ma") == "") | (F.col("mb") == "") | (F.col("ma") == F.col("mb"))
    return met.where(middles).select(F.least("na", "nb").alias("name_1"), F.greatest("na", "nb").alias("name_2")).distinct()


def begun_by(stems: DataFrame, keys: DataFrame) -> DataFrame:
    """(stem, key): each key (column ``key``) with the stems (column ``stem``) that begin it, by its beginnings of STEM letters or more."""
    heads = keys.where(F.length("key") > STEM).withColumn("stem", F.explode(F.transform(F.sequence(F.lit(STEM), F.length("key") - 1), lambda n: F.substring("key", 1, n))))
    return stems.join(heads, "stem")


def is_swap(a: str, b: str, d: str):
    """Column: strings at distance 2 that differ at two adjoining places, as a swap of neighbours does."""
    pos = F.filter(F.sequence(F.lit(1), F.length(a)), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)))
    return (F.col(d) == 2) & (F.length(a) == F.length(b)) & (F.size(pos) == 2) & (F.try_element_at(pos, F.lit(-1)) - F.try_element_at(pos, F.lit(1)) == 1)


def surname_pairs(uses: DataFrame, r: int = RADIUS, long: int = 10) -> DataFrame:
    """(name_1, name_2): spellings of one family name, from (name, evidence).

    Long names within distance 1 (or a swap) are one name; shorter ones, and those at
    distance 2, only if a value of ``evidence`` (a work they are cited with) is common to both and
    more than half of the shorter name is left as it is.
    A name cut short by a full stop goes with the names it begins, given such evidence.
    """
    uses = cut(uses.where(F.length("name") > 0).distinct(), "uses")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [parse_surname(x) for x in pdf["name"]]
            yield pd.DataFrame({"name": pdf["name"], "key": [g[0] for g in got], "short": [g[1] for g in got]})

    parsed = cut(uses.select("name").distinct().mapInPandas(parse, "name string, key string, short boolean"), "surnames").where(F.length("key") > 0)
    whole = parsed.where(~F.col("short"))
    near = radius_join(whole.select("key"), r).where(F.least(F.length("ka"), F.length("kb")) > 2 * F.col("d"))
    same = whole.select(F.col("key").alias("ka"), F.col("key").alias("kb"), F.lit(0).alias("d")).distinct()
    begun = begun_by(parsed.where("short").select(F.col("key").alias("stem")).distinct(), whole.select("key").distinct()).select(F.col("stem").alias("ka"), F.col("key").alias("kb"), F.lit(9).alias("d"))
    names_a, names_b = parsed.select(F.col("key").alias("ka"), F.col("name").alias("na")), parsed.select(F.col("key").alias("kb"), F.col("name").alias("nb"))
    met = near.unionByName(same).unionByName(begun).join(names_a, "ka").join(names_b, "kb").where(F.col("na") != F.col("nb")).distinct()
    size = F.least(F.length("ka"), F.length("kb"))
    sure = (F.col("d") == 0) | ((size >= long) & ((F.col("d") == 1) | is_swap("ka", "kb", "d")))
    met = cut(met.withColumn("sure", sure), "met")
    ev = uses.where(F.col("evidence").isNotNull())
    doubt = met.where(~F.col("sure"))
    backed = doubt.join(ev.select(F.col("name").alias("na"), "evidence"), "na").join(ev.select(F.col("name").alias("nb"), "evidence"), ["nb", "evidence"]).select("na", "nb").distinct()
    out = met.where("sure").select("na", "nb").unionByName(backed)
    return out.select(F.least("na", "nb").alias("name_1"), F.greatest("na", "nb").alias("name_2")).distinct()
