"""Citation graph analytics: works, co-citation, shared literature, bridges, age, coverage and field flow.

Edges are (src, surname, year, title) rows; a *work* is (surname, year).  Counting is by distinct
citing record throughout, through distinct edges first, so a work cited by a third of all
records costs one row per record and no gathered list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

Z95, MAX_AGE = 1.96, 120
WORK = ["surname", "year"]


def latest(docs: DataFrame) -> DataFrame:
    """One row per record: its last harvest."""
    cols = [c for c in docs.columns if c not in ("id", "harvested_at")]
    return docs.where(F.col("id").isNotNull()).groupBy("id").agg(F.max_by(F.struct(*cols), F.struct(F.coalesce("harvested_at", F.lit("1970-01-01").cast("timestamp")), F.coalesce("title", F.lit("")))).alias("r")).select("id", "r.*")


def edges(cites: DataFrame) -> DataFrame:
    """Distinct (src, surname, year) with a usable key."""
    return cites.select("src", F.lower(F.trim("surname")).alias("surname"), "year").where("src is not null and surname <> '' and year is not null").distinct()


def top_works(e: DataFrame) -> DataFrame:
    return e.groupBy(*WORK).agg(F.count("*").alias("citers")).where("citers > 1")


def age_edges(e: DataFrame, docs: DataFrame) -> DataFrame:
    """(src, age, reason): reason is null for usable ages, else why the edge is dropped."""
    x = e.join(docs.select(F.col("id").alias("src"), F.col("year").alias("doc_year")), "src")
    age = F.col("doc_year") - F.col("year")
    reason = F.when(F.col("doc_year").isNull(), "no thesis year").when(~F.col("doc_year").between(1900, 2026), "thesis year out of range").when(age < 0, "negative age").when(age > MAX_AGE, "too old")
    return x.withColumn("age", age).withColumn("reason", reason)


def cumulative_ages(ages: DataFrame, by: list[str]) -> DataFrame:
    """(by, age, n, upto, total) per distinct age: the basis of all quantiles of a group."""
    h = ages.groupBy(*by, "age").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*by)
    return h.withColumn("upto", F.sum("n").over(w.orderBy("age"))).withColumn("total", F.sum("n").over(w))


def first_age_at(q: float) -> Column:
    """First age at which the cumulative count reaches q of the total."""
    return F.min(F.when(F.col("upto") >= q * F.col("total"), F.col("age")))


def half_life() -> Column:
    """Interpolated age by which half of the edges lie."""
    half = F.col("total") / 2
    hit = (F.col("upto") >= half) & (F.col("upto") - F.col("n") < half)
    return F.min(F.when(hit, F.col("age") + (half - (F.col("upto") - F.col("n"))) / F.col("n") - 0.5))


def weighted_slope(x: Column, y: Column, w: Column) -> Column:
    """Least-squares slope in closed form, null for fewer than three points or no spread."""
    sw, sx, sy, sxx, sxy = F.sum(w), F.sum(w * x), F.sum(w * y), F.sum(w * x * x), F.sum(w * x * y)
    den = sw * sxx - sx * sx
    return F.when((F.count("*") >= 3) & (den != 0), (sw * sxy - sx * sy) / F.nullif(den, F.lit(0.0)))


def field_citers(e: DataFrame, fields: DataFrame) -> DataFrame:
    """(field, surname, year, n): citing records per field and work; ``fields`` is (src, field)."""
    return e.join(fields, "src").groupBy("field", *WORK).agg(F.count("*").alias("n"))


def top_field(fc: DataFrame) -> DataFrame:
    """Field with the most citers of each work (ties by name), its share, and the number of fields."""
    w = Window.partitionBy(*WORK)
    x = fc.withColumn("total", F.sum("n").over(w)).withColumn("fields", F.count("*").over(w)).withColumn("rn", F.row_number().over(w.orderBy(F.desc("n"), "field")))
    return x.where("rn = 1").select(*WORK, "field", "n", "total", "fields")


def cocitation(e: DataFrame, top: int = 260, least: int = 12) -> DataFrame:
    """Pairs of the ``top`` most cited works that at least ``least`` records cite together."""
    best = e.groupBy(*WORK).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *WORK).limit(top)
    x = e.join(F.broadcast(best.select(*WORK)), WORK).select("src", F.struct(*WORK).alias("w"))
    y = x.select("src", F.col("w").alias("v"))
    return x.join(y, "src").where(F.col("w") < F.col("v")).groupBy("w", "v").agg(F.count("*").alias("weight")).where(F.col("weight") >= least).select(F.col("w.surname").alias("surname_1"), F.col("w.year").alias("year_1"), F.col("v.surname").alias("surname_2"), F.col("v.year").alias("year_2"), "weight")


def shared_literature(node_works: DataFrame, least: int) -> DataFrame:
    """(s, t, shared, jaccard) of nodes by their sets of works; ``node_works`` is distinct (node, surname, year)."""
    size = node_works.groupBy("node").agg(F.count("*").alias("size"))
    a, b = node_works.withColumnRenamed("node", "s"), node_works.withColumnRenamed("node", "t")
    inter = a.join(b, WORK).where(F.col("s") < F.col("t")).groupBy("s", "t").agg(F.count("*").alias("shared")).where(F.col("shared") >= least)
    x = inter.join(size.withColumnRenamed("node", "s").withColumnRenamed("size", "ns"), "s").join(size.withColumnRenamed("node", "t").withColumnRenamed("size", "nt"), "t")
    return x.select("s", "t", "shared", (F.col("shared") / (F.col("ns") + F.col("nt") - F.col("shared"))).alias("jaccard"))


def bridges(fc: DataFrame, most: int = 150, side: int = 2, max_fields: int = 6) -> DataFrame:
    """Works read on several sides: few enough citers, at least two fields with ``side`` citers, not everywhere."""
    agg = fc.groupBy(*WORK).agg(F.sum("n").alias("citers"), F.count("*").alias("fields"), F.count_if(F.col("n") >= side).alias("sides"))
    return agg.where((F.col("citers") <= most) & (F.col("sides") >= 2) & (F.col("fields") <= max_fields))


def field_pair_lift(fc: DataFrame) -> DataFrame:
    """(f, g, works, expected, lift): works two fields both cite against chance."""
    n = fc.select(*WORK).distinct().count()
    one = fc.groupBy("field").agg(F.count("*").alias("k"))
    a, b = fc.select(*WORK, F.col("field").alias("f")), fc.select(*WORK, F.col("field").alias("g"))
    both = a.join(b, WORK).where("f < g").groupBy("f", "g").agg(F.count("*").alias("works"))
    x = both.join(one.select(F.col("field").alias("f"), F.col("k").alias("kf")), "f").join(one.select(F.col("field").alias("g"), F.col("k").alias("kg")), "g")
    exp = F.col("kf") * F.col("kg") / F.lit(float(max(n, 1)))
    return x.select("f", "g", "works", exp.alias("expected"), (F.col("works") / exp).alias("lift"))


def lower_95(obs: Column) -> Column:
    """Lower end of a 95 % interval of a count (Byar); 0 for none."""
    o = obs.cast("double")
    return F.when(o > 0, o * F.pow(1 - 1 / (9 * o) - Z95 / (3 * F.sqrt(o)), 3)).otherwise(0.0)


def placements(fc: DataFrame, strict: bool = True, least: int = 3, share: float = 0.5) -> DataFrame:
    """Home field of each work and its kind: thin, universal, placed, bridging or unplaced.

    ``strict`` leaves one citer out of the majority, so that a work is not placed by the citer counted.
    """
    t = top_field(fc)
    p = (F.col("n") - 1) / F.greatest(F.col("total") - 1, F.lit(1)) if strict else F.col("n") / F.col("total")
    kind = F.when(F.col("total") < least, "thin").when(p >= share, "placed").when(F.col("fields") >= 8, "universal").when(F.col("fields") >= 3, "bridging").otherwise("unplaced")
    return t.withColumn("kind", kind)


def flow(fc: DataFrame, placed: DataFrame) -> DataFrame:
    """(citing, home, citers, works, expected, lift, lower): citations from a field into works at home in another."""
    home = placed.where("kind = 'placed'").select(*WORK, F.col("field").alias("home"))
    x = fc.join(home, WORK).groupBy(F.col("field").alias("citing"), "home").agg(F.sum("n").alias("citers"), F.count("*").alias("works"))
    every = Window.partitionBy()
    exp = F.sum("citers").over(Window.partitionBy("citing")) * F.sum("citers").over(Window.partitionBy("home")) / F.sum("citers").over(every)
    x = x.withColumn("expected", exp.cast("double"))
    return x.withColumn("lift", F.col("citers") / F.col("expected")).withColumn("lower", lower_95(F.col("works")) / F.col("works") * F.col("lift"))
