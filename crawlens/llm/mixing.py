"""Mixing sources to target token weights by entropy balancing, in DataFrame operations only.

Every document i of source s gets a rate r_i in [0, cap]. Among all rates whose tokens meet the source's target,
the balanced ones have the largest entropy, where a document enters with mass size_i ** mass_power. The optimum is
an exponential tilt, r_i = min(cap, exp(lambda_s * z_i)) with z_i = (size_i / mean size) ** (1 - mass_power), and
lambda_s solves one convex dual equation per source: sum(size_i * r_i) = target_s. All sources take safeguarded Newton
steps together; a step is one grouped sum over the table of (source, size) counts. Sums are decimal, hence the same in
any order, so reruns agree to the last document.

Rates become copies: floor(r_i), plus one for the documents with the smallest u_i - frac(r_i) (u_i a keyed hash)
until the source's target is met. The border is found by two histograms of 4096 cells per source and a running sum
within the last cell; then up to REPAIRS single documents, chosen by size, absorb what is left over.

Targets: sources in code-point order (null last) take the weights in turn; a target stops at cap times its source's
size and the excess is reshared by weight until none is above (the water level has a closed form over sorted sources).

Defined cases: a null text has size 0, takes part with one copy and takes no words; a null source is a source;
equal documents with different ids round apart, repeated rows (same id and size) together; one row per source is the
only state, empty tables give empty results; other columns of the input may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from crawlens.llm.common import WORD, stored, table

CELLS = 4096
REPAIRS = 3
STEPS = 60
TOLERANCE = 1e-7
EXACT = "decimal(38,9)"


def word_count(col: Column) -> Column:
    return F.coalesce(F.regexp_count(col, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """``sizes(key, source, n, total)``, one row per source → with ``target``."""
    every = W.partitionBy()
    rank = F.row_number().over(W.orderBy(F.col("source").isNull(), "source"))
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), ((rank - 1) % len(weights) + 1).cast("int"))
    ordered = sizes.withColumn("weight", weight).withColumn("limit", cap * F.col("total")).withColumn("at", F.col("limit") / F.col("weight"))
    up = W.orderBy("at", "key").rowsBetween(W.unboundedPreceding, -1)
    down = W.orderBy("at", "key").rowsBetween(W.currentRow, W.unboundedFollowing)
    level = (share * F.sum("total").over(every) - F.coalesce(F.sum("limit").over(up), F.lit(0.0))) / F.sum("weight").over(down)
    first = F.min(F.when(F.col("level") <= F.col("at"), F.struct("at", "key", "level"))).over(every)["level"]
    leveled = ordered.withColumn("level", level).withColumn("water", first)
    return leveled.select("key", "source", "n", "total", F.when(F.col("water").isNull() | (F.col("at") <= F.col("water")), F.col("limit")).otherwise(F.col("water") * F.col("weight")).alias("target"))


def _rate(cap: float, mass_power: float) -> Column:
    z = F.pow(F.col("size") / F.col("mean"), F.lit(1.0 - mass_power))
    return F.when(F.col("full"), F.lit(float(cap))).otherwise(F.least(F.lit(float(cap)), F.exp(F.col("lam") * z)))


def balanced(counts: DataFrame, sources: DataFrame, cap: float, mass_power: float, tag: str = "dual") -> DataFrame:
    """``counts(key, size, n)`` and ``sources(key, n, total, target, …)`` → sources with ``mean``, ``full`` and ``lam``."""
    least_z = F.pow(1 / F.col("mean"), F.lit(1.0 - mass_power))
    ratio = F.col("target") / F.greatest(F.col("total"), F.lit(1))
    state = (
        sources.withColumn("mean", F.greatest(F.col("total") / F.greatest(F.col("n"), F.lit(1)), F.lit(1e-9)))
        .withColumn("full", ratio >= cap * (1 - 1e-12))
        .withColumn("lam", F.log(F.greatest(ratio, F.lit(1e-30))))
        .withColumn("lo", F.least(F.lit(0.0), F.col("lam") / least_z))
        .withColumn("hi", F.when(ratio <= 1, F.lit(0.0)).otherwise(F.log(F.lit(float(cap))) / least_z))
        .withColumn("miss", F.lit(None).cast("double"))
    )
    state = stored(state, tag)
    done = F.col("full") | (F.col("total") == 0)
    for _ in range(STEPS):
        z = F.pow(F.col("size") / F.col("mean"), F.lit(1.0 - mass_power))
        e = F.exp(F.col("lam") * z)
        tokens = F.col("n") * F.col("size")
        sums = (
            counts.join(state.where(~done).select("key", "lam", "mean"), "key")
            .groupBy("key")
            .agg(
                F.sum((tokens * F.least(F.lit(float(cap)), e)).cast(EXACT)).cast("double").alias("value"),
                F.sum(F.when(e < cap, tokens * z * e).otherwise(0.0).cast(EXACT)).cast("double").alias("slope"),
            )
        )
        gap = F.col("value") - F.col("target")
        near = F.abs(gap) <= TOLERANCE * F.col("target")
        lo, hi = F.when(gap < 0, F.col("lam")).otherwise(F.col("lo")), F.when(gap > 0, F.col("lam")).otherwise(F.col("hi"))
        newton = F.col("lam") - gap / F.col("slope")
        moved = F.when(F.col("value").isNull() | near, F.col("lam")).when((F.col("slope") > 0) & (newton > F.col("lo2")) & (newton < F.col("hi2")), newton).otherwise((F.col("lo2") + F.col("hi2")) / 2)
        state = (
            state.drop("miss").join(sums, "key", "left")
            .withColumn("lo2", lo).withColumn("hi2", hi)
            .withColumn("next", moved)
            .withColumn("miss", F.when(F.col("value").isNull() | near, 0.0).otherwise(F.abs(F.col("next") - F.col("lam"))))
            .select(*sources.columns, "mean", "full", F.col("next").alias("lam"), F.coalesce("lo2", "lo").alias("lo"), F.coalesce("hi2", "hi").alias("hi"), "miss")
        )
        state = stored(state, tag)
        if not state.where("miss > 1e-12").limit(1).count():
            break
    return state.select(*sources.columns, "mean", "full", "lam")


def _border(rows: DataFrame, cell: str) -> DataFrame:
    """Per key, the cell in which the running sum of sizes passes ``rest``, and what is left on entering it."""
    cells = rows.groupBy("key", "rest", cell).agg(F.sum("size").alias("size"))
    before = F.coalesce(F.sum("size").over(W.partitionBy("key").orderBy(cell).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    passed = cells.withColumn("before", before).where((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("size") > F.col("rest")))
    return passed.select("key", F.col(cell).alias(f"{cell}_border"), (F.col("rest") - F.col("before")).alias(f"{cell}_rest"))


def mixed(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.0, cap: int = 3, mass_power: float = 0.5, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``(doc_id, size, source_size, target, rate, copies, taken)`` for every document."""
    source = F.col(source_col).cast("string")
    own = docs.select(F.col(id_col).alias("doc_id"), source.alias("source"), F.coalesce(F.concat(F.lit("="), source), F.lit("")).alias("key"), word_count(F.col(text_col)).alias("size"))
    own = own.withColumn("u", F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"), "size"), F.lit(1 << 40)) / float(1 << 40))
    own = stored(own, "sized")
    counts = stored(own.groupBy("key", "size").agg(F.count("*").alias("n"), F.first("source").alias("source")), "sizes")
    sizes = counts.groupBy("key").agg(F.first("source").alias("source"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("size")).alias("total"))
    sources = stored(targets(sizes, weights, share, cap), "targets")
    state = balanced(counts, sources, cap, mass_power)

    rated = own.drop("source").join(state.drop("source", "n"), "key").withColumn("rate", _rate(cap, mass_power)).withColumn("base", F.floor("rate").cast("long"))
    rated = rated.withColumn("place", F.when(F.col("base") < cap, (F.col("u") - (F.col("rate") - F.col("base")) + 1) / 2 * CELLS))
    rated = rated.withColumn("c1", F.floor("place").cast("int")).withColumn("c2", F.floor((F.col("place") - F.col("c1")) * CELLS).cast("int"))
    floors = rated.groupBy("key").agg(F.sum(F.col("base") * F.col("size")).alias("floor_words"))
    rest = stored(sources.join(floors, "key").select("key", (F.col("target") - F.col("floor_words")).alias("rest")), "rest")
    open_ = rated.where("place is not null").join(rest, "key")
    b1 = stored(_border(open_, "c1"), "border")
    in1 = open_.drop("rest").join(b1, "key").where("c1 = c1_border").withColumnRenamed("c1_rest", "rest")
    b2 = stored(_border(in1, "c2"), "border")
    in2 = in1.drop("rest").join(b2, "key").where("c2 = c2_border")  # some 1/16,000,000 of a source
    run = W.partitionBy("key").orderBy("place", "doc_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    last = in2.withColumn("upto", F.sum("size").over(run)).where(2 * F.col("upto") - F.col("size") <= 2 * F.col("c2_rest"))
    cut = stored(last.groupBy("key").agg(F.max(F.struct("place", "doc_id")).alias("cut")), "cut")

    known = state.select("key", "total", "target", "mean", "full", "lam").join(b1.drop("c1_rest"), "key", "left").join(b2.drop("c2_rest"), "key", "left").join(cut, "key", "left").join(rest, "key", "left")
    known = stored(known, "borders")
    full = own.drop("source").join(known, "key").withColumn("rate", _rate(cap, mass_power)).withColumn("base", F.floor("rate").cast("long"))
    full = full.withColumn("place", F.when(F.col("base") < cap, (F.col("u") - (F.col("rate") - F.col("base")) + 1) / 2 * CELLS))
    full = full.withColumn("c1", F.floor("place").cast("int")).withColumn("c2", F.floor((F.col("place") - F.col("c1")) * CELLS).cast("int"))
    more = (
        F.when(F.col("place").isNull(), 0)
        .when(F.col("c1_border").isNull(), F.when(F.col("rest") > 0, 1).otherwise(0))  # no cell passes: all or none
        .when(F.col("c1") != F.col("c1_border"), (F.col("c1") < F.col("c1_border")).cast("int"))
        .when(F.col("c2_border").isNull(), 0)
        .when(F.col("c2") != F.col("c2_border"), (F.col("c2") < F.col("c2_border")).cast("int"))
        .otherwise(F.coalesce((F.struct("place", "doc_id") <= F.col("cut")).cast("int"), F.lit(0)))
    )
    out = full.withColumn("copies", F.col("base") + more).select("key", "doc_id", "size", "u", "total", "target", "rate", "copies")
    for _ in range(REPAIRS):
        out = _repaired(stored(out, "copies"), cap)
    return out.select("doc_id", "size", F.col("total").alias("source_size"), "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def _repaired(out: DataFrame, cap: int) -> DataFrame:
    """One document per source gains or loses a copy where that brings the source nearer its target."""
    off = out.groupBy("key", "target").agg(F.sum(F.col("copies") * F.col("size")).alias("sum")).select("key", (F.col("target") - F.col("sum")).alias("off"))
    off = stored(off, "off")
    far = F.abs(F.col("size") - F.abs("off"))
    can = (F.col("size") > 0) & (far < F.abs("off")) & F.when(F.col("off") > 0, F.col("copies") < cap).otherwise(F.col("copies") > 0)
    pick = out.join(off, "key").where(can).groupBy("key").agg(F.min(F.struct(far.alias("far"), "u", "doc_id", "size")).alias("p"), F.first(F.signum("off")).cast("long").alias("step"))
    pick = stored(pick, "pick").select("key", F.col("p.doc_id").alias("p_id"), F.col("p.u").alias("p_u"), F.col("p.size").alias("p_size"), "step")
    joined = out.join(pick, "key", "left")
    mine = F.col("doc_id").eqNullSafe(F.col("p_id")) & (F.col("u") == F.col("p_u")) & (F.col("size") == F.col("p_size"))
    return joined.withColumn("copies", F.col("copies") + F.when(mine, F.col("step")).otherwise(0)).select(*out.columns)


def copied(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents, each as often as the mix takes it; rows without an id once."""
    rates = mixed(docs, id_col=id_col, **options).where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("copies").cast("int").alias("copies"))
    whole = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))  # no name of the documents can meet one of ours
    joined = whole.join(rates, "doc_id", "left").withColumn("copies", F.coalesce("copies", F.lit(1)))
    return joined.where("copies > 0").select(F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"), "row").select("row.*")


def query(spark, sf_dir):
    return mixed(table(spark, sf_dir, "documents"))
