"""Calculus and statistics along each entity's trajectory, as window expressions over all entities at once.

W orders an entity's points by time, equal times by node_id. Entities with too few points give no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from vectide.functions import vectors

DAY_US = 86_400_000_000.0


def W() -> WindowSpec:  # noqa: N802
    return Window.partitionBy("entity_id").orderBy("t", "node_id")


def WHOLE() -> WindowSpec:  # noqa: N802
    return Window.partitionBy("entity_id")


def trajectory(points: DataFrame, entity_id: int | None = None, when: Column | None = None) -> DataFrame:
    kept = points if entity_id is None else points.where(F.col("entity_id") == entity_id)
    return (kept if when is None else kept.where(when)).orderBy("entity_id", "t", "node_id")


def nearest_in_time(points: DataFrame, target: Column | int, name: str = "vector") -> DataFrame:
    """Per entity the point nearest to a time, the earlier one on a tie: entity_id, node_id, t, vector."""
    key = F.struct(F.abs(F.col("t") - target), "t", "node_id")
    return points.groupBy("entity_id").agg(F.min_by(F.struct("node_id", "t", "vector"), key).alias("r")).select("entity_id", "r.node_id", "r.t", F.col("r.vector").alias(name))


def velocity(points: DataFrame, target: Column | int, per_us: float = DAY_US) -> DataFrame:
    """entity_id, t, velocity: finite difference at the point nearest to target, one-sided at the ends, zero over a zero time step.

    Per day by default: per microsecond the numbers vanish.
    """
    n = F.count(F.lit(1)).over(WHOLE())
    v0, v1 = F.coalesce(F.lag("vector").over(W()), F.col("vector")), F.coalesce(F.lead("vector").over(W()), F.col("vector"))
    dt = F.coalesce(F.lead("t").over(W()), F.col("t")) - F.coalesce(F.lag("t").over(W()), F.col("t"))
    diff = points.select("entity_id", "node_id", "t", "vector", v0.alias("v0"), v1.alias("v1"), dt.alias("dt"), n.alias("n")).where("n >= 2")
    key = F.struct(F.abs(F.col("t") - target), "t", "node_id")
    at = diff.groupBy("entity_id").agg(F.min_by(F.struct("t", "v0", "v1", "dt"), key).alias("r")).select("entity_id", "r.*")
    return at.select("entity_id", "t", F.zip_with("v1", "v0", lambda a, b: F.when(F.col("dt") != 0, (a - b) / F.nullif(F.col("dt"), F.lit(0)) * per_us).otherwise(0.0)).alias("velocity"))


def acceleration(points: DataFrame, target: Column | int, per_us: float = DAY_US) -> DataFrame:
    """entity_id, t, acceleration at the inner point nearest to target (the nearest of all points, moved inside); needs 3 points."""
    step = points.select("entity_id", "node_id", "t", "vector", F.row_number().over(W()).alias("pos"), F.count(F.lit(1)).over(WHOLE()).alias("n"), F.lag("vector").over(W()).alias("v0"), F.lead("vector").over(W()).alias("v1"), (F.col("t") - F.lag("t").over(W())).alias("d1"), (F.lead("t").over(W()) - F.col("t")).alias("d2")).where("n >= 3")
    key = F.struct(F.abs(F.col("t") - target), "t", "node_id")
    at = step.groupBy("entity_id").agg(F.min_by("pos", key).alias("at"), F.first("n").alias("m")).select("entity_id", F.least(F.greatest("at", F.lit(2)), F.col("m") - 1).alias("pos"))
    inner = step.join(at, ["entity_id", "pos"])
    ok = (F.col("d1") != 0) & (F.col("d2") != 0)
    d1, d2 = F.nullif(F.col("d1"), F.lit(0)) / per_us, F.nullif(F.col("d2"), F.lit(0)) / per_us
    up, down = F.transform("v1", lambda x, i: x - F.col("vector")[i]), F.transform("vector", lambda x, i: x - F.col("v0")[i])
    return inner.select("entity_id", "t", F.zip_with(up, down, lambda a, b: F.when(ok, (a / d2 - b / d1) / ((d1 + d2) / 2)).otherwise(0.0)).alias("acceleration"))


def drift(points: DataFrame, t1: int, t2: int, top_n: int = 5) -> DataFrame:
    """entity_id, l2, cosine, top (dim, change) between the points nearest to two times."""
    both = nearest_in_time(points, t1, "v1").select("entity_id", "v1").join(nearest_in_time(points, t2, "v2").select("entity_id", "v2"), "entity_id")
    return both.select("entity_id", vectors.l2("v1", "v2").alias("l2"), vectors.cosine_distance("v1", "v2").alias("cosine"), vectors.top_dims(vectors.subtract("v2", "v1"), top_n).alias("top"))


def drift_attribution(points: DataFrame, t1: int, t2: int, top_n: int) -> DataFrame:
    """entity_id, dim, change, share of the squared drift; the top_n dimensions of each entity."""
    both = nearest_in_time(points, t1, "v1").select("entity_id", "v1").join(nearest_in_time(points, t2, "v2").select("entity_id", "v2"), "entity_id")
    d = both.select("entity_id", vectors.subtract("v2", "v1").alias("d")).select("entity_id", vectors.top_dims(F.col("d"), top_n).alias("top"), vectors.dot("d", "d").alias("all"))
    return d.select("entity_id", "all", F.explode("top").alias("x")).select("entity_id", "x.dim", F.abs("x.change").alias("change"), F.coalesce(F.try_divide(F.col("x.change") * F.col("x.change"), F.col("all")), F.lit(0.0)).alias("share"))


def predict_linear(points: DataFrame, target: Column | int) -> DataFrame:
    """entity_id, prediction from the last two points; the last point over a zero time step."""
    last = points.select("entity_id", "t", "vector", F.lag("t").over(W()).alias("t0"), F.lag("vector").over(W()).alias("v0"), F.lead("t").over(W()).alias("later")).where("later is null and t0 is not null")
    ratio = F.when(F.col("t") != F.col("t0"), (target - F.col("t")) / F.nullif(F.col("t") - F.col("t0"), F.lit(0))).otherwise(0.0)
    return last.withColumn("ratio", ratio).select("entity_id", F.zip_with("vector", "v0", lambda a, b: a + (a - b) * F.col("ratio")).alias("prediction"))


def analogy(points: DataFrame, a: int, t1: int, t2: int, b: int, t3: int) -> DataFrame:
    """One row: entity b's vector near t3 plus entity a's change from t1 to t2; no row if an entity has no point."""
    one = lambda e, t, name: F.broadcast(nearest_in_time(points.where(F.col("entity_id") == e), t, name).select(name))
    return one(a, t1, "v1").crossJoin(one(a, t2, "v2")).crossJoin(one(b, t3, "v3")).select(vectors.add("v3", vectors.subtract("v2", "v1")).alias("analogy"))


def steps(points: DataFrame) -> DataFrame:
    """Consecutive differences: entity_id, node_id, t, dt (µs), change."""
    return points.select("entity_id", "node_id", "t", (F.col("t") - F.lag("t").over(W())).alias("dt"), F.lag("vector").over(W()).alias("v0"), "vector").where("dt is not null").select("entity_id", "node_id", "t", "dt", vectors.subtract("vector", "v0").alias("change"))


def heatmap(points: DataFrame) -> DataFrame:
    """entity_id, t, dim, intensity: absolute change per step and dimension."""
    return steps(points).select("entity_id", "t", F.posexplode(F.transform("change", F.abs)).alias("dim", "intensity"))


def realised_volatility(points: DataFrame, least: int = 10) -> DataFrame:
    """entity_id, dim, volatility: sample deviation of change per µs (steps of no time count as 1 µs)."""
    rate = steps(points).select("entity_id", F.posexplode("change").alias("dim", "x"), F.greatest("dt", F.lit(1)).alias("dt"))
    return rate.groupBy("entity_id", "dim").agg(F.stddev_samp(F.col("x") / F.col("dt")).alias("volatility"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least - 1).select("entity_id", "dim", "volatility")


def adf(points: DataFrame, least: int = 10) -> DataFrame:
    """entity_id, adf: t statistic of the change of the vectors' norm on its former level, both centred; 0 where degenerate."""
    y = points.select("entity_id", "t", "node_id", vectors.norm("vector").alias("y")).withColumn("y0", F.lag("y").over(W())).where("y0 is not null").withColumn("dy", F.col("y") - F.col("y0"))
    s = y.groupBy("entity_id").agg(F.count(F.lit(1)).alias("m"), F.regr_sxx("dy", "y0").alias("sxx"), F.regr_syy("dy", "y0").alias("syy"), F.regr_sxy("dy", "y0").alias("sxy")).where(F.col("m") >= least - 1)
    beta = F.try_divide("sxy", "sxx")
    s2 = F.greatest(F.col("syy") - beta * F.col("sxy"), F.lit(0.0)) / (F.col("m") - 2)
    return s.select("entity_id", F.when((F.col("sxx") > 1e-15) & (s2 > 0), F.try_divide(beta, F.sqrt(F.try_divide(s2, F.col("sxx"))))).otherwise(0.0).alias("adf"))


def resample_last(points: DataFrame, bucket_us: int) -> DataFrame:
    """entity_id, bucket, t (its begin), vector: the last vector of each bucket since the entity's first point; empty buckets are skipped."""
    b = points.withColumn("first_t", F.min("t").over(WHOLE())).withColumn("bucket", F.floor((F.col("t") - F.col("first_t")) / bucket_us).cast("long"))
    return b.groupBy("entity_id", "bucket").agg(F.max_by("vector", F.struct("t", "node_id")).alias("vector"), (F.min("first_t") + F.col("bucket") * bucket_us).alias("t")).select("entity_id", "bucket", "t", "vector")


def resample_linear(points: DataFrame, bucket_us: int) -> DataFrame:
    """entity_id, bucket, t (the bucket's middle), vector: linear between neighbouring points, held at the ends; every bucket is filled."""
    p = points.withColumn("first_t", F.min("t").over(WHOLE()))
    nxt = p.select("entity_id", "node_id", "t", "vector", "first_t", F.lead("t").over(W()).alias("t1"), F.lead("vector").over(W()).alias("v1"), F.max("t").over(WHOLE()).alias("last_t"))
    # each point answers for the middles from itself up to the next one; the first middle of all and those after the last point are held
    half = bucket_us // 2
    number = lambda t: F.ceil((t - F.col("first_t") - half) / bucket_us).cast("long")
    low = F.greatest(number(F.col("t")), F.lit(0))
    high = F.when(F.col("t1").isNull(), F.floor((F.col("last_t") - F.col("first_t")) / bucket_us).cast("long")).otherwise(number(F.col("t1")) - 1)
    filled = nxt.withColumn("low", low).withColumn("high", high).where("low <= high").withColumn("bucket", F.explode(F.sequence("low", "high")))
    filled = filled.withColumn("t_mid", F.col("first_t") + F.col("bucket") * bucket_us + half)
    share = F.when(F.col("t1") > F.col("t"), (F.col("t_mid") - F.col("t")) / (F.col("t1") - F.col("t"))).otherwise(0.0)
    return filled.withColumn("share", share).select("entity_id", "bucket", F.col("t_mid").alias("t"), F.zip_with("vector", F.coalesce("v1", "vector"), lambda a, b: a + (b - a) * F.col("share")).alias("vector"))


def scale_drift(points: DataFrame, bucket_us: int) -> DataFrame:
    """entity_id, t, drift between consecutive resampled vectors."""
    w = Window.partitionBy("entity_id").orderBy("bucket")
    return resample_last(points, bucket_us).withColumn("v0", F.lag("vector").over(w)).where("v0 is not null").select("entity_id", "t", vectors.l2("vector", "v0").alias("drift"))


def mean_scale_drift(points: DataFrame, bucket_us: int) -> DataFrame:
    return scale_drift(points, bucket_us).groupBy("entity_id").agg(F.avg("drift").alias("mean_drift"))


def behavioural_alignment(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: Pearson correlation of two drift series (t, drift) place by place over the shorter one; 0 if degenerate."""
    place = lambda d, n: d.select(F.row_number().over(Window.orderBy("t")).alias("i"), F.col("drift").alias(n))
    return place(a, "x").join(place(b, "y"), "i").agg(F.coalesce(F.nanvl(F.corr("x", "y"), F.lit(0.0)), F.lit(0.0)).alias("alignment"))


def event_features(points: DataFrame) -> DataFrame:
    """Per entity of 3 events or more: gaps' mean, deviation, maximum, cv, burstiness, memory, entropy over 10 bins, trend over 5 windows, daily resultant (t in µs)."""
    g = points.select("entity_id", "t", (F.col("t") - F.lag("t").over(W())).cast("double").alias("gap"), F.min("t").over(WHOLE()).alias("t0"), F.max("t").over(WHOLE()).alias("t1"), F.row_number().over(W()).alias("i"), "node_id")
    g = g.withColumn("mean", F.avg("gap").over(WHOLE())).withColumn("lo", F.min("gap").over(WHOLE())).withColumn("hi", F.max("gap").over(WHOLE()))
    span = F.col("t1") - F.col("t0")
    g = g.withColumn("next", F.lead("gap").over(W())).withColumn("bin", F.when(F.col("hi") > F.col("lo"), F.floor((F.col("gap") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * 9 + 0.5)))
    # five half-open windows: the last event lies in none
    g = g.withColumn("win", F.when((span > 0) & (F.col("t") < F.col("t1")), F.floor((F.col("t") - F.col("t0")) / F.nullif(span / 5.0, F.lit(0.0))))).withColumn("angle", F.pmod(F.col("t"), F.lit(86_400_000_000)) / 86_400_000_000.0 * 2 * F.pi())
    both = F.col("gap").isNotNull() & F.col("next").isNotNull()
    a, b = F.col("gap") - F.col("mean"), F.col("next") - F.col("mean")
    s = g.groupBy("entity_id").agg(
        F.count(F.lit(1)).alias("n_events"), F.first(span).alias("span"), F.first("mean").alias("mean_gap"), F.stddev_pop("gap").alias("std_gap"), F.max("gap").alias("max_gap"),
        F.sum(F.when(both, a * b)).alias("num"), F.sum(F.when(both, a * a)).alias("d1"), F.sum(F.when(both, b * b)).alias("d2"),
        *[F.count_if(F.col("bin") == i).alias(f"b{i}") for i in range(10)], *[F.count_if(F.col("win") == i).alias(f"w{i}") for i in range(5)], F.avg(F.cos("angle")).alias("c"), F.avg(F.sin("angle")).alias("s"),
    ).where("n_events >= 3")
    gaps = F.col("n_events") - 1
    p = lambda i: F.col(f"b{i}") / gaps
    entropy = sum((F.when(F.col(f"b{i}") > 0, -p(i) * F.log(F.greatest(p(i), F.lit(1e-300)))).otherwise(0.0) for i in range(10)), F.lit(0.0))
    root = F.sqrt(F.col("d1") * F.col("d2"))
    both_ = F.col("std_gap") + F.col("mean_gap")
    return s.select(
        "entity_id", "n_events", F.col("span").cast("double").alias("span"), "mean_gap", "std_gap", "max_gap", F.coalesce(F.try_divide(F.col("std_gap") - F.col("mean_gap"), both_), F.lit(0.0)).alias("burstiness"),
        F.when((gaps >= 3) & (root > 1e-15), F.try_divide("num", root)).otherwise(0.0).alias("memory"), entropy.alias("entropy"), ((-2 * F.col("w0") - F.col("w1") + F.col("w3") + 2 * F.col("w4")) / 10.0).alias("trend"),
        F.coalesce(F.try_divide("std_gap", "mean_gap"), F.lit(0.0)).alias("gap_cv"), F.sqrt(F.col("c") * F.col("c") + F.col("s") * F.col("s")).alias("circadian"),
    )


def timelines(points: DataFrame) -> DataFrame:
    """entity_id, first_seen, last_seen, n_points, duration."""
    return points.groupBy("entity_id").agg(F.min("t").alias("first_seen"), F.max("t").alias("last_seen"), F.count(F.lit(1)).alias("n_points")).withColumn("duration", F.col("last_seen") - F.col("first_seen"))


def post_features(points: DataFrame) -> DataFrame:
    """Per point: its place in the entity's span, from 0 to 1 (a span of 0 counts as a second), seconds since the one before (0 for the first), its log1p, index from 0, hour of day (UTC)."""
    gap = F.coalesce((F.col("t") - F.lag("t").over(W())) / 1e6, F.lit(0.0))
    return points.select("entity_id", "node_id", F.try_divide((F.col("t") - F.min("t").over(WHOLE())).cast("double"), F.coalesce(F.nullif(F.max("t").over(WHOLE()) - F.min("t").over(WHOLE()), F.lit(0)), F.lit(1_000_000))).alias("t_rel"), gap.alias("gap_seconds"), F.log1p(gap).alias("gap_log"), (F.row_number().over(W()) - 1).alias("post_index"), F.floor(F.pmod(F.col("t"), F.lit(int(DAY_US))) / 3_600_000_000).cast("int").alias("hour"))


def behaviour_features(points: DataFrame, burst: int = 5) -> DataFrame:
    """Per entity: posts, span in days, gaps in seconds (mean, population deviation, maximum, median, cv, slope over their index if there are three), night (0 to 5) and evening (18 to 23) shares, and bursts.

    A burst is a post with so many posts, itself among them, from it (in order of time) to an hour later, in whole
    seconds. An entity of one post has gaps of 0.
    """
    order = Window.partitionBy("entity_id").orderBy("s")
    upto = F.count(F.lit(1)).over(order.rangeBetween(Window.unboundedPreceding, 3600))
    f = points.select("entity_id", "t", "node_id", F.floor(F.col("t") / 1_000_000).alias("s"), ((F.col("t") - F.lag("t").over(W())) / 1e6).alias("gap"), F.floor(F.pmod(F.col("t"), F.lit(int(DAY_US))) / 3_600_000_000).alias("h"), (F.row_number().over(W()) - 1).alias("i"))
    f = f.withColumn("soon", upto - F.col("i"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    g = f.groupBy("entity_id").agg(
        F.count(F.lit(1)).alias("n_posts"), ((F.max("t") - F.min("t")) / DAY_US).alias("span_days"), zero(F.avg("gap")).alias("mean_gap"), zero(F.stddev_pop("gap")).alias("std_gap"), zero(F.max("gap")).alias("max_gap"), zero(F.percentile("gap", 0.5)).alias("median_gap"),
        F.when(F.count("gap") > 2, F.regr_slope("gap", "i")).otherwise(0.0).alias("gap_trend"), F.avg(F.when(F.col("h") < 6, 1.0).otherwise(0.0)).alias("night_ratio"), F.avg(F.when(F.col("h") >= 18, 1.0).otherwise(0.0)).alias("evening_ratio"), F.count_if(F.col("soon") >= burst).alias("bursts"),
    )
    return g.withColumn("cv_gap", zero(F.try_divide("std_gap", "mean_gap")))


def sector_features(prices: DataFrame, key: str, t: str, price: str, volume: str, benchmark: str = "benchmark") -> DataFrame:
    """Per row of a series: returns over 5, 20 and 60 rows, annualised deviation of log returns over 5 and 20 rows, the 20-row return less the benchmark's (a column of its prices on the same rows), volume against its 20-row mean; incomplete rows are dropped."""
    w = Window.partitionBy(key).orderBy(t)
    back = lambda n: w.rowsBetween(-n + 1, 0)
    change = lambda c, n: F.try_divide(F.col(c), F.lag(c, n).over(w)) - 1
    p = prices.withColumn("lr", F.log(F.try_divide(F.col(price), F.lag(price).over(w)))).withColumn("i", F.row_number().over(w))
    out = p.select(
        key, t, "i", *[change(price, n).alias(f"ret_{n}") for n in (5, 20, 60)], *[(F.stddev_samp("lr").over(back(n)) * (252**0.5)).alias(f"vol_{n}") for n in (5, 20)],
        (change(price, 20) - change(benchmark, 20)).alias("rel_strength"), F.try_divide(F.col(volume), F.avg(volume).over(back(20))).alias("volume_ratio"),
    )
    return out.where("i > 60").drop("i").dropna()


def daily_activity(events: DataFrame, entity: str, t_us: str, kind: str, kinds: list[str], after: tuple[int, int] = (7, 19)) -> DataFrame:
    """Per entity and UTC day: events of each kind, all events, share outside working hours."""
    hour = F.floor(F.pmod(F.col(t_us), F.lit(int(DAY_US))) / 3_600_000_000)
    late = (hour < after[0]) | (hour >= after[1])
    day = F.floor(F.col(t_us) / int(DAY_US)).cast("long")
    return events.groupBy(F.col(entity).alias("entity_id"), day.alias("day")).agg(F.count(F.lit(1)).alias("n_events"), *[F.count_if(F.col(kind) == k).alias(f"n_{k}") for k in kinds], F.avg(F.when(late, 1.0).otherwise(0.0)).alias("after_hours_ratio"))


def dispersion_timeline(points: DataFrame, rows: int = 30, step: int = 5) -> DataFrame:
    """Per entity and window of so many rows, every step rows: 1 - mean pairwise cosine, from sums of unit vectors alone."""
    unit = points.select("entity_id", "t", "node_id", vectors.normalise("vector").alias("u"), F.row_number().over(W()).alias("i"))
    w = Window.partitionBy("entity_id", "dim").orderBy("i").rowsBetween(0, rows - 1)
    long = unit.select("entity_id", "t", "i", F.posexplode("u").alias("dim", "x"))
    sums = long.select("entity_id", "t", "i", F.sum("x").over(w).alias("s"), F.count(F.lit(1)).over(w).alias("m")).where(f"m = {rows} and (i - 1) % {step} = 0")
    return sums.groupBy("entity_id", "i").agg(F.min("t").alias("t"), (1 - (F.sum(F.col("s") * F.col("s")) - rows) / (rows * (rows - 1.0))).alias("dispersion"))
