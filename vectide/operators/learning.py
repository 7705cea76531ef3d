"""Counting models: region decision processes, Bayesian networks, class labels by TF-IDF, evaluation."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def transitions(episodes: DataFrame) -> DataFrame:
    """region, action, next_region, n, probability from rows (episode_id, step, region, action)."""
    w = Window.partitionBy("episode_id").orderBy("step")
    moves = episodes.withColumn("next_region", F.lead("region").over(w)).where("next_region is not null")
    counts = moves.groupBy("region", "action", "next_region").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("probability", F.col("n") / F.sum("n").over(Window.partitionBy("region", "action")))


def region_quality(episodes: DataFrame, distinct: bool = False) -> DataFrame:
    """region, quality, decay: mean reward over all visits (or, if distinct, once per episode, whose reward is that of its first visit), and 0.70 + 0.25 * quality; no visit with a reward gives 0.5."""
    visits = episodes.groupBy("region", "episode_id").agg(F.min_by("reward", "step").alias("reward")) if distinct else episodes
    return visits.groupBy("region").agg(F.coalesce(F.avg("reward"), F.lit(0.5)).alias("quality")).withColumn("decay", 0.70 + 0.25 * F.col("quality"))


def moves(episodes: DataFrame) -> DataFrame:
    """The steps of episodes but for the last one of each, which leads nowhere."""
    w = Window.partitionBy("episode_id").orderBy("step")
    return episodes.withColumn("__next", F.lead(F.lit(1)).over(w)).where("__next = 1").drop("__next")


def action_success(episodes: DataFrame) -> DataFrame:
    """region, action, n, success: (1 + rewards above 0.5) / (2 + n) over all steps but an episode's last, best first within a region by rank (ties by action)."""
    s = moves(episodes).where("action is not null and reward is not null").groupBy("region", "action").agg(F.count(F.lit(1)).alias("n"), ((1 + F.count_if(F.col("reward") > 0.5)) / (2 + F.count(F.lit(1)))).alias("success"))
    return s.withColumn("rank", F.row_number().over(Window.partitionBy("region").orderBy(F.desc("success"), "action")))


def success_or_default(episodes: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (region, action) with success; the region's quality where the action was never tried, 0.5 where the region wasn't."""
    return asked.join(action_success(episodes).select("region", "action", "success"), ["region", "action"], "left").join(region_quality(episodes).select("region", "quality"), "region", "left").select("region", "action", F.coalesce("success", "quality", F.lit(0.5)).alias("success"))


def hints(episodes: DataFrame, most: int = 3) -> DataFrame:
    """region, hint: its best actions with their success, as text."""
    best = action_success(episodes).where(F.col("rank") <= most)
    line = F.concat("action", F.lit("("), F.format_string("%.0f", F.col("success") * 100), F.lit("%)"))
    return best.groupBy("region").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("s")))).alias("x")).select("region", F.concat(F.lit("Action success rates: "), F.concat_ws(", ", F.transform("x", lambda s: s["s"]))).alias("hint"))


def mdp_stats(episodes: DataFrame) -> DataFrame:
    """One row: n_transitions, n_state_actions, n_regions."""
    m = moves(episodes).where("action is not null").agg(F.count(F.lit(1)).alias("n_transitions"), F.count_distinct("region", "action").alias("n_state_actions"))
    return m.crossJoin(F.broadcast(episodes.agg(F.count_distinct("region").alias("n_regions"))))  # one row each


class Network:
    """A Bayesian network over columns of a table: variables with their states, parents, and smoothed conditional tables."""

    def __init__(self, states: dict[str, list[str]], parents: dict[str, list[str]]):
        self.states, self.parents = states, {v: parents.get(v, []) for v in states}
        self.cpt: dict[str, DataFrame] = {}

    def learn(self, rows: DataFrame, alpha: float = 1.0) -> None:
        """(count + alpha) / (n + alpha K) per variable over the whole grid of parent states; a missing parent counts as its first state, a missing value not at all."""
        spark = rows.sparkSession
        for v, own in self.states.items():
            ps = self.parents[v]
            seen = rows.where(F.col(v).isin(*own)).select(*[F.when(F.col(p).isin(*self.states[p]), F.col(p)).otherwise(self.states[p][0]).alias(p) for p in ps], v)
            counts = seen.groupBy(*ps, v).agg(F.count(F.lit(1)).alias("n"))
            grid = spark.createDataFrame(list(product(*[self.states[p] for p in ps], own)), ", ".join(f"`{c}` string" for c in [*ps, v]))
            full = grid.join(counts, [*ps, v], "left").select(*ps, v, F.coalesce("n", F.lit(0)).alias("n"))
            w = Window.partitionBy(*(ps or [F.lit(0)]))
            self.cpt[v] = full.withColumn("probability", (F.col("n") + alpha) / (F.sum("n").over(w) + alpha * len(own)))

    def posterior(self, variable: str, evidence: dict[str, str], exact: bool = True) -> DataFrame:
        """state, probability. exact sums over hidden variables; else they stand at their first state, as the compared engine has it. Uniform if nothing is possible."""
        spark = next(iter(self.cpt.values())).sparkSession
        free = {v: ([evidence[v]] if v in evidence else s if exact or v == variable else s[:1]) for v, s in self.states.items()}
        worlds = spark.createDataFrame(list(product(*free.values())), ", ".join(f"`{v}` string" for v in free))
        for v in self.states:
            worlds = worlds.join(self.cpt[v].select(*self.parents[v], v, F.col("probability").alias(f"p_{v}")), [*self.parents[v], v])
        mass = worlds.groupBy(F.col(variable).alias("state")).agg(F.sum(F.exp(sum((F.log(f"p_{v}") for v in self.states), F.lit(0.0)))).alias("m"))
        total = F.sum("m").over(Window.partitionBy(F.lit(0)))
        k = len(free[variable])
        return mass.select("state", F.when(total > 1e-12, F.col("m") / total).otherwise(1.0 / k).alias("probability"))

    def most_likely(self, variable: str, evidence: dict[str, str], exact: bool = True) -> DataFrame:
        order = F.create_map(*[x for i, s in enumerate(self.states[variable]) for x in (F.lit(s), F.lit(i))])
        return self.posterior(variable, evidence, exact).agg(F.max_by("state", F.struct("probability", order[F.col("state")])).alias("state"))


def class_terms(docs: DataFrame, label: str, text: str, most: int = 5) -> DataFrame:
    """label, term, weight, rank: words that tell a class from the others: share of the class's words times log(1 + classes' mean size / occurrences)."""
    words = docs.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(label).alias("label"), F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))).alias("term"))
    tf = words.groupBy("label", "term").agg(F.count(F.lit(1)).alias("n"))
    size = tf.groupBy("label").agg(F.sum("n").alias("size"))
    mean = F.broadcast(size.agg(F.avg("size").alias("mean_size")))  # one row
    everywhere = tf.groupBy("term").agg(F.sum("n").alias("all"))
    s = tf.join(size, "label").join(everywhere, "term").crossJoin(mean).withColumn("weight", F.col("n") / F.col("size") * F.log1p(F.col("mean_size") / F.col("all")))
    return s.withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("weight"), "term"))).where(F.col("rank") <= most).select("label", "term", "weight", "rank")


def binary_metrics(scored: DataFrame, label: str, score: str, threshold: float = 0.5) -> DataFrame:
    """One row: n, auc (ties count half), precision, recall, f1. Ranks come from counts per score, not from one sorted task; null if undefined."""
    per = scored.where(F.col(label).isNotNull() & F.col(score).isNotNull()).groupBy(F.col(score).alias("s")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("q"))
    return _metrics(per, [], threshold)


def _metrics(per: DataFrame, by: list[str], threshold: float) -> DataFrame:
    """Metrics from the positives p and negatives q of each score s, one row per group of by."""
    # running sums by range: bucket totals first, then within buckets
    bucketed = per.withColumn("b", F.floor(F.col("s") * 1000))
    totals = bucketed.groupBy(*by, "b").agg(F.sum("q").alias("bq"))
    all_before = Window.partitionBy(*by).orderBy("b") if by else Window.orderBy("b")  # one row a bucket
    below = totals.withColumn("under", F.coalesce(F.sum("bq").over(all_before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select(*by, "b", "under")
    inner = F.coalesce(F.sum("q").over(Window.partitionBy(*by, "b").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    r = bucketed.withColumn("inner", inner).join(below, [*by, "b"]).withColumn("less", F.col("inner") + F.col("under"))
    hit = F.col("s") >= threshold
    a = r.groupBy(*by).agg(F.sum("p").alias("np"), F.sum("q").alias("nq"), F.sum(F.col("p") * (F.col("less") + F.col("q") / 2)).alias("u"), F.sum(F.when(hit, F.col("p")).otherwise(0)).alias("tp"), F.sum(F.when(hit, F.col("q")).otherwise(0)).alias("fp"))
    prec, rec = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", "np")
    return a.select(*by, (F.col("np") + F.col("nq")).alias("n"), F.try_divide("u", F.col("np") * F.col("nq")).alias("auc"), prec.alias("precision"), rec.alias("recall"), F.try_divide(2 * prec * rec, prec + rec).alias("f1"))


MODULUS = 2_147_483_647


def poisson_weight(key: Column, turn: Column) -> Column:
    """A Poisson(1) weight that depends on key and turn alone, so that a lost task gives the same again: 0 to 5 by the cumulative chances."""
    a = F.pmod(F.pmod(key, F.lit(MODULUS)) * 48271 + turn * 69621, F.lit(MODULUS))
    u = F.pmod(a * a, F.lit(MODULUS)) / MODULUS
    return F.when(u < 0.36788, 0).when(u < 0.73576, 1).when(u < 0.91970, 2).when(u < 0.98101, 3).when(u < 0.99634, 4).otherwise(5)


def bootstrap_mean(rows: DataFrame, value: str, rounds: int = 200, level: float = 0.95, key: str | None = None) -> DataFrame:
    """One row: low, high of the mean's percentile interval. Each row gets a Poisson(1) weight per round, from key, a number of its own (else from its place in the partitions read), so every round is one partial aggregate."""
    base = rows.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("x"), (F.col(key).cast("long") if key else F.monotonically_increasing_id()).alias("k"))
    per = base.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds))))
    w = poisson_weight(F.col("k"), F.col("round").cast("long"))
    means = per.withColumn("w", w).groupBy("round").agg(F.try_divide(F.sum(F.col("x") * F.col("w")), F.sum("w")).alias("m"))
    return means.agg(F.percentile("m", (1 - level) / 2).alias("low"), F.percentile("m", (1 + level) / 2).alias("high"))


def bootstrap_metrics(scored: DataFrame, label: str, score: str, key: str, rounds: int = 200, threshold: float = 0.5, level: float = 0.95) -> DataFrame:
    """metric, mean, low, high of auc, precision, recall and f1 over rounds of Poisson(1) weights; rounds without both classes are left out, undefined precision and f1 count as 0."""
    known = scored.where(F.col(label).isNotNull() & F.col(score).isNotNull()).select(F.col(score).alias("s"), F.col(label).alias("y"), F.col(key).cast("long").alias("k"))
    w = poisson_weight(F.col("k"), F.col("round").cast("long"))
    each = known.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds)))).withColumn("w", w).where("w > 0")
    per = each.groupBy("round", "s").agg(F.sum(F.when(F.col("y") == 1, F.col("w")).otherwise(0)).alias("p"), F.sum(F.when(F.col("y") == 0, F.col("w")).otherwise(0)).alias("q"))
    m = _metrics(per, ["round"], threshold).where("auc is not null").select("auc", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("precision", "recall", "f1")])
    long = m.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("v")) for c in m.columns])).alias("e")).select("e.*")
    return long.groupBy("metric").agg(F.avg("v").alias("mean"), F.percentile("v", (1 - level) / 2).alias("low"), F.percentile("v", (1 + level) / 2).alias("high"))


def stratified_split(users: DataFrame, user: str, label: str, share: float = 0.8) -> DataFrame:
    """user, label, split: the first share of each label's users by hash to train, the others to test.

    Ranks come from counts per label and 4,096 ranges of the hash; only within a range users are put in order, so a
    label that most users have is no single task.
    """
    u = users.select(F.col(user).alias("user"), F.col(label).alias("label")).distinct().withColumn("h", F.xxhash64("user")).withColumn("range", F.shiftright("h", 52))
    ranges = u.groupBy("label", "range").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("label")
    before = F.coalesce(F.sum("n").over(w.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sized = ranges.select("label", "range", before.alias("before"), F.ceil(share * F.sum("n").over(w)).alias("train"))
    placed = u.withColumn("place", F.row_number().over(Window.partitionBy("label", "range").orderBy("h", "user")))
    met = placed.join(sized, placed["label"].eqNullSafe(sized["label"]) & (placed["range"] == sized["range"])).select("user", placed["label"], "place", "before", "train")
    return met.select("user", "label", F.when(F.col("place") + F.col("before") <= F.col("train"), "train").otherwise("test").alias("split"))
