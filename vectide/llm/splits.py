"""Splits that keep related records together.

Groups are connected components of the link table (hash-to-min); a user without a link is a group of its own.
A group draws its split by weighted rendezvous hashing: the split with the largest -share / ln(u), u a hash of
group and split, wins, so a group's split does not depend on other groups. A group that holds more than
HEAVY_SHARE of all rows could upset the shares; there are at most 1 / HEAVY_SHARE such groups, and they draw first,
largest first, with bounded loads: a group takes the best of its draws among the splits that still have room for it,
or the roomiest if none has. The other groups then draw with what is left of the shares.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectide.llm.components import components
from vectide.session import Scratch

HEAVY_SHARE = 0.002
MOST_SPLITS = 1000


def user_groups(users: DataFrame, user: str, links: DataFrame, a: str, b: str) -> DataFrame:
    """user, grp for each distinct non-null user."""
    linked = components(links, a, b)
    named = users.where(F.col(user).isNotNull()).select(F.col(user).alias("user")).distinct()
    return named.join(linked.withColumnRenamed("node", "user"), "user", "left").select("user", F.coalesce("root", "user").alias("grp"))


def draws(group: Column, shares: dict[str, float]) -> Column:
    """(score, split) of a group for each split; a split of share 0 is drawn by none."""
    drawn = []
    for name, share in sorted(shares.items()):
        u = (F.pmod(F.xxhash64(group, F.lit(name)), F.lit(2**52)).cast("double") + 0.5) / float(2**52)
        drawn.append(F.struct((-F.lit(float(share)) / F.log(u)).alias("score"), F.lit(name).alias("split")))
    return F.array(*drawn)


def rendezvous(group: Column, shares: dict[str, float]) -> Column:
    return F.array_max(draws(group, shares))["split"]


def assign_splits(rows: DataFrame, row_id: str, user: str, links: DataFrame, a: str, b: str, targets: DataFrame) -> DataFrame:
    """Every row of rows with its group and split: row_id, user, grp, split.

    targets: split, share (positive shares, scaled to sum 1; at least one). Rows with a null user belong to no
    group; each draws by its own id, so repeated ids stay together. An empty table gives no row.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "splits")
    shares = {r["split"]: float(r["share"]) for r in targets.where("share > 0 and split is not null").limit(MOST_SPLITS + 1).collect()}
    if len(shares) > MOST_SPLITS:
        raise ValueError(f"more than {MOST_SPLITS} splits")
    if not shares:
        raise ValueError("targets has no split with a positive share")
    whole = sum(shares.values())
    shares = {s: x / whole for s, x in shares.items()}
    r = rows.select(rows[row_id].alias("id"), rows[user].alias("user"))
    groups = scratch.write(user_groups(r, "user", links, a, b))
    per_user = r.groupBy("user").agg(F.count(F.lit(1)).alias("n"))
    sized = scratch.write(groups.join(per_user, "user").groupBy("grp").agg(F.sum("n").alias("n")))
    total = r.count()
    heavy = sized.where(F.col("n") > HEAVY_SHARE * total).select("grp", "n", F.reverse(F.array_sort(draws(F.col("grp"), shares))).alias("drawn")).orderBy(F.desc("n"), "grp").collect()  # at most 1 / HEAVY_SHARE rows
    lack = {s: x * total for s, x in shares.items()}
    settled = {}
    for g in heavy:
        s = next((x["split"] for x in g["drawn"] if lack[x["split"]] >= g["n"]), max(sorted(lack), key=lambda x: lack[x]))
        settled[g["grp"]] = s
        lack[s] -= g["n"]
    rest = {s: max(0.0, x) for s, x in lack.items()}
    rest = rest if sum(rest.values()) > 0 else shares
    split = rendezvous(F.col("grp"), rest)
    if settled:
        split = F.coalesce(F.create_map(*[F.lit(x) for kv in settled.items() for x in kv])[F.col("grp")], split)
    by_user = groups.withColumn("split", split)
    hot = [x["user"] for x in per_user.where(F.col("user").isNotNull() & (F.col("n") > HEAVY_SHARE * total)).collect()]  # bounded likewise
    lone = r.where("user is null").select("id", "user", F.lit(None).cast("string").alias("grp"), rendezvous(F.col("id").cast("string"), rest).alias("split"))
    named = r.where("user is not null")
    parts = named.join(F.broadcast(by_user.where(F.col("user").isin(hot))), "user", "left") if hot else named.withColumn("grp", F.lit(None).cast("string")).withColumn("split", F.lit(None).cast("string"))
    cold = parts.where("split is null").select("id", "user").join(by_user.select("user", "grp", "split"), "user")
    out = parts.where("split is not null").select("id", "user", "grp", "split").unionByName(cold.select("id", "user", "grp", "split")).unionByName(lone)
    return out.toDF(row_id, user, "grp", "split")


def torn_users(rows: DataFrame, user: str, split: str, links: DataFrame, a: str, b: str) -> DataFrame:
    """Users with a row of non-null split whose group has rows of more than one split; null users are left out."""
    held = rows.where(F.col(user).isNotNull() & F.col(split).isNotNull()).select(F.col(user).alias("user"), F.col(split).alias("split")).distinct()
    scratch = Scratch(rows.sparkSession, "torn")
    named = scratch.write(held.join(user_groups(held, "user", links, a, b), "user"))
    torn = named.groupBy("grp").agg(F.min("split").alias("lo"), F.max("split").alias("hi")).where("lo <> hi").select("grp")
    return named.join(torn, "grp", "left_semi").select(F.col("user").alias(user)).distinct()
