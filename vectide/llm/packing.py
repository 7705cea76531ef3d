"""Placing items into containers of fixed capacity by a grouping genetic algorithm on islands.

Each island holds a bounded, random part of the items and evolves packings of it: crossover hands whole well
filled containers of one parent to the other, drops that parent's containers that hold the same items, and
best-fits the displaced items. Containers filled well enough are the island's elite. Most of them are final; some
migrate whole, with all left-over items, to fewer islands in the next round, where they are one parent's first
containers. The last round keeps every container. Islands are bounded by their item count whatever the input's size,
and no item is ever left out. An island stops once its packing can't have fewer containers.
"""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectide.session import Scratch

ISLAND = 2048
ROUNDS = 3
ELITE_FILL = 0.998
MIGRANTS = 16  # one in so many elite containers migrates
POPULATION = 8
GENERATIONS = 60
MOST_KINDS = 1000
PLACED = "container string, bin string, item long, piece int, tokens long, capacity long, elite string"
SEARCHED = "container string, round int, island long, n_items long, least long, best_fit long, evolved long, crossovers int"

Bin = tuple[int, list[int]]  # room left, indexes of items


def best_fit(bins: list[Bin], order: list[int], size: list[int], capacity: int) -> list[Bin]:
    """Places items one by one into the open container with the least room that still holds them.

    Containers hang in lists by room left; a bit set of the rooms in use gives the next larger one at once.
    """
    by_room: list[list[list[int]]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for room, items in bins:
        by_room[room].append(items)
        mask |= 1 << room
    for i in order:
        s = size[i]
        fit = mask >> s
        if fit:
            room = s + (fit & -fit).bit_length() - 1
            items = by_room[room].pop()
            if not by_room[room]:
                mask ^= 1 << room
            items = [*items, i]
        else:
            room, items = capacity, [i]
        by_room[room - s].append(items)
        mask |= 1 << (room - s)
    return [(room, items) for room in range(capacity + 1) for items in by_room[room]]


def fitness(bins: list[Bin], capacity: int) -> float:
    return sum(((capacity - r) / capacity) ** 2 for r, _ in bins) / len(bins)


def crossover(giver: list[Bin], taker: list[Bin], size: list[int], capacity: int, rng: random.Random) -> list[Bin]:
    good = sorted(giver, key=lambda b: b[0])[: max(1, len(giver) // 2)]
    given = rng.sample(good, max(1, len(good) // 2))
    moved = {i for _, items in given for i in items}
    kept = [b for b in taker if moved.isdisjoint(b[1])]
    gone = [i for _, items in taker if not moved.isdisjoint(items) for i in items if i not in moved]
    # the worst filled containers are opened too, so that their items can meet the displaced ones
    kept.sort(key=lambda b: b[0])
    opened = kept[len(kept) - len(kept) // 20 :]
    gone += [i for _, items in opened for i in items]
    gone.sort(key=lambda i: -size[i])
    return best_fit([*given, *kept[: len(kept) - len(kept) // 20]], gone, size, capacity)


def evolve(size: list[int], capacity: int, seed: int, elite: list[list[int]] | None = None) -> tuple[list[Bin], int, int]:
    """The best packing found of sizes from 1 to capacity, the containers of the first best fit, and the crossovers made.

    elite: groups of items that came as whole containers; one parent keeps them together. The search ends once the
    number of containers can't be less.
    """
    rng = random.Random(seed)
    least = -(-sum(size) // capacity)
    down = sorted(range(len(size)), key=lambda i: -size[i])
    people = [best_fit([], down, size, capacity)]
    first, made = len(people[0]), 0
    if elite:
        inside = {i for g in elite for i in g}
        people.append(best_fit([(capacity - sum(size[i] for i in g), list(g)) for g in elite], [i for i in down if i not in inside], size, capacity))
    while len(people) < POPULATION and min(map(len, people)) > least:
        order = sorted(down, key=lambda i: -size[i] * rng.uniform(0.7, 1.3))
        people.append(best_fit([], order, size, capacity))
    rank = lambda p: (len(p), -fitness(p, capacity))
    people.sort(key=rank)
    for _ in range(GENERATIONS):
        if len(people[0]) <= least or len(people) < 2:
            break
        a, b = rng.sample(people[: max(2, len(people) // 2 + 1)], 2)
        people[-1] = crossover(a, b, size, capacity, rng)
        made += 1
        people.sort(key=rank)
    return people[0], first, made


def _groups(elite: pd.Series) -> list[list[int]]:
    return [rows for name, rows in elite.reset_index(drop=True).groupby(elite.reset_index(drop=True)).indices.items()]


def _island(last: bool, step: int):
    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["item", "piece"]).reset_index(drop=True)
        capacity = int(pdf["capacity"].iat[0])
        size = pdf["tokens"].tolist()
        real = [i for i, s in enumerate(size) if s > 0]
        place = {i: k for k, i in enumerate(real)}
        came = [[place[int(i)] for i in g if int(i) in place] for g in _groups(pdf["elite"])]
        bins, _, _ = evolve([size[i] for i in real], capacity, step, [g for g in came if g]) if real else ([], 0, 0)
        name: list[str | None] = [None] * len(size)
        elite: list[str | None] = [None] * len(size)
        for n, (room, items) in enumerate(bins):
            good = capacity - room >= ELITE_FILL * capacity
            migrates = not last and good and n % MIGRANTS == 0
            for i in items:
                if last or good and not migrates:
                    name[real[i]] = f"{step}-{key[1]}-{n}"
                if migrates:
                    elite[real[i]] = f"{step}-{key[1]}-{n}"
        # items without a token need no room: they go into any container of the island
        for i, s in enumerate(size):
            if not s:
                name[i] = f"{step}-{key[1]}-0" if bins and last else (None if not last else f"{step}-{key[1]}-empty")
        return pd.DataFrame({"container": pdf["container"], "bin": name, "item": pdf["item"], "piece": pdf["piece"], "tokens": pdf["tokens"], "capacity": pdf["capacity"], "elite": elite})

    return run


def _report(step: int):
    """What an island's search did; the same search as _island's, as it depends on the rows alone."""
    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["item", "piece"]).reset_index(drop=True)
        capacity = int(pdf["capacity"].iat[0])
        size = pdf["tokens"].tolist()
        real = [i for i, s in enumerate(size) if s > 0]
        place = {i: k for k, i in enumerate(real)}
        came = [[place[int(i)] for i in g if int(i) in place] for g in _groups(pdf["elite"])]
        bins, first, made = evolve([size[i] for i in real], capacity, step, [g for g in came if g]) if real else ([], 0, 0)
        return pd.DataFrame({"container": [key[0]], "round": step, "island": [key[1]], "n_items": len(size), "least": -(-sum(size) // capacity), "best_fit": first, "evolved": len(bins), "crossovers": made})

    return run


def pack(items: DataFrame, item: str, tokens: str, containers: DataFrame) -> DataFrame:
    """Rows: container, bin, item, piece, tokens, capacity; each item placed once in each kind of container.

    items: item (long) and its size; containers: container, capacity_tokens (a small table, one row per kind; rows
    with a null or non-positive capacity are ignored). An item larger than the capacity is cut into full pieces,
    each filling a container alone, and one rest; no other item is cut. Null sizes count as 0; items of size 0 are
    placed, too. Repeated item ids are separate items; an empty table gives no row.
    """
    return _rounds(items, item, tokens, containers)[0]


def search_report(items: DataFrame, item: str, tokens: str, containers: DataFrame) -> DataFrame:
    """Per container, round and island of pack: items, the least possible containers, those of the first best fit, those evolved, and how many crossovers were made."""
    return _rounds(items, item, tokens, containers)[1]


def _rounds(items: DataFrame, item: str, tokens: str, containers: DataFrame) -> tuple[DataFrame, DataFrame]:
    spark = items.sparkSession
    kinds = containers.where("capacity_tokens > 0").select("container", F.col("capacity_tokens").cast("long").alias("capacity"))
    if len(kinds.limit(MOST_KINDS + 1).collect()) > MOST_KINDS:
        raise ValueError(f"more than {MOST_KINDS} kinds of containers")
    scratch = Scratch(spark, "packing")
    sized = items.select(items[item].alias("item"), F.greatest(F.coalesce(items[tokens], F.lit(0)), F.lit(0)).cast("long").alias("all"))
    every = sized.join(F.broadcast(kinds))
    pieces = scratch.write(
        every.withColumn("full", F.expr("all div capacity")).withColumn("rest", F.expr("all % capacity"))
        .withColumn("piece", F.explode(F.expr("sequence(0, cast(full as int) - if(rest = 0 and full > 0, 1, 0))")))
        .withColumn("tokens", F.when(F.col("piece") < F.col("full"), F.col("capacity")).otherwise(F.col("rest")))
        .select("container", "item", "piece", "tokens", "capacity")
    )
    whole = pieces.where("tokens = capacity").select("container", F.concat(F.lit("f-"), F.col("item").cast("string"), F.lit("-"), F.col("piece").cast("string")).alias("bin"), "item", "piece", "tokens", "capacity")
    done, told, rest = [whole], [], pieces.where("tokens < capacity").withColumn("elite", F.lit(None).cast("string"))
    for step in range(1, ROUNDS + 1):
        last = step == ROUNDS
        counts = {r["container"]: r["n"] for r in rest.groupBy("container").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most MOST_KINDS
        if not counts:
            break
        islands = F.create_map(*[x for c, n in counts.items() for x in (F.lit(c), F.lit(max(1, round(n / ISLAND))))])
        # an elite container stays together
        dealt = rest.withColumn("island", F.pmod(F.coalesce(F.xxhash64("elite"), F.xxhash64("item", "piece", F.lit(step))), islands[F.col("container")]))
        told.append(dealt.groupBy("container", "island").applyInPandas(_report(step), SEARCHED))
        placed = scratch.write(dealt.groupBy("container", "island").applyInPandas(_island(last, step), PLACED))
        done.append(placed.where("bin is not null").drop("elite"))
        rest = placed.where("bin is null").drop("bin")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    report = told[0] if told else spark.createDataFrame([], SEARCHED)
    for more in told[1:]:
        report = report.unionByName(more)
    return out, report


def fill_report(placed: DataFrame) -> DataFrame:
    """Per kind of container: bins, tokens, the least number of bins that could hold them, and the share of room left."""
    bins = placed.groupBy("container", "capacity", "bin").agg(F.sum("tokens").alias("used"))
    return bins.groupBy("container", "capacity").agg(F.count(F.lit(1)).alias("n_bins"), F.sum("used").alias("tokens")).select(
        "container", "capacity", "n_bins", "tokens", F.ceil(F.col("tokens") / F.col("capacity")).alias("least_bins"), F.round(1 - F.col("tokens") / (F.col("n_bins") * F.col("capacity")), 6).alias("room_left")
    )
