"""Temporal edges, typed edges, knowledge-graph walks and task rules, as joins and bounded breadth-first search."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from vectide.session import Scratch, width

PRUNE = 0.01
MOST_EDGES = 2_000_000  # edges that travel with the tasks, 24 bytes each
MOST_CELLS, CHUNK, HEAVY = 2_000_000, 2_048, 64  # nodes x starts that a task holds at once, edges that it follows at once, and incoming edges of a node that is met apart


class _Edges:
    """Edges by target, to be followed in groups: the k-th incoming edge of every node with up to HEAVY of them, and all edges of one other node."""

    def __init__(self, rows: pa.Table):
        source, target = rows["source"].combine_chunks(), rows["target"].combine_chunks()
        self.nodes = pc.unique(pa.concat_arrays([source, target.cast(source.type)]))
        at, to = (np.asarray(pc.index_in(x.cast(source.type), value_set=self.nodes), np.int64) for x in (source, target))
        order = np.argsort(to, kind="stable")
        at, to = at[order], to[order]
        weight = np.asarray(rows["w"], float)[order] if "w" in rows.schema.names else None
        first = np.searchsorted(to, to)
        rank, heavy = np.arange(len(to)) - first, (np.searchsorted(to, to, "right") - first) > HEAVY
        pick = lambda i: (to[i], at[i], None if weight is None else weight[i])
        light = np.flatnonzero(~heavy)
        light = light[np.argsort(rank[light], kind="stable")]
        groups = np.split(light, np.flatnonzero(np.diff(rank[light])) + 1)
        self.light = [pick(g[i : i + CHUNK]) for g in groups for i in range(0, len(g), CHUNK)]
        of_one = np.flatnonzero(heavy)
        self.heavy = [pick(g[i : i + CHUNK]) for g in np.split(of_one, np.flatnonzero(np.diff(to[of_one])) + 1) for i in range(0, len(g), CHUNK)]

    def step(self, front: np.ndarray, meet: np.ufunc) -> np.ndarray:
        """One hop of every start (columns) at once: over a node's incoming edges, the greatest product or the union of bits."""
        out, active = np.zeros_like(front), front.any(1)
        for groups, one in ((self.light, False), (self.heavy, True)):
            for to, at, w in groups:
                keep = active[at]
                if not keep.any():
                    continue
                if not keep.all():
                    to, at, w = to[keep], at[keep], None if w is None else w[keep]
                moved = front[at]
                if w is not None:
                    moved *= w[:, None]
                if one:
                    out[to[0]] = meet(out[to[0]], meet.reduce(moved, axis=0))
                else:
                    out[to] = meet(out[to], moved)
        return out


def _small(e: DataFrame) -> _Edges | None:
    """The edges where they can travel with the tasks, which then need no shuffle; None where they are more, or hold weights beyond numbers."""
    rows = e.limit(MOST_EDGES + 1).toArrow()
    if len(rows) > MOST_EDGES or "w" in rows.schema.names and not np.isfinite(np.asarray(rows["w"], float)).all():
        return None
    return _Edges(rows)


def _per_start(starts: DataFrame, edges: _Edges, node: DataType, name: str, kind: str, follow: Callable[[_Edges, np.ndarray], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]]) -> DataFrame:
    """start, node and a value, found for some starts at a time; follow yields places of starts, of nodes, and values."""
    schema = StructType([starts.schema["start"], StructField("node", node), *StructType.fromDDL(f"{name} {kind}").fields])
    shared = starts.sparkSession.sparkContext.broadcast(edges)

    def run(batches):
        e = shared.value
        at_once = max(1, min(256, MOST_CELLS // max(1, len(e.nodes))))
        for b in batches:
            own = b.column(0)
            place = pc.index_in(own.cast(e.nodes.type), value_set=e.nodes)
            own, place = own.filter(place.is_valid()), np.asarray(place.drop_null(), np.int64)
            for i in range(0, len(place), at_once):
                for s, n, value in follow(e, place[i : i + at_once]):
                    for k in range(0, len(s), 500_000):
                        x = slice(k, k + 500_000)
                        yield pa.RecordBatch.from_arrays([own.take(pa.array(s[x] + i)), e.nodes.take(pa.array(n[x])), pa.array(value[x])], names=["start", "node", name])

    return starts.select("start").where("start is not null").distinct().repartition(4 * width(starts.sparkSession), "start").mapInArrow(run, schema)


def temporal_edges(points: DataFrame) -> DataFrame:
    """node_id, predecessor, successor along each entity's timeline; derived, never stored."""
    w = Window.partitionBy("entity_id").orderBy("t", "node_id")
    return points.select("entity_id", "node_id", F.lag("node_id").over(w).alias("predecessor"), F.lead("node_id").over(w).alias("successor"))


def walk(points: DataFrame, steps: int) -> DataFrame:
    """node_id with the next and the former nodes, nearest first; at most steps of them."""
    w = Window.partitionBy("entity_id").orderBy("t", "node_id")
    return points.select("node_id", F.collect_list("node_id").over(w.rowsBetween(1, steps)).alias("forward"), F.reverse(F.collect_list("node_id").over(w.rowsBetween(-steps, -1))).alias("backward"))


def edges_by_type(edges: DataFrame) -> DataFrame:
    return edges.groupBy("edge_type").agg(F.count(F.lit(1)).alias("n_edges"), F.countDistinct("source").alias("n_sources"))


def outgoing(edges: DataFrame, source: int, edge_type: str | None = None) -> DataFrame:
    kept = edges.where(F.col("source") == source)
    return kept if edge_type is None else kept.where(F.col("edge_type") == edge_type)


def remove_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges without those whose (source, target, edge_type) is in gone; null types match null."""
    return edges.join(gone.select(F.col("source").alias("s_"), F.col("target").alias("t_"), F.col("edge_type").alias("e_")), (F.col("source") == F.col("s_")) & (F.col("target") == F.col("t_")) & F.col("edge_type").eqNullSafe(F.col("e_")), "left_anti")


def update_weights(edges: DataFrame, edge_type: str, factor: float) -> DataFrame:
    return edges.withColumn("weight", F.when(F.col("edge_type") == edge_type, F.col("weight") * factor).otherwise(F.col("weight")))


def success_scores(edges: DataFrame) -> DataFrame:
    """source, success_score: (1 + S) / (2 + S + F) of the weights of its success and failure edges; 0.5 where they sum to under 0.01; null weights count as 0."""
    s, f = F.coalesce(F.sum(F.when(F.col("edge_type") == "causal_success", F.col("weight"))), F.lit(0.0)), F.coalesce(F.sum(F.when(F.col("edge_type") == "causal_failure", F.col("weight"))), F.lit(0.0))
    return edges.where("source is not null").groupBy("source").agg(s.alias("s"), f.alias("f")).select("source", F.when(F.col("s") + F.col("f") < PRUNE, 0.5).otherwise((1 + F.col("s")) / (2 + F.col("s") + F.col("f"))).alias("success_score"))


def traverse(edges: DataFrame, starts: DataFrame, types: list[str] | None, hops: int) -> DataFrame:
    """start, node, weight: nodes within so many hops of each start (column start), with the best product of weights; products up to 0.01 are cut off.

    Up to MOST_EDGES edges travel with the tasks, each of which follows some starts to the end, so no pair of nodes is
    shuffled or kept on disk. Of more edges a hop is a shuffled join; paths to one node are merged by a partial aggregate
    before the next, so work is bounded by nodes and not by paths. Multi-edges count with their best weight, null weights
    not at all; a start is not its own result.
    """
    e = edges.where("source is not null and target is not null and weight is not null")
    if types:
        e = e.where(F.col("edge_type").isin(*types))
    e = e.groupBy("source", "target").agg(F.max("weight").cast("double").alias("w"))
    if small := _small(e):

        def follow(g, own):
            cols = np.arange(len(own))
            front = np.zeros((len(g.nodes), len(own)))
            front[own, cols] = 1.0
            best = np.zeros_like(front)
            for _ in range(hops):
                front = g.step(front, np.maximum)
                front[front <= PRUNE] = 0.0
                front[own, cols] = 0.0
                np.maximum(best, front, out=best)
            s, n = np.nonzero(best.T)
            yield s, n, best[n, s]

        return _per_start(starts, small, edges.schema["target"].dataType, "weight", "double", follow)
    scratch = Scratch(edges.sparkSession, "traverse")
    front = starts.select("start", F.col("start").alias("node"), F.lit(1.0).alias("weight"))
    best = front
    for _ in range(hops):
        step = front.join(e, F.col("node") == F.col("source")).select("start", F.col("target").alias("node"), (F.col("weight") * F.col("w")).alias("weight")).where((F.col("weight") > PRUNE) & (F.col("node") != F.col("start")))
        front = scratch.write(step.groupBy("start", "node").agg(F.max("weight").alias("weight")))
        best = best.unionByName(front).groupBy("start", "node").agg(F.max("weight").alias("weight"))
    return best.where("start <> node")


def reach(edges: DataFrame, starts: DataFrame, types: list[str] | None, hops: int) -> DataFrame:
    """start, node, hop: shortest number of hops to every node within hops; self edges and repeats don't matter.

    Up to MOST_EDGES edges travel with the tasks, as in traverse, 64 starts in a word.
    """
    e = edges.where("source is not null and target is not null")
    if types:
        e = e.where(F.col("edge_type").isin(*types))
    e = e.select("source", "target").distinct()
    if small := _small(e):

        def follow(g, own):
            cols = np.arange(len(own))
            seen = np.zeros((len(g.nodes), -(-len(own) // 64)), np.uint64)
            seen[own, cols // 64] |= np.uint64(1) << (cols % 64).astype(np.uint64)
            front = seen.copy()
            for hop in range(1, hops + 1):
                front = g.step(front, np.bitwise_or) & ~seen
                seen |= front
                met = np.unpackbits(front.astype("<u8").view(np.uint8), axis=1, bitorder="little")
                s, n = np.nonzero(met.T)
                yield s, n, np.full(len(s), hop, np.int32)

        return _per_start(starts, small, edges.schema["target"].dataType, "hop", "int", follow)
    scratch = Scratch(edges.sparkSession, "reach")
    seen = scratch.write(starts.select("start", F.col("start").alias("node"), F.lit(0).alias("hop")).distinct())
    front = seen
    for hop in range(1, hops + 1):
        step = front.join(e, F.col("node") == F.col("source")).select("start", F.col("target").alias("node")).distinct().join(seen.select("start", "node"), ["start", "node"], "left_anti")
        front = scratch.write(step.withColumn("hop", F.lit(hop)))
        seen = seen.unionByName(front)
    return seen.where("hop > 0")


def find_path(edges: DataFrame, start: int, end: int, hops: int) -> DataFrame:
    """One row with a shortest path (array of nodes), the least one of equals; no row if there is none within hops."""
    e = edges.where("source is not null and target is not null").select("source", "target").distinct()
    scratch = Scratch(edges.sparkSession, "path")
    front = edges.sparkSession.range(1).select(F.lit(start).cast("long").alias("node"), F.array(F.lit(start).cast("long")).alias("path"))
    seen = front.select("node")
    for _ in range(hops):
        found = front.where(F.col("node") == end)
        if found.limit(1).count():
            return found.select("path")
        step = front.join(e, F.col("node") == F.col("source")).select(F.col("target").alias("node"), F.concat("path", F.array("target")).alias("path")).join(seen, "node", "left_anti")
        front = scratch.write(step.groupBy("node").agg(F.min("path").alias("path")))
        seen = seen.unionByName(front.select("node"))
    return front.where(F.col("node") == end).select("path")


def neighbours(entities: DataFrame, relations: DataFrame, relation_type: str | None = None, incoming: bool = False) -> DataFrame:
    """id, relation_type, other, weight: one hop; relations to unknown entities are dropped."""
    a, b = ("target", "source") if incoming else ("source", "target")
    r = relations if relation_type is None else relations.where(F.col("relation_type") == relation_type)
    return r.join(entities.select(F.col("id").alias(b)), b).select(F.col(a).alias("id"), "relation_type", F.col(b).alias("other"), "weight")


def task_plan(required: DataFrame, precedes: DataFrame, most: int = 100) -> DataFrame:
    """place, step: the required step that no other one precedes (the least of several), then along the least edge to a step not yet met; required: step; precedes: source, target.

    A plan has at most most steps, so they may come to the driver one by one.
    """
    spark = required.sparkSession
    first = required.join(precedes.join(required.select(F.col("step").alias("source")), "source").select(F.col("target").alias("step")), "step", "left_anti").agg(F.min("step")).first()[0]
    plan = [] if first is None else [first]
    while plan and len(plan) < most:
        nxt = precedes.where((F.col("source") == plan[-1]) & ~F.col("target").isin(*plan)).agg(F.min("target")).first()[0]
        if nxt is None:
            break
        plan.append(nxt)
    return spark.createDataFrame(list(enumerate(plan)), "place int, step long")


def missing_preconditions(actions: DataFrame, needs: DataFrame, state: DataFrame) -> DataFrame:
    """action, n_missing: how many of each action's preconditions the state lacks; an action without any has 0. needs: action, fact; state: fact."""
    lacking = needs.join(state, "fact", "left_anti").groupBy("action").agg(F.countDistinct("fact").alias("n"))
    return actions.select("action").distinct().join(lacking, "action", "left").select("action", F.coalesce("n", F.lit(0)).alias("n_missing"))


def valid_actions(actions: DataFrame, needs: DataFrame, state: DataFrame) -> DataFrame:
    return missing_preconditions(actions, needs, state).where("n_missing = 0").select("action")


def apply_action(state: DataFrame, effects: DataFrame) -> DataFrame:
    """The state with the effects added; nothing is taken away."""
    return state.select("fact").unionByName(effects.select("fact")).distinct()


def entities_by_type(entities: DataFrame, entity_type: str) -> DataFrame:
    return entities.where(F.col("entity_type") == entity_type)


def graph_stats(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """kind, n: how many entities and relations of each type."""
    count = lambda d, c: d.groupBy(F.col(c).alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return count(entities, "entity_type").unionByName(count(relations, "relation_type"))
