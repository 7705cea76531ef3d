"""Queries of the problems on training data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectide.llm import overlap, packing, pii, repetition, splits, tokens, vectors
from vectide.llm.sql import SQL  # noqa: F401
from vectide.operators.skew import hot_join
from vectide.session import Scratch, table


MOST_NAMES = 100_000  # the lexicon is a fixed table of 114 rows


def _posts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "unified").select("post_id", "text").dropDuplicates(["post_id"])


def _known(spark: SparkSession, d: str) -> pii.Knowledge:
    names = [(r["name"], r["name_kind"]) for r in table(spark, d, "name_lexicon").limit(MOST_NAMES + 1).collect()]
    if len(names) > MOST_NAMES:
        raise ValueError(f"a lexicon of more than {MOST_NAMES} names")
    return pii.learn(table(spark, d, "unified").select("text"), "text", names)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.find_items(table(spark, d, "unified").select("post_id", "text"), "post_id", "text", _known(spark, d))


def p1_sanitised(spark: SparkSession, d: str) -> DataFrame:
    return pii.sanitise(_posts(spark, d), "post_id", "text", _known(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return splits.torn_users(table(spark, d, "erisk_mental_embeddings"), "user_id", "split", table(spark, d, "subject_link"), "user_id_a", "user_id_b")


def _assigned(spark: SparkSession, d: str) -> DataFrame:
    return splits.assign_splits(table(spark, d, "erisk_mental_embeddings").select("post_id", "user_id"), "post_id", "user_id", table(spark, d, "subject_link"), "user_id_a", "user_id_b", table(spark, d, "split_target"))


def p3_assign(spark: SparkSession, d: str) -> DataFrame:
    return _assigned(spark, d)


def p3_shares(spark: SparkSession, d: str) -> DataFrame:
    """Wanted and reached share of rows per split."""
    got = _assigned(spark, d).groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"))
    total = table(spark, d, "erisk_mental_embeddings").count()
    want = table(spark, d, "split_target")
    return want.join(F.broadcast(got), "split", "left").select("split", "share", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), (F.coalesce("n_rows", F.lit(0)) / F.lit(max(total, 1))).alias("reached"))


NEAR = 0.30
K = 5


def _points(spark: SparkSession, d: str) -> vectors.Collection:
    return vectors.Collection(table(spark, d, "ingestpoint").select("sequence", "vector"), "sequence", "vector", 64, K + 1)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    near = vectors.neighbours_within(_points(spark, d), K, NEAR)
    return near.select(F.least("id", "other").alias("sequence_a"), F.greatest("id", "other").alias("sequence_b")).distinct()


def p4_knn(spark: SparkSession, d: str) -> DataFrame:
    """The 5 nearest of all records, with their entity, for every record whose sequence is divisible by 100."""
    points = table(spark, d, "ingestpoint")
    near = vectors.nearest_of(_points(spark, d), points.where("sequence % 100 = 0").select(F.col("sequence").alias("id")), K)
    owner = points.groupBy("sequence").agg(F.min("entity_id").alias("entity_id"))
    return near.join(owner.withColumnRenamed("sequence", "other"), "other").select(F.col("id").alias("sequence"), F.col("other").alias("neighbour"), "entity_id", "d2")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return vectors.clusters(_points(spark, d), NEAR)[0].withColumnRenamed("id", "sequence")


def p6_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Size, medoid, the most typical records (as text, for comparison) and radius of each cluster."""
    return vectors.clusters(_points(spark, d), NEAR)[1].withColumn("typical", F.concat_ws(",", "typical"))


def _overlaps(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Linked texts and members; the least split of a post counts."""
    split = table(spark, d, "erisk_mental_embeddings").where("split is not null").groupBy("post_id").agg(F.min("split").alias("split"))
    sides = split.select("post_id", F.when(F.col("split") == "train", "train").when(F.col("split").isin("val", "test"), "eval").alias("side"))
    return overlap.overlap_pairs(table(spark, d, "unified").select("post_id", "text"), "post_id", "text", "side", 0.5, 3, 20, sides)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    pairs, members = _overlaps(spark, d)
    train = members.where("side = 'train'").select(F.col("key").alias("key_train"), F.col("id").alias("train_id"))
    held = members.where("side = 'eval'").select(F.col("key").alias("key_eval"), F.col("id").alias("eval_id"))
    each = pairs.join(train, "key_train").join(held, "key_eval")
    return each.select(F.least("train_id", "eval_id").alias("post_id_a"), F.greatest("train_id", "eval_id").alias("post_id_b"))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    """Per evaluation split and source: posts that overlap with a train post, and how many pairs, exact ones among them.

    Pairs of records are counted, not listed: an evaluation text has as many as its linked training texts have members.
    """
    pairs, members = _overlaps(spark, d)
    copies = members.where("side = 'train'").groupBy(F.col("key").alias("key_train")).agg(F.count(F.lit(1)).alias("n"))
    same = F.when(F.col("similarity") == 1.0, F.col("n")).otherwise(0)
    per_text = pairs.join(copies, "key_train").groupBy(F.col("key_eval").alias("key")).agg(F.sum("n").alias("pairs"), F.sum(same).alias("same"))
    held = members.where("side = 'eval'")
    sized = per_text.join(held.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "key")
    per_post = hot_join(held.select("key", F.col("id").alias("post_id")), sized, "key", "n", held.count())
    where = table(spark, d, "erisk_mental_embeddings").where("split is not null").groupBy("post_id").agg(F.min("split").alias("split"))
    source = table(spark, d, "unified").groupBy("post_id").agg(F.min("source").alias("source"))
    return per_post.join(where, "post_id").join(source, "post_id").groupBy("split", "source").agg(F.count(F.lit(1)).alias("n_posts"), F.sum("pairs").alias("n_pairs"), F.sum("same").alias("n_equal_pairs"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, d, "documents"), "doc_id", "text")


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    sizes = tokens.count_tokens(table(spark, d, "documents"), "doc_id", "text")
    return packing.pack(sizes, "doc_id", "n_tokens", table(spark, d, "container_size")).withColumnRenamed("item", "doc_id")


def p9_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p9_containers(spark, d))


def p9_search(spark: SparkSession, d: str) -> DataFrame:
    """What the search of p9_containers did on each island: containers of the first best fit and evolved, crossovers made."""
    sizes = Scratch(spark, "sizes").write(tokens.count_tokens(table(spark, d, "documents"), "doc_id", "text"))
    return packing.search_report(sizes, "doc_id", "n_tokens", table(spark, d, "container_size"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return repetition.repeating(table(spark, d, "documents"), "doc_id", "text").select("doc_id")


def p10_repetition(spark: SparkSession, d: str) -> DataFrame:
    return repetition.measure_repetition(table(spark, d, "documents"), "doc_id", "text")


def p10_bands(spark: SparkSession, d: str) -> DataFrame:
    return repetition.fertility_bands(repetition.measure_repetition(table(spark, d, "documents"), "doc_id", "text"))


def p10_outside(spark: SparkSession, d: str) -> DataFrame:
    measured = Scratch(spark, "repetition").write(repetition.measure_repetition(table(spark, d, "documents"), "doc_id", "text"))
    return repetition.outside_bands(measured, "doc_id")


QUERIES = {f.__name__: f for f in (p1_found, p1_sanitised, p3_found, p3_assign, p3_shares, p4_found, p4_knn, p6_found, p6_clusters, p7_found, p7_report, p8_ids, p9_containers, p9_fill, p9_search, p10_found, p10_repetition, p10_bands, p10_outside)}
