"""Lineage graphs: bounded climbs, node routes, edges, timelines and the reconstruction of a case."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidara.functions.hashing import similarity

MOST_HOPS, MOST_NODES = 32, 250


def climb(nodes: DataFrame, start: DataFrame, most: int = MOST_HOPS) -> DataFrame:
    """id, ancestor, depth: every ancestor within ``most`` hops; a cycle ends at its first repeat.

    ``nodes`` has id and parent_id, ``start`` has id.  One equi-join a hop over the frontier only; it stops as soon
    as no new ancestor turns up, and each hop's frontier is a checkpoint so that plans stay short.
    """
    from evidara.sources.tables import durable

    edges = nodes.filter("parent_id is not null").select(F.col("id").alias("_from"), F.col("parent_id").alias("_to"))
    found = durable(start.select("id", F.col("id").alias("ancestor"), F.lit(0).alias("depth")))
    frontier = found
    for hop in range(1, most + 1):
        step = frontier.join(edges, frontier.ancestor == edges._from).select("id", F.col("_to").alias("ancestor"), F.lit(hop).alias("depth"))
        frontier = durable(step.join(found.select("id", "ancestor"), ["id", "ancestor"], "left_anti").distinct())
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier)
    return found


def positions(nodes: DataFrame) -> DataFrame:
    """id, root, depth, on_cycle of every node of an (id, parent_id) forest, by pointer doubling.

    Every node points to an ancestor; each round it takes over its ancestor's pointer, so the distance doubles and a chain of
    n nodes takes log2(n) rounds, not n joins.  A node whose pointer is at a root is done and leaves the loop.  A parent that
    isn't among the nodes counts as a root of its own.  Nodes on a cycle or above which there is one never get done: after as many
    rounds as the number of nodes has bits their root and depth are NULL and ``on_cycle`` is true.  Of repeated ids the smallest
    parent counts.  Very many nodes may share an ancestor.
    """
    from evidara.operators.skew import salted_join
    from evidara.sources.tables import durable

    nodes = nodes.filter("id is not null").groupBy("id").agg(F.min("parent_id").alias("to"))
    roots = nodes.filter("to is null").select("id")
    known = nodes.filter("to is not null").select("id", "to")
    done = roots.select("id", F.col("id").alias("root"), F.lit(0).cast("long").alias("depth"), F.lit(False).alias("on_cycle"))
    inner = known.select(F.col("id").alias("to"), F.lit(True).alias("_inner"))
    # open: the pointer's target has a parent itself
    first = durable(salted_join(known, inner, ["to"], F.col("id"), "left").withColumn("hops", F.lit(1).cast("long")))
    open_, rounds = first.filter("_inner").select("id", "to", "hops"), max(1, first.count().bit_length())
    ends = first.filter("_inner is null").select("id", F.col("to").alias("root"), F.col("hops").alias("depth"), F.lit(False).alias("on_cycle"))
    done, state = done.unionByName(ends), durable(first.select("id", "to", "hops", F.col("_inner").isNull().alias("_end")))
    for _ in range(rounds):
        if open_.isEmpty():
            break
        step = state.select(F.col("id").alias("to"), F.col("to").alias("_to"), F.col("hops").alias("_hops"), "_end")
        moved = durable(salted_join(open_, step, ["to"], F.col("id")).select("id", F.col("_to").alias("to"), (F.col("hops") + F.col("_hops")).alias("hops"), "_end"))
        done = done.unionByName(moved.filter("_end").select("id", F.col("to").alias("root"), F.col("hops").alias("depth"), F.lit(False).alias("on_cycle")))
        open_ = moved.filter("not _end").select("id", "to", "hops")
        state = durable(state.filter("_end").unionByName(moved))
    lost = open_.select("id", F.lit(None).cast(roots.schema["id"].dataType).alias("root"), F.lit(None).cast("long").alias("depth"), F.lit(True).alias("on_cycle"))
    return done.unionByName(lost)


def collect_nodes(case: DataFrame, matched: DataFrame, nodes: DataFrame, most: int = MOST_NODES) -> DataFrame:
    """id, discovered_by of a case's items, their matches, the matches' lineage groups and all ancestors.

    The first route wins in that order.  At most ``most`` nodes, by route and id; ``truncated`` tells of a cut.
    """
    own = case.select("id", F.lit(0).alias("route"))
    hit = matched.select("id", F.lit(1).alias("route"))
    outside = nodes.join(hit.join(own, "id", "left_anti"), "id", "left_semi")
    groups = outside.filter("source_id is not null").select("source_id").distinct()
    kin = nodes.join(groups, "source_id", "left_semi").select("id").union(nodes.join(groups.toDF("id"), "id", "left_semi").select("id"))
    known = own.unionByName(hit).unionByName(kin.select("id", F.lit(2).alias("route"))).groupBy("id").agg(F.min("route").alias("route"))
    above = climb(nodes, known.select("id")).join(nodes.select(F.col("id").alias("ancestor")), "ancestor", "left_semi")
    all_nodes = known.unionByName(above.select(F.col("ancestor").alias("id"), F.lit(2).alias("route"))).groupBy("id").agg(F.min("route").alias("route"))
    name = F.element_at(F.array(*map(F.lit, ("case_evidence", "perceptual_match", "recorded_lineage"))), F.col("route") + 1)
    total = all_nodes.agg((F.count(F.lit(1)) > most).alias("truncated"))
    return all_nodes.orderBy("route", "id").limit(most).join(F.broadcast(total)).select("id", name.alias("discovered_by"), "truncated")


def edges(nodes: DataFrame, matches: DataFrame) -> DataFrame:
    """source, target, relation, distance, similarity, verified: recorded parents among the nodes, and matches with both ends there."""
    ids = nodes.select("id")
    parent = nodes.filter("parent_id is not null").join(ids.toDF("parent_id"), "parent_id", "left_semi")
    recorded = parent.select(F.col("parent_id").alias("source"), F.col("id").alias("target"), F.lit("recorded_parent").alias("relation"), F.lit(False).alias("verified"))
    both = matches.join(ids.toDF("query"), "query", "left_semi").join(ids.toDF("candidate"), "candidate", "left_semi")
    near = both.select(F.col("query").alias("source"), F.col("candidate").alias("target"), F.lit("near_duplicate_candidate").alias("relation"), "distance", similarity(F.col("distance")).alias("similarity"), F.lit(True).alias("verified"))
    return recorded.unionByName(near, allowMissingColumns=True)


def with_distances(nodes: DataFrame, own: DataFrame, matches: DataFrame) -> DataFrame:
    """Adds the distance and similarity to the case: 0 and 1 for its own hashed items, else those of the nearest match."""
    near = matches.groupBy(F.col("candidate").alias("id")).agg(F.min("distance").alias("_near"))
    mine = own.filter("hashed").select("id", F.lit(True).alias("_own"))
    both = nodes.join(near, "id", "left").join(mine, "id", "left").withColumn("distance", F.when(F.col("_own"), 0).otherwise(F.col("_near")))
    return both.withColumn("similarity", similarity(F.col("distance"))).drop("_near", "_own")


def eligible(nodes: DataFrame) -> DataFrame:
    """Nodes that may be an origin: with a time, and with a distance, a parent or a generation."""
    return nodes.filter("timestamp is not null and (distance is not null or parent_id is not null or generation is not null)")


def reconstruct(case: DataFrame, matches: DataFrame, nodes: DataFrame, most: int = MOST_NODES) -> DataFrame:
    """One row: n_nodes, n_edges, status, earliest, n_tied, platforms, generations, truncated of a case's spread.

    ``case`` has id and hashed; ``matches`` query, candidate, distance; ``nodes`` id, parent_id, source_id, generation,
    platform and timestamp.  The nodes are at most ``most``, so what is collected of them is bounded.
    """
    from evidara.sources.tables import durable

    hit = matches.join(case.select(F.col("id").alias("query")), "query", "left_semi")
    routes = durable(collect_nodes(case, hit.select(F.col("candidate").alias("id")).distinct(), nodes, most))
    held = durable(with_distances(nodes.join(F.broadcast(routes), "id"), case, hit))
    kept = eligible(held).select(F.date_trunc("second", "timestamp").alias("at"), F.coalesce("generation", F.lit(99)).alias("g"), "id")
    first = kept.agg(F.min(F.struct("at", "g", "id")).alias("first"))
    tied = kept.join(first).filter("at = first.at").agg(F.min("first.id").alias("earliest"), F.count(F.lit(1)).alias("n_tied"))
    n_edges = edges(held, matches).agg(F.count(F.lit(1)).alias("n_edges"))
    distinct = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    whole = held.agg(F.count(F.lit(1)).alias("n_nodes"), distinct("platform").alias("platforms"), distinct("generation").alias("generations"), F.coalesce(F.bool_or("truncated"), F.lit(False)).alias("truncated"))
    out = whole.join(n_edges).join(tied)
    status = F.when(F.col("n_nodes") == 0, "NO_EVIDENCE").when(F.col("n_edges") > 0, "TRACED").otherwise("ISOLATED")
    return out.withColumn("status", status)


def timestamps(items: DataFrame) -> DataFrame:
    """Adds timestamp and where it comes from: observation, else ingestion."""
    source = F.when(F.col("observed_at").isNotNull(), "recorded_observation").otherwise("local_ingestion")
    return items.withColumn("timestamp", F.coalesce("observed_at", "ingested_at")).withColumn("timestamp_source", source)


def timeline(nodes: DataFrame) -> DataFrame:
    """Nodes in order: undated last, then time, generation or 99, id; with a description."""
    text = F.concat_ws(" ", F.lit("Instance"), F.col("id").cast("string"), F.when(F.col("platform").isNotNull(), F.concat(F.lit("on "), "platform")), F.when(F.col("generation").isNotNull(), F.concat(F.lit("(generation "), F.col("generation").cast("string"), F.lit(")"))))
    return nodes.withColumn("dated", F.col("timestamp").isNotNull()).withColumn("description", text).orderBy(F.col("timestamp").asc_nulls_last(), F.coalesce("generation", F.lit(99)), "id")


def trace_status(n_nodes: int, n_edges: int) -> str:
    return "NO_EVIDENCE" if not n_nodes else "TRACED" if n_edges else "ISOLATED"
