"""Walks over entity relations and document links, and entity look-up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorehouse import fixed_values as fixed
from lorehouse.functions.text import canonical_name, literal_contains
from lorehouse.operators.filters import active
from lorehouse.operators.rare_key import candidates
from lorehouse.session import cut_lineage, once


def both_ways(edges: DataFrame) -> DataFrame:
    """Distinct ``(vertex, near)`` pairs of active edges, in both directions."""
    live = active(edges)
    forward = live.select(F.col("source_id").alias("vertex"), F.col("target_id").alias("near"))
    backward = live.select(F.col("target_id").alias("vertex"), F.col("source_id").alias("near"))
    return forward.unionByName(backward).distinct()


def walk(roots: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """``(root, id, depth)``: all vertices within ``depth`` steps, each at its smallest depth.

    ``roots``: one column, root. The visited vertices of a round are written once,
    so a lost executor costs one round at most.
    """
    depth = max(0, min(depth, fixed.MAX_DEPTH))
    reached = roots.select("root").distinct().select(
        "root", F.col("root").alias("id"), F.lit(0).alias("depth")
    )
    if depth == 0:
        return reached
    pairs = cut_lineage(both_ways(edges), "neighbours")
    reached = cut_lineage(reached, "walk-0")
    for step in range(1, depth + 1):
        frontier = reached.filter(F.col("depth") == step - 1)
        found = (
            frontier.join(pairs, frontier["id"] == pairs["vertex"])
            .select("root", F.col("near").alias("id"))
            .distinct()
            .join(reached.select("root", "id"), ["root", "id"], "left_anti")
            .withColumn("depth", F.lit(step))
        )
        reached = cut_lineage(reached.unionByName(found), f"walk-{step}")
    return reached


def first_neighbours(edges: DataFrame, limit: int) -> DataFrame:
    """``(vertex, nears)``: the ``limit`` smallest neighbour ids of each vertex, in order.

    The rank filter prunes each map task's rows first, so a hub sends at most
    ``limit`` ids per task.
    """
    order = Window.partitionBy("vertex").orderBy("near")
    ranked = both_ways(edges).withColumn("_n", F.row_number().over(order))
    kept = ranked.filter(F.col("_n") <= limit)
    return kept.groupBy("vertex").agg(F.sort_array(F.collect_list("near")).alias("nears"))


def first_reached(roots: DataFrame, edges: DataFrame, depth: int, limit: int) -> DataFrame:
    """``(root, id, depth)``: the first ``limit`` vertices of each root by (depth, id)."""
    return _listed(_reached_sets(roots, edges, depth, limit))


def _listed(sets: DataFrame) -> DataFrame:
    """``(root, id, depth)`` of the sets."""
    levels = F.concat(*[_with_depth(step) for step in range(len(sets.columns) - 2)])
    return sets.select("root", F.explode(levels).alias("_node")).select("root", "_node.*")


def _reached_sets(roots: DataFrame, edges: DataFrame, depth: int, limit: int) -> DataFrame:
    """``(root, seen, level_0, ...)``: the first ``limit`` vertices of each root, all of them and by depth.

    Exact with bounded work. Say a root holds v < limit vertices, so limit - v are
    still to come. A vertex that ranks after ``limit`` among one neighbour's ids
    has at least limit - v unvisited ones before it there, so the first ``limit``
    ids of each neighbour hold all that can come next; and a full root is done.
    A root is one row with at most ``limit`` ids, and a round brings at most
    ``limit`` lists of ``limit`` ids together.
    """
    depth = max(0, min(depth, fixed.MAX_DEPTH))
    empty = F.array().cast("array<bigint>")
    start = roots.select(F.col("root").cast("bigint").alias("root")).distinct()
    state = start.select("root", F.array("root").alias("seen"), F.array("root").alias("level_0"))
    if depth:
        nears = cut_lineage(first_neighbours(edges, limit), "neighbours")
    for step in range(1, depth + 1):
        frontier = state.filter(F.size("seen") < limit).select(
            "root", F.explode(f"level_{step - 1}").alias("vertex")
        )
        offered = (
            frontier.join(nears, "vertex").groupBy("root").agg(F.collect_list("nears").alias("_lists"))
        )
        # a comparator of its own would make ``array_sort`` call an expression for every comparison
        fresh = F.sort_array(F.array_except(F.flatten("_lists"), "seen"))
        room = F.lit(limit) - F.size("seen")
        state = (
            state.join(offered, "root", "left")
            .withColumn(f"level_{step}", F.coalesce(F.slice(fresh, F.lit(1), room), empty))
            .withColumn("seen", F.concat("seen", f"level_{step}"))
            .drop("_lists")
        )
        state = cut_lineage(state, f"reached-{step}")
    return state


def _with_depth(step: int) -> Column:
    return F.transform(
        F.col(f"level_{step}"), lambda id: F.struct(id.alias("id"), F.lit(step).alias("depth"))
    )


def induced_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(root, source, target, relation)``: active edges with both ends among a root's nodes."""
    return _edges_within(nodes.groupBy("root").agg(F.collect_set("id").alias("seen")), edges)


def _mark(id: Column) -> Column:
    """A byte of an id: equal ids have equal bytes."""
    return (F.pmod(F.xxhash64(id), F.lit(256)) - 128).cast("tinyint")


def _edges_within(sets: DataFrame, edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """``(root, source, target, relation)``: active edges with both ends in ``seen`` of a root, and in ``vertices`` (id) if given.

    Each edge is looked up from its end of lower degree, so a hub's edges are
    never listed once per root that contains the hub. A byte of every id of the
    root is at hand there and tells most of the edges that lead elsewhere; the
    rest meet the root's own row, so all edges of a root end up in one place.
    """
    live = active(edges).select(
        F.col("source_id").alias("source"), F.col("target_id").alias("target"), "relation"
    )
    ends = live.select(F.explode(F.array("source", "target")).alias("id"))
    degree = ends.groupBy("id").agg(F.count(F.lit(1)).alias("_degree"))
    if vertices is not None:
        degree = degree.join(vertices.select("id"), "id", "left_semi")
    from_source = degree.select(F.col("id").alias("source"), F.col("_degree").alias("_ds"))
    from_target = degree.select(F.col("id").alias("target"), F.col("_degree").alias("_dt"))
    source_low = F.col("_ds") <= F.col("_dt")
    oriented = (
        live.join(from_source, "source")
        .join(from_target, "target")
        .withColumn("_low", F.when(source_low, F.col("source")).otherwise(F.col("target")))
        .withColumn("_high", F.when(source_low, F.col("target")).otherwise(F.col("source")))
        .drop("_ds", "_dt")
    )
    marked = once(sets.select("root", "seen"), "_marks", F.transform("seen", _mark))
    low = marked.select("root", "_marks", F.explode("seen").alias("_low"))
    met = oriented.join(low, "_low").filter(F.array_contains("_marks", _mark(F.col("_high")))).drop("_marks", "_low")
    return (
        met.join(sets.select("root", "seen"), "root")
        .filter(F.array_contains("seen", F.col("_high")))
        .select("root", "source", "target", "relation")
    )


def neighbors(
    roots: DataFrame,
    entities: DataFrame,
    relations: DataFrame,
    depth: int = 2,
    limit: int = fixed.MAX_NODES,
) -> tuple[DataFrame, DataFrame]:
    """Nodes ``(root, id, type, name, depth)`` around each root, and their edges."""
    # written, as the walk and the look-up of edges read them several times
    live = cut_lineage(active(relations).select("source_id", "target_id", "relation", "invalid_at"), "edges")
    sets = _reached_sets(roots, live, depth, min(limit, fixed.MAX_NODES))
    described = entities.select("id", F.col("entity_type").alias("type"), "name")
    nodes = _listed(sets).join(described, "id").select("root", "id", "type", "name", "depth")
    return nodes, _edges_within(sets, live, entities)


def superseded(links: DataFrame) -> DataFrame:
    """Ids of documents that an active link replaces."""
    newer = active(links).filter(F.col("kind") == "supersedes")
    return newer.select(F.col("target_id").alias("id")).distinct()


def with_current(documents: DataFrame, links: DataFrame) -> DataFrame:
    """Add ``current``: false for documents replaced by another."""
    old = superseded(links).withColumn("_old", F.lit(True))
    return documents.join(old, "id", "left").withColumn("current", F.col("_old").isNull()).drop("_old")


def related_documents(
    roots: DataFrame, documents: DataFrame, links: DataFrame, depth: int = 1
) -> DataFrame:
    """Documents linked to each root: root, id, title, doc_type, version, depth, current."""
    reached = walk(roots, links, depth).filter(F.col("id") != F.col("root"))
    described = with_current(documents.select("id", "title", "doc_type", "version"), links)
    return reached.join(described, "id").select(
        "root", "id", "title", "doc_type", "version", "depth", "current"
    )


#: Names up to this length are looked up as whole runs of an entity name, longer ones by a run of this length.
RUN = 32


def _runs(entities: DataFrame, lengths: DataFrame) -> DataFrame:
    """``(key, item)``: distinct runs of characters of each entity name, of the lengths in the one row of ``lengths``."""

    def of_length(text: Column, n: Column) -> Column:
        places = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1))
        runs = F.transform(places, lambda at: F.substring(text, at, n))
        return F.coalesce(runs, F.array().cast("array<string>"))

    low = entities.select(F.col("id").alias("item"), F.lower("name").alias("_low")).crossJoin(F.broadcast(lengths))
    runs = F.flatten(F.transform("lengths", lambda n: of_length(F.col("_low"), n)))
    return low.select(F.explode(F.array_distinct(runs)).alias("key"), "item")


def find_entities(names: DataFrame, entities: DataFrame) -> DataFrame:
    """``(name, entity_id)``: exact canonical match, else literal substring; lowest id wins.

    ``names``: name. A name of up to ``RUN`` characters is itself a run of the entity names
    that hold it and needs only the smallest id among these, so the entity names are cut into
    runs of the lengths that are asked for, and no name meets its many holders. A longer
    one is verified on the postings of its rarest run.
    """
    asked = names.select("name").distinct().withColumn("canonical", canonical_name(F.col("name")))
    first = entities.groupBy("canonical").agg(F.min("id").alias("entity_id"))
    exact = asked.join(first, "canonical").select("name", "entity_id")
    missed = asked.join(first, "canonical", "left_anti").select("name", F.lower("name").alias("low"))
    # written, so that few names are broadcast to the runs instead of shuffling these
    missed = cut_lineage(missed, "missed")

    short = missed.filter(F.length("low") <= RUN)
    lengths = short.agg(F.collect_set(F.length("low")).alias("lengths"))
    smallest = (
        _runs(entities, lengths)
        .join(short.select(F.col("low").alias("key")).distinct(), "key", "left_semi")
        .groupBy("key")
        .agg(F.min("item").alias("entity_id"))
    )
    by_run = short.join(smallest, short["low"] == smallest["key"]).select("name", "entity_id")

    long = missed.filter(F.length("low") > RUN)
    one = long.agg(F.array(F.lit(RUN)).alias("lengths"))
    needs = _runs(long.select(F.col("name").alias("id"), "name"), one).select(F.col("item").alias("name"), "key")
    by_substring = (
        candidates(needs, _runs(entities.filter(F.length("name") > RUN), one), ["name"])
        .join(entities.select(F.col("id").alias("item"), F.col("name").alias("_full")), "item")
        .filter(literal_contains(F.col("_full"), F.col("name")))
        .groupBy("name")
        .agg(F.min("item").alias("entity_id"))
    )
    return exact.unionByName(by_run).unionByName(by_substring)


def documents_of_entities(mentions: DataFrame, documents: DataFrame) -> DataFrame:
    """Documents that actively mention each entity, with the role."""
    return (
        active(mentions)
        .select("entity_id", F.col("document_id").alias("id"), "role")
        .join(documents.select("id", "title", "doc_type"), "id")
        .select("entity_id", "id", "title", "doc_type", "role")
    )


def entities_of_documents(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """Entities that each document actively mentions, with the role."""
    return (
        active(mentions)
        .select("entity_id", "document_id", "role")
        .join(entities.select(F.col("id").alias("entity_id"), "entity_type", "name"), "entity_id")
        .select("document_id", "entity_id", "entity_type", "name", "role")
    )


def entity_cards(
    names: DataFrame,
    entities: DataFrame,
    mentions: DataFrame,
    documents: DataFrame,
    relations: DataFrame,
    depth: int = 1,
    parts: Sequence[str] = ("entity", "documents", "nodes", "edges"),
) -> dict[str, DataFrame]:
    """Card of every name as four tables keyed by name: entity, documents, nodes, edges.

    An entity may be mentioned by any number of documents, so its documents are
    rows, not one nested list. A name that is not found has a NULL entity. Only the
    tables in ``parts`` are made.
    """
    found = cut_lineage(find_entities(names, entities), "cards")
    cards = {}
    if "entity" in parts:
        cards["entity"] = _entity_details(names, found, entities)
    if "documents" in parts:
        cards["documents"] = found.join(documents_of_entities(mentions, documents), "entity_id").drop("entity_id")
    if "nodes" in parts or "edges" in parts:
        wanted = found.select("name", F.col("entity_id").alias("root"))
        nodes, edges = neighbors(wanted.select("root"), entities, relations, depth)
        cards["nodes"] = wanted.join(nodes.withColumnRenamed("name", "node_name"), "root").drop("root")
        cards["edges"] = wanted.join(edges, "root").drop("root")
    return {part: cards[part] for part in parts}


def _entity_details(names: DataFrame, found: DataFrame, entities: DataFrame) -> DataFrame:
    """The entity of each name, NULL if none is found."""
    details = entities.select(F.col("id").alias("entity_id"), "entity_type", "name", "attributes")
    card = names.select("name").distinct().join(found, "name", "left").join(
        details.withColumnRenamed("name", "entity_name"), "entity_id", "left"
    )
    return card.select("name", "entity_id", "entity_type", "entity_name", "attributes")


def document_cards(
    ids: DataFrame,
    documents: DataFrame,
    chunks: DataFrame,
    entities: DataFrame,
    mentions: DataFrame,
    links: DataFrame,
) -> dict[str, DataFrame]:
    """Card of every document as three tables: document with chunk count, entities, related."""
    wanted = ids.select("id").distinct()
    counts = chunks.groupBy(F.col("document_id").alias("id")).agg(F.count(F.lit(1)).alias("chunks"))
    card = (
        documents.join(wanted, "id", "left_semi")
        .join(counts, "id", "left")
        .withColumn("chunks", F.coalesce("chunks", F.lit(0)))
    )
    mentioned = entities_of_documents(mentions, entities).join(
        wanted.select(F.col("id").alias("document_id")), "document_id", "left_semi"
    )
    related = related_documents(card.select(F.col("id").alias("root")), documents, links)
    return {"document": card, "entities": mentioned, "related": related}
