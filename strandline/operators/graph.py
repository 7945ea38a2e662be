"""Entities, relationships and communities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..common import discard, is_finite, materialize, running


def first_url(urls: Column) -> Column:
    return F.coalesce(F.try_element_at(urls, F.lit(1)), F.lit(""))


def entity_hits(entities: DataFrame) -> DataFrame:
    """Entities as hits: ``id, title, content, url``."""
    content = F.format_string("%s (%s): %s", F.coalesce("name", F.lit("")), F.coalesce("type", F.lit("")), F.coalesce("description", F.lit("")))
    return entities.select("id", F.col("name").alias("title"), content.alias("content"), first_url(F.col("source_urls")).alias("url"))


def community_hits(communities: DataFrame) -> DataFrame:
    return communities.select("id", "title", F.coalesce("summary", F.lit("")).alias("content"), first_url(F.col("source_urls")).alias("url"))


def relationship_hits(edges: DataFrame) -> DataFrame:
    score = F.when(is_finite(F.col("weight")), F.col("weight"))
    return edges.select("id", F.concat_ws(" — ", "source", "target").alias("title"), F.coalesce("description", F.lit("")).alias("content"), first_url(F.col("source_urls")).alias("url"), score.alias("score"))


def _gathered(rows: DataFrame, keys: list[str], value: Column, seen: Column, name: str) -> DataFrame:
    """``keys..., name``: the distinct non-empty values of each group in the order in which they are first seen.

    Values are made distinct before they are gathered, so a group gathers what comes out and no more.
    """
    rows = rows.select(*keys, value.alias("x_"), seen.alias("s_")).where("coalesce(x_, '') != ''")
    first = rows.groupBy(*keys, "x_").agg(F.min("s_").alias("s_"))
    return first.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("s_", "x_"))), lambda r: r["x_"]).alias(name))


def _merged(rows: DataFrame, keys: list[str], more: list[Column]) -> DataFrame:
    """Rows of the same ``keys`` as one: all descriptions, ``source_ids`` and ``source_urls`` in the order first seen (by id), and ``more``."""
    urls = rows.select("id", *keys, F.posexplode("source_urls").alias("at", "url"))
    none = F.array().cast("array<string>")
    out = rows.groupBy(*keys).agg(*more)
    for part in (
        _gathered(rows, keys, F.col("description"), F.col("id"), "descriptions"),
        _gathered(rows, keys, F.col("id"), F.col("id"), "source_ids"),
        _gathered(urls, keys, F.col("url"), F.struct("id", "at"), "source_urls"),
    ):
        out = out.join(part, keys, "left")
    return out.select(*out.columns[: len(keys) + len(more)], F.array_join(F.coalesce("descriptions", none), "\n").alias("description"), F.coalesce("source_ids", none).alias("source_ids"), F.coalesce("source_urls", none).alias("source_urls"))


def merge_entities(entities: DataFrame) -> DataFrame:
    """``name, type, mentions, description, source_ids, source_urls``: entities of one name in upper case; the type of the
    least id, all descriptions, the ids and urls that it comes from. Rows without a name are left out."""
    named = entities.where(F.coalesce("name", F.lit("")) != "").withColumn("name", F.upper("name"))
    return _merged(named, ["name"], [F.min_by(F.upper("type"), F.struct("id", "type")).alias("type"), F.countDistinct("id").alias("mentions")])


def merge_relationships(edges: DataFrame) -> DataFrame:
    """``source, target, weight, description, source_ids, source_urls``: directed edges of the same ends; the largest finite
    weight, 1 without one."""
    rows = edges.where("source is not null and target is not null").withColumns({"source": F.upper("source"), "target": F.upper("target")})
    weight = F.max(F.when(is_finite(F.col("weight")), F.col("weight")))
    return _merged(rows, ["source", "target"], [F.coalesce(weight, F.lit(1.0)).alias("weight")])


def entity_documents(entities: DataFrame) -> DataFrame:
    """``id, name, type, description, community_id, source_urls``: merged entities, numbered in the order first seen; -1 without
    a community."""
    place = entities.where("name is not null").groupBy(F.upper("name").alias("name")).agg(F.min("community_id").alias("c"))
    rows = merge_entities(entities).withColumn("first", F.col("source_ids")[0]).join(place, "name", "left")
    no = running(rows.select("name", "first", F.lit(0).alias("all")), ["all"], ["first", "name"]).select("name", "place")
    return rows.join(no, "name").select(F.concat(F.lit("entity-"), F.col("place")).alias("id"), "name", "type", "description", F.coalesce("c", F.lit(-1)).alias("community_id"), "source_urls")


def relationship_documents(edges: DataFrame) -> DataFrame:
    """``id, source, target, description, weight, source_urls``: merged edges, numbered in the order first seen."""
    rows = merge_relationships(edges).withColumn("first", F.col("source_ids")[0])
    no = running(rows.select("source", "target", "first", F.lit(0).alias("all")), ["all"], ["first", "source", "target"]).select("source", "target", "place")
    return rows.join(no, ["source", "target"]).select(F.concat(F.lit("rel-"), F.col("place")).alias("id"), "source", "target", "description", "weight", "source_urls")


def community_documents(communities: DataFrame, entities: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, title, summary, source_urls``: the urls of a community's members, then of the edges within it, each once.

    ``communities`` has ``id`` whose number is the ``community_id`` of its members; those without any keep no urls.
    """
    members = entities.where("community_id is not null and name is not null").select("community_id", F.lit(0).alias("leg"), "id", F.posexplode("source_urls").alias("at", "url"))
    within = community_edges(edges, entities).distinct().join(edges.select("id", "source_urls"), "id")
    urls = members.unionByName(within.select("community_id", F.lit(1).alias("leg"), "id", F.posexplode("source_urls").alias("at", "url")))
    urls = _gathered(urls, ["community_id"], F.col("url"), F.struct("leg", "id", "at"), "source_urls")
    rows = communities.select("id", "title", "summary", F.regexp_extract("id", r"([0-9]+)$", 1).cast("int").alias("community_id")).distinct()
    return rows.join(urls, "community_id", "left").select(F.concat(F.lit("community-"), F.col("community_id")).alias("id"), "title", F.coalesce("summary", F.lit("")).alias("summary"), F.coalesce("source_urls", F.array().cast("array<string>")).alias("source_urls"))


def adjacency(edges: DataFrame) -> DataFrame:
    """``key, id, other``: each edge under both its ends in upper case; a self-loop once."""
    rows = edges.select("id", F.upper("source").alias("s"), F.upper("target").alias("t")).where("s is not null and t is not null").distinct()
    out = rows.select(F.col("s").alias("key"), "id", F.col("t").alias("other"))
    return out.unionByName(rows.where("s != t").select(F.col("t").alias("key"), "id", F.col("s").alias("other")))


def expand(seeds: DataFrame, entities: DataFrame, edges: DataFrame) -> DataFrame:
    """One hop from ranked seed entities: ``query_id, id, score, rank`` of the seeds, then of their edges, each once, in order
    of first seen.

    ``seeds`` has ``query_id, id, score, rank``. An edge's score is its weight (1 where it has none).
    """
    names = entities.select("id", F.upper("name").alias("key")).where("key is not null").distinct()
    weight = edges.groupBy("id").agg(F.max(F.when(is_finite(F.col("weight")), F.col("weight"))).alias("w"))
    found = seeds.select("query_id", "id", F.col("rank").alias("seed")).join(names, "id").drop("id").join(adjacency(edges), "key")
    best = found.groupBy("query_id", "id").agg(F.min("seed").alias("seed")).join(weight, "id").select("query_id", "id", F.coalesce("w", F.lit(1.0)).alias("score"), "seed")
    rows = best.select("*", F.lit(1).alias("leg")).unionByName(seeds.select("query_id", "id", "score", F.col("rank").alias("seed"), F.lit(0).alias("leg")))
    order = Window.partitionBy("query_id").orderBy("leg", "seed", "id")
    return rows.select("query_id", "id", "score", (F.row_number().over(order) - 1).alias("rank"))


def modularity_communities(edges: DataFrame, nodes: DataFrame | None = None, levels: int = 3, rounds: int = 6) -> DataFrame:
    """``node, community``: communities of high modularity in the undirected weighted graph ``source, target, weight``.

    Nodes move to the neighbouring community that raises the modularity most, half of them (by hash) at a time so that
    neighbours do not swap; when a level's moves end, or after ``rounds``, its communities become the nodes of the next. ``nodes`` (``node``) adds
    nodes without edges, each a community of its own, and leaves out edges with other ends. Communities are named by
    their least node. Weights that are not finite and positive count 1; what is gathered of a node is one sum for
    each community around it.
    """
    weight = F.when(is_finite(F.col("weight")) & (F.col("weight") > 0), F.col("weight")).otherwise(1.0)
    rows = edges.select(F.col("source").alias("u"), F.col("target").alias("v"), weight.alias("w")).where("u is not null and v is not null")
    if nodes is not None:
        known = nodes.select("node").where("node is not null").distinct()
        rows = rows.join(known.withColumnRenamed("node", "u"), "u", "left_semi").join(known.withColumnRenamed("node", "v"), "v", "left_semi")
    # both directions; a loop once with its double weight, as it adds to its node's degree
    both = rows.where("u != v").select("u", "v", "w").unionAll(rows.where("u != v").select(F.col("v").alias("u"), F.col("u").alias("v"), "w")).unionAll(rows.where("u = v").select("u", "v", F.col("w") * 2))
    graph = materialize(both.groupBy("u", "v").agg(F.sum("w").alias("w")))
    own = graph.select(F.col("u").alias("node")).distinct()
    named = materialize(own.select("node", F.col("node").alias("community")))
    for _ in range(levels):
        degree = materialize(graph.groupBy("u").agg(F.sum("w").alias("k")))
        total = F.broadcast(degree.agg(F.sum("k").alias("m2")))  # one row
        place = materialize(degree.select(F.col("u").alias("node"), F.col("u").alias("c")))
        still = 0
        for turn in range(rounds):
            size = place.join(degree.withColumnRenamed("u", "node"), "node").groupBy("c").agg(F.sum("k").alias("sum_c"))
            movers = graph.where((F.pmod(F.xxhash64("u"), F.lit(2)) == turn % 2) & (F.col("u") != F.col("v")))
            toward = movers.join(place.select(F.col("node").alias("v"), "c"), "v").groupBy("u", "c").agg(F.sum("w").alias("w"))
            here = place.select(F.col("node").alias("u"), F.col("c").alias("now"))
            choice = toward.join(here, "u").join(degree, "u").join(size, "c").crossJoin(total)
            others = F.col("sum_c") - F.when(F.col("c") == F.col("now"), F.col("k")).otherwise(0.0)
            choice = choice.withColumn("gain", F.round(F.col("w") - F.col("k") * others / F.col("m2"), 9))
            # what staying is worth: the own community without the node itself
            alone = here.join(degree, "u").join(size.withColumnRenamed("c", "now"), "now").crossJoin(total).select("u", "now", F.round(-F.col("k") * (F.col("sum_c") - F.col("k")) / F.col("m2"), 9).alias("base"))
            best = choice.groupBy("u").agg(F.max(F.struct("gain", "c")).alias("b"), F.max(F.when(F.col("c") == F.col("now"), F.col("gain"))).alias("stay"))
            moved = best.join(alone, "u").where(F.col("b.gain") > F.coalesce("stay", "base")).select(F.col("u").alias("node"), F.col("b.c").alias("to"))
            new = materialize(place.join(moved, "node", "left").select("node", F.coalesce("to", "c").alias("c"), F.col("to").isNotNull().alias("moved")))
            changed = not new.where("moved").isEmpty()
            discard(place)
            place = new.select("node", "c")
            still = 0 if changed else still + 1
            if still == 2:
                break
        after = materialize(named.join(place.withColumnRenamed("node", "community"), "community").select("node", F.col("c").alias("community")))
        merged = graph.join(place.select(F.col("node").alias("u"), F.col("c").alias("cu")), "u").join(place.select(F.col("node").alias("v"), F.col("c").alias("cv")), "v")
        graph_ = materialize(merged.groupBy(F.col("cu").alias("u"), F.col("cv").alias("v")).agg(F.sum("w").alias("w")))
        shrunk = after.select("community").distinct().count() < named.select("community").distinct().count()
        discard(graph, named)
        graph, named = graph_, after
        if not shrunk:
            break
    if nodes is not None:
        named = known.join(named, "node", "left").select("node", F.coalesce("community", "node").alias("community"))
    least = named.groupBy("community").agg(F.min("node").alias("least"))
    return named.join(least, "community").select("node", F.col("least").alias("community"))


def known_edges(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges whose two ends are both names of entities, each id once."""
    names = entities.select(F.upper("name").alias("n")).where("n is not null").distinct()
    rows = edges.select("id", F.upper("source").alias("source"), F.upper("target").alias("target")).distinct()
    rows = rows.join(names.withColumnRenamed("n", "source"), "source", "left_semi")
    return rows.join(names.withColumnRenamed("n", "target"), "target", "left_semi").select("id", "source", "target")


def community_edges(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """``id, community_id``: edges within one community; ends without an entity have community -1 and no edge there."""
    place = entities.where("name is not null").groupBy(F.upper("name").alias("n")).agg(F.min(F.coalesce("community_id", F.lit(-1))).alias("c"))
    rows = edges.select("id", F.upper("source").alias("s"), F.upper("target").alias("t")).distinct()
    rows = rows.join(place.select(F.col("n").alias("s"), F.col("c").alias("cs")), "s", "left").join(place.select(F.col("n").alias("t"), F.col("c").alias("ct")), "t", "left")
    rows = rows.select("id", F.coalesce("cs", F.lit(-1)).alias("cs"), F.coalesce("ct", F.lit(-1)).alias("ct"))
    return rows.where("cs = ct and cs != -1").select("id", F.col("cs").alias("community_id"))


def community_sizes(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """``community_id, members, edges, urls``: distinct entities, edges within, distinct urls of both."""
    people = entities.where("community_id is not null and name is not null")
    members = people.groupBy("community_id").agg(F.countDistinct(F.upper("name")).alias("members"))
    within = community_edges(edges, entities).dropDuplicates(["id", "community_id"])
    n_edges = within.groupBy("community_id").agg(F.count("*").alias("edges"))
    urls = people.select("community_id", F.explode("source_urls").alias("u")).unionByName(within.join(edges.select("id", "source_urls"), "id").select("community_id", F.explode("source_urls").alias("u")))
    n_urls = urls.where("coalesce(u, '') != ''").groupBy("community_id").agg(F.countDistinct("u").alias("urls"))
    zero = F.lit(0).cast("bigint")
    out = members.join(n_edges, "community_id", "left").join(n_urls, "community_id", "left")
    return out.select("community_id", "members", F.coalesce("edges", zero).alias("edges"), F.coalesce("urls", zero).alias("urls"))


def components(edges: DataFrame, a: str = "source", b: str = "target", rounds: int = 64) -> DataFrame:
    """``node, component``: connected components, named by their least node, by large-star and small-star rounds.

    Each round rewrites the edges as a written table; it ends when a round changes neither their number nor the sum of
    their hashes. Stars keep the number of edges at that of the nodes, whatever the diameter, and no component is ever
    gathered in one place. A graph that isn't done after ``rounds`` (the rounds grow with the logarithm of the nodes) is an
    error, not an unfinished result.
    """
    links = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    nodes = materialize(links.select(F.col("u").alias("node")).union(links.select("v")).distinct())
    links = materialize(links.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = lambda x: x.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = mark(links)
    for _ in range(rounds):
        both = links.union(links.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        new = materialize(small.select("e.u", "e.v").where("u != v").distinct())
        discard(links)
        links, now = new, mark(new)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components: not done after {rounds} rounds")
    root = links.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return nodes.join(root, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
