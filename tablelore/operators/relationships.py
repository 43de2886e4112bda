"""Relationships between tables: declared foreign keys, and links inferred from names.

Inputs are catalogue frames that may hold many databases at once. A column can only point at a table that owns a
column of the same name, so parents are ranked once per (source, name), the best two are kept, and children join
those: the work grows with the number of columns, however often a name such as customer_id repeats.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tablelore.functions import names
from tablelore.operators.catalog import catalog_fks, fk_pairs
from tablelore.session import settle

# Confidence of inferred links.
SAME_COLUMN = 0.95
SAME_ENTITY = 0.80
OVERLAP = 0.60

TABLE = ["source", "table_name"]
EDGE = ["source", "from_table", "from_column", "to_table", "to_column"]


# ---- declared edges ----------------------------------------------------------------------------------------------

def explicit_edges(keys: DataFrame) -> DataFrame:
    """One edge per column pair of a declared foreign key, each pair once."""
    pairs = fk_pairs(keys).filter(F.col("to_table").isNotNull()).withColumnRenamed("table_name", "from_table")
    at = F.min(F.struct("fk_position", "pair_position"))
    return (pairs.groupBy(*EDGE).agg(at.alias("at"))
            .select(*EDGE, F.lit(True).alias("is_explicit"), F.lit(1.0).alias("confidence"),
                    F.col("at.fk_position").alias("position"), F.col("at.pair_position").alias("pair_position")))


# ---- inferred edges ----------------------------------------------------------------------------------------------

def _near_score(stem: Column, core: Column) -> Column:
    return F.when(names.stem_near_core(stem, core), SAME_ENTITY).when(names.stem_overlaps_core(stem, core), OVERLAP)


def _parents(columns: DataFrame) -> DataFrame:
    """Each table's columns by name key; of two spellings of one key the later column counts."""
    spelled = (columns.withColumn("key", names.name_key(F.col("column_name")))
               .groupBy(*TABLE, "key")
               .agg(F.max_by("column_name", "ordinal").alias("to_column"),
                    F.bool_or("is_primary_key").alias("key_is_primary")))
    core = names.entity_core(F.col("table_name"))
    return spelled.withColumn("core", core).withColumn("stem", names.id_stem(F.col("key")))


def _best_two(candidates: DataFrame, key: str) -> DataFrame:
    """Two parents suffice: of the ranked parents of a name only one can be the child's own table."""
    w = Window.partitionBy("source", key).orderBy(F.desc("confidence"), "to_table", "to_column")
    return (candidates.filter(F.col("confidence") >= OVERLAP)
            .withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= 2).drop("rank"))


def _named_parents(parents: DataFrame) -> DataFrame:
    """Parents that own a column of the very name."""
    stem, core = F.col("stem"), F.col("core")
    score = (F.when(F.col("key_is_primary") | names.stem_is_core(stem, core), SAME_COLUMN)
             .otherwise(_near_score(stem, core)))
    return _best_two(
        parents.select("source", "key", F.col("table_name").alias("to_table"), "to_column", score.alias("confidence")),
        "key")


def _stem_parents(parents: DataFrame, primary: DataFrame) -> DataFrame:
    """Parents of odd spellings such as order__id: tables that own order_id."""
    stem, core = F.col("stem"), F.col("core")
    plain = parents.filter(F.col("key") == F.concat(stem, F.lit("_id")))
    score = F.when(names.stem_is_core(stem, core), SAME_ENTITY).otherwise(_near_score(stem, core))
    only_key = F.when(F.size("primary_keys") == 1, F.element_at("primary_keys", 1))
    return _best_two(
        plain.join(primary, TABLE, "left")
        .select("source", F.col("key").alias("plain_key"), F.col("table_name").alias("to_table"),
                F.coalesce(only_key, F.col("to_column")).alias("to_column"), score.alias("confidence")),
        "plain_key")


def implicit_edges(columns: DataFrame, keys: DataFrame) -> DataFrame:
    """At most one inferred edge per column: highest confidence, then table name, then column name.

    Parents and children are worked out once and settled, with the names they are compared by: each is read twice.
    """
    primary = keys.select(*TABLE, "primary_keys")
    parents = settle(_parents(columns))
    core = names.entity_core(F.col("table_name"))
    sole_key = F.coalesce((F.size("primary_keys") == 1) & F.array_contains("primary_keys", F.col("column_name")), F.lit(False))
    children = (columns.join(primary, TABLE, "left")
                .withColumn("key", names.name_key(F.col("column_name")))
                .filter(~(F.col("is_foreign_key") & (F.coalesce("foreign_key_references", F.lit("")) != ""))
                        & ~sole_key & ~names.owns_id(F.col("key"), core))
                .select("source", F.col("table_name").alias("from_table"), F.col("column_name").alias("from_column"),
                        "ordinal", "key", names.id_stem(F.col("key")).alias("stem")))
    children = settle(children)
    same = children.join(_named_parents(parents), ["source", "key"]).withColumn("way", F.lit(0))
    plain_key = F.concat("stem", F.lit("_id"))
    odd = (children.filter(F.col("key") != plain_key).withColumn("plain_key", plain_key)
           .join(_stem_parents(parents, primary), ["source", "plain_key"]).withColumn("way", F.lit(1)))
    cols = ["source", "from_table", "from_column", "ordinal", "to_table", "to_column", "confidence", "way"]
    found = same.select(*cols).unionByName(odd.select(*cols)).filter(F.col("from_table") != F.col("to_table"))
    order = F.struct(-F.col("confidence"), "to_table", "way", "to_column")
    best = F.min_by(F.struct("to_table", "to_column", "confidence"), order)
    return (found.groupBy("source", "from_table", "from_column", "ordinal").agg(best.alias("b"))
            .select("source", "from_table", "from_column", F.col("b.to_table").alias("to_table"),
                    F.col("b.to_column").alias("to_column"), F.lit(False).alias("is_explicit"),
                    F.col("b.confidence").alias("confidence"), F.col("ordinal").alias("position"),
                    F.lit(0).alias("pair_position")))


# ---- cardinality -------------------------------------------------------------------------------------------------

def junction_tables(keys: DataFrame) -> DataFrame:
    """Tables whose primary key is made of exactly their foreign-key columns, to two or more tables."""
    fks = catalog_fks(keys)
    facts = fks.groupBy(*TABLE).agg(
        F.count(F.lit(1)).alias("n_fks"),
        F.collect_set(F.nullif("referred_table", F.lit(""))).alias("referred"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("constrained_columns")))).alias("fk_columns"))
    pk = F.array_sort(F.array_distinct("primary_keys"))
    return (facts.join(keys.select(*TABLE, "primary_keys"), TABLE)
            .filter((F.col("n_fks") >= 2) & (F.size("referred") >= 2) & (F.size("primary_keys") > 0)
                    & (pk == F.col("fk_columns")))
            .select(*TABLE, "referred"))


def linked_by_junction(pairs: DataFrame, junctions: DataFrame) -> DataFrame:
    """The (source, from_table, to_table) pairs that some third table links.

    Starts from the pairs that have an edge, at the end with fewer junctions, and asks whether one of these holds the other end too. So a table that
    thousands of junctions refer to costs a row for each junction of the tables around it, and no junction spells out its own pairs.
    """
    ends = junctions.select("source", F.col("table_name").alias("junction"), F.explode("referred").alias("end"))
    degree = ends.groupBy("source", "end").agg(F.count(F.lit(1)).alias("degree"))

    def known(side: str) -> DataFrame:
        return degree.select("source", F.col("end").alias(side), F.col("degree").alias(f"degree_{side}"))

    # a table no junction refers to is linked with nothing
    both = pairs.join(known("from_table"), ["source", "from_table"]).join(known("to_table"), ["source", "to_table"])
    fewer = F.col("degree_from_table") <= F.col("degree_to_table")
    walk = both.select("source", "from_table", "to_table", F.when(fewer, F.col("from_table")).otherwise(F.col("to_table")).alias("near"),
                       F.when(fewer, F.col("to_table")).otherwise(F.col("from_table")).alias("far"))
    third = (F.col("junction") != F.col("from_table")) & (F.col("junction") != F.col("to_table"))
    return (walk.join(ends.withColumnRenamed("end", "near"), ["source", "near"]).filter(third)
            .join(ends.withColumnRenamed("end", "far"), ["source", "junction", "far"], "left_semi")
            .select("source", "from_table", "to_table").distinct())


def with_cardinality(edges: DataFrame, columns: DataFrame, keys: DataFrame) -> DataFrame:
    """Label each edge; the first rule that fits decides."""
    junctions = junction_tables(keys)
    own = junctions.select("source", F.col("table_name").alias("from_table"), F.lit(True).alias("from_junction"))
    pairs = edges.select("source", "from_table", "to_table").distinct()
    linked = linked_by_junction(pairs, junctions).withColumn("linked", F.lit(True))
    sole = (keys.filter(F.size(F.array_distinct("primary_keys")) == 1)
            .select(*TABLE, F.element_at("primary_keys", 1).alias("column_name"))
            .join(columns.filter("is_foreign_key"), [*TABLE, "column_name"])
            .select("source", F.col("table_name").alias("from_table"), F.col("foreign_key_references").alias("key_points_to")))
    label = (F.when(F.col("from_junction"), "one_to_many")
             .when(F.col("linked"), "many_to_many")
             .when(F.col("key_points_to").startswith(F.concat("to_table", F.lit("."))), "one_to_one")
             .otherwise("one_to_many"))
    return (edges.join(own, ["source", "from_table"], "left")
            .join(linked, ["source", "from_table", "to_table"], "left")
            .join(sole, ["source", "from_table"], "left")
            .select(*EDGE, label.alias("relationship_type"), "is_explicit", "confidence", "position", "pair_position"))


def relationships(columns: DataFrame, keys: DataFrame) -> DataFrame:
    """Declared and inferred edges with their cardinality. Columns are read three times and edges twice, so both are settled once."""
    columns = settle(columns)
    return with_cardinality(settle(explicit_edges(keys).unionByName(implicit_edges(columns, keys))), columns, keys)


# ---- views of the edges ------------------------------------------------------------------------------------------

def adjacency(edges: DataFrame) -> DataFrame:
    """Edges grouped by the ordered pair of tables; tables that are only pointed at come with no edge. Edges are read once: both ends come from the
    groups, which are settled."""
    arcs = edges.groupBy("source", "from_table", "to_table").agg(F.array_sort(F.collect_list(F.struct(
        (~F.col("is_explicit")).alias("inferred"), "position", "pair_position", "from_column", "to_column",
        "relationship_type", "is_explicit", "confidence"))).alias("sorted_edges"))
    payload = F.transform("sorted_edges", lambda e: F.struct(
        *[e[f].alias(f) for f in ("from_column", "to_column", "relationship_type", "is_explicit", "confidence")]))
    arcs = settle(arcs.select("source", "from_table", "to_table", payload.alias("edges")))
    nodes = arcs.select("source", F.explode(F.array("from_table", "to_table")).alias("from_table")).distinct()
    return nodes.join(arcs, ["source", "from_table"], "left")


def edges_by_table(edges: DataFrame) -> DataFrame:
    """Each edge under every table it touches; an edge from a table to itself counts once."""
    return edges.withColumn("table_name", F.explode(F.array_distinct(F.array("from_table", "to_table"))))


def edge_text() -> Column:
    return F.concat("from_table", F.lit("."), "from_column", F.lit(" -> "), "to_table", F.lit("."), "to_column")


def edge_lists(edges: DataFrame) -> DataFrame:
    """The distinct readable edges of each table, sorted."""
    return (edges_by_table(edges).select(*TABLE, edge_text().alias("edge")).distinct()
            .groupBy(*TABLE).agg(F.array_sort(F.collect_list("edge")).alias("relationships")))


def diagram_lines(edges: DataFrame, tables: DataFrame) -> DataFrame:
    """Entity-relationship diagram as ordered lines; a source without edges has none.

    The "one" mark stands at the table pointed at, so the ends are swapped against the edge's direction.
    """
    arrow = (F.when(F.col("relationship_type") == "one_to_many", "||--o{")
             .when(F.col("relationship_type") == "many_to_many", "}o--o{")
             .when(F.col("relationship_type") == "one_to_one", "||--||"))
    sources = edges.select("source").distinct()
    head = sources.select("source", F.lit(0).alias("section"), F.lit("").alias("sort_key"), F.lit(0).alias("position"),
                          F.lit(0).alias("pair_position"), F.lit("erDiagram").alias("line"))
    body = edges.filter(arrow.isNotNull()).select(
        "source", F.when(F.col("is_explicit"), 1).otherwise(2).alias("section"), F.col("from_table").alias("sort_key"),
        "position", "pair_position",
        F.concat(F.lit("    "), names.diagram_name(F.col("to_table")), F.lit(" "), arrow, F.lit(" "),
                 names.diagram_name(F.col("from_table")), F.lit(' : "'), names.diagram_label(F.col("from_column")),
                 F.lit('"')).alias("line"))
    boxes = (tables.select("source", "table_name").join(sources, "source", "left_semi")
             .select("source", F.lit(3).alias("section"), F.col("table_name").alias("sort_key"),
                     F.explode(F.array(
                         F.struct(F.lit(0).alias("position"),
                                  F.concat(F.lit("    "), names.diagram_name(F.col("table_name")), F.lit(" {")).alias("line")),
                         F.struct(F.lit(1).alias("position"), F.lit("    }").alias("line")))).alias("b"))
             .select("source", "section", "sort_key", "b.position", F.lit(0).alias("pair_position"), "b.line"))
    return head.unionByName(body).unionByName(boxes)


def diagram_text(lines: DataFrame) -> DataFrame:
    """The whole diagram of each source as one text."""
    ordered = F.array_sort(F.collect_list(F.struct("section", "sort_key", "position", "pair_position", "line")))
    return lines.groupBy("source").agg(F.array_join(ordered["line"], "\n").alias("diagram"))
