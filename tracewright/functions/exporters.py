"""Exports of lineage edges: OpenLineage, Mermaid, DOT, Cypher and JSON.

Each takes ``edges(src, dst, kind, transform, seq)`` of one graph and returns a
DataFrame whose rows, in order, are the text; OpenLineage gives one JSON row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Transform -> OpenLineage transformation type and subtype.
OPENLINEAGE = {
    "DIRECT": ("DIRECT", "IDENTITY"), "EXPRESSION": ("DIRECT", "TRANSFORMATION"), "AGGREGATE": ("DIRECT", "AGGREGATION"),
    "CASE_BRANCH": ("INDIRECT", "CONDITIONAL"), "WINDOW": ("INDIRECT", "WINDOW"), "JOIN_KEY": ("INDIRECT", "JOIN"),
    "FILTER_PREDICATE": ("INDIRECT", "FILTER"), "GROUPING": ("INDIRECT", "GROUP_BY"), "ORDERING": ("INDIRECT", "SORT"),
}


def _lookup(which: int) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for k, v in OPENLINEAGE.items() for x in (k, v[which])]), F.col("transform"))


def table_of(col: str) -> Column:
    return F.nullif(F.regexp_extract(col, r"^(.*)\.[^.]*$", 1), F.lit(""))


def field_of(col: str) -> Column:
    return F.regexp_extract(col, r"([^.]*)$", 1)


def openlineage_fields(edges: DataFrame, outputs: DataFrame) -> DataFrame:
    """``(output, table, field, type, subtype)``: the facet's input fields, for edges to ``outputs(id)``."""
    kept = edges.join(outputs.withColumnRenamed("id", "dst"), "dst", "left_semi").where(F.col("transform").isin(*OPENLINEAGE))
    rows = kept.select(F.col("dst").alias("output"), table_of("src").alias("table"), field_of("src").alias("field"), _lookup(0).alias("type"), _lookup(1).alias("subtype"))
    return rows.where(F.col("table").isNotNull()).distinct()


def openlineage(edges: DataFrame, outputs: DataFrame, namespace: str = "default", job: str = "lineage", run_id: str = "00000000-0000-0000-0000-000000000000", event_time: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """One run event.  Outputs appear only if all output columns have the same table."""
    fields = openlineage_fields(edges, outputs)
    per_input = fields.groupBy("output", "table", "field").agg(F.sort_array(F.collect_set(F.struct("type", "subtype"))).alias("transformations"))
    per_output = per_input.groupBy("output").agg(F.sort_array(F.collect_set(F.struct(F.lit(namespace).alias("namespace"), F.col("table").alias("name"), "field", "transformations"))).alias("inputFields"))
    facet = per_output.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(field_of("output").alias("k"), F.struct("inputFields").alias("v"))))).alias("fields"))
    sources = edges.where("kind = 'SOURCE'").select(F.col("src").alias("name")).union(edges.where("kind <> 'SOURCE'").select(table_of("src"))).where("name IS NOT NULL").distinct()
    inputs = sources.agg(F.transform(F.sort_array(F.collect_list("name")), lambda n: F.struct(F.lit(namespace).alias("namespace"), n.alias("name"))).alias("inputs"))
    target = outputs.select(table_of("id").alias("t")).agg(F.count_distinct("t").alias("n"), F.min("t").alias("t"), F.sum(F.col("t").isNull().cast("int")).alias("bare"))
    one = facet.join(F.broadcast(inputs)).join(F.broadcast(target))  # each side is one row
    dataset = F.struct(F.lit(namespace).alias("namespace"), F.col("t").alias("name"), F.struct(F.struct("fields").alias("columnLineage")).alias("facets"))
    event = F.struct(F.lit("COMPLETE").alias("eventType"), F.lit(event_time).alias("eventTime"), F.struct(F.lit(run_id).alias("runId")).alias("run"), F.struct(F.lit(namespace).alias("namespace"), F.lit(job).alias("name")).alias("job"), "inputs", F.when((F.col("n") == 1), F.array(dataset)).otherwise(F.array()).alias("outputs"))
    return one.select(F.to_json(event).alias("event"))


def mermaid_edges(edges: DataFrame) -> DataFrame:
    """``(src, dst, label)``: parallel edges as one, labels sorted and joined."""
    return edges.groupBy("src", "dst").agg(F.array_join(F.sort_array(F.collect_set("transform")), ", ").alias("label"), F.min("seq").alias("seq"))


def _safe(col: str) -> Column:
    return F.concat(F.lit("n_"), F.regexp_replace(col, "[^A-Za-z0-9_]", "_"))


def mermaid(edges: DataFrame, outputs: DataFrame | None = None) -> DataFrame:
    """Lines of a flow chart; with ``outputs(id)`` their nodes are labelled as such."""
    if outputs is not None:
        ids = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct().join(outputs.select("id").distinct(), "id", "left_semi")
        label = F.replace(F.col("id"), F.lit('"'), F.lit("#quot;"))
        named = ids.select(F.lit(-1).alias("seq"), F.lit("1").alias("src"), F.concat(F.lit("  "), _safe("id"), F.lit('["'), label, F.lit(' (output)"]')).alias("line"))
        return _mermaid_rows(edges).unionByName(named).orderBy("seq", "src", "line").select("line")
    return _mermaid_rows(edges).orderBy("seq", "src", "line").select("line")


def _mermaid_rows(edges: DataFrame) -> DataFrame:
    rows = mermaid_edges(edges).select("seq", "src", F.concat(F.lit("  "), _safe("src"), F.lit(" -->|"), "label", F.lit("| "), _safe("dst")).alias("line"))
    head = edges.sparkSession.createDataFrame([(-1, "", "flowchart LR")], "seq int, src string, line string")
    return head.unionByName(rows)


def _quote(col: str) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(F.col(col), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def dot(edges: DataFrame, outputs: DataFrame) -> DataFrame:
    spark = edges.sparkSession
    names = edges.select(F.col("src").alias("id"), (F.col("kind") == "SOURCE").alias("t")).union(edges.select("dst", F.lit(False))).groupBy("id").agg(F.max("t").alias("t"))
    shape = F.when(F.col("t"), "cylinder").when(F.col("o"), "box").otherwise("ellipse")
    n = names.join(outputs.select("id", F.lit(True).alias("o")), "id", "left").select(F.lit(1).alias("part"), F.lit(0).alias("seq"), F.concat(F.lit("  "), _quote("id"), F.lit(" [shape="), shape, F.lit("];")).alias("line"))
    e = edges.select(F.lit(2).alias("part"), "seq", F.concat(F.lit("  "), _quote("src"), F.lit(" -> "), _quote("dst"), F.lit(' [label="'), "transform", F.lit('"];')).alias("line"))
    ends = spark.createDataFrame([(0, 0, "digraph lineage {"), (0, 1, "  rankdir=LR;"), (3, 0, "}")], "part int, seq int, line string")
    return ends.unionByName(n).unionByName(e).orderBy("part", "seq", "line").select("line")


def cypher(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("src").alias("id"), "seq", F.lit(0).alias("side"), (F.col("kind") == "SOURCE").alias("t")).union(edges.select("dst", "seq", F.lit(1), F.lit(False)))
    first = ends.groupBy("id").agg(F.min(F.struct("seq", "side")).alias("at"), F.max("t").alias("t"))
    text = lambda c: F.concat(F.lit("'"), F.replace(F.replace(F.col(c), F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))
    named = first.withColumn("v", F.concat(F.lit("n"), (F.row_number().over(Window.orderBy("at", "id")) - 1).cast("string")))
    n = named.select(F.lit(0).alias("part"), F.col("at.seq").alias("seq"), F.col("at.side").alias("side"), F.concat(F.lit("MERGE ("), "v", F.when(F.col("t"), ":Table").otherwise(":Column"), F.lit(" {id: "), text("id"), F.lit("})")).alias("line"))
    e = edges.join(named.select(F.col("id").alias("src"), F.col("v").alias("a")), "src").join(named.select(F.col("id").alias("dst"), F.col("v").alias("b")), "dst").select(F.lit(1).alias("part"), "seq", F.lit(0).alias("side"), F.concat(F.lit("MERGE ("), "a", F.lit(")-[:"), "kind", F.lit(" {transform: "), text("transform"), F.lit("}]->("), "b", F.lit(")")).alias("line"))
    return n.unionByName(e).orderBy("part", "seq", "side", "line").select("line")


def stable_json(edges: DataFrame) -> DataFrame:
    return edges.orderBy("seq").select(F.to_json(F.struct("src", "dst", "kind", "transform", "seq")).alias("line"))


#: id -> media type and function
EXPORTERS = {
    "openlineage": ("application/json", openlineage), "mermaid": ("text/vnd.mermaid", mermaid), "dot": ("text/vnd.graphviz", dot),
    "cypher": ("application/x-cypher", cypher), "json": ("application/json", stable_json),
}


def exporter(name: str):
    """The function of an exporter id, in any letter case."""
    if name.lower() not in EXPORTERS:
        raise KeyError(f"unknown_format: {name}; one of {', '.join(EXPORTERS)}")
    return EXPORTERS[name.lower()][1]
