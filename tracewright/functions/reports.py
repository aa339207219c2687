"""Text and JSON reports over the engine's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATEMENT = ("source_file", "statement_index")


def edge_lines(edges: DataFrame) -> DataFrame:
    """``line`` for each edge: id, kind, ends, transform and expression."""
    text = F.concat("edge_id", F.lit("  "), "kind", F.lit("  "), "from_id", F.lit(" -> "), "to_id", F.lit("  ["), "transform", F.lit("]"), F.coalesce(F.concat(F.lit("  «"), "expression", F.lit("»")), F.lit("")))
    return edges.select(*STATEMENT, "ordinal", text.alias("line"))


def summary(facts: DataFrame) -> DataFrame:
    """How many statements, edges, columns, scopes, unknowns, diagnostics and tables each source has."""
    n = lambda what: F.sum((F.col("what") == what).cast("long")).alias(what + "s")
    return facts.groupBy("source_file").agg(*[n(w) for w in ("statement", "edge", "column", "scope", "unknown", "diagnostic", "table")])


def parse_report(facts: DataFrame) -> DataFrame:
    """``(source_file, report)``: JSON of each source's tables and diagnostics, in text order."""
    item = F.struct("statement_index", "ordinal", "body")
    of = lambda what: F.transform(F.sort_array(F.collect_list(F.when(F.col("what") == what, item))), lambda x: x["body"])
    one = facts.groupBy("source_file").agg(of("table").alias("tables"), of("diagnostic").alias("diagnostics"))
    listed = lambda c: F.concat(F.lit("["), F.array_join(c, ","), F.lit("]"))
    return one.select("source_file", F.concat(F.lit('{"tables":'), listed("tables"), F.lit(',"diagnostics":'), listed("diagnostics"), F.lit("}")).alias("report"))


def impact_report(reached: DataFrame, nodes: DataFrame, origin: str, direction: str = "DOWNSTREAM", truncated: bool = False) -> DataFrame:
    """``line``: JSON head, then a JSON line for each node, by distance and id."""
    head = nodes.sparkSession.createDataFrame([(origin, direction, truncated)], "origin string, direction string, truncated boolean").select(F.lit(-1).alias("distance"), F.lit("").alias("id"), F.to_json(F.struct("origin", "direction", "truncated")).alias("line"))
    rows = reached.join(nodes, "id", "left").select("distance", "id", F.to_json(F.struct("id", "distance", F.coalesce("is_output", F.lit(False)).alias("isOutput"))).alias("line"))
    return head.unionByName(rows).orderBy("distance", "id").select("line")


def model_report(facts: DataFrame) -> DataFrame:
    """``(source_file, statement_index, report)``: JSON of each statement with its tables, scopes, columns, edges, unknowns and diagnostics, each in its order."""
    item = F.struct("ordinal", "body")
    parts = ("statement", "table", "scope", "column", "edge", "unknown", "diagnostic")
    of = lambda what: F.transform(F.sort_array(F.collect_list(F.when(F.col("what") == what, item))), lambda x: x["body"])
    one = facts.groupBy(*STATEMENT).agg(*[of(w).alias(w) for w in parts])
    listed = lambda c: F.concat(F.lit(f'"{c}s":['), F.array_join(c, ","), F.lit("]"))
    return one.select(*STATEMENT, F.concat(F.lit("{"), F.concat_ws(",", *map(listed, parts)), F.lit("}")).alias("report"))


def format_report(formatted: DataFrame, engine: str = "tokens") -> DataFrame:
    """``(source_file, report)``: JSON with the engine, the text if there is one, and the diagnostics."""
    return formatted.select("source_file", F.to_json(F.struct(F.lit(engine).alias("engine"), F.col("text").alias("sql"), "diagnostics")).alias("report"))


def validate_report(scripts: DataFrame, found: DataFrame, engine: str = "tokens") -> DataFrame:
    """``(source_file, report)``: JSON with the engine and what validation found, for each script, those without findings too."""
    item = F.struct("ordinal", "code", "message", "span_start", "span_end")
    by = found.groupBy(F.col("source_file").alias("f")).agg(F.transform(F.sort_array(F.collect_list(item)), lambda x: x.dropFields("ordinal")).alias("diagnostics"))
    none = F.array().cast(by.schema["diagnostics"].dataType)
    told = scripts.select("source_file").distinct().join(by, F.col("source_file").eqNullSafe(F.col("f")), "left")
    return told.select("source_file", F.to_json(F.struct(F.lit(engine).alias("engine"), F.coalesce("diagnostics", none).alias("diagnostics"))).alias("report"))


def compatibility_lines(cells: DataFrame) -> DataFrame:
    """``line`` for each cell of the compatibility matrix."""
    verdict = F.when(F.col("ok"), F.concat(F.lit("ok, "), F.col("statements").cast("string"), F.lit(" statements, "), F.col("unknowns").cast("string"), F.lit(" unknowns"))).otherwise(F.concat(F.lit("failed: "), F.coalesce("reason", F.lit(""))))
    return cells.select("case_id", F.concat_ws("  ", "case_id", "dialect", "engine", verdict).alias("line"))


def quality_lines(ratios: DataFrame, key: str) -> DataFrame:
    """``line`` for each row of precision and recall; a share without a base is ``n/a``."""
    share = lambda c: F.when(F.col(c).isNull(), F.lit("n/a")).otherwise(F.concat(F.format_number(F.col(c) * 100, 2), F.lit("%")))
    return ratios.select(F.concat_ws("  ", F.col(key).cast("string"), F.concat(F.lit("precision "), share("precision")), F.concat(F.lit("recall "), share("recall"))).alias("line"))
