"""Normalised syntax trees as tables, their search and their difference."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.parser import Expr, Query, Scope, SqlError, Statement, parse
from ..functions.scan import split_statements

NODES = "source_file string, statement_index int, node_id int, parent_id int, depth int, path string, type string, text string, span_start int, span_end int"


def tree(st: Statement, sql: str, offset: int = 0) -> list[tuple]:
    """``(node, parent, depth, path, type, text, start, end)`` in depth-first order."""
    out: list[tuple] = []

    def put(kind: str, s: int, e: int, parent: int | None, depth: int) -> int:
        me = len(out)
        path = (out[parent][3] + "/" if parent is not None else "") + f"{me:06d}"
        out.append((me, parent, depth, path, kind, sql[max(0, s - offset) : max(0, e - offset)], s, e))
        return me

    def expr(x: Expr, parent: int, depth: int) -> None:
        kind = {"function": "function", "binary": "binary_op", "unary": "signed", "star": "all_table_columns" if x.qualifier else "all_columns", "window": "window_function", "unknown": "unknown_node"}.get(x.kind, x.kind)
        me = put(kind, x.start, x.end, parent, depth)
        for a in [*x.args, *x.extra]:
            expr(a, me, depth + 1)
        if x.query is not None:
            query(x.query, me, depth + 1)

    def scope(s: Scope, parent: int | None, depth: int) -> None:
        me = put("plain_select", s.start, s.end, parent, depth)
        for o in s.outputs:
            k = put("select_item", o.expr.start, o.expr.end, me, depth + 1)
            expr(o.expr, k, depth + 2)
        for src in s.sources:
            k = put("derived_table" if src.query else "table", src.start, src.end, me, depth + 1)
            if src.query:
                query(src.query, k, depth + 2)
        for j in s.joins:
            k = put("join", j.start, j.end, me, depth + 1)
            for x in j.on:
                expr(x, k, depth + 2)
        for kind, xs in (("where", s.where), ("group_by", s.group), ("having", s.having), ("order_by", s.order)):
            if xs:
                k = put(kind, xs[0].start, xs[-1].end, me, depth + 1)
                for x in xs:
                    expr(x, k, depth + 2)

    def query(q: Query, parent: int | None, depth: int) -> None:
        if q.ctes or q.branches:
            me = put("set_operation" if q.branches else "select", st.start, st.end, parent, depth)
            for _, _, b in q.ctes:
                k = put("cte", b.scope.start if b.scope else st.start, b.scope.end if b.scope else st.end, me, depth + 1)
                query(b, k, depth + 2)
            for b in q.branches:
                query(b, me, depth + 1)
            if q.scope:
                scope(q.scope, me, depth + 1)
        elif q.scope:
            scope(q.scope, parent, depth)

    if st.kind == "SELECT" and st.query:
        query(st.query, None, 0)
        return out
    me = put(st.kind.lower(), st.start, st.end, None, 0)
    if st.query:
        query(st.query, me, 1)
    elif st.scope:
        scope(st.scope, me, 1)
    return out


def nodes(scripts: DataFrame) -> DataFrame:
    """Flattened trees of ``scripts(source_file, sql)``."""

    def run(frames):
        for f in frames:
            rows = []
            for src, sql in zip(f["source_file"], f["sql"]):
                i = -1
                for start, _, text in split_statements(sql or ""):
                    try:
                        st = parse(text, start)
                    except SqlError:
                        i += 1
                        continue
                    for x in (st, *st.more):
                        i += 1
                        rows += [(src, i, *n) for n in tree(x, text, start)]
            yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in NODES.split(", ")]).astype({"parent_id": "Int32"})

    return scripts.select("source_file", "sql").mapInPandas(run, NODES)


def search(tree_nodes: DataFrame, text: str) -> DataFrame:
    """Nodes whose type or whitespace-folded text contains ``text``, in any letter case, and ``hit`` false for their ancestors."""
    low = text.lower()
    hit = F.contains(F.lower("type"), F.lit(low)) | F.contains(F.lower(F.regexp_replace("text", r"\s+", " ")), F.lit(low))
    hits = tree_nodes.where(hit)
    key = ["source_file", "statement_index"]
    above = hits.select(*key, F.explode(F.slice(F.transform(F.split("path", "/"), lambda x: x.cast("int")), 1, F.size(F.split("path", "/")))).alias("node_id")).distinct()
    return tree_nodes.join(above, [*key, "node_id"]).withColumn("hit", hit)


def _kids(rows: list[tuple]) -> dict:
    kids: dict = {}
    for r in rows:
        kids.setdefault(r[1], []).append(r)
    return kids


def diff_trees(left: list[tuple], right: list[tuple]) -> list[tuple[str, str, str]]:
    """``(status, type, text)``: added, removed, changed or same; children are aligned by the longest common run of types."""
    lk, rk, out = _kids(left), _kids(right), []
    fold = lambda s: re.sub(r"\s+", " ", s.strip())

    def all_of(n, kids, status):
        out.append((status, n[4], fold(n[5])))
        for c in kids.get(n[0], []):
            all_of(c, kids, status)

    def walk(a, b):
        if a[4] != b[4]:
            all_of(a, lk, "removed")
            all_of(b, rk, "added")
            return
        out.append(("same" if fold(a[5]) == fold(b[5]) else "changed", a[4], fold(a[5])))
        x, y = lk.get(a[0], []), rk.get(b[0], [])
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in reversed(range(len(x))):
            for j in reversed(range(len(y))):
                best[i][j] = best[i + 1][j + 1] + 1 if x[i][4] == y[j][4] else max(best[i + 1][j], best[i][j + 1])
        i = j = 0
        while i < len(x) or j < len(y):
            if i < len(x) and j < len(y) and x[i][4] == y[j][4] and best[i][j] == best[i + 1][j + 1] + 1:
                walk(x[i], y[j])
                i, j = i + 1, j + 1
            elif i < len(x) and (j == len(y) or best[i + 1][j] >= best[i][j + 1]):
                all_of(x[i], lk, "removed")
                i += 1
            else:
                all_of(y[j], rk, "added")
                j += 1

    if left and right:
        walk(left[0], right[0])
    return out


def _compared(a: str | None, b: str | None) -> list[tuple[str, str, str]]:
    """Differences of two texts; a side that cannot be read gives an ``error`` row and nothing else is compared."""
    trees, errors = [], []
    for side, sql in (("left", a), ("right", b)):
        try:
            trees.append(tree(parse(sql or ""), sql or ""))
        except SqlError as e:
            errors.append(("error", side, str(e)))
    return errors or diff_trees(*trees)


def diff(pairs: DataFrame) -> DataFrame:
    """``pairs(id, left, right)`` of SQL texts to ``(id, ordinal, status, type, text)``; bad SQL gives rows of status ``error``, never a failure."""

    def run(frames):
        for f in frames:
            rows = [(i, k, *d) for i, a, b in zip(f["id"], f["left"], f["right"]) for k, d in enumerate(_compared(a, b))]
            yield pd.DataFrame(rows, columns=["id", "ordinal", "status", "type", "text"])

    return pairs.select("id", "left", "right").mapInPandas(run, "id string, ordinal int, status string, type string, text string")


def diff_summary(differences: DataFrame) -> DataFrame:
    """How many nodes of each pair are added, removed, changed, the same, or could not be read."""
    n = lambda x: F.sum((F.col("status") == x).cast("long")).alias(x)
    return differences.groupBy("id").agg(*map(n, ("added", "removed", "changed", "same", "error")))


def overlapping(a: DataFrame, b: DataFrame, width: int = 256) -> DataFrame:
    """Pairs of half-open spans of one file that overlap; null spans never do.

    Spans are cut into bins of ``width`` characters, and a pair is told in the
    bin where its later start lies, so a large file's spans meet only those nearby.
    """
    bins = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / width), F.floor((F.greatest(F.col(e) - 1, F.col(s))) / width)))
    x = a.where("span_start < span_end").withColumn("_bin", bins("span_start", "span_end"))
    y = b.where("span_start < span_end").select(F.col("source_file").alias("f"), F.col("span_start").alias("s"), F.col("span_end").alias("e"), bins("span_start", "span_end").alias("_b"))
    meet = (F.col("source_file") == F.col("f")) & (F.col("_bin") == F.col("_b")) & (F.col("span_start") < F.col("e")) & (F.col("s") < F.col("span_end"))
    return x.join(y, meet & (F.floor(F.greatest("span_start", "s") / width) == F.col("_bin"))).drop("_bin", "_b")


def visible(tree_nodes: DataFrame, collapsed: DataFrame) -> DataFrame:
    """Nodes that stand below none of ``collapsed(source_file, statement_index, node_id)``."""
    key = ["source_file", "statement_index"]
    steps = F.split("path", "/")
    above = tree_nodes.select(*key, "node_id", F.explode(F.transform(F.slice(steps, 1, F.size(steps) - 1), lambda x: x.cast("int"))).alias("above"))
    hidden = above.join(collapsed.select(*key, F.col("node_id").alias("above")), [*key, "above"]).select(*key, "node_id").distinct()
    return tree_nodes.join(hidden, [*key, "node_id"], "left_anti")
