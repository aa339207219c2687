"""Embedding near-duplicates: spherical k-means cells, blocked cosines inside.

Cells come from k-means on a bounded sample (``SAMPLE`` vectors at most); every
vector is then assigned.  A vector also visits each other cell whose border it
stands near: if x belongs to cell c and y to cell d and their difference has at
most length delta, then x.(c - d) and y.(d - c) are both at least 0 and their sum
(x - y).(c - d) is at most delta |c - d|, so one of the two is at most half of
that.  Each vector visits the cells within that half; of every pair one end at
least then visits the other's cell, whatever the direction of the difference, so
the search is exact.  A pair counts for the end at home in the cell where it is
found, and there for the visiting end too if the home end does not visit back.

Equal vectors are one node with a multiplicity.  A cell is compared in
blocks of ``BLOCK`` by ``WIDE`` vectors, so a crowded cell spreads over many tasks, and each
block yields link counts and a spanning forest, not pairs.

Defined results: a vector that is null, empty, zero, or holds a null or
non-finite component links with nothing, and vectors of different lengths never
link; such a row is its own component.  Repeated rows count as other vectors.
An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stage
from .components import components

SAMPLE, BLOCK, WIDE, CELL, MOST_CELLS, ROUNDS = 20_000, 2048, 4096, 1024, 2048, 8


def unit(rows) -> np.ndarray:
    """Rows as double-precision unit vectors; scaled first, so that no square overflows."""
    x = np.array([np.asarray(r, np.float64) for r in rows], np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """Unit centroids (k at most) of unit vectors; deterministic."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        home = np.concatenate([(x[i : i + BLOCK] @ c.T).argmax(axis=1) for i in range(0, len(x), BLOCK)])
        total = np.zeros_like(c)
        np.add.at(total, home, x)
        size = np.sqrt((total**2).sum(axis=1))
        c = np.where((size > 1e-12)[:, None], total / np.maximum(size, 1e-12)[:, None], c)
    return c


def _assigner(centres: dict[int, np.ndarray], cosine: float):
    delta = np.sqrt(max(0, 2 - 2 * cosine) + 1e-12)  # the small terms here and below outweigh rounding

    def run(frames):
        for f in frames:
            out = []
            for dim, part in f.groupby(f["v"].map(len)):
                c = centres[dim]
                gaps = np.sqrt(np.maximum(0, 2 - 2 * np.clip(c @ c.T, -1, 1)) + 1e-14) * delta / 2 + 1e-9
                for at in range(0, len(part), BLOCK):
                    block = part.iloc[at : at + BLOCK]
                    sims = unit(block["v"]) @ c.T
                    home = sims.argmax(axis=1)
                    near = sims.max(axis=1)[:, None] - sims <= gaps[home]
                    row, cell = np.nonzero(near)
                    visits = [np.flatnonzero(x).tolist() for x in near]
                    cells = [visits[r] if c == home[r] else [int(home[r])] for r, c in zip(row, cell)]
                    out.append(pd.DataFrame({"dim": dim, "cell": cell, "home": cell == home[row], "cells": cells, "node": block["node"].to_numpy()[row], "n": block["n"].to_numpy()[row], "v": block["v"].to_numpy()[row]}))
            if out:
                yield pd.concat(out)

    return run


def _block_forest(m: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what the boolean matrix connects."""
    i, j = np.nonzero(m)
    if len(i) <= 4 * (len(rows) + len(cols)):
        return list(zip(rows[i].tolist(), cols[j].tolist()))
    out, free_rows, free_cols = [], m.any(axis=1), m.any(axis=0)
    while free_rows.any():
        queue = [int(free_rows.argmax())]
        free_rows[queue[0]] = False
        while queue:
            r = queue.pop()
            for c in np.flatnonzero(m[r] & free_cols).tolist():
                out.append((int(rows[r]), int(cols[c])))
                free_cols[c] = False
                more = np.flatnonzero(m[:, c] & free_rows).tolist()
                out += [(int(rows[x]), int(cols[c])) for x in more]
                free_rows[more] = False
                queue += more
    return out


def _comparer(cosine: float):
    def run(f: pd.DataFrame) -> pd.DataFrame:
        left, right = f[f["side"] == 0], f[f["side"] == 1]
        if left.empty or right.empty:
            return pd.DataFrame({"a": pd.Series([], "int64"), "b": pd.Series([], "Int64"), "w": pd.Series([], "int64")})
        x, y = unit(left["v"]), unit(right["v"])
        sims = x @ y.T
        m = sims >= cosine
        for i, j in zip(*np.nonzero(np.abs(sims - cosine) < 1e-12)):  # ties are settled by one exactly rounded way
            m[i, j] = float(sum(np.longdouble(p) * np.longdouble(q) for p, q in zip(x[i], y[j]))) >= cosine
        rows, cols = left["node"].to_numpy(), right["node"].to_numpy()
        m &= rows[:, None] != cols[None, :]
        w = m @ right["n"].to_numpy(np.int64)
        goes = np.zeros((len(left), max(max(x) for x in f["cells"]) + 1), bool)  # left row to cell
        for i, x in enumerate(left["cells"]):
            goes[i, x] = True
        w2 = left["n"].to_numpy(np.int64) @ (m & ~goes[:, [x[0] for x in right["cells"]]])
        pairs = np.array(_block_forest(m, rows, cols), np.int64).reshape(-1, 2)
        ends, w = np.concatenate([rows, cols]), np.concatenate([w, w2])
        some = w > 0
        return pd.DataFrame({"a": np.concatenate([ends[some], pairs[:, 0]]), "b": pd.array([None] * int(some.sum()) + pairs[:, 1].tolist(), "Int64"), "w": np.concatenate([w[some], np.zeros(len(pairs), np.int64)])})

    return run


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", cosine: float = 0.95) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row per vector."""
    spark = vectors.sparkSession
    small_batches(spark, 4096)
    v = F.col(embedding)
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.when(F.coalesce(fine, F.lit(False)), v).alias("v"))
    nodes = stage(rows.where("v is not null").groupBy("v").agg(F.count("*").alias("n"), F.min("vec_id").alias("low")).withColumn("node", F.monotonically_increasing_id()), "nodes")
    centres = {}
    for dim, count in nodes.groupBy(F.size("v")).count().collect():  # one row per vector length
        sample = nodes.where(F.size("v") == dim).orderBy(F.xxhash64("v"), "node").limit(SAMPLE).select("v").toPandas()["v"]
        centres[dim] = spherical_kmeans(unit(sample), max(1, min(MOST_CELLS, len(sample) // 8, -(-count // CELL))))
    dealt = stage(nodes.select("node", "n", "v").mapInPandas(_assigner(centres, cosine), f"dim int, cell int, home boolean, cells array<int>, node long, n long, {_field(nodes)}"), "cells")
    blocks = dealt.groupBy("dim", "cell").agg(F.greatest(F.ceil(F.sum(F.col("home").cast("int")) / BLOCK), F.lit(1)).cast("int").alias("nl"), F.ceil(F.count("*") / WIDE).cast("int").alias("nr"))
    dealt = dealt.join(blocks, ["dim", "cell"])
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = dealt.where("home").select("dim", "cell", own("nl").alias("i"), every("nr").alias("j"), F.lit(0).alias("side"), "cells", "node", "n", "v")
    right = dealt.select("dim", "cell", every("nl").alias("i"), own("nr").alias("j"), F.lit(1).alias("side"), F.when(F.col("home"), F.array("cell")).otherwise(F.col("cells")).alias("cells"), "node", "n", "v")
    found = stage(left.unionByName(right).groupBy("dim", "cell", "i", "j").applyInPandas(_comparer(cosine), "a long, b long, w long"), "links")
    weight = found.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("w"))
    roots = components(found.where("b is not null").select("a", "b"))
    named = nodes.join(weight, "node", "left").join(roots, "node", "left").select("v", "low", F.coalesce("root", "node").alias("root"), (F.coalesce("w", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    low = named.groupBy("root").agg(F.min("low").alias("component_id"))
    of = named.join(low, "root").select("v", "n_links", "component_id")
    linked = rows.where("v is not null").join(of, "v").select("vec_id", "n_links", "component_id")
    alone = rows.where("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _field(nodes: DataFrame) -> str:
    return f"v {nodes.schema['v'].dataType.simpleString()}"


def oracle(cosine: float = 0.95) -> str:
    """The same result from all pairs, in DuckDB SQL."""
    return f"""WITH RECURSIVE e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
f AS (SELECT * FROM e WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM f x JOIN f y ON x.vec_id <> y.vec_id AND len(x.v) = len(y.v) AND list_cosine_similarity(x.v, y.v) >= {cosine}),
r AS (SELECT vec_id AS a, vec_id AS b FROM e UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a, min(b) AS component_id FROM r GROUP BY a), c AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM e JOIN m ON m.a = vec_id LEFT JOIN c ON c.a = vec_id"""
