"""Exact top-k by inner product with a paged M-tree, searched best first.

Vectors become integers, and one more coordinate sqrt(top - |x|^2) puts all of them on a sphere, where a
smaller Euclidean distance to the query (with 0 there) means a larger inner product. ``top`` is the largest
squared norm of the whole table.

The tree has three levels and is written once as a table of pages:

* the root: at most ``PIVOTS`` pivots, drawn from the ``SAMPLE`` rows with the smallest id hashes. Every vector goes to its nearest
  pivot's cell; a cell is a ball of covering radius around the pivot. The root alone is known to the driver.
* a cell, dealt by a hash of the row over as many shards as keep each below ``SHARD_BYTES``, so that a cell which holds
  most rows is split; each shard has its own covering radius.
* a page: at most ``PAGE`` vectors around a centre, with covering radius, the centre's distance to the pivot, and every
  vector's distance to the centre.

A query is first answered from one shard of its nearest cell. The k-th score found bounds the distance, and the query goes on
only to the shards whose ball the bound reaches. Inside a shard pages are taken best first: the stored triangle
bound |d(q, pivot) - d(pivot, centre)| - radius skips a page without computing its distance, d - radius orders and ends the
search, and |d(q, centre) - d(centre, x)| skips vectors of a page that is read. Bounds are widened by more than the rounding
error of the floats, and scores are exact integers, so ties are decided by id alone.

A shard that many queries reach is read by several tasks, ``QUERY_BLOCK`` queries each. Where vectors are so spread that no
ball can be left out, every query reads every shard, as an exact search then must.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from snapledger.llm.common import stage, table
from snapledger.llm.registry import query

SCALE, K, PAGE, FANOUT = 1024, 10, 256, 8
PIVOTS, SAMPLE, CELL_ROWS, SHARD_BYTES, QUERY_BLOCK = 1_024, 8_192, 2_000, 16 << 20, 1_000
MODULUS = 100
#: Squared norms stay below this, so that every inner product fits a long.
MAX_NORM = 2.0**62

PAGES = (
    "cell int, salt int, page int, shard_radius double, centre array<double>, radius double, parent double,"
    " row_nos array<bigint>, ids array<bigint>, far array<double>, width int, vectors binary"
)
FOUND = "query_no bigint, query_id bigint, vec_id bigint, score bigint"


def matrix(vectors: list, width: int = 0) -> np.ndarray:
    """The vectors as rows, the shorter ones continued with zeros."""
    width = max([width, *map(len, vectors)])
    out = np.zeros((len(vectors), width), np.asarray(vectors[0]).dtype if len(vectors) else np.int64)
    for row, v in zip(out, vectors, strict=True):
        row[: len(v)] = v
    return out


def lifted(ints: np.ndarray, height: np.ndarray) -> np.ndarray:
    """The points on the sphere; the further coordinate comes first, so that zeros may follow."""
    return np.column_stack([height, ints.astype(float)])


def widened(points: np.ndarray, width: int) -> np.ndarray:
    return np.pad(points, ((0, 0), (0, width - points.shape[1])))


def distances(points: np.ndarray, pivot: np.ndarray) -> np.ndarray:
    return np.sqrt(((points - pivot) ** 2).sum(1))


def all_distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distance of every point to every pivot, one pivot at a time."""
    width = max(points.shape[1], pivots.shape[1])
    points, pivots = widened(points, width), widened(pivots, width)
    return np.column_stack([distances(points, p) for p in pivots])


def nearest(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The nearest pivot of every point by one product; a tie that rounding decides is as good either way."""
    shared = min(points.shape[1], pivots.shape[1])
    return ((pivots**2).sum(1) - 2.0 * (points[:, :shared] @ pivots[:, :shared].T)).argmin(1)


def slack(q_norm: np.ndarray | float, top: int) -> np.ndarray | float:
    return 1e-6 * (1.0 + np.sqrt(q_norm) + np.sqrt(float(top)))


def reach(floor: float, q_norm: float, top: int) -> float:
    """The distance beyond which no score reaches ``floor``; infinite without one."""
    return float("inf") if np.isnan(floor) else float(np.sqrt(max(0.0, q_norm + top - 2.0 * floor)))


def dealt(points: np.ndarray, seed: np.random.Generator) -> Iterator[np.ndarray]:
    """Row numbers of the pages: points go to the nearest of ``FANOUT`` of them until a group fits a page."""
    open_groups = [np.arange(len(points))]
    while open_groups:
        rows = open_groups.pop()
        if len(rows) <= PAGE:
            yield rows
            continue
        near = all_distances(points[rows], points[seed.choice(rows, FANOUT, replace=False)]).argmin(1)
        groups = [rows[near == g] for g in range(FANOUT)]
        groups = [g for g in groups if len(g)]
        if len(groups) == 1:  # equal pivots: cut by distance
            order = rows[np.argsort(distances(points[rows], points[rows[0]]), kind="stable")]
            groups = [order[: len(order) // 2], order[len(order) // 2 :]]
        open_groups += groups


def integer_vectors(rows: DataFrame) -> DataFrame:
    """(vec_id, v, norm): floor(1024 x) of every component, of the rows that take part."""
    usable = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")) & ~F.isnan(x))
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE))
    ints = rows.filter(usable & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("v"))
    about = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    norm = F.when(about < MAX_NORM, F.aggregate("v", F.lit(0).cast("bigint"), lambda a, x: a + x * x))
    return ints.select("vec_id", "v", norm.alias("norm")).filter(F.col("norm").isNotNull())


def top_k(
    rows: DataFrame, modulus: int = MODULUS, k: int = K, cell_rows: int = CELL_ROWS, shard_bytes: int = SHARD_BYTES, query_block: int = QUERY_BLOCK
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` best other rows, ties to the smaller id.

    Queries are the rows whose id is divisible by ``modulus``. ``rows`` needs ``vec_id`` and ``embedding``; other
    columns are ignored. Rows without id, or whose vector is null or holds a null or a component that is not finite, take
    no part; nor do vectors whose squared integer norm is 2^62 or more, since their scores need not fit a long. Of vectors of
    different length the shorter continues with zeros; an empty one scores 0. Rows that share an id are rows of their
    own: each is a candidate for the others, and each that is a query gives its own ranks under the id. A
    table with one usable row, or none, gives no rows.
    """
    spark, result = rows.sparkSession, "query_id bigint, rank int, vec_id bigint, score bigint"
    ints = integer_vectors(rows)
    about = ints.agg(F.max("norm").alias("top"), F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    if about["n"] == 0:
        return spark.createDataFrame([], result)
    top, exact = about["top"], np.float64 if about["top"] <= 1 << 53 else np.int64
    sample = ints.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v", "norm").collect()
    drawn = lifted(matrix([np.asarray(r["v"], np.int64) for r in sample], about["width"]), np.sqrt([float(top - r["norm"]) for r in sample]))
    _, firsts = np.unique(drawn, axis=0, return_index=True)
    pivots = drawn[np.sort(firsts)][: min(PIVOTS, -(-about["n"] // cell_rows))]

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for data in batches:
            if len(data):
                points = lifted(matrix(data["v"].to_list()), np.sqrt((top - data["norm"].to_numpy()).astype(float)))
                yield data.assign(cell=nearest(points, pivots).astype("int32"))

    numbered = ints.select(F.monotonically_increasing_id().alias("row_no"), "*")
    placed = stage(numbered.mapInPandas(assign, "row_no bigint, vec_id bigint, v array<bigint>, norm bigint, cell int"), "cells")

    shard_rows = max(PAGE, shard_bytes // (8 * max(1, about["width"])))
    salts = [1] * len(pivots)
    for row in placed.groupBy("cell").count().collect():  # a row per pivot
        salts[row["cell"]] = -(-row["count"] // shard_rows)
    salt = F.pmod(F.xxhash64("row_no"), F.get(F.array(*map(F.lit, salts)), F.col("cell"))).cast("int")

    def paged(data: pd.DataFrame) -> pd.DataFrame:
        data = data.sort_values("row_no")
        cell, salt = int(data["cell"].iloc[0]), int(data["salt"].iloc[0])
        own = matrix(data["v"].to_list())
        points = lifted(own, np.sqrt((top - data["norm"].to_numpy()).astype(float)))
        width = max(points.shape[1], pivots.shape[1])
        points, pivot = widened(points, width), widened(pivots, width)[cell]
        shard_radius = float(distances(points, pivot).max())
        numbers, ids, out = data["row_no"].to_numpy(), data["vec_id"].to_numpy(), []
        for page, group in enumerate(dealt(points, np.random.default_rng(0))):
            centre = points[group[distances(points[group], points[group].mean(0)).argmin()]]
            far = distances(points[group], centre)
            parent = float(distances(centre[None], pivot)[0])
            body = own[group].astype("<i8").tobytes()
            out.append((cell, salt, page, shard_radius, centre, float(far.max()), parent, numbers[group], ids[group], far, own.shape[1], body))
        return pd.DataFrame(out, columns=[c.split()[0] for c in PAGES.split(", ")])

    pages = stage(placed.withColumn("salt", salt).groupBy("cell", "salt").applyInPandas(paged, PAGES), "pages")
    shards = pages.groupBy("cell", "salt").agg(F.max("shard_radius").alias("shard_radius"))
    radii = np.full(len(pivots), -np.inf)
    for row in shards.groupBy("cell").agg(F.max("shard_radius").alias("radius")).collect():  # a row per pivot
        radii[row["cell"]] = row["radius"]
    queries = placed.filter(F.col("vec_id") % modulus == 0).select(F.col("row_no").alias("query_no"), F.col("vec_id").alias("query_id"), "v", "norm")

    def routed(batches: Iterator[pd.DataFrame], first: bool) -> Iterator[pd.DataFrame]:
        """The nearest cell of every query (``first``), or all cells that its bound reaches."""
        for data in batches:
            if not len(data):
                continue
            own = matrix(data["v"].to_list())
            away = np.where(np.isinf(radii), np.inf, all_distances(lifted(own, np.zeros(len(own))), pivots))
            home, norms = away.argmin(1), data["norm"].to_numpy(float)
            limit = np.array([reach(f, q, top) for f, q in zip(data["floor"], norms, strict=True)]) + slack(norms, top)
            q, cell = (np.arange(len(own)), home) if first else np.nonzero(away - radii <= limit[:, None])
            found = {"query_no": data["query_no"].to_numpy()[q], "cell": cell, "away": away[q, cell], "limit": limit[q], "home": cell == home[q]}
            yield pd.DataFrame(found).assign(floor=data["floor"].to_numpy(float)[q]).astype({"cell": "int32"})

    def route(asked: DataFrame, first: bool) -> DataFrame:
        names = "query_no bigint, cell int, away double, limit double, home boolean, floor double"
        cells = asked.select("query_no", "v", "norm", "floor").mapInPandas(lambda b: routed(b, first), names)
        at_home = F.col("home") & (F.col("salt") == 0)
        if first:
            return stage(cells.withColumn("salt", F.lit(0)).select("query_no", "cell", "salt", "floor"), "first-routes")
        reached = cells.join(shards, "cell").filter(~at_home & (F.col("away") - F.col("shard_radius") <= F.col("limit")))
        return stage(reached.select("query_no", "cell", "salt", "floor"), "routes")

    def search(tree: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out: list[pd.DataFrame] = []
        if len(tree) and len(asked):
            bodies = [np.frombuffer(b, "<i8").reshape(len(i), w) for b, i, w in zip(tree["vectors"], tree["ids"], tree["width"], strict=True)]
            wanted = matrix(asked["v"].to_list(), int(tree["width"].max()))
            width = wanted.shape[1]
            bodies = [widened(b, width).astype(exact) for b in bodies]
            centres = matrix(tree["centre"].to_list(), width + 1)
            centres_width = centres.shape[1]
            pivot = widened(pivots, max(centres_width, pivots.shape[1]))[int(tree["cell"].iloc[0])][:centres_width]
            radius, parent = tree["radius"].to_numpy(), tree["parent"].to_numpy()
            leaves = list(zip(bodies, tree["ids"], tree["row_nos"], tree["far"], strict=True))
            points = widened(lifted(wanted, np.zeros(len(wanted))), centres_width)
            for n, own, floor, q_norm, q, point in zip(asked["query_no"], asked["query_id"], asked["floor"], asked["norm"].astype(float), wanted.astype(exact), points, strict=True):
                best = best_first(leaves, centres, radius, parent, float(distances(pivot[None], point)[0]), q, point, n, floor, q_norm)
                out.append(pd.DataFrame({"query_no": n, "query_id": own, "vec_id": best[1], "score": best[0]}))
        found = pd.concat(out) if out else pd.DataFrame(columns=["query_no", "query_id", "vec_id", "score"])
        return found.astype("int64")

    def best_first(leaves, centres, radius, parent, to_pivot, q, point, own, floor, q_norm):  # noqa: PLR0913
        """(scores, ids) of at most ``k`` rows of one shard, none below ``floor``."""
        scores, ids = np.empty(0, np.int64), np.empty(0, np.int64)
        room = slack(q_norm, top)
        limit = reach(floor, q_norm, top) + room
        live = np.flatnonzero(np.abs(to_pivot - parent) - radius <= limit)  # the stored bound saves the distance
        far = distances(centres[live], point)
        low = far - radius[live]
        for j in np.argsort(low, kind="stable"):
            if low[j] > limit:
                break
            body, page_ids, numbers, to_centre = leaves[live[j]]
            near = np.flatnonzero((np.abs(far[j] - to_centre) <= limit) & (numbers != own))
            got = (body[near] @ q).astype(np.int64)
            if not np.isnan(floor):
                ok = got >= floor
                near, got = near[ok], got[ok]
            if not len(got):
                continue
            scores, ids = np.concatenate([scores, got]), np.concatenate([ids, page_ids[near]])
            order = np.lexsort((ids, -scores))[:k]
            scores, ids = scores[order], ids[order]
            if len(scores) == k:
                floor = scores[-1]
                limit = reach(float(floor), q_norm, top) + room
        return scores, ids

    def answered(routes: DataFrame) -> DataFrame:
        load = routes.groupBy("cell", "salt").agg(F.ceil(F.count("*") / query_block).cast("int").alias("blocks"))
        block = F.pmod(F.xxhash64("query_no"), F.col("blocks")).cast("int")
        asked = routes.join(load, ["cell", "salt"]).withColumn("block", block).join(queries, "query_no")
        read = pages.join(load, ["cell", "salt"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        keys = ("cell", "salt", "block")
        return read.drop("blocks").groupBy(*keys).cogroup(asked.drop("blocks").groupBy(*keys)).applyInPandas(search, FOUND)

    first = stage(answered(route(queries.withColumn("floor", F.lit(None).cast("double")), True)), "first-answers")
    floors = first.groupBy("query_no").agg(F.when(F.count("*") >= k, F.min("score")).cast("double").alias("floor"))
    lower = F.when(F.abs("floor") >= 2.0**53, F.col("floor") - F.abs("floor") * 2.0**-51).otherwise(F.col("floor"))  # a double may lie above the long
    floors = floors.withColumn("floor", lower)
    rest = answered(route(queries.join(floors, "query_no", "left"), False))
    order = Window.partitionBy("query_no").orderBy(F.col("score").desc(), "vec_id")
    ranked = first.unionByName(rest).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


OP2_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


@query("op2_top_k", OP2_SQL)
def op2_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return top_k(table(spark, folder, "embeddings"))
