"""Approximate nearest neighbours by inner product: a small-world graph in each shard.

Equal vectors are one point, which keeps the smallest ids that any query can need. Points
are dealt out to shards of bounded size. A shard's hierarchical graph is a matrix of
neighbour numbers for each level: level 0 has all points, each level above a fixed part of
the one below. A point's neighbours are the closest of those that no chosen neighbour is
closer to than the point itself, filled up with the closest others. A shard's arrays are
built and written once; queries walk them in blocks of bounded size, and the results of all
shards are merged.
"""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statetrail.llm.store import settle

#: Points of a shard, about; the exact number varies as hashes fall.
SHARD_POINTS = 8192
#: Queries of a block, about, likewise.
BLOCK_QUERIES = 2048
#: Neighbours of a point on level 0 and above, candidates they are chosen from, share of points a level up.
WIDE, NARROW, CANDIDATES, SHARE = 32, 12, 96, 16
#: Points that a walk keeps open.
BEAM = 96


def usable(vector: Column) -> Column:
    """Vectors of finite components, not all zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def _closest(points: np.ndarray, count: int) -> np.ndarray:
    """Numbers of the ``count`` points of largest inner product with each point, itself excluded, best first."""
    out = np.empty((len(points), count), np.int32)
    for i in range(0, len(points), 512):
        near = points[i : i + 512] @ points.T
        near[np.arange(len(near)), np.arange(i, i + len(near))] = -np.inf
        part = np.argpartition(-near, count - 1, axis=1)[:, :count]
        order = np.argsort(-np.take_along_axis(near, part, 1), axis=1, kind="stable")
        out[i : i + 512] = np.take_along_axis(part, order, 1)
    return out


def neighbours(points: np.ndarray, width: int) -> np.ndarray:
    """The flat neighbour array of one level: ``width`` numbers for each point, -1 where there are fewer."""
    n = len(points)
    count = min(CANDIDATES, n - 1)
    if count < 1:
        return np.full((n, width), -1, np.int32)
    near = _closest(points, count)
    out = np.full((n, width), -1, np.int32)
    for i in range(0, n, 256):
        own = near[i : i + 256]
        around = points[own]
        to_point = np.einsum("rcd,rd->rc", around, points[i : i + 256])
        between = around @ around.transpose(0, 2, 1)
        taken = np.zeros(own.shape, bool)
        for c in range(count):
            closer = (between[:, c, :] > to_point[:, c, None]) & taken
            taken[:, c] = ~closer.any(1) & (taken.sum(1) < width // 2)
        order = np.argsort(~taken, axis=1, kind="stable")[:, :width]
        out[i : i + 256, : order.shape[1]] = np.take_along_axis(own, order, 1)
    # what is nobody's neighbour could not be reached: its best neighbour gives it its last place
    lost = np.setdiff1d(np.arange(n), out[out >= 0])
    out[near[lost, 0], min(width, count) - 1] = lost
    return out


class Graph:
    """Levels of a shard: the points' numbers on each and their neighbour arrays."""

    def __init__(self, points: np.ndarray):
        self.points = points.astype(np.float32)
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        members = np.arange(len(points))
        while True:
            width = WIDE if not self.levels else NARROW
            local = neighbours(self.points[members], width)
            self.levels.append((members, np.where(local >= 0, members[local], -1)))
            if len(members) <= SHARE:
                break
            members = members[::SHARE]

    def arrays(self) -> dict[str, np.ndarray]:
        """All of the graph but its points, by names that ``of`` reads."""
        return {f"{kind}{i}": x for i, level in enumerate(self.levels) for kind, x in zip(("members", "links"), level, strict=True)}

    @classmethod
    def of(cls, points: np.ndarray, stored: dict[str, np.ndarray]) -> Graph:
        graph = cls.__new__(cls)
        graph.points, graph.levels = points.astype(np.float32), []
        while (name := f"members{len(graph.levels)}") in stored:
            graph.levels.append((stored[name], stored[name.replace("members", "links")]))
        return graph

    def search(self, queries: np.ndarray, count: int) -> np.ndarray:
        """Numbers of the ``count`` best points found for each query, best first; -1 where there are fewer."""
        queries = queries.astype(np.float32)
        top = self.levels[-1][0]
        at = top[np.argmax(queries @ self.points[top].T, axis=1)]
        for members, links in self.levels[-2:0:-1]:
            row = np.zeros(len(self.points), np.int64)
            row[members] = np.arange(len(members))
            at = self._walk(queries, at, row, links, 8)[:, 0]
        identity = np.arange(len(self.points))
        return self._walk(queries, at, identity, self.levels[0][1], max(BEAM, count))[:, :count]

    def _walk(self, queries: np.ndarray, start: np.ndarray, row: np.ndarray, links: np.ndarray, beam: int) -> np.ndarray:
        """Best-first walks of all queries, in step, over one level; ``row`` finds a point's line in ``links``."""
        n = len(queries)
        seen = np.zeros((n, len(self.points)), bool)
        found = np.full((n, beam), -1, np.int64)
        score = np.full((n, beam), -np.inf, np.float32)
        closed = np.ones((n, beam), bool)
        found[:, 0] = start
        score[:, 0] = np.einsum("qd,qd->q", self.points[start], queries)
        closed[:, 0] = False
        seen[np.arange(n), start] = True
        active = np.arange(n)
        while len(active):
            open_score = np.where(closed[active], -np.inf, score[active])
            best = open_score.argmax(1)
            going = open_score[np.arange(len(active)), best] > -np.inf
            active, best = active[going], best[going]
            if not len(active):
                break
            closed[active, best] = True
            near = links[row[found[active, best]]]
            fresh = (near >= 0) & ~seen[active[:, None], near]
            seen[active[:, None], np.where(near >= 0, near, found[active, best][:, None])] = True
            value = np.where(fresh, np.einsum("qsd,qd->qs", self.points[near], queries[active]), -np.inf)
            all_score = np.concatenate([score[active], value], axis=1)
            all_found = np.concatenate([found[active], near], axis=1)
            all_closed = np.concatenate([closed[active], ~fresh], axis=1)
            order = np.argsort(-all_score, axis=1, kind="stable")[:, :beam]
            score[active] = np.take_along_axis(all_score, order, 1)
            found[active] = np.where(score[active] > -np.inf, np.take_along_axis(all_found, order, 1), -1)
            closed[active] = np.take_along_axis(all_closed, order, 1)
        return found


def distinct_points(vectors: DataFrame, ids: int) -> DataFrame:
    """``point`` (a number made of the vector), ``embedding`` and its ``ids`` smallest ids, for each distinct vector.

    The limit of ids is applied before the shuffle, so copies of one vector don't gather.
    """
    numbered = vectors.withColumn("point", F.xxhash64("embedding")).selectExpr(
        "*", "row_number() over (partition by point, embedding order by vec_id) as nth"
    ).where(F.col("nth") <= ids)
    return numbered.groupBy("point", "embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def dealt(queries: DataFrame, shards: int, blocks: int) -> DataFrame:
    """``queries`` with ``block`` and, once for each, ``shard``."""
    block = F.pmod(F.xxhash64(F.lit("block"), "query_id", "query"), F.lit(blocks))
    return queries.withColumn("block", block).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)).cast("array<bigint>")))


def nearest(
    vectors: DataFrame, count: int = 20, every: int = 20, shard_points: int = SHARD_POINTS, block_queries: int = BLOCK_QUERIES,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``count`` nearest vectors found for each whose id ``every`` divides.

    Nearness is the inner product in double precision; ties go to the smaller id. Null ids,
    null or zero vectors and those with null or non-finite components take no part; neither
    do vectors of another length than the most common one. Rows equal in id and vector are
    one; an id with several vectors is several candidates. With fewer candidates than
    ``count`` all are returned; no vectors, no rows.
    """
    clean = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    clean = clean.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).distinct()
    asks = (F.col("vec_id") % every == 0).cast("bigint")
    sizes = clean.groupBy(F.size("embedding").alias("size")).agg(F.count("*").alias("count"), F.sum(asks).alias("asks")).orderBy(F.desc("count"), "size").first()
    if sizes is None:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    clean = clean.where(F.size("embedding") == sizes["size"])
    shards = max(1, round(sizes["count"] / shard_points))
    blocks = max(1, round(sizes["asks"] / block_queries))
    queries = clean.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    points = distinct_points(clean, count + 1).withColumn("shard", F.pmod(F.col("point"), F.lit(shards)))
    def built(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("point", kind="stable")
        data = np.stack(own["embedding"].to_list())
        ids, file = own["ids"].to_list(), io.BytesIO()
        at = np.cumsum([0, *map(len, ids)])
        np.savez(file, data=data, ids=np.concatenate(ids), at=at, **Graph(data).arrays())
        return pd.DataFrame({"shard": own["shard"].iloc[:1], "graph": [file.getvalue()]})

    def searched(stored: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": [], "ids": [], "score": []})]
        if len(stored) and len(asking):
            with np.load(io.BytesIO(stored["graph"].iloc[0])) as file:
                held = dict(file)
            data, at = held["data"], held["at"]
            graph = Graph.of(data, held)
            for i in range(0, len(asking), 256):
                part = asking.iloc[i : i + 256]
                query = np.stack(part["query"].to_list())
                found = graph.search(query, count + 1)
                q, c = np.nonzero(found >= 0)
                hit = found[q, c]
                out.append(pd.DataFrame({
                    "query_id": part["query_id"].to_numpy()[q],
                    "ids": [held["ids"][at[h] : at[h + 1]] for h in hit],
                    "score": (query[q] * data[hit]).sum(1),
                }))
        return pd.concat(out)

    graphs = settle(points.groupBy("shard").applyInPandas(built, "shard bigint, graph binary"))
    copies = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")))
    found = copies.groupBy("shard", "block").cogroup(dealt(queries, shards, blocks).groupBy("shard", "block")).applyInPandas(
        searched, "query_id bigint, ids array<bigint>, score double"
    )
    pairs = found.select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    ranks = pairs.distinct().selectExpr(
        "query_id", "row_number() over (partition by query_id order by score desc, vec_id) as rank", "vec_id", "score"
    )
    return ranks.where(F.col("rank") <= count)
