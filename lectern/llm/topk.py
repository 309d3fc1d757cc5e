"""Exact top-k inner products by M-trees and best-first search.

Vectors become whole numbers. With M the largest norm among candidates, each candidate gets one more
component that lifts it onto the sphere of radius M; a query gets 0 there. Then distance squared is
|q|^2 + M^2 - 2 * score, so the highest scores are the nearest candidates in a metric. The first level
of the index is one page of pivots; each candidate goes to its nearest pivot's region, regions are cut
into blocks of bounded size, and each block is an M-tree of paged nodes that store their covering radius
and their entries' distances to the parent. Those distances bound what a query can find by the triangle
inequality, mostly without computing a distance. A query first searches the block that may hold the
nearest; what it finds there bounds the second round, which visits only blocks that can still add to it.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm.common import scratch, stored, table

K, SCALE, EVERY = 5, 256, 50
#: Pivots of the first page at most, candidates per pivot at least, candidates of a block at most.
MAX_PIVOTS, PER_PIVOT, BLOCK = 256, 1024, 131_072
#: Queries that meet one copy of a block in one task, about.
CHUNK = 65_536
#: Entries of a leaf and of an inner node.
LEAF, FAN = 128, 32
#: Squared norms from here on would leave 64-bit arithmetic.
MAX_NORM = 2.0**60
SALTS = 16


def _usable() -> Column:
    v = F.col("embedding")
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(F.col("vec_id").isNotNull() & (F.size(v) > 0) & finite, F.lit(False))


def _whole(embeddings: DataFrame, scale: int) -> DataFrame:
    """vec_id, q (whole numbers), h1, h2 (a hash of q), each different pair of vec_id and q once."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(_usable())
    floored = rows.select("vec_id", F.transform("embedding", lambda x: F.floor(scale * x)).alias("w")).withColumn(
        "norm", F.aggregate("w", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    )
    q = floored.where(F.col("norm") < MAX_NORM).select("vec_id", F.col("w").cast("array<int>").alias("q"))
    return q.distinct().withColumn("h1", F.xxhash64("q")).withColumn("h2", F.xxhash64(F.lit("second"), "q"))


class MTree:
    """Candidates on the sphere of radius sqrt(m2), bulk-loaded. ``points``: whole numbers, a row each."""

    def __init__(self, points: np.ndarray, m2: float, leaf: int = LEAF, fan: int = FAN):
        self.points, self.m2, self.leaf, self.fan = points, m2, leaf, fan
        norms = np.einsum("ij,ij->i", points, points).astype(np.float64)
        self.lifted = np.column_stack([points.astype(np.float64), np.sqrt(np.maximum(m2 - norms, 0))])
        #: Roundings of distances between lifted vectors stay well below this.
        self.slack = 1e-5 * (1 + math.sqrt(m2))
        self.computed = 0
        self.root = self._node(np.arange(len(points)), 0)

    def _distances(self, rows: np.ndarray, pivot: int) -> np.ndarray:
        gap = self.lifted[rows] - self.lifted[pivot]
        return np.sqrt(np.einsum("ij,ij->i", gap, gap))

    def _node(self, rows: np.ndarray, parent: int) -> tuple:
        """(entries, distances to the parent, radii, children); a leaf's entries are candidates and it has no
        children. An inner entry is its child's pivot."""
        if len(rows) <= self.leaf:
            return rows, self._distances(rows, parent), None, None
        n = min(self.fan, -(-len(rows) // self.leaf))
        pivots = rows[np.linspace(0, len(rows) - 1, n).astype(np.int64)]
        nearest = np.argmin(np.stack([self._distances(rows, p) for p in pivots]), axis=0)
        groups = [(p, rows[nearest == k]) for k, p in enumerate(pivots) if (nearest == k).any()]
        if max(len(g) for _, g in groups) > 0.9 * len(rows):  # they lie too close to be told apart by pivots
            groups = [(g[0], g) for g in np.array_split(rows, n)]
        entries = np.array([p for p, _ in groups])
        radii = np.array([self._distances(g, p).max() for p, g in groups])
        return entries, self._distances(entries, parent), radii, [self._node(g, p) for p, g in groups]

    def search(self, q: np.ndarray, ids: list, k: int, bound: int | None = None) -> list[tuple[int, int, bool]]:
        """The k best (score, id, whether it is the query's own vector), ids[i] being those of candidate i, best
        first, smaller ids first where scores tie; of scores below ``bound`` none."""
        whole, q2 = q.astype(np.int64), float(q.astype(np.float64) @ q.astype(np.float64))
        best: list[tuple[int, int, bool]] = []  # scores negated
        reach = math.inf

        def scores(rows: np.ndarray) -> np.ndarray:
            self.computed += len(rows)
            return self.points[rows] @ whole

        def distance(score):
            return np.sqrt(np.maximum(q2 + self.m2 - 2.0 * score, 0))

        if bound is not None:
            reach = float(distance(bound)) + self.slack
        first = float(distance(scores(np.array([0]))[0]))
        # Node, distance from the query to its pivot, by the least distance that it may hold.
        queue: list[tuple] = [(0.0, 0, first, self.root)]
        pushed = 0
        while queue:
            least, _, to_pivot, (entries, to_parent, radii, children) = heapq.heappop(queue)
            if least > reach:
                break
            gap = np.abs(to_pivot - to_parent)
            at = np.flatnonzero((gap if radii is None else gap - radii) <= reach)
            if not len(at):
                continue
            found = scores(entries[at])
            if radii is None:
                worst = -best[-1][0] if len(best) == k else bound
                for i in np.flatnonzero(found >= worst) if worst is not None else range(len(at)):
                    row = entries[at[i]]
                    same = bool((self.points[row] == whole).all())
                    best.extend((-int(found[i]), int(v), same) for v in ids[row])
                best = sorted(best)[:k]
                if len(best) == k:
                    reach = min(reach, float(distance(-best[-1][0])) + self.slack)
            else:
                away = distance(found)
                for i, d, low in zip(at, away, np.maximum(away - radii[at], least)):
                    if low <= reach:
                        pushed += 1
                        heapq.heappush(queue, (float(low), pushed, float(d), children[i]))
        return [(-s, v, same) for s, v, same in best]


def _matrix(vectors) -> np.ndarray:
    return np.array([np.asarray(v, np.int64) for v in vectors], np.int64)


class Page:
    """The first page: pivots with their numbers, by dimension. Dimensions without a pivot have region -1."""

    def __init__(self, rows: list, m2: float):
        self.m2 = m2
        self.by_dim: dict[int, tuple[list[int], np.ndarray]] = {}
        for region, q in enumerate(rows):
            self.by_dim.setdefault(len(q), ([], []))[0].append(region)
            self.by_dim[len(q)][1].append(q)
        self.by_dim = {d: (regions, _matrix(q)) for d, (regions, q) in self.by_dim.items()}

    def distances(self, q: np.ndarray, lift: bool) -> tuple[list[int], np.ndarray]:
        """Regions, and the distances of rows of ``q`` to their pivots; candidates are lifted, queries not."""
        regions, pivots = self.by_dim.get(q.shape[1], ([-1], None))
        if pivots is None:
            return regions, np.zeros((len(q), 1))
        own = q.astype(np.float64)
        norms = np.einsum("ij,ij->i", own, own)
        square = norms[:, None] + self.m2 - 2.0 * (own @ pivots.astype(np.float64).T)
        if lift:
            p2 = np.einsum("ij,ij->i", pivots, pivots).astype(np.float64)
            high = np.sqrt(np.maximum(self.m2 - norms, 0))
            square += (high**2)[:, None] - 2.0 * high[:, None] * np.sqrt(np.maximum(self.m2 - p2, 0))[None, :]
        return regions, np.sqrt(np.maximum(square, 0))


def _assign(page: Page):
    def fn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            region, away = np.zeros(len(f), np.int32), np.zeros(len(f))
            for _, at in f.groupby(f["q"].map(len)).indices.items():
                regions, d = page.distances(_matrix(f["q"].iloc[at]), lift=True)
                region[at], away[at] = np.array(regions)[d.argmin(axis=1)], d.min(axis=1)
            yield f.assign(region=region, away=away)

    return fn


def _visits(page: Page, blocks: dict, slack: float, nearest: bool):
    """Rows (block, h1, h2, q, bound) of the blocks a query visits: the one that may hold the nearest, or
    all others that may hold a candidate within its bound."""

    def fn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows: list[tuple] = []
            for dim, at in f.groupby(f["q"].map(len)).indices.items():
                names, of, near, far = blocks.get(dim, ([], [], [], []))
                if not len(names):
                    continue
                q = _matrix(f["q"].iloc[at])
                regions, d = page.distances(q, lift=False)
                place = {r: i for i, r in enumerate(regions)}
                to_pivot = d[:, [place[r] for r in of]]
                low = np.maximum(0, np.maximum(to_pivot - far, near - to_pivot))
                if any(r < 0 for r in of):
                    low[:] = 0
                # Of equally low ones the nearest pivot's; of its blocks the first.
                first = np.lexsort((np.broadcast_to(np.arange(len(names)), low.shape), to_pivot, low), axis=1)[:, 0]
                for i, row in enumerate(at):
                    h1, h2, vector, bound = f["h1"].iat[row], f["h2"].iat[row], f["q"].iat[row], f["bound"].iat[row]
                    if nearest:
                        rows.append((names[first[i]], h1, h2, vector, None))
                        continue
                    reach = math.inf
                    if bound == bound and bound is not None:
                        square = float(q[i].astype(np.float64) @ q[i].astype(np.float64)) + page.m2 - 2.0 * float(bound)
                        reach = math.sqrt(max(square, 0)) + slack
                    rows.extend((names[b], h1, h2, vector, bound) for b in np.flatnonzero(low[i] <= reach) if b != first[i])
            yield pd.DataFrame(rows, columns=["block", "h1", "h2", "q", "bound"]).astype({"block": "int32", "h1": "int64", "h2": "int64", "bound": "Int64"})

    return fn


def _search(m2: float, k: int):
    """Partitions come sorted by block and chunk, candidates before queries."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tree, vectors, ids = None, None, [], []
        for batch in batches:
            out: dict[str, list] = {"h1": [], "h2": [], "found": []}
            cols = {c: batch.column(c) for c in batch.schema.names}
            heads = zip(cols["block"].to_pylist(), cols["chunk"].to_pylist(), cols["kind"].to_pylist())
            for i, (block, chunk, kind) in enumerate(heads):
                if key != (block, chunk):
                    key, tree, vectors, ids = (block, chunk), None, [], []
                q = np.asarray(cols["q"][i].values.to_numpy(), np.int64)
                if kind == 0:
                    vectors.append(q)
                    ids.append(cols["ids"][i].as_py())
                    continue
                if not vectors and tree is None:
                    continue
                if tree is None:
                    tree, vectors = MTree(np.stack(vectors), m2), []
                found = tree.search(q, ids, k, cols["bound"][i].as_py())
                out["h1"].append(cols["h1"][i].as_py())
                out["h2"].append(cols["h2"][i].as_py())
                out["found"].append([{"score": s, "vec_id": v, "same": same} for s, v, same in found])
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("score", pa.int64()), ("vec_id", pa.int64()), ("same", pa.bool_())]))]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds)], names=list(out))

    return fn


_FOUND = "h1 long, h2 long, found array<struct<score:long,vec_id:long,same:boolean>>"


def top_products(embeddings: DataFrame, queries: Column | None = None, k: int = K, scale: int = SCALE, max_pivots: int = MAX_PIVOTS, per_pivot: int = PER_PIVOT, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """query_id, rank, vec_id, score: of each query the k highest inner products of floor(scale * component)
    with all other rows, ties to the smaller vec_id; fewer where there are fewer.

    ``embeddings`` has vec_id and embedding; ``queries`` is a condition on vec_id, as it stands every 50th.
    Vectors that are null, empty or hold null, NaN or infinite components, rows without vec_id, and vectors
    whose squared norm reaches 2^60 take no part. Only vectors of one length are compared. Rows alike in
    vec_id and vector count once; rows that share a vec_id with different vectors are queries and
    candidates of their own. Equal vectors under many ids are one point with its k + 1 smallest
    ids: no more can be among the k best. Other columns are ignored; an empty table gives no rows.

    The driver and each task hold the first page (``max_pivots`` vectors, chosen by hash) and 32 bytes for
    each block, of which there are at most ``max_pivots`` and one for each ``block`` candidates more.
    """
    queries = F.col("vec_id") % EVERY == 0 if queries is None else queries
    with scratch() as held:
        rows = stored(_whole(embeddings, scale))
        alike = W.partitionBy("h1", "h2", "q").orderBy("vec_id")
        points = stored(
            rows.withColumn("at", F.row_number().over(alike)).where(F.col("at") <= k + 1)
            .groupBy("h1", "h2", "q").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
        )
        n, m2 = points.agg(F.count(F.lit(1)), F.max(F.aggregate("q", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))).first()
        m2 = float(m2 or 0)
        slack = 1e-5 * (1 + math.sqrt(m2))
        pivots = max(1, min(max_pivots, n // per_pivot))
        page = Page([r["q"] for r in points.orderBy("h1", "h2").limit(pivots).select("q").collect()], m2)
        assigned = stored(points.mapInPandas(_assign(page), "h1 long, h2 long, q array<int>, ids array<long>, region int, away double"))
        size = max(1, min(block, max(2 * n // pivots, per_pivot)))
        parts = F.ceil(F.count(F.lit(1)) / size).cast("int").alias("parts")
        places = assigned.groupBy(F.size("q").alias("dim"), "region").agg(parts, F.min("away").alias("near"), F.max("away").alias("far")).orderBy("dim", "region").collect()
        blocks: dict[int, tuple] = {}
        number, first_of = 0, []
        for dim, region, n_parts, near, far in places:
            names, of, low, high = blocks.setdefault(dim, ([], [], [], []))
            first_of.append((dim, region, number, n_parts))
            for _ in range(n_parts):
                names.append(number)
                of.append(region)
                low.append(near - slack)
                high.append(far + slack)
                number += 1
        blocks = {d: (names, of, np.array(low), np.array(high)) for d, (names, of, low, high) in blocks.items()}

        asked = stored(rows.where(queries).select("h1", "h2", "q").distinct())
        chunks = max(1, math.ceil(asked.count() / chunk))
        starts = F.broadcast(embeddings.sparkSession.createDataFrame(first_of, "dim int, region int, first int, parts int"))
        dealt = assigned.join(starts, (F.size("q") == F.col("dim")) & (assigned["region"] == starts["region"])).select(
            (F.col("first") + F.pmod(F.col("h1"), F.col("parts"))).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"),
            F.lit(0).alias("kind"), "h1", "h2", "q", "ids", F.lit(None).cast("long").alias("bound"),
        )

        def round_of(visits: DataFrame) -> DataFrame:
            put = visits.select("block", F.pmod("h2", F.lit(chunks)).cast("int").alias("chunk"), F.lit(1).alias("kind"), "h1", "h2", "q", F.lit(None).cast("array<long>").alias("ids"), "bound")
            both = dealt.unionByName(put).repartition("block", "chunk").sortWithinPartitions("block", "chunk", "kind")
            return both.mapInArrow(_search(m2, k + 1), _FOUND)

        form = "block int, h1 long, h2 long, q array<int>, bound long"
        none = asked.withColumn("bound", F.lit(None).cast("long"))
        near_found = stored(round_of(none.mapInPandas(_visits(page, blocks, slack, True), form)))
        bounds = near_found.select("h1", "h2", F.when(F.size("found") > k, F.element_at("found", k + 1)["score"]).alias("bound"))
        more = round_of(asked.join(bounds, ["h1", "h2"], "left").select("h1", "h2", "q", "bound").mapInPandas(_visits(page, blocks, slack, False), form))
        entries = near_found.unionByName(more).select("h1", "h2", F.inline("found"))
        order = W.partitionBy("h1", "h2").orderBy(F.desc("score"), "vec_id")
        best = (
            entries.withColumn("at", F.row_number().over(order)).where(F.col("at") <= k + 1)
            .groupBy("h1", "h2").agg(F.sort_array(F.collect_list(F.struct("at", "vec_id", "score", "same"))).alias("best"))
        )
        # A vector that very many queries share is met in SALTS places.
        spread = best.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        wanting = rows.where(queries).select(F.col("vec_id").alias("query_id"), "h1", "h2", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).cast("int").alias("salt"))
        own = wanting.join(spread.hint("merge"), ["h1", "h2", "salt"])
        rest = F.filter("best", lambda b: ~(b["same"] & (b["vec_id"] == F.col("query_id"))))
        out = stored(own.select("query_id", F.posexplode(F.slice(rest, 1, k)).alias("pos", "b")).select("query_id", (F.col("pos") + 1).alias("rank"), "b.vec_id", "b.score"))
        held.append(out)
    return out


def op12_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(table(spark, sf_dir, "embeddings"))


QUERIES = {"op12_topk_search": op12_topk_search}

ORACLES = {
    "op12_topk_search": """
WITH v AS (
  SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)), true)
), scored AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.w, b.w) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.w) = len(b.w) WHERE a.vec_id % 50 = 0
)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM scored
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5""",
}
