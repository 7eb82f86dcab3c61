"""Exact top-k inner products with M-trees.

Largest inner product becomes nearest neighbour: with R the largest squared norm of the tree's
vectors, x -> (x, sqrt(R - |x|^2)) and q -> (q, 0) give |q' - x'|^2 = |q|^2 + R - 2 q.x, a
metric distance. Vectors go to the nearest of at most ``PIVOTS`` routing vectors (chosen by hash over the whole
table, the only ones on the driver), and each such cell to trees of at most ``TREE`` rows; a cell that
is too large (a third of all vectors alike, say) is split by hash. A tree is a list of paged
nodes, each entry with a routing vector, a covering radius and its distance to the parent. The
search takes nodes best-first from a heap; an entry is skipped without computing its distance
where the stored parent distance and the triangle inequality already put it beyond the k-th
best.

Queries travel in blocks of one cell. A block first searches a tree of its own cell; the k-th best
scores found there go with it as floors. Of all other trees it then meets only those whose root ball can
hold a vector of at least a floor (q.x <= q.c + |q| r): the pairs of blocks and trees (a stated query set
against all rows, in blocks) are decided on centres and radii before any tree is moved. Each tree
returns at most k rows a query, and the best k of those follow from one grouped top-k. Where vectors
have no clusters (independent directions in many dimensions), no metric bound excludes anything, and
every distance is computed.

Scores are exact: integers of 64 bits, or Python's where those could overflow; float bounds are widened
by a margin.

Defined results: vectors that are null, empty, or hold null or non-finite components take no part, nor do
rows without a vec_id; vectors meet only those of their own length. A component whose floor lies outside a
long counts as the end of its range, as does a score. Ties go to the smaller vec_id. Every row is a row of
its own: a row never answers itself, but other rows with its vec_id do, and each row whose vec_id is a
query's gets its own ranking, also if rows repeat.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import persist_table, table

K, TREE, PAGE, QUERY_BLOCK, SCALE, PIVOTS = 10, 4096, 48, 512, 1024, 1024
#: Blocks and root balls that one part of the pairing compares, about.
BLOCKS_AT_ONCE, BALLS_AT_ONCE = 48, 1024


class MTree:
    """Bulk-loaded M-tree over integer vectors (rows of ``x``) with ``ids`` and row numbers ``rows``."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, rows: np.ndarray | None = None):
        rows = ids if rows is None else rows
        order = np.lexsort((rows, ids))
        self.ids, self.rows, self.x = ids[order], rows[order], x[order]
        self.most = float(np.abs(self.x.astype(np.float64)).max()) if x.size else 0.0
        self.computed = 0
        f = self.x.astype(np.float64)
        norms = (f * f).sum(axis=1)
        self.top = float(norms.max()) if len(norms) else 0.0
        self.points = np.hstack([f, np.sqrt(np.maximum(self.top - norms, 0.0))[:, None]])
        #: node: (is_leaf, members (rows or node numbers), routing points, radii, distances to the parent's routing point)
        self.nodes: list[tuple] = []
        self.root = self._build(np.arange(len(ids)), None)[0] if len(ids) else None

    def _build(self, rows: np.ndarray, parent: np.ndarray | None):
        """Returns (node number, routing point, covering radius)."""
        pts = self.points[rows]
        centre = pts[np.argmin(((pts - pts.mean(axis=0)) ** 2).sum(axis=1))]
        radius = float(np.sqrt(((pts - centre) ** 2).sum(axis=1).max()))
        if len(rows) <= PAGE:
            dist = np.sqrt(((pts - centre) ** 2).sum(axis=1))
            self.nodes.append((True, rows, pts, np.zeros(len(rows)), dist))
            return len(self.nodes) - 1, centre, radius
        # Farthest-first pivots; each row goes to its nearest pivot, even chunks where that can't divide.
        m = min(PAGE, -(-len(rows) // PAGE) if len(rows) <= PAGE * PAGE else PAGE)
        m = max(m, 2)
        picks, near = [0], np.full(len(rows), np.inf)
        part = np.zeros(len(rows), dtype=np.int64)
        for j in range(m):
            d = ((pts - pts[picks[-1]]) ** 2).sum(axis=1)
            part[d < near] = j
            near = np.minimum(near, d)
            picks.append(int(near.argmax()))
        pieces = []
        for j in np.unique(part):
            own = rows[part == j]
            if len(own) == len(rows):
                pieces += np.array_split(own, m)
            else:
                pieces.append(own)
        kids = [self._build(p, centre) for p in pieces]
        routes = np.array([k[1] for k in kids])
        self.nodes.append((False, np.array([k[0] for k in kids]), routes, np.array([k[2] for k in kids]), np.sqrt(((routes - centre) ** 2).sum(axis=1))))
        return len(self.nodes) - 1, centre, radius

    def search(self, own: int, q: np.ndarray, k: int, floor: int | None = None) -> list[tuple[int, int]]:
        """Best (score, vec_id) pairs but that of row ``own``, best first, and none below ``floor``; counts ``computed`` distances."""
        if self.root is None:
            return []
        q = q.astype(np.int64)
        wide = self.most * float(np.abs(q.astype(np.float64)).max()) * len(q) >= 2.0**62
        if wide:
            q = q.astype(object)
        f = np.append(q.astype(np.float64), 0.0)
        shift = float((f * f).sum()) + self.top
        best: list[tuple[int, int, int]] = []  # heap of (score, -vec_id, -row), the worst first
        slack = 1e-9 * (1.0 + shift)

        def limit() -> float:
            """Squared distance beyond which nothing can enter; equal scores must still be seen."""
            known = [float(s) for s in ([floor] if floor is not None else []) + ([best[0][0]] if len(best) >= k else [])]
            return shift - 2.0 * max(known) + slack if known else np.inf

        # heap of (lower bound, node, distance of the query to the node's own routing point or None)
        heap: list[tuple[float, int, float]] = [(0.0, self.root, -1.0)]
        while heap:
            bound, node, to_parent = heapq.heappop(heap)
            far = limit()
            if bound * bound > far:
                break
            leaf, members, pts, radii, dist = self.nodes[node]
            r = np.sqrt(far) if far < np.inf else np.inf
            keep = np.arange(len(members)) if to_parent < 0 or r == np.inf else np.flatnonzero(np.abs(to_parent - dist) <= radii + r + 1e-6 * (1 + r))
            if not len(keep):
                continue
            self.computed += len(keep)
            if leaf:
                at = members[keep]
                score = (self.x[at].astype(object) if wide else self.x[at]) @ q
                low = max([floor] * (floor is not None) + [b[0] for b in best[:1] if len(best) >= k], default=None)
                if low is not None:
                    fit = (score >= low).astype(bool)
                    at, score = at[fit], score[fit]
                for s, v, r in zip(score.tolist(), self.ids[at].tolist(), self.rows[at].tolist()):
                    if r == own:
                        continue
                    if len(best) < k:
                        heapq.heappush(best, (s, -v, -r))
                    elif (s, -v, -r) > best[0]:
                        heapq.heapreplace(best, (s, -v, -r))
            else:
                d = np.sqrt(np.maximum(((pts[keep] - f) ** 2).sum(axis=1), 0.0))
                for b, n, dd in zip(np.maximum(d - radii[keep] - 1e-6 * (1 + d), 0.0).tolist(), members[keep].tolist(), d.tolist()):
                    if b * b <= far:
                        heapq.heappush(heap, (b, n, dd))
        return [(s, -v) for s, v, _ in sorted(best, reverse=True)]


def quantised(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(vec_id, q array<bigint>): floor(1024 x) of complete finite vectors."""
    v = F.col(vector)
    fine = F.col(key).isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return df.where(fine).select(F.col(key).cast("long").alias("vec_id"), F.transform(v, lambda c: F.floor(c.cast("double") * SCALE)).alias("q"))


def _blob(x: np.ndarray) -> bytes:
    """Integers in the narrowest type that holds them, its name before them."""
    kind = next(t for t in ("<i2", "<i4", "<i8") if not x.size or (x.min() >= np.iinfo(t).min and x.max() <= np.iinfo(t).max))
    return kind.encode() + x.astype(kind).tobytes()


def _from_blob(b: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(b, b[:3].decode(), offset=3).reshape(rows, -1).astype(np.int64)


def _with_cells(rows: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """Add ``cell`` (nearest routing vector of the same length, -1 without one) and ``width``."""

    def run(batches):
        for batch in batches:
            vectors = batch.column("q")
            at = vectors.offsets.to_numpy()
            flat, start, width = vectors.flatten().to_numpy(zero_copy_only=False), at[:-1] - at[0], np.diff(at)
            cell = np.full(len(width), -1, np.int32)
            for w in np.unique(width):
                if int(w) not in pivots:
                    continue
                own = np.flatnonzero(width == w)
                p = pivots[int(w)]
                half = (p * p).sum(axis=1) / 2
                for lo in range(0, len(own), 4096):
                    part = own[lo : lo + 4096]
                    x = flat[(start[part][:, None] + np.arange(w)).ravel()].reshape(len(part), w).astype(np.float64)
                    cell[part] = (x @ p.T - half).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(width.astype(np.int32))], names=[*batch.schema.names, "cell", "width"])

    return rows.mapInArrow(run, "rid long, vec_id long, q array<bigint>, cell int, width int")


def _packed(rows: DataFrame, most: int) -> DataFrame:
    """One row for at most ``most`` vectors of one cell and length: cell, width, n, rids, ids, q, centre, radius."""
    counts = rows.groupBy("cell", "width").agg(F.ceil(F.count(F.lit(1)) / (0.9 * most)).alias("subs"))
    dealt = rows.join(counts, ["cell", "width"]).withColumn("sub", F.pmod(F.xxhash64("rid"), F.col("subs"))).drop("subs")

    def run(tab: pa.Table) -> pa.Table:
        tab = tab.combine_chunks().sort_by("rid")
        n, w = tab.num_rows, tab.column("width")[0].as_py()
        x = tab.column("q").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, w)
        rid, ids = (tab.column(c).to_numpy().astype("<i8") for c in ("rid", "vec_id"))
        out = []
        for lo in range(0, n, most):
            part = x[lo : lo + most].astype(np.float64)
            centre = part.mean(axis=0)
            radius = float(np.sqrt(((part - centre) ** 2).sum(axis=1).max()))
            out.append((tab.column("cell")[0].as_py(), w, len(part), rid[lo : lo + most].tobytes(), ids[lo : lo + most].tobytes(), _blob(x[lo : lo + most]), centre.astype("<f8").tobytes(), radius))
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.float64())
        return pa.table({name: pa.array([o[i] for o in out], t) for i, (name, t) in enumerate(zip(("cell", "width", "n", "rids", "ids", "q", "centre", "radius"), kinds))})

    return dealt.select("rid", "vec_id", "q", "cell", "width", "sub").groupBy("cell", "width", "sub").applyInArrow(run, "cell int, width int, n int, rids binary, ids binary, q binary, centre binary, radius double")


def _may_hold(q: np.ndarray, centre: np.ndarray, radius: float, floor: np.ndarray) -> np.ndarray:
    """Which queries may find a score of at least their floor in a ball (Cauchy-Schwarz, widened)."""
    f = q.astype(np.float64)
    norm = np.sqrt((f * f).sum(axis=1))
    reach = f @ centre + norm * radius
    return reach + 1e-6 * (1.0 + np.abs(reach) + norm * (radius + np.sqrt((centre * centre).sum()))) >= floor


_NEAR = ["tree", "n", "rids", "ids", "q"]
_BLOCK = ["block", "q_n", "q_rids", "q_ids", "q_q", "floors"]


def _searched(pairs: DataFrame, k: int, only_floors: bool) -> DataFrame:
    """Rows of a block and a tree to found rows, or to the block's floors (the k-th best scores, -inf without k)."""

    def run(batches):
        held: tuple[int, MTree] | None = None
        for batch in batches:
            out: list[tuple] = []
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if held is None or held[0] != row["tree"]:
                    held = (row["tree"], MTree(np.frombuffer(row["ids"], "<i8"), _from_blob(row["q"], row["n"]), np.frombuffer(row["rids"], "<i8")))
                tree, block = held[1], _from_blob(row["q_q"], row["q_n"])
                rids, ids, floor = np.frombuffer(row["q_rids"], "<i8"), np.frombuffer(row["q_ids"], "<i8"), np.frombuffer(row["floors"], "<f8")
                if only_floors:
                    best = [tree.search(r, q, k) for r, q in zip(rids.tolist(), block)]
                    out.append((row["block"], np.array([float(b[-1][0]) if len(b) == k else -np.inf for b in best], "<f8").tobytes()))
                    continue
                may = _may_hold(block, np.frombuffer(row["centre"], "<f8"), row["radius"], floor)
                for j in np.flatnonzero(may).tolist():
                    # A floor as a float is rounded; one step down keeps every equal score.
                    low = None if floor[j] == -np.inf else int(np.floor(np.nextafter(floor[j], -np.inf)))
                    out += [(int(rids[j]), int(ids[j]), v, max(-(2**63), min(2**63 - 1, s))) for s, v in tree.search(int(rids[j]), block[j], k, low)]
            names = ["block", "floors"] if only_floors else ["rid", "query_id", "vec_id", "score"]
            kinds = [pa.int64(), pa.binary()] if only_floors else [pa.int64()] * 4
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)], names=names)

    columns = [*_NEAR, *_BLOCK, "centre", "radius"]
    return pairs.select(*columns).mapInArrow(run, "block long, floors binary" if only_floors else "rid long, query_id long, vec_id long, score long")


def _met(pairs: DataFrame) -> DataFrame:
    """The pairs of blocks and trees (by centre and radius alone) where some query may find something: (block, tree)."""

    def run(batches):
        for batch in batches:
            keep = []
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                keep.append(bool(_may_hold(_from_blob(row["q_q"], row["q_n"]), np.frombuffer(row["centre"], "<f8"), row["radius"], np.frombuffer(row["floors"], "<f8")).any()))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["block", "tree"])

    return pairs.select("block", "tree", "q_n", "q_q", "floors", "centre", "radius").mapInArrow(run, "block long, tree long")


def _paired(blocks: DataFrame, balls: DataFrame) -> DataFrame:
    """Every block beside every root ball of its length, dealt to (rows of blocks) x (columns of balls).

    Vectors mostly have one length, so the length alone would put all pairs into one task. A block goes to
    each column, which costs its vectors once for ``BALLS_AT_ONCE`` pairs, and a ball to each row.
    """
    n_rows, n_columns = (max(1, -(-df.count() // most)) for df, most in ((blocks, BLOCKS_AT_ONCE), (balls, BALLS_AT_ONCE)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>"))
    dealt = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n).cast("long"))
    left = blocks.withColumn("part", dealt("block", n_rows)).withColumn("column", every(n_columns))
    right = balls.withColumn("column", dealt("tree", n_columns)).withColumn("part", every(n_rows))
    return left.join(right, ["width", "part", "column"]).drop("part", "column")


def top_k(queries: DataFrame, candidates: DataFrame, k: int = K, pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` best candidates of each query row.

    Both frames have rid (a row's number, by which it is kept from answering itself), vec_id and q.
    """
    n = candidates.count()
    chosen = candidates.orderBy(F.xxhash64("rid"), "rid").limit(max(1, min(pivots, -(-n // TREE)))).select("q").toArrow().column("q").to_pylist()
    by_width: dict[int, np.ndarray] = {w: np.array([c for c in chosen if len(c) == w], np.float64) for w in {len(c) for c in chosen}}
    trees = persist_table(_packed(_with_cells(candidates, by_width), TREE).withColumn("tree", F.monotonically_increasing_id()), "topk-trees")
    packed = _packed(_with_cells(queries, by_width), QUERY_BLOCK).drop("centre", "radius").withColumnsRenamed({"n": "q_n", "rids": "q_rids", "ids": "q_ids", "q": "q_q"})
    blocks = persist_table(packed.withColumn("block", F.monotonically_increasing_id()), "topk-blocks")
    # Home: a tree of the block's own cell; a block without one has no floors.
    home = trees.groupBy("cell", "width").agg(F.max_by("tree", "n").alias("tree"))
    at_home = blocks.join(home, ["cell", "width"]).select(*_BLOCK[:-1], F.lit(b"").alias("floors"), "tree").join(trees.select(*_NEAR, "centre", "radius"), "tree")
    floors = persist_table(_searched(at_home.sortWithinPartitions("tree"), k, True), "topk-floors")
    unknown = F.expr("unhex(repeat('000000000000F0FF', q_n))")  # -inf for each query
    blocks = persist_table(blocks.join(floors, "block", "left").withColumn("floors", F.coalesce("floors", unknown)), "topk-blocks-floors")
    pairs = _met(_paired(blocks, trees.select("tree", "width", "centre", "radius")))
    both = pairs.join(blocks.select(*_BLOCK), "block").join(trees.select(*_NEAR, "centre", "radius"), "tree")
    found = _searched(both, k, False)
    w = Window.partitionBy("rid").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantised(table(spark, sf_dir, "embeddings"), "vec_id", "embedding").withColumn("rid", F.monotonically_increasing_id())
    vectors = persist_table(vectors.select("rid", "vec_id", "q"), "topk-vectors")
    return top_k(vectors.where(F.col("vec_id") % 100 == 0), vectors)
