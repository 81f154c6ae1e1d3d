"""Exact near-duplicates of embeddings by dual traversal of cover trees.

Equal vectors are one. The different ones are dealt into blocks of neighbours; each block gets a cover tree, and
every pair of blocks whose trees may come close is one task that walks both trees together. A pair of nodes goes
when even its nearest points are too far apart, and counts as a whole when even its farthest are near enough.
"""
from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from takt.llm.common import settled
from takt.llm.components import components, local_roots

LEAST_COSINE = 0.9
BLOCK_ROWS, MOST_BLOCKS, PIVOTS, SEED = 4096, 1024, 256, 11
SLACK = 1e-9
FINEST = 0.25
LEAF_PAIRS, WIDE = 1 << 20, 4096


@dataclass
class Tree:
    """Nodes in the order they were made. A node covers ``points[first:last]``, all within ``radius`` of its center.

    Children follow each other, have half the radius of their level, and the first has the same center.
    """

    center: np.ndarray
    radius: np.ndarray
    first: np.ndarray
    last: np.ndarray
    child: np.ndarray
    children: np.ndarray
    points: np.ndarray


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Chords between unit vectors."""
    return np.sqrt(np.maximum(2 - 2 * (x @ y.T), 0))


def build(unit: np.ndarray) -> Tree:
    """Cover tree of a block of unit vectors, level by level: the cover of a level has half the radius of the one above.

    Centers of a node's children are taken greedily, its own center first, so they are farther apart than the
    children's radius; a point goes to the first center that covers it. Radii are then drawn in to the points.
    """
    center, radius, first, last, child, children = [0], [0.0], [0], [len(unit)], [-1], [0]
    points = np.arange(len(unit))
    todo = [(0, 2.0)]
    while todo:
        node, cover = todo.pop()
        own = points[first[node]:last[node]].copy()
        far = distances(unit[own], unit[center[node]][None])[:, 0]
        radius[node] = float(far.max())
        if len(own) == 1 or radius[node] < 1e-7:
            continue
        while cover / 2 >= radius[node]:
            cover /= 2
        half = cover / 2
        gap = distances(unit[own], unit[own]) if len(own) <= 4096 else None
        at = int(np.flatnonzero(own == center[node])[0])
        groups = cover_of(unit[own], gap, at, half)
        while 2 * len(groups) > len(own) and half > FINEST:  # a level that groups next to nothing is passed over
            half /= 2
            groups = cover_of(unit[own], gap, at, half)
        child[node], children[node] = len(center), len(groups)
        begin = first[node]
        for at, members in groups:
            center.append(int(own[at]))
            radius.append(0.0)
            first.append(begin)
            points[begin:begin + len(members)] = own[members]
            begin += len(members)
            last.append(begin)
            child.append(-1)
            children.append(0)
            if len(members) > 1:
                todo.append((len(center) - 1, half))
    return Tree(*map(np.array, (center, radius, first, last, child, children, points)))


def cover_of(unit: np.ndarray, gap: np.ndarray | None, at: int, radius: float) -> list[tuple[int, np.ndarray]]:
    """Greedy cover: (center, members) of balls of one radius, ``at`` first; centers lie farther apart than that."""
    free, groups = np.ones(len(unit), bool), []
    while True:
        near = (gap[at] if gap is not None else distances(unit, unit[at][None])[:, 0]) <= radius
        near[at] = True
        near &= free
        free &= ~near
        groups.append((at, np.flatnonzero(near)))
        if not free.any():
            return groups
        at = int(np.argmax(free))


class Join:
    """Links of two blocks: how many vectors each of a and b is linked to, and edges (i, j) that connect them.

    ``wa`` and ``wb`` are numbers of copies. With ``same`` both blocks are one and all counts go to ``na``.
    """

    def __init__(self, a, ta: Tree, wa, b, tb: Tree, wb, same: bool, least: float):
        self.a, self.ta, self.wa, self.b, self.tb, self.wb, self.same, self.least = a, ta, wa, b, tb, wb, same, least
        self.limit = float(np.sqrt(2 - 2 * least))
        self.na = np.zeros(len(a), np.int64)
        self.nb = self.na if same else np.zeros(len(b), np.int64)
        self.edges: list[tuple[np.ndarray, np.ndarray]] = []
        x = y = np.zeros(1, np.int64)
        while len(x):
            x, y = self.open(x, y)

    def open(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Settle what can be settled among the children of node pairs; return the pairs that stay open.

        Only the node that reaches much farther is opened, else both are.
        """
        ta, tb = self.ta, self.tb
        itself = (x == y) if self.same else np.zeros(len(x), bool)
        open_x = (ta.children[x] > 0) & (itself | (tb.children[y] == 0) | (2 * ta.radius[x] >= tb.radius[y]))
        open_y = (tb.children[y] > 0) & (itself | (ta.children[x] == 0) | (2 * tb.radius[y] >= ta.radius[x]))
        n_x, n_y = np.where(open_x, ta.children[x], 1), np.where(open_y, tb.children[y], 1)
        from_x, from_y = np.where(open_x, ta.child[x], x), np.where(open_y, tb.child[y], y)
        left = []
        stuck = ~open_x & ~open_y
        for k in np.flatnonzero(stuck):
            self.points(int(x[k]), int(y[k]), bool(itself[k]))
        for k in np.flatnonzero(~stuck & (n_x * n_y >= WIDE)):
            ys = np.arange(from_y[k], from_y[k] + n_y[k])
            step = max(1, LEAF_PAIRS // len(ys))
            for at in range(from_x[k], from_x[k] + n_x[k], step):
                xs = np.arange(at, min(at + step, from_x[k] + n_x[k]))
                cosine = self.a[ta.center[xs]] @ self.b[tb.center[ys]].T
                reach = self.limit + SLACK + float(ta.radius[xs].max() + tb.radius[ys].max())
                i, j = np.nonzero(cosine >= 1 - reach * reach / 2 - SLACK)
                keep = xs[i] <= ys[j] if itself[k] else slice(None)
                left.append(self.sift(xs[i][keep], ys[j][keep], cosine[i, j][keep]))
        small = np.flatnonzero(~stuck & (n_x * n_y < WIDE))
        for at in range(0, len(small), 256):
            part = small[at:at + 256]
            total = n_x[part] * n_y[part]
            of = np.repeat(part, total)
            within = np.arange(total.sum()) - np.repeat(np.cumsum(total) - total, total)
            cx, cy = from_x[of] + within // n_y[of], from_y[of] + within % n_y[of]
            keep = ~itself[of] | (cx <= cy)
            cx, cy = cx[keep], cy[keep]
            for to in range(0, len(cx), 1 << 15):
                px, py = cx[to:to + (1 << 15)], cy[to:to + (1 << 15)]
                cosine = np.einsum("ij,ij->i", self.a[ta.center[px]], self.b[tb.center[py]])
                left.append(self.sift(px, py, cosine))
        if not left:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([p[0] for p in left]), np.concatenate([p[1] for p in left])

    def sift(self, x: np.ndarray, y: np.ndarray, cosine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Drop node pairs out of reach, count those wholly in reach, return the rest."""
        ta, tb = self.ta, self.tb
        single = (ta.last[x] - ta.first[x] == 1) & (tb.last[y] - tb.first[y] == 1)
        reach = ta.radius[x] + tb.radius[y]
        gap = np.sqrt(np.maximum(2 - 2 * cosine, 0))
        done = single & (cosine >= self.least)  # two single points: their cosine itself decides
        self.count(ta.points[ta.first[x[done]]], tb.points[tb.first[y[done]]])
        sure = ~single & (gap + reach <= self.limit - SLACK)
        for k in np.flatnonzero(sure):
            self.whole(int(x[k]), int(y[k]))
        rest = ~single & ~sure & (gap <= self.limit + reach + SLACK)
        return x[rest], y[rest]

    def count(self, p: np.ndarray, q: np.ndarray) -> None:
        """Links p[k] - q[k], each unordered pair once."""
        self.na += np.bincount(p, self.wb[q], len(self.na)).astype(np.int64)
        other = p != q if self.same else np.ones(len(p), bool)
        self.nb += np.bincount(q[other], self.wa[p[other]], len(self.nb)).astype(np.int64)
        self.edges.append((p, q))

    def whole(self, x: int, y: int) -> None:
        """Every point below x is linked to every one below y."""
        p = self.ta.points[self.ta.first[x]:self.ta.last[x]]
        q = self.tb.points[self.tb.first[y]:self.tb.last[y]]
        self.na[p] += self.wb[q].sum()
        if not self.same or x != y:
            self.nb[q] += self.wa[p].sum()
        self.edges += [(p, np.full(len(p), q[0])), (np.full(len(q), p[0]), q)]

    def points(self, x: int, y: int, itself: bool) -> None:
        """Two nodes without children, of points that are all but one: by their cosines."""
        p = self.ta.points[self.ta.first[x]:self.ta.last[x]]
        q = self.tb.points[self.tb.first[y]:self.tb.last[y]]
        step = max(1, LEAF_PAIRS // len(q))
        for at in range(0, len(p), step):
            part = p[at:at + step]
            i, j = np.nonzero(self.a[part] @ self.b[q].T >= self.least)
            i, j = part[i], q[j]
            keep = i <= j if itself else slice(None)
            self.count(i[keep], j[keep])

    def linked(self) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([e[0] for e in self.edges]), np.concatenate([e[1] for e in self.edges])


def unit_rows(column) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in column])
    return x / np.linalg.norm(x, axis=1)[:, None]


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding as doubles, good) of every row; a good vector can be compared with others of its length."""
    e = F.col("embedding").cast("array<double>")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("embedding")).withColumn(
        "good", F.coalesce(fine & F.exists("embedding", lambda x: x != 0), F.lit(False)))
    length = rows.where("good").groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    n = length["n"] if length else 0
    return rows.withColumn("good", F.col("good") & (F.size("embedding") == n))


def blocks_of(distinct: DataFrame, block_rows: int, most_blocks: int, pivots: int) -> DataFrame:
    """(block, tree) rows: vectors near the same pivots lie in the same blocks, each of about ``block_rows``.

    Pivots are a bounded sample of the vectors (the first by a hash). A pivot's cell with too many vectors is cut
    by a hash, small cells next to each other in the pivots' order share a block.
    """
    n = distinct.count()
    rows = max(block_rows, -(-n // most_blocks))
    sample = distinct.orderBy(F.xxhash64("rep", F.lit(SEED)), "rep").limit(min(pivots, max(1, n // rows))).select("embedding").collect()
    heart = unit_rows([r[0] for r in sample])
    order = [0]  # a walk from pivot to nearest pivot: neighbours in number are neighbours in space
    while len(order) < len(heart):
        gap = distances(heart, heart[order[-1]][None])[:, 0]
        gap[order] = np.inf
        order.append(int(np.argmin(gap)))
    heart = heart[order]

    def cell(batches):
        for part in batches:
            x = unit_rows(part["embedding"]) if len(part) else np.zeros((0, heart.shape[1]))
            part["cell"] = np.argmin(distances(x, heart), axis=1) if len(part) else np.zeros(0, int)
            yield part

    celled = settled(distinct.mapInPandas(cell, "rep long, copies long, embedding array<double>, cell int"))
    size = {r["cell"]: r["count"] for r in celled.groupBy("cell").count().collect()}  # one row a pivot
    first, cuts, number, room = [], [], -1, 0
    for c in range(len(heart)):
        k = size.get(c, 0)
        if k > room:
            number += 1
            room = rows
        first.append(max(number, 0))
        pieces = max(1, -(-k // rows))
        cuts.append(pieces)
        number, room = (number + pieces - 1, 0) if pieces > 1 else (number, room - k)
    at, many = (F.array(*map(F.lit, v)) for v in (first, cuts))
    return celled.select("rep", "copies", "embedding", (F.get(at, F.col("cell")) + F.pmod(
        F.xxhash64("rep", F.lit(SEED + 1)), F.get(many, F.col("cell")).cast("long"))).cast("int").alias("block"))


BLOCK = "block int, reps binary, copies binary, vectors binary, tree binary, center binary, radius double, n int"


def pack(part: pd.DataFrame) -> pd.DataFrame:
    """A block as one row: its vectors, and a center and radius that cover them."""
    part = part.sort_values("rep", kind="stable")
    unit = unit_rows(part["embedding"])
    middle = unit.mean(axis=0)
    length = np.linalg.norm(middle)
    heart = middle / length if length > 1e-6 else unit[0]
    return pd.DataFrame([{
        "block": part["block"].iat[0], "reps": part["rep"].to_numpy(np.int64).tobytes(), "copies": part["copies"].to_numpy(np.int64).tobytes(),
        "vectors": unit.tobytes(), "tree": pickle.dumps(build(unit)), "center": heart.tobytes(), "radius": float(distances(unit, heart[None]).max()), "n": len(part)}])


def meet(row, least: float) -> pd.DataFrame:
    """Links of one pair of blocks: counts, and the smallest row number of each vector's part of the two."""
    ra, rb, wa, wb = (np.frombuffer(v, np.int64) for v in (row.reps_a, row.reps_b, row.copies_a, row.copies_b))
    a, b = (np.frombuffer(v, np.float64).reshape(len(r), -1) for v, r in ((row.vectors_a, ra), (row.vectors_b, rb)))
    same = row.block_a == row.block_b
    made = Join(a, pickle.loads(row.tree_a), wa, b, pickle.loads(row.tree_b), wb, same, least)
    i, j = made.linked()
    reps, links = (ra, made.na) if same else (np.concatenate([ra, rb]), np.concatenate([made.na, made.nb]))
    root = local_roots(len(reps), i, j if same else j + len(a))
    hit = links > 0
    return pd.DataFrame({"rep": reps[hit], "links": links[hit], "root": reps[root[hit]]})


def linked(vectors: DataFrame, least: float = LEAST_COSINE, block_rows: int = BLOCK_ROWS, most_blocks: int = MOST_BLOCKS,
           pivots: int = PIVOTS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of vectors.

    Two vectors are linked if their cosine, in double precision, is ``least`` or more. n_links counts the other
    rows that a row is linked to; component_id is the smallest vec_id reachable over links; kept marks that one.
    NULL vectors, zero vectors, and those with NULL or non-finite components link with nothing; so do vectors of
    another length than most have. Equal vectors are linked; repeated vec_ids are rows of their own. An empty
    table gives no row. Labels and other columns are not read.
    """
    rows = settled(usable(vectors))
    good = rows.where("good")
    distinct = settled(good.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")).select("rep", "copies", "embedding"))
    alone = rows.where(~F.col("good")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    if distinct.isEmpty():
        return alone.withColumn("kept", F.lit(True))
    dealt = blocks_of(distinct, block_rows, most_blocks, pivots)
    blocks = settled(dealt.groupBy("block").applyInPandas(pack, BLOCK))
    tops = sorted(blocks.select("block", "center", "radius").collect())  # ``most_blocks`` rows or a few more
    heart = np.stack([np.frombuffer(t["center"]) for t in tops])
    radius = np.array([t["radius"] for t in tops])
    gap = distances(heart, heart) - radius[:, None] - radius[None, :]
    i, j = np.nonzero(np.triu(gap <= np.sqrt(2 - 2 * least) + SLACK))
    pairs = vectors.sparkSession.createDataFrame([(tops[a]["block"], tops[b]["block"]) for a, b in zip(i, j)], "block_a int, block_b int")
    side = lambda s: blocks.select(*[F.col(c).alias(f"{c}_{s}") for c in ("block", "reps", "copies", "vectors", "tree")])

    def walk(batches):
        for part in batches:
            yield from (meet(row, least) for row in part.itertuples(index=False))

    met = settled(pairs.join(side("a"), "block_a").join(side("b"), "block_b").mapInPandas(walk, "rep long, links long, root long"))
    counts = met.groupBy("rep").agg(F.sum("links").alias("links"))
    comps = components(met.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    classes = (distinct.join(counts, "rep", "left").join(comps, F.col("rep") == F.col("node"), "left")
               .select("embedding", (F.coalesce("links", F.col("copies")) - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")))
    met_rows = good.join(classes, "embedding").select("vec_id", "n_links", "component_id")
    return met_rows.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


ORACLE = """
WITH RECURSIVE good AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
    AND len([x FOR x IN embedding IF x <> 0]) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id
          WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
low AS (SELECT a, min(b) AS b FROM reach GROUP BY a), n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, least(vec_id, coalesce(low.b, vec_id)) AS component_id,
       vec_id = least(vec_id, coalesce(low.b, vec_id)) AS kept
FROM embeddings LEFT JOIN low ON vec_id = low.a LEFT JOIN n ON vec_id = n.a
"""
