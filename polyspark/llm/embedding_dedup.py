"""Embedding near-dedup with hierarchical navigable small-world graphs, one per shard.

Vectors of a label are dealt to shards; each shard builds a layered graph over its *leaders*: a vector within the link
angle of a leader joins that leader's group instead of the graph, so a huge group of near copies is one node. Every block of
vectors then queries every shard of its label. By the triangle inequality of angles, all partners of a vector lie in groups
whose leaders are within twice the link angle, so the search is a range search over leaders: the beam widens while it is
full of leaders in range, and doubles for the whole block until an audit (a sample of the block searched by brute force)
finds nothing missed. Members of the groups found are verified by cosine in double precision, as matrix products.

Links are counted, not listed: a task returns for each vector its number of partners and one edge to the smallest id it
is united with, so groups of any size cost rows in proportion to their vectors.

Nulls and edges: a null label, a null or empty vector, a zero vector, or one with null or non-finite components links with
nothing and is returned with n_links 0 and itself as component; vectors of different lengths do not link; rows that repeat
a vec_id count once; rows with a null vec_id are left out; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .components import connected_components
from .stash import Stash

COSINE = 0.98
#: Rows of a shard and of a query block (fixed sizes: the numbers of both follow the input).
SHARD_ROWS, BLOCK_ROWS = 16_384, 2_048
LINKS, LINKS_BOTTOM, BEAM, BATCH = 16, 32, 32, 256
#: Every so many queries of a block are audited against brute force.
AUDIT_EVERY = 16


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    return rows / np.linalg.norm(rows, axis=1)[:, None]


class Graph:
    """Layered small-world graph over unit vectors; cosine is the closeness."""

    def __init__(self, dim: int, room: int):
        self.vec = np.zeros((room, dim), np.float32)
        self.size = 0
        self.adj = [np.full((room, LINKS_BOTTOM), -1, np.int32)]
        self.level = np.zeros(room, np.int8)
        self.entry = -1

    @classmethod
    def load(cls, vec: np.ndarray, level: np.ndarray, adj: list[np.ndarray], entry: int) -> Graph:
        g = cls.__new__(cls)
        g.vec, g.level, g.adj, g.entry, g.size = vec, level, adj, entry, len(vec)
        return g

    def _close(self, q: np.ndarray, near: np.ndarray) -> np.ndarray:
        """Cosines of each query with its row of node ids; -2 where an id is missing."""
        sims = np.einsum("qd,qmd->qm", q, self.vec[np.maximum(near, 0)])
        sims[near < 0] = -2
        return sims

    def descend(self, q: np.ndarray, down_to: int) -> np.ndarray:
        """Greedy search through the upper layers, all queries together."""
        cur = np.full(len(q), self.entry)
        best = self._close(q, cur[:, None])[:, 0]
        for layer in range(len(self.adj) - 1, down_to - 1, -1):
            live = np.arange(len(q))
            while len(live):
                near = self.adj[layer][cur[live]]
                sims = self._close(q[live], near)
                k = np.argmax(sims, 1)
                top = sims[np.arange(len(live)), k]
                better = top > best[live]
                live = live[better]
                cur[live], best[live] = near[better, k[better]], top[better]
        return cur

    def search(self, q: np.ndarray, beam: int, layer: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(ids, cosines) of the beam of each query, best first; -1 where a beam has room left."""
        n, rows = len(q), np.arange(len(q))
        beam = min(beam, self.size)
        ids = np.full((n, beam), -1, np.int64)
        sims = np.full((n, beam), -2.0, np.float32)
        done = np.zeros((n, beam), bool)
        ids[:, 0] = self.descend(q, layer + 1)
        sims[:, 0] = self._close(q, ids[:, :1])[:, 0]
        seen = np.zeros((n, self.size), bool)
        seen[rows, ids[:, 0]] = True
        live = rows
        while len(live):
            score = np.where(done[live] | (ids[live] < 0), -3.0, sims[live])
            k = np.argmax(score, 1)
            more = score[np.arange(len(live)), k] > -2.5
            live, k = live[more], k[more]
            if not len(live):
                break
            done[live, k] = True
            near = self.adj[layer][ids[live, k]].astype(np.int64)
            near[seen[live[:, None], np.maximum(near, 0)]] = -1
            r, c = np.nonzero(near >= 0)
            seen[live[r], near[r, c]] = True
            got = self._close(q[live], near)
            all_ids = np.concatenate([ids[live], near], 1)
            all_sims = np.concatenate([sims[live], got], 1)
            all_done = np.concatenate([done[live], np.zeros(near.shape, bool)], 1)
            top = np.argpartition(-all_sims, beam - 1, 1)[:, :beam] if all_sims.shape[1] > beam else np.tile(np.arange(all_sims.shape[1]), (len(live), 1))
            ids[live], sims[live], done[live] = (np.take_along_axis(x, top, 1) for x in (all_ids, all_sims, all_done))
        order = np.argsort(-sims, 1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)

    def _spread(self, near: np.ndarray, sims: np.ndarray, most: int) -> list[int]:
        """Neighbours that are closer to the new node than to those already taken; then the closest of the rest."""
        taken: list[int] = []
        vec = self.vec[near]
        between = vec @ vec.T
        for k in range(len(near)):
            if len(taken) < most and all(between[k, t] < sims[k] for t in taken):
                taken.append(k)
        for k in range(len(near)):
            if len(taken) >= most:
                break
            if k not in taken:
                taken.append(k)
        return taken

    def _link(self, layer: int, a: int, b: int, sim: float) -> None:
        row = self.adj[layer][a]
        free = np.flatnonzero(row < 0)
        if len(free):
            row[free[0]] = b
            return
        near = self.vec[row] @ self.vec[a]
        worst = int(np.argmin(near))
        if near[worst] < sim:
            row[worst] = b

    def insert(self, vec: np.ndarray, levels: np.ndarray, near: np.ndarray, sims: np.ndarray) -> None:
        """Add a batch: ``near`` and ``sims`` are search results in the graph so far; members of the batch see each other too."""
        base, n = self.size, len(vec)
        self.vec[base : base + n] = vec
        self.level[base : base + n] = levels
        self.size += n
        inner = vec @ vec.T
        upper = {}
        if base:
            for layer in range(1, len(self.adj)):
                up = np.flatnonzero(levels >= layer)
                if len(up):
                    upper[layer] = dict(zip(up.tolist(), zip(*self._search_upper(vec[up], layer, base))))
        for i in range(n):
            node = base + i
            for layer in range(int(levels[i]) + 1):
                if layer == len(self.adj):
                    self.adj.append(np.full((len(self.vec), LINKS), -1, np.int32))
                if layer == 0:
                    c, s = (near[i], sims[i]) if base else (np.zeros(0, np.int64), np.zeros(0, np.float32))
                else:
                    c, s = upper.get(layer, {}).get(i, (np.zeros(0, np.int64), np.zeros(0, np.float32)))
                ok = c >= 0
                mates = np.flatnonzero(levels[:i] >= layer)
                mates = mates[np.argsort(-inner[i, mates], kind="stable")[:LINKS]]
                c, s = np.concatenate([c[ok], base + mates]), np.concatenate([s[ok], inner[i, mates]])
                order = np.argsort(-s, kind="stable")[: 2 * LINKS]
                c, s = c[order], s[order]
                for k in self._spread(c, s, LINKS):
                    self._link(layer, node, int(c[k]), float(s[k]))
                    self._link(layer, int(c[k]), node, float(s[k]))
            if self.entry < 0 or levels[i] > self.level[self.entry]:
                self.entry = node

    def _search_upper(self, q: np.ndarray, layer: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        now, self.size = self.size, size
        if self.level[self.entry] < layer:
            out = np.full((len(q), 1), -1, np.int64), np.full((len(q), 1), -2.0, np.float32)
        else:
            out = self.search(q, LINKS, layer)
        self.size = now
        return out


class Shard:
    """Groups of vectors round leaders, and the graph of the leaders."""

    def __init__(self, ids: np.ndarray, vec: np.ndarray, cosine: float):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vec = ids[order], vec[order]
        u = unit(self.vec).astype(np.float32)
        n = len(ids)
        # The level of a node follows from its id, so a rebuilt shard has the same layers.
        draw = (tk.mix(self.ids.astype(tk.U)) >> tk.U(11)).astype(np.float64) / 2**53
        levels = np.minimum(-np.log(np.maximum(draw, 1e-12)) / math.log(LINKS), 6).astype(np.int8)
        g = Graph(vec.shape[1], n)
        leader_of = np.full(n, -1, np.int64)
        own = np.zeros(n, np.int64)
        for a in range(0, n, BATCH):
            q = u[a : a + BATCH]
            if g.size:
                near, sims = g.search(q, BEAM)
                joins = sims[:, 0] >= cosine
                leader_of[a : a + BATCH] = np.where(joins, near[:, 0], -1)
            else:
                near, sims, joins = np.zeros((len(q), 0), np.int64), np.zeros((len(q), 0), np.float32), np.zeros(len(q), bool)
            inner = q @ q.T
            new: list[int] = []
            for i in np.flatnonzero(~joins).tolist():
                if new:
                    k = int(np.argmax(inner[i, new]))
                    if inner[i, new[k]] >= cosine:
                        leader_of[a + i] = g.size + k
                        continue
                leader_of[a + i] = g.size + len(new)
                new.append(i)
            if new:
                own[g.size : g.size + len(new)] = a + np.array(new)
                g.insert(q[new], levels[a + np.array(new)], near[new], sims[new])
        m = g.size
        self.graph = Graph.load(g.vec[:m], g.level[:m], [x[:m] for x in g.adj], g.entry)
        self.group = np.argsort(leader_of, kind="stable")
        self.bound = np.searchsorted(leader_of[self.group], np.arange(m + 1))
        # The widest angle within any group: rounding and the float search are covered by a little room.
        self.cosine = cosine

    def pack(self) -> bytes:
        g = self.graph
        out = [np.array([len(self.ids), self.vec.shape[1], g.size, len(g.adj), g.entry], np.int64).tobytes(), self.ids.tobytes(), self.vec.astype(np.float32).tobytes(), g.vec.tobytes(), g.level.tobytes()]
        out += [x.tobytes() for x in g.adj] + [self.group.astype(np.int64).tobytes(), self.bound.astype(np.int64).tobytes()]
        return b"".join(out)

    @classmethod
    def unpack(cls, blob: bytes, cosine: float) -> Shard:
        s = cls.__new__(cls)
        n, dim, m, layers, entry = np.frombuffer(blob, np.int64, 5).tolist()
        at = 40

        def take(kind, *shape):
            nonlocal at
            count = int(np.prod(shape))
            x = np.frombuffer(blob, kind, count, at).reshape(shape)
            at += x.nbytes
            return x

        s.ids, s.vec = take(np.int64, n), take(np.float32, n, dim)
        vec, level = take(np.float32, m, dim), take(np.int8, m)
        adj = [take(np.int32, m, LINKS_BOTTOM if k == 0 else LINKS) for k in range(layers)]
        s.graph = Graph.load(vec, level, adj, entry)
        s.group, s.bound, s.cosine = take(np.int64, n), take(np.int64, m + 1), cosine
        return s

    def leaders_in_range(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, leader) pairs within twice the link angle."""
        least = np.float32(2 * self.cosine * self.cosine - 1 - 1e-4)
        audit = np.arange(0, len(q), AUDIT_EVERY)
        truth = q[audit] @ self.graph.vec.T >= least
        beam, rows, found = BEAM, np.arange(len(q)), []
        while True:
            retry = np.zeros(len(q), bool)
            found, todo, width = [], rows, beam
            while len(todo):  # beams that are full of leaders in range widen
                full = []
                for a in range(0, len(todo), 512):
                    part = todo[a : a + 512]
                    ids, sims = self.graph.search(q[part], width)
                    r, c = np.nonzero((sims >= least) & (ids >= 0))
                    saturated = (sims[:, -1] >= least) & (width < self.graph.size)
                    keep = ~saturated[r]
                    found.append(np.stack([part[r[keep]], ids[r[keep], c[keep]]], 1))
                    full.append(part[saturated])
                todo = np.concatenate(full)
                width *= 2
            pairs = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
            got = np.zeros(truth.shape, bool)
            place = np.full(len(q), -1)
            place[audit] = np.arange(len(audit))
            sampled = place[pairs[:, 0]] >= 0
            got[place[pairs[sampled, 0]], pairs[sampled, 1]] = True
            if (got | ~truth).all() or beam >= self.graph.size:
                return pairs[:, 0], pairs[:, 1]
            beam *= 2

    def links(self, ids: np.ndarray, vec: np.ndarray) -> tuple[np.ndarray, dict[int, int]]:
        """Partners of each query, and for every vector that has some the smallest id of what it is united with here."""
        q = unit(vec)
        own = unit(self.vec)
        qi, leader = self.leaders_in_range(q.astype(np.float32))
        order = np.argsort(leader, kind="stable")
        qi, leader = qi[order], leader[order]
        count = np.zeros(len(ids), np.int64)
        low_q, low_x = ids.copy(), self.ids.copy()
        used_q, used_x = np.zeros(len(ids), bool), np.zeros(len(self.ids), bool)
        tiles = []
        for a, b in zip(*tk.runs(leader)):
            members = self.group[self.bound[leader[a]] : self.bound[leader[a] + 1]]
            rows = qi[a:b]
            hit = (q[rows] @ own[members].T >= self.cosine) & (ids[rows][:, None] != self.ids[members][None, :])
            count[rows] += hit.sum(1)
            r, c = hit.any(1), hit.any(0)
            if r.any():
                used_q[rows[r]] = used_x[members[c]] = True
                tiles.append((rows[r], members[c], hit[np.ix_(r, c)]))
        far = np.iinfo(np.int64).max
        while True:
            before = low_q.copy(), low_x.copy()
            for rows, members, hit in tiles:
                low_q[rows] = np.minimum(low_q[rows], np.where(hit, low_x[members][None, :], far).min(1))
                low_x[members] = np.minimum(low_x[members], np.where(hit, low_q[rows][:, None], far).min(0))
            if (before[0] == low_q).all() and (before[1] == low_x).all():
                break
        edges = dict(zip(ids[used_q].tolist(), low_q[used_q].tolist()))
        for x, low in zip(self.ids[used_x].tolist(), low_x[used_x].tolist()):
            edges[x] = min(edges.get(x, low), low)
        return count, edges


def _matrix(column, dim: int) -> np.ndarray:
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)


def _build(cosine: float):
    def run(table: pa.Table) -> pa.Table:
        dim = table.column("dim")[0].as_py()
        shard = Shard(table.column("id").to_numpy().copy(), _matrix(table.column("vec"), dim), cosine)
        return pa.table({"label": table.column("label")[:1], "dim": table.column("dim")[:1], "shard": table.column("shard")[:1], "graph": pa.array([shard.pack()], pa.binary())})

    return run


def _block(table: pa.Table) -> pa.Table:
    dim = table.column("dim")[0].as_py()
    blob = table.column("id").to_numpy().tobytes() + _matrix(table.column("vec"), dim).tobytes()
    return pa.table({"label": table.column("label")[:1], "dim": table.column("dim")[:1], "block": table.column("block")[:1], "rows": pa.array([blob], pa.binary())})


def _query(cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, rows, graph in zip(*(batch.column(k) for k in range(3))):
                dim, rows = dim.as_py(), rows.as_py()
                n = len(rows) // (8 + 4 * dim)
                ids = np.frombuffer(rows, np.int64, n).copy()
                shard = Shard.unpack(graph.as_py(), cosine)
                count, edges = shard.links(ids, np.frombuffer(rows, np.float32, n * dim, 8 * n).reshape(n, dim))
                got = dict(zip(ids[count > 0].tolist(), count[count > 0].tolist()))
                keys = list(edges)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([got.get(k, 0) for k in keys], pa.int64()), pa.array(list(edges.values()), pa.int64())], ["id", "n", "low"])

    return run


def embedding_links(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", cosine: float = COSINE) -> DataFrame:
    """One row per vector: id, n_links (other vectors with a cosine of ``cosine`` or more), component_id and kept."""
    spark: SparkSession = vectors.sparkSession
    stash = Stash(spark, "hnsw")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).cast("array<float>").alias("vec")).where("id is not null").dropDuplicates(["id"])
    rows = stash.put(rows)
    fine = F.col("label").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0)
    fine &= F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("vec", lambda x: x != 0)
    good = rows.where(fine).withColumn("dim", F.size("vec"))
    sizes = good.groupBy("label", "dim").agg(F.count("*").alias("n"))
    good = good.join(sizes, ["label", "dim"])
    good = good.withColumn("shard", F.pmod(F.xxhash64("id", F.lit(1)), F.ceil(F.col("n") / SHARD_ROWS)))
    good = good.withColumn("block", F.pmod(F.xxhash64("id", F.lit(2)), F.ceil(F.col("n") / BLOCK_ROWS)))
    graphs = good.groupBy("label", "dim", "shard").applyInArrow(_build(cosine), "label string, dim int, shard long, graph binary")
    blocks = good.groupBy("label", "dim", "block").applyInArrow(_block, "label string, dim int, block long, rows binary")
    pairs = blocks.join(graphs, ["label", "dim"]).repartition("label", "dim", "block", "shard").select("dim", "rows", "graph")
    found = stash.put(pairs.mapInArrow(_query(cosine), "id long, n long, low long"))
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    comp = connected_components(found.select(F.col("id").alias("u"), F.col("low").alias("v")), stash)
    out = rows.select("id").join(counts, "id", "left").join(comp.select(F.col("u").alias("id"), "v"), "id", "left")
    out = out.select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).alias("n_links"), F.coalesce("v", "id").alias("component_id"))
    return out.withColumn("kept", F.col(id_col) == F.col("component_id"))


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_links(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: Brute force over all pairs of a label.
ORACLE_SQL = """
WITH RECURSIVE w AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), v AS (SELECT * FROM (SELECT *, sqrt(list_inner_product(e, e)) AS n FROM w) WHERE n > 0
), l AS (SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.98
), r(u, c) AS (SELECT u, u FROM l UNION SELECT l.v, r.c FROM r JOIN l ON r.u = l.u)
SELECT e.vec_id, coalesce(k, 0) AS n_links, coalesce(c, e.vec_id) AS component_id, coalesce(c, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN (SELECT u, count(*) AS k FROM l GROUP BY u) n ON n.u = e.vec_id LEFT JOIN (SELECT u, min(c) AS c FROM r GROUP BY u) m ON m.u = e.vec_id
"""
