"""Graph operators over an edge table (src, dst[, rel]): plain joins, iterated only where the answer needs it.

Up to ``MOST_SENT`` vertices, iterations send one number for each vertex to the tasks and go over packed edges without a shuffle.
Beyond that they join, and write their frontier to the shared checkpoint folder. Plans stay short and a lost executor costs a re-read.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import stored
from . import packed

#: Vertices for which rounds send a number each to the tasks (8 bytes at most, 128 MB in all); with more, rounds are joins.
MOST_SENT = 1 << 24


def directed(edges: DataFrame, direction: str = "out") -> DataFrame:
    """(src, dst, ...) as seen when walking out, in or both ways; multi-edges are kept."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *(c for c in edges.columns if c not in ("src", "dst")))
    edges = edges.select(back.columns)
    if direction in ("out", "outgoing"):
        return edges
    if direction in ("in", "incoming"):
        return back
    if direction in ("both", "any"):
        return edges.unionByName(back)
    raise ValueError(f"unknown direction: {direction!r}")


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("vertex")).union(edges.select("dst")).distinct()


def neighbors(edges: DataFrame, vertex, direction: str = "out") -> DataFrame:
    return directed(edges, direction).where(F.col("src") == F.lit(vertex)).select(F.col("dst").alias("neighbor"), *(c for c in edges.columns if c == "rel"))


def _reached(state, heads, starts, near):
    """(id, before): who is not seen yet (0) but beside the front (2), with the smallest such neighbour."""
    before = np.minimum.reduceat(np.where(state[near] == 2, near, np.iinfo(np.int32).max), starts)
    new = (before < np.iinfo(np.int32).max) & (state[heads] == 0)
    return heads[new], before[new]


def _walk(rows: DataFrame, start: int, size: int, most: int, until: int = -1):
    """(depth, before) of each vertex number, -1 where none: a round for each step."""
    state, depth, before = np.zeros(size, np.int8), np.full(size, -1, np.int32), np.full(size, np.iinfo(np.int32).max, np.int32)
    state[start], depth[start] = 2, 0
    for d in range(1, most + 1):
        if until >= 0 and depth[until] >= 0:
            break
        ids, least = packed.heard(rows, state, _reached, "id int, before int")
        if not len(ids):
            break
        np.minimum.at(before, ids, least)
        state = np.where(state == 2, np.int8(1), state)
        state[ids], depth[ids] = 2, d
    return depth, before


def bfs(edges: DataFrame, start, depth: int = 10, direction: str = "out") -> DataFrame:
    """(vertex, depth) of everything within ``depth`` steps; an unknown start gives no rows."""
    edges = stored(edges.select("src", "dst"))
    nodes = packed.nodes_of(edges)
    size = nodes.count()
    if size > MOST_SENT or not nodes.where("vertex is null").isEmpty():  # a null end is reached, which packed edges leave out
        return _joined_bfs(edges, start, depth, direction)
    rows, first = packed.packed(edges, nodes, direction), nodes.where(F.col("vertex") == F.lit(start)).first()
    found = _walk(rows, first.id, size, depth)[0] if first else np.full(size, -1, np.int32)
    return packed.with_state(nodes, found, "int").where("value >= 0").withColumnRenamed("value", "depth")


def _joined_bfs(edges: DataFrame, start, depth: int, direction: str) -> DataFrame:
    step = directed(edges, direction).select("src", "dst").distinct()
    kind = edges.schema["src"].dataType
    front = stored(vertices(edges).where(F.col("vertex") == F.lit(start)).select(F.col("vertex").cast(kind), F.lit(0).alias("depth")))
    seen = front  # the union of the steps' own tables: nothing seen is written again
    for d in range(1, depth + 1):
        front = front.select(F.col("vertex").alias("src")).join(step, "src").select(F.col("dst").alias("vertex")).distinct().join(seen, "vertex", "left_anti")
        front = stored(front.withColumn("depth", F.lit(d)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def shortest_path(edges: DataFrame, a, b, direction: str = "both", most: int = 1000) -> DataFrame:
    """(step, vertex) along one shortest path, the one with the smallest predecessors; no rows if there is none."""
    edges = stored(edges.select("src", "dst"))
    nodes = packed.nodes_of(edges)
    size = nodes.count()
    if size > MOST_SENT:
        return _joined_path(edges, a, b, direction, most)
    rows, ends = packed.packed(edges, nodes, direction), [nodes.where(F.col("vertex") == F.lit(v)).first() for v in (a, b)]
    path = []
    if all(ends):
        depth, before = _walk(rows, ends[0].id, size, most, ends[1].id)
        if depth[ends[1].id] >= 0:
            path = [ends[1].id]
            while depth[path[-1]]:
                path.append(int(before[path[-1]]))
    schema = nodes.limit(0).select(F.lit(0).alias("step"), F.col("id").alias("at")).schema
    steps = edges.sparkSession.createDataFrame(list(enumerate(reversed(path))), schema)
    return nodes.join(F.broadcast(steps), F.col("id") == F.col("at")).select("step", "vertex")


def _joined_path(edges: DataFrame, a, b, direction: str, most: int) -> DataFrame:
    step = directed(edges, direction).select("src", "dst").distinct()
    empty = vertices(edges).limit(0).select(F.lit(0).alias("step"), "vertex")
    if vertices(edges).where(F.col("vertex").isin(a, b)).select("vertex").distinct().count() < len({a, b}):
        return empty
    seen = stored(vertices(edges).where(F.col("vertex") == F.lit(a)).select("vertex", F.lit(None).cast(edges.schema["src"].dataType).alias("before"), F.lit(0).alias("depth")))
    front = seen
    for d in range(most):
        if not front.where(F.col("vertex") == F.lit(b)).isEmpty():
            break
        front = front.select(F.col("vertex").alias("src")).join(step, "src").groupBy(F.col("dst").alias("vertex")).agg(F.min("src").alias("before"))
        front = stored(front.join(seen, "vertex", "left_anti").withColumn("depth", F.lit(d + 1)))
        if front.isEmpty():
            return empty
        seen = stored(seen.unionByName(front))
    path, at = [], b
    while at is not None:  # one lookup for each step of the path
        row = seen.where(F.col("vertex") == F.lit(at)).first()
        path.append(row.vertex)
        at = row.before
    rows = [(i, v) for i, v in enumerate(reversed(path))]
    return edges.sparkSession.createDataFrame(rows, empty.schema)


def _least(state, heads, starts, near):
    """The smallest number heard, where it is smaller than one's own."""
    least = np.minimum.reduceat(state[near], starts)
    new = least < state[heads]
    return heads[new], least[new]


def connected_components(edges: DataFrame) -> DataFrame:
    """(vertex, component): weak components, named by their smallest vertex; minimum labels with pointer jumping."""
    edges = stored(edges.select("src", "dst"))
    nodes = packed.nodes_of(edges)
    size = nodes.count()
    if size > MOST_SENT:
        return _joined_components(edges)
    rows, label = packed.packed(edges, nodes, "both"), np.arange(size, dtype=np.int32)
    while True:
        ids, least = packed.heard(rows, label, _least, "id int, least int")
        if not len(ids):
            return packed.named(nodes, label, "component")
        old, label = label, label.copy()
        np.minimum.at(label, ids, least)
        np.minimum.at(label, old[ids], least)  # what named the vertex so far is in the component too
        while not np.array_equal(up := label[label], label):
            label = up


def _joined_components(edges: DataFrame) -> DataFrame:
    both = stored(edges.select("src", "dst").union(edges.select("dst", "src")).where("src <> dst").distinct())
    label = stored(vertices(edges).select("vertex", F.col("vertex").alias("component")))
    while True:
        near = both.join(label.select(F.col("vertex").alias("dst"), "component"), "dst").groupBy(F.col("src").alias("vertex")).agg(F.min("component").alias("c"))
        new = label.join(near, "vertex", "left").select("vertex", F.least("component", "c").alias("c1"))
        jump = new.select(F.col("vertex").alias("c1"), F.col("c1").alias("c2"))
        new = stored(new.join(jump, "c1", "left").select("vertex", F.least("c1", "c2").alias("component")))
        changed = new.join(label.withColumnRenamed("component", "old"), "vertex").where("component <> old").isEmpty()
        label = new
        if changed:
            return label


def _sums(state, heads, starts, near):
    return heads, np.add.reduceat(state[near], starts)


def pagerank(edges: DataFrame, iterations: int = 20, damping: float = 0.85) -> DataFrame:
    """(vertex, score): start 1/n, the mass of vertices without out-edges spread evenly, multi-edges weigh, no early stop."""
    edges = stored(edges.select("src", "dst"))
    nodes = packed.nodes_of(edges)
    n = nodes.count()
    if not n or n > MOST_SENT:
        return _joined_pagerank(edges, iterations, damping)
    rows, deg, score = packed.packed(edges, nodes, "out"), np.zeros(n), np.full(n, 1.0 / n)
    ids, out = packed.columns(nodes.where("deg > 0").select("id", "deg"))
    deg[ids] = out
    for _ in range(iterations):
        got = np.zeros(n)
        ids, sums = packed.heard(rows, score / np.maximum(deg, 1), _sums, "id int, got double")
        np.add.at(got, ids, sums)
        score = (1 - damping) / n + damping * (got + score[deg == 0].sum() / n)
    return packed.with_state(nodes, score, "double").withColumnRenamed("value", "score")


def _joined_pagerank(edges: DataFrame, iterations: int, damping: float) -> DataFrame:
    out = edges.groupBy("src").agg(F.count("*").alias("deg"))
    weighted = stored(edges.groupBy("src", "dst").agg(F.count("*").alias("w")).join(out, "src").select("src", "dst", (F.col("w") / F.col("deg")).alias("share")))
    nodes = stored(vertices(edges).join(out.select(F.col("src").alias("vertex"), F.lit(True).alias("has_out")), "vertex", "left"))
    n = nodes.count()
    if not n:
        return nodes.select("vertex", F.lit(0.0).alias("score"))
    score = nodes.select("vertex", "has_out", F.lit(1.0 / n).alias("score"))
    for i in range(iterations):
        lost = score.where("has_out is null").agg(F.coalesce(F.sum("score"), F.lit(0.0)).alias("lost"))
        given = weighted.join(score.select(F.col("vertex").alias("src"), "score"), "src").groupBy(F.col("dst").alias("vertex")).agg(F.sum(F.col("score") * F.col("share")).alias("got"))
        score = nodes.join(given, "vertex", "left").crossJoin(F.broadcast(lost)).select("vertex", "has_out", ((1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / n)).alias("score"))
        if i % 4 == 3:
            score = stored(score)
    return score.select("vertex", "score")


def triangle_count(edges: DataFrame) -> DataFrame:
    """(vertex, triangles), undirected; edges point from the vertex of fewer ends, which bounds the pairs of hubs, and packed lists of
    neighbours are intersected where they lie in blocks, so pairs of neighbours are never written."""
    edges = stored(edges.select("src", "dst"))
    nodes = packed.nodes_of(edges, ("n", "vertex"))
    size = nodes.count()
    if size >= 1 << 31:
        raise ValueError("vertex numbers of 32 bits do not suffice")
    lists = packed.later_lists(edges, nodes, size <= MOST_SENT)
    n = lists.agg(F.sum(F.octet_length("near") / 4)).first()[0]
    count = packed.triangles(lists, int(n or 0)).groupBy("id").agg(F.sum("n").alias("triangles"))
    return nodes.join(count, "id", "left").select("vertex", F.coalesce("triangles", F.lit(0)).alias("triangles"))


def _votes(state, heads, starts, near):
    """(id, label, n): the first and last vertex of a row, which other rows may go on with, by label; the others with their label and n = 0."""
    k = np.sort(np.repeat(np.arange(len(heads)) << 32, np.diff(np.r_[starts, len(near)])) | state[near])
    at = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    n, k = np.diff(np.r_[at, len(k)]), k[at]
    i, label = k >> 32, k & 0xFFFFFFFF
    first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
    best = np.flatnonzero(n == np.maximum.reduceat(n, first)[i])
    best = best[np.r_[True, i[best][1:] != i[best][:-1]]]  # labels rise: the smallest on a tie
    best = best[(i[best] > 0) & (i[best] < len(heads) - 1)]
    part = np.flatnonzero((i == 0) | (i == len(heads) - 1))
    rows = np.r_[best, part]
    return heads[i[rows]], label[rows].astype(np.int32), np.r_[np.zeros(len(best), np.int64), n[part]]


def label_propagation(edges: DataFrame, iterations: int = 10) -> DataFrame:
    """(vertex, label): each round every vertex takes its neighbours' most frequent label, the smallest on a tie."""
    edges = stored(edges.select("src", "dst"))
    nodes = packed.nodes_of(edges)
    size = nodes.count()
    if size > MOST_SENT:
        return _joined_labels(edges, iterations)
    rows, label = packed.packed(edges, nodes, "both"), np.arange(size)
    for _ in range(iterations):
        told, sent = packed.told(rows, label, _votes, "id int, label int, n long")
        told = stored(told)
        sent.destroy()
        part = told.where("n > 0").groupBy("id", "label").agg(F.sum("n").alias("n")).groupBy("id").agg(F.min(F.struct((-F.col("n")).alias("n"), "label")).alias("b"))
        ids, new = packed.columns(told.where("n = 0").select("id", "label").unionByName(part.select("id", F.col("b.label").alias("label"))))
        label = label.copy()
        label[ids] = new
    return packed.named(nodes, label, "label")


def _joined_labels(edges: DataFrame, iterations: int) -> DataFrame:
    both = stored(edges.select("src", "dst").union(edges.select("dst", "src")))
    label = vertices(edges).select("vertex", F.col("vertex").alias("label"))
    for _ in range(iterations):
        votes = both.join(label.select(F.col("vertex").alias("dst"), "label"), "dst").groupBy(F.col("src").alias("vertex"), "label").agg(F.count("*").alias("n"))
        best = votes.groupBy("vertex").agg(F.min(F.struct((-F.col("n")).alias("n"), "label")).alias("b")).select("vertex", F.col("b.label").alias("new"))
        label = stored(label.join(best, "vertex", "left").select("vertex", F.coalesce("new", "label").alias("label")))
    return label


NODE = re.compile(r"\(\s*(\w+)\s*\)")
HOP = re.compile(r"(<-|-)\s*\[\s*(?::\s*(\w+))?\s*\]\s*(->|-)")


def match_path(edges: DataFrame, pattern: str, returns: list[str], where: dict | None = None) -> DataFrame:
    """``(a)-[:R]->(b)<-[:S]-(c)`` as one join per hop; edges and vertices may repeat."""
    pattern = pattern.strip()
    m = NODE.match(pattern)
    if not m:
        raise ValueError("a pattern begins with a node")
    names, hops, at = [m[1]], [], m.end()
    while at < len(pattern):
        h = HOP.match(pattern[at:].lstrip())
        at += len(pattern[at:]) - len(pattern[at:].lstrip())
        if not h or (h[1] == "<-") == (h[3] == "->"):
            raise ValueError(f"no hop at {pattern[at:]!r}")
        at += h.end()
        n = NODE.match(pattern[at:])
        if not n:
            raise ValueError("a hop ends with a node")
        at += n.end()
        names.append(n[1])
        hops.append((h[2], h[1] == "<-"))
    rows = None
    for k, (rel, back) in enumerate(hops):
        e = edges if rel is None else edges.where(F.col("rel") == rel)
        a, b = ("dst", "src") if back else ("src", "dst")
        e = e.select(F.col(a).alias(f"_{k}"), F.col(b).alias(f"_{k + 1}"))
        for j in (k, k + 1):
            if where and names[j] in where:
                e = e.where(F.col(f"_{j}") == F.lit(where[names[j]]))
        rows = e if rows is None else rows.join(e, f"_{k}")
        same = [j for j in range(k + 1) if names[j] == names[k + 1]]
        for j in same:
            rows = rows.where(F.col(f"_{j}") == F.col(f"_{k + 1}"))
    if rows is None:
        rows = vertices(edges).select(F.col("vertex").alias("_0"))
        if where and names[0] in where:
            rows = rows.where(F.col("_0") == F.lit(where[names[0]]))
    return rows.select(*(F.col(f"_{names.index(r)}").alias(r) for r in returns))


def related(facts: dict[str, DataFrame], links: list[tuple[str, str, str, str]], table: str, key: str, value, depth: int = 2, limit: int = 100) -> DataFrame:
    """Rows reachable over declared links (table, column, other table, other column) as (depth, table, row JSON)."""
    start = facts[table].where(F.col(key) == F.lit(value))
    found, front = [start.select(F.lit(0).alias("depth"), F.lit(table).alias("table"), F.to_json(F.struct("*")).alias("row"))], [(table, start)]
    for d in range(1, min(depth, 2) + 1):
        nxt = []
        for name, rows in front:
            for t, c, o, oc in links:
                for here, hc, there, tc in ((t, c, o, oc), (o, oc, t, c)):
                    if here == name:
                        keys = rows.select(F.col(hc).alias("_k")).distinct()
                        got = facts[there].join(keys, F.col(tc) == F.col("_k"), "left_semi")
                        nxt.append((there, got))
                        found.append(got.select(F.lit(d).alias("depth"), F.lit(there).alias("table"), F.to_json(F.struct("*")).alias("row")))
        front = nxt
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.distinct().orderBy("depth", "table", "row").limit(limit)
