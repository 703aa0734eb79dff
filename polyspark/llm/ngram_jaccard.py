"""N-gram Jaccard join with prefix filters under several global token orders.

A document's set holds its distinct word shingles. Two sets with a Jaccard similarity of t or more share a token among
the first ``n - ceil(t n) + 1`` tokens of each, whatever global order the tokens are put in. Candidates come from a
packed inverted index of the prefixes under the first order (rare tokens first); a candidate must then also share a prefix
token under each of the other orders, and only what passes all of them is verified on the full sets.

Texts travel only for candidates that can still be links. Before that, candidates are tested by sketches: a sketch has a bit for
each cell that an odd number of a set's tokens fall in, so two sets differ by at least as many tokens as their sketches differ by
bits. That bound never drops a link. Of the texts, only those that a bounded bitmap of the wanted ids names are shuffled.

Nothing here makes all pairs of a group. In a group of documents with a common prefix token, each document is first
compared with a leader of fitting size; links are united; only groups that still hold several components go on, and only pairs across
components are compared there, so no link between components is lost and copies are never expanded. Documents that such pairs
connect, by places, sizes and sketches, form a family, whose documents meet in one task; in a family of more than
``MOST_FAMILY`` a few pairs of each two components are verified at first, and more only where these stay apart.

Nulls and edges: a null or empty text has an empty set and no link; null ids are ignored; repeated (id, text) rows count
once; an empty table gives an empty result; other columns of the input are never read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .components import connected_components
from .stash import Stash

SHINGLE = 5
SIMILARITY = (75, 100)
#: Tokens that at least so many documents of one input split hold are summarised for the order.
LOCALLY_COMMON = 3
#: Cells of the summary that tells common tokens from rare ones; this bounds what is sent to the tasks (1 MB).
CELLS = 1 << 20
#: Postings in a bucket of the index, and the most buckets.
BUCKET_POSTINGS, MOST_BUCKETS = 250_000, 1 << 16
#: Groups up to this size are compared fully; larger ones by leader first, then across components.
FULL_GROUP = 8
#: Documents of a family up to which one task compares them; a larger family goes pair by pair, with so many times the pairs each round.
MOST_FAMILY, WIDER = 20_000, 8
#: Cells of the bitmap that tells which texts are wanted; this bounds what is sent to the tasks (4 MB). A clash costs one more text.
WANTED_CELLS = 1 << 25
#: Candidate places of a group, bytes of sketches, bytes of squeezed texts and tokens of kept sets that are taken at once.
PLACES, SKETCH_BYTES, TEXT_BYTES, KEPT_TOKENS = 1 << 20, 16 << 20, 1 << 20, 2_000_000
ORDER_SEEDS = np.array([0x1B873593CC9E2D51, 0x52DCE729A0761D65, 0x38495AB5E7037ED1], dtype=np.uint64)


def prefix_size(n: int, num: int, den: int) -> int:
    """How many leading tokens two similar sets cannot both avoid sharing."""
    return n - -(-num * n // den) + 1


def shingle_sets(buf: np.ndarray, off: np.ndarray, size: int = SHINGLE) -> list[np.ndarray]:
    """For each document the sorted distinct shingle hashes."""
    h, _, _, doc = tk.word_hashes(buf, off, tk.SPACED)
    n_docs = len(off) - 1
    bound = np.searchsorted(doc, np.arange(n_docs + 1))
    slots = tk.SLOT[:size]
    if len(h) >= size:
        rolled = np.zeros(len(h) - size + 1, tk.U)
        for k in range(size):
            rolled += h[k : len(h) - size + 1 + k] * slots[k]
        rolled = tk.mix(rolled)
    out = []
    for d in range(n_docs):
        a, b = bound[d], bound[d + 1]
        if b - a >= size:
            out.append(tk.distinct(rolled[a : b - size + 1]))
        elif b > a:
            out.append(tk.mix(np.array([(h[a:b] * tk.SLOT[8 : 8 + b - a]).sum() + tk.U(b - a)], tk.U)))
        else:
            out.append(np.zeros(0, tk.U))
    return out


def _signature(tokens: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def _levels(tokens: np.ndarray, cells: np.ndarray) -> np.ndarray:
    return cells[(tokens >> tk.U(44)).astype(np.int64)]


def ordered(tokens: np.ndarray, cells: np.ndarray, order: int) -> np.ndarray:
    """The tokens under one global order: common ones last, the rest by an order of its own."""
    key = (_levels(tokens, cells).astype(tk.U) << tk.U(56)) | (tk.mix(tokens ^ ORDER_SEEDS[order]) >> tk.U(8))
    return tokens[np.argsort(key, kind="stable")]


def sketch(tokens: np.ndarray) -> bytes:
    """A bit for each cell that an odd number of tokens fall in; at least as many cells as tokens, and a power of two."""
    cells = 1 << max(6, (len(tokens) - 1).bit_length())
    odd = np.bincount((tokens & tk.U(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


class Sketches:
    """Sketches by place, as one matrix for each length."""

    def __init__(self, values: list[bytes]):
        length = np.array([len(v) for v in values], np.int64)
        self.length, self.row, self.of = length, np.zeros(len(values), np.int64), {}
        for n in np.unique(length).tolist():
            at = np.flatnonzero(length == n)
            self.row[at] = np.arange(len(at))
            self.of[n] = np.frombuffer(b"".join(values[k] for k in at.tolist()), np.uint64).reshape(len(at), -1)

    def apart(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For each pair of places at how many tokens, at least, the two sets differ. A longer sketch is folded to the shorter one's length."""
        out = np.zeros(len(i), np.int64)
        key = self.length[i] << 32 | self.length[j]
        for k in np.unique(key).tolist():
            at = np.flatnonzero(key == k)
            step = max(1, SKETCH_BYTES // max(k >> 32, k & 0xFFFFFFFF))
            for c in range(0, len(at), step):
                some = at[c : c + step]
                a, b = self.of[k >> 32][self.row[i[some]]], self.of[k & 0xFFFFFFFF][self.row[j[some]]]
                while a.shape[1] > b.shape[1]:
                    a = a[:, : a.shape[1] // 2] ^ a[:, a.shape[1] // 2 :]
                while b.shape[1] > a.shape[1]:
                    b = b[:, : b.shape[1] // 2] ^ b[:, b.shape[1] // 2 :]
                out[some] = np.bitwise_count(a ^ b).sum(1)
        return out


def _features(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = np.zeros(0, tk.U), np.zeros(0, np.int64)
        for batch in batches:
            buf, off = tk.column_bytes(batch.column(1))
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            sig, n, drawn, tokens = [], [], [], []
            for i, j in tk.blocks(off):
                sets = shingle_sets(buf[off[i] : off[j]], off[i : j + 1] - off[i], size)
                sig += [_signature(s) for s in sets]
                n += [len(s) for s in sets]
                drawn += [sketch(s) for s in sets]
                tokens.append(np.concatenate(sets))
            if tokens:
                u, c = np.unique(np.concatenate(tokens), return_counts=True)
                keep = c >= 2
                both, counts = np.concatenate([common[0], u[keep]]), np.concatenate([common[1], c[keep]])
                u, back = np.unique(both, return_inverse=True)
                common = u, np.bincount(back, counts, len(u)).astype(np.int64)
            kind = np.zeros(len(ids), np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(ids), pa.array(sig, pa.int64()), pa.array(n, pa.int64()), pa.array(drawn, pa.binary())], ["kind", "id", "sig", "n", "sketch"])
        keep = common[1] >= LOCALLY_COMMON
        cell = (common[0][keep] >> tk.U(44)).astype(np.int64)
        count = common[1][keep]
        if len(cell):
            kind = np.ones(len(cell), np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(common[0][keep].view(np.int64)), pa.array(cell), pa.array(count), pa.nulls(len(cell), pa.binary())], ["kind", "id", "sig", "n", "sketch"])

    return run


def _postings(size: int, cells_of, buckets: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.frombuffer(zstandard.decompress(cells_of.value), np.uint8)
        seen: set[tuple[int, int]] = set()
        held: list[tuple[np.ndarray, ...]] = []
        rows = 0

        def flush():
            return tk.packed_rows(*(lambda c: (c[0], list(c[1:])))([np.concatenate(x) for x in zip(*held)]))

        for batch in batches:
            buf, off = tk.column_bytes(batch.column(1))
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for i, j in tk.blocks(off):
                for d, s in enumerate(shingle_sets(buf[off[i] : off[j]], off[i : j + 1] - off[i], size), i):
                    n = len(s)
                    if not n or (key := (_signature(s), n)) in seen:
                        continue  # a copy within this split is linked by its signature
                    seen.add(key)
                    p = prefix_size(n, num, den)
                    head = tk.mix(ordered(s, cells, 0)[:p])
                    held.append(((head >> tk.U(32)).astype(np.int64) % buckets, head.astype(np.uint32), np.full(p, ids[d], np.int64), np.full(p, n, np.uint32), np.arange(p, dtype=np.uint32)))
                    rows += p
            if rows > 2_000_000:
                yield flush()
                held, rows = [], 0
        if held:
            yield flush()

    return run


CANDIDATE = pa.schema([("x", pa.int64()), ("y", pa.int64()), ("grp", pa.int64()), ("at", pa.int64())])


def _candidates(num: int, den: int):
    def run(table: pa.Table) -> pa.Table:
        parts = [tk.unpack(x.as_py(), [np.uint32, np.int64, np.uint32, np.uint32]) for x in table.column("blob")]
        token, ids, n, at = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(token)
        same = token[order[1:]] == token[order[:-1]]
        order = order[np.append(same, False) | np.append(False, same)]  # a token that one document has links nothing
        order = order[np.lexsort((ids[order], n[order], token[order]))]
        token, ids, n, at = token[order], ids[order], n[order].astype(np.int64), at[order].astype(np.int64)
        a, b = tk.runs(token)
        xs, ys, gs, gd = [], [], [], []

        def fit(i, j):
            """Positions i (smaller set) against j: can they still reach the similarity?"""
            need = -(-num * (n[i] + n[j]) // (num + den))
            return (den * n[i] >= num * n[j]) & (np.minimum(n[i] - at[i], n[j] - at[j]) >= need)

        for k in range(2, FULL_GROUP + 1):
            p, q = (a[b - a == k][:, None] + v for v in np.triu_indices(k, 1))
            p, q = p.ravel(), q.ravel()
            ok = fit(p, q)
            xs.append(p[ok])
            ys.append(q[ok])
        large = b - a > FULL_GROUP
        for i, j in zip(a[large].tolist(), b[large].tolist()):
            gs.append(np.full(j - i, int.from_bytes(hashlib.blake2b(np.sort(ids[i:j]).tobytes(), digest_size=8).digest(), "little", signed=True)))
            gd.append(np.arange(i, j))
            lead = i
            while lead < j - 1:  # each leader takes the sets that its size fits
                upto = i + int(np.searchsorted(n[i:j], den * n[lead] // num, "right"))
                q = np.arange(lead + 1, upto)
                q = q[fit(np.full(len(q), lead), q)]
                xs.append(np.full(len(q), lead))
                ys.append(q)
                lead = max(upto, lead + 1)
        x, y = ids[np.concatenate(xs)], ids[np.concatenate(ys)]
        x, y = np.minimum(x, y), np.maximum(x, y)
        pair = np.stack([x, y], 1)[np.lexsort((y, x))]
        new = np.ones(len(pair), bool)
        new[1:] = (pair[1:] != pair[:-1]).any(1)
        pair = pair[new & (pair[:, 0] != pair[:, 1])]
        g, k = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (gs, gd))
        first = np.lexsort((at[k], ids[k], g))  # a list that several tokens have counts once, with its earliest place
        g, k = g[first], k[first]
        keep = np.ones(len(k), bool)
        keep[1:] = (g[1:] != g[:-1]) | (ids[k[1:]] != ids[k[:-1]])
        g, k = g[keep], k[keep]
        none = pa.nulls(len(pair), pa.int64())
        return pa.concat_tables(
            [
                pa.table({"x": pair[:, 0], "y": pair[:, 1], "grp": none, "at": none}, schema=CANDIDATE),
                pa.table({"x": ids[k], "y": n[k], "grp": g, "at": at[k]}, schema=CANDIDATE),
            ]
        )

    return run


def _apart(i: np.ndarray, j: np.ndarray, n: np.ndarray, drawn: Sketches, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(bits by which the sketches differ, whether the pair can still be a link) of each pair of places."""
    bits = drawn.apart(i, j)
    return bits, (den + num) * bits <= (den - num) * (n[i] + n[j])


def _near(num: int, den: int):
    """The pairs whose sketches do not rule them out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.concatenate([batch.column(c).to_numpy() for c in (2, 4)])
            drawn = Sketches(batch.column(3).to_pylist() + batch.column(5).to_pylist())
            keep = pa.array(_apart(np.arange(len(batch)), np.arange(len(batch), 2 * len(batch)), n, drawn, num, den)[1], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["x", "y"])

    return run


def _across(table: pa.Table, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, bits apart) of the pairs of one group, in blocks of its rows, that lie in different components and that places, sizes
    and sketches let pass; pairs inside a component need no check."""
    n, at, comp, m = (table.column(c).to_numpy() for c in ("n", "at", "comp", "m"))
    drawn = Sketches(table.column("sketch").to_pylist())
    order = np.argsort(n, kind="stable")
    n, rest, comp = n[order], (n - at)[order], comp[order]
    i = 0
    while i < len(n):
        k = min(len(n), i + max(1, PLACES // (len(n) - i)))
        j = int(np.searchsorted(n, den * n[k - 1] // num, "right"))
        p, q = np.arange(i, k)[:, None], np.arange(i, j)[None, :]
        ok = (p < q) & (comp[p] != comp[q]) & (den * n[p] >= num * n[q]) & ((num + den) * np.minimum(rest[p], rest[q]) >= num * (n[p] + n[q]))
        p, q = np.nonzero(ok)
        p, q = order[p + i], order[q + i]
        bits, ok = _apart(p, q, m, drawn, num, den)
        yield p[ok], q[ok], bits[ok]
        i = k


OPEN = "grp long, id long, n long, at long, comp long, m long, sketch binary, head long"


def _open(num: int, den: int):
    """The rows of one group that have open pairs, each with the smallest id that these pairs connect it with."""

    def run(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        tree, live = np.arange(len(ids)), np.zeros(len(ids), bool)
        for p, q, _ in _across(table, num, den):
            live[p] = live[q] = True
            while (apart := tree[p] != tree[q]).any():
                p, q = p[apart], q[apart]
                a, b = tree[p], tree[q]
                np.minimum.at(tree, np.concatenate([a, b]), np.tile(np.minimum(a, b), 2))
                while (tree != tree[tree]).any():
                    tree = tree[tree]
        head = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(head, tree, ids)
        return table.append_column("head", pa.array(head[tree])).filter(pa.array(live))

    return run


def _cross(num: int, den: int, most: int):
    """Of each two components of one group the ``most`` open pairs whose sketches are nearest; a null row says that there are more."""

    def run(table: pa.Table) -> pa.Table:
        ids, comp = table.column("id").to_numpy(), table.column("comp").to_numpy()
        held = np.zeros((0, 5), np.int64)
        more = False
        for p, q, bits in _across(table, num, den):
            low, high = np.minimum(comp[p], comp[q]), np.maximum(comp[p], comp[q])
            held = np.concatenate([held, np.stack([low, high, bits, np.minimum(ids[p], ids[q]), np.maximum(ids[p], ids[q])], 1)])
            held = held[np.lexsort(held.T[::-1])]
            first = np.ones(len(held), bool)
            first[1:] = (held[1:, :2] != held[:-1, :2]).any(1)
            start = np.flatnonzero(first)
            keep = np.arange(len(held)) - np.repeat(start, np.diff(np.append(start, len(held)))) < most
            more |= not keep.all()
            held = held[keep]
        none = [None] * more
        return pa.table({"x": pa.array([*held[:, 3].tolist(), *none], pa.int64()), "y": pa.array([*held[:, 4].tolist(), *none], pa.int64())})

    return run


def _family(size: int, cells_of, num: int, den: int):
    """All open pairs of one family of groups: each document once against its later partners, as marks over token numbers.

    A document's tokens are marked in an array; the partners' marked tokens are summed. The same is done first with the
    prefixes of the other orders, so a pair reaches the exact count only past every filter. United documents are skipped.
    """

    def run(groups: pa.Table, texts: pa.Table) -> pa.Table:
        cells = np.frombuffer(zstandard.decompress(cells_of.value), np.uint8)
        ids, first = np.unique(texts.column("id").to_numpy(), return_index=True)
        comp = texts.column("comp").to_numpy()[first].copy()
        z = texts.column("z")
        sets = []
        for i in first.tolist():
            raw = np.frombuffer(zstandard.decompress(z[i].as_py()), np.uint8)
            sets.append(shingle_sets(raw, np.array([0, len(raw)]), size)[0])
        n = np.array([len(v) for v in sets], np.int64)
        heads = [[ordered(v, cells, o)[: prefix_size(len(v), num, den)] for v in sets] for o in range(1, len(ORDER_SEEDS))]

        def numbered(lists):
            u, back = np.unique(np.concatenate(lists), return_inverse=True)
            start = np.concatenate([[0], np.cumsum([len(v) for v in lists])])
            return back, start, np.zeros(len(u), np.int32)

        layers = [numbered(h) for h in heads] + [numbered(sets)]

        def shared(layer, x, ys):
            back, start, mark = layers[layer]
            own = back[start[x] : start[x + 1]]
            mark[own] = 1
            length = start[ys + 1] - start[ys]
            begin = np.cumsum(length) - length
            at = np.arange(length.sum()) - np.repeat(begin, length) + np.repeat(start[ys], length)
            out = np.add.reduceat(mark[back[at]], begin)
            mark[own] = 0
            return out

        g = groups.column("grp").to_numpy()
        d = np.searchsorted(ids, groups.column("id").to_numpy())
        place = groups.column("at").to_numpy()
        order = np.lexsort((d, g))
        g, d, place = g[order], d[order], place[order]
        a, b = tk.runs(g)
        of_row = np.repeat(np.arange(len(a)), b - a)
        by_doc = np.argsort(d, kind="stable")
        doc_start = np.searchsorted(d[by_doc], np.arange(len(ids) + 1))
        parent = {}

        def root(c):
            while parent.get(c, c) != c:
                parent[c] = parent.get(parent[c], parent[c])
                c = parent[c]
            return c

        us, vs = [], []
        for x in range(len(ids)):
            rows = by_doc[doc_start[x] : doc_start[x + 1]]
            ys = []
            for r in rows.tolist():
                q = np.arange(r + 1, b[of_row[r]])
                least = -(-num * (n[x] + n[d[q]]) // (num + den))
                ys.append(d[q[np.minimum(n[x] - place[r], n[d[q]] - place[q]) >= least]])
            ys = np.unique(np.concatenate(ys)) if ys else np.zeros(0, np.int64)
            ys = ys[(comp[ys] != comp[x]) & (den * np.minimum(n[ys], n[x]) >= num * np.maximum(n[ys], n[x]))]
            own = root(int(comp[x]))
            ys = ys[np.array([root(c) != own for c in comp[ys].tolist()], bool)]
            for layer in range(len(heads)):
                if len(ys):
                    ys = ys[shared(layer, x, ys) > 0]
            if not len(ys):
                continue
            both = shared(len(heads), x, ys)
            for y in ys[den * both >= num * (n[x] + n[ys] - both)].tolist():
                c1, c2 = root(int(comp[x])), root(int(comp[y]))
                if c1 != c2:
                    parent[max(c1, c2)] = min(c1, c2)
                    us.append(int(ids[x]))
                    vs.append(int(ids[y]))
        return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})

    return run


def _squeezed(wanted):
    """Compressed texts of the rows whose cell is in the bitmap of ``wanted``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(zstandard.decompress(wanted.value), np.uint8)
        for batch in batches:
            cell = batch.column(2).to_numpy() - 1
            batch = batch.filter(pa.array(bits[cell >> 3] >> (cell & 7) & 1 > 0, pa.bool_()))
            buf, off = tk.column_bytes(batch.column(1))
            raw = buf.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([zstandard.compress(raw[a:b], 1) for a, b in zip(off[:-1], off[1:])], pa.binary())], ["id", "z"])

    return run


def _texts(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, z): the text, compressed, of every row whose id is in ``ids``, and of few others, which the caller's join leaves out."""
    cell = 1 + F.pmod(F.xxhash64("id"), F.lit(WANTED_CELLS))
    cells = ids.select(cell.alias("cell")).withColumn("part", F.bitmap_bucket_number("cell"))
    cells = cells.repartition("part").groupBy("part").agg(F.bitmap_construct_agg(F.bitmap_bit_position("cell")).alias("bits"))
    bits = np.zeros((WANTED_CELLS >> 15, 1 << 12), np.uint8)
    for part, some in cells.collect():  # WANTED_CELLS bits at most
        bits[part - 1] = np.frombuffer(some, np.uint8)
    wanted = rows.sparkSession.sparkContext.broadcast(zstandard.compress(bits.tobytes()))
    return rows.withColumn("cell", cell).mapInArrow(_squeezed(wanted), "id long, z binary")


def _verify(size: int, cells_of, num: int, den: int):
    """Filters by the remaining orders, then the exact similarity of the full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.frombuffer(zstandard.decompress(cells_of.value), np.uint8)
        kept: dict[bytes, list[np.ndarray]] = {}
        tokens = 0
        for batch in batches:
            upto = np.cumsum(sum(pc.binary_length(batch.column(c)).to_numpy().astype(np.int64) for c in (2, 3)))
            ok: list[bool] = []
            while len(ok) < len(batch):  # so many pairs that their texts stay small
                i = len(ok)
                j = max(i + 1, int(np.searchsorted(upto, TEXT_BYTES + (upto[i - 1] if i else 0), "right")))
                if tokens > KEPT_TOKENS:
                    kept, tokens = {}, 0
                zx, zy = (batch.column(c).slice(i, j - i).to_pylist() for c in (2, 3))
                new = [z for z in dict.fromkeys(zx + zy) if z not in kept]
                raw = [zstandard.decompress(z) for z in new]
                off = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
                buf, done = np.frombuffer(b"".join(raw), np.uint8), 0
                for a, b in tk.blocks(off):
                    for s in shingle_sets(buf[off[a] : off[b]], off[a : b + 1] - off[a], size):
                        kept[new[done]] = prefixes(s, cells, num, den)
                        tokens += len(s)
                        done += 1
                ok += [similar(kept[a], kept[b], num, den) for a, b in zip(zx, zy)]
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["u", "v"])

    return run


def prefixes(tokens: np.ndarray, cells: np.ndarray, num: int, den: int) -> list[np.ndarray]:
    """The prefixes of a set under the orders after the first, and the set; each sorted."""
    return [np.sort(ordered(tokens, cells, o)[: prefix_size(len(tokens), num, den)]) for o in range(1, len(ORDER_SEEDS))] + [tokens]


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    """How many values two sorted lists of distinct values have in common."""
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())


def similar(a: list[np.ndarray], b: list[np.ndarray], num: int, den: int) -> bool:
    """Whether two sets, given by ``prefixes``, pass every order's prefix filter and then the exact test."""
    n, m = len(a[-1]), len(b[-1])
    if not n or not m or den * min(n, m) < num * max(n, m) or not all(_shared(p, q) for p, q in zip(a[:-1], b[:-1])):
        return False
    both = _shared(a[-1], b[-1])
    return den * both >= num * (n + m - both)


def jaccard_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, similarity: tuple[int, int] = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(features, components): id, sig, n of each document; and (u, v) of each document that is not its component's smallest."""
    spark: SparkSession = docs.sparkSession
    num, den = similarity
    stash = Stash(spark, "jaccard")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    first = stash.put(rows.mapInArrow(_features(size), "kind int, id long, sig long, n long, sketch binary"))
    features = first.where("kind = 0").select("id", "sig", "n")
    sketches = first.where("kind = 0 and n > 0").select("id", F.col("n").alias("m"), "sketch")
    cells = np.zeros(CELLS, np.uint8)
    common = first.where("kind = 1").groupBy("id", F.col("sig").alias("cell")).agg(F.sum("n").alias("n")).groupBy("cell").agg(F.max("n").alias("n"))
    for cell, n in common.select("cell", "n").toLocalIterator():  # CELLS rows at most
        cells[cell] = min(255, int(8 * math.log2(n)))
    cells_of = spark.sparkContext.broadcast(zstandard.compress(cells.tobytes()))
    total = features.agg(F.sum("n")).first()[0] or 0
    buckets = max(16, min(MOST_BUCKETS, int(total * (1 - num / den)) // BUCKET_POSTINGS))
    index = rows.mapInArrow(_postings(size, cells_of, buckets, num, den), "bucket long, blob binary")
    found = stash.put(index.groupBy("bucket").applyInArrow(_candidates(num, den), "x long, y long, grp long, at long"))

    def verified(pairs: DataFrame) -> DataFrame:
        # Pairs, texts and components grow with the documents: no side of these joins is ever broadcast.
        texts = _texts(rows, pairs.select(F.explode(F.array("x", "y")).alias("id")))
        full = (
            pairs.hint("merge").join(texts.select(F.col("id").alias("x"), F.col("z").alias("zx")), "x")
            .hint("merge").join(texts.select(F.col("id").alias("y"), F.col("z").alias("zy")), "y")
            .select("x", "y", "zx", "zy")
        )
        return stash.put(full.mapInArrow(_verify(size, cells_of, num, den), "u long, v long"))

    same = features.where("n > 0").groupBy("sig", "n").agg(F.min("id").alias("low"))
    copies = features.where("n > 0").join(same.hint("merge"), ["sig", "n"]).where("id <> low").select(F.col("id").alias("u"), F.col("low").alias("v"))
    pairs = (
        found.where("grp is null").select("x", "y").distinct()
        .hint("merge").join(sketches.select(F.col("id").alias("x"), F.col("m").alias("mx"), F.col("sketch").alias("sx")), "x")
        .hint("merge").join(sketches.select(F.col("id").alias("y"), F.col("m").alias("my"), F.col("sketch").alias("sy")), "y")
        .select("x", "y", "mx", "sx", "my", "sy")
    )
    pairs = stash.put(pairs.mapInArrow(_near(num, den), "x long, y long").distinct())
    links = verified(pairs).unionByName(copies)
    comp = connected_components(links, stash)
    # Groups that still span several components: compare across components only.
    members = found.where("grp is not null").groupBy("grp", F.col("x").alias("id")).agg(F.first("y").alias("n"), F.min("at").alias("at"))
    members = members.join(comp.select(F.col("u").alias("id"), "v").hint("merge"), "id", "left").select("grp", "id", "n", "at", F.coalesce("v", "id").alias("comp"))
    members = stash.put(members)
    several = members.groupBy("grp").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a <> b").select("grp")
    members = members.join(several.hint("merge"), "grp").join(sketches.hint("merge"), "id").select("grp", "id", "n", "at", "comp", "m", "sketch")
    members = stash.put(members.groupBy("grp").applyInArrow(_open(num, den), OPEN))
    if members.isEmpty():
        return features, comp
    family = connected_components(members.select(F.col("id").alias("u"), F.col("head").alias("v")), stash)
    family = family.select(F.col("u").alias("head"), F.col("v").alias("f"))
    members = members.join(family.hint("merge"), "head", "left").withColumn("family", F.coalesce("f", "head")).drop("f", "head")
    wide = members.groupBy("family").agg(F.countDistinct("id").alias("docs")).where(f"docs > {MOST_FAMILY}").select("family")
    members = stash.put(members.join(wide.withColumn("wide", F.lit(True)), "family", "left"))
    narrow = members.where("wide is null").drop("m", "sketch")
    texts = _texts(rows, narrow.select("id")).join(narrow.select("id", F.col("family").alias("of"), "comp").distinct().hint("merge"), "id")
    more = narrow.select("family", "grp", "id", "at").groupBy("family").cogroup(texts.groupBy("of")).applyInArrow(_family(size, cells_of, num, den), "u long, v long")
    comp = connected_components(stash.put(more).unionByName(comp), stash)
    wide = members.where("wide").select("grp", "id", "n", "at", "m", "sketch")
    tried, most = pairs, 1
    while not wide.isEmpty():
        now = wide.join(comp.select(F.col("u").alias("id"), "v").hint("merge"), "id", "left").withColumn("comp", F.coalesce("v", "id")).drop("v")
        now = stash.put(now.groupBy("grp").applyInArrow(_cross(num, den, most), "x long, y long").distinct())
        rest = stash.put(now.where("x is not null").join(tried.hint("merge"), ["x", "y"], "left_anti"))
        if not rest.isEmpty():
            comp = connected_components(verified(rest).unionByName(comp), stash)
            tried = tried.unionByName(rest)
        if now.where("x is null").isEmpty():
            break
        most *= WIDER
    return features, comp


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """One row per document: its id, ``n_shingles`` and ``component_id`` (smallest id reachable by links)."""
    features, comp = jaccard_links(docs, id_col, text_col, size, similarity)
    comp = comp.select(F.col("u").alias("id"), "v")
    return features.join(comp, "id", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("v", "id").alias("component_id"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Brute force over all pairs that share a shingle.
ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 4), ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM d WHERE len(ws) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 75 * (a.n + b.n - k)
), e AS (SELECT x AS u, y AS v FROM l UNION SELECT y, x FROM l
), r(u, c) AS (SELECT u, u FROM e UNION SELECT e.v, r.c FROM r JOIN e ON r.u = e.u)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(c, d.doc_id) AS component_id
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN (SELECT u, min(c) AS c FROM r GROUP BY u) m ON m.u = d.doc_id
"""
