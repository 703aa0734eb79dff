"""Exact substring dedup: run-length Burrows-Wheeler indexes over the repeated parts of a corpus.

A string of ``LENGTH`` bytes is removed wherever it also starts in a document with a smaller id. Building one suffix array
of everything would be a job for one machine, so the work is split by content: every window of LENGTH bytes has an anchor,
the least-hashed 16-byte string in it, and equal windows have equal anchors at equal places, in whatever document they
stand. The windows of one anchor occurrence make a context, one stretch of bytes. Three rounds, all of them hash-partitioned:

1. Documents are packed (a few MB a row). Each pack sends its anchor hashes, sorted and delta-packed; anchors that no second
   document has end here, and with them all text that occurs once.
2. Contexts of the remaining anchors go to buckets by anchor. Equal contexts within a pack are settled on the spot, so
   of a group of copies each pack sends one.
3. Each bucket rules out contexts that share too little around their anchor to have a window in common, numbers the documents
   of an anchor and pairs neighbouring ranges of them, of 1, 2, 4, ... documents. The lower ranges go into a run-compressed
   Burrows-Wheeler index with the text positions at run ends sampled; the contexts of the upper ranges stream their matching
   statistics over its runs, and every place with LENGTH or more is marked. Marked ends of contexts stay out of wider ranges.

Marks return to their packs, where spans are united and cut out.

Nulls and edges: a null text counts as empty; texts under LENGTH bytes have no window; a document never matches itself,
also when its (id, text) row is repeated; rows with a null id get no marks and give none; texts of any length are read
whole; an empty table gives an empty result; other columns of the input are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .stash import Stash

LENGTH = 50
ANCHOR = 16
PACK_BYTES = 4 << 20
#: Bytes of documents that are scanned at once, so that the arrays of a scan stay in the processor's cache.
SCAN_BYTES = 256 << 10
#: Bytes of contexts in one index (more only where one anchor has more).
INDEX_BYTES = 2 << 20
#: Kinds of windows, by the place of their anchor, whose common bytes are compared before the index; an anchor of more
#: than HOT distinct contexts has as many kinds as windows.
CORES, HOT = 3, 32
#: Packs for each bucket, and the most buckets.
PACKS_A_BUCKET, MOST_BUCKETS = 3, 4096


def _sliding(f, a: np.ndarray, size: int) -> np.ndarray:
    """f (minimum or maximum) of each ``size`` neighbours, by doubling."""
    width = 1
    while width * 2 <= size:
        a = f(a[:-width], a[width:])
        width *= 2
    return f(a[: len(a) - (size - width)], a[size - width :]) if size > width else a


class Contexts:
    """Anchored contexts of the windows of a few concatenated documents."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, length: int = LENGTH):
        z = np.zeros(0, np.int64)
        self.length, self.buf, self.x = length, buf, None
        self.p0, self.p1, self.q, self.doc, self.key = z, z, z, z, np.zeros(0, tk.U)
        if len(buf) < length or not (np.diff(off) >= length).any():
            return
        x = self.x = tk.loads(buf)
        h = x[:-8] * tk.SLOT[20]
        h += x[8:] * tk.SLOT[21]
        h ^= h >> tk.U(32)
        h *= tk.STEP
        h ^= h >> tk.U(29)
        w = length - ANCHOR + 1
        m = _sliding(np.minimum, h, w)
        pad = np.zeros(w - 1, tk.U)
        q = np.flatnonzero(h == _sliding(np.maximum, np.concatenate([pad, m, pad]), w))
        # An anchor takes over when it enters the windows, if it is smaller than the one before, else when that one leaves.
        key = h[q]
        start = np.zeros(len(q), np.int64)
        start[1:] = np.where(key[1:] < key[:-1], q[1:] - w + 1, q[:-1] + 1)
        np.maximum(start, 0, out=start)
        stop = np.append(start[1:] - 1, len(buf) - length)
        stop = np.minimum(stop, q)
        # Windows that would run over a document's end belong to no context; a context lies in one document.
        doc = np.searchsorted(off, start, "right") - 1
        late = start > off[doc + 1] - length
        long = np.append(np.flatnonzero(np.diff(off) >= length), len(off) - 2)
        after = long[np.minimum(np.searchsorted(long, doc, "right"), len(long) - 1)]
        start, doc = np.where(late, np.maximum(off[after], start), start), np.where(late, after, doc)
        stop = np.minimum(stop, off[doc + 1] - length)
        fine = start <= stop
        self.p0, self.p1, self.q, self.key, self.doc = start[fine], stop[fine], q[fine], key[fine], doc[fine]

    def window_hash(self, p: np.ndarray) -> np.ndarray:
        out = np.zeros(len(p), tk.U)
        for k, o in enumerate([*range(0, self.length - 8, 8), self.length - 8]):
            out += tk.mix(self.x[p + o] * tk.SLOT[24 + k])
        return out

    def content(self, i: np.ndarray) -> np.ndarray:
        """A hash of the bytes of contexts: first and last window together cover them."""
        size = (self.p1[i] - self.p0[i]).astype(tk.U)
        return tk.mix(self.window_hash(self.p0[i]) * tk.SLOT[22] + self.window_hash(self.p1[i]) * tk.SLOT[23] + size)

    def bytes_of(self, i: np.ndarray) -> np.ndarray:
        size = self.p1[i] - self.p0[i] + self.length
        first = np.cumsum(size) - size
        return self.buf[np.arange(size.sum()) - np.repeat(first, size) + np.repeat(self.p0[i], size)]


def _strings(text: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, starts) of the strings laid out anew, each with one byte of room for its terminator."""
    start = np.cumsum(size + 1) - (size + 1)
    out = np.zeros(int((size + 1).sum()) + 16, np.uint8)
    run = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    out[run + np.repeat(start, size)] = text[run + np.repeat(first, size)]
    return out, start


def _by(key: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(at, key) by key, then at; as one sort of single numbers where both fit into them."""
    bits = int(at.max(initial=0)).bit_length()
    if int(key.max(initial=0)).bit_length() + bits < 64:
        both = np.sort(key << bits | at)
        return both & (1 << bits) - 1, both >> bits
    order = np.lexsort((at, key))
    return at[order], key[order]


class RunLengthIndex:
    """Run-compressed Burrows-Wheeler transform of strings in groups, with the text positions at the ends of every run.

    Rows are all suffixes, by group, then by bytes, a terminator below every byte, then by string. A symbol is a group and
    a byte, so a search for a text never leaves its group. Kept are the runs, by symbol and row: first row, end, the row to
    which a backward step leads, and the samples; the suffix order itself is not.
    """

    def __init__(self, text: np.ndarray, first: np.ndarray, size: np.ndarray, group: np.ndarray):
        self.text, start = _strings(text, first, size)
        self.words = tk.loads(self.text).byteswap()
        string = np.repeat(np.arange(len(size)), size + 1)
        n = len(string)
        self.left = np.repeat(start + size, size + 1) - np.arange(n)
        of = group[string]
        sa, _ = _by(of << n.bit_length() | self._ranks(int(size.max(initial=0))), np.arange(n))
        before = np.where(sa > start[string[sa]], self.text[sa - 1].astype(np.int64) + 1, 0)
        symbol = of[sa] * 257 + before
        head, end = tk.runs(symbol)
        by = np.argsort(symbol[head], kind="stable")
        self.rows, self.first, self.end, self.symbol = n, head[by], end[by], symbol[head[by]]
        self.head_sample, self.end_sample = sa[self.first], sa[self.end - 1]
        length = self.end - self.first
        self.step = np.cumsum(length) - length
        self.key = self.symbol * (n + 1) + self.first
        self.top = sa[0]
        # The run that each row lies in, so that a step within a run needs no search.
        run = np.empty(len(by), np.int32)
        run[by] = np.arange(len(by), dtype=np.int32)
        self.run = np.repeat(run, end - head)

    def _ranks(self, longest: int) -> np.ndarray:
        """Order of all suffixes up to their terminators, by doubling; a rank that no other suffix has stays."""
        n, left = len(self.left), self.left
        bits = n.bit_length()
        width = max((60 - bits) // 8, 1)
        inside = np.minimum(left, width)
        room = (8 * (width - inside)).astype(tk.U)
        word = (self.words[:n] >> tk.U(64 - 8 * width) >> room << room).astype(np.int64)
        at, key = _by(word << 3 | inside, np.arange(n))
        old, rank = np.zeros(n, np.int64), np.zeros(n, np.int64)
        while True:
            a, b = tk.runs(key)
            c, d = tk.runs(old)
            rank[at] = old + np.repeat(a, b - a) - np.repeat(c, d - c)
            at = at[np.repeat(b - a > 1, b - a) & (left[at] >= width)]
            if width >= longest or not len(at):
                return rank
            at, key = _by(rank[at] << bits | rank[at + width], at)
            old = key >> bits
            width *= 2

    def _common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many bytes the suffixes at a and b share, ``most`` at most; the suffix at a has ``most``."""
        most = np.minimum(most, self.left[b])
        out = np.zeros(len(a), np.int64)
        live = np.flatnonzero(most > 0)
        while len(live):
            x = self.words[a[live] + out[live]] ^ self.words[b[live] + out[live]]
            same = np.zeros(len(live), np.int8)
            for k in range(56, -1, -8):
                same += x < tk.U(1 << k)
            out[live] += same
            live = live[(same == 8) & (out[live] < most[live])]
        return np.minimum(out, most)

    def matching_statistics(self, text: np.ndarray, first: np.ndarray, size: np.ndarray, group: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Streams (place, patterns, lengths) from the last place to the first: how long a match with the group starts there.

        Each pattern keeps a row whose suffix matches longest, and that suffix's text position. A byte that the transform
        has in that row is a backward step; else the row moves to the nearest run of the byte above or below, whichever
        sample shares more bytes with the match so far. All patterns take their steps together.
        """
        order = np.argsort(-size, kind="stable")  # so that the patterns that reach a place are the first ones
        first, base, reach = first[order], group[order] * 257 + 1, -size[order]
        m, last = len(size), len(self.key) - 1
        row, at, long = np.zeros(m, np.int64), np.full(m, self.top), np.zeros(m, np.int64)
        for place in range(int(size.max(initial=0)) - 1, -1, -1):
            n = int(np.searchsorted(reach, -place))
            want = base[:n] + text[first[:n] + place]
            r = self.run[row[:n]]
            p = np.flatnonzero(self.symbol[r] != want)
            if len(p):
                k = np.searchsorted(self.key, want[p] * (self.rows + 1) + row[p], "right") - 1
            row[:n] += self.step[r] - self.first[r]
            at[:n] -= 1
            if len(p):
                up, down, match = np.maximum(k, 0), np.minimum(k + 1, last), long[p]
                above = (k >= 0) & (self.symbol[up] == want[p])
                has_down = (k < last) & (self.symbol[down] == want[p])
                n_up, n_down = np.where(above, 0, -1), np.where(has_down, 0, -1)
                q = np.flatnonzero(above & (match > 0))
                n_up[q] = self._common(at[p[q]] + 1, self.end_sample[up[q]], match[q])
                q = np.flatnonzero(has_down & (match > np.maximum(n_up, 0)))
                n_down[q] = self._common(at[p[q]] + 1, self.head_sample[down[q]], match[q])
                upward, best = n_up >= n_down, np.maximum(n_up, n_down)
                r, found = np.where(upward, up, down), best >= 0
                row[p] = np.where(found, self.step[r] + np.where(upward, self.end[r] - 1 - self.first[r], 0), 0)
                at[p] = np.where(found, np.where(upward, self.end_sample[r], self.head_sample[r]) - 1, self.top)
                long[p] = best
            long[:n] += 1
            yield place, order[:n], long[:n]


def earlier_matches(text: np.ndarray, first: np.ndarray, size: np.ndarray, doc: np.ndarray, key: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(string, place), sorted: where ``length`` bytes start that also stand in a string of the same key and a smaller document.

    Documents of a key are numbered, and pairs of neighbouring ranges of 1, 2, 4, ... of them give a group each: the lower
    range is indexed and the upper one streamed against it. Any two documents of a key meet in exactly one group. Windows that
    were found are left out of later groups at the ends of their strings: the first document that has them stays in.
    """
    order = np.lexsort((doc, key))
    new = np.ones(len(key), bool)
    new[1:] = (key[order][1:] != key[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    number = np.cumsum(new) - 1
    a, b = tk.runs(key[order])
    rank, of = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
    rank[order] = number - np.repeat(number[a], b - a)
    of[order] = np.repeat(np.arange(len(a)), b - a)
    windows = np.maximum(size - length + 1, 0)
    base, string = np.cumsum(windows) - windows, np.repeat(np.arange(len(size)), windows)
    found = np.zeros(len(string), bool)
    for level in range(int(rank.max(initial=0)).bit_length()):
        left = np.flatnonzero(~found)
        a, b = tk.runs(string[left])
        k = string[left[a]]
        shift = left[a] - base[k]
        start, bytes_left = first[k] + shift, left[b - 1] - left[a] + length
        upper = (rank[k] >> level) & 1 == 1
        _, group = np.unique(of[k] * (rank.max() + 1) + (rank[k] >> (level + 1)), return_inverse=True)
        lower, paired = np.zeros(group.max(initial=-1) + 1, bool), np.zeros(group.max(initial=-1) + 1, bool)
        lower[group[~upper]] = True
        paired[group[upper]] = True
        at, both = base[k] + shift, lower & paired
        # Groups of a level that are far larger than an index should be go one stretch after another.
        stretch = (np.cumsum(np.where(both, np.bincount(group, bytes_left), 0)) // (2 * INDEX_BYTES)).astype(np.int64)[group]
        for s in np.unique(stretch[both[group]]):
            here = both[group] & (stretch == s)
            low, up = np.flatnonzero(here & ~upper), np.flatnonzero(here & upper)
            index = RunLengthIndex(text, start[low], bytes_left[low], group[low])
            for place, live, long in index.matching_statistics(text, start[up], bytes_left[up], group[up]):
                found[at[up[live[long >= length]]] + place] = True
    here = np.flatnonzero(found)
    return string[here], here - base[string[here]]


def shared_windows(text: np.ndarray, first: np.ndarray, count: np.ndarray, anchor: np.ndarray, key: np.ndarray, doc: np.ndarray, cores: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, window, windows): contexts that may share a window with another document, from the first such window to the last.

    Equal windows hold their anchor at equal places, so windows with i to j bytes before it are equal only if the bytes that
    all of these hold, the core, are. A window is ruled out if no other document has its core; equal hashes rule none out.
    The places are dealt to ``cores`` ranges i to j.
    """
    x = tk.loads(np.concatenate([text, np.zeros(8, np.uint8)]))
    low, high = np.full(len(key), LENGTH), np.full(len(key), -1)
    for cut in np.array_split(np.arange(LENGTH - ANCHOR + 1), cores):
        i, j = int(cut[0]), int(cut[-1])
        k = np.flatnonzero((anchor >= i) & (anchor - count < j))
        size, at = LENGTH - (j - i), first[k] + anchor[k] - i
        core = key[k].copy()
        for n, o in enumerate([*range(0, size - 8, 8), size - 8]):
            core += tk.mix(x[at + o] * tk.SLOT[24 + n])
        order = np.argsort(core)
        a, b = tk.runs(core[order])
        who = doc[k][order]
        several = np.minimum.reduceat(who, a) < np.maximum.reduceat(who, a) if len(a) else np.zeros(0, bool)
        k = k[order[np.repeat(several, b - a)]]
        low[k] = np.minimum(low[k], np.maximum(anchor[k] - j, 0))
        high[k] = np.maximum(high[k], np.minimum(anchor[k] - i, count[k] - 1))
    k = np.flatnonzero(high >= 0)
    return k, low[k], high[k] - low[k] + 1


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids, parts, held = [], [], 0

    def row():
        raw = b"".join(parts)
        off = np.cumsum([0] + [len(p) for p in parts])
        return pa.RecordBatch.from_arrays([pa.array([len(ids)], pa.int64()), pa.array([zstandard.compress(np.array(ids, np.int64).tobytes() + off.astype(np.int64).tobytes() + raw, 3)], pa.binary())], ["docs", "data"])

    for batch in batches:
        buf, off = tk.column_bytes(batch.column(1))
        raw = buf.tobytes()
        for i, a, b in zip(batch.column(0).to_pylist(), off[:-1].tolist(), off[1:].tolist()):
            ids.append(i)
            parts.append(raw[a:b])
            held += b - a
            if held >= PACK_BYTES:
                yield row()
                ids, parts, held = [], [], 0
    if ids:
        yield row()


def _open(docs: int, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = zstandard.decompress(data)
    return np.frombuffer(raw, np.int64, docs), np.frombuffer(raw, np.int64, docs + 1, 8 * docs), np.frombuffer(raw, np.uint8, -1, 16 * docs + 8)


def _anchor_lists(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pack, docs, data in zip(*(batch.column(k).to_pylist() for k in range(3))):
                ids, off, buf = _open(docs, data)
                keys = [c.key >> tk.U(16) for i, j in tk.blocks(off, SCAN_BYTES) for c in [Contexts(buf[off[i] : off[j]], off[i : j + 1] - off[i])]]
                key = tk.distinct(np.concatenate(keys)) if keys else np.zeros(0, tk.U)
                if not len(key):
                    continue
                home = (key >> tk.U(36)).astype(np.int64) % buckets  # key has 48 bits
                order = np.argsort(home, kind="stable")
                key, home = key[order], home[order]
                a, b = tk.runs(home)
                blobs = []
                for i, j in zip(a, b):
                    delta = np.diff(key[i:j], prepend=tk.U(0)).astype(tk.U)
                    planes = delta.view(np.uint8).reshape(-1, 8)[:, :6].T
                    blobs.append(np.int64(j - i).tobytes() + zstandard.compress(np.ascontiguousarray(planes).tobytes(), 1))
                yield pa.RecordBatch.from_arrays([pa.array(home[a]), pa.array([pack] * len(a), pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "pack", "blob"])

    return run


def _unlist(blob: bytes) -> np.ndarray:
    n = int(np.frombuffer(blob, np.int64, 1)[0])
    delta = np.zeros((n, 8), np.uint8)
    delta[:, :6] = np.frombuffer(zstandard.decompress(blob[8:]), np.uint8).reshape(6, n).T
    return np.cumsum(delta.view(tk.U).ravel(), dtype=tk.U)


def _repeated(table: pa.Table) -> pa.Table:
    """For each pack the anchors of one bucket that another pack has too, as a bit for each anchor it sent."""
    packs = table.column("pack").to_pylist()
    lists = [_unlist(b.as_py()) for b in table.column("blob")]
    u, count = np.unique(np.concatenate(lists), return_counts=True)
    shared = u[count > 1]
    out = []
    for k in lists:
        at = np.minimum(np.searchsorted(shared, k), max(len(shared) - 1, 0))
        out.append(np.packbits(shared[at] == k).tobytes() if len(shared) else bytes(-(-len(k) // 8)))
    return pa.table({"pack": pa.array(packs, pa.int64()), "bucket": table.column("bucket"), "bits": pa.array([zstandard.compress(x, 1) for x in out], pa.binary())})


CONTEXT_TYPES = [tk.U, tk.U, np.int64, np.int64, np.int32, np.int32, np.uint8, np.uint8]


def _contexts(buckets: int):
    """Rows (kind, bucket, pack, blob): 0 contexts of repeated anchors by bucket, 1 spans that the pack itself settles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pack, docs, data, bits in zip(*(batch.column(k).to_pylist() for k in range(4))):
                ids, off, buf = _open(docs, data)
                key, content, doc, p0, anchor, count, raw = [], [], [], [], [], [], []
                found = []
                for i, j in tk.blocks(off, SCAN_BYTES):
                    found.append((i, off[i], Contexts(buf[off[i] : off[j]], off[i : j + 1] - off[i])))
                if not found:
                    continue
                every = np.concatenate([c.key >> tk.U(16) for _, _, c in found])
                own = np.concatenate([c.doc + i for i, _, c in found])
                sent = tk.distinct(every)
                home = (sent >> tk.U(36)).astype(np.int64) % buckets
                shared = np.zeros(len(sent), bool)
                for b in bits or []:
                    at = np.flatnonzero(home == b["bucket"])
                    shared[at] = np.unpackbits(np.frombuffer(zstandard.decompress(b["bits"]), np.uint8), count=len(at)).astype(bool)
                place = np.searchsorted(sent, every)
                low, high = np.full(len(sent), len(ids)), np.full(len(sent), -1)
                np.minimum.at(low, place, own)
                np.maximum.at(high, place, own)
                use = (shared | (low < high))[place]
                at = 0
                for i, base, c in found:
                    k = np.flatnonzero(use[at : at + len(c.key)])
                    at += len(c.key)
                    if not len(k):
                        continue
                    key.append(c.key[k])
                    content.append(c.content(k))
                    doc.append(c.doc[k] + i)
                    p0.append(c.p0[k] + base)
                    anchor.append(c.q[k] - c.p0[k])
                    count.append(c.p1[k] - c.p0[k] + 1)
                if not key:
                    continue
                key, content, doc, p0, anchor, count = (np.concatenate(x) for x in (key, content, doc, p0, anchor, count))
                ident = ids[doc]
                order = np.lexsort((ident, content, key))
                key, content, doc, p0, anchor, count, ident = (x[order] for x in (key, content, doc, p0, anchor, count, ident))
                new = np.ones(len(key), bool)
                new[1:] = (key[1:] != key[:-1]) | (content[1:] != content[:-1])
                least = ident[np.flatnonzero(new)][np.cumsum(new) - 1]
                copy = ident > least
                local = p0 - off[doc]
                if copy.any():
                    yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), pa.array([pack % buckets], pa.int64()), pa.array([pack], pa.int64()), pa.array([tk.pack([doc[copy].astype(np.int32), local[copy].astype(np.int32), count[copy].astype(np.uint8)])], pa.binary())], ["kind", "bucket", "pack", "blob"])
                k = np.flatnonzero(~copy)
                goes = ((key[k] >> tk.U(16)) % tk.U(buckets)).astype(np.int64)
                k = k[np.argsort(goes, kind="stable")]
                goes = np.sort(goes, kind="stable")
                a, b = tk.runs(goes)
                blobs = []
                for s, e in zip(a, b):
                    r = k[s:e]
                    size = count[r].astype(np.int64) + LENGTH - 1
                    first = np.cumsum(size) - size
                    text = buf[np.arange(size.sum()) - np.repeat(first, size) + np.repeat(p0[r], size)]
                    head = tk.pack([key[r], content[r], ident[r], np.full(len(r), pack, np.int64), doc[r].astype(np.int32), local[r].astype(np.int32), anchor[r].astype(np.uint8), count[r].astype(np.uint8)])
                    blobs.append(np.int64(len(head)).tobytes() + head + zstandard.compress(text.tobytes(), 1))
                yield pa.RecordBatch.from_arrays([pa.array([0] * len(a), pa.int32()), pa.array(goes[a]), pa.array([pack] * len(a), pa.int64()), pa.array(blobs, pa.binary())], ["kind", "bucket", "pack", "blob"])

    return run


def _slices(key: np.ndarray, size: np.ndarray) -> Iterator[slice]:
    """Stretches of sorted anchors with about INDEX_BYTES of contexts; an anchor's contexts stay together."""
    a, b = tk.runs(key)
    total = np.cumsum(size)
    at = 0
    while at < len(key):
        least = total[at - 1] if at else 0
        k = int(np.searchsorted(total, least + INDEX_BYTES, "right"))
        k = int(b[min(np.searchsorted(b, max(k, at + 1), "left"), len(b) - 1)])
        yield slice(at, k)
        at = k


def _mark(table: pa.Table) -> pa.Table:
    """Spans of one bucket's contexts that documents with smaller ids have, by pack."""
    kind = table.column("kind").to_numpy()
    settled = table.filter(pa.array(kind == 1)).select(["pack", "blob"])
    cols, texts = [], []
    for b in table.column("blob").filter(pa.array(kind == 0)):
        b = b.as_py()
        n = int(np.frombuffer(b, np.int64, 1)[0])
        cols.append(tk.unpack(b[8 : 8 + n], CONTEXT_TYPES))
        texts.append(np.frombuffer(zstandard.decompress(b[8 + n :]), np.uint8))
    if not cols:
        return settled
    key, content, ident, pack, doc, local, anchor, count = (np.concatenate(x) for x in zip(*cols))
    text = np.concatenate(texts)
    size = count.astype(np.int64) + LENGTH - 1
    first = np.cumsum(size) - size
    order = np.lexsort((ident, content, key))
    key, content, ident = key[order], content[order], ident[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (content[1:] != content[:-1])
    group = np.cumsum(new) - 1
    head = np.flatnonzero(new)
    whole = ident > ident[head][group]
    spans = [(order[whole], np.zeros(whole.sum(), np.int64), count[order[whole]].astype(np.int64))]
    # Anchors that several distinct contexts have: their windows go through the index.
    a, b = tk.runs(key[head])
    several = np.repeat(b - a > 1, b - a)
    rep = head[several]
    members = np.flatnonzero(~whole)
    m_group = group[members]
    for part in _slices(key[rep], size[order[rep]]):
        own = rep[part]
        src = order[own]
        own_text = text[tk.spread(first[src], size[src])]
        start, windows, before = np.cumsum(size[src]) - size[src], count[src].astype(np.int64), anchor[src].astype(np.int64)
        a, b = tk.runs(key[own])
        hot = np.repeat(b - a > HOT, b - a)
        kept = []
        for pick, cores in ((np.flatnonzero(~hot), CORES), (np.flatnonzero(hot), LENGTH - ANCHOR + 1)):
            k, shift, n = shared_windows(own_text, start[pick], windows[pick], before[pick], key[own][pick], ident[own][pick], cores)
            kept.append((pick[k], shift, n))
        k, shift, n = (np.concatenate(x) for x in zip(*kept))
        own = own[k]
        o, at = earlier_matches(own_text, start[k] + shift, n + LENGTH - 1, ident[own], key[own], LENGTH)
        at += shift[o]
        if not len(at):
            continue
        cut = np.flatnonzero((at[1:] != at[:-1] + 1) | (o[1:] != o[:-1])) + 1
        s, e = np.concatenate([[0], cut]), np.concatenate([cut, [len(at)]]) - 1
        o, lo, hi = o[s], at[s], at[e] + 1
        # The context's other occurrences in its own document share the marks; those in larger documents are whole already.
        g = group[own][o]
        i, j = np.searchsorted(m_group, g, "left"), np.searchsorted(m_group, g, "right")
        reps = j - i
        which = np.repeat(np.arange(len(g)), reps)
        pos = members[np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps) + np.repeat(i, reps)]
        spans.append((order[pos], lo[which], (hi - lo)[which]))
    row, shift, n = (np.concatenate(x) for x in zip(*spans))
    by = np.argsort(pack[row], kind="stable")
    row, shift, n = row[by], shift[by], n[by]
    a, b = tk.runs(pack[row])
    blobs = [tk.pack([doc[row[i:j]], (local[row[i:j]] + shift[i:j]).astype(np.int32), n[i:j].astype(np.uint8)]) for i, j in zip(a, b)]
    return pa.concat_tables([settled, pa.table({"pack": pa.array(pack[row[a]], pa.int64()), "blob": pa.array(blobs, pa.binary())})])


def _cut(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for docs, data, blobs in zip(*(batch.column(k).to_pylist() for k in range(3))):
                ids, off, buf = _open(docs, data)
                gone = np.zeros(len(buf) + 1, np.int32)
                for blob in blobs or []:
                    doc, start, n = tk.unpack(blob, [np.int32, np.int32, np.uint8])
                    at = off[doc] + start
                    np.add.at(gone, at, 1)
                    np.add.at(gone, at + n.astype(np.int64) + LENGTH - 1, -1)
                gone = np.cumsum(gone[:-1]) > 0
                begins = gone.copy()
                begins[1:] &= ~gone[:-1]
                inner = off[:-1][off[:-1] < len(buf)]
                begins[inner] = gone[inner]
                removed, spans = np.concatenate([[0], np.cumsum(gone)]), np.concatenate([[0], np.cumsum(begins)])
                sha, text = [], []
                raw = buf.tobytes()
                for d in range(docs):
                    a, b = off[d], off[d + 1]
                    left = raw[a:b] if removed[a] == removed[b] else buf[a:b][~gone[a:b]].tobytes()
                    sha.append(hashlib.sha256(left).hexdigest())
                    if with_text:
                        text.append(left)
                columns = [pa.array(ids), pa.array(np.diff(off)), pa.array(removed[off[1:]] - removed[off[:-1]]), pa.array(spans[off[1:]] - spans[off[:-1]]), pa.array(sha, pa.string())]
                names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
                if with_text:
                    columns.append(pa.array(text, pa.binary()))
                    names.append("kept")
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """One row per document: sizes and spans of what goes, a digest of what stays, and (``kept``) the bytes that stay."""
    spark: SparkSession = docs.sparkSession
    stash = Stash(spark, "suffix")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    packs = stash.put(rows.where("id is not null").mapInArrow(_packs, "docs long, data binary").select(F.monotonically_increasing_id().alias("pack"), "docs", "data"))
    buckets = max(16, min(MOST_BUCKETS, packs.count() // PACKS_A_BUCKET))
    lists = packs.mapInArrow(_anchor_lists(buckets), "bucket long, pack long, blob binary")
    shared = lists.groupBy("bucket").applyInArrow(_repeated, "pack long, bucket long, bits binary")
    shared = shared.groupBy("pack").agg(F.collect_list(F.struct("bucket", "bits")).alias("bits"))
    sent = packs.join(shared, "pack", "left").select("pack", "docs", "data", "bits").mapInArrow(_contexts(buckets), "kind int, bucket long, pack long, blob binary")
    marks = sent.groupBy("bucket").applyInArrow(_mark, "pack long, blob binary").groupBy("pack").agg(F.collect_list("blob").alias("blobs"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    cut = packs.join(marks, "pack", "left").select("docs", "data", "blobs").mapInArrow(_cut(with_text), schema)
    # Rows without an id are neither earlier nor later than others, so they never reach the packs.
    raw, none = F.coalesce(F.col("text"), F.lit("")).cast("binary"), F.lit(0).cast("long")
    whole = rows.where("id is null").select(F.col("id").alias("doc_id"), F.octet_length(raw).cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), F.sha2(raw, 256).alias("kept_sha256"), *[raw.alias("kept")] * with_text)
    return cut.unionByName(whole)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=False)
