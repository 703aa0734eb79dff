"""Line dedup by pairwise alignment.

A line goes when it stands in a run of adjacent lines, of at least ``MIN_CHARS`` code points, that any earlier document
(one with a smaller id) has too. The bound keeps headings and short phrases of the language; it is a parameter.

Overlapping documents are found through hashes of the shortest such runs, those that begin and those that end at each line:
together they cover every longer run, and a long line is a run by itself. A run is paired with its first holder (the
smallest id), which settles it as all its earlier holders would. Rare runs, with ``RARE`` holders at most, pair documents
first. What alignments with these partners leave of the commoner runs is then paired with their first holders, so no run is
lost, and a passage that a third of all documents share makes no pair where a closer relative settles it.

Pairs are aligned with patience diff: lines that are unique in both documents anchor the alignment, which is refined between
the anchors; where none is unique, the k-th places of equal lines anchor it. Aligned common blocks go from the later
document, and so do the runs that one increasing alignment leaves out, as they stand in another order or more than once.
Lines count as equal when two 64-bit hashes of their bytes are.

Alignments see line hashes and lengths only; texts move once, when the marked lines are cut out.

Nulls and edges: a null text counts as empty and stays null; blank lines neither pair documents nor count in a block's
length; rows with a null id are kept as they are; rows with one id never pair with each other, be they copies or not, and
each is cut by its own marks; texts of any length are read whole; an empty table gives an empty result; other columns,
whatever their names, are carried and never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .stash import Stash

MIN_CHARS = 50
#: Holders up to which a run is rare; it decides the order of the work, never the result.
RARE = 16


def line_arrays(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, second hash, code points, document) of each line of the documents; a blank line has hash 0. A document has a line more than line ends."""
    n_docs = len(off) - 1
    ends = np.flatnonzero(buf == 10)
    doc_of_end = np.searchsorted(off, ends, "right") - 1
    start = np.concatenate([off[:-1], ends + 1])
    doc = np.concatenate([np.arange(n_docs), doc_of_end])
    order = np.lexsort((start, doc))
    start, doc = start[order], doc[order]
    stop = np.where(np.append(doc[1:] == doc[:-1], False), np.append(start[1:], 0) - 1, off[doc + 1])
    size = stop - start
    points = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
    solid = np.concatenate([[0], np.cumsum(tk.SPACED[buf])])
    blank = solid[stop] == solid[start]
    h, again = (np.where(blank, tk.U(0), tk.span_hashes(buf, start, size, seed) | tk.U(1)) for seed in (0, 1))
    return h, again, np.where(blank, 0, points[stop] - points[start]), doc


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Matched positions (i in a, j in b) of equal lines, increasing in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        while alo < ahi and blo < bhi and a[alo] == b[blo]:
            out.append((alo, blo))
            alo, blo = alo + 1, blo + 1
        while alo < ahi and blo < bhi and a[ahi - 1] == b[bhi - 1]:
            ahi, bhi = ahi - 1, bhi - 1
            out.append((ahi, bhi))
        if alo == ahi or blo == bhi:
            continue
        in_a: dict = {}
        in_b: dict = {}
        for i in range(alo, ahi):
            in_a[a[i]] = -1 if a[i] in in_a else i
        for j in range(blo, bhi):
            in_b[b[j]] = -1 if b[j] in in_b else j
        unique = [(i, in_b[x]) for x, i in in_a.items() if i >= 0 and in_b.get(x, -1) >= 0]
        unique.sort()
        chain = _longest(unique or _numbered(a, b, alo, ahi, blo, bhi))
        if not chain:
            continue
        pi, pj = alo, blo
        for i, j in chain:
            out.append((i, j))
            todo.append((pi, i, pj, j))
            pi, pj = i + 1, j + 1
        todo.append((pi, ahi, pj, bhi))
    return sorted(out)


def _numbered(a: list, b: list, alo: int, ahi: int, blo: int, bhi: int) -> list[tuple[int, int]]:
    """For a range without a line that is unique in both documents: the k-th place of each line with its k-th place in the other."""
    places: dict = {}
    for j in range(bhi - 1, blo - 1, -1):
        places.setdefault(b[j], []).append(j)
    return [(i, places[a[i]].pop()) for i in range(alo, ahi) if places.get(a[i])]


def _longest(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest chain of pairs that increases in both places (pairs are sorted by the first)."""
    from bisect import bisect_left

    tops: list[int] = []
    at: list[int] = []
    before = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        p = bisect_left(tops, j)
        before[k] = at[p - 1] if p else -1
        if p == len(tops):
            tops.append(j)
            at.append(k)
        else:
            tops[p], at[p] = j, k
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


#: An odd base of run hashes, and its inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
BACK = pow(BASE, -1, 1 << 64)


def short_runs(h: np.ndarray, size: np.ndarray, doc: np.ndarray, min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of the shortest runs of lines with ``min_chars`` code points that begin or end at each line; none leaves its document."""
    n = len(h)
    total = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
    at = np.arange(n)
    first, past = np.searchsorted(doc, doc, "left"), np.searchsorted(doc, doc, "right")
    end = np.searchsorted(total, total[:-1] + min_chars, "left")
    start = np.searchsorted(total, total[1:] - min_chars, "right") - 1
    ahead, behind = end <= past, start >= first
    start, end = np.concatenate([at[ahead], start[behind]]), np.concatenate([end[ahead], at[behind] + 1])
    power, back = (np.cumprod(np.concatenate([np.ones(1, tk.U), np.full(n, b, tk.U)])) for b in (BASE, BACK))
    code = np.concatenate([np.zeros(1, tk.U), np.cumsum(tk.mix(h + tk.U(1)) * power[:n], dtype=tk.U)])
    return start, end, tk.mix((code[end] - code[start]) * back[start] + (end - start).astype(tk.U))


def doomed_lines(later: list, sizes: list[int], earlier: list, min_chars: int = MIN_CHARS) -> list[int]:
    """Lines of the later document in common blocks of at least ``min_chars`` code points: the aligned ones, and those the alignment leaves."""
    out: list[int] = []
    block: list[int] = []
    last = (-2, -2)

    def end() -> None:
        if sum(sizes[i] for i in block) >= min_chars:
            out.extend(block)
        block.clear()

    for i, j in patience(later, earlier):
        if (i - 1, j - 1) != last:
            end()
        block.append(i)
        last = (i, j)
    end()
    return sorted({*out, *_left(later, sizes, earlier, min_chars)}) if len(out) < len(later) else out


def _left(later: list, sizes: list[int], earlier: list, min_chars: int) -> list[int]:
    """Lines of the later document in any run of ``min_chars`` code points that the earlier one has, in whatever order."""
    number = {x: k for k, x in enumerate(dict.fromkeys(later))}
    known = dict(zip(later, sizes))
    n, m = len(later), len(earlier)
    h = np.array([number[x] for x in later] + [number.get(x, len(number) + j) for j, x in enumerate(earlier)], tk.U)
    # A line that only the earlier document has is of no matter: no run with it is common.
    size = np.array(sizes + [known.get(x, 0) for x in earlier], np.int64)
    start, end, key = short_runs(h, size, np.repeat([0, 1], [n, m]), min_chars)
    own = start < n
    hit = own & np.isin(key, key[~own])
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, start[hit], 1)
    np.add.at(cover, end[hit], -1)
    return np.flatnonzero(np.cumsum(cover[:-1]) > 0).tolist()


def _lines(min_chars: int):
    """Packed lines of each row and the hashes of its shortest runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = tk.column_bytes(batch.column(2))
            blobs, keys = [], []
            for i, j in tk.blocks(off):
                h, again, size, doc = line_arrays(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                start, _, key = short_runs(h, size, doc, min_chars)
                order = np.argsort(doc[start], kind="stable")
                key = key[order]
                bound, held = (np.searchsorted(d, np.arange(j - i + 1)) for d in (doc, doc[start[order]]))
                for a, b, c, e in zip(bound[:-1], bound[1:], held[:-1], held[1:]):
                    blobs.append(tk.pack([h[a:b], again[a:b], size[a:b].astype(np.int32)]))
                    keys.append(tk.distinct(key[c:e]).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(blobs, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["id", "tag", "lines", "keys"])

    return run


LINE_TYPES = [tk.U, tk.U, np.int32]


def _open_keys(min_chars: int):
    """Hashes of the shortest runs of which a line is not marked yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = []
            for lines, gone in zip(batch.column(2), batch.column(3)):
                h, _, size = tk.unpack(lines.as_py(), LINE_TYPES)
                start, end, key = short_runs(h, size, np.zeros(len(h), np.int64), min_chars)
                left = np.ones(len(h) + 1, np.int64)
                left[gone.values.to_numpy()] = 0
                left = np.cumsum(left) - left
                keys.append(tk.distinct(key[left[end] > left[start]]).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.list_(pa.int64()))], ["id", "tag", "keys"])

    return run


def _align(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for mine, other in zip(batch.column(2), batch.column(3)):
                (h, again, size), (h2, again2, _) = (tk.unpack(x.as_py(), LINE_TYPES) for x in (mine, other))
                out.append(doomed_lines(list(zip(h.tolist(), again.tolist())), size.tolist(), list(zip(h2.tolist(), again2.tolist())), min_chars))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int32()))], ["id", "tag", "gone"])

    return run


def _masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A byte for each line up to the last marked one, 1 where it goes."""
    for batch in batches:
        masks = []
        for gone in batch.column(2):
            at = gone.values.to_numpy()
            mask = np.zeros(at.max() + 1, np.uint8)
            mask[at] = 1
            masks.append(mask.tobytes())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(masks, pa.binary())], ["id", "tag", "gone", "mask"])


def _tag(text: str):
    """What tells rows with one id apart."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(id, tag, gone, mask) of each row that loses lines: the sorted places of those lines, and the same as bytes; ``tag`` is a hash of the text."""
    spark: SparkSession = docs.sparkSession
    stash = Stash(spark, "lines")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), _tag(text_col).alias("tag"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where("id is not null")
    lines = stash.put(rows.mapInArrow(_lines(min_chars), "id long, tag long, lines binary, keys array<long>"))
    held = lines.select("id", "tag", F.explode("keys").alias("key"))
    # Written, so that the joins below are plain ones, whose hot keys adaptive execution splits.
    shared = stash.put(
        held.groupBy("key").agg(F.min(F.struct("id", "tag")).alias("first"), F.max("id").alias("last"), F.count("*").alias("holders")).where("first.id < last")
        .select("key", F.col("first.id").alias("other"), F.col("first.tag").alias("other_tag"), "holders")
    )
    mine = lines.select("id", "tag", "lines")
    theirs = lines.select(F.col("id").alias("other"), F.col("tag").alias("other_tag"), F.col("lines").alias("theirs"))

    def aligned(keys: DataFrame, runs: DataFrame) -> DataFrame:
        pairs = keys.hint("merge").join(runs, "key").where("other < id").select("id", "tag", "other", "other_tag").distinct()
        full = pairs.hint("merge").join(mine, ["id", "tag"]).hint("merge").join(theirs, ["other", "other_tag"])
        return stash.put(full.select("id", "tag", "lines", "theirs").mapInArrow(_align(min_chars), "id long, tag long, gone array<int>").where(F.size("gone") > 0))

    def united(parts: DataFrame) -> DataFrame:
        return parts.groupBy("id", "tag").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("gone")))).alias("gone"))

    first = aligned(held, shared.where(f"holders <= {RARE}"))
    common = shared.where(f"holders > {RARE}")
    none = F.expr("cast(array() as array<int>)")
    left = mine.hint("merge").join(united(first), ["id", "tag"], "left").select("id", "tag", "lines", F.coalesce("gone", none).alias("gone"))
    left = left.mapInArrow(_open_keys(min_chars), "id long, tag long, keys array<long>").select("id", "tag", F.explode("keys").alias("key"))
    gone = united(first.unionByName(aligned(left, common)))
    return stash.put(gone.mapInArrow(_masks, "id long, tag long, gone array<int>, mask binary"))


def cut_lines(docs: DataFrame, marks: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the marked lines cut out of the text; adds ``n_removed_lines`` (in place of a column of that name)."""
    left = F.array_join(F.filter(F.split(F.col(f"row.{text_col}"), "\n", -1), lambda x, i: F.substring("mask", i + 1, 1) != F.lit(b"\1")), "\n")
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("id"), _tag(text_col).alias("tag"))
    # The marks grow with the documents, so they are never broadcast.
    joined = rows.join(marks.select("id", "tag", F.size("gone").alias("n"), "mask").hint("merge"), ["id", "tag"], "left")
    joined = joined.select("row", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.when(F.col("mask").isNull(), F.col(f"row.{text_col}")).otherwise(left).alias("left"))
    kept = [F.col("left").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns if c != "n_removed_lines"]
    return joined.select(*kept, F.col("n").alias("n_removed_lines"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    text = F.coalesce("text", F.lit(""))
    return cut_lines(docs, removed_lines(docs)).select("doc_id", "n_removed_lines", F.char_length(text).cast("long").alias("n_chars"), F.sha2(text, 256).alias("kept_sha256"))
