"""Language identification by cross-parsing entropy.

For each language a suffix automaton holds a bounded sample of labelled text. A text is cut, from the left, into the
longest phrases that occur in a language's sample (the greedy cross-parsing; a letter that the sample never has is a phrase
by itself); the fewer phrases, weighted with the logarithm of the sample's length, the closer the text is to that language.
The language with the least weighted count wins.

Symbols are code points, and the automata's transitions lie in one hash table, so there is no bound on the alphabet and a
language costs memory in proportion to its sample. Texts are parsed in lanes: every text is cut into segments of ``SEGMENT``
symbols that are parsed together, one symbol a step in all languages. The parse of each segment then runs on into the next
until both begin a phrase at the same place, from where on they agree; the counts put together at these places are those of
one parse from the left. So every whole text is read, phrases run over segments' ends, and one very long text is only more lanes.

Nulls and edges: a null text, or one without any letter, is ``und`` with score 0; rows with a null text, language or id are
never learned from; ties go to the alphabetically first language with score 0; without any labelled row all texts are
``und``; an empty table gives an empty result; repeated rows and other columns have no influence on a prediction.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk

#: The bounds of the training sample: rows of each language, symbols of each language, and the length up to which rows are
#: preferred. Rows are learned whole: one that would pass the bound is left out, unless it is the first.
SAMPLE_DOCS, SAMPLE_SYMBOLS, LONG = 48, 32_000, 8_000
SEGMENT = 512
#: Characters that are parsed at once; a longer text is a block of its own.
BLOCK = 1 << 20
#: The symbol between words. Code points take 21 bits.
BREAK, BITS = 0, 21
UNDETERMINED = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(symbols of all texts, offsets): letters in lower case, every run of other characters as one break."""
    low = [t.lower() for t in texts]
    size = np.array([len(t) for t in low], np.int64)
    sym = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    sym = np.where(_letters()[sym], sym, BREAK)
    off = np.concatenate([[0], np.cumsum(size)])
    keep = np.ones(len(sym), bool)
    keep[1:] = (sym[1:] != BREAK) | (sym[:-1] != BREAK)
    first = off[:-1][size > 0]
    keep[first] = True
    return sym[keep], np.concatenate([[0], np.cumsum(keep)])[off]


def suffix_automaton(s: list[int]) -> list[dict[int, int]]:
    """Transitions of the smallest automaton that reads exactly the substrings of ``s``. State 0 is the root."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in s:
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                copy = len(nxt)
                nxt.append(dict(nxt[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = copy
                    p = link[p]
                link[q] = link[cur] = copy
        last = cur
    return nxt


class Moves:
    """A hash table from (state, symbol) to the next state, with linear probing; -1 where there is none."""

    FREE = tk.U(2**64 - 1)

    def __init__(self, key: np.ndarray, to: np.ndarray):
        self.shift = tk.U(64 - max(4, int(2.5 * len(key)).bit_length()))
        self.mask = (1 << (64 - int(self.shift))) - 1
        self.key, self.to = np.full(self.mask + 1, self.FREE), np.full(self.mask + 1, -1, np.int64)
        todo, slot = np.arange(len(key)), self._home(key)
        while len(todo):
            _, first = np.unique(slot[todo], return_index=True)
            first = todo[first]
            first = first[self.key[slot[first]] == self.FREE]
            self.key[slot[first]], self.to[slot[first]] = key[first], to[first]
            todo = todo[self.key[slot[todo]] != key[todo]]
            slot[todo] = (slot[todo] + 1) & self.mask

    def _home(self, key: np.ndarray) -> np.ndarray:
        return ((key * tk.STEP) >> self.shift).astype(np.int64)

    def next(self, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        key = (state << BITS | c).astype(tk.U)
        slot = self._home(key)
        got = self.key[slot]
        out = np.where(got == key, self.to[slot], -1)
        todo = np.flatnonzero((got != key) & (got != self.FREE))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & self.mask
            got = self.key[slot[todo]]
            hit = got == key[todo]
            out[todo[hit]] = self.to[slot[todo[hit]]]
            todo = todo[~hit & (got != self.FREE)]
        return out


class Parser:
    """The automata of all languages in one table; languages in alphabetical order. State 0 reads nothing."""

    def __init__(self, samples: dict[str, list[str]]):
        self.langs = sorted(samples)
        key, to, roots, self.weight, base = [], [], [], [], 1
        for lang in self.langs:
            s, total = [], 0
            for t in samples[lang]:
                own = symbols([t])[0].tolist()
                if s and total + len(own) > SAMPLE_SYMBOLS:
                    continue
                s += [*own, (1 << BITS) - 1]  # a symbol that no text has keeps samples apart
                total += len(own)
            states = suffix_automaton(s)
            moves = [((base + i) << BITS | c, base + n) for i, m in enumerate(states) for c, n in m.items() if c < 0x110000]
            key += [k for k, _ in moves]
            to += [n for _, n in moves]
            roots.append(base)
            self.weight.append(math.log2(total + 2))
            base += len(states)
        self.roots = np.array(roots, np.int64)
        self.moves = Moves(np.array(key, tk.U), np.array(to, np.int64))

    def _begin(self, root: np.ndarray, c: np.ndarray) -> np.ndarray:
        return np.maximum(self.moves.next(root, c), 0)

    def phrases(self, sym: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Phrases of each text in each language, [language, text]."""
        langs, n, size = len(self.langs), len(sym), np.diff(off)
        per = -(-size // SEGMENT)
        text = np.repeat(np.arange(len(size)), per)
        start = tk.spread(np.zeros(len(size), np.int64), per) * SEGMENT + off[:-1][text]
        end = np.minimum(start + SEGMENT, off[1:][text])
        k = len(text)
        # A lane for each language and segment; all segments begin with a phrase.
        at, stop, root = np.tile(start, langs), np.tile(end, langs), np.repeat(self.roots, k)
        row = np.repeat(np.arange(langs) * n, k)
        begins = np.zeros(langs * n, bool)
        state = root.copy()
        begins[row + at] = True
        order = np.argsort(at - stop, kind="stable")
        longer = np.searchsorted(np.sort(at - stop), -np.arange(SEGMENT), "left")  # lanes with more than t symbols
        for t in range(SEGMENT):
            live = order[: longer[t]]
            if not len(live):
                break
            c = sym[at[live] + t]
            to = self.moves.next(state[live], c)
            fail = np.flatnonzero(to < 0)
            begins[row[live[fail]] + at[live[fail]] + t] = True
            to[fail] = self._begin(root[live[fail]], c[fail])
            state[live] = to
        # Each lane runs on until it begins a phrase where the segment that it is in does, or its text ends.
        pos, extra, last = stop.copy(), np.zeros(len(at), np.int64), np.tile(off[1:][text], langs)
        live = np.flatnonzero(pos < last)
        while len(live):
            c = sym[pos[live]]
            to = self.moves.next(state[live], c)
            fail = to < 0
            met = fail & begins[row[live] + pos[live]]
            fresh = np.flatnonzero(fail & ~met)
            extra[live[fresh]] += 1
            to[fresh] = self._begin(root[live[fresh]], c[fresh])
            state[live] = to
            live = live[~met]
            pos[live] += 1
            live = live[pos[live] < last[live]]
        total = np.concatenate([[0], np.cumsum(begins)])
        first = np.tile(np.append(True, text[1:] != text[:-1])[:k], langs)
        since = np.where(first, at, np.append(0, pos[:-1])[: len(at)])
        count = total[row + stop] - total[row + np.minimum(since, stop)] + extra
        out = np.zeros((langs, len(size)), np.int64)
        np.add.at(out, (np.repeat(np.arange(langs), k), np.tile(text, langs)), count)
        # Where a lane ran through a whole segment, that segment's own parse has no part in the text's.
        for i in {(j // k, int(text[j % k])) for j in np.flatnonzero(since > stop).tolist()}:
            lanes = i[0] * k + np.flatnonzero(text == i[1])
            since, whole = at[lanes[0]], 0
            for j in lanes.tolist():
                if since < stop[j]:
                    whole += int(total[row[j] + stop[j]] - total[row[j] + since] + extra[j])
                    since = pos[j]
            out[i] = whole
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        sym, off = symbols(texts)
        letters = np.concatenate([[0], np.cumsum(sym != BREAK)])
        has = letters[off[1:]] > letters[off[:-1]]
        cost = self.phrases(sym, off) * np.array(self.weight)[:, None]
        best = np.argmin(cost, 0)
        ranked = np.sort(cost, 0)
        second = ranked[1] if len(ranked) > 1 else ranked[0] * 2
        score = np.clip(1 - ranked[0] / np.maximum(second, 1e-9), 0, 1)
        langs = [self.langs[b] if h else UNDETERMINED for b, h in zip(best.tolist(), has.tolist())]
        return langs, np.where(has, score, 0.0).tolist()


@lru_cache(maxsize=2)
def _parser(samples: tuple) -> Parser:
    return Parser({k: list(v) for k, v in samples})


def held_out(id_col: Column) -> Column:
    """Rows that are never learned from."""
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(4)) == 2


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple:
    """A bounded sample of whole labelled texts, the same whatever the partitioning: for each of ``SAMPLE_DOCS`` seeds the labelled row with the least seeded hash, rows of up to ``LONG`` code points first."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("id").isNotNull() & ~held_out(F.col("id")))
    long = F.char_length("text") > LONG
    picks = rows.groupBy("lang").agg(F.array(*(F.min_by("id", F.struct(long, F.xxhash64("id", F.lit(seed)))) for seed in range(SAMPLE_DOCS))).alias("ids"))
    picks = picks.select("lang", F.posexplode("ids").alias("seed", "id"))
    wanted: dict[tuple[str, int], int] = {}
    for r in picks.toLocalIterator():  # SAMPLE_DOCS rows for each language at most
        wanted[r.lang, r.id] = min(r.seed, wanted.get((r.lang, r.id), r.seed))
    found: dict[str, dict[int, str]] = {}
    for r in rows.where(F.col("id").isin(sorted({i for _, i in wanted}))).groupBy("lang", "id").agg(F.min("text").alias("text")).toLocalIterator():
        if (r.lang, r.id) in wanted:
            found.setdefault(r.lang, {})[wanted[r.lang, r.id]] = r.text
    return tuple((lang, tuple(t for _, t in sorted(found[lang].items()))) for lang in sorted(found))


def _predict(samples_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = None
        for batch in batches:
            if parser is None:
                parser = _parser(samples_of.value)
            texts = [t or "" for t in batch.column(1).to_pylist()]
            off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
            langs, scores = [], []
            for i, j in tk.blocks(off, BLOCK):
                if parser.langs:
                    a, b = parser.predict(texts[i:j])
                else:
                    a, b = [UNDETERMINED] * (j - i), [0.0] * (j - i)
                langs += a
                scores += b
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return run


def predict_language(docs: DataFrame, samples: tuple, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score (relative margin of the best language over the second) of every text."""
    samples_of = docs.sparkSession.sparkContext.broadcast(samples)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_predict(samples_of), "doc_id long, lang_pred string, score double")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = predict_language(docs, learn(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
