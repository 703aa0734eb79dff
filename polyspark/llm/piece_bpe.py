"""SentencePiece (BPE) encoding and decoding by vectorised merge rounds.

All distinct words of a block are encoded at once. Their symbols lie in flat numpy arrays; each round takes the smallest
pair rank of every word (a segmented minimum), merges the leftmost non-overlapping places of that pair in all words
together and compacts the arrays, until no word has a pair left. A word drops out in the round in which it is finished.

Merging several places of a word in one round equals one-by-one merging unless a pair made by one of them ranks as high
as the pair being merged; in that case only the leftmost place is merged in that round, so results are always those of the
sequential algorithm. A word here is a run of spaces with the run of other characters after it: no piece of the vocabulary
has a space after another character (checked when the model is read), so merges never run over a word's end.

A task keeps the ids of words it has seen, up to ``KEPT_BYTES``, in flat arrays; words are looked up by hash. The bytes of the
pieces found are compared with the text, and a block in which they differ is encoded again by its words' bytes.

Nulls and edges: a null text counts as empty; an empty text has only the end id, and decodes to ''; texts of any length
are encoded whole; repeated rows give repeated results; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk

SPACE = "▁"
NO_PAIR = np.int64(1) << 40
#: Bytes of ids and hashes of words that a task keeps; beyond that it starts anew.
KEPT_BYTES = 16 << 20
#: Bytes of text that are encoded at once; a longer text is a block of its own.
BLOCK_BYTES = 512 << 10


class PieceModel:
    """Vocabulary of a SentencePiece BPE model with byte fallback, as lookup arrays."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm, train = model.normalizer_spec, model.trainer_spec
        if train.model_type != 2 or not train.byte_fallback or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix:
            raise ValueError("only BPE models with byte fallback and identity normalisation are supported")
        self.pieces = [p.piece for p in model.pieces]
        self.kinds = [p.type for p in model.pieces]
        self.end = self.kinds.index(3, self.kinds.index(3) + 1)
        normal = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == 1}
        if any(SPACE in p.lstrip(SPACE) for p in normal):
            raise ValueError("a piece has a space after another character")
        self.bytes_at = self.kinds.index(6)
        #: Symbols: piece ids, then characters that only longer pieces hold, then (at CHAR_BASE + code point) all others.
        extra = sorted({c for p in normal for c in p} - {p for p in normal})
        self.extra = [ord(c) for c in extra]
        symbol = normal | {c: len(self.pieces) + i for i, c in enumerate(extra)}
        self.char_base = len(self.pieces) + len(extra)
        single = sorted((ord(p), i) for p, i in symbol.items() if len(p) == 1)
        self.char_code = np.array([c for c, _ in single], np.int64)
        self.char_symbol = np.array([i for _, i in single], np.int64)
        scores = sorted({p.score for p in model.pieces if p.type == 1}, reverse=True)
        rank_of = {s: r for r, s in enumerate(scores)}
        keys, made, rank = [], [], []
        for p, i in normal.items():
            for k in range(1, len(p)):
                if p[:k] in symbol and p[k:] in symbol:
                    keys.append((symbol[p[:k]] << 32) | symbol[p[k:]])
                    made.append(i)
                    rank.append(rank_of[model.pieces[i].score])
        order = np.argsort(keys)
        self.pair_key = np.array(keys, np.int64)[order]
        self.pair_made = np.array(made, np.int64)[order]
        self.pair_rank = np.array(rank, np.int64)[order]
        self.raw = [bytes([i - self.bytes_at]) if k == 6 else p.replace(SPACE, " ").encode() if k == 1 else b"" for i, (p, k) in enumerate(zip(self.pieces, self.kinds))]
        self.raw_flat, self.raw_size, self.raw_at = _flat(self.raw)
        self.shown_flat, self.shown_size, self.shown_at = _flat([b"%d " % i for i in range(len(self.pieces))])

    def ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged symbol) of pairs; NO_PAIR where the vocabulary has none."""
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        found = self.pair_key[at] == key
        return np.where(found, self.pair_rank[at], NO_PAIR), np.where(found, self.pair_made[at], -1)

    def symbols(self, chars: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.char_code, chars), len(self.char_code) - 1)
        return np.where(self.char_code[at] == chars, self.char_symbol[at], self.char_base + chars)

    def merged(self, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols after all merges, and their words. ``word`` is sorted and holds each word's symbols together."""
        rank, made = np.full(len(sym), NO_PAIR), np.full(len(sym), -1)
        if len(sym) > 1:
            same = np.flatnonzero(word[1:] == word[:-1])
            rank[same], made[same] = self.ranks(sym[same], sym[same + 1])
        out_sym, out_word = [], []
        while len(sym):
            start, end = tk.runs(word)
            least = np.minimum.reduceat(rank, start)
            per = np.repeat(np.arange(len(start)), end - start)
            if (least == NO_PAIR).any():
                done = (least == NO_PAIR)[per]
                out_sym.append(sym[done])
                out_word.append(word[done])
                sym, word, rank, made = sym[~done], word[~done], rank[~done], made[~done]
                if not len(sym):
                    break
                start, end = tk.runs(word)
                least = least[least < NO_PAIR]
                per = np.repeat(np.arange(len(start)), end - start)
            hit = np.flatnonzero(rank == least[per])
            # In a row of overlapping places every second one is taken, from the left.
            follows = np.zeros(len(hit), bool)
            follows[1:] = hit[1:] == hit[:-1] + 1
            base = np.maximum.accumulate(np.where(follows, -1, np.arange(len(hit))))
            at = hit[(np.arange(len(hit)) - base) % 2 == 0]
            owner = per[at]
            first = np.ones(len(at), bool)
            first[1:] = owner[1:] != owner[:-1]
            several = ~first
            several[:-1] |= ~first[1:]
            if several.any():
                # The pairs that each single merge would make, in the order from the left.
                k = np.flatnonzero(several)
                p, m, o = at[k], made[at[k]], owner[k]
                right, left = np.minimum(p + 2, len(sym) - 1), np.maximum(p - 1, 0)
                r_rank = np.where((p + 2 < end[o]), self.ranks(m, sym[right])[0], NO_PAIR)
                taken = np.zeros(len(sym) + 2, bool)
                taken[at] = True  # p - 2 may be -1 or -2: these last two places stay free
                before = np.where(taken[p - 2], made[np.maximum(p - 2, 0)], sym[left])
                l_rank = np.where(p - 1 >= start[o], self.ranks(before, m)[0], NO_PAIR)
                risky = np.zeros(len(start), bool)
                risky[o[np.minimum(r_rank, l_rank) <= least[o]]] = True
                at = at[first | ~risky[owner]]
            sym[at] = made[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            now = np.cumsum(keep) - 1
            sym, word, rank, made = sym[keep], word[keep], rank[keep], made[keep]
            new = now[at]
            changed = np.zeros(len(sym), bool)
            changed[new] = True
            changed[new[new > 0] - 1] = True
            fresh = np.flatnonzero(changed)
            inside = fresh[(fresh + 1 < len(sym))]
            inside = inside[word[inside] == word[inside + 1]]
            rank[fresh], made[fresh] = NO_PAIR, -1
            rank[inside], made[inside] = self.ranks(sym[inside], sym[inside + 1])
        if not out_sym:
            return sym, word
        sym, word = np.concatenate(out_sym), np.concatenate(out_word)
        order = np.argsort(word, kind="stable")
        return sym[order], word[order]

    def encode_words(self, raw: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, number of ids of each). ``raw`` has the words' UTF-8 bytes with plain spaces, ``size`` their lengths."""
        points = np.add.reduceat((raw & 0xC0) != 0x80, np.cumsum(size) - size, dtype=np.int64)
        chars = np.frombuffer(raw.tobytes().decode().replace(" ", SPACE).encode("utf-32-le"), np.uint32).astype(np.int64)
        sym, word = self.merged(self.symbols(chars), np.repeat(np.arange(len(size)), points))
        out = np.ones(len(sym), np.int64)
        odd = np.flatnonzero(sym >= len(self.pieces))  # a character without a piece becomes the pieces of its bytes
        code = np.array([s - self.char_base if s >= self.char_base else self.extra[s - len(self.pieces)] for s in sym[odd].tolist()], np.int64)
        out[odd] = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
        ids = np.repeat(sym, out).astype(np.int32)
        if len(odd):
            ids[tk.spread((np.cumsum(out) - out)[odd], out[odd])] = self.bytes_at + np.frombuffer("".join(map(chr, code.tolist())).encode(), np.uint8).astype(np.int32)
        return ids, np.bincount(word, out, len(size)).astype(np.int64)

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        return self.raw_flat[tk.spread(self.raw_at[ids], self.raw_size[ids])]

    def decode(self, ids: list[int]) -> str:
        """Text of ids: pieces joined, control ids left out, byte pieces as bytes, and the leading space that encoding adds removed."""
        kinds = self.kinds
        raw = b"".join(self.raw[i] for i in ids)
        first = next((i for i in ids if kinds[i] != 3), None)
        if first is not None and kinds[first] == 1 and raw.startswith(b" "):
            raw = raw[1:]
        return raw.decode("utf-8", "replace")


def _flat(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, lengths, starts) of a list of strings."""
    size = np.array([len(p) for p in parts], np.int64)
    return np.frombuffer(b"".join(parts), np.uint8), size, np.cumsum(size) - size


@lru_cache(maxsize=4)
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)


class Encoder:
    """Encodes documents block by block and keeps the words it has seen."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.reset()

    def reset(self) -> None:
        self.known = np.zeros(0, tk.U)  # sorted hashes of words, and where their ids lie
        self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def encode(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents, number of ids of each), without end ids. Each document starts with the added space."""
        space = buf == 0x20
        start = space.copy()
        start[1:] &= ~space[:-1]
        start[off[:-1]] = True
        ws = np.flatnonzero(start)
        size = np.diff(np.append(ws, len(buf)))
        u, one, back = np.unique(tk.span_hashes(buf, ws, size), return_index=True, return_inverse=True)
        if 24 * len(self.known) + 4 * len(self.ids) > KEPT_BYTES:
            self.reset()
        at = np.searchsorted(self.known, u)
        new = np.flatnonzero(np.append(self.known, tk.U(0))[at] != u) if len(self.known) else np.arange(len(u))
        if len(new):
            w = one[new]
            ids, count = self.model.encode_words(buf[tk.spread(ws[w], size[w])], size[w])
            at = at[new]
            self.known = np.insert(self.known, at, u[new])
            self.start = np.insert(self.start, at, len(self.ids) + np.cumsum(count) - count)
            self.size = np.insert(self.size, at, count)
            self.ids = np.concatenate([self.ids, ids])
        place = np.searchsorted(self.known, u)[back]
        count = self.size[place]
        ids = self.ids[tk.spread(self.start[place], count)]
        if not np.array_equal(self.model.bytes_of(ids), buf):  # two words with one hash
            raw = buf.tobytes()
            known: dict[bytes, int] = {}
            word = np.array([known.setdefault(raw[a : a + n], len(known)) for a, n in zip(ws.tolist(), size.tolist())], np.int64)
            flat, length, _ = _flat(list(known))
            ids, count = self.model.encode_words(flat, length)
            ids, count = ids[tk.spread((np.cumsum(count) - count)[word], count[word])], count[word]
        total = np.concatenate([[0], np.cumsum(count)])
        return ids, np.diff(total[np.searchsorted(ws, off)])


def _with_prefix(col) -> tuple[np.ndarray, np.ndarray]:
    """The column as the model sees it: its own space character as a space, and a space before each text."""
    col = pc.replace_substring(pc.fill_null(col.cast(pa.large_string()), ""), SPACE, " ")
    return tk.column_bytes(pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), col, pa.scalar("", pa.large_string())))


def _digests(flat: np.ndarray, bound: np.ndarray, tail: int) -> pa.Array:
    """SHA-256 of stretches of bytes, each without its last ``tail`` bytes."""
    raw = memoryview(np.ascontiguousarray(flat))
    return pa.array([hashlib.sha256(raw[a : b - tail]).hexdigest() for a, b in zip(bound[:-1].tolist(), bound[1:].tolist())], pa.string())


def encoded(model_path: str, with_ids: bool):
    """For mapInArrow over (id, text): id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(model_path)
        enc = Encoder(model)
        for batch in batches:
            _, off = tk.column_bytes(batch.column(1))
            for i, j in tk.blocks(off, BLOCK_BYTES):  # a row batch for each block: results never pile up
                buf, own = _with_prefix(batch.column(1).slice(i, j - i))
                ids, count = enc.encode(buf, own)
                filled = np.diff(own) > 1  # an empty text has the added space only, and no token but the end
                ids, count = ids[np.repeat(filled, count)], np.where(filled, count, 0)
                bound = np.concatenate([[0], np.cumsum(count + 1)])
                full = np.full(bound[-1], model.end, np.int32)
                full[tk.spread(bound[:-1], count)] = ids
                shown = np.concatenate([[0], np.cumsum(model.shown_size[full])])[bound]
                plain = model.bytes_of(full)  # the end id has no bytes
                edge = np.concatenate([[0], np.cumsum(model.raw_size[full])])[bound]
                added = np.zeros(len(plain), bool)
                added[edge[:-1][filled]] = True  # the space that encoding adds
                edge -= np.concatenate([[0], np.cumsum(filled)])
                columns = [
                    batch.column(0).slice(i, j - i),
                    pa.array(count + 1, pa.int64()),
                    _digests(model.shown_flat[tk.spread(model.shown_at[full], model.shown_size[full])], shown, 1),
                    _digests(plain[~added], edge, 0),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(bound.astype(np.int32)), pa.array(full)))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def encode_pieces(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Ids of every whole text with an end id, and digests of the ids and of the text decoded from them."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(encoded(model_path, with_ids), schema)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_pieces(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_model(), with_ids=False)
