"""Byte-level BPE over whole texts by a trie of distinct words.

Texts fall into pieces (a word with the one space before it, or a run of white space), most of which occur again and again. The
distinct pieces of a slice that the task hasn't met are cut into pre-tokens and inserted, in order, into a trie. Walked depth first,
every node (a prefix) gets the last token of its encoding: the one token that ends there and is compatible with the last
token of the node where it starts; so a shared prefix is encoded once. Two tokens are compatible if merging the bytes of both
gives back the two. A word's ids are read from its node upwards.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwatch.llm import words as W

#: Fixed value: how the vocabulary's pre-tokenizer cuts text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct pieces a task remembers before it starts afresh; results don't depend on it.
MEMORY = 500_000
_OUT = "doc_id long, n_tokens long, ids binary, decoded string"


def byte_letters() -> dict[str, int]:
    """The printable letter of each byte in vocabulary files: printable Latin-1 stands for itself, the others follow from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Token bytes, merge ranks and compatibility of token pairs."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, model = byte_letters(), spec["model"]
        to_bytes = lambda s: bytes(letters[c] for c in s)
        self.ids = {to_bytes(t): i for t, i in model["vocab"].items() if all(c in letters for c in t)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for text, i in self.special.items():
            self.ids.pop(text.encode(), None)
        self.bytes = {i: t for t, i in self.ids.items()} | {i: t.encode() for t, i in self.special.items()}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.merges = {(self.ids[to_bytes(a)], self.ids[to_bytes(b)]): (r, self.ids[to_bytes(a + b)]) for r, (a, b) in enumerate(pairs)}
        self.ends: dict[bytes, int] = {}
        for token in self.ids:
            for k in range(len(token)):
                self.ends.setdefault(token[k:], -1)
        for token, i in self.ids.items():
            if self.merge(token) == [i]:
                self.ends[token] = i
        self.fits: dict[int, bool] = {}
        size = max(self.bytes) + 1
        self.length = np.zeros(size, np.int64)
        for i, t in self.bytes.items():
            self.length[i] = len(t)
        self.place = np.concatenate(([0], np.cumsum(self.length)[:-1]))
        self.table = np.frombuffer(b"".join(self.bytes.get(i, b"") for i in range(size)), np.uint8)

    def merge(self, text: bytes) -> list[int]:
        """Ids by merging the best-ranked pair again and again."""
        parts = [self.ids[bytes((b,))] for b in text]
        while len(parts) > 1:
            best = min((self.merges.get(p, (1 << 60, 0)) + (k,) for k, p in enumerate(zip(parts, parts[1:]))), key=lambda x: (x[0], x[2]))
            if best[0] == 1 << 60:
                break
            parts[best[2]:best[2] + 2] = [best[1]]
        return parts

    def compatible(self, one: int, two: int) -> bool:
        key = one << 24 | two
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) > 2_000_000:
                self.fits.clear()
            known = self.fits[key] = self.merge(self.bytes[one] + self.bytes[two]) == [one, two]
        return known

    def encode_words(self, words: list[bytes]) -> dict[bytes, list[int]]:
        """Ids of distinct words: a depth-first walk over the trie that the ordered words span."""
        out: dict[bytes, list[int]] = {}
        last: list[int] = [-1]
        path: list[int] = [0]
        before, ends, compatible = b"", self.ends, self.compatible
        for word in sorted(words):
            shared, limit = 0, min(len(before), len(word))
            while shared < limit and before[shared] == word[shared]:
                shared += 1
            del path[shared + 1:]
            for depth in range(shared + 1, len(word) + 1):
                token = -1
                for length in range(1, depth + 1):
                    found = ends.get(word[depth - length:depth])
                    if found is None:
                        break
                    if found >= 0 and (length == depth or compatible(last[path[depth - length]], found)):
                        token = found
                        break
                path.append(len(last))
                last.append(token)
            ids, depth = [], len(word)
            while depth:
                token = last[path[depth]]
                ids.append(token)
                depth -= len(self.bytes[token])
            out[word] = ids[::-1]
            before = word
        return out


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Encoder:
    """Ids of pieces, remembered within a worker."""

    def __init__(self, path: str):
        self.v = vocabulary(path)
        self.cut = regex.compile(PATTERN)
        self.forget()

    def forget(self):
        self.known: dict[int, int] = {}
        self.pool: list[np.ndarray] = [np.zeros(0, np.uint32)]
        self.of = np.zeros(1 << 12, np.int64)
        self.size = np.zeros(1 << 12, np.int64)
        self.used = 0

    def pretokens(self, piece: str) -> list[str]:
        if piece.isascii() and piece[piece[:1] == " ":].isalpha():
            return [piece]
        return self.cut.findall(piece)

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        cut = [[p.encode() for p in self.pretokens(piece.decode())] for piece in pieces]
        ids = self.v.encode_words(list({p for ps in cut for p in ps}))
        return [[i for p in ps for i in ids[p]] for ps in cut]

    def encode_text(self, text: str) -> list[int]:
        """Any text, special tokens and all kinds of white space included."""
        out: list[int] = []
        parts = regex.split("(" + "|".join(map(regex.escape, self.v.special)) + ")", text) if self.v.special else [text]
        for part in parts:
            if part in self.v.special:
                out.append(self.v.special[part])
            elif part:
                words = [p.encode() for p in self.cut.findall(part)]
                ids = self.v.encode_words(list(set(words)))
                out.extend(i for w in words for i in ids[w])
        return out

    def pieces(self, hashes: np.ndarray, start: np.ndarray, end: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all distinct pieces, first id, count) with one entry per piece."""
        distinct, where, back = np.unique(hashes, return_index=True, return_inverse=True)
        if self.used + len(distinct) > MEMORY:
            self.forget()
        known, raw = self.known, data.tobytes()
        new = [k for k, h in enumerate(distinct.tolist()) if h not in known]
        if new:
            made = self.encode_pieces([raw[start[where[k]]:end[where[k]]] for k in new])
            sizes = np.array([len(m) for m in made], np.int64)
            need = self.used + len(new)
            if need > len(self.of):
                grown = max(need, 2 * len(self.of))
                self.of, self.size = np.resize(self.of, grown), np.resize(self.size, grown)
            base = sum(len(p) for p in self.pool)
            self.of[self.used:need] = base + np.concatenate(([0], np.cumsum(sizes)[:-1]))
            self.size[self.used:need] = sizes
            self.pool = [np.concatenate(self.pool + [np.fromiter((i for m in made for i in m), np.uint32)])]
            for j, k in enumerate(new):
                known[int(distinct[k])] = self.used + j
            self.used = need
        slot = np.fromiter((known[h] for h in distinct.tolist()), np.int64, len(distinct))[back]
        return self.pool[0], self.of[slot], self.size[slot]


@lru_cache(maxsize=1)
def encoder_of(path: str) -> Encoder:
    """One for all tasks of a worker."""
    return Encoder(path)


def odd_texts(data: np.ndarray, offsets: np.ndarray, special: dict[str, int]) -> set[int]:
    """Documents that may hold special tokens or white space other than ASCII; they are cut as a whole."""
    nxt = np.append(data[1:], np.uint8(0))
    hit = (data >= 28) & (data <= 31)
    for lead, follow in ((0xC2, (0x85, 0xA0)), (0xE1, (0x9A, 0xA0)), (0xE2, (0x80, 0x81)), (0xE3, (0x80,))):
        if (at := data == lead).any():
            hit |= at & np.isin(nxt, follow)
    places = list(np.flatnonzero(hit))
    raw = data.tobytes()
    for text in special:
        at = raw.find(text.encode())
        while at >= 0:
            places.append(at)
            at = raw.find(text.encode(), at + 1)
    return set((np.searchsorted(offsets, places, "right") - 1).tolist())


def piece_bounds(w: W.Words) -> np.ndarray:
    """Starts of the pieces; they tile the data."""
    n = len(w.data)
    marks = np.zeros(n + 1, bool)
    marks[w.offsets] = True
    at_head = np.zeros(n + 1, bool)
    at_head[w.offsets] = True
    inner = w.start[~at_head[w.start]]
    marks[w.start[at_head[w.start]]] = True
    marks[inner - 1] = True
    marks[inner[w.data[inner - 1] != 32]] = True
    marks[w.end] = True
    return np.flatnonzero(marks[:n])


def _joined(table: np.ndarray, place: np.ndarray, size: np.ndarray) -> np.ndarray:
    return table[W.ragged(place, size)]


def _round_trip(path: str):
    def run(batches):
        encoder = encoder_of(path)
        v = encoder.v
        for batch in batches:
            for rows, data, offsets in W.text_slices(batch.column("text")):
                n_docs = len(offsets) - 1
                w = W.find_words(rows, data, offsets)
                start = piece_bounds(w)
                end = np.append(start[1:], len(data))
                if len(start):
                    pool, of, size = encoder.pieces(W.byte_hashes(data, start, end), start, end, data)
                    ids = _joined(pool, of, size)
                    done = np.concatenate(([0], np.cumsum(size)))
                    bounds = done[np.searchsorted(start, offsets)]
                else:
                    ids, bounds = np.zeros(0, np.uint32), np.zeros(n_docs + 1, np.int64)
                per_doc = None
                odd = odd_texts(data, offsets, v.special)
                if odd:
                    raw = data.tobytes()
                    per_doc = [np.array(encoder.encode_text(raw[offsets[i]:offsets[i + 1]].decode()), np.uint32) if i in odd
                               else ids[bounds[i]:bounds[i + 1]] for i in range(n_docs)]
                    ids = np.concatenate(per_doc).astype(np.uint32)
                    bounds = np.concatenate(([0], np.cumsum([len(x) for x in per_doc])))
                size = v.length[ids]
                text = _joined(v.table, v.place[ids], size)
                ends = np.concatenate(([0], np.cumsum(size)))[bounds]
                text_array = pa.LargeStringArray.from_buffers(n_docs, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(text))
                ids_array = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), n_docs, [None, pa.py_buffer((bounds * 4).astype(np.int64)), pa.py_buffer(ids.astype("<u4"))])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(rows.start, n_docs), pa.array(np.diff(bounds).astype(np.int64)),
                     ids_array.cast(pa.binary()), text_array.cast(pa.string())], names=["doc_id", "n_tokens", "ids", "decoded"])
    return run


def round_trip(docs: DataFrame, path: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers), decoded: every whole text encoded, and its ids decoded again.

    Special tokens in a text are recognised, none are added. Null counts as empty: no ids. Repeated rows stay repeated; other
    columns of ``docs`` are not read. ``path`` is the vocabulary file, at the same place on every executor.
    """
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_round_trip(path), _OUT)
