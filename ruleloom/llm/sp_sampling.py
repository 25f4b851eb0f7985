"""Sampled SentencePiece segmentations, and lossless decoding.

A text's piece lattice has an edge for every vocabulary piece that matches at a
position, and byte pieces for characters that no piece covers.  A piece's
probability falls with its rank in the vocabulary (Zipf's law), to the power
``1 / temperature``.  Forward filtering sums the probabilities of all
segmentations up to every position; backward sampling then draws a segmentation
from the end, in proportion to its probability.  Random numbers come from the
row's key and the place in the text, so a key's segmentation can be
reproduced.

No piece reaches over the end of a word into the next space, so the lattice of
a text falls into those of its words; the distinct words of a batch are
filtered together, one position at a time, and all their occurrences are drawn
together, one backward step at a time.  A word's sums and shares depend on
nothing but the word, and a draw on nothing but its row's key, the place in the
text and the shares, so a row's segmentation doesn't depend on its neighbours.
Very long words (texts without spaces) are filtered and drawn one by one, in
time linear in their length.
Spaces are spaces: nothing is normalised, added or dropped, a literal piece
mark in a text is written as bytes, and decoding gives back every text.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Characters of a word from which it is filtered and drawn alone.
LONG = 256
#: Bytes of text that are sampled at once.
AT_ONCE = 1 << 20
_WORD = re.compile(r" *[^ \n]+| +|\n")
_GAMMA, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = np.uint64(0x100000001B3)
#: Slots of the hash table of pieces and their beginnings, as a power of two.
_SLOTS = 20


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _uniform(counter: np.ndarray) -> np.ndarray:
    """Numbers in [0, 1) from 64-bit counters (the finalizer of splitmix64)."""
    z = counter * _GAMMA
    z = (z ^ (z >> np.uint64(30))) * _M1
    z = (z ^ (z >> np.uint64(27))) * _M2
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) * 2.0**-53


class Sampler:
    """Lattices, sampling and decoding for one model file."""

    def __init__(self, path: str, temperature: float = 1.0):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.surface: list[bytes] = []
        self.pieces: dict[str, tuple[int, float]] = {}
        self.byte_id = [-1] * 256
        n = model.get_piece_size()
        norm = float(np.log((1.0 / np.arange(1, n + 1)).sum()))
        rank = 0
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.surface.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.surface.append(b"")
            else:
                text = piece.replace(MARK, " ")
                rank += 1
                self.pieces[text] = (i, -(float(np.log(rank)) + norm) / temperature)
                self.surface.append(text.encode())
        if min(self.byte_id) < 0:
            raise ValueError("the model has no byte pieces: not every text can be decoded")
        if any(" " in p.lstrip(" ") or "\n" in p for p in self.pieces):
            raise ValueError("the model has pieces that reach over words")
        self._index()

    def _index(self) -> None:
        """A hash table of all beginnings of pieces; a beginning that is a piece knows its id."""
        found: dict[str, int] = {}
        for p in self.pieces:
            for j in range(1, len(p) + 1):
                found.setdefault(p[:j], len(found))
        self.longest = max(map(len, self.pieces))
        self.piece_of = np.full(len(found), -1, np.int64)
        self.weight_of = np.zeros(len(found))
        self.hashes = np.zeros(len(found), np.uint64)
        self.table = np.full(1 << _SLOTS, -1, np.int32)
        for p, k in found.items():
            h = 0
            for c in p:
                h = (h * int(_BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
            self.hashes[k] = h
            if p in self.pieces:
                self.piece_of[k], self.weight_of[k] = self.pieces[p]
            at = (h * int(_GAMMA) & 0xFFFFFFFFFFFFFFFF) >> (64 - _SLOTS)
            while self.table[at] >= 0:
                if self.hashes[self.table[at]] == h:
                    raise ValueError("two beginnings of pieces have one hash")
                at = (at + 1) % (1 << _SLOTS)
            self.table[at] = k

    def _look_up(self, h: np.ndarray) -> np.ndarray:
        """Numbers of beginnings by hash; -1 for none."""
        at = (h * _GAMMA >> np.uint64(64 - _SLOTS)).astype(np.int64)
        out = self.table[at].astype(np.int64)
        wrong = np.flatnonzero((out >= 0) & (self.hashes[out] != h))
        while len(wrong):
            at[wrong] = (at[wrong] + 1) % (1 << _SLOTS)
            out[wrong] = self.table[at[wrong]]
            wrong = wrong[(out[wrong] >= 0) & (self.hashes[out[wrong]] != h[wrong])]
        return out

    def lattices(self, words: list[str]) -> tuple[np.ndarray, ...]:
        """Forward filtering of many words at once.

        Boundaries are numbered through all words.  Returns (end boundary of
        each word, log-sum at each boundary, first edge and number of edges that
        end at each boundary, and for the edges, sorted by end: share cumulated
        over the boundary's edges, piece, source boundary or -1 for a word's
        start).
        """
        size = np.array([len(w) for w in words], np.int64)
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        word = np.repeat(np.arange(len(words)), size)
        first = np.cumsum(size) - size
        place = np.arange(len(chars)) - first[word]
        left = size[word] - place  # characters to the word's end
        base = first + np.arange(len(words))  # boundary before each word
        start, end, piece, weight = [], [], [], []
        alive, h = np.arange(len(chars)), np.zeros(len(chars), np.uint64)
        for length in range(1, self.longest + 1):
            h = h * _BASE + (chars[alive + length - 1] + 1).astype(np.uint64)
            known = self._look_up(h)
            ids = np.where(known >= 0, self.piece_of[known], -1)
            hit = np.flatnonzero(ids >= 0)
            at = alive[hit]
            start.append(at)
            end.append(np.full(len(at), length))
            piece.append(ids[hit])
            weight.append(self.weight_of[known[hit]])
            if length == 1:
                bare = np.flatnonzero(ids < 0)
                start.append(bare)
                end.append(np.full(len(bare), 1))
                piece.append(-1 - chars[bare])
                weight.append(np.full(len(bare), -20.0))
            more = (known >= 0) & (left[alive] > length)
            alive, h = alive[more], h[more]
            if not len(alive):
                break
        start, length = np.concatenate(start), np.concatenate(end)
        piece, weight = np.concatenate(piece), np.concatenate(weight)
        source = base[word[start]] + place[start]
        target = source + length
        order = np.argsort(target, kind="stable")  # merges one sorted run a length
        source, target, piece, weight = source[order], target[order], piece[order], weight[order]
        bounds = len(chars) + len(words)
        edges = np.bincount(target, minlength=bounds)
        first_edge = np.cumsum(edges) - edges
        total = np.zeros(bounds)
        share = np.zeros(len(target))
        by_size = np.argsort(-size, kind="stable")
        ordered, sizes = base[by_size], -size[by_size]
        short = np.where(size < LONG, size, 0)
        by_size = np.argsort(-short, kind="stable")
        ordered, sizes = base[by_size], -short[by_size]
        for k in range(1, int(short.max(initial=0)) + 1):
            # the boundaries after k characters, of all words that are as long
            at = ordered[: np.searchsorted(sizes, -k, "right")] + k
            n = edges[at]
            some = np.cumsum(n) - n
            pick = np.repeat(first_edge[at] - some, n) + np.arange(int(some[-1] + n[-1]))
            value = total[source[pick]] + weight[pick]
            top = np.maximum.reduceat(value, some)
            e = np.exp(value - np.repeat(top, n))
            summed = np.add.reduceat(e, some)
            total[at] = top + np.log(summed)
            share[pick] = e / np.repeat(summed, n)
        for i in np.flatnonzero(size >= LONG).tolist():
            self._filter_long(int(base[i]), int(size[i]), edges, first_edge, source, weight, total, share)
        # cumulated shares of each boundary's edges, edge by edge
        for k in range(1, int(edges.max(initial=0))):
            at = first_edge[edges > k] + k
            share[at] += share[at - 1]
        at_start = np.zeros(bounds, bool)
        at_start[base] = True
        return base + size, total, first_edge, edges, share, piece, np.where(at_start[source], -1, source)

    @staticmethod
    def _filter_long(start: int, size: int, edges, first_edge, source, weight, total, share) -> None:
        """Forward filtering of one word, character by character."""
        low, stop = int(first_edge[start + 1]), int(first_edge[start + size] + edges[start + size])
        n, back, w = edges[start + 1 : start + size + 1].tolist(), (source[low:stop] - start).tolist(), weight[low:stop].tolist()
        sums, shares, at, exp, log = [0.0], [], 0, math.exp, math.log
        for count in n:
            values = [sums[back[i]] + w[i] for i in range(at, at + count)]
            top = max(values)
            parts = [exp(v - top) for v in values]
            whole = sum(parts)
            sums.append(top + log(whole))
            shares += [p / whole for p in parts]
            at += count
        total[start : start + size + 1] = sums
        share[low:stop] = shares

    def sample(self, keys: list[str], texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each text)."""
        number_of: dict[str, int] = defaultdict(itertools.count().__next__)
        which: list[int] = []
        long_words: dict[int, list[int]] = {}
        counts, seeds = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.uint64)
        for t, (k, text) in enumerate(zip(keys, texts, strict=True)):
            parts = _WORD.findall(text)
            which += [number_of[p] for p in parts]
            counts[t] = len(parts)
            seeds[t] = xxhash.xxh64_intdigest(k.encode(), 0)
        if not which:
            return np.zeros(0, np.int32), counts
        last, _, first_edge, edges, share, piece, source = self.lattices(list(number_of))
        which = np.array(which, np.int64)
        size = np.array([len(w) for w in number_of], np.int64)[which]
        # a word takes one number a step, as many as it has characters at most: its place in the text is its stream
        before = np.cumsum(size) - size
        starts = np.cumsum(counts) - counts
        place = before - np.repeat(np.r_[before, 0][starts], counts)
        counter = np.repeat(seeds, counts) + place.astype(np.uint64)
        state, alive = last[which], np.flatnonzero(size < LONG)
        state = state[alive]
        taken_by, taken = [], []
        length, step = np.zeros(len(which), np.int64), 0
        while len(alive):
            edge = first_edge[state]
            end = edge + edges[state] - 1
            u = _uniform(counter[alive] + np.uint64(step))
            on = np.flatnonzero((share[edge] <= u) & (edge < end))
            while len(on):
                edge[on] += 1
                on = on[(share[edge[on]] <= u[on]) & (edge[on] < end[on])]
            taken_by.append(alive)
            taken.append(piece[edge])
            length[alive] += 1
            state = source[edge]
            more = state >= 0
            alive, state = alive[more], state[more]
            step += 1
        for i in np.flatnonzero(size >= LONG).tolist():
            found = self._draw_long(int(last[which[i]]), int(size[i]), counter[i], first_edge, edges, share, piece, source)
            length[i] = len(found)
            long_words[i] = found
        ends = np.cumsum(length)
        out = np.zeros(int(ends[-1]), np.int64)
        for k, (who, ids) in enumerate(zip(taken_by, taken, strict=True)):
            out[ends[who] - 1 - k] = ids
        for i, found in long_words.items():
            out[ends[i] - len(found) : ends[i]] = found[::-1]
        of_text = np.add.reduceat(np.r_[length, 0], np.cumsum(counts) - counts) * (counts > 0)
        bare = np.flatnonzero(out < 0)
        if len(bare):  # characters without a piece become bytes
            spelled = [[self.byte_id[b] for b in chr(-1 - int(c)).encode("utf-8", "surrogatepass")] for c in out[bare]]
            grow = np.ones(len(out), np.int64)
            grow[bare] = [len(b) for b in spelled]
            text_of = np.repeat(np.arange(len(texts)), of_text)
            of_text = np.bincount(text_of, weights=grow, minlength=len(texts)).astype(np.int64)
            wide = np.repeat(out, grow)
            wide[wide < 0] = [b for one in spelled for b in one]
            out = wide
        return out.astype(np.int32), of_text

    @staticmethod
    def _draw_long(state: int, size: int, counter: np.uint64, first_edge, edges, share, piece, source) -> list[int]:
        """Backward sampling of one word: its pieces from the last to the first."""
        u = _uniform(counter + np.arange(size, dtype=np.uint64)).tolist()
        start = state - size
        low, stop = int(first_edge[start + 1]), int(first_edge[state] + edges[state])
        first, n = (first_edge[start : state + 1] - low).tolist(), edges[start : state + 1].tolist()
        shares, pieces, back = share[low:stop].tolist(), piece[low:stop].tolist(), source[low:stop].tolist()
        found, at = [], size
        while at > 0:
            edge, end, x = first[at], first[at] + n[at] - 1, u[len(found)]
            while shares[edge] <= x and edge < end:
                edge += 1
            found.append(pieces[edge])
            at = back[edge] - start
        return found

    def decode(self, ids) -> str:
        surface = self.surface
        return b"".join([surface[i] for i in ids]).decode("utf-8", "surrogatepass")


_samplers: dict[tuple[str, float], Sampler] = {}


def sampler(path: str, temperature: float) -> Sampler:
    if (path, temperature) not in _samplers:
        _samplers[path, temperature] = Sampler(path, temperature)
    return _samplers[path, temperature]


def sampled_pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", model_path: str | None = None, temperature: float = 1.0) -> DataFrame:
    """``(key, ids, n_ids, lossless)`` for every document.

    ``ids`` is a segmentation of the whole text, drawn with the key as seed;
    ``lossless`` says that decoding it gave the text back.  Null and empty
    texts have no ids (and are lossless).  Equal texts with different keys are
    drawn apart; rows that repeat a key and text repeat the segmentation.  An
    empty table gives an empty result; other columns are ignored.  A task's
    memory grows with its longest text.
    """
    path = model_path or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = sampler(path, temperature)
        for batch in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
            at = 0
            while at < len(sizes):
                stop = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + AT_ONCE, "right")))
                some = batch.slice(at, stop - at)
                names = ["" if k is None else str(k) for k in some.column(0).to_pylist()]
                texts = [t or "" for t in some.column(1).to_pylist()]
                ids, n = s.sample(names, texts)
                ends = np.r_[0, np.cumsum(n)]
                cuts = ends.tolist()
                same = [s.decode(ids[a:b].tolist()) == t for a, b, t in zip(cuts[:-1], cuts[1:], texts, strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([some.column(0), lists, pa.array(n, pa.int64()), pa.array(same)], ["k", "ids", "n_ids", "lossless"])
                at = stop

    d = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t"))
    kind = d.schema["k"].dataType.simpleString()
    return d.mapInArrow(run, f"k {kind}, ids array<int>, n_ids bigint, lossless boolean").withColumnRenamed("k", key)


def decoded(pieces: DataFrame, key: str = "doc_id", ids: str = "ids", model_path: str | None = None) -> DataFrame:
    """``(key, text)`` from lists of ids."""
    path = model_path or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = sampler(path, 1.0)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())], ["k", "text"])

    d = pieces.select(F.col(f"`{key}`").alias("k"), F.col(f"`{ids}`").alias("i"))
    kind = d.schema["k"].dataType.simpleString()
    return d.mapInArrow(run, f"k {kind}, text string").withColumnRenamed("k", key)
