"""Token ids on disk: an adaptive context-mixing range coder.

A block holds the ids of whole documents and stands alone: its model starts
afresh and a checksum closes it, so any block can be lost, moved or read by
itself.  Within a block the ids are cut into lanes that are coded in lockstep
and share one model, which makes every step a handful of vector operations.

Model.  Three predictions are mixed for every id: order 2, the id last seen
after the two previous ones, with a confidence that grows as it holds; order 1,
the distribution of the ids seen after the previous one; order 0, the
distribution of all ids.  The mixing weights are adaptive counts, renewed at
every step, by the confidence of order 2 and by how much and how varied is what
order 1 has seen.  An id's probability is the weight of the first prediction
that holds it times its share there.  The distributions of order 0 and 1 are
counted anew whenever the ids seen have grown by half.

Coder.  A carry-less range coder with 64-bit state and 16-bit words; every lane
has its own words, all their lengths stand in the block.

Ids are numbered through the block, so any 32-bit ids will do: a block with
more than 2^16 different ones is coded as its 16-bit halves in turn.

Block layout (little endian): magic ``RLTB``, version, mode, lanes, ids,
alphabet size, bytes of the alphabet, documents, crc32 of the ids as 32-bit
integers, then document keys, key flags, document lengths, the alphabet's steps
(deflated), lane lengths, words.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ruleloom.llm.common import materialize, partitions

MAGIC = b"RLTB"
HEAD = struct.Struct("<4sBBIIIIII")
#: Ids in a block, unless one document alone has more.
BLOCK_IDS = 1 << 21
LANES = 8192
#: Precision of the weights and of the distributions.
FLAG_BITS, ID_BITS = 12, 18
_BITS = FLAG_BITS + ID_BITS
#: Different symbols in a block.
MOST_SYMBOLS = 1 << 16
_TOP, _BOTTOM, _WORD = np.uint64(1 << 48), np.uint64((1 << 32) - 1), np.uint64(16)
_FULL, _NONE, _ONE = np.uint64(1 << ID_BITS), np.uint64(0), np.uint64(1)
_LOW = np.uint64((1 << 20) - 1)
_SHIFT, _ALL = np.uint64(_BITS), np.uint64((1 << _BITS) - 1)
_ORDER2 = 18
#: Contexts of the weights: four confidences of order 2, sixteen states of order 1.
_CONTEXTS = 64
#: Steps of an encoder's look-ups at once.
_AHEAD = 8


def _order2(before2: np.ndarray, before1: np.ndarray) -> np.ndarray:
    return ((before2 << np.uint32(16) | before1) * np.uint32(0x9E3779B1) >> np.uint32(32 - _ORDER2)).astype(np.int64)


def _shares(total: np.ndarray, before: np.ndarray, bits, different, place: np.ndarray) -> np.ndarray:
    """Where a symbol's share begins in 2^bits: in proportion to the counts before it, at least one each."""
    # a quotient of such numbers is never as near to the next whole one as doubles are apart
    return (before * ((1 << bits) - different) / np.maximum(total, 1)).astype(np.int64) + place


def _packed(cum: np.ndarray, freq: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Begin and size of a share, and whose it is, in one number: one look-up gets all."""
    return (ids << 40 | freq << 20 | cum).astype(np.uint64)


def _cum(packed: np.ndarray) -> np.ndarray:
    return packed & _LOW


def _freq(packed: np.ndarray) -> np.ndarray:
    return packed >> np.uint64(20) & _LOW


class _Model:
    """Predictions and their weights, alike in coder and decoder."""

    def __init__(self, size: int):
        self.size = size
        self.second = np.zeros(1 << _ORDER2, np.int32)  # (id + 1, confidence)
        self.flags = np.repeat(np.array([2, 4, 2], np.int64), _CONTEXTS)
        self.counts = np.zeros(size, np.int64)
        self.seen, self.next = 0, 8192
        self.count_order0()
        self.state = np.zeros(size, np.int64)
        self.weigh()

    def weigh(self) -> None:
        a, b, c = self.flags.reshape(3, _CONTEXTS)
        total, room = a + b + c, (1 << FLAG_BITS) - 3
        a, b = 1 + a * room // total, 1 + b * room // total
        self.bound1, self.bound2 = a, a + b
        self.weight = np.concatenate((a, b, (1 << FLAG_BITS) - self.bound2)).astype(np.uint64)
        self.below = (np.concatenate((np.zeros(_CONTEXTS, np.int64), a, self.bound2)) << ID_BITS).astype(np.uint64)

    def count_order0(self) -> None:
        cum = np.r_[0, np.cumsum(2 * self.counts + 1)]
        self.edges = _shares(cum[-1], cum, ID_BITS, self.size, np.arange(self.size + 1))
        self.share0 = _packed(self.edges[:-1], np.diff(self.edges), np.arange(self.size))
        self.next = max(8192, self.seen + self.seen // 2)

    def count_order1(self, row: np.ndarray, ids: np.ndarray, count: np.ndarray) -> None:
        """From pairs in ascending order: the id before (``row``), the id, how often each pair was seen."""
        different = np.bincount(row, minlength=self.size)
        self.start = np.cumsum(different) - different
        cum = np.r_[0, np.cumsum(count)]
        total = cum[self.start + different] - cum[self.start]
        # every row has 2^k slots, four to eight for each of its ids
        self.k = np.ceil(np.log2(np.maximum(4 * different, 1))).astype(np.int64)
        k = self.k[row]
        self.slots1 = _shares(total[row], cum[:-1] - cum[self.start[row]], k, different[row], np.arange(len(row)) - self.start[row])
        end = np.r_[self.slots1[1:], 0]
        last = (self.start + different - 1)[different > 0]
        end[last] = 1 << k[last]
        self.wide1 = end - self.slots1
        self.share1 = _packed(self.slots1 << ID_BITS - k, self.wide1 << ID_BITS - k, ids)
        varied = np.minimum(4 * different // np.maximum(total, 1), 3)
        self.state = 4 * (4 * np.searchsorted([1, 8, 64], total, "right") + varied)

    def learn(self, at: np.ndarray, guess: np.ndarray, hit: np.ndarray, ids1: np.ndarray, code: np.ndarray) -> None:
        """``ids1`` are the ids plus one, ``code`` is the context and the prediction that held."""
        held = guess + ((guess & 3) < 3)
        failed = np.where(guess & 2, guess - 2, ids1 << 2)
        self.second[at] = np.where(hit, held, failed)
        self.flags += np.bincount(code, minlength=3 * _CONTEXTS)
        self.weigh()
        self.seen += len(at)


def _shape(n: int) -> tuple[int, int]:
    """Lanes, and steps of each; the last lanes may lack the last step."""
    lanes = max(1, min(LANES, n // 64))
    return lanes, -(-n // lanes)


def _cut(ids: np.ndarray, lanes: int) -> list[tuple[slice, slice, np.ndarray]]:
    """(steps, lanes, their ids by lane) in two parts: the first lanes are one longer if it doesn't come out even."""
    each, more = divmod(len(ids), lanes)
    longer = more * (each + 1)
    first = [(slice(0, each + 1), slice(0, more), ids[:longer].reshape(more, each + 1))] if more else []
    return [*first, (slice(0, each), slice(more, lanes), ids[longer:].reshape(lanes - more, each))]


def _settled(low: np.ndarray, width: np.ndarray) -> np.ndarray:
    """The lanes whose first word is settled, or whose range is too narrow to go on."""
    differ = low + width
    differ ^= low
    out = differ < _TOP
    out |= width <= _BOTTOM
    return np.flatnonzero(out)


def _shifted(low: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """State after a word has gone; a range over the word's border is cut off there."""
    over = (low ^ (low + width)) >= _TOP
    if over.any():
        width[over] = (~low[over] + _ONE) & _BOTTOM
    return low << _WORD, width << _WORD


def _numbered_pairs(before: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of each pair in ascending order, first and second id of each different pair)."""
    both = np.empty((len(ids), 2), "<u4")  # the place below, the pair above
    both[:, 0] = np.arange(len(ids), dtype=np.uint32)
    both[:, 1] = before << np.uint32(16) | ids
    both = both.reshape(-1).view("<u8")
    both.sort()
    both = both.view("<u4")
    pairs = both[1::2].copy()
    first = np.empty(len(ids), bool)
    first[:1] = True
    np.not_equal(pairs[1:], pairs[:-1], out=first[1:])
    number = np.empty(len(ids), np.int32)
    number[both[::2].astype(np.intp)] = np.cumsum(first, dtype=np.int32) - np.int32(1)
    pairs = pairs[first].astype(np.int64)
    return number, pairs >> 16, pairs & 0xFFFF


def compress(ids: np.ndarray, size: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(lanes, words of each lane, all words by lane) of ids below ``size``."""
    n = len(ids)
    lanes, steps = _shape(n)
    full = n - lanes * (steps - 1)  # lanes that take the last step
    table = np.zeros((steps + 2, lanes), np.uint32)
    for step, lane, part in _cut(ids, lanes):
        table[2:][step, lane] = part.T
    pair, row, second = _numbered_pairs(table[1:-1].reshape(-1)[:n], table[2:].reshape(-1)[:n])
    pair = np.r_[pair, np.zeros(lanes * steps - n, np.int32)].reshape(steps, lanes)
    count = np.zeros(len(row), np.int64)
    share1 = np.zeros(len(row), np.uint64)
    model = _Model(size)
    low, width = np.zeros(lanes, np.uint64), np.full(lanes, np.iinfo(np.uint64).max, np.uint64)
    out_lane, out_word = [], []
    t = counted = 0
    while t < steps:
        ahead = min(steps - t, _AHEAD, -(-(model.next - model.seen) // lanes))
        # an index of another type is cast bit by bit, more slowly
        x, before1 = table[t + 2 : t + ahead + 2].astype(np.intp), table[t + 1 : t + ahead + 1]
        at, x1, p = _order2(table[t : t + ahead], before1), x.astype(np.int32) + np.int32(1), pair[t : t + ahead].astype(np.intp)
        share = share1[p]
        known = share > _NONE
        share = np.where(known, share, model.share0[x])
        cum, freq = _cum(share), _freq(share)
        flag, state = np.where(known, _CONTEXTS, 2 * _CONTEXTS), model.state[before1.astype(np.intp)]
        for j in range(ahead):
            now = slice(0, lanes if t + j < steps - 1 else full)
            where, c, f = at[j, now], cum[j, now], freq[j, now]
            guess = model.second[where]
            hit = (guess >> 2) == x1[j, now]
            code = state[j, now] + (guess & 3)
            code += flag[j, now] * ~hit
            np.putmask(c, hit, _NONE)
            np.putmask(f, hit, _FULL)
            weight = model.weight[code]
            c *= weight
            c += model.below[code]
            f *= weight
            r = width[now] >> _SHIFT
            lo = r * c
            lo += low[now]
            r *= f
            left = _settled(lo, r)
            while len(left):
                a, w = lo[left], r[left]
                out_lane.append(left)
                out_word.append((a >> np.uint64(48)).astype(np.uint16))
                a, w = _shifted(a, w)
                lo[left], r[left] = a, w
                left = left[_settled(a, w)]
            low[now], width[now] = lo, r
            model.learn(where, guess, hit, x1[j, now], code)
        t += ahead
        if model.seen >= model.next and t < steps:
            new = slice(counted * lanes, t * lanes)
            count += np.bincount(pair.reshape(-1)[new], minlength=len(row))
            model.counts += np.bincount(table[2:].reshape(-1)[new], minlength=size)
            counted = t
            model.count_order0()
            there = np.flatnonzero(count)
            model.count_order1(row[there], second[there], count[there])
            share1[there] = model.share1
    for _ in range(4):
        out_lane.append(np.arange(lanes))
        out_word.append((low >> np.uint64(48)).astype(np.uint16))
        low <<= _WORD
    lane, word = np.concatenate(out_lane), np.concatenate(out_word)
    return lanes, np.bincount(lane, minlength=lanes), word[np.argsort(lane.astype(np.uint16), kind="stable")]


class _Pairs:
    """Pairs that a decoder has seen, in ascending order, and their slots."""

    def __init__(self, size: int):
        self.size = np.uint32(size)
        self.keys, self.count = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def add(self, before: np.ndarray, ids: np.ndarray, model: _Model) -> None:
        new = np.sort(before * self.size + ids)
        first = np.flatnonzero(np.r_[True, new[1:] != new[:-1]])
        keys = np.concatenate((self.keys, new[first]))
        count = np.concatenate((self.count, np.diff(np.r_[first, len(new)])))
        order = np.argsort(keys, kind="stable")
        keys, count = keys[order], count[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        self.keys, self.count = keys[first], np.add.reduceat(count, first)
        row = (self.keys // self.size).astype(np.int64)
        model.count_order1(row, self.keys.astype(np.int64) - row * int(self.size), self.count)
        slots = np.where(np.diff(np.r_[model.start, len(row)]) > 0, 1 << model.k, 0)
        self.base, self.shift = np.cumsum(slots) - slots, ID_BITS - model.k
        self.pair_at = np.repeat(np.arange(len(row), dtype=np.int32), model.wide1)

    def find(self, before: np.ndarray, target: np.ndarray) -> np.ndarray:
        return self.pair_at[self.base[before] + (target >> self.shift[before])]


def expand(n: int, size: int, lanes: int, lengths: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The ids that ``compress`` was given."""
    steps = -(-n // lanes)
    full = n - lanes * (steps - 1)
    model, pairs = _Model(size), _Pairs(size)
    slot0 = np.repeat(np.arange(size, dtype=np.uint16), np.diff(model.edges))
    words = np.r_[words.astype(np.uint64), np.zeros(8, np.uint64)]
    at_word = np.cumsum(lengths) - lengths
    low, width, code = np.zeros(lanes, np.uint64), np.full(lanes, np.iinfo(np.uint64).max, np.uint64), np.zeros(lanes, np.uint64)
    for _ in range(4):
        code = code << _WORD | words[at_word]
        at_word += 1
    table = np.zeros((steps + 2, lanes), np.uint32)
    counted = 0
    for t in range(steps):
        now = slice(0, lanes if t < steps - 1 else full)
        where = _order2(table[t, now], table[t + 1, now])
        before1 = table[t + 1, now].astype(np.intp)
        guess = model.second[where]
        context = model.state[before1] + (guess & 3)
        r = width[now] >> _SHIFT
        value = (code[now] - low[now]) // r
        np.minimum(value, _ALL, out=value)
        part = (value >> np.uint64(ID_BITS)).astype(np.int64)
        flag = (part >= model.bound1[context]).astype(np.int64)
        flag += part >= model.bound2[context]
        held = context + flag * _CONTEXTS
        weight, c = model.weight[held], model.below[held]
        target = ((value - c).astype(np.float64) / weight).astype(np.int64)  # exact: both are below 2^30
        x, f = ((guess >> 2) - 1).astype(np.uint32), np.full(len(where), _FULL)
        i = np.flatnonzero(flag == 1)
        if len(i):
            if not len(pairs.keys):
                raise ValueError("a block of token ids is damaged")
            share = model.share1[pairs.find(before1[i], target[i])]
            x[i], f[i] = share >> np.uint64(40), _freq(share)
            c[i] += _cum(share) * weight[i]
        i = np.flatnonzero(flag == 2)
        if len(i):
            share = model.share0[slot0[target[i]]]
            x[i], f[i] = share >> np.uint64(40), _freq(share)
            c[i] += _cum(share) * weight[i]
        if x.max() >= size:
            raise ValueError("a block of token ids is damaged")
        lo = r * c
        lo += low[now]
        f *= weight
        r *= f
        given = code[now]
        left = _settled(lo, r)
        while len(left):
            a, w = _shifted(lo[left], r[left])
            at = at_word[left]
            given[left] = given[left] << _WORD | words[np.minimum(at, len(words) - 1)]
            at_word[left] = at + 1
            lo[left], r[left] = a, w
            left = left[_settled(a, w)]
        low[now], width[now] = lo, r
        table[t + 2, now] = x
        model.learn(where, guess, flag == 0, (x + np.uint32(1)).astype(np.int32), held)
        if model.seen >= model.next and t < steps - 1:
            new = table[counted + 2 : t + 3].reshape(-1)
            model.counts += np.bincount(new, minlength=size)[:size]
            model.count_order0()
            slot0 = np.repeat(np.arange(size, dtype=np.uint16), np.diff(model.edges))
            pairs.add(table[counted + 1 : t + 2].reshape(-1), new, model)
            counted = t + 1
    out = np.zeros(n, np.uint32)
    for step, lane, part in _cut(out, lanes):
        part[:] = table[2:][step, lane].T
    return out


def _alphabet(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the different ids in order, number of each id)."""
    if int(ids.max()) < 1 << 22:
        symbols = np.flatnonzero(np.bincount(ids))
        number = np.zeros(int(symbols[-1]) + 1, np.uint32)
        number[symbols] = np.arange(len(symbols), dtype=np.uint32)
        return symbols, number[ids.astype(np.intp)]
    symbols, number = np.unique(ids, return_inverse=True)
    return symbols.astype(np.int64), number.astype(np.uint32)


def pack_block(keys: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """One block of whole documents; ids are unsigned 32-bit integers."""
    ids = np.asarray(ids, dtype="<u4")
    check = zlib.crc32(ids.tobytes())
    table = np.array([k or 0 for k in keys], "<i8").tobytes() + bytes(k is None for k in keys) + np.array(lengths, "<u4").tobytes()
    if not len(ids):
        return HEAD.pack(MAGIC, 2, 0, 0, 0, 0, 0, len(keys), check) + table
    mode, (symbols, numbers) = 1, _alphabet(ids)
    if len(symbols) > MOST_SYMBOLS:
        mode, (symbols, numbers) = 2, _alphabet(ids.view("<u2").astype(np.uint32))
    steps = zlib.compress(np.diff(symbols, prepend=0).astype("<u4").tobytes())
    lanes, each, words = compress(numbers, len(symbols))
    return HEAD.pack(MAGIC, 2, mode, lanes, len(ids), len(symbols), len(steps), len(keys), check) + table + steps + each.astype("<u4").tobytes() + words.astype("<u2").tobytes()


def unpack_block(block: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(keys, lengths, ids) of a block; raises if it isn't whole."""
    magic, version, mode, lanes, n, size, deflated, docs, check = HEAD.unpack_from(block)
    if magic != MAGIC or version != 2:
        raise ValueError("not a block of token ids")
    at = HEAD.size
    keys = np.frombuffer(block, "<i8", docs, at)
    null = np.frombuffer(block, np.uint8, docs, at + 8 * docs)
    lengths = np.frombuffer(block, "<u4", docs, at + 9 * docs).astype(np.int64)
    at += 13 * docs
    ids = np.zeros(0, "<u4")
    if mode:
        symbols = np.cumsum(np.frombuffer(zlib.decompress(block[at : at + deflated]), "<u4").astype(np.int64))
        at += deflated
        each = np.frombuffer(block, "<u4", lanes, at).astype(np.int64)
        words = np.frombuffer(block, "<u2", int(each.sum()), at + 4 * lanes)
        numbers = expand(n * mode, size, lanes, each, words)
        ids = symbols.astype("<u4")[numbers] if mode == 1 else symbols.astype("<u2")[numbers].view("<u4")
    if zlib.crc32(ids.tobytes()) != check or int(lengths.sum()) != n:
        raise ValueError("a block of token ids is damaged")
    return [None if z else int(k) for k, z in zip(keys, null, strict=True)], lengths, ids


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: Different pieces that an encoder remembers before it starts afresh.
CACHED_PIECES = 1_200_000
#: A word and the marks behind it: a byte-level tokenizer splits between them.
_WORD_BEFORE = "^[A-Za-zÀ-ÖØ-öø-ɏ]+"
_MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")
_MARKED = _WORD_BEFORE + r"[!-&(-/:-@\[-`{-~]+$"
#: The same, or a word alone, at the end of a line, and another on the next: a line's end between them stands alone.
_BROKEN = _WORD_BEFORE + r"[!-&(-/:-@\[-`{-~]*\n" + _WORD_BEFORE[1:] + r"[!-&(-/:-@\[-`{-~]*$"
#: Bytes of text that are split into pieces at once.
AT_ONCE = 1 << 24


class Encoder:
    """Whole-text encoding with the tokenizers library.

    A byte-level tokenizer splits before any space that a visible character
    follows, so a text's ids are those of its space-separated pieces in turn.
    Arrow finds the distinct pieces of some texts and parts words from the marks
    behind them and from the next line's word; new ones are encoded together, many
    in a call, and told apart by their bytes, and remembered.  A word with marks,
    or two words with a line's end between them, are put together anew.
    Texts with runs of white space around a space or with one of the
    tokenizer's added tokens, and tokenizers of other kinds, are encoded whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            kind = json.load(f)
        pre = kind.get("pre_tokenizer") or {}
        #: Tokens that the library finds in a text before it splits it.
        self.added = [t["content"] for t in kind.get("added_tokens") or []]
        self.by_piece = kind.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        self.by_piece = self.by_piece and not any(" " in t for t in self.added)
        if self.by_piece:  # one character of a byte-level token is one byte
            self.bytes_of = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
            for token, i in self.tokenizer.get_vocab().items():
                self.bytes_of[i] = len(token)
        self._forget()

    def _forget(self) -> None:
        """No pieces: place 0 stands for those that can't be encoded alone, place 1 for nothing."""
        self.place: dict[str, int] = {}
        self.on_line: dict[str, int] = {}
        self.marks: dict[str, int] = {}
        self.ids, self.start, self.size = np.zeros(1 << 20, "<u4"), np.zeros(1 << 18, np.int64), np.zeros(1 << 18, np.int64)
        self.used, self.places = 0, 2

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _add(self, ids: np.ndarray, sizes: np.ndarray) -> int:
        """Keep the ids of some pieces; returns the place of the first."""
        first, n = self.places, len(sizes)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.r_[self.ids, np.zeros_like(self.ids)]
        while first + n > len(self.start):
            self.start, self.size = np.r_[self.start, np.zeros_like(self.start)], np.r_[self.size, np.zeros_like(self.size)]
        self.ids[self.used : self.used + len(ids)] = ids
        self.start[first : first + n], self.size[first : first + n] = self.used + np.cumsum(sizes) - sizes, sizes
        self.used += len(ids)
        self.places += n
        return first

    def _kept(self, places: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The ids at some places, one after the other; ``lengths`` may leave out some."""
        stops = np.cumsum(lengths)
        return self.ids[np.repeat(self.start[places] - stops + lengths, lengths) + np.arange(int(stops[-1]) if len(stops) else 0)]

    def _encode_pieces(self, names: list[str], before: str = " ") -> int:
        """Encode pieces together, each with a space or the end of a line before it; returns the place of the first."""
        pieces = pa.array(names, pa.string())
        sizes = pc.binary_length(pieces).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        cuts = np.unique(np.r_[np.arange(0, len(names), 64), len(names)])
        groups = pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pieces), before).to_pylist()
        ids = np.concatenate([np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast([before + g for g in groups], add_special_tokens=False)])
        # a piece ends with the token that ends at its last byte
        ends = np.searchsorted(np.cumsum(self.bytes_of[ids]), np.cumsum(sizes), "left") + 1
        first = self._add(ids, np.diff(ends, prepend=0))
        return first

    def _learn(self, names: list[str], before: str) -> np.ndarray:
        """Places for new pieces, each of them once."""
        pieces, added = pa.array(names, pa.string()), np.zeros(len(names), bool)
        for token in self.added:
            added |= pc.match_substring(pieces, token).to_numpy(zero_copy_only=False)
        heads = pc.utf8_slice_codeunits(pieces, 0, 1).dictionary_encode()
        spaces = np.array([not c or c.isspace() for c in heads.dictionary.to_pylist()])
        added |= spaces[heads.indices.to_numpy(zero_copy_only=False)]
        place = np.zeros(len(names), np.int64)
        alone = names if not added.any() else [names[i] for i in np.flatnonzero(~added).tolist()]
        if alone:
            place[~added] = self._encode_pieces(alone, before) + np.arange(len(alone))
        return place

    def _places(self, names: list[str], before: str = " ") -> np.ndarray:
        """The place of each piece; new ones are learnt."""
        known = self.place if before == " " else self.on_line
        place = np.fromiter(map(known.get, names, repeat(-1)), np.int64, len(names))
        unknown = np.flatnonzero(place < 0)
        if len(unknown):
            new = [names[i] for i in unknown.tolist()]
            place[unknown] = learnt = self._learn(new, before)
            known.update(zip(new, learnt.tolist(), strict=True))
        return place

    def _mark(self, mark: str) -> int:
        if mark not in self.marks:
            ids = np.array(self.tokenizer.encode(mark, add_special_tokens=False).ids, "<u4")
            self.marks[mark] = self._add(ids, np.array([len(ids)]))
        return self.marks[mark]

    def _marks(self, marks: pa.Array) -> np.ndarray:
        """The places of runs of marks; an empty run is nothing."""
        marks = marks.dictionary_encode()
        return np.array([self._mark(m) if m else 1 for m in marks.dictionary.to_pylist()], np.int64)[marks.indices.to_numpy(zero_copy_only=False)]

    def _parts(self, names: pa.Array) -> np.ndarray:
        """Four places for each piece: a word, the marks behind it, a word on the next line, the marks behind that; or the piece and nothing."""
        is_marked, has_line = pc.match_substring_regex(names, _MARKED), pc.match_substring(names, "\n")
        is_broken = pc.replace_with_mask(has_line, has_line, pc.match_substring_regex(names.filter(has_line), _BROKEN))
        for token in self.added:
            has_added = pc.match_substring(names, token)
            is_marked, is_broken = pc.and_not(is_marked, has_added), pc.and_not(is_broken, has_added)
        marked, broken = names.filter(is_marked), pc.split_pattern(names.filter(is_broken), "\n")
        above, below = pc.list_element(broken, 0), pc.list_element(broken, 1)
        ends = pa.concat_arrays([marked, above])
        others = pa.concat_arrays([names.filter(pc.invert(pc.or_(is_marked, is_broken))), pc.utf8_rtrim(ends, _MARKS)]).dictionary_encode()
        lines = pc.utf8_rtrim(below, _MARKS).dictionary_encode()
        place = self._places(others.dictionary.to_pylist())[others.indices.to_numpy(zero_copy_only=False)]
        marked_at, broken_at = np.flatnonzero(is_marked.to_numpy(zero_copy_only=False)), np.flatnonzero(is_broken.to_numpy(zero_copy_only=False))
        parts, alone = np.ones((len(names), 4), np.int64), np.ones(len(names), bool)
        cut = np.concatenate((marked_at, broken_at))
        alone[cut] = False
        parts[np.concatenate((np.flatnonzero(alone), cut)), 0] = place
        parts[cut, 1] = self._marks(pc.replace_substring_regex(ends, _WORD_BEFORE, ""))
        if len(broken_at):
            parts[broken_at, 2] = self._places(lines.dictionary.to_pylist(), "\n")[lines.indices.to_numpy(zero_copy_only=False)]
            parts[broken_at, 3] = self._marks(pc.replace_substring_regex(below, _WORD_BEFORE, ""))
        return parts

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        if not self.by_piece:
            return self._whole(texts.to_pylist())
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        out, at = [], 0
        while at < len(texts):
            stop = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + AT_ONCE, "right")))
            out += self._some(texts.slice(at, stop - at))
            at = stop
        return out

    def _some(self, texts: pa.Array) -> list[bytes]:
        if self.places > CACHED_PIECES:
            self._forget()
        pieces = pc.split_pattern(texts, " ")
        flat = pieces.flatten().dictionary_encode()
        number = flat.indices.to_numpy(zero_copy_only=False)
        ends = np.cumsum(pc.list_value_length(pieces).to_numpy(zero_copy_only=False))
        first = np.r_[0, ends[:-1]]
        names = flat.dictionary
        parts = self._parts(names)
        # a text with white space next to a space is encoded whole, others piece by piece
        odd = (parts == 0).any(axis=1).astype(np.int64)
        whole = np.add.reduceat(odd[number], first) > 0
        sizes = self.size[parts]
        size = sizes.sum(axis=1)
        # the ids of each piece as bytes, and none for the first piece of a text
        stops = 4 * np.cumsum(size)
        held = [None, pa.py_buffer(np.r_[0, stops, stops[-1]]), pa.py_buffer(self._kept(parts.reshape(-1), sizes.reshape(-1)))]
        rows = pa.Array.from_buffers(pa.large_binary(), len(names) + 1, held)
        at = number.copy()
        at[first] = len(names)
        _, offsets, placed = rows.take(pa.array(at)).buffers()
        placed = memoryview(placed or b"")
        cut = np.frombuffer(offsets, np.int64, len(at) + 1)[ends].tolist()
        heads = iter(self._whole(names.take(pa.array(number[first[~whole]])).to_pylist()))
        wholes = iter(self._whole([texts[i].as_py() for i in np.flatnonzero(whole).tolist()]))
        return [next(wholes) if w else next(heads) + placed[a:b] for w, a, b in zip(whole.tolist(), [0, *cut[:-1]], cut, strict=True)]


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def write_blocks(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer_path: str | None = None, end_id: int = 0, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Encode whole texts and write them in ascending order of the key.

    Returns the written table ``(file_no, block_no, n_ids, block)``: file
    ``f`` holds the keys between those of files ``f - 1`` and ``f + 1``, its
    blocks are numbered in order.  Rows are range-partitioned by key and by
    where they were read, so a key with very many rows (null, for one) spreads
    over files; no task holds more than a block and a batch of texts.
    """
    path = tokenizer_path or default_tokenizer()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, file_no, number = _encoder(path).encode, TaskContext.get().partitionId(), 0
        keys, lengths, parts, held = [], [], [], 0

        def block() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(parts), "<u4")
            row = [pa.array([file_no], pa.int32()), pa.array([number], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([pack_block(keys, lengths, ids)], pa.binary())]
            return pa.RecordBatch.from_arrays(row, ["file_no", "block_no", "n_ids", "block"])

        for batch in batches:
            for k, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1)), strict=True):
                ids += end
                if held and held + len(ids) // 4 > block_ids:
                    yield block()
                    number += 1
                    keys, lengths, parts, held = [], [], [], 0
                keys.append(k)
                lengths.append(len(ids) // 4)
                parts.append(ids)
                held += len(ids) // 4
        if keys:
            yield block()

    d = docs.select(F.col(f"`{key}`").cast("bigint").alias("k"), F.col(f"`{text}`").alias("t"))
    d = d.withColumn("n", F.monotonically_increasing_id()).repartitionByRange(partitions(docs.sparkSession), "k", "n").sortWithinPartitions("k", "n").select("k", "t")
    return materialize(d.mapInArrow(run, "file_no int, block_no int, n_ids bigint, block binary"), "ids")


def read_blocks(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Decode written blocks: ``(key, start, n_tokens, ids_crc32)`` for every document.

    ``start`` counts the ids of all documents before it.  Offsets come from
    the blocks' sizes in two levels: files, then blocks of a file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f, b, packed in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                keys, lengths, ids = unpack_block(packed)
                raw, ends = memoryview(ids.tobytes()), np.cumsum(lengths)
                begins = ends - lengths
                crc = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(begins.tolist(), ends.tolist(), strict=True)]
                n = len(keys)
                row = [pa.array(np.full(n, f, np.int32)), pa.array(np.full(n, b, np.int32)), pa.array(keys, pa.int64()), pa.array(begins), pa.array(lengths), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(row, ["f", "b", "k", "at", "n_tokens", "ids_crc32"])

    sizes = blocks.select("file_no", "block_no", "n_ids")
    files = sizes.groupBy("file_no").agg(F.sum("n_ids").alias("in_file"))
    all_before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    files = files.select(F.col("file_no").alias("f"), F.coalesce(F.sum("in_file").over(all_before), F.lit(0)).alias("file_start"))
    w = Window.partitionBy("file_no").orderBy("block_no").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("in_file", F.coalesce(F.sum("n_ids").over(w), F.lit(0)))
    starts = starts.join(files, F.col("file_no") == F.col("f")).select("file_no", "block_no", (F.col("file_start") + F.col("in_file")).alias("block_start"))
    read = blocks.select("file_no", "block_no", "block").mapInArrow(run, "f int, b int, k bigint, at bigint, n_tokens bigint, ids_crc32 bigint")
    placed = read.join(starts, (F.col("file_no") == F.col("f")) & (F.col("block_no") == F.col("b")))
    return placed.select(F.col("k").alias(key), (F.col("block_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_ids(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer_path: str | None = None, end_id: int = 0, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Encode, write, read back: ``(key, start, n_tokens, ids_crc32)``.

    A null or empty text has only the end id.  Null keys come first; rows that
    repeat a key follow each other in any order.  An empty table gives an
    empty result; other columns are ignored.  A document longer than a block
    gets a block of its own, so a task's memory grows with its longest text.
    """
    return read_blocks(write_blocks(docs, key, text, tokenizer_path, end_id, block_ids), key)
