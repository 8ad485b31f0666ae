"""The language model behind lm_scoring: logistic mixing of bit predictors, as functions on arrays.

A word is coded by the bits of its bytes and a stop, under a Huffman code of the
training bytes, so that a frequent byte takes few binary decisions.  Each bit is
predicted twice over:

* `Speller`, within the word: hashed contexts (the last one to four bytes, and
  the word's whole beginning) index tables of counts; their logits are added
  with weights from a gate and corrected by a refinement table.
* `Mixer`, across words: the counts of the bit after the same previous word and
  after the same two previous words.  The speller's logit and those of the two
  contexts are added with weights from a gate (how much, and how one-sidedly,
  each context has counted), again refined by a table.  Weights and table learn
  online, apart in each set of contexts: a bit's place of all occurrences of a
  set is predicted before it is learnt from, so other sets beside it change nothing.

A training occurrence is always predicted from counts that leave it out, so
weights learn what holds for other texts and a text that occurs once gains
nothing from having been counted itself.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np

from notefold.llm.setsketch import mix

#: Bytes before a bit that contexts within the word take in; the last context is the whole beginning.
LAST = (1, 2, 3, 4)
ORDERS = len(LAST) + 1
#: Tables of short contexts have fewer slots, by these powers of two.
FEWER = (5, 3, 1, 0, 0)
#: Bytes of a word's beginning that its own context takes in; later bytes share one.
BEGINNING = 32
LEVELS = 33
#: Bits of a word for which contexts across words have counts; later bits are the speller's.
HEAD = 64
#: Groups that are predicted at once.
PORTION = 1 << 16
STOP = 10
_DEPTHS = 8
_A = np.uint64(0x9E3779B97F4A7C15)
_LIMIT = 12.0
_CLASSES = 6


class Code:
    """A Huffman code of bytes from their counts; every byte that a word can hold, and the stop, has one."""

    def __init__(self, counts: dict[int, int]):
        total = max(1, sum(counts.values()))
        heap = [(1 + (counts.get(s, 0) << 20) // total, s) for s in range(256) if s == STOP or s not in (9, 11, 12, 13, 32)]
        heapq.heapify(heap)
        children: list[tuple[int, int]] = []
        while len(heap) > 1:
            (m, a), (n, b) = heapq.heappop(heap), heapq.heappop(heap)
            heapq.heappush(heap, (m + n, 256 + len(children)))
            children.append((a, b))
        each: list[list[tuple[int, int]]] = [[]] * 256
        todo: list[tuple[int, list[tuple[int, int]]]] = [(heap[0][1], [])]
        while todo:
            at, path = todo.pop()
            if at < 256:
                each[at] = path
            else:
                todo += [(child, [*path, (at - 256, bit)]) for bit, child in enumerate(children[at - 256])]
        self.length = np.array([len(p) for p in each], np.int32)
        self.start = np.cumsum(self.length, dtype=np.int32) - self.length
        self.node = (mix(np.array([n for p in each for n, _ in p], np.uint64) * _A + _A) >> np.uint64(32)).astype(np.uint32)
        self.bit = np.array([b for p in each for _, b in p], np.int8)
        self.value = np.array([sum(b << k for k, (_, b) in enumerate(reversed(p))) for p in each], np.uint64)

    def heads(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The first HEAD bits of each word with its stop, from the top of a 64-bit number, and how many bits it has."""
        raw, begin, size = flat(words)
        length = self.length[raw]
        total = np.cumsum(length)
        at = total - length
        at -= np.repeat(at[begin], size)
        room = HEAD - at - length
        own = self.value[raw]
        own = np.where(room >= 0, own << np.maximum(room, 0).astype(np.uint64), own >> np.clip(-room, 0, 63).astype(np.uint64))
        own[room <= -length] = 0
        return np.bitwise_or.reduceat(own, begin), np.add.reduceat(length, begin)


def flat(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of words, each with a stop, where each begins, and how many it has."""
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    return np.frombuffer(b"\n".join(words) + b"\n", np.uint8), np.cumsum(size) - size, size


def portions(words: list[bytes], most: int = 1 << 15) -> Iterator[slice]:
    """Words in portions of bounded bytes, unless one word has more."""
    end, start = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1), 0
    while start < len(words):
        stop = max(start + 1, int(np.searchsorted(end, (end[start - 1] if start else 0) + most, "right")))
        yield slice(start, stop)
        start = stop


def events(words: list[bytes], code: Code, table_bits: int, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For every bit of some words (but each one's first `skip`): slots by order, the bit, its depth within the byte, and bits by word."""
    small, begin, size = flat(words)
    raw, length, out = small.astype(np.uint64), code.length[small], np.int32(0)
    some = np.arange(len(raw))  # bytes of which bits are asked for
    if skip is not None:
        total = np.cumsum(length) - length
        out = np.clip(np.repeat(skip + total[begin], size) - total, 0, length).astype(np.int32)
        length = length - out
        some = np.flatnonzero(length)
    place = (some - np.repeat(begin, size)[some]).astype(np.int32)
    contexts, h = [], np.zeros(len(some), np.uint64)
    for k in range(1, LAST[-1] + 1):  # the k bytes before, or all there are
        older = raw.take(some - k, mode="clip")
        older += np.uint64(1)
        older[place < k] = 0
        h = mix(h * _A + older + np.uint64(k << 40))
        if k in LAST:
            contexts.append(h)
    whole, h, live, left = np.zeros(len(raw), np.uint64), np.full(len(begin), 7, np.uint64), begin, size  # the whole beginning, from byte to byte
    whole[begin] = 7
    for k in range(1, min(BEGINNING, int(size.max()))):
        stays = np.flatnonzero(left > k)
        left, live, h = left[stays], live[stays], h[stays]
        whole[live + k] = h = mix(h * _A + raw[live + k - 1] + np.uint64(1))
    contexts.append(whole[some])
    bits = np.add.reduceat(length, begin)
    small, length, out = small[some], length[some], np.broadcast_to(out, len(raw))[some]
    at = np.repeat(np.arange(len(some), dtype=np.int32), length)
    depth = np.arange(len(at), dtype=np.int32) - np.repeat(np.cumsum(length, dtype=np.int32) - length - out, length)
    path = code.start[small][at] + depth
    node, slots = code.node[path], np.empty((ORDERS, len(at)), np.int32)
    for k, (c, slot) in enumerate(zip(contexts, slots, strict=True)):
        c = (c >> np.uint64(32)).astype(np.uint32)[at]
        c += node
        c >>= np.uint32(32 - table_bits + FEWER[k])
        slot[:] = c
    return slots, code.bit[path], np.minimum(depth, _DEPTHS - 1), bits


def _refined(hits: np.ndarray) -> np.ndarray:
    """By gate and level, how often bits came true, held to the level itself where few did."""
    plain = 1 / (1 + np.exp(-(np.arange(LEVELS) / (LEVELS - 1) * 2 * _LIMIT - _LIMIT)))
    return ((hits[..., 1] + 8 * plain) / (hits.sum(-1) + 8)).astype(np.float32)


def _probability(logit: np.ndarray, gate: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a one: the mean of the mixed prediction and its correction, interpolated between levels; the mixed prediction; the nearest level."""
    plain = 1 / (1 + np.exp(-logit))
    at = (logit + np.float32(_LIMIT)) * np.float32((LEVELS - 1) / 2 / _LIMIT)
    low = np.minimum(at.astype(np.int32), LEVELS - 2)
    at -= low
    low += gate * LEVELS
    ref = table.ravel()
    under = ref.take(low)
    p = ref.take(low + 1)
    p -= under
    p *= at
    under += plain
    p += under
    p /= 2
    return np.clip(p, np.float32(1e-6), np.float32(1 - 1e-6), out=p), plain, low + (at > 0.5)


class Gated:
    """Weights by gate for a few inputs, their steps, and the refinement, learnt online from weighted bits."""

    def __init__(self, gates: int, start: list[float]):
        self.weights = np.tile(np.array(start), (gates, 1))
        self.step = np.full(self.weights.shape, 1e-3)
        self.hits = np.zeros((gates, LEVELS, 2))
        self._noted: list[list[np.ndarray]] = []

    def logit(self, inputs: list[np.ndarray], gate: np.ndarray) -> np.ndarray:
        weights = self.weights.T.astype(np.float32, order="C")
        out = weights[0].take(gate) * inputs[0]
        for own, x in zip(weights[1:], inputs[1:], strict=False):
            out += own.take(gate) * x
        return np.clip(out, np.float32(-_LIMIT), np.float32(_LIMIT), out=out)

    def note(self, inputs: list[np.ndarray], gate: np.ndarray, plain: np.ndarray, level: np.ndarray, bit: np.ndarray, times: np.ndarray) -> None:
        """Keep what was predicted (plain, at a level of the refinement) and what came."""
        miss = times * (bit - plain)
        self._noted.append([gate, level * 2 + bit, times, *(miss * x for x in inputs)])

    def settle(self) -> np.ndarray:
        """Learn from all that was noted since the last time, in one step; gives the gates that took part."""
        if not self._noted:
            return np.zeros(0, int)
        gate, place, times, *told = (np.concatenate(x) for x in zip(*self._noted, strict=True))
        used = np.zeros(len(self.weights), bool)
        used[gate] = True
        at, number = np.flatnonzero(used), np.cumsum(used, dtype=np.int32) - np.int32(1)
        place += (number[gate] - gate) * np.int32(2 * LEVELS)
        gate = number[gate]
        hits = np.bincount(place, times, len(at) * LEVELS * 2).reshape(-1, LEVELS, 2)
        self.hits[at] += hits
        n = np.maximum(hits.sum((1, 2)), 1)
        for k, x in enumerate(told):
            slope = np.bincount(gate, x, len(n)) / n
            self.step[at, k] += slope**2
            self.weights[at, k] += 0.05 * slope / np.sqrt(self.step[at, k])
        self._noted = []
        return at

    def learn(self, *told: np.ndarray) -> None:
        """Take in what was predicted and what came."""
        self.note(*told)
        self.settle()


class Speller:
    """Bits of words from hashed contexts within the word, under tables of counts."""

    def __init__(self, code: Code, table_bits: int):
        self.code, self.table_bits = code, table_bits
        self.gated = Gated(ORDERS * _DEPTHS, [0.35] * ORDERS)
        self.levels = _refined(self.gated.hits)

    def empty(self) -> list[np.ndarray]:
        """Tables by order: zeros and ones of slot s at 2s and 2s + 1."""
        return [np.zeros(2 << self.table_bits - f, np.float32) for f in FEWER]

    def count(self, tables: list[np.ndarray], words: list[bytes], times: np.ndarray, whole: np.ndarray) -> None:
        """Take in words, each so many times; their whole beginnings only where `whole` is set."""
        for part in portions(words):
            slots, bit, _, bits = events(words[part], self.code, self.table_bits)
            n = np.repeat(times[part].astype(np.float32), bits)
            for o in range(ORDERS - 1):
                np.add.at(tables[o], slots[o] * 2 + bit, n)
            np.add.at(tables[-1], slots[-1] * 2 + bit, n * np.repeat(whole[part], bits))

    def freeze(self, tables: list[np.ndarray]) -> list[np.ndarray]:
        """Logits of slot s (nothing known: zero): at 4s of all it has counted, at 4s + 1 without one zero, at 4s + 2 without one one."""
        self.logits = []
        for table in tables:
            own = np.zeros((len(table) // 2, 4), np.float32)
            for k, out in enumerate(((0, 0), (1, 0), (0, 1))):
                zero, one = np.maximum(table.reshape(-1, 2) - np.float32(out), 0).T
                own[:, k] = np.log((one + np.float32(0.1)) / (zero + np.float32(0.1)))
            self.logits.append(own.ravel())
        return self.logits

    def inputs(self, slots: np.ndarray, depth: np.ndarray, variant: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Logits of each order and the gate: how many of the longer contexts say something, and the bit's place."""
        out, gate = [], depth.copy()
        for o in range(ORDERS):
            x = self.logits[o].take(slots[o] * 4 + variant)
            if o:
                gate += (x != 0) * np.int32(_DEPTHS)
            out.append(x)
        return out, gate

    def learn(self, words: list[bytes], times: np.ndarray) -> None:
        """Learn weights and refinement online from words that are in the tables, each occurrence left out of them."""
        for part in portions(words):
            slots, bit, depth, bits = events(words[part], self.code, self.table_bits)
            x, gate = self.inputs(slots, depth, 1 + bit.astype(np.int32))
            _, plain, level = _probability(self.gated.logit(x, gate), gate, self.levels)
            self.gated.learn(x, gate, plain, level, bit, np.repeat(times[part].astype(float), bits))

    def spell(self, words: list[bytes], own: np.ndarray, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For every bit of words: the mixed logit of a one and the natural log of the bit's probability; and where each word begins.

        own: whether an occurrence is left out of the counts, by word.  skip: first bits of each word that are left out, none if not given.
        """
        if not words:
            return np.zeros(0, np.float32), np.zeros(0, np.float32), np.zeros(0, np.int64)
        logits, logs, sizes = [], [], []
        for part in portions(words):
            slots, bit, depth, size = events(words[part], self.code, self.table_bits, None if skip is None else skip[part])
            x, gate = self.inputs(slots, depth, (1 + bit) * np.repeat(own[part].astype(np.int32), size))
            logit = self.gated.logit(x, gate)
            p, _, _ = _probability(logit, gate, self.levels)
            logits.append(logit)
            logs.append(np.log(np.where(bit == 1, p, 1 - p)))
            sizes.append(size)
        size = np.concatenate(sizes)
        return np.concatenate(logits), np.concatenate(logs), np.cumsum(size) - size


class Groups:
    """Items in order of context and code, grouped by context and first bits, level by level.

    Items of a group are neighbours, and the first of them leads it: nothing is
    hashed.  At level t groups share t + 1 bits.  A group that divides keeps its
    leader for the zeros, and the first item with a one leads the others.
    """

    def __init__(self, context: np.ndarray, head: np.ndarray):
        shared = np.full(len(head), -1, np.int8)  # bits that an item shares with the one before; -1: not even the context
        same = np.flatnonzero(context[1:] == context[:-1]) + 1
        apart = head[same] ^ head[same - 1]
        bits = np.full(len(same), HEAD, np.int8)
        for k in (32, 16, 8, 4, 2, 1):  # leading zeros by halves
            high = apart >> np.uint64(k)
            some = high > 0
            bits[some] -= k
            apart = np.where(some, high, apart)
        shared[same] = bits - (apart > 0)
        self.shared, self.order = shared, np.argsort(shared, kind="stable")
        self.edge = np.cumsum(np.bincount(shared + 1, minlength=HEAD + 2))
        self.roots = self.order[: self.edge[0]]
        self._first = np.zeros(len(head), np.intp)
        self._first[self.roots] = self.roots
        self.lead = np.maximum.accumulate(self._first)

    def step(self, t: int) -> tuple[np.ndarray, np.ndarray]:
        """Go on to level t: what leads a group from now on, and what led it before."""
        new = self.order[self.edge[t] : self.edge[t + 1]]
        before = self.lead[new]
        if len(new):
            self._first[new] = new
            self.lead = np.maximum.accumulate(self._first)
        return new, before


class Trie(Groups):
    """Groups of distinct (context, word) pairs, with how often each group occurs in training and is asked for otherwise.

    other: of a group that comes of a division at this level, how often the other half occurs in training.
    """

    def __init__(self, context: np.ndarray, head: np.ndarray, length: np.ndarray, times: np.ndarray, asked: np.ndarray):
        super().__init__(context, head)
        self.head, self.length = head, np.minimum(length, HEAD + 1).astype(np.int8)
        self._sums = [np.r_[0, np.cumsum(x)] for x in (asked, times)]
        self.end = np.zeros(len(head), np.intp)
        self.end[self.roots] = np.r_[self.roots[1:], len(head)]
        self.counts = [np.zeros(len(head), np.int32) for _ in self._sums]  # asked, times
        for n, total in zip(self.counts, self._sums, strict=True):
            n[self.roots] = total[self.end[self.roots]] - total[self.roots]
        self.other, self._told = np.zeros(len(head), np.int32), self.roots

    def step(self, t: int) -> tuple[np.ndarray, np.ndarray]:
        new, before = super().step(t)
        self.other[self._told] = 0
        self.end[new], self.end[before] = self.end[before], new
        for n, total in zip(self.counts, self._sums, strict=True):
            n[new] = total[self.end[new]] - total[new]
            n[before] -= n[new]
        self.other[new], self.other[before] = self.counts[1][before], self.counts[1][new]
        self._told = np.r_[new, before]
        return new, before

    def bit(self, at: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
        """Bit t, and 1 for a one, -1 for a zero."""
        bit = (self.head.take(at) >> np.uint64(HEAD - 1 - t)).astype(np.int32) & 1
        return bit, (bit * 2 - 1).astype(np.float32)


class Spelt:
    """The speller's logits and logs along words in order of code, each beginning that words share spelt once."""

    def __init__(self, speller: Speller, words: list[bytes], head: np.ndarray, used: np.ndarray, own: int):
        at = np.flatnonzero(used)
        self.place = np.cumsum(used) - used  # of a word that is not used: the next one that is, which shares what its group shares
        self.groups = Groups(np.zeros(len(at), np.int8), head[at])
        skip = np.maximum(self.groups.shared, 0).astype(np.int64)
        self.logit, logs, self.begin = speller.spell([words[k] for k in at.tolist()], np.full(len(at), own, np.int32), skip)
        self.base, self.last = self.begin - skip, np.r_[self.begin[1:], len(logs)]
        self.sums = np.r_[0.0, np.cumsum(logs, dtype=float)]
        self.offset = np.zeros(len(at))

    def _sum(self, at: np.ndarray, t: int) -> np.ndarray:
        return self.offset[at] + self.sums[self.base[at] + t] - self.sums[self.begin[at]]

    def step(self, t: int) -> None:
        new, before = self.groups.step(t)
        self.offset[new] = self._sum(before, t)

    def at(self, place: np.ndarray, t: int) -> np.ndarray:
        """Logits of bit t of words at places."""
        return self.logit.take(self.base.take(self.groups.lead.take(place)) + t)

    def upto(self, place: np.ndarray, t: int) -> np.ndarray:
        """Sums of logs of the bits before t, of words of at least so many."""
        return self._sum(self.groups.lead[place], t)

    def whole(self, at: np.ndarray) -> np.ndarray:
        """Sums of logs of all bits of words that are used; all levels lie behind."""
        return self.offset[at] + self.sums[self.last[at]] - self.sums[self.begin[at]]


#: By whether both bits were counted, and the count up to 8: nothing, one, few or more of one bit; few or more of both.
_CLASS = np.array([[0, 1, 2, 2, 3, 3, 3, 3, 3], [0, 1, 4, 4, 4, 4, 4, 4, 5]], np.int32).ravel()


def _class(zero: np.ndarray, one: np.ndarray) -> np.ndarray:
    """How much a context has counted (0: nothing), and whether all of it was alike; the same with both changed round."""
    return _CLASS.take(np.minimum(zero + one, 8) + 9 * (np.minimum(zero, one) > 0))


class Mixer(Gated):
    """The speller's logit and those of one and two previous words, mixed by what both contexts have counted."""

    def __init__(self, sets: int = 1, start: np.ndarray | None = None):
        super().__init__(sets * _CLASSES * _CLASSES, [0.6, 0.5, 0.7])
        if start is not None:
            self.weights = np.tile(start, (sets, 1))
        self.levels = _refined(self.hits)

    def settle(self) -> np.ndarray:
        at = super().settle()
        self.levels[at] = _refined(self.hits[at])
        return at


def _portions(rows: list[np.ndarray]) -> Iterator[list[np.ndarray]]:
    for s in range(0, len(rows[0]), PORTION):
        yield [x[s : s + PORTION] for x in rows]


def _between(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All numbers of ranges."""
    size = end - start
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())


def _logit(same: np.ndarray, other: np.ndarray, sign: np.ndarray) -> np.ndarray:
    """Of a one, after counts of the bit that came (sign: 1 for a one, -1 for a zero) and of the other."""
    few = np.float32(0.3)
    out = same.astype(np.float32)
    out += few
    out /= other.astype(np.float32) + few
    np.log(out, out=out)
    out *= sign
    return out


def score_tokens(words: list[bytes], previous: np.ndarray, word: np.ndarray, before: np.ndarray, train: np.ndarray, speller: Speller, sets: np.ndarray | None = None, start: np.ndarray | None = None) -> np.ndarray:
    """Natural log probabilities of tokens: word numbers `word` after what the numbers `previous` stand for, itself after what `before` (32 bits) stands for.

    Counts are those of the training tokens among them, so all tokens after a
    previous one should be here.  sets: a number for each token, the same for all
    tokens after a previous one; sets are mixed each with weights of their own,
    which begin with start (by what both contexts have counted, and input).
    The result does not depend on the order of tokens, nor on other sets.
    """
    head, length = speller.code.heads(words)
    order = np.argsort(head, kind="stable")
    head = head[order]
    alike = np.flatnonzero(np.diff(head) == 0)
    if len(alike):  # words that differ only after their heads stand in their own order
        spot = np.unique(np.r_[alike, alike + 1])
        order[spot] = order[spot][sorted(range(len(spot)), key=lambda k: (head[spot[k]], words[order[spot[k]]]))]
    length, rank = length[order], np.empty(len(words), np.int64)
    rank[order] = np.arange(len(words))
    previous, word = previous.astype(np.int64), rank[word]

    contexts, context = np.unique(previous << 32 | before.astype(np.int64), return_inverse=True)
    triple, of_triple = np.unique(context << 32 | word, return_inverse=True)
    low = np.int64(0xFFFFFFFF)
    pair, pair_of = np.unique(contexts[triple >> 32] & ~low | triple & low, return_inverse=True)
    of_set = np.zeros(len(triple), np.int64)
    if sets is not None:
        of_set[of_triple] = sets
    present, number = np.unique(of_set, return_inverse=True)
    mixer, offset = Mixer(len(present), start), np.zeros(len(pair), np.int32)
    offset[pair_of] = number * (_CLASSES * _CLASSES)
    n2 = [np.bincount(of_triple[which], minlength=len(triple)) for which in (~train, train)]
    n1 = [np.bincount(pair_of, n, len(pair)).astype(np.int64) for n in n2]
    w1, w2 = pair & low, triple & low
    one, two = Trie(pair >> 32, head[w1], length[w1], n1[1], n1[0]), Trie(triple >> 32, head[w2], length[w2], n2[1], n2[0])
    spelling = [words[k] for k in order.tolist()]
    spelt = [Spelt(speller, spelling, head, np.bincount(w2[n2[o] > 0], minlength=len(words)) > 0, o) for o in (0, 1)]
    p1, p2 = ([x.place[w] for x in spelt] for w in (w1, w2))

    # Twice each: for other occurrences (0), and for those of training, which are left out of the counts (1). All that a bit is
    # predicted from is alike in a group, so it is predicted once. Of a group, sums of logs so far; when the longer context says
    # nothing more, what the shorter one's group has had is taken off, and what it comes to is added at the end; so for the speller.
    sum1, sum2, gone1, gone2 = ([np.zeros(len(x), kind) for _ in (0, 1)] for kind in (float, bool) for x in (pair, triple))
    fallen, group = ([np.zeros(len(pair), np.int64) for _ in (0, 1)] for _ in (0, 1))  # occurrences that only the last word still says something about, and their sums by group
    live1, live2 = [one.roots] * 2, [two.roots] * 2

    def go_on(trie: Trie, t: int, sums: list[np.ndarray], gone: list[np.ndarray], live: list[np.ndarray]) -> None:
        new, old = trie.step(t)
        for o in (0, 1):
            sums[o][new], gone[o][new] = sums[o].take(old), gone[o].take(old)
            if trie is one:
                some = np.flatnonzero(group[o].take(old))
                if len(some):
                    a, b = new.take(some), trie.end.take(new.take(some))
                    group[o][a] = n = np.add.reduceat(fallen[o].take(_between(a, b)), np.cumsum(b - a) - (b - a))
                    group[o][old.take(some)] -= n
            at = np.concatenate([live[o], new[~gone[o].take(new)]])
            live[o] = at[trie.counts[o].take(at) > 0]

    def predict(x: list[np.ndarray], gate: np.ndarray, bit: np.ndarray, times: np.ndarray | None) -> np.ndarray:
        p, plain, level = _probability(mixer.logit(x, gate), gate, mixer.levels)
        if times is not None:
            mixer.note(x, gate, plain, level, bit, times.astype(np.float32))
        return np.log(np.where(bit == 1, p, 1 - p))

    for t in range(HEAD):
        go_on(one, t, sum1, gone1, live1)
        go_on(two, t, sum2, gone2, live2)
        for x in spelt:
            x.step(t)
        for o in (0, 1):
            at = live2[o]
            same, other = two.counts[1].take(at) - o, two.other.take(at)
            says = same + other > 0
            if not says.all():
                fell = at[~says]
                short = one.lead.take(pair_of.take(fell))
                sum2[o][fell] -= sum1[o].take(short)
                gone2[o][fell] = True
                np.add.at(group[o], short, two.counts[o].take(fell))
                all_of = _between(fell, two.end.take(fell))
                np.add.at(fallen[o], pair_of.take(all_of), n2[o].take(all_of))
                at, same, other = at[says], same[says], other[says]
            live2[o] = at[two.length.take(at) > t + 1]
            for at, same, other in _portions([at, same, other]):
                short, (bit, sign) = one.lead.take(pair_of.take(at)), two.bit(at, t)
                same1, other1 = one.counts[1].take(short) - o, one.other.take(short)
                gate = _class(same1, other1) * _CLASSES + _class(same, other) + offset.take(short)
                sum2[o][at] += predict([spelt[o].at(p2[o].take(at), t), _logit(same1, other1, sign), _logit(same, other, sign)], gate, bit, same + 1 if o else None)
        mixer.settle()
        for o in (0, 1):
            at = live1[o]
            times = group[o].take(at)
            some = times > 0
            at, times, rest = at[some], times[some], at[~some]
            same, other = one.counts[1].take(at) - o, one.other.take(at)
            says = same + other > 0
            if not says.all():  # from here on the speller is alone
                fell = at[~says]
                sum1[o][fell] -= spelt[o].upto(p1[o][fell], t)
                gone1[o][fell] = True
                at, times, same, other = at[says], times[says], same[says], other[says]
            live1[o] = np.r_[at[one.length[at] > t + 1], rest[one.length[rest] > t + 1]]
            for at, times, same, other in _portions([at, times, same, other]):
                bit, sign = one.bit(at, t)
                sum1[o][at] += predict([spelt[o].at(p1[o].take(at), t), _logit(same, other, sign)], _class(same, other) * _CLASSES + offset.take(at), bit, times if o else None)
        mixer.settle()
    out = np.zeros((2, len(triple)))
    for o, x in enumerate(spelt):
        ends = []
        for trie, place, n in ((one, p1[o], n1[o]), (two, p2[o], n2[o])):
            at = np.flatnonzero(n)
            far = at[trie.length[at] > HEAD]
            head_of = np.zeros(len(n))
            head_of[far] = x.upto(place[far], HEAD)
            ends.append((at, far, head_of))
        x.step(HEAD)
        (at1, far1, head1), (at2, far2, head2) = ends
        all1, alone = sum1[o][one.lead], gone1[o][one.lead]
        far1 = far1[~alone[far1]]
        all1[far1] -= head1[far1]
        alone[far1] = True
        at1 = at1[alone[at1]]
        all1[at1] += x.whole(p1[o][at1])
        all2, short = sum2[o][two.lead], gone2[o][two.lead]
        far2 = far2[~short[far2]]
        all2[far2] += x.whole(p2[o][far2]) - head2[far2]
        out[o] = all2 + np.where(short, all1[pair_of], 0)
    return out[train.astype(np.intp), of_triple]
