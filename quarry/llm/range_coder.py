"""Adaptive context-mixing range coder for token ids.

A block is coded by itself: its tables start empty. The next id is one of four things: what order 2 predicts (the id that last
followed the two ids before), what order 1 predicts, an id of the block's own order-0 counts, or a new one. Three adaptive
distributions over these four, by the state of order 2, of order 1, and without context, are mixed; the mixing weights move to
the distributions that foretold best. An id of order 0 is coded by its share of the counts, all of its bits; a new id takes 16
bits. All this drives a carry-less range coder. Distributions and weights adapt after each stretch of 96 ids, the counts
whenever the block has doubled. Many blocks are coded side by side, a lane of the arrays each.

The model uses integers and single additions, multiplications and divisions of 32-bit floats alone, so any machine decodes what
another has coded."""

from __future__ import annotations

import numpy as np

STRETCH = 96
#: Bits of a distribution's total, of what an event is divided into, and of both.
ROW, INNER = 14, 16
TOTAL = ROW + INNER
#: What every event keeps of a distribution, at least.
SHARE = 16
#: The range is kept above BOTTOM, in words of 32 bits; an id takes 30 at most, so that one word for an id is enough.
BOTTOM, WORD, BELOW = np.uint64(1 << 32), np.uint64(32), np.uint64((1 << 32) - 1)
SLOTS1, SLOTS2 = 1 << 9, 1 << 10
ORDER2, ORDER1, ORDER0, NEW = range(4)
#: Four 16-bit fields in one number: bits of a field's place, the last field, a one in each, and the high bit of each.
FIELD, LAST, FIELDS, HIGH = np.uint64(4), np.uint64(0xFFFF), np.uint64(0x0001_0001_0001_0001), np.uint64(0x8000_8000_8000_8000)
IN, ALL, LIMIT = np.uint64(INNER), np.uint64(TOTAL), np.int64((1 << TOTAL) - 1)
#: What an event is divided into, where one id has all of it, and where each has one of it: 2^32 times the width, and 2^16 the lower bound.
WHOLE, EACH = np.uint64(1 << 32 + INNER), np.uint64(1 << 32)
#: The low 16 bits of this product of an id stand for it in the slots' numbers.
HASH = np.uint16(40503)
#: Blocks whose ids are looked up at once before they are coded: their arrays fit a core's cache.
ROWS_AT_ONCE = 32
#: States of order 2 (how often in a row it was right, whether order 1 agrees), states of order 1, and all distributions.
STATES2, STATES1 = 8, 4
ROWS = STATES2 + STATES1 + 1
START = np.array([0.1, 0.1, 0.8, 1.0], np.float32)
DECAY, PACE, FLOOR = np.float32(0.96), np.float32(0.25), np.float32(0.02)


def _growth(most: int) -> list[int]:
    """Sizes at which a block's counts are taken anew."""
    out = [STRETCH]
    while out[-1] < most:
        out.append(2 * out[-1])
    return out[:-1]


class _Lanes:
    """The distributions and the coder of ``n`` blocks. A cell is an event in a state of order 2 and one of order 1, in each block."""

    def __init__(self, n: int):
        self.n, self.lane = n, np.arange(n)
        self.counts = np.empty((ROWS, 4, n), np.float32)
        self.counts[:] = START[:, None]
        self.weights = np.full((3, n), 1 / 3, np.float32)
        self.low, self.range = np.zeros(n, np.uint64), np.full(n, (1 << 64) - 1, np.uint64)
        self.mix()

    def mix(self) -> None:
        """The upper bounds of the first three events for every pair of states: an array (3, states of order 2, of order 1, n)."""
        self.shares = self.counts / (self.counts[:, 0] + self.counts[:, 1] + self.counts[:, 2] + self.counts[:, 3])[:, None]
        self.bounds, below = np.empty((3, STATES2, STATES1, self.n), np.uint16), np.zeros((ROWS, self.n), np.float32)
        scale = self.weights * np.float32((1 << ROW) - 4 * SHARE)
        for event in range(3):
            below += self.shares[:, event]
            two, one = scale[0] * below[:STATES2], scale[1] * below[STATES2:-1] + scale[2] * below[-1]
            np.add(two[:, None], one, out=self.bounds[event], casting="unsafe")
            self.bounds[event] += np.uint16(SHARE * (event + 1))

    def packed(self) -> np.ndarray:
        """For every pair of states the upper bounds of the four events as one 64-bit number of four 16-bit ones."""
        out = self.bounds[2].astype(np.uint64)
        out |= np.uint64(1 << ROW + 16)
        for event in (1, 0):
            out <<= IN
            out |= self.bounds[event]
        return out.ravel()

    def cells(self) -> np.ndarray:
        """For every cell 2^16 times the lower bound, and the width."""
        out = np.empty((4, *self.bounds.shape[1:]), np.uint32)
        out[0], out[1:] = 0, self.bounds
        out <<= np.uint32(16)
        out[0] = self.bounds[0]
        out[1:3] |= self.bounds[1:] - self.bounds[:-1]
        out[3] |= np.uint16(1 << ROW) - self.bounds[2]
        return out.ravel()

    def adapt(self, cells: np.ndarray) -> None:
        """Moves distributions and weights to what happened: the cells of a stretch."""
        times = np.bincount(cells.ravel(), minlength=4 * STATES2 * STATES1 * self.n).astype(np.float32).reshape(4, STATES2, STATES1, self.n)
        answer = np.zeros((3, self.n), np.float32)
        for event, seen in enumerate(times):
            told = self.shares[:, event].copy()
            for rows, weight in zip((slice(STATES2), slice(STATES2, -1), slice(-1, None)), self.weights, strict=True):
                told[rows] *= weight
            two, one, none = told[:STATES2, None], told[STATES2:-1], told[-1]
            part = np.float32(1024) / (two + one + none)
            # how much of what happened each distribution answers for: whole numbers, so that their sum is the same in any order
            for k, own in enumerate((two, one, none)):
                share = own * part
                np.trunc(share, out=share)
                share *= seen
                answer[k] += share.reshape(-1, self.n).sum(0)
        answer += FLOOR
        answer /= answer[0] + answer[1] + answer[2]
        self.weights += (answer - self.weights) * PACE
        self.counts *= DECAY
        self.counts[:STATES2] += times.sum(2).swapaxes(0, 1)
        own = times.sum(1)
        self.counts[STATES2:-1] += own.swapaxes(0, 1)
        self.counts[-1] += own.sum(1)

    def settle(self) -> tuple[np.ndarray, np.ndarray]:
        """The lanes whose range is used up, and their leading words, which move on."""
        moving = (self.range < BOTTOM).nonzero()[0]
        low, wide = self.low.take(moving), self.range.take(moving)
        lead, end = low >> WORD, low + wide
        end >>= WORD
        across = (end != lead).nonzero()[0]
        if len(across):  # the leading word is not settled: what lies beyond it is given up
            wide[across] = (np.uint64(0) - low.take(across)) & BELOW
        wide <<= WORD
        low <<= WORD
        self.low[moving], self.range[moving] = low, wide
        return moving, lead


def _slots(last: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slots of orders 1 and 2 after ids of these hashes, the last and the one before it."""
    one, two = last >> np.uint16(3), before * np.uint16(3)
    one &= np.uint16(SLOTS1 - 1)
    two += last
    two >>= np.uint16(4)
    two &= np.uint16(SLOTS2 - 1)
    return one, two


class _Sorted:
    """Rows of keys of at most 16 bits in order, equal ones by their place."""

    def __init__(self, keys: np.ndarray):
        n, most = keys.shape
        bits = max(1, (most - 1).bit_length())
        kind = np.uint32 if bits <= 16 else np.uint64
        held = keys.astype(kind)
        held <<= kind(bits)
        held |= np.arange(most, dtype=kind)
        held.sort(axis=1)
        #: Where each comes from, in all rows; and whether it equals the one before it.
        self.at = (held & kind((1 << bits) - 1)).astype(np.int64)
        self.at += np.arange(n)[:, None] * most
        held >>= kind(bits)
        self.same = np.zeros((n, most), bool)
        np.equal(held[:, 1:], held[:, :-1], out=self.same[:, 1:])

    def back(self, values: np.ndarray) -> np.ndarray:
        """Values of the sorted keys, put where those come from."""
        out = np.empty_like(values)
        out.ravel()[self.at] = values
        return out


def _followed(ids: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each id the one that last followed in its slot, and 0 to 3: how often in a row that was right."""
    order = _Sorted(slots)
    held = ids.ravel().take(order.at)
    guess = np.zeros_like(held)
    np.multiply(held[:, :-1], order.same[:, 1:], out=guess[:, 1:])
    once = order.same
    once[:, 1:] &= (guess == held)[:, :-1]
    twice = once[:, 1:] & once[:, :-1]
    sure = once.astype(np.uint32)
    sure[:, 1:] += twice
    sure[:, 2:] += twice[:, 1:] & once[:, :-2]
    sure <<= np.uint32(16)
    sure |= guess
    told = order.back(sure)
    return told.astype(np.uint16), (told >> np.uint32(16)).astype(np.uint8)


def _renewed(held: np.ndarray, guess: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """What slots hold after an id: it, and how often in a row it was foretold."""
    sure = held - guess
    sure += np.uint32(1 << 16)
    np.minimum(sure, np.uint32(3 << 16), out=sure)
    sure *= guess == ids
    sure |= ids
    return sure


def _quotient(value: np.ndarray, step: np.ndarray) -> np.ndarray:
    """value // step for quotients under 2^31: by floats, a little too large rather than too small, and put right where it is."""
    near = value.astype(np.float64)
    near /= step.astype(np.float64)
    near += 2.0**-20
    out = near.astype(np.int64)
    rest = (value - out.view(np.uint64) * step).view(np.int64)
    rest >>= 63
    out += rest
    return out


def _counted(ids: np.ndarray, sizes: list[int], points: list[int]) -> np.ndarray:
    """For each id of each block (row) the share of the counts that it has, out of 2^INNER: lower bound, and 2^16 times the width; no width, if it is not counted."""
    n, most = ids.shape
    order = _Sorted(ids)
    number = np.cumsum(~order.same.ravel(), dtype=np.int32) - np.int32(1)  # distinct ids of all blocks, one block after another
    at = order.back(number.reshape(n, most)).astype(np.int64)
    last = number[most - 1 :: most] + 1
    shares, counts = np.zeros((n, most), np.uint32), np.zeros(int(last[-1]) + 1, np.int64)  # one before the first
    for lo, hi, after in zip([0, *points], points, [*points[1:], most], strict=False):
        live = int(np.searchsorted(-np.array(sizes), -hi))  # blocks come from the longest on
        if not live:
            break
        own = counts[: int(last[live - 1]) + 1]
        own[1:] += np.bincount(at[:live, lo:hi].ravel(), minlength=len(own) - 1)
        # each block has ``hi`` ids counted, so bounds that run on from block to block are a multiple of 2^INNER off
        until = (np.cumsum(own) << INNER) // hi
        width = np.minimum(np.diff(until), 0xFFFF)
        width <<= 16
        width |= until[:-1] & 0xFFFF
        shares[:live, hi:after] = width.astype(np.uint32).take(at[:live, hi:after])
    return shares


def _foreseen(ids: np.ndarray, sizes: list[int], points: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """For each id of each block (row) its cell, and its share of that: lower bound, and 2^16 times the width less one."""
    hashes = np.zeros((len(ids), ids.shape[1] + 2), np.uint16)
    np.multiply(ids, HASH, out=hashes[:, 2:])
    (one, sure1), (two, sure2) = (_followed(ids, slots) for slots in _slots(hashes[:, 1:-1], hashes[:, :-2]))
    shares = _counted(ids, sizes, points)
    counted, right1, right2 = shares > 0xFFFF, one == ids, two == ids
    shares -= counted.astype(np.uint32) << np.uint32(16)
    shares = np.where(right1 | right2, np.uint32(0xFFFF << 16), np.where(counted, shares, ids))
    event = np.uint8(NEW) - counted
    event[right1] = ORDER1
    event[right2] = ORDER2
    event *= np.uint8(STATES2 * STATES1)
    event += (sure2 << np.uint8(3)) + ((one == two) << np.uint8(2)) + sure1
    return event, shares


def encode(blocks: list[np.ndarray]) -> list[bytes]:
    """Codes blocks of ids under 2^16, each by itself."""
    order = sorted(range(len(blocks)), key=lambda i: -len(blocks[i]))
    sizes = [len(blocks[i]) for i in order]
    n, most = len(blocks), max(sizes, default=0)
    if not most:
        return [b"\0" * 8] * n
    cells, shares = np.empty((most, n), np.uint8), np.empty((most, n), np.uint32)
    for lo in range(0, n, ROWS_AT_ONCE):
        own = order[lo : lo + ROWS_AT_ONCE]
        ids = np.zeros((len(own), most), np.uint16)
        for row, i in zip(ids, own, strict=True):
            row[: len(blocks[i])] = blocks[i]
        cell, share = _foreseen(ids, sizes[lo : lo + len(own)], _growth(most))
        cells[:, lo : lo + len(own)], shares[:, lo : lo + len(own)] = cell.T, share.T
    wide = most + 4
    lanes, out, at = _Lanes(n), np.zeros(n * wide, np.uint32), np.arange(n) * wide
    over = {t: np.array([k for k, size in enumerate(sizes) if size == t]) for t in set(sizes)}  # what a lane does after its end is not read
    ends, lows = at.copy(), lanes.low.copy()
    step, by = np.empty(n, np.uint64), np.empty(n, np.uint64)
    for lo in range(0, most, STRETCH):
        cell = cells[lo : lo + STRETCH].astype(np.int64)
        cell *= n
        cell += lanes.lane
        cut, share = lanes.cells().take(cell), shares[lo : lo + STRETCH]
        start = cut & np.uint32(0xFFFF << 16)
        cut &= np.uint32(0xFFFF)
        start += cut * (share & np.uint32(0xFFFF))
        cut *= (share >> np.uint32(16)) + np.uint32(1)
        for t, start_now, cut_now in zip(range(lo, most), start.astype(np.uint64), cut.astype(np.uint64), strict=False):
            np.right_shift(lanes.range, ALL, out=step)
            np.multiply(start_now, step, out=by)
            lanes.low += by
            np.multiply(cut_now, step, out=lanes.range)
            moving, lead = lanes.settle()
            place = at.take(moving)
            out[place] = lead
            place += 1
            at[moving] = place
            if t + 1 in over:
                ends[over[t + 1]], lows[over[t + 1]] = at[over[t + 1]], lanes.low[over[t + 1]]
        lanes.adapt(cell)
        lanes.mix()
    coded: list[bytes] = [b""] * n
    for k, (i, end, low) in enumerate(zip(order, ends.tolist(), lows, strict=True)):
        coded[i] = out[k * wide : end].astype("<u4").tobytes() + np.array([low >> WORD, low & BELOW], "<u4").tobytes()
    return coded


class _Counts:
    """What order 0 knows of ``n`` blocks at one size: for each of the sorted ids, that id and the share of all that equal it."""

    def __init__(self, n: int, most: int):
        self.n, self.size, self.all = n, 0, np.empty(n * most, np.uint64)

    def take(self, ids: np.ndarray) -> None:
        """Counts the ids so far, a column for each block."""
        self.size = size = len(ids)
        self.base = np.arange(self.n) * size
        for lo in range(0, self.n, ROWS_AT_ONCE):
            held = ids[:, lo : lo + ROWS_AT_ONCE].T.astype(np.uint32, order="C")
            held.sort(axis=1)
            begins = np.ones(held.shape, bool)
            np.not_equal(held[:, 1:], held[:, :-1], out=begins[:, 1:])
            first = np.append(begins.ravel().nonzero()[0], held.size)
            # every block has as many ids, so bounds that run on from block to block are a multiple of 2^INNER off
            until = (first << INNER) // size
            packed = np.minimum(np.diff(until), 0xFFFF) << 32
            packed |= (until[:-1] & 0xFFFF) << 16
            packed |= held.ravel().take(first[:-1])
            run = np.cumsum(begins.ravel())
            run -= 1
            packed.view(np.uint64).take(run, out=self.all[lo * size : lo * size + held.size], mode="clip")

    def at(self, value: np.ndarray, lanes: np.ndarray) -> np.ndarray:
        """Of the ids of some lanes that hold the values the id, and 2^16 times the lower bound and 2^32 times the width."""
        place = value + 1
        place *= self.size
        place -= 1
        place >>= INNER
        place += self.base.take(lanes)
        return self.all.take(place)


def decode(coded: list[bytes], sizes: list[int]) -> list[np.ndarray]:
    """The blocks of so many ids that :func:`encode` made ``coded`` of."""
    n, most = len(coded), max(sizes, default=0)
    wide = max(map(len, coded), default=0) // 4 + 4
    words = np.zeros(n * wide, np.uint32)
    for k, own in enumerate(coded):
        words[k * wide : k * wide + len(own) // 4] = np.frombuffer(own, "<u4")
    lanes, at = _Lanes(n), np.arange(n) * wide + 2
    code = words[0::wide].astype(np.uint64) << WORD | words[1::wide]
    # the id that followed last, and 2^16 times how often in a row it was right: first all slots of order 1, then those of order 2
    slots = np.zeros(n * (SLOTS1 + SLOTS2), np.uint32)
    of_state = np.arange(STATES2 * STATES1) * n
    of_slot, places = np.arange(SLOTS1 + SLOTS2) * n, np.empty((2, n), np.int64)
    last, before = np.zeros(n, np.uint16), np.zeros(n, np.uint16)
    points, out = _growth(most), np.zeros((most, n), np.uint16)
    counts = _Counts(n, max(points, default=0))
    held, pick, step, by = np.empty((2, n), np.uint32), np.empty(n, np.int64), np.empty(n, np.uint64), np.empty(n, np.uint64)
    found, bounds, base = np.zeros((4, n), np.uint64), np.empty(n, np.uint64), np.empty(n, np.uint64)
    for lo in range(0, most, STRETCH):
        if lo in points:
            counts.take(out[:lo])
        table, cells = lanes.packed(), np.empty((min(STRETCH, most - lo), n), np.int64)
        events = np.empty(cells.shape, np.uint8)
        for t, cell, event in zip(range(lo, most), cells, events, strict=False):  # what lanes do after their ends is not read
            one, two = _slots(last, before)
            two += np.uint16(SLOTS1)
            of_slot.take(one, out=places[0], mode="clip")
            of_slot.take(two, out=places[1], mode="clip")
            places += lanes.lane
            slots.take(places, out=held, mode="clip")
            guess, sure = held & np.uint32(0xFFFF), (held >> np.uint32(16)).astype(np.uint8)
            state = (guess[0] == guess[1]).view(np.uint8)
            state <<= np.uint8(2)
            state += sure[0]
            sure[1] <<= np.uint8(3)
            state += sure[1]
            of_state.take(state, out=cell, mode="clip")
            cell += lanes.lane
            table.take(cell, out=bounds, mode="clip")
            np.right_shift(lanes.range, ALL, out=step)
            value = _quotient(code - lanes.low, step)
            np.minimum(value, LIMIT, out=value)
            # how many bounds it has reached: in each field the high bit stays if the bound is not larger
            reached = value.view(np.uint64) >> IN
            reached *= FIELDS
            reached |= HIGH
            reached -= bounds
            reached &= HIGH
            np.bitwise_count(reached, out=event)
            field = event.astype(np.uint64)
            field <<= FIELD
            np.left_shift(bounds, IN, out=base)
            bounds -= base  # fields do not borrow: bounds ascend
            base >>= field
            base &= LAST
            bounds >>= field
            cut = bounds
            cut &= LAST
            base <<= IN
            value -= base.view(np.int64)
            near = value.astype(np.float64)
            near /= cut.view(np.int64)
            value = near.astype(np.int64)  # of numbers under 2^30 no quotient rounds up to the next
            np.add(guess[1], WHOLE, out=found[ORDER2])
            np.add(guess[0], WHOLE, out=found[ORDER1])
            known = (event == ORDER0).nonzero()[0]
            if counts.size:
                found[ORDER0][known] = counts.at(value.take(known), known)
            np.multiply(value.view(np.uint64), np.uint64(0x1_0001), out=found[NEW])
            found[NEW] += EACH
            of_state.take(event, out=pick, mode="clip")
            pick += lanes.lane
            share = found.ravel().take(pick)
            ids = share.astype(np.uint16)
            out[t] = ids
            share >>= IN
            start = share & LAST
            start *= cut
            start += base
            start *= step
            lanes.low += start
            share >>= IN
            share *= cut
            np.multiply(share, step, out=lanes.range)
            moving, _ = lanes.settle()
            place = at.take(moving)
            new = code.take(moving)
            new <<= WORD
            new |= words.take(place, mode="clip")
            code[moving] = new
            place += 1
            at[moving] = place
            slots[places] = _renewed(held, guess, ids)
            before, last = last, ids * HASH
        cells += events * np.int64(STATES2 * STATES1 * n)
        lanes.adapt(cells)
        lanes.mix()
    out = np.ascontiguousarray(out.T)
    return [out[k, :size].copy() for k, size in enumerate(sizes)]
