"""Adaptive context-mixing range coder for blocks of token ids, many blocks side by side.

A block is coded on its own: its models start empty and its checksum is its own, so blocks can be decoded
apart. As ids of one block depend on each other, arrays run over blocks instead: step t codes the t-th id
of every block at once.

Order 2 predicts the id that followed the last two ids, order 1 the one that followed the last one. The
chance that the predicted id comes mixes the evidence of order 2 and order 1 (how sure their predictions are,
and whether they agree) and of order 0 (how often the predicted id came in the block) by weights that each
block learns. What is left of the interval is shared, by adaptive frequencies, by order 1's own guess, an id
that order 0 holds in a slot of the block, and a new one; slots and new ids follow as plain bytes. All
arithmetic is on 32-bit integers, so every machine decodes what another has coded.
"""

from __future__ import annotations

import math
import zlib

import numpy as np

BLOCK_IDS = 1024
ID_LIMIT = 1 << 28
SLOTS = 256  # of order 0; order 1 has two entries for each
ORDER2_SLOTS = 1024
LEARN = 10  # speed of the weights; they stay within 32 bits for BLOCK_IDS steps
RATE = 4  # of hit rates: a power of 1/2
KIND_RATE = 5  # of the kinds' frequencies

#: Chances are parts of 2^12; none is below LEAST, so that one byte always makes an interval wide enough again.
ONE, LEAST = 4096, 16
NARROW = 1 << 16
FORETOLD, GUESS, SLOT, NEW = 0, 1, 2, 3
KIND_LEAST = 64  # of 2^12 that share the chance of what was not foretold

#: What an entry of order 2 or 1 adds, and 3, to its confidence of 0 to 7 when it failed, and when it was right; 8
#: where another id takes its place: a prediction that failed is doubted before it is replaced.
DOUBT = np.array([8, 8, 2, 2, 1, 1, 1, 0, 3, 4, 4, 4, 4, 4, 4, 3], np.int32)

#: Logistic transforms of these chances; logits are in 1/256.
SQUASH = np.array([min(ONE - 4 * LEAST, max(LEAST, round(ONE / (1 + math.exp(-x / 256))))) for x in range(-2047, 2048)], np.int32)
STRETCH = np.array([round(256 * math.log((p + 0.5) / (ONE - 0.5 - p))) for p in range(ONE)], np.int32)


class _Coder:
    def __init__(self, lanes: int) -> None:
        self.lanes = self.open = lanes
        self.everyone = np.arange(lanes)
        self.width = np.full(lanes, 1 << 24, np.int32)


class Encoder(_Coder):
    """Arithmetic coding into bytes, a lane for each block; `open` says how many lanes are left."""

    def __init__(self, lanes: int, steps: int, id_bytes: int) -> None:
        super().__init__(lanes)
        self.low = np.zeros(lanes, np.int32)
        self.out = np.zeros((steps, lanes), np.int16)  # a byte for each id at most, and a carry
        self.given = np.zeros((steps, lanes), bool)  # which of them are part of the code
        self.plain = np.zeros((id_bytes, steps, lanes), np.uint8)
        self.needs = np.zeros((steps, lanes), np.uint8)
        self.step = 0

    def _narrow(self, low: np.ndarray, width: np.ndarray) -> None:
        """Take on the new interval and give out a byte where it became narrow."""
        n = self.open
        np.right_shift(low, 16, out=self.out[self.step, :n], casting="unsafe")
        small = np.less(width, NARROW, out=self.given[self.step, :n])
        shift = small.astype(np.int32)
        low &= shift - 1 | 0xFFFF
        shift <<= 3
        np.left_shift(width, shift, out=self.width[:n])
        np.left_shift(low, shift, out=self.low[:n])

    def pick(self, ends: np.ndarray, choice: np.ndarray) -> np.ndarray:
        """Code which part of the interval is taken; parts begin and end at the rows of `ends`."""
        unit = self.width[: self.open] >> 12
        at = choice * self.lanes
        at += self.everyone[: self.open]
        flat = ends.reshape(-1)
        start = flat.take(at, mode="clip")
        at += self.lanes
        size = flat.take(at, mode="clip")
        size -= start
        size *= unit
        start *= unit
        start += self.low[: self.open]
        self._narrow(start, size)
        return choice

    def bytes(self, value: np.ndarray, choice: np.ndarray, needs: np.ndarray) -> np.ndarray:
        """`value` in as many plain bytes as the choice needs."""
        n = self.open
        self.needs[self.step, :n] = needs.take(choice, mode="clip")
        for k, plane in enumerate(self.plain):
            plane[self.step, :n] = value >> 8 * k if k else value
        self.step += 1
        return value

    def finish(self) -> list[bytes]:
        """The code of each lane: its length, the code, then the plain bytes."""
        steps = len(self.out)
        code = np.empty((steps + 3, self.lanes), np.uint8)
        code[steps:] = [self.low >> shift & 255 for shift in (16, 8, 0)]
        carry = (self.low >> 24).astype(np.int16)
        for t in range(steps - 1, -1, -1):
            given = self.given[t]
            value = self.out[t] * given
            value += carry
            code[t] = value
            # What is not given out passes the carry on.
            carry = np.where(given, value >> 8, carry)
        given = np.ones((self.lanes, steps + 3), bool)
        given[:, :steps] = self.given.T
        used = np.count_nonzero(given, axis=1)
        code = np.ascontiguousarray(code.T)[given].tobytes()
        stops = np.cumsum(used).tolist()
        needs = np.ascontiguousarray(self.needs.T)
        taken = np.empty((*needs.shape, len(self.plain)), bool)
        plain = np.empty(taken.shape, np.uint8)
        for k, plane in enumerate(self.plain):
            np.greater(needs, k, out=taken[:, :, k])
            plain[:, :, k] = plane.T
        plain = plain.reshape(-1)[taken.reshape(-1)].tobytes()
        ends = np.cumsum(self.needs.sum(0, dtype=np.int64)).tolist()
        return [n.to_bytes(2, "little") + code[stop - n : stop] + plain[start:end]
                for n, stop, start, end in zip(used.tolist(), stops, [0, *ends], ends)]


class Decoder(_Coder):
    """The inverse of `Encoder`. A damaged code gives some ids, and their checksum tells."""

    def __init__(self, codes: list[bytes]) -> None:
        super().__init__(len(codes))
        self.data = np.frombuffer(b"".join([*codes, bytes(8)]), np.uint8)
        starts = np.cumsum([0, *map(len, codes)])[: len(codes)]
        self.plain_at = starts + 2 + self._byte(starts) + (self._byte(starts + 1) << 8)
        self.code = (self._byte(starts + 2) << 16) + (self._byte(starts + 3) << 8) + self._byte(starts + 4)
        self.at = starts + 5

    def _byte(self, at: np.ndarray) -> np.ndarray:
        return self.data.take(at, mode="clip").astype(np.int32)

    def _narrow(self, code: np.ndarray, width: np.ndarray) -> None:
        n = self.open
        at = self.at[:n]
        small = width < NARROW
        shift = small.astype(np.int32)
        fresh = self._byte(at)
        fresh *= shift
        at += small
        shift <<= 3
        np.left_shift(width, shift, out=self.width[:n])
        np.left_shift(code, shift, out=code)
        np.add(code, fresh, out=self.code[:n])

    def pick(self, ends: np.ndarray, _: None) -> np.ndarray:
        n = self.open
        unit, code = self.width[:n] >> 12, self.code[:n]
        choice = (code >= unit * ends[1, :n]).astype(np.int64)
        choice += code >= unit * ends[2, :n]
        choice += code >= unit * ends[3, :n]
        at = choice * self.lanes
        at += self.everyone[:n]
        flat = ends.reshape(-1)
        start = flat.take(at, mode="clip")
        at += self.lanes
        size = flat.take(at, mode="clip")
        size -= start
        size *= unit
        start *= unit
        self._narrow(code - start, size)
        return choice

    def bytes(self, _: None, choice: np.ndarray, needs: np.ndarray) -> np.ndarray:
        at = self.plain_at[: self.open]
        value = self._byte(at)
        for k in range(1, int(needs[NEW])):
            value += self._byte(at + k) << 8 * k
        at += needs.take(choice, mode="clip")
        return value


class Mixer:
    """A probability from the evidence of the orders, by weights that each lane learns.

    Each input has eight states, whose own hit rates are learned too.
    """

    def __init__(self, lanes: int, inputs: int) -> None:
        self.lanes, self.base = np.int64(lanes), np.arange(lanes)
        self.rates = [np.full(lanes * 8, 1 << 15, np.int32) for _ in range(inputs)]
        self.weights = [np.full(lanes, 1 << 15, np.int32) for _ in range(inputs)]

    def chance(self, states: list[np.ndarray]) -> np.ndarray:
        n = len(states[0])
        self.at = [s * self.lanes + self.base[:n] for s in states]  # most lanes are in the same few states
        self.held = [r.take(at, mode="clip") for r, at in zip(self.rates, self.at)]
        self.logits = [STRETCH.take(h >> 4, mode="clip") for h in self.held]
        total = (self.weights[0][:n] >> 4) * self.logits[0]
        for weight, logit in zip(self.weights[1:], self.logits[1:]):
            total += (weight[:n] >> 4) * logit
        self.p = SQUASH.take((total >> 12) + 2047, mode="clip")
        return self.p

    def learn(self, hit: np.ndarray) -> None:
        n = len(hit)
        error = ((hit << 12) - self.p) * LEARN
        goal = hit * 65535
        for rate, at, held, weight, logit in zip(self.rates, self.at, self.held, self.weights, self.logits):
            rate[at] = held + (goal - held >> RATE)
            weight[:n] += logit * error >> 14


def _run(coder: Encoder | Decoder, sizes: np.ndarray, id_bytes: int, known: np.ndarray | None) -> np.ndarray:
    """Code the ids `known` (a row for each step, a column for each block), or decode them.

    `sizes` are the blocks' ids, most first, so that those still open are always the first ones. Within,
    ids count from 1, as 0 is nothing.
    """
    lanes = len(sizes)
    steps = int(sizes.max(initial=0))
    ids = np.zeros((steps, lanes), np.int32) if known is None else known
    # A row for each slot, as blocks use the same slots most. In it each block has its entries side by side, as
    # they are needed when the slot's id came: order 0's, of that id, and two of order 1, of the next one, between
    # which another bit of the id decides. An entry is an id and three bits, of its count or of its confidence.
    table = np.zeros(lanes * SLOTS * 3, np.int32)
    pairs = np.zeros(lanes * ORDER2_SLOTS, np.int32)  # order 2's entries
    ends = np.zeros((5, lanes), np.int32)
    ends[4] = ONE
    guess_share, slot_share = np.full(lanes, ONE // 2, np.int32), np.full(lanes, ONE // 2, np.int32)
    options = np.zeros((4, lanes), np.int32)
    needs = np.array([0, 0, 1, id_bytes])
    mixer = Mixer(lanes, 3)
    everyone, row, pair_row = np.arange(lanes), np.int64(3 * lanes), np.int64(lanes)
    places = 3 * everyone
    at1, at2 = places + 1, everyone
    last = np.zeros(lanes, np.int32)  # spread ids
    spread = np.int32(-1640531527)  # 2^32 by the golden ratio
    opened = np.searchsorted(-sizes, -np.arange(steps), side="left")  # blocks longer than t
    for t in range(steps):
        n = coder.open = int(opened[t])
        place, at1, at2 = places[:n], at1[:n], at2[:n]
        held2, held1 = pairs.take(at2, mode="clip"), table.take(at1, mode="clip")
        guess2, guess1 = held2 >> 3, held1 >> 3
        sure2, sure1 = held2 & 7, held1 & 7
        # Order 2's prediction, and order 1's where it has none; choices are made by masks, as they follow no pattern.
        guess = (guess1 ^ guess2) & -(guess2 > 0).astype(np.int32)
        guess ^= guess1
        kept = table.take((guess * spread >> 15 & SLOTS - 1) * row + place, mode="clip")
        same = guess1 == guess
        differ = 1 - same.astype(np.int32)
        chance = mixer.chance([sure2, sure1 * same, (kept & 7) * (kept >> 3 == guess)])
        ends[1, :n] = chance
        # Order 1's guess has a part where it differs from what is foretold.
        part = ONE - 3 * LEAST - chance
        part *= guess_share[:n]
        part >>= 12
        part += LEAST
        part *= differ
        end = np.add(chance, part, out=ends[2, :n])
        part = ONE - 2 * LEAST - end
        part *= slot_share[:n]
        part >>= 12
        part += end
        np.add(part, LEAST, out=ends[3, :n])
        if known is None:
            choice = coder.pick(ends, None)
            value = coder.bytes(None, choice, needs)
            options[FORETOLD, :n] = guess
            options[GUESS, :n] = guess1
            # Where no slot came, the first one is looked at: it is near.
            asked = value & (choice == SLOT) * np.int32(SLOTS - 1)
            options[SLOT, :n] = table.take(asked * row + place, mode="clip") >> 3
            options[NEW, :n] = value + 1
            found = options.reshape(-1).take(choice * lanes + everyone[:n], mode="clip")
            ids[t, :n] = found
        else:
            found = known[t, :n]
        spun = found * spread
        slot = spun >> 15 & SLOTS - 1
        at0 = slot * row + place
        held0 = table.take(at0, mode="clip")
        same0 = held0 >> 3 == found
        hit, hit1, hit2 = (np.equal(g, found).astype(np.int32) for g in (guess, guess1, guess2))
        mask0 = -same0.astype(np.int32)  # all bits where the slot holds the id
        if known is not None:
            choice = (2 + mask0) * (1 - hit1)
            choice += GUESS
            choice *= 1 - hit
            choice = choice.astype(np.int64)
            coder.pick(ends, choice)
            value = found - 1
            value ^= (value ^ slot) & mask0
            coder.bytes(value, choice, needs)
        mixer.learn(hit)
        # The shares move towards what came, where they were used; no kind's falls to nothing.
        miss = 1 - hit
        for share, came, used in ((guess_share, -hit1, miss * differ), (slot_share, mask0, miss * (1 - hit1))):
            goal = came & ONE - 2 * KIND_LEAST
            goal += KIND_LEAST
            goal -= share[:n]
            goal >>= KIND_RATE
            goal *= used
            share[:n] += goal
        # What replaces an entry and what stays of it, joined by masks.
        fresh = found << 3
        begun = fresh | 1
        for entries, at, held, sure, right in ((pairs, at2, held2, sure2, hit2), (table, at1, held1, sure1, hit1)):
            state = right << 3
            state += sure
            step = DOUBT.take(state, mode="clip")
            held += step
            held -= 3
            step >>= 3
            step -= 1  # all bits where the entry stays
            held ^= begun
            held &= step
            held ^= begun
            entries[at] = held
        held0 += (held0 & 7) < 7
        table[at0] = (held0 ^ fresh) & mask0 ^ fresh
        bit = spun >> 23 & 1
        bit += 1
        at1 = at0 + bit
        both = last[:n]
        both *= 5
        both += spun
        both >>= 15
        both &= ORDER2_SLOTS - 1
        at2 = both * pair_row
        at2 += everyone[:n]
        last = spun
    return ids


def id_bytes_of(largest: int) -> int:
    """Bytes of ids up to `largest`."""
    if largest >= ID_LIMIT:
        raise ValueError(f"ids must be below {ID_LIMIT}")
    return max(1, -(-int(largest).bit_length() // 8))


def encode(ids: np.ndarray, id_bytes: int) -> list[tuple[int, int, bytes]]:
    """(number of ids, checksum, code) of each block of `ids`."""
    count = -(-len(ids) // BLOCK_IDS)
    grid = np.zeros(count * BLOCK_IDS, np.int32)
    grid[: len(ids)] = ids
    sizes = np.full(count, BLOCK_IDS)
    if count:
        sizes[-1] = len(ids) - (count - 1) * BLOCK_IDS
    coder = Encoder(count, int(sizes.max(initial=0)), id_bytes)
    _run(coder, sizes, id_bytes, np.ascontiguousarray(grid.reshape(count, BLOCK_IDS).T)[: int(sizes.max(initial=0))] + 1)
    raw = ids.astype("<u4")
    return [(int(n), zlib.crc32(raw[k * BLOCK_IDS : k * BLOCK_IDS + int(n)]), code)
            for k, (n, code) in enumerate(zip(sizes, coder.finish()))]


def decode(blocks: list[tuple[int, int, bytes]], id_bytes: int) -> np.ndarray:
    """The ids of consecutive blocks, their checksums checked."""
    order = sorted(range(len(blocks)), key=lambda k: -blocks[k][0])
    sizes = np.array([blocks[k][0] for k in order], np.int64)
    ids = _run(Decoder([blocks[k][2] for k in order]), sizes, id_bytes, None) - 1
    ids = np.ascontiguousarray(ids.astype("<u4").T)
    parts = [b""] * len(blocks)
    for lane, k in enumerate(order):
        parts[k] = ids[lane, : sizes[lane]].tobytes()
        if zlib.crc32(parts[k]) != blocks[k][1]:
            raise ValueError("a block does not match its checksum")
    return np.frombuffer(b"".join(parts), "<u4")
