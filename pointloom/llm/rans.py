"""Static range asymmetric numeral system over arrays of ids, in numpy.

One table of frequencies, summing to 2**bits, serves all blocks. A block is
BLOCK ids dealt to LANES interleaved coders, so a step codes one id of every
lane; blocks know nothing of each other, and all blocks of a frame are coded
side by side in the same steps. States stay in [2**31, 2**63) and give or take
32-bit words. A block's checkpoint is the place of its first word and its
lanes' states: decoding can begin at any of them.

Frame (little-endian): magic, counts, document ids and lengths, checkpoints,
checksums of the blocks' words, words; then the checksum of all before it.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK, LANES = 16_384, 32
STEPS = BLOCK // LANES
LEAST = np.uint64(1 << 31)
MAGIC = b"IDSANS1\n"
_HEAD = struct.Struct("<8sQQQQ")  # magic, documents, ids, blocks, words
_32, _LOW = np.uint64(32), np.uint64(0xFFFFFFFF)


class Table:
    """Frequencies of ids, whole numbers that sum to 2**bits; ids that occur have at least 1, others cannot be coded."""

    def __init__(self, freq: np.ndarray, bits: int):
        self.freq, self.bits = freq.astype(np.uint64), bits
        if int(self.freq.sum()) != 1 << bits:
            raise ValueError("frequencies must sum to the table's size")
        self.start = np.concatenate([[0], np.cumsum(self.freq)]).astype(np.uint64)
        # one more entry, of the whole range: coding it changes nothing, so it pads the last block
        self.enc_freq = np.append(self.freq, np.uint64(1 << bits))
        self.enc_start = np.append(self.start[:-1], np.uint64(0))
        self._symbols: np.ndarray | None = None

    @classmethod
    def fit(cls, counts: np.ndarray, bits: int = 20) -> Table:
        """The table nearest to these counts: shares rounded down, at least 1, the rest to (or from) the most frequent ids."""
        counts = np.asarray(counts, np.float64)
        n = int((counts > 0).sum())
        if n == 0:
            counts, n = np.append(counts, 1.0) if not len(counts) else np.eye(1, len(counts))[0], 1
        bits = max(bits, (2 * n - 1).bit_length())
        if bits > 28:
            raise ValueError("too many different ids for one table")
        size = 1 << bits
        freq = np.where(counts > 0, np.maximum(1, np.floor(counts / counts.sum() * size)), 0).astype(np.int64)
        order = np.argsort(-counts, kind="stable")[:n]
        left = size - int(freq.sum())
        if left >= 0:
            freq[order[0]] += left
        while left < 0:  # many rare ids were raised to 1: taken back evenly from those above 1
            give = np.minimum(freq[order] - 1, np.maximum(1, -left * freq[order] // freq.sum()))
            give = np.where(np.cumsum(give) <= -left, give, np.maximum(0, -left - (np.cumsum(give) - give)))
            freq[order] -= give
            left += int(give.sum())
        return cls(freq, bits)

    def to_bytes(self) -> bytes:
        body = struct.pack("<8sIQ", b"IDSTAB1\n", self.bits, len(self.freq)) + self.freq.astype("<u4").tobytes()
        return body + struct.pack("<I", zlib.crc32(body))

    @classmethod
    def from_bytes(cls, data: bytes) -> Table:
        magic, bits, n = struct.unpack_from("<8sIQ", data)
        if magic != b"IDSTAB1\n" or len(data) != 24 + 4 * n or zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("not a table of frequencies, or a damaged one")
        return cls(np.frombuffer(data, "<u4", n, 20), bits)

    @property
    def symbols(self) -> np.ndarray:
        """The id at each place of the range."""
        if self._symbols is None:
            self._symbols = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        return self._symbols


def encode(ids: np.ndarray, table: Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """States (blocks, LANES), words of each block, and all words (32 bits each) in block order."""
    blocks = -(-len(ids) // BLOCK)
    if not blocks:
        return np.zeros((0, LANES), np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
    if int(ids.max()) >= len(table.freq) or not table.freq[ids].all():
        raise ValueError("an id is not in the table")
    padded = np.full(blocks * BLOCK, len(table.freq), np.int64)
    padded[: len(ids)] = ids
    steps = padded.reshape(blocks, STEPS, LANES).transpose(1, 0, 2).reshape(STEPS, -1)
    state = np.full(blocks * LANES, LEAST, np.uint64)
    words, given = np.zeros((STEPS, blocks * LANES), np.uint32), np.zeros((STEPS, blocks * LANES), bool)
    bits, top = np.uint64(table.bits), np.uint64(63 - table.bits)
    for s in range(STEPS - 1, -1, -1):
        freq = table.enc_freq[steps[s]]
        full = (state >> top) >= freq
        given[s], words[s] = full, state & _LOW
        state = np.where(full, state >> _32, state)
        whole = state // freq
        state = (whole << bits) + (state - whole * freq) + table.enc_start[steps[s]]
    given = given.reshape(STEPS, blocks, LANES).transpose(1, 0, 2).reshape(blocks, -1)
    words = words.reshape(STEPS, blocks, LANES).transpose(1, 0, 2).reshape(blocks, -1)
    return state.reshape(blocks, LANES), given.sum(axis=1), words[given]


def decode(states: np.ndarray, sizes: np.ndarray, words: np.ndarray, n: int, table: Table) -> np.ndarray:
    """The n ids of consecutive blocks, from their checkpoints."""
    blocks = len(states)
    if not blocks:
        return np.zeros(0, np.uint32)
    state = states.reshape(-1).astype(np.uint64)
    out = np.empty((STEPS, blocks * LANES), np.uint32)
    bits, mask = np.uint64(table.bits), np.uint64((1 << table.bits) - 1)
    at = np.cumsum(sizes) - sizes  # next word of each block
    words = np.append(words, np.zeros(LANES, np.uint32))
    last = n - (blocks - 1) * BLOCK  # ids in the last block; other blocks are full
    for s in range(STEPS):
        slot = state & mask
        symbol = table.symbols[slot]
        out[s] = symbol
        fresh = table.freq[symbol] * (state >> bits) + slot - table.start[symbol]
        if (s + 1) * LANES > last:  # lanes of the last block that have no id here
            idle = slice((blocks - 1) * LANES + max(0, last - s * LANES), None)
            fresh[idle] = state[idle]
        need = (fresh < LEAST).reshape(blocks, LANES)
        taken = np.cumsum(need, axis=1)
        word = words[np.minimum(at[:, None] + taken - 1, len(words) - 1)].reshape(-1).astype(np.uint64)
        state = np.where(need.reshape(-1), (fresh << _32) | word, fresh)
        at = at + taken[:, -1]
    return out.reshape(STEPS, blocks, LANES).transpose(1, 0, 2).reshape(-1)[:n]


def pack(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray, table: Table) -> bytes:
    """A frame of whole documents."""
    states, sizes, words = encode(ids, table)
    ends = np.cumsum(sizes)
    sums = [zlib.crc32(words[b - k : b].astype("<u4").tobytes()) for b, k in zip(ends.tolist(), sizes.tolist())]
    known = np.array([d is not None for d in doc_ids], np.uint8)
    parts = [
        _HEAD.pack(MAGIC, len(doc_ids), len(ids), len(states), len(words)), known.tobytes(), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.asarray(lengths, "<u8").tobytes(),
        sizes.astype("<u8").tobytes(), np.array(sums, "<u4").tobytes(), states.astype("<u8").tobytes(), words.astype("<u4").tobytes(),
    ]
    body = b"".join(parts)
    return body + struct.pack("<I", zlib.crc32(body))


class Frame:
    """A frame's directory and checkpoints, read from its bytes; ids are decoded on demand."""

    def __init__(self, data: bytes, check: bool = True):
        if len(data) < _HEAD.size + 4 or data[:8] != MAGIC:
            raise ValueError("not a frame")
        if check and zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("damaged frame")
        _, docs, self.n_ids, blocks, n_words = _HEAD.unpack_from(data)
        at = _HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        known, ids = take("u1", docs), take("<i8", docs)
        self.doc_ids = [d if k else None for d, k in zip(ids.tolist(), known.tolist())]
        self.lengths = take("<u8", docs).astype(np.int64)
        self.sizes = take("<u8", blocks).astype(np.int64)
        self.sums = take("<u4", blocks)
        self.states = take("<u8", blocks * LANES).reshape(blocks, LANES)
        self.words = take("<u4", n_words)
        self.firsts = np.cumsum(self.sizes) - self.sizes

    def ids(self, table: Table, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids from start to stop; only the blocks that hold them are checked and decoded."""
        stop = self.n_ids if stop is None else stop
        if start >= stop:
            return np.zeros(0, np.uint32)
        a, b = start // BLOCK, -(-stop // BLOCK)
        for k in range(a, b):
            first = self.firsts[k]
            if zlib.crc32(self.words[first : first + self.sizes[k]].tobytes()) != self.sums[k]:
                raise ValueError(f"damaged block {k}")
        low, high = self.firsts[a], self.firsts[b - 1] + self.sizes[b - 1]
        out = decode(self.states[a:b], self.sizes[a:b], self.words[low:high], min(b * BLOCK, self.n_ids) - a * BLOCK, table)
        return out[start - a * BLOCK : stop - a * BLOCK]

    def document(self, i: int, table: Table) -> np.ndarray:
        end = int(self.lengths[: i + 1].sum())
        return self.ids(table, end - int(self.lengths[i]), end)
