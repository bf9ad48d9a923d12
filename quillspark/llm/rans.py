"""Static range asymmetric numeral coder for blocks of ids, in numpy.

A block's ids are dealt to LANES coder states in turn, which share one stream of 32-bit words; all blocks share
one frequency table. After every SEGMENT ids the block keeps a checkpoint: the states, the place in the stream and
the checksum of the ids up to the next one. A reader starts at any checkpoint, and decodes all segments side by side.

A block is a header (mark, ids, words, checkpoints, checksum of what follows), the checkpoints' places and
checksums, their states, and the words; all little-endian.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

LANES, SEGMENT = 2048, 2048 * 128
#: Frequencies add up to 2**SCALE; states lie from 2**31 to 2**63 and give up 32 bits at a time.
SCALE = 18
LOW, MASK, HALF = np.uint64(1 << 31), np.uint64((1 << SCALE) - 1), np.uint64(32)
#: Bits of a number below 2**SCALE, or just that, in the tables' entries.
FIELD, FIELD_MASK = SCALE + 1, np.uint64((1 << SCALE + 1) - 1)
HEAD, HEAD_BYTES = "<4sIIII", 20
MARK = b"QRA1"


def frequencies(counts: dict[int, int]) -> dict[int, int]:
    """Shares of 2**SCALE, one at least for every id that occurs; what rounding leaves goes to the most frequent one."""
    counts = {i: n for i, n in counts.items() if n > 0}
    if not counts:
        return {}
    if len(counts) > 1 << SCALE:
        raise ValueError(f"more than {1 << SCALE} different ids")
    total, room = sum(counts.values()), (1 << SCALE) - len(counts)
    out = {i: 1 + n * room // total for i, n in counts.items()}
    out[max(sorted(counts), key=counts.get)] += (1 << SCALE) - sum(out.values())
    return out


class Table:
    """The frequency table as arrays. ``code``: each id's share and first slot; ``slots``: each slot's id, its share and the place in it."""

    def __init__(self, shares: dict[int, int]) -> None:
        ids = np.array(sorted(shares), np.int64)
        own = np.array([shares[i] for i in ids.tolist()], np.int64)
        first = np.cumsum(own) - own
        self.code = np.zeros(int(ids[-1]) + 1 if len(ids) else 0, np.uint64)
        self.code[ids] = own << FIELD | first
        self.slots = (np.repeat(ids << 2 * FIELD | own << FIELD, own) + np.arange(own.sum()) - np.repeat(first, own)).astype(np.uint64)


def encode(ids: np.ndarray, table: Table) -> bytes:
    """A block of ``ids``, all of which have a share."""
    n = len(ids)
    state, words, emitted, kept = np.full(LANES, LOW, np.uint64), [], 0, []
    for at in range((n - 1) // LANES * LANES, -1, -LANES):  # backwards, as the decoder undoes the last step first
        own = ids[at : at + LANES]
        x, code = state[: len(own)], table.code[own]
        share = code >> np.uint64(FIELD)
        over = x >= share << np.uint64(63 - SCALE)
        if over.any():
            words.append(x[over].astype(np.uint32))
            emitted += len(words[-1])
            x[over] >>= HALF
        q = x // share
        x[:] = (q << np.uint64(SCALE)) + (x - q * share) + (code & FIELD_MASK)
        if at % SEGMENT == 0:
            kept.append((emitted, state.copy()))
    kept.reverse()
    whole = np.ascontiguousarray(ids, "<u4")
    places = np.array([[emitted - e, zlib.crc32(whole[k * SEGMENT : (k + 1) * SEGMENT])] for k, (e, _) in enumerate(kept)], "<u4").reshape(-1, 2)
    body = places.tobytes() + np.array([s for _, s in kept], "<u8").tobytes() + np.concatenate([np.zeros(0, np.uint32), *words[::-1]]).astype("<u4").tobytes()
    return struct.pack(HEAD, MARK, n, emitted, len(kept), zlib.crc32(body)) + body


def _run(x: np.ndarray, place: np.ndarray, words: np.ndarray, n: int, table: Table) -> np.ndarray:
    """``n`` ids from each of the checkpoints with states ``x`` and places in ``words``."""
    out = np.empty((len(x), n), np.uint32)
    for at in range(0, n, LANES):
        y = x[:, : min(LANES, n - at)]
        slot = table.slots[y & MASK]
        out[:, at : at + LANES] = slot >> np.uint64(2 * FIELD)
        y[:] = (slot >> np.uint64(FIELD) & FIELD_MASK) * (y >> np.uint64(SCALE)) + (slot & FIELD_MASK)
        short = y < LOW
        if short.any():
            next_ = (place[:, None] + np.cumsum(short, 1) - 1)[short]
            if not next_.max() < len(words):
                raise ValueError("a block ends too early: it was coded with another table")
            y[short] = (y[short] << HALF) | words[next_]
            place = place + short.sum(1)
    return out


def decode(block: bytes, table: Table, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Ids ``start`` to ``stop`` of a block; only the segments that hold them are decoded. ValueError if a checksum fails."""
    mark, n, n_words, n_kept, crc = struct.unpack_from(HEAD, block)
    body = memoryview(block)[HEAD_BYTES:]
    if mark != MARK or len(body) != n_kept * (8 + 8 * LANES) + 4 * n_words or zlib.crc32(body) != crc:
        raise ValueError("damaged block")
    stop = n if stop is None else min(stop, n)
    if start >= stop:
        return np.zeros(0, np.uint32)
    places = np.frombuffer(body, "<u4", 2 * n_kept).reshape(-1, 2)
    states = np.frombuffer(body, "<u8", n_kept * LANES, 8 * n_kept).reshape(-1, LANES)
    words = np.frombuffer(body, "<u4", n_words, n_kept * (8 + 8 * LANES)).astype(np.uint64)
    a, b = start // SEGMENT, -(-stop // SEGMENT)
    full = min(b, n // SEGMENT)
    parts = [_run(states[a:full].copy(), places[a:full, 0].astype(np.int64), words, SEGMENT, table).reshape(-1)] if a < full else []
    if b > full:
        parts.append(_run(states[b - 1 : b].copy(), places[b - 1 : b, 0].astype(np.int64), words, n - full * SEGMENT, table)[0])
    ids = np.concatenate(parts).astype("<u4")
    for k in range(a, b):
        if zlib.crc32(ids[(k - a) * SEGMENT : (k - a + 1) * SEGMENT]) != places[k, 1]:
            raise ValueError("decoded ids do not have their checksum")
    return ids[start - a * SEGMENT : stop - a * SEGMENT]


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo that of CRC-32; the top bit is x**0."""
    out = 0
    for k in range(31, -1, -1):
        out ^= b * (a >> k & 1)
        b = b >> 1 ^ 0xEDB88320 * (b & 1)
    return out


def crc_before(crc: int, size: int) -> int:
    """What a part's CRC-32 adds to that of the whole if ``size`` bytes follow: the whole's is the xor of all parts'."""
    power, square = 1 << 31, 1 << 23
    while size:
        if size & 1:
            power = _times(power, square)
        square, size = _times(square, square), size >> 1
    return _times(power, crc)
