"""Static range asymmetric numeral system for token ids: coder and segment format.

A *segment* holds the ids of some whole documents.  It has one frequency table, which
all its blocks share.  A block is coded alone: its ids go to ``LANES`` interleaved
states in turn (id i to lane i mod LANES), each a 63-bit state that gives off and takes in
32-bit words.  Every ``STEP`` rounds a checkpoint keeps the lanes' states and the place
in the word stream, so all sections of all blocks can be decoded side by side, here
as one vector.  Each block carries checksums of its stored bytes and of its ids, and
the state at the end of a section must be that of the next checkpoint.

Layout, little-endian: magic, version, scale bits, lanes, step, number of ids, blocks,
rounds a block, symbols; table (symbols u4, frequencies u4); then per block: number of words
(u8), crc32 of the stored part, crc32 of the ids as u4; then per block its stored part:
checkpoint states (u8, section by section), checkpoint places (u8), words (u4).
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"RANS"
VERSION = 1
LOW = np.uint64(1 << 31)
SCALE = 20
LANES = 64
BLOCK = 1 << 16
STEP = 256
_HEAD = struct.Struct("<4sIIIIQIII")
_BLOCK = struct.Struct("<QII")


def frequencies(counts: np.ndarray, scale: int) -> np.ndarray:
    """Positive integers that sum to 2**scale, close in proportion to positive counts."""
    total = 1 << scale
    f = np.maximum(1, counts.astype(np.float64) * (total / counts.sum())).astype(np.int64)
    order = np.argsort(-f, kind="stable")
    rest = total - int(f.sum())
    f[order[0]] += max(0, rest)
    while rest < 0:                                # too many symbols were raised to 1
        give = np.minimum(f[order] - 1, np.maximum(1, (f[order] * (-rest / total)).astype(np.int64)))
        give = np.where(np.cumsum(give) <= -rest, give, np.maximum(0, -rest - (np.cumsum(give) - give)))
        f[order] -= give
        rest += int(give.sum())
    return f


def _kinds(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct ids, each id's place among them, their counts."""
    if int(ids.max()) >= 1 << 22:
        return np.unique(ids, return_inverse=True, return_counts=True)
    counts = np.bincount(ids)
    symbols = np.flatnonzero(counts)
    place = np.zeros(len(counts), np.int64)
    place[symbols] = np.arange(len(symbols))
    return symbols, place[ids], counts[symbols]


def encode_segment(ids: np.ndarray, block: int = BLOCK, lanes: int = LANES, step: int = STEP) -> bytes:
    """The segment of some ids (unsigned 32-bit, any number of them)."""
    n = len(ids)
    if not n:
        return _HEAD.pack(MAGIC, VERSION, SCALE, lanes, step, 0, 0, 0, 0)
    symbols, where, counts = _kinds(ids)
    scale = max(SCALE, int(len(symbols)).bit_length() + 2)
    f = frequencies(counts, scale)
    start = np.cumsum(f) - f
    blocks = -(-n // block)
    rounds = -(-n // (blocks * lanes))
    padded = np.full(blocks * rounds * lanes, int(np.argmax(f)), np.int64)
    # block b holds ids [b * rounds * lanes, ...): equal blocks, only the last is padded
    padded[:n] = where
    turns = np.ascontiguousarray(padded.reshape(blocks, rounds, lanes).transpose(1, 0, 2)).reshape(rounds, blocks * lanes)
    freq, low = f.astype(np.uint64), start.astype(np.uint64)
    limit = ((LOW >> np.uint64(scale)) << np.uint64(32)) * freq
    state = np.full(blocks * lanes, LOW, np.uint64)
    sections = -(-rounds // step)
    checkpoints = np.zeros((sections, blocks * lanes), np.uint64)
    words, owners, given = [], [], np.zeros((rounds, blocks), np.int64)
    half, shift = np.uint64(32), np.uint64(scale)
    for t in range(rounds - 1, -1, -1):
        s = turns[t]
        fs = freq[s]
        full = np.flatnonzero(state >= limit[s])
        words.append(state[full].astype(np.uint32))            # the lower half
        owners.append(full // lanes)
        given[t] = np.bincount(owners[-1], minlength=blocks)
        state[full] >>= half
        q = state // fs
        state = (q << shift) + (state - q * fs) + low[s]
        if t % step == 0:
            checkpoints[t // step] = state
    stream, owner = np.concatenate(words[::-1]), np.concatenate(owners[::-1])
    stream = stream[np.argsort(owner, kind="stable")]
    ends = np.cumsum(given.sum(axis=0))
    places = np.concatenate([np.zeros((1, blocks), np.int64), np.cumsum(given, axis=0)])[0:rounds:step]
    head, parts = [], []
    for b in range(blocks):
        own = stream[(ends[b - 1] if b else 0):ends[b]]
        part = checkpoints[:, b * lanes:(b + 1) * lanes].astype("<u8").tobytes() + places[:, b].astype("<u8").tobytes() + own.astype("<u4").tobytes()
        mine = ids[b * rounds * lanes:(b + 1) * rounds * lanes].astype("<u4").tobytes()
        head.append(_BLOCK.pack(len(own), zlib.crc32(part), zlib.crc32(mine)))
        parts.append(part)
    return b"".join([_HEAD.pack(MAGIC, VERSION, scale, lanes, step, n, blocks, rounds, len(symbols)),
                     symbols.astype("<u4").tobytes(), f.astype("<u4").tobytes(), *head, *parts])


def decode_segment(data: bytes) -> np.ndarray:
    """The ids of a segment; every section of every block decoded side by side."""
    magic, version, scale, lanes, step, n, blocks, rounds, kinds = _HEAD.unpack_from(data)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a token segment")
    if not n:
        return np.zeros(0, np.uint32)
    at = _HEAD.size
    symbols = np.frombuffer(data, "<u4", kinds, at)
    f = np.frombuffer(data, "<u4", kinds, at + 4 * kinds).astype(np.uint64)
    at += 8 * kinds
    heads = [_BLOCK.unpack_from(data, at + b * _BLOCK.size) for b in range(blocks)]
    at += blocks * _BLOCK.size
    sections = -(-rounds // step)
    states, places, stream, base = [], [], [], 0
    for size, stored, _ in heads:
        length = sections * (lanes + 1) * 8 + 4 * size
        if zlib.crc32(data[at:at + length]) != stored:
            raise ValueError("a block's stored bytes are damaged")
        states.append(np.frombuffer(data, "<u8", sections * lanes, at).reshape(sections, lanes))
        places.append(np.frombuffer(data, "<u8", sections, at + 8 * sections * lanes).astype(np.int64) + base)
        stream.append(np.frombuffer(data, "<u4", size, at + 8 * sections * (lanes + 1)))
        at, base = at + length, base + size
    words = np.concatenate([*stream, np.zeros(1, "<u4")]).astype(np.uint64)
    state = np.stack(states)                       # (block, section, lane)
    place = np.stack(places)                       # (block, section)
    low = np.cumsum(f) - f
    slot = np.repeat(np.arange(kinds, dtype=np.int32), f.astype(np.int64))
    mask, shift, half = np.uint64((1 << scale) - 1), np.uint64(scale), np.uint64(32)
    out = np.zeros((blocks, sections, step, lanes), np.int32)
    ends = state[:, 1:].copy()
    for t in range(step):
        # the last section may have fewer rounds
        live = sections if (sections - 1) * step + t < rounds else sections - 1
        if not live:
            break
        x = state[:, :live]
        part = x & mask
        s = slot[part]
        out[:, :live, t] = s
        x = f[s] * (x >> shift) + part - low[s]
        need = x < LOW
        rank = np.cumsum(need, axis=2)
        word = words[np.where(need, place[:, :live, None] + rank - 1, 0)]
        state[:, :live] = np.where(need, (x << half) | word, x)
        place[:, :live] += rank[:, :, -1]
    if not (state[:, :-1] == ends).all():
        raise ValueError("a section does not end in the next checkpoint")
    ids = symbols[out.reshape(blocks, sections * step, lanes)[:, :rounds].reshape(-1)[:n]]
    for b, (_, _, crc) in enumerate(heads):
        if zlib.crc32(ids[b * rounds * lanes:(b + 1) * rounds * lanes].tobytes()) != crc:
            raise ValueError("a block's ids differ from their checksum")
    return ids
