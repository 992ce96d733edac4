"""Static range asymmetric numeral system over token ids, vectorised by lanes.

A segment holds whole documents. Its frequency table is counted over all of its
tokens and shared by its blocks; each block of BLOCK_TOKENS is coded on its own
by LANES interleaved 64-bit states, so any block can be decoded alone. The
checkpoint of a block gives its first token, byte range and CRC-32.

Layout, little-endian: header (HEADER), document ids i64, null flags u8, lengths
u64, symbols u32, frequencies u32, checkpoints (u64 first token, u64 offset,
u64 bytes, u32 crc32), u32 crc32 of all so far, then the blocks: LANES states
u64 and the words u32 in decoding order.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

MAGIC = b"RTOK"
HEADER = "<4sHHIIQQI"  # magic, version, scale bits, lanes, blocks, documents, tokens, symbols
CHECKPOINT = np.dtype([("first", "<u8"), ("offset", "<u8"), ("bytes", "<u8"), ("crc", "<u4")])
LANES = 512
BLOCK_TOKENS = 1 << 18
LOW = np.uint64(1 << 31)  # states stay in [2**31, 2**63)
WORD = np.uint64(32)


def frequencies(counts: np.ndarray, scale: int) -> np.ndarray:
    """Counts of the symbols present, scaled to sum 2**scale, each at least 1."""
    whole = 1 << scale
    freq = np.maximum(1, (counts * (whole / counts.sum())).astype(np.int64))
    excess = int(freq.sum()) - whole
    for i in np.argsort(-freq, kind="stable"):
        if excess <= 0:
            freq[i] -= excess  # a shortfall goes to the most frequent symbol
            break
        step = min(int(freq[i]) - 1, excess)
        freq[i] -= step
        excess -= step
    return freq.astype(np.uint64)


def encode_block(at: np.ndarray, freq: np.ndarray, cum: np.ndarray, scale: int) -> bytes:
    """Bytes of one block; ``at`` are positions in the symbol table."""
    state = np.full(LANES, LOW, np.uint64)
    limit = freq << np.uint64(63 - scale)
    bits = np.uint64(scale)
    words = []
    for lo in range((len(at) - 1) // LANES * LANES, -1, -LANES):
        sym = at[lo : lo + LANES]
        x = state[: len(sym)]
        full = x >= limit[sym]
        words.append(x[full].astype(np.uint32))
        x = np.where(full, x >> WORD, x)
        f = freq[sym]
        q = x // f
        state[: len(sym)] = (q << bits) + (x - q * f) + cum[sym]
    return state.astype("<u8").tobytes() + np.concatenate(words[::-1]).astype("<u4").tobytes()


def decode_block(raw: bytes, n: int, table: np.ndarray, freq: np.ndarray, cum: np.ndarray, scale: int) -> np.ndarray:
    """Positions in the symbol table of the ``n`` tokens of a block."""
    state = np.frombuffer(raw, "<u8", LANES).astype(np.uint64)
    words = np.frombuffer(raw, "<u4", offset=8 * LANES).astype(np.uint64)
    mask, bits = np.uint64((1 << scale) - 1), np.uint64(scale)
    out = np.empty(n, np.int64)
    at = 0
    for lo in range(0, n, LANES):
        x = state[: min(LANES, n - lo)]
        slot = x & mask
        sym = table[slot]
        out[lo : lo + len(x)] = sym
        x = freq[sym] * (x >> bits) + slot - cum[sym]
        low = np.flatnonzero(x < LOW)
        x[low] = (x[low] << WORD) | words[at : at + len(low)]
        at += len(low)
        state[: len(x)] = x
    return out


def pack_segment(doc_ids: np.ndarray, nulls: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """One segment; ``ids`` are all tokens of its documents in order."""
    counts = np.bincount(ids) if len(ids) else np.zeros(0, np.int64)
    symbols = np.flatnonzero(counts)
    scale = max(16, int(len(symbols)).bit_length() + 4)
    freq = frequencies(counts[symbols], scale) if len(symbols) else np.zeros(0, np.uint64)
    cum = np.cumsum(freq) - freq
    place = np.zeros(len(counts), np.int64)
    place[symbols] = np.arange(len(symbols))
    firsts = range(0, len(ids), BLOCK_TOKENS)
    blocks = [encode_block(place[ids[lo : lo + BLOCK_TOKENS]], freq, cum, scale) for lo in firsts]
    checks = np.zeros(len(blocks), CHECKPOINT)
    checks["first"] = list(firsts)
    checks["bytes"] = [len(b) for b in blocks]
    checks["offset"] = np.cumsum(checks["bytes"]) - checks["bytes"]
    checks["crc"] = [zlib.crc32(b) for b in blocks]
    head = b"".join(
        [
            struct.pack(HEADER, MAGIC, 1, scale, LANES, len(blocks), len(doc_ids), len(ids), len(symbols)),
            doc_ids.astype("<i8").tobytes(),
            nulls.astype("u1").tobytes(),
            lengths.astype("<u8").tobytes(),
            symbols.astype("<u4").tobytes(),
            freq.astype("<u4").tobytes(),
            checks.tobytes(),
        ]
    )
    return b"".join([head, struct.pack("<I", zlib.crc32(head)), *blocks])


class Segment:
    """A segment opened for reading; blocks are decoded on request."""

    def __init__(self, raw: bytes) -> None:
        magic, version, self.scale, lanes, n_blocks, n_docs, self.n_tokens, n_symbols = struct.unpack_from(HEADER, raw)
        if magic != MAGIC or version != 1 or lanes != LANES:
            raise ValueError("not a token segment of this version")
        at = struct.calcsize(HEADER)

        def take(dtype: str | np.dtype, n: int) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(raw, dtype, n, at)
            at += got.nbytes
            return got

        self.doc_ids, self.nulls = take("<i8", n_docs), take("u1", n_docs).astype(bool)
        self.lengths = take("<u8", n_docs).astype(np.int64)
        self.symbols = take("<u4", n_symbols)
        self.freq = take("<u4", n_symbols).astype(np.uint64)
        self.checks = take(CHECKPOINT, n_blocks)
        if zlib.crc32(raw[:at]) != struct.unpack_from("<I", raw, at)[0]:
            raise ValueError("damaged segment header")
        self.raw, self.base = raw, at + 4
        self.cum = np.cumsum(self.freq) - self.freq
        self.table = np.repeat(np.arange(n_symbols), self.freq.astype(np.int64))

    def block(self, i: int) -> np.ndarray:
        """Token ids of block ``i``."""
        c = self.checks[i]
        lo = self.base + int(c["offset"])
        raw = self.raw[lo : lo + int(c["bytes"])]
        if zlib.crc32(raw) != int(c["crc"]):
            raise ValueError(f"damaged block {i}")
        n = min(BLOCK_TOKENS, self.n_tokens - int(c["first"]))
        return self.symbols[decode_block(raw, n, self.table, self.freq, self.cum, self.scale)]

    def documents(self) -> Iterator[np.ndarray]:
        """Token ids of each document, block by block."""
        held, i = np.zeros(0, np.uint32), 0
        for n in self.lengths:
            parts, missing = [], int(n)
            while missing > len(held):
                parts.append(held)
                missing -= len(held)
                held = self.block(i)
                i += 1
            yield np.concatenate([*parts, held[:missing]])
            held = held[missing:]
