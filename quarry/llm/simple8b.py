"""Simple-8b word-aligned coding of token ids (operator 1).

A word has a selector in its top 4 bits and 60 bits of data. Selectors 2 to 15 pack
from 60 ids of 1 bit to 1 id of 60 bits, selector 1 stands for 240 zeros, and selector
0 is the escape: the whole next word is one id. A block holds 256 ids (the last one
fewer); the directory of a segment has each block's first word, so blocks decode alone
and all at once. An id sequence may end inside a word: the slots left are zero.

Segment layout, little endian: magic ``S8B1``; u32 documents; u64 ids; u32 blocks;
u64 words; then per document i64 doc_id and u64 first id; per block u64 first word;
the words.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np

BLOCK = 256
MAGIC = b"S8B1"
_HEAD = struct.Struct("<4sIQIQ")
#: Slots and bits of selectors 0 to 15 (fixed values of this format).
SLOTS = np.array([1, 240, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([64, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])


def _widths(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs; 64 for those that only an escape can hold."""
    if not len(values) or values.max() < 1 << 53:  # exact as doubles: the exponent is the number of bits
        return np.frexp(values.astype(np.float64))[1].astype(np.uint8)
    high = np.frexp((values >> np.uint64(32)).astype(np.float64))[1]
    low = np.frexp((values & np.uint64(0xFFFFFFFF)).astype(np.float64))[1]
    out = np.where(high > 0, high + 32, low).astype(np.uint8)
    out[out > 60] = 64
    return out


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words, and the first word of each block. All blocks advance together."""
    values = np.asarray(values, np.uint64)
    n = len(values)
    blocks = -(-n // BLOCK)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    padded = np.zeros(blocks * BLOCK, np.uint64)
    padded[:n] = values
    width = np.zeros((blocks, 2 * BLOCK), np.uint8)  # zeros behind a block let its last word run over
    width[:, :BLOCK] = _widths(padded).reshape(blocks, BLOCK)
    # choice[b, i]: the selector with most slots whose ids all fit from i on
    choice = np.zeros((blocks, BLOCK), np.uint8)
    level = {1: width}
    for half in (1, 2, 4, 8, 16, 32, 64):
        low = level[half]
        level[2 * half] = np.maximum(low[:, : low.shape[1] - half], low[:, half:])
    for selector in range(15, 0, -1):
        slots = int(SLOTS[selector])
        base = max(k for k in level if k <= slots)
        low = level[base]
        most = np.maximum(low[:, :BLOCK], low[:, slots - base : slots - base + BLOCK])
        np.copyto(choice, selector, where=most <= BITS[selector])
    position = np.zeros(blocks, np.int64)
    ends = np.full(blocks, BLOCK)
    ends[-1] = n - (blocks - 1) * BLOCK
    steps = []  # of each step, where each block's next word starts, or -1 behind its end
    row = np.arange(blocks)
    while (alive := position < ends).any():
        at = np.where(alive, position, 0)
        steps.append(np.where(alive, position, -1))
        position += np.where(alive, SLOTS[choice[row, at]], 0)
    start = np.array(steps).T + BLOCK * row[:, None]
    owner, step = np.nonzero(start >= BLOCK * row[:, None])
    start = start[owner, step]
    selector = choice.ravel()[start]
    size = 1 + (selector == 0)  # an escape takes two words
    place = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), np.uint64)
    flat = np.concatenate([padded, np.zeros(BLOCK, np.uint64)])
    for kind in np.unique(selector):
        rows = np.flatnonzero(selector == kind)
        if kind == 0:
            words[place[rows] + 1] = flat[start[rows]]
            continue
        word = np.full(len(rows), np.uint64(int(kind) << 60))
        if kind > 1:
            end = (owner[rows] + 1) * BLOCK
            for slot in range(int(SLOTS[kind])):
                at = start[rows] + slot
                word |= np.where(at < end, flat[at], np.uint64(0)) << np.uint64(slot * int(BITS[kind]))
        words[place[rows]] = word
    first = place[np.searchsorted(start, np.arange(blocks) * BLOCK)]
    return words, first


def decode(words: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """The ids, for all blocks at once: only finding the words of escapes follows the chain."""
    if not n:
        return np.zeros(0, np.uint64)
    blocks = len(first)
    kind = (words >> np.uint64(60)).astype(np.int64)
    ends = np.append(first[1:], len(words))
    literal = np.zeros(len(words), bool)
    if (kind == 0).any():  # a literal may look like any word, so walk the blocks that may hold escapes
        at = first.astype(np.int64).copy()
        alive = np.arange(blocks)
        while len(alive):
            here = at[alive]
            escape = kind[here] == 0
            literal[here[escape] + 1] = True
            at[alive] = here + 1 + escape
            alive = alive[at[alive] < ends[alive]]
    heads = np.flatnonzero(~literal)
    selector = kind[heads]
    block = np.searchsorted(first, heads, side="right") - 1
    slots = SLOTS[selector]
    before = np.cumsum(slots) - slots
    head_of = np.searchsorted(heads, first)
    offset = before - before[head_of][block] + block * BLOCK  # of the word's first id
    out = np.zeros((blocks + 2) * BLOCK, np.uint64)
    limit = (block + 1) * BLOCK
    for k in np.unique(selector):
        rows = np.flatnonzero(selector == k)
        if k == 0:
            out[offset[rows]] = words[heads[rows] + 1]
        elif k > 1:
            mask = np.uint64((1 << int(BITS[k])) - 1)
            for slot in range(int(SLOTS[k])):
                at = offset[rows] + slot
                inside = at < limit[rows]
                out[at[inside]] = (words[heads[rows]][inside] >> np.uint64(slot * int(BITS[k]))) & mask
    return out[:n]


def pack_segment(doc_ids: list[int], lengths: list[int], ids: np.ndarray) -> bytes:
    words, first = encode(ids)
    starts = np.cumsum([0, *lengths[:-1]]) if lengths else np.zeros(0)
    head = _HEAD.pack(MAGIC, len(doc_ids), len(ids), len(first), len(words))
    return b"".join([head, np.array(doc_ids, "<i8").tobytes(), starts.astype("<u8").tobytes(), first.astype("<u8").tobytes(), words.astype("<u8").tobytes()])


def unpack_segment(data: bytes) -> Iterator[tuple[int, int, np.ndarray]]:
    """(doc_id, first id in the segment, ids) of each document."""
    magic, docs, n, blocks, count = _HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a segment of this format")
    at = _HEAD.size
    doc_ids = np.frombuffer(data, "<i8", docs, at)
    starts = np.frombuffer(data, "<u8", docs, at + 8 * docs).astype(np.int64)
    first = np.frombuffer(data, "<u8", blocks, at + 16 * docs).astype(np.int64)
    words = np.frombuffer(data, "<u8", count, at + 16 * docs + 8 * blocks)
    ids = decode(words, first, n)
    for doc, start, end in zip(doc_ids.tolist(), starts.tolist(), [*starts[1:].tolist(), n]):
        yield doc, start, ids[start:end]
