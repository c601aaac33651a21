"""Operator 4: byte-level BPE encoding and decoding with a bitmap rank queue.

Each match of the split pattern is encoded by itself. Its bytes form a linked list;
every neighbouring pair that has a merge rank stands in that rank's bucket. A bitmap of
three levels of 64-bit words marks the ranks whose buckets hold anything, so that
find-first-set gives the next rank in three steps. A bucket yields its leftmost
position first; an entry whose pair has changed since is stale and skipped. Work is
linear in the bytes of a match, up to the order kept inside a bucket, which is what
very long matches need. Short matches recur, so each worker remembers their ids, and
looks up chunks of text (see ``vocab``) that no match crosses once for each batch.

Defined cases: a null text is an empty text, with no ids; other columns are ignored;
rows with the same doc_id are separate documents; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import functools
from array import array
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.vocab import byte_chunks, encode_chunks, split_stems, whole_byte
from quarry.session import small_batches, tidy

#: Matches of up to so many characters are remembered, so many of them at most.
SHORT, REMEMBERED = 48, 400_000


_BIT = [1 << k for k in range(64)]


class ByteBpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        token = {rank: token for token, rank in ranks.items()}
        self.tokens = pa.array(map(token.get, range(max(ranks.values()) + 1)), pa.binary())
        words = (max(ranks.values()) >> 6) + 1
        self.low = [0] * words  # bit r & 63 of word r >> 6: rank r's bucket holds something
        self.middle = [0] * ((words >> 6) + 1)  # the words of low that aren't 0; a third level fits one word
        self.pair_ranks = [[ranks.get(bytes((a, b))) for b in range(256)] for a in range(256)]
        self.known: dict[str, bytes] = {"": b""}

    def encode_match(self, data: bytes) -> list[int]:
        """The ids of one match: merges by least rank, leftmost first."""
        get = self.ranks.get
        whole = get(data)
        if whole is not None:
            return [whole]
        n = len(data)
        low, middle, top, bit, first_ranks = self.low, self.middle, 0, _BIT, self.pair_ranks
        buckets: dict[int, list[int]] = {}
        end = list(range(1, n + 1))  # where the part that begins here ends; part i is data[i:end[i]]
        before = list(range(-1, n - 1))
        pair = [first_ranks[a][b] for a, b in zip(data, data[1:])]  # rank of the part that begins here with the next
        pair.append(None)
        for i, rank in enumerate(pair):  # pushes are written out, since calls would cost as much as they do
            if rank is not None:
                bucket = buckets.get(rank)
                if bucket is not None:
                    bucket.append(i)
                else:
                    buckets[rank] = [i]
                    word = rank >> 6
                    low[word] |= bit[rank & 63]
                    middle[word >> 6] |= bit[word & 63]
                    top |= bit[word >> 6]
        while top:
            third = (top & -top).bit_length() - 1
            second = middle[third]
            word = third << 6 | (second & -second).bit_length() - 1
            first = low[word]
            rank = word << 6 | (first & -first).bit_length() - 1
            bucket = buckets[rank]
            if len(bucket) > 1:
                i = heappop(bucket)
            else:
                i = bucket[0]
                del buckets[rank]
                low[word] = first = first & (first - 1)
                if not first:
                    middle[third] = second = second & (second - 1)
                    if not second:
                        top &= top - 1
            if pair[i] != rank:  # stale
                continue
            j = end[i]
            stop = end[i] = end[j]
            pair[j] = None
            if stop < n:
                before[stop] = i
                new = pair[i] = get(data[i : end[stop]])
                if new is not None:
                    bucket = buckets.get(new)
                    if bucket is not None:
                        heappush(bucket, i)
                    else:
                        buckets[new] = [i]
                        word = new >> 6
                        low[word] |= bit[new & 63]
                        middle[word >> 6] |= bit[word & 63]
                        top |= bit[word >> 6]
            else:
                pair[i] = None
            h = before[i]
            if h >= 0:
                new = get(data[h:stop])
                if new != pair[h]:
                    pair[h] = new
                    if new is not None:
                        bucket = buckets.get(new)
                        if bucket is not None:
                            heappush(bucket, h)
                        else:
                            buckets[new] = [h]
                            word = new >> 6
                            low[word] |= bit[new & 63]
                            middle[word >> 6] |= bit[word & 63]
                            top |= bit[word >> 6]
        ids, i, ranks = [], 0, self.ranks
        while i < n:
            j = end[i]
            ids.append(ranks[data[i:j]])
            i = j
        return ids

    def _encode(self, text: str) -> bytes:
        """Ids of a text or chunk, its matches looked up or encoded."""
        known, parts = self.known, []
        for match in self.pattern.findall(text):
            ids = known.get(match)
            if ids is None:
                ids = array("i", self.encode_match(match.encode())).tobytes()
                if len(match) <= SHORT:
                    known[match] = ids
            parts.append(ids)
        return b"".join(parts)

    def _lookup(self, chunks: list[str]) -> list[bytes]:
        known = self.known
        if len(known) > REMEMBERED:  # keep the older part: frequent matches come early
            for match in list(known)[REMEMBERED * 2 // 3 :]:
                del known[match]
        stems, tails, plain = split_stems(chunks, words=False)
        for stem, letters in {x: p for x, p in zip(stems, plain) if x not in known}.items():
            if letters:  # one match by itself
                ids = self.encode_match(stem.encode())
                known[stem] = array("i", ids).tobytes()
        found = []
        for stem, tail, letters in zip(stems, tails, plain):
            ids = known[stem] if letters else self._encode(stem)
            found.append(ids + (known.get(tail) or self._encode(tail)) if tail else ids)
        for stem in {x for x in stems if len(x) > SHORT}:  # what is remembered is bounded in bytes as well
            known.pop(stem, None)
        return found

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and where each text's begin and end."""
        return encode_chunks(texts, byte_chunks, whole_byte, self._lookup, self._encode, np.int32)

    def encode(self, text: str) -> list[int]:
        return self.encode_batch([text])[0].tolist()

    def decode_batch(self, ids: pa.Array, bounds: np.ndarray) -> pa.Array:
        """The bytes of all texts whose ids stand one after the other, by their bounds."""
        parts = self.tokens.take(ids)
        if parts.null_count:
            raise KeyError("an id without a token")
        if not len(ids):
            return pa.array([b""] * (len(bounds) - 1), pa.binary())
        _, places, data = parts.buffers()
        ends = np.frombuffer(places, np.int32)[parts.offset :][bounds]
        return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(ends), data])

    def decode(self, ids) -> bytes:
        return self.decode_batch(pa.array(ids, pa.int32()), np.array([0, len(ids)]))[0].as_py()


@functools.lru_cache(maxsize=2)
def coder(path: str, pattern: str) -> ByteBpe:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return ByteBpe(ranks, pattern)


def encode_documents(docs: DataFrame, ranks: str, pattern: str, decoded: bool = False) -> DataFrame:
    """(doc_id, ids) of every whole text; if ``decoded``, with the bytes decoded from the ids,
    for which the same worker serves."""
    small_batches(docs.sparkSession, 1000, 3)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(ranks, pattern)
        for batch in batches:
            ids, bounds = bpe.encode_batch([text or "" for text in batch.column(1).to_pylist()])
            ids = pa.array(ids)
            columns = {"doc_id": batch.column(0), "ids": pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), ids)}
            if decoded:
                columns["decoded"] = bpe.decode_batch(ids, bounds)
            yield pa.RecordBatch.from_pydict(columns)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(encode), "doc_id long, ids array<int>" + ", decoded binary" * decoded)


def decode_documents(encoded: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """Adds the decoded bytes to (doc_id, ids)."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(ranks, pattern)
        for batch in batches:
            ids = batch.column(1)
            bounds = np.append(0, np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False)))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, bpe.decode_batch(ids.flatten(), bounds)], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(tidy(decode), "doc_id long, ids array<int>, decoded binary")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    files = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_documents(docs, *files, decoded=True).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
