"""Operator 7: n-gram Jaccard join by parity sketches.

A document is its set of five-word shingles, as 64-bit hashes. Two documents link when
their Jaccard similarity is at least 0.75, that is when the symmetric difference has at
most (a + b) / 7 elements, a and b being the sizes of the sets. Equal sets are one class;
classes are what is compared.

*Sketches.* In a size band the shingles of a set are dealt to parts by their hash, and
each part is the XOR of its shingles' codes. Common shingles cancel, so the number of
parts in which two sketches differ bounds their symmetric difference from below. Another
sketch, one parity bit for each of at least 4a positions, bounds it in the same way by its
Hamming distance.

*Size bands.* A pair belongs to the band of its smaller set, so a set takes part in its
own band and, as the larger one, in those where a partner may be. In a band it differs
from any partner in at most d parts, d following from its own size and the greatest
partner's. All parts stand in one order that both sets share; two sets that each differ
from the other in at most d (d') parts must then agree on one among the first d + 1 (d' + 1)
parts of each. Those parts with their XOR are the join keys: a whole pigeonhole, at every
size. The order puts parts with an uncommon shingle first and empty parts last, so that
passages that many documents share seldom make keys. Which shingles are common is counted
over the whole corpus in a table of fixed size; it only orders the parts, and no link
depends on it.

*Stars.* A key's bucket gives the pairs of its least member with the others, not all
pairs. A task that sees many members of one key replaces their key by one of its own and
passes on their least member only, so no bucket gathers more than a few rows a task; such
a member is the head of its task's star.
Pairs that sizes and parity bits don't exclude are verified on the whole sets, and links
give components.

*Crossing.* Stars are made whole again first: the members of a head's star are members of
the head's bucket too. The members of a star that are then still in different components are
compared by their parity bits: those outside the star's largest component with all, in
blocks of bounded size. Each such component sends its nearest pairs of a block to
verification. If it had more, and they remain apart, the round is repeated with more pairs,
until every pair that might link has been verified or joined otherwise.

Defined cases: a null, empty or blank text has no shingles and links with nothing; rows
with the same doc_id and different texts are separate documents that share the id;
repeated rows are returned as often as they come; a null doc_id takes part and gives no
component id of its own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.components import components, lookup
from quarry.llm.shingles import mix, shingle_sets
from quarry.session import Scratch, small_batches, tidy

MOST_BITS = 1 << 16
#: Counters of common shingles.
SLOTS = 1 << 22
#: Counters that travel as one row, and rows that are added up at once.
SLICE, FAN_IN = 1 << 16, 64
#: Rows that a task looks through for keys that it sees at least OFTEN times.
HELD, OFTEN = 400_000, 64
#: Keys of a task's own are at least OWN; others have KEY_BITS.
OWN, KEY_BITS = 1 << 57, 48
#: Shingles whose keys make a bucket of packed keys, on average.
BUCKET = 1 << 22
#: Members and outsiders that meet in a block at most.
BLOCK = 2048
#: Pairs that a component sends to verification from a block, in the first round.
NEAREST = 64


def _edges() -> list[int]:
    edges = list(range(1, 9))
    while edges[-1] < 1 << 40:
        edges.append(2 * edges[-1])
    return edges


#: The least size of each band.
EDGES = np.array(_edges())


def band_parts(band: np.ndarray) -> np.ndarray:
    """Parts of a band: more than the greatest number in which a link may differ, and a
    seventh on top so that few of the keyed parts are empty."""
    return ((EDGES[band + 1] - 1) // 3 + 1) * 8 // 7 + 1


def bands(size: np.ndarray, below: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sets of these sizes: which take part in the band ``below`` places under their own,
    that band, and how many keys each needs there."""
    own = np.searchsorted(EDGES, size, "right") - 1
    least = np.searchsorted(EDGES, -(-3 * size // 4), "right") - 1  # the band of the smallest partner
    band = own - below
    taking = np.flatnonzero((size > 0) & (band >= least) & (band >= 0))
    band, size = band[taking], size[taking]
    greatest = 4 * size // 3 if below == 0 else EDGES[band + 1] - 1
    return taking, band, (size + greatest) // 7 + 1


def common_slots(bitmap: np.ndarray, shingles: np.ndarray) -> np.ndarray:
    """Whether each shingle is common by the bitmap of slots."""
    slot = slots(shingles)
    return (bitmap[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1) == 1


def slots(shingles: np.ndarray) -> np.ndarray:
    return ((shingles >> np.uint64(3)) & np.uint64(SLOTS - 1)).astype(np.int64)


def keys(sets: list[np.ndarray], common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The join keys of all sets in all their bands, and whose each is."""
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    starts = np.cumsum(sizes) - sizes
    codes, dealt, usual = mix(flat, salt=0x77), flat >> np.uint64(20), common_slots(common, flat)
    out, whose = [], []
    below = 0
    while True:
        taking, band, need = bands(sizes, below)
        if below and not len(taking):
            break
        below += 1
        parts, n = band_parts(band), sizes[taking]
        first = np.cumsum(parts) - parts
        rows = np.repeat(starts[taking] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        part = (dealt[rows] % np.repeat(parts, n).astype(np.uint64)).astype(np.int64) + np.repeat(first, n)
        total = int(parts.sum())
        sketch = np.zeros(total, np.uint64)
        np.bitwise_xor.at(sketch, part, codes[rows])
        kind = np.full(total, 2, np.uint64)  # empty
        kind[part] = 1
        kind[part[~usual[rows]]] = 0
        owner = np.repeat(np.arange(len(taking)), parts)
        place = (np.arange(total) - np.repeat(first, parts)).astype(np.uint64)
        token = mix(mix(sketch) + (np.repeat(band, parts).astype(np.uint64) << np.uint64(40)) + place)
        token = (kind << np.uint64(62)) | (token >> np.uint64(2))  # the order of the parts
        order = np.lexsort((token, owner))
        chosen = np.repeat(first - (np.cumsum(need) - need), need) + np.arange(int(need.sum()))
        out.append(token[order[chosen]] >> np.uint64(6))
        whose.append(np.repeat(taking, need))
    return np.concatenate(out).view(np.int64), np.concatenate(whose)


def parity_bits(shingles: np.ndarray) -> bytes:
    """One parity bit for each position; a longer sketch folds into a shorter one."""
    bits = 64
    while bits < 4 * len(shingles) and bits < MOST_BITS:
        bits *= 2
    place = (shingles & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits(np.bincount(place, minlength=bits) & 1, bitorder="little").astype(np.uint8).tobytes()


def folded(sketch: np.ndarray, size: int) -> np.ndarray:
    while len(sketch) > size:
        half = len(sketch) // 2
        sketch = sketch[:half] ^ sketch[half:]
    return sketch


def apart(bits_a: bytes, bits_b: bytes) -> int:
    """The Hamming distance of two sketches, at most the symmetric difference of the sets."""
    x, y = np.frombuffer(bits_a, np.uint64), np.frombuffer(bits_b, np.uint64)
    size = min(len(x), len(y))
    return int(np.bitwise_count(folded(x, size) ^ folded(y, size)).sum())


def may_link(bits_a: bytes, bits_b: bytes, a: int, b: int) -> bool:
    """Whether sizes and parity bits leave room for a link."""
    return 4 * min(a, b) >= 3 * max(a, b) and 7 * apart(bits_a, bits_b) <= a + b


def fingerprint(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that equal sets share."""
    if not len(shingles):
        return 0, 0
    return int(np.bitwise_xor.reduce(mix(shingles, 1)).view(np.int64)), int(mix(shingles, 2).sum(dtype=np.uint64).view(np.int64))


def class_ids(sets: list[np.ndarray], salt: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Size, both fingerprints and 64-bit id of each set's class."""
    size = np.array([len(s) for s in sets], np.int64)
    prints = np.array([fingerprint(s) for s in sets], np.int64).reshape(-1, 2)
    node = mix(mix(prints[:, 0].astype(np.uint64), salt) + mix(prints[:, 1].astype(np.uint64), 3) + size.astype(np.uint64))
    return size, prints[:, 0], prints[:, 1], node.view(np.int64)


def links(a: np.ndarray, b: np.ndarray) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= 75 * (len(a) + len(b) - common)


SKETCHES = "doc_id long, n_shingles long, print1 long, print2 long, node long, bits binary, common binary"


def sketch_documents(docs: DataFrame, salt: int = 0) -> DataFrame:
    """Size, fingerprints, class and parity bits of every document's set.

    A task gives the bits of a class once. Its last rows, of size -1, are its counters of
    shingles, a slice each: doc_id is the slice's number and print1 the task's.
    """
    small_batches(docs.sparkSession, 4000, 2)
    names = [x.split()[0] for x in SKETCHES.split(", ")]

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        counters, seen = np.zeros(SLOTS, np.uint32), set()
        for batch in batches:
            sets = shingle_sets(batch.column(1).to_pylist())
            size, print1, print2, node = class_ids(sets, salt)
            bits = []
            for s, k in zip(sets, node.tolist()):
                if len(s) and k not in seen:
                    seen.add(k)
                    np.add.at(counters, slots(s), 1)
                    bits.append(parity_bits(s))
                else:
                    bits.append(None)
            numbers = [pa.array(x) for x in (size, print1, print2, node)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *numbers, pa.array(bits, pa.binary()), pa.nulls(len(sets), pa.binary())], names)
        if seen:
            n = SLOTS // SLICE
            slices = [deflated(x) for x in np.minimum(counters, 65535).astype(np.uint16).reshape(n, SLICE)]
            task = np.full(n, TaskContext.get().partitionId())
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(np.full(n, -1)), pa.array(task), *[pa.array(np.zeros(n, np.int64))] * 2, pa.nulls(n, pa.binary()), pa.array(slices, pa.binary())], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(sketch), SKETCHES)


def deflated(counters: np.ndarray) -> bytes:
    """Counters byte by byte, the low bytes of all first: most of them are small."""
    return bytes([counters.itemsize]) + zlib.compress(np.ascontiguousarray(counters.view(np.uint8).reshape(len(counters), -1).T).tobytes(), 1)


def inflated(data: pa.Buffer) -> np.ndarray:
    """The counters of ``deflated``."""
    width = data[0]
    planes = np.frombuffer(zlib.decompress(memoryview(data)[1:]), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(f"u{width}").ravel()


def common_bitmap(counted: DataFrame, scratch: Scratch) -> np.ndarray:
    """A bitmap of the slots with clearly more shingles than by chance, of fixed size.

    Counters are added up in groups of at most FAN_IN tasks, round by round.
    """
    small_batches(counted.sparkSession, 64, 2)
    sums = counted.select(F.col("doc_id").alias("slice"), F.col("print1").alias("part"), F.col("common").alias("n"))
    parts = (sums.agg(F.max("part")).first()[0] or 0) + 1

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros(SLICE, np.uint64)
        for n in group.column("n"):
            total += inflated(n.as_buffer())
        return pa.table({"slice": group.column("slice").slice(0, 1), "part": group.column("part").slice(0, 1), "n": pa.array([deflated(total)], pa.binary())})

    while parts > 1:
        sums = sums.withColumn("part", (F.col("part") / FAN_IN).cast("long"))
        sums = scratch.write(sums.groupBy("slice", "part").applyInArrow(add, "slice long, part long, n binary"), "shingle-counts", small=True)
        parts = -(-parts // FAN_IN)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in batch.column(0):
                n = inflated(n.as_buffer())
                yield pa.RecordBatch.from_arrays([pa.array([int(n.sum())])], ["n"])

    load = (sums.select("n").mapInArrow(summed, "n long").agg(F.sum("n")).first()[0] or 0) / SLOTS
    least = load + 6 * np.sqrt(load) + 6

    def often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = []
            for n in batch.column(1):
                n = inflated(n.as_buffer())
                bits.append(np.packbits(n >= least, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits, pa.binary())], ["slice", "bits"])

    out = np.zeros(SLOTS // 64, np.uint64)
    for row in sums.select("slice", "n").mapInArrow(often, "slice long, bits binary").collect():
        out[row.slice * SLICE // 64 : (row.slice + 1) * SLICE // 64] = np.frombuffer(bytes(row.bits), np.uint64)
    return out


def spread_often(key: np.ndarray, node: np.ndarray, own: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows (key, node) where keys with many rows are replaced by keys of ``own``, and, after
    all rows, each such key's least node stands once under the key itself."""
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    first = np.flatnonzero(np.diff(key, prepend=key[0] - 1 if len(key) else 0))
    n = np.diff(np.append(first, len(key)))
    many = first[n >= OFTEN]
    if not len(many):
        return key, node
    replaced = np.repeat(n >= OFTEN, n)
    fresh = (mix(key[replaced].view(np.uint64), own) >> np.uint64(8)).view(np.int64) | OWN
    lead_key, lead_node = key[many], node[many]
    key = key.copy()
    key[replaced] = fresh
    return np.concatenate([key, lead_key]), np.concatenate([node, lead_node])


PACKED = "bucket int, wide boolean, keys binary, nodes binary, places binary"


def pack_keys(key: np.ndarray, node: np.ndarray, head: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Rows of ``PACKED``: by bucket the quotients of keys, ``head`` as their last bit, as
    differences in order, and their nodes, by their places among the distinct ones if that
    is shorter."""
    rows = []
    quotient, bucket = (key // buckets) << 1 | head, key % buckets
    order = np.lexsort((quotient, key >= OWN, bucket))
    quotient, bucket, node, own = quotient[order], bucket[order], node[order], key[order] >= OWN
    cuts = [0, *(np.flatnonzero((np.diff(bucket) != 0) | (np.diff(own) != 0)) + 1).tolist(), len(key)]
    for i, j in zip(cuts, cuts[1:]):
        steps = np.diff(quotient[i:j], prepend=0)
        wide = bool(steps[1:].max(initial=0) >> 32)
        distinct, place = np.unique(node[i:j], return_inverse=True)
        short = 8 * len(distinct) + 2 * (j - i) < 8 * (j - i) and len(distinct) <= 1 << 16
        first = steps[:1].tobytes()
        steps = steps[1:].astype(np.int64 if wide else np.uint32).tobytes()
        rows.append((int(bucket[i]), wide, first + steps, (distinct if short else node[i:j]).tobytes(), place.astype(np.uint16).tobytes() if short else b""))
    columns = list(zip(*rows)) or [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int32(), pa.bool_(), *[pa.binary()] * 3))], ["bucket", "wide", "keys", "nodes", "places"])


def unpack_keys(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The quotients, with the heads' bit, and the nodes of rows of a bucket."""
    quotients, nodes = [], []
    for wide, keys, node, place in zip(rows.column("wide").to_pylist(), *[(x for c in rows.column(k).chunks for x in c) for k in ("keys", "nodes", "places")]):
        data, node = keys.as_buffer(), np.frombuffer(node.as_buffer(), np.int64)
        steps = np.frombuffer(data, np.int64 if wide else np.uint32, offset=8).astype(np.int64)
        quotients.append(np.cumsum(np.append(np.frombuffer(data, np.int64, 1), steps)))
        nodes.append(node[np.frombuffer(place.as_buffer(), np.uint16)] if place.as_buffer().size else node)
    return np.concatenate(quotients), np.concatenate(nodes)


def star_pairs(quotient: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs of each key's least node with the others, and whether the other is a head."""
    key = quotient >> 1
    order = np.argsort(key, kind="stable")
    key = key[order]
    met = np.flatnonzero((np.diff(key, prepend=-1) == 0) | (np.diff(key, append=-1) == 0))
    if not len(met):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    key, order = key[met], order[met]
    node, head = node[order], quotient[order] & 1 == 1
    first = np.flatnonzero(np.diff(key, prepend=-1))
    lead = np.repeat(np.minimum.reduceat(node, first), np.diff(np.append(first, len(key))))
    other = np.flatnonzero(node != lead)
    found = np.unique(np.stack([lead[other], node[other], head[other]], axis=1), axis=0)
    return found[:, 0].copy(), found[:, 1].copy(), found[:, 2] == 1


def join_keys(docs: DataFrame, common: np.ndarray, salt: int, buckets: int) -> DataFrame:
    """The packed keys of every class, once a task."""
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(common.tobytes())

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bitmap, seen, held, rows, flushes = np.frombuffer(known.value, np.uint64), set(), [], 0, 0

        def flush() -> pa.RecordBatch:
            own = (TaskContext.get().partitionId() << 20) + flushes + 1
            key, node = spread_often(np.concatenate([k for k, _ in held]), np.concatenate([x for _, x in held]), own)
            held.clear()
            return pack_keys(key, node, np.arange(len(key)) >= rows, buckets)

        for batch in batches:
            sets = shingle_sets(batch.column(0).to_pylist())
            node = class_ids(sets, salt)[3]
            fresh = []
            for i, k in enumerate(node.tolist()):
                if len(sets[i]) and k not in seen:
                    seen.add(k)
                    fresh.append(i)
            if not fresh:
                continue
            key, whose = keys([sets[i] for i in fresh], bitmap)
            held.append((key >> (58 - KEY_BITS), node[fresh][whose]))
            rows += len(key)
            if rows >= HELD:
                yield flush()
                rows, flushes = 0, flushes + 1
        if held:
            yield flush()

    return docs.select("text").mapInArrow(tidy(emit), PACKED)


def stars(packed: DataFrame) -> DataFrame:
    """The distinct pairs (a, b) of a bucket's least node and another one; ``head`` if b is
    the head of a task's star whose members have a's key too."""
    spark = packed.sparkSession

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> pa.RecordBatch:
            a, b, head = star_pairs(*unpack_keys(pa.Table.from_batches(held)))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(head)], ["a", "b", "head"])

        for batch in batches:  # a bucket's rows stand together
            bucket = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
            for i, j in zip(cuts, cuts[1:]):
                if j > i:
                    if held and held[-1].column(0)[0].as_py() != bucket[i]:
                        yield flush()
                    held.append(batch.slice(i, j - i))
        if held:
            yield flush()

    dealt = packed.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(tidy(pair), "a long, b long, head boolean").groupBy("a", "b").agg(F.max("head").alias("head"))


def whole_stars(star: DataFrame) -> DataFrame:
    """The pairs (a, b) of stars and, for each head among them, a with the members of its star."""
    pairs = star.select("a", "b")
    heads = star.where("head").select(F.col("a").alias("least"), F.col("b").alias("a"))
    return pairs.union(pairs.join(heads, "a").select("least", "b")).distinct()


def facts_of(sketched: DataFrame, pairs: DataFrame) -> DataFrame:
    """(node, size, bits) of the classes that occur in pairs."""
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    found = sketched.where("bits IS NOT NULL").select("node", F.col("n_shingles").alias("size"), "bits")
    return found.join(ends, "node", "left_semi").dropDuplicates(["node"])


def sifted(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """The pairs (a, b) that sizes and, of those left, parity bits don't exclude."""
    faced = pairs.select("a", "b").join(facts.select(F.col("node").alias("b"), F.col("size").alias("n")), "b")
    faced = faced.join(facts.select(F.col("node").alias("a"), F.col("size").alias("m")), "a")
    faced = faced.where(4 * F.least("m", "n") >= 3 * F.greatest("m", "n"))
    faced = faced.join(facts.select(F.col("node").alias("b"), F.col("bits").alias("q")), "b")
    faced = faced.join(facts.select(F.col("node").alias("a"), F.col("bits").alias("p")), "a").select("a", "b", "m", "n", "p", "q")

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m, n = (batch.column(i).to_numpy() for i in (2, 3))
            far = np.array([apart(x.as_buffer(), y.as_buffer()) for x, y in zip(batch.column(4), batch.column(5))], np.int64)
            yield batch.select([0, 1]).filter(pa.array(7 * far <= m + n))

    return faced.mapInArrow(sift, "a long, b long")


def _bitmap(ids: DataFrame, count: int) -> tuple[bytes, int]:
    """A bitmap of hashed doc_ids of at most 8 MB, by which most other documents are skipped."""
    bits = 1 << min(26, max(16, (16 * max(count, 1)).bit_length()))
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    words = ids.groupBy(F.shiftright(slot, 6).cast("int").alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, int(pmod(xxhash64(doc_id), {bits}) % 64))")).alias("v")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[words.column("w").to_numpy()] = words.column("v").to_numpy()
    return out.tobytes(), bits


def shingles_of(docs: DataFrame, sketched: DataFrame, pairs: DataFrame, salt: int) -> DataFrame:
    """(node, shingles) of the classes in pairs, made again from their texts."""
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    named = sketched.where("bits IS NOT NULL").select("node", "doc_id").join(wanted, "node", "left_semi")
    bitmap, bits = _bitmap(named, wanted.count())
    known = docs.sparkSession.sparkContext.broadcast(bitmap)

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen = np.frombuffer(known.value, np.int64), set()
        for batch in batches:
            slot = batch.column(1).to_numpy()
            hit = (words[slot >> 6] >> (slot & 63)) & 1 == 1
            part = batch.column(0).filter(pa.array(hit))
            if not len(part):
                continue
            sets = shingle_sets(part.to_pylist())
            node = class_ids(sets, salt)[3].tolist()
            fresh = [i for i, k in enumerate(node) if len(sets[i]) and k not in seen and not seen.add(k)]
            yield pa.RecordBatch.from_arrays([pa.array([node[i] for i in fresh], pa.int64()), pa.array([sets[i].tobytes() for i in fresh], pa.binary())], ["node", "shingles"])

    found = docs.select("text", F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(bits)).alias("slot")).mapInArrow(tidy(shingle), "node long, shingles binary")
    return found.join(wanted, "node", "left_semi").dropDuplicates(["node"])


def verified(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) that link, compared on their whole sets."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [links(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) for x, y in zip(batch.column(2), batch.column(3))]
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    both = pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    both = both.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
    return both.select("a", "b", "x", "y").mapInArrow(tidy(compare), "a long, b long")


def nearest_pairs(node: np.ndarray, c: np.ndarray, size: np.ndarray, bits: list[np.ndarray], member: np.ndarray, outside: np.ndarray, nearest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a block's rows ``outside``, for each component the ``nearest`` pairs with members of
    other components that may link; and whether the component had more."""
    width = np.array([len(x) for x in bits])
    stacked: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def at_width(w: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows of at least that width, folded to it, and where each row is among them."""
        if w not in stacked:
            rows = np.flatnonzero(width >= w)
            where = np.full(len(bits), -1)
            where[rows] = np.arange(len(rows))
            stacked[w] = np.array([folded(bits[r], w) for r in rows]), where
        return stacked[w]

    found: list[tuple[np.ndarray, ...]] = []
    for i in np.flatnonzero(outside):
        rows = np.flatnonzero(member & (c != c[i]) & (4 * np.minimum(size, size[i]) >= 3 * np.maximum(size, size[i])))
        for w in np.unique(np.minimum(width[rows], width[i])):
            some = rows[np.minimum(width[rows], width[i]) == w]
            sketches, where = at_width(int(w))
            far = np.bitwise_count(sketches[where[some]] ^ sketches[where[i]]).sum(axis=1, dtype=np.int64)
            both = size[some] + size[i]
            near = 7 * far <= both
            if near.any():
                some = some[near]
                found.append((np.full(len(some), c[i]), far[near] / both[near], np.minimum(node[i], node[some]), np.maximum(node[i], node[some])))
    if not found:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, bool),)
    group, far, a, b = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((b, a, far, group))
    group, a, b = group[order], a[order], b[order]
    first = np.flatnonzero(np.diff(group, prepend=group[0] - 1))
    n = np.diff(np.append(first, len(group)))
    rank = np.arange(len(group)) - np.repeat(first, n)
    return a[rank < nearest], b[rank < nearest], np.repeat(n > nearest, n)[rank < nearest]


def crossed(star: DataFrame, labels: DataFrame, facts: DataFrame, nearest: int, scratch: Scratch) -> DataFrame:
    """(a, b, more): pairs of different components in a star that may link, the nearest ones
    of each component and block; ``more`` if there are others."""
    members = star.union(star.select("a", F.col("a").alias("b")).distinct()).select(F.col("a").alias("star"), F.col("b").alias("node"))
    members = members.join(labels.withColumnRenamed("id", "node"), "node", "left").select("star", "node", F.coalesce("component_id", "node").alias("c"))
    members = scratch.write(members, "star-members", small=True)
    shape = members.groupBy("star", "c").agg(F.count("*").alias("n")).groupBy("star")
    shape = shape.agg(F.max_by("c", F.struct("n", "c")).alias("bulk"), F.sum("n").alias("rows"), F.max("n").alias("most")).where("rows > most")
    chunks = lambda n: F.ceil(n / F.lit(BLOCK)).cast("int")
    rows = lookup(members, "star", shape).withColumn("ks", chunks(F.col("rows"))).withColumn("ss", chunks(F.col("rows") - F.col("most")))
    rows = rows.withColumn("out", F.col("c") != F.col("bulk")).withColumn("k", F.pmod(F.xxhash64("node"), "ks").cast("int")).withColumn("s", F.pmod(F.xxhash64("node", F.lit(1)), "ss").cast("int"))
    meets = F.expr("concat(transform(sequence(0, ss - 1), j -> struct(k AS k, j AS s, true AS member, out AND j = s AS outside)), filter(transform(sequence(0, ks - 1), i -> struct(i AS k, s AS s, false AS member, true AS outside)), x -> out AND x.k <> k))")
    rows = rows.select("star", "node", "c", F.explode(meets).alias("m")).select(F.xxhash64("star", "m.k", "m.s").alias("block"), "m.member", "m.outside", "node", "c")
    blocks = rows.join(facts, "node").select("block", "member", "outside", "node", "c", "size", "bits")

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def pairs(rows: pa.Table) -> pa.RecordBatch:
            block, node, c, size = (rows.column(x).to_numpy() for x in ("block", "node", "c", "size"))
            member, outside = (rows.column(x).to_numpy() for x in ("member", "outside"))
            bits = [np.frombuffer(x.as_buffer(), np.uint64) for chunk in rows.column("bits").chunks for x in chunk]
            cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
            found = [nearest_pairs(node[i:j], c[i:j], size[i:j], bits[i:j], member[i:j], outside[i:j], nearest) for i, j in zip(cuts, cuts[1:])]
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], ["a", "b", "more"])

        for batch in batches:  # whole blocks at a time: a block's rows stand together
            held.append(batch)
            rows = pa.Table.from_batches(held)
            block = rows.column("block").to_numpy()
            last = int(np.flatnonzero(block != block[-1])[-1]) + 1 if (block != block[-1]).any() else 0
            if last:
                yield pairs(rows.slice(0, last))
            held = rows.slice(last).to_batches()
        if held:
            yield pairs(pa.Table.from_batches(held))

    dealt = blocks.repartition(int(star.sparkSession.conf.get("spark.sql.shuffle.partitions")), "block").sortWithinPartitions("block")
    return dealt.mapInArrow(tidy(cross), "a long, b long, more boolean").groupBy("a", "b").agg(F.max("more").alias("more"))


def _classes(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, int]:
    """The written sketches, the classes (node, first doc_id) and the salt of their ids, with
    which no two classes share an id."""
    for salt in range(8):
        sketched = scratch.write(sketch_documents(docs, salt), "sketches")
        identity = F.struct("n_shingles", "print1", "print2")
        classes = sketched.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("first"), F.min(identity).alias("x"), F.max(identity).alias("y"))
        classes = scratch.write(classes.select("node", "first", (F.col("x") == F.col("y")).alias("alone")), "classes", small=True)
        if classes.where("NOT alone").isEmpty():
            return sketched, classes.select("node", "first"), salt
        scratch.drop(sketched, classes)
    raise RuntimeError("no salt keeps the classes' ids apart")


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of (doc_id, text), as a written table."""
    scratch = Scratch(docs.sparkSession)
    sketched, classes, salt = _classes(docs, scratch)
    common = common_bitmap(sketched.where("n_shingles = -1"), scratch)

    # each member of a bucket with its least one
    shingles = sketched.where("bits IS NOT NULL").agg(F.sum("n_shingles")).first()[0] or 0
    star = scratch.write(stars(join_keys(docs, common, salt, max(8, -(-shingles // BUCKET)))), "stars", small=True)
    facts = scratch.write(facts_of(sketched, star), "star-facts", small=True)

    def linked(pairs: DataFrame) -> DataFrame:
        sets = scratch.write(shingles_of(docs, sketched, pairs, salt), "shingle-sets")
        found = scratch.write(verified(sets, pairs), "links", small=True)
        scratch.drop(sets)
        return found

    near = scratch.write(sifted(star, facts), "sifted", small=True)
    found = linked(near)
    scratch.drop(near)
    heads, star = star, scratch.write(whole_stars(star), "whole-stars", small=True)
    scratch.drop(heads)
    labels = components(found, "jaccard")

    # members of different components in the stars that hold several
    nearest = NEAREST
    while True:
        pairs = scratch.write(crossed(star, labels, facts, nearest, scratch), "crossed", small=True)
        if pairs.isEmpty():
            break
        more = not pairs.where("more").isEmpty()
        fresh = linked(pairs.select("a", "b"))
        scratch.drop(pairs)
        if not fresh.isEmpty():
            found = scratch.write(found.union(fresh), "links", small=True)
            labels = components(found, "jaccard")
        if not more:
            break
        nearest *= 16
    scratch.drop(star, facts)

    labelled = classes.join(labels.withColumnRenamed("id", "node"), "node", "left").select("node", "first", F.coalesce("component_id", "node").alias("c"))
    heads = labelled.groupBy("c").agg(F.min("first").alias("component_id"))
    named = scratch.write(labelled.join(heads, "c").select("node", "component_id"), "named", small=True)
    some = sketched.where("n_shingles > 0").select("doc_id", "n_shingles", "node").join(named, "node").select("doc_id", "n_shingles", "component_id")
    none = sketched.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    result = scratch.write(some.union(none), "jaccard-components")
    scratch.close(result)
    return result


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
