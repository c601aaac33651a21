"""Operator 6: a hashed maximum-entropy language model.

Tokens are the words between ASCII white space, A-Z in lower case, and one end a document.
The ``COMMON - 1`` commonest words and the end are ids; as history every other word is one
of ``HASHED`` ids by its hash. Ids are dealt by frequency to classes of equal shares of the
tokens, and all other words are the last class. The probability of a token is that of its
class times that of the word in its class, both maximum-entropy models:

* the class is a softmax of the classes' logarithmic shares plus the weights of the
  previous word's feature and, skipping one, of the word before it, each scaled by a factor
  for how often the feature occurs;
* the word in its class is a softmax of the words' logarithmic shares plus a weight for the
  pair of previous word and word. Pairs without a weight add nothing, so the normaliser of
  a context needs its weighted pairs only. In the last class a word has its share
  (c + 0.1) / (N + 0.1 (V + 1)) of the class, one share of 0.1 standing for all unseen words.

*Training.* A hash deals one training document in ``FOLDS`` to the scales. The tokens of all
others are counted in their pair and skip features. Counts meet by history, where
regularised gradient (Newton) steps give the weights of all pairs and classes of
that history at once; the penalty acts as a discount of seen pairs. The scales are then
trained on the documents that the weights haven't seen by synchronous gradient rounds: tasks
return sums of gradients and curvatures, the driver takes the step. What is gathered grows
with the corpus. Every pair has a weight. All workers hold the normalisers and the weights of
the commonest pairs, at most ``PAIRS``; those of rarer pairs stay a written table, packed by
bucket of histories. Documents ask for theirs in packed lists, one for every bucket and chunk of
documents, and get back a sum for each document that asked.
Results don't depend on the partitioning, but for the rounding of sums.

*Counts* of all training words are a written table. A document's words outside the
vocabulary meet their counts in a join.

Defined cases: a null text is empty and has its end alone; without training documents all
counts are 0 and classes and words have equal shares; rows with the same doc_id are separate
documents; texts of any length are scored whole; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import pickle
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from itertools import chain, islice, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.labelled import remainder
from quarry.session import Scratch, materialize, release_heaps, small_batches, tidy

CLASSES = 32  # the last one for words outside the vocabulary
COMMON = 131_072
HASHED = 8_192
HISTORIES, TARGETS = COMMON + HASHED, COMMON + 1
END = 0  # the id of the end
#: Pairs whose weights every worker holds, at most: 12 bytes each. Others are asked for.
PAIRS = 1 << 21
#: Penalties of the weights of pairs, of their squares, and of the squares of classes' weights.
PAIR_DISCOUNT, PAIR_PENALTY, CLASS_PENALTY = 0.3, 0.04, 0.3
#: Of so many training documents one trains the scales and the others the weights.
FOLDS = 16
SCALES, ROUNDS = 8, 3
BATCH, HELD = 16_384, 1_500_000
#: Megabytes of a batch of texts or tokens, which a worker's arrays take many times, and words of one of counts.
MEGABYTES, WORDS = 1, 65_536
#: Codes of whole histories that are solved at once, about; a history has at most TARGETS.
SOLVE = 1 << 17


def tokenize(texts: list[str | None]) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of all texts as codes of a dictionary, and the bounds of each text's words."""
    lowered = pa.array([(text or "").encode().lower() for text in texts], pa.binary()).cast(pa.string())
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(lowered))
    flat, offsets = lists.flatten(), lists.offsets.to_numpy()
    filled = pc.not_equal(flat, "")
    if not pc.all(filled).as_py():  # empty texts give one empty word
        kept = filled.to_numpy(zero_copy_only=False)
        offsets = np.append(0, np.cumsum(kept))[offsets]
        flat = flat.filter(filled)
    return flat.dictionary_encode(), offsets


class Vocabulary:
    """The commonest words with their counts, classes and shares, and totals of all others."""

    def __init__(self, words: list[str], counts: list[int], ends: int, total: int, distinct: int):
        self.ids = {w: i + 1 for i, w in enumerate(words)}
        self.counts = np.zeros(COMMON)
        self.counts[: len(words) + 1] = [ends, *counts]
        self.total, self.distinct = total, distinct
        self.rest_n = total - self.counts.sum()
        self.rest_v = max(distinct - (len(words) + (ends > 0)), 0)
        middle = np.cumsum(self.counts) - self.counts / 2
        classes = np.minimum(middle / max(self.counts.sum(), 1) * (CLASSES - 1), CLASSES - 2).astype(np.int64)
        self.classes = np.append(classes, CLASSES - 1)  # by target
        used = len(words) + 1  # ids beyond have no word
        weight = np.where(np.arange(COMMON) < used, self.counts + 1e-3, 0)
        mass = np.bincount(classes, weight, CLASSES - 1)
        self.share = np.full(TARGETS, -50.0)  # of a word in its class
        self.share[:used] = np.log(weight[:used] / mass[classes[:used]])
        self.share[COMMON] = 0.0
        self.class_share = np.log(np.append(mass, self.rest_n) + 0.5) - np.log((np.append(mass, self.rest_n) + 0.5).sum())

    def lookup(self, words: list[str]) -> np.ndarray:
        """Ids of words; others by their hash from COMMON on."""
        out = np.fromiter(map(self.ids.get, words, repeat(-1)), np.int64, len(words))
        other = np.flatnonzero(out < 0)
        hashes = map(zlib.crc32, map(str.encode, map(words.__getitem__, other.tolist())))
        out[other] = COMMON + np.fromiter(hashes, np.int64, len(other)) % HASHED
        return out

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.1) / (self.total + 0.1 * (self.distinct + 1)))


def sequence(ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of all texts, each text's end after its words, and the bounds of each."""
    n = len(bounds) - 1
    out = np.full(len(ids) + n, END, np.int64)
    out[np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(bounds))] = ids
    return out, bounds + np.arange(n + 1)


def history(tokens: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The previous token and the one before it; the end stands before a text's first."""
    one = np.concatenate([[END], tokens[:-1]])
    two = np.concatenate([[END], one[:-1]])
    two[bounds[:-1]] = END
    return one, two


def counted(codes: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order and the sum of their counts."""
    order = np.argsort(codes, kind="stable") if n is not None else None
    codes = np.sort(codes) if order is None else codes[order]
    first = np.flatnonzero(np.diff(codes, prepend=-1))
    if n is None:
        return codes[first], np.diff(np.append(first, len(codes)))
    return codes[first], np.add.reduceat(n[order], first) if len(codes) else n


def class_weights(n: np.ndarray, class_share: np.ndarray, rounds: int = 12) -> np.ndarray:
    """Weights of each class in each row of counts ``n``, a history each."""
    w = np.zeros(n.shape)
    total = n.sum(axis=1, keepdims=True)
    for _ in range(rounds):
        z = w + class_share
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        w += np.clip((n - total * p - CLASS_PENALTY * w) / (total * p + CLASS_PENALTY), -2, 2)
    return w


def pair_weights(group: np.ndarray, n: np.ndarray, total: np.ndarray, share: np.ndarray, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Weights of pairs and the logarithmic normaliser of each pair's context.

    Pairs of a context, a history and a class, stand together and share a number in
    ``group``; ``total`` is how often the context occurs and ``share`` the word's share of
    its class without the pair.
    """
    if not len(n):
        return np.zeros(0), np.zeros(0)
    first = np.flatnonzero(np.diff(group, prepend=-1))
    size = np.diff(np.append(first, len(group)))
    summed = lambda x: np.repeat(np.add.reduceat(x, first), size)
    w, rest = np.zeros(len(n)), np.maximum(1 - summed(share), 1e-9)
    for _ in range(rounds):
        p = share * np.exp(w)
        p /= rest + summed(p)
        w += np.clip((n - total * p - PAIR_DISCOUNT - PAIR_PENALTY * w) / (total * p + PAIR_PENALTY), -2, 2)
        w = np.clip(w, 0, 15)
    w = w.astype(np.float16).astype(np.float64)  # as it is stored, so that the normaliser is its own
    return w, np.log(rest + summed(share * np.exp(w)))


_unpacked: dict[str, Model] = {}
#: The arrays of a model and how they are packed; codes as differences.
_ARRAYS = {"previous": np.float16, "skipped": np.float16, "often": np.uint8, "normaliser": np.float32, "codes": np.int64, "weights": np.float16}


@dataclass
class Model:
    """Class weights by previous word and by skipped word, pairs with their weights, normalisers
    by context, and scales by how often a feature occurs."""

    vocabulary: Vocabulary
    previous: np.ndarray = field(default_factory=lambda: np.zeros((HISTORIES, CLASSES), np.float32))
    skipped: np.ndarray = field(default_factory=lambda: np.zeros((HISTORIES, CLASSES), np.float32))
    often: np.ndarray = field(default_factory=lambda: np.zeros((2, HISTORIES), np.uint8))
    normaliser: np.ndarray = field(default_factory=lambda: np.zeros((HISTORIES, CLASSES), np.float32))
    codes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    scales: np.ndarray = field(default_factory=lambda: np.repeat([0.7, 0.6], SCALES))
    rare: DataFrame | None = None  # packed (bucket, ids, weights) of the pairs that aren't in codes
    buckets: int = 1  # of histories, by which the rare pairs are dealt
    written: DataFrame | None = None  # the table that rare reads
    name: str = ""  # under which workers hold it

    def packed(self) -> list[bytes]:
        """The model for the workers, packed array by array so that few bytes are held twice;
        weights of classes and pairs are 16-bit numbers already."""
        rest = replace(self, rare=None, written=None, **dict.fromkeys(_ARRAYS))
        parts = (np.diff(x, prepend=0) if x.dtype == np.int64 else x.astype(_ARRAYS[k]) for k in _ARRAYS for x in [getattr(self, k)])
        return [zlib.compress(pickle.dumps(x), 1) for x in chain([rest], parts)]

    @classmethod
    def unpacked(cls, name: str, shared: Broadcast, scales: np.ndarray | None = None) -> Model:
        """The model of ``packed``, ``scaled`` if scales are given, under a name of its own; a worker
        unpacks one model once, and holds it without the packed bytes."""
        key = name if scales is None else f"{name} scaled"
        if key not in _unpacked:
            _unpacked.clear()
            parts = shared.value[::-1]
            if getattr(shared, "_path", None):  # a worker, which could read the value again
                shared.__dict__.pop("_value", None)
            model = pickle.loads(zlib.decompress(parts.pop()))
            for k in _ARRAYS:
                x = pickle.loads(zlib.decompress(parts.pop()))
                setattr(model, k, np.cumsum(x) if x.dtype == np.int64 else x.astype(np.float32) if x.dtype == np.float16 else x)
            _unpacked[key] = model if scales is None else replace(model, scales=scales).scaled()
        return _unpacked[key]

    def class_probabilities(self, one: np.ndarray, two: np.ndarray):
        """Weights of both features, their scales' places, and the probability of each class."""
        a, b = self.previous[one], self.skipped[two]
        i, j = self.often[0][one].astype(np.int64), SCALES + self.often[1][two].astype(np.int64)
        z = a * self.scales[i].astype(np.float32)[:, None]
        z += b * self.scales[j].astype(np.float32)[:, None]
        z += self.vocabulary.class_share.astype(np.float32)
        z -= z.max(axis=1, keepdims=True)
        np.exp(z, out=z)
        z /= z.sum(axis=1, keepdims=True)
        return a, b, i, j, z

    def pair_terms(self, one: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The weight of each token's pair, and whether that is held."""
        if not len(self.codes):
            return np.zeros(len(one)), np.zeros(len(one), bool)
        codes, back = np.unique(one * TARGETS + target, return_inverse=True)
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        held = self.codes[at] == codes
        return np.where(held, self.weights[at], 0.0)[back], held[back]

    def scaled(self) -> Model:
        """The model with scales and classes' shares in its weights of classes, in place."""
        for weights, often, scales in ((self.previous, self.often[0], self.scales[:SCALES]), (self.skipped, self.often[1], self.scales[SCALES:])):
            weights *= scales.astype(np.float32)[often][:, None]
        self.previous += self.vocabulary.class_share.astype(np.float32)
        return self

    def log10(self, tokens: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """log10 probability of each token's class, and of vocabulary words in their class."""
        return replace(self, previous=self.previous.copy(), skipped=self.skipped.copy()).scaled().log10_held(tokens, one, two)[0]

    def log10_held(self, tokens: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``log10`` by a ``scaled`` model, and which vocabulary words' pairs aren't held."""
        out = np.empty(len(tokens))
        target = np.minimum(tokens, COMMON)
        classes = self.vocabulary.classes[target]
        for at in range(0, len(tokens), BATCH):
            part = slice(at, at + BATCH)
            z = self.previous[one[part]]
            z += self.skipped[two[part]]
            z -= z.max(axis=1, keepdims=True)
            own = z[np.arange(len(z)), classes[part]].astype(np.float64)
            np.exp(z, out=z)
            out[part] = own - np.log(np.einsum("ij->i", z)).astype(np.float64)
        known = np.flatnonzero(tokens < COMMON)
        weights, held = self.pair_terms(one[known], target[known])
        out[known] += self.vocabulary.share[target[known]] + weights - self.normaliser[one[known], classes[known]]
        return out / np.log(10), known[~held]

    def gradients(self, tokens: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """The gradient by scale and below it the curvature, summed over tokens."""
        n = 2 * SCALES
        out = np.zeros((n + 1, n))
        classes = self.vocabulary.classes[np.minimum(tokens, COMMON)]
        for at in range(0, len(tokens), BATCH):
            part = slice(at, at + BATCH)
            a, b, i, j, p = self.class_probabilities(one[part], two[part])
            row, c = np.arange(len(p)), classes[part]
            mean_a, mean_b = np.einsum("ij,ij->i", a, p), np.einsum("ij,ij->i", b, p)
            weighed = a * p
            aa, ab, bb = np.einsum("ij,ij->i", weighed, a), np.einsum("ij,ij->i", weighed, b), np.einsum("ij,ij->i", b * p, b)
            out[0] += np.bincount(i, a[row, c] - mean_a, n) + np.bincount(j, b[row, c] - mean_b, n)
            flat = np.bincount(i * n + i, aa - mean_a**2, n * n) + np.bincount(j * n + j, bb - mean_b**2, n * n)
            cross = np.bincount(i * n + j, ab - mean_a * mean_b, n * n).reshape(n, n)
            out[1:] += flat.reshape(n, n) + cross + cross.T
        return out


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) over all whole texts, as a written table."""
    small_batches(docs.sparkSession, 2000, MEGABYTES)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def flush() -> Iterator[pa.RecordBatch]:
            rows = iter(found.items())
            while part := list(islice(rows, WORDS)):
                words, n = zip(*part)
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(n, pa.int64())], ["word", "n"])
            found.clear()

        for batch in batches:
            counts = tokenize(batch.column(0).to_pylist())[0].value_counts()
            words = counts.field(0)
            words = words.dictionary_decode() if isinstance(words, pa.DictionaryArray) else words
            for word, n in zip(words.to_numpy(zero_copy_only=False).tolist(), counts.field(1).to_pylist()):
                found[word] += n
            if len(found) > 700_000:
                yield from flush()
        yield from flush()

    parts = docs.select("text").mapInArrow(tidy(count), "word string, n long")
    return materialize(parts.groupBy("word").agg(F.sum("n").alias("n")), "word-counts")


def learn_vocabulary(counts: DataFrame, ends: int) -> Vocabulary:
    facts = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    top = counts.orderBy(F.desc("n"), "word").limit(COMMON - 1).toArrow()
    words, n = top.column("word").to_pylist(), top.column("n").to_pylist()
    return Vocabulary(words, n, ends, facts.n + ends, facts.v + (ends > 0))


REST = pa.struct([("word", pa.string()), ("n", pa.int32())])
TOKENS = "kind int, bucket int, row_id long, doc_id long, held_out boolean, codes binary, counts binary, rest array<struct<word:string,n:int>>"
NAMES = ["kind", "bucket", "row_id", "doc_id", "held_out", "codes", "counts", "rest"]
DOCUMENT, PAIR, SKIP = 0, 1, 2
#: What a document trains: nothing, the weights or the scales.
HELD_OUT, WEIGHTS, SCALING = 0, 1, 2


def pack(x: np.ndarray) -> bytes:
    """Whole numbers, best in order, as deflated differences."""
    return zlib.compress(np.diff(x.astype(np.int64), prepend=0).tobytes(), 1)


def unpack(data) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(data), np.int64))


def split_by_history(codes: np.ndarray, width: int, buckets: int) -> list[tuple[int, np.ndarray]]:
    """Which of the codes of a history are in each bucket, in order."""
    bucket = (codes // width * 0x9E3779B1 >> 8) % buckets
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    return [(k, order[i:j]) for k, (i, j) in enumerate(zip(cuts, cuts[1:])) if j > i]


def encode_documents(docs: DataFrame, vocabulary: Vocabulary, buckets: int) -> DataFrame:
    """A row of token ids for every document of (doc_id, text, held_out), with what it trains as
    ``bucket`` and its words outside the vocabulary; and rows of the counts of pairs and skips
    by history, of the documents that train weights."""
    spark = docs.sparkSession
    small_batches(spark, 2000, MEGABYTES)
    known = spark.sparkContext.broadcast(vocabulary)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        v, held, n_held, row = known.value, ([], []), 0, TaskContext.get().partitionId() << 33

        def flush() -> pa.RecordBatch:
            rows = []
            for kind, width, parts in ((PAIR, TARGETS, held[0]), (SKIP, CLASSES, held[1])):
                joined = np.concatenate(parts)
                parts.clear()
                codes, n = counted(joined)
                for bucket, at in split_by_history(codes, width, buckets):
                    rows.append((kind, bucket, zlib.compress(np.diff(codes[at], prepend=0).tobytes(), 1), zlib.compress(n[at].astype(np.int32).tobytes(), 1)))
            kinds, places, codes, counts = zip(*rows)
            n = len(rows)
            return pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(places, pa.int32()), *[pa.nulls(n, pa.int64())] * 2, pa.nulls(n, pa.bool_()), pa.array(codes, pa.binary()), pa.array(counts, pa.binary()), pa.nulls(n, pa.list_(REST))], NAMES)

        for batch in batches:
            coded, bounds = tokenize(batch.column(2).to_pylist())
            words, index = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
            by_word = v.lookup(words.to_pylist())
            ids = by_word[index] if len(index) else np.zeros(0, np.int64)
            tokens, ends = sequence(ids, bounds)
            n = batch.num_rows
            role = batch.column(3).to_numpy(zero_copy_only=False)
            training = role == WEIGHTS
            at = np.flatnonzero(np.repeat(training, np.diff(ends)))
            if len(at):
                one, two = history(tokens, ends)
                target = np.minimum(tokens[at], COMMON)
                held[0].append(one[at] * TARGETS + target)
                held[1].append(two[at] * CLASSES + v.classes[target])
                n_held += len(at)
            # words to look up: by text and word, with how often
            place = np.flatnonzero(ids >= COMMON)
            owner = np.searchsorted(bounds, place, "right") - 1
            pair, times = np.unique(owner * max(len(words), 1) + index[place], return_counts=True)
            owner, code = pair // max(len(words), 1), pair % max(len(words), 1)
            rest = pa.StructArray.from_arrays([words.take(pa.array(code)).cast(pa.string()), pa.array(times.astype(np.int32))], fields=list(REST))
            offsets = np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)
            data, cuts = tokens.astype(np.uint32).tobytes(), (4 * ends).tolist()
            codes = pa.array([data[i:j] for i, j in zip(cuts, cuts[1:])], pa.binary())
            zero, rows = pa.array(np.zeros(n, np.int32)), pa.array(row + np.arange(n))
            role = pa.array(role.astype(np.int32))
            row += n
            yield pa.RecordBatch.from_arrays([zero, role, rows, batch.column(0), batch.column(1), codes, pa.nulls(n, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), rest)], NAMES)
            if n_held > HELD:
                yield flush()
                n_held = 0
        if n_held:
            yield flush()

    scaling = F.pmod(F.xxhash64(F.lit(6), F.col("doc_id").cast("long"), "text"), F.lit(FOLDS)) == 0
    role = F.when(F.col("held_out"), HELD_OUT).when(scaling, SCALING).otherwise(WEIGHTS)
    return docs.select(F.col("doc_id").cast("long"), "held_out", "text", role.alias("role")).mapInArrow(tidy(encode), TOKENS)


MERGED = "kind int, bucket int, codes binary, counts binary, single long, sizes array<long>"
LOG_COUNTS = 40


def merge(group: pa.Table) -> pa.Table:
    """All counts of a bucket's codes of a kind, and how many pairs have each count (by logarithm beyond 8)."""
    codes = np.concatenate([np.cumsum(np.frombuffer(zlib.decompress(x.as_buffer()), np.int64)) for x in group.column("codes")])
    n = np.concatenate([np.frombuffer(zlib.decompress(x.as_buffer()), np.int32) for x in group.column("counts")]).astype(np.int64)
    codes, n = counted(codes, n)
    sizes = np.bincount(count_level(n), minlength=LOG_COUNTS)
    return pa.table(
        {
            "kind": group.column("kind").slice(0, 1),
            "bucket": group.column("bucket").slice(0, 1),
            "codes": pa.array([np.diff(codes, prepend=0).tobytes()], pa.binary()),
            "counts": pa.array([n.tobytes()], pa.binary()),
            "single": pa.array([int((n == 1).sum())]),
            "sizes": pa.array([sizes.tolist()], pa.list_(pa.int64())),
        }
    )


def count_level(n: np.ndarray) -> np.ndarray:
    return np.where(n <= 8, n, 6 + np.floor(np.log2(np.maximum(n, 1)))).astype(np.int64)


def least_level(sizes: np.ndarray, most: int) -> int:
    """The least level of counts such that at most ``most`` pairs are at it or above."""
    above = np.cumsum(sizes[::-1])[::-1]
    return int(np.flatnonzero(np.append(above, 0) <= most)[0])


SOLVED = "bucket int, kind int, ids binary, weights binary, often binary, contexts binary, normalisers binary"


def solve(vocabulary: Vocabulary, level: int, kind: int, codes: np.ndarray, n: np.ndarray) -> dict[str, bytes]:
    """The weights of some of a bucket's histories: of classes, of pairs from a level of counts on, and
    of rarer pairs, kind -1."""
    width = TARGETS if kind == PAIR else CLASSES
    h, y = codes // width, codes % width
    c = vocabulary.classes[y] if kind == PAIR else y
    ids, row = np.unique(h, return_inverse=True)
    table = np.bincount(row * CLASSES + c, n, len(ids) * CLASSES).reshape(-1, CLASSES)
    often = np.minimum(np.log2(np.maximum(table.sum(axis=1), 1)) / 2, SCALES - 1).astype(np.uint8)
    out = {"ids": ids.astype(np.int32), "weights": class_weights(table, vocabulary.class_share).astype(np.float16), "often": often, "contexts": np.zeros(0, np.int64), "normalisers": np.zeros(0, np.float32)}
    found = {"kind": kind, **{k: x.tobytes() for k, x in out.items()}}
    pairs, rare = ({"kind": k, **dict.fromkeys(out, b"")} for k in (0, -1))
    if kind == PAIR:
        some = np.flatnonzero(y < COMMON)
        context = h[some] * CLASSES + c[some]
        order = np.argsort(context, kind="stable")
        some, context = some[order], context[order]
        w, z = pair_weights(context, n[some].astype(float), table[row[some], c[some]], np.exp(vocabulary.share[y[some]]))
        first = np.flatnonzero(np.diff(context, prepend=-1))
        held, w = count_level(n[some]) >= level, w.astype(np.float16)
        arrays = {"ids": codes[some][held], "weights": w[held], "contexts": context[first], "normalisers": z[first].astype(np.float32)}
        pairs |= {k: x.tobytes() for k, x in arrays.items()}
        rarer = np.sort(some[~held])  # codes are in order
        if len(rarer):
            order = np.empty(len(codes), np.int64)
            order[some] = np.arange(len(some))
            rare |= {"ids": pack(codes[rarer]), "weights": zlib.compress(w[order[rarer]].tobytes(), 1)}
    return {k: [found[k], pairs[k], *([rare[k]] if rare["ids"] else [])] for k in found}


def slices(codes: np.ndarray, width: int) -> list[tuple[int, int]]:
    """Cuts of codes in order about every ``SOLVE``, between histories."""
    first = np.flatnonzero(np.diff(codes // width, prepend=-1))
    cuts = first[np.diff(first // SOLVE, prepend=-1) > 0].tolist()
    return list(zip(cuts, [*cuts[1:], len(codes)]))


def train(coded: DataFrame, vocabulary: Vocabulary, buckets: int, scratch: Scratch, most: int = PAIRS) -> tuple[Model, Broadcast]:
    """The model of the training documents in a written table of ``encode_documents``, and all of
    it but the final scales for the workers."""
    spark = coded.sparkSession
    parts = coded.where("kind > 0").select("kind", "bucket", "codes", "counts").repartition(2 * buckets, "kind", "bucket")
    release_heaps(spark)
    merged = scratch.write(parts.groupBy("kind", "bucket").applyInArrow(merge, MERGED), "pair-counts")
    sizes = merged.where(F.col("kind") == PAIR).select(F.posexplode("sizes").alias("level", "n")).groupBy("level").agg(F.sum("n").alias("n")).collect()
    histogram = np.zeros(LOG_COUNTS, np.int64)
    for row in sizes:
        histogram[row.level] = row.n
    level = max(least_level(histogram, most), 1)
    known = spark.sparkContext.broadcast(vocabulary)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, kind, codes, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                codes, n = np.cumsum(np.frombuffer(codes.as_buffer(), np.int64)), np.frombuffer(n.as_buffer(), np.int64)
                for i, j in slices(codes, TARGETS if kind == PAIR else CLASSES):
                    found = solve(known.value, level, kind, codes[i:j], n[i:j])
                    buckets = pa.array([bucket] * len(found["kind"]), pa.int32())
                    yield pa.RecordBatch.from_arrays([buckets, pa.array(found["kind"], pa.int32()), *[pa.array(found[k], pa.binary()) for k in ("ids", "weights", "often", "contexts", "normalisers")]], ["bucket", "kind", "ids", "weights", "often", "contexts", "normalisers"])

    small_batches(spark, 1, 4)  # a bucket at a time
    release_heaps(spark)
    model = Model(vocabulary, buckets=buckets)
    written = scratch.write(merged.select("bucket", "kind", "codes", "counts").mapInArrow(tidy(weigh), SOLVED), "weights")
    solved = written.where("kind >= 0").toArrow()
    codes, weights = [], []
    for kind, *arrays in zip(*[solved.column(k) for k in ("kind", "ids", "weights", "often", "contexts", "normalisers")]):
        ids, w, often, contexts, normalisers = (np.frombuffer(x.as_buffer(), t) for x, t in zip(arrays, (np.int32 if kind.as_py() else np.int64, np.float16, np.uint8, np.int64, np.float32)))
        if kind.as_py():
            place = kind.as_py() - 1
            (model.previous, model.skipped)[place][ids] = w.reshape(-1, CLASSES)
            model.often[place][ids] = often
        else:
            codes.append(ids)
            weights.append(w.astype(np.float32))
            model.normaliser.reshape(-1)[contexts] = normalisers
    if codes:
        order = np.argsort(np.concatenate(codes))
        model.codes, model.weights = np.concatenate(codes)[order], np.concatenate(weights)[order]
    small_batches(spark, 2000, MEGABYTES)
    texts = coded.where((F.col("kind") == DOCUMENT) & (F.col("bucket") == SCALING)).select("codes")
    solved = codes = weights = ids = w = often = contexts = normalisers = arrays = None  # all read from solved
    scratch.drop(merged)
    if histogram[1:level].sum():
        model.rare, model.written = written.where("kind = -1").select("bucket", "ids", "weights"), written
    else:
        scratch.drop(written)
    model.name = uuid.uuid4().hex
    release_heaps(spark)
    shared = spark.sparkContext.broadcast(model.packed())
    for _ in range(ROUNDS):
        model.scales = stepped(model.name, shared, model.scales, texts)
    return model, shared


def documents_of(codes: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and bounds of a batch's documents."""
    tokens = [np.frombuffer(x.as_buffer(), np.uint32) for x in codes]
    return np.concatenate(tokens).astype(np.int64), np.cumsum([0, *map(len, tokens)])


def stepped(name: str, shared: Broadcast, scales: np.ndarray, texts: DataFrame) -> np.ndarray:
    """The scales after one synchronous step on the tokens of the texts."""

    def gradients(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2 * SCALES + 1, 2 * SCALES))
        for batch in batches:
            if batch.num_rows:
                tokens, bounds = documents_of(batch.column(0))
                total += replace(Model.unpacked(name, shared), scales=scales).gradients(tokens, *history(tokens, bounds))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], ["place", "value"])

    sums = texts.mapInArrow(tidy(gradients), "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).collect()
    total = np.zeros((2 * SCALES + 1) * 2 * SCALES)
    for row in sums:
        total[row.place] = row.value
    total = total.reshape(2 * SCALES + 1, 2 * SCALES)
    step = np.linalg.solve(total[1:] + np.eye(2 * SCALES), total[0])
    return np.clip(scales + np.clip(step, -1, 1), 0.0, 2.0)


SCORED = "row_id long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, model double, chunk long, bucket int, codes binary, owners binary"
GAINED = "chunk long, owners binary, gains binary"


def rare_weights(asked: pa.Table, rare: pa.Table) -> pa.Table:
    """For each list of a bucket's rarer pairs and the rows that they are in, the sum of their
    weights by row; ``rare`` has the weights of the bucket."""
    out = ([], [], [])
    if rare.num_rows:
        codes = np.concatenate([unpack(x.as_buffer()) for x in rare.column("ids")])
        weights = np.concatenate([np.frombuffer(zlib.decompress(x.as_buffer()), np.float16) for x in rare.column("weights")])
        order = np.argsort(codes, kind="stable")  # of slices, which come in any order
        codes, weights = codes[order], weights[order]
        for chunk, wanted, owners in zip(asked.column("chunk").to_pylist(), asked.column("codes"), asked.column("owners")):
            wanted = unpack(wanted.as_buffer())
            at = np.minimum(np.searchsorted(codes, wanted), len(codes) - 1)
            met = codes[at] == wanted
            if met.any():
                rows, place = np.unique(np.frombuffer(zlib.decompress(owners.as_buffer()), np.int64)[met], return_inverse=True)
                sums = np.bincount(place, weights[at[met]].astype(np.float64))
                for part, x in zip(out, (chunk, pack(rows), zlib.compress(sums.tobytes(), 1))):
                    part.append(x)
    return pa.table({"chunk": pa.array(out[0], pa.int64()), "owners": pa.array(out[1], pa.binary()), "gains": pa.array(out[2], pa.binary())})


def gather(group: pa.Table) -> pa.Table:
    """(row_id, gained) of a chunk of documents, over all buckets."""
    rows, place = np.unique(np.concatenate([unpack(x.as_buffer()) for x in group.column("owners")]), return_inverse=True)
    gains = np.concatenate([np.frombuffer(zlib.decompress(x.as_buffer()), np.float64) for x in group.column("gains")])
    return pa.table({"row_id": rows, "gained": np.bincount(place, gains)})


def score_documents(coded: DataFrame, counts: DataFrame, model: Model, shared: Broadcast, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of the documents in a
    written table of ``encode_documents``."""
    v, scales, asking, buckets, name = model.vocabulary, model.scales, model.rare is not None, model.buckets, model.name

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk, n_asked, asked = TaskContext.get().partitionId() << 32, 0, ([], [])

        def flush() -> pa.RecordBatch:
            codes, owners = (np.concatenate(x) for x in asked)
            order = np.argsort(codes, kind="stable")
            codes, owners = codes[order], owners[order]
            rows = [(bucket, pack(codes[at]), zlib.compress(owners[at].tobytes(), 1)) for bucket, at in split_by_history(codes, TARGETS, buckets)]
            for part in asked:
                part.clear()
            n, (places, codes, owners) = len(rows), zip(*rows)
            columns = [pa.nulls(n, f.type) for f in fields[:7]]
            return pa.RecordBatch.from_arrays([*columns, pa.array([chunk] * n, pa.int64()), pa.array(places, pa.int32()), pa.array(codes, pa.binary()), pa.array(owners, pa.binary())], schema=pa.schema(fields))

        numbers, real = pa.int64(), pa.float64()
        types = (numbers, numbers, pa.bool_(), numbers, numbers, real, real, numbers, pa.int32(), pa.binary(), pa.binary())
        fields = [pa.field(column, t) for column, t in zip(("row_id", "doc_id", "held_out", "n_tokens", "n_known", "base", "model", "chunk", "bucket", "codes", "owners"), types)]
        for batch in batches:
            if not batch.num_rows:
                continue
            m = Model.unpacked(name, shared, scales)
            tokens, ends = documents_of(batch.column(3))
            c = np.append(m.vocabulary.counts, 0)[np.minimum(tokens, COMMON)]
            common = tokens < COMMON
            total = lambda x: np.add.reduceat(x, ends[:-1])  # noqa: E731, B023
            one, two = history(tokens, ends)
            probabilities, at = m.log10_held(tokens, one, two)
            if asking:
                asked[0].append(one[at] * TARGETS + tokens[at])
                asked[1].append(np.repeat(batch.column(0).to_numpy(), np.diff(ends))[at])
                n_asked += len(at)
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:3],
                    pa.array(np.diff(ends)),
                    pa.array(total((common & (c > 0)).astype(np.int64))),
                    pa.array(total(np.where(common, m.vocabulary.base(c), 0.0))),
                    pa.array(total(probabilities)),
                    *[pa.nulls(batch.num_rows, t) for t in types[7:]],
                ],
                schema=pa.schema(fields),
            )
            if n_asked > HELD:
                yield flush()
                n_asked, chunk = 0, chunk + 1
        if n_asked:
            yield flush()

    release_heaps(coded.sparkSession)
    numbered = coded.where("kind = 0")
    found = numbered.select("row_id", "doc_id", "held_out", "codes").mapInArrow(tidy(score), SCORED)
    of_documents = ["row_id", "doc_id", "held_out", "n_tokens", "n_known", "base", "model"]
    scored = found.select(of_documents)
    if asking:
        scratch = scratch or Scratch(coded.sparkSession)
        found = scratch.write(found, "maxent-asked")
        release_heaps(coded.sparkSession)
        asked = found.where("bucket IS NOT NULL").select("bucket", "chunk", "codes", "owners").repartition(buckets, "bucket")
        answers = asked.groupBy("bucket").cogroup(model.rare.repartition(buckets, "bucket").groupBy("bucket")).applyInArrow(rare_weights, GAINED)
        gained = answers.groupBy("chunk").applyInArrow(gather, "row_id long, gained double")
        scored = found.where("bucket IS NULL").select(of_documents).join(gained, "row_id", "left")
        scored = scored.withColumn("model", F.col("model") + F.coalesce("gained", F.lit(0.0)) / float(np.log(10))).select(of_documents)
        scored = scratch.write(scored, "maxent-scored")
        scratch.drop(found, model.written)
    rest = numbered.select("row_id", F.explode("rest").alias("r")).select("row_id", "r.word", F.col("r.n").alias("times"))
    met = rest.join(counts.select("word", F.col("n").alias("c")), "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    more = met.groupBy("row_id").agg(
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("more_known"),
        F.sum(F.col("times") * F.log10((F.col("c") + 0.1) / F.lit(float(v.total + 0.1 * (v.distinct + 1))))).alias("more_base"),
        F.sum(F.col("times") * F.log10((F.col("c") + 0.1) / F.lit(float(v.rest_n + 0.1 * (v.rest_v + 1))))).alias("more_model"),
    )
    return scored.join(more, "row_id", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(int(v.total)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        (F.col("model") + F.coalesce("more_model", F.lit(0.0))).alias("score"),
    )


def score_corpus(docs: DataFrame, most: int = PAIRS) -> DataFrame:
    """Trains on the rows of (doc_id, text, held_out) that aren't held out and scores all."""
    scratch = Scratch(docs.sparkSession)
    training = docs.where(~F.col("held_out"))
    counts = count_words(training)
    vocabulary = learn_vocabulary(counts, training.count())
    release_heaps(docs.sparkSession)
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    coded = scratch.write(encode_documents(docs, vocabulary, buckets), "maxent-tokens")
    return score_documents(coded, counts, *train(coded, vocabulary, buckets, scratch, most), scratch)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", (remainder(10) == 0).alias("held_out"))
    return score_corpus(docs)
