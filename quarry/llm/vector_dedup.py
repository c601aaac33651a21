"""Operator 9: near-duplicate vectors by collision-counting projections.

Every vector gets its values on ``projections`` random lines. Two vectors collide on a
line if their values differ by at most the window, which is centred on the query. For a
pair at the threshold the number of collisions is calibrated on synthetic pairs at just
that cosine: the required count is one that all but ``miss`` of them reach, and closer
pairs collide more often. Pairs that reach the count are verified in double precision.

The lines are used in sorted order: a block sorts the values of its rows on each line,
finds each query's window as a range of ranks by binary search, and adds up, for all its
pairs at once, in how many lines the partner's rank lies in the range. Equal vectors are
one class with a multiplicity. A block emits counts and a spanning forest of its links, not
the links.

*Blocks* are groups of vectors that may be linked, directly or over others. Several tables
deal the vectors to cells: a table has groups of lines of its own, and a cell is, for each
group, the line with the largest value and its sign. The lines of a group, the groups and
the tables follow from the number of vectors, so that a cell has about ``CELL`` of them if
they are spread evenly, and all but ``miss`` of the pairs at the threshold share a cell in
some table. Members of a cell whose signs agree on enough of ``SIGNS`` further lines, again
all but ``miss`` of such pairs, are joined; connected vectors are a group. A vector's copies
in cells are 24 bytes, and the vectors themselves travel only within their group. Groups and
cells with many rows are split into chunks that meet pairwise, so a block has a bounded size;
a count of one vector in 16 tells which cells those are, and only how work is dealt hangs on it.

Defined cases: null, empty and zero vectors, vectors with null or non-finite components
and vectors of another length than the commonest link with nothing; rows with the same
vec_id are one vector each, and equal vectors are linked with each other; a vector without
vec_id takes part, gives no component id of its own and isn't kept; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.components import components, lookup, union_find
from quarry.llm.vectors import dimension, matrix, usable
from quarry.session import Scratch, release_shuffles, small_batches, tidy

#: Rows of a chunk of vectors, and of a chunk of a cell's signs; rows of a cell to aim at.
CHUNK, MANY, CELL = 4096, 8192, 512
#: Lines whose signs are compared in a cell: two 64-bit numbers.
SIGNS = 128
#: With more tables than that, all vectors share one cell instead.
MOST_TABLES = 128


def lines(dim: int, number: int, seed: int = 9) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, number))


def calibrate(dim: int, number: int, window: float, threshold: float, miss: float, seed: int = 10) -> int:
    """The count that all but ``miss`` of 200,000 synthetic pairs at the threshold reach."""
    rng = np.random.default_rng(seed)
    distance = math.sqrt(2 - 2 * threshold)
    counts = (np.abs(rng.standard_normal((200_000, number)) * distance) <= window).sum(axis=1)
    return int(np.quantile(counts, miss, method="lower"))


def count_collisions(a: np.ndarray, b: np.ndarray, window: float) -> np.ndarray:
    """Collisions of each row of a with each row of b (values on lines by row)."""
    if len(a) * len(b) <= 4096:  # sorting pays later
        return (np.abs(a[:, None] - b[None]) <= window).sum(axis=2, dtype=np.uint8)
    counts = np.zeros((len(a), len(b)), np.uint8)
    for line in range(a.shape[1]):
        order = np.argsort(b[:, line], kind="stable")
        ranks = np.empty(len(b), np.uint16)
        ranks[order] = np.arange(len(b), dtype=np.uint16)
        values = b[order, line]
        low = np.searchsorted(values, a[:, line] - window, "left").astype(np.uint16)
        high = np.searchsorted(values, a[:, line] + window, "right").astype(np.uint16)
        counts += (ranks[None, :] - low[:, None]) < (high - low)[:, None]
    return counts


def block_links(ids, unit, values, other_ids, other_unit, other_values, window, need, threshold) -> list[tuple[int, int]]:
    """Index pairs of a block that pass the count and the verification."""
    found = []
    for at in range(0, len(ids), 256):
        counts = count_collisions(values[at : at + 256], other_values, window)
        i, j = np.nonzero(counts >= need)
        i += at
        keep = ids[i] != other_ids[j]
        if other_ids is ids:
            keep &= i < j
        i, j = i[keep], j[keep]
        for k in range(0, len(i), 100_000):
            x, y = i[k : k + 100_000], j[k : k + 100_000]
            good = np.einsum("ij,ij->i", unit[x], other_unit[y]) >= threshold
            found.append(np.stack([x[good], y[good]], axis=1))
    return np.concatenate(found) if found else np.zeros((0, 2), np.int64)


def forest(n: int, pairs: np.ndarray, ids: np.ndarray) -> dict[int, int]:
    """Each linked row's root, the row of the least id that it reaches in the block."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in pairs.tolist():
        x, y = find(x), find(y)
        if x != y:
            if ids[x] > ids[y]:
                x, y = y, x
            root[y] = x
    return {x: find(x) for x in np.unique(pairs).tolist()}


def tables_for(rows: int, threshold: float, miss: float, seed: int = 11) -> tuple[int, int, int]:
    """Tables, groups of a table and lines of a group, such that all but ``miss`` of the pairs
    at the threshold share a cell of about CELL rows; (1, 0, 0) for a single cell."""
    bits = math.log2(max(rows / CELL, 1))
    if bits <= 1:
        return 1, 0, 0
    groups = math.ceil(bits / 7)
    width = math.ceil(2 ** (bits / groups) / 2)
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((50_000, width), np.float32)
    y = threshold * x + math.sqrt(max(1 - threshold**2, 0)) * rng.standard_normal(x.shape, np.float32)
    same = float((extremes(x[:, None]) == extremes(y[:, None])).mean()) ** groups
    tables = 1 if same == 1 else math.ceil(math.log(miss) / math.log1p(-same)) if same else MOST_TABLES + 1
    return (tables, groups, width) if tables <= MOST_TABLES else (1, 0, 0)


def extremes(values: np.ndarray) -> np.ndarray:
    """A number for the largest value's line and sign in each group (rows, groups, lines)."""
    n, groups, width = values.shape
    at = np.abs(values).argmax(axis=2)
    sign = np.take_along_axis(values, at[:, :, None], 2)[:, :, 0] > 0
    return ((2 * at + sign) * (2 * width) ** np.arange(groups)).sum(axis=1)


def agreeing(threshold: float, miss: float, seed: int = 12) -> int:
    """The number of SIGNS lines on which all but ``miss`` of pairs at the threshold have one sign."""
    same = 1 - math.acos(min(max(threshold, -1), 1)) / math.pi
    return int(np.quantile(np.random.default_rng(seed).binomial(SIGNS, same, 200_000), miss, method="lower"))


def unit_rows(column: pa.Array, dim: int) -> np.ndarray:
    x = matrix(column, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def sign_forest(node: np.ndarray, signs: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (a, b) of the rows that agree on at least ``need`` signs."""
    a = b = np.zeros(0, np.int64)
    strip = max(1, (1 << 21) // len(node))
    signs = signs.view(np.uint64)
    for at in range(0, len(node) - 1, strip):
        rest = signs[at:]
        far = np.bitwise_count(rest[:strip, None, 0] ^ rest[None, :, 0])
        far += np.bitwise_count(rest[:strip, None, 1] ^ rest[None, :, 1])
        i, j = np.nonzero(far <= SIGNS - need)
        keep = i < j
        if keep.any():
            ids, least = union_find(np.concatenate([a, node[at + i[keep]]]), np.concatenate([b, node[at + j[keep]]]))
            a, b = least[ids != least], ids[ids != least]
    return a, b


def by_block(process: Callable[[pa.Table], pa.Table]) -> Callable[[Iterator], Iterator]:
    """A mapper that passes on each block's rows, which stand together, as one table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done() -> list[pa.RecordBatch]:
            found = process(pa.Table.from_batches(held).combine_chunks())
            held.clear()
            return found.to_batches()

        def full(found: list[pa.Table], least: int) -> Iterator[pa.RecordBatch]:
            if sum(x.num_rows for x in found) >= least:
                yield from pa.concat_tables(found).combine_chunks().to_batches()
                found.clear()

        out: list[pa.Table] = []
        for batch in batches:
            block = batch.column("block").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
            for i, j in zip(cuts, cuts[1:]):
                if j > i:
                    if held and held[-1].column("block")[0].as_py() != block[i]:
                        out += [pa.Table.from_batches([x]) for x in done()]
                        yield from full(out, 10_000)
                    held.append(batch.slice(i, j - i))
        if held:
            out += [pa.Table.from_batches([x]) for x in done()]
        yield from full(out, 1)

    return run


def groups_of(classes: DataFrame, dim: int, rows: int, threshold: float, miss: float, scratch: Scratch) -> DataFrame:
    """(id, component_id) of the classes (node, embedding) that may be linked with another."""
    spark = classes.sparkSession
    tables, groups, width = tables_for(rows, threshold, miss)
    need = agreeing(threshold, miss)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directions, further = lines(dim, tables * groups * width, seed=13), lines(dim, SIGNS, seed=14)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                unit = unit_rows(part.column(1), dim)
                signs = np.packbits(unit @ further > 0, axis=1).view(np.int64)
                for t in range(tables):
                    cell = np.full(len(unit), t * (2 * width) ** groups)
                    if groups:
                        own = directions[:, t * groups * width : (t + 1) * groups * width]
                        cell += extremes((unit @ own).reshape(-1, groups, width))
                    yield pa.RecordBatch.from_arrays([pa.array(cell), part.column(0), pa.array(signs[:, 0].copy()), pa.array(signs[:, 1].copy())], ["cell", "node", "s0", "s1"])

    placing = "cell long, node long, s0 long, s1 long"
    some = classes.where("pmod(node, 16) = 0").mapInArrow(tidy(place), placing).groupBy("cell").agg((16 * F.count("*")).alias("rows"))
    large = some.where(F.col("rows") > MANY).select("cell", F.ceil(F.col("rows") / MANY).cast("int").alias("chunks"))
    large = scratch.write(large, "vector-cells", small=True)
    placed = classes.mapInArrow(tidy(place), placing).join(F.broadcast(large), "cell", "left")
    chunk = F.pmod(F.xxhash64("node"), "chunks").cast("int")
    meets = F.when(F.col("chunks").isNull(), F.array("cell")).otherwise(F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda x: F.xxhash64("cell", F.least(x, chunk), F.greatest(x, chunk))))
    dealt = placed.select(F.explode(meets).alias("block"), "node", "s0", "s1")
    dealt = dealt.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "block").sortWithinPartitions("block")

    def join(block: pa.Table) -> pa.Table:
        signs = np.stack([block.column(k).to_numpy() for k in ("s0", "s1")], axis=1)
        a, b = sign_forest(block.column("node").to_numpy(), signs, need) if len(signs) > 1 else (np.zeros(0, np.int64),) * 2
        return pa.table({"a": a, "b": b})

    joined = scratch.write(dealt.mapInArrow(tidy(by_block(join)), "a long, b long"), "vector-candidates")
    release_shuffles(spark)
    found = components(joined, "vector-groups")
    scratch.drop(joined, large)
    return found


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, projections: int = 24, window_sd: float = 3.3, miss: float = 0.0005) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of (vec_id, embedding)."""
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession)
    doubles = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    good = rows.where(usable(doubles))
    dim = dimension(good)
    good = good.where(F.size("embedding") == dim)
    # classes of equal vectors
    keyed = good.withColumn("key", F.unhex(F.sha2(F.array_join(doubles.cast("array<string>"), ",").cast("binary"), 256)))
    members = scratch.write(keyed.select("vec_id", "key"), "vector-members", small=True)
    found = keyed.groupBy("key").agg(F.min("vec_id").alias("class_id"), F.count("*").alias("n"), F.any_value("embedding").alias("embedding"))
    sizes = scratch.write(found.withColumn("node", F.xxhash64("key")), "vector-classes")
    release_shuffles(spark)
    window = window_sd * math.sqrt(2 - 2 * threshold)
    need = calibrate(max(dim, 1), projections, window, threshold, miss)
    small_batches(spark, 10_000, 4)
    group = groups_of(sizes.select("node", "embedding"), dim, sizes.count(), threshold, miss, scratch)

    # a group meets itself, a large one in pairs of chunks
    large = group.groupBy("component_id").count().where(F.col("count") > CHUNK).select("component_id", F.ceil(F.col("count") / CHUNK).cast("int").alias("chunks"))
    large = scratch.write(large, "vector-large", small=True)
    placed = group.withColumnRenamed("id", "node").join(F.broadcast(large), "component_id", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    placed = placed.join(sizes.select("node", "n", "embedding"), "node").withColumn("chunk", F.pmod(F.xxhash64("node"), "chunks").cast("int"))
    meets = F.explode(F.expr("transform(sequence(0, chunks - 1), x -> struct(least(x, chunk) AS i, greatest(x, chunk) AS j, chunk <= x AS is_left, chunk >= x AS is_right))")).alias("p")
    blocks = placed.select("component_id", "node", "n", "embedding", meets).select(F.xxhash64("component_id", "p.i", "p.j").alias("block"), "p.is_left", "p.is_right", "node", "n", "embedding")
    blocks = blocks.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "block").sortWithinPartitions("block")
    directions = lines(max(dim, 1), projections)

    def meet(block: pa.Table) -> pa.Table:
        left, right = (block.filter(block.column(k)) for k in ("is_left", "is_right"))
        out = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])
        if not left.num_rows or not right.num_rows:
            return out.empty_table()

        def parts(t: pa.Table):
            unit = unit_rows(t.column("embedding").combine_chunks(), dim)
            return t.column("node").to_numpy(), t.column("n").to_numpy(), unit, unit @ directions

        ids, n, unit, values = parts(left)
        if left.num_rows == block.num_rows == right.num_rows:
            other = (ids, n, unit, values)
        else:
            other = parts(right)
        pairs = block_links(ids, unit, values, other[0], other[2], other[3], window, need, threshold)
        if not len(pairs):
            return out.empty_table()
        if other[0] is not ids:
            pairs = pairs + [0, len(ids)]
            ids, n = np.concatenate([ids, other[0]]), np.concatenate([n, other[1]])
        links = np.bincount(pairs[:, 0], n[pairs[:, 1]], len(ids)) + np.bincount(pairs[:, 1], n[pairs[:, 0]], len(ids))
        roots = forest(len(ids), pairs, ids)
        at = np.array(list(roots))
        return pa.Table.from_arrays([pa.array(ids[at]), pa.array(links[at].astype(np.int64)), pa.array(ids[list(roots.values())])], schema=out)

    met = scratch.write(blocks.mapInArrow(tidy(by_block(meet)), "node long, links long, root long"), "vector-links")
    release_shuffles(spark)
    linked = met.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(met.select(F.col("node").alias("a"), F.col("root").alias("b")), "vector-components")
    classes = sizes.select("node", "key", "class_id", "n").join(linked, "node", "left").join(joined.withColumnRenamed("id", "node"), "node", "left")
    classes = scratch.write(classes.select("key", "class_id", "n", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component_id", "node").alias("c")), "vector-results", small=True)
    scratch.drop(met, large, sizes)
    heads = scratch.write(classes.groupBy("c").agg(F.min("class_id").alias("component_id")), "vector-heads", small=True)
    classes = scratch.write(lookup(classes, "c", heads), "vector-named", small=True)
    known = lookup(members, "key", classes.select("key", "n", "links", "component_id"))
    known = known.select("vec_id", (F.col("n") - 1 + F.col("links")).alias("n_links"), "component_id")
    rest = rows.where(~(usable(doubles) & (F.size("embedding") == dim))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return known.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
