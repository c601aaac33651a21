"""Connected components, look-ups that hold up under hot keys, and choices among wide rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.session import Scratch

#: A key is hot above this share of all rows, so there are at most HOT_KEYS hot keys.
HOT_KEYS = 512


def hot_keys(counts: DataFrame, key: str, count: str) -> list:
    """The keys, at most HOT_KEYS, that hold more than their share of all rows."""
    total = counts.agg(F.sum(count)).first()[0] or 0
    hot = counts.where(F.col(count) * HOT_KEYS > max(total, HOT_KEYS * 64)).select(key)
    return [row[0] for row in hot.limit(HOT_KEYS).collect()]


def lookup(rows: DataFrame, key: str, known: DataFrame, how: str = "inner", hot: list | None = None) -> DataFrame:
    """Joins ``known`` (unique by ``key``, narrow rows only) to ``rows``, of which one key may hold most.

    The rows of ``known`` for hot keys, at most HOT_KEYS by definition, are broadcast;
    all other keys are spread by an ordinary join. Without ``hot``, ``rows`` is counted
    first and should be a written table.
    """
    if hot is None:
        hot = hot_keys(rows.groupBy(key).count(), key, "count")
    if not hot:
        return rows.join(known, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    few = known.where(F.col(key).isin(hot))
    return rows.where(~is_hot).join(known, key, how).unionByName(rows.where(is_hot).join(F.broadcast(few), key, how))


def _slot(key: str, salt: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("long"), F.lit(salt)), F.lit(bits))


def _hits(keys: DataFrame, key: str, salt: int, name: str) -> tuple[DataFrame, Column]:
    """A bitmap of hashed keys, at least 16 slots each but at most 8 MB, as a row of
    the column ``name`` to broadcast, and the condition that a row's key has a slot in it."""
    bits = 1 << min(26, max(16, (16 * max(keys.count(), 1)).bit_length()))
    slots = keys.select(_slot(key, salt, bits).alias("slot")).groupBy(F.shiftright("slot", 6).cast("int").alias("w"))
    found = slots.agg(F.bit_or(F.expr("shiftleft(1L, int(slot % 64))")).alias("v")).toArrow()
    words = np.zeros(bits // 64, np.int64)
    words[found.column("w").to_numpy()] = found.column("v").to_numpy()
    row = keys.sparkSession.createDataFrame(pa.table({name: pa.array([words], pa.list_(pa.int64()))}))
    slot = _slot(key, salt, bits)
    return F.broadcast(row), F.getbit(F.get(name, F.shiftright(slot, 6).cast("int")), (slot % 64).cast("int")) == 1


def chosen_rows(rows: DataFrame, key: str, known: DataFrame) -> DataFrame:
    """The rows whose key is kept by ``known``, a written table of (key, kept) that has every key
    of ``rows``.

    Rows may be wide, so few of them move. Most that stay are told by a bitmap of the other
    keys, most that go by a bitmap of the kept keys with a slot in the first. Rows that both
    bitmaps leave open are joined.
    """
    kept, others = known.where("kept").select(key), known.where("NOT kept").select(key)
    name = "words"
    while name in rows.columns:
        name += "_"
    mark, hit = _hits(others, key, 0, name)
    doubtful = kept.join(mark, hit, "left_semi")
    second, met = _hits(doubtful, key, 1, name)
    open_ = rows.join(mark, hit, "left_semi").join(second, met, "left_semi").join(doubtful, key, "left_semi")
    return rows.join(mark, hit, "left_anti").unionByName(open_.select(rows.columns))


def union_find(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of two columns of links, and for each the least id that it reaches."""
    ids, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = np.arange(len(ids))
    x, y = place[: len(a)], place[len(a) :]
    while len(x):
        low, high = np.minimum(label[x], label[y]), np.maximum(label[x], label[y])
        open_ = low < high
        if not open_.any():
            break
        x, y = x[open_], y[open_]
        np.minimum.at(label, high[open_], low[open_])
        while True:  # to the label of the label, until it is its own
            up = label[label]
            if (up == label).all():
                break
            label = up
    return ids, ids[label]


def thinned(edges: DataFrame) -> DataFrame:
    """At most one link an id and task, to the least id that the task's links reach: the same components."""

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def forest() -> tuple[np.ndarray, np.ndarray]:
            ids, least = union_find(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))
            open_ = ids != least
            return least[open_], ids[open_]

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            rows += batch.num_rows
            if rows > 1 << 20:  # what a task holds is bounded; a forest is already thin
                held = [forest()]
                rows = 0
                if len(held[0][0]) > 1 << 19:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in held.pop()], ["a", "b"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in forest()], ["a", "b"])

    return edges.select(F.col("a").cast("long"), F.col("b").cast("long")).mapInArrow(thin, "a long, b long")


def components(edges: DataFrame, name: str = "components", most_rounds: int = 60) -> DataFrame:
    """(id, component_id) of every id in ``edges`` (columns a, b): the least id reachable.

    Links are thinned task by task first. Then two steps alternate: every id takes the
    least label among its own and its neighbours', and then the label of its label, until
    the first step changes nothing. Labels meet edges in shuffles only; each round is a
    written table, and the driver gets only whether it changed anything and the few hot ids.
    """
    scratch = Scratch(edges.sparkSession)
    forest = thinned(edges.where("a <> b"))
    both = forest.union(forest.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = scratch.write(both.distinct(), f"{name}-edges", small=True)
    hot = hot_keys(both.groupBy("b").count(), "b", "count")
    labels = both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("c"))
    old = None
    for _ in range(most_rounds):
        near = lookup(both, "b", labels.select(F.col("id").alias("b"), "c"), hot=hot).groupBy(F.col("a").alias("id")).agg(F.min("c").alias("m"))
        stepped = scratch.write(labels.join(near, "id").select("id", F.col("c").alias("old"), F.least("c", "m").alias("c")), f"{name}-step", small=True)
        if old is not None:
            scratch.drop(old)
        old = stepped
        if stepped.where("c <> old").isEmpty():
            break
        jump = stepped.select(F.col("id").alias("c"), F.col("c").alias("up"))
        labels = lookup(stepped.select("id", "c"), "c", jump).select("id", F.least("c", "up").alias("c"))
    else:
        raise RuntimeError("components did not settle; raise most_rounds")
    result = scratch.write(stepped.select("id", F.col("c").alias("component_id")), f"{name}-labels", small=True)
    scratch.close(result)
    return result
