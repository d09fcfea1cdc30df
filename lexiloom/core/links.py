"""Joins of a table with itself on a key, and connected components of links.

Both stay whole when one key holds a large share of the rows: hot keys are cut
into blocks on both sides, so no task sees a key's whole square or one side's
rows times a block, and no key's rows are ever collected into one list.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lexiloom.core.storage import materialize

#: Rows of one key on either side that a single unit of a join holds.
BLOCK = 2000


def _cut(df: DataFrame, parts: Column, mine: str, other: str) -> DataFrame:
    """Each row in one of ``parts`` blocks (``mine``), once for each block it meets (``other``)."""
    own = F.pmod(F.xxhash64(*df.columns), parts).cast("int")
    return df.withColumn(mine, own).withColumn(other, F.explode(F.sequence(F.lit(0), parts - 1)))


#: Pairs that one batch of the pass over sorted rows holds.
_PAIRS = 1 << 20


def _pairs_within(sizes: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of all pairs, the earlier first, inside runs of rows."""
    first, last = np.repeat(starts, sizes), np.repeat(starts + sizes, sizes)
    row = first + np.arange(len(first)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    later = last - row - 1
    cuts = np.searchsorted(np.cumsum(later), np.arange(0, later.sum() + _PAIRS, _PAIRS))
    for a, b in zip(cuts, [*cuts[1:], len(row)], strict=True):
        n = later[a:b]
        left = np.repeat(row[a:b], n)
        if len(left):
            yield left, left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n)


#: Which of the pairs (row numbers of a batch) are to be kept.
Keep = Callable[[pa.RecordBatch, np.ndarray, np.ndarray], np.ndarray]


def _paired(batches: Iterator[pa.RecordBatch], block: int, keep: Keep | None = None, carried: tuple[str, ...] = ()) -> Iterator[pa.RecordBatch]:
    """Pairs of the rows of each key, from rows sorted by key (the first column).

    Rows of keys with more than ``block`` rows come out alone, with their key.
    The ``carried`` columns are null in pairs.
    """
    carry, hot = None, None

    def out(rows: pa.RecordBatch, left: np.ndarray, right: np.ndarray | None) -> pa.RecordBatch:
        at = pa.array(left)
        keys = pa.nulls(len(left), rows.column(0).type) if right is not None else rows.column(0).take(at)
        bare = [right is not None and rows.schema.names[k] in carried for k in range(rows.num_columns)]
        none = lambda k: pa.nulls(len(left), rows.column(k).type)
        a = [none(k) if bare[k] else rows.column(k).take(at) for k in range(1, rows.num_columns)]
        b = [none(k) if bare[k] or right is None else rows.column(k).take(pa.array(right)) for k in range(1, rows.num_columns)]
        return pa.RecordBatch.from_arrays([keys, *a, *b], ["_key", *(f"{c}_{x}" for x in "ab" for c in rows.schema.names[1:])])

    for batch in itertools.chain(batches, [None]):
        rows = carry if batch is None else batch if carry is None else pa.concat_batches([carry, batch])
        if rows is None or not rows.num_rows:
            continue
        keys = rows.column(0).to_numpy()
        starts = np.r_[0, np.flatnonzero(keys[1:] != keys[:-1]) + 1]
        sizes = np.diff(np.r_[starts, len(keys)])
        large = (sizes > block) | (keys[starts] == hot if hot is not None else False)
        small = ~large & (sizes > 1)
        carry = hot = None
        if batch is not None:  # the last key may go on in the next batch
            if large[-1]:
                hot = keys[-1]
            else:
                small[-1] = False
                carry = rows.slice(starts[-1])
        if large.any():
            yield out(rows, np.flatnonzero(np.repeat(large, sizes)), None)
        for left, right in _pairs_within(sizes[small], starts[small]):
            if keep is not None:
                kept = keep(rows, left, right)
                left, right = left[kept], right[kept]
            if len(left):
                yield out(rows, left, right)


def keyed_pairs(
    rows: DataFrame | list[DataFrame], key: str, order: str, block: int = BLOCK,
    keep: tuple[Keep, Column] | None = None, carried: tuple[str, ...] = (), drop_shuffles: bool = False,
) -> DataFrame:
    """Pairs of rows with one key, each once: ``<c>_a, <c>_b`` of the other columns, ``order_a < order_b``.

    Rows are shuffled and sorted by key once; a pass over the sorted rows pairs
    those of each key (a window and a self-join would sort them four times).  A
    key of more than ``block`` rows is left out of that pass and joined with
    itself in blocks on both sides, so a task joins at most about ``block`` rows of
    a key with as many.  Rows with a null key are in no pair.

    ``keep`` chooses among the pairs before any is written, in the pass and, for
    large keys, as a condition on ``<c>_a, <c>_b``; the ``carried`` columns are
    there for that choice and do not come out.  Of several tables, which have no
    key in common, one at a time is shuffled and paired.
    """
    tables = rows if isinstance(rows, list) else [rows]
    names = [c for c in tables[0].columns if c != key]
    kind = lambda c: tables[0].schema[c].dataType.simpleString()
    schema = f"_key {kind(key)}, " + ", ".join(f"{c}_{x} {kind(c)}" for x in "ab" for c in names)
    chosen, condition = keep or (None, F.lit(True))

    def passed(df: DataFrame) -> DataFrame:
        ordered = df.where(F.col(key).isNotNull()).select(key, *names).repartition(F.col(key)).sortWithinPartitions(key, order)
        return materialize(ordered.mapInArrow(lambda it: _paired(it, block, chosen, carried), schema), "pairs", drop_shuffles)

    met = functools.reduce(DataFrame.unionByName, [passed(df) for df in tables])
    hidden = [f"{c}_{x}" for c in carried for x in "ab"]
    few = met.where("_key is null").where(F.col(f"{order}_a") < F.col(f"{order}_b")).drop("_key", *hidden)
    large = met.where("_key is not null").select("_key", *(F.col(f"{c}_a").alias(c) for c in names))
    counted = large.join(large.groupBy("_key").agg(F.ceil(F.count("*") / block).cast("int").alias("_n")), "_key")

    def side(x: str, mine: str, other: str) -> DataFrame:
        cut = _cut(counted, F.col("_n"), mine, other)
        return cut.select("_key", "_p", "_q", *(F.col(c).alias(f"{c}_{x}") for c in names))

    many = side("a", "_p", "_q").join(side("b", "_q", "_p"), ["_key", "_p", "_q"]).where((F.col(f"{order}_a") < F.col(f"{order}_b")) & condition)
    return few.unionByName(many.drop("_key", "_p", "_q", *hidden))


def expand_links(links: DataFrame, left: DataFrame, right: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rows of ``left(class, ...)`` with rows of ``right(class, ...)`` along links.

    ``links(class_a, class_b)``: ``class_a`` names classes of ``left``; it is read
    twice, so it should be a written table.  The other columns of both sides must
    differ in name.  Classes of more than ``block`` rows are cut into blocks on
    their side and each link becomes one unit for each pair of blocks, so no task
    joins more than about ``block`` rows with as many.
    """

    def sizes(df: DataFrame, x: str) -> DataFrame:
        counts = df.groupBy("class").agg(F.ceil(F.count("*") / block).cast("int").alias(f"parts_{x}"))
        return counts.where(f"parts_{x} > 1").withColumnRenamed("class", f"class_{x}")

    big_a, big_b = sizes(left, "a"), sizes(right, "b")
    tagged = links.join(big_a, "class_a", "left").join(big_b, "class_b", "left")
    mine, other = left.withColumnRenamed("class", "class_a"), right.withColumnRenamed("class", "class_b")
    few = tagged.where("parts_a is null and parts_b is null").select("class_a", "class_b").join(mine, "class_a").join(other, "class_b")
    ranges = [F.explode(F.sequence(F.lit(0), F.coalesce(f"parts_{x}", F.lit(1)) - 1)) for x in "ab"]
    units = tagged.where("parts_a is not null or parts_b is not null").withColumn("_p", ranges[0]).withColumn("_q", ranges[1]).select("class_a", "class_b", "_p", "_q")

    def placed(df: DataFrame, big: DataFrame, key: str, part: str) -> DataFrame:
        parts = F.coalesce(f"parts_{key[-1]}", F.lit(1))
        touched = df.join(units.select(key).distinct(), key, "left_semi").join(big, key, "left")
        cut = touched.withColumn(part, F.pmod(F.xxhash64(*[c for c in df.columns if c != key]), parts).cast("int")).drop(f"parts_{key[-1]}")
        return cut.join(units, [key, part])

    unit = ["class_a", "class_b", "_p", "_q"]
    many = placed(mine, big_a, "class_a", "_p").join(placed(other, big_b, "class_b", "_q"), unit)
    return few.unionByName(many.drop("_p", "_q"))


def member_pairs(links: DataFrame, members: DataFrame, block: int = BLOCK) -> DataFrame:
    """Expand class links into distinct pairs ``(id_a, id_b)``, ``id_a < id_b``.

    ``links(class_a, class_b)`` may hold a class with itself; ``members(class,
    id)``.
    """
    return _members_met(links, members, members, block).distinct()


def _members_met(links: DataFrame, left: DataFrame, right: DataFrame, block: int) -> DataFrame:
    both = expand_links(
        links, left.withColumnRenamed("id", "id_l"), right.withColumnRenamed("id", "id_r"), block
    ).where("id_l < id_r or id_l > id_r and class_a <> class_b")
    return both.select(F.least("id_l", "id_r").alias("id_a"), F.greatest("id_l", "id_r").alias("id_b"))


def member_pairs_once(links: DataFrame, members: DataFrame, block: int = BLOCK) -> DataFrame:
    """:func:`member_pairs` for written tables of distinct links, each in one direction, and distinct members.

    ``members(class, id, several)``: whether the id is in several classes.  Pairs
    of ids of one class each are distinct as they are made and are not shuffled
    again, however many there are; only pairs of ids in several classes are.
    """
    one, more = members.where("not several").drop("several"), members.where("several").drop("several")
    pairs = _members_met(links, one, one, block)
    if more.isEmpty():
        return pairs
    others = _members_met(links, more, members.drop("several"), block).union(_members_met(links, one, more, block))
    return pairs.union(others.distinct())


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Label each vertex of ``links(a, b)`` with the least vertex it reaches.

    Alternates large-star and small-star steps; each round's edges are written
    to the shared folder, so lineage stays short and a lost executor costs one
    round.  Only two numbers per round reach the driver.  Raises if the labels
    have not settled after ``max_rounds`` (the rounds needed grow as log n).
    Returns ``(vertex, label)``; vertices without links do not appear.
    """
    edges = materialize(
        links.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
        .where("lo <> hi")
        .distinct(),
        "edges",
    )
    before = None
    for _ in range(max_rounds):
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(
            edges.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
            .where("hi <> lo").distinct()
        )
        least_lo = large.groupBy("hi").agg(F.min("lo").alias("m"))
        joined = large.join(least_lo, "hi")
        small = (
            joined.where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
            .union(least_lo.select("hi", F.col("m").alias("lo")))
            .distinct()
        )
        edges = materialize(small, "edges")
        state = edges.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("s")
        ).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    stars = edges.groupBy("hi").agg(F.min("lo").alias("label"))
    roots = edges.select(F.col("lo").alias("vertex")).distinct()
    return (
        stars.select(F.col("hi").alias("vertex"), "label")
        .union(roots.join(stars.select(F.col("hi").alias("vertex")), "vertex", "left_anti").select("vertex", F.col("vertex").alias("label")))
    )
