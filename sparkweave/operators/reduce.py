"""Reductions whose result depends on a plan of chunks alone, not on partitions or threads."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ReduceError(ValueError):
    """A chunk failed; the lowest one's message, and its number."""

    def __init__(self, chunk: int, message: str):
        super().__init__(f"chunk {chunk}: {message}")
        self.chunk = chunk


@dataclass(frozen=True)
class Plan:
    """0..n in chunks of grain items at most, whose sizes differ by one at most, the larger first; one empty chunk for none."""

    n: int
    grain: int

    def __post_init__(self):
        if self.grain <= 0 or self.n < 0:
            raise ValueError("a plan has items and a grain above 0")

    @property
    def chunks(self) -> int:
        return max(1, -(-self.n // self.grain))

    def range(self, k: int) -> range:
        """The items of a chunk."""
        if not 0 <= k < self.chunks:
            raise IndexError(f"there are {self.chunks} chunks")
        size, larger = divmod(self.n, self.chunks)
        return range(k * size + min(k, larger), (k + 1) * size + min(k + 1, larger))

    def chunk_of(self, item: Column) -> Column:
        """The chunk that an item is in, of items under n."""
        size, larger = divmod(self.n, self.chunks)
        if not size:
            return item.cast("long")
        cut = larger * (size + 1)
        return F.when(item < cut, F.floor(item / F.lit(size + 1))).otherwise(larger + F.floor((item - cut) / F.lit(size))).cast("long")


def seed_split(seed: int, chunk: Column) -> Column:
    """A seed for each chunk or other work item, which depends on the seed and the item alone."""
    return F.xxhash64(F.lit(seed), chunk)


def partials(df: DataFrame, plan: Plan, item: str, value: str, of: Callable[[Column, Column], Column], seed: int = 0) -> DataFrame:
    """(chunk, partial) of every chunk of the plan: of(values, seed), from a chunk's values in order of item; items from 0 on.

    A chunk is gathered in one row, so grain bounds what a task holds.
    """
    rows = df.select(plan.chunk_of(F.col(item)).alias("chunk"), F.struct(F.col(item).alias("i"), F.col(value).alias("x")).alias("row"))
    held = rows.groupBy("chunk").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    empty = F.array().cast(held.schema["rows"].dataType)
    every = df.sparkSession.range(plan.chunks).select(F.col("id").alias("chunk")).join(held, "chunk", "left")
    values = F.transform(F.coalesce("rows", empty), lambda r: r["x"])
    return every.select("chunk", of(values, seed_split(seed, F.col("chunk"))).alias("partial"))


def det_reduce(df: DataFrame, plan: Plan, item: str, value: str, of: Callable[[Column, Column], Column], identity: Column, reduce: Callable[[Column, Column], Column], seed: int = 0) -> DataFrame:
    """One row: the partials of all chunks, folded in order of chunk from identity on.

    The fold is a sequence over plan.chunks partials, which one task holds: take a grain that leaves few.
    """
    found = partials(df, plan, item, value, of, seed)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("chunk", "partial"))), lambda p: p["partial"])
    return found.agg(F.aggregate(ordered, identity, reduce).alias("result"))


def try_det_reduce(df: DataFrame, plan: Plan, item: str, value: str, of: Callable[[Column, Column], Column], check: Callable[[Column], Column], identity: Column, reduce: Callable[[Column, Column], Column], seed: int = 0) -> DataFrame:
    """As det_reduce; check gives the error of a chunk's values, or null. Every chunk is worked out, and the lowest error is raised."""
    found = partials(df, plan, item, value, lambda v, s: F.struct(of(v, s).alias("value"), check(v).alias("error")), seed)
    first = found.where("partial.error IS NOT NULL").agg(F.min(F.struct("chunk", F.col("partial.error").alias("error"))).alias("e")).first()[0]
    if first is not None:
        raise ReduceError(first[0], first[1])
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("chunk", F.col("partial.value").alias("value")))), lambda p: p["value"])
    return found.agg(F.aggregate(ordered, identity, reduce).alias("result"))


def chunked_sum(values: Column, lanes: int) -> Column:
    """The sum of an array of doubles by lanes: the i-th value is added to lane i mod lanes, and the lanes are added in order."""
    if lanes <= 0:
        raise ValueError("a sum needs a lane")
    each = F.transform(F.sequence(F.lit(0), F.lit(lanes - 1)), lambda k: F.aggregate(F.filter(values, lambda x, i: i % lanes == k), F.lit(0.0), lambda a, x: a + x))
    return F.aggregate(each, F.lit(0.0), lambda a, x: a + x)
