"""Rules that go through the rows of a key in order, for keys of any size: rows are dealt out by range, what a run of rows
does to the state is summed up as a piecewise map, and each run is replayed from the state in which it begins."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sightline.session import shared_folder

FAN = 64


# ----------------------------------------------------------------------------------- piecewise maps

class Pieces:
    """A map of the states ``start[0]``..``cap``: from ``start[i]`` on either ``state + shift[i]`` (``moves[i]``) or
    ``shift[i]``.

    Maps of this kind are closed under composition, and neighbours that agree are one piece: however many rows a map
    stands for, it has no more pieces than there are states."""

    def __init__(self, cap: int, start: np.ndarray, moves: np.ndarray, shift: np.ndarray):
        self.cap, self.start, self.moves, self.shift = cap, start, moves, shift

    @classmethod
    def same(cls, low: int, high: int) -> Pieces:
        """The states ``low`` to ``high``, left as they are."""
        return cls(high, np.array([low], np.int64), np.array([True]), np.array([0], np.int64))

    @classmethod
    def of(cls, cap: int, pieces: list[tuple[int, bool, int]]) -> Pieces:
        start, moves, shift = zip(*pieces)
        return cls(cap, np.array(start, np.int64), np.array(moves, bool), np.array(shift, np.int64))

    def __call__(self, state: int) -> int:
        i = int(np.searchsorted(self.start, state, "right")) - 1
        return int(self.shift[i]) + (state if self.moves[i] else 0)

    def then(self, after: Pieces) -> Pieces:
        """``after`` of this map."""
        end = np.append(self.start[1:], self.cap + 1)
        found = []
        for low, high, moves, shift in zip(after.start, np.append(after.start[1:], after.cap + 1), after.moves, after.shift):
            # Where this map's values lie in [low, high): a stretch of each moving piece, all or nothing of a fixed one.
            a = np.where(self.moves, np.maximum(self.start, low - self.shift), self.start)
            b = np.where(self.moves, np.minimum(end, high - self.shift), np.where((self.shift >= low) & (self.shift < high), end, self.start))
            own = np.flatnonzero(a < b)
            found.append((a[own], self.moves[own] & moves, np.where(moves, self.shift[own] + shift, shift)))
        start, moves, shift = (np.concatenate(c) for c in zip(*found))
        order = np.argsort(start)
        start, moves, shift = start[order], moves[order], shift[order]
        new = np.append(True, (moves[1:] != moves[:-1]) | (shift[1:] != shift[:-1]))
        return Pieces(self.cap, start[new], moves[new], shift[new])

    def to_bytes(self) -> bytes:
        return np.concatenate([[self.cap], self.start, self.moves, self.shift]).astype(np.int64).tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> Pieces:
        held = np.frombuffer(raw, np.int64)
        start, moves, shift = held[1:].reshape(3, -1)
        return cls(int(held[0]), start, moves.astype(bool), shift)


# --------------------------------------------------------------------------------------- ordered runs

def in_runs(rows: DataFrame, key: str, order: str, run_rows: int | None = None) -> tuple[DataFrame, int]:
    """The rows stored with ``_run``, the number of the range of (key, order) they lie in, and how many there are at
    most: the session's shuffle width, or so many that a run has about ``run_rows`` rows."""
    spark = rows.sparkSession
    n = -(-rows.count() // run_rows) if run_rows else int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = f"{shared_folder(spark)}/sightline-runs-{uuid.uuid4().hex}"
    rows.repartitionByRange(max(1, n), key, order).withColumn("_run", F.spark_partition_id()).write.parquet(path)
    return spark.read.schema(rows.withColumn("_run", F.lit(0)).schema).parquet(path), max(1, n)


def _ordered(runs: DataFrame, n: int, key: str, order: str) -> DataFrame:
    return runs.repartition(n, "_run").sortWithinPartitions("_run", key, order)


def _spanning(runs: DataFrame, key: str) -> DataFrame:
    """``key, _run`` of the keys that lie in several runs: the first and last key of a run at most, so no more rows than
    twice the number of runs."""
    ends = runs.groupBy("_run").agg(F.min(key).alias("a"), F.max(key).alias("b"))
    ends = ends.select("_run", F.explode(F.array_distinct(F.array("a", "b"))).alias(key))
    several = ends.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(key)
    return ends.join(several, key)


def _starts(summaries: DataFrame, key: str, n: int, fan: int) -> DataFrame:
    """``key, _run, state``: the state in which each run of a key begins. ``fan`` neighbouring maps are composed into one,
    as often as it takes to have ``fan`` left, and the known states are handed down the same way."""
    kind = summaries.schema[key].dataType.simpleString()

    def walk(group: pd.DataFrame, state: int) -> pd.DataFrame:
        group, states = group.sort_values("_run"), []
        for raw in group["map"]:
            states.append(state)
            state = Pieces.from_bytes(raw)(state)
        return pd.DataFrame({key: group[key], "_run": group["_run"], "state": np.array(states, np.int64)})

    schema = f"{key} {kind}, _run bigint, state bigint"
    if n <= fan:
        return summaries.groupBy(key).applyInPandas(lambda g: walk(g, 0), schema)
    packs = summaries.withColumn("_pack", F.floor(F.col("_run") / fan))

    def compose(group: pd.DataFrame) -> pd.DataFrame:
        whole = None
        for raw in group.sort_values("_run")["map"]:
            one = Pieces.from_bytes(raw)
            whole = one if whole is None else whole.then(one)
        return pd.DataFrame({key: group[key].iloc[:1], "_run": group["_pack"].iloc[:1], "map": [whole.to_bytes()]})

    above = _starts(packs.groupBy(key, "_pack").applyInPandas(compose, f"{key} {kind}, _run bigint, map binary"), key, -(-n // fan), fan)
    begun = packs.join(above.select(key, F.col("_run").alias("_pack"), F.col("state").alias("_state")), [key, "_pack"])
    return begun.groupBy(key, "_pack").applyInPandas(lambda g: walk(g, int(g["_state"].iloc[0])), schema)


class Rule:
    """How one row changes the state. ``values`` are those of the columns that the rule reads."""
    reads: list[str] = []

    def __init__(self, cap: int):
        self.cap = cap

    def after(self, state: int, *values) -> int:
        raise NotImplementedError

    def pieces(self, *values) -> Pieces:
        """The rule as a map of all states."""
        raise NotImplementedError

    def bounds(self, low: int, high: int, *values) -> tuple[int, int]:
        """Between which states those from ``low`` to ``high`` end."""
        raise NotImplementedError


def _summed(crossing: DataFrame, key: str, n: int, rule: Rule, kind: str) -> DataFrame:
    """``key, _run, map`` of the keys that lie in several runs.

    What is known of the end of one run is what the next can begin with. Most rules forget where they began after some
    rows: a first pass tells between which states each run ends, whatever it began with, and the maps of the second pass
    are made for those states alone."""
    reads = rule.reads

    def grouped(batches, begin, add, end):
        at, whole = None, None
        for batch in batches:
            for run, k, *values in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))):
                domain, values = values[:-len(reads)], values[-len(reads):]
                if (run, k) != at:
                    if at is not None:
                        yield end(at, whole)
                    at, whole = (run, k), begin(*domain)
                whole = add(whole, values)
        if at is not None:
            yield end(at, whole)

    from pyspark.sql.pandas.types import to_arrow_type

    key_of = to_arrow_type(crossing.schema[key].dataType)
    ends_of = pa.schema([(key, key_of), ("_run", pa.int64()), ("_low", pa.int64()), ("_high", pa.int64())])
    map_of = pa.schema([(key, key_of), ("_run", pa.int64()), ("map", pa.binary())])

    def ends(batches):
        return grouped(batches, lambda: (0, rule.cap), lambda w, v: rule.bounds(*w, *v), lambda at, w: pa.RecordBatch.from_pydict(
            {key: [at[1]], "_run": [at[0]], "_low": [w[0]], "_high": [w[1]]}, schema=ends_of))

    def maps(batches):
        return grouped(batches, lambda low, high: Pieces.same(low, high), lambda w, v: w.then(rule.pieces(*v)), lambda at, w: pa.RecordBatch.from_pydict(
            {key: [at[1]], "_run": [at[0]], "map": [w.to_bytes()]}, schema=map_of))

    ended = _ordered(crossing, n, key, "_order").select("_run", key, *reads).mapInArrow(ends, f"{key} {kind}, _run bigint, _low bigint, _high bigint")
    # The first run of a key begins with 0. At most two rows a run, so a key's window is no longer than the runs are many.
    before = Window.partitionBy(key).orderBy("_run")
    domain = ended.select(F.col(key).alias("_key"), F.col("_run").alias("_of"), *(F.coalesce(F.lag(c).over(before), F.lit(0)).alias(c) for c in ("_low", "_high")))
    known = crossing.join(domain, (F.col(key) == F.col("_key")) & (F.col("_run") == F.col("_of")))
    return _ordered(known, n, key, "_order").select("_run", key, "_low", "_high", *reads).mapInArrow(maps, f"{key} {kind}, _run bigint, map binary")


def replay(rows: DataFrame, key: str, order: str, rule: Rule, run_rows: int | None = None, fan: int = FAN) -> DataFrame:
    """Adds ``before`` and ``spent``: the state, a number from 0 to the rule's cap that is 0 for the first row of a key,
    before and after each row in order.

    Order is by range partitioning, so a key with a third of all rows is many runs. Only keys that lie in several runs
    are summed up, and only where those begin matters: at most two rows a run."""
    runs, n = in_runs(rows, key, order, run_rows)
    kind = rows.schema[key].dataType.simpleString()
    # The keys are at most two a run; whether they are broadcast is left to the optimizer's size check.
    crossing = runs.join(_spanning(runs, key), [key, "_run"], "left_semi").select("_run", key, F.col(order).alias("_order"), *rule.reads)
    begun = _starts(_summed(crossing, key, n, rule, kind), key, n, fan)
    begun = begun.select(F.col(key).alias("_key"), F.col("_run").alias("_of"), F.col("state").alias("_state"))
    known = runs.join(begun, (F.col(key) == F.col("_key")) & (F.col("_run") == F.col("_of")), "left").drop("_key", "_of")
    names = [c for c in known.columns if c not in ("_run", "_state")]

    def walk(batches):
        at, state = None, 0
        for batch in batches:
            befores, states = [], []
            for run, k, start, *values in zip(*(batch.column(c).to_pylist() for c in ("_run", key, "_state", *rule.reads))):
                if (run, k) != at:
                    at, state = (run, k), start or 0
                befores.append(state)
                state = rule.after(state, *values)
                states.append(state)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(befores, pa.int64()), pa.array(states, pa.int64())], [*names, "before", "spent"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in known.schema if f.name in names)
    return _ordered(known, n, key, order).mapInArrow(walk, f"{schema}, before bigint, spent bigint")


def numbered(rows: DataFrame, key: str, order: str, name: str) -> DataFrame:
    """Adds the row's number from 1 within its key, in order: within its run, after the rows of the key's earlier runs."""
    runs, _ = in_runs(rows, key, order)
    sizes = runs.groupBy(key, "_run").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(key).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(key, "_run", before.alias("_before"))
    own = F.row_number().over(Window.partitionBy(key, "_run").orderBy(order))
    return runs.withColumn("_own", own).join(sizes, [key, "_run"]).withColumn(name, (F.col("_before") + F.col("_own")).cast("int")).drop("_own", "_before", "_run")
