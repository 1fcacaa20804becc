"""The load lattice: cells projected on segment, class and deadline slot, re-bucketed by time, relaxed by sweeps.

All integers. A projection is one aggregate; by addition's order-freedom it equals any incremental upkeep, and
deltas are the same aggregate over signed rows. Overflow is an error by name, never a wrap.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillfold.functions.hashing import blake2b_hex
from quillfold.operators.enrich import in_range
from quillfold.schema import INT64_MAX

FIX = 1 << 16
WARRANT = 1


class FieldRefused(ValueError):
    pass


@dataclass(frozen=True)
class Dims:
    segments: int
    classes: int
    slots: int
    slot_ns: int

    def __post_init__(self):
        if min(self.segments, self.classes, self.slot_ns) < 1 or self.slots < 2:
            raise FieldRefused("bad_dims")

    @property
    def buckets(self) -> int:
        return self.segments * self.classes * self.slots


@dataclass(frozen=True)
class Coefficients:
    den: int = 256
    omega: int = 256
    decay: int = 256
    k_cls: int = 64
    k_slot: int = 64
    tol_num: int = 1
    tol_den: int = 100_000
    max_iters: int = 128
    shift: int = 6

    def __post_init__(self):
        if self.den < 1 or self.den & (self.den - 1) or min(self.omega, self.decay, self.tol_den, self.max_iters) < 1 or min(self.k_cls, self.k_slot, self.tol_num, self.shift) < 0:
            raise FieldRefused("bad_coefficients")


def slot_of(due: Column, now: Column | int, dims: Dims) -> Column:
    """No deadline: the last slot; a past one: the first; else whole slots ahead, at most the last."""
    now = F.lit(now).cast("long") if isinstance(now, int) else now
    ahead = F.call_function("div", F.try_subtract(due, now), F.lit(dims.slot_ns).cast("long"))
    last = F.lit(dims.slots - 1).cast("long")
    return F.when(due == 0, last).when(due <= now, F.lit(0).cast("long")).otherwise(F.least(F.coalesce(ahead, last), last)).cast("int")


def crossing_ns(due: Column, slot: Column, dims: Dims) -> Column:
    """The instant at which a deadline leaves a slot; null without deadline or in the first slot."""
    return F.when((due != 0) & (slot > 0), due - slot.cast("long") * dims.slot_ns + 1)


def contributes(state: Column) -> Column:
    return state.between(0, 2)


def placed(cells: DataFrame, now: int, dims: Dims) -> DataFrame:
    """Contributing cells with their bucket: f_seg, f_cls, f_slot."""
    return cells.where(contributes(F.col("state"))).select(
        "*",
        F.pmod(F.col("seg"), F.lit(dims.segments)).cast("int").alias("f_seg"),
        F.pmod(F.col("cls"), F.lit(dims.classes)).cast("int").alias("f_cls"),
        slot_of(F.col("due_ns"), now, dims).alias("f_slot"),
    )


def projection(cells: DataFrame, now: int, dims: Dims, sign: int = 1) -> DataFrame:
    """seg, cls, slot, load, count, warrants of the buckets that have cells; a load outside 64 bits raises."""
    rows = placed(cells, now, dims)
    load = F.sum(F.col("amount_minor").cast("decimal(38,0)") * F.lit(sign * FIX))
    out = rows.groupBy(F.col("f_seg").alias("seg"), F.col("f_cls").alias("cls"), F.col("f_slot").alias("slot")).agg(
        load.alias("wide"), F.sum(F.lit(sign * FIX).cast("long")).alias("count"), F.sum(F.lit(sign).cast("long") * F.col("flags").cast("int").bitwiseAND(WARRANT)).alias("warrants")
    )
    checked = F.coalesce(in_range(F.col("wide")), F.raise_error(F.lit("field_overflow")).cast("long"))
    return out.select("seg", "cls", "slot", checked.alias("load"), "count", "warrants")


def dense(lattice: DataFrame, dims: Dims) -> DataFrame:
    """All buckets, empty ones with zeros."""
    index = F.col("id").cast("int")
    every = lattice.sparkSession.range(dims.buckets).select(
        F.floor(index / (dims.classes * dims.slots)).cast("int").alias("seg"), F.floor(index / dims.slots).cast("int") % dims.classes, index % dims.slots
    ).toDF("seg", "cls", "slot")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return every.join(lattice, ["seg", "cls", "slot"], "left").select("seg", "cls", "slot", zero("load"), zero("count"), zero("warrants"))


def merged(*lattices: DataFrame) -> DataFrame:
    """Lattices added up: a projection and signed deltas."""
    total = reduce(DataFrame.unionByName, lattices)
    wide = F.sum(F.col("load").cast("decimal(38,0)"))
    out = total.groupBy("seg", "cls", "slot").agg(wide.alias("wide"), F.sum("count").alias("count"), F.sum("warrants").alias("warrants"))
    return out.select("seg", "cls", "slot", F.coalesce(in_range(F.col("wide")), F.raise_error(F.lit("field_overflow")).cast("long")).alias("load"), "count", "warrants")


def delta(before: DataFrame, after: DataFrame, now: int, dims: Dims) -> DataFrame:
    """What changed cells take away and bring."""
    return merged(projection(before, now, dims, -1), projection(after, now, dims))


def moved(cells: DataFrame, now: int, later: int, dims: Dims) -> DataFrame:
    """Contributing cells whose slot changes between two instants; time going back is refused."""
    if later < now:
        raise FieldRefused("tick_backwards")
    rows = placed(cells, now, dims).withColumn("new_slot", slot_of(F.col("due_ns"), later, dims))
    return rows.where("f_slot <> new_slot")


def conservation(cells: DataFrame, lattice: DataFrame) -> tuple[int, int]:
    """The table's and the lattice's total; equal unless the projection lost or made something."""
    table = cells.where(contributes(F.col("state"))).agg(F.sum(F.col("amount_minor").cast("decimal(38,0)") * FIX)).first()[0]
    held = lattice.agg(F.sum(F.col("load").cast("decimal(38,0)"))).first()[0]
    return int(table or 0), int(held or 0)


def settled(baseline: Column, dev: Column, shift: int) -> tuple[Column, Column]:
    """A tick's step of the baseline towards the pressure; their sum stays."""
    step = F.shiftright(dev, shift)
    return baseline + step, dev - step


@dataclass
class Sweep:
    dev: np.ndarray
    dirty: np.ndarray
    iters: int
    converged: bool
    capped: bool
    max_move: int
    dev_inf: int
    threshold: int


def _checked(bound: float) -> None:
    """Refuses if magnitudes may leave 64 bits, by a bound in floating point."""
    if bound >= 2.0**63 * (1 - 2.0**-40):
        raise FieldRefused("field_overflow")


def sweep(load: np.ndarray, capacity: np.ndarray, baseline: np.ndarray, warrants: np.ndarray, dev: np.ndarray, c: Coefficients = Coefficients()) -> Sweep:
    """Red-black relaxation of (segments, classes, slots) arrays. Buckets of a colour don't see each other, so a pass is a map.

    A bucket with a warrant stays as it is. Sums are bounded before each pass, and the last product is checked
    exactly; overflow refuses.
    """
    dev = np.array(dev, np.int64)
    shape = dev.shape
    place = np.add.outer(np.arange(shape[1]), np.arange(shape[2])) % 2
    free = np.asarray(warrants) == 0
    diag = np.full(shape, c.decay, np.int64)
    diag[:, 1:] += c.k_cls
    diag[:, :-1] += c.k_cls
    diag[:, :, 1:] += c.k_slot
    diag[:, :, :-1] += c.k_slot
    size = lambda x: float(np.abs(x.astype(np.float64)).max(initial=0))
    bound = size(np.asarray(load)) + size(np.asarray(capacity)) + size(np.asarray(baseline))
    _checked(bound)
    source = np.asarray(load, np.int64) - np.asarray(capacity, np.int64) - np.asarray(baseline, np.int64)
    dirty = np.zeros(shape, bool)
    moved_max = dev_inf = threshold = 0
    for n in range(1, c.max_iters + 1):
        moved_max = 0
        for colour in range(2):
            _checked(bound * c.den + size(dev) * (4 * (c.k_cls + c.k_slot) + c.decay))
            pull = np.zeros(shape, np.int64)
            pull[:, 1:] += c.k_cls * (dev[:, :-1] - dev[:, 1:])
            pull[:, :-1] += c.k_cls * (dev[:, 1:] - dev[:, :-1])
            pull[:, :, 1:] += c.k_slot * (dev[:, :, :-1] - dev[:, :, 1:])
            pull[:, :, :-1] += c.k_slot * (dev[:, :, 1:] - dev[:, :, :-1])
            now = free & (place == colour)
            rest = np.where(now, source * c.den + pull - c.decay * dev, 0)
            if int(np.abs(rest).max(initial=0)) * c.omega > INT64_MAX:
                raise FieldRefused("field_overflow")
            num = c.omega * rest
            step = np.sign(num) * (np.abs(num) // (c.den * diag))
            dev += step
            dirty[now] = step[now] != 0
            moved_max = max(moved_max, int(np.abs(step).max(initial=0)))
        dev_inf = int(np.abs(dev).max(initial=0))
        threshold = max(dev_inf, FIX) // c.tol_den * c.tol_num
        if moved_max <= threshold:
            return Sweep(dev, dirty, n, True, False, moved_max, dev_inf, threshold)
    return Sweep(dev, dirty, c.max_iters, False, True, moved_max, dev_inf, threshold)


def swept(lattice: DataFrame, dims: Dims, c: Coefficients = Coefficients()) -> DataFrame:
    """seg, cls, slot, dev, pressure after a sweep of a dense lattice (columns load, warrants and, if there, capacity, baseline, dev).

    A lattice has a declared, bounded size and its stop rule is global, so it is one group, swept by numpy.
    """
    import pyarrow as pa

    have = lattice.columns
    column = lambda n: F.col(n) if n in have else F.lit(0).cast("long")
    rows = lattice.select("seg", "cls", "slot", "load", "warrants", *[column(n).alias(n) for n in ("capacity", "baseline", "dev")], F.lit(1).alias("one"))

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("seg", "ascending"), ("cls", "ascending"), ("slot", "ascending")])
        grid = {n: t.column(n).to_numpy().reshape(dims.segments, dims.classes, dims.slots) for n in ("load", "capacity", "baseline", "warrants", "dev")}
        s = sweep(grid["load"], grid["capacity"], grid["baseline"], grid["warrants"], grid["dev"], c)
        flat = s.dev.reshape(-1)
        return pa.table({"seg": t.column("seg"), "cls": t.column("cls"), "slot": t.column("slot"), "dev": flat, "pressure": grid["baseline"].reshape(-1) + flat, "iters": np.full(len(flat), s.iters), "converged": np.full(len(flat), s.converged)})

    return rows.groupBy("one").applyInArrow(run, "seg int, cls int, slot int, dev long, pressure long, iters long, converged boolean")


def projection_digest(lattice: DataFrame, dims: Dims) -> str:
    """The identity of dimensions, loads and counts, in bucket order."""
    rows = dense(lattice, dims).orderBy("seg", "cls", "slot").collect()
    numbers = [dims.segments, dims.classes, dims.slots, dims.slot_ns, *[r["load"] for r in rows], *[r["count"] for r in rows]]
    return blake2b_hex(b"".join((x & (1 << 64) - 1).to_bytes(8, "little") for x in numbers))


def full_digest(lattice: DataFrame, swept_: DataFrame, dims: Dims) -> str:
    """The identity of the projection, deviations, baselines and warrants; marks of the last sweep aren't part of it."""
    rows = dense(lattice, dims).join(swept_.select("seg", "cls", "slot", "dev", (F.col("pressure") - F.col("dev")).alias("baseline")), ["seg", "cls", "slot"]).orderBy("seg", "cls", "slot").collect()
    numbers = [r[c] for c in ("dev", "baseline", "warrants") for r in rows]
    return blake2b_hex(projection_digest(lattice, dims).encode() + b"".join((x & (1 << 64) - 1).to_bytes(8, "little") for x in numbers))
