"""Declared enrichment: a grain table, side tables by declared joins, and a closed set of reducers.

A declaration is checked whole before a row is read. It compiles to one aggregate for each side table, left-joined
to the grain; Spark chooses how to join. Sums run in decimals and are range-checked, so a total outside 64 bits
refuses its row by name and never wraps.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillfold.functions.hashing import pin
from quillfold.schema import INT64_MAX, INT64_MIN

REDUCERS = ("sum", "min", "max", "first", "last", "count", "distinct_count")


class DeclarationRefused(ValueError):
    def __init__(self, reason: str, what: str):
        super().__init__(f"{reason}: {what}")
        self.reason, self.what = reason, what


@dataclass(frozen=True)
class SideJoin:
    table: str
    key_col: str
    via_table: str
    via_col: str


@dataclass(frozen=True)
class EnrichedColumn:
    target: str
    source: str  # table.column
    reducer: str | None = None


@dataclass(frozen=True)
class BackFill:
    table: str
    columns: tuple[str, ...]


def qualified(ref: str) -> tuple[str, str] | None:
    """Table and column of a reference with exactly one dot between two names."""
    parts = ref.split(".")
    return (parts[0], parts[1]) if len(parts) == 2 and all(parts) else None


@dataclass(frozen=True)
class IngestDef:
    class_table: str
    key_col: str
    columns: tuple[EnrichedColumn, ...]
    joins: tuple[SideJoin, ...] = ()
    back_fill: tuple[BackFill, ...] = ()

    def validate(self, schema: Mapping[str, Sequence[str]]) -> None:
        """Raises for the first defect in declaration order."""

        def need(table: str, column: str) -> None:
            if table not in schema:
                raise DeclarationRefused("enrich_unknown_table", table)
            if column not in schema[table]:
                raise DeclarationRefused("enrich_unknown_source_column", f"{table}.{column}")

        need(self.class_table, self.key_col)
        joined = {j.table for j in self.joins}
        for j in self.joins:
            need(j.table, j.key_col)
            if j.via_table != self.class_table:
                raise DeclarationRefused("enrich_no_join_path", f"{j.table} joins to {j.via_table}, not to the grain")
            need(j.via_table, j.via_col)
        for c in self.columns:
            ref = qualified(c.source)
            if ref is None:
                raise DeclarationRefused("enrich_unqualified_column", c.source)
            need(*ref)
            if ref[0] != self.class_table:
                if ref[0] not in joined:
                    raise DeclarationRefused("enrich_no_join_path", c.source)
                if c.reducer is None:
                    raise DeclarationRefused("enrich_no_reducer", c.source)
            if c.reducer is not None and c.reducer not in REDUCERS:
                raise DeclarationRefused("enrich_unknown_reducer", c.reducer)
        targets = {c.target for c in self.columns}
        for b in self.back_fill:
            if b.table not in schema:
                raise DeclarationRefused("enrich_unknown_table", b.table)
            if b.table not in joined | {self.class_table}:
                raise DeclarationRefused("enrich_no_join_path", b.table)
            for target in b.columns:
                if target not in targets:
                    raise DeclarationRefused("enrich_unresolved_column", f"{target} of {b.table} isn't a declared column")

    def may_back_fill(self, table: str, target: str) -> bool:
        return any(b.table == table and target in b.columns for b in self.back_fill)

    def pin(self) -> str:
        parts = [self.class_table, self.key_col]
        for c in self.columns:
            parts += [c.target, c.source, c.reducer or "as is"]
        for j in self.joins:
            parts += [j.table, j.key_col, j.via_table, j.via_col]
        for b in self.back_fill:
            parts += [b.table, *b.columns]
        return pin("ingest-pin-v1", parts)


def in_range(value: Column) -> Column:
    """A decimal as a long, null outside 64 bits."""
    return F.when((value >= F.lit(INT64_MIN)) & (value <= F.lit(INT64_MAX)), value).cast("long")


def reduced(reducer: str, value: Column, raw: Column, order: Sequence[Column]) -> Column:
    """A reducer's aggregate; ``first`` and ``last`` follow the declared order, never that of arrival."""
    if reducer in ("first", "last"):
        if not order:
            raise DeclarationRefused("enrich_no_order", reducer)
        return (F.min_by if reducer == "first" else F.max_by)(value, F.struct(*order))
    return {
        "sum": lambda: in_range(F.sum(value.cast("decimal(38,0)"))),
        "min": lambda: F.min(value),
        "max": lambda: F.max(value),
        "count": lambda: F.count(F.lit(1)),
        "distinct_count": lambda: F.count_distinct(raw.cast("string")),
    }[reducer]()


@dataclass
class Compiled:
    """A declaration as a DataFrame: the key, the targets, ``n_<side>`` rows that met, and ``refused``."""

    frame: DataFrame
    pin: str
    targets: tuple[str, ...] = field(default_factory=tuple)


def compile_ingest(ingest: IngestDef, tables: Mapping[str, DataFrame], to_long: Mapping[str, Callable[[Column], Column]] | None = None, order: Mapping[str, Sequence[str]] | None = None) -> Compiled:
    """``to_long`` converts a target's source column to a long; ``order`` names the order columns of a side table.

    A grain row without side rows has 0 and n 0. A sum outside 64 bits makes its target null and is named in
    ``refused`` (null: none). A key that side rows have and the grain lacks is left out.
    """
    ingest.validate({name: df.columns for name, df in tables.items()})
    to_long, order = to_long or {}, order or {}
    long_of = lambda c, ref: to_long.get(c.target, lambda x: x.cast("long"))(F.col(ref[1]))
    grain = tables[ingest.class_table]
    own = [c for c in ingest.columns if qualified(c.source)[0] == ingest.class_table]
    vias = {j.table: f"_via_{i}" for i, j in enumerate(ingest.joins)}
    frame = grain.select(
        F.col(ingest.key_col).alias(ingest.key_col),
        *[F.col(j.via_col).alias(vias[j.table]) for j in ingest.joins],
        *[long_of(c, qualified(c.source)).alias(c.target) for c in own],
    )
    refused = F.lit(None).cast("string")
    for j in ingest.joins:
        cols = [c for c in ingest.columns if qualified(c.source)[0] == j.table]
        by = [F.col(x) for x in order.get(j.table, ())]
        aggs = [reduced(c.reducer, long_of(c, qualified(c.source)), F.col(qualified(c.source)[1]), by).alias(c.target) for c in cols]
        side = tables[j.table].groupBy(F.col(j.key_col).alias(f"_key_{j.table}")).agg(F.count(F.lit(1)).alias(f"n_{j.table}"), *aggs)
        frame = frame.join(side, F.col(vias[j.table]) == F.col(f"_key_{j.table}"), "left").drop(f"_key_{j.table}", vias[j.table])
        n = F.coalesce(F.col(f"n_{j.table}"), F.lit(0))
        for c in cols:
            if c.reducer == "sum":
                refused = F.coalesce(refused, F.when((n > 0) & F.col(c.target).isNull(), F.lit(f"overflow:{c.target}")))
            frame = frame.withColumn(c.target, F.when(n > 0, F.col(c.target)).otherwise(F.lit(0).cast("long")))
        frame = frame.withColumn(f"n_{j.table}", n)
    return Compiled(frame.withColumn("refused", refused), ingest.pin(), tuple(c.target for c in ingest.columns))


def disagreements(one: DataFrame, other: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Keys at which two frames, made in different ways, differ or that only one of them has."""
    left = one.select(F.col(key).alias("k1"), *[F.col(c).alias(f"{c}_1") for c in columns])
    right = other.select(F.col(key).alias("k2"), *[F.col(c).alias(f"{c}_2") for c in columns])
    same = F.lit(True)
    for c in columns:
        same &= F.col(f"{c}_1").eqNullSafe(F.col(f"{c}_2"))
    return left.join(right, F.col("k1") == F.col("k2"), "full").where(F.col("k1").isNull() | F.col("k2").isNull() | ~same).select(F.coalesce("k1", "k2").alias(key))


#: Ranges of values that places are counted in; one row for each is windowed whole.
RANGES = 4096


def nearest_rank(df: DataFrame, value: str, percents: Sequence[float]) -> DataFrame:
    """percent, value: the element at place floor(p (n - 1) + 0.5) of the sorted values (longs).

    Values are counted, and the counts added up inside ranges of values; where a range begins follows from one
    row for each range. So no task sees all values.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    low, high, total = counts.agg(F.min("_v"), F.max("_v"), F.sum("_n")).first()
    spark = df.sparkSession
    wanted = spark.createDataFrame([(float(p), int(p * (total - 1) + 0.5)) for p in percents] if total else [], "percent double, place long")
    width = (high - low) // RANGES + 1 if total else 1
    ranged = counts.withColumn("_range", F.call_function("div", F.col("_v") - F.lit(low or 0), F.lit(width)))
    starts = ranged.groupBy("_range").agg(F.sum("_n").alias("_all"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("_range", F.coalesce(F.sum("_all").over(before), F.lit(0)).alias("_start"), "_all")
    # As many rows as there are percents, and each meets one range.
    hit = starts.join(F.broadcast(wanted), (F.col("place") >= F.col("_start")) & (F.col("place") < F.col("_start") + F.col("_all")))
    inside = Window.partitionBy("_range").orderBy("_v")
    placed = ranged.withColumn("_upto", F.sum("_n").over(inside))
    found = placed.join(F.broadcast(hit), "_range").withColumn("_end", F.col("_start") + F.col("_upto"))
    return found.where((F.col("place") < F.col("_end")) & (F.col("place") >= F.col("_end") - F.col("_n"))).select("percent", F.col("_v").alias("value"))
