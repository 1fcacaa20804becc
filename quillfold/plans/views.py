"""SQL over a ledger as of a position, and the calls around it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillfold.functions.hashing import row_digest
from quillfold.operators import state, verify
from quillfold.schema import REFUSE_BODY
from quillfold.session import configure
from quillfold.sources.tape import read_strict

VIEWS = ("tape", "facts", "cells", "caps", "refusals", "ticks")


class Ledger:
    """Views of a scanned ledger; every fold is a function of its rows up to a position."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = configure(spark), folder

    def tape(self, pos: int | None = None) -> DataFrame:
        """Rows up to a position; one that can't be read is an error, but for a torn tail."""
        return read_strict(self.spark, self.folder, to_pos=pos, torn_tail=True)

    def frames(self, pos: int | None = None) -> dict[str, DataFrame]:
        tape = self.tape(pos)
        facts = state.replayed(state.delivered_once(state.facts_of(tape)))
        refusals = tape.where("k = 'refuse'").select("pos", "by", "cell", F.from_json("body", REFUSE_BODY).alias("r")).select("pos", "by", "cell", "r.*")
        return {"tape": tape, "facts": facts, "cells": state.cells_of(facts), "caps": state.caps_of(facts, state.last_cap_tick(tape)), "refusals": refusals, "ticks": tape.where("k = 'tick'")}

    def query(self, sql: str, as_of_pos: int | None = None) -> DataFrame:
        """A SELECT over the views."""
        return self.spark.sql(sql, **self.frames(as_of_pos)) if "{" in sql else self._named(sql, as_of_pos)

    def _named(self, sql: str, pos: int | None) -> DataFrame:
        for name, frame in self.frames(pos).items():
            frame.createOrReplaceTempView(name)
        return self.spark.sql(sql)

    def schema(self) -> dict[str, str]:
        return {name: frame.schema.simpleString() for name, frame in self.frames().items()}

    def explain_refusal(self, pos: int) -> dict | None:
        row = self.frames()["refusals"].where(F.col("pos") == pos).first()
        return row.asDict() if row else None

    def health(self) -> dict:
        frames = self.frames()
        told = {r["reason"]: r["n"] for r in frames["refusals"].groupBy("reason").agg(F.sum("count").alias("n")).collect()}
        kinds = {r["k"]: r["n"] for r in verify.kinds(frames["tape"]).collect()}
        return {"kinds": kinds, "refusals": told, "unreadable_tx": state.unreadable_tx(frames["tape"]), "cells": frames["cells"].count()}

    def digest(self, pos: int | None = None) -> tuple[str, int]:
        """The identity of the cells, whatever their order."""
        cells = self.frames(pos)["cells"]
        return row_digest(cells, sorted(cells.columns))

    def verify_fold(self, cells: DataFrame, pos: int | None = None) -> bool:
        """Whether cells that were kept incrementally are those that replay gives."""
        return row_digest(cells, sorted(cells.columns)) == self.digest(pos)
