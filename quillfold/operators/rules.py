"""Declared classes: reversibility rules, checks, caps, and pins over all of it."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillfold.functions.expr import Program, compile_text
from quillfold.functions.hashing import pin
from quillfold.schema import CONSTRAINT_COLUMNS

# Fixed values, in order of their numbers.
REVERSIBILITY = ("reversible_by_inverse", "reversible_within", "irreversible")
DEFAULT = "irreversible"


@dataclass(frozen=True)
class RevRule:
    table: str
    op: str
    reversibility: str = DEFAULT
    window_ns: int = 0

    @property
    def score(self) -> int:
        return 2 * (self.table != "*") + (self.op != "*")

    def fits(self, table: str, op: str) -> bool:
        return self.table in ("*", table) and self.op in ("*", op)


@dataclass(frozen=True)
class Check:
    id: str
    program: Program


@dataclass(frozen=True)
class ClassDef:
    cls: int
    name: str
    rules: tuple[RevRule, ...] = ()
    checks: tuple[Check, ...] = ()
    cap_minor_per_period: int = -1
    quorum_m: int = 0
    quorum_n: int = 0
    flags: int = 0

    @staticmethod
    def of(cls: int, name: str, checks: dict[str, str] | None = None, **more) -> ClassDef:
        """Compiles the checks; a text that doesn't compile raises."""
        return ClassDef(cls, name, checks=tuple(Check(k, compile_text(v)) for k, v in (checks or {}).items()), **more)

    def by_precedence(self) -> list[RevRule]:
        """The most specific first; of equal ones the first listed."""
        return [r for _, r in sorted(enumerate(self.rules), key=lambda x: (-x[1].score, x[0]))]

    def reversibility_of(self, table: str, op: str) -> str:
        return next((r.reversibility for r in self.by_precedence() if r.fits(table, op)), DEFAULT)

    def reversibility_column(self, table: Column, op: Column) -> Column:
        """The same as a CASE over the rules in order of precedence: no join, no shuffle."""
        out = F.lit(DEFAULT)
        for r in reversed(self.by_precedence()):
            fits = (F.lit(True) if r.table == "*" else table == r.table) & (F.lit(True) if r.op == "*" else op == r.op)
            out = F.when(fits, F.lit(r.reversibility)).otherwise(out)
        return out

    def pin(self) -> str:
        parts: list[str | int] = [self.cls, self.name, self.flags, self.cap_minor_per_period, self.quorum_n, self.quorum_m, len(self.rules)]
        for r in self.rules:
            parts += [r.table, r.op, REVERSIBILITY.index(r.reversibility), r.window_ns]
        parts.append(len(self.checks))
        for c in self.checks:
            parts += [c.id, c.program.program_hash]
        return pin("class-pin-v1", parts)


@dataclass
class ClassMap:
    classes: dict[int, ClassDef] = field(default_factory=dict)

    def add(self, definition: ClassDef) -> ClassMap:
        if definition.cls in self.classes:
            raise ValueError("duplicate class id")
        self.classes[definition.cls] = definition
        return self

    def pin(self) -> str:
        return pin("map-pin-v1", [len(self.classes), *(c.pin() for c in self.classes.values())])

    def by_class(self, cls: Column, of, default: Column) -> Column:
        """A CASE over the classes; a class map is a declaration of bounded size."""
        out = default
        for c in self.classes.values():
            out = F.when(cls == c.cls, of(c)).otherwise(out)
        return out

    def known(self, cls: Column) -> Column:
        return cls.isin(*self.classes) if self.classes else F.lit(False)

    def reversibility(self, cls: Column, table: Column, op: Column) -> Column:
        return self.by_class(cls, lambda c: c.reversibility_column(table, op), F.lit(DEFAULT))

    def check_failure(self, cls: Column) -> Column:
        """The first failing check over the constraint columns: its id, or id:error; null if all hold."""

        def of(c: ClassDef) -> Column:
            out = F.lit(None).cast("string")
            for check in reversed(c.checks):
                value, error = check.program.columns()
                out = F.when(error.isNotNull(), F.concat(F.lit(f"{check.id}:"), error)).when(~value, F.lit(check.id)).otherwise(out)
            return out

        return self.by_class(cls, of, F.lit(None).cast("string"))

    def cap(self, cls: Column) -> Column:
        return self.by_class(cls, lambda c: F.lit(c.cap_minor_per_period).cast("long"), F.lit(-1).cast("long"))

    def class_name(self, cls: Column) -> Column:
        return self.by_class(cls, lambda c: F.lit(c.name), F.lit(None).cast("string"))


def constraint_row(**columns: Column) -> list[Column]:
    """The columns that checks may read, 0 where not given."""
    return [columns.get(name, F.lit(0)).cast("long").alias(name) for name in CONSTRAINT_COLUMNS]
