"""The constraint language: text to a tree, the tree to a Spark column.

Integers are 64-bit and checked, booleans are only made by comparisons; `&&` and `||` skip their right side
when the left decides, and an error on a side that is evaluated is the error of the whole. SQL's AND and OR
are not used: they would turn an error into a verdict. A compiled expression is two columns, the value (null on
error) and the error's name (null if none).

    or  := and ("||" and)*      and := cmp ("&&" cmp)*     cmp := add (op add)?
    add := mul (("+" | "-") mul)*     mul := un (("*" | "/" | "%") un)*     un := ("!" | "-") un | prim
    prim := INT | NAME | "(" or ")" | abs(or) | min(or, or) | max(or, or) | true | false
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillfold.functions.hashing import blake2b_hex
from quillfold.schema import CONSTRAINT_COLUMNS, INT64_MAX, INT64_MIN

OVERFLOW, DIVISION = "expr_overflow", "expr_div_by_zero"
MAX_DEPTH, MAX_STACK = 64, 120
#: Signs in a row; trees are walked by recursion.
MAX_SIGNS = 128
_TOKEN = re.compile(r"[ \t]*(?:(?P<int>[0-9]+)|(?P<name>[A-Za-z_][A-Za-z0-9_]*)|(?P<op>\|\||&&|==|!=|<=|>=|[-+*/%!<>(),]))")
_COMPARE = ("==", "!=", "<", "<=", ">", ">=")
_FUNCTIONS = {"abs": 1, "min": 2, "max": 2}


class CompileError(ValueError):
    """``reason`` and the offset in the text."""

    def __init__(self, reason: str, offset: int):
        super().__init__(f"{reason} at offset {offset}")
        self.reason, self.offset = reason, offset


@dataclass(frozen=True)
class Node:
    op: str
    args: tuple = ()

    @property
    def is_bool(self) -> bool:
        return self.op in _COMPARE or self.op in ("&&", "||", "!", "true", "false")


class _Parser:
    def __init__(self, text: str, names: tuple[str, ...]):
        self.text, self.names, self.at, self.depth = text, names, 0, 0

    def fail(self, reason: str):
        raise CompileError(reason, self.at)

    def peek(self):
        return _TOKEN.match(self.text, self.at)

    def take(self, *ops: str) -> str | None:
        m = self.peek()
        if m and m["op"] in ops:
            self.at = m.end()
            return m["op"]
        return None

    def typed(self, node: Node, boolean: bool) -> Node:
        if node.is_bool != boolean:
            self.fail("expr_type")
        return node

    def chain(self, below, ops: tuple[str, ...], boolean: bool) -> Node:
        node = below()
        while op := self.take(*ops):
            self.typed(node, boolean)
            node = Node(op, (node, self.typed(below(), boolean)))
        return node

    def either(self) -> Node:
        if self.depth > MAX_DEPTH:
            self.fail("expr_too_complex")
        self.depth += 1
        node = self.chain(lambda: self.chain(self.compared, ("&&",), True), ("||",), True)
        self.depth -= 1
        return node

    def compared(self) -> Node:
        node = self.sum()
        if op := self.take(*_COMPARE):
            self.typed(node, False)
            node = Node(op, (node, self.typed(self.sum(), False)))
        return node

    def sum(self) -> Node:
        return self.chain(lambda: self.chain(self.unary, ("*", "/", "%"), False), ("+", "-"), False)

    def unary(self) -> Node:
        signs = []
        while op := self.take("!", "-"):
            signs.append(op)
        if len(signs) > MAX_SIGNS:
            self.fail("expr_too_complex")
        node = self.primary()
        for op in reversed(signs):
            node = Node("!" if op == "!" else "neg", (self.typed(node, op == "!"),))
        return node

    def primary(self) -> Node:
        m = self.peek()
        if not m:
            self.fail("expr_parse")
        if m["int"]:
            digits = m["int"]
            if len(digits) > 1 and digits[0] == "0":
                self.fail("expr_parse")
            if int(digits) > INT64_MAX:
                self.fail(OVERFLOW)
            self.at = m.end()
            return Node("int", (int(digits),))
        if name := m["name"]:
            start, self.at = self.at, m.end()
            if name in ("true", "false"):
                return Node(name)
            if name in _FUNCTIONS and self.take("("):
                args = [self.typed(self.either(), False)]
                while self.take(","):
                    args.append(self.typed(self.either(), False))
                if len(args) != _FUNCTIONS[name] or not self.take(")"):
                    self.fail("expr_parse")
                return Node(name, tuple(args))
            if name not in self.names:
                self.at = start
                self.fail("expr_unknown_column")
            return Node("col", (name,))
        if self.take("("):
            node = self.either()
            if not self.take(")"):
                self.fail("expr_parse")
            return node
        self.fail("expr_parse")


def _stack(node: Node) -> int:
    """Values that are held at once when arguments are evaluated from the left."""
    inner = [x for x in node.args if isinstance(x, Node)]
    return max([1, *(i + _stack(x) for i, x in enumerate(inner))])


def _reads(node: Node) -> set[str]:
    return {node.args[0]} if node.op == "col" else set().union(*(_reads(x) for x in node.args if isinstance(x, Node)), set())


def _canonical(node: Node) -> str:
    return f"({node.op}" + "".join(" " + (_canonical(x) if isinstance(x, Node) else str(x)) for x in node.args) + ")"


def evaluate(node: Node, row: dict[str, int]) -> tuple[int | bool | None, str | None]:
    """The value and error for one row, in Python: the transactor's own evaluator."""
    op = node.op
    if op == "int":
        return node.args[0], None
    if op == "col":
        return row[node.args[0]], None
    if op in ("true", "false"):
        return op == "true", None
    left, error = evaluate(node.args[0], row)
    if error:
        return None, error
    if op == "&&" and not left or op == "||" and left:
        return left, None
    if op == "!":
        return not left, None
    if op in ("neg", "abs"):
        value = -left if op == "neg" or left < 0 else left
        return (value, None) if value <= INT64_MAX else (None, OVERFLOW)
    right, error = evaluate(node.args[1], row)
    if error:
        return None, error
    if op in ("&&", "||"):
        return right, None
    if op in _COMPARE:
        return {"==": left == right, "!=": left != right, "<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}[op], None
    if op in ("min", "max"):
        return (min if op == "min" else max)(left, right), None
    if op in ("/", "%"):
        if right == 0:
            return None, DIVISION
        quotient = abs(left) // abs(right) * (1 if (left < 0) == (right < 0) else -1)
        if quotient > INT64_MAX:
            return None, OVERFLOW
        return (quotient if op == "/" else left - quotient * right), None
    value = {"+": left + right, "-": left - right, "*": left * right}[op]
    return (value, None) if INT64_MIN <= value <= INT64_MAX else (None, OVERFLOW)


def _columns(node: Node) -> tuple[Column, Column]:
    none = F.lit(None).cast("string")
    op = node.op
    if op == "int":
        return F.lit(node.args[0]).cast("long"), none
    if op == "col":
        return F.col(node.args[0]).cast("long"), none
    if op in ("true", "false"):
        return F.lit(op == "true"), none
    left, left_error = _columns(node.args[0])
    if op == "!":
        return ~left, left_error
    if op in ("neg", "abs"):
        value = F.try_subtract(F.lit(0).cast("long"), left)
        value = value if op == "neg" else F.when(left < 0, value).otherwise(left)
        return value, F.when(left_error.isNotNull(), left_error).when(value.isNull(), F.lit(OVERFLOW))
    right, right_error = _columns(node.args[1])
    if op in ("&&", "||"):
        # An error leaves the left side null; the right one counts only if the left doesn't decide.
        decided = ~left if op == "&&" else left
        value = F.when(left.isNull(), F.lit(None).cast("boolean")).when(decided, left).otherwise(right)
        return value, F.when(left_error.isNotNull(), left_error).when(decided, none).otherwise(right_error)
    error = F.when(left_error.isNotNull(), left_error).when(right_error.isNotNull(), right_error)
    missing = left.isNull() | right.isNull()
    if op in _COMPARE:
        return {"==": left == right, "!=": left != right, "<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}[op], error
    if op in ("min", "max"):
        return F.when(missing, F.lit(None).cast("long")).otherwise((F.least if op == "min" else F.greatest)(left, right)), error
    if op in ("/", "%"):
        over = (left == INT64_MIN) & (right == -1)
        safe = F.when(missing | (right == 0) | over, F.lit(None).cast("long"))
        value = safe.otherwise(F.call_function("div", left, right) if op == "/" else left % right)
        return value, error.when(right == 0, F.lit(DIVISION)).when(over, F.lit(OVERFLOW))
    value = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op](left, right)
    return value, error.when(value.isNull(), F.lit(OVERFLOW))


@dataclass(frozen=True)
class Program:
    source: str
    tree: Node
    names: tuple[str, ...]

    @property
    def reads(self) -> set[str]:
        return _reads(self.tree)

    @property
    def program_hash(self) -> str:
        """Of meaning, not spelling: the tree and the bound names in order."""
        return blake2b_hex("\x1f".join(["constraint-v1", *self.names, _canonical(self.tree)]).encode())

    def columns(self) -> tuple[Column, Column]:
        """Value and error. The session must have ``session.configure``'s settings."""
        return _columns(self.tree)

    def evaluate(self, row: dict[str, int]) -> tuple[bool | None, str | None]:
        return evaluate(self.tree, row)


def compile_text(text: str, names: tuple[str, ...] = CONSTRAINT_COLUMNS) -> Program:
    parser = _Parser(text, names)
    tree = parser.either()
    if text[parser.at :].strip(" \t"):
        parser.fail("expr_parse")
    if not tree.is_bool:
        parser.fail("expr_not_bool")
    if _stack(tree) > MAX_STACK:
        parser.fail("expr_too_complex")
    return Program(text, tree, tuple(names))
