import random

import pytest

from quillfold.functions.expr import CompileError, Node, Program, compile_text, evaluate
from quillfold.schema import CONSTRAINT_COLUMNS, INT64_MAX, INT64_MIN

ROW = dict.fromkeys(CONSTRAINT_COLUMNS, 0) | {"amount_minor": 1500, "state": 2, "due_ns": 5000, "now_ns": 4000}


@pytest.mark.parametrize(
    ("text", "value"),
    [
        ("amount_minor == 1500", True), ("amount_minor % 7 == 2", True), ("-amount_minor < 0 && state != 3", True), ("!(state > 1)", False), ("min(state, 7) + max(1, 2) == 4", True),
        ("abs(-5) == 5", True), ("2 + 3 * 4 == 14", True), ("(2 + 3) * 4 == 20", True), ("due_ns - now_ns >= 1000", True), ("-7 / 2 == -3", True), ("-7 % 2 == -1", True), ("state == 0 || 1 / state == 0", True),
        ("!!true", True), ("!!(state == 3)", False), ("--1 == 1", True), ("- -1 == 1", True), ("---amount_minor < 0", True), ("!!!(state > 1) || 3 - --2 == 1", True), ("(" * 64 + "true" + ")" * 64, True),
    ],
)
def test_values(text, value):
    assert compile_text(text).evaluate(ROW) == (value, None)


@pytest.mark.parametrize(
    ("text", "reason"),
    [("state", "expr_not_bool"), ("nope == 1", "expr_unknown_column"), ("state == 1 == 2", "expr_parse"), ("state && true", "expr_type"), ("01 == 1", "expr_parse"), ("9223372036854775808 > 0", "expr_overflow"), ("(" * 70 + "true" + ")" * 70, "expr_too_complex"), ("(" * 65 + "true" + ")" * 65, "expr_too_complex"), ("!-1", "expr_type"), ("-!true", "expr_type"), ("!" * 500 + "true", "expr_too_complex"), ("true == true", "expr_type"), ("1.5 > 1", "expr_parse")],
)
def test_refused_texts(text, reason):
    with pytest.raises(CompileError) as e:
        compile_text(text)
    assert e.value.reason == reason


@pytest.mark.parametrize(
    ("text", "amount", "result"),
    [
        ("amount_minor + 1 > 0 || true", INT64_MAX, (None, "expr_overflow")), ("false && 1 / 0 == 1", 0, (False, None)), ("(1 + amount_minor) + -7 > 0", INT64_MAX, (None, "expr_overflow")),
        ("0 * (amount_minor * 2) == 0", INT64_MAX, (None, "expr_overflow")), ("amount_minor / -1 > 0", INT64_MIN, (None, "expr_overflow")), ("amount_minor % -1 == 0", INT64_MIN, (None, "expr_overflow")),
        ("abs(amount_minor) > 0", INT64_MIN, (None, "expr_overflow")), ("1 / amount_minor == 1", 0, (None, "expr_div_by_zero")),
    ],
)
def test_errors_win(spark, text, amount, result):
    program = compile_text(text)
    assert program.evaluate(ROW | {"amount_minor": amount}) == result
    frame = spark.createDataFrame([(amount,)], "amount_minor long")
    value, error = program.columns()
    assert tuple(frame.select(value, error).first()) == result


def test_hash_is_of_meaning():
    assert compile_text("state  ==1").program_hash == compile_text("state == 1").program_hash
    assert compile_text("state == 1").program_hash != compile_text("state == 2").program_hash
    assert compile_text("state == 1 && due_ns > 0").reads == {"state", "due_ns"}


def test_random_trees_agree_with_the_evaluator(spark):
    r = random.Random(5)
    names = CONSTRAINT_COLUMNS[:3]

    def number(d):
        k = r.random()
        if not d or k < 0.3:
            return Node("col", (r.choice(names),)) if r.random() < 0.6 else Node("int", (r.choice([0, 1, 7, INT64_MAX]),))
        if k < 0.4:
            return Node(r.choice(["neg", "abs"]), (number(d - 1),))
        return Node(r.choice(["+", "-", "*", "/", "%", "min", "max"]), (number(d - 1), number(d - 1)))

    def truth(d):
        k = r.random()
        if not d or k < 0.4:
            return Node(r.choice(["==", "!=", "<", "<=", ">", ">="]), (number(d), number(d)))
        return Node("!", (truth(d - 1),)) if k < 0.5 else Node(r.choice(["&&", "||"]), (truth(d - 1), truth(d - 1)))

    values = [0, 1, -1, -7, INT64_MAX, INT64_MIN, 100]
    rows = [tuple(r.choice(values) for _ in names) for _ in range(40)]
    frame = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "rid long, " + ", ".join(f"{n} long" for n in names))
    trees = [truth(3) for _ in range(12)]
    columns = [c for i, t in enumerate(trees) for c in (Program("", t, names).columns()[0].alias(f"v{i}"), Program("", t, names).columns()[1].alias(f"e{i}"))]
    for row in frame.select("rid", *columns).collect():
        for i, tree in enumerate(trees):
            assert evaluate(tree, dict(zip(names, rows[row.rid], strict=True))) == (row[f"v{i}"], row[f"e{i}"])


def spelled(node, r):
    """The tree as text, with more parentheses than it needs and spaces anywhere."""
    space = " " * r.randrange(2)
    if node.op in ("int", "col"):
        return space + str(node.args[0])
    inner = [spelled(x, r) for x in node.args]
    if node.op in ("abs", "min", "max"):
        return f"{space}{node.op}({','.join(inner)})"
    if node.op in ("!", "neg"):
        return f"{space}{'!' if node.op == '!' else '-'}" + (inner[0] if node.args[0].op in ("!", "neg") else f"({inner[0]})")
    return f"{space}({inner[0]}{space}{node.op}{space}{inner[1]})"


def test_random_texts_are_read_back():
    r = random.Random(6)

    def number(d):
        k = r.random()
        if not d or k < 0.2:
            return Node("col", ("state",)) if k < 0.1 else Node("int", (r.choice([0, 1, 7, INT64_MAX]),))
        if k < 0.5:
            return Node(r.choice(["neg", "neg", "abs"]), (number(d - 1),))
        return Node(r.choice(["+", "-", "*", "/", "%", "min", "max"]), (number(d - 1), number(d - 1)))

    def truth(d):
        if not d:
            return Node(r.choice(["==", "<", ">="]), (number(2), number(2)))
        return Node("!", (truth(d - 1),)) if r.random() < 0.5 else Node(r.choice(["&&", "||"]), (truth(d - 1), truth(d - 1)))

    for _ in range(200):
        tree = truth(r.randrange(6))
        assert compile_text(spelled(tree, r)).tree == tree
