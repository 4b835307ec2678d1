"""Tokens and expressions against known cases and against Python's own arithmetic."""

import operator
import random

import pytest

from lodestack.operators import source


@pytest.mark.parametrize(
    "line,want",
    [
        ("Press.Any.Key", ["Press.Any.Key"]), ("Disk(N).Sectors", ["Disk", "(", "N", ")", ".", "Sectors"]), ("X = 1 ' a: b", ["X", "=", "1", "'", " a: b"]),
        ("REM $DYNAMIC", ["REM", " $DYNAMIC"]), ("a: rem x", ["a", ":", "REM", " x"]), ("REMARK = 1", ["REMARK", "=", "1"]), ('DATA "a:b", $2: X', ["DATA", ' "a:b", $2', ":", "X"]),
        ('PRINT "open', ["PRINT", "open"]), ("1E5+&HFF&", ["1E5", "+", "&HFF&"]), (".5<=A", [".5", "<=", "A"]), ("", []), ("  \t", []), ("DATA", ["DATA", ""]),
    ],
)
def test_tokens(line, want):
    assert [t[1] for t in source.lex(line)[:-1]] == want


@pytest.mark.parametrize("line", ["X = {", "&", "a $ b", "@"])
def test_what_is_no_token(line):
    with pytest.raises(ValueError, match="column"):
        source.lex(line)


@pytest.mark.parametrize(
    "text,want",
    [
        ("-X ^ 2", "LOAD X,PUSH 2,POWER,NEGATE"), ("2 ^ -3 ^ 2", "PUSH 2,PUSH 3,PUSH 2,POWER,NEGATE,POWER"), ("(2)", "PUSH 2,PAREN"), ("A MOD B \\ 2", "LOAD A,LOAD B,PUSH 2,IDIVIDE,MOD"),
        ("NOT a AND b", "LOAD a,NOT,LOAD b,AND"), ("F%(1, x$).y", "PUSH 1,LOAD$ x,ARRAY% 2 F,FIELD y"), ('LEN("a") >= 1', 'PUSH_STR "a",LEN,PUSH 1,GE'), ("1 - 2 - 3", "PUSH 1,PUSH 2,SUBTRACT,PUSH 3,SUBTRACT"),
    ],
)
def test_expressions(text, want):
    assert ",".join(source.reverse_polish(text)) == want


def test_arithmetic_agrees_with_python():
    rng, does = random.Random(3), {"ADD": operator.add, "SUBTRACT": operator.sub, "MULTIPLY": operator.mul}

    def grow(depth):
        if not depth or rng.random() < 0.2:
            return str(rng.randrange(10))
        pick = rng.random()
        return f"({grow(depth - 1)})" if pick < 0.2 else f"-{grow(depth - 1)}" if pick < 0.3 else f"{grow(depth - 1)} {rng.choice('+-*')} {grow(depth - 1)}"

    for text in (grow(6) for _ in range(300)):
        stack = []
        for word in source.reverse_polish(text):
            if word.startswith("PUSH"):
                stack.append(int(word[5:]))
            elif word == "NEGATE":
                stack.append(-stack.pop())
            elif word != "PAREN":
                b, a = stack.pop(), stack.pop()
                stack.append(does[word](a, b))
        assert stack == [eval(text)], text


@pytest.mark.parametrize("text", ["", "1 +", "(1", "1 2", "* 1", "f(1"])
def test_what_is_no_expression(text):
    with pytest.raises(ValueError):
        source.reverse_polish(text)


def test_frames(spark):
    lines = spark.createDataFrame([(1, "A% = 70000"), (2, "{"), (3, None)], "n int, line string")
    rows = {r.n: r for r in source.lex_lines(lines).collect()}
    assert rows[2].tokens is None and "column 0" in rows[2].error and rows[3].tokens is None and rows[3].error is None
    tokens = source.token_rows(source.lex_lines(lines), "n").orderBy("token_no").collect()
    assert [(t.kind, t.text, t.suffix, t.numtype) for t in tokens] == [("NAME", "A", "%", None), ("OP", "=", "", None), ("NUMBER", "70000", "", "long"), ("END", "", "", None)]
    found = {r.n: r.words for r in source.parse_expressions(lines, "line").collect()}
    assert found[1] == ["LOAD% A", "PUSH 70000", "EQ"] and found[2] is None


@pytest.mark.parametrize("read", ["lex_lines", "parse_expressions", "record_variables"])
def test_one_partition_is_dealt_to_all_cores(spark, read):
    """A small table comes in one piece, and Python takes long over it."""
    rows = spark.createDataFrame([("a", "DIM X AS T", "1 + X")] * 100, "path string, line string, expression string").coalesce(1)
    plan = getattr(source, read)(rows)._jdf.queryExecution().executedPlan().toString()
    assert "RoundRobinPartitioning" in plan.split("EvalPython")[-1]


def test_tokens_of_null_and_bad_lines_together(spark):
    lines = spark.createDataFrame([(0, None), (1, "A$ = 1"), (2, "X = @"), (3, "")], "n int, line string").coalesce(1)
    found = {r.n: (None if r.tokens is None else [tuple(t) for t in r.tokens], r.error is None) for r in source.lex_lines(lines).collect()}
    assert found == {0: (None, True), 1: ([("NAME", "A", "$", 0), ("OP", "=", "", 3), ("NUMBER", "1", "", 5), ("END", "", "", 6)], True), 2: (None, False), 3: ([("END", "", "", 0)], True)}


def test_record_variables(spark):
    lines = spark.createDataFrame([("a", "TYPE Disk"), ("a", "DIM d(10) AS DISK, e AS INTEGER"), ("a", "SUB s (x AS Disk)"), ("b", "DIM d AS Disk"), ("b", None)], "path string, line string")
    assert {(r.path, r.name) for r in source.record_variables(lines).collect()} == {("a", "d"), ("a", "x")}


def test_differences(spark):
    rows = spark.createDataFrame([("a", "x\r\ny\r\n", "x\ny"), ("b", "x", "z"), ("c", None, None), ("d", "", "\n"), ("e", "x\x85", "x")], "path string, before string, after string")
    changed = {r.path: r.c for r in rows.select("path", source.would_change(rows.before, rows.after).alias("c")).collect()}
    assert changed == {"a": False, "b": True, "c": False, "d": True, "e": False}
    diffs = {r.path: r["diff"] for r in source.fmt_diff(rows).collect()}
    assert diffs["a"] == "" and diffs["b"].endswith("-x\n+z") and diffs["c"] == ""


def test_later_words(spark):
    lines = spark.createDataFrame(
        [("a", "defcur a-z"), ("a", "x AS  Currency"), ("b", "' DEFCUR"), ("b", 'PRINT "AS CURRENCY"'), ("b", "rem DEFCUR"), ("c", "TYPE CURRENCY"), ("c", "DIM x AS CURRENCY"), ("d", None), ("d", "My.DEFCUR = 1")],
        "path string, line string",
    )
    assert {(r.path, r.word) for r in source.pds_words(lines).collect()} == {("a", "DEFCUR"), ("a", "AS CURRENCY")}
