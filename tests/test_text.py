import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fleetgauge.functions import text
from fleetgauge.functions.syntax import error_class, syntax_error


def run(spark, values, column, extra=None):
    """Applies a column expression to texts, keeping their order."""
    data = [(i, v, (extra or [None] * len(values))[i]) for i, v in enumerate(values)]
    df = spark.createDataFrame(data, "i int, x string, e string")
    return [r.y for r in df.select("i", column.alias("y")).orderBy("i").collect()]


X, E = F.col("x"), F.col("e")


def test_fences_and_prefaces(spark):
    got = run(
        spark,
        ["```python\nx\n```", "```PYTHON x```", "```\nx\n```\n", "x", " \u00a0x\u3000\n", "```python"],
        text.strip_fences(X),
    )
    assert got == ["x", "x", "x", "x", "x", ""]
    got = run(
        spark,
        ["Here is: x", "here's the", "The  function.y", "Implementation:\nz", "There is", "The implementation q"],
        text.strip_preface(X),
    )
    assert got == ["x", "the", "y", "z", "There is", "q"]


def test_body_after_def(spark):
    values = ["import a\ndef f(x,\n  y):\n    return 1", "def g():\n  pass", "def f(x): return x"]
    assert run(spark, values, text.body_after_def(X, E), ["f", "f", "f"]) == [
        "    return 1",
        "def g():\n  pass",
        "(x): return x",
    ]
    assert run(spark, values[:1], text.body_after_def(X, E, compat=True), ["f"]) == [
        "(x,\n  y):\n    return 1"
    ]
    assert run(spark, ["def (x):\n y"], text.body_after_def(X, E), [""]) == ["def (x):\n y"]


def docstring_lines(value):
    """Line by line: a triple quote at the front toggles, unless the line closes itself."""
    kept, inside = [], False
    for line in value.split("\n"):
        front = line.strip()
        if front[:3] in ('"""', "'''"):
            whole = front.count('"""') == 2 or front.count("'''") == 2
            inside = not inside and not whole
        elif not inside:
            kept.append(line)
    return kept


def random_docs(count, seed):
    rng = random.Random(seed)
    parts = ['"""', "'''", "x = 1", '    """one"""', "  '''one'''", '"""a', "b'''", "", "   ", 'y """ z', "\t'''", '"""""" """', "\u2028q", "a\rb"]
    return ["\n".join(rng.choice(parts) for _ in range(rng.randrange(1, 9))) for _ in range(count)]


def test_docstrings_against_line_machine(spark):
    values = random_docs(1500, 1)
    got = run(spark, values, text.drop_docstrings(X))
    for value, result in zip(values, got):
        # Removing the last line also removes the line break before it; compare what remains.
        assert [l for l in result.split("\n") if l.strip()] == [
            l for l in docstring_lines(value) if l.strip()
        ], repr(value)


def test_long_texts_do_not_overflow(spark):
    many = "\n" * 60000 + "x"
    values = [
        '"""' + "a" * 200000,
        "'''\n" + "line\n" * 60000,
        many,
        "def f(" + "a, " * 60000,
        ('"""' + "b" * 9 + '"""\n') * 20000,
        " " * 100000 + "z\n" * 3,
    ]
    for column in (
        text.extract_completion(X, E),
        text.drop_docstrings(X),
        text.cut_explanation(X),
        text.sanitize_completion(X),
    ):
        assert len(run(spark, values, column, ["f"] * len(values))) == len(values)


def test_statements_and_explanations(spark):
    values = ["import os\n  from a import b\nx = 1\nclass A:\ny = important", "def a():\nz"]
    assert run(spark, values, text.drop_leading_statements(X)) == ["x = 1\ny = important", "z"]
    values = ["items = []\nreturn items\nThis is it", "x\n  ```\ny", "It", "Notes = 1", "a\n note: b", "thé = 1"]
    assert run(spark, values, text.cut_explanation(X)) == [
        "items = []\nreturn items",
        "x",
        "",
        "Notes = 1",
        "a",
        "thé = 1",
    ]
    assert run(spark, values, text.cut_explanation(X, compat=True)) == ["", "x", "", "", "a", "thé = 1"]


def test_indentation(spark):
    values = ["if a:\n    b\n\nc", "        if a:\n            b", "x", "\n\n"]
    assert run(spark, values, text.reindent(X)) == [
        "    if a:\n        b\n    c",
        "    if a:\n        b",
        "    x",
        "",
    ]
    assert run(spark, ["    a\n\n      b\n   "], text.dedent(X)) == ["a\n\n  b\n"]


def test_extract_keeps_nesting(spark):
    answer = (
        "Here is:\n```python\nimport math\ndef f(a,\n      b):\n    '''\n    Doc.\n    '''\n"
        "    for x in a:\n        if x:\n            return b\n    items = []\n    return items\n```"
    )
    body = "    for x in a:\n        if x:\n            return b\n    items = []\n    return items"
    # The fence is not at the very start here, so the inner one stays; it is cut as a fence line.
    fenced = answer.replace("Here is:\n", "")
    assert run(spark, [fenced], text.extract_completion(X, E), ["f"]) == [body]
    assert run(spark, [answer], text.extract_completion(X, E), ["f"]) == [body]
    assert run(spark, ["", None, "```python\n```", "This is prose."], text.extract_completion(X, E)) == ["", "", "", ""]
    compat = run(spark, ["def f(x):\n    return x"], text.extract_completion(X, E, compat=True), ["f"])
    assert compat == ["    (x):\n        return x"]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["x = 1", "if x:", "    y = 2", "        z()", "return x"]), min_size=1, max_size=6), min_size=1, max_size=20))
def test_extraction_is_idempotent_on_clean_bodies(spark, bodies):
    values = ["\n".join(lines) for lines in bodies]
    once = run(spark, values, text.extract_completion(X, E))
    assert run(spark, once, text.reindent(X)) == once
    assert run(spark, once, text.sanitize_completion(X)) == [
        v if len(v.strip()) >= 5 else "    pass" for v in once
    ]


def test_sanitize(spark):
    from fleetgauge.fixed_values import ERROR_MARKERS

    values = ["if a:\n    b = 1", "", None, "x=1", *[f"boom {m} boom" for m in ERROR_MARKERS], "    keep\n      me"]
    got = run(spark, values, text.sanitize_completion(X))
    assert got[0] == "    if a:\n        b = 1"
    assert got[1:10] == ["    pass"] * 9
    assert got[10] == "    keep\n      me"
    flat = run(spark, values[:1], text.sanitize_completion(X, compat=True))
    assert flat == ["    if a:\n    b = 1"]
    assert run(spark, ["123456789", "1234567890", None], text.long_enough(X)) == [False, True, False]


@pytest.mark.parametrize(
    "code,kind",
    [
        ("    if x:\n        return 1\n    return 2", "valid"),
        ("return 1\nreturn 2", "valid"),
        ("def f():\n    return 1", "valid"),
        ("\n\n        a = 1\n        if a:\n            b = 2", "valid"),
        ("", "empty"),
        (None, "empty"),
        ("  \n ", "empty"),
        ("x = (1,", "SyntaxError: '(' was never closed"),
        ("    x = 1\n      y = 2", "SyntaxError: unexpected indent"),
        ("a\x00b", "SyntaxError: source code string cannot contain null bytes"),
    ],
)
def test_syntax_classes(spark, code, kind):
    assert run(spark, [code], error_class(syntax_error(X))) == [kind]


def test_syntax_error_names_the_completions_own_line(spark):
    assert run(spark, ["x = 1\ny = = 2"], syntax_error(X)) == ["SyntaxError: invalid syntax on line 2 (y = = 2)"]
    deep = "(" * 5000 + ")" * 5000
    assert run(spark, [deep], syntax_error(X))[0] is not None


def test_prevalidated_rows_are_flagged_not_dropped(spark):
    from fleetgauge.operators import evaluation as ev

    data = [
        ("a", "if x:\n    return 1\n\nreturn 2"),
        ("b", "    def f():\n        return 1"),
        ("c", "x = ("),
        ("d", "\n\n  y = 1\n    \n  return y\n"),
    ]
    df = spark.createDataFrame(data, "task_id string, completion string")
    got = {r.task_id: r for r in ev.prevalidate(df).collect()}
    assert got["a"].completion == "    if x:\n        return 1\n\n    return 2"
    assert got["b"].completion == "def f():\n    return 1"
    assert (got["c"].completion, got["c"].passed, got["c"].result, got["c"].syntax_error) == ("x = (", False, "syntax_error", "syntax_error")
    assert got["d"].completion == "    y = 1\n\n    return y"
    assert (got["d"].passed, got["d"].result) == (None, None)
