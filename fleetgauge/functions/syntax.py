"""Syntax class of completions, judged by CPython's own parser.

This is the one place Python runs per text. It is a map over Arrow batches: nothing is shuffled,
so copies of one text cannot pile up in a task, and repeats inside a batch are parsed once. The
parser's findings come back as fields; their wording is made of Spark expressions.
"""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from fleetgauge.functions.numbers import let
from fleetgauge.functions.whitespace import strip

EMPTY_ERROR = "Empty completion"
_FINDING = T.StructType(
    [
        T.StructField("parsed", T.BooleanType()),
        T.StructField("message", T.StringType()),
        T.StructField("line", T.IntegerType()),
        T.StructField("source", T.StringType()),
    ]
)
_SEPARATE = "def "
_OPENING = "def _completion():"


@pandas_udf(_FINDING)
def _findings(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Per text: whether it parses, and what, where and in which source line it does not."""
    import ast
    import textwrap
    import warnings

    def finding(code: str) -> tuple:
        try:
            ast.parse(code)
        except SyntaxError as found:
            return True, found.msg, found.lineno, found.text
        except Exception as found:  # null bytes, nesting too deep for the parser
            return False, str(found), None, None
        return True, None, None, None

    warnings.simplefilter("ignore")
    for texts in batches:
        found = {}
        for text in set(texts.dropna()):
            # Dedenting before any stripping keeps the first line's nesting.
            body = textwrap.dedent(text.rstrip()).lstrip("\n")
            if not body.startswith(_SEPARATE):
                body = _OPENING + "\n" + textwrap.indent(body, "    ")
            found[text] = finding(body)
        none = (None, None, None, None)
        rows = pd.DataFrame([found.get(x, none) for x in texts], columns=["parsed", "message", "line", "source"])
        yield rows.astype({"parsed": object, "message": object, "line": "Int32", "source": object})


def _wording(found: Column, alone: Column) -> Column:
    """The finding as text. Lines count from the completion's own first line, after the opening."""
    shift = F.when(alone | (found["line"] == 1), F.lit(0)).otherwise(F.lit(1))
    line = F.when(found["line"] > 0, F.concat(F.lit(" on line "), (found["line"] - shift).cast("string")))
    source = F.nullif(found["source"], F.lit(""))
    shown = F.when(source.isNotNull(), F.concat(F.lit(" ("), strip(source), F.lit(")")))
    nothing = F.lit("")
    wrong = F.concat(
        F.lit("SyntaxError: "), found["message"], F.coalesce(line, nothing), F.coalesce(shown, nothing)
    )
    failed = F.concat(F.lit("Parse error: "), found["message"])
    return F.when(found["message"].isNull(), F.lit(None)).when(found["parsed"], wrong).otherwise(failed)


def syntax_error(x: Column) -> Column:
    """Null for valid code, else the reason.

    A completion that starts with ``def`` stands alone; any other is a function body and is
    wrapped in one, so line numbers count from the completion's own first line.
    """
    blank = F.coalesce(strip(x), F.lit("")) == ""
    alone = F.coalesce(strip(x).startswith(_SEPARATE), F.lit(False))
    wording = let(_findings(F.when(~blank, x)), lambda found: _wording(found, alone))
    return F.when(blank, F.lit(EMPTY_ERROR)).otherwise(wording)


def error_class(error: Column) -> Column:
    """``empty``, ``valid`` or the parser message without line number and source text."""
    bare = F.regexp_replace(error, r" on line [0-9]+[\s\S]*\z", "")
    return (
        F.when(error.isNull(), F.lit("valid"))
        .when(error == EMPTY_ERROR, F.lit("empty"))
        .otherwise(bare)
    )
