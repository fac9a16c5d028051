"""What counts as whitespace: the characters Python's ``str.strip`` and ``split`` use."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same set as regular-expression classes. The characters below 256 are listed one by one and
# the others sit behind one range test, which keeps matching ordinary text fast.
_LOW = r" \t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0"
_HIGH = r"[\x{1680}-\x{3000}&&[\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]]"
WS_CLASS = rf"[\n{_LOW}{_HIGH}]"
WS_INLINE_CLASS = rf"[{_LOW}{_HIGH}]"
NON_WS_CLASS = rf"[^\n{_LOW}{_HIGH}]"


def strip(x: Column) -> Column:
    return F.btrim(x, F.lit(WHITESPACE))


def lstrip(x: Column) -> Column:
    return F.ltrim(x, F.lit(WHITESPACE))


def rstrip(x: Column) -> Column:
    return F.rtrim(x, F.lit(WHITESPACE))
