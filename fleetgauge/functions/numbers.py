"""Small numeric and parsing expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetgauge.fixed_values import MIN_SECONDS
from fleetgauge.functions.whitespace import WS_CLASS, strip

_TWO_62 = 4611686018427387904


def divide_or(numerator: Column, denominator: Column, default: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(numerator, denominator), F.lit(default))


def throughput(count: Column, seconds: Column, min_seconds: float = MIN_SECONDS) -> Column:
    """Items per second with a floor on the elapsed time."""
    return count / F.greatest(F.coalesce(seconds, F.lit(0.0)), F.lit(min_seconds))


def used_percent(used: Column, total: Column, when_empty: float = 0.0) -> Column:
    return F.when(total > 0, used / total * 100.0).otherwise(F.lit(when_empty))


def utilisation(used: Column, total: Column) -> Column:
    """Share of memory in use; a device that reports no memory counts as full."""
    return F.when(total > 0, used / total).otherwise(F.lit(1.0))


def clean_number(text: Column) -> Column:
    """``1,234`` and ``12.5%`` as doubles; anything else null."""
    bare = F.rtrim(F.replace(text, F.lit(","), F.lit("")), F.lit("%"))
    return F.when(text.rlike(r"^[-.,0-9]+%*$"), bare.try_cast("double"))


def first_number(line: Column) -> Column:
    return F.regexp_extract(line, r"([0-9]+\.?[0-9]*)", 1).try_cast("double")


def bucket_range(text: Column) -> tuple[Column, Column]:
    """Bounds of ``lo -> hi`` or ``lo-hi``; a single number is its own range."""
    low = F.regexp_extract(text, r"^\s*([0-9]+)", 1).try_cast("double")
    high = F.regexp_extract(text, r"^\s*[0-9]+\s*(?:->|-)\s*([0-9]+)\s*$", 1).try_cast("double")
    return low, F.coalesce(high, low)


def bucket_midpoint(text: Column) -> Column:
    low, high = bucket_range(text)
    return (low + high) / 2.0


def tokens(line: Column) -> Column:
    """Whitespace-separated words of a line, without empty ones."""
    return F.array_remove(F.split(strip(line), f"{WS_CLASS}+"), "")


def rest_of(words: Column, start: int) -> Column:
    """Words from 1-based position ``start`` on, joined by single spaces."""
    return F.array_join(F.slice(words, start, F.greatest(F.size(words), F.lit(1))), " ")


def pass_at_k(n: Column, c: Column, k: int) -> Column:
    """Unbiased estimate that one of ``k`` draws from ``n`` samples, ``c`` correct, passes.

    The chance that all draws miss is a product of ``k`` ratios, so the work per task does not
    grow with its number of samples.
    """
    all_miss = F.aggregate(
        F.sequence(F.lit(0), F.lit(k - 1)),
        F.lit(1.0),
        lambda acc, j: acc * ((n - c - j) / (n - j)),
    )
    return F.when(n - c < k, F.lit(1.0)).otherwise(F.lit(1.0) - all_miss)


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _exact_point(x: Column, digits: int | Column) -> Column:
    """The fraction is scaled to an integer (exact for doubles) and rounded as a decimal."""
    places = F.lit(digits) if isinstance(digits, int) else digits
    powers = F.array(*[F.lit(10**i).cast("bigint") for i in range(7)])
    two62 = F.lit(_TWO_62).cast("decimal(20,0)")
    half = F.lit(_TWO_62 // 2).cast("decimal(20,0)")

    def scaled(v: Column) -> Column:
        fraction = ((v["size"] - F.floor(v["size"])) * float(_TWO_62)).cast("bigint")
        product = fraction.cast("decimal(20,0)") * v["scale"].cast("decimal(8,0)")
        return let(product, lambda p: rounded(v, p))

    def rounded(v: Column, p: Column) -> Column:
        part = ((p - p % two62) / two62).cast("bigint")
        # The last kept digit is the fraction's, or the whole number's without decimals.
        last = F.when(v["places"] == 0, F.floor(v["size"])).otherwise(part)
        up = (p % two62 > half) | ((p % two62 == half) & (last % 2 == 1))
        # A decimal, as the units of a large number are more than a long holds.
        whole = F.floor(v["size"]).cast("decimal(16,0)") * v["scale"].cast("decimal(7,0)")
        units = whole + part.cast("decimal(20,0)") + F.when(up, 1).otherwise(0)
        return let(units.cast("decimal(38,0)"), lambda u: text(v, u))

    def text(v: Column, u: Column) -> Column:
        whole = F.floor(u / v["scale"].cast("decimal(7,0)")).cast("string")
        tail = F.lpad((u % v["scale"]).cast("string"), v["places"], F.lit("0"))
        decimals = F.when(v["places"] == 0, F.lit("")).otherwise(F.concat(F.lit("."), tail))
        return F.concat(F.when(v["minus"], F.lit("-")).otherwise(F.lit("")), whole, decimals)

    parts = F.struct(
        F.abs(x).alias("size"),
        (x < 0).alias("minus"),
        places.cast("int").alias("places"),
        F.element_at(powers, places.cast("int") + 1).alias("scale"),
    )
    return let(parts, scaled)


def fixed_point(x: Column, digits: int | Column) -> Column:
    """Text of ``x`` with ``digits`` (0 to 6) decimals, rounding the binary value half to even.

    ``format_string`` rounds the shortest decimal rendering half up, so 2.675 and 0.125 would
    differ from logs written by C or Python formatting. The two can only disagree when that
    rendering is itself a tie (one digit more than asked, and a 5); those rare values, and ones
    in exponent notation, take the exact route. From 2**53 on doubles have no fraction.
    """
    plain = x.cast("string")
    places = F.lit(digits) if isinstance(digits, int) else digits
    doubtful = (F.abs(x) < float(1 << 53)) & (
        plain.contains("E")
        | (plain.endswith("5") & (F.length(F.substring_index(plain, ".", -1)) == places + 1))
    )
    choices = [digits] if isinstance(digits, int) else range(7)
    quick = F.lit(None).cast("string")
    for d in choices:
        text = F.format_string(f"%.{d}f", x)
        quick = text if isinstance(digits, int) else F.when(places == d, text).otherwise(quick)
    return F.when(x.isNull(), F.lit(None)).when(doubtful, _exact_point(x, digits)).otherwise(quick)
