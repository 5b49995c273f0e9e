"""Scalar functions as Column expressions: all run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def abs2(re: Column, im: Column) -> Column:
    return re * re + im * im


def to_db(p: Column, floor: float = 1e-12) -> Column:
    return F.log10(p + F.lit(floor)) * 10


def ceil_div(a: Column, b: Column | int) -> Column:
    b = F.lit(b) if isinstance(b, int) else b
    return F.ceil(a / b)


def half_away(c: Column) -> Column:
    """Round halves away from zero (``llround``)."""
    return F.round(c)


def half_even(c: Column) -> Column:
    """Round halves to even."""
    return F.bround(c)


def saturating_add(a: Column, b: Column, most: int) -> Column:
    return F.least(a.cast("decimal(38,0)") + b.cast("decimal(38,0)"), F.lit(most).cast("decimal(38,0)")).cast("long")


def quantise(c: Column, rounded: bool) -> Column:
    """[0, 1] to 0..255: rounded, or cut off."""
    x = clamp(c, 0.0, 1.0) * 255
    return F.floor(x + 0.5).cast("int") if rounded else x.cast("int")


def attenuation_of(stem: Column) -> Column:
    """The number after the attenuation mark in a capture's name; null if there is none."""
    got = F.regexp_extract(stem, r"attenuation_dB_(\d+)", 1)
    return F.when(got != "", got.cast("int"))


def semver(c: Column) -> Column:
    """``v1.2`` and the like as major.minor.patch; null if it doesn't begin with a number."""
    part = lambda i: F.coalesce(F.nullif(F.regexp_extract(c, r"^\s*[vV]?(\d+)(?:\.(\d+))?(?:\.(\d+))?", i), F.lit("")), F.lit("0"))
    return F.when(c.rlike(r"^\s*[vV]?\d"), F.concat_ws(".", part(1), part(2), part(3)))


def doubles(c: Column) -> Column:
    """Comma-separated numbers; null as a whole if any part is none."""
    parts = F.transform(F.split(c, ","), lambda x: F.trim(x).try_cast("double"))
    return F.when(F.forall(parts, lambda x: x.isNotNull()), parts)


def short_path(c: Column, separator: str = ",") -> Column:
    """The first three letters of each operator's name on a path; an error where two different names of a path would look the same."""
    names = F.array_distinct(F.transform(F.split(c, separator), lambda x: F.trim(x)))
    alike = F.size(F.array_distinct(F.transform(names, lambda x: F.substring(x, 1, 3)))) < F.size(names)
    short = F.when(alike, F.raise_error(F.concat(F.lit("names on one path begin alike: "), c)).cast("string"))
    return short.otherwise(_short(c, separator))


def _short(c: Column, separator: str) -> Column:
    return F.concat_ws("-", F.transform(F.split(c, separator), lambda x: F.substring(F.trim(x), 1, 3)))


def fft_size(rate: Column, reference_rate: float, reference_size: int) -> Column:
    """The reference size times the power of two nearest to the rate's ratio in octaves."""
    return (F.lit(reference_size) * F.pow(F.lit(2.0), F.round(F.log2(rate / F.lit(reference_rate))))).cast("long")


def frame_budget_ms(rows: Column, size: Column, rate: Column) -> Column:
    return rows * size / rate * 1000


def bucket_label(c: Column, edges: list[float], labels: list[str], missing: str = "unknown") -> Column:
    """The label of the half-open bucket a value lies in."""
    out = F.when(c.isNull() | F.isnan(c.cast("double")), F.lit(missing))
    for e, name in zip(edges, labels, strict=False):
        out = out.when(c < e, F.lit(name))
    return out.otherwise(F.lit(labels[len(edges)]))


BANDWIDTH_EDGES = ([2e6, 10e6, 25e6, 60e6], ["<2MHz", "2-10MHz", "10-25MHz", "25-60MHz", ">=60MHz"])
LENGTH_EDGES = ([10_000.0, 100_000.0, 1_000_000.0, 5_000_000.0], ["<10k", "10k-100k", "100k-1M", "1M-5M", ">=5M"])


def fnv1a(payload: Column, most: int | None = None) -> Column:
    """64-bit FNV-1a of the (first ``most``) bytes, as sixteen hexadecimal digits; null of a null.

    The hash is kept as two halves, as products of 64 bits would overflow. The
    prime is 2**40 + 435.
    """
    h = F.hex(payload if most is None else F.substring(payload, 1, most))
    places = F.when(F.length(h) > 0, F.sequence(F.lit(1), F.length(h), F.lit(2))).otherwise(F.array().cast("array<int>"))
    low32 = 0xFFFFFFFF

    def step(acc: Column, at: Column) -> Column:
        low = acc["low"].bitwiseXOR(F.conv(F.substring(h, at, F.lit(2)), 16, 10).cast("long"))
        product = low * 435
        high = (acc["high"] * 435 + F.shiftright(product, 32) + F.shiftleft(low, 8)).bitwiseAND(low32)
        return F.struct(high.alias("high"), product.bitwiseAND(low32).alias("low"))

    # Fixed value: the offset basis.
    start = F.struct(F.lit(0xCBF29CE4).cast("long").alias("high"), F.lit(0x84222325).cast("long").alias("low"))
    half = lambda c: F.lpad(F.lower(F.hex(c)), 8, "0")
    return F.when(h.isNotNull(), F.aggregate(places, start, step, lambda a: F.concat(half(a["high"]), half(a["low"]))))


def pcm16(c: Column) -> Column:
    """[-1, 1] as 16-bit samples, cut off towards 0; values beyond are at the limit."""
    return (clamp(c, -1.0, 1.0) * 32767).cast("int")


def gamma(c: Column, power: float, most: int, alpha: Column) -> Column:
    """Power law over 0..``most``, rounded to whole numbers; components that are ``alpha`` stay, cut off to the range."""
    held = clamp(c, 0.0, float(most))
    return F.when(alpha, held).otherwise(F.floor(F.pow(held / most, F.lit(power)) * most + 0.5)).cast("int")
