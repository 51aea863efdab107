"""Random draws that are a pure function of a seed, a name and a row's key.

``unit`` is uniform in [0, 1) and does not depend on partitions or retries. Draws that end
up in printed numbers are made as integers in the printed unit, so that every engine prints
the same text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def unit(seed: int, name: str, *keys: Column) -> Column:
    """The first 32 bits of an MD5, over 2**32."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(name), *[k.cast("string") for k in keys]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def bernoulli(u: Column, probability: float) -> Column:
    return u < F.lit(float(probability))


def randint(u: Column, low: int, high: int) -> Column:
    """An integer of [low, high]."""
    return F.lit(low).cast("long") + F.floor(u * (high - low + 1))


def uniform(u: Column, low: float, high: float, places: int) -> Column:
    """A number of [low, high] with so many decimals, as an integer in units of the last one."""
    return randint(u, round(low * 10**places), round(high * 10**places))


def choice(u: Column, options: list) -> Column:
    return F.element_at(F.array(*[F.lit(o) for o in options]), (F.floor(u * len(options)) + 1).cast("int"))


def decimal_text(n: Column, places: int) -> Column:
    """An integer in units of the last decimal, as text."""
    a = F.abs(n)
    whole, part = F.floor(a / 10**places).cast("string"), (a % 10**places).cast("string")
    sign = F.when(n < 0, F.lit("-")).otherwise(F.lit(""))
    return F.concat(sign, whole, F.lit("."), F.lpad(part, places, "0")) if places else F.concat(sign, whole)
