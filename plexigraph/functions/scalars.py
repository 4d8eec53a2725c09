"""Scalar expressions that the operators share."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def activation(x: Column, name: str) -> Column:
    """id, step, sigmoid, relu or gaussian; any other name is the sigmoid."""
    if name == "id":
        return x
    if name == "step":
        return F.when(x >= 0, 1.0).otherwise(0.0)
    if name == "relu":
        return F.when(x > 0, x).otherwise(0.0)
    if name == "gaussian":
        return F.exp(-x * x)
    return 1.0 / (1.0 + F.exp(-x))


def parse_uint64(text: Column) -> Column:
    """An unsigned 64-bit integer as decimal(20,0); null for other characters or overflow."""
    number = F.when(text.rlike(r"^[0-9]{1,20}$"), text.try_cast("decimal(20,0)"))
    return F.when(number <= F.lit("18446744073709551615").cast("decimal(20,0)"), number)


def parse_int(text: Column) -> Column:
    """A leading integer; null if there is none."""
    return F.regexp_extract(text, r"^\s*([+-]?\d+)", 1).try_cast("int")


def parse_double(text: Column) -> Column:
    return F.trim(text).try_cast("double")


def split_values(text: Column, delimiter: str | None) -> Column:
    """The values of a delimited string; an empty item at the end does not count."""
    if not delimiter:
        return F.array(text)
    items = F.split(text, "\\Q" + delimiter + "\\E")
    n = F.size(items)
    return F.when((n > 1) & (F.element_at(items, -1) == ""), F.slice(items, 1, n - 1)).otherwise(items)


def strip_space(text: Column) -> Column:
    return F.regexp_replace(text, r"\s", "")


def damped(mutual: Column) -> Column:
    """log(2 + mutual): the weight of mutual neighbours in clustered placement."""
    return F.log(mutual + 2)


def program_id(code: Column) -> Column:
    """SHA-256 of a program's bytes."""
    return F.sha2(code, 256)


def new_handle(counter: Column, client: int) -> Column:
    """A handle from a counter and a client number."""
    return F.concat(counter.cast("string"), F.lit("_"), F.lit(str(client)))
