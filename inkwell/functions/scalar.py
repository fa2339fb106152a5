"""Scalar functions as column expressions; all stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: object) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def add(*args: object) -> Column:
    """Sum of numbers."""
    return reduce(lambda a, b: a + b, map(_c, args))


def concat(*args: object) -> Column:
    """Addition whose first argument is text joins all arguments."""
    return F.concat(*[_c(a).cast("string") for a in args])


def add_time(t: Column, seconds: object) -> Column:
    """A time some (fractional) seconds later."""
    return F.timestamp_micros(F.unix_micros(t) + F.round(_c(seconds) * 1_000_000).cast("long"))


def subtract(*args: object) -> Column:
    """Difference; of one argument its negative."""
    cols = [_c(a) for a in args]
    return -cols[0] if len(cols) == 1 else reduce(lambda a, b: a - b, cols)


def time_difference(a: Column, b: Column) -> Column:
    """Seconds between two times, as a float."""
    return (F.unix_micros(a) - F.unix_micros(b)) / F.lit(1_000_000.0)


def multiply(*args: object) -> Column:
    return reduce(lambda a, b: a * b, map(_c, args))


def repeat(s: Column, n: object) -> Column:
    """Text times a whole number."""
    return F.repeat(s, _c(n).cast("int"))


def divide(a: object, b: object) -> Column:
    """Whole-number division that truncates; null on a zero divisor (see divide_float)."""
    a, b = _c(a).cast("long"), _c(b).cast("long")
    return F.call_function("div", a, F.nullif(b, F.lit(0).cast("long")))


def divide_float(a: object, b: object) -> Column:
    """Float division; by zero it is infinite or not a number."""
    a, b = _c(a).cast("double"), _c(b).cast("double")
    inf = F.lit(float("inf"))
    zero = F.when(a > 0, inf).when(a < 0, -inf).otherwise(F.lit(float("nan")))
    return F.when(b == 0, zero).otherwise(a / F.nullif(b, F.lit(0.0)))


def quotient(a: object, b: object) -> Column:
    """Division as scripts see it: truncated for whole numbers, but a float when the divisor is 0."""
    return F.when(_c(b) == 0, divide_float(a, b)).otherwise(divide(a, b).cast("double"))


def remainder(*args: object) -> Column:
    """Left-folded remainder with the dividend's sign; a zero divisor is an error."""

    def step(a: Column, b: Column) -> Column:
        return F.when(b == 0, F.raise_error(F.lit("remainder: division by zero")).cast("long")).otherwise(a % F.nullif(b, F.lit(0)))

    return reduce(step, map(_c, args))


def _chain(args: tuple, test) -> Column:
    cols = [_c(a) for a in args]
    return reduce(lambda a, b: a & b, [test(x, y) for x, y in zip(cols, cols[1:])])


def eq(*args: object) -> Column:
    return _chain(args, lambda a, b: a == b)


def lt(*args: object) -> Column:
    return _chain(args, lambda a, b: a < b)


def gt(*args: object) -> Column:
    return _chain(args, lambda a, b: a > b)


def le(*args: object) -> Column:
    return _chain(args, lambda a, b: a <= b)


def ge(*args: object) -> Column:
    return _chain(args, lambda a, b: a >= b)


def identical(a: Column, b: Column) -> Column:
    """Same value, or both missing."""
    return a.eqNullSafe(b)


def is_zero(c: Column) -> Column:
    return c == 0


def is_positive(c: Column) -> Column:
    return c > 0


def is_negative(c: Column) -> Column:
    return c < 0


def is_empty(c: Column) -> Column:
    return F.size(c) == 0


def truth(c: Column) -> Column:
    """Only false (and a missing value) fails."""
    return F.coalesce(c, F.lit(False))


def negate(c: Column) -> Column:
    """True for false (and missing) only."""
    return ~truth(c)


def substrb(s: Column, begin: int, end: int) -> Column:
    """Bytes begin to end, both included; a negative end counts from the last byte (-1), a negative begin from one past it."""
    raw = F.encode(s, "UTF-8")
    size = F.octet_length(s)
    b = F.lit(begin) if begin >= 0 else size + F.lit(begin + 1)
    e = F.lit(end) if end >= 0 else size + F.lit(end)
    b = F.greatest(b, F.lit(0))
    e = F.least(e, size - 1)
    return F.decode(F.when(e >= b, F.substring(raw, b + 1, e - b + 1)).otherwise(F.lit(b"")), "UTF-8")


def to_number(s: Column) -> Column:
    """Number that the whole text spells, else 0."""
    return F.coalesce(s.try_cast("double"), F.lit(0.0))


def now() -> Column:
    return F.current_timestamp()


def timestr(t: Column) -> Column:
    return F.date_format(t.cast("timestamp"), "yyyy-MM-dd HH:mm:ss.SSSSSS")


def to_time(s: Column) -> Column:
    """Time from ``Y/M/D h:m:s[.u]``, with / or -; null if it isn't one."""
    return F.try_to_timestamp(F.regexp_replace(s, "/", "-"))


def car(c: Column) -> Column:
    return F.get(c, F.lit(0))


def cdr(c: Column) -> Column:
    return F.slice(c, 2, F.greatest(F.size(c), F.lit(1)))


def cons(x: object, c: Column) -> Column:
    return F.concat(F.array(_c(x)), c)


def list_of(*args: object) -> Column:
    return F.array(*map(_c, args))


def length(c: Column) -> Column:
    return F.size(c)


def reverse(c: Column) -> Column:
    return F.reverse(c)


def append(*cs: Column) -> Column:
    return F.concat(*cs)


def assq(key: object, c: Column) -> Column:
    """Value of a key in a map, null if absent."""
    return F.try_element_at(c, _c(key))


def json_read(s: Column, schema: str) -> Column:
    """Typed value of JSON text, null if it can't be read."""
    return F.from_json(s, schema)


def json_get(s: Column, path: str) -> Column:
    return F.get_json_object(s, path)
