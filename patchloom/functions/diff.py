"""Expressions over a unified diff held in one string column.

Everything stays inside the row: no explode, no shuffle, linear in the number of
lines.
"""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

TRUNCATE_MIN_LINES = 5
DROP_MIN_LINES = 10
DROP_EVERY = 3


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a lambda variable.

    An expression captured by a higher-order function's lambda is evaluated again
    for each element; a bound variable is not, which keeps line work linear.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lines(patch: Column) -> Column:
    """All lines, trailing empty ones included."""
    return F.split(patch, "\n", -1)


def line_count(patch: Column) -> Column:
    return F.octet_length(patch) - F.octet_length(F.replace(patch, F.lit("\n"), F.lit(""))) + 1


def is_header(line: Column) -> Column:
    return F.startswith(line, F.lit("+++")) | F.startswith(line, F.lit("---"))


def is_changed(line: Column) -> Column:
    """An added or removed line, file headers excluded."""
    signed = F.startswith(line, F.lit("+")) | F.startswith(line, F.lit("-"))
    return signed & ~is_header(line)


def line_kind(line: Column) -> Column:
    return (
        F.when(is_header(line), F.lit("header"))
        .when(F.startswith(line, F.lit("+")), F.lit("added"))
        .when(F.startswith(line, F.lit("-")), F.lit("removed"))
        .otherwise(F.lit("context"))
    )


def changed_counts(patch: Column) -> Column:
    """struct(n_lines, n_added, n_removed, n_header)."""

    def count_of(kinds: Column, kind: str) -> Column:
        return F.size(F.filter(kinds, lambda k: k == kind)).alias(f"n_{kind}")

    def counted(kinds: Column) -> Column:
        named = [count_of(kinds, kind) for kind in ("added", "removed", "header")]
        return F.struct(F.size(kinds).alias("n_lines"), *named)

    return bind(F.transform(lines(patch), line_kind), counted)


def truncated(patch: Column, min_lines: int = TRUNCATE_MIN_LINES) -> Column:
    """The first half of the lines; NULL for patches of at most ``min_lines`` lines."""
    n = line_count(patch)
    half = F.call_function("substring_index", patch, F.lit("\n"), F.floor(n / 2).cast("int"))
    return F.when(n > min_lines, half)


def every_nth_dropped(
    patch: Column, every: int = DROP_EVERY, min_lines: int = DROP_MIN_LINES
) -> Column:
    """The patch without every ``every``-th changed line.

    NULL for patches of at most ``min_lines`` lines and where nothing is dropped.
    """

    def without(ls: Column) -> Column:
        numbered = F.transform(ls, lambda line, i: F.when(is_changed(line), i))
        changed = F.filter(numbered, lambda i: i.isNotNull())
        dropped = F.filter(changed, lambda _, k: k % every == every - 1)
        return bind(dropped, lambda drop: F.when(F.size(drop) > 0, rejoin(ls, drop)))

    def rejoin(ls: Column, drop: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), drop)
        return F.array_join(F.transform(kept, lambda i: F.get(ls, i)), "\n")

    return F.when(line_count(patch) > min_lines, bind(lines(patch), without))


def signs_swapped(patch: Column) -> Column:
    """Added lines become removed ones and the other way round; headers stay."""

    def swap(line: Column) -> Column:
        sign = F.when(F.startswith(line, F.lit("+")), F.lit("-")).otherwise(F.lit("+"))
        return F.when(is_changed(line), F.concat(sign, F.substr(line, F.lit(2)))).otherwise(line)

    return F.array_join(F.transform(lines(patch), swap), "\n")
