"""Batch generation: a user-supplied function run over a table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def generate(
    df: DataFrame,
    make_generator: Callable[[], Callable],
    prompt: str = "prompt",
    options: list[str] | None = None,
    output: str = "patch",
    partitions: int | None = None,
    batch: int | None = None,
) -> DataFrame:
    """Add the generator's answer to each row's prompt, and an ``error`` column.

    ``make_generator`` is called once per task that has rows, where a model is loaded or a
    client opened; what it returns is called with the prompt and, by keyword, the columns
    named in ``options``. A row whose call raises gets ``''`` and the message, and the rest
    goes on. Give ``partitions`` when the calls dominate: rows are then dealt out evenly,
    whatever their keys.

    With ``batch`` the generator gets lists, of at most so many rows, and returns a list of
    as many answers. Rows of similar prompt length are put together, so that a model pads
    little. A call that raises, or returns another number of answers, is repeated on both
    halves until the row that it fails for is alone: one bad row costs the others two more
    calls for each halving, but no answer.
    """
    wanted = list(options or [])
    schema = StructType(
        [*df.schema.fields, StructField(output, StringType()), StructField("error", StringType())]
    )

    def checked(text):
        # What Arrow could not carry back would fail the whole batch.
        if text is not None:
            if not isinstance(text, str):
                raise TypeError(f"generator returned {type(text).__name__}, not text")
            text.encode("utf-8")
        return text

    def message(error: Exception) -> str:
        found = str(error) or type(error).__name__
        return found.encode("utf-8", "replace").decode("utf-8")

    def single(call, rows: list[tuple]) -> Iterator[tuple]:
        for text, *values in rows:
            try:
                yield checked(call(text, **dict(zip(wanted, values)))), None
            except Exception as error:
                yield "", message(error)

    def together(call, rows: list[tuple]) -> list[tuple]:
        """The answers to a list of rows, in order."""
        try:
            texts, *values = (list(column) for column in zip(*rows))
            answers = list(call(texts, **dict(zip(wanted, values))))
            if len(answers) != len(rows):
                raise ValueError(f"generator returned {len(answers)} answers to {len(rows)} prompts")
        except Exception as error:
            if len(rows) == 1:
                return [("", message(error))]
            half = len(rows) // 2
            return together(call, rows[:half]) + together(call, rows[half:])
        found = []
        for answer in answers:
            try:
                found.append((checked(answer), None))
            except Exception as error:
                found.append(("", message(error)))
        return found

    def by_length(call, rows: list[tuple]) -> list[tuple]:
        order = sorted(range(len(rows)), key=lambda i: len(rows[i][0] or ""))
        found: list = [None] * len(rows)
        for first in range(0, len(rows), batch):
            part = order[first : first + batch]
            for i, answer in zip(part, together(call, [rows[i] for i in part])):
                found[i] = answer
        return found

    def answer(batches: Iterator) -> Iterator:
        call = None
        for given in batches:
            if given.empty:
                continue
            call = call or make_generator()
            rows = list(zip(given[prompt], *(given[name] for name in wanted)))
            found = list((by_length if batch else single)(call, rows))
            yield given.assign(**{output: [a for a, _ in found], "error": [e for _, e in found]})

    if batch is not None and batch < 1:
        raise ValueError("batch must be at least 1")
    spread = df if partitions is None else df.repartition(partitions)
    return spread.mapInPandas(answer, schema)


def summary(outputs: DataFrame, output: str = "patch") -> DataFrame:
    """Processed, successful (an answer and no error) and failed rows."""
    good = (F.coalesce(F.col(output), F.lit("")) != "") & (
        F.coalesce(F.col("error"), F.lit("")) == ""
    )
    return outputs.agg(
        F.count(F.lit(1)).alias("processed"),
        F.count_if(good).alias("successful"),
        F.count_if(~good).alias("failed"),
    )
