"""Text expressions whose results equal those of Python's string methods."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 29 characters for which Python's str.isspace() is true. SQL's
# plain TRIM removes spaces only.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    """Remove Unicode whitespace at both ends."""
    return F.btrim(text, F.lit(WHITESPACE))


def extract_patch(response: Column) -> Column:
    """The patch inside a free-form model response.

    From the first ``diff --git`` to the end, stripped; else, where both file
    header markers occur, everything from the first line that starts with
    ``---``, as is (empty if no line does); else the whole response, stripped.
    """
    git_at = F.instr(response, "diff --git")
    header_at = F.instr(response, "\n---")
    from_header = (
        F.when(F.startswith(response, F.lit("---")), response)
        .when(header_at > 0, F.substr(response, header_at + 1))
        .otherwise(F.lit(""))
    )
    has_headers = F.contains(response, F.lit("---")) & F.contains(response, F.lit("+++"))
    return (
        F.when(git_at > 0, strip(F.substr(response, git_at)))
        .when(has_headers, from_header)
        .otherwise(strip(response))
    )


def strip_prompt_echo(generated: Column, prompt: Column, by_length: bool = False) -> Column:
    """Drop the prompt a model repeated before its answer, then strip.

    The text is cut only if it really starts with the prompt, so an answer
    without an echo, or after a shortened one, keeps all its characters. With
    ``by_length`` as many characters as the prompt has are cut in any case.
    """
    rest = F.substr(generated, F.length(prompt) + 1)
    if by_length:
        return strip(rest)
    return strip(F.when(F.startswith(generated, prompt), rest).otherwise(generated))


def preview(text: Column, limit: int, marker: str = "...") -> Column:
    """The first ``limit`` characters, with ``marker`` where something was cut."""
    return F.when(
        F.length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit(marker))
    ).otherwise(text)


def log_tail(logs: Column, limit: int = 5000) -> Column:
    """The last ``limit`` characters of a log."""
    return F.right(logs, F.lit(limit))
