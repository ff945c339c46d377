"""Prompt templates and their rendering to column expressions."""

from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

# The prompt texts. A model tuned on them expects them unchanged.
ISSUE_HEAD = """### Task: Fix GitHub Issue

Repository: {repo}

### Issue Description:
{problem_statement}
"""

HINTS_BLOCK = """
### Hints:
{hints_text}
"""

SFT_TAIL = """
### Instructions:
Generate a unified diff patch that fixes the issue described above.
The patch should be in standard unified diff format.

### Patch:
"""

INFERENCE_TAIL = """
### Instructions:
Generate a unified diff patch that fixes the issue described above.
The patch should be in standard unified diff format, starting with "diff --git".

### Patch:
"""

SHORT_TAIL = """
### Instructions:
Generate a unified diff patch that fixes the issue described above.

### Patch:
"""

PROSE_TEMPLATE = (
    "Given the following GitHub issue in repository {repo}:\n\n"
    "{problem_statement}\n\nGenerate a patch to fix this issue."
)

NEGATIVE_REQUESTS = {
    "flaw_list": """{prompt}

Generate a patch that attempts to fix the issue but contains one of these flaws:
- Incomplete fix (doesn't handle edge cases)
- Incorrect logic
- Breaks existing functionality
- Doesn't follow the codebase style

The patch should look plausible but be incorrect.""",
    "subtle_bug": """{prompt}

Generate a patch that attempts to fix the issue but contains a subtle bug or incompleteness.
The patch should look plausible but be incorrect in one of these ways:
- Incomplete fix (doesn't handle all cases)
- Incorrect logic
- Side effects or breaking changes
- Style inconsistencies""",
    "plain": """Given this GitHub issue:
{problem_statement}

Generate a patch that attempts to fix this issue but contains a subtle bug
or doesn't fully address the problem. The patch should look plausible but
be incorrect in some way.

Patch:""",
}


def render(template: str, **slots: Column) -> Column:
    """Fill ``{name}`` slots of ``template`` from columns (default: the column of that name).

    The template is cut into pieces once, on the driver; the values are only
    concatenated, so a value that happens to contain ``{patch}`` is left alone.
    """
    pieces = []
    for literal, field, _, _ in Formatter().parse(template):
        if literal:
            pieces.append(F.lit(literal))
        if field is not None:
            pieces.append(slots.get(field, F.col(field)) if field else F.lit("{}"))
    return F.concat(*pieces) if pieces else F.lit("")


def hints_block(hints_text: Column) -> Column:
    """The hints section, or nothing where hints are missing or empty."""
    given = F.coalesce(hints_text, F.lit("")) != ""
    return F.when(given, render(HINTS_BLOCK, hints_text=hints_text)).otherwise(F.lit(""))


def sft_prompt(include_hints: bool = False) -> Column:
    """Training prompt from the columns repo, problem_statement (and hints_text)."""
    head = render(ISSUE_HEAD)
    if include_hints:
        return F.concat(head, hints_block(F.col("hints_text")), F.lit(SFT_TAIL))
    return F.concat(head, F.lit(SFT_TAIL))


def inference_prompt() -> Column:
    """Generation prompt; hints are always included where there are any."""
    return F.concat(render(ISSUE_HEAD), hints_block(F.col("hints_text")), F.lit(INFERENCE_TAIL))


def short_prompt() -> Column:
    return F.concat(render(ISSUE_HEAD), F.lit(SHORT_TAIL))


def negative_request(wording: str = "flaw_list") -> Column:
    """Request for a deliberately flawed patch, from the columns of an instance."""
    if wording not in NEGATIVE_REQUESTS:
        known = sorted(NEGATIVE_REQUESTS)
        raise ValueError(f"unknown wording {wording!r}, expected one of {known}")
    return render(NEGATIVE_REQUESTS[wording], prompt=sft_prompt())
