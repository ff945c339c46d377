"""Secrets in text: fixed patterns, and windows of high entropy. Column expressions only.

Besides the patterns, runs of a character class are looked at through a sliding window.
The window's Shannon entropy is kept by counts: a step takes one character out and one in,
and only their terms of the sum change. The allow-list excuses what it matches and no more:
a run is cut there, and reported if any window of a stretch that is left reaches its class's
threshold. Letters of one case with digits have classes of their own; their runs are reported
where no other span holds them.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The patterns of the base kinds, in their order, with the least length.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24

WINDOW = 24
#: Entropy terms are whole numbers of this size, so that sums do not depend on their order.
UNIT = 1_000_000
#: c · log2(c) for a character that is c times in the window.
TERMS = [round(c * log2(c) * UNIT) if c else 0 for c in range(WINDOW + 1)]


@dataclass(frozen=True)
class CharacterClass:
    kind: str
    pattern: str
    alphabet: str
    #: What a stretch of a run must hold to be a candidate.
    needs: tuple[str, ...]
    least_bits: float
    #: What is cut out of a run before its stretches are looked at.
    allowed: str

    @property
    def most(self) -> int:
        """Largest sum of terms at which the entropy reaches ``least_bits``."""
        return int(WINDOW * UNIT * (log2(WINDOW) - self.least_bits))


#: No secrets: published samples, and identifiers made of spelled-out words.
SAMPLES = "[Ee][Xx][Aa][Mm][Pp][Ll][Ee]|[Ss][Aa][Mm][Pp][Ll][Ee]|[Dd][Uu][Mm][Mm][Yy]"
ALLOWED = f"{SAMPLES}|[a-z]{{10,}}"

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
CLASSES = (
    CharacterClass(
        "entropy_base64", f"[A-Za-z0-9+/_-]{{{WINDOW},}}", f"{LETTERS}0123456789+/_-",
        ("[A-Z]", "[a-z]", "[0-9].*[0-9]"), 3.9, ALLOWED,
    ),
    CharacterClass(
        "entropy_hex", f"[0-9A-Fa-f]{{{WINDOW},}}", "0123456789ABCDEFabcdef",
        ("[A-Fa-f]", "[0-9]"), 3.0, ALLOWED,
    ),
)
#: Keys of one case. Ten lower-case letters in a row are common in random ones, twenty are not.
ONE_CASE = (
    CharacterClass(
        "entropy_upper", f"[A-Z0-9]{{{WINDOW},}}", f"{LETTERS[:26]}0123456789",
        ("[A-Z]", "[0-9].*[0-9]"), 3.6, SAMPLES,
    ),
    CharacterClass(
        "entropy_lower", f"[a-z0-9]{{{WINDOW},}}", f"{LETTERS[26:]}0123456789",
        ("[a-z]", "[0-9](?:[a-z]*[0-9]){3}"), 3.6, f"{SAMPLES}|[a-z]{{20,}}",
    ),
)
KINDS = ("assign", "access", "hex", *(c.kind for c in (*CLASSES, *ONE_CASE)))

_SPAN = "struct<start:bigint,end:bigint,text:string>"


def _spans(between: Column, found: Column) -> Column:
    """Code-point spans of the matches ``found``, given the pieces of text between them."""
    steps = F.arrays_zip(F.slice(between, 1, F.size(found)).alias("gap"), found.alias("text"))
    none = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(f"array<{_SPAN}>").alias("out"))

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["gap"])
        end = start + F.length(x["text"])
        span = F.struct(start.alias("start"), end.alias("end"), x["text"].alias("text"))
        return F.struct(end.alias("at"), F.array_append(state["out"], span).alias("out"))

    return F.aggregate(steps, none, step, lambda state: state["out"])


def matches(df: DataFrame, text: str, pattern: str, name: str) -> DataFrame:
    """Add ``name``: all matches of ``pattern`` as (start, end, text), left to right."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    df = df.withColumn("_found", found)
    spans = F.when(F.size("_found") > 0, _spans(F.split(text, pattern, -1), F.col("_found")))
    return df.withColumn(name, F.coalesce(spans, F.array().cast(f"array<{_SPAN}>"))).drop("_found")


def least_sum(run: Column, alphabet: str) -> Column:
    """Smallest sum of terms over all windows of a run, null if it is shorter than one."""
    chars = F.transform(F.split(run, ""), lambda c: F.instr(F.lit(alphabet), c))
    # In step i the character at i comes in and the one at i - WINDOW goes out (0: none).
    leaving = F.concat(F.array_repeat(F.lit(0), WINDOW), chars)
    steps = F.arrays_zip(chars.alias("new"), F.slice(leaving, 1, F.size(chars)).alias("old"))
    terms = F.array(*(F.lit(t).cast("bigint") for t in TERMS))
    start = F.struct(
        F.array_repeat(F.lit(0), len(alphabet)).alias("counts"),
        F.lit(0).cast("bigint").alias("sum"),
        F.lit(None).cast("bigint").alias("least"),
        F.lit(0).alias("size"),
    )

    def term(count: Column) -> Column:
        return F.get(terms, count)

    def step(state: Column, x: Column) -> Column:
        new, old = x["new"], x["old"]
        coming, going = F.get(state["counts"], new - 1), F.get(state["counts"], old - 1)
        added = term(coming + 1) - term(coming)
        removed = F.when(old > 0, term(going) - term(going - 1)).otherwise(F.lit(0))
        total = F.when(new == old, state["sum"]).otherwise(state["sum"] + added - removed)
        counts = F.when(new == old, state["counts"]).otherwise(
            F.transform(
                state["counts"],
                lambda c, k: c + (k == new - 1).cast("int") - (k == old - 1).cast("int"),
            )
        )
        size = state["size"] + 1
        least = F.when(size >= WINDOW, F.least(state["least"], total)).otherwise(state["least"])
        return F.struct(
            counts.alias("counts"), total.alias("sum"), least.alias("least"), size.alias("size")
        )

    return F.aggregate(steps, start, step, lambda state: state["least"])


def _likely(c: CharacterClass):
    def candidate(part: Column) -> Column:
        mixed = F.length(part) >= WINDOW
        for need in c.needs:
            mixed = mixed & part.rlike(need)
        return mixed

    def test(s: Column) -> Column:
        # The window runs over candidates only.
        parts = F.filter(F.split(s["text"], c.allowed, -1), candidate)
        return F.exists(parts, lambda part: least_sum(part, c.alphabet) <= c.most)

    return test


def _not_within(spans: Column, others: Column) -> Column:
    """The ``spans`` that no single one of ``others`` holds: one pass by start."""
    wide = F.transform(others, lambda s: F.struct(s["start"].alias("start"), F.lit(0).alias("own"), s.alias("span")))
    own = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(1).alias("own"), s.alias("span")))
    none = F.struct(F.lit(0).cast("bigint").alias("far"), F.array().cast(f"array<{_SPAN}>").alias("out"))

    def step(state: Column, x: Column) -> Column:
        end, mine = x["span"]["end"], x["own"] == 1
        far = F.when(mine, state["far"]).otherwise(F.greatest(state["far"], end))
        out = F.when(mine & (end > state["far"]), F.array_append(state["out"], x["span"])).otherwise(state["out"])
        return F.struct(far.alias("far"), out.alias("out"))

    return F.aggregate(F.array_sort(F.concat(wide, own)), none, step, lambda state: state["out"])


def find_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``n_assign``, ``n_access``, ``n_hex``, ``base`` and ``secrets`` to ``docs``.

    Both are arrays of (start, end, kind), by start and then kind: those of the fixed
    patterns, and all. A null text is empty. Columns of these names are replaced, all others
    stay whatever they are called; no row is moved, so hot sources and repeated rows do not
    matter.
    """
    added = {"n_assign", "n_access", "n_hex", "base", "secrets"}
    given = [F.col(f"`{c}`") for c in docs.columns if c not in added]
    df = docs.select(F.struct(*given).alias("_row"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    for pattern, name in ((ASSIGN, "_assign"), (ACCESS, "_access"), (HEX.replace("+", f"{{{HEX_LEAST},}}"), "_hex")):
        df = matches(df, "_text", pattern, name)
    df = df.withColumns(
        {
            "_assign": F.filter("_assign", lambda s: F.length(F.regexp_extract(s["text"], ASSIGN, 2)) >= ASSIGN_LEAST),
            "_access": F.filter("_access", lambda s: F.length(s["text"]) >= ACCESS_LEAST),
        }
    )
    for c in CLASSES:
        df = matches(df, "_text", c.pattern, f"_{c.kind}")
        df = df.withColumn(f"_{c.kind}", F.filter(f"_{c.kind}", _likely(c)))
    others = F.concat(*(F.col(f"_{k}") for k in KINDS[: -len(ONE_CASE)]))
    for c in ONE_CASE:
        df = matches(df, "_text", c.pattern, f"_{c.kind}")
        df = df.withColumn(f"_{c.kind}", F.filter(_not_within(F.col(f"_{c.kind}"), others), _likely(c)))

    def tagged(kind: str) -> Column:
        order = F.lit(KINDS.index(kind))
        return F.transform(
            f"_{kind}",
            lambda s: F.struct(s["start"].alias("start"), order.alias("place"), s["end"].alias("end"), F.lit(kind).alias("kind")),
        )

    def ordered(*kinds: str) -> Column:
        every = F.array_sort(F.concat(*(tagged(k) for k in kinds)))
        return F.transform(
            every, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))
        )

    return df.select(
        "_row.*",
        F.size("_assign").cast("long").alias("n_assign"),
        F.size("_access").cast("long").alias("n_access"),
        F.size("_hex").cast("long").alias("n_hex"),
        ordered(*KINDS[:3]).alias("base"),
        ordered(*KINDS).alias("secrets"),
    )


def listed(spans: Column) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with each span, or run of overlapping spans, replaced by ``[SECRET]``."""
    state = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(s: Column, x: Column) -> Column:
        apart = x["start"] >= s["at"]
        gap = F.substring(text, s["at"].cast("int") + 1, (x["start"] - s["at"]).cast("int"))
        out = F.when(apart, F.concat(s["out"], gap, F.lit("[SECRET]"))).otherwise(s["out"])
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), out.alias("out"))

    whole = F.aggregate(
        spans, state, step,
        lambda s: F.concat(s["out"], F.substring(text, s["at"].cast("int") + 1, F.length(text))),
    )
    return F.when(F.size(spans) > 0, whole).otherwise(text)
