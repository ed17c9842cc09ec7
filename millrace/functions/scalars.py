"""Scalar functions of the meters and reports, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pct(part: Column, whole: Column) -> Column:
    """Percentage to one decimal, half up, 0.0 where the whole is 0. Whole numbers not below 0."""
    tenths = F.expr("0L") + F.floor((part * 2000 + whole).cast("decimal(38,0)") / F.when(whole != 0, whole * 2)).cast("bigint")
    return F.coalesce(tenths / F.lit(10.0), F.lit(0.0))


def whole_median(c: Column) -> Column:
    """Median of whole numbers; the mean of the two middle ones is cut off."""
    return F.median(c).cast("bigint")


def nearest_rank_p90(name: str) -> Column:
    """The value at rank ceil(0.9 n)."""
    return F.expr(f"percentile_disc(0.9) WITHIN GROUP (ORDER BY {name})").cast("bigint")


def iso_week(ts: Column) -> Column:
    """ISO 8601 label of a week, with the year the week belongs to."""
    return F.concat(F.date_part(F.lit("YEAROFWEEK"), ts).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(ts).cast("string"), 2, "0"))


def format_tokens(n: Column) -> Column:
    """999, 1.2k, 12k, 1.2M: cut off, not rounded; one decimal below ten."""
    tens = lambda unit: F.concat(F.floor(n / unit).cast("string"), F.lit("."), (F.floor(n / (unit // 10)) % 10).cast("string"))
    return (
        F.when(n < 1000, n.cast("string"))
        .when(n < 10_000, F.concat(tens(1000), F.lit("k")))
        .when(n < 1_000_000, F.concat(F.floor(n / 1000).cast("string"), F.lit("k")))
        .otherwise(F.concat(tens(1_000_000), F.lit("M")))
    )


def kfmt(n: Column) -> Column:
    """950, 12.3k, 84k, 1.2M: rounded half up; '.0' is dropped in thousands up to 99.9k, none is shown from 100k on."""
    tenth_k = F.floor((n + 50) / 100)
    whole_k = F.floor((n + 500) / 1000)
    tenth_m = F.floor((n + 50_000) / 100_000)
    shown = lambda t, keep: F.when((t % 10 == 0) & F.lit(not keep), F.floor(t / 10).cast("string")).otherwise(F.concat(F.floor(t / 10).cast("string"), F.lit("."), (t % 10).cast("string")))
    return (
        F.when(n < 1000, n.cast("string"))
        .when(n < 99_950, F.concat(shown(tenth_k, False), F.lit("k")))
        .when(whole_k < 1000, F.concat(whole_k.cast("string"), F.lit("k")))
        .otherwise(F.concat(shown(tenth_m, True), F.lit("M")))
    )


def _two(n: Column) -> Column:
    return F.lpad(n.cast("string"), 2, "0")


def elapsed(ms: Column) -> Column:
    """42s, 3m07s, 2h05m; negative spans are 0s."""
    s = F.greatest(F.floor(ms / 1000), F.lit(0).cast("bigint"))
    return (
        F.when(s < 60, F.concat(s.cast("string"), F.lit("s")))
        .when(s < 3600, F.concat(F.floor(s / 60).cast("string"), F.lit("m"), _two(s % 60), F.lit("s")))
        .otherwise(F.concat(F.floor(s / 3600).cast("string"), F.lit("h"), _two(F.floor(s / 60) % 60), F.lit("m")))
    )


def remaining(ms: Column) -> Column:
    """3d 4h, 2h 14m, 9m, <1m."""
    m = F.floor(ms / 60_000)
    return (
        F.when(m < 1, F.lit("<1m"))
        .when(m < 60, F.concat(m.cast("string"), F.lit("m")))
        .when(m < 1440, F.concat(F.floor(m / 60).cast("string"), F.lit("h "), (m % 60).cast("string"), F.lit("m")))
        .otherwise(F.concat(F.floor(m / 1440).cast("string"), F.lit("d "), (F.floor(m / 60) % 24).cast("string"), F.lit("h")))
    )


def fit(text: Column, width: int) -> Column:
    """One line of at most ``width`` characters: control characters become spaces, spaces collapse, an ellipsis ends what is cut."""
    flat = F.trim(F.regexp_replace(F.regexp_replace(text, r"[\x00-\x1f\x7f]", " "), " +", " "))
    if width <= 0:
        return F.when(text.isNotNull(), F.lit(""))
    return F.when(F.length(flat) <= width, flat).otherwise(F.concat(F.substring(flat, 1, width - 1), F.lit("…")))


def grouped(n: Column) -> Column:
    """Thousands set off by commas."""
    return F.format_number(n, 0)


def pct1(share: Column) -> Column:
    """42.5% of a share in percent, half up."""
    return F.concat(F.round(share.cast("decimal(20,6)"), 1).cast("decimal(20,1)").cast("string"), F.lit("%"))


def strict_date(text: Column) -> Column:
    """The date of a text of exactly the form 2021-01-31, null for any other."""
    return F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), F.try_to_date(text, "yyyy-MM-dd"))


def is_safe_scalar(text: Column) -> Column:
    """Whether a text setting may be shown: short, of letters, digits and few signs."""
    return F.coalesce(text.rlike(r"^[A-Za-z0-9_.:\-\[\]]{1,64}\z"), F.lit(False))


def as_number(v: str) -> Column:
    """The number of the variant column ``v``: whole and decimal ones as they are, those in texts read; null for flags and all else."""
    kind = f"schema_of_variant({v})"
    text = f"CAST({v} AS string)"
    return F.expr(f"CASE WHEN {kind} = 'BIGINT' OR {kind} LIKE 'DECIMAL%' OR {kind} = 'DOUBLE' OR {kind} = 'STRING' AND {text} RLIKE '^ *[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)? *$' THEN try_cast({text} AS decimal(38,9)) END")


# Figures that walk beside an agent, a line of frames each.
FIGURES = [["><>  ", " ><> ", "  ><>", " ><> "], ["~~~o ", "~~o~ ", "~o~~ ", "o~~~ "], ["^v^  ", "v^v  "], ["(o,o)", "(-,-)", "(o,o)", "(o,o)"]]


def figure(id_: Column, now_ms: Column, frame_ms: int = 500) -> Column:
    """The frame shown for an id at a moment: the sum of its characters' codes chooses the figure, the clock the frame."""
    codes = F.transform(F.filter(F.split(id_, ""), lambda c: c != ""), lambda c: F.ascii(c))
    frames = F.element_at(F.array(*[F.array(*map(F.lit, f)) for f in FIGURES]), (F.aggregate(codes, F.lit(0), lambda a, x: a + x) % len(FIGURES)) + 1)
    return F.element_at(frames, (F.floor(now_ms / frame_ms) % F.size(frames)).cast("int") + 1)


def usd(amount: Column) -> Column:
    """$1.23 of a decimal amount, half up."""
    return F.concat(F.lit("$"), F.round(amount.cast("decimal(20,6)"), 2).cast("decimal(20,2)").cast("string"))


def short_tool(name: Column) -> Column:
    """The last segment of a tool name that begins with 'mcp__'."""
    return F.when(name.startswith("mcp__"), F.element_at(F.split(name, "__"), -1)).otherwise(name)


def window_label(kind: Column) -> Column:
    """Names of the two common rate windows, others with spaces for underscores."""
    return F.when(kind == "five_hour", "5h").when(kind == "seven_day", "7d").otherwise(F.replace(kind, F.lit("_"), F.lit(" ")))


def alert_level(percent: Column, warn: int, critical: int) -> Column:
    """0, 1 or 2; the thresholds are held to 1..100 and the critical one to at least the other."""
    warn = min(100, max(1, warn))
    critical = max(warn, min(100, max(1, critical)))
    return F.when(percent >= critical, 2).when(percent >= warn, 1).otherwise(0)


def period_key(kind: Column, reset_ms: Column) -> Column:
    """Kind and reset time rounded to five minutes, so that small drifts of the reset keep the key; '-' without one."""
    return F.concat(kind, F.lit("@"), F.coalesce(F.floor((reset_ms + 150_000) / 300_000).cast("string"), F.lit("-")))


def masked(value: Column) -> Column:
    """All but the last characters hidden: four stay of ten or more, else two, none of a value hardly longer."""
    bare = F.regexp_replace(value, r"[\s\-()]", "")
    keep = F.when(F.length(bare) >= 10, 4).otherwise(2)
    return F.when(F.length(bare) <= keep + 2, F.lit("****")).otherwise(F.concat(F.lit("****"), F.right(bare, keep)))


def annotation_text(text: Column) -> Column:
    """Escapes the text of a workflow annotation."""
    return F.replace(F.replace(F.replace(text, F.lit("%"), F.lit("%25")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def annotation_property(text: Column) -> Column:
    return F.replace(F.replace(annotation_text(text), F.lit(":"), F.lit("%3A")), F.lit(","), F.lit("%2C"))


def markdown_cell(text: Column) -> Column:
    """Text that doesn't break a Markdown table's cell."""
    return F.regexp_replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|")), r"[\r\n]+", " ")


def word_set(text: Column, stop: list[str]) -> Column:
    """Distinct words of letters and digits in lower case, without stop words and plain numbers."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: ~w.rlike("^[0-9]+$") & ~w.isin(stop)))


def overlap(a: Column, b: Column) -> Column:
    """Overlap coefficient of two sets, 0 if either is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(F.lit(0.0))
