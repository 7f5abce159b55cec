"""Scalar and conditional column expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def number(column: str | Column, kind: str = "double") -> Column:
    """Coercing cast: what isn't a finite number is null."""
    value = F.col(column) if isinstance(column, str) else column
    cast = value.try_cast(kind)
    return F.when(~F.isnan(cast.cast("double")) & (F.abs(cast.cast("double")) < float("inf")), cast)


def strict_number(column: str, kind: str = "double") -> Column:
    """Number that must be well-formed and finite, and whole for an integral kind; null stays null."""
    value = number(column, "double")
    whole = F.lit(True) if kind in ("double", "float") else value == F.rint(value)
    failed = F.raise_error(F.concat(F.lit(f"{column} isn't a valid {kind}: "), F.col(column).cast("string")))
    return F.when(F.col(column).isNull() | (F.trim(F.col(column).cast("string")) == ""), None).when(
        value.isNotNull() & whole, value.cast(kind)).otherwise(failed.cast(kind))


def strict_flag(column: str) -> Column:
    """Boolean from true/1/yes and false/0/no in any case; anything else fails; null stays null."""
    text = F.lower(F.trim(F.col(column).cast("string")))
    return F.when(text.isNull(), None).when(text.isin("true", "1", "yes"), True).when(
        text.isin("false", "0", "no"), False).otherwise(F.raise_error(F.concat(F.lit(f"{column} isn't a flag: "), text)).cast("boolean"))


def lenient_flag(column: str) -> Column:
    """True for true, 1, 1.0 and yes, false for all else and null."""
    return F.coalesce(F.lower(F.trim(F.col(column).cast("string"))).isin("true", "1", "1.0", "yes"), F.lit(False))


def block_name(column: str) -> Column:
    """block-1, B1 and b1 as b1."""
    digits = F.regexp_extract(F.lower(F.trim(F.col(column).cast("string"))), r"^(?:block[-_ ]?|b)?0*(\d+)$", 1)
    return F.when(digits != "", F.concat(F.lit("b"), digits))


def padded_id(column: str, width: int = 3) -> Column:
    """Identifier with leading zeros; longer ones stay whole."""
    text = F.col(column).cast("string")
    return F.lpad(text, F.greatest(F.length(text), F.lit(width)), F.lit("0"))


def valid_rt(no_go: str, response: str, rt: str, least: float = 150) -> Column:
    return F.when((F.col(no_go) == 0) & (F.col(response) == 1) & (F.col(rt) >= least), F.col(rt))


def error_strict(correct: str) -> Column:
    """1 if known to be wrong; unknown counts as right."""
    return F.coalesce((F.col(correct) == 0).cast("int"), F.lit(0))


def error_lenient(correct: str) -> Column:
    """1 unless known to be right."""
    return (F.coalesce(F.col(correct), F.lit(0)) != 1).cast("int")


def guarded_log(value: Column) -> Column:
    return F.when(value > 0, F.log(value))


def rebuilt_count(rate: Column, n: Column) -> Column:
    """Count from a rate, rounded half to even, within 0 and n."""
    return F.least(F.greatest(F.rint(rate * n), F.lit(0.0)), n).cast("long")


def clipped_share(value: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest((value - low) / F.nullif(high - low, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))


def first_match(rules: Sequence[tuple[Column, str]], default: str | None = None) -> Column:
    """Label of the first rule that holds."""
    out = F.when(rules[0][0], rules[0][1])
    for rule, label in rules[1:]:
        out = out.when(rule, label)
    return out.otherwise(F.lit(default))


def band(value: Column, bands: Iterable[tuple[float, float, str]], closed_last: bool = False) -> Column:
    """Label of the half-open band of a value; the upper edge of the last one belongs to it if `closed_last`."""
    bands = list(bands)
    rules = [((value >= lo) & ((value <= hi) if closed_last and i == len(bands) - 1 else (value < hi)), label)
             for i, (lo, hi, label) in enumerate(bands)]
    return first_match(rules)


def flags(rules: Sequence[tuple[Column, str]]) -> Column:
    """Sorted list of the labels whose rule holds; empty if none."""
    return F.array_sort(F.array_compact(F.array(*[F.when(rule, F.lit(label)) for rule, label in rules])))


def reasons(rules: Sequence[tuple[Column, str]]) -> Column:
    """As `flags`, in the order of the rules and without repeats."""
    return F.array_distinct(F.array_compact(F.array(*[F.when(rule, F.lit(label)) for rule, label in rules])))


def harmonic_flags(reference: Column, value: Column, breath: Column, tolerance: float = 5) -> Column:
    """Which simple multiples of the reference or of the breath rate a value is near."""
    near = lambda target: F.abs(value - target) <= tolerance
    return flags([(near(reference / 2), "half"), (near(reference * 2), "double"),
                  (F.exists(F.array(F.lit(2), F.lit(3)), lambda k: F.abs(value - breath * k) <= tolerance), "breath")])


def switched_estimate(fused: Column, time: Column, spectral: Column, gap: float = 10) -> Column:
    """The time arm where the arms disagree, else the fused value."""
    return F.when(F.abs(time - spectral) > gap, time).otherwise(fused)


def severity(error: Column) -> Column:
    return first_match([(error <= 5, "le5"), (error <= 10, "le10"), (error <= 20, "le20"), (error > 20, "gt20")])


def all_finite(columns: Sequence[str]) -> Column:
    return F.forall(F.array(*[F.col(c).cast("double") for c in columns]),
                    lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def sigmoid(x: Column, clamp: float = 60) -> Column:
    return 1 / (1 + F.exp(-F.least(F.greatest(x, F.lit(-clamp)), F.lit(clamp))))


def decision(p: Column, high: float = 0.65, low: float = 0.35) -> Column:
    return F.when(p >= high, "positive").when(p <= low, "negative").otherwise("indeterminate")


def membership_digest(members: Column) -> Column:
    """Hash of a set of integers, whatever their order."""
    return F.sha2(F.array_join(F.transform(F.array_sort(members), lambda x: x.cast("string")), ","), 256)


def serial_date(days: Column) -> Column:
    """Date of a spreadsheet's serial day."""
    return F.date_add(F.to_date(F.lit("1899-12-30")), days.cast("int"))


FORBIDDEN = re.compile(r"(^|_)(hr|br|hrv|rmssd|sdnn|label|target)(_|$)", re.I)


def forbidden_predictors(names: Iterable[str]) -> list[str]:
    """Names that a predictor may not have."""
    return sorted(n for n in names if FORBIDDEN.search(n))


def has_text(text: Column, part: str) -> Column:
    """Whether a text holds a part; false for null."""
    return F.coalesce(F.contains(text, F.lit(part)), F.lit(False))


def has_pattern(text: Column, pattern: str) -> Column:
    """Whether a pattern is found in a text; false for null."""
    return F.coalesce(text.rlike(pattern), F.lit(False))


def masked(df: DataFrame, rule: Column, block: Sequence[str], zeroed: Sequence[str]) -> DataFrame:
    """`df` with the columns of a block null and its availability and quality 0 in the rows that the rule holds for."""
    kinds = {f.name: f.dataType for f in df.schema}
    return df.withColumns({c: F.when(~rule, F.col(c)) for c in block} | {c: F.when(rule, F.lit(0).cast(kinds[c])).otherwise(F.col(c)) for c in zeroed})
