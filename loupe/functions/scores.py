"""Scores, grades and bands as column expressions.  NULL means unmeasured and never turns into 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Band edges of CRAP, and the sizes from which a test example smells.
LOW_CRAP, HIGH_CRAP = 5, 30
LARGE_LINES, MOCK_HEAVY, ASSERTION_HEAVY, HOT_SCORE = 30, 3, 10, 6.0
#: Allowances added to the limits of a run: seconds, bytes of output, bytes of memory.
TIME_ALLOWANCE, OUTPUT_ALLOWANCE, MEMORY_ALLOWANCE = 5, 16 << 20, 256 << 20


def rounded(value: Column, digits: int = 1) -> Column:
    """Half away from zero of the scaled value, which is not always what the value's decimal digits say."""
    return F.round(value * 10**digits) / 10**digits


def crap(complexity: Column, coverage: Column) -> Column:
    """complexity² · (1 − coverage)³ + complexity, with coverage from 0 to 1; NULL without coverage."""
    untested = 1 - coverage
    return complexity * complexity * untested * untested * untested + complexity


def band(value: Column) -> Column:
    return F.when(value.isNull(), "unknown").when(value <= LOW_CRAP, "low").when(value < HIGH_CRAP, "medium").otherwise("high")


def band_grade(low: Column, medium: Column, high: Column) -> Column:
    """1 to 10 from the share of risky functions; NULL if none is measured."""
    measured = low + medium + high
    risk = (high + 0.3 * medium) / F.when(measured > 0, measured)
    return F.when(measured > 0, rounded(10 - 9 * F.least(F.lit(1.0), 2 * risk)))  # least skips NULL


def crap_grade(worst: Column) -> Column:
    """1 to 10 from the worst CRAP of a module."""
    return F.when(worst <= LOW_CRAP, 10.0).when(worst >= HIGH_CRAP, 1.0).otherwise(rounded(10 - 9 * (worst - LOW_CRAP) / (HIGH_CRAP - LOW_CRAP)))


def mutation_grade(killed: Column, survived: Column) -> Column:
    judged = killed + survived
    return rounded(1 + 9 * killed / F.when(judged > 0, judged))


def overall_grade(crap_: Column, mutation: Column) -> Column:
    """The mean of both grades, or the one there is."""
    return F.when(crap_.isNotNull() & mutation.isNotNull(), rounded((crap_ + mutation) / 2)).otherwise(F.coalesce(crap_, mutation))


def grade_hue(grade: Column) -> Column:
    """Degrees from red (grade 1) to green (grade 10); null without a grade."""
    return F.when(grade.isNotNull(), F.round((F.least(F.lit(10.0), F.greatest(F.lit(1.0), grade)) - 1) / 9 * 130))


def example_score(lines: Column, decisions: Column, mocks: Column, assertions: Column) -> Column:
    """What a test example asks of its reader; 1 is the least."""
    score = 1.0 + F.greatest(F.lit(0), lines - 15) / 5 + 2.5 * decisions + 1.5 * F.greatest(F.lit(0), mocks - 2)
    return rounded(score + F.when(assertions == 0, 6).otherwise(0) + F.greatest(F.lit(0), assertions - ASSERTION_HEAVY) / 2)


def smells(lines: Column, decisions: Column, mocks: Column, assertions: Column) -> Column:
    """Names of what is wrong with an example, in a fixed order."""
    found = {"no-assertions": assertions == 0, "large": lines > LARGE_LINES, "logic": decisions > 0, "mock-heavy": mocks >= MOCK_HEAVY, "assertion-heavy": assertions > ASSERTION_HEAVY}
    return F.filter(F.array(*(F.when(c, name) for name, c in found.items())), lambda x: x.isNotNull())


def action(examples: Column, hot: Column, hot_groups: Column, mocked: Column, tables: Column, duplications: Column) -> Column:
    """What to do with a test file; the first rule that holds decides."""
    return (
        F.when((examples >= 25) & (hot_groups >= 3) & (hot >= 5), "MANUAL_SPLIT")
        .when((examples >= 4) & (mocked * 2 > examples), "REVIEW_FIRST")
        .when((hot > 0) | (duplications > 0), "AUTO_REFACTOR")
        .when(tables > 0, "AUTO_TABLE_DRIVE")
        .otherwise("LEAVE_ALONE")
    )


def verdict(delta: Column) -> Column:
    return F.when(delta <= -0.5, "improved").when(delta >= 0.5, "worse").otherwise("unchanged")


def limits(elapsed: Column, output: Column, memory: Column, measured: Column, factors: tuple[float, float, float]) -> dict[str, Column]:
    """Limits of a run from its baseline's use; no memory limit where memory wasn't measured."""
    return {
        "limit_seconds": elapsed * factors[0] + TIME_ALLOWANCE,
        "limit_output": (output * factors[1]).cast("bigint") + OUTPUT_ALLOWANCE,
        "limit_memory": F.when(measured, (memory * factors[2]).cast("bigint") + MEMORY_ALLOWANCE),
    }
