"""Record counts in free text and the base score they give."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from signalsieve.functions import fixed_values as fv
from signalsieve.functions.matching import let
from signalsieve.functions.text import ASCII_SPACE

# possessive: a unit never starts with a digit, comma or point, so giving digits back is useless
NUMBER = r"[0-9][0-9,.]*+"
# the digit is tested first: most characters fail there, before the costlier look-behind
WORD_STARTING_DIGIT = r"[0-9](?<![0-9A-Za-z_][0-9])"
NOT_WORD_AFTER = r"(?![0-9A-Za-z_])"


def _counted(units: list[str]) -> str:
    return rf"{WORD_STARTING_DIGIT}[0-9,.]*+{ASCII_SPACE}*+(?:{'|'.join(units)}){NOT_WORD_AFTER}"


# One pass over the text: a count and its unit are adjacent and both are whole words,
# so no two kinds of unit can claim the same digits.
COUNT_PHRASE = _counted(fv.BILLION_UNITS + fv.MILLION_UNITS + fv.THOUSAND_UNITS + fv.RECORD_NOUNS)


def _phrase_value(phrase: Column) -> Column:
    digits = F.regexp_extract(phrase, f"^{NUMBER}", 0)
    unit = F.regexp_extract(phrase, "[a-z]+$", 0)
    number = F.coalesce(F.replace(digits, F.lit(","), F.lit("")).try_cast("double"), F.lit(0.0))
    scale = (
        F.when(unit.isin(fv.BILLION_UNITS), 1e9)
        .when(unit.isin(fv.MILLION_UNITS), 1e6)
        .when(unit.isin(fv.THOUSAND_UNITS), 1e3)
        .otherwise(1.0)
    )
    return number * scale


def max_records(text: Column) -> Column:
    """R2: largest record count named in lower-cased text, -1 when there is none."""
    phrases = F.regexp_extract_all(text, F.lit(COUNT_PHRASE), F.lit(0))
    best = F.coalesce(F.array_max(F.transform(phrases, _phrase_value)), F.lit(0.0))
    # clamp while still a double: the cast would fail on larger values
    return let(
        best, lambda n: F.when(n <= 0, -1).otherwise(F.least(n, F.lit(float(fv.MAX_RECORDS))).cast("int"))
    )


def records_score(records: Column) -> Column:
    """Base score of a record count."""
    steps = [(records >= low, score) for low, score in fv.RECORD_SCORE_STEPS]
    first = F.when(*steps[0])
    return reduce(lambda acc, s: acc.when(*s), steps[1:], first).otherwise(fv.UNKNOWN_RECORDS_SCORE)
