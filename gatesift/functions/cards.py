"""Card numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gatesift.functions.expr import let


def luhn_valid(text: Column) -> Column:
    """13 to 19 digits, whatever stands between them, whose check digit is right."""

    def checked(d: Column) -> Column:
        def digit(i: Column) -> Column:
            value = F.substring(d, -i, F.lit(1)).cast("int")
            return F.when(i % 2 == 0, 2 * value - F.when(value > 4, 9).otherwise(0)).otherwise(value)

        total = F.aggregate(F.sequence(F.lit(1), F.char_length(d)), F.lit(0), lambda s, i: s + digit(i))
        return F.when(F.char_length(d).between(13, 19), total % 10 == 0).otherwise(F.lit(False))

    return let(F.regexp_replace(text, "[^0-9]", ""), checked)


def tokenize_card(text: Column) -> Column:
    """`XXXX-XXXX-XXXX-` and the last four digits; all X for fewer than four digits."""

    def token(d: Column) -> Column:
        return F.when(F.char_length(d) < 4, F.lit("XXXX-XXXX-XXXX-XXXX")).otherwise(
            F.concat(F.lit("XXXX-XXXX-XXXX-"), F.substring(d, -4, 4))
        )

    return let(F.regexp_replace(text, "[^0-9]", ""), token)
