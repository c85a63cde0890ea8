r"""Personal data in texts, with Spark's own functions only.

A regular expression per kind proposes spans, leftmost and without overlap; a validator confirms them (parts of an
address, Luhn's sum, mod 97, number of digits), and words nearby raise or lower the score. Spans count code points from
0, the end is exclusive. The kinds email, ip, card and phone are always reported when confirmed; `iban`, which this
operator adds, when its score reaches `threshold`. A match that is not confirmed is dropped and not tried again from
inside.

The expressions are written so that the JVM neither backtracks over long runs nor nests calls: a run of characters is
taken as a whole, and it is entered at its beginning or where the match before ended (`\G`). Card numbers are looked for
after every blank or hyphen which does not stand between two digits has been replaced by another character.

NULL counts as empty, with no spans; repeated rows each get their result; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatesift.functions.cards import luhn_valid
from gatesift.functions.expr import let
from gatesift.llm.common import plain, text_or_empty

NEAR = 40  # characters before and after a span, within the text between it and the next of its kind
RAISE, LOWER = 0.3, 0.3


def digits(value: Column) -> Column:
    return F.char_length(F.regexp_replace(value, "[^0-9]", ""))


def address_parts(value: Column) -> Column:
    small = lambda p: let(F.regexp_replace(p, "^0+(?=[0-9])", ""), lambda d: (F.char_length(d) <= 3) & (F.substring(d, 1, 3).cast("int") <= 255))
    return F.forall(F.split(value, r"\."), small)


def card_number(value: Column) -> Column:
    return digits(value).between(14, 19) & luhn_valid(value)


def mod_97(value: Column) -> Column:
    """An account number whose first four characters, moved to the end, leave 1: letters count 10 to 35."""

    def rest(v: Column) -> Column:
        moved = F.concat(F.substring(v, F.lit(5), F.char_length(v)), F.substring(v, 1, 4))
        number = lambda c: F.when(c >= "A", F.ascii(c) - 55).otherwise(F.ascii(c) - 48)
        step = lambda a, c: (a * F.when(c >= "A", 100).otherwise(10) + number(c)) % 97
        return F.aggregate(F.split(moved, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise(step(a, c)))

    return let(F.replace(value, F.lit(" "), F.lit("")), lambda v: (rest(v) == 1) & F.char_length(v).between(15, 34))


@dataclass(frozen=True)
class Kind:
    """Expression, validator, score of a confirmed span, words that raise or lower it; `screen` is needed for any match."""

    name: str
    regex: str
    valid: Callable[[Column], Column]
    score: float
    raising: str
    lowering: str
    screen: Callable[[Column], Column]
    base: bool = True
    prepared: Callable[[Column], Column] = lambda text: text


SINGLE = r"[ -](?![0-9])|(?<![0-9])[ -]"  # blanks and hyphens that are not between two digits
KINDS = (
    Kind(
        "email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda v: F.lit(True), 0.9,
        "mail|contact|write|reach", "example|sample", lambda t: F.contains(t, F.lit("@")),
    ),
    Kind(
        "ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", address_parts, 0.6, r"\bip\b|address|host|server|login",
        "version|release|section|chapter", lambda t: F.rlike(t, F.lit(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]")),
    ),
    Kind(
        "card", "[0-9][0-9 -]+", card_number, 0.7, "card|credit|visa|master|amex|pay|expir", "order|invoice|serial|isbn|tracking",
        lambda t: F.rlike(t, F.lit("[0-9](?:[ -]?[0-9]){13}")), prepared=lambda t: F.regexp_replace(t, SINGLE, "\u0001"),
    ),
    Kind(
        "phone", r"\+[0-9][ ().0-9-]+[0-9]", lambda v: digits(v).between(10, 15), 0.6, "phone|tel|call|mobile|fax|whatsapp|contact",
        "total|sum|score", lambda t: F.contains(t, F.lit("+")),
    ),
    Kind(
        "iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])", mod_97, 0.6,
        "iban|account|bank|transfer|konto|compte|cuenta", "serial|licen|part", lambda t: F.rlike(t, F.lit("[A-Z]{2}[0-9]{2}[ A-Z0-9]")), base=False,
    ),
)


def _proposed(kind: Kind, rank: int) -> Column:
    """Confirmed spans of a kind: places follow from the lengths of the matches and of the texts between them."""
    between, hits = F.col(f"_between_{kind.name}"), F.col(f"_hits_{kind.name}")
    none = F.array().cast("array<struct<start:int,rank:int,end:int,value:string,near:string>>")
    state = F.struct(F.lit(0).alias("i"), F.lit(0).alias("at"), none.alias("out"))

    def step(s: Column, hit: Column) -> Column:
        before, after = F.get(between, s["i"]), F.get(between, s["i"] + 1)
        start = s["at"] + F.char_length(before)
        span = F.struct(
            start.alias("start"), F.lit(rank).alias("rank"), (start + F.char_length(hit)).alias("end"), hit.alias("value"),
            F.lower(F.concat(F.right(before, F.lit(NEAR)), F.lit(" "), F.left(after, F.lit(NEAR)))).alias("near"),
        )
        return F.struct((s["i"] + 1).alias("i"), (start + F.char_length(hit)).alias("at"), F.concat(s["out"], F.array(span)).alias("out"))

    spans = F.aggregate(hits, state, step, lambda s: s["out"])
    score = lambda near: (
        F.lit(kind.score) + F.when(F.rlike(near, F.lit(kind.raising)), RAISE).otherwise(0.0) - F.when(F.rlike(near, F.lit(kind.lowering)), LOWER).otherwise(0.0)
    )
    scored = F.transform(
        F.filter(spans, lambda s: kind.valid(s["value"])),
        lambda s: F.struct(
            s["start"], s["rank"], s["end"], F.lit(kind.name).alias("kind"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), score(s["near"]))).alias("score")
        ),
    )
    return F.when(F.size(hits) > 0, scored).otherwise(F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,score:double>>"))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """Per row of `docs`: id, `spans` (start, rank, end, kind, score) ordered by start and kind, `base_spans` of the base kinds."""
    rows = plain(docs, id_col, text_col).select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"))
    rows = rows.select("_id", "_text", *[F.when(k.screen(F.col("_text")), k.prepared(F.col("_text"))).alias(f"_for_{k.name}") for k in kinds])
    rows = rows.select(
        "_id",
        *[F.split(f"_for_{k.name}", k.regex, -1).alias(f"_between_{k.name}") for k in kinds],
        *[F.regexp_extract_all(f"_for_{k.name}", F.lit(k.regex), F.lit(0)).alias(f"_hits_{k.name}") for k in kinds],
    )
    found = rows.select("_id", *[_proposed(k, i).alias(k.name) for i, k in enumerate(kinds)])
    base = F.array_sort(F.concat(*[F.col(k.name) for k in kinds if k.base]))
    more = [F.filter(k.name, lambda s: s["score"] >= threshold) for k in kinds if not k.base]
    found = found.select("_id", base.alias("base_spans"), *[c.alias(f"_more_{i}") for i, c in enumerate(more)])
    spans = F.array_sort(F.concat("base_spans", *[F.col(f"_more_{i}") for i in range(len(more))])) if more else F.col("base_spans")
    return found.select(F.col("_id").alias(id_col), spans.alias("spans"), "base_spans")


def listed(spans: Column) -> Column:
    """`kind:start:end` of spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def counted(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")
