"""License notices in documents, with Spark's own functions only.

Words are runs of ASCII letters and digits in lower case. Templates fall into classes by length; a class of templates of
at most `stride` words is looked for in windows of twice as many, which begin every `stride` words, so every occurrence
lies inside a window. MinHash bands of a window retrieve templates; the number of bands of a class follows from the
smallest Jaccard similarity that a window may have with a contained template, so that a band agrees with a probability of
at least 1 - `miss`. Candidates are verified by the exact share of the template's shingles that the window holds.

A template of fewer than WORDS words is one shingle of its own length: it is held as a whole or not at all, so it is looked
up by that shingle instead of by bands. A template without any word is refused.

Two conditions that no match can fail spare work: a document must hold one of a few words without which less than the
wanted share of a template's shingles would be left (they are found from the templates), and a window one of the
templates' shingles. Templates are a bounded side: they are part of the plan.

NULL counts as empty; repeated rows each have their matches; documents without a match have no row; an empty table gives
an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gatesift.functions.expr import opaque
from gatesift.llm.common import plain, saved, text_or_empty
from gatesift.llm.license_texts import LINES, NOTICES

WORDS = 5
CONTAINMENT = 0.8
MISS = 1e-4
EVERY = {**NOTICES, **LINES}


def template_words(text: str) -> list[str]:
    return [w.lower() for w in re.findall("[A-Za-z0-9]+", text)]


def stride_of(words: int) -> int:
    return 1 << max(3, math.ceil(math.log2(words)))


def needed_words(templates: Mapping[str, str], share: float) -> list[str]:
    """Words of which a text must hold one if it holds `share` of the shingles of any template."""
    chosen: set[str] = set()
    for text in templates.values():
        words = template_words(text)
        width = min(WORDS, len(words))
        shingles = {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}
        while True:
            free = [s for s in shingles if not chosen & set(s)]
            if len(free) < share * len(shingles):
                break
            count = {w: sum(w in s for s in free) for s in free for w in s}
            chosen.add(max(count, key=lambda w: (len(w) > 4, count[w], len(w), w)))
    return sorted(chosen)


def band_settings(templates: Mapping[str, str], share: float, miss: float) -> dict[int, tuple[int, int]]:
    """Per stride the number of bands and of rows in a band, for the least similarity of a window with a contained template."""
    least: dict[int, float] = {}
    for text in templates.values():
        words = template_words(text)
        stride, shingles = stride_of(len(words)), len({tuple(words[i : i + WORDS]) for i in range(len(words) - WORDS + 1)})
        held = math.ceil(share * shingles)
        least[stride] = min(least.get(stride, 1.0), held / (2 * stride - WORDS + 1 + shingles - held))
    out = {}
    for stride, j in least.items():
        rows = 2 if j >= 0.3 else 1
        out[stride] = (math.ceil(math.log(miss) / math.log(1 - j**rows)), rows)
    return out


def shingle_hashes(words: str, width: int = WORDS) -> Column:
    """Hash of every shingle of an array of words, in order; none for fewer words than a shingle."""
    last = F.size(words) - width + 1
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice(words, i, width)))).otherwise(
        F.array().cast("array<bigint>")
    )


def bands(shingles: str, number: int, rows: int) -> Column:
    """Per band the hash of its minima over an array of shingles."""
    least = lambda j: F.array_min(F.transform(shingles, lambda h: F.xxhash64(h, j)))
    one = lambda b: F.xxhash64(b, *[least(b * rows + r) for r in range(rows)])
    return F.transform(F.sequence(F.lit(0), F.lit(number - 1)), one)


def templates_table(spark: SparkSession, templates: Mapping[str, str]) -> DataFrame:
    rows = [(name, template_words(text)) for name, text in templates.items() if len(template_words(text)) >= WORDS]
    df = spark.createDataFrame(rows, "license string, words array<string>").withColumn("shingles", F.array_distinct(shingle_hashes("words")))
    stride = F.create_map(*[F.lit(x) for name, words in rows for x in (name, stride_of(len(words)))])[F.col("license")] if rows else F.lit(8)
    return df.select("license", stride.alias("stride"), "shingles")


def short_table(spark: SparkSession, templates: Mapping[str, str]) -> DataFrame:
    """Templates of fewer than WORDS words, each the one shingle of its own length."""
    rows = [(name, template_words(text)) for name, text in templates.items() if len(template_words(text)) < WORDS]
    df = spark.createDataFrame(rows, "license string, words array<string>")
    return df.select("license", F.size("words").alias("width"), F.xxhash64("words").alias("shingle"))


def short_places(width: int, shingles: list[int]) -> Column:
    """Where one of these shingles of `width` words stands, in the column of all shingles of that width."""
    at = F.transform(f"_short{width}", lambda h, i: F.struct(F.lit(width).alias("width"), h.alias("shingle"), i.alias("place")))
    wanted = F.array(*[F.lit(h) for h in shingles]).cast("array<bigint>")
    return F.filter(at, lambda s: F.array_contains(wanted, s["shingle"]))


def scan_licenses(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: Mapping[str, str] = NOTICES, share: float = CONTAINMENT, miss: float = MISS,
) -> DataFrame:
    """A row per document and template found: id, `license`, `containment`, `start_word` of the best window, `window_words`."""
    spark = docs.sparkSession
    if wordless := [n for n, t in templates.items() if not template_words(t)]:
        raise ValueError(f"templates without words: {wordless}")
    known = {n: t for n, t in templates.items() if len(template_words(t)) >= WORDS}
    table = templates_table(spark, known)
    every = sorted({h for r in table.select("shingles").collect() for h in r[0]})
    settings = band_settings(known, share, miss)
    short = short_table(spark, templates)
    of_width: dict[int, list[int]] = {}
    for r in short.collect():
        of_width.setdefault(r["width"], []).append(r["shingle"])

    lowered = F.lower("_text")
    holds = F.lit(False)
    for word in needed_words(templates, share):
        holds = holds | F.contains(lowered, F.lit(word))
    rows = plain(docs, id_col, text_col).select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text")).filter(holds)
    # Each step stands behind a barrier: a filter above must not copy the step below into a lambda, once per element.
    words = F.transform(F.regexp_extract_all("_text", F.lit("[A-Za-z0-9]+"), F.lit(0)), F.lower)
    rows = rows.select("_id", F.monotonically_increasing_id().alias("_row"), opaque(words).alias("_words"))
    shorter = [opaque(shingle_hashes("_words", width)).alias(f"_short{width}") for width in of_width]
    rows = rows.select("_id", "_row", opaque(shingle_hashes("_words")).alias("_shingles"), *shorter)
    of_template = F.array(*[F.lit(h) for h in every]).cast("array<bigint>")
    places = F.filter(F.sequence(F.lit(0), F.size("_shingles") - 1), lambda i: F.array_contains(of_template, F.get("_shingles", i)))
    places = F.when(F.size("_shingles") > 0, places).otherwise(F.array().cast("array<int>"))
    lines = F.concat(F.array().cast("array<struct<width:int,shingle:bigint,place:int>>"), *[short_places(w, h) for w, h in of_width.items()])
    rows = rows.select("_id", "_row", "_shingles", opaque(places).alias("_places"), opaque(lines).alias("_lines"))
    rows = saved(rows.filter((F.size("_places") > 0) | (F.size("_lines") > 0)))

    # The window before the own one holds the line too, unless the line runs over its end.
    stride = stride_of(1)
    at = rows.select("_id", "_row", F.explode("_lines").alias("_at")).select("_id", "_row", "_at.*").join(F.broadcast(short), ["width", "shingle"])
    own = F.floor(F.col("place") / stride) * stride
    start = F.when((own >= stride) & (F.col("place") + F.col("width") <= own + stride), own - stride).otherwise(own).cast("int")
    found = at.select("_id", "_row", "license", F.lit(1.0).alias("containment"), start.alias("start"), F.lit(2 * stride).alias("window_words"))
    for stride, (number, per_band) in sorted(settings.items()):
        first = F.transform("_places", lambda p: (F.floor(p / stride) * stride).cast("int"))
        starts = F.filter(F.array_union(first, F.transform(first, lambda s: s - stride)), lambda s: s >= 0)  # noqa: B023
        windows = rows.select("_id", "_row", "_shingles", F.explode(starts).alias("start"))
        windows = windows.select("_id", "_row", "start", F.array_distinct(F.slice("_shingles", F.col("start") + 1, 2 * stride - WORDS + 1)).alias("_window"))
        keyed = windows.select("_id", "_row", "start", "_window", F.posexplode(bands("_window", number, per_band)).alias("band", "key"))
        own = table.filter(F.col("stride") == stride).select("license", F.col("shingles").alias("_template"))
        index = own.select("license", "_template", F.posexplode(bands("_template", number, per_band)).alias("_band", "_key"))
        matched = keyed.join(F.broadcast(index), (F.col("band") == F.col("_band")) & (F.col("key") == F.col("_key")))
        # A window and a template may agree in many bands: they are verified once.
        once = matched.groupBy("_row", "start", "license").agg(F.first("_id").alias("_id"), F.first("_window").alias("_window"), F.first("_template").alias("_template"))
        held = F.size(F.array_intersect("_window", "_template")) / F.size("_template")
        one = once.select("_id", "_row", "license", held.alias("containment"), "start", F.lit(2 * stride).alias("window_words")).filter(F.col("containment") >= share)
        found = found.unionByName(one)
    best = F.max(F.struct("containment", (-F.col("start")).alias("_back"), "window_words")).alias("b")
    result = found.groupBy("_row", "license").agg(F.first("_id").alias("_id"), best)
    return result.select(
        F.col("_id").alias(id_col), "license", F.col("b.containment").alias("containment"), (-F.col("b._back")).cast("bigint").alias("start_word"),
        F.col("b.window_words").cast("bigint").alias("window_words"),
    )


def oracle_sql() -> str:
    """The same matches without MinHash: every template against every window, short ones against every place."""
    quoted = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    values = ", ".join(f"('{n}', {stride_of(len(template_words(t)))}, {quoted(template_words(t))})" for n, t in EVERY.items())
    line = stride_of(1)
    return f"""
WITH templates(license, stride, w) AS (VALUES {values}),
template_shingles AS (
  SELECT DISTINCT license, stride, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT license, stride, w, unnest(range(1, len(w) - 3)) AS i FROM templates WHERE len(w) >= {WORDS})),
sizes AS (SELECT license, count(*) AS n FROM template_shingles GROUP BY license),
doc_words AS (SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+'), lambda x: lower(x)) AS w FROM documents),
doc_shingles AS (
  SELECT doc_id, i - 1 AS p, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM doc_words WHERE len(w) >= 5)),
hits AS (SELECT doc_id, license, stride, p, s FROM doc_shingles JOIN template_shingles USING (s)),
placed AS (
  SELECT doc_id, license, stride, s, p, unnest([p // stride * stride, p // stride * stride - stride]) AS start FROM hits),
held AS (
  SELECT doc_id, license, stride, start, count(DISTINCT s) AS k FROM placed WHERE start >= 0 AND p <= start + 2 * stride - 5 GROUP BY ALL),
lines AS (SELECT license, len(w) AS width, array_to_string(w, ' ') AS s FROM templates WHERE len(w) < {WORDS}),
line_places AS (
  SELECT doc_id, width, i - 1 AS p, array_to_string(w[i:i + width - 1], ' ') AS s
  FROM (SELECT doc_id, w, width, unnest(range(1, len(w) - width + 2)) AS i FROM doc_words, (SELECT DISTINCT width FROM lines) WHERE len(w) >= width)),
line_starts AS (SELECT doc_id, license, p, width, p // {line} * {line} AS own FROM line_places JOIN lines USING (width, s)),
good AS (
  SELECT doc_id, license, stride, start, k / n AS containment FROM held JOIN sizes USING (license) WHERE k / n >= {CONTAINMENT}
  UNION ALL
  SELECT doc_id, license, {line}, CASE WHEN own >= {line} AND p + width <= own + {line} THEN own - {line} ELSE own END, 1.0 FROM line_starts)
SELECT doc_id, license, containment, CAST(start AS BIGINT) AS start_word, CAST(2 * stride AS BIGINT) AS window_words
FROM good QUALIFY row_number() OVER (PARTITION BY doc_id, license ORDER BY containment DESC, start) = 1"""
