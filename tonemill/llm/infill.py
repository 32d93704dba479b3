"""Fill-in-middle transformation by counted quantifiers.

A text is a row of units: runs of ASCII letters and single other characters. ``regexp_count`` gives their number n, a
hash of the id chooses two cuts a <= b among them, and one pattern per row, with possessive groups ``unit{a}`` and
``unit{b-a}``, captures prefix, middle and suffix in a single match, whose replacement is the output. Possessive
quantifiers are matched in a loop: nothing is tried twice and no stack grows with the text. All of it is a projection:
no shuffle, no Python, and the hash makes every row independent of partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNIT = r"[A-Za-z]+|[^A-Za-z]"
# possessive inside too: a unit never gives a letter back
_UNIT_GROUP = r"(?:[A-Za-z]++|[^A-Za-z])"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_FROM = 90  # hundredths of rows that are transformed
SPM_BELOW = 20  # hundredths of the transformed rows with the suffix first
OUTPUTS = ("n", "form", "prefix_chars", "middle_chars", "output")


def seeded_numbers(doc_id: Column, seed: int, count: int) -> list[Column]:
    """The first ``count`` groups of eight hex digits of sha256(``seed:doc_id``), as numbers; a null id is written as nothing."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(count)]


def fill_in_middle(docs: DataFrame, seed: int = 1, plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW) -> DataFrame:
    """All rows and columns of ``docs`` with ``n``, ``form``, ``prefix_chars``, ``middle_chars`` and ``output``.

    * ``form`` is ``plain`` for an empty or null text, a text that holds one of the three marks, and rows the hash leaves
      alone; the output is then the text (null: empty) and the two lengths are null. Else it is ``psm`` or ``spm``.
    * Lengths count code points. Rows with equal ids are cut by equal numbers, also where the id is null.
    * Very long texts are matched whole. An empty table gives an empty table. Columns that have the name of an output
      already are replaced; all others pass through.
    """
    kept = [c for c in docs.columns if c not in OUTPUTS]
    rows = docs.select(
        F.struct(*kept).alias("_row") if kept else F.lit(None).alias("_row"),
        F.coalesce(F.col("text"), F.lit("")).alias("_text"),
        *[h.alias(f"_h{i}") for i, h in enumerate(seeded_numbers(F.col("doc_id"), seed, 4), 1)],
    )
    rows = rows.withColumn("n", F.regexp_count("_text", F.lit(UNIT)).cast("long"))
    cut = [F.col(f"_h{i}") % (F.col("n") + 1) for i in (1, 2)]
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains(F.col("_text"), F.lit(mark))
    plain = (F.col("n") == 0) | marked | (F.col("_h3") % 100 >= plain_from)
    form = F.when(plain, "plain").when(F.col("_h4") % 100 < spm_below, "spm").otherwise("psm")
    rows = rows.select("_row", "_text", "n", F.least(*cut).alias("_a"), F.greatest(*cut).alias("_b"), form.alias("form"))
    pattern = F.format_string(
        rf"(?s)\A(%s{{%d}}+)(%s{{%d}}+)(.*)\z", F.lit(_UNIT_GROUP), F.col("_a"), F.lit(_UNIT_GROUP), F.col("_b") - F.col("_a")
    )
    shape = F.when(F.col("form") == "psm", f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2").otherwise(f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2")
    output = F.when(F.col("form") == "plain", F.col("_text")).otherwise(F.regexp_replace("_text", pattern, shape))
    rows = rows.select("_row", "n", "form", output.alias("output"))

    # A transformed text holds no mark of its own, and no mark can begin inside the one before it, so places are certain.
    def between(first: str, last: str) -> Column:
        return F.instr("output", F.lit(last)) - F.instr("output", F.lit(first)) - len(first)

    prefix = F.when(F.col("form") == "psm", between(PREFIX, SUFFIX)).when(F.col("form") == "spm", between(PREFIX, MIDDLE))
    middle = F.length("output") - F.instr("output", F.lit(MIDDLE)) - len(MIDDLE) + 1
    return rows.select(
        *[F.col("_row").getField(c).alias(c) for c in kept],
        "n",
        "form",
        prefix.cast("long").alias("prefix_chars"),
        F.when(F.col("form") != "plain", middle).cast("long").alias("middle_chars"),
        "output",
    )


def restore(output: Column, form: Column) -> Column:
    """The exact text from output and form alone."""
    psm = F.regexp_replace(output, F.lit(rf"(?s)\A{PREFIX}(.*?){SUFFIX}(.*?){MIDDLE}(.*)\z"), F.lit("$1$3$2"))
    spm = F.regexp_replace(output, F.lit(rf"(?s)\A{SUFFIX}(.*?){PREFIX}(.*?){MIDDLE}(.*)\z"), F.lit("$2$3$1"))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
