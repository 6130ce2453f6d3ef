"""Problem 1: text that looks the same in different characters comes out in one form.

Method: Arrow text is copied to code-point arrays; table gathers drop invisible characters and turn full-width
forms, kinds of blank and look-alike letters into the ordinary ones; expansion offsets write base letters and
marks apart, and vector passes put the marks in canonical order and compose them (``codepoints.canonical``).

Case, punctuation, the place of a tone mark and line breaks are visible and stay.  A null stays null, an empty or
blank text stays as it is.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from reedmill.functions.session import cut_lineage
from reedmill.llm.codepoints import canonical

FIELDS = ("title", "description", "content")
#: Parts over which the rows of one spelling are spread.
SALTS = 16


@F.arrow_udf(StringType())
def one_form(text: pa.Array) -> pa.Array:
    return canonical(text)


def unify(df: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """The same rows with the given text columns in one form; other columns are kept."""
    return df.withColumns({f: one_form(f) for f in fields})


def look_alikes(df: DataFrame, fields: tuple[str, ...] = FIELDS, key: str = "row_id") -> DataFrame:
    """Pairs (field, row_id_a, row_id_b) of rows whose field looks the same but is not the same characters.

    Blank fields take no part; a joiner inside an emoji counts as absent here, though ``unify`` keeps it.  Only
    fingerprints of the texts are shuffled.  Forms of a text that occur in one spelling only leave after a
    pre-aggregated count.  Spellings of a form are paired with their numbers of rows, not rows with rows: the rows of
    the rarer spelling are spread over ``SALTS`` parts each and meet those of the other there, so that the work is that
    of the pairs that come out, and a text in a third of all rows with one odd spelling is split.
    """
    shown = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("raw"), F.translate(one_form(f), "\u200d", "").alias("form")) for f in fields))
    # outer, as an inner one makes the optimiser filter by the list below, where the forms would be made once more
    rows = df.select(F.col(key).alias("row_id"), F.inline_outer(shown)).where(~F.coalesce(F.col("raw"), F.lit("")).rlike(r"^[\s\p{Z}\p{Cf}]*$"))
    # the fingerprints are written once and read twice
    rows = cut_lineage(rows.select("field", "row_id", F.struct(F.xxhash64("form").alias("f1"), F.xxhash64(F.lit(1), "form").alias("f2")).alias("form"), F.struct(F.xxhash64("raw").alias("r1"), F.xxhash64(F.lit(1), "raw").alias("r2")).alias("spelling")))
    form = ["field", "form"]
    several = rows.groupBy(*form).agg(F.min("spelling").alias("lo"), F.max("spelling").alias("hi")).where("lo <> hi").select(*form)
    varied = cut_lineage(rows.join(several, form, "left_semi").distinct())
    spellings = varied.groupBy(*form, "spelling").agg(F.struct(F.count("*").alias("n"), F.col("spelling")).alias("x")).select(*form, "x")
    pairs = spellings.join(spellings.withColumnRenamed("x", "y"), form).where("x < y").select(*form, F.col("x.spelling").alias("spelling"), F.col("y.spelling").alias("other"))
    few = varied.join(pairs, [*form, "spelling"]).select(*form, F.col("row_id").alias("a"), F.col("other").alias("spelling"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    many = varied.withColumn("salt", F.pmod(F.hash("row_id"), F.lit(SALTS)))
    both = few.join(many, [*form, "spelling", "salt"]).where("a <> row_id")
    return both.select("field", F.least("a", "row_id").alias("row_id_a"), F.greatest("a", "row_id").alias("row_id_b"))
