"""Rule sets made whole: fields of a clause that follow from others are written anew, whatever stood there.

Clauses are rows (book, clause, approved_laws, law_phrases, preferred_law, max_term_years) with any other columns. Of the governing
law the wording follows from the approved laws, of the term from the greatest number of years; other clauses, and a
governing law without approved laws, keep what they have."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchmill.functions.scalar import year_label
from parchmill.functions.text import joined_with_and

# Fixed values.
GOVERNING_LAW, TERM = "governing_law", "term_and_survival"
DERIVED = {GOVERNING_LAW: ("preferred_position", "check_trigger"), TERM: ("preferred_position", "check_trigger")}
DEFAULT_YEARS = 5
LAW_POSITION = ("The governing law is one of the approved jurisdictions, preferably ", " unless the NDA context supports another approved option.")
LAW_LANGUAGE = ("This Agreement shall be governed by the laws of ", ".")
TERM_REQUIREMENT = ("The NDA term and ordinary confidentiality survival must be fixed at up to ", ".")
TERM_LANGUAGE = ("The confidentiality obligations survive for a fixed period of up to ", ", except for trade secrets or legal obligations that require a longer period.")
# End of the fixed values.


def derived_fields(clause: Column) -> Column:
    """The fields of a clause that an editor cannot change, for they are derived."""
    none = F.array().cast("array<string>")
    out = F.when(F.lit(False), none)
    for name, fields in DERIVED.items():
        out = out.when(clause == name, F.array(*map(F.lit, fields)))
    return out.otherwise(none)


def normalised(clauses: DataFrame) -> DataFrame:
    """clauses with approved_laws cleaned, preferred_law one of them (else the first), and the derived requirement,
    preferred_position and acceptable_language; these three stay as they were (or null) where nothing derives them."""
    laws = F.filter(F.transform(F.coalesce("approved_laws", F.array().cast("array<string>")), lambda x: F.trim(F.coalesce(x, F.lit("")))), lambda x: x != "")
    is_law = (F.col("clause") == GOVERNING_LAW) & (F.size("_laws") > 0)
    is_term = F.col("clause") == TERM
    preferred = F.when(F.array_contains("_laws", F.trim("preferred_law")), F.trim("preferred_law")).otherwise(F.get("_laws", F.lit(0)))
    years = F.coalesce(F.nullif(F.col("max_term_years"), F.lit(0)), F.lit(DEFAULT_YEARS))
    label = year_label(years, digits=True)
    months = F.concat(F.lit(" ("), (years * 12).cast("string"), F.lit(" months)"))
    phrase = F.transform("_laws", lambda x: F.coalesce(F.nullif(F.trim(F.element_at(F.coalesce("law_phrases", F.create_map().cast("map<string,string>")), x)), F.lit("")), x))
    around = lambda ends, middle: F.concat(F.lit(ends[0]), middle, F.lit(ends[1]))
    had = lambda name: F.col(name) if name in clauses.columns else F.lit(None).cast("string")
    rows = clauses.withColumn("_laws", laws).withColumn("_preferred", preferred)
    new = {
        "approved_laws": F.when(is_law, F.col("_laws")).otherwise(F.col("approved_laws")),
        "preferred_law": F.when(is_law, F.col("_preferred")).otherwise(F.col("preferred_law")),
        "requirement": F.when(is_term, around(TERM_REQUIREMENT, F.concat(label, months))).otherwise(had("requirement")),
        "preferred_position": F.when(is_law, around(LAW_POSITION, F.col("_preferred"))).otherwise(had("preferred_position")),
        "acceptable_language": F.when(is_law, around(LAW_LANGUAGE, joined_with_and(phrase, "or"))).when(is_term, around(TERM_LANGUAGE, label)).otherwise(had("acceptable_language")),
        "derived": derived_fields(F.col("clause")),
    }
    return rows.withColumns(new).drop("_laws", "_preferred")
