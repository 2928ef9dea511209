"""Cleaning of raw activity records: names, measures, organisms, concentrations and units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandlake.functions.descriptors import molecular_weight
from strandlake.functions.scales import ALPHABET, FORBIDDEN, MAX_LENGTH, MIN_LENGTH, TOP_MAX_LENGTH, TOP_MIN_LENGTH

NONE, RIGHT, LEFT, INTERVAL = 0, 1, -1, 2

# Lists of words that decide a record's class.
GRAM_POSITIVE = ["staphylococcus", "enterococcus", "bacillus", "streptococcus", "listeria", "micrococcus", "clostridium", "lactobacillus", "corynebacterium", "mycobacterium", "propionibacterium"]
GRAM_NEGATIVE = ["escherichia", "pseudomonas", "klebsiella", "acinetobacter", "salmonella", "enterobacter", "serratia", "proteus", "shigella", "helicobacter", "campylobacter", "neisseria", "burkholderia", "yersinia", "vibrio", "haemophilus", "stenotrophomonas", "citrobacter", "moraxella", "legionella", "aeromonas"]
NON_BACTERIAL = ["candida", "aspergillus", "cryptococcus", "fusarium", "saccharomyces", "trichophyton", "hiv", "influenza", "herpes", "virus", "leishmania", "plasmodium", "trypanosoma", "cell line", "hela", "hek"]
RESISTANT = ["atcc 43300", "atcc 33591", "atcc baa-44", "mrsa", "mrse", "atcc 700603", "esbl", "vre", "atcc 51299", "atcc 700221", "carbapenem", "multidrug", "multi-drug", "resistant"]
CEILINGS = [10.0, 20.0, 25.0, 32.0, 50.0, 64.0, 100.0, 128.0, 150.0, 200.0, 250.0, 256.0, 300.0, 400.0, 500.0, 512.0, 1000.0]
MISSING = ["NA", "N/A", "ND", "NT", "-"]
MEASURES = ["MIC", "MIC50", "MIC90"]


def name_of(v: Column, path: str = "$") -> Column:
    """The name of an enum-like VARIANT at `path` of v: an object's `name`, else the value as text; '' where missing."""
    name, text = F.try_variant_get(v, f"{path}.name", "string"), F.try_variant_get(v, path, "string")
    # the schema is slow to make, so it is asked for only where the text may be that of an object without a name
    is_object = F.coalesce(F.schema_of_variant(F.try_variant_get(v, path, "variant")).startswith("OBJECT"), F.lit(False))
    return F.coalesce(name, F.when(text.startswith("{") & is_object, "").otherwise(text), F.lit(""))


def clean_sequence(s: Column) -> Column:
    """Trimmed, upper case; null unless 8 to 50 standard residues."""
    t = F.upper(F.trim(s))
    return F.when(t.rlike(f"^[{ALPHABET}]{{{MIN_LENGTH},{MAX_LENGTH}}}$"), t)


def library_feasible(s: Column) -> Column:
    return F.coalesce(s.rlike(f"^[{ALPHABET}]{{{MIN_LENGTH},{MAX_LENGTH}}}$"), F.lit(False))


def candidate_feasible(s: Column) -> Column:
    return library_feasible(s) & F.length(s).between(TOP_MIN_LENGTH, TOP_MAX_LENGTH) & ~s.contains(FORBIDDEN)


def is_measure(m: Column) -> Column:
    return F.translate(F.upper(m), " _", "").isin(MEASURES)


def _any(s: Column, words: list[str]) -> Column:
    return s.rlike("|".join(w.replace("-", "\\-") for w in words))


def gram_class(species: Column) -> Column:
    s = F.lower(species)
    return F.when(_any(s, NON_BACTERIAL), None).when(_any(s, GRAM_POSITIVE), "gram_positive").when(_any(s, GRAM_NEGATIVE), "gram_negative")


def is_resistant(species: Column) -> Column:
    return _any(F.lower(species), RESISTANT)


def is_modified(n_end: Column, c_end: Column) -> Column:
    return ~F.upper(n_end).isin("", "FREE", "NONE") | ~F.upper(c_end).isin("", "FREE", "NONE", "COOH")


def concentration(raw: Column) -> Column:
    """Struct (value, censor) of a concentration as text; value is null where it can't be read."""
    t = F.replace(F.trim(raw), F.lit(","), F.lit("."))
    nums = F.regexp_extract_all(t, F.lit("([0-9]+\\.?[0-9]*)"), F.lit(1))
    first = F.get(nums, 0).try_cast("double")
    pack = lambda v, c: F.struct(v.alias("value"), F.lit(c).alias("censor"))
    return (
        F.when(t.isNull() | (t == "") | F.upper(t).isin(MISSING), pack(F.lit(None).cast("double"), NONE))
        .when(t.rlike("^[>≥]"), pack(first, RIGHT)).when(t.rlike("^[<≤]"), pack(first, LEFT))
        .when(t.rlike("^[0-9]+\\.?[0-9]*\\s*[-–]\\s*[0-9]+\\.?[0-9]*$"), pack(F.get(nums, 1).try_cast("double"), INTERVAL))
        .otherwise(pack(F.when(F.size(nums) == 1, first), NONE))
    )


def with_ceiling(value: Column, censor: Column) -> Column:
    """A bare value at a usual highest test level is a lower bound."""
    return F.when((censor == NONE) & value.isin(CEILINGS), RIGHT).otherwise(censor)


def to_micromolar(value: Column, unit: Column, s: Column) -> Column:
    """Null for values that aren't positive and finite, and for unknown units."""
    u = F.translate(F.lower(F.trim(unit)), "μµ", "uu")
    # the mass stands in one place only, which keeps the generated code small
    times = F.when(u.isin("um", "umol/l", "micromolar", "nm", "nmol/l", "ng/ml", "ug/l"), 1.0).when(u.isin("mm", "mmol/l", "ug/ml", "mg/l", "microg/ml"), 1000.0).when(u.isin("mg/ml", "g/l"), 1e6)
    over = F.when(u.isin("nm", "nmol/l"), 1000.0).when(u.isin("ug/ml", "mg/l", "microg/ml", "mg/ml", "g/l", "ng/ml", "ug/l"), molecular_weight(s)).otherwise(1.0)
    return F.when((value > 0) & (value < float("inf")), value * times / over)
