"""Text normalization, identifiers, labels and coercions as column expressions."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Markers in a path that give a label, tested in this order.
PATHOLOGICAL_MARKERS = ("pathol", "pathological", "patologico", "patologicos", "patologica", "patologicas", "patolog")
HEALTHY_MARKERS = ("normal", "normales", "healthy")
# Group keys that count as healthy.
HEALTHY_GROUPS = ("healthy", "normal", "normale", "normales", "gesund", "gesunde", "stimmgesunde")
# Codes of sex in the two sources.  M is female in the first and male in the second.
SEX_CODES_1 = {"H": "male", "M": "female"}
SEX_CODES_2 = {"m": "male", "w": "female"}
# Columns of the two metadata sources and their names here.
COLUMNS_1 = {
    "Archivo": "metadata_filename", "Fs": "metadata_fs", "Tipo": "audio_type", "EGG": "egg", "edad": "age", "sexo": "sex", "G": "grbas_g", "R": "grbas_r",
    "A": "grbas_a", "B": "grbas_b", "S": "grbas_s", "Total": "grbas_total", "Codigo": "pathology_code", "Patología": "pathology", "F0": "f0_metadata",
    "F1": "f1_metadata", "F2": "f2_metadata", "F3": "f3_metadata", "Formantes": "formants_quality", "Picos": "peaks_quality", "Jitter": "jitter_quality",
    "Comentarios": "comments",
}
COLUMNS_2 = {
    "AufnahmeID": "recording_id", "AufnahmeTyp": "recording_type", "AufnahmeDatum": "recording_date", "Diagnose": "diagnosis", "SprecherID": "speaker_id",
    "Geburtsdatum": "birth_date", "Geschlecht": "sex", "Pathologien": "pathology",
}
#: Stands for a null where a null must differ from any value.
NA = "<NA>"
SEPARATOR = " | "


#: What counts as white space at the ends of a text.
BLANK = "[\\s\\x1c-\\x1f\\x85\\p{Z}]"


def strip(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(c, f"^{BLANK}+|{BLANK}+$", "")


def _folded() -> tuple[str, str, dict[str, str]]:
    """Characters whose compatibility decomposition, without combining marks, is one other character, and that
    character; and those with a longer one, where a letter or digit of ASCII is in it."""
    one, many = [], {}
    for point in range(0x80, sys.maxunicode + 1):
        c = chr(point)
        base = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if base == c or 0xD800 <= point < 0xE000:
            continue
        if len(base) == 1:
            one.append((c, base))
        elif any(x.isascii() and x.isalnum() for x in base):
            many[c] = base
    return "".join(a for a, _ in one), "".join(b for _, b in one), many


_ACCENTED, _PLAIN, _LONGER = _folded()


def strip_accents(c: Column) -> Column:
    """Compatibility forms and accents folded: one character each by translate(), and ligatures, fractions and
    the like character by character in the texts that have any."""
    folded = F.translate(c, _ACCENTED, _PLAIN)
    longer = F.create_map(*[F.lit(x) for pair in _LONGER.items() for x in pair])
    each = F.array_join(F.transform(F.split(folded, ""), lambda x: F.coalesce(longer[x], x)), "")
    has = folded.rlike("[^\\x00-\\x7F]") & (F.length(F.translate(folded, "".join(_LONGER), "")) < F.length(folded))
    return F.when(has, each).otherwise(folded)


def slugify(c: Column) -> Column:
    """Lower case, runs of other characters than a-z and 0-9 become one underscore, none at the ends."""
    s = F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), "[^a-z0-9]+", "_")
    return F.regexp_replace(s, "^_+|_+$", "")


def normalize_text(c: Column) -> Column:
    """slugify after folding accents; null becomes empty."""
    return slugify(strip_accents(F.lower(F.trim(F.coalesce(c, F.lit(""))))))


def normalize_recording_id(c: Column) -> Column:
    """Trimmed, without a closing ``.0``; null becomes empty."""
    return F.regexp_replace(strip(F.coalesce(c, F.lit(""))), "\\.0$", "")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), "(?<=.)\\.[^.]*$", "")


def normalize_filename_key(path: Column) -> Column:
    return F.coalesce(normalize_text(file_stem(path)), F.lit(""))


def sample_id(prefix: str, relative_path: Column) -> Column:
    """prefix_ and the normalized path without its suffix."""
    return F.concat(F.lit(f"{prefix}_"), normalize_text(F.regexp_replace(relative_path, "(?<=[^/])\\.[^./]*$", "")))


def canonical_id_of_key(prefix: str, *parts: Column) -> Column:
    return F.concat_ws("_", F.lit(prefix), *parts)


def canonical_id_of_hash(prefix: str, digest: Column) -> Column:
    return F.concat(F.lit(f"{prefix}_"), F.substring(digest, 1, 16))


def label_from_path(path: Column, pathological: Sequence[str] = PATHOLOGICAL_MARKERS, healthy: Sequence[str] = HEALTHY_MARKERS) -> Column:
    """pathological if any of its markers is in the normalized path, else healthy likewise, else null."""
    whole = normalize_text(path)
    return F.when(whole.rlike("|".join(pathological)), "pathological").when(whole.rlike("|".join(healthy)), "healthy")


def label_from_group(key: Column, healthy: Sequence[str] = HEALTHY_GROUPS) -> Column:
    return F.when(key.isin(*healthy), "healthy").otherwise("pathological")


def parse_vowel_filename(name: Column) -> Column:
    """struct<recording_id, vowel, condition> of ``<id>-<a|i|u>_<h|l|lhl|n>.nsp`` or ``<id>-iau.nsp``, else null."""
    low = F.lower(strip(name))
    single, sequence = "^([0-9]+)-([aiu])_(h|lhl|l|n)\\.nsp$", "^([0-9]+)-iau\\.nsp$"
    one = F.struct(*[F.regexp_extract(low, single, i).alias(n) for i, n in ((1, "recording_id"), (2, "vowel"), (3, "condition"))])
    all_ = F.struct(F.regexp_extract(low, sequence, 1).alias("recording_id"), F.lit("iau").alias("vowel"), F.lit("sequence").alias("condition"))
    return F.when(low.rlike(single), one).when(low.rlike(sequence), all_)


def to_number(c: Column) -> Column:
    """Bad numbers and NaN become null."""
    n = c.try_cast("double")
    return F.when(~F.isnan(n), n)


def safe_float(c: Column) -> Column:
    """NaN, infinities and what can't be cast become null."""
    n = c.try_cast("double")
    return F.when(~F.isnan(n) & (F.abs(n) != float("inf")), n)


def age_at(recorded: Column, born: Column) -> Column:
    """Years with one decimal (half to even); a bad date gives null."""
    return F.bround(F.datediff(F.try_to_date(recorded), F.try_to_date(born)) / F.lit(365.2425), 1)


def recode(c: Column, codes: Mapping[str, str], ignore_case: bool = False) -> Column:
    """Values in codes are replaced and others kept."""
    key = F.lower(F.trim(c)) if ignore_case else c
    pairs = [F.lit(x) for k, v in codes.items() for x in (k.lower() if ignore_case else k, v)]
    return F.coalesce(F.create_map(*pairs)[key], c)


def missing(c: Column) -> Column:
    """Null or blank."""
    return c.isNull() | (strip(c) == "")


def observed(name: str, c: Column) -> Column:
    """``name=value``, with <NA> for null."""
    return F.concat(F.lit(f"{name}="), F.coalesce(c.cast("string"), F.lit(NA)))


def below(name: str, c: Column, least: float) -> Column:
    """``name=value; minimum_name=least``."""
    return F.concat(F.lit(f"{name}="), c.cast("string"), F.lit(f"; minimum_{name}={least:g}"))


def binary_target(label: Column, positive: str = "pathological") -> Column:
    return (label == positive).cast("int")


def stratum_key(c: Column, target: Column) -> Column:
    return F.concat_ws("::", c, F.concat(F.lit("target="), target.cast("string")))


def pooled_group(base: Column, speaker: Column) -> Column:
    return F.concat_ws("::", base, speaker)


def join_distinct(c: Column, separator: str = SEPARATOR) -> Column:
    """Aggregate: distinct non-blank trimmed values, sorted by lower case and then the value, joined."""
    held = F.filter(F.collect_set(F.trim(c)), lambda x: x != "")
    ranked = F.array_sort(F.transform(held, lambda x: F.struct(F.lower(x).alias("k"), x.alias("v"))))
    return F.array_join(F.transform(ranked, lambda s: s["v"]), separator)
