"""Cleaning of bilingual registry text."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# What the registry's cells and links look like.
BLANKS = r"[\s\x0b\x1c-\x1f\x85\p{Z}]+"
SIGNED_DECIMAL = r"([-+]?\d+(?:\.\d+)?)"
PORTAL_DATE = r"^\d{1,2}/\d{1,2}/\d{4}$"
DEVANAGARI_DIGITS = "०१२३४५६७८९"
LATIN_DIGITS = "0123456789"
DEVANAGARI_WORD_START = r" [अ-हक़-य़]"
BILINGUAL_STATUTORY_ORDER = (
    r"(?i)^(S\.O\.\s+\d+\s*\([A-Za-z]\))\s+S\.O\.\s+[०-९]+\s*\([A-Za-z]\)$"
)
TRAILING_DEVANAGARI_NUMBER = r"^([A-Za-z0-9()./\- ]+?)\s+[०-९]+$"
QUOTED_PAGE_LINK = r"(?i)['\"]([^'\"]+\.cshtml[^'\"]*)['\"]"
CLOSING_PUNCTUATION = r"['\" )]+$"


def collapse_blanks(value: Column) -> Column:
    """Turn every run of blanks, no-break spaces included, into one space; null stays null."""
    return F.trim(F.regexp_replace(value, BLANKS, " "))


def clean_text(value: Column) -> Column:
    return F.coalesce(collapse_blanks(value), F.lit(""))


def blank_to_null(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def first_decimal(value: Column) -> Column:
    """The first signed decimal in a text such as ``22 (ha)``, in Latin or Devanagari digits."""
    latin = F.translate(clean_text(value), DEVANAGARI_DIGITS, LATIN_DIGITS)
    return blank_to_null(F.regexp_extract(latin, SIGNED_DECIMAL, 1)).try_cast("double")


def parse_amount(value: Column) -> Column:
    """First signed decimal once thousands separators are gone."""
    return first_decimal(F.replace(value, F.lit(","), F.lit("")))


def portal_date_to_iso(value: Column) -> Column:
    """``dd/MM/yyyy`` to ``yyyy-MM-dd``; any other text is passed through cleaned."""
    text = clean_text(value)
    parsed = F.when(text.rlike(PORTAL_DATE), F.try_to_timestamp(text, F.lit("d/M/yyyy")))
    return F.coalesce(F.date_format(parsed, "yyyy-MM-dd"), text)


def normalise_header(value: Column) -> Column:
    return clean_text(F.replace(F.lower(value), F.lit(":"), F.lit("")))  # blanks around a colon meet once it is gone


def land_attribute(description: Column, attribute: str) -> Column:
    """Quoted value behind ``Land <attribute>:`` in a parcel description, else null."""
    found = F.regexp_extract(clean_text(description), rf'(?i)Land {attribute}\s*:\s*"([^"]+)"', 1)
    return blank_to_null(clean_text(found))


def survey_number(value: Column) -> Column:
    return F.split(clean_text(value), " ", 2).getItem(0)


def query_parameter(href: Column, name: str) -> Column:
    """Value of a query-string parameter in a relative or absolute link; '' if absent."""
    found = F.regexp_extract(href, rf"[?&]{re.escape(name)}=([^&]+)", 1)
    return F.coalesce(F.trim(found), F.lit(""))


def unwrap_link(href: Column) -> Column:
    """Take the page out of a script link and drop closing quotes and brackets."""
    text = F.trim(F.coalesce(href, F.lit("")))
    inner = F.coalesce(blank_to_null(F.regexp_extract(text, QUOTED_PAGE_LINK, 1)), text)
    return F.regexp_replace(F.replace(inner, F.lit("\\'"), F.lit("'")), CLOSING_PUNCTUATION, "")


def _comparable(words: Column) -> Column:
    return F.lower(F.translate(F.array_join(words, ""), DEVANAGARI_DIGITS, ""))


def gazette_number(value: Column) -> Column:
    """Keep one half of a gazette number that is printed once per language."""
    text = clean_text(value)
    words = F.split(text, " ")
    half = (F.size(words) / 2).cast("int")
    first, second = F.slice(words, F.lit(1), half), F.slice(words, half + 1, half)
    repeated = (text != "") & (F.size(words) % 2 == 0) & (_comparable(first) == _comparable(second))
    return (
        F.when(text.rlike(BILINGUAL_STATUTORY_ORDER), F.regexp_extract(text, BILINGUAL_STATUTORY_ORDER, 1))
        .when(text.rlike(TRAILING_DEVANAGARI_NUMBER), F.trim(F.regexp_extract(text, TRAILING_DEVANAGARI_NUMBER, 1)))
        .when(repeated, F.array_join(first, " "))
        .otherwise(text)
    )


def english_prefix(value: Column) -> Column:
    """Officer name up to its first Devanagari word."""
    return F.trim(F.split(clean_text(value), DEVANAGARI_WORD_START, 2).getItem(0))


# Wording shown to users for each model feature.
FEATURE_LABELS = {
    "file_pending_days": ("Administrative file pending", "Administrative"),
    "docs_complete_pct": ("Documentation completeness", "Administrative"),
    "docs_remaining_pct": ("Documentation completeness", "Administrative"),
    "pending_approvals_count": ("Pending approvals", "Administrative"),
    "court_cases_count": ("Legal dispute burden", "Legal"),
    "case_age_months": ("Case age", "Legal"),
    "title_disputes_parcels": ("Title dispute parcels", "Legal"),
    "grievances_30d": ("Recent grievance load", "Community / Grievance"),
    "grievance_redressal_days": ("Grievance resolution time", "Community / Grievance"),
    "disbursal_pct": ("Compensation disbursal", "Compensation"),
    "compensation_pending_cr": ("Compensation pending", "Compensation"),
    "compensation_awarded_cr": ("Compensation awarded", "Compensation"),
    "compensation_disbursed_cr": ("Compensation disbursed", "Compensation"),
    "rnr_progress_pct": ("R&R implementation progress", "Rehabilitation & Resettlement"),
    "rnr_consent_pct": ("R&R consent progress", "Rehabilitation & Resettlement"),
    "rnr_remaining_pct": ("R&R implementation progress", "Rehabilitation & Resettlement"),
    "days_in_current_stage": ("Time in current stage", "Administrative"),
    "days_since_project_start": ("Project elapsed time", "Administrative"),
    "land_acquisition_ratio": ("Land acquisition progress", "Land Acquisition"),
    "land_required_ha": ("Land requirement", "Land Acquisition"),
    "land_to_acquire_ha": ("Land to acquire", "Land Acquisition"),
    "total_parcels": ("Affected land parcels", "Land Acquisition"),
    "affected_families": ("Affected families", "Community / Grievance"),
    "vulnerable_families": ("Vulnerable families", "Community / Grievance"),
}
ONE_HOT_GROUPS = {
    "current_stage_": ("Current stage: ", "Administrative"),
    "approval_dept_": ("Approval department", "Administrative"),
    "terrain_type_": ("Terrain context", "Land Acquisition"),
    "urban_rural_": ("Settlement context", "Community / Grievance"),
}
DEFAULT_CATEGORY = "Administrative"


def _lookup(position: int) -> Column:
    return F.create_map(*[F.lit(v) for name, info in FEATURE_LABELS.items() for v in (name, info[position])])


def feature_label(feature: Column) -> Column:
    """Display label of a model feature; one-hot columns share their group's label."""
    label = F.when(_lookup(0)[feature].isNotNull(), _lookup(0)[feature])
    for prefix, (text, _) in ONE_HOT_GROUPS.items():
        named = F.concat(F.lit(text), F.replace(feature, F.lit(prefix), F.lit(""))) if text.endswith(" ") else F.lit(text)
        label = label.when(feature.startswith(prefix), named)
    return label.otherwise(F.initcap(F.trim(F.replace(feature, F.lit("_"), F.lit(" ")))))


def feature_category(feature: Column) -> Column:
    category = F.when(_lookup(1)[feature].isNotNull(), _lookup(1)[feature])
    for prefix, (_, group) in ONE_HOT_GROUPS.items():
        category = category.when(feature.startswith(prefix), F.lit(group))
    return category.otherwise(F.lit(DEFAULT_CATEGORY))
