"""Column expressions that repair and normalise raw incident fields. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the data model.
NOT_SET, NOT_AVAILABLE, MULTIPLE, UNKNOWN = "Not Set", "Not Available", "Multiple", "Unknown"
PLACEHOLDERS = {"NS": NOT_SET, "NA": NOT_SET, "N/A": NOT_SET, "": NOT_SET, "#N/B": NOT_AVAILABLE, "#MULTIVALUE": MULTIPLE}
CLOSURE_TRANSLATIONS = {"Overig": "Other", "Kwaliteit van de output": "Output quality"}
CLOSURE_CLASSES = {
    "software": "software_fix", "hardware": "hardware_fix", "data": "data_fix", "user error": "user_or_operator",
    "operator error": "user_or_operator", "user manual not used": "user_or_operator", "no error - works as designed": "no_fault_found",
    "inquiry": "information_or_referral", "questions": "information_or_referral", "referred": "information_or_referral",
}
IMPACT_SCOPE = {"1": "organization-wide", "2": "department", "3": "team", "4": "limited (few users)", "5": "minimal (single user)"}
PRIORITY_SEVERITY = {"1": "critical", "2": "high", "3": "medium", "4": "low", "5": "planning"}


def lookup(c: Column, table: dict[str, str], default: Column | None = None) -> Column:
    """A small dictionary as a map literal; what it doesn't hold becomes the default, or null."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    found = F.try_element_at(F.create_map(*pairs), c)
    return found if default is None else F.coalesce(found, default)


def source_of(present: Column, origin: str) -> Column:
    return F.when(present, F.lit(origin)).otherwise(F.lit("missing"))


def parse_dayfirst(c: Column) -> Column:
    """Timestamps written d/m/yyyy H:MM or dd-mm-yyyy HH:MM; anything else is null."""
    return F.coalesce(F.try_to_timestamp(c, F.lit("d/M/yyyy H:mm")), F.try_to_timestamp(c, F.lit("d-M-yyyy H:mm")))


def classify_duration(c: Column) -> Column:
    s = F.trim(c)
    return (
        F.when(c.isNull(), "missing").when(s.rlike(r"^\d{1,3}(,\d{2,3}){2,}$"), "corrupted_digit_grouping")
        .when(s.rlike(r"^\d+,\d+$"), "decimal_comma").otherwise("unparseable")
    )


def decimal_comma(c: Column) -> Column:
    s = F.trim(c)
    return F.when(s.rlike(r"^\d+,\d+$"), F.replace(s, F.lit(","), F.lit(".")).try_cast("double"))


def placeholder(c: Column) -> Column:
    return lookup(F.trim(c), PLACEHOLDERS, F.trim(c))


def itil_level(c: Column) -> Column:
    """'1' to '5', or Not Set and its like."""
    s = F.trim(c)
    digit = F.nullif(F.regexp_extract(s, r"^(\d)(\.0)?(\s*-.*)?$", 1), F.lit(""))
    return F.coalesce(lookup(s, PLACEHOLDERS), digit, F.lit(NOT_SET))


def closure_class(c: Column) -> Column:
    return F.when(c.isNull() | (c == ""), UNKNOWN).otherwise(lookup(F.lower(c), CLOSURE_CLASSES, F.lit("unspecified")))


def priority_consistent(impact: Column, urgency: Column, priority: Column) -> Column:
    """priority = least(impact, urgency), skipping levels that aren't set; null if there is nothing to compare."""
    return priority.try_cast("double") == F.least(impact.try_cast("double"), urgency.try_cast("double"))


def hours_between(a: Column, b: Column) -> Column:
    return (F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))) / F.lit(3.6e9)


def days_between(a: Column, b: Column) -> Column:
    return (F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))) / F.lit(8.64e10)


def outcome_factor(reopened: Column, reassignments: Column) -> Column:
    return F.when(reopened.isNull(), 0.85).when(reopened, 0.5).when(reassignments >= 5, 0.75).otherwise(1.0)


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.upper(c), "[^A-Z0-9]+", "-"), "^-+|-+$", "")
