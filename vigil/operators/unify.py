"""The unified incident schema: an event log's raw strings become typed, provenance-tagged columns in one projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions import clean

# Provenance classes, and the groups, categories and teams of configuration items.
PROVENANCE = ("original", "derived", "synthetic", "missing")
SUBCATEGORY_GROUP = {
    "Server Based Application": "app_server", "Web Based Application": "app_web", "Desktop Application": "app_desktop", "Client Based Application": "app_desktop",
    "Standard Application": "app_desktop", "SAP": "sap", "Citrix": "citrix_vdi", "VDI": "citrix_vdi", "Exchange": "collab", "SharePoint Farm": "collab",
    "Laptop": "enduser_hw", "Desktop": "enduser_hw", "Monitor": "enduser_hw", "Keyboard": "enduser_hw", "Printer": "enduser_hw", "Scanner": "enduser_hw",
    "KVM Switches": "enduser_hw", "Banking Device": "banking_device", "SAN": "storage", "Database": "database", "Windows Server": "server", "Linux Server": "server",
    "Unix Server": "server", "X86 Server": "server", "ESX Cluster": "server", "zOS Cluster": "server", "NonStop Server": "server", "DataCenterEquipment": "server",
    "Network Component": "network", "Switch": "network", "Router": "network", "Lines": "network", "Net Device": "network", "Controller": "network",
    "Encryption": "security_sw", "System Software": "security_sw", "Automation Software": "security_sw",
}
GROUP_CATEGORY = {
    "app_server": "Application", "app_web": "Application", "app_desktop": "Application", "sap": "Application", "citrix_vdi": "Application", "collab": "Application",
    "enduser_hw": "Hardware", "banking_device": "Hardware", "storage": "Storage", "database": "Database", "server": "Infrastructure", "network": "Network", "security_sw": "Security",
}
GROUP_TEAM = {
    "app_server": "Application Support", "app_web": "Application Support", "app_desktop": "Workplace Applications", "sap": "SAP Competence Center",
    "citrix_vdi": "Workplace Virtualization", "collab": "Messaging & Collaboration", "enduser_hw": "Workplace Hardware", "banking_device": "Branch Devices",
    "storage": "Storage Engineering", "database": "Database Administration", "server": "Server Operations", "network": "Network Operations", "security_sw": "Security Operations",
}


def from_event_log(df: DataFrame, file_name: str) -> DataFrame:
    """df: the raw log, all strings. Durations, classes and routing are derived; every field says where it came from."""
    c = F.col
    known = lambda x: clean.source_of(x != clean.UNKNOWN, "derived")
    number = lambda n: c(n).try_cast("double")
    step = df.select(
        c("Incident_ID").alias("incident_id"), F.lit("B_event_log").alias("source"), F.lit(file_name).alias("source_file"), c("Category").alias("ticket_type"),
        c("CI_Name").alias("ci_name"), F.coalesce("CI_Cat", F.lit(clean.UNKNOWN)).alias("ci_category"), clean.source_of(c("CI_Cat").isNotNull(), "original").alias("ci_category_source"),
        F.coalesce("CI_Subcat", F.lit(clean.UNKNOWN)).alias("ci_subcategory"), clean.lookup(c("CI_Subcat"), SUBCATEGORY_GROUP, F.lit("other")).alias("ci_group"), c("WBS").alias("wbs"),
        *[clean.itil_level(c(n)).alias(n.lower()) for n in ("Impact", "Urgency", "Priority")], c("Status").alias("status"), c("Closure_Code").alias("closure_code_original"),
        F.coalesce(clean.lookup(c("Closure_Code"), clean.CLOSURE_TRANSLATIONS, c("Closure_Code")), F.lit(clean.NOT_SET)).alias("closure_code"),
        *[clean.parse_dayfirst(c(n)).alias(n.lower()) for n in ("Open_Time", "Resolved_Time", "Reopen_Time", "Close_Time")],
        c("Handle_Time_hrs").alias("handle_time_raw"), clean.classify_duration(c("Handle_Time_hrs")).alias("handle_time_status"),
        number("No_of_Reassignments").alias("no_of_reassignments"), number("No_of_Related_Interactions").alias("no_of_related_interactions"),
        clean.placeholder(c("Related_Interaction")).alias("related_interaction"), clean.placeholder(c("Related_Change")).alias("related_change"), c("KB_number").alias("kb_number"),
    )
    category = clean.lookup(c("ci_group"), GROUP_CATEGORY, F.lit(clean.UNKNOWN))
    severity = clean.lookup(c("priority"), clean.PRIORITY_SEVERITY, F.lit(clean.UNKNOWN))
    scope = clean.lookup(c("impact"), clean.IMPACT_SCOPE, F.lit(clean.UNKNOWN))
    team = clean.lookup(c("ci_group"), GROUP_TEAM)
    hours = clean.hours_between(c("open_time"), c("resolved_time"))
    return step.withColumns(
        {
            "category": category, "category_source": known(category), "severity": severity, "severity_source": known(severity),
            "impact_scope": scope, "impact_scope_source": known(scope), "closure_class": clean.closure_class(c("closure_code")),
            "priority_consistent": clean.priority_consistent(c("impact"), c("urgency"), c("priority")),
            "resolution_hours": hours, "resolution_hours_source": clean.source_of(hours.isNotNull(), "derived"),
            "close_hours": clean.hours_between(c("open_time"), c("close_time")), "reopened": c("reopen_time").isNotNull(),
            "suggested_team": team, "suggested_team_source": clean.source_of(team.isNotNull(), "derived"),
        }
    )


def complete(df: DataFrame) -> DataFrame:
    """The unified event log with the provenance of every field, and the text fields that it doesn't have: null and missing.

    Levels and codes that are placeholders, times that couldn't be read and counts that are absent are missing; whether a record was reopened is derived.
    """
    c = F.col
    given = {n: (c(n) != clean.NOT_SET) & c(n).isNotNull() for n in ("impact", "urgency", "priority", "closure_code")}
    given |= {n: c(n).isNotNull() for n in ("open_time", "resolved_time", "reopen_time", "close_time", "no_of_reassignments", "status", "ci_name", "ticket_type", "ci_subcategory") if n in df.columns}
    out = {f"{n}_source": clean.source_of(p, "original") for n, p in given.items()}
    out |= {"reopened_source": F.lit("derived"), "closure_class_source": clean.source_of(~c("closure_class").isin(clean.UNKNOWN), "derived")}
    for n in ("title", "description", "resolution_notes"):
        out |= {n: F.lit(None).cast("string"), f"{n}_source": F.lit("missing")}
    out |= {"category_original": F.lit(None).cast("string"), "category_conflict": F.lit(False), "in_kb": F.lit(False), "text_generator": F.lit(None).cast("string"), "media_asset": F.lit(None).cast("string")}
    out |= {n: F.lit(None).cast("double") for n in ("no_of_related_incidents", "no_of_related_changes") if n not in df.columns}
    out |= {n: F.lit(None).cast("string") for n in ("gt_scenario", "gt_strategy", "gt_view", "gt_note_quality", "gt_seeded_defect")}
    return df.withColumns(out)


def eligible_for_text(df: DataFrame) -> DataFrame:
    return df.filter((F.col("status") == "Closed") & F.col("resolved_time").isNotNull() & (F.col("ticket_type") == "incident") & (F.col("ci_group") != "other") & (F.col("closure_code") != clean.NOT_SET))


def bad_provenance(df: DataFrame) -> DataFrame:
    """Rows with a provenance outside the four classes; empty for a sound table."""
    bad: Column = F.lit(False)
    for n in df.columns:
        if n.endswith("_source"):
            bad = bad | ~F.col(n).isin(*PROVENANCE)
    return df.filter(bad)


def corrected_category(df: DataFrame, lexicon: dict[str, list[str]]) -> DataFrame:
    """df with title, description and category: the category is replaced where the text speaks for another one and not at all for it."""
    from vigil.functions import rules

    said = F.concat(F.coalesce("title", F.lit("")), F.lit(". "), F.coalesce("description", F.lit("")))
    conflict, original = rules.category_conflict(said, F.col("category"), lexicon), F.col("category")
    df = df.withColumns({"category_conflict": conflict, "__inferred": rules.keyword_category(said, lexicon), "category_original": original})
    df = df.withColumn("category", F.when(F.col("category_conflict"), F.col("__inferred")).otherwise(original)).drop("__inferred")
    return df.withColumn("category_source", F.when(F.col("category_conflict"), "derived").otherwise("original"))
