"""Incident records made from `orders` by arithmetic on the order's key, alike in Spark and in SQL.

The driver's tables hold no incidents, so queries on records run over these: one per order, with titles, notes and
codes drawn from short lists, times from the order's date, and nulls where real logs have them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.session import table

TITLES = ("Portal slow in the morning", "Cannot log in", "Printer queue stuck", "VPN drops", "Report is empty", "Disk full on server", "Mailbox quota", None, "Query timeout", "Card reader out of service")
DESCRIPTIONS = (
    "The payroll portal is very slow since the latest deployment and freezes; after a restart it works for all users in production.",
    "Several users cannot login to the customer banking application, the SSO page returns access denied after the password change.",
    "Print jobs hang in the spooler on SBA123456 and nobody can print, our team is waiting.",
    "VPN tunnel keeps dropping for remote colleagues after the firmware update of the gateway.",
    "Yesterday's figures are missing: the overnight update ended with return code 8, the interface file arrived late.",
    "Capacity alert: volume at 99% used, no space on the shared drive of the department.",
    "Outlook cannot send, the mailbox is over quota, only me it seems.",
    "High CPU on the database server, queries are slow and time out under load during month-end peak.",
    "Black screen on my laptop after the bios update, it does not start.",
    "Certificate expired at midnight, the TLS handshake fails on the partner interface in staging.",
    "Wrong data in the contracts dashboard after a bulk import, duplicate records.",
    "The button does nothing.", None, "", "Packet loss on the switch, connectivity is lost for several departments.",
    "Memory usage climbs until the application runs out of memory; it hangs and comes back by itself.",
    "Suspicious login attempts on the acceptance environment.",
)
NOTES = (
    "The memory leak in the session cache was resolved by restarting the application service, verified with the user and monitored for a day.",
    "Rolled back the release because of a defect in the new version; errors dropped and the portal is back to normal.",
    "closed", "Fixed", None, "", "Replaced the faulty patch cable on port 12 and confirmed the link is stable.",
    "Explained the procedure to the user, works as designed.", "Cleared the spooler, removed the corrupted job and installed a certified driver. Printing works again.",
    "Extended the LUN and archived logs; log files filled the volume due to debug logging.", "Deleted the old datafile and killed the blocking session, created an index and updated statistics.",
    "Renewed certificate and restarted the gateway, TLS handshake succeeded.", "User confirmed, closed", "Reset password, account unlocked.",
    "The interface file was malformed; upstream redelivered it and the job was rerun, data loaded.", "done", "Reimaged the laptop, SSD defect, loan laptop provided. No further errors.",
)
CLASSES = ("software_fix", "hardware_fix", "data_fix", "user_or_operator", "no_fault_found", "unspecified", "Unknown", None)
CODES = ("Software", "Hardware", "Data", "User error", "No error - works as designed", "Other", "Not Set", None)
GROUPS = ("app_server", "app_web", "sap", "citrix_vdi", "collab", "enduser_hw", "banking_device", "storage", "database", "server", "network", "security_sw", "media", "other")
CATEGORIES = ("Application", "Hardware", "Storage", "Database", "Infrastructure", "Network", "Security", "Unknown")
LEVELS = ("1", "2", "3", "4", "5", "Not Set")
SCOPES = ("Unknown", "single user", "department", None, "limited (few users)")
CHANGES = (None, None, None, "C00012345", "Not Available", None, "C00000777")
SOURCES = ("original", "original", "synthetic")

#: column -> (values, multiplier, offset): values[(key * multiplier + offset) mod their number].
LISTS = {
    "title": (TITLES, 7, 1), "description": (DESCRIPTIONS, 5, 2), "resolution_notes": (NOTES, 11, 3), "closure_class": (CLASSES, 3, 0), "closure_code": (CODES, 3, 0),
    "ci_group": (GROUPS, 5, 1), "category": (CATEGORIES, 3, 1), "impact": (LEVELS, 5, 0), "urgency": (LEVELS, 1, 2), "priority": (LEVELS, 5, 3), "impact_scope": (SCOPES, 2, 1),
    "related_change": (CHANGES, 3, 2), "description_source": (SOURCES, 1, 0), "resolution_notes_source": (SOURCES, 2, 1),
}


def q(s: str | None) -> str:
    return "NULL" if s is None else "'" + s.replace("'", "''") + "'"


def _pick(values: tuple, a: int, b: int) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), F.pmod(F.col("k") * a + b, F.lit(len(values))).cast("int"))


def records(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), "o_custkey", F.col("o_orderdate").cast("timestamp").alias("d"))
    us = F.unix_micros("d") + F.pmod(F.col("k") * 37, F.lit(86400)) * 1_000_000
    taken = F.when(F.col("k") % 11 != 0, us + (F.pmod(F.col("k") * 101, F.lit(500_000)) + 600) * 1_000_000)
    rows = d.select(
        "k", F.concat(F.lit("IM"), F.lpad(F.col("k").cast("string"), 7, "0")).alias("incident_id"),
        F.concat(F.lit("SBA"), F.lpad((F.col("o_custkey") % 40).cast("string"), 6, "0")).alias("ci_name"), *[_pick(*v).alias(n) for n, v in LISTS.items()],
        F.timestamp_micros(us).alias("open_time"), F.timestamp_micros(taken).alias("resolved_time"),
        F.when(F.col("k") % 4 != 0, F.col("k") % 9 == 0).alias("reopened"), F.when(F.col("k") % 6 != 0, F.col("k") % 8).alias("reassignments"),
        F.concat(F.lit("F"), F.lpad((F.col("k") % 12 + 1).cast("string"), 3, "0")).alias("family"),
        F.concat(F.lit("S"), (F.col("k") % 3 + 1).cast("string")).alias("way"),
    )
    known = lambda c: F.when(c.isNull() | (c == "Not Set"), "missing").otherwise("original")
    rows = rows.withColumns({f"{n}_source": known(F.col(n)) for n in ("impact", "urgency", "priority", "closure_code")})
    times = {f"{n}_source": F.when(F.col(n).isNull(), "missing").otherwise("original") for n in ("open_time", "resolved_time", "reopened")}
    return rows.withColumns(times | {"ci_subcategory": F.col("ci_group"), "strategy": F.concat_ws("-", "family", "way"), "resolution_hours": (F.unix_micros("resolved_time") - F.unix_micros("open_time")) / 3.6e9})


def _sql() -> str:
    pick = ", ".join(f"([{', '.join(map(q, v))}])[((k * {a} + {b}) % {len(v)} + 1)::INT] AS {n}" for n, (v, a, b) in LISTS.items())
    known = ", ".join(f"CASE WHEN {n} IS NULL OR {n} = 'Not Set' THEN 'missing' ELSE 'original' END AS {n}_source" for n in ("impact", "urgency", "priority", "closure_code"))
    times = ", ".join(f"CASE WHEN {n} IS NULL THEN 'missing' ELSE 'original' END AS {n}_source" for n in ("open_time", "resolved_time", "reopened"))
    return f"""(
      SELECT *, {known}, {times}, ci_group AS ci_subcategory, family || '-' || way AS strategy, (epoch_us(resolved_time) - epoch_us(open_time)) / 3.6e9 AS resolution_hours
      FROM (SELECT k, 'IM' || lpad(k::VARCHAR, 7, '0') AS incident_id, 'SBA' || lpad((o_custkey % 40)::VARCHAR, 6, '0') AS ci_name, {pick},
                   make_timestamp(us) AS open_time, CASE WHEN k % 11 <> 0 THEN make_timestamp(us + ((k * 101) % 500000 + 600) * 1000000) END AS resolved_time,
                   CASE WHEN k % 4 <> 0 THEN k % 9 = 0 END AS reopened, CASE WHEN k % 6 <> 0 THEN k % 8 END AS reassignments,
                   'F' || lpad((k % 12 + 1)::VARCHAR, 3, '0') AS family, 'S' || (k % 3 + 1)::VARCHAR AS way
            FROM (SELECT o_orderkey AS k, o_custkey, epoch_us(o_orderdate::TIMESTAMP) + ((o_orderkey * 37) % 86400) * 1000000 AS us FROM orders)))"""


#: The same table in SQL, as a subquery.
RECORDS = _sql()


def content_sql(*fields: str) -> str:
    """What exact duplicates have in common: normalised texts."""
    plain = "trim(regexp_replace(regexp_replace(lower(coalesce({0}, '')), '[^a-z0-9 ]', ' ', 'g'), '\\s+', ' ', 'g'))"
    return " || '|' || ".join(plain.format(f) for f in fields)


def case(rules: list, c: str, give: str = "label") -> str:
    """The first rule that matches c: its label, group or phrase; else null."""
    then = {"label": lambda r: q(r.label), "group": lambda r: q(r.group or None), "phrase": lambda r: f"regexp_extract({c}, {q('(?i)' + r.pattern)}, 0)"}[give]
    return "CASE " + " ".join(f"WHEN regexp_matches({c}, {q('(?i)' + r.pattern)}) THEN {then(r)}" for r in rules) + " END"


def mapped(c: str, pairs: dict[str, str]) -> str:
    return f"CASE {c} " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in pairs.items()) + " END"
