"""ATT&CK technique names, tactics and links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Technique id -> (name, tactic).
TECHNIQUES = {
    "T1110": ("Brute Force", "Credential Access"),
    "T1110.001": ("Brute Force: Password Guessing", "Credential Access"),
    "T1110.003": ("Brute Force: Password Spraying", "Credential Access"),
    "T1190": ("Exploit Public-Facing Application", "Initial Access"),
    "T1498": ("Network Denial of Service", "Impact"),
    "T1499": ("Endpoint Denial of Service", "Impact"),
    "T1046": ("Network Service Discovery", "Discovery"),
    "T1595": ("Active Scanning", "Reconnaissance"),
    "T1071": ("Application Layer Protocol", "Command and Control"),
    "T1078": ("Valid Accounts", "Defense Evasion"),
    "T1059": ("Command and Scripting Interpreter", "Execution"),
    "T1003": ("OS Credential Dumping", "Credential Access"),
}


def _catalog(position: int) -> Column:
    return F.create_map(*[F.lit(x) for tid, info in TECHNIQUES.items() for x in (tid, info[position])])


def _lookup(technique: Column, position: int) -> Column:
    # The catalog is a constant of a dozen rows, so it travels as a literal and
    # needs no join.  An unlisted sub-technique takes its parent's entry.
    catalog = _catalog(position)
    parent = F.substring_index(technique, ".", 1)
    return F.coalesce(F.try_element_at(catalog, technique), F.try_element_at(catalog, parent))


def technique_name(technique: Column) -> Column:
    return _lookup(technique, 0)


def tactic(technique: Column) -> Column:
    return _lookup(technique, 1)


def technique_url(technique: Column) -> Column:
    """``T1110.001`` -> ``https://attack.mitre.org/techniques/T1110/001/``."""
    parts = F.split(technique, r"\.")
    base = F.concat(F.lit("https://attack.mitre.org/techniques/"), parts[0], F.lit("/"))
    sub = F.get(parts, F.lit(1))
    return F.when(sub != "", F.concat(base, sub, F.lit("/"))).otherwise(base)
