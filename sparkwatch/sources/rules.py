"""Rule files and technique catalogues."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Rule

try:
    import yaml
except ImportError:  # rules may also be given as dicts
    yaml = None

# A small catalogue for use without a download.
CATALOG = {
    "T1003.001": ("LSASS Memory", "credential-access"), "T1021.001": ("Remote Desktop Protocol", "lateral-movement"),
    "T1033": ("System Owner/User Discovery", "discovery"), "T1047": ("Windows Management Instrumentation", "execution"),
    "T1053.005": ("Scheduled Task", "persistence"), "T1059.001": ("PowerShell", "execution"), "T1059.003": ("Windows Command Shell", "execution"),
    "T1070.001": ("Clear Windows Event Logs", "defense-evasion"), "T1071.001": ("Web Protocols", "command-and-control"),
    "T1087.001": ("Account Discovery: Local Account", "discovery"), "T1105": ("Ingress Tool Transfer", "command-and-control"),
    "T1110": ("Brute Force", "credential-access"), "T1136.001": ("Create Account: Local Account", "persistence"),
    "T1218.011": ("Rundll32", "defense-evasion"), "T1486": ("Data Encrypted for Impact", "impact"),
    "T1547.001": ("Registry Run Keys / Startup Folder", "persistence"),
}
CATALOG_SCHEMA = "id string, name string, tactics array<string>, platforms array<string>, is_subtechnique boolean, revoked boolean, deprecated boolean, revoked_by string"


def load_rules(text: str, path: str = "") -> list[Rule]:
    """Rules in a YAML text of one or more documents; those without a detection are skipped."""
    return [Rule.parse(d, path) for d in documents(text) if "detection" in d]


def documents(text: str) -> list[dict]:
    """The mappings among a YAML text's documents."""
    if yaml is None:
        raise ImportError("reading YAML needs PyYAML")
    return [d for d in yaml.load_all(text, getattr(yaml, "CSafeLoader", yaml.SafeLoader)) if isinstance(d, dict)]


def load_rule_dir(*roots: str) -> tuple[list[Rule], dict[str, str]]:
    """Rules in files and under folders of the driver, in the order of their paths, and files that couldn't be read with the reason.

    A path that isn't there is an error of its own. A file given under two roots counts once; `skipped` says of the
    documents without a detection how many there were.
    """
    rules: list[Rule] = []
    errors: dict[str, str] = {}
    found: dict[Path, None] = {}
    for root in map(Path, roots):
        if not root.exists():
            errors[str(root)] = "no such file or folder"
        found |= dict.fromkeys([root] if root.is_file() else sorted(q for q in root.rglob("*") if q.suffix in (".yml", ".yaml")))
    for p in found:
        try:
            rules += load_rules(p.read_text(encoding="utf-8"), str(p))
        except Exception as e:  # noqa: BLE001  a broken file must not hide the others
            errors[str(p)] = str(e)
    return rules, errors


def skipped(*roots: str) -> int:
    """How many readable documents under files and folders are no rules."""
    out = 0
    for root in map(Path, roots):
        for p in [root] if root.is_file() else [q for q in root.rglob("*") if q.suffix in (".yml", ".yaml")]:
            try:
                out += sum("detection" not in d for d in documents(p.read_text(encoding="utf-8")))
            except Exception:  # noqa: BLE001, S112  load_rule_dir names broken files
                continue
    return out


def rules_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """One row a rule, with what operators join and count."""
    rows = [(r.key, r.title, r.status, r.level, r.logsource.product, r.logsource.category, r.logsource.service, r.tags, r.techniques, r.tactics, len(r.description), bool(r.references), bool(r.falsepositives), bool(r.author), len(r.true_positives) + len(r.true_negatives), r.path) for r in rules]
    return spark.createDataFrame(rows, "rule_id string, title string, status string, level string, product string, category string, service string, tags array<string>, techniques array<string>, tactics array<string>, description_length int, has_references boolean, has_falsepositives boolean, has_author boolean, n_tests int, path string")


def fallback_catalog(spark: SparkSession) -> DataFrame:
    """The small catalogue as techniques of Windows, none revoked."""
    named = spark.createDataFrame([(i, *of) for i, of in CATALOG.items()], "id string, name string, tactic string")
    no = F.lit(False)
    return named.select("id", "name", F.array("tactic").alias("tactics"), F.array(F.lit("Windows")).alias("platforms"), F.contains("id", F.lit(".")).alias("is_subtechnique"), no.alias("revoked"), no.alias("deprecated"), F.lit(None).cast("string").alias("revoked_by"))


def load_stix(spark: SparkSession, path: str) -> DataFrame:
    """Techniques of a STIX bundle, with what revoked them."""
    ref = "struct<source_name: string, external_id: string>"
    item = f"struct<id: string, type: string, name: string, revoked: boolean, x_mitre_deprecated: boolean, x_mitre_is_subtechnique: boolean, x_mitre_platforms: array<string>, kill_chain_phases: array<struct<kill_chain_name: string, phase_name: string>>, external_references: array<{ref}>, relationship_type: string, source_ref: string, target_ref: string>"
    items = spark.read.schema(f"objects array<{item}>").json(path, multiLine=True).select(F.explode("objects").alias("o")).select("o.*")
    external = F.element_at(F.filter("external_references", lambda r: r["source_name"] == "mitre-attack"), 1)["external_id"]
    no = F.lit(False)
    found = items.filter("type = 'attack-pattern'").select(F.col("id").alias("stix"), external.alias("id"), "name", F.coalesce(F.transform(F.filter("kill_chain_phases", lambda p: p["kill_chain_name"] == "mitre-attack"), lambda p: p["phase_name"]), F.array().cast("array<string>")).alias("tactics"), F.coalesce("x_mitre_platforms", F.array().cast("array<string>")).alias("platforms"), F.coalesce("x_mitre_is_subtechnique", no).alias("is_subtechnique"), F.coalesce("revoked", no).alias("revoked"), F.coalesce("x_mitre_deprecated", no).alias("deprecated"))
    moved = items.filter("relationship_type = 'revoked-by'").select("source_ref", "target_ref")
    target = found.select(F.col("stix").alias("target_ref"), F.col("id").alias("revoked_by"))
    by = moved.join(target, "target_ref").groupBy(F.col("source_ref").alias("stix")).agg(F.min("revoked_by").alias("revoked_by"))
    return found.filter("id is not null").join(by, "stix", "left").drop("stix")


def detects(spark: SparkSession, path: str) -> DataFrame:
    """(component, technique) pairs, once each, of a STIX bundle's `detects` relations that are neither revoked nor deprecated."""
    items = spark.read.schema("objects array<struct<id: string, type: string, name: string, revoked: boolean, x_mitre_deprecated: boolean, relationship_type: string, source_ref: string, target_ref: string, external_references: array<struct<source_name: string, external_id: string>>>>").json(path, multiLine=True).select(F.explode("objects").alias("o")).select("o.*")
    external = F.element_at(F.filter("external_references", lambda r: r["source_name"] == "mitre-attack"), 1)["external_id"]
    rel = items.filter("relationship_type = 'detects' and not coalesce(revoked, false) and not coalesce(x_mitre_deprecated, false)").select("source_ref", "target_ref")
    return rel.join(items.select(F.col("id").alias("source_ref"), F.col("name").alias("component")), "source_ref").join(items.filter("type = 'attack-pattern'").select(F.col("id").alias("target_ref"), external.alias("technique")), "target_ref").filter("component <> '' and technique is not null").select("component", "technique").distinct()
