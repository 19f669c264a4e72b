"""Which events a rule is for: log sources to (channel, event id), and the joins that follow from it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import LogSource

# Channels, and the events of each category and service of the rule format.
SYSMON = "microsoft-windows-sysmon/operational"
SECURITY = "security"
POWERSHELL = "microsoft-windows-powershell/operational"
POWERSHELL_CLASSIC = "windows powershell"
DEFENDER = "microsoft-windows-windows defender/operational"
LINUX_SYSMON, AUDITD, CLOUDTRAIL = "linux-sysmon/operational", "linux-auditd", "aws-cloudtrail"
NOT_WINDOWS = (LINUX_SYSMON, AUDITD, CLOUDTRAIL)
SYSMON_CATEGORIES = {
    "process_creation": (1,), "file_change": (2,), "network_connection": (3,), "sysmon_status": (4, 16), "process_termination": (5,),
    "driver_load": (6,), "image_load": (7,), "create_remote_thread": (8,), "raw_access_thread": (9,), "process_access": (10,),
    "file_event": (11,), "registry_add": (12,), "registry_delete": (12,), "registry_set": (13,), "registry_rename": (14,),
    "registry_event": (12, 13, 14), "create_stream_hash": (15,), "pipe_created": (17, 18), "wmi_event": (19, 20, 21), "dns_query": (22,),
    "file_delete": (23,), "clipboard_change": (24,), "process_tampering": (25,), "file_delete_detected": (26,), "file_block_executable": (27,),
    "file_block_shredding": (28,), "file_executable_detected": (29,), "sysmon_error": (255,),
}
OTHER_CATEGORIES = {
    "process_creation": (SECURITY, (4688,)), "ps_module": (POWERSHELL, (4103,)), "ps_script": (POWERSHELL, (4104,)),
    "ps_classic_start": (POWERSHELL_CLASSIC, (400,)), "ps_classic_provider_start": (POWERSHELL_CLASSIC, (600,)), "ps_classic_script": (POWERSHELL_CLASSIC, (800,)),
    "antivirus": (DEFENDER, (1006, 1007, 1008, 1009, 1010, 1011, 1012, 1017, 1018, 1019, 1115, 1116)),
}
GUARDS = {"registry_add": ("EventType", ("createkey",)), "registry_delete": ("EventType", ("deletekey", "deletevalue"))}
LINUX_CATEGORIES = {"process_creation": 1, "network_connection": 3, "process_termination": 5, "raw_access_thread": 9, "file_event": 11, "file_delete": 23}
SERVICES = {
    "security": SECURITY, "system": "system", "application": "application", "sysmon": SYSMON, "powershell": POWERSHELL,
    "powershell-classic": POWERSHELL_CLASSIC, "windefend": DEFENDER, "dns-server": "dns server", "msexchange-management": "msexchange management",
    "openssh": "openssh/operational", "microsoft-servicebus-client": "microsoft-servicebus-client", "iis-configuration": "microsoft-iis-configuration/operational",
    "taskscheduler": "microsoft-windows-taskscheduler/operational", "wmi": "microsoft-windows-wmi-activity/operational",
    "wmi-activity": "microsoft-windows-wmi-activity/operational", "bits-client": "microsoft-windows-bits-client/operational",
    "codeintegrity-operational": "microsoft-windows-codeintegrity/operational", "dns-server-analytic": "microsoft-windows-dns-server/analytical",
    "firewall-as": "microsoft-windows-windows firewall with advanced security/firewall", "dns-client": "microsoft-windows-dns client events/operational",
    "driver-framework": "microsoft-windows-driverframeworks-usermode/operational", "ntlm": "microsoft-windows-ntlm/operational",
    "printservice-admin": "microsoft-windows-printservice/admin", "printservice-operational": "microsoft-windows-printservice/operational",
    "smbclient-security": "microsoft-windows-smbclient/security", "smbclient-connectivity": "microsoft-windows-smbclient/connectivity",
    "smbserver-connectivity": "microsoft-windows-smbserver/connectivity", "ldap": "microsoft-windows-ldap-client/debug",
    "terminalservices-localsessionmanager": "microsoft-windows-terminalservices-localsessionmanager/operational",
    "terminalservices-remoteconnectionmanager": "microsoft-windows-terminalservices-remoteconnectionmanager/operational",
    "appxdeployment-server": "microsoft-windows-appxdeploymentserver/operational", "appxpackaging-om": "microsoft-windows-appxpackaging/operational",
    "appmodel-runtime": "microsoft-windows-appmodel-runtime/admin", "capi2": "microsoft-windows-capi2/operational",
    "lsa-server": "microsoft-windows-lsa/operational", "diagnosis-scripted": "microsoft-windows-diagnosis-scripted/operational",
    "shell-core": "microsoft-windows-shell-core/operational", "hyper-v-worker": "microsoft-windows-hyper-v-worker",
    "certificateservicesclient-lifecycle-system": "microsoft-windows-certificateservicesclient-lifecycle-system/operational",
    "kernel-shimengine": "microsoft-windows-kernel-shimengine/operational", "vhdmp": "microsoft-windows-vhdmp-operational",
    "bitlocker": "microsoft-windows-bitlocker/bitlocker management", "sense": "microsoft-windows-sense/operational",
    "dhcp": "microsoft-windows-dhcp-server/operational", "rdp": "microsoft-windows-remotedesktopservices-rdpcorets/operational",
    "ntfs": "microsoft-windows-ntfs/operational", "kernel-event-tracing": "microsoft-windows-kernel-eventtracing/admin",
}
SERVICES_OF_MANY = {
    "applocker": tuple(f"microsoft-windows-applocker/{x}" for x in ("exe and dll", "msi and script", "packaged app-deployment", "packaged app-execution")),
    "security-mitigations": tuple(f"microsoft-windows-security-mitigations/{x} mode" for x in ("kernel", "user")),
}
ALIASES_4688 = {"NewProcessName": "Image", "ParentProcessName": "ParentImage", "NewProcessId": "ProcessId"}
ALIASES_DEFENDER = {"ThreatName": "Signature", "Path": "Filename"}

ANY = "*"  # any Windows channel


@dataclass(frozen=True)
class Route:
    """(channel, event id or None for any) pairs, and a field that must have one of some values."""

    pairs: tuple[tuple[str, int | None], ...]
    guard: tuple[str, tuple[str, ...]] | None = None


def route(source: LogSource) -> Route | None:
    """Where a log source's events are; None if it can't be told."""
    product, category, service = (x.lower() for x in (source.product, source.category, source.service))
    if product == "linux":
        if category:
            return Route(((LINUX_SYSMON, LINUX_CATEGORIES[category]),)) if category in LINUX_CATEGORIES else None
        return Route(((AUDITD, None),)) if service == "auditd" else None
    if product and product != "windows":
        return Route(((CLOUDTRAIL, None),)) if (product, service) == ("aws", "cloudtrail") and not category else None
    channels = SERVICES_OF_MANY.get(service) or ((SERVICES[service],) if service in SERVICES else ())
    if category:
        pairs = [(SYSMON, i) for i in SYSMON_CATEGORIES.get(category, ())]
        if category in OTHER_CATEGORIES:
            channel, ids = OTHER_CATEGORIES[category]
            pairs += [(channel, i) for i in ids]
        if not pairs:
            return None
        narrowed = [p for p in pairs if p[0] in channels]  # a service narrows, unless nothing would be left
        return Route(tuple(narrowed or pairs), GUARDS.get(category))
    if service:
        return Route(tuple((c, None) for c in channels)) if channels else None
    return Route(((ANY, None),)) if product == "windows" else None


def indexed(found: Route, required: set[int] | None) -> Route:
    """A route narrowed to the event ids that a rule requires; pairs that can't match are left out."""
    if required is None:
        return found
    pairs: list[tuple[str, int | None]] = []
    for channel, i in found.pairs:
        if i is not None:
            pairs += [(channel, i)] if i in required else []
        elif channel == ANY:
            pairs.append((channel, None))
        else:
            pairs += [(channel, r) for r in sorted(required)]
    return Route(tuple(pairs), found.guard)


def channel_key(channel: str = "Channel") -> Column:
    return F.lower(F.coalesce(F.col(channel).cast("string"), F.lit("")))


def event_id_key(event_id: str = "EventID") -> Column:
    return F.coalesce(F.col(event_id).cast("string").try_cast("int"), F.lit(0))


def routes_table(spark: SparkSession, routes: dict[str, Route]) -> DataFrame:
    """rule_id, channel, eid (null: any), guard_field, guard_values: a row for each pair."""
    rows = [(k, c, i, *(r.guard and (r.guard[0], list(r.guard[1])) or (None, None))) for k, r in routes.items() for c, i in r.pairs]
    return spark.createDataFrame(rows, "rule_id string, channel string, eid int, guard_field string, guard_values array<string>")


def candidates(events: DataFrame, routes: DataFrame) -> DataFrame:
    """Events with the rules that may match them: by (channel, id), by channel, and the rules for any Windows channel.

    events has __channel and __eid. An event is read once and asks with up to three keys; routes are a library's, a few
    thousand rows, so they are broadcast into one hash join.
    """
    key = lambda kind, channel, eid: F.struct(F.lit(kind).alias("kind"), channel.alias("channel"), eid.cast("int").alias("eid"))
    none, channel = F.lit(0), F.col("__channel")
    asked = F.array_compact(F.array(key(2, channel, F.col("__eid")), key(1, channel, none), F.when(~channel.isin(*NOT_WINDOWS), key(0, F.lit(ANY), none))))
    kind = F.when(F.col("channel") == ANY, 0).when(F.col("eid").isNull(), 1).otherwise(2)
    slim = routes.select("rule_id", F.struct(kind.alias("kind"), "channel", F.coalesce("eid", none).alias("eid")).alias("__key")).distinct()
    return events.withColumn("__key", F.explode(asked)).join(F.broadcast(slim), "__key").drop("__key")


def applies(found: Route, channel: Column, eid: Column, field) -> Column:  # type: ignore[no-untyped-def]
    """Whether a route covers an event, its guard included; `field` gives the column of a field name."""
    hit = F.lit(False)
    for c, i in found.pairs:
        where = ~channel.isin(*NOT_WINDOWS) if c == ANY else channel == c
        hit = hit | (where if i is None else where & (eid == i))
    if found.guard:
        hit = hit & F.lower(F.coalesce(field(found.guard[0]).cast("string"), F.lit(""))).isin(*found.guard[1])
    return hit


def with_aliases(df: DataFrame) -> DataFrame:
    """Security 4688 and Defender events also under the field names that rules use, where those are absent."""
    channel, eid = channel_key(), event_id_key()
    for when, names in (((channel == SECURITY) & (eid == 4688), ALIASES_4688), (channel == DEFENDER, ALIASES_DEFENDER)):
        for old, new in names.items():
            if old in df.columns:
                own = F.col(new) if new in df.columns else F.lit(None)
                df = df.withColumn(new, F.when(when, F.coalesce(own, F.col(old))).otherwise(own))
    return df
