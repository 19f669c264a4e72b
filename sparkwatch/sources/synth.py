"""Synthetic benign process events for dry runs, made by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WINDOWS = "C:\\Windows\\System32\\"
#: image, command line, parent of processes that any host has.
PROCESSES = [
    (WINDOWS + "svchost.exe", "svchost.exe -k netsvcs -p", WINDOWS + "services.exe"),
    (WINDOWS + "cmd.exe", "cmd.exe /c dir C:\\Users", "C:\\Windows\\explorer.exe"),
    (WINDOWS + "conhost.exe", "conhost.exe 0xffffffff -ForceV1", WINDOWS + "cmd.exe"),
    (WINDOWS + "taskhostw.exe", "taskhostw.exe", WINDOWS + "svchost.exe"),
    (WINDOWS + "schtasks.exe", "schtasks.exe /query /fo LIST", WINDOWS + "cmd.exe"),
    (WINDOWS + "certutil.exe", "certutil.exe -verify C:\\certs\\root.cer", WINDOWS + "cmd.exe"),
    (WINDOWS + "net.exe", "net.exe use", WINDOWS + "cmd.exe"),
    (WINDOWS + "WindowsPowerShell\\v1.0\\powershell.exe", "powershell.exe Get-Service", "C:\\Windows\\explorer.exe"),
]
RENAMED = {"Image": "process.executable", "CommandLine": "process.command_line", "ParentImage": "process.parent.executable"}


def generate(spark: SparkSession, n: int = 5000, seed: int = 1337, schema: str = "v1") -> DataFrame:
    """Events over one day; schema v2 has three fields under other names. The same seed gives the same events on any cluster."""
    pick = lambda values, salt: F.element_at(F.array(*[v if not isinstance(v, str) else F.lit(v) for v in values]), (F.pmod(F.xxhash64("event_idx", F.lit(f"{seed}|{salt}")), F.lit(len(values))) + 1).cast("int"))
    p = pick([F.struct(*[F.lit(x).alias(k) for k, x in zip(("Image", "CommandLine", "ParentImage"), row, strict=True)]) for row in PROCESSES], "process")
    base = spark.range(n).withColumnRenamed("id", "event_idx").select(
        "event_idx", F.date_format(F.timestamp_seconds(F.lit(1767225600) + F.floor(F.col("event_idx") * 86400 / n)), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("timestamp"),
        F.lit("Microsoft-Windows-Sysmon/Operational").alias("Channel"), F.lit(1).alias("EventID"), pick([f"WS-{i:03d}.lab.example" for i in range(1, 21)], "host").alias("Computer"),
        pick([*(f"LAB\\user{i:02d}" for i in range(1, 16)), "NT AUTHORITY\\SYSTEM"], "user").alias("User"), p.alias("p"),
    ).select("*", "p.*").drop("p")
    return base if schema == "v1" else base.withColumnsRenamed(RENAMED)
