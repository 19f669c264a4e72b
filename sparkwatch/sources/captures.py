"""Captures of attacks and what is said of them: regression cases, emulated data sets, folders of logs.

Descriptions are small files that the driver reads; the logs that they name are read by Spark.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from pathlib import Path, PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stored import BROADCAST_ROWS, Scratch
from .rules import documents

# Kinds of regression captures, and suffixes of log files.
CASE_TYPES = ("evtx", "json", "ndjson", "jsonl")
LOG_SUFFIXES = (".log", ".json", ".gz")
TECHNIQUE = r"\bT[0-9]{4}(?:\.[0-9]{3})?\b"
DATASET = "id string, title string, description string, techniques array<string>, host_files array<string>, adversary_view string, tags array<string>"


def _described(root: Path, pattern: str) -> Iterator[tuple[Path, dict]]:
    """Description files and their first mapping; those that can't be read are passed over."""
    for path in sorted(root.glob(pattern)):
        try:
            found = documents(path.read_text(encoding="utf-8"))
        except Exception:  # noqa: BLE001, S112  a broken file must not hide the others
            continue
        if found:
            yield path, found[0]


def regression_cases(spark: SparkSession, root: str) -> DataFrame:
    """case_id, rule_id, title, file, expected: a row for each capture that an info.yml under regression_data names; the file is its JSON form."""
    rows = []
    for path, info in _described(Path(root) / "regression_data", "**/info.yml"):
        rule = next(iter(info.get("rule_metadata") or []), {})
        for case in info.get("regression_tests_info") or []:
            if isinstance(case, dict) and case.get("type") in CASE_TYPES:
                file = str(path.with_name(PurePosixPath(str(case.get("path", "")).replace("\\", "/")).stem + ".json"))
                count = case.get("match_count")
                rows.append((f"{rule.get('id', '')}|{file}", str(rule.get("id", "")), str(rule.get("title", "")), file, None if count is None else int(count)))
    return spark.createDataFrame(rows, "case_id string, rule_id string, title string, file string, expected int")


def _mapped(description: dict) -> list[str]:
    """Techniques of an attack mapping, with the sub-technique where it is a number."""
    out = set()
    for m in description.get("attack_mappings") or []:
        technique, sub = str(m.get("technique") or "").strip(), str(m.get("sub-technique") or "")
        if technique:
            out.add(f"{technique}.{int(sub):03d}" if sub.isdigit() else technique)
    return sorted(out)


def attack_datasets(spark: SparkSession, root: str, pattern: str = "atomic/_metadata/SDWIN-*.yaml") -> DataFrame:
    """Emulated attacks by their descriptions: those with host logs, whose paths stand behind `/datasets/` in their links."""
    rows = []
    for path, about in _described(Path(root), pattern):
        links = [str(f.get("link", "")) for f in about.get("files") or [] if str(f.get("type", "")).lower() == "host"]
        files = [str(Path(root) / link.partition("/datasets/")[2]) for link in links if "/datasets/" in link]
        if files:
            view = (about.get("simulation") or {}).get("adversary_view") or ""
            rows.append((str(about.get("id", path.stem)), str(about.get("title", "")), str(about.get("description", "")), _mapped(about), files, str(view), [str(t) for t in about.get("tags") or []]))
    return spark.createDataFrame(rows, DATASET)


def dataset_events(spark: SparkSession, datasets: DataFrame) -> DataFrame:
    """Events of all host files that are there, with the data set's id; files that can't be read are passed over."""
    from .logs import read_json_files

    listed = datasets.select("id", F.explode("host_files").alias("path"))
    there = sorted({r["path"] for r in listed.select("path").distinct().collect() if Path(r["path"]).exists()})  # a catalogue's files
    if not there:
        return spark.createDataFrame([], "id string, file string, event_idx long, Channel string, EventID int, event map<string,string>")
    events = read_json_files(spark, there, skip_broken=True)
    return events.withColumn("path", F.regexp_replace("file", "^file:/*", "/")).join(F.broadcast(listed), "path").drop("path")


def capture_folders(spark: SparkSession, root: str, label: str = "") -> DataFrame:
    """id, techniques, host_files: folders below root that hold logs; the first part of a folder's path is its technique."""
    base = Path(root)
    by: dict[Path, list[str]] = {}
    for f in sorted(base.rglob("*")):
        if f.is_file() and f.suffix.lower() in LOG_SUFFIXES:
            by.setdefault(f.parent.relative_to(base), []).append(str(f))
    rows = [(label + d.as_posix(), [d.parts[0].upper()] if d.parts else [], files) for d, files in by.items()]
    return spark.createDataFrame(rows, "id string, techniques array<string>, host_files array<string>")


def recording(path: str) -> dict[str, str]:
    """key=value lines beside a recording; a file that isn't there says nothing."""
    file = Path(path)
    lines = file.read_text(encoding="utf-8").splitlines() if file.exists() else []
    return {k.strip(): v.strip() for k, eq, v in (x.partition("=") for x in lines) if eq}


def techniques_in(text: str = "text") -> Column:
    """Technique ids that a text names, sorted and once each."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(f"({TECHNIQUE})"), F.lit(1))))


def emulations(spark: SparkSession, root: str) -> DataFrame:
    """id, techniques, host_files, start, end of recorded emulations: folders below root with logs and a window.txt, which says what was run and when (seconds; null if it doesn't say)."""
    rows = []
    for window in sorted(Path(root).rglob("window.txt")):
        about = recording(str(window))
        files = sorted(str(f) for f in window.parent.iterdir() if f.is_file() and f.suffix.lower() in LOG_SUFFIXES)
        number = lambda k: float(v) if re.fullmatch(r"\d+(\.\d+)?", v := about.get(k, "")) else None
        if files:
            rows.append((f"live:{window.parent.name}", [t for t in about.get("techniques", "").split(",") if t], files, number("start"), number("end")))
    return spark.createDataFrame(rows, "id string, techniques array<string>, host_files array<string>, start double, end double")


def within(events: DataFrame, windows: DataFrame, seconds: str) -> DataFrame:
    """Events of recordings (with their id) that fall in their recording's window; an open end lets all pass."""
    of = windows.select("id", "start", "end")
    at = F.col(seconds)
    return events.join(F.broadcast(of), "id").filter((F.col("start").isNull() | (at >= F.col("start"))) & (F.col("end").isNull() | (at <= F.col("end")))).drop("start", "end")  # broadcast: a row for each recording


#: Characters by which a file's name is looked for.
GRAM = 4


def named_in(files: DataFrame, metadata: DataFrame) -> DataFrame:
    """name, key, techniques: descriptions (key, text) that hold a file's name, whatever characters it has.

    A name is known by the run of four characters (all of a shorter name) that fewest names have. The runs in a text are
    looked up among these, by a broadcast of a counted size or a shuffle of the runs, and only the names found there are
    searched for in it; so no text is compared with every file.
    """
    names = files.select("name").distinct().filter("name <> ''")
    size = F.least(F.length("name"), F.lit(GRAM))
    grams = names.select("name", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("name") - size + 1), lambda i: F.substring(F.col("name"), i, size)))).alias("gram"))
    rarity = grams.groupBy("gram").agg(F.count("*").alias("n"))
    keyed = Scratch(files.sparkSession).write(grams.join(rarity, "gram").groupBy("name").agg(F.min(F.struct("n", "gram")).alias("x")).select("name", F.col("x.gram").alias("gram")), "names")
    sizes = sorted(r[0] for r in keyed.select(F.length("gram")).distinct().collect())  # at most four
    texts = metadata.select("key", F.coalesce("text", F.lit("")).alias("text"))
    runs = [F.regexp_extract_all("text", F.lit(f"(?s)(?=({'.' * k}))"), F.lit(1)) for k in sizes]
    if not runs:
        return texts.select(F.lit("").alias("name"), "key", techniques_in("text").alias("techniques")).limit(0)
    found = texts.withColumn("gram", F.explode(F.array_distinct(F.concat(*runs))))
    n = keyed.count()
    if n <= BROADCAST_ROWS:
        near = found.join(F.broadcast(keyed), "gram")
    else:  # the texts stay where they are: only runs travel, and of the texts those that may hold a name
        pairs = found.select("gram", F.xxhash64("text").alias("of"), "key").join(keyed, "gram").select("key", "of", "name")
        near = texts.withColumn("of", F.xxhash64("text")).join(pairs, ["key", "of"])
    return near.filter(F.contains("text", F.col("name"))).select("name", "key", techniques_in("text").alias("techniques")).distinct()
