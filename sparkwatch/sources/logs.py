"""Log files as events: file, event_idx, Channel, EventID and the event's fields as a map.

Values in the map are texts; nested ones are their JSON, which dotted field names reach into. Lines, JSON lines, Sysmon XML,
auditd and CloudTrail records are parsed by Spark functions. JSON documents and archives are listed first, then streamed: a
zip's members are dealt to all tasks, and no task holds a file, a member or a document of many records as a whole.
"""

from __future__ import annotations

from collections.abc import Callable
from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.stored import before
from ..operators.routes import ALIASES_4688, ALIASES_DEFENDER, AUDITD, CLOUDTRAIL, DEFENDER, LINUX_SYSMON, SECURITY
from .members import members, records

# What collectors add to an event around its own fields.
ENVELOPE = (
    "Message", "@version", "tags", "host", "port", "EventReceivedTime", "SourceModuleName", "SourceModuleType", "Keywords", "Severity",
    "SeverityValue", "Category", "Opcode", "OpcodeValue", "RecordNumber", "ExecutionProcessID", "ExecutionThreadID", "EventType", "Version",
    "Task", "ProviderGuid", "ActivityID", "log_name", "beat", "agent", "ecs", "input", "log", "event", "winlog", "type",
)
CLOUDTRAIL_ENVELOPE = ("@version", "@timestamp", "tags", "host", "port")
_MAP = "map<string,string>"


def _without(m: Column, names: tuple[str, ...]) -> Column:
    return F.map_filter(m, lambda k, v: ~k.isin(*names))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluates value once for each row, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _over(m: Column, new: Column) -> Column:
    """Both maps together; where they share a key the second counts."""
    return _let(new, lambda n: F.map_concat(F.map_filter(m, lambda k, v: ~F.map_contains_key(n, k)), n))


def _put(m: Column, **fields: Column) -> Column:
    """The map with these fields, in place of those of the same names; null ones are left out."""
    return _over(m, F.map_filter(F.create_map(*[x for k, v in fields.items() for x in (F.lit(k), v.cast("string"))]), lambda k, v: v.isNotNull()))


def _parsed(text: Column) -> Column:
    """A JSON object's fields; null for anything else."""
    return F.when(F.ltrim(text).startswith("{"), F.from_json(text, _MAP))


def _object(text: Column) -> Column:
    return F.coalesce(F.from_json(text, _MAP), F.create_map().cast(_MAP))


def _element(v: Column) -> Column:
    """What an XML element in JSON says: its text if it has one, nothing if it has attributes only, else itself."""
    told = lambda m: F.when(F.map_contains_key(m, "#text"), F.try_element_at(m, F.lit("#text"))).when(F.map_keys(m) != F.array(F.lit("#attributes")), v)
    return F.when(F.coalesce(v.startswith("{"), F.lit(False)), _let(_object(v), told)).otherwise(v)


def _section(text: Column, wrapped: bool) -> Column:
    """Fields of EventData or UserData, whose one element may wrap them; a section that is no object is its Data."""
    inside = lambda m: F.coalesce(F.when(F.size(m) == 1, _let(F.get(F.map_values(m), F.lit(0)), _parsed)), m)
    fields = _let(_object(text), inside) if wrapped else _object(text)
    return F.when(text.startswith("{"), _without(fields, ("#attributes",))).when(text != "", F.create_map(F.lit("Data"), text)).otherwise(F.create_map().cast(_MAP))


def _elements(m: Column) -> Column:
    """What the fields say as elements, those listed as Data too."""
    each = lambda k, v: F.when((k == "Data") & v.startswith("["), F.from_json(v, "array<string>")).otherwise(F.array(v))
    said = lambda k, v: _let(F.transform(each(k, v), _element), lambda x: F.when((k == "Data") & v.startswith("["), F.to_json(x)).otherwise(F.get(x, F.lit(0))))
    return F.transform_values(m, said)


def _without_blanks(m: Column) -> Column:
    """Fields whose names hold blanks under names without them too, unless there are such fields."""
    spaced = F.map_filter(m, lambda k, v: F.contains(k, F.lit(" ")))
    named = _first(F.transform(F.map_keys(spaced), lambda k: F.replace(k, F.lit(" "), F.lit(""))), F.map_values(spaced))
    return F.when(F.exists(F.map_keys(m), lambda k: F.contains(k, F.lit(" "))), _over(named, m)).otherwise(m)


def flatten_evtx(event: Column) -> Column:
    """System, EventData and UserData (as JSON, by key) of an event in EVTX's JSON form, as flat fields; of fields that share a name the later section's counts."""
    part = lambda k: F.try_element_at(event, F.lit(k))

    def named(system: Column) -> Column:
        get = lambda k: F.try_element_at(system, F.lit(k))
        attribute = lambda k, a: F.get_json_object(get(k), f"$['#attributes'].{a}")
        there = lambda v: F.coalesce(v, F.lit(""))
        has = F.get_json_object(get("Provider"), "$['#attributes']").isNotNull()
        provider = F.when(has, attribute("Provider", "Name")).otherwise(F.get_json_object(get("Provider"), "$.Name"))
        when = F.when(there(get("TimeCreated")).startswith("{"), attribute("TimeCreated", "SystemTime")).otherwise(get("TimeCreated"))
        return F.create_map(*[x for k, v in {
            "Channel": there(get("Channel")), "EventID": _element(get("EventID")), "Computer": there(get("Computer")), "Provider_Name": there(provider),
            "TimeCreated": there(when), "UserID": F.nullif(attribute("Security", "UserID"), F.lit("")),
        }.items() for x in (F.lit(k), v)])

    system = F.map_filter(_let(_object(part("System")), named), lambda k, v: v.isNotNull())
    data = _over(_section(part("EventData"), False), _section(part("UserData"), True))
    return _let(_over(system, _elements(data)), _without_blanks)


def flatten_flat(m: Column) -> Column:
    """A flat record of a public attack data set: envelope dropped, the time renamed, and source and host too unless their new names are taken."""
    get = lambda k: F.try_element_at(m, F.lit(k))
    taken = lambda old, new: (F.lit(old), F.map_contains_key(m, new))
    kept = F.map_filter(_without(m, (*ENVELOPE, "@timestamp")), lambda k, v: ~F.coalesce(*[F.when(k == old, ~there) for old, there in (taken("SourceName", "Provider_Name"), taken("Hostname", "Computer"))], F.lit(False)))
    renamed = lambda old, new: F.when(~F.map_contains_key(m, new), get(old))
    return _put(kept, Provider_Name=renamed("SourceName", "Provider_Name"), Computer=renamed("Hostname", "Computer"), TimeCreated=get("@timestamp"))


def cloudtrail(m: Column) -> Column:
    return _put(_without(m, CLOUDTRAIL_ENVELOPE), Channel=F.lit(CLOUDTRAIL), EventID=F.lit(0))


def unescape(text: Column) -> Column:
    """A text with its character references decoded: by name (HTML's), decimal and hexadecimal. Unknown names stay."""
    names = F.create_map(*[x for name, code in name2codepoint.items() for x in (F.lit(name), F.lit(chr(code)))], F.lit("apos"), F.lit("'"))
    piece = r"&#[0-9]+;?|&#[xX][0-9a-fA-F]+;?|&[A-Za-z][A-Za-z0-9]*;|[^&]+|&"

    def decoded(t: Column) -> Column:
        decimal, hexed = F.regexp_extract(t, r"^&#([0-9]+);?$", 1), F.regexp_extract(t, r"^&#[xX]([0-9a-fA-F]+);?$", 1)
        digits = F.ltrim(F.when(decimal != "", F.conv(decimal, 10, 16)).otherwise(hexed), F.lit("0"))
        code = F.lpad(F.when((F.length(digits) == 0) | (F.length(digits) > 6) | ((F.length(digits) == 6) & (F.substring(digits, 1, 2) != "10")), "FFFD").otherwise(digits), 8, "0")
        char = F.decode(F.unhex(code), "UTF-32")
        return F.when((decimal != "") | (hexed != ""), char).otherwise(F.coalesce(F.try_element_at(names, F.regexp_extract(t, r"^&(\w+);$", 1)), t))

    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(F.regexp_extract_all(text, F.lit(piece), F.lit(0)), decoded), "")).otherwise(text)


def _first(keys: Column, values: Column) -> Column:
    """A map in which the first of repeated keys counts."""
    return _let(keys, lambda k: F.map_from_arrays(F.array_distinct(k), F.transform(F.array_distinct(k), lambda x: F.element_at(values, F.array_position(k, x).cast("int")))))


def sysmon_xml(line: Column) -> Column:
    """Fields of a Sysmon for Linux line; null without an event id. An empty element is an empty text; data count before the head, and the last of repeated ones."""
    part = lambda p: F.nullif(F.regexp_extract(line, p, 1), F.lit(""))
    found = r'(?s)<Data Name="([^"]+)"(?:\s*/>|>(.*?)</Data>)'
    names, values = (F.regexp_extract_all(line, F.lit(found), F.lit(i)) for i in (1, 2))
    fields = _first(F.reverse(names), F.reverse(F.transform(values, unescape)))
    head = {"Channel": F.lit(LINUX_SYSMON), "EventID": part(r"<EventID>(\d+)</EventID>"), "Provider_Name": F.lit("Linux-Sysmon"), "Computer": part(r"<Computer>(.*?)</Computer>"), "TimeCreated": part(r'<TimeCreated SystemTime="([^"]+)"')}
    return F.when(head["EventID"].isNotNull(), _over(_put(F.create_map().cast(_MAP), **head), fields))


def auditd(line: Column) -> Column:
    """Fields of an auditd record, raw or interpreted; null for other lines. The first of repeated keys counts."""
    cut = F.substring_index(line, "\x1d", 1)
    head = r"(?s)^type=(\S+)\s+(?:msg=)?audit\(([^)]*)\)\s*:\s*(.*)$"
    kind, when, rest = (F.regexp_extract(cut, head, i) for i in (1, 2, 3))
    pair = r"""([A-Za-z0-9_\-]+)=("(?:[^"\\]|\\.)*"|'[^']*'|\S*)"""
    keys, values = (F.regexp_extract_all(rest, F.lit(pair), F.lit(i)) for i in (1, 2))
    bare = F.transform(values, lambda v: F.when(v.rlike("^\"(?s).*\"$|^'(?s).*'$"), F.substring(v, 2, F.length(v) - 2)).otherwise(v))
    fields = _without(_first(keys, bare), ("type",))
    return F.when(kind != "", _put(fields, type=kind, Channel=F.lit(AUDITD), EventID=F.lit(0), audit_id=when))


def _logged(line: Column) -> Column:
    """Whether sysmon_xml or auditd makes an event of a line."""
    return line.rlike(r"<EventID>\d+</EventID>") | F.substring_index(line, "\x1d", 1).rlike(r"(?s)^type=\S+\s+(?:msg=)?audit\([^)]*\)\s*:\s*.*$")


def _is_sysmon(message: Column) -> Column:
    return F.contains(message, F.lit("<Event>")) & F.contains(message, F.lit("Linux-Sysmon"))


def syslog(message: Column) -> Column:
    """The event that a syslog message wraps: Sysmon for Linux, or an auditd record."""
    return F.when(_is_sysmon(message), sysmon_xml(message)).when(message.startswith("type="), auditd(message))


def is_event(doc: Column, any_object: bool | Column = True) -> Column:
    """Whether `normalised` makes an event of a VARIANT, told without building it; or only of CloudTrail's and syslog's."""

    any_object = F.lit(any_object) if isinstance(any_object, bool) else any_object

    def known(v: Column) -> Column:
        has = lambda k: F.try_variant_get(v, f"$.{k}", "variant").isNotNull()
        line = F.coalesce(F.try_variant_get(v, "$.SyslogMessage", "string"), F.to_json(F.try_variant_get(v, "$.SyslogMessage", "variant")))
        trail, wrapped = has("eventSource") & has("eventName"), (_is_sysmon(line) | line.startswith("type=")) & _logged(line)
        return F.schema_of_variant(v).startswith("OBJECT") & (any_object | trail | F.coalesce(wrapped, F.lit(False)))

    return F.coalesce(_let(doc, known), F.lit(False))


def normalised(doc: Column) -> Column:
    """A JSON object in any of the known forms, as an event's fields; null for what is no object."""

    def known(m: Column) -> Column:
        has = lambda k: F.map_contains_key(m, k)
        wrapped = F.try_element_at(m, F.lit("SyslogMessage"))
        event = F.try_element_at(m, F.lit("Event"))
        return (
            F.when(m.isNull(), None)
            .when(has("eventSource") & has("eventName"), cloudtrail(m))
            .when(F.coalesce((_is_sysmon(wrapped) | wrapped.startswith("type=")) & _logged(wrapped), F.lit(False)), syslog(wrapped))
            .when(F.coalesce(event.startswith("{"), F.lit(False)), _let(_object(event), flatten_evtx))
            .when(has("Hostname") | has("SourceName") | has("@timestamp"), flatten_flat(m))
            .otherwise(m)
        )

    return _let(_parsed(doc), known)


def aliased(m: Column) -> Column:
    """Fields of Security 4688 and Defender events under the names that rules use too."""

    def named(m: Column) -> Column:
        get = lambda k: F.try_element_at(m, F.lit(k))
        channel = F.lower(F.coalesce(get("Channel"), F.lit("")))
        add = lambda names: _put(m, **{new: F.coalesce(get(new), get(old)) for old, new in names.items()})
        return F.when((channel == SECURITY) & (get("EventID") == "4688"), add(ALIASES_4688)).when(channel == DEFENDER, add(ALIASES_DEFENDER)).otherwise(m)

    return _let(m, named)


def numbered(rows: DataFrame, there: Column) -> DataFrame:
    """The rows that are `there`, with event_idx from 0 in each file; no row is shuffled.

    A task reads the splits of its files one after the other, so a row's place in its split is its running number in the
    task less that of the split's first row. These and the splits' counts come from a pass that evaluates `there` alone,
    and only they are shuffled and added up.
    """
    own = rows.filter(there).withColumn("__row", F.monotonically_increasing_id())
    splits = own.groupBy("file", "__start").agg(F.count("*").alias("n"), F.min("__row").alias("first"))
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("__start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = splits.select("file", "__start", (earlier - F.col("first")).alias("__offset"))
    return own.join(F.broadcast(offsets), ["file", "__start"]).withColumn("event_idx", F.col("__row") + F.col("__offset")).drop("__row", "__start", "__offset")  # broadcast: a row for each split of spark.sql.files.maxPartitionBytes


def text_lines(spark: SparkSession, paths: str | list[str], glob: str | None = None) -> DataFrame:
    """file, __start (of the split), value of text files, gzip included; folders recursively."""
    read = spark.read.option("recursiveFileLookup", True)
    if glob:
        read = read.option("pathGlobFilter", glob)
    return read.text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("__start"), "value")


def _events(df: DataFrame) -> DataFrame:
    """file, event_idx and the promoted columns of event maps."""
    out = df.withColumn("event", aliased(F.col("event")))
    get = lambda k: F.try_element_at("event", F.lit(k))
    return out.select("file", "event_idx", get("Channel").alias("Channel"), get("EventID").try_cast("int").alias("EventID"), "event")


def _json(text: Column, strict: bool = False) -> Column:
    return F.parse_json(text) if strict else F.try_parse_json(text)


def read_jsonl(spark: SparkSession, paths: str | list[str], strict: bool = False, glob: str | None = None) -> DataFrame:
    """JSON lines. Blank lines are skipped; bad lines and what is no object are dropped, or raise if strict."""
    lines = text_lines(spark, paths, glob).filter(F.trim("value") != "")
    doc = _json(F.col("value"), strict)
    return _events(numbered(lines, is_event(doc)).withColumn("event", normalised(F.to_json(doc))))


def _line_records(v: Column) -> Column:
    """The records of a line: of a CloudTrail document those that it lists, else the line."""
    listed = F.from_json(F.get_json_object(v, "$.Records"), "array<string>")
    return F.when(v.startswith("{"), F.coalesce(listed, F.array(v))).otherwise(F.array(v))


def _line_event(v: Column, as_json: Column | None = None) -> tuple[Column, Column]:
    """Whether a line is an event, and the event: Sysmon XML, auditd, or JSON of CloudTrail or syslog, told by how it starts; any JSON object where `as_json`."""
    doc, any_json = F.try_parse_json(v), F.lit(False) if as_json is None else as_json
    is_json = any_json | v.startswith("{")
    there = F.when(is_json, is_event(doc, any_json)).otherwise(v.rlike("^(?:<Event|type=)") & _logged(v))
    return there, F.when(is_json, normalised(F.to_json(doc))).when(v.startswith("<Event"), sysmon_xml(v)).when(v.startswith("type="), auditd(v))


def parse_lines(lines: DataFrame) -> DataFrame:
    """Events of text lines (file, __start, value), each line told by how it starts."""
    pieces = lines.select("file", "__start", F.explode(_line_records(F.ltrim("value"))).alias("value"))
    there, event = _line_event(F.ltrim("value"))
    return _events(numbered(pieces, there).withColumn("event", event))


def read_text_logs(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return parse_lines(text_lines(spark, paths))


def read_json_files(spark: SparkSession, paths: str | list[str], glob: str = "*", skip_broken: bool = False) -> DataFrame:
    """JSON documents of any size, zip and tar archives of them, and logs in either, told by their first bytes.

    A broken file or member raises, or is passed over as a whole. Events of an archive are numbered through its members.
    """
    listed = members(spark, paths, glob, skip_broken)
    rows = records(listed, skip_broken).withColumnRenamed("member", "__start")
    there, event = _line_event(F.ltrim("value"), F.col("kind") == "json")
    return _events(numbered(rows, there).withColumn("event", event))


#: What read_logs takes for lines, and of these for JSON lines.
LINES, JSON_LINES = "{jsonl,ndjson,jsonl.gz,ndjson.gz,log,txt,log.gz,txt.gz}", r"\.(?:jsonl|ndjson)(?:\.gz)?$"


def read_logs(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Any mix of files, told apart by their suffixes: .jsonl and .ndjson, .log and .txt (each also .gz), .json, .zip, .tar.gz. All lines are one scan."""
    as_json = F.col("file").rlike(JSON_LINES)
    v = F.ltrim("value")
    pieces = text_lines(spark, paths, f"*.{LINES}").select("file", "__start", F.explode(F.when(as_json, F.array("value")).otherwise(_line_records(v))).alias("value"))
    there, event = _line_event(v, as_json)
    return _events(numbered(pieces, there).withColumn("event", event)).unionByName(read_json_files(spark, paths, "*.{json,json.gz,zip,tar.gz,tgz}"))


def write_jsonl(events: DataFrame, path: str, gzipped: bool = True, rows: int = 0) -> int:
    """JSON lines, in files of at most `rows`; columns that start with two underscores are helpers. Returns how many were written."""
    plain = events.select(*[c for c in events.columns if not c.startswith("__")])
    write = plain.write.mode("overwrite").option("compression", "gzip" if gzipped else "none")
    (write.option("maxRecordsPerFile", rows) if rows else write).json(path)
    return events.sparkSession.read.text(path).count()


def ingest(spark: SparkSession, paths: str | list[str], out: str, shard_size: int = 100_000) -> DataFrame:
    """Normalises logs into Parquet by channel, in files of at most shard_size events; returns the table."""
    events = read_logs(spark, paths).withColumn("channel_key", F.lower(F.coalesce("Channel", F.lit("none"))))
    events.write.mode("overwrite").option("maxRecordsPerFile", shard_size).partitionBy("channel_key").parquet(out)
    return spark.read.parquet(out)


def in_order(events: DataFrame) -> DataFrame:
    """events (file, event_idx, ...) with position, their number over all files in the order of the files' names. Only the files' counts are gathered."""
    counts = events.groupBy("file").agg(F.count("*").alias("__before"))
    return events.join(F.broadcast(before(counts, "file", "__before")), "file").withColumn("position", F.col("__before") + F.col("event_idx")).drop("__before")  # broadcast: a row for each file


def write_shards(events: DataFrame, out: str, size: int = 100_000, gzipped: bool = True) -> DataFrame:
    """JSON lines in shards of exactly `size` events, the last one less, in the order of files and events.

    A shard is one file, in a folder shard=N below `out`, written by one task from some `size` events; rerun tasks write
    the same. Returns shard, n of what was written.
    """
    plain = in_order(events)
    plain = shards(plain, size, "position").select("shard", "position", F.to_json("event").alias("value"))
    sorted_ = plain.repartition("shard").sortWithinPartitions("shard", "position").select("shard", "value")
    sorted_.write.mode("overwrite").partitionBy("shard").option("compression", "gzip" if gzipped else "none").text(out)
    return events.sparkSession.read.text(out).groupBy("shard").agg(F.count("*").alias("n"))


def shards(events: DataFrame, size: int, index: str = "event_idx") -> DataFrame:
    """Adds the number of each event's shard of `size` events; the index must have no gaps."""
    return events.withColumn("shard", F.floor(F.col(index) / size).cast("int"))
