"""Snapshot lines: scan, validation, quarantine, flattening, run header."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from abuse_lens.config import DEFAULT_INTERVAL_SEC
from abuse_lens.functions import net
from abuse_lens.functions.timetext import hour_seconds
from abuse_lens.schema import COUNTERS, KEY_TYPES, READABLE_VERSIONS, SNAPSHOT, U16_MAX, U32_MAX
from abuse_lens.sinks import files

_CORRUPT = "_corrupt"
_BUCKET_FIELDS = ("key_type", "src_ip", "dst_port", *COUNTERS)
_REQUIRED = tuple(f for f in _BUCKET_FIELDS if f != "dst_port")
_HEADER_FIELDS = (
    "version", "aggregation", "ts_unix_sec", "interval_sec", "run_id", "counter_mode", "base_ts_unix_sec",
    "dst_ports", "buckets",
)
_U64 = {"ts_unix_sec", "run_id", "base_ts_unix_sec"}
_U32_COUNTERS = tuple(c for c in COUNTERS if c != "bytes")


def read_lines(spark: SparkSession, directory: str, places: bool = False) -> DataFrame:
    """Lines of a directory's snapshot files; with ``places``, what :func:`located` needs to number them.

    These are the ``*.jsonl`` files directly in it, and the hourly folders that the
    snapshot sink writes there; files in other folders are not read.  The parts of
    an hourly folder are named as one file of that hour.
    """
    place = [F.col("_metadata.file_block_start").alias("block_start"), F.monotonically_increasing_id().alias("row")] if places else []
    flat = spark.read.schema("value string").option("pathGlobFilter", "*.jsonl").option("recursiveFileLookup", "false")
    found = [
        # named one by one: Spark leaves out files beside partition folders
        flat.text(files.directly_in(spark, directory, ".jsonl") or directory).select(
            "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_name").alias("file_name"), *place
        )
    ]
    if files.partition_values(spark, directory, "hour"):
        hourly = spark.read.schema("value string, hour string").option("basePath", directory).text(f"{directory}/hour=*")
        name = F.concat(F.lit("snapshot_"), F.col("hour"), F.lit(".jsonl"))
        found.append(hourly.select("value", F.col("_metadata.file_path").alias("file"), name.alias("file_name"), *place))
    return found[0] if len(found) == 1 else found[0].union(found[1])


def located(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """Add ``line`` (from 1, blank ones counted) and ``location`` (``file:line``) to judged ``rows`` of ``lines``.

    ``lines`` are read with ``places``.  Rows of a block have consecutive numbers, whatever task reads it, so a row's place in
    its block is a difference; the lines of the blocks before it are summed over one row per block.  A file split
    over many tasks is never gathered.  The lines are scanned once more to be counted, but parsed only once.
    """
    block = ["file", "block_start"]
    before = Window.partitionBy("file").orderBy("block_start").rowsBetween(Window.unboundedPreceding, -1)
    blocks = lines.groupBy(*block).agg(F.min("row").alias("_first"), F.count(F.lit(1)).alias("_lines"))
    blocks = blocks.select(*block, "_first", F.coalesce(F.sum("_lines").over(before), F.lit(0)).alias("_before"))
    placed = rows.join(blocks, block).withColumn("line", F.col("_before") + F.col("row") - F.col("_first") + 1)
    name = F.substring_index("file", "/", -1)
    return placed.withColumn("location", F.concat_ws(":", name, "line")).drop("_before", "_first", "block_start", "row")


def snapshot_files(lines: DataFrame) -> DataFrame:
    """Hourly snapshot files among the scanned ones, oldest first."""
    hour = F.regexp_extract("file_name", r"^snapshot_(\d{10})\.jsonl$", 1)
    named = lines.select("file", hour_seconds(hour).alias("hour_ts")).distinct()
    return named.where(F.col("hour_ts").isNotNull()).orderBy("hour_ts", "file")


def _name_defect(names: Column) -> Column:
    """Why the field names of a bucket reject its whole line; null when they are fine."""
    known = F.array(*[F.lit(f) for f in _BUCKET_FIELDS])
    return (
        F.when(names.isNull(), "bucket is not an object")
        .when(F.size(F.array_distinct(names)) != F.size(names), "duplicate bucket field")
        .when(F.size(F.array_except(names, known)) > 0, "unknown bucket field")
    )


def _bucket_defect(b: Column, named: Column) -> Column:
    """Why a bucket rejects its whole line, what is wrong with its field names first; null when it is fine."""
    missing = F.lit(False)
    for f in _REQUIRED:
        missing = missing | b[f].isNull()
    in_range = F.lit(True)
    for c in _U32_COUNTERS:
        in_range = in_range & b[c].between(0, U32_MAX)
    in_range = in_range & (b["bytes"] >= 0) & (b["dst_port"].isNull() | b["dst_port"].between(0, U16_MAX))
    return (
        F.when(named.isNotNull(), named)
        .when(missing, "missing bucket field")
        .when(~b["key_type"].isin(*KEY_TYPES), "unknown key type")
        .when(~b["src_ip"].rlike(net.DOTTED_QUAD), "invalid IP address")
        .when(~in_range, "bucket value out of range")
    )


@dataclass(frozen=True)
class Parsed:
    """``judged`` lines carry a ``reason`` (null for a good one)."""

    good: DataFrame
    bad: DataFrame
    judged: DataFrame


def parse(lines: DataFrame) -> Parsed:
    """Lines to snapshot rows; unusable lines go to ``bad`` with a reason.

    Blank lines are neither.  Numbers must be integers of the right size, the
    version one of those readable, every bucket complete: one bad bucket
    rejects its line.  Unknown fields beside the known ones are ignored.
    """
    from pyspark.sql import types as T

    schema = T.StructType([*SNAPSHOT.fields, T.StructField(_CORRUPT, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}
    origin = [c for c in lines.columns if c in ("file", "file_name", "block_start", "row")]
    text = lines.select(F.btrim("value", F.lit(" \t\r\n\f\v")).alias("value"), *origin).where(F.col("value") != "")
    s = F.col("s")
    # A bucket's names are judged where they are read: those of a whole line take several times its text.
    judge = lambda text: F.transform(F.array(F.json_object_keys(text)), _name_defect)[0]
    names = F.transform(F.from_json("value", "buckets array<string>")["buckets"], judge)
    # As a generator the two readings happen once per line; as expressions they
    # would be repeated for every field that is looked at below.
    once = F.array(F.struct(F.from_json("value", schema, options).alias("s"), names.alias("names"), F.json_object_keys("value").alias("top")))
    read = text.select("*", F.inline(once))
    header_missing = F.lit(False)
    for f in _HEADER_FIELDS:
        header_missing = header_missing | s[f].isNull()
    # Totals belong to every aggregates block, whatever else it lacks.
    block = s["resp_aggregates"]
    header_missing = header_missing | (block.isNotNull() & (block["count"].isNull() | block["resp_bytes_total"].isNull()))
    known = F.filter("top", lambda n: n.isin(*SNAPSHOT.fieldNames()))
    repeated = F.size(F.array_distinct(known)) != F.size(known)
    header_ok = s["interval_sec"].between(0, U32_MAX)
    for f in sorted(_U64):
        header_ok = header_ok & (s[f] >= 0)
    ports_ok = F.forall(s["dst_ports"], lambda p: F.coalesce(p.between(0, U16_MAX), F.lit(False)))
    defects = F.filter(F.zip_with(s["buckets"], F.col("names"), _bucket_defect), lambda d: d.isNotNull())
    reason = (
        F.when(s.isNull() | s[_CORRUPT].isNotNull(), "malformed JSON")
        .when(repeated, "duplicate field")
        .when(header_missing, "missing field")
        .when(~header_ok | ~ports_ok, "value out of range")
        .when(~s["version"].isin(*READABLE_VERSIONS), "unsupported version")
        .otherwise(F.try_element_at(defects, F.lit(1)))
    )
    judged = read.withColumn("reason", reason)
    good = judged.where(F.col("reason").isNull()).select(*origin, "value", *[s[f].alias(f) for f in SNAPSHOT.fieldNames()])
    bad = judged.where(F.col("reason").isNotNull()).select(*origin, "value", "reason")
    return Parsed(good, bad, judged.select(*origin, "value", "reason"))


def parse_strict(lines: DataFrame) -> DataFrame:
    """Like :func:`parse`, but the first unusable line fails the query."""
    parsed = parse(lines)
    failing = parsed.bad.select(F.raise_error(F.concat("reason", F.lit(": "), "value")).cast("bigint").alias("version"))
    columns = parsed.good.columns
    empty = failing.select(
        *[F.col("version") if f.name == "version" else F.lit(None).cast(f.dataType).alias(f.name) for f in parsed.good.schema.fields]
    )
    return parsed.good.unionByName(empty.select(*columns))


def flattened(snapshots: DataFrame) -> DataFrame:
    """A row per bucket, and before them one per line, without ``pos``, that holds what may be long: text and header ports.

    What stands beside the exploded array is copied for every bucket, and a task holds the copies of a whole line.  So
    only short columns do: ``line`` names the line by its file and a digest of its text, made once per line.
    """
    text = F.col("value") if "value" in snapshots.columns else F.lit("")
    digest = F.md5(F.col("value").cast("binary")) if "value" in snapshots.columns else F.lit("")
    file = F.col("file") if "file" in snapshots.columns else F.lit("")
    head = ["version", "ts_unix_sec", "interval_sec", "run_id", "base_ts_unix_sec"]
    kinds = {f.name: f.dataType for f in snapshots.schema.fields}
    none = lambda name, kind: F.lit(None).cast(kind).alias(name)
    whole = F.struct(none("pos", "int"), text.alias("text"), F.col("dst_ports"), none("b", kinds["buckets"].elementType))
    one = lambda b, i: F.struct(i.alias("pos"), none("text", "string"), none("dst_ports", kinds["dst_ports"]), b.alias("b"))
    lines = snapshots.select(
        *head, file.alias("file"), F.concat(file, F.lit("#"), digest).alias("line"),
        F.concat(F.array(whole), F.transform("buckets", one)).alias("rows"),
    )
    rows, b = lines.select(*head, "file", "line", F.explode("rows").alias("r")), F.col("r.b")
    return rows.select(
        *head, "file", "line", "r.pos", "r.text", "r.dst_ports", b["key_type"].alias("key_type"),
        net.ipv4_to_long(b["src_ip"]).alias("ip_u32"), b["dst_port"].alias("dst_port"), *[b[c].alias(c) for c in COUNTERS],
    )


def counter_rows(snapshots: DataFrame) -> DataFrame:
    """One row per bucket; ``seq`` orders rows of one key at one ``ts``.

    That is by file, then by the line's text, then by position in the line: the same
    order in every run.  Spark does not number the lines of a file.
    """
    return counters_of(flattened(snapshots))


def counters_of(flat: DataFrame) -> DataFrame:
    """:func:`counter_rows` of :func:`flattened` lines."""
    ordinal = F.array_position(F.array(*[F.lit(k) for k in KEY_TYPES]), F.col("key_type")).cast("int") - 1
    return flat.where(F.col("pos").isNotNull()).select(
        F.col("ts_unix_sec").alias("ts"),
        F.col("base_ts_unix_sec").alias("base_ts"),
        "run_id",
        F.concat("line", F.lit("#"), F.lpad(F.col("pos").cast("string"), 10, "0")).alias("seq"),
        "key_type",
        ordinal.alias("key_ord"),
        "ip_u32",
        F.col("dst_port").cast("int").alias("dst_port"),
        *COUNTERS,
    )


def between(snapshots: DataFrame, start: int, end: int, ts: str = "ts_unix_sec") -> DataFrame:
    """Time slice, both ends included."""
    return snapshots.where(F.col(ts).between(start, end))


def run_header(snapshots: DataFrame) -> DataFrame:
    """One row: time bounds, version range, ports, run and interval of the earliest snapshot."""
    return header_of(flattened(snapshots))


def header_of(flat: DataFrame) -> DataFrame:
    """:func:`run_header` of :func:`flattened` lines."""
    lines = flat.where(F.col("pos").isNull())
    earliest = F.min_by(F.struct("run_id", "interval_sec"), F.struct("ts_unix_sec", "file", "text"))
    grouped = lines.agg(
        F.min("ts_unix_sec").alias("start_ts"),
        F.max("ts_unix_sec").alias("end_ts"),
        F.min("version").alias("version_min"),
        F.max("version").alias("version_max"),
        earliest.alias("e"),
    )
    ports = lines.select(F.explode("dst_ports").alias("p")).union(flat.select("dst_port"))
    # Ports are 16-bit, so the set below has at most 65,536 members.
    present = ports.distinct().agg(F.array_sort(F.collect_list("p")).alias("ports"))
    return grouped.select(
        "start_ts",
        "end_ts",
        (F.col("end_ts") - F.col("start_ts")).alias("duration_sec"),
        F.coalesce("version_min", F.lit(0).cast("bigint")).alias("version_min"),
        F.coalesce("version_max", F.lit(0).cast("bigint")).alias("version_max"),
        F.coalesce(F.col("e.run_id"), F.lit(0).cast("bigint")).alias("run_id"),
        F.coalesce(F.col("e.interval_sec"), F.lit(DEFAULT_INTERVAL_SEC).cast("bigint")).alias("interval_sec"),
        present.scalar().alias("ports"),
    )


def ports_present(snapshots: DataFrame) -> DataFrame:
    """Header ports and bucket ports, each once."""
    header = snapshots.select(F.explode("dst_ports").alias("port"))
    buckets = snapshots.select(F.explode(F.transform("buckets", lambda b: b["dst_port"])).alias("port"))
    return header.union(buckets.where(F.col("port").isNotNull())).distinct()
