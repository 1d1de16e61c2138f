"""Folders of sessions as tables: typed JSON documents, screen readings, optional lab tables, recording files.

A session's folder is named after it; the session's id is taken from the path, so a document
can't claim another session's rows. Readers take globs and read all sessions in one job.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

SPAN = "struct<seg: string, text: string, t: double, name: string, token: string, raw_text: string>"
#: The families of cited spans, the kinds of events and the alignment methods that documents may have.
SPANS = ("bias_statements", "playbooks_mentioned", "stated_levels", "stated_stops_targets", "checkins", "tilt_markers", "brief_refs", "observations")
EVENT_KINDS = ("hourly_checkin", "bias_statement", "no_trade_zone", "trade_zone", "tilt", "break", "rule_mention", "brief_ref", "grok_ref")
METHODS = ("ocr_clock", "filename", "chapter_fill", "manual", "invalid", "sidecar")

PART = "struct<path: string, sha256: string, duration_s: double, offset_s: double, filename: string>"
DOCUMENTS: dict[str, str] = {
    "session": (
        f"schema_version string, id string, language string, app_version string, recording struct<path: string, sha256: string, start_wallclock_vienna: string, duration_s: double, tracks: array<string>, "
        f"chapters: array<struct<t: double, name: string>>, filename: string, parts: array<{PART}>>, "
        "alignment struct<offset_s: double, drift_s_per_h: double, confidence: double, method: string, samples: array<struct<video_t: double, ocr_text: string, parsed_wallclock: string, residual_s: double>>>"
    ),
    "transcript": "schema_version string, provider string, model string, prompt_version string, language string, segments array<struct<id: string, t0: double, t1: double, lang: string, text: string, words: array<struct<w: string, t0: double, t1: double, p: double>>>>",
    "insights": (
        "schema_version string, provider string, model string, prompt_version string, " + ", ".join(f"{s} array<{SPAN}>" for s in SPANS) + ", gaps array<string>, "
        "session_events array<struct<t: double, kind: string, seg: string, text: string>>, summary_de string, summary_en string, visual_notes array<struct<text: string, t: double, frames_cited: array<string>, clip: string>>"
    ),
}
CORRUPT = "_corrupt_record"


def _any(items: str, bad) -> Column:  # noqa: ANN001
    return F.exists(F.coalesce(F.col(items), F.array()), bad)


def _problem(kind: str) -> Column:
    """The first thing that makes a document unusable."""
    out = F.when(F.col(CORRUPT).isNotNull(), "not a document")
    if kind == "session":
        a = F.col("alignment")
        out = out.when(F.col("id").isNull(), "no id").when(F.col("id") != F.col("session_id"), "another session's id").when(F.col("recording.path").isNull() | F.col("recording.duration_s").isNull(), "no recording")
        return out.when(a.isNotNull() & (~F.coalesce(a["method"].isin(*METHODS), F.lit(False)) | ~F.coalesce(a["confidence"].between(0, 1), F.lit(False)) | a["offset_s"].isNull() | a["drift_s_per_h"].isNull()), "unknown alignment")
    out = out.when(F.col("provider").isNull() | F.col("model").isNull(), "no provider")
    if kind == "transcript":
        return out.when(_any("segments", lambda s: s["id"].isNull() | s["text"].isNull() | s["t0"].isNull() | s["t1"].isNull()), "segment without id, times or text")
    out = out.when(_any("session_events", lambda e: ~F.coalesce(e["kind"].isin(*EVENT_KINDS), F.lit(False)) | e["seg"].isNull() | e["t"].isNull()), "unknown event")
    cited = F.lit(False)
    for s in SPANS:
        cited = cited | _any(s, lambda x: x["seg"].isNull() | x["text"].isNull())
    return out.when(cited, "span without segment or text")


def read_documents(spark: SparkSession, pattern: str, kind: str, level: int = 1) -> DataFrame:
    """session_id, the document's columns and problem (null: usable) for each JSON file that the glob names.

    kind: session, transcript or insights; level: how far up the path the session's folder is. Files that are no such
    JSON are rows with a problem and null columns. Fields of other names are ignored, missing ones are null.
    """
    schema = StructType.fromDDL(DOCUMENTS[kind]).add(CORRUPT, "string")
    raw = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(pattern)
    parts = F.split(F.col("_metadata.file_path"), "/")
    folder = F.element_at(parts, -1 - level)
    named = raw.select(F.regexp_replace(F.url_decode(folder), "^session_id=", "").alias("session_id"), *schema.fieldNames())
    return named.withColumn("problem", _problem(kind)).drop(CORRUPT)


def usable(docs: DataFrame) -> DataFrame:
    return docs.where("problem is null").drop("problem")


def rejects(docs: DataFrame) -> DataFrame:
    return docs.where("problem is not null").select("session_id", "problem")


def segments(transcripts: DataFrame) -> DataFrame:
    """session_id, i, seg, t0, t1, lang, text, n_words."""
    s = usable(transcripts).select("session_id", F.posexplode("segments").alias("i", "s"))
    return s.select("session_id", "i", F.col("s.id").alias("seg"), "s.t0", "s.t1", F.coalesce("s.lang", F.lit("de")).alias("lang"), "s.text", F.coalesce(F.size("s.words"), F.lit(0)).alias("n_words"))


def spans(insights: DataFrame) -> DataFrame:
    """session_id, field, i, seg, text, t, name, token, raw_text: cited spans of all families."""
    families = F.create_map(*(x for s in SPANS for x in (F.lit(s), F.col(s))))
    each = usable(insights).select("session_id", F.explode(families).alias("field", "list"))
    return each.select("session_id", "field", F.posexplode("list").alias("i", "s")).select("session_id", "field", "i", "s.*")


def events(insights: DataFrame) -> DataFrame:
    """session_id, t, kind, seg, text."""
    return usable(insights).select("session_id", F.explode("session_events").alias("e")).select("session_id", "e.t", "e.kind", "e.seg", F.coalesce("e.text", F.lit("")).alias("text"))


READING = "session_id string, t double, roi string, text string, confidence double, parsed string"


def write_readings(readings: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Screen readings by (session_id, t, roi) within files; the texts are kept as read, a null text as empty."""
    whole = readings.where("session_id is not null and t is not null and roi is not null").select("session_id", F.col("t").cast("double").alias("t"), "roi", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("confidence").cast("double"), F.lit(0.0)).alias("confidence"), "parsed")
    whole.repartition("session_id").sortWithinPartitions("session_id", "t", "roi").write.mode(mode).parquet(path)


def read_readings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(READING).parquet(path)


@dataclass(frozen=True)
class LabKind:
    names: tuple[str, ...]
    columns: str


#: File names, the first that is there counts, and columns of the lab's tables.
LAB: dict[str, LabKind] = {
    "attribution": LabKind(("attribution.parquet", "journal_attribution.parquet"), "trade_id string, entry_fill_id string, token string, alignment string, note string"),
    "zones": LabKind(("zones.parquet", "journal_zones.parquet"), "trade_id string, entry_fill_id string, zone string, distance_ticks double"),
    "triggers": LabKind(("triggers.parquet", "journal_triggers.parquet"), "trade_id string, entry_fill_id string, trigger string, strength double"),
}


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def read_lab(spark: SparkSession, folder: str, kinds: Mapping[str, LabKind] = LAB) -> tuple[dict[str, DataFrame], DataFrame]:
    """Lab tables by kind, and gaps (kind, gap): kinds without a file are empty typed tables with a gap, columns that a file lacks are null with a gap.

    An entry fill may come as fill_id. Columns beyond the contract are dropped. A table's row_no is its row's place among equal keys: by all columns.
    """
    from pyspark.sql import Window

    from .ledger_tables import fitted

    tables: dict[str, DataFrame] = {}
    gaps: list[tuple[str, str]] = []
    for kind, what in kinds.items():
        schema = StructType.fromDDL(what.columns)
        found = next((p for n in what.names if exists(spark, p := f"{folder.rstrip('/')}/{n}")), None)
        if found is None:
            gaps.append((kind, "missing"))
            tables[kind] = spark.createDataFrame([], schema)
            continue
        rows = spark.read.parquet(found)
        if "entry_fill_id" not in rows.columns and "fill_id" in rows.columns:
            rows = rows.withColumnRenamed("fill_id", "entry_fill_id")
        gaps += [(kind, f"no {f.name}") for f in schema if f.name not in rows.columns]
        tables[kind] = _blank_to_null(fitted(rows, schema), schema.fields)
    w = Window.partitionBy("entry_fill_id", "trade_id")
    tables = {k: t.withColumn("row_no", F.row_number().over(w.orderBy(*(F.col(c).asc_nulls_last() for c in t.columns)))) for k, t in tables.items()}
    return tables, spark.createDataFrame(gaps, "kind string, gap string")


def _blank_to_null(rows: DataFrame, fields: Sequence[StructField]) -> DataFrame:
    return rows.select(*(F.nullif(F.trim(f.name), F.lit("")).alias(f.name) if f.dataType.simpleString() == "string" else F.col(f.name) for f in fields))


def recordings(spark: SparkSession, pattern: str, suffixes: Sequence[str], digest_below: int = 0) -> DataFrame:
    """path, name, size, modified_us, sha256 of the files of a folder or glob with one of the suffixes (any case), hidden ones aside.

    Contents aren't read: the scan has no content column. Digests are made for files of less than digest_below bytes, by a second
    scan whose filter on the length keeps larger files closed; those of others are null. Files of no bytes aren't scanned, and so not listed.
    """
    wanted = F.lit(False)
    for s in suffixes:
        wanted = wanted | F.lower("name").endswith(s.lower())
    name = F.url_decode(F.element_at(F.split("path", "/"), -1))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(pattern)
    seen = files.select("path", name.alias("name"), F.col("length").alias("size"), F.unix_micros("modificationTime").alias("modified_us")).where(wanted & ~F.col("name").startswith("."))
    if digest_below <= 0:
        return seen.withColumn("sha256", F.lit(None).cast("string"))
    small = files.where(F.col("length") < digest_below).select(F.col("path").alias("d_path"), F.sha2("content", 256).alias("sha256"))
    return seen.join(small, F.col("path") == F.col("d_path"), "left").drop("d_path")


def start_hints(files: DataFrame, durations: DataFrame) -> DataFrame:
    """session_id, path, pause_hint_us, verified: what modification time, nominal start and duration leave for pauses, of a session's last file in chain order.

    durations: name, session_id, chain_no, start_us, duration_us. A copy changes the modification time, so a hint is never verified.
    """
    met = files.join(durations, "name")
    last = met.groupBy("session_id").agg(F.max_by(F.struct("path", "modified_us", "start_us", "duration_us"), F.struct("chain_no", "path")).alias("f"))
    return last.select("session_id", "f.path", (F.col("f.modified_us") - F.col("f.start_us") - F.col("f.duration_us")).alias("pause_hint_us"), F.lit(False).alias("verified"))
