"""Files in and out. Every reader returns a DataFrame; broken input goes to a second frame or column instead of failing."""

from __future__ import annotations

import uuid
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_blobs(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files by content: sha256, path, length, is_pdf, content; a content stored twice gives one row (the first path)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    rows = files.withColumn("sha256", F.sha2("content", 256)).withColumn("is_pdf", F.substring("content", 1, 5) == F.lit(b"%PDF-"))
    first = Window.partitionBy("sha256").orderBy("path")
    return rows.withColumn("_n", F.row_number().over(first)).filter("_n = 1").select("sha256", "path", "length", "is_pdf", "content")


def ingest_uploads(blobs: DataFrame, filename: str = "path") -> tuple[DataFrame, DataFrame]:
    """(source documents, rejects): only files that begin like a PDF are taken."""
    taken = blobs.filter("is_pdf").select("sha256", F.concat(F.lit("uploaded PDF ("), F.element_at(F.split(filename, "/"), -1), F.lit(")")).alias("version_label"), F.lit("upload").alias("origin"))
    return taken, blobs.filter(~F.coalesce("is_pdf", F.lit(False))).select("sha256", filename, F.lit("not_a_pdf").alias("error"))


def read_rubric(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A rubric file (YAML) as tables of fixed, small size: steps, tiers, weights, thresholds, citations."""
    import yaml

    spec = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    profile = Path(path).stem
    steps = [(profile, i, s["id"], s.get("name", "")) for i, s in enumerate(spec.get("steps", []))]
    tiers = [(profile, s["id"], label, tier) for s in spec.get("steps", []) for tier, field in (("expected", "essential_for"), ("recommended", "recommended_for")) for label in s.get(field) or []]
    weights = [(profile, label, step, float(w)) for label, by in (spec.get("scoring", {}).get("weights") or {}).items() for step, w in by.items()]
    limits = [(profile, s["id"], name, str(t["value"]), t["source"], bool(t["verified"])) for s in spec.get("steps", []) for name, t in (s.get("thresholds") or {}).items()]
    cites = [(profile, k, v) for k, v in (spec.get("citations") or {}).items()]
    return {
        "steps": spark.createDataFrame(steps, "profile string, pos int, step_id string, name string"),
        "tiers": spark.createDataFrame(tiers, "profile string, step_id string, label string, tier string"),
        "weights": spark.createDataFrame(weights, "profile string, label string, step_id string, weight double"),
        "thresholds": spark.createDataFrame(limits, "profile string, step_id string, name string, value string, source string, verified boolean"),
        "citations": spark.createDataFrame(cites, "profile string, source_id string, citation string"),
    }


def available_rubrics(folder: str, first: str = "synthesis") -> list[str]:
    """The ids of the rubric files, the default first, then by name."""
    return sorted((p.stem for p in Path(folder).glob("*.yaml")), key=lambda x: (x != first, x))


def resolve_standards(selected: DataFrame, citations: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Chosen standard ids in their order, with citation and whether any of the step's thresholds from that source is verified; an unknown id is an error.

    ``selected``: doc, step_id, ids. ``citations`` and ``thresholds`` are the rubric's tables.
    """
    ids = selected.select("doc", "step_id", F.posexplode("ids").alias("pos", "source_id"))
    ok = thresholds.groupBy("step_id", F.col("source").alias("source_id")).agg(F.max("verified").alias("verified"))
    j = ids.join(citations, "source_id", "left").join(ok, ["step_id", "source_id"], "left")
    known = F.when(F.col("citation").isNull(), F.raise_error(F.concat(F.lit("unknown standard: "), F.coalesce("source_id", F.lit("null"))))).otherwise(F.col("citation"))
    return j.select("doc", "step_id", "pos", "source_id", known.alias("citation"), F.coalesce("verified", F.lit(False)).alias("verified"))


def read_json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, broken lines) of an append-only log; blank and torn lines don't fail the read."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parsed = lines.withColumn("r", F.from_json("value", f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    rows = parsed.filter(F.col("r._corrupt").isNull()).select("r.*").drop("_corrupt")
    return rows, parsed.filter(F.col("r._corrupt").isNotNull()).select(F.col("value").alias("line"))


def read_json_files(spark: SparkSession, folder: str, schema: str, strict: bool = False) -> DataFrame:
    """One JSON object a file, with the file's stem; a broken file is left out, or fails the read if ``strict``."""
    files = spark.read.option("wholetext", "true").text(f"{folder}/*.json").withColumn("stem", F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1))
    parsed = files.withColumn("r", F.from_json("value", f"{schema}, _corrupt string", {"mode": "FAILFAST"} if strict else {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    return parsed.filter(F.col("r._corrupt").isNull()).select("stem", "r.*").drop("_corrupt")


def append_json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def write_atomic(rows: DataFrame, path: str) -> str:
    """Write a new version of a table beside the old ones and switch the pointer to it: readers see the old or the new one, whole.

    ``path`` holds folders version=<id> and the pointer CURRENT, which is replaced by renaming. The pointer is switched only
    once the version is complete, and what fails before leaves the old one in place. Returns the version. Old versions stay.
    """
    spark = rows.sparkSession
    version = uuid.uuid4().hex
    rows.write.mode("error").parquet(f"{path}/version={version}")
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target, fresh = (jvm.org.apache.hadoop.fs.Path(f"{path}/{name}") for name in ("CURRENT", f"CURRENT.{version}"))
    fs = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf) if target.toUri().getScheme() else jvm.org.apache.hadoop.fs.FileContext.getFileContext(conf)
    out = fs.create(fresh, jvm.java.util.EnumSet.of(jvm.org.apache.hadoop.fs.CreateFlag.CREATE), spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.CreateOpts, 0))
    out.write(bytearray(version.encode()))
    out.close()
    renames = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    renames[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    fs.rename(fresh, target, renames)
    return version


def read_current(spark: SparkSession, path: str) -> DataFrame:
    """The version of a table that write_atomic() made current last."""
    version = spark.read.format("binaryFile").load(f"{path}/CURRENT").first().content.decode()
    return spark.read.parquet(f"{path}/version={version}")


class BlobStore:
    """Bytes by their SHA-256 as a table partitioned by the hash's first two digits; equal contents are kept once.

    put() appends only contents that aren't there; delete() writes tombstones, and a later put() brings a content back.
    """

    SCHEMA = "sha256 string, content binary, at timestamp, deleted boolean, prefix string"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _log(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.SCHEMA).parquet(self.path)
        except AnalysisException:
            return self.spark.createDataFrame([], self.SCHEMA)

    def _state(self, hashes: DataFrame | None = None) -> DataFrame:
        """The hashes that are there; contents aren't read."""
        log = self._log() if hashes is None else self._log().join(hashes.select("sha256").distinct(), "sha256", "left_semi")
        return log.groupBy("sha256").agg(F.max_by("deleted", F.struct("at", "deleted")).alias("gone")).filter(~F.col("gone")).select("sha256")

    def put(self, contents: DataFrame, column: str = "content") -> DataFrame:
        """Handles (sha256) of the contents; repeated and known ones are written once."""
        hashed = contents.select(F.sha2(column, 256).alias("sha256"), F.col(column).alias("content")).filter(F.col("content").isNotNull())
        new = hashed.join(self._state(hashed), "sha256", "left_anti").dropDuplicates(["sha256"])
        new.select("sha256", "content", F.current_timestamp().alias("at"), F.lit(False).alias("deleted"), F.substring("sha256", 1, 2).alias("prefix")).write.mode("append").partitionBy("prefix").parquet(self.path)
        return hashed.select("sha256").distinct()

    def get(self, handles: DataFrame) -> DataFrame:
        """sha256 and content of the handles that are there."""
        there = self._state(handles)
        rows = self._log().filter(~F.col("deleted")).join(there, "sha256", "left_semi")
        return rows.groupBy("sha256").agg(F.first("content").alias("content"))

    def exists(self, handles: DataFrame) -> DataFrame:
        """The handles with whether they are there."""
        return handles.select("sha256").distinct().join(self._state(handles).withColumn("there", F.lit(True)), "sha256", "left").select("sha256", F.coalesce("there", F.lit(False)).alias("there"))

    def delete(self, handles: DataFrame) -> None:
        gone = self._state(handles).select("sha256", F.lit(None).cast("binary").alias("content"), F.current_timestamp().alias("at"), F.lit(True).alias("deleted"), F.substring("sha256", 1, 2).alias("prefix"))
        gone.write.mode("append").partitionBy("prefix").parquet(self.path)


def save_event(event: DataFrame, path: str) -> None:
    """Append events; created_at is stamped where the event has none. Partitioned by event."""
    stamped = event if "created_at" in event.columns else event.withColumn("created_at", F.lit(None).cast("timestamp"))
    stamped.withColumn("created_at", F.coalesce("created_at", F.current_timestamp())).write.mode("append").partitionBy("event").parquet(path)


def pinned(gold: DataFrame, engine: DataFrame, key: str = "source_sha256") -> DataFrame:
    """Gold records with their engine results by content hash; a record without its result stops the job."""
    j = gold.join(engine.withColumn("_there", F.lit(True)), key, "left")
    return j.filter(F.when(F.col("_there").isNull(), F.raise_error(F.concat(F.lit("no engine result for "), F.coalesce(key, F.lit("null"))))).otherwise(F.lit(True))).drop("_there")


def write_validation(report: DataFrame, origins: DataFrame, folder: str, treat_as_real: bool) -> str:
    """Write a validation report as JSON and as a Markdown table, behind a guard: returns the status.

    ``report``: metric, value, n, preliminary; ``origins``: the origin of each gold record. Only if all of them are
    blind_human may a report be called real; made-up records among real ones stop the job. Otherwise it is a demo, and the
    Markdown bears another name. A report is a few rows, so one task writes it.
    """
    said = origins.agg(F.coalesce(F.bool_and(F.col("origin").eqNullSafe("blind_human")), F.lit(False)).alias("blind"), F.array_sort(F.collect_set(F.when(~F.col("origin").eqNullSafe("blind_human"), F.coalesce("origin", F.lit("null"))))).alias("others")).first()
    if treat_as_real and not said.blind:
        raise ValueError(f"a real report needs blind_human records only; found: {said.others}")
    status = "development_set" if treat_as_real else "demo_fake_data"
    report.withColumn("status", F.lit(status)).coalesce(1).write.mode("overwrite").json(f"{folder}/validation.json")
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("—"))
    line = F.concat(F.lit("| "), "metric", F.lit(" | "), cell("value"), F.lit(" | "), cell("n"), F.when(F.col("preliminary"), " (preliminary) |").otherwise(" |"))
    head = report.sparkSession.createDataFrame([("", 0, "| metric | value | n |"), ("", 1, "|-|-|-|")], "k string, pos int, line string")
    lines = head.unionByName(report.select(F.lit("").alias("k"), F.lit(2).alias("pos"), line.alias("line")))
    report_markdown(lines, "k").select("markdown").coalesce(1).write.mode("overwrite").text(f"{folder}/{'VALIDATION' if treat_as_real else 'VALIDATION.demo'}.md")
    return status


def report_markdown(lines: DataFrame, key: str) -> DataFrame:
    """Lines (key, pos, line) as one Markdown text a document."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "line")))  # a report's lines, which are few
    return lines.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("markdown"))
