"""The run from input files to validated results."""

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import written
from ..operators.identity import resolve_identities
from ..operators.normalise import normalise_claims, normalise_hints
from ..operators.resolve import profiles
from ..sources import REGISTRY, delimited
from ..sources.detect import with_types
from ..sources.files import read_files, size
from .projection import canonical_json
from .validation import validate


@dataclass
class Run:
    """What a run gives: results has a row for each person, ordered by candidate_id when collected."""

    files: DataFrame
    records: DataFrame
    canonical: DataFrame
    results: DataFrame

    def warnings(self) -> list[str]:
        """warning_rows() in order of their paths."""
        return [r["warning"] for r in self.warning_rows().orderBy("path").collect()]

    def warning_rows(self) -> DataFrame:
        """(path, warning) of files of unknown type, unreadable files, and files without records."""
        found = self.records.groupBy("path").count()
        left = self.files.join(found, "path", "left").where("count IS NULL")
        known = F.col("source_type").isin(*REGISTRY)
        unread = F.col("source_type").isin("recruiter_csv", "ats_json") & ~F.coalesce(F.is_valid_utf8(F.col("raw").cast("string")), F.lit(True))
        told = left.where(unread).select("path", "source_type", "raw").mapInArrow(read_errors, "path string, source_type string, error string")
        failed = told.select("path", F.concat(F.lit("extractor '"), "source_type", F.lit("' failed on "), "path", F.lit(": "), "error").alias("warning"))
        text = F.when(~F.coalesce(known, F.lit(False)), F.concat(F.lit("skipped (unrecognized source type): "), "path")).otherwise(F.concat(F.lit("no candidates extracted from "), "path", F.lit(" ("), "source_type", F.lit(")")))
        return left.where(~F.coalesce(unread, F.lit(False))).select("path", text.alias("warning")).unionByName(failed)

    def source_counts(self) -> DataFrame:
        """(source_type, files, records) of each known type."""
        files = self.files.groupBy("source_type").agg(F.count(F.lit(1)).alias("files"))
        records = self.records.groupBy("source_type").agg(F.count(F.lit(1)).alias("records"))
        return files.where(F.col("source_type").isin(*REGISTRY)).join(records, "source_type", "left").select("source_type", "files", F.coalesce("records", F.lit(0)).alias("records"))

    def stats(self) -> dict:
        by_source = {r["source_type"]: r["records"] for r in self.source_counts().orderBy("source_type").collect()}
        people = self.results.agg(F.count(F.lit(1)), F.count_if(F.size("validation_errors") > 0)).first()
        return {"input_files": self.files.count(), "records_extracted": sum(by_source.values()), "candidates": people[0], "by_source": by_source, "all_valid": people[1] == 0}

    def rendered(self, emit: str = "output") -> DataFrame:
        """(candidate_id, component, text): the JSON of each person, as output, canonical or both; people without an output are left out of outputs."""
        output, canonical = F.col("output_json"), F.col("canonical_json")
        forms = {"output": output, "canonical": canonical, "both": F.concat(F.lit('{"canonical": '), canonical, F.lit(', "output": '), F.coalesce(output, F.lit("null")), F.lit("}"))}
        return self.results.select("candidate_id", "component", forms[emit].alias("text")).where("text IS NOT NULL")

    def write_lines(self, folder: str, emit: str = "output") -> None:
        """The rendered results into a folder, a line of JSON each: executors write, and parts are in order of candidate_id."""
        self.rendered(emit).repartitionByRange("candidate_id", "component").sortWithinPartitions("candidate_id", "component").select("text").write.mode("overwrite").text(folder)

    def ok(self) -> bool:
        return self.results.where(F.size("validation_errors") > 0).isEmpty()


def read_errors(batches):
    """(path, source_type, error): class and message of what reading a file as UTF-8 raises."""
    for batch in batches:
        errors = []
        for raw in batch.column(2).to_pylist():
            try:
                raw.decode("utf-8-sig")
                errors.append("")
            except UnicodeDecodeError as e:
                errors.append(f"{type(e).__name__}: {e}")
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(errors, pa.string())], names=["path", "source_type", "error"])


def extract(files: DataFrame, service: str | None = None) -> DataFrame:
    """Records of all files, each by the extractor of its source_type. Profiles that no cache has come from a service, if one is given."""
    out = None
    for kind, extractor in REGISTRY.items():
        of_kind = files.where(F.col("source_type") == kind)
        found = extractor(of_kind, service=service) if kind == "github" and service else extractor(of_kind)
        out = found if out is None else out.unionByName(found)
    return out


def consolidate(records: DataFrame) -> DataFrame:
    """The profiles of records: normalised, linked and resolved.

    Records are written once: extraction is long expressions, which would else be
    planned into, and run for, keys and claims alike.
    """
    return resolve(written(records))


def resolve(records: DataFrame) -> DataFrame:
    """consolidate() over records that need no writing."""
    components = resolve_identities(normalise_hints(records))
    claims = normalise_claims(records).join(components, "record_id")
    # people all of whose claims were dropped still have an empty profile
    everyone = components.select("component").distinct().withColumn("field", F.lit(""))
    return profiles(claims.unionByName(everyone, allowMissingColumns=True))


def run_files(files: DataFrame, config: dict, forced: dict[str, str] | None = None, service: str | None = None, large: list[str] = ()) -> Run:
    """A run over (path, ext, raw, content), however it was read, and over delimited files that are too large to be read whole."""
    spark, typed = files.sparkSession, with_types(files, forced).persist()
    records = extract(typed, service)
    if large:
        rows = delimited.rows_by_line(spark, list(large))
        records = records.unionByName(delimited.map_rows(rows))
        typed = typed.unionByName(spark.createDataFrame([(p, "recruiter_csv") for p in large], "path string, source_type string"), allowMissingColumns=True)
    records = written(records)
    canonical = resolve(records).persist()
    results = validate(canonical, config).withColumn("canonical_json", canonical_json(canonical.schema))
    return Run(typed, records, canonical, results)


def run(spark: SparkSession, paths: list[str], config: dict | None = None, forced: dict[str, str] | None = None, service: str | None = None) -> Run:
    """A run over files by their paths; their order does not matter. service is where profiles are fetched that no cache has."""
    names, forced = sorted(set(paths)), forced or {}
    kind = {p: forced.get(p, "recruiter_csv" if p.lower().endswith(".csv") else "") for p in names}
    large = [p for p in names if kind[p] == "recruiter_csv" and size(spark, p) >= delimited.LARGE_BYTES]
    return run_files(read_files(spark, [p for p in names if p not in set(large)]), config or {}, forced, service, large)
