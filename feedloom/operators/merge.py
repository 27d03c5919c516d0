"""Many feeds to one: scan, first-wins dedup, one written feed, its check and the run's figures."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.operators.dedup import IDENTIFIERS, first_wins, merge_counters, registered
from feedloom.operators.validate import json_faults, validate, xml_faults
from feedloom.plans.tables import written
from feedloom.sources import feeds, sinks


def well_formed(spark: SparkSession, path: str) -> bool:
    """Whether the parts of a written feed make up one document that parses. Records are checked in parallel, the frame apart.

    A record that parses alone cannot break the others, so only the opening and the closing are read together. A feed in one file is
    validated as a file.
    """
    if feeds.files_of(spark, path) and not feeds.files_of(spark, f"{path}/1-records"):
        return validate(spark, path).isEmpty()
    rows = spark.read.text(f"{path}/1-records", wholetext=True).select("value")
    frame = ["".join(r["value"] for r in spark.read.text(f"{path}/{d}", wholetext=True).collect()) for d in ("0-open", "2-close")]
    as_json = frame[0].lstrip()[:1] == "["

    def faulty(batches):
        import pyarrow as pa

        for batch in batches:
            bad = [v for v in batch.column("value").to_pylist() if (json_faults(f"[{v.lstrip().lstrip(',')}]".encode()) if as_json else xml_faults(f"<r>{v}</r>".encode()))]
            yield pa.RecordBatch.from_arrays([pa.array([len(bad)], pa.int64())], names=["n"])

    faults = rows.mapInArrow(faulty, "n long").agg(F.sum("n")).first()[0] or 0
    whole = "".join(frame).encode()
    return not faults and not (json_faults(whole) if as_json else xml_faults(whole))


def merge(spark: SparkSession, sources: list[dict], out: str, root: str = "source", names: tuple[str, ...] = IDENTIFIERS, state: str | None = None, as_file: bool = False) -> dict:
    """Merge file sources in order into the feed ``out`` (JSON by its suffix, else XML) and return the run's figures.

    A source that stands for no file has failed and the others go on; so has one with a fault, of which records before it count. ``state`` is a table of identifiers of earlier runs,
    to which this run's are added. With ``as_file`` the feed is one file, else parts in a folder. The figures: feeds (all, good, failed, each one's counts), jobs parsed and written,
    duplicates, whether the written feed is well-formed, seconds, jobs a second.
    """
    began = time.monotonic()
    keys = [feeds.source_key(s) for s in sources]
    there = [bool(feeds.files_of(spark, k)) if s.get("type") == "file" else False for s, k in zip(sources, keys, strict=True)]
    good = [k for k, t in zip(keys, there, strict=True) if t]
    scanned, faults = feeds.scan_feeds(spark, good)
    records = written(scanned, "merge-records")
    faulty = {good[r["source_idx"]]: r for r in faults.collect()}  # at most one for each file of the list
    known = None
    if state and feeds.files_of(spark, state):
        known = written(spark.read.parquet(state), "merge-known")
    kept = written(first_wins(records, names, known), "merge-kept")
    sinks.writer_for(out)(kept, out, *([] if out.lower().endswith(".json") else [root]), as_file=as_file)
    if state:
        registered(kept, names).write.mode("append").parquet(state)
    counts = {r["source_idx"]: r for r in merge_counters(records, kept).collect()}
    each = {}
    for key, found in zip(keys, there, strict=True):
        row = counts.get(good.index(key)) if found else None
        fault = faulty.get(key)
        each[key] = {"status": "ok" if found and not fault else "failed", "parsed": row["parsed"] if row else 0, "written": row["written"] if row else 0}
        if fault:
            each[key]["error"] = f"{fault['message']} at line {fault['line']}, column {fault['column']}" if fault["line"] else fault["message"]
    seconds, jobs = time.monotonic() - began, sum(x["written"] for x in each.values())
    parsed = sum(x["parsed"] for x in each.values())
    return {
        "total_feeds": len(keys), "successful_feeds": len(good) - len(faulty), "failed_feeds": len(keys) - len(good) + len(faulty), "jobs_parsed": parsed, "jobs_written": jobs, "duplicates_removed": parsed - jobs,
        "feeds": each, "well_formed": well_formed(spark, out), "elapsed_seconds": seconds, "jobs_per_second": jobs / max(seconds, 0.001),
    }


def write_statistics(spark: SparkSession, figures: dict, path: str) -> None:
    """The figures of a run as one JSON document."""
    spark.createDataFrame([(json.dumps(figures, indent=2),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def known_identifiers(spark: SparkSession, state: str) -> DataFrame:
    """Identifiers that earlier runs have registered."""
    return spark.read.parquet(state)
