"""Label cache as a keyed table: append on write, latest row of a key on read, a version that must match."""

from __future__ import annotations

import datetime
import json
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.errors import FixtureError

VERSION = 1


def read_cache(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(cache_key, ...) of the current version; an absent path is an empty cache."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = f"cache_key string, version int, written_at timestamp, {schema}"
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], full).drop("version", "written_at")
    rows = spark.read.schema(full).parquet(path).where(F.col("version") == VERSION)
    names = [c for c in rows.columns if c not in ("cache_key", "version", "written_at")]
    return rows.groupBy("cache_key").agg(F.max_by(F.struct(*names), "written_at").alias("x")).select("cache_key", "x.*")


def append_cache(rows: DataFrame, path: str) -> None:
    """Append (cache_key, ...); partial progress survives the failure of a later batch."""
    names = [c for c in rows.columns if c != "cache_key"]
    rows.select("cache_key", F.lit(VERSION).alias("version"), F.current_timestamp().alias("written_at"), *names).write.mode("append").parquet(path)


#: The fields of a fixture by place (fixed values).
FIXTURE = {
    "": {"format_version", "methodology", "provenance", "cases"}, "methodology": {"methodology_version", "prompt_version", "schema_version"}, "provenance": {"status", "approved_by", "approved_at", "source"},
    "cases": {"id", "prompt", "previous_answer", "followup_prompt", "expected"}, "expected": {"task_type", "followup_label", "steering_reason", "prevention_mechanisms", "prompt_issue", "agents_rule", "skill_candidate", "validation_type"},
}


def read_fixture(path: str) -> dict:
    """A fixture file, strictly: unknown fields at any place and trailing data are errors."""
    with open(path, encoding="utf-8") as f:
        got = json.load(f)
    cases = got.get("cases") or [] if isinstance(got, dict) else []
    places = [("", got)] + ([(k, got.get(k) or {}) for k in ("methodology", "provenance")] if isinstance(got, dict) else []) + [("cases", c) for c in cases] + [("expected", c["expected"]) for c in cases if isinstance(c, dict) and c.get("expected") is not None]
    for place, v in places:
        if not isinstance(v, dict) or v.keys() - FIXTURE[place]:
            raise FixtureError(f"unknown fields in {place or 'fixture'}: {sorted(v.keys() - FIXTURE[place]) if isinstance(v, dict) else v}")
    return got


def check_approval(fixture: dict) -> None:
    """FixtureError unless the fixture has the known format, all its versions, an approval with a time, and cases."""
    p, m = fixture.get("provenance") or {}, fixture.get("methodology") or {}
    if fixture.get("format_version") != "1" or not all(m.get(k) for k in FIXTURE["methodology"]):
        raise FixtureError("format or methodology")
    if p.get("status") != "approved" or not all((p.get(k) or "").strip() for k in FIXTURE["provenance"]):
        raise FixtureError("approval")
    try:
        if datetime.datetime.fromisoformat(p["approved_at"]).tzinfo is None:
            raise ValueError(p["approved_at"])
    except ValueError as e:
        raise FixtureError("approval time") from e
    if not fixture.get("cases"):
        raise FixtureError("no cases")


def write_private(path: str, value: object) -> None:
    """Indented JSON, readable by its owner only, put in place in one step."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, mode=0o700, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=folder)
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            json.dump(value, f, ensure_ascii=False, indent=2)
            f.flush()
            os.fsync(f.fileno())
        os.replace(name, path)
    except BaseException:
        os.unlink(name)
        raise
