"""Exports: JSON, CSV for office programs, diagnostics bundles, snapshots."""

from __future__ import annotations

import io
import json
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.storage import Files
from quillspark.functions.text import redact, redacted, redacted_text


def report_json(report: DataFrame) -> str:
    """A one-row report as JSON."""
    row = report.limit(1).collect()[0].asDict(recursive=True)
    return json.dumps(row, ensure_ascii=False, indent=2, sort_keys=True, default=str)


def office_csv(sections: list[tuple[list[str], list[tuple]]]) -> bytes:
    """Sections of a header and rows: semicolons, UTF-8 with a mark, CRLF, an empty line between sections."""
    import csv

    out = io.StringIO(newline="")
    writer = csv.writer(out, delimiter=";", lineterminator="\r\n")
    for i, (header, rows) in enumerate(sections):
        if i:
            out.write("\r\n")
        writer.writerow(header)
        writer.writerows(rows)
    return b"\xef\xbb\xbf" + out.getvalue().encode()


def coverage_csv(report: DataFrame, details: DataFrame) -> bytes:
    """The coverage report and the documents that aren't searchable (bounded by the report's own limit)."""
    row = report.limit(1).collect()[0].asDict()
    rows = details.select("status", "name").collect()
    return office_csv([(["metric", "value"], list(row.items())), (["status", "name"], [tuple(r) for r in rows])])


def recent_errors(errors: DataFrame, limit: int = 1000) -> DataFrame:
    """The newest errors, messages without secrets."""
    return errors.orderBy(F.desc("created_at"), F.desc("id")).limit(limit).withColumn("message", redact(F.col("message")))


def errors_csv(errors: DataFrame, limit: int = 1000) -> bytes:
    """recent_errors() for office programs."""
    columns = ["created_at", "stage", "code", "source_id", "file_name", "message"]
    rows = recent_errors(errors, limit).select(*columns).collect()
    return office_csv([(columns, [tuple(r) for r in rows])])


def diagnostics(report: DataFrame, details: DataFrame, errors: DataFrame, facts: dict, log: str = "", tail: int = 200) -> bytes:
    """A ZIP of coverage, errors, facts of the environment and the end of a log, all without secrets."""
    lines = [redacted_text(x) for x in log.splitlines()[-tail:]]
    return bundle({
        "coverage.json": report_json(report),
        "coverage.csv": coverage_csv(report, details),
        "errors.csv": errors_csv(errors),
        "environment.json": json.dumps(redacted("", facts), ensure_ascii=False, indent=2, sort_keys=True, default=str),
        "log.txt": "\n".join(lines),
    })


def bundle(parts: dict[str, bytes | str]) -> bytes:
    """A ZIP of named parts."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in parts.items():
            z.writestr(name, data)
    return out.getvalue()


ROOM = 1.3  # fixed value: free space that a snapshot needs, in sizes of what is copied


def snapshot(spark: SparkSession, tables: dict[str, DataFrame], path: str, size: int | None = None) -> None:
    """All tables written under one folder; a marker last, so that a snapshot without it is not complete.

    Where their ``size`` in bytes is given, too little free space is an error before anything is written.
    """
    if size is not None and (free := Files(spark, path.rpartition("/")[0] or "/").free_bytes()) < ROOM * size:
        raise OSError(f"{free} bytes are free, {int(ROOM * size)} are needed")
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{path}/{name}")
    names = spark.createDataFrame([(n,) for n in sorted(tables)], "name string")
    names.coalesce(1).write.mode("errorifexists").json(f"{path}/complete")


def restore(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    names = [r.name for r in spark.read.schema("name string").json(f"{path}/complete").collect()]
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def snapshots(spark: SparkSession, folder: str) -> list[str]:
    """Complete snapshots in a folder."""
    files = Files(spark, folder)
    return [n for n in files.names() if files.exists(f"{n}/complete/_SUCCESS")]


def compacted(df: DataFrame, path: str, files: int) -> None:
    """The table rewritten to a number of files."""
    df.repartition(files).write.parquet(path)
