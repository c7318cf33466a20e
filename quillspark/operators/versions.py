"""Tables as versions in a folder: complete ones, ones of changes, and the manifest that publishes several at once."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillspark.functions.storage import Files


class VersionedTable:
    """A table whose every version is complete; readers see the last that was written whole."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.files = Files(spark, self.path)

    def versions(self) -> list[int]:
        found = sorted(int(n[1:]) for n in self.files.names() if n[:1] == "v" and n[1:].isdigit())
        return [v for v in found if self.files.exists(f"v{v}/_SUCCESS")]

    def read(self, upto: int | None = None) -> DataFrame | None:
        """The last version, or the last that is no later than a number."""
        found = [v for v in self.versions() if upto is None or v <= upto]
        return self.spark.read.parquet(f"{self.path}/v{found[-1]}") if found else None

    def write(self, rows: DataFrame, version: int | None = None) -> int:
        """The next version, or a given one anew."""
        if version is None:
            version = max(self.versions(), default=0) + 1
        rows.write.mode("overwrite").parquet(f"{self.path}/v{version}")
        return version

    def drop_before(self, keep: int = 2) -> None:
        """All but the last versions."""
        for v in self.versions()[:-keep]:
            self.files.delete(f"v{v}")


class ChangeTable:
    """A table of rows that belong to documents, kept as changes.

    Version v adds rows and names the documents whose rows of earlier versions
    are gone, so that a change costs what changes and not the whole table. A row
    is live if no later version names its document. compact() makes one version
    of what is live.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "doc_id", partition: str | None = None):
        self.spark, self.path, self.key, self.partition = spark, path.rstrip("/"), key, partition
        self.files = Files(spark, self.path)

    def versions(self) -> list[int]:
        found = sorted(int(n[1:]) for n in self.files.names() if n[:1] == "v" and n[1:].isdigit())
        return [v for v in found if self.files.exists(f"v{v}/rows/_SUCCESS")]

    def write(self, rows: DataFrame, gone: DataFrame | None, version: int) -> int:
        """Version ``version`` (anew, if it is there): ``gone`` are keys whose earlier rows end; the rows' success mark comes last."""
        self.files.delete(f"v{version}")
        if gone is not None:
            gone.select(self.key).distinct().write.parquet(f"{self.path}/v{version}/gone")
        self._write(rows, version)
        return version

    def _write(self, rows: DataFrame, version: int) -> None:
        """Rows with their schema beside them, as a partitioned table without rows has no file that tells it."""
        self.files.write(f"v{version}/schema", json.loads(rows.schema.json()))
        writer = rows.write
        (writer.partitionBy(self.partition) if self.partition else writer).parquet(f"{self.path}/v{version}/rows")

    def _rows(self, version: int) -> DataFrame:
        schema = StructType.fromJson(self.files.read(f"v{version}/schema"))
        return self.spark.read.schema(schema).parquet(f"{self.path}/v{version}/rows").select(schema.names)

    def read(self, upto: int | None = None) -> DataFrame | None:
        """The live rows of the last version, or of a given one."""
        own = [v for v in self.versions() if upto is None or v <= upto]
        if not own:
            return None
        base = max((v for v in own if self.files.exists(f"v{v}/base")), default=own[0])
        own = [v for v in own if v >= base]
        tables = [self._rows(v).withColumn("_version", F.lit(v)) for v in own]
        rows = tables[0]
        for t in tables[1:]:
            rows = rows.unionByName(t, allowMissingColumns=True)
        ended = [self.spark.read.parquet(f"{self.path}/v{v}/gone").withColumn("_ended", F.lit(v)) for v in own[1:] if self.files.exists(f"v{v}/gone")]
        if not ended:
            return rows.drop("_version")
        gone = ended[0]
        for t in ended[1:]:
            gone = gone.unionByName(t)
        gone = gone.groupBy(self.key).agg(F.max("_ended").alias("_ended"))
        live = F.col("_ended").isNull() | (F.col("_version") >= F.col("_ended"))
        return rows.join(gone, self.key, "left").where(live).drop("_version", "_ended")

    def compact(self, keep: bool = False) -> int | None:
        """One version of all live rows; earlier ones are deleted at once, unless they are to be kept until drop_before()."""
        own = self.versions()
        rows = self.read()
        if rows is None:
            return None
        version = own[-1] + 1
        self._write(rows, version)
        self.files.write(f"v{version}/base", {"from": own[-1]})
        if not keep:
            self.drop_before(version)
        return version

    def drop_before(self, version: int) -> None:
        for v in self.versions():
            if v < version:
                self.files.delete(f"v{v}")


class Manifest:
    """Which versions of a workspace's tables belong together. A crawl that ends early leaves the last manifest in force."""

    def __init__(self, spark: SparkSession, path: str):
        self.files = Files(spark, f"{path.rstrip('/')}/manifest")

    def numbers(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self.files.names() if n.endswith(".json") and n.removesuffix(".json").isdigit())

    def current(self) -> dict[str, object]:
        found = self.numbers()
        return dict(self.files.read(f"{found[-1]}.json")) if found else {}

    def publish(self, **changed) -> int:
        number = max(self.numbers(), default=0) + 1
        self.files.write(f"{number}.json", {**self.current(), **changed})
        return number

    def drop_before(self, keep: int = 1) -> None:
        for n in self.numbers()[:-keep]:
            self.files.delete(f"{n}.json")
