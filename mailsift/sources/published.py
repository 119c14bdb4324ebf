"""Tables published as a whole: readers see the version before or the one after."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailsift.sources.files import child_names, create_small, read_small

_VERSIONS = "_versions"


def publish(df: DataFrame, path: str, by: str | Sequence[str] = "split") -> int:
    """Write a table as the next version below ``path``, in folders by ``by``; its number.

    Rows go to a folder of their own, which nobody reads until a manifest that names it is
    there, so a job that fails leaves the version before in place. The manifest is made by
    a call that refuses to replace a file: of two writers one gets the next number. (On an
    object store without such a call, publish from one writer at a time.) It also holds the
    number of rows and the schema. An empty table is a version too.
    """
    spark, root = df.sparkSession, path.rstrip("/")
    by = [by] if isinstance(by, str) else list(by)
    data = f"data-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(f"{root}/{data}")
    # Parquet footers tell the number; an observed metric would leave the session unable to
    # send some trained models to its tasks.
    rows = spark.read.schema(df.schema).parquet(f"{root}/{data}").count()
    manifest = {"data": data, "rows": rows, "schema": df.schema.jsonValue()}
    version = max(_numbers(spark, root), default=0) + 1
    while not create_small(spark, _manifest(root, version), json.dumps(manifest)):
        version += 1
    return version


def read_published(spark: SparkSession, path: str, version: int | None = None, **equal) -> DataFrame:
    """The latest version of a published table, or the one named.

    ``split="test"`` and the like choose folders; the others are not listed in the plan's
    scan. The frame keeps to its version whatever is published later.
    """
    found = manifest(spark, path, version)
    df = spark.read.schema(_schema(found)).parquet(f"{path.rstrip('/')}/{found['data']}")
    for column, value in equal.items():
        df = df.filter(F.col(column) == value)
    return df


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict:
    """What the manifest of a version says: ``version, data, rows, schema``.

    A manifest whose writer died over it is passed over.
    """
    root = path.rstrip("/")
    wanted = sorted(_numbers(spark, root), reverse=True) if version is None else [version]
    for number in wanted:
        try:
            return {"version": number, **json.loads(read_small(spark, _manifest(root, number)))}
        except json.JSONDecodeError:
            continue
    raise ValueError(f"nothing is published at {path}")


def _schema(found: dict):
    from pyspark.sql.types import StructType

    return StructType.fromJson(found["schema"])


def _numbers(spark: SparkSession, root: str) -> list[int]:
    names = child_names(spark, f"{root}/{_VERSIONS}")
    return [int(n.removesuffix(".json")) for n in names if n.endswith(".json")]


def _manifest(root: str, version: int) -> str:
    return f"{root}/{_VERSIONS}/{version:010d}.json"
