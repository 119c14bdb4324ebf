"""A clean corpus that grows batch by batch, without reading its mails again."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailsift.operators.clean import to_contract
from mailsift.operators.dedup import first_places, rows_at
from mailsift.schemas import CONTRACT
from mailsift.sources.files import child_names
from mailsift.sources.scratch import land

#: Buckets of a new index. Each batch adds one file to every bucket it has new texts for.
BUCKETS = 256
_INDEX = "digests_by_"


def open_index(spark: SparkSession, root: str, buckets: int | None = None) -> tuple[DataFrame, str, int]:
    """Digests of all admitted texts: ``digest, batch`` as a bucketed table, its name and buckets.

    The files lie below ``root`` and are all there is: any session declares the table over
    them anew. The number of buckets is fixed by the first batch and is part of the folder's
    name.
    """
    made = [int(n.removeprefix(_INDEX)) for n in child_names(spark, root) if n.startswith(_INDEX)]
    if made and buckets not in (None, *made):
        raise ValueError(f"the index at {root} has {made[0]} buckets, not {buckets}")
    buckets = made[0] if made else buckets or BUCKETS
    path = f"{root.rstrip('/')}/{_INDEX}{buckets}"
    name = f"digests_{hashlib.md5(path.encode()).hexdigest()}"
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} (digest BINARY, batch BIGINT) USING parquet "
        f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
    )
    spark.catalog.refreshTable(name)
    return spark.table(name), name, buckets


def unknown(first: DataFrame, index: DataFrame, batch: int, buckets: int) -> DataFrame:
    """First places whose text no other batch has admitted.

    The new digests are dealt as the index lies, so the index, which grows with the corpus,
    is read bucket by bucket where it is and never shuffled or broadcast.
    """
    others = index.filter(F.col("batch") != batch).select("digest").hint("merge")
    return first.repartition(buckets, "__digest").join(others, F.col("__digest") == F.col("digest"), "left_anti")


def admit(
    marked: DataFrame,
    root: str,
    batch: int,
    order: Sequence[str] = ("dataset", "key"),
    buckets: int | None = None,
) -> DataFrame:
    """Add the mails of a batch whose texts are new to the corpus below ``root``, and return them.

    ``marked`` is what ``clean.mark`` makes, landed; ``order`` is unique in the batch. Of
    equal texts the first of the earliest admitted batch is kept, so batches admitted one
    after another give what cleaning all at once by ``(batch, *order)`` gives. Copies are
    folded inside each map task before their digests travel; mails meet first places only.

    A batch that failed half-way is simply admitted again: digests it has already left in
    the index do not count against it and are not added twice, and its mails are replaced.
    Rows that fail a filter are never admitted; an empty batch adds nothing. Batches are
    admitted one at a time.
    """
    spark = marked.sparkSession
    index, name, buckets = open_index(spark, root, buckets)
    valid = marked.filter("__step IS NULL").drop("__step")
    fresh = land(unknown(first_places(valid, "__digest", order), index, batch, buckets), "fresh")
    retained = [c for c in order if c not in CONTRACT]
    path = f"{root.rstrip('/')}/mails/batch={batch}"
    to_contract(rows_at(valid, fresh, "__digest", order), *retained).write.mode("overwrite").parquet(path)
    # Last, and in the index's own order of buckets: a file for each.
    own = index.filter(F.col("batch") == batch).select("digest").hint("merge")
    added = fresh.repartition(buckets, "__digest").join(own, F.col("__digest") == F.col("digest"), "left_anti")
    added.select(F.col("__digest").alias("digest"), F.lit(batch).cast("long").alias("batch")).write.insertInto(name)
    return spark.read.parquet(path)


def admitted(spark: SparkSession, root: str) -> DataFrame:
    """All mails of the corpus, with the ``batch`` that brought them."""
    return spark.read.parquet(f"{root.rstrip('/')}/mails")
