"""Mails to prompts, an outside model's answers, prediction rows and quality.

``predict_run`` does it as one job. For a model that takes days, ``start_run`` lands the
prompts in shards, ``resume_run`` answers shards until none is open, however often it is
stopped, and ``finish_run`` judges the answers.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailsift.functions import chat
from mailsift.functions.answers import parse_answer_any
from mailsift.operators import prompts
from mailsift.operators.classify import model_answers
from mailsift.plans.evaluation import evaluate_run
from mailsift.sources.files import child_names, create_small, read_small

Load = Callable[[], Callable[[list[str]], list[str]]]


def with_prompts(mails: DataFrame, system: str = chat.EVAL_SYSTEM, max_chars: int | None = None) -> DataFrame:
    """Add ``prompt``: the chat that asks about a mail, open for the answer."""
    asked = prompts.add_messages(mails, system, with_answer=False, max_chars=max_chars)
    return asked.withColumn("prompt", chat.render_chat(F.col("messages"), add_cue=True)).drop("messages")


def predict_run(
    mails: DataFrame,
    load: Load,
    path: str | None = None,
    parse=parse_answer_any,
    system: str = chat.EVAL_SYSTEM,
    max_chars: int | None = None,
) -> dict[str, DataFrame]:
    """Ask a model about every mail and judge its answers.

    ``mails`` has ``index, subject, body, label, dataset``, for instance the test split;
    ``load`` returns the model (see ``model_answers``). Answers are landed once, then all
    tables of ``evaluate_run`` are made from them.
    """
    asked = with_prompts(mails, system, max_chars)
    return evaluate_run(asked.withColumn("raw_prediction", model_answers(load)(F.col("prompt"))), path, parse)


#: Mails in a shard, and shards that a job answers at once.
SHARD_MAILS, AT_ONCE = 10_000, 64
_ANSWERS = "shard int, place long, raw_prediction string"


def start_run(
    mails: DataFrame,
    root: str,
    system: str = chat.EVAL_SYSTEM,
    max_chars: int | None = None,
    shard_mails: int = SHARD_MAILS,
) -> int:
    """Land the prompts of all mails below ``root`` in shards; how many shards there are.

    Prompts are dealt to shards by length, so those that a model takes together are about
    equally long; equal lengths are told apart by a hash, so no length fills one shard. A
    run that has been started is left as it is, provided it has the same prompts (compared
    by number and sum of hashes), and refused otherwise. What a start that failed has
    written is not read. Null ids and repeated rows are mails like any other.
    """
    spark, root = mails.sparkSession, root.rstrip("/")
    columns = ["index", "label", "dataset", "subject", "prompt"]
    asked = with_prompts(mails, system, max_chars).select(columns)
    digest = F.xxhash64(*columns)
    size = asked.agg(F.count("*").alias("n"), F.sum(digest.cast("decimal(38,0)")).alias("h")).first()
    stamp = {"mails": size.n, "hashes": str(size.h or 0)}
    if _RUN not in child_names(spark, root):
        shards = max(1, -(-size.n // shard_mails))
        folder = f"prompts-{uuid.uuid4().hex}"
        length = F.coalesce(F.char_length("prompt"), F.lit(0))
        dealt = (
            asked.withColumns({"__length": length, "__hash": digest})
            .repartitionByRange(shards, "__length", "__hash")
            .sortWithinPartitions("__length", "__hash")
        )
        # Numbers of rows are given once, by the tasks that write them.
        placed = dealt.select(
            *columns, F.spark_partition_id().alias("shard"), F.monotonically_increasing_id().alias("place")
        )
        placed.write.partitionBy("shard").parquet(f"{root}/{folder}")
        made = {**stamp, "prompts": folder, "shards": shards, "schema": placed.schema.jsonValue()}
        create_small(spark, f"{root}/{_RUN}", json.dumps(made))
    found = _run(spark, root)
    if {k: found[k] for k in stamp} != stamp:
        raise ValueError(f"the run at {root} was started on other mails")
    return found["shards"]


def resume_run(
    spark: SparkSession, root: str, load: Load, at_once: int = AT_ONCE, most_jobs: int | None = None
) -> int:
    """Ask the model about all mails below ``root`` without an answer; how many shards stay open.

    Jobs answer ``at_once`` shards each and write their answers when they end. Answers that
    are there are joined away, row by row, so a run that was stopped asks nothing twice
    beyond the job it was stopped in, even if that job had written some of its files.
    ``most_jobs`` ends a run early, for machines that are lent for a time. One run at a
    time may write below a root. A job looks into the folders of its own shards only, so
    the files of all shards are not listed once for each job.
    """
    root = root.rstrip("/")
    open_shards = _open(spark, root)
    groups = [open_shards[i : i + at_once] for i in range(0, len(open_shards), at_once)]
    for group in groups[:most_jobs]:
        shards = [r.shard for r in group]
        todo = _prompts(spark, root, shards).select("shard", "place", "prompt")
        begun = [r.shard for r in group if r.answered]
        if begun:
            todo = todo.join(_answers(spark, root, begun), ["shard", "place"], "left_anti")
        (
            todo.repartitionByRange(len(shards), "shard")
            .sortWithinPartitions("shard", "place")
            .select("shard", "place", model_answers(load)(F.col("prompt")).alias("raw_prediction"))
            .write.mode("append")
            .partitionBy("shard")
            .parquet(f"{root}/answers")
        )
    return sum(len(group) for group in groups[len(groups[:most_jobs]) :])


def finish_run(spark: SparkSession, root: str, path: str | None = None, parse=parse_answer_any) -> dict[str, DataFrame]:
    """The tables of ``evaluate_run`` for a run whose shards are all answered."""
    root = root.rstrip("/")
    left = len(_open(spark, root))
    if left:
        raise ValueError(f"{left} shards of the run at {root} are not answered")
    # A task that was tried twice may have left two files where the store cannot rename.
    answers = _answers(spark, root).groupBy("shard", "place").agg(F.min("raw_prediction").alias("raw_prediction"))
    return evaluate_run(_prompts(spark, root).drop("prompt").join(answers, ["shard", "place"]), path, parse)


_RUN = "run.json"


def _run(spark: SparkSession, root: str) -> dict:
    if _RUN not in child_names(spark, root):
        raise ValueError(f"no run was started at {root}")
    return json.loads(read_small(spark, f"{root}/{_RUN}"))


def _of_shards(spark: SparkSession, schema, folder: str, shards: list[int] | None) -> DataFrame:
    """A table in folders of shards, or those of some shards that are there."""
    paths = [folder] if shards is None else [f"{folder}/shard={s}" for s in shards]
    return spark.read.schema(schema).option("basePath", folder).parquet(*paths)


def _prompts(spark: SparkSession, root: str, shards: list[int] | None = None) -> DataFrame:
    from pyspark.sql.types import StructType

    found = _run(spark, root)
    return _of_shards(spark, StructType.fromJson(found["schema"]), f"{root}/{found['prompts']}", shards)


def _answers(spark: SparkSession, root: str, shards: list[int] | None = None) -> DataFrame:
    if "answers" not in child_names(spark, root):
        return spark.createDataFrame([], _ANSWERS)
    return _of_shards(spark, _ANSWERS, f"{root}/answers", shards)


def _open(spark: SparkSession, root: str) -> list:
    """``shard, answered`` of the shards with mails that have no answer: a number for each shard."""
    asked = _prompts(spark, root).groupBy("shard").agg(F.count("*").alias("n"))
    there = _answers(spark, root).select("shard", "place").distinct()
    there = there.groupBy("shard").agg(F.count("*").alias("answered"))
    both = asked.join(there, "shard", "left").fillna(0, ["answered"]).filter("answered < n")
    return both.select("shard", "answered").orderBy("shard").collect()
