"""From split mail to training text, and from training to a chosen classifier."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailsift.functions import chat
from mailsift.operators import assemble, classify, prompts
from mailsift.operators.contract import missing_columns

GRID = ({"regularisation": 0.1}, {"regularisation": 0.01}, {"regularisation": 0.001})


def training_rows(
    mails: DataFrame,
    cap: int | None = None,
    max_chars: int | None = None,
    system: str = chat.TRAIN_SYSTEM,
    seed: int = assemble.SEED,
) -> DataFrame:
    """Prompt and full chat text of every mail, or of ``cap`` mails drawn by seed.

    Mails go in whole; ``max_chars`` shortens longer ones as ``compact_text`` does.

    Tokenise both, then ``chat.answer_only_labels`` masks the prompt's part.
    """
    chosen = assemble.sample_at_most(mails, cap, seed=seed)
    asked = prompts.add_messages(chosen, system, with_answer=False, max_chars=max_chars)
    asked = asked.withColumn("prompt", chat.render_chat(F.col("messages"), add_cue=True))
    told = prompts.add_messages(asked, system, max_chars=max_chars)
    return told.withColumn("full", chat.render_chat(F.col("messages"))).drop("messages")


def train_classifier(
    splits: DataFrame, grid: Sequence[Mapping] = GRID
) -> tuple[PipelineModel, DataFrame]:
    """Train on ``train``, choose on ``valid``; returns the model and all losses."""
    missing = missing_columns(splits, ("subject", "body", "label", "split"))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    parts = (splits.filter(F.col("split") == name) for name in ("train", "valid"))
    return classify.fit_best(*parts, grid)
