"""Free-text model answers to labels."""

from pyspark.sql import Column
from pyspark.sql import functions as F

PHISHING, LEGITIMATE = 1, 0


def parse_answer_any(c: Column) -> Column:
    """Phishing if mentioned anywhere, else legitimate if mentioned, else null."""
    text = F.lower(c)
    return F.when(F.contains(text, F.lit("phishing")), PHISHING).when(
        F.contains(text, F.lit("legitimate")), LEGITIMATE
    )


def parse_answer_first(c: Column) -> Column:
    """Whichever word comes first, null when neither does."""
    text = F.lower(c)
    phishing, legitimate = F.instr(text, "phishing"), F.instr(text, "legitimate")
    return F.when(
        (phishing > 0) & ((legitimate == 0) | (phishing < legitimate)), PHISHING
    ).when(legitimate > 0, LEGITIMATE)


def invalid_as_text(label: Column) -> Column:
    """Label as text, a missing one as ``invalid``."""
    return F.coalesce(label.cast("string"), F.lit("invalid"))


def invalid_as_number(label: Column) -> Column:
    """Label as a number, a missing one as -1."""
    return F.coalesce(label, F.lit(-1))
