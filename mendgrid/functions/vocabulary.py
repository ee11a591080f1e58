"""Status sets and severity order.

The three finding sets differ and each report keeps its own; they decide results.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Status words.
OPEN = "Open"
IN_PROGRESS = "In Progress"
REMEDIATED = "Remediated"
PENDING = "Pending"
COMPLETED = "Completed"
CLOSED = ("Remediated", "False Positive")
SETTLED = ("Remediated", "Accepted Risk", "False Positive")
ACTION_DONE = ("Completed", "Cancelled")

# Severity order, most urgent first, and the older severity weights.
SEVERITY_ORDER = ("Critical", "High", "Medium", "Low")
SEVERITY_WEIGHT = {"Critical": 10, "High": 6, "Medium": 3, "Low": 1}


def not_closed(status: Column | str) -> Column:
    return ~_col(status).isin(*CLOSED)


def not_settled(status: Column | str) -> Column:
    return ~_col(status).isin(*SETTLED)


def action_open(status: Column | str) -> Column:
    return ~_col(status).isin(*ACTION_DONE)


def severity_rank(severity: Column | str, levels: int = 4) -> Column:
    """1 for Critical, 2 for High, ... and ``levels + 1`` for everything else."""
    words = F.array(*[F.lit(s) for s in SEVERITY_ORDER[:levels]])
    place = F.array_position(words, _col(severity))
    return F.when(place > 0, place.cast("int")).otherwise(F.lit(levels + 1))


def action_priority(severity: Column | str) -> Column:
    """Priority of a patch action: the severity itself down to Medium, else Low."""
    word = _col(severity)
    return F.when(word.isin("Critical", "High", "Medium"), word).otherwise(F.lit("Low"))


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c
