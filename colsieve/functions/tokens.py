"""Name tokens and the fixed word lists of the name rules."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Results depend on these lists being exactly as given.
RISKY_NAME_TERMS = (
    "final", "outcome", "post", "decision", "confirmed", "result", "followup", "resolution",
    "diagnosis", "approval", "settlement", "cancellation", "cancel", "default", "churn",
)
SIGNAL_NAME_PARTS = ("signal", "history", "credit", "tenure", "contract")
GUARDRAIL_TERMS = (
    "after", "approval", "approved", "cancel", "canceled", "cancellation", "churn", "closed",
    "confirmed", "decision", "default", "diagnosis", "final", "followup", "future", "label",
    "outcome", "post", "resolved", "resolution", "result", "settlement", "target",
)
DISGUISED_TERM_SETS = (
    ("risk", "review", "code"),
    ("case", "resolution", "type"),
    ("followup", "action", "group"),
)
IDENTIFIER_NAME_PARTS = ("id", "uuid", "name")


def tokens(text: Column) -> Column:
    """Distinct lower-case runs of letters and digits."""
    return F.array_distinct(F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), ""))


def words(terms) -> Column:
    return F.array(*[F.lit(t) for t in terms]) if terms else F.array().cast("array<string>")


def holds_part(text: Column, parts) -> Column:
    """Does the lower-cased text contain one of the parts anywhere?"""
    found = F.lit(False)
    for part in parts:
        found = found | F.lower(text).contains(part)
    return found
