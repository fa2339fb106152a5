"""A full-text search and record-processing engine for Apache Spark."""

__version__ = "0.1.0"


def info() -> dict[str, object]:
    """Version and defaults."""
    from inkwell.compat import DEFAULT
    from inkwell.operators.tokenize import Tokenizer
    from inkwell.plans.qparse import WEIGHT

    return {"version": __version__, "tokenizer": Tokenizer(), "compat": DEFAULT, "operand_weight": WEIGHT, "escalation_threshold": 0, "escalation_decay": 2}
