"""Where the engine can either keep a historical quirk or do the sensible thing."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Compat:
    """Defaults follow the behaviour that the test goldens record.

    prefix_star: ``word*`` in a query searches by prefix (by default the star is consumed and the word is exact).
    first_posting_only: an expanded token scores the term that stands first in a section (else all its terms add up).
    intersect_keep_smaller: an intersection keeps the scores of the smaller side (else of the left one).
    glue_controls: normalising deletes line ends and tabs before words are cut (else they become spaces).
    tf_cap: occurrences of a term in a section that count at most.
    overlap_values: the values of a section all start at position 0 (else each follows the one before).
    """

    prefix_star: bool = False
    first_posting_only: bool = True
    intersect_keep_smaller: bool = True
    glue_controls: bool = False
    tf_cap: int | None = None
    overlap_values: bool = False


DEFAULT = Compat()
