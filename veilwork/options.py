"""Options of one processing request. They live on the driver and become literals in the plan."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass

from veilwork import patterns


@dataclass(frozen=True)
class RedactOptions:
    anonymize: bool = False
    remove_pii: bool = False
    extract_json: bool = False
    terms: tuple[str, ...] = ()
    replacement: str = ""
    throughput: bool = False
    ocr_enabled: bool = True
    ocr_available: bool = True
    max_images: int | None = None
    header_ratio: float = patterns.HEADER_RATIO
    scope: str = "text"

    def __post_init__(self):
        object.__setattr__(self, "terms", tuple(normalize_term_list(self.terms)))
        if self.scope not in ("text", "all"):
            raise ValueError(f"scope must be 'text' or 'all', not {self.scope!r}")

    def as_json(self) -> str:
        """Stable text of every option, the second half of a fingerprint."""
        return json.dumps(asdict(self), sort_keys=True)


def normalize_term_list(terms: Sequence[str | None] | None) -> list[str]:
    """Trimmed terms without blanks; of spellings that differ only in case the first stays."""
    first_spelling: dict[str, str] = {}
    for term in terms or ():
        trimmed = str(term).strip() if term is not None else ""
        if trimmed:
            first_spelling.setdefault(trimmed.lower(), trimmed)
    return list(first_spelling.values())


def validate_options(opts: RedactOptions) -> RedactOptions:
    """A request must ask for at least one operation."""
    if not (opts.anonymize or opts.remove_pii or opts.extract_json):
        raise ValueError("Select at least one operation: anonymize, remove_pii or extract_json")
    return opts
