"""Header rules: small driver-side work on column names and the first line of a file."""

from __future__ import annotations

import csv
import re
from collections.abc import Iterable, Mapping

from reviewmill.fixed import HEADER_SYNONYMS


def normalize_header(name: str) -> str:
    """Strip, lower case, whitespace runs to one underscore."""
    return re.sub(r"\s+", "_", name.strip().lower())


def simple_header(name: str) -> str:
    """The metadata rule: strip, lower case, each space to an underscore."""
    return name.strip().lower().replace(" ", "_")


def map_columns(
    headers: Iterable[str], synonyms: Mapping[str, list[str]] = HEADER_SYNONYMS
) -> dict[str, str]:
    """Target column -> file header. The first synonym found wins."""
    by_norm: dict[str, str] = {}
    for header in headers:
        norm = normalize_header(header)
        if norm in by_norm:
            raise ValueError(f"two columns read as {norm!r}: {by_norm[norm]!r} and {header!r}")
        by_norm[norm] = header
    mapping = {}
    for target, spellings in synonyms.items():
        known = [normalize_header(s) for s in spellings if normalize_header(s) in by_norm]
        if known:
            mapping[target] = by_norm[known[0]]
    return mapping


def choose_delimiter(line: str) -> str:
    """Semicolon if it beats both others, else tab if it beats comma, else comma."""
    commas, semicolons, tabs = (line.count(d) for d in (",", ";", "\t"))
    if semicolons > max(commas, tabs):
        return ";"
    return "\t" if tabs > commas else ","


def sniff_delimiter(line: str) -> str:
    """Delimiter of a .txt file: the commonest candidate outside quotes, a tie gives comma."""
    bare = re.sub(r'"(?:[^"]|"")*"', "", line)
    counts = {d: bare.count(d) for d in (",", ";", "\t", "|")}
    best = max(counts.values())
    winners = [d for d, n in counts.items() if n == best]
    return winners[0] if best and len(winners) == 1 else ","


def split_header(line: str, delimiter: str) -> list[str]:
    return next(csv.reader([line], delimiter=delimiter))
