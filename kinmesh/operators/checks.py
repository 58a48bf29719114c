"""Checks of a data set against what it is said to hold: results with a verdict, tolerances, and claims of a report."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession

PASS, FAIL, WARNING, UNKNOWN = "PASS", "FAIL", "WARNING", "NOT VERIFIABLE"


@dataclass(frozen=True)
class Check:
    name: str
    verdict: str
    observed: str
    expected: str


def exact(name: str, observed: Any, expected: Any) -> Check:
    return Check(name, UNKNOWN if observed is None else PASS if observed == expected else FAIL, str(observed), str(expected))


def within(name: str, observed: float | None, least: float, most: float) -> Check:
    return Check(name, UNKNOWN if observed is None else PASS if least <= observed <= most else FAIL, str(observed), f"{least} to {most}")


def about(name: str, observed: float | None, target: float, tolerance: float = 0.05, limit: float = 0.20) -> Check:
    """PASS within the tolerance (a share of the target), WARNING up to the limit, else FAIL."""
    if observed is None:
        return Check(name, UNKNOWN, "None", str(target))
    off = abs(observed - target) / abs(target) if target else float(observed != 0)
    return Check(name, PASS if off <= tolerance else WARNING if off <= limit else FAIL, str(observed), f"about {target}")


def scaled(name: str, observed: float | None, full: float, scale: float, tolerance: float = 0.05) -> Check:
    """about, of a full-size target at a share of the full size; small counts get room for one of them."""
    target = full * scale
    return about(name, observed, target, max(tolerance, 1 / target if target else 1.0))


def table(spark: SparkSession, checks: list[Check]) -> DataFrame:
    return spark.createDataFrame([(c.name, c.verdict, c.observed, c.expected) for c in checks], "name string, verdict string, observed string, expected string")


def passed(checks: list[Check]) -> bool:
    return not any(c.verdict == FAIL for c in checks)


def find_numbers(document: Any, *words: str) -> Iterator[tuple[str, float]]:
    """(dotted path, number) of each number in a nested document whose path holds all the words, in order of the document."""

    def walk(node: Any, path: str) -> Iterator[tuple[str, float]]:
        if isinstance(node, dict):
            for k, v in node.items():
                yield from walk(v, f"{path}.{k}" if path else str(k))
        elif isinstance(node, list):
            for i, v in enumerate(node):
                yield from walk(v, f"{path}.{i}")
        elif isinstance(node, (int, float)) and not isinstance(node, bool) and all(w.lower() in path.lower() for w in words):
            yield path, node

    return walk(document, "")


def find_section(document: Any, word: str) -> dict | None:
    """The first nested object, from the outside in, under a key that holds the word."""
    level = [document]
    while level:
        for node in level:
            if isinstance(node, dict):
                for k, v in node.items():
                    if word.lower() in str(k).lower() and isinstance(v, dict):
                        return v
        level = [v for node in level if isinstance(node, (dict, list)) for v in (node.values() if isinstance(node, dict) else node)]
    return None


def reconcile(claims: dict, measured: dict[str, Any], tolerances: dict[str, float] | None = None) -> list[Check]:
    """Each measured figure against the claim under the same dotted path: exact, or within a share of it."""
    paths = dict(find_numbers(claims))
    out = []
    for name, value in measured.items():
        if name not in paths:
            out.append(Check(name, UNKNOWN, str(value), "no claim"))
        elif tolerances and name in tolerances:
            out.append(about(name, value, paths[name], tolerances[name], tolerances[name]))
        else:
            out.append(exact(name, value, paths[name]))
    return out
