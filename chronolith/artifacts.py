"""Contract of the final metrics documents: a table of rules over their fields, and one evaluator.

Documents, charts and the report are read through Hadoop's file systems when a Spark
session is there, so any URI will do; without one, paths are local.  A chart may be a
file or a folder of Parquet files.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import SparkSession

from .ml.contract import FORBIDDEN
from .schemas import FEATURE_VERSION
from .sources.lake import Location

PLACEHOLDER = re.compile(r"\{\{FINAL_[A-Z0-9_]+\}\}")
#: Kind of document -> its file.
DOCUMENTS = {"features": "cast_crew_metrics.json", "awards": "oscar_metrics.json", "analytics": "analytics_metrics.json", "hit model": "hit_model_metrics.json", "awards model": "awards_model_metrics.json"}
MODELS = ("hit model", "awards model")


class LocalPlace:
    """A local path with the part of Location's interface that is read here."""

    def __init__(self, path: str) -> None:
        self.path = Path(path)

    def exists(self) -> bool:
        return self.path.exists()

    def read_text(self) -> str:
        return self.path.read_text(encoding="utf-8")


def place(uri: object) -> Location | LocalPlace:
    spark = SparkSession.getActiveSession()
    return Location(spark, str(uri)) if spark else LocalPlace(str(uri))


def field(document: object, path: str) -> object:
    """The value at a dotted path, or None."""
    for key in path.split("."):
        document = document.get(key) if isinstance(document, dict) else None
    return document


@dataclass(frozen=True)
class Rule:
    """A field of some kinds of documents, what must hold of its value there, and that in words."""

    kinds: tuple[str, ...]
    path: str
    wanted: str
    holds: Callable[[object, dict], bool]

    def breach(self, document: dict) -> str | None:
        value = field(document, self.path)
        try:
            sound = self.holds(value, document)
        except (TypeError, AttributeError):  # a value of another kind than the rule compares
            sound = False
        return None if sound else f"{self.path} must be {self.wanted}, not {value!r}"


def equal(wanted: object) -> Callable[[object, dict], bool]:
    return lambda value, _: value == wanted


def below(path: str) -> Callable[[object, dict], bool]:
    return lambda value, document: value < field(document, path)


def number(least: float, most: float = float("inf"), whole: bool = False) -> Callable[[object, dict], bool]:
    return lambda value, _: not isinstance(value, bool) and isinstance(value, int if whole else (int, float)) and least <= value <= most


def rules() -> Iterable[Rule]:
    yield Rule(("features", "awards"), "feature_semantics_version", str(FEATURE_VERSION), equal(FEATURE_VERSION))
    yield Rule(("analytics", *MODELS), "schema_version", "2", equal(2))
    yield Rule(MODELS, "feature_cols", "columns that may predict", lambda v, _: bool(v) and FORBIDDEN.isdisjoint(v))
    for part in ("train", "validation", "test"):
        for count in ("rows", "positives"):
            yield Rule(MODELS, f"partitions.{part}.{count}", "above zero", number(1))
    for earlier, later in (("train", "validation"), ("validation", "test")):
        yield Rule(MODELS, f"partitions.{earlier}.max_year", f"before the first year of {later}", below(f"partitions.{later}.min_year"))
    yield Rule(MODELS, "selected_candidate.candidate_id", "one of the candidates", lambda v, d: v in [c["candidate_id"] for c in d["candidate_results"]])
    yield Rule(MODELS, "threshold_selection.source", "validation", equal("validation"))
    for share in ("threshold_selection.selected.threshold", *(f"test_metrics.{m}" for m in ("pr_auc", "roc_auc", "precision", "recall", "positive_f1"))):
        yield Rule(MODELS, share, "between 0 and 1", number(0, 1))
    for cell in ("tp", "fp", "fn", "tn"):
        yield Rule(MODELS, f"test_metrics.{cell}", "a count", number(0, whole=True))


RULES = tuple(rules())
CHARTED = ("analytics", *MODELS)


def errors_of(kind: str, document: dict) -> list[str]:
    """The rules that a document of a kind breaks."""
    return [e for rule in RULES if kind in rule.kinds and (e := rule.breach(document))]


def model_errors(document: dict) -> list[str]:
    return errors_of(MODELS[0], document)


def missing_charts(document: dict, folder: object = None) -> list[str]:
    """Charts that stand neither where the document says nor under their name in ``folder``; having none is a breach too."""
    named = field(document, "charts")
    if not isinstance(named, list) or not named:
        return ["charts must be named"]
    tries = lambda uri: [uri, *([f"{str(folder).rstrip('/')}/{uri.rstrip('/').rsplit('/', 1)[-1]}"] if folder else [])]
    return [f"no chart at {uri}" for uri in map(str, named) if not any(place(t).exists() for t in tries(uri))]


def load(uri: str) -> dict | str:
    """The document, or why there is none."""
    if not place(uri).exists():
        return f"{uri} does not exist"
    try:
        document = json.loads(place(uri).read_text())
    except Exception as e:  # noqa: BLE001  a store's own errors come through Py4J
        return f"{uri} cannot be read: {e}"
    return document if isinstance(document, dict) else f"{uri} holds no object"


def validate_artifacts(metrics: object, charts: object = None, report: object = None, allow_placeholders: bool = False) -> list[str]:
    """Every breach over all documents, their charts and the report; empty if the artifacts are sound."""
    loaded = {kind: load(f"{str(metrics).rstrip('/')}/{file}") for kind, file in DOCUMENTS.items()}
    sound = {kind: document for kind, document in loaded.items() if isinstance(document, dict)}
    errors = [f"{kind}: {why}" for kind, why in loaded.items() if kind not in sound]
    for kind, document in sound.items():
        errors += [f"{kind}: {e}" for e in [*errors_of(kind, document), *(missing_charts(document, charts) if kind in CHARTED else [])]]
    ended = [str(field(sound.get(kind), "completed_at_utc") or "") for kind in ("features", "awards")]
    if "" not in ended and ended[1] < ended[0]:
        errors.append("awards: built before the features that they rest on")
    if report is not None and not place(report).exists():
        errors.append(f"report: {report} does not exist")
    elif report is not None and not allow_placeholders:
        errors += [f"report: {mark} is not filled in" for mark in sorted(set(PLACEHOLDER.findall(place(report).read_text())))]
    return errors


def main(argv: list[str] | None = None) -> int:
    """``python -m chronolith.artifacts METRICS [CHARTS [REPORT]]``: prints breaches, 1 if there are any."""
    import sys

    found = validate_artifacts(*(sys.argv[1:] if argv is None else argv))
    print("\n".join(found) or "artifacts are sound")
    return int(bool(found))


if __name__ == "__main__":
    raise SystemExit(main())
