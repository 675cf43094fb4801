"""Physical plans as text, and counts of their operators."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame


def physical_plan(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def operators(df: DataFrame) -> Counter:
    """How often each operator stands in the plan."""
    lines = physical_plan(df).splitlines()
    return Counter(m[1] for line in lines if (m := re.match(r"[\s:+\-*()\d]*([A-Z]\w+)", line)))
