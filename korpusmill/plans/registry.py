"""All core queries and their SQL, gathered from the plan modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from korpusmill.plans import corpus, language, messages, quality, tokens

_REGISTRIES = (corpus.R, tokens.R, messages.R, language.R)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = dict(quality.QUERIES)
ORACLES: dict[str, str] = dict(quality.ORACLES)
for _registry in _REGISTRIES:
    QUERIES.update(_registry.queries)
    ORACLES.update(_registry.oracles)
