"""Records and rosters to results, candidates, missing students, exceptions, summary."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollkeeper.config import MatchConfig
from rollkeeper.operators import exceptions, fuzzy, matching
from rollkeeper.session import stage


@dataclass(frozen=True)
class Reconciliation:
    results: DataFrame
    candidates: DataFrame
    missing: DataFrame
    exceptions: DataFrame
    summary: DataFrame


def resolve(
    records: DataFrame,
    roster: DataFrame,
    config: MatchConfig = MatchConfig(),
    keep: Callable[[DataFrame], DataFrame] = stage,
) -> tuple[DataFrame, DataFrame | None]:
    """Resolved records and the fuzzy candidates (null when fuzzy matching is off).

    ``keep`` materialises what is read more than once; pass an identity to leave
    the whole plan lazy on small inputs.
    """
    found = matching.find_exact(records, roster)
    if not config.use_fuzzy:
        return matching.resolve_exact(keep(found), config), None
    found = keep(found)
    is_open = F.col("hit").isNull() & (F.col("norm_name") != "")
    open_records = found.filter(is_open)
    names = open_records.select(*fuzzy.NAME_KEY).distinct()
    candidates = keep(fuzzy.top_candidates(names, roster, config, keep))
    settled = matching.resolve_exact(found.filter(~is_open), config)
    return settled.unionByName(matching.resolve_fuzzy(open_records, fuzzy.decide(candidates, config))), candidates


def reconcile(
    records: DataFrame,
    roster: DataFrame,
    config: MatchConfig = MatchConfig(),
    keep: Callable[[DataFrame], DataFrame] = stage,
) -> Reconciliation:
    """The full job. Read results ordered by ``scope_id, rec_seq``."""
    resolved, candidates = resolve(records, roster, config, keep)
    # Read for the first records of students and again for all.
    resolved = keep(resolved)
    firsts = matching.first_seen(resolved)
    results = keep(matching.flag_repeats(resolved, firsts, config))
    missing = matching.missing_students(roster, matching.first_seen(results))
    return Reconciliation(
        results=results,
        candidates=matching.candidate_rows(results, roster, candidates),
        missing=missing,
        exceptions=exceptions.all_exceptions(results, missing),
        summary=exceptions.match_summary(results, roster, missing),
    )
