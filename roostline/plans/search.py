"""Recorded response bodies to ranked listings, as one plan over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from roostline import config
from roostline.operators import grounding, search


def answer(
    responses: DataFrame,
    vocabulary: DataFrame,
    listings: DataFrame,
    embed: Callable[[DataFrame], DataFrame],
    limit: int = 10,
    cap: int = config.FANOUT_CAP,
) -> DataFrame:
    """``(request_id, id, distance, place)`` for every request that was parsed.

    ``embed`` adds a ``query`` vector to ``(request_id, semantic_query, …)``. Requests
    that failed to parse have no rows here.
    """
    sets = grounding.filter_sets(grounding.ground(responses, vocabulary))
    per_branch = search.branch_top_k(listings, embed(sets), limit, cap)
    return search.merge_branches(per_branch, limit)
