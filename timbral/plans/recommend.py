"""The flagship plan: one lazy DataFrame from stored samples to ranked candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timbral.operators import admission, ranking, retrieval


def recommend(kicks: DataFrame, candidates: DataFrame, judgments: DataFrame, version: str, policy: admission.Policy, song: admission.Song | None = None, limit: int = 10, size: int = 100, digits: int | None = None) -> DataFrame:
    """Best candidates of each kick: admitted, cut to a shortlist by similarity, ranked with judgments.

    kicks is the stated query set of one palette or a few.  Statistics are of
    the whole candidate population of the version; only admitted rows are
    compared.  Where candidates have a column content, equal contents count and
    are compared once, by the sample of least id.  Kicks meet all candidates in
    map tasks, which keep each kick's first rows; what is shuffled, scored and
    joined with judgments is the shortlist alone.
    """
    if not 5 <= limit <= 20:
        raise ValueError("a result has 5 to 20 candidates")
    if "content" in candidates.columns:
        candidates = candidates.groupBy("content").agg(F.min_by(F.struct(*candidates.columns), "sample_id").alias("c")).select("c.*")
    fitted = retrieval.fit(retrieval.population(candidates, version))
    admitted = admission.admit(candidates, None, policy, song)
    eligible = admitted.where("eligible").where(admitted["analysis_version"] == version)
    near = retrieval.shortlist(retrieval.nearest(kicks, eligible, fitted, size, digits), size).select("kick_id", "sample_id")
    scored = ranking.score_baseline(ranking.pair_up(near, kicks, eligible))
    ranked = ranking.rank(ranking.score_hybrid(scored, judgments, shortlisted=True))
    return ranked.where(ranked["rank"] <= limit)
