"""Shortlists in a masked, normalised feature space.

A kick is compared with every eligible candidate over the dimensions that both
know.  Statistics come from the whole population of the analysis version, never
from the admitted rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timbral.operators.ranking import blocks_of, in_blocks, in_cells
from timbral.schemas import BANDS, CANDIDATE_ROLES, RELIABLE

# The dimensions in order, with their transforms.
SPACE: dict[str, str] = {
    "fundamental": "log2_hz",
    "spectral_centroid": "log2_hz",
    "spectral_rolloff": "log2_hz",
    "loudness": "linear",
    "crest_factor": "linear",
    "transient_strength": "linear",
    "attack": "log1p_ms",
    "decay": "log1p_ms",
} | dict.fromkeys(BANDS, "linear")
COVERAGE = 0.50
LEAST_STD = 1e-9
MOST_Z = 1e9
SHORTLIST = (50, 100)
#: Kicks and candidates of one cell of a search, and kicks whose distances are held at once.
CELL = (2048, 16384)
HELD = 128


@dataclass(frozen=True)
class Normal:
    """Mean and standard deviation of one dimension, or why it is inactive."""

    name: str
    mean: float | None
    std: float | None
    n: int
    inactive: str | None


def transformed(name: str, value: Column) -> Column:
    """log2 of a positive frequency, log1p of a time from 0 on, anything else as it is."""
    kind = SPACE[name]
    if kind == "log2_hz":
        return F.when(value > 0, F.log2(value))
    return F.when(value >= 0, F.log1p(value)) if kind == "log1p_ms" else value


def masked(name: str) -> Column:
    """The dimension's coordinate: null for an unknown value, one out of the transform's domain, or an unreliable fundamental."""
    value = F.col(name)
    if name == "fundamental":
        value = F.when(F.coalesce(F.col("fundamental_confidence") >= RELIABLE, F.lit(False)), value)
    return transformed(name, value)


def coordinates(samples: DataFrame) -> DataFrame:
    """samples with coords, an array in the order of SPACE."""
    return samples.withColumn("coords", F.array(*(masked(n) for n in SPACE)))


def population(samples: DataFrame, version: str) -> DataFrame:
    """Candidate-role samples of one analysis version."""
    return samples.where(F.col("role").isin(*CANDIDATE_ROLES) & (F.col("analysis_version") == version))


def mask_counts(samples: DataFrame) -> DataFrame:
    """dimension, known, domain_rejected: an unreliable fundamental counts under neither."""
    rows = []
    for name in SPACE:
        value = F.col(name)
        usable = value.isNotNull() & (F.coalesce(F.col("fundamental_confidence") >= RELIABLE, F.lit(False)) if name == "fundamental" else F.lit(True))
        known = usable & transformed(name, value).isNotNull()
        rows += [F.count_if(known).alias(f"{name}_k"), F.count_if(usable & ~known).alias(f"{name}_r")]
    parts = F.array(*(F.struct(F.lit(n).alias("dimension"), F.col(f"{n}_k").alias("known"), F.col(f"{n}_r").alias("domain_rejected")) for n in SPACE))
    return samples.agg(*rows).select(F.explode(parts).alias("d")).select("d.*")


def fit(samples: DataFrame) -> DataFrame:
    """dimension, n, mean, std (population) and inactive_reason, in one pass with map-side partials.

    Values are scaled by the dimension's largest magnitude before they are
    squared, so that no finite input overflows.
    """
    first = samples.agg(*(F.max(F.abs(masked(n))).alias(n) for n in SPACE))
    scale = [F.when(F.col(f"_s.{n}") > 1e150, F.col(f"_s.{n}")).otherwise(1.0).alias(f"_scale_{n}") for n in SPACE]
    scaled = samples.crossJoin(F.broadcast(first.select(F.struct(*SPACE).alias("_s")))).select("*", *scale)
    rows = []
    for n in SPACE:
        x = masked(n) / F.col(f"_scale_{n}")
        rows += [F.count(x).alias(f"{n}_n"), F.avg(x).alias(f"{n}_m"), F.stddev_pop(x).alias(f"{n}_s"), F.max(f"_scale_{n}").alias(f"{n}_f")]
    parts = F.array(*(F.struct(F.lit(n).alias("dimension"), F.col(f"{n}_n").alias("n"), (F.col(f"{n}_m") * F.col(f"{n}_f")).alias("mean"), (F.col(f"{n}_s") * F.col(f"{n}_f")).alias("std")) for n in SPACE))
    found = scaled.agg(*rows).select(F.explode(parts).alias("d")).select("d.*")
    reason = F.when(F.col("n") < 2, "insufficient_population").when(F.col("std") < LEAST_STD, "zero_variance")
    return found.withColumn("inactive_reason", reason)


def _normals(fitted: DataFrame) -> DataFrame:
    """One row: arrays of means and deviations in the order of SPACE, null where inactive."""
    order = F.array(*(F.lit(n) for n in SPACE))
    place = F.array_position(order, F.col("dimension"))
    active = F.col("inactive_reason").isNull()
    entry = F.struct(place.alias("place"), F.when(active, F.col("mean")).alias("mean"), F.when(active, F.col("std")).alias("std"))
    return fitted.agg(F.array_sort(F.collect_list(entry)).alias("normals"))


def similarities(kicks: DataFrame, candidates: DataFrame, fitted: DataFrame) -> DataFrame:
    """kick_id, sample_id, similarity, unavailable_reason, coverage and n_common of every pair.

    kicks is the stated query set, broadcast in blocks to the candidates'
    partitions, as are the 14 normals.  Nothing is shuffled.
    """
    queries = coordinates(kicks).select(F.col("sample_id").alias("kick_id"), F.col("coords").alias("kick_coords"))
    placed = coordinates(candidates).select("sample_id", "coords").crossJoin(F.broadcast(_normals(fitted)))
    pairs = reduce(DataFrame.unionByName, [placed.crossJoin(F.broadcast(part)) for part in in_blocks(queries, "kick_id")])
    z = F.zip_with("coords", "normals", lambda v, n: (v - n["mean"]) / n["std"])
    k = F.zip_with("kick_coords", "normals", lambda v, n: (v - n["mean"]) / n["std"])
    zipped = pairs.select("kick_id", "sample_id", F.zip_with(z, k, lambda a, b: F.struct(a.alias("a"), b.alias("b"))).alias("z"), F.size(F.filter("normals", lambda n: n["std"].isNotNull())).alias("active"))
    common = F.filter("z", lambda p: p["a"].isNotNull() & p["b"].isNotNull())
    kick_known = F.size(F.filter("z", lambda p: p["b"].isNotNull()))
    extreme = F.exists("common", lambda p: F.isnan(p["a"]) | F.isnan(p["b"]) | (F.abs(p["a"]) > MOST_Z) | (F.abs(p["b"]) > MOST_Z))
    counted = zipped.withColumn("common", common).withColumn("kick_known", kick_known).withColumn("n_common", F.size("common"))
    share = F.when(F.col("active") > 0, F.col("n_common") / F.col("active")).otherwise(0.0)
    reason = (
        F.when(F.col("active") == 0, "no_active_dimensions")
        .when(F.col("kick_known") / F.col("active") < COVERAGE, "kick_dimensions_insufficient")
        .when(F.col("n_common") / F.col("active") < COVERAGE, "insufficient_common_dimensions")
        .when(extreme, "extreme_dimension_value")
    )
    squares = F.aggregate("common", F.lit(0.0), lambda t, p: t + (p["a"] - p["b"]) * (p["a"] - p["b"]))
    similarity = F.lit(1.0) / (F.lit(1.0) + F.sqrt(squares / F.col("n_common")))
    out = counted.withColumn("unavailable_reason", reason)
    return out.select("kick_id", "sample_id", F.when(F.col("unavailable_reason").isNull(), similarity).alias("similarity"), "unavailable_reason", share.alias("coverage"), "n_common")


def _side(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which dimensions each row knows, which of these are extreme, and the others' values, 0 elsewhere."""
    columns = [table[f"z{k}"].combine_chunks() for k in range(len(SPACE))]
    known = np.column_stack([c.is_valid().to_numpy(zero_copy_only=False) for c in columns])
    z = np.column_stack([c.to_numpy(zero_copy_only=False) for c in columns])
    with np.errstate(invalid="ignore"):
        extreme = known & ~(np.abs(z) <= MOST_Z)
    return known, extreme, np.where(known & ~extreme, z, 0.0)


def _search(size: int, slack: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Of one cell's kicks and candidates the pairs that may be among a kick's first size, with their exact similarity.

    Products of matrices give every distance up to a bound on their rounding;
    what is no further than the size-th, by that bound and slack, is computed
    anew in the order of SPACE.  A kick with too few comparable candidates also
    keeps the first others by id.
    """

    def cell(kicks: pa.Table, candidates: pa.Table) -> pa.Table:
        candidates = candidates.sort_by("sample_id")
        (k_known, k_extreme, k), (c_known, c_extreme, c) = _side(kicks), _side(candidates)
        active = kicks["active"][0].as_py() if len(kicks) else 0
        n, share = len(candidates), lambda count: count / active if active else np.zeros_like(count, dtype=float)
        right = np.hstack([c_known, c * c, c]).T.astype(float)
        k_error, c_error = (4e-14 * (x * x).sum(axis=1) for x in (k, c))
        rows, places = [], []
        for at in range(0, len(kicks) if n else 0, HELD):
            part = slice(at, at + HELD)
            own, mask = k[part], k_known[part].astype(float)
            common = mask @ c_known.T
            good = (common > 0) & (share(common) >= COVERAGE) & (share(mask.sum(axis=1)) >= COVERAGE)[:, None]
            if k_extreme[part].any() or c_extreme.any():
                good &= k_extreme[part].astype(float) @ c_known.T + mask @ c_extreme.T.astype(float) == 0
            far = np.hstack([own * own, mask, -2.0 * own]) @ right
            far += k_error[part][:, None]
            far += c_error
            far /= np.maximum(common, 1.0)
            far[~good] = np.inf
            last = np.maximum(np.partition(far, size - 1, axis=1)[:, size - 1], 0.0) if n > size else np.full(len(own), np.inf)
            least = 1.0 / (1.0 + np.sqrt(last)) - slack
            with np.errstate(divide="ignore", over="ignore"):
                reach = np.where(least > 0, (1.0 / least - 1.0) ** 2, np.inf)
            kept = good & (far <= (reach * (1 + 1e-12) + 2 * (k_error[part] + c_error.max()))[:, None])
            for row in np.flatnonzero(good.sum(axis=1) < size):
                kept[row, np.flatnonzero(~good[row])[:size]] = True
            row, place = np.nonzero(kept)
            rows.append(row + at)
            places.append(place)
        row, place = (np.concatenate(x) if x else np.zeros(0, dtype=int) for x in (rows, places))
        both = k_known[row] & c_known[place]
        squares = np.zeros(len(row))
        for d in range(len(SPACE)):
            apart = c[place, d] - k[row, d]
            squares += np.where(both[:, d], apart * apart, 0.0)
        common = both.sum(axis=1)
        coverage = share(common)
        extreme = (both & (k_extreme[row] | c_extreme[place])).any(axis=1)
        faults = [np.full(len(row), active == 0), share(k_known.sum(axis=1))[row] < COVERAGE, coverage < COVERAGE, extreme]
        reason = np.select(faults, ["no_active_dimensions", "kick_dimensions_insufficient", "insufficient_common_dimensions", "extreme_dimension_value"], "")
        similarity = 1.0 / (1.0 + np.sqrt(squares / np.maximum(common, 1)))
        found = [kicks["kick_id"].take(pa.array(row)), candidates["sample_id"].take(pa.array(place)), pa.array(similarity, mask=reason != ""), pa.array(reason.astype(object), pa.string(), mask=reason == ""), pa.array(coverage), pa.array(common.astype("i4"))]
        return pa.table(found, names=["kick_id", "sample_id", "similarity", "unavailable_reason", "coverage", "n_common"])

    return cell


def nearest(kicks: DataFrame, candidates: DataFrame, fitted: DataFrame, size: int, digits: int | None = None) -> DataFrame:
    """Of similarities(), the rows among which each kick's first size positions are: some size rows for each kick and block of candidates.

    digits: similarities are rounded to so many before they are ordered.  Kicks
    and candidates are dealt into blocks that meet in cells of bounded size, so
    that a cell's pairs are a few products of matrices and most are never rows.
    Of candidates with equal coordinates the first size by id stand for all.
    """
    normal = _normals(fitted)
    z = [((F.col("coords")[k] - F.col("normals")[k]["mean"]) / F.col("normals")[k]["std"]).alias(f"z{k}") for k in range(len(SPACE))]
    active = F.size(F.filter("normals", lambda n: n["std"].isNotNull())).alias("active")
    blocks = blocks_of(kicks, candidates, CELL)
    copies = Window.partitionBy("coords").orderBy("sample_id")
    first = coordinates(candidates).select("sample_id", "coords").withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= size)
    own, others = (side.crossJoin(F.broadcast(normal)).select(key, *z, active) for key, side in (("kick_id", coordinates(kicks).withColumnRenamed("sample_id", "kick_id")), ("sample_id", first)))
    kind = kicks.schema["sample_id"].dataType.simpleString(), candidates.schema["sample_id"].dataType.simpleString()
    schema = f"kick_id {kind[0]}, sample_id {kind[1]}, similarity double, unavailable_reason string, coverage double, n_common int"
    found = in_cells(own, others, blocks, _search(size, 0.0 if digits is None else 1.001 * 10.0**-digits), schema)
    return found if digits is None else found.withColumn("similarity", F.round("similarity", digits))


def positions(pairs: DataFrame) -> DataFrame:
    """pairs with position: by similarity, then id; pairs without one come last, by id."""
    order = Window.partitionBy("kick_id").orderBy(F.col("similarity").isNull(), F.col("similarity").desc_nulls_last(), "sample_id")
    return pairs.withColumn("position", F.row_number().over(order))


def shortlist(pairs: DataFrame, size: int = SHORTLIST[1]) -> DataFrame:
    """Each kick's first size positions. The rank filter reaches the sort, which keeps size rows of each kick and task."""
    if not SHORTLIST[0] <= size <= SHORTLIST[1]:
        raise ValueError(f"a shortlist has {SHORTLIST[0]} to {SHORTLIST[1]} candidates")
    return positions(pairs).where(F.col("position") <= size)


def cutoff_evidence(pairs: DataFrame, size: int = SHORTLIST[1], copies: DataFrame | None = None) -> DataFrame:
    """For each kick: last_similarity, last_id, first_excluded_id, tied (ids with the last similarity), returned and limit_reason.

    pairs: all of each kick, or those of nearest() for size + 1 together with
    copies, the candidates it searched: a candidate ties where one of equal
    coordinates does.  Only the first size + 1 rows of a kick are sorted, which
    each task cuts down to before they are shuffled.
    """
    first = positions(pairs).where(F.col("position") <= size + 1)
    ends = first.groupBy("kick_id").agg(F.count("*").alias("n"), F.max(F.when(F.col("position") <= size, F.struct("position", "similarity", "sample_id"))).alias("last"), F.max(F.when(F.col("position") == size + 1, F.col("sample_id"))).alias("first_excluded_id"))
    last = ends.select("kick_id", "n", F.col("last.similarity").alias("last_similarity"), F.col("last.sample_id").alias("last_id"), "first_excluded_id")
    same = pairs.join(last.select("kick_id", "last_similarity"), "kick_id").where(F.col("similarity") == F.col("last_similarity"))
    if copies is not None:
        placed = coordinates(copies).select("sample_id", "coords")
        same = same.join(placed, "sample_id").select("kick_id", "coords").distinct().join(placed, "coords")
    tied = same.groupBy("kick_id").agg(F.array_sort(F.collect_list("sample_id")).alias("tied"))
    joined = last.join(tied, "kick_id", "left")
    return joined.select("kick_id", "last_similarity", "last_id", "first_excluded_id", F.coalesce("tied", F.array("last_id")).alias("tied"), F.least("n", F.lit(size).cast("long")).alias("returned"), F.when(F.col("n") > size, "shortlist_size").otherwise("eligible_exhausted").alias("limit_reason"))
