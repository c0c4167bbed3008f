"""A palette's items and song context as a fold over requests with optimistic revisions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

RESULT = "palette_id long, request_id long, action string, code string, revision long, kick_id long, bass_id long, tempo double"


def step(state: dict, request: dict) -> tuple[dict, str, str | None]:
    """The state after a request, the action taken, and the refusal if there is one.

    A request carries the revision that it was made against; a stale one is
    refused.  Setting what is set already, or removing nothing, changes no
    revision.
    """
    if request["revision"] is not None and request["revision"] != state["revision"]:
        return state, "refused", "stale_revision"
    slot, value = request["slot"], request["value"]
    if slot not in ("kick_id", "bass_id", "tempo"):
        return state, "refused", "unknown_slot"
    value = None if value is None or value != value else value
    if slot != "tempo" and value is not None:
        value = int(value)
    if state[slot] == value:
        return state, "no_op", None
    action = "set" if state[slot] is None else "removed" if value is None else "replaced"
    return state | {slot: value, "revision": state["revision"] + 1}, action, None


_EMPTY = {"revision": 0, "kick_id": None, "bass_id": None, "tempo": None}


def _run(rows: pd.DataFrame, state: dict) -> tuple[pd.DataFrame, dict]:
    out = []
    for r in rows.sort_values("request_id").to_dict("records"):
        revision = r["revision"]
        r["revision"] = None if revision is None or revision != revision else int(revision)
        state, action, code = step(state, r)
        out.append({"palette_id": r["palette_id"], "request_id": r["request_id"], "action": action, "code": code} | state)
    return pd.DataFrame(out).astype({"kick_id": "Int64", "bass_id": "Int64", "tempo": "Float64"}), state


def fold(requests: DataFrame) -> DataFrame:
    """The answer to each request, in order, with the palette after it. A task reads palettes one after the other as a stream and keeps one state."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        palette, state = None, dict(_EMPTY)
        for batch in batches:
            runs = (batch["palette_id"] != batch["palette_id"].shift()).cumsum()
            for _, rows in batch.groupby(runs, sort=False):
                if rows["palette_id"].iloc[0] != palette:
                    palette, state = rows["palette_id"].iloc[0], dict(_EMPTY)
                out, state = _run(rows, state)
                yield out

    order = ["palette_id", "request_id"]
    return requests.repartition("palette_id").sortWithinPartitions(*order).mapInPandas(run, RESULT)


def stream(requests: DataFrame) -> DataFrame:
    """fold() on a stream, with the palette as its state."""

    def apply(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = dict(zip(_EMPTY, state.get, strict=True)) if state.exists else dict(_EMPTY)
        out, held = _run(pd.concat(list(frames)), held)
        state.update(tuple(held.values()))
        yield out

    return requests.groupBy("palette_id").applyInPandasWithState(apply, RESULT, "revision long, kick_id long, bass_id long, tempo double", "append", GroupStateTimeout.NoTimeout)


def context_state(value: Column, confidence: Column, touched: Column) -> Column:
    """known, unknown (asked for, without a value) or unset."""
    return F.when(value.isNotNull() & confidence.isNotNull(), "known").when(F.coalesce(touched, F.lit(False)), "unknown").otherwise("unset")


def newest(answers: DataFrame, key: str = "palette_id") -> DataFrame:
    """Each palette's answer of the highest revision: a late one never replaces it."""
    rest = F.struct(*[c for c in answers.columns if c != key])
    return answers.groupBy(key).agg(F.max_by(rest, F.struct("revision", "request_id")).alias("v")).select(key, "v.*")


def active_items(items: DataFrame) -> DataFrame:
    """Rows that have not been removed; the others are history."""
    return items.where("removed_at is null")


def with_context(items: DataFrame, samples: DataFrame, errors: DataFrame) -> DataFrame:
    """items with their sample's role and state and the content's last error; an item without a sample stays."""
    joined = items.join(samples.select("sample_id", "content", "role"), "sample_id", "left")
    return joined.join(errors, "content", "left").withColumn("known", F.col("role").isNotNull())


def default_project(projects: DataFrame) -> DataFrame:
    """The project created first, by id among those of one time."""
    return projects.agg(F.min_by("project_id", F.struct("created_at", "project_id")).alias("project_id"))
