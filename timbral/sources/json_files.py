"""Strict JSON documents in files: repeated keys, NaN and broken text are refused, and a bad file is a row with its problem, not an error.

A file's digest is that of its bytes.  Checks look at a document's own types: a
number in quotes is no number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The fields of the documents, their version, and the labels of ratings.
PAIR_LIST = ("schema_version", "dataset_version", "split_manifest_digest", "sampler_seed", "assignment_seed", "pairs")
PAIR = ("pair_id", "kick_sample_id", "bass_sample_id")
EXPORT = ("schema_version", "session", "ratings")
RATING = ("pair_id", "kick_sample_id", "bass_sample_id", "presentation_index", "rating", "skip", "skip_reason", "recognised", "playback_completed", "responded_at", "correction_of")
VERSION = "1.0"
LABELS = ("poor", "acceptable", "good", "excellent")
DIGEST, PAIR_ID = r"\Asha256:[0-9a-f]{64}\z", r"\A[A-Za-z0-9:_.-]{1,128}\z"

_PAIRS = "array<struct<pair_id: string, kick_sample_id: string, bass_sample_id: string>>"
_RATINGS = "array<struct<pair_id: string, kick_sample_id: string, bass_sample_id: string, presentation_index: bigint, rating: string, skip: boolean, recognised: boolean, playback_completed: boolean>>"


def read(spark: SparkSession, path: str) -> DataFrame:
    """path, digest and document (the text, null where it is no UTF-8) of every file."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("digest"), F.try_validate_utf8(F.col("content").cast("string")).alias("document"))


class Value:
    """Tests of one value of a parsed document; each is true or false, never null."""

    def __init__(self, v: Column) -> None:
        self.v, self.kind = v, F.coalesce(F.schema_of_variant(v), F.lit("VOID"))

    def at(self, name: str) -> Value:
        return Value(F.try_variant_get(self.v, f"$.{name}", "variant"))

    def text(self) -> Column:
        return F.when(self.kind == "STRING", F.try_variant_get(self.v, "$", "string"))

    def is_text(self) -> Column:
        return F.coalesce(F.length(F.trim(self.text())) > 0, F.lit(False))

    def equals(self, value: str) -> Column:
        return F.coalesce(self.text() == value, F.lit(False))

    def has_fields(self, names: tuple[str, ...]) -> Column:
        keys = F.map_keys(F.try_variant_get(self.v, "$", "map<string, variant>"))  # null for what is no object
        return F.coalesce(F.array_sort(keys) == F.array(*map(F.lit, sorted(names))), F.lit(False))

    def holds(self, *names: str) -> Column:
        """An object with these keys, and others maybe."""
        keys = F.json_object_keys(F.to_json(self.v))
        return F.coalesce(self.is_object() & (F.size(F.array_except(F.array(*map(F.lit, names)), keys)) == 0), F.lit(False))

    def is_object(self) -> Column:
        return self.kind.startswith("OBJECT")

    def number(self) -> Column:
        return F.when(self.kind.rlike("^(BIGINT|DOUBLE|DECIMAL.*|FLOAT|INT|SMALLINT|TINYINT)$"), F.try_variant_get(self.v, "$", "double"))

    def is_list(self) -> Column:
        return self.kind.startswith("ARRAY")

    def items(self) -> Column:
        return F.coalesce(F.try_variant_get(self.v, "$", "array<variant>"), F.array().cast("array<variant>"))


def _once(value: Column, rule: Callable[[Column], Column]) -> Column:
    """rule of a value that is computed once, however often the rule names it."""
    return F.transform(F.array(value), rule)[0]


def pair_list_problem(document: Column) -> Column:
    """Why a text is no pair list: its code, a colon and where; null if it is one."""
    says = lambda code, where: F.lit(f"{code}:{where}")

    def sound(p: Column) -> Column:
        pair = Value(p)
        return F.coalesce(pair.at("pair_id").text().rlike(PAIR_ID), F.lit(False)) & pair.at("kick_sample_id").is_text() & pair.at("bass_sample_id").is_text()

    def of_pairs(items: Column) -> Column:
        return (
            F.when(F.size(items) == 0, says("schema_mismatch", "pair_list.pairs"))
            .when(~F.forall(items, lambda p: Value(p).has_fields(PAIR)), says("schema_mismatch", "pair_list.pairs"))
            .when(~F.forall(items, sound), says("schema_mismatch", "pair_list.pairs.pair"))
        )

    def problem(v: Column) -> Column:
        d = Value(v)
        # what is no list has no items
        return (
            F.when(~d.has_fields(PAIR_LIST), says("schema_mismatch", "pair_list"))
            .when(~d.at("schema_version").equals(VERSION), says("schema_mismatch", "pair_list.schema_version"))
            .when(~d.at("dataset_version").is_text(), says("schema_mismatch", "pair_list.dataset_version"))
            .when(~F.coalesce(d.at("split_manifest_digest").text().rlike(DIGEST), F.lit(False)), says("split_manifest_digest_invalid", "pair_list.split_manifest_digest"))
            .when(~d.at("sampler_seed").is_text(), says("schema_mismatch", "pair_list.sampler_seed"))
            .when(~d.at("assignment_seed").is_text(), says("schema_mismatch", "pair_list.assignment_seed"))
            .otherwise(_once(d.at("pairs").items(), of_pairs))
        )

    return _once(F.try_parse_json(document), problem)


def export_problem(document: Column) -> Column:
    """malformed_export with what is wrong, or null: fields, version, session, and every rating's fields, types and label."""

    def sound(r: Column) -> Column:
        rating = Value(r)
        known = _once(rating.at("rating").v, lambda x: (Value(x).kind == "VOID") | F.coalesce(Value(x).text().isin(*LABELS), F.lit(False)))
        ids = rating.at("pair_id").is_text() & rating.at("kick_sample_id").is_text() & rating.at("bass_sample_id").is_text()
        return rating.has_fields(RATING) & (rating.at("skip").kind == "BOOLEAN") & (rating.at("presentation_index").kind == "BIGINT") & known & ids

    def problem(v: Column) -> Column:
        d = Value(v)
        listed = F.try_variant_get(v, "$.ratings", "array<variant>")  # null for what is no list
        named = d.at("session").at("session_id").is_text() & d.at("session").at("evaluator_id").is_text()
        return (
            F.when(~d.has_fields(EXPORT), "malformed_export:fields")
            .when(~d.at("schema_version").equals(VERSION), "malformed_export:version")
            .when(~d.at("session").is_object(), "malformed_export:session")
            .otherwise(_once(listed, lambda items: F.when(items.isNull(), "malformed_export:session").when(~named, "malformed_export:ids").when(~F.forall(items, sound), "malformed_export:rating")))
        )

    return _once(F.try_parse_json(document), problem)


def pairs_of(documents: DataFrame) -> DataFrame:
    """place, pair_id, kick, bass of the sound pair lists, with the other columns but document; a repeated pair_id keeps its first pair."""
    rest = [c for c in documents.columns if c != "document"]
    good = documents.where(pair_list_problem(F.col("document")).isNull())
    rows = good.select(*rest, F.posexplode(F.from_json("document", f"pairs {_PAIRS}")["pairs"]).alias("place", "p"))
    first = rows.groupBy(*rest, F.col("p.pair_id").alias("pair_id")).agg(F.min_by(F.struct("place", "p"), "place").alias("r"))
    return first.select(*rest, F.col("r.place").alias("place"), "pair_id", F.col("r.p.kick_sample_id").alias("kick"), F.col("r.p.bass_sample_id").alias("bass"))


def ratings_of(documents: DataFrame) -> DataFrame:
    """session_id, evaluator_id, place, pair_id, label, skipped of the sound exports, with the other columns but document."""
    rest = [c for c in documents.columns if c != "document"]
    good = documents.where(export_problem(F.col("document")).isNull())
    read_ = good.select(*rest, F.from_json("document", f"session struct<session_id: string, evaluator_id: string>, ratings {_RATINGS}").alias("d"))
    rows = read_.select(*rest, "d.session.session_id", "d.session.evaluator_id", F.posexplode("d.ratings").alias("place", "r"))
    return rows.select(*rest, "session_id", "evaluator_id", "place", "r.pair_id", F.col("r.rating").alias("label"), F.col("r.skip").alias("skipped"))


# The names under which split manifests have their parts and roles.
HELD_OUT, TUNING = ("held_out", "held-out", "heldout"), ("tuning", "tune")
ROLE_KEYS = {"kick": ("kicks", "kickss"), "bass": ("bass", "basss", "basses", "bassess")}


def _ids(part: Value, role: str) -> tuple[Column, Column]:
    """The ids of a role in a part, and whether they are a list of names; the first name of the role that is there counts."""
    lists = [part.at(name) for name in ROLE_KEYS[role]]
    first = F.coalesce(*(F.when(x.kind != "VOID", x.v) for x in lists))
    own = Value(first)
    texts = F.transform(own.items(), lambda i: Value(i).text())
    return texts, own.is_list() & F.forall(texts, lambda t: F.coalesce(F.length(t) > 0, F.lit(False)))


def split_rows(documents: DataFrame) -> DataFrame:
    """partition, role, place, sample_id of each split manifest, with the other columns but document; no rows of a malformed one."""
    rest = [c for c in documents.columns if c != "document"]
    d = Value(F.try_parse_json("document"))
    quoted = lambda name: f"$['{name}']"
    part = lambda names: Value(F.coalesce(*(F.try_variant_get(d.v, quoted(n), "variant") for n in names)))
    held, tuned = part(HELD_OUT), part(TUNING)
    found, fits = [], held.is_object()
    for partition, where in (("held_out", held), ("tuning", tuned)):
        for role in ROLE_KEYS:
            ids, good = _ids(where, role)
            if partition == "held_out":
                fits = fits & good
            found.append(F.struct(F.lit(partition).alias("partition"), F.lit(role).alias("role"), F.when(good, ids).otherwise(F.array().cast("array<string>")).alias("ids")))
    rows = documents.where(d.is_object() & fits).select(*rest, F.explode(F.array(*found)).alias("r"))
    return rows.select(*rest, "r.partition", "r.role", F.posexplode("r.ids").alias("place", "sample_id"))


def assignment_rows(documents: DataFrame) -> DataFrame:
    """pair_id, place, evaluator of each assignment, a map of lists or a list of records, with the other columns but document; no rows of a malformed one.

    Of records that repeat a pair the last stands.
    """
    rest = [c for c in documents.columns if c != "document"]
    given = Value(F.try_parse_json("document")).at("assignments")
    map_ = F.try_variant_get(given.v, "$", "map<string, variant>")
    entries = F.when(given.is_object(), F.transform(F.map_entries(map_), lambda e: F.struct(e["key"].alias("pair"), e["value"].alias("who")))).when(given.is_list(), F.transform(given.items(), lambda r: F.struct(Value(r).at("pair_id").text().alias("pair"), Value(r).at("evaluators").v.alias("who"))))

    def sound(e: Column) -> Column:
        who = Value(e["who"])
        named = F.forall(who.items(), lambda i: F.coalesce(F.length(Value(i).text()) > 0, F.lit(False)))
        return (given.is_object() | F.coalesce(F.length(e["pair"]) > 0, F.lit(False))) & who.is_list() & named

    rows = documents.where(entries.isNotNull() & F.forall(entries, sound)).select(*rest, F.posexplode(entries).alias("at", "e"))
    names = rows.select(*rest, "at", F.col("e.pair").alias("pair_id"), F.transform(Value(F.col("e.who")).items(), lambda i: Value(i).text()).alias("who"))
    last = names.groupBy(*rest, "pair_id").agg(F.max_by("who", "at").alias("who"))
    return last.select(*rest, "pair_id", F.posexplode("who").alias("place", "evaluator"))
