"""Personal data by fixed forms, and by contexts that such data are found in, with built-in functions only.

The fixed forms (mail and IP addresses, card and phone numbers) are found by
patterns that say the same as the published ones but can't fall back: each is
linear in a text's length.  Their finds are the seeds of a bootstrap.  The one or
two words before an identifier are a pattern; patterns and values make a graph
that Spark scores in rounds: a pattern's confidence is the share of all its
occurrences in the corpus that a value known as one kind follows, if different
values enough do; a value's score is the chance that one at least of its
confident patterns is right.  Values so found raise the confidence of further
patterns in the next round.  A pattern that many ordinary words follow never
becomes confident, so plain prose with numbers gains nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timbral.llm.shared import durable, shuffle_width, stored

# The kinds in their order, and the lengths in digits of a card and of a phone number.
KINDS = ("email", "ip", "card", "phone")
CARD_DIGITS, PHONE_DIGITS = (12, 19), (9, 15)
EMAIL, IP, CARD, PHONE = range(4)
#: A word that may be an identifier of no fixed form.
MENTION = 4

_LOCAL = "[A-Za-z0-9._%+-]"
_WORD = "0-9A-Za-z@._%+:#/()-"
#: A find starts where a run of its characters starts, or where the find before it has ended (\G).  A card's digits are
#: counted within the run, which is one find whatever its length; a mention has four digits or an @.
PATTERNS = (
    rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    rf"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){{{CARD_DIGITS[0] - 1},{CARD_DIGITS[1] - 1}}}+(?![ -]?[0-9])",
    r"\+[0-9][ ().0-9-]+[0-9]",
    rf"(?<![{_WORD}])(?=(?:[A-Za-z@._%+:#/()-]*+[0-9]){{4}}|[0-9A-Za-z._%+:#/()-]*+@)[{_WORD}]++",
)
#: What a text must have for a pattern to be tried.
_NEEDS = ("@", "[0-9]", "[0-9]", r"\+", "[0-9@]")
#: Characters before a find in which its context is looked for.
_BEFORE = 160
#: Different known values that a pattern needs, the confidence from which it is used, and the score from which a value is taken.
SUPPORT, CONFIDENCE, SCORE = 4, 0.5, 0.5
ROUNDS = 3
#: Up to so many contexts (of two words) are broadcast; beyond, they are joined by a shuffle.
MOST_BROADCAST = 50_000


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _finds(text: Column, family: int) -> Column:
    """Array of the finds of a family: number, length of the text since the find before, the find, and the words before it."""
    pattern = F.lit(PATTERNS[family])
    pair = F.arrays_zip(F.regexp_extract_all(text, pattern, F.lit(0)).alias("hit"), F.split(text, PATTERNS[family], -1).alias("gap"))

    def one(x: Column, k: Column) -> Column:
        before = F.lower(F.substring(x["gap"], -_BEFORE, _BEFORE))
        words = F.when(before.rlike(r"\S\s+$"), F.filter(F.split(before, r"\s+"), lambda w: w != ""))
        return F.struct(F.lit(family).alias("family"), k.alias("no"), F.char_length(x["gap"]).alias("gap"), x["hit"].alias("hit"), F.try_element_at(words, F.lit(-2)).alias("second"), F.try_element_at(words, F.lit(-1)).alias("first"))

    found = F.transform(F.filter(pair, lambda x: x["hit"].isNotNull()), one)
    return F.when(text.rlike(_NEEDS[family]), found).otherwise(F.filter(found, lambda x: F.lit(False)))


def _luhn(digits: Column) -> Column:
    doubled = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c, k: (F.ascii(c) - 48) * (1 + k % 2))
    return F.aggregate(doubled, F.lit(0), lambda s, d: s + F.when(d > 9, d - 9).otherwise(d)) % 10 == 0


def _valid(family: Column, hit: Column) -> Column:
    small = lambda part: F.ltrim(part, F.lit("0")).rlike("^(?:[0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$")
    ip = F.forall(F.split(hit, r"\."), small)
    return F.when(family == IP, ip).when(family == CARD, _luhn(_digits(hit))).when(family == PHONE, F.length(_digits(hit)).between(*PHONE_DIGITS)).otherwise(True)


def scan(docs: DataFrame) -> DataFrame:
    """key, doc_id, finds: a row for each of docs, key being its number; in the shared folder, so that a key keeps its row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    finds = F.concat(*(_finds(text, family) for family in range(len(PATTERNS))))
    return stored(docs.select(F.monotonically_increasing_id().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), finds.alias("finds")))


def spans(scanned: DataFrame) -> DataFrame:
    """key, family, start, end, value, second, first: the valid finds of fixed form, and the mentions that touch none of them.

    Offsets are code points, end exclusive.  value: in lower case, or its digits alone where it has no letters.
    """
    rows = scanned.select("key", F.inline("finds")).repartition(shuffle_width(scanned.sparkSession), "key")
    upto = Window.partitionBy("key", "family").orderBy("no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("end", F.sum(F.col("gap") + F.char_length("hit")).over(upto)).withColumn("start", F.col("end") - F.char_length("hit"))
    # a mention ends before the sentence's own punctuation
    mention = F.col("family") == MENTION
    head, tail = F.ltrim(F.col("hit"), F.lit("(.:/#%-")), F.rtrim(F.col("hit"), F.lit("().:/#%-"))
    cut = placed.select(
        "key",
        "family",
        "hit",
        F.when(mention, F.col("start") + F.char_length("hit") - F.char_length(head)).otherwise(F.col("start")).alias("start"),
        F.when(mention, F.col("end") - F.char_length("hit") + F.char_length(tail)).otherwise(F.col("end")).alias("end"),
        "second",
        "first",
    )
    kept = cut.where(_valid(F.col("family"), F.col("hit")) & (F.col("end") > F.col("start")))
    base = F.col("family") < MENTION
    before = Window.partitionBy("key").orderBy("start", "family").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("key").orderBy(F.desc("start"), F.desc("family")).rowsBetween(Window.unboundedPreceding, -1)
    beside = kept.withColumn("last_end", F.max(F.when(base, F.col("end"))).over(before)).withColumn("next_start", F.min(F.when(base, F.col("start"))).over(after))
    clear = beside.where(base | (F.coalesce(F.col("last_end"), F.lit(0)) <= F.col("start")) & (F.coalesce(F.col("next_start"), F.col("end")) >= F.col("end")))
    word = F.lower(F.rtrim(F.ltrim(F.col("hit"), F.lit("(.:/#%-")), F.lit("().:/#%-")))
    value = F.when(word.rlike("[a-z@:]") | (F.col("family") == IP), word).otherwise(_digits(word))
    return clear.select("key", "family", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), value.alias("value"), "second", "first")


def edges(found: DataFrame) -> DataFrame:
    """pattern, value, family, n: which values follow which words, and how often."""
    both = F.array(F.col("first"), F.concat_ws(" ", "second", "first"))
    each = found.where("first IS NOT NULL").select(F.explode(F.when(F.col("second").isNull(), F.slice(both, 1, 1)).otherwise(both)).alias("pattern"), "value", "family")
    return stored(each.groupBy("pattern", "value").agg(F.min("family").alias("family"), F.count("*").alias("n")))


def ordinary_followers(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """pattern, words: how often a word that is no identifier follows each of the patterns, in all texts."""
    words = F.split(F.lower(F.coalesce(F.col("text").cast("string"), F.lit(""))), r"\s+")
    size = F.greatest(F.size("words"), F.lit(1))
    runs = docs.select(words.alias("words")).select(F.inline(F.arrays_zip(F.col("words").alias("a"), F.slice("words", F.lit(2), size).alias("b"), F.slice("words", F.lit(3), size).alias("c"))))
    follow = runs.select(F.inline(F.array(F.struct(F.col("a").alias("pattern"), F.col("b").alias("next")), F.struct(F.concat_ws(" ", "a", "b").alias("pattern"), F.col("c").alias("next")))))
    plain = follow.where(F.col("next").isNotNull() & (F.col("next") != "") & ~F.col("next").rlike(r"^[+(]+[0-9]|@|(?:[0-9][^0-9]*){4}"))
    few = patterns.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    if few:
        plain = plain.join(F.broadcast(patterns), "pattern", "left_semi")
    counts = plain.groupBy("pattern").agg(F.count("*").alias("words"))
    return counts if few else counts.join(patterns, "pattern", "left_semi")


def confident(graph: DataFrame, followers: DataFrame, known: DataFrame | None, support: int = SUPPORT, least: float = CONFIDENCE) -> DataFrame:
    """pattern, kind, confidence of the patterns that are sure enough, given the values known so far (value, kind, score)."""
    seed = F.col("family") < MENTION
    if known is None:
        scored = graph.select("pattern", "n", F.when(seed, F.col("family")).alias("kind"), F.lit(1.0).alias("score"))
    else:
        named = known.select("value", F.col("kind").alias("_kind"), F.col("score").alias("_score"))
        joined = graph.join(named, "value", "left")
        scored = joined.select("pattern", "n", F.when(seed, F.col("family")).otherwise(F.col("_kind")).alias("kind"), F.when(seed, F.lit(1.0)).otherwise(F.col("_score")).alias("score"))

    def held(kind: int) -> F.Column:
        mine = F.col("kind") == kind
        values, times = F.sum(F.when(mine, F.col("score"))), F.sum(F.when(mine, F.col("score") * F.col("n")))
        return F.struct(F.coalesce(times, F.lit(0.0)).alias("times"), F.lit(-kind).alias("kind"), F.coalesce(values, F.lit(0.0)).alias("values"))

    totals = scored.groupBy("pattern").agg(F.sum("n").alias("n"), *(held(k).alias(name) for k, name in enumerate(KINDS))).join(followers, "pattern", "left")
    rated = totals.select("pattern", F.greatest(*KINDS).alias("best"), (F.col("n") + F.coalesce("words", F.lit(0))).alias("all"))
    return rated.where(F.col("best.values") >= support).select("pattern", (-F.col("best.kind")).alias("kind"), (F.col("best.times") / F.col("all")).alias("confidence")).where(F.col("confidence") >= least)


def plausible(kind: Column, value: Column) -> Column:
    """Whether a value can be of a kind, though it has not its fixed form."""
    digits, letters = F.length(_digits(value)), value.rlike("[a-z]")
    return F.when(kind == EMAIL, value.contains("@")).when(kind == IP, value.rlike("^[0-9a-f]*(?:[.:][0-9a-f]*){3,}$")).when(kind == CARD, ~letters & (digits >= 8)).otherwise(~letters & digits.between(5, PHONE_DIGITS[1]))


def discovered(graph: DataFrame, patterns: DataFrame, least: float = SCORE) -> DataFrame:
    """value, kind, score of the values of no fixed form that confident patterns precede."""
    wrong = F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-9)))))
    found = graph.where(F.col("family") == MENTION).join(patterns, "pattern").where(plausible(F.col("kind"), F.col("value")))
    scored = found.groupBy("value").agg((1 - wrong).alias("score"), F.max(F.struct("confidence", (-F.col("kind")).alias("kind"))).alias("best"))
    return scored.select("value", (-F.col("best.kind")).alias("kind"), "score").where(F.col("score") >= least)


def bootstrap(docs: DataFrame, graph: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, least: float = CONFIDENCE) -> DataFrame:
    """value, kind, score of all values found in some rounds of scoring patterns by values and values by patterns."""
    candidates = graph.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= support).select("pattern")
    graph = stored(graph.join(candidates, "pattern", "left_semi"))
    followers = stored(ordinary_followers(docs, candidates))
    known = None
    for _ in range(rounds):
        known = durable(discovered(graph, confident(graph, followers, known, support, least)))
    return known


def find_personal_data(docs: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, least: float = CONFIDENCE) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added: a row for each row of docs.

    docs: doc_id, text; other columns are left aside.  A null text is an empty
    one, a null or repeated doc_id keeps its rows.  The counts and base_sha256
    are of the fixed forms; spans also has the n_added finds by context, as
    kind:start:end.  Copies of a text count as often as they occur, among the
    identifiers and among the other words; support counts different values.  No
    documents give no rows.
    """
    scanned = scan(docs)
    found = stored(spans(scanned))
    values = bootstrap(docs, edges(found), rounds, support, least)
    base = found.where(F.col("family") < MENTION).select("key", "start", "end", F.col("family").alias("kind"), F.lit(False).alias("added"))
    more = found.where(F.col("family") == MENTION).join(values, "value").select("key", "start", "end", "kind", F.lit(True).alias("added"))
    span = F.struct("start", "kind", "end", "added")
    rows = base.unionByName(more).select("key", F.lit(None).cast("long").alias("doc_id"), span.alias("span"))
    every = scanned.select("key", "doc_id", F.lit(None).cast(rows.schema["span"].dataType).alias("span")).unionByName(rows)
    held = every.groupBy("key").agg(F.max("doc_id").alias("doc_id"), F.array_sort(F.collect_list("span")).alias("all"))
    own = held.select("doc_id", "all", F.filter("all", lambda s: ~s["added"]).alias("base"))
    names = F.array(*map(F.lit, KINDS))
    listed = lambda column: F.array_join(F.transform(column, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return own.select("doc_id", *counts, F.sha2(listed("base"), 256).alias("base_sha256"), listed("all").alias("spans"), (F.size("all") - F.size("base")).cast("long").alias("n_added"))
