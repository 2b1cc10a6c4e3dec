"""Personal data by patterns and bootstrapped contexts, in Spark functions only.

Base kinds are found by regular expressions. Their matches are the seeds of a
bootstrap over contexts: tokens with a digit or an at sign are instances, the
two words in front of them are lexical patterns, and the two-sided graph of
patterns and instances is scored in turns. A pattern's confidence is the share
of its different instances that are believed to be identifiers (smoothed); an
instance's score is one minus the product of its patterns' doubts. Instances
that only high-confidence patterns vouch for are the discoveries.

The expressions are those of the contract, put so that Java's engine needs no
recursion and no second look at a character: separators inside a number or a
domain are first replaced by one private-use character of the same length.

Defined results: a null text is empty; positions are code points, end exclusive;
equal texts have equal spans; rows with null or repeated keys keep their own
row. A context is the last two words with letters before the token, however far
back; an instance between them counts as one word of its own, and the members of
a list share the context of the first. The first tokens of a text, with fewer
than two words before them, have none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinforge.session import materialize

KINDS = ("email", "ip", "card", "phone")
CONTEXT = "context"
DOT, OTHER = "", ""
LOCAL, LABEL = "A-Za-z0-9._%+-", "A-Za-z0-9-"
EMAIL = rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[{LABEL}]++{DOT}[{LABEL}{DOT}]*+"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = rf"(?<![0-9{DOT}])[0-9](?:{DOT}?+[0-9]){{11,18}}+(?![0-9{DOT}])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: An instance: a whole token with a digit or an at sign.
TOKEN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
SPAN = "array<struct<start:bigint,stop:bigint,txt:string,gap:string>>"
CHUNK = 256
#: What stands for an instance within a context, and what is between the members of a list.
INSTANCE = "#"
LISTED = r"^(?:and|or|et|ou|und|oder|y|o|e|u)?$"

ROUNDS, CONFIDENCE, SCORE, SUPPORT = 3, 0.5, 0.5, 3


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also within lambda functions."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _closed(fn: Callable, *given: object) -> Callable:
    return (lambda x, y: fn(x, y, *given)) if fn.__code__.co_argcount - len(given) == 2 else (lambda x: fn(x, *given))


def running(items: Column, zero: Column, step: Callable, emit: Callable, state: str, kind: str) -> Column:
    """``emit(s, x)`` of each item, where s is ``step`` folded over the items before it.

    Taken in chunks, so a long array costs little more than its length.
    """

    def put(a: Column, x: Column) -> Column:
        return F.struct(step(a["s"], x).alias("s"), F.concat(a["out"], F.array(emit(a["s"], x))).alias("out"))

    def chunked(all_: Column) -> Column:
        last = F.floor((F.size(all_) - 1) / CHUNK).cast("int")
        return let(F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(all_, k * CHUNK + 1, F.lit(CHUNK))), placed)

    def placed(chunks: Column) -> Column:
        starts = F.aggregate(
            chunks,
            F.struct(zero.alias("s"), F.array().cast(f"array<{state}>").alias("out")),
            lambda a, c: F.struct(F.aggregate(c, a["s"], step).alias("s"), F.concat(a["out"], F.array(a["s"])).alias("out")),
            lambda a: a["out"],
        )
        none = F.array().cast(f"array<{kind}>")
        return F.flatten(F.zip_with(chunks, starts, lambda c, s: F.aggregate(c, F.struct(s.alias("s"), none.alias("out")), put, lambda a: a["out"])))

    return let(items, lambda x: F.when(F.size(x) > 0, chunked(x)).otherwise(F.array().cast(f"array<{kind}>")))


def located(text: Column, pattern: str) -> Column:
    """Matches with their places, from the matches and the gaps between them."""
    hits, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    def pairs(hits: Column) -> Column:
        return F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda g, h: F.struct(g.alias("g"), h.alias("h")))

    def step(pos: Column, x: Column) -> Column:
        return pos + (F.length(x["g"]) + F.length(x["h"])).cast("long")

    def emit(pos: Column, x: Column) -> Column:
        return F.struct((pos + F.length(x["g"])).alias("start"), step(pos, x).alias("stop"), x["h"].alias("txt"), x["g"].alias("gap"))

    spans = let(hits, lambda h: running(pairs(h), F.lit(0).cast("long"), step, emit, "bigint", SPAN.removeprefix("array<")[:-1]))
    return F.coalesce(spans, F.array().cast(SPAN))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(x: Column) -> Column:
    digits = F.split(F.reverse(_digits(x)), "")
    twice = F.transform(digits, lambda c, i: F.when(i % 2 == 1, F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)).otherwise(c.cast("int")))
    return F.aggregate(twice, F.lit(0), lambda a, d: a + d) % 10 == 0


def _octets(x: Column) -> Column:
    # leading zeros aside, a part has at most three digits and at most 255
    return F.forall(F.split(x, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "").rlike(r"^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


def base_spans(text: Column) -> dict[str, Column]:
    """Arrays of the base kinds' spans."""
    raw = F.coalesce(text, F.lit(""))
    plain = F.translate(raw, DOT, OTHER)
    none = F.array().cast(SPAN)
    dotted = F.regexp_replace(plain, rf"(?<=[{LABEL}])\.(?=[{LABEL}])", DOT)
    joined = F.regexp_replace(plain, r"(?<=[0-9])[\x20-](?=[0-9])", DOT)

    def n_digits(x: Column) -> Column:
        return F.length(_digits(x["txt"]))

    return {
        "email": F.when(raw.contains("@"), located(dotted, EMAIL)).otherwise(none),
        "ip": F.when(raw.rlike(r"[0-9]\.[0-9]"), F.filter(located(raw, IP), lambda x: _octets(x["txt"]))).otherwise(none),
        "card": F.when(raw.rlike(r"[0-9][\x20-]?[0-9][\x20-]?[0-9]"), F.filter(located(joined, CARD), lambda x: _luhn(x["txt"]))).otherwise(none),
        "phone": F.when(raw.contains("+"), F.filter(located(raw, PHONE), lambda x: (n_digits(x) >= 9) & (n_digits(x) <= 15))).otherwise(none),
    }


def patterns_of(tokens: Column) -> Column:
    """The context of each token: two words, lowered, without signs and digits, or an empty string."""

    def lead(x: Column, i: Column) -> Column:
        letters = F.trim(F.regexp_replace(F.regexp_replace(F.lower(x["gap"]), r"[^\p{L}\s]", ""), r"\s+", " "))
        alike = (i > 0) & letters.rlike(LISTED)
        return F.when(alike, F.lit("")).otherwise(F.regexp_extract(F.concat(F.when(i > 0, F.lit(INSTANCE + " ")).otherwise(F.lit("")), letters), r"(?:^|\s)(\S+ \S+)$", 1))

    def last(before: Column, mine: Column) -> Column:
        return F.when(mine != "", mine).otherwise(before)

    return running(F.transform(tokens, lead), F.lit(""), last, last, "string", "string")


def occurrences(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, th, base, found): base spans, and the instances with their patterns."""
    raw = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    spans = base_spans(F.col(f"`{text}`"))

    def ranked(x: Column, i: int, k: str) -> Column:
        return F.struct(x["start"].alias("start"), F.lit(i).alias("rank"), x["stop"].alias("stop"), F.lit(k).alias("kind"))

    base = F.concat(*[F.transform(spans[k], _closed(ranked, i, k)) for i, k in enumerate(KINDS)])
    df = df.select(F.col(f"`{key}`").alias("key"), F.xxhash64(raw).alias("th"), raw.alias("raw"), F.array_sort(base).alias("base"))
    tokens = F.when(F.col("raw").rlike("[0-9@]"), located(F.col("raw"), TOKEN)).otherwise(F.array().cast(SPAN))

    def shape(x: Column, pattern: Column, base: Column) -> Column:
        return F.struct(
            (x["start"] + F.length(F.regexp_extract(x["txt"], r"^[\p{P}\p{S}]*+", 0))).alias("start"),
            x["stop"].alias("stop"),
            F.regexp_replace(x["txt"], r"^[\p{P}\p{S}]+|[\p{P}\p{S}]+$", "").alias("inst"),
            pattern.alias("pattern"),
            F.exists(base, lambda b: (b["start"] < x["stop"]) & (x["start"] < b["stop"])).alias("seed"),
        )

    shaped = let(F.col("base"), lambda base: let(tokens, lambda ts: F.zip_with(ts, patterns_of(ts), _closed(shape, base))))
    kept = F.filter(shaped, lambda x: (x["pattern"] != "") & (F.length(_digits(x["inst"])) + F.when(x["inst"].contains("@"), 3).otherwise(0) >= 3))
    return df.select("key", "th", "base", kept.alias("found"))


def score_graph(pairs: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """Patterns (pattern, confidence, support) and instances (inst, score).

    ``pairs`` has (pattern, inst, seed), each pair once. The graph's sides are
    scored in turns; only groupings and equality joins are used.
    """
    known = pairs.groupBy("inst").agg(F.max(F.col("seed").cast("double")).alias("score"))
    patterns = None
    for _ in range(rounds):
        believed = F.when(F.col("score") >= SCORE, F.col("score")).otherwise(0.0)
        patterns = materialize(
            pairs.join(known, "inst").groupBy("pattern")
            .agg((F.sum(believed) / (F.count("*") + 1)).alias("confidence"), F.sum(F.when(F.col("score") >= SCORE, 1).otherwise(0)).alias("support")),
            "patterns",
        )
        doubt = F.when((F.col("confidence") >= CONFIDENCE) & (F.col("support") >= SUPPORT), F.log(1.0 - F.least("confidence", F.lit(0.999)))).otherwise(0.0)
        known = materialize(
            pairs.join(patterns, "pattern").groupBy("inst")
            .agg(F.greatest(F.max(F.col("seed").cast("double")), 1.0 - F.exp(F.sum(doubt))).alias("score")),
            "instances",
        )
    return patterns, known


def detect(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, found array<struct<start,rank,stop,kind>>) for each row, sorted.

    Kinds are the base ones and ``context`` for discovered identifiers.
    """
    rows = materialize(occurrences(df, key, text), "pii")
    occ = rows.select("key", "th", F.explode("found").alias("x")).select("key", "th", "x.*")
    pairs = materialize(occ.groupBy("pattern", F.lower("inst").alias("inst")).agg(F.max("seed").alias("seed")), "pairs")
    patterns, known = score_graph(pairs)
    strong = patterns.where((F.col("confidence") >= CONFIDENCE) & (F.col("support") >= SUPPORT)).select("pattern")
    fresh = (
        occ.where(~F.col("seed")).withColumn("inst", F.lower("inst"))
        .join(known.where(F.col("score") >= SCORE).select("inst"), "inst")
        .join(strong, "pattern", "left_semi")
    )
    # the trimmed token; repeated rows give the same spans once
    new = fresh.groupBy("key", "th").agg(
        F.collect_set(F.struct("start", F.lit(len(KINDS)).alias("rank"), (F.col("start") + F.length("inst")).alias("stop"), F.lit(CONTEXT).alias("kind"))).alias("new")
    )
    new = new.select(F.col("key").alias("k2"), F.col("th").alias("t2"), "new")
    joined = rows.join(new, rows["key"].eqNullSafe(new["k2"]) & (rows["th"] == new["t2"]), "left")
    found = F.when(F.col("new").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "new")))
    return joined.select(F.col("key").alias(key), found.alias("found"))


def digest(found: str = "found") -> dict[str, Column]:
    """Contract columns from a ``found`` column."""
    spans = F.col(found)

    def line(x: Column) -> Column:
        return F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))

    base = F.filter(spans, lambda x: x["rank"] < len(KINDS))
    def is_kind(x: Column, kind: str) -> Column:
        return x["kind"] == kind

    return {f"n_{k}": F.size(F.filter(spans, _closed(is_kind, k))).cast("long") for k in KINDS} | {
        "base_sha256": F.sha2(F.array_join(F.transform(base, line), ","), 256),
        "spans": F.array_join(F.transform(spans, line), ","),
    }
