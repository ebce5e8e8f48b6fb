"""Secret scan: a trigram inverted index names the texts a rule has to be run on.

Only DataFrame functions are used: the index, the intersection of postings and
the search for spans all run in the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusforge.llm.frames import fresh, plain_text, settle
from locusforge.llm.trigrams import trigram_query


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its pattern, and the least length of the given group."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


BASE = (
    # the whole key and value are matched before short values are dropped, so that they hide what they cover
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    # maximal runs: a shorter run can't start a longer match inside itself
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
_KEY = r"(?:[A-Z]+ ){0,3}PRIVATE KEY(?: BLOCK)?-----"
#: What stands between lines of a key, also in quoted or escaped ones. Possessive repeats take no stack in the JVM.
_GAP = r"""(?:[\s"'+,>#]|\\[rnt])*+"""
_HEADS = rf"(?:{_GAP}[A-Z][A-Za-z]*(?:-[A-Z][A-Za-z]*)?:\x20[^\r\n\\]*+)*+"
_BODY = rf"(?:{_GAP}[A-Za-z0-9+/]{{24,}}+={{0,2}})*+"
_LAST = rf"""(?:{_GAP}[A-Za-z0-9+/]+={{0,2}}(?=[\x20\t"',]*(?:[\r\n\\]|$)))?"""
EXTRA = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("gitlab", r"glpat-[A-Za-z0-9_-]{20,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    # the whole key: up to its END line, or, before the next BEGIN, header lines and lines of base64 as far as they go
    Rule("private_key", f"-----BEGIN {_KEY}(?:(?:(?!-----BEGIN )[\\s\\S])*?-----END {_KEY}|{_HEADS}{_BODY}{_LAST})"),
)
RULES = (*BASE, *EXTRA)


def postings(docs: DataFrame, trigrams: Sequence[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """The inverted index: a (trigram, key) row for each of the given trigrams that a lowered text holds."""
    low = fresh(docs.columns, "low")
    held = F.array_compact(F.array(*[F.when(F.col(low).contains(t), F.lit(t)) for t in trigrams]))
    lowered = docs.select(F.col(key).alias("key"), F.lower(F.col(text)).alias(low))
    return lowered.select(F.explode(held).alias("trigram"), "key")


def candidates(index: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(key, kinds): the rules for one of whose alternatives the postings of all trigrams hold the key."""
    needs = [
        (rule.kind, n, t, len(way)) for rule in rules for n, way in enumerate(trigram_query(rule.pattern)) for t in sorted(way)
    ]
    wanted = index.sparkSession.createDataFrame(needs, "kind string, way int, trigram string, need int")
    met = (
        index.join(F.broadcast(wanted), "trigram")  # as many rows as the rules have trigrams
        .groupBy("key", "kind", "way", "need")
        .agg(F.count_distinct("trigram").alias("n"))
        .where("n = need")
    )
    return met.groupBy("key").agg(F.collect_set("kind").alias("kinds"))


def rule_spans(text: Column, rule: Rule, order: int) -> Column:
    """Array of (start, order, end, kind) of a rule's matches, in code points.

    The pieces between matches and the matches themselves tile the text, so
    their lengths add up to the places.
    """
    pieces, hits = F.split(text, rule.pattern, -1), F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    parts = F.zip_with(
        F.slice(pieces, 1, F.size(hits)),
        F.arrays_zip(hits.alias("hit"), values.alias("value")),
        lambda piece, match: F.struct(
            F.length(piece).cast("long").alias("gap"),
            F.length(match["hit"]).cast("long").alias("n"),
            (F.length(match["value"]) >= rule.least).alias("ok"),
        ),
    )
    shape = "array<struct<start:bigint,order:int,end:bigint,kind:string>>"
    none = F.array().cast(shape)
    start = F.struct(F.lit(0).cast("long").alias("at"), none.alias("spans"))

    def step(acc: Column, part: Column) -> Column:
        first = acc["at"] + part["gap"]
        span = F.struct(first.alias("start"), F.lit(order).alias("order"), (first + part["n"]).alias("end"), F.lit(rule.kind).alias("kind"))
        return F.struct(
            (first + part["n"]).alias("at"),
            F.when(part["ok"], F.concat(acc["spans"], F.array(span).cast(shape))).otherwise(acc["spans"]).alias("spans"),
        )

    return F.aggregate(parts, start, step, lambda acc: acc["spans"])


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """The rows of ``docs`` with ``spans``: (start, order, end, kind) by start, then by the order of rules.

    A rule with mandatory trigrams is run on the texts that the index names,
    one without them on every text; either way a rule is run on the whole text.
    A null text is taken as empty and has no spans. Rows of one key, null too,
    are looked at each on its own. Other columns are kept as they are.
    """
    indexed = [r for r in rules if trigram_query(r.pattern)]
    grams = sorted({t for r in indexed for way in trigram_query(r.pattern) for t in way})
    kinds, other = fresh(docs.columns, "kinds"), fresh(docs.columns, "key")
    rows = docs
    if grams:
        named = settle(candidates(postings(docs, grams, key, text), indexed), "secret_candidates")
        named = named.select(F.col("key").alias(other), F.col("kinds").alias(kinds))
        rows = docs.join(named, F.col(key).eqNullSafe(F.col(other)), "left").drop(other)
    else:
        rows = docs.withColumn(kinds, F.array().cast("array<string>"))
    whole = plain_text(text)
    found = []
    for order, rule in enumerate(rules):
        probe = whole.rlike(rule.pattern)
        if rule in indexed:
            probe = F.coalesce(F.array_contains(kinds, rule.kind), F.lit(False)) & probe
        found.append(F.when(probe, rule_spans(whole, rule, order)).otherwise(F.array()))
    return rows.withColumn("spans", F.array_sort(F.concat(*found))).drop(kinds)


def spans_text(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """``docs`` with every found span replaced by its kind in brackets; overlapping spans become one.

    ``n_chars``, if there, is counted anew for changed texts.
    """
    name = fresh(docs.columns, "found")
    clash = "spans" in {c.lower() for c in docs.columns}
    held = docs.withColumnRenamed("spans", fresh(docs.columns, "kept_spans")) if clash else docs
    found = find_secrets(held, text=text, rules=rules).withColumnRenamed("spans", name)
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    whole = plain_text(text)

    def step(acc: Column, span: Column) -> Column:
        before = F.substring(whole, (acc["at"] + 1).cast("int"), (span["start"] - acc["at"]).cast("int"))
        fresh_span = F.concat(acc["out"], before, F.lit("["), span["kind"], F.lit("]"))
        return F.struct(
            F.greatest(acc["at"], span["end"]).alias("at"),
            F.when(span["start"] >= acc["at"], fresh_span).otherwise(acc["out"]).alias("out"),
        )

    masked = F.aggregate(
        name, start, step, lambda acc: F.concat(acc["out"], F.substring(whole, (acc["at"] + 1).cast("int"), F.length(whole)))
    )
    changed = F.size(name) > 0
    out = found.withColumn(text, F.when(changed, masked).otherwise(F.col(text)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(changed, F.length(text).cast("long")).otherwise(F.col("n_chars")))
    out = out.drop(name)
    return out.withColumnRenamed(fresh(docs.columns, "kept_spans"), "spans") if clash else out
