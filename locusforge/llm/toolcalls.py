"""Chat formatting: link tool calls with their results, order and validate them, write canonical JSON.

Only DataFrame and SQL functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusforge.llm.frames import scope, settle

#: Types of JSON schema by the leading word of the type that Spark gives a variant.
JSON_TYPES = {
    "BIGINT": "integer", "DECIMAL": "number", "DOUBLE": "number", "FLOAT": "number", "STRING": "string",
    "BOOLEAN": "boolean", "VOID": "null", "ARRAY": "array", "OBJECT": "object",
}


def json_type(value: Column) -> Column:
    """JSON schema type of a variant."""
    head = F.regexp_extract(F.schema_of_variant(value), r"^[A-Z]+", 0)
    return F.element_at(F.create_map(*[F.lit(x) for pair in JSON_TYPES.items() for x in pair]), head)


def canonical_json(text: Column) -> Column:
    """JSON without white space, keys in code point order; null if it isn't one object, array or value."""
    return F.to_json(F.try_parse_json(text))


def argument_errors(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """(conv_id, call_id, errors) of calls whose arguments break the schema of their name.

    ``schemas`` has (name, field, type, required), a field once per type it may
    have. Errors are sorted texts: ``invalid`` (no JSON object), ``unknown
    tool``, ``unknown F``, ``type F``, ``missing F``. One schema is never
    brought to all calls: both sides are joined on the name and the field.
    """
    parsed = calls.select("conv_id", "call_id", "name", F.try_parse_json("arguments").alias("v"))
    is_object = F.coalesce(json_type(F.col("v")) == "object", F.lit(False))
    names = schemas.select("name").distinct().withColumn("known", F.lit(True))
    checked = parsed.join(names, "name", "left").select(
        "conv_id", "call_id", "name", "v", is_object.alias("object"), F.coalesce("known", F.lit(False)).alias("known")
    )
    whole = checked.select(
        "conv_id", "call_id",
        F.explode(F.array_compact(F.array(F.when(~F.col("object"), F.lit("invalid")), F.when(~F.col("known"), F.lit("unknown tool"))))).alias("error"),
    )
    sound = checked.where("object and known")
    # the object's own entries, so that a field may have any name
    entries = calls.sparkSession.tvf.variant_explode(F.col("v").outer()).select(F.col("key").alias("field"), F.col("value").alias("entry"))
    given = sound.lateralJoin(entries).select(
        "conv_id", "call_id", "name", "field", json_type(F.col("entry")).alias("given")
    )
    types = schemas.groupBy("name", "field").agg(F.collect_set("type").alias("types"))
    fits = F.array_contains("types", F.col("given")) | (
        (F.col("given") == "integer") & F.array_contains("types", "number")
    )
    wrong = given.join(types, ["name", "field"], "left").select(
        "conv_id", "call_id",
        F.when(F.col("types").isNull(), F.concat(F.lit("unknown "), "field")).when(~fits, F.concat(F.lit("type "), "field")).alias("error"),
    ).where("error is not null")
    needed = schemas.where("required").select("name", "field").distinct()
    missing = (
        sound.select("conv_id", "call_id", "name")
        .join(needed, "name")
        .join(given.select("conv_id", "call_id", "field"), ["conv_id", "call_id", "field"], "left_anti")
        .select("conv_id", "call_id", F.concat(F.lit("missing "), "field").alias("error"))
    )
    errors = whole.unionByName(wrong).unionByName(missing)
    return errors.groupBy("conv_id", "call_id").agg(F.array_sort(F.collect_set("error")).alias("errors"))


def call_levels(calls: DataFrame, needs: DataFrame) -> DataFrame:
    """(conv_id, call_id, level): 0 for calls that need no other, else one more than the largest level needed.

    Calls that need just one other point to it; pointers are doubled until they
    end at a call that needs none or several, so a chain takes as many rounds as
    its length has binary digits. Then each round places the calls with several
    needs all of which are placed: these rounds are as many as such calls follow
    each other. Calls on a cycle or behind one, or that need an unknown call,
    are not returned. A round reads and writes only ids.
    """
    keys = ["conv_id", "call_id"]
    with scope():
        placed = _placed(calls.select(*keys).distinct(), needs.select(*keys, "needs").distinct(), keys)
        return settle(placed, "levels", outer=True)


def _placed(known: DataFrame, needs: DataFrame, keys: list[str]) -> DataFrame:
    wanted = settle(needs.join(known, keys, "left_semi"), "needs")
    counts = settle(wanted.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), "need_counts")
    done = settle(known.join(counts, keys, "left_anti").withColumn("level", F.lit(0)), "levels")
    chains = _chain_ends(wanted.join(counts.where("n = 1"), keys).select(*keys, F.col("needs").alias("end"), F.lit(1).alias("far")))
    behind = chains.select("conv_id", F.col("call_id").alias("needs"), "end", "far")
    # what calls with several needs wait for, chains left out
    open_ = wanted.join(counts.where("n > 1").select(*keys), keys, "left_semi").join(behind, ["conv_id", "needs"], "left")
    open_ = open_.select(*keys, F.coalesce("end", "needs").alias("end"), (F.coalesce("far", F.lit(0)) + 1).alias("far"))
    open_ = settle(open_.groupBy(*keys, "end").agg(F.max("far").alias("far")), "open_needs")
    found, newest = done, done
    while not newest.isEmpty() and not open_.isEmpty():
        ends = found.select("conv_id", F.col("call_id").alias("end"), "level")
        reached = open_.join(ends, ["conv_id", "end"], "left").groupBy(*keys)
        reached = reached.agg(F.max(F.col("level") + F.col("far")).alias("level"), F.count_if(F.col("level").isNull()).alias("left"))
        newest = settle(reached.where("left = 0").select(*keys, "level"), "levels")
        open_ = settle(open_.join(newest, keys, "left_anti"), "open_needs")
        found = settle(found.unionByName(newest), "levels")
    ends = found.select("conv_id", F.col("call_id").alias("end"), "level")
    along = chains.join(ends, ["conv_id", "end"]).select(*keys, (F.col("level") + F.col("far")).alias("level"))
    return found.unionByName(along)


def _chain_ends(pointers: DataFrame) -> DataFrame:
    """(conv_id, call_id, end, far) of calls with one need: where their chain ends, or some call of their cycle."""
    pointers = settle(pointers, "pointers")
    covered, most = 1, pointers.count()
    while covered <= most:
        next_ = pointers.select("conv_id", F.col("call_id").alias("end"), F.col("end").alias("end2"), F.col("far").alias("far2"))
        joined = pointers.join(next_, ["conv_id", "end"], "left")
        moved = settle(
            joined.select(
                "conv_id", "call_id", F.coalesce("end2", "end").alias("end"), (F.col("far") + F.coalesce("far2", F.lit(0))).alias("far"),
                F.col("end2").isNotNull().alias("moved"),
            ),
            "pointers",
        )
        pointers, covered = moved.drop("moved"), covered * 2
        if moved.where("moved").isEmpty():
            break
    return pointers


def link_calls(calls: DataFrame, results: DataFrame, needs: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per call, and one per result without a call.

    ``calls`` has (conv_id, call_id, turn, name, arguments), ``results``
    (conv_id, call_id, turn, content), ``needs`` (conv_id, call_id, needs). A
    result belongs to the call of its identifier; both are joined on the hash
    of the identifier, never inside a conversation. Returned: conv_id, call_id,
    turn, result_turn, status, level, errors, arguments (canonical) and message
    (the linked pair as canonical JSON, null for stray results).

    Status: ``linked``, ``unanswered`` (no result), ``early`` (result in an
    earlier turn), ``repeated`` (several calls or several results of one
    identifier: the first turn counts, equal turns by the smaller text),
    ``stray`` (result without a call), ``cyclic`` (can't be ordered). A null
    identifier matches nothing: such calls are unanswered and such results
    stray. Null arguments are invalid. Empty tables give an empty one; other
    columns are not read.
    """
    keys = ["conv_id", "call_id"]
    one_call = F.min(F.struct("turn", "name", "arguments"))
    whole = F.col("call_id").isNotNull() & F.col("conv_id").isNotNull()
    first_call = calls.where(whole).groupBy(*keys).agg(one_call.alias("c"), F.count(F.lit(1)).alias("n_calls"))
    loose = calls.where(~whole).select(*keys, F.struct("turn", "name", "arguments").alias("c"), F.lit(1).cast("long").alias("n_calls"))
    unique = first_call.select(*keys, "c.*", "n_calls")
    answers = results.where(whole).groupBy(*keys).agg(
        F.min(F.struct("turn", "content")).alias("r"), F.count(F.lit(1)).alias("n_results")
    )
    stray = results.where(~whole).select(*keys, F.struct("turn", "content").alias("r"), F.lit(1).cast("long").alias("n_results"))
    levels = call_levels(unique, needs)
    errors = argument_errors(unique, schemas)
    joined = (
        first_call.join(answers, keys, "full")
        .join(levels, keys, "left")
        .join(errors, keys, "left")
        .unionByName(loose, allowMissingColumns=True)
        .unionByName(stray, allowMissingColumns=True)
    )
    status = (
        F.when(F.col("c").isNull(), "stray")
        .when((F.col("n_calls") > 1) | (F.col("n_results") > 1), "repeated")
        .when(F.col("level").isNull() & whole, "cyclic")
        .when(F.col("r").isNull(), "unanswered")
        .when(F.col("r.turn") < F.col("c.turn"), "early")
        .otherwise("linked")
    )
    arguments = canonical_json(F.col("c.arguments"))
    loose_errors = F.when(whole | F.col("c").isNull(), F.array().cast("array<string>")).otherwise(F.array(F.lit("no identifier")))
    quoted = F.struct(
        F.col("call_id").alias("id"), F.col("c.name").alias("name"), F.col("r.content").alias("result"), F.col("c.turn").alias("turn")
    )
    message = F.concat(
        F.lit('{"arguments":'), F.coalesce(arguments, F.lit("null")), F.lit(","), F.substring(F.to_json(quoted), 2, 1 << 30)
    )
    return joined.select(
        *keys,
        F.col("c.turn").alias("turn"),
        F.col("r.turn").alias("result_turn"),
        status.alias("status"),
        "level",
        F.coalesce("errors", loose_errors).alias("errors"),
        arguments.alias("arguments"),
        F.when(F.col("c").isNotNull(), message).alias("message"),
    )
