"""Row routing: policies, splits, sampling, payload contracts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.common import HASH_BUCKETS, all_of, any_of, hash_bucket

Policy = Mapping[str, Sequence[str]]


def filter_policy_route(df: DataFrame, policies: Mapping[str, Policy | None]) -> DataFrame:
    """One row per (subscriber, event) whose policy accepts the event.

    A policy maps attribute to allowed values and every attribute must match; no
    policy accepts all. Policies compile to predicates, so there is no join.
    """
    hits = []
    for subscriber, policy in policies.items():
        accepts = all_of([F.col(a).cast("string").isin(list(v)) for a, v in (policy or {}).items()])
        hits.append(F.when(accepts, F.lit(subscriber)))
    return df.withColumn("subscriber", F.explode(F.array_compact(F.array(*hits))))


def policy_table_route(
    events: DataFrame, policies: DataFrame, event_id: str, attributes: Sequence[str], spread: int = 16
) -> DataFrame:
    """(subscriber, event id) as :func:`filter_policy_route`, for policies that are a table of any size.

    ``policies``: (subscriber, attribute, value) rows, one per allowed value; a subscriber with a row whose attribute is NULL
    accepts all. Each policy is posted under the values of one attribute only, the one that the fewest events meet.
    Events look up their (attribute, value) pairs in these postings by an equi-join, and what a policy asks of other attributes
    is tested on the candidate. So the candidates are bounded by the rarest condition of each
    policy, and a plan is the same for one policy or a million. Postings of all-accepting policies are
    spread over ``spread`` keys, those of a hot pair are split by adaptive execution. Attributes compare as text.
    """
    text = {a: F.col(a).cast("string") for a in attributes}
    pairs = F.array(*[F.struct(F.lit(a).alias("attribute"), v.alias("value")) for a, v in text.items()])
    asked = events.select(
        event_id, F.map_from_arrays(F.array(*[F.lit(a) for a in attributes]), F.array(*text.values())).alias("_has"), F.explode(
            F.concat(pairs, F.array(F.struct(
                F.lit("").alias("attribute"), F.pmod(F.xxhash64(event_id), F.lit(spread)).cast("string").alias("value"))))).alias("p"),
    ).where(F.col("p.value").isNotNull()).select(event_id, "_has", "p.attribute", "p.value")
    met = asked.where("attribute <> ''").groupBy("attribute", "value").agg(F.count(F.lit(1)).alias("_met"))

    open_to_all = policies.where(F.col("attribute").isNull()).select("subscriber").distinct()
    stated = policies.where(F.col("attribute").isNotNull()).distinct()
    weighed = stated.join(met, ["attribute", "value"], "left").groupBy("subscriber", "attribute").agg(
        F.collect_set("value").alias("values"), F.sum(F.coalesce("_met", F.lit(0))).alias("_met"))
    # One row per policy; it holds what the policy says, as a message does.
    whole = weighed.groupBy("subscriber").agg(
        F.min_by("attribute", F.struct("_met", "attribute")).alias("pivot"),
        F.collect_list(F.struct("attribute", "values")).alias("conditions"))
    others = F.filter("conditions", lambda c: c["attribute"] != F.col("pivot"))
    own = F.flatten(F.transform(F.filter("conditions", lambda c: c["attribute"] == F.col("pivot")), lambda c: c["values"]))
    posted = whole.select(
        "subscriber", F.col("pivot").alias("attribute"), F.explode(own).alias("value"), others.alias("rest"))
    all_posted = open_to_all.select(
        "subscriber", F.lit("").alias("attribute"), F.explode(F.sequence(F.lit(0), F.lit(spread - 1)).cast("array<string>")).alias("value"),
        F.array().cast(posted.schema["rest"].dataType).alias("rest"))
    fits = F.forall("rest", lambda c: F.coalesce(F.array_contains(c["values"], F.try_element_at("_has", c["attribute"])), F.lit(False)))
    return asked.join(posted.unionByName(all_posted), ["attribute", "value"]).where(fits).select("subscriber", event_id)


def choice_route(df: DataFrame, accepted: Column, yes: str, no: str, column: str = "route") -> DataFrame:
    """Two-way choice; a NULL test takes the ``no`` branch."""
    return df.withColumn(column, F.when(accepted, F.lit(yes)).otherwise(F.lit(no)))


def hash_sample(df: DataFrame, key: str, percent: float) -> DataFrame:
    """Keep ``percent`` % of the keys, always the same ones; narrow, no shuffle."""
    return df.where(hash_bucket(F.col(key)) < round(percent * HASH_BUCKETS / 100))


def traffic_split(df: DataFrame, key: str, weights: Mapping[str, float], column: str = "variant") -> DataFrame:
    """Assign each key to a variant by cumulative weights over its hash bucket."""
    total = float(sum(weights.values()))
    bucket, edge, chosen = hash_bucket(F.col(key)), 0.0, None
    names = list(weights)
    for name in names[:-1]:
        edge += weights[name] / total
        test = bucket < round(edge * HASH_BUCKETS)
        chosen = F.when(test, F.lit(name)) if chosen is None else chosen.when(test, F.lit(name))
    last = F.lit(names[-1])
    return df.withColumn(column, last if chosen is None else chosen.otherwise(last))


def validate_payload(
    df: DataFrame, body: str, schema: T.StructType | str, max_bytes: int, required: Sequence[str] = ()
) -> DataFrame:
    """Check a JSON body: size cap, declared property types, required properties."""
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    corrupt = "_corrupt"
    full = T.StructType([*schema.fields, T.StructField(corrupt, T.StringType())])
    parsed = F.from_json(body, full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt})
    missing = any_of([F.col(f"_parsed.{c}").isNull() for c in required]) if required else F.lit(False)
    status = (
        F.when(F.col(body).isNull(), "missing")
        .when(F.octet_length(body) > max_bytes, "too_large")
        .when(F.col(f"_parsed.{corrupt}").isNotNull(), "invalid")
        .when(missing, "invalid")
        .otherwise("valid")
    )
    return df.withColumn("_parsed", parsed).withColumn("status", status).drop("_parsed")


def contract_errors(df: DataFrame, contract: Mapping[str, str]) -> DataFrame:
    """Add ``contract_error``: names of columns that are absent or do not cast."""
    checks = []
    for column, type_name in contract.items():
        if column not in df.columns:
            checks.append(F.lit(column))
        else:
            bad = F.col(column).isNotNull() & F.expr(f"try_cast(`{column}` as {type_name})").isNull()
            checks.append(F.when(bad, F.lit(column)))
    joined = F.concat_ws(",", F.array_compact(F.array(*checks)))
    return df.withColumn("contract_error", F.when(joined != "", joined))


def block_countries(df: DataFrame, column: str, blocked: Sequence[str] = ()) -> DataFrame:
    """Drop rows of blocked countries; nothing is blocked by default."""
    if not blocked:
        return df
    return df.where(F.col(column).isNull() | ~F.col(column).isin(list(blocked)))


def lookbacks(df: DataFrame, ts: str, as_of: str, spans: Mapping[str, str]) -> DataFrame:
    """One row per (row, span) with ``ts`` in the span before ``as_of``.

    The widest span is also a plain filter, so it reaches the scan.
    """
    now = F.lit(as_of).cast("timestamp_ntz")
    within = {n: F.col(ts) >= now - F.expr(f"interval {s}") for n, s in spans.items()}
    labels = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in within.items()]))
    return (
        df.where((F.col(ts) < now) & any_of(list(within.values())))
        .withColumn("lookback", F.explode(labels))
    )
