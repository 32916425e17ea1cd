"""Rule coverage: categories of traces, method matrices, feature tokens, and differences between paired cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepfold.functions import text as X
from stepfold.operators.metrics import relation_stats, variation

# The categories, the rules that explain little, and the rules of three of the categories.
CATEGORIES = ["parser", "object_identity", "precondition", "state_effect", "status_invariant", "payload_invariant", "spec_backed", "tested"]
LOW_CONFIDENCE = ["DEFAULT_PASS", "PARSE_FINAL_COMMAND", "UNEXPECTED_ERROR_STATUS"]
# The categories that apply to each method.
APPLICABLE = {
    "Properties": ["parser", "object_identity", "status_invariant", "payload_invariant", "spec_backed", "tested"],
    "StartSession": ["parser", "object_identity", "precondition", "state_effect", "status_invariant", "payload_invariant", "spec_backed", "tested"],
    "EndSession": ["parser", "precondition", "state_effect", "status_invariant", "payload_invariant", "spec_backed", "tested"],
    "Get": ["parser", "object_identity", "precondition", "status_invariant", "payload_invariant", "spec_backed", "tested"],
    "Set": ["parser", "object_identity", "precondition", "state_effect", "status_invariant", "payload_invariant", "spec_backed", "tested"],
    "Activate": ["parser", "object_identity", "precondition", "state_effect", "status_invariant", "payload_invariant", "spec_backed", "tested"],
    "GenKey": ["parser", "object_identity", "precondition", "state_effect", "status_invariant", "payload_invariant", "spec_backed", "tested"],
    "Read": ["parser", "state_effect", "status_invariant", "payload_invariant", "spec_backed", "tested"],
    "Write": ["parser", "state_effect", "status_invariant", "payload_invariant", "spec_backed", "tested"],
}
# The rules that show a precondition, a status or a payload to be checked.
PRECONDITION_RULES = ["PRECONDITION_EXPECTED_ERROR", "KNOWN_FIELD_INVALID_VALUE", "AUTHORITY_DISABLED_STARTSESSION", "STARTSESSION_FINAL"]
STATUS_RULES = [
    "UNEXPECTED_ERROR_STATUS", "PRECONDITION_EXPECTED_ERROR", "KNOWN_FIELD_EXPECTED_SUCCESS", "KNOWN_FIELD_INVALID_VALUE", "AUTHORITY_DISABLED_STARTSESSION",
    "PROPERTIES_PAYLOAD", "STARTSESSION_FINAL", "ACTIVATE_TARGET", "READ_PAYLOAD", "WRITE_RESPONSE", "LOCKING_DATA_ACCESS", "SET_PAYLOAD", "GET_PAYLOAD", "GENKEY_PAYLOAD", "ENDSESSION_PAYLOAD",
]
PAYLOAD_RULES = [
    "READ_PAYLOAD", "GET_PAYLOAD", "PROPERTIES_PAYLOAD", "STARTSESSION_FINAL", "SET_PAYLOAD", "ENDSESSION_PAYLOAD", "ACTIVATE_PAYLOAD", "WRITE_RESPONSE", "LOCKING_DATA_ACCESS", "GENKEY_PAYLOAD",
]


def _any(items: Column, known: list[str]) -> Column:
    return F.arrays_overlap(items, F.array(*[F.lit(k) for k in known]))


def categories(rules: Column, reads: Column, writes: Column, spec_hits: Column) -> Column:
    """The coverage categories of a trace's rules, reads and writes."""
    held = {
        "parser": F.lit(True), "object_identity": F.exists(reads, lambda r: F.contains(r, F.lit("invoking"))), "precondition": _any(rules, PRECONDITION_RULES),
        "state_effect": F.size(writes) > 0, "status_invariant": _any(rules, STATUS_RULES), "payload_invariant": _any(rules, PAYLOAD_RULES), "spec_backed": spec_hits > 0, "tested": F.lit(True),
    }
    return F.array_compact(F.array(*[F.when(held[c], c) for c in CATEGORIES]))


def trace_columns(verdicts: DataFrame) -> DataFrame:
    """rules, reads, writes and queries of each verdict's trace, distinct, in order."""
    flat = lambda f: X.unique(F.flatten(F.transform("trace", lambda e: e[f])))
    return verdicts.withColumns({"rules": X.unique(F.transform("trace", lambda e: e["rule_id"])), "reads": flat("state_reads"), "writes": flat("state_writes"), "queries": flat("spec_ref_candidates")})


def matrix(cases: DataFrame) -> DataFrame:
    """method, one boolean a category, and the gaps: categories that apply but no case of the method covers."""
    found = cases.groupBy("method").agg(*[F.bool_or(F.array_contains("categories", c)).alias(c) for c in CATEGORIES])
    wanted = F.lit(None).cast("array<string>")
    for m, own in APPLICABLE.items():
        wanted = F.when(F.lower("method") == m.lower(), F.array(*[F.lit(x) for x in own])).otherwise(wanted)
    gaps = F.array_compact(F.array(*[F.when(~F.col(c) & F.array_contains(wanted, c), c) for c in CATEGORIES]))
    return found.withColumn("gaps", F.coalesce(F.array_join(gaps, ","), F.lit("")))


def low_confidence(spec_hits: Column, final_rule: Column, reads: Column) -> Column:
    return (spec_hits == 0) | final_rule.isin(LOW_CONFIDENCE) | (F.size(reads) == 0)


def feature_tokens(method: Column, invoking: Column, kind: Column, status: Column, prediction: Column) -> Column:
    """What the last step alone contributes to a case's features."""
    said = lambda name, x: F.concat(F.lit(f"{name}:"), F.when(x == "", "unknown").otherwise(x))
    return F.array(said("final_method", method), said("final_invoking", invoking), said("final_object_kind", kind), said("final_status", status), F.concat(F.lit("prediction:"), prediction))


def trace_tokens(trace: Column) -> Column:
    """Rules, their transitions, and what they read, write and ask of the specification."""
    rules = F.transform(trace, lambda e: e["rule_id"])
    moves = F.transform(F.sequence(F.lit(1), F.greatest(F.size(rules) - 1, F.lit(1))), lambda i: F.concat(F.lit("rule_transition:"), F.get(rules, i - 1), F.lit("->"), F.get(rules, i)))

    def of(field: str, name: str) -> Column:
        plain = F.flatten(F.transform(trace, lambda e: F.transform(e[field], lambda x: F.concat(F.lit(f"{name}:"), x))))
        paired = F.flatten(F.transform(trace, lambda e: F.transform(e[field], lambda x: F.concat(F.lit(f"rule_{name}:"), e["rule_id"], F.lit(":"), x))))
        return F.concat(plain, paired)

    asked = F.flatten(F.transform(trace, lambda e: F.transform(e["spec_ref_candidates"], lambda x: F.concat(F.lit("spec_query:"), x))))
    return F.array_distinct(F.array_compact(F.concat(F.transform(rules, lambda r: F.concat(F.lit("rule:"), r)), moves, of("state_reads", "read"), of("state_writes", "write"), asked)))


def pair_coverage(pairs: DataFrame, source: str = "source_tokens", follow: str = "follow_tokens") -> DataFrame:
    """Sizes of both feature sets, their union and their symmetric difference, and the latter's share of the union."""
    a, b = F.col(source), F.col(follow)
    d = pairs.withColumns({"union_features": F.array_sort(F.array_union(a, b)), "differential_features": F.array_sort(X.symmetric_difference(a, b))})
    return d.withColumns({
        "source_coverage_size": F.size(a).cast("long"), "followup_coverage_size": F.size(b).cast("long"), "union_coverage_size": F.size("union_features").cast("long"), "mc_size": F.size("differential_features").cast("long"),
        "mc_ratio": F.round(F.coalesce(F.try_divide(F.size("differential_features").cast("double"), F.size("union_features")), F.lit(0.0)), 6),
    })


def summarise_pairs(pairs: DataFrame) -> DataFrame:
    """Statistics of the differences by relation, pairs of identical cases left out."""
    return relation_stats(pairs.where(~F.col("identity_pair")), ["relation"], F.col("mc_size"))


def extremes(stats: DataFrame, high: bool, n: int = 10) -> DataFrame:
    """The relations with the least (or greatest) mean difference."""
    order = [F.desc("mean_size"), F.asc("relation")] if high else [F.asc("mean_size"), F.desc("n"), F.asc("relation")]
    return stats.orderBy(*order).limit(n)


# Relations whose follow-up is compared with another case, with what came before the session, or
# with what came before the last key was generated.
OTHER_CASE = ["known_pin_success", "known_pin_rejected", "wrong_pin_success", "wrong_pin_rejected"]
EARLIER_SESSION = ["startsession_missing_sp_session", "startsession_wrong_host_session", "startsession_wrong_response_method", "malformed_challenge_success"]
BEFORE_KEY = ["read_old_pattern_after_genkey", "read_success_missing_result", "read_wrong_response_command"]


def source_prefixes(mutated: DataFrame, steps: DataFrame) -> DataFrame:
    """name, source_case, n_source: of which case, and how many of its steps, a follow-up case is compared with.

    Mostly the observed case up to the changed step; for some relations a shorter prefix, or the first two
    steps of the first other case, so that both sides differ in what they exercise. steps: case_id,
    step_idx, input.
    """
    key = F.get_json_object("input", "$.method.name") == "GenKey"
    sizes = steps.groupBy("case_id").agg(F.count("*").cast("int").alias("n"), F.array_sort(F.collect_list(F.when(key, F.col("step_idx")))).alias("keys"))
    order = F.struct(X.case_number(F.col("case_id")).alias("k"), "case_id")
    firsts = sizes.select("case_id", "n", order.alias("o")).orderBy("o").limit(2).agg(F.array_sort(F.collect_list(F.struct("o", "case_id", "n"))).alias("firsts"))
    d = mutated.select("name", "source", "relation").join(sizes, F.col("source") == F.col("case_id")).crossJoin(F.broadcast(firsts))  # one row
    other = F.get(F.filter("firsts", lambda f: f["case_id"] != F.col("source")), 0)
    i = F.coalesce(X.trailing_index(F.col("name")), F.col("n"))
    elsewhere = F.col("relation").isin(OTHER_CASE) | F.startswith("relation", F.lit("known_"))
    before = F.array_max(F.filter("keys", lambda k: k < i))
    size = (
        F.when(i >= F.col("n"), F.col("n")).when(elsewhere & other.isNotNull(), F.least(F.lit(2), other["n"])).when(elsewhere, 1)
        .when(F.col("relation").isin(EARLIER_SESSION) & (i >= 2), F.greatest(F.lit(1), i - 1)).when(F.col("relation").isin(BEFORE_KEY), F.coalesce(before, F.lit(1))).otherwise(i + 1)
    )
    return d.select("name", F.when((i < F.col("n")) & elsewhere & other.isNotNull(), other["case_id"]).otherwise(F.col("source")).alias("source_case"), size.cast("int").alias("n_source"))


__all__ = ["categories", "extremes", "feature_tokens", "low_confidence", "matrix", "pair_coverage", "source_prefixes", "summarise_pairs", "trace_columns", "trace_tokens", "variation"]
