"""The event-log engine: accessors, fold and cascade on fixtures, generators, reports, and streaming against batch."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

from stepfold.functions import render
from stepfold.functions import text as X
from stepfold.functions import tokens as K
from stepfold.generate import families, mutations
from stepfold.operators import coverage, fold
from stepfold.operators.normalise import normalise
from stepfold.plans import verdict
from stepfold.plans.queries import QUERIES, SQL
from stepfold.sources import reports, trajectories

RANGE = ("Locking_Range1", "00 00 08 02 00 03 00 01")
PIN = ("C_PIN_SID", "00 00 00 0B 00 00 00 01")
IDS = {"HostSessionID": "00000001", "SPSessionID": "00001001"}


def start(status="SUCCESS", word=None, ids=IDS, reply="SyncSession"):
    command = {"method": {"name": "StartSession", "args": {"required": {"HostSessionID": 1, "SPID": "0000020500000001", "Write": 1}, "optional": {"HostChallenge": word} if word else {}}}, "invoking_id": {"uid": "00 00 00 00 00 00 00 FF", "name": "Session Manager UID"}}
    good = {"method": {"name": reply}, "return_values": {"required": ids}} if status == "SUCCESS" else {"return_values": []}
    return {"input": command, "output": {"status_codes": status, **good}}


def call(name, target, status, required=None, returned=()):
    return {"input": {"method": {"name": name, "args": {"required": required or {}, "optional": {}}}, "invoking_id": {"uid": target[1], "name": target[0]}}, "output": {"status_codes": status, "return_values": list(returned)}}


def data(command, args, returned=None, status=None, reply=None):
    return {"input": {"command": command, "args": args}, "output": {"command": reply or command, "args": returned or {}} | ({"status_codes": status} if status else {})}


def properties(returned, name="Session Manager UID", uid="00 00 00 00 00 00 00 FF"):
    return {"input": {"method": {"name": "Properties"}, "invoking_id": {"uid": uid, "name": name}}, "output": {"return_values": returned, "status_codes": "SUCCESS"}}


def setting(cells, target=RANGE, status="SUCCESS", **more):
    return call("Set", target, status, {"Values": cells}, **more)


def block(a, b=None, split=True):
    cells = [{"startColumn": a}, {"endColumn": b}] if split else [{"startColumn": a, "endColumn": b}]
    return {"Cellblock": cells if b is not None else cells[:1]}


KEY, SP = ("K_AES", "00 00 08 06 00 03 00 01"), ("SP_Locking", "00 00 02 05 00 00 00 02")
END = {"input": {"method": {"name": "EndSession"}, "SessionID": 1}, "output": {"status_codes": "SUCCESS", "return_values": []}}
WROTE = data("Write", {"LBA": "0", "pattern": "8E"})
LOCKED = [start(), setting([{"5": 1, "7": 1}])]
CASES = {
    "empty": ([], "fail", "PARSE_FINAL_COMMAND"),
    "unknown_status": ([call("Get", RANGE, "SP_BUSY")], "fail", "PARSE_FINAL_COMMAND"),
    "props_ok": ([properties([{"Properties": {"MaxMethods": 1}}])], "pass", "PROPERTIES_PAYLOAD"),
    "props_no_payload": ([properties([])], "fail", "PROPERTIES_PAYLOAD"),
    "props_wrong_target": ([properties([{"MaxMethods": 1}], "SP", "00 00 02 05 00 00 00 02")], "fail", "PROPERTIES_TARGET"),
    "start_ok": ([start()], "pass", "STARTSESSION_FINAL"),
    "start_no_sp_id": ([start(ids={"HostSessionID": "00000001"})], "fail", "STARTSESSION_FINAL"),
    "start_wrong_echo": ([start(ids={"HostSessionID": "2", "SPSessionID": "3"})], "fail", "STARTSESSION_FINAL"),
    "start_wrong_reply": ([start(reply="Get")], "fail", "STARTSESSION_FINAL"),
    "known_pin_rejected": ([start(), setting([{"3": "secretpin"}], PIN), start("NOT_AUTHORIZED", "secretpin")], "fail", "STARTSESSION_FINAL"),
    "wrong_pin_rejected": ([start(), setting([{"3": "secretpin"}], PIN), start("NOT_AUTHORIZED", "otherpin")], "pass", "STARTSESSION_FINAL"),
    "malformed_challenge_success": ([start(word="a" * 33)], "fail", "STARTSESSION_FINAL"),
    "get_no_session_ok": ([call("Get", RANGE, "SUCCESS", returned=[{"3": 1}])], "fail", "PRECONDITION_EXPECTED_ERROR"),
    "get_no_session_rejected": ([call("Get", RANGE, "NOT_AUTHORIZED")], "pass", "PRECONDITION_EXPECTED_ERROR"),
    "get_reversed_same_dict": ([start(), call("Get", RANGE, "SUCCESS", block(5, 3, split=False))], "fail", "PRECONDITION_EXPECTED_ERROR"),
    "get_reversed_split_dict": ([start(), call("Get", RANGE, "SUCCESS", block(5, 3))], "pass", "GET_PAYLOAD"),
    "get_partial": ([start(), call("Get", RANGE, "SUCCESS", block(3, 5), [[{"3": 1}]])], "fail", "GET_PAYLOAD"),
    "get_full": ([start(), call("Get", RANGE, "SUCCESS", block(3, 5), [[{"3": 1, "4": 2, "5": 0}]])], "pass", "GET_PAYLOAD"),
    "get_stale": ([start(), setting([{"3": 7}]), call("Get", RANGE, "SUCCESS", block(3, 3), [[{"3": 1}]])], "fail", "GET_PAYLOAD"),
    "set_twice": ([start(), setting([{"5": 1}, {"5": 0}])], "fail", "PRECONDITION_EXPECTED_ERROR"),
    "set_bad_bool": ([start(), setting([{"5": 2}])], "fail", "KNOWN_FIELD_INVALID_VALUE"),
    "set_bad_bool_rejected": ([start(), setting([{"5": 2}], status="INVALID_PARAMETER")], "pass", "KNOWN_FIELD_INVALID_VALUE"),
    "set_nonempty": ([start(), setting([{"3": 2}], returned=[{"x": 1}])], "fail", "SET_PAYLOAD"),
    "known_field_error": ([start(), call("Get", RANGE, "FAIL", block(3, 5))], "fail", "KNOWN_FIELD_EXPECTED_SUCCESS"),
    "unknown_field_error": ([start(), call("Get", ("ACE", "00 00 00 08 00 00 00 01"), "FAIL", block(3, 5))], "fail", "UNEXPECTED_ERROR_STATUS"),
    "activate_wrong": ([start(), call("Activate", KEY, "SUCCESS")], "fail", "PRECONDITION_EXPECTED_ERROR"),
    "activate_nonempty": ([start(), call("Activate", SP, "SUCCESS", returned=[{"x": 1}])], "fail", "ACTIVATE_PAYLOAD"),
    "activate_ok": ([start(), call("Activate", SP, "SUCCESS")], "pass", "ACTIVATE_PAYLOAD"),
    "read_locked_ok": ([*LOCKED, data("Read", {"LBA": "0"}, {"result": "x"})], "fail", "LOCKING_DATA_ACCESS"),
    "read_locked_fail": ([*LOCKED, data("Read", {"LBA": "0"}, status="FAIL")], "pass", "LOCKING_DATA_ACCESS"),
    "read_mismatch": ([WROTE, data("Read", {"LBA": "0"}, {"result": "FF11"})], "fail", "READ_PAYLOAD"),
    "read_match": ([WROTE, data("Read", {"LBA": "0"}, {"result": "Pattern 8E"})], "pass", "READ_PAYLOAD"),
    "read_after_genkey_old": ([start(), WROTE, call("GenKey", KEY, "SUCCESS"), data("Read", {"LBA": "0"}, {"result": "Pattern 8E"})], "fail", "READ_PAYLOAD"),
    "read_after_genkey_new": ([start(), WROTE, call("GenKey", KEY, "SUCCESS"), data("Read", {"LBA": "0"}, {"result": "Random Data"})], "pass", "READ_PAYLOAD"),
    "read_other_reply": ([data("Read", {"LBA": "0"}, {"result": "abc"}, reply="Write")], "fail", "READ_PAYLOAD"),
    "write_no_payload": ([data("Write", {"LBA": "0"})], "fail", "WRITE_RESPONSE"),
    "write_ok": ([WROTE], "pass", "WRITE_RESPONSE"),
    "genkey_nonempty": ([start(), call("GenKey", KEY, "SUCCESS", returned=[{"k": "v"}])], "fail", "GENKEY_PAYLOAD"),
    "end_with_other_text": ([start(), END, call("Get", RANGE, "SUCCESS", block(3), [[{"3": 1}]])], "pass", "GET_PAYLOAD"),
    "auth_no_session": ([call("Authenticate", PIN, "SUCCESS", returned=[True])], "fail", "AUTHENTICATE_NO_SESSION"),
    "auth_ok": ([start(), call("Authenticate", PIN, "SUCCESS", returned=[True])], "pass", "AUTHENTICATE_SUCCESS"),
    "auth_error": ([start(), call("Authenticate", PIN, "NOT_AUTHORIZED")], "pass", "DEFAULT_PASS"),
}


@pytest.fixture(scope="module")
def cases(spark):
    return spark.createDataFrame([(k, json.dumps(v[0])) for k, v in CASES.items()], "case_id string, raw string")


@pytest.fixture(scope="module")
def steps(cases):
    return trajectories.steps_of(cases).cache()


def test_fixture_verdicts(cases, steps):
    got = {r["case_id"]: (r["prediction"], r["final_rule_id"]) for r in verdict.with_empty_cases(verdict.verify(steps), cases).collect()}
    assert got == {k: (p, rule) for k, (_, p, rule) in CASES.items()}


def test_trace_follows_the_steps(steps):
    t = {r["case_id"]: r["trace"] for r in verdict.verify(steps, with_trace=True).where("case_id in ('read_after_genkey_old', 'activate_ok', 'known_pin_rejected')").collect()}
    assert [(e["step"], e["rule_id"]) for e in t["read_after_genkey_old"]] == [(0, "STARTSESSION_EFFECT"), (1, "WRITE_PAYLOAD_EFFECT"), (2, "GENKEY_EFFECT"), (3, "READ_PAYLOAD")]
    assert [e["rule_id"] for e in t["activate_ok"]] == ["STARTSESSION_EFFECT", "ACTIVATE_TARGET", "ACTIVATE_PAYLOAD"]
    assert [e["rule_id"] for e in t["known_pin_rejected"]] == ["STARTSESSION_EFFECT", "SET_CPIN_SECRET", "SET_OBJECT_FIELDS", "STARTSESSION_FINAL"]
    assert t["read_after_genkey_old"][3]["spec_ref_candidates"] == ["Read LBA result GenKey"]


def test_mutants(steps):
    r = {x["mutant_id"]: x for x in verdict.mutation_report(verdict.verify(steps), verdict.mutants(steps)).collect()}
    assert len(r) == 13 and r["NO_READ_PAYLOAD"]["n_changed"] == 3 and not r["NO_DISABLED_AUTHORITY"]["killed"]
    assert all(x["killed"] for k, x in r.items() if k != "NO_DISABLED_AUTHORITY")


def test_ensemble(spark):
    v = spark.createDataFrame([("a", "pass", "X"), ("b", "fail", "UNEXPECTED_ERROR_STATUS"), ("c", "fail", "GET_PAYLOAD"), ("d", "pass", "X")], "case_id string, prediction string, final_rule_id string")
    m = spark.createDataFrame([("a", "fail"), ("b", "pass"), ("c", "pass")], "case_id string, model string")
    assert {r["case_id"]: r["prediction"] for r in verdict.ensemble(v, m).collect()} == {"a": "fail", "b": "pass", "c": "fail", "d": "pass"}


def test_scorer_that_cannot_load(spark):
    p = spark.createDataFrame([("a", "x")], "case_id string, prompt string")

    def broken():
        raise OSError

    assert verdict.score(p, broken).count() == 0
    assert verdict.score(p, lambda: lambda xs: [("fail", 0.7) for _ in xs]).first()["model"] == "fail"


def test_search_order(spark):
    docs = {
        "own keys first": ('{"a": {"name": 1}, "name": 2}', "2"), "then values in order": ('{"a": {"b": {"name": 1}}, "c": {"name": 2}}', "1"), "null hides an object": ('{"a": {"name": null, "x": {"name": 5}}, "b": {"name": 6}}', "6"),
        "lists": ('[{"x": 1}, {"Name": "z"}]', "z"), "first of a node": ('{"name": 3, "NAME": 4}', "3"), "none": ('{"names": 1}', None), "no json": ("{", None),
    }
    d = spark.createDataFrame([(k, t) for k, (t, _) in docs.items()], "k string, t string").withColumn("t", K.tokens(F.col("t")))
    assert {r["k"]: r["v"] for r in d.select("k", K.first(F.col("t"), "name")["text"].alias("v")).collect()} == {k: v for k, (_, v) in docs.items()}


def test_strings_cells_and_ranges(spark):
    t = '{"b": ["x", {"7": 1, "k": {"7": 2}}], "a": "y  z", "c": {"startColumn": 2}, "d": {"endColumn": 4}, "9": {"1": 5}}'
    d = spark.createDataFrame([(t,)], "t string").withColumn("t", K.tokens(F.col("t")))
    r = d.select(K.strings(F.col("t")).alias("s"), K.cells(F.col("t")).alias("c"), K.requested_columns(F.col("t")).alias("q")).first()
    assert r["s"] == ["b", "a", "c", "d", "9", "x", "7", "k", "7", "y z", "startColumn", "endColumn", "1"]
    assert {(c["column"], c["text"]) for c in r["c"]} == {("7", "2"), ("9", "{'1': 5}")} and r["q"] == ["2", "3", "4"]


def test_values(spark):
    d = spark.createDataFrame([("1", "00000001", True), ("0x1f", "1F", True), ("g", "g", True), ("", "", False), ("a", "b", False)], "a string, b string, same boolean")
    assert d.where(X.ids_equivalent(F.col("a"), F.col("b")) != F.col("same")).count() == 0
    c = spark.createDataFrame([("", False), ("abcd", True), ("a" * 64, False), ("xyz", True), ("wxyz", False)], "c string, bad boolean")
    assert c.where(X.challenge_malformed(F.col("c")) != F.col("bad")).count() == 0


def test_containers(spark):
    raw = spark.createDataFrame([('[{"id": "x", "steps": []}, [1], {"id": "x", "steps": [{"input": {}, "output": {}}]}]',)], "raw string")
    assert {r["case_id"]: r["raw"] for r in trajectories.cases_from_json(raw).collect()} == {"x": '[{"input": {}, "output": {}}]', "case_1": "[1]"}
    nested = spark.createDataFrame([('{"testcases": [], "data": {"b": [2], "a": [1]}}',)], "raw string")
    assert [r["raw"] for r in trajectories.cases_from_json(nested, nested=True).orderBy("position").collect()] == ["[1]", "[2]"]
    odd = spark.createDataFrame([("r", '{"records": [1, {"input": 3}, null, {"output": {"a": 1}}]}'), ("n", "7"), ("z", None)], "case_id string, raw string")
    assert [(r["case_id"], r["step_idx"], r["input"], r["output"]) for r in trajectories.steps_of(odd).collect()] == [("r", 0, "{}", "{}"), ("r", 1, "{}", '{"a": 1}')]


def test_files(spark, tmp_path, cases, steps):
    folder = tmp_path / "testcases"
    folder.mkdir()
    for n in (10, 2):
        (folder / f"tc{n}_x.json").write_text(json.dumps(CASES["start_ok"][0]))
    (tmp_path / "label.jsonl").write_text('{"filename": "tc2_x.json", "label": " Pass "}\n\n')
    (tmp_path / "a.txt").write_text("StartSession HOSTSESSIONID")
    got = trajectories.read_cases(spark, str(folder)).orderBy("position")
    assert [r["case_id"] for r in got.collect()] == ["tc2_x.json", "tc10_x.json"]
    labels = trajectories.read_labels(spark, str(tmp_path / "label.jsonl"))
    joined = trajectories.labelled(got, labels)
    assert [(r["case_id"], r["label"]) for r in joined.collect()] == [("tc2_x.json", "pass")]
    texts = trajectories.read_spec_texts(spark, str(tmp_path))
    assert [(r["path"], r["text"]) for r in texts.collect()] == [("a.txt", "startsession hostsessionid")]
    s = trajectories.steps_of(joined)
    out = reports.case_summaries(normalise(s), verdict.verify(s, with_trace=True), joined.select("case_id", "label"), texts).cache()
    row = out.first()
    assert row["correct"] and row["spec_hits"] == ["a.txt"] and row["receptive_field"] == ["StartSession(Session Manager UID) -> success"]
    reports.write_jsonl(out, str(tmp_path / "out"))
    reports.append_results(out, str(tmp_path / "log"))
    reports.rotate_results(spark, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log.bak")).count() == spark.read.json(str(tmp_path / "out")).count() == 1
    lines = [r["value"] for r in reports.markdown(out, "Report").collect()]
    assert lines[0] == "# Report" and "| StartSession | 1 | 1 | 100.0 |" in lines
    assert reports.mismatches(out).count() == 0 and reports.brief(out).first()["value"] == "score=100.00 correct=1 total=1 mismatches=0"
    wrong = out.withColumns({"correct": F.lit(False), "rule_ids": F.array(*[F.lit(f"R{i}") for i in range(6)])})
    assert reports.mismatches(wrong).first()["rules"] == "R2, R3, R4, R5"
    assert any(r["value"].startswith("| tc2_x.json | pass | pass | StartSession / Session Manager UID | success | R2, R3") for r in reports.markdown(wrong, "x").collect())
    assert json.loads(reports.json_report(out.groupBy().count(), cases=out.select("case_id")).first()["value"])["cases"] == [{"case_id": "tc2_x.json"}]


def test_families_and_their_split(spark):
    f = families.families(spark).cache()
    assert f.count() == f.select("case_id").distinct().count() == 1415
    assert {r["label"]: r["count"] for r in f.groupBy("label").count().collect()} == {"pass": 778, "fail": 637}
    assert {r["split"]: r["count"] for r in families.split(f).groupBy("split").count().collect()} == {"train": 849, "val": 283, "test": 283}
    assert f.select(F.explode("steps").alias("s")).where("try_parse_json(s.input) is null or try_parse_json(s.output) is null").count() == 0


def test_strings_as_payloads_are_rendered(spark):
    odd = [("s", {"output": {"status": "SUCCESS", "payload": "Pattern 8E"}, "input": {"method": {"name": "Read", "args": "all"}}}, "args=all", "payload=Pattern 8E"), ("n", {"output": {"return_values": 123, "status": "x"}, "input": {"method": {"name": "Get", "args": {"required": 3, "a": 1}}}}, "Get →", "payload=123"),
           ("t", {"output": {"return_values": "true", "status": "x"}, "input": {"method": "Get"}}, "Get →", "payload=true"), ("b", {"output": {"return_values": [True, None], "status": "x"}, "input": {}}, "Step 0:", "payload=[True, None]")]
    d = spark.createDataFrame([(k, 0, json.dumps(r["input"]), json.dumps(r["output"])) for k, r, _, _ in odd], "case_id string, step_idx int, input string, output string")
    got = {r["case_id"]: r["prompt"] for r in render.prompts(d).collect()}
    assert all(a in got[k] and b in got[k] for k, _, a, b in odd)
    cut = {r["case_id"]: r["prompt"] for r in render.prompts_as(d, most=20).collect()}
    assert cut == {k: v[-20:] for k, v in got.items()}
    with pytest.raises(ValueError, match="rich"):
        render.prompts_as(d, "other")


def test_nameless_status_and_deep_json(spark):
    deep = "[" * 100_000 + "]" * 100_000
    rows = [("nameless", '{"command": "Read"}', '{"status": {}, "command": "Read", "args": {"result": "x"}}'), ("spoken", '{"method": "Get"}', '{"status": {"code": 1}, "x": "FAIL"}'), ("deep", '{"method": "Get"}', deep)]
    d = spark.createDataFrame([(k, 0, i, o) for k, i, o in rows], "case_id string, step_idx int, input string, output string")
    assert {r["case_id"]: r["status"] for r in normalise(d).collect()} == {"nameless": "success", "spoken": "fail", "deep": ""}
    assert trajectories.steps_of(spark.createDataFrame([("d", deep)], "case_id string, raw string")).count() == 0
    assert verdict.verify_case(spark, [{"input": {"method": "Get"}, "output": {}}])["prediction"] == "fail"
    assert verdict.verify_case(spark, "no json", with_trace=True)["final_rule_id"] == "PARSE_FINAL_COMMAND"


def test_new_cases_have_keys_of_their_own(spark):
    authority = ("Authority_Admin1", "00 00 00 09 00 00 00 01")
    case = [start(), setting([{"5": 1}], authority), setting([{"5": 0}], authority), start()]
    d = trajectories.steps_of(spark.createDataFrame([("c", json.dumps(case))], "case_id string, raw string"))
    m = mutations.mutate(d).where("relation = 'authority_disabled_start_success'").collect()
    assert len(m) == 2 and len({r["name"] for r in m}) == 1 and len({r["key"] for r in m}) == 2
    n = {r["case_id"]: r["count"] for r in mutations.as_steps(mutations.mutate(d).where("relation = 'authority_disabled_start_success'")).groupBy("case_id").count().collect()}
    assert sorted(n.values()) == [4, 4]


def test_missing_files_and_odd_folders(spark, tmp_path):
    assert trajectories.read_labels(spark, str(tmp_path / "none.jsonl")).count() == 0
    assert trajectories.read_spec_index(spark, str(tmp_path / "none.jsonl")).count() == 0
    folder = tmp_path / "a (b)+c d.x" / "sub"
    folder.mkdir(parents=True)
    (folder / "x y.txt").write_text("Text")
    got = trajectories.read_spec_texts(spark, str(folder.parent)).collect()
    assert [(r["path"], r["text"]) for r in got] == [("sub/x y.txt", "text")]
    for name in ("a", "b"):
        (tmp_path / f"{name}.json").write_text('[{"records": [], "label": "Pass"}]')
    assert {r["case_id"] for r in trajectories.read_case_array(spark, str(tmp_path / "*.json")).collect()} == {"case_a_0", "case_b_0"}
    assert trajectories.read_case_array(spark, str(tmp_path / "a.json")).first()["case_id"] == "case_0"


def test_ranks_follow_one_order_whatever_the_ranges(spark):
    from stepfold.operators import sequence

    d = spark.range(1000).select((F.col("id") * 7 % 1000).alias("o"), (F.col("id") % 3 == 0).alias("g")).repartition(5)
    good = [r["g"] for r in d.orderBy("o").collect()]
    got = {r["n_rows"]: r["accuracy"] for r in sequence.running_share(d, F.col("g"), ["o"], 90).collect()}
    assert got == {n: round(sum(good[:n]) / n, 6) for n in range(90, 1001, 90)}


def test_mutations(steps):
    m = mutations.mutate(steps).cache()
    rates = {r["relation"]: r["rate"] for r in mutations.pass_rate(m, verdict.verify(mutations.as_steps(m))).collect()}
    exact = [k for k in rates if k.startswith(("genkey", "properties", "endsession", "activate", "startsession", "get_", "read_", "write_", "wrong_pin", "malformed"))]
    assert len(rates) > 45 and all(rates[k] == 1 for k in exact), {k: rates[k] for k in exact if rates[k] < 1}


def test_all_families_are_mutated_and_rendered(spark, sf_dir):
    f = families.families(spark)
    s = f.select("case_id", F.posexplode("steps").alias("step_idx", "s")).select("case_id", "step_idx", "s.input", "s.output")
    want = {r["relation"]: r["count"] for r in mutations.mutate(s).groupBy("relation").count().collect()}
    got = {r["relation"]: r["n"] for r in QUERIES["mutation_relations"](spark, sf_dir).collect()}
    assert got == want
    assert QUERIES["family_prompts"](spark, sf_dir).count() == s.select("case_id").distinct().count()


def test_terms_of_all_items_are_found(spark, tmp_path):
    items = [(i, f"Word{i % 4}_common the term{i}") for i in range(25)] + [(30, None)]
    docs = [(i, f"a WORD{i % 3} stands by term{i} and term{i + 1}") for i in range(20)] + [(40, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    score = {(i, d): n for i, t in items for d, x in docs if (n := sum(w in (x or "").lower() for w in {w for w in (t or "").lower().replace("_", " ").split() if len(w) >= 4}))}
    counts, top = set(), set()
    for i in {i for i, _ in score}:
        own = sorted((-n, d) for (j, d), n in score.items() if j == i)
        counts.add((i, len(own), -sum(n for n, _ in own)))
        top |= {(i, d, -n, k + 1) for k, (n, d) in enumerate(own[:5])}
    assert max(i for i, *_ in counts) > 10
    assert {tuple(r) for r in QUERIES["term_hit_count"](spark, str(tmp_path)).collect()} == counts
    assert {tuple(r) for r in QUERIES["topk_docs_per_query"](spark, str(tmp_path)).collect()} == top


def test_coverage_tokens(steps):
    t = coverage.trace_columns(verdict.verify(steps, with_trace=True)).where("case_id = 'activate_ok'").select(coverage.trace_tokens(F.col("trace")).alias("t")).first()["t"]
    assert {"rule:ACTIVATE_TARGET", "rule_transition:STARTSESSION_EFFECT->ACTIVATE_TARGET", "read:invoking_uid", "rule_write:STARTSESSION_EFFECT:authenticated", "spec_query:Activate SP UID"} <= set(t)


def test_source_prefixes(spark, steps):
    own = spark.createDataFrame([("read_after_genkey_old:read_old_pattern_after_genkey:3", "read_after_genkey_old", "read_old_pattern_after_genkey"), ("get_full:known_locking_get_fail:1", "get_full", "known_locking_get_fail"), ("get_full:get_empty_success:1", "get_full", "get_empty_success")], "name string, source string, relation string")
    got = {r["name"]: (r["source_case"] == r["name"].split(":")[0], r["n_source"]) for r in coverage.source_prefixes(own, steps).collect()}
    assert list(got.values()).count((True, 2)) == 2 and sum(not same for same, _ in got.values()) == 1


def test_prompts(steps):
    p = {r["case_id"]: r["prompt"] for r in render.prompts(steps).collect()}
    lines = p["get_full"].splitlines()
    assert lines[:2] == [render.HEAD, "SessionState: active=True, auth=True, SPID=0000020500000001,Write=1"]
    assert lines[4] == "[FINAL] Step 1: Get target=Locking_Range1[00 00 08 02 00 03 00 01] args={Cellblock=[{...}, {...}]} → SUCCESS payload=[[{...}]]"
    assert render.brief({"a": [1, 2, 3, 4], "b": "x" * 70}) == "{a=[1, ... (4 items)], b=" + "x" * 60 + "...}"


def test_streaming_is_the_batch(spark, steps, tmp_path):
    from stepfold.streaming import sessions

    typed = sessions.typed(normalise(steps)).cache()
    batch = sessions.judge_stream(typed).collect()
    typed.orderBy(F.desc("step_idx")).repartition(3).write.parquet(str(tmp_path / "in"))
    stream = sessions.judge_stream(spark.readStream.schema(typed.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(180)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, batch)) and len(batch) == steps.count()
    ends = {r["case_id"]: r for r in fold.state(normalise(steps)).select("case_id", "last.step_idx", F.size("active_sessions").alias("n"), "authenticated").collect()}
    for r in batch:
        if r["step_idx"] == ends[r["case_id"]]["step_idx"]:
            assert (r["n_active"], r["authenticated"]) == (ends[r["case_id"]]["n"], ends[r["case_id"]]["authenticated"])


@pytest.fixture(scope="module")
def tables(sf_dir):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_gives_the_rows_of_its_sql(spark, sf_dir, tables, name):
    df = QUERIES[name](spark, sf_dir)
    r = tables.execute(SQL[name])
    columns = [x[0] for x in r.description]
    assert sorted(columns) == sorted(df.columns)
    rows = lambda got: sorted(tuple(str(v) for v in x) for x in got)
    assert rows(df.select(*columns).collect()) == rows(r.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0
