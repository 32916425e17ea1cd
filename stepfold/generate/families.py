"""Labelled cases by rule families: products of small pools, each product one DataFrame.

Every family is a product of pools (fixed values, below) with the statuses that its rule makes right or
wrong; steps are JSON built by column expressions. The names of objects, UIDs, ranges and rule numbers are
fixed values of the protocol.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# Objects with known fields, objects without, class and individual authorities, by name and UID.
KNOWN = [
    ("C_PIN_MSID", "00 00 00 0B 00 00 84 02"), ("C_PIN_SID", "00 00 00 0B 00 00 00 01"), ("C_PIN_Admin1", "00 00 00 0B 00 01 00 01"), ("C_PIN_Admin2", "00 00 00 0B 00 01 00 02"),
    ("C_PIN_User1", "00 00 00 0B 00 03 00 01"), ("C_PIN_User2", "00 00 00 0B 00 03 00 02"), ("Authority_SID", "00 00 00 09 00 00 00 06"), ("Authority_Admin1", "00 00 00 09 00 01 00 01"),
    ("Authority_Admin2", "00 00 00 09 00 01 00 02"), ("Authority_User1", "00 00 00 09 00 03 00 01"), ("Authority_User2", "00 00 00 09 00 03 00 02"), ("Locking_GR", "00 00 08 02 00 00 00 01"),
    ("Locking_Range1", "00 00 08 02 00 03 00 01"), ("Locking_Range2", "00 00 08 02 00 03 00 02"), ("MBRControl", "00 00 08 03 00 00 00 01"),
]
UNKNOWN = [
    ("K_AES_256", "00 00 08 06 00 03 00 01"), ("K_AES_128", "00 00 08 06 00 02 00 01"), ("K_AES_256_R1", "00 00 08 06 00 03 00 02"), ("SP_Locking", "00 00 02 05 00 00 00 01"),
    ("SP_Admin", "00 00 02 05 00 00 00 02"), ("SPInfo", "00 00 02 05 00 00 00 03"), ("ACE", "00 00 00 08 00 00 00 01"), ("ACE_Locking_GR", "00 00 00 08 00 03 E0 01"),
    ("Template", "00 00 00 02 00 00 00 01"), ("DataStore", "00 00 10 01 00 00 00 00"), ("MethodID", "00 00 00 06 00 00 00 01"), ("Table", "00 00 00 01 00 00 00 01"),
    ("SecretProtect", "00 00 00 04 00 00 00 01"), ("Log", "00 00 0F 01 00 00 00 01"), ("LogList", "00 00 0F 02 00 00 00 01"),
]
CLASSES = [("Admins", "00 00 00 09 00 00 00 02"), ("Makers", "00 00 00 09 00 00 00 03"), ("Users", "00 00 00 09 00 03 00 00")]
PERSONS = [
    ("SID", "00 00 00 09 00 00 00 06"), ("Admin1", "00 00 00 09 00 01 00 01"), ("Admin2", "00 00 00 09 00 01 00 02"), ("Admin3", "00 00 00 09 00 01 00 03"),
    ("User1", "00 00 00 09 00 03 00 01"), ("User2", "00 00 00 09 00 03 00 02"), ("User3", "00 00 00 09 00 03 00 03"),
]
READABLE = [("C_PIN_MSID", "3-3"), ("Locking_GR", "3-8"), ("Locking_Range1", "3-8"), ("Authority_Admin1", "5-5"), ("Authority_User1", "5-5"), ("MBRControl", "1-2")]
ERRORS = ["NOT_AUTHORIZED", "INVALID_PARAMETER", "FAIL"]
RANGES = ["0-3", "3-3", "3-8", "5-5"]
LBAS = ["0 ~ 7", "80 ~ 87", "100 ~ 107", "200 ~ 207", "500 ~ 507", "1000 ~ 1007", "1500 ~ 1507", "2000 ~ 2007"]
PROVIDERS = ["0000020500000001", "0000020500000002", "0000000100000001"]
MANAGER = '"invoking_id": {"uid": "00 00 00 00 00 00 00 FF", "name": "%s"}'


def _text(*parts: Column | str) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _c(x: Column | str) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _step(command: Column, response: Column) -> Column:
    return F.struct(command.alias("input"), response.alias("output"))


def start(status: Column | str = "SUCCESS", uid: Column | str = "00 00 00 09 00 01 00 01", word: Column | str = "correct_password", sp: Column | str = PROVIDERS[0], write: Column | int = 1, signed: bool = True) -> Column:
    """A StartSession step, signed by an authority or not."""
    optional = _text('{"HostSigningAuthority": "', uid, '", "HostChallenge": "', word, '"}') if signed else F.lit("{}")
    args = _text('{"required": {"HostSessionID": 1, "SPID": "', sp, '", "Write": ', F.lit(write).cast("string") if isinstance(write, int) else write.cast("string"), '}, "optional": ', optional, "}")
    command = _text('{"method": {"name": "StartSession", "uid": "00 00 00 00 00 00 FF 02", "args": ', args, "}, ", MANAGER % "Session Manager UID", "}")
    fine = '"return_values": {"required": {"HostSessionID": "00000001", "SPSessionID": "00001001"}}, "method": {"name": "SyncSession"}'
    response = _text('{"status_codes": "', status, '", ', F.when(_c(status) == "SUCCESS", fine).otherwise('"return_values": []'), "}")
    return _step(command, response)


def call(method: Column | str, name: Column | str, uid: Column | str, status: Column | str, required: Column | str = "{}", returned: Column | str | None = None, optional: str = "{}") -> Column:
    """A method call on an object."""
    if returned is None:
        returned = F.when((_c(status) == "SUCCESS") & (_c(method) == "Get"), '[{"3": "val"}]').otherwise("[]")
    command = _text('{"method": {"name": "', method, '"}, "invoking_id": {"uid": "', uid, '", "name": "', name, '"}, "args": {"required": ', required, ', "optional": ', optional, "}}")
    return _step(command, _text('{"return_values": ', returned, ', "status_codes": "', status, '"}'))


def block(columns: Column | str) -> Column:
    """The Cellblock of a range of columns such as 3-8."""
    c = _c(columns)
    return _text('{"Cellblock": [{"startColumn": ', F.split_part(c, F.lit("-"), F.lit(1)), '}, {"endColumn": ', F.split_part(c, F.lit("-"), F.lit(2)), "}]}")


VALUES = '{"Values": [{"3": "new_value"}]}'


def families(spark: SparkSession) -> DataFrame:
    """family, spec_rule, label, description, steps of all generated cases."""
    parts: list[DataFrame] = []

    def pool(rows: list, *names: str) -> Column:
        """A pool as an array of structs, to be exploded."""
        return F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(names, r if isinstance(r, tuple) else (r,))]) for r in rows])

    def add(family: str, rule: str | Column, pools: list[Column], label: Column, steps: list[Column], said: Column) -> None:
        d = spark.range(1).select()
        for p in pools:  # a product without a join: each pool is exploded in turn
            d = d.select("*", F.inline(p))
        parts.append(d.select(F.lit(family).alias("family"), _c(rule).alias("spec_rule"), label.alias("label"), said.alias("description"), F.array(*steps).alias("steps")))

    n, u, s, m, a, au, c = (F.col(x) for x in ("n", "u", "s", "m", "a", "au", "c"))
    objects, unknown = pool(KNOWN + UNKNOWN, "n", "u"), pool(UNKNOWN, "n", "u")
    ten = pool(KNOWN[:10], "n", "u")
    classes, persons = pool(CLASSES, "a", "au"), pool(PERSONS, "a", "au")
    methods = lambda *x: pool(list(x), "m")
    statuses = lambda *x: pool(list(x), "s")
    right = lambda *good: F.when(s.isin(*good), "pass").otherwise("fail")
    # what a call carries by default: a range for Get, values for Set
    with_range = lambda cols: F.when(m == "Get", block(cols)).when(m == "Set", VALUES).otherwise("{}")
    plain = F.when(m == "Set", VALUES).otherwise("{}")
    said = lambda *x: _text(*x)

    add("R1", "5.2.2.3", [methods("Get", "Set"), objects, statuses(*ERRORS, "SUCCESS")], right(*ERRORS), [call(m, n, u, s, with_range("3-3"))], said("no session + ", m, "(", n, ") -> ", s))
    add("R2", "3.3.7.1", [methods("Set", "GenKey", "Activate"), objects, statuses("NOT_AUTHORIZED", "SUCCESS")], right("NOT_AUTHORIZED"), [start(signed=False), call(m, n, u, s, plain)], said("unsigned + ", m, "(", n, ") -> ", s))
    sp = F.col("sp")
    add("R3", F.when(s == "NOT_AUTHORIZED", "5.1.5.11-wrongerr").otherwise("5.1.5.11"), [classes, pool(PROVIDERS, "sp"), statuses("INVALID_PARAMETER", "SUCCESS", "NOT_AUTHORIZED")], right("INVALID_PARAMETER"), [start(s, au, sp=sp)], said("StartSession(", a, ", ", sp, ") -> ", s))
    w = F.col("w")
    add("R4", "5.1.5.2", [persons, pool(["wrong1", "wrong2", "empty", "12345"], "w"), statuses("NOT_AUTHORIZED", "SUCCESS")], right("NOT_AUTHORIZED"), [start(s, au, w)], said("StartSession(", a, ", ", w, ") -> ", s))
    add("R5", "5.1.5.1", [persons, statuses("SUCCESS", "NOT_AUTHORIZED")], right("SUCCESS"), [start(s, au)], said("StartSession(", a, ") -> ", s))
    rv = F.col("rv")
    asked = _text('{"method": {"name": "Properties"}, ', MANAGER % "SM", "}")
    add("R6", "5.2.3", [pool(['[{"Properties": {"MaxMethods": 1}}]', "[]"], "rv")], F.when(rv == "[]", "fail").otherwise("pass"), [_step(asked, _text('{"return_values": ', rv, ', "status_codes": "SUCCESS"}'))], said("Properties -> ", rv))
    bare = _step(_text('{"method": {"name": "StartSession", "args": {"required": {"HostSessionID": 1, "SPID": "', PROVIDERS[0], '", "Write": 1}, "optional": {"HostSigningAuthority": "00 00 00 09 00 01 00 01", "HostChallenge": "pw"}}}, ', MANAGER % "SM", "}"), F.lit('{"status_codes": "SUCCESS", "return_values": []}'))
    yes = F.col("l") == "pass"
    either = start()
    picked = F.struct(F.when(yes, either["input"]).otherwise(bare["input"]).alias("input"), F.when(yes, either["output"]).otherwise(bare["output"]).alias("output"))
    add("R7", "5.2.3.2", [pool(["pass", "fail"], "l")], F.col("l"), [picked], said("SyncSession ", F.col("l")))
    add("R8", "5.3.3.7", [methods("Set", "GenKey"), objects, pool(["[]", '[{"x": "y"}]'], "rv")], F.when(rv == "[]", "pass").otherwise("fail"), [start(), call(m, n, u, "SUCCESS", plain, rv)], said(m, "(", n, ") -> ", rv))
    add("R9", "5.3.3.6", [pool(["5-3", "10-2", "8-0"], "c"), ten, statuses("INVALID_PARAMETER", "SUCCESS")], right("INVALID_PARAMETER"), [start(), call("Get", n, u, s, block(c))], said("Get(", n, ", ", c, ") -> ", s))
    uids = dict(KNOWN)
    add("R10", "5.3.4.2", [pool([(x, uids[x], y) for x, y in READABLE], "n", "u", "c"), pool(PERSONS[:4], "a", "au"), statuses("SUCCESS", *ERRORS)], right("SUCCESS"), [start(uid=au), call("Get", n, u, s, block(c))], said(a, " + Get(", n, ", ", c, ") -> ", s))
    add("R11", "opal/4.2.1.5", [pool(["1", "0"], "w"), statuses("SUCCESS", "NOT_AUTHORIZED")], right("SUCCESS"), [start(write=w, signed=False), call("Get", "C_PIN_MSID", uids["C_PIN_MSID"], s, block("3-3"))], said("unsigned (", w, ") + Get(MSID) -> ", s))

    def authenticated(family: str, rule: str, who: Column, outcomes: list[tuple[str, str, str]]) -> None:
        add(family, rule, [who, pool(outcomes, "s", "rv", "l")], F.col("l"), [start(), call("Authenticate", a, au, s, "{}", _text("[", rv, "]"), '{"Proof": "cred"}')], said("Authenticate(", a, ") -> ", s, " ", rv))

    authenticated("R12", "5.3.4.1.14.1-class", classes, [("INVALID_PARAMETER", "null", "pass"), ("SUCCESS", "true", "fail"), ("SUCCESS", "false", "fail")])
    authenticated("R13", "5.3.4.1.14.1-ok", persons, [("SUCCESS", "true", "pass"), ("SUCCESS", "false", "fail"), ("NOT_AUTHORIZED", "null", "fail")])
    authenticated("R14", "5.3.4.1.14.1-wrong", persons, [("SUCCESS", "false", "pass"), ("NOT_AUTHORIZED", "null", "fail")])
    authenticated("R15", "5.3.4.1.2.1", pool([("Anybody", "00 00 00 09 00 00 00 01")], "a", "au"), [("SUCCESS", "true", "pass"), ("SUCCESS", "false", "fail")])
    lba, pattern = F.col("lba"), F.col("pattern")
    wrote = lambda p: _step(_text('{"command": "Write", "args": {"LBA": "', lba, '", "pattern": "', p, '"}}'), F.lit('{"command": "Write", "status_codes": "Success"}'))
    got = lambda tail: _step(_text('{"command": "Read", "args": {"LBA": "', lba, '"}}'), _text('{"command": "Read", "status_codes": "', tail, "}"))
    add("R16", "data_consistency", [pool(LBAS, "lba"), pool(["0xAA", "0xBB", "0xCC", "0x00", "0xFF"], "pattern")], F.lit("pass"), [start(), wrote(pattern), got('Success", "args": {"result": "data"}')], said("Write(", lba, ", ", pattern, ") + Read"))
    add("R16", "data_consistency", [pool(LBAS, "lba"), statuses("FAIL", "NOT_AUTHORIZED")], F.lit("fail"), [start(), wrote("0xDD"), got(_text(s, '"'))], said("Write(", lba, ") + Read -> ", s))
    add("R17", "3.3.7.1-RO", [methods("Set", "GenKey", "Activate"), objects, statuses("NOT_AUTHORIZED", "SUCCESS")], right("NOT_AUTHORIZED"), [start(write=0), call(m, n, u, s, plain)], said("read-only + ", m, "(", n, ") -> ", s))
    add("R18", "5.1.5.2-unknown", [unknown, statuses(*ERRORS), pool(RANGES, "c")], F.lit("pass"), [start(signed=False), call("Get", n, u, s, block(c))], said("unsigned + Get(", n, ", ", c, ") -> ", s))
    add("R19", "5.3.4.2-unknown", [unknown, statuses("NOT_AUTHORIZED", "FAIL"), pool(RANGES, "c")], F.lit("fail"), [start(), call("Get", n, u, s, block(c))], said("signed + Get(", n, ", ", c, ") -> ", s))
    add("R20", "5.3.4.2.6", [ten, statuses("INVALID_PARAMETER", "SUCCESS")], right("INVALID_PARAMETER"), [start(), call("Set", n, u, s, '{"Values": [[{"3": "a"}, {"3": "b"}]]}')], said("Set(", n, ", twice) -> ", s))
    k = F.col("k")
    drawn = lambda r: call("Random", "ThisSP", "00 00 00 00 00 00 00 01", s, _text('{"Count": ', k, "}"), r)
    add("R21", "opal/4.2.9.1", [pool(["33", "64", "100", "256"], "k"), statuses("INVALID_PARAMETER", "SUCCESS")], right("INVALID_PARAMETER"), [start(), drawn("[]")], said("Random(", k, ") -> ", s))
    add("R21", "opal/4.2.9.1-ok", [pool(["1", "8", "16", "32"], "k"), statuses("SUCCESS")], F.lit("pass"), [start(), drawn('[{"result": "0xABCD"}]')], said("Random(", k, ") -> SUCCESS"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    # dealt anew, so that what is computed on the cases is planned once, not for each part of the union
    return out.withColumn("case_id", F.concat_ws("/", "family", "description")).repartition("case_id")


def public_cases(cases: DataFrame) -> DataFrame:
    """The observed cases among training cases: those whose source says so."""
    return cases.where(F.startswith("source", F.lit("public:")))


def with_public(splits: DataFrame, old: DataFrame) -> DataFrame:
    """case_id, label, split: of generated cases as they were split, and the observed ones among `old` (case_id, source, label) for training only."""
    return splits.select("case_id", "label", "split").unionByName(public_cases(old).select("case_id", "label", F.lit("train").alias("split")))


def split(cases: DataFrame, key: str = "case_id", seed: int = 42, shares: tuple[float, float] = (0.6, 0.8)) -> DataFrame:
    """train, val and test by exact shares, in the order of a seeded hash: the same in every run."""
    order = F.xxhash64(F.lit(seed), key)
    # ranks come from bounded buckets of the hash: counts of 4096 of them, then an order within each
    d = cases.withColumns({"_o": order, "_b": F.pmod(F.shiftright(order, 52), F.lit(4096)).cast("int")})
    counts = d.groupBy("_b").agg(F.count("*").alias("_k"))
    ahead = counts.select(F.col("_b").alias("_bb"), F.coalesce(F.sum("_k").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_k").over(W.partitionBy()).alias("_n"))
    d = d.join(F.broadcast(ahead), d["_b"] == ahead["_bb"])  # 4096 rows at most
    rank = F.col("_before") + F.row_number().over(W.partitionBy("_b").orderBy("_o", key)) - 1
    name = F.when(F.col("_rank") < F.floor(F.col("_n") * shares[0]), "train").when(F.col("_rank") < F.floor(F.col("_n") * shares[1]), "val").otherwise("test")
    return d.withColumn("_rank", rank).withColumn("split", name).drop("_o", "_b", "_bb", "_before", "_n", "_rank")
