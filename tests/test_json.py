"""Canonical documents, exact numbers and property rules."""

import json

from pyspark.sql import functions as F

from tidemark.functions import jsondoc, temporal, text
from tidemark.operators import validation
from tidemark.sources import wire


def one(spark, expression, *values):
    rows = spark.createDataFrame([(v,) for v in values], "v STRING").select(expression(F.col("v")).alias("r"))
    return [r.r for r in rows.collect()]


def test_numbers_by_value(spark):
    same = ["1", "1.0", "1e0", "10e-1", "0.1E+1", "100e-2"]
    assert set(one(spark, jsondoc.plain_number, *same)) == {"1"}
    pairs = {"-1.50": "-1.5", "1.5e3": "1500", "-0.0": "0", "0e5": "0", "12e-4": "0.0012", "-3e-1": "-0.3"}
    assert one(spark, jsondoc.plain_number, *pairs) == list(pairs.values())


EXACT = dict(
    [
        ("79228162514264337593543950335", True), ("79228162514264337593543950336", False), ("1e28", True), ("1e29", False),
        ("1e-28", True), ("1e-29", False), ("1.00000000000000000000000000001", False), ("0.10000000000000000000000000000", True),
        ("-5", True), ("0e99", True), ("1e99999999999", False), ("7.9228162514264337593543950335", True),
    ]
)


def test_exact_numbers(spark):
    assert dict(zip(EXACT, one(spark, jsondoc.is_exact_number, *EXACT))) == EXACT


def test_canonical(spark):
    raw = ['{"b":1.0,"a":{"d":[3,1,2.50],"c":1e2}}', '{"a":{"c":100,"d":[3.0,1,2.5]},"b":1}', '{"a":1,"a":2}', "{"]
    left, right, duplicate, broken = one(spark, jsondoc.canonical, *raw)
    assert left == right == '{"a":{"c":100,"d":[3,1,2.5]},"b":1}'
    assert duplicate is None and broken is None
    tricky = '{"k":"1.0 , -0.0 \\" 1e0","e":1E2}'
    assert json.loads(one(spark, jsondoc.canonical, tricky)[0]) == {"k": '1.0 , -0.0 " 1e0', "e": 100}


def nested(levels):
    return '{"a":' * levels + "1" + "}" * levels


DOCUMENTS = dict(
    [
        ("{}", True), (nested(4), True), (nested(5), False), ('{"a":[[[1]]]}', True), ('{"a":[[[[1]]]]}', False),
        (json.dumps({f"k{i}": i for i in range(64)}), True), (json.dumps({f"k{i}": i for i in range(65)}), False),
        (json.dumps({"a": list(range(63))}), True), (json.dumps({"a": list(range(64))}), False),
        (json.dumps({"x" * 100: 1}), True), (json.dumps({"x" * 101: 1}), False), ('{"a":"' + "s" * 2048 + '"}', True),
        ('{"a":"' + "s" * 2049 + '"}', False), ('{" ":1}', False), ('{"a\\nb":1}', False), ('{"a\\\\nb":1}', True),
        ('{"a":{"APIkey":1}}', False), ('{"tok\\u0065n":1}', False), ('{"a":"password"}', True), ('{"a":"\\"token\\":1"}', True),
        ('{"a":1e29}', False), ('{"a":"' + '\\n' * 2048 + '"}', True),
    ]
)


def test_document_rules(spark):
    def exact(c):
        numbers = F.regexp_extract_all(jsondoc.skeleton(c), F.lit(jsondoc.NUMBER), F.lit(0))
        return F.forall(numbers, jsondoc.is_exact_number)

    found = one(spark, lambda c: jsondoc.document_ok(jsondoc.canonical(c)) & exact(c), *DOCUMENTS)
    assert dict(zip(DOCUMENTS, found)) == DOCUMENTS


def test_text_rules(spark):
    assert one(spark, text.trim_whitespace, "\t a b ") == ["a b"]
    assert one(spark, lambda c: text.bad_label(c, 3), "abc", "abcd", "  ", "a\u0007", None) == [False, True, True, True, True]
    assert one(spark, text.bad_identity, None, "", "x") == [False, True, False]


def test_instants(spark):
    shown = one(
        spark, lambda c: temporal.iso_text(temporal.parse_instant(c)),
        "2026-09-10T10:00:00.1234567+07:00", "2026-09-10T03:00:00Z", "2026-09-10T03:00:00", "10:00", "2026-13-01T00:00:00Z",
    )
    assert shown == ["2026-09-10T03:00:00.123456Z", "2026-09-10T03:00:00.000000Z", "2026-09-10T03:00:00.000000Z", None, None]


GUID = "11111111-2222-4333-8444-555555555555"


def decode(spark, *documents):
    frames = spark.createDataFrame([(d,) for d in documents], "value STRING")
    now = F.lit("2026-09-10 12:00:00").cast("timestamp_ntz")
    return validation.validate(wire.decode_events(frames), now)


def wire_event(**changes):
    body = {"eventId": GUID, "eventType": "login", "schemaVersion": 1, "occurredAt": "2026-09-10T11:00:00Z"}
    body.update(changes)
    return json.dumps({k: v for k, v in body.items() if v is not ...})


EVENTS = [
    (wire_event(), None, []),
    (wire_event(userId=None, properties=None), None, []),
    (wire_event(extra=1), "malformed", None),
    (wire_event() + " x", "malformed", None),
    ("[1]", "malformed", None),
    (wire_event(eventId="nope"), "malformed", None),
    (wire_event(eventId=None), "malformed", None),
    (wire_event(schemaVersion="1"), "malformed", None),
    (wire_event(occurredAt="yesterday"), "malformed", None),
    (wire_event(eventId=...), "validation", ["eventId"]),
    (wire_event(eventType=" ", userId=""), "validation", ["eventType", "userId"]),
    (wire_event(schemaVersion=...), "validation", ["schemaVersion"]),
    (wire_event(occurredAt="2026-09-03T11:59:59Z"), "validation", ["occurredAt"]),
    (wire_event(occurredAt="2026-09-03T12:00:00Z"), None, []),
    (wire_event(occurredAt="2026-09-10T12:05:00.000001Z"), "validation", ["occurredAt"]),
    (wire_event(properties=[1]), "validation", ["properties"]),
    (wire_event(properties={"a": {"Secret": 1}}), "validation", ["properties"]),
    (wire_event(properties={"a": 1}).replace(": 1}", ": 1.00000000000000000000000000001}"), "validation", ["properties"]),
    (wire_event(properties={"a": "x" * 40000}), "size", None),
    (wire_event().replace("eventId", "EVENTID"), None, []),
]


def test_event_rules(spark):
    rows = {r.value: r for r in decode(spark, *[d for d, _, _ in EVENTS]).collect()}
    for document, reason, fields in EVENTS:
        row = rows[document]
        assert row.reject_reason == reason, document
        if fields is not None:
            assert [e.field for e in row.errors] == fields, document


def test_browser_policy(spark):
    frames = spark.createDataFrame(
        [(wire_event(eventType=t, properties=p),) for t, p in [("login", {"source": "browser"}), ("purchase", {"source": "browser"}), ("login", {"source": "server"})]],
        "value STRING",
    )
    now = F.lit("2026-09-10 12:00:00").cast("timestamp_ntz")
    rows = validation.validate(wire.decode_events(frames), now, browser_only=True).collect()
    assert [[e.field for e in r.errors] for r in rows] == [[], ["eventType"], ["properties.source"]]


def test_envelopes(spark):
    good = '{"events":[' + wire_event() + ",null]}"
    many = '{"events":[' + ",".join([wire_event()] * 101) + "]}"
    huge = '{"events":["' + "x" * 1024 * 1024 + '"]}'
    frames = spark.createDataFrame([(1, good), (2, '{"events":[]}'), (3, many), (4, '{"events":1}'), (5, '{"other":[]}'), (6, huge)], "b INT, value STRING")
    rows = wire.explode_batches(frames).select("b", "batch_error", "ordinal", F.col("event").isNull().alias("missing")).orderBy("b", "ordinal").collect()
    assert [(r.b, r.batch_error, r.ordinal, r.missing) for r in rows] == [
        (1, None, 0, False), (1, None, 1, True), (2, "events", 0, True), (3, "events", 0, True),
        (4, "events", 0, True), (5, "malformed", 0, True), (6, "batch too large", 0, True),
    ]
