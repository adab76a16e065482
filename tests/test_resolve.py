"""R1-R9 on hand-written messages (FIXTURES A1/A2)."""

from featurestats.operators.resolve import build_schema, parse_messages, quarantine, resolve, unresolved_features

FEATURES = [
    (8, "amount", "Double", "PUBLISHED"),
    (7, "country", "String", "PUBLISHED"),
    (9, "flag", "Boolean", "PUBLISHED"),
    (10, "n", "Integer", "PUBLISHED"),
    (11, "note", None, "PUBLISHED"),
    (12, "draft", "Integer", "DRAFT"),
    (13, "eventType", "String", "PUBLISHED"),
    (14, "acct", "Long", "PUBLISHED"),
    (15, "tags", "List<String>", "PUBLISHED"),
]
ATTRS = [(4, "acct", "String"), (18, "ref", "String")]
MSGS = [
    '{"eventId":"e1","eventType":"transfer","userId":"k-9","time":1700001234000,"processTime":1700001235,'
    '"rules":[1,null,"2"],"actions":["block",null],"featureMap":{"8":41.5,"7":"PT","99":"x","9":1,"10":"3.7",'
    '"11":"hello","12":5,"13":"clash","14":7,"15":["a",null]},"eventFields":{"4":"123","18":"ref-77"}}',
    '{"eventId":"e2","eventType":"login","time":"1700001234","featureMap":{},"eventFields":{}}',
    '{"eventId":"e3","eventTime":1700001234000,"processingTime":1700001334000,"featureMap":{"8":"NaN","9":"true",'
    '"14":9},"eventFields":{}}',
    "not json",
    "[1, 2]",
    "42",
    '{"eventId":"e4","rules":"nope"}',
    '{"eventId":"e5","time":"soon"}',
    '{"eventId":"e6","time":1700001234,"originId":"abc"}',
    '{"eventId":"e7","time":1700001234,"rules":[1,"x"]}',
    '{"eventId":"e9","rules":[1.9,"4"],"actions":7,"featureMap":[],"eventFields":"none"}',
    '{"eventId":"e10","time":1700001234,"rules":["3.7"]}',
    '{"eventId":"e8","time":1700001234,"processTime":"later"}',
    None,
]


def _df(spark):
    return spark.createDataFrame([(m,) for m in MSGS], "value string")


def test_build_schema_order_and_collisions():
    plan = build_schema(FEATURES, ATTRS)
    names = [c.name for c in plan.columns]
    assert names == ["country", "amount", "flag", "n", "note", "acct", "tags", "ref"]
    assert any("eventType" in c for c in plan.collisions)
    acct = next(c for c in plan.columns if c.name == "acct")
    assert acct.dtype.simpleString() == "bigint" and acct.attribute_ids == ["4"] and acct.feature_ids == ["14"]


def test_resolve_values(spark):
    plan = build_schema(FEATURES, ATTRS)
    rows = {r.eventId: r for r in resolve(parse_messages(_df(spark), plan=plan), plan).collect()}
    assert set(rows) == {"e1", "e2", "e3", "e4", "e9"}
    # fields of another JSON type read as NULL, the record is kept; a number truncates, its text must be an integer
    assert rows["e4"].rules is None and rows["e9"].rules == [1, 4] and rows["e9"].actions is None and rows["e9"].amount is None
    e1 = rows["e1"]
    assert e1.eventType == "transfer" and e1.userId == "k-9"
    assert e1.rules == [1, 2] and e1.actions == ["block", None]
    # "10":"3.7" is a string: not an integer literal → NULL (a number 3.7 would truncate to 3)
    assert e1.amount == 41.5 and e1.country == "PT" and e1.flag is False and e1.n is None
    assert e1.note == "hello" and e1.acct == 123 and e1.ref == "ref-77" and e1.tags == '["a",null]'
    assert e1.eventTime.timestamp() * 1000 == 1700001234000
    e2 = rows["e2"]
    assert e2.eventTime.timestamp() == 1700001234 and e2.amount is None and e2.rules is None
    e3 = rows["e3"]
    assert e3.amount is None and e3.flag is True and e3.acct == 9
    assert e3.processingTime.timestamp() * 1000 == 1700001334000


def test_quarantine_reasons(spark):
    q = {r.raw_value: r.reason for r in quarantine(parse_messages(_df(spark))).collect()}
    assert q == {
        "not json": "not_an_object",
        "[1, 2]": "not_an_object",
        "42": "not_an_object",
        '{"eventId":"e10","time":1700001234,"rules":["3.7"]}': "bad_fixed_field",
        '{"eventId":"e5","time":"soon"}': "bad_event_time",
        '{"eventId":"e6","time":1700001234,"originId":"abc"}': "bad_fixed_field",
        '{"eventId":"e7","time":1700001234,"rules":[1,"x"]}': "bad_fixed_field",
        '{"eventId":"e8","time":1700001234,"processTime":"later"}': "bad_fixed_field",
    }


def test_unresolved(spark):
    meta = spark.createDataFrame(FEATURES, "id int, name string, return_type string, status string")
    out = {r.feature_id: r.n_events for r in unresolved_features(parse_messages(_df(spark)), meta).collect()}
    assert out == {"99": 1, "12": 1}


def test_single_projection(spark):
    """Resolution is one narrow projection: no shuffle, no join."""
    plan = build_schema(FEATURES, ATTRS)
    text = resolve(parse_messages(_df(spark), plan=plan), plan)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text and "Join" not in text
