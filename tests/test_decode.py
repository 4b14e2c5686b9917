import math

import pytest

from curbside.functions import decode as D

GOOD = [
    ('{"taxiId":1,"lon":-73.9,"lat":40.7}', (1, -73.9, 40.7)),
    ('{"taxiId":"12","lon":"-73.9","lat":40.7,"extra":1}', (12, -73.9, 40.7)),
    ('{"taxiId":2.9,"lon":1,"lat":2}', (2, 1.0, 2.0)),
    ('{"taxiId":-2.9,"lon":1,"lat":2}', (-2, 1.0, 2.0)),
    ('{"taxiId":"2.9","lon":1e2,"lat":2}', (2, 100.0, 2.0)),
    ('{"taxiId":3,"lon":1,"lat":2} trailing', (3, 1.0, 2.0)),
    ('{"taxiId":99999999999,"lon":1,"lat":2}', (99999999999, 1.0, 2.0)),
    ('{"taxiId":3,"taxiId":4,"lon":1,"lat":2}', (4, 1.0, 2.0)),
]
LENIENT = [
    ('{"taxiId":null,"lon":null,"lat":2}', (0, 0.0, 2.0)),
    ('{"taxiId":"abc","lon":"x","lat":2}', (0, 0.0, 2.0)),
    ('{"taxiId":true,"lon":true,"lat":[1]}', (1, 1.0, 0.0)),
    ('{"taxiId":5,"lon":"NaN","lat":2}', (5, math.nan, 2.0)),
    ('{"taxiId":true,"lon":1,"lat":2}', (1, 1.0, 2.0)),
]
BAD = ['{"lon":1,"lat":2}', '{"taxiId":1,"lon":1}', "not json", "", "[1]", "7", '{"taxiId":1,', None]


@pytest.fixture(scope="module")
def messages(spark):
    rows = [(m,) for m, _ in GOOD + LENIENT] + [(m,) for m in BAD]
    return spark.createDataFrame(rows, "value string")


def plain(rows):
    return sorted(repr(tuple(r)) for r in rows)


def test_lenient(messages):
    decoded = D.decode_taxis(messages, seq_field=None).collect()
    assert plain(decoded) == plain(v for _, v in GOOD + LENIENT)


def test_strict(messages):
    assert plain(D.decode_taxis(messages, seq_field=None, coerce="reject").collect()) == plain(v for _, v in GOOD)


def test_rejects_are_the_rest(messages):
    lost = [r.value for r in D.rejects(messages, D.TAXI_FIELDS, seq_field=None).collect()]
    assert sorted(lost, key=str) == sorted(BAD, key=str)
    strict = D.rejects(messages, D.TAXI_FIELDS, seq_field=None, coerce="reject").count()
    assert strict == len(BAD) + len(LENIENT)


def test_order_field(spark):
    rows = [('{"clientId":85,"origLon":-73.91,"origLat":40.66,"seq":4}',), ('{"clientId":85,"origLon":1,"origLat":2}',)]
    assert [tuple(r) for r in D.decode_clients(spark.createDataFrame(rows, "value string")).collect()] == [
        (85, -73.91, 40.66, 4)
    ]


def test_order_of_the_source(spark):
    rows = [('{"taxiId":1,"lon":1,"lat":2}', 77)]
    decoded = D.decode_taxis(spark.createDataFrame(rows, "value string, seq long"), seq_field=None, keep=("seq",))
    assert [tuple(r) for r in decoded.collect()] == [(1, 1.0, 2.0, 77)]


def test_round_trip_keeps_every_bit(spark):
    rows = [(i, i, -74.0 + i / 7, 40.0 + i / 11) for i in range(200)]
    df = spark.createDataFrame(rows, "taxi_id long, seq long, lon double, lat double")
    back = D.decode_taxis(D.encode(df, D.TAXI_FIELDS)).select(df.columns)
    assert sorted(map(tuple, back.collect())) == rows


def test_every_message_is_parsed_once(messages):
    for coerce in ("zero", "reject"):
        plan = D.decode_taxis(messages, coerce=coerce)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("parseJson") == 1


def test_unknown_mode(messages):
    with pytest.raises(ValueError):
        D.decode_taxis(messages, coerce="maybe")
