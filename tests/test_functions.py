from pyspark.sql import functions as F

from tracelens import verbs
from tracelens.functions import classify, money, payload, time, values


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v"))).first()[0]


def test_numbers_and_flags(spark):
    assert str(one(spark, money.paise_to_inr, "1234")) == "12.34"
    assert str(one(spark, money.paise_to_inr, 1234.0, "double")) == "12.34"
    assert one(spark, values.safe_long, "1e300") is None and one(spark, values.safe_long, "1500.5") == 1500
    assert one(spark, values.safe_double, "1772442000d") is None
    assert [one(spark, values.tri_bool, x) for x in ("yes", "0", "2", "nan", None)] == [True, False, None, None, None]
    assert one(spark, money.sms_paise, "Rs. 500 debited") == 50_000


def test_times_keep_going_on_bad_rows(spark):
    assert one(spark, time.norm_ts, "NaN") is None and one(spark, time.norm_ts, "1e300") is None
    a, b = (one(spark, lambda c: F.unix_micros(time.chromium_ts(c)), str(11_644_473_600_000_000 + 10**15 + k)) for k in (123, 125))
    assert b - a == 2


def test_verbs_are_two_valued_and_total(spark):
    df = spark.createDataFrame([(1, "10"), (2, None), (3, "abc"), (4, "9"), (5, "A[b")], "id long, v string")
    ids = lambda p: [r.id for r in verbs.where(df, p).orderBy("id").collect()]
    v = F.col("v")
    assert ids(verbs.eq(v, 10.0)) == [1] and ids(verbs.ne(v, "10")) == [2, 3, 4, 5] and ids(verbs.eq(v, None)) == [2]
    assert ids(verbs.compare(v, "<", 10)) == [4] and ids(~verbs.compare(v, "<", 10)) == [1, 2, 3, 5]
    assert ids(verbs.like(v, "a[[]?")) == [5] and ids(verbs.like(v, "A?C")) == [3] and ids(verbs.matches(v, "(")) == []
    assert [r.id for r in verbs.sort(df, "v", "id").collect()] == [4, 1, 5, 3, 2]
    assert [r.id for r in verbs.sort(df, "v", "id", desc=True).collect()] == [3, 5, 1, 4, 2]
    assert [r.id for r in verbs.tail(df, 2, "id").collect()] == [4, 5] and verbs.tail(df, 0, "id").count() == 0
    assert verbs.dedup(df.unionByName(df.withColumn("id", F.col("id") + 10)), "v", "id").count() == 5
    assert verbs.stats(df, "sum", "v").first()[0] == 19.0


def test_payload_rules(spark):
    cases = [
        (classify.payment_amount, '{"amount":1e5}', 100_000),
        (classify.payment_amount, '{"amount":1500.5,"paidFrom":{"amount":0}}', 1500),
        (classify.payment_amount, '{"paidFrom":[{"amount":1500.5}],"amount":7}', 1500),
        (classify.payment_amount, '{"receivedIn":{"actualAmount":"250"}}', 250),
        (classify.payment_amount, '{"amount":{"amount":9}}', 9),
        (classify.payment_amount, '{"amount":1,"amount":2}', 2),
        (classify.payment_amount, '{"amount":true}', 0),
        (classify.payment_amount, "plain text", 0),
        (lambda v: classify.direction_of_payment(F.lit("SENT_PAYMENT"), v), '{"from":[{"a":1}],"receivedIn":{"a":1}}', "SENT"),
        (lambda v: classify.direction_of_payment(F.lit("SENT_PAYMENT"), v), '{"from":{"a":1},"receivedIn":{"a":1}}', "RECEIVED"),
        (lambda v: classify.direction_of_payment(F.lit("X"), v), '{"from":{"a":1},"receivedIn":[{}]}', "UNKNOWN"),
        (lambda v: classify.direction_of_legs(F.lit(None).cast("string"), v), '{"actor":"receiver"}', "IN"),
        (lambda v: classify.direction_of_legs(F.lit("X"), v), '{"paidFrom":[{}]}', "OUT"),
        (classify.classify, '{"mandateAmount":null}', "MANDATE"),
        (classify.classify, '{"to":{"type":"VPA","mcc":0}}', "PEER_TO_PEER"),
        (classify.classify, '{"to":{"type":"VPA","mcc":"0000"}}', "PEER_TO_PEER"),
        (classify.classify, '{"to":[{"type":"VPA","mcc":5411}]}', "MERCHANT"),
        (classify.classify, '{"to":{"type":"VPA","firstPartyMerchant":"true"}}', "PEER_TO_PEER"),
        (classify.classify, '{"to":{"type":"VPA","firstPartyMerchant":true}}', "MERCHANT"),
        (classify.user_note, '{"note":" {hi} "}', "{hi}"),
        (classify.user_note, '{"note":["q"]}', ""),
        (classify.user_note, '{"note":{"message":"","text":"t"}}', "t"),
        (lambda v: payload.at(v, "k"), '{"k":"x"', None),
    ]
    for rule, text, expected in cases:
        assert one(spark, lambda c: rule(payload.decode_json(c)), text) == expected, text
    assert one(spark, money.sms_paise, "Rs.\u00a0500 debited") == 50_000
    flat = one(spark, payload.flatten, '{"a":{"x":{"y":1}},"b":"{\\"x\\":1}","c":[1,2],"d":{}}')
    assert {r["key"]: r["value"] for r in flat} == {"a.x.y": "1", "b": '{"x":1}', "c": "[1,2]", "d": "{}"}
