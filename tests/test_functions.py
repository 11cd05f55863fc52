import uuid
from datetime import datetime

from pyspark.sql import functions as F

from tallyroll.functions import ids, text, times


def one(spark, column):
    return spark.range(1).select(column.alias("v")).collect()[0]["v"]


def test_masking(spark):
    rows = [
        ("tester@test.com", "tes****@test.com"), ("ab@x.org", "ab****@x.org"), ("012-7577-2823", "012-****-2823"), ("01012345678", "010-****-5678"),
        ("mail a.b+c@d.co and 02 123 4567!", "mail a.b****@d.co and 02-****-4567!"), ("no data", "no data"), (None, None), ("", ""),
        ("a@b.com1z@x.org q@", "a****@b.com1z****@x.org q@"), ("x0123-456-7890", "x0123-456-7890")]
    df = spark.createDataFrame(rows, "t string, want string")
    for r in df.select("want", text.mask_text(F.col("t")).alias("got")).collect():
        assert r["got"] == r["want"]


def test_masking_equals_the_plain_pattern(spark):
    import random

    rng = random.Random(1)
    rows = [("".join(rng.choice("ab1.-+@_ co") for _ in range(60)),) for _ in range(500)]
    df = spark.createDataFrame(rows, "t string")
    plain = F.regexp_replace("t", text.EMAIL, text.EMAIL_MASK)
    assert df.filter(~plain.eqNullSafe(text.mask_email(F.col("t")))).isEmpty()


def test_mask_name(spark):
    rows = [("Kim", "K*m"), ("Jo", "J*"), ("X", "X"), ("  Robert ", "R****t"), ("  ", "  "), (None, None), ("홍길동", "홍*동"), ("김철", "김*")]
    df = spark.createDataFrame(rows, "t string, want string")
    assert all(r["got"] == r["want"] for r in df.select("want", text.mask_name(F.col("t")).alias("got")).collect())


def test_ids(spark):
    import hashlib

    def v3(name):
        return str(uuid.UUID(bytes=hashlib.md5(name.encode()).digest(), version=3))

    for campaign, entry in ((1, "1755000000000-0"), (13, "1-7"), (999, "5-5"), (4, "x")):
        got = one(spark, ids.message_id(F.lit(campaign), F.lit(entry)))
        assert got == v3(f"coupon-issue-stream:{campaign}:{entry}")
    assert one(spark, ids.is_uuid(F.lit("3b5d5c37-12f8-3c4e-9d5a-6d2a6f0c7e11"))) is True
    assert one(spark, ids.is_uuid(F.lit("x" * 36))) is False
    assert (one(spark, ids.bitmap_segment(F.lit(8_388_609))), one(spark, ids.bitmap_offset(F.lit(8_388_609)))) == (1, 0)
    assert (one(spark, ids.bitmap_segment(F.lit(8_388_608))), one(spark, ids.bitmap_offset(F.lit(8_388_608)))) == (0, 8_388_607)


def test_times(spark):
    a, b = times.ts("2026-08-18 09:00:00"), times.ts("2026-08-18 09:00:01.9")
    assert one(spark, times.micros_between(a, b)) == 1_900_000 and one(spark, times.micros_between(b, a)) == -1_900_000
    assert one(spark, times.seconds_between(a, b)) == 1
    assert one(spark, times.epoch_millis_to_local(F.lit(1755000000123))) == datetime(2025, 8, 12, 21, 0, 0, 123000)
    assert one(spark, times.local_to_offset_text(a)) == "2026-08-18T09:00:00.000000+09:00"
    assert one(spark, a + times.millis(1500)) == datetime(2026, 8, 18, 9, 0, 1, 500000)


def test_details_and_labels(spark):
    assert one(spark, text.encode_detail(F.lit(None).cast("map<string,string>"))) == "{}"
    assert one(spark, text.decode_detail(F.lit(' '))) == {}
    assert one(spark, text.decode_detail(F.lit('{"a":"1","b":2}'))) == {"a": "1", "b": "2"}
    assert one(spark, text.detail_json(a=F.lit(1), b=F.lit(None).cast("string"))) == '{"a":1}'
    assert one(spark, text.label(F.lit("x"), {"x": "ex"})) == "ex"
    assert one(spark, text.label(F.lit("z"), {"x": "ex"}, F.lit("?"))) == "?"
    assert one(spark, text.truncate(F.lit("abcdef"), 4)) == "abcd"
    assert [text.clamp(v, 1, 50, 6) for v in (None, 0, 7, 99)] == [6, 1, 7, 50]
