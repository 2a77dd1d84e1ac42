"""Scalar expressions of §2.8 on hand-made rows."""

import datetime as dt

from pyspark.sql import functions as F

from tessera.functions import scalar as sx


def test_link_params_fragment_wins_and_plus_is_space(spark):
    df = spark.createDataFrame([(1, "https://a.io/i.html?error=a+b&x=1&x=2#error=c%20d&token_hash=t&flag"),
                                (2, "https://a.io/plain")], "id int, url string")
    got = {(r.id, r.key): r.value for r in sx.link_params(df, "id", "url").collect()}
    assert got == {(1, "error"): "c d", (1, "x"): "1", (1, "token_hash"): "t", (1, "flag"): ""}


def test_invite_link_encodes_the_target(spark):
    df = spark.createDataFrame([("https://x.io/invite.html",)], "u string")
    assert df.select(sx.invite_link("https://auth.io/invite", "u")).first()[0] == \
        "https://auth.io/invite?redirect_to=https%3A%2F%2Fx.io%2Finvite.html"


def test_session_expiry_fallbacks(spark):
    t = dt.datetime(2024, 1, 1, 12)
    df = spark.createDataFrame([(1, t, None, None), (2, t, 120, None), (3, t, None, t + dt.timedelta(seconds=30))],
                               "id int, started_at timestamp_ntz, expires_in int, expires_at timestamp_ntz")
    now = F.lit(t + dt.timedelta(seconds=100)).cast("timestamp_ntz")
    out = sx.expiring_sessions(df, now, start_col="started_at", expires_at_col="expires_at",
                               expires_in_col="expires_in")
    assert sorted(r.id for r in out.collect()) == [2, 3]


def test_json_key_present_even_when_null(spark):
    df = spark.createDataFrame([('{"probe": null}',), ('{"other": 1}',), ("[1]",)], "j string")
    assert [r[0] for r in df.select(sx.has_json_key("j", "probe")).collect()] == [True, False, None]


def test_summary_texts(spark):
    df = spark.createDataFrame([(0, None), (1, dt.datetime(2024, 3, 4, 5, 6)), (3, None)],
                               "n int, last timestamp_ntz")
    got = [r[0] for r in df.select(F.concat_ws(" · ", sx.plural_apps("n"), sx.last_sign_in_text("last"))).collect()]
    assert got == ["no access · never signed in", "1 app · last sign-in 2024-03-04", "3 apps · never signed in"]
    assert spark.range(1).select(sx.strip_scheme(F.lit("https://jobs.example.com"))).first()[0] == "jobs.example.com"
