"""Audits, checksums, pages, publishing and the time-based operators on hand-made rows."""

import datetime as dt
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import scalar as sx
from tessera.operators import audit as au
from tessera.operators import history as hi
from tessera.operators import integrity as ig
from tessera.sources import publish as pub
from tessera.sources import tables as tb


def test_policy_audit_edge_cases(spark):
    pol = spark.createDataFrame([
        ("t", "both_null", "ALL", None, None), ("t", "qual_true", "ALL", "true", None),
        ("t", "role", "ALL", "auth.role() = 'authenticated'", None), ("t", "ok", "ALL", "has_app_access('x')", None),
        ("t", "check_true", "ALL", "has_app_access('x')", "true"),
    ], "tablename string, policyname string, cmd string, qual string, with_check string")
    assert sorted(r.policyname for r in au.open_policies(pol).collect()) == ["both_null", "qual_true", "role"]
    assert "check_true" in {r.policyname for r in au.open_policies(pol, strict=True).collect()}


def test_view_invoker_options(spark):
    rel = spark.createDataFrame([
        ("v_absent", "v", True, None, True), ("v_true", "v", True, "true", True), ("v_on", "m", True, "on", True),
        ("v_false", "v", True, "false", False), ("t_off", "r", False, None, True), ("t_on", "r", True, None, True),
    ], "relname string, relkind string, relrowsecurity boolean, security_invoker string, anon_can_read boolean")
    assert [r[0] for r in au.bypassing_views(rel).collect()] == ["v_absent", "v_false"]
    got = {r[0]: r[1] for r in au.anon_unprotected(rel).collect()}
    assert got == {"t_off": au.WHY_RLS_OFF, "v_absent": au.WHY_VIEW}
    assert {r.relname: r.invoker for r in au.view_listing(rel).collect()}["v_absent"] == "NOT SET"


def test_definer_reasons(spark):
    fns = spark.createDataFrame([
        ("both", True, True, ["work_mem=1MB"]), ("unpinned", True, False, None),
        ("pinned", True, False, ["search_path=public"]), ("invoker", False, True, None),
    ], "proname string, prosecdef boolean, anon_execute boolean, proconfig array<string>")
    got = {r[0]: r[2] for r in au.unsafe_definer_functions(fns).collect()}
    assert got == {"both": au.WHY_ANON, "unpinned": au.WHY_PATH}


def test_run_audit_survives_a_broken_snapshot(spark):
    rel = spark.createDataFrame([("t", "r", False, None, True)],
                                "relname string, relkind string, relrowsecurity boolean, "
                                "security_invoker string, anon_can_read boolean")
    broken = spark.createDataFrame([("x",)], "nothing string")
    out = au.run_audit(rel, broken, broken)
    checks = {r.check: r.reason for r in out.collect()}
    assert checks["tables_without_rls"] == au.WHY_RLS_OFF
    assert checks["open_policies"].startswith("check failed")


CLAIMS = [
    ("b", "p1", "s", dt.date(2025, 1, 1), 2025, "1.00", "0.00", None, "active", None, None,
     dt.datetime(2025, 1, 2, 3, 4, 5, 6)),
    ("a", "p2", "s", dt.date(2025, 1, 1), 2025, "2.50", "0.00", "ins", "excluded", "suspected", None,
     dt.datetime(2025, 1, 2, 3, 4, 5)),
]
SCHEMA = ("id string, person string, service string, service_date date, tax_year int, amount_submitted string, "
          "amount_paid string, insurer string, status string, flag_status string, note string, "
          "created_at timestamp_ntz")
COLS = ["id", "person", "service", "service_date", "tax_year", "amount_submitted", "amount_paid", "insurer",
        "status", "flag_status", "note", "created_at"]


def claims(spark, rows=CLAIMS):
    return (spark.createDataFrame(rows, SCHEMA)
            .withColumn("amount_submitted", F.col("amount_submitted").cast("decimal(10,2)"))
            .withColumn("amount_paid", F.col("amount_paid").cast("decimal(10,2)")))


def exact_checksum(df, guard=None):
    """The single-stream digest: md5 of all lines ordered by the key text."""
    line = sx.checksum_line(list(COLS), ("created_at",), guard)
    rows = sorted(tuple(r) for r in df.select(F.col("id").cast("string"), line).collect())
    return hashlib.md5("\n".join(x for _, x in rows if x is not None).encode()).hexdigest()


def test_checksum_lines(spark):
    lines = ["a|p2|s|2025-01-01|2025|2.50|0.00|ins|excluded|suspected|~NULL~|2025-01-02 03:04:05.000000",
             "b|p1|s|2025-01-01|2025|1.00|0.00|~NULL~|active|~NULL~|~NULL~|2025-01-02 03:04:05.000006"]
    assert exact_checksum(claims(spark)) == hashlib.md5("\n".join(lines).encode()).hexdigest()
    digests = [hashlib.md5(x.encode()).hexdigest() for x in lines]
    want = ":".join(str(sum(int(d[16 * i:16 * i + 16], 16) for d in digests)) for i in range(2))
    assert ig.table_checksum(claims(spark), COLS, "id", ("created_at",)).first() == (2, want)
    assert ig.table_checksum(claims(spark).limit(0), COLS, "id", ("created_at",)).first() == (0, "0:0")


def test_compatible_guard_drops_rows_with_null_status(spark):
    rows = CLAIMS + [("c", "p3", "s", dt.date(2025, 1, 1), 2025, "3.00", "0.00", None, None, None, None,
                      dt.datetime(2025, 1, 2))]
    guard = ("insurer", "flag_status", "note")
    assert exact_checksum(claims(spark, rows), guard) == exact_checksum(claims(spark), guard)
    assert exact_checksum(claims(spark, rows)) != exact_checksum(claims(spark))


def test_checksum_independent_of_order_and_partitioning(spark, ws):
    c = ws.fx_claims
    a = ig.table_checksum(c, COLS, "id", ("created_at",)).first()
    b = ig.table_checksum(c.repartition(7, "person").orderBy(F.rand(1)), COLS, "id", ("created_at",)).first()
    assert a == b
    changed = c.withColumn("note", F.when(F.col("id") == "1", F.lit("x")).otherwise(F.col("note")))
    assert ig.table_checksum(changed, COLS, "id", ("created_at",)).first().digest != a.digest
    diff = ig.compare_checksums(c, changed, COLS, "id", ("created_at",)).collect()
    assert len(diff) == 1 and diff[0].rows_a == diff[0].rows_b


def test_row_diff_and_count_diff(spark):
    a = spark.createDataFrame([(1,), (2,), (2,)], "x int")
    b = spark.createDataFrame([(2,), (3,)], "x int")
    assert sorted((r.x, r.side, r.n) for r in ig.row_diff(a, b).collect()) == [(1, "lost", 1), (2, "lost", 1), (3, "added", 1)]
    old = spark.createDataFrame([("t1", 5), ("t2", 3)], "tbl string, n bigint")
    new = spark.createDataFrame([("t1", 5)], "tbl string, n bigint")
    assert ig.diff_verdict(ig.diff_counts(old, new)).first().verdict == "FAIL"
    assert ig.diff_verdict(ig.diff_counts(old, old)).first().verdict == "PASS"


def test_exact_size_page_then_short_page(spark):
    df = spark.range(2000).withColumnRenamed("id", "k")
    p1 = tb.page(df, "k", 1000)
    last = p1.agg(F.max("k")).first()[0]
    assert p1.count() == 1000 and last == 999
    assert tb.page(df, "k", 1000, after=last).count() == 1000
    assert tb.page(df, "k", 1000, after=1999).count() == 0
    pages = tb.page_numbers(df, "k", 1000).groupBy("_page").count().orderBy("_page").collect()
    assert [(r["_page"], r["count"]) for r in pages] == [(0, 1000), (1, 1000)]


def test_paged_json_round_trip_and_refusal(spark, ws, tmp_path):
    c = ws.fx_claims
    path = str(tmp_path / "pages")
    tb.export_pages(c, "id", path, 400, files=3)
    back = tb.read_pages(spark, path, c.schema)
    assert back.drop("_page").exceptAll(c).count() == 0 and c.exceptAll(back.drop("_page")).count() == 0
    sizes = sorted((r.page, r.rows) for r in tb.page_sizes(spark, path).collect())
    assert sizes == [(0, 400), (1, 400), (2, 400), (3, 300)]
    assert back.filter("_page = 0").agg(F.max("id")).first()[0] < back.filter("_page = 1").agg(F.min("id")).first()[0]
    assert tb.columns_seen(spark, path) == sorted(c.columns)
    bad_line = str(tmp_path / "bad_line")
    spark.createDataFrame([('{"page": 0, "rows": {"id": "1"}}',)], "value string").write.text(bad_line)
    with pytest.raises(ValueError):
        tb.read_pages(spark, bad_line, c.schema)
    # one JSON array per file, as a paging client saves responses; a page may span lines
    files = tmp_path / "files"
    files.mkdir()
    (files / "p0.json").write_text('[{"id": "1", "person": "p"},\n {"id": "2", "person": null}]')
    (files / "p1.json").write_text('[{"id": "3", "person": "q"}]')
    schema = "id string, person string"
    got = tb.read_paged_json(spark, str(files), schema)
    assert sorted(r.id for r in got.collect()) == ["1", "2", "3"]
    assert sorted(r.rows for r in tb.page_report(got).collect()) == [1, 2]
    assert tb.columns_seen(spark, str(files)) == ["id", "person"]
    for bad in ('{"id": "4"}', '[{"id": "4"', '"text"', ' '):
        (files / "p2.json").write_text(bad)
        # whatever is read of the pages, even no column, one bad page refuses them all
        for use in (lambda df: df.collect(), lambda df: df.count(), lambda df: df.select("person").collect()):
            with pytest.raises(Exception, match="not a JSON array|MALFORMED"):
                use(tb.read_paged_json(spark, str(files), schema))


def test_each_page_is_read_once(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"p{i}.json").write_text(f' \n[{{"id": "{i}", "other": 1}}]')
    df = tb.read_paged_json(spark, str(tmp_path), "id string")
    plan = df._jdf.queryExecution().toString()
    assert plan.split("== Physical Plan ==")[1].count("FileScan") == 1
    assert sorted(r.id for r in df.collect()) == ["0", "1", "2"] and df.columns == ["id", "_page_file"]


def test_publish_is_all_or_nothing_and_import_refuses_twice(spark, ws, tmp_path):
    root = str(tmp_path / "pub")
    g = ws.fx_grants
    pub.publish({"grants": g, "accounts": ws.fx_accounts}, root)
    assert pub.read_published(spark, root, "grants").count() == g.count()
    # a version whose manifest never committed is invisible
    g.limit(1).write.parquet(f"{root}/grants/v=9-orphan")
    assert pub.read_published(spark, root, "grants").count() == g.count()
    pub.publish({"grants": g.limit(2)}, root)
    assert pub.read_published(spark, root, "grants").count() == 2
    assert pub.read_published(spark, root, "accounts").count() == ws.fx_accounts.count()
    out = pub.import_into_empty(g, str(tmp_path / "imp"), "grants").first()
    assert out.ok
    with pytest.raises(ValueError):
        pub.import_into_empty(g, str(tmp_path / "imp"), "grants")
    with pytest.raises(ValueError):
        pub.guarded_copy(g, str(tmp_path / "cp"), "grants", g.count() + 1)
    assert pub.current_manifest(spark, str(tmp_path / "cp")) is None and not list((tmp_path / "cp" / "grants").glob("v=*"))
    assert pub.guarded_copy(g, str(tmp_path / "cp"), "grants", g.count()).first().ok


def test_a_change_computed_from_an_older_version_is_refused(spark, ws, tmp_path):
    root = str(tmp_path / "pub")
    pub.publish({"grants": ws.fx_grants}, root, base_version=0)
    base = pub.current_version(spark, root)
    pub.publish({"grants": ws.fx_grants.limit(3)}, root, base_version=base)
    with pytest.raises(pub.StaleVersion):
        pub.publish({"grants": ws.fx_grants.limit(5)}, root, base_version=base)
    assert pub.read_published(spark, root, "grants").count() == 3


def brute_force_fold(times, cap=10, window=3600):
    accepted, out = [], []
    for t in times:
        ok = sum(1 for a in accepted if a > t - window) < cap
        out.append(ok)
        if ok:
            accepted.append(t)
    return out


def test_rate_cap_fold_matches_brute_force(spark):
    rnd = random.Random(7)
    rows, t = [], dt.datetime(2024, 1, 1)
    for i in range(600):
        t += dt.timedelta(seconds=rnd.choice([5, 60, 200, 400, 4000]))
        rows.append((i, i % 3, t))
    df = spark.createDataFrame(rows, "attempt_id bigint, inviter bigint, attempted_at timestamp_ntz")
    got = {r.attempt_id: r.accepted for r in hi.rate_cap_history(df, chunk_hours=1).collect()}
    for inv in range(3):
        mine = [(r[0], r[2]) for r in rows if r[1] == inv]
        want = brute_force_fold([(x[1] - dt.datetime(2024, 1, 1)).total_seconds() for x in mine])
        assert [got[i] for i, _ in mine] == want
    trailing = {r.attempt_id: r.trailing_count for r in hi.trailing_hour_counts(df, chunk_hours=2).collect()}
    for inv in range(3):
        mine = [r for r in rows if r[1] == inv]
        for i, _, ts in mine:
            assert trailing[i] == sum(1 for _, _, u in mine if ts - dt.timedelta(hours=1) < u <= ts)


def test_stale_token_window_edges(spark):
    access = spark.createDataFrame([
        (1, 1, dt.datetime(2024, 1, 1, 10, 0, 0)), (2, 1, dt.datetime(2024, 1, 1, 10, 30)),
        (3, 1, dt.datetime(2024, 1, 1, 11, 0, 0)), (4, 1, dt.datetime(2024, 1, 1, 11, 0, 1)),
        (5, 2, dt.datetime(2024, 1, 1, 10, 30))], "event_id bigint, user_id bigint, ts timestamp_ntz")
    rev = spark.createDataFrame([(1, "crm", dt.datetime(2024, 1, 1, 10, 0, 0))],
                                "user_id bigint, app string, revoked_at timestamp_ntz")
    assert sorted(r.event_id for r in hi.stale_token_exposure(access, rev).collect()) == [2, 3]


def test_current_grants_latest_wins(spark):
    log = spark.createDataFrame([
        (1, 1, "crm", dt.datetime(2024, 1, 1), "grant", "member"),
        (2, 1, "crm", dt.datetime(2024, 1, 2), "grant", "app_admin"),
        (3, 2, "crm", dt.datetime(2024, 1, 1), "grant", "member"),
        (4, 2, "crm", dt.datetime(2024, 1, 3), "revoke", "member")],
        "change_id bigint, user_id bigint, app string, changed_at timestamp_ntz, action string, role string")
    assert [(r.user_id, r.role) for r in hi.current_grants(log).collect()] == [(1, "app_admin")]


def test_response_classes(spark):
    log = spark.createDataFrame([
        ("invite", 200, '{"id":"u1"}'), ("invite", 200, None), ("invite", 200, "not json"),
        ("invite", 400, '{"error_code":"over_email_send_rate_limit"}'),
        ("invite", 400, '{"error_code":"user_already_exists"}'), ("invite", 502, "not json"),
        ("invite", 418, "not json"), ("delete", 404, None), ("delete", 409, None), ("delete", 401, None)],
        "op string, status int, content string")
    got = [r.outcome for r in hi.classify_responses(log).collect()]
    assert got == ["ok", "no_user_id", "no_user_id", "rate_limited", "already_exists", "server_error", "other", "ok",
                   "blocked_by_reference", "bad_key"]


def test_time_operators_ignore_the_session_zone(spark):
    rows = [(1, 0, dt.datetime(2024, 3, 10, 1, 30)), (2, 0, dt.datetime(2024, 3, 10, 2, 20)),
            (3, 0, dt.datetime(2024, 3, 10, 2, 40)), (4, 0, dt.datetime(2024, 3, 10, 3, 35))]
    df = spark.createDataFrame(rows, "attempt_id bigint, inviter bigint, attempted_at timestamp_ntz")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")  # clocks jump at 02:00
        dst = sorted((r.attempt_id, r.trailing_count) for r in hi.trailing_hour_counts(df, chunk_hours=1).collect())
        dst_cap = sorted((r.attempt_id, r.accepted) for r in hi.rate_cap_history(df, cap=1, chunk_hours=1).collect())
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert dst == [(1, 1), (2, 2), (3, 2), (4, 2)]
    assert dst_cap == sorted((r.attempt_id, r.accepted) for r in hi.rate_cap_history(df, cap=1, chunk_hours=1).collect())


def test_check_constraints_reports_every_kind_in_one_table(spark):
    df = spark.createDataFrame([(1, "crm", "member"), (1, "crm", "owner"), (2, None, "app_admin"), (3, "x", None)],
                               "user_id bigint, app string, role string")
    got = sorted((r.constraint, r.key, r.column, r.value) for r in
                 ig.check_constraints(df, pk=("user_id", "app"), not_null=("role",),
                                      domains={"role": ("member", "app_admin")}).collect())
    assert got == [("domain", "1|crm", "role", "owner"), ("duplicate_key", "1|crm", "user_id,app", "2"),
                   ("not_null", "2|~NULL~", "app", None), ("not_null", "3|x", "role", None)]
