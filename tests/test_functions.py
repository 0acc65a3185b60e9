"""Golden rows of scalar functions and text operators."""

import json

import pytest
from pyspark.sql import functions as F

from ampertrace.functions import names, payload, privacy, standards
from ampertrace.operators import benchmark, people, privacy as privacy_ops, reports
from ampertrace.operators.filters import candidate_flag
from ampertrace.sources import snapshots, tables, telemetry
from ampertrace.sources.html import _Tables, parse_items


def values(spark, column, inputs):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, v string")
    return [r["o"] for r in df.select("i", column(F.col("v")).alias("o")).orderBy("i").collect()]


def test_scalars(spark):
    assert values(spark, payload.try_float, [" 12,5 W", "abc", "-3", "1.5e3", "", None]) == [12.5, None, -3.0, 1.5, None, None]
    assert values(spark, payload.norm_status, ["status 3", " idle ", " "]) == ["3", "IDLE", None]
    assert values(spark, lambda c: payload.norm_status(c, "report"), ["NaN", "3", "true", None]) == ["N/A", "3", "N/A", "N/A"]
    assert values(spark, payload.boolish, ["Tak", "single", "maybe", None]) == [True, False, None, None]
    good = values(spark, lambda c: payload.try_json(c).isNotNull(), ['{"a":1}', '{"a":1}}', '{"a":1},{"b":2}', "[1]]", "", "7"])
    assert good == [True, False, False, False, False, True]
    eff = lambda a, b, c: spark.range(1).select(payload.efficiency(*[F.lit(x).cast("double") for x in (a, b, c)])).first()[0]
    assert [eff(None, 80, None), eff(None, 80, 90), eff(70, 80, None)] == [80.0, 85.0, 70.0]
    assert values(spark, names.norm_summary, ["ABC-12 Motor Fault! WI #4711 v2 20250101"]) == ["motor fault v2"]
    assert values(spark, standards.norm_ref, ["mbn51012", "iso_26262"]) == ["MBN 51012", "ISO 26262"]
    assert values(spark, standards.eu_refs, ["2011/65/EU"]) == [["2011.65.EU", "2011_65_EU"]]
    assert values(spark, standards.cfr_refs, ["49 CFR 571.108"]) == [["49.CFR.571.108", "49CFR571.108"]]
    assert values(spark, privacy.phones, ["+48 600 700 800", "2024-01-31", "STM-4764956", None]) == [["+48 600 700 800"], [], [], []]


def test_flat_and_nested_payloads_agree(spark):
    texts = ['{"RX":"5,5 W","rx":7,"sample":"A"}', '{"power_rx":2,"rpp":null,"sample":null}', '{"voltage":"n/a","vbat":"3.9"}', "{}", "x"]
    df = spark.createDataFrame([(i, t, json.dumps({"inner": json.loads(t)}) if t != "x" else t) for i, t in enumerate(texts)], "i int, flat string, deep string")
    metrics, words = {k: payload.METRIC_KEYS[k] for k in ("rx", "rpp", "voltage_v")}, {"sample_label": payload.TEXT_KEYS["sample_label"]}
    entries = payload.payload_entries("flat")
    flat = df.select("i", *[payload.flat_metric(entries, k).alias(n) for n, k in metrics.items()], payload.flat_text(entries, words["sample_label"]).alias("s"))
    deep = df.select("i", payload.nested_fields(F.col("deep"), metrics, words).alias("f")).select("i", "f.*")
    got = [tuple(r) for r in flat.orderBy("i").collect()]
    assert got == [tuple(r) for r in deep.orderBy("i").collect()]
    assert got[:3] == [(0, 5.5, None, None, "A"), (1, None, 2.0, None, None), (2, None, None, 3.9, None)]


GOLDEN_PAYLOADS = [
    ('{"rx":1e-05,"temp":-2.5E+1}', (1e-05, -25.0, None)),
    ('{"rx":"1.5e3","sample":"1e5"}', (1.5, None, "1e5")),
    ('{"rx":"5","rx":"6"}', (6.0, None, None)),
    ('{"RX":"5","rx":"6","sample":"a"}', (5.0, None, "a")),
    ("{'rx':'5'}", (None, None, None)),
    ('{"rx":NaN,"sample":"x"}', (None, None, None)),
    ('{"rx":true,"temp":null,"sample":""}', (None, None, None)),
    ('{"rx":"n/a","temperature":"7,5 C"}', (None, 7.5, None)),
    ('{"rx":1} {"rx":2}', (None, None, None)),
    ("", (None, None, None)),
]


def test_payload_golden_rows(spark):
    """A payload gives the same values flat, inside an object and inside an array."""
    rows = [(i, form.format(text) if text else text, i % len(GOLDEN_PAYLOADS)) for i, (text, form) in enumerate(
        (text, form) for form in ("{}", '{{"in":{}}}', '{{"list":[[{}]]}}') for text, _ in GOLDEN_PAYLOADS)]
    raw = spark.createDataFrame(rows, "raw_id long, row_json string, k int")
    found = telemetry._payload_fields(raw).select("raw_id", "k", "_found.rx", "_found.temperature", "_found.sample_label").collect()
    for r in found:
        assert tuple(r)[2:] == GOLDEN_PAYLOADS[r["k"]][1], rows[r["raw_id"]]


def test_deep_payload_does_not_end_the_job(spark):
    texts = ['{"a":' * 100_000 + "1" + "}" * 100_000, '{"a":' * 300 + '{"rx":3}' + "}" * 300]
    df = spark.createDataFrame([(t,) for t in texts], "row_json string")
    assert [r[0] for r in telemetry._payload_fields(df).select("_found.rx").collect()] == [None, 3.0]


def test_candidate_flags(spark):
    rows = [
        ("3", "Foreign Object", None), ("3", None, None), ("15", "RFID", None), ("15", None, None), ("2", None, None), ("15", "RFID", "coin"),
    ]
    df = spark.createDataFrame(rows, "hmi_status string, scenario_hint string, fod_object string")
    df = df.withColumns({c: F.lit(None).cast("string") for c in ("manual_result", "defect_id", "defect_comment", "card_position")})
    flags = lambda variant: [r[0] for r in df.select(candidate_flag(df, variant)).collect()]
    assert flags("processed") == [True, False, False, True, False, True]
    assert flags("sessions") == [False, False, False, True, False, False]


def test_people_and_masking(spark):
    raw = spark.createDataFrame(
        [(1, "Łoś  Anna", "dd", "x"), (2, "Jan Anna Nowak", "DEF", None), (3, "Nowak", "DEC", None)],
        "id long, name string, department string, jazz_login string",
    )
    known = people.directory(raw)
    asked = spark.createDataFrame([("anna los",), ("Los, Anna",), ("dr Nowak jr",), ("nowak anna jan xx",), ("Kim",)], "name string")
    got = {r["given"]: r["name"] for r in people.resolve_people(asked, known).collect()}
    assert got == {"anna los": "Łoś Anna", "Los, Anna": "Łoś Anna", "dr Nowak jr": "Nowak", "nowak anna jan xx": "Jan Anna Nowak"}
    texts = spark.createDataFrame([(1, "JAN ANNA NOWAK and nowak"), (2, None), (3, "nothing")], "work_item_id long, work_item string")
    small = [r["work_item"] for r in people.mask_names(texts, "work_item", known, "strip").orderBy("work_item_id").collect()]
    assert small == ["and", "", "nothing"]
    # repeated and missing identifiers, case changes of accented letters, characters with a meaning in patterns
    mixed = spark.createDataFrame([(7, "by ŁOŚ  ANNA"), (7, "x łoś anna."), (None, "JAN anna nowak"), (None, None), (8, "O'Neil (Pat) and o'neil (pat)")], "work_item_id long, work_item string")
    more = people.directory(spark.createDataFrame([(1, "Łoś Anna", "DD", None), (2, "Jan Anna Nowak", "DEF", None), (3, "O'Neil (Pat)", "DD", None)], "id long, name string, department string, jazz_login string"))
    hashes = {r["name"]: r["person_hash"] for r in more.collect()}
    got = sorted((r["work_item_id"] or 0, r["work_item"]) for r in people.mask_names(mixed, "work_item", more).collect())
    assert got == sorted([(7, "by ŁOŚ  ANNA"), (7, f"x {hashes['Łoś Anna']}."), (0, hashes["Jan Anna Nowak"]), (0, ""), (8, f"{hashes[chr(79) + chr(39) + 'Neil (Pat)']} and {hashes[chr(79) + chr(39) + 'Neil (Pat)']}")])


def test_case_status(spark):
    steps = [(1, "Passed"), (1, "Blocked"), (2, "Passed"), (2, "Failed"), (3, "Blocked"), (4, "Skipped"), (4, "Passed")]
    df = spark.createDataFrame([("r", c, 1, s) for c, s in steps], "report_id string, case_no long, page_no int, result string")
    got = {r["case_no"]: r["computed_status"] for r in reports.case_status(df).collect()}
    assert got == {1: "Blocked", 2: "Failed", 3: "Blocked", 4: "Passed/Skipped"}


def test_last_case_is_kept(spark):
    rows = [("r", 1, 1, i, 0, n) for i, n in enumerate(["1", "2", "1", "2"])]
    df = spark.createDataFrame([(*r[:4], r[5], "Passed") for r in rows], "report_id string, page_no int, table_no int, row_no int, step_no string, result string")
    assert [r["case_no"] for r in reports.segment_steps(df).orderBy("row_no").collect()] == [1, 1, 2, 2]


def test_workbook_cells(spark):
    cells = [("FOD", "status 4", None), ("FOD", "status 4", "FFFF4B4B"), ("FOD", "no FOD detected", "FF00B050"), ("NFC", "ok", None), ("WLC", "#REF!", None)]
    df = spark.createDataFrame(cells, "sheet string, text string, fill string")
    got = [r[0] for r in df.select(benchmark.classify_cell("sheet", "text", "fill")["category"]).collect()]
    assert got == ["pass", "defect", "not_ok", "pass", None]


def test_masking_is_idempotent_and_handles_clients(spark):
    clients = spark.createDataFrame(
        [("", "Merc-Benz", ["Daimler", " daimler "], ["M\\d+X"], None, None), ("", "Hidden", [], [], True, "pending"), (None, "  ", [], [], True, "")],
        "id string, canonical string, aliases array<string>, patterns array<string>, case_insensitive boolean, status string",
    )
    clean = privacy_ops.norm_clients(clients)
    assert [(r["id"], r["aliases"]) for r in clean.orderBy("canonical").collect()] == [("Hidden", []), ("Merc-Benz", ["Daimler"])]
    text = "Mail a.b@c.de, call +48 600 700 800. merc – benz or M12X and Hidden; Polach, Karin. Client-Benz"
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    once = privacy_ops.anonymize(docs, clean).orderBy("doc_id").collect()
    assert once[0]["anonymized"] == "Mail mail@mail.com, call phone number. Client or Client and Hidden; Name. Client"
    assert once[1]["anonymized"] is None
    again = privacy_ops.anonymize(spark.createDataFrame([(1, once[0]["anonymized"])], "doc_id long, text string"), clean)
    assert again.first()["anonymized"] == once[0]["anonymized"]
    # null and repeated identifiers, soft hyphens, words broken over a line, other cases of accented letters, overlaps, parts of words
    odd = clients.sparkSession.createDataFrame(
        [("", "Łódź Werke", ["AUTOMOBILE", "ŽLUŤ"], [], None, None), ("", "Exact", [], [], False, None), ("", "++", [], ["Q[0-9]-Z"], None, None)], clients.schema
    )
    cases = [
        ("AUTO\u00adMOBILE, łódź-\n  WERKE; žluť", "Client, Client; Client"), ("exact Exact xExact Exact-", "exact Client xExact Exact-"),
        ("a ++ b, q1-\nz", "a Client b, Client"), ("Pol\u00adach, Karin and KowalAnna, Kowal  Anna", "Name and Name, Name"),
        ("write automobile@x.org", "write mail@mail.com"), ("STM-4764956 on 2024-01-31, 4764956 600 700", "STM-4764956 on 2024-01-31, phone number"),
        ("a@@b @c.d x@y.z@b.c", "a@@b @c.d mail@mail.com@b.c"), ("", ""), ("nothing", "nothing"),
    ]
    rows = [(None, t, t) for t, _ in cases] * 2
    got = privacy_ops.anonymize(spark.createDataFrame(rows, "doc_id long, text string, clients string"), privacy_ops.norm_clients(odd))
    assert {r["clients"]: r["anonymized"] for r in got.collect()} == dict(cases) and got.count() == len(rows)
    assert got.columns == ["doc_id", "text", "clients", "anonymized"]
    found = privacy_ops.find_clients(spark.createDataFrame([(t,) for t, _ in cases[:3]], "text string"), privacy_ops.norm_clients(odd))
    assert {r["text"]: r["clients"] for r in found.collect()} == {cases[0][0]: ["Łódź Werke"], cases[1][0]: ["Exact"], cases[2][0]: ["++"]}
    with pytest.raises(ValueError):
        privacy_ops.anonymize(docs, privacy_ops.norm_clients(spark.createDataFrame([("", "A", [], ["("], None, None)], clients.schema)))
    assert privacy_ops.anonymize(docs, clean.limit(0)).filter("doc_id = 2 and anonymized is null").count() == 1
    assert privacy_ops.client_hits(docs, {"canonical": "Merc-Benz", "patterns": ["m\\d+x"]}).first()["matches"] == 2
    pages = spark.createDataFrame([(i,) for i in range(1, 7)], "page_no int")
    assert [r[0] for r in privacy_ops.select_pages(pages, "1-2,5").orderBy("page_no").collect()] == [1, 2, 5]
    with pytest.raises(ValueError):
        privacy_ops.select_pages(pages, "1-9", total=6)


def test_plain_pages_are_read_like_by_the_general_parser():
    page = "<p>x</p><table><TR Class=\"a b=c\" nowrap><td title='t &lt; u'  href=\"/a?b=1&amp;c\"> R&D &amp; &copy <a href='..//y'>z</a></td ><th\n>1 > 0</th></tr></table>"
    pieces = ["", " &", "<", "<br/>", "<!-- <td> -->", "<script>if (a<td)</script>", "<td a=b>", "<td a='x'b='y'>", "<td\xa0x='1'>", "</ td>", "<title><td></title>", "<td\x0ba='1'>"]
    for piece in pieces:
        for text in (page + piece, page.replace("z", piece), page.replace("1 >", f"{piece}1")):
            fast, general = _Tables(), _Tables()
            fast.read(text)
            general.feed(text)
            assert fast.tables == general.tables, text
    plain = _Tables()
    plain.feed = None  # not needed for plain pages
    plain.read(page)
    assert plain.tables == [[("", [["td", ["R&D & ©", "z"], "..//y"], ["th", ["1 > 0"], ""]])]]


def test_html_tables():
    head = "".join(f"<th>{h}</th>" for h in ("Project", "Type", "Owner", "Creator", "Work Item ID", "Work Item"))
    row = "<td>P</td><td>Defect</td><td>A</td><td>B</td><td>7</td><td><a href='../x'>Text &amp; more</a></td>"
    html = f"<table><tr><td>nav</td></tr></table><table><tr>{head}</tr><tr>{row}</tr></table>"
    assert parse_items(html, "https://h/") == [
        {"project": "P", "type": "Defect", "owner": "A", "creator": "B", "work_item_id": "7", "work_item": "Text & more", "work_item_url": "https://h/x"}
    ]
    assert parse_items("<p>none</p>", "") == []


def test_keyed_tables_and_validation(spark):
    table = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    with pytest.raises(ValueError):
        tables.rename_key(table, "k", spark.createDataFrame([(1, 2)], "old long, new long"))
    with pytest.raises(ValueError):
        telemetry.validate_sessions(table)
    assert sorted(telemetry.conform(table.withColumnRenamed("k", "raw_id")).columns) == sorted(telemetry.PROCESSED_SCHEMA)


def test_snapshot_partitions_are_replaced_by_date(spark, tmp_path):
    from datetime import date

    path = str(tmp_path / "snap")
    sections = spark.createDataFrame([("phone", 1, "PH0")], "section string, rank int, label string")
    for day, n in ((date(2024, 1, 1), 5), (date(2024, 1, 2), 6), (date(2024, 1, 2), 7)):
        totals = spark.createDataFrame([(n, n)], "source_row_count long, session_count int")
        snapshots.write_snapshot(snapshots.snapshot_row(sections, totals, day, "sessions"), path)
    assert spark.read.parquet(path).count() == 2
    latest = snapshots.latest_snapshot(spark, path, date(2024, 1, 3)).first()
    assert (latest["snapshot_date"], latest["session_count"], latest["is_current"]) == (date(2024, 1, 2), 7, False)
    assert json.loads(latest["payload"])[0]["label"] == "PH0"


def _joins(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Join ")


def test_people_are_resolved_once_for_all_readers(spark):
    raw = spark.createDataFrame([(1, "Nowak Jan", "DD", None), (2, "Nowak Anna", "DEF", None)], "id long, name string, department string, jazz_login string")
    known = people.directory(raw)
    items = spark.createDataFrame(
        [(1, "Nowak Jan", "Anna Nowak", "seen by nowak jan"), (2, "nobody", None, "x"), (3, None, "Jan Maria Nowak", "y")],
        "work_item_id long, owner string, creator string, work_item string",
    )
    rows = people.resolve_roles(items, known)
    assert _joins(rows) <= 2
    got = {r["work_item_id"]: (r["owner"], r["creator"], r["owner_known"], r["creator_known"]) for r in rows.collect()}
    assert got == {1: ("Nowak Jan", "Nowak Anna", True, True), 2: ("", "", False, False), 3: ("", "Nowak Jan", False, True)}
    stats = people.match_stats(items, known)
    assert _joins(stats) <= 2
    row = stats.first().asDict()
    assert (row["parsed"], row["owner_matched"], row["creator_matched"], row["dropped"]) == (3, 1, 2, 1)
    assert (row["unknown_owner_samples"], row["unknown_creator_samples"]) == ("nobody", "")


def test_broadcasts_are_bounded_by_rows_not_by_files(spark, tmp_path):
    from ampertrace.session import prepare

    old = {k: spark.conf.get(k, None) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")}
    try:
        # 600,000 rows of 48 bytes in memory, about 3 MB of files
        spark.range(600_000, numPartitions=1).selectExpr("id", "concat('name ', id % 1000) as name").write.parquet(f"{tmp_path}/t")
        small = prepare(spark).read.parquet(f"{tmp_path}/t")
        plan = spark.range(10**9).join(small, "id")._jdf.queryExecution().sparkPlan().toString()
        assert "BroadcastHashJoin" not in plan
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_a_column_of_keys_is_not_broadcast_by_its_small_file(spark, tmp_path):
    from ampertrace.session import prepare

    old = {k: spark.conf.get(k, None) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")}
    try:
        # less than 1 MB of files, 3.2 MB of rows, about 8 MB as a hash table
        spark.range(200_000, numPartitions=1).write.parquet(f"{tmp_path}/t")
        keys = prepare(spark).read.parquet(f"{tmp_path}/t")
        joined = spark.range(300_000).join(keys, "id").groupBy().count()
        assert joined.collect()[0][0] == 200_000
        assert "BroadcastHashJoin" not in joined._jdf.queryExecution().executedPlan().toString()
        # a few rows still are
        few = spark.range(300_000).join(keys.filter("id < 100"), "id").groupBy().count()
        assert few.collect()[0][0] == 100
        assert "BroadcastHashJoin" in few._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_a_report_query_numbers_its_steps_once(spark, tmp_path, monkeypatch):
    from checks import q_reports
    from checks.registry import QUERIES

    spark.sql(
        "select cast(1 as bigint) as l_orderkey, cast(id as bigint) as l_partkey, cast(id as bigint) as l_suppkey, cast(id as int) as l_linenumber, "
        "1d as l_quantity, 1d as l_extendedprice, 0d as l_discount, 0d as l_tax, 'A' as l_returnflag, 'O' as l_linestatus, "
        "timestamp '1996-01-01' as l_shipdate from range(1, 5)"
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    once = q_reports.cut_lineage
    for name in ("j16_failed_without_defect", "c8_case_ids_by_page", "j17_misplaced_defects"):
        written = []
        monkeypatch.setattr(q_reports, "cut_lineage", lambda df: written.append(1) or once(df))
        QUERIES[name](spark, str(tmp_path))
        assert len(written) == 1, name


def test_cells_are_dealt_by_row_before_they_are_gathered(spark):
    from ampertrace.operators import reports as R

    cells = [
        ("r", 1, 1, 0, 1, "b"), ("r", 1, 1, 0, 0, "a"), ("r", 1, 1, 0, 1, "a"), ("r", 1, 1, 0, 1, None), (None, 1, 1, 0, 0, "x"), (None, 1, 1, 0, None, "y"),
    ]
    rows = R.rows_of(spark.createDataFrame(cells, "report_id string, page_no int, table_no int, row_no int, col_no int, cell string"))
    assert {r["report_id"]: r["cells"] for r in rows.collect()} == {"r": ["a", None, "a", "b"], None: ["y", "x"]}
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" not in plan and "REPARTITION_BY_NUM" in plan


def test_steps_are_found_among_other_rows(spark):
    from ampertrace.operators import reports as R

    cells = [
        ("r", 1, 1, 0, 0, " 1 "), ("r", 1, 1, 0, 1, "note"), ("r", 1, 1, 0, 2, "\tPASSED "), ("r", 1, 1, 1, 0, "2"), ("r", 1, 1, 1, 1, "not passed"),
        ("r", 1, 1, 2, 0, None), ("r", 1, 1, 2, 1, "3"), ("r", 1, 1, 2, 2, "failed"), ("r", 1, 1, 3, 0, None), ("r", 1, 1, 4, 0, "a"), ("r", 1, 1, 4, 1, "b"), ("r", 1, 1, 4, 2, "Blocked"),
    ]
    steps = R.extract_steps(spark.createDataFrame(cells, "report_id string, page_no int, table_no int, row_no int, col_no int, cell string"))
    assert {(r["row_no"], r["result"], r["step_no"]) for r in steps.collect()} == {(0, "Passed", "1"), (2, "Failed", "3")}


def test_only_tables_with_an_overview_are_gathered(spark, monkeypatch):
    from ampertrace.operators import reports as R

    cells = [("a", 1, 1, 0, 0, "Status overview"), ("a", 1, 1, 1, 0, "Actual test result"), ("a", 1, 1, 1, 1, "Passed"), ("a", 1, 2, 0, 0, "other")]
    # an overview without a page comes first, and one in the second cell is none
    cells += [("b", None, 1, 0, 0, "Status overview"), ("b", 1, 1, 0, 0, "Status overview"), ("b", 1, 1, 1, 0, "Actual test result"), ("b", 1, 1, 1, 1, "done")]
    cells += [("c", 1, 1, 0, 0, "x"), ("c", 1, 1, 0, 1, "Status overview"), ("c", 1, 2, 0, 0, "Status overview"), ("c", 1, 2, 1, 0, "Actual test result"), ("c", 1, 2, 2, 0, "odd")]
    df = spark.createDataFrame(cells, "report_id string, page_no int, table_no int, row_no int, col_no int, cell string")
    gathered, gather = [], R.rows_of
    monkeypatch.setattr(R, "rows_of", lambda c: gathered.append(c.count()) or gather(c))
    found = {r["report_id"]: (r["overview"], r["status"]) for r in R.status_overview(df, df).collect()}
    assert found == {"a": ("valid", "Passed"), "b": ("missing", None), "c": ("invalid", "odd")}
    assert gathered == [len(cells) - 1]


CELL_SCHEMA = "report_id string, page_no int, table_no int, row_no int, col_no int, cell string"


def test_steps_and_defect_pages_gather_cells_once(spark, tmp_path, monkeypatch):
    from ampertrace.operators import reports as R
    from checks import load_queries
    from checks.registry import QUERIES

    load_queries()
    spark.sql(
        "select cast(1 as bigint) as l_orderkey, cast(id as bigint) as l_partkey, cast(id as bigint) as l_suppkey, cast(id as int) as l_linenumber, "
        "1d as l_quantity, 1d as l_extendedprice, 0d as l_discount, 0d as l_tax, 'A' as l_returnflag, 'O' as l_linestatus, "
        "timestamp '1996-01-01' as l_shipdate from range(1, 5)"
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    gathered, gather = [], R.rows_of
    monkeypatch.setattr(R, "rows_of", lambda *a: gathered.append(1) or gather(*a))
    found = QUERIES["j17_misplaced_defects"](spark, str(tmp_path))
    assert [tuple(r) for r in found.collect()] == [(1, 2, "after_good_result", 1, "Passed")]
    assert len(gathered) == 1
    # the pages are read more than once
    pages = R.defect_pages(spark.createDataFrame([("r", 1, 1, 0, 0, " Defect ID"), ("r", 1, 1, 0, 1, ""), ("r", 2, 1, 0, 0, "x"), ("r", 2, 1, 0, 1, "defect id")], CELL_SCHEMA))
    assert "Exchange" not in pages._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in pages.collect()] == [("r", 1)]


def test_marked_rows_are_steps_or_begin_with_a_defect_id(spark):
    from ampertrace.operators import reports as R

    cells = [("r", 1, 1, 0, 0, "1"), ("r", 1, 1, 0, 1, "Passed"), ("r", 1, 2, 0, 0, "Passed"), ("r", 1, 3, 0, 0, "defect id 1"), ("r", 1, 3, 0, 1, "2"), ("r", 1, 3, 0, 2, "failed")]
    # of two cells in one place the lesser comes first, a null before it
    cells += [("r", 2, 1, 0, 0, "Defect ID"), ("r", 2, 1, 0, 0, "A"), ("r", 2, 2, 0, 0, "3"), ("r", 2, 2, 0, 0, None), ("r", 2, 2, 0, 0, "+"), ("r", 2, 2, 0, 1, "Passed"), (None, None, 1, 0, 0, "defect id")]
    df = spark.createDataFrame(cells, CELL_SCHEMA)
    marked = R.marked_rows(df)
    for found in (marked, df):
        steps = R.extract_steps(found)
        assert steps.columns == ["report_id", "page_no", "table_no", "row_no", "result", "step_no"]
        assert {tuple(r) for r in steps.collect()} == {("r", 1, 1, 0, "Passed", "1"), ("r", 1, 3, 0, "Failed", "2")}
        assert {tuple(r) for r in R.defect_pages(found).collect()} == {("r", 1), (None, None)}


def test_pages_find_the_latest_page_over_slots(spark):
    from pyspark.sql import functions as F

    from ampertrace.operators import reports as R

    marks = [("a", 3, "x", 2), ("a", 3, "y", 1), ("a", 60, None, 1), ("a", 120, "z", None), ("a", 130, "w", 5), ("b", None, "n", 1), ("b", 200, "m", 1), (None, 1, "k", 1)]
    pages = [("a", 2), ("a", 3), ("a", 49), ("a", 50), ("a", 60), ("a", 120), ("a", 500), ("a", None), ("b", 1), ("b", 199), ("b", 200), ("c", 1), (None, 1)]
    left = spark.createDataFrame([(*p, i) for i, p in enumerate(pages * 2)], "report_id string, page_no int, n int")
    right = spark.createDataFrame(marks, "report_id string, page_no int, v string, t int")
    found = R.asof_page(left, right, F.col("v"), F.col("t"), "v")
    assert found.columns == ["report_id", "page_no", "n", "v"]
    wanted = [None, "y", "y", "y", "y", "y", "w", None, "n", "n", "m", None, None] * 2
    assert [r["v"] for r in found.orderBy("n").collect()] == wanted


def test_pages_failed_in_tables_are_gathered_once(spark):
    from ampertrace.operators import reports as R

    head = [("Test case result: x", "FAILED"), ("test case result", None), ("a", "test case result fail")]
    body = [("Defect ID", ""), ("Defect ID", "D-1"), ("Defect ID", None, " \t"), (None, "Defect ID"), ("Defect ID",), ("x", "defect id"), ("\tdefect id:", " "), ("defect id", "failed", "")]
    texts = [(h, b) for h in head for b in body]
    cells = [("r", page, t, 0, at, cell) for page, rows in enumerate(texts) for t, row in enumerate(rows) for at, cell in enumerate(row)]
    # of two cells in one place the lesser comes first
    cells += [("s", 1, 0, 0, 0, "test case result failed"), ("s", 1, 1, 0, 0, "defect id"), ("s", 1, 1, 0, 0, "  ")]
    cells += [("s", 2, 0, 0, 0, "test case result failed"), ("s", 2, 1, 0, 0, "\tdefect id"), ("s", 2, 1, 0, 0, "  "), (None, None, 1, 0, 0, "test case result failed"), (None, None, 2, 0, 0, "Defect ID"), (None, None, 2, 0, 1, "")]
    lines = [("t", 1, 1, "TEST CASE RESULT failed"), ("t", 1, 2, "Defect ID:"), ("t", 1, 3, None), ("t", 2, 1, "test case result fail"), ("t", 2, 2, "Defect ID: D-1"), ("r", 0, 1, "Test case result: fail"), ("r", 0, 2, "defect id")]
    lines += [("t", 3, 1, "test case result fail"), ("t", 3, 2, "x"), ("t", 3, 3, "Test Case 4"), ("t", 3, 4, "defect id"), ("t", 4, 1, "test case result fail"), ("t", 4, 2, "Test Case 4"), ("t", 4, 3, "defect id"), ("t", 4, 4, "Comments")]
    lines += [("t", 5, 1, "test case result fail"), ("t", 5, 2, "defect id"), ("t", 5, 3, "D-1")]
    found = R.failed_without_defect(spark.createDataFrame(cells, CELL_SCHEMA), spark.createDataFrame(lines, "report_id string, page_no int, line_no int, line string"))
    failed, empty = (0, 2), (0, 2, 6)
    wanted = {("r", h * len(body) + b) for h in failed for b in empty} | {("s", 2), (None, None), ("t", 1), ("t", 4)}
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, wanted))
    # pages found in tables are written once: cells are not gathered again where they are read
    assert "collect_list" not in found._jdf.queryExecution().executedPlan().toString()
