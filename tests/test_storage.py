"""What is stored and how: keyed batches, versions of a table, read-only statements, lists, counts from footers."""

from datetime import date, datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ledgerloom import adapters, queries
from ledgerloom.operators import query as q
from ledgerloom.operators import readonly as ro
from ledgerloom.operators import records as rc
from ledgerloom.operators import runs as rn
from ledgerloom.functions import describe
from ledgerloom.operators import diagnostics as dg
from ledgerloom.sources import database, docx, files, reports, responses

SF = "/root/testdata/sf0.001"
KEYED = "source_image_id long, idx int, canonical_key string, referencia string"
ROWS = [(1, 2, "k1", "b"), (1, 1, "k1", "a"), (1, 3, "", "x"), (1, 4, "", "y"), (1, 5, None, "y"), (2, 1, "k1", "c"), (2, 2, "k2", "d")]


def plain(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def test_records_without_key_stay_and_the_smallest_idx_wins(spark):
    stored = spark.createDataFrame([(2, "k2"), (1, ""), (1, None), (9, "k1")], "source_image_id long, canonical_key string")
    want = plain([(1, 1, "k1", "a"), (1, 3, "", "x"), (1, 4, "", "y"), (1, 5, None, "y"), (2, 1, "k1", "c")])
    for rows in (ROWS, ROWS[::-1]):
        new = spark.createDataFrame(rows, KEYED)
        assert plain(rc.existing_key_anti(new, stored).collect()) == want
        assert plain(rc.existing_key_semi(new, stored).collect()) == [(2, "k2", 2, "d")]
        told = {(r["source_image_id"], r["idx"]): r["reason"] for r in rc.key_outcomes(new, stored).collect()}
        assert {k for k, why in told.items() if why} == {(1, 2), (2, 2)} and len(told) == 7 and told[1, 2] == "existing_persisted_canonical_key"


def test_a_batch_that_is_repeated_changes_nothing(spark, tmp_path):
    path, new = str(tmp_path / "deposits"), spark.createDataFrame(ROWS, KEYED)
    stored = spark.createDataFrame([(2, "k2")], "source_image_id long, canonical_key string")
    first = rc.write_deposits(new, path, "2026-11/1", stored)
    assert first[1:] == (7, 5, 2) and first.rows.count() == 5
    before = plain(spark.read.schema(KEYED).parquet(path).collect())
    again = rc.write_deposits(new, path, "2026-11/1", stored)
    assert again[1:] == (7, 5, 2) and plain(spark.read.schema(KEYED).parquet(path).collect()) == before
    # Another batch brings only what is new, and records without key.
    more = rc.write_deposits(spark.createDataFrame([*ROWS, (3, 1, "k9", "e")], KEYED), path, "two", stored)
    assert more[1:] == (8, 4, 4) and {r["referencia"] for r in more.rows.collect()} == {"x", "y", "e"}
    assert rc.write_deposits(new.limit(0), path, "none", stored)[1:] == (0, 0, 0)
    assert rc.stored_deposits(spark, path, new.schema, without="two").count() == 5


def test_versions_count_what_they_change(spark, tmp_path):
    t, day, fields = q.Versions(spark, str(tmp_path / "t")), date(2026, 1, 1), {"id": "id", "referencia": "referencia"}
    with pytest.raises(ValueError):
        t.read()
    rows = spark.createDataFrame([(1, "a", None), (2, "b", None), (3, None, None)], "id long, referencia string, created_at timestamp")
    assert t.create(rows) == 3 and t.last() == 0
    assert t.add(spark.createDataFrame([("c",), ("d",)], "referencia string"), day) == 2
    assert t.update(fields, [{"field": "referencia", "op": "in", "value": ["a", "c"]}], {"referencia": "z"}, day) == 2
    assert t.delete(fields, [{"field": "referencia", "op": "eq", "value": "z"}], day) == 2 and t.last() == 3
    assert sorted(r["referencia"] or "" for r in t.read().collect()) == ["", "b", "d"] and t.read(0).count() == 3
    # A version that was not finished is not read, and is written anew.
    rows.write.parquet(f"{t.path}/v=4")
    files.remove(spark, f"{t.path}/v=4/_SUCCESS")
    assert t.last() == 3 and t.update(fields, [{"field": "id", "op": "eq", "value": 3}], {"referencia": "y"}, day) == 1
    assert t.last() == 4 and t.read().count() == 3
    for write in (lambda: t.delete(fields, [], day), lambda: t.update(fields, [], {"referencia": "x"}, day), lambda: t.update(fields, [{"field": "id", "op": "eq", "value": 3}], {"id": 9}, day)):
        with pytest.raises(ValueError):
            write()
    assert t.last() == 4


def test_statements_are_judged_by_their_plan(spark, tmp_path):
    d = spark.createDataFrame([(1, 10.0, "a"), (2, 20.0, "b"), (3, 5.0, "a")], "id long, v double, k string")
    views = {"d": d, "runs": spark.createDataFrame([("a", "x"), ("b", "y")], "k string, n string")}
    run = lambda sql, **more: [tuple(r) for r in ro.readonly_sql(spark, sql, views, **more).collect()]
    d.createOrReplaceTempView("hidden")
    assert run("SELECT 'please update me; drop it' AS t, id FROM d ORDER BY v DESC;", limit=2) == [("please update me; drop it", 2), ("please update me; drop it", 1)]
    assert run("WITH t AS (SELECT k, sum(v) AS s FROM d JOIN runs USING (k) GROUP BY k) SELECT t.*, (SELECT max(v) FROM d) FROM t WHERE EXISTS (SELECT 1 FROM runs WHERE runs.k = t.k) ORDER BY s") == [("a", 15.0, 20.0), ("b", 20.0, 20.0)]
    assert run("WITH d AS (SELECT 7 AS id) SELECT * FROM d") == [(7,)] and run("SELECT id FROM d WHERE v > :v", args={"v": 6}, limit=0) in ([(1,)], [(2,)])
    assert run("WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 3) SELECT n FROM t ORDER BY n") == [(1,), (2,), (3,)]
    for bad in ("SELECT * FROM text.`/etc/hostname`", "SELECT reflect('java.lang.System', 'getProperty', 'user.name')", "SELECT * FROM hidden", "SELECT (SELECT count(*) FROM hidden)", "WITH t AS (SELECT * FROM csv.`/x`) SELECT 1",
                "SELECT 1; SELECT 2", "DELETE FROM d", "INSERT INTO d VALUES (1)", "WITH x AS (SELECT 1) INSERT INTO d SELECT * FROM x", "DROP TABLE d", "CREATE VIEW x AS SELECT 1", "SET a=1", "CACHE TABLE d", "SELECT * FROM range(9)", "SELECT input_file_name() FROM d",
                "SELECT * FROM identifier('hidden')", "SELECT transform(k) USING 'cat' AS (x) FROM d", "FROM d INSERT INTO runs SELECT *", "SELECT * FROM default.d", "EXPLAIN SELECT 1", ""):
        with pytest.raises(ValueError):
            ro.readonly_sql(spark, bad, views)
    spark.catalog.dropTempView("hidden")
    assert not [t.name for t in spark.catalog.listTables() if t.name in ("d", "runs") or t.name.startswith("ledgerloom_")]


def test_counts_come_from_footers(spark, tmp_path):
    for name, n in (("deposits", 5), ("logs", 7), ("small", 1)):
        spark.range(n).withColumn("x", F.repeat(F.lit("x"), 1000)).write.parquet(str(tmp_path / name))
    paths = {n: str(tmp_path / n) for n in ("deposits", "logs", "small", "process_runs")}
    got = {r["table_name"]: (r["present"], r["n"], r["place"]) for r in rn.table_stats(spark, paths, most=2).collect()}
    assert got == {"logs": (True, 7, 1), "deposits": (True, 5, 2), "process_runs": (False, None, None), "source_images": (False, None, None)}
    n, plan = rn.footer_count(spark, paths["logs"])
    assert n == 7 and "PushedAggregation: [COUNT(*)]" in plan and "ReadSchema: struct<count(*):bigint>" in plan
    assert "parquet" in spark.conf.get("spark.sql.sources.useV1SourceList")


T0 = datetime(2026, 4, 1)


def test_lists_show_what_the_tables_hold(spark):
    runs = spark.createDataFrame([(1, "a.docx", "completed", "", T0), (2, "b.docx", "failed", "boom", T0)], "id long, original_filename string, status string, error_message string, created_at timestamp").withColumns({"started_at": F.lit(None).cast("timestamp"), "finished_at": F.lit(None).cast("timestamp")})
    images = spark.createDataFrame([(10, 1, 2, "two.png", "f2"), (11, 1, 1, "one.png", "f1"), (12, 1, 3, "none.png", "")], "id long, process_run_id long, sequence_index int, source_name string, image_file string")
    deposits = spark.createDataFrame([(100, 1, 10, 7, "R1", 5.0, True, ["x"]), (101, 1, 10, 3, "R2", 6.0, None, []), (102, 1, 11, 9, "R3", 7.0, False, [])], "id long, process_run_id long, source_image_id long, sequence_index int, referencia string, valor double, is_current_month boolean, observations array<string>")
    deposits = deposits.withColumns({"structured_payload": F.lit(None).cast("string"), "fecha_consignacion": F.lit("01/04/2026"), "hora_consignacion": F.lit("10:00")})
    assert [tuple(r)[:5] for r in rn.run_list(runs, images, deposits).collect()] == [(2, "b.docx", "failed", 0, 0), (1, "a.docx", "completed", 2, 3)]
    detail = {r["id"]: r for r in rn.run_detail(runs, images, deposits).collect()}
    assert [i["source_name"] for i in detail[1]["source_images"]] == ["one.png", "two.png", "none.png"] and [x["id"] for x in detail[1]["source_images"][1]["deposits"]] == [101, 100]
    assert detail[1]["total_images"] == 2 and detail[1]["source_images"][0]["deposits"][0]["descripcion"] == "NINGUNO" and detail[2]["source_images"] is None
    logs = spark.createDataFrame([(5, 1, 10, "ocr"), (4, 1, None, "start"), (3, 1, 11, "ocr"), (2, 1, 10, "llm")], "id long, process_run_id long, source_image_id long, stage string")
    assert [(r["id"], r["sequence_index"]) for r in rn.log_list(logs, images).collect()] == [(4, None), (3, 1), (2, 2), (5, 2)]
    report = rn.export_report(runs, images, deposits).collect()
    assert [(r["image_index"], r["SECUENCIA"], r["REFERENCIA"]) for r in report] == [(1, 9, "R3"), (2, 3, "R2"), (2, 7, "R1")]


def test_text_of_documents(spark):
    import io
    import zipfile

    def document(body):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>' + body + "</w:body></w:document>")
        return out.getvalue()

    p = lambda *texts: "<w:p>" + "".join(f"<w:r><w:t>{t}</w:t></w:r>" for t in texts) + "</w:p>"
    empty = io.BytesIO()
    zipfile.ZipFile(empty, "w").close()
    rows = [("a", document(p("  Pa", "go ") + "<w:p/>" + p("") + p("two") + "<w:p><w:hyperlink><w:r><w:t>link</w:t></w:r></w:hyperlink></w:p>")), ("b", b"no zip"), ("c", document("<w:p>")), ("d", None), ("e", empty.getvalue()), ("f", document(""))]
    got = {r["path"]: r["text"] for r in docx.docx_text(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert got == {"a": "Pago \ntwo\nlink", "b": "", "c": "", "d": "", "e": "", "f": ""}


def test_specs_over_any_source(spark):
    source = q.Source(spark.createDataFrame([(2, "b"), (1, "a")], "nr int, name string"), {"nr": "nr", "name": "name"})
    assert [tuple(r) for r in q.run_query(source, {"order_by": ["nr"]}, date(2026, 1, 1)).collect()] == [(1, "a"), (2, "b")]
    assert q.run_query(source, {"aggregations": [{"type": "count"}]}, date(2026, 1, 1)).first()[0] == 2
    assert q.preset("latest_n", 500)["limit"] == 50 and q.preset("latest_n", -3)["limit"] == 1


def test_tables_over_jdbc(spark):
    """Written and read back in eight parts; filters and columns reach the database; an empty table, and one of other column names."""
    url, options, sf = "jdbc:derby:memory:ledger;create=true", {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}, "/root/testdata/sf0.001"
    tables = {name: getattr(adapters, name)(spark, sf) for name in database.TABLES}
    database.write_tables(url, tables, options=options)
    got = database.scan_tables(spark, url, parts=8, options=options)
    for name, schema in database.TABLES.items():
        want = database._plain(tables[name], schema)
        back = got[name].withColumn("observations", F.to_json("observations")) if name == "deposits" else got[name]
        assert back.rdd.getNumPartitions() == 8 and back.dtypes == want.dtypes
        assert back.exceptAll(want).isEmpty() and want.exceptAll(back).isEmpty()
    wanted = got["deposits"].filter("valor > 150000").select("id", "valor")
    plan = wanted._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(valor,150000" in plan and "ReadSchema: struct<id:bigint,valor:decimal(14,2)>" in plan
    assert wanted.count() == tables["deposits"].filter("valor > 150000").count()
    database.write_table(tables["logs"].limit(0), url, "logs", options=options)
    assert database.scan_table(spark, url, "logs", parts=8, options=options).count() == 0
    database.write_table(spark.createDataFrame([(7, "x"), (9, None)], "NR int, Name string"), url, "other", schema="NR int, Name string", options=options)
    assert sorted(map(tuple, database.scan_table(spark, url, "other", "nr bigint, name string", parts=2, key="nr", options=options).collect())) == [(7, "x"), (9, None)]


def test_reports_are_a_file_per_run(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    logs, images = dg.parsed_logs(adapters.trace_logs(spark, sf)), adapters.source_images(spark, sf)
    stale = dg.stale_runs(adapters.process_runs(spark, sf), adapters.trace_logs(spark, sf), F.lit(adapters.AS_OF_EVENTS).cast("timestamp"))
    summary = dg.stage_summary(logs, images)
    parts = (summary, dg.recommendations(dg.stage_summary(logs), images, stale, adapters.trace_logs(spark, sf)), dg.event_rows(adapters.trace_logs(spark, sf)))
    reports.write_markdown(dg.diagnostic_report(*parts, ordered=False), str(tmp_path / "md"))
    want = {}
    for r in dg.diagnostic_report(*parts).collect():
        want.setdefault(r["process_run_id"], []).append(r["value"])
    files_of = {int(f.name.split("=")[1]): [p for p in f.iterdir() if p.suffix == ".txt"] for f in (tmp_path / "md").iterdir() if f.is_dir()}
    assert {k: f[0].read_text().splitlines() for k, f in files_of.items()} == want and all(len(f) == 1 for f in files_of.values())

    runs, deposits = adapters.process_runs(spark, sf), adapters.deposits(spark, sf).withColumn("referencia", F.concat("referencia", F.lit('; "a", b\n')))
    reports.write_csv(rn.export_report(runs, images, deposits, ordered=False), str(tmp_path / "csv"))
    back = reports.read_csv(spark, str(tmp_path / "csv")).fillna("", ["OBSERVACIONES"])
    want = rn.export_report(runs, images, deposits).select(*reports.REPORT_COLUMNS, F.col("process_run_id").alias("run"))
    assert back.exceptAll(want).isEmpty() and want.exceptAll(back).isEmpty() and back.count() > 100
    # Some runs again: theirs are replaced, the others stay.
    some = rn.export_report(runs.filter("id % 2 = 0"), images, deposits.withColumn("valor", F.lit(1).cast("decimal(14,2)")), ordered=False)
    reports.write_csv(some, str(tmp_path / "csv"))
    again = reports.read_csv(spark, str(tmp_path / "csv"))
    assert again.count() == want.count() and again.filter("run % 2 = 0 AND VALOR <> 1 OR run % 2 = 1 AND VALOR = 1").isEmpty()


def test_reports_of_all_runs_are_bundled(spark, tmp_path):
    """As many files as tasks, however many runs there are; each run whole and in order in one of them."""
    sf = "/root/testdata/sf0.001"
    runs, images, deposits = adapters.process_runs(spark, sf), adapters.source_images(spark, sf), adapters.deposits(spark, sf).withColumn("referencia", F.concat("referencia", F.lit('; "a", b\r\n ')))
    reports.bundle_csv(rn.export_report(runs, images, deposits, ordered=False), str(tmp_path / "csv"))
    assert len(list((tmp_path / "csv").rglob("*.csv"))) <= 4 and not [f for f in (tmp_path / "csv").iterdir() if f.is_dir()]
    got = {}
    for r in reports.read_bundled_csv(spark, str(tmp_path / "csv")).fillna("", ["OBSERVACIONES"]).withColumn("file", F.input_file_name()).collect():
        got.setdefault((r["run"], r["file"]), []).append(tuple(r[c] for c in reports.REPORT_COLUMNS))
    want = {}
    for r in rn.export_report(runs, images, deposits).collect():
        want.setdefault(r["process_run_id"], []).append(tuple(r[c] for c in reports.REPORT_COLUMNS))
    assert {run: rows for (run, _), rows in got.items()} == want and len(got) == len(want) > 20
    lines = spark.createDataFrame([(k % 7, 0, k, x) for k, x in enumerate(["a", "", None, ' b,"c"', "x\ny"] * 9)], "process_run_id long, part int, line int, value string")
    reports.bundle_markdown(lines, str(tmp_path / "md"))
    read = reports.read_bundled_markdown(spark, str(tmp_path / "md")).collect()
    for run in range(7):
        assert [r["value"] for r in read if r["run"] == run] == [x or "" for k, x in enumerate(["a", "", None, ' b,"c"', "x\ny"] * 9) if k % 7 == run]


def test_first_object_of_a_response(spark):
    texts = ["no braces", 'x {"a": 1} y {"b": 2}', '{"a": "}{\\\\"} {"', '{"a": "\\"}"} rest', '{"a": {"b": [{}, {"c": "{"}]}} }', '{"a": "cut', '{"a": {"b": 1}', "{}", None, "}{", '"{" {"a": 1}', "{" * 3000 + "}" * 3000 + "x"]
    def plain(t):
        if t is None or "{" not in t:
            return t
        t, depth, quoted, skip = t[t.index("{"):], 0, False, False
        for i, c in enumerate(t):
            if skip:
                skip = False
            elif quoted:
                skip, quoted = c == "\\", c != '"'
            elif c == '"':
                quoted = True
            elif c in "{}":
                depth += 1 if c == "{" else -1
                if not depth:
                    return t[: i + 1]
        return t
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(responses.first_json_object(F.col("t"))).collect()]
    assert got == [plain(t) for t in texts]


def test_letters_bound_the_likeness(spark):
    """The bound loses no text, and hardly any real one is asked."""
    import random
    from difflib import SequenceMatcher

    random.seed(3)
    name = describe.PERSON.replace(" ", "")
    texts = ["".join(random.choice(name + "XYZ") for _ in range(random.randint(1, 18))) for _ in range(300)]
    texts += ["".join(random.sample(name, len(name)))] + [name[:i] + "Q" + name[i + random.randint(0, 1):] for i in range(len(name))]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(describe.may_reach(F.col("t"), name, describe.PERSON_LIKE)).collect()]
    like = [SequenceMatcher(None, t, name).ratio() >= describe.PERSON_LIKE for t in texts]
    assert all(g for g, x in zip(got, like) if x) and any(like) and sum(got) < len(texts) / 4
    share = describe.asked_share(adapters.receipts(spark, "/root/testdata/sf0.001"), "text").first()
    assert share["asked"] <= share["n"] / 100


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the test data")
def test_candidates_of_some_images_are_those_among_all(spark):
    images = spark.createDataFrame([(1,), (2,), (2,), (7,), (-5,), (None,)], "source_image_id long")
    want = plain(adapters.candidates(spark, SF).filter("source_image_id IN (1, 2, 7)").collect())
    assert want and plain(adapters.candidates(spark, SF, images).collect()) == want


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the test data")
@pytest.mark.parametrize("name", ["existing_key_semi", "existing_key_semi_rows"])
def test_known_keys_are_made_once_and_only_where_an_image_has_stored_ones(spark, name):
    plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sha2(") == 2
    above, *below = plan.split("+- Window [")
    assert len(below) == 2 and all("LeftSemi" in b.split("lineitem")[0].split("Relation")[0] for b in below)
