"""Operators on small tables, and every registered query against its SQL on the smallest test data."""

import datetime as dt
import decimal
import io
import zipfile
from datetime import date
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ledgerloom import queries as library
from ledgerloom.operators import attempts as at
from ledgerloom.operators import query as q
from ledgerloom.operators import records as rc
from ledgerloom.operators import runs as rn
from ledgerloom.sources import docx, responses

SF = "/root/testdata/sf0.001"


def canonical(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return str(v.normalize())
    return v.replace(tzinfo=None).isoformat() if isinstance(v, dt.datetime) else v


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the test data")
@pytest.mark.parametrize("name", sorted(library.SQL))
def test_query_equals_sql(spark, duck, name):
    df = library.QUERIES[name](spark, SF)
    result = duck.execute(library.SQL[name])
    names = [c[0] for c in result.description]
    order = sorted(df.columns)
    assert order == sorted(names)
    mine = sorted((tuple(canonical(r[c]) for c in order) for r in df.collect()), key=repr)
    theirs = sorted((tuple(canonical(r[names.index(c)]) for c in order) for r in result.fetchall()), key=repr)
    assert mine == theirs


def test_merge_of_duplicates(spark):
    rows = [(1, "h", 1, "15/04/2026", None, " ref001 ", "$50.000,00", 0.0), (1, "h", 2, "15/04/2026", "09:30", "REF001", "50000.00", 0.0), (1, "h", 3, "15/04/2026", "09:30", "REF001", "50,000.00", 0.0),
            (1, "h", 4, "15/04/2026", "10:30", "REF001", "50000", 0.0), (1, "h", 5, None, None, None, "1", 0.0)]
    c = spark.createDataFrame(rows, "source_image_id long, content_hash string, idx int, fecha_consignacion string, hora_consignacion string, referencia string, valor string, confidence double")
    got = sorted((r["idx"], r["hora_consignacion"], r["merged"]) for r in rc.dedup_merge(c.orderBy(F.rand(1))).collect())
    # 1 and 2 merge, 3 repeats the merged key, 4 has another time, 5 has no key.
    assert got == [(1, "09:30", 2), (4, "10:30", 1), (5, None, 1)]
    again = rc.dedup_merge(rc.dedup_merge(c).withColumn("content_hash", F.lit("h")).withColumn("confidence", F.lit(0.0)))
    assert again.count() == 3


def merge_by_hand(rows):
    """The fold of dedup_merge for one loose key, in plain Python. rows: (idx, fecha, hora, confidence), normalized."""
    kept, seen = [], set()
    for row in rows:
        idx, day, hour, conf = row
        if (day, hour) in seen:
            continue
        if kept:
            h = kept[0]
            if not (h[1] and h[2] and day and hour) or (h[1], h[2]) == (day, hour):
                rank = lambda r: (bool(r[1]) + bool(r[2]), r[3])
                best = row if rank(row) > rank(h) else h
                kept[0] = (h[0], best[1], best[2], best[3])
                seen.add((best[1], best[2]))
                continue
        seen.add((day, hour))
        kept.append(row)
    return [(k[0], k[1], k[2]) for k in kept]


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the test data")
def test_merge_equals_plain_fold(spark):
    from ledgerloom import adapters

    c = adapters.candidates(spark, SF)
    keyed = rc.with_keys(c).filter("loose_key <> ''").select("source_image_id", "loose_key", "idx", "n_fecha", "n_hora", "confidence").collect()
    groups = {}
    for r in sorted(keyed, key=lambda r: r["idx"]):
        groups.setdefault((r["source_image_id"], r["loose_key"]), []).append((r["idx"], r["n_fecha"], r["n_hora"], r["confidence"]))
    wanted = sorted((k[0], idx, bool(day), bool(hour)) for k, rows in groups.items() for idx, day, hour in merge_by_hand(rows))
    got = sorted((r["source_image_id"], r["idx"], bool(r["fecha_consignacion"]), bool(r["hora_consignacion"])) for r in rc.dedup_merge(c).filter("valor IS NOT NULL").collect())
    assert got == wanted


def fold_with_counts(rows):
    """The same with what happens to each candidate: (idx, what, other) and how many went into the first record."""
    head, seen, merged, told, kept = None, {}, 0, [], []
    for idx, day, hour, conf in rows:
        rank = (bool(day) + bool(hour), conf)
        if head is None:
            head, best, first, merged = (day, hour), rank, idx, 1
            seen[day, hour] = idx
        elif (day, hour) in seen:
            told.append((idx, "result_duplicate_skipped", seen[day, hour]))
        elif day and hour and all(head):
            seen[day, hour] = idx
            kept.append((idx, 1))
        else:
            merged += 1
            told.append((idx, "result_candidate_merged", first))
            if rank > best:
                head, best = (day, hour), rank
                seen[day, hour] = first
    return sorted([(first, merged), *kept]), told


@pytest.mark.parametrize("stretch", [4096, 7])
def test_merge_of_a_hot_image(spark, monkeypatch, stretch):
    """One image, and in it one reference and amount, holds a third of all candidates: reduced in stretches, folded as one after the other."""
    import random

    random.seed(stretch)
    monkeypatch.setattr(rc, "STRETCH", stretch)
    days, hours = [None, "01/04/2026", "02/04/2026"], [None, "", "09:30", "10:00"]
    rows, groups = [], {}
    for i in range(900):
        hot = i % 3 == 0
        image, ref = (1, "REF100" if i % 6 else "REF200") if hot else (2 + i % 40, f"REF{i % 2}00")
        day, hour, conf = random.choice(days), random.choice(hours), random.choice([None, 0.0, 0.25, 0.5, 0.75, 0.9, round(random.random(), 3)])
        if i % 50 == 7:
            ref = None
        rows.append((image, "h", i, day, hour, ref, "500", conf))
        if ref:
            n_day = day and f"{day[6:]}-{day[3:5]}-{day[:2]}"
            groups.setdefault((image, ref), []).append((i, n_day or "", hour or "", conf or 0.0))
    c = spark.createDataFrame(rows, "source_image_id long, content_hash string, idx int, fecha_consignacion string, hora_consignacion string, referencia string, valor string, confidence double")
    records, events = [], []
    for (image, _), group in groups.items():
        kept, told = fold_with_counts(group)
        records += [(image, *k) for k in kept]
        events += [(image, *t) for t in told]
    records += [(r[0], r[2], 1) for r in rows if r[5] is None]
    assert sorted((r["source_image_id"], r["idx"], r["merged"]) for r in rc.dedup_merge(c).collect()) == sorted(records)
    assert sorted((r["source_image_id"], r["idx"], r["stage"], r["other"]) for r in rc.dedup_events(c).collect()) == sorted(events)
    plan = rc.dedup_merge(c)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and plan.count("MapInPandas") == 1


DEPOSITS = [(1, "REFTOOL001", "100000.00", "2026-04-22", ["ok"], -40), (2, "REFTOOL002", "200000.00", "2026-04-15", ["error en valor"], -10), (3, "REFTOOL003", "50000.00", "2026-03-28", ["fecha invalida"], 0)]
AS_OF = date(2026, 4, 30)


def deposits(spark):
    rows = [(i, ref, Decimal(v), day, obs, dt.datetime(2026, 4, 30, 12) + dt.timedelta(days=off)) for i, ref, v, day, obs, off in DEPOSITS]
    return spark.createDataFrame(rows, "id long, referencia string, valor decimal(14,2), fecha string, observations array<string>, created_at timestamp")


def ask(spark, spec):
    df = deposits(spark)
    source = q.Source(df, {c: c for c in df.columns})
    return q.run_query(source, spec, AS_OF).collect(), source.warnings


def test_spec_queries(spark):
    assert ask(spark, {"select": ["referencia"], "order_by": ["-valor"], "limit": 1})[0][0]["referencia"] == "REFTOOL002"
    assert [r["id"] for r in ask(spark, {"filters": [{"field": "observations", "op": "icontains", "value": "FECHA"}]})[0]] == [3]
    assert ask(spark, {"filters": [{"field": "created_at", "op": "in_last_days", "value": 30}], "aggregations": [{"type": "sum", "field": "valor", "alias": "t"}]})[0][0]["t"] == Decimal("250000.00")
    rows, _ = ask(spark, {"group_by": ["fecha"], "aggregations": [{"type": "count", "alias": "n"}, {"type": "sum", "field": "valor"}], "order_by": ["-fecha"]})
    assert tuple(rows[0]) == ("2026-04-22", 1, Decimal("100000.00"))
    rows, warnings = ask(spark, {"select": ["id", "secret"], "filters": [{"field": "nope", "op": "eq", "value": 1}, {"field": "valor", "op": "between", "value": 3}], "limit": "x"})
    assert len(rows) == 3 and len(warnings) == 3
    assert [r["id"] for r in ask(spark, {"filters": [{"field": "created_at", "op": "date_eq", "value": "today"}]})[0]] == [3]


def test_today_falls_back(spark):
    d = deposits(spark).filter(F.lower("referencia").contains("tool") & F.col("valor").between(1, 200000))
    assert [r["id"] for r in q.today_or_all_valid(d, AS_OF).collect()] == [1]


def test_updates_and_deletes_keep_unknown_rows(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id long, status string")
    source = q.Source(df, {"id": "id", "status": "status"})
    only_a = [{"field": "status", "op": "eq", "value": "a"}]
    assert [r["id"] for r in q.delete_rows(source, only_a, AS_OF).collect()] == [2]
    assert {r["id"]: r["status"] for r in q.update_rows(source, only_a, {"status": "z", "id": 9}, AS_OF).collect()} == {1: "z", 2: None}
    assert source.warnings == ["field not writable: id"]


def test_corrections(spark):
    d = spark.createDataFrame([(1, "01/01/2026", "10:00", "A", "1"), (2, None, None, "B", "2")], "id long, fecha_consignacion string, hora_consignacion string, referencia string, valor string")
    c = spark.createDataFrame([(1, "2026-04-22", "15:45", "REF999", "175000", 2), (1, "2020-01-01", "00:00", "OLD", "1", 1), (7, None, None, None, None, 1)], "id long, fecha_consignacion string, hora_consignacion string, referencia string, valor string, at int")
    got = {r["id"]: tuple(r)[1:] for r in rc.apply_corrections(d, c, "at").collect()}
    assert got == {1: ("22/04/2026", "15:45", "REF999", "175000", True), 2: (None, None, "B", "2", False)}
    assert [r["id"] for r in rc.unknown_ids_anti(c, d).collect()] == [7]


def test_corrections_recompute_observations(spark):
    schema = "id long, fecha_consignacion string, hora_consignacion string, referencia string, valor decimal(14,2), fecha_date date, observations array<string>, is_current_month boolean"
    old = ["Fecha invalida"], False
    d = spark.createDataFrame([(i, "99/99/2026", "10:00", "A", Decimal(1), None, *old) for i in range(1, 5)], schema)
    c = spark.createDataFrame([(1, "2026-04-22", "REF999"), (2, "15/03/2026", None), (3, None, "REF9")], "id long, fecha_consignacion string, referencia string")
    criteria = [{"key": "referencia", "rules": [{"kind": "regex", "pattern": "^REF", "message": "no REF"}]}]
    got = {r["id"]: (r["fecha_date"], r["observations"], r["is_current_month"]) for r in rc.apply_corrections(d, c, None, 4, 2026, criteria).collect()}
    assert got == {1: (date(2026, 4, 22), [], True), 2: (date(2026, 3, 15), ["Fecha fuera del periodo valido configurado", "no REF"], False), 3: (None, ["Fecha invalida"], None), 4: (None, *old)}
    assert [r["id"] for r in q.valid_deposits(rc.apply_corrections(d, c, None, 4, 2026)).orderBy("id").collect()] == [1, 2]


def test_report_has_description_and_order(spark):
    runs = spark.createDataFrame([(1, "completed"), (2, "failed")], "id long, status string")
    images = spark.createDataFrame([(10, 2, "b.png", "DAVID GUEVARA", None), (11, 1, "a.png", None, "nada"), (12, 3, "c.png", None, None)], "id long, sequence_index int, source_name string, ocr_raw_text string, context_text string")
    row = lambda i, run, image, seq, payload: (i, run, image, seq, None, None, f"R{i}", Decimal(1), None, ["x", "y"], payload)
    deposits = spark.createDataFrame(
        [row(1, 1, 10, 2, None), row(2, 1, 10, 1, "no json"), row(3, 1, 11, 1, '{"telefono": 3176771287, "more": {"name": "GROUP DYD COMUNICACIONES SAS"}}'), row(4, 1, 12, 1, '{"titular": "GROUP DYD COMUNICACIONES SAS", "n": null}'), row(5, 2, 12, 1, None),
         row(6, 1, 12, 2, '{"more": {"name": "GROUP DYD COMUNICACIONES SAS"}, "list": ["3176771287"]}')],
        "id long, process_run_id long, source_image_id long, sequence_index int, fecha_consignacion string, hora_consignacion string, referencia string, valor decimal(14,2), is_current_month boolean, observations array<string>, structured_payload string")
    got = [(r["deposit_id"], r["DESCRIPCION"]) for r in rn.export_report(runs, images, deposits).collect()]
    assert got == [(3, "NEQUI"), (2, "NEQUI"), (1, "NEQUI"), (4, "CUENTA"), (6, "NINGUNO")]


def test_best_ocr_attempt(spark):
    rows = [(1, 1, "long text", 50, None, 0, 3), (1, 2, "t", 5, None, 1, 1), (1, 3, "tt", 5, None, 1, 1), (2, 1, "", 0, "timeout", None, None), (2, 2, "", 0, "no model", None, None), (3, 1, "a", 1, None, None, None), (3, 2, "", 99, "x", 9, 9)]
    schema = "source_image_id long, attempt_number int, text string, score int, error string, valid_records_count int, structured_records_count int"
    got = sorted(map(tuple, at.best_ocr_attempt(spark.createDataFrame(rows, schema)).collect()))
    assert got == [(1, 3, None), (2, None, "timeout; no model"), (3, 1, None)]


def test_extraction_events_keep_rejected_candidates(spark):
    got = library.QUERIES["extraction_events_all"](spark, SF)
    rejected = {r["reason"]: r["n"] for r in got.filter("stage = 'rejected_candidate'").groupBy("reason").agg(F.count_distinct("id").alias("n")).collect()}
    variants = {r["variant"]: r["n"] for r in library.a.receipts(spark, SF).groupBy("variant").agg(F.count("*").alias("n")).collect()}
    assert rejected["amount_looks_like_year"] >= variants[2] and rejected["amount_looks_like_time"] >= variants[3] and rejected["amount_looks_like_phone"] >= variants[4]
    assert got.filter("stage <> 'rejected_candidate'").count() == sum(variants.values())


ATTEMPTS = "source_image_id long, attempt_number int, strategy string, records array<struct<referencia:string,valor:string>>, confidence double, error string"


def test_consensus_by_attempts_and_records(spark):
    rows = [(1, 1, "s", [("r", "5"), (" R ", "5")], 0.9, None), (1, 2, "s", [("q", "7")], 0.5, None), (2, 1, "s", [("a", "1")], 0.2, "boom"), (2, 2, "s", [("b", "2")], 0.8, None),
            # One attempt alone: both of its records hold. No records at all: nothing to agree on.
            (3, 1, "s", [("a", "1"), ("b", "2")], 0.9, None), (4, 1, "s", [], 0.9, None), (5, 1, "s", None, 0.9, None)]
    a = spark.createDataFrame(rows, ATTEMPTS)
    got = {(r["source_image_id"], r["signature"]): r["is_consensus"] for r in at.consensus(a).collect()}
    assert got == {(1, "R|5"): True, (1, "Q|7"): False, (2, "B|2"): True, (3, "A|1"): True, (3, "B|2"): True}
    verdict = {r["source_image_id"]: (r["n_consensus"], r["n_conflict"], r["recommendation"]) for r in at.aggregation(a).collect()}
    assert verdict == {1: (1, 1, "review"), 2: (1, 0, "accept"), 3: (2, 0, "accept"), 4: (0, 0, "accept"), 5: (0, 0, "accept")}
    final = sorted((r["source_image_id"], r["attempt_number"], r["record"]["referencia"]) for r in at.select_final_records(a).collect())
    assert final == [(1, 1, " R "), (1, 1, "r"), (2, 2, "b"), (3, 1, "a"), (3, 1, "b")]


def test_writes_want_filters_they_know(spark):
    source = q.Source(spark.createDataFrame([(1, "a"), (2, "b")], "id long, referencia string"), {"id": "id", "referencia": "referencia"})
    for bad in ([{"field": "referencia", "op": "startswith", "value": "a"}], [{"field": "nope", "op": "eq", "value": 1}], [{"field": "id", "op": "in", "value": 3}]):
        with pytest.raises(ValueError):
            q.delete_rows(source, bad, date(2026, 1, 1))
        with pytest.raises(ValueError):
            q.update_rows(source, bad, {"referencia": "x"}, date(2026, 1, 1))
    made = q.create_rows(source.frame, spark.createDataFrame([(1, "c"), (7, "d")], "id long, referencia string"), date(2026, 1, 1))
    assert sorted(r["referencia"] for r in made.collect()) == ["a", "b", "c", "d"] and made.select("id").distinct().count() == 4


def test_periods_go_by_their_column():
    day = date(2026, 4, 22)
    assert {f["field"] for f in q.period_filters("current_month", day)} == {"fecha_date"} and {f["field"] for f in q.period_filters("last_30_days", day)} == {"fecha_date"}
    for name, more in (("this_year", {}), ("last_7_days", {}), ("named_month", {"month": 2}), ("between", {"start": day, "end": date(2026, 1, 1)}), ("exact_day", {"day": day})):
        assert {f["field"] for f in q.period_filters(name, day, **more)} == {"created_at"}
    assert q.amount_filters("near", "$ 50.000") == [{"field": "valor", "op": "between", "value": [45000, 55000]}] and q.amount_filters("gt", "1.200,000")[0]["value"] == 1200000


def test_corrections_take_known_fields_alone(spark):
    deposits = spark.createDataFrame([(5, "01/04/2026", "10:00", "REF1", Decimal("10.00"), ["x"], None)], "id long, fecha_consignacion string, hora_consignacion string, referencia string, valor decimal(14,2), observations array<string>, is_current_month boolean")
    for bad in ({"id": 5, "status": "x", "valor": 1}, {"id": 5}, {"valor": 1}):
        with pytest.raises(ValueError):
            rc.partial_correction(deposits, bad)
    got = rc.partial_correction(deposits, {"id": 5, "fecha_consignacion": "2026-04-22", "hora_consignacion": "15:45", "referencia": "REF999", "valor": 175000}, 4, 2026).first()
    assert (got["fecha_consignacion"], got["hora_consignacion"], got["referencia"], got["valor"], got["observations"], got["is_current_month"]) == ("22/04/2026", "15:45", "REF999", Decimal("175000.00"), [], True)
    with pytest.raises(ValueError):
        rc.apply_corrections(deposits, spark.createDataFrame([(5, "x")], "id long, status string"))


def test_retry_rounds(spark):
    d = at.retry_decision(F.lit("extraction_failed"), F.lit(1), F.lit(None).cast("double"), F.lit("auto"), F.lit("mistral:7b"))
    r = spark.range(1).select(d.alias("d"), at.apply_retry(F.lit("auto"), F.lit("mistral:7b"), F.lit(45), d).alias("n")).first()
    assert r["d"]["strategy"] == "change_llm_model" and tuple(r["n"]) == ("auto", "neural-chat:7b", 90)


def test_responses(spark):
    texts = ['<think>{"x":1}</think>```json\n{"consignaciones":[{"referencia":"R{1}","valor":"50.000,00"},{"referencia":"ok","valor":5}]}\n```', 'noise {"consignaciones":[{"referencia":"RRR","valor":7000}]} tail', "{broken", None, ""]
    got = responses.parse_responses(spark.createDataFrame(list(enumerate(texts)), "id long, response string")).collect()
    assert sorted((r["id"], r["referencia"], r["valor"]) for r in got) == [(0, "R{1}", 50000.0), (1, "RRR", 7000.0)]


def a_docx(paragraphs, media, targets):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    r = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    run = lambda x: f'<w:r><w:drawing><a:blip xmlns:a="a" r:embed="{x[1:]}"/></w:drawing></w:r>' if x.startswith("@") else f"<w:r><w:t>{x}</w:t></w:r>"
    body = "".join("<w:p>" + "".join(map(run, p)) + "</w:p>" for p in paragraphs)
    links = "".join(f'<Relationship Id="{i}" Target="{t}"/>' for i, t in targets.items())
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}" xmlns:r="{r}"><w:body>{body}</w:body></w:document>')
        z.writestr("word/_rels/document.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>')
        for name, data in media.items():
            z.writestr(f"word/media/{name}", data)
    return out.getvalue()


PNG = b"\x89PNG\r\n\x1a\n" + b"x" * 40


def test_docx(spark, tmp_path):
    ids = {"r1": "media/first.png", "r2": "media/second.png", "r3": "media/third.png"}
    (tmp_path / "order.docx").write_bytes(a_docx([["@r2"], ["@r1"]], {"first.png": PNG + b"1", "second.png": PNG + b"2"}, ids))
    (tmp_path / "twins.docx").write_bytes(a_docx([["@r1", "@r2", "@r3", "@r1"]], {"first.png": PNG, "second.png": PNG, "third.png": PNG + b"3"}, ids))
    (tmp_path / "dates.docx").write_bytes(a_docx([["0", "6", " ABRIL 2026"], ["@r1"], ["07/04/2026", "@r2", " 8 de abril de 2026", "@r3"]], {n: PNG + n.encode() for n in ("first.png", "second.png", "third.png")}, ids))
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    (tmp_path / "text.docx").write_bytes(a_docx([["hola ", "mundo"], ["fin"]], {}, {}))
    files = docx.scan_docx(spark, str(tmp_path))
    refs = docx.raw_references(files).cache()
    images = docx.kept_images(refs).orderBy("path", "ref").collect()
    of = lambda name: [r for r in images if r["path"].endswith(f"/{name}.docx")]
    assert [(r["sequence_index"], r["target"]) for r in of("order")] == [(1, "word/media/second.png"), (2, "word/media/first.png")]
    assert [(r["sequence_index"], r["skip_reason"]) for r in of("twins")] == [(1, None), (None, "adjacent_same_binary_content"), (2, None), (None, "same_package_target")]
    assert [r["context_date"] for r in of("dates")] == ["06/04/2026", "07/04/2026", "08/04/2026"] and of("dates")[0]["context_date_text"] == "06 ABRIL 2026"
    reasons = {r["path"].rsplit("/", 1)[1]: r["reason"] for r in docx.validate_docx(files, refs).collect()}
    assert reasons == {"order.docx": "", "twins.docx": "", "dates.docx": "", "bad.docx": "invalid_docx", "text.docx": "docx_no_images"}
    assert {r["path"].rsplit("/", 1)[1]: r["text"] for r in docx.docx_text(refs).collect()}["text.docx"] == "hola mundo\nfin"


def test_images(spark):
    rows = [(1, PNG), (2, b"BM"), (3, b"RIFF0000WEBP" + b"x" * 30), (4, b"z" * 50)]
    got = spark.createDataFrame([(i, bytearray(b)) for i, b in rows], "i int, c binary").select("i", docx.validate_image(F.col("c")).alias("v")).orderBy("i").collect()
    assert [r["v"] for r in got] == ["", "too_small", "", "unknown_format"]


def test_a_text_is_read_once_an_image(spark, monkeypatch):
    """Attempts of an image with one text: extraction gets one row for them, all of them count, and the best by score, then the first, stands for them."""
    good, read = "Referencia MCTX001 Valor $30.000,00", []
    rows = [(1, 1, "ilegible", 9, None), (1, 2, good, 3, None), (1, 3, good, 5, None), (1, 4, good, 5, ""), (1, 5, good, 99, "llm timeout"), (1, 6, good + " fin", 4, None),
            (2, 1, good, None, None), (2, 2, good, -1, None), (3, 1, "ilegible", 1, None), (3, 2, "ilegible", 2, None), (4, 1, "", 5, None)]
    inner = at.with_record

    def counted(df, *args, **kwargs):
        read.append(df.count())
        return inner(df, *args, **kwargs)

    monkeypatch.setattr(at, "with_record", counted)
    texts = spark.createDataFrame(rows, "source_image_id long, attempt_number int, text string, score int, error string")
    got = at.select_structured_candidate(texts).select("source_image_id", "candidates", "attempt_number", "score", "structured_records_count", "valid_records_count", "record.referencia").collect()
    assert sorted(map(tuple, got)) == [(1, 5, 3, 5, 1, 1, "MCTX001"), (2, 2, 1, None, 1, 1, "MCTX001"), (3, 2, 2, 2, 0, 0, None)]
    assert read == [5]
