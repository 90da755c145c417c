"""The driver's tables seen as runs, images, deposits, logs, attempts, receipts and candidates.

Each view is an expression over one table, so its rows and work grow with that table. VIEWS_SQL is
the same for the engine that checks results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATUS = "CASE c_mktsegment WHEN 'BUILDING' THEN 'completed' WHEN 'AUTOMOBILE' THEN 'completed_with_errors' WHEN 'MACHINERY' THEN 'failed' WHEN 'HOUSEHOLD' THEN 'processing' ELSE 'uploaded' END"
#: 2024-01-01 in seconds; a run starts every ten minutes.
EPOCH = 1704067200
#: Spanish month names of the receipts.
MONTHS = ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre")
AS_OF_ORDERS, AS_OF_EVENTS = "2001-08-02", "2024-01-31"


#: Stages of trace_logs by event number, and its payload: expressions by name, null where the field is missing.
TRACE_STAGES = "WHEN 0 THEN 'ocr' WHEN 1 THEN 'llm_structuring' WHEN 2 THEN 'llm_structuring_auto_vision' WHEN 3 THEN 'heuristic_fallback_completed' WHEN 4 THEN 'candidate_record_validation' WHEN 5 THEN 'docx_image_limit_warning' ELSE 'persistence'"
PAYLOAD = {
    "status": "CASE event_type WHEN 'error' THEN CASE WHEN event_id % 3 = 0 THEN 'timeout' ELSE 'failed' END WHEN 'signup' THEN 'started' WHEN 'view' THEN NULL ELSE 'completed' END",
    "duration_ms": "CASE WHEN event_id % 9 > 0 THEN CAST(round(value * 100) AS BIGINT) END", "agent": "CASE WHEN event_id % 2 = 0 THEN concat('agent', event_id % 4) END", "attempt": "CASE WHEN event_id % 3 > 0 THEN event_id % 3 END",
    "decision": "CASE WHEN event_id % 8 = 0 THEN 'retry' END", "explicit_ocr_date": "CASE WHEN event_id % 3 = 0 THEN concat('1', event_id % 10, '/04/1998') END", "final_date_source": "CASE WHEN event_id % 11 = 0 THEN 'ocr_text' END",
    "llm_structured_records_count": "event_id % 4", "heuristic_records_count": "event_id % 3", "candidate_status": "CASE WHEN event_id % 2 = 0 THEN 'rejected' ELSE 'accepted' END", "candidate_id": "event_id",
    "records_count": "CASE WHEN event_id % 4 > 0 THEN event_id % 4 END", "error_class": "CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN 'TimeoutError' END", "error_message": "CASE WHEN event_type = 'error' AND event_id % 4 = 0 THEN 'model says no' END",
}


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(scan: DataFrame) -> DataFrame:
    """A scan of fewer parts than there are cores, dealt to all of them: what follows is bound by the processor, not by reading. Larger scans stay as they are."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def process_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = f"timestamp_seconds({EPOCH} + c_custkey * 600)"
    base = _t(spark, sf_dir, "customer").selectExpr(
        "CAST(c_custkey AS BIGINT) AS id", "concat(c_name, '.docx') AS original_filename", f"{STATUS} AS status", f"{at} AS created_at",
        "md5(CAST(c_custkey % 100 AS STRING)) AS document_hash", "c_custkey % 7 AS config_id", "concat('fp-', c_custkey % 3) AS fingerprint")
    started = F.when(F.col("status") != "uploaded", F.col("created_at") + F.expr("INTERVAL 10 SECONDS"))
    out = base.withColumn("started_at", started)
    done = F.col("status").isin("completed", "completed_with_errors", "failed")
    return out.withColumns({
        "finished_at": F.when(done, F.expr("timestampadd(SECOND, CAST(id % 97 + 1 AS INT), started_at)")),
        "error_message": F.when(F.col("status") == "failed", F.when(F.col("id") % 2 == 0, "ocr timeout").otherwise("llm failure")).otherwise("")})


def deposits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS id", "o_custkey AS process_run_id", "o_orderkey AS source_image_id", "CAST(o_orderkey % 9 + 1 AS INT) AS sequence_index",
        "date_format(o_orderdate, 'dd/MM/yyyy') AS fecha_consignacion", "CAST(o_orderdate AS DATE) AS fecha_date",
        "concat(lpad(CAST(o_orderkey % 24 AS STRING), 2, '0'), ':', lpad(CAST(o_orderkey % 60 AS STRING), 2, '0')) AS hora_consignacion",
        "concat('REF', lpad(CAST(o_orderkey AS STRING), 8, '0')) AS referencia", "CAST(o_totalprice AS DECIMAL(14,2)) AS valor",
        "CASE o_orderpriority WHEN '1-URGENT' THEN array('ok') WHEN '2-HIGH' THEN array('Fecha inválida') WHEN '3-MEDIUM' THEN CASE WHEN o_orderkey % 3 = 0 THEN array('Referencia ilegible') ELSE array('error en valor') END "
        "WHEN '4-NOT SPECIFIED' THEN array('Fecha fuera del periodo valido configurado', 'revisar') ELSE CAST(array() AS ARRAY<STRING>) END AS observations",
        "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderkey % 4 = 1 END AS is_current_month",
        # Deposits are stored up to 39 days after their date.
        "timestampadd(HOUR, CAST(o_orderkey % 940 AS INT), CAST(o_orderdate AS TIMESTAMP)) AS created_at")


def source_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS id", "o_custkey AS process_run_id", "CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT) AS sequence_index",
        "CASE WHEN o_orderkey % 50 = 0 THEN '' ELSE concat('images/', o_orderkey, '.png') END AS image_file", "concat('image', o_orderkey, '.png') AS source_name",
        "CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'processed' ELSE 'pending' END AS ocr_status",
        "CASE WHEN o_orderstatus = 'F' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'ocr timeout' ELSE 'llm failure' END ELSE '' END AS error_message",
        "o_orderkey % 4000000 AS image_bytes", "md5(CAST(o_orderkey % 5000 AS STRING)) AS content_hash",
        "CASE WHEN o_orderkey % 3 = 0 THEN date_format(o_orderdate, 'dd/MM/yyyy') END AS context_date")


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _t(spark, sf_dir, "events").selectExpr(
        "event_id AS id", "user_id AS process_run_id", "CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id % 1000 END AS source_image_id",
        "CASE event_type WHEN 'view' THEN 'ocr' WHEN 'signup' THEN 'ocr' WHEN 'purchase' THEN 'persistence' ELSE 'llm_structuring' END AS stage",
        "CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 3 = 0 THEN 'timeout' ELSE 'failed' END WHEN event_type = 'signup' THEN 'started' ELSE 'completed' END AS status",
        "CAST(round(value * 100) AS BIGINT) AS duration_ms", "event_type = 'error' AS is_error", "CAST(ts AS TIMESTAMP) AS created_at", "event_id % 4 AS records_count",
        "CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 3 = 0 THEN 'timeout calling model' ELSE 'model failure' END ELSE '' END AS notes")
    return out.withColumn("raw_payload", F.concat(F.lit('{"status":"'), "status", F.lit('","duration_ms":'), F.col("duration_ms").cast("string"), F.lit("}")))


def trace_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events again, with more stages and a payload of many fields, of which rows lack some."""
    out = _t(spark, sf_dir, "events").selectExpr(
        "event_id AS id", "user_id AS process_run_id", "CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id % 1000 END AS source_image_id", f"CASE event_id % 7 {TRACE_STAGES} END AS stage",
        "event_type = 'error' AS is_error", "CAST(ts AS TIMESTAMP) AS created_at", "CASE WHEN event_type = 'error' THEN concat('model failure ', event_id, repeat('!', 100)) WHEN event_id % 7 = 5 THEN 'many images' ELSE '' END AS notes",
        "CASE WHEN event_id % 3 = 0 THEN 'openai' ELSE '' END AS provider", f"named_struct({', '.join(f"'{k}', {v}" for k, v in PAYLOAD.items())}) AS payload")
    return out.withColumn("raw_payload", F.to_json("payload")).drop("payload")


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of an order as attempts on an image, each with no, one or two records."""
    order = "PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"
    one = "named_struct('referencia', concat(' ref', l_partkey % 3, ' '), 'valor', CAST(CAST(l_quantity % 2 AS INT) AS STRING))"
    two = "named_struct('referencia', concat('REF', l_suppkey % 3), 'valor', CAST(CAST(l_linenumber % 2 AS INT) AS STRING))"
    return _t(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS source_image_id", f"CAST(row_number() OVER ({order}) AS INT) AS attempt_number", "concat('s', l_linenumber % 3) AS strategy",
        "concat(' ref', l_partkey % 3, ' ') AS referencia", "CAST(CAST(l_quantity % 2 AS INT) AS STRING) AS valor", "round(l_discount * 10, 2) AS confidence",
        "CASE WHEN l_returnflag = 'R' THEN 'llm timeout' END AS error", "length(l_linestatus) + CAST(l_quantity AS INT) AS score",
        f"CASE CAST(l_quantity AS INT) % 3 WHEN 0 THEN slice(array({one}), 1, 0) WHEN 1 THEN array({one}) ELSE array({one}, {two}) END AS records")


def receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = spread(_t(spark, sf_dir, "orders")).selectExpr("o_orderkey AS id", "o_orderkey % 6 AS variant", "concat('M', lpad(CAST(o_orderkey AS STRING), 8, '0')) AS ref", "10000 + (o_orderkey % 100000) * 7 AS n",
                                               "date_format(o_orderdate, 'dd/MM/yyyy') AS day", "concat(lpad(CAST(o_orderkey % 24 AS STRING), 2, '0'), ':', lpad(CAST(o_orderkey % 60 AS STRING), 2, '0')) AS clock")
    k = k.withColumns({"money": F.expr("concat(n div 1000, '.', lpad(CAST(n % 1000 AS STRING), 3, '0'))"), "month": F.element_at(F.array(*[F.lit(m) for m in MONTHS]), (F.col("id") % 12 + 1).cast("int"))})
    text = F.expr(
        "CASE variant WHEN 0 THEN concat('Pago exitoso Nequi\\n¿Cuánto? $', money, ',00\\nFecha ', lpad(CAST(id % 28 + 1 AS STRING), 2, '0'), ' de ', month, ' de ', 2020 + id % 7, ' a las ', ltrim('0', clock), ' a. m.\\nReferencia ', ref, '\\nNúmero Nequi 317036520') "
        "WHEN 1 THEN concat('Comprobante de pago banco\\n', CASE WHEN id % 8 < 4 THEN 'Valor' ELSE 'Monto' END, ' $ ', money, CASE WHEN id % 4 = 1 THEN ',50' ELSE '' END, '\\nFecha ', day, ' ', clock, '\\nReferencia: ', ref) "
        "WHEN 2 THEN concat('Referencia ', ref, ' Valor 2026 Fecha 01 ABRIL 2026') WHEN 3 THEN concat('Referencia ', ref, ' Valor 1149 Fecha 01 ABRIL 2026') "
        "WHEN 4 THEN concat('Referencia ', ref, ' Valor 3176771287 Numero Nequi 3176771287') ELSE concat('Fecha de proceso: ', day, '  Importe Total: ', money, ',00 Referencia ', ref) END")
    return k.select("id", "variant", "ref", "n", "day", "clock", text.alias("text"))


def candidates(spark: SparkSession, sf_dir: str, images: DataFrame | None = None) -> DataFrame:
    """Competing records of one image: the lines of an order, in several spellings, some without date or time. With images (source_image_id) those of these images only."""
    order = "PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"
    # What follows from the columns is made after the lines have met, so that only columns of the table are moved and sorted.
    lines = _t(spark, sf_dir, "lineitem")
    if images is not None:
        # Lines of other images go before the rest are sorted: an image has all its lines or none, so idx stays the same.
        lines = lines.join(images.select(F.col("source_image_id").alias("l_orderkey")), "l_orderkey", "left_semi")
    rows = lines.select("*", F.expr(f"CAST(row_number() OVER ({order}) AS INT) AS idx")).selectExpr(
        "l_orderkey AS source_image_id", "md5(CAST(l_orderkey AS STRING)) AS content_hash", "idx", "date_add(DATE '2026-01-01', CAST(l_orderkey % 90 AS INT)) AS day",
        "(l_orderkey % 40 + 1) * 2500 + CASE WHEN l_partkey % 4 = 0 THEN 10000 ELSE 0 END AS n", "l_partkey AS p", "l_suppkey AS s", "CAST(l_quantity AS INT) AS q", "l_linenumber AS k", "l_discount AS confidence")
    return rows.selectExpr(
        "source_image_id", "content_hash", "idx", "CASE p % 3 WHEN 0 THEN NULL WHEN 1 THEN date_format(day, 'dd/MM/yyyy') ELSE CAST(day AS STRING) END AS fecha_consignacion",
        "CASE WHEN s % 2 = 0 THEN '' ELSE concat(7 + s % 3, ':', lpad(CAST(source_image_id % 60 AS STRING), 2, '0')) END AS hora_consignacion",
        "CASE k % 3 WHEN 0 THEN concat(' ref', source_image_id % 7 + 100, ' ') WHEN 1 THEN concat('REF', source_image_id % 7 + 100) ELSE concat('Ref', source_image_id % 7 + 100) END AS referencia",
        "CASE q % 6 WHEN 0 THEN concat('$', n div 1000, '.', lpad(CAST(n % 1000 AS STRING), 3, '0'), ',00') WHEN 1 THEN concat(n, '.00') WHEN 2 THEN concat(n div 1000, ',', lpad(CAST(n % 1000 AS STRING), 3, '0'), '.00') "
        "WHEN 3 THEN concat(n div 1000, '.', lpad(CAST(n % 1000 AS STRING), 3, '0')) WHEN 4 THEN concat('COP ', n) ELSE NULL END AS valor", "confidence")


def keyed_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deposits as rows of corrections, some of which do not hold."""
    return deposits(spark, sf_dir).select(
        "id", F.expr("CASE WHEN id % 3 = 0 THEN '' WHEN id % 3 = 2 AND id % 5 = 0 THEN '22.04.2026' ELSE '22/04/2026' END").alias("fecha_consignacion"), F.expr("CASE WHEN id % 4 > 0 THEN '3:45 pm' END").alias("hora_consignacion"),
        F.expr("CASE WHEN id % 11 = 0 THEN 'R7' ELSE referencia END").alias("referencia"), F.expr("CASE WHEN id % 13 = 0 THEN -5 ELSE valor END").alias("valor"))


VIEWS_SQL = f"""
process_runs AS (
  SELECT *, CASE WHEN status IN ('completed', 'completed_with_errors', 'failed') THEN started_at + to_seconds(id % 97 + 1) END AS finished_at,
         CASE WHEN status = 'failed' THEN CASE WHEN id % 2 = 0 THEN 'ocr timeout' ELSE 'llm failure' END ELSE '' END AS error_message
  FROM (SELECT *, CASE WHEN status <> 'uploaded' THEN created_at + to_seconds(10) END AS started_at FROM (
    SELECT c_custkey::BIGINT AS id, c_name || '.docx' AS original_filename, {STATUS} AS status, TIMESTAMP '2024-01-01' + to_seconds(c_custkey * 600) AS created_at,
           md5((c_custkey % 100)::VARCHAR) AS document_hash, c_custkey % 7 AS config_id, 'fp-' || (c_custkey % 3) AS fingerprint FROM customer))
), deposits AS (
  SELECT o_orderkey AS id, o_custkey AS process_run_id, o_orderkey AS source_image_id, (o_orderkey % 9 + 1)::INT AS sequence_index, strftime(o_orderdate, '%d/%m/%Y') AS fecha_consignacion,
         o_orderdate::DATE AS fecha_date, lpad((o_orderkey % 24)::VARCHAR, 2, '0') || ':' || lpad((o_orderkey % 60)::VARCHAR, 2, '0') AS hora_consignacion,
         'REF' || lpad(o_orderkey::VARCHAR, 8, '0') AS referencia, o_totalprice::DECIMAL(14,2) AS valor,
         CASE o_orderpriority WHEN '1-URGENT' THEN ['ok'] WHEN '2-HIGH' THEN ['Fecha inválida'] WHEN '3-MEDIUM' THEN CASE WHEN o_orderkey % 3 = 0 THEN ['Referencia ilegible'] ELSE ['error en valor'] END
              WHEN '4-NOT SPECIFIED' THEN ['Fecha fuera del periodo valido configurado', 'revisar'] ELSE []::VARCHAR[] END AS observations,
         CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderkey % 4 = 1 END AS is_current_month, o_orderdate::TIMESTAMP + to_hours((o_orderkey % 940)::INT) AS created_at FROM orders
), source_images AS (
  SELECT o_orderkey AS id, o_custkey AS process_run_id, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey))::INT AS sequence_index,
         CASE WHEN o_orderkey % 50 = 0 THEN '' ELSE 'images/' || o_orderkey || '.png' END AS image_file, 'image' || o_orderkey || '.png' AS source_name,
         CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'processed' ELSE 'pending' END AS ocr_status,
         CASE WHEN o_orderstatus = 'F' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'ocr timeout' ELSE 'llm failure' END ELSE '' END AS error_message,
         o_orderkey % 4000000 AS image_bytes, md5((o_orderkey % 5000)::VARCHAR) AS content_hash,
         CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%d/%m/%Y') END AS context_date FROM orders
), logs AS (
  SELECT event_id AS id, user_id AS process_run_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id % 1000 END AS source_image_id,
         CASE event_type WHEN 'view' THEN 'ocr' WHEN 'signup' THEN 'ocr' WHEN 'purchase' THEN 'persistence' ELSE 'llm_structuring' END AS stage,
         CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 3 = 0 THEN 'timeout' ELSE 'failed' END WHEN event_type = 'signup' THEN 'started' ELSE 'completed' END AS status,
         round(value * 100)::BIGINT AS duration_ms, event_type = 'error' AS is_error, ts::TIMESTAMP AS created_at, event_id % 4 AS records_count,
         CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 3 = 0 THEN 'timeout calling model' ELSE 'model failure' END ELSE '' END AS notes FROM events
), trace_logs AS (
  SELECT event_id AS id, user_id AS process_run_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id % 1000 END AS source_image_id, CASE event_id % 7 {TRACE_STAGES} END AS stage, event_type = 'error' AS is_error, ts::TIMESTAMP AS created_at,
         CASE WHEN event_type = 'error' THEN 'model failure ' || event_id || repeat('!', 100) WHEN event_id % 7 = 5 THEN 'many images' ELSE '' END AS notes, CASE WHEN event_id % 3 = 0 THEN 'openai' ELSE '' END AS provider,
         {', '.join(f"{v} AS {k}" for k, v in PAYLOAD.items())} FROM events
), attempts AS (
  SELECT l_orderkey AS source_image_id,
         (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate))::INT AS attempt_number,
         's' || (l_linenumber % 3) AS strategy, ' ref' || (l_partkey % 3) || ' ' AS referencia, ((l_quantity % 2)::INT)::VARCHAR AS valor, round(l_discount * 10, 2) AS confidence,
         CASE WHEN l_returnflag = 'R' THEN 'llm timeout' END AS error, length(l_linestatus) + l_quantity::INT AS score,
         list_slice([{{'referencia': ' ref' || (l_partkey % 3) || ' ', 'valor': ((l_quantity % 2)::INT)::VARCHAR}}, {{'referencia': 'REF' || (l_suppkey % 3), 'valor': (l_linenumber % 2)::VARCHAR}}], 1, l_quantity::INT % 3) AS records FROM lineitem
), receipts AS (
  SELECT o_orderkey AS id, o_orderkey % 6 AS variant, 'M' || lpad(o_orderkey::VARCHAR, 8, '0') AS ref, 10000 + (o_orderkey % 100000) * 7 AS n, strftime(o_orderdate, '%d/%m/%Y') AS day,
         lpad((o_orderkey % 24)::VARCHAR, 2, '0') || ':' || lpad((o_orderkey % 60)::VARCHAR, 2, '0') AS clock,
         (n // 1000) || '.' || lpad((n % 1000)::VARCHAR, 3, '0') AS money,
         CASE variant WHEN 0 THEN 'Pago exitoso Nequi' || chr(10) || '¿Cuánto? $' || money || ',00' || chr(10) || 'Fecha ' || lpad((id % 28 + 1)::VARCHAR, 2, '0') || ' de ' || ({list(MONTHS)})[(id % 12 + 1)::INT] || ' de ' || (2020 + id % 7) || ' a las ' || ltrim(clock, '0') || ' a. m.' || chr(10) || 'Referencia ' || ref || chr(10) || 'Número Nequi 317036520'
           WHEN 1 THEN 'Comprobante de pago banco' || chr(10) || CASE WHEN id % 8 < 4 THEN 'Valor' ELSE 'Monto' END || ' $ ' || money || CASE WHEN id % 4 = 1 THEN ',50' ELSE '' END || chr(10) || 'Fecha ' || day || ' ' || clock || chr(10) || 'Referencia: ' || ref
           WHEN 2 THEN 'Referencia ' || ref || ' Valor 2026 Fecha 01 ABRIL 2026' WHEN 3 THEN 'Referencia ' || ref || ' Valor 1149 Fecha 01 ABRIL 2026'
           WHEN 4 THEN 'Referencia ' || ref || ' Valor 3176771287 Numero Nequi 3176771287' ELSE 'Fecha de proceso: ' || day || '  Importe Total: ' || money || ',00 Referencia ' || ref END AS text FROM orders
), parsed AS (
  SELECT id, variant, CASE WHEN taken THEN value END AS value, 4 + CASE WHEN contains(text, '$') THEN 2 ELSE 0 END AS score, CASE WHEN taken THEN ref_found END AS referencia, CASE WHEN NOT taken THEN 'missing_transaction_amount' END AS reason,
         CASE WHEN taken THEN lpad(nullif(regexp_extract(text, '[0-9]{{1,2}}:[0-9]{{2}}'), ''), 5, '0') END AS hora,
         CASE WHEN taken THEN CASE WHEN named[2] <> '' THEN lpad(named[1], 2, '0') || '/' || lpad(list_position({list(MONTHS)}, lower(named[2]))::VARCHAR, 2, '0') || '/' || named[3] ELSE regexp_extract(text, '[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}') END END AS fecha
  FROM (SELECT *, NOT (floor(value) BETWEEN 1900 AND 2100 OR length(digits) IN (3, 4) AND digits[1:-3]::INT <= 23 AND digits[-2:]::INT <= 59 OR length(digits) IN (9, 10) AND digits[1] = '3') AS taken FROM (
    SELECT *, regexp_replace(amount, '[^0-9]', '', 'g') AS digits, [regexp_extract(text, names, 1), regexp_extract(text, names, 2), regexp_extract(text, names, 3)] AS named, regexp_extract(text, 'Referencia:? (M[0-9]+)', 1) AS ref_found,
           CASE WHEN contains(amount, ',') AND contains(amount, '.') THEN replace(replace(amount, '.', ''), ',', '.') WHEN contains(amount, '.') THEN replace(amount, '.', '') ELSE amount END::DOUBLE AS value
    FROM (SELECT *, '(?i)([0-9]{{1,2}}) (?:de )?({'|'.join(MONTHS)}) (?:de )?([0-9]{{4}})' AS names, regexp_extract(text, '(?:Cuánto\\?|Valor|Monto|Importe Total:) *\\$? *([0-9][0-9.,]*)', 1) AS amount FROM receipts)))
), candidates AS (
  SELECT source_image_id, content_hash, idx, CASE p % 3 WHEN 0 THEN NULL WHEN 1 THEN strftime(day, '%d/%m/%Y') ELSE day::VARCHAR END AS fecha_consignacion,
         CASE WHEN s % 2 = 0 THEN '' ELSE (7 + s % 3) || ':' || lpad((source_image_id % 60)::VARCHAR, 2, '0') END AS hora_consignacion,
         CASE k % 3 WHEN 0 THEN ' ref' || (source_image_id % 7 + 100) || ' ' WHEN 1 THEN 'REF' || (source_image_id % 7 + 100) ELSE 'Ref' || (source_image_id % 7 + 100) END AS referencia,
         CASE q % 6 WHEN 0 THEN '$' || (n // 1000) || '.' || lpad((n % 1000)::VARCHAR, 3, '0') || ',00' WHEN 1 THEN n || '.00' WHEN 2 THEN (n // 1000) || ',' || lpad((n % 1000)::VARCHAR, 3, '0') || '.00'
                    WHEN 3 THEN (n // 1000) || '.' || lpad((n % 1000)::VARCHAR, 3, '0') WHEN 4 THEN 'COP ' || n ELSE NULL END AS valor, confidence
  FROM (SELECT l_orderkey AS source_image_id, md5(l_orderkey::VARCHAR) AS content_hash,
         (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate))::INT AS idx,
         DATE '2026-01-01' + (l_orderkey % 90)::INT AS day, (l_orderkey % 40 + 1) * 2500 + CASE WHEN l_partkey % 4 = 0 THEN 10000 ELSE 0 END AS n, l_partkey AS p, l_suppkey AS s, l_quantity::INT AS q, l_linenumber AS k, l_discount AS confidence FROM lineitem)
), keyed AS (
  SELECT *, CASE WHEN n_valor IS NULL THEN '' ELSE 'v1:' || sha256(concat_ws('|', content_hash, n_fecha, n_hora, n_valor::VARCHAR, n_ref)) END AS canonical_key,
         CASE WHEN n_valor IS NULL THEN '' ELSE 'v1:' || sha256(concat_ws('|', content_hash, n_valor::VARCHAR, n_ref)) END AS loose_key
  FROM (SELECT *, CASE WHEN contains(t, ',') AND contains(t, '.') THEN CASE WHEN strpos(reverse(t), ',') < strpos(reverse(t), '.') THEN replace(replace(t, '.', ''), ',', '.') ELSE replace(t, ',', '') END
                       WHEN contains(t, ',') THEN CASE WHEN strpos(reverse(t), ',') IN (2, 3) THEN replace(t, ',', '.') ELSE replace(t, ',', '') END
                       WHEN contains(t, '.') THEN CASE WHEN strpos(reverse(t), '.') IN (2, 3) THEN t ELSE replace(t, '.', '') END ELSE t END::DECIMAL(14,2) AS n_valor
        FROM (SELECT *, nullif(regexp_replace(valor, '[^0-9,.-]', '', 'g'), '') AS t, upper(trim(referencia)) AS n_ref,
                     coalesce(CASE WHEN contains(fecha_consignacion, '/') THEN strptime(fecha_consignacion, '%d/%m/%Y')::DATE::VARCHAR ELSE fecha_consignacion END, '') AS n_fecha,
                     CASE WHEN hora_consignacion = '' THEN '' ELSE lpad(hora_consignacion, 5, '0') END AS n_hora FROM candidates))
)"""
