"""Queries of parts, orders, quizzes, certificates, plans and streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from evspark.operators import maintenance, parts, plan_items, training
from evspark.suite.inputs import table


def _parts(s, sf):
    p = table(s, sf, "part")
    nxt = F.lead("p_partkey").over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    return p.withColumn("next", nxt).select(
        F.concat(F.lit("P"), F.col("p_partkey")).alias("code"), F.col("p_name").alias("part"), F.col("p_partkey").alias("ordinal"), F.col("p_retailprice").cast("decimal(18,2)").alias("price"), (F.col("p_size") % 9).alias("stock"), F.col("p_brand").alias("device_model"), F.col("p_type").alias("spec"), F.lit("A").alias("location"),
        F.when(F.col("next").isNull(), F.array().cast("array<struct<code:string,basis:string>>")).otherwise(F.array(F.struct(F.concat(F.lit("P"), F.col("next")).alias("code"), F.when(F.col("next") % 3 == 0, "").otherwise("same fit").alias("basis")))).alias("substitutes"),
        F.when(F.col("p_partkey") % 4 == 0, F.array(F.struct(F.concat(F.lit("P"), F.col("p_partkey") + 1).alias("part"), F.lit("other seal").alias("reason")))).alias("forbidden"),
    )


PARTS = """pt AS (SELECT 'P' || p_partkey AS code, p_name AS part, p_partkey AS ordinal, p_retailprice::DECIMAL(18,2) AS price, p_size % 9 AS stock, p_brand AS device_model, p_type AS spec, lead(p_partkey) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS nxt FROM part),
sub AS (SELECT 'p' || nxt AS substitute, code, CASE WHEN nxt % 3 = 0 THEN NULL ELSE 'same fit' END AS basis FROM pt WHERE nxt IS NOT NULL)"""


def _items(s, sf):
    i = table(s, sf, "lineitem")
    return i.select(F.col("l_orderkey").alias("order_id"), F.concat(F.lit("p"), F.when(F.col("l_linenumber") == 7, -1).otherwise(F.col("l_partkey")).cast("string")).alias("code"), (F.col("l_quantity").cast("int") - 1).alias("qty"), (F.col("l_linenumber") % 3 == 0).alias("is_substitute"))


def _resolved(s, sf):
    return parts.resolve_order_items(_items(s, sf), _parts(s, sf), parts.substitute_lookup(_parts(s, sf)))


ITEMS = PARTS + """,
li AS (SELECT l_orderkey AS order_id, 'p' || CASE WHEN l_linenumber = 7 THEN -1 ELSE l_partkey END AS code, l_quantity::INT - 1 AS qty, l_linenumber % 3 = 0 AS is_substitute FROM lineitem),
rs AS (SELECT li.*, pt.price AS unit_price, s.basis AS sb, s.substitute IS NOT NULL AS has, CASE WHEN qty < 1 THEN 'qty' WHEN pt.code IS NULL THEN 'unknown code' WHEN is_substitute AND s.basis IS NULL THEN 'no basis' END AS reject
  FROM li LEFT JOIN pt ON lower(pt.code) = li.code LEFT JOIN (SELECT substitute, max(basis) AS basis FROM sub GROUP BY 1) s ON s.substitute = li.code),
ri AS (SELECT order_id, code, qty, is_substitute, unit_price, CASE WHEN reject IS NULL THEN (qty * unit_price)::DECIMAL(18,2) END AS amount, CASE WHEN has AND is_substitute THEN sb END AS basis, reject FROM rs)"""


def _orders(s, sf):
    status = F.when(F.col("o_orderstatus") == "P", "submitted").when(F.col("o_orderstatus") == "O", "approved").otherwise("received")
    return table(s, sf, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_orderdate").cast("timestamp").alias("created_at"), status.alias("status"), F.col("o_totalprice").cast("decimal(18,2)").alias("total"))


def _steps(s, sf):
    action = F.element_at(F.create_map(*[F.lit(x) for kv in {"view": "submit", "signup": "approve", "click": "receive", "error": "reject", "purchase": "cancel"}.items() for x in kv]), F.col("event_type"))
    return table(s, sf, "events").select((F.col("event_id") % 3001).alias("order_id"), F.col("event_id").alias("seq"), action.alias("action"), F.lit("r").alias("reason"))


STEPS = """st AS (SELECT event_id % 3001 AS order_id, event_id AS seq, CASE event_type WHEN 'view' THEN 'submit' WHEN 'signup' THEN 'approve' WHEN 'click' THEN 'receive' WHEN 'error' THEN 'reject' ELSE 'cancel' END AS action FROM events),
os AS (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY seq) AS n FROM st),
walk AS (WITH RECURSIVE w AS (SELECT order_id, seq, action, n, CASE action WHEN 'submit' THEN 'submitted' WHEN 'cancel' THEN 'cancelled' ELSE 'draft' END AS status, action IN ('submit', 'cancel') AS legal FROM os WHERE n = 1
  UNION ALL SELECT os.order_id, os.seq, os.action, os.n, coalesce(t.to_status, w.status), t.to_status IS NOT NULL FROM w JOIN os ON os.order_id = w.order_id AND os.n = w.n + 1
  LEFT JOIN (VALUES ('draft', 'submit', 'submitted'), ('draft', 'cancel', 'cancelled'), ('submitted', 'approve', 'approved'), ('submitted', 'reject', 'rejected'), ('submitted', 'cancel', 'cancelled'), ('approved', 'receive', 'received'), ('approved', 'reject', 'rejected')) t(from_status, act, to_status) ON t.from_status = w.status AND t.act = os.action) SELECT * FROM w)"""


def _cart(s, sf):
    e = table(s, sf, "events")
    action = F.when(F.col("event_type") == "purchase", "set").when(F.col("event_type") == "error", "remove").when((F.col("event_type") == "signup") & (F.col("event_id") % 50 == 0), "submit").otherwise("add")
    return e.select((F.col("event_id") % 701).alias("order_id"), F.col("event_id").alias("seq"), action.alias("action"), F.concat(F.lit("c"), F.col("user_id") % 3).alias("code"), F.col("value").cast("int").alias("qty"))


CART = """ev AS (SELECT event_id % 701 AS order_id, event_id AS seq, CASE WHEN event_type = 'purchase' THEN 'set' WHEN event_type = 'error' THEN 'remove' WHEN event_type = 'signup' AND event_id % 50 = 0 THEN 'submit' ELSE 'add' END AS action,
  'c' || (user_id % 3) AS code, trunc(value)::BIGINT AS x, coalesce(min(CASE WHEN event_type = 'signup' AND event_id % 50 = 0 THEN event_id END) OVER (PARTITION BY event_id % 701), 9223372036854775807) AS done FROM events),
ed AS (SELECT order_id, seq, action, code, least(999, greatest(1, coalesce(x, 1))) AS x, row_number() OVER (PARTITION BY order_id, code ORDER BY seq) AS n FROM ev WHERE action <> 'submit' AND seq < done),
walk AS (WITH RECURSIVE w AS (SELECT order_id, code, seq, n, CASE WHEN action = 'add' THEN x ELSE 0 END AS q, action <> 'add' AS missing FROM ed WHERE n = 1
  UNION ALL SELECT ed.order_id, ed.code, ed.seq, ed.n, CASE WHEN ed.action = 'add' THEN least(999, q + x) WHEN ed.action = 'set' AND q > 0 THEN x ELSE 0 END, ed.action <> 'add' AND q = 0 FROM w JOIN ed ON ed.order_id = w.order_id AND ed.code = w.code AND ed.n = w.n + 1) SELECT * FROM w)"""


def _sentences(s, sf):
    p = table(s, sf, "part")
    return p.select(F.col("p_partkey").alias("chunk_id"), F.concat_ws("", F.lit("- "), "p_name", F.lit(" needs "), F.col("p_size").cast("string"), F.lit(" bolts and "), (F.col("p_size") + 3).cast("string"), F.lit(" rings and "), (F.col("p_size") + 7).cast("string"), F.lit(" pins。 Short 。 type X-"), F.col("p_size").cast("string"), F.lit(" is plain and without。")).alias("text"))


def _clauses(s, sf):
    unit = F.when(F.col("p_partkey") % 3 == 0, " 小时").when(F.col("p_partkey") % 3 == 1, " 万片").otherwise(" 个月")
    return table(s, sf, "part").select(F.col("p_partkey").alias("chunk_id"), F.when(F.col("p_partkey") % 7 == 0, "通用").otherwise(F.col("p_brand")).alias("device_model"), F.concat_ws("", "p_name", F.lit("每 "), F.col("p_size").cast("string"), unit, F.lit("更换；滤芯累计 500 小时清洗。"), F.when(F.col("p_partkey") % 5 == 0, "记录保存 3 年并检查。").otherwise("备用。")).alias("text"))


def _plans(s, sf):
    p = table(s, sf, "part")
    basis = F.when(F.col("p_partkey") % 3 == 0, "hours").when(F.col("p_partkey") % 3 == 1, "wafers").otherwise("days")
    x = maintenance.due_calc(basis, F.col("p_size") * 10.0, F.col("p_retailprice") / 10, F.when(F.col("p_partkey") % 4 == 0, F.col("p_size") * 3.0), F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("device_model"), basis.alias("basis"), (F.col("p_size") * 10.0).alias("cycle"), (F.col("p_size") * 1.0).alias("baseline"), x.alias("x")).select("id", "device_model", "basis", "cycle", "baseline", "x.*")


PLANS = """pl AS (SELECT p_partkey AS id, p_brand AS device_model, CASE p_partkey % 3 WHEN 0 THEN 'hours' WHEN 1 THEN 'wafers' ELSE 'days' END AS basis, p_size * 10.0::DOUBLE AS cycle, p_size::DOUBLE AS baseline,
  CASE WHEN p_partkey % 3 = 2 THEN p_size * 10.0::DOUBLE ELSE p_size * 10.0::DOUBLE - CASE WHEN p_partkey % 4 = 0 THEN p_size * 3.0::DOUBLE ELSE p_retailprice / 10 END END AS rem FROM part),
pd AS (SELECT id, device_model, basis, cycle, baseline, round(rem, 4) AS remaining, CASE WHEN basis = 'days' THEN TIMESTAMP '2024-01-01' + to_seconds(round(cycle * 86400)::BIGINT) WHEN basis = 'hours' THEN TIMESTAMP '2024-01-01' + to_seconds(round(greatest(0, rem) / 24 * 86400)::BIGINT) END AS due_at, CASE WHEN rem <= 0 THEN 'due' ELSE 'pending' END AS status FROM pl)"""


def _attempts(s, sf):
    o = table(s, sf, "orders")
    return o.select(F.col("o_orderkey").alias("attempt_id"), F.concat(F.lit("t"), F.col("o_custkey")).alias("trainee"), (F.col("o_totalprice").cast("long") % 101 >= 60).alias("passed"), F.col("o_orderdate").cast("timestamp").alias("issued_at"))


def _certificates(s, sf):
    a = _attempts(s, sf).filter("passed")
    return a.select(F.col("attempt_id").alias("id"), "trainee", F.when(F.col("attempt_id") % 11 == 0, "revoked").otherwise("valid").alias("status"), (F.col("issued_at") + F.expr("INTERVAL 365 DAYS")).alias("expires_at"))


def _manual(s, sf):
    """Sentences of manuals with listed items and others, each with one or two cycles."""
    n = F.col("p_size").cast("string")
    kind = F.col("p_partkey") % 6
    text = (
        F.when(kind == 0, F.concat(F.lit("排气过滤器每 "), n, F.lit(" 小时更换；消音器每 8000 小时检查。")))
        .when(kind == 1, F.concat(F.lit("MFC 每 "), n, F.lit(" 年校准。")))
        .when(kind == 2, F.concat(F.lit("换油周期为 "), n, F.lit("00 小时或每 12 个月，以先到者为准。")))
        .when(kind == 3, F.concat(F.lit("真空泵，轴封（外侧）每 "), n, F.lit(" 个月检查。")))
        .when(kind == 4, F.concat(F.lit("绝缘手套每 "), n, F.lit(" 个月试验。")))
        .otherwise(F.concat(F.lit("压力表：每 "), n, F.lit(" 天校验；安全带每 6 个月更换。")))
    )
    scope = F.when(F.col("p_partkey") % 7 == 0, "通用").otherwise(F.col("p_brand"))
    return table(s, sf, "part").select(F.col("p_partkey").alias("chunk_id"), scope.alias("device_model"), text.alias("text"))


MANUAL = """pp AS (SELECT p_partkey AS chunk_id, CASE WHEN p_partkey % 7 = 0 THEN '通用' ELSE p_brand END AS scope, p_partkey % 6 AS k, p_size AS x FROM part),
cy AS (
  SELECT chunk_id, scope, 0 AS clause_no, 1 AS rank, '干泵排气过滤器更换' AS listed, '排气过滤器' AS item, '耗材更换' AS kind, 'hours' AS basis, x::DOUBLE AS value, x || ' 小时' AS raw, '' AS more, 1 AS main FROM pp WHERE k = 0
  UNION ALL SELECT chunk_id, scope, 1, 7, '消音器检查', '消音器', 'PM 项', 'hours', 8000, '8000 小时', '', 1 FROM pp WHERE k = 0
  UNION ALL SELECT chunk_id, scope, 0, 9, '质量流量控制器（MFC）校准', 'MFC校准', '校准', 'days', x * 365, x || ' 年', '年=365', 1 FROM pp WHERE k = 1
  UNION ALL SELECT chunk_id, scope, 0, 2, '罗茨泵换油', '换油周期为 ' || x || '00 小时或每 12 个月', '耗材更换', 'hours', x * 100, x || '00 小时', '', 1 FROM pp WHERE k = 2
  UNION ALL SELECT chunk_id, scope, 0, NULL, NULL, '换油周期为 ' || x || '00 小时或每 12 个月', '耗材更换', 'days', 360, '12 个月', '个月=30', 0 FROM pp WHERE k = 2
  UNION ALL SELECT chunk_id, scope, 0, 15, NULL, CASE WHEN x < 10 THEN '轴封检查' ELSE '轴封' END, 'PM 项', 'days', x * 30, x || ' 个月', '个月=30', 1 FROM pp WHERE k = 3
  UNION ALL SELECT chunk_id, scope, 0, 15, NULL, '绝缘手套', '安全检查', 'days', x * 30, x || ' 个月', '个月=30', 1 FROM pp WHERE k = 4
  UNION ALL SELECT chunk_id, scope, 0, 15, NULL, '压力表校验', '校准', 'days', x, x || ' 天', '', 1 FROM pp WHERE k = 5
  UNION ALL SELECT chunk_id, scope, 1, 15, NULL, '安全带更换', '耗材更换', 'days', 180, '6 个月', '个月=30', 1 FROM pp WHERE k = 5)"""


def _found(s, sf):
    return plan_items.located(_manual(s, sf))


def _now():
    return F.lit("1998-06-01 00:00:00").cast("timestamp")


QUERIES = {
    "b1_match_parts": (lambda s, sf: parts.match_parts(table(s, sf, "benchmark").select(F.col("item_id").alias("request_id"), F.concat(F.lit("p"), F.col("item_id") * 7 % 300).alias("text")), _parts(s, sf)), f"""WITH {PARTS}, q AS (SELECT item_id AS request_id, 'p' || (item_id * 7 % 300) AS t FROM benchmark),
      h AS (SELECT request_id, code, ordinal, CASE WHEN lower(code) = t THEN 0 WHEN contains(lower(code), t) THEN 1 WHEN contains(lower(part), t) OR contains(t, lower(part)) THEN 2 END AS level FROM q, pt) SELECT request_id, code, level FROM h WHERE level IS NOT NULL QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY level, ordinal) = 1"""),
    "b2_part_availability": (lambda s, sf: parts.part_availability(_parts(s, sf)).withColumn("substitutes", F.array_join("substitutes", ",")).withColumn("forbidden", F.array_join("forbidden", ",")), f"WITH {PARTS} SELECT code, CASE WHEN stock <= 5 THEN 'low' ELSE 'ok' END AS stock_state, price, CASE WHEN nxt % 3 <> 0 THEN 'P' || nxt ELSE '' END AS substitutes, CASE WHEN nxt % 3 = 0 THEN 1 ELSE 0 END AS without_basis, CASE WHEN ordinal % 4 = 0 THEN '禁止替代：P' || (ordinal + 1) || ' —— other seal' ELSE '' END AS forbidden FROM pt"),
    "b3_substitute_lookup": (lambda s, sf: parts.substitute_lookup(_parts(s, sf)), f"WITH {PARTS} SELECT * FROM sub"),
    "b4_catalog": (lambda s, sf: parts.catalog(_parts(s, sf), None, "p12").select("code", "part"), f"WITH {PARTS} SELECT code, part FROM pt WHERE contains(lower(part), 'p12') OR contains(lower(code), 'p12') OR contains(lower(spec), 'p12')"),
    "b5_resolve_order_items": (_resolved, f"WITH {ITEMS} SELECT * FROM ri"),
    "b6_order_totals": (lambda s, sf: parts.order_totals(_resolved(s, sf).filter("reject IS NULL")), f"WITH {ITEMS} SELECT order_id, sum(amount)::DECIMAL(18,2) AS total FROM ri WHERE reject IS NULL GROUP BY 1"),
    "b7_assign_order_no": (lambda s, sf: parts.assign_order_no(_orders(s, sf)).select("order_id", "order_no"), "SELECT o_orderkey AS order_id, 'PO-' || strftime(o_orderdate, '%Y%m%d') || '-' || lpad(row_number() OVER (PARTITION BY strftime(o_orderdate, '%Y%m%d') ORDER BY o_orderdate, o_orderkey)::VARCHAR, 4, '0') AS order_no FROM orders"),
    "b8_fold_cart": (lambda s, sf: parts.fold_cart(_cart(s, sf)), f"WITH {CART} SELECT order_id, code, arg_max(q, n) AS qty FROM walk GROUP BY 1, 2 HAVING arg_max(q, n) > 0"),
    "b8_rejected_edits": (lambda s, sf: parts.rejected_edits(_cart(s, sf)), f"WITH {CART} SELECT order_id, seq, 'no such item' AS reject FROM walk WHERE missing UNION ALL SELECT order_id, seq, 'not a draft' FROM ev WHERE action <> 'submit' AND seq > done"),
    "b8_cart_totals": (lambda s, sf: parts.cart_totals(parts.fold_cart(_cart(s, sf).withColumn("code", F.regexp_replace("code", "c", "p"))), _parts(s, sf)), f"WITH {CART}, {PARTS}, c AS (SELECT order_id, code, arg_max(q, n) AS qty FROM walk GROUP BY 1, 2) SELECT order_id, sum(coalesce(qty * price, 0))::DECIMAL(18,2) AS total FROM c LEFT JOIN pt ON lower(pt.code) = replace(c.code, 'c', 'p') WHERE qty > 0 GROUP BY 1"),
    "b9_fold_order_status": (lambda s, sf: parts.fold_order_status(_steps(s, sf)).select("order_id", "status", F.size("accepted").alias("accepted"), F.size("rejected").alias("rejected")), f"WITH {STEPS} SELECT order_id, arg_max(status, n) AS status, count(*) FILTER (legal) AS accepted, count(*) FILTER (NOT legal) AS rejected FROM walk GROUP BY 1"),
    "b10_settle": (lambda s, sf: parts.settle(_orders(s, sf), table(s, sf, "lineitem").filter("l_linenumber < 3").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_extendedprice").alias("l_extendedprice")).select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("request_id"), F.col("l_orderkey").alias("order_id"), F.when(F.col("l_linenumber") == 1, F.lit(None)).otherwise(F.col("l_extendedprice")).cast("decimal(18,2)").alias("amount")), _orders(s, sf).filter("order_id % 5 = 0")), """
      WITH o AS (SELECT o_orderkey AS order_id, o_totalprice::DECIMAL(18,2) AS total FROM orders WHERE o_orderstatus <> 'P'), r AS (SELECT l_orderkey * 10 + l_linenumber AS request_id, l_orderkey AS order_id, CASE WHEN l_linenumber <> 1 THEN l_extendedprice::DECIMAL(18,2) END AS amount, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS n FROM (SELECT l_orderkey, l_linenumber, max(l_extendedprice) AS l_extendedprice FROM lineitem WHERE l_linenumber < 3 GROUP BY 1, 2)),
      j AS (SELECT request_id, r.order_id, amount, total, CASE WHEN total IS NULL THEN 'status' WHEN r.order_id % 5 = 0 OR n > 1 THEN 'settled already' END AS reject FROM r LEFT JOIN o ON o.order_id = r.order_id)
      SELECT request_id, order_id, CASE WHEN reject IS NULL THEN coalesce(amount, total) END AS settled, reject FROM j"""),
    "b11_settlement_ledger": (lambda s, sf: parts.settlement_ledger(parts.assign_order_no(_orders(s, sf)).join(_orders(s, sf).select("order_id", F.col("total").alias("amount")), "order_id"), "199512"), "SELECT count(*) AS n, coalesce(sum(o_totalprice::DECIMAL(18,2)), 0)::DECIMAL(18,2) AS total FROM orders WHERE contains('PO-' || strftime(o_orderdate, '%Y%m%d'), '199512')"),
    "b12_list_orders": (lambda s, sf: parts.list_orders(_orders(s, sf)).select("order_id", F.array_join("allowed", ",").alias("allowed")), "SELECT o_orderkey AS order_id, CASE o_orderstatus WHEN 'P' THEN 'approve,reject,cancel' WHEN 'O' THEN 'receive' ELSE 'settle' END AS allowed FROM orders"),
    "b13_inquiry_draft": (lambda s, sf: parts.inquiry_draft(_parts(s, sf)), f"WITH {PARTS} SELECT code, 'Part: ' || part || chr(10) || 'Code: ' || code || chr(10) || 'Stock: ' || stock || chr(10) || 'Substitute: ' || CASE WHEN nxt % 3 <> 0 THEN 'P' || nxt ELSE 'confirm with vendor' END AS draft FROM pt"),
    "q1_number_tokens": (lambda s, sf: _sentences(s, sf).select("chunk_id", F.array_join(training.number_tokens("text"), ",").alias("numbers")), "SELECT p_partkey AS chunk_id, concat_ws(',', p_size, p_size + 3, p_size + 7) AS numbers FROM part"),
    "q2_quiz_sentences": (lambda s, sf: training.quiz_sentences(_sentences(s, sf)).select("chunk_id", "no", "sentence"), "SELECT p_partkey AS chunk_id, 0 AS no, p_name || ' needs ' || p_size || ' bolts and ' || (p_size + 3) || ' rings and ' || (p_size + 7) || ' pins。' AS sentence FROM part"),
    "q3_quiz_items": (lambda s, sf: training.quiz_items(training.quiz_sentences(_sentences(s, sf))), None),
    "q4_quiz_sets": (lambda s, sf: training.quiz_sets(table(s, sf, "lineitem").select((F.col("l_orderkey") % 500).alias("quiz_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("no"), "l_returnflag").groupBy("quiz_id", "no").agg(F.max("l_returnflag").alias("question")), 20).withColumn("questions", F.array_join("questions", "")), """
      WITH r AS (SELECT l_orderkey % 500 AS quiz_id, q, row_number() OVER (PARTITION BY l_orderkey % 500 ORDER BY l_orderkey * 10 + l_linenumber) AS n FROM (SELECT l_orderkey, l_linenumber, max(l_returnflag) AS q FROM lineitem GROUP BY 1, 2))
      SELECT quiz_id, 20 AS requested, least(20, count(*)) AS kept, count(*) - least(20, count(*)) AS dropped, string_agg(q, '' ORDER BY n) FILTER (n <= 20) AS questions FROM r GROUP BY 1"""),
    "q5_validate_items": (lambda s, sf: training.validate_items(table(s, sf, "part").select(F.col("p_partkey").alias("item_id"), F.when(F.col("p_partkey") % 9 == 0, -1).otherwise(F.col("p_partkey")).alias("chunk_id"), F.when(F.col("p_partkey") % 8 == 0, "essay").otherwise("judgement").alias("type"), F.when(F.col("p_partkey") % 7 == 0, "why").otherwise(F.concat_ws(" ", F.lit("It needs"), (F.col("p_size") + F.col("p_partkey") % 2).cast("string"), F.lit("bolts"))).alias("question"), F.array().cast("array<string>").alias("options"), F.lit("true").alias("answer")), _sentences(s, sf)), """
      SELECT p_partkey AS item_id, CASE WHEN p_partkey % 7 = 0 THEN 'short stem' WHEN p_partkey % 8 = 0 THEN 'type' WHEN p_partkey % 9 = 0 THEN 'no evidence' WHEN p_partkey % 2 = 1 THEN 'untraceable number' END AS reject FROM part"""),
    "q6_grade": (lambda s, sf: table(s, sf, "lineitem").join(table(s, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", training.grade(F.lit("single"), F.when(F.col("l_linenumber") % 2 == 0, F.char(F.lit(65) + F.col("l_linenumber") % 4)).otherwise((F.col("l_linenumber") % 4).cast("string")), (F.col("p_size") % 4).cast("string"), F.array().cast("array<string>")).alias("right")), "SELECT l_orderkey, l_linenumber, l_linenumber % 4 = p_size % 4 AS right FROM lineitem JOIN part ON l_partkey = p_partkey"),
    "q7_score_attempts": (lambda s, sf: training.score_attempts(table(s, sf, "lineitem").select(F.col("l_orderkey").alias("attempt_id"), (F.col("l_partkey") % 5 > 1).alias("right"))), """
      SELECT l_orderkey AS attempt_id, count(*) FILTER (l_partkey % 5 > 1) AS correct, count(*) AS total, round(100.0::DOUBLE * count(*) FILTER (l_partkey % 5 > 1) / count(*), 1) AS score, round(100.0::DOUBLE * count(*) FILTER (l_partkey % 5 > 1) / count(*), 1) >= 60 AS passed FROM lineitem GROUP BY 1"""),
    "q8_issue_certificates": (lambda s, sf: training.issue_certificates(_attempts(s, sf).select((F.col("attempt_id") * 2).alias("request_id"), (F.col("attempt_id") + F.when(F.col("attempt_id") % 13 == 0, 10000000).otherwise(0)).alias("attempt_id"), F.when(F.col("attempt_id") % 6 == 0, "x").otherwise(F.col("trainee")).alias("trainee"), "issued_at"), _attempts(s, sf), 365), """
      WITH r AS (SELECT o_orderkey, o_orderdate, o_totalprice::BIGINT AS x, CASE WHEN o_orderkey % 13 = 0 THEN 'no attempt' WHEN trunc(o_totalprice)::BIGINT % 101 < 60 THEN 'not passed' END AS reject FROM orders)
      SELECT o_orderkey * 2 AS request_id, o_orderkey + CASE WHEN o_orderkey % 13 = 0 THEN 10000000 ELSE 0 END AS attempt_id, CASE WHEN reject IS NULL THEN o_orderdate + INTERVAL 365 DAYS END AS expires_at, reject, reject IS NULL AND o_orderkey % 6 = 0 AS mismatch FROM r"""),
    "q9_days_to_expiry": (lambda s, sf: _certificates(s, sf).select("id", training.days_to_expiry(F.col("expires_at"), _now()).alias("days")), """
      WITH d AS (SELECT o_orderkey AS id, (epoch(o_orderdate + INTERVAL 365 DAYS) - epoch(TIMESTAMP '1998-06-01')) / 86400 AS days FROM orders WHERE trunc(o_totalprice)::BIGINT % 101 >= 60) SELECT id, (CASE WHEN days > 0 THEN ceil(days) ELSE floor(days) END)::BIGINT AS days FROM d"""),
    "q10_expiring": (lambda s, sf: training.expiring(_certificates(s, sf), 60, _now()).select("id", "expires_at", "days"), """
      WITH c AS (SELECT o_orderkey AS id, o_orderdate + INTERVAL 365 DAYS AS expires_at FROM orders WHERE trunc(o_totalprice)::BIGINT % 101 >= 60 AND o_orderkey % 11 <> 0), d AS (SELECT *, (epoch(expires_at) - epoch(TIMESTAMP '1998-06-01')) / 86400 AS x FROM c)
      SELECT id, expires_at, (CASE WHEN x > 0 THEN ceil(x) ELSE floor(x) END)::BIGINT AS days FROM d WHERE expires_at BETWEEN TIMESTAMP '1998-06-01' - INTERVAL 30 DAYS AND TIMESTAMP '1998-06-01' + INTERVAL 60 DAYS ORDER BY expires_at, id LIMIT 500"""),
    "p1_cycle_sentences": (lambda s, sf: maintenance.cycle_sentences(_clauses(s, sf)), """SELECT p_partkey AS chunk_id, 0 AS no, p_name || '每 ' || p_size || CASE p_partkey % 3 WHEN 0 THEN ' 小时' WHEN 1 THEN ' 万片' ELSE ' 个月' END || '更换；滤芯累计 500 小时清洗' AS sentence FROM part"""),
    "p2_extract_cycles": (lambda s, sf: maintenance.extract_cycles(maintenance.cycle_sentences(_clauses(s, sf))).select("chunk_id", "basis", "value"), """SELECT p_partkey AS chunk_id, 'hours' AS basis, 500.0::DOUBLE AS value FROM part
      UNION ALL SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'hours' WHEN 1 THEN 'wafers' ELSE 'days' END, p_size * CASE p_partkey % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 10000.0 ELSE 30.0 END::DOUBLE FROM part"""),
    "p3_clauses": (lambda s, sf: maintenance.cycles_in_clauses(maintenance.extract_cycles(maintenance.cycle_sentences(_clauses(s, sf))), maintenance.clauses(maintenance.cycle_sentences(_clauses(s, sf)))).select("chunk_id", "clause_no", "raw", "alternates"), """SELECT p_partkey AS chunk_id, 1 AS clause_no, '500 小时' AS raw, 0 AS alternates FROM part
      UNION ALL SELECT p_partkey, 0, p_size || CASE p_partkey % 3 WHEN 0 THEN ' 小时' WHEN 1 THEN ' 万片' ELSE ' 个月' END, 0 FROM part"""),
    "p4_match_candidates": (lambda s, sf: plan_items.match_candidates(_found(s, sf)).select("scope", "rank", "item", "basis", "value", "chunk_id"), f"""WITH {MANUAL}
      SELECT scope, rank, listed AS item, basis, value, chunk_id FROM cy WHERE listed IS NOT NULL QUALIFY row_number() OVER (PARTITION BY scope, rank ORDER BY chunk_id) = 1"""),
    "p5_item_type": (lambda s, sf: _found(s, sf).select("chunk_id", "raw", plan_items.item_type(F.col("sentence"), F.col("pos")).alias("kind")), f"WITH {MANUAL} SELECT chunk_id, raw, kind FROM cy"),
    "p6_derive_name": (lambda s, sf: _found(s, sf).select("chunk_id", "raw", plan_items.derive_name(F.col("sentence"), F.col("start"), F.col("pos"), F.col("heading"), F.col("doc_title")).alias("item")), f"WITH {MANUAL} SELECT chunk_id, raw, item FROM cy"),
    "p7_generate_plans": (lambda s, sf: plan_items.generate_plans(_manual(s, sf).select("device_model").filter("device_model != '通用'"), _manual(s, sf)), f"""WITH {MANUAL},
      d AS (SELECT DISTINCT scope AS device_model FROM pp WHERE scope <> '通用'), m AS (SELECT device_model, chunk_id, clause_no, rank, coalesce(listed, item) AS item, kind, basis, value, raw, more FROM cy JOIN d ON scope IN (device_model, '通用') WHERE main = 1),
      o AS (SELECT * FROM m WHERE rank < 15 QUALIFY row_number() OVER (PARTITION BY device_model, rank ORDER BY chunk_id) = 1
        UNION ALL SELECT * FROM m WHERE rank = 15 QUALIFY row_number() OVER (PARTITION BY device_model, item, basis, value ORDER BY chunk_id, clause_no) = 1)
      SELECT device_model, row_number() OVER (PARTITION BY device_model ORDER BY rank, chunk_id, clause_no)::INT AS n, item, kind, basis, value, raw, '由知识库生成，依据《未知文档》；周期原文「' || raw || '」'
        || CASE WHEN more <> '' THEN '，已按 1' || more || ' 天折算为 ' || value::BIGINT || ' 天（折算系数为工程约定，非知识库原文）' ELSE '' END || CASE WHEN rank = 2 THEN '；知识库同时给出：12 个月（以先到者为准）' ELSE '' END AS note, chunk_id
      FROM o QUALIFY row_number() OVER (PARTITION BY device_model ORDER BY rank, chunk_id, clause_no) <= 20"""),
    "p8_uncovered": (lambda s, sf: maintenance.uncovered(table(s, sf, "nation").select(F.col("n_name").alias("item"), F.lower(F.substring("n_name", 1, 3)).alias("keyword")), table(s, sf, "documents").select(F.lower("text").alias("text")), table(s, sf, "region").select(F.col("r_name").alias("item"))), """
      WITH t AS (SELECT n_name AS item, lower(substr(n_name, 1, 3)) AS k FROM nation WHERE n_name NOT IN (SELECT r_name FROM region)) SELECT item, CASE WHEN (SELECT count(*) FROM documents WHERE contains(lower(text), k)) = 0 THEN 'not in the corpus' ELSE 'mentioned without a value' END AS reason FROM t"""),
    "p9_due_calc": (lambda s, sf: _plans(s, sf).select("id", "remaining", "due_at", "status"), f"WITH {PLANS} SELECT id, remaining, due_at, status FROM pd"),
    "p10_list_plans": (lambda s, sf: maintenance.list_plans(_plans(s, sf), None, "due").limit(50).select("id", "remaining"), f"WITH {PLANS} SELECT id, remaining FROM pd WHERE status = 'due' ORDER BY remaining, id LIMIT 50"),
    "p11_roll_plans": (lambda s, sf: maintenance.roll_plans(_plans(s, sf), table(s, sf, "events").select((F.col("event_id") % 1500).alias("plan_id"), F.col("event_id").alias("at"), F.when(F.col("event_id") % 3 == 0, "skip").otherwise("complete").alias("action"), F.when(F.col("event_id") % 2 == 0, F.col("value")).alias("value"))), f"""
      WITH {PLANS}, e AS (SELECT event_id % 1500 AS plan_id, max(event_id) AS k FROM events GROUP BY 1), l AS (SELECT plan_id, k % 3 = 0 AS skip, CASE WHEN k % 2 = 0 THEN value END AS value FROM e JOIN events ON event_id = k)
      SELECT id, cycle, CASE WHEN NOT skip THEN coalesce(value, baseline + cycle) ELSE baseline END AS baseline, CASE WHEN NOT skip THEN cycle ELSE remaining END AS remaining, CASE WHEN NOT skip THEN 'pending' WHEN skip THEN 'skipped' ELSE status END AS status FROM pd LEFT JOIN l ON plan_id = id"""),
}
