"""Spare parts, orders and settlements, as jobs over tables of requests and events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evspark.config import DEFAULT
from evspark.operators import matching

MONEY = "decimal(18,2)"
#: Steps of an order: (status, action) -> status. Cancelling is a rejection whose reason says so.
STEPS = {("draft", "submit"): "submitted", ("draft", "cancel"): "cancelled", ("submitted", "approve"): "approved", ("submitted", "reject"): "rejected", ("submitted", "cancel"): "cancelled", ("approved", "receive"): "received", ("approved", "reject"): "rejected"}
NEXT = {"draft": ["submit", "cancel"], "submitted": ["approve", "reject", "cancel"], "approved": ["receive"], "received": ["settle"], "rejected": [], "cancelled": []}
MAX_QTY = 999


def match_parts(requests: DataFrame, parts: DataFrame) -> DataFrame:
    """request_id, code, level: equal code (0) before code that contains the text (1) before name that contains it or stands in it (2); of equals the first in the ledger (ordinal). Requests of one text are matched once, and meet the ledger by equal strings and grams. Null and empty texts match nothing."""
    asked = requests.select("request_id", F.lower(F.trim("text")).alias("q")).filter("q != ''")
    texts = asked.select(F.col("q").alias("pattern")).distinct()
    ledger = parts.select("ordinal", F.lower("code").alias("code"), F.lower("part").alias("name"))
    by = lambda c: ledger.select(F.col(c).alias("text"), F.col("ordinal").alias("rank"))
    equal = texts.join(ledger.groupBy(F.col("code").alias("pattern")).agg(F.min("ordinal").alias("first")), "pattern")
    inside = matching.first_contained(texts.select(F.col("pattern").alias("text")), by("name").withColumnRenamed("text", "pattern")).withColumnRenamed("text", "pattern")
    hits = [(0, equal), (1, matching.first_containing(by("code"), texts)), (2, matching.first_containing(by("name"), texts)), (2, inside)]
    every = reduce(DataFrame.unionByName, [df.select("pattern", F.struct(F.lit(n).alias("level"), F.col("first").alias("ordinal")).alias("hit")) for n, df in hits])
    best = every.groupBy("pattern").agg(F.min("hit").alias("hit")).select(F.col("pattern").alias("q"), "hit.*")
    return asked.join(best, "q").join(parts.select("ordinal", "code"), "ordinal").select("request_id", "code", "level")


def part_availability(parts: DataFrame, low: int = DEFAULT.low_stock) -> DataFrame:
    """code, stock_state (low up to `low`, else ok; unknown stock counts as none), price (null if missing), substitutes (only those with a basis), without_basis, forbidden (a line for each part that must not stand in; empty without that column)."""
    based = lambda x: F.coalesce(F.trim(x["basis"]), F.lit("")) != ""
    subs = F.coalesce("substitutes", F.array().cast("array<struct<code:string,basis:string>>"))
    none = F.array().cast("array<struct<part:string,reason:string>>")
    bad = F.coalesce("forbidden", none) if "forbidden" in parts.columns else none
    line = lambda x: F.concat(F.lit("禁止替代："), F.coalesce(x["part"], F.lit("")), F.lit(" —— "), F.coalesce(x["reason"], F.lit("")))
    return parts.select(
        "code", F.when(F.coalesce("stock", F.lit(0)) <= low, "low").otherwise("ok").alias("stock_state"), F.col("price").cast(MONEY).alias("price"),
        F.transform(F.filter(subs, based), lambda x: x["code"]).alias("substitutes"), F.size(F.filter(subs, lambda x: ~based(x))).alias("without_basis"),
        F.transform(bad, line).alias("forbidden"),
    )


def substitute_lookup(parts: DataFrame) -> DataFrame:
    """substitute, code, basis: which part each substitute stands for."""
    each = parts.select("code", F.explode("substitutes").alias("s"))
    return each.select(F.lower("s.code").alias("substitute"), "code", F.nullif(F.trim("s.basis"), F.lit("")).alias("basis"))


def catalog(parts: DataFrame, device: str | None = None, keyword: str | None = None, generic: str = "通用") -> DataFrame:
    where = F.lit(True) if device is None else F.col("device_model").isin(device, generic)
    if keyword:
        where = where & reduce(lambda a, b: a | b, [F.lower(F.coalesce(c, F.lit(""))).contains(keyword.lower()) for c in ("part", "code", "spec", "location")])
    return parts.filter(where)


def resolve_order_items(items: DataFrame, parts: DataFrame, substitutes: DataFrame) -> DataFrame:
    """items (order_id, code, qty) with unit_price from the ledger, amount, is_substitute, basis and reject: null, 'qty', 'unknown code' or 'no basis'. `substitutes`: substitute, code, basis."""
    price = parts.select(F.lower("code").alias("__code"), F.col("price").cast(MONEY).alias("unit_price"))
    subs = substitutes.groupBy("substitute").agg(F.max("basis").alias("basis"))
    out = items.withColumn("__key", F.lower("code")).join(price, F.col("__key") == F.col("__code"), "left").join(subs.withColumn("is_sub", F.lit(True)), F.col("__key") == F.col("substitute"), "left")
    is_sub = F.coalesce("is_sub", F.lit(False)) & F.col("is_substitute")
    reject = F.when(F.coalesce("qty", F.lit(0)) < 1, "qty").when(F.col("__code").isNull(), "unknown code").when(F.col("is_substitute") & (F.col("basis").isNull() | ~is_sub), "no basis")
    amount = F.round(F.col("qty") * F.col("unit_price"), 2).cast(MONEY)
    return out.select("order_id", "code", "qty", "is_substitute", "unit_price", F.when(reject.isNull(), amount).alias("amount"), F.when(is_sub, F.col("basis")).alias("basis"), reject.alias("reject"))


def order_totals(items: DataFrame) -> DataFrame:
    """order_id, total: the sum of amounts; a missing one is quantity times price."""
    return items.groupBy("order_id").agg(F.sum(F.coalesce("amount", F.round(F.col("qty") * F.col("unit_price"), 2)).cast(MONEY)).cast(MONEY).alias("total"))


def assign_order_no(orders: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """orders (order_id, created_at) with order_no: PO-day-number, counted by day after the numbers that exist."""
    day = F.date_format("created_at", "yyyyMMdd")
    rows = orders.withColumn("__day", day).withColumn("__n", F.row_number().over(Window.partitionBy("__day").orderBy("created_at", "order_id")))
    if existing is not None:
        top = existing.groupBy(F.substring("order_no", 4, 8).alias("__day")).agg(F.max(F.substring_index("order_no", "-", -1).cast("int")).alias("__top"))
        rows = rows.join(top, "__day", "left").withColumn("__n", F.col("__n") + F.coalesce("__top", F.lit(0)))
    number = F.when(F.col("__n") > 9999, F.col("__n").cast("string")).otherwise(F.lpad(F.col("__n").cast("string"), 4, "0"))
    return rows.select("order_id", "created_at", F.concat_ws("-", F.lit("PO"), "__day", number).alias("order_no"))


def _edits(events: DataFrame) -> DataFrame:
    """Edits of carts, and whether the order had been submitted before."""
    w = Window.partitionBy("order_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    closed = F.coalesce(F.max((F.col("action") == "submit").cast("int")).over(w), F.lit(0)) == 1
    return events.withColumn("__closed", closed).filter("action IN ('add', 'set', 'remove')")


def fold_cart(events: DataFrame) -> DataFrame:
    """order_id, code, qty after the events (order_id, seq, action, code, qty): add accumulates up to 999, set replaces what is there, remove takes out; nothing counts after a submit. Quantities are brought within 1..999, a null one counts as 1. Items taken out are not there."""
    each = F.sort_array(F.collect_list(F.struct("seq", "action", "qty")))  # the events on one item of one order

    def step(q: Column, e: Column) -> Column:
        n = F.least(F.lit(MAX_QTY), F.greatest(F.lit(1), F.coalesce(e["qty"].cast("long"), F.lit(1))))
        return F.when(e["action"] == "remove", F.lit(0)).when(e["action"] == "set", F.when(q > 0, n).otherwise(q)).otherwise(F.least(F.lit(MAX_QTY), q + n)).cast("long")

    return _edits(events).filter(~F.col("__closed")).groupBy("order_id", "code").agg(F.aggregate(each, F.lit(0).cast("long"), step).alias("qty")).filter("qty > 0")


def rejected_edits(events: DataFrame) -> DataFrame:
    """order_id, seq, reject: edits after the submit, and of those before it the ones that set or remove an item that is not there."""
    w = Window.partitionBy("order_id", "code").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    there = F.coalesce(F.max_by("action", F.when(F.col("action") != "set", F.col("seq"))).over(w) == "add", F.lit(False))  # a set changes nothing about that
    missing = (F.col("action") != "add") & ~F.col("__there")
    return _edits(events).withColumn("__there", there).withColumn("reject", F.when(F.col("__closed"), "not a draft").when(missing, "no such item")).filter("reject IS NOT NULL").select("order_id", "seq", "reject")


def cart_totals(cart: DataFrame, parts: DataFrame) -> DataFrame:
    """order_id, total of the carts of `fold_cart` at the ledger's prices; a code without a price adds nothing."""
    priced = cart.join(parts.select(F.lower("code").alias("__code"), F.col("price").cast(MONEY).alias("price")), F.lower("code") == F.col("__code"), "left")
    return priced.groupBy("order_id").agg(F.sum(F.coalesce(F.col("qty") * F.col("price"), F.lit(0))).cast(MONEY).alias("total"))


def step_action(action: str = "action", reason: str = "reason") -> Column:
    """The action that an event stands for: a rejection that says cancel or 取消 cancels, and one without a reason is 'refused', which no status allows."""
    why = F.lower(F.trim(F.coalesce(reason, F.lit(""))))
    rejects = F.col(action) == "reject"
    return F.when(rejects & why.rlike(r"^(cancel|取消)"), "cancel").when(rejects & (why == ""), "refused").otherwise(F.col(action))


def fold_order_status(events: DataFrame) -> DataFrame:
    """order_id, status, accepted (array of the sequence numbers taken), rejected (of those refused), after events (order_id, seq, action, reason). A rejection needs a reason; one that begins with cancel or 取消 cancels."""
    action = step_action()
    table = F.create_map(*[F.lit(x) for (s, a), t in STEPS.items() for x in (f"{s} {a}", t)])
    ordered = F.sort_array(F.collect_list(F.struct("seq", action.alias("action"))))  # the steps of one order
    none = F.array().cast("array<bigint>")
    start = F.struct(F.lit("draft").alias("status"), none.alias("accepted"), none.alias("rejected"))

    def step(s: Column, e: Column) -> Column:
        to = table[F.concat_ws(" ", s["status"], e["action"])]
        seq = F.array(e["seq"].cast("bigint"))
        return F.struct(F.coalesce(to, s["status"]).alias("status"), F.when(to.isNotNull(), F.concat(s["accepted"], seq)).otherwise(s["accepted"]).alias("accepted"), F.when(to.isNull(), F.concat(s["rejected"], seq)).otherwise(s["rejected"]).alias("rejected"))

    return events.groupBy("order_id").agg(F.aggregate(ordered, start, step).alias("x")).select("order_id", "x.*")


def settle(orders: DataFrame, requests: DataFrame, existing: DataFrame) -> DataFrame:
    """requests (request_id, order_id, amount) with the amount settled and reject: 'status', 'settled already' or null. The first request of an order counts."""
    eligible = orders.filter(F.col("status").isin("approved", "received")).select("order_id", F.col("total").cast(MONEY).alias("__total"))
    done = existing.select("order_id").distinct().withColumn("__done", F.lit(True))
    n = F.row_number().over(Window.partitionBy("order_id").orderBy("request_id"))
    rows = requests.withColumn("__n", n).join(eligible, "order_id", "left").join(done, "order_id", "left")
    reject = F.when(F.col("__total").isNull(), "status").when(F.col("__done") | (F.col("__n") > 1), "settled already")
    return rows.select("request_id", "order_id", F.when(reject.isNull(), F.coalesce(F.col("amount").cast(MONEY), F.col("__total"))).alias("settled"), reject.alias("reject"))


def settlement_ledger(settlements: DataFrame, like: str) -> DataFrame:
    """One row: n and total of the settlements whose order number has `like`."""
    return settlements.filter(F.col("order_no").contains(like)).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col("amount").cast(MONEY)), F.lit(0)).cast(MONEY).alias("total"))


def list_orders(orders: DataFrame, status: str | None = None) -> DataFrame:
    """Orders with the actions that may follow."""
    actions = F.create_map(*[x for s, a in NEXT.items() for x in (F.lit(s), F.array(*[F.lit(k) for k in a]).cast("array<string>"))])
    out = orders.withColumn("allowed", F.coalesce(actions[F.col("status")], F.array().cast("array<string>")))
    return out if status is None else out.filter(F.col("status") == status)


def inquiry_draft(parts: DataFrame) -> DataFrame:
    """code, draft: lines of a request for quotation, with the first substitute that has a basis."""
    subs = F.filter("substitutes", lambda x: F.coalesce(F.trim(x["basis"]), F.lit("")) != "")
    best = F.coalesce(F.get(F.transform(subs, lambda x: x["code"]), F.lit(0)), F.lit("confirm with vendor"))
    lines = [F.concat(F.lit("Part: "), "part"), F.concat(F.lit("Code: "), "code"), F.concat(F.lit("Stock: "), F.col("stock").cast("string")), F.concat(F.lit("Substitute: "), best)]
    return parts.select("code", F.concat_ws("\n", *lines).alias("draft"))
