"""Maintenance cycles from text, plans and their due dates."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evspark.operators import matching

#: Words of maintenance actions, of contexts that are not maintenance, and marks of a cycle.
ACTION_WORDS = [
    "更换", "换油", "替换", "检查", "巡检", "点检", "保养", "维护", "清洗", "校准", "校验", "标定",
    "检定", "试验", "试水", "检测", "测试", "验证", "演练", "检修", "寿命", "报废", "PM",
]
EXCLUDED = [
    "保存", "台账", "有效期", "盘点", "核对", "请购", "申报", "提前期", "到货", "入库", "验收", "领用", "存放", "库存",
    "交底", "许可", "报价", "预算", "费用", "工单", "重复出现", "上报", "判定是否", "空跑", "空白片",
]
DELIVERY = ["到货周期", "交期", "提前期", "请购", "采购"]
CYCLE_MARKS = ["每", "周期", "累计", "达到", "满", "间隔", "至少", "不超过", "不低于"]
#: Units with their basis and factor, and wordings without a number.
UNITS = [("hours", r"(?:个)?\s*(?:运行)?\s*小时", 1.0), ("hours", r"h(?![A-Za-z])", 1.0), ("wafers", "万片", 10000.0), ("wafers", "片", 1.0), ("days", "天", 1.0), ("days", r"个?\s*月", 30.0), ("days", r"个?\s*周", 7.0), ("days", r"个?\s*年", 365.0)]
FIXED = [("每季度", 90.0), ("每半年", 180.0), ("每月", 30.0), ("每周", 7.0), ("每年", 365.0)]
FREQUENCY_ONLY = "每班次|每次开腔|每次拆装|每次作业前|每批"
CLAUSE_BREAK = "，,、；;：:。（）()【】[]"


def cycle_sentences(chunks: DataFrame, id_col: str = "chunk_id", actions: list[str] = ACTION_WORDS, excluded: list[str] = (*EXCLUDED, *DELIVERY)) -> DataFrame:
    """chunk, no, sentence: sentences with an action and without words that speak of other periods."""
    each = chunks.select(id_col, F.posexplode(F.split("text", r"[。\n\r]+")).alias("no", "sentence"))
    any_of = lambda words: "|".join(map(re.escape, words))
    return each.withColumn("sentence", F.trim("sentence")).filter(F.col("sentence").rlike(any_of(actions)) & ~F.col("sentence").rlike(any_of(excluded)))


def _cycles(sentence: str) -> list[tuple[int, str, float, str]]:
    found: dict[tuple[int, str], tuple[int, str, float, str]] = {}
    for basis, unit, factor in UNITS:
        for m in re.finditer(rf"(\d+(?:\.\d+)?)\s*{unit}", sentence):
            clause = sentence[: m.start()]
            clause = clause[max((clause.rfind(c) for c in CLAUSE_BREAK), default=-1) + 1 :]
            if float(m[1]) > 0 and any(w in clause for w in CYCLE_MARKS):
                found.setdefault((m.start(), basis), (m.start(), basis, float(m[1]) * factor, m[0]))
    for wording, days in FIXED:
        for m in re.finditer(wording, sentence):
            found.setdefault((m.start(), "days"), (m.start(), "days", days, m[0]))
    return sorted(found.values())


def extract_cycles(sentences: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """chunk, no, pos, basis, value, raw: each cycle of a sentence; a number needs a mark of a cycle before it in its clause. Offsets of matches are what built-in functions don't give, hence Arrow batches."""
    kind = sentences.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, no, *c) for i, no, s in batch[[id_col, "no", "sentence"]].itertuples(index=False, name=None) for c in _cycles(s or "")]
            yield pd.DataFrame(rows, columns=[id_col, "no", "pos", "basis", "value", "raw"])

    return sentences.select(id_col, "no", "sentence").mapInPandas(run, f"`{id_col}` {kind}, no int, pos int, basis string, value double, raw string")


def clauses(sentences: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """chunk, no, clause_no, start, end, clause: parts between semicolons, with their place in the sentence."""
    parts = sentences.select(id_col, "no", F.posexplode(F.split("sentence", "[；;]", -1)).alias("clause_no", "clause"))
    before = F.coalesce(F.sum(F.length("clause") + 1).over(Window.partitionBy(id_col, "no").orderBy("clause_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return parts.select(id_col, "no", "clause_no", before.alias("start"), (before + F.length("clause")).alias("end"), "clause").filter("clause != ''")


def cycles_in_clauses(cycles: DataFrame, parts: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """Each cycle with its clause, and alternates: how many other cycles the clause has. The range test stands on an equality of sentences."""
    both = cycles.join(parts, [id_col, "no"]).filter((F.col("start") <= F.col("pos")) & (F.col("pos") < F.col("end")))
    return both.withColumn("alternates", F.count(F.lit(1)).over(Window.partitionBy(id_col, "no", "clause_no")) - 1)


def uncovered(templates: DataFrame, chunks: DataFrame, covered: DataFrame) -> DataFrame:
    """templates (item, keyword) without a row in `covered` (item), and why: not in the corpus, only a frequency, or mentioned without a value. One automaton of the keywords runs over each text."""
    left = templates.join(covered.select("item").distinct(), "item", "left_anti")
    texts = chunks.select("text", F.col("text").rlike(FREQUENCY_ONLY).cast("int").alias("frequency"))
    hit = matching.find_patterns(texts, left, "text", "keyword", ("frequency",)).groupBy(F.col("pattern").alias("keyword")).agg(F.max("frequency").alias("frequency"))
    seen = left.join(hit, "keyword").groupBy("item").agg(F.max("frequency").alias("frequency"))
    why = F.when(F.col("frequency").isNull(), "not in the corpus").when(F.col("frequency") == 1, "only a frequency").otherwise("mentioned without a value")
    return left.select("item").join(seen, "item", "left").select("item", why.alias("reason"))


def due_calc(basis: Column, cycle: Column, meter: Column, since: Column, now: Column) -> Column:
    """remaining, due_at and status of a plan. Hours: due when the rest has run, at once if overdue; wafers: no date; days: a full cycle from now. What has run since the last maintenance counts if it is known."""
    used = F.coalesce(since, meter, F.lit(0.0))
    remaining = F.when(basis == "days", cycle).otherwise(cycle - used)
    days = F.when(basis == "days", cycle).when(basis == "hours", F.greatest(F.lit(0.0), remaining) / 24)
    due = F.when(days.isNotNull(), F.timestamp_seconds(F.unix_timestamp(now) + F.round(days * 86400)))
    return F.struct(F.round(remaining, 4).alias("remaining"), due.alias("due_at"), F.when(remaining <= 0, "due").otherwise("pending").alias("status"))


def list_plans(plans: DataFrame, device: str | None = None, status: str | None = None) -> DataFrame:
    """Plans in order of what remains."""
    where = (F.lit(True) if device is None else F.col("device_model") == device) & (F.lit(True) if status is None else F.col("status") == status)
    return plans.filter(where).orderBy(F.col("remaining").asc_nulls_last(), "id")


def roll_plans(plans: DataFrame, events: DataFrame) -> DataFrame:
    """plans (id, cycle, baseline, remaining, status) after the latest event of each (plan_id, at, action, value): completed begins a new cycle from the value reported, or from the end of the last; skipped only says so."""
    last = events.groupBy("plan_id").agg(F.max_by(F.struct("action", "value"), "at").alias("e"))
    rows = plans.join(last, F.col("id") == F.col("plan_id"), "left")
    done, skipped = F.col("e.action") == "complete", F.col("e.action") == "skip"
    return rows.select(
        "id", "cycle", F.when(done, F.coalesce("e.value", F.col("baseline") + F.col("cycle"))).otherwise(F.col("baseline")).alias("baseline"),
        F.when(done, F.col("cycle")).otherwise(F.col("remaining")).alias("remaining"), F.when(done, "pending").when(skipped, "skipped").otherwise(F.col("status")).alias("status"),
    )
