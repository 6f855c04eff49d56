import random
import re

import pytest
from pyspark.sql import functions as F

from evspark.operators import maintenance, matching, parts, retrieve


def words(pick, n, letters="abcä漢"):
    return "".join(pick.choice(letters) for _ in range(n))


@pytest.mark.parametrize("chars", [1 << 20, 40])
def test_patterns_in_texts(spark, monkeypatch, chars):
    monkeypatch.setattr(matching, "PATTERN_CHARS", chars)  # with 40, several passes
    pick = random.Random(2)
    texts = [(i, words(pick, pick.randint(0, 60)), "x") for i in range(200)] + [(200, None, None), (201, "", "y")]
    patterns = [words(pick, pick.randint(1, 4)) for _ in range(60)] + ["", None]
    t, p = spark.createDataFrame(texts, "id int, body string, pattern_of string"), spark.createDataFrame([(x,) for x in patterns], "word string")
    got = sorted(map(tuple, matching.find_patterns(t, p, "body", "word", ("id",)).collect()))
    assert got == sorted({(i, w) for i, b, _ in texts for w in patterns if w and b and w in b}) and len(got) > 500
    assert matching.find_patterns(t, p.limit(0), "body", "word", ("id",)).count() == 0 == matching.find_patterns(t.limit(0), p, "body", "word", ("id",)).count()


def test_first_text_and_first_pattern(spark):
    pick = random.Random(3)
    texts = [(words(pick, pick.randint(0, 12)), i) for i in range(300)] + [(None, 300)]
    patterns = [(words(pick, pick.randint(1, 6)), i) for i in range(200)] + [("", 200), (None, 201)]
    t, p = spark.createDataFrame(texts, "text string, rank int"), spark.createDataFrame(patterns, "pattern string, rank int")
    got = {r.pattern: r["first"] for r in matching.first_containing(t, p).collect()}
    assert got == {w: min(i for b, i in texts if b and w in b) for w, _ in patterns if w and any(b and w in b for b, _ in texts)}
    got = {r.text: r["first"] for r in matching.first_contained(t, p).collect()}
    assert got == {b: min(i for w, i in patterns if w and w in b) for b, _ in texts if b and any(w and w in b for w, _ in patterns)}


def slow_part(ledger, q):
    q = (q or "").strip().lower()
    tests = [lambda c, n: c == q, lambda c, n: q in c, lambda c, n: n and (q in n or n in q)]
    return next(((code, level) for level, test in enumerate(tests) for code, name in ledger if test(code.lower(), (name or "").lower())), None) if q else None


def test_parts_of_requests(spark):
    pick = random.Random(4)
    ledger = [(f"P-{words(pick, 4, 'AB1')}{i}", pick.choice([words(pick, pick.randint(1, 8), "ab c"), None, ""])) for i in range(120)]
    asked = [(i, pick.choice([pick.choice(ledger)[0].lower(), pick.choice(ledger)[0][1:4], words(pick, pick.randint(0, 9), "ab c"), f" {pick.choice(ledger)[1] or 'x'} ", None])) for i in range(300)]
    got = {r.request_id: (r.code, r.level) for r in parts.match_parts(spark.createDataFrame(asked, "request_id int, text string"), spark.createDataFrame([(c, n, i) for i, (c, n) in enumerate(ledger)], "code string, part string, ordinal int")).collect()}
    assert got == {i: hit for i, q in asked if (hit := slow_part(ledger, q))}


GLOSSARY = [("密封圈", "term", 0, ["O型圈", "胶圈"]), ("腔压", "term", 1, ["压力", "pressure", "Press"]), ("薄膜沉积", "term", 2, ["CVD"]), ("$5\\E", "term", 3, ["a.b"]), ("密封圈机", "device", 0, ["SealMaker"]), ("空", "term", 4, [])]


@pytest.fixture(scope="module")
def glossary(spark):
    return spark.createDataFrame(GLOSSARY, "canonical string, kind string, ordinal int, synonyms array<string>")


def slow_lookup(term):
    for kind in ("term", "device"):
        for canonical, _, _, synonyms in (g for g in GLOSSARY if g[1] == kind):
            if any(term.strip().lower() in x.lower() for x in (canonical, *synonyms)):
                return canonical, synonyms, [canonical, *synonyms[:2]] if kind == "term" else [canonical]
    return None, [], [term]


def test_glossary_lookup(spark, glossary):
    terms = ["胶圈", "圈", "seal", "SEALMAKER", "press", "pressure x", "", " cvd ", "密封圈机", "none", "a.b", "a"]
    got = {r.term: (r.canonical, r.synonyms, r.queries) for r in retrieve.glossary_lookup(spark.createDataFrame([(t,) for t in [*terms, "圈"]], "term string"), glossary).collect()}
    assert got == {t: slow_lookup(t) for t in terms}
    assert [r.canonical for r in retrieve.glossary_lookup(spark.createDataFrame([("圈",)], "term string"), glossary.limit(0)).collect()] == [None]


def slow_forms(question):
    question = question.strip()
    text, hits = question, []
    for canonical, _, _, synonyms in (g for g in GLOSSARY if g[1] == "term"):
        for s in synonyms:
            if s.lower() in question.lower():
                new, n = re.subn(r"(?<![A-Za-z0-9\-])" + re.escape(s) + r"(?![A-Za-z0-9\-]*\d)", lambda _, c=canonical: c, text)
                if n:
                    text = new
                    hits.append(canonical)
                    break
    forms = [question, text.strip(), " ".join(dict.fromkeys([question, *hits]))]
    return list(dict.fromkeys(f for f in forms if f))


def test_query_forms(spark, glossary):
    pick = random.Random(6)
    bits = ["O型圈", "o型圈", "胶圈", "压力", "pressure", "CVD", "CVD-200", "xCVD", "CVDx", "a.b", "aXb", " ", "-", "7", "怎么换", "密封圈"]
    asked = [(i, "".join(pick.choice(bits) for _ in range(pick.randint(0, 7)))) for i in range(400)] + [(400, None)]
    got = {r.query_id: r.forms for r in retrieve.expand_queries(spark.createDataFrame(asked, "query_id int, text string"), glossary).collect()}
    assert got == {i: slow_forms(q or "") for i, q in asked}


def test_plans_have_no_nested_loops(spark, glossary):
    t = spark.createDataFrame([(1, "x")], "request_id int, text string")
    p = spark.createDataFrame([("c", "n", 1)], "code string, part string, ordinal int")
    chunks, templates = spark.createDataFrame([("清洗频率 a",), (None,), ("b",)], "text string"), spark.createDataFrame([("A", "a"), ("B", "b"), ("C", "c"), ("D", "d")], "item string, keyword string")
    missing = maintenance.uncovered(templates, chunks, templates.filter("item = 'D'").select("item"))
    frames = [parts.match_parts(t, p), retrieve.glossary_lookup(t.select(F.col("text").alias("term")), glossary), retrieve.expand_queries(t.withColumnRenamed("request_id", "query_id"), glossary), missing]
    for df in frames:
        assert "NestedLoop" not in df._jdf.queryExecution().toString() and "Cartesian" not in df._jdf.queryExecution().toString()
    assert {r.item: r.reason for r in missing.collect()}.keys() == {"A", "B", "C"}
