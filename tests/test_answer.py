"""The plan from questions to answers: forms, calls, evidence from other sources, and what fails on the way."""

import itertools

import pytest
from pyspark.sql import functions as F

from evspark.functions import plugins
from evspark.plans import answer
from evspark.plans.answer import Models, Notices, Sources

CHUNK = "chunk_id string, doc_id string, doc_title string, version string, page int, section string, heading string, category string, device_model string, index int, text string"
TEXTS = [
    ("a0", "a", "Pump manual", "The vacuum pump oil is replaced every 500 hours。 Use oil of grade VG46 for the vacuum pump。", None),
    ("a1", "a", "Pump manual", "Before the oil is drained the pump is switched off。 The drain valve is closed again afterwards。", None),
    ("b0", "b", "Furnace manual", "The furnace door gasket is inspected weekly。 A worn gasket leaks hydrogen at 900 degrees。", "F-100"),
    ("b1", "b", "Furnace manual", "The thermocouple of the furnace is calibrated yearly by the maker。", "F-100"),
    ("c0", "c", "Store rules", "A spare seal ring is taken from stock against a signature。 The alarm of a hydrogen leak is told in a ticket。", None),
]


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [(c, d, t, "V1", 1, str(i), "", "标准", m, i % 2, x) for i, (c, d, t, x, m) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, CHUNK)


@pytest.fixture(scope="module")
def sources(spark):
    tickets = spark.createDataFrame([("T1", "F-100", "hydrogen leak alarm", "worn gasket", "gasket replaced", "alarm gone"), ("T2", "X", "pump noise", "bearing", "", "ok")], "ticket_no string, device_model string, symptom string, root_cause string, action string, conclusion string")
    parts = spark.createDataFrame([("P-1", "seal ring", 0, 7, [("P-2", "same size"), ("P-3", "")]), ("P-9", "drain valve", 1, 0, [])], "code string, part string, ordinal int, stock int, substitutes array<struct<code: string, basis: string>>")
    glossary = spark.createDataFrame([("vacuum pump", "term", 0, ["vp"])], "canonical string, kind string, ordinal int, synonyms array<string>")
    return Sources(glossary, tickets, parts, {"parts": ["stock", "spare"], "tickets": ["ticket", "alarm"]})


def asked(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id int, text string")


def test_answers_and_refusals(spark, chunks, sources):
    questions = ["vacuum pump oil replaced hours", "spare seal ring stock", "hydrogen leak alarm ticket", "gizmo flux zebra quokka", "", "vp", "spare unobtainium stock"]
    got = {r.query_id: r for r in answer.answer_batch(asked(spark, questions), chunks, sources=sources, notices=Notices(["replaced"], "SAFETY", "IMAGE")).collect()}
    assert set(got) == set(range(len(questions)))
    assert got[0].status == "OK" and got[0].text.startswith("SAFETY\n") and "every 500 hours [1]" in got[0].text and not got[0].augmented and got[0].errors == []
    assert got[1].status == "OK" and got[1].augmented and "Stock: 7" in got[1].text and "Substitute: P-2, basis: same size" in got[1].text and "P-3" not in got[1].text
    assert got[2].status == "OK" and got[2].augmented and "历史工单 T1" in got[2].text and got[2].calls == 3
    assert (got[3].status, got[3].text, got[3].degraded) == ("NOT_COVERED", "", True) and "no evidence" in got[3].reasons
    assert got[4].status == "NOT_COVERED" and got[4].text == ""
    assert got[5].augmented and "no evidence" not in got[5].reasons  # by the glossary's form alone
    assert got[6].augmented and (got[6].status == "NOT_COVERED" or "Not in the catalogue: spare unobtainium stock" in got[6].text)


def test_words_that_the_corpus_lacks_refuse(spark, chunks):
    text = "vacuum pump oil replaced hours gizmo flux zebra quokka"
    (row,) = answer.answer_batch(asked(spark, [text]), chunks).collect()
    assert row.status == "NOT_COVERED" and "anchors missing" in row.reasons


@pytest.mark.parametrize(("calls", "rounds"), itertools.product((0, 1, 2, 3), (0, 2)))
def test_calls_of_a_round(spark, calls, rounds):
    keywords = {"parts": ["p"], "tickets": ["t"]}
    rows = [(i, "".join(k), list("abcdef")[:n], top) for i, (k, n, top) in enumerate(itertools.product([(), ("p",), ("t",), ("p", "t")], range(5), [None, 0.2, 0.9]))]
    df = spark.createDataFrame(rows, "query_id int, text string, forms array<string>, top double")
    plan = {r.query_id: r for r in answer.plan_calls(df.drop("top"), df.select("query_id", "top"), Sources(keywords=keywords), rounds=rounds, calls=calls).collect()}
    want = {}
    for i, text, forms, top in rows:
        need = [name for name, words in keywords.items() if any(w in text for w in words)]
        if rounds >= 2 or calls >= 3 or not (need or (top or 0) < 0.5):
            continue
        budget, used, external, n = 3 - calls, 0, [], 0
        for name in need:
            if used < budget:
                external.append(name)
                used += 1
        for _ in forms[: max(1, budget - 1)]:
            if used < budget:
                n, used = n + 1, used + 1
        want[i] = (external, n, used < budget, calls + used)
    assert {i: (r.external, r.n_forms, r.neighbors, r.calls) for i, r in plan.items()} == want


def test_new_evidence_stands_first_and_once(spark, chunks, sources):
    questions = answer.with_forms(spark.createDataFrame([(0, "gasket alarm", "F-200"), (1, "pump oil", None)], "query_id int, text string, device_model string"))
    searcher = answer.Searcher(questions, chunks, answer.DEFAULT)
    first = answer.evidence(questions, chunks, searcher=searcher)
    assert {r.query_id for r in first.collect()} == {1}  # the gasket is another device's
    plan = answer.plan_calls(questions, first.groupBy("query_id").agg(F.max("normalized").alias("top")), sources)
    ranked, calls = answer.augment(first, plan, chunks, searcher, sources)
    rows = {}
    for r in ranked.orderBy("query_id", "position").collect():
        rows.setdefault(r.query_id, []).append(r)
    assert [r.chunk_id for r in rows[0]][0] == "ticket:T1" and {r.chunk_id for r in rows[0]} == {"ticket:T1", "b0", "b1", "c0"}  # found without the filter, and its neighbour
    assert all(len({r.chunk_id for r in x}) == len(x) for x in rows.values())
    assert {r.query_id: (r.calls, r.n_new) for r in calls.collect()}[0] == (3, 3)


def test_forms_of_conversations(spark):
    rows = [(1, 0, "user", "How is the vacuum pump oil replaced in the hall?"), (1, 1, "assistant", "So."), (1, 2, "user", "那 oil"), (2, 0, "user", "And here?")]
    got = {r.query_id: r for r in answer.conversation_questions(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")).collect()}
    assert got["1-2"].followup and got["1-2"].text == "那 oil" and got["1-2"].forms[0].startswith("How is") and not got["2-0"].followup


@pytest.fixture
def models():
    def broken():
        raise OSError("no model here")

    def picky(queries, texts):
        if any("gasket" in t for t in texts):
            raise ValueError("gasket")
        return [5.0 if "oil" in t else -5.0 for t in texts]

    plugins.register_scorer("absent", lambda: broken(), "1")
    plugins.register_scorer("picky", lambda: picky, "1")
    plugins.register_scorer("lengths", lambda: lambda q, t: [len(x) / 100 for x in t], "1")
    plugins.register_generator("shy", lambda: lambda q, p: f"Said of {p[-12:]} [1]。" if "oil" in q else (_ for _ in ()).throw(ValueError("too shy")))
    plugins.register_embedder("none", lambda: broken(), "none:1")
    plugins.register_embedder("two", lambda: lambda texts: [[3.0, 4.0] if t != "x" else 1 / 0 for t in texts], "two:1")
    plugins.register_embedder("rest", lambda: lambda texts: [[0.0, 2.0] for _ in texts], "rest:1")


def test_scorers_take_over_by_row(spark, chunks, models):
    df = chunks.select("chunk_id", plugins.score_chain(["absent", "picky", "lengths"])(F.lit("q"), F.col("text")).alias("s")).select("chunk_id", "s.*")
    got = {r.chunk_id: r for r in df.collect()}
    assert (got["a0"].score, got["a0"].provider) == (5.0, "picky") and "absent: no model here" in got["a0"].error
    assert got["b0"].provider == "lengths" and "picky: gasket" in got["b0"].error and got["b1"].score == -5.0
    alone = {r.chunk_id: r.s for r in chunks.select("chunk_id", plugins.score_chain(["picky"])(F.lit("q"), F.col("text")).alias("s")).collect()}
    assert alone["b0"].score is None and alone["b0"].error == "picky: gasket" and alone["a0"].error is None


def test_embedders_take_over_by_row(spark, models):
    df = spark.createDataFrame([("a",), ("x",), (None,)], "t string")
    got = [r.v for r in df.select(plugins.embed_chain(["none", "two", "rest"])(F.col("t")).alias("v")).collect()]
    assert [(list(v.vector), v.provider, v.signature) for v in got] == [([0.6, 0.8], "two", "two:1"), ([0.0, 1.0], "rest", "rest:1"), ([0.6, 0.8], "two", "two:1")]
    alone = [r.v for r in df.select(plugins.embed_chain(["two"])(F.col("t")).alias("v")).collect()]
    assert alone[1].vector is None and alone[1].provider is None and "two: " in alone[1].error


def test_what_fails_is_in_the_answer(spark, chunks, models):
    questions = asked(spark, ["vacuum pump oil replaced hours", "furnace door gasket inspected weekly"])
    run = lambda **k: {r.query_id: r for r in answer.answer_batch(questions, chunks, models=Models(**k)).collect()}
    got = run(scorers=("absent",))
    assert all(r.degraded and r.status == "NOT_COVERED" and "scoring failed: absent: no model here" in r.errors for r in got.values())
    got = run(scorers=("picky", "lengths"))
    assert got[0].status == "OK" and any("picky: gasket" in e for e in got[1].errors)
    got = run(generator="shy", prompt="{question}|{context}|{question}")
    assert got[0].text == "Said of placed hours [1]。" and got[0].errors == []
    assert got[1].degraded and got[1].errors == ["generation failed: too shy"] and "gasket is inspected weekly" in got[1].text


def test_prompts(spark):
    row = spark.createDataFrame([("{b}", None)], "a string, b string").select(plugins.render_prompt("x {a} {b} {c} {a}", a=F.col("a"), b=F.col("b")).alias("p")).first()
    assert row.p == "x {b}  {c} {b}"
