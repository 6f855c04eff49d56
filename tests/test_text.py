from pyspark.sql import functions as F

from evspark.functions import text as fx
from evspark.operators import citations, ingest


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column).first()[0]


def test_tokenize_chinese_and_ascii(spark):
    assert one(spark, fx.tokenize("t"), "腔体门 O-ring 更换") == ["腔", "体", "门", "腔体", "体门", "更", "换", "更换", "o", "ring"]
    assert one(spark, fx.tokenize("t"), None) == []


def test_sentences_and_bigrams(spark):
    assert one(spark, fx.split_sentences("t"), "先停机。再检查！ 好吗？") == ["先停机。", "再检查！", "好吗？"]
    assert one(spark, fx.char_bigrams("t"), "停机, 停机") == ["停机", "机停"]
    assert one(spark, fx.char_bigrams("t"), "停") == ["停"]
    assert one(spark, fx.char_bigrams("t"), "，") == []


def test_clean_text(spark):
    assert one(spark, fx.clean_text("t"), "exam-\nple\r\n 12 \n\n\n\na  b　　c ") == "example\n\na b c"


def test_masks_and_titles(spark):
    assert one(spark, fx.mask_secrets("t"), "key sk-abcdef123 Bearer abcdefgh1") == "key sk-*** Bearer ***"
    assert one(spark, fx.title("t"), "  ") == "新会话"
    assert one(spark, fx.normalize_question("t"), "腔体门 O-ring 还有库存吗？") == "腔体门oring还有库存吗"


def test_parse_citation_ids(spark):
    assert one(spark, citations.parse_citation_ids("t"), "甲 [1,3] 乙 [2-4] ［1］") == [1, 3, 2, 4]
    assert one(spark, citations.parse_citation_ids("t"), "无") == []


def test_sentence_kinds(spark):
    kinds = {"- 《刻蚀设备维护手册》 V3.2 第 3 页 章节 3.4": "attribution", "建议先检查腔体密封情况。": "exempt", "知识库未覆盖该问题的答案。": "disclaimer", "腔体压力应保持在 5 Pa 以下。": "claim", "好。": "short"}
    rows = spark.createDataFrame([(k,) for k in kinds], "t string").select("t", citations.sentence_kind(F.col("t"))).collect()
    assert dict(map(tuple, rows)) == kinds


def test_confidence_and_enforcement(spark):
    assert one(spark, citations.confidence(F.lit(0.5), F.lit(1.0), F.lit(0.9)), "") == 0.775
    answers = spark.createDataFrame([(1, "真空度应低于五帕才能启动。月亮是奶酪做成的球体。")], "answer_id long, text string")
    blocks = spark.createDataFrame([(1, 1, "启动前真空度应低于五帕才能启动。")], "answer_id long, n long, text string")
    row = citations.enforce_citations(answers, blocks).first()
    assert (row.text, row.attributed, row.dropped) == ("真空度应低于五帕才能启动 [1]。", 1, 1)


def test_manual_structure(spark):
    text = "# 手册\n<!-- page: 1 -->\n## 3.4 真空\n检查泵。\n<!-- page: 3 -->\n### 3.5 门\n换圈。\n#### 无号\n再看。"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    blocks = ingest.assemble_blocks(ingest.forward_fill_structure(ingest.explode_lines(docs))).orderBy("block_no").collect()
    assert [(b.page, b.section, b.text) for b in blocks] == [(1, "", "# 手册"), (1, "3.4", "检查泵。"), (3, "3.5", "换圈。\n再看。")]


def test_chunks_stay_near_the_size(spark):
    docs = spark.createDataFrame([(1, 0, 1, "1", "h", "这是一个用来凑长度的句子。" * 200), (2, 0, 1, "1", "h", None)], "doc_id long, block_no long, page int, section string, heading string, text string")
    rows = ingest.chunk_blocks(docs, 300, 50).collect()
    assert len(rows) > 1 and all(len(r.text) <= 420 for r in rows) and [r["index"] for r in rows] == list(range(len(rows)))
    assert {r.doc_id for r in rows} == {1}


def test_repeated_lines(spark):
    rows = [(1, p, 10 * p + k, line) for p in range(1, 6) for k, line in enumerate(["Header", f"body {p}", "Footer"])]
    left = ingest.strip_repeated_lines(spark.createDataFrame(rows, "doc_id long, page int, pos int, line string"))
    assert sorted(r.line for r in left.collect()) == [f"body {p}" for p in range(1, 6)]


def test_noise_of_questions_is_no_content(spark):
    terms = one(spark, citations.anchors(F.col("t"))[2], "请问，如何 更换，滤芯")
    assert sorted(terms) == ["更换", "滤芯"]


def test_paragraphs(spark):
    long = "\n".join(["甲" * 250] * 7)
    assert one(spark, ingest.split_paragraphs(F.col("t")), f" a\nb \n \t\n\n{long}\n\n") == ["a\nb", *["\n".join(["甲" * 250] * 3)] * 2, "甲" * 250]
    assert one(spark, ingest.split_paragraphs(F.col("t")), None) == [] == one(spark, ingest.split_paragraphs(F.col("t")), " \n\n ")
