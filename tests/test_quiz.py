import random
import re
import zlib

import pytest

from evspark.operators import training

NUMBER = re.compile(training.NUMBER)
POINT = re.compile(training.POINT)


def value(x):
    return x.split("×")[0]


def slow_items(rows, types, seed="quiz"):
    """Item by item, sentence by sentence."""
    corpus = sorted({x for _, _, s in rows for x in NUMBER.findall(s)}, key=lambda x: (float(value(x)), x))
    chunks = {}
    for c, no, s in sorted(rows):
        chunks.setdefault(c, []).append((no, s))
    out = {}
    for c, sentences in chunks.items():
        in_chunk = list(dict.fromkeys(x for _, s in sentences for x in NUMBER.findall(s)))
        for pos, (no, s) in enumerate(sentences):
            dice = lambda *salt, no=no, c=c: zlib.crc32("|".join([seed, str(c), str(no), *salt]).encode())
            change = lambda t, at, new: (m := list(NUMBER.finditer(t))[at]) and t[: m.start()] + new + t[m.end() :]
            unlike = lambda x: [y for y in in_chunk if value(y) != value(x)]  # noqa: E731, B023
            shuffled = lambda xs: sorted(xs, key=lambda x: (dice(x), x))  # noqa: E731, B023
            numbers = NUMBER.findall(s)
            at = dice("number") % len(numbers)
            number, others = numbers[at], unlike(numbers[at])

            def judgement():
                if len(s) > 160:
                    return None
                false = pos % 2 == 1 and others
                return ("judgement", change(s, at, others[dice("swap") % len(others)]) if false else s, None, "false" if false else "true", None)

            def single():
                kin = [x for x in corpus if len(x.split(".")[0].split("×")[0]) == len(number.split(".")[0].split("×")[0]) and x[0] == number[0]]
                k = kin.index(number)
                near = [kin[i] for i in (k - 1, k + 1, k - 2, k + 2) if 0 <= i < len(kin)]
                near = [x for x in near if value(x) != value(number) and x not in others]
                wrong = others[:3] if len(others) >= 2 else (others + near)[:2]
                if len(s) > 120 or len(wrong) < 2:
                    return None
                options = shuffled([number, *wrong])
                return ("single", change(s, at, "____"), options, str(options.index(number)), None)

            def multiple():
                beside = next((t for _, t in sentences if t != s and len(t) <= 80), None)
                if len(s) > 80 or beside is None:
                    return None
                falses = []
                for t in (s, beside):
                    own = NUMBER.findall(t)
                    i = dice("alter", t) % len(own)
                    if new := unlike(own[i]):
                        wrong = change(t, i, new[dice("value", t) % len(new)])
                        falses += [wrong] if wrong not in (s, beside) and wrong not in falses else []
                options = shuffled([s, beside, *falses])
                return ("multiple", "Which of these statements are right?", options, "[" + ",".join(map(str, sorted([options.index(s), options.index(beside)]))) + "]", None) if falses else None

            def short():
                keys = [value(x) for x in numbers]
                points = [m.group() for i, m in enumerate(POINT.finditer(s)) if keys.index(keys[i]) == i][:3]
                return ("short", NUMBER.sub("____", s), None, None, points) if len(s) <= 160 and len(points) >= 2 else None

            made = {"single": single, "judgement": judgement, "multiple": multiple, "short": short}
            start = zlib.crc32(f"{seed}|{c}".encode()) + pos
            item = next((x for k in range(len(types)) if (x := made[types[(start + k) % len(types)]]())), None)
            if item:
                out[c, no] = (*item, s)
    return out


@pytest.mark.parametrize("types", [training.TYPES, ("single",), ("multiple", "short"), ("judgement",)])
def test_items(spark, types):
    pick = random.Random(len(types))
    unit = lambda: pick.choice([" Pa", " mm/s", " h", "%", "", " 片"])
    sentence = lambda: "The value of part A-7 " + " and ".join(f"is {pick.choice([pick.randint(1, 40), pick.randint(1, 9) / 10, pick.randint(900, 1200), '2×10^3', '2×10^4'])}{unit()}" for _ in range(pick.randint(1, 4))) + pick.choice(["", " as measured" * pick.randint(1, 9)]) + "。"
    texts = [(i, "\n".join(sentence() for _ in range(pick.randint(1, 5)))) for i in range(120)] + [(120, None), (121, "no number in this sentence here。")]
    sentences = training.quiz_sentences(spark.createDataFrame(texts, "chunk_id int, text string"))
    rows = [(r.chunk_id, r.no, r.sentence) for r in sentences.collect()]
    got = {(r.chunk_id, r.no): tuple(r[2:]) for r in training.quiz_items(sentences, types=types).collect()}
    want = slow_items(rows, types)
    assert got == want and {x[0] for x in got.values()} == set(types)
    if len(types) == 4:
        assert len(got) >= 0.9 * len(rows)  # a judgement can be had of all but the longest
    for kind, question, options, answer, points, evidence in got.values():
        if kind == "single":
            assert question.replace("____", options[int(answer)]) == evidence and len(set(options)) == len(options) >= 3
        if kind == "judgement":
            assert (question == evidence) == (answer == "true")
        if kind == "multiple":
            assert len(options) >= 3 and evidence in [options[int(i)] for i in answer[1:-1].split(",")]
        if kind == "short":
            assert all(p in evidence for p in points) and 2 <= len(points) <= 3
    assert training.quiz_items(sentences.limit(0), types=types).count() == 0


def test_what_decides_an_item_stands_once_in_the_plan(spark):
    rows = training.quiz_sentences(spark.createDataFrame([(1, "It needs 5 bolts and 8 rings.")], "chunk_id long, text string"))
    plan = training.quiz_items(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("alter") == 1 and plan.count("swap") == 1  # each was made again for the test of whether there is an item
