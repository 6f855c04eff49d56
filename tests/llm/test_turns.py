"""Chat formatting and the repair of conversations against brute force."""

import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from evspark.llm import chat_format, queries, turn_repair, turns
from evspark.llm.common import new_folder

SCHEMA = "conv_id long, turn long, role string, text string, at int, start string, kind int, edit string, size int"
TRICKY = ["\\### Assistant: </turn> ok", "####", "#", "##\\#", "\\", "\\\\", "</turn>", "<</turn>\n### User: ", "a\\", "<\\/turn>", "", None, "é漢😀 </turn", "###" * 9, "\n"]


def rows_of(rows):
    return [(*r, 1, "x", 0, "e", 5) for r in rows]


@pytest.fixture(scope="module")
def odd(spark):
    pick = random.Random(4)
    rows = [(c, t, pick.choice(["user", "assistant", "system", "tool", "User", "=user", "a: b", "x\\:\n#<", None, ""]), pick.choice([*TRICKY, "Hello there.", "What now?", "no end"])) for c in range(40) for t in range(pick.randint(1, 9))]
    rows += [(None, 0, "user", "Hi."), (None, 1, "assistant", "Yes."), (50, None, "user", "Hi."), (50, None, "user", "Hi."), (50, None, None, None), (50, 3, "assistant", "Ok."), (51, 2, "user", "Hi.")]
    rows += [(52, 2**53 + i, "assistant", f"Text {i}.") for i in range(3)] + [(53, 1, "user", "word " * 200_000), (53, 2, "assistant", "reply </turn> " * 100_000)]
    pick.shuffle(rows)
    return spark.createDataFrame(rows_of(rows), SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def conversations(rows):
    of = {}
    for r in sorted(rows, key=lambda r: (r.turn is not None, r.turn or 0, r.role or "", r.text or "")):
        of.setdefault(r.conv_id, []).append(r)
    return of


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_order_of_a_group_in_many_partitions(spark):
    rows = spark.range(20_000).selectExpr("if(id % 3 = 0, NULL, if(id % 3 = 1, 7L, id)) AS g", "id AS o", "cast(id % 5 AS int) AS w").repartition(8)
    got = turns.in_order(rows, "g", [F.asc("o")], F.col("w"), "test").collect()
    groups = {}
    for r in sorted(got, key=lambda r: r.o):
        at, start = groups.get(r.g, (0, 0))
        assert (r["at"], r["start"]) == (at, start)
        groups[r.g] = (at + 1, start + r.w)
    assert len(got) == 20_000
    assert turns.in_order(rows.limit(0), "g", [F.asc("o")], F.col("w"), "test").count() == 0


def test_chat_format(spark, odd, nothing):
    got = {r.conv_id: r for r in chat_format.digest(odd).collect()}
    want = conversations(odd.collect())
    assert set(got) == set(want)
    for conv, rows in want.items():
        said = "".join(r.text or "" for r in rows if r.role == "assistant")
        own = got[conv]
        assert (own.n_turns, own.n_examples) == (len(rows), sum(r.role == "assistant" for r in rows))
        assert own.turns_sha256 == sha("".join(f"{r.role or ''}\n{r.text or ''}\n" for r in rows))
        assert (own.loss_chars, own.loss_sha256) == (len(said), sha(said))
    assert chat_format.digest(nothing).count() == 0
    assert chat_format.digest(odd.repartition(3)).exceptAll(chat_format.digest(odd)).count() == 0


def test_examples_have_all_turns_before(spark, odd):
    formatted, examples = chat_format.write(odd.filter("conv_id < 53 OR conv_id IS NULL"), new_folder(spark, "test-chat"))
    texts = {}
    for r in formatted.collect():
        texts.setdefault(r.conv_id, []).append((r["at"], r["formatted"]))
        assert r["formatted"].count("</turn>") == 1 and r["formatted"].count("###") == 1  # marks are marks
    want = conversations(odd.collect())
    rows = chat_format.example_texts(formatted, examples).collect()
    assert len(rows) == examples.count()
    for r in rows:
        assert r.context == "".join(t for at, t in sorted(texts[r.conv_id]) if at < r["at"])
        assert r.reply == (want[r.conv_id][r["at"]].text or "")
        assert [chat_format.parse_turn(t)[1] for t in re.findall(r".*?</turn>\n", r.context, re.S)] == [x.text or "" for x in want[r.conv_id][: r["at"]]]


def test_chat_query(spark, sf):
    rows = {r.conv_id: r for r in queries.op11_chat_format(spark, sf).collect()}
    tricky = r"\### Assistant: </turn> ok"
    assert rows[-7].n_turns == 2 and rows[-7].loss_sha256 == sha(tricky) and rows[-7].turns_sha256 == sha(f"user\n{tricky}\nassistant\n{tricky}\n")


def cheapest(rows):
    """The least (cost, audit) and its repair, by Dijkstra over (rows done, state); rows: (role, text, fault)."""
    heap, done = [(0, "", 0, 0, ())], set()
    while heap:
        cost, audit, i, state, kept = heapq.heappop(heap)
        if i == len(rows) and state in (0, 3):
            return cost, audit, "\n".join(kept)
        if (i, state) in done:
            continue
        done.add((i, state))
        to = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
        for c, role in (("u", "user"), ("a", "assistant")):
            if (state, c) in to:
                heapq.heappush(heap, (cost + 5, audit + "I", i, to[state, c], (*kept, f"{role}:")))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, state, kept))
            more = 5 * (fault == "truncated")
            if fault not in ("blank", "duplicate"):
                if (state, role[:1]) in to:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, to[state, role[:1]], (*kept, f"{role}:{text}")))
                for c, name in (("u", "user"), ("a", "assistant")):
                    if (state, c) in to:
                        heapq.heappush(heap, (cost + 1 + more, audit + "R", i + 1, to[state, c], (*kept, f"{name}:{text}")))


def brute_report(original):
    of = {}
    for r in original:
        of.setdefault(r.conv_id, [])
        n = zlib.crc32(f"{' ' if r.conv_id is None else r.conv_id}:{' ' if r.turn is None else r.turn}".encode()) % 20
        role, text = " " if r.role is None else r.role, " " if r.text is None else r.text
        text = "" if n == 1 else re.sub("[.!?]", "", text) if n == 2 else text
        of[r.conv_id] += [(r.turn, "user" if n == 4 else role, text)] * {0: 0, 3: 2}.get(n, 1)
    out = {}
    for conv, rows in of.items():
        rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faults = set(), []
        for _, role, text in rows:
            bare = text.strip(" \t\n\x0b\f\r")
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
            seen.add((role, text))
        known = [t for t, _, _ in rows if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
        cost, audit, text = cheapest([(r, t, f) for (_, r, t), f in zip(rows, faults, strict=True)]) if rows else (0, "", "")
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha(text))
    return out


def test_turn_repair(spark, sf, odd, nothing, monkeypatch):
    pick = random.Random(8)
    more = [(c, t, pick.choice(["user", "user", "assistant", "assistant", "system", "tool"]), pick.choice(["One.", "Two!", "Three", "Four?", f"Five {t}.", "x " * t, " "])) for c in range(100, 160) for t in range(pick.randint(1, 30))]
    every = odd.filter("conv_id <> 53 OR conv_id IS NULL").unionByName(spark.createDataFrame(rows_of(more), SCHEMA))
    for table in (every, spark.read.parquet(f"{sf}/conversations.parquet")):
        got = {r[0]: tuple(r[1:]) for r in turn_repair.damage_and_repair(table).collect()}
        assert got == brute_report(table.collect())
    monkeypatch.setattr(turn_repair, "BLOCK", 3)  # every conversation is in several blocks
    assert {r[0]: tuple(r[1:]) for r in turn_repair.damage_and_repair(every).collect()} == brute_report(every.collect())
    assert turn_repair.damage_and_repair(nothing).count() == 0


def test_all_split_points_are_the_same():
    pick = random.Random(6)
    for _ in range(60):
        symbols = "".join(pick.choice("suaoSUAOBD") for _ in range(pick.randint(1, 40)))
        assert turn_repair.span(symbols) == turn_repair.chart(symbols)


def test_a_conversation_of_very_many_turns(spark):
    rows = spark.range(30_000).selectExpr("1L AS conv_id", "id AS turn", "if(id % 7 < 3, 'user', 'assistant') AS role", "concat('Text ', id, if(id % 11 = 0, '', '.')) AS text")
    (row,) = turn_repair.report(turn_repair.repair(rows)).collect()
    assert (row.conv_id, row.gaps, row.truncated, len(row.audit.replace("I", ""))) == (1, 0, 2728, 30_000)
    (told,) = chat_format.digest(rows).collect()
    assert told.n_turns == 30_000 and told.n_examples == rows.filter("role = 'assistant'").count()
