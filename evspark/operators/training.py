"""Quizzes, attempts and certificates."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evspark.functions import text as fx

NUMBER = r"(?<![A-Za-z0-9.-])[0-9]+(?:\.[0-9]+)?(?:×10\^?-?[0-9]+)?"
PASS_MARK, POINTS_SHARE, POINT_OVERLAP = 60.0, 0.6, 0.5


def number_tokens(text: Column | str) -> Column:
    """Numbers of a text that are not parts of codes."""
    return fx.found(text, NUMBER)


def number_key(token: Column) -> Column:
    return F.substring_index(token, "×", 1)


def quiz_sentences(chunks: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """chunk, no, sentence, numbers: sentences of 10 to 200 characters that hold a number, without bullets."""
    tidy = F.regexp_replace(F.regexp_replace("text", r"(?m)^[ \t]*[-*•·]+[ \t]*", ""), r"\*", "")
    each = chunks.select(id_col, F.posexplode(fx.split_sentences(tidy)).alias("no", "sentence"))
    kept = each.filter(F.length("sentence").between(10, 200)).withColumn("numbers", number_tokens("sentence"))
    return kept.filter(F.size("numbers") > 0)


#: Kinds of items in the order in which they take turns; the longest statement, stem and option of a multiple choice.
TYPES = ("single", "judgement", "multiple", "short")
LONGEST_STATEMENT, LONGEST_STEM, LONGEST_OPTION = 160, 120, 80
POINT = NUMBER + r"(?:\s*[A-Za-z%℃°]+(?:/[A-Za-z]+)?)?"
_ITEM = "struct<type:string,question:string,options:array<string>,answer:string,points:array<string>>"


def nearest_numbers(sentences: DataFrame) -> DataFrame:
    """number, near: each different number of the corpus, and the two before and after it in value among those with as many digits and the same first one."""
    each = sentences.select(F.explode("numbers").alias("number")).distinct()
    whole = F.regexp_extract("number", r"^[0-9]+", 0)
    w = Window.partitionBy(F.length(whole), F.substring(whole, 1, 1)).orderBy(number_key(F.col("number")).cast("double"), "number")
    return each.select("number", F.array_compact(F.array(F.lag("number", 1).over(w), F.lead("number", 1).over(w), F.lag("number", 2).over(w), F.lead("number", 2).over(w))).alias("near"))


def _made_once(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)`, in which the value is made once for a row, however often it stands there and in whatever lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _without(numbers: Column, number: Column) -> Column:
    """Those that have another value."""
    return _made_once(number_key(number), lambda key: F.filter(numbers, lambda x: number_key(x) != key))


def _changed(sentence: Column, numbers: Column, at: Column, new: Column) -> Column:
    """The sentence with its number at place `at` changed."""
    parts = lambda between: F.transform(numbers, lambda x, i: F.concat(F.get(between, i), F.when(i == at, new).otherwise(x)))
    return _made_once(F.split(sentence, NUMBER, -1), lambda between: F.concat(F.array_join(parts(between), ""), F.get(between, F.size(numbers))))


def quiz_items(sentences: DataFrame, seed: str = "quiz", id_col: str = "chunk_id", types: tuple[str, ...] = TYPES) -> DataFrame:
    """One item a sentence with a number: chunk, no, type, question, options, answer, points, evidence. Choices go by checksum, so that reruns agree.

    The sentences of a chunk take the types in turn; one that can't be had of a sentence gives way to the next. judgement: the sentence,
    of every second one with a number changed for another of its chunk. single: a number left out, with others of the chunk, or else
    its neighbours in value in the corpus, beside it. multiple: two sentences of the chunk, and the same with a number changed. short:
    all numbers left out; points are the numbers with their units, three at most. A sentence of which no type can be had has no item.
    """
    place, whole, n = Window.partitionBy(id_col).orderBy("no"), Window.partitionBy(id_col), len(types)
    rows = sentences.select(id_col, "no", "sentence", "numbers", (F.row_number().over(place) - 1).alias("pos"), F.sort_array(F.collect_list(F.struct("no", "sentence", "numbers")).over(whole)).alias("all"))  # the sentences of one chunk
    dice = lambda *salt: F.crc32(F.concat_ws("|", F.lit(seed), F.col(id_col).cast("string"), F.col("no").cast("string"), *[F.lit(x) if isinstance(x, str) else x for x in salt]))
    pick = lambda xs, *salt: _made_once(xs, lambda own: F.get(own, (dice(*salt) % F.size(own)).cast("int")))
    shuffled = lambda xs: F.transform(F.sort_array(F.transform(xs, lambda x: F.struct(dice(x).alias("k"), x.alias("x")))), lambda y: y["x"])
    turn = (F.crc32(F.concat_ws("|", F.lit(seed), F.col(id_col).cast("string"))) + F.col("pos")) % n
    rows = rows.withColumns({"of_chunk": F.array_distinct(F.flatten(F.transform("all", lambda x: x["numbers"]))), "at": (dice("number") % F.size("numbers")).cast("int"), "turn": turn})
    rows = rows.withColumn("number", F.get("numbers", F.col("at"))).withColumn("others", _without(F.col("of_chunk"), F.col("number")))
    rows = rows.join(nearest_numbers(sentences), "number", "left")
    length, sentence, numbers, others = F.length("sentence"), F.col("sentence"), F.col("numbers"), F.col("others")

    def altered(x: Column) -> Column:
        def at_place(at: Column) -> Column:
            new = pick(_without(F.col("of_chunk"), F.get(x["numbers"], at)), "value", x["sentence"])
            return _made_once(new, lambda new: F.when(new.isNotNull(), _changed(x["sentence"], x["numbers"], at, new)))

        return _made_once((dice("alter", x["sentence"]) % F.size(x["numbers"])).cast("int"), at_place)

    # what decides which types can be had: each is made once, as what comes after it reads it more than once
    rows = rows.withColumn("beside", F.get(F.filter("all", lambda x: (x["sentence"] != sentence) & (F.length(x["sentence"]) <= LONGEST_OPTION)), F.lit(0)))
    trues = F.array("sentence", F.col("beside")["sentence"])
    falses = F.array_distinct(F.filter(F.array_compact(F.transform(F.array(F.struct("no", "sentence", "numbers"), F.col("beside")), altered)), lambda x: ~F.array_contains(trues, x)))
    near = F.filter(_without(F.coalesce("near", F.array().cast("array<string>")), F.col("number")), lambda x: ~F.array_contains("others", x))
    points = lambda keys: F.slice(F.filter(fx.found(sentence, POINT), lambda x, i: F.array_position(keys, F.get(keys, i)) == i + 1), 1, 3)
    rows = rows.withColumns({
        "falses": F.when((length <= LONGEST_OPTION) & F.col("beside").isNotNull(), falses).otherwise(F.array().cast("array<string>")),
        "wrong": F.when(F.size("others") >= 2, F.slice("others", 1, 3)).otherwise(F.slice(F.concat("others", near), 1, 2)),
        "points": _made_once(F.transform("numbers", number_key), points),
    })
    had = {
        "single": (length <= LONGEST_STEM) & (F.size("wrong") >= 2), "judgement": length <= LONGEST_STATEMENT,
        "multiple": F.size("falses") > 0, "short": (length <= LONGEST_STATEMENT) & (F.size("points") >= 2),
    }
    tried = _made_once(F.array(*[F.when(had[t], t) for t in types]), lambda own: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.get(own, ((F.col("turn") + k) % n).cast("int"))))
    rows = rows.withColumn("kind", F.get(F.array_compact(tried), F.lit(0)))

    item = lambda kind, question, options=None, answer=None, points=None: F.struct(
        F.lit(kind).alias("type"), question.alias("question"), (F.lit(None) if options is None else options).cast("array<string>").alias("options"), (F.lit(None) if answer is None else answer).cast("string").alias("answer"), (F.lit(None) if points is None else points).cast("array<string>").alias("points"),
    ).cast(_ITEM)
    false = (F.col("pos") % 2 == 1) & (F.size("others") > 0)
    right = lambda offered: F.concat(F.lit("["), F.array_join(F.sort_array(F.transform(trues, lambda x: F.array_position(offered, x) - 1)).cast("array<string>"), ","), F.lit("]"))
    made = {
        "single": _made_once(shuffled(F.concat(F.array("number"), "wrong")), lambda choices: item("single", _changed(sentence, numbers, F.col("at"), F.lit("____")), choices, (F.array_position(choices, F.col("number")) - 1).cast("string"))),
        "judgement": item("judgement", F.when(false, _changed(sentence, numbers, F.col("at"), pick(others, "swap"))).otherwise(sentence), None, (~false).cast("string")),
        "multiple": _made_once(shuffled(F.concat(trues, "falses")), lambda offered: item("multiple", F.lit("Which of these statements are right?"), offered, right(offered))),
        "short": item("short", F.array_join(F.split("sentence", NUMBER, -1), "____"), None, None, F.col("points")),
    }
    chosen = reduce(lambda out, t: F.when(F.col("kind") == t, made[t]).otherwise(out), types, F.lit(None).cast(_ITEM))
    # a generator has no row for an item that isn't there, and no filter goes below it, which would make the item once more
    return rows.select(id_col, "no", "sentence", F.inline(F.array_compact(F.array(chosen)))).select(id_col, "no", "type", "question", "options", "answer", "points", F.col("sentence").alias("evidence"))


def quiz_sets(items: DataFrame, n: int, by: str = "quiz_id") -> DataFrame:
    """quiz, requested, kept, dropped, questions (in order, renumbered)."""
    w = Window.partitionBy(by).orderBy("no")
    numbered = items.withColumn("__n", F.row_number().over(w))
    total = numbered.groupBy(by).agg(F.count(F.lit(1)).alias("all"), F.transform(F.sort_array(F.collect_list(F.when(F.col("__n") <= n, F.struct("__n", "question")))), lambda x: x["question"]).alias("questions"))
    return total.select(by, F.lit(n).alias("requested"), F.size("questions").alias("kept"), (F.col("all") - F.size("questions")).alias("dropped"), "questions")


def validate_items(candidates: DataFrame, chunks: DataFrame) -> DataFrame:
    """candidates (item_id, chunk_id, type, question, options, answer) with reject: short stem, wrong type, no evidence, options, or numbers that the cited chunk lacks."""
    text = chunks.select("chunk_id", number_tokens("text").alias("__there"))
    rows = candidates.join(text, "chunk_id", "left")
    stated = number_tokens(F.concat_ws(" ", "question", F.when(F.col("type") == "single", F.get("options", F.col("answer").try_cast("int")))))
    reject = (
        F.when(F.length(F.trim("question")) < 6, "short stem").when(~F.col("type").isin("single", "multiple", "judgement", "short"), "type").when(F.col("__there").isNull(), "no evidence")
        .when(F.col("type").isin("single", "multiple") & (F.coalesce(F.size("options"), F.lit(0)) < 3), "options").when(F.size(F.array_except(stated, "__there")) > 0, "untraceable number")
    )
    return rows.select("item_id", reject.alias("reject"))


def grade(kind: Column, given: Column, answer: Column, points: Column) -> Column:
    """Whether an answer is right: an index or its letter, an exact set, a truth value, or three fifths of the points by character pairs."""
    g, a = F.upper(F.trim(F.coalesce(given, F.lit("")))), F.upper(F.trim(answer))
    index = lambda x: F.when(x.rlike("^[A-H]$"), F.ascii(x) - 65).otherwise(x.try_cast("int"))
    chosen = lambda x: F.array_sort(F.array_distinct(F.transform(F.split(F.regexp_replace(x, r"[\[\] ]", ""), ","), index)))
    truth = lambda x: F.when(x.isin("TRUE", "T", "1", "YES", "对", "正确"), True).when(x.isin("FALSE", "F", "0", "NO", "错", "错误"), False)
    hit = F.filter(points, lambda p: fx.overlap(fx.char_bigrams(p), fx.char_bigrams(given)) >= POINT_OVERLAP)
    right = F.when(kind == "single", index(g) == index(a)).when(kind == "multiple", chosen(g) == chosen(a)).when(kind == "judgement", truth(g) == truth(a))
    return F.coalesce(right.when(kind == "short", F.size(hit) >= POINTS_SHARE * F.size(points)), F.lit(False)) & (g != "")


def score_attempts(graded: DataFrame) -> DataFrame:
    """attempt_id, correct, total, score (one decimal), passed. `graded`: attempt_id, right."""
    return graded.groupBy("attempt_id").agg(F.sum(F.coalesce("right", F.lit(False)).cast("long")).alias("correct"), F.count(F.lit(1)).alias("total")).select(
        "attempt_id", "correct", "total", F.round(100 * F.col("correct") / F.col("total"), 1).alias("score")
    ).withColumn("passed", F.col("score") >= PASS_MARK)


def issue_certificates(requests: DataFrame, attempts: DataFrame, valid_days: int) -> DataFrame:
    """requests (request_id, attempt_id, trainee, issued_at) with expires_at and reject: 'no attempt', 'not passed' or null; `mismatch` warns that the trainee is another."""
    rows = requests.join(attempts.select("attempt_id", "passed", F.col("trainee").alias("__trainee")), "attempt_id", "left")
    reject = F.when(F.col("passed").isNull(), "no attempt").when(~F.col("passed"), "not passed")
    expires = F.col("issued_at") + F.make_dt_interval(F.lit(valid_days))
    return rows.select("request_id", "attempt_id", F.when(reject.isNull(), expires).alias("expires_at"), reject.alias("reject"), (reject.isNull() & (F.col("trainee") != F.col("__trainee"))).alias("mismatch"))


def days_to_expiry(expires: Column, now: Column) -> Column:
    days = (F.unix_timestamp(expires) - F.unix_timestamp(now)) / 86400
    return F.when(days > 0, F.ceil(days)).otherwise(F.floor(days))


def expiring(certificates: DataFrame, days: int, now: Column, most: int = 500) -> DataFrame:
    """Certificates that expire from 30 days ago to `days` from now and are not revoked, the soonest first."""
    add = lambda n: now + F.make_dt_interval(F.lit(n))
    hit = certificates.filter((F.col("status") != "revoked") & F.col("expires_at").between(add(-30), add(days)))
    return hit.withColumn("days", days_to_expiry(F.col("expires_at"), now)).orderBy("expires_at", "id").limit(most)
