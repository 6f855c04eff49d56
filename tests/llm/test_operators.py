"""The ten operators against brute force, on small fixtures with odd rows."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from evspark.llm import arrow_sequences, bpe, exact_dedup, langid, line_dedup, mixing, ngram_join, quality_qda, quality_rules, warc_fixity
from evspark.llm.common import new_folder, tokenizer

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, digest int, n int, line string, `key` string, n_lines int"
BASE = "the quick brown fox jumps over the lazy dog while seven wizards quietly make toxic brew for the evil queen and jack"


def rows_of(texts):
    return [(i, t, "en", f"s{i % 3}" if i and i % 5 else None, len(t or ""), "x", 1, 2, "l", "k", 9) for i, t in texts]


@pytest.fixture(scope="module")
def odd(spark):
    words = BASE.split()
    near = [" ".join([*words[:k], f"w{k}", *words[k + 1 :]]) for k in range(0, 22, 2)]
    long = " ".join(random.Random(5).choice(words) for _ in range(30_000))
    texts = [None, "", " \t ", BASE, BASE.upper(), BASE, "héé Ünï", "HÉÉ Ünï", "one two", "One  Two", *near, " ".join([BASE] * 9), long, "a\nPage 3 of 10 is here now\nb c d", "x\nPage 4 of 10 is here now\ny z", "ß" * 5000, "#$% | <>" * 40]
    rows = [*rows_of(enumerate(texts)), *rows_of([(3, BASE), (None, BASE), (None, None)])]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def test_bpe_is_that_of_the_library(spark, odd, nothing, monkeypatch):
    import public_tokenizers
    import tiktoken

    path = tokenizer("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    pick = random.Random(1)
    parts = ["'", "s", "re", "l", "ll", " ", "\n", "  ", " ", "1", "漢", "!", "😀", "é", "\x1c", "½", "́"]
    texts = ["".join(pick.choice(parts) for _ in range(pick.randint(0, 60))) for _ in range(3000)] + ["ab" * 40_000 + " " * 999 + "x'll" * 999]
    own = bpe.codec(path)
    monkeypatch.setattr(bpe, "RUN", 7)
    for text, (ids, at, ids_at) in zip(texts, own.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
        assert own.decode(ids) == text.encode() == b"".join(own.decoded_runs(ids, at, ids_at))
        assert b"".join(text.encode()[a:b] for a, b in zip(at, [*at[1:], None], strict=False)) == text.encode()
    for row in bpe.decode(bpe.encode(odd, path), path).join(odd.select("doc_id", "text"), "doc_id").filter("doc_id != 3").collect():
        assert bytes(row.decoded).decode() == (row.text or "")
    assert bpe.round_trip(nothing, path).count() == 0 and bpe.round_trip(odd, path).count() == odd.count()


def test_states_do_not_depend_on_blocks():
    kinds = np.random.default_rng(0).integers(0, 8, 5000).astype(np.uint8)
    whole, end = bpe.states_before(kinds, bpe.BEGIN)
    one, state = [], bpe.BEGIN
    for k in kinds.tolist():
        one.append(state)
        state = bpe._step(state, k)
    assert whole.tolist() == one and end == state


def test_exact_dedup(odd, nothing):
    got = exact_dedup.duplicate_groups(odd).collect()
    groups = {}
    for r in odd.select("doc_id", "text").collect():
        groups.setdefault((r.text or "").translate(LOWER), []).append(r.doc_id)
    want = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        want += [(i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    order = lambda rows: sorted(map(tuple, rows), key=str)
    assert order(got) == order(want)
    assert exact_dedup.duplicate_groups(nothing).count() == 0
    assert exact_dedup.exact_dedup(odd).columns == odd.columns


def test_line_dedup(spark, odd, nothing):
    got = {r.doc_id: r.text for r in line_dedup.drop_recurring(odd).filter("doc_id IN (23, 24)").collect()}
    assert sorted(got.values()) == ["a\nPage 3 of 10 is here now\nb c d", "x\ny z"]  # fields with digits are variable; the first document keeps the line
    assert line_dedup.drop_recurring(nothing).count() == 0
    rows = line_dedup.digest(odd).collect()
    assert len(rows) == odd.count()
    clean = spark.createDataFrame(rows_of([(1, "Alpha beta gamma delta epsilon zeta"), (2, "Alpha beta gamma nine eight seven"), (3, "q\n\nq\n")]), SCHEMA)
    assert all(r.n_dropped == 0 for r in line_dedup.digest(clean).collect())


def test_line_dedup_families_of_one_leaf(spark):
    """Three families of a leaf, two of equal size and a small one, each with a variable name; beside them lines of one family each."""
    name = lambda f, i: "abcdefgh"[i] + "xyz"[f] * 3
    family = lambda f, i: " ".join(["all", "rights", "of", *(f"{'pqr'[f]}{x}" for x in "jklmnos"), name(f, i), "end"])
    rows = rows_of([(10 * f + i, family(f, i)) for f in range(3) for i in range((8, 8, 4)[f])] + [(90 + i, f"all rights of {' '.join(c * (i + 2) for c in 'stuvwxyz')} k") for i in range(8)])
    got = {r.doc_id: r.n_dropped for r in line_dedup.digest(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: int(i < 90 and i % 10 > 0) for i in got}
    assert sum(r.n_dropped for r in line_dedup.drop_recurring(spark.createDataFrame(rows, SCHEMA), keep_first=False).collect()) == 20


def test_line_dedup_rows_of_very_many_lines(spark):
    letters = lambda i: "".join("abcdefghij"[int(d)] for d in str(i))
    lines = [f"{letters(i)} line {letters(i * 7)} z" for i in range(100_000)]
    texts = [(1, "\n".join(lines)), (2, "\n".join(lines[::2])), (2, "\n".join([*lines[1::2], "its own line"])), (None, "\n".join(lines[:10]))]
    got = sorted(((r.doc_id or 0, r.n_lines, r.n_dropped) for r in line_dedup.drop_recurring(spark.createDataFrame(rows_of(texts), SCHEMA)).collect()))
    assert got == [(0, 10, 0), (1, 100_000, 10), (2, 50_000, 50_000), (2, 50_001, 50_000)]


def test_mixing(spark, odd, nothing):
    rng = random.Random(3)
    rows = rows_of([(i, " ".join(str(rng.random()) for _ in range(rng.randint(0, 400)))) for i in range(400)])
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix_report(docs).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix_report(docs.repartition(7)).collect()))
    sizes = {r[0]: len(WORD.findall(r[1])) for r in rows}
    source = {r[0]: r[3] for r in rows}
    assert all(r["size"] == sizes[r.doc_id] and r.taken <= 3 * r["size"] for r in got)
    taken, target = {}, {}
    for r in got:
        taken[source[r.doc_id]] = taken.get(source[r.doc_id], 0) + r.taken
        target[source[r.doc_id]] = r.target
    assert all(abs(taken[s] - target[s]) < 0.05 * target[s] for s in target) and abs(sum(target.values()) - sum(sizes.values())) < 1e-6
    texts = {r.doc_id: len(WORD.findall(r.text)) for r in mixing.mixed_documents(docs).collect()}
    assert texts == {r.doc_id: r.taken for r in got if r.taken}
    assert mixing.mix_report(nothing).count() == 0 and mixing.mix_report(odd).count() == odd.count()


def test_targets_and_permutations():
    assert mixing.targets(np.array([10, 100, 100]), np.array([5, 2, 1])).tolist() == [30.0, 120.0, 60.0]
    for n in (1, 2, 3, 64, 1000):
        assert sorted(mixing.permuted(np.arange(n), n, 7).tolist()) == list(range(n))
    assert mixing.draw(3, 100, np.array([0.5, 0.3, 0.2])).tolist() == [50, 30, 20]


def brute_groups(rows, width, percent):
    sets = []
    for i, text in rows:
        w = WORD.findall((text or "").translate(LOWER))
        sets.append((i, frozenset(" ".join(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset()))
    group = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and 100 * len(x & y) >= percent * len(x | y):
                group = [group[b] if g == group[a] else g for g in group]
    return [(i, len(s), min((sets[k][0] for k in range(len(sets)) if group[k] == group[j] and sets[k][0] is not None), default=None)) for j, (i, s) in enumerate(sets)]


@pytest.mark.parametrize("tile", [ngram_join.TILE, 1])
def test_ngram_join(spark, odd, nothing, monkeypatch, tile):
    monkeypatch.setattr(ngram_join, "PAIRS", 64)
    monkeypatch.setattr(ngram_join, "TILE", tile)  # with tiles of one class, all shingles are wide and all groups are dealt out
    rng = random.Random(9)
    words = [f"v{i}" for i in range(300)]
    texts = []
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(20, 120))]
        texts += [" ".join(rng.choice(words) if rng.random() < rng.choice([0, 0.01, 0.03]) else w for w in base) for _ in range(6)]
    docs = spark.createDataFrame(rows_of(enumerate(texts)), SCHEMA)
    want = sorted(brute_groups(enumerate(texts), 4, 85))
    assert sorted(map(tuple, ngram_join.near_duplicates(docs, 4, 85).collect())) == want
    if tile > 1:
        rows = [(r.doc_id, r.text) for r in odd.collect() if len(r.text or "") < 100_000]
        short = odd.filter("length(coalesce(text, '')) < 100000")
        assert sorted(map(tuple, ngram_join.near_duplicates(short, 4, 85).collect()), key=str) == sorted(brute_groups(rows, 4, 85), key=str)
        assert ngram_join.near_duplicates(nothing).count() == 0


def test_ngram_join_rows_without_ids_and_large_ids(spark):
    words, big = [f"v{i}" for i in range(24)], 2**53 + 1
    near = " ".join([*words[:-1], "other"])
    texts = [(5, " ".join(words)), (None, near), (None, near), (big, " ".join(f"x{i}" for i in range(24))), (big + 1, " ".join([*(f"x{i}" for i in range(23)), "y"])), (None, "q"), (None, None)]
    rows = ngram_join.near_duplicates(spark.createDataFrame(rows_of(texts), SCHEMA)).collect()
    assert sorted(map(str, ((r.doc_id, r.component_id) for r in rows))) == sorted(map(str, [(5, 5), (None, 5), (None, 5), (big, big), (big + 1, big), (None, None), (None, None)]))


def test_quality_rules(odd, nothing):
    def brute(t):
        w, seen, cover, dup = WORD.findall(t), {}, set(), 0
        for i in range(len(w) - 4):
            seen.setdefault(tuple(w[i : i + 5]), []).append(i)
        for at in seen.values():
            cover |= {i + k for i in at for k in range(5)} if len(at) > 1 else set()
        lines = [x for x in t.split("\n") if WORD.search(x)]
        dup = len(lines) - len(set(lines))
        return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), dup, len(cover)

    pick = random.Random(2)
    texts = ["".join(pick.choice("ab  \n\té#\x0b ") for _ in range(pick.randint(0, 80))) for _ in range(2000)]
    base = quality_rules.base_features([t.encode() for t in texts])
    assert [tuple(map(int, r[:5])) for r in base.itertuples(index=False)] == [brute(t) for t in texts]
    names = list(quality_rules.RULES)
    verdicts = [[x is None for x in quality_rules.cascade([t.encode() for t in texts], base, order)] for order in (names, names[::-1])]
    assert verdicts[0] == verdicts[1]
    assert quality_rules.judge(odd).count() == odd.count() and quality_rules.judge(nothing).count() == 0


def test_language_id(spark, sf, odd, nothing):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    held = "crc32(cast(doc_id AS string)) % 4 = 2"
    model = langid.train(langid.sample(docs, f"NOT ({held})"))
    rows = langid.label(docs.filter(held), model, extra=("lang",)).collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows) and all(0 <= r.score <= 1 for r in rows)
    (lang, _, spans), (none, zero, _) = langid.identify(model, ["the of that and with " * 9 + "eaux que les nous réan le " * 9, "123 !!"])
    assert len(spans) == 2 and (none, zero) == ("und", 0.0)
    assert langid.label(odd, model).count() == odd.count()
    assert langid.train(langid.sample(nothing, "true")).langs == []
    assert langid.keep_identified(odd, model).filter("text IS NULL OR text = ''").count() == 0


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(4)
    for n in (1, 2, 6):
        scores = rng.normal(size=(n, 3)).astype(np.float32)
        import itertools

        value = lambda p: sum(scores[i, x] for i, x in enumerate(p)) - 1.0 * sum(a != b for a, b in itertools.pairwise(p))
        best = max(itertools.product(range(3), repeat=n), key=value)
        assert value(langid.viterbi(scores, np.array([n]), 1.0).tolist()) == pytest.approx(value(best))


def test_quality_classifier(spark, sf, odd, nothing):
    big = sf.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    rows = quality_qda.score_quality(docs, labels, "crc32(cast(doc_id AS string)) % 5 = 0").join(labels, "doc_id").filter("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert sum((r.quality == 1) == (r.predicted == 1) for r in rows) >= 0.95 * len(rows)
    assert quality_qda.score_quality(odd, labels, "doc_id % 5 = 0").count() == odd.count()
    assert quality_qda.score_quality(nothing, labels.limit(0), "doc_id % 5 = 0").count() == 0
    assert {r.score for r in quality_qda.score_quality(odd, labels.limit(0), "doc_id % 5 = 0").collect()} == {0.5}


def test_token_files(spark, odd, nothing, monkeypatch):
    from tokenizers import Tokenizer

    path = tokenizer("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    pick = random.Random(3)
    parts = ["'", "s", "re", "A", "É", "é", " ", "\n", "\t", "1", "漢", "!", "İ", "Σ", "\x85", ".", "K", "a.", "<|endoftext|>", "ı", "ÿ", "&&&"]
    texts = ["".join(pick.choice(parts) for _ in range(pick.randint(0, 30))) for _ in range(3000)]
    assert [x.tolist() for x in arrow_sequences.encode_texts(texts, path)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    long = "One two, three. " * 200_000
    assert next(arrow_sequences.encode_texts([long], path)).tolist() == library.encode(long, add_special_tokens=False).ids
    other = tokenizer("byte_bpe_50k.json")  # other rules: texts are encoded whole
    assert not arrow_sequences.Words(other).by_words and arrow_sequences.Words(path).by_words
    assert [x.tolist() for x in arrow_sequences.encode_texts(texts[:300], other)] == [Tokenizer.from_file(other).encode(t, add_special_tokens=False).ids for t in texts[:300]]
    monkeypatch.setattr(arrow_sequences, "CACHE_WORDS", 50)
    assert [x.tolist() for x in arrow_sequences.encode_texts(texts, path)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    docs = odd.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    folder = new_folder(spark, "test-sequences")
    manifest = arrow_sequences.write(docs, folder, path, 2, 3, length=64)
    start = 0
    found = {r.doc_id: r for r in arrow_sequences.read_documents(manifest, folder).collect()}
    for r in docs.orderBy("doc_id").collect():
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 2]
        assert tuple(found[r.doc_id]) == (r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    name = manifest.first().file
    own = arrow_sequences.Reader(arrow_sequences.local_path(folder), name)
    ids, mask = own.sequences(0)
    assert ids.shape == mask.shape and ids.shape[1] == 64 and mask[:-1].all()
    assert arrow_sequences.write_and_read(spark, nothing, path, 2, 3).count() == 0


def test_token_files_beyond_ten_in_a_partition(spark):
    path = tokenizer("word_bpe_49k.json")
    docs = spark.createDataFrame(rows_of([(i, "one two three " * (i % 5 + 1)) for i in range(40)]), SCHEMA)
    folder = new_folder(spark, "test-sequences")
    manifest = arrow_sequences.write(docs, folder, path, 2, 1, length=4, file_tokens=8)
    assert manifest.count() > 10
    start = 0
    for r in sorted(arrow_sequences.read_documents(manifest, folder).collect()):
        assert r.start == start
        start += r.n_tokens


def test_token_files_split_letters_and_rows_without_an_id(spark, odd):
    from tokenizers import Tokenizer

    path = tokenizer("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    texts = ["सड़क", "सड़. सड़क, a", "\ufb2a\u05d0 ok", "\ufb2a.", "Page सड़क सडक"]
    texts += [f"{chr(c)} a{chr(c)} {chr(c)}b {chr(c)}. a{chr(c)}," for c in range(0x80, 0x30000) if chr(c).isalpha() and not 0x3400 <= c < 0xD7A4 and c < 0x20000]
    assert [x.tolist() for x in arrow_sequences.encode_texts(texts, path)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    big = 2**53 + 1
    docs = odd.unionByName(spark.createDataFrame(rows_of([(None, "सड़क"), (big, "सड़क")]), SCHEMA))
    rows = arrow_sequences.write_and_read(spark, docs, path, 2, 3).collect()
    crc = lambda t: zlib.crc32(np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes())
    assert sorted((str(r.doc_id), r.ids_crc32) for r in rows) == sorted((str(r.doc_id), crc(r.text)) for r in docs.collect())
    start = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == start
        start += r.n_tokens
    ids = [r.doc_id for r in sorted(rows, key=lambda r: r.start)]
    assert ids[:3] == [None] * 3 and ids[-1] == big


def test_rows_that_share_an_id(spark, odd):
    long, other = " ".join(f"u{i}" for i in range(300)), " ".join(f"o{i}" for i in range(70))
    texts = [(1, long), (1, other), (1, other), (2, long), (None, long), (None, long), (None, BASE), (3, BASE), (1, "alone a b c d e f")]
    docs = spark.createDataFrame(rows_of(texts), SCHEMA)
    of = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    kept = [(1, long), (1, other), (3, BASE), (1, "alone a b c d e f")]
    assert of(ngram_join.drop_near_duplicates(docs)) == sorted(kept, key=str)
    assert of(exact_dedup.exact_dedup(docs)) == sorted([(2, long), (1, other), (3, BASE), (1, "alone a b c d e f")], key=str)
    for rows in (docs, odd):
        report = [(str(r.doc_id), r.taken) for r in mixing.mix_report(rows).collect() if r.taken]
        mixed = mixing.mixed_documents(rows)
        assert mixed.schema.simpleString() == rows.schema.simpleString()
        assert sorted(report) == sorted((str(r.doc_id), len(WORD.findall(r.text))) for r in mixed.collect())
    nobody = spark.createDataFrame(rows_of([(None, f"{BASE} w{i % 2}") for i in range(4)]), SCHEMA)
    assert ngram_join.drop_near_duplicates(nobody).count() == 1
    assert len({r.text for r in exact_dedup.exact_dedup(odd).collect()}) == exact_dedup.exact_dedup(odd).count()


def test_warc_audit(spark, sf, nothing):
    pages = spark.read.parquet(f"{sf}/pages.parquet").unionByName(spark.createDataFrame([(None, None, None), (7, "u", "é\r\n\r\nx"), (7, "u", "again"), (7, "u", "again"), (None, "http://a\r\nContent-Length: 0", "y"), (2**53 + 1, "u\r\nbroken", "z")], "page_id long, url string, html string"))
    a, b = new_folder(spark, "test-warc"), new_folder(spark, "test-warc")
    index = warc_fixity.write(pages, a, 3, "2024-01-01T00:00:00Z")
    warc_fixity.copy_replica(index, a, b, "page_id % 10 = 3")
    rows = warc_fixity.audit(index, a, b).collect()
    assert len(rows) == pages.count() and all(r.intact == (r.page_id is None or r.page_id % 10 != 3) for r in rows)
    read = {}
    for row in rows:
        with open(f"{warc_fixity.local_path(a)}/{row.file}", "rb") as own:
            own.seek(row.offset)
            headers, body = warc_fixity.read_record(own.read(row.length))
        assert len(headers) == 6 and headers["WARC-Record-ID"] not in read
        read[headers["WARC-Record-ID"]] = (headers["WARC-Target-URI"], body.decode())
    assert ("u", "é\r\n\r\nx") in read.values() and ("http://a%0D%0AContent-Length: 0", "y") in read.values()
    assert read[f"<urn:page:{2**53 + 1}>"] == ("u%0D%0Abroken", "z") and read["<urn:page:8>"][1] == pages.filter("page_id = 8").first().html
    whole = spark.read.parquet(f"{sf}/pages.parquet")  # a record does not depend on others
    alone = {r.page_id: r.record_sha256 for r in warc_fixity.write(whole, new_folder(spark, "test-warc"), 2, "2024-01-01T00:00:00Z").collect()}
    assert all(alone.get(r.page_id) == r.record_sha256 for r in rows if r.page_id not in (None, 7, 2**53 + 1))
    none = warc_fixity.write(nothing.selectExpr("doc_id AS page_id", "text AS url", "text AS html"), new_folder(spark, "test-warc"), 2, "x")
    assert none.count() == 0
