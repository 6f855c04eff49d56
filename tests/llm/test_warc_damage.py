"""Damage that no record of the index shows by itself."""

import os
import shutil

import pytest

from evspark.llm import warc_fixity
from evspark.llm.common import new_folder


@pytest.fixture
def replicas(spark, sf, monkeypatch):
    monkeypatch.setattr(warc_fixity, "FILE_BYTES", 4000)
    a, b = new_folder(spark, "test-warc"), new_folder(spark, "test-warc")
    index = warc_fixity.write(spark.read.parquet(f"{sf}/pages.parquet"), a, 3, "2024-01-01T00:00:00Z")
    warc_fixity.copy_replica(index, a, b)
    return index, a, b


def found(index, a, b):
    return sorted((r.file, r.seq, r.what) for r in warc_fixity.compare(index, a, b).collect())


def test_damage_is_found(spark, replicas):
    index, a, b = replicas
    path = warc_fixity.local_path(b)
    count = {r.file: r["count"] for r in index.groupBy("file").count().collect()}
    names = sorted(count)
    assert len(names) > 5 and found(index, a, b) == [] and warc_fixity.audit(index, a, b).filter("NOT intact").count() == 0
    with open(f"{path}/{names[0]}", "ab") as f:
        f.write(b"x" * 700)
    os.remove(f"{path}/{names[1]}")
    last = index.filter(index.file == names[2]).orderBy("seq").collect()[-1]
    os.truncate(f"{path}/{names[2]}", last.offset + last.length - 5)
    with open(f"{path}/part-999999-0000.warc.gz", "wb") as f:
        f.write(b"a file that nobody knows")
    open(f"{path}/part-999998-0000.warc.gz", "wb").close()  # an empty file counts as not there
    third = index.filter(index.file == names[3]).orderBy("seq").first()
    with open(f"{path}/{names[3]}", "r+b") as f:
        f.seek(third.offset)
        f.write(b"\0")
    want = [(names[0], count[names[0]], "extra"), *((names[1], i, "missing") for i in range(count[names[1]])), (names[2], last.seq, "changed"), (names[3], third.seq, "changed"), ("part-999999-0000.warc.gz", 0, "extra")]
    assert found(index, a, b) == sorted(want)
    assert found(index, b, a) == sorted((f, s, {"extra": "missing", "missing": "extra"}.get(w, w)) for f, s, w in want)
    bad = {(r.file, r.seq) for r in warc_fixity.audit(index, a, b).filter("NOT intact").collect()}
    assert bad == {(f, s) for f, s, _ in want if s < count.get(f, 0)}


def test_a_file_longer_than_all_others(spark, replicas):
    index, a, b = replicas
    name = index.first().file
    for folder, size in ((a, 10), (b, 11)):
        with open(f"{warc_fixity.local_path(folder)}/{name}", "ab") as f:
            f.write(b"y" * size)
    assert [x[2] for x in found(index, a, b)] == ["changed"]  # both have bytes beyond, of different lengths
    shutil.rmtree(warc_fixity.local_path(b))
    os.makedirs(warc_fixity.local_path(b))
    assert {x[2] for x in found(index, a, b)} == {"missing"} and len(found(index, a, b)) == index.count() + 1


def test_one_root_for_a_replica(spark, replicas):
    index, a, b = replicas
    root = lambda x: warc_fixity.crown(warc_fixity.tree(warc_fixity.read_digests(warc_fixity.places(index, x), x))[-1])[-1].collect()
    one, two = root(a), root(b)
    assert len(one) == 1 and one[0].key == "" and one == two
