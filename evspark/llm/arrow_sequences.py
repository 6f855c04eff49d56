"""Token ids in Arrow's file format: equal-length sequences with masks, mapped into memory for random access.

A file holds the ids of documents in ascending order of their ids, cut into rows of `length` ids: a fixed-size list `ids` and a
fixed-size list `mask` (false where the last row is filled up). A second file beside it holds each document's place. The files are
Arrow streams with a footer, so that any batch, and in it any row, is read by its offset without copying the rest.
"""

from __future__ import annotations

import json
import os
import unicodedata
import uuid
import zlib
from array import array
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evspark.llm.common import new_folder, small_batches, slices

LENGTH = 2048
#: Rows of a record batch; tokens after which a file ends with the document.
BATCH_ROWS, FILE_TOKENS = 512, 1 << 23
#: Characters of a text that are split into words at a time.
WINDOW = 1 << 20
#: Words of a generation of the cache of a Python worker; it holds two.
CACHE_WORDS = 400_000
#: Marks that are one piece together after a letter, where no letter, digit or apostrophe follows.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: What a tokenizer file has if white space and marks part words, so that words can be encoded one by one.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
#: The letters by which byte-level vocabularies name bytes: printable ones by themselves, the others by 256, 257, ...
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_NAMES = {b: 256 + k for k, b in enumerate(x for x in range(256) if x not in _PRINTABLE)}


def schema(length: int) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.uint16(), length)), ("mask", pa.list_(pa.bool_(), length))])


def local_path(uri: str) -> str:
    """The path of a shared folder that is mounted on every machine."""
    parts = urlparse(uri)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"sequence files need a mounted folder, not {uri}")
    return parts.path


def _letter(c: str) -> bool:
    """Whether the tokenizer, which composes and lower-cases first, sees letters alone: that makes a letter and a mark of some (U+095C, U+FB2A, U+0130)."""
    return c.isalpha() and (c.isascii() or unicodedata.normalize("NFC", c).lower().isalpha())


class Words(dict):
    """The packed ids of words between spaces, as they are met.

    `by_words` says whether the file's rules let a text's ids be those of its words: white space ends every token, and a word of
    letters, or the marks after it, are one piece each. A file with other rules has its texts encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids are stored in 16 bits")
        own = json.loads(self.tokenizer.to_str())
        model, added = own["model"], own["added_tokens"]
        self.by_words = (
            own["normalizer"] == NORMALIZER and own["pre_tokenizer"] == {"type": "Sequence", "pretokenizers": [SPLIT, BYTES]} and own["truncation"] is None and own["padding"] is None
            and model["type"] == "BPE" and model["end_of_word_suffix"] == "</w>" and not (model["continuing_subword_prefix"] or model["dropout"] or model["unk_token"])
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added)
            # special tokens begin with a mark and have a letter or digit after it, and no space: they are in no word of letters with marks at its end
            and all(t["content"][:1] in MARKS and any(map(str.isalnum, t["content"])) and t["content"].split() == [t["content"]] for t in added)
        )
        self.special = [t["content"] for t in added]
        self.piece = self.tokenizer.model.tokenize
        self.old: dict[str, bytes] = {}
        self.of_marks: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = self._ids(word)
        if len(self) >= CACHE_WORDS:
            self.old = dict(self)
            self.clear()
        self[word] = ids
        return ids

    def _ids(self, word: str) -> bytes:
        """A word that differs from another in ASCII capitals and in marks at its end has the ids of the other, and those of the marks."""
        bare = word.rstrip(MARKS)
        low = bare.lower() if bare.isascii() else bare
        if low.isalpha() and (bare.isascii() or (max(low) < "\u0250" and low == low.lower())):  # letters that composing and lower-casing leave as they are
            ids = None if low == word else self.get(low) or self.old.get(low)
            if ids is None:
                name = low if low.isascii() else low.encode().decode("latin-1").translate(_NAMES)
                ids = array("H", [t.id for t in self.piece(name)]).tobytes()
                if low != word:
                    self[low] = ids
            return ids if len(bare) == len(word) else ids + self.marks(word[len(bare) :])
        if bare and len(bare) < len(word) and _letter(bare[-1]) and not any(x in word for x in self.special):
            return self[bare] + self.marks(word[len(bare) :])
        return self._whole(word)

    def marks(self, word: str) -> bytes:
        if word not in self.of_marks:
            if len(self.of_marks) >= CACHE_WORDS:
                self.of_marks.clear()
            self.of_marks[word] = self._whole(word)
        return self.of_marks[word]

    def _whole(self, text: str) -> bytes:
        return array("H", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> np.ndarray:
        if not self.by_words:
            return np.frombuffer(self._whole(text), np.uint16)
        parts, lo, text = [], 0, text.replace("\n", " ")
        while lo <= len(text):
            hi = text.find(" ", lo + WINDOW) if len(text) - lo > WINDOW else -1
            hi = len(text) if hi < 0 else hi
            parts.append(b"".join(map(self.__getitem__, text[lo:hi].split(" "))))
            lo = hi + 1
        return np.frombuffer(b"".join(parts), np.uint16)


_words: dict[str, Words] = {}


def encode_texts(texts: list[str], path: str) -> Iterator[np.ndarray]:
    """The ids of each text."""
    if path not in _words:
        _words[path] = Words(path)
    yield from map(_words[path].encode, texts)


class Writer:
    """Files of one task, `part`-0, `part`-1, ... Each is written under another name and then renamed, so that a task can run twice."""

    def __init__(self, folder: str, partition: int, length: int, file_tokens: int = FILE_TOKENS):
        self.folder, self.partition, self.length, self.file_tokens, self.done = folder, partition, length, file_tokens, 0
        self.manifest: list[tuple[str, int | None, int, int, int, int]] = []
        self._open()

    def _open(self) -> None:
        self.name = f"part-{self.partition:06d}-{self.done}"
        self.temp = f"{self.folder}/.{self.name}-{uuid.uuid4().hex}"
        self.file = pa.ipc.new_file(self.temp + ".ids", schema(self.length))
        self.index, self.left, self.waiting, self.tokens = [], [], 0, 0

    def _rows(self, upto: int) -> None:
        flat = np.concatenate([*self.left, np.zeros(max(0, upto - self.waiting), np.uint16)]) if self.left else np.zeros(upto, np.uint16)
        mask = np.arange(upto) < self.waiting
        self.left, rest = [flat[upto:]], max(0, self.waiting - upto)
        self.waiting = rest
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (flat[:upto], mask)]
        self.file.write_batch(pa.record_batch(lists, schema=schema(self.length)))

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.index.append((doc_id, self.tokens, len(ids)))
        self.left.append(ids)
        self.waiting += len(ids)
        self.tokens += len(ids)
        while self.waiting >= self.length * BATCH_ROWS:
            self._rows(self.length * BATCH_ROWS)
        if self.tokens >= self.file_tokens:
            self.close()
            self.done += 1
            self._open()

    def close(self) -> None:
        if self.waiting:
            self._rows(-(-self.waiting // self.length) * self.length)
        self.file.close()
        if self.index:
            with pa.ipc.new_file(self.temp + ".index", INDEX) as out:
                out.write_table(pa.table([pa.array(c, pa.int64()) for c in zip(*self.index, strict=True)], schema=INDEX), max_chunksize=1 << 16)
            for kind in ("ids", "index"):
                os.replace(f"{self.temp}.{kind}", f"{self.folder}/{self.name}.{kind}")
            self.manifest.append((self.name, self.index[0][0], len(self.index), self.tokens, self.partition, self.done))
        else:
            os.remove(self.temp + ".ids")


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int, partitions: int, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Encode every text, append `end_id`, and write the files; gives the manifest: file, first_id, n_docs, n_tokens, partition, number (of the file in its partition), base (ids in all files before).

    A null or empty text has the end id alone. Rows without an id come before all others; rows that share an id, or have none, stand
    in the order of a hash of their texts. An empty table gives no file. The texts are dealt out by ranges of their id; a task holds
    one batch of texts and one batch of rows.
    """
    path = local_path(folder)
    os.makedirs(path, exist_ok=True)
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        out = Writer(path, TaskContext.get().partitionId(), length, file_tokens)
        for part in slices(batches):
            texts = [t or "" for t in part.column(1).to_pylist()]
            for doc_id, ids in zip(part.column(0).to_pylist(), encode_texts(texts, tokenizer), strict=True):
                out.add(doc_id, np.append(ids, np.uint16(end_id)))
        out.close()
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
        columns = list(zip(*out.manifest, strict=True)) or [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["file", "first_id", "n_docs", "n_tokens", "partition", "number"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("among", F.xxhash64("text"))
    order = [F.asc_nulls_first("doc_id"), F.asc("among")]
    dealt = rows.repartitionByRange(partitions, *order).sortWithinPartitions(*order, "text").drop("among")
    dealt.mapInArrow(run, "file string, first_id long, n_docs long, n_tokens long, partition int, number int").write.parquet(f"{folder}/manifest")
    before = Window.orderBy("partition", "number").rowsBetween(Window.unboundedPreceding, -1)  # one row a file; names sort -10 before -2
    return docs.sparkSession.read.parquet(f"{folder}/manifest").withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


class Reader:
    """Random access to a file's sequences and documents; nothing is read before it is asked for."""

    def __init__(self, folder: str, name: str):
        self.ids = pa.ipc.open_file(pa.memory_map(f"{folder}/{name}.ids"))
        self.index = pa.ipc.open_file(pa.memory_map(f"{folder}/{name}.index")).read_all()
        self.length = self.ids.schema.field("ids").type.list_size

    def sequences(self, batch: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids (no copy) and mask of a record batch, one row a sequence."""
        got = self.ids.get_batch(batch)
        flat = got.column(0).flatten().to_numpy(zero_copy_only=True)
        return flat.reshape(-1, self.length), got.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, self.length)

    def tokens(self, start: int, n: int) -> np.ndarray:
        """`n` ids from `start` on."""
        size, parts = self.length * BATCH_ROWS, []
        while n > 0:
            flat = self.ids.get_batch(start // size).column(0).flatten().to_numpy(zero_copy_only=True)
            part = flat[start % size : start % size + n]
            parts.append(part)
            start, n = start + len(part), n - len(part)
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.empty(0, np.uint16)


def read_documents(manifest: DataFrame, folder: str) -> DataFrame:
    """From the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    path = local_path(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = Reader(path, name)
                start, n = (own.index.column(k).to_numpy() for k in ("start", "n_tokens"))
                crc = [zlib.crc32(own.tokens(s, k).astype("<u4").tobytes()) for s, k in zip(start.tolist(), n.tolist(), strict=True)]
                columns = [own.index.column("doc_id").combine_chunks(), pa.array(start + base), pa.array(n), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])

    dealt = manifest.select("file", "base").repartition(max(1, manifest.sparkSession.sparkContext.defaultParallelism * 2))
    return dealt.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def write_and_read(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int, partitions: int) -> DataFrame:
    folder = new_folder(spark, "sequences")
    return read_documents(write(docs, folder, tokenizer, end_id, partitions), folder)
