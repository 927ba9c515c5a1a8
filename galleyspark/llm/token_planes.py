"""Token ids as bit or byte planes: documents become id blocks, each block is transposed into planes, each plane is compressed.

File format. A dataset is a folder with two Parquet tables.

``chunks``: one row for about ``chunk_ids`` ids of whole documents, in ascending document order.
  ``part``, ``chunk``   place in the order: parts ascend with doc_id, chunks ascend within a part
  ``offset``            ids of the part before this chunk
  ``doc_ids``, ``counts``  the documents of the chunk and their id counts
  ``block_ids``         ids to a block (the last block of a chunk may be shorter)
  ``kind``              ``byte`` (4 planes) or ``bit`` (32 planes) of little-endian unsigned 32-bit ids
  ``planes``            blocks x planes zstandard frames, plane after plane within a block

``index``: the chunk index: ``part``, ``chunk``, ``first_doc``, ``n_docs``, ``n_ids`` and ``first_id``, the global position of its first id.
A reader finds any id position or document through the index and decodes that chunk alone.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from galleyspark.llm.base import bounded_batches, portions, query, settle, table

CHUNKS = "part int, chunk int, offset long, doc_ids array<long>, counts array<long>, block_ids int, kind string, planes array<binary>"
END_ID = 2


#: Texts of these characters alone are cut into words here just as the vocabulary file's own rules cut them.
PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-\xa9\xab\xac\xae-\xb1\xb6\xb7\xbb\xbf-\xff\u2010-\u2027]*")
WORD = re.compile(r"[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^a-z0-9\s\xdf-\xf6\xf8-\xff]+")  # of lower-case texts
WORD_END = "</w>"


class WordIds:
    """Ids of texts by a word-end BPE file, with the ids of words seen before at hand.

    A token never spans two words, so a text's ids are those of its words. New words go through the library, many at once; the last
    token of each is known by its word-end mark. Texts with other characters, or with the strings of special tokens, go through the
    library whole. Words are held in two generations: when the younger holds ``most``, it replaces the older.
    """

    def __init__(self, path: str, most: int = 150_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism; idle thread pools hold memory
        from tokenizers import Tokenizer

        self.model, self.most = Tokenizer.from_file(path), most
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        vocabulary = self.model.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith(WORD_END)]] = True

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(got.ids, "<u4").tobytes() for got in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, words: list[str], together: int = 500) -> None:
        lists = [words[i : i + together] for i in range(0, len(words), together)]
        for some, got in zip(lists, self.model.encode_batch_fast([" ".join(x) for x in lists], add_special_tokens=False), strict=True):
            ids = np.array(got.ids, "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(some):
                raw, cuts = ids.tobytes(), (4 * cuts).tolist()
                self.young.update(zip(some, (raw[i:j] for i, j in zip([0, *cuts], cuts)), strict=True))
            else:
                self.young.update(zip(some, self.whole(some), strict=True))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if len(self.young) > self.most:
            self.old, self.young = self.young, {}
        texts = [t or "" for t in texts]
        plain = ["<|" not in t and PLAIN.fullmatch(t) is not None for t in texts]
        split = [WORD.findall(t.lower()) if p else () for t, p in zip(texts, plain, strict=True)]
        missing = set().union(*split) - self.young.keys()
        known = missing & self.old.keys()
        self.young.update((w, self.old[w]) for w in known)
        self.learn(list(missing - known))
        others = iter(self.whole([t for t, p in zip(texts, plain, strict=True) if not p]))
        return [b"".join(map(self.young.__getitem__, words)) if p else next(others) for words, p in zip(split, plain, strict=True)]


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """Transpose one block: plane p holds byte (or bit) p of every id."""
    raw = ids.view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return [np.ascontiguousarray(raw[:, p]).tobytes() for p in range(4)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(bits[:, p], bitorder="little").tobytes() for p in range(32)]


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    if kind == "byte":
        return np.ascontiguousarray(np.stack([np.frombuffer(p, np.uint8) for p in planes], 1)).view("<u4").ravel()
    bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes], 1)
    return np.packbits(bits, axis=1, bitorder="little").view("<u4").ravel()


_loaded: dict[str, WordIds] = {}


def write_planes(docs: DataFrame, vocabulary: str, folder: str | None = None, kind: str = "byte", block_ids: int = 16_384,
                 chunk_ids: int = 1 << 18, end_id: int = END_ID, in_file_order: bool = False) -> tuple[DataFrame, DataFrame]:
    """Encode ``docs(doc_id, text)`` in ascending doc_id order into the format above; returns ``(chunks, index)`` as read back.

    Null texts and empty texts hold the end id alone. Null doc_ids come first; equal doc_ids are all kept, in the order of their texts.
    ``in_file_order`` keeps the order of rows in the Parquet files that ``docs`` was read from instead, such as a mix.
    An empty table gives empty tables. Other columns are not read. Range partitions keep the order without one task seeing all rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        words = _loaded.get(vocabulary) or _loaded.setdefault(vocabulary, WordIds(vocabulary))
        pack, end = zstandard.ZstdCompressor(level=1), np.array([end_id], "<u4").tobytes()
        part, chunk, offset = TaskContext.get().partitionId(), 0, 0
        doc_ids, held, size = [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal chunk, offset, doc_ids, held, size
            ids = np.frombuffer(b"".join(held), "<u4")
            planes = [pack.compress(p) for at in range(0, len(ids), block_ids) for p in to_planes(ids[at : at + block_ids], kind)]
            row = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([chunk], pa.int32()), pa.array([offset], pa.int64()), pa.array([doc_ids], pa.list_(pa.int64())),
                 pa.array([[len(b) // 4 for b in held]], pa.list_(pa.int64())), pa.array([block_ids], pa.int32()), pa.array([kind]), pa.array([planes], pa.list_(pa.binary()))],
                ["part", "chunk", "offset", "doc_ids", "counts", "block_ids", "kind", "planes"])
            chunk, offset = chunk + 1, offset + len(ids)
            doc_ids, held, size = [], [], 0
            return row

        for batch in portions(batches, "text"):
            for doc_id, got in zip(batch.column("doc_id").to_pylist(), words.encode(batch.column("text").to_pylist()), strict=True):
                doc_ids.append(doc_id)
                held.append(got + end)
                size += len(got) // 4 + 1
                if size >= chunk_ids:
                    yield flush()
        if held:
            yield flush()

    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    if in_file_order:  # files of a write are numbered part-N in the order of its partitions
        file_no = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).try_cast("long")
        ordered = docs.select(*columns, file_no.alias("f"), F.col("_metadata.file_name").alias("name"), F.col("_metadata.row_index").alias("at"))
        ordered = ordered.repartitionByRange("f", "name", "at").sortWithinPartitions("f", "name", "at").select("doc_id", "text")
    else:
        ordered = docs.select(*columns).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    chunks = settle(ordered.mapInArrow(encode, CHUNKS), folder and f"{folder}/chunks")
    sizes = chunks.select("part", "chunk", "offset", F.col("doc_ids")[0].alias("first_doc"), F.size("doc_ids").alias("n_docs"),
                          F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("n_ids"))
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("part_ids"))  # one row to a range partition
    before = parts.select("part", F.coalesce(F.sum("part_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    index = settle(sizes.join(before, "part").select("part", "chunk", "first_doc", "n_docs", "n_ids", (F.col("before") + F.col("offset")).alias("first_id")),
                   folder and f"{folder}/index")
    return chunks, index


def read_planes(chunks: DataFrame, index: DataFrame) -> DataFrame:
    """One row for each document, decoded from the files: doc_id, start, n_tokens, ids (little-endian unsigned 32-bit, binary)."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for row in batch.to_pylist():
                wide, counts = {"byte": 4, "bit": 32}[row["kind"]], np.array(row["counts"], np.int64)
                left, blocks = int(counts.sum()), []
                for at in range(0, len(row["planes"]), wide):
                    n = min(left, row["block_ids"])
                    blocks.append(from_planes([unpack.decompress(p) for p in row["planes"][at : at + wide]], n, row["kind"]))
                    left -= n
                data, ends = np.concatenate(blocks).tobytes(), np.cumsum(counts)
                starts = ends - counts
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(starts + row["first_id"]), pa.array(counts),
                     pa.array([data[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], pa.binary())],
                    ["doc_id", "start", "n_tokens", "ids"])

    bounded_batches(chunks.sparkSession, 16)
    placed = chunks.join(index.select("part", "chunk", "first_id"), ["part", "chunk"])
    return placed.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids binary")


@query("op7_token_planes")
def op7_token_planes(spark, folder) -> DataFrame:
    """Encode all documents, write byte planes, read the files back and sum each document's ids up."""
    import public_tokenizers

    chunks, index = write_planes(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return read_planes(chunks, index).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
