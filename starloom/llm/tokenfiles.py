"""Token ids in Arrow stream files of equal-length sequences.

Each shard is an Arrow IPC stream in a file: record batches of fixed-size lists ``input_ids`` (uint16 or uint32) and
``attention_mask`` (bool), all of one length; only a shard's last sequence is padded, with mask false. Since every full
batch has the same layout, a reader maps the file, seeks to a batch by the offsets in the index beside it, and gets views
without a copy. The index, another stream, holds one row per document: id, start in the shard, number of tokens; a small JSON
file holds the offsets of batches.

Rows are dealt to shards by ranges of the id, so shards follow the ids' order; a shard is written by one task, under its own
attempt's name and then renamed, so a repeated task leaves the same files. The words of many texts are encoded at once: each
distinct word of a block of texts once, and all others by Arrow's dictionary and take kernels.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .bpe import piece_ids, tokenizer
from .common import fresh_path, n_partitions, partitions_of, stored, text_slices

LENGTH, ROWS = 2048, 64
#: Bytes of the input (as stored) for a shard; documents for a batch of the index; bytes of texts whose words are encoded at once.
SHARD_BYTES, INDEX_ROWS, SLICE_BYTES = 128 << 20, 8192, 12 << 20
#: Texts of these code points only are split here word by word; any other text goes to the tokenizer whole. Below U+0250 no
#: code point composes under NFC, lower-casing depends on no neighbour, and but for U+001C to U+001F Arrow cuts at the white
#: space at which the tokenizer does.
_PLAIN = regex.compile(r"[\x00-\x1b\x20-įı-ɏ‐-‧€]*")
_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")


class WordEncoder:
    """Encodes texts as the tokenizer of a lower-casing word-end BPE file does, each distinct word of a block of texts once.

    Words and their pieces are remembered, about twice ``remember`` of them: those not met again while that many others come
    are forgotten.
    """

    def __init__(self, path: str, remember: int = 120_000):
        self.own, self.remember, self.known, self.older = tokenizer(path), remember, {}, {}
        self.special = [t.content for t in self.own.get_added_tokens_decoder().values()]

    def word(self, word: str) -> tuple[int, ...]:
        """Ids of a word that is not among the known ones; white space parts pieces, so what stands between is cut alone."""
        ids = self.older.get(word)
        if ids is None:
            pieces = [word] if word.isalpha() else _WORDS.findall(word)
            if len(pieces) == 1 and pieces[0] == word:
                ids = tuple([t.id for t in self.own.model.tokenize(word)] if word.isascii() and word.isalnum() else piece_ids(self.own, word))
            else:
                known = [self.known.get(p) or self.word(p) for p in pieces]
                ids = tuple(chain.from_iterable(known))
        self.known[word] = ids
        return ids

    def __call__(self, texts: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, one behind the other and each with end_id behind it; number of ids of each)."""
        direct = {k for k, text in enumerate(texts) if any(s in text for s in self.special) or not _PLAIN.fullmatch(text)}
        lists = pc.utf8_split_whitespace(pa.array(["" if k in direct else text.lower() for k, text in enumerate(texts)], pa.string()))
        flat = pc.dictionary_encode(lists.flatten())
        words = flat.dictionary.to_pylist()
        entries = list(map(self.known.get, words))
        for k in [k for k, ids in enumerate(entries) if ids is None]:
            entries[k] = self.word(words[k])
        if len(self.known) > self.remember:
            self.known, self.older = {}, self.known
        ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
        at = flat.indices.to_numpy().astype(np.int32)
        for k in direct:  # its words are one empty one, which stands for the whole text's ids
            at[ends[k] - 1] = len(entries)
            entries.append(self.own.encode(texts[k], add_special_tokens=False).ids)
        at = np.insert(at, ends, len(entries))
        entries.append((end_id,))
        sizes = np.fromiter(map(len, entries), np.int64, len(entries))
        table = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(np.fromiter(chain.from_iterable(entries), np.uint32)))
        ids = table.take(pa.array(at)).flatten().to_numpy()
        bounds = np.concatenate(([0], np.cumsum(sizes[at])))[np.concatenate(([0], ends + np.arange(1, len(texts) + 1)))]
        return ids, np.diff(bounds)


@lru_cache(maxsize=2)
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def _fs(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(uri if ":" in uri.split("/")[0] else f"file://{uri}")


class ShardWriter:
    """Writes one shard: ``add(keys, ids, counts)`` of documents in order, then ``close()``, which gives the number of tokens."""

    def __init__(self, uri: str, id_type: pa.DataType, dtype, length: int = LENGTH, rows: int = ROWS, pad: int = 0):
        self.fs, self.path = _fs(uri)
        self.length, self.rows, self.pad, self.dtype, self.id_type = length, rows, pad, np.dtype(dtype), id_type
        self.schema = pa.schema([("input_ids", pa.list_(pa.from_numpy_dtype(self.dtype), length)), ("attention_mask", pa.list_(pa.bool_(), length))])
        self.mark = f".{uuid.uuid4().hex}"
        self.fs.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.file = self.fs.open_output_stream(f"{self.path}.arrows{self.mark}")
        self.stream = pa.ipc.new_stream(self.file, self.schema)
        self.index_schema = pa.schema([("id", id_type), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.index_file = self.fs.open_output_stream(f"{self.path}.docs{self.mark}")
        self.index = pa.ipc.new_stream(self.index_file, self.index_schema)
        self.offsets: list[int] = []
        self.total, self.held, self.buffer = 0, 0, []

    def add(self, keys: pa.Array, ids: np.ndarray, counts: np.ndarray) -> None:
        starts = self.total + np.cumsum(counts) - counts
        table = pa.table([keys.cast(self.id_type), pa.array(starts, pa.int64()), pa.array(counts, pa.int64())], schema=self.index_schema)
        self.index.write_table(table, max_chunksize=INDEX_ROWS)
        self.total += len(ids)
        self.buffer.append(ids.astype(self.dtype))
        self.held += len(ids)
        whole = self.length * self.rows
        if self.held >= whole:
            flat = np.concatenate(self.buffer)
            for at in range(0, len(flat) - whole + 1, whole):
                self._batch(flat[at : at + whole], whole)
            self.buffer = [flat[len(flat) - len(flat) % whole :].copy()]
            self.held = len(self.buffer[0])

    def _batch(self, flat: np.ndarray, valid: int) -> None:
        self.offsets.append(self.file.tell() or self.schema.serialize().size)  # the schema goes out with the first batch
        mask = np.arange(len(flat)) < valid
        fixed = [pa.FixedSizeListArray.from_arrays(pa.array(v), self.length) for v in (flat, mask)]
        self.stream.write_batch(pa.RecordBatch.from_arrays(fixed, schema=self.schema))

    def close(self) -> int:
        flat = np.concatenate(self.buffer) if self.buffer else np.zeros(0, self.dtype)
        if len(flat):
            padded = np.full(-(-len(flat) // self.length) * self.length, self.pad, self.dtype)
            padded[: len(flat)] = flat
            self._batch(padded, len(flat))
        self.stream.close()
        self.file.close()
        self.index.close()
        self.index_file.close()
        with self.fs.open_output_stream(f"{self.path}.json{self.mark}") as f:
            f.write(json.dumps({"offsets": self.offsets, "length": self.length, "rows": self.rows, "total": self.total}).encode())
        for kind in ("arrows", "docs", "json"):
            self.fs.move(f"{self.path}.{kind}{self.mark}", f"{self.path}.{kind}")
        return self.total


class TokenFile:
    """Random access to a shard: ``sequence(i)`` and ``tokens(start, n)`` are views of the mapped file or slices of it."""

    def __init__(self, uri: str):
        self.uri = uri
        fs, path = _fs(uri)
        local = isinstance(fs, pa.fs.LocalFileSystem)
        with fs.open_input_stream(f"{path}.json") as f:
            about = json.loads(f.read())
        self.offsets, self.length, self.rows, self.total = (about[k] for k in ("offsets", "length", "rows", "total"))
        self.file = pa.memory_map(f"{path}.arrows") if local else fs.open_input_file(f"{path}.arrows")
        self.schema = pa.ipc.read_schema(self.file)

    def docs(self) -> Iterator[pa.RecordBatch]:
        """The index, batch by batch: id, start, n_tokens."""
        fs, path = _fs(self.uri)
        with fs.open_input_stream(f"{path}.docs") as f, pa.ipc.open_stream(f) as docs:
            yield from docs

    def batch(self, k: int) -> pa.RecordBatch:
        self.file.seek(self.offsets[k])
        return pa.ipc.read_record_batch(pa.ipc.read_message(self.file), self.schema)

    def sequence(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """Ids and mask of the i-th sequence."""
        batch, at = self.batch(i // self.rows), i % self.rows * self.length
        ids = batch.column(0).values.to_numpy()[at : at + self.length]
        return ids, batch.column(1).values.slice(at, self.length)

    def tokens(self, start: int, n: int) -> Iterator[np.ndarray]:
        """Ids [start, start + n) of the shard, batch by batch."""
        whole = self.length * self.rows
        while n > 0:
            k, at = divmod(start, whole)
            part = self.batch(k).column(0).values.to_numpy()[at : at + n]
            yield part
            start, n = start + len(part), n - len(part)


def write_tokens(docs: DataFrame, uri: str, path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """Write all texts' ids under uri; the manifest: (shard, uri, n_docs, n_tokens, base), base the ids in all shards before.

    Each text is encoded whole, null as empty, and ends with end_id. Documents follow in ascending id, null ids first; rows of
    one id by the text's hash, equal rows in any order. Rows of a hot id are spread over shards. An empty table has no shard.
    Ids are stored as uint16 if the vocabulary and end_id allow, else as uint32.
    """
    spark = docs.sparkSession
    dtype = np.uint16 if max([end_id, *tokenizer(path).get_vocab().values()]) < 1 << 16 else np.uint32
    id_type = docs.schema[id_col].dataType
    arrow_type = pa.string() if id_type.simpleString() == "string" else pa.int64()
    rows = docs.select(F.col(id_col).cast("string" if arrow_type == pa.string() else "long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    keyed = rows.withColumns({"h": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    dealt = keyed.repartitionByRange(partitions_of(docs, SHARD_BYTES), "id", "h", "row").sortWithinPartitions("id", "h", "row").select("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        own, writer, n = _encoder(path), None, 0
        for batch in batches:
            if batch.num_rows and writer is None:
                writer = ShardWriter(f"{uri}/part-{shard:06d}", arrow_type, dtype, length)
            for part in text_slices(batch, 1, SLICE_BYTES):
                writer.add(part.column(0), *own(part.column(1).to_pylist(), end_id))
                n += part.num_rows
        if writer:
            yield pa.RecordBatch.from_pydict({"shard": [shard], "uri": [f"{uri}/part-{shard:06d}"], "n_docs": [n], "n_tokens": [writer.close()]})

    manifest = stored(dealt.mapInArrow(run, "shard long, uri string, n_docs long, n_tokens long"), "manifest")
    before = F.sum("n_tokens").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1))  # one small row per shard
    return manifest.withColumn("base", F.coalesce(before, F.lit(0)))


def read_tokens(spark: SparkSession, manifest: DataFrame, id_type: str = "long") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document in the manifest's files, read back from them shard by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                file = TokenFile(uri)
                for docs in file.docs():
                    sums = []
                    for start, n in zip(docs.column(1).to_pylist(), docs.column(2).to_pylist(), strict=True):
                        crc = 0
                        for part in file.tokens(start, n):
                            crc = zlib.crc32(part.astype("<u4").tobytes(), crc)
                        sums.append(crc)
                    start = pa.array(docs.column(1).to_numpy() + base, pa.int64())
                    yield pa.RecordBatch.from_arrays([docs.column(0), start, docs.column(2), pa.array(sums, pa.int64())], ["id", "start", "n_tokens", "ids_crc32"])

    shards = manifest.select("uri", "base", "shard").repartitionById(n_partitions(spark), F.col("shard").cast("int")).select("uri", "base")
    return shards.mapInArrow(run, f"id {id_type}, start long, n_tokens long, ids_crc32 long")


def op3_tokens(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files.

    Null and empty texts have the end id alone; null ids come first and repeated rows each have their own place; rows of one id follow
    by the text's hash; an empty table has no shard and no row; other columns are not looked at.
    """
    import public_tokenizers

    path = path or public_tokenizers.path("word_bpe_49k.json")
    manifest = write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), fresh_path(spark, "tokens"), path)
    return read_tokens(spark, manifest).withColumnRenamed("id", "doc_id")
