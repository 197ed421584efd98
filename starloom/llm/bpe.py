"""Byte-level BPE encoding and decoding by a table of distinct words.

Texts are split into words in Spark; a word is what the tokenizer's own pattern splits off, so its ids depend on
nothing around it. Each scan partition gathers its distinct words, which meet in the task of their hash; there each
distinct word is encoded once. The ids go back to the partitions that asked, as one compressed dictionary for each,
written in the shared folder. A second scan joins whole Arrow batches of words with their partition's dictionary,
position by position. Texts are never shuffled, and no task holds more than one partition's words. Decoding joins ids
with the id-to-piece table, whose size is the vocabulary's, and joins the pieces' bytes by position.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, partitions_of, released

_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^{S}\p{L}\p{N}]+|[{S}]+(?![^{S}])|[{S}]+"
JAVA_SPLIT = _SPLIT.replace("{S}", r"\p{IsWhite_Space}")
_BYTE_CHARS, _spare = {}, 0
for _b in range(256):
    _BYTE_CHARS[_b] = chr(_b) if 33 <= _b <= 126 or 161 <= _b <= 172 or 174 <= _b <= 255 else chr(256 + _spare)
    _spare += _BYTE_CHARS[_b] != chr(_b)


@lru_cache(maxsize=4)
def tokenizer(path: str):
    """The tokenizer of a file, without truncation and padding; once per process."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    return out


@lru_cache(maxsize=4)
def pieces(path: str) -> tuple[bytes, ...]:
    """Bytes by id; ids without a piece: empty. Added tokens stand for their own text."""
    char = {c: b for b, c in _BYTE_CHARS.items()}
    own = tokenizer(path)
    added = own.get_added_tokens_decoder()
    out = [b""] * (max(own.get_vocab(with_added_tokens=True).values(), default=-1) + 1)
    for token, i in own.get_vocab(with_added_tokens=True).items():
        whole = i not in added and all(c in char for c in token)
        out[i] = bytes(char[c] for c in token) if whole else token.encode()
    return tuple(out)


def piece_ids(own, piece: str) -> list[int]:
    """Ids of one word that the tokenizer's pattern has split off: its model alone, without normalising and splitting again."""
    return [t.id for t in own.model.tokenize(piece.encode("utf-8", "surrogatepass").decode("latin-1").translate(_BYTE_CHARS))]


def _pack(words: list[str]) -> bytes:
    """Words as compressed lengths and UTF-8 bytes."""
    raw = [w.encode() for w in words]
    body = np.array([len(raw), *map(len, raw)], np.uint32).tobytes() + b"".join(raw)
    return np.uint32(len(body)).tobytes() + pa.Codec("zstd").compress(body, asbytes=True)


def _unpack(blob: bytes) -> pa.StringArray:
    """Words of _pack."""
    body = pa.Codec("zstd").decompress(blob[4:], decompressed_size=int(np.frombuffer(blob[:4], np.uint32)[0]), asbytes=True)
    n = int(np.frombuffer(body[:4], np.uint32)[0])
    offsets = np.concatenate(([0], np.cumsum(np.frombuffer(body[4 : 4 + 4 * n], np.uint32)))).astype(np.int32)
    return pa.StringArray.from_buffers(n, pa.py_buffer(offsets.tobytes()), pa.py_buffer(body[4 + 4 * n :]))


def _pack_ids(ids: list[bytes]) -> bytes:
    """Ids of words, each word's as the bytes of 32-bit numbers, as compressed lengths and ids."""
    lengths = np.array([4 * len(ids), *map(len, ids)], np.uint32) // 4
    body = lengths.tobytes() + b"".join(ids)
    return np.uint32(len(body)).tobytes() + pa.Codec("zstd").compress(body, asbytes=True)


def _unpack_ids(blob: bytes) -> pa.ListArray:
    body = np.frombuffer(pa.Codec("zstd").decompress(blob[4:], decompressed_size=int(np.frombuffer(blob[:4], np.uint32)[0]), asbytes=True), np.uint32)
    n = int(body[0])
    offsets = np.concatenate(([0], np.cumsum(body[1 : n + 1]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(body[n + 1 :].astype(np.int32)))


#: Words that are joined with their ids at once; memory per task stays bounded for any length of texts.
SLICE_WORDS = 400_000
#: Bytes of the input (as stored) for a part of the distinct words; words that the task of a part remembers from one asking partition to the next.
PART_BYTES, REMEMBER = 64 << 20, 500_000


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """(id, ids: array<int>) for every row of docs, as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them.

    With ``decoded``, a column text holds what decode() makes of the ids; it is joined on in the same pass and worker.

    Null and empty texts have no ids; repeated rows stay repeated; null ids are kept. A text that holds an added token or a
    code point that the JVM's Unicode tables do not know is encoded whole in its own row's task, with the same result. So is
    a word that the dictionary at hand lacks, should a recomputed scan be cut into partitions differently.
    """
    special = [t.content for t in tokenizer(path).get_added_tokens_decoder().values()]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    direct = text.rlike(r"\p{Cn}")
    for token in special:
        direct = direct | text.contains(token)
    split = F.expr(f"regexp_extract_all(text, r\"{JAVA_SPLIT}\", 0)")
    based = docs.select(F.col(id_col).alias("id"), text.alias("text"), direct.alias("direct"))
    spark, uri = docs.sparkSession, fresh_path(docs.sparkSession, "dictionaries")
    parts = partitions_of(docs, PART_BYTES)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, block = set(), None
        for batch in batches:
            if batch.num_rows:
                block = batch.column(1)[0].as_py()
                words.update(pc.unique(batch.column(0).flatten()).to_pylist())
        dealt: dict[int, list[str]] = {}
        for w in words:
            dealt.setdefault(xxhash.xxh32_intdigest(w) % parts, []).append(w)
        for part, own in dealt.items():
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "block": pa.array([block], pa.int32()), "words": pa.array([_pack(sorted(own))], pa.binary())})

    asked = based.where(~F.col("direct")).select(split.alias("words"), F.spark_partition_id().alias("block")).mapInArrow(released(gather), "part int, block int, words binary")

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known = tokenizer(path), {}
        for batch in batches:
            found = []
            for blob in batch.column(2).to_pylist():
                words = _unpack(blob).to_pylist()
                if len(known) > REMEMBER:
                    known.clear()
                for w in words:
                    if w not in known:
                        known[w] = array("I", piece_ids(own, w)).tobytes()  # a third of what a tuple of numbers takes
                found.append(_pack_ids([known[w] for w in words]))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(found, pa.binary())], ["block", "words", "ids"])

    answered = asked.repartitionById(parts, F.col("part")).mapInArrow(released(once), "block int, words binary, ids binary")
    answered.withColumn("bucket", F.pmod("block", F.lit(parts))).repartitionById(parts, F.col("bucket")).write.partitionBy("bucket").parquet(uri)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, ids, at = None, None, None
        for batch in batches:
            if batch.num_rows and batch.column(3)[0].as_py() != at:
                at = batch.column(3)[0].as_py()
                words, ids = _dictionary(f"{uri}/bucket={at % parts}", at)
            for part in _slices(batch):
                out = _joined(part, words, ids, path)
                yield _decoded(out, 1, path) if decoded else out

    cut = based.select("id", F.when(~F.col("direct"), split).alias("words"), F.when(F.col("direct"), F.col("text")).alias("text"), F.spark_partition_id().alias("block"))
    return cut.mapInArrow(released(join), f"id {docs.schema[id_col].dataType.simpleString()}, ids array<int>{', text string' if decoded else ''}")


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows that hold about SLICE_WORDS words each, or one row."""
    ends = np.cumsum(batch.column(1).value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + SLICE_WORDS, side="right")))
        yield batch.slice(at, to - at)
        at = to


def _dictionary(uri: str, block: int) -> tuple[pa.Array, pa.ListArray]:
    """Words and ids of a block, from its bucket's folder."""
    fs, at = pa.fs.FileSystem.from_uri(uri if ":" in uri.split("/")[0] else f"file://{uri}")
    words, ids = [pa.array([], pa.string())], [pa.array([], pa.list_(pa.int32()))]
    for f in fs.get_file_info(pa.fs.FileSelector(at, allow_not_found=True)):
        if f.path.endswith(".parquet"):
            with fs.open_input_file(f.path) as source:
                rows = pq.read_table(source, columns=["block", "words", "ids"], filters=[("block", "=", block)], use_threads=False)
            words += [_unpack(b) for b in rows.column("words").to_pylist()]
            ids += [_unpack_ids(b) for b in rows.column("ids").to_pylist()]
    return pa.concat_arrays(words), pa.concat_arrays(ids)


def _joined(batch: pa.RecordBatch, words: pa.Array, ids: pa.ListArray, path: str) -> pa.RecordBatch:
    """A batch (id, words, text: only of rows to be encoded whole) to (id, ids), by joins of Arrow arrays."""
    lists = batch.column(1)
    flat = pc.dictionary_encode(lists.flatten())
    at = pc.index_in(flat.dictionary, value_set=words)
    found = ids.take(at)
    if at.null_count:  # words that the dictionary lacks
        found = _filled(found, at.is_null(), [piece_ids(tokenizer(path), w.as_py()) for w in flat.dictionary.filter(at.is_null())])
    taken = found.take(flat.indices)
    ends = np.concatenate(([0], np.cumsum(taken.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64)
    counts = np.concatenate(([0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))).astype(np.int64)
    offsets, values = ends[counts], taken.flatten()
    texts = batch.column(2)
    if texts.null_count < len(texts):
        whole = [tokenizer(path).encode(t.as_py(), add_special_tokens=False).ids if t.is_valid else None for t in texts]
        values = values.to_numpy()
        parts = [values[offsets[k] : offsets[k + 1]] if w is None else np.array(w, np.int32) for k, w in enumerate(whole)]
        offsets, values = np.concatenate(([0], np.cumsum([len(p) for p in parts]))), pa.array(np.concatenate(parts), pa.int32())
    return pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)], ["id", "ids"])


def _filled(lists: pa.ListArray, where: pa.BooleanArray, new: list[list[int]]) -> pa.ListArray:
    """lists with the rows marked by ``where`` replaced in turn."""
    rows, new_rows = lists.to_pylist(), iter(new)
    return pa.array([next(new_rows) if w else r for r, w in zip(rows, where.to_pylist(), strict=True)], lists.type)


def decode(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """encoded with a column text: its ids joined with the id-to-piece table, as ``Tokenizer.decode(ids, skip_special_tokens=False)``.

    Null ids decode to an empty text, ids outside the vocabulary to nothing, broken UTF-8 to U+FFFD. The table has one row per
    vocabulary entry, so each task holds it whole. Raises ValueError if encoded has a column text already.
    """
    if "text" in encoded.columns:
        raise ValueError("there is a column named text already")
    at = encoded.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _decoded(batch, at, path)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(run, f"{schema}, text string")


@lru_cache(maxsize=2)
def _piece_table(path: str) -> pa.BinaryArray:
    """The bytes of each id, and nothing for ids outside the vocabulary behind them."""
    return pa.array([*pieces(path), b""], pa.binary())


def _decoded(batch: pa.RecordBatch, at: int, path: str) -> pa.RecordBatch:
    """The batch with a column text behind: pieces joined on by id, and joined by position."""
    table, lists = _piece_table(path), batch.column(at)
    ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    joined = table.take(pa.array(np.where((ids < 0) | (ids >= len(table)), len(table) - 1, ids)))
    # the bytes of all pieces lie one behind the other: texts are slices of that buffer
    starts = np.frombuffer(joined.buffers()[1], np.int32)[: len(joined) + 1] if len(joined) else np.zeros(1, np.int32)
    data = memoryview(joined.buffers()[2]) if len(joined) and joined.buffers()[2] else memoryview(b"")
    ends = starts[np.concatenate(([0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))).astype(np.int64)]
    texts = [bytes(data[a:b]).decode("utf-8", "replace") for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
    return pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "text"])


def op5_bpe(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document.

    Null and empty texts have no ids and decode to an empty text; null ids and repeated rows are kept; an empty table gives an empty result; other
    columns are not looked at.
    """
    import public_tokenizers

    path = path or public_tokenizers.path("byte_bpe_50k.json")
    out = encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, decoded=True)
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return out.select(
        F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256")
    )
