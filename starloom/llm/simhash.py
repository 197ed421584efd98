"""SimHash near-duplicates by tiled exact comparison of fingerprints.

Fingerprints of whole texts come from one Arrow pass. Distinct fingerprints are dealt to groups by population counts
and cut into tiles of bounded size; a tile pair is compared, by numpy exclusive-or and bit counts, only if its population
counts differ by the radius or less, which every linked pair does (|pop(a) - pop(b)| <= popcount(a ^ b), part by part).
Each task emits a spanning star per linked set within its tile pair, never all pairs, and the stars are joined into
components.

There are two kinds. ``near_duplicates`` has 64 bits over shingles of three words and links at three bits or fewer, grouped by
the counts of the two halves. ``similar_documents`` and ``keep_one`` look for shingle sets of a Jaccard similarity: 256 bits over distinct
shingles of five words, whose share of differing bits tells the cosine of the sets, as it is the angle over pi. Groups
there are by whole population counts and by the number of shingles, as similar sets are of similar size.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, log, pi

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, fold_labels, released, stored, text_slices, unused

TILE = 8192
#: Tables of up to this many single longs are broadcast.
BROADCAST_ROWS = 500_000
#: Jaccard similarity and words of a shingle of near duplicates; 64-bit words of a wide fingerprint; population counts to a band.
SIMILARITY, WIDTH, WIDE, BAND = 0.8, 5, 4, 16
#: Bytes of texts whose words are hashed at once.
SLICE_BYTES = 1 << 21
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SHIFTS = np.arange(64, dtype=np.uint64)
_M1, _M2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def bit_sums(h: np.ndarray) -> np.ndarray:
    """How often each bit is set in the rows of h (n, w) of 64-bit words: 64 * w counts."""
    sums = np.zeros(64 * h.shape[1], np.int64)
    for at in range(0, len(h), 255 * 16):  # bits become bytes, of which eight are added at once, 255 rows at most before they could run over
        bits = np.unpackbits(h[at : at + 255 * 16].view(np.uint8), axis=1, bitorder="little")
        for k in range(0, len(bits), 255):
            sums += np.add.reduce(bits[k : k + 255].view(np.uint64), axis=0).view(np.uint8)
    return sums


def fingerprint(text: str | None, width: int = 3) -> int:
    """The 64-bit SimHash of one text: shingles of ``width`` words, XXH64 with seed 42, bits set in over half; no word: 0."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()  # bytes.split() cuts at the six ASCII spaces
    if not words:
        return 0
    if len(words) <= width:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), 42)]
    else:
        line, ends = b" ".join(words), np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[a:b], 42) for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)]
    sums = bit_sums(np.array(hashes, dtype=np.uint64)[:, None])
    return int(((2 * sums > len(hashes)).astype(np.uint64) << _SHIFTS).sum(dtype=np.uint64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def wide_fingerprints(texts: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints (n, WIDE) of texts and their numbers of distinct shingles; without a word: zeros.

    Words are cut at ASCII space after lower-casing A-Z; a text of fewer words than ``width`` has one shingle of all of them. A bit is
    set if it is in over half of the hashes of distinct shingles.
    """
    trimmed = pc.ascii_trim_whitespace(pc.ascii_lower(texts))
    lists = pc.ascii_split_whitespace(trimmed)
    flat = pc.dictionary_encode(lists.flatten())
    known = np.fromiter((xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), 42) for w in flat.dictionary.to_pylist()), np.uint64, len(flat.dictionary))
    words = known[flat.indices.to_numpy()] if len(flat) else np.zeros(0, np.uint64)
    counts = np.where(pc.equal(trimmed, "").to_numpy(zero_copy_only=False), 0, lists.value_lengths().to_numpy(zero_copy_only=False))
    starts = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64) - lists.value_lengths().to_numpy(zero_copy_only=False)
    rolled = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for k in range(width):
        rolled = _mixed(rolled * _STEP + words[k : k + len(rolled)] + np.uint64(1))
    out, sizes = np.zeros((len(texts), WIDE), np.uint64), np.zeros(len(texts), np.int64)
    steps = (np.arange(WIDE, dtype=np.uint64) * _STEP)[None, :]
    for k, (at, n) in enumerate(zip(starts.tolist(), counts.tolist(), strict=True)):
        if n >= width:
            h = np.sort(rolled[at : at + n - width + 1])
            h = h[np.concatenate(([True], h[1:] != h[:-1]))]
        elif n:
            h = np.zeros(1, np.uint64)
            for w in words[at : at + n]:
                h = _mixed(h * _STEP + w + np.uint64(1))
        else:
            continue
        sums = bit_sums(_mixed(h[:, None] + steps))
        sizes[k] = len(h)
        out[k] = np.packbits(2 * sums > len(h), bitorder="little").view(np.uint64)
    return out, sizes


def reach(similarity: float, bits: int = 64 * WIDE) -> int:
    """Differing bits up to which fingerprints of sets link: those expected at the Jaccard similarity, for sets of one size, and one standard deviation more."""
    share = acos(2 * similarity / (1 + similarity)) / pi
    return int(bits * share + (bits * share * (1 - share)) ** 0.5)


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, th, fp) of every row: th is a hash of the text, fp the fingerprint's bit pattern as a signed long. Null text: as an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), width) for t in batch.column(2)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(fps.view(np.int64))], ["id", "th", "fp"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("th"), text.alias("text")).mapInArrow(released(run), "id long, th long, fp long")


def _first_word(radius: int):
    """Whether the first of the 64-bit words of rows a and b differ in ``radius`` bits or fewer: indexes of such pairs."""
    return lambda a, b: np.nonzero(np.bitwise_count(a[:, 0, None] ^ b[None, :, 0]) <= radius)


def _similar(similarity: float):
    """Tests of rows (n, WIDE + 1), the last the number of shingles, that are as similar: one of all pairs, and one of those it leaves.

    Their bits differ in ``reach`` or fewer, in no more than double the first word's share of those in the first word, and
    neither set is smaller than ``similarity`` times the other.
    """
    radius = reach(similarity)

    def rest(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        low, high = np.minimum(x[:, -1], y[:, -1]), np.maximum(x[:, -1], y[:, -1])
        return (np.bitwise_count(x[:, :-1] ^ y[:, :-1]).sum(axis=1) <= radius) & (low >= high * similarity)

    return _first_word(2 * radius // WIDE), rest


def _stars(keys: np.ndarray, a: np.ndarray, b: np.ndarray | None, first, rest=None) -> np.ndarray:
    """Pairs (member, root) of keys that connect what is linked among the rows a and b (None: a itself), whose keys these are; one for each row at most.

    Pairs that are connected already are left out, so that a group of many rows costs no memory for its pairs.
    """
    off = 0 if b is None else len(a)
    b = a if b is None else b
    step = max(1, 500_000 // max(1, len(b)))
    parent = np.arange(len(keys))
    left: list[np.ndarray] = []
    right: list[np.ndarray] = []
    held = 0
    for at in range(0, len(a), step):
        i, j = first(a[at : at + step], b)
        i, j = i + at, j + off
        for k in range(0, len(i), 65_536):
            x, y = i[k : k + 65_536], j[k : k + 65_536]
            new = (x < y) & (parent[x] != parent[y])
            x, y = x[new], y[new]
            if rest is not None and len(x):
                near = rest(a[x], b[y - off])
                x, y = x[near], y[near]
            if len(x):
                left.append(x)
                right.append(y)
                held += len(x)
            if held > 100_000:  # fold what is found so far into the labels
                parent = fold_labels(parent, np.concatenate(left), np.concatenate(right))
                left, right, held = [], [], 0
    if held:
        parent = fold_labels(parent, np.concatenate(left), np.concatenate(right))
    moved = np.nonzero(parent != np.arange(len(parent)))[0]
    return np.stack([keys[moved], keys[parent[moved]]], axis=1)


def _tiled_links(rows: DataFrame, steps: list[tuple[int, int]], tests: tuple, tile: int) -> DataFrame:
    """Links (a, b) between keys of rows (key: long, x, y: the group, w0 and so on: longs) that span every component of the pairs that pass the tests (see _stars).

    Groups meet whose (x, y) differ by one of ``steps``; they are few, whatever the number of rows, and so is what is broadcast of them.
    """
    words = [c for c in rows.columns if c not in ("key", "x", "y")]
    own = rows.groupBy("x", "y").count().select("x", "y", F.ceil(F.col("count") / F.lit(tile)).cast("int").alias("k"))
    tiles = own.select(F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("k").alias("k2"))
    shifted = own.select("x", "y", "k", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in steps])).alias("d"))
    shifted = shifted.select("x", "y", "k", (F.col("x") + F.col("d.i")).alias("x2"), (F.col("y") + F.col("d.j")).alias("y2"))
    code = lambda x, y: F.col(x) * 64 + F.col(y)
    partners = shifted.join(F.broadcast(tiles), ["x2", "y2"]).groupBy("x", "y", "k").agg(F.collect_list(F.struct(code("x2", "y2").alias("g"), "k2")).alias("partners"))
    dealt = rows.join(F.broadcast(partners), ["x", "y"]).withColumns({"g0": code("x", "y"), "t0": F.pmod(F.xxhash64("key"), F.col("k").cast("long")).cast("int")})
    pairs = dealt.select("key", *words, "g0", "t0", F.explode("partners").alias("p")).select(
        "key", *words, "g0", "t0", F.col("p.g").alias("g1"), F.explode(F.sequence(F.lit(0), F.col("p.k2") - 1)).alias("t1")
    )
    me, other = F.struct(F.col("g0").alias("g"), F.col("t0").alias("t")), F.struct(F.col("g1").alias("g"), F.col("t1").alias("t"))
    keyed = pairs.select(F.least(me, other).alias("x"), F.greatest(me, other).alias("y"), (me > other).alias("second"), "key", *words)

    def run(group, table):
        keys, second = table.column("key").to_numpy(), table.column("second").to_numpy(zero_copy_only=False)
        own = np.stack([table.column(c).to_numpy().view(np.uint64) for c in words], axis=1)
        if group[0].as_py() == group[1].as_py():
            links = _stars(keys, own, None, *tests)
        else:
            links = _stars(np.concatenate([keys[~second], keys[second]]), own[~second], own[second], *tests)
        return pa.table({"a": links[:, 0], "b": links[:, 1]})

    return keyed.groupBy("x", "y").applyInArrow(run, "a long, b long")


def fingerprint_links(fps: DataFrame, radius: int = 3, tile: int = TILE) -> DataFrame:
    """Links (a, b: fingerprints as longs) that span every component of the distinct fingerprints in fps (fp: long), linked at ``radius`` differing bits or fewer."""
    high, low = F.bit_count(F.shiftrightunsigned("fp", 32)), F.bit_count(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)))
    steps = [(i, j) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) if abs(i) + abs(j) <= radius]
    return _tiled_links(fps.select(F.col("fp").alias("key"), high.alias("x"), low.alias("y"), F.col("fp").alias("w0")), steps, (_first_word(radius),), tile)


def similarity_links(wide: DataFrame, similarity: float = SIMILARITY, tile: int = TILE) -> DataFrame:
    """Links (a, b) that span every component of wide (fp: a hash of the rest, n: shingles, words: array of WIDE longs), distinct rows linked if as similar."""
    counts = sum((F.bit_count(F.get("words", F.lit(k))) for k in range(1, WIDE)), F.bit_count(F.get("words", F.lit(0))))
    bucket = F.when(F.col("n") > 0, 1 + F.floor(F.log(F.greatest(F.col("n"), F.lit(1))) / F.lit(-log(similarity)) + F.lit(1e-9))).otherwise(-1)
    bands = ceil(reach(similarity) / BAND)
    steps = [(i, j) for i in (-1, 0, 1) for j in range(-bands, bands + 1)]
    rows = wide.select(F.col("fp").alias("key"), bucket.cast("int").alias("x"), F.floor(counts / BAND).cast("int").alias("y"), *[F.get("words", F.lit(k)).alias(f"w{k}") for k in range(WIDE)], F.col("n").alias(f"w{WIDE}"))
    return _tiled_links(rows, steps, _similar(similarity), tile)


def _distinct(fps: DataFrame, *more: str) -> DataFrame:
    """Of stored (id, th, fp, more), the stored table of one row per fp: (fp, more, id: the least, head: the first row by id, null last, and th, n: rows)."""
    head = F.struct(F.col("id").isNull().alias("none"), "id", "th")
    return stored(fps.groupBy("fp", *more).agg(F.min("id").alias("id"), F.min(head).alias("head"), F.count(F.lit(1)).alias("rows")), "distinct")


def _roots(links: DataFrame) -> DataFrame:
    return stored(components(stored(links, "links")).withColumnRenamed("node", "fp"), "roots")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3, width: int = 3) -> DataFrame:
    """One row per row of docs: (id, fp, component_id), the smallest id whose fingerprint is reachable by links.

    Null ids carry through and never name a component unless all ids of it are null; null and empty texts have
    fingerprint 0 and link like any other; repeated rows stay repeated; an empty table gives an empty result;
    other columns of docs are not looked at.
    """
    fps = stored(with_fingerprints(docs, id_col, text_col, width), "fingerprints")
    distinct = _distinct(fps)
    roots = _roots(fingerprint_links(distinct, radius))
    # most fingerprints have no link: only linked ones are joined with their roots
    named = roots.join(distinct.select("fp", "id"), "fp")
    least = named.groupBy("root").agg(F.min("id").alias("component"))
    by_fp = stored(named.join(least, "root").select("fp", "component"), "components")
    least_of = distinct.join(by_fp, "fp", "left").select("fp", F.coalesce("component", "id").alias("component_id"))
    return fps.join(least_of, "fp", "left").select("id", "fp", "component_id")


def with_wide_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(id, th, fp, n, words) of every row: th is a hash of the text, words the wide fingerprint, n the number of distinct shingles, fp a hash of both. Null text: as an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (part for whole in batches for part in text_slices(whole, 2, SLICE_BYTES)):
            words, sizes = wide_fingerprints(part.column(2), width)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(words) + 1) * WIDE, pa.int32()), pa.array(words.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sizes), lists], ["id", "th", "n", "words"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("th"), text.alias("text")).mapInArrow(released(run), "id long, th long, n long, words array<long>")
    return rows.select("id", "th", F.xxhash64("n", "words").alias("fp"), "n", "words")


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, width: int = WIDTH) -> DataFrame:
    """One row per row of docs: (id, component_id), the smallest id reachable over texts of this Jaccard similarity or more of their shingles.

    The similarity is told by wide fingerprints, so pairs within some hundredths of it can fall on either side; equal texts always link. Null ids
    carry through and never name a component unless all ids of it are null; texts without a word link with each other; repeated rows stay repeated.
    """
    fps = stored(with_wide_fingerprints(docs, id_col, text_col, width), "fingerprints")
    distinct = _distinct(fps, "n", "words")
    roots = _roots(similarity_links(distinct, similarity))
    named = roots.join(distinct.select("fp", "id"), "fp")
    by_fp = named.join(named.groupBy("root").agg(F.min("id").alias("component")), "root").select("fp", "component")
    least_of = distinct.join(by_fp, "fp", "left").select("fp", F.coalesce("component", "id").alias("component_id"))
    return fps.select("id", "fp").join(least_of, "fp", "left").select("id", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, width: int = WIDTH) -> DataFrame:
    """The rows of docs without near duplicates (see similar_documents): of each component the first row by id (null last) and hash of the text stays.

    Of rows equal in id and text one stays; rows of one id but different texts are different documents. Null and empty texts are
    near duplicates of each other. Columns are docs' own.
    """
    fps = stored(with_wide_fingerprints(docs, id_col, text_col, width), "fingerprints")
    distinct = _distinct(fps, "n", "words")
    roots = _roots(similarity_links(distinct, similarity))
    fps = fps.select("id", "th", "fp")
    linked = roots.join(distinct, "fp")
    heads = stored(linked.join(linked.groupBy("root").agg(F.min("head").alias("first")), "root").select("fp", F.col("first").alias("head")), "heads")
    several = distinct.where("rows > 1").join(heads, "fp", "left_anti").select("fp", "head").unionAll(heads)
    key, hashed = unused(docs, "_id", "_th")
    same = F.col("id").eqNullSafe(F.col("head.id")) & (F.col("th") == F.col("head.th"))
    of_groups = stored(fps.join(several, "fp").groupBy("id", "th").agg(F.count(F.lit(1)).alias("n"), F.max(same).alias("same")), "of_groups")
    sides = {"lost": of_groups.where("not same"), "repeated": of_groups.where("same and n > 1")}
    on = F.col(id_col).cast("long").eqNullSafe(F.col(key)) & (F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))) == F.col(hashed))
    sizes = {name: side.count() for name, side in sides.items()}
    for name, side in sides.items():
        side = side.select(F.col("id").alias(key), F.col("th").alias(hashed))
        sides[name] = F.broadcast(side) if sizes[name] <= BROADCAST_ROWS else side
    kept = docs.join(sides["lost"], on, "left_anti")
    if not sizes["repeated"]:
        return kept
    # the same row several times over: seldom any, and only their rows are dealt
    again = kept.join(sides["repeated"], on).dropDuplicates([key, hashed]).select(*[F.col(f"`{c}`") for c in docs.columns])
    return kept.join(sides["repeated"], on, "left_anti").unionAll(again)


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    """(doc_id, fingerprint: 16 hexadecimal digits, component_id) of every document.

    Null, empty and blank texts have fingerprint zero and link like any other; null ids carry through and name a component only if all its ids are
    null; repeated rows stay repeated; an empty table gives an empty result; other columns are not looked at.
    """
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
