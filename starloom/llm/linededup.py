"""Line dedup by a segment-partition edit join.

A line of length l may differ from another by some edits, more for longer lines; the shorter line's length says how many.
It is cut into that number + 1 of even segments. Two lines within the threshold share a segment whose place
differs only by what the edits around it allow, so each line is looked up, for every length it may match, at the few
positions left by the multi-match-aware bounds. Lookups are 64-bit keys (length, segment, substring's hash), taken from
prefix sums over the characters of many lines at once.

Texts are split once: the lines (with their text where it is new to the texts beside it) are a written table, and everything else reads columns
of it. An aggregate finds the keys that lines share, and a semi-join leaves their lines, never pairs. The lines of a key are cut into
tiles of bounded size, and each pair of tiles is compared in one task by a banded bit-parallel edit distance, many pairs
at a time. A pair that shares several keys is compared at the first only, so links are counted exactly; a task gives one
row per linked line: its number of links and the root of a spanning star, so output is linear in a key's lines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, components, fold_labels, released, stored, text_slices, unused

#: Edits that still make two lines the same: at most so many, and one for every so many characters of the shorter line. Lines too
#: short for one edit are the same only if equal.
EDITS, PER_EDIT = 2, 16
#: Lines of a key in a tile, for each of its two sides.
TILE = 1024
#: Tables of up to this many rows of two or three longs are broadcast; and those of lists of up to so many line numbers in all.
BROADCAST_ROWS, BROADCAST_NUMBERS = 200_000, 20_000
#: Bytes of texts that are split at once; characters whose lines are keyed at once.
SLICE_BYTES, BLOCK_CHARS = 1 << 22, 1 << 18
_BASE = 0x9E3779B97F4A7C15
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _lookups(edits: int) -> list[tuple[int, int, int, int]]:
    """(edits of the other line, how much shorter it is, segment, shift) of all lookups; those with no difference and shift are the line's own keys."""
    out = []
    for e in range(1, edits + 1):
        for less in range(e + 1):
            for i in range(e + 1):
                low, high = max(-i, less - (e - i)), min(i, less + (e - i))
                out += [(e, less, i, shift) for shift in range(low, high + 1)]
    return out


def allowed(length, edits: int = EDITS, per: int = PER_EDIT):
    """Edits that a line of this length may differ by from one that is as long or longer."""
    return np.minimum(edits, length // per)


def _segment(length, i: int, edits: int):
    """Start and size of segment i of edits + 1 even ones; the longer ones come last."""
    small, short = length // (edits + 1), edits + 1 - length % (edits + 1)
    return i * small + np.maximum(0, i - short), small + (i >= short)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class _Keys:
    """Keys of the lines of a block: substrings' hashes are differences of prefix sums of characters times powers of an odd base."""

    def __init__(self, edits: int, per: int):
        self.edits, self.per, self.lookups, self.powers = edits, per, _lookups(edits), None

    def __call__(self, lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(line's index, key, whether the line is indexed there) of all lookups; a key's last two bits are the segment's number modulo 4."""
        sizes = np.fromiter(map(len, lines), np.int64, len(lines))
        codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
        if self.powers is None or len(self.powers[0]) < len(codes) + 1:
            n = max(BLOCK_CHARS, len(codes)) + 1
            self.powers = []
            for base in (_BASE, pow(_BASE, -1, 1 << 64)):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                self.powers.append(np.cumprod(steps))
        up, down = self.powers
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(_mixed(codes.astype(np.uint64) + np.uint64(1)) * up[: len(codes)], out=sums[1:])
        starts = np.cumsum(sizes) - sizes
        rows, keys, owns = [], [], []
        for e, less, i, shift in self.lookups:
            length = sizes - less
            row = np.flatnonzero((length >= self.per) & (allowed(length, self.edits, self.per) == e))
            length = length[row]
            start, size = _segment(length, i, e)
            at = starts[row] + start + shift
            part = (sums[at + size] - sums[at]) * down[at]
            key = _mixed(part ^ _mixed((length * 8 + i).astype(np.uint64) + np.uint64(_BASE)))
            rows.append(row)
            keys.append(key & np.uint64((1 << 64) - 4) | np.uint64(i % 4))
            owns.append(np.full(len(row), less == 0 and shift == 0))
        return np.concatenate(rows), np.concatenate(keys).view(np.int64), np.concatenate(owns)


def line_keys(lines: DataFrame, edits: int = EDITS, per: int = PER_EDIT) -> DataFrame:
    """(key, h, own) of all lookups of lines (h, line)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = _Keys(edits, per)
        for batch in batches:
            h, lines = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            at = chars = 0
            for k, line in enumerate(lines):
                chars += len(line)
                if chars >= BLOCK_CHARS or k + 1 == len(lines):
                    row, key, own = keys(lines[at : k + 1])
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(h[at + row]), pa.array(own)], ["key", "h", "own"])
                    at, chars = k + 1, 0

    return lines.select("h", "line").mapInArrow(run, "key long, h long, own boolean")


def within(a: list[str], b: list[str], edits: int, per: int = 0) -> np.ndarray:
    """Whether each pair of strings is within ``edits`` edits, by Hyyrö's banded bit-parallel algorithm over all pairs at once.

    With ``per``, of those only one for every so many characters of the shorter string; strings are longer than ``edits`` then.
    """
    n, width = len(a), 2 * edits + 1
    out = np.zeros(n, bool)
    codes = [(np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32), np.frombuffer(y.encode("utf-32-le", "surrogatepass"), np.uint32)) for x, y in zip(a, b, strict=True)]
    codes = [(x, y) if len(x) >= len(y) else (y, x) for x, y in codes]
    order = sorted(range(n), key=lambda k: len(codes[k][1]))
    at = 0
    while at < n:
        k = at
        while k < n and k - at < 4096 and (k - at + 1) * (len(codes[order[k]][1]) + 64) < 4_000_000 or k == at:
            k += 1
        part = [j for j in order[at:k] if len(codes[j][0]) - len(codes[j][1]) <= edits]
        at = k
        if part:
            most = [min(edits, len(codes[j][1]) // per) if per else edits for j in part]
            out[part] = _banded([codes[j] for j in part], edits, width) <= np.array(most)
    return out


def _banded(pairs: list[tuple[np.ndarray, np.ndarray]], edits: int, width: int) -> np.ndarray:
    n1, n2 = (np.array([len(p[k]) for p in pairs]) for k in (0, 1))
    m = int(n1.max(initial=0)) + 2 * width
    s1 = np.full((len(pairs), m), 0xFFFFFFFF, np.uint32)
    s2 = np.full((len(pairs), max(1, int(n2.max(initial=0)))), 0xFFFFFFFE, np.uint32)
    for k, (x, y) in enumerate(pairs):
        s1[k, edits : edits + len(x)] = x
        s2[k, : len(y)] = y
    full, top = np.uint64((1 << width) - 1), np.uint64(1 << (width - 1))
    powers = (np.uint64(1) << np.arange(width, dtype=np.uint64))[None, :]
    vp = np.full(len(pairs), ((1 << (edits + 1)) - 1) << edits, np.uint64)
    vn = np.zeros(len(pairs), np.uint64)
    dist, side = np.full(len(pairs), edits), np.full(len(pairs), top >> np.uint64(1))
    one = np.uint64(1)
    for i in range(int(n2.max(initial=0))):
        pm = ((s1[:, i : i + width] == s2[:, i : i + 1]) * powers).sum(axis=1, dtype=np.uint64)
        d0 = ((((pm & vp) + vp) ^ vp) | pm | vn) & full
        hp, hn = (vn | ~(d0 | vp)) & full, d0 & vp
        live, inner = i < n2, i < n1 - edits
        down = (d0 & top) == 0
        dist += np.where(live & inner, down, 0)
        last = live & ~inner
        dist += np.where(last, ((hp & side) > 0).astype(int) - ((hn & side) > 0).astype(int), 0)
        side = np.where(last, side >> one, side)
        vp, vn = (hn | ~((d0 >> one) | hp)) & full, (d0 >> one) & hp
    return dist  # exact up to edits, in strings that are longer than those


def lines_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = PER_EDIT) -> DataFrame:
    """(id, th: hash of the text, line_no, h: hash of the line, line) of all lines with a word, trimmed.

    ``line`` is given where h is new to its run of texts, and only if it has ``least`` or more characters.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for batch in (part for whole in batches for part in text_slices(whole, 2, SLICE_BYTES)):
            row, number, hashes, texts, seen = [], [], [], [], set()
            for k, text in enumerate(batch.column(2).to_pylist()):
                for n, raw in enumerate(text.split("\n")):
                    line = raw.strip(SPACE)
                    if line:
                        h = digest(line.encode("utf-8", "surrogatepass"))
                        row.append(k)
                        number.append(n)
                        hashes.append(h)
                        if h in seen or len(line) < least:
                            texts.append(None)
                        else:
                            seen.add(h)
                            texts.append(line)
            row = pa.array(row, pa.int32())
            h = pa.array(np.array(hashes, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), pa.array(number, pa.int32()), h, pa.array(texts, pa.string())], ["id", "th", "line_no", "h", "line"])

    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("th"), text.alias("text")).where("text is not null")
    return rows.mapInArrow(released(run), "id long, th long, line_no int, h long, line string")


def _pairs(probers: list[str], owners: list[str], segment: int, edits: int, per: int) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the pairs to compare at a key of this segment (modulo 4): of the lookups that find the owner, this is the first."""
    lookups, known = _lookups(edits), {}
    of_length: dict[int, list[tuple[int, int]]] = {}

    def place(length: int) -> list[tuple[int, int]]:
        if length not in of_length:
            e = min(edits, length // per)
            of_length[length] = [tuple(map(int, _segment(length, i, e))) for i in range(e + 1)]
        return of_length[length]

    def code(i: int, length: int, part: str) -> int:
        return known.setdefault((i, length, part), len(known))

    own = np.full((len(owners), edits + 1), -2, np.int64)
    for k, x in enumerate(owners):
        found = [code(i, len(x), x[at : at + size]) for i, (at, size) in enumerate(place(len(x)))]
        own[k, : len(found)] = found
    asked = np.full((len(probers), len(lookups)), -1, np.int64)
    for k, x in enumerate(probers):
        for j, (e, less, i, shift) in enumerate(lookups):
            length = len(x) - less
            if length >= per and min(edits, length // per) == e:
                at, size = place(length)[i]
                asked[k, j] = code(i, length, x[at + shift : at + shift + size])
    open_, here = np.ones((len(probers), len(owners)), bool), np.zeros((len(probers), len(owners)), bool)
    for j, (_, _, i, _) in enumerate(lookups):
        same = open_ & (asked[:, j, None] == own[None, :, i])
        if i % 4 == segment:
            here |= same
        open_ &= ~same
    return np.nonzero(here)


class _Comparer:
    """Gathers the pairs of one tile after another and compares many at once; ``add`` and ``close`` give (line, root, number of links) arrays."""

    def __init__(self, edits: int, per: int, pairs: int = 16_384, chars: int = 8_000_000):
        self.edits, self.per, self.most_pairs, self.most_chars = edits, per, pairs, chars
        self._clear()

    def _clear(self):
        self.hashes: list[np.ndarray] = []
        self.lines: list[str] = []
        self.left: list[np.ndarray] = []
        self.right: list[np.ndarray] = []
        self.pairs = self.chars = 0

    def add(self, h: np.ndarray, owns: np.ndarray, lines: list[str], segment: int) -> list[tuple]:
        p, o = np.flatnonzero(~owns), np.flatnonzero(owns)
        i, j = _pairs([lines[k] for k in p], [lines[k] for k in o], segment, self.edits, self.per)
        a, b = p[i], o[j]
        sizes = np.fromiter(map(len, lines), np.int64, len(lines))
        # lines of one length find each other: the one with the lesser hash asks
        keep = (h[a] != h[b]) & ((sizes[a] != sizes[b]) | (h[a] < h[b]))
        if keep.any():
            at = len(self.lines)
            self.left.append(a[keep] + at)
            self.right.append(b[keep] + at)
            self.hashes.append(h)
            self.lines += lines
            self.pairs += int(keep.sum())
            self.chars += int(sizes.sum())
        return self.close() if self.pairs >= self.most_pairs or self.chars >= self.most_chars else []

    def close(self) -> list[tuple]:
        if not self.pairs:
            return []
        a, b, lines = np.concatenate(self.left), np.concatenate(self.right), self.lines
        near = np.zeros(len(a), bool)
        for at in range(0, len(a), 65536):
            near[at : at + 65536] = within([lines[k] for k in a[at : at + 65536].tolist()], [lines[k] for k in b[at : at + 65536].tolist()], self.edits, self.per)
        distinct, at = np.unique(np.concatenate(self.hashes), return_inverse=True)
        a, b = at[a[near]], at[b[near]]
        counts = np.bincount(a, minlength=len(distinct)) + np.bincount(b, minlength=len(distinct))
        labels = fold_labels(np.arange(len(distinct)), a, b)
        linked = np.flatnonzero(counts)
        self._clear()
        return [(distinct[linked], distinct[labels[linked]], counts[linked])]


def _compared(edits: int, per: int):
    """A function for mapInArrow over rows (key, o, a, h, own, line), those of a tile one behind the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        comparer, held, at = _Comparer(edits, per), None, None
        give = lambda found: [pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in x], ["h", "root", "n"]) for x in found]
        for batch in batches:
            if not batch.num_rows:
                continue
            key, o, a, h, own = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(5))
            lines = batch.column(5).to_pylist()
            cuts = np.flatnonzero((key[1:] != key[:-1]) | (o[1:] != o[:-1]) | (a[1:] != a[:-1])) + 1
            for x, y in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)], strict=True):
                now = (int(key[x]), int(o[x]), int(a[x]))
                if now == at:  # the tile goes on from the batch before
                    held = (np.concatenate([held[0], h[x:y]]), np.concatenate([held[1], own[x:y]]), held[2] + lines[x:y])
                else:
                    if held:
                        yield from give(comparer.add(*held, at[0] & 3))
                    held, at = (h[x:y], own[x:y].astype(bool), lines[x:y]), now
        if held:
            yield from give(comparer.add(*held, at[0] & 3))
        yield from give(comparer.close())

    return run


def edit_links(lines: DataFrame, edits: int = EDITS, tile: int = TILE, per: int = PER_EDIT) -> DataFrame:
    """Rows (h, root, n) of different lines (h, line) within the edits of others: n sums up to a line's links, roots join what is linked.

    Lines can be repeated; those without text are not looked at. Tiles are compared one behind the other within a partition, so
    that small ones share the vectorised steps.
    """
    lines = lines.select("h", "line").where("line is not null")
    # keys at which some line is indexed and another one asks: most keys are of one line alone
    shared = line_keys(lines, edits, per).groupBy("key").agg(F.min("h").alias("low"), F.max("h").alias("high"), F.max("own").alias("own")).where("own and low <> high")
    shared = stored(shared.select(F.col("key").alias("_key")), "shared")
    side = F.broadcast(shared) if shared.count() <= BROADCAST_ROWS else shared
    hit = line_keys(lines, edits, per).join(side, F.col("key") == F.col("_key"), "left_semi").groupBy("key", "h").agg(F.max("own").alias("own"))
    both = F.when(F.col("own"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    members = stored(hit.select("key", "h", F.explode(both).alias("own")), "members")
    # keys with more lines than a tile holds are few: (lines over tile size) of them at most
    many = members.groupBy("key").agg(F.count(F.when(F.col("own"), 1)).alias("owners"), F.count(F.when(~F.col("own"), 1)).alias("askers")).where((F.col("owners") > tile) | (F.col("askers") > tile))
    many = stored(many.select(F.col("key").alias("_key"), F.ceil(F.col("owners") / tile).cast("int").alias("_o"), F.ceil(F.col("askers") / tile).cast("int").alias("_a")), "many")
    side = F.broadcast(many) if many.count() <= BROADCAST_ROWS else many
    tiles = lambda c: F.sequence(F.lit(0), F.coalesce(F.col(c), F.lit(1)) - 1)
    mine = lambda c: F.array(F.pmod(F.xxhash64("h"), F.coalesce(F.col(c), F.lit(1))).cast("int"))
    dealt = members.join(side, F.col("key") == F.col("_key"), "left").select(
        "key", "h", "own", F.explode(F.when(F.col("own"), mine("_o")).otherwise(tiles("_o"))).alias("o"), "_a"
    )
    dealt = dealt.select("key", "h", "own", "o", F.explode(F.when(F.col("own"), tiles("_a")).otherwise(mine("_a"))).alias("a"))
    wanted = stored(members.select("h").distinct(), "wanted")
    side = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    texts = stored(lines.join(side, "h", "left_semi").dropDuplicates(["h"]), "texts")

    rows = dealt.join(texts, "h").select("key", "o", "a", "h", "own", "line")
    return rows.repartition("key", "o", "a").sortWithinPartitions("key", "o", "a").mapInArrow(released(_compared(edits, per)), "h long, root long, n long")


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, per: int = PER_EDIT) -> DataFrame:
    """(id, th, removed: sorted line numbers from 0, n_links) of the rows that lose lines or hold linked ones.

    Lines with a word are of one class if equal or joined by links: ``edits`` edits or fewer, and one at most for every ``per``
    characters of the shorter line. Of each class the first line by id, text hash and number stays, null ids
    last; all others go. n_links counts the links of the row's distinct lines to different lines. Null and blank texts have no lines.
    """
    lines = stored(lines_of(docs, id_col, text_col, per), "lines")
    found = stored(edit_links(lines, edits, TILE, per), "links")
    roots = stored(components(found.select(F.col("h").alias("a"), F.col("root").alias("b"))), "roots")
    place = F.struct(F.col("id").isNull().alias("n"), "id", "th", "line_no")
    per_line = stored(lines.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")), "per_line")
    degree = found.groupBy("h").agg(F.sum("n").alias("degree"))
    joined = per_line.join(roots.withColumnRenamed("node", "h"), "h", "left")
    linked = joined.where("root is not null")
    heads = linked.groupBy("root").agg(F.min("first").alias("head"))
    classes = linked.join(heads, "root").join(degree, "h").select("h", "head", "degree")
    alone = joined.where("root is null and n > 1").select("h", F.col("first").alias("head"), F.lit(0).cast("long").alias("degree"))
    table = stored(classes.unionAll(alone), "classes")
    side = F.broadcast(table) if table.count() <= BROADCAST_ROWS else table
    hit = lines.select("id", "th", "line_no", "h").join(side, "h")
    goes = ~(F.col("id").eqNullSafe(F.col("head.id")) & (F.col("th") == F.col("head.th")) & (F.col("line_no") == F.col("head.line_no")))
    per_row = hit.groupBy("id", "th").agg(F.sort_array(F.collect_set(F.when(goes, F.col("line_no")))).alias("removed"), F.sum("degree").alias("n_links"))
    return per_row


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, per: int = PER_EDIT) -> DataFrame:
    """docs with the repeated lines taken out of the text; every row stays, also if no line is left of it.

    Null texts stay null; blank lines stay; rows equal in id and text are treated alike; columns keep their
    names and order, and none of docs' other columns is looked at.
    """
    gone = stored(removals(docs, id_col, text_col, edits, per).where(F.size("removed") > 0), "removed")
    key, hashed, lost = unused(docs, "_id", "_th", "_removed")
    side = gone.select(F.col("id").alias(key), F.col("th").alias(hashed), F.col("removed").alias(lost))
    numbers = gone.agg(F.coalesce(F.sum(F.size("removed")), F.lit(0)).alias("n")).first()["n"]
    side = F.broadcast(side) if numbers <= BROADCAST_NUMBERS else side.hint("merge")
    match = F.col(id_col).cast("long").eqNullSafe(F.col(key)) & (F.xxhash64(F.col(text_col).cast("string")) == F.col(hashed))
    kept = F.array_join(F.filter(F.split(text_col, "\n", -1), lambda x, i: ~F.array_contains(F.col(lost), i)), "\n")
    out = docs.join(side, match, "left")
    return out.select(*[(F.when(F.col(lost).isNull(), F.col(c)).otherwise(kept).alias(c) if c == text_col else F.col(c)) for c in docs.columns])


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Per document: lines (with a word), lines removed, their numbers (from 0, joined by commas) and the links of its lines to different ones.

    Null and blank texts have no lines; rows equal in id and text are treated alike and stay repeated; null ids come last where the first
    line of a class is chosen; an empty table gives an empty result; other columns are not looked at.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = removals(docs).select(F.col("id").alias("_id"), F.col("th").alias("_th"), "removed", "n_links")
    n_lines = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D][^\n]*")).cast("long")  # one match for each line with a word
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), n_lines.alias("n_lines"))
    out = rows.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")), "left")
    return out.select(
        "doc_id", "n_lines", F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce(F.array_join(F.col("removed").cast("array<string>"), ","), F.lit("")).alias("removed"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")
    )
