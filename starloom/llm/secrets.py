"""Secret scans: fixed rules, and formats learned by grammar inference.

For each kind of labelled credential, a prefix tree is folded into a probabilistic automaton by merging states whose outgoing frequencies, and
whose distributions of the number of characters still to come, agree within a Hoeffding bound. So fixed lengths stay in the states and
free ones become loops. Symbols are character classes, and the characters themselves at the beginning of a format as long as all its samples
have few different ones there. Every run of credential characters in a text is a candidate, and so are its parts between separators; each is scored by every
automaton: its log-likelihood against a background of ordinary strings (classes of characters one behind the other). Values that no fixed rule knows
are reported so. Runs of one shape (a word, a word in capitals, a number) are not scored if no automaton can accept any such run, which follows from
the automata themselves.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from math import inf, log, log2, sqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_KEYWORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_CHARS = "A-Za-z0-9+/_.=-"
_SEPARATORS = "+/_.=-"
#: Classes of characters with the number of their members: lower case (those of hexadecimal digits apart), upper case alike, digits.
_SIZES = {"lower": 20, "a-f": 6, "upper": 20, "A-F": 6, "digit": 10}
_CLASS = {c: "a-f" if c <= "f" else "lower" for c in "abcdefghijklmnopqrstuvwxyz"}
_CLASS |= {c.upper(): "A-F" if c <= "f" else "upper" for c in "abcdefghijklmnopqrstuvwxyz"} | dict.fromkeys("0123456789", "digit") | {c: c for c in _SEPARATORS}
_GROUP = {"lower": "low", "a-f": "low", "upper": "up", "A-F": "up", "digit": "digit"}
#: Chances in ordinary words, names, numbers, paths and the like that a character of a group follows one of another.
_FOLLOWS = {
    "start": {"low": 0.60, "up": 0.20, "digit": 0.15, "sign": 0.05},
    "low": {"low": 0.93, "up": 0.02, "digit": 0.02, "sign": 0.03},
    "up": {"low": 0.45, "up": 0.45, "digit": 0.05, "sign": 0.05},
    "digit": {"low": 0.06, "up": 0.04, "digit": 0.75, "sign": 0.15},
    "sign": {"low": 0.50, "up": 0.15, "digit": 0.30, "sign": 0.05},
}
_WITHIN = {"lower": 0.73 / 20, "a-f": 0.27 / 6, "upper": 0.73 / 20, "A-F": 0.27 / 6, "digit": 1 / 10}
_group = lambda c: _GROUP.get(_CLASS[c], "sign")
_START = {c: log2(_FOLLOWS["start"][_group(c)] * _WITHIN.get(_CLASS[c], 1 / 6)) for c in _CLASS}
_NEXT = {(_group(b), c): log2(_FOLLOWS[_group(b)][_group(c)] * _WITHIN.get(_CLASS[c], 1 / 6)) for b in _CLASS for c in _CLASS}
#: Bits over the background that a credential has at least, in all and for each character.
LEAST_BITS, LEAST_RATE = 8.0, 0.3
#: Different characters up to which a place at the beginning of a format is one of fixed characters.
FIXED = 6
#: Samples in a state from which a class that none of them has is no part of the format.
ENOUGH = 30


def background(value: str) -> list[float]:
    """Log2 chance of each character of a value under the background."""
    return [_NEXT[_group(value[k - 1]), c] if k else _START[c] for k, c in enumerate(value)]


class Automaton:
    """A probabilistic automaton merged from the prefix tree of samples; ``bits(value)`` is their log2-likelihood."""

    def __init__(self, samples: Iterable[str], alpha: float = 0.05):
        samples = [s for s in samples if all(c in _CLASS for c in s)]
        fixed = 0
        while samples and fixed < min(map(len, samples)) and len({s[fixed] for s in samples}) <= min(FIXED, 1 + len(samples) // 20):
            fixed += 1
        count, ends, step = [0], [0], [{}]  # the prefix tree
        passed: list[dict[str, int]] = [defaultdict(int)]
        rest: list[Counter] = [Counter()]  # how many characters are still to come
        for s in samples:
            at = 0
            count[0] += 1
            rest[0][len(s)] += 1
            for k, c in enumerate(s):
                c = c if k < fixed else _CLASS[c]
                passed[at][c] += 1
                if c not in step[at]:
                    step[at][c] = len(count)
                    count.append(0), ends.append(0), step.append({}), passed.append(defaultdict(int)), rest.append(Counter())
                at = step[at][c]
                count[at] += 1
                rest[at][len(s) - k - 1] += 1
            ends[at] += 1
        bound = sqrt(0.5 * log(2 / alpha))

        def differ(f1: int, n1: int, f2: int, n2: int) -> bool:
            return bool(n1 and n2) and abs(f1 / n1 - f2 / n2) > bound * (1 / sqrt(n1) + 1 / sqrt(n2))

        def apart(a: int, b: int) -> float:
            """The largest difference between the shares of strings with so many characters, or fewer, to come."""
            most = x = y = 0.0
            for r in sorted(rest[a].keys() | rest[b].keys()):
                x += rest[a][r] / count[a]
                y += rest[b][r] / count[b]
                most = max(most, abs(x - y))
            return most

        def compatible(a: int, b: int) -> bool:
            stack = [(a, b)]
            while stack:
                a, b = stack.pop()
                if differ(ends[a], count[a], ends[b], count[b]):
                    return False
                for c in passed[a].keys() | passed[b].keys():
                    if differ(passed[a].get(c, 0), count[a], passed[b].get(c, 0), count[b]):
                        return False
                    if c in step[a] and c in step[b]:
                        stack.append((step[a][c], step[b][c]))
            return True

        def merge(a: int, b: int) -> None:
            stack = [(a, b)]
            while stack:
                a, b = stack.pop()
                if a == b:
                    continue
                count[a] += count[b]
                ends[a] += ends[b]
                rest[a].update(rest[b])
                for c, n in passed[b].items():
                    passed[a][c] += n
                for c, to in list(step[b].items()):
                    if c in step[a]:
                        stack.append((step[a][c], to))
                    else:
                        step[a][c] = to

        red = [0]
        while True:
            blue = [(q, c) for q in red for c in sorted(step[q]) if step[q][c] not in red]
            if not blue:
                break
            q, c = min(blue, key=lambda x: (-count[step[x[0]][x[1]]], x))
            b = step[q][c]
            near = sorted((d, r) for d, r in ((apart(r, b), r) for r in red) if d <= bound * (1 / sqrt(count[r]) + 1 / sqrt(count[b])))
            for _, r in near:
                if compatible(r, b):
                    step[q][c] = r
                    merge(r, b)
                    break
            else:
                red.append(b)
        self.n_states, self.fixed = len(red), fixed
        at = {q: i for i, q in enumerate(red)}
        self.moves = [{c: (at[step[q][c]], log2(passed[q][c] / count[q]) - log2(_SIZES.get(c, 1))) for c in step[q] if passed[q][c]} for q in red]
        self.stop = [log2(ends[q] / count[q]) if ends[q] else -inf for q in red]
        for i, q in enumerate(red):  # a class that none of a few samples has here goes where the likeliest one goes, as the next sample might have it
            known = [self.moves[i][c] for c in _SIZES if c in self.moves[i]]
            if known and count[q] < ENOUGH:
                to = max(known, key=lambda move: move[1])[0]
                self.moves[i] |= {c: (to, -log2(count[q] + 2) - log2(n)) for c, n in _SIZES.items() if c not in self.moves[i]}

    def move(self, q: int, c: str) -> tuple[int, float] | None:
        """The state behind q by a character, and its log2 chance."""
        return self.moves[q].get(c) or self.moves[q].get(_CLASS[c])

    def bits(self, value: str) -> float:
        q, total = 0, 0.0
        for c in value:
            move = self.move(q, c)
            if move is None:
                return -inf
            q = move[0]
            total += move[1]
        return total + self.stop[q]

    def most(self, first: str, others: str, needed: str) -> float:
        """A bound on the bits over the background of strings of one character of ``first`` and any of ``others``, one of them or more from ``needed``."""
        best = {(0, None, False): 0.0}
        found, changed = -inf, set(best)
        for length in range(4 * self.n_states + 8):
            new: dict[tuple[int, str | None, bool], float] = {}
            for key in changed:
                q, g, seen = key
                for c in others if length else first:
                    move = self.move(q, c)
                    if move:
                        gain = best[key] + move[1] - (_NEXT[g, c] if g else _START[c])
                        to = (move[0], _group(c), seen or c in needed)
                        if gain > max(best.get(to, -inf), new.get(to, -inf)) + 1e-9:
                            new[to] = gain
            best |= new
            changed = set(new)
            found = max([found, *(v + self.stop[q] for (q, _, seen), v in new.items() if seen)])
            if not changed:
                return found
        return inf  # some loop gains with every round


def labelled_credentials(n: int = 300, seed: int = 7) -> list[tuple[str, str]]:
    """Labelled credentials (kind, value) in publicly documented formats and, as random and prefixed ones, of no known format; made with a fixed seed."""
    rng = random.Random(seed)
    lower, upper, digit = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    pick = lambda chars, k: "".join(rng.choices(chars, k=k))
    every = lower + upper + digit
    make = {
        "github": lambda: "gh" + rng.choice("pousr") + "_" + pick(every, 36),
        "slack": lambda: "xox" + rng.choice("bpa") + "-" + pick(digit, 12) + "-" + pick(digit, 12) + "-" + pick(every, 24),
        "google": lambda: "AIza" + pick(every + "_-", 35),
        "stripe": lambda: "sk_live_" + pick(every, 24),
        "jwt": lambda: "eyJ" + pick(every, rng.randint(17, 37)) + ".eyJ" + pick(every, rng.randint(20, 80)) + "." + pick(every + "_-", 43),
        "uuid": lambda: "-".join(pick("0123456789abcdef", k) for k in (8, 4, 4, 4, 12)),
        "digest": lambda: pick("0123456789abcdef", rng.choice((32, 40, 64))),
        "key": lambda: "AKIA" + pick(upper + "234567", 16),
        "base64": lambda: pick(every + "+/", 40),
        "random": lambda: pick(every, rng.randint(14, 48)),
        "prefixed": lambda: pick(lower, rng.randint(2, 6)) + rng.choice("_-") + pick(every, rng.randint(16, 48)),
    }
    return [(kind, f()) for kind, f in make.items() for _ in range(n)]


class Formats:
    """One automaton for each kind of labelled credentials; all of them score every candidate."""

    def __init__(self, labelled: Iterable[tuple[str, str]], least_bits: float = LEAST_BITS, least_rate: float = LEAST_RATE):
        by: dict[str, list[str]] = defaultdict(list)
        for kind, value in labelled:
            if kind and value:
                by[kind].append(value)
        self.least_bits, self.least_rate = least_bits, least_rate
        self.kinds = {kind: Automaton(values) for kind, values in sorted(by.items())}
        lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
        every = upper + lower
        shapes = {"[A-Z]?[a-z]*[g-z][a-z]*": (every, lower, lower[6:]), "[A-Z]*[G-Z][A-Z]*": (upper, upper, upper[6:]), "[0-9]+": (digits, digits, digits)}
        # runs of these shapes are left to prose if no automaton can give them the bits
        self.hopeless = [shape for shape, strings in shapes.items() if all(own.most(*strings) < least_bits for own in self.kinds.values())]
        skip = f"(?!(?:{'|'.join(self.hopeless)})[.=-]*(?![{_CHARS}]))" if self.hopeless else ""
        self.run = re.compile(f"(?<![{_CHARS}]){skip}[{_CHARS}]+")

    def spans(self, value: str) -> list[tuple[int, int, str, float]]:
        """Learned spans (start, end, kind, bits) in a run of credential characters, those of the most bits first, none over another.

        A span begins behind a separator (or anywhere, for formats that begin with fixed characters) and ends before one.
        """
        stops = {k for k, c in enumerate(value) if c in _SEPARATORS} | {len(value)}
        borders = {0} | {k + 1 for k in stops if k < len(value)}
        # in the middle of a run the first character of a span is the first of a string
        plain = background(value)
        found = []
        for kind, own in self.kinds.items():
            first = own.moves[0]
            for at in range(len(value)) if own.fixed > 2 else sorted(borders):
                if value[at : at + 1] not in first and (own.fixed > 2 or at == len(value)):
                    continue
                q, gain = 0, 0.0
                for k in range(at, len(value)):
                    move = own.move(q, value[k])
                    if move is None:
                        break
                    q = move[0]
                    gain += move[1] - (plain[k] if k > at else _START[value[k]])
                    if k + 1 in stops and own.stop[q] > -inf:
                        total = gain + own.stop[q]
                        if total >= self.least_bits and total >= self.least_rate * (k + 1 - at):
                            found.append((total, at, k + 1, kind))
        out: list[tuple[int, int, str, float]] = []
        for total, a, b, kind in sorted(found, key=lambda x: (-x[0], x[1:])):
            if all(b <= x or y <= a for x, y, _, _ in out):
                out.append((a, b, kind, total))
        return out


def scan(text: str, formats: Formats) -> tuple[list[tuple[int, int, int, str]], list[tuple[int, int, int, str]]]:
    """Base spans and learned spans of a text as (start, rank of kind, end, kind), each sorted."""
    base = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        base += [(m.start(), 0, m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        base += [(m.start(), 1, m.end(), "access") for m in _ACCESS.finditer(text)]
    base += [(m.start(), 2, m.end(), "hex") for m in _HEX.finditer(text)]
    learned = [(m.start() + a, 3, m.start() + b, kind) for m in formats.run.finditer(text) for a, b, kind, _ in formats.spans(m[0])]
    return sorted(base), sorted(learned)


def find_secrets(docs: DataFrame, formats: Formats | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, learned) per row: arrays of (kind, start, end) in code points, by start and kind.

    Null texts count as empty and have no spans; repeated rows and null ids are kept; other columns are not looked at; an empty
    table gives an empty result. The automata are a few kilobytes and travel with the tasks.
    """
    formats = formats or Formats(labelled_credentials())
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    as_rows = lambda found: [{"kind": k, "start": a, "end": b} for a, _, b, k in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, learned = [], []
            for text in batch.column(1):
                x, y = scan(text.as_py() or "", formats)
                base.append(as_rows(x))
                learned.append(as_rows(y))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, span), pa.array(learned, span)], ["id", "base", "learned"])

    kind = "array<struct<kind:string,start:long,end:long>>"
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id long, base {kind}, learned {kind}")


def op7_secrets(spark, sf_dir: str) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every document.

    Null and empty texts have no spans; null ids and repeated rows are kept; spans that begin together come in the order of their kinds; an
    empty table gives an empty result; other columns are not looked at.
    """
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    rank = lambda s: F.when(s["kind"] == "assign", 0).when(s["kind"] == "access", 1).when(s["kind"] == "hex", 2).otherwise(3)
    keyed = F.transform(F.concat("base", "learned"), lambda s: F.struct(s["start"].alias("start"), rank(s).alias("rank"), s["kind"].alias("kind"), s["end"].alias("end")))
    return found.select(
        F.col("id").alias("doc_id"), count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(text(F.col("base")).cast("binary"), 256).alias("base_sha256"), text(F.array_sort(keyed)).alias("spans"),
    )


def base_sha256(spans: list[tuple[int, int, int, str]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in spans).encode()).hexdigest()
