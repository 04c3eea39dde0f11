"""Secret scan: pattern matches, and credential values that would be hard to guess.

The method: a value that stands in a credential context (``password: ...``,
``Bearer ...``, ``scheme://user:...@host``) is split into dictionary words,
dates, repeats, keyboard walks and brute-force spans so that the total guess
cost is least (a shortest path over its positions). A value that even so costs
at least ``min_log10_guesses`` is a secret; a placeholder such as
``your-password`` is cheap and isn't.

Edge cases: a null or empty text gives no span, counts of 0 and the digest of
the empty string. Values are read whole, however long; dictionary words of more
than 24 letters are not tried. Repeated rows each give a row. Other columns of
the input are not read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import long_rows, materialise, read_table, slices

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_CONTEXT = re.compile(
    r"""(?<![A-Za-z])(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[ _-]?key|access[ _-]?key|private[ _-]?key|credentials?|auth)["'`]?[ \t]*(?::=|=>|[:=]{1,2})[ \t]*["'`]?([^\s"'`<>,;]{6,})"""
    r"""|(?<![A-Za-z])bearer[ \t]+([^\s"'`<>,;]{6,})|://[^\s/:@]+:([^\s/@]{6,})@""",
    re.I | re.A,
)
#: A text without any of these has no credential context.
_HINTS = ("pass", "pwd", "secret", "token", "key", "credential", "auth", "bearer", "://")

#: Neighbouring keys of a US keyboard, row by row.
_ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
_SHIFTED = dict(zip('~!@#$%^&*()_+{}|:"<>?', "`1234567890-=[]\\;',./", strict=True))
_LEET = str.maketrans("4@3105$7", "aaelosst")
_DATE = re.compile(r"(?:19|20)\d\d(?:([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01]))?|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d")
#: Cost of one more segment: a guesser has to try where it starts and of what kind it is.
_SEGMENT = 1.0
_LONGEST_WORD = 24


def _grid() -> dict[str, tuple[int, int]]:
    return {c: (y, x) for y, row in enumerate(_ROWS) for x, c in enumerate(row)}


_KEYS = _grid()


def _adjacent(a: str, b: str) -> tuple[int, int] | None:
    p, q = _KEYS.get(_SHIFTED.get(a, a)), _KEYS.get(_SHIFTED.get(b, b))
    if p is None or q is None or p == q:
        return None
    step = (q[0] - p[0], q[1] - p[1])
    return step if abs(step[0]) <= 1 and abs(step[1]) <= 1 else None


class _Starts:
    """Where an open segment may have begun: (start, cost up to there), for costs that grow with log10 of the length.

    Of two starts the earlier one, once it is as cheap, stays so, and the later
    one goes. An earlier one that costs as much up to its start as a later one
    never gets cheaper, and goes too. Few are left at a time.
    """

    def __init__(self) -> None:
        self.at: list[tuple[int, float]] = []

    def cheapest(self, end: int, first: int, least: int, shift: int = 0) -> float:
        """Cost + log10 of (length - shift) of the best start from ``first`` on that lies ``least`` or more before ``end``."""
        low, found, keep = math.inf, math.inf, []
        for i, cost in self.at:
            if i >= first:
                if end - i - shift > 0:
                    own = cost + math.log10(end - i - shift)
                    if own >= low:
                        continue
                    low = own
                    if end - i >= least:
                        found = own
                keep.append((i, cost))
        floor, self.at = math.inf, []
        for i, cost in reversed(keep):
            if cost < floor:
                self.at.append((i, cost))
                if end - i >= least:
                    floor = cost
        self.at.reverse()
        return found


_TURN, _KEYS_47 = math.log10(4.6), math.log10(47)


def guess_cost(value: str, ranks: dict[str, int]) -> float:
    """log10 of the guesses that the cheapest segmentation of ``value`` takes.

    ``ranks``: dictionary words in lower case with their rank from 1.
    """
    n, low = len(value), value.lower()
    if len(low) != n:  # letters whose lower case is longer
        low = "".join(c.lower()[:1] or c for c in value)
    plain = low.translate(_LEET)
    steps = [None, *(_adjacent(low[k - 1], low[k]) for k in range(1, n))]
    turns = [0] * (n + 1)  # changes of direction up to each step
    for k in range(1, n):
        turns[k] = turns[k - 1] + (steps[k] != steps[k - 1])
    turns[n] = turns[n - 1] if n else 0
    classes = [any(c.islower() for c in value) * 26, any(c.isupper() for c in value) * 26, any(c.isdigit() for c in value) * 10, any(not c.isalnum() for c in value) * 33]
    char = math.log10(max(10, min(sum(classes), 36)))
    best = [0.0] + [math.inf] * n
    brute = [math.inf] * (n + 1)  # cheapest way that ends in a brute-force span
    walks, walk_from = _Starts(), 0
    repeats = {unit: [_Starts() for _ in range(unit)] for unit in range(1, 9)}
    repeat_from = dict.fromkeys(repeats, 0)
    for i in range(n + 1):
        if i >= 2 and steps[i - 1] is None:
            walk_from = i - 1
        if i >= 3:
            best[i] = min(best[i], walks.cheapest(i, walk_from, 3, 1) + _KEYS_47 + _TURN * (1 + turns[i - 1]))
        for unit, starts in repeats.items():
            if i > unit and low[i - 1] != low[i - 1 - unit]:
                repeat_from[unit] = i - unit
            if i >= 2 * unit:
                cost = starts[i % unit].cheapest(i, repeat_from[unit], 3 if unit == 1 else 2 * unit)
                best[i] = min(best[i], cost + unit * char - math.log10(unit))
        if i and brute[i] < best[i]:
            best[i] = brute[i]
        if i == n:
            break
        here = best[i] + (_SEGMENT if i else 0)
        walks.at.append((i, here - _TURN * turns[i + 1]))
        for unit, starts in repeats.items():
            starts[i % unit].at.append((i, here))
        brute[i + 1] = min(brute[i + 1], brute[i] + char, here + char)
        for j in range(i + 2, min(n, i + _LONGEST_WORD) + 1):
            for form, extra in ((low[i:j], 0.0), (plain[i:j], 0.6)):
                if (r := ranks.get(form)) is not None:
                    cost = math.log10(r + 1) + extra + (0.3 if value[i:j] != low[i:j] else 0)
                    best[j] = min(best[j], here + cost)
                    break
        if m := _DATE.match(value, i):
            best[m.end()] = min(best[m.end()], here + (math.log10(150) if m.end() - i == 4 else math.log10(366 * 150)))
    return min(best[n], brute[n])


def scan(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """Base spans of one text as (start, kind number, end), and (start, end) of the values in credential context."""
    text = text or ""
    base, said = [], []
    low = text.lower()
    hinted = any(h in low for h in _HINTS)
    if hinted:
        base += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        base += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    base += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    base.sort()
    if hinted:
        said = [m.span(m.lastindex) for m in _CONTEXT.finditer(text)]
    return base, said


def outside(base: list[tuple[int, int, int]], said: list[tuple[int, int]]) -> list[bool]:
    """Whether each of ``said`` lies in no base span; one pass, as both are sorted by start."""
    out, k, far = [], 0, -1
    for start, end in said:
        while k < len(base) and base[k][0] <= start:
            far, k = max(far, base[k][2]), k + 1
        out.append(far < end)
    return out


KINDS = ("assign", "access", "hex", "guess")


def words_in(text: Column) -> Column:
    """Runs of letters of whatever script, in lower case."""
    return F.explode(F.split(F.lower(text), r"[^\p{L}]+"))


def word_ranks(docs: DataFrame, leave_out: DataFrame) -> DataFrame:
    """word, rank (1 + number of more frequent words) for every word of all texts, less its occurrences in ``leave_out(value, n)``.

    Ranks come from how many words have each count: at most the square root of
    twice the corpus' words, so the one window over these levels is small.
    """
    one = docs.select(words_in(F.col("text")).alias("word"), F.lit(1).cast("long").alias("n"))
    less = leave_out.select(words_in(F.col("value")).alias("word"), (-F.col("n")).alias("n"))
    counts = one.unionByName(less).where(F.length("word").between(2, _LONGEST_WORD)).groupBy("word").agg(F.sum("n").alias("n")).where("n > 0")
    counts = materialise(counts, "word-counts")
    above = Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    levels = counts.groupBy("n").agg(F.count("*").alias("m")).select("n", (F.coalesce(F.sum("m").over(above), F.lit(0)) + 1).alias("rank"))
    return counts.join(levels, "n").select("word", "rank")


def _parts(value: str, most: int = 10_000) -> Iterator[set[str]]:
    """Substrings of a value that may be words: letters only, plain or after undoing usual replacements.

    They come in sets of about ``most``, as a value of a megabyte has tens of
    millions of them; one that stands in distant places may come again.
    """
    low, own = value.lower(), set()
    for form in {low, low.translate(_LEET)}:
        for r in "".join(c if c.isalpha() else " " for c in form).split():
            for i in range(len(r) - 1):
                own.update(r[i:j] for j in range(i + 2, min(len(r), i + _LONGEST_WORD) + 1))
                if len(own) >= most:
                    yield own
                    own = set()
    if own:
        yield own


def hard_values(values: DataFrame, ranks: DataFrame, min_log10_guesses: float) -> DataFrame:
    """The rows of ``values(vid, value)`` whose cheapest segmentation takes that many guesses.

    Substrings meet the dictionary in a join, so it may be of any size and each
    task holds only the words of its own values.
    """

    def split(batches):
        for b in slices(batches, 100):
            for vid, value in zip(b["vid"].to_pylist(), b["value"].to_pylist(), strict=True):
                for some in map(list, _parts(value)):
                    yield pa.RecordBatch.from_arrays([pa.array([vid] * len(some), pa.int64()), pa.array(some, pa.string())], names=["vid", "word"])

    def judge(batches):
        for b in slices(batches, 100):
            own = [dict(w or ()) for w in b["words"].to_pylist()]
            on = [guess_cost(v, w) >= min_log10_guesses for v, w in zip(b["value"].to_pylist(), own, strict=True)]
            yield pa.RecordBatch.from_arrays([b["value"].filter(pa.array(on, pa.bool_()))], names=["value"])

    known = values.mapInArrow(split, "vid long, word string").join(ranks, "word")
    known = known.groupBy("vid").agg(F.map_from_entries(F.collect_set(F.struct("word", "rank"))).alias("words"))
    return values.join(known, "vid", "left").select("value", "words").mapInArrow(judge, "value string")


def find_secrets(docs: DataFrame, ranks: DataFrame | None = None, min_log10_guesses: float = 8.0) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, spans array<struct<start,kind_no,end,kind,value,base>>.

    Offsets are code points, end exclusive. Kinds: assign, access, hex (base)
    and guess (a credential value outside every base span that costs at least
    ``10 ** min_log10_guesses`` guesses). ``ranks(word, rank)``: another
    dictionary than the words of all texts.
    """
    docs = docs.select("doc_id", "text")
    span = pa.struct([("start", pa.int32()), ("kind_no", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("value", pa.string()), ("base", pa.bool_())])
    one = "struct<start:int,kind_no:int,end:int,kind:string,value:string,base:boolean>"

    def run(batches):
        for b in slices(batches):
            spans, values = [], []
            for t in b["text"].to_pylist():
                base, said = scan(t)
                spans.append([{"start": s, "kind_no": k, "end": e, "kind": KINDS[k], "value": t[s:e], "base": True} for s, k, e in base])
                free = outside(base, said)
                values.append([{"start": s, "kind_no": 3 if o else -1, "end": e, "kind": KINDS[3], "value": t[s:e], "base": False} for (s, e), o in zip(said, free, strict=True)])
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(spans, pa.list_(span)), pa.array(values, pa.list_(span))], names=["doc_id", "spans", "said"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = long_rows(docs).mapInArrow(run, f"doc_id {kind}, spans array<{one}>, said array<{one}>")
    rows = materialise(rows.withColumn("_row", F.monotonically_increasing_id()), "credential-values")
    said = rows.where(F.size("said") > 0).select("_row", F.explode("said").alias("s")).withColumn("value", F.col("s.value"))
    if ranks is None:
        ranks = word_ranks(docs, said.groupBy("value").agg(F.count("*").alias("n")))
    said = said.where("s.kind_no = 3")
    values = materialise(said.select("value").distinct().withColumn("vid", F.monotonically_increasing_id()), "distinct-values")
    hard = said.join(hard_values(values, ranks, min_log10_guesses), "value").groupBy("_row").agg(F.collect_list("s").alias("more"))
    out = rows.join(hard, "_row", "left")
    return out.select("doc_id", F.when(F.col("more").isNull(), F.col("spans")).otherwise(F.array_sort(F.concat("spans", "more"))).alias("spans"))


def secret_digest(found: DataFrame) -> DataFrame:
    """Counts, the digest of the base spans and all spans as one string."""
    said = lambda arr: F.concat_ws(",", F.transform(arr, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        of("assign").alias("n_assign"),
        of("access").alias("n_access"),
        of("hex").alias("n_hex"),
        F.sha2(said(F.filter("spans", lambda s: s["base"])), 256).alias("base_sha256"),
        said(F.col("spans")).alias("spans"),
        of("guess").alias("n_guess"),
    )


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digest(find_secrets(read_table(spark, sf_dir, "documents")))


def digest_of(base: list[tuple[int, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in base).encode()).hexdigest()
