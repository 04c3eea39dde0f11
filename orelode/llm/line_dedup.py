"""Line dedup: an exact set-similarity join over the lines of all documents, with DataFrame functions only.

A line's set is its distinct words in lower case. A line goes if an earlier
line of the corpus (by doc_id, then line number) has Jaccard similarity of at
least ``percent`` / 100 with it. Lines without a word stay and match nothing.

1. Words are put in order of rarity: exact counts of each word give
   it a level (``LEVELS`` steps of a logarithm); the levels travel as a
   constant of fixed size, by ``SLOTS`` slots of the words' hashes (words that
   share a slot share the level of the commonest). Any common order gives the
   same result; rare words first keeps lists short.
2. Equal lines are one class (128 bits of hash), known by its first place; the
   others of it go. Only the prefix of a class's words travels.
3. Prefix filter: similar sets share a word among their first
   n - ceil(percent * n / 100) + 1. Length, positional and parity filters are
   join conditions, so pairs that fail are never rows. Parity: 128 bits (64 for
   lines of at most ``FEW_WORDS`` words), each the parity of how many words fall on it; each bit in which two lines differ
   is a word that only one has.
4. Pairs left are verified on the words themselves, read from the texts again.
   A line needs one earlier match only: each first meets the earliest line of
   each of its words of over ``SHORT_LIST`` lines, so large groups of copies cost no more than their members; only
   lines that this doesn't settle meet all their other partners. A word's level
   tells how long its list may be: lists of over ``LIST_ROWS`` lines are dealt
   over several tasks, each with an earliest line of its own.

Every step is written to the shared folder, so the next reads only what it
needs and earlier shuffle files can go.

Edge cases: a null text stays null; a null doc_id's lines stay and match
nothing. Rows that share doc_id and text are one document; texts that share
a doc_id are documents of their own, in an order fixed by a hash of the text. A
text whose lines all go is empty. Lines end at line feeds only; a very long
line or text is read whole. Columns named like the operator's own (n_lines,
n_removed) are replaced, others kept. An empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, discard, materialise, read_table

PERCENT = 80
#: Words that occur more often than this have their lists dealt over several tasks.
LIST_ROWS = 100_000
#: Words that occur in more lines than this first lead to their earliest line only.
SHORT_LIST = 200
#: Lines of at most this many words have 64 bits of parity, longer ones 128.
FEW_WORDS = 64
#: Holds the distinct hashes of a file, so that a hash is stored as an index of two to three bytes.
DICTIONARY = {"parquet.dictionary.page.size": str(8 << 20)}
#: Levels of rarity, and slots of the table that holds them: 16 of four bits to a long.
LEVELS, LONGS = 16, 1 << 14
SLOTS = LONGS * 16
#: Larger n and positions are not told apart in the index; such pairs are left to verification.
MOST = (1 << 16) - 1
#: The bit of an index row's m that says that its line still looks for a match.
OPEN = 1 << 15


def _spaced(line: Column) -> Column:
    """Every white-space character of a line as a plain space, so that a fixed one-character pattern splits it."""
    for c in "\t\x0b\x0c\r":
        line = F.replace(line, F.lit(c), F.lit(" "))
    return line


def word_hashes(line: Column) -> Column:
    """Hashes of the distinct words of a line."""
    own = F.transform(F.split(_spaced(line), " "), lambda w: F.xxhash64(w))
    return F.array_remove(F.array_distinct(own), F.xxhash64(F.lit("")))


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, line, low (the line in lower case) of every line of ``docs(doc_id, text_key, text)``."""
    return docs.select("doc_id", "text_key", F.posexplode(F.split(F.lower("text"), "\n")).alias("line", "low"))


def line_words(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, line, k1, k2, words (hashes of the distinct words) of every line: texts are split once, here."""
    keys = [F.xxhash64("low").alias("k1"), F.xxhash64(F.lit(1), F.col("low")).alias("k2")]
    rows = lines_of(docs).select("doc_id", "text_key", "line", *keys, word_hashes(F.col("low")).alias("words"))
    return materialise(rows, "line-hashes", DICTIONARY)


def rarity_levels(lines: DataFrame) -> tuple[list[int], list[int]]:
    """The levels (-8 to 7) of all slots, and the largest count of each level.

    Exact counts of lines by word first (with map-side partials), then the
    largest of each slot; at most LONGS numbers, of 16 slots each, come to the driver.
    """
    counts = lines.select(F.explode("words").alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    slots = materialise(counts.groupBy(F.col("w").bitwiseAND(SLOTS - 1).alias("s")).agg(F.max("n").alias("n")), "word-slots")
    step = math.log((slots.agg(F.max("n")).first()[0] or 1) + 1) / (LEVELS - 0.001)
    # Half of the levels are stored as negative numbers, so that codes sort by level.
    level = F.pmod(F.floor(F.log("n") / step).cast("long") + LEVELS // 2, F.lit(LEVELS)).alias("v")
    packed = slots.select(F.expr(f"int(s & {LONGS - 1})").alias("i"), F.expr(f"int(4 * (s div {LONGS}))").alias("by"), level)
    got = packed.groupBy("i").agg(F.bit_or(F.expr("shiftleft(v, `by`)")).alias("v")).toPandas()
    table = [0] * SLOTS
    for i, v in zip(got["i"].tolist(), got["v"].tolist(), strict=True):
        table[i::LONGS] = [((v >> 4 * k & 15) ^ 8) - 8 for k in range(16)]
    discard(slots)
    return table, [math.ceil(math.exp((k + 1) * step)) for k in range(LEVELS)]


def word_codes(hashes: Column, levels: list[int]) -> Column:
    """Sorted codes of word hashes, rare words first: four bits of level, then 60 bits of the hash."""
    table = F.from_json(F.lit(str(levels)), "array<bigint>")

    def code(h: Column) -> Column:
        return F.shiftleft(F.get(table, h.bitwiseAND(SLOTS - 1).cast("int")), 60).bitwiseOR(F.shiftrightunsigned(h, 4))

    return F.sort_array(F.transform(hashes, code))


def _parity(half: int) -> Column:
    """64 of the 128 parity bits: those of codes whose 7th lowest bit is ``half``. A short line has both halves, one upon the other, in the first."""
    own = f"aggregate(codes, 0L, (a, c) -> if((c & 64) = {64 * half}, a ^ shiftleft(1L, int(c & 63)), a))"
    both = "0L" if half else "aggregate(codes, 0L, (a, c) -> a ^ shiftleft(1L, int(c & 63)))"
    return F.expr(f"if(size(codes) <= {FEW_WORDS}, {both}, {own})")


def line_classes(lines: DataFrame, levels: list[int], percent: int) -> DataFrame:
    """doc_id, text_key, line (the first place), k1, k2, n, b0, b1, prefix: one row per distinct line with a word."""
    # explode keeps the codes from being computed once for each use of them.
    codes = F.explode(F.array(word_codes(F.col("words"), levels))).alias("codes")
    sets = lines.where("size(words) > 0").select("doc_id", "text_key", "line", "k1", "k2", codes)
    n = F.size("codes")
    prefix = F.slice("codes", F.lit(1), F.expr(f"size(codes) - int((size(codes) * {percent}L + 99) div 100) + 1"))
    slim = sets.select(F.struct("doc_id", "text_key", "line").alias("at"), "k1", "k2", F.struct(n.alias("n"), _parity(0).alias("b0"), _parity(1).alias("b1"), prefix.alias("prefix")).alias("own"))
    first = slim.groupBy("k1", "k2").agg(F.min("at").alias("at"), F.first("own").alias("own"))
    return materialise(first.select("at.*", "k1", "k2", "own.*"), "line-classes")


def prefix_index(classes: DataFrame) -> DataFrame:
    """A row for each word of each class's prefix: word, doc_id, text_key, m, b0, b1.

    m holds, from its upper half down, the line, n (16 bits), whether the class
    is open (1) and the word's place in the prefix (15). Of one text's rows
    with a word, m is in order of lines.

    No word is null; saying so makes the sides of a join on it the same plan,
    which is shuffled once.
    """
    is_open = F.expr(f"if(open, {OPEN}L, 0L)") if "open" in classes.columns else F.lit(0).cast("long")
    rows = classes.select("doc_id", "text_key", F.expr(f"shiftleft(bigint(line), 32) | shiftleft(bigint(least(n, {MOST})), 16)").bitwiseOR(is_open).alias("own"), "b0", "b1", F.posexplode("prefix").alias("pos", "word"))
    return rows.select("word", "doc_id", "text_key", F.expr(f"own | least(pos, {OPEN - 1})").alias("m"), "b0", "b1").where("word is not null")


def _n(side: str) -> str:
    return f"(shiftright({side}.m, 16) & {MOST})"


#: With a short line, the other's halves are laid upon each other too.
_SHORT = f"({_n('a')} <= {FEW_WORDS} or {_n('b')} <= {FEW_WORDS})"
_DIFFER = f"if({_SHORT}, bit_count(a.b0 ^ b.b0 ^ a.b1 ^ b.b1), bit_count(a.b0 ^ b.b0) + bit_count(a.b1 ^ b.b1))"


def _maybe(percent: int) -> str:
    """b is earlier than a, and no filter rules out that they are similar."""
    na, nb, pa, pb = _n("a"), _n("b"), f"(a.m & {OPEN - 1})", f"(b.m & {OPEN - 1})"
    return f"""(b.doc_id < a.doc_id or (b.doc_id = a.doc_id and (b.text_key < a.text_key or (b.text_key = a.text_key and b.m < a.m))))
        and ({na} = {MOST} or {nb} = {MOST}
          or (100 * least({na}, {nb}) >= {percent} * greatest({na}, {nb})
            and {100 + percent} * least({na} - {pa}, {nb} - {pb}) >= {percent} * ({na} + {nb})
            and {100 + percent} * {_DIFFER} <= {100 - percent} * ({na} + {nb})))"""


_FIRST, _SECOND = ([f"{s}.doc_id as d{k}", f"{s}.text_key as t{k}", f"int(shiftright({s}.m, 32)) as l{k}"] for k, s in ((1, "a"), (2, "b")))


def earliest_partners(classes: DataFrame, percent: int, counts: list[int]) -> DataFrame:
    """d1, t1, l1, d2, t2, l2: each class with the likeliest of the earliest classes that its common words lead to.

    One partner a word at most, so a group of copies gives as many rows as it
    has members. A word's rows stream by in order of place: only the first of
    them is held. ``counts``: the most lines with a word of each level. Words
    of at most ``SHORT_LIST`` lines are left to ``other_partners``, where a
    line meets no more than that many by such a word.
    """
    shares = F.array(*(F.lit(max(1, n // LIST_ROWS)) for n in counts))
    level = F.pmod(F.shiftright("word", 60).cast("int") + LEVELS // 2, F.lit(LEVELS))
    common = F.get(F.array(*(F.lit(n > SHORT_LIST) for n in counts)), level)
    index = prefix_index(classes).where(common).withColumn("salt", F.pmod(F.xxhash64("doc_id", F.shiftright("m", 32)), F.get(shares, level)).cast("int"))
    upto = Window.partitionBy("word", "salt").orderBy("doc_id", "text_key", "m").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = F.struct("doc_id", "text_key", "m", "b0", "b1")
    met = index.select(own.alias("a"), F.first(own).over(upto).alias("b")).where(F.expr(_maybe(percent)))
    best = met.selectExpr(*_FIRST, f"struct({_DIFFER} as x, {', '.join(_SECOND)}) as m").groupBy("d1", "t1", "l1").agg(F.min("m").alias("m"))
    return materialise(best.select("d1", "t1", "l1", "m.d2", "m.t2", "m.l2"), "line-partners")


def other_partners(classes: DataFrame, settled: DataFrame, percent: int) -> DataFrame:
    """d1, t1, l1, d2, t2, l2: every class that isn't settled with every earlier class that may be similar.

    Both sides are the same rows, so they are shuffled once; that a side is
    open is asked in the join (and with the other side's m, which is never
    negative, or it would be asked before the shuffle and make two of it).
    """
    done = settled.select(F.col("d1").alias("doc_id"), F.col("t1").alias("text_key"), F.col("l1").alias("line"), F.lit(True).alias("_done"))
    marked = classes.drop("k1", "k2").join(done, ["doc_id", "text_key", "line"], "left").withColumn("open", F.col("_done").isNull()).drop("_done")
    index = prefix_index(marked)
    pairs = index.alias("a").join(index.alias("b"), F.expr(f"a.word = b.word and ((a.m & {OPEN}) > 0 or b.m < 0) and {_maybe(percent)}"))
    return materialise(pairs.selectExpr(*_FIRST, *_SECOND).distinct(), "line-pairs")


def verified(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """d1, t1, l1 of pairs whose sets of words are similar, read from the texts of ``docs(doc_id, text_key, text)``."""
    ends = F.explode(F.array(F.struct(F.col("d1").alias("doc_id"), F.col("t1").alias("text_key"), F.col("l1").alias("line")), F.struct(F.col("d2").alias("doc_id"), F.col("t2").alias("text_key"), F.col("l2").alias("line"))))
    wanted = pairs.select(ends.alias("e")).groupBy("e.doc_id", "e.text_key").agg(F.collect_set("e.line").alias("lines"))  # lines of one text
    # Never broadcast, so that the plan is the same at every size; texts aren't sorted, line numbers are what is held.
    texts = docs.join(wanted.hint("shuffle_hash"), ["doc_id", "text_key"]).select("doc_id", "text_key", "lines", F.split(F.lower("text"), "\n").alias("_all"))
    sets = texts.select("doc_id", "text_key", F.explode("lines").alias("line"), "_all").select("doc_id", "text_key", "line", F.get("_all", F.col("line")).alias("low"))
    words = F.array_remove(F.array_distinct(F.split(_spaced(F.col("low")), " ")), "")
    sets = materialise(sets.select("doc_id", "text_key", "line", words.alias("words")), "line-words")
    one = sets.toDF("d1", "t1", "l1", "c1")
    two = sets.toDF("d2", "t2", "l2", "c2")
    both = pairs.join(one, ["d1", "t1", "l1"]).join(two, ["d2", "t2", "l2"])
    # The common words o stand here once, so that they are counted once: 100 o >= percent (n1 + n2 - o).
    hit = both.where(f"{100 + percent}L * size(array_intersect(c1, c2)) >= {percent}L * (size(c1) + size(c2))").select("d1", "t1", "l1").distinct()
    hit = materialise(hit, "line-hits")
    discard(sets, pairs)
    return hit


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")


def lines_to_remove(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, text_key, gone (array of line numbers) of texts with lines that go."""
    docs = _keyed(docs)
    lines = line_words(docs)
    levels, counts = rarity_levels(lines)
    classes = line_classes(lines, levels, percent)
    # Later members of a class; lines without a word have none.
    places = classes.select("k1", "k2", F.col("doc_id").alias("d0"), F.col("text_key").alias("t0"), F.col("line").alias("l0"))
    again = lines.select("doc_id", "text_key", "line", "k1", "k2").join(places, ["k1", "k2"]).where("doc_id <> d0 or text_key <> t0 or line <> l0")
    again = materialise(again.select("doc_id", "text_key", "line"), "lines-again")
    discard(lines)
    hits = verified(earliest_partners(classes, percent, counts), docs, percent)
    more = verified(other_partners(classes, hits, percent), docs, percent)
    gone = hits.unionByName(more).toDF("doc_id", "text_key", "line").unionByName(again)
    gone = materialise(gone.groupBy("doc_id", "text_key").agg(F.collect_set("line").alias("gone")), "lines-gone")
    discard(classes, again, hits, more)
    return gone


def dedup_lines(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs(doc_id, text, ...)`` with text reduced to the lines that stay, and n_lines, n_removed (long).

    Other columns come back unchanged, whatever they are called; those named
    n_lines or n_removed are replaced.
    """
    own = docs.select(*(c for c in docs.columns if c not in ("n_lines", "n_removed")))
    names = own.columns
    own = own.toDF(*(c if c in ("doc_id", "text") else f"carried_{k}" for k, c in enumerate(names)))
    gone = lines_to_remove(docs, percent).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), F.col("gone").alias("_gone"))
    out = own.join(gone.hint("shuffle_hash"), (F.col("doc_id").cast("long") == F.col("_id")) & (F.xxhash64("text") == F.col("_key")), "left")
    every = F.split("text", "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(every) - 1), "_gone")
    clean = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform("_stay", lambda i: F.get("_all", i)), "\n"))
    n = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"))) + 1).cast("long")
    out = out.withColumn("_all", F.when(F.col("_gone").isNotNull(), every)).withColumn("_stay", F.when(F.col("_gone").isNotNull(), stay))
    removed = F.when(F.col("_gone").isNull(), F.lit(0)).otherwise(F.size("_all") - F.size("_stay")).cast("long")
    kept = out.select(*(clean.alias("text") if c == "text" else F.col(c) for c in own.columns), n.alias("n_lines"), removed.alias("n_removed"))
    return kept.toDF(*names, "n_lines", "n_removed")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(read_table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


LINE_DEDUP_SQL = f"""
with lines as (select doc_id, unnest(range(0, len(string_split(text, chr(10)))::bigint)) as line, unnest(string_split(text, chr(10))) as words from documents where doc_id is not null),
 sets as (select doc_id, line, list_distinct(regexp_extract_all(lower(words), '{WORD}')) as s, lower(words) as low from lines),
 big as (select {{'d': doc_id, 'l': line}} as pl, s, low, len(s) as n from sets where len(s) > 0),
 cls as (select low, min(pl) as pl, any_value(s) as s, any_value(n) as n from big group by low),
 tok as (select pl, n, unnest(s) as w from cls),
 df as (select w, count(*) as df from tok group by w),
 ord as (select pl, n, w, row_number() over (partition by pl order by df, w) as p from tok join df using (w)),
 idx as (select pl, n, w from ord where p <= n - (n * {PERCENT} + 99) // 100 + 1),
 pairs as (select distinct a.pl as a, b.pl as b from idx a join idx b on a.w = b.w and b.pl < a.pl and 100 * least(a.n, b.n) >= {PERCENT} * greatest(a.n, b.n)),
 ok as (select distinct p.a from pairs p join cls x on x.pl = p.a join cls y on y.pl = p.b
   where 100 * len(list_intersect(x.s, y.s)) >= {PERCENT} * (x.n + y.n - len(list_intersect(x.s, y.s)))),
 gone as (select big.pl.d as doc_id, big.pl.l as line from big join cls on big.low = cls.low where big.pl <> cls.pl union select a.d, a.l from ok),
 kept as (select l.doc_id, count(*) as n_lines, count(g.line) as n_removed, string_agg(l.words, chr(10) order by l.line) filter (g.line is null) as text
   from lines l left join gone g on l.doc_id = g.doc_id and l.line = g.line group by l.doc_id)
select d.doc_id, coalesce(k.n_lines, 0)::bigint as n_lines, coalesce(k.n_removed, 0)::bigint as n_removed,
  case when d.text is null then null else coalesce(k.text, '') end as text from documents d left join kept k on d.doc_id = k.doc_id
"""
