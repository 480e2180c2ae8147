"""Operator 7: near-duplicate lines by a segment-partition edit join, in DataFrame operations only.

A line goes if an earlier line (smaller doc_id, or same document and smaller line number; judged on the input) is equal or
within EDITS edits of it. Of two such lines one cut into EDITS + 1 segments keeps a segment that occurs in the other at a place
that the lengths and the number of edits allow, so:

1. Every line gives the hashes of its own segments and of those substrings that could be a segment of a line 0 to EDITS shorter
   (the multi-match-aware choice: 12 of them for two edits), each with the segment's number and length of line.
2. Hashes that only one text has are dropped; only their lines are read again. Two lines that share a hash and whose counts of some
   letters differ by no more than the edits allow are candidates.
3. Candidates are verified by a bit-parallel automaton over a band of 2 * EDITS + 1 diagonals (within_edits). First each line is compared with the
   earliest lines of its hashes alone; only lines that stay after that are compared with all earlier ones. So a large group of
   similar lines, most of which are near its earliest, is compared in proportion to its size.

Each text gives hashes once, however many copies it has: lines that may have copies (by a bitmap of fixed size) are joined with the
places of first copies. Lines without a word always stay. Lines of fewer than LEAST characters have no part in the edit join, as two
edits would make other words of them, but their exact copies go. Groups are held by window and join operators that spill; letter
counts are tested within the join.

Null texts have no lines and stay null. Rows that share a doc_id count as parts of one document at the same line numbers: equal
lines at the same place of both stay. Null doc_ids take no part and stay as they are. Other columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import WORD, Scratch, fresh, likely, table

EDITS = 2
LEAST = 20
#: Groups of letters whose counts are compared, five bits each in a long.
LETTERS = ("e", "a", "i", "n", "t", "s", "r", "o", "hw", "dl", "cum", "bgpvfykqjxz")


def numbered(documents: DataFrame, least: int = 1) -> DataFrame:
    """doc_id, pos, line of the lines with a word and `least` characters, with two hashes of the line."""
    lines = documents.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.where((F.char_length("line") >= least) & F.col("line").rlike(WORD)).select("doc_id", "pos", "line", F.xxhash64("line").alias("id"), F.xxhash64(F.lit("second"), F.col("line")).alias("id2"))


def _choices(edits: int) -> list[tuple[int, int, int]]:
    """(how much shorter the other line is, its segment, how much later than in it the substring starts)."""
    return [(d, i, j) for d in range(edits + 1) for i in range(1, edits + 2) for j in range(max(1 - i, d - (edits + 1 - i)), min(i - 1, d + (edits + 1 - i)) + 1)]


def _keyed(lines: DataFrame, edits: int = EDITS) -> DataFrame:
    """(key, id, own): hashes of possible segments of lines (id, line); own for the line's own ones.

    Lengths and cuts are columns of their own, so that each is computed once for a line.
    """
    parts = edits + 1
    codes = {100 * d + 10 * i + j + 5: d == 0 and j == 0 for d, i, j in _choices(edits)}
    made = lines.select("id", "line", F.char_length("line").alias("n"), F.explode(F.array(*map(F.lit, codes))).alias("c"))
    made = made.selectExpr("id", "line", "n", "c", "c div 10 % 10 as i", "n - c div 100 as size").selectExpr("id", "line", "n", "c", "i", "size", f"size div {parts} as q", f"{parts} - size % {parts} as whole")
    # segments after the first `whole` ones are longer by one
    made = made.selectExpr("id", "line", "n", "c", "i", "size", "cast(q * (i - 1) + greatest(i - 1 - whole, 0) + c % 10 - 4 as int) as start", "cast(q + if(whole < i, 1, 0) as int) as length")
    made = made.where("start >= 1 and start + length - 1 <= n")
    own = [c for c, o in codes.items() if o]
    return made.select(F.xxhash64("i", "size", F.substring("line", F.col("start"), F.col("length"))).alias("key"), "id", F.col("c").isin(own).alias("own"))


def _letters(line: Column) -> Column:
    """Counts of each of LETTERS modulo 32, packed."""
    n, out = F.char_length(line), F.lit(0).cast("long")
    for k, group in enumerate(LETTERS):
        out = out.bitwiseOR(F.shiftleft((n - F.char_length(F.translate(line, group, ""))).cast("long").bitwiseAND(F.lit(31)), 5 * k))
    return out


def _letters_apart(a: str, b: str) -> str:
    """SQL for the sum of differences of packed counts; an edit adds at most two."""
    return " + ".join(f"abs(pmod((shiftright({a}, {5 * k}) & 31) - (shiftright({b}, {5 * k}) & 31) + 16, 32) - 16)" for k in range(len(LETTERS)))


def within_edits(pairs: DataFrame, a: str, b: str, edits: int = EDITS) -> DataFrame:
    """The pairs whose texts a and b are at most `edits` insertions, deletions and substitutions apart, by a banded bit-parallel automaton.

    What both share at either end is cut off. For each number of errors a word of 2 * edits + 1 bits holds the diagonals of the band that are
    reached with at most that many; all bits move at once with each character of b, by one mask of the places where a agrees.
    """
    band = 2 * edits + 1
    chars = pairs.withColumns({"_a": F.split(a, ""), "_b": F.split(b, "")}).withColumns({"_a": F.filter("_a", lambda c: c != ""), "_b": F.filter("_b", lambda c: c != "")})

    def shared(x: Column, y: Column) -> Column:
        first = F.array_position(F.zip_with(x, y, lambda p, q: p.eqNullSafe(q)), False)
        return F.when(first > 0, first - 1).otherwise(F.least(F.size(x), F.size(y))).cast("int")

    head = chars.withColumn("_h", shared(F.col("_a"), F.col("_b")))
    rest = head.withColumns({c: F.slice(c, F.col("_h") + 1, F.size(c) - F.col("_h")) for c in ("_a", "_b")})
    tail = rest.withColumn("_t", shared(F.reverse("_a"), F.reverse("_b")))
    core = tail.withColumns({c: F.slice(c, F.lit(1), F.size(c) - F.col("_t")) for c in ("_a", "_b")})

    def mask(c: Column, j: Column) -> Column:
        at = [F.when(F.get("_a", j + (k - edits)).eqNullSafe(c), 1 << k).otherwise(0) for k in range(band)]
        return sum(at[1:], at[0])

    # a generator, which filters are not pushed through: else the arrays would be made again for each character
    masks = core.withColumn("_m", F.transform("_b", mask)).select(*pairs.columns, F.explode(F.array(F.struct((F.size("_a") - F.size("_b") + edits).alias("at"), F.col("_m").alias("m")))).alias("_g"))
    start = F.struct(*[F.lit(((1 << (d + 1)) - 1) << edits).bitwiseAND(F.lit((1 << band) - 1)).alias(f"r{d}") for d in range(edits + 1)])

    def step(s: Column, m: Column) -> Column:
        now, out = s["r0"].bitwiseAND(m), []
        for d in range(edits + 1):
            if d:
                before = s[f"r{d - 1}"]
                now = s[f"r{d}"].bitwiseAND(m).bitwiseOR(before).bitwiseOR(F.shiftright(before, 1)).bitwiseOR(F.shiftleft(now, 1)).bitwiseAND(F.lit((1 << band) - 1))
            out.append(now.alias(f"r{d}"))
        return F.struct(*out)

    end = masks.where(F.col("_g.at").between(0, band - 1)).withColumn("_e", F.aggregate("_g.m", start, step))
    return end.where(F.expr(f"shiftright(_e.r{edits}, _g.at) & 1") == 1).select(*pairs.columns)


def near_lines(lines: DataFrame, copies: DataFrame, scratch: Scratch, edits: int = EDITS) -> DataFrame:
    """(id, id2) of the texts within `edits` edits of one that is first met earlier; copies: id, id2, n, first of each text."""
    copied = scratch.keep(copies.where("n > 1").select("id", "id2", "first"))
    unsure = likely(lines, copied, "id").join(copied, ["id", "id2"], "left").where("first is null or first = struct(doc_id, pos)")
    once = likely(lines, copied, "id", False).select("id", "line").union(unsure.select("id", "line"))
    of_key = Window.partitionBy("key")
    shared = _keyed(once, edits).select("key", "id", "own", F.min("id").over(of_key).alias("lo"), F.max("id").over(of_key).alias("hi")).where("lo < hi")
    shared = scratch.keep(shared.select("key", "id", "own").distinct())

    met = likely(lines, shared, "id").groupBy("id", "id2").agg(F.min(F.struct("doc_id", "pos")).alias("first"), F.min("line").alias("line"))
    met = scratch.keep(met.join(shared.select("id").distinct(), "id").select("id", "id2", "first", "line", F.char_length("line").alias("n"), _letters(F.col("line")).alias("letters")))
    rows = shared.join(met.select("id", F.struct("first", "id2", "n", "letters").alias("x")), "id").select("key", "own", "x")
    rows = scratch.keep(rows.withColumns({"lead": F.min("x").over(of_key), "own_lead": F.min(F.when(F.col("own"), F.col("x"))).over(of_key)}))

    def verified(pairs: DataFrame) -> DataFrame:
        """id2 of the later texts of pairs (a earlier, b later) that are near."""
        of_a, of_b = (met.select(F.col("id2").alias(c), F.col("line").alias(f"{c}_line")) for c in "ab")
        return scratch.keep(within_edits(pairs.select("a", "b").distinct().join(of_a, "a").join(of_b, "b"), "a_line", "b_line", edits).select(F.col("b").alias("id2")).distinct())

    # x has the segment as its own, so y isn't shorter
    near = f"y.n - x.n between 0 and {edits} and x.id2 <> y.id2 and {_letters_apart('x.letters', 'y.letters')} <= {2 * edits}"
    ends = "if(x.first < y.first, x.id2, y.id2) as a", "if(x.first < y.first, y.id2, x.id2) as b"
    with_own = rows.where("own_lead is not null").select(F.col("own_lead").alias("x"), F.col("x").alias("y"))
    with_any = rows.where("own").select("x", F.col("lead").alias("y"))
    gone = verified(with_own.union(with_any).where(near).selectExpr(*ends))

    stays = rows.join(gone.select(F.col("id2").alias("gone")), F.col("x.id2") == F.col("gone"), "left_anti")
    own, every = rows.where("own").select("key", "x"), rows.select("key", F.col("x").alias("y"))
    later_y = own.join(stays.select("key", F.col("x").alias("y")), "key").where(f"x.first < y.first and {near}")
    later_x = stays.where("own").select("key", "x").join(every, "key").where(f"y.first < x.first and {near}")
    gone = gone.union(verified(later_y.selectExpr(*ends).union(later_x.selectExpr(*ends))))
    return met.select("id", "id2").join(gone.distinct(), "id2").select("id", "id2")


def removed_lines(documents: DataFrame, edits: int = EDITS) -> DataFrame:
    """doc_id and the sorted numbers (from 0) of its lines that go, for documents that lose any."""
    scratch = Scratch(documents.sparkSession, "lines")
    lines = numbered(documents)
    marks = scratch.keep(lines.select("doc_id", "pos", "id", "id2"))
    copies = scratch.keep(marks.groupBy("id", "id2").agg(F.min(F.struct("doc_id", "pos")).alias("first"), F.count("*").alias("n")))
    near = near_lines(lines.where(F.char_length("line") >= LEAST), copies, scratch, edits).withColumn("near", F.lit(True))
    texts = scratch.keep(copies.join(near, ["id", "id2"], "left").where("n > 1 or near").select("id", "id2", "first", "near"))
    gone = marks.join(texts, ["id", "id2"]).where("near or first <> struct(doc_id, pos)").select("doc_id", "pos")
    return gone.groupBy("doc_id").agg(F.array_sort(F.collect_set("pos")).alias("gone"))


def line_dedup(documents: DataFrame, edits: int = EDITS) -> DataFrame:
    """The documents with all their columns, text without the lines that go; documents that lose all of their words go."""
    key, out_ = fresh(documents, "line_doc"), fresh(documents, "line_gone")
    lost = removed_lines(documents, edits).select(F.col("doc_id").alias(key), F.col("gone").alias(out_))
    none = F.col(out_).isNull()
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(out_, i)), "\n")
    out = documents.join(lost, F.col("doc_id") == F.col(key), "left").withColumn("text", F.when(none, F.col("text")).otherwise(kept)).where(none | F.col("text").rlike(WORD))
    if "n_chars" in documents.columns:
        out = out.withColumn("n_chars", F.when(none, F.col("n_chars")).otherwise(F.char_length("text").cast(documents.schema["n_chars"].dataType)))
    return out.select(*documents.columns)


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_lines (all lines), n_removed and removed_lines (numbers from 0, joined by commas) of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    gone = removed_lines(docs)
    counted = docs.select("doc_id", F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long").alias("n_lines"))
    return counted.join(gone, "doc_id", "left").select("doc_id", "n_lines", F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce(F.array_join("gone", ","), F.lit("")).alias("removed_lines"))


ORACLE = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
c AS (SELECT doc_id, pos, line FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
f AS (SELECT line, length(line) AS n, min(doc_id * 1000000 + pos) AS first FROM c GROUP BY line),
k AS (SELECT DISTINCT b.line FROM f a JOIN f b ON a.n >= 20 AND b.n >= 20 AND a.first < b.first AND a.n BETWEEN b.n - 2 AND b.n + 2 AND a.line <> b.line
      AND (left(a.line, 6) = left(b.line, 6) OR right(a.line, 6) = right(b.line, 6) OR substr(a.line, 8, 5) = substr(b.line, 8, 5)
           OR substr(a.line, 8, 5) = substr(b.line, 9, 5) OR substr(a.line, 9, 5) = substr(b.line, 8, 5) OR substr(a.line, 8, 5) = substr(b.line, 10, 5) OR substr(a.line, 10, 5) = substr(b.line, 8, 5))
      WHERE levenshtein(a.line, b.line) <= 2),
g AS (SELECT c.doc_id, c.pos FROM c JOIN f USING (line) LEFT JOIN k ON k.line = c.line WHERE k.line IS NOT NULL OR c.doc_id * 1000000 + c.pos <> f.first),
r AS (SELECT doc_id, count(*) AS n, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS s FROM g GROUP BY doc_id)
SELECT d.doc_id, CAST(CASE WHEN text IS NULL THEN 0 ELSE len(string_split(text, chr(10))) END AS BIGINT) AS n_lines,
       CAST(coalesce(r.n, 0) AS BIGINT) AS n_removed, coalesce(r.s, '') AS removed_lines
FROM documents d LEFT JOIN r USING (doc_id)
"""
