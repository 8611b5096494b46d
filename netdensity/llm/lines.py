"""Line dedup by pairwise alignment of documents that share rare lines.

A line counts as evidence if it has five words or more. Its hash leads to the documents that hold
it; the earliest holder (least doc_id) is the partner of all later ones. A line held by many
documents thus gives one pair for each, never all pairs, and no line is too frequent to count. Lines that this leaves over
meet their other earlier holders, as many as it takes to match each place with one, until none is left or no holder is.
What a pair has in common is aligned by patience diff: lines that either side holds once are matched,
a longest increasing run of them is kept, gaps are aligned in turn, and lines that repeat are matched
by occurrence where no single ones are left. The aligned lines are deleted from the later
document, along with the short lines just before and after them that align as well. A text that
an earlier document has as a whole is deleted as a whole, short lines included.

Rows carry line hashes, never texts; a pair's rows together are no more than the later document's lines.

Defined results: a null text counts as empty and comes back as it was; rows without a doc_id are left alone; rows
that share a doc_id are not compared with each other; a repeat of a line within its own document
stays; a very long text is aligned whole; an empty table gives no rows;
other columns, whatever their names, pass through, but for __n_lines and __n_removed, which are replaced.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netdensity.llm.common import WORD, free, let
from netdensity.session import fewer, materialize

MIN_WORDS = 5
RUNS = "pre_at array<int>, pre array<long>, post_at array<int>, post array<long>"
LINES = f"d long, th long, pos int, start int, next int, h long, {RUNS}"



def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def split_lines(text: str, min_words: int) -> list[tuple]:
    """(line, line after the previous line of evidence, line of the next one, hash, then the places and hashes of the short lines before and after) of each line of evidence."""
    out: list[list] = []
    short: tuple[list[int], list[int]] = ([], [])
    start = 0
    rows = text.encode().split(b"\n")
    for pos, row in enumerate(rows):
        words = row.split()
        if len(words) >= min_words:
            out.append([pos, start, len(rows), signed(xxhash.xxh64_intdigest(row.strip(b" \t\n\x0b\x0c\r"), 42)), *short, [], []])
            if len(out) > 1:
                out[-2][2], out[-2][6:] = pos, short
            short, start = ([], []), pos + 1
        elif words:
            short[0].append(pos)
            short[1].append(signed(xxhash.xxh64_intdigest(b" ".join(words), 42)))
    if out:
        out[-1][6:] = short
    return [tuple(x) for x in out]


def shared_run(mine: list[int], at: list[int], theirs: list[int], a: int, z: int) -> list[tuple[int, int]]:
    """Ranges of the lines a to z that go with an aligned line: all of them where the short lines agree, else the aligned ones."""
    if mine == theirs:
        return [(a, z)] if a < z else []
    return [(at[i], at[i] + 1) for i, _ in patience(mine, theirs)] if mine and theirs else []


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest run of (a, b), given in order of a, in which b rises too."""
    tops: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for k, (_, b) in enumerate(pairs):
        p = bisect_left(tops, b)
        tops[p : p + 1] = [b]
        at[p : p + 1] = [k]
        back.append(at[p - 1] if p else -1)
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Index pairs of the lines of a and b that patience diff aligns, in order."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        na, nb = Counter(a[a0:a1]), Counter(b[b0:b1])
        where = {b[j]: j for j in range(b0, b1) if nb[b[j]] == 1}
        once = [(i, where[a[i]]) for i in range(a0, a1) if na[a[i]] == 1 and a[i] in where]
        if once:
            kept = increasing(once)
            ends = [(a0 - 1, b0 - 1), *kept, (a1, b1)]
            todo += [(p + 1, r, q + 1, s) for (p, q), (r, s) in zip(ends, ends[1:])]
            out += kept
        else:
            seen: Counter = Counter()
            place = {}
            for j in range(b0, b1):
                place[b[j], seen[b[j]]] = j
                seen[b[j]] += 1
            seen.clear()
            same = []
            for i in range(a0, a1):
                key = a[i], seen[a[i]]
                seen[a[i]] += 1
                if key in place:
                    same.append((i, place[key]))
            out += increasing(same)
    return sorted(out)


def deletions(docs: DataFrame, doc_id="doc_id", text="text", min_words: int = MIN_WORDS) -> DataFrame:
    """(d, th, gone): line ranges to delete from the document d whose text has hash th, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for d, th, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows += [(d, th, *x) for x in split_lines(t, min_words)]
            if rows:
                runs = [pa.list_(pa.int32()), pa.list_(pa.int64())] * 2
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), *runs]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True)], ["d", "th", "pos", "start", "next", "h", "pre_at", "pre", "post_at", "post"])

    source = docs.select(F.col(doc_id).cast("long").alias("d"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("th"), F.coalesce(F.col(text), F.lit("")).alias("t")).where("d is not null")
    # One row for each line of a document with its places, in order, then the earliest holder of each line: a hot line is
    # summed up in each task before the shuffle, and the join that follows can be split.
    place = F.struct("pos", "start", "next", "pre_at", "pre", "post_at", "post")
    held = materialize(fewer(source.mapInArrow(run, LINES).groupBy("h", "d", "th").agg(F.sort_array(F.collect_set(place)).alias("mine")), docs))
    seen = F.transform("mine", lambda m: F.struct(m["pos"].alias("pos"), m["pre"].alias("pre"), m["post"].alias("post")))

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From pairs, the lines that align (h, pos) and with each the ranges that go (a, z)."""
        for b in batches:
            rows = []
            for d, th, own in zip(*(c.to_pylist() for c in b.columns), strict=True):
                mine = sorted(((y["pos"], x["h"], y) for x in own for y in x["mine"]), key=lambda y: y[0])
                theirs = sorted(((y["pos"], x["h"], y) for x in own for y in x["at"]), key=lambda y: y[0])
                for i, j in patience([x[1] for x in mine], [y[1] for y in theirs]):
                    pos, h, x = mine[i]
                    y = theirs[j][2]
                    rows.append((d, th, h, pos, pos, pos + 1))
                    ranges = shared_run(x["pre"], x["pre_at"], y["pre"], x["start"], pos) if x["pre"] else []
                    ranges += shared_run(x["post"], x["post_at"], y["post"], pos + 1, x["next"])
                    rows += [(d, th, h, pos, *r) for r in ranges]
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True)], ["d", "th", "h", "pos", "a", "z"])

    def aligned(met: DataFrame) -> DataFrame:
        """From rows (h, d, th, o, mine, at): lines of d and the partner's lines."""
        pairs = met.groupBy("d", "th", "o").agg(F.collect_list(F.struct("h", "mine", "at")).alias("own"))
        return materialize(fewer(pairs.select("d", "th", "own"), docs).mapInArrow(align, "d long, th long, h long, pos int, a int, z int"))

    first = held.groupBy("h").agg(F.min(F.struct("d", seen.alias("at"))).alias("m"), F.max("d").alias("z"))
    holders = materialize(fewer(first.where("m.d < z").select("h", F.col("m.d").alias("o"), F.col("m.at").alias("at")), docs))
    later = held.join(holders, "h").where("d > o")
    gone = aligned(later.select("h", "d", "th", "o", "mine", "at"))
    found = gone
    # What is left over meets the other earlier holders, from the second on, as many of them as it takes to match its
    # places one by one; what does not align there, for order, meets the holders after those.
    left = later.select("h", "d", "th", "mine", F.lit(1).alias("used"))
    ranked = None
    while True:
        went = found.groupBy("h", "d", "th").agg(F.collect_set("pos").alias("went"))
        left = left.join(went, ["h", "d", "th"], "left").withColumn("mine", F.when(F.col("went").isNull(), F.col("mine")).otherwise(F.filter("mine", lambda m: ~F.array_contains("went", m["pos"]))))
        left = materialize(fewer(left.where("size(mine) > 0").drop("went"), docs))
        if not left.limit(1).count():
            break
        if ranked is None:
            # The holders of the lines that are left over, numbered in order; upto counts their places before and with them.
            near = held.join(left.select("h").distinct(), "h", "left_semi").groupBy("h", "d").agg(F.max_by(F.col("mine"), F.size("mine")).alias("mine"))
            order = Window.partitionBy("h").orderBy("d")
            counted = near.select("h", "d", F.size("mine").alias("n")).withColumn("nth", F.row_number().over(order)).withColumn("upto", F.sum("n").over(order))
            ranked = materialize(fewer(near.join(counted, ["h", "d"]).select("h", F.col("d").alias("o"), "nth", "upto", "n", seen.alias("at")), docs))
        base = left.join(ranked.select("h", F.col("nth").alias("used"), F.col("upto").alias("base")), ["h", "used"])
        # Each place left over meets the holder's place of its number: one row for one row.
        wanted = base.select("h", "d", "th", "base", F.posexplode("mine").alias("i", "m")).withColumn("p", F.col("base") + F.col("i"))
        slots = ranked.select("h", "o", "nth", F.explode(F.sequence(F.col("upto") - F.col("n"), F.col("upto") - 1)).alias("p"))
        hit = wanted.join(slots, ["h", "p"]).where("o < d").groupBy("h", "d", "th", "o", "nth").agg(F.sort_array(F.collect_list("m")).alias("mine"))
        met = materialize(fewer(hit.join(ranked.select("h", "o", "at"), ["h", "o"]).select("h", "d", "th", "o", "nth", "mine", "at"), docs))
        if not met.limit(1).count():
            break
        found = aligned(met.select("h", "d", "th", "o", "mine", "at"))
        gone = gone.union(found)
        reached = met.groupBy("h", "d", "th").agg(F.max("nth").alias("used"))
        left = left.drop("used").join(reached, ["h", "d", "th"])
    # A whole text that an earlier document has goes whatever its lines are.
    worded = source.where(F.regexp_count("t", F.lit(WORD)) > 0).select("d", "th", F.size(F.split("t", "\n", -1)).alias("z")).distinct()
    least = worded.groupBy("th").agg(F.min("d").alias("o"))
    whole = worded.join(least, "th").where("d > o").select("d", "th", F.lit(0).alias("a"), "z")
    ranges = gone.select("d", "th", "a", "z").union(whole).groupBy("d", "th").agg(F.sort_array(F.collect_set(F.struct("a", "z"))).alias("r"))
    return ranges.select("d", "th", merged(F.col("r")).alias("gone"))


def merged(ranges):
    """Sorted ranges with those that meet made one."""
    start = F.array().cast("array<struct<a:int,z:int>>")

    def add(state, r):
        joins = state["open"]["z"] >= r["a"]
        both = F.struct(state["open"]["a"].alias("a"), F.greatest(state["open"]["z"], r["z"]).alias("z"))
        return F.struct(F.when(joins, state["done"]).otherwise(F.concat(state["done"], F.array(state["open"]))).alias("done"), F.when(joins, both).otherwise(F.struct(r["a"].alias("a"), r["z"].alias("z"))).alias("open"))

    first = F.struct(ranges[0]["a"].alias("a"), ranges[0]["z"].alias("z"))
    return F.aggregate(ranges, F.struct(start.alias("done"), first.alias("open")), add, lambda s: F.concat(s["done"], F.array(s["open"])))


def dedup_lines(docs: DataFrame, doc_id="doc_id", text="text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the text cleaned, and __n_lines, __n_removed: lines before, and lines deleted; columns of these two names are replaced."""
    d, th, gone = free(docs, "d", "th", "gone")
    ranges = deletions(docs, doc_id, text, min_words).select(F.col("d").alias(d), F.col("th").alias(th), F.col("gone").alias(gone))
    keyed = docs.withColumn(d, F.col(doc_id).cast("long")).withColumn(th, F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    joined = keyed.join(ranges, [d, th], "left")
    lines = F.split(F.col(text), "\n", -1)

    def kept(all_lines, ranges):
        # What lies between the deleted ranges, as slices, so the work is linear in lines and ranges.
        starts = F.concat(F.array(F.lit(0)), F.transform(ranges, lambda r: r["z"]))
        ends = F.concat(F.transform(ranges, lambda r: r["a"]), F.array(F.size(all_lines)))
        return let(F.arrays_zip(starts.alias("s"), ends.alias("e")), lambda z: F.array_join(F.flatten(F.transform(z, lambda p: F.slice(all_lines, p["s"] + 1, p["e"] - p["s"]))), "\n"))

    removed = F.coalesce(F.aggregate(gone, F.lit(0), lambda n, r: n + r["z"] - r["a"]), F.lit(0)).cast("long")
    return (
        joined.withColumn("__n_lines", F.coalesce(F.size(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)), F.lit(0)).cast("long"))
        .withColumn("__n_removed", removed)
        .withColumn(text, F.when(F.col(gone).isNull(), F.col(text)).otherwise(let(lines, lambda ls: kept(ls, F.col(gone)))))
        .drop(d, th, gone)
    )
