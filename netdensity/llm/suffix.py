"""Repeated substrings of a fixed width by blockwise suffix sorting with a difference cover.

Every byte that lies in a ``width``-byte string which starts at two places or more of the corpus is removed.

1. Keys. A window (the string at one start) has the least hash of the short strings in it as its key, so equal windows have equal keys.
   Consecutive windows with one key form a segment. Keys are packed into binary blocks by hash range and
   shuffled without text; a key that only one text has, and has once, cannot hold a repeated window.
2. Segments. The segments of repeated keys are cut from their texts, and shuffled in packed blocks by hash range of the key. A
   block is a suffix bucket in the large: all suffixes that may be equal meet in one.
3. Suffix arrays. In a block, equal segments are one with a weight. The suffixes of the others are sorted one bucket
   of leading bytes at a time. Ties beyond the first 24 bytes are resolved by ranks precomputed for the positions of a
   difference cover (1, 2, 4 modulo 7): any two suffixes have a shift below 7 that takes both into the
   cover, where their ranks compare all but the last bytes, which are compared directly. Only 3/7 of
   the positions have ranks, and a bucket holds BUCKET suffixes, which bounds the memory.
4. Each text gets the union of its repeated windows.

Whole copies of a text stand for one text in these steps; a text of ``width`` bytes or more that has a copy goes entirely. The
number of packed blocks grows with the input, so a block stays near BLOCK_BYTES. The driver sees two sums.

Defined results: a null text counts as empty; texts shorter than ``width`` stay; rows that share a doc_id are rows of
their own; overlapping repeats count; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netdensity.session import materialize

WIDTH = 200
#: Of shorter strings the cover does not order all.
LEAST_WIDTH = 31
#: Bytes of text that are hashed at once, suffixes in a bucket, bytes of a packed block.
PIECE, BUCKET, BLOCK_BYTES = 1 << 21, 1 << 16, 8 << 20
LONGEST = 60_000
PERIOD, COVER = 7, (1, 2, 4)
KEYS = np.dtype([("key", "<u8"), ("th", "<i8"), ("n", "<i4"), ("start", "<i4"), ("run", "<u2"), ("multi", "u1")])
CUT = np.dtype([("key", "<u8"), ("start", "<i4"), ("run", "<u2")])
SEGMENT = np.dtype([("key", "<u8"), ("th", "<i8"), ("n", "<i4"), ("start", "<i4"), ("run", "<u2")])


def spread(width: int) -> int:
    """How many short strings a window has: a power of two, about two thirds of the width."""
    return 1 << max(0, (2 * width // 3).bit_length() - 1)


@lru_cache(maxsize=1)
def powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random value a byte, and the powers of an odd base modulo 2^64 with their inverses."""
    base = 0x9E3779B97F4A7C15
    up = np.full(n, base, np.uint64)
    up[0] = 1
    down = np.full(n, pow(base, -1, 1 << 64), np.uint64)
    down[0] = 1
    return np.random.default_rng(200).integers(0, 2**63, 256, dtype=np.uint64), np.cumprod(up), np.cumprod(down)


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k-byte string."""
    value, up, down = powers(PIECE + LONGEST + 4096)
    s = np.empty(len(data) + 1, np.uint64)
    s[0] = 0
    np.cumsum(value[data] * up[: len(data)], out=s[1:])
    h = (s[k:] - s[:-k]) * down[: len(s) - k]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def segments(data: np.ndarray, lengths: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """(document, start in data, run, key, multi) of the runs of windows with one key; windows never cross documents."""
    w = spread(width)
    if len(data) < width:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    h = gram_hashes(data, width - w + 1)
    m = h
    step = 1
    while step < w:
        m = np.minimum(m[:-step], m[step:])
        step *= 2
    doc = np.repeat(np.arange(len(lengths)), lengths)[: len(m)]
    at = np.flatnonzero(np.arange(width, width + len(m)) <= np.cumsum(lengths)[doc])
    if not len(at):
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    key = m[at]
    new = np.append(True, (np.diff(at) != 1) | (key[1:] != key[:-1]) | (doc[at[1:]] != doc[at[:-1]]))
    first = np.flatnonzero(new)
    run = np.diff(np.append(first, len(at)))
    start, key = at[first], key[first]
    # How often the key's string occurs in the segment: in its first window, and entering with later ones.
    views = np.lib.stride_tricks.sliding_window_view(h, w)
    seen = np.concatenate([(views[start[a : a + 8192]] == key[a : a + 8192, None]).sum(1) for a in range(0, len(start), 8192)])
    enters = np.append(0, np.cumsum(h[w - 1 :] == m[: len(h) - w + 1]))
    seen = seen + enters[start + run] - enters[start + 1]
    return doc[start], start, run, key, seen > 1


def pieces(texts: list[bytes], width: int) -> Iterator[tuple[np.ndarray, list[int], list[int], list[int]]]:
    """Texts joined up to about PIECE bytes: (bytes, text numbers, offsets in their texts, lengths); long texts are cut with an overlap."""
    joined, which, offset, size = [], [], [], 0
    for k, t in enumerate(texts):
        for o in range(0, max(1, len(t) - width + 1), PIECE // 2):
            part = t[o : o + PIECE // 2 + width - 1]
            joined.append(part)
            which.append(k)
            offset.append(o)
            size += len(part)
            if size >= PIECE // 2:
                yield np.frombuffer(b"".join(joined), np.uint8), which, offset, [len(x) for x in joined]
                joined, which, offset, size = [], [], [], 0
    if joined:
        yield np.frombuffer(b"".join(joined), np.uint8), which, offset, [len(x) for x in joined]


def packed(blocks: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Rows grouped by block number."""
    order = np.argsort(blocks, kind="stable")
    b = blocks[order]
    cut = np.append(np.flatnonzero(np.append(True, b[1:] != b[:-1])), len(b))
    for a, z in zip(cut[:-1], cut[1:]):
        yield int(b[a]), rows[order[a:z]].tobytes()


def block_of(key: np.ndarray, blocks: int) -> np.ndarray:
    """Hash range of keys. Keys are minima, and so small; they are mixed first."""
    return ((key * np.uint64(0xA0761D6478BD642F)) >> np.uint64(33)).astype(np.int64) % blocks


def batch_of(rows: list[tuple], names: str, kinds: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True)], names.split())


def list_keys(batches: Iterator[pa.RecordBatch], width: int, blocks: int) -> Iterator[pa.RecordBatch]:
    """(th, n, t) to packed key rows by block."""
    for b in batches:
        th, n, texts = b.column(0).to_numpy(), b.column(1).to_numpy(), [x.encode() for x in b.column(2).to_pylist()]
        out = []
        for data, which, offset, lengths in pieces(texts, width):
            doc, start, run, key, multi = segments(data, np.array(lengths), width)
            base = np.cumsum(lengths) - lengths
            which, offset = np.array(which), np.array(offset)
            start = start - base[doc] + offset[doc]
            while len(run):
                rows = np.zeros(len(run), KEYS)
                rows["key"], rows["th"], rows["n"], rows["start"], rows["run"], rows["multi"] = key, th[which[doc]], n[which[doc]], start, np.minimum(run, LONGEST), multi
                out.append(rows)
                more = run > LONGEST
                doc, start, run, key, multi = doc[more], start[more] + LONGEST, run[more] - LONGEST, key[more], multi[more]
        if out and len(rows := np.concatenate(out)):
            yield batch_of(list(packed(block_of(rows["key"], blocks), rows)), "block payload", [pa.int32(), pa.binary()])


def whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[bytes]]:
    """The payloads of one block after the other, from rows sorted by block."""
    now, held = None, []
    for b in batches:
        for block, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if block != now and held:
                yield held
                held = []
            now = block
            held.append(payload)
    if held:
        yield held


def by_text(rows: np.ndarray, fields: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """(th, n, bytes of the text's fields) from rows with th and n."""
    order = np.lexsort((rows["start"], rows["n"], rows["th"]))
    th, n = rows["th"][order], rows["n"][order]
    cut = np.append(np.flatnonzero(np.append(True, (th[1:] != th[:-1]) | (n[1:] != n[:-1]))), len(order))
    for a, z in zip(cut[:-1], cut[1:]):
        yield int(th[a]), int(n[a]), fields[order[a:z]].tobytes()


def repeated_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed key rows to (th, n, cuts, size): the segments whose key two texts have, or one text twice."""
    for payloads in whole_blocks(batches):
        rows = np.concatenate([np.frombuffer(p, KEYS) for p in payloads])
        order = np.lexsort((rows["n"], rows["th"], rows["key"]))
        k, th, n = rows["key"][order], rows["th"][order], rows["n"][order]
        new_key = np.append(True, k[1:] != k[:-1])
        new_text = np.append(True, (k[1:] != k[:-1]) | (th[1:] != th[:-1]) | (n[1:] != n[:-1]))
        group = np.cumsum(new_key) - 1
        # A text that has the key in two segments counts twice; whole copies have equal th, n and start.
        start = rows["start"][order]
        lowest = np.full(int(group[-1]) + 1, np.iinfo(np.int64).max)
        np.minimum.at(lowest, group, start)
        highest = np.full(int(group[-1]) + 1, -1)
        np.maximum.at(highest, group, start)
        texts = np.bincount(group, new_text)
        often = (texts > 1) | (highest > lowest) | (np.bincount(group, rows["multi"][order]) > 0)
        kept = rows[order[often[group]]]
        if not len(kept):
            continue
        cuts = np.zeros(len(kept), CUT)
        for f in CUT.names:
            cuts[f] = kept[f]
        out = [(th, n, np.unique(np.frombuffer(c, CUT)).tobytes()) for th, n, c in by_text(kept, cuts)]
        yield batch_of([(*r, len(r[2]) // CUT.itemsize) for r in out], "th n cuts size", [pa.int64(), pa.int32(), pa.binary(), pa.int64()])


def cut_segments(batches: Iterator[pa.RecordBatch], width: int, blocks: int) -> Iterator[pa.RecordBatch]:
    """(th, n, t, list of cuts) to packed segments, with their bytes, by block."""
    for b in batches:
        metas, bodies, size = [], [], 0

        def record() -> pa.RecordBatch:
            rows = np.concatenate(metas)
            at = block_of(rows["key"], blocks)
            out = []
            for block in np.unique(at):
                own = np.flatnonzero(at == block)
                out.append((int(block), len(own).to_bytes(8, "little") + rows[own].tobytes() + b"".join([bodies[k] for k in own])))
            return batch_of(out, "block payload", [pa.int32(), pa.binary()])

        for th, n, t, cuts in zip(*(c.to_pylist() for c in b.columns), strict=True):
            raw = t.encode()
            c = np.unique(np.concatenate([np.frombuffer(x, CUT) for x in cuts]))
            rows = np.zeros(len(c), SEGMENT)
            for f in CUT.names:
                rows[f] = c[f]
            rows["th"], rows["n"] = th, n
            metas.append(rows)
            more = [raw[s : s + r + width - 1] for s, r in zip(c["start"].tolist(), c["run"].tolist())]
            bodies += more
            size += sum(map(len, more))
            if size > BLOCK_BYTES:
                yield record()
                metas, bodies, size = [], [], 0
        if metas:
            yield record()


def word_at(text: np.ndarray, at: np.ndarray, n: int = 8) -> np.ndarray:
    """The n bytes at each place as a number whose order is theirs."""
    out = np.zeros(len(at), np.uint64)
    for k in range(n):
        out = (out << np.uint64(8)) | text[at + k]
    return out


def dense(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Ranks of the pairs (a, b), equal ones alike."""
    by = np.lexsort((b, a))
    new = np.append(False, (a[by][1:] != a[by][:-1]) | (b[by][1:] != b[by][:-1]))
    out = np.empty(len(a), np.int64)
    out[by] = np.cumsum(new)
    return out


def cover_ranks(text: np.ndarray, depth: int) -> np.ndarray:
    """Ranks, by their first ``depth`` bytes (a multiple of 7), of the suffixes at the positions of the difference cover.

    Places are in order of position, three a period. Doubling shifts by whole periods, so it stays within the cover."""
    periods = len(text) // PERIOD + 1
    padded = np.append(text, np.zeros(depth + 2 * PERIOD + 16, np.uint8))
    at = (np.arange(periods)[:, None] * PERIOD + np.array(COVER)).ravel()
    rank = np.unique(word_at(padded, at, PERIOD), return_inverse=True)[1].astype(np.uint64)

    def paired(r: np.ndarray, shift: int) -> np.ndarray:
        later = np.append(r[shift:] + np.uint64(1), np.zeros(min(shift, len(r)), np.uint64))
        return np.unique((r << np.uint64(32)) | later, return_inverse=True)[1].astype(np.uint64)

    have = PERIOD
    while 2 * have <= depth:
        rank = paired(rank, have // PERIOD * 3)
        have *= 2
    return rank if have == depth else paired(rank, (depth - have) // PERIOD * 3)


#: For residues a and b, the least shift that takes both into the cover; for a residue in it, its place in the period.
SHIFT = np.array([[next(k for k in range(PERIOD) if (a + k) % PERIOD in COVER and (b + k) % PERIOD in COVER) for b in range(PERIOD)] for a in range(PERIOD)])
PLACE = np.array([COVER.index(r) if r in COVER else -1 for r in range(PERIOD)])


def sorted_suffixes(text: np.ndarray, starts: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The suffixes at ``starts`` in order of their first ``width`` bytes, one bucket at a time, with whether each equals its predecessor.

    Every suffix has ``width`` bytes of text; equal ones stay in order of position. ``width`` is 31 at least."""
    depth = PERIOD * ((width - PERIOD + 1) // PERIOD)
    rank = cover_ranks(text, depth)
    padded = np.append(text, np.zeros(16, np.uint8))
    lead = word_at(padded, starts)
    order = np.argsort(lead, kind="stable")
    lead = lead[order]
    edge = np.append(np.flatnonzero(np.append(True, lead[1:] != lead[:-1])), len(lead))
    lo = 0
    while lo < len(starts):
        # A bucket ends where the leading bytes change, after BUCKET suffixes if it can.
        hi = int(edge[max(np.searchsorted(edge, lo + BUCKET, "right") - 1, np.searchsorted(edge, lo, "right"))])
        at = np.sort(starts[order[lo:hi]])
        heads = [word_at(padded, at + k) for k in (0, 8, 16)]
        by = np.lexsort(heads[::-1])
        at, heads = at[by], [x[by] for x in heads]
        tie = np.append(True, np.logical_or.reduce([x[1:] != x[:-1] for x in heads]))
        group = np.cumsum(tie) - 1
        size = np.bincount(group)
        first = np.cumsum(size) - size
        place = first[group].astype(np.int64)
        long = np.flatnonzero(size[group] > 1)
        if len(long):
            p, g = at[long], group[long].astype(np.uint64)
            tail = dense(word_at(padded, p + depth), word_at(padded, p + width - 8))
            residue = p % PERIOD
            before = np.zeros(len(p), np.int64)

            def keys(of: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray]:
                q = p[of] + shift
                r = rank[q // PERIOD * 3 + PLACE[q % PERIOD]]
                return (g[of] << np.uint64(32)) | r, tail[of]

            members = [np.flatnonzero(residue == r) for r in range(PERIOD)]
            for a in range(PERIOD):
                for b in range(a, PERIOD):
                    x, y = members[a], members[b]
                    if not len(x) or not len(y):
                        continue
                    both = x if a == b else np.concatenate([x, y])
                    k, t = keys(both, SHIFT[a, b])
                    o = np.lexsort((p[both], t, k))
                    # How many of the other residue, in the same tie, stand before each: running counts less those of earlier ties.
                    of_b = (o >= len(x)) if a != b else np.ones(len(o), bool)
                    tied = g[both[o]]
                    start = np.flatnonzero(np.append(True, tied[1:] != tied[:-1]))
                    run = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(o))))
                    for side in (True, False) if a != b else (True,):
                        count = np.cumsum(of_b == side) - (of_b == side)
                        less = count - count[start][run]
                        take = (of_b != side) if a != b else of_b
                        before[both[o[take]]] += less[take]
            place[long] += before
        out = np.empty_like(at)
        out[place] = at
        same = np.zeros(len(out), bool)
        if len(long):
            grouped = np.empty_like(group)
            grouped[place] = group
            near = np.flatnonzero((grouped[1:] == grouped[:-1])) + 1
            x, y = out[near - 1], out[near]
            s = SHIFT[x % PERIOD, y % PERIOD]
            rx, ry = x + s, y + s
            eq = rank[rx // PERIOD * 3 + PLACE[rx % PERIOD]] == rank[ry // PERIOD * 3 + PLACE[ry % PERIOD]]
            for k in range(PERIOD - 1):
                eq &= padded[x + k] == padded[y + k]
            for k in range(depth, width):
                eq &= padded[x + k] == padded[y + k]
            same[near] = eq
        yield out, same
        lo = hi


def repeated_windows(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Packed segments to (th, n, spans): the byte ranges of each text that repeated windows cover in a block."""
    for payloads in whole_blocks(batches):
        metas, bodies = [], []
        for p in payloads:
            count = int.from_bytes(p[:8], "little")
            rows = np.frombuffer(p, SEGMENT, count, 8)
            metas.append(rows)
            at = 8 + rows.nbytes + np.append(0, np.cumsum(rows["run"].astype(np.int64) + width - 1))
            bodies += [p[a:z] for a, z in zip(at[:-1].tolist(), at[1:].tolist())]
        rows = np.concatenate(metas)
        del payloads
        digest = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, bodies)), "V16")
        _, one, which, weight = np.unique(digest, return_index=True, return_inverse=True, return_counts=True)
        # Where every text of a key has its segment repeated whole, nothing is left to sort.
        _, key_of = np.unique(rows["key"], return_inverse=True)
        single = np.bincount(key_of, weight[which] == 1) > 0
        distinct = np.flatnonzero(single[key_of[one]])
        run = rows["run"][one].astype(np.int64)
        hit = {}
        if len(distinct):
            text = np.frombuffer(b"".join([bodies[one[d]] for d in distinct]), np.uint8)
            size = run[distinct] + width - 1
            base = np.cumsum(size) - size
            n = run[distinct]
            first = np.cumsum(n) - n
            starts = np.repeat(base - first, n) + np.arange(int(n.sum()))
            found = np.zeros(len(text), bool)
            for out, same in sorted_suffixes(text, starts, width):
                found[out[same]] = True
                found[out[:-1][same[1:]]] = True
            hit = {int(d): found[b : b + r] for d, b, r in zip(distinct, base, n)}
        del bodies
        spans = []
        for k, d in enumerate(which.tolist()):
            s, r = int(rows["start"][k]), int(rows["run"][k])
            if weight[d] > 1:
                spans.append((k, s, s + r + width - 1))
            elif d in hit and hit[d].any():
                at = np.flatnonzero(hit[d])
                cut = np.flatnonzero(np.diff(at) > width)
                a, z = at[np.append(0, cut + 1)], at[np.append(cut, len(at) - 1)]
                spans += [(k, s + int(x), s + int(y) + width) for x, y in zip(a, z)]
        if not spans:
            continue
        k, a, z = np.array(spans).T
        out = np.zeros(len(k), np.dtype([("th", "<i8"), ("n", "<i4"), ("start", "<i4")]))
        out["th"], out["n"], out["start"] = rows["th"][k], rows["n"][k], a
        pairs = np.stack([a, z], 1).astype("<i4").view("V8").ravel()
        yield batch_of(list(by_text(out, pairs)), "th n spans", [pa.int64(), pa.int32(), pa.binary()])


def union_of(spans: list[bytes]) -> np.ndarray:
    """Disjoint, sorted ranges [a, z) that the packed ranges cover; touching ones are one."""
    x = np.frombuffer(b"".join(spans), "<i4").reshape(-1, 2)
    x = x[np.argsort(x[:, 0], kind="stable")]
    top = np.maximum.accumulate(x[:, 1])
    new = np.append(True, x[1:, 0] > top[:-1])
    return np.stack([x[new, 0], top[np.append(np.flatnonzero(new)[1:] - 1, len(x) - 1)]], 1)


def dedup_substrings(docs: DataFrame, doc_id="doc_id", text="text", width: int = WIDTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and kept (bytes), for every row."""
    if width < LEAST_WIDTH:
        raise ValueError(f"the suffix sort needs strings of {LEAST_WIDTH} bytes or more")
    spark = docs.sparkSession
    t = F.coalesce(F.col(text), F.lit(""))
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(t).alias("th"), F.octet_length(t).alias("n"), t.alias("t"))
    slim = materialize(source.select("doc_id", "th", "n"))
    texts = materialize(slim.groupBy("th", "n").agg(F.count("*").alias("copies"), F.min("doc_id").alias("rep")))
    total = slim.agg(F.coalesce(F.sum(F.col("n").cast("long")), F.lit(0)).alias("s")).first()["s"]
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(4 * partitions, total // (2 * BLOCK_BYTES))

    listed = source.where(F.col("n") >= width).select("th", "n", "t").mapInArrow(lambda it: list_keys(it, width, blocks), "block int, payload binary")
    cuts = listed.repartition("block").sortWithinPartitions("block").mapInArrow(repeated_keys, "th long, n int, cuts binary, size long")
    cuts = materialize(cuts)
    bytes_out = cuts.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("s")).first()["s"] * (width + spread(width) // 2)
    blocks2 = max(4 * partitions, bytes_out // BLOCK_BYTES)
    # One text for each set of whole copies: the representative's.
    per_text = cuts.groupBy("th", "n").agg(F.collect_list("cuts").alias("cuts")).join(texts.select("th", "n", "rep"), ["th", "n"])
    holding = source.alias("s").join(per_text.alias("c"), F.col("s.doc_id").eqNullSafe(F.col("c.rep")) & (F.col("s.th") == F.col("c.th")) & (F.col("s.n") == F.col("c.n"))).select("s.th", "s.n", "t", "cuts")
    cut = holding.mapInArrow(lambda it: cut_segments(it, width, blocks2), "block int, payload binary")
    spans = cut.repartition("block").sortWithinPartitions("block").mapInArrow(lambda it: repeated_windows(it, width), "th long, n int, spans binary")
    covered = spans.groupBy("th", "n").agg(F.collect_list("spans").alias("spans"))
    once = covered.join(texts.where("copies = 1"), ["th", "n"]).select(F.col("rep").alias("doc_id"), "th", "n", F.lit(False).alias("whole"), "spans")
    twice = slim.join(texts.where((F.col("copies") > 1) & (F.col("n") >= width)), ["th", "n"]).select("doc_id", "th", "n").distinct().select("doc_id", "th", "n", F.lit(True).alias("whole"), F.lit(None).cast("array<binary>").alias("spans"))
    info = materialize(once.union(twice))

    @F.pandas_udf("removed long, count long, kept binary")
    def remove(t: pd.Series, spans: pd.Series) -> pd.DataFrame:
        out = []
        for x, s in zip(t, spans):
            if s is None or not len(s):
                out.append((0, 0, None))
                continue
            raw, u = x.encode(), union_of(list(s))
            ends = [0, *u.ravel().tolist(), len(raw)]
            out.append((int((u[:, 1] - u[:, 0]).sum()), len(u), b"".join(raw[a:z] for a, z in zip(ends[::2], ends[1::2]))))
        return pd.DataFrame(out, columns=["removed", "count", "kept"])

    joined = source.alias("s").join(info.alias("i"), F.col("s.doc_id").eqNullSafe(F.col("i.doc_id")) & (F.col("s.th") == F.col("i.th")) & (F.col("s.n") == F.col("i.n")), "left").select("s.doc_id", "s.n", "s.t", "whole", "spans")
    cleaned = joined.withColumn("r", remove(F.when(F.col("spans").isNotNull(), F.col("t")), "spans"))
    whole, some = F.coalesce("whole", F.lit(False)), F.col("spans").isNotNull()
    kept = F.when(whole, F.lit(b"")).when(some, F.col("r.kept")).otherwise(F.col("t").cast("binary"))
    return cleaned.select(
        "doc_id", F.col("n").cast("long").alias("n_bytes"),
        F.when(whole, F.col("n")).when(some, F.col("r.removed")).otherwise(0).cast("long").alias("n_removed"),
        F.when(whole, 1).when(some, F.col("r.count")).otherwise(0).cast("long").alias("n_spans"),
        F.sha2(kept, 256).alias("kept_sha256"), kept.alias("kept"),
    )


def naive(texts: list[str | None], width: int) -> list[tuple[int, int, int, str]]:
    """Plain version for tests: n_bytes, n_removed, n_spans, sha256 by counting every window."""
    raws = [(t or "").encode() for t in texts]
    seen: dict[bytes, int] = {}
    for r in raws:
        for i in range(len(r) - width + 1):
            w = r[i : i + width]
            seen[w] = seen.get(w, 0) + 1
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - width + 1):
            if seen[r[i : i + width]] > 1:
                gone[i : i + width] = b"\x01" * width
        keep = bytes(c for c, g in zip(r, gone) if not g)
        out.append((len(r), sum(gone), sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(keep).hexdigest()))
    return out
