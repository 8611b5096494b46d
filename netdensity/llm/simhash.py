"""SimHash near-duplicates through a byte-position inverted index with count filtering.

A fingerprint has eight bytes. Where two fingerprints differ in at most four bits, at most four bytes
differ, so at least four of the eight positional bytes agree: four is the guaranteed number
of matches. The index therefore lists fingerprints under every set of four (position, byte) entries, 70
a fingerprint; a pair shares such a list exactly if its tally of shared positional bytes is four or
more. In a list the tally of each pair is taken from the equal bytes, the pair is kept only in the
first list that its equal bytes name, and it is verified by its differing bits.

Equal fingerprints are one entry, so a text copied any number of times costs one. Within a list only
a spanning set of the verified links leaves the task: lists of up to PAIRED entries are compared
pairwise in numpy; longer ones, up to HELD, meet through the values within two bit flips of each
entry (two values differ in at most four bits exactly if they share one; for fewer bits, half as many flips), in time linear in the list; a list
beyond HELD is not held at all, and its flips are grouped by Spark. No entry is left out in any case.

Similar texts differ in more bits than an index of eight bytes can guarantee, so ``near_pairs`` takes fewer matches and
more bits: it gives pairs to check, and guarantees none beyond 8 - matches bits.

Defined results: a null or blank text has fingerprint zero, which links like any other; fewer
than four words give one shingle; null doc_ids take part but never name a component; a component
of null ids only has a null id; repeated rows each get a row; a very long text is
hashed whole, 65,536 shingles at a time; an empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netdensity.operators.components import components
from netdensity.session import materialize

SHINGLE = 4
BITS = 4
PAIRED = 512
HELD = 20_000
#: The 70 sets of four of the eight byte positions.
SETS = list(combinations(range(8), 4))


def first_of(sets: list[tuple[int, ...]]) -> np.ndarray:
    """For each mask of equal bytes, the first set that it holds, or -1."""
    return np.array([next((k for k, s in enumerate(sets) if all(m >> p & 1 for p in s)), -1) for m in range(256)], np.int16)


FIRST = first_of(SETS)
#: Flips of up to 0, 1 and 2 of 32 bits: two values differ in at most 0, 2 or 4 bits exactly if they share a flip.
FLIPS = [np.array([sum(1 << i for i in c) for k in range(n + 1) for c in combinations(range(32), k)], np.uint32) for n in range(3)]
POSTS = "k long, v long, fp long"


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """The 64-bit fingerprint of a text's word shingles, each counted as often as it occurs."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z and ASCII white space
    if not words:
        return 0
    joined = b" ".join(words)
    n = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(n + 1) - 1
    first, last = (ends - n)[: max(1, len(n) - size + 1)].tolist(), ends[size - 1 :].tolist() or [len(joined)]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for k in range(0, len(first), 65_536):
        h = np.fromiter((digest(joined[a:z], 42) for a, z in zip(first[k : k + 65_536], last[k : k + 65_536])), np.uint64)
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int((2 * ones > len(first)) @ (1 << np.arange(64, dtype=object)))


def of_hashes(h: np.ndarray) -> int:
    """The 64-bit fingerprint of hashes: a bit is set if over half of them have it."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 65_536):
        ones += np.unpackbits(h[k : k + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id="doc_id", text="text", size: int = SHINGLE) -> DataFrame:
    """doc_id and fp (signed) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, size) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["doc_id", "fp"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("t")).mapInArrow(run, "doc_id long, fp long")


def spanning(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For n nodes and links i-j, the least node that each reaches."""
    label = np.arange(n)
    while True:
        m = np.minimum(label[i], label[j])
        after = label.copy()
        np.minimum.at(after, i, m)
        np.minimum.at(after, j, m)
        after = after[after]
        if (after == label).all():
            return label
        label = after


def equal_mask(x: np.ndarray) -> np.ndarray:
    """Bit p set where byte p of the xor is zero: the tally of a pair is its number of ones."""
    return np.packbits(np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8) == 0, axis=1, bitorder="little")[:, 0]


def rest_of(fps: np.ndarray, which: int) -> np.ndarray:
    """The four bytes that a list's set leaves, as 32 bits."""
    b = fps.astype("<u8").view(np.uint8).reshape(-1, 8)
    return np.ascontiguousarray(b[:, [p for p in range(8) if p not in SETS[which]]]).view("<u4")[:, 0]


def links_of(which: int, fps: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (fp, least fp reached) within one list of distinct fingerprints."""
    n = len(fps)
    if n <= PAIRED:
        i, j = np.triu_indices(n, 1)
        x = fps[i] ^ fps[j]
        ok = np.bitwise_count(x) <= bits
        i, j, x = i[ok], j[ok], x[ok]
        ok = FIRST[equal_mask(x)] == which
        label = spanning(n, i[ok], j[ok])
    else:
        flips = FLIPS[bits // 2]
        v = (rest_of(fps, which)[:, None] ^ flips[None, :]).ravel()
        _, v = np.unique(v, return_inverse=True)
        node = np.repeat(np.arange(n), len(flips))
        label = np.arange(n)
        while True:
            least = np.full(v.max() + 1, n)
            np.minimum.at(least, v, label[node])
            after = least[v].reshape(n, -1).min(1)
            after = after[after]
            if (after == label).all():
                break
            label = after
    moved = np.flatnonzero(label != np.arange(n))
    return fps[moved], fps[label[moved]]


def posts(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """From rows (k, fp) sorted by k: links (null, fp, fp), and flips (k, flip, fp) of lists over HELD."""

    def record(k, v, fp) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([k, pa.array(np.asarray(v).astype(np.uint64).view(np.int64)), pa.array(np.asarray(fp, np.uint64).view(np.int64))], ["k", "v", "fp"])

    def flips(k: int, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(fps), 256):
            part = fps[a : a + 256]
            v = rest_of(part, k >> 32)[:, None] ^ FLIPS[bits // 2][None, :]
            yield record(pa.array(np.full(v.size, k)), v.ravel(), np.repeat(part, v.shape[1]))

    held_k, held, over = None, np.zeros(0, np.uint64), False
    for b in batches:
        k, fp = b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64)
        if not len(k):
            continue
        if over and k[0] == held_k:
            n = int(np.searchsorted(k, held_k, "right"))
            yield from flips(held_k, fp[:n])
            k, fp = k[n:], fp[n:]
            if not len(k):
                continue
        if held_k is not None and not over:
            k, fp = np.append(np.full(len(held), held_k), k), np.append(held, fp)
        cut = np.append(np.flatnonzero(np.append(True, k[1:] != k[:-1])), len(k))
        size = np.diff(cut)
        a_out, b_out = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        two = cut[:-2][size[:-1] == 2]
        x = fp[two] ^ fp[two + 1]
        ok = np.bitwise_count(x) <= bits
        ok[ok] = FIRST[equal_mask(x[ok])] == k[two[ok]] >> 32
        a_out.append(fp[two[ok]])
        b_out.append(fp[two[ok] + 1])
        for g in np.flatnonzero(size[:-1] > 2):
            p, q = links_of(int(k[cut[g]] >> 32), fp[cut[g] : cut[g + 1]], bits)
            a_out.append(p)
            b_out.append(q)
        held_k, held, over = int(k[-1]), fp[cut[-2] :].copy(), False
        if len(held) > HELD:
            yield from flips(held_k, held)
            held, over = held[:0], True
        p, q = np.concatenate(a_out), np.concatenate(b_out)
        yield record(pa.nulls(len(p), pa.int64()), p, q)
    if len(held) > 1:
        p, q = links_of(held_k >> 32, held, bits)
        yield record(pa.nulls(len(p), pa.int64()), p, q)


def keys(sets: list[tuple[int, ...]]) -> list[Column]:
    """The lists of a fingerprint: for each set its number and the bytes at its positions."""
    byte = [F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255).cast("long")) for p in range(8)]
    out = []
    for k, s in enumerate(sets):
        key = F.lit(k).cast("long")
        for p in s:
            key = F.shiftleft(key, 8).bitwiseOR(byte[p])
        out.append(key)
    return out


def near_links(fps: DataFrame, bits: int = BITS) -> DataFrame:
    """Links (a, b) that connect what distinct fingerprints (column fp) within ``bits`` connect; bits is 0, 2 or 4."""
    if bits not in (0, 2, BITS):
        raise ValueError("the index guarantees matches for up to four differing bits, and long lists meet through flips of half as many")
    listed = fps.select(F.explode(F.array(*keys(SETS))).alias("k"), "fp").repartition("k").sortWithinPartitions("k")
    found = materialize(listed.mapInArrow(lambda it: posts(it, bits), POSTS))
    links = found.where("k is null").select(F.col("v").alias("a"), F.col("fp").alias("b"))
    long = found.where("k is not null")
    least = long.groupBy("k", "v").agg(F.min("fp").alias("b"))
    return links.union(long.join(least, ["k", "v"]).where("fp <> b").select(F.col("fp").alias("a"), "b"))


def nearest_before(batches: Iterator[pa.RecordBatch], bits: int, matches: int, window: int) -> Iterator[pa.RecordBatch]:
    """From rows (k, fp) sorted by k, fp: each entry of a list with the nearest of the ``window`` before it, within ``bits``."""
    first = first_of(list(combinations(range(8), matches)))
    k, fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    for b in batches:
        if not len(b):
            continue
        old, k, fp = len(k), np.append(k, b.column(0).to_numpy()), np.append(fp, b.column(1).to_numpy().view(np.uint64))
        least, partner, at = np.full(len(k), bits + 1, np.uint8), np.zeros(len(k), np.uint64), np.arange(old, len(k))
        for step in range(1, window + 1):
            at = at[at >= step]
            at = at[k[at] == k[at - step]]
            if not len(at):
                break
            x = fp[at] ^ fp[at - step]
            n = np.bitwise_count(x)
            ok = n < least[at]
            ok[ok] = first[equal_mask(x[ok])] == k[at[ok]] >> 8 * matches
            least[at[ok]], partner[at[ok]] = n[ok], fp[at[ok] - step]
        got = np.flatnonzero(least <= bits)
        yield pa.RecordBatch.from_arrays([pa.array(partner[got].view(np.int64)), pa.array(fp[got].view(np.int64))], ["a", "b"])
        last = max(int(np.searchsorted(k, k[-1])), len(k) - window)
        k, fp = k[last:], fp[last:]


def near_pairs(fps: DataFrame, bits: int, matches: int, window: int = PAIRED) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints (column fp) that share ``matches`` bytes or more and differ in at most ``bits`` bits.

    The lists are those of every set of so many positions. A pair counts only in the first list that its equal bytes name. There
    an entry goes with its nearest partner before it, not with all, so that at most one pair an entry leaves a list; beyond ``window``
    entries a list is not searched. Who needs every pair has to look for the rest otherwise.
    """
    sets = list(combinations(range(8), matches))
    listed = fps.select(F.explode(F.array(*keys(sets))).alias("k"), "fp").repartition("k").sortWithinPartitions("k", "fp")
    return listed.mapInArrow(lambda it: nearest_before(it, bits, matches, window), "a long, b long")


def near_duplicates(docs: DataFrame, doc_id="doc_id", text="text", bits: int = BITS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row."""
    prints = materialize(fingerprints(docs, doc_id, text))
    classes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(near_links(classes.select("fp"), bits)).select(F.col("node").alias("fp"), "root")
    tied = classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = tied.groupBy("root").agg(F.min("least").alias("component_id"))
    of_print = tied.join(named, "root").select("fp", "component_id")
    return prints.join(of_print, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
