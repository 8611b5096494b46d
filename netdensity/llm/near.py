"""Near-duplicates by SimHash over five-word shingles, verified by Jaccard similarity, with an exact way for the rest.

Two texts are linked if the sets of their shingles have a similarity of 0.8 or more. Pairs come first from fingerprints:
each set has one of 64 bits, and the byte-position inverted index of ``simhash`` with count filtering gives pairs that share
MATCHES of 8 bytes or more and differ in at most BITS bits. Their similarity is then taken from the sets, and what is linked makes classes.

At a similarity of 0.8 about 10 of 64 bits differ, up to 18 were seen, and no index of eight bytes can guarantee matches for
more than 7; so fingerprints find many links, but not all. The rest is looked for only between texts that they leave in different classes,
by prefix filtering: in any one order of all shingles, sets of that similarity share a shingle among the first
n - ceil(0.8 n) + 1 of each set of n, so lists of the texts that have a shingle there hold every such pair. The order puts
shingles of little used buckets first (a count over 65,536 buckets of hashes, the only thing that the driver sees), so that
a passage of many texts seldom names a list; the order changes the work, never the result.

Texts with equal sets are one entry. A pair goes on to its texts if its bitmaps allow the similarity: the differing bits of
two parity bitmaps never exceed the differing members. A pair of a prefix list also has to pass by its sizes and its places in the list.
Lists of up to PAIRED entries give all such pairs. In a longer one pairs of different classes are compared by bitmaps at once, and each
pair goes on from one list only, the least that both are in. Texts move only for pairs that passed.

Defined results: words are parted by ASCII white space and compared without the case of A-Z; fewer than five words give
one shingle; null and blank texts have none and equal each other; a long text is one entry; null doc_ids take part like others;
repeated rows are one entry; an empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netdensity.llm import shingles, simhash
from netdensity.llm.common import lean
from netdensity.operators.components import components
from netdensity.session import fewer, materialize, release

#: Bits in which fingerprints may differ, and bytes of eight that they share.
BITS = 16
MATCHES = 3
PAIRED = 64
BUCKETS = 1 << 16
#: Bytes of one side's bitmaps or texts, about, whose pairs are compared together.
SLICE = 2 << 20
#: Texts whose hashes may be broadcast (8 bytes each); more are joined by a shuffle.
SENT = 100_000
PRINTS = "th long, sig long, fp long, size int, first array<long>, bits binary"
LISTED = "k long, a long, b long, size int, pos int"
PAIRS = "a long, b long"


def alike(common, m, n):
    """Whether sets of m and n members with so many in common have a similarity of 0.8 or more."""
    return 9 * common >= 4 * (m + n)


def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = np.zeros(BUCKETS, np.int64)
    for b in lean(batches, 0, shingles.PIECE):
        for s in shingles.of_all(b.column(0).to_pylist()):
            n += np.bincount((s >> np.uint64(48)).astype(np.int64), minlength=BUCKETS) if len(s) else 0
    at = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["bucket", "n"])


def prints(batches: Iterator[pa.RecordBatch], level: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(th, sig, fp, size, first, bits): text hash, hash of the set, its fingerprint and size, the shingles that name its lists, in order, and its bitmap."""
    for b in lean(batches, 1, shingles.PIECE):
        sig, fp, size, first, bits = [], [], [], [], []
        for s in shingles.of_all(b.column(1).to_pylist()):
            sig.append(xxhash.xxh64_intdigest(s.tobytes(), 42))
            fp.append(simhash.of_hashes(s))
            size.append(len(s))
            ranked = s[np.argsort(level[(s >> np.uint64(48)).astype(np.int64)], kind="stable")]
            first.append(ranked[: len(s) - (4 * len(s) + 4) // 5 + 1].view(np.int64))
            bits.append(shingles.parity(s))
        yield pa.RecordBatch.from_arrays(
            [
                b.column(0), pa.array(np.array(sig, np.uint64).view(np.int64)), pa.array(np.array(fp, np.uint64).view(np.int64)),
                pa.array(size, pa.int32()), pa.array(first, pa.list_(pa.int64())), pa.array(bits, pa.binary()),
            ],
            ["th", "sig", "fp", "size", "first", "bits"],
        )


def by_list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each list of two or more, from rows sorted by their first column, the list."""
    parts: list[pa.RecordBatch] = []

    def held() -> Iterator[pa.RecordBatch]:
        if sum(map(len, parts)) > 1:
            yield parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        parts.clear()

    for b in batches:
        if not len(b):
            continue
        k = b.column(0).to_numpy()
        cut = np.flatnonzero(k[1:] != k[:-1]) + 1
        for x, y in zip([0, *cut.tolist()], [*cut.tolist(), len(k)]):
            if parts and parts[0].column(0)[0].as_py() != k[x]:
                yield from held()
            elif not parts and y - x == 1 and y < len(k):
                continue  # alone in its list
            parts.append(b.slice(x, y - x))
            if y < len(k):
                yield from held()
    yield from held()


def possible(size: np.ndarray, pos: np.ndarray, i, j) -> np.ndarray:
    """Whether entries may be alike, by what lies after the places of the shingle that they share."""
    return alike(np.minimum(size[i], size[j]), size[i], size[j]) & alike(
        np.minimum(size[i] - pos[i], size[j] - pos[j]) + np.minimum(pos[i], pos[j]), size[i], size[j]
    )


def ordered(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
    """Distinct pairs, the lesser first."""
    x, y = np.concatenate(a), np.concatenate(b)
    pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def pairs_of_lists(batches: Iterator[pa.RecordBatch], paired: int) -> Iterator[pa.RecordBatch]:
    """From rows (k, sig, size, pos) sorted by k: pairs (null, a, b) of short lists, and the rows of long ones."""
    a_out, b_out, n_out = [], [], 0
    names = ["k", "a", "b", "size", "pos"]

    def flush() -> pa.RecordBatch:
        pairs = ordered(a_out, b_out)
        a_out.clear()
        b_out.clear()
        return pa.RecordBatch.from_arrays([pa.nulls(len(pairs), pa.int64()), *pairs.columns, pa.nulls(len(pairs), pa.int32()), pa.nulls(len(pairs), pa.int32())], names)

    for rows in by_list(batches):
        k, sig, size, pos = rows.columns
        if len(rows) > paired:
            yield pa.RecordBatch.from_arrays([k, sig, pa.nulls(len(rows), pa.int64()), size, pos], names)
            continue
        sig, size, pos = sig.to_numpy(), size.to_numpy(), pos.to_numpy()
        i, j = np.triu_indices(len(sig), 1)
        ok = possible(size, pos, i, j)
        a_out.append(sig[i[ok]])
        b_out.append(sig[j[ok]])
        n_out += len(a_out[-1])
        if n_out > 100_000:
            yield flush()
            n_out = 0
    if a_out:
        yield flush()


def matrix(bits: list[bytes], length: int) -> np.ndarray:
    """Bitmaps as rows of 64-bit words, folded to ``length`` bytes; none is shorter."""
    out = np.empty((len(bits), length // 8), np.uint64)
    n = np.array(list(map(len, bits)))
    for size in np.unique(n).tolist():
        at = np.flatnonzero(n == size)
        rows = np.frombuffer(b"".join(bits[k] for k in at.tolist()), np.uint64).reshape(len(at), -1)
        out[at] = shingles.folded(rows, length // 8)
    return out


def close(differing: np.ndarray, m, n) -> np.ndarray:
    """Whether sets of m and n members may be alike whose bitmaps differ in so many bits."""
    return 9 * differing <= m + n


def pairs_by_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (a, b, m, n, x, y) with sizes and bitmaps: the pairs that these allow."""
    for b in lean(batches, 4, SLICE):
        m, n = b.column(2).to_numpy(), b.column(3).to_numpy()
        x, y = b.column(4).to_pylist(), b.column(5).to_pylist()
        length, keep = np.array([min(len(p), len(q)) for p, q in zip(x, y)], np.int64), np.zeros(len(b), bool)
        for size in np.unique(length).tolist():
            at = np.flatnonzero(length == size)
            differing = np.bitwise_count(matrix([x[k] for k in at.tolist()], size) ^ matrix([y[k] for k in at.tolist()], size)).sum(1, dtype=np.int64)
            keep[at] = close(differing, m[at], n[at])
        yield b.select(["a", "b"]).filter(pa.array(keep))


def pairs_across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (k, sig, size, pos, bits, root, ks) sorted by k: pairs of unlike roots that may be alike; ks are the long lists that an entry is in."""
    for rows in by_list(batches):
        root = rows.column(5).to_numpy()
        if (root == root[0]).all():
            continue
        k, size = rows.column(0)[0].as_py(), rows.column(2).to_numpy()
        order = np.argsort(size, kind="stable")
        sig, pos, root, size = rows.column(1).to_numpy()[order], rows.column(3).to_numpy()[order], root[order], size[order]
        bits, before = rows.column(4).take(pa.array(order)).to_pylist(), [[x for x in ks if x < k] for ks in rows.column(6).take(pa.array(order)).to_pylist()]
        column = {x: c for c, x in enumerate(sorted({x for ks in before for x in ks}))}
        other = np.zeros((len(sig), len(column)), np.uint8)
        for r, ks in enumerate(before):
            other[r, [column[x] for x in ks]] = 1
        other = np.packbits(other, axis=1)
        upto, length = np.searchsorted(size, size * 5 // 4, "right"), np.array(list(map(len, bits)))
        a_out, b_out, n_out, words, low = [], [], 0, np.zeros((0, 0), np.uint64), 0
        for i in range(len(sig)):
            if i == 0 or length[i] != length[i - 1]:  # a size's partners have bitmaps of its length or twice that
                low = i
                words = matrix(bits[i : int(np.searchsorted(length, 2 * length[i], "right"))], int(length[i]))
            j = np.arange(i + 1, upto[i])
            j = j[root[j] != root[i]]
            j = j[possible(size, pos, i, j)]
            j = j[close(np.bitwise_count(words[j - low] ^ words[i - low]).sum(1, dtype=np.int64), size[i], size[j])]
            j = j[~(other[j] & other[i]).any(1)]
            a_out.append(np.full(len(j), sig[i]))
            b_out.append(sig[j])
            n_out += len(j)
            if n_out > 100_000:
                yield ordered(a_out, b_out)
                a_out, b_out, n_out = [], [], 0
        if n_out:
            yield ordered(a_out, b_out)


def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (a, b, ta, tb): the pairs that are alike."""
    for b in lean(batches, 2, SLICE):
        text = dict(zip(b.column(0).to_pylist(), b.column(2).to_pylist())) | dict(zip(b.column(1).to_pylist(), b.column(3).to_pylist()))
        members = dict(zip(text, shingles.of_all(list(text.values()))))
        ok = []
        for i, j in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            x, y = members[i], members[j]
            ok.append(bool(alike(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y))))
        yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))


def by_fingerprint(entries: DataFrame, dealt: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """From rows (sig, fp): pairs of sets that the fingerprints' index names, the lesser first; a fingerprint's least set stands for it."""
    heads = materialize(dealt(entries.groupBy("fp").agg(F.min("sig").alias("head"))))
    pairs = simhash.near_pairs(heads.select("fp"), BITS, MATCHES)
    pairs = pairs.join(heads.select(F.col("fp").alias("a"), F.col("head").alias("x")), "a").join(heads.select(F.col("fp").alias("b"), F.col("head").alias("y")), "b")
    same = entries.join(heads, "fp").where("sig <> head").select(F.col("sig").alias("x"), F.col("head").alias("y"))
    return pairs.select("x", "y").union(same).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose ends (sig, root) does not put in one component."""
    joined = pairs.join(roots.select(F.col("sig").alias("a"), F.col("root").alias("x")), "a", "left").join(roots.select(F.col("sig").alias("b"), F.col("root").alias("y")), "b", "left")
    return joined.where(F.coalesce("x", "a") != F.coalesce("y", "b")).select("a", "b")


def near_duplicates(docs: DataFrame, text="text", paired: int = PAIRED) -> DataFrame:
    """(th, root) for each distinct text: xxhash64 of the text, null as empty, and the component it is in."""
    t = F.coalesce(F.col(text), F.lit(""))
    source = docs.select(F.xxhash64(t).alias("th"), t.alias("t"))
    dealt = partial(fewer, source=docs)
    level = np.zeros(BUCKETS, np.int8)
    for r in source.select("t").mapInArrow(tally, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        level[r.bucket] = int(r.n).bit_length()
    found = materialize(dealt(source).mapInArrow(partial(prints, level=level), PRINTS))

    def verified(pairs: DataFrame) -> DataFrame:
        ends = pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct()
        traits = found.join(F.broadcast(ends) if ends.count() <= SENT else ends, "sig").groupBy("sig").agg(F.min("th").alias("th"), F.first("size").alias("size"), F.first("bits").alias("bits"))
        both = pairs.join(traits.select(F.col("sig").alias("a"), F.col("size").alias("m"), F.col("bits").alias("x")), "a").join(traits.select(F.col("sig").alias("b"), F.col("size").alias("n"), F.col("bits").alias("y")), "b")
        passed = materialize(dealt(both.select("a", "b", "m", "n", "x", "y")).mapInArrow(pairs_by_bits, PAIRS))
        needed = materialize(dealt(passed.select(F.explode(F.array("a", "b")).alias("sig")).distinct().join(traits.select("sig", "th"), "sig")))
        hashes = F.broadcast(needed) if needed.count() <= SENT else needed
        texts = materialize(dealt(source.join(hashes, "th").groupBy("sig").agg(F.first("t").alias("t"))))
        both = passed.join(texts.select(F.col("sig").alias("a"), F.col("t").alias("ta")), "a").join(texts.select(F.col("sig").alias("b"), F.col("t").alias("tb")), "b")
        return materialize(dealt(both.select("a", "b", "ta", "tb")).mapInArrow(compare, PAIRS))

    tried = materialize(dealt(by_fingerprint(found.select("sig", "fp").distinct(), dealt)))
    links = verified(tried)
    classes = components(links, dealt=dealt).withColumnRenamed("node", "sig")
    release(docs.sparkSession)

    posts = found.groupBy("sig").agg(F.first("size").alias("size"), F.first("first").alias("first")).select("sig", "size", F.posexplode("first").alias("pos", "k"))
    listed = materialize(dealt(posts.select("k", "sig", "size", "pos").repartition("k").sortWithinPartitions("k")).mapInArrow(partial(pairs_of_lists, paired=paired), LISTED))
    release(docs.sparkSession)
    rest = apart(listed.where("k is null").select("a", "b").distinct(), classes)
    long = listed.where("k is not null").select("k", F.col("a").alias("sig"), "size", "pos")
    if long.limit(1).count() > 0:
        traits = found.groupBy("sig").agg(F.first("bits").alias("bits"))
        ks = long.groupBy("sig").agg(F.collect_list("k").alias("ks"))  # at most a text's own first shingles
        rows = long.join(traits, "sig").join(ks, "sig").join(classes, "sig", "left")
        rows = rows.select("k", "sig", "size", "pos", "bits", F.coalesce("root", "sig").alias("root"), "ks")
        rest = rest.union(rows.repartition("k").sortWithinPartitions("k").mapInArrow(pairs_across, PAIRS)).distinct()
    links = links.union(verified(materialize(dealt(rest.join(tried, ["a", "b"], "left_anti")))))
    roots = components(links, dealt=dealt).withColumnRenamed("node", "sig")
    return found.select("th", "sig").distinct().join(roots, "sig", "left").select("th", F.coalesce("root", "sig").alias("root"))
