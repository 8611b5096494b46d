"""Embedding near-duplicates by E8 lattice hashing.

Each table projects the normalised vectors to eight dimensions with a seeded orthonormal random
matrix, scales them, and decodes them to the nearest point of the lattice E8. A vector is listed
under that point and under the neighbouring lattice points next nearest to it (PROBES in all), so two
vectors meet in a table if their lists share a point; the relation is symmetric. Vectors that meet
are compared by cosine in double precision.

Equal vectors of a group are one entry with a weight. In a list, entries are compared block by block with one
matrix product; a pair counts only in the first list that both entries name, so counts
add up without pairs leaving a task. Out come one count for each entry and a spanning set of links. Lists longer
than BLOCK are cut into blocks, and every two blocks are a unit of work of their own, so a list
of any length is spread over tasks and held in pieces.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components, and rows with a null group,
have no links and stand alone; vectors of different lengths are never compared; rows that share an id are rows of
their own and a row links to them as to others, except that a component's name is
an id; null ids are never a name unless all are null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netdensity.operators.components import components
from netdensity.llm.simhash import spanning
from netdensity.session import materialize

MIN_COSINE = 0.98
TABLES = 3
PROBES = 4
SCALE = 0.42
BLOCK = 2048
LISTED = "node long, weight long, codes array<long>, v array<double>"
COUNTED = "node long, n long, to long"


@lru_cache(maxsize=1)
def shortest() -> np.ndarray:
    """Zero and the 240 shortest vectors of E8."""
    out = [np.zeros(8)]
    for i, j in combinations(range(8), 2):
        for a, b in product((-1, 1), repeat=2):
            x = np.zeros(8)
            x[i], x[j] = a, b
            out.append(x)
    out += [np.array(s) / 2 for s in product((-1, 1), repeat=8) if np.prod(s) == 1]
    return np.array(out)


def decode(x: np.ndarray) -> np.ndarray:
    """The nearest E8 points: the nearer of the nearest points of D8 and of D8 moved by one half."""

    def even(y: np.ndarray) -> np.ndarray:
        r = np.rint(y)
        off = y - r
        worst = np.abs(off).argmax(1)
        odd = np.flatnonzero(r.sum(1) % 2)
        r[odd, worst[odd]] += np.where(off[odd, worst[odd]] >= 0, 1, -1)
        return r

    a, b = even(x), even(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


@lru_cache(maxsize=8)
def projection(dims: int, which: int, seed: int) -> np.ndarray:
    g = np.random.default_rng([seed, dims, which]).standard_normal((dims, 8))
    return np.linalg.qr(g)[0] * np.sqrt(dims / 8) if dims >= 8 else g


def codes_of(unit: np.ndarray, salt: np.ndarray, tables: int, probes: int, scale: float, seed: int) -> np.ndarray:
    """64-bit codes [n, tables * probes] of the lattice points that each vector is listed under, nearest first within a table."""
    out = np.empty((len(unit), tables * probes), np.int64)
    near = shortest()
    mult = np.random.default_rng([seed, 9]).integers(0, 2**63, 9, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for t in range(tables):
        y = unit @ projection(unit.shape[1], t, seed) / scale
        home = decode(y)
        rest = y - home
        # |rest - s|^2 over the shortest vectors s, less |rest|^2
        d = (near**2).sum(1)[None, :] - 2 * rest @ near.T
        pick = np.argpartition(d, probes - 1, axis=1)[:, :probes] if probes < len(near) else np.tile(np.arange(len(near)), (len(y), 1))
        pick = np.take_along_axis(pick, np.take_along_axis(d, pick, 1).argsort(1, kind="stable"), 1)
        point = np.rint(2 * (home[:, None, :] + near[pick])).astype(np.int64).astype(np.uint64)
        h = (point * mult[:8]).sum(2, dtype=np.uint64) + (salt + np.uint64(t))[:, None] * mult[8]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        out[:, t * probes : (t + 1) * probes] = h.view(np.int64)
    return out


def compare(a: dict, b: dict | None, cell: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Links (i, j) of entries of a, or of a against b, whose first common list is ``cell``."""
    other = b or a
    cos = a["v"] @ other["v"].T
    i, j = np.nonzero(cos >= least)
    if b is None:
        i, j = i[i < j], j[i < j]
    keep = np.zeros(len(i), bool)
    for k in range(0, len(i), 1 << 16):
        x, y = a["codes"][i[k : k + (1 << 16)]], other["codes"][j[k : k + (1 << 16)]]
        first = np.zeros(len(x), np.int64)
        open_ = np.ones(len(x), bool)
        for c in range(x.shape[1]):
            common = open_ & (y == x[:, c : c + 1]).any(1)
            first[common] = x[common, c]
            open_ &= ~common
        # The order of lists must not depend on the side: the least common code of both views decides.
        back = np.zeros(len(x), np.int64)
        open_ = np.ones(len(x), bool)
        for c in range(x.shape[1]):
            common = open_ & (x == y[:, c : c + 1]).any(1)
            back[common] = y[common, c]
            open_ &= ~common
        keep[k : k + (1 << 16)] = np.minimum(first, back) == cell
    return i[keep], j[keep]


def count_lists(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Rows (cell, p, q, side, node, weight, codes, v) sorted by the first four to link counts and spanning links."""

    def solve(key: tuple, pieces: list[tuple]) -> list[tuple[np.ndarray, ...]]:
        sides = []
        for side in (0, 1):
            own = [x for x in pieces if x[0] == side]
            if own:
                sides.append({name: np.concatenate([x[k] for x in own]) for k, name in ((1, "node"), (2, "w"), (3, "codes"), (4, "v"))})
        if not sides or (key[1] != key[2] and len(sides) < 2):
            return []
        a, b = sides[0], sides[1] if key[1] != key[2] else None
        i, j = compare(a, b, key[0], least)
        if not len(i):
            return []
        o, shift = (b, len(a["node"])) if b else (a, 0)
        node = np.concatenate([a["node"], b["node"]]) if b else a["node"]
        n = np.zeros(len(node), np.int64)
        np.add.at(n, i, o["w"][j])
        np.add.at(n, j + shift, a["w"][i])
        label = spanning(len(node), i, j + shift)
        hit = np.flatnonzero(n)
        return [(node[hit], n[hit], node[label[hit]])]

    def record(found: list[tuple]) -> Iterator[pa.RecordBatch]:
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[k] for x in found])) for k in range(3)], ["node", "n", "to"])

    now, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        cell, p, q, side, node, weight = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(6))
        codes = batch.column(6).flatten().to_numpy().reshape(len(cell), -1)
        lists = batch.column(7)
        values, off = lists.flatten().to_numpy(), np.append(0, np.cumsum(lists.value_lengths().to_numpy()))
        keys = np.stack([cell, p, q, side])
        cuts = np.append(np.flatnonzero(np.append(True, (keys[:, 1:] != keys[:, :-1]).any(0))), len(cell))
        found = []
        for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            key = (int(cell[s]), int(p[s]), int(q[s]))
            if key != now:
                if now is not None:
                    found += solve(now, held)
                now, held = key, []
            held.append((int(side[s]), node[s:e], weight[s:e], codes[s:e], values[off[s] : off[e]].reshape(e - s, -1)))
        yield from record(found)
    if now is not None:
        yield from record(solve(now, held))


def near_duplicates(rows: DataFrame, vec_id="vec_id", vector="embedding", group="label", least: float = MIN_COSINE, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE, seed: int = 8) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    v = F.col(vector).cast("array<double>")
    sound = F.coalesce(F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists(v, lambda x: x != 0) & F.col(group).isNotNull(), F.lit(False))
    slim = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.when(sound, F.xxhash64(F.col(group).cast("string"), F.size(v))).alias("g"), F.when(sound, v).alias("v"))
    # Equal vectors of a group have one node; its number is a 64-bit hash of group and vector.
    slim = materialize(slim.withColumn("node", F.when(F.col("g").isNotNull(), F.xxhash64("g", "v"))))
    entries = materialize(slim.where("node is not null").groupBy("node", "g", "v").agg(F.count("*").alias("weight"), F.min("vec_id").alias("least")))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            g, node, weight = b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy(), b.column(3).to_numpy()
            vs = b.column(2).to_pylist()
            for dims in sorted({len(x) for x in vs}):
                at = np.array([k for k, x in enumerate(vs) if len(x) == dims])
                unit = np.array([vs[k] for k in at])
                unit /= np.abs(unit).max(1, keepdims=True)
                unit /= np.sqrt((unit**2).sum(1, keepdims=True))
                codes = codes_of(unit, g[at], tables, probes, scale, seed)
                n = len(at)
                flat = lambda m, kind, n=n: pa.ListArray.from_arrays(pa.array(np.arange(0, n * m.shape[1] + 1, m.shape[1], dtype=np.int32)), pa.array(np.ascontiguousarray(m).ravel(), kind))
                yield pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(weight[at]), flat(codes, pa.int64()), flat(unit, pa.float64())], ["node", "weight", "codes", "v"])

    coded = materialize(entries.select("g", "node", "v", "weight").mapInArrow(listed, LISTED))
    lists = coded.select(F.explode("codes").alias("cell"), "node")
    sizes = lists.groupBy("cell").agg(F.count("*").alias("m")).where("m > 1")
    # A list of m entries has ceil(m / BLOCK) blocks; an entry of block k goes to every pair with k, one row a block.
    sized = lists.join(sizes, "cell").withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int")).withColumn("k", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    sided = sized.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("cell", F.least("k", "o").alias("p"), F.greatest("k", "o").alias("q"), (F.col("k") > F.col("o")).cast("int").alias("side"), "node")
    full = sided.join(coded, "node").select("cell", "p", "q", "side", "node", "weight", "codes", "v")
    work = full.repartition("cell", "p", "q").sortWithinPartitions("cell", "p", "q", "side", "node")
    counted = materialize(work.mapInArrow(lambda it: count_lists(it, least), COUNTED))
    links = counted.groupBy("node").agg(F.sum("n").alias("n"))
    roots = components(counted.where("node <> to"), "node", "to").select("node", "root")
    tied = entries.select("node", "least", "weight").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = tied.groupBy("root").agg(F.min("least").alias("component_id"))
    per_node = tied.join(named, "root").join(links, "node", "left").select("node", "component_id", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    out = slim.select("vec_id", "node").join(per_node, "node", "left")
    name = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), name.alias("component_id"), F.coalesce(F.col("vec_id") == name, F.lit(True)).alias("kept"))
