"""Each text operator against a plain version, with nulls, empty and repeated rows, ties, empty tables and clashing columns."""

import hashlib
import random
import re
import struct
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from netdensity.llm import bpe, chat, elias_fano, lattice, lines, mixing, pii, quality, simhash, suffix, token_files

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")
DOC = "doc_id long, text string, source string, th string, node string, size string, fp string, n string"


def docs(spark, rows, parts=3):
    """Rows (doc_id, text[, source]) with other columns whose names the operators use inside."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "s", "x", "y", "z", "w", "v") for r in rows]
    return spark.createDataFrame(full, DOC).repartition(parts)


ODD = [(None, None), (1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (5, "ÄÖ é   x" * 3), (6, "a" * 20_000), (7, "word " * 30_000), (8, "<|im_end|> \\ <\\| <|endoftext|> \x00 😀")]


# ---- SimHash


def words(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def plain_print(t):
    w = words(t)
    sh = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def test_simhash_against_all_pairs(spark):
    rng = random.Random(2)
    rows = [r for r in ODD if r[0] != 7]
    base = [" ".join(rng.choice("abcdefghijklmnop") * rng.randint(1, 3) for _ in range(60)) for _ in range(12)]
    for k in range(150):
        w = rng.choice(base).split()
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice(["x", "Y", "zz"])
        rows.append((100 + k, " ".join(w)))
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs(spark, rows)).collect())
    prints = [plain_print(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                root[max(find(i), find(j))] = min(find(i), find(j))
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    name = {g: min((d for d in ds if d is not None), default=None) for g, ds in groups.items()}
    assert got == sorted((d if d is not None else -1, f"{prints[i]:016x}", name[find(i)]) for i, (d, _) in enumerate(rows))
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


@pytest.mark.parametrize("limits", [(512, 20_000), (1, 20_000), (1, 5)])
def test_simhash_lists_of_any_length_are_exact(spark, monkeypatch, limits):
    monkeypatch.setattr(simhash, "PAIRED", limits[0])
    monkeypatch.setattr(simhash, "HELD", limits[1])
    rng = random.Random(3)
    prints = {0}
    for _ in range(60):
        x = rng.choice(sorted(prints))
        for _ in range(rng.randint(1, 6)):
            x ^= 1 << rng.randrange(64)
        prints.add(x)
    fps = np.array(sorted(prints), np.uint64)
    keys = np.array([(k << 32) | int.from_bytes(bytes(int(f) >> 8 * p & 255 for p in s), "big") for f in fps for k, s in enumerate(simhash.SETS)])
    order = np.argsort(keys, kind="stable")
    import pyarrow as pa

    rep = np.repeat(fps, 70)[order].view(np.int64)
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[order][a : a + 97]), pa.array(rep[a : a + 97])], ["k", "fp"]) for a in range(0, len(rep), 97)]
    links, flips = [], {}
    for b in simhash.posts(iter(batches), 4):
        for k, v, f in zip(*(c.to_pylist() for c in b.columns)):
            if k is None:
                links.append((v, f))
            else:
                flips.setdefault((k, v), []).append(f)
    links += [(f, g[0]) for g in flips.values() for f in g[1:]]
    at = {int(f): i for i, f in enumerate(fps.view(np.int64))}
    got = simhash.spanning(len(fps), np.array([at[a] for a, _ in links]), np.array([at[b] for _, b in links]))
    i, j = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4)
    assert got.tolist() == simhash.spanning(len(fps), i, j).tolist()


# ---- repeated substrings


def test_suffix_order_is_that_of_plain_sorting(monkeypatch):
    monkeypatch.setattr(suffix, "BUCKET", 100)
    rng = random.Random(5)
    t = bytes(rng.choice(b"ab") for _ in range(30)) * 12 + bytes(rng.choice(b"abc") for _ in range(400))
    t += t[100:500]
    for width in (31, 64, 200):
        starts = np.arange(len(t) - width + 1)
        parts = list(suffix.sorted_suffixes(np.frombuffer(t, np.uint8), starts, width))
        expected = sorted(starts.tolist(), key=lambda i: (t[i : i + width], i))
        assert np.concatenate([p[0] for p in parts]).tolist() == expected
        assert np.concatenate([p[1] for p in parts]).tolist() == [k > 0 and t[expected[k] :][:width] == t[expected[k - 1] :][:width] for k in range(len(expected))]


@pytest.mark.parametrize("width", [200, 48])
def test_substrings_against_counting_all_windows(spark, width):
    rng = random.Random(width)
    base = ["".join(rng.choice("abcdé \n") for _ in range(rng.randint(0, 700))) for _ in range(25)]
    texts = [rng.choice(base)[rng.randint(0, 90) :] + rng.choice(["", "x", rng.choice(base)]) for _ in range(60)] + base[:5] + ["ab" * 400, "a" * 399, base[0] + base[0], None, "", "a" * width, "b" * (width - 1)]
    rows = [(None if i % 19 == 0 else i // 2, t) for i, t in enumerate(texts)]
    got = sorted(tuple(r) for r in suffix.dedup_substrings(docs(spark, rows), width=width).select("n_bytes", "n_removed", "n_spans", "kept_sha256").collect())
    assert got == sorted(suffix.naive(texts, width))
    assert suffix.dedup_substrings(docs(spark, [])).count() == 0


# ---- BPE


def test_bpe_equals_the_library(spark):
    path = str(public_tokenizers.path("word_bpe_49k.json"))
    tok = tokenizers.Tokenizer.from_file(path)
    rows = [*ODD, (20, "Don't we've <|startoftext|>Ünïcödé 漢字 ΣΑΣ İx 12345 $$$ \x1c!\x1c ä ﬁ"), (21, "z" * 300 + " " + "qx" * 400)]
    df = docs(spark, rows)
    blob = bpe.build(df, path, most=2)
    assert bpe.frequent(df, path, most=2) == ["word"]
    ids = {(r.doc_id, r.ids and tuple(r.ids) or ()) for r in bpe.encode(df, path, blob).collect()}
    assert ids == {(d, tuple(tok.encode(t or "", add_special_tokens=False).ids)) for d, t in rows}
    back = {(r.doc_id, r.text) for r in bpe.decode(bpe.encode(df, path, blob), path).collect()}
    assert back == {(d, tok.decode(tok.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False)) for d, t in rows}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in bpe.roundtrip(df, path, blob, with_ids=True).collect():
        assert r.n_tokens == len(r.ids) and r.ids_sha256 == sha(" ".join(map(str, r.ids)))
    assert bpe.roundtrip(docs(spark, []), path, bpe.build(docs(spark, []), path)).count() == 0


@pytest.mark.parametrize("piece", [1 << 22, 40])
def test_bpe_of_every_character_and_odd_strings(monkeypatch, piece):
    monkeypatch.setattr(bpe, "PIECE", piece)
    monkeypatch.setattr(bpe, "BLOCK", 7)
    path, rng = str(public_tokenizers.path("word_bpe_49k.json")), random.Random(5)
    tok = tokenizers.Tokenizer.from_file(path)
    frequent = ["the", "of", "'s", "é", "a"]
    codec = bpe.Codec(bpe.Rules(path), bpe.Lexicon(bpe.compile_lexicon({w: tok.encode(w).ids for w in frequent})))
    odd = ["'s", "'S", "'re", "'ll", "'", "''", "'t've", "a", "é", "É", "İ", "Σ", "ς", "1", "23", "٣", "²", " ", "  ", "\n", "\x85", "\u2003", "\x1c", "$", "%%", "漢", "ﬁ", "\u0307", "e\u0301", "<|endoftext|>", "<|startoftext|>", "<|end", "the", "of", "😀", "x" * 70, "ab" * 50]
    texts = [None, ""] + ["".join(rng.choice(odd) for _ in range(rng.randint(0, 30))) for _ in range(400 if piece < 100 else 3000)]
    if piece > 100:
        points = [p for p in range(0x18900) if not 0xD800 <= p < 0xE000]
        texts += ["".join(f"a?1 {chr(p)}a{chr(p)}?{chr(p)}1 {chr(p)}'s" for p in points[a : a + 64]) for a in range(0, len(points), 64)]
    sha, seen = lambda s: hashlib.sha256(s.encode()).hexdigest(), 0
    for first, ids, ends in codec.documents(texts):
        assert first == seen
        for k, (a, z, x, y) in enumerate(zip([0, *ends[:-1]], ends, *codec.digests(ids, ends))):
            expected = tok.encode(texts[first + k] or "", add_special_tokens=False).ids
            assert ids[a:z].tolist() == expected
            assert (x, y) == (sha(" ".join(map(str, expected))), sha(tok.decode(expected, skip_special_tokens=False)))
            assert codec.decode(expected) == tok.decode(expected, skip_special_tokens=False)
        seen += len(ends)
    assert seen == len(texts)


def test_lexicon_accepts_its_words_only():
    rng = random.Random(1)
    entries = {"".join(rng.choice("abé") for _ in range(rng.randint(1, 7))): [i, i + 1][: 1 + i % 2] for i in range(400)}
    lex = bpe.Lexicon(bpe.compile_lexicon(entries))
    assert all(lex.get(w) == ids for w, ids in entries.items())
    others = {"".join(rng.choice("abéz") for _ in range(rng.randint(0, 8))) for _ in range(3000)} - set(entries)
    assert all(lex.get(w) is None for w in others)
    assert bpe.Lexicon(bpe.compile_lexicon({})).get("a") is None


# ---- chat


def test_chat_round_trip(spark):
    said = "<|im_end|><|im_start|>assistant ok"
    rows = [(-1, 0, "user", said), (-1, 1, "assistant", said), (None, 3, "assistant", "null id"), (5, 2, "assistant", "<\\|x <| \\ é😀"), (5, 1, "us\ner\\", None), (5, 2, "assistant", "<\\|x <| \\ é😀"), (6, None, None, "")]
    rows += [(9, i, "assistant" if i % 2 else "user", "t<|" * (i % 5)) for i in range(25_000)]
    df = spark.createDataFrame([(*r, "p", "q") for r in rows], "conv_id long, turn long, role string, text string, part string, formatted string").repartition(4)
    got = {r.conv_id: r for r in chat.digest(chat.format_chat(df)).collect()}
    for c in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        assert got[c].n_turns == len(own)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own).encode()).hexdigest()
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    parts = chat.format_chat(df.where("conv_id = -1")).collect()
    assert parts[0].formatted.count("<|im_start|>") == 2 and got[-1].formatted_chars == len(parts[0].formatted)
    assert chat.digest(chat.format_chat(df.where("false"))).count() == 0


# ---- lines


def test_lines_go_from_the_later_document(spark):
    a = "\n".join(f"line number {i} of the first text" for i in range(8))
    shared = "\n".join(f"line number {i} of the first text" for i in range(2, 6))
    rows = [(10, a), (20, f"an opening of its own is here\n{shared}\nshort\nan ending of its own is here"), (30, a), (40, a.replace("3", "three")), (None, a), (50, None), (51, ""), (52, "too short\n" * 4), (60, "again and again the same line\n" * 3), (61, "again and again the same line\n" * 5), (30, a)]
    got = {}
    for r in lines.dedup_lines(docs(spark, rows)).collect():
        got.setdefault(r.doc_id, []).append((r.text, r["__n_lines"], r["__n_removed"]))
    assert got[10][0][0] == a and got[None][0][0] == a
    assert got[20] == [("an opening of its own is here\nshort\nan ending of its own is here", 7, 4)]
    assert got[30] == [("", 8, 8)] * 2
    assert got[40] == [("line number three of the first text", 8, 7)]
    assert got[50] == [(None, 1, 0)] and got[51] == [("", 1, 0)] and got[52][0][2] == 0
    assert got[60][0][2] == 0 and got[61][0][2] == 3
    assert lines.dedup_lines(docs(spark, [])).count() == 0
    assert set(lines.dedup_lines(docs(spark, rows)).columns) >= {"th", "n", "fp"}


def test_patience_aligns_in_order():
    rng = random.Random(4)
    for _ in range(200):
        a, b = ([rng.randint(0, 9) for _ in range(rng.randint(0, 14))] for _ in range(2))
        got = lines.patience(a, b)
        assert all(a[i] == b[j] for i, j in got)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:]))
    assert lines.patience([1, 2, 3, 4], [9, 2, 3, 8]) == [(1, 1), (2, 2)]
    assert lines.patience([5] * 5, [5] * 3) == [(0, 0), (1, 1), (2, 2)]


# ---- token files


def test_token_files_read_back(spark):
    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    tok = tokenizers.Tokenizer.from_file(path)
    rows = [*ODD, (-5, "before zero"), (2**40, "far  away\n\n x")]
    out = token_files.fresh_path(spark, "t")
    token_files.write(docs(spark, rows), path, out, end_id=2)
    got = sorted(((r.doc_id is not None, r.doc_id or 0, r.start), r.n_tokens, r.ids_crc32) for r in token_files.read(spark, out).collect())
    at, expected = 0, []
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        expected.append(((d is not None, d or 0, at), len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        at += len(ids)
    assert got == sorted(expected)
    empty = token_files.fresh_path(spark, "t")
    token_files.write(docs(spark, []), path, empty, end_id=2)
    assert token_files.read(spark, empty).count() == 0


@pytest.mark.parametrize("values", [[], [0], [7] * 600, list(range(0, 90_000, 7)), [0, 2**63], [1, 1, 2, 2**40, 2**40]])
def test_elias_fano(values):
    x = elias_fano.EliasFano(elias_fano.encode(np.array(values, np.uint64)))
    assert x.all().tolist() == values and [x.select(i) for i in range(len(values))] == values


def test_block_reads_by_two_selects():
    ids = [np.arange(k, dtype=np.uint32) for k in (3, 0, 70_000, 1)]
    b = token_files.Block(token_files.pack(ids, [None, -(2**63), 5, 2**63 - 1]))
    assert b.doc_ids() == [None, -(2**63), 5, 2**63 - 1]
    assert all((b.ids(i) == ids[i]).all() for i in range(4)) and b.data.itemsize == 4


# ---- mixing


def test_mixing_fills_to_caps(spark):
    rng = random.Random(7)
    rows = [(i, "w " * rng.randint(0, 30), rng.choice(["a", "b", "b", "b", "b", "b", "c", None])) for i in range(600)] + [(None, None, "z"), (1, "", "z"), (7, "w w", "é"), (7, "w w", "é")]
    df = docs(spark, rows)
    got = mixing.mix(df).collect()
    size, of = {}, {}
    for r in got:
        size[r.source] = size.get(r.source, 0) + r["__size"]
        of[r.source] = r["__target"]
        assert r["__source_size"] >= r["__size"] and 0 <= r["__copies"] <= 2
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    total, open_, target = 1.5 * sum(size.values()), set(size), {}
    while True:
        level = (total - sum(target.values())) / sum(weight[s] for s in open_)
        over = {s for s in open_ if 2 * size[s] < level * weight[s]}
        if not over:
            break
        target |= {s: 2.0 * size[s] for s in over}
        open_ -= over
    target |= {s: level * weight[s] for s in open_}
    assert of == pytest.approx(target)
    for s in size:
        taken = sum(r["__size"] * r["__copies"] for r in got if r.source == s)
        assert abs(taken - target[s]) <= 30
    again = mixing.mix(docs(spark, rows, 5)).collect()
    key = lambda r: (str(r.doc_id), r.text or "", r["__copies"])
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert mixing.repeat(df).count() == sum(r["__copies"] for r in got) and mixing.repeat(df).columns == df.columns
    assert mixing.mix(docs(spark, [])).count() == 0


# ---- embeddings


def test_lattice_points_are_nearest():
    x = np.random.default_rng(0).standard_normal((500, 8)) * 2
    d = lattice.decode(x)
    assert ((((x - d)[:, None, :] - lattice.shortest()[None]) ** 2).sum(2).argmin(1) == 0).all()


@pytest.mark.parametrize("block", [2048, 16])
def test_lattice_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(lattice, "BLOCK", block)
    g = np.random.default_rng(4)
    rows, centres = [], g.standard_normal((6, 24))
    for i in range(240):
        v = centres[i % 6] + g.standard_normal(24) * (0.02 if i % 3 else 0.14)
        rows.append((i, v.tolist(), i % 2))
    rows += [(300, None, 1), (301, [0.0] * 24, 1), (302, [float("nan")] * 24, 1), (303, [1.0, None] * 12, 0), (304, [float("inf")] * 24, 0), (305, centres[0].tolist(), None), (306, [1.0] * 5, 0), (307, [1.0] * 5, 0), (308, [], 0)]
    rows += [(400 + k, rows[0][1], 0) for k in range(3)]
    df = spark.createDataFrame([(*r, "c", "n") for r in rows], "vec_id long, embedding array<double>, label int, cell string, node string").repartition(5)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in lattice.near_duplicates(df).collect()}
    ok = [r for r in rows if r[1] and r[2] is not None and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    links = {r[0]: set() for r in rows}
    for a in ok:
        for b in ok:
            if a[0] != b[0] and a[2] == b[2] and len(a[1]) == len(b[1]):
                u, v = np.array(a[1]), np.array(b[1])
                if u @ v / np.sqrt(u @ u) / np.sqrt(v @ v) >= 0.98:
                    links[a[0]].add(b[0])
    found, true = sum(n for n, _, _ in got.values()), sum(map(len, links.values()))
    assert true > 1000 and 0.97 * true <= found <= true
    assert all(got[i][0] <= len(links[i]) for i in links)
    assert all(got[i] == (0, i, True) for i in (300, 301, 302, 303, 304, 305, 308))
    assert got[306][1] == got[307][1] == 306 and got[307] == (1, 306, False)
    assert got[400][1] == got[0][1] and got[0][0] >= 3
    assert lattice.near_duplicates(df.where("false")).count() == 0


# ---- quality


def test_quality_counts(spark):
    rows = [*ODD, (30, "a b c a b c d\n\nx y\nx y\n  \n# $ | a"), (31, "Good words stand here, and more of them follow on. " * 9 + "\n" + " ".join(f"w{i}" for i in range(60)) + "."), (32, "HOME | NEWS | MORE\n" * 30 + " ".join(f"w{i}" for i in range(60)) + ".")]
    for r in quality.judge(docs(spark, rows)).collect():
        t, q = r.text or "", r["__q"]
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        full = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        win = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        many = {x for x in win if win.count(x) > 1} if len(win) < 3000 else set(win)
        rep = len({p for i, x in enumerate(win) if x in many for p in (i, i + 1, i + 2)})
        assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(full) - len(set(full)), rep), t[:40]
        assert q.base_failed == (len(w) < 50 or 100 * rep > 50 * len(w))
        assert q.kept <= (not q.base_failed)
    kept = {r.doc_id: r["__q"] for r in quality.judge(docs(spark, rows)).collect()}
    assert not kept[32].kept and "HOME" not in kept[32].clean
    assert quality.judge(docs(spark, [])).count() == 0


# ---- personal data

PATTERNS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def passes(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        v = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
        return 13 <= len(d) <= 19 and sum(x - 9 if x > 9 else x for x in v) % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def test_base_spans(spark):
    rng = random.Random(9)
    bits = ["a@b.c", "_d@e.f", "1.2.3.4", ".5.6.7.8", "300.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "+12 12", "😀", "é", "x@", "@y.z", "0" * 15, "token = \"9c9babcdef0123456789abcdef012345\"", "555-123-4567", "2024-01-02", " ", "007.1.2.3", "1.2.3.0000000000000000000009"]
    rows = [*ODD, *[(100 + k, "".join(rng.choice(bits) + rng.choice(["", " ", "\n", ", "]) for _ in range(rng.randint(1, 40)))) for k in range(80)], (999, "1.2.3.4 a@b.co " * 400)]
    found = pii.find(docs(spark, rows))
    got = sorted((str(r.doc_id), r.base_sha256, r.n_email, r.n_ip, r.n_card, r.n_phone) for r in pii.digest(found).collect())
    expected = []
    for d, t in rows:
        spans = [(k, m.start(), m.end()) for k, p in PATTERNS for m in re.finditer(p, t or "") if passes(k, m.group())]
        expected.append((str(d), hashlib.sha256(",".join(f"{k}:{a}:{z}" for k, a, z in spans).encode()).hexdigest(), *[sum(s[0] == k for s in spans) for k, _ in PATTERNS]))
    assert got == sorted(expected)
    for r in pii.digest(found).collect():
        kinds = [s.split(":")[0] for s in r.spans.split(",") if s]
        assert kinds == sorted(kinds, key=pii.KINDS.index)
    assert pii.digest(pii.find(docs(spark, []))).count() == 0


def test_very_long_runs(spark):
    texts = ["1" * 10**6, "1 " * 500_000, "a@b" + ".cb" * 300_000, "a-" * 400_000 + "b1", "1-1 " * 250_000, "aB1" * 300_000, "1." * 400_000, "+1 (" * 200_000, "a@" * 300_000]
    got = {r.doc_id: r for r in pii.digest(pii.find(docs(spark, list(enumerate(texts))))).collect()}
    counts = [(0, 0, 0, 0)] * len(texts)
    counts[2], counts[6] = (1, 0, 0, 0), (0, 100_000, 0, 0)
    assert [(got[k].n_email, got[k].n_ip, got[k].n_card, got[k].n_phone) for k in range(len(texts))] == counts
    assert got[2].spans == f"email:0:{len(texts[2])}" and got[5].spans in ("", f"secret:0:{len(texts[5])}")


def test_added_spans_of_planted_texts(spark):
    rng, rows, planted = random.Random(3), [], {}
    prose = lambda: " ".join(rng.choice(["and", "the", "of", "house", "12", "1999", "well-known", "3.5"]) for _ in range(rng.randint(20, 60)))
    for k in range(300):
        before, after = prose(), prose()
        if k % 3 == 0:
            x, lead, kind = "".join(rng.choice("0123456789abcdef") for _ in range(40)), ' token = "', "secret"
        elif k % 3 == 1:
            x, lead, kind = f"{rng.randint(200, 999)}-{rng.randint(200, 999)}-{rng.randint(1000, 9999)}", " phone: ", "number"
        else:
            x, lead, kind = "", " ", None
        rows.append((k, before + lead + x + ('" ' if kind == "secret" else ". ") + after))
        planted[k] = f"{kind}:{len(before + lead)}:{len(before + lead + x)}" if kind else ""
    got = {r.doc_id: r.spans for r in pii.digest(pii.find(docs(spark, rows))).collect()}
    caught = sum(planted[k] in got[k].split(",") for k in planted if planted[k])
    clean = sum(not got[k] for k in planted if not planted[k])
    assert caught >= 195 and clean >= 95


def test_training_tells_good_from_bad():
    rows = [{"kind": "secret", "v0": 1, "v1": 1, "v2": 1, "v3": 1, "f_len": 3, "f_digits": 1, "n": 40}, {"kind": "secret", "v0": -1, "v1": 0, "v2": 0, "v3": -1, "f_len": 2, "f_digits": 0, "n": 200}, {"kind": "secret", "v0": 1, "v1": 0, "v2": 0, "v3": 1, "f_len": 3, "f_digits": 1, "n": 15}]
    m = pii.train(rows)
    odds = lambda r: m.bias["secret"] + sum(m.weights["secret"][f][r[f]] for f in pii.FEATURES)
    assert odds(rows[0]) > 0 > odds(rows[1]) and odds(rows[2]) > 0 and 0 < m.share["secret"] < 0.5
    assert pii.train([]).weights == {}


def test_prefix_sums_over_chunks(spark):
    v = [(i * 37) % 11 for i in range(1000)]
    df = spark.createDataFrame([(v,), ([],)], "v array<long>")
    got = [r.p for r in df.select(pii.prefix(F.col("v")).alias("p")).collect()]
    assert got == [[sum(v[:i]) for i in range(1000)], []]


# ---- names and parameters


def test_clashing_names(spark):
    names = ["__d", "__th", "__gone", "__k", "__m", "__key", "__h", "__whole", "__limit", "__q", "__head", "a.b"]
    rows = [(1, "one two three four five\nx", "s", *range(12)), (2, "one two three four five\ny", None, *range(12)), (None, None, "s", *range(12))]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{n}` int" for n in names))
    keep = [F.col(f"`{n}`") for n in names if n != "__q"]
    for out in (lines.dedup_lines(df), mixing.mix(df), quality.judge(df)):
        assert [tuple(r) for r in out.select(*keep).collect()] == [tuple(i for i, n in enumerate(names) if n != "__q")] * 3
    assert {r.doc_id: r.text for r in lines.dedup_lines(df).collect()} == {1: rows[0][1], 2: "y", None: None}


def test_pipeline_stages_keep_clashing_columns(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    names = ["__d", "__q", "__head", "__key", "others", "a.b", "th"]
    prose = lambda k: "\n".join(" ".join(f"w{k}x{i}y{j}" for j in range(12)) + "." for i in range(8))
    rows = [(5, prose(1), "s"), (5, prose(2), None), (None, prose(3), "s"), (7, prose(4), "t"), (7, prose(4), "t")]
    df = spark.createDataFrame([(*r, *range(7)) for r in rows], "doc_id long, text string, source string, " + ", ".join(f"`{n}` int" for n in names))
    docs = df
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, "")
        assert docs.columns == df.columns and docs.dtypes == df.dtypes
        assert {tuple(r)[3:] for r in docs.collect()} == {tuple(range(7))}
    near = corpus_pipeline.near_stage(spark, df, "")
    assert sorted((r.doc_id or 0, r.text) for r in near.collect()) == sorted((d or 0, t) for d, t in {r[:2] for r in rows})


@pytest.mark.parametrize("bits", [0, 2, 4])
def test_links_of_long_lists_keep_to_their_bits(bits):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**32, 120, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, *[base[:60] ^ (np.uint64(1) << np.uint64(a)) ^ (np.uint64(1) << np.uint64(b)) for a, b in ((1, 7), (9, 30), (3, 4))], *[base[60:] ^ np.uint64(m) for m in (0b1111, 1 << 20, 0b10101 << 9)]]))
    label = list(range(len(fps)))
    for _ in fps:
        for i in range(len(fps)):
            for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= bits).tolist():
                label[i] = label[j] = min(label[i], label[j])
        if all(label[label[i]] == label[i] for i in range(len(fps))):
            break
    which = simhash.SETS.index((4, 5, 6, 7))
    simhash.PAIRED, was = 16, simhash.PAIRED
    try:
        a, b = simhash.links_of(which, fps, bits)
    finally:
        simhash.PAIRED = was
    got = dict(zip(a.tolist(), b.tolist()))
    assert [got.get(x, x) for x in fps.tolist()] == [int(fps[label[i]]) for i in range(len(fps))]
    with pytest.raises(ValueError):
        simhash.near_links(None, bits=1)
    with pytest.raises(ValueError):
        suffix.dedup_substrings(None, width=30)
