"""Chat formatting by columnar byte assembly.

Each turn becomes ``<|im_start|>role\\ntext<|im_end|>\\n``. A text's own control strings are
escaped: wherever ``<`` is followed by any number of backslashes and ``|``, one backslash is put after
the ``<``. So ``<|`` never stands in an escaped text, and taking one backslash away restores it.

Rows are sorted by conversation and turn within hash partitions and go through Python as
Arrow batches. For a batch, segment lengths, their running sums and scatter indices are numpy arrays,
and headers and texts are copied into one preallocated buffer that is the Arrow output. A
conversation that spans batches gives one row a batch, with part numbers, so neither a long nor a hot
conversation is ever held as a whole.

Defined results: null texts and roles count as empty; a newline or backslash in a role is
escaped; null conv_id is a conversation; equal turns are ordered by role and text; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = b"<|im_start|>", b"<|im_end|>\n"
TURN = re.compile(rb"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.S)
ESCAPED = re.compile(rb"<\\(\\*)\|")
LEARNED = b"assistant"
PARTS = "conv_id long, part long, n_turns long, formatted string, mask_start array<long>, mask_end array<long>"
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
#: Texts over this length are copied by slices, and indices are made for as many bytes at once.
BLOCK = 1 << 20


def scatter(out: np.ndarray, to: np.ndarray, src: np.ndarray, at: np.ndarray, n: np.ndarray) -> None:
    """Copy src[at:at+n] to out[to:] for all segments; indices are bounded by BLOCK."""
    for k in np.flatnonzero(n > BLOCK):
        out[to[k] : to[k] + n[k]] = src[at[k] : at[k] + n[k]]
    small = np.flatnonzero((n > 0) & (n <= BLOCK))
    ends = np.cumsum(n[small])
    lo = 0
    while lo < len(small):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + BLOCK, "right")))
        ks = small[lo:hi]
        run = n[ks]
        first = np.cumsum(run) - run
        step = np.arange(int(run.sum())) - np.repeat(first, run)
        out[np.repeat(to[ks], run) + step] = src[np.repeat(at[ks], run) + step]
        lo = hi


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n+1 offsets, nulls as empty."""
    col = col.fill_null("").cast(pa.large_string())
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def escape(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets after a backslash went behind each ``<`` that starts a control string."""
    lt = np.flatnonzero(data == ord("<"))
    if not lt.size:
        return data, offsets
    solid = np.append(np.flatnonzero(data != ord("\\")), len(data))
    after = solid[np.searchsorted(solid, lt + 1)]
    row = np.searchsorted(offsets, lt, "right") - 1
    hit = (after < offsets[row + 1]) & (np.append(data, 0)[after] == ord("|"))
    lt, row = lt[hit], row[hit]
    grown = np.bincount(row, minlength=len(offsets) - 1)
    return np.insert(data, lt + 1, ord("\\")), offsets + np.append(0, np.cumsum(grown))


def role_header(role: str | None) -> bytes:
    raw = (role or "").encode().replace(b"\\", b"\\\\").replace(b"\n", b"\\n")
    return START + raw.replace(b"<|", b"<\\p") + b"\n"


def role_of(raw: bytes) -> bytes:
    return re.sub(rb"\\(.)", lambda m: {b"n": b"\n", b"p": b"|"}.get(m[1], m[1]), raw)


def format_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, part = None, 0
    for b in batches:
        if not b.num_rows:
            continue
        conv = b.column("conv_id")
        ids = conv.fill_null(0).to_numpy(zero_copy_only=False)
        null = conv.is_null().to_numpy(zero_copy_only=False)
        data, off = escape(*text_bytes(b.column("text")))
        roles = b.column("role").fill_null("").dictionary_encode()
        code = roles.indices.to_numpy(zero_copy_only=False)
        heads = [role_header(r) for r in roles.dictionary.to_pylist()]
        learned = np.array([r.encode() == LEARNED for r in roles.dictionary.to_pylist()])[code]
        head_len = np.array([len(h) for h in heads], np.int64)
        head_at = np.cumsum(head_len) - head_len
        fixed = np.frombuffer(b"".join(heads) + END, np.uint8)
        n = len(code)
        n_head, n_text = head_len[code], np.diff(off)
        width = n_head + n_text + len(END)
        ends = np.cumsum(width)
        starts = ends - width
        out = np.empty(int(ends[-1]), np.uint8)
        scatter(out, starts, fixed, head_at[code], n_head)
        scatter(out, starts + n_head, data, off[:-1], n_text)
        scatter(out, ends - len(END), fixed, np.full(n, len(fixed) - len(END)), np.full(n, len(END)))
        first = np.flatnonzero(np.append(True, (ids[1:] != ids[:-1]) | (null[1:] != null[:-1])))
        bounds = np.append(first, n)
        points = np.append(0, np.cumsum((out & 0xC0) != 0x80))
        base = points[starts[first]][np.repeat(np.arange(len(first)), np.diff(bounds))]
        mask_from = (points[starts + n_head] - base)[learned]
        mask_to = (points[ends - len(END)] - base)[learned]
        mask_off = np.append(0, np.cumsum(learned))[bounds].astype(np.int32)
        keys = [None if null[k] else int(ids[k]) for k in first]
        part = part + 1 if last == (keys[0],) else 0
        parts = [part, *[0] * (len(keys) - 1)]
        part, last = parts[-1], (keys[-1],)
        formatted = pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(np.append(starts[first], ends[-1])), pa.py_buffer(out)])
        lists = [pa.ListArray.from_arrays(pa.array(mask_off), pa.array(x)) for x in (mask_from, mask_to)]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(parts, pa.int64()), pa.array(np.diff(bounds)), formatted.cast(pa.string()), *lists], ["conv_id", "part", "n_turns", "formatted", "mask_start", "mask_end"])


def format_chat(turns: DataFrame, conv_id="conv_id", turn="turn", role="role", text="text") -> DataFrame:
    """One row per conversation and part: the formatted text and the loss mask in code points of it."""
    rows = turns.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.select("conv_id", "role", "text").mapInArrow(format_batches, PARTS)


def unescape(raw: bytes) -> bytes:
    return ESCAPED.sub(rb"<\1|", raw) if b"<\\" in raw else raw


def digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now = None

    def closed() -> list:
        return [now["id"], now["turns"], now["all"].hexdigest(), now["loss_chars"], now["loss"].hexdigest(), now["chars"]]

    names = [x.split()[0] for x in DIGEST.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    table = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types, strict=True)], names)
    for b in batches:
        done = []
        for r in b.to_pylist():
            if now is None or now["id"] != r["conv_id"]:
                if now:
                    done.append(closed())
                now = {"id": r["conv_id"], "turns": 0, "all": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0}
            text = r["formatted"]
            now["chars"] += len(text)
            for role, said in TURN.findall(text.encode()):
                now["turns"] += 1
                now["all"].update(role_of(role) + b"\n" + unescape(said) + b"\n")
            for a, z in zip(r["mask_start"], r["mask_end"], strict=True):
                raw = unescape(text[a:z].encode())
                now["loss"].update(raw)
                now["loss_chars"] += len(raw.decode())
        if done:
            yield table(done)
    if now:
        yield table([closed()])


def digest(formatted: DataFrame) -> DataFrame:
    """Per conversation, counts and digests read back from the formatted parts, in their order."""
    return formatted.mapInArrow(digest_batches, DIGEST)
