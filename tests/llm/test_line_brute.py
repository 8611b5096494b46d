"""Line dedup against a plain version over all documents, on random ones with lines that repeat within and across them."""

import random

import pytest

from netdensity.llm import lines

BLANKS = " \t\n\x0b\x0c\r"


def corpus(seed):
    rng = random.Random(seed)
    long = [f"line {k} of a text with words" for k in range(14)]
    short = ["yes", "no", "a b", "Menu", ""]
    texts = []
    for _ in range(45):
        rows = [rng.choice(long) if rng.random() < 0.7 else rng.choice(short) for _ in range(rng.randrange(12))]
        texts.append("\n".join(r + " " * (rng.random() < 0.1) for r in rows))
    texts += [rng.choice(texts) for _ in range(6)]  # whole copies
    texts += ["\n".join(rng.choice(texts).split("\n")[1:]) for _ in range(6)]  # copies without their first line
    rng.shuffle(texts)
    return list(zip(rng.sample(range(1000), len(texts)), texts))


def evidence(text):
    return [(i, r.strip(BLANKS)) for i, r in enumerate(text.split("\n")) if len(r.split()) >= 5]


def plain(docs):
    """The lines of five words or more that go from each document: every place meets the earlier holders of its line, one after the other."""
    holders = {}
    for d in sorted(docs):
        for i, line in evidence(docs[d]):
            holders.setdefault(line, {}).setdefault(d, []).append(i)
    gone = {d: set() for d in docs}
    for d, text in docs.items():
        left = {}
        for i, line in evidence(text):
            left.setdefault(line, []).append(i)
        earlier = {line: [o for o in holders[line] if o < d] for line in left}
        tried = dict.fromkeys(left, 0)
        first = True
        while left:
            meetings, at = {}, {}
            for line, places in left.items():
                rest = earlier[line][tried[line] :]
                # At first all places meet the earliest holder; afterwards each meets a place of its own.
                own = rest[:1] * len(places) if first else [o for o in rest for _ in holders[line][o]]
                for i, o in zip(places, own):
                    meetings.setdefault(o, []).append((i, line))
                    at[line] = earlier[line].index(o) + 1
            for o, mine in meetings.items():
                mine.sort()
                asked = {line for _, line in mine}
                theirs = [line for _, line in evidence(docs[o]) if line in asked]
                gone[d] |= {mine[i][0] for i, _ in lines.patience([line for _, line in mine], theirs)}
            tried |= at
            left = {line: rest for line, places in left.items() if line in at and (rest := [i for i in places if i not in gone[d]])}
            first = False
        if text.split() and any(docs[o] == text for o in docs if o < d):
            gone[d] |= {i for i, _ in evidence(text)}
    return gone


@pytest.mark.parametrize("seed", [1, 2])
def test_same_lines_as_the_plain_version(spark, seed):
    rows = corpus(seed)
    docs = dict(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    ranges = {r.d: [i for x in r.gone for i in range(x.a, x.z)] for r in lines.deletions(df).collect()}
    want = plain(docs)
    assert sum(map(len, want.values())) > 150
    for d, text in docs.items():
        went = ranges.get(d, [])
        assert len(went) == len(set(went))
        assert {i for i, _ in evidence(text)} & set(went) == want[d], d
        split = text.split("\n")
        before = {" ".join(x.split()) for o in docs if o < d for x in docs[o].split("\n")}
        assert all(" ".join(split[i].split()) in before or not split[i].strip(BLANKS) for i in went)
    # What dedup_lines leaves is the text without those lines.
    for r in lines.dedup_lines(df).collect():
        went = set(ranges.get(r.doc_id, []))
        assert r.text == "\n".join(x for i, x in enumerate(docs[r.doc_id].split("\n")) if i not in went)
        assert r["__n_removed"] == len(went)
