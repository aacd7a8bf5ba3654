import hashlib
import heapq
import math
import random
import re
import zlib

import numpy as np

from lodestone.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def grams(text, n=1):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(w), [" ".join(w[k : k + m]) for m in range(1, n + 1) for k in range(len(w) - m + 1)]


def expected(rows, target, percent, least, buckets, n):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    count = lambda texts: np.bincount([bucket(f) for x in texts for f in grams(x, n)[1]], minlength=buckets)
    s, t = count([r[1] for r in rows]), count(target)
    gain = [math.floor(1000 * math.log((b + 1) * (s.sum() + buckets) / ((a + 1) * (t.sum() + buckets)))) for a, b in zip(s, t, strict=True)]
    out = []
    for doc, text in rows:
        size, f = grams(text, n)
        weight = math.floor(sum(gain[bucket(x)] for x in f) / len(f)) if f else 0
        h = int(hashlib.sha256(f"2024:{doc}".encode()).hexdigest()[:8], 16)
        score = None if doc is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))
        out.append([doc, len(f), weight, score, None, size])
    eligible = sorted((r for r in out if r[5] >= least and r[0] is not None), key=lambda r: (-r[3], r[0], r[1]))
    for k, r in enumerate(eligible[: percent * len(eligible) // 100]):
        r[4] = k + 1
    return sorted(map(str, (r[:5] for r in out)))


def test_draw_equals_brute_force(spark, rows, monkeypatch):
    monkeypatch.setattr(resampling, "RANGE", 7)
    rng = random.Random(4)
    some = [(r[0], r[1]) for r in rows] + [(7000 + k, " ".join(rng.choices("alpha beta gamma Delta été x1".split(), k=30))) for k in range(60)]
    some += [(5555, "the same row many times over " * 6)] * 25 + [(8000, "very long " * 40_000), (8001, None), (8002, "")]
    docs = spark.createDataFrame([(*r, "x") for r in some], "doc_id long, text string, score string").repartition(5)
    target = ["alpha beta alpha", None, "Delta the same", ""]
    frame = spark.createDataFrame([(x,) for x in target], "text string")
    for percent, n in ((10, 1), (100, 1), (50, 2), (0, 1)):
        got = sorted(str(list(r)) for r in resampling.resampled(docs, frame, percent=percent, ngrams=n, buckets=97).collect())
        assert got == expected(some, target, percent, 20, 97, n)


def test_draw_from_nothing(spark, docs, empty):
    assert resampling.resampled(empty, docs).count() == 0
    out = resampling.resampled(docs, empty)
    assert out.count() == docs.count() and out.where("rank IS NOT NULL").count() > 3


def blocks(runs, size):
    cut = [resampling.Block([np.array([x[k] for x in run[i : i + size]], np.int64) for k in range(5)]) for run in runs for i in range(0, len(run), size)]
    return sorted(cut, key=lambda b: b.key(0))


def test_merge_takes_blocks_late_and_stops():
    rng = random.Random(2)
    runs = [sorted((rng.randrange(50), rng.randrange(50), 0, rng.randrange(10**6), k) for _ in range(rng.choice([1, 30, 100]))) for k in range(37)]
    want = list(heapq.merge(*runs))
    for most in (0, 1, 400, len(want), len(want) + 9):
        taken = []
        given = (taken.append(b) or b for b in blocks(runs, 8))
        got = [tuple(int(x[i]) for x in part) for part in resampling.merged(given, most) for i in range(len(part[0]))]
        assert [g[:4] for g in got] == [w[:4] for w in want[:most]]
        if 0 < most < len(want):
            assert all(b.key(0) <= want[most][:4] for b in taken[:-2])  # but one that waits, and the one before
