import random
import re
from itertools import combinations

import pytest

from lodestone.llm import components, line_dedup, ngram_join, pivots

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def closed(nodes, links):
    label = {n: n for n in nodes}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        label[b] = a
    return {n: root(n) for n in nodes}


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


@pytest.mark.parametrize("few", [4, 0])
def test_join_equals_brute_force(docs, rows, few, monkeypatch):
    monkeypatch.setattr(pivots, "FEW_PAIRS", few)  # 0: a part of the pairs is settled first
    sets = {r[0]: shingles(r[1]) for r in rows if r[0] is not None}
    links = [(a, b) for a, b in combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = closed(list(sets), links)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.joined(docs).collect()}
    assert got.pop(None) == (len(shingles("some words without an id here")), None)
    assert got == {k: (len(s), want[k]) for k, s in sets.items()}
    assert len(set(want.values())) < len(want) - 8


def test_join_of_nothing_and_of_repeated_ids(spark, empty):
    assert ngram_join.joined(empty).count() == 0
    twice = spark.createDataFrame([(5, "a b c d e f"), (5, "x y z u v w"), (3, "x y z u v w"), (2, "A b c d e f"), (None, "A b c d e f")], "doc_id long, text string")
    out = ngram_join.joined(twice).collect()
    assert len(out) == 5 and {(r["doc_id"], r["component_id"]) for r in out} == {(5, 2), (3, 2), (2, 2), (None, None)} and {r["n_shingles"] for r in out} == {2}


def test_components(spark):
    links = [(k, k + 1) for k in range(1, 40)] + [(100, k) for k in range(101, 130)] + [(200, 200), (7, 3), (3, 7), (None, 4)]
    df = spark.createDataFrame(links, "a long, b long")
    got = {r["node"]: r["label"] for r in components.components(df).collect()}
    assert got == {**{k: 1 for k in range(1, 41)}, **{k: 100 for k in range(100, 130)}, 200: 200}


def runs(line):
    """All runs of eight 16-bit units, or the whole of a shorter line."""
    wide = line.lower().encode("utf-16-be")
    return {wide[k : k + 16] for k in range(0, max(2, len(wide) - 14), 2)}


def alike(a, b):
    return 180 * len(a & b) >= 80 * (len(a) + len(b))


def test_sets_of_lines(spark):
    lines = ["Word and another", "a", "an_unbroken_word_of_many_letters x", "日本語のテキスト です 🎉a", "a\tb\u2028c d", "mixed日本 words日", "aaaaaaaaaaaaaaaaaaaa"]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    hashes = lambda x: {r[0] for r in spark.createDataFrame([(bytearray(y),) for y in x], "x binary").selectExpr("xxhash64(x)").collect()}
    got = df.select(line_dedup.shingle_set(df["line"]).alias("s")).collect()
    assert [set(r["s"]) for r in got] == [hashes(runs(x)) for x in lines] and all(len(set(r["s"])) == len(r["s"]) for r in got)


def test_bands_hold_any_six_of_eight():
    from itertools import combinations as some

    holds = lambda agree: any(set(b) <= set(agree) for b in line_dedup.BANDS)
    assert len(line_dedup.BANDS) == 14 and all(map(holds, some(range(8), 5))) and sum(map(holds, some(range(8), 4))) == 14
    assert {m >> 61 & 7 for m in line_dedup.MASKS} == set(range(8)) and all(-(1 << 63) <= m < 1 << 63 for m in line_dedup.MASKS)


def test_most_links_of_lines_are_found(spark):
    """Pairs of lines, each alike to no other: short and long ones with words changed at the end or within, and typos."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9)))
    pairs = {}
    for n in (5, 8, 12, 20, 100):
        for _ in range(400):
            base = [word() for _ in range(n)]
            new = list(base)
            for _ in range(max(1, n // 20)):
                at = rng.choice([0, n - 1, rng.randrange(n)])
                w = new[at]
                k = rng.randrange(len(w))
                new[at] = rng.choice([w[:k] + rng.choice("abcxyz") + w[k + 1 :], w[:k] + w[k + 1 :] or "q", w + rng.choice("abc"), word()])
            a, b = " ".join(base), " ".join(new)
            if a != b and alike(runs(a), runs(b)):
                pairs.setdefault(n, []).append((a, b))
    lines = [x for p in pairs.values() for pair in p for x in pair]
    gone = {r["doc_id"] for r in line_dedup.dropped(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()}
    at = 0
    for n, p in pairs.items():
        found = sum(at + 2 * k + 1 in gone for k in range(len(p)))
        assert len(p) >= 30 and found >= 0.93 * len(p), (n, found, len(p))
        at += 2 * len(p)
    assert all(k % 2 for k in gone)


def test_groups_of_lines_equal_brute_force_nearly(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(2, 9))) for _ in range(900)]
    lines = []
    for _ in range(120):
        base = rng.choices(words, k=rng.choice([6, 12, 25, 60, 200]))
        for _ in range(5):
            new = [rng.choice(words) if rng.random() < 0.02 else w for w in base]
            lines.append(" ".join(new))
    lines = list(dict.fromkeys(lines))
    sets = [runs(x) for x in lines]
    links = [(a, b) for a, b in combinations(range(len(lines)), 2) if alike(sets[a], sets[b])]
    gone = {(r["doc_id"], r["pos"]) for r in line_dedup.dropped(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()}
    label = closed(range(len(lines)), links)
    want = {(k, 0) for k in label if label[k] != k}
    assert len(links) > 150 and gone <= want and len(gone) >= 0.97 * len(want)


def test_lines_equal_brute_force(docs, rows):
    first = {}
    for doc, text in sorted((r[0], r[1]) for r in rows if r[0] is not None and r[1]):
        for k, line in enumerate(text.split("\n")):
            if line.strip(" \t\n\x0b\f\r"):
                first.setdefault(line.strip(" \t\n\x0b\f\r"), (doc, k))
    sets = {line: runs(line) for line in first}
    links = [(first[a], first[b]) for a, b in combinations(first, 2) if alike(sets[a], sets[b])]
    label = closed(sorted(first.values()), links)
    out = {r["doc_id"]: r for r in line_dedup.deduplicated(docs).collect()}
    for r in rows:
        if r[0] is None or r[1] is None:
            assert out[r[0]]["text"] == r[1] and out[r[0]]["n_dropped"] == 0
            continue
        kept = [x for k, x in enumerate(r[1].split("\n")) if not x.strip(" \t\n\x0b\f\r") or label[first[x.strip(" \t\n\x0b\f\r")]] == (r[0], k)]
        assert out[r[0]]["text"] == "\n".join(kept)
        assert out[r[0]]["n_dropped"] == len(r[1].split("\n")) - len(kept)
    assert len(links) >= 3


def test_lines_of_nothing_and_clashing_columns(spark, empty):
    assert line_dedup.deduplicated(empty).count() == 0
    df = spark.createDataFrame([(1, "same line here\nother", "x"), (2, "same line here\nsame line here", "y")], "doc_id long, text string, n_dropped string")
    assert {(r["doc_id"], r["text"], r["n_dropped"]) for r in line_dedup.deduplicated(df).collect()} == {(1, "same line here\nother", 0), (2, "", 2)}
