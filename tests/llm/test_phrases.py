import hashlib
import random
import re

import pytest

from lodestone.llm import phrases

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ITEMS = [(1, "one two three four five six seven eight nine ten eleven"), (2, "Short ITEM-here"), (3, ""), (4, None), (None, "no id for this item"), (10, "one two three four five six seven eight nine ten"), (5, "a a a a a a a a a a a a"), (6, "…!? ."), (7, "naïve Ünï 日本語"), (8, "short item HERE")]
TEXTS = ["x one, two three four FIVE six seven eight nine ten eleven y", "one two three four five six seven eight nine ten", "one two three four five six seven eight nine", "short item", "item here short item here short item here",
         "a " * 30, "", None, "§$%", "NAÏVE ünï", "naïve Ünï 日本語", "ten eleven one two three", "short", "item here"]


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def expected(text, items):
    own, hit, found = words(text), set(), set()
    for item, body in items:
        w = words(body)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if item is not None and w else 0):
            for at in range(len(own) - n + 1):
                if own[at : at + n] == w[k : k + n]:
                    hit |= set(range(at, at + n))
                    found.add(str(item))
    return len(own), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("segment_words", [1, 12, 1 << 20])
def test_contamination_equals_brute_force(spark, segment_words, monkeypatch):
    monkeypatch.setattr(phrases.index_of, "__defaults__", (segment_words,))
    rng = random.Random(5)
    texts = TEXTS + [" ".join(rng.choices("one two three a short item here".split(), k=rng.choice([5, 60]))) for _ in range(30)] + ["one two three four five six seven eight nine ten eleven " * 3000]
    rows = [(k if k % 9 else None, x, "clash") for k, x in enumerate(texts)] + [(3, TEXTS[0], "clash")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_hit string").repartition(3)
    items = spark.createDataFrame([(*i, 7) for i in ITEMS], "item_id long, text string, doc_id int")
    got = sorted((str(r[0]), *r[1:]) for r in phrases.contamination(docs, items).collect())
    assert got == sorted((str(d), *expected(x, ITEMS)) for d, x, _ in rows)
    assert sum(r[-1] for r in got) > 8


def test_contamination_of_nothing(spark, docs, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert phrases.contamination(empty, some).count() == 0
    out = phrases.contamination(docs, none)
    assert out.count() == docs.count() and out.where("n_hit > 0 OR contaminated OR n_items > 0").count() == 0


def test_phrases_and_nearby_words(spark):
    rng = random.Random(8)
    texts = {k: rng.choices("a b c d e".split(), k=rng.choice([0, 3, 40])) for k in range(40)}
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in texts.items()], "doc_id long, text string").repartition(2)
    asked = {1: ["a", "b"], 2: ["a", "b", "a"], 3: ["c"], 4: ["e", "zzz"], 5: ["d", "d", "e"]}
    index = phrases.index_of(docs, 50)
    frame = spark.createDataFrame(list(asked.items()), "phrase long, terms array<string>")
    want = {(p, k, at) for p, t in asked.items() for k, w in texts.items() for at in range(len(w)) if w[at : at + len(t)] == t}
    assert {tuple(r) for r in phrases.occurrences(index, frame).collect()} == want and len(want) > 20
    holds = lambda part, t: all(part.count(x) >= t.count(x) for x in t)
    near = set()
    for p, t in asked.items():
        for k, w in texts.items():
            spans = [(i, j) for i in range(len(w)) for j in range(i, min(len(w), i + 4)) if holds(w[i : j + 1], t)]
            near |= {(p, k, i, j) for i, j in spans if not any((x, y) != (i, j) and i <= x and y <= j for x, y in spans)}
    assert {tuple(r) for r in phrases.nearby(index, frame, 4).collect()} == near and len(near) > 20
