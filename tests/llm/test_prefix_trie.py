import hashlib
import random
import zlib

from lodestone.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def rebuilt(rows):
    own = {}
    key = lambda r: (r[1] is not None, r[1] or 0)
    for r in sorted((r for r in rows if r[0] is not None), key=key):
        own.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    return out


def expected(talks):
    nodes = {}
    for c, turns in talks.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    children, leaves, saved = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for p in nodes:
        if p:
            children[p[:-1]] += 1
    for p, members in nodes.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(members) - 1) * len(p[-1][1].encode()) if p else 0
    ends = {}
    for c in sorted(talks):
        ends.setdefault(tuple(talks[c]), []).append(str(c))
    sha = lambda p: hashlib.sha256(",".join(ends.get(p, [])).encode()).hexdigest()
    return sorted((min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], sha(p)) for p, m in nodes.items())


def order(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0], r[1], r[-1]))


def conversations(rng):
    texts = ["hello", "hello there", "ünï", "", None, "a long text " * 50]
    rows = [(c, t, rng.choice(["user", "assistant"]), rng.choice(texts)) for c in range(120) for t in range(rng.randint(1, 9))]
    rows += [(c, t, "user", "all alike") for c in range(200, 260) for t in range(6)]  # one conversation many times
    rows += [(c, t, "user", "a common start" if t < 2 else f"{rng.randrange(3)}") for c in range(300, 380) for t in range(7)]
    rows += [(995, t, "user", f"turn {t}") for t in range(400)]  # a long one
    return rows + [(996, None, None, None), (996, 5, "user", "x"), (None, 1, "user", "no id"), (17, 100, "user", "last"), (17, 101, "user", "last")]


def test_trie_equals_brute_force(spark):
    rows = conversations(random.Random(6))
    frame = spark.createDataFrame([(*r, "x") for r in rows], f"{SCHEMA}, n_convs string")
    want = order(expected(rebuilt(rows)))
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "4", "23"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
            assert order(prefix_trie.prefix_trie(frame.repartition(3)).collect()) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(want) > 500 and max(r[3] for r in want[1:]) >= 60


def test_any_cut_of_sorted_sequences_gives_the_same_trie():
    """Ranges cut anywhere, and put together again, without Spark."""
    rng = random.Random(1)
    for _ in range(60):
        paths = sorted({tuple(rng.choices("abc", k=rng.randrange(6))) for _ in range(rng.randint(1, 25))})
        talks = {100 + k: [("", x) for x in p] for k, p in enumerate(rng.sample(paths, len(paths)))}
        talks |= {300 + k: talks[rng.choice(list(talks))] for k in range(8)}
        name = lambda p: b"".join(x[1].encode().ljust(prefix_trie.DIGEST) for x in p)
        of = {}
        for c in sorted(talks):
            of.setdefault(name(talks[c]), []).append(c)
        own = []
        for path, cs in sorted(of.items()):
            sizes = [1] * (len(path) // prefix_trie.DIGEST)
            own.append((path, sizes, [(len(sizes), len(cs), cs[0], 0, 0, 0, hashlib.sha256(",".join(map(str, cs)).encode()).hexdigest())]))
        cuts = sorted(rng.sample(range(1, len(own)), min(rng.randrange(6), len(own) - 1))) if len(own) > 1 else []
        held, opened = [], []
        for a, b in zip([0, *cuts], [*cuts, len(own)], strict=True):
            part = prefix_trie.Range(True)
            for s in own[a:b]:
                part.sequence(*s)
            part.end()
            held += part.held
            opened += part.open
        whole = prefix_trie.Range(False)
        for s in sorted(opened, key=lambda x: x[0]):
            whole.sequence(*s)
        whole.end()
        conv = {h[1]: h[2][0] for h in whole.held if h[1] is not None}
        out = [(*h[2], h[3]) if h[0] == "node" else (*h[2][:2], conv[h[1]], *h[2][3:], h[3]) for h in held + whole.held]
        assert order(out) == order(expected(talks))


def test_trie_of_nothing(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert prefix_trie.prefix_trie(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)).count() == 0
