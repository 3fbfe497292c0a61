import hashlib
import random
import re

import pytest

from tessel.llm.components import connected_components
from tessel.llm.common import Scratch
from tessel.llm.exact_dedup import ContentTable, exact_dedup, grace
from tessel.llm.near_dedup import near_dedup, spanning_links


def test_exact_against_brute_force(spark, documents):
    rng = random.Random(1)
    texts = [rng.choice(["", "a", "b" * 3000, "é漢", "long " * 500]) for _ in range(300)] + [None, None]
    rows = [*enumerate(texts), (None, "a"), (None, "only null id"), (7, texts[7]), (9, "another text under a repeated id")]
    groups = {}
    for doc, text in rows:
        groups.setdefault(text or "", []).append(doc)
    got = sorted(map(str, exact_dedup(spark, documents(rows), memory_bytes=20_000).collect()))
    want = []
    for doc, text in rows:
        own = groups[text or ""]
        keep = max((d for d in own if d is not None), default=None)
        want.append((doc, keep, len(own), doc == keep, hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(f"Row(doc_id={a}, keep_id={b}, group_size={c}, kept={d}, text_sha256='{e}')" for a, b, c, d, e in want)


def test_exact_in_two_steps_for_hot_texts(spark, documents):
    rng = random.Random(21)
    rows = [(i, "hot" if i % 3 else rng.choice(["warm", "b", f"only {i}", "c" * 400])) for i in range(600)] + [(None, "hot"), (None, None), (601, "")]
    key = lambda r: (str(r["doc_id"]), r["keep_id"], r["group_size"], r["kept"], r["text_sha256"])
    one = sorted(map(str, map(key, exact_dedup(spark, documents(rows).repartition(5), memory_bytes=2_000).collect())))
    two = sorted(map(str, map(key, exact_dedup(spark, documents(rows).repartition(5), memory_bytes=2_000, hot_blocks=1).collect())))
    assert one == two and len(one) == len(rows)


def test_exact_empty_table(spark, documents):
    assert exact_dedup(spark, documents([])).collect() == []


def test_content_table_compares_contents():
    table = ContentTable(2)
    entries = [table.find(5, bytes([i % 7])) for i in range(50)]  # one fingerprint for all
    assert [e for e, _ in entries] == [i % 7 for i in range(50)]
    assert sum(new for _, new in entries) == 7


@pytest.mark.parametrize("memory", [200, 5_000, 10**9])
def test_grace_at_any_memory(memory, tmp_path):
    rng = random.Random(2)
    contents = [str(rng.randrange(40)).encode() * 50 for _ in range(500)]
    rows = [(str(i), hashlib.sha256(c).hexdigest(), i, 1, c) for i, c in enumerate(contents)]
    found = sorted(sorted(int(m[0]) for m in g) for g in grace(iter(rows), memory, folder=str(tmp_path)))
    want = {}
    for i, c in enumerate(contents):
        want.setdefault(c, []).append(i)
    assert found == sorted(want.values())
    assert not list(tmp_path.iterdir())


def _near_brute(rows, k, share):
    sets = {}
    for i, (_, text) in enumerate(rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= share * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        comp = min(ids, default=None)
        out.append((doc, len(sets[i]), comp, doc == comp))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [2048, 6])
def test_near_against_brute_force(spark, documents, block):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for base in range(12):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([3, 5, 40, 160]))]
        for _ in range(rng.choice([1, 3, 12])):
            copy = list(words)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(copy).upper() if rng.random() < 0.3 else "\t".join(copy)))
    rows += [(900, None), (901, ""), (902, " \n"), (903, "one"), (904, "ONE"), (None, "one"), (905, rows[0][1]), (905, rows[0][1]), (906, "x " * 30_000)]
    rng.shuffle(rows)
    got = [tuple(r) for r in near_dedup(spark, documents(rows), k=4, share=80, block=block).collect()]
    assert sorted(got, key=str) == _near_brute(rows, 4, 80)


def test_near_empty_table(spark, documents):
    assert near_dedup(spark, documents([])).collect() == []


def test_spanning_links_keep_all_components():
    import numpy as np

    sets = [np.arange(a, a + 20, dtype=np.uint64) for a in (0, 1, 2, 3, 100, 101, 300)]
    links = spanning_links(sets, 80)
    assert len(links) == 4 and {frozenset(x) for x in links} <= {frozenset((i, j)) for i in range(4) for j in range(4)} | {frozenset((4, 5))}


def test_components_of_a_long_path_and_a_star(spark):
    rng = random.Random(4)
    names = list(range(60))
    rng.shuffle(names)
    links = [(names[i], names[i + 1]) for i in range(59)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5, 5), (None, 3)]
    df = spark.createDataFrame(links, "a long, b long")
    got = {r["node"]: r["root"] for r in connected_components(spark, Scratch(spark, "test"), df, "t").collect()}
    assert got == {**{i: 0 for i in range(60)}, **{1000 + i: 1000 for i in range(50)}}


def test_near_pairs_at_the_edge_are_all_found(spark, documents):
    """Pairs at a similarity of 0.8 to 0.84 over their shingles, and as many at 0.6 that must not be linked."""
    rng = random.Random(22)
    rows, want = [], {}
    for i in range(300):
        w = [f"w{rng.randrange(10**9)}" for _ in range(104)]
        cut = 11 if i % 2 else 25  # words replaced at the end, each of which takes a shingle
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(w[:-cut] + [f"v{rng.randrange(10**9)}" for _ in range(cut)]))]
        shared, union = 101 - cut, 101 + cut
        want[2 * i + 1] = 2 * i if 100 * shared >= 80 * union else 2 * i + 1
    got = {r["doc_id"]: r["component_id"] for r in near_dedup(spark, documents(rows), k=4, share=80).collect()}
    assert {d: got[d] for d in want} == want and set(want.values()) - set(want)


@pytest.mark.parametrize("limits", [dict(group=2), dict(block_shingles=300), dict(group=1, block=3)])
def test_near_is_the_same_at_any_bounds(spark, documents, limits):
    rng = random.Random(23)
    base = [[f"w{rng.randrange(500)}" for _ in range(60)] for _ in range(6)]
    rows = []
    for i in range(120):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            w[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    assert sorted((tuple(r) for r in near_dedup(spark, documents(rows), k=4, **limits).collect()), key=str) == _near_brute(rows, 4, 80)
