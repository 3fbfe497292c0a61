import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from pyspark.sql import functions as F

from tessel.llm import importance, pii
from tessel.llm.importance import BUCKETS, byte_grams, gumbel, importance_sample, kth_largest
from tessel.llm.interpolated_lm import contexts, fit_weights, interpolated_scores


def _labelled(spark, documents, n=600):
    rng = random.Random(8)
    syllables = ["ta", "re", "mo", "lin", "sha", "ve", "ko", "bu"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    rows, labels = [], []
    for i in range(n):
        w = [word() for _ in range(rng.randint(20, 120))]
        low, toxic = i % 5 == 1, i % 7 == 3
        if low:
            w = [x.upper() + "!!" for x in w]
        if toxic:
            w[rng.randrange(len(w))] = "vileword"
        rows.append((i, " ".join(w)))
        labels.append((i, int(not low), int(toxic)))
    return rows, labels


def test_importance_keeps_clean_and_drops_the_rest(spark, documents):
    rows, labels = _labelled(spark, documents)
    more = [(9000, None), (9001, ""), (None, rows[0][1]), (9002, "abc")]
    known = spark.createDataFrame([*labels[:450], (None, 1, 0), (5000, None, 1)], "doc_id long, quality int, toxic int")
    df = documents(rows + more, "n_grams int, log_weight string, sample_key int")
    got = importance_sample(spark, df, known).collect()
    assert len(got) == len(rows) + 4
    kept = {r["doc_id"]: r["kept"] for r in got}
    assert not kept[9000] and not kept[9001]
    clean = [kept[i] for i, q, t in labels[450:] if q and not t]
    bad = [kept[i] for i, q, t in labels[450:] if not q or t]
    assert np.mean(clean) > 0.9 and np.mean(bad) < 0.1
    drawn = importance_sample(spark, df, known, rows=True)
    assert drawn.columns == df.columns
    assert sorted(str(r["doc_id"]) for r in drawn.collect()) == sorted(str(r["doc_id"]) for r in got if r["kept"])


def test_importance_draws_exactly_k(spark, documents):
    rows, labels = _labelled(spark, documents, 200)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert importance_sample(spark, documents(rows), known, k=37).where("kept").count() == 37
    assert importance_sample(spark, documents([]), known).collect() == []
    assert importance_sample(spark, documents(rows[:5]), known.limit(0)).where("kept").count() == 5


def test_importance_keeps_clean_texts_of_any_length(spark, documents):
    rng = random.Random(13)
    letters = "abcdefghiklmnoprstuv"
    known_words = ["".join(rng.choice(letters) for _ in range(rng.randint(3, 8))) for _ in range(400)]

    def clean(n):  # a few words are new to the model
        return [rng.choice(known_words) if rng.random() < 0.97 else "".join(rng.choice(letters) for _ in range(6)) for _ in range(n)]

    sizes = {0: 12, 1: 60, 2: 250, 3: 2500}
    rows, labels = [], []
    for i in range(900):
        bad = i % 6 == 5
        w = clean(sizes[i % 3])
        if bad:
            w = ["zq" + x[::-1].upper() for x in w] if i % 12 == 5 else [*w[: len(w) // 2], "vile", *w[len(w) // 2 :]]
        rows.append((i, " ".join(w)))
        labels.append((i, int(not (bad and i % 12 == 5)), int(bad and i % 12 != 5)))
    fresh = [(10_000 + i, " ".join(clean(sizes[i % 4]))) for i in range(160)]
    got = importance_sample(spark, documents(rows + fresh), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    kept = {r["doc_id"]: r["kept"] for r in got}
    shares = {n: np.mean([kept[10_000 + i] for i in range(160) if sizes[i % 4] == n]) for n in sizes.values()}
    assert min(shares.values()) > 0.8, shares
    assert np.mean([kept[i] for i, q, t in labels if not q or t]) < 0.2


def test_log_ratios_against_brute_force(spark, documents):
    """Counts of every n-gram of every text by a plain walk, both models from them, and each text's sum."""
    rows, labels = _labelled(spark, documents, 300)
    rows += [(9001, "short"), (9002, ""), (9003, None), (9004, "x" * 200_000), (5, rows[5][1]), (None, rows[7][1])]
    known = labels[:250]
    grams = lambda t: [(t or "").encode()[i : i + 6] for i in range(len((t or "").encode()) - 5)]
    slot = lambda g: int(byte_grams(np.frombuffer(g, np.uint8), np.array([0, 6]))[0][0])
    ids = spark.createDataFrame([(i,) for i, _, _ in known], "id long").select("id", F.expr("pmod(xxhash64(id, 7), 6) = 0").alias("apart")).collect()
    apart = {r["id"] for r in ids if r["apart"]}
    sort = {i: "good" if q and not t else "rest" for i, q, t in known if i not in apart}
    every, good, rest = Counter(), Counter(), Counter()
    for doc, text in rows:
        own = Counter(slot(g) for g in grams(text))
        every += own
        if doc in sort:
            (good if sort[doc] == "good" else rest).update(own)
    total = sum(every.values()) + 1e-3 * BUCKETS
    weight = 0.1 * (sum(good.values()) + sum(rest.values())) + 1

    def ratio(b):
        base = (every[b] + 1e-3) / total
        target = (good[b] + weight * base) / (sum(good.values()) + weight)
        raw = (good[b] + rest[b] + weight * base) / (sum(good.values()) + sum(rest.values()) + weight)
        return math.log(target / raw)

    got = importance_sample(spark, documents(rows), spark.createDataFrame(known, "doc_id long, quality int, toxic int")).collect()
    want = sorted((str(doc), len(grams(text)), sum(ratio(slot(g)) for g in grams(text))) for doc, text in rows)
    for g, w in zip(sorted(((str(r["doc_id"]), r["n_grams"], r["log_ratio"]) for r in got)), want, strict=True):
        assert g[:2] == w[:2] and math.isclose(g[2], w[2], rel_tol=1e-4, abs_tol=1e-3), (g, w)
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[9001]["log_weight"] == 0 and by_id[9001]["n_grams"] == 0
    assert by_id[9002]["log_weight"] is None and by_id[9003]["log_weight"] is None
    assert len({r["sample_key"] for r in got if r["doc_id"] == 5}) == 1


def test_the_draw_is_gumbel_top_k(spark, documents):
    """Keys are weight over temperature plus noise, and the k largest of them are kept; ties stay."""
    rows, labels = _labelled(spark, documents, 200)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = importance_sample(spark, documents(rows + [(3, rows[3][1])]), known, k=50, temperature=2.0).collect()
    noise = {r["id"]: r["g"] for r in spark.createDataFrame([(i,) for i, _ in rows], "id long").select("id", gumbel(F.col("id"), 1).alias("g")).collect()}
    for r in got:
        assert math.isclose(r["sample_key"], r["log_weight"] / 2.0 + noise[r["doc_id"]], rel_tol=1e-9, abs_tol=1e-9)
    ranked = sorted((r["sample_key"] for r in got), reverse=True)
    assert all(r["kept"] == (r["sample_key"] >= ranked[49]) for r in got)


def test_two_sums_equal_one(spark, documents, monkeypatch):
    rows, labels = _labelled(spark, documents, 200)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    one = {r["doc_id"]: r["log_ratio"] for r in importance_sample(spark, documents(rows).repartition(7), known).collect()}
    monkeypatch.setattr(importance, "input_bytes", lambda _: 9 * importance.SUMMED_BYTES)
    two = {r["doc_id"]: r["log_ratio"] for r in importance_sample(spark, documents(rows).repartition(7), known).collect()}
    assert one == two


def test_kth_largest(spark):
    rng = random.Random(9)
    values = [rng.gauss(0, 1) for _ in range(2000)] + [0.5] * 300 + [1e9, -1e9]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
    ranked = sorted(values, reverse=True)
    for k in (1, 2, 700, 800, 2302):
        assert kth_largest(df, "x", k) == ranked[k - 1]
    assert kth_largest(df, "x", 3000) is None


def test_scores_against_brute_force(spark, documents):
    rng = random.Random(10)
    rows = [(i, " ".join(rng.choice(["The", "cat", "sat", "on", "mat", f"w{i % 40}"]) for _ in range(rng.randrange(40)))) for i in range(250)]
    rows += [(900, None), (901, ""), (902, "word " * 20_000), (None, "null id"), (3, rows[3][1])]
    tokens = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()) + [None] for _, t in rows]
    part = [zlib.crc32(str(d).encode() if d is not None else b"") % 10 for d, _ in rows]
    c, c2 = Counter(), Counter()
    core, core2 = Counter(), Counter()
    for w, p in zip(tokens, part, strict=True):
        pairs = list(zip([None, *w[:-1]], w, strict=True))
        if p:
            c.update(w)
            c2.update(pairs)
        if p > 1:
            core.update(w)
            core2.update(pairs)
    n, v = sum(c.values()), len(c)
    bucket = lambda x: min(math.ceil(math.log2(x + 1)), 15)
    held = Counter((bucket(core[a]), core2[a, b], core[a], core[b]) for w, p in zip(tokens, part, strict=True) if p == 1 for a, b in zip([None, *w[:-1]], w, strict=True))
    df = spark.createDataFrame([(*k, m) for k, m in held.items()], "b int, vw long, v long, w long, n long")
    weights = fit_weights(df, n, v)
    want = []
    for (doc, _), w, p in zip(rows, tokens, part, strict=True):
        base = sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        score = 0.0
        for a, b in zip([None, *w[:-1]], w, strict=True):
            l2, l1, l0 = weights[bucket(c[a])]
            score += math.log10((l2 * c2[a, b] / c[a] if c[a] else 0) + l1 * c[b] / n + l0 / (v + 1))
        want.append((str(doc), p == 0, len(w), sum(c[x] > 0 for x in w), n, base, score))
    got = interpolated_scores(spark, documents(rows), chunks=5).collect()
    assert len(got) == len(want)
    for g, x in zip(sorted((str(r[0]), *r[1:]) for r in got), sorted(want), strict=True):
        assert g[:5] == x[:5] and math.isclose(g[5], x[5], rel_tol=1e-9) and math.isclose(g[6], x[6], rel_tol=1e-9)
    assert interpolated_scores(spark, documents([])).collect() == []


def test_weights_are_probabilities_and_raise_the_likelihood(spark):
    rows = [(1, 1, 1, 3, 5), (1, 0, 1, 2, 9), (3, 4, 6, 2, 7), (0, 0, 0, 1, 3), (3, 0, 5, 0, 1)]
    weights = fit_weights(spark.createDataFrame(rows, "b int, vw long, v long, w long, n long"), 50, 12)
    assert all(abs(sum(w) - 1) < 1e-5 and min(w) >= 0 for w in weights.values()) and weights[0][0] == 0
    loss = lambda of: sum(n * math.log(of[b][0] * vw / max(v, 1) + of[b][1] * w / 50 + of[b][2] / 13) for b, vw, v, w, n in rows)
    start = {b: (0.0, 0.9, 0.1) if b == 0 else (0.3, 0.6, 0.1) for b in range(16)}
    assert loss(weights) > loss(start)


def test_context_buckets_have_no_cap(spark):
    assert contexts(np.array([0, 1, 2, 3, 4, 16_383, 16_384, 32_767, 32_768, 1 << 33])).tolist() == [0, 1, 2, 2, 3, 14, 15, 15, 16, 34]
    rows = [(15, 9000, 20_000, 30, 50), (17, 3, 100_000, 60_000, 70), (34, 5, 1 << 33, 1 << 32, 90)]
    weights = fit_weights(spark.createDataFrame(rows, "b int, vw long, v long, w long, n long"), 1 << 34, 1000)
    assert set(weights) == set(range(36)) and len({weights[b] for b in (15, 17, 34)}) == 3


def _luhn(digits):
    return sum(int(c) * (1 + i % 2) - 9 * (int(c) * (1 + i % 2) > 9) for i, c in enumerate(reversed(digits))) % 10 == 0


def _rules(text):
    digits = lambda m: re.sub("[^0-9]", "", m)
    return [
        [f"{kind}:{m.start()}:{m.end()}" for m in re.finditer(pattern, text) if good(m.group())]
        for kind, pattern, good in (
            ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
            ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
            ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and _luhn(digits(m))),
            ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
        )
    ]


def test_rule_spans_against_the_patterns(spark, documents):
    rng = random.Random(11)
    texts = ["".join(rng.choice("ab.@@..1239-- +()%_é😀") for _ in range(rng.randrange(60))) for _ in range(1500)]
    texts += ["a@b.c_d@e.f", "a@b@c.d.", "1.2.3.4.5.6.7.8", "256.1.1.1 0255.001.1.1", "4111 1111 1111 1111-", "4111-1111-1111-1111 4", "+1 (275) 555-2469 +49 30 1234567890123"]
    texts += ["x" * 50_000, "1" * 30_000, "a.b." * 20_000, "1 " * 20_000, "1.2." * 10_000 + "@" + "a.b" * 5_000, None, "", "a@b.c"]
    rows = [*enumerate(texts), (None, "a@b.cd")]
    got = {r["doc_id"]: r for r in pii.personal_data(spark, documents(rows, "plain string, numeric int, body string")).collect()}
    for doc, text in rows:
        want = _rules(text or "")
        assert [len(w) for w in want] == [got[doc][f"n_{k}"] for k in pii.KINDS], (doc, text)
        assert got[doc]["base_sha256"] == hashlib.sha256(",".join(sum(want, [])).encode()).hexdigest()
        assert set(sum(want, [])) <= set(filter(None, got[doc]["spans"].split(",")))
    assert pii.personal_data(spark, documents([])).collect() == []


def test_candidates_that_look_like_rule_spans_are_added(spark, documents):
    rng = random.Random(12)
    rows = []
    for i in range(400):
        number = f"({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"
        kind = i % 4
        text = {0: f"please call tel +1 {number} now", 1: f"order 555-{rng.randint(100, 999)}-{rng.randint(1000, 9999)}x and 2024-{rng.randint(100, 999)} 17", 2: f"codes 12 {rng.randint(100, 999)} 77 {rng.randint(1000, 9999)} end", 3: "no numbers"}[kind]
        rows.append((i, text))
    found = pii.personal_data(spark, documents(rows)).collect()
    assert all(r["n_phone"] == (r["doc_id"] % 4 == 0) for r in found)
    assert not any(r["n_added"] for r in found if r["doc_id"] % 4 in (2, 3))


def test_repeated_rows_have_the_same_spans(spark, documents):
    rows = [(1, "a@b.c and 1.2.3.4"), (1, "a@b.c and 1.2.3.4"), (1, "+1 275 555 2469"), (None, None), (None, None)]
    got = sorted((str(r["doc_id"]), r["spans"]) for r in pii.personal_data(spark, documents(rows)).collect())
    assert got == [("1", "email:0:5,ip:10:17"), ("1", "email:0:5,ip:10:17"), ("1", "phone:0:15"), ("None", ""), ("None", "")]


MASKED = ["jane.doe at example.com", "jane@example(dot)com", "jane@example [dot] com", "jane@example dot com", "jane at example dot com", "jane (at) example (dot) com"]


def test_gates_let_every_candidate_through():
    java = lambda p: p.replace("++", "+")
    for text in [x for x in MASKED if re.search(java(pii.GENERATORS["email"]), x)]:
        assert re.search(java(pii.NEEDS["email"]), text), text
    assert sum(bool(re.search(java(pii.GENERATORS["email"]), x)) for x in MASKED) == len(MASKED)


def test_masked_emails_and_national_phones_are_added(spark, documents):
    rng = random.Random(14)
    rows = []
    for i in range(300):
        number = f"({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"
        rows.append((i, [f"we wrote to some.{i}@mail{i % 7}.example.com then", f"here +1 {number} was told", f"on 2024-{i % 12 + 1:02d}-11 we paid 12 {rng.randint(100, 999)} 77, look at noon. Then go"][i % 3]))
    masked = [(1000 + i, f"so {x} it is") for i, x in enumerate(MASKED)]
    phones = [(2000, "(555) 123-4567"), (2001, "then (555) 123-4567 again"), (2002, "or 555-123-4567 too")]
    none = [(3000, "we look at noon. Then it is over"), (3001, "on 2024-03-11 we paid 12 345 77"), (3002, "visit us at example.com")]
    found = {r["doc_id"]: r for r in pii.personal_data(spark, documents(rows + masked + phones + none)).collect()}
    for doc, text in masked:
        assert [x["found"] for x in found[doc]["found"] if x["kind"] == "email"] == [text[3:-6]], text
    for doc, text in phones:
        assert [x["found"] for x in found[doc]["found"] if x["kind"] == "phone"] == [re.search(r"\(?555.*[0-9]", text).group()], text
    assert not any(found[doc]["n_added"] for doc, _ in none)


def test_every_document_is_learned_from(spark, documents):
    # just as many rule spans as a kind needs, spread over a large table: each one left out leaves the kind without a model
    rows = [(i, f"the host 10.0.{i // 2000}.7 is up" if i % 2000 == 0 else "no numbers") for i in range(30_000)]
    found = pii.personal_data(spark, documents([*rows, (30_000, "the host 10.0.1[.]7 is up")])).where("n_added > 0 or n_ip > 0").collect()
    assert sorted(r["doc_id"] for r in found if r["n_ip"]) == list(range(0, 30_000, 2000))
    assert [(r["doc_id"], r["spans"]) for r in found if r["n_added"]] == [(30_000, "ip:9:19")]


def test_rare_counter_examples_let_no_more_pass_in_larger_tables(spark, documents):
    # counter-examples are over thirty, but so few beside the rule spans that taking all of them keeps the precision
    rows = [(i, f"we pay by card {4000 + i} 1111 1111 {next(x for x in range(1000, 1010) if _luhn(f'{4000 + i}11111111{x}'))} now") for i in range(900)]
    other = [(1000 + i, f"sum of 96293805678{x} ok") for i, x in enumerate(x for x in range(10, 40) if not _luhn(f"96293805678{x}"))][:20]
    masked = [(2000, "call (963) 555-1408 4111111111111111 so"), (2001, "we pay by card 4111.1111.1111.1111 now")]
    found = {r["doc_id"]: r for r in pii.personal_data(spark, documents(rows + other + masked)).collect()}
    assert all(r["n_card"] == (doc < 1000) for doc, r in found.items())
    assert {doc: r["spans"] for doc, r in found.items() if r["n_added"]} == {2000: "card:20:36", 2001: "card:15:34"}


def test_boosting_separates_and_calibrates():
    cells = [((d, s, 1, 0, 1, 1, 2), 50.0 if d > 8 else 1.0, 1.0 if d > 8 else 40.0) for d in range(4, 14) for s in range(3)]
    model = pii.boosted(cells)
    score = lambda f: model[0] + sum(pii.tree_value(t, f) for t in model[1])
    assert min(score(f) for f, p, n in cells if p > n) > max(score(f) for f, p, n in cells if p < n)
    cut = pii.threshold(cells, model, 0.95)
    assert all((score(f) >= cut) == (p > n) for f, p, n in cells)
