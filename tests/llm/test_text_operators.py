"""Text operators against brute force, and on odd inputs."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridloom.llm import decontaminate, html_extract, interpolation, langid, near_dedup, packing, pii, rlz_dedup, textkern, topk, toxicity

DIR = "/root/testdata/sf0.001"


# -- 1: substring dedup ------------------------------------------------------------------


def windows_removed(rows: list[tuple[int, str]], n: int = 20) -> dict[int, tuple]:
    seen, out = set(), {}
    for d, text in sorted(rows, key=lambda r: r[0]):
        w = (text or "").encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            k = tuple(w[i : i + n])
            if k in seen:
                gone[i : i + n] = [True] * n
            seen.add(k)
        left = [x for x, g in zip(w, gone) if not g]
        out[d] = (len(w), len(w) - len(left), hashlib.sha256(b" ".join(left)).hexdigest())
    return out


def test_substring_dedup_brute_force(spark, small):
    rng = random.Random(1)
    made = [(i, " ".join(rng.choice("abc") for _ in range(rng.randrange(0, 90)))) for i in range(60)]
    for rows, n in ((made, 4), ([(r["doc_id"], r["text"]) for r in small.collect()], 20)):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rlz_dedup.substring_dedup(df, n).collect()}
        assert got == windows_removed(rows, n)
        for hot in (1, 3):  # split blocks give the same
            assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rlz_dedup.substring_dedup(df, n, hot).collect()} == got
        if n == 20:
            break


def thue_morse(n: int, a: str, b: str) -> str:
    return "".join(a if bin(i).count("1") % 2 else b for i in range(n))


def test_words_of_one_polynomial_hash_differ(spark):
    words = [f"w{i}" for i in range(19)]
    rows = [(1, " ".join([*words, thue_morse(2048, "a", "b")])), (2, " ".join([*words, thue_morse(2048, "b", "a")])), (3, " ".join([*words, thue_morse(2048, "a", "b")]))]
    got = {r["doc_id"]: r["n_removed"] for r in rlz_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 0, 3: 20}


def test_longest_earlier_factors():
    rng = np.random.default_rng(1)
    for _ in range(20):
        lengths = rng.integers(1, 40, 6)
        end = np.repeat(np.cumsum(lengths), lengths)
        number, block = rng.integers(0, 3, lengths.sum()), np.repeat([0, 0, 0, 1, 1, 1], lengths)
        index = rlz_dedup.Index(number, block, np.arange(len(number)), end)
        for p in range(len(number)):
            best = 0
            for q in range(p):
                if block[q] == block[p]:
                    n = 0
                    while p + n < end[p] and q + n < end[q] and number[p + n] == number[q + n]:
                        n += 1
                    best = max(best, n)
            assert index.longest[p] == best
        start, stop = index.parse(np.cumsum(lengths) - lengths)
        assert (start[1:] == stop[:-1]).all() and stop[-1] == len(number)


def test_factors_point_to_equal_earlier_text(spark):
    words = [str(i) for i in range(60)]
    rows = [(1, " ".join(words)), (2, "x y " + " ".join(words[10:50]) + " z"), (3, " ".join(words[5:40]))]
    found = rlz_dedup.factors(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    text = {d: t.split() for d, t in rows}
    assert found
    for f in found:
        assert (f["ref_id"], f["ref_start"]) < (f["id"], f["start"]) and f["n_words"] >= 20
        assert text[f["id"]][f["start"] : f["start"] + f["n_words"]] == text[f["ref_id"]][f["ref_start"] : f["ref_start"] + f["n_words"]]


def test_substring_dedup_odd(odd, none, wide):
    got = rlz_dedup.substring_dedup(odd).collect()
    assert len(got) == odd.count()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append((r["n_words"], r["n_removed"]))
    assert by[2] == [(0, 0)] and by[1] == [(0, 0)] and by[8][0][1] == 30_000 - 1
    # the text repeats every seven words; of identical rows neither start is earlier
    assert Counter(by[10]) == Counter({(28, 21): 2, (6, 0): 1})
    assert rlz_dedup.substring_dedup(none).count() == 0 and rlz_dedup.substring_dedup(wide).count() == odd.count()


# -- 2: language-model scores ------------------------------------------------------------


def tokens(text):
    return [*(text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))).split(), None]


def test_interpolation_brute_force(small):
    rows = {r["doc_id"]: tokens(r["text"]) for r in small.collect()}
    part = {d: zlib.crc32(str(d).encode()) % 10 for d in rows}
    got = {r["doc_id"]: r for r in interpolation.scores(small, 1 << 16, 1 << 16).collect()}

    def count(parts):
        one, two, n = Counter(), Counter(), 0
        for d, t in rows.items():
            if part[d] in parts:
                n += 1
                one.update(t)
                two.update(zip(["<s>", *t[:-1]], t))
        total = sum(one.values())
        one["<s>"] = n
        return one, two, total

    one, two, n = count(set(range(1, 10)))
    vocabulary = len(one) - 1
    rest, pairs, m = count(set(range(2, 10)))
    bucket = lambda c: 1 + int(math.log2(c)) if c else 0
    seen: dict[int, Counter] = {}
    for d, t in rows.items():
        if part[d] == 1:
            for c, w in zip(["<s>", *t[:-1]], t):
                seen.setdefault(bucket(rest[c]), Counter())[pairs[c, w] / max(1, rest[c]), rest[w] / m] += 1
    weights = {}
    for b, cells in seen.items():
        p = np.array([[*k, 1 / (vocabulary + 1)] for k in cells])
        k, lam = np.array(list(cells.values())), np.full(3, 1 / 3)
        for _ in range(interpolation.EM_ROUNDS):
            share = lam * p
            share *= (k / share.sum(1))[:, None]
            lam = share.sum(0) / share.sum()
        weights[b] = lam
    compared = 0
    for d, t in rows.items():
        r = got[d]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(t), sum(one[w] > 0 for w in t), n, part[d] == 0)
        assert math.isclose(r["base_score"], sum(math.log10((one[w] + 0.1) / (n + 0.1 * (vocabulary + 1))) for w in t), rel_tol=1e-9)
        want = 0.0
        for c, w in zip(["<s>", *t[:-1]], t):
            lam = weights.get(bucket(one[c]))
            if lam is None:
                break
            want += math.log10(lam[0] * two[c, w] / max(1, one[c]) + lam[1] * one[w] / n + lam[2] / (vocabulary + 1))
        else:
            compared += 1
            assert abs(r["score"] - want) < 0.01 * len(t)
    assert compared > 50
    held = [d for d in rows if part[d] == 0]
    assert sum(got[d]["score"] for d in held) > sum(got[d]["base_score"] for d in held)


def test_interpolation_sums_to_one():
    w = interpolation.learn(np.array([[3, 8, 16, 10], [3, -1, 40, 5], [0, -1, 24, 7]]), 99)
    assert np.allclose(w.sum(1), 1) and (w > 0).all()


def test_interpolation_odd(odd, none, wide):
    got = interpolation.scores(odd).collect()
    assert len(got) == odd.count() and all(math.isfinite(r["score"]) and r["score"] <= 0 for r in got)
    assert interpolation.scores(none).count() == 0 and interpolation.scores(wide).count() == odd.count()


@pytest.mark.parametrize("values", [[], [0], [255, 1], [256], [1 << 20], [1 << 40, 3]])
def test_packed_counts_round_trip(values):
    v = np.array(values, np.int64)
    assert (interpolation._unpacked(interpolation._packed(v), len(v)) == v).all()


def test_packed_keys_round_trip():
    k = np.unique(np.random.default_rng(0).integers(1 << 62, (1 << 63) - 1, 500, dtype=np.uint64))
    assert (interpolation._unpack_keys(interpolation._pack_keys(k, 1 << 61), 1 << 61) == k).all()


# -- 3 and 6: classifiers ----------------------------------------------------------------


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = toxicity.toxicity(spark.read.parquet(f"{d}/documents.parquet"), labels)
    held = got.join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] == r["toxic"] for r in held]) > 0.95
    assert sum(r["predicted"] for r in held) > 0 and all(0 <= r["score"] <= 1 for r in held)


def test_machine_learns_a_pair():
    """Two terms that are harmless alone and count together: no additive model fits this."""
    rng = np.random.default_rng(3)
    x = rng.random((800, 6)) < 0.5
    y = (x[:, 0] * x[:, 1]).astype(float)
    row, at = np.nonzero(x)
    m = toxicity.train(row, at, y, np.arange(6), rounds=400)
    assert ((m.score(len(x), row, at) >= 0.5) == y).mean() > 0.99


def test_terms_that_count_only_together(spark):
    """Through fit(): toxic if just one of two words occurs, or one of some marked words.
    Neither word differs by label alone."""
    rng = random.Random(4)
    rows = []
    for i in range(3000):
        words = [f"w{rng.randrange(400)}" for _ in range(30)]
        a, b, marked = rng.random() < 0.5, rng.random() < 0.5, rng.random() < 0.05
        words += ["mention"] * a + ["insult"] * b + [f"marked{rng.randrange(3)}"] * marked
        rng.shuffle(words)
        rows.append((i, " ".join(words), int(a != b or marked)))
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    data, off = textkern.buffers(pa.array([r[1] for r in rows]))
    row, bucket = toxicity._distinct(*toxicity._terms(data, off))
    z = toxicity.single_z(np.searchsorted(row, np.arange(len(rows) + 1)), bucket, np.array([r[2] for r in rows], float))
    words = toxicity._terms(*textkern.buffers(pa.array(["mention insult"])))[1][:2]
    assert (np.abs(z[words]) < 4).all()
    machine = toxicity.fit(docs, labels)
    assert set(words.tolist()) <= set(machine.inputs.tolist())
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs, labels).collect()}
    held = [(got[i]["predicted"], y) for i, _, y in rows if got[i]["held_out"]]
    assert np.mean([p == y for p, y in held]) > 0.95


def test_toxicity_scores_by_definition(spark, small):
    """Scores of whole texts against the sum over all single terms and pairs."""
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    m = toxicity.fit(small, labels)
    at = {b: i for i, b in enumerate(m.inputs.tolist())}
    got = {r["doc_id"]: r["score"] for r in toxicity.toxicity(small, labels).collect()}
    for r in small.collect():
        terms = sorted({at[b] for b in toxicity._terms(*textkern.buffers(pa.array([(r["text"] or "").lower()])))[1].tolist() if b in at})
        z = m.bias + sum(m.weight[i] for i in terms) + sum(m.factor[i] @ m.factor[j] for k, i in enumerate(terms) for j in terms[:k])
        assert math.isclose(got[r["doc_id"]], 1 / (1 + math.exp(-min(max(z, -30), 30))), rel_tol=1e-6, abs_tol=1e-9)


def test_toxicity_odd(spark, odd, none, wide):
    labels = spark.createDataFrame([(4, 1), (5, 0), (7, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity.toxicity(odd, labels).collect()
    assert len(got) == odd.count()
    assert toxicity.toxicity(none, labels).count() == 0 and toxicity.toxicity(odd, labels.limit(0)).select("score").distinct().count() == 1
    assert toxicity.clean(wide, labels).columns == wide.columns


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = langid.language_id(docs).join(docs, "doc_id").where("held_out").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in held]) > 0.98


def test_language_backoff():
    m = langid.Model(["a", "b"], {(0, "known"): {0: 9}, (3, "xyz"): {1: 5}, (1, "q"): {0: 3}}, {(0, 0): 9, (3, 1): 5, (1, 0): 3}, {(0, 0): 1, (3, 1): 1, (1, 0): 1})
    got, score = m.predict(pa.array(["known", "axyzb", "q", "", "known axyzb q known"]))
    assert got == ["a", "b", "a", "und", "a"] and score[3] == 0.0


def test_language_brute_force(spark, small):
    """Against counts and scores taken word by word from the whole sample."""
    letters = lambda t: re.findall(r"[^\W\d_]+", (t or "").lower())
    rows = small.collect()
    train = [r for r in rows if r["lang"] and zlib.crc32(str(r["doc_id"]).encode()) % 5]
    langs = sorted({r["lang"] for r in train})
    counts = {n: {x: Counter() for x in langs} for n in range(6)}
    for r in train:
        for w in letters(r["text"]):
            for n in range(6):
                counts[n][r["lang"]].update([w] if not n else langid.grams(w, n))
    kinds = {n: 1 + max(len(c) for c in counts[n].values()) for n in counts}
    part = lambda n, g: np.array([math.log((counts[n][x][g] + 0.05) / (sum(counts[n][x].values()) + 0.05 * kinds[n])) for x in langs]) if any(counts[n][x][g] for x in langs) else None
    got = {r["doc_id"]: r for r in langid.language_id(small).collect()}
    for r in rows[::4]:
        words = letters(r["text"])[:3000]
        if len(letters(r["text"])) > 3000:
            continue
        total = np.zeros(len(langs))
        for w in words:
            v = part(0, w)
            for n in (5, 4, 3, 2, 1):
                if v is None:
                    hits = [x for g in langid.grams(w, n) if (x := part(n, g)) is not None]
                    v = np.mean(hits, axis=0) if hits else None
            total += 0 if v is None else v
        total /= math.sqrt(max(1, len(words)))
        p = np.exp(total - total.max())
        want = ("und", 0.0) if not words else (langs[int(p.argmax())], float(p.max() / p.sum()))
        assert got[r["doc_id"]]["lang_pred"] == want[0] and math.isclose(got[r["doc_id"]]["score"], want[1], rel_tol=1e-4), r["doc_id"]


def test_signs_of_numbers_are_no_letters(spark, small):
    docs = small.select("doc_id", "text", "lang").unionByName(spark.createDataFrame([(-1, "\u00bd \u00b2 \u2460 \u216b 12 _", None), (-2, "\u00e9", None)], "doc_id long, text string, lang string"))
    got = {r["doc_id"]: r for r in langid.language_id(docs).where("doc_id < 0").collect()}
    assert (got[-1]["lang_pred"], got[-1]["score"]) == ("und", 0.0) and got[-2]["lang_pred"] != "und"


def test_language_of_many(spark):
    """More than 64 languages, and one with more than 30,000 words and 10,000 n-grams."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    name = lambda k: letters[k // 676 % 26] + letters[k // 26 % 26] + letters[k % 26]
    rows = [(k, f"l{k % 90:02d}", f"{name(k % 90)}one {name(k % 90)}two") for k in range(900)]
    rows.append((10_001, "big", " ".join("q" + name(k // 17) + name(k) for k in range(40_000))))
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    model = langid.fit(docs, parts=1_000_003)
    assert len(model.langs) == 91 and len(model.key[0]) == 40_000 + 180
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs, model).collect()}
    assert got == {k: lang for k, lang, _ in rows}


def test_language_odd(odd, none, wide):
    got = {}
    for r in langid.language_id(odd).collect():
        got.setdefault(r["doc_id"], []).append(r["lang_pred"])
    assert got[1] == got[2] == got[3] == ["und"] and len(got[10]) == 3
    assert langid.language_id(none).count() == 0 and langid.language_id(wide).count() == odd.count()
    assert {r["lang_pred"] for r in langid.language_id(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


# -- 4: top-k ----------------------------------------------------------------------------


def test_topk_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 8) / 4]) for i in range(400)]
    rows += [(400, None), (401, [None] * 8), (402, [float("nan")] * 8), (403, [float("inf")] * 8), (None, [1.0] * 8), (404, [1.0, 1.0]), (450, [0.5, 0.25]), (405, []), (7, [0.25] * 8), (50, [0.9] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    sound = [(i, tuple(math.floor(256 * float(np.float32(x))) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    ask = {}
    for i, v in rows:
        if i is not None and i % 50 == 0 and (i, tuple(math.floor(256 * float(np.float32(x))) for x in (v or []) if x is not None)) in sound:
            ask[i] = min(ask.get(i, (9e9,)), tuple(math.floor(256 * float(np.float32(x))) for x in v))
    want = []
    for q, v in ask.items():
        best = sorted(((-sum(a * b for a, b in zip(v, w)), i) for i, w in sound if i != q and len(w) == len(v)))[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    for shard in (10_000, 64):
        got = [tuple(r) for r in topk.top_k(df, shard=shard).collect()]
        assert sorted(got) == sorted(want)
    assert topk.top_k(df.limit(0)).count() == 0
    for name in ("id", "v", "shard", "query", "floor", "dim", "rank", "score", "query_id"):
        df = df.withColumn(name, F.lit(1))
    assert sorted(tuple(r) for r in topk.top_k(df).collect()) == sorted(want)


@pytest.mark.parametrize("scale", [1000.0, 3e6, 1e12, 1e300])
def test_topk_of_large_components(scale):
    """Scores that float64 cannot hold are exact too, in 64 bits and beyond."""
    rng = np.random.default_rng(12)
    n, dim = 3000, 16
    raw = rng.normal(0, scale, (n, dim))
    raw[1::7] = raw[::7][: len(raw[1::7])]  # ties
    x = topk._matrix(pa.array(list(raw), pa.list_(pa.float64())), dim)
    whole = np.array([[int(v) for v in r] for r in x], object)
    if scale < 1e300:
        assert (whole == np.array([[math.floor(256 * v) for v in r] for r in raw.tolist()], object)).all()
    tree, ask = topk.Tree(np.arange(n), x), np.arange(0, n, 300)
    at, row, _ = tree.search(ask, x[ask], np.full(len(ask), -(1 << 62)), 5)
    for i, q in enumerate(ask.tolist()):
        score = whole @ whole[q]
        assert row[at == i].tolist() == sorted((j for j in range(n) if j != q), key=lambda j: (-score[j], j))[:5]


# -- 5: near-duplicates ------------------------------------------------------------------


def j_p(a: Counter, b: Counter) -> float:
    return sum(1 / sum(max(a[y] / a[x], b[y] / b[x]) for y in a.keys() | b.keys()) for x in a.keys() & b.keys())


def test_probability_jaccard():
    rng = random.Random(6)
    for _ in range(50):
        a, b = (Counter(rng.choices(range(12), k=rng.randrange(1, 30))) for _ in range(2))
        got = near_dedup.probability_jaccard(*((np.array(sorted(c)), np.array([c[k] for k in sorted(c)])) for c in (a, b)))
        assert math.isclose(got, j_p(a, b), rel_tol=1e-9, abs_tol=1e-12)


def test_signatures_estimate_it():
    a, b = Counter(dict.fromkeys(range(0, 100), 1) | {3: 9}), Counter(dict.fromkeys(range(20, 120), 1) | {30: 7})
    row = np.repeat([0, 1], [sum(a.values()), sum(b.values())])
    gram = textkern.mix(np.array([*a.elements(), *b.elements()], np.uint64))
    sig, some = near_dedup.signatures(row, gram, 3, 4000)
    assert some.tolist() == [True, True, False]
    assert abs((sig[0] == sig[1]).mean() - j_p(a, b)) < 0.03


def groups(df) -> dict:
    return {r["doc_id"]: r["class_id"] for r in df.collect()}


def test_near_duplicates_brute_force(spark):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(500)]
    base = [[rng.choice(vocabulary) for _ in range(120)] for _ in range(8)]
    rows = []
    for b in base:
        for _ in range(30):
            t = list(b)
            for _ in range(rng.randrange(0, 5)):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            rows.append(t)
    rng.shuffle(rows)
    shingle = [Counter(tuple(t[i : i + 5]) for i in range(len(t) - 4)) for t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if len(shingle[i].keys() & shingle[j].keys()) > 50 and j_p(shingle[i], shingle[j]) >= 0.8:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(rows)], "doc_id long, text string")
    for small in (16, 2):
        assert groups(near_dedup.classes(df, small=small)) == {i: find(i) for i in range(len(rows))}


def test_near_duplicates_of_a_table_against_all_pairs(spark):
    """Classes equal those of all pairs with a similarity of 0.8 or more."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    held = {}
    for r in docs.collect():
        w = (r["text"] or "").encode().split()
        if w:
            held[r["doc_id"]] = Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))
    ids, total = sorted(held), {d: sum(c.values()) for d, c in held.items()}
    places: dict = {}
    for d in ids:
        for g in held[d]:
            places.setdefault(g, []).append(d)
    root = {d: d for d in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    number = {g: i for i, g in enumerate(places)}

    def packed(d):
        got = sorted((number[g], n) for g, n in held[d].items())
        return np.array([g for g, _ in got]), np.array([n for _, n in got])

    links = 0
    for d in ids:
        common: Counter = Counter()
        for g, n in held[d].items():
            for e in places[g]:
                if e < d:
                    common[e] += n
        for e, n in common.items():
            if n >= 0.8 * total[d] and near_dedup.probability_jaccard(packed(d), packed(e)) >= 0.8 - 1e-12:  # tested above
                links += 1
                x, y = find(d), find(e)
                root[max(x, y)] = min(x, y)
    assert links > 50
    got = groups(near_dedup.classes(docs))
    assert {d: got[d] for d in ids} == {d: find(d) for d in ids}


def test_unlike_texts_under_one_id(spark):
    """One document for classes(), two texts for clean()."""
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    df = spark.createDataFrame([(1, a), (1, b), (2, a), (3, b), (3, b), (4, None), (4, None)], "doc_id long, text string")
    assert {(r["doc_id"], r["class_id"]) for r in near_dedup.classes(df).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4)}
    assert sorted((r["doc_id"], r["text"]) for r in near_dedup.clean(df).where("text is not null").collect()) == [(1, a), (1, b)] and near_dedup.clean(df).where("text is null").count() == 2


@pytest.mark.parametrize("block", [near_dedup.BLOCK, 20_000])
def test_large_buckets_of_many_classes(spark, block):
    passage = [f"p{k}" for k in range(60)]
    texts = []
    for g in range(60):
        own = [f"g{g}w{k}" for k in range(25)]
        texts += [" ".join(passage + own), " ".join(passage + own[:-1] + ["other"])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert groups(near_dedup.classes(docs, bands=5, rows=1, block=block)) == {i: i - i % 2 for i in range(len(texts))}


def test_bound_of_common_mass():
    rng = np.random.default_rng(4)
    for _ in range(50):
        a, b = (Counter(rng.integers(0, 12, rng.integers(1, 40)).tolist()) for _ in range(2))
        cells = sorted((g, r, n) for r, c in enumerate((a, b)) for g, n in c.items())
        col, row, weight = (np.array(x) for x in zip(*cells, strict=True))
        u, v = near_dedup.common_mass(row, col, weight, np.array([0]), np.array([1]), step=5)
        assert not u[0, 0] and not j_p(a, b) or 1 / (1 / u[0, 0] + 1 / v[0, 0] - 1) >= j_p(a, b) - 1e-5


def test_components_of_a_long_path(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["root"] for r in near_dedup.components(e).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {101: 100}


def test_near_duplicates_odd(odd, none, wide):
    got = near_dedup.classes(odd)
    by = {}
    for r in got.collect():
        by.setdefault(r["doc_id"], set()).add(r["class_id"])
    assert by[1] == {1} and by[2] == {2} and by[3] == {3} and by[6] == {5} and by[None] == {None} and by[10] == {10}
    kept = [r["doc_id"] for r in near_dedup.clean(wide).collect()]
    assert kept.count(10) == 2 and 6 not in kept and {1, 2, 3, 5, None} <= set(kept) and near_dedup.clean(wide).columns == wide.columns
    assert near_dedup.classes(none).count() == 0 and near_dedup.clean(none).count() == 0


# -- 7: decontamination ------------------------------------------------------------------


def distance(p, t):
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p):
        new = [i + 1]
        for j, d in enumerate(t):
            new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_matches_brute_force(spark):
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(40)}"
    items = [(i, " ".join(word() for _ in range(rng.randrange(1, 30)))) for i in range(12)] + [(90, ""), (91, None)]
    docs = []
    for d in range(60):
        t = [word() for _ in range(rng.randrange(0, 60))]
        if d % 2:
            p = items[rng.randrange(12)][1].split()
            for _ in range(rng.randrange(0, 7)):
                k = rng.randrange(len(p) + 1)
                p[k : k + rng.randrange(2)] = [word()] * rng.randrange(2)
            t[len(t) // 2 : len(t) // 2] = p
        docs.append((d, ", ".join(t).upper()))
    want = set()
    for d, text in docs:
        w = re.findall(r"\w+", text.lower())
        for i, item in items:
            p = re.findall(r"\w+", (item or "").lower())
            if p and distance(p, w) <= int(len(p) * 0.2 + 1e-9):
                want.add((d, i, distance(p, w)))
    x, y = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["distance"]) for r in decontaminate.matches(x, y).collect()}
    assert got == want and {r["doc_id"] for r in decontaminate.clean(x, y, block_bytes=200).collect()} == {d for d, _ in docs} - {d for d, _, _ in want}


def test_matches_odd(spark, odd, none, wide):
    items = spark.createDataFrame([(1, "no id here"), (None, "one"), (2, None)], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(odd, items).collect()} == {(None, 1), (4, None)}
    assert decontaminate.matches(none, items).count() == 0 and decontaminate.matches(odd, items.limit(0)).count() == 0
    assert decontaminate.clean(wide, items).count() == wide.count() - 2 and decontaminate.clean(wide, items).columns == wide.columns


# -- 8: packing --------------------------------------------------------------------------


def test_packing_round_trip(spark, small):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    text = {r["doc_id"]: r["text"] for r in small.collect()}
    text[9_000] = "a <|endoftext|> b"
    df = spark.createDataFrame(list(text.items()), "doc_id long, text string")
    got = packing.best_fit_pack(df, capacity=256).toPandas()
    for d, x in got.groupby("doc_id"):
        ids = np.array([*t.encode(text[d], add_special_tokens=False).ids, 0], "<u4")
        x = x.sort_values("piece")
        assert x["piece"].tolist() == list(range(len(x))) and x["length"].sum() == len(ids)
        assert (x["length"].iloc[1:] == 256).all() and len(x) == -(-len(ids) // 256)
        for r in x.itertuples():
            assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
    for _, x in got.groupby("sequence_id"):
        x = x.sort_values("offset")
        assert x["length"].sum() <= 256 and (x["offset"] == x["length"].cumsum() - x["length"]).all()
    assert got["sequence_id"].nunique() <= -(-got["length"].sum() // 256) * 1.02


def fewest(sizes: list[int], capacity: int) -> int:
    """The least number of sequences, over all ways to fill them."""
    best, rest = len(sizes), sorted(sizes, reverse=True)

    def fill(k: int, bins: list[int]) -> None:
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(rest):
            best = len(bins)
            return
        for room in {b: i for i, b in enumerate(bins) if b >= rest[k]}.items():
            bins[room[1]] -= rest[k]
            fill(k + 1, bins)
            bins[room[1]] += rest[k]
        bins.append(capacity - rest[k])
        fill(k + 1, bins)
        bins.pop()

    fill(0, [])
    return best


def test_local_search_against_all_packings():
    """Small inputs: hardly ever more sequences than the least number, fewer than best fit."""
    rng = np.random.default_rng(9)
    plain = ours = least = 0
    for _ in range(150):
        sizes = rng.integers(10, 60, 11)
        number, offset = packing.pack(sizes, 100)
        fill = np.bincount(number, sizes)
        assert fill.max() <= 100 and (fill > 0).all()
        plain += len(packing._Bins(sizes, 100).items)
        ours += len(fill)
        least += fewest(sizes.tolist(), 100)
    assert least <= ours <= plain and ours - least <= 0.01 * least


@pytest.mark.parametrize("low, high", [(200, 1500), (200, 900)])
def test_local_search_of_many_sizes(low, high):
    sizes = np.random.default_rng(low).integers(low, high + 1, 5000)
    number, _ = packing.pack(sizes)
    fill = np.bincount(number, sizes)
    plain, bound = len(packing._Bins(sizes, packing.CAPACITY).items), -(-sizes.sum() // packing.CAPACITY)
    assert fill.max() <= packing.CAPACITY and len(fill) - bound <= 0.75 * (plain - bound)


def test_full_pieces_have_sequences_of_their_own(spark):
    got = packing.best_fit_pack(spark.createDataFrame([(i, "a b c d e f g h " * 60) for i in range(20)], "doc_id long, text string"), capacity=16, block_pieces=7).toPandas()
    assert got["length"].sum() == got.groupby("sequence_id")["length"].sum().sum() and got.groupby("sequence_id")["length"].sum().max() <= 16
    assert got[got["length"] == 16]["sequence_id"].is_unique and (got[got["length"] == 16]["offset"] == 0).all()


def test_packing_odd(odd, none, wide):
    got = packing.best_fit_pack(odd)
    assert got.select("doc_id").distinct().count() == odd.select("doc_id").distinct().count()
    assert got.where("doc_id = 2").select("length").first()[0] == 1
    assert packing.best_fit_pack(none).count() == 0 and packing.best_fit_pack(wide).count() == got.count()


# -- 9: html -----------------------------------------------------------------------------


def test_extraction_of_labelled_pages():
    m = html_extract.trained()
    right = total = 0
    for page in html_extract.training_pages(seed=1234, n=40):
        got = set(re.findall(r"[bc]\d+x*", html_extract.main_text(page, m)))
        words = set(re.findall(r"\b[bc]\d+x*", re.sub(r"<title>.*?</title>", "", page)))
        total += len(words)
        right += sum((w in got) == (w[0] == "c") for w in words)
    assert right > 0.98 * total


def test_marginals_by_enumeration():
    """Both sweeps give the marginals that summing over all states gives."""
    import itertools

    rng = np.random.default_rng(2)
    model = html_extract.Model(rng.normal(size=html_extract.N_FEATURES), rng.normal(size=(len(html_extract.EDGES) + 1, 2, 2)))
    parent, kinds, active = [-1, 0, 0, 1, 1, 2, 5], [0, 1, 2, 0, 3, 4, 2], [[1], [2, 3], [4], [5], [1, 6], [7], [8, 2]]
    p = np.zeros((7, 2))
    for s in itertools.product((0, 1), repeat=7):
        z = sum(model.weight[a].sum() * v for a, v in zip(active, s)) + sum(model.edge[kinds[i], s[parent[i]], s[i]] for i in range(1, 7))
        for i, v in enumerate(s):
            p[i, v] += np.exp(z)
    assert np.allclose(model.beliefs(active, kinds, parent)[0], np.log(p[:, 1] / p[:, 0]))


def test_extraction_text_rules(spark):
    page = "<html><body><nav><a href=/>menu</a></nav><article><h1>Main  title here</h1><p>First &amp; <b>bold</b>\n text &eacute; runs on.<br>next line of it.</p><script>var x='<p>no</p>'</script><p>Second block of text.<ul><li>item one is here.<li>item two is here.</ul><form>name <input></form><div class='comments'><p>first!</p><p>me too</p></div></article><footer>&copy; foot</footer>"
    assert html_extract.main_text(page, html_extract.trained()) == "Main title here\nFirst & bold text é runs on. next line of it.\nSecond block of text.\nitem one is here.\nitem two is here."
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (None, "u", "<" * 5000), (4, "u", "<div>" * 3000), (1, "u", page)]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == 6 and all(r["n_chars"] == len(r["text"]) for r in got) and [r["text"] for r in got if r["page_id"] in (2, 3)] == ["", ""]


@pytest.mark.parametrize("head", ["<head><title>t</title>", "<head><title>t</title><meta charset=utf-8>", "<head><title>t</title></head>"])
@pytest.mark.parametrize("body", ["<body>", ""])
@pytest.mark.parametrize("end", ["</body></html>", ""])
def test_extraction_without_optional_tags(head, body, end):
    text = "A long paragraph of the article that a reader came for, with some more words in it."
    page = f"<html>{head}{body}<article><p>{text}</p></article>{end}"
    assert html_extract.main_text(page, html_extract.trained()) == text


def test_text_ends_an_open_head():
    page = html_extract.parse("<html><head><title>t</title>bare text")
    assert page.text[-1] == "bare text" and "t" not in page.text


def test_extraction_of_the_table(spark):
    import html

    pages = spark.read.parquet(f"{DIR}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html_extract.extract(pages).collect()}
    for r in pages.collect():
        a = re.search(r"<article>(.*?)(?:</article>|$)", r["html"], re.S)[1]
        a = re.sub(r"<[^>]+>", "", re.sub(r"<br>", " ", re.sub(r"</?(?:p|h1)[^>]*>", "\0", a)))
        assert got[r["page_id"]] == "\n".join(y for x in a.split("\0") if (y := re.sub(r"[ \t\n\r\f\v]+", " ", html.unescape(x)).strip()))


# -- 10: personal data -------------------------------------------------------------------


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(int(c) for c in reversed(d))) % 10 == 0


def base_spans(text):
    digits = lambda m: re.sub(r"[^0-9]", "", m)
    kinds = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    )
    return [(k, m.start(), m.end()) for k, p, ok in kinds for m in re.finditer(p, text or "") if ok(m.group())]


def test_pii_brute_force(spark, odd):
    rng = random.Random(10)
    bits = ["a@b.co", "@", ".", "-", " ", "+", "1", "255", "256", "4111 1111 1111 1111", "(", ")", "12", "é", "x_y", "00", "+49 30 1234567", "10.0.0.1"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(0, 40)))) for i in range(400)] + [(r["doc_id"], r["text"]) for r in odd.where("doc_id is not null and doc_id < 8 and doc_id > 0").collect()]
    rows = [(1000 + k, t) for k, (_, t) in enumerate(rows)]
    got = {r["doc_id"]: r for r in pii.pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for d, text in rows:
        want, r = base_spans(text), got[d]
        shown = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r["base_sha256"] == hashlib.sha256(shown.encode()).hexdigest(), text
        assert r["spans"].startswith(shown) and r["n_phone"] == sum(k == "phone" for k, _, _ in want)


def test_pii_context_and_checksums(spark):
    text = "iban DE89370400440532013000, not DE89370400440532013001; call 377-555-0271, code 377-555-0271xx and much more text than forty characters before 377-555-0272; ssn 123-45-6789"
    r = pii.pii(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [s.split(":")[0] for s in r["spans"].split(",")].count("iban") == 1 and "ssn" in r["spans"]
    places = [tuple(map(int, s.split(":")[1:])) for s in r["spans"].split(",") if s.startswith("phone_local")]
    assert text.index("377-555-0271") in [a for a, _ in places] and text.index("377-555-0272") not in [a for a, _ in places]


def test_redaction(spark, wide, none):
    rows = [(1, "mail a@b.co and +49 30 1234567 é", 32), (2, None, None), (3, "clean", 5)]
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in pii.redact(spark.createDataFrame(rows, "doc_id long, text string, n_chars long")).collect()}
    assert got == {1: ("mail <EMAIL> and <PHONE> é", 26), 2: (None, None), 3: ("clean", 5)}
    assert pii.redact(wide).columns == wide.columns and pii.redact(wide).count() == wide.count() and pii.redact(none).count() == 0


def test_many_spans_in_one_text(spark):
    """Places behind many slices of matches, kinds that overlap, and time that grows in
    proportion."""
    import time

    unit = "mail a.b@c.de or +49 30 1234567 é 4111 1111 1111 1111, call 377-555-0271 10.0.0.1@x.org "
    took = []
    for n in (1000, 8000):
        df = spark.createDataFrame([(1, unit * n)], "doc_id long, text string")
        t = time.time()
        r = pii.pii(df).first()
        took.append(time.time() - t)
        want = base_spans(unit * n)
        assert r["spans"].startswith(",".join(f"{k}:{a}:{b}" for k, a, b in want)) and r["spans"].count("phone_local") == n
        text, at = [], 0
        for k, a, b in sorted([*((k, a, b) for k, a, b in want), *(("phone_local", m.start(), m.end()) for m in re.finditer("377-555-0271", unit * n))], key=lambda x: x[1:]):
            if a >= at:
                text.append((unit * n)[at:a] + f"<{k.upper()}>")
            at = max(at, b)
        assert pii.redact(df).first()["text"] == "".join(text) + (unit * n)[at:]
    assert took[1] < 20 * took[0] + 10


def test_pii_clashing_columns_and_empty(wide, none, odd):
    assert pii.pii(wide).count() == odd.count() and pii.pii(none).count() == 0


def test_pii_stays_in_the_jvm(small):
    assert not re.search("Python|Arrow|Pandas", pii.pii(small)._jdf.queryExecution().executedPlan().toString())


# -- kernels -----------------------------------------------------------------------------


def test_words_equal_split():
    rng = random.Random(11)
    texts = ["".join(rng.choice("ab \t\n\x0b\x0c\r\x1c\xa0é😀") for _ in range(rng.randrange(0, 30))) for _ in range(200)] + [None]
    data, off = textkern.buffers(pa.array(texts))
    w = textkern.Words(data, off)
    h = w.hashes()
    for i, t in enumerate(texts):
        want = (t or "").encode().split()
        k = slice(w.first[i], w.first[i + 1])
        assert [bytes(data[a:b]) for a, b in zip(w.start[k], w.end[k])] == want
        one = textkern.Words(*textkern.buffers(pa.array(["x " + (t or "")])))
        assert (one.hashes()[1:] == h[k]).all()


def test_sliding_min():
    x = np.random.default_rng(0).integers(0, 99, 50)
    for n in range(1, 51):
        assert textkern.sliding_min(x, n).tolist() == [min(x[i : i + n]) for i in range(51 - n)]
