"""Collocations, spelling variants and embedding classes against brute force."""

import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from gridloom.llm import collocations as co
from gridloom.llm import embedding_dedup as ed
from gridloom.llm import pii
from gridloom.llm import spelling as sp

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


# ---- phrases


def brute_phrases(rows, most=3, least=10, cover=50, top=2000):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOW)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            f[lang].update(tuple(w[i : i + k]) for k in range(1, most + 1) for i in range(len(w) - k + 1))
    out = set()
    for lang, c in f.items():
        held = {g: a for g, a in c.items() if len(g) > 1 and a >= least}
        inside = Counter()
        for g, a in held.items():
            for k in range(2, len(g)):
                for i in range(len(g) - k + 1):
                    inside[g[i : i + k]] = max(inside[g[i : i + k]], a)
        scored = []
        for g, a in held.items():
            if inside[g] and 100 * inside[g] >= cover * a:
                continue
            score, _, left, right = min((10**6 * a * a // (c[g[:k]] * c[g[k:]]), k, c[g[:k]], c[g[k:]]) for k in range(1, len(g)))
            scored.append((-score, -a, " ".join(g).encode(), left, right))
        out |= {(lang, r + 1, p.decode(), -a, x, y, n[lang], -s) for r, (s, a, p, x, y) in enumerate(sorted(scored)[:top])}
    return out


def found_phrases(df, **more):
    return [(r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in co.collocations(df, **more).collect()]


def test_quicksort_counts_prefixes():
    rng = np.random.default_rng(1)
    for least in (1, 5, 40):
        s = rng.integers(0, 6, (3, 700)).astype(np.int32)
        s[1, :50] = s[2, :200] = -1
        weight = rng.integers(1, 4, 700)
        want = Counter()
        for i in range(700):
            for d in range(3):
                if (s[: d + 1, i] >= 0).all():
                    want[tuple(s[: d + 1, i])] += int(weight[i])
        level, who, f = co.multikey_quicksort(s, weight.astype(float), least)
        got = {tuple(s[: lv + 1, i]): int(x) for lv, i, x in zip(level, who, f, strict=True)}
        assert len(got) == len(level) and got == {k: v for k, v in want.items() if v >= least}


def test_divided_groups_are_not_abandoned():
    s = np.array([[0, 0, 1, 2]], np.int32)
    level, who, f = co.multikey_quicksort(s, np.ones(4), 3, np.array([[False, False, True, False]]))
    assert [(int(s[0, i]), int(x)) for i, x in zip(who, f, strict=True)] == [(1, 1)] and list(level) == [0]


@pytest.mark.parametrize("size", [1 << 20, 300])
def test_phrases_equal_brute_force(spark, small, size):
    """Ranges of 300 suffixes cut frequent words, and pairs of words, by the words after."""
    rows = [(r.text, r.lang) for r in small.select("text", "lang").collect()]
    got = found_phrases(small, size=size)
    assert len(got) == len(set(got)) and set(got) == brute_phrases(rows)


def test_phrases_edges_of_pieces_and_odd_words(spark):
    rows = [("New York, new york! New  York\tnew york.city \x01 york", "en"), ("the New York Times the new york times", None), ("\x02 \x02 a\x01 b a b", "x y"), ("É è É è", "a\nb c"), ("", "en"), (None, "en")] * 12
    df = spark.createDataFrame(rows, "text string, lang string")
    for size in (1 << 20, 2):
        assert set(found_phrases(df, size=size)) == brute_phrases(rows)
    assert set(found_phrases(df, words=4, least=5, cover=20, top=3)) == brute_phrases(rows, 4, 5, 20, 3)


def test_scores_are_exact_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    big = 5_000_000_019
    got = spark.createDataFrame([(big, big + 2, big + 4)], "a long, l long, r long").select(F.expr("cast((1000000 * (cast(a as decimal(19, 0)) * cast(a as decimal(19, 0)))) div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0))) as long)")).first()[0]
    assert got == 10**6 * big * big // ((big + 2) * (big + 4))


def test_phrases_of_odd_tables(odd, none, wide):
    assert co.collocations(none).count() == 0
    want = brute_phrases([(r.text, r.lang) for r in odd.collect()])
    assert set(found_phrases(odd)) == want and set(found_phrases(wide)) == want


# ---- spelling


def brute_variants(rows):
    n = Counter()
    for i, t in rows:
        for r in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            r = r.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{r}".encode())
            if h % 97 == 0:
                r = r[: h % len(r)] + r[h % len(r) + 1 :]
            n[r] += 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    near, same = defaultdict(set), defaultdict(set)
    for w in n:
        for i in range(len(w)):
            v = w[:i] + w[i + 1 :]
            same[i, v].add(w)
            if v in n:
                near[w].add(v)
                near[v].add(w)
    for group in same.values():
        for a in group:
            near[a] |= group - {a}
    form = {}
    for w in n:
        if near[w]:
            best = min(near[w], key=lambda v: (-n[v], v))
            if n[best] >= 2 * n[w]:
                form[w] = best
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return out


def found_variants(df):
    return [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in sp.variants(df).collect()]


def test_crc_goes_on(spark):
    words = [b"", b"a", "straße".encode(), b"x" * 300]
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    state = np.array([zlib.crc32(b"77:")] * 4, np.uint32)
    assert sp.crc32_on(state, data, ends - [len(w) for w in words], ends).tolist() == [zlib.crc32(b"77:" + w) for w in words]


def test_variants_equal_brute_force(spark, small):
    got = found_variants(small)
    want = brute_variants([(r.doc_id, r.text) for r in small.collect()])
    assert len(got) == len(set(got)) and set(got) == want and any(x[2] not in (x[0], x[1]) for x in want)


def test_variants_of_long_and_repeated_letters(spark):
    x, a = "x" * 2000, "a" * 32
    text = f"{x} {x}y {x[:-1]} y{x[1:]} hello Hallo hallo hellos jello {a} {a}a {a}aa b{a} {a[:16]}c{a[16:]} aabb aabbb aaabb bbaaa Éclair éclair eclair"
    rows = [(i, text) for i in range(4)] + [(None, text), (9, "hello " * 9), (9, "hallo " * 20), (8, ""), (7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = found_variants(df)
    assert len(got) == len(set(got)) and set(got) == brute_variants(rows)


def test_variants_of_odd_tables(odd, none, wide):
    assert sp.variants(none).count() == 0
    want = brute_variants([(r.doc_id, r.text) for r in odd.collect()])
    assert set(found_variants(odd)) == want and set(found_variants(wide)) == want


# ---- vectors


def brute_classes(rows, least=0.9):
    sound = [i for i, (k, v) in enumerate(rows) if k is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    root, links = {i: i for i in sound}, Counter()

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for p, i in enumerate(sound):
        for j in sound[:p]:
            a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
            if len(a) == len(b) and a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b)) >= least:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    low = defaultdict(lambda: 1 << 62)
    for i in sound:
        low[find(i)] = min(low[find(i)], rows[i][0])
    ids = [low[find(i)] if i in root else k for i, (k, _) in enumerate(rows)]
    return Counter((k, links[i], ids[i], None if k is None else k == ids[i]) for i, (k, _) in enumerate(rows))


def found_classes(spark, rows, **more):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    return Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in ed.classes(df, **more).collect())


@pytest.fixture(scope="session")
def planted():
    """Copies, near copies with a chain, scaled copies and strangers."""
    rng = np.random.default_rng(5)
    v = rng.normal(size=(60, 24)).astype(np.float32)
    rows = [*v, *(v[:6] * 2), *np.repeat(v[7:8], 30, 0)]
    rows += [v[9] + rng.normal(scale=0.18, size=24).astype(np.float32) for _ in range(50)]
    at, turn = np.zeros(24, np.float32), np.zeros(24, np.float32)
    at[0] = turn[1] = 1
    rows += [(np.cos(k * 0.4) * at + np.sin(k * 0.4) * turn).astype(np.float32) for k in range(8)]
    order = rng.permutation(len(rows))
    return [(int(k), [float(x) for x in rows[i]]) for k, i in enumerate(order)]


@pytest.mark.parametrize("more", [{}, {"leaves": 16}, {"leaves": 4, "block": 24 * 8 * 7}, {"lead": 3, "leaves": 8}])
def test_classes_equal_brute_force(spark, planted, more):
    got = found_classes(spark, planted, **more)
    assert got == brute_classes(planted) and max(x[1] for x in got) >= 30


def test_linked_finds_every_pair():
    rng = np.random.default_rng(2)
    for dim, scale in ((3, 1.0), (40, 1.0), (40, 0.1)):
        a, b = (ed._unit(1 + scale * rng.normal(size=(n, dim))) for n in (90, 70))
        i, j, product = ed.linked(a, b, 0.9)
        want = np.argwhere(a @ b.T >= 0.9)
        assert {tuple(x) for x in want} == set(zip(i.tolist(), j.tolist(), strict=True))
        assert np.allclose(product, (a @ b.T)[i, j])


def test_reach_bounds_products():
    rng = np.random.default_rng(3)
    p = ed._points(ed._unit(rng.normal(size=(200, 12))), 4)
    splits = ed.Splits(p, 8)
    leaf = splits.leaf(p)
    low, high = (np.stack([f(p[leaf == k], 0) for k in range(8)]) for f in (np.min, np.max))
    bound = ed.reach(p, low, high)
    assert all(bound[i, leaf[j]] >= p[i] @ p[j] - 1e-12 for i in range(200) for j in range(200))


def test_classes_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (None, [1.0, 0.0]), (None, None), (9, [1.0]), (10, [2.0]), (11, [3e38, 3e38]), (12, [1e-38, 1e-38]), (0, [-0.0, 5.0]), (-5, [0.9, 0.4358898943540674])]
    assert found_classes(spark, rows) == brute_classes([(k, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for k, v in rows])
    assert found_classes(spark, rows[:0]) == Counter()


def test_classes_with_clashing_columns(spark, planted):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(planted[:40], "vec_id long, embedding array<float>").withColumns({n: F.lit(1) for n in ("v", "node", "n", "id", "dim", "root", "component_id", "links")})
    assert Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in ed.classes(df).collect()) == brute_classes(planted[:40])


# ---- personal data that is filtered


def test_filters_on_personal_data_plan_at_once(spark):
    d = spark.createDataFrame([(1, "write to a.b@c.de or 1.2.3.4 now"), (2, None), (3, "1.2.3.4.5.6.7.8 and 999.1.1.1")], "doc_id long, text string")
    spark.range(1).where("id > 0").collect()
    began = time.perf_counter()
    assert [r.doc_id for r in pii.redact(d).where("text like '%<EMAIL>%'").collect()] == [1]
    assert [(r.doc_id, r.spans) for r in pii.pii(d).where("n_ip = 2 and spans like 'ip%'").collect()] == [(3, "ip:0:7,ip:8:15")]
    assert time.perf_counter() - began < 30


def test_addresses_in_long_runs_of_digits(spark):
    digits = "7" * 1_000_000
    rows = [(1, "1.2 " + digits), (2, "1.2.3 " + digits), (3, "1.2." + digits), (4, f"1.2.{digits}.5 1.2.3.4.5.6.7.8")]
    began = time.perf_counter()
    got = {r.doc_id: r.spans for r in pii.pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    at = len(rows[3][1]) - len("1.2.3.4.5.6.7.8")
    assert got == {1: "", 2: "", 3: "", 4: f"ip:{at}:{at + 7},ip:{at + 8}:{at + 15}"} and time.perf_counter() - began < 60
