"""Every operator on nulls, empty and long texts, ties, repeated rows, clashing columns, no rows."""

import hashlib
import os
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from foliant.llm import fingerprints, jaccard, langid, mixing, packing, quality, sharding, vectors, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, component_id int, _pid string, shard string"
WORDS = "the of and a quick brown fox jumps over lazy dog while seven tired writers copy long dull lines again".split()


def text(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(WORDS[i] for i in rng.integers(0, len(WORDS), n))


def rows():
    base = text(0, 300)
    out = [(1, base, "en", "a"), (2, base, "en", "a"), (3, base + " tail words here now", "en", None), (4, None, None, None), (5, "", "fr", "b"), (None, "lonely text", "en", "b"), (6, "  \t ", "en", "b")]
    out += [(7, text(7, 3), "de", "c")] * 2 + [(8, text(8, 70_000), "de", "c"), (9, "a" * 300_000, "fr", "c"), (10, "12 34 !!", "en", "d"), (11, "Ünï çødé ✓ 漢字 text", "de", "d")]
    out += [(100 + i, text(100 + i, 40), ("en", "fr", "de")[i % 3], "abcd"[i % 4]) for i in range(30)]
    return [(*r, None if r[1] is None else len(r[1]), "clash", 1, "clash", "clash") for r in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_packing_round_trip(docs, none):
    got = packing.pack(docs).collect()
    w = packing.Words()
    want = Counter((r[0], bytes(w.tok_ids(r[1] or ""))) for r in rows())
    parts, seqs = defaultdict(list), defaultdict(list)
    for r in got:
        assert len(r.ids) == 4 * r.length > 0
        parts[(r.doc_id, r.doc_tokens)].append((r.start, bytes(r.ids)))
        seqs[r.sequence_id].append((r.offset, r.length, r.context))
    made = Counter()
    for (d, n), p in parts.items():
        copies = sum(s == 0 for s, _ in p)
        p.sort()
        text_ = b"".join(b for _, b in sorted(set(p)))
        assert len(text_) == 4 * n
        made[(d, text_)] += copies
    assert made == want
    padding = 0
    for s in seqs.values():
        s.sort()
        assert s[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(s, s[1:], strict=False))
        used = s[-1][0] + s[-1][1]
        assert used <= 2048
        padding += 0 if used & (used - 1) == 0 else 2048 - used
    assert padding == 0
    assert packing.pack(none).count() == 0


def test_mixing_budgets(docs, none):
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows())
    by = defaultdict(list)
    for r in got:
        by[r.source].append(r)
        assert 0 <= r.taken <= 3 * r.size
    for g in by.values():
        assert sum(r.size for r in g) == g[0].source_size
        assert abs(sum(r.taken for r in g) - g[0].target) < 1
        assert g[0].target <= 3 * g[0].source_size + 1e-9
    total = sum(g[0].target for g in by.values())
    assert abs(total - sum(r.size for r in got)) < 1e-6 * max(1, total)
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mix(docs).collect()), key=repr)
    assert mixing.mix(none).count() == 0


def test_mixed_documents_hold_what_is_taken(docs, none):
    taken = sum(r.taken for r in mixing.mix(docs).collect())
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    assert sum(len((r.text or "").split()) for r in out.collect()) == taken
    assert mixing.mixed_documents(none).count() == 0


def test_sharding_balance_and_slots(spark, docs, none):
    got = sharding.shard(docs).collect()
    assert len(got) == len(rows())
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    same = defaultdict(set)
    for r in got:
        same[(r.text_crc32, r.size)].add(r.shard)
    many = spark.createDataFrame([(i, text(i, 20 + i % 300), "x") for i in range(3000)] + [(9000 + i, text(5, 100), "x") for i in range(150)], "doc_id long, text string, d0 string")
    got = sharding.shard(many).collect()
    bytes_ = Counter()
    for r in got:
        bytes_[r.shard] += r.size
    assert set(bytes_) == set(range(8)) and max(bytes_.values()) < 1.06 * min(bytes_.values())
    assert len({r.shard for r in got if r.doc_id >= 9000}) == 1  # copies stay together
    hot = spark.createDataFrame([(i, text(1, 50) if i % 3 == 0 else text(i, 50)) for i in range(2000)], "doc_id long, text string")
    bytes_ = Counter()
    for r in sharding.shard(hot).collect():
        bytes_[r.shard] += r.size
    assert max(bytes_.values()) < 1.25 * min(bytes_.values())
    assert sharding.shard(none).count() == 0


def test_sharding_against_a_plain_walk(spark, docs):
    got = Counter((r.doc_id, r.size, r.text_crc32) for r in sharding.shard(docs).collect())
    assert got == Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows())
    many = spark.createDataFrame([(i, text(i, 20 + i % 300)) for i in range(800)], "doc_id long, text string")
    table = sharding.points(many)
    pts = [(r.size, (r.d0, r.d1, r.d2)) for r in table.collect()]
    most = sum(w for w, _ in pts) / 40
    tree, leaves = sharding.grow(table, most)
    weight, held = Counter(), defaultdict(set)
    for w, x in pts:
        node = 0
        while tree.dim[node] >= 0:
            node = tree.kids[node][int(x[tree.dim[node]] >= tree.cut[node])]
        weight[node] += w
        held[node].add(x)
    assert weight == Counter({n: int(w) for n, w in leaves.items()})
    assert all(w <= most or len(held[n]) == 1 for n, w in weight.items())
    below = lambda n: weight[n] if tree.dim[n] < 0 else sum(map(below, tree.kids[n]))
    halves = [min(map(below, tree.kids[n])) / below(n) for n in range(len(tree.dim)) if tree.dim[n] >= 0]
    assert min(halves) > 0.2 and np.mean(halves) > 0.42  # cuts lie at medians, to a bin


def test_shared_folder_is_asked_for_on_a_cluster():
    from types import SimpleNamespace as N

    from foliant.llm import common

    unset = N(get=lambda k, d: d)
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1000]"):
        with pytest.raises(ValueError):
            common.scratch(N(conf=unset, sparkContext=N(applicationId="app", master=master)))
    assert common.scratch(N(conf=N(get=lambda k, d: "file:///x/"), sparkContext=N(applicationId="app", master="yarn"))) == "file:///x/foliant-app"


def test_fingerprints_against_a_plain_loop(docs, none):
    got = {(r.doc_id, r.n_chars): r for r in fingerprints.edited_fingerprints(docs).collect()}
    assert fingerprints.edited_fingerprints(none).count() == 0
    order = sorted({(r[0], r[1] or "") for r in rows() if r[0] not in (7,)}, key=lambda x: (x[0] is not None, x[0] or 0))
    ids = [o[0] for o in order]
    for (d, t), (_, after) in list(zip(order, order[1:] + order[:1], strict=True)):
        if d in (6,):  # its next document is the repeated one
            continue
        k = len(t) // 4
        want = hashlib.sha256((t[: len(t) - k] + after[:k]).encode()).hexdigest()
        assert got[(d, len(t))].edited_sha256 == want, d
    assert got[(1, len(rows()[0][1]))].fingerprint == got[(2, len(rows()[0][1]))].fingerprint
    assert got[(1, len(rows()[0][1]))].near_next == 1.0 and None in ids


def test_fingerprint_likeness_is_unbiased():
    rng = np.random.default_rng(0)
    miss = []
    for _ in range(60):
        common, a, b = (rng.integers(0, 1 << 62, n) for n in (300, 100, 100))
        t = [" ".join(map(str, x)) for x in (np.concatenate([common, a]), np.concatenate([common, b]))]
        fp, some = fingerprints.fingerprints([x.encode() for x in t], width=1)
        miss.append(float(fingerprints.likeness(fp[:1], fp[1:], some[:1], some[1:])[0]) - 300 / 500)
    assert abs(np.mean(miss)) < 0.02 and np.std(miss) < 0.06


def brute_components(data):
    sets = []
    for r in data:
        w = (r[1] or "").translate({i: i + 32 for i in range(65, 91)}).split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(data)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(data)):
        for j in range(i):
            same_id = data[i][0] == data[j][0] and data[i][0] is not None and sets[i] and sets[j]
            if None in (data[i][0], data[j][0]):
                continue
            if same_id or (sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])):
                root[top(i)] = top(j)
    low = defaultdict(list)
    for i, r in enumerate(data):
        if r[0] is not None:
            low[top(i)].append(r[0])
    return sorted(((r[0], len(s), min(low[top(i)]) if r[0] is not None else None) for i, (r, s) in enumerate(zip(data, sets, strict=True))), key=repr)


def test_jaccard_join_against_all_pairs(spark, docs, none):
    got = sorted(map(tuple, jaccard.near_duplicates(docs).collect()), key=repr)
    assert got == brute_components(rows())
    assert jaccard.near_duplicates(none).count() == 0
    rng = np.random.default_rng(3)
    data, base = [], [str(x) for x in rng.integers(0, 10**6, 146)]
    for i in range(150):  # a crowd of near copies about the threshold
        w = list(base)
        for k in rng.integers(0, len(w), rng.integers(0, 8)):
            w[k] = str(rng.integers(0, 10**6))
        data.append((i, " ".join(w) + (" a common line that many share" if i % 2 else "")))
    data += [(1000 + i, " ".join(map(str, rng.integers(0, 10**6, 30))) + " a common line that many share") for i in range(150)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert sorted(map(tuple, jaccard.near_duplicates(df).collect()), key=repr) == brute_components(data)


def test_jaccard_join_of_long_lists(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "LONG", 5)
    monkeypatch.setattr(jaccard, "PART", 16)
    monkeypatch.setattr(jaccard, "KEYS", 1)
    rng = np.random.default_rng(4)
    lines = [" ".join(str(x) for x in rng.integers(0, 10**6, 12)) for _ in range(6)]  # lines that many share
    data = []
    for i in range(240):
        w = [lines[k] for k in rng.permutation(6)[: rng.integers(3, 7)]] + [" ".join(map(str, rng.integers(0, 10**6, rng.integers(0, 16))))]
        data.append((i, " ".join(w)))
    df = spark.createDataFrame(data, "doc_id long, text string")
    want = brute_components(data)
    assert 1 < len({c for _, _, c in want}) < 240
    assert sorted(map(tuple, jaccard.near_duplicates(df).collect()), key=repr) == want


def test_jaccard_overlaps_and_skips():
    rng = np.random.default_rng(5)
    base = rng.permutation(3000)
    sets_ = []
    for k in range(60):  # families of highly similar sets, and strangers
        s = set(base[(k % 4) * 300 : (k % 4) * 300 + 250].tolist()) if k % 5 else set(rng.integers(0, 3000, 80).tolist())
        s -= set(rng.choice(sorted(s), rng.integers(0, 20)).tolist())
        sets_.append(np.array(sorted(s | set(rng.integers(0, 3000, rng.integers(0, 20)).tolist())), np.uint64))
    want = [[len(np.intersect1d(a, b)) for b in sets_] for a in sets_]
    assert jaccard.overlaps(sets_).tolist() == want
    n = np.sort(rng.integers(20, 120, 700))
    pos = rng.integers(0, 30, 700)
    order = np.lexsort((pos, n))
    n, pos = n[order], pos[order]
    got = sorted((int(x), int(y)) for xs, ys in jaccard.block_pairs(n, pos) for x, y in zip(xs, ys, strict=True))
    ok = [(x, y) for x in range(700) for y in range(x + 1, 700) if 100 * n[x] >= 75 * n[y] and min(pos[x], pos[y]) + min(n[x] - pos[x], n[y] - pos[y]) >= -(-75 * (n[x] + n[y]) // 175)]
    assert got == ok and 0 < len(ok) < 700 * 699 // 2


def test_jaccard_join_ties_an_id_to_its_own_set_and_another(spark):
    a, b = text(21, 60), text(22, 60)
    data = [(1, b), (5, a), (5, b), (9, a + " and one tail"), (20, text(23, 60)), (20, text(24, 60))]
    got = sorted(map(tuple, jaccard.near_duplicates(spark.createDataFrame(data, "doc_id long, text string")).collect()), key=repr)
    assert got == brute_components(data) and {c for i, _, c in got if i in (1, 5, 9)} == {1}


def test_vectors_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 16))
    x[50:90] = x[0] + rng.normal(size=(40, 16)) * 0.2
    x[90:100] = x[1]
    data = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    data += [(300, None), (301, [0.0] * 16), (302, [float("nan")] * 16), (303, [None] * 16), (304, [1.0] * 3), (None, data[0][1]), (305, []), (5, data[5][1])]
    got = sorted(map(tuple, vectors.near_vectors(spark.createDataFrame([(*d, 1) for d in data], "vec_id long, embedding array<float>, rep int")).collect()), key=repr)
    good = [(i, np.array(v, np.float64)) for i, v in data if i is not None and v and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v)]
    u = np.stack([v / np.linalg.norm(v) for _, v in good])
    link = u @ u.T >= 0.95
    comp = list(range(len(good)))
    for _ in range(len(good)):
        comp = [min(comp[j] for j in np.flatnonzero(link[i])) for i in range(len(good))]
    ids = [i for i, _ in good]
    low = defaultdict(list)
    for i, c in enumerate(comp):
        low[c].append(ids[i])
    want = [(ids[i], int(link[i].sum()) - 1, min(low[comp[i]]), ids[i] == min(low[comp[i]])) for i in range(len(good))]
    want += [(i, 0, i, i is not None) for i, v in data if not (i is not None and v and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v))]
    assert got == sorted(want, key=repr)
    assert vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_vectors_of_every_length_link(spark):
    rng = np.random.default_rng(5)
    x, y, z = rng.normal(size=(30, 16)), rng.normal(size=8), rng.normal(size=3)
    data = [(i, v.tolist()) for i, v in enumerate(x)] + [(100, y.tolist()), (101, y.tolist()), (102, (y + 0.01).tolist()), (200, z.tolist()), (201, (2 * z).tolist())]
    got = {r.vec_id: tuple(r)[1:] for r in vectors.near_vectors(spark.createDataFrame(data, "vec_id long, embedding array<double>")).collect()}
    assert [got[i] for i in (100, 101, 102, 200, 201)] == [(2, 100, True), (2, 100, False), (2, 100, False), (1, 200, True), (1, 200, False)]
    assert all(got[i] == (0, i, True) for i in range(30))


def test_vectors_of_any_scale_link(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(12, 16))
    data = [(i, (v * s).tolist()) for i, (v, s) in enumerate(zip(np.repeat(x[:3], 4, 0), [1.0, 1e-200, 1e200, 1e-308] * 3, strict=True))]
    got = {r.vec_id: tuple(r)[1:] for r in vectors.near_vectors(spark.createDataFrame(data, "vec_id long, embedding array<double>")).collect()}
    assert got == {i: (3, i // 4 * 4, i % 4 == 0) for i in range(12)}


def test_vector_recall_against_all_pairs(spark):
    path = "/root/testdata/sf0.1/embeddings.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables here")
    rows_ = [(r.vec_id, r.embedding) for r in spark.read.parquet(path).collect()]
    good = [v for _, v in rows_ if v and None not in v and np.isfinite(v).all() and any(v)]
    x = np.array(good, np.float64)
    x /= np.sqrt((x * x).sum(1))[:, None]
    rng = np.random.default_rng(8)  # the table has few near pairs: add some about the threshold
    noise = rng.normal(size=x.shape) / np.sqrt(x.shape[1])
    x = np.concatenate([x, x + noise * rng.uniform(0.2, 0.4, len(x))[:, None]]).astype(np.float32)
    u = x.astype(np.float64)
    u /= np.sqrt((u * u).sum(1))[:, None]
    want = np.concatenate([(u[a : a + 500] @ u.T >= 0.95).sum(1) - 1 for a in range(0, len(u), 500)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {r.vec_id: r.n_links for r in vectors.near_vectors(df).collect()}
    found = np.array([got[i] for i in range(len(x))])
    assert (found <= want).all() and found.sum() >= 0.99 * want.sum() > 1000


def test_language_is_learned(spark, docs, none):
    rng = np.random.default_rng(2)
    parts = {"xx": ["ka", "lo", "mi", "tu"], "yy": ["sch", "ung", "ei", "th"]}
    make = lambda p, n: " ".join("".join(rng.choice(p, rng.integers(1, 4))) for _ in range(n))
    data = [(i, make(parts[k], 40), k) for i, k in enumerate(["xx", "yy"] * 60)]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(data, "doc_id long, text string, lang string")).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _, _ in data)
    assert sum(got[i].lang_pred == k for i, _, k in data) >= 0.98 * len(data)
    out = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert out[4].lang_pred == out[5].lang_pred == out[10].lang_pred == "und" and out[4].score == 0.0
    assert all(0 <= r.score <= 1 for r in out.values())
    assert langid.identify(none).count() == 0


def test_language_scores_against_a_plain_loop(docs):
    names, net = langid.fit(docs)
    p, h = {k: v.astype(np.float64) for k, v in net.p.items()}, langid.HIDDEN
    seen = {}

    def states(d, piece):
        at, out = np.zeros(h), []
        for byte in piece:
            a, u = p[f"x{d}"][byte], at @ p[f"u{d}"]
            z, r = 1 / (1 + np.exp(-(a[:h] + u[:h]))), 1 / (1 + np.exp(-(a[h : 2 * h] + u[h : 2 * h])))
            at = (1 - z) * np.tanh(a[2 * h :] + r * (u[2 * h :] + p[f"c{d}"])) + z * at
            out.append(at)
        return out

    def labels(piece):
        if piece not in seen:
            both = zip(states("f", piece), states("b", piece[::-1])[::-1], strict=True)
            e = [np.exp(np.concatenate(x) @ p["o"] + p["ob"]) for x in both]
            seen[piece] = sum(x / x.sum() for x in e)
        return seen[piece]

    want = {}
    for r in rows():
        t = (r[1] or "").encode()
        words = t.split()
        if any(c.isalpha() for c in r[1] or ""):
            mean = sum(labels(w[k : k + langid.LONGEST]) for w in words for k in range(0, len(w), langid.LONGEST)) / sum(map(len, words))
            want[(r[0], r[1])] = names[int(mean.argmax())], mean.max()
        else:
            want[(r[0], r[1])] = "und", 0.0
    got = langid.predict(docs.select("doc_id", "text"), names, net, with_text=True).collect()
    assert len(got) == len(rows())
    for r in got:
        lang, best = want[(r.doc_id, r.text)]
        assert r.lang_pred == lang and abs(r.score - best) < 1e-4, (r.doc_id, r.score, best)


def test_rare_languages_are_learned(spark):
    data = [(i, f"word{i % 210} other", f"l{i % 210:03d}") for i in range(1680)]
    names, net = langid.fit(spark.createDataFrame(data, "doc_id long, text string, lang string"))
    assert len(names) == 210 == net.p["o"].shape[1]


def test_language_gradients():
    rng = np.random.default_rng(0)
    net = langid.Network(3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    words = [bytes(rng.integers(97, 123, rng.integers(1, 7)).astype(np.uint8)) for _ in range(8)]
    x, lens = langid.matrix(words)
    y = rng.integers(0, 3, 8)
    _, g = net.gradients(x, lens, y)
    for k in ("uf", "ub", "cf", "o", "xb"):
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        net.p[k][at] += 1e-3
        up = net.gradients(x, lens, y)[0]
        net.p[k][at] -= 2e-3
        down = net.gradients(x, lens, y)[0]
        net.p[k][at] += 1e-3
        assert abs((up - down) / 2e-3 - g[k][at]) < 0.05 * abs(g[k][at]) + 1e-4, k


def test_quality_is_learned(spark, docs, none):
    data = [(i, text(i, 60) if i % 2 else text(i, 60).upper().replace(" ", "!! ")) for i in range(120)]
    d = spark.createDataFrame(data, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(120)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    net = quality.fit(d, labels)
    got = {r.doc_id: r.score for r in quality.score(d, net).collect()}
    assert all((got[i] >= 0.5) == bool(i % 2) for i in range(120))
    assert all(0 <= r.score <= 1 for r in quality.score(docs.select("doc_id", "text"), net).collect())
    assert quality.score(none.select("doc_id", "text"), net).count() == 0
    assert quality.fit(d, labels.limit(0)) == 0.5
    long = [text(9, 60_000).encode()]
    tables = net.pairs()
    a, b = net.features(long, tables), net.document(np.concatenate(list(net._long(long[0], tables))))
    assert np.allclose(a[0], b)


def test_quality_scores_against_a_plain_loop(spark, docs):
    labels = spark.createDataFrame([(100 + i, i % 2, 0) for i in range(30)] + [(7, 1, 0), (7, 0, 0)], "doc_id long, quality int, toxic int")
    net = quality.fit(docs, labels)
    p, chunk = {k: v.astype(np.float64) for k, v in net.p.items()}, quality.CHUNK * quality.BLOCK

    def plain(t):
        x = np.frombuffer(t + bytes(quality.WIDTH), np.uint8)
        r = p["b"] + sum(p["t"][j][x[j : j + len(t)]] for j in range(quality.WIDTH))
        step, tops = quality.STRIDE * quality.BLOCK, []
        for s in range(0, len(t), step):
            if s == 0 or s + chunk - step < len(t):
                tops.append(np.maximum(r[s : s + chunk].max(0), 0))
        f = np.concatenate([np.mean(tops, 0), np.max(tops, 0)]) if tops else np.zeros(2 * quality.FILTERS)
        return 1 / (1 + np.exp(-(f @ p["w"] + p["c"][0] + net.shift)))

    got = quality.score(docs.select("doc_id", "text", "size", "shard"), net).collect()  # clashing names come along
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows()) and {r.size for r in got} == {"clash"}
    want = {r[0]: plain((r[1] or "").encode()) for r in rows()}
    for r in got:
        assert abs(r.score - want[r.doc_id]) < 1e-4, (r.doc_id, r.score, want[r.doc_id])
    assert len({r.score for r in got if r.doc_id in (4, 5)}) == 1  # null and empty alike
    assert len({r.score for r in got if r.doc_id == 7}) == 1  # repeated rows alike


def test_warc_round_trip(spark):
    big = "x" * 1500 + "é"
    data = [(1, "http://a", big), (2, "http://b\nc", big), (2, "http://b\nc", big), (3, None, big), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (None, "n", big), (7, "", "")]
    pages = spark.createDataFrame([(*d, "clash") for d in data], "page_id long, url string, html string, digest string")
    index = warc.write(pages)
    got = warc.read(index).collect()
    assert len(got) == len(data)
    want = Counter((d[0], len((d[2] or "").encode()), hashlib.sha1((d[2] or "").encode()).hexdigest()) for d in data)
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest) for r in got) == want
    for r in got:
        shared = r.payload_bytes >= 1000
        assert (r.record_type == "response") == (not shared or r.page_id == 3)
        assert r.refers_to == (3 if r.record_type == "revisit" else None)
        if r.record_type == "response":
            assert hashlib.sha1(bytes(r.payload)).hexdigest() == r.payload_digest
    some = warc.read(index.filter("page_id = 4")).collect()
    assert [bytes(r.payload) for r in some] == [b"small"]
    assert warc.read(warc.write(pages.limit(0))).count() == 0
