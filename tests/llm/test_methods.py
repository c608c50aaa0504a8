"""The queries that SQL can't express against plain versions written apart from them, and degenerate inputs."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldlift.llm import block_naming, chat, components, matroska, minhash, mixing, packing, substring_dedup, token_store, toxicity, weak_quality
from fieldlift.llm.features import DIMENSIONS, Rows

DOCS = "doc_id long, text string, lang string, source string, n_chars long, removed_spans string, h string, s string, copies string, size string, votes string, facts map<string,int>, __id string, __h string, r string, c string"


def frame(spark, rows):
    """Documents with columns whose names clash with internal and result columns, and a map."""
    return spark.createDataFrame([(i, t, "en", s, 0, "a", "b", "c", "d", "e", "f", {"k": 1}, "p", "q", "u", "v") for i, t, s in rows], DOCS)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def prose():
    rnd = random.Random(11)
    vocabulary = ["".join(rnd.choice("aeioutnrsé") for _ in range(rnd.randint(2, 8))) for _ in range(300)]
    rows = []
    for i in range(90):
        t = [rnd.choice(vocabulary) + ("." if k % 9 == 8 else "") for k in range(rnd.randint(3, 120))]
        if i % 6 == 0:
            t = [w.upper() + "!!" for w in t]
        elif i % 6 == 1:
            t = [t[0]] * len(t)
        elif i % 6 == 2:
            t = [x for w in t for x in (w, "|")]
        rows.append((i, " ".join(t), f"s{i % 4}"))
    return [*rows, (200, None, None), (201, "", "s0"), (202, " \n", "s1"), (203, "猫 Él 1", "s0"), (0, rows[0][1], "s0"), (5, "another text of the fifth id", "s3"), (None, rows[3][1], "s9")]


# Quality


def plain_votes(text):
    w = words(text)
    n = len(w)
    if n < 5:
        return "0000000"
    chars = [c for x in w for c in x]
    symbols = sum(c in "%$&*#|!^~=<>{}\\_@+" for c in chars) / len(chars)
    letters = [c for c in chars if c.isalpha()]
    upper = sum(c.isupper() for c in letters) / max(1, len(letters))
    repeats = sum(w[k] == w[k - 1] for k in range(1, n)) / n
    parts = [w[k : k + 100] for k in range(0, n, 100)]
    parts = [p for k, p in enumerate(parts) if k == 0 or len(p) >= 50]
    distinct = sum(len(set(p)) / len(p) for p in parts) / len(parts)
    bars, length = w.count("|") / n, len(chars) / n
    ends = sum(x[-1] in ".,;:?!" for x in w) / n
    cases = [(symbols > 0.1, symbols < 0.02), (upper > 0.5, upper < 0.2), (repeats > 0.1, repeats < 0.03), (n >= 30 and distinct < 0.45, n >= 30 and distinct > 0.55), (bars > 0.1, bars == 0), (length > 12 or length < 2, 3 <= length <= 9), (ends > 0.5 or (n >= 40 and ends == 0), 0.01 <= ends <= 0.35)]
    return "".join("1" if bad else "2" if good else "0" for bad, good in cases)


def plain_em(every):
    """Over documents, not over counted patterns."""
    prior, table = 0.8, [[[0.2, 0.4, 0.4], [0.2, 0.03, 0.77]] for _ in range(7)]
    for _ in range(200):
        q = []
        for v in every:
            a, b = 1 - prior, prior
            for j, c in enumerate(v):
                a, b = a * table[j][0][int(c)], b * table[j][1][int(c)]
            q.append(b / (a + b))
        for j in range(7):
            for t in (0, 1):
                mass = [0.5] * 3
                for v, x in zip(every, q, strict=True):
                    mass[int(v[j])] += x if t else 1 - x
                table[j][t] = [m / sum(mass) for m in mass]
        prior = min(max(sum(q) / len(q), 1e-3), 1 - 1e-3)
    return prior, table


def test_quality_matches_a_plain_version(spark, prose):
    got = weak_quality.quality(frame(spark, prose)).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _, _ in prose)
    every = [plain_votes(t) for _, t, _ in prose]
    assert Counter((r["doc_id"], r["votes"]) for r in got) == Counter(zip((i for i, _, _ in prose), every, strict=True))
    prior, table = plain_em(every)
    for r in got:
        a, b = 1 - prior, prior
        for j, c in enumerate(r["votes"]):
            a, b = a * table[j][0][int(c)], b * table[j][1][int(c)]
        assert r["posterior"] == pytest.approx(b / (a + b), abs=1e-5)
    same = {r["score"] for r in got if r["doc_id"] == 0}
    assert len(same) == 1
    # Every distinct text trains, whatever its id: a bound of as many rows changes nothing.
    again = {(r["doc_id"], r["votes"]): r["score"] for r in weak_quality.quality(frame(spark, prose), max_rows=len({t for _, t, _ in prose})).collect()}
    assert all(again[r["doc_id"], r["votes"]] == pytest.approx(r["score"], abs=1e-9) for r in got)


def test_linear_scorer_matches_dense_descent():
    rnd = np.random.default_rng(3)
    rows = [np.unique(rnd.integers(0, 12, rnd.integers(1, 6))).astype(np.int32) for _ in range(30)]
    target = rnd.random(30)
    w, bias = weak_quality.fit_linear(rows, target, steps=40)
    x = np.zeros((30, 12))
    for i, r in enumerate(rows):
        x[i, r] = 1 / np.sqrt(len(r))
    v, b, sv, sb = np.zeros(12), 0.0, np.full(12, 1e-8), 1e-8
    for _ in range(40):
        e = (1 / (1 + np.exp(-(x @ v + b))) - target) / 30
        g = x.T @ e + 1e-4 * v
        sv += g * g
        v = v - 0.5 * g / np.sqrt(sv)
        sb += e.sum() ** 2
        b -= 0.5 * e.sum() / np.sqrt(sb)
    assert np.allclose(w[:12], v) and bias == pytest.approx(b)


def test_shapes_are_of_characters():
    assert weak_quality.Profile("Éa ß1 猫_").shapes == "Aa a0 a_"
    assert weak_quality.votes(weak_quality.Profile("ÉÀÖ " * 20))[1] == "1"


# Toxicity


def test_toxicity_gradient_matches_finite_differences():
    rnd = np.random.default_rng(5)
    rows = Rows([np.unique(rnd.integers(0, 6, 3)).astype(np.int32) for _ in range(25)])
    grade, share = rnd.integers(0, 4, 25), rnd.random(25)
    share /= share.sum()
    w, cuts = rnd.normal(size=6), np.array([-0.5, 0.4, 1.1])
    _, g, g_cuts = toxicity.gradient(rows, grade, share, w, cuts)
    for k in range(6):
        e = np.eye(6)[k] * 1e-6
        assert g[k] == pytest.approx((toxicity.gradient(rows, grade, share, w + e, cuts)[0] - toxicity.gradient(rows, grade, share, w - e, cuts)[0]) / 2e-6, abs=1e-5)
    for k in range(3):
        e = np.eye(3)[k] * 1e-6
        assert g_cuts[k] == pytest.approx((toxicity.gradient(rows, grade, share, w, cuts + e)[0] - toxicity.gradient(rows, grade, share, w, cuts - e)[0]) / 2e-6, abs=1e-5)


def test_toxicity_score_matches_a_plain_version(spark, prose):
    rows = [(i, (t or "") + (" vile, rotten scum." if i is not None and i % 5 == 0 else ""), s) for i, t, s in prose]
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 5 == 0), "z") for i in range(90)] + [(1, 0, "z"), (None, 1, "z"), (7, None, "z")], "doc_id long, toxic int, text string")
    model = toxicity.fit(docs, labels)
    weight = dict(zip(model.index.tolist(), model.weight.tolist(), strict=True))
    got = {(r["doc_id"], r["expected_severity"]) for r in toxicity.score(docs, model).collect()}
    import xxhash

    for i, t, _ in rows:
        found = {xxhash.xxh32_intdigest(n) % DIMENSIONS for w in words(t) for n in toxicity.names(w)}
        x = sum(weight.get(k, 0.0) for k in found)
        want = sum(1 / (1 + math.exp(-(x - c))) for c in model.cuts) if t.strip() else 0.0
        assert any(d == i and s == pytest.approx(want, abs=1e-9) for d, s in got)
    wrong = [r for r in toxicity.score(docs, model).collect() if r["doc_id"] is not None and r["doc_id"] < 90 and r["kept"] == (r["doc_id"] % 5 == 0)]
    assert not [r for r in wrong if r["doc_id"] != 5]
    assert toxicity.score(docs.limit(0), model).count() == 0
    assert toxicity.reject(docs, model).columns == docs.columns


def test_a_repeated_label_trains_once(spark):
    docs = spark.createDataFrame([(1, "rotten scum")] * 50 + [(2, "kind words"), (3, "calm words")], "doc_id long, text string")
    seen = {}
    real = toxicity.fit_rows

    def spy(features, toxic, steps, **more):
        seen["n"] = len(features)
        return real(features, toxic, steps, **more)

    toxicity.fit_rows = spy
    try:
        toxicity.fit(docs, spark.createDataFrame([(1, 1)] * 9 + [(2, 0), (3, 0)], "doc_id long, toxic int"))
        assert seen["n"] == 3
        toxicity.fit(docs, spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, toxic int"), max_rows=2)
        assert seen["n"] == 2
    finally:
        toxicity.fit_rows = real


# Mixing


def test_temperature_matches_a_plain_version(spark):
    totals = [1000, 130, 130, 7, 1]

    def powers(a):
        s = [t / sum(totals) for t in totals]
        return [x**a / sum(y**a for y in s) for x in s]

    frame_ = spark.createDataFrame([(t,) for t in [*totals, 0]], "t long")
    t = mixing.temperature(frame_)
    w = powers(t.alpha)
    budget = max(x / p for x, p in zip(totals, w, strict=True))
    assert t.budget == pytest.approx(budget, rel=1e-9) and max(p * budget / x for x, p in zip(totals, w, strict=True)) == pytest.approx(2.0, abs=1e-9)
    assert all(x**t.alpha / t.norm == pytest.approx(p, rel=1e-9) for x, p in zip(totals, w, strict=True))
    t = mixing.temperature(frame_, max_repetition=None, target_entropy=1.2)
    assert -sum(p * math.log(p) for p in powers(t.alpha)) == pytest.approx(1.2, abs=1e-9)
    t = mixing.temperature(frame_, budget_tokens=2000.0, max_repetition=5.0)
    assert max(p * 2000 / x for x, p in zip(totals, powers(t.alpha), strict=True)) == pytest.approx(5.0, abs=1e-6)
    t = mixing.temperature(frame_, max_repetition=None, target_entropy=0.05)
    assert t.alpha > 1 and t.budget == pytest.approx(max(x / p for x, p in zip(totals, powers(t.alpha), strict=True)), rel=1e-9)
    assert mixing.temperature(frame_.limit(0)).budget == 0.0


@pytest.mark.parametrize("limits", [{}, {"max_repetition": None, "target_entropy": 1.6}, {"budget_tokens": 9000.0}])
def test_budgeted_block_permutations_match_a_plain_version(spark, prose, limits):
    docs = frame(spark, [*prose, (5, "another text of the fifth id", "a first source")])
    plan = {(r["doc_id"], r["h"]): r for r in mixing.plan(docs, **limits).collect()}
    assert len(plan) == len({(i, t) for i, t, _ in prose})
    assert [r["source"] for r in plan.values() if r["doc_id"] == 5 and r["n_tokens"] == 6] == ["a first source"]
    by = defaultdict(list)
    for r in plan.values():
        by[r["s"]].append(r)
    keys = [(r["doc_id"], r["h"], r["s"], r["full"], r["block"]) for r in plan.values()]
    hashed = spark.createDataFrame(keys, "doc_id long, h long, s string, full int, block int").select("doc_id", "h", mixing._unit("s", "block", "full", F.lit(mixing.SEED)).alias("b"), mixing._unit("doc_id", "h", "full", F.lit(mixing.SEED + 1)).alias("d"))
    at = {(r["doc_id"], r["h"]): (r["b"], r["d"]) for r in hashed.collect()}
    for rows in by.values():
        tokens = sum(r["n_tokens"] for r in rows)
        left = round((rows[0]["repetition"] - rows[0]["full"]) * tokens)
        blocks = defaultdict(list)
        for r in rows:
            blocks[at[r["doc_id"], r["h"]][0], r["block"]].append(r)
        assert len(blocks) <= math.ceil(math.sqrt(len(rows)))
        for key in sorted(blocks):
            own = sorted(blocks[key], key=lambda r: (at[r["doc_id"], r["h"]][1], r["doc_id"] is not None, r["doc_id"] or 0, r["h"]))
            whole, used = sum(r["n_tokens"] for r in own), 0
            for r in own:
                used += r["n_tokens"]
                more = left > 0 and (left >= whole or used <= left)
                assert r["copies"] == r["full"] + more
            left -= whole
    out = mixing.emissions(mixing.plan(docs, **limits)).collect()
    assert Counter((r["doc_id"], r["n_tokens"]) for r in out) == sum((Counter({(r["doc_id"], r["n_tokens"]): r["copies"]}) for r in plan.values() if r["copies"]), Counter())
    assert mixing.mixed_documents(docs).columns == docs.columns


# Media


def plain_reader(media):
    """Frames of a Matroska file, read byte by byte without the library."""
    def size_at(p):
        width = 1
        while not media[p] >> (8 - width) & 1:
            width += 1
        return int.from_bytes(bytes([media[p] & (0xFF >> width)]) + media[p + 1 : p + width], "big"), p + width

    def id_at(p):
        width = next(n for n in range(1, 5) if media[p] >> (8 - n) & 1)
        return media[p : p + width].hex(), p + width

    frames, p = [], 0
    while p < len(media):
        ident, p = id_at(p)
        n, p = size_at(p)
        if ident in ("18538067", "1f43b675"):  # go inside
            continue
        if ident == "a3":
            end, q = p + n, p + 4
            kind = media[p + 3] >> 1 & 3
            count = 1
            sizes = []
            if kind:
                count, q = media[q] + 1, q + 1
            if kind == 1:
                for _ in range(count - 1):
                    total = 0
                    while media[q] == 255:
                        total, q = total + 255, q + 1
                    sizes.append(total + media[q])
                    q += 1
            elif kind == 3:
                for k in range(count - 1):
                    before = q
                    value, q = size_at(q)
                    sizes.append(value if k == 0 else sizes[-1] + value - (2 ** (7 * (q - before) - 1) - 1))
            elif kind == 2:
                sizes = [(end - q) // count] * (count - 1)
            sizes.append(end - q - sum(sizes))
            for k in sizes:
                frames.append(media[q : q + k])
                q += k
            assert q == end
        p += n
    return frames


def test_media_query_matches_an_independent_reader(spark, prose):
    docs = frame(spark, [*prose, (300, "x" * 576, "s"), (301, "é🙂" * 150_000, "s")])
    media = sorted(matroska.media_column(docs).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["media"]))
    got = sorted(matroska.media_digests(docs).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
    by = defaultdict(list)
    for r in media:
        by[r["doc_id"]].append(bytes(r["media"]))
    texts = defaultdict(list)
    for i, t, _ in [*prose, (300, "x" * 576, "s"), (301, "é🙂" * 150_000, "s")]:
        raw = (t or "").encode()
        texts[i].append((len(raw), raw + b"\xff" * (max(1, math.ceil(len(raw) / 576)) * 576 - len(raw))))
    for r in got:
        ok = []
        for n, payload in texts[r["doc_id"]]:
            for m in by[r["doc_id"]]:
                frames = plain_reader(m)
                if b"".join(frames) != payload:
                    continue
                s = np.frombuffer(payload, np.uint8).reshape(-1, 576).astype(int) - 128
                crossings = sum(int((a < 0) != (b < 0)) for row in s.tolist() for a, b in zip(row, row[1:], strict=False)) if len(payload) < 10_000 else int(((s[:, 1:] < 0) != (s[:, :-1] < 0)).sum())
                clusters = math.ceil(len(frames) / 1024)
                feature = f"packets={len(frames)};clusters={clusters};cues={clusters};ms={len(frames) * 12};sum={int(s.sum())};energy={int((s * s).sum())};peak={int((s * s).sum(1).max())};crossings={crossings}"
                ok.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(m), hashlib.sha256(m).hexdigest(), feature))
        assert tuple(r)[1:] in ok
    assert len(got) == len(prose) + 2
    broken = spark.createDataFrame([(1, bytearray(b"\x1a\x45\xdf\xa3\x9f"))], "doc_id long, media binary")
    with pytest.raises(Exception, match="beyond its parent"):
        matroska.packet_table(broken).collect()
    block = struct.pack(">BhB", 0x81, 0, 0x80) + b"ab"
    group = matroska.element(matroska.EBML, b"") + matroska.element(matroska.SEGMENT, matroska.element(matroska.CLUSTER, matroska.element(matroska.BLOCK_GROUP, matroska.element(matroska.BLOCK, block))))
    assert [p.size for p in matroska.demux(group)[0]] == [2]


# Packing


def plain_best_fit(items, capacity):
    """Items: (size, cluster, single source or None), in order; every bin is looked at."""
    bins, out = [], []
    for size, cluster, source in items:
        fits = [(b["room"], k) for k, b in enumerate(bins) if b["room"] >= size and not (size and (cluster in b["clusters"] or (source is not None and source in b["sources"])))]
        if fits:
            k = min(fits)[1]
        else:
            k = len(bins)
            bins.append({"room": capacity, "clusters": set(), "sources": set()})
        out.append((k, capacity - bins[k]["room"]))
        bins[k]["room"] -= size
        if size:
            bins[k]["clusters"].add(cluster)
            if source is not None:
                bins[k]["sources"].add(source)
    return out


@pytest.mark.parametrize("limits", [{"shard_bins": 4}, {"shard_rows": 20}, {}])
def test_packing_matches_a_plain_best_fit(spark, prose, limits):
    rows = [*prose, *[(400 + k, " ", "s0") for k in range(30)], *[(None, "same words here", None)] * 12, (500, "w " * 1000, "s1")]
    capacity = 64
    docs = frame(spark, rows)
    got = packing.pack(docs, capacity, **limits).collect()
    total = sum(len(words(t)) for _, t, _ in rows)
    bins, per = limits.get("shard_bins", packing.SHARD_BINS), limits.get("shard_rows", packing.SHARD_ROWS)
    shards = max(1, math.ceil(total / (capacity * bins)), math.ceil(len(rows) / per))
    tokens = Counter()
    for _, t, s in rows:
        tokens[s] += len(words(t))
    copies, keyed = Counter(), []
    for i, t, s in rows:
        x = re.sub(r"[\x20\x09-\x0D]+", "", t or "")
        copies[i, x, s, len(words(t))] += 1
        keyed.append((i, x, s, len(words(t)), copies[i, x, s, len(words(t))]))
    placed = spark.createDataFrame(keyed, "i long, x string, s string, n long, c int").select("i", F.xxhash64("x").alias("cluster"), "s", "n", F.pmod(F.xxhash64("i", F.xxhash64("x"), "c"), F.lit(shards)).alias("shard")).collect()
    want = Counter()
    for shard in range(shards):
        own = [r for r in placed if r["shard"] == shard]
        last = [(r["n"] - max(r["n"] - 1, 0) // capacity * capacity, r) for r in own]
        last.sort(key=lambda p: (-p[0], p[1]["i"] is None, p[1]["i"] or 0, p[1]["cluster"], p[1]["s"] is None, p[1]["s"] or "", p[1]["n"]))
        found = plain_best_fit([(n, r["cluster"], (r["s"] or "\0null") if tokens[r["s"]] < packing.ONCE_BELOW * total else None) for n, r in last], capacity)
        free = max((b for b, _ in found), default=-1) + 1
        for (n, r), (b, offset) in zip(last, found, strict=True):
            want[r["i"], r["s"], r["n"], r["n"] - n, n, (shard << 32) + b, offset] += 1
        for n, r in last:
            for start in range(0, r["n"] - n, capacity):
                want[r["i"], r["s"], r["n"], start, capacity, (shard << 32) + free, 0] += 1
                free += 1
    assert Counter(map(tuple, got)) == want
    assert packing.pack(frame(spark, [(k, "", "s") for k in range(50)])).select("bin_id").distinct().count() == 1


# Substrings, names and components


def test_passages_of_repeated_and_missing_ids(spark):
    w = [" ".join(f"p{k}x{j}" for j in range(20)) + "." for k in range(3)]
    same = " ".join(w)
    other = "Nothing of this is repeated at all. " * 1 + "Own words. " + "q " * 60
    rows = [(1, same, "s"), (2, f"Start here. {same}", "s"), (2, other, "s"), (None, f"No id. {same}", "s"), (None, f"No id. {same}", "s"), (3, None, "s"), (4, "", "s")]
    d = frame(spark, rows)
    out = [(r["doc_id"], r["text"]) for r in substring_dedup.remove_passages(d).collect()]
    assert Counter(out) == Counter([(1, same), (2, "Start here. "), (2, other), (None, "No id. "), (None, "No id. "), (3, None), (4, "")])
    spans = [r["removed_spans"] for r in substring_dedup.remove_passages(d).where("doc_id = 2").collect()]
    assert sum(x is not None for x in spans) == 1 and all(len(x) == 3 for x in spans if x)
    found = Counter((r["doc_id"], r["unit"]) for r in substring_dedup.repeated_passages(d).collect())
    assert found == Counter({(2, 1): 1, (2, 2): 1, (2, 3): 1, (None, 1): 1, (None, 2): 1, (None, 3): 1})
    assert substring_dedup.later_occurrences(d.limit(0)).count() == 0


def test_repeated_ids_in_exact_dedup(spark):
    rows = [(1, "a b c", "s"), (1, "a b c", "t"), (1, "x y z", "s"), (2, "xyz!!", "s"), (0, "x  y z", "s"), (None, "q", "s"), (None, "q", "s")]
    kept = Counter((r["doc_id"], r["text"]) for r in block_naming.keep_first_copies(frame(spark, rows)).collect())
    assert kept == Counter([(1, "a b c"), (2, "xyz!!"), (0, "x  y z"), (None, "q")])
    again = frame(spark, rows[:2])
    assert block_naming.keep_first_copies(again).columns == again.columns and [r["source"] for r in block_naming.keep_first_copies(again).collect()] == ["s"]


def test_components(spark):
    rnd = random.Random(8)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(1000, k) for k in range(1001, 1060)] + [(k, k + 1) for k in range(2000, 2040)]
    parent = {}

    def find(a):
        while parent.setdefault(a, a) != a:
            a = parent[a]
        return a

    for u, v in edges:
        if u != v:
            a, b = find(u), find(v)
            parent[max(a, b)] = min(a, b)
    got = {r[0]: r[1] for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {a: find(a) for a in list(parent)}


def test_two_permutations():
    x = np.arange(0, 1 << 32, 65537, dtype=np.uint64).astype(np.uint32)
    for f in (minhash._first, minhash._second):
        assert len(np.unique(f(x))) == len(x)
    assert (minhash._first(x) != minhash._second(x)).mean() > 0.99
    sets = [np.sort(np.random.default_rng(k).integers(0, 1 << 64, 500, dtype=np.uint64)) for k in range(2)]
    half = np.unique(np.r_[sets[0], sets[1][:250]])
    a, b = minhash.signatures([sets[0], half], 512)
    assert (a == b).mean() == pytest.approx(500 / 750, abs=0.08)


# Chat and tokens


def test_chat_of_odd_tables(spark):
    schema = "conv_id long, turn long, role string, text string, formatted string, state string, turns string"
    rows = [(1, 0, "user", "a", "x", "y", "z")] * 2 + [(None, 0, "user", "b", "x", "y", "z"), (None, 1, "assistant", "c", "x", "y", "z")]
    turns = spark.createDataFrame(rows, schema)
    got = chat.digests(chat.format_conversations(turns)).collect()
    assert sorted((r["conv_id"] or -1, r["n_turns"]) for r in got) == [(-1, 1), (-1, 1), (1, 2)]
    assert chat.digests(chat.format_conversations(turns.limit(0))).count() == 0


def test_tokens_of_odd_tables(spark, tmp_path):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    rows = [(3, "b", "s"), (3, "a", "s"), (3, "a", "s"), (None, "z z", "s"), (None, None, "s"), (-1, "x " * 5000, "s")]
    token_store.write_tokens(frame(spark, rows), str(tmp_path / "t"), path)
    got = sorted(token_store.read_tokens(spark, str(tmp_path / "t")).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, None, -1, 3, 3, 3]
    assert [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got)])[:-1].tolist()
    crc = lambda x: zlib.crc32(np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4").tobytes())
    assert Counter((r["doc_id"], r["ids_crc32"]) for r in got) == Counter((i, crc(x)) for i, x, _ in rows)
    token_store.write_tokens(frame(spark, rows).limit(0), str(tmp_path / "e"), path)
    assert token_store.read_tokens(spark, str(tmp_path / "e")).count() == 0


def test_pieces_match_the_whole_tokenizer_for_every_code_point():
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    whole, pieces = Tokenizer.from_file(path), token_store.Pieces(path)
    texts = ["<|ENDOFTEXT|> <|EndOfText|>. x<|endoftext|>.", "a• •b •. • x•y. •••", "Mr.Smith, x.y.z... A.B. it's. 5. é.", "<|endoftext|> x<|endoftext|>y", "it's\x1cI'LL", "é ́ ́a"]
    for c in range(1, 0x10000):
        if not 0xD800 <= c < 0xE000:
            texts += [f"a{chr(c)}b X{chr(c)}.", f"{chr(c)}'s {chr(c)}{chr(c)} x", f"A {chr(c)} 1{chr(c)}9"]
    for at in range(0, len(texts), 1024):
        part = texts[at : at + 1024]
        want = [[*e.ids, 2] for e in whole.encode_batch_fast(part, add_special_tokens=False)]
        assert [np.frombuffer(x, "<u4").tolist() for x in pieces.encode(part, 2)] == want


def test_pieces_look_each_occurrence_up_once(monkeypatch):
    """Known pieces aren't walked through for a batch, and what passes the limit is encoded without being kept."""
    pytest.importorskip("tokenizers")
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    pieces = token_store.Pieces(path)
    first = pieces.encode(["The cat. the Cat", None, "the"], 2)
    assert len(pieces) == 4
    walked = []
    monkeypatch.setattr(token_store.Pieces, "__iter__", lambda self: walked.append(1) or dict.__iter__(self))
    monkeypatch.setattr(token_store, "PIECE_LIMIT", 5)
    assert pieces.encode(["The cat. the Cat", None, "the"], 2) == first and len(pieces) == 4
    later = pieces.encode(["some other words, dog dog.", "dog"], 2)
    assert later == token_store.Pieces(path).encode(["some other words, dog dog.", "dog"], 2) and len(pieces) == 4 and not walked
