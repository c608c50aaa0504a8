"""The training-data operators against brute force, round trips and degenerate inputs."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldlift.llm import block_naming, chat, matroska, minhash, mixing, packing, substring_dedup, token_store, toxicity, weak_quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h1 string, rep string, block string, name string, bands string"


def frame(spark, rows):
    """Documents with extra columns whose names clash with internal ones."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", "y", "z", "w", "v") for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 6))) for _ in range(300)]
    base = [" ".join(rnd.choice(words) for _ in range(rnd.randint(20, 90))) for _ in range(20)]
    rows = []
    for i in range(160):
        t = base[rnd.randrange(20)].split()
        for _ in range(rnd.randint(0, 4)):
            t[rnd.randrange(len(t))] = rnd.choice(words)
        rows.append((i, " ".join(t), f"s{rnd.choice([0, 0, 0, 1, 2])}"))
    rows += [(200, None, None), (201, "", "s1"), (202, " \n\t ", "s1"), (203, "One", "s0"), (204, "one", "s0"), (205, "A  B", "s2"), (206, "AB", "s2"), (207, "x " * 30000, "s0"), (208, "x " * 30000, "s0"), (209, "É Σ 猫 " * 40, "s1")]
    return rows


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_near_duplicates_match_brute_force(spark, corpus, monkeypatch):
    sets = {i: shingle_set(t) for i, t, _ in corpus}
    parent = {i: i for i in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    want = {i: (len(sets[i]), find(i), find(i) == i) for i in sets}
    got = {r[0]: tuple(r)[1:] for r in minhash.near_duplicates(frame(spark, corpus)).collect()}
    assert got == want
    monkeypatch.setattr(minhash, "BLOCK_DOCS", 4)  # groups of many blocks
    assert {r[0]: tuple(r)[1:] for r in minhash.near_duplicates(frame(spark, corpus)).collect()} == want


def test_exact_dedup_matches_brute_force(spark, corpus):
    groups = defaultdict(list)
    for i, t, _ in corpus:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i))
    want = {i: (min(g)[1], len(g), min(g)[1] == i, hashlib.sha256(k.encode()).hexdigest()) for k, g in groups.items() for _, i in g}
    for block, by_content in ((8192, False), (16, False), (16, True)):
        names = block_naming.document_names(frame(spark, corpus), block_bytes=block, by_content=by_content)
        assert names.select("level", "name").distinct().count() == len(groups)
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in block_naming.exact_dedup(frame(spark, corpus), block_bytes=16).collect()}
    assert got == want


def test_repeated_rows_and_empty_tables(spark):
    rows = [(1, "a b c d e f", "s"), (1, "a b c d e f", "s"), (2, "a b c d e f", None), (None, "a b", "s")]
    d = frame(spark, rows)
    r = block_naming.exact_dedup(d).where("group_size = 3").collect()
    assert len(r) == 3 and sum(x["kept"] for x in r) == 1
    assert block_naming.keep_first_copies(d).count() == 2
    assert {(x[0], x[2]) for x in minhash.near_duplicates(d).collect()} == {(1, 1), (2, 1), (None, None)}
    assert mixing.mixed_documents(d).count() >= 4
    assert packing.pack(d).count() == 4
    empty = d.limit(0)
    for out in (block_naming.exact_dedup(empty), minhash.near_duplicates(empty), packing.pack(empty), mixing.mixed_documents(empty), substring_dedup.repeated_passages(empty), weak_quality.quality(empty), matroska.media_digests(empty)):
        assert out.count() == 0


def test_passages(spark):
    long = " ".join(f"w{k}" for k in range(30))
    rows = [(1, f"head\n{long}\n{long} z\ntail", "s"), (2, f"other\n{long.upper()}\n  {long}  z\nend", "s"), (3, "head\nshort", "s"), (4, None, "s")]
    got = [tuple(r) for r in substring_dedup.repeated_passages(frame(spark, rows), 50, sentences=False).orderBy("unit").collect()]
    text = rows[1][1]
    assert [(r[0], r[1], r[5], r[6]) for r in got] == [(2, 1, 61, 1), (2, 2, 61, 1)]
    assert [text[r[2] : r[3]] for r in got] == text.split("\n")[1:3]
    cut = {r["doc_id"]: r["text"] for r in substring_dedup.remove_passages(frame(spark, rows), 50).collect()}
    assert cut[2] == "other\nend" and cut[1] == rows[0][1] and cut[4] is None


def test_passages_that_begin_and_end_inside_lines(spark):
    w = [" ".join(f"p{k}x{j}" for j in range(20)) + "." for k in range(3)]
    rows = [(1, f"Own start here. {w[0]}\n{w[1]}\n{w[2]} Own end.", "s"), (2, f"Another start. {w[0]}\n{w[1]}\n{w[2]} Another end.\nshort", "s"), (3, f"{w[1]}\nshort", "s"), (4, "一二。三四！" + "五" * 3, "s")]
    d = frame(spark, rows)
    assert substring_dedup.repeated_passages(d, sentences=False).count() == 0
    cut = {r["doc_id"]: r["text"] for r in substring_dedup.remove_passages(d).collect()}
    assert cut[2] == "Another start. Another end.\nshort" and cut[1] == rows[0][1] and cut[3] == rows[2][1]
    flags = [(r["doc_id"], r["n_words"], r["removed"]) for r in substring_dedup.later_occurrences(d, sentences=True).orderBy("doc_id", "unit").collect()]
    assert flags == [(2, 20, True)] * 3 + [(3, 20, False), (3, 1, False)]
    assert [rows[3][1][u[1] : u[2]] for u in substring_dedup.units(rows[3][1], True)] == ["一二。", "三四！", "五五五"]


def test_chat_round_trip(spark):
    odd = ["\\### Assistant: </turn> ok", "####", "\\b\\h\\e", "</turn>\n", "", None, "</</turn>", "a\\", "#"]
    rows = [(c, k, ("user", "assistant")[k % 2], t) for c in range(2) for k, t in enumerate(odd[c:])]
    rows += [(9, 0, "assistant", "x"), (10, 0, None, "y"), (10, 1, "a: b", "z"), (None, 0, "user", "q")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    f = chat.format_conversations(turns)
    back = {r[0]: [tuple(x) for x in r[1]] for r in f.select("conv_id", chat.read_back(F.col("formatted"))).collect()}
    want = defaultdict(list)
    for c, _, role, t in rows:
        want[c].append((role or "", t or ""))
    assert back == dict(want)
    d = {r["conv_id"]: r for r in chat.digests(f).collect()}
    assert d[0]["loss_sha256"] == hashlib.sha256("".join(t or "" for r, t in want[0] if r == "assistant").encode()).hexdigest()
    assert not d[9]["valid"] and not d[10]["valid"]


def test_mixing_keeps_all_and_meets_the_limit(spark, corpus):
    p = mixing.plan(frame(spark, corpus)).toPandas()
    assert len(p) == len(corpus) and p["copies"].min() >= 1 and p["repetition"].max() == pytest.approx(2.0, abs=1e-6)
    for _, g in p[p["n_tokens"] > 0].groupby("s"):
        budget = g["repetition"].iloc[0] * g["n_tokens"].sum()
        used = (g["copies"] * g["n_tokens"]).sum()
        assert used <= budget + 1 and used >= budget - g["n_tokens"].max() * 2
    out = mixing.emissions(mixing.plan(frame(spark, corpus), max_repetition=None, target_entropy=0.9)).toPandas()
    assert out["position"].between(0, 1).all()


def test_packing_invariants(spark, corpus):
    p = packing.pack(frame(spark, corpus), capacity=128).toPandas()
    assert (p.groupby("bin_id")["length"].sum() <= 128).all()
    assert p.groupby("doc_id")["length"].sum().to_dict() == {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in corpus}
    p = p.sort_values(["bin_id", "bin_offset", "length"])
    ends = p["bin_offset"] + p["length"]
    same = p["bin_id"].eq(p["bin_id"].shift(-1))
    assert (ends[same] == p["bin_offset"].shift(-1)[same]).all()
    bins, _ = packing.best_fit([6, 5, 4, 4], [0, 1, 0, -1], [-1, -1, -1, -1], 10)
    assert bins == [0, 1, 1, 0]  # the third may not join its cluster in the tighter bin


def test_toxicity_on_held_out_rows(spark):
    rnd = random.Random(2)
    words = [f"word{k}" for k in range(200)]
    rows = []
    for i in range(400):
        t = [rnd.choice(words) for _ in range(40)]
        if i % 4 == 0:
            t[: rnd.randint(2, 6)] = ["Idiot,", "scum", "moron."][: rnd.randint(2, 3)]
        rows.append((i, " ".join(t), int(i % 4 == 0)))
    docs = spark.createDataFrame(rows + [(900, None, 0), (901, "", 0)], "doc_id long, text string, toxic int")
    model = toxicity.fit(docs, docs.where("doc_id < 200").select("doc_id", "toxic"))
    assert list(model.cuts) == sorted(model.cuts)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    right = sum(got[i]["kept"] == (t == 0) for i, _, t in rows if i >= 200)
    assert right >= 195 and got[900]["kept"] and got[901]["kept"]
    assert toxicity.fit(docs, docs.limit(0).select("doc_id", "toxic")).survival(np.array([0.0]))[0, 0] < 0.01


def test_weak_labels(spark):
    rnd = random.Random(4)
    words = ["".join(rnd.choice("aeioutnrs") for _ in range(rnd.randint(2, 8))) for _ in range(400)]
    rows = []
    for i in range(300):
        t = [rnd.choice(words) + ("." if k % 9 == 8 else "") for k in range(80)]
        kind = i % 6
        if kind == 0:
            t = [w.upper() + "!!" for w in t]
        elif kind == 1:
            t = [t[0]] * 80
        rows.append((i, " ".join(t), "s"))
    got = {r["doc_id"]: r for r in weak_quality.quality(frame(spark, [*rows, (900, None, "s")])).collect()}
    assert all(got[i]["kept"] == (i % 6 > 1) for i in range(300)) and 900 in got
    patterns = [got[i]["votes"] for i in range(300)]
    model = weak_quality.expectation_maximisation(patterns, np.ones(300))
    assert abs(model.prior - 2 / 3) < 0.05 and np.nanmin(model.accuracy()) > 0.6


@pytest.mark.parametrize("lacing", [1, 2, 3])
def test_lacing(lacing):
    frames = [bytes([k]) * (300 if lacing == 2 else 1 + 255 * k) for k in range(1, 6)]
    body = matroska.laced(frames, lacing)
    sizes, at = matroska.laced_sizes(body, 0, len(body), lacing)
    assert sizes == [len(f) for f in frames] and body[at:] == b"".join(frames)


def test_matroska(spark):
    for n in (0, 1, 575, 576, 577, 576 * 64 + 1, 576 * 1100):
        raw = bytes(random.Random(n).randrange(256) for _ in range(n))
        payload = raw + b"\xff" * (max(1, -(-n // 576)) * 576 - n)
        media = matroska.mux(payload)
        packets, cues = matroska.demux(media)
        assert b"".join(media[p.start : p.start + p.size] for p in packets) == payload
        assert [p.timestamp_ns for p in packets] == [12_000_000 * k for k in range(len(packets))]
        assert {c[2] for c in cues} and all(media[c[2] : c[2] + 4] == b"\x1fC\xb6u" for c in cues)
    unknown = matroska.element(matroska.EBML, b"") + b"\x18\x53\x80\x67\x01" + b"\xff" * 7 + b"\x1f\x43\xb6\x75\xff" + matroska.uint(matroska.TIMESTAMP, 5) + matroska.element(matroska.SIMPLE_BLOCK, b"\x81\x00\x01\x80abc")
    assert matroska.demux(unknown)[0][0][:4] == (1, 6_000_000, len(unknown) - 3, 3)
    d = frame(spark, [(1, "é" * 400, "s"), (2, None, "s"), (3, "é" * 400, "s")])
    r = {x["doc_id"]: x for x in matroska.media_digests(d).collect()}
    assert r[1]["n_bytes"] == 800 and r[1]["payload_bytes"] == 1152 and r[1][2:] == r[3][2:]
    assert r[2]["tail_crc32"] == zlib.crc32(b"\xff" * 32)
    packets = matroska.packet_table(matroska.media_column(d)).where("doc_id = 1").collect()
    assert [p["packet"] for p in packets] == [0, 1]


def test_control_bytes():
    v = np.array([0, 1, 255, 256, 65535, 65536, (1 << 24) - 1, 1 << 24, (1 << 32) - 1], np.uint32)
    for n in range(len(v) + 1):
        assert (token_store.decode_values(*token_store.encode_values(v[:n]), n) == v[:n]).all()


def test_tokens_match_the_whole_tokenizer(spark, corpus, tmp_path):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    rows = [*corpus, (300, "I'll <|endoftext|> CAN'T İstanbul 12²½ _x_ y\x1cz", "s"), (-5, "ΣΑΣ é", "s")]
    want, start = {}, 0
    for i, text, _ in sorted(rows):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want[i] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    out = str(tmp_path / "tokens")
    token_store.write_tokens(frame(spark, rows), out, path)
    assert {r[0]: tuple(r)[1:] for r in token_store.read_tokens(spark, out).collect()} == want


def test_pipeline(spark, tmp_path, corpus):
    pytest.importorskip("corpus_pipeline")
    import corpus_pipeline

    frame(spark, corpus).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    kept = {r["doc_id"] for r in minhash.near_duplicates(block_naming.keep_first_copies(frame(spark, corpus))).where("kept").collect()}
    assert set(out["doc_id"]) == kept
