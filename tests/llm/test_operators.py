"""Each training-data operator against brute force on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import base64
import gzip
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strandloom.llm import bpe, chat, components, flac, packing, pii, simhash, suffix_dedup, topk, toxicity, warc

WORDS = "the of and thing anor erst onble idiot scum édouard über 日本 line".split()


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", ".", ",", "\n"]) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    shared = prose(rng, 40)
    out = [None, "", "a", "   ", "x" * 5000, prose(rng, 6000), shared, shared, shared + " more", "pre " + shared + " post"]
    out += [prose(rng, rng.randint(1, 200)) for _ in range(20)]
    out += [out[-1].replace("the", "tha", 1), "mail me at a.b+c@ex-ample.co.uk, call +1 (555) 010-9999 or 10.0.0.255; card 4111 1111 1111 1111, bad 4111 1111 1111 1112 and 1.2.3.256"]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i * 3, t, "en", "src0", len(t or ""), "other") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, length string").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.filter("doc_id < 0")


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


# 1. best-fit packing


def one_by_one(lengths, capacity):
    bins = 0
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = [r for r in rooms if r >= n]
        if fit:
            rooms.remove(min(fit))
            room = min(fit)
        else:
            bins, room = bins + 1, capacity
        if room - n:
            rooms.append(room - n)
    return bins


@pytest.mark.parametrize("seed", range(6))
def test_best_fit_agrees_with_one_item_at_a_time(seed):
    rng = random.Random(seed)
    lengths = [rng.choice([64, rng.randint(1, 64), 33]) for _ in range(rng.randint(0, 400))]
    counts = {n: lengths.count(n) for n in set(lengths)}
    moves = packing.best_fit_decreasing(counts, 64)
    fill = {}
    for n, _, first, bins, each, at in moves:
        for b in range(first, first + bins):
            fill.setdefault(b, []).append((at, n * each))
    for parts in fill.values():
        end = 0
        for at, size in sorted(parts):
            assert at == end
            end += size
        assert end <= 64
    assert len(fill) == one_by_one(lengths, 64)
    assert sum(bins * each for _, _, _, bins, each, _ in moves) == len(lengths)


def test_packing(spark, docs, empty, texts):
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    rows = packing.pack(docs.unionByName(docs.filter("doc_id = 18")), path).collect()
    seqs = {}
    for i, t in enumerate(texts):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        want = [(p, a, len(ids[a : a + 2048]), zlib.crc32(np.array(ids[a : a + 2048], "<u4").tobytes())) for p, a in enumerate(range(0, len(ids), 2048))]
        got = sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows if r["doc_id"] == i * 3)
        assert got == sorted(want * (2 if i == 6 else 1))
    for r in rows:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in seqs.values():
        end = 0
        for at, n in sorted(parts):
            assert at == end
            end += n
        assert end <= 2048
    assert packing.pack(empty, path).count() == 0


# 2. exact top-k search


def test_top_k(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=16)]) for i in range(300)]
    rows += [(1000, rows[0][1]), (1001, rows[0][1]), (2000, None), (2001, [float("nan")] * 16), (2002, [None] * 16), (2003, [1.0] * 4), (2004, []), (2005, [float("inf")] + [0.0] * 15), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    good = {i: np.floor(1024 * np.array(v)).astype(np.int64) for i, v in rows if i is not None and i not in (2000, 2001, 2002, 2005)}
    want = []
    for q in [i for i in good if i % 100 == 0]:
        near = sorted((-int(good[q] @ v), i) for i, v in good.items() if i != q and len(v) == len(good[q]))[:10]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(near)]
    assert sorted(map(tuple, topk.top_k_digest(df).collect())) == sorted(want)
    assert topk.top_k_digest(df.filter("vec_id < 0")).count() == 0
    few = topk.top_k(df.filter("vec_id in (0, 1)"), df.filter("vec_id in (0, 1)"), 10).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in few) == [(0, 1, 1), (1, 1, 0)]


@pytest.mark.parametrize("dims", [64, 50])
def test_survivors_keep_the_best(dims):
    rng = np.random.default_rng(dims)
    base = rng.normal(size=(8, dims))
    c = np.floor(1024 * (base[rng.integers(0, 8, 3000)] + 0.3 * rng.normal(size=(3000, dims)))).astype(np.int64)
    q, ids = c[:40], np.arange(3000)
    at_q, at_c, score = topk.survivors(ids[:40], q, ids, c, 10, np.full(40, topk.LEAST))
    best = topk.Best(40, 10)
    best.add(at_q, at_c, score)
    every = q @ c.T
    every[np.arange(40), np.arange(40)] = -(1 << 62)
    want = np.lexsort((np.broadcast_to(ids, every.shape), -every), axis=1)[:, :10]
    assert (best.ids.reshape(40, 10) == want).all() and len(at_q) < 40 * 3000 / 2


def test_top_k_of_a_repeated_query(spark):
    df = spark.createDataFrame([(0, [2.0, 0.0]), (0, [1.0, 5.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0])], "vec_id long, embedding array<double>")
    got = topk.top_k(df.filter("vec_id = 0"), df, 5).collect()  # the least vector asks: (1, 5)
    assert sorted((r["rank"], r["vec_id"], r["score"]) for r in got) == [(1, 1, 5 * 1024**2), (2, 2, 1024**2)]


# 3. suffix-array dedup


def removed_by_force(rows):
    seen, out = set(), {}
    for i, t in sorted(rows):
        gone = bytearray(len(t))
        for at in range(len(t) - 99):
            w = t[at : at + 100]
            if w in seen:
                gone[at : at + 100] = b"\1" * 100
            seen.add(w)
        out[i] = (len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(bytes(c for c, g in zip(t, gone) if not g)))
    return out


def check_suffix(df, rows):
    got = by_id(suffix_dedup.suffix_digest(df))
    want = removed_by_force(rows)
    assert {i: tuple(r)[1:] for i, r in got.items()} == want
    return want


def test_suffix_dedup(spark, docs, empty, texts):
    check_suffix(docs, [(i * 3, (t or "").encode()) for i, t in enumerate(texts)])
    assert suffix_dedup.suffix_digest(empty).count() == 0
    again = suffix_dedup.suffix_digest(docs.unionByName(docs.filter("doc_id = 24"))).collect()
    assert len(again) == len(texts) + 1 and len({tuple(r) for r in again if r["doc_id"] == 24}) == 1


def test_suffix_dedup_beyond_16_mib(spark):
    rng = random.Random(8)
    text = base64.b64encode(rng.randbytes(12_900_000)).decode()  # 17.2 million characters
    cut = suffix_dedup.BATCH - 150
    far, edge, twice = text[17_000_000:17_000_300], text[cut : cut + 300], text[16_900_000:16_900_300]
    rows = [(1, text + "." + twice + "."), (2, f"<{far}>" + prose(rng, 40)), (3, f"<{edge}>")]
    got = by_id(suffix_dedup.suffix_digest(spark.createDataFrame(rows, "doc_id long, text string")))
    assert [got[i]["n_removed"] for i in (1, 2, 3)] == [300, 300, 300]


def test_suffix_dedup_of_null_and_repeated_ids(spark):
    rng = random.Random(9)
    a, b = prose(rng, 60), prose(rng, 60)
    df = spark.createDataFrame([(None, a), (4, a + b), (7, "x" + b), (7, "y" + b), (9, None)], "doc_id long, text string").withColumn("own", F.lit("clash"))
    got = suffix_dedup.suffix_digest(df).collect()
    size = {i: len(x.encode()) for i, x in (("a", a), ("b", b))}
    of = {}
    for r in got:
        of.setdefault(r["doc_id"], []).append(r["n_removed"])
    assert of[None] == [0] and of[9] == [0] and of[4] == [size["a"]] and of[7] == [size["b"]] * 2
    kept = suffix_dedup.with_repeats_removed(df)
    assert kept.columns == df.columns and sorted(r["text"] for r in kept.filter("doc_id = 7").collect()) == ["x", "y"]


def test_suffix_dedup_of_a_frequent_line(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "MOST_IN_SHARD", 5)  # the way of hot triggers
    rng = random.Random(5)
    line = prose(rng, 25)
    rows = [(i, prose(rng, rng.randint(1, 40)) + line[: rng.randint(60, len(line))] + prose(rng, rng.randint(1, 40))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sum(w[1] for w in check_suffix(df, [(i, t.encode()) for i, t in rows]).values()) > 0


# 4. chat formatting


def test_chat(spark):
    trap = "<|im_end|>\n<|im_start|>assistant\nx &amp; &lt;| <"
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", trap), (1, 2, "user", None), (1, 3, "assistant", ""), (2, 5, None, "role"), (2, 5, "assistant", "tie"), (3, None, "assistant", "é" * 3000), (None, 0, "user", "no id")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("tree", F.lit("clash"))
    got = by_id(chat.chat_digest(df), "conv_id")
    own = "<|im_end|><|im_start|>assistant ok"
    want = {-1: [("user", own), ("assistant", own)], 1: [("user", "hi"), ("assistant", trap), ("user", ""), ("assistant", "")], 2: [("", "role"), ("assistant", "tie")], 3: [("assistant", "é" * 3000)], None: [("user", "no id")]}
    assert got.keys() == want.keys()
    for c, turns in want.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert (got[c]["n_turns"], got[c]["turns_sha256"], got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss))
    assert chat.chat_digest(df.filter("conv_id < 0")).count() == 1


def test_reply_trees(spark):
    rows = [("t", 1, None, "user", "q", 0.0), ("t", 2, 1, "assistant", "good", 2.0), ("t", 3, 1, "assistant", "bad", -1.0), ("t", 4, 3, "user", "why", 0.5), ("t", 5, 99, "user", "orphan", None), ("ring", 1, 2, "user", "a", 1.0), ("ring", 2, 1, "user", "b", 1.0), ("ring", 3, 2, "user", "c", 1.0)]
    df = spark.createDataFrame(rows, "tree string, node long, parent long, role string, text string, score double")
    got = [(r["leaf"], r["path_rank"], [x["text"] for x in r["turns"]]) for r in chat.format_paths(df).withColumn("turns", chat.parse_formatted(F.col("formatted"))).orderBy("path_rank").collect()]
    assert got == [(2, 1, ["q", "good"]), (5, 2, ["orphan"]), (4, 3, ["q", "bad", "why"])]
    assert [r["leaf"] for r in chat.format_paths(df, 1).collect()] == [2]


def test_reply_paths_of_random_trees_and_rings(spark, monkeypatch):
    rng, rows = random.Random(6), []
    for tree in range(30):
        n = rng.randint(1, 12)
        for node in range(n):
            rows.append((f"t{tree}", node, rng.choice([None, 99, *range(n)]) if tree % 3 == 0 else rng.choice([None, *range(node)])))
    rows += [("hot", i, i - 1 if i else None) for i in range(40)] + [("alone", i, None) for i in range(500)]
    rows += [("ring", 0, 2), ("ring", 1, 0), ("ring", 2, 1), ("ring", 3, 2)]
    up = {(t, n): p for t, n, p in rows}
    parents = {(t, p) for (t, _), p in up.items()}
    want = set()
    for t, n in up:
        chain = [n]
        while (p := up[t, chain[-1]]) is not None and (t, p) in up and p not in chain:
            chain.append(p)
        if (t, n) not in parents and (p is None or (t, p) not in up):
            want |= {(t, n, node, i) for i, node in enumerate(chain)}
    rounds = []
    monkeypatch.setattr(chat, "written", lambda df, label, of=chat.written: rounds.append(label) or of(df, label))
    df = spark.createDataFrame(rows, "tree string, node long, parent long").withColumn("up", F.lit(1)).withColumn("most", F.lit(1))
    got = [tuple(r) for r in chat.reply_paths(df).select("tree", "leaf", "node", "dist").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert rounds.count("paths") == 6  # as the longest tree of 40 needs; the ring ends after two
    rounds.clear()
    assert chat.reply_paths(df.filter("tree = 'ring' or tree = 'alone'")).count() == 500 and rounds.count("paths") == 2


# 5. toxicity


def test_toxicity(spark):
    rng = random.Random(1)
    plain = [w for w in WORDS if w not in ("idiot", "scum")]
    rows = []
    for i in range(400):
        bad = i % 5 == 0
        words = [rng.choice(plain) for _ in range(60)] + ([rng.choice(["idiot", "scum", "grobel" + rng.choice("abc")]) for _ in range(4)] if bad else [])
        rng.shuffle(words)
        rows.append((i, " ".join(words), int(bad)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    more = df.select("doc_id", "text").unionByName(spark.createDataFrame([(1000, None), (1001, ""), (None, "idiot")], "doc_id long, text string"))
    out = toxicity.toxicity_digest(more, df.select("doc_id", "toxic")).collect()
    got = {r["doc_id"]: r for r in out}
    held = [(got[i]["predicted"], y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _, _ in rows)
    assert sum(p == y for p, y in held) / len(held) >= 0.95
    assert got[1000]["predicted"] == got[1001]["predicted"] == 0 and all(0 <= r["score"] <= 1 for r in out)
    assert toxicity.toxicity_digest(more, df.filter("doc_id < 0").select("doc_id", "toxic")).count() == len(out)


def test_toxicity_mines_beyond_the_sample(spark, monkeypatch):
    rng = random.Random(2)
    plain = [w for w in WORDS if w not in ("idiot", "scum")]
    rows = []
    for i in range(400):
        own = (["zyxomma"] if i % 40 == 0 else ["idiot", "scum"]) * 2 if i % 5 == 0 else []
        words = [rng.choice(plain) for _ in range(40)] + own
        rng.shuffle(words)
        rows.append((i, " ".join(words), int(i % 5 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    monkeypatch.setattr(toxicity.labelled_rows, "__defaults__", (True, 40))  # of its 40 rows, too few have the rare word
    monkeypatch.setattr(toxicity, "fit", lambda *rows, of=toxicity.fit: seen.append(of(*rows)) or seen[-1])
    seen = []
    out = {r["doc_id"]: r["score"] for r in toxicity.toxicity_digest(df, df.select("doc_id", "toxic")).collect()}
    assert "zyxomma" in seen[0].voters
    clean = max(out[i] for i, text, y in rows if not y)
    assert all(out[i] > clean for i in range(0, 400, 40))


def test_label_model_against_a_plain_em():
    rng = np.random.default_rng(4)
    truth = rng.random(600) < 0.3
    rates = np.array([[0.6, 0.02], [0.4, 0.05], [0.5, 0.01], [0.3, 0.3]])
    matrix = (rng.random((600, 4)) < np.where(truth[:, None], rates[:, 0], rates[:, 1])).astype(np.float32)
    labels = np.where(rng.random(600) < 0.1, ~truth, truth).astype(float)
    got, odds = toxicity.label_model(matrix, labels, 0.3, rounds=30)
    p = [0.9 if y else 0.1 for y in labels]
    for _ in range(30):
        sums = sum(p)
        t = [(sum(a * row[j] for a, row in zip(p, matrix)) + 0.5) / (sums + 1) for j in range(4)]
        o = [(sum((1 - a) * row[j] for a, row in zip(p, matrix)) + 0.05) / (600 - sums + 1) for j in range(4)]
        for i, row in enumerate(matrix):
            toxic, other = 0.3 * (0.9 if labels[i] else 0.1), 0.7 * (0.1 if labels[i] else 0.9)
            for j in range(4):
                toxic *= t[j] if row[j] else 1 - t[j]
                other *= o[j] if row[j] else 1 - o[j]
            p[i] = toxic / (toxic + other)
    assert np.abs(got - np.array(p)).max() < 1e-3 and np.argmin(np.abs(odds)) == 3
    assert ((got >= 0.5) == truth).mean() > (labels == truth).mean()
    twice, _ = toxicity.label_model(np.hstack([matrix, matrix[:, :1], matrix[:, :1]]), labels, 0.3)  # three voters as one
    assert np.abs(twice - got).mean() < 0.02


def test_linear_fit_and_cut():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(500, 3))
    y = 1 / (1 + np.exp(-(x @ [2.0, -1.0, 0.0] + 0.5)))
    w = toxicity.linear_fit(x, y, ridge=1e-6)
    assert np.allclose(w, [2, -1, 0, 0.5], atol=1e-3)
    z = np.array([3.0, 1.0, 2.0, -1.0, 0.0])
    assert toxicity.best_cut(z, np.array([1.0, 1, 1, 0, 0])) == 0.5 and toxicity.best_cut(z, np.ones(5)) == 0.0


def test_mined_voters_against_counts(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "FLUSH", 10)
    rows = [(int(i % 4 == 0), f"shared word{i % 3} {'zerbomotic' if i % 4 == 0 else 'calm'}") for i in range(60)]
    got = dict(toxicity.mine_voters(spark.createDataFrame(rows, "toxic int, text string")))
    bad, good = 15, 45
    want = {}
    for p in {p for _, t in rows for p in toxicity.patterns_of(t)}:
        t, n = (sum(p in toxicity.patterns_of(x) for y, x in rows if y or k) for k in (0, 1))
        odds = np.log((t + 0.5) / (bad + 1)) - np.log((n - t + 0.5) / (good + 1))
        if t >= 3 and odds > 2:
            want[p] = odds
    assert got.keys() == want.keys() == {"zerbomotic", "zerb*", "zerbo*", "zerbom*"} and all(abs(got[p] - want[p]) < 1e-9 for p in want)


# 6. WARC


def test_warc(spark):
    rows = [(1, "http://b.example/x?b=2&a=1", "same"), (2, "http://www.a.example/", "same"), (3, "http://a.example/", None), (4, None, ""), (5, "http://a.example/ z\r\n", "é" * 4000), (6, "http://a.example/", "same")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("archive", F.lit(1)).repartition(3)
    got = by_id(warc.warc_digest(df), "page_id")
    last = {}
    for i, _, h in rows:
        last[h or ""] = i
    for i, _, h in rows:
        p = (h or "").encode()
        first = last[h or ""] == i
        assert (got[i]["payload_bytes"], got[i]["payload_digest"], got[i]["record_type"], got[i]["refers_to"]) == (len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if first else "revisit", None if first else last[h or ""])
    order = sorted(got.values(), key=lambda r: r["capture_position"])
    assert [r["capture_position"] for r in order] == list(range(len(rows)))
    assert [(r["urlkey"], r["captured"]) for r in order] == sorted((r["urlkey"], r["captured"]) for r in order)
    archives = warc.write_archives(warc.decide_revisits(df, 10))
    assert {r["page_id"]: r["payload"].decode() for r in warc.read_archives(archives).collect()} == {i: h or "" for i, _, h in rows}
    assert warc.warc_digest(df.filter("page_id < 0")).count() == 0


def test_warc_order_does_not_depend_on_ranges(spark):
    rows = [(i if i % 11 else None, f"http://h{i % 3 * (i % 5 > 0)}.example/p{i % 4}", "x" * (i % 50)) for i in range(400)]
    rows += [(7, "http://h0.example/p3", "again")] * 3
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    archives = warc.written(warc.write_archives(warc.decide_revisits(df), 300), "archives")
    assert archives.count() > 20  # many runs
    want = sorted(({**e.asDict(), "archive": r["archive"], "segment": r["segment"]} for r in archives.collect() for e in r["run"]), key=lambda e: (*warc.capture_order(e), e["archive"], e["segment"], e["offset"]))
    for in_range in (10, 10**6):
        got = sorted(warc.merge_index(archives, in_range).collect(), key=lambda r: r["position"])
        assert [r["position"] for r in got] == list(range(len(rows)))
        assert [{k: r[k] for k in want[0]} for r in got] == want


def test_archive_members():
    parts = [b"", b"a" * 10, bytes(random.Random(1).randbytes(5 * warc.PIECE)), b"end"]
    packed = [gzip.compress(p) for p in parts]
    assert list(warc.members(b"".join(packed))) == [(sum(map(len, packed[:i])), p) for i, p in enumerate(parts)]
    assert list(warc.members(b"")) == []
    with pytest.raises(ValueError, match="cut short"):
        list(warc.members(packed[2][:-9]))


def test_loser_tree():
    rng = random.Random(2)
    for k in range(9):
        runs = [sorted(rng.randint(0, 20) for _ in range(rng.randint(0, 9))) for _ in range(k)]
        assert list(warc.LoserTree(runs, lambda x: x)) == sorted(x for r in runs for x in r)


# 7. BPE


def test_bpe(docs, empty, texts):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    got = by_id(bpe.tokenize(docs, path))
    for i, t in enumerate(texts):
        ids = tok.encode(t or "", add_special_tokens=False).ids
        r = got[i * 3]
        assert (r["ids"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (ids, len(ids), sha(",".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False)))
    assert bpe.tokenize(empty, path).count() == 0


def test_bpe_of_odd_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok, own, rng = Tokenizer.from_file(path), bpe.bpe(path), random.Random(4)
    bits = ["a", "th", " ", "  ", "\n", " \n", "'s", "é", "日本", "12", "!!", "\t", "́", "\xa0", "<|endoftext|>", "ing"]
    for _ in range(1500):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))
        assert bpe.encode_text(own, t).tolist() == tok.encode(t, add_special_tokens=False).ids


# 8. personal data

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def holds(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def test_pii(spark, docs, empty, texts):
    rng = random.Random(9)
    bits = ["a", ".", "@", "b-c", "%", " ", "1", "25", "255", "00300", "4111111111111111", "-", "+", "(", ")", "GB82WEST12345698765432", "DE00", "é", "\n", "_"]
    odd = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(1, 40)))) for i in range(10_000, 10_800)]
    every = docs.select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    got = by_id(pii.pii_digest(every))
    for i, t in [(i * 3, t or "") for i, t in enumerate(texts)] + odd:
        spans = {k: [m for m in re.finditer(p, t) if holds(k, m.group())] for k, p in BASE.items()}
        base = ",".join(f"{k}:{m.start()}:{m.end()}" for k in BASE for m in spans[k])
        assert [got[i][f"n_{k}"] for k in BASE] == [len(spans[k]) for k in BASE], t
        assert got[i]["base_sha256"] == sha(base) and got[i]["spans"].startswith(base)
    assert pii.pii_digest(empty).count() == 0


def test_pii_of_long_texts(spark):
    text = " ".join(f"a{i}@b.co 12 {i % 256}.0.0.1" for i in range(1500))
    r = pii.pii_digest(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    mails = [m for m in re.finditer(BASE["email"], text)]
    assert (r["n_email"], r["n_ip"], r["n_card"]) == (1500, 1500, 0)
    assert r["spans"].startswith(",".join(f"email:{m.start()}:{m.end()}" for m in mails) + ",ip:")
    red = pii.redact_pii(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["text"]
    assert red == " ".join(["[EMAIL] 12 [IP]"] * 1500)


def test_redaction(spark):
    df = spark.createDataFrame([(1, "é write to a@b.co or pay 4111111111111111, IBAN GB82WEST12345698765432"), (2, None), (3, "plain")], "doc_id long, text string")
    assert [r["text"] for r in pii.redact_pii(df).orderBy("doc_id").collect()] == ["é write to [EMAIL] or pay [CARD], IBAN [IBAN]", None, "plain"]


# 9. SimHash


def fingerprint_by_force(t, n):
    words = re.findall(rb"[^\x20\x09-\x0D]+", bytes(b + 32 if 65 <= b <= 90 else b for b in t.encode()))
    shingles = [b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_by_force(ids, linked):
    top = {i: i for i in ids}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash(docs, empty, texts):
    got = by_id(simhash.simhash_digest(docs))
    fp = {i * 3: fingerprint_by_force(t or "", 4) for i, t in enumerate(texts)}
    want = components_by_force(sorted(fp), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 4)
    assert {i: (r["fingerprint"], r["component_id"]) for i, r in got.items()} == {i: (f"{fp[i]:016x}", want[i]) for i in fp}
    assert simhash.simhash_digest(empty).count() == 0


@pytest.mark.parametrize("part", [3, 1000])
def test_near_links_join_what_all_links_join(spark, part):
    rng = random.Random(part)
    seeds = [rng.getrandbits(64) for _ in range(5)]
    values = {s ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for s in seeds for _ in range(25)}
    signed = {v: v - (1 << 64) if v >> 63 else v for v in values}
    links = simhash.near_links(spark.createDataFrame([(v,) for v in signed.values()], "fp long"), 4, part)
    got = {r["id"]: r["component"] for r in components.connected_components(links).collect()}
    want = components_by_force(sorted(values), lambda a, b: (a ^ b).bit_count() <= 4)
    groups = {}
    for v, top in want.items():
        groups.setdefault(top, set()).add(got.get(signed[v], signed[v]))
    assert all(len(g) == 1 for g in groups.values()) and len({*map(tuple, groups.values())}) == len(groups)


def test_keep_one(spark):
    rng = random.Random(6)
    base = [" ".join(f"w{rng.randint(0, 5000)}" for _ in range(120)) for _ in range(12)]
    rows = list(enumerate(base))
    for i in range(12):
        words = base[i].split()
        words[60] = "changed"
        rows.append((100 + i, " ".join(words)))
        rows.append((200 + i, base[i]))
    rows += [(300, None), (301, ""), (None, "only one here")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash"))
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [*range(12), 300]
    assert simhash.keep_one(df.filter("doc_id < 0")).count() == 0


def jaccard_by_force(a, b, n=5):
    of = [{tuple(t.split()[i : i + n]) for i in range(len(t.split()) - n + 1)} for t in (a, b)]
    return len(of[0] & of[1]) / len(of[0] | of[1])


@pytest.mark.parametrize("part", [2000, 9])
def test_keep_one_takes_the_exact_similarity(spark, monkeypatch, part):
    for of in (simhash.exact_links, simhash.candidate_links):
        monkeypatch.setattr(of, "__defaults__", (part, *of.__defaults__[1:]))
    rng, rows, expected = random.Random(5), [], []
    for n in range(60):
        words = [f"w{rng.randrange(10**9)}" for _ in range(104)]
        common = [92, 93, 91, 94][n % 4]  # Jaccard 0.786, 0.802, 0.770, 0.818
        near = words[:common] + [f"w{rng.randrange(10**9)}" for _ in range(104 - common)]
        a, b = " ".join(words), " ".join(near)
        rows += [(2 * n, a), (2 * n + 1, b)]
        expected += [2 * n] if jaccard_by_force(a, b) >= 0.8 else [2 * n, 2 * n + 1]
    assert 60 < len(expected) < 120
    words = [f"v{i}" for i in range(300)]
    footer = " ".join(words[-6:])
    rows += [(200, " ".join(words)), (201, " ".join([*words, *[footer] * 200]))]  # one footer repeated: sets nearly equal
    chain = [f"c{i}" for i in range(150)]
    rows += [(300 + i, " ".join(chain[3 * i : 3 * i + 104])) for i in range(15)]  # one component, linked from next to next
    got = sorted(r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert jaccard_by_force(rows[-17][1], rows[-16][1]) >= 0.8 and got == [*expected, 200, 300]


# 10. media columns


def test_flac(docs, empty, texts):
    got = by_id(flac.media_digest(docs))
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        p = flac.payload(t or "")
        r = got[i * 3]
        assert len(p) % 64 == 0 and len(p) > 0 and p.rstrip(b"\0") == raw.rstrip(b"\0")
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(p), sha(p), zlib.crc32(p[-64:]))
    assert got[18]["media_sha256"] == got[21]["media_sha256"] and got[18]["feature"] == got[21]["feature"]
    assert flac.media_digest(empty).count() == 0


def test_pcm_blocks(spark):
    rng = random.Random(3)
    texts = {1: "x" * 5000, 2: None, 3: prose(rng, 3000)}
    media = flac.encode_media(spark.createDataFrame([*texts.items()], "doc_id long, text string")).cache()
    stream = {r["doc_id"]: bytes(r["media"]) for r in media.collect()}
    seek = {r["doc_id"]: [tuple(p) for p in r["seek"]] for r in flac.decode_media(media).collect()}
    got = {}
    for r in flac.pcm_blocks(media).orderBy("doc_id", "block").collect():
        assert (r["first_sample"], r["frame_offset"]) == seek[r["doc_id"]][r["block"]] and r["samples"] == len(r["pcm"])
        assert stream[r["doc_id"]][r["frame_offset"] :][:2] == b"\xff\xf8"
        got[r["doc_id"]] = got.get(r["doc_id"], b"") + bytes(r["pcm"])
        assert len(got[r["doc_id"]]) == r["first_sample"] + r["samples"]
    assert got == {i: flac.payload(t or "") for i, t in texts.items()}


def test_flac_round_trip_and_damage():
    rng = random.Random(8)
    payloads = [bytes(rng.choice(c) for _ in range(n)) for n in (64, 1024, 4160, 1030) for c in (b"\0", b"ab ", bytes(range(256)), b"\0" * 60 + b"\xff")]
    streams = flac.encode(payloads)
    back, seek = flac.decode(streams)
    assert back == payloads
    for s, points in zip(streams, seek):
        for sample, at in points:
            assert s[at : at + 2] == b"\xff\xf8" and sample % flac.BLOCK == 0
    hurt = bytearray(streams[1])
    hurt[-10] ^= 4
    with pytest.raises(ValueError):
        flac.decode([bytes(hurt)])


# 4, 8: no Python on the executors


def test_native_plans(docs, spark, monkeypatch):
    plans = []
    monkeypatch.setattr(chat, "written", lambda df, label, of=chat.written: plans.append(df) or of(df, label))
    conv = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "user", "ho")], "conv_id long, turn long, role string, text string").repartition(2)
    for df in (pii.pii_digest(docs), pii.redact_pii(docs), chat.chat_digest(conv), *plans):
        assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())


# Extra columns whose names clash with the operators' own


def clashing(spark, names):
    """Documents with personal data, a repeated passage, near copies and a toxic text, and further columns of these names."""
    rng = random.Random(21)
    passage = " ".join("".join(rng.choice("bcdfgaeiou") for _ in range(6)) for _ in range(40))
    texts = [f"write to me{i}@example.org or 10.0.0.{i} {passage if i < 2 else ''} " + " ".join("".join(rng.choice("bcdfgaeiou") for _ in range(5)) for _ in range(60)) for i in range(8)]
    rows = [(i, t, *[f"{n}-{i}" for n in names]) for i, t in enumerate([*texts, texts[3] + " more", None])]
    return spark.createDataFrame(rows, "doc_id long, text string" + "".join(f", `{n}` string" for n in names))


def kept(df, names):
    rows = by_id(df)
    assert all(r[n] == f"{n}-{i}" for i, r in rows.items() for n in names)
    return rows


CLASHES = {
    "pii": [f"{x}_{k}" for x in ("hits", "gaps", "__hits", "__gaps") for k in ("email", "phone")] + ["__text", "__chunks", "__SPANS", "pii"],
    "suffix": ["__ranges", "__doc", "__own", "__Text", "ranges", "doc", "own", "z", "h"],
    "keep": ["__key", "__Key_", "own", "least", "fp", "keys", "component", "a", "b"],
    "score": ["__score", "__SCORE_", "score"],
}


def test_pii_beside_clashing_columns(spark):
    names = CLASHES["pii"]
    df = clashing(spark, names)
    got = kept(pii.find_pii(df, into="found"), names)
    assert [s["kind"] for s in got[4]["found"]] == ["email", "ip"] and got[9]["found"] == []
    out = pii.redact_pii(df)
    assert out.columns == df.columns
    got = kept(out, names)
    assert got[4]["text"].startswith("write to [EMAIL] or [IP]") and got[9]["text"] is None


def test_repeats_removed_beside_clashing_columns(spark):
    names = CLASHES["suffix"]
    df = clashing(spark, names)
    out = suffix_dedup.with_repeats_removed(df)
    assert out.columns == df.columns
    got, before = kept(out, names), by_id(df)
    removed = removed_by_force([(i, (r["text"] or "").encode()) for i, r in before.items()])
    assert {i: sha(r["text"] or "") for i, r in got.items()} == {i: x[-1] for i, x in removed.items()}
    assert len(got[1]["text"]) < len(before[1]["text"]) and got[9]["text"] is None


def test_keep_one_beside_clashing_columns(spark):
    names = CLASHES["keep"]
    df = clashing(spark, names)
    out = simhash.keep_one(df)
    assert out.columns == df.columns
    assert sorted(kept(out, names)) == [*range(8), 9]


def test_scores_beside_clashing_columns(spark):
    names = CLASHES["score"]
    df = clashing(spark, names)
    model = toxicity.ToxicityModel(("idiot",), (1.0,), (2.0,), 1.0, -2.5)
    out = toxicity.without_toxic(df.unionByName(df.filter("doc_id = 5").withColumn("text", F.lit("idiot " * 9)).withColumn("doc_id", F.lit(50).cast("long"))), model)
    assert out.columns == df.columns
    assert sorted(kept(out, names)) == list(range(10))


def test_near_duplicates_of_null_and_repeated_ids(spark):
    rows = [(5, "one two three four five six"), (5, "one two three four five six"), (None, "one two three four five six"), (None, "quite another text that stands alone here"), (2, "ONE two three four five six"), (9, None), (8, "")]
    got = [(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=repr) == sorted([(5, 2), (5, 2), (None, 2), (None, None), (2, 2), (9, 8), (8, 8)], key=repr)


def test_number_of_voters_is_the_callers(spark):
    rows = [(i, ("vile " if i % 4 == 0 else "calm ") + f"word{i % 5} text{i % 3}", int(i % 4 == 0)) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    parts = toxicity.labelled_rows(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"), held_out=False)
    assert len(toxicity.fit(*parts, most_voters=1).voters) <= len(toxicity.LEXICON) + 1 < len(toxicity.fit(*parts).voters)


def near_by_force(sets, similarity=0.8):
    """All pairs of different sets at that Jaccard similarity: only the rarest few shingles of a set need be looked up, as sets that share none of them can't reach it."""
    count = {}
    for s in sets.values():
        for x in s:
            count[x] = count.get(x, 0) + 1
    at, pairs = {}, set()
    for i, s in sets.items():
        rare = sorted(s, key=lambda x: (count[x], x))[: len(s) - -(-len(s) * 4 // 5) + 1]
        for j in {j for x in rare for j in at.get(x, ())}:
            both = len(s & sets[j])
            if both >= similarity * (len(s) + len(sets[j]) - both):
                pairs.add((j, i))
        for x in rare:
            at.setdefault(x, []).append(i)
    return pairs


def test_keep_one_recall_on_the_given_documents(spark):
    """Recall and precision 1 against exact similarity over the 10,000 documents of sf0.1, near and exact copies alike."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    sets, same = {}, {}
    for r in docs.select("doc_id", "text").orderBy("doc_id").collect():
        words = [w for w in re.split("[ \t-\r]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r["text"] or "")) if w]
        key = frozenset(" ".join(words[i : i + 5]) for i in range(max(len(words) - 4, 1))) if words else frozenset()
        same.setdefault(key, []).append(r["doc_id"])
    for key, ids in same.items():
        sets[ids[0]] = key
    near = near_by_force(sets)
    assert len(near) > 40
    top = {i: i for i in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for a, b in near:
        x, y = sorted((find(a), find(b)))
        top[y] = x
    assert sorted(r["doc_id"] for r in simhash.keep_one(docs).select("doc_id").collect()) == sorted({find(i) for i in sets})
