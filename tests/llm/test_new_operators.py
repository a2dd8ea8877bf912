"""Tree-joined BPE, importance resampling and spelling variants against libraries and brute force."""

import base64
import hashlib
import math
import random
import re
import zlib
from array import array
from collections import Counter

import public_tokenizers
import pytest
import tiktoken

from strandloom.llm import resample, spelling, treebpe

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    words = "colour color colours honour honor honnor Münster Munster über Fülle the of cafés × ÷ 日本 x1y".split()
    out = [None, "", "   ", "a", "é", "a" * 40_000, "one  two\n\nthree \t four ", "\x1c\x00 odd\x85blanks\xa0here", "<|endoftext|> 's'tt're"]
    out += [" ".join(rng.choice(words) + rng.choice(["", "", ".", ",", "\n"]) for _ in range(rng.randint(1, 300))) for _ in range(30)]
    return out + out[-3:]


@pytest.fixture(scope="module")
def docs(spark, texts):
    # the extra columns clash with the operators' own; ids repeat and one is null
    rows = [(None if i == 12 else i // 2 * 3, t, "key", 1, 2, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, word string, __part int, rank int, __text string").repartition(3)


# 11. byte-level BPE as a tree


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_tree_bpe(docs, texts, library):
    got = treebpe.tree_tokenize(docs, RANKS, public_tokenizers.PATTERN)
    want = []
    for i, t in enumerate(texts):
        ids = library.encode_ordinary(t or "")
        packed = b"".join(x.to_bytes(4, "little") for x in ids)
        want.append((None if i == 12 else i // 2 * 3, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), ids))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert treebpe.tree_tokenize(docs.filter("1 = 0"), RANKS, public_tokenizers.PATTERN).collect() == []


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def test_tree_bpe_of_any_bytes(name):
    with open(public_tokenizers.path(name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coder = treebpe.TreeBpe(public_tokenizers.path(name), public_tokenizers.PATTERN)
    rng = random.Random(5)
    for n in range(1500):
        letters = rng.choice(["ab", "aabcdethes \n\t'.,1é日 \x85", "the and in g"])
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 120)))
        got = [i for p in treebpe.pieces(text, 25) for i in array("I", coder.encode(p))]
        assert got == library.encode_ordinary(text)
        assert coder.decoded(got) == text.encode()


def test_windows_grow_until_their_edges_stand():
    coder = treebpe.TreeBpe(RANKS, public_tokenizers.PATTERN)
    rng = random.Random(6)
    for _ in range(400):
        data = bytes(rng.choice(b"aaabhesint") for _ in range(rng.randint(2, 90)))
        cut = rng.randint(0, len(data))
        whole = coder.merged(data)
        assert coder.joined(coder.merged(data[:cut]), coder.merged(data[cut:])) == whole
        assert coder.encoded(data) == whole


def test_full_tables_change_nothing(monkeypatch, library):
    monkeypatch.setattr(treebpe, "MOST_KEPT", 3)
    coder = treebpe.TreeBpe(RANKS, public_tokenizers.PATTERN)
    for text in ["several different words of one text", "and others of another text here", "several different words of one text"] * 2:
        assert array("I", coder.encode(text)).tolist() == library.encode_ordinary(text)


# 12. importance resampling


def resampled_by_force(rows, target, percent, most, buckets, seed, min_words):
    pattern = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})

    def found(text):
        words = pattern.findall((text or "").translate(lower))
        return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % buckets for n in range(1, most + 1) for i in range(len(words) - n + 1)]

    own = [found(t) for _, t in rows]
    s, t = Counter(b for _, f in own for b in f), Counter(b for x in target for b in found(x)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets))))
    out = []
    for (doc, _), (n_words, f) in zip(rows, own):
        h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f))
        out.append([doc, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, n_words])
    can = sorted((r for r in out if r[5] >= min_words), key=lambda r: (-r[3], -math.inf if r[0] is None else r[0], r[1]))
    for i, r in enumerate(can[: percent * len(can) // 100]):
        r[4] = i + 1
    return sorted(repr(tuple(r[:5])) for r in out)


@pytest.mark.parametrize(("percent", "most", "buckets", "min_words"), [(10, 1, 10_000, 20), (50, 2, 65_536, 1), (100, 3, 7, 0)])
def test_resampling(spark, docs, texts, percent, most, buckets, min_words):
    target = [None, "", "colour and HONOUR", "über 日本"]
    rows = [(None if i == 12 else i // 2 * 3, t) for i, t in enumerate(texts)]
    got = resample.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), percent, most, buckets, 2024, min_words)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(repr(tuple(r)) for r in got.collect()) == resampled_by_force(rows, target, percent, most, buckets, 2024, min_words)


def test_resampling_of_empty_tables(spark, docs):
    none = spark.createDataFrame([], "text string")
    assert resample.resample(docs.filter("1 = 0"), none).collect() == []
    assert resample.resample(docs, none).count() == docs.count()
    with pytest.raises(ValueError):
        resample.resample(docs, none, buckets=65_537)


def test_streams_hold_each_documents_offsets(docs, texts):
    rows = resample.bucket_streams(docs, "text", "doc_id", 1, 10_000).collect()
    assert sum(len(r["ids"]) for r in rows) == len(texts)
    assert all(len(r["stream"]) == 2 * r["offsets"][-1] and len(r["offsets"]) == len(r["ids"]) + 1 for r in rows)


# 13. spelling variants


def is_near(a, b):
    a, b = sorted((a, b), key=len)
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a != b and (a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :] and len(b) == len(a) + 1)


def variants_by_force(rows, min_length, min_count, ratio, drop):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if drop and h % drop == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= min_length and n >= min_count}
    near = {w: [v for v in words if is_near(w, v)] for w in words}
    form = {w: min(vs, key=lambda v: (-words[v], v)) for w, vs in near.items() if vs}
    form = {w: v for w, v in form.items() if words[v] >= ratio * words[w]}
    out = []
    for w in words:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, words[w], len(near[w]), words[form[w]] if w in form else None))
    return sorted(map(repr, out))


@pytest.fixture(scope="module")
def spelled(spark):
    rng = random.Random(13)
    base = ["".join(rng.choice("abÀÿ") for _ in range(rng.randint(2, 9))) for _ in range(60)]
    rows = []
    for i in range(60):
        words = []
        for _ in range(150):
            w = base[min(int(rng.expovariate(0.08)), 59)]
            if rng.random() < 0.3:
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice("abÀ") + w[at:], w[:at] + rng.choice("abÿ") + w[at + 1 :]])
            words.append(w.upper() if rng.random() < 0.1 else w)
        rows.append((i if i != 7 else None, " ".join(words) + rng.choice(["", "日aĀb", "a×b÷c"])))
    rows += [(100, None), (101, ""), (102, "ab" * 5000), (3, rows[3][1])]
    return rows, spark.createDataFrame([(*r, "form", 5, "key") for r in rows], "doc_id long, text string, root string, n int, key string").repartition(3)


@pytest.mark.parametrize("most", [20_000, 3])
@pytest.mark.parametrize(("length", "count", "drop"), [(6, 5, 199), (2, 1, 3)])
def test_spelling_variants(spelled, monkeypatch, length, count, drop, most):
    monkeypatch.setattr(spelling, "MOST_IN_SUBTREE", most)
    rows, df = spelled
    got = spelling.spelling_variants(df, length, count, 2, drop)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(repr(tuple(r)) for r in got.collect()) == variants_by_force(rows, length, count, 2, drop)


def test_near_pairs_come_once_each_way(spelled, monkeypatch):
    monkeypatch.setattr(spelling, "MOST_IN_SUBTREE", 2)
    words = spelling.vocabulary(spelled[1], 2, 1, 0)
    pairs = [(r["word"], r["near"]) for r in spelling.near_words(words, 2).collect()]
    own = [r["word"] for r in words.collect()]
    assert sorted(pairs) == sorted((a, b) for a in own for b in own if is_near(a, b))


def test_spelling_of_an_empty_table(spelled):
    assert spelling.spelling_variants(spelled[1].filter("1 = 0")).collect() == []
    with pytest.raises(ValueError):
        spelling.spelling_variants(spelled[1], 1)


def test_active_nodes_against_all_pairs():
    rng = random.Random(2)
    for _ in range(200):
        words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(0, 5))) for _ in range(rng.randint(1, 25))})
        assert sorted(spelling.near_in_subtree(words)) == [(i, j) for i in range(len(words)) for j in range(i + 1, len(words)) if is_near(words[i], words[j])]


def test_forms_are_followed_to_the_last(spark):
    rows = [(f"w{i:02}", f"w{i + 1:02}") for i in range(13)] + [("x", "w05")]
    got = {r["word"]: r["root"] for r in spelling.roots(spark.createDataFrame(rows, "word string, form string")).collect()}
    assert got == {w: "w13" for w, _ in rows}
