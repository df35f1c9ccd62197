"""Operators 11 to 13 and their helpers against brute force, with edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from framelens.llm import common, lexical, scratch, substrings, trie
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def ws(text):
    return WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


# -- helpers ----------------------------------------------------------------
def test_word_hashes_follow_words():
    texts = ["Hello wOrld, héllo\x00x9", "", None, "a b", "c", " d e", "ÉA9_x", "x" * 64, "x" * 65, "y" * 500, "X" * 65]
    raw, offsets = common.text_buffer(pa.array(texts))
    starts, ends, bounds = common.word_spans(raw, offsets)
    assert np.diff(bounds).tolist() == [len(ws(t)) for t in texts]
    same = {}
    for w, h in zip((w for t in texts for w in ws(t)), common.span_hashes(raw, starts, ends).tolist()):
        assert same.setdefault(w, h) == h
    assert len(set(same.values())) == len(same)


def test_word_hashes_tell_thue_morse_words_apart():
    word = "ab"
    while len(word) < 4096:
        word += word.translate(str.maketrans("ab", "ba"))
    for n in (64, 2048):  # a polynomial modulo 2**64 takes the long pair for one word
        raw, offsets = common.text_buffer(pa.array([word[:n], word[n:2 * n]]))
        a, b = common.span_hashes(raw, *common.word_spans(raw, offsets)[:2])
        assert a != b


def test_scratch_tables_are_deleted(spark):
    s = scratch.Scratch(spark)
    a = s.keep("a", spark.range(5).withColumn("x", F.lit("y")))
    s.keep("b", a.groupBy("x").count())
    assert a.count() == 5 and s.live["b"].first()["count"] == 5
    s.close("b")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(s.folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    assert [f.getPath().getName() for f in files] == ["b"]
    assert spark.conf.get(scratch.RELEASE, "false") == "false"


# -- 11 ---------------------------------------------------------------------
def brute_trie(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    full = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        full[c] = tuple(own.get(c - c % 5, [])[:h] + turns[h:])
    members = {}
    for c in sorted(full):
        for d in range(len(full[c]) + 1):
            members.setdefault(full[c][:d], []).append(c)
    out = []
    for p, m in members.items():
        below = [q for q in members if q[:len(p)] == p]
        ends = ",".join(str(c) for c in m if full[c] == p)
        out.append((m[0], len(p), members[p[:-1]][0] if p else None, len(m),
                    sum(len(q) == len(p) + 1 for q in below),
                    sum(not any(len(r) == len(q) + 1 and r[:-1] == q for r in below) for q in below),
                    sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below if q),
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


TURNS = "conv_id long, turn long, role string, text string, name string, chain int"
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def nodes(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], TURNS)  # extra columns with the operator's own names
    got = trie.prefix_trie(trie.share_openings(trie.sequences(df))).select(*NODE).collect()
    return sorted((tuple(r) for r in got), key=str)


def test_trie_equals_brute_force(spark):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "bot"]), rng.choice(["", "a", "é" * 3, "word " * 9]))
            for c in range(70) for t in range(rng.choice([1, 2, 3, 8, 13]))]
    rows += [(c, t, "user", "same") for c in range(100, 140) for t in range(6)]              # a group of copies
    rows += [(200, t, "user", str(t % 7)) for t in range(37)] + [(201, t, "bot", "z") for t in range(64)]
    rows += [(300, None, "user", "first"), (300, 2, None, None), (300, 1, "bot", "x" * 5000), (None, 1, "user", "gone")]
    rows += [(301, 5, "user", "tie"), (301, 5, "user", "tie"), (302, 0, "", "")]             # repeated rows are turns
    assert nodes(spark, rows) == brute_trie(rows)


@pytest.mark.parametrize("rows", [[], [(None, 1, "user", "x")], [(7, 1, None, None)], [(3, 0, "a", "b")]])
def test_trie_of_few_rows(spark, rows):
    assert nodes(spark, rows) == brute_trie(rows)


def test_trie_ranks_by_size_not_by_turns(spark):
    rows = [(c, t, "user", f"{t}" if t < 90 else f"{c}-{t}") for c in range(0, 15, 5) for t in range(100)]
    got = nodes(spark, rows)
    assert got == brute_trie(rows) and max(r[1] for r in got) == 100


# -- 12 ---------------------------------------------------------------------
def brute_search(docs, items, k=10):
    bags = [(i, Counter(ws(t))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    n_docs, total = len(bags), sum(n for _, _, n in bags)
    df = Counter(w for _, b, _ in bags for w in b)
    terms = {}
    for i, t in dict.fromkeys(items):
        terms.setdefault(i, Counter()).update(ws(t))
    out = []
    for item, bag in terms.items():
        found = []
        for i, b, n in bags:
            m = 100 - 75 + ((75 * n * n_docs) // total)
            score = sum(r * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1)))
                        * ((1000000000 * b[w]) // (1000 * b[w] + 8 * m)) for w, r in bag.items() if w in b)
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, rank + 1, i, -s) for rank, (s, _, _, i) in enumerate(sorted(found, key=lambda x: x[:3])[:k])]
    return sorted(out, key=str)


def searched(spark, docs, items, **more):
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, score int")
    b = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, rank string")
    return sorted((tuple(r) for r in lexical.search(d, b, **more).collect()), key=str)


@pytest.mark.parametrize("block_terms", [7, 1 << 20])
def test_search_equals_brute_force(spark, block_terms):
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choices([f"w{i}" for i in range(90)], [1 / (i + 1) for i in range(90)], k=n))
    docs = [(i, text(rng.choice([0, 1, 5, 40, 300]))) for i in range(120)]
    docs += [(500 + i, "w1 w2 w3, common") for i in range(30)]            # ties, and a group of copies
    docs += [(7, "w1 W2"), (7, "w1 W2"), (None, "w5 w6 w7"), (600, None), (601, ""), (602, " ,;"), (603, "É x" * 20000)]
    items = [(i, text(n)) for i, n in enumerate([1, 3, 20, 400])] + [(4, "w1 w1 w1 w2"), (5, None), (6, ""), (None, "w7 é"),
                                                                    (8, "absent"), (9, "common"), (9, "common"), (9, "w3")]
    assert searched(spark, docs, items, block_terms=block_terms) == brute_search(docs, items)


def test_search_with_more_terms_than_a_machine_word(spark):
    rng = random.Random(6)
    docs = [(i, " ".join(rng.sample([f"t{j}" for j in range(200)], 60))) for i in range(80)]
    items = [(1, " ".join(f"t{j}" for j in range(200))), (2, " ".join(f"t{j}" for j in range(0, 200, 3)))]
    assert searched(spark, docs, items) == brute_search(docs, items)


def test_search_of_empty_tables(spark):
    assert searched(spark, [], [(1, "a")]) == [] and searched(spark, [(1, "a")], []) == []
    assert searched(spark, [(1, None)], [(1, "a")]) == []


def test_masks_group_equal_documents():
    held = [[0, 2, 3], [], [2, 3, 5]] + [[5]] * 70
    masks, number = lexical.group_masks([np.array(h, np.int64) for h in held], 6)
    for doc in range(6):
        assert [doc in h for h in held] == masks[number[doc]].tolist()
    assert number[2] == number[3] and number[1] == number[4] and len(set(number.tolist())) == len(masks) == 4


# -- 13 ---------------------------------------------------------------------
def brute_repeats(rows, threshold):
    first, out = {}, []
    key = [(-1 << 63) if i is None else i for i, _ in rows]
    bodies = [(t or "").encode() for _, t in rows]
    for i, b in zip(key, bodies):
        for p in range(len(b) - threshold + 1):
            s = b[p:p + threshold]
            first[s] = min(first.get(s, (i, p)), (i, p))
    for (doc, _), i, b in zip(rows, key, bodies):
        gone = bytearray(len(b))
        for p in range(len(b) - threshold + 1):
            if first[b[p:p + threshold]] < (i, p):
                gone[p:p + threshold] = b"\1" * threshold
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = len(re.findall(b"\1+", bytes(gone)))
        out.append((doc, len(b), sum(gone), runs, kept, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def cut(spark, rows, threshold):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, version int, low string")
    got = substrings.deduplicate(df, threshold)
    assert got.columns == ["doc_id", "text", "version", "low", "deduped"]
    return sorted(((r.doc_id, d.n_bytes, d.n_removed, len(d.spans), bytes(d.kept), d.kept_sha256)
                   for r in got.collect() for d in [r.deduped]), key=str)


@pytest.mark.parametrize("threshold", [2, 8, 13, 100])
def test_removed_bytes_equal_brute_force(spark, threshold):
    rng = random.Random(threshold)
    pick = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    base = pick("ab é", 900)
    rows = []
    for i in range(60):
        x = rng.randint(0, 700)
        rows.append((i, pick("abcdefgh", rng.randint(0, 200)) + base[x:x + rng.randint(0, 250)] + pick("ab", rng.randint(0, 40))))
    rows += [(100, None), (101, ""), (102, "a" * 300), (103, "a" * 30), (104, rows[3][1]), (105, rows[3][1] * 2)]
    rows += [(None, rows[5][1]), (106, rows[7][1]), (106, rows[8][1] + "tail"), (106, rows[8][1] + "tail")]  # versions of one id
    assert cut(spark, rows, threshold) == brute_repeats(rows, threshold)


def test_large_group_with_one_shared_passage(spark):
    rng = random.Random(1)
    line = "".join(rng.choice("abcdefghij ") for _ in range(150))
    rows = [(i, "".join(rng.choice("klmnop") for _ in range(60)) + line + "".join(rng.choice("qrst") for _ in range(60)))
            for i in range(400)]
    got = cut(spark, rows, 100)
    assert got == brute_repeats(rows, 100)
    assert sum(r[2] > 0 for r in got) == 399


def test_long_text_in_parts(spark):
    half = np.random.default_rng(0).integers(97, 123, 3 * substrings.PIECE // 2, dtype=np.uint8).tobytes().decode()
    got = cut(spark, [(1, half + "-" + half), (2, half[1000:2000])], 100)
    assert [(r[1], r[2], r[3]) for r in got] == [(2 * len(half) + 1, len(half), 1), (1000, 1000, 1)]
    assert got[0][4] == (half + "-").encode()


def test_substrings_of_empty_tables(spark):
    assert cut(spark, [], 100) == []
    assert cut(spark, [(1, None), (2, "short")], 100) == brute_repeats([(1, None), (2, "short")], 100)


def test_anchors_cover_every_window_once():
    rng = np.random.default_rng(2)
    for texts in (["a" * 300, "", "b" * 99, "c" * 100], ["".join(rng.choice(list("ab"), 500)), "xyz" * 80]):
        raw, offsets = common.text_buffer(pa.array(texts))
        row, start, low, high, _ = substrings.anchors(raw, offsets, 100)
        seen = [p for a, b in zip(low, high) for p in range(a, b + 1)]
        want = [p for i, t in enumerate(texts) for p in range(offsets[i], offsets[i] + max(0, len(t) - 99))]
        assert seen == want and (low <= start).all() and (start + 32 <= low + 100).all() and (start >= high).all()
        assert (offsets[row] <= low).all()
