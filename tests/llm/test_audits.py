"""Merkle manifest, filter audit and decontamination against brute force on small, awkward tables."""

import hashlib
import random
import re
import zlib
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from ontime.llm import decontaminate, filter_audit, merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
CLASHING = "tree lo hi size digest item path top prefix mask id part words start end _t _p _b n".split()


def some_words(rng, n, vocabulary=30):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def sample(seed, n=90):
    rng = random.Random(seed)
    texts = [some_words(rng, rng.randrange(0, 120)) for _ in range(n)]
    texts += ["", None, "", " ", "# $", "É É é", "ABC DEF", "日本語 " * 60, "x" * 3000, *texts[:9], *[texts[5]] * 20, texts[1] + " end", (texts[1] or "")[:20]]
    rows = [(i, t, rng.choice(["en", None, ""]), rng.choice([None, "", "a", "a", "a", "é", "z"]), rng.choice([None, i])) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, "no id A", "en", "a", 1), (None, "no id A", "en", "a", 1), (4, "other", "en", "z", 2)]
    rng.shuffle(rows)
    return rows


def frame(spark, rows, parts=5):
    return spark.createDataFrame(rows, SCHEMA).repartition(parts).withColumns({c: F.lit(1) for c in CLASHING})


# --- Merkle manifest


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(doc_id, text, lang, source, n_chars):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return H(*map(field, (doc_id, source, lang, n_chars, text)))


def climb(nodes):
    """(top, siblings of each leaf as (left, right) level by level) of a list of digests."""
    paths, owner = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        above, leaves = [], []
        for a in range(0, len(nodes), 16):
            run = nodes[a : a + 16]
            for j in range(len(run)):
                for i in owner[a + j]:
                    paths[i].append(("".join(run[:j]), "".join(run[j + 1 :])))
            above.append(H(*run))
            leaves.append([i for o in owner[a : a + 16] for i in o])
        nodes, owner = above, leaves
    return nodes[0], paths


def brute_manifest(rows):
    by_source = {}
    for r in rows:
        by_source.setdefault(r[3], []).append(r)
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        leaves = sorted(by_source[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(*r)))
        trees[s] = leaves, *climb([leaf_of(*r) for r in leaves])
    root, up = climb([trees[s][1] for s in order])
    out = []
    for k, s in enumerate(order):
        leaves, subroot, paths = trees[s]
        for r, path in zip(leaves, paths, strict=True):
            path = path + up[k]
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            acc = leaf_of(r[0], r[1].translate(LOWER) if hit and r[1] is not None else r[1], *r[2:])
            for left, right in path:
                acc = H(left, acc, right)
            out.append((str(r[0]), leaf_of(*r), subroot, root, H(*[x for p in path for x in p]), acc, acc == root))
    return out


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


@pytest.mark.parametrize(("n", "few"), [(90, 100_000), (400, 0)])
def test_manifest(spark, n, few, monkeypatch):
    monkeypatch.setattr(merkle, "FEW", few)
    rows = [(i, t and t.replace("w1", "W1"), *rest) for i, t, *rest in sample(n, n)]
    got = merkle.merkle_manifest(frame(spark, rows)).select(*COLUMNS).collect()
    want = brute_manifest(rows)
    assert sorted((str(r[0]), *r[1:]) for r in got) == sorted(want)
    assert {r["verified"] for r in got} == {True, False}


@pytest.mark.parametrize("n", [1, 16, 257])
def test_manifest_at_the_edges_of_levels(spark, n):
    rows = [(i, "A text", "en", "s", i) for i in range(n)]
    got = merkle.merkle_manifest(frame(spark, rows)).select(*COLUMNS).collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == sorted(brute_manifest(rows))


def test_manifest_of_many_sources_and_of_none(spark):
    rows = [(i, "t", None, f"s{i}", i) for i in range(40)]
    got = merkle.merkle_manifest(frame(spark, rows)).select(*COLUMNS).collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == sorted(brute_manifest(rows))
    assert merkle.merkle_manifest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_manifest_has_no_python_on_its_path(spark):
    from ontime.plans.inspect import uses_python

    assert not uses_python(merkle.merkle_manifest(frame(spark, sample(1, 20))))


def test_a_narrow_tree(spark):
    """Another fan gives the same proofs as folding by hand, and every row proves itself."""
    rows = sample(8, 40)
    got = merkle.verify(merkle.manifest(frame(spark, rows), fan=3))
    assert got.where("NOT verified").count() == 0 and got.count() == len(rows)


# --- filter audit


def brute_masks(rows):
    first = {}
    last = (1 << 63) - 1
    for i, t, *_ in rows:
        first[t or ""] = min(first.get(t or "", last), last if i is None else i)
    out = []
    for i, t, _, source, _ in rows:
        t = t or ""
        w = WORD.findall(t)
        bits = [len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search("[#$%&*|]", t)), first[t] < (last if i is None else i)]
        out.append((i, source or "", sum(b << k for k, b in enumerate(bits))))
    return out


def brute_audit(rows, labels):
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, x in labels if x == 1}
    found = {}
    for part in {p for _, p, _ in brute_masks(rows)}:
        mine = [(i, m) for i, p, m in brute_masks(rows) if p == part]
        whole = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                bit = 1 << "ABCDE".index(f)
                gone, stay = [x for x in left if x[1] & bit], [x for x in left if not x[1] & bit]
                failing = sum(bool(m & bit) for _, m in mine)
                found[part, "".join(order), step] = [len(stay), len(gone), failing - len(gone), sum(m == bit for _, m in mine), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
                whole[f] += len(gone)
                left = stay
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                found[part, "".join(order), step].append(whole[f])
    return {(*k, *v) for k, v in found.items()}


AUDIT = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


@pytest.mark.parametrize(("seed", "trie", "seen", "parts"), [(0, 8 << 20, 32 << 20, None), (1, 40, 300, 10), (2, 1, 0, 10**9)])
def test_audit(spark, seed, trie, seen, parts, monkeypatch):
    """Whole tries and tiny ones: prefixes are lengthened many times, and tasks forget what they saw."""
    monkeypatch.setattr(filter_audit, "SEEN_BYTES", seen)
    rows = sample(seed)
    labels = [(i, i % 2, (i // 2) % 2) for i in range(0, 80)] + [(3, 1, 0), (3, None, 1), (None, 1, 1)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.filter_audit(frame(spark, rows), table, trie_bytes=trie, parts=parts).select(*AUDIT).collect()
    assert {tuple(r) for r in got} == brute_audit(rows, [x for x in labels if x[0] is not None])
    assert len(got) == 600 * len({r[3] or "" for r in rows})
    masks = filter_audit.masks(frame(spark, rows), trie_bytes=trie, parts=parts).collect()
    last = (1 << 63) - 1
    assert sorted((r["id"], r["part"], r["mask"]) for r in masks) == sorted((last if i is None else i, p, m) for i, p, m in brute_masks(rows))


def test_audit_of_nothing(spark):
    labels = spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")
    assert filter_audit.filter_audit(spark.createDataFrame([], SCHEMA), labels).count() == 0
    assert filter_audit.filter_audit(frame(spark, [(1, None, None, None, None)]), labels.limit(0)).count() == 600


@pytest.mark.parametrize("seed", range(4))
def test_trie_holds_what_it_was_given(seed):
    rng = random.Random(seed)
    strings = [bytes(rng.choices(b"ab", k=rng.randrange(0, 12))) for _ in range(400)]
    trie, want = filter_audit.Trie(), {}
    for i, s in enumerate(strings):
        terminal = trie.insert(s)
        assert terminal[0] == want.get(s)
        if s not in want:
            terminal[0] = want[s] = i
    assert sorted(t[0] for t in trie.terminals()) == sorted(want.values())


def test_words_of_long_texts_are_counted_in_stretches(monkeypatch):
    rng = random.Random(3)
    text = some_words(rng, 3000, 2900).encode() + b"\x0b" * 50 + b"y" * 500 + b"\t#"
    whole = filter_audit.mask_of(text)
    monkeypatch.setattr(filter_audit, "STRETCH", 64)
    assert filter_audit.mask_of(text) == whole and b"".join(filter_audit._stretches(text)) == text


def test_prefixes_are_long_enough(spark):
    """No prefix of several texts has more than its share, but for heads of over 4096 characters, which are told apart by digest."""
    rng = random.Random(1)
    texts = ["common head " * 20 + some_words(rng, 5, 999) for _ in range(40)] + ["same text, and so on"] * 30 + [some_words(rng, 4, 999) for _ in range(40)]
    texts += ["x" * 5000 + some_words(rng, 3, 999) for _ in range(5)]
    docs = spark.createDataFrame([(i, "p", t) for i, t in enumerate(texts)], "id long, part string, text string")
    rows = docs.mapInArrow(filter_audit._measure, filter_audit.MEASURED).where("text IS NOT NULL")
    total = rows.agg(F.sum("size")).first()[0]
    got = filter_audit.prefixed(rows, parts=100).groupBy("prefix").agg(F.sum(F.octet_length("text")).alias("n"), F.countDistinct("text").alias("texts")).collect()
    assert all(r["n"] <= total / 100 or r["texts"] == 1 for r in got) and len(got) > 10


# --- decontamination


def brute_leaks(rows, items, window=10):
    wanted = {}
    for i, t in items:
        w = TOKEN.findall((t or "").translate(LOWER))
        size = min(window, len(w))
        for k in range(len(w) - size + 1 if w else 0):
            wanted.setdefault(tuple(w[k : k + size]), set()).add("" if i is None else str(i))
    sizes = {len(k) for k in wanted}
    out = []
    for i, t, *_ in rows:
        w = TOKEN.findall((t or "").translate(LOWER))
        hit, names = set(), set()
        for size in sizes:
            for k in range(len(w) - size + 1):
                found = wanted.get(tuple(w[k : k + size]))
                if found:
                    hit |= set(range(k, k + size))
                    names |= found
        out.append((str(i), len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


LEAKS = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def contaminated(seed):
    rng = random.Random(seed)
    items = [(i, some_words(rng, rng.choice([1, 2, 9, 10, 11, 12, 40]), 40).replace(" ", rng.choice([" ", ", ", "\n"]))) for i in range(25)]
    items += [(100, None), (101, ""), (102, "!?"), (5, some_words(rng, 14)), (None, some_words(rng, 12)), (103, items[4][1]), (104, items[4][1] + " und so weiter"), (105, "É é ÉÉ " * 3)]
    rows = sample(seed, 60)
    for k, (_, t) in enumerate(items * 2):
        rows.append((1000 + k, f"{some_words(rng, rng.randrange(6))} {(t or '').upper() if k % 3 else t} {some_words(rng, 3)}", "en", "a", 1))
    return rows, items


@pytest.mark.parametrize(("seed", "shard", "block"), [(0, 1 << 20, 4 << 20), (1, 25, 4 << 20), (2, 70, 1500), (3, 1 << 20, 800)])
def test_leaks(spark, seed, shard, block):
    """One shard and many, one block of items and so many that tables are written between them."""
    rows, items = contaminated(seed)
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = frame(spark, rows).withColumns({c: F.lit(2) for c in ("hits", "items", "n_words", "longest")})
    got = decontaminate.report(decontaminate.scan(docs, bench, shard=shard, block_bytes=block)).select(*LEAKS).collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == brute_leaks(rows, items)
    if seed == 0:
        clean = decontaminate.decontaminate(docs, bench)
        assert clean.columns == docs.columns
        assert sorted((str(r["doc_id"]), r["text"] is None, r["hits"]) for r in clean.collect()) == sorted((i, any(r[0] == int(i) and r[1] is None for r in rows if i != "None"), 2) for i, *_, bad in brute_leaks(rows, items) if not bad)


def test_nothing_to_find(spark):
    rows, items = contaminated(4)
    none = spark.createDataFrame([], "item_id long, text string")
    got = decontaminate.report(decontaminate.scan(frame(spark, rows), none)).collect()
    assert len(got) == len(rows) and not any(r["contaminated"] for r in got)
    empty = spark.createDataFrame([], SCHEMA)
    assert decontaminate.scan(empty, spark.createDataFrame(items, "item_id long, text string")).count() == 0


@pytest.mark.parametrize("block", [4 << 20, 1500])
def test_longest_matches_and_their_places(spark, block):
    """Against trying every pair of places."""
    rows, items = contaminated(6)
    rows = [(k, r[1]) for k, r in enumerate(rows[:40] + rows[-30:])]
    table = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.scan(spark.createDataFrame(rows, "doc_id long, text string"), table, block_bytes=block).collect()
    plain = [("" if i is None else str(i), TOKEN.findall((t or "").translate(LOWER))) for i, t in items]
    for r in found:
        w = TOKEN.findall((r["text"] or "").translate(LOWER))
        best = (0, 0, "")
        for name, other in plain:
            run = np.zeros(len(other) + 1, dtype=int)
            for k, x in enumerate(w):
                run[1:] = [run[j] + 1 if other[j] == x else 0 for j in range(len(other))]
                longest = int(run.max())
                if longest >= 10 or longest == len(other) > 0:
                    best = min(best, (-longest, k + 1 - longest, name))
        assert (-r["longest"]["words"], r["longest"]["start"], r["longest"]["item"] or "") == best


@pytest.mark.parametrize("seed", range(5))
def test_suffix_array_is_sorted(seed):
    rng = np.random.default_rng(seed)
    symbols = rng.integers(-1, 3, 200).astype(np.int32)
    array = decontaminate.suffix_array(symbols, 1000)
    tail = lambda i: symbols[i:].tolist() + [-1]
    tails = [tail(i)[: tail(i).index(-1)] for i in array]
    assert sorted(array.tolist()) == np.flatnonzero(symbols >= 0).tolist() and tails == sorted(tails)
