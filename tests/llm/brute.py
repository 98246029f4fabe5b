"""Plain Python versions of the operators, for small inputs. Rows are dicts."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

SPACE, WORD = re.compile(r"[\x20\x09-\x0D]+"), re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def exact(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[SPACE.sub(" ", r["text"] or "")].append(r["doc_id"])
    return {
        i: (min(ids), len(ids), i == min(ids), hashlib.sha256(t.encode()).hexdigest())
        for t, ids in groups.items()
        for i in ids
    }


def targets(sizes, weights=(3, 1, 2), share=1.5, repeats=2):
    """Shares by weight; what is above a cap is shared out again until none is."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, free, out = share * sum(sizes.values()), set(order), {}
    while free:
        level = left / sum(w[s] for s in free)
        full = {s for s in free if w[s] * level > repeats * sizes[s] + 1e-9}
        if not full:
            out |= {s: w[s] * level for s in free}
            break
        for s in full:
            out[s] = float(repeats * sizes[s])
            left -= out[s]
        free -= full
    return out


def apportion(claims, seats):
    """Seats one by one to the highest quotient claim / (2k + 1); ties go to the first."""
    got = [0] * len(claims)
    for _ in range(seats):
        best = max(range(len(claims)), key=lambda i: (claims[i] / (2 * got[i] + 1), -i))
        got[best] += 1
    return got


def quantile(values, p):
    """The least value that a share p of all values doesn't exceed."""
    return sorted(values)[max(1, -(-round(100 * p) * len(values) // 100)) - 1]


def bucket(rate):
    """Least value and upper end of the bucket of a rate, cut to 20 bits after the point and to its leading 9."""
    v = math.floor(rate * 2**20)
    step = 2 ** max(0, v.bit_length() - 9)
    low = v // step * step
    return low / 2**20, (low + step if low else 0) / 2**20


def fences(values, table, level, multiple, both, wider=1.0):
    """(low, high) of a group's rates, table being those of all texts."""
    high = lambda v, p: bucket(quantile(v, p))[1]
    low = lambda v, p: bucket(quantile(v, p))[0]
    up = high(values, level) + multiple * max(high(v, level) - low(v, 0.5) for v in (values, table)) * wider
    other = round(1 - level, 2)
    down = low(values, other) - multiple * max(high(v, 0.5) - low(v, other) for v in (values, table)) * wider if both else -1e9
    return down, up


def quality_kept(rows, rules, shrink):
    """Verdicts from sorted lists of rates; rules as the operator has them."""
    shouts = lambda t, chars: sum(c in chars for c in t or "")
    seen = {}
    for r in rows:
        n, chars, symbols, dup, repeat, failed = quality(r["text"])
        lines = sum(bool(words(x)) for x in (r["text"] or "").split("\n"))
        seen[r["doc_id"]] = (failed, {"n_words": n, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": repeat, "n_lines": lines,
                                      "n_shouts": shouts(r["text"], "!?"), "n_capitals": shouts(r["text"], "ABCDEFGHIJKLMNOPQRSTUVWXYZ")})
    good = [r for r in rows if not seen[r["doc_id"]][0]]
    out = {}
    for r in rows:
        failed, c = seen[r["doc_id"]]
        keep = not failed
        if keep:
            lang = [g for g in good if g["lang"] == r["lang"]]
            group = [g for g in lang if g["source"] == r["source"]]
            for count, length, level, multiple, both in rules.values():
                rates = [[seen[g["doc_id"]][1][count] / max(seen[g["doc_id"]][1][length], 1) for g in x] for x in (good, lang, group)]
                down, up = fences(rates[0], rates[0], level, multiple, both, (len(good) + shrink) / len(good))
                for mine in rates[1:]:
                    d, u = fences(mine, rates[0], level, multiple, both)
                    down, up = ((len(mine) * a + shrink * b) / (len(mine) + shrink) for a, b in ((d, down), (u, up)))
                keep &= (c[count] - 1) / max(c[length], 1) <= up and (c[count] + 1) / max(c[length], 1) >= down
        out[r["doc_id"]] = keep
    return out


def quality(text):
    text = text or ""
    w = words(text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = {g for g, n in Counter(grams).items() if n > 1}
    hit = {j for i, g in enumerate(grams) if g in often for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if words(x)]
    failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), failed


def repeated_bytes(rows, size=400):
    """Bytes covered by a string of `size` bytes that also starts anywhere else."""
    at = defaultdict(list)
    for n, r in enumerate(rows):
        b = (r["text"] or "").encode()
        for i in range(len(b) - size + 1):
            at[b[i : i + size]].append((n, i))
    gone = defaultdict(set)
    for places in at.values():
        if len(places) > 1:
            for n, i in places:
                gone[n].update(range(i, i + size))
    out = {}
    for n, r in enumerate(rows):
        b, g = (r["text"] or "").encode(), gone[n]
        kept = bytes(x for i, x in enumerate(b) if i not in g)
        out[r["doc_id"]] = (len(b), len(g), sum(i - 1 not in g for i in g), hashlib.sha256(kept).hexdigest())
    return out


def repeated_words(rows, size=13):
    first = {}
    for r in rows:
        w = words(r["text"])
        for i in range(len(w) - size + 1):
            k = tuple(w[i : i + size])
            first[k] = min(first.get(k, r["doc_id"]), r["doc_id"])
    out = {}
    for r in rows:
        w, gone = words(r["text"]), set()
        for i in range(len(w) - size + 1):
            if first[tuple(w[i : i + size])] < r["doc_id"]:
                gone.update(range(i, i + size))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[r["doc_id"]] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left = [i]
        for j, y in enumerate(b, 1):
            left.append(min(row[j] + 1, left[-1] + 1, row[j - 1] + (x != y)))
        row = left
    return row[-1]


def toxicity(text, model):
    """(score, hits, misspelled hits); the first letter is never misspelled."""
    trim, marks, window = "\"'`.,;:!?()[]{}<>«»“”‘’„-–—*_~#|", ".,;:!?", 6
    words_ = (text or "").lower().split()
    found = []
    for i, w in enumerate(words_):
        w, best = w.strip(trim), None
        for t, (term, beginning) in enumerate(model["terms"]):
            if beginning:
                e = 0 if w.startswith(term) else None
            else:
                most = 0 if len(term) < 5 else 1 if len(term) < 10 else 2
                e = edit_distance(w[1:], term[1:]) if w[:1] == term[0] else None
                e = e if e is not None and e <= most else None
            if e is not None and (best is None or (e, t) < best):
                best = (e, t)
        if best:
            found.append((i, *best))
    x = [1.0] + [0.0] * 5
    if found:

        def mark(w, places):
            return w != "" and w[0 if places == "open" else -1] in ("\"“„«‘'" if places == "open" else "\"”“»’'")

        def quoted(i):
            sides = []
            for step, wanted, other in ((-1, "open", "close"), (1, "close", "open")):
                ok = False
                for j in range(i, i + step * (window + 1), step):
                    if not 0 <= j < len(words_):
                        break
                    w = words_[j].strip(marks)
                    if j != i and mark(w, other):
                        break
                    if mark(w, wanted):
                        ok = True
                        break
                sides.append(ok)
            return all(sides)

        weight = {i: model["quote"] if quoted(i) else 1.0 for i, _, _ in found}
        exact, fuzzy = (sum(weight[i] for i, e, _ in found if bool(e) == b) for b in (False, True))
        variety = sum(max(weight[i] for i, _, t in found if t == term) for term in {t for _, _, t in found})
        near = [words_[j].strip(trim) for i, _, _ in found for j in range(max(0, i - window), min(len(words_), i + window + 1)) if j != i]
        x[1:] = [math.log1p(exact), math.log1p(fuzzy), min(variety, 6) / 2, math.sqrt(100 * (exact + fuzzy) / len(words_)), sum(model["context"].get(w, 0.0) for w in near) / max(len(near), 1)]
    return 1 / (1 + math.exp(-sum(a * b for a, b in zip(x, model["weights"], strict=True)))), len(found), sum(bool(e) for _, e, _ in found)


def simhash(text):
    import xxhash

    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near(rows, bits=3):
    prints = {r["doc_id"]: simhash(r["text"]) for r in rows}
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= bits and find(a) != find(b):
                a2, b2 = sorted((find(a), find(b)))
                root[b2] = a2
    return {i: (f"{prints[i]:016x}", find(i)) for i in ids}


def shingles(text, width=5):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())


def near_jaccard(rows, width=5, similarity=0.8):
    """Each id's group, named by its smallest id; every pair of sets is compared."""
    sets = {r["doc_id"]: shingles(r["text"], width) for r in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            alike = both / (len(sets[a]) + len(sets[b]) - both) >= similarity if sets[a] or sets[b] else True
            if alike and find(a) != find(b):
                a2, b2 = sorted((find(a), find(b)))
                root[b2] = a2
    return {i: find(i) for i in ids}


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def secrets(text):
    text = text or ""
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    n = Counter(f[2] for f in found)
    joined = ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(found))
    return n["assign"], n["access"], n["hex"], hashlib.sha256(joined.encode()).hexdigest(), joined
