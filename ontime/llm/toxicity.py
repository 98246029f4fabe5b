"""Toxicity by a lexicon that tolerates misspelling, and the words around each hit.

The lexicon is learned: words, and word beginnings where endings vary, that are far more
frequent in documents labelled toxic. It is kept as a trie and intersected with Levenshtein
automata: the states of the product are sets of (trie node, edits), determinised as texts ask
for them, so a word is looked up in one step per character and mostly given up after a few. Short
terms must match exactly, longer ones may differ by one edit or two; the first letter is kept.

Each hit is weighed by its context window. A hit between quotation marks counts a fraction of one
that isn't: the fraction is the ratio of toxic shares among labelled documents whose hits are all
quoted and all others with hits, drawn towards QUOTED as if QUOTED_LIKE such documents had been
seen. So quotations count less even where no label shows one. Words around hits have learned
weights. A logistic model on the weighed counts of exact and misspelled hits, their variety and
density, and their contexts gives the score; the first four never lower it.

Labels are read only for rows whose crc32(doc_id as text) mod 4 is not 2. The fit uses about
`sample` labelled documents at most, chosen by a hash of their ids; terms and context words come
from those documents, without other bounds. Every document is scored, from all its hits.

Cases: null and empty texts have no hits and the score of such documents. A null id is not held
out and never a training row; of rows that share an id one is a training row, the least text.
Texts of any length are read whole, one text at a time beyond the size of a chunk. Without labels
of both kinds there is no lexicon and every score is the share of toxic labels (0 without labels).
Repeated rows are scored alike. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ontime.llm.common import materialise, text_chunks, text_or_empty

SAMPLE = 20_000
WINDOW = 6
PREFIXES = (4, 5, 6)
#: A lexicon entry needs this log-likelihood ratio and this ratio of document frequencies.
LEAST_G, LEAST_RATIO = 18.0, 15.0
LEAST_TOXIC, LEAST_NEAR = 4, 5
#: What a quoted hit counts without labelled quotations, and how many documents that is worth.
QUOTED, QUOTED_LIKE = 0.25, 20.0
_TRIM = "\"'`.,;:!?()[]{}<>«»“”‘’„-–—*_~#|"
_STOPS = ".,;:!?"
_OPEN, _CLOSE = "\"“„«‘'", "\"”“»’'"


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def edits_for(term: str, prefix: bool) -> int:
    """Edits that a term forgives: none for short terms and beginnings."""
    return 0 if prefix or len(term) < 5 else 1 if len(term) < 10 else 2


class FuzzyLexicon:
    """Lexicon trie intersected with Levenshtein automata, determinised on demand."""

    MOST_STATES = 100_000

    def __init__(self, terms: list[tuple[str, bool]]):
        self.terms = terms
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[tuple[int, bool, int]]] = [[]]  # (term, prefix, forgiven edits)
        self.most: list[int] = [0]  # edits that any term below a node forgives
        for i, (term, prefix) in enumerate(terms):
            allowed = edits_for(term, prefix)
            node = 0
            self.most[0] = max(self.most[0], allowed)
            for c in term:
                node = self._child(node, c)
                self.most[node] = max(self.most[node], allowed)
            self.ends[node].append((i, prefix, allowed))
        self._reset()

    def _child(self, node: int, c: str) -> int:
        if c not in self.children[node]:
            self.children[node][c] = len(self.children)
            self.children.append({})
            self.ends.append([])
            self.most.append(0)
        return self.children[node][c]

    def _reset(self) -> None:
        self.number: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.accept: list[tuple[int, int] | None] = []
        self.step: list[dict[str, int]] = []
        self.start = self._state(frozenset({(0, 0)}), {})

    def _state(self, nodes: frozenset, sticky: dict[int, int]) -> int:
        """Number of the state of these (node, edits) and (-1 - term, edits) already accepted."""
        best: dict[int, int] = {}
        todo = sorted(nodes, key=lambda x: x[1])
        for node, e in todo:  # missing letters
            if best.get(node, 9) <= e:
                continue
            best[node] = e
            if node and e < self.most[node]:
                todo.extend((child, e + 1) for child in self.children[node].values() if e + 1 <= self.most[child])
        hits = dict(sticky)
        ends: dict[int, int] = {}
        for node, e in best.items():
            for term, prefix, allowed in self.ends[node]:
                if e <= allowed:
                    into = hits if prefix else ends
                    into[term] = min(into.get(term, 9), e)
        key = frozenset([*best.items(), *((-1 - t, e) for t, e in hits.items())])
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
            found = ends | hits
            self.accept.append(min(((e, t) for t, e in found.items()), default=None))
            self.step.append({})
        return self.number[key]

    def _next(self, state: int, c: str) -> int:
        out, sticky = set(), {}
        for node, e in self.states[state]:
            if node < 0:
                sticky[-1 - node] = e
                continue
            for letter, child in self.children[node].items():
                if letter == c:
                    out.add((child, e))
                elif node and e < self.most[child]:
                    out.add((child, e + 1))
            if node and e < self.most[node]:
                out.add((node, e + 1))
        to = self._state(frozenset(out), sticky) if out or sticky else -1
        self.step[state][c] = to
        return to

    def find(self, word: str) -> tuple[int, int] | None:
        """(edits, term) of the nearest term that the word matches, or None."""
        if len(self.states) > self.MOST_STATES:
            self._reset()
        state, step = self.start, self.step
        for c in word:
            to = step[state].get(c)
            state = self._next(state, c) if to is None else to
            if state < 0:
                return None
        return self.accept[state]


def tokens(text: str) -> list[str]:
    return text.lower().split()


def hits(lexicon: FuzzyLexicon, words: list[str], cache: dict) -> list[tuple[int, int, int]]:
    """(position, edits, term) of each hit."""
    out = []
    for i, w in enumerate(words):
        found = cache.get(w, 0)
        if found == 0:
            found = lexicon.find(w.strip(_TRIM))
            if len(cache) < 300_000:
                cache[w] = found
        if found is not None:
            out.append((i, *found))
    return out


def quoted(words: list[str], i: int) -> bool:
    """Whether word i stands in quotation marks: looking out from it, inside the window, the first
    mark before it opens and the first one after it closes."""

    def outwards(places, wanted: str, other: str, first: bool) -> bool:
        for j in places:
            w = words[j].strip(_STOPS)
            begins, ends = w[:1] in _OPEN and w != "", w[-1:] in _CLOSE and w != ""
            found = {"open": begins, "close": ends}
            if found[other] and not (first and j == i):
                return False
            if found[wanted]:
                return True
        return False

    before, after = range(i, max(-1, i - WINDOW - 1), -1), range(i, min(len(words), i + WINDOW + 1))
    return outwards(before, "open", "close", True) and outwards(after, "close", "open", True)


def around(words: list[str], i: int) -> list[str]:
    near = words[max(0, i - WINDOW) : i] + words[i + 1 : i + 1 + WINDOW]
    return [w.strip(_TRIM) for w in near]


def features(words: list[str], found: list[tuple[int, int, int]], context: dict[str, float], quote: float = QUOTED) -> list[float]:
    """Numbers of one document for the logistic model; the first is the constant. A quoted hit
    counts `quote`."""
    if not found:
        return [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]
    exact = fuzzy = near = 0.0
    n_near = 0
    terms: dict[int, float] = {}
    for i, e, term in found:
        weight = quote if quoted(words, i) else 1.0
        if e:
            fuzzy += weight
        else:
            exact += weight
        terms[term] = max(terms.get(term, 0.0), weight)
        for w in around(words, i):
            near += context.get(w, 0.0)
            n_near += 1
    density = math.sqrt(100 * (exact + fuzzy) / len(words))
    return [1.0, math.log1p(exact), math.log1p(fuzzy), min(sum(terms.values()), 6) / 2, density, near / max(n_near, 1)]


def _terms_of(words: list[str]) -> set[str]:
    """Words and, marked by a star, word beginnings of a document."""
    plain = {w.strip(_TRIM) for w in words} - {""}
    return plain | {w[:n] + "*" for w in plain for n in PREFIXES if len(w) > n}


def _sums(counts: Counter) -> pd.DataFrame:
    out = pd.DataFrame({"term": pd.Series(list(counts.keys()), dtype=object), "n": pd.Series(list(counts.values()), dtype="int64")})
    counts.clear()
    return out


def _frequencies(batches: Iterator[pd.DataFrame], most: int = 200_000) -> Iterator[pd.DataFrame]:
    """Document frequencies of terms, summed up inside each task, at most about `most` at a time."""
    counts: Counter = Counter()
    for pdf in batches:
        for text in pdf["text"]:
            counts.update(_terms_of(tokens(text)))
            if len(counts) > most:
                yield _sums(counts)
    yield _sums(counts)


def ratio_and_g(clean: Column, toxic: Column, n_clean: int, n_toxic: int) -> tuple[Column, Column]:
    """Of document frequencies: toxic against clean, and the log-likelihood ratio against the share
    of toxic documents."""
    n, share = clean + toxic, n_toxic / (n_clean + n_toxic)
    part = lambda x, s: F.when(x > 0, x * F.log(x / (n * F.lit(s)))).otherwise(0.0)
    ratio = ((toxic + 0.5) / F.lit(float(n_toxic))) / ((clean + 0.5) / F.lit(float(n_clean)))
    return ratio, 2 * (part(toxic, share) + part(clean, 1 - share))


def choose_terms(table: list[tuple[str, int]]) -> list[tuple[str, bool]]:
    """Lexicon from telling terms and their toxic document frequencies: (term, whether a beginning).
    A beginning is taken where no single word stands for it."""
    good = dict(table)
    words = sorted(t for t in good if not t.endswith("*"))
    stems: dict[str, int] = {}
    for term in sorted((t for t in good if t.endswith("*")), key=lambda t: (len(t), t)):
        stem = term[:-1]
        if any(stem[:n] in stems for n in PREFIXES if n < len(stem)):
            continue
        whole, i = 0, bisect_left(words, stem)
        while i < len(words) and words[i].startswith(stem):
            whole, i = max(whole, good[words[i]]), i + 1
        if whole < 0.7 * good[term]:
            stems[stem] = good[term]
    left = {w: good[w] for w in words if not any(w[:n] in stems for n in PREFIXES)}
    ranked = sorted([(-v, w, False) for w, v in left.items()] + [(-v, s, True) for s, v in stems.items()])
    return [(w, prefix) for _, w, prefix in ranked]


def _near(terms: list[tuple[str, bool]], most: int = 200_000):
    """Context words of hits and in how many documents; under the empty word: documents with hits,
    and under a quotation mark those whose hits are all quoted."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon, cache, counts = FuzzyLexicon(terms), {}, Counter()
        for pdf in batches:
            for text in pdf["text"]:
                words = tokens(text)
                found = hits(lexicon, words, cache)
                if not found:
                    continue
                counts.update({w for i, _, _ in found for w in around(words, i)} - {"", '"'})
                counts[""] += 1
                counts['"'] += all(quoted(words, i) for i, _, _ in found)
                if len(counts) > most:
                    yield _sums(counts)
        yield _sums(counts)

    return run


def _feature_rows(terms, context, quote):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon, cache = FuzzyLexicon(terms), {}
        for pdf in batches:
            rows = []
            for text in pdf["text"]:
                words = tokens(text)
                rows.append(features(words, hits(lexicon, words, cache), context, quote))
            yield pd.DataFrame({"x": rows, "toxic": pdf["toxic"]})

    return run


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Newton steps for a logistic model with a ridge penalty on all but the constant."""
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty)
    ridge[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit_rising(x: np.ndarray, y: np.ndarray, rising: range) -> np.ndarray:
    """fit_logistic without the features of `rising` that would have a negative weight."""
    used = list(range(x.shape[1]))
    while True:
        w = np.zeros(x.shape[1])
        w[used] = fit_logistic(x[:, used], y)
        worst = min(rising, key=lambda i: w[i])
        if w[worst] >= 0:
            return w
        used.remove(worst)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """Lexicon, context weights and coefficients, from labelled rows that are not held out."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    known = materialise(known.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic")), "toxicity-labels")
    share = min(1.0, sample / max(known.count(), 1))
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.lit(int(share * 1_000_000)))
    texts = docs.select("doc_id", text_or_empty().alias("text")).join(chosen, "doc_id")
    rows = materialise(texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")), "toxicity-sample")
    n_toxic, n_clean = (rows.agg(F.count_if(F.col("toxic") == 1), F.count_if(F.col("toxic") == 0)).first())
    if not n_toxic or not n_clean:
        return {"terms": [], "context": {}, "weights": None, "share": float(bool(n_toxic)), "quote": QUOTED}
    counted = "term string, n long"

    def by_label(count, only: DataFrame | None = None) -> DataFrame:
        """term, clean, toxic"""
        sums = []
        for name, label in (("clean", 0), ("toxic", 1)):
            part = rows.where(F.col("toxic") == label).select("text").mapInPandas(count, counted)
            if only is not None:
                part = part.join(only, "term", "left_semi")
            sums.append(part.groupBy("term").agg(F.sum("n").alias(name)))
        both = sums[0].join(sums[1], "term", "full")
        return both.select("term", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("clean", "toxic")])

    often = rows.where("toxic = 1").select("text").mapInPandas(_frequencies, counted).groupBy("term").agg(F.sum("n").alias("n"))
    often = materialise(often.where(F.col("n") >= LEAST_TOXIC).select("term"), "toxicity-terms")
    ratio, g = ratio_and_g(F.col("clean"), F.col("toxic"), n_clean, n_toxic)
    telling = by_label(_frequencies, often).where((ratio >= LEAST_RATIO) & (g >= LEAST_G)).select("term", "toxic")
    terms = choose_terms([tuple(r) for r in telling.collect()])  # of the sample, few
    near = {r["term"]: (r["clean"], r["toxic"]) for r in by_label(_near(terms)).where(F.col("clean") + F.col("toxic") >= LEAST_NEAR).collect()}
    (any_clean, any_toxic), (all_clean, all_toxic) = (near.pop(k, (0, 0)) for k in ("", '"'))
    quote = quote_weight(all_clean, all_toxic, any_clean, any_toxic)
    total_clean, total_toxic = (sum(v[i] for v in near.values()) for i in (0, 1))
    context = {}
    if total_clean:  # else contexts tell nothing
        context = {w: math.log((t + 1) / (total_toxic + 1)) - math.log((c + 1) / (total_clean + 1)) for w, (c, t) in near.items()}
    got = rows.select("text", "toxic").mapInPandas(_feature_rows(terms, context, quote), "x array<double>, toxic int").toPandas()
    weights = fit_rising(np.array(got["x"].tolist()), got["toxic"].to_numpy(float), range(1, 5))
    return {"terms": terms, "context": context, "weights": weights.tolist(), "share": n_toxic / (n_toxic + n_clean), "quote": quote}


def quote_weight(all_clean: int, all_toxic: int, any_clean: int, any_toxic: int) -> float:
    """What a quoted hit counts, from documents whose hits are all quoted and documents with hits."""
    clean, toxic = any_clean - all_clean, any_toxic - all_toxic
    share = (toxic + 0.5) / (clean + toxic + 1)
    ratio = min(1.0, (all_toxic + QUOTED_LIKE * QUOTED * share) / (all_clean + all_toxic + QUOTED_LIKE) / share)
    return max(ratio, 0.01)


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, score, predicted, n_hits, n_misspelled: one row for each row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        lexicon, cache = FuzzyLexicon(m["terms"]), {}
        weights = None if m["weights"] is None else np.array(m["weights"])
        for batch in text_chunks(batches):
            x, n, fuzzy = [], [], []
            for text in batch.column("text").to_pylist():
                words = tokens(text)
                found = hits(lexicon, words, cache)
                x.append(features(words, found, m["context"], m["quote"]))
                n.append(len(found))
                fuzzy.append(sum(e > 0 for _, e, _ in found))
            if weights is None:
                p = np.full(len(x), m["share"])
            else:
                p = 1 / (1 + np.exp(-np.clip(np.array(x) @ weights, -30, 30)))
            cols = [batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= 0.3).astype(np.int32)), pa.array(n, pa.int64()), pa.array(fuzzy, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "score", "predicted", "n_hits", "n_misspelled"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, n_hits long, n_misspelled long")


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    return score(docs, train(docs, labels, sample))
