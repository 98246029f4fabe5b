"""SentencePiece encoding and decoding by weighted finite-state transduction.

A model file is compiled into three transducers: the normaliser (the model's character map, longest
match first; then spaces become U+2581, and one is put before a text), the pieces as a trie whose
arcs write piece ids, and byte fallback arcs for characters that no piece has. A text is composed with them position by position, and the
shortest path in the tropical semiring (weights add along a path, the least sum wins) is its
encoding.

Unigram models weigh a piece by its negative score. BPE models are not a matter of sums: there
an encoding is the one path on which no neighbouring pieces would have merged across their
border. So states of a BPE transducer remember the last piece, and the arc to a next piece
weighs nothing when the border holds and is infinitely heavy (absent) when it does not. Whether
a border holds follows from the order of merges along the right edge of the one piece and the
left edge of the other.

No piece has a space mark after another character, so paths meet before each run of marks:
texts are composed run by run, and runs seen before are not composed again.

The character map is a double array in the model file: it is walked once, into a trie of characters
with outputs. A text goes through it from left to right, and through a second, three-state
transducer for spaces (at the start, after a space, after anything else), which a regular
expression stands for.

Cases: null and empty texts have no ids. A text that the normaliser changes doesn't decode to
itself, but to the normalised text. U+2581 in a text is read as a space. Very long runs are
composed like others and not remembered. Rows with null or equal ids are separate rows. An
empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontime.llm.common import text_chunks

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
INF = float("inf")
#: Runs of text that a worker remembers, and the longest of them.
REMEMBER, REMEMBER_LENGTH = 200_000, 40

NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _wire(data: bytes) -> Iterator[tuple[int, object]]:
    """Field numbers and values of a protocol-buffer message."""

    def number(i):
        value = shift = 0
        while True:
            value |= (data[i] & 127) << shift
            shift += 7
            i += 1
            if data[i - 1] < 128:
                return value, i

    i = 0
    while i < len(data):
        key, i = number(i)
        kind = key & 7
        if kind == 0:
            value, i = number(i)
        else:
            size, i = number(i) if kind == 2 else ({1: 8, 5: 4}[kind], i)
            value, i = data[i : i + size], i + size
        yield key >> 3, value


class Model:
    """Pieces, scores, types and the settings that encoding depends on."""

    def __init__(self, data: bytes):
        self.pieces, self.scores, self.types = [], [], []
        self.kind, self.dummy_prefix, self.squeeze, self.charsmap = UNIGRAM, True, True, b""
        for field, value in _wire(data):
            if field == 1:
                p = dict(_wire(value))
                self.pieces.append(p[1].decode())
                self.scores.append(float(np.frombuffer(p.get(2, b"\0\0\0\0"), "<f4")[0]))
                self.types.append(p.get(3, NORMAL))
            elif field == 2:
                self.kind = dict(_wire(value)).get(3, UNIGRAM)
            elif field == 3:
                n = dict(_wire(value))  # a message that comes in parts is merged
                self.charsmap = n.get(2, self.charsmap)
                self.dummy_prefix, self.squeeze = bool(n.get(3, self.dummy_prefix)), bool(n.get(4, self.squeeze))
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models")


def character_map(data: bytes) -> dict[str, str]:
    """What a precompiled character map replaces, by what.

    Its first four bytes are the size of a double array, whose units hold a label (low byte), whether
    a key ends there (bit 8), where the children are (bits 10 to 30, times 256 if bit 9 is set), or at
    a key's end the place of its output. Outputs follow, each ended by a zero byte.
    """
    if not data:
        return {}
    size = int(np.frombuffer(data[:4], "<u4")[0])
    units, outputs = np.frombuffer(data[4 : 4 + size], "<u4").astype(np.int64), data[4 + size :]
    children = lambda u: (u >> 10) << ((u & 512) >> 6)
    labels = np.arange(1, 256)
    found: dict[str, str] = {}
    todo = [(int(children(units[0])), b"")]  # place that children's labels are added to, key so far
    while todo:
        at, key = todo.pop()
        places = at ^ labels
        places, bytes_ = places[places < len(units)], labels[places < len(units)]
        hit = (units[places] & (0x80000000 | 255)) == bytes_
        for place, c in zip(places[hit].tolist(), bytes_[hit].tolist(), strict=True):
            unit = int(units[place])
            below = place ^ children(unit)
            longer = key + bytes([c])
            if unit >> 8 & 1:
                start = int(units[below]) & 0x7FFFFFFF
                found[longer.decode()] = outputs[start : outputs.index(b"\0", start)].decode()
            todo.append((below, longer))
    return found


class Normaliser:
    """The character map and the handling of spaces."""

    def __init__(self, model: Model):
        self.dummy_prefix, self.squeeze = model.dummy_prefix, model.squeeze
        rules = character_map(model.charsmap)
        kept = {model.pieces[i]: model.pieces[i] for i, t in enumerate(model.types) if t == USER} if rules else {}
        self.trie: dict = {}  # nested by character; "" holds the output of the key that ends there
        for key, out in (rules | kept).items():
            node = self.trie
            for c in key:
                node = node.setdefault(c, {})
            node[""] = out
        starts = "".join(map(re.escape, self.trie))
        self._may_start = re.compile(f"[{starts}]") if starts else None

    def _mapped(self, text: str) -> str:
        """The text with the longest match at each place replaced, from left to right."""
        out, end = [], 0
        m = self._may_start.search(text)
        while m:
            i = j = m.start()
            node, best = self.trie, None
            while j < len(text) and (node := node.get(text[j])) is not None:
                j += 1
                if "" in node:
                    best = (j, node[""])
            if best is None:
                m = self._may_start.search(text, i + 1)
                continue
            out += [text[end:i], best[1]]
            end = best[0]
            m = self._may_start.search(text, end)
        return "".join([*out, text[end:]])

    def __call__(self, text: str) -> str:
        if self._may_start is not None:
            text = self._mapped(text)
        if self.squeeze:
            text = _SPACES.sub(" ", text).strip(" ")
        if not text:
            return ""
        out = (MARK if self.dummy_prefix else "") + text.replace(" ", MARK)
        return out.rstrip(MARK) if self.squeeze else out  # a mark that a text ends with goes like a space


_SPACES = re.compile("  +")


class Transducer:
    """The compiled normaliser, pieces and byte fallback of one model."""

    def __init__(self, model: Model):
        self.model = model
        usable = [i for i, t in enumerate(model.types) if t in (NORMAL, USER)]
        self.id = {model.pieces[i]: i for i in usable}
        self.trie: dict = {}  # nested by character; "" holds the piece that ends there
        for piece in self.id:
            node = self.trie
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = piece
        self.unknown = next((i for i, t in enumerate(model.types) if t == UNKNOWN), 0)
        self.byte = {int(model.pieces[i][1:-1], 16): i for i, t in enumerate(model.types) if t == BYTE}
        self.weight = {p: -model.scores[i] for p, i in self.id.items()}
        self.worst = max(self.weight.values(), default=0.0) + 10.0
        self.normalise = Normaliser(model)
        self.by_run = not any(MARK in p.lstrip(MARK) for p in self.id)
        self.out = [self._bytes_of(i) for i in range(len(model.pieces))]
        self._edges: dict[str, tuple] = {}
        self._runs: dict[str, tuple] = {}
        self._older: dict[str, tuple] = {}
        self._border: dict[tuple[str, str], bool] = {}  # weights 0 and infinity of BPE arcs

    def _bytes_of(self, i: int) -> bytes:
        piece, kind = self.model.pieces[i], self.model.types[i]
        if kind == BYTE:
            return bytes([int(piece[1:-1], 16)])
        if kind == UNKNOWN:
            return " ⁇ ".encode()
        return b"" if kind == CONTROL else piece.replace(MARK, " ").encode()

    # --- the BPE border weights

    def _halves(self, piece: str) -> tuple[str, str] | None:
        """The two pieces that the last merge of `piece` joins: the split whose border holds."""
        best = None
        for n in range(1, len(piece)):
            a, b = piece[:n], piece[n:]
            if a in self.id and b in self.id and self.holds(a, b, below=self.weight[piece]):
                t = max(self.weight[a] if len(a) > 1 else -INF, self.weight[b] if len(b) > 1 else -INF)
                if t <= self.weight[piece] and best is None:
                    best = (a, b)
        return best

    def edges(self, piece: str) -> tuple[list, list]:
        """Pieces along the right and the left edge, smallest first, each with the time (merge
        weight) at which it is taken into the next larger one."""
        if piece not in self._edges:
            halves = self._halves(piece) if len(piece) > 1 else None
            if halves is None:
                right, left = [(piece, INF)], [(piece, INF)]
            else:
                t = self.weight[piece]
                r, l = self.edges(halves[1])[0], self.edges(halves[0])[1]
                right = [*r[:-1], (r[-1][0], t), (piece, INF)]
                left = [*l[:-1], (l[-1][0], t), (piece, INF)]
            self._edges[piece] = (right, left)
        return self._edges[piece]

    def holds(self, a: str, b: str, below: float = INF) -> bool:
        """Whether no merge earlier than `below` crosses the border between a and b.

        Of equal merges the leftmost comes first.
        """
        xs, ys = self.edges(a)[0], self.edges(b)[1]
        weight, i, j = self.weight, 0, 0
        while True:
            (x, tx), (y, ty) = xs[i], ys[j]
            w = weight.get(x + y)
            if w is not None and w < tx and w <= ty and w < below:
                return False
            if tx == INF and ty == INF:
                return True
            if tx <= ty:
                i += 1
            else:
                j += 1

    # --- composition and shortest path

    def shortest(self, run: str) -> tuple[int, ...]:
        """Ids along the shortest path of a normalised run of characters."""
        return self._finite_path(run) if self.model.kind == BPE else self._cheapest_path(run)

    def _fallback(self, text: str) -> list[int]:
        return [self.byte[b] for b in text.encode()] if self.byte else [self.unknown]

    def _arcs(self, run: str, i: int) -> list[str]:
        """Pieces that start at place i, shortest first; the character itself if none does."""
        found, node = [], self.trie
        for j in range(i, len(run)):
            node = node.get(run[j])
            if node is None:
                break
            piece = node.get("")
            if piece is not None:
                found.append(piece)
        return found if found and len(found[0]) == 1 else [run[i], *found]

    def _finite_path(self, run: str) -> tuple[int, ...]:
        """BPE: arcs weigh 0 or infinity, so any path of finite weight is the shortest, and only one
        exists. It is sought depth first, longest pieces first. A place that can't be left again
        is given up for good: whatever way leads there ends with the same piece."""
        n, piece_id, border, holds = len(run), self.id, self._border, self.holds
        given_up: set[int] = set()
        path: list[tuple[int, str | None, list[str], str]] = []
        i, last, arcs = 0, None, self._arcs(run, 0)
        while i < n:
            while arcs:
                piece = arcs.pop()
                j = i + len(piece)
                if j in given_up:
                    continue
                if piece not in piece_id:
                    path.append((i, last, arcs, piece))
                    i, last = j, None
                    break
                if last is not None:
                    key = (last, piece)
                    ok = border.get(key)
                    if ok is None:
                        ok = holds(last, piece)
                        if len(border) >= REMEMBER:
                            border.clear()
                        border[key] = ok
                    if not ok:
                        continue
                path.append((i, last, arcs, piece))
                i, last = j, piece
                break
            else:
                given_up.add(i)
                i, last, arcs, _ = path.pop()
                continue
            if i < n:
                arcs = self._arcs(run, i)
        ids: list[int] = []
        for _, _, _, piece in path:
            if piece in piece_id:
                ids.append(piece_id[piece])
            elif self.byte or not ids or ids[-1] != self.unknown:
                ids += self._fallback(piece)
        return tuple(ids)

    def _cheapest_path(self, run: str) -> tuple[int, ...]:
        """Unigram: the path with the least sum of weights."""
        n, piece_id, weight = len(run), self.id, self.weight
        cost, arc = [INF] * (n + 1), [""] * (n + 1)
        cost[0] = 0.0
        for i in range(n):
            for piece in self._arcs(run, i):
                w = cost[i] + weight.get(piece, self.worst)
                if w < cost[i + len(piece)]:
                    cost[i + len(piece)], arc[i + len(piece)] = w, piece
        pieces, j = [], n
        while j:
            pieces.append(arc[j])
            j -= len(arc[j])
        ids: list[int] = []
        for piece in reversed(pieces):
            if piece in piece_id:
                ids.append(piece_id[piece])
            elif self.byte or not ids or ids[-1] != self.unknown:
                ids += self._fallback(piece)
        return tuple(ids)

    def encode(self, text: str) -> list[int]:
        whole = self.normalise(text)
        if not self.by_run:
            return list(self.shortest(whole)) if whole else []
        ids: list[int] = []
        runs = self._runs
        for run in _RUN.findall(whole):
            found = runs.get(run)
            if found is None:
                found = self._older.get(run) or self.shortest(run)
                if len(run) <= REMEMBER_LENGTH:
                    if len(runs) >= REMEMBER:  # runs not seen since the last change are forgotten
                        self._older, self._runs = runs, {}
                        runs = self._runs
                    runs[run] = found
            ids += found
        return ids

    def decode(self, ids: list[int]) -> str:
        out = self.out
        text = b"".join([out[i] for i in ids])
        if self.model.dummy_prefix and text[:1] == b" ":
            text = text[1:]
        return text.decode("utf-8", "replace")


_RUN = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_compiled: dict[str, Transducer] = {}


def transducer(data: bytes) -> Transducer:
    """The transducer of a model file's content, compiled once in each worker."""
    key = hashlib.sha256(data).hexdigest()
    if key not in _compiled:
        _compiled[key] = Transducer(Model(data))
    return _compiled[key]


def _model(path: str) -> bytes:
    with open(path, "rb") as f:  # half a MB, read by the driver and sent along
        return f.read()


def encode(docs: DataFrame, model: str = MODEL, check: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids, round_trip, decoded_sha256: one row for each row of docs.

    round_trip: decoding the ids gives the text again (with U+2581 read as a space). The model file is
    read by the driver and sent along.
    """
    sent = docs.sparkSession.sparkContext.broadcast(_model(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(sent.value)
        for batch in text_chunks(batches):
            texts = [x or "" for x in batch.column("text").to_pylist()]
            ids = [t.encode(x) for x in texts]
            sizes = np.array([len(x) for x in ids], dtype=np.int64)
            flat = np.fromiter((i for x in ids for i in x), dtype=np.int32, count=int(sizes.sum()))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat))
            back = [t.decode(x) for x in ids] if check else [None] * len(ids)
            same = [a == b.replace(MARK, " ") for a, b in zip(back, texts, strict=True)] if check else back
            digest = [hashlib.sha256(x.encode()).hexdigest() for x in back] if check else back
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes), lists, pa.array(same, pa.bool_()), pa.array(digest, pa.string())],
                ["doc_id", "n_tokens", "ids", "round_trip", "decoded_sha256"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, round_trip boolean, decoded_sha256 string")


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, text from rows of doc_id, ids. Null ids give an empty text."""
    sent = encoded.sparkSession.sparkContext.broadcast(_model(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(sent.value)
        for batch in batches:
            text = [t.decode(x or []) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(text, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")
