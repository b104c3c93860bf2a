"""Benchmark decontamination by a generalised suffix automaton (operator 7).

The words of all benchmark items are numbered and one suffix automaton is built over them; each state knows the items
that hold its strings. Documents stream through it: at each word the automaton gives the length of the longest item
string that ends there. Where that length reaches ``window`` words, the last ``window`` words are an occurrence of a
window; items of fewer words count whole. Word pairs that no item holds end every match of two or more words, so runs of
known pairs are found for a whole text at once and only runs long enough for a window are streamed.

The benchmark is a stated query set of any size. It is cut into blocks of ``block_words`` words, one automaton a block. The
driver builds one block after another from a stream of items and stores it in the scratch folder; a worker has one block
open at a time, holds a batch of documents against it, then opens the next, and hits are united. Items of a state are kept
only where a window is cut off, once for each place in the benchmark.

Words: A-Z lower-cased, then runs of ``[0-9a-z]`` and characters beyond ASCII. Null or word-less texts have no words and
no hits; null or word-less items have no windows; items that are equal are all reported; an empty benchmark gives no
hits, an empty table no rows. Repeated rows are told each, very long texts streamed whole. ``report`` reads the key and the
text only; ``decontaminate`` keeps all columns, whatever their names.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import files
from .common import fresh, ship, slices

_TABLE = bytes((b + 32 if 65 <= b <= 90 else b) if b >= 128 or 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


class Automaton:
    """A suffix automaton of several word sequences.

    ``go[s]`` maps a word number to the next state, ``link[s]`` is the state of the longest proper suffix that other
    contexts share, ``length[s]`` the longest string of the state, ``items[s]`` the sequences that hold its window.
    """

    def __init__(self, sequences: list[tuple[int, list[bytes]]], window: int):
        self.window = window
        self.number: dict[bytes, int] = {}
        self.go: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[tuple[int, int]] = []
        self.whole: dict[int, list[tuple[int, int]]] = {}
        pairs = set()
        for item, words in sequences:
            ids = [self.number.setdefault(w, len(self.number)) for w in words]
            pairs.update(zip(ids, ids[1:], strict=False))
            state = 0
            for w in ids:
                state = self._extend(state, w)
                ends.append((state, item))
        self.least = window
        for item, words in sequences:
            if 0 < len(words) < window:
                state = 0
                for w in words:
                    state = self.go[state][self.number[w]]
                self.whole.setdefault(state, []).append((len(words), item))
                self.least = min(self.least, len(words))
        self._suffixes()
        self.items: dict[int, set[int]] = {}
        for state, item in ends:
            if self.length[state] >= window:
                self.items.setdefault(self.cut[state], set()).add(item)
        self.pairs = np.array(sorted(a * len(self.number) + b for a, b in pairs), np.int64)

    def _copy(self, of: int, length: int) -> int:
        self.go.append(dict(self.go[of]))
        self.link.append(self.link[of])
        self.length.append(length)
        return len(self.go) - 1

    def _redirect(self, state: int, word: int, target: int) -> int:
        """The state that stands for the strings of ``target`` no longer than ``state``'s plus the word."""
        if self.length[target] == self.length[state] + 1:
            return target
        made = self._copy(target, self.length[state] + 1)
        self.link[target] = made
        while state >= 0 and self.go[state].get(word) == target:
            self.go[state][word] = made
            state = self.link[state]
        return made

    def _extend(self, last: int, word: int) -> int:
        if word in self.go[last]:
            return self._redirect(last, word, self.go[last][word])
        self.go.append({})
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        new, state = len(self.go) - 1, last
        while state >= 0 and word not in self.go[state]:
            self.go[state][word] = new
            state = self.link[state]
        if state >= 0:
            self.link[new] = self._redirect(state, word, self.go[state][word])
        return new

    def _suffixes(self) -> None:
        """For each state: the state of its last ``window`` words, and the whole short items that end there."""
        self.cut, self.short = [0] * len(self.go), [()] * len(self.go)
        for s in sorted(range(1, len(self.go)), key=self.length.__getitem__):
            up = self.link[s]
            self.cut[s] = self.cut[up] if up > 0 and self.length[up] >= self.window else s
            self.short[s] = (*self.short[up], *self.whole.get(s, ())) if up >= 0 else ()

    def numbers(self, words: list[bytes]) -> np.ndarray:
        get = self.number.get
        return np.fromiter((get(w, -1) for w in words), np.int64, len(words))

    def runs(self, ids: np.ndarray) -> Iterator[tuple[int, int]]:
        """Stretches in which each word and each pair is some item's; only those that could hold a window."""
        n = len(ids)
        if not n or not len(self.number):
            return
        if self.least < 2:
            inside = np.concatenate([[False], ids >= 0, [False]])
            edge = np.diff(inside.astype(np.int8))
            for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
                yield a, b
            return
        if n < 2 or not len(self.pairs):
            return
        both = (ids[:-1] >= 0) & (ids[1:] >= 0)
        code = ids[:-1] * len(self.number) + ids[1:]
        at = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
        inside = np.concatenate([[False], both & (self.pairs[at] == code), [False]])
        edge = np.diff(inside.astype(np.int8))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + 1
        for i in np.flatnonzero(end - start >= self.least).tolist():
            yield int(start[i]), int(end[i])

    def matches(self, words: list[bytes]) -> Iterator[tuple[int, int, set[int]]]:
        """Occurrences of windows: first word, end, items."""
        ids = self.numbers(words)
        go, link, length, window = self.go, self.link, self.length, self.window
        for a, b in self.runs(ids):
            state = long = 0
            for i, w in enumerate(ids[a:b].tolist(), a):
                while state and w not in go[state]:
                    state = link[state]
                    long = length[state]
                if w in go[state]:
                    state, long = go[state][w], long + 1
                if long >= window:
                    yield i + 1 - window, i + 1, self.items[self.cut[state]]
                for n, item in self.short[state]:
                    if n <= long:
                        yield i + 1 - n, i + 1, {item}


def automata(items: list[tuple[int, str | None]], window: int, block_words: int) -> list[Automaton]:
    sequences = [(i, w) for i, t in items if (w := words_of(t))]
    return [Automaton(sequences[a:b], window) for a, b in slices([len(w) for _, w in sequences], block_words)]


def stored(benchmark: DataFrame, key: str, text: str, window: int, block_words: int) -> list[str]:
    """Places of the automata of all items, block by block; the driver holds the items and the automaton of one block."""
    spark = benchmark.sparkSession
    folder, out, held, words = fresh(spark, "benchmark"), [], [], 0
    files.make_folder(folder)

    def flush() -> None:
        for a in automata(held, window, block_words):
            out.append(f"{folder}/{len(out)}")
            with files.open_write(out[-1]) as f:
                f.write(pickle.dumps(a, 5))
        held.clear()

    for r in benchmark.select(F.col(key).cast("long"), text).toLocalIterator():
        held.append((r[0], r[1]))
        words += len(words_of(r[1]))
        if words >= block_words:
            flush()
            words = 0
    flush()
    return out


_OPEN: list[tuple[str, Automaton]] = []


def opened(place: str) -> Automaton:
    """A stored automaton; a worker keeps the last one."""
    if not _OPEN or _OPEN[0][0] != place:
        _OPEN.clear()
        with files.open_read(place) as f:
            _OPEN.append((place, pickle.loads(f.read())))
    return _OPEN[0][1]


def _hits(places: list[str], texts: list[str | None], most: int = 1 << 22) -> Iterator[tuple[int, np.ndarray, set[int]]]:
    """Of each text: its number of words, which are hit, and the items with occurring windows.

    With several blocks, texts of ``most`` characters together (or one longer text) are held against each block in turn.
    """
    for x, y in slices([len(t or "") for t in texts], most if len(places) > 1 else 1):
        words = [words_of(t) for t in texts[x:y]]
        hit, found = [np.zeros(len(w), bool) for w in words], [set() for _ in words]
        for place in places:
            block = opened(place)
            for i, w in enumerate(words):
                h, f = _scan([block], w)
                if f:
                    hit[i] |= h
                    found[i] |= f
        yield from ((len(w), h, f) for w, h, f in zip(words, hit, found, strict=True))


def _scan(blocks: list[Automaton], words: list[bytes]) -> tuple[np.ndarray, set[int]]:
    """Hit words and items with occurring windows, over all blocks."""
    hit, found = np.zeros(len(words) + 1, np.int32), set()
    for block in blocks:
        for a, b, items in block.matches(words):
            hit[a] += 1
            hit[b] -= 1
            found |= items
    return np.cumsum(hit[:-1]) > 0, found


def report(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", window: int = 10, block_words: int = 2_000_000) -> DataFrame:
    """A row a document: key, n_words, n_hit, n_items, items_sha256, contaminated. No shuffle."""
    spark = docs.sparkSession
    ship(spark)
    places = stored(benchmark, item_key, "text", window, block_words)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_hit, n_items, digest = [], [], [], []
            for n, hit, found in _hits(places, batch.column("text").to_pylist()):
                n_words.append(n)
                n_hit.append(int(hit.sum()))
                n_items.append(len(found))
                digest.append(hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("key"), *(pa.array(c, pa.int64()) for c in (n_words, n_hit, n_items)), pa.array(digest, pa.string()), pa.array([n > 0 for n in n_hit], pa.bool_())], names=["key", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    made = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = made.schema["key"].dataType.simpleString()
    return made.mapInArrow(scan, f"key {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean").withColumnRenamed("key", key)


def _spans(text: str, hit: np.ndarray) -> list[tuple[int, int]]:
    """Byte ranges of the runs of hit words."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass").translate(_TABLE), np.uint8) != 32
    edge = np.diff(np.concatenate([[0], data.astype(np.int8), [0]]))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    turn = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    return [(int(start[a]), int(end[b - 1])) for a, b in zip(np.flatnonzero(turn == 1), np.flatnonzero(turn == -1), strict=True)]


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id", window: int = 10, coverage: float = 0.5, length_column: str | None = "n_chars", block_words: int = 2_000_000) -> DataFrame:
    """The documents without the spans that occur in the benchmark.

    A run of hit words is over the length limit (``window``) and is cut out of the text, with the blanks before it. A
    document of whose words at least the share ``coverage`` is hit goes as a whole. All columns stay; ``length_column``,
    where it exists, is set to the new length in characters of the texts that changed.
    """
    spark = docs.sparkSession
    ship(spark)
    places = stored(benchmark, item_key, "text", window, block_words)
    schema, has_length = docs.schema, bool(length_column) and length_column in docs.columns

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            texts, keep, changed = batch.column(at).to_pylist(), [], {}
            for i, (x, (n_words, hit, _)) in enumerate(zip(texts, _hits(places, texts), strict=True)):
                n = int(hit.sum())
                keep.append(not n or n < coverage * n_words)
                if n and keep[-1]:
                    data, out, done = x.encode("utf-8", "surrogatepass"), [], 0
                    for a, b in _spans(x, hit):
                        out.append(data[done:a].rstrip(b" \t"))
                        done = b
                    changed[i] = (b"".join(out) + data[done:]).decode("utf-8", "surrogatepass")
            if changed:
                columns = list(batch.columns)
                columns[at] = pa.array([changed.get(i, x) for i, x in enumerate(texts)], batch.schema.field(at).type)
                if has_length:
                    j = batch.schema.get_field_index(length_column)
                    old = columns[j].to_pylist()
                    columns[j] = pa.array([len(changed[i]) if i in changed else v for i, v in enumerate(old)], batch.schema.field(j).type)
                batch = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(clean, T.StructType(list(schema)))
