"""SentencePiece N-best segmentation: forward Viterbi scores are exact heuristics of a backward A* over the piece lattice.

Pieces are scored by a Zipf prior of their rank in the model file, -ln(1 + rank), since the file's own scores are ranks.
A text without piece for a character takes the pieces of its bytes.  Where no piece holds two neighbouring characters,
as before a space and between most characters of unspaced scripts, the lattice of a text has a bridge.  It falls apart
there into lattices of words, and the N best of a text are combined from those of the few words with the closest alternatives.
A word without a bridge takes about 200 bytes a character.
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Distinct words that a worker remembers, and characters of new words that are searched at once.
CACHE_WORDS, CHUNK_CHARS = 100_000, 50_000
SPACE = "▁"
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


class Pieces:
    """The vocabulary of a model file: pieces by the hash of their characters."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.byte_ids, normal = np.zeros(256, np.int32), []
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                normal.append((i, piece))
        self.bytes_of = [b""] * sp.get_piece_size()
        for b, i in enumerate(self.byte_ids):
            self.bytes_of[i] = bytes([b])
        self.longest = max(len(p) for _, p in normal)
        self.by_length: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        rank = {i: r for r, (i, _) in enumerate(normal)}
        for length in range(1, self.longest + 1):
            own = [(i, p) for i, p in normal if len(p) == length]
            keys = np.zeros(len(own), np.uint64)
            codes = np.frombuffer("".join(p for _, p in own).encode("utf-32-le"), np.uint32).reshape(len(own), length).astype(np.uint64)
            for k in range(length):
                keys = keys * _BASE + codes[:, k] + np.uint64(1)
            order = np.argsort(keys)
            ids = np.array([i for i, _ in own], np.int32)[order]
            self.by_length.append((keys[order], ids, -np.log1p([float(rank[i]) for i in ids.tolist()])))
        self.unknown = -np.log1p(float(len(normal))) - 10.0  # a byte piece is worse than any other
        self.goes_on = np.zeros((128, 128), bool)
        for i, piece in normal:
            self.bytes_of[i] = piece.replace(SPACE, " ").encode()
            raw = self.bytes_of[i]
            for a, b in zip(raw[:-1], raw[1:], strict=True):
                if a < 128 and b < 128:
                    self.goes_on[a, b] = True
        # pairs of characters inside pieces: between any other two no piece goes on, so the lattice has a bridge there
        pairs = {ord(a) << 21 | ord(b) for _, piece in normal for a, b in zip(piece.replace(SPACE, " "), piece.replace(SPACE, " ")[1:], strict=False)}
        self.pairs = np.array(sorted(pairs), np.int64)
        self.score_of = np.full(sp.get_piece_size(), self.unknown)
        for _, ids, scores in self.by_length:
            self.score_of[ids] = scores


@functools.lru_cache(maxsize=2)
def _pieces(model: bytes) -> Pieces:
    return Pieces(model)


class Lattice:
    """The piece lattices of several words, one after the other: node k + w is before character k of word w."""

    def __init__(self, pieces: Pieces, words: list[str]) -> None:
        self.pieces, self.words = pieces, words
        lengths = np.array([len(w) for w in words], np.int64)
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        codes = np.where(codes == 32, ord(SPACE), codes).astype(np.uint64)
        n, self.first = len(codes), np.cumsum(lengths + 1) - lengths - 1
        word = np.repeat(np.arange(len(words)), lengths)
        node = np.arange(n) + word  # of each character's left side
        left = np.cumsum(lengths)[word] - np.arange(n)  # characters from here to the end of the word
        self.lengths, self.nodes = lengths, n + len(words)
        longest = min(pieces.longest, int(lengths.max(initial=1)))
        self.score = np.full((longest, self.nodes), -np.inf)
        self.id = np.full((longest, self.nodes), -1, np.int32)
        hashes = np.zeros(n, np.uint64)
        for k in range(longest):
            fits = np.flatnonzero(left > k)
            if not len(fits):
                break
            hashes[fits] = hashes[fits] * _BASE + codes[fits + k] + np.uint64(1)
            keys, ids, scores = pieces.by_length[k]
            if not len(keys):
                continue
            place = np.minimum(np.searchsorted(keys, hashes[fits]), len(keys) - 1)
            hit = keys[place] == hashes[fits]
            self.score[k, node[fits[hit]]] = scores[place[hit]]
            self.id[k, node[fits[hit]]] = ids[place[hit]]
        lone = np.flatnonzero(self.id[0, node] < 0)  # no piece for the character: its bytes
        width = 1 + (codes[lone] > 0x7F) + (codes[lone] > 0x7FF) + (codes[lone] > 0xFFFF)
        self.score[0, node[lone]] = pieces.unknown * width

    def forward(self) -> None:
        """Best scores from the start of the word to each node (alpha) and from it to the end (beta)."""
        self.alpha, self.beta = np.full(self.nodes, -np.inf), np.full(self.nodes, -np.inf)
        self.back = np.zeros(self.nodes, np.int16)
        last = self.first + self.lengths
        self.alpha[self.first], self.beta[last] = 0.0, 0.0
        by_length = np.argsort(-self.lengths, kind="stable")
        sizes = self.lengths[by_length]
        longest = len(self.score)
        for t in range(1, int(self.lengths.max(initial=0)) + 1):
            live = by_length[: np.searchsorted(-sizes, -t, "right")]
            end, begin = self.first[live] + t, last[live] - t
            best, backward = np.full(len(live), -np.inf), np.full(len(live), -np.inf)
            chosen = np.zeros(len(live), np.int16)
            for k in range(min(t, longest)):
                total = self.alpha[end - k - 1] + self.score[k, end - k - 1]
                better = total > best
                best[better], chosen[better] = total[better], k + 1
                np.maximum(backward, self.score[k, begin] + self.beta[begin + k + 1], out=backward)
            self.alpha[end], self.back[end], self.beta[begin] = best, chosen, backward
        self.best = self.alpha[last]

    def best_paths(self) -> tuple[list[np.ndarray], np.ndarray]:
        """Piece ids of the best path of each word, and by how much the best other path is worse."""
        on_path = np.zeros_like(self.score, bool)
        at = self.first + self.lengths
        ends = []
        live = np.flatnonzero(self.lengths)
        where = at.copy()
        while len(live):
            step = self.back[where[live]].astype(np.int64)
            where[live] -= step
            on_path[step - 1, where[live]] = True
            ends.append((live, where[live], step))
            live = live[where[live] > self.first[live]]
        other = np.full(self.nodes, -np.inf)
        for k in range(len(self.score)):
            total = self.alpha[: self.nodes - k - 1] + self.score[k, : self.nodes - k - 1] + self.beta[k + 1 :]
            total[on_path[k, : self.nodes - k - 1]] = -np.inf
            np.maximum(other[: self.nodes - k - 1], total, out=other[: self.nodes - k - 1])
        second = np.maximum.reduceat(other, self.first) if len(self.first) else np.zeros(0)
        words = np.concatenate([w for w, _, _ in ends]) if ends else np.zeros(0, np.int64)
        nodes = np.concatenate([w for _, w, _ in ends]) if ends else np.zeros(0, np.int64)
        steps = np.concatenate([s for _, _, s in ends]) if ends else np.zeros(0, np.int64)
        order = np.lexsort((nodes, words))
        words, nodes, steps = words[order], nodes[order], steps[order]
        ids = self.id[steps - 1, nodes]
        cuts = np.searchsorted(words, np.arange(len(self.words) + 1))
        odd = set(words[ids < 0].tolist())
        paths = [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        for w in odd:
            a, b = cuts[w], cuts[w + 1]
            paths[w] = self._ids(w, list(zip(nodes[a:b].tolist(), steps[a:b].tolist(), strict=True)))
        return paths, self.best - second

    def _ids(self, word: int, edges: list[tuple[int, int]]) -> np.ndarray:
        out: list[int] = []
        for node, step in edges:
            if (i := int(self.id[step - 1, node])) >= 0:
                out.append(i)
            else:
                out += self.pieces.byte_ids[np.frombuffer(self.words[word][node - self.first[word]].encode(), np.uint8)].tolist()
        return np.array(out, np.int32)

    def n_best(self, word: int, n: int) -> list[tuple[float, np.ndarray]]:
        """The n best paths of a word, by A* from its end: what is left to the start is known exactly."""
        start, found = int(self.first[word]), []
        end = start + int(self.lengths[word])
        agenda: list[tuple[float, int, int, float, tuple | None]] = [(-self.alpha[end], 0, end, 0.0, None)]
        count = 0
        while agenda and len(found) < n:
            _, _, node, done, path = heapq.heappop(agenda)
            if node == start:
                edges = []
                while path:
                    edges.append(path[:2])
                    path = path[2]
                found.append((done, self._ids(word, edges)))
                continue
            for k in range(1, min(len(self.score), node - start) + 1):
                s = self.score[k - 1, node - k]
                if s > -np.inf and self.alpha[node - k] > -np.inf:
                    count += 1
                    heapq.heappush(agenda, (-(self.alpha[node - k] + s + done), count, node - k, done + s, (node - k, k, path)))
        return found


def combine(lists: list[list[float]], n: int) -> list[tuple[float, tuple[int, ...]]]:
    """The n smallest sums of one loss from each ascending list, with the places taken; each list begins with 0."""
    start = (0,) * len(lists)
    agenda, seen, found = [(0.0, start)], {start}, []
    while agenda and len(found) < n:
        total, places = heapq.heappop(agenda)
        found.append((total, places))
        for i, p in enumerate(places):
            if p + 1 < len(lists[i]):
                nxt = (*places[:i], p + 1, *places[i + 1 :])
                if nxt not in seen:
                    seen.add(nxt)
                    heapq.heappush(agenda, (sum(lists[j][q] for j, q in enumerate(nxt)), nxt))
    return found


class Segmenter:
    """N-best segmentation of texts with a memory of words."""

    def __init__(self, model: bytes, n: int) -> None:
        self.pieces, self.n = _pieces(model), n
        self.cache: dict[bytes, tuple[np.ndarray, float, float]] = {}
        self.lists: dict[bytes, list[tuple[float, np.ndarray]]] = {}

    def _learn(self, words: list[bytes]) -> None:
        at = 0
        while at < len(words):
            size, to = 0, at
            while to < len(words) and (to == at or size < CHUNK_CHARS):
                size += len(words[to])
                to += 1
            lattice = Lattice(self.pieces, [w.decode("utf-8") for w in words[at:to]])
            lattice.forward()
            paths, losses = lattice.best_paths()
            for w, path, score, loss in zip(words[at:to], paths, lattice.best.tolist(), losses.tolist(), strict=True):
                self.cache[w] = path, score, loss
            at = to

    def _learn_lists(self, words: list[bytes]) -> None:
        """The N best of words, whose lattices are built together."""
        for at in range(0, len(words), 500):
            part = words[at : at + 500]
            lattice = Lattice(self.pieces, [w.decode("utf-8") for w in part])
            lattice.forward()
            for i, w in enumerate(part):
                self.lists[w] = lattice.n_best(i, self.n)

    def segment(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, float, list[tuple[float, int, list[tuple[int, int, list[int]]]]]]]:
        """For each text its best ids, their score, and the next best: loss, tokens, and (token, tokens dropped, ids put there)."""
        whole = b"".join(b" " + t.replace(SPACE.encode(), b" ") if t else b"" for t in texts)
        offsets = np.cumsum([0, *(len(t.replace(SPACE.encode(), b" ")) + 1 if t else 0 for t in texts)])
        data = np.frombuffer(whole, np.uint8)
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        if len(data) > 1:
            a, b = data[:-1], data[1:]
            low = (a < 128) & (b < 128)
            edge[1:-1] |= ((b == 32) & (a != 32)) | (low & ~self.pieces.goes_on[a & 127, b & 127])
            heads = np.flatnonzero((data & 0xC0) != 0x80)
            if len(heads) < len(data):
                chars = np.frombuffer(whole.decode("utf-8").encode("utf-32-le"), np.uint32).astype(np.int64)
                wide = np.flatnonzero((chars[:-1] > 127) | (chars[1:] > 127))
                keys = chars[wide] << 21 | chars[wide + 1]
                place = np.minimum(np.searchsorted(self.pieces.pairs, keys), len(self.pieces.pairs) - 1)
                edge[heads[wide[self.pieces.pairs[place] != keys] + 1]] = True
        starts = np.flatnonzero(edge[: len(data)])
        ends = np.append(starts[1:], len(data))
        codes, _ = pd.factorize(common.span_hashes(data, starts, ends))
        first = np.full(codes.max(initial=-1) + 1, -1)
        first[codes[::-1]] = np.arange(len(codes))[::-1]
        words = [whole[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        if len(self.lists) > CACHE_WORDS:
            self.lists.clear()
        self._learn([w for w in words if w not in self.cache])
        known = [self.cache[w] for w in words]
        lengths = np.fromiter((len(k[0]) for k in known), np.int64, len(known))
        scores, losses = np.array([k[1] for k in known]), np.array([k[2] for k in known])
        flat = np.concatenate([*(k[0] for k in known), np.zeros(0, np.int32)])
        heads = np.cumsum(lengths) - lengths
        each = lengths[codes]
        before = np.append(0, np.cumsum(each))
        ids = flat[np.repeat(heads[codes] - before[:-1], each) + np.arange(before[-1])].astype(np.int32)
        cuts = np.searchsorted(starts, offsets)
        word_scores, word_losses = scores[codes], losses[codes]
        near = [self._closest(word_losses[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        wanted = {words[codes[a + i]] for a, own in zip(cuts[:-1].tolist(), near, strict=True) for i in own.tolist()}
        self._learn_lists(sorted(w for w in wanted if w not in self.lists))
        for a, b, own in zip(cuts[:-1].tolist(), cuts[1:].tolist(), near, strict=True):
            base = before[a]
            found = []
            lists = [self.lists[words[codes[a + i]]] for i in own]
            sums = combine([[max(0.0, x[0][0] - s) for s, _ in x] for x in lists], self.n)
            for loss, places in sums[1:]:
                swaps = [(int(before[a + i] - base), int(each[a + i]), lists[j][p][1].tolist()) for j, (i, p) in enumerate(zip(own, places, strict=True)) if p]
                found.append((float(loss), int(before[b] - base) + sum(len(s[2]) - s[1] for s in swaps), swaps))
            yield ids[base : before[b]], float(word_scores[a:b].sum()), found

    def _closest(self, losses: np.ndarray) -> np.ndarray:
        """The words that can change in the N best of a text: the n - 1 with the least losses."""
        if self.n < 2:
            return np.zeros(0, np.int64)
        near = np.arange(len(losses)) if len(losses) < self.n else np.argpartition(losses, self.n - 2)[: self.n - 1]
        return np.sort(near[np.isfinite(losses[near])])


def apply_swaps(ids: list[int], swaps: list) -> list[int]:
    """The ids of an alternative: each swap puts ids in the place of `drop` tokens at `token` of the best."""
    out, at = [], 0
    for s in swaps:
        out += [*ids[at : s["token"]], *s["ids"]]
        at = s["token"] + s["drop"]
    return [*out, *ids[at:]]


def decode(pieces: Pieces, ids: np.ndarray) -> bytes:
    """The text of ids, without the space that encoding puts before it."""
    of = pieces.bytes_of
    return b"".join([of[i] for i in ids.tolist()]).removeprefix(b" ")


_ALTERNATIVE = pa.struct([("score", pa.float64()), ("n_tokens", pa.int32()), ("swaps", pa.list_(pa.struct([("token", pa.int32()), ("drop", pa.int32()), ("ids", pa.list_(pa.int32()))])))])
_OUT = [("n_tokens", pa.int32()), ("score", pa.float64()), ("ids", pa.list_(pa.int32())), ("alternatives", pa.list_(_ALTERNATIVE)), ("round_trip", pa.bool_())]
_TYPES = "n_tokens int, score double, ids array<int>, alternatives array<struct<score: double, n_tokens: int, swaps: array<struct<token: int, drop: int, ids: array<int>>>>>, round_trip boolean"


def _segmenter(model, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = Segmenter(model.value, n)
        for batch in batches:
            for part, data, offsets in common.slices(batch):
                whole = data.tobytes()
                texts = [whole[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                rows, all_ids = [], []
                for text, (ids, score, others) in zip(texts, worker.segment(texts), strict=True):
                    rows.append((len(ids), score, [{"score": score - loss, "n_tokens": k, "swaps": [{"token": t, "drop": d, "ids": i} for t, d, i in swaps]} for loss, k, swaps in others], decode(worker.pieces, ids) == text))
                    all_ids.append(ids)
                n_tokens, scores, others, exact = zip(*rows, strict=True)
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *n_tokens]), pa.int32()), pa.array(np.concatenate([*all_ids, np.zeros(0, np.int32)])))
                columns = [part.column("doc_id"), pa.array(n_tokens, pa.int32()), pa.array(scores), lists, pa.array(others, pa.list_(_ALTERNATIVE)), pa.array(exact)]
                yield pa.RecordBatch.from_arrays(columns, schema=pa.schema([("doc_id", pa.int64()), *_OUT]))

    return run


def n_best(docs: DataFrame, model_path: str, n: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the best segmentation (ids, n_tokens, score), the next n - 1 as swaps against it, and whether decoding gives the text.

    A null or empty text has no tokens; a text with U+2581 decodes with spaces there (round_trip is false); ties keep a
    fixed order; each repeated row has its own result; a null id stays null; an empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    with open(model_path, "rb") as f:
        model = spark.sparkContext.broadcast(f.read())
    two = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return two.mapInArrow(_segmenter(model, n), f"doc_id long, {_TYPES}")


def _decoder(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(model.value)
        for batch in batches:
            lists = batch.column("ids")
            texts = [decode(pieces, np.array(ids.as_py() or [], np.int64)).decode("utf-8", "replace") for ids in lists]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return run


def decoded(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id and the text of its ids; byte pieces that are no UTF-8 become U+FFFD.

    Null or no ids give an empty text, each repeated row its own; null doc_ids stay; an empty table gives no rows; other columns are not read.
    """
    common.small_batches(encoded.sparkSession)
    with open(model_path, "rb") as f:
        model = encoded.sparkSession.sparkContext.broadcast(f.read())
    return encoded.select("doc_id", F.col("ids")).mapInArrow(_decoder(model), "doc_id long, text string")
