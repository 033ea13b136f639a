"""Token counts under a unigram model, by dynamic programming on a trie.

Distinct pre-tokens enter a trie, character by character. Each node holds the best score of its prefix and the number
of pieces that give it, computed once from the nodes above it, whatever number of pre-tokens share the prefix; the node
where a pre-token ends holds its occurrences. The pieces are those of a public vocabulary; their log-probabilities
follow the ranks there by the Zipf-Mandelbrot law, a fixed rule, so that nothing is trained. A character that is no
piece costs one byte piece for each of its bytes. Of equally good cuts the one with the longest last piece is taken.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from flowgauge.llm.common import texts

VOCABULARY = "piece_bpe_32k.model"
MARK = "▁"
#: The law's shift and exponent.
SHIFT, EXPONENT = 2.7, 1.0
#: Nodes of a worker's trie before it is begun anew. Pre-tokens over DEEP characters are solved outside it.
NODES, DEEP = 1_500_000, 48


class Unigram:
    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        law = [-EXPONENT * math.log(rank + SHIFT) for rank in range(size)]
        total = math.log(sum(map(math.exp, law)))
        whole, self.byte = {}, [0.0] * 256
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte[int(piece[3:5], 16)] = law[i] - total
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                whole[piece] = law[i] - total
        self.pieces, self.longest = whole, max(map(len, whole))
        self.finder = ahocorasick.Automaton()
        for piece, score in whole.items():
            self.finder.add_word(piece, (score, len(piece)))
        self.finder.make_automaton()

    def fallback(self, char: str) -> tuple[float, int]:
        data = char.encode("utf-8", "surrogatepass")
        return sum(self.byte[b] for b in data), len(data)

    def step(self, text: str, end: int, best: list[float], count: list[int]) -> tuple[float, int]:
        """Score and number of pieces of text[:end], from those of shorter prefixes; of equal scores the longest last piece."""
        top, number = -math.inf, 0
        for start in range(max(0, end - self.longest), end):
            score = self.pieces.get(text[start:end])
            if score is not None and best[start] + score > top:
                top, number = best[start] + score, count[start] + 1
        if text[end - 1] not in self.pieces:
            score, size = self.fallback(text[end - 1])
            if best[end - 1] + score > top:
                top, number = best[end - 1] + score, count[end - 1] + size
        return top, number

    def forward(self, text: str) -> tuple[float, int]:
        """Best score of a whole text, and its number of pieces."""
        best, count = [0.0], [0]
        for end in range(1, len(text) + 1):
            score, number = self.step(text, end, best, count)
            best.append(score)
            count.append(number)
        return best[-1], count[-1]


class Trie:
    """Nodes are numbered: next holds the node below one by a character. best, pieces and times hold each node's score,
    its number of pieces and, where a pre-token ends, how often it occurred; ends holds the nodes of whole pre-tokens (without mark)."""

    def __init__(self, model: Unigram) -> None:
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.next: dict[int, int] = {}
        self.best, self.pieces, self.times = [0.0], [0], [0]
        self.ends: dict[str, int] = {}

    @property
    def nodes(self) -> int:
        return len(self.best)

    def insert(self, token: str) -> int:
        """The node where token ends; only the part of it that no other pre-token has brought in is computed."""
        after, at, known, path = self.next, 0, 0, [0]
        for char in token:
            if (below := after.get(at << 21 | ord(char))) is None:
                break
            at = below
            path.append(at)
            known += 1
        if known < len(token):
            best, pieces, model = self.best, self.pieces, self.model
            top: list = [None] * (len(token) + 1)
            for last, (score, size) in model.finder.iter(token):
                if (end := last + 1) > known:
                    top_ = top[end]
                    if top_ is None:
                        # all shorter prefixes are settled before the first piece that ends here is looked at
                        while len(path) < end:
                            self._settle(token, path, top)
                        top_ = top[end] = [-math.inf, 0]
                    if best[path[end - size]] + score > top_[0]:
                        top_[0], top_[1] = best[path[end - size]] + score, pieces[path[end - size]] + 1
            while len(path) <= len(token):
                self._settle(token, path, top)
            at = path[-1]
        return at

    def _settle(self, token: str, path: list[int], top: list) -> None:
        """Makes the node of the next longer prefix from its best last piece, or the bytes of a character that is no piece."""
        end = len(path)
        score, number = top[end] or (-math.inf, 0)
        if token[end - 1] not in self.model.pieces:
            cost, size = self.model.fallback(token[end - 1])
            if self.best[path[-1]] + cost > score:
                score, number = self.best[path[-1]] + cost, self.pieces[path[-1]] + size
        below = self.next[path[-1] << 21 | ord(token[end - 1])] = len(self.best)
        self.best.append(score)
        self.pieces.append(number)
        self.times.append(0)
        path.append(below)

    def count(self, words: dict[str, int]) -> tuple[int, float]:
        """Counts a document's pre-tokens at the nodes where they end; the number of pieces of them all, and their
        log-probability, summed over these terminal counts. times keeps the counts of all documents."""
        if self.nodes > NODES:
            self.clear()
        ends, own, outside = self.ends, {}, []
        for word, n in words.items():
            node = ends.get(word)
            if node is None:
                if len(word) > DEEP:
                    outside.append((n, *self.model.forward(MARK + word)))
                    continue
                node = ends[word] = self.insert(MARK + word)
            own[node] = n
        times, best, pieces, total, log_prob = self.times, self.best, self.pieces, 0, 0.0
        for node, n in own.items():
            times[node] += n
            total += n * pieces[node]
            log_prob += n * best[node]
        for n, score, number in outside:
            total += n * number
            log_prob += n * score
        return total, log_prob


_loaded: dict[str, Trie] = {}


def load(path: str) -> Trie:
    if path not in _loaded:
        _loaded[path] = Trie(Unigram(path))
    return _loaded[path]


def count(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_pretokens, n_distinct, n_tokens, log_prob (rounded to 4 places) of each row of docs (doc_id, text), whole texts.

    Pre-tokens are what white space separates, each with the vocabulary's mark of a word's beginning. A null or empty
    text has none, and log_prob 0; null ids and repeated rows are kept; no rows: no rows. Other columns are ignored.
    """
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = load(path)
        for b in batches:
            out: list[tuple] = []
            for text in b.column("text"):
                words = Counter(text.as_py().split())  # in order of first occurrence, so that sums are the same anywhere
                tokens, log_prob = trie.count(words)
                out.append((words.total(), len(words), tokens, round(log_prob, 4)))
            cols = list(zip(*out)) if out else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.float64())], ["doc_id", "n_pretokens", "n_distinct", "n_tokens", "log_prob"])

    return texts(docs).mapInArrow(run, "doc_id long, n_pretokens long, n_distinct long, n_tokens long, log_prob double")
