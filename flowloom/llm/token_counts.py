"""Operator 9: word-piece counts by a linear longest-match automaton.

The vocabulary is a trie whose nodes have a failure link and the number of pieces that taking the
link completes. A word is read once, from left to right: where no edge continues, the automaton
adds the node's precomputed count and takes its link. The greedy longest-match-first segmentation
is counted this way without building a piece, in time linear in the word.

A word is a run of anything but ASCII white space. Pieces that begin a word and pieces that
continue one are two sets; a word that cannot be segmented counts as one unknown piece. Any
SentencePiece model gives both sets: pieces that begin with U+2581, and the others. The automaton
reads a word of any length to its end. A WordPiece model may take words of more than some code
points for unknown without reading them; ``max_word`` is there to compare with one, and is not set.

Defined results: null and empty texts have no words and no pieces; repeated rows and null ids stay.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame

from .common import map_text

#: Words kept with their counts, and the bytes of the longest kept; longer ones are counted each time.
MAX_KEPT, KEPT_BYTES = 300_000, 400


def vocabulary(path: str | None = None) -> tuple[list[str], list[str]]:
    """Pieces that begin a word and pieces that continue one."""
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
    own = [sp.id_to_piece(i) for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    return [p[1:] for p in own if p[0] == "▁" and "▁" not in p[1:] and len(p) > 1], [p for p in own if "▁" not in p]


class Automaton:
    """Node 0 is where no word was begun, node 1 where a piece has ended and the word may go on."""

    def __init__(self, begin: list[str], inside: list[str]):
        self.edge: list[dict[str, int]] = [{}, {}]
        self.link: list[int] = [-1, -1]
        self.pops: list[int] = [0, 0]
        final = [False, False]
        for root, pieces in ((0, begin), (1, inside)):
            for p in pieces:
                node = root
                for c in p:
                    nxt = self.edge[node].get(c)
                    if nxt is None:
                        nxt = self.edge[node][c] = len(self.edge)
                        self.edge.append({})
                        self.link.append(-1)
                        self.pops.append(0)
                        final.append(False)
                    node = nxt
                final[node] = True
        level = [0, 1]
        while level:
            below = []
            for parent in level:
                for c, v in self.edge[parent].items():
                    below.append(v)
                    if final[v]:
                        self.link[v], self.pops[v] = 1, 1
                        continue
                    node, n = self.link[parent], self.pops[parent]
                    while node != -1 and c not in self.edge[node]:
                        n += self.pops[node]
                        node = self.link[node]
                    if node != -1:
                        self.link[v], self.pops[v] = self.edge[node][c], n
            level = below

    def count(self, word: str) -> int:
        """Pieces of the word; -1 if it cannot be segmented."""
        node = total = 0
        for c in word:
            while (nxt := self.edge[node].get(c)) is None:
                if self.link[node] == -1:
                    return -1
                total += self.pops[node]
                node = self.link[node]
            node = nxt
        while node != 1:  # what is read but not yet completed
            if self.link[node] == -1:
                return -1
            total += self.pops[node]
            node = self.link[node]
        return total


class _Counts(dict):
    def __init__(self, automaton: Automaton, max_word: int | None):
        super().__init__()
        self.automaton, self.max_word = automaton, max_word

    def __missing__(self, word: bytes) -> int:
        w = word.decode("utf-8", "surrogatepass")
        n = -1 if self.max_word is not None and len(w) > self.max_word else self.automaton.count(w)
        if len(word) > KEPT_BYTES:
            return n
        if len(self) >= MAX_KEPT:
            self.clear()
        self[word] = n
        return n


@lru_cache(2)
def _automaton(begin: tuple[str, ...], inside: tuple[str, ...]) -> Automaton:
    return Automaton(list(begin), list(inside))


def token_counts(docs: DataFrame, vocab: tuple[list[str], list[str]] | None = None, id_col: str = "doc_id", text_col: str = "text", max_word: int | None = None) -> DataFrame:
    """``id, n_words, n_tokens, n_unknown`` of every row; an unknown word is one token.

    Words of more than ``max_word`` code points are unknown; with None every word is read.
    """
    begin, inside = map(tuple, vocab or vocabulary())

    def make():
        counts = _Counts(_automaton(begin, inside), max_word)

        def kernel(texts):
            out = {"n_words": [], "n_tokens": [], "n_unknown": []}
            for t in texts:
                got = list(map(counts.__getitem__, t.encode("utf-8", "surrogatepass").split()))
                unknown = got.count(-1)
                out["n_words"].append(len(got))
                out["n_tokens"].append(sum(got) + 2 * unknown)
                out["n_unknown"].append(unknown)
            return out

        return kernel

    return map_text(docs, make, "n_words long, n_tokens long, n_unknown long", id_col, text_col)
