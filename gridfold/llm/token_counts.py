"""Exact token counts at every prefix, by dynamic programming over BPE pieces.

The encoding of a prefix ends in the one piece that fits the encoding of what
stands before it (see :mod:`gridfold.llm.bpe` on adjacent pairs), so the last
piece and the count at each prefix follow from those of shorter prefixes.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import lru_cache
from itertools import accumulate

from pyspark.sql import DataFrame

from gridfold.llm.bpe import Merges
from gridfold.llm.common import Memo, map_columns, text_or_empty, tokenizer_path

WORDS, PAIRS = 400_000, 400_000
SPACE = "▁"  # how the vocabulary writes a space


class PrefixCounter:
    """Counts for a sentencepiece BPE model with byte fallback."""

    def __init__(self, path: str, words: int = WORDS, pairs: int = PAIRS):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(sp.get_piece_size())
               if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.ranks = {sp.id_to_piece(i): -sp.get_score(i) for i in ids}
        if any(not re.fullmatch(f"{SPACE}*[^{SPACE}\n]*", p) for p in self.ranks):
            raise ValueError("a piece goes on past a space or holds a line break: words can't be counted apart")
        merges = Merges(self.ranks)
        self.trie = ahocorasick.Automaton()
        for piece in merges.left:  # those that the merges can reach
            self.trie.add_word(piece, piece)
        self.trie.make_automaton()
        self.fits = Memo(lambda ab: merges.fits(*ab), pairs)
        self.word = Memo(self.prefix_counts, words)
        self.total = Memo(lambda w: self.prefix_counts(w)[-1], words)

    def prefix_counts(self, word: str) -> list[int]:
        """Tokens of every prefix of a word (spaces written as in the vocabulary)."""
        counts, last, fits, done = [0] * (len(word) + 1), [""] * (len(word) + 1), self.fits, 0
        for at, piece in self.trie.iter(word):
            end, start = at + 1, at + 1 - len(piece)
            if end == done:
                continue
            if start > done:  # what no piece ends at is unknown
                self._bytes(word, done, start, counts, last)
            if not last[start] or fits[last[start], piece]:
                counts[end], last[end], done = counts[start] + 1, piece, end
        self._bytes(word, done, len(word), counts, last)
        return counts

    @staticmethod
    def _bytes(word: str, start: int, end: int, counts: list[int], last: list[str]) -> None:
        """Characters outside the vocabulary: one token for each UTF-8 byte."""
        for k in range(start, end):
            counts[k + 1], last[k + 1] = counts[k] + len(word[k].encode()), ""

    def words(self, text: str) -> list[str]:
        """The text cut where no piece can go across: before each run of spaces,
        and around each line break. Joined, with spaces as in the vocabulary,
        they are the text with the one space that the library puts first."""
        if not text:
            return []
        out: list[str] = []
        for n, line in enumerate((SPACE + text.replace(" ", SPACE)).split("\n")):
            if n:
                out.append("\n")
            if SPACE + SPACE in line:
                out += re.findall(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+", line)
            else:
                first, *rest = line.split(SPACE)
                if first:
                    out.append(first)
                out += [SPACE + w for w in rest]
        return out

    def count(self, text: str) -> int:
        return sum(map(self.total.__getitem__, self.words(text)))

    def count_at(self, text: str, chars: int) -> int:
        """Tokens of the first ``chars`` code points, without encoding them anew."""
        return PrefixTable(self, text).count(chars)


class PrefixTable:
    """Counts at every prefix of one text: answers budget questions."""

    def __init__(self, counter: PrefixCounter, text: str):
        self.counter, self.parts, self.n_chars = counter, counter.words(text), len(text)
        # code points and tokens before each part; the library's first space is no code point of the text
        self.chars = list(accumulate(map(len, self.parts), initial=-1 if self.parts else 0))
        self.tokens = list(accumulate(map(counter.total.__getitem__, self.parts), initial=0))

    def count(self, chars: int) -> int:
        if chars <= 0 or not self.parts:
            return 0
        chars = min(chars, self.n_chars)
        k = min(bisect_right(self.chars, chars) - 1, len(self.parts) - 1)
        return self.tokens[k] + self.counter.word[self.parts[k]][chars - self.chars[k]]

    def fit(self, budget: int) -> int:
        """Code points of the longest prefix of at most ``budget`` tokens. What
        comes after a whole part has more tokens than it, so the part where the
        budget runs out holds the answer."""
        k = bisect_right(self.tokens, budget) - 1
        if k >= len(self.parts):
            return self.n_chars
        inside = self.counter.word[self.parts[k]]
        best = max(i for i, c in enumerate(inside) if self.tokens[k] + c <= budget)
        return max(0, self.chars[k] + best)


@lru_cache(maxsize=2)
def prefix_counter(path: str, words: int = WORDS) -> PrefixCounter:
    return PrefixCounter(path, words)


def count_tokens(docs: DataFrame, limit: int = 4096, path: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, fit_chars per row of ``docs``.

    ``fit_chars`` is the code points of the longest prefix of at most ``limit``
    tokens, the whole text where it fits. A null or empty text has no bytes
    and no tokens. Repeated rows and null doc_ids are kept as they are; other
    columns are ignored; an empty table gives an empty result.
    """
    path = path or tokenizer_path("piece_bpe_32k.model")

    def make():
        counter = prefix_counter(path)

        def work(doc_ids, texts):
            n = [counter.count(t) for t in texts]
            return {
                "doc_id": doc_ids, "n_bytes": [len(t.encode()) for t in texts], "n_tokens": n,
                "over_limit": [x > limit for x in n],
                "fit_chars": [PrefixTable(counter, t).fit(limit) if x > limit else len(t) for t, x in zip(texts, n)],
            }

        return work

    return map_columns(text_or_empty(docs, "doc_id"),
                       "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long", make)
