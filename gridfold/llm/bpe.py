"""Byte-level BPE by longest match and backtracking, and its decoder.

A token sequence is the BPE encoding of its bytes exactly when every adjacent
pair of tokens is the encoding of its own bytes. So an encoder may take the
longest token at each place, fall back to shorter ones while the pair with the
token before does not fit, and step back when none fits: each place is given
up at most once, which keeps it linear in the text.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

from pyspark.sql import DataFrame

from gridfold.llm.common import Memo, map_columns, text_or_empty, tokenizer_path

#: Entries that a worker keeps: encoded words, and judged token pairs.
WORDS, PAIRS = 400_000, 400_000


def merge_units(units: list, ranks: dict) -> list:
    """BPE by definition: join the adjacent pair whose union has the lowest
    rank, the leftmost first, until no union has a rank. For short inputs."""
    parts = list(units)
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            r = ranks.get(parts[i] + parts[i + 1])
            if r is not None and (best is None or r < best):
                best, at = r, i
        if best is None:
            break
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Merges:
    """How the merges build each token of a vocabulary (bytes or str -> rank).

    ``left[t]`` and ``right[t]`` are the symbols that stand at t's left and right
    edge while it is built, each with the rank of the merge that ends it, from
    single units up to t itself, which nothing ends.
    """

    def __init__(self, ranks: dict):
        self.ranks = ranks
        never = max(ranks.values(), default=0) + 1
        self.left: dict = {}
        self.right: dict = {}
        for token in sorted(ranks, key=len):  # parts come before what they build
            parts = [token[k:k + 1] for k in range(len(token))]
            if len(parts) > 1:
                parts = merge_units(parts, _Without(ranks, token))
                if len(parts) != 2:
                    continue  # the merges never reach this token
                a, b = parts
                self.left[token] = [*self.left[a][:-1], (a, ranks[token]), (token, never)]
                self.right[token] = [*self.right[b][:-1], (b, ranks[token]), (token, never)]
            else:
                self.left[token] = self.right[token] = [(token, never)]

    def fits(self, a, b) -> bool:
        """Whether no merge crosses the border of adjacent tokens a and b: at
        each moment the symbols at the border must be taken by their own token
        before their union would be made (of equal ranks the left comes first)."""
        xs, ys, i, j = self.right[a], self.left[b], 0, 0
        while True:
            (x, x_ends), (y, y_ends) = xs[i], ys[j]
            union = self.ranks.get(x + y)
            if union is not None and union < x_ends and union <= y_ends:
                return False
            if i + 1 == len(xs) and j + 1 == len(ys):
                return True
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1


class _Without:
    """Ranks without one token: its merges then stop at its last two parts."""

    def __init__(self, ranks: dict, token):
        self.ranks, self.token = ranks, token

    def get(self, key):
        return None if key == self.token else self.ranks.get(key)


class ByteBpe:
    """Encoder and decoder for a rank file of byte tokens."""

    def __init__(self, path: str, pattern: str, words: int = WORDS, pairs: int = PAIRS):
        import ahocorasick
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.bytes = {i: t for t, i in self.ranks.items()}
        self.by_text = {str(i): t for t, i in self.ranks.items()}
        self.findall = regex.compile(pattern).findall
        self.spaced = regex.compile(r" \s").search
        self.at_spaces = regex.compile(r" (?=\S)").split
        self.merges = Merges(self.ranks)
        # tokens that the merges can reach; others are only ever whole pieces
        self.trie = ahocorasick.Automaton()
        for token in self.merges.left:
            self.trie.add_word(token.decode("latin-1"), (self.ranks[token], len(token)))
        self.trie.make_automaton()
        self.size = {i: len(t) for i, t in self.bytes.items()}
        self.fits = Memo(lambda ab: self.merges.fits(self.bytes[ab[0]], self.bytes[ab[1]]), pairs)
        self.shorter = Memo(self._shorter, len(self.ranks))
        self.word = Memo(self._word, words)

    def _shorter(self, token: int) -> int | None:
        """The longest reachable token that is a proper prefix of this one."""
        text = self.bytes[token].decode("latin-1")
        for n in range(len(text) - 1, 0, -1):
            if text[:n] in self.trie:
                return self.trie.get(text[:n])[0]
        return None

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one match of the pattern."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        longest = [None] * (len(piece) + 1)
        for end, (token, n) in self.trie.iter(piece.decode("latin-1")):
            longest[end - n + 1] = token  # at an equal start the later match is longer
        out: list[int] = []
        given_up = bytearray(len(piece) + 1)
        at, token = 0, longest[0]
        while at < len(piece):
            while token is not None:
                end = at + self.size[token]
                if not given_up[end] and (not out or self.fits[out[-1], token]):
                    break
                token = self.shorter[token]
            if token is None:
                given_up[at] = 1
                last = out.pop()
                at -= self.size[last]
                token = self.shorter[last]
            else:
                out.append(token)
                at, token = end, longest[end]
        return out

    def _word(self, word: str) -> str:
        """Ids of a word and the space before it, as decimals joined by commas."""
        return self._ids(" " + word)

    def _ids(self, text: str) -> str:
        encode = self.encode_piece
        return ",".join(str(i) for p in self.findall(text) for i in encode(p.encode()))

    def encode(self, text: str) -> str:
        """Ids of a whole text as decimals joined by commas.

        The pattern always starts a new match at a space that something other
        than white space follows, so the text may be cut there and each word
        looked up."""
        if not text:
            return ""
        first, *rest = self.at_spaces(text) if self.spaced(text) else text.split(" ")
        head = self._ids(first) if first else ""
        if not rest:
            return head
        tail = ",".join(map(self.word.__getitem__, rest))
        return f"{head},{tail}" if head else tail

    def decode(self, ids: str) -> bytes:
        return b"".join(map(self.by_text.__getitem__, ids.split(","))) if ids else b""


@lru_cache(maxsize=2)
def byte_bpe(path: str, pattern: str, words: int = WORDS) -> ByteBpe:
    return ByteBpe(path, pattern, words)


def encode_documents(docs: DataFrame, path: str | None = None, pattern: str | None = None,
                     keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ``ids``, the decimals
    joined by commas, when asked) for each row's whole text.

    The ids are those of the tiktoken library without special tokens; the
    decoded bytes come from the ids alone. A null or empty text has no ids.
    Repeated rows and null doc_ids are kept as they are, other columns ignored.
    """
    import public_tokenizers

    path, pattern = path or tokenizer_path("byte_bpe_multi_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids string" * keep_ids

    def make():
        bpe = byte_bpe(path, pattern)

        def work(doc_ids, texts):
            ids = [bpe.encode(t) for t in texts]
            return {
                "doc_id": doc_ids,
                "n_tokens": [x.count(",") + 1 if x else 0 for x in ids],
                "ids_sha256": [hashlib.sha256(x.encode()).hexdigest() for x in ids],
                "decoded_sha256": [hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids],
                "ids": ids,
            }

        return work

    return map_columns(text_or_empty(docs, "doc_id"), schema, make)
