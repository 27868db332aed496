"""Whole texts as numbered distinct words, so that a tokenizer sees each word
of a slice once. Nothing outlives the slice: memory follows its bytes."""

from __future__ import annotations

import json
from array import array
from collections.abc import Callable, Collection, Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: UTF-8 bytes of text worked on at once (a longer text is a slice of its own).
SLICE = 4 << 20
#: Bytes of distinct words encoded in one go, and words that a task keeps the ids of.
CALL, KEPT = 2 << 20, 1 << 20

# A plain text may be cut at every space. Any other is only cut at a space after
# a character that is no space and before a letter, number, mark or symbol, where
# byte-level patterns start a match and space-first pieces end.
_ODD = r"^ | $| [\x00-\x20\x7f-\x{a0}\p{Z}\p{C}\p{M}]"
_CUT = r"(?<=[^ ]) (?=[\p{L}\p{N}\p{P}\p{S}])"


def slices(texts: pa.Array, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges (from, to) of at most ``most`` bytes of text, or of one row."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    a, total = 0, 0
    for b, n in enumerate(size.tolist()):
        if b > a and total + n > most:
            yield a, b
            a, total = b, 0
        total += n
    if len(size) > a:
        yield a, len(size)


@dataclass
class Words:
    """The words of some texts, without the space before each.

    ``rows[k]`` is the row of the k-th text here (the order is not that of the
    rows); its words are ``distinct[codes[i]]`` for i from ``starts[k]`` up to
    ``starts[k + 1]``. An empty text has none.
    """

    distinct: pa.Array
    codes: np.ndarray
    rows: np.ndarray
    starts: np.ndarray

    def spaced(self) -> tuple[pa.Array, np.ndarray]:
        """Words with the space before them, but for the first of each text, and their codes."""
        some = self.starts[:-1][np.diff(self.starts) > 0]
        firsts, back = np.unique(self.codes[some], return_inverse=True)
        codes = self.codes.copy()
        codes[some] = len(self.distinct) + back
        return pa.concat_arrays([with_space(self.distinct), self.distinct.take(pa.array(firsts, pa.int64()))]), codes


def with_space(words: pa.Array) -> pa.Array:
    return pc.binary_join_element_wise(pa.scalar("", words.type), words, pa.scalar(" ", words.type))


def split_words(texts: pa.Array, whole: Collection[str] = ()) -> Words:
    """Cut texts (null: empty) into words; one that holds a string of
    ``whole``, such as a special token, stays in one piece."""
    import regex

    texts = pc.fill_null(texts, "")
    odd = pc.match_substring_regex(texts, "|".join([_ODD, *(rf"\Q{s}\E" for s in whole)])).to_numpy(zero_copy_only=False)
    none = pc.equal(texts, "").to_numpy(zero_copy_only=False)
    plain = ~odd & ~none
    lists = pc.split_pattern(texts.filter(pa.array(plain)), " ")
    counts, flat = [pc.list_value_length(lists).to_numpy(zero_copy_only=False)], [pc.list_flatten(lists)]
    if odd.any():
        cut = regex.compile(_CUT).split
        some = [[t] if any(s in t for s in whole) else cut(t) for t in texts.filter(pa.array(odd)).to_pylist()]
        counts.append(np.fromiter(map(len, some), np.int64, len(some)))
        flat.append(pa.array([w for words in some for w in words], flat[0].type))
    coded = pa.concat_arrays(flat).dictionary_encode()
    rows = np.concatenate([np.flatnonzero(plain), np.flatnonzero(odd), np.flatnonzero(none)])
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.concatenate([*counts, np.zeros(int(none.sum()), np.int64)]), out=starts[1:])
    return Words(coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), rows, starts)


@dataclass
class Ragged:
    """Lists of numbers end to end: list k is ``flat[starts[k]:starts[k + 1]]``."""

    flat: np.ndarray
    starts: np.ndarray

    @cached_property
    def sizes(self) -> np.ndarray:
        return np.diff(self.starts)

    def take(self, codes: np.ndarray) -> "Ragged":
        """The lists of ``codes``, end to end."""
        sizes = self.sizes[codes]
        starts = np.zeros(len(codes) + 1, np.int64)
        np.cumsum(sizes, out=starts[1:])
        at = np.repeat(self.starts[:-1][codes] - starts[:-1], sizes)
        at += np.arange(len(at))
        return Ragged(self.flat[at], starts)

    def merge(self, borders: np.ndarray) -> "Ragged":
        """Neighbouring lists joined: list k takes those from borders[k] up to borders[k + 1]."""
        return Ragged(self.flat, self.starts[borders])


def encode_words(words: pa.Array, encode: Callable[[pa.Array], Ragged]) -> Ragged:
    """Ids of each word, some of them at a time."""
    return end_to_end([encode(words.slice(a, b - a)) for a, b in slices(words, CALL)])


class Remembered:
    """An encoder that a task keeps the ids of up to ``most`` words with: the
    first slices bring the frequent ones. It goes when the task ends. Its owner
    names the encoder with each call, for a cycle would keep both in memory."""

    def __init__(self, encode: Callable[[pa.Array], Ragged] | None = None, most: int = KEPT):
        self.encode, self.most = encode, most
        self.words, self.ids = pa.array([], pa.string()), ragged([])

    def __call__(self, words: pa.Array, encode: Callable[[pa.Array], Ragged] | None = None) -> Ragged:
        at = pc.index_in(words, value_set=self.words)
        unseen = pc.is_null(at)
        new = words.filter(unseen)
        both = end_to_end([self.ids, encode_words(new, encode or self.encode)])
        codes = pc.fill_null(at, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        codes[unseen.to_numpy(zero_copy_only=False)] = len(self.words) + np.arange(len(new))
        room = self.most - len(self.words)
        if room > 0 and len(new):
            self.words = pa.concat_arrays([self.words, new.slice(0, room)])
            ends = both.starts[:len(self.words) + 1]
            self.ids = Ragged(both.flat[:ends[-1]], ends)
        return both.take(codes)


def end_to_end(parts: list[Ragged]) -> Ragged:
    sizes = np.concatenate([np.empty(0, np.int64), *(p.sizes for p in parts)])
    return Ragged(np.concatenate([np.empty(0, np.int32), *(p.flat for p in parts)]), np.concatenate([[0], np.cumsum(sizes)]))


def ragged(lists: list[list[int]]) -> Ragged:
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return Ragged(np.fromiter(chain.from_iterable(lists), np.int32), np.concatenate([[0], np.cumsum(sizes)]))


class LibraryTokenizer:
    """Batch encoder of a tokenizers file without added tokens: call it with words.

    Plain words are first cut into the matches of the file's own pattern, and each
    distinct match is encoded once a task. It goes to the library's model in the file's
    byte-level letters, as the library itself would hand it on; matches that the
    normalizer may change by more than small letters go to the library as one text, where ``marks`` tells
    where each match's tokens end; should their number not fit, each match is a
    text of its own. So is any word that is not plain.
    """

    #: The normalizer changes nothing of these but capitals, which Arrow's small letters equal here.
    LATIN = r"^[\n\x20-\x7e\x{a1}-\x{ff}]*$"
    #: Latin-1 words of one run of letters and what else may follow, which are a match each.
    LETTERS_FIRST = r"^(?P<letters> ?[A-Za-z\x{aa}\x{b5}\x{ba}\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}]+)(?P<rest>[!-/:-@\[-`{-~\x{a1}-\x{a9}\x{ab}-\x{b1}\x{b4}\x{b6}-\x{b8}\x{bb}\x{bf}\x{d7}\x{f7}]*)$"
    #: Byte-level letters: a byte that is no printable Latin-1 character is one from 256 on.
    LETTERS = {b: 256 + k for k, b in enumerate([*range(33), *range(127, 161), 173])}

    #: What a plain word has nothing of: white space but line feeds, controls, marks that may join the letter before them.
    UNPLAIN = r"[\x00-\x09\x0b-\x20\x7f-\x{a0}\p{Z}\p{Cf}\p{Co}\p{M}]"

    def __init__(self, path: str, plain_specials: bool = False):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has the cores
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain_specials
        self.specials = [a.content for a in self.tokenizer.get_added_tokens_decoder().values()]
        #: special strings that it finds inside texts
        self.found = [] if plain_specials else self.specials
        with open(path) as f:
            spec = json.load(f)
        cut, suffix = spec["pre_tokenizer"] or {}, spec["model"].get("end_of_word_suffix")
        vocab = self.tokenizer.get_vocab()
        self.begins, self.marks, pattern = not suffix, np.zeros(max(vocab.values()) + 1, bool), None
        if cut.get("type") == "ByteLevel" and cut["use_regex"] and not cut["add_prefix_space"] and not spec["normalizer"]:
            import public_tokenizers

            pattern, marked = public_tokenizers.PATTERN, lambda t: t.startswith("Ġ")  # a byte-level space
        elif suffix and cut.get("type") == "Sequence" and cut["pretokenizers"][0]["type"] == "Split":
            pattern, marked = cut["pretokenizers"][0]["pattern"]["Regex"], lambda t: t.endswith(suffix)
        if pattern:
            self.marks[[i for t, i in vocab.items() if marked(t)]] = True
        self.findall = pattern and regex.compile(pattern if self.begins else f"\n|{pattern}").findall
        self.model, self.known = self.tokenizer.model, Remembered()
        self.lower = bool(spec["normalizer"])  # matches depend on normalized text, which plain small letters are

    def __call__(self, words: pa.Array) -> Ragged:
        if not self.findall or not len(words):
            return self.single(words)
        plain = pc.invert(pc.match_substring_regex(pc.utf8_ltrim(words, " ") if self.begins else words, self.UNPLAIN))
        if self.begins:  # where a word begins is seen by its space
            plain = pc.and_(plain, pc.match_substring_regex(words, "^ [^ \n]"))
        for s in self.specials:
            plain = pc.and_(plain, pc.invert(pc.match_substring(words, s)))
        if self.lower:
            words, small = pc.if_else(pc.match_substring_regex(words, self.LATIN), pc.utf8_lower(words), words), pc.utf8_lower(words)
            plain = pc.and_(plain, pc.equal(words, small))
        plain = plain.to_numpy(zero_copy_only=False)
        parts = [self.cut(words.filter(pa.array(plain))), self.single(words.filter(pa.array(~plain)))]
        if plain.all():
            return parts[0]
        return end_to_end(parts).take(np.argsort(np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])))

    def cut(self, words: pa.Array) -> Ragged:
        """Ids of plain words by the matches that they consist of."""
        if not len(words):
            return ragged([])
        two = pc.extract_regex(words, self.LETTERS_FIRST)
        simple = pc.is_valid(two).to_numpy(zero_copy_only=False)
        others, two = words.filter(pa.array(~simple)), two.filter(pa.array(simple))
        found = self.found_in(others)
        if found is None:
            return end_to_end([self.cut(words.filter(pa.array(simple))), self.single(others)]).take(np.argsort(np.argsort(~simple, kind="stable")))
        n = len(two)
        coded = pa.concat_arrays([*two.flatten(), found[0]]).dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        codes[:2 * n] = codes[:2 * n].reshape(2, n).T.ravel()  # letters and what follows them, word by word
        borders = np.concatenate([np.arange(0, 2 * n, 2), 2 * n + found[1]])
        return self.known(coded.dictionary, self.matches).take(codes).merge(borders).take(np.argsort(np.argsort(~simple, kind="stable")))

    def found_in(self, words: pa.Array) -> tuple[pa.Array, np.ndarray] | None:
        """Matches of all words, and where each word's begin (and the last one's end);
        none if they do not tell the words apart."""
        if not self.begins:  # line breaks are white space like any other here, so they can tell words apart
            words = pc.replace_substring(words, "\n", " ")
        matches = pa.array(self.findall(("" if self.begins else "\n").join(words.to_pylist()) + "\n" * (not self.begins and len(words) > 0)), pa.string())
        border = (pc.starts_with(matches, " ") if self.begins else pc.equal(matches, "\n")).to_numpy(zero_copy_only=False)
        at = np.flatnonzero(border)
        if len(at) != len(words):
            return None
        if self.begins:
            return matches, np.append(at, len(matches))
        return matches.filter(pa.array(~border)), np.concatenate([[0], at - np.arange(len(at))])

    def matches(self, pieces: pa.Array) -> Ragged:
        """Ids of distinct matches of plain words."""
        ascii_ = pc.string_is_ascii(pieces).to_numpy(zero_copy_only=False)
        other = pc.match_substring_regex(pieces, self.LATIN).to_numpy(zero_copy_only=False) ^ ascii_ if self.lower else ~ascii_
        some = [ascii_, other, ~ascii_ & ~other]
        texts = pc.replace_substring(pc.replace_substring(pieces.filter(pa.array(ascii_)), " ", "\u0120"), "\n", "\u010a").to_pylist()
        texts += [p.encode().decode("latin-1").translate(self.LETTERS) for p in pieces.filter(pa.array(other)).to_pylist()]
        ids, ends = array("i"), array("q", [0])
        for tokens in map(self.model.tokenize, texts):
            ids.extend([t.id for t in tokens])
            ends.append(len(ids))
        whole = Ragged(np.array(ids, np.int32), np.array(ends, np.int64))
        both = end_to_end([whole, self.joined(pieces.filter(pa.array(some[2])))])
        return both.take(np.argsort(np.concatenate([np.flatnonzero(which) for which in some])))

    def single(self, texts: pa.Array) -> Ragged:
        lists = texts.to_pylist()
        return end_to_end([ragged([e.ids for e in self.tokenizer.encode_batch_fast(lists[k:k + 512], add_special_tokens=False)]) for k in range(0, len(lists), 512)])

    def joined(self, pieces: pa.Array, some: int = 512) -> Ragged:
        out = []
        for k in range(0, len(pieces), some):
            text = ("" if self.begins else " ").join(pieces.slice(k, some).to_pylist())
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)
            at, n = np.flatnonzero(self.marks[ids]), min(some, len(pieces) - k)
            if len(at) != n or at[0 if self.begins else -1] != (0 if self.begins else len(ids) - 1):
                out.append(self.single(pieces.slice(k, some)))
            else:
                out.append(Ragged(ids, np.append(at, len(ids)) if self.begins else np.concatenate([[0], at + 1])))
        return end_to_end(out)
