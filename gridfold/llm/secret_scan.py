"""Secret scans: candidates by pattern, false positives removed by a random forest.

The forest judges a candidate by its length, its character transitions, how much
of it dictionary words cover, whether it is part of a path, and the words around
it. It is trained here from labelled findings.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from gridfold.llm.common import map_columns, rewrite_text, text_or_empty

KEY_WORDS = r"(?:pass(?:wor[dt]|wd|phrase)?|pwd|secret|token|credentials?|auth|bearer|api[_-]?key|access[_-]?key|private[_-]?key)"
#: What can be a secret: a key block; a value given to a credential's name, up to
#: the closing quote, or to white space without one (a comma or the like ends it
#: only before white space, a tag or the next name); a key with the mark of its
#: issuer; or a long run of key characters. Digits are left to the forest.
NAMED = rf"(?i:{KEY_WORDS}[\w-]{{0,20}}[\"']?\s*(?:[:=]|=>|is)\s*)"
RUN = r"A-Za-z0-9_+/=-"
CANDIDATE = re.compile(
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[^-]|-(?!----))*-----END [A-Z ]*PRIVATE KEY-----"
    rf"|{NAMED}(?P<q>[\"'])(?P<quoted>(?:\\[^\n]|(?!(?P=q))[^\\\n]){{6,}})(?P=q)"
    rf"|{NAMED}[\"']?(?P<value>(?:[^\s\"',;<>]|(?:[,;<>](?=[,;<>]{{0,8}}[^\s\"',;<>/])|[\"'](?=[^\s\"',;<>]))(?![,;<>\"']{{0,8}}[\w-]{{1,40}}[\"']?\s{{0,4}}[:=])){{6,}})"
    rf"|(?<![{RUN}])(?:(?:AKIA|ASIA|ABIA|ACCA)[A-Z0-9]{{16}}|gh[opsur]_[A-Za-z0-9]{{20,}}|github_pat_\w{{20,}}|[srp]k_(?:live|test)_[A-Za-z0-9]{{16,}}"
    rf"|xox[abeoprs]-[A-Za-z0-9-]{{10,}}|glpat-[\w-]{{16,}}|npm_[A-Za-z0-9]{{20,}})(?![{RUN}])"
    rf"|(?<![{RUN}])[{RUN}]{{16,}}",
)
KEYED = re.compile(KEY_WORDS, re.I)
HARMLESS = re.compile(r"example|sample|dummy|placeholder|changeme|commit|sha-?\d|md5|checksum|digest|uuid|invoice|order|phone|card|isbn|version|build", re.I)
AROUND = 48  # characters looked at on either side of a candidate
REDACTED = "[SECRET]"

FEATURES = (
    "log_length", "digits", "upper", "lower", "other", "turns", "bigrams", "distinct", "covered", "path", "keyed", "harmless",
    "assigned", "quoted", "hex", "keyed_after", "harmless_after",
)
#: Dictionary: the most frequent words of the corpus, 4 to 12 small letters each.
DICTIONARY, MIN_WORD, MAX_WORD = 5_000, 4, 12


def dictionary(docs: DataFrame, size: int = DICTIONARY) -> dict[str, int]:
    """The ``size`` most frequent plain words of all texts, with their counts
    (ties: in alphabetical order): a top-k, so the driver gets a bounded list."""
    each = docs.select(F.explode(F.split("text", " ")).alias("w")).where(F.col("w").rlike(rf"\A[a-z]{{{MIN_WORD},{MAX_WORD}}}\z"))
    top = each.groupBy("w").count().orderBy(F.desc("count"), "w").limit(size)
    return {r["w"]: r["count"] for r in top.collect()}


class Reader:
    """Features of candidates, given the dictionary."""

    def __init__(self, words: dict[str, int]):
        self.words = words
        pairs = np.ones((27, 27))
        for w, n in words.items():
            codes = [ord(c) - 96 if "a" <= c <= "z" else 0 for c in w]
            np.add.at(pairs, (codes[:-1], codes[1:]), n)
        self.log = np.log(pairs / pairs.sum(axis=1, keepdims=True))

    def covered(self, s: str) -> float:
        """Share of the characters that dictionary words cover, longest first from the left."""
        s, at, hit = s.lower(), 0, 0
        while at < len(s):
            for n in range(min(MAX_WORD, len(s) - at), MIN_WORD - 1, -1):
                if s[at:at + n] in self.words:
                    at, hit = at + n, hit + n
                    break
            else:
                at += 1
        return hit / max(1, len(s))

    def features(self, text: str, start: int, end: int) -> tuple[float, ...]:
        s, before, after, n = text[start:end], text[max(0, start - AROUND):start], text[end:end + AROUND], end - start
        kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "o" for c in s]
        codes = np.array([ord(c) - 96 if "a" <= c <= "z" else 0 for c in s.lower()])
        near = self.log[codes[:-1], codes[1:]].mean() if n > 1 else 0.0
        share = lambda k: kinds.count(k) / n
        return (
            float(np.log1p(n)), share("d"), share("u"), share("l"), share("o"),
            sum(a != b for a, b in zip(kinds, kinds[1:])) / n, float(near), len(set(s)) / n, self.covered(s),
            float(s.count("/") / n > 0.05 or before[-1:] in ("/", ".", "\\") or "://" in before[-30:]),
            float(bool(KEYED.search(before) or s.startswith("-----BEGIN"))), float(bool(HARMLESS.search(before) or HARMLESS.search(s))),
            float(before.rstrip(" \"'")[-1:] in ("=", ":")), float(before[-1:] in ("\"", "'")),
            float(all(c in "0123456789abcdefABCDEF" for c in s)), float(bool(KEYED.search(after))), float(bool(HARMLESS.search(after))),
        )

    def candidates(self, text: str) -> list[tuple[int, int]]:
        return [m.span(m.lastgroup) if m.lastgroup in ("quoted", "value") else m.span() for m in CANDIDATE.finditer(text)]


@dataclass
class Forest:
    """Trees as arrays: feature (-1: leaf), threshold, children, share of secrets."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, threshold, right, value in self.trees:
            at = np.zeros(len(x), dtype=np.int64)
            while (inner := feature[at] >= 0).any():
                goes = x[np.arange(len(x)), np.maximum(feature[at], 0)] > threshold[at]
                at = np.where(inner, np.where(goes, right[at], at + 1), at)
            total += value[at]
        return total / len(self.trees)


def fit_forest(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 8, least: int = 3, seed: int = 7) -> Forest:
    """Bagged trees by Gini gain over a random third of the features at each node."""
    rng = np.random.default_rng(seed)
    tries = max(2, x.shape[1] // 3)

    def best(rows: np.ndarray) -> tuple[float, int, float]:
        found = (0.0, -1, 0.0)
        for k in rng.choice(x.shape[1], tries, replace=False):
            order = rows[np.argsort(x[rows, k], kind="stable")]
            v, ones, n = x[order, k], np.cumsum(y[order]), len(order)
            left = np.arange(1, n)
            share_l, share_r = ones[:-1] / left, (ones[-1] - ones[:-1]) / (n - left)
            all_ = ones[-1] / n
            gain = all_ * (1 - all_) - (left * share_l * (1 - share_l) + (n - left) * share_r * (1 - share_r)) / n
            gain[(v[1:] <= v[:-1]) | (left < least) | (n - left < least)] = 0
            if len(gain) and gain.max() > found[0] + 1e-12:
                i = int(gain.argmax())
                found = (float(gain[i]), int(k), float(v[i]))
        return found

    def grow(rows: np.ndarray, level: int, out: list) -> None:
        node = len(out)
        out.append([-1, 0.0, 0, float(y[rows].mean())])
        gain, k, cut = best(rows) if level < depth and 0 < out[node][3] < 1 else (0.0, -1, 0.0)
        if k >= 0:
            goes = x[rows, k] > cut
            grow(rows[~goes], level + 1, out)  # the left child comes next
            out[node][:3] = [k, cut, len(out)]
            grow(rows[goes], level + 1, out)

    made = []
    for _ in range(trees):
        out: list = []
        grow(rng.integers(0, len(x), len(x)), 0, out)
        f, t, r, v = zip(*out)
        made.append((np.array(f), np.array(t), np.array(r), np.array(v)))
    return Forest(made)


def labelled_findings(words: list[str], n: int = 4_000, seed: int = 11) -> list[tuple[str, int, int, bool]]:
    """(text, start, end, is a secret): findings as a reviewer would mark them.
    Random keys of the usual kinds, with digits or without, in assignments or bare,
    and passwords with marks in them are secrets; numbers, identifiers, paths,
    digests named as such, placeholders, long and joined words in any case,
    rules, and phrases in quotes are not. ``words`` makes the prose around them."""
    rng = random.Random(seed)
    words = words or ["lorem", "ipsum", "dolor", "amet", "sunt", "culpa"]
    hexes, alnum = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    capitals, letters = alnum[:26], alnum[:52]

    def draw(chars: str, *sizes: int) -> str:
        return "".join(rng.choice(chars) for _ in range(rng.choice(sizes)))

    def prose(k: int) -> str:
        return " ".join(rng.choice(words) for _ in range(k))

    def secret() -> str:
        return rng.choice([
            lambda: draw(hexes, 16, 18, 20, 24, 32, 40, 48, 64), lambda: draw(alnum, 20, 24, 32, 36, 40, 64), lambda: draw(alnum + "+/", 40, 44, 88) + "=",
            lambda: rng.choice(["AKIA", "ASIA"]) + draw("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16),
            lambda: rng.choice(["ghp_", "sk_live_", "xoxb-", "glpat-", "npm_"]) + draw(alnum, 24, 36),
            lambda: rng.choice(["AKIA", "ASIA"]) + draw(capitals, 16) if rng.random() < 0.5 else draw(letters, 20, 24, 32, 40),
        ])()

    def marked() -> str:
        return "".join(rng.sample(draw(alnum, 6, 8, 12, 16) + draw(",;<>!@#$%&*", 1, 2, 4), k=7)) + draw(alnum, 1, 4)

    def long_word() -> str:
        w = "".join(rng.choice(words) for _ in range(rng.randint(2, 5)))
        while len(w) < 16:
            w += rng.choice(words)
        return rng.choice([str.lower, str.lower, str.capitalize, str.upper])(w)

    def harmless() -> tuple[str, str]:
        word = lambda: rng.choice(words)
        digits = "0123456789"
        return rng.choice([
            lambda: ("", draw(digits, 16, 18, 20)), lambda: ("phone ", "+" + draw(digits, 15, 16)),
            lambda: (rng.choice(["commit ", "sha256: ", "md5=", "checksum "]), draw(hexes, 32, 40, 64)),
            lambda: (rng.choice(["", "uuid "]), "-".join(draw(hexes, k) for k in (8, 4, 4, 4, 12))),
            lambda: ("", "-".join([word(), word(), draw(digits, 1, 2, 4), word()])), lambda: ("", "_".join([word(), word(), word()]) + draw(digits, 1, 2)),
            lambda: (rng.choice(["/", "https://"]), "/".join([word(), word(), word() + draw(digits, 1, 2), word()])),
            lambda: (rng.choice(["password=", "token: ", "api_key = "]), rng.choice(["changeme", "your_", "example_", "placeholder_"]) + word() + draw(digits, 1, 2)),
            lambda: (rng.choice(["password: ", "token = ", "secret is "]), word() + word()), lambda: ("", word() + word() + word() + word() + draw(digits, 1)),
            lambda: ("", long_word()), lambda: ("", long_word()),
            lambda: ("", rng.choice(["-", "_", "/", ""]).join(rng.choice([str, str.capitalize, str.upper])(word()) for _ in range(rng.randint(3, 5)))),
            lambda: ("", rng.choice("=-_+/") * rng.randint(16, 60)), lambda: (rng.choice(["password is \"", "token: \"", "secret = '"]), prose(rng.randint(2, 5))),
            lambda: ("", "x" * rng.randint(16, 30) + "1"), lambda: ("", "=" * rng.randint(10, 20) + draw(digits, 4) + "=" * 10),
        ])()

    out = []
    while len(out) < n:
        good, named = rng.random() < 0.5, rng.random() < 0.2
        if good:
            name = rng.choice(["password=", "passwd: ", "token = ", "api_key=", "secret: ", "access_key = ", "key ", "", ""])
            lead, value = name + rng.choice(["", "\"", "'"]), marked() if name[-1:] in "= " and rng.random() < 0.15 and "=" in name else secret()
        else:
            lead, value = harmless()
        if rng.random() < 0.05:  # a digest, or a key, by what stands after it
            lead, value, named = "", draw(hexes, 32, 40, 64), not good
        head = f"{prose(rng.randint(0, 6))} {lead}"
        told = ["is the password", "as api key", "(secret token)"] if good else ["is the commit", "(sha256)", "as checksum", "order number", "uuid"]
        tail = f"{rng.choice(told)} {prose(1)}" if named else prose(3)
        out.append((f"{head}{value}{lead[-1:] if lead[-1:] in ('\"', chr(39)) else ''} {tail}", len(head), len(head) + len(value), good))
    return out


def train(words: dict[str, int], findings: list[tuple[str, int, int, bool]] | None = None) -> tuple[Reader, Forest]:
    """The forest for ``findings`` (bounded: the caller's list)."""
    reader = Reader(words)
    findings = findings or labelled_findings(sorted(words))
    x = np.array([reader.features(t, a, b) for t, a, b, _ in findings])
    return reader, fit_forest(x, np.array([float(s) for *_, s in findings]))


def _judge(reader: Reader, forest: Forest, texts: list[str], threshold: float) -> list[list[tuple[int, int, float]]]:
    """Spans and scores of the candidates of each text, all scored at once."""
    spans = [reader.candidates(t) for t in texts]
    x = [reader.features(t, a, b) for t, s in zip(texts, spans) for a, b in s]
    p = iter(forest.score(np.array(x)).tolist() if x else [])
    return [[(a, b, next(p)) for a, b in s] for s in spans]


def scan_documents(docs: DataFrame, threshold: float = 0.5, findings: list | None = None) -> DataFrame:
    """doc_id, n_candidates, n_secrets, spans, top_score per row of ``docs``.

    ``spans`` are the secrets' code points as start-end, joined by commas;
    ``top_score`` is the highest score of a candidate (null without one).
    Null and empty texts have no candidate; repeated rows and null doc_ids are
    kept; an empty table gives an empty result; other columns are ignored.
    """
    texts = text_or_empty(docs, "doc_id")
    reader, forest = train(dictionary(texts), findings)

    def make():
        def work(doc_ids, texts):
            found = _judge(reader, forest, texts, threshold)
            hits = [[(a, b) for a, b, p in f if p >= threshold] for f in found]
            return {
                "doc_id": doc_ids, "n_candidates": [len(f) for f in found], "n_secrets": [len(h) for h in hits],
                "spans": [",".join(f"{a}-{b}" for a, b in h) for h in hits],
                "top_score": [max((p for *_, p in f), default=None) for f in found],
            }

        return work

    return map_columns(texts, "doc_id long, n_candidates long, n_secrets long, spans string, top_score double", make)


def redact_documents(docs: DataFrame, threshold: float = 0.5, findings: list | None = None) -> DataFrame:
    """``docs`` with each secret replaced by a mark, and ``n_chars`` to match."""
    reader, forest = train(dictionary(text_or_empty(docs)), findings)

    def make():
        def work(texts):
            out = []
            for t, found in zip(texts, _judge(reader, forest, texts, threshold)):
                at, parts = 0, []
                for a, b, p in found:
                    if p >= threshold:
                        parts += [t[at:a], REDACTED]
                        at = b
                out.append("".join([*parts, t[at:]]))
            return out

        return work

    return rewrite_text(docs, make)
