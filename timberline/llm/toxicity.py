"""Toxicity scores: Levenshtein automata run against a trie of learned terms, with context windows.

Terms are the words of toxic documents that the labels single out. A word of a document is folded (lower case, common
letter disguises, inner signs dropped) and runs as an automaton of its spelling and an allowed number of errors down the
trie; so it meets all terms within that distance in one walk, without a list of variants. Before that the different words of
some texts are sieved together: a term cut into one piece more than there may be errors has a piece without errors at a known
place, so a word without such a piece meets no term and needs no walk. A hit whose window of words
opens a quotation before it and closes one behind it counts as quoted. The score is logistic in the hits: strongest and
number of exact, of misspelled and of quoted ones.

Terms are learned from one part of the training labels and the weights from the other. Labels show few misspelled and
quoted terms, so the weights are fitted on two variants of each toxic document besides itself: one whose terms are misspelled
by an error each counts as toxic, one that only quotes its terms as not toxic. Words near a term that clean documents
use are learned as harmless, and a term that ``most_near`` of them are near to is matched without errors only.

What is learned from is bounded: ``most_rows`` labelled documents of each label, taken by a hash of their ids, and
``most_terms`` terms. Both are broadcast, under these bounds; harmless words are words of those documents. Equal texts of a label
are learned from once, so the model doesn't depend on partitions. Scoring covers every whole document. Words of four letters
or fewer match exactly only; up to eight letters may have one error, longer ones two.

Defined results: null and blank texts have no hits and get the score of a document without hits. Without labels of both
kinds every score is the share of toxic labels (0.5 without labels). Repeated rows are scored each. Extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, cut, word_bounds
from .labels import held_out, training_labels

_DISGUISE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "€": "e"})
_EDGE = "\"'“”„«»‘’‹›()[]{}<>.,;:!?…*_-#%&$@|/\\+=~`^"
_OPEN, _CLOSE = "\"“„«‘‹'", "\"”“»’›'"
WINDOW = 8


def fold(word: str) -> str:
    """The spelling by which a word is looked up."""
    w = word.lower().strip(_EDGE)
    return w if w.isalpha() else "".join(filter(str.isalpha, w.translate(_DISGUISE)))


def allowed(length: int) -> int:
    """Errors that a word of so many letters may have."""
    return 0 if length < 5 else 1 if length < 9 else 2


def misspelled(word: str) -> str:
    """``word`` with one error inside, chosen by its hash: a letter left out, doubled or replaced."""
    n, h = len(word), zlib.crc32(word.encode())
    if n < 3:
        return word
    i = 1 + h % (n - 2)
    put = ("", word[i] * 2, "x" if word[i] != "x" else "y")[h // 64 % 3]
    return word[:i] + put + word[i + 1 :]


def _letters(word: str) -> int:
    """The set of letters as bits."""
    out = 0
    for c in word:
        out |= 1 << (ord(c) % 64)
    return out


#: Texts are cut into words in pieces of about so many bytes, whole documents each, to bound memory.
PIECE_BYTES = 8 << 20
#: What str.split takes as blanks, in UTF-8.
_BLANKS = [c.encode() for c in map(chr, range(1 << 16)) if c.isspace()]
_BLANK = np.isin(np.arange(256), [b[0] for b in _BLANKS if len(b) == 1])


def blank_bytes(data: np.ndarray) -> np.ndarray:
    """Which bytes of the UTF-8 ``data`` are of blanks as str.split has them."""
    out = _BLANK[data]
    for first in {b[0] for b in _BLANKS if len(b) > 1}:
        at = np.flatnonzero(data == first)
        for sign in (b for b in _BLANKS if b[0] == first):
            own = at[at + len(sign) <= len(data)]
            for k in range(1, len(sign)):
                own = own[data[own + k] == sign[k]]
            for k in range(len(sign)):
                out[own + k] = True
    return out


def numbered_words(column: pa.Array) -> Iterator[tuple[int, list[str], np.ndarray, np.ndarray]]:
    """The words, as str.split has them, of some texts at a time: the first text's row, the different words, the numbers of the
    texts' words in turn, and where those of each text begin and end."""
    if not len(column):
        return
    texts = as_bytes(column)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    d = 0
    while d < len(texts):
        e = max(d + 1, int(np.searchsorted(offsets, offsets[d] + PIECE_BYTES, side="right")) - 1)
        piece, own = data[int(offsets[d]) : int(offsets[e])], offsets[d : e + 1] - offsets[d]
        blank = blank_bytes(piece)
        begin, end = word_bounds(piece, own, blank)
        bounds = np.zeros(len(begin) + 1, np.int64)
        np.cumsum(end - begin, out=bounds[1:])
        words = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(bounds), pa.py_buffer(piece[~blank])).dictionary_encode()
        yield d, words.dictionary.to_pylist(), words.indices.to_numpy(), np.searchsorted(begin, own)
        d = e


@cache
def _sign_tables(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each code point below ``size``: the letter that it stands for, if it is a disguise; whether that is a letter; whether it is cut off at the ends of a word."""
    signs = np.arange(size, dtype=np.uint32)
    plain = signs.copy()
    plain[list(_DISGUISE)] = [ord(c) for c in _DISGUISE.values()]
    return plain, np.array([chr(c).isalpha() for c in plain]), np.isin(signs, [ord(c) for c in _EDGE])


def fold_all(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``fold`` of all words, which have no line ends: their code points in turn, and where each word's begin and end."""
    signs = np.frombuffer("\n".join([*words, ""]).lower().encode("utf-32-le"), np.uint32)
    plain, letter, edge = _sign_tables(1 << 16 if len(signs) == 0 or signs.max() < 1 << 16 else 0x110000)
    ends = np.flatnonzero(signs == 10)
    begins = np.concatenate([[0], ends[:-1] + 1]).astype(np.int64)
    solid = np.flatnonzero(~edge[signs] & (signs != 10))
    first, last = np.searchsorted(solid, begins), np.searchsorted(solid, ends)
    some = first < last
    step = np.zeros(len(signs) + 1, np.int8)
    step[solid[first[some]]] += 1
    step[solid[last[some] - 1] + 1] -= 1
    out = plain[signs]
    kept = (np.cumsum(step[:-1]) > 0) & letter[out]
    return out[kept], np.concatenate([[0], np.cumsum(kept)[ends]]).astype(np.int64)


_STEP = 0x9E3779B97F4A7C15


def _hash(word: str) -> int:
    out = 0
    for c in word:
        out = (out * _STEP + ord(c) + 1) % (1 << 64)
    return out


def _keys(words: Iterable[str]) -> np.ndarray:
    return np.array(sorted(set(map(_hash, words))), np.uint64)


def _among(x: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return keys[np.minimum(np.searchsorted(keys, x), len(keys) - 1)] == x if len(keys) else np.zeros(len(x), bool)


def _cut_at(length: int, errors: int) -> list[int]:
    """Where a term of that length is cut into ``errors`` + 1 pieces."""
    return [*(k * (length // (errors + 1)) for k in range(errors + 1)), length]


class Sieve:
    """Sorts out folded words that meet none of ``terms`` and have none of ``near`` within their allowed errors. What it leaves may hit.

    A term is cut into e + 1 pieces for e errors. Take the first piece i (from 0) up to which there are i errors at most: it has none itself,
    i before it and so e - i behind it at most. The word holds it, moved by i signs at most as counted from its beginning and by e - i as counted from its end.
    """

    def __init__(self, terms: Iterable[str], near: Iterable[str]):
        terms, by = list(terms), {}
        self.whole = _keys(t for t in terms if not t.endswith("*"))
        self.stems = {k: _keys(t[:-1] for t in terms if t.endswith("*") and len(t) == k + 1) for k in STEMS}
        for t in near:
            by.setdefault(len(t), []).append(t)
        self.pieces = {}
        for m, own in by.items():
            for e in {allowed(n) for n in range(max(0, m - 2), m + 3) if abs(n - m) <= allowed(n)} - {0}:
                cuts = _cut_at(m, e)
                self.pieces[m, e] = [_keys(t[a:b] for t in own) for a, b in zip(cuts, cuts[1:], strict=False)]
        self.letters = {m: np.array([_letters(t) for t in own], np.uint64) for m, own in by.items()}
        self.longest = max(max(map(len, terms), default=0), max(by, default=0) + 2, *STEMS)

    def left(self, words: list[str]) -> np.ndarray:
        """The places of those of ``words`` that may hit."""
        signs, bounds = fold_all(words)
        lengths = np.diff(bounds)
        # a word that is longer than any term could be has its stems only
        width = np.minimum(lengths, self.longest + 1)
        out = np.zeros(len(words), bool)
        order = np.argsort(width, kind="stable")
        edges = np.searchsorted(width[order], np.arange(self.longest + 3))
        for n in range(3, self.longest + 2):
            own = order[edges[n] : edges[n + 1]]
            if len(own):
                out[own] = self._of_length(n, signs[bounds[own] + np.arange(n)[:, None]].astype(np.uint64))
        return np.flatnonzero(out)

    def _of_length(self, n: int, signs: np.ndarray) -> np.ndarray:
        """Of words of ``n`` signs, in columns."""
        h = np.zeros((n + 1, signs.shape[1]), np.uint64)
        for k in range(n):
            h[k + 1] = h[k] * np.uint64(_STEP) + signs[k] + np.uint64(1)
        out = _among(h[n], self.whole)
        for k, keys in self.stems.items():
            if n > k:
                out |= _among(h[k], keys)
        e = allowed(n)
        letters = None
        for m in range(n - e, n + e + 1):
            if (m, e) not in self.pieces:
                continue
            met, cuts = np.zeros(len(out), bool), _cut_at(m, e)
            for i, keys in enumerate(self.pieces[m, e]):
                size = cuts[i + 1] - cuts[i]
                power = np.uint64(pow(_STEP, size, 1 << 64))
                for at in range(cuts[i] + max(-i, n - m - e + i), cuts[i] + min(i, n - m + e - i) + 1):
                    if 0 <= at <= n - size:
                        met |= _among(h[at + size] - h[at] * power, keys)
            met = np.flatnonzero(met & ~out)
            if len(met) and letters is None:
                letters = np.bitwise_or.reduce(np.uint64(1) << signs % np.uint64(64), axis=0)
            # an error changes two of the letters used at most
            for k in range(0, len(met), 1024):
                some = met[k : k + 1024]
                out[some] = (np.bitwise_count(letters[some, None] ^ self.letters[m]) <= 2 * e).any(axis=1)
        return out


_END = ""
#: Lengths of word beginnings that are learned as terms too, for inflected forms; such a term ends with a star.
STEMS = (4, 5, 6)


def spellings(w: str) -> list[str]:
    """The terms that a folded word counts for."""
    return [w, *(w[:k] + "*" for k in STEMS if len(w) > k)]


def build_trie(terms: dict[str, float]) -> dict:
    root: dict = {}
    for term, weight in terms.items():
        if term.endswith("*"):  # such terms are looked up as they are
            continue
        node = root
        for sign in term:
            node = node.setdefault(sign, {})
        node[_END] = (term, weight)
    return root


def intersect(trie: dict, word: str, errors: int) -> list[tuple[str, float, int]]:
    """(term, weight, distance) of each term within ``errors`` edits of ``word``: the states of the word's Levenshtein
    automaton, (place, errors so far), move down the trie together."""
    found: dict[str, tuple[float, int]] = {}
    n = len(word)
    stack = [(trie, 0, 0)]
    while stack:
        node, i, e = stack.pop()
        if e == errors:  # only the spelling itself is left
            while i < n and node is not None:
                node = node.get(word[i])
                i += 1
            if node is not None and (hit := node.get(_END)) and (hit[0] not in found or found[hit[0]][1] > e):
                found[hit[0]] = (hit[1], e)
            continue
        if i == n:
            if (hit := node.get(_END)) and (hit[0] not in found or found[hit[0]][1] > e):
                found[hit[0]] = (hit[1], e)
        else:
            stack.append((node, i + 1, e + 1))
        sign = word[i] if i < n else None
        for c, child in node.items():
            if c == _END:
                continue
            if c == sign:
                stack.append((child, i + 1, e))
            elif i < n:
                stack.append((child, i + 1, e + 1))
            stack.append((child, i, e + 1))
    return [(t, w, e) for t, (w, e) in found.items()]


@dataclass
class ToxicityModel:
    terms: dict[str, float] = field(default_factory=dict)
    harmless: frozenset[str] = frozenset()
    crowded: frozenset[str] = frozenset()
    weights: np.ndarray | None = None
    prior: float = 0.5
    most_kept: int = 300_000

    def __post_init__(self):
        self._trie, self._sieve, self._seen = None, None, {}

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def __setstate__(self, state):
        self.__dict__ |= state
        self.__post_init__()

    def _prepare(self) -> None:
        whole = [t for t in self.terms if not t.endswith("*") and t not in self.crowded]
        self._trie, self._sieve = build_trie({t: self.terms[t] for t in whole}), Sieve(self.terms, whole)

    def may_hit(self, words: list[str]) -> list[int]:
        """The places of those of ``words`` that may be or be near a term; the others have no match and nothing near."""
        if self._sieve is None:
            self._prepare()
        return self._sieve.left(words).tolist() if words else []

    def match(self, word: str) -> tuple[float, int, str] | None:
        """(weight, distance, folded word) of the nearest, then strongest term."""
        if word in self._seen:
            return self._seen[word]
        if self._trie is None:
            self._prepare()
        if len(self._seen) > self.most_kept:
            self._seen.clear()
        w, out = fold(word), None
        if len(w) > 2:
            if known := [x for t in spellings(w) if (x := self.terms.get(t)) is not None]:
                out = (max(known), 0, w)
            elif w not in self.harmless:
                errors = allowed(len(w))
                hits = intersect(self._trie, w, errors) if errors else ()
                if hits:
                    out = (max(h[1] for h in hits), min(h[2] for h in hits), w)
        self._seen[word] = out
        return out

    def near(self, w: str) -> list[str]:
        """The terms that the folded word ``w`` is near to, but isn't."""
        if self._trie is None:
            self._prepare()
        errors = allowed(len(w))
        if not errors or any(t in self.terms for t in spellings(w)):
            return []
        return [t for t, _, _ in intersect(self._trie, w, errors)]

    def hits(self, column: pa.Array) -> Iterator[tuple[int, list[str], list[int]]]:
        """Each text with hits: its row, its words and the places of those that hit."""
        for row, words, numbers, bounds in numbered_words(column):
            hit = np.zeros(len(words), bool)
            hit[[k for k in self.may_hit(words) if self.match(words[k])]] = True
            at = np.flatnonzero(hit[numbers])
            edges = np.searchsorted(at, bounds)
            for d in np.flatnonzero(np.diff(edges)).tolist():
                own = at[edges[d] : edges[d + 1]] - bounds[d]
                yield row + d, column[row + d].as_py().split(), own.tolist()

    def features(self, column: pa.Array) -> np.ndarray:
        """The numbers by which each text is scored."""
        out = np.zeros((len(column), 6))
        out[:, 0] = 1.0
        for row, words, places in self.hits(column):
            out[row] = self.word_features(words, places)
        return out

    def word_features(self, words: list[str], places: Iterable[int]) -> list[float]:
        exact, fuzzy, quoted = {}, {}, 0
        for i in places:
            h = self.match(words[i])
            if in_quotation(words, i):
                quoted += 1
            elif h[1] == 0:
                exact[h[2]] = h[0]
            else:
                fuzzy[h[2]] = h[0]
        top = lambda hits: max(hits.values(), default=0.0) ** 2 / 10
        return [1.0, top(exact), math.log1p(len(exact)), top(fuzzy), math.log1p(len(fuzzy)), math.log1p(quoted)]

    def variants(self, words: list[str], places: Iterable[int]) -> list[str]:
        """The text of ``words`` with its terms misspelled, and with its terms quoted; none if it has no term that may be misspelled."""
        terms = {i: w for i in places if self.match(words[i])[1] == 0 and (w := fold(words[i]))}
        if not any(allowed(len(w)) for w in terms.values()):
            return []
        wrong = [misspelled(terms[i]) if i in terms else w for i, w in enumerate(words) if i not in terms or allowed(len(terms[i]))]
        return [" ".join(wrong), " ".join(f'"{terms[i]}"' if i in terms else w for i, w in enumerate(words))]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -500, 500)))


def in_quotation(words: list[str], i: int, window: int = WINDOW) -> bool:
    """Whether a quotation opens at or before word ``i`` and closes at or behind it, both within ``window`` words."""
    opened = None
    for j in range(i, max(-1, i - window - 1), -1):
        if words[j][0] in _OPEN:
            opened = j
            break
        if j < i and words[j].rstrip(".,;:!?")[-1:] in tuple(_CLOSE):
            return False
    if opened is None:
        return False
    for j in range(i, min(len(words), i + window + 1)):
        w = words[j].rstrip(".,;:!?")
        if len(w) > 1 and w[-1] in _CLOSE:
            return True
    return False


def _fit(x: np.ndarray, y: np.ndarray, share: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic weights of rows that count ``share`` each, with a ridge penalty; unquoted hits never count for less than nothing."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (share * (y - p)) - penalty * w
        hess = (x * (share * p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hess, grad)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    w[1:5] = np.maximum(w[1:5], 0)
    return w


def _texts(column: pa.Array) -> Iterator[str]:
    return (t.as_py() or "" for t in column)


def learn(docs: DataFrame, labels: DataFrame, most_rows: int = 12_000, most_terms: int = 5_000, least_documents: int = 4, least_odds: float = 3.0, most_near: int = 4) -> ToxicityModel:
    """A model from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic)."""
    known = training_labels(labels, "toxic").withColumn("h", F.xxhash64("doc_id"))
    part = F.pmod(F.col("h"), F.lit(4)) == 0
    sample = known.filter("y = 1").orderBy("h", "doc_id").limit(most_rows).unionByName(known.filter("y = 0").orderBy("h", "doc_id").limit(most_rows)).select("doc_id", "y", part.alias("weigh"))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    prior = counts.get(1, 0) / total if total else 0.5
    if len(counts) < 2:
        return ToxicityModel(prior=prior)
    # at most 2 * most_rows rows of three small columns
    met = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id")
    rows = cut(met.filter("text is not null").groupBy("text", "y").agg(F.min("weigh").alias("weigh")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            toxic, clean, around, n = Counter(), Counter(), Counter(), [0, 0]
            for text, y in zip(_texts(b.column(0)), b.column(1).to_pylist(), strict=True):
                n[y] += 1
                if not y:
                    clean.update({t for w in set(map(fold, set(text.split()))) if len(w) > 2 for t in spellings(w)})
                    continue
                words = [fold(w) for w in text.split()]
                if not words:
                    continue
                bits, met = {}, set()
                for before, w, after in zip(["", *words[:-1]], words, [*words[1:], ""], strict=True):
                    if len(w) > 2 and w not in met:
                        met.add(w)
                        bit = 1 << (zlib.crc32(f"{before} {after}".encode()) % 63)
                        for t in spellings(w):
                            bits.setdefault(t, bit)
                toxic.update(bits.keys())
                for t, bit in bits.items():
                    around[t] |= bit
            terms = list(toxic.keys() | clean.keys())
            yield pa.RecordBatch.from_arrays([pa.array([*terms, ""], pa.string()), pa.array([*(toxic[t] for t in terms), n[1]], pa.int64()), pa.array([*(clean[t] for t in terms), n[0]], pa.int64()), pa.array([*(around[t] for t in terms), 0], pa.int64())], names=["term", "t", "c", "around"])

    counted = rows.filter("not weigh").select("text", "y").mapInArrow(count, "term string, t long, c long, around long")
    sums = cut(counted.groupBy("term").agg(F.sum("t").alias("t"), F.sum("c").alias("c"), F.expr("bit_count(bit_or(around))").alias("contexts")))
    n = sums.filter("term = ''").first()
    if n is None or not n["t"]:
        return ToxicityModel(prior=prior)
    # the words of near copies have the same neighbours in all of them; so a term counts by its different neighbours
    seen = F.least(F.col("t").cast("double"), -63 * F.log(1 - F.least("contexts", F.lit(62)) / 63.0))
    odds = F.log((F.col("seen") + 0.5) / (n["t"] + 1.0)) - F.log((F.col("c") + 0.5) / (n["c"] + 1.0))
    varied = "seen >= 0.75 * t or contexts >= 48"
    chosen = sums.withColumn("seen", seen).filter(f"term <> '' and seen >= {least_documents} and ({varied})").withColumn("w", odds).filter(F.col("w") >= least_odds)
    terms = {r["term"]: r["w"] for r in chosen.orderBy(F.desc(F.col("w") * F.sqrt("t")), "term").limit(most_terms).collect()}
    def credit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: Counter = Counter()
            for text in _texts(b.column(0)):
                words = {tuple(t for t in spellings(w) if t in terms) for w in set(map(fold, set(text.split()))) if len(w) > 2} - {()}
                for t in {t for ts in words for t in ts}:
                    found[t] += 1 / len(words)
            yield pa.RecordBatch.from_arrays([pa.array(list(found.keys()), pa.string()), pa.array(list(found.values()), pa.float64())], names=["term", "n"])

    # the words of a copied document go along with dozens of others in each of its copies, a term with a few; at most most_terms rows
    alone = rows.filter("y = 1 and not weigh").select("text").mapInArrow(credit, "term string, n double").groupBy("term").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_documents / 8)
    kept = {r["term"] for r in alone.collect()}
    terms = {t: w for t, w in terms.items() if t in kept}
    draft = ToxicityModel(terms, prior=prior)

    def nearby(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = set()
            for weigh in (False, True):
                for _, words, _, _ in numbered_words(b.column(0).filter(pc.equal(b.column(1), weigh))):
                    found |= {(w, t, weigh) for w in {fold(words[k]) for k in draft.may_hit(words)} for t in draft.near(w)}
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.bool_()))], names=["word", "term", "weigh"])

    # words of the bounded sample that are near a term
    near = [tuple(r) for r in rows.filter("y = 0").select("text", "weigh").mapInArrow(nearby, "word string, term string, weigh boolean").distinct().collect()]

    def guarded_by(found: list[tuple[str, str]], weights: np.ndarray | None = None) -> ToxicityModel:
        crowd = Counter(t for _, t in set(found))
        return ToxicityModel(terms, frozenset(w for w, _ in found), frozenset(t for t, k in crowd.items() if k >= most_near), weights, prior)

    guarded, final = guarded_by([(w, t) for w, t, weigh in near if not weigh]), [(w, t) for w, t, _ in near]

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = guarded.features(b.column(0)), b.column(1).to_numpy()
            toxic = b.column(0).filter(pc.equal(b.column(1), 1))
            varied = [v for _, words, places in guarded.hits(toxic) if (v := guarded.variants(words, places))]
            more = [guarded.features(pa.array([v[k] for v in varied], pa.string())) for k in (0, 1)]
            xs = np.concatenate([x, *more]).tolist()
            ys = [*y.tolist(), *([1] * len(varied)), *([0] * len(varied))]
            ws = [*np.where(y == 1, 3.0, 1.0).tolist(), *([0.5] * 2 * len(varied))]
            yield pa.RecordBatch.from_arrays([pa.array(xs, pa.list_(pa.float64())), pa.array(ys, pa.int32()), pa.array(ws, pa.float64())], names=["x", "y", "w"])

    # a few numbers for each of the bounded sample's texts; equal ones are added up
    got = rows.filter("weigh").select("text", "y").mapInArrow(weigh, "x array<double>, y int, w double").groupBy("x", "y").agg(F.sum("w").alias("w")).collect()
    table = np.array(sorted((*r["x"], r["y"], r["w"]) for r in got))
    if len(table) == 0 or len(set(table[:, -2])) < 2:
        return guarded_by(final, np.array([-3.0, 1.0, 1.0, 0.5, 0.5, 0.0]))
    return guarded_by(final, _fit(table[:, :-2], table[:, -2], table[:, -1]))


def toxicity_scores(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted, exact, misspelled (different words that hit), quoted (hits) of each row of ``docs`` (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            x = own.features(b.column(1))
            hits = [pa.array(np.rint(np.expm1(x[:, k])).astype(np.int32)) for k in (2, 4, 5)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own.score(x)), *hits], names=["doc_id", "score", "exact", "misspelled", "quoted"])

    scored = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double, exact int, misspelled int, quoted int")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "exact", "misspelled", "quoted")


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The columns of ``op7``: doc_id, held_out, score, predicted and the hits."""
    return toxicity_scores(docs, learn(docs, labels))
