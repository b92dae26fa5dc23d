"""BPE encoding and decoding with a pair occurrence index.

The distinct words of a piece of a partition lie one behind the other in one symbol array. An index maps each pair that has
a merge to all its positions there; the active ranks are applied in ascending order, each at all its positions from left
to right, and the lists of the pairs that a merge touches are updated. A merge makes a token that only later ranks use,
so the order of ranks is the order in which the words alone would be merged. Encoded words are kept for later pieces.

Defined results: a null text is empty, has no tokens and decodes to the empty text. The special tokens of the vocabulary
file are recognised in texts, as the tokenizers library does. Repeated rows return once each, null doc_ids as they are.
Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: White space as Unicode has it.
_WS = r"\t-\r \x85\xa0  -     　"
_SPLIT = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_WS}\p{{L}}\p{{N}}]+")
#: Words encoded together, words kept for later pieces, and the most bytes that a vocabulary file may have.
PIECE_WORDS, KEPT_WORDS, MOST_FILE_BYTES = 200_000, 400_000, 64 << 20
_loaded: dict[str, BpeCodec] = {}


def _byte_signs() -> list[str]:
    """The sign that stands for each byte: printable ones themselves, the others from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    signs, extra = [], 0
    for b in range(256):
        if b in plain:
            signs.append(chr(b))
        else:
            signs.append(chr(256 + extra))
            extra += 1
    return signs


class BpeCodec:
    """A word-end BPE vocabulary in the JSON format of the tokenizers library."""

    def __init__(self, content: str):
        spec = json.loads(content)
        model = spec["model"]
        vocab, self.suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in (vocab | self.special).items()}
        signs = _byte_signs()
        self.inner, self.last = [vocab.get(s, -1) for s in signs], [vocab.get(s + self.suffix, -1) for s in signs]
        self.ranks: dict[int, int] = {}
        self.merged: list[tuple[int, int, int]] = []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks.setdefault(vocab[a] << 20 | vocab[b], rank)
            self.merged.append((vocab[a], vocab[b], vocab[a + b]))
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.marks = sorted({t[:2] for t in self.special})
        self.ids: dict[str, bytes] = {}
        self.texts: dict[str, str] = {}
        self._fixed()

    def _fixed(self) -> None:
        for text, i in self.special.items():
            self.ids[f" {text}"], self.texts[f" {text}"] = np.array([i], "<u4").tobytes(), text

    def words(self, text: str) -> list[str]:
        """The pre-tokens of a text; a special token has a space before it, which no other word has."""
        if self.cut is None or not any(m in text for m in self.marks):
            return self._plain(text)
        out: list[str] = []
        for part in self.cut.split(text):
            if part in self.special:
                out.append(f" {part}")
            elif part:
                out += self._plain(part)
        return out

    @staticmethod
    def _plain(text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:  # the library lowers each sign alone, without final forms
                text = "".join(map(str.lower, text))
        return _SPLIT.findall(text.lower())

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """The ids of each of ``words``, by a pair occurrence index over all of them."""
        sym: list[int] = []
        starts: list[int] = []
        for w in words:
            starts.append(len(sym))
            raw = w.encode()
            sym += [self.inner[b] for b in raw]
            sym[-1] = self.last[raw[-1]]
            sym.append(-2)
        n = len(sym)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        ranks, merged = self.ranks, self.merged
        index: dict[int, list[int]] = {}
        left = -2
        for p, right in enumerate(sym):
            if left >= 0 and right >= 0 and (r := ranks.get(left << 20 | right)) is not None:
                if r in index:
                    index[r].append(p - 1)
                else:
                    index[r] = [p - 1]
            left = right
        active = list(index)
        heapq.heapify(active)
        while active:
            rank = heapq.heappop(active)
            a, b, new = merged[rank]
            at = index.pop(rank)
            at.sort()
            for p in at:
                if sym[p] != a:
                    continue
                q = nxt[p]
                if q >= n or sym[q] != b:
                    continue
                sym[p], sym[q] = new, -1
                after = nxt[q]
                nxt[p] = after
                prv[after] = p
                before = prv[p]
                if before >= 0 and sym[before] >= 0 and (r := ranks.get(sym[before] << 20 | new)) is not None:
                    if r in index:
                        index[r].append(before)
                    else:
                        index[r] = [before]
                        heapq.heappush(active, r)
                if sym[after] >= 0 and (r := ranks.get(new << 20 | sym[after])) is not None:
                    if r in index:
                        index[r].append(p)
                    else:
                        index[r] = [p]
                        heapq.heappush(active, r)
        out = []
        for p in starts:
            ids = []
            while sym[p] != -2:
                if sym[p] >= 0:
                    ids.append(sym[p])
                p = nxt[p]
            out.append(ids)
        return out

    def learn(self, words: set[str]) -> None:
        """Encodes those of ``words`` that aren't known yet."""
        if len(self.ids) > KEPT_WORDS:
            self.ids.clear()
            self.texts.clear()
            self._fixed()
        new = [w for w in words if w not in self.ids]
        for w, ids in zip(new, self.encode_words(new), strict=True):
            self.ids[w], self.texts[w] = np.array(ids, "<u4").tobytes(), " ".join([self.tokens[i] for i in ids])

    def decode(self, ids) -> str:
        return " ".join([self.tokens[i] for i in ids if i in self.tokens])


def _codec(content: str) -> BpeCodec:
    key = hashlib.sha256(content.encode()).hexdigest()
    if key not in _loaded:
        _loaded[key] = BpeCodec(content)
    return _loaded[key]


def _shared(spark, path: str):
    with open(path, encoding="utf-8") as f:
        content = f.read(MOST_FILE_BYTES + 1)
    if len(content) > MOST_FILE_BYTES:
        raise ValueError(f"{path} is larger than {MOST_FILE_BYTES} bytes")
    return spark.sparkContext.broadcast(content)


def _pieces(codec: BpeCodec, texts: pa.Array) -> Iterator[list[list[str]]]:
    piece, held = [], 0
    for t in texts:
        words = codec.words(t.as_py() or "")
        piece.append(words)
        held += len(words)
        if held >= PIECE_WORDS:
            yield piece
            piece, held = [], 0
    if piece:
        yield piece


def bpe_round_trip(docs: DataFrame, vocabulary: str, digests: bool = False) -> DataFrame:
    """doc_id, ids (array of int), decoded of each row of ``docs`` (doc_id, text); ``vocabulary`` is a file's path.

    With ``digests``: doc_id, n_tokens, ids_sha256 (ids as little-endian 32 bits), decoded_sha256.
    """
    shared = _shared(docs.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for b in batches:
            at = 0
            for piece in _pieces(codec, b.column(1)):
                codec.learn({w for words in piece for w in words})
                ids = [b"".join([codec.ids[w] for w in words]) for words in piece]
                texts = [" ".join([t for w in words if (t := codec.texts[w])]) for words in piece]
                own = b.column(0).slice(at, len(piece))
                at += len(piece)
                if digests:
                    columns = [own, pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(map(sha, ids), pa.string()), pa.array([sha(t.encode()) for t in texts], pa.string())]
                    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                else:
                    columns = [own, pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in ids], pa.list_(pa.int32())), pa.array(texts, pa.string())]
                    names = ["doc_id", "ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "doc_id long, ids array<int>, decoded string"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def decode_ids(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, text of ``encoded`` (doc_id, ids): the tokens joined by spaces, as the vocabulary has no decoder of its own."""
    shared = _shared(encoded.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([codec.decode(x.as_py() or []) for x in b.column(1)], pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<long>")).mapInArrow(run, "doc_id long, text string")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """The columns of ``op4``: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return bpe_round_trip(docs, vocabulary or default_vocabulary(), digests=True)
