"""Byte-pair encoding and decoding with forced boundaries.

A merge can only ever join two neighbouring bytes that stand side by side inside some token of the
vocabulary. A pair of bytes which no token holds is therefore a certain cut: no merge crosses it. A text is
cut at the pre-tokeniser's boundaries and at these pairs, the fragments are encoded independently (and
remembered, as most of them recur), and their ids are concatenated. The result is the ids that encoding the
whole text gives.

Cases: a null text counts as empty; an empty text has 0 tokens and decodes to ''; repeated rows each get their
own result; a table without rows gives a table without rows. Texts are read whole, of any length: long
fragments are merged with a heap, in n log n steps.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inquest.llm.common import ship, slices

#: The byte-level pre-tokeniser's pattern.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?(?:\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+)|\s+(?!\S)|\s+"
#: Below these code points all Unicode versions agree about letters, numbers and white space.
_LATIN_END, _AGREED_END = 0x250, 0x500


def _latin_pattern() -> re.Pattern:
    """PATTERN for texts below U+0250, in the standard library's faster engine."""

    def members(what: str) -> str:
        return "".join(re.escape(chr(c)) for c in range(_LATIN_END) if regex.match(what, chr(c)))

    letters, numbers, white = members(r"\p{L}"), members(r"\p{N}"), members(r"\s")
    return re.compile(f"'(?:[sdmt]|ll|ve|re)| ?(?:[{letters}]+|[{numbers}]+|[^{white}{letters}{numbers}]+)|[{white}]+(?![^{white}])|[{white}]+")


def _byte_letters() -> dict[str, int]:
    """The printable stand-in for each byte in a byte-level vocabulary file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class _Pieces(dict):
    """Packed ids of the pieces met lately: two generations of at most ``bound`` each."""

    def __init__(self, encode, bound: int) -> None:
        super().__init__()
        self.encode, self.bound, self.old = encode, bound, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = self.encode(piece.encode("utf-8", "replace"))
            if len(piece) > 64:
                return ids
        if len(self) >= self.bound:
            self.old = dict(self)
            self.clear()
        self[piece] = ids
        return ids


class ForcedBoundaryBpe:
    """Encoder and decoder for a byte-level BPE vocabulary file of the tokenizers library."""

    def __init__(self, path: str, remembered: int = 300_000) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kind, before = spec["model"], spec["pre_tokenizer"]
        if kind["type"] != "BPE" or before["type"] != "ByteLevel" or before["add_prefix_space"] or spec["normalizer"]:
            raise ValueError("only byte-level BPE without normalizer and prefix space is supported")
        letters = _byte_letters()
        vocab = {bytes(letters[c] for c in token): i for token, i in kind["vocab"].items()}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that strip or bind to words are not supported")
        self.tokens: list[bytes] = [b""] * (1 + max([*vocab.values(), *special.values()]))
        for token, i in [*vocab.items(), *((s.encode(), i) for s, i in special.items())]:
            self.tokens[i] = token
        self.first = [vocab.get(bytes([b]), -1) for b in range(256)]
        #: rank of the merge of two ids, and the id that each rank makes
        self.ranks: dict[int, int] = {}
        self.made: list[int] = []
        unpacked = (m if isinstance(m, list) else m.split(" ") for m in kind["merges"])
        for rank, (a, b) in enumerate(unpacked):
            left, right = bytes(letters[c] for c in a), bytes(letters[c] for c in b)
            self.ranks[vocab[left] << 32 | vocab[right]] = rank
            self.made.append(vocab[left + right])
        #: inside[a << 8 | b]: some token holds byte a followed by byte b.
        self.inside = bytearray(1 << 16)
        for token in vocab:
            for a, b in zip(token, token[1:], strict=False):
                self.inside[a << 8 | b] = 1
        self._inside = np.frombuffer(self.inside, np.uint8)
        self.special = special
        self._split = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self._latin, self._wide = _latin_pattern(), regex.compile(PATTERN)
        self._not_latin, self._not_agreed = re.compile(f"[^\x00-{chr(_LATIN_END - 1)}]"), re.compile(f"[^\x00-{chr(_AGREED_END - 1)}]")
        self._pieces = _Pieces(self._encode_piece, remembered)
        self._path, self._library = path, None

    def fragments(self, piece: bytes) -> list[bytes]:
        """Cut where no token holds the two bytes side by side."""
        if len(piece) < 2:
            return [piece] if piece else []
        if len(piece) > 256:
            raw = np.frombuffer(piece, np.uint8).astype(np.uint16)
            cuts = (np.flatnonzero(self._inside[raw[:-1] << 8 | raw[1:]] == 0) + 1).tolist()
        else:
            inside = self.inside
            cuts = [i for i in range(1, len(piece)) if not inside[piece[i - 1] << 8 | piece[i]]]
        return [piece[a:b] for a, b in zip([0, *cuts], [*cuts, len(piece)], strict=True)]

    def _encode_piece(self, piece: bytes) -> bytes:
        ids: list[int] = []
        for fragment in self.fragments(piece):
            ids += self._merge(fragment) if len(fragment) <= 48 else self._merge_long(fragment)
        return np.array(ids, "<u4").tobytes()

    def _merge(self, fragment: bytes) -> list[int]:
        """Merge the pair of least rank, the first of them, until none is left."""
        ids, rank_of, none = [self.first[b] for b in fragment], self.ranks.get, len(self.made)
        ranks = [rank_of(a << 32 | b, none) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks and (least := min(ranks)) < none:
            i = ranks.index(least)
            ids[i] = new = self.made[least]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank_of(ids[i - 1] << 32 | new, none)
            if i < len(ranks):
                ranks[i] = rank_of(new << 32 | ids[i + 1], none)
        return ids

    def _merge_long(self, fragment: bytes) -> list[int]:
        """The same with a heap of candidate merges over a linked list."""
        rank_of, n = self.ranks.get, len(fragment)
        ids: list[int] = [self.first[b] for b in fragment]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank_of(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = new, _ = self.made[rank], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank_of(new << 32 | ids[k])) is not None:
                    heapq.heappush(heap, (r, i, new, ids[k]))
            if (h := before[i]) >= 0 and (r := rank_of(ids[h] << 32 | new)) is not None:
                heapq.heappush(heap, (r, h, ids[h], new))
        return [i for i in ids if i >= 0]

    def _cut(self, text: str) -> list[str]:
        if not self._not_latin.search(text):
            return self._latin.findall(text)
        if not self._not_agreed.search(text):
            return self._wide.findall(text)
        if self._library is None:  # newer letters: the library's own tables decide
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self._path).pre_tokenizer
        return [text[a:b] for _, (a, b) in self._library.pre_tokenize_str(text)]

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        pieces = self._pieces
        if self._split is None or not self._split.search(text):
            return b"".join(map(pieces.__getitem__, self._cut(text)))
        return b"".join(np.array([self.special[part]], "<u4").tobytes() if part in self.special else b"".join(map(pieces.__getitem__, self._cut(part))) for part in self._split.split(text) if part)

    def decode(self, ids: bytes) -> str:
        """Bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_LOADED: dict[str, ForcedBoundaryBpe] = {}


def loaded(path: str) -> ForcedBoundaryBpe:
    """One encoder for each worker and vocabulary."""
    if path not in _LOADED:
        _LOADED[path] = ForcedBoundaryBpe(path)
    return _LOADED[path]


def _mapped(df: DataFrame, text: str, outputs: dict[str, tuple[str, pa.DataType]], rows) -> DataFrame:
    """Add columns that ``rows(values)`` makes for each piece of a batch; columns of those names are replaced."""
    ship(df.sparkSession)
    rest = [c for c in df.columns if c.lower() not in {o.lower() for o in outputs}]
    # the worker addresses columns by place, so odd or clashing names do no harm
    place, given = len(rest), df.select(*(F.col(f"`{c}`") for c in rest), F.col(f"`{text}`").alias("__inquest_text"))
    schema = ", ".join([*(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in given.schema.fields[:place]), *(f"`{name}` {kind}" for name, (kind, _) in outputs.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__inquest_text"):
            made = rows(batch.column(place).to_pylist())
            arrays = [*batch.columns[:place], *(pa.array(values, kind) for values, (_, kind) in zip(made, outputs.values(), strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names[:place], *outputs])

    return given.mapInArrow(run, schema)


def encode(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """df with ``n_tokens`` (long) and ``token_ids`` (binary, little-endian unsigned 32-bit)."""

    def rows(texts: list) -> tuple[list, ...]:
        ids = [loaded(path).encode(t) for t in texts]
        return [len(x) // 4 for x in ids], ids

    return _mapped(df, text, {"n_tokens": ("bigint", pa.int64()), "token_ids": ("binary", pa.binary())}, rows)


def decode(df: DataFrame, path: str, ids: str = "token_ids") -> DataFrame:
    """df with ``decoded`` (string), the text of the ids; null ids give ''."""
    return _mapped(df, ids, {"decoded": ("string", pa.string())}, lambda values: ([loaded(path).decode(v or b"") for v in values],))


def round_trip(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """encode() and decode() in one pass over the texts."""

    def rows(texts: list) -> tuple[list, ...]:
        bpe = loaded(path)
        ids = [bpe.encode(t) for t in texts]
        return [len(x) // 4 for x in ids], ids, [bpe.decode(x) for x in ids]

    return _mapped(df, text, {"n_tokens": ("bigint", pa.int64()), "token_ids": ("binary", pa.binary()), "decoded": ("string", pa.string())}, rows)


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    both = round_trip(docs.select("doc_id", "text"), path)
    return both.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
