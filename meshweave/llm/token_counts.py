"""Token counts of whole texts, by batch encoding that returns lengths only.

Texts are cut at safe boundaries: ASCII white space, where the tokenizer's own file says
that it drops white space before words are formed (``drops_space``) and no special string
holds any; then neither its normaliser nor its word pattern nor a special string reaches
across. Pieces met before in the same task are not encoded again; new ones go to the
library in batches balanced by bytes. With any other tokenizer whole texts are encoded, in
batches balanced by bytes.

Edge cases: a null text counts as empty (0 bytes, 0 tokens); repeated rows each
get their row; an empty table gives an empty result; other columns are not read.
A piece of over ``LONG_PIECE`` bytes is cut further between an ASCII digit and
an ASCII letter or digit (a digit is always a token's word of its own); without
such a place it is encoded whole.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LONG_PIECE = 1 << 16
BATCH_BYTES = 1 << 20
#: Pieces that a task remembers, and their longest; longer ones are encoded each time.
MEMO_ENTRIES, MEMO_LONGEST = 400_000, 64

_DIGIT = re.compile(rb"(?<=[0-9])(?=[0-9A-Za-z])")


def safe_pieces(piece: bytes) -> list[bytes]:
    """Cut one long piece at its safe boundaries, into parts of about ``LONG_PIECE``."""
    if len(piece) <= LONG_PIECE:
        return [piece]
    out, start = [], 0
    while len(piece) - start > LONG_PIECE:
        place = _DIGIT.search(piece, start + LONG_PIECE)
        if place is None:
            break
        out.append(piece[start : place.start()])
        start = place.start()
    return [*out, piece[start:]]


#: Word patterns that match no white space (fixed values).
SPACELESS = ("'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+",)
#: Normalisers that never reach across white space.
LOCAL = ("NFC", "Lowercase", "Replace")


def steps(part: dict | None, inner: str) -> list[dict]:
    """The steps of a tokenizer file's part, one or a sequence."""
    return [] if part is None else part[inner] if part["type"] == "Sequence" else [part]


def drops_space(spec: dict) -> bool:
    """Whether a tokenizer (its file, parsed) forms words within runs without ASCII white space only."""
    normal, words = steps(spec.get("normalizer"), "normalizers"), steps(spec.get("pre_tokenizer"), "pretokenizers")
    first = words[0] if words else {}
    plain = all(n["type"] in LOCAL and (n["type"] != "Replace" or n["pattern"] == {"Regex": "\\s+"}) for n in normal)
    only = first.get("type") == "Split" and first["behavior"] == "Removed" and first["invert"] and first["pattern"].get("Regex") in SPACELESS
    return plain and only and not any(re.search(r"\s", t["content"]) for t in spec["added_tokens"])


class Counter:
    """Counts tokens with a memo of pieces; one per task."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.cuts = drops_space(json.loads(self.tokenizer.to_str()))
        self.memo: dict[bytes, int] = {}

    def lengths(self, pieces: list[bytes]) -> Iterator[int]:
        """The number of tokens of each piece; pieces go to the library in batches balanced by bytes."""
        for group in common.slices(pieces, map(len, pieces), BATCH_BYTES):
            yield from (len(e) for e in self.tokenizer.encode_batch_fast([p.decode() for p in group], add_special_tokens=False))

    def learn(self, pieces: list[bytes]) -> dict[bytes, int]:
        """The tokens of new pieces; short ones are remembered."""
        cuts = [safe_pieces(p) for p in pieces]
        lengths = self.lengths([c for cut in cuts for c in cut])
        found = {piece: sum(next(lengths) for _ in cut) for piece, cut in zip(pieces, cuts)}
        self.memo.update((p, n) for p, n in found.items() if len(p) <= MEMO_LONGEST)
        return found

    def count(self, raw: bytes) -> int:
        """The tokens of one text, cut at white space."""
        total = 0
        for part in common.parts(raw):
            words = part.split()
            seen = set(words)
            new = seen.difference(self.memo)
            if len(self.memo) + len(new) > MEMO_ENTRIES:
                self.memo.clear()
                new = seen
            found = self.learn(sorted(new))
            total += sum(found[w] if w in found else self.memo[w] for w in words) if any(len(w) > MEMO_LONGEST for w in found) else sum(map(self.memo.__getitem__, words))
        return total

    def counts(self, raws: list[bytes]) -> list[int]:
        return [self.count(raw) for raw in raws] if self.cuts else list(self.lengths(raws))


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of each row, over its whole text."""
    common.bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(tokenizer)
        for batch in batches:
            raws = [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in batch.column(1)]
            counts = counter.counts(raws)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(map(len, raws), pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("raw"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
