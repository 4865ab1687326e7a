"""Sizes of texts in tokens of a public byte-level BPE tokenizer.

The tokenizer's pattern never joins a character with white space after it, so a text falls into units (white
space and the run of other characters after it) whose token counts add up exactly. Units repeat, so their
counts are kept per worker and most of the work is one pass of a C loop over the text.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the vocabulary's published splitting pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# White space as the tokenizer sees it: unlike in this language the four separators 1c to 1f are none.
BLANKS, VISIBLE = r"[^\S\x1c-\x1f]", r"[\S\x1c-\x1f]"
UNIT, LEAD = re.compile(f"{BLANKS}*{VISIBLE}+"), re.compile(f"{BLANKS}*")
KEPT = 1 << 20  # units remembered per worker

_encodings: dict[str, object] = {}


def encoding(path: str = VOCABULARY):
    """The tokenizer, loaded once per Python process."""
    if path not in _encodings:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[path] = tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def units_of(text: str) -> list[str]:
    """The units of a text; white space at its end is one of its own."""
    units = UNIT.findall(text)
    rest = len(text) - sum(map(len, units))
    if rest:
        units.append(text[len(text) - rest :])
    return units


class UnitCounts(dict):
    """Token count of each unit, computed at first sight and bounded in number."""

    def __init__(self, path: str = VOCABULARY):
        super().__init__()
        self.encode = encoding(path).encode_ordinary

    def __missing__(self, unit: str) -> int:
        if len(self) >= KEPT:
            self.clear()
        n = len(self.encode(unit))
        if len(unit) < 64:
            self[unit] = n
        return n


_counts: dict[str, UnitCounts] = {}


def unit_counts(path: str = VOCABULARY) -> UnitCounts:
    if path not in _counts:
        _counts[path] = UnitCounts(path)
    return _counts[path]


def count_tokens(text: str | None, path: str = VOCABULARY) -> int:
    """Tokens of a text; 0 for null or empty."""
    return sum(map(unit_counts(path).__getitem__, units_of(text))) if text else 0


def with_token_counts(df: DataFrame, keep: list[str], text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """The columns ``keep`` and ``n_tokens``; unless it is among them the text goes no further than the worker."""
    fields = df.select(*keep).schema
    sent = keep.index(text) if text in keep else len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = pa.array([count_tokens(t.as_py(), path) for t in b.column(sent)], type=pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], n], [*keep, "n_tokens"])

    out = type(fields)([*fields.fields])
    return df.select(*keep, *([] if text in keep else [F.col(text).cast("string").alias("__text")])).mapInArrow(run, out.add("n_tokens", "long"))
