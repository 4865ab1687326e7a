"""Splitting oversized texts at natural boundaries, with overlap, by byte ranges.

A text is worked on in byte ranges of ``RANGE``. A range's worker finds the parts (see ``Units``) that lie between
its first and its last certain cut and leaves the fragments outside them, its halos, to its neighbours. What it hands
on is a boundary table of four bytes a part and none of the text. A text's tables are stitched in order as a stream:
the prefix sums run on from table to table, and only the parts of the piece that is open are held, so neither a text
nor its table is ever in one place. The result is pairs of byte offsets, and every range cuts its own share of the
pieces out by offset; a piece that reaches over several ranges is put together from their shares. Where a text's
first range is its last, that worker has all it needs and finishes the text: the same stitcher, without a shuffle.

A piece ends at the strongest boundary (blank line, line end, sentence end, then a blank between words) in the
later half of what fits, else at the last natural one that fits, else where the limit falls. The next piece
begins at the latest boundary that still repeats at least the given overlap, or, if the piece before is shorter
than that, all of it but its beginning. Token counts are exact: parts are cut where the tokenizer itself cuts, and a
run of a byte-pair encoding's tokens is the encoding of its own text. A certain cut is where white space follows
another character, or a letter a CJK sentence mark; a run without either is a fragment of its own, worked on by one
task.

Defined results, whatever the size of the ranges: texts within the limit, null and empty ones, and rows without an id
give no pieces; a repeated row repeats its pieces; the pieces of a text without their overlaps are the text, byte for
byte; an overlap of half the limit or more is reduced to that; a single character is never cut, even if it alone has
more tokens than the limit.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtrace.llm.sorted_groups import parallelism
from loomtrace.llm.tokens import BLANKS, LEAD, PATTERN, VISIBLE, VOCABULARY, encoding, units_of
from loomtrace.session import materialize

RANGE = 1 << 16
FINE = 8  # tokens of a part; units and words of more are cut inside
ROW_GROUP = 8 << 20  # bytes of a range table's row groups, so that one text's ranges are read by many tasks
NONE, WORD, SENTENCE, LINE, BLANK = range(5)
ENDS = 8  # bit of a part that ends a sentence, beside the strength of the boundary before it
PART = np.dtype([("bytes", "<u2"), ("tokens", "u1"), ("mark", "u1")])
_SENTENCE_END = re.compile(r"""[.!?…。！？；][)\]"'»”’）」』]*\s*$""")
_CJK_CUT = re.compile(r"(?<=[。！？；])(?=[^\W_])")
_CERTAIN = re.compile(f"(?<={VISIBLE})(?={BLANKS})" + r"|(?<=[。！？；])(?=[^\W_])")
_BLANK_LINE = re.compile(r"\n[^\S\n]*\n|\r\n?[^\S\r\n]*\r")


class Units(dict):
    """unit -> its parts, each as one number: bytes, tokens and mark in the places that PART gives them.

    A unit of at most ``fine`` tokens is one part. Others are cut at CJK sentence ends, between the tokenizer's own
    words, and inside words between tokens, where that is between characters; not before an apostrophe, which at the
    beginning of a text is encoded in another way.
    """

    def __init__(self, path: str, fine: int = FINE):
        super().__init__()
        import regex

        e = encoding(path)
        self.encode, self.bytes_of = e.encode_ordinary, e.decode_tokens_bytes
        self.words, self.fine = regex.compile(PATTERN), fine

    def inside(self, word: str, tokens: list[int]) -> Iterator[tuple[int, int]]:
        """(bytes, tokens) of the runs of at most ``fine`` tokens of a word."""
        raw, at = word.encode(), 0
        size = n = whole = whole_n = 0  # of the open run, and of that up to its last possible cut
        for b in self.bytes_of(tokens):
            size, n = size + len(b), n + 1
            end = at + size
            if end == len(raw) or (raw[end] & 0xC0 != 0x80 and raw[end] != 0x27):
                if n > self.fine and whole:
                    yield whole, whole_n
                    at, size, n = at + whole, size - whole, n - whole_n
                whole, whole_n = size, n
        yield size, n

    def __missing__(self, unit: str) -> tuple[int, ...]:
        if len(self) > 1 << 20:
            self.clear()
        lead = LEAD.match(unit)[0]
        # Without white space before it a unit begins a text, or follows a CJK sentence end.
        before = SENTENCE if not lead else NONE if lead == unit else BLANK if _BLANK_LINE.search(lead) else LINE if "\n" in lead or "\r" in lead else WORD
        out: list[tuple[int, int, int]] = []
        for i, part in enumerate(_CJK_CUT.split(unit)):
            ends = ENDS if _SENTENCE_END.search(part) else 0
            n = len(self.encode(part))
            strength = before if i == 0 else SENTENCE
            if n <= self.fine:
                out.append((len(part.encode()), n, strength | ends))
                continue
            runs: list[tuple[int, int]] = []
            for w in self.words.findall(part):
                t = self.encode(w)
                runs += self.inside(w, t) if len(t) > self.fine else [(len(w.encode()), len(t))]
            out += [(b, k, (strength if j == 0 else NONE) | ends * (j == len(runs) - 1)) for j, (b, k) in enumerate(runs)]
        kept = tuple(b | n << 16 | mark << 24 for b, n, mark in out)
        if len(unit) < 64:
            self[unit] = kept
        return kept


_known: dict[tuple[str, int], Units] = {}


def boundary_table(text: str, path: str = VOCABULARY, fine: int = FINE) -> np.ndarray:
    """The parts of a text as a PART array."""
    known = _known.get((path, fine)) or _known.setdefault((path, fine), Units(path, fine))
    return np.fromiter(itertools.chain.from_iterable(map(known.__getitem__, units_of(text))), dtype="<u4").view(PART)


def range_table(raw: bytes, first: bool, last: bool, path: str, fine: int = FINE) -> tuple[bytes, bytes, bytes, bool]:
    """(head, table, tail, has a certain cut) of one byte range; head and tail are the fragments before and after its certain cuts."""
    lead = 0
    while not first and lead < min(4, len(raw)) and raw[lead] & 0xC0 == 0x80:
        lead += 1
    text = raw[lead:].decode(errors="ignore")  # at most a cut character at the end is left out
    if first and last:
        return b"", boundary_table(text, path, fine).tobytes(), b"", True
    found = _CERTAIN.search(text)
    if not found:
        return raw, b"", b"", False
    start, end = 0 if first else found.start(), len(text)
    if not last:
        near = [m.start() for m in _CERTAIN.finditer(text, max(found.start(), len(text) - 1024))]
        end = near[-1] if near else [m.start() for m in _CERTAIN.finditer(text, found.start())][-1]
    head = raw[:lead] + text[:start].encode()
    middle = text[start:end]
    return head, boundary_table(middle, path, fine).tobytes(), raw[len(head) + len(middle.encode()) :], True


class Cutter:
    """The pieces of one text for one limit, from its parts as they come. Only the parts of the open piece are held."""

    def __init__(self, limit: int, overlap: int):
        self.limit, self.overlap = limit, min(overlap, limit // 2)
        self.no, self.ends, self.base = 0, False, 0  # base: bytes before the parts that are held
        self.size = self.tok = self.strength = np.zeros(0, dtype=np.int64)
        self.done = 0  # parts held that are in an earlier piece

    def add(self, t: np.ndarray, final: bool = False) -> Iterator[tuple[int, int, int, int, int]]:
        """(piece_no, start byte, end byte, tokens, overlap tokens) of every piece whose end is now certain."""
        if len(t):
            mark = t["mark"]
            strength = (mark & 7).astype(np.int64)
            # A sentence end counts as boundary before the next part where there is no line end.
            after = np.concatenate([[self.ends], mark[:-1] & ENDS > 0])
            strength[after & (strength == WORD)] = SENTENCE
            self.ends = bool(mark[-1] & ENDS)
            self.size = np.concatenate([self.size, t["bytes"]])
            self.tok = np.concatenate([self.tok, t["tokens"]])
            self.strength = np.concatenate([self.strength, strength])
        n = len(self.size)
        if not n or (self.no == 0 and int(self.tok.sum()) <= self.limit):
            return
        tok = np.concatenate([[0], np.cumsum(self.tok)])
        at = np.concatenate([[self.base], self.base + np.cumsum(self.size)])
        start, done = 0, self.done
        while done < n and (final or tok[n] - tok[start] > self.limit):
            end = int(np.searchsorted(tok, tok[start] + self.limit, side="right")) - 1
            if end <= done:  # what is repeated leaves no room
                start = done
                if not final and tok[n] - tok[start] <= self.limit:
                    break
                end = max(done + 1, int(np.searchsorted(tok, tok[start] + self.limit, side="right")) - 1)
            if end < n:
                half = max(done + 1, int(np.searchsorted(tok, tok[start] + self.limit / 2)))
                late = self.strength[half : end + 1]
                if len(late) and late.max() >= WORD:
                    end = half + len(late) - 1 - int(np.argmax(late[::-1] == late.max()))
                else:
                    natural = np.flatnonzero(self.strength[done + 1 : end + 1] >= WORD)
                    end = done + 1 + int(natural[-1]) if len(natural) else end
            yield self.no, int(at[start]), int(at[end]), int(tok[end] - tok[start]), int(tok[done] - tok[start])
            self.no += 1
            before, start, done = start, end, end
            if self.overlap and (done < n or not final):
                start = max(0, int(np.searchsorted(tok, tok[end] - self.overlap, side="right")) - 1)
                start = max(start, before + 1)
        self.base, self.done = int(at[start]), done - start
        self.size, self.tok, self.strength = self.size[start:], self.tok[start:], self.strength[start:]


class Stitcher:
    """Pieces of one text for all limits from the tables of its ranges, in order."""

    def __init__(self, caps: list[tuple[str, int, int]], path: str, fine: int):
        self.cutters = [(name, Cutter(limit, overlap)) for name, limit, overlap in caps]
        self.path, self.fine, self.pending = path, fine, []

    def add(self, head: bytes, table: bytes, tail: bytes, has_cut: bool, last: bool) -> Iterator[tuple]:
        self.pending.append(head)
        tables = []
        if has_cut or last:
            tables = [boundary_table(b"".join(self.pending).decode(), self.path, self.fine), np.frombuffer(table, dtype=PART)]
            self.pending = [tail]
            if last and tail:
                tables.append(boundary_table(tail.decode(), self.path, self.fine))
        t = np.concatenate(tables) if tables else np.zeros(0, dtype=PART)
        if len(t) or last:
            for name, c in self.cutters:
                for p in c.add(t, last):
                    yield (name, *p)


def split(df: DataFrame, limits: DataFrame, id_col: str = "doc_id", text: str = "text", path: str = VOCABULARY, range_bytes: int = RANGE) -> DataFrame:
    """(limit_name, id, piece_no, start_byte, end_byte, n_tokens, overlap_tokens, piece) for each limit.

    Limits below 1 are left out; where one is below ``2 * FINE`` all texts are cut token by token.
    """
    caps = sorted(
        (r["limit_name"], r["max_tokens"], r["overlap_tokens"] or 0)
        for r in limits.where("max_tokens > 0").select("limit_name", "max_tokens", "overlap_tokens").distinct().collect()
    )  # a fixed table of a few rows
    fine = 1 if min((c[1] for c in caps), default=FINE * 2) < 2 * FINE else FINE
    kind = dict(df.dtypes)[id_col]
    offsets = "piece_no int, start_byte long, end_byte long, n_tokens int, overlap_tokens int"
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    names = ["piece_no", "start_byte", "end_byte", "n_tokens", "overlap_tokens"]
    docs = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(text).cast("string").cast("binary").alias("__b")).where("octet_length(__b) > 0")

    def batch(rows: list[tuple], key: pa.DataType, rest: list[tuple[str, pa.DataType]] = ()) -> pa.RecordBatch:
        kinds = [pa.string(), key, *types, *[t for _, t in rest]]
        cols = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, kinds, strict=True)], ["limit_name", "__id", *names, *[n for n, _ in rest]])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts of one range."""
        for b in batches:
            rows: list[tuple] = []
            held = 0
            for i, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                data = raw.as_py()
                for name, *p in Stitcher(caps, path, fine).add(*range_table(data, True, True, path, fine), True):
                    rows.append((name, i, *p, data[p[1] : p[2]].decode()))
                    held += p[2] - p[1]
                if held > 1 << 24:
                    yield batch(rows, b.column(0).type, [("piece", pa.string())])
                    rows, held = [], 0
            yield batch(rows, b.column(0).type, [("piece", pa.string())])

    one = docs.where(F.octet_length("__b") <= range_bytes).mapInArrow(finish, f"limit_name string, __id {kind}, {offsets}, piece string")

    # Texts of several ranges, whose ranges are written once under a key of the row.
    last = F.floor((F.octet_length("__b") - 1) / range_bytes).cast("int")
    ranges = docs.where(F.octet_length("__b") > range_bytes).select(F.monotonically_increasing_id().alias("k"), "__id", "__b", last.alias("last"))
    ranges = ranges.select("k", "__id", "__b", "last", F.explode(F.sequence(F.lit(0), "last")).alias("no")).select(
        "k", "__id", "no", "last", F.expr(f"substring(__b, no * {range_bytes} + 1, {range_bytes})").alias("raw")
    )
    ranges = materialize(ranges, "ranges", **{"parquet.block.size": str(ROW_GROUP)})

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [range_table(r.as_py(), no == 0, no == end, path, fine) for no, end, r in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4), strict=True)]
            cols = list(zip(*done, strict=True)) if done else [[]] * 4
            kinds = [pa.binary(), pa.binary(), pa.binary(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], *[pa.array(c, type=t) for c, t in zip(cols, kinds, strict=True)]], ["k", "__id", "no", "last", "head", "tab", "tail", "has_cut"])

    def stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s: Stitcher | None = None
        for b in batches:
            rows: list[tuple] = []
            for k, i, no, end, *t in zip(*[b.column(j).to_pylist() for j in range(8)], strict=True):
                if no == 0:
                    s = Stitcher(caps, path, fine)
                rows += [(name, i, *p, k) for name, *p in s.add(*t, no == end)]
            yield batch(rows, b.column(1).type, [("k", pa.int64())])

    tabled = ranges.mapInArrow(tables, f"k long, __id {kind}, no int, last int, head binary, tab binary, tail binary, has_cut boolean")
    cuts = tabled.repartition(parallelism(df), "k").sortWithinPartitions("k", "no").mapInArrow(stitch, f"limit_name string, __id {kind}, {offsets}, k long")
    # Each range cuts out its share of every piece that reaches into it.
    shares = cuts.withColumn("no", F.explode(F.expr(f"sequence(cast(start_byte div {range_bytes} as int), cast((end_byte - 1) div {range_bytes} as int))")))
    here = f"greatest(start_byte - cast(no as long) * {range_bytes}, 0)"
    there = f"least(end_byte - cast(no as long) * {range_bytes}, {range_bytes})"
    shares = shares.join(ranges.select("k", "no", "raw"), ["k", "no"]).select(
        "limit_name", "k", "__id", *names, "no", F.expr(f"substring(raw, cast({here} as int) + 1, cast({there} - {here} as int))").alias("share")
    )
    joined = F.expr("cast(aggregate(array_sort(collect_list(struct(no, share))), cast('' as binary), (a, x) -> concat(a, x.share)) as string)")
    several = shares.groupBy("limit_name", "k", "__id", *names).agg(joined.alias("piece")).drop("k")
    return one.unionByName(several).select("limit_name", F.col("__id").alias(id_col), *names, "piece")


def summary(pieces: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(limit_name, n_texts, n_pieces, mean_tokens, max_tokens) per limit."""
    return pieces.groupBy("limit_name").agg(
        F.countDistinct(id_col).alias("n_texts"), F.count("*").alias("n_pieces"), F.avg("n_tokens").alias("mean_tokens"), F.max("n_tokens").alias("max_tokens")
    )
