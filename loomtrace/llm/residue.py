"""Template residue, filler, error pages and script notices in place of content.

Labelled exemplars (see ``exemplars``; any table of texts and labels can take their place) are held in an inverted
index over their words. A text's passages are its JSON string values, its sentences and its lines. For every passage the
exemplars that share a heavy word with it are retrieved, and the TF-IDF containment is computed both ways: the share of
the passage's weight that exemplars cover, and the share of the exemplar's weight that is there. A passage that
residue exemplars cover highly, and more than content exemplars do, is residue; so is one that holds a window of an
exemplar's length for which that is so, unless the words around it only report what the window says. Weights
come from the word counts of all passages of the table.

What an unfilled template part looks like ({{name}}, <%= name %>, [insert name here], %name%, ____ and so on)
is a word of its own, as are the many spellings of "enable scripts" and numbers, so one exemplar stands for all.

Defined results: null and blank fields are no cases; JSON is judged by its string values, not its keys; a
field is a case if one of its steps, values, sentences or lines is; without residue exemplars nothing is.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtrace.llm.exemplars import BRACKET, DOTS, LABELLED, PART
from loomtrace.session import materialize

BUCKETS = 1 << 16
COVERAGE = 0.7  # least share of a passage that residue must cover
RECALL = 0.55  # least share of the exemplar that must be there
WINDOW = 0.8  # the same two shares of a window inside a longer passage
HALF = 0.5  # least share that one exemplar must cover where the words of others cover the rest
SHORT = 4  # words of an exemplar that may be found in such a window
RESIDUE = ("phrase", "bag", "part")  # labels of residue
MAX_EXEMPLARS = 100_000  # the index is held by every worker
SLOT = 4  # words that an open place of an exemplar may hold

_NAME = r"[A-Za-z_][A-Za-z0-9_]*(?:[ .\-][A-Za-z0-9_]+)*"
_TAGS = r"html|head|body|title|center|h[1-6]|p|b|i|u|em|strong|a|br|hr|div|span|script|noscript|style|ul|ol|li|table|tr|td|th|code|pre|img|input|form|button|meta|link"
_PART = re.compile(
    "|".join([
        r"\{\{\s*" + _NAME + r"\s*\}\}", r"\[\[\s*" + _NAME + r"\s*\]\]", r"\{%-?\s*" + _NAME + r"\s*-?%\}", r"<%[=\-]?\s*" + _NAME + r"\s*-?%>",
        r"[$#]\{\s*" + _NAME + r"\s*\}", r"%[A-Za-z_][A-Za-z0-9_]+%", r"@@" + _NAME + r"@@", r"<<\s*" + _NAME + r"\s*>>", r"«\s*" + _NAME + r"\s*»",
        r"&lt;\s*" + _NAME + r"\s*&gt;", r"\b__[A-Za-z][A-Za-z0-9_]*?__\b", r"_{3,}", r"\{\d+\}", r"%[sdif](?![A-Za-z])",
        r"\[(?:insert|enter|your|add|put)\b[^\]\n]*\]", r"\[[A-Z][A-Z0-9]*(?:[_ ][A-Z0-9]+)*\]",
        r"<(?!/?(?:" + _TAGS + r")\b)[a-z][a-z0-9]*(?:[_ \-][a-z0-9]+)*>", r"\((?:[a-z][a-z0-9_]*[ _])+to be (?:filled in|added|defined)\)",
    ])
)
_BRACKET = re.compile(r"\[[a-z][a-z ]*\]")
_TAG = re.compile(r"</?(?:" + _TAGS + r"|!--)[^>]*>", re.I)
_CJK = "\u3040-\u30ff\u3400-\u9fff"  # characters that are words of their own
_WORD = re.compile(rf"[{_CJK}]|[^\W_{_CJK}]+(?:['’][^\W_]+)?|[⌂⊏…]")
_SCRIPT = re.compile(r"(?<![A-Za-z0-9_])(?:client[- ]side |active )?(?:java ?script|js|scripts?|scripting)(?![A-Za-z0-9_])", re.I)
_ENABLE = re.compile(r"\b(?:enabled?|activated?|allow(?:ed)?|unblock(?:ed)?|(?:switch|turn)(?:ed)? on)\b", re.I)
_NUMBER = re.compile(r"(?=[^\W_]*\d)[^\W_]+")
_SENTENCES = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])|[\r\n]+")


_OPENS = frozenset("{[<%$#@«&_(")  # every unfilled part holds one of these
_MARKS_ONLY = re.compile(r"[.…\-_?*#=~\s]+")
_BLANK_LINE = re.compile(r"_{3,}")
_STEMS = ("enabl", "activat", "allow", "unblock", "switch", "turn")  # of every way to say enable
_NOT_AVAILABLE = re.compile(r"\bn/a\b")
_DIGIT = re.compile(r"\d")


def words_of(passage: str) -> list[str]:
    """The words of a passage: lower case, template parts, numbers and script phrases as one word each.

    Each substitution is tried only where a character or a part of a word that it needs is there.
    """
    s = passage.strip()
    if s and not s[0].isalnum() and _MARKS_ONLY.fullmatch(s) and not _BLANK_LINE.fullmatch(s):
        return [DOTS]
    if not _OPENS.isdisjoint(s):
        s = _PART.sub(f" {PART} ", s)
        if "[" in s:
            s = _BRACKET.sub(lambda m: f" {BRACKET} " if s.count("[") == 1 and len(s) == len(m[0]) else m[0], s)
        if "<" in s:
            s = _TAG.sub(" ", s)
    low = s.lower()
    if "script" in low or "js" in low:
        s = _SCRIPT.sub("js", s)
        low = s.lower()
    if any(map(low.__contains__, _STEMS)):
        low = _ENABLE.sub("enable", s).lower()
    if "/" in low:
        low = _NOT_AVAILABLE.sub("notavailable", low)
    words = _WORD.findall(low)
    return [_NUMBER.sub("0", w) for w in words] if _DIGIT.search(low) else words


class Index:
    """Inverted index over labelled exemplars with the weights of one corpus."""

    def __init__(self, counts: np.ndarray, total: int, exemplars: list[tuple[str, str]] = LABELLED):
        self.counts, self.total = counts, max(total, 1)
        self.known: dict[str, float] = {}
        self.entries: list[tuple[frozenset[str], float, bool, bool, str, int]] = []  # words, weight, lead, tail, label, length
        self.postings: dict[str, list[int]] = {}
        self.vocabulary: set[str] = set()  # of the residue phrases
        for text, label in exemplars:
            w = [text] if text in (DOTS, BRACKET, PART) else words_of(text.replace("_", " "))
            words = frozenset(w)
            if not words:
                continue
            if label == "phrase":
                self.vocabulary |= words
            e = (words, sum(map(self.weight, words)), text.startswith("_"), text.endswith("_"), label, len(w))
            # Posted under its heaviest words only: whoever holds RECALL of its weight holds one of them. A bag is posted under all.
            rest = e[1]
            for x in sorted(words, key=lambda x: (-self.weight(x), x)):
                self.postings.setdefault(x, []).append(len(self.entries))
                rest -= self.weight(x)
                if rest < RECALL * e[1] and label != "bag":
                    break
            self.entries.append(e)

    def weight(self, word: str) -> float:
        v = self.known.get(word)
        if v is None:
            n = int(self.counts[bucket(word)])
            v = self.known[word] = (0.1 if word == "0" else 1.0) * float(np.log((self.total + 1) / (n + 1)) + 0.1)
        return v

    def is_residue(self, words: list[str]) -> bool:
        """Whether residue exemplars cover the passage, or a window of it, highly and more than content exemplars do."""
        present = set(words)
        seen: set[int] = set()
        for w in present:
            seen.update(self.postings.get(w, ()))
        if not any(self.entries[i][4] in RESIDUE for i in seen):
            return False
        weights = [self.weight(w) for w in words]
        whole = sum(weights)
        residue = content = 0.0
        covered = [False] * len(words)
        lone = len(words) == 1
        windows: list[tuple[int, int]] = []
        frames: list[list[int]] = []
        for i in seen:
            ex, ex_weight, lead, tail, label, length = self.entries[i]
            on = [j for j, w in enumerate(words) if w in ex]
            if label == "bag":
                residue = max(residue, sum(weights[j] for j in on) / whole)
                continue
            held = sum(map(self.weight, ex & present))
            if label == "part":
                windows += [(j, j + 1) for j in on]
                continue
            if held < RECALL * ex_weight:
                continue
            if label == "frame":
                if held >= WINDOW * ex_weight:
                    frames.append(on)
                continue
            first, last = on[0], on[-1]
            mine = sum(weights[j] for j in on)
            free = sum(weights[max(0, first - SLOT) : first]) if lead else 0.0
            free += sum(weights[last + 1 : last + 1 + SLOT]) if tail else 0.0
            if label == "content":  # content exemplars have their places inside
                free += sum(weights[j] for j in range(first, last + 1) if words[j] not in ex)
                content = max(content, min(1.0, (mine + free) / whole) * min(1.0, held / ex_weight + 0.15 * (not lone)))
                continue
            residue = max(residue, min(1.0, (mine + free) / whole) * (1.0 if lone else min(1.0, held / ex_weight + 0.15)))
            if mine >= HALF * whole:
                # Most of the passage says what an exemplar says; the rest may be the words of others.
                residue = max(residue, sum(w for w, x in zip(weights, words, strict=True) if x in self.vocabulary) / whole - 0.2)
            if held >= WINDOW * ex_weight and (length > 1 or ex_weight >= WINDOW * whole):
                for j in on:
                    covered[j] = True
                if lead:
                    covered[max(0, first - SLOT) : first] = [True] * len(covered[max(0, first - SLOT) : first])
                if length >= SHORT:
                    windows += self.windows(words, weights, on, ex, ex_weight, length)
        residue = max(residue, sum(w for w, c in zip(weights, covered, strict=True) if c) / whole)
        if residue >= COVERAGE and residue > content:
            return True
        # A window is residue unless content covers the passage, or words outside a longer window report what it says.
        return any(
            content < 0.9 and (hi - lo == 1 or not any(any(not lo <= j < hi for j in on) for on in frames)) for lo, hi in windows
        )

    def windows(self, words: list[str], weights: list[float], on: list[int], ex: frozenset[str], ex_weight: float, length: int) -> list[tuple[int, int]]:
        """Runs of about the exemplar's length that it covers and that hold it."""
        out = []
        for lo in on:
            inside = [j for j in on if lo <= j < lo + length + SLOT]
            hi = inside[-1] + 1
            holds = sum(map(self.weight, {words[j] for j in inside}))
            if holds >= WINDOW * ex_weight and sum(weights[j] for j in inside) >= WINDOW * sum(weights[lo:hi]):
                out.append((lo, hi))
        return out

    def case(self, passages: list[list[str]]) -> bool:
        return any(map(self.is_residue, passages))


def bucket(word: str) -> int:
    """The bucket that xxhash64 of the engine gives: unsigned here, signed there, which is the same modulo a power of two."""
    import xxhash

    return xxhash.xxh64_intdigest(word, seed=42) % BUCKETS


def passages_of(text: str) -> list[str]:
    """A text, or the string values of a JSON text, also of one that is itself such a value."""
    out: list[str] = []
    todo: list = [text]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            s = x.strip()
            if s[:1] in ("{", "[") and s[-1:] in ("}", "]"):
                try:
                    todo.append(json.loads(s))
                    continue
                except (ValueError, RecursionError):
                    pass
            if s:
                out.append(s)
        elif isinstance(x, dict):
            todo += x.values()
        elif isinstance(x, list):
            todo += x
    return out


def field_texts(tests: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """(test_id, field_name, text): one row per step or value that is not null or blank."""
    kinds = dict(tests.dtypes)
    none = F.array().cast("array<struct<field_name:string,text:string>>")

    def entries(f: str):
        values = F.col(f) if kinds[f].startswith("array") else F.array(F.col(f))
        return F.coalesce(F.transform(values, lambda x: F.struct(F.lit(f).alias("field_name"), x.cast("string").alias("text"))), none)

    return (
        tests.select(F.col(id_col).alias("test_id"), F.explode(F.concat(*[entries(f) for f in fields])).alias("e"))
        .select("test_id", "e.field_name", "e.text").where("text is not null and trim(text) <> ''")
    )


def windows_of(text: str) -> list[list[str]]:
    """The words of each passage of a text and of each of its sentences and lines."""
    out: dict[str, None] = {}
    for p in passages_of(text):
        out.update(dict.fromkeys([p, *_SENTENCES.split(p)]))
    return [w for w in map(words_of, out) if w]


def labelled(exemplars: DataFrame | None) -> list[tuple[str, str]]:
    """The rows of a table of (text, label), at most ``MAX_EXEMPLARS``; without a table the default ones."""
    if exemplars is None:
        return LABELLED
    rows = exemplars.where("text is not null and label is not null").select("text", "label").distinct().limit(MAX_EXEMPLARS + 1).collect()
    if len(rows) > MAX_EXEMPLARS:
        raise ValueError(f"more than {MAX_EXEMPLARS} exemplars")
    return sorted((r["text"], r["label"]) for r in rows)


def residue_texts(texts: DataFrame, exemplars: DataFrame | None = None) -> DataFrame:
    """(text): the distinct texts that hold residue. Weights come from the word counts of all rows of ``texts``.

    Texts are cut into words once; the words are written and both read for the counts and judged.
    """
    spark = texts.sparkSession
    each = texts.groupBy("text").agg(F.count("*").alias("n"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = ["\n".join(map(" ".join, windows_of(t))) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(words, type=pa.string())], ["text", "n", "passages"])

    # Passages are lines of words: neither holds a blank or a line end.
    each = materialize(each.mapInArrow(cut, "text string, n long, passages string"), "passages").where("passages <> ''")
    lines = each.select("n", F.explode(F.split("passages", "\n")).alias("p"))
    words = lines.select("n", F.explode(F.array_distinct(F.split("p", " "))).alias("w")).groupBy(F.pmod(F.xxhash64("w"), F.lit(BUCKETS)).alias("b")).agg(F.sum("n").alias("n"))
    counts = np.zeros(BUCKETS, dtype=np.int64)
    for r in words.collect():  # bounded: one row per bucket
        counts[r["b"]] = r["n"]
    total = lines.agg(F.sum("n")).first()[0] or 0
    shared = spark.sparkContext.broadcast((counts, total, labelled(exemplars)))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(*shared.value)
        for b in batches:
            cases = [index.case([p.split(" ") for p in t.split("\n")]) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(cases, type=pa.bool_()))], ["text"])

    return each.select("text", "passages").mapInArrow(judge, "text string")


def residue_fields(tests: DataFrame, id_col: str = "test_id", fields: tuple[str, ...] = ("test_steps", "expected_result", "test_data"), exemplars: DataFrame | None = None) -> DataFrame:
    """p3_found: (test_id, field_name) of each field with residue in at least one step, value or sentence."""
    texts = field_texts(tests, id_col, list(fields))
    return texts.join(residue_texts(texts, exemplars), "text", "left_semi").select("test_id", "field_name").distinct()


def clean_tests(tests: DataFrame, id_col: str = "test_id", exemplars: DataFrame | None = None) -> DataFrame:
    """The rows of ``tests`` without residue in any field. Judged row by row: another version of a test may be clean."""
    fields = ["test_steps", "expected_result", "test_data"]
    texts = field_texts(tests, id_col, fields)
    bad = residue_texts(texts, exemplars)
    row = F.xxhash64(*[F.coalesce(F.to_json(F.struct(f), {"ignoreNullFields": "false"}), F.lit("")) for f in fields])
    keyed = tests.withColumn("__row", row)
    dirty = field_texts(keyed, "__row", fields).join(bad, "text", "left_semi").select(F.col("test_id").alias("__row")).distinct()
    return keyed.join(dirty, "__row", "left_anti").drop("__row")
