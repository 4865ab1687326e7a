"""Text functions as Column expressions: everything stays in the JVM and in whole-stage code generation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomtrace.functions import rules as R

Col = Column | str


def col(c: Col) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_text(c: Col) -> Column:
    """Dashes to '-', odd blanks to a blank, three or more blanks to two, blanks trimmed; line ends stay."""
    s = F.regexp_replace(col(c), "[‐-—]", "-")
    s = F.regexp_replace(s, r"[\p{Zs}\t​]", " ")
    return F.trim(F.regexp_replace(s, " {3,}", "  "))


def squeeze(c: Col) -> Column:
    """All white space runs to one blank, trimmed; null to ''."""
    return F.trim(F.regexp_replace(F.coalesce(col(c), F.lit("")), r"[\s ​]+", " "))


def norm_title(c: Col) -> Column:
    return F.regexp_replace(F.lower(col(c)), "[^a-z0-9 ]", "")


def section_level(c: Col) -> Column:
    return F.size(F.split(col(c), r"\."))


def parent_path(c: Col) -> Column:
    """The path one level up, null at the top."""
    return F.when(col(c).contains("."), F.regexp_replace(col(c), r"\.[^.]+$", ""))


def ancestors(c: Col) -> Column:
    """All proper ancestors of a dotted path, so that prefix joins become equi-joins."""
    parts = F.split(col(c), r"\.")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))).otherwise(
        F.array().cast("array<string>")
    )


def first_match(cases: list[tuple[Column, object]], otherwise: object = None) -> Column:
    """The value of the first condition that holds."""
    out = F.lit(otherwise) if not isinstance(otherwise, Column) else otherwise
    for cond, value in reversed(cases):
        out = F.when(cond, F.lit(value) if not isinstance(value, Column) else value).otherwise(out)
    return out


def section_type(path: Col, title: Col) -> Column:
    """Section type of a path and a title by the first rule that fits; else the type of the nearest typed ancestor path."""
    p, t = col(path), F.lower(F.coalesce(col(title), F.lit("")))
    own = first_match([((p if where == "path" else t).rlike(pattern), kind) for where, pattern, kind in R.SECTION_TYPES])
    # An ancestor path has no title, so only the path rules can type it; they all begin with the top number.
    by_path = first_match([(p.rlike(pattern), kind) for where, pattern, kind in R.SECTION_TYPES if where == "path"])
    return F.when(p == "PREAMBLE", "toc").otherwise(F.coalesce(own, by_path, F.lit("other")))


def structural_role(c: Col) -> Column:
    """Role of a block by its first word: requirement label, planguage keyword, scenario step or prose."""
    t = col(c)
    labels = [(t.rlike(f"(?i)^{k}\\s*:" + ("\\s*\\S+" if k == "ID" else "")), R.LABEL_ROLES[k]) for k in R.LABELS]
    return first_match(
        [*labels, (t.rlike(f"(?i)^({'|'.join(R.PLANGUAGE)})\\s*:"), "planguage_keyword"), (t.rlike(f"(?i)^({'|'.join(R.GHERKIN)})\\s*[:\\s]"), "gherkin_keyword")], "prose_content"
    )


def sentences(c: Col) -> Column:
    """Sentences of a text: cut after . ! or ? where white space follows; no look-behind, so SQL engines agree."""
    marked = F.regexp_replace(F.trim(col(c)), r"([.!?])\s+", "$1\u0001")
    return F.filter(F.split(marked, "\u0001"), lambda s: s != "")


def modal_sentences(c: Col) -> Column:
    """Sentences with shall, must, will, should or may; the whole text if there is none."""
    hit = F.filter(sentences(c), lambda s: F.lower(s).rlike(r"\b(shall|must|will|should|may)\b"))
    return F.when(F.size(hit) > 0, hit).otherwise(F.array(col(c)))


def roles(c: Col) -> Column:
    """Roles of a paragraph in fixed order; narrative if it has none."""
    t = F.lower(col(c))
    found = F.array_compact(F.array(
        F.when(t.rlike(R.MODALS) & t.rlike(R.BEHAVIOUR), "behaviour"), F.when(t.rlike(R.INPUTS), "input"),
        F.when(t.rlike(R.OUTPUTS), "output"), F.when(t.rlike(R.CONSTRAINTS), "constraint"),
    ))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("narrative")))


def stem(c: Col) -> Column:
    """Suffix stemmer: the first rule whose result is long enough. One nested expression, no function call per row."""
    w = col(c)
    return first_match([
        (w.endswith(s) & (F.length(w) - len(s) + len(r) >= n), F.concat(F.substring(w, F.lit(1), F.length(w) - len(s)), F.lit(r))) for s, r, n in R.SUFFIXES
    ], w)


def words(c: Col) -> Column:
    """Distinct words of a-z, without stop words and single letters."""
    stop = F.array(*[F.lit(w) for w in R.STOPWORDS])
    w = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(col(c), F.lit(""))), F.lit("[a-z]+"), F.lit(0)))
    return F.filter(w, lambda x: (F.length(x) > 1) & ~F.array_contains(stop, x))


def negated(c: Col) -> Column:
    return F.lower(F.coalesce(col(c), F.lit(""))).rlike("|".join(f"({p})" for p in R.NEGATIONS))


def verdict(ratio: Column, negation: Column, empty: Column) -> Column:
    return first_match([
        (empty, "MISSING"), (negation & (ratio >= R.PARTIAL), "CONFLICT"), (ratio >= R.MATCH, "MATCH"), (ratio >= R.PARTIAL, "PARTIAL"),
    ], "MISSING")


def clause(actor: Col, action: Col, constraint: Col) -> Column:
    """Actor and action, with the constraint unless the action holds it already."""
    base = F.trim(F.concat_ws(" ", col(actor), col(action)))
    k = F.coalesce(col(constraint), F.lit(""))
    return F.when((k != "") & ~base.contains(k), F.concat_ws(" ", base, k)).otherwise(base)


def confidence_value(c: Col) -> Column:
    """high, medium, low as numbers; other words and null have values of their own."""
    w = F.lower(F.trim(col(c)))
    return F.when(w.isNull() | (w == ""), R.CONFIDENCE_NULL).otherwise(first_match([(w == k, v) for k, v in R.CONFIDENCE.items()], R.CONFIDENCE_OTHER))


def clamp(c: Col, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.least(F.greatest(col(c), F.lit(lo)), F.lit(hi))


def status(c: Col) -> Column:
    """Test status by what the text holds, in a fixed order."""
    s = F.upper(F.trim(F.coalesce(col(c), F.lit(""))))
    return first_match([
        (s.rlike("NOT[ _-]?TESTED"), "NOT_TESTED"), (s.contains("PARTIAL"), "PARTIAL"), (s.contains("FAIL"), "FAIL"), (s.contains("PASS"), "PASS"),
    ], "UNKNOWN")


def any_of(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, cols)


def parent_chunk_id(doc_id: Col, section: Col) -> Column:
    return F.concat(F.lit("P_"), F.sha2(F.concat(F.coalesce(col(doc_id), F.lit("")), F.coalesce(col(section), F.lit(""))), 256))


def child_chunk_id(doc_id: Col, section: Col, cru_id: Col, text: Col) -> Column:
    parts = [F.coalesce(col(c), F.lit("")) for c in (doc_id, section, cru_id)]
    return F.concat(F.lit("CH_"), F.sha2(F.concat(*parts, F.lower(F.trim(F.coalesce(col(text), F.lit(""))))), 256))


def roman_value(c: Col) -> Column:
    """1 to 10 of a roman numeral in the letters I, V and X, lax forms included; null for anything else.

    Each letter counts minus its value if the letter after it is greater.
    """
    s = F.upper(F.trim(col(c)))
    v = lambda x: F.when(x == "I", 1).when(x == "V", 5).when(x == "X", 10)
    letters = F.filter(F.split(s, ""), lambda x: x != "")
    values = F.transform(letters, v)
    after = F.transform(letters, lambda x, i: F.coalesce(F.try_element_at(values, i + 2), F.lit(0)))
    total = F.aggregate(F.zip_with(values, after, lambda a, b: F.when(a < b, -a).otherwise(a)), F.lit(0), lambda x, y: x + y)
    return F.when(s.rlike("^[IVX]+$") & total.between(1, 10), total)


def section_path(c: Col) -> Column:
    """Numbers as they are; roman numerals and single letters as A.n; anything else unchanged, null as ''."""
    s = F.trim(col(c))
    n = roman_value(col(c))
    letter = F.ascii(F.upper(s)) - 64
    return first_match([
        (col(c).isNull(), F.lit("")), (s.rlike(r"^\d+(\.\d+)*$"), s), (n.isNotNull(), F.concat(F.lit("A."), n.cast("string"))),
        (s.rlike("^[A-Za-z]$"), F.concat(F.lit("A."), letter.cast("string"))),
    ], col(c))


def input_format(roles: Col) -> Column:
    """Format of a requirement from the set of its blocks' roles: labeled before gherkin before planguage before prose."""
    has = lambda x: F.array_contains(roles, x)
    rest = F.filter(roles, lambda x: ~x.isin("section_heading", "req_id_label", "prose_content", "table_block"))
    return first_match([
        (has("req_id_label") & has("req_desc_label"), "labeled"), (has("req_id_label") & has("gherkin_keyword"), "gherkin"),
        (has("req_id_label") & (F.size(rest) > 0) & F.forall(rest, lambda x: x.startswith("planguage_")), "planguage"),
    ], "prose")


def actor(c: Col) -> Column:
    t = F.lower(F.coalesce(col(c), F.lit("")))
    return first_match([(t.contains(w), label) for w, label in R.ACTORS], R.ACTOR_OTHER)


def tag_parts(c: Col) -> Column:
    """A tag's first word as id and the rest as title; without a rest the title is the id."""
    t = F.trim(F.regexp_replace(F.coalesce(col(c), F.lit("")), r"\s+", " "))
    rest = F.trim(F.regexp_replace(t, r"^\S+", ""))
    first = F.regexp_extract(t, r"^(\S+)", 1)
    return F.struct(first.alias("id"), F.when(rest == "", first).otherwise(rest).alias("title"))


def provenance_confidence(method: Col, has_nulls: Column) -> Column:
    known = F.coalesce(col(method).isin("deterministic", "llm", "llm_structured"), F.lit(False))
    return first_match([(known & ~has_nulls, "high"), (known & has_nulls, "medium")], "low")


def method_confidence(method: Col) -> Column:
    return first_match([(col(method) == k, v) for k, v in R.METHOD_CONFIDENCE.items()], "low")


def unit_type(kind: Col, title: Col, description: Col) -> Column:
    t = F.lower(F.concat_ws(" ", F.coalesce(col(title), F.lit("")), F.coalesce(col(description), F.lit(""))))
    quality = first_match([(t.contains(w), k) for w, k in R.QUALITY_TYPES], R.QUALITY_TYPE_OTHER)
    return first_match([*[(col(kind) == k, v) for k, v in R.UNIT_TYPES.items()], (col(kind) == "quality_attributes", quality)], R.UNIT_TYPE_OTHER)


def path_kind(c: Col) -> Column:
    p = F.lower(F.coalesce(col(c), F.lit("")))
    return first_match([(p.rlike(w), k) for w, k in R.PATH_KINDS], R.PATH_KIND_OTHER)


def heading(c: Col) -> Column:
    """(level, method) of a line that may be a heading: numeric, all capitals or title case; level null if it is none."""
    t = F.trim(col(c))
    none = F.lit(None).cast("int")
    numeric = t.rlike(R.HEADING_NUMBER)
    depth = F.least(F.size(F.split(F.regexp_extract(t, R.HEADING_NUMBER, 1), r"\.")), F.lit(R.HEADING_DEPTH))
    kind = first_match([
        ((t == "") | (F.length(t) > R.HEADING_LONGEST["any"]), "none"), (numeric & t.rlike(R.HEADING_LISTED), "list_item"), (numeric & (F.length(t) > R.HEADING_LONGEST["numeric"]), "too_long"), (numeric, "numeric"),
        (t.rlike(R.HEADING_CAPITALS), "allcaps"), (t.endswith(":"), "label"),
        (t.rlike(R.HEADING_TITLE) & (F.length(t) <= R.HEADING_LONGEST["titlecase"]) & t.rlike(r"\S\s+\S"), "titlecase"),
    ], "none")
    level = F.when(kind == "numeric", depth).when(kind == "allcaps", 1).when(kind == "titlecase", 2).otherwise(none)
    return F.struct(level.alias("level"), kind.alias("method"))


def short_title(c: Col, max_words: int = 12) -> Column:
    """The first sentence or the first line, whichever is shorter, cut to ``max_words`` words."""
    t = F.trim(col(c))
    sentence, line = F.coalesce(F.try_element_at(sentences(t), F.lit(1)), F.lit("")), F.substring_index(t, "\n", 1)
    best = F.when(F.length(sentence) <= F.length(line), sentence).otherwise(line)
    w = F.filter(F.split(best, r"\s+"), lambda x: x != "")
    return F.when(F.size(w) <= max_words, F.trim(best)).otherwise(F.concat(F.array_join(F.slice(w, 1, max_words), " "), F.lit("...")))


def skip_block(section: Col, kind: Col, role: Col, text: Col, low_confidence: Column) -> Column:
    """Whether a block is noise: preamble, contents, short text, a bare number, an unsure heading outside requirement sections."""
    t = F.trim(F.coalesce(col(text), F.lit("")))
    labels = list(R.LABEL_ROLES.values())
    return F.coalesce(
        (col(section) == "PREAMBLE") | ((col(kind) == "toc") & (col(role) != "section_heading")) | ((F.length(t) < R.SHORT_TEXT) & ~col(role).isin(labels)) | t.rlike(r"^\d+$")
        | (low_confidence & (col(role) == "section_heading") & ~col(kind).isin(R.REQUIREMENT_SECTIONS)), F.lit(False),
    )


def keep_picture(width: Col, height: Col, page_area: Col) -> Column:
    """Six gates: both sides, area, aspect and share of the page; false without a page area."""
    w, h, a = col(width), col(height), col(page_area)
    cover = w * h / F.when(a > 0, a)
    lo, hi = R.PICTURE_COVER
    ok = (w >= R.PICTURE_SIDE) & (h >= R.PICTURE_SIDE) & (w * h >= R.PICTURE_AREA) & (F.greatest(w, h) / F.when(F.least(w, h) > 0, F.least(w, h)) <= R.PICTURE_ASPECT) & cover.between(lo, hi)
    return F.coalesce(ok, F.lit(False))


def may_split(c: Col) -> Column:
    """Whether a description lists several behaviours: a clause mark, or two sentences that begin with such a verb."""
    t = F.coalesce(col(c), F.lit(""))
    return (F.length(F.trim(t)) >= 10) & (t.rlike(R.FOR_CLAUSE) | (F.size(F.regexp_extract_all(t, F.lit(R.IMPERATIVES), F.lit(0))) >= 2))


def acceptance_unit(c: Col) -> Column:
    """Whether a text can be accepted or not: at least 6 characters and words, an expectation, no numbers or page headers only."""
    t = F.trim(F.coalesce(col(c), F.lit("")))
    return (F.length(t) >= 6) & (F.size(F.filter(F.split(t, r"\s+"), lambda w: w != "")) >= 6) & t.rlike(R.EXPECTATIONS) & ~t.rlike(R.NO_UNIT)


def toc_entry(c: Col) -> Column:
    """(number, title, page) of a line of a table of contents; null for any other line."""
    t = F.trim(col(c))
    part = lambda i: F.regexp_extract(t, R.TOC_ENTRY, i)
    number = F.when(part(1) != "", section_path(part(1))).otherwise(part(2))
    return F.when(t.rlike(R.TOC_ENTRY), F.struct(number.alias("number"), part(3).alias("title"), part(4).try_cast("int").alias("page")))
