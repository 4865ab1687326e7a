"""Ordered text: lines, paragraphs, sections, steps and groups, as window queries over explicit positions.

All windows are partitioned by document (or conversation, section), so order is data and no window is global.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtrace.functions import text as X


def lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, pos, line): the lines of each text with either line ending, blank ones included."""
    return docs.where(F.col(text).isNotNull()).select(id_col, F.posexplode(F.split(F.col(text), "\r\n|\r|\n")).alias("pos", "line"))


def carry_forward(df: DataFrame, value: Column, part: list[str], order: str, name: str) -> DataFrame:
    """The last value that is not null at or before each row."""
    w = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def running_group(df: DataFrame, opens: Column, part: list[str], order: str, name: str = "grp") -> DataFrame:
    """The number of rows at or before each row that open a group."""
    w = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.sum(opens.cast("int")).over(w))


def gap_sessions(df: DataFrame, part: list[str], order: str, end: str, start: str, gap: float, breaks: Column | None = None, name: str = "session") -> DataFrame:
    """A row opens a session if its start is more than ``gap`` after the end of the row before, or it breaks by itself."""
    w = Window.partitionBy(*part).orderBy(order)
    opens = F.coalesce(F.col(start) - F.lag(end).over(w) > gap, F.lit(True))
    return running_group(df.withColumn("__o", opens | breaks if breaks is not None else opens), F.col("__o"), part, order, name).drop("__o")


def word_lines(words: DataFrame) -> DataFrame:
    """Words (page, text, x0, x1, top, bottom) into lines by banker's rounding of top/2: (page, y, text, x0, x1, top, bottom)."""
    y = (F.bround(F.col("top") / 2) * 2).cast("double")
    return words.groupBy("page", y.alias("y")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda w: w["text"]), " ").alias("text"),
        F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("top").alias("top"), F.max("bottom").alias("bottom"),
    )


def paragraphs(lines_: DataFrame, gap: float = 8.0) -> DataFrame:
    """Lines (page, text, top, bottom) into paragraphs: a wide gap or a requirement label opens one."""
    label = F.col("text").rlike(r"^(ID|TITLE|DESC|RAT|DEP|FIT):")
    s = gap_sessions(lines_, ["page"], "top", "bottom", "top", gap, label, "para")
    return s.groupBy("page", "para").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("top", "text"))), lambda x: x["text"]), " ").alias("text"), F.min("top").alias("top"), F.max("bottom").alias("bottom")
    )


HEADING = r"^\s*#*\s*(\d+(?:\.\d+)*)\.?\s+(\S.*)$"


def sections(lines_: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Each line with the numbered heading it stands under: adds section_path (PREAMBLE before the first), section_no."""
    path = F.when(F.col("line").rlike(HEADING) & (F.length("line") < 100), F.regexp_extract("line", HEADING, 1))
    h = carry_forward(lines_.withColumn("__p", path), F.col("__p"), [id_col], "pos", "section_path")
    h = running_group(h, F.col("__p").isNotNull(), [id_col], "pos", "section_no")
    return h.withColumn("section_path", F.coalesce("section_path", F.lit("PREAMBLE"))).drop("__p")


def block_slices(lines_: DataFrame, header: Column, id_col: str = "doc_id") -> DataFrame:
    """(id, grp, first, last, n): each header with the lines up to the next one; lines before the first are group 0."""
    g = running_group(lines_, header, [id_col], "pos")
    return g.groupBy(id_col, "grp").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.count("*").alias("n"))


def fold_items(lines_: DataFrame, bullet: str = r"^\s*([-*•]|\d+[.)])\s+", id_col: str = "doc_id") -> DataFrame:
    """(id, item, text): a bullet opens an item, other lines are added to it; lines before the first bullet are item 0."""
    g = running_group(lines_.where("trim(line) <> ''"), F.col("line").rlike(bullet), [id_col], "pos", "item")
    parts = F.array_sort(F.collect_list(F.struct("pos", F.trim(F.regexp_replace("line", bullet, "")).alias("t"))))
    return g.groupBy(id_col, "item").agg(F.array_join(F.transform(parts, lambda p: p["t"]), " ").alias("text"))


def labelled_values(lines_: DataFrame, labels: list[str], part: list[str]) -> DataFrame:
    """(part, label, value): the last block of each label, its own line and the lines up to the next label."""
    pat = rf"(?i)^\s*({'|'.join(labels)})\s*:\s*(.*)$"
    lab = F.when(F.col("line").rlike(pat), F.upper(F.regexp_extract("line", pat, 1)))
    g = running_group(carry_forward(lines_.withColumn("__l", lab), F.col("__l"), part, "pos", "label"), F.col("__l").isNotNull(), part, "pos")
    t = F.when(F.col("__l").isNotNull(), F.trim(F.regexp_extract("line", pat, 2))).otherwise(F.trim("line"))
    blocks = g.where("label is not null").withColumn("t", t).groupBy(*part, "grp", "label").agg(
        F.array_join(F.filter(F.transform(F.array_sort(F.collect_list(F.struct("pos", "t"))), lambda x: x["t"]), lambda x: x != ""), " ").alias("value")
    )
    return blocks.groupBy(*part, "label").agg(F.max_by("value", "grp").alias("value"))


STEP = r"^\s*(?:[-*]\s*)?(Given|When|Then|And|But)\b"


def step_categories(lines_: DataFrame, part: list[str]) -> DataFrame:
    """Scenario steps with their kind; And and But inherit the kind before them, a leading one is an outcome."""
    word = F.lower(F.regexp_extract("line", f"(?i){STEP}", 1))
    s = lines_.withColumn("word", word).where("word <> ''")
    kind = F.when(F.col("word") == "given", "precondition").when(F.col("word") == "when", "action").when(F.col("word") == "then", "outcome")
    return carry_forward(s.withColumn("__k", kind), F.col("__k"), part, "pos", "kind").withColumn("kind", F.coalesce("kind", F.lit("outcome"))).drop("__k")


def heading_stack(headings: DataFrame, part: list[str], depth: int = 6) -> DataFrame:
    """Headings (pos, level, title) with their full path: a heading at level L stays until one at L or above follows.

    Per level, the last heading that no later shallower one has closed: one window per level. Levels below ``depth`` count
    as ``depth``: such headings follow each other.
    """
    headings = headings.withColumn("level", F.least("level", F.lit(depth)))
    w = Window.partitionBy(*part).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = headings
    for lv in range(1, depth + 1):
        at = at.withColumn(f"__p{lv}", F.max(F.when(F.col("level") == lv, F.col("pos"))).over(w)).withColumn(f"__t{lv}", F.last(F.when(F.col("level") == lv, F.col("title")), ignorenulls=True).over(w))
        at = at.withColumn(f"__c{lv}", F.max(F.when(F.col("level") < lv, F.col("pos"))).over(w))
    live = F.array_compact(F.array(*[
        F.when((F.col("level") >= lv) & F.col(f"__p{lv}").isNotNull() & (F.col(f"__p{lv}") > F.coalesce(f"__c{lv}", F.lit(-1))), F.col(f"__t{lv}")) for lv in range(1, depth + 1)
    ]))
    return at.withColumn("section_path", F.array_join(live, " > ")).drop(*[f"__{k}{lv}" for k in "ptc" for lv in range(1, depth + 1)])


def anchor_groups(rows: DataFrame, part: list[str], floor: float = 0.45) -> DataFrame:
    """Rows (pos, strict, narrative, attachable, score) with their group: a strict row opens one, a narrative row closes it.

    Adds grp (0: none) and member: others join an open group if they can be attached or score high enough.
    """
    g = running_group(rows, F.col("strict"), part, "pos", "__g")
    w = Window.partitionBy(*part, "__g").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    closed = F.max((~F.col("strict") & F.col("narrative")).cast("int")).over(w) == 1
    member = F.col("strict") | ((F.col("__g") > 0) & ~closed & (F.col("attachable") | (F.col("score") >= floor)))
    return g.withColumn("member", member).withColumn("grp", F.when(F.col("member"), F.col("__g")).otherwise(0)).drop("__g")


def inside_box(blocks: DataFrame, tables: DataFrame, page: str = "page") -> DataFrame:
    """Blocks that lie fully inside a table of their page: an equi-join on the page, then four comparisons."""
    t = tables.select(page, *[F.col(c).alias(f"t_{c}") for c in ("x0", "top", "x1", "bottom")])
    return blocks.join(t, page, "inner").where("x0 >= t_x0 and top >= t_top and x1 <= t_x1 and bottom <= t_bottom").select(blocks.columns).distinct()


def roles_by_section(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, section_path, n, n_strict, n_modal, kind): how much of a section states requirements."""
    ln = sections(lines(docs, id_col), id_col).where("trim(line) <> ''")
    t = F.lower("line")
    from loomtrace.functions import rules as R

    s = ln.groupBy(id_col, "section_path").agg(F.count("*").alias("n"), F.count_if(t.rlike(R.MODALS) & t.rlike(R.BEHAVIOUR)).alias("n_strict"), F.count_if(t.rlike(R.MODALS)).alias("n_modal"))
    return s.withColumn("kind", X.first_match([(F.col("n_strict") > 0, "REQUIREMENT_SOURCE"), (F.col("n_modal") > 0, "SUPPORTING")], "NARRATIVE"))


def paragraphs_of_lines(lines_: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, para, first, n, is_heading, text): a blank line ends a paragraph, a heading is one of its own."""
    w = Window.partitionBy(id_col).orderBy("pos")
    heading = X.heading("line")["level"].isNotNull()
    h = lines_.withColumn("__h", heading)
    opens = F.col("__h") | F.coalesce(F.lag("__h").over(w) | (F.trim(F.lag("line").over(w)) == ""), F.lit(True))
    g = running_group(h.withColumn("__o", opens & (F.trim("line") != "")), F.col("__o"), [id_col], "pos", "para").where("trim(line) <> ''")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.trim("line").alias("t")))), lambda x: x["t"]), "\n")
    return g.groupBy(id_col, "para").agg(F.min("pos").alias("first"), F.count("*").alias("n"), F.bool_or("__h").alias("is_heading"), text.alias("text"))


def pipe_rows(lines_: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, pos, cells): the rows of tables whose cells are between bars; rules between head and body are none."""
    t = F.trim("line")
    cells = F.transform(F.split(F.regexp_replace(t, r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    return lines_.where(t.rlike(r"^\|.*\|$") & ~t.rlike(r"^\|[\s\-:|]+\|$")).select(id_col, "pos", cells.alias("cells"))


def pipe_tables(lines_: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, table_no, n_rows, n_cols, text): neighbouring lines between bars as one table in plain text."""
    w = Window.partitionBy(id_col).orderBy("pos")
    bars = lines_.where(F.trim("line").rlike(r"^\|.*\|$")).withColumn("__o", F.coalesce(F.col("pos") - F.lag("pos").over(w) > 1, F.lit(True)))
    g = running_group(bars, F.col("__o"), [id_col], "pos", "table_no").select(id_col, "pos", "table_no")
    rows = pipe_rows(lines_, id_col).join(g, [id_col, "pos"])
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.array_join("cells", " | ").alias("t")))), lambda x: x["t"]), "\n")
    return rows.groupBy(id_col, "table_no").agg(F.count("*").alias("n_rows"), F.max(F.size("cells")).alias("n_cols"), text.alias("text"))


def toc_run(pages: DataFrame, id_col: str = "doc_id", opens: int = 3) -> DataFrame:
    """(id, first_page, last_page) of pages (id, page, n): the first with at least ``opens`` lines of contents and all after it up to one without."""
    w = Window.partitionBy(id_col)
    p = pages.withColumn("first_page", F.min(F.when(F.col("n") >= opens, F.col("page"))).over(w)).where("page >= first_page")
    p = p.withColumn("__end", F.min(F.when(F.col("n") < 1, F.col("page"))).over(w)).where("__end is null or page < __end")
    return p.groupBy(id_col, "first_page").agg(F.max("page").alias("last_page"))


def story_units(lines_: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, pos, kind, unit) of lines that are not blank: the units of acceptance stories.

    A user story, a scenario and a bullet open a unit. A story holds the lines up to its first end of a sentence, a scenario its steps and
    a bullet its own line; any other line is a unit of prose.
    """
    t = F.trim("line")
    kind = X.first_match([
        (t.rlike(r"(?i)^As an?\b"), "story"), (t.rlike(r"(?i)^(Acceptance )?Scenario( Outline)?:"), "scenario"), (t.rlike(r"(?i)^(Given|When|Then|And|But)\b"), "step"), (t.rlike(r"^([-*•]|\d+[.)])\s"), "bullet"),
    ], "prose")
    part = [id_col]
    ln = lines_.where("trim(line) <> ''").withColumn("__k", kind)
    g = running_group(ln, F.col("__k").isin("story", "scenario", "bullet"), part, "pos", "__g")
    opener = F.first("__k").over(Window.partitionBy(id_col, "__g").orderBy("pos"))
    before = Window.partitionBy(id_col, "__g").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    ended = F.coalesce(F.max(F.trim("line").rlike(r"[.!?]$").cast("int")).over(before), F.lit(0)) == 1
    g = g.withColumns({"__opener": opener, "__ended": ended}).withColumn("__story", F.col("__opener") == "story")
    inside = X.first_match([(F.col("__k").isin("story", "scenario", "bullet"), True), (F.col("__story"), ~F.col("__ended")), (F.col("__opener") == "scenario", F.col("__k") == "step")], False)
    g = g.withColumn("__in", inside)
    kind = F.when(F.col("__in"), F.col("__opener")).otherwise(F.when(F.col("__k") == "step", "step").otherwise("prose"))
    unit = F.when(F.col("__in"), F.concat(F.lit("g"), F.col("__g").cast("string"))).otherwise(F.concat(F.lit("p"), F.col("pos").cast("string")))
    return g.select(id_col, "pos", kind.alias("kind"), unit.alias("unit"))
