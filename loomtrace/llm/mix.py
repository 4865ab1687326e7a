"""Mixing sources to target shares by hash thresholds.

Every text has a fixed hash. Tokens are summed by source and hash bucket; from that histogram the bucket in
which a source's budget runs out is known; only that bucket is summed again by finer hash bits, and so on.
The result per source is a number of whole passes and one threshold for the last, partial pass: taking the
mixture is a filter, without any sort. Thresholds are nested: a smaller budget is a subset of a larger one.

The total is a parameter. Left open, it is the largest at which every source that has text reaches its
share, so shares are met to within one text; a source without text cannot contribute, and the others keep
their proportions.

Defined results: source names are compared in lower case with blanks and hyphens as underscores; texts of no
source, of a source without target or of 0 tokens are not in the mixture, but in the report with target 0.
Of a source that is listed twice in the targets the shares add up and the greater repeat limit holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS, LEVELS = 12, 3


def source_name(col: str | Column) -> Column:
    return F.nullif(F.regexp_replace(F.lower(F.trim(col)), r"[\s\-]+", "_"), F.lit(""))


def _hash(id_col: str) -> Column:
    """36 bits of a hash of the id, as a long."""
    return F.shiftrightunsigned(F.xxhash64(id_col), 64 - BITS * LEVELS)


def budgets(available: dict[str, int], targets: dict[str, tuple[float, int]], total: float | None) -> dict[str, float]:
    """Tokens wanted of each source that has text and a target."""
    usable = {s: p for s, (p, r) in targets.items() if available.get(s, 0) > 0 and p > 0 and r > 0}
    if not usable:
        return {}
    whole = sum(usable.values())
    cap = {s: available[s] * targets[s][1] for s in usable}
    if total is None:
        total = min(cap[s] * whole / usable[s] for s in usable)
    # Sources that cannot reach their share give all they have; the others share the rest in proportion.
    out: dict[str, float] = {}
    left, open_ = float(total), dict(usable)
    while open_:
        whole = sum(open_.values())
        short = [s for s in open_ if left * open_[s] / whole > cap[s]]
        if not short:
            return out | {s: left * p / whole for s, p in open_.items()}
        for s in short:
            out[s] = float(cap[s])
            left -= cap[s]
            del open_[s]
    return out


def thresholds(sized: DataFrame, targets: dict[str, tuple[float, int]], total: float | None = None, id_col: str = "doc_id") -> tuple[dict[str, tuple[int, int]], dict[str, int]]:
    """({source: (whole passes, threshold)}, available tokens): a text is used once more if its hash is below the threshold.

    What comes to the driver is one sum per targeted source and bucket, LEVELS times.
    """
    known = sized.where(F.col("src").isin(list(targets)))
    h = _hash(id_col)
    bucket = F.shiftright(h, BITS * (LEVELS - 1))
    sums: dict[str, dict[int, int]] = {}
    for r in known.groupBy("src", bucket.alias("b")).agg(F.sum("n_tokens").alias("n")).collect():
        sums.setdefault(r["src"], {})[r["b"]] = r["n"]
    available = {s: sum(v.values()) for s, v in sums.items()}
    want = budgets(available, targets, total)
    passes = {s: min(int(w // available[s] + 1e-12), targets[s][1]) for s, w in want.items()}
    left = {s: want[s] - passes[s] * available[s] for s in want}
    found: dict[str, tuple[int, int]] = {}
    prefix = dict.fromkeys(want, 0)
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        for s in list(prefix):
            at = None
            for b in sorted(sums.get(s, {})):
                if sums[s][b] > left[s]:
                    at = b
                    break
                left[s] -= sums[s][b]
            if at is None:  # the whole range is used
                found[s] = (passes[s], (prefix[s] + 1) << (shift + BITS) if level else 1 << (BITS * LEVELS))
                del prefix[s]
            elif level == LEVELS - 1:  # the last bucket goes to the nearer side
                found[s] = (passes[s], (prefix[s] << BITS) + at + (sums[s][at] < 2 * left[s]))
            else:
                prefix[s] = (prefix[s] << BITS) + at
        if not prefix or level == LEVELS - 1:
            break
        inside = F.lit(False)
        for s, p in prefix.items():
            inside = inside | ((F.col("src") == s) & (F.shiftright(h, shift) == p))
        finer = F.shiftright(h, shift - BITS).bitwiseAND(F.lit((1 << BITS) - 1))
        sums = {}
        for r in known.where(inside).groupBy("src", finer.alias("b")).agg(F.sum("n_tokens").alias("n")).collect():
            sums.setdefault(r["src"], {})[r["b"]] = r["n"]
    return found, available


def target_map(mix_targets: DataFrame) -> dict[str, tuple[float, int]]:
    """{source: (share, max_repeats)}; a fixed table of some rows."""
    rows = (
        mix_targets.where("target_share is not null and max_repeats is not null")
        .groupBy(source_name("source").alias("s")).agg(F.sum("target_share").alias("p"), F.max("max_repeats").alias("r")).collect()
    )
    return {r["s"]: (r["p"], r["r"]) for r in rows if r["s"] is not None}


def taken(df: DataFrame, uses: dict[str, tuple[int, int]], source: str = "source", id_col: str = "doc_id") -> DataFrame:
    """The rows of ``df`` that are in a mixture, with ``src`` and ``uses``: a filter on id and source, nothing moves."""
    h = _hash(id_col)
    src = source_name(source)
    n = F.lit(0)
    for s, (whole, below) in sorted(uses.items()):
        n = F.when(src == s, F.lit(whole) + (h < F.lit(below)).cast("int")).otherwise(n)
    return df.withColumns({"src": src, "uses": n}).where("uses > 0")


def named(sized: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, src, n_tokens) of the texts that a mixture can use."""
    return sized.select(id_col, source_name("source").alias("src"), "n_tokens").where("n_tokens > 0")


def mixture(sized: DataFrame, mix_targets: DataFrame, total: float | None = None, id_col: str = "doc_id") -> DataFrame:
    """(id, src, n_tokens, repeat): one row per use of a text. ``sized`` holds id, source and n_tokens."""
    uses, _ = thresholds(named(sized, id_col), target_map(mix_targets), total, id_col)
    used = taken(sized.select(id_col, "source", "n_tokens").where("n_tokens > 0"), uses, "source", id_col)
    return used.select(id_col, "src", "n_tokens", F.explode(F.sequence(F.lit(1), F.col("uses"))).alias("repeat"))


def report(sized: DataFrame, mix: DataFrame, mix_targets: DataFrame) -> DataFrame:
    """(src, target_share, max_repeats, available_tokens, mixed_tokens, share, most_repeats, unused_tokens) for every source."""
    have = sized.select(source_name("source").alias("src"), "n_tokens").groupBy("src").agg(F.sum("n_tokens").alias("available_tokens"))
    got = mix.groupBy("src").agg(F.sum("n_tokens").alias("mixed_tokens"), F.max("repeat").alias("most_repeats"))
    want = mix_targets.groupBy(source_name("source").alias("src")).agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    whole = got.agg(F.sum("mixed_tokens").alias("whole"))
    all_ = have.join(got, have["src"].eqNullSafe(got["src"]), "left").drop(got["src"])
    out = all_.join(want, all_["src"].eqNullSafe(want["src"]), "full_outer").select(
        F.coalesce(all_["src"], want["src"]).alias("src"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("target_share", "max_repeats", "available_tokens", "mixed_tokens", "most_repeats")],
    )
    unused = F.greatest(F.col("available_tokens") - F.col("mixed_tokens"), F.lit(0))
    return out.join(F.broadcast(whole), how="left").withColumns({"share": F.col("mixed_tokens") / F.col("whole"), "unused_tokens": unused}).drop("whole")
