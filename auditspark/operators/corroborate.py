"""``agg_dedup``: corroborate findings of all sources by file:line:CWE.

Semantics (an ordered left fold per dedup key, in arrival order ``seq``):
the first finding starts the group; each next finding replaces the primary
iff its severity rank is higher, or equal severity and higher confidence rank
than the *current* confidence (which is CONFIRMED once the group holds the
detector and another source), or both equal and it is a tool finding while the
current merged source is the detector. Sources are unioned; text fields fall
back to the other side when empty; references are an ordered distinct union,
primary first; the count grows by one per merge.

Scale design - no group is ever collected whole:

* The current primary's comparison key ``(severity, confidence, is_tool)`` never
  decreases along the fold, so only the FIRST element of each key value can
  ever become primary (at most 5 x 6 x 2 = 60 candidates per group).
* Everything else the fold needs is a prefix fact that is an ordinary
  partial-aggregable aggregate: first detector / first tool arrival, the first
  non-empty source and text fields, the source set, the count.

So stage A aggregates per (group, key value) with map-side combine (a hot key
of millions of rows ships one partial row per task), stage B gathers at most
60 candidates per group and runs the exact fold over them with ``aggregate``.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import catalogs as C
from ..functions import columns as X
from .numbering import positions

# FIXED VALUES: the order in which the kinds of sources are merged, and the tools of each
SOURCE_ORDER = ["detector", "opengrep", "package-audit", "osv-scanner", "extra", "partial"]
SOURCE_TOOLS = {"detector": ["detector"], "opengrep": ["opengrep"], "package-audit": ["npm-audit", "bun-audit", "pnpm-audit"],
                "osv-scanner": ["osv-scanner"], "extra": ["gitleaks", "bandit", "gosec", "trivy"], "partial": []}

TEXT_FALLBACKS = ["description", "vulnerable_code", "fix", "exploitation"]
PRIMARY_FIELDS = ["id", "severity", "confidence", "category", "name", "file", "line", "cwe", "owasp", "vibe_risk",
                  "compliance"]
OPTIONAL = {"id": "string", "owasp": "string", "vibe_risk": "boolean", "compliance": "string",
            "description": "string", "vulnerable_code": "string", "fix": "string", "exploitation": "string",
            "references": "array<string>", "source": "string"}


def _with_defaults(df: DataFrame) -> DataFrame:
    for c, t in OPTIONAL.items():
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast(t))
    return df


def source_rank(source: Column, default: str = "extra") -> Column:
    """The place in SOURCE_ORDER of the kind that holds the tool ``source``."""
    ranks = {t: SOURCE_ORDER.index(k) for k, tools in SOURCE_TOOLS.items() for t in tools}
    return X.lookup(ranks, source, SOURCE_ORDER.index(default))


def ordered_union(parts: dict[str, DataFrame], order: dict[str, list], ranks: dict[str, Column] | None = None) -> DataFrame:
    """``set_union_findings``: findings of all kinds of sources with the order key
    ``seq``: the rank of the kind in SOURCE_ORDER, then the kind's own ``order``
    columns, which must have the same names and types in every part. A part that holds
    several kinds has the rank of each row in ``ranks``."""
    out = None
    for kind in SOURCE_ORDER:
        if kind not in parts:
            continue
        rank = (ranks or {}).get(kind, F.lit(SOURCE_ORDER.index(kind)))
        seq = F.struct(rank.alias("source_rank"), *order[kind])
        part = parts[kind].withColumn("seq", seq)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def _first_nonempty(c: str):
    return F.min(F.when(X.nonempty(c), F.struct(F.col("seq").alias("seq"), F.col(c).alias("v"))))


def deduplicate(findings: DataFrame, group_cols: tuple = ("repo_id",), with_references: bool = True,
                spread: bool = False, counts: dict[str, Column] | None = None) -> DataFrame:
    """Input: canonical findings with ``seq`` (any orderable column, unique per
    group). Output: one row per (group, dedup_key) with ``sources`` (sorted),
    ``duplicate_count`` and ``first_seq``. ``counts`` adds, by name, how many of a
    key's findings meet a condition.

    ``with_references`` gathers all references of a key into its row; for keys with
    very many there is ``reference_rows``.

    ``spread`` deals the rows out by a hash of their content first, for an input
    of few splits (keys are derived before the first shuffle); it is up to the
    caller and never guessed.
    """
    f, out = _fold(findings, group_cols, spread, counts or {})
    g = list(group_cols)
    if with_references:
        refs = (_first_references(f, g).groupBy(*g, "dedup_key")
                .agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "ref"))), lambda r: r["ref"]).alias("_refs_by_first")))
        out = (out.join(refs, [*g, "dedup_key"], "left")
               .withColumn("references", F.array_distinct(F.filter(
                   F.concat(F.col("_rrefs"), F.coalesce("_refs_by_first", F.array().cast("array<string>"))),
                   lambda r: X.nonempty(r))))
               .drop("_refs_by_first"))
    else:
        out = out.withColumn("references", F.array_distinct(F.filter("_rrefs", lambda r: X.nonempty(r))))
    return out.drop("_rrefs")


def _first_references(f: DataFrame, g: list[str]) -> DataFrame:
    """(group, dedup_key, ref, at): where each reference of a key stands first, by
    finding and place in its list; partial minimums, nothing is gathered."""
    return (f.select(*g, "dedup_key", "seq", F.posexplode("references").alias("i", "ref")).where(X.nonempty("ref"))
            .groupBy(*g, "dedup_key", "ref").agg(F.min(F.struct("seq", "i")).alias("at")))


def reference_rows(findings: DataFrame, group_cols: tuple = ("repo_id",), spread: bool = False) -> DataFrame:
    """(group, dedup_key, position, reference): the references of the merged findings, a
    row for each, in the order of ``deduplicate``'s array: those of the findings that
    became primary, the last one first, then all by their first place. A key may have any
    number of them: positions come from prefix sums over a range partition."""
    f, out = _fold(findings, group_cols, spread, {})
    g = list(group_cols)
    lead = (out.select(*g, "dedup_key", F.posexplode("_rrefs").alias("lead", "ref")).where(X.nonempty("ref"))
            .groupBy(*g, "dedup_key", "ref").agg(F.min("lead").alias("lead")))
    every = _first_references(f, g).join(lead, [*g, "dedup_key", "ref"], "left")
    # what no primary holds comes behind, by its first place
    rank = [F.coalesce("lead", F.lit((1 << 31) - 1)).alias("lead"), F.when(F.col("lead").isNull(), F.col("at")).alias("at")]
    rows = positions(every.select(*g, "dedup_key", F.col("ref").alias("reference"), *rank), [F.col("lead"), F.col("at")], (*g, "dedup_key"))
    return rows.select(*g, "dedup_key", "position", "reference")


def _fold(findings: DataFrame, group_cols: tuple, spread: bool, counts: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(findings with their keys, merged findings with the primaries' references ``_rrefs``)."""
    g = list(group_cols)
    f = _with_defaults(findings)
    if spread:
        f = f.repartition(F.xxhash64(*[F.col(c) for c in f.columns]))
    f = (f.withColumn("dedup_key", X.dedup_key("file", "line", "cwe", "category", "name"))
         .withColumn("_sev_r", X.severity_rank("severity"))
         .withColumn("_conf_r", X.confidence_rank("confidence"))
         .withColumn("_tool", (~X.is_detector("source")).cast("int"))
         .withColumn("_fsrc", X.finding_source("source")))
    f = f.withColumn("_k", F.col("_sev_r") * 100 + F.col("_conf_r") * 10 + F.col("_tool"))

    cand = F.struct(F.col("seq").alias("seq"), F.col("_sev_r").alias("sev_r"), F.col("_conf_r").alias("conf_r"),
                    F.col("_tool").alias("tool"), F.col("source").alias("source"),
                    *[F.col(c).alias(c) for c in PRIMARY_FIELDS + TEXT_FALLBACKS],
                    F.coalesce(F.col("references"), F.array().cast("array<string>")).alias("refs"))
    # stage A: per (group, key value) - partial aggregation before the shuffle
    a = f.groupBy(*g, "dedup_key", "_k").agg(
        F.min(cand).alias("cand"),
        F.count(F.lit(1)).alias("cnt"),
        F.collect_set("_fsrc").alias("srcs"),
        F.min(F.when(F.col("_tool") == 0, F.col("seq"))).alias("first_det"),
        F.min(F.when(F.col("_tool") == 1, F.col("seq"))).alias("first_tool"),
        _first_nonempty("source").alias("first_source"),
        *[F.count_if(c).alias(f"n_{n}") for n, c in counts.items()],
        *[_first_nonempty(c).alias(f"first_{c}") for c in TEXT_FALLBACKS])
    # stage B: per group - at most 60 rows per group arrive here. The fold is an
    # aggregate output (later filters cannot inline it) and runs over a narrow
    # integer state: positions into the sorted candidate array, not whole rows.
    cands = F.array_sort(F.collect_list("cand"))

    def key_of(c, i):
        ne = {n: X.nonempty(c[n]) for n in ["source"] + TEXT_FALLBACKS}
        return F.struct(i.alias("i"), c["seq"].alias("seq"), c["sev_r"].alias("sev_r"), c["conf_r"].alias("conf_r"),
                        c["tool"].alias("tool"), ne["source"].alias("ne_source"),
                        (ne["source"] & (c["source"] != C.DETECTOR)).alias("src_tool"),
                        *[ne[n].alias(f"ne_{n}") for n in TEXT_FALLBACKS])

    keys = F.transform(cands, key_of)
    fs = F.min("first_source")

    # the first element initialises the state (p < 0): it always "replaces", so
    # the candidate array is evaluated once per group (no repeated keys[0] refs)
    state0 = F.struct(F.lit(-1).alias("p"), F.lit(0).alias("psev"), F.lit(0).alias("pconf"),
                      F.lit(-1).alias("rs"), F.lit(False).alias("rs_tool"),
                      *[F.lit(-1).alias(f"r_{c}") for c in TEXT_FALLBACKS],
                      F.array().cast("array<int>").alias("reps"),
                      F.min("first_det").alias("fd"), F.min("first_tool").alias("ft"),
                      fs["seq"].alias("fs_seq"), (X.nonempty(fs["v"]) & (fs["v"] != C.DETECTOR)).alias("fs_tool"))

    def step(st, x):
        seq = x["seq"]
        confirmed = st["fd"].isNotNull() & st["ft"].isNotNull() & (st["fd"] < seq) & (st["ft"] < seq)
        cur_conf = F.when(confirmed, F.lit(5)).otherwise(st["pconf"])
        cur_tool = F.when(st["rs"] >= 0, st["rs_tool"]).when(st["fs_seq"] < seq, st["fs_tool"]).otherwise(F.lit(False))
        same_sev = x["sev_r"] == st["psev"]
        repl = ((st["p"] < 0) | (x["sev_r"] > st["psev"]) | (same_sev & (x["conf_r"] > cur_conf))
                | (same_sev & (x["conf_r"] == cur_conf) & (x["tool"] == 1) & ~cur_tool))
        take_src = repl & x["ne_source"]
        return F.struct(F.when(repl, x["i"]).otherwise(st["p"]).alias("p"),
                        F.when(repl, x["sev_r"]).otherwise(st["psev"]).alias("psev"),
                        F.when(repl, x["conf_r"]).otherwise(st["pconf"]).alias("pconf"),
                        F.when(take_src, x["i"]).otherwise(st["rs"]).alias("rs"),
                        F.when(take_src, x["src_tool"]).otherwise(st["rs_tool"]).alias("rs_tool"),
                        *[F.when(repl & x[f"ne_{c}"], x["i"]).otherwise(st[f"r_{c}"]).alias(f"r_{c}")
                          for c in TEXT_FALLBACKS],
                        F.when(repl, F.concat(F.array(x["i"]), st["reps"])).otherwise(st["reps"]).alias("reps"),
                        st["fd"].alias("fd"), st["ft"].alias("ft"), st["fs_seq"].alias("fs_seq"),
                        st["fs_tool"].alias("fs_tool"))

    out = a.groupBy(*g, "dedup_key").agg(
        F.aggregate(keys, state0, step).alias("_st"),
        cands.alias("_cands"),
        F.sum("cnt").alias("duplicate_count"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("srcs")))).alias("sources"),
        fs.alias("first_source"),
        *[F.sum(f"n_{n}").alias(n) for n in counts],
        *[F.min(f"first_{c}").alias(f"first_{c}") for c in TEXT_FALLBACKS])
    cs = F.col("_cands")
    p = cs[F.col("_st.p")]

    def at(pos_col, field):
        return F.when(pos_col >= 0, cs[pos_col][field])

    first_src = F.col("first_source")
    has_both = F.array_contains("sources", C.DETECTOR) & F.exists("sources", lambda s_: s_ != C.DETECTOR)
    cols = [*g, "dedup_key"]
    cols += [p[c].alias(c) for c in PRIMARY_FIELDS if c != "confidence"]
    cols += [F.when(has_both, F.lit("CONFIRMED")).otherwise(p["confidence"]).alias("confidence"),
             F.coalesce(at(F.col("_st.rs"), "source"), first_src["v"]).alias("source"),
             "sources", "duplicate_count", *counts,
             F.flatten(F.transform(F.col("_st.reps"), lambda i: cs[i]["refs"])).alias("_rrefs"),
             cs[0]["seq"].alias("first_seq"),
             p["seq"].alias("primary_seq")]
    cols += [F.coalesce(at(F.col(f"_st.r_{c}"), c), F.col(f"first_{c}.v")).alias(c) for c in TEXT_FALLBACKS]
    return f, out.select(*cols)


def origin_breakdown(deduped: DataFrame, group_cols: tuple = ("repo_id",)) -> DataFrame:
    """``agg_origin``: findings per distinct source, plus confirmed and total. One pass:
    every finding also counts under a null source, the group's total."""
    g = list(group_cols)
    srcs = F.when(F.size(F.coalesce("sources", F.array())) > 0, F.array_distinct("sources")).otherwise(
        F.array(X.finding_source("source")))
    f = deduped.select(*g, srcs.alias("_srcs"), ((F.upper(X.s("confidence")) == "CONFIRMED") | (F.size(srcs) > 1)).alias("_sure"))
    per = (f.select(*g, "_sure", F.explode(F.concat("_srcs", F.array(F.lit(None).cast("string")))).alias("source"))
           .groupBy(*g, "source").agg(F.count(F.lit(1)).alias("count"), F.count_if("_sure").alias("_confirmed")))
    whole = F.col("source").isNull()
    over = Window.partitionBy(*g)  # a row for each source
    per = per.withColumn("total", F.max(F.when(whole, F.col("count"))).over(over)).withColumn(
        "confirmed", F.max(F.when(whole, F.col("_confirmed"))).over(over))
    return per.where(~whole).drop("_confirmed").withColumn("label", X.source_label("source"))
