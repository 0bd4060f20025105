"""Operator 9, mixing sources to target weights: hierarchical budgeting with DataFrame operations only.

The tree is domain, language, source. A node's capacity is what its documents hold over all allowed
epochs. From the root down, each node's budget is dealt to its children by weight; a child that cannot
use its share is capped at its capacity and the rest goes to its siblings. As capacities count whole
subtrees, a shortage reaches the level above only when all siblings are full. Each leaf then takes
whole epochs and, of the next, a prefix in that epoch's seeded order that does not exceed the budget.
The order is of digests of seed, epoch, id and text, so documents without ids spread like others.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.llm.common import WORD, Scratch, prefix_sum

#: Rows that a piece of a leaf's running sum should hold.
SLICE_ROWS = 256
#: Target weights. A name that is not listed has weight 1.
DOMAIN_WEIGHTS = {"web": 5, "reference": 3, "social": 2}
LANGUAGE_WEIGHTS = {"en": 6, "de": 2, "fr": 2, "es": 1}


def default_domain() -> Column:
    """The domain of a source: by the last character of its name."""
    return F.element_at(F.array(*(F.lit(d) for d in DOMAIN_WEIGHTS)), F.ascii(F.right(F.col("source"), F.lit(1))) % 3 + 1)


def _weight(name: str, weights: Mapping[str, int]) -> Column:
    out = F.lit(1)
    for k, w in weights.items():
        out = F.when(F.col(name) == k, w).otherwise(out)
    return out.cast("decimal(38,0)")


def deal(children: DataFrame, parent: list[str], child: str, weights: Mapping[str, int]) -> DataFrame:
    """Deal each parent's ``budget`` to its children (column ``cap``) by weight, capped, shortages to siblings.

    Siblings are sorted by capacity per weight. One is full if its capacity is at most its share of what
    those before it leave; the full ones come first, so two running sums settle all of them.
    """
    kids = children.withColumn("w", _weight(child, weights))
    kids = kids.withColumn("r", F.col("cap").cast("double") / F.col("w").cast("double"))
    keys = parent or [F.lit(0)]
    order = Window.partitionBy(*keys).orderBy("r", child)
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(0, Window.unboundedFollowing)
    big = lambda c: c.cast("decimal(38,0)")
    left = big(F.col("budget")) - big(F.coalesce(F.sum("cap").over(past), F.lit(0)))
    kids = kids.withColumn("full", big(F.col("cap")) * big(F.sum("w").over(rest)) <= F.col("w") * left)
    group = Window.partitionBy(*keys)
    full_cap = big(F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(group), F.lit(0)))
    open_w = big(F.sum(F.when(~F.col("full"), F.col("w"))).over(group))
    kids = kids.withColumn("c0", full_cap).withColumn("w0", open_w)
    share = F.expr("CAST((w * (CAST(budget AS DECIMAL(38,0)) - c0)) div w0 AS BIGINT)")
    return kids.select(*parent, child, F.when(F.col("full"), F.col("cap")).otherwise(share).alias("budget"))


def mix(
    docs: DataFrame, share: tuple[int, int] = (7, 10), max_epochs: int = 2, seed: str = "7", domain: Column | None = None,
    domains: Mapping[str, int] = DOMAIN_WEIGHTS, languages: Mapping[str, int] = LANGUAGE_WEIGHTS,
    sources: Mapping[str, int] | None = None,
) -> DataFrame:
    """doc_id, text_md5, domain, lang, source, tokens, epoch: a row for each selected document and epoch.

    The whole budget is share[0]/share[1] of all tokens (words between blanks), at most what the epochs hold. A null
    language or source counts as ''. A text without words has no tokens and is selected in every epoch that its leaf
    reaches; a leaf without tokens reaches none. Repeated rows count each; those that are equal in all four columns
    can't be told apart, and the result is the same whichever is taken. An empty table gives no rows. Columns of
    ``docs`` besides doc_id, text, lang and source are ignored. Only ids, digests and counts are shuffled, never
    texts.
    """
    scratch = Scratch(docs.sparkSession)
    named = docs.select(
        "doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("tokens"),
        F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"),
    )
    dom = domain if domain is not None else default_domain()
    rows = scratch.put(named.withColumn("domain", F.coalesce(dom, F.lit(""))).withColumn(
        "id", F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))

    leaf = ["domain", "lang", "source"]
    leaves = scratch.put(rows.groupBy(*leaf).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")))
    leaves = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("t"), F.max("n").alias("n")).first()
    budget = min(total["t"] * share[0] // share[1], total["t"] * max_epochs)

    caps = lambda keys: leaves.groupBy(*keys).agg(F.sum("cap").alias("cap"))
    by_domain = deal(caps(leaf[:1]).withColumn("budget", F.lit(budget).cast("bigint")), [], "domain", domains)
    by_lang = deal(caps(leaf[:2]).join(by_domain, leaf[:1]), leaf[:1], "lang", languages)
    by_source = deal(caps(leaf).join(by_lang, leaf[:2]), leaf[:2], "source", sources or {})
    plan = scratch.put(leaves.join(by_source, leaf).select(
        *leaf,
        F.expr("if(tokens > 0, budget div tokens, 0)").cast("int").alias("whole"),
        F.expr("if(tokens > 0, budget % tokens, 0)").alias("part"),
    ))

    planned = rows.join(plan, leaf)
    last = F.md5(F.concat_ws("/", F.lit(seed), F.col("whole"), F.col("id"), F.col("text_md5")).cast("binary"))
    n_slices = max(1, (total["n"] or 0) // SLICE_ROWS)
    piece = F.expr(f"shiftright(CAST(conv(substr(k, 1, 7), 16, 10) AS BIGINT) * {n_slices}L, 28)")
    cut = planned.where(f"whole < {max_epochs} AND part > 0").withColumn("k", last).withColumn("piece", piece)
    cut = prefix_sum(cut, leaf, "piece", [F.col("k"), F.col("tokens")], F.col("tokens"), "ahead")
    cut = cut.where("ahead + tokens <= part").withColumn("epoch", F.col("whole"))
    full = planned.where("whole > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("whole") - 1)))
    out = ["doc_id", "text_md5", *leaf, "tokens", "epoch"]
    return full.select(*out).unionByName(cut.select(*out))


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that ``mix`` selects, once each, with all their columns (epochs are not repeated).

    Rows are told by doc_id and text; of repeated rows all are kept if one is selected.
    """
    chosen = mix(docs, **how).select(F.col("doc_id").alias("__id"), F.col("text_md5").alias("__md5")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.md5(F.coalesce("text", F.lit("")).cast("binary")) == F.col("__md5"))
    return docs.join(chosen, same, "left_semi").select(*docs.columns)


def _sql_weight(name: str, weights: Mapping[str, int]) -> str:
    return "CASE " + " ".join(f"WHEN {name} = '{k}' THEN {w}" for k, w in weights.items()) + " ELSE 1 END" if weights else "1"


def _sql_deal(name: str, kids: str, parent: list[str], child: str, weights: Mapping[str, int]) -> str:
    part = f"PARTITION BY {', '.join(parent)}" if parent else ""
    keys = "".join(f"{k}, " for k in parent)
    return f"""{name}_a AS (SELECT *, CAST({_sql_weight(child, weights)} AS HUGEINT) AS w FROM ({kids})),
{name}_b AS (SELECT *, CAST(cap AS HUGEINT) * sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
  <= w * (budget - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS is_full
  FROM {name}_a WINDOW o AS ({part} ORDER BY cap / CAST(w AS DOUBLE), {child})),
{name} AS (SELECT {keys}{child}, CASE WHEN is_full THEN cap ELSE CAST((w * (budget - coalesce(sum(cap) FILTER (is_full) OVER ({part}), 0)))
  // nullif(sum(w) FILTER (NOT is_full) OVER ({part}), 0) AS BIGINT) END AS budget FROM {name}_b)"""


def oracle(documents: str = "documents", share: tuple[int, int] = (7, 10), max_epochs: int = 2, seed: str = "7", select: str = "") -> str:
    """DuckDB SQL for ``mix``; ``documents`` names a relation with doc_id, text, lang and source."""
    leaf = "domain, lang, source"
    names = ", ".join(f"'{d}'" for d in DOMAIN_WEIGHTS)
    return f"""WITH rows0 AS (SELECT doc_id, text, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS tokens FROM {documents}),
rows1 AS (SELECT *, list_extract([{names}], CAST(CASE WHEN source = '' THEN 0 ELSE ord(right(source, 1)) END % 3 + 1 AS INTEGER)) AS domain FROM rows0),
leaves AS (SELECT {leaf}, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(tokens) AS BIGINT) * {max_epochs} AS cap FROM rows1 GROUP BY ALL),
{_sql_deal("d1", f"SELECT domain, sum(cap) AS cap, (SELECT least(sum(tokens) * {share[0]} // {share[1]}, sum(tokens) * {max_epochs}) FROM leaves) AS budget FROM leaves GROUP BY domain", [], "domain", DOMAIN_WEIGHTS)},
{_sql_deal("d2", "SELECT l.domain, lang, sum(cap) AS cap, any_value(budget) AS budget FROM leaves l JOIN d1 USING (domain) GROUP BY l.domain, lang", ["domain"], "lang", LANGUAGE_WEIGHTS)},
{_sql_deal("d3", "SELECT l.domain, l.lang, source, cap, budget FROM leaves l JOIN d2 USING (domain, lang)", ["domain", "lang"], "source", {})},
plan AS (SELECT domain, lang, source, CAST(CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS INTEGER) AS whole,
  CASE WHEN tokens > 0 THEN budget % tokens ELSE 0 END AS part FROM leaves JOIN d3 USING (domain, lang, source)),
planned AS (SELECT * FROM rows1 JOIN plan USING (domain, lang, source)),
cut AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5(concat('{seed}/', whole, '/', coalesce(CAST(doc_id AS VARCHAR), ''), '/', md5(coalesce(text, '')))), tokens
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM planned WHERE whole < {max_epochs} AND part > 0),
chosen AS (SELECT doc_id, text, domain, lang, source, tokens, CAST(unnest(range(whole)) AS INTEGER) AS epoch FROM planned
  UNION ALL SELECT doc_id, text, domain, lang, source, tokens, whole FROM cut WHERE upto <= part)
{select or "SELECT doc_id, domain, lang, source, tokens, epoch FROM chosen"}"""
