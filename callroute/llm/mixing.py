"""Mixing sources to target weights: raking by iterative proportional fitting, then calibrated sampling.

Documents are first summed into cells (one per source, language and topic),
so that a source with a third of all rows is a handful of rows in everything
that follows. All of it is DataFrame expressions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Share of the tokens of each value of a column; or a power of its own share (1: as it is, 0: all alike).
Target = dict[str, float] | float

_CELLS_TO_BROADCAST = 100_000  # rows of a few numbers: some MB
_ROUNDS_A_JOB = 5


def _over(column: str) -> Column:
    return F.sum("_w").over(Window.partitionBy(column))


def _shares(cells: DataFrame, targets: dict[str, Target], unlisted: bool) -> DataFrame:
    """Adds ``_t0``, ``_t1``, ...: the target share of each cell's value, over the values that occur.

    ``unlisted``: values that a dict doesn't list have their own share, and the
    listed ones share the rest.
    """
    for i, (column, target) in enumerate(targets.items()):
        by = Window.partitionBy(column)
        own = F.sum("_mass").over(by)
        if isinstance(target, dict):
            listed = reduce(lambda rest, kv: F.when(F.col(column) == kv[0], F.lit(float(kv[1]))).otherwise(rest), target.items(), F.lit(0.0))
            raw = listed
        else:
            raw = F.pow(own, F.lit(float(target)))
        # each value counts once: by the cell that comes first among its own
        cells = cells.withColumn("_raw", F.when(F.col("_mass") > 0, raw).otherwise(0.0))
        cells = cells.withColumn("_once", F.when(F.row_number().over(by.orderBy(F.desc("_mass"), *targets)) == 1, F.col("_raw")).otherwise(0.0))
        named = F.coalesce(F.col(column).isin(*target), F.lit(False)) if isinstance(target, dict) else F.lit(True)
        sums = cells.agg(F.sum("_once").alias("s"), F.sum(F.when(named, F.col("_mass"))).alias("listed"), F.sum(F.when(~named, F.col("_mass"))).alias("others")).first()
        total = sums.s or 0.0
        if unlisted and sums.others:
            each = total / sums.listed if total and sums.listed else 1.0  # a listed share for the same mass
            cells = cells.withColumn("_raw", F.when(named, F.col("_raw")).otherwise(own * F.lit(each)))
            total += sums.others * each
        total = total or 1.0
        cells = cells.withColumn(f"_t{i}", F.col("_raw") / F.lit(float(total))).drop("_raw", "_once")
    return cells


def rake(cells: DataFrame, targets: dict[str, Target], rounds: int, unlisted: bool = False) -> DataFrame:
    """Adds ``_w``, shares of the cells whose sums over each column approach its targets.

    One round scales the shares to each column's targets in turn. Cells of no
    mass or with a target of 0 get 0.
    """
    spark_total = cells.agg(F.sum("_mass").alias("s")).first().s or 1
    fitted = _shares(cells.withColumn("_w", F.col("_mass") / F.lit(float(spark_total))), targets, unlisted)
    for done in range(1, rounds + 1):
        for i, column in enumerate(targets):
            fitted = fitted.withColumn("_w", F.when(_over(column) > 0, F.col("_w") * F.col(f"_t{i}") / _over(column)).otherwise(0.0))
        if done % _ROUNDS_A_JOB == 0 or done == rounds:
            fitted = common.cut(fitted, "raked")
    return fitted


def calibrate(fitted: DataFrame, budget: float) -> DataFrame:
    """Adds ``_probability``: min(1, c times what the raking multiplied a cell by), with c such that ``budget`` of the tokens are expected.

    Every pass fixes the cells that reach 1 and deals what is left of the budget to the rest.
    """
    total = fitted.agg(F.sum("_mass").alias("s")).first().s or 1
    ratio = F.when(F.col("_mass") > 0, F.col("_w") * F.lit(float(total)) / F.col("_mass")).otherwise(0.0)
    cells = fitted.withColumn("_ratio", ratio)
    c, full = 0.0, -1.0
    while True:
        capped = F.col("_ratio") * F.lit(c) >= 1
        row = cells.agg(F.sum(F.when(capped, F.col("_mass")).otherwise(0.0)).alias("full"), F.sum(F.when(capped, 0.0).otherwise(F.col("_mass") * F.col("_ratio"))).alias("rest")).first()
        if row.full == full or not row.rest:
            break
        full = row.full
        c = max(c, (budget * total - full) / row.rest)
    if row.rest == 0 or row.rest is None:  # everything that may be taken is
        c = max(c, 1e300)
    return cells.withColumn("_probability", F.least(F.lit(1.0), F.col("_ratio") * F.lit(c)))


def chance(doc_id: str, seed: int) -> Column:
    """A number from 0 to under 1 that an id always gets: the leading 52 bits of a hash."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(2.0**52)


def mix(docs: DataFrame, targets: dict[str, Target], tokens: str, budget: float, doc_id: str = "doc_id", rounds: int = 10, seed: int = 1, unlisted: bool = False) -> DataFrame:
    """Every row of ``docs`` with ``_probability`` to be kept and ``_kept``.

    ``targets`` names one to three or more columns; a null in one is a value
    of its own, and a value that a dict doesn't list, null too, gets 0, or with
    ``unlisted`` keeps its own share while the listed shares are scaled to the
    rest. ``tokens``: the column with a row's weight; null or negative counts as 0, and a cell of
    nothing else has probability 0. ``budget``: share of all tokens to keep;
    at 1 or more every row with a target is kept. Rows of one id in one cell
    are kept or dropped together. No rows give no rows. Columns that start
    with an underscore are reserved.
    """
    if clash := [c for c in docs.columns if c.startswith("_")]:
        raise ValueError(f"reserved column names: {clash}")
    mass = F.greatest(F.coalesce(F.col(tokens).cast("double"), F.lit(0.0)), F.lit(0.0))
    cells = common.cut(docs.groupBy(*targets).agg(F.sum(mass).alias("_mass")), "cells")
    found = calibrate(rake(cells, targets, rounds, unlisted), budget).select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(targets)), "_probability")
    if cells.count() <= _CELLS_TO_BROADCAST:
        found = F.broadcast(found)
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(targets)))
    out = docs.join(found, same).drop(*(f"_k{i}" for i in range(len(targets))))
    return out.withColumn("_kept", chance(doc_id, seed) < F.col("_probability"))


def topic(text: str) -> Column:
    """What a text looks like, by marks it holds: a stand-in for a topic where a table has none."""
    t = F.coalesce(F.col(text), F.lit(""))
    return (
        F.when(t.contains(" | "), "list")
        .when(t.contains("!!"), "shout")
        .when(t.contains("***"), "signs")
        .when(t.contains("icense"), "licence")
        .when(t.contains("@"), "contact")
        .otherwise("prose")
    )


def words(text: str) -> Column:
    """Words between ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


#: Production targets of the registered query and the pipeline; both keep the languages that are not listed (``unlisted``).
TARGETS: dict[str, Target] = {"source": 0.7, "lang": {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.15}, "topic": 0.9}
BUDGET = 0.8
ROUNDS = 10


def oracle_sql() -> str:
    """The registered query in DuckDB SQL, its rounds written out."""
    steps = []
    for k in range(ROUNDS):
        for i, c in enumerate(TARGETS):
            before = f"w{k}_{i - 1}" if i else (f"w{k - 1}_{len(TARGETS) - 1}" if k else "w")
            steps.append(f"w{k}_{i} as materialized (select * exclude (w), case when sum(w) over (partition by {c}) > 0 then w * t{i} / sum(w) over (partition by {c}) else 0 end as w from {before})")
    raws = []
    for i, (c, t) in enumerate(TARGETS.items()):
        listed = f"case {c} " + " ".join(f"when '{v}' then {s}" for v, s in t.items()) + " end" if isinstance(t, dict) else f"pow(sum(mass), {t})"
        raws.append(f"q{i} as (select {c}, sum(mass) as m, {listed} as l from cells group by {c})")
        # a value that is not listed keeps its own share: it counts as the listed ones do for the same mass
        each = f"coalesce((select nullif(sum(l), 0) / nullif(sum(m), 0) from q{i} where l is not null and m > 0), 1.0)"
        raws.append(f"r{i} as (select {c}, case when m <= 0 then 0.0 when l is null then m * {each} else l end as raw from q{i}), s{i} as (select {c}, raw / sum(raw) over () as t{i} from r{i})")
    joins = " ".join(f"join s{i} on c.{c} is not distinct from s{i}.{c}" for i, c in enumerate(TARGETS))
    last = f"w{ROUNDS - 1}_{len(TARGETS) - 1}"
    return f"""
with docs as (select doc_id, source, lang,
  case when contains(t, ' | ') then 'list' when contains(t, '!!') then 'shout' when contains(t, '***') then 'signs'
   when contains(t, 'icense') then 'licence' when contains(t, '@') then 'contact' else 'prose' end as topic,
  len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+'))::bigint as n_tokens
  from (select *, coalesce(text, '') as t from documents)),
cells as (select source, lang, topic, sum(n_tokens)::double as mass from docs group by all),
{", ".join(raws)},
w as (select c.*, {", ".join(f"t{i}" for i in range(len(TARGETS)))}, mass / sum(mass) over () as w from cells c {joins}),
{", ".join(steps)},
ratios as (select *, case when mass > 0 then w * sum(mass) over () / mass else 0 end as ratio from {last}),
cuts as (select ratio, ({BUDGET} * (select sum(mass) from ratios) - coalesce(sum(mass) over (order by ratio desc, source, lang, topic rows between unbounded preceding and 1 preceding), 0))
  / nullif(sum(mass * ratio) over (order by ratio desc, source, lang, topic rows between current row and unbounded following), 0) as c,
  row_number() over (order by ratio desc, source, lang, topic) as k from ratios),
scale as (select coalesce(min_by(c, k) filter (where c * ratio <= 1), 1e300) as c from cuts),
p as (select source, lang, topic, least(1.0, ratio * c) as p from ratios, scale)
select d.doc_id, d.topic, d.n_tokens, round(p.p, 6) as probability,
  ('0x' || substr(md5('1:' || coalesce(d.doc_id::varchar, '')), 1, 13))::bigint / pow(2.0, 52) < p.p as kept
from docs d join p on d.source is not distinct from p.source and d.lang is not distinct from p.lang and d.topic is not distinct from p.topic
"""
