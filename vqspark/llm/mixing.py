"""Mixing sources to target weights: raking of token weights and calibrated sampling.

Documents fall into cells of source, language and topic. Iterative proportional
fitting scales the tokens of the cells until the three marginals have their
target shares; each document is then drawn with a probability in proportion to
the factor of its cell, so that a given share of all tokens is expected. Targets
are given as a table, or follow from the corpus's own shares. Only DataFrame
functions are used; what iterates is the table of cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vqspark.llm.graph import cut

DIMENSIONS = ("source", "lang", "topic")
#: Target share of a value without a given one: its own share of the tokens to this power, scaled to sum to one.
POWERS = {"source": 0.5, "lang": 0.7, "topic": 0.8}
#: Share of all tokens that is expected to be kept.
KEEP = 0.5
#: Sweeps at most; between checks; and the relative gap of a marginal at which they end.
SWEEPS, CHECK, TOLERANCE = 200, 4, 1e-12
#: Up to this many cells (about 120 bytes each) are fitted in one task and broadcast; beyond it both shuffle.
FEW_CELLS = 50_000


def n_tokens(text: Column) -> Column:
    """Words between white space, and one for the end of the text."""
    return (F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")) + 1).cast("long")


def topic_of(text: Column) -> Column:
    """A topic for tables that have none: ``table``, ``figures`` (a number of four digits or more) or ``prose``."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.contains(text, F.lit(" | ")), "table").when(text.rlike("[0-9]{4}"), "figures").otherwise("prose")


def _labels(docs: DataFrame, text_col: str) -> list[Column]:
    topic = F.coalesce(F.col("topic").cast("string"), F.lit("")) if "topic" in docs.columns else topic_of(F.col(text_col))
    own = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"mix_{c}") for c in ("source", "lang")]
    return [*own, topic.alias("mix_topic"), n_tokens(F.col(text_col)).alias("mix_tokens")]


def _with_sum(cells: DataFrame, by: str, value: Column, name: str, few: bool) -> DataFrame:
    """``cells`` with the sum of ``value`` over those that share ``by``. Few are one partition, which needs no exchange; others are summed up and joined back."""
    if few:
        return cells.withColumn(name, F.sum(value).over(Window.partitionBy(by)))
    return cells.join(cells.groupBy(by).agg(F.sum(value).alias(name)), by)


def _with_targets(cells: DataFrame, powers: dict[str, float], targets: DataFrame | None, total: int, few: bool) -> DataFrame:
    """Adds ``_t_<dimension>``, the tokens that each cell's value should have."""
    for d in DIMENSIONS:
        name, known = f"_t_{d}", None
        if targets is not None:
            known = targets.where((F.col("dimension") == d) & (F.col("share") > 0)).groupBy(F.coalesce(F.col("value").cast("string"), F.lit("")).alias(d)).agg(F.sum("share").alias("_share"))
            if known.isEmpty():
                known = None
        if known is not None:
            absent = known.join(cells.select(d).distinct(), d, "left_anti").limit(5).collect()
            if absent:
                raise ValueError(f"no document has the {d} that should have a share: {', '.join(repr(r[d]) for r in absent)}")
            whole = known.agg(F.sum("_share")).first()[0]
            cells = cells.join(known, d, "left").withColumn(name, F.coalesce(F.col("_share"), F.lit(0.0)) / whole * total).drop("_share")
            cells = cut(cells.coalesce(1)) if few else cut(cells)
        else:
            own = cells.groupBy(d).agg(F.pow(F.sum("tokens").cast("double"), F.lit(powers[d])).alias("_own"))
            whole = own.agg(F.sum("_own")).first()[0]
            cells = _with_sum(cells, d, F.col("tokens"), "_own", few)
            cells = cells.withColumn(name, F.pow(F.col("_own").cast("double"), F.lit(powers[d])) / whole * total).drop("_own")
            cells = cells if few else cut(cells)
    return cells


def rake(cells: DataFrame, powers: dict[str, float] = POWERS, targets: DataFrame | None = None, few: bool = True, sweeps: int = SWEEPS, tolerance: float = TOLERANCE) -> tuple[DataFrame, float]:
    """``cells(source, lang, topic, tokens)`` with the factor ``g`` of the fit, 1 on average over tokens; and the largest relative gap.

    Ends when no marginal is further from its target than ``tolerance``, or after ``sweeps``.
    """
    total = cells.agg(F.sum("tokens")).first()[0]
    if total is None:
        return cells.withColumn("g", F.lit(1.0)), 0.0
    now = _with_targets(cells.coalesce(1) if few else cells, powers, targets, total, few).withColumn("g", F.lit(1.0))
    gap = float("inf")
    for sweep in range(1, sweeps + 1):
        gaps = []
        for d in DIMENSIONS:
            now = _with_sum(now, d, F.col("tokens") * F.col("g"), "_had", few)
            if sweep % CHECK == 0 or sweep == sweeps:
                # how far each marginal is off when its turn comes: all are fitted when none is
                now = now.withColumn(f"_gap_{d}", F.when(F.col(f"_t_{d}") > 0, F.abs(F.col("_had") / F.col(f"_t_{d}") - 1)).otherwise(0.0))
                gaps.append(f"_gap_{d}")
            now = now.withColumn("g", F.when(F.col("_had") > 0, F.col("g") * F.col(f"_t_{d}") / F.col("_had")).otherwise(0.0)).drop("_had")
            now = now if few else cut(now)  # the next sum and the join with it both begin here
        if gaps:
            now = cut(now) if few else now
            gap = now.agg(F.max(F.greatest(*gaps))).first()[0]
            now = now.drop(*gaps)
            now = now.coalesce(1) if few else now
            if gap <= tolerance:
                break
    return now.select(*DIMENSIONS, "tokens", "g"), gap


def calibrate(cells: DataFrame, keep: float) -> DataFrame:
    """Adds ``p``, the least of 1 and a multiple of ``g``, such that ``keep`` of the tokens are expected.

    Cells whose multiple would exceed 1 are set to 1 and the multiple for the
    others follows, until no more do: a few sums over all cells.
    """
    total = cells.agg(F.sum("tokens")).first()[0]
    if total is None:
        return cells.withColumn("p", F.lit(1.0))
    multiple = 0.0
    while True:
        full = F.col("g") * F.lit(multiple) > 1
        at_one, rest, n = cells.agg(F.sum(F.when(full, F.col("tokens")).otherwise(0)), F.sum(F.when(full, 0.0).otherwise(F.col("tokens") * F.col("g"))), F.count(F.when(full, 1))).first()
        new = (keep * total - at_one) / rest if rest and rest > 0 else float(1 << 60)
        if new <= multiple * (1 + 1e-12):
            break
        multiple = new
    return cells.withColumn("p", F.when(F.col("g") > 0, F.least(F.lit(1.0), F.col("g") * F.lit(multiple))).otherwise(0.0))


def uniform(id_col: Column, text: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the id, or the text where the id is null."""
    name = F.coalesce(id_col.cast("string"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), name).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def _fit(rows: DataFrame, keep: float, powers: dict[str, float], targets: DataFrame | None, sweeps: int) -> DataFrame:
    """Factor and probability of each cell of labelled rows, to be joined to them."""
    names = [f"mix_{d}" for d in DIMENSIONS]
    cells = cut(rows.groupBy(*(F.col(n).alias(d) for n, d in zip(names, DIMENSIONS))).agg(F.sum("mix_tokens").alias("tokens")))
    few = cells.limit(FEW_CELLS + 1).count() <= FEW_CELLS
    raked, gap = rake(cells, powers, targets, few, sweeps)
    if gap > 1e-3 and targets is not None:
        raise ValueError(f"no weights give all targets at once: a share is off by {gap:.1%} after {sweeps} sweeps")
    fitted = cut(calibrate(cut(raked), keep))
    fitted = fitted.select(*(F.col(d).alias(n) for n, d in zip(names, DIMENSIONS)), F.col("g").alias("mix_weight"), F.col("p").alias("mix_probability"))
    return F.broadcast(fitted) if few else fitted


OWN = (*(f"mix_{d}" for d in DIMENSIONS), "mix_tokens", "mix_weight", "mix_probability", "mix_sampled")


def mix(docs: DataFrame, keep: float = KEEP, powers: dict[str, float] = POWERS, targets: DataFrame | None = None, sweeps: int = SWEEPS, seed: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``mix_source, mix_lang, mix_topic, mix_tokens, mix_weight, mix_probability, mix_sampled``.

    ``targets(dimension, value, share)`` holds the wanted shares of tokens of the
    values of ``source``, ``lang`` or ``topic``; the shares of a dimension are
    scaled to sum to one, and values that it doesn't name get none. A dimension
    without rows there follows ``powers``. Shares for values that no document has,
    and targets that can't be met together, raise ``ValueError``. A null source or
    language is a category of its own, together with the empty one; an empty or
    null text has one token. ``mix_weight`` is the raking factor,
    ``mix_probability`` that of being sampled. Rows that repeat an id are sampled
    together; rows with a null id by their text. Columns of these names in
    ``docs`` are replaced. An empty table gives an empty table.
    """
    own = docs.drop(*OWN)
    rows = own.select("*", *_labels(own, text_col))
    fitted = _fit(rows, keep, powers, targets, sweeps)
    joined = rows.join(fitted, [f"mix_{d}" for d in DIMENSIONS])
    return joined.withColumn("mix_sampled", uniform(F.col(id_col), F.col(text_col), seed) < F.col("mix_probability"))


def mix_weights(docs: DataFrame, keep: float = KEEP, powers: dict[str, float] = POWERS, targets: DataFrame | None = None, sweeps: int = SWEEPS, seed: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same without the documents: ``doc_id`` and the columns of :func:`mix`, one row per input row. Texts are looked at once."""
    own = docs.drop(*OWN)
    draw = uniform(F.col(id_col), F.col(text_col), seed).alias("_draw")
    rows = cut(own.select(F.col(id_col).alias("doc_id"), *_labels(own, text_col), draw))
    joined = rows.join(_fit(rows, keep, powers, targets, sweeps), [f"mix_{d}" for d in DIMENSIONS])
    return joined.withColumn("mix_sampled", F.col("_draw") < F.col("mix_probability")).drop("_draw")


def mix_sql(keep: float = KEEP, powers: dict[str, float] = POWERS, sweeps: int = 100, seed: int = 8) -> str:
    """The same in SQL over ``documents``, the sweeps written out: as many as bring the fit to its end."""
    steps = []
    for i in range(sweeps):
        for k, d in enumerate(DIMENSIONS):
            n = 3 * i + k
            steps.append(f"f{n + 1} AS MATERIALIZED (SELECT source, lang, topic, tokens, t_source, t_lang, t_topic, everything, g * t_{d} * everything / sum(tokens * g) OVER (PARTITION BY {d}) AS g FROM f{n})")
    shares = ", ".join(f"pow(m_{d}::DOUBLE, {powers[d]}) / sum(pow(m_{d}::DOUBLE, {powers[d]}) / n_{d}) OVER () AS t_{d}" for d in DIMENSIONS)
    sums = ", ".join(f"sum(tokens) OVER (PARTITION BY {d}) AS m_{d}, count(*) OVER (PARTITION BY {d}) AS n_{d}" for d in DIMENSIONS)
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang,
    CASE WHEN contains(coalesce(text, ''), ' | ') THEN 'table' WHEN regexp_matches(coalesce(text, ''), '[0-9]{{4}}') THEN 'figures' ELSE 'prose' END AS topic,
    (len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) + 1)::BIGINT AS n_tokens FROM documents
), c AS (SELECT source, lang, topic, sum(n_tokens)::BIGINT AS tokens FROM d GROUP BY ALL
), m AS (SELECT *, {sums} FROM c
), f0 AS (SELECT source, lang, topic, tokens, {shares}, (sum(tokens) OVER ())::DOUBLE AS everything, 1.0::DOUBLE AS g FROM m
), {", ".join(steps)}, o AS (
  SELECT *, row_number() OVER w AS k, ({keep} * everything - coalesce(sum(tokens) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(tokens * g) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS c FROM f{3 * sweeps} WINDOW w AS (ORDER BY g DESC, source, lang, topic)
), x AS (SELECT c AS multiple FROM o WHERE c * g <= 1 ORDER BY k LIMIT 1
), p AS (SELECT source, lang, topic, g, least(1.0::DOUBLE, coalesce((SELECT multiple FROM x) * g, 1.0::DOUBLE)) AS p FROM o)
SELECT doc_id, source, lang, topic, n_tokens, round(g, 6) AS weight, round(p, 6) AS probability,
  ('0x' || substr(md5('{seed}:' || doc_id::VARCHAR), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE < p AS sampled
FROM d JOIN p USING (source, lang, topic)
"""
