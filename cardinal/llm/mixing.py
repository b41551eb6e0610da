"""Mixing sources to target weights by iterative proportional fitting.

Token weights are summed per cell (source, language, topic). Raking scales the cells, one dimension after another, until
their sums along each dimension meet the targets at `token_share` of all tokens; a cell's probability is its fitted weight
over its own. No cell can give more than it has: a value whose target is beyond its tokens is kept whole and the other
values of its dimension rise for it, and where a value is scaled up its full cells stay at 1 while the others rise. Documents
are then drawn by their cell's probability, by a hash of the id, so that the draw is the same however the rows are dealt.

Targets: per dimension a map from value to share; without one, shares are the observed ones raised to `temperature` (below
1 flattens the mix). Target values that don't occur are left out first. The others are rescaled only if they leave nothing
for the values without a target, which keep their observed share of what is left.

The topic is the column `topic` if there is one. Else it is a stand-in, the text's shape: table, shout, marked, note, essay
or prose, from counts of its characters; it says nothing about what the text is about.

Edge cases: a null source, language or topic is a value of its own; a null or empty text weighs one token; a null id is
drawn by the hash of its text; repeated rows are drawn alike; an empty table stays empty; other columns stay as they are.
Fitting runs on the driver up to DRIVER_CELLS cells (counted) and on DataFrames, written out each round, beyond that; both
follow the same steps.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardinal.llm.columnar import per_document, small_batches, text_column, text_slices
from cardinal.llm.staging import dropped, staged

DIMENSIONS = ("source", "lang", "topic")
#: Cells of the contingency table that the driver fits; a cell is about 100 bytes.
DRIVER_CELLS = 100_000
ROUNDS, TOLERANCE = 50, 1e-6
#: A probability that counts as 1: such a cell isn't scaled up any more.
FULL = 1 - 1e-9
BYTES_PER_TOKEN = 4
TEMPERATURE = 0.7
#: Share of all tokens to be drawn.
TOKEN_SHARE = 0.8
TOPICS = ("table", "shout", "marked", "note", "essay", "prose")

#: Byte classes: a character's first byte, capital, small, mark, bar.
_FIRST, _CAPITAL, _SMALL, _MARK, _BAR = 1, 2, 4, 8, 16
_KIND = np.array([_FIRST * (b & 0xC0 != 0x80) | _CAPITAL * (65 <= b <= 90) | _SMALL * (97 <= b <= 122) | _MARK * (chr(b) in "#*$%&<>") | _BAR * (b == 124) for b in range(256)], np.uint8)


def topic_codes(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The place in TOPICS of each text's shape."""
    kind = _KIND[raw]
    size, capitals, small, marks, bars = (per_document(kind & k > 0, offsets) for k in (_FIRST, _CAPITAL, _SMALL, _MARK, _BAR))
    return np.select([bars * 40 > size, capitals > small, marks * 40 > size, size < 400, size > 6000], range(5), 5)


def topic_of(text: Column) -> Column:
    @F.arrow_udf("int")
    def code(column: pa.Array) -> pa.Array:
        slices = [topic_codes(raw, offsets) for _, _, raw, offsets in text_slices(column)]
        return pa.array(np.concatenate(slices) if slices else [], pa.int32())

    return F.element_at(F.array(*map(F.lit, TOPICS)), code(text) + 1)


def token_weight(text: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.octet_length(text) / BYTES_PER_TOKEN)).cast("bigint")


def uniform(key: Column) -> Column:
    """A number in [0, 1) from a hash of the key."""
    return F.pmod(F.xxhash64(key, F.lit("mix")), F.lit(1 << 40)) / F.lit(float(1 << 40))


def shares_of(observed: np.ndarray, target: np.ndarray | None, temperature: float) -> np.ndarray:
    """The aimed share of each value. observed: its weight; target: its share, NaN where it has none."""
    if target is None:
        flat = (observed / observed.sum()) ** temperature
        return flat / flat.sum()
    named = ~np.isnan(target)
    rest = observed[~named].sum()
    left = max(0.0, 1.0 - target[named].sum()) if rest else 0.0
    aim = np.where(named, target, left * observed / rest if rest else 0.0)
    return aim / aim.sum() if aim.sum() else observed / observed.sum()


def amounts(available: np.ndarray, share: np.ndarray, wanted: float) -> np.ndarray:
    """min(available, c * share) with the c at which they sum up to wanted, as far as there is that much."""
    ratio = np.divide(available, share, out=np.full(len(share), np.inf), where=share > 0)
    order = np.argsort(ratio, kind="stable")
    whole = np.append(0.0, np.cumsum(available[order]))[:-1]
    rest = np.cumsum(share[order][::-1])[::-1]
    c = np.divide(wanted - whole, rest, out=np.full(len(share), np.inf), where=rest > 0)
    fits = np.flatnonzero((rest > 0) & (c <= ratio[order]))
    return np.minimum(available, c[fits[0]] * share) if len(fits) else np.where(share > 0, available, 0.0)


def rake(weights: np.ndarray, codes: list[np.ndarray], aims: list[np.ndarray], start: float) -> np.ndarray:
    """The probability of each cell: from `start` for all, each dimension's values are scaled to their aims in turn, no cell beyond 1."""
    p = np.full(len(weights), start)
    total = weights.sum()
    for _ in range(ROUNDS):
        worst = 0.0
        for code, aim in zip(codes, aims, strict=True):
            full = p >= FULL
            whole = np.bincount(code, np.where(full, weights, 0), len(aim))
            part = np.bincount(code, np.where(full, 0, weights * p), len(aim))
            worst = max(worst, float(np.abs(whole + part - aim).max()) / total)
            p = _scaled(p, full, whole[code], part[code], aim[code])
        if worst < TOLERANCE:
            break
    return p


def _scaled(p: np.ndarray, full: np.ndarray, whole: np.ndarray, part: np.ndarray, aim: np.ndarray) -> np.ndarray:
    down = np.divide(aim, whole + part, out=np.zeros(len(p)), where=whole + part > 0)
    up = np.divide(aim - whole, part, out=np.ones(len(p)), where=part > 0)
    return np.minimum(1.0, p * np.where(aim < whole + part, down, np.where(full, 1.0, up)))


def _fit_small(cells: DataFrame, targets: dict, temperature: float, token_share: float) -> DataFrame:
    rows = cells.collect()
    weights = np.array([float(r["weight"]) for r in rows])
    codes, aims = [], []
    for d in DIMENSIONS:
        values = sorted({r[d] for r in rows}, key=lambda v: (v is not None, str(v)))
        place = {v: i for i, v in enumerate(values)}
        codes.append(np.array([place[r[d]] for r in rows]))
        observed = np.bincount(codes[-1], weights)
        target = None if targets.get(d) is None else np.array([float(targets[d].get(v, np.nan)) for v in values])
        aims.append(amounts(observed, shares_of(observed, target, temperature), token_share * weights.sum()))
    p = rake(weights, codes, aims, token_share)
    return cells.sparkSession.createDataFrame([(*(r[d] for d in DIMENSIONS), int(r["weight"]), float(x)) for r, x in zip(rows, p, strict=True)], "source string, lang string, topic string, weight bigint, factor double")


def _fit_large(cells: DataFrame, targets: dict, temperature: float, token_share: float) -> DataFrame:
    """The same fit on DataFrames: each round joins every cell with the sums of its dimension's values."""
    spark, wanted = cells.sparkSession, token_share * cells.agg(F.sum("weight")).first()[0]

    def aims(d: str) -> DataFrame:
        observed = cells.groupBy(F.col(d).alias("value")).agg(F.sum("weight").cast("double").alias("has"))
        target = targets.get(d)
        if target is None:
            raw = observed.withColumn("share", F.pow("has", F.lit(temperature)))
        else:
            listed = spark.createDataFrame([(k, float(v)) for k, v in target.items()], "named string, aim double")
            raw = staged(observed.join(listed, observed["value"].eqNullSafe(listed["named"]), "left").select("value", "has", "aim"))
            named, rest = raw.agg(F.coalesce(F.sum("aim"), F.lit(0.0)), F.coalesce(F.sum(F.when(F.col("aim").isNull(), F.col("has"))), F.lit(0.0))).first()
            left = max(0.0, 1.0 - named) if rest else 0.0
            raw = raw.withColumn("share", F.coalesce("aim", F.lit(left) * F.col("has") / F.lit(rest or 1.0)) if named or left else F.col("has"))
        raw = staged(raw.select("value", "has", "share"))
        c = 0.0
        while True:  # values are full at a level, which makes the next level higher
            full = F.col("share") * c >= F.col("has")
            kept, open_ = raw.where("share > 0").agg(F.coalesce(F.sum(F.when(full, F.col("has"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("share"))), F.lit(0.0))).first()
            new = (wanted - kept) / open_ if open_ else float("inf")
            if new <= c * (1 + 1e-12) or not open_:
                break
            c = new
        c = c if open_ else 1e300
        return staged(raw.select("value", F.least("has", F.lit(c) * F.col("share")).alias("aim")))

    goals = {d: aims(d) for d in DIMENSIONS}
    fitted = staged(cells.withColumn("p", F.lit(float(token_share))))
    total = wanted / token_share
    for _ in range(ROUNDS):
        worst = 0.0
        for d in DIMENSIONS:
            full = F.col("p") >= FULL
            now = fitted.groupBy(F.col(d).alias("v")).agg(F.sum(F.when(full, F.col("weight")).otherwise(0)).cast("double").alias("whole"), F.sum(F.when(full, 0.0).otherwise(F.col("weight") * F.col("p"))).alias("part"))
            now = staged(now.join(goals[d], now["v"].eqNullSafe(goals[d]["value"])).drop("value"))
            worst = max(worst, (now.agg(F.max(F.abs(F.col("whole") + F.col("part") - F.col("aim")))).first()[0] or 0.0) / total)
            down = F.when(F.col("whole") + F.col("part") > 0, F.col("aim") / (F.col("whole") + F.col("part"))).otherwise(0.0)
            up = F.when(F.col("part") > 0, (F.col("aim") - F.col("whole")) / F.col("part")).otherwise(1.0)
            scale = F.when(F.col("aim") < F.col("whole") + F.col("part"), down).when(full, 1.0).otherwise(up)
            new = staged(fitted.join(now, fitted[d].eqNullSafe(now["v"])).select(*DIMENSIONS, "weight", F.least(F.lit(1.0), F.col("p") * scale).alias("p")))
            dropped(fitted, now)
            fitted = new
        if worst < TOLERANCE:
            break
    return fitted.withColumnRenamed("p", "factor")


def described(docs: DataFrame, text_col: str = "text") -> list[Column]:
    """Source, language, topic and token weight of each row."""
    small_batches(docs.sparkSession)
    text = text_column(text_col)
    named = [F.col(d).cast("string").alias(d) if d in docs.columns else F.lit(None).cast("string").alias(d) for d in DIMENSIONS[:2]]
    topic = F.col("topic").cast("string") if "topic" in docs.columns else topic_of(text)
    return [*named, topic.alias("topic"), token_weight(text).alias("weight")]


def factors_of(rows: DataFrame, targets: dict[str, dict] | None = None, temperature: float = TEMPERATURE, driver_cells: int = DRIVER_CELLS, token_share: float = TOKEN_SHARE) -> tuple[DataFrame, bool]:
    """(source, lang, topic, weight, factor): the probability of each cell of rows with those dimensions and a weight; and whether the cells are few."""
    cells = staged(rows.groupBy(*DIMENSIONS).agg(F.sum("weight").alias("weight")))
    n = cells.count()
    if n == 0:
        return cells.withColumn("factor", F.lit(1.0)), True
    return (_fit_small if n <= driver_cells else _fit_large)(cells, targets or {}, temperature, token_share), n <= driver_cells


def cell_factors(docs: DataFrame, targets: dict[str, dict] | None = None, temperature: float = TEMPERATURE, text_col: str = "text", driver_cells: int = DRIVER_CELLS, token_share: float = TOKEN_SHARE) -> DataFrame:
    """(source, lang, topic, weight, factor): the calibrated probability of each cell."""
    return factors_of(docs.select(*described(docs, text_col)), targets, temperature, driver_cells, token_share)[0]


def reached(factors: DataFrame) -> DataFrame:
    """(dimension, value, share): the share of the drawn tokens that each value is expected to have, to be held against its target."""
    each = F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in DIMENSIONS)))
    sums = factors.select(each.alias("e"), (F.col("weight") * F.col("factor")).alias("w")).groupBy("e.dimension", "e.value").agg(F.sum("w").alias("w"))
    total = factors.agg(F.sum(F.col("weight") * F.col("factor")).alias("all"))
    return sums.crossJoin(F.broadcast(total)).select("dimension", "value", (F.col("w") / F.col("all")).alias("share"))  # total is one row


def _met(rows: DataFrame, factors: DataFrame, few: bool, how: str) -> DataFrame:
    side = (F.broadcast(factors) if few else factors).select(*(F.col(d).alias(f"f_{d}") for d in DIMENSIONS), F.col("factor").alias("probability"))
    return rows.join(side, reduce(lambda a, b: a & b, (F.col(d).eqNullSafe(F.col(f"f_{d}")) for d in DIMENSIONS)), how)


def probabilities(docs: DataFrame, targets: dict[str, dict] | None = None, temperature: float = TEMPERATURE, id_col: str = "doc_id", text_col: str = "text", driver_cells: int = DRIVER_CELLS, token_share: float = TOKEN_SHARE) -> DataFrame:
    """id, source, lang, topic, weight, probability and drawn for each row. Texts are read once."""
    key = F.coalesce(F.col(id_col).cast("string"), text_column(text_col))
    rows = staged(docs.select(F.col(id_col).alias("id"), uniform(key).alias("u"), *described(docs, text_col)))
    met = _met(rows, *factors_of(rows, targets, temperature, driver_cells, token_share), "left")
    return met.select(F.col("id").alias(id_col), *DIMENSIONS, "weight", "probability", (F.col("u") < F.col("probability")).alias("drawn"))


def draw(docs: DataFrame, targets: dict[str, dict] | None = None, temperature: float = TEMPERATURE, id_col: str = "doc_id", text_col: str = "text", driver_cells: int = DRIVER_CELLS, token_share: float = TOKEN_SHARE) -> DataFrame:
    """The rows of docs that are drawn, with their own columns."""
    found = factors_of(docs.select(*described(docs, text_col)), targets, temperature, driver_cells, token_share)
    key = F.coalesce(F.col(id_col).cast("string"), text_column(text_col))
    rows = docs.select(F.struct("*").alias("row"), uniform(key).alias("u"), *described(docs, text_col)[:3])
    return _met(rows, *found, "inner").where("u < probability").select("row.*")
