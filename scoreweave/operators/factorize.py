"""Factor models of the score table: baselines, Bayesian factorization by Gibbs sampling, predictions.

The model is ``score ~ N(u_entity . v_item, 1/alpha)`` with unit normal priors on the vectors, whose prior
mean may be a linear map of side features. Every full conditional is normal, so a half-sweep is one join, one
``groupBy`` of sums and a batched small solve.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreweave.operators.spread import ranked
from scoreweave.session import cut_lineage, delete_table, new_table_path, written

_SHARE = 1_000_000  # observations of one id that meet its vector in one task
_BUCKET_ROWS = 2_000_000  # observations of one bucket of the laid-out table
_TASK_ROWS = 100_000  # fewer are not worth a bucket of their own
_FEW = 16 << 20  # bytes of the vectors of a side that every task gets
_PAIRS = 32  # pairs of blocks of a full matrix in one task: Spark hands them to Python all at once
_DENSE = 1000  # features of a side whose weights are solved for in one place (8 MB); more go through a distributed solver
_TOLERANCE = 1e-11  # residual of the distributed solver, as a share of the right-hand side
_VEC = "id string, vec array<double>"


def _dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


# ---- baselines -------------------------------------------------------------------------------------------


def global_mean(cells: DataFrame, train: DataFrame) -> DataFrame:
    """Observed cells keep their score, the others get the mean of all scores."""
    mean = train.select(F.avg("score")).scalar()
    seen = train.select("entity", "item", "score")
    return cells.join(seen, ["entity", "item"], "left").select("entity", "item", F.coalesce("score", mean).alias("prediction"))


def uniform_random(cells: DataFrame, train: DataFrame, seed: int = 42) -> DataFrame:
    """Observed cells keep their score, the others get a draw between the lowest and highest score. The draw
    is made of 13 hex digits of md5(seed:entity:item): it does not depend on partitioning."""
    low, high = train.select(F.min("score")).scalar(), train.select(F.max("score")).scalar()
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), "entity", "item").cast("binary")), 1, 13)
    lot = (F.conv(digits, 16, 10).cast("double") + 0.5) / 2.0**52
    seen = train.select("entity", "item", "score")
    rows = cells.join(seen, ["entity", "item"], "left").select("entity", "item", "score", lot.alias("_u"))
    rows = rows.withColumn("_low", low).withColumn("_high", high)
    drawn = F.col("_low") + F.col("_u") * (F.col("_high") - F.col("_low"))
    return rows.select("entity", "item", F.coalesce("score", drawn).alias("prediction"))


def mean_of_means(cells: DataFrame, train: DataFrame) -> DataFrame:
    """Mean of the global, entity and item mean for every cell; a mean without scores is left out."""
    overall = train.select(F.avg("score")).scalar()
    by_entity = train.groupBy("entity").agg(F.avg("score").alias("_e"))
    by_item = train.groupBy("item").agg(F.avg("score").alias("_i"))
    rows = cells.join(by_entity, "entity", "left").join(by_item, "item", "left").withColumn("_g", overall)
    total = F.col("_g") + F.coalesce("_e", F.lit(0.0)) + F.coalesce("_i", F.lit(0.0))
    n = 1 + F.when(F.col("_e").isNull(), 0).otherwise(1) + F.when(F.col("_i").isNull(), 0).otherwise(1)
    return rows.select("entity", "item", (total / n).alias("prediction"))


# ---- Gibbs sampler ---------------------------------------------------------------------------------------


def _normals(dim: int, key: str) -> str:
    """SQL for an array of standard normals that depend on the text ``key`` alone, never on partitioning.

    Normal ``i`` is made (Box and Muller) of two 52-bit numbers, the hex digits 1-13 and 14-26 of md5(key:i), so that
    any engine can repeat the draws.
    """

    def uniform(first: int) -> str:
        return f"((cast(conv(substr(h, {first}, 13), 16, 10) AS DOUBLE) + 0.5D) / {2**52}D)"

    hashes = f"transform(sequence(0, {dim - 1}), i -> md5(cast(concat_ws(':', {key}, i) AS BINARY)))"
    return f"transform({hashes}, h -> sqrt(-2 * ln({uniform(1)})) * cos(2 * pi() * {uniform(14)}))"


def _hashed(dim: int, key: str) -> list[str]:
    """SQL for the bytes that ``_normals`` makes its normals of, 16 for each."""
    return [f"unhex(md5(cast(concat_ws(':', {key}, {i}) AS BINARY)))" for i in range(dim)]


def _shares(obs: DataFrame, key: str, share: int) -> DataFrame:
    """Ids with more observations than one task should take, and into how many shares they go."""
    counts = obs.groupBy(key).count().filter(F.col("count") > share)
    return cut_lineage(counts.select(key, F.ceil(F.col("count") / share).cast("int").alias("shares")))


class _Observations:
    """The observations, laid out by the ids of a side when a half-sweep first asks for it: bucketed by the id (and by
    the share of a hot id), so that neither its sums nor its vectors' meeting with the observations shuffle them."""

    def __init__(self, obs: DataFrame, share: int, *ids: DataFrame | None):
        self.spark, self.share = obs.sparkSession, share
        self.paths: dict[str, str] = {}  # of the bucketed tables, by name
        self.kept: dict[str, DataFrame] = {}
        self.hot: dict[str, DataFrame] = {}
        self.rows = obs.select(F.col("entity").cast("string").alias("entity"), F.col("item").cast("string").alias("item"), "score")
        # As many buckets as the rows (or more ids than those) need, and no more than the session's partitions while these do.
        self.n = obs.count()
        most = max([self.n, *[given.count() for given in ids if given is not None]])
        partitions = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.buckets = max(1, min(partitions, -(-most // _TASK_ROWS)), -(-most // _BUCKET_ROWS))

    def keys(self, key: str) -> list[str]:
        """What tells apart the vectors of a side when they meet the observations."""
        return [key, f"{key}_share"] if key in self.hot else [key]

    def bucketed(self, df: DataFrame, keys: Sequence[str], path: str | None = None) -> DataFrame:
        """``df`` as a table bucketed by ``keys``, one file per bucket; ``forget`` deletes it, unless ``path`` is given."""
        name = new_table_path(self.spark, "bucketed")
        table = name.rsplit("/", 1)[1].replace("-", "_")
        self.paths[table] = "" if path else name
        df.write.bucketBy(self.buckets, *keys).option("path", path or name).saveAsTable(table)
        return self.spark.table(table)

    def lay(self, df: DataFrame, *keys: str) -> DataFrame:
        # Rows are brought together by bucket before they are written.
        return self.bucketed(df.repartition(self.buckets, *keys), keys)

    def plain(self, df: DataFrame) -> DataFrame:
        """``df`` as a table of no layout, for a side of few ids: a bucket each would be a task each; ``forget`` deletes it."""
        rows, path = written(df)
        self.paths[path.rsplit("/", 1)[1].replace("-", "_")] = path
        return rows

    def by(self, key: str) -> DataFrame:
        if key not in self.kept:
            rows = self.rows
            hot = _shares(rows, key, self.share) if self.n > self.share else None
            if hot is not None and not hot.isEmpty():
                self.hot[key] = hot
                other = {"entity": "item", "item": "entity"}[key]
                place = F.pmod(F.xxhash64(other), F.coalesce("shares", F.lit(1))).cast("int").alias(f"{key}_share")
                rows = rows.join(hot, key, "left").select("entity", "item", "score", place)
            self.kept[key] = self.lay(rows, *self.keys(key))
        return self.kept[key]

    def spread(self, vectors: DataFrame, key: str) -> DataFrame:
        """One copy of a vector per share of its id; a single one for all but the hot ids."""
        rows = vectors.select(F.col("id").alias(key), "vec")
        if key not in self.hot:
            return rows
        rows = rows.join(self.hot[key], key, "left")  # a written table: its size is known to the optimizer
        share = F.explode(F.sequence(F.lit(0), F.coalesce("shares", F.lit(1)) - 1)).alias(f"{key}_share")
        return rows.select(key, "vec", share)

    def forget(self) -> None:
        for name, path in self.paths.items():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            if path:
                delete_table(self.spark, path)


def _solve(dim: int, alpha: float, shaken: bool):
    upper = np.triu_indices(dim)

    def gauss(column: pa.Array, count: int) -> np.ndarray:
        """The normals that ``_normals`` makes of the same bytes."""
        at = np.frombuffer(column.buffers()[1], np.int32)[column.offset :]  # all values have as many bytes
        words = np.frombuffer(column.buffers()[2], ">u8", 2 * count * len(column), at[0]).astype(np.uint64).reshape(-1, count, 2)
        first = words[..., 0] >> np.uint64(12)
        second = ((words[..., 0] & np.uint64(0xFFF)) << np.uint64(40)) | (words[..., 1] >> np.uint64(24))
        x, y = ((w.astype(float) + 0.5) / 2.0**52 for w in (first, second))
        return np.sqrt(-2 * np.log(x)) * np.cos(2 * np.pi * y)

    def lists(values: np.ndarray) -> pa.Array:
        ends = pa.array(np.arange(0, values.size + dim, dim, dtype=np.int32))
        return pa.ListArray.from_arrays(ends, pa.array(values.ravel()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            numbers = lambda kind: np.stack([batch.column(f"{kind}{i}").to_numpy() for i in range(dim)], axis=1)
            gram = np.zeros((n, dim, dim))
            for i, j in zip(*upper):
                gram[:, i, j] = gram[:, j, i] = batch.column(f"g{i}_{j}").to_numpy()
            precision = np.eye(dim) + alpha * gram
            z = gauss(batch.column("z"), 2 * dim if shaken else dim)
            root = np.linalg.cholesky(precision)
            right = alpha * numbers("p") + (numbers("m") if "m0" in batch.schema.names else 0.0)
            centre = np.linalg.solve(precision, right[..., None])
            vec = (centre + np.linalg.solve(np.swapaxes(root, 1, 2), z[:, :dim, None]))[..., 0]
            columns = {"id": batch.column("id"), "vec": lists(vec)}
            if shaken:
                columns["shaken"] = lists(vec + z[:, dim:])
            yield pa.RecordBatch.from_pydict(columns)

    return run


def _half_sweep(obs: _Observations, ids, other, mean, layout, key, other_key, dim, alpha, lot, shaken: bool) -> DataFrame:
    """New vectors of one side given the other side's; ``shaken`` adds those with the noise that a draw of weights needs.

    Everything an id needs is a sum. Laid out by the id itself, the observations meet the few vectors of the other side
    and are summed where they lie; else they meet the other side's vectors, and the partial sums of an id are shuffled.
    """
    pairs = [(i, j) for i in range(dim) for j in range(i, dim)]
    names = [f"g{i}_{j}" for i, j in pairs] + [f"p{i}" for i in range(dim)]
    products = [f"vec[{i}] * vec[{j}]" for i, j in pairs] + [f"score * vec[{i}]" for i in range(dim)]
    sums = [F.sum(F.expr(p)).alias(name) for p, name in zip(products, names)]
    rows = obs.by(layout)
    if layout == key:
        few = F.broadcast(other.select(F.col("id").alias(other_key), "vec"))  # at most _FEW bytes
        totals = rows.join(few, other_key, "left").groupBy(*obs.keys(key)).agg(*sums)
        if key in obs.hot:
            totals = totals.groupBy(key).agg(*[F.sum(name).alias(name) for name in names])
    else:
        vectors = obs.spread(other, other_key).hint("shuffle_hash")  # of a bucket: at most as many as it has rows
        totals = rows.join(vectors, obs.keys(other_key), "left").groupBy(key).agg(*sums)
    # Ids, sums and means are bucketed alike, and meet where they lie. Without ``ids`` those observed are all there are
    # (an observation whose other id is null adds nothing, but its own id stays).
    rows = totals.withColumnRenamed(key, "id")
    if ids is not None:
        rows = ids.join(rows.hint("shuffle_hash"), "id", "left")
    if mean is not None:
        rows = rows.join(mean.select("id", *[F.col("total")[i].alias(f"m{i}") for i in range(dim)]).hint("shuffle_hash"), "id", "left")
    means = [f"coalesce(m{i}, 0.0D) AS m{i}" for i in range(dim)] if mean is not None else []
    z = _hashed(dim, f"'{lot}', id") + (_hashed(dim, f"'{lot}', 'noise', id") if shaken else [])
    # A null id meets no sums.
    filled = rows.selectExpr("id", *[f"coalesce(if(id IS NULL, NULL, {name}), 0.0D) AS {name}" for name in names], *means, f"concat({', '.join(z)}) AS z")
    return filled.mapInArrow(_solve(dim, alpha, shaken), _VEC + (", shaken array<double>" if shaken else ""))


class _Side:
    """Side features of one side in long form, and the draw of their weights.

    Weights have unit normal priors, so given the vectors they are normal with precision ``A = I + X'X``. A draw is the
    solution of ``A w = X'(vec + e) + d`` with standard normals ``e`` per id and ``d`` per feature: its mean and its
    covariance are those of the posterior. Up to ``_DENSE`` features ``A`` is solved in one place; beyond, by conjugate
    gradients over the long table, with nothing as long as the features outside executors.
    """

    def __init__(self, features: DataFrame, dim: int, dense: int, lay: Callable[[DataFrame], DataFrame] = cut_lineage):
        self.spark, self.dim = features.sparkSession, dim
        rows = features.select(F.col("id").cast("string").alias("id"), "feature", F.col("value").cast("double").alias("value"))
        # A feature that an id has twice counts as their sum.
        self.features = lay(rows.groupBy("id", "feature").agg(F.sum("value").alias("value")))
        names = [r[0] for r in self.features.select("feature").distinct().limit(dense + 1).collect()]
        self.names = sorted(names) if len(names) <= dense else None
        if self.names is None:
            diagonal = self.features.groupBy("feature").agg((F.sum(F.col("value") * F.col("value")) + 1).alias("diag"))
            self.diagonal = cut_lineage(diagonal)
            return
        self.at = {name: i for i, name in enumerate(self.names)}
        left, right = self.features.toDF("id", "f", "x"), self.features.toDF("id", "g", "y")
        # An id has a handful of features (a size and one value per category), so this stays small per id.
        cross = left.join(right, "id").groupBy("f", "g").agg(F.sum(F.col("x") * F.col("y")).alias("s")).collect()
        self.precision = np.eye(len(self.names))
        for row in cross:
            self.precision[self.at[row["f"]], self.at[row["g"]]] += row["s"]

    def _by_feature(self, per_id: DataFrame, column: str) -> DataFrame:
        """``X' column``: per feature the sum of its values times the ids' arrays."""
        terms = [F.sum(F.col("value") * F.col(column)[k]) for k in range(self.dim)]
        return self.features.join(per_id.hint("shuffle_hash"), "id").groupBy("feature").agg(F.array(*terms).alias("total"))

    def _by_id(self, weights: DataFrame, column: str) -> DataFrame:
        """``X column``: per id the sum of its values times the features' arrays."""
        terms = [F.sum(F.col("value") * F.col(column)[k]) for k in range(self.dim)]
        return self.features.join(weights, "feature").groupBy("id").agg(F.array(*terms).alias("total"))

    def draw_weights(self, vectors: DataFrame, lot: str) -> DataFrame:
        """``(feature, w)`` given ``vectors(id, vec)``; ``lot`` names the draw. A half-sweep adds the noise itself, as ``shaken``."""
        shaken = vectors
        if "shaken" not in vectors.columns:
            shaken = vectors.selectExpr("id", "zip_with(vec, {}, (x, z) -> x + z) AS shaken".format(_normals(self.dim, f"'{lot}', 'noise', id")))
        right = self._by_feature(shaken.select("id", "shaken"), "shaken")
        right = right.selectExpr("feature", "zip_with(total, {}, (x, z) -> x + z) AS r".format(_normals(self.dim, f"'{lot}', 'feature', feature")))
        if self.names is None:
            return self._conjugate(right)
        target = np.zeros((len(self.names), self.dim))
        for row in right.collect():
            target[self.at[row["feature"]]] = row["r"]
        solved = np.linalg.solve(self.precision, target)
        return self.spark.createDataFrame(pa.table({"feature": pa.array(self.names, pa.string()), "w": pa.array(solved.tolist(), pa.list_(pa.float64()))}))

    def _conjugate(self, right: DataFrame) -> DataFrame:
        """``A w = right`` for all columns at once, preconditioned by the diagonal. One small row of products leaves
        the executors in each step; tables of earlier steps are deleted."""
        dim = self.dim

        def scaled(column: str, by: list[float], plus: str = "") -> str:
            """SQL for ``column * by + plus``, component by component."""
            parts = [f"{column}[{k}] * {by[k]!r}D" + (f" + {plus}[{k}]" if plus else "") for k in range(dim)]
            return f"array({', '.join(parts)})"

        def products(rows: DataFrame, *pairs: tuple[str, str]) -> list[np.ndarray]:
            sums = [F.coalesce(F.sum(F.expr(f"{a}[{k}] * {b}[{k}]")), F.lit(0.0)) for a, b in pairs for k in range(dim)]
            return np.array(rows.agg(F.array(*sums)).first()[0]).reshape(len(pairs), dim)

        zeros = f"array_repeat(0.0D, {dim})"
        over = "transform(r, x -> x / diag)"
        table = self.diagonal.join(right, "feature").selectExpr("feature", "diag", f"{zeros} AS x", "r", f"{over} AS p")
        state, old = written(table)
        (rz, size) = products(state.selectExpr("r", f"{over} AS z"), ("r", "z"), ("r", "r"))
        while (size > 0).any():
            image = self._by_feature(self._by_id(state.select("feature", "p"), "p").withColumnRenamed("total", "t"), "t")
            applied, path = written(state.join(image, "feature").selectExpr("*", "zip_with(total, p, (a, b) -> a + b) AS q"))
            delete_table(self.spark, old)
            (bend,) = products(applied, ("p", "q"))
            step = np.divide(rz, bend, out=np.zeros(dim), where=bend > 0).tolist()
            back = [-x for x in step]
            moved = applied.selectExpr("feature", "diag", f"{scaled('p', step, 'x')} AS x", f"{scaled('q', back, 'r')} AS r", "p")
            (new_rz, left) = products(moved.selectExpr("r", f"{over} AS z"), ("r", "z"), ("r", "r"))
            turn = np.divide(new_rz, rz, out=np.zeros(dim), where=rz > 0).tolist()
            state, old = moved.selectExpr("feature", "diag", "x", "r", f"zip_with({scaled('p', turn)}, {over}, (a, b) -> a + b) AS p"), path
            rz = new_rz
            if (left <= _TOLERANCE**2 * size).all():
                break
        return state.selectExpr("feature", "x AS w")

    def prior_means(self, weights: DataFrame) -> DataFrame:
        """``(id, total)``: the prior mean of each id with features."""
        return self._by_id(F.broadcast(weights) if self.names is not None else weights, "w")  # at most _DENSE rows


def fit_factors(
    obs: DataFrame,
    dim: int = 8,
    alpha: float = 2.0,
    init_std: float = 0.05,
    draws: int = 100,
    tune: int = 100,
    seed: int = 42,
    entity_features: DataFrame | None = None,
    item_features: DataFrame | None = None,
    entity_ids: DataFrame | None = None,
    item_ids: DataFrame | None = None,
    share: int = _SHARE,
    dense: int = _DENSE,
) -> DataFrame:
    """Posterior draws ``(side, draw, id, vec)`` of the model on ``obs(entity, item, score)``.

    ``side`` is ``u`` for entities and ``v`` for items. ``score`` should be standardized. Features are long
    tables ``(id, feature, value)``; with them the vectors are the combined ones (own part plus features).
    Ids without observations, if listed in ``entity_ids`` or ``item_ids``, are drawn from their prior.

    Each half-sweep is written to a table in the shared folder, which both ends its lineage and keeps it as a
    draw; those of the warm-up are deleted when nothing needs them any more. Random numbers depend on
    (seed, sweep, side, id) only. Weights of up to ``dense`` features are solved for in one place, see ``_Side``.
    """
    laid = _Observations(obs, share, entity_ids, item_ids)
    try:
        return _sampled(laid, dim, alpha, init_std, draws, tune, seed, entity_features, item_features, entity_ids, item_ids, dense)
    finally:
        laid.forget()


def _sampled(
    laid, dim=8, alpha=2.0, init_std=0.05, draws=100, tune=100, seed=42,
    entity_features=None, item_features=None, entity_ids=None, item_ids=None, dense=_DENSE,
) -> DataFrame:
    spark, ids, sides, size = laid.spark, {}, {}, {}
    for side, key, given in (("u", "entity", entity_ids), ("v", "item", item_ids)):
        found = laid.by("entity").select(F.col(key).alias("id"))
        if given is None:
            ids[side] = found.distinct()
        else:
            ids[side] = laid.lay(found.unionByName(given.toDF("id").select(F.col("id").cast("string").alias("id"))).distinct(), "id")
        size[side] = ids[side].count() * (8 * dim + 64)
    many, few = ("u", "v") if size["u"] >= size["v"] else ("v", "u")
    one_layout = size[few] <= _FEW  # of the larger side; else half-sweeps take turns
    small = few if one_layout else None
    for side, given in (("u", entity_ids), ("v", item_ids)):
        if side == small:
            ids[side] = laid.plain(ids[side])
        elif given is None and not one_layout:
            ids[side] = laid.lay(ids[side], "id")
    joined = {"u": ids["u"] if entity_ids is not None or not one_layout else None, "v": ids["v"] if item_ids is not None or not one_layout else None}
    for side, features in (("u", entity_features), ("v", item_features)):
        if features is not None:
            known = features.withColumn("id", F.col("id").cast("string")).join(ids[side], "id", "left_semi")
            sides[side] = _Side(known, dim, dense, laid.plain if side == small else lambda df: laid.lay(df, "id"))
    means: dict[str, DataFrame] = {}
    path = new_table_path(spark, "draws")
    start = _normals(dim, f"'{seed}:-1:v', id")
    other = ids["v"].selectExpr("id", f"transform({start}, x -> x * {init_std}D) AS vec")
    if not one_layout or few != "v":
        other = laid.lay(other, "id")
    plan = (("u", "entity", "item"), ("v", "item", "entity"))
    for sweep in range(tune + draws):
        for side, key, other_key in plan:
            lot = f"{seed}:{sweep}:{side}"
            layout = {"u": "entity", "v": "item"}[many] if one_layout else other_key
            shaken = side in sides and sweep + 1 < tune + draws  # the last sweep needs no weights of its own
            drawn = _half_sweep(laid, joined[side], other, means.get(side), layout, key, other_key, dim, alpha, lot, shaken)
            target = f"{path}/side={side}/draw={sweep}"
            if side == small:
                drawn.write.parquet(target)
                other = spark.read.schema(drawn.schema).parquet(target)
            else:
                other = laid.bucketed(drawn, ["id"], target)
            if shaken:
                means[side] = sides[side].prior_means(sides[side].draw_weights(other, lot))
            if 0 < sweep <= tune:  # the vectors of the sweep before it have served
                delete_table(spark, f"{path}/side={side}/draw={sweep - 1}")
    table = spark.read.schema(_VEC + ", side string, draw int").parquet(path)
    return table.filter(F.col("draw") >= tune).select("side", (F.col("draw") - tune).alias("draw"), "id", "vec")


def fit_pmf(obs: DataFrame, **settings) -> DataFrame:
    return fit_factors(obs, **settings)


def fit_cpmf(obs: DataFrame, entity_features: DataFrame, item_features: DataFrame, **settings) -> DataFrame:
    return fit_factors(obs, entity_features=entity_features, item_features=item_features, **settings)


def fit_map(obs: DataFrame, dim: int = 8, reg: float = 0.1, iterations: int = 10, seed: int = 42) -> DataFrame:
    """Point estimates ``(side, id, vec)`` by alternating least squares, where draws are not needed."""
    from pyspark.ml.recommendation import ALS

    def numbered(key):
        return cut_lineage(ranked(obs.select(key).distinct(), [], [F.col(key)], f"_{key}").withColumn(f"_{key}", F.col(f"_{key}").cast("int")))

    entities, items = numbered("entity"), numbered("item")
    rows = obs.join(entities, "entity").join(items, "item").select("_entity", "_item", "score")
    model = ALS(userCol="_entity", itemCol="_item", ratingCol="score", rank=dim, regParam=reg, maxIter=iterations, seed=seed).fit(rows)

    def named(factors, ids, key, side):
        found = factors.select(F.col("id").alias(f"_{key}"), F.col("features").cast("array<double>").alias("vec"))
        return found.join(ids, f"_{key}").select(F.lit(side).alias("side"), F.col(key).alias("id"), "vec")

    return named(model.userFactors, entities, "entity", "u").unionByName(named(model.itemFactors, items, "item", "v"))


# ---- using draws -----------------------------------------------------------------------------------------


def posterior_means(draws: DataFrame, dim: int) -> DataFrame:
    """Mean vector per (side, id)."""
    means = [F.avg(F.col("vec")[i]) for i in range(dim)]
    return draws.groupBy("side", "id").agg(F.array(*means).alias("vec"))


def predict(cells: DataFrame, u: DataFrame, v: DataFrame) -> DataFrame:
    """Dot product for each requested cell ``(entity, item)``; never the whole matrix. A cell whose entity or item has
    no vector stays, with a null prediction."""
    rows = cells.join(u.select(F.col("id").alias("entity"), F.col("vec").alias("_u")), "entity", "left")
    rows = rows.join(v.select(F.col("id").alias("item"), F.col("vec").alias("_v")), "item", "left")
    return rows.withColumn("prediction", _dot("_u", "_v")).drop("_u", "_v")


def predict_packed(cells: DataFrame, draws: DataFrame) -> DataFrame:
    """``cells`` with ``draws`` (numbers, ascending) and ``predictions``, one for each draw that both sides have.

    All draws of an id travel in one row, so each cell is joined once per side however many draws there are. A cell
    whose entity or item has no vector stays, with empty arrays.
    """
    packed = draws.groupBy("side", "id").agg(F.sort_array(F.collect_list(F.struct("draw", "vec"))).alias("all"))

    def side(name: str, key: str, column: str) -> DataFrame:
        return packed.filter(F.col("side") == name).select(F.col("id").alias(key), F.col("all").alias(column))

    rows = cells.join(side("u", "entity", "_u"), "entity", "left").join(side("v", "item", "_v"), "item", "left")
    # Usually both sides have the same draws; else those they share.
    mine = lambda own, other: F.filter(own, lambda d: F.array_contains(F.transform(other, lambda o: o["draw"]), d["draw"]))
    same = F.transform("_u", lambda d: d["draw"]) == F.transform("_v", lambda d: d["draw"])
    kept = F.when(same, F.struct(F.col("_u").alias("u"), F.col("_v").alias("v"))).otherwise(
        F.struct(mine(F.col("_u"), F.col("_v")).alias("u"), mine(F.col("_v"), F.col("_u")).alias("v"))
    )
    dot = lambda a, b: F.aggregate(F.zip_with(a["vec"], b["vec"], lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    rows = rows.withColumn("_kept", kept)
    numbers = F.transform(F.col("_kept.u"), lambda d: d["draw"].cast("int"))
    rows = rows.withColumns({
        "draws": F.coalesce(numbers, F.array().cast("array<int>")),
        "predictions": F.coalesce(F.zip_with("_kept.u", "_kept.v", dot), F.array().cast("array<double>")),
    })
    return rows.drop("_u", "_v", "_kept")


def predict_draws(cells: DataFrame, draws: DataFrame) -> DataFrame:
    """Prediction per cell and draw; a cell without vectors has none."""
    rows = predict_packed(cells, draws).withColumn("_d", F.explode(F.arrays_zip("draws", "predictions")))
    return rows.withColumns({"draw": F.col("_d.draws"), "prediction": F.col("_d.predictions")}).drop("_d", "draws", "predictions")


def posterior_summary(predicted: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """Mean and population deviation over the ``predictions`` of each row of ``predict_packed``, on the items' own scale
    if ``stats`` given, and ``n_draws``. Without predictions both are null; so they are for an item without stats."""
    n, all_ = F.size("predictions"), F.col("predictions")
    mean = F.aggregate(all_, F.lit(0.0), lambda s, x: s + x) / F.when(n > 0, n)
    rows = predicted.select("entity", "item", n.cast("long").alias("n_draws"), mean.alias("_mean"), "predictions")
    square = F.aggregate("predictions", F.lit(0.0), lambda s, x: s + (x - F.col("_mean")) * (x - F.col("_mean")))
    spread = F.sqrt(square / F.when(F.col("n_draws") > 0, F.col("n_draws")))
    out = rows.select("entity", "item", F.col("_mean").alias("prediction"), spread.alias("uncertainty"), "n_draws")
    if stats is None:
        return out
    return out.join(stats.select("item", "mu", "sigma"), "item", "left").select(
        "entity",
        "item",
        (F.col("prediction") * F.col("sigma") + F.col("mu")).alias("prediction"),
        (F.col("uncertainty") * F.col("sigma")).alias("uncertainty"),
        "n_draws",
    )


def running_rmse(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """Per draw and part: RMSE of that draw and of the running mean over the draws so far.

    ``predicted`` is that of ``predict_packed``, ``truth(entity, item, score, part)``. Running means are taken inside a
    row; what is shuffled for the last step is one row per task, draw and part.
    """
    rows = predicted.join(truth, ["entity", "item"])
    start = F.struct(F.lit(0.0).alias("sum"), F.array().cast("array<double>").alias("means"))
    means = F.aggregate(
        "predictions",
        start,
        lambda a, x: F.struct(
            (a["sum"] + x).alias("sum"), F.concat(a["means"], F.array((a["sum"] + x) / (F.size(a["means"]) + 1))).alias("means")
        ),
        lambda a: a["means"],
    )
    each = rows.select("part", "score", F.explode(F.arrays_zip(F.col("draws").alias("draw"), F.col("predictions").alias("p"), means.alias("m"))).alias("d"))

    def rmse(c):
        d = F.col(f"d.{c}") - F.col("score")
        return F.sqrt(F.avg(d * d))

    return each.groupBy(F.col("d.draw").alias("draw"), "part").agg(rmse("p").alias("step_rmse"), rmse("m").alias("running_rmse"))


def full_matrix(draws: DataFrame, stats: DataFrame | None = None, block: int = 1024) -> DataFrame:
    """``(entity, item, prediction, uncertainty)`` for every entity and item of ``draws(side, draw, id, vec)``: mean and
    population deviation over the draws that all ids have, on the items' own scale if ``stats(item, mu, sigma)`` given.

    A product of blocks: ``block`` ids of one side meet ``block`` ids of the other, so what is shuffled is about the
    result divided by ``block``, and no list of ids is collected. A task gets at most about 32 such pairs, however many there are. For one set of vectors give them one draw number.
    """
    packed = draws.groupBy("side", "id").agg(F.transform(F.sort_array(F.collect_list(F.struct("draw", "vec"))), lambda d: d["vec"]).alias("vecs"))
    if stats is not None:
        own = stats.select(F.col("item").alias("id"), F.struct("mu", "sigma").alias("scale"), F.lit("v").alias("side"))
        packed = packed.join(own, ["side", "id"], "left")
    else:
        packed = packed.withColumn("scale", F.lit(None).cast("struct<mu:double,sigma:double>"))
    placed = ranked(packed, ["side"], [F.col("id")], "no", total="n")
    placed = placed.select("side", F.floor((F.col("no") - 1) / block).alias("b"), F.ceil(F.col("n") / block).alias("blocks"), F.struct("id", "vecs", "scale").alias("row"))
    blocks = cut_lineage(placed.groupBy("side", "b").agg(F.collect_list("row").alias("rows"), F.max("blocks").alias("blocks")))
    sizes = {r["side"]: r["count"] for r in blocks.groupBy("side").count().collect()}
    n_items = F.lit(sizes.get("v", 0)).cast("long")
    tasks = -(-sizes.get("u", 0) * sizes.get("v", 0) // _PAIRS)
    u = blocks.filter("side = 'u'").select(F.col("rows").alias("us"), F.explode(F.sequence(F.lit(0).cast("long"), n_items - 1)).alias("b"))
    pairs = u.join(blocks.filter("side = 'v'").select("b", F.col("rows").alias("vs")), "b").select("us", "vs")
    pairs = pairs.repartition(max(1, tasks))

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for us, vs in zip(batch["us"], batch["vs"], strict=True):
                n = min(len(r["vecs"]) for rows in (us, vs) for r in rows)
                a = np.array([[v.tolist() for v in r["vecs"][:n]] for r in us])
                b = np.array([[v.tolist() for v in r["vecs"][:n]] for r in vs])
                mean, square = np.zeros((len(us), len(vs))), np.zeros((len(us), len(vs)))
                for k in range(n):  # running mean and sum of squared differences, draw by draw
                    value = a[:, k] @ b[:, k].T
                    gap = value - mean
                    mean += gap / (k + 1)
                    square += gap * (value - mean)
                spread = np.sqrt(square / n)
                if vs[0]["scale"] is not None or any(r["scale"] is not None for r in vs):
                    mu = np.array([r["scale"]["mu"] if r["scale"] is not None else np.nan for r in vs])
                    sigma = np.array([r["scale"]["sigma"] if r["scale"] is not None else np.nan for r in vs])
                    mean, spread = mean * sigma + mu, spread * sigma
                entities, items = np.array([r["id"] for r in us], object), np.array([r["id"] for r in vs], object)
                for i in range(0, len(us), 64):
                    m = mean[i : i + 64]
                    yield pd.DataFrame({
                        "entity": np.repeat(entities[i : i + 64], len(vs)), "item": np.tile(items, len(m)),
                        "prediction": m.ravel(), "uncertainty": spread[i : i + 64].ravel(),
                    })

    return pairs.mapInPandas(multiply, "entity string, item string, prediction double, uncertainty double")


def train_and_compare(
    train: DataFrame,
    test: DataFrame,
    ranges: DataFrame,
    entity_features: DataFrame,
    item_features: DataFrame,
    **settings,
) -> DataFrame:
    """Both models on the same standardized scores: ``(metric, base, new, gain)``, base without features."""
    from scoreweave.operators.metrics import improvement, metrics_long
    from scoreweave.operators.stats import item_stats

    stats = cut_lineage(item_stats(train))
    obs = train.join(stats, "item").select("entity", "item", ((F.col("score") - F.col("mu")) / F.col("sigma")).alias("score"))
    cells = test.select("entity", "item").join(train.select("entity").distinct(), "entity", "left_semi")
    truth = test.select("entity", "item", F.col("score").alias("truth"))

    def report(draws):
        summary = posterior_summary(predict_packed(cells, draws), stats)
        return metrics_long(summary.join(truth, ["entity", "item"]), ranges)

    items = cut_lineage(item_features.select("id").distinct())
    laid = _Observations(obs, settings.pop("share", _SHARE), items)  # once for both models
    try:
        base = _sampled(laid, item_ids=items, **settings)
        new = _sampled(laid, entity_features=entity_features, item_features=item_features, item_ids=items, **settings)
    finally:
        laid.forget()
    return improvement(report(base), report(new))
