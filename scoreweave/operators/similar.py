"""Nearest known entities by cosine similarity, and predictions for new entities from them."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreweave.operators.spread import first_per_key
from scoreweave.session import cut_lineage

_PAD = 1e-8  # added to every norm, and to every weight
_DIGITS = 9  # similarities that agree to nine digits are ties and go to the id
_PIVOT_BYTES = 64 << 20  # of pivot directions that every task gets: 131,072 cells of 64 dimensions
_SHELF_BYTES = 16 << 20  # of known vectors that a task holds, about
_PAIRS = 1 << 28  # of vectors that a task compares, about
_BLOCK = 2048  # known vectors compared at a time
_AT_ONCE = 1 << 20  # angles or similarities that a task holds at a time
_TRIED = 256  # new vectors on whose exact neighbours the number of hash planes is chosen


@dataclass(frozen=True)
class Hashing:
    """Random hyperplanes for an approximate search: in each of ``tables`` a vector's bucket is the signs of its
    products with that table's planes. A new vector looks into its own bucket and the ``probes`` next likely ones,
    those on the other side of the planes it is nearest to. ``bucket`` is how many known vectors a bucket should
    hold, from which follows the highest number of planes. Planes are left out, and buckets get larger, until of the exact
    neighbours of 256 new vectors at least the share ``recall`` lies in the buckets these look into; without planes the
    search is the exact one."""

    tables: int = 8
    probes: int = 8
    bucket: int = 256
    seed: int = 42
    recall: float = 0.95


def _units(vectors: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(norms == 0, 1.0, norms)


def _shrink(vectors: np.ndarray) -> np.ndarray:
    """How much padding lowers a similarity: norm / (norm + pad)."""
    norms = np.linalg.norm(vectors, axis=1)
    return norms / (norms + _PAD)


def _slices(n: int, width: int) -> Iterator[slice]:
    """Parts of ``n`` rows whose table with ``width`` columns stays small."""
    step = max(1, _AT_ONCE // max(1, width))
    return (slice(i, min(i + step, n)) for i in range(0, n, step))


def _matrix(column: pa.Array) -> np.ndarray:
    """The vectors of a column as the rows of one array."""
    lengths = pc.min_max(pc.list_value_length(column)).as_py()
    if column.null_count or lengths["min"] != lengths["max"]:
        raise ValueError("vectors must not be null and must have one length")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _floors(column: pa.Array) -> np.ndarray:
    """Similarities that are known to be reached, NaN where none is."""
    return column.cast(pa.float64()).to_numpy(zero_copy_only=False).astype(float)


def _hashed_name() -> Column:
    # Two hashes name a vector: with 128 bits, different vectors do not meet.
    return F.concat_ws(":", F.xxhash64("vec").cast("string"), F.xxhash64(F.lit(1), "vec").cast("string"))


def _named(new: DataFrame, known: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Known vectors (of equal ones the first ``k`` ids: no other can matter), new ones, and distinct new ones with a key."""
    as_double = F.col("vec").cast("array<double>").alias("vec")
    known = first_per_key(known.select(F.col("id").cast("string").alias("id"), as_double), ["vec"], [F.col("id")], k)
    wanted = new.select(F.col("id").cast("string").alias("id"), as_double)
    asked = wanted.select("vec").distinct().select(F.monotonically_increasing_id().cast("string").alias("key"), "vec")
    return cut_lineage(known), wanted, cut_lineage(asked)


def _loads(asked: DataFrame, olds: DataFrame, visits: Callable, width: int) -> list[tuple[int, int, int, int]]:
    """Per shelf that any new vector visits: its number, its first unit, into how many parts its known vectors are cut,
    and into how many its new ones. Every pair of parts is a unit, and one task compares it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch.num_rows, width):
                rows = batch.slice(part.start, part.stop - part.start)
                runs, n = np.unique(visits(_matrix(rows["vec"]), _floors(rows["floor"]))[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(runs, pa.int64()), pa.array(n, pa.int64())], ["run", "news"])

    news = asked.mapInArrow(count, "run long, news long").groupBy("run").agg(F.sum("news").alias("news"))
    sizes = olds.groupBy("shelf", "run").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("vec")).alias("numbers"))
    sizes = sizes.join(news, "run", "left").groupBy("shelf")
    sizes = sizes.agg(F.sum("numbers").alias("numbers"), F.sum(F.col("n") * F.col("news")).alias("pairs")).filter("pairs > 0")
    loads, units = [], 0
    for shelf, numbers, pairs in sorted(map(tuple, sizes.collect())):  # as many rows as shelves
        cuts = max(1, round(8 * numbers / _SHELF_BYTES))
        packs = -(-pairs // (cuts * _PAIRS))
        loads.append((shelf, units, cuts, packs))
        units += cuts * packs
    return loads


def _search(asked: DataFrame, olds: DataFrame, visits: Callable, shelf_of: Callable, width: int, k: int, block: int) -> DataFrame:
    """``(key, known_id, similarity)``: of the known vectors that a new one visits, the ``k`` best of each unit.

    ``asked(key, vec, floor)`` are new vectors and a similarity that ``k`` known ones reach, or null. ``olds(id, vec,
    shelf, run)`` are known ones: a run is visited as a whole, a shelf is what a task can hold of runs.
    ``visits(vectors, floors)`` gives rows and the runs they visit; where a shelf is compared it is told the shelf's runs.
    ``shelf_of`` gives the shelves of runs; ``width`` is how many numbers ``visits`` needs for a row.

    A vector goes to a shelf once, however many of its runs are visited. A task keeps the known vectors of its unit, and
    new ones pass by in batches; no row holds more than one vector.
    """
    loads = _loads(asked, olds, visits, width)
    if not loads:
        return asked.limit(0).select("key", F.lit("").alias("known_id"), F.lit(0.0).alias("similarity"))
    shelves, first, cuts, packs = (np.array(c) for c in zip(*loads))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch.num_rows, width):
                rows = batch.slice(part.start, part.stop - part.start)
                at, runs = visits(_matrix(rows["vec"]), _floors(rows["floor"]))
                wanted = shelf_of(runs)
                place = np.searchsorted(shelves, wanted).clip(max=len(shelves) - 1)
                met = shelves[place] == wanted  # others hold nothing that is visited
                at, place = np.divmod(np.unique(at[met] * len(shelves) + place[met]), len(shelves))
                copies = cuts[place]
                cut = np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
                at, place = np.repeat(at, copies), np.repeat(place, copies)
                deal = rows["deal"].to_numpy()[at]
                unit = first[place] + cut * packs[place] + deal % packs[place]
                for some in _slices(len(at), len(rows["vec"][0])):
                    took = rows.take(pa.array(at[some]))
                    yield pa.RecordBatch.from_arrays([pa.array(unit[some], pa.int32()), *(took[c] for c in ("key", "vec", "floor"))], ["unit", "name", "vec", "floor"])

    news = asked.withColumn("deal", F.pmod(F.xxhash64("key"), F.lit(1 << 30))).mapInArrow(send, "unit int, name string, vec array<double>, floor double")
    table = asked.sparkSession.createDataFrame([tuple(map(int, x)) for x in loads], "shelf int, first int, cuts int, packs int")
    start = F.col("first") + F.pmod(F.xxhash64("id"), F.col("cuts")).cast("int") * F.col("packs")
    olds = olds.join(F.broadcast(table), "shelf").select(  # as many rows as shelves
        F.explode(F.sequence(start, start + F.col("packs") - 1)).alias("unit"), F.col("id").alias("name"), "vec", "run"
    )
    both = olds.withColumns({"new": F.lit(False), "floor": F.lit(None).cast("double")}).unionByName(
        news.withColumns({"new": F.lit(True), "run": F.lit(None).cast("long")})
    )
    both = both.repartitionById(int((cuts * packs).sum()), "unit").sortWithinPartitions("unit", "new")
    return both.mapInArrow(_comparer(visits, width, k, block), "key string, known_id string, similarity double")


class _Shelf:
    """The known vectors of a unit, by run and id."""

    def __init__(self, batches: list[pa.RecordBatch]) -> None:
        table = pa.Table.from_batches(batches).combine_chunks()
        names, run = table["name"].chunk(0), table["run"].to_numpy()
        rank = np.empty(len(names), np.int64)
        rank[pc.array_sort_indices(names, null_placement="at_start").to_numpy()] = np.arange(len(names))
        order = np.lexsort((rank, run))
        self.names, self.rank = names.take(pa.array(order)), rank[order]
        self.vectors = _matrix(table["vec"].chunk(0))[order]
        self.vectors /= np.linalg.norm(self.vectors, axis=1, keepdims=True) + _PAD
        self.odd = np.isnan(self.vectors).any()
        self.runs, self.start = np.unique(run[order], return_index=True)
        self.stop = np.append(self.start[1:], len(order))

    def best(self, vectors: np.ndarray, floors: np.ndarray, at: np.ndarray, runs: np.ndarray, k: int, block: int):
        """Rows of ``vectors``, rows of the shelf and similarities: the ``k`` best of the runs ``runs`` that the rows
        ``at`` visit, less those known not to be among a row's best. What is no number counts as the lowest."""
        vectors = vectors / (np.linalg.norm(vectors, axis=1, keepdims=True) + _PAD)
        floors = np.where(np.isnan(floors), -np.inf, floors)
        odd = self.odd or np.isnan(vectors).any()
        place = np.searchsorted(self.runs, runs).clip(max=len(self.runs) - 1)
        met = self.runs[place] == runs
        at, place = at[met], place[met]
        order = np.argsort(place, kind="stable")
        at, place = at[order], place[order]
        held, n_held = [], 0

        def kept() -> list[tuple[np.ndarray, ...]]:
            row, old, similar = (np.concatenate(c) for c in zip(*held))
            order = np.lexsort((self.rank[old], -similar, row))
            row, old, similar = row[order], old[order], similar[order]
            nth = np.arange(len(row)) - np.searchsorted(row, row)
            full = nth == k - 1
            floors[row[full]] = np.maximum(floors[row[full]], similar[full])
            return [(row[nth < k], old[nth < k], similar[nth < k])]

        edges = np.append(np.flatnonzero(np.diff(place, prepend=-1)), len(place))
        for begin, end in zip(edges[:-1], edges[1:]):
            low, high = self.start[place[begin]], self.stop[place[begin]]
            for left in range(low, high, block):
                right = min(left + block, high)
                for part in _slices(end - begin, right - left):
                    rows = at[begin:end][part]
                    similar = vectors[rows] @ self.vectors[left:right].T
                    if odd:
                        similar[np.isnan(similar)] = -np.inf
                    blank = np.flatnonzero(np.isneginf(floors[rows]))
                    if len(blank) and right - left >= k:
                        kth = np.partition(similar[blank], right - left - k, axis=1)[:, right - left - k]
                        floors[rows[blank]] = np.round(kth, _DIGITS)
                    i, j = np.nonzero(similar >= floors[rows][:, None] - 10.0**-_DIGITS)
                    held.append((rows[i], left + j, np.round(similar[i, j], _DIGITS)))
                    n_held += len(i)
                    if n_held > _AT_ONCE:
                        held = kept()
                        n_held = len(held[0][0])
        return kept()[0] if held else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def _comparer(visits: Callable, width: int, k: int, block: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Compares the rows of units: of each unit first the known vectors, then the new ones."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held, shelf = None, [], None
        for batch in batches:
            units, is_new = batch["unit"].to_numpy(), batch["new"].to_numpy(zero_copy_only=False)
            edges = np.append(np.flatnonzero(np.diff(units * 2 + is_new, prepend=-1)), len(units))
            for begin, end in zip(edges[:-1], edges[1:]):
                if units[begin] != unit:
                    unit, held, shelf = units[begin], [], None
                rows = batch.slice(begin, end - begin)
                if not is_new[begin]:
                    held.append(rows.select(["name", "vec", "run"]))
                    continue
                if shelf is None and held:
                    shelf, held = _Shelf(held), []
                if shelf is None:
                    continue  # no known vector has come here
                for part in _slices(rows.num_rows, width):
                    some = rows.slice(part.start, part.stop - part.start)
                    vectors, floors = _matrix(some["vec"]), _floors(some["floor"])
                    row, old, similar = shelf.best(vectors, floors, *visits(vectors, floors, shelf.runs), k, block)
                    yield pa.RecordBatch.from_arrays(
                        [some["name"].take(pa.array(row)), shelf.names.take(pa.array(old)), pa.array(similar, pa.float64())],
                        ["key", "known_id", "similarity"],
                    )

    return compare


def _answer(wanted: DataFrame, asked: DataFrame, near: DataFrame, k: int) -> DataFrame:
    """The first ``k`` of ``near(key, known_id, similarity)`` for every row of ``wanted``."""
    top = first_per_key(near, ["key"], [F.col("similarity").desc(), F.col("known_id")], k)
    lists = top.groupBy("key").agg(F.sort_array(F.collect_list(F.struct((-F.col("similarity")).alias("s"), "known_id"))).alias("best"))
    answer = wanted.join(asked.join(lists, "key").select("vec", "best"), "vec").select("id", F.posexplode("best").alias("at", "hit"))
    similarity = F.when(F.col("hit.s") < math.inf, -F.col("hit.s"))  # null if it is no number
    return answer.select("id", F.col("hit.known_id").alias("known_id"), similarity.alias("similarity"), (F.col("at") + 1).alias("rank"))


def top_k_similar(
    new: DataFrame, known: DataFrame, k: int = 5, cells: int | None = None, block: int = _BLOCK, hashing: Hashing | None = None
) -> DataFrame:
    """The ``k`` most similar rows of ``known(id, vec)`` for each row of ``new(id, vec)``:
    ``(id, known_id, similarity, rank)``. The result is exact unless ``hashing`` is given.

    Known vectors are grouped around pivot directions, as many as the root of their number (or what fits into 64 MB,
    which every task gets). Each new vector is first compared with its nearest
    cell; the ``k``-th best similarity found there is a floor. From the angle to a pivot and the cell's radius
    follow bounds on every similarity inside, and cells that cannot reach the floor are skipped. What is left is
    compared on shelves of whole cells: a task holds a shelf (16 MB), new vectors pass by, ``block`` known ones are
    compared at a time, and only ``k`` rows per new vector and shelf leave it. Copies are searched once: of equal
    known vectors only the first ``k`` ids can matter.

    With ``hashing`` a new vector meets only the buckets it looks into, see ``Hashing``: a neighbour in none of them is
    missed. Similarities are exact, and a vector that finds fewer than ``k`` in its buckets is searched exactly.
    """
    known, wanted, asked = _named(new, known, k)
    if hashing is not None:
        return _answer(wanted, asked, _hashed(asked, known, k, block, hashing), k)
    return _answer(wanted, asked, _exact(asked, known, k, cells, block), k)


def _exact(asked: DataFrame, known: DataFrame, k: int, cells: int | None, block: int) -> DataFrame:
    """``(key, known_id, similarity)`` with at least the ``k`` best of each key of ``asked(key, vec)``."""
    n_known = known.count()
    first = known.select("vec").first()
    if first is None:
        return asked.limit(0).select("key", F.lit("").alias("known_id"), F.lit(0.0).alias("similarity"))
    n_numbers = max(1, len(first["vec"]))
    n_cells = cells or max(1, min(math.isqrt(n_known), _PIVOT_BYTES // (8 * n_numbers)))
    nonzero = known.filter(F.exists("vec", lambda x: x != 0))
    chosen = nonzero.select("vec").distinct().orderBy(F.xxhash64("vec"), "vec").limit(n_cells).collect()
    pivots = _units(np.array([row["vec"] for row in chosen])) if chosen else np.zeros((0, 1))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _matrix(batch["vec"])
            shrink = _shrink(vectors)
            cell, angle = np.zeros(len(vectors), int), np.zeros(len(vectors))
            for part in _slices(len(vectors), len(pivots)) if len(pivots) else ():
                angles = np.arccos(np.clip(_units(vectors[part]) @ pivots.T, -1, 1))
                cell[part], angle[part] = angles.argmin(axis=1), angles.min(axis=1)
            cell = np.where(shrink == 0, -1, cell)  # a zero vector has no direction: a cell of its own
            yield pa.RecordBatch.from_arrays(
                [batch["id"], batch["vec"], pa.array(cell, pa.int64()), pa.array(angle), pa.array(shrink)], ["id", "vec", "run", "angle", "shrink"]
            )

    placed = cut_lineage(known.mapInArrow(place, "id string, vec array<double>, run long, angle double, shrink double"))
    stats = placed.groupBy("run").agg(F.max("angle").alias("radius"), F.count(F.lit(1)).alias("n"), F.min("shrink").alias("shrink"))
    table = sorted((r["run"], r["radius"], r["n"], r["shrink"]) for r in stats.collect())
    ids, radius, sizes, least = (np.array(c) for c in zip(*table))
    shelves, held = [], 0
    for size in sizes:  # cells one after the other, as many as a task can hold
        full = bool(shelves) and (held + size) * 8 * n_numbers > _SHELF_BYTES
        shelves.append(shelves[-1] + full if shelves else 0)
        held = size if full else held + size
    shelves = np.array(shelves)

    def angles_to(vectors: np.ndarray, some: np.ndarray) -> np.ndarray:
        """Per vector and cell: the angle to the cell's pivot, 0 for the cell without a direction."""
        angles, real = np.zeros((len(vectors), len(some))), ids[some] >= 0
        if len(pivots):
            angles[:, real] = np.arccos(np.clip(_units(vectors) @ pivots[ids[some][real]].T, -1, 1))
        return angles

    def nearest(vectors: np.ndarray, floors: np.ndarray, present: np.ndarray | None = None):
        angles = angles_to(vectors, np.arange(len(ids)))
        return np.arange(len(vectors)), ids[np.where(ids >= 0, angles, math.pi + 1).argmin(axis=1)]  # with no number, any

    def certain(vectors: np.ndarray) -> np.ndarray:
        """Up to the vector's own padding, a similarity that ``k`` known ones reach because of their cells' angles."""
        angles = angles_to(vectors, np.arange(len(ids)))
        farthest = np.cos(np.clip(angles + radius, 0, math.pi))
        lower = np.where(ids >= 0, np.minimum(farthest, farthest * least), 0.0)
        order = np.argsort(-lower, axis=1, kind="stable")
        reached = np.cumsum(sizes[order], axis=1) >= k
        last = np.take_along_axis(order, reached.argmax(axis=1)[:, None], 1)
        # With fewer than k known nothing can be skipped.
        return np.where(reached.any(axis=1), np.take_along_axis(lower, last, 1)[:, 0], -np.inf)

    def reachable(vectors: np.ndarray, floors: np.ndarray, present: np.ndarray | None = None):
        """The cells that can reach a vector's floor; without a floor, what the bounds alone tell."""
        some = np.arange(len(ids)) if present is None else np.searchsorted(ids, present)
        shrink = _shrink(vectors)
        bound = floors / np.where(shrink == 0, 1.0, shrink)
        blank = np.flatnonzero(np.isnan(floors))
        for part in _slices(len(blank), len(ids)):
            bound[blank[part]] = certain(vectors[blank[part]])
        bound[(shrink == 0) | np.isnan(bound)] = -np.inf  # all similarities are 0, or no numbers
        upper = np.maximum(np.cos(np.clip(angles_to(vectors, some) - radius[some], 0, math.pi)), 0)
        upper[:, ids[some] < 0] = 0.0
        rows, columns = np.nonzero(~(upper < bound[:, None] - 1e-6))
        return rows, ids[some][columns]

    def shelf_of(runs: np.ndarray) -> np.ndarray:
        return shelves[np.searchsorted(ids, runs)]

    by_cell = asked.sparkSession.createDataFrame([(int(i), int(s)) for i, s in zip(ids, shelves)], "run long, shelf int")
    olds = placed.join(F.broadcast(by_cell), "run").select("id", "vec", "shelf", "run")  # as many rows as pivots, and one
    asked = asked.select("key", "vec")
    # A new vector's nearest cell gives it a floor; the cell is met again with those that can reach it.
    near = _search(asked.withColumn("floor", F.lit(None).cast("double")), olds, nearest, shelf_of, len(ids), k, block)
    floors = first_per_key(near, ["key"], [F.col("similarity").desc(), F.col("known_id")], k).groupBy("key")
    floors = floors.agg(F.count(F.lit(1)).alias("n"), F.min("similarity").alias("floor")).filter(F.col("n") == k)
    rest = cut_lineage(asked.join(floors.select("key", "floor"), "key", "left"))
    return _search(rest, olds, reachable, shelf_of, len(ids), k, block)


def _flips(margins: np.ndarray, probes: int) -> np.ndarray:
    """Per row the ``probes`` sets of planes to cross first, as numbers whose bits are planes: those with the least sum
    of squared margins. Only the planes nearest to the vector are tried."""
    near = min(margins.shape[1], max(1, probes).bit_length() + 2)
    order = np.argsort(np.abs(margins), axis=1, kind="stable")[:, :near]
    cost = np.take_along_axis(margins, order, 1) ** 2
    sets = [c for size in range(1, near + 1) for c in combinations(range(near), size)]
    total = np.stack([cost[:, list(c)].sum(axis=1) for c in sets], axis=1)
    bits = np.left_shift(np.int64(1), order.astype(np.int64))
    masks = np.stack([bits[:, list(c)].sum(axis=1) for c in sets], axis=1)
    return np.take_along_axis(masks, np.argsort(total, axis=1, kind="stable")[:, :probes], 1)


def _bucket_codes(vectors: np.ndarray, own: np.ndarray, probes: int) -> np.ndarray:
    """Per row the bucket of a unit vector in one table, and the ``probes`` next likely ones."""
    margins = vectors @ own.T
    code = ((margins > 0) @ np.left_shift(np.int64(1), np.arange(len(own), dtype=np.int64)))[:, None]
    return np.concatenate([code, code ^ _flips(margins, probes)], axis=1) if probes else code


def _planes_kept(asked: DataFrame, known: DataFrame, k: int, block: int, planes: np.ndarray, hashing: Hashing) -> int:
    """The most planes with which the buckets hold the wanted share of the exact neighbours of a few new vectors."""
    named = asked.withColumn("name", _hashed_name())
    tried = cut_lineage(named.orderBy(F.xxhash64("name"), "name").limit(_TRIED).drop("name"))
    near = _exact(tried, known, k, None, block).distinct()
    top = first_per_key(near, ["key"], [F.col("similarity").desc(), F.col("known_id")], k)
    pairs = top.join(known.select(F.col("id").alias("known_id"), F.col("vec").alias("old")), "known_id").join(tried, "key")
    pairs = pairs.select("vec", "old").collect()  # at most 256 times k
    if not pairs:
        return planes.shape[1]
    news, olds = (_units(np.array([r[c] for r in pairs])) for c in ("vec", "old"))
    for n_bits in range(planes.shape[1], 0, -1):
        met = [(_bucket_codes(news, own, hashing.probes) == _bucket_codes(olds, own, 0)).any(axis=1) for own in planes[:, :n_bits]]
        if np.any(met, axis=0).mean() >= hashing.recall:
            return n_bits
    return 0


def _hashed(asked: DataFrame, known: DataFrame, k: int, block: int, hashing: Hashing) -> DataFrame:
    """As ``_exact``, but from buckets of random hyperplanes; keys that find fewer than ``k`` there are searched exactly."""
    n_known, first = known.count(), known.select("vec").first()
    if first is None:
        return _exact(asked, known, k, None, block)
    n_bits = min(40, max(1, math.ceil(math.log2(max(2, n_known / hashing.bucket)))))
    planes = np.random.default_rng(hashing.seed).standard_normal((hashing.tables, n_bits, len(first["vec"])))
    planes = planes[:, : _planes_kept(asked, known, k, block, planes, hashing)]
    if planes.shape[1] == 0:
        return _exact(asked, known, k, None, block)

    n_bits = planes.shape[1]
    n_high = min(n_bits, max(0, math.ceil(math.log2(n_known * 8 * max(1, len(first["vec"])) / _SHELF_BYTES))))

    def shelf_of(runs: np.ndarray) -> np.ndarray:
        """Buckets of a table whose codes agree in the highest bits, as many bits as leave what a task can hold."""
        return (runs >> 41 << n_high) | ((runs & (1 << 41) - 1) >> (n_bits - n_high))

    def probed(vectors: np.ndarray, floors: np.ndarray, present: np.ndarray | None = None):
        vectors, tables = _units(vectors), range(len(planes)) if present is None else np.unique(present >> 41)
        codes = np.concatenate([int(t) << 41 | _bucket_codes(vectors, planes[t], hashing.probes) for t in tables], axis=1)
        return np.repeat(np.arange(len(vectors)), codes.shape[1]), codes.ravel()

    def bucketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _units(_matrix(batch["vec"]))
            for table, own in enumerate(planes):
                run = table << 41 | _bucket_codes(vectors, own, 0)[:, 0]
                yield pa.RecordBatch.from_arrays(
                    [batch["id"], batch["vec"], pa.array(shelf_of(run), pa.int32()), pa.array(run, pa.int64())], ["id", "vec", "shelf", "run"]
                )

    olds = known.distinct().mapInArrow(bucketed, "id string, vec array<double>, shelf int, run long")
    blank = asked.select("key", "vec", F.lit(None).cast("double").alias("floor"))
    near = _search(blank, olds, probed, shelf_of, len(planes) * (hashing.probes + 1), k, block)
    # The same neighbour may be found in several tables.
    near = near.groupBy("key", "known_id").agg(F.max("similarity").alias("similarity"))
    near = cut_lineage(first_per_key(near, ["key"], [F.col("similarity").desc(), F.col("known_id")], k))
    found = near.groupBy("key").count().filter(F.col("count") >= min(k, n_known)).select("key")
    short = cut_lineage(asked.join(found, "key", "left_anti"))
    if short.isEmpty():
        return near
    rest = _exact(short, known, k, None, block)
    return near.join(short.select("key"), "key", "left_anti").unionByName(rest)


def cold_start(cells: DataFrame, neighbours: DataFrame, u: DataFrame, v: DataFrame, stats: DataFrame) -> DataFrame:
    """Predict ``cells(id, item)`` of new entities from ``neighbours(id, known_id, similarity)``, the vectors
    ``u(id, vec)``, ``v(id, vec)`` and ``stats(item, mu, sigma)``.

    The weighted mean of the neighbours' predictions equals the prediction of their weighted mean vector, so
    one aggregate gives both the prediction and the spread of the neighbours' own predictions.
    """
    weight = F.greatest(F.col("similarity"), F.lit(0.0)) + _PAD
    rows = cells.join(neighbours.withColumn("_w", weight), "id")
    rows = rows.join(u.select(F.col("id").alias("known_id"), F.col("vec").alias("_u")), "known_id")
    rows = rows.join(v.select(F.col("id").alias("item"), F.col("vec").alias("_v")), "item")
    dot = F.aggregate(F.zip_with("_u", "_v", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    out = (
        rows.select("id", "item", "_w", "known_id", dot.alias("_p"))
        .groupBy("id", "item")
        .agg(
            (F.sum(F.col("_w") * F.col("_p")) / F.sum("_w")).alias("p"),
            F.stddev_pop("_p").alias("s"),
            F.sort_array(F.collect_list("known_id")).alias("similar"),
        )
    )
    return out.join(stats, "item").select(
        "id",
        "item",
        (F.col("p") * F.col("sigma") + F.col("mu")).alias("prediction"),
        (F.col("s") * F.col("sigma")).alias("uncertainty"),
        F.array_join("similar", ";").alias("similar"),
    )
