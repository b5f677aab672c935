"""Resampling and hypothesis tests.

Replicates use Poisson weights: unit u counts m(b, u) times in replicate b, drawn by integer arithmetic from (b, u). No draw
table is joined, a task adds its units up in arrays of one number a replicate, and a lost task repeats its draws.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from assayer.operators.board import finite
from assayer.operators.curves import mid_rank
from assayer.operators.preparation import equivalence_verdict
from assayer.operators.ranks import mid_ranks, positions, ranges, same
from assayer.operators.registry import query
from assayer.operators.summaries import rounded
from assayer.plans.measures import CONTROL, SLICES, slices
from assayer.plans.store import Scratch
from assayer.sources.tables import table

#: Draws of an interval, and of those registered intervals that another engine follows on the same tables; callers choose their own.
REPLICATES, CHECKED = 10_000, 2000
#: Draws of the registered differences of areas, whose ranking makes a row a draw and score.
AREA_REPLICATES = 1000
#: Shufflings of the registered permutation test.
SHUFFLINGS = 199
#: Distribution function of the Poisson law with mean 1 at 0, 1, 2 and so on.
POISSON = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676)


def uniform(b: Column, unit: Column) -> Column:
    """In [0, 1) from replicate and unit, below 2**63 throughout."""
    x = (unit % 1_000_003 * 7919 + b * 104_729 + 12_345) % 1_000_003
    return (x * 48_271 + b * 16_807 + unit % 65_537) % 2_147_483_647 * 48_271 % 2_147_483_647 / 2_147_483_647.0


def weight(b: Column, unit: Column) -> Column:
    u = uniform(b, unit)
    return sum(((u >= p).cast("int") for p in POISSON[1:]), (u >= POISSON[0]).cast("int"))


U_SQL = "(((({u} % 1000003) * 7919 + {b} * 104729 + 12345) % 1000003 * 48271 + {b} * 16807 + {u} % 65537) % 2147483647 * 48271 % 2147483647 / 2147483647.0::DOUBLE)"
M_SQL = "(" + " + ".join(f"({U_SQL} >= {p})::INT" for p in POISSON) + ")"


def _numbers(first: int, end: int) -> Column:
    return F.sequence(F.lit(first).cast("long"), F.lit(end - 1).cast("long"))


#: The same law for whole numbers below 2**31 - 1: how many of these a number reaches is its weight.
_STEPS = [next(r for r in range(int(p * 2_147_483_647) - 2, 2_147_483_647) if r / 2_147_483_647.0 >= p) for p in POISSON]
#: Numbers of a matrix of weights that is worked on at once, and those that sums of all groups may hold in a task.
_CELLS, _HELD = 1 << 18, 1 << 23
_PRIME, _MOD = (1 << 31) - 1, 1_000_003


class _Weigher:
    """What ``weight`` gives, for some units (rows) and the replicates from 0 on (columns).

    The next replicate moves a unit's first remainder by a fixed step, so with the remainders in order of such steps a unit's row is a
    stretch of one table, moved by a number of the unit's own. The matrix given stands until the next call.
    """

    def __init__(self, replicates: int, most: int):
        step, at = 104_729, np.arange(_MOD + replicates, dtype=np.int64)
        self.back = pow(step, -1, _MOD)
        table = at % _MOD * step % _MOD * 48_271 % _PRIME * 48_271 % _PRIME + self._drift(at)
        self.rows = np.lib.stride_tricks.sliding_window_view((table % _PRIME).astype(np.uint32), replicates)
        self.x, self.y = (np.empty((most, replicates), np.uint32) for _ in range(2))
        self.reached, self.n, self.out = np.empty((most, replicates), bool), np.empty((most, replicates), np.int8), np.empty((most, replicates))

    @staticmethod
    def _drift(at: np.ndarray) -> np.ndarray:
        return at * 16_807 % _PRIME * 48_271 % _PRIME

    def __call__(self, units: np.ndarray) -> np.ndarray:
        x, y, reached, n, out = (a[: len(units)] for a in (self.x, self.y, self.reached, self.n, self.out))
        at = (units % _MOD * 7919 + 12_345) % _MOD * self.back % _MOD
        own = ((units % 65_537 * 48_271 - self._drift(at)) % _PRIME).astype(np.uint32)
        for i, (k, c) in enumerate(zip(at.tolist(), own, strict=True)):
            np.add(self.rows[k], c, out=x[i])
        # the remainder of a sum of two remainders: below zero a whole number without sign is huge
        np.minimum(x, np.subtract(x, np.uint32(_PRIME), out=y), out=x)
        np.greater_equal(x, np.uint32(_STEPS[0]), out=n.view(bool))
        for step in _STEPS[1:]:
            np.add(n, np.greater_equal(x, np.uint32(step), out=reached).view(np.int8), out=n)
        out[:] = n
        return out


def _weights(units: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All of a weigher's matrix at once, for the replicates ``b`` that count on from 0."""
    return _Weigher(len(b), len(units))(units)


def replicate_sums(units: DataFrame, by: list[str], unit: str, sums: list[str], replicates: int) -> DataFrame:
    """(by, b, sums): in every replicate the weighted sums over units; the same weights for every group of a unit.

    A task keeps an array of ``replicates`` sums a group and adds to it what a matrix of weights makes of some units, so a unit is never
    copied, and rows of one unit stand together, so that it is weighed once for its groups. Only these arrays are shuffled. A task whose
    groups need more than ``_HELD`` numbers lets them go and begins anew. Units that are null are left out; a null value adds nothing.
    """
    spark = units.sparkSession
    kinds = {f.name: f.dataType for f in units.schema.fields}
    schema = StructType([*(StructField(c, kinds[c]) for c in by), StructField("b", LongType()), *(StructField(c, DoubleType()) for c in sums)])
    arrow, numbers = to_arrow_schema(schema), np.arange(replicates, dtype=np.int64)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        step = max(1, _CELLS // replicates)
        weigh = None

        def out() -> Iterator[pa.RecordBatch]:
            for group, values in held.items():
                keys = [pa.array([k] * replicates, f.type) for k, f in zip(group, arrow, strict=False)]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(numbers), *(pa.array(v) for v in values)], schema=arrow)

        for batch in batches:
            if not len(batch):
                continue
            weigh = weigh or _Weigher(replicates, step)
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(len(by))), strict=True)) if by else [()] * len(batch)
            places: dict[tuple, int] = {}
            group = np.fromiter((places.setdefault(k, len(places)) for k in keys), np.int64, len(keys))
            names = list(places)
            at, unit_of = np.unique(batch.column(len(by)).to_numpy(zero_copy_only=False), return_inverse=True)
            values = np.column_stack([pc.fill_null(c.cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False) for c in batch.columns[len(by) + 1 :]])
            order = np.argsort(unit_of, kind="stable")
            ends = np.searchsorted(unit_of[order], np.arange(0, len(at) + step, step))
            for i, (low, high) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
                m, rows = weigh(at[i * step : (i + 1) * step]), order[low:high]
                there, g = np.unique(group[rows], return_inverse=True)
                if len(there) * len(m) <= 16 * len(rows):
                    cells = np.zeros((len(there), len(sums), len(m)))
                    np.add.at(cells, (g, slice(None), unit_of[rows] - i * step), values[rows])
                    found = (cells.reshape(-1, len(m)) @ m).reshape(len(there), len(sums), replicates)
                else:
                    # few units have many of the groups: each group by its own rows
                    own = np.split(rows[np.argsort(g, kind="stable")], np.cumsum(np.bincount(g))[:-1])
                    found = (values[r].T @ m[unit_of[r] - i * step] for r in own)
                for k, more in zip(there.tolist(), found, strict=True):
                    total = held.get(names[k])
                    if total is None:
                        held[names[k]] = np.array(more)
                    else:
                        total += more
                if len(held) * len(sums) * replicates > _HELD:
                    yield from out()
                    held.clear()
        yield from out()

    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    u = units.where(F.col(unit).isNotNull()).select(*by, F.col(unit).cast("long").alias("_unit"), *sums)
    u = u.repartition(tasks, "_unit").sortWithinPartitions("_unit")
    return u.mapInArrow(add, schema).groupBy(*by, "b").agg(*(F.sum(c).alias(c) for c in sums))


def replicate_means(units: DataFrame, by: list[str], unit: str, total: str, count: str, replicates: int = REPLICATES) -> DataFrame:
    """(by, b, mean): weighted means of per-unit partial sums; replicates that draw nothing of a group are left out."""
    out = replicate_sums(units, by, unit, [total, count], replicates).where(F.col(count) > 0)
    return out.select(*by, "b", (F.col(total) / F.col(count)).alias("mean"))


def percentile_ci(means: DataFrame, by: list[str], alpha: float = 0.05) -> DataFrame:
    q = F.percentile("mean", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))
    return means.groupBy(*by).agg(q.alias("q")).select(*by, F.get("q", 0).alias("low"), F.get("q", 1).alias("high"))


def bca_ci(units: DataFrame, means: DataFrame, by: list[str], total: str, alpha: float = 0.05) -> DataFrame:
    """Bias-corrected accelerated interval of a mean of units; the jackknife's moments in closed form.

    The acceleration is the third central moment over 6 times the second's 3/2 power; a share below of 0 or 1 falls
    back to the plain percentiles.
    """
    mean = units.groupBy(*by).agg(F.avg(total).alias("theta"))
    dev = units.join(mean, by).withColumn("d", F.col(total) - F.col("theta"))
    acc = dev.groupBy(*by).agg(F.first("theta").alias("theta"), F.sum(F.pow("d", F.lit(3))).alias("m3"), F.sum(F.pow("d", F.lit(2))).alias("m2"))
    acc = acc.withColumn("a", F.when(F.col("m2") > 0, F.col("m3") / (6 * F.pow("m2", F.lit(1.5)))).otherwise(0.0))
    boots = means.groupBy(*by).agg(F.sort_array(F.collect_list("mean")).alias("boots"))  # ``replicates`` values a group

    @F.pandas_udf("low double, high double")
    def levels(boots: pd.Series, theta: pd.Series, a: pd.Series) -> pd.DataFrame:
        nd, out = NormalDist(), []
        for x, t, acc_ in zip(boots, theta, a, strict=True):
            x = np.asarray(x, float)
            below = float((x < t).mean())
            z = [nd.inv_cdf(alpha / 2), nd.inv_cdf(1 - alpha / 2)]
            if 0 < below < 1:
                z0 = nd.inv_cdf(below)
                at = [min(max(nd.cdf(z0 + (z0 + v) / (1 - acc_ * (z0 + v))), 1e-4), 1 - 1e-4) for v in z]
            else:
                at = [alpha / 2, 1 - alpha / 2]
            out.append(np.quantile(x, at).tolist())
        return pd.DataFrame(out, columns=["low", "high"])

    return acc.join(boots, by).select(*by, "theta", levels("boots", "theta", "a").alias("ci")).select(*by, "theta", "ci.low", "ci.high")


def sign_test(rows: DataFrame, by: list[str], a: Column, b: Column) -> DataFrame:
    """Per group: pairs, how many have a < b, and the two-sided binomial tail by sums of logarithms."""
    n, k = F.count(F.when(a != b, 1)), F.count(F.when(a < b, 1))
    g = rows.groupBy(*by).agg(n.cast("int").alias("n"), k.cast("int").alias("k"))
    low = F.least(F.col("k"), F.col("n") - F.col("k"))
    # the logarithm of a binomial coefficient goes on from the one before
    start = F.struct(F.lit(0.0).alias("log"), F.lit(0.0).alias("sum"))
    ahead = lambda x, j: F.struct((x["log"] + F.log((F.col("n") - j) / (j + 1))).alias("log"), (x["sum"] + F.exp(x["log"] - F.col("n") * F.log(F.lit(2.0)))).alias("sum"))
    tail = F.aggregate(F.sequence(F.lit(0), low), start, ahead, lambda x: x["sum"])
    return g.select(*by, F.col("n").cast("long").alias("n"), F.col("k").cast("long").alias("k"), F.least(2 * tail, F.lit(1.0)).alias("p"))


def kruskal(ranks: DataFrame, by: list[str], group: str, rank: str) -> DataFrame:
    """H from rank sums per group; ties are corrected by the variance of the ranks themselves."""
    return _h(ranks.groupBy(*by, group).agg(F.sum(rank).alias("r"), F.count("*").alias("n"), F.sum(F.pow(rank, F.lit(2))).alias("r2")), by)


def _h(sums: DataFrame, by: list[str]) -> DataFrame:
    """H from one row a group: the sum of its ranks, its rows, the sum of its squared ranks."""
    t = sums.groupBy(*by).agg(F.sum(F.pow("r", F.lit(2)) / F.col("n")).alias("between"), F.sum("n").alias("n"), F.sum("r2").alias("r2"))
    middle = F.col("n") * F.pow((F.col("n") + 1) / 2, F.lit(2))
    return t.select(*by, ((F.col("n") - 1) * (F.col("between") - middle) / (F.col("r2") - middle)).alias("h"))


#: Units whose keys are worked out together, shufflings that are paired together, and keys that a task sorts on average.
_BLOCK, _TOGETHER, _SORTED = 1 << 15, 16, 1 << 25
#: Bits of a key inside its range; the keys' 31 bits make 128 ranges.
_INSIDE = 24


def _rest(x: np.ndarray, m: int) -> np.ndarray:
    """The remainder with the sign of ``x``, as in SQL."""
    return np.fmod(x, m) if x.size and x.min() < 0 else x - x // m * m


def _keys(units: pa.Array, replicates: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(b, key, range) for b from 1: what ``uniform`` divides, and its range as a byte. A null unit stands before all others."""
    null = units.is_null().to_numpy(zero_copy_only=False)
    u = pc.fill_null(units, 0).to_numpy(zero_copy_only=False)
    first, last = _rest(u, _MOD) * 7919 + 12_345, _rest(u, 65_537)
    for b in range(1, replicates + 1):
        x = _rest(_rest(first + b * 104_729, _MOD) * 48_271 + (last + b * 16_807), _PRIME)
        key = _rest(x * 48_271, _PRIME).astype(np.int32)
        key[null] = -_PRIME - 1
        yield b, key, ((key >> _INSIDE) + 128).astype(np.uint8)


def shuffled_sums(units: DataFrame, total: int, replicates: int) -> DataFrame:
    """(b, code, s) for b from 1: sums of ``x`` over the units that get label ``code`` in shuffling b. Units are (unit, p, code, x).

    A shuffling pairs the i-th unit by key with the i-th label by unit, whose place is ``p``. Keys are worked out in the task from unit
    and b. A block of units sends, a shuffling and range of keys, one row with the keys and ``x`` as bytes, in order of ``p``. Keys are
    uniform, so a range is even; how many keys lie ahead of it is counted before, and so the stretch of labels that it meets is known.
    """
    spark = units.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total * replicates // _SORTED))
    number = np.dtype(np.uint32 if total < 1 << 31 else np.int64)
    pieces_of = StructType.fromDDL("b long, k int, block long, n long, keys binary, x binary")
    sums_of = StructType.fromDDL("b long, code long, s double")
    dealt, paired = to_arrow_schema(pieces_of), to_arrow_schema(sums_of)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((replicates + 1, 256), np.int64)
        for batch in batches:
            for b, _, k in _keys(batch.column(0), replicates):
                held[b] += np.bincount(k, minlength=256)
        b, k = np.nonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(b), pa.array((k - 128).astype(np.int32)), pa.array(held[b, k])], names=["b", "k", "n"])

    def deal(block: pa.Table) -> pa.Table:
        block = block.sort_by("p")
        x, at, out = block["x"].to_numpy().astype(number), block["block"][0].as_py(), []
        for b, key, k in _keys(block["unit"].combine_chunks(), replicates):
            order, n = np.argsort(k, kind="stable"), np.bincount(k, minlength=256)
            there = np.flatnonzero(n)
            ends = np.concatenate(([0], np.cumsum(n[there]))).astype(np.int32)
            bytes_of = lambda v: pa.Array.from_buffers(pa.binary(), len(there), [None, pa.py_buffer(ends * v.itemsize), pa.py_buffer(v[order])])  # noqa: B023, E731
            b_, at_ = (pa.array(np.full(len(there), v, np.int64)) for v in (b, at))
            out.append(pa.RecordBatch.from_arrays([b_, pa.array((there - 128).astype(np.int32)), at_, pa.array(n[there]), bytes_of(key), bytes_of(x)], schema=dealt))
        return pa.Table.from_batches(out, schema=dealt)

    def pair(pieces: pa.Table, labels: pa.Table) -> pa.Table:
        if not len(pieces):
            return paired.empty_table()
        labels, pieces = labels.sort_by("at"), pieces.sort_by([("b", "ascending"), ("block", "ascending")])
        first = labels["at"][0].as_py()
        codes, label = np.unique(pc.list_flatten(labels["labels"]).to_numpy(), return_inverse=True)
        b, base, n = (pieces[c].to_numpy() for c in ("b", "base", "n"))
        keys, x = (np.frombuffer(b"".join(pieces[c].to_pylist()), t) for c, t in (("keys", np.int32), ("x", number)))
        ends, starts, out = np.concatenate(([0], np.cumsum(n))), np.flatnonzero(np.diff(b, prepend=-1)), []
        for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(b)], strict=True):
            low, high = ends[s], ends[e]
            # equal keys stay in order of place, which is that of the units
            order = (keys[low:high].astype(np.int64) << 32) | np.arange(high - low)
            order.sort()
            own = label[base[s] - first :][: high - low]
            out.append(np.bincount(own, x[low:high][order & 0xFFFFFFFF], len(codes)))
        columns = [np.repeat(b[starts], len(codes)), np.tile(codes, len(starts)), np.concatenate(out)]
        return pa.Table.from_arrays([pa.array(c) for c in columns], schema=paired)

    counts = units.select("unit").repartition(tasks, "unit").mapInArrow(count, "b long, k int, n long").groupBy("b", "k").agg(F.sum("n").alias("n"))
    ahead = Window.partitionBy("b").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    # a row a shuffling and range
    bases = Scratch(spark, "shufflings").keep(counts.select("b", "k", "n", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base")), "bases")
    together = F.floor(F.col("b") / _TOGETHER).alias("c")
    u = units.withColumn("block", F.floor(F.col("p") / _BLOCK)).repartition(tasks, "block")
    pieces = u.select("block", "unit", "p", "x").groupBy("block").applyInArrow(deal, pieces_of)
    pieces = pieces.join(F.broadcast(bases.select("b", "k", "base")), ["b", "k"]).select("k", together, "b", "block", "n", "base", "keys", "x")
    blocks = u.groupBy("block").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "code"))), lambda v: v["code"]).alias("labels"))
    met = bases.groupBy("k", together).agg(F.min("base").alias("low"), F.max(F.col("base") + F.col("n")).alias("high"))
    start = F.col("block") * _BLOCK
    low, high = F.greatest("low", start), F.least("high", start + _BLOCK)
    labels = blocks.join(F.broadcast(met), (F.col("low") < start + _BLOCK) & (F.col("high") > start))
    labels = labels.select("k", "c", low.alias("at"), F.slice("labels", (low - start + 1).cast("int"), (high - low).cast("int")).alias("labels"))
    pieces, labels = (d.repartition(tasks, "k", "c").groupBy("k", "c") for d in (pieces, labels))
    return pieces.cogroup(labels).applyInArrow(pair, sums_of).groupBy("b", "code").agg(F.sum("s").alias("s"))


def permutation_kruskal(rows: DataFrame, unit: str, group: str, value: str, replicates: int) -> DataFrame:
    """H of the labels as they are and the share of label shufflings with as large an H.

    A shuffling pairs the i-th row by a random key with the i-th label by unit. A group's rows and all squared ranks are those of the
    labels as they are, so a shuffling is known by its rank sums.
    """
    scratch = Scratch(rows.sparkSession, "permutation")
    # doubled, a mean rank is a whole number
    r = mid_ranks(rows.select(F.col(unit).cast("long").alias("unit"), F.col(group).alias("g"), F.col(value).alias("v")), [], "v", "r", wide=True)
    r = scratch.keep(r.select("unit", "g", (F.col("r") * 2).cast("long").alias("x")), "ranks")
    half = F.col("x") / 2
    groups = r.groupBy("g").agg(F.sum(half).alias("r"), F.count("*").alias("n"), F.sum(half * half).alias("r2"))
    groups = scratch.keep(groups.withColumn("code", F.monotonically_increasing_id()), "groups")
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    coded = same(r, groups.select("g", "code"), ["g"]).select("unit", "code", "x")
    units = scratch.keep(positions(coded, [], ["unit"], ranges(r, "unit"), "p"), "units")
    shuffled = shuffled_sums(units, total, replicates).join(groups.select("code", "n", "r2"), "code")
    seen = _h(groups.withColumn("b", F.lit(0).cast("long")), ["b"])
    h = seen.union(_h(shuffled.withColumn("r", F.col("s") / 2), ["b"]))
    # One value a replicate, so the list is as long as there are replicates.
    both = h.agg(F.max(F.when(F.col("b") == 0, F.col("h"))).alias("h"), F.collect_list(F.when(F.col("b") > 0, F.col("h"))).alias("all"))
    ge = F.size(F.filter("all", lambda x: x >= F.col("h") - 1e-9)).cast("long")
    return both.select("h", ge.alias("ge"), ((ge + 1) / (F.size("all") + 1)).alias("p"))


_DELTAS = f"WITH {SLICES}, u AS (SELECT vendor, series, sum(score_a - score_b) AS t, count(*) AS c FROM s GROUP BY ALL), b AS (SELECT vendor, r.b, {M_SQL.format(u='series', b='r.b')} AS m, t, c FROM u, (SELECT unnest(range({CHECKED})) AS b) r), m AS (SELECT vendor, b, sum(m * t) / sum(m * c) AS mean FROM b WHERE m > 0 GROUP BY ALL), ci AS (SELECT vendor, quantile_cont(mean, 0.025) AS low, quantile_cont(mean, 0.975) AS high FROM m GROUP BY vendor)"


def _deltas(spark: SparkSession, folder: str) -> DataFrame:
    return slices(spark, folder).groupBy("vendor", "series").agg(F.sum(F.col("score_a") - F.col("score_b")).alias("t"), F.count("*").alias("c"))


@query(f"{_DELTAS} SELECT vendor, round(low, 6) AS low, round(high, 6) AS high FROM ci")
def bs1_percentile_ci(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(percentile_ci(replicate_means(_deltas(spark, folder), ["vendor"], "series", "t", "c", CHECKED), ["vendor"]), ["low", "high"])


@query()
def bs2_bca_ci(spark: SparkSession, folder: str) -> DataFrame:
    units = _deltas(spark, folder)
    return rounded(bca_ci(units.withColumn("x", F.col("t") / F.col("c")), replicate_means(units, ["vendor"], "series", "t", "c"), ["vendor"], "x"), ["theta", "low", "high"])


_PATIENTS = f"WITH {SLICES}, u AS (SELECT dose, {{by}}patient, sum(cnr) AS t, count(*) AS c FROM s GROUP BY ALL), b AS (SELECT dose, {{by}}r.b, {M_SQL.format(u='patient', b='r.b')} AS m, t, c FROM u, (SELECT unnest(range({CHECKED})) AS b) r), m AS (SELECT dose, {{by}}b, sum(m * t) / sum(m * c) AS mean FROM b WHERE m > 0 GROUP BY ALL)"


@query(f"{_PATIENTS.format(by='')} SELECT dose, round(quantile_cont(mean, 0.025), 6) AS low, round(quantile_cont(mean, 0.975), 6) AS high FROM m GROUP BY dose")
def bs5_patient_block_bootstrap(spark: SparkSession, folder: str) -> DataFrame:
    """Whole patients, all their slices, one draw for every dose."""
    u = slices(spark, folder).groupBy("dose", "patient").agg(F.sum("cnr").alias("t"), F.count("*").alias("c"))
    return rounded(percentile_ci(replicate_means(u, ["dose"], "patient", "t", "c", CHECKED), ["dose"]), ["low", "high"])


_UNIT = "(series * 8 + slice)"


@query(f"WITH {SLICES}, b AS (SELECT dose, r.b, {M_SQL.format(u=_UNIT, b='r.b')} AS m, cnr FROM s, (SELECT unnest(range({CHECKED})) AS b) r), m AS (SELECT dose, b, sum(m * cnr) / sum(m) AS mean FROM b WHERE m > 0 GROUP BY ALL) SELECT dose, round(quantile_cont(mean, 0.025), 6) AS low, round(quantile_cont(mean, 0.975), 6) AS high FROM m GROUP BY dose")
def bs6_slice_bootstrap(spark: SparkSession, folder: str) -> DataFrame:
    u = slices(spark, folder).select("dose", (F.col("series") * 8 + F.col("slice")).alias("unit"), F.col("cnr").alias("t"), F.lit(1).alias("c"))
    return rounded(percentile_ci(replicate_means(u, ["dose"], "unit", "t", "c", CHECKED), ["dose"]), ["low", "high"])


@query(f"{_PATIENTS.format(by='method, ')}, r AS (SELECT o.method, o.dose, o.b, k.mean / o.mean AS ratio FROM m o JOIN m k ON o.dose = k.dose AND o.b = k.b AND k.method = '{CONTROL}' WHERE o.method <> '{CONTROL}' AND o.mean <> 0) SELECT method, dose, round(quantile_cont(ratio, 0.025), 6) AS low, round(quantile_cont(ratio, 0.975), 6) AS high FROM r GROUP BY ALL")
def bs7_paired_separation(spark: SparkSession, folder: str) -> DataFrame:
    """Interval of control over method on shared draws; zero and non-finite denominators are left out."""
    u = slices(spark, folder).groupBy("method", "dose", "patient").agg(F.sum("cnr").alias("t"), F.count("*").alias("c"))
    # read twice below: a row a method, dose and draw
    m = Scratch(spark, "separation").keep(replicate_means(u, ["method", "dose"], "patient", "t", "c", CHECKED), "means")
    k = m.where(F.col("method") == CONTROL).select("dose", "b", F.col("mean").alias("k"))
    r = m.where((F.col("method") != CONTROL) & finite(F.col("mean")) & (F.col("mean") != 0)).join(k, ["dose", "b"])
    return rounded(percentile_ci(r.select("method", "dose", (F.col("k") / F.col("mean")).alias("mean")), ["method", "dose"]), ["low", "high"])


#: Values of a vector that are hashed in one row.
BLOCK = 4096


def pool_replicates(rows: DataFrame, model: str, seed: str, pos: str, value: str) -> DataFrame:
    """Per model: seeds, distinct vectors, and whether some repeat. A vector's digest is that of its blocks' digests."""
    block = F.transform(F.array_sort(F.collect_list(F.struct(pos, F.coalesce(F.col(value).cast("string"), F.lit("null")).alias("v")))), lambda x: x["v"])
    b = rows.groupBy(model, seed, F.floor(F.col(pos) / BLOCK).alias("k")).agg(F.sha2(F.array_join(block, ","), 256).alias("h"))
    whole = F.transform(F.array_sort(F.collect_list(F.struct("k", "h"))), lambda x: x["h"])
    v = b.groupBy(model, seed).agg(F.sha2(F.array_join(whole, ","), 256).alias("h"))
    return v.groupBy(model).agg(F.count("*").alias("n_seeds"), F.countDistinct("h").alias("n_distinct"), (F.count("*") > F.countDistinct("h")).alias("degenerate"))


@query("WITH v AS (SELECT l_suppkey AS model, l_linenumber % 3 AS seed, sha256(string_agg(l_quantity::INT::VARCHAR, ',' ORDER BY l_orderkey, l_partkey, l_extendedprice)) AS h FROM lineitem GROUP BY ALL) SELECT model, count(*) AS n_seeds, count(DISTINCT h) AS n_distinct, count(*) > count(DISTINCT h) AS degenerate FROM v GROUP BY model")
def bs8_pool_replicates(spark: SparkSession, folder: str) -> DataFrame:
    """Replicates of a model whose vectors are identical count once."""
    line = table(spark, folder, "lineitem")
    rows = line.select(F.col("l_suppkey").alias("model"), (F.col("l_linenumber") % 3).alias("seed"), "l_orderkey", "l_partkey", "l_extendedprice", F.col("l_quantity").cast("int").alias("v"))
    return pool_replicates(positions(rows, ["model", "seed"], ["l_orderkey", "l_partkey", "l_extendedprice"], ranges(line, "l_orderkey"), "pos"), "model", "seed", "pos", "v")


@query("SELECT event_type, round(avg(value) FILTER (isfinite(value)), 6) AS mean, round(quantile_cont(value, 0.5) FILTER (isfinite(value)), 6) AS median FROM events GROUP BY event_type")
def bs9_representative(spark: SparkSession, folder: str) -> DataFrame:
    v = F.when(finite(F.col("value")), F.col("value"))
    return table(spark, folder, "events").groupBy("event_type").agg(F.round(F.avg(v), 6).alias("mean"), F.round(F.percentile(v, 0.5), 6).alias("median"))


_H = "(n - 1) * (bt - n * pow((n + 1) / 2, 2)) / (r2 - n * pow((n + 1) / 2, 2))"
_KW = f"r AS (SELECT c_custkey AS u, c_mktsegment AS g, rank() OVER (ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_acctbal) - 1) / 2 AS r FROM customer), b AS (SELECT r.*, x.b FROM r, (SELECT unnest(range(1, {SHUFFLINGS + 1})) AS b) x), l AS (SELECT b, r, row_number() OVER (PARTITION BY b ORDER BY {U_SQL.format(u='u', b='b')}, u) AS i FROM b), q AS (SELECT b, g, row_number() OVER (PARTITION BY b ORDER BY u) AS i FROM b)"


@query(f"WITH {_KW}, s AS (SELECT 0 AS b, g, r FROM r UNION ALL SELECT b, g, r FROM l JOIN q USING (b, i)), e AS (SELECT b, g, sum(r) AS s, count(*) AS n, sum(r * r) AS r2 FROM s GROUP BY ALL), t AS (SELECT b, sum(s * s / n) AS bt, sum(n)::DOUBLE AS n, sum(r2) AS r2 FROM e GROUP BY b), h AS (SELECT b, {_H} AS h FROM t) SELECT round(h.h, 6) AS h, (SELECT count(*) FROM h x WHERE b > 0 AND x.h >= h.h - 1e-9) AS ge, round(((SELECT count(*) FROM h x WHERE b > 0 AND x.h >= h.h - 1e-9) + 1) / {SHUFFLINGS + 1}, 6) AS p FROM h WHERE b = 0")
def bs10_permutation_kruskal(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(permutation_kruskal(table(spark, folder, "customer"), "c_custkey", "c_mktsegment", "c_acctbal", SHUFFLINGS), ["h", "p"])


def friedman_exact(ranks: DataFrame, subject: str, condition: str, rank: str, k: int) -> DataFrame:
    """Q and its exact p over all (k!)**n within-subject orders.

    The orders are not listed: the states after each subject are the sorted rank sums and the share of orders that reach
    them, and the next subject adds each of its k! orders to every state. There are at most as many states as ways to write
    n k (k + 1) / 2 as k sums, which is polynomial in n.
    """
    from itertools import permutations
    from math import factorial

    n = ranks.select(subject).distinct().count()
    q = lambda s2: 12 / (n * k * (k + 1)) * s2 - 3 * n * (k + 1)
    seen = ranks.groupBy(condition).agg(F.sum(rank).alias("s")).agg(q(F.sum(F.col("s") * F.col("s"))).alias("q")).first()["q"]  # a scalar
    orders = [tuple(o) for o in permutations(range(1, k + 1))]
    states = {(0,) * k: 1.0}
    for _ in range(n):
        after: dict[tuple[int, ...], float] = {}
        for sums, share in states.items():
            for o in orders:
                new = tuple(sorted(map(sum, zip(sums, o, strict=True))))
                after[new] = after.get(new, 0.0) + share / factorial(k)
        states = after
    p = sum(share for sums, share in states.items() if q(sum(s * s for s in sums)) >= seen - 1e-9)
    return ranks.sparkSession.createDataFrame([(float(seen), float(p))], "q double, p double")


#: By one subject at a time: every state of rank sums takes each of the six orders of three conditions.
_FRIEDMAN = f"WITH RECURSIVE {SLICES}, m AS (SELECT vendor, dose, avg(cnr) AS v FROM s GROUP BY ALL), r AS (SELECT vendor, dose, rank() OVER (PARTITION BY vendor ORDER BY v) AS r FROM m), t AS (SELECT dose, sum(r) AS s FROM r GROUP BY dose), n AS (SELECT count(DISTINCT vendor) AS n FROM r), q AS (SELECT 12.0::DOUBLE / (n * 12) * sum(s * s) - 12 * n AS q FROM t, n GROUP BY n), o AS (SELECT * FROM (VALUES (1, 2, 3), (1, 3, 2), (2, 1, 3), (2, 3, 1), (3, 1, 2), (3, 2, 1)) o(a, b, c)), f(i, w) AS (SELECT 0, [{{{{'x': 0, 'y': 0, 'z': 0, 'p': 1.0::DOUBLE}}}}] UNION ALL SELECT i + 1, (SELECT list({{{{'x': x, 'y': y, 'z': z, 'p': p}}}}) FROM (SELECT u.s.x + a AS x, u.s.y + b AS y, u.s.z + c AS z, sum(u.s.p / 6) AS p FROM (SELECT unnest(w) AS s) u, o GROUP BY ALL)) FROM f, n WHERE i < n), e AS (SELECT unnest(w) AS s FROM f, n WHERE i = n) SELECT round(q, 6) AS q, round(sum(CASE WHEN 12.0::DOUBLE / (n * 12) * (s.x * s.x + s.y * s.y + s.z * s.z) - 12 * n >= q - 1e-9 THEN s.p ELSE 0 END), 6) AS p FROM e, q, n GROUP BY q"


@query(_FRIEDMAN.replace("{{", "{").replace("}}", "}"))
def bs11_friedman_exact(spark: SparkSession, folder: str) -> DataFrame:
    """Over all vendors as subjects."""
    m = slices(spark, folder).groupBy("vendor", "dose").agg(F.avg("cnr").alias("v"))
    return rounded(friedman_exact(m.select("vendor", "dose", mid_rank(["vendor"], "v").alias("r")), "vendor", "dose", "r", 3), ["q", "p"])


@query(f"WITH {SLICES}, m AS (SELECT vendor, method, avg(score_a) AS a, avg(score_b) AS b FROM s GROUP BY ALL), g AS (SELECT vendor, count(*) FILTER (a <> b) AS n, count(*) FILTER (a < b) AS k FROM m GROUP BY vendor) SELECT vendor, n, k, round(least(1.0, 2 * list_sum(list_transform(range(0, least(k, n - k) + 1), lambda j: exp(coalesce(list_sum(list_transform(range(1, j + 1), lambda i: ln((n - i + 1) / i))), 0) - n * ln(2))))), 6) AS p FROM g")
def bs13_sign_test(spark: SparkSession, folder: str) -> DataFrame:
    m = slices(spark, folder).groupBy("vendor", "method").agg(F.avg("score_a").alias("a"), F.avg("score_b").alias("b"))
    return rounded(sign_test(m, ["vendor"], F.col("a"), F.col("b")), ["p"])


@query(f"{_DELTAS}, d AS (SELECT vendor, avg(score_a - score_b) AS mean, var_samp(score_a - score_b) AS s2, count(*) AS n FROM s GROUP BY vendor) SELECT vendor, n, round(mean, 6) AS mean, round(low, 6) AS low, round(high, 6) AS high, CASE WHEN low > -0.6 AND high < 0.6 THEN 'PASS' WHEN low > 0.6 OR high < -0.6 THEN 'FAIL' ELSE 'INDETERMINATE' END AS verdict, ceil(pow(1.959963984540054 / 0.6, 2) * s2)::BIGINT AS required, n >= ceil(pow(1.959963984540054 / 0.6, 2) * s2) AS enough, n < 30 AS small FROM ci JOIN d USING (vendor)")
def bs14_equivalence_credential(spark: SparkSession, folder: str) -> DataFrame:
    """Per stratum: interval, verdict, needed cases and the small-sample warning."""
    d = F.col("score_a") - F.col("score_b")
    ci = percentile_ci(replicate_means(_deltas(spark, folder), ["vendor"], "series", "t", "c", CHECKED), ["vendor"])
    g = slices(spark, folder).groupBy("vendor").agg(F.avg(d).alias("mean"), F.var_samp(d).alias("s2"), F.count("*").alias("n"))
    need = F.ceil((1.959963984540054 / 0.6) ** 2 * F.col("s2"))
    out = g.join(ci, "vendor").select("vendor", "n", "mean", "low", "high", equivalence_verdict(F.col("low"), F.col("high"), 0.6).alias("verdict"), need.alias("required"), (F.col("n") >= need).alias("enough"), (F.col("n") < 30).alias("small"))
    return rounded(out, ["mean", "low", "high"])


def _area_sql(score: str) -> str:
    return f"n_{score} AS (SELECT lang, rep, {score} AS x, sum(m * label) AS p, sum(m * (1 - label)) AS q FROM w WHERE m > 0 GROUP BY ALL), v_{score} AS (SELECT lang, rep, p, q, p * (coalesce(sum(q) OVER (PARTITION BY lang, rep ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + q / 2) AS won FROM n_{score}), auc_{score} AS (SELECT lang, rep, sum(won)::DOUBLE / nullif(sum(p) * sum(q), 0)::DOUBLE AS auc FROM v_{score} GROUP BY ALL)"


_AREAS = f"WITH d AS (SELECT lang, quality AS label, n_chars AS a, (doc_id * 7919) % 1009 AS b FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL), w AS (SELECT lang, label, a, d.b, rep, {M_SQL.format(u='(a * 1009 + d.b)', b='rep')} AS m FROM d, (SELECT unnest(range({AREA_REPLICATES})) AS rep) r), {_area_sql('a')}, {_area_sql('b')} SELECT lang, round(quantile_cont(x.auc - y.auc, 0.025), 6) AS low, round(quantile_cont(x.auc - y.auc, 0.975), 6) AS high FROM auc_a x JOIN auc_b y USING (lang, rep) WHERE x.auc IS NOT NULL AND y.auc IS NOT NULL GROUP BY lang"


@query(_AREAS)
def bs4_bootstrap_auc_diff(spark: SparkSession, folder: str) -> DataFrame:
    """Paired difference of two areas over class-wise replicates: weighted counts per score, no repeated rows."""
    from assayer.operators.curves import _scores

    s = _scores(spark, folder).withColumn("unit", F.col("a") * 1009 + F.col("b"))
    s = s.withColumn("rep", F.explode(_numbers(0, AREA_REPLICATES))).withColumn("m", weight(F.col("rep"), F.col("unit"))).where("m > 0")

    def weighted(score: str) -> DataFrame:
        rows = s.groupBy("lang", "rep", score).agg(F.sum(F.col("m") * F.col("label")).alias("p"), F.sum(F.col("m") * (1 - F.col("label"))).alias("q"))
        below = F.coalesce(F.sum("q").over(Window.partitionBy("lang", "rep").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        rows = rows.withColumn("won", F.col("p") * (below + F.col("q") / 2)).groupBy("lang", "rep").agg(F.sum("won").alias("w"), F.sum("p").alias("p"), F.sum("q").alias("q"))
        return rows.select("lang", "rep", F.when(F.col("p") * F.col("q") > 0, F.col("w") / (F.col("p") * F.col("q"))).alias(f"auc_{score}"))

    both = weighted("a").join(weighted("b"), ["lang", "rep"]).select("lang", (F.col("auc_a") - F.col("auc_b")).alias("mean"))
    return rounded(percentile_ci(both.where("mean is not null"), ["lang"]), ["low", "high"])


#: Draws of the registered ranks.
RANK_REPLICATES = 1000
#: Numbers of observers that the slices are dealt to, each a multiple of the one before.
OBSERVERS = (1, 2, 4, 8, 16, 32)


def bootstrap_ranks(units: DataFrame, by: list[str], method: str, unit: str, value: str, replicates: int) -> DataFrame:
    """(by, method, share_last, rank_sum): all methods ranked in every replicate, best mean first, on the same draws.

    A unit counts as often for one method as for another. A replicate ranks the methods that it draws something of.
    """
    u = units.select(*by, method, unit, F.col(value).cast("double").alias("t"), F.lit(1.0).alias("c"))
    m = replicate_means(u, [*by, method], unit, "t", "c", replicates)
    w = Window.partitionBy(*by, "b")
    r = m.select(*by, method, F.rank().over(w.orderBy(F.desc("mean"))).alias("k"), F.count("*").over(w).alias("n"))
    return r.groupBy(*by, method).agg(F.avg((F.col("k") == F.col("n")).cast("int")).alias("share_last"), F.sum("k").cast("long").alias("rank_sum"))


def observers_needed(units: DataFrame, by: list[str], method: str, unit: str, value: str, control: str, observers: tuple[int, ...] = OBSERVERS, least: float = 0.95) -> DataFrame:
    """(by, k, share, needed): units dealt to k observers, the share of them that see the control last, and the smallest k with ``least`` of them.

    Sums are formed once for the largest number of observers; a smaller one's are sums of these.
    """
    most = max(observers)
    seat = (F.col(unit) % 1_000_003 * 7919 + 12_345) % 1_000_003 % most
    cells = units.groupBy(*by, method, seat.alias("seat")).agg(F.sum(value).alias("t"), F.count(value).alias("c"))
    dealt = cells.withColumn("k", F.explode(F.array(*map(F.lit, observers)))).groupBy(*by, "k", method, (F.col("seat") % F.col("k")).alias("observer")).agg((F.sum("t") / F.sum("c")).alias("mean"))
    w = Window.partitionBy(*by, "k", "observer").orderBy("mean")
    last = dealt.where("mean is not null").withColumn("place", F.rank().over(w)).groupBy(*by, "k", "observer").agg(F.bool_or((F.col(method) == control) & (F.col("place") == 1)).alias("last"))
    shares = last.groupBy(*by, "k").agg(F.avg(F.col("last").cast("int")).alias("share"))
    # six rows a stratum
    enough = F.min(F.when(F.col("share") >= least, F.col("k"))).over(Window.partitionBy(*(by or [F.lit(0)])))
    return shares.select(*by, "k", "share", enough.alias("needed"))


def _readings(spark: SparkSession, folder: str) -> DataFrame:
    return slices(spark, folder).select("dose", "method", (F.col("series") * 8 + F.col("slice")).alias("unit"), "cnr")


@query(
    f"WITH {SLICES}, b AS (SELECT dose, method, r.b, {M_SQL.format(u=_UNIT, b='r.b')} AS m, cnr FROM s, (SELECT unnest(range({RANK_REPLICATES})) AS b) r), "
    "m AS (SELECT dose, method, b, sum(m * cnr) / sum(m) AS mean FROM b WHERE m > 0 GROUP BY ALL), "
    "k AS (SELECT *, rank() OVER (PARTITION BY dose, b ORDER BY mean DESC) AS k, count(*) OVER (PARTITION BY dose, b) AS n FROM m) "
    "SELECT dose, method, round(avg((k = n)::INT), 6) AS share_last, sum(k)::BIGINT AS rank_sum FROM k GROUP BY ALL"
)
def bs12_rank_over_replicates(spark: SparkSession, folder: str) -> DataFrame:
    """Per dose, the share of slice replicates in which a method ranks last, and its rank sum."""
    return rounded(bootstrap_ranks(_readings(spark, folder), ["dose"], "method", "unit", "cnr", RANK_REPLICATES), ["share_last"])


@query(
    f"WITH {SLICES}, c AS (SELECT dose, method, ({_UNIT} % 1000003 * 7919 + 12345) % 1000003 % {max(OBSERVERS)} AS seat, cnr FROM s), "
    f"d AS (SELECT dose, k, method, seat % k AS o, avg(cnr) AS mean FROM c, (SELECT unnest({list(OBSERVERS)}) AS k) GROUP BY ALL), "
    f"r AS (SELECT *, rank() OVER (PARTITION BY dose, k, o ORDER BY mean) AS place FROM d), l AS (SELECT dose, k, o, bool_or(method = '{CONTROL}' AND place = 1) AS last FROM r GROUP BY ALL), "
    "s2 AS (SELECT dose, k, avg(last::INT) AS share FROM l GROUP BY ALL) SELECT dose, k, round(share, 6) AS share, min(k) FILTER (share >= 0.95) OVER (PARTITION BY dose) AS needed FROM s2"
)
def bs12_observers_needed(spark: SparkSession, folder: str) -> DataFrame:
    """How many observers it takes until the control is last for nearly all of them."""
    return rounded(observers_needed(_readings(spark, folder), ["dose"], "method", "unit", "cnr", CONTROL), ["share"])
