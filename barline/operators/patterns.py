"""Search for similar windows, and similarities of whole series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.functions import scalars, warping
from barline.functions.ma import PERIODS, s
from barline.operators import blocks
from barline.sources.bars import BASE
from barline.sources.store import cut

CROSS_PAIRS = tuple((p, q) for i, p in enumerate(PERIODS) for q in PERIODS[i + 1 :])


def centred(k: int) -> Column:
    """An average in cents less BASE, so that squares stay small."""
    return s(k) / F.lit(k) - F.lit(float(BASE))


def similar_windows(sums: DataFrame, code: str, lo: int, length: int = 10, stride: int = 2) -> DataFrame:
    """Every window of `length` bars at every `stride`-th place against the window of `code` at `lo`: code, start, similarity.

    0.4 trend + 0.3 exp(-mean squared difference) + 0.3 cosine of the z-scored (bars x averages) matrices. For z-scores the
    cosine is Pearson's r and the squared difference 2 (1 - r), so five sums of each window are enough. Windows are frames over blocks of bars that also have the
    `length` bars behind them, so each bar is exchanged once, but for those at the edge of a block, whatever the pattern's length. The pattern is one row: its broadcast has a fixed size.
    """
    values = F.array(*[centred(k) for k in PERIODS])
    flat = lambda c: F.flatten(F.transform(F.array_sort(c), lambda x: x["y"]))
    base = sums.where((F.col("code") == code) & F.col("n").between(lo, lo + length - 1)).agg(flat(F.collect_list(F.struct("n", values.alias("y")))).alias("y"))
    size = length * len(PERIODS)
    base = base.where(F.size("y") == size)  # one row, or none where the code has no such bars
    add = lambda c, f: F.aggregate(c, F.lit(0.0), lambda a, v: a + f(v))
    base = base.select("y", add("y", lambda v: v).alias("sy"), add("y", lambda v: v * v).alias("syy"), F.get("y", 0).alias("y0"), F.get("y", size - 1).alias("y1"))
    rows = sums.select("code", F.col("n").cast("long").alias("n"), values.alias("x")).withColumn("block", F.expr(f"n div {blocks.BLOCK}"))
    frame = blocks.in_block().rowsBetween(0, length - 1)
    rows = blocks.around(rows, 0, length - 1, blocks.BLOCK).withColumns({"sx": F.sum(add("x", lambda v: v)).over(frame), "sxx": F.sum(add("x", lambda v: v * v)).over(frame), "xs": F.collect_list("x").over(frame)})
    got = rows.where(F.col("own") & (F.col("n") % stride == 0) & (F.size("xs") == length)).crossJoin(F.broadcast(base))
    sxy = F.aggregate(F.zip_with(F.flatten("xs"), "y", lambda x, y: x * y), F.lit(0.0), lambda a, v: a + v)
    got = got.select("code", F.col("n").cast(sums.schema["n"].dataType).alias("start"), "sx", "sxx", "sy", "syy", "y0", "y1", sxy.alias("sxy"), F.get("x", 0).alias("x0"), F.element_at(F.element_at("xs", -1), -1).alias("x1"))
    m = float(length * len(PERIODS))
    sd = lambda a, b: F.sqrt(F.greatest(F.col(b) / m - (F.col(a) / m) * (F.col(a) / m), F.lit(0.0)))
    got = got.withColumns({"dx": sd("sx", "sxx"), "dy": sd("sy", "syy")})
    moving = (F.col("dx") > 1e-6) & (F.col("dy") > 1e-6)
    got = got.withColumns({"r": F.when(moving, (F.col("sxy") / m - F.col("sx") / m * F.col("sy") / m) / (F.col("dx") * F.col("dy"))).otherwise(0.0), "mse": F.when((F.col("dx") <= 1e-6) & (F.col("dy") <= 1e-6), 0.0).when(~moving, 1.0)})
    scaled = lambda a, b, d: F.when(F.col(d) > 1e-6, (F.col(b) - F.col(a)) / F.col(d)).otherwise(0.0)
    got = got.withColumns({"t1": scaled("x0", "x1", "dx"), "t2": scaled("y0", "y1", "dy")})
    size = F.when((F.col("t1") == 0) & (F.col("t2") == 0), 1.0).otherwise(F.coalesce(F.try_divide(F.least(F.abs("t1"), F.abs("t2")), F.greatest(F.abs("t1"), F.abs("t2"))), F.lit(0.0)))
    trend = (1 + F.signum(F.col("t1") * F.col("t2")) * size) / 2
    return got.select("code", "start", F.round(0.4 * trend + 0.3 * F.exp(-F.coalesce("mse", 2 * (1 - F.col("r")))) + 0.3 * F.col("r"), 6).alias("similarity"))


def top_per_code(found: DataFrame, k: int = 10, least: float = 0.7) -> DataFrame:
    w = Window.partitionBy("code").orderBy(F.desc("similarity"), "start")
    return found.where(F.col("similarity") >= least).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def tail(sums: DataFrame, days: int = 20, whole: bool = False) -> DataFrame:
    """The last bars of each code, numbered from 0; with `whole`, only of codes that have so many."""
    w = Window.partitionBy("code").orderBy(F.desc("ts"))
    out = sums.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= days)
    by = Window.partitionBy("code")
    out = out.withColumns({"i": F.max("_r").over(by) - F.col("_r"), "_c": F.count("*").over(by)})
    return (out.where(F.col("_c") >= days) if whole else out).drop("_r", "_c")


def series(sums: DataFrame, days: int = 20, whole: bool = True) -> DataFrame:
    """One row for each code: the averages of its last bars as arrays m4 .. m47; without `whole`, codes with fewer bars have shorter ones."""
    rows = tail(sums, days, whole)
    return rows.groupBy("code").agg(*[F.transform(F.array_sort(F.collect_list(F.struct("i", centred(k).alias("v")))), lambda x: x["v"]).alias(f"m{k}") for k in PERIODS])


WEIGHTS = {"direction": 0.15, "slope": 0.1, "volatility": 0.15, "pearson": 0.2, "spearman": 0.15, "dtw": 0.15, "mean_level": 0.1}
CROSS_WEIGHTS = {"golden_count": 0.25, "golden_position": 0.25, "death_count": 0.25, "death_position": 0.25}
GROUP_WEIGHTS = {"lines": 0.6, "crossover": 0.4}


def normalised(weights: dict[str, float]) -> dict[str, float]:
    """The weights divided by their sum, as a new mapping."""
    whole = sum(weights.values())
    if whole <= 0:
        raise ValueError("weights need a sum above 0")
    return {k: v / whole for k, v in weights.items()}


def pair_similarities(both: DataFrame, *keys: str) -> DataFrame:
    """Of arrays a and b: direction, slope, volatility, pearson, spearman, dtw and mean_level, from 0 to 1, beside the keys.

    The shorter array is resampled to the longer one's length. Constant arrays have no correlation; its value is 0.5. Arrays are averages less BASE.
    """
    return warped(pair_metrics(both, *keys)).select(*keys, *WEIGHTS)


def _near_warp(distance: Column) -> Column:
    return 1 - F.least(F.coalesce(F.try_divide(distance, F.col("_scale")), F.lit(0.0)), F.lit(1.0))


def warped(pairs: DataFrame) -> DataFrame:
    """pairs of `pair_metrics` with dtw, the similarity by their warping distance: a dynamic program over Arrow batches."""
    return pairs.withColumn("dtw", F.round(_near_warp(warping.distance("a", "b")), 6))


def least_warp(a: Column, b: Column) -> Column:
    """A distance that no warping is below: both ends are met, and so is every value, which lies as far from the other array's range."""
    beyond = lambda x, y: F.aggregate(x, F.lit(0.0), lambda acc, v: acc + F.greatest(v - F.array_max(y), F.array_min(y) - v, F.lit(0.0)))
    # One cell may be both ends.
    ends = F.greatest(F.abs(F.get(a, 0) - F.get(b, 0)), F.abs(F.element_at(a, -1) - F.element_at(b, -1)))
    return F.greatest(beyond(a, b), beyond(b, a), ends)


def pair_metrics(both: DataFrame, *keys: str) -> DataFrame:
    """As pair_similarities without dtw; with a and b at one length, and what a warping distance is divided by."""
    both = both.select(*keys, scalars.unified(F.col("a"), F.col("b")).alias("a"), scalars.unified(F.col("b"), F.col("a")).alias("b")).withColumn("size", F.size("a"))
    n = F.col("size").cast("double")
    centre = lambda c: F.transform(c, lambda x: x - scalars.mean(c))
    dot = lambda x, y: scalars.total(F.zip_with(x, y, lambda u, v: u * v))
    steps = F.transform(F.sequence(F.lit(0), F.col("size") - 1), lambda i: i - (n - 1) / 2)
    diff = lambda c: F.zip_with(F.slice(c, F.lit(2), F.col("size") - 1), F.slice(c, F.lit(1), F.col("size") - 1), lambda x, y: x - y)
    ranked = lambda c: F.transform(c, lambda x: F.size(F.filter(c, lambda y: y < x)) + (F.size(F.filter(c, lambda y: y == x)) + 1) / 2.0)
    near = lambda x, y: F.least(F.greatest(1 - F.abs(x - y) / (F.abs(x) + F.abs(y) + 1e-10), F.lit(0.0)), F.lit(1.0))
    corr = lambda x, y: F.coalesce((F.try_divide(dot(x, y), F.sqrt(dot(x, x) * dot(y, y))) + 1) / 2, F.lit(0.5))
    both = both.withColumns({"ca": centre(F.col("a")), "cb": centre(F.col("b")), "ra": ranked(F.col("a")), "rb": ranked(F.col("b"))})
    both = both.withColumns({"cra": centre(F.col("ra")), "crb": centre(F.col("rb")), "da": diff(F.col("a")), "db": diff(F.col("b"))})
    slope = lambda c: F.coalesce(F.try_divide(dot(steps, F.col(c)), (n * n * n - n) / 12), F.lit(0.0))
    sd = lambda c: F.sqrt(dot(F.col(c), F.col(c)) / n)
    reach = F.greatest(F.array_max("a"), F.array_max("b")) - F.least(F.array_min("a"), F.array_min("b"))
    level = lambda c: scalars.mean(F.col(c)) + float(BASE)
    same_way = scalars.mean(F.zip_with("da", "db", lambda x, y: (F.signum(x) == F.signum(y)).cast("double")))
    metrics = {
        "direction": F.coalesce(same_way, F.lit(0.0)),
        "slope": near(slope("a"), slope("b")),
        "volatility": 1 - F.abs(sd("ca") - sd("cb")) / (sd("ca") + sd("cb") + 1e-10),
        "pearson": corr(F.col("ca"), F.col("cb")),
        "spearman": corr(F.col("cra"), F.col("crb")),
        "mean_level": near(level("a"), level("b")),
    }
    return both.select(*keys, "a", "b", F.sqrt(n * reach * reach).alias("_scale"), *[F.round(v, 6).alias(k) for k, v in metrics.items()])


def line_similarities(rows: DataFrame, code: str, k: int = 4) -> DataFrame:
    """Each code's line MA_k against that of `code`. The target is one row: its broadcast has a fixed size."""
    own = rows.select("code", F.col(f"m{k}").alias("a"))
    target = own.where(F.col("code") == code).select(F.col("a").alias("b"))
    return pair_similarities(own.crossJoin(F.broadcast(target)), "code")


def crossings(rows: DataFrame) -> DataFrame:
    """Places of golden and death crosses of each pair of lines: code, pair, kind, places."""
    def places(upper: Column, lower: Column) -> Column:
        """Where `upper` comes to lie above `lower`."""
        return F.filter(F.sequence(F.lit(1), F.size(upper) - 1), lambda i: (F.get(upper, i - 1) <= F.get(lower, i - 1)) & (F.get(upper, i) > F.get(lower, i)))

    parts = []
    for p, q in CROSS_PAIRS:
        short, long = F.col(f"m{p}"), F.col(f"m{q}")
        parts += [F.struct(F.lit(f"{p}/{q}").alias("pair"), F.lit(kind).alias("kind"), found.alias("places")) for kind, found in (("golden", places(short, long)), ("death", places(long, short)))]
    return rows.select("code", F.size("m4").alias("length"), F.inline(F.array(*parts)))


def crossover_similarity(rows: DataFrame, code: str, weights: dict[str, float] = CROSS_WEIGHTS, golden: bool = True, resampled: bool = True) -> DataFrame:
    """The weighted mean over the pairs of lines of count and position similarity of golden and death crosses: code, crossover.

    Positions: 1 if neither line has crosses, 0 if one has none. Else both lists are resampled linearly to the longer one's length; two places or more are
    compared by dynamic time warping, one less the distance over the target series' length times the number of places, single ones by their difference over that length.
    With golden=False golden crosses count as alike, as an older version of the score has it. With resampled=False lists of places are warped as they are, of whatever
    lengths and single ones, too, as the oldest version has it.
    """
    weights = normalised(weights)
    found = crossings(rows)
    target = found.where(F.col("code") == code).select("pair", "kind", F.col("places").alias("wanted"), "length")
    both = found.drop("length").join(F.broadcast(target), ["pair", "kind"])  # 30 rows
    a, b = F.size("places"), F.size("wanted")
    count = 1 - F.abs(a - b) / (F.greatest(a, b, F.lit(1)) + 1e-10)
    doubles = lambda c: F.col(c).cast("array<double>")
    facing = (lambda c, d: scalars.unified(doubles(c), doubles(d))) if resampled else (lambda c, d: doubles(c))
    both = both.withColumns({"x": facing("places", "wanted"), "y": facing("wanted", "places")})
    single = 1 - F.least(F.abs(scalars.mean(F.col("x")) - scalars.mean(F.col("y"))) / F.col("length"), F.lit(1.0))
    warped = 1 - scalars.dtw(F.col("x"), F.col("y")) / (F.col("length") * F.greatest(a, b) + (1e-10 if resampled else 0))
    place = F.when((a == 0) & (b == 0), 1.0).when((a == 0) | (b == 0), 0.0).when((F.size("x") < 2) & F.lit(resampled), single).otherwise(warped)
    both = both.select("code", "kind", count.alias("count"), place.alias("position"))
    alike = lambda kind, c: F.lit(1.0) if kind == "golden" and not golden else F.avg(F.when(F.col("kind") == kind, F.col(c)))
    return both.groupBy("code").agg(F.round(sum((alike(*name.split("_")) * w for name, w in weights.items()), F.lit(0.0)), 6).alias("crossover"))


def group_similarity(rows: DataFrame, code: str, top: int = 20, weights: dict[str, float] = WEIGHTS, groups: dict[str, float] = GROUP_WEIGHTS, crosses: dict[str, float] = CROSS_WEIGHTS, golden: bool = True, resampled: bool = True) -> DataFrame:
    """The `top` codes most similar to `code`, itself among them: code, similarity, the mean line similarity and the crossover similarity weighted; ties by code.

    rows are series(); weights are divided by their sum. Warping is the dear part: each code gets a bound from `least_warp`, the `top` codes of the highest bounds are warped,
    and then those alone whose bound reaches the least score of these. The result is that of warping all.
    """
    weights, groups = normalised(weights), normalised(groups)
    lines = rows.select("code", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"m{k}").alias("a")) for k in PERIODS])).alias("line")).select("code", "line.*")
    target = lines.where(F.col("code") == code).select("k", F.col("a").alias("b"))  # six rows
    pairs = pair_metrics(lines.join(F.broadcast(target), "k"), "code", "k")
    pairs = pairs.join(crossover_similarity(rows, code, crosses, golden, resampled), "code")
    share = weights.get("dtw", 0.0)
    rest = sum((F.col(n) * w for n, w in weights.items() if n != "dtw"), F.lit(0.0))

    def scores(df: DataFrame, dtw: Column) -> DataFrame:
        """code and similarity of lines, by their warping similarity or a bound of it."""
        mean = df.groupBy("code").agg((F.sum(rest + share * dtw) / len(PERIODS)).alias("lines"), F.first("crossover").alias("crossover"))
        return mean.select("code", F.round(groups["lines"] * F.col("lines") + groups["crossover"] * F.col("crossover"), 6).alias("similarity"))

    if not share:
        return scores(pairs, F.lit(0.0)).orderBy(F.desc("similarity"), "code").limit(top)
    pairs = cut(pairs)  # six rows a code, which three branches read
    bounds = scores(pairs, _near_warp(least_warp(F.col("a"), F.col("b"))))
    exact = lambda codes: scores(warped(pairs.join(codes.select("code"), "code", "left_semi")), F.col("dtw"))
    first = exact(bounds.orderBy(F.desc("similarity"), "code").limit(top))
    # One row. Scores are rounded, so a bound may lie below its score by two last digits.
    bar = first.agg(F.when(F.count("*") >= top, F.min("similarity") - 2e-6).otherwise(-1.0).alias("bar"))
    return exact(bounds.crossJoin(F.broadcast(bar)).where("similarity >= bar")).orderBy(F.desc("similarity"), "code").limit(top)


def older_group_similarity(rows: DataFrame, code: str, top: int = 10) -> DataFrame:
    """The older score: only series of the target's own length, without the target, ten codes. Count and position of each kind of cross weigh the same, as the default weights have it; places are warped as they are."""
    length = rows.where(F.col("code") == code).select(F.size("m4").alias("own"))  # one row
    alike = rows.crossJoin(F.broadcast(length)).where(F.size("m4") == F.col("own")).drop("own")
    return group_similarity(alike, code, top + 1, resampled=False).where(F.col("code") != code).orderBy(F.desc("similarity"), "code").limit(top)


def same_stage_cosine(segments: DataFrame, code: str, stage: str, least: float = 0.8) -> DataFrame:
    """Segments of a stage whose 18 features are close to those of the code's first segment: code, lo, hi, similarity."""
    chosen = segments.where(F.col("stage") == stage)
    target = chosen.where(F.col("code") == code).agg(F.min_by("features18", F.struct("lo", "hi")).alias("wanted"))  # one row
    both = chosen.crossJoin(F.broadcast(target)).withColumn("similarity", F.round(scalars.cosine(F.col("features18"), F.col("wanted")), 6))
    return both.where(F.col("similarity") >= least).select("code", "lo", "hi", "similarity")
