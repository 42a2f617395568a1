"""Reconciling, adjusting and filtering bars, and the joins around them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from .series import BUCKET_DAYS, kept, speculative


def by_time():
    return Window.partitionBy("symbol").orderBy("ts")


def dedupe_bars(bars: DataFrame, order: str) -> DataFrame:
    """One bar per symbol and time: the last by ``order``."""
    w = Window.partitionBy("symbol", "ts").orderBy(F.desc(order))
    return bars.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


def latest_n_bars(bars: DataFrame, n: int) -> DataFrame:
    """The newest n bars of each symbol, n between 32 and 5000."""
    n = max(32, min(5000, n))
    return bars.withColumn("nth", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts")))).where(F.col("nth") <= n).drop("nth")


def source_fallback(official: DataFrame, fallback: DataFrame, minimum: int = 32) -> DataFrame:
    """Per symbol the official bars if there are enough, else the fallback's if enough, else none. Adds ``source``."""
    both = official.withColumn("source", F.lit("official")).unionByName(fallback.withColumn("source", F.lit("fallback")))
    w = Window.partitionBy("symbol")
    n = {s: F.count_if(F.col("source") == s).over(w) for s in ("official", "fallback")}
    chosen = F.when(n["official"] >= minimum, "official").when(n["fallback"] >= minimum, "fallback")
    return both.withColumn("chosen", chosen).where(F.col("source") == F.col("chosen")).drop("chosen")


def min_history_gate(bars: DataFrame, minimum: int) -> tuple[DataFrame, DataFrame]:
    """(bars of symbols with enough of them; symbol and count of the others)."""
    n = bars.withColumn("bars", F.count("*").over(Window.partitionBy("symbol")))
    return n.where(F.col("bars") >= minimum).drop("bars"), n.where(F.col("bars") < minimum).groupBy("symbol").agg(F.count("*").alias("bars"))


def finite_series_check(bars: DataFrame, column: str = "close") -> DataFrame:
    """Per symbol the number of bars and of missing or non-finite values, and whether the series can be used."""
    bad = F.col(column).isNull() | F.isnan(column) | (F.abs(column) == float("inf"))
    return bars.groupBy("symbol").agg(F.count("*").alias("bars"), F.count_if(bad).alias("bad")).withColumn("usable", (F.col("bars") > 0) & (F.col("bad") == 0))


def reconcile_streams(primary: DataFrame, baseline: DataFrame, tolerance: float = 0.001, source: str = "baseline") -> DataFrame:
    """Primary bars against a baseline of (symbol, ts, close): where they diverge by more than ``tolerance`` the baseline's close is taken.

    Baseline keys must be unique (see ``dedupe_bars``). Bars without a match stay as they are, with a null score.
    """
    b = baseline.select("symbol", "ts", F.col("close").alias("base_close"))
    gap = F.when(F.col("base_close") == 0, 0.0).otherwise(F.abs(F.col("close") - F.col("base_close")) / F.abs("base_close"))
    joined = primary.join(b, ["symbol", "ts"], "left").withColumn("divergence_score", gap).withColumn("anomaly", F.coalesce(F.col("divergence_score") > tolerance, F.lit(False)))
    return joined.withColumn("close", F.when(F.col("anomaly"), F.col("base_close")).otherwise(F.col("close"))).withColumn("fallback_source", F.when(F.col("anomaly"), source)).drop("base_close")


def detect_corporate_actions(bars: DataFrame, drop: float = 0.4, reverse: float = 2.3, multiple: float = 8.0) -> DataFrame:
    """(symbol, ts, factor, kind, price_ratio) where the close jumps far beyond the symbol's usual moves.

    The usual move is the upper median of the absolute log moves; a jump counts if its ratio is at most ``drop`` or at
    least ``reverse`` and its log exceeds the larger of 0.5 and ``multiple`` times the usual move.
    """
    r = bars.withColumn("c1", F.lag("close").over(by_time())).where((F.col("c1") > 0) & (F.col("close") > 0))
    r = r.withColumn("price_ratio", F.col("close") / F.col("c1")).withColumn("move", F.abs(F.log("price_ratio")))
    per = Window.partitionBy("symbol")
    r = r.withColumn("nth", F.row_number().over(per.orderBy("move")) - 1).withColumn("n", F.count("*").over(per))
    r = r.withColumn("median", F.max(F.when(F.col("nth") == F.floor(F.col("n") / 2), F.col("move"))).over(per))
    jump = ((F.col("price_ratio") <= drop) | (F.col("price_ratio") >= reverse)) & (F.col("move") >= F.greatest(F.lit(0.5), multiple * F.col("median")))
    return r.where(jump).select("symbol", "ts", (F.col("c1") / F.col("close")).alias("factor"), F.when(F.col("price_ratio") < 1, "SPLIT").otherwise("REVERSE_SPLIT").alias("kind"), "price_ratio")


def apply_corporate_actions(bars: DataFrame, actions: DataFrame, adjust_ohlc: bool = False) -> DataFrame:
    """Divide the close (and open, high and low, if asked) by the product of all later factors, multiply the volume by it.

    Bars and actions are one stream of events; the product is the exponential of a running sum of logarithms from the
    end, so no bar meets an action in a join. An action at a bar's own time doesn't touch it. Factors not above 0 are ignored.
    """
    a = actions.where((F.col("factor") > 0) & (F.col("factor") < float("inf"))).select("symbol", "ts", F.log("factor").alias("lf"))
    events = bars.withColumn("lf", F.lit(None).cast("double")).withColumn("bar", F.lit(True)).unionByName(a.withColumn("bar", F.lit(False)), allowMissingColumns=True)
    later = Window.partitionBy("symbol").orderBy(F.unix_micros("ts").desc()).rangeBetween(Window.unboundedPreceding, -1)
    out = events.withColumn("product", F.exp(F.coalesce(F.sum("lf").over(later), F.lit(0.0)))).where("bar")
    for c in ("open", "high", "low", "close") if adjust_ohlc else ("close",):
        out = out.withColumn(c, F.col(c) / F.col("product"))
    return out.withColumn("volume", F.col("volume") * F.col("product")).drop("lf", "bar", "product")


def bad_print_step(window: int = 5, volume_window: int = 20, sigma: float = 3.0):
    """A step over a symbol's bars: state (how many accepted closes, these, the last volumes) or None at first, and whether the bar is rejected.

    A close is a bad print if it is more than ``sigma`` deviations from the last accepted ones and its volume is less
    than twice the mean of the volumes before it (to nine decimals: volumes of adjusted bars are products, and a ratio
    of two must not hang on their last digit).
    """

    def step(state, close, volume):
        k = int(state[0]) if state else 0
        accepted, volumes = (state[1 : 1 + k], state[1 + k :]) if state else ([], [])
        bad = False
        if k >= 2:
            m = sum(accepted) / k
            s = (sum((x - m) ** 2 for x in accepted) / k) ** 0.5
            if s > 0 and abs(close - m) > sigma * s:
                base = sum(volumes) / len(volumes) if volumes else 0.0
                bad = (round(volume / base, 9) if base > 0 else float("inf")) < 2
        if not bad:
            accepted = [*accepted, close][-window:]
        return [float(len(accepted)), *accepted, *[*volumes, volume][-volume_window:]], (bad,)

    return step


def flag_bad_prints(bars: DataFrame, window: int = 5, volume_window: int = 20, sigma: float = 3.0, bucket_days: float = BUCKET_DAYS) -> DataFrame:
    """``bars`` (symbol, ts, close, volume) with ``rejected``. Whether a bar is depends on which bars before it were: chunks of a series run speculatively (see ``series``)."""
    rows = speculative(bars, bad_print_step(window, volume_window, sigma), "rejected boolean", 3 * volume_window, bucket_days)
    return rows.select("symbol", "ts", "close", "volume", "rejected")


def clean_history(bars: DataFrame) -> DataFrame:
    """Detect and apply corporate actions, then flag bad prints."""
    return flag_bad_prints(apply_corporate_actions(bars, detect_corporate_actions(bars)))


def lasting_actions(bars: DataFrame, low: float = 0.4, high: float = 2.3) -> DataFrame:
    """The detected actions without the two of a bar whose close jumps and is back at the next one: that is a bad print, no action."""
    w = by_time()
    stays = lambda ratio: F.coalesce((ratio <= low) | (ratio >= high), F.lit(True))
    b = bars.select("symbol", "ts", stays(F.lead("close").over(w) / F.lag("close").over(w)).alias("s1"), stays(F.col("close") / F.lag("close", 2).over(w)).alias("s2"))
    return detect_corporate_actions(bars).join(b.where("s1 and s2").select("symbol", "ts"), ["symbol", "ts"], "left_semi")


def prepare_verified_matrix(primary: DataFrame, baseline: DataFrame, actions: DataFrame | None = None) -> DataFrame:
    """Bars (symbol, ts, close, volume, usable) that are reconciled, free of bad prints and adjusted; usable: the symbol's closes are all finite.

    ``actions`` (symbol, ts, factor) are the lasting ones of the reconciled bars unless given. Bad prints are told from
    adjusted closes, as every price after a split would count as one; for a series without actions that is the order of
    reconciling, bad prints, corporate actions and finite check.
    """
    r = reconcile_streams(primary, baseline).select("symbol", "ts", "close", "volume")
    adjusted = flag_bad_prints(apply_corporate_actions(r, lasting_actions(r) if actions is None else actions)).where("not rejected").drop("rejected")
    return adjusted.join(finite_series_check(adjusted).select("symbol", "usable"), "symbol")


def append_live_quote(bars: DataFrame, quotes: DataFrame) -> DataFrame:
    """A flat bar from each symbol's quote, if it is later than the symbol's last bar; volume of the quote, else of the last bar, else 0."""
    end = bars.groupBy("symbol").agg(F.max("ts").alias("end"), F.max_by("volume", "ts").alias("last_volume"))
    q = quotes.select("symbol", F.col("ts").alias("ts"), F.col("close").alias("price"), F.col("volume").alias("quoted")).join(end, "symbol").where(F.col("ts") > F.col("end"))
    new = q.select("symbol", "ts", *[F.col("price").alias(c) for c in ("open", "high", "low", "close")], F.coalesce("quoted", "last_volume", F.lit(0.0)).alias("volume"))
    return bars.withColumn("live", F.lit(False)).unionByName(new.withColumn("live", F.lit(True)))


def enrich_quotes(quotes: DataFrame, catalog: DataFrame) -> DataFrame:
    """Quotes with name and sector of the catalog (unknown: null)."""
    return quotes.join(catalog, "symbol", "left")


def missing_symbols(wanted: DataFrame, quotes: DataFrame) -> DataFrame:
    """Those of ``wanted`` (symbol), trimmed and in upper case, that no quote has."""
    return wanted.select(F.upper(F.trim("symbol")).alias("symbol")).distinct().join(quotes.select("symbol"), "symbol", "left_anti")


def prefix_join(cutoffs: DataFrame, bars: DataFrame) -> DataFrame:
    """Each of ``cutoffs`` (symbol, cutoff, train_end) with the symbol's bars numbered below train_end: its expanding training window.

    The rows grow with the square of a series; running sums (``walk_forward``, ``factors``) need none of them. For models
    that must see every training row.
    """
    b = bars.withColumn("idx", F.row_number().over(by_time()) - 1)
    return cutoffs.join(b, "symbol").where(F.col("idx") < F.col("train_end"))


def horizon_targets(bars: DataFrame, horizon: int = 5, purge: int = 5, step: int = 5, minimum: int = 50) -> DataFrame:
    """Per cutoff: the last training close (``purge`` + 1 bars before), the close ``horizon`` bars after, and the return between them."""
    w = by_time()
    b = bars.withColumn("idx", F.row_number().over(w) - 1).withColumn("start", F.lag("close", purge + 1).over(w)).withColumn("target", F.lead("close", horizon).over(w))
    ok = (F.col("idx") >= minimum) & ((F.col("idx") - minimum) % step == 0) & (F.col("idx") - purge >= minimum) & F.col("target").isNotNull()
    return b.where(ok).select("symbol", "ts", F.col("idx").alias("cutoff"), "start", "target", (F.col("target") / F.col("start") - 1).alias("actual_return"))


#: Returns of a block of ``covariance_pairs``, on average of the blocks at most.
BLOCK_ROWS = 1_000_000
#: Symbols of the one and of the other block in a tile, and times of a slice.
TILE, SLICE = (128, 512), 1_024
#: Symbols of the one block in a row that leaves Python: Spark holds the pairs of a row at once.
ROW = 4


class Series:
    """Rows (symbol, t, ret) of a block, flat: the symbol's place, the time, and the return less the symbol's mean."""

    def __init__(self, rows: pa.Table):
        self.symbols, t, ret = (rows[c].combine_chunks() for c in ("symbol", "t", "ret"))
        length = pc.list_value_length(t).to_numpy(zero_copy_only=False)
        self.start = np.concatenate([[0], np.cumsum(length)])
        self.own = np.repeat(np.arange(len(length)), length)
        self.t, ret = t.flatten().to_numpy(), ret.flatten().to_numpy()
        self.ret = ret - (np.bincount(self.own, ret, len(length)) / length)[self.own]

    def spread(self, rows: range, at: np.ndarray, times: range) -> tuple[np.ndarray, np.ndarray]:
        """Returns (0 where there are none) and whether there are any, ``rows`` by ``times``; ``at``: the number of each time."""
        cells = slice(self.start[rows.start], self.start[rows.stop])
        own, at, ret = self.own[cells] - rows.start, at[cells] - times.start, self.ret[cells]
        within = (at >= 0) & (at < len(times))
        own, at, ret = own[within], at[within], ret[within]
        r, there = np.zeros((len(rows), len(times))), np.zeros((len(rows), len(times)))
        r[own, at], there[own, at] = ret, 1.0
        return r, there


def cut(n: int, size: int) -> list[range]:
    return [range(i, min(i + size, n)) for i in range(0, n, size)]


def covariance_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of two blocks (or of one with itself, each once): rows of ``ROW`` left symbols by ``width`` right ones; n is 0 where a pair has no row."""
    group = pa.Table.from_batches(batches)
    x, y = group["x"][0].as_py(), group["y"][0].as_py()
    left = Series(group.filter(pc.equal(group["block"], x)))
    right = left if x == y else Series(group.filter(pc.equal(group["block"], y)))
    del group
    times = np.unique(np.concatenate([left.t, right.t]))
    left_at, right_at = (np.searchsorted(times, s.t) for s in (left, right))
    for j in cut(len(right.symbols), TILE[1]):
        for i in cut(len(left.symbols), TILE[0]):
            if x == y and i.start >= j.stop:
                continue  # the same pairs as those of a tile on the other side of the diagonal
            sums = None
            for s in cut(len(times), SLICE):
                (rx, tx), (ry, ty) = left.spread(i, left_at, s), right.spread(j, right_at, s)
                part = (tx @ ty.T, rx @ ry.T, rx @ ty.T, tx @ ry.T)
                sums = part if sums is None else tuple(a + b for a, b in zip(sums, part, strict=True))
            n, xy, xs, ys = sums
            with np.errstate(divide="ignore", invalid="ignore"):
                cov = (xy - xs * ys / n) / (n - 1)
            if x == y:
                n = np.where(np.array(i)[:, None] <= np.array(j)[None, :], n, 0)
            starts, width = np.array([*range(0, len(i), ROW), len(i)]), len(j)
            lists = lambda values, each: pa.ListArray.from_arrays(pa.array(starts * each, pa.int32()), values)
            again = pa.ListArray.from_arrays(pa.array(np.arange(len(starts)) * width, pa.int32()), right.symbols.take(pa.array(np.tile(np.array(j), len(starts) - 1))))
            made = [lists(left.symbols[i.start : i.stop], 1), again, pa.array(np.full(len(starts) - 1, width), pa.int32()), lists(pa.array(n.ravel().astype("int32")), width), lists(pa.array(cov.ravel()), width)]
            yield pa.RecordBatch.from_arrays(made, ["left", "right", "width", "n", "cov"])


def covariance_pairs(returns: DataFrame, block_symbols: int = 4_096) -> DataFrame:
    """Sample covariance of each pair of symbols over their common times, (a, b, n, cov) with a <= b; pairs without a common time have no row.

    ``returns`` (symbol, ts, ret) has one row a symbol and time at most. Symbols are dealt into blocks by hash; two blocks
    are one group, whose sums over the common times are matrix products, made in tiles of pairs and slices of time, so a
    task's memory is that of two blocks' series and one tile. Pairs leave Python as arrays; Spark makes their rows.
    The covariance over a single common time is null.
    """
    series = returns.where(F.col("ret").isNotNull() & F.col("symbol").isNotNull()).groupBy("symbol").agg(F.collect_list(F.struct(F.unix_micros("ts").alias("t"), F.col("ret").cast("double").alias("ret"))).alias("s"))
    series = kept(series.select("symbol", F.col("s.t").alias("t"), F.col("s.ret").alias("ret")))  # read for its size and for the blocks
    whole = series.agg(F.count("*").alias("symbols"), F.coalesce(F.sum(F.size("t")), F.lit(0)).alias("rows")).first()
    # blocks have ``block_symbols`` and BLOCK_ROWS on average at most, and fewer symbols as long as that makes more groups for the tasks
    n_blocks = max(1, -(-whole.symbols // block_symbols), -(-whole["rows"] // BLOCK_ROWS), min(32, -(-whole.symbols // 512)))
    groups, blocks = n_blocks * (n_blocks + 1) // 2, F.lit(n_blocks).cast("long")
    # series are few bytes: as many tasks as there are cores send them, or groups would come in crumbs
    series = series.coalesce(4 * returns.sparkSession.sparkContext.defaultParallelism).withColumn("block", F.pmod(F.xxhash64("symbol"), blocks))
    # a symbol goes to its block's pairs with every block, as the lesser or the greater of the two
    pairs = series.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))).select(F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "symbol", "t", "ret")
    tiles = pairs.repartition(groups, "x", "y").groupBy("x", "y").applyInArrow(covariance_tiles, "left array<string>, right array<string>, width int, n array<int>, cov array<double>")
    one = tiles.select("left", "right", "width", "n", F.posexplode("cov").alias("at", "cov")).withColumn("n", F.get("n", F.col("at"))).where("n > 0")
    one = one.select(F.get("left", F.expr("int(at div width)")).alias("l"), F.get("right", F.col("at") % F.col("width")).alias("r"), F.col("n").cast("long").alias("n"), F.when(F.col("n") > 1, F.col("cov")).alias("cov"))
    return one.select(F.least("l", "r").alias("a"), F.greatest("l", "r").alias("b"), "n", "cov")


def catalyst_events(announcements: DataFrame, symbols: DataFrame, positive: list[str], negative: list[str], at_once: int = 200_000) -> DataFrame:
    """(doc_id, symbol, at, direction, excerpt): the first place of each symbol in an announcement's text in upper case, wherever it is part of it, and the class of the excerpt around it.

    An automaton of all symbols (at most ``at_once`` of them; more take a pass for each so many) goes over each text once,
    so the work doesn't grow with the number of symbols. Empty and null symbols and null texts match nothing.
    """
    import ahocorasick

    from ..functions.scalar import classify_text, collapse

    texts = announcements.select("doc_id", F.upper(collapse(F.col("text"))).alias("clean")).where("clean is not null")
    wanted = symbols.select("symbol").where("symbol <> ''").distinct()
    parts = max(1, -(-wanted.count() // at_once))
    schema = StructType([texts.schema["doc_id"], StructField("symbol", StringType()), StructField("at", IntegerType()), StructField("excerpt", StringType())])
    out = None
    for part in range(parts):
        words = [r.symbol for r in wanted.where(F.pmod(F.xxhash64("symbol"), F.lit(parts)) == part).collect()]

        def scan(pdfs, words=words):
            found = ahocorasick.Automaton()
            for w in words:
                found.add_word(w, w)
            if words:
                found.make_automaton()
            for pdf in pdfs:
                rows = []
                for doc, text in zip(pdf["doc_id"], pdf["clean"], strict=True):
                    first = {}
                    for end, w in found.iter(text) if words else ():
                        first.setdefault(w, end - len(w) + 1)
                    rows += [(doc, w, at + 1, text[max(at - 250, 0) : at + 1500]) for w, at in first.items()]
                yield pd.DataFrame(rows, columns=schema.names)

        hits = texts.mapInPandas(scan, schema)
        out = hits if out is None else out.unionByName(hits)
    return out.select("doc_id", "symbol", "at", classify_text(F.col("excerpt"), positive, negative).alias("direction"), "excerpt")
