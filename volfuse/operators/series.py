"""Window work on time series, cut into blocks so that no task ever holds a whole series.

A series is identified by its keys and has one row per grid step. Rows are assigned to blocks of
``rows`` consecutive grid positions. Fixed-length frames see the neighbours they need because the
edge rows of a block are also sent to the next (or previous) block; unlimited look-back is answered
by one summary row per block, combined over the blocks of a series. A window partition therefore has a
bounded number of rows, however long one series is. Rows without a key or a time belong to no series and
are not expected here; the steps before drop them.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from volfuse.session import require_utc, stage

IDX, HOME, BLOCK, CENTRED = "_idx", "_home", "_block", "_centred"


@dataclass(frozen=True)
class Series:
    """Where a table's series live: key columns, time column, grid step in seconds, rows per block."""

    keys: tuple[str, ...] = ("symbol",)
    time: str = "hour"
    step: int = 3600
    rows: int = 4096

    def index(self) -> Column:
        """Position on the grid that all series share (steps since the epoch)."""
        return F.expr(f"floor(unix_seconds(cast(`{self.time}` as timestamp)) / {self.step})")

    def time_at(self, index: Column) -> Column:
        return F.timestamp_seconds(index * F.lit(self.step)).cast("timestamp_ntz")


HOURLY = Series()
DAILY = Series(time="day", step=86400)


@dataclass(frozen=True)
class Panel:
    """A table arranged in blocks of ``rows`` grid steps with halo rows; ``home()`` removes the halo again."""

    df: DataFrame
    before: int
    after: int
    window: WindowSpec
    so_far: WindowSpec
    spec: Series
    rows: int

    def frame(self, first: int, last: int):
        if first < -self.before or last > self.after:
            raise ValueError(f"frame {first}..{last} exceeds the halo {self.before}/{self.after}")
        return self.window.rowsBetween(first, last)

    def add(self, **columns: Column) -> Panel:
        return replace(self, df=self.df.withColumns(columns))

    def drop(self, *columns: str) -> Panel:
        return replace(self, df=self.df.drop(*columns))

    def inside(self, value: Column) -> Column:
        """``value`` on the block's own rows, null on its halo."""
        return F.when(F.col(BLOCK) == F.col(HOME), value)

    def placed(self) -> DataFrame:
        """The rows without the halo, with their places."""
        return self.df.filter(F.col(BLOCK) == F.col(HOME))

    def home(self) -> DataFrame:
        return self.placed().drop(IDX, HOME, BLOCK, CENTRED)

    def over(self, df: DataFrame) -> Panel:
        """The same blocks, without a halo, of rows that have their places."""
        return replace(self, df=df, before=0, after=0)


def to_panel(
    df: DataFrame,
    spec: Series = HOURLY,
    before: int = 0,
    after: int = 0,
    rows: int | None = None,
    index: Column | None = None,
) -> Panel:
    """Arrange ``df`` in blocks. ``index`` replaces the grid position, e.g. by a dense row number."""
    require_utc(df)
    rows = max(rows or spec.rows, before, after, 1)
    width = before + rows + after
    offset = f"pmod({IDX}, {rows})"
    first = f"{HOME} - if({offset} < {after}, 1, 0)"
    last = f"{HOME} + if({offset} >= {rows - before}, 1, 0)"
    copies = f"explode(sequence({first}, {last}))" if before or after else HOME
    placed = (
        df.withColumn(IDX, spec.index() if index is None else index)
        .withColumn(HOME, F.expr(f"floor({IDX} / {rows})"))
        .withColumn(BLOCK, F.expr(copies))
        .withColumn(CENTRED, F.expr(f"{IDX} - {BLOCK} * {rows} + {before} - {width // 2}"))
    )
    window = Window.partitionBy(*spec.keys, BLOCK).orderBy(IDX)
    return Panel(placed, before, after, window, window.rowsBetween(Window.unboundedPreceding, 0), spec, rows)


# --- decayed scans ----------------------------------------------------------------------------

_EXPONENT_RANGE = 1100.0  # natural-log width that doubles hold with room for the values themselves


@dataclass(frozen=True)
class Scan:
    """y(t) = alpha * x(t) + (1 - alpha) * y(t-1) over the non-null values x of column ``of``, kept in ``name``.

    It starts at input number ``head`` with the mean of the first ``head`` inputs and is null before.
    """

    name: str
    of: str
    alpha: float
    head: int = 1

    @property
    def keep(self) -> float:
        return 1.0 - self.alpha

    @property
    def count(self) -> str:
        return f"_n_{self.of}"

    def fits(self, rows: int) -> bool:
        """Whether rescaled sums over so many rows stay within doubles."""
        return self.alpha >= 1 or -math.log(self.keep) * rows <= _EXPONENT_RANGE


def scan_blocks(panel: Panel, scans: Sequence[Scan]) -> Panel:
    """Every scan inside its block, as if nothing came before, and the number of inputs so far.

    A running sum of rescaled weights does it in one window, shared by all scans; the exponent is centred on the
    block, which keeps both factors inside the range of doubles. A scan too fast for that doubles its reach
    instead, y(t) += keep**d * y(t-d) for d = 1, 2, 4 and so on, until that power is zero in doubles.
    """
    sums = {s.count: F.count(panel.inside(F.col(s.of))).over(panel.so_far) for s in scans}
    for s in scans:
        weight = panel.inside(F.lit(s.alpha) * F.col(s.of))
        if s.alpha < 1 and s.fits(panel.rows):
            power = F.pow(F.lit(s.keep), F.col(CENTRED))
            sums[s.name] = power * F.sum(weight / power).over(panel.so_far)
        else:
            sums[s.name] = F.coalesce(weight, F.lit(0.0))
    panel = panel.add(**sums)
    reach, fast = 1, [s for s in scans if not s.fits(panel.rows)]
    while fast := [s for s in fast if reach < panel.rows and s.keep**reach > 0]:
        back = panel.window.rangeBetween(-reach, -reach)
        earlier = {s.name: F.coalesce(F.sum(s.name).over(back), F.lit(0.0)) for s in fast}
        panel = panel.add(**{s.name: F.col(s.name) + F.lit(s.keep**reach) * earlier[s.name] for s in fast})
        reach *= 2
    return panel


def _every_block(ends: DataFrame, spec: Series) -> DataFrame:
    """One row for every block between the first and the last of each series; added ones hold nulls."""
    series = Window.partitionBy(*spec.keys).orderBy(BLOCK)
    spread = ends.withColumn("_until", F.coalesce(F.lead(BLOCK).over(series) - 1, F.col(BLOCK)))
    spread = spread.withColumn("_at", F.explode(F.sequence(BLOCK, "_until")))
    own = F.col("_at") == F.col(BLOCK)
    values = [c for c in ends.columns if c not in (*spec.keys, BLOCK)]
    return spread.select(*spec.keys, F.col("_at").alias(BLOCK), *[F.when(own, F.col(c)).alias(c) for c in values])


def _start(scan: Scan) -> tuple[Column, Column]:
    """From a block's first inputs: what the start adds to a scan at its first row, and the place of that row.

    The plain sum gives input i of the first ``head`` the weight alpha * keep**(head - i) there; it has to be
    1 / head.
    """
    first, before = F.col(f"_head_{scan.name}"), F.col(f"_before_{scan.count}")
    missing = lambda x, i: F.when(
        i + before < scan.head, x["x"] * (F.lit(1 / scan.head) - F.lit(scan.alpha) * F.pow(F.lit(scan.keep), F.lit(scan.head - 1) - i - before))
    )
    added = F.aggregate(F.transform(first, missing), F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
    row = F.filter(F.transform(first, lambda x, i: F.when(i + before == scan.head - 1, x["at"])), lambda x: x.isNotNull())
    return F.coalesce(added, F.lit(0.0)), F.get(row, F.lit(0))


def carry_over(panel: Panel, scans: Sequence[Scan], latest: Sequence[str] = ()) -> DataFrame:
    """The panel's own rows with every scan of ``scan_blocks`` continued from block to block, and the counts too.

    ``latest`` columns, filled forward inside their block, are filled from earlier blocks. Each block gives one
    row: the scans at its end, the counts, the first inputs. What enters a block is the sum of all earlier ends,
    each times keep**rows for every block in between, which is found by doubling, as in ``scan_blocks``; a window
    over these rows holds one for each block of a series. Nothing is cut off: powers end where doubles do.
    """
    spec, rows = panel.spec, panel.placed()
    offset = F.col(IDX) - F.col(BLOCK) * panel.rows
    counts = {s.count: s.of for s in scans}
    ends = [F.max(F.struct(IDX, F.col(c).alias("n")))["n"].alias(c) for c in counts]
    for s in scans:
        to_end = F.pow(F.lit(s.keep), F.lit(panel.rows - 1) - offset)
        ends.append(F.coalesce(F.max(F.struct(F.col(IDX), (F.col(s.name) * to_end).alias("y")))["y"], F.lit(0.0)).alias(f"_end_{s.name}"))
        given = F.col(s.of).isNotNull() & (F.col(s.count) <= s.head)
        entry = F.when(given, F.struct(F.col(IDX).alias("at"), F.col(s.of).cast("double").alias("x")))
        first = F.array_compact(F.array(F.min(entry))) if s.head == 1 else F.array_sort(F.collect_list(entry))
        ends.append(first.alias(f"_head_{s.name}"))
    ends += [F.max(F.when(F.col(c).isNotNull(), F.struct(F.col(IDX), F.col(c).alias("v"))))["v"].alias(f"_latest_{c}") for c in latest]
    blocks = _every_block(rows.groupBy(*spec.keys, BLOCK).agg(*ends), spec)
    series = Window.partitionBy(*spec.keys)
    ordered = series.orderBy(BLOCK)
    earlier = ordered.rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumns(
        {f"_before_{c}": F.coalesce(F.sum(c).over(earlier), F.lit(0)) for c in counts}
        | {f"_end_{s.name}": F.coalesce(f"_end_{s.name}", F.lit(0.0)) for s in scans}
        | {f"_from_{c}": F.last(f"_latest_{c}", ignorenulls=True).over(earlier) for c in latest}
    )
    reach, slow = 1, list(scans)
    while slow := [s for s in slow if s.keep ** (panel.rows * reach) > 0]:
        lagged = {f"_end_{s.name}": F.coalesce(F.lag(f"_end_{s.name}", reach).over(ordered), F.lit(0.0)) for s in slow}
        blocks = blocks.withColumns({f"_end_{s.name}": F.col(f"_end_{s.name}") + F.lit(s.keep ** (panel.rows * reach)) * lagged[f"_end_{s.name}"] for s in slow})
        reach *= 2
    facts = {}
    for s in scans:
        added, row = _start(s)
        facts |= {f"_in_{s.name}": F.coalesce(F.lag(f"_end_{s.name}").over(ordered), F.lit(0.0)), f"_add_{s.name}": added, f"_row_{s.name}": row}
    blocks = blocks.withColumns(facts)
    side = blocks.select(
        *spec.keys,
        BLOCK,
        *[f"_before_{c}" for c in counts],
        *[f"_from_{c}" for c in latest],
        *[f"_in_{s.name}" for s in scans],
        *[F.sum(f"_add_{s.name}").over(series).alias(f"_add_{s.name}") for s in scans],
        *[F.max(f"_row_{s.name}").over(series).alias(f"_row_{s.name}") for s in scans],
    )
    full = {c: F.col(c) + F.col(f"_before_{c}") for c in counts} | {c: F.coalesce(F.col(c), F.col(f"_from_{c}")) for c in latest}
    for s in scans:
        since = F.col(IDX) - F.col(f"_row_{s.name}")
        entered = F.pow(F.lit(s.keep), offset + 1) * F.col(f"_in_{s.name}")
        started = F.pow(F.lit(s.keep), since) * F.col(f"_add_{s.name}")
        full[s.name] = F.when(since >= 0, F.coalesce(F.col(s.name), F.lit(0.0)) + entered + started)
    return rows.join(side, [*spec.keys, BLOCK]).withColumns(full).select(*rows.columns)


def decayed_scan(
    df: DataFrame, col: str, alpha: float, out: str, spec: Series = HOURLY, rows: int | None = None
) -> DataFrame:
    """y(t) = alpha * x(t) + (1 - alpha) * y(t-1), started by the first non-null x of the series."""
    scan = Scan(out, col, alpha)
    panel = scan_blocks(to_panel(df, spec, rows=rows), [scan])
    return carry_over(panel.over(stage(panel.placed(), "scan")), [scan]).select(*[c for c in df.columns if c != out], out)


# --- unlimited look-back ----------------------------------------------------------------------


def _block(spec: Series) -> Column:
    # Never null, which keeps the planner from adding a filter to one reader of a shared exchange only.
    index = f"floor(unix_seconds(cast(`{spec.time}` as timestamp)) / {spec.step})"
    return F.expr(f"coalesce(floor({index} / {spec.rows}), 0L)")


def _carried(df: DataFrame, cols: Sequence[str], spec: Series) -> DataFrame:
    """One row per block: the latest non-null value of each column before the block starts, and the
    grid position at which the next block that has rows starts."""
    require_utc(df)
    latest = [F.expr(f"max_by(`{c}`, if(`{c}` is null, null, `{spec.time}`)) as `_last_{c}`") for c in cols]
    ends = df.groupBy(*spec.keys, _block(spec).alias(BLOCK)).agg(F.min(spec.index()).alias("_first"), *latest)
    blocks = Window.partitionBy(*spec.keys).orderBy(BLOCK)  # one row per `rows` grid steps
    earlier = blocks.rowsBetween(Window.unboundedPreceding, -1)
    return ends.select(
        *spec.keys,
        BLOCK,
        F.lead("_first").over(blocks).alias("_next_first"),
        *[F.last(f"_last_{c}", ignorenulls=True).over(earlier).alias(f"_carry_{c}") for c in cols],
    )


def _attach(df: DataFrame, side: DataFrame, spec: Series) -> DataFrame:
    """Add the per-block columns. The windows that follow use the same keys, so the join's partitioning
    serves them too."""
    return df.join(side, [*spec.keys, BLOCK])


def _filled(c: str, window) -> Column:
    return F.coalesce(F.last(c, ignorenulls=True).over(window), F.col(f"_carry_{c}"))


def ffill(df: DataFrame, cols: Sequence[str], spec: Series = HOURLY) -> DataFrame:
    """Replace nulls by the latest earlier non-null value of the series, however old it is."""
    local = Window.partitionBy(*spec.keys, BLOCK).orderBy(spec.time).rowsBetween(Window.unboundedPreceding, 0)
    joined = _attach(df.withColumn(BLOCK, _block(spec)), _carried(df, cols, spec), spec)
    return joined.withColumns({c: _filled(c, local) for c in cols}).select(*df.columns)


def fill_grid(df: DataFrame, carry: Sequence[str], zero: Sequence[str] = (), spec: Series = HOURLY) -> DataFrame:
    """One row for every step between the first and the last of each series.

    Each row is repeated up to the next one, so an added step needs no join: ``carry`` columns are
    filled forward (within given rows too), ``zero`` columns are 0 on added steps and all others null.
    A gap becomes one row for each block it touches first; these are dealt out by series and block, and
    each then makes the steps of its block, so a task never makes more than a block from one row.
    """
    window = Window.partitionBy(*spec.keys, BLOCK).orderBy(spec.time)
    local = window.rowsBetween(Window.unboundedPreceding, 0)
    placed = df.withColumns({IDX: spec.index(), BLOCK: _block(spec)})
    joined = _attach(placed, _carried(df, carry, spec), spec)
    following = F.coalesce(F.lead(IDX).over(window), F.col("_next_first"), F.col(IDX) + 1)
    until = joined.withColumns({"_until": following - 1, **{c: _filled(c, local) for c in carry}})
    piece = lambda c: F.floor(F.col(c) / spec.rows)
    pieces = until.drop(BLOCK, "_next_first").withColumn("_piece", F.explode(F.sequence(piece(IDX), piece("_until"))))
    first = F.greatest(F.col(IDX), F.col("_piece") * spec.rows)
    last = F.least(F.col("_until"), (F.col("_piece") + 1) * spec.rows - 1)
    # A number of tasks that adaptive execution keeps: it would judge the few rows before they are spread.
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = pieces.repartition(tasks, *[F.col(c) for c in (*spec.keys, "_piece")])
    spread = dealt.withColumn("_at", F.explode(F.sequence(first, last)))
    added = F.col("_at") != F.col(IDX)
    values = []
    for c in df.columns:
        if c == spec.time:
            values.append(spec.time_at(F.col("_at")).alias(c))
        elif c in spec.keys or c in carry:
            values.append(F.col(c))
        else:
            values.append(F.when(added, F.lit(0.0) if c in zero else F.lit(None)).otherwise(F.col(c)).alias(c))
    return spread.select(*values)


def number_rows(df: DataFrame, spec: Series = HOURLY, rn: str = "rn", n: str = "n") -> DataFrame:
    """Add each row's 1-based position in its series and the length of the series.

    Rows are numbered inside their block; one count per block gives the offset.
    """
    require_utc(df)
    local = Window.partitionBy(*spec.keys, BLOCK).orderBy(spec.time)
    counts = df.groupBy(*spec.keys, _block(spec).alias(BLOCK)).agg(F.count("*").alias("_rows"))
    series = Window.partitionBy(*spec.keys)
    earlier = series.orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *spec.keys,
        BLOCK,
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_offset"),
        F.sum("_rows").over(series).alias(n),
    )
    return (
        _attach(df.withColumn(BLOCK, _block(spec)), offsets, spec)
        .withColumn(rn, F.row_number().over(local) + F.col("_offset"))
        .select(*df.columns, rn, n)
    )


def with_halo(df: DataFrame, start, end, before: int, after: int, spec: Series = HOURLY) -> DataFrame:
    """Rows of [start, end] plus the steps around it that windows need; pushed into the scan."""
    low = F.to_timestamp_ntz(F.lit(start)) - F.expr(f"interval {before * spec.step} seconds")
    high = F.to_timestamp_ntz(F.lit(end)) + F.expr(f"interval {after * spec.step} seconds")
    return df.filter(F.col(spec.time).between(low, high))
