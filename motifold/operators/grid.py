"""Joins of several relations in one round: a grid of cells over the variables.

Every variable is an axis, cut by a hash of its values into as many parts as its share says.  A row goes to all cells that its
own values allow, so every solution meets in exactly one cell, and each relation is shuffled once, whatever the
number of joins.  Shares come from the sizes of the relations: of all grids with enough cells the one that sends the fewest rows.
A value that holds very many rows of a relation is spread over the other axes; cells are counted before rows move,
and the grid grows until the fullest is small enough.

In a cell the variables are bound one by one.  Each binding is extended through the relation that has the fewest values for it, and the
others only test, so no cell lists the pairs of a hub that no third relation confirms.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import combinations_with_replacement, permutations
from math import prod

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.triples import union_all

#: Rows of all relations that a cell should hold, and the most it may hold before the grid grows.
CELL_ROWS = 800_000
FULL_CELL_ROWS = 2 * CELL_ROWS
#: The grid is not cut further than this; what then is over full is one value on every axis.
MOST_CELLS = 1 << 22
#: Rows that are packed together on their way to the cells.
PACK_ROWS = 1_000_000
#: Bindings extended at a time.
STEP_ROWS = 1 << 20


@dataclass(frozen=True)
class Grid:
    """The share of each variable."""

    shares: dict[str, int]

    @property
    def cells(self) -> int:
        return prod(self.shares.values())

    def copies(self, variables: Sequence[str]) -> int:
        """Cells to which a row of a relation over ``variables`` goes."""
        return prod(n for v, n in self.shares.items() if v not in variables)


def choose_grid(sizes: Sequence[tuple[Sequence[str], int]], cells: int, least: dict[str, int] | None = None) -> Grid:
    """Shares, powers of two and at least ``least``, whose product is at least ``cells``, with the fewest rows sent."""
    names = list(dict.fromkeys(v for variables, _ in sizes for v in variables))
    base = {v: (least or {}).get(v, 1) for v in names}
    doublings = 0
    while prod(base.values()) << doublings < cells:
        doublings += 1

    def grown(axes: Sequence[str]) -> Grid:
        return Grid({v: n << axes.count(v) for v, n in base.items()})

    def cost(grid: Grid) -> tuple[int, list[int]]:
        sent = sum(n * grid.copies(variables) for variables, n in sizes)
        return sent, sorted(grid.shares.values(), reverse=True)

    if doublings <= 8:
        return min((grown(axes) for axes in combinations_with_replacement(names, doublings)), key=cost)
    grid = grown(())
    for _ in range(doublings):  # one axis after the other, where all ways are too many
        grid = min((Grid({**grid.shares, v: 2 * grid.shares[v]}) for v in names), key=cost)
    return grid


def _fixed(grid: Grid, variables: Sequence[str]) -> Column:
    """Where a row lies on its own axes, as the number of its cell at the start of all others."""
    fixed, step = F.lit(0).cast("bigint"), 1
    for v, share in grid.shares.items():
        if v in variables:
            fixed = fixed + F.pmod(F.xxhash64(F.lit(v), F.col(f"`{v}`")), F.lit(share)) * step
        step *= share
    return fixed


def _copied(grid: Grid, variables: Sequence[str]) -> Column:
    """The cells of column ``fixed``: all parts of the axes that are not its own."""
    cells, step = F.array("fixed"), 1
    for v, share in grid.shares.items():
        if v not in variables and share > 1:
            shifts = F.sequence(F.lit(0).cast("bigint"), F.lit((share - 1) * step).cast("bigint"), F.lit(step).cast("bigint"))
            cells = _sums(cells, shifts)
        step *= share
    return cells


def _sums(a: Column, b: Column) -> Column:
    """All sums of an element of each array."""
    return F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: x + y)))


def fullest_cells(relations: Sequence[DataFrame], grid: Grid) -> list[int]:
    """Rows in the fullest cell of each relation, from counts that merge before the shuffle.

    All cells on a relation's free axes hold the same of its rows, so each row counts once, by its own axes.
    """
    out = []
    for df in relations:
        own = Grid({v: share for v, share in grid.shares.items() if v in df.columns})
        per_cell = df.select(_fixed(own, df.columns).alias("cell")).groupBy("cell").count()
        out.append(per_cell.agg(F.coalesce(F.max("count"), F.lit(0)).alias("n")).first()["n"])
    return out


def fitted_grid(relations: Sequence[DataFrame], sizes: Sequence[int], cell_rows: int = CELL_ROWS) -> Grid:
    """A grid whose cells hold about ``cell_rows`` rows, none much more than that if any cut can prevent it."""
    counted = [(df.columns, n) for df, n in zip(relations, sizes, strict=True)]
    cells = 1
    while True:
        grid = choose_grid(counted, cells)
        sent = sum(n * grid.copies(variables) for variables, n in counted)
        if sent <= cell_rows * grid.cells or grid.cells >= MOST_CELLS:
            break
        cells = 2 * grid.cells
    most = cell_rows * FULL_CELL_ROWS // CELL_ROWS
    while grid.cells > 1 and grid.cells < MOST_CELLS:
        full = fullest_cells(relations, grid)
        worst = full.index(max(full))
        if full[worst] <= most:
            break
        # The axis of the over-full relation that is cut least: a hub on one of its axes is spread by the others.
        axis = min(relations[worst].columns, key=lambda v: grid.shares[v])
        grid = Grid({**grid.shares, axis: 2 * grid.shares[axis]})
    return grid


class _Trie:
    """Rows of a relation as a trie over its columns: a level's nodes are the distinct prefixes of that length, in order.

    ``values`` holds the last value of each node, ``starts`` where the children of a node of the level above begin, and ``codes``
    node above and value as one number, sorted.
    """

    def __init__(self, columns: Sequence[np.ndarray], width: int) -> None:
        rows = _distinct_rows(columns, width)
        n = len(rows[0])
        self.width = width
        self.values, self.starts, self.codes = [], [], []
        first = np.zeros(min(n, 1), np.int64)  # rows where the nodes of a level begin
        change = np.zeros(n, bool)
        change[:1] = True
        for column in rows:
            change[1:] |= column[1:] != column[:-1]
            nodes = np.flatnonzero(change)
            self.starts.append(np.append(np.searchsorted(nodes, first), len(nodes)))
            above = np.repeat(np.arange(len(first)), np.diff(self.starts[-1]))
            self.values.append(column[nodes])
            self.codes.append(above * width + column[nodes])
            first = nodes
        # The first level is looked up without a search.
        self.top = np.full(width, -1, np.int64)
        if n:
            self.top[self.values[0]] = np.arange(len(self.values[0]))

    def children(self, depth: int, nodes: np.ndarray | None, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First child and number of children of the nodes of each of ``n`` bindings; None is the root."""
        starts = self.starts[depth]
        if nodes is None:
            return np.zeros(n, np.int64), np.full(n, starts[-1], np.int64)
        return starts[nodes], starts[nodes + 1] - starts[nodes]

    def child(self, depth: int, nodes: np.ndarray | None, value: np.ndarray) -> np.ndarray:
        """The child with a value, or -1."""
        if nodes is None:
            return self.top[value]
        codes, wanted = self.codes[depth], nodes * self.width + value
        at = np.minimum(np.searchsorted(codes, wanted), len(codes) - 1)
        return np.where(codes[at] == wanted, at, -1)


def _distinct_rows(columns: Sequence[np.ndarray], width: int) -> list[np.ndarray]:
    """Columns of the distinct rows, sorted; value numbers are below ``width``."""
    if width ** len(columns) < 1 << 62:
        codes = reduce(lambda code, column: code * width + column, columns)
        codes = np.unique(codes)
        out = []
        for _ in columns[1:]:
            codes, column = np.divmod(codes, width)
            out.append(column)
        return [codes, *out[::-1]]
    own = np.unique(np.stack(columns, axis=1), axis=0)
    return [own[:, k] for k in range(own.shape[1])]


def bind_all(
    tables: Sequence[tuple[list[str], list[np.ndarray]]],
    order: Sequence[str],
    width: int,
    steps: list[int] | None = None,
) -> Iterator[list[np.ndarray]]:
    """Solutions of the relations of one cell, as value numbers in the order of the variables, in pieces.

    ``tables`` gives each relation's variables and its columns of value numbers below ``width``.  The numbers of extended
    bindings are added to ``steps``.
    """
    names, tries = [], []
    for variables, columns in tables:
        by_order = sorted(range(len(variables)), key=lambda i: order.index(variables[i]))
        names.append([variables[i] for i in by_order])
        tries.append(_Trie([columns[i].astype(np.int64, copy=False) for i in by_order], width))
    if any(not len(t.codes[0]) for t in tries):
        return

    def extend(bound: list[np.ndarray], nodes: list[np.ndarray | None], n: int, depth: int) -> Iterator[list[np.ndarray]]:
        """Extend ``n`` bindings, of which ``nodes`` says where they are in each trie."""
        if depth == len(order):
            yield bound
            return
        users = [(k, names[k].index(order[depth])) for k in range(len(tries)) if order[depth] in names[k]]
        held = [tries[k].children(level, nodes[k], n) for k, level in users]
        if len(users) == 1:
            chosen, least = None, held[0][1]
        else:
            counts = np.array([c for _, c in held])
            chosen, least = counts.argmin(axis=0), counts.min(axis=0)
        ends = np.cumsum(least)
        start = 0
        while start < n:
            before = ends[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(ends, before + STEP_ROWS, "right")))
            rows = np.repeat(np.arange(start, end), least[start:end])
            if steps is not None:
                steps.append(len(rows))
            place = np.arange(len(rows)) - np.repeat(ends[start:end] - least[start:end] - before, least[start:end])
            start = end
            value = np.empty(len(rows), np.int64)
            for i, (k, level) in enumerate(users):
                mine = slice(None) if chosen is None else np.flatnonzero(chosen[rows] == i)
                value[mine] = tries[k].values[level][held[i][0][rows[mine]] + place[mine]]
            reached = {}
            for i, (k, level) in enumerate(users):
                if chosen is None:
                    reached[k] = held[i][0][rows] + place
                    continue
                found = tries[k].child(level, None if nodes[k] is None else nodes[k][rows], value)
                keep = np.flatnonzero(found >= 0)
                if len(keep) < len(rows):
                    rows, value, found = rows[keep], value[keep], found[keep]
                    reached = {q: r[keep] for q, r in reached.items()}
                reached[k] = found
            if len(rows):
                after = [reached[k] if k in reached else None if at is None else at[rows] for k, at in enumerate(nodes)]
                yield from extend([*(b[rows] for b in bound), value], after, len(rows), depth + 1)

    yield from extend([], [None] * len(tries), 1, 0)


_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _common_types(relations: Sequence[DataFrame]) -> dict[str, T.DataType]:
    """The type of each variable: that of its columns, or the widest of several whole-number types."""
    found: dict[str, T.DataType] = {}
    for field in (f for df in relations for f in df.schema.fields):
        old = found.setdefault(field.name, field.dataType)
        if old != field.dataType:
            if not all(isinstance(t, _WHOLE) for t in (old, field.dataType)):
                raise ValueError(f"variable {field.name} has different types in two relations")
            found[field.name] = max(old, field.dataType, key=lambda t: _WHOLE.index(type(t)))
    return found


def variable_order(tables: Sequence[tuple[list[str], list[np.ndarray]]], width: int) -> list[str]:
    """The order of the variables with the fewest expected bindings along the way.

    A variable's values per binding are estimated by the relation with the fewest rows per distinct value of its bound
    variables; every other relation that holds the variable and a bound one keeps its share of them.
    """
    distinct = [{v: np.count_nonzero(np.bincount(c, minlength=width)) for v, c in zip(*own, strict=True)} for own in tables]
    rows = [len(columns[0]) for _, columns in tables]
    variables = list(dict.fromkeys(v for names, _ in tables for v in names))
    domain = {v: max(d[v] for d in distinct if v in d) for v in variables}

    def per_binding(bound: Sequence[str], v: str) -> float:
        fans = []
        for (names, _), own, n in zip(tables, distinct, rows, strict=True):
            if v in names:
                known = [own[b] for b in names if b in bound]
                fans.append((max(1.0, n / min(n, prod(known))) if known else own[v], bool(known)))
        least = min(range(len(fans)), key=lambda k: fans[k][0])
        kept = prod(min(1.0, fan / domain[v]) for k, (fan, met) in enumerate(fans) if k != least and met)
        return fans[least][0] * kept

    def cost(order: Sequence[str]) -> float:
        total, bindings = 0.0, 1.0
        for k, v in enumerate(order):
            bindings *= per_binding(order[:k], v)
            total += bindings
        return total

    if len(variables) <= 5:
        return list(min(permutations(variables), key=cost))
    order: list[str] = []
    while len(order) < len(variables):  # one after the other, where all orders are too many
        order.append(min((v for v in variables if v not in order), key=lambda v: cost([*order, v])))
    return order


def grid_join(
    relations: Sequence[DataFrame],
    sizes: Sequence[int] | None = None,
    cell_rows: int = CELL_ROWS,
    grid: Grid | None = None,
) -> DataFrame:
    """Natural join of relations (sets) that share variables in any way, cycles included, in one shuffle.

    ``sizes`` are numbers of rows, counted if not given.  Nulls never meet.
    """
    if len(relations) < 2:
        return relations[0]
    variables = list(dict.fromkeys(v for df in relations for v in df.columns))
    types = _common_types(relations)
    relations = [
        df.select(*(F.col(f"`{v}`").cast(types[v]).alias(v) for v in df.columns)).dropna() for df in relations
    ]
    if grid is None:
        grid = fitted_grid(relations, sizes or [df.count() for df in relations], cell_rows)
    blocks = union_all(
        _packed(df, grid).select(F.explode(_copied(grid, df.columns)).alias("cell"), F.lit(number).alias("relation"), "block")
        for number, df in enumerate(relations)
    )
    columns = [df.columns for df in relations]

    def cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[pa.Table]] = [[] for _ in columns]
        for batch in batches:
            for number, block in zip(batch.column("relation").to_pylist(), batch.column("block"), strict=True):
                held[number].append(pq.ParquetFile(pa.BufferReader(block.as_buffer())).read(use_threads=False))
        if not all(held):
            return
        rows = [pa.concat_tables(own) for own in held]
        numbers, values = [{} for _ in columns], {}
        for v in variables:
            users = [k for k, own in enumerate(columns) if v in own]
            every = pa.chunked_array([c for k in users for c in rows[k].column(v).chunks]).combine_chunks().dictionary_encode()
            coded, start = every.indices.to_numpy(zero_copy_only=False).astype(np.int64), 0
            for k in users:
                numbers[k][v] = coded[start : start + rows[k].num_rows]
                start += rows[k].num_rows
            values[v] = every.dictionary
        tables = [(own, [numbers[k][v] for v in own]) for k, own in enumerate(columns)]
        width = max(map(len, values.values()))
        order = variable_order(tables, width)
        for bound in bind_all(tables, order, width):
            found = dict(zip(order, bound, strict=True))
            yield pa.RecordBatch.from_arrays([values[v].take(pa.array(found[v])) for v in variables], variables)

    schema = T.StructType([T.StructField(v, types[v]) for v in variables])
    # Blocks are small for the work that they stand for: adaptive execution, which goes by bytes, would merge cells into few tasks.
    spark = blocks.sparkSession
    tasks = min(grid.cells, max(4 * spark.sparkContext.defaultParallelism, grid.cells // 8))
    return blocks.repartition(tasks, "cell").groupBy("cell").applyInArrow(cell, schema)


def _packed(df: DataFrame, grid: Grid) -> DataFrame:
    """``(fixed, block)``: rows of one part of a relation's own axes, sorted and packed, as they go to every cell of the part.

    Rows are packed where they are read; a block holds what ``PACK_ROWS`` of them have of its part.
    """
    names = df.columns
    whole = [f.name for f in df.schema.fields if isinstance(f.dataType, _WHOLE)]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= PACK_ROWS:
                yield from blocks(held)
                held, n = [], 0
        if n:
            yield from blocks(held)

    def blocks(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        table = table.take(pc.sort_indices(table, [(c, "ascending") for c in ("#fixed", *names)]))
        fixed, rows = table.column("#fixed").to_numpy(), table.select(names)
        cuts = [0, *(np.flatnonzero(fixed[1:] != fixed[:-1]) + 1).tolist(), len(fixed)]
        for start, stop in zip(cuts, cuts[1:], strict=False):
            sink = pa.BufferOutputStream()
            pq.write_table(
                rows.slice(start, stop - start),
                sink,
                compression="zstd",
                use_dictionary=[c for c in names if c not in whole],
                column_encoding={c: "DELTA_BINARY_PACKED" for c in whole},
                write_statistics=False,
            )
            yield pa.RecordBatch.from_arrays([pa.array([fixed[start]]), pa.array([sink.getvalue().to_pybytes()])], ["fixed", "block"])

    return df.withColumn("#fixed", _fixed(grid, names)).mapInArrow(packed, "fixed bigint, block binary")
