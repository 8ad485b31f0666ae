"""Related notes: exact cosine candidates and the diversified choice among them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notefold.functions.text import top_folder
from notefold.plans.shared import kept
from notefold.sources.vault import opened

#: Vectors in a block.
BLOCK = 1024
#: Asking rows that a task takes through the candidates at a time, in blocks; candidate blocks that it reads at once.
GROUP, STRIPE = 8, 16
#: Pivots, and the vectors that they are fitted on. Both only decide how much is skipped, never what is found.
PIVOTS, SAMPLE = 256, 16_384
#: Pairs whose exact scores are computed at once.
PAIRS = 1 << 16
#: Bytes of candidates up to which they go to every task instead of being shuffled.
SENT = 32 << 20
#: What angles and scores to nine decimals may be off by.
SLACK = 1e-7
_ROWS = "path string, chunk int, floor double, rank long, cell int, angle double, u binary"
_BLOCKS = "block long, cell int, low double, high double, n int, paths array<string>, chunks array<int>, floors binary, ranks binary, lead binary, m binary"
_NEAR = "note string, chunk int, path string, path_chunk int, score double"


def _units(v: pa.ListArray) -> np.ndarray:
    """Vectors scaled to length one, a row each; shorter ones are padded with zeros, and zeros stay."""
    sizes = np.diff(v.offsets.to_numpy())
    m = np.zeros((len(sizes), int(sizes.max(initial=0))))
    m[np.arange(m.shape[1]) < sizes[:, None]] = v.flatten().to_numpy(zero_copy_only=False)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def _fitted_pivots(sample: np.ndarray, most: int, rounds: int = 6) -> np.ndarray:
    """Directions that a sample of unit vectors gathers around."""
    at = sample[np.linspace(0, len(sample) - 1, most).astype(int)]
    for _ in range(rounds):
        label = (sample @ at.T).argmax(1)
        sums = np.zeros_like(at)
        np.add.at(sums, label, sample)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        at = np.where(size > 1e-12, sums / np.maximum(size, 1e-12), at)
    return at


def _angles(m: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    d = min(m.shape[1], pivots.shape[1])  # beyond it one of the two is zero
    return np.arccos(np.clip(m[:, :d] @ pivots[:, :d].T, -1, 1))


def _dealt(pivots: np.ndarray):
    """Rows with their number in order (of its task, then within), the pivot that they are nearest to, and their angle to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 40
        for b in batches:
            u = _units(b["v"])
            angle = _angles(u, pivots)
            cell = angle.argmin(1) if len(u) else np.zeros(0, int)
            own = pa.array([row.tobytes() for row in u], pa.binary())
            rank = pa.array(first + np.arange(len(u)))
            first += len(u)
            yield pa.RecordBatch.from_arrays([b["path"], b["chunk"], b["floor"], rank, pa.array(cell, pa.int32()), pa.array(angle[np.arange(len(u)), cell]), own], names=["path", "chunk", "floor", "rank", "cell", "angle", "u"])

    return run


def _leaders(m: np.ndarray, ranks: np.ndarray, k: int) -> np.ndarray:
    """Rows of a block but for those that are behind k copies of themselves: as candidates these come behind them for whoever asks."""
    order = np.argsort(ranks, kind="stable")
    _, copy = np.unique(np.ascontiguousarray(m[order]).view(f"V{8 * m.shape[1]}").ravel(), return_inverse=True) if m.shape[1] else (None, np.zeros(len(m), int))
    by = np.argsort(copy, kind="stable")
    place = np.arange(len(m)) - np.searchsorted(copy[by], copy[by])
    return np.sort(order[by[place < k]])


def _pack(size: int, copies: int):
    """Rows in order of cell and angle as blocks, none of two cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, serial = TaskContext.get().partitionId(), 0
        held: pa.Table | None = None

        def blocks(t: pa.Table, over: bool):
            nonlocal serial
            cells = t["cell"].to_numpy()
            while len(t):
                end = min(size, int(np.searchsorted(cells, cells[0], "right")))
                if end == len(t) and end < size and not over:
                    break  # the cell may go on
                own = t.slice(0, end).combine_chunks()
                u = [np.frombuffer(x) for x in own["u"].to_pylist()]
                m = np.zeros((end, max(map(len, u))))
                for k, x in enumerate(u):
                    m[k, : len(x)] = x
                angle = own["angle"].to_numpy()
                column = lambda c: own[c].combine_chunks()
                one = lambda values: pa.ListArray.from_arrays(pa.array([0, end], pa.int32()), values.chunk(0) if isinstance(values, pa.ChunkedArray) else values)
                floors = own["floor"].fill_null(-np.inf).to_numpy()
                row = [pa.array([part << 32 | serial]), pa.array(cells[:1], pa.int32()), pa.array([angle.min()]), pa.array([angle.max()]), pa.array([end], pa.int32()), one(column("path")), one(column("chunk")), pa.array([floors.tobytes()]), pa.array([(ranks := own["rank"].to_numpy()).tobytes()]), pa.array([_leaders(m, ranks, copies).astype(np.int32).tobytes()]), pa.array([m.tobytes()])]
                serial += 1
                yield pa.RecordBatch.from_arrays(row, names=["block", "cell", "low", "high", "n", "paths", "chunks", "floors", "ranks", "lead", "m"])
                t, cells = t.slice(end), cells[end:]
            return t

        for b in batches:
            t = pa.Table.from_batches([b])
            held = yield from blocks(pa.concat_tables([held, t]) if held is not None else t, False)
        if held is not None:
            yield from blocks(held, True)

    return run


def _asking(rows: DataFrame) -> DataFrame:
    floor = F.col("floor") if "floor" in rows.columns else F.lit(None).cast("double").alias("floor")
    return rows.where("v is not null").select("path", "chunk", floor, F.col("v").cast("array<double>").alias("v"))


def _blocks(rows: DataFrame, pivots: np.ndarray, size: int, k: int) -> DataFrame:
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = ["cell", "angle", F.xxhash64("path", "chunk")]  # copies of one vector are dealt by their names
    named = _asking(rows).repartitionByRange(parts, "path", "chunk").sortWithinPartitions("path", "chunk")
    return named.mapInArrow(_dealt(pivots), _ROWS).repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_pack(size, k), _BLOCKS)


class _Files:
    """Candidate blocks in Parquet files of the shared folder: their ranges of angles, and a stripe of them (a row group) when it is asked for."""

    def __init__(self, files: list[str]):
        self._files, stripes, parts = [], [], []
        for name in files:
            fs, path = opened(name)
            file = pq.ParquetFile(fs.open_input_file(path))
            for g in range(file.num_row_groups):
                parts.append(file.read_row_group(g, ["cell", "low", "high"]))
                stripes += [len(self._files)] * parts[-1].num_rows
                self._files.append((file, g))
        listed = pa.concat_tables(parts)
        self.cell, self.low, self.high = (listed[c].to_numpy() for c in ("cell", "low", "high"))
        self.stripe = np.array(stripes)
        self.first = np.searchsorted(self.stripe, np.arange(len(self._files)))

    def read(self, stripe: int, columns: list[str]) -> pa.Table:
        file, g = self._files[stripe]
        return file.read_row_group(g, columns)


class _Lists:
    """The k best of some asking rows so far: score, number by name, and place, of each."""

    def __init__(self, k: int, q: np.ndarray, floors: np.ndarray):
        self._k, self._q, self._small = k, q, q.astype(np.float32)
        self.least, self.compared = floors.copy(), 0
        self.score, self.rank, self.place = (np.full((len(q), k), x) for x in (-np.inf, np.iinfo(np.int64).max, np.int64(-1)))
        self._new: list[tuple[np.ndarray, ...]] = []
        self._waiting = 0

    def meet(self, own: np.ndarray, c: np.ndarray, rank: np.ndarray, place: np.ndarray) -> None:
        """Rows `own` meet candidates: single precision finds those near or over the bound, double precision tells their scores."""
        d = min(self._q.shape[1], c.shape[1])
        c = np.ascontiguousarray(c[:, :d])
        small, error = c.astype(np.float32).T, np.float32((d + 16) * 1.2e-7)
        for s in range(0, len(own), BLOCK):
            part = own[s : s + BLOCK]
            self.compared += len(part) * len(c)
            near = self._small[part, :d] @ small
            bound = (self.least[part] - error).astype(np.float32)
            if len(c) > self._k:
                unknown = np.flatnonzero(bound == -np.inf)
                if len(unknown):
                    bound[unknown] = -np.partition(-near[unknown], self._k - 1, axis=1)[:, self._k - 1] - 2 * error
            at = np.flatnonzero(near >= bound[:, None])
            for t in range(0, len(at), PAIRS):
                i, j = np.divmod(at[t : t + PAIRS], len(c))
                i = part[i]
                score = np.round(np.einsum("ij,ij->i", self._q[i, :d], c[j]), 9)
                keep = score >= self.least[i]
                self._new.append((i[keep], score[keep], rank[j[keep]], place[j[keep]]))
                self._waiting += int(keep.sum())
                if self._waiting >= 8 * len(self._q):
                    self.settle()

    def settle(self) -> None:
        """Take in what was found since the last time."""
        if not self._waiting:
            self._new.clear()
            return
        row, *more = (np.concatenate(x) for x in zip(*self._new, strict=True))
        self._new, self._waiting, k = [], 0, self._k
        rows = np.unique(row)
        each = np.r_[np.repeat(rows, k), row]
        score, rank, place = (np.r_[old[rows].ravel(), x] for old, x in zip((self.score, self.rank, self.place), more, strict=True))
        order = np.lexsort((rank, -score, each))
        each = each[order]
        order = order[np.arange(len(each)) - np.searchsorted(each, each) < k].reshape(len(rows), k)
        self.score[rows], self.rank[rows], self.place[rows] = score[order], rank[order], place[order]
        self.least[rows] = np.maximum(self.least[rows], self.score[rows, k - 1])


def _searched(k: int, pivots: np.ndarray, files: list[str], block: int, count: bool):
    """The best of all candidates for blocks of asking rows, or how many pairs are compared for them."""

    def found(have: _Files, rows: list[dict]) -> pa.RecordBatch:
        width = max(len(r["m"]) // (8 * r["n"]) for r in rows)
        q = np.concatenate([np.pad(x := np.frombuffer(r["m"]).reshape(r["n"], -1), ((0, 0), (0, width - x.shape[1]))) for r in rows])
        lists = _Lists(k, q, np.concatenate([np.frombuffer(r["floors"]) for r in rows]))
        angle = _angles(q, pivots)

        def bound(b: int) -> np.ndarray:
            # a vector at angles low to high from a pivot is at least this far from one at another angle
            own = angle[:, have.cell[b]]
            return np.cos(np.maximum(0, np.maximum(own - have.high[b], have.low[b] - own))) + SLACK

        most = np.array([bound(b).mean() for b in range(len(have.cell))])
        for stripe in np.argsort(-np.maximum.reduceat(most, have.first), kind="stable").tolist():  # those beside the asking rows first
            t = None
            for b in range(have.first[stripe], have.first[stripe] + (have.stripe == stripe).sum()):
                own = np.flatnonzero(bound(b) >= lists.least)
                if len(own):
                    t = have.read(stripe, ["n", "ranks", "lead", "m"]) if t is None else t
                    at = int(b - have.first[stripe])
                    lead = np.frombuffer(t["lead"][at].as_buffer(), np.int32)
                    c = np.frombuffer(t["m"][at].as_buffer()).reshape(t["n"][at].as_py(), -1)
                    lists.meet(own, c[lead], np.frombuffer(t["ranks"][at].as_buffer(), np.int64)[lead], (int(b) << 32) + lead.astype(np.int64))
            lists.settle()
        if count:
            return pa.RecordBatch.from_arrays([pa.array([lists.compared])], names=["pairs"])
        row, rank = np.nonzero(lists.place >= 0)
        place, paths, chunks = lists.place[row, rank], [], []
        order = np.argsort(place, kind="stable")
        b, at = place[order] >> 32, place[order] & 0xFFFFFFFF
        stripes = have.stripe[b]
        for stripe in np.unique(stripes).tolist():
            t, own = have.read(stripe, ["paths", "chunks"]).combine_chunks(), slice(*np.searchsorted(stripes, [stripe, stripe + 1]))
            start = t["paths"].chunk(0).offsets.to_numpy()
            index = pa.array(start[b[own] - have.first[stripe]] - start[0] + at[own])
            paths.append(t["paths"].chunk(0).flatten().take(index))
            chunks.append(t["chunks"].chunk(0).flatten().take(index))
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        asked, back = pa.array(row), pa.array(back)
        joined = lambda parts, kind: pa.concat_arrays(parts) if parts else pa.array([], kind)
        note, chunk = pa.array([x for r in rows for x in r["paths"]], pa.string()), pa.array([x for r in rows for x in r["chunks"]], pa.int32())
        cols = [note.take(asked), chunk.take(asked), joined(paths, pa.string()).take(back), joined(chunks, pa.int32()).take(back), pa.array(lists.score[row, rank]), pa.array((rank + 1).astype(np.int32))]
        return pa.RecordBatch.from_arrays(cols, names=["note", "chunk", "path", "path_chunk", "score", "rank"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, rows = None, []
        for b in batches:
            for r in b.select(["n", "paths", "chunks", "floors", "m"]).to_pylist():
                have = _Files(files) if have is None else have
                rows.append(r)
                if sum(r["n"] for r in rows) >= GROUP * block:
                    yield found(have, rows)
                    rows = []
        if rows:
            yield found(have, rows)

    return run


def _top(k: int, row: np.ndarray, at: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Those with a score of at least the k-th of their row; ties of the last place stay for the final ranking."""
    order = np.lexsort((-score, row))
    row, at, score = row[order], at[order], score[order]
    start = np.searchsorted(row, row)
    last = np.minimum(start + k - 1, np.searchsorted(row, row, "right") - 1)
    keep = (np.arange(len(row)) - start < k) | (score >= score[last])
    return row[keep], at[keep], score[keep]


def _sent(have: DataFrame, asking: DataFrame, k: int, block: int, count: int) -> Found:
    """Neighbours among few candidates, which go to every task."""
    rows = have.toArrow()  # of a checked size
    u = _units(rows["v"].combine_chunks())
    spread = np.linspace(0, count - 1, min(SAMPLE, count)).astype(int)
    pivots = _fitted_pivots(u[spread], min(PIVOTS, max(1, count // (2 * block))))
    angle = _angles(u, pivots)
    cell = angle.argmin(1)
    angle = angle[np.arange(count), cell]
    order = np.lexsort((angle, cell))
    u, cell, angle, names = u[order], cell[order], angle[order], rows.select(["path", "chunk"]).take(pa.array(order)).combine_chunks()
    starts = [int(s) for c in np.unique(cell) for s in range(int(np.searchsorted(cell, c)), int(np.searchsorted(cell, c, "right")), block)]
    ends = [*starts[1:], count]
    place = np.empty(count, np.int64)
    place[sorted(range(count), key=list(zip(*names.to_pydict().values(), strict=True)).__getitem__)] = np.arange(count)
    low, high = (np.array([angle[x] for x in at]) for at in (starts, [e - 1 for e in ends]))

    def best(q: np.ndarray, floors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Row, candidate and score of each row's best, and how many were compared."""
        at = _angles(q, pivots)[:, cell[starts]]
        bound = np.cos(np.maximum(0, np.maximum(at - high, low - at))) + SLACK
        home, least, d = bound.argmax(1) if len(q) else np.zeros(0, int), floors.copy(), min(q.shape[1], u.shape[1])
        held, compared = (np.zeros(0, int), np.zeros(0, int), np.zeros(0)), 0
        for first in (True, False):
            for b, (s, e) in enumerate(zip(starts, ends, strict=True)):
                own = np.flatnonzero((home == b) == first) if first else np.flatnonzero((home != b) & (bound[:, b] >= least))
                if not len(own):
                    continue
                compared += len(own) * (e - s)
                score = np.round(q[own, :d] @ u[s:e, :d].T, 9)
                i, j = np.nonzero(score >= least[own, None])
                held = _top(k, *(np.concatenate(p) for p in zip(held, (own[i], s + j, score[i, j]), strict=True)))
                start = np.searchsorted(held[0], own)
                full = np.searchsorted(held[0], own, "right") - start >= k
                least[own[full]] = np.maximum(least[own[full]], held[2][start[full] + k - 1])
        row, found, score = held
        order = np.lexsort((place[found], -score, row))
        row, found, score = row[order], found[order], score[order]
        keep = np.arange(len(row)) - np.searchsorted(row, row) < k
        return row[keep], found[keep], score[keep], compared

    def asked(b: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, tuple]]:
        for s in range(0, len(b), block):
            part = b.slice(s, block)
            yield part, best(_units(part["v"]), part["floor"].fill_null(-np.inf).to_numpy(zero_copy_only=False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, (row, found, score, _) in asked(b):
                i, j = pa.array(row), pa.array(found)
                rank = np.arange(len(row)) - np.searchsorted(row, row) + 1
                yield pa.RecordBatch.from_arrays([part["path"].take(i), part["chunk"].take(i), names["path"].combine_chunks().take(j), names["chunk"].combine_chunks().take(j), pa.array(score), pa.array(rank, pa.int32())], names=["note", "chunk", "path", "path_chunk", "score", "rank"])

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(x[3] for _, x in asked(b))]), pa.array([len(b) * count])], names=["pairs", "possible"])

    parts = max(1, int(have.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = _asking(asking).repartition(parts, "path", "chunk")

    def counted() -> tuple[int, int]:
        r = dealt.mapInArrow(count_pairs, "pairs long, possible long").agg(F.sum("pairs"), F.sum("possible")).first()
        return r[0] or 0, r[1] or 0

    return Found(dealt.mapInArrow(run, _NEAR + ", rank int"), counted)


@dataclass(frozen=True)
class Found:
    """Neighbours, and how many of all pairs of vectors are compared for them (counted when asked for)."""

    rows: DataFrame
    counted: Callable[[], tuple[int, int]] = lambda: (0, 0)

    @property
    def compared(self) -> int:
        return self.counted()[0]

    @property
    def possible(self) -> int:
        return self.counted()[1]


def nearest_chunks(chunks: DataFrame, k: int = 40, asking: DataFrame | None = None, block: int = BLOCK) -> Found:
    """note, chunk, path, path_chunk, score, rank: the k nearest of all chunks (path, chunk, v) by cosine of each chunk that asks, itself and its siblings included.

    All chunks ask where no `asking` (path, chunk, v) is given; a column `floor`
    of it names a score under which nothing is wanted, null for none.  Scores
    have nine decimals, ties go by path and chunk.  A null vector takes no part.

    Candidates of at most SENT bytes (checked) go to every task, in blocks like
    those below, and asking rows meet the blocks that they need there.

    1. Pivots are fitted on a bounded sample.  Chunks go by pivot and angle to it
       into blocks that hold a range of angles, however many are alike, and the
       blocks into files of the shared folder.
    2. Each task takes asking rows through those files, a stripe of blocks at a
       time, nearest ranges first: no pair of blocks is shuffled, and what a task
       holds does not grow with the table.  Only the first k copies of a vector
       in a block are compared.
    3. The k-th score so far is a row's bound.  By the triangle inequality of
       angles, a range of angles around a pivot can only hold scores up to the
       cosine of the gap to it; ranges that reach no asking row's bound are not
       read.  Vectors without structure need all; what is found is the same.
    """
    spark = chunks.sparkSession
    have = chunks.where("v is not null").select("path", "chunk", F.col("v").cast("array<double>").alias("v"))
    count, numbers, letters = have.agg(F.count("*"), F.coalesce(F.sum(F.size("v")), F.lit(0)), F.coalesce(F.sum(F.octet_length("path")), F.lit(0))).first()
    if not count:
        return Found(spark.createDataFrame([], _NEAR + ", rank int"))
    if 8 * numbers + 2 * letters + 64 * count <= SENT:
        return _sent(have, chunks if asking is None else asking, k, block, count)
    sample = have.orderBy(F.xxhash64("path", "chunk")).limit(SAMPLE).select("v").toArrow()  # a bounded number
    units = _units(sample["v"].combine_chunks())
    pivots = _fitted_pivots(units, min(PIVOTS, len(units), max(1, count // (2 * block))))
    have = kept(_blocks(have, pivots, block, k), "blocks", **{"parquet.block.row.count.limit": STRIPE})
    files = sorted(have.inputFiles())
    asked = have if asking is None else kept(_blocks(asking, pivots, block, k), "asking")
    n = count if asking is None else asked.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = asked.repartitionByRange(max(1, min(-(-n // (GROUP * block)), 8 * parts)), "block")  # blocks of a task are neighbours

    def counted() -> tuple[int, int]:
        return dealt.mapInArrow(_searched(k, pivots, files, block, True), "pairs long").agg(F.sum("pairs")).first()[0] or 0, count * n

    return Found(dealt.mapInArrow(_searched(k, pivots, files, block, False), _NEAR + ", rank int"), counted)


def knn_chunks(chunks: DataFrame, k: int = 40, block: int = BLOCK, asking: DataFrame | None = None) -> DataFrame:
    """The rows of nearest_chunks."""
    return nearest_chunks(chunks, k, asking, block).rows


def renewed_neighbours(known: DataFrame, index: DataFrame, changed: DataFrame, k: int = 40, spare: int = 40, block: int = BLOCK) -> Found:
    """The neighbours of every chunk of index (path, chunk, v), from those known before some notes changed; k + spare of each, or as many as are sure.

    known: what this or nearest_chunks gave for the index as it was, ranked;
    changed: paths of notes that are new, changed or gone.  Each list holds the
    first of all chunks in order, so it stays right without the rows of notes
    that changed, and new chunks enter it where they come before its last row.
    Only chunks of changed notes, and those whose list has become shorter than
    k, ask all chunks again; the others meet the new chunks alone.
    """
    depth = k + spare
    known, paths = kept(known.select("note", "chunk", "path", "path_chunk", "score", "rank"), "known"), changed.select("path").distinct()
    whole = known.select("note", "chunk").distinct().count() <= depth  # then lists hold every chunk
    old = known.join(paths.withColumnRenamed("path", "note"), "note", "left_anti").join(paths, "path", "left_anti").select("note", "chunk", "path", "path_chunk", "score", "rank")
    last = old.groupBy("note", "chunk").agg(F.max_by(F.struct("score", "path", "path_chunk"), "rank").alias("last"))
    fresh, stay = index.join(paths, "path", "left_semi"), index.join(paths, "path", "left_anti")
    bound = F.lit(None).cast("double") if whole else F.col("last.score")
    asking = stay.join(last.withColumnRenamed("note", "path"), ["path", "chunk"]).select("path", "chunk", "v", bound.alias("floor"))
    met = nearest_chunks(fresh, depth, asking, block)
    before = F.lit(whole) | (F.col("score") > F.col("last.score")) | ((F.col("score") == F.col("last.score")) & (F.struct("path", "path_chunk") < F.struct("last.path", "last.path_chunk")))
    entering = met.rows.join(last, ["note", "chunk"]).where(before).select("note", "chunk", "path", "path_chunk", "score")
    order = F.row_number().over(Window.partitionBy("note", "chunk").orderBy(F.col("score").desc(), "path", "path_chunk"))
    lists = kept(old.drop("rank").unionByName(entering).withColumn("rank", order).where(F.col("rank") <= depth), "lists")
    enough = lists.where(F.col("rank") == min(k, index.where("v is not null").count())).select(F.col("note").alias("path"), "chunk")
    again = kept(index.join(enough, ["path", "chunk"], "left_anti"), "again")
    full = nearest_chunks(index, depth, again, block)
    out = lists.join(again.select(F.col("path").alias("note"), "chunk"), ["note", "chunk"], "left_anti").unionByName(full.rows)
    return Found(out, lambda: (met.compared + full.compared, index.where("v is not null").count() ** 2))


def _partial_sums(most: int):
    """Sums by path of what a task has read, sent on when they are many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, list] = {}

        def row() -> pa.RecordBatch:
            n, total = zip(*sums.values(), strict=True) if sums else ((), ())
            out = pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array(n, pa.int64()), pa.array([t.tolist() for t in total], pa.list_(pa.float64()))], names=["path", "n", "total"])
            sums.clear()
            return out

        for b in batches:
            values, ends = b["v"].flatten().to_numpy(zero_copy_only=False), b["v"].offsets.to_numpy()
            ends = ends - ends[0]
            for k, path in enumerate(b["path"].to_pylist()):
                v = values[ends[k] : ends[k + 1]]
                if path in sums:
                    sums[path][0] += 1
                    sums[path][1] = sums[path][1] + v
                else:
                    sums[path] = [1, v]
            if len(sums) >= most:
                yield row()
        yield row()

    return run


def _means(rows: pa.Table) -> pa.Table:
    total, n = np.sum(rows["total"].to_pylist(), axis=0), sum(rows["n"].to_pylist())
    return pa.table([rows["path"].slice(0, 1), pa.array([(total / n).tolist()], pa.list_(pa.float64()))], names=["path", "v"])


def mean_vectors(chunks: DataFrame) -> DataFrame:
    """path, v: the mean of each note's chunk vectors, not scaled again. Tasks add up what they read, so one shuffle moves a vector a note and task."""
    own = chunks.where("v is not null").select("path", F.col("v").cast("array<double>").alias("v"))
    return own.mapInArrow(_partial_sums(10_000), "path string, n long, total array<double>").groupBy("path").applyInArrow(_means, "path string, v array<double>")


def candidates(near: DataFrame, least: float) -> DataFrame:
    """note, path, score, rank: best score of each other note, ranked; a least score of 0 keeps all."""
    kept = near.where("note <> path")
    kept = kept.where(F.col("score") >= least) if least else kept
    best = kept.groupBy("note", "path").agg(F.max("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("note").orderBy(F.col("score").desc(), "path")))


def among(ranked: DataFrame, allowed: DataFrame) -> DataFrame:
    """Ranked candidates whose path is allowed (path), ranked anew."""
    own = ranked.join(allowed, "path", "left_semi")
    return own.withColumn("rank", F.row_number().over(Window.partitionBy("note").orderBy(F.col("score").desc(), "path")))


def select_links(ranked: DataFrame, limit: int = 8, overreach: int = 2, creative: int = 2, low: float = 0.45, high: float = 0.7) -> DataFrame:
    """note, path, kind, pos: core by rank, then other folders, then the middle band, then the rest.

    Greedy choice as running counts over one partitioning by note: see each
    step's condition. At least one core link is taken.
    """
    core_most = max(1, max(0, limit - overreach - creative))
    by_rank = Window.partitionBy("note").orderBy("rank")
    upto, whole = by_rank.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("note")
    count = lambda c, w: F.sum(F.when(c, 1).otherwise(0)).over(w)
    r = ranked.withColumn("core", F.col("rank") <= core_most).withColumn("n_core", count(F.col("core"), whole))
    other = ~F.col("core") & (top_folder(F.col("note")) != top_folder(F.col("path")))
    room = F.greatest(F.lit(1), F.lit(max(0, limit - overreach - creative) + overreach) - F.col("n_core"))
    r = r.withColumn("other", other & F.lit(overreach > 0)).withColumn("over", F.col("other") & (count(F.col("other"), upto) <= room)).withColumn("n_over", count(F.col("over"), whole))
    free, band = ~F.col("core") & ~F.col("over"), F.col("score").between(low, high)
    left = F.lit(max(0, limit - overreach - creative) + overreach + creative) - F.col("n_core") - F.col("n_over")
    fits = F.when(left > 0, count(free & band, upto) <= left).otherwise(count(free, upto) == 1)
    r = r.withColumn("made", free & band & fits & F.lit(creative > 0)).withColumn("n_made", count(F.col("made"), whole))
    rest = free & ~F.col("made")
    r = r.withColumn("fill", rest & (count(rest, upto) <= F.lit(limit) - F.col("n_core") - F.col("n_over") - F.col("n_made")))
    kind = F.when(F.col("core"), 0).when(F.col("over"), 1).when(F.col("made"), 2).when(F.col("fill"), 3)
    r = r.withColumn("kind", kind).where("kind is not null")
    r = r.withColumn("pos", F.row_number().over(Window.partitionBy("note").orderBy("kind", "rank"))).where(F.col("pos") <= limit)
    return r.select("note", "path", F.element_at(F.array(*map(F.lit, ("core", "overreach", "creative", "fill"))), F.col("kind") + 1).alias("kind"), "pos")
