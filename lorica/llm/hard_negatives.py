"""Hard negatives by integer inner products, as a block matrix multiply over rows and dimensions.

Rows are dealt to panels, those of one panel into blocks of about ROWS by ascending id, and vectors are cut into chunks of
DIMS components; anchors likewise into panels and blocks of about ANCHORS. What is shuffled are the chunks of blocks: each
pair of a panel of anchors and a panel of rows is one task, which holds the anchors and lets the rows pass, adds up the
products of two blocks chunk by chunk, and keeps of every sum only the best rows. Sums of scores never leave their task.
Panels grow with the table, so that their number stays about the same and what is shuffled grows with the input, although
all anchors are multiplied with all rows.

Two rounds: the best rows of the same label (positives), then the best rows of other labels within each positive's window.
Panels of rows hold the rows of one group of labels, so the first round multiplies panels of one group only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import BATCH_BYTES, keep

ROWS, ANCHORS, DIMS, GROUPS = 2048, 256, 32, 64
#: Rows and anchors of a panel: at least and at most. A panel of anchors is held in memory, and takes so many bytes at most.
PANEL_ROWS, PANEL_ANCHORS, PANEL_BYTES = (1 << 15, 1 << 19), (1 << 12, 1 << 15), 32 << 20
#: Panels of a large table, of rows and of anchors.
PANELS = 16, 4
#: Bytes of a block, for vectors so long that ROWS or ANCHORS of them take more.
BLOCK_BYTES = 8 << 20
#: Scores and hundredfold scores must fit 64 bits. NONE: no score.
MOST, NONE = (1 << 63) // 100, -(1 << 62)
_PIECE = "panel int, block int, chunk int, g int, m binary, rows binary, ids binary, labels binary, windows binary"
_FOUND = "i int, block int, j int, rows binary, ids binary, windows binary, found binary"


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """row (a number of its own), vec_id, label, q, size, largest: the rows that take part, with their components as
    64-bit whole numbers, how many these are and the largest amount among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            part = b.column(2)
            offs, x = np.asarray(part.offsets), part.values.to_numpy(zero_copy_only=False)  # a null component is NaN here
            x = x[offs[0] : offs[-1]]
            size = np.diff(offs)
            odd = np.zeros(b.num_rows, bool)
            odd[np.repeat(np.arange(b.num_rows), size)[~np.isfinite(x)]] = True
            with np.errstate(invalid="ignore", over="ignore"):
                q = np.clip(np.floor(x * scale), -(2.0**62), 2.0**62)
            q = np.where(np.isnan(q), 0, q).astype(np.int64)
            largest = np.zeros(b.num_rows, np.int64)
            some = np.flatnonzero(size)
            if len(some):
                largest[some] = np.maximum.reduceat(np.abs(q), (offs[:-1] - offs[0])[some])
            whole = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(((offs - offs[0]) * 8).astype(np.int32)), pa.py_buffer(q)])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), whole, pa.array(size.astype(np.int32)), pa.array(largest)], ["vec_id", "label", "q", "size", "largest"]).filter(pa.array(~odd))

    given = vectors.where(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
    given = given.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("q"))
    return given.mapInArrow(run, "vec_id long, label long, q binary, size int, largest long").withColumn("row", F.monotonically_increasing_id())


def _by_group(values: list[int]) -> Column:
    """values[g] as a column of g."""
    return F.element_at(F.array(*map(F.lit, values)), F.col("g") + 1)


def _pieces(rows: DataFrame, panel: Column, most: int, chunks: int, dims: int, kind: type) -> DataFrame:
    """The rows of each panel in blocks of ``most`` by ascending id, one row for each block and chunk: the matrix, and with
    chunk 0 the numbers, ids, labels and windows of its rows."""
    schema = pa.schema([(c, pa.int32()) for c in ("panel", "block", "chunk", "g")] + [(c, pa.binary()) for c in ("m", "rows", "ids", "labels", "windows")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, block, held = None, 0, []

        def out() -> Iterator[pa.RecordBatch]:
            qs = [q for h in held for q in h[0]]
            size = np.array([len(q) // 8 for q in qs])
            m = np.zeros((len(qs), chunks * dims), kind)
            m[np.repeat(np.arange(len(qs)), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = np.frombuffer(b"".join(qs), np.int64)
            meta = [np.concatenate([h[c] for h in held]).tobytes() for c in (1, 2, 3)] + [b"".join(w or b"" for h in held for w in h[4])]
            for c in range(chunks):
                piece = (key[0], block, c, key[1], m[:, c * dims : (c + 1) * dims].tobytes(), *(meta if c == 0 else [None] * 4))
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, piece, strict=True))], schema=schema)

        for b in batches:
            panels, g, row, ids, labels = (b.column(i).to_numpy() for i in range(5))
            qs, windows = b.column(5).to_pylist(), b.column(6).to_pylist()
            a = 0
            while a < b.num_rows:
                if key is None or key[0] != panels[a]:
                    if held:
                        yield from out()
                    key, block, held = (int(panels[a]), int(g[a])), 0, []
                z = min(a + most - sum(len(h[0]) for h in held), a + int(np.searchsorted(panels[a:], panels[a], "right")))
                held.append((qs[a:z], row[a:z], ids[a:z], labels[a:z], windows[a:z]))
                if sum(len(h[0]) for h in held) == most:
                    yield from out()
                    block, held = block + 1, []
                a = z
        if held:
            yield from out()

    dealt = rows.select(panel.cast("int").alias("panel"), "g", "row", "vec_id", "label", "q", "windows")
    return dealt.repartition("panel").sortWithinPartitions("panel", "vec_id", "row").mapInArrow(run, _PIECE)


class Block:
    """A block of anchors, chunk by chunk, and the best rows found for each of their windows.

    above, upto: of each anchor and window, the scores that still count: higher than above, upto at most. found: scores, ids
    and numbers of the rows found, (anchor, window, place), best first. same: whether rows of the anchor's label are looked
    for, or else all others. most: rows kept of a window."""

    def __init__(self, chunks: list[np.ndarray], rows: np.ndarray, ids: np.ndarray, labels: np.ndarray, windows: np.ndarray | None, above: np.ndarray, upto: np.ndarray, same: bool, most: int):
        self.chunks, self.rows, self.ids, self.labels, self.windows, self.above, self.upto, self.same, self.most = chunks, rows, ids, labels, windows, above, upto, same, most
        self.found = np.full((3, *above.shape, most), NONE)
        self.least, self.hits, self.n_hits = above.min(axis=1), [], 0

    def meet(self, chunks: list[np.ndarray], rows: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        """Looks at rows, which follow all rows met before by their ids."""
        tile = self.chunks[0] @ chunks[0].T
        for x, y in zip(self.chunks[1:], chunks[1:], strict=True):
            tile += x @ y.T
        w = self.above.shape[1]
        likely = tile > self.least.astype(tile.dtype)[:, None]
        if np.count_nonzero(likely) * 8 <= tile.size:
            a, b = np.divmod(np.flatnonzero(likely), tile.shape[1])
            fit = (self.labels[a] == labels[b]) & (self.rows[a] != rows[b]) if self.same else self.labels[a] != labels[b]
            a, b = a[fit], b[fit]
            s = tile[a, b].astype(np.int64)
            for k in range(w):
                t = (s > self.above[a, k]) & (s <= self.upto[a, k])
                self._hit(a[t] * w + k, s[t], ids[b[t]], rows[b[t]])
        else:
            fit = self.labels[:, None] == labels
            fit = fit & (self.rows[:, None] != rows) if self.same else ~fit
            for k in range(w):
                t = fit & (tile > self.above[:, k, None].astype(tile.dtype)) & (tile <= self.upto[:, k, None].astype(tile.dtype))
                if tile.shape[1] > self.most:  # the best rows alone, of equal ones the first
                    held = np.where(t, tile, tile.dtype.type(NONE))
                    last = np.partition(held, -self.most, axis=1)[:, -self.most, None]
                    equal = t & (held == last)
                    t &= (held > last) | (equal & (np.cumsum(equal, axis=1) <= self.most))
                a, b = np.divmod(np.flatnonzero(t), tile.shape[1])
                self._hit(a * w + k, tile[a, b].astype(np.int64), ids[b], rows[b])
        if 4 * self.n_hits > self.found[0].size:
            self.take()

    def _hit(self, *hits: np.ndarray) -> None:
        """Anchor and window, score, id and number of rows that may be among the best; of one window by ascending id."""
        self.hits.append(hits)
        self.n_hits += len(hits[0])

    def take(self) -> None:
        """Keeps the best of what was found and hit. A stable sort leaves ties in the order of their ids."""
        if not self.n_hits:
            return
        g, s, ids, rows = (np.concatenate(x) for x in zip(*self.hits, strict=True))
        found, above = self.found.reshape(3, -1, self.most), self.above.reshape(-1)
        touched, at = np.unique(g, return_inverse=True)
        new = np.concatenate([found[:, touched].reshape(3, -1), np.stack([s, ids, rows])], axis=1)
        at = np.concatenate([np.repeat(np.arange(len(touched)), self.most), at])
        order = np.lexsort((-new[0], at))
        best = order[np.searchsorted(at[order], np.arange(len(touched)))[:, None] + np.arange(self.most)]
        found[:, touched] = new[:, best]
        above[touched] = np.maximum(above[touched], new[0, best[:, -1]])
        self.least, self.hits, self.n_hits = self.above.min(axis=1), [], 0


def _paired(left: DataFrame, right: DataFrame, pair: Column, n: int, chunks: int, dims: int, kind: type, same: bool, most: int, low: int, high: int) -> DataFrame:
    """left: pieces of anchors, right: pieces of rows, for each pair of panels i and j. The best rows that each block of anchors
    has in the panel j. pair: the number of a pair, below n; each is a task of its own."""
    names = [x.split()[0] for x in _FOUND.split(", ")]

    def block_of(pieces: list[np.ndarray], meta: list[bytes]) -> Block:
        rows, ids, labels = (np.frombuffer(x, np.int64) for x in meta[:3])
        if same:
            windows, above, upto = None, np.full((len(rows), 1), NONE), np.full((len(rows), 1), MOST)
        else:
            windows = np.frombuffer(meta[3], np.int64).reshape(len(rows), -1, 3)
            s = windows[:, :, 2]  # below 0 no score lies in the window
            above, upto = np.where(s < 0, MOST, -(-low * s // 100) - 1), np.where(s < 0, -MOST, high * s // 100)
        return Block(pieces, rows, ids, labels, windows, above, upto, same, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, anchors, pieces, meta, span = None, {}, [], [], 0

        def out() -> Iterator[pa.RecordBatch]:
            for block, x in anchors.items():
                x.take()
                values = (key[0], block, key[1], x.rows.tobytes(), x.ids.tobytes(), None if x.windows is None else x.windows.tobytes(), x.found.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.int32() if c < 3 else pa.binary()) for c, v in enumerate(values)], names)

        for b in batches:
            for k in range(b.num_rows):
                i, j, side, block, chunk = (b.column(c)[k].as_py() for c in range(5))
                if key != (i, j):
                    yield from out()
                    key, anchors, pieces, span = (i, j), {}, [], 32
                if chunk == 0:
                    meta = [b.column(c)[k].as_py() for c in range(6, 10)]
                pieces.append(np.frombuffer(b.column(5)[k].as_py(), kind).reshape(-1, dims))
                if len(pieces) < chunks:
                    continue
                if side == 0:
                    anchors[block] = block_of(pieces, meta)
                else:
                    rows, ids, labels = (np.frombuffer(x, np.int64) for x in meta[:3])
                    a = 0
                    while a < len(rows):  # few rows at first, as until the windows are full many rows are better than those found
                        z = min(a + span, len(rows))
                        for x in anchors.values():
                            x.meet([p[a:z] for p in pieces], rows[a:z], ids[a:z], labels[a:z])
                        a, span = z, min(2 * span, 1 << 20)
                pieces = []
        yield from out()

    columns = ["i", "j", "g", "side", "block", "chunk", "m", "rows", "ids", "labels", "windows"]
    both = left.withColumn("side", F.lit(0)).select(columns).unionByName(right.withColumn("side", F.lit(1)).select(columns))
    return both.repartitionById(n, pair).drop("g").sortWithinPartitions("i", "j", "side", "block", "chunk").mapInArrow(run, _FOUND)


def _merged(found: DataFrame, windows: int, most: int, schema: str, rows_of: Callable[..., pa.RecordBatch]) -> DataFrame:
    """What rows_of(rows, ids, windows, found) makes of each block of anchors once the best rows of all panels are merged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total, meta = None, None, []
        for b in batches:
            for k in range(b.num_rows):
                i, block, *now = (b.column(c)[k].as_py() for c in (0, 1, 3, 4, 5, 6))
                part = np.frombuffer(now[3], np.int64).reshape(3, -1, windows, most)
                if key == (i, block):
                    both = np.concatenate([total, part], axis=-1)
                    order = np.lexsort((both[2], both[1], -both[0]), axis=-1)[..., :most]
                    total = np.take_along_axis(both, order[None], axis=-1)
                    continue
                if key is not None:
                    yield rows_of(*meta, total)
                key, total, meta = (i, block), part, [None if x is None else np.frombuffer(x, np.int64) for x in now[:3]]
        if key is not None:
            yield rows_of(*meta, total)

    return found.repartition("i", "block").sortWithinPartitions("i", "block", "j").mapInArrow(run, schema)


def _positives_of(rows: np.ndarray, ids: np.ndarray, windows: None, found: np.ndarray) -> pa.RecordBatch:
    """number, id and score of each positive, as the windows of their anchor."""
    some = np.flatnonzero(found[0, :, 0, 0] > NONE)
    of = np.ascontiguousarray(np.stack([found[2, some, 0], found[1, some, 0], found[0, some, 0]], axis=-1))
    return pa.RecordBatch.from_arrays([pa.array(rows[some]), pa.array([x.tobytes() for x in of], pa.binary())], ["row", "windows"])


def _negatives_of(rows: np.ndarray, ids: np.ndarray, windows: np.ndarray, found: np.ndarray) -> pa.RecordBatch:
    a, k, nth = np.nonzero(found[0] > NONE)
    own = windows.reshape(len(rows), -1, 3)
    columns = [ids[a], own[a, k, 1], (nth + 1).astype(np.int32), found[1, a, k, nth], own[a, k, 2], found[0, a, k, nth]]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], [x.split()[0] for x in _RESULT.split(", ")])


_RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def hard_negatives(vectors: DataFrame, anchor: Callable[[Column], Column], relabel: Callable[[Column, Column], Column] = lambda i, label: label, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256, n_rows: int = ROWS, n_anchors: int = ANCHORS, n_dims: int = DIMS, panel_rows: tuple[int, int] = PANEL_ROWS, panel_anchors: tuple[int, int] = PANEL_ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor and each of its first
    positives the first rows of another label with low * positive_score <= 100 * score <= high * positive_score.

    vectors: vec_id, embedding, label. anchor: of vec_id, whether a row is an anchor. Scores are inner products of
    components floor(scale * x); higher ones come first, ties by smaller vec_id. Rows without vec_id, label or vector, or
    with a null or non-finite component, take no part. Of vectors of different length the shorter one counts as 0 beyond
    its end. Rows that repeat a vec_id are rows of their own: other than the anchor is every row but itself. An anchor
    without positives, or without rows in a window, gives no rows, nor does an empty table; other columns are not looked
    at. Components so large that a score could leave 64 bits are an error.
    """
    spark = vectors.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    given = quantised(vectors, scale).withColumn("label", relabel(F.col("vec_id"), F.col("label")).cast("long"))
    rows = keep(given.withColumn("g", F.pmod(F.xxhash64("label"), F.lit(GROUPS)).cast("int")))
    groups = rows.groupBy("g").agg(F.count("*").alias("n"), F.count_if(anchor(F.col("vec_id"))).alias("anchors"), (F.min("label") == F.max("label")).alias("pure"), F.max("size").alias("size"), F.max("largest").alias("largest")).collect()
    of = {r["g"]: r for r in groups}
    total, total_a = sum(r["n"] for r in groups), sum(r["anchors"] for r in groups)
    size = max((r["size"] for r in groups), default=0)
    bound = max((r["largest"] for r in groups), default=0) ** 2 * max(size, 1)
    if bound >= MOST:
        raise ValueError("components are too large for scores of 64 bits")
    if not total_a or (len(groups) == 1 and groups[0]["pure"]):  # no anchor, or no row of another label
        return spark.createDataFrame([], _RESULT)
    # whole numbers that stay below 2**24 and 2**53 are exact as such floats, whose products are much faster
    kind = np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64
    chunks = max(1, -(-size // n_dims))
    row_bytes = 8 * chunks * n_dims
    n_rows, n_anchors = (max(1, min(n, BLOCK_BYTES // row_bytes)) for n in (n_rows, n_anchors))
    within = lambda n, bounds: min(max(n, bounds[0]), bounds[1])
    of_rows = within(-(-total // PANELS[0]), panel_rows)
    of_anchors = max(1, min(within(-(-total_a // PANELS[1]), panel_anchors), PANEL_BYTES // row_bytes))
    counts = lambda c, size: [-(-of[g][c] // size) if g in of else 0 for g in range(GROUPS)]
    before = lambda x: [sum(x[:g]) for g in range(GROUPS)]
    a_count, b_count = counts("anchors", of_anchors), counts("n", of_rows)
    a_first, b_first, a_panels, b_panels = before(a_count), before(b_count), -(-total_a // of_anchors), sum(b_count)
    dealt = lambda first, count: _by_group(first) + F.pmod(F.xxhash64("row"), _by_group(count))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    of_group = lambda first, count: F.explode(F.when(_by_group(count) > 0, F.sequence(_by_group(first), _by_group(first) + F.greatest(_by_group(count), F.lit(1)) - 1)))
    plain = rows.withColumn("windows", F.lit(None).cast("binary"))
    anchors = plain.where(anchor(F.col("vec_id")))
    right = keep(_pieces(plain, dealt(b_first, b_count), n_rows, chunks, n_dims, kind).withColumnRenamed("panel", "j"), 4)

    left = _pieces(anchors, dealt(a_first, a_count), n_anchors, chunks, n_dims, kind).withColumnRenamed("panel", "i")
    pairs = [a * b for a, b in zip(a_count, b_count, strict=True)]
    pair = _by_group(before(pairs)) + (F.col("i") - _by_group(a_first)) * _by_group(b_count) + F.col("j") - _by_group(b_first)
    met = _paired(left.withColumn("j", of_group(b_first, b_count)), right.withColumn("i", of_group(a_first, a_count)), pair, sum(pairs), chunks, n_dims, kind, True, positives, low, high)
    first = keep(_merged(met, 1, positives, "row long, windows binary", _positives_of))

    left = _pieces(anchors.drop("windows").join(first, "row"), F.pmod(F.xxhash64("row"), F.lit(a_panels)), n_anchors, chunks, n_dims, kind).withColumnRenamed("panel", "i")
    met = _paired(left.withColumn("j", numbers(b_panels)), right.withColumn("i", numbers(a_panels)), F.col("i") * b_panels + F.col("j"), a_panels * b_panels, chunks, n_dims, kind, False, negatives, low, high)
    return _merged(met, positives, negatives, _RESULT, _negatives_of)
