"""Codes of vectors by parts: codebooks refined over metric trees, whose balls are given to an entry as a whole.

Tasks gather rows into blocks. For each part position of a block they build a metric tree by the anchors hierarchy: about
the square root of n anchors take turns in taking the points nearest to them (the triangle inequality spares most
comparisons), each anchor's points are divided in the same way, and the anchors are joined upwards, the pair with the
smallest common ball first. A ball keeps its centre, radius, count and the sums of its points. Blocks with their trees
are checkpointed and serve all rounds.

In a round every ball inherits from its parent the entries that may be nearest to some point of it, and drops those that
lose to its best one anywhere in the ball. When one is left the ball is that entry's, with its count and sums as they are;
leaves that stay open are settled by exact integer distances. Only sums and counts by part and entry leave the tasks.

Rows whose vector is null, empty, or holds null or non-finite components are dropped, as are those whose length isn't that
of the longest; the parts must divide that length. A null id comes after all others; of repeated ids every row has its
own result. Ties go to the entry of lower index. Components of more than 2**27 / 256 are an error, as distances would leave
64 bits. A table without rows gives none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.llm.hashing import tidy
from ledgerlens.llm.joins import narrow
from ledgerlens.session import checkpoint

#: Rows of a block, and points that a ball isn't divided for.
BLOCK_ROWS, LEAF = 8192, 40
#: Components of one vector, times 256, may be as large as this.
LARGEST = 2**27

Tree = tuple  # (points,) of a leaf or (tree, tree)


def _spread(points: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
    """The rows dealt to about the square root of their number of anchors, each to its nearest (or first met)."""
    own = points[rows]
    most = int(np.ceil(np.sqrt(len(rows))))
    anchors = [own[0]]
    owner = np.zeros(len(rows), dtype=np.int64)
    dist = np.sqrt(((own - own[0]) ** 2).sum(axis=1))
    while len(anchors) < most:
        far = int(dist.argmax())
        if dist[far] == 0:
            break
        new = own[far]
        half = np.sqrt(((np.array(anchors) - new) ** 2).sum(axis=1)) / 2
        near = np.flatnonzero(dist > half[owner] * (1 - 1e-12))  # no other point can be nearer to the new anchor
        to_new = np.sqrt(((own[near] - new) ** 2).sum(axis=1))
        takes = to_new < dist[near]
        taken = near[takes]
        owner[taken], dist[taken] = len(anchors), to_new[takes]
        anchors.append(new)
    by = np.argsort(owner, kind="stable")
    return [rows[g] for g in np.split(by, np.flatnonzero(np.diff(owner[by])) + 1)]


def _joined(points: np.ndarray, groups: list[np.ndarray], trees: list[Tree]) -> Tree:
    """One tree over the anchors' trees: the two with the smallest common ball become one, until one is left."""
    n = np.array([len(g) for g in groups], dtype=float)
    centre = np.array([points[g].mean(axis=0) for g in groups])
    radius = np.array([np.sqrt(((points[g] - c) ** 2).sum(axis=1).max()) for g, c in zip(groups, centre, strict=True)])

    def common(i: int, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        both = (centre[others] * n[others, None] + centre[i] * n[i]) / (n[others] + n[i])[:, None]
        return both, np.maximum(np.sqrt(((both - centre[others]) ** 2).sum(axis=1)) + radius[others], np.sqrt(((both - centre[i]) ** 2).sum(axis=1)) + radius[i])

    everything = np.arange(len(trees))
    cost = np.array([common(i, everything)[1] for i in everything])
    np.fill_diagonal(cost, np.inf)
    for _ in range(len(trees) - 1):
        i, j = divmod(int(cost.argmin()), len(trees))
        (middle,), (size,) = common(i, np.array([j]))
        trees[i], centre[i], radius[i] = (trees[i], trees[j]), middle, size
        n[i] += n[j]
        cost[j], cost[:, j] = np.inf, np.inf
        live = np.flatnonzero(np.isfinite(cost[i]))
        if len(live):
            cost[i, live] = cost[live, i] = common(i, live)[1]
    return trees[i] if len(trees) > 1 else trees[0]


def _tree(points: np.ndarray, rows: np.ndarray) -> Tree:
    if len(rows) <= LEAF or (points[rows] == points[rows[0]]).all():
        return (rows,)
    groups = _spread(points, rows)
    return _joined(points, groups, [_tree(points, g) for g in groups])


class Balls:
    """A tree over the points of one part in a block: balls, parents before children, each over a run of ``order``."""

    def __init__(self, order: np.ndarray, spans: np.ndarray, centres: np.ndarray, radii: np.ndarray, sums: np.ndarray):
        self.order, self.spans, self.centres, self.radii, self.sums = order, spans, centres, radii, sums

    @classmethod
    def of(cls, points: np.ndarray) -> Balls:
        order, spans, at = [], [], 0
        todo = [(_tree(points.astype(float), np.arange(len(points))), -1, 0)]
        while todo:
            tree, parent, side = todo.pop()
            if parent >= 0:
                spans[parent][2 + side] = len(spans)
            spans.append([at, at, -1, -1])
            if len(tree) == 1:
                order.append(tree[0])
                at += len(tree[0])
                spans[-1][1] = at
            else:
                todo += [(tree[1], len(spans) - 1, 1), (tree[0], len(spans) - 1, 0)]
        for span in reversed(spans):  # a ball ends where its right part does
            if span[2] >= 0:
                span[1] = spans[span[3]][1]
        order, spans = np.concatenate(order).astype(np.int32), np.array(spans, dtype=np.int32)
        placed = points[order].astype(np.int64)
        upto = np.concatenate((np.zeros((1, points.shape[1]), dtype=np.int64), np.cumsum(placed, axis=0)))
        sums = upto[spans[:, 1]] - upto[spans[:, 0]]
        centres = sums / (spans[:, 1] - spans[:, 0])[:, None]
        radii = np.array([np.sqrt(((placed[a:b] - c) ** 2).sum(axis=1).max()) for (a, b), c in zip(spans[:, :2].tolist(), centres, strict=True)])
        return cls(order, spans, centres, radii, sums)

    def owned(self, points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(entry of each point, sums by entry, counts by entry)``."""
        out = np.empty(len(points), dtype=np.int64)
        sums, counts = np.zeros(entries.shape, dtype=np.int64), np.zeros(len(entries), dtype=np.int64)
        _, first = np.unique(entries, axis=0, return_index=True)  # an entry that repeats an earlier one never wins
        real = entries.astype(float)
        todo = [(0, np.sort(first))]
        while todo:
            ball, names = todo.pop()
            a, b, left, right = self.spans[ball].tolist()
            if len(names) > 1:
                away = ((real[names] - self.centres[ball]) ** 2).sum(axis=1)
                best = int(away.argmin())
                apart = np.sqrt(((real[names] - real[names[best]]) ** 2).sum(axis=1))
                # how far the ball's centre is from where the entry would be as near as the best one
                names = names[away - away[best] <= 2 * apart * (self.radii[ball] * (1 + 1e-9) + 1e-6) + 1e-9 * away]
            if len(names) == 1:
                out[self.order[a:b]] = names[0]
                sums[names[0]] += self.sums[ball]
                counts[names[0]] += b - a
            elif left >= 0:
                todo += [(left, names), (right, names)]
            else:
                rows = self.order[a:b]
                own = points[rows].astype(np.int64)
                near = names[((own[:, None, :] - entries[names][None]) ** 2).sum(axis=2).argmin(axis=1)]
                out[rows] = near
                np.add.at(sums, near, own)
                np.add.at(counts, near, 1)
        return out, sums, counts


BLOCK = "points binary, nodes array<int>, orders binary, spans binary, centres binary, radii binary, sums binary"


def _blocks(df: DataFrame, vector: str, parts: int, width: int, carried: Sequence[str]) -> DataFrame:
    """Rows of ``carried`` as arrays, with the block's points and the balls of each part."""
    schema = T.StructType([*(T.StructField(f"c{i}", T.ArrayType(df.schema[c].dataType)) for i, c in enumerate(carried)), *T._parse_datatype_string(BLOCK).fields])

    def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        lists = rows.column(len(carried)).combine_chunks()
        whole = np.floor(256 * lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)).reshape(len(rows), parts * width)
        if np.abs(whole).max() > LARGEST:
            raise ValueError(f"a component is beyond {LARGEST / 256}: distances would leave 64 bits")
        points = whole.astype(np.int32)
        balls = [Balls.of(points[:, p * width : (p + 1) * width]) for p in range(parts)]
        own = [pa.array([rows.column(i).to_pylist()], pa.list_(rows.schema.field(i).type)) for i in range(len(carried))]
        blobs = [[points.tobytes()], None, *([np.concatenate([getattr(b, f) for b in balls]).tobytes()] for f in ("order", "spans", "centres", "radii", "sums"))]
        return pa.RecordBatch.from_arrays([*own, *(pa.array([[len(b.spans) for b in balls]], pa.list_(pa.int32())) if x is None else pa.array(x, pa.binary()) for x in blobs)], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                take = min(BLOCK_ROWS - n, batch.num_rows - at)
                held.append(batch.slice(at, take))
                n, at = n + take, at + take
                if n == BLOCK_ROWS:
                    yield block(held)
                    held, n = [], 0
        if n:
            yield block(held)

    return df.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(carried)], F.col(vector)).mapInArrow(tidy(run), schema)


def _read(row: dict, parts: int, width: int) -> tuple[np.ndarray, list[Balls]]:
    points = np.frombuffer(row["points"], dtype=np.int32).reshape(-1, parts * width)
    ends = np.cumsum(row["nodes"])[:-1]
    cut = lambda name, kind, shape: np.split(np.frombuffer(row[name], dtype=kind).reshape(shape), ends)
    orders = np.frombuffer(row["orders"], dtype=np.int32).reshape(parts, -1)
    columns = [cut("spans", np.int32, (-1, 4)), cut("centres", np.float64, (-1, width)), cut("radii", np.float64, (-1,)), cut("sums", np.int64, (-1, width))]
    return points, [Balls(o, *c) for o, *c in zip(orders, *columns, strict=True)]


def _refined(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks (part, entry, position) after one round."""
    parts, size, width = books.shape
    shared = blocks.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                points, balls = _read(row, parts, width)
                found = [b.owned(points[:, p * width : (p + 1) * width], shared.value[p])[1:] for p, b in enumerate(balls)]
                sums, counts = np.array([f[0] for f in found]), np.array([f[1] for f in found])
                p, e = np.nonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(counts[p, e]), pa.array(list(sums[p, e]), pa.list_(pa.int64()))], names=["part", "entry", "n", "sums"])

    sums = blocks.select(*[f.name for f in T._parse_datatype_string(BLOCK)]).mapInArrow(tidy(run), "part int, entry int, n bigint, sums array<bigint>")
    total = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(width)]
    out = books.copy()
    for r in sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *total).collect():  # a row for each entry at most
        out[r["part"], r["entry"]] = [int(r[f"s{i}"]) // r["n"] for i in range(width)]
    shared.destroy()
    return out


def _coded(blocks: DataFrame, books: np.ndarray, fields: list[T.StructField]) -> DataFrame:
    """The carried columns, each row's code and its error."""
    parts, _, width = books.shape
    shared = blocks.sparkSession.sparkContext.broadcast(books)
    schema = T.StructType([*fields, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                points, balls = _read(row.select(names).to_pylist()[0], parts, width)
                entries = [b.owned(points[:, p * width : (p + 1) * width], shared.value[p])[0] for p, b in enumerate(balls)]
                error = sum(((points[:, p * width : (p + 1) * width].astype(np.int64) - shared.value[p][e]) ** 2).sum(axis=1) for p, e in enumerate(entries))
                codes = [c.tobytes().hex() for c in np.stack(entries, axis=1).astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([*(row.column(j).flatten() for j in range(len(fields))), pa.array(codes), pa.array(error)], names=schema.names)

    names = [f.name for f in T._parse_datatype_string(BLOCK)]
    return blocks.mapInArrow(tidy(run), schema)


def compress(df: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, vector: str = "embedding", key: str = "vec_id", label: str = "label") -> tuple[DataFrame, np.ndarray | None]:
    """``key, label, code, error`` of every kept row, and the codebooks (part, entry, position).

    Codebooks start as the parts of the ``entries`` kept rows of smallest ``key``. ``code`` has two hex digits a part.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits for an entry")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    rows = df.select(key, label, vector).where(F.col(vector).isNotNull() & (F.size(vector) > 0) & finite)
    fields = [T.StructField(key, df.schema[key].dataType), T.StructField(label, df.schema[label].dataType)]
    length = rows.agg(F.max(F.size(vector)).alias("n")).first()["n"]
    if length is None:
        return rows.select(key, label, F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error")), None
    if length % parts:
        raise ValueError(f"{parts} parts don't divide a length of {length}")
    width = length // parts
    rows = rows.where(F.size(vector) == length)
    first = rows.orderBy(F.asc_nulls_last(key), vector).limit(entries).collect()
    books = np.floor(256 * np.array([r[vector] for r in first], dtype=np.float64)).astype(np.int64).reshape(-1, parts, width).transpose(1, 0, 2).copy()
    blocks = checkpoint(_blocks(rows, vector, parts, width, [key, label]))
    for _ in range(rounds):
        books = _refined(blocks, books)
    return _coded(blocks, books, fields), books


def digest(books: np.ndarray | None) -> str:
    """SHA-256 of all components by part, entry and position."""
    return hashlib.sha256(",".join(map(str, [] if books is None else books.ravel().tolist())).encode()).hexdigest()


def codes(df: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, vector: str = "embedding", key: str = "vec_id", label: str = "label") -> DataFrame:
    """``key, code, error, label_error, codebooks_sha256`` of every kept row; ``label_error`` sums over equal labels, nulls together."""
    coded, books = compress(df, parts, entries, rounds, vector, key, label)
    coded = checkpoint(coded.select(F.col(key), F.col(label).alias("_label"), "code", "error"))
    sums = coded.groupBy(F.col("_label").alias("_of")).agg(F.sum("error").alias("label_error"))
    return coded.join(narrow(checkpoint(sums)), F.col("_label").eqNullSafe(F.col("_of")), "left").select(key, "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


SQL = """
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)))),
parts AS (SELECT vec_id, label, p, v[p * (len(v) // 16) + 1 : (p + 1) * (len(v) // 16)] AS x FROM kept CROSS JOIN (SELECT unnest(range(16)) AS p)),
first_ids AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept QUALIFY e < 64),
book0 AS (SELECT p, e, x AS c FROM parts JOIN first_ids USING (vec_id)),
near0 AS (SELECT vec_id, p, arg_min(e, (d, e)) AS e FROM (SELECT a.vec_id, a.p, b.e, list_sum(list_transform(list_zip(a.x, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM parts a JOIN book0 b ON a.p = b.p) GROUP BY ALL),
cells1 AS (SELECT a.p, n.e, i, ((sum(a.x[i]) - (sum(a.x[i]) % count(*) + count(*)) % count(*)) // count(*))::BIGINT AS c FROM parts a JOIN near0 n ON a.vec_id = n.vec_id AND a.p = n.p CROSS JOIN (SELECT unnest(range(1, 5)) AS i) GROUP BY ALL),
means1 AS (SELECT p, e, list(c ORDER BY i) AS c FROM cells1 GROUP BY ALL),
book1 AS (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM book0 b LEFT JOIN means1 m ON b.p = m.p AND b.e = m.e),
near1 AS (SELECT vec_id, p, arg_min(e, (d, e)) AS e FROM (SELECT a.vec_id, a.p, b.e, list_sum(list_transform(list_zip(a.x, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM parts a JOIN book1 b ON a.p = b.p) GROUP BY ALL),
cells2 AS (SELECT a.p, n.e, i, ((sum(a.x[i]) - (sum(a.x[i]) % count(*) + count(*)) % count(*)) // count(*))::BIGINT AS c FROM parts a JOIN near1 n ON a.vec_id = n.vec_id AND a.p = n.p CROSS JOIN (SELECT unnest(range(1, 5)) AS i) GROUP BY ALL),
means2 AS (SELECT p, e, list(c ORDER BY i) AS c FROM cells2 GROUP BY ALL),
book2 AS (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM book1 b LEFT JOIN means2 m ON b.p = m.p AND b.e = m.e),
last AS (SELECT vec_id, label, p, arg_min(e, (d, e)) AS e, min(d) AS d FROM (SELECT a.vec_id, a.label, a.p, b.e, list_sum(list_transform(list_zip(a.x, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM parts a JOIN book2 b ON a.p = b.p) GROUP BY ALL),
coded AS (SELECT vec_id, label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM last GROUP BY ALL),
books AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS h FROM book2)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM coded CROSS JOIN books
"""
