"""Product codes of vectors: a codebook for each of PARTS equal parts, fitted by Lloyd rounds with Yinyang bounds.

A component x becomes the integer floor(256 x). The codebook of a part starts as that part of the ENTRIES rows with the smallest
ids. Each round assigns every part to the nearest entry (squared distance, ties to the lower index) and replaces each entry by
the componentwise floor of its parts' mean; a last assignment gives the codes.

Yinyang: the entries of a part are clustered into groups. A part keeps an upper bound of its distance to its entry
and, for each group, a lower bound of the distance to the group's other entries. After a round both move by how far
entries have drifted, and only groups whose lower bound is not above the upper one are scanned. Bounds are doubles
widened by SLACK; every scan and every tie is settled by integers, so bounds only save work and never decide.

Codebooks are PARTS * ENTRIES entries whatever the input: they go to the tasks with the code, and only sums and
counts by entry, added up by Spark, come back. Bounds are columns of a table in the shared folder, so a lost task is read again."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, map_arrow

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Entries of a Yinyang group, about.
GROUP_ENTRIES = 10
#: Bounds are widened by this share and this distance: far more than doubles round by.
SLACK, LEAST_SLACK = 1e-9, 1e-6
#: Rows of a batch.
ROWS = 4096
#: Labels whose sums are broadcast; more meet the rows by an exchange.
BROADCAST_LABELS = 100_000
#: Largest integer component: squared distances and their sums over a vector of up to 1,024 parts fit a long.
MAX_COMPONENT = 1 << 25


def _squares(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of points (n, d) and entries (k, d), as longs."""
    far = max(int(np.abs(points).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if far * far * 4 * points.shape[1] < 1 << 53:
        x, c = points.astype(np.float64), entries.astype(np.float64)
        return ((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None, :]).astype(np.int64)
    out = np.zeros((len(points), len(entries)), np.int64)
    for j in range(points.shape[1]):
        out += (points[:, j, None] - entries[None, :, j]) ** 2
    return out


def entry_groups(entries: np.ndarray) -> np.ndarray:
    """The group of each entry (k, d): a few Lloyd rounds over the entries themselves, from evenly spaced ones."""
    n = max(1, math.ceil(len(entries) / GROUP_ENTRIES))
    centres = entries[np.linspace(0, len(entries) - 1, n).astype(int)].astype(np.float64)
    found = np.zeros(len(entries), np.int64)
    for _ in range(5):
        found = ((entries[:, None, :].astype(np.float64) - centres[None]) ** 2).sum(2).argmin(1)
        for g in range(n):
            if (own := found == g).any():
                centres[g] = entries[own].mean(0)
    return found


def _up(x: np.ndarray) -> np.ndarray:
    return x * (1 + SLACK) + LEAST_SLACK


def _down(x: np.ndarray) -> np.ndarray:
    return x * (1 - SLACK) - LEAST_SLACK


def first_assignment(points: np.ndarray, entries: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """at (n), upper (n) and lower (n, groups) from all distances."""
    d = _squares(points, entries)
    at = d.argmin(1)  # the first of equal ones
    rows = np.arange(len(points))
    upper, others = _up(np.sqrt(d[rows, at].astype(np.float64))), np.sqrt(d.astype(np.float64))
    others[rows, at] = np.inf
    lower = np.stack([others[:, groups == g].min(1, initial=np.inf) for g in range(groups.max(initial=0) + 1)], 1)
    return at, upper, _down(lower)


def next_assignment(points: np.ndarray, at: np.ndarray, upper: np.ndarray, lower: np.ndarray, before: np.ndarray, now: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """at, upper and lower after entries have moved from before to now, and how many groups of a point were scanned.

    lower holds, for a group, no more than the distance to any of its entries but the assigned one."""
    drift = _up(np.sqrt(((before - now).astype(np.float64) ** 2).sum(1)))
    n_groups = lower.shape[1]
    at, upper, lower = at.copy(), upper + drift[at], lower.copy()
    for g in range(n_groups):
        lower[:, g] -= drift[groups == g].max(initial=0.0)
    rows = np.flatnonzero(upper >= lower.min(1))
    if not len(rows):
        return at, upper, lower, 0
    # a tighter upper bound first: the distance to the entry itself
    own = ((points[rows] - now[at[rows]]) ** 2).sum(1)
    upper[rows] = _up(np.sqrt(own.astype(np.float64)))
    best, owned = own.copy(), at[rows].copy()
    need = upper[rows][:, None] >= lower[rows]
    seen: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
    for g in range(n_groups):
        members, asked = np.flatnonzero(groups == g), np.flatnonzero(need[:, g])
        if not len(asked) or not len(members):
            continue
        d = _squares(points[rows[asked]], now[members])
        seen.append((g, asked, members, d))
        least = d.min(1)
        first = members[d.argmin(1)]
        better = (least < best[asked]) | ((least == best[asked]) & (first < owned[asked]))
        best[asked[better]], owned[asked[better]] = least[better], first[better]
    # the entry that a point leaves bounds its old group from now on, unless that group is scanned below
    left = owned != at[rows]
    old_group = groups[at[rows]]
    away = _down(np.sqrt(own.astype(np.float64)))
    lower[rows[left], old_group[left]] = np.minimum(lower[rows[left], old_group[left]], away[left])
    for g, asked, members, d in seen:
        d = np.where(members[None, :] == owned[asked][:, None], np.inf, np.sqrt(d.astype(np.float64)))
        lower[rows[asked], g] = _down(d.min(1, initial=np.inf))
    at[rows], upper[rows] = owned, _up(np.sqrt(best.astype(np.float64)))
    return at, upper, lower, int(need.sum())


def _numbers(column: pa.Array, kind: str) -> np.ndarray:
    """A column of binary values of one length as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in np.ascontiguousarray(rows)], pa.binary())


def integers(vectors: DataFrame) -> DataFrame:
    """vec_id, label and q (the integer components, 32 bits each) of the rows whose vector is not null and has only finite components."""

    def convert(batches):
        for batch in batches:
            ids, labels, rows = batch.columns
            flat = np.asarray(rows.flatten().to_numpy(zero_copy_only=False), np.float64)
            whole = np.floor(flat * SCALE)
            if len(whole) and np.abs(whole).max() > MAX_COMPONENT:
                raise ValueError(f"components beyond {MAX_COMPONENT // SCALE} have no exact error in 64 bits")
            ends = np.cumsum([0, *(rows.value_lengths().to_pylist())])
            data = [whole[a:b].astype("<i4").tobytes() for a, b in zip(ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([ids, labels, pa.array(data, pa.binary())], names=["vec_id", "label", "q"])

    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), F.col("embedding").cast("array<double>").alias("v")).where(F.col("v").isNotNull() & finite)
    kind = dict(rows.dtypes)["label"]
    return map_arrow(rows, convert, f"vec_id long, label {kind}, q binary", ROWS)


def _state(rows: DataFrame, step, label_type: str) -> DataFrame:
    """rows(vec_id, label, q, ...) with at, upper and lower by step(points, batch) of each part."""
    schema = f"vec_id long, label {label_type}, q binary, at binary, upper binary, lower binary"

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            at, upper, lower = step(_numbers(batch.column("q"), "<i4").astype(np.int64), batch)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("vec_id", "label", "q")), _binary(at.astype("u1")), _binary(upper.astype("<f8")), _binary(lower.astype("<f8"))], names=["vec_id", "label", "q", "at", "upper", "lower"])

    return map_arrow(rows, run, schema, ROWS)


def _sums(state: DataFrame, n_entries: int, width: int, parts: int) -> dict[int, tuple[int, list[int]]]:
    """count and component sums of each entry in use, by part * ENTRIES + entry: as many rows as entries at most."""

    def partial(batches):
        n, total = np.zeros(parts * n_entries, np.int64), np.zeros((parts * n_entries, width), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            points = _numbers(batch.column("q"), "<i4").astype(np.int64).reshape(batch.num_rows * parts, width)
            key = (_numbers(batch.column("at"), "u1").astype(np.int64) + np.arange(parts) * n_entries).ravel()
            n += np.bincount(key, minlength=len(n))
            np.add.at(total, key, points)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n[used]), pa.array(total[used].tolist(), pa.list_(pa.int64()))], names=["key", "n", "s"])

    rows = map_arrow(state.select("q", "at"), partial, "key long, n long, s array<long>", ROWS)
    wide = rows.groupBy("key").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.get("s", F.lit(j)).cast("decimal(38,0)")) for j in range(width))).alias("s"))
    return {r.key: (r.n, [int(x) for x in r.s]) for r in wide.collect()}


def encode_vectors(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(rows, codebooks) of embeddings(vec_id, embedding, label, ...): rows with vec_id, label, code (one byte a part, in order)
    and error (the sum of squared distances), and the final entries, an array (parts, entries, length of a part).

    Rows whose vector is null or has null, NaN or infinite components are left out. Vectors must be of one length, which the parts divide,
    and components within MAX_COMPONENT / 256: others are an error, as no long holds their distances. The first entries are the
    rows with the smallest vec_id, null last, rows that repeat an id in the order of their
    components' bytes (32 bits each, least byte first); with fewer rows there are fewer entries. An entry without parts stays as it is. Other columns are ignored."""
    if not 0 < entries <= 256:
        raise ValueError("a code has one byte a part: 1 to 256 entries")
    rows = cut_lineage(integers(vectors))
    label_type = dict(rows.dtypes)["label"]
    lengths = rows.agg(F.min(F.length("q")).alias("a"), F.max(F.length("q")).alias("b")).first()
    if lengths.a is None:
        return rows.select("vec_id", "label", F.col("q").alias("code"), F.lit(0).cast("long").alias("error")), np.zeros((parts, 0, 0), np.int64)
    if lengths.a != lengths.b or lengths.a // 4 % parts:
        raise ValueError(f"vectors of {lengths.a // 4} to {lengths.b // 4} components can't be cut into {parts} equal parts")
    width = lengths.a // 4 // parts
    smallest = rows.select("vec_id", "q").orderBy(F.col("vec_id").asc_nulls_last(), "q").limit(entries).collect()
    k = len(smallest)
    books = np.stack([np.frombuffer(bytes(r.q), "<i4").astype(np.int64) for r in smallest]).reshape(k, parts, width).transpose(1, 0, 2)
    groups = [entry_groups(books[p]) for p in range(parts)]
    edges = np.concatenate(([0], np.cumsum([g.max() + 1 for g in groups])))

    def first(points, _, books=books):
        each = [first_assignment(points[:, p * width : (p + 1) * width], books[p], groups[p]) for p in range(parts)]
        return np.stack([e[0] for e in each], 1), np.stack([e[1] for e in each], 1), np.concatenate([e[2] for e in each], 1)

    state = cut_lineage(_state(rows, first, label_type))
    for _ in range(rounds):
        before, books = books, books.copy()
        for key, (n, s) in _sums(state, k, width, parts).items():
            books[key // k, key % k] = [x // n for x in s]

        def following(points, batch, before=before, books=books):
            at, upper, lower = _numbers(batch.column("at"), "u1").astype(np.int64), _numbers(batch.column("upper"), "<f8"), _numbers(batch.column("lower"), "<f8")
            each = [next_assignment(points[:, p * width : (p + 1) * width], at[:, p], upper[:, p], lower[:, edges[p] : edges[p + 1]], before[p], books[p], groups[p]) for p in range(parts)]
            return np.stack([e[0] for e in each], 1), np.stack([e[1] for e in each], 1), np.concatenate([e[2] for e in each], 1)

        state = cut_lineage(_state(state, following, label_type))

    def errors(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            points, at = _numbers(batch.column("q"), "<i4").astype(np.int64), _numbers(batch.column("at"), "u1")
            chosen = books[np.arange(parts)[None, :], at].reshape(batch.num_rows, parts * width)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), batch.column("at"), pa.array(((points - chosen) ** 2).sum(1), pa.int64())], names=["vec_id", "label", "code", "error"])

    coded = map_arrow(state.select("vec_id", "label", "q", "at"), errors, f"vec_id long, label {label_type}, code binary, error long", ROWS)
    return coded, books


def books_digest(books: np.ndarray) -> str:
    """SHA-256 of all integer components in decimal, by part, entry and place, with commas between."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def with_label_error(coded: DataFrame, broadcast_labels: int = BROADCAST_LABELS) -> DataFrame:
    """coded with label_error: error summed over equal labels, nulls together.

    Sums are one row a label. They are broadcast up to so many labels; beyond that the join is an
    exchange, whose large partitions Spark splits."""
    sums = cut_lineage(coded.groupBy("label").agg(F.sum("error").alias("label_error")))
    small = sums.count() <= broadcast_labels
    right = sums.select(F.col("label").alias("__label"), "label_error")
    return coded.join(F.broadcast(right) if small else right, F.col("label").eqNullSafe(F.col("__label")), "left").drop("__label")


def oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The rows of the query in DuckDB, for embeddings of 64 components: all distances, without bounds."""
    width = 64 // parts
    near = lambda book: f"SELECT p.vec_id, p.part, min(({' + '.join(f'(p.a[{j}] - c.a[{j}]) * (p.a[{j}] - c.a[{j}])' for j in range(1, width + 1))}) * {entries} + c.entry) AS m FROM points p JOIN {book} c ON c.part = p.part GROUP BY 1, 2"
    floor = lambda s: f"(({s}) - ((({s}) % count(*)) + count(*)) % count(*)) // count(*)"
    steps = [f"""
v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
points AS MATERIALIZED (SELECT vec_id, part, q[part * {width} + 1 : part * {width} + {width}] AS a FROM v, range({parts}) r(part)),
b0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, a FROM points WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT {entries}))"""]
    for r in range(rounds):
        sums = ", ".join(floor(f"sum(p.a[{j}])") for j in range(1, width + 1))
        steps.append(f"n{r} AS MATERIALIZED ({near(f'b{r}')})")
        steps.append(f"u{r} AS (SELECT n.part, n.m % {entries} AS entry, [{sums}] AS a FROM n{r} n JOIN points p USING (vec_id, part) GROUP BY 1, 2)")
        steps.append(f"b{r + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(u.a, b.a) AS a FROM b{r} b LEFT JOIN u{r} u USING (part, entry))")
    steps.append(f"n{rounds} AS ({near(f'b{rounds}')})")
    steps.append(f"f AS (SELECT vec_id, string_agg(printf('%02x', CAST(m % {entries} AS INT)), '' ORDER BY part) AS code, CAST(sum(m // {entries}) AS BIGINT) AS error FROM n{rounds} GROUP BY 1)")
    steps.append("e AS (SELECT vec_id, label, code, error FROM f JOIN v USING (vec_id))")
    digest = f"(SELECT sha256(string_agg(array_to_string(a, ','), ',' ORDER BY part, entry)) FROM b{rounds})"
    return "WITH " + ",\n".join(steps) + f"\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, {digest} AS codebooks_sha256 FROM e"
