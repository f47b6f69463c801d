"""Reading levels by harmonic propagation over the graph of documents and words.

A document and each of its words are joined by an edge of weight (saturated count) * (idf of the
word). Graded documents are clamped to their grade. A word's level is the weighted mean of its
documents' levels, a document's level the weighted mean of its words' levels, where a word counts
the more the less its documents' levels differ. All edges of one word to ungraded documents share
a fixed weight, so that grades are never drowned by the many ungraded documents, and words that no
graded document has still get a level from their neighbours.

Words are hashed into 2**18 nodes, so word levels are vectors of a fixed size (2 MB each): they go
to the tasks by broadcast, and a task sends back one row for each node that its documents have.
Documents never leave their partition.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.util import materialise

NODES = 1 << 18
#: Weight that all ungraded edges of one word share, floor and power of the spread that a word's weight falls with, and saturation of counts.
SHARED, FLOOR, POWER, SATURATION = 2.0, 0.15, 2.0, 30.0
ROUNDS, SETTLED = 8, 0.005
LOWEST, HIGHEST = 1.0, 5.0
SLICE_CHARS = 1 << 20
#: Letters of other scripts that pass for Latin ones, and characters that only break words up.
LOOKALIKES = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ѕ": "s", "ј": "j", "ԁ": "d", "һ": "h", "ո": "n", "ɡ": "g", "ο": "o", "α": "a", "А": "a", "В": "b", "Е": "e", "К": "k", "М": "m", "Н": "h", "О": "o", "Р": "p", "С": "c", "Т": "t", "Х": "x"}
INVISIBLE = "\u200b\u200c\u200d\u2060\ufeff\u00ad"


def plain(text: str) -> str:
    """Compatibility forms, look-alike letters and invisible characters undone."""
    if text.isascii():
        return text
    return unicodedata.normalize("NFKC", text).translate(_TABLE)


_TABLE = str.maketrans(LOOKALIKES | {c: None for c in INVISIBLE})


class Words:
    """Hashes of all words of many texts at once, by differences of one running polynomial sum."""

    FACTOR = 0x9E3779B97F4A7C15

    def __init__(self):
        import numpy as np

        self.letter = np.zeros(256, dtype=bool)
        self.letter[ord("a") : ord("z") + 1] = self.letter[128:] = True
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[ord("A") : ord("Z") + 1] += 32
        self.powers = self.inverse = np.zeros(0, dtype=np.uint64)

    def _grow(self, n: int) -> None:
        import numpy as np

        if len(self.powers) < n:
            for name, factor in (("powers", self.FACTOR), ("inverse", pow(self.FACTOR, -1, 2**64))):
                steps = np.full(n, np.uint64(factor), dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def _pieces(self, texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
        """Groups of texts of bounded length; longer texts are cut at blanks."""
        owners, parts, held = [], [], 0
        for i, text in enumerate(texts):
            at = 0
            while text and at < len(text):
                end = at + SLICE_CHARS
                if end < len(text):
                    blank = text.find(" ", end, end + SLICE_CHARS)
                    end = blank if blank >= 0 else end
                owners.append(i)
                parts.append(text[at:end])
                held += len(parts[-1])
                at = end
                if held >= SLICE_CHARS:
                    yield owners, parts
                    owners, parts, held = [], [], 0
        if parts:
            yield owners, parts

    def nodes(self, texts: list[str | None]):
        """(text number, node, count) of each distinct word of each text, sorted by text."""
        import numpy as np

        pairs, counts = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for owners, parts in self._pieces(texts):
            raw = [plain(t).encode("utf-8", "replace") for t in parts]
            data = self.lower[np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)]
            self._grow(len(data) + 1)
            turn = np.diff(self.letter[data].astype(np.int8), prepend=np.int8(0))
            start, end = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
            sums = np.zeros(len(data) + 1, dtype=np.uint64)
            np.cumsum((data.astype(np.uint64) + np.uint64(7)) * self.powers[: len(data)], out=sums[1:])
            h = (sums[end] - sums[start]) * self.inverse[start]
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(32)
            text = np.array(owners)[np.searchsorted(np.cumsum([len(r) + 1 for r in raw]), start, side="right")]
            pair, count = np.unique(text * NODES + (h >> np.uint64(20)).astype(np.int64) % NODES, return_counts=True)
            pairs.append(pair)
            counts.append(count)
        pair, back = np.unique(np.concatenate(pairs), return_inverse=True)
        count = np.bincount(back, np.concatenate(counts), minlength=len(pair)).astype(np.int64)
        return pair // NODES, pair % NODES, count


def word_graph(documents: DataFrame, key: str, text: str) -> DataFrame:
    """key and its words' nodes (uint32) and counts (uint32) as bytes; whole texts, empty for null ones."""
    rows = documents.select(F.col(text).alias("text"), F.col(key).alias("key"))
    schema = rows.select("key").withColumn("nodes", F.lit(b"")).withColumn("counts", F.lit(b"")).schema

    def run(batches: Iterable) -> Iterator:
        import numpy as np
        import pyarrow as pa

        words = Words()

        def packed(keys, texts):
            of, node, count = words.nodes(texts)
            offsets = pa.py_buffer((np.searchsorted(of, np.arange(len(texts) + 1)) * 4).astype(np.int32).tobytes())
            cells = [pa.Array.from_buffers(pa.binary(), len(texts), [None, offsets, pa.py_buffer(x.astype("<u4").tobytes())]) for x in (node, count)]
            return pa.RecordBatch.from_arrays([keys, *cells], names=["key", "nodes", "counts"])

        for batch in batches:
            yield packed(batch.column(1), batch.column(0).to_pylist())

    return rows.mapInArrow(run, schema)


def _edges(batch, nodes: int, counts: int):
    """Row, node and saturated count of each edge of a batch."""
    import numpy as np

    raw = batch.column(nodes).to_pylist()
    node = np.frombuffer(b"".join(raw), dtype="<u4").astype(np.int64)
    count = np.frombuffer(b"".join(batch.column(counts).to_pylist()), dtype="<u4").astype(float)
    row = np.repeat(np.arange(len(raw)), [len(x) // 4 for x in raw])
    return row, node, count / (1 + count / SATURATION)


def _sums_first(batches: Iterable) -> Iterator:
    """By node: documents, ungraded weight, and graded weight with its sums of grades and squares; -1: documents in all and graded ones."""
    import numpy as np
    import pyarrow as pa

    out, docs, graded = np.zeros((5, NODES)), 0, np.zeros(3)
    for batch in batches:
        row, node, weight = _edges(batch, 0, 1)
        grade = batch.column(2).to_numpy(zero_copy_only=False).astype(float)
        docs += len(grade)
        known = ~np.isnan(grade)
        graded += [known.sum(), np.nansum(grade), np.nansum(grade**2)]
        y, on = grade[row], known[row]
        for i, (which, value) in enumerate(((slice(None), None), (~on, weight), (on, weight), (on, weight * np.nan_to_num(y)), (on, weight * np.nan_to_num(y) ** 2))):
            out[i] += np.bincount(node[which], None if value is None else value[which], minlength=NODES)
    at = np.flatnonzero(out[0])
    head = np.array([docs, *graded, 0.0])
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int64)), *[pa.array(np.append(out[i][at], head[i])) for i in range(5)]], names=["node", *[f"x{i}" for i in range(5)]])


@dataclass
class Levels:
    """Word levels at one round: what every task needs."""

    idf: object
    graded: object  # weight, sum and sum of squares of grades of graded edges, idf included
    prior: object
    spread: object
    slope: float = 1.0
    shift: float = 0.0

    def of(self, row, node, count, rows: int, own=None):
        """Weighted means over the rows' words. own: grades whose own edges are left out of the word levels."""
        import numpy as np

        weight = count * self.idf[node]
        total, first, second = (g[node] for g in self.graded)
        if own is not None:
            y = own[row]
            total, first, second = total - weight, first - weight * y, second - weight * y**2
        total = np.maximum(total, 0)
        mean = (first + SHARED * self.prior[node]) / (total + SHARED)
        square = (second + SHARED * (self.spread[node] + self.prior[node] ** 2)) / (total + SHARED)
        edge = weight / (np.maximum(square - mean**2, 0) + FLOOR) ** POWER
        reach = np.bincount(row, edge, minlength=rows)
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.bincount(row, edge * mean, minlength=rows) / reach, weight


def _round(shared):
    """By node: sums over ungraded documents of weight * level and weight * level**2; below 0: sums for the calibration."""

    def run(batches: Iterable) -> Iterator:
        import numpy as np
        import pyarrow as pa

        levels = shared.value
        out, seen, fit = np.zeros((2, NODES)), np.zeros(NODES, dtype=bool), np.zeros(6)
        for batch in batches:
            row, node, count = _edges(batch, 0, 1)
            grade = batch.column(2).to_numpy(zero_copy_only=False).astype(float)
            on = ~np.isnan(grade)
            if on.any():
                pick = on[row]
                x, _ = levels.of(row[pick], node[pick], count[pick], len(grade), grade)
                use = on & ~np.isnan(x)
                x, y = x[use], grade[use]
                fit += [len(x), x.sum(), y.sum(), (x * x).sum(), (x * y).sum(), (y * y).sum()]
            pick = ~on[row]
            row, node, count = row[pick], node[pick], count[pick]
            level, weight = levels.of(row, node, count, len(grade))
            level = level[row]
            for i in range(2):
                out[i] += np.bincount(node, weight * level ** (i + 1), minlength=NODES)
            seen[node] = True
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([at, [-1, -2, -3]]).astype(np.int64)), pa.array(np.concatenate([out[0][at], fit[0::2]])), pa.array(np.concatenate([out[1][at], fit[1::2]]))], names=["node", "x0", "x1"])

    return run


def _final(shared):
    def run(batches: Iterable) -> Iterator:
        import numpy as np
        import pyarrow as pa

        levels = shared.value
        known = levels.graded[0] > 0
        for batch in batches:
            row, node, count = _edges(batch, 1, 2)
            level, weight = levels.of(row, node, count, batch.num_rows)
            score = np.clip(levels.slope * level + levels.shift, LOWEST, HIGHEST)
            with np.errstate(invalid="ignore", divide="ignore"):
                reached = np.bincount(row, weight * known[node], minlength=batch.num_rows) / np.bincount(row, weight, minlength=batch.num_rows)
            none = np.isnan(score)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, mask=none), pa.array(np.floor(np.nan_to_num(score) + 0.5).astype(np.int32), mask=none), pa.array(np.nan_to_num(reached))], names=["key", "score", "level", "reached"])

    return run


def _by_node(df: DataFrame, width: int):
    """The sums of at most NODES + 3 nodes."""
    sums = df.groupBy("node").agg(*[F.sum(f"x{i}").alias(f"x{i}") for i in range(width)]).toPandas()
    return sums["node"].to_numpy(), sums[[f"x{i}" for i in range(width)]].to_numpy()


def reading_levels(documents: DataFrame, labels: DataFrame, key: str, text: str, label: str, rounds: int = ROUNDS) -> DataFrame:
    """key, ``score`` (on the scale of the labels, within 1 to 5), ``level`` (score rounded) and ``reached``.

    labels: ``key`` and a numeric ``label``; several ratings of a document are averaged, null,
    NaN and out-of-scale ones are left out. ``reached`` is the share of a text's word weight whose
    words some graded document has.

    A text without words (null, empty, only digits or marks) has a null score, as has every text
    if there is no label. A document with a grade also gets the graph's estimate, as raters err.
    Repeated rows of a document are rated alike and each counts. Every row has one result row.
    """
    import numpy as np

    spark = documents.sparkSession
    grade = F.col(label).cast("double")
    grades = labels.filter(F.col(key).isNotNull() & (grade >= LOWEST) & (grade <= HIGHEST)).groupBy(F.col(key).alias("key")).agg(F.avg(grade).alias("grade"))
    graph = materialise(word_graph(documents, key, text).join(grades, "key", "left"), "reading-graph")
    part = graph.select("nodes", "counts", "grade")

    node, sums = _by_node(part.mapInArrow(_sums_first, "node long, " + ", ".join(f"x{i} double" for i in range(5))), 5)
    head = sums[node == -1].sum(axis=0)
    docs, n = head[0], head[1]
    if not n:
        return graph.select(F.col("key").alias(key), F.lit(None).cast("double").alias("score"), F.lit(None).cast("int").alias("level"), F.lit(0.0).alias("reached"))
    mean = head[2] / n
    spread = max(head[3] / n - mean**2, 0.25)
    dense = np.zeros((5, NODES))
    dense[:, node[node >= 0]] = sums[node >= 0].T
    idf = np.log(1 + docs / np.maximum(dense[0], 1))
    ungraded = dense[1] * idf
    levels = Levels(idf, dense[2:5] * idf, np.full(NODES, mean), np.full(NODES, spread))
    for _ in range(max(1, rounds)):
        shared = spark.sparkContext.broadcast(levels)
        node, sums = _by_node(part.mapInArrow(_round(shared), "node long, x0 double, x1 double"), 2)
        at = {k: sums[node == -k].sum(axis=0) for k in (1, 2, 3)}
        (count, x), (y, xx), (xy, _) = at[1], at[2], at[3]
        spread_x = xx - x * x / count if count else 0
        # with too few grades to fit a line the levels stay as they are
        levels.slope = float(np.clip((xy - x * y / count) / spread_x, 0.2, 5)) if count >= 3 and spread_x > 1e-9 else 1.0
        levels.shift = float(y / count - levels.slope * x / count) if count else 0.0
        first, second = (np.zeros(NODES) for _ in range(2))
        first[node[node >= 0]], second[node[node >= 0]] = sums[node >= 0].T
        a, b = levels.slope, levels.shift
        has = ungraded > 0
        weight = np.where(has, ungraded, 1)
        prior = np.where(has, np.clip((a * first + b * ungraded) / weight, LOWEST, HIGHEST), mean)
        square = (a * a * second + 2 * a * b * first + b * b * ungraded) / weight
        change = float(np.average(np.abs(prior - levels.prior), weights=np.maximum(ungraded, 1e-12)))
        shared.unpersist()
        levels = Levels(idf, levels.graded, prior, np.where(has, np.maximum(square - prior**2, 0.05), spread), a, b)
        if change < SETTLED:
            break
    shared = spark.sparkContext.broadcast(levels)
    schema = graph.select("key").withColumn("score", F.lit(0.0)).withColumn("level", F.lit(0)).withColumn("reached", F.lit(0.0)).schema
    return graph.select("key", "nodes", "counts").mapInArrow(_final(shared), _nullable(schema)).withColumnRenamed("key", key)


def _nullable(schema):
    from pyspark.sql import types as T

    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])
