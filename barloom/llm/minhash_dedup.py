"""Near-duplicates: MinHash bands, sequential Bayesian pruning of candidates, exact check of survivors."""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import cut, small_batches
from barloom.llm.components import connected_components

BANDS, ROWS = 32, 6  #: a pair of similarity 0.8 shares no band with a chance of 6e-5
CHECKS, STEP = 128, 32  #: separate hashes for the posterior, a byte of each, compared STEP at a time
MISS = 1e-6  #: a candidate is pruned when its posterior chance of being similar enough falls below this
BLOCK = 1024  #: members of a bucket that meet in one cell; a larger bucket is laid out in cells of two blocks each
PARTS, PART_PAIRS = 64, 100_000  #: a leader's text goes once to each part of its members: PARTS, or more for so many pairs each
MAX_WORDS = 100_000  #: words whose hashes a worker remembers
_M64 = (1 << 64) - 1


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MAX_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_words = WordHashes()


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; a text of fewer words is one shingle, none without words."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = min(width, len(words))
    out = np.full(len(words) - n + 1, n, np.uint64)
    for i in range(n):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += h[i : i + len(out)]
        out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return np.unique(out)


def _constants() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20_240_607)
    n = BANDS * ROWS + CHECKS
    return draw.integers(0, 1 << 32, n, np.uint32) | np.uint32(1), draw.integers(0, 1 << 32, n, np.uint32)


_A, _B = _constants()


def signature(shingles: np.ndarray) -> np.ndarray:
    """Smallest value of every hash function over the set, a block of shingles at a time."""
    best = np.full(len(_A), 0xFFFFFFFF, np.uint32)
    h = (shingles >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(h), 1024):
        values = np.multiply(_A[:, None], h[None, at : at + 1024])
        values += _B[:, None]
        np.minimum(best, values.min(axis=1), out=best)
    return best


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band, the band's number mixed in."""
    parts = signatures[:, : BANDS * ROWS].reshape(len(signatures), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for i in range(ROWS):
        key = (key ^ parts[:, :, i]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(31)
    return key.astype(np.int64)


def _sketch(width: int):
    def run(batches):
        _words.clear()  # of the task before: an idle worker would keep them
        for batch in batches:
            sets = [shingle_set(t, width) for t in batch.column("text").to_pylist()]
            full = [i for i, s in enumerate(sets) if len(s)]
            signs = np.array([signature(sets[i]) for i in full], np.uint32).reshape(len(full), len(_A))
            keys, checks = band_keys(signs), signs[:, BANDS * ROWS :].astype(np.uint8)
            at = np.zeros(len(sets) + 1, np.int32)
            at[1:] = np.cumsum([BANDS * (len(s) > 0) for s in sets])
            prints, proofs = [None] * len(sets), [None] * len(sets)
            for k, i in enumerate(full):
                prints[i], proofs[i] = xxhash.xxh3_128_digest(sets[i].tobytes()), checks[k].tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(map(len, sets), pa.int64()), pa.array(prints, pa.binary()), pa.ListArray.from_arrays(pa.array(at), pa.array(keys.ravel())), pa.array(proofs, pa.binary())],
                ["doc_id", "n_shingles", "print", "bands", "proof"],
            )

    return run


def prune_limits(percent: int, miss: float = MISS) -> list[int]:
    """For 1..CHECKS hashes compared: the fewest matches that keep a pair. With a uniform prior the chance that the
    similarity reaches t after m of n matches is P(Binomial(n + 1, t) <= m)."""
    t, out = percent / 100, []
    for n in range(CHECKS + 1):
        total, m = 0.0, 0
        while m <= n:
            total += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if total >= miss:
                break
            m += 1
        out.append(m)
    return out


def bayes_keep(left: np.ndarray, right: np.ndarray, limits: list[int]) -> np.ndarray:
    """Rows whose proofs stay likely: compared a batch of hashes at a time, losers leave early."""
    alive, matches = np.arange(len(left)), np.zeros(len(left), np.int64)
    for n in range(STEP, CHECKS + 1, STEP):
        matches[alive] += (left[alive, n - STEP : n] == right[alive, n - STEP : n]).sum(axis=1)
        alive = alive[matches[alive] >= limits[n]]
    return alive


def _proofs(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, CHECKS)


def _prune(limits: list[int]):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                alive = bayes_keep(_proofs(batch.column("pa")), _proofs(batch.column("pb")), limits)
                yield batch.select(["a", "b"]).take(pa.array(alive))

    return run


class Cell:
    """Rows of one block of a bucket, or of two: which pairs of two components may be similar enough.

    A pair is taken up in the first band it shares alone, so that it is compared once whatever the number of its bands.
    """

    def __init__(self, rows: list[tuple], limits: list[int]):
        self.rows, self.limits = rows, limits
        self.side = np.array([r["side"] for r in rows])
        self.part = np.array([r["component"] for r in rows])
        self.bands = np.array([r["bands"] for r in rows], np.int64)
        self.proofs = np.frombuffer(b"".join(r["proof"] for r in rows), np.uint8).reshape(-1, CHECKS)

    def pairs(self):
        """(row, later rows it may be similar to)."""
        one = self.rows[0]["i"] == self.rows[0]["j"]
        for k in range(len(self.rows)):
            after = np.arange(k + 1, len(self.rows))
            others = after[(self.part[after] != self.part[k]) & (one | (self.side[after] != self.side[k]))]
            same = self.bands[others] == self.bands[k]
            others = others[same.argmax(axis=1) == self.rows[k]["band"]] if len(others) else others
            alive = others[bayes_keep(np.broadcast_to(self.proofs[k], (len(others), CHECKS)), self.proofs[others], self.limits)]
            if len(alive):
                yield k, alive.tolist()


def _cells(batches, width: int | None = None):
    """Rows of a sorted partition, a cell at a time; with a width, a row's text gives way to its set of shingles."""
    at, rows = None, []
    for batch in batches:
        texts = batch.column("text") if width else None
        for k, row in enumerate((batch.drop_columns(["text"]) if width else batch).to_pylist()):
            cell = (row["key"], row["i"], row["j"])
            if cell != at and rows:
                yield rows
                rows = []
            at = cell
            if width:
                row["set"] = shingle_set(texts[k].as_py(), width)
            rows.append(row)
    if rows:
        yield rows


def _candidates(limits: list[int]):
    """The rows of each cell that have a likely partner."""

    def run(batches):
        for rows in _cells(batches):
            found = {x for k, others in Cell(rows, limits).pairs() for x in (k, *others)}
            if found:
                keep = [rows[k] for k in sorted(found)]
                yield pa.RecordBatch.from_pylist([{c: r[c] for c in _CELL.names} for r in keep], _CELL)

    return run


_CELL = pa.schema([("key", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("side", pa.int32()), ("band", pa.int32()), ("rep", pa.int64()), ("component", pa.int64())])
_CELL_DDL = "key long, i int, j int, side int, band int, rep long, component long"


def _confirm_cells(width: int, percent: int, limits: list[int]):
    """Links of each cell, on the full sets; components that a link has joined are not compared again."""

    def run(batches):
        for rows in _cells(batches, width):
            root: dict[int, int] = {}

            def find(x: int, root=root) -> int:
                while root.get(x, x) != x:
                    x = root[x]
                return x

            links = []
            for k, others in Cell(rows, limits).pairs():
                for o in others:
                    x, y = find(rows[k]["component"]), find(rows[o]["component"])
                    if x != y and similar(rows[k]["set"], rows[o]["set"], percent):
                        root[max(x, y)] = min(x, y)
                        links.append((rows[k]["rep"], rows[o]["rep"]))
            if links:
                yield pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return run


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union of two sorted sets, neither empty."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    same = len(np.intersect1d(a, b, assume_unique=True))
    return same > 0 and 100 * same >= percent * (len(a) + len(b) - same)


def _confirm(width: int, percent: int):
    """Members of sorted stars that are similar to their leader, whose row (b null) stands first."""

    def run(batches):
        at, leaders = None, []
        for batch in batches:
            keep = []
            for i, (a, part, b, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("a", "part", "b", "text")), strict=True)):
                if (a, part) != at:
                    at, leaders = (a, part), []
                own = shingle_set(text, width)
                if b is None:
                    leaders.append(own)
                elif any(similar(leader, own, percent) for leader in leaders):
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return run


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, n_shingles, component_id, kept; one row for each input row.

    Links are pairs whose sets of `width`-word shingles reach 100 * intersection >= percent * union, confirmed on the
    full sets. Equal sets are one node, so copies never meet as pairs. In each bucket of a band every node meets the
    smallest node; what this leaves in several components is then compared across components inside the buckets, block
    by block, so that no link between components is lost to a cap and no pairs leave a task but links.

    Null or wordless texts have no shingles and no links (n_shingles 0, kept). A very long text is read whole; a task
    holds the hashed sets of one cell, 2 * BLOCK at most, and no texts. Rows that share a doc_id count as one document. A null doc_id links with nothing: component_id null, kept. Ties need no rule: the smallest id stands for
    a component. An empty table gives an empty result; extra columns are not read. The chance that a pair at the
    threshold shares no band is (1 - t^ROWS)^BANDS, pruning adds at most about MISS.
    """
    spark = docs.sparkSession
    small_batches(spark)
    limits = prune_limits(percent)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    sketch = cut(texts.mapInArrow(_sketch(width), "doc_id long, n_shingles long, print binary, bands array<long>, proof binary"), "sketch")

    owners = cut(sketch.where("print is not null and doc_id is not null").groupBy("print").agg(F.min("doc_id").alias("rep")), "owners")
    nodes = sketch.join(owners, (sketch["print"] == owners["print"]) & (sketch.doc_id == owners.rep)).select("rep", "bands", "proof")
    nodes = cut(nodes, "nodes")
    members = nodes.select("rep", F.posexplode("bands").alias("band", "key"))
    buckets = members.groupBy("key").agg(F.min("rep").alias("leader"), F.max("rep").alias("top")).where("leader < top").select("key", "leader")
    proofs = nodes.select("rep", "proof")
    stars = members.join(buckets, "key").where("rep <> leader").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct()
    links = cut(_confirmed(_pruned(stars, proofs, limits), texts, width, percent), "links")
    parts = cut(connected_components(links), "parts")

    labelled = members.join(parts, F.col("rep") == F.col("node"), "left").select("key", "band", "rep", F.coalesce("component", "rep").alias("component"))
    open_ = labelled.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n"), F.min("rep").alias("leader")).where("low < high")
    rest = labelled.join(open_.select("key", "n", "leader"), "key").where("rep <> leader and n > 2")
    n = F.ceil(F.col("n") / BLOCK).cast("int")
    placed = rest.select("key", "band", "rep", "component", F.pmod(F.xxhash64("rep"), n).cast("int").alias("own"), F.explode(F.sequence(F.lit(0), n - 1)).alias("with"))
    cells = placed.select("key", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), (F.col("own") > F.col("with")).cast("int").alias("side"), "band", "rep", "component")
    likely = cut(_by_cell(cells.join(nodes, "rep")).mapInArrow(_candidates(limits), _CELL_DDL), "likely")
    full = likely.join(nodes, "rep").join(_texts_of(likely.select(F.col("rep").alias("doc_id")), texts).withColumnRenamed("doc_id", "rep"), "rep")
    more = cut(_by_cell(full).mapInArrow(_confirm_cells(width, percent, limits), "a long, b long"), "links")
    if more.take(1):
        parts = connected_components(links.union(more))
    least = owners.join(parts, F.col("rep") == F.col("node"), "left").select("print", F.coalesce("component", "rep").alias("component_id"))
    rows = sketch.select("doc_id", "n_shingles", "print").join(least, "print", "left")
    own = F.coalesce("component_id", "doc_id")
    return rows.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), own).alias("component_id"), F.coalesce(own == F.col("doc_id"), F.lit(True)).alias("kept"))


def _pruned(pairs: DataFrame, proofs: DataFrame, limits: list[int]) -> DataFrame:
    left = proofs.select(F.col("rep").alias("a"), F.col("proof").alias("pa"))
    right = proofs.select(F.col("rep").alias("b"), F.col("proof").alias("pb"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "pa", "pb").mapInArrow(_prune(limits), "a long, b long").distinct()


def _texts_of(ids: DataFrame, texts: DataFrame) -> DataFrame:
    """Texts of some ids. The ids are written first, so that Spark knows their size and broadcasts them only if small."""
    return texts.join(cut(ids.distinct(), "ids"), "doc_id", "left_semi")


def _confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs (a, b) with a leader a that are similar on the full sets. A star's members are dealt to parts, and each part
    gets the leader's text once."""
    pairs = cut(pairs, "pairs")
    parts = max(PARTS, -(-pairs.count() // PART_PAIRS))
    texts = _texts_of(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")), texts)
    stars = pairs.select("a", F.pmod(F.xxhash64("b"), F.lit(parts)).alias("part"), "b")
    leaders = stars.select("a", "part").distinct().join(texts, F.col("a") == F.col("doc_id")).select("a", "part", F.lit(None).cast("long").alias("b"), "text")
    members = stars.join(texts, F.col("b") == F.col("doc_id")).select("a", "part", "b", "text")
    dealt = leaders.union(members).repartition("a", "part").sortWithinPartitions("a", "part", F.asc_nulls_first("b"))
    return dealt.mapInArrow(_confirm(width, percent), "a long, b long").distinct()


def _by_cell(rows: DataFrame) -> DataFrame:
    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "rep")
