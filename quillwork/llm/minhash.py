"""Near-duplicates by BagMinHash (operator 1).

A text is the multiset of its runs of five words. Every run owns Poisson processes over the cells of a dyadic
division of its weight axis, (0, 1], (1, 2], (2, 4], ...; a text of multiplicity c sees the cells below c, and of
the cell that holds c the points below c. Each point goes to one component of the signature, which keeps its
earliest point; so two texts agree in a component with the probability of their weighted Jaccard similarity.
Points come in order of time, and a process ends once it is later than all components: few points are drawn.

Signatures are banded, texts that share a band are candidates, and multiset overlap of the texts decides.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import Grid, chunks, grid, mix, shingles, tidy
from .graph import components
from .heads import against_heads, slices
from .storage import Scratch, holding

WIDTH, SIMILARITY, BANDS, ROWS = 5, 0.8, 24, 4
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def bags(g: Grid, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, hash and multiplicity of every different run of ``width`` words; a shorter text is one run."""
    words = g.words()
    runs, at = shingles(words, g.doc, width)
    doc = g.doc[at]
    short = np.flatnonzero((np.diff(g.first) > 0) & (np.diff(g.first) < width))
    if len(short):
        whole = [mix(np.array([np.uint64(sum(int(x) * (i + 3) for i, x in enumerate(words[g.first[d] : g.first[d + 1]])) % (1 << 64))]))[0] for d in short]
        runs, doc = np.concatenate([runs, np.array(whole, np.uint64)]), np.concatenate([doc, short])
    by = np.lexsort((runs, doc))
    runs, doc = runs[by], doc[by]
    lead = np.flatnonzero(np.concatenate([[True], (runs[1:] != runs[:-1]) | (doc[1:] != doc[:-1])])) if len(runs) else np.zeros(0, np.int64)
    return doc[lead], runs[lead], np.diff(np.append(lead, len(runs)))


def signatures(doc: np.ndarray, runs: np.ndarray, times: np.ndarray, n_docs: int, size: int) -> np.ndarray:
    """(n_docs, size) numbers of the earliest points; texts without runs have zeros."""
    out, first = np.zeros(n_docs * size, np.uint64), np.full(n_docs * size, np.inf)
    if not len(doc):
        return out.reshape(n_docs, size)
    cells = [(np.arange(len(doc)), 0)]
    for k in range(1, int(times.max()).bit_length() + 1):
        if len(held := np.flatnonzero(times > 1 << (k - 1))):
            cells.append((held, k))
    with np.errstate(over="ignore"):
        row = np.concatenate([c for c, _ in cells])
        level = np.repeat([k for _, k in cells], [len(c) for c, _ in cells])
        seed = mix(runs[row] + level.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        span = np.where(level == 0, 1.0, 2.0 ** (level - 1))
        base = np.where(level == 0, 0.0, span)
        d, weight, t = doc[row], times[row].astype(np.float64), np.zeros(len(row))
        while len(d):
            seed = mix(seed + _GOLDEN)
            t = t - np.log(((seed >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / span
            other = mix(seed ^ np.uint64(0xA5A5A5A5A5A5A5A5))
            at = d * size + (((other & np.uint64(0xFFFFFFFF)) * np.uint64(size)) >> np.uint64(32)).astype(np.int64)
            inside = base + np.floor((other >> np.uint64(32)).astype(np.float64) * 2.0**-32 * span) < weight
            better = np.flatnonzero(inside & (t < first[at]))
            np.minimum.at(first, at[better], t[better])
            won = better[t[better] == first[at[better]]]
            out[at[won]] = seed[won]
            alive = t < first.reshape(n_docs, size).max(axis=1)[d]
            d, seed, t, span, base, weight = (x[alive] for x in (d, seed, t, span, base, weight))
    return out.reshape(n_docs, size)


def contents(g: Grid) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each text's sequence of words."""
    words, out = g.words(), []
    place = (np.arange(len(words)) - g.first[g.doc]).astype(np.uint64)
    with np.errstate(over="ignore"):
        for salt in (1, 2):
            total = np.concatenate([[np.uint64(0)], np.cumsum(mix(words + mix(place * np.uint64(2 * salt + 1) + np.uint64(salt))), dtype=np.uint64)])
            out.append(mix(total[g.first[1:]] - total[g.first[:-1]] + np.diff(g.first).astype(np.uint64)))
    return out[0], out[1]


def sketch(df: DataFrame, doc_id: str, text: str, width: int, bands: int, rows: int) -> DataFrame:
    """id, content hashes c1 and c2, number of runs and signature of every text with a word.

    Of each component 16 bits are kept; the ``rows`` of a band, 4 at most, make one number of ``sig``.
    """
    size = bands * rows

    @tidy
    def run(batches):
        for batch in batches:
            for start, stop in chunks(batch.column(1)):
                g = grid(batch.column(1).slice(start, stop - start))
                doc, runs, times = bags(g, width)
                short = np.zeros((len(g), bands, 4), np.uint16)
                short[:, :, :rows] = (signatures(doc, runs, times, len(g), size) & np.uint64(0xFFFF)).reshape(len(g), bands, rows)
                n = np.bincount(doc, times, len(g)).astype(np.int64)
                held = pa.array(np.diff(g.first) > 0)
                made = [pa.array(x.view(np.int64)) for x in contents(g)]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(g) + 1) * bands, pa.int32()), pa.array(short.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, stop - start), *made, pa.array(n), lists], names=["id", "c1", "c2", "n", "sig"]).filter(held)

    return df.select(F.col(f"`{doc_id}`").cast("long"), F.col(f"`{text}`")).where(f"`{doc_id}` is not null and `{text}` is not null").mapInArrow(run, "id long, c1 long, c2 long, n long, sig array<long>")


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two multisets (sorted hashes, multiplicities)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = np.minimum(a[1][i], b[1][j]).sum()
    return float(shared / (a[1].sum() + b[1].sum() - shared))


def _bags(texts: pa.Array, width: int) -> list[tuple[np.ndarray, ...]]:
    doc, runs, times = bags(grid(texts), width)
    return slices(doc, len(texts), runs, times)


def verify(scratch: Scratch, pairs: DataFrame, docs: DataFrame, width: int, least: float) -> DataFrame:
    """Of pairs (a, b), those whose texts in ``docs`` (id, text) overlap enough; many a to a b."""

    def alike(own, other):
        return {"alike": x} if len(own[0]) and len(other[0]) and (x := similarity(own, other)) >= least else None

    found = against_heads(scratch, pairs.select(F.col("a").alias("id"), F.col("b").alias("head")), docs.withColumn("row", F.col("id")), lambda texts: _bags(texts, width), alike, ["alike"])
    return found.select(F.col("id").alias("a"), F.col("head").alias("b"))


def _blocks(rows: DataFrame, columns: list[str], block: int) -> DataFrame:
    """Members of buckets (key, rep, all, ...) cut into blocks of about ``block``, so that every two blocks meet once:
    one copy of a member for each block of its bucket, with the pair (i, j) and whether it is on the second side."""
    own = rows.withColumn("blocks", F.ceil(F.col("all") / block).cast("int")).withColumn("x", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    met = own.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("key", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), (F.col("x") > F.col("y")).alias("second"), *columns)
    return met.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")


def across(rows: DataFrame, columns: list[str], block: int) -> DataFrame:
    """As ``_blocks``, for buckets (key, rep, comp, major, few, many, ...) of which only pairs of different components
    matter: members of the largest component, ``major`` (there are ``many``), do not meet each other, only the ``few``
    others. A bucket with few others is copied few times, however large it is."""
    few, many = (F.ceil(F.col(c) / block).cast("int") for c in ("few", "many"))
    inside = F.col("comp") == F.col("major")
    own = rows.withColumn("fb", few).withColumn("mb", many).withColumn("x", F.when(inside, F.col("fb") + F.pmod(F.xxhash64("rep"), F.col("mb"))).otherwise(F.pmod(F.xxhash64("rep"), F.col("fb"))).cast("int"))
    met = own.withColumn("y", F.explode(F.sequence(F.lit(0), F.when(inside, F.col("fb")).otherwise(F.col("fb") + F.col("mb")) - 1)))
    met = met.select("key", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), (F.col("x") > F.col("y")).alias("second"), *columns)
    return met.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")


def split_sides(scratch: Scratch, state: DataFrame) -> DataFrame:
    """``state`` (key, rep, comp, ...) of the buckets with several components, with ``major``, ``many`` and ``few``."""
    counts = state.groupBy("key", "comp").agg(F.count("*").alias("c"))
    sides = counts.groupBy("key").agg(F.max(F.struct("c", "comp")).alias("top"), F.sum("c").alias("all")).where("all > top.c")
    sides = scratch.cut(sides.select("key", F.col("top.comp").alias("major"), F.col("top.c").alias("many"), (F.col("all") - F.col("top.c")).alias("few")))
    return state.join(sides, "key")


def _by_key(batches, compare):
    """Runs ``compare`` on the rows of each (key, i, j), which come together."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(k).to_numpy() for k in range(3)]
        new = np.flatnonzero(np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)]))
        for start, stop in zip(new, np.append(new[1:], batch.num_rows), strict=True):
            key = tuple(k[start] for k in keys)
            if last is not None and key != last:
                yield compare(pa.Table.from_batches(held))
                held = []
            held.append(batch.slice(start, stop - start))
            last = key
    if held:
        yield compare(pa.Table.from_batches(held))


def _sides(table: pa.Table) -> tuple[np.ndarray, np.ndarray, bool]:
    """Row numbers of the first and second side, and whether they are two blocks or the same one."""
    second = table["second"].to_numpy(zero_copy_only=False)
    if table["i"][0].as_py() == table["j"][0].as_py():
        return np.arange(len(second)), np.arange(len(second)), False
    return np.flatnonzero(~second), np.flatnonzero(second), True


def likely(rows: DataFrame, bands: int, per_band: int, least: float, block: int = 2048) -> DataFrame:
    """Of buckets' members (key, band, rep, n, comp, sig and the sides), those (key, rep) that may be ``least`` similar to a
    member of another component with which this is the first common band.

    Components of the signatures that agree estimate the similarity; more than four standard deviations below
    ``least`` is ruled out.
    """
    size = bands * per_band
    need = int(np.floor(size * least - 4 * np.sqrt(size * least * (1 - least))))

    def compare(table: pa.Table) -> pa.RecordBatch:
        rep, n, comp = (table[c].to_numpy() for c in ("rep", "n", "comp"))
        whole = table["sig"].combine_chunks().flatten().to_numpy().reshape(len(rep), bands)
        sig = np.ascontiguousarray(whole).view(np.uint16).reshape(len(rep), bands, 4)[:, :, :per_band].reshape(len(rep), size)
        left, right, apart = _sides(table)
        band, found = table["band"][0].as_py(), np.zeros(len(rep), bool)
        for k in left:
            rest = right if apart else right[right > k]
            rest = rest[(comp[rest] != comp[k]) & (np.minimum(n[rest], n[k]) >= least * np.maximum(n[rest], n[k]))]
            rest = rest[(sig[rest] == sig[k]).sum(axis=1) >= need]
            rest = rest[(whole[rest] == whole[k]).argmax(axis=1) == band]
            found[rest] = True
            found[k] |= len(rest) > 0
        return table.select(["key", "rep"]).filter(pa.array(found)).combine_chunks().to_batches()[0] if found.any() else pa.RecordBatch.from_pylist([], pa.schema([("key", pa.int64()), ("rep", pa.int64())]))

    return across(rows, ["band", "rep", "n", "comp", "sig"], block).mapInArrow(tidy(lambda batches: _by_key(batches, compare)), "key long, rep long").distinct()


def overlaps(rows: DataFrame, least: float, block: int = 256, strip: int = 64) -> DataFrame:
    """Edges (a, b) between members of a bucket (key, rep, n, comp, bag and the sides) in different components whose bags overlap
    by ``least`` or more: enough of them to join all components that have such a pair.

    A bag is a set of 32-bit numbers, one for each run and repetition. Overlaps of a strip of members with a block
    are one product of matrices.
    """

    def compare(table: pa.Table) -> pa.RecordBatch:
        rep, n, comp = (table[c].to_numpy() for c in ("rep", "n", "comp"))
        left, right, apart = _sides(table)
        bag = [np.frombuffer(x, np.uint32) for x in table["bag"].to_pylist()]
        theirs, owner = np.concatenate([bag[k] for k in right]), np.repeat(np.arange(len(right)), [len(bag[k]) for k in right])
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while parent.get(x, x) != x:
                x = parent[x]
            return x

        out = []
        for at in range(0, len(left), strip):
            own = left[at : at + strip]
            words = np.unique(np.concatenate([bag[k] for k in own]))
            place = np.minimum(np.searchsorted(words, theirs), len(words) - 1)
            held = words[place] == theirs
            shared = np.zeros((len(own), len(right)), np.float32)
            for low in range(0, len(words), 4096):
                a, b = (np.zeros((m, min(4096, len(words) - low)), np.float32) for m in (len(own), len(right)))
                for r, k in enumerate(own):
                    c = np.searchsorted(words, bag[k]) - low
                    a[r, c[(c >= 0) & (c < a.shape[1])]] = 1
                c = held & (place >= low) & (place < low + b.shape[1])
                b[owner[c], place[c] - low] = 1
                shared += a @ b.T
            alike = (shared >= least * (n[own][:, None] + n[right][None, :] - shared)) & (comp[own][:, None] != comp[right][None, :])
            for r, q in zip(*np.nonzero(alike), strict=True):
                x, y = find(comp[own[r]]), find(comp[right[q]])
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    out.append((rep[own[r]], rep[right[q]]))
        return pa.RecordBatch.from_arrays([pa.array([x[z] for x in out], pa.int64()) for z in (0, 1)], names=["a", "b"])

    return across(rows, ["rep", "n", "comp", "bag"], block).mapInArrow(tidy(lambda batches: _by_key(batches, compare)), "a long, b long").distinct()


def whole_bags(docs: DataFrame, width: int) -> DataFrame:
    """rep and bag of ``docs`` (id, text)."""

    @tidy
    def run(batches):
        for batch in batches:
            for start, stop in chunks(batch.column(1)):
                g = grid(batch.column(1).slice(start, stop - start))
                doc, runs, times = bags(g, width)
                nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                with np.errstate(over="ignore"):
                    marks = (mix(np.repeat(runs, times) + nth.astype(np.uint64) * _GOLDEN) >> np.uint64(32)).astype(np.uint32)
                cuts = np.searchsorted(np.repeat(doc, times), np.arange(len(g) + 1))
                held = [marks[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, stop - start), pa.array(held, pa.binary())], names=["rep", "bag"])

    return docs.select("id", "text").mapInArrow(run, "rep long, bag binary")


def near_duplicates(
    df: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    *,
    width: int = WIDTH,
    least: float = SIMILARITY,
    bands: int = BANDS,
    rows: int = ROWS,
    keep_all: bool = True,
) -> DataFrame:
    """id, class_id and is_first of every document: classes are the connected components of pairs whose multisets
    of runs of ``width`` words overlap by ``least`` or more; class_id is the least id, and is_first marks it.

    Texts of equal words are one node from the start. In every bucket all members are first compared with the one
    that has the most company over all its buckets, which settles large groups of copies in one comparison each;
    what is left, members of a bucket outside its largest component, is compared with the other components in blocks:
    signatures rule out most, bags of runs decide. With 24 bands of 4 rows a pair at 0.8 shares a bucket with
    probability 0.999996.

    Rows that share an id are one document. A null id has a null class and counts as first; a text without words
    (null, empty, white space) is a class of its own; an empty table gives no rows. ``keep_all`` false leaves out
    the documents that are alone. Other columns are ignored.
    """
    docs = df.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    with Scratch(df.sparkSession) as scratch:
        classes = scratch.keep(scratch.cut(_classes(scratch, df, docs, doc_id, text, width, least, bands, rows)))
    out = docs.select("id").join(classes, "id", "left" if keep_all else "inner").withColumn("class_id", F.coalesce("class_id", "id"))
    return out.select("id", "class_id", F.coalesce(F.col("id") == F.col("class_id"), F.lit(True)).alias("is_first"))


def _classes(scratch: Scratch, df: DataFrame, docs: DataFrame, doc_id: str, text: str, width: int, least: float, bands: int, rows: int) -> DataFrame:
    """id and class_id of the documents that are not alone."""
    cut = scratch.cut
    coded = cut(sketch(df, doc_id, text, width, bands, rows))
    # one node for equal texts; what an aggregate gives is cut before it meets its rows again, so that Spark can split a hot key
    nodes = cut(coded.groupBy("c1", "c2").agg(F.count("*").alias("copies"), F.min(F.struct("id", "n", "sig")).alias("first")).select("c1", "c2", "copies", F.col("first.id").alias("rep"), "first.n", "first.sig"))
    members = cut(coded.select("id", "c1", "c2").join(nodes.where("copies > 1").select("c1", "c2", "rep"), ["c1", "c2"]).select("id", "rep").distinct())
    scratch.drop(coded)

    buckets = nodes.select("rep", "n", F.posexplode("sig").alias("band", "value")).select("rep", "n", "band", F.xxhash64("band", "value").alias("key"))
    sizes = cut(buckets.groupBy("key").agg(F.count("*").alias("all"), F.min("rep").alias("x"), F.max("rep").alias("y")).where("x <> y").select("key", "all"))
    shared = cut(buckets.join(sizes, "key").select("key", "band", "rep", "n", "all"))
    company = cut(shared.groupBy("rep").agg(F.sum("all").alias("company")))
    heads = cut(shared.join(company, "rep").groupBy("key").agg(F.max(F.struct("company", (-F.col("rep")).alias("rep"), "n")).alias("head")))
    stars = shared.join(heads, "key").select(F.col("rep").alias("a"), (-F.col("head.rep")).alias("b"), F.col("n").alias("na"), F.col("head.n").alias("nb"))
    stars = cut(stars.where((F.col("a") != F.col("b")) & (F.least("na", "nb") >= least * F.greatest("na", "nb"))).select("a", "b").distinct())
    edges = cut(verify(scratch, stars, docs, width, least))
    scratch.drop(sizes, company, heads, stars)

    # buckets of two are settled; elsewhere members of different components are still to be compared
    labels = cut(components(scratch, edges))
    state = cut(shared.where("all > 2").join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep")))
    scratch.drop(shared, labels)
    mixed = cut(split_sides(scratch, state))
    rest = mixed.join(nodes.select("rep", "sig"), "rep")
    left = cut(likely(rest, bands, rows, least).join(state.select("key", "rep", "n", "comp"), ["key", "rep"]))
    scratch.drop(nodes, mixed, state)
    wanted = cut(left.select(F.col("rep").alias("id")).distinct())
    bagged = whole_bags(holding(docs, "id", wanted, "id").join(wanted, "id", "left_semi"), width)
    more = cut(overlaps(split_sides(scratch, left).join(bagged, "rep"), least))
    labels = components(scratch, edges.unionAll(more))

    classes = members.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("id", F.coalesce("comp", "rep").alias("class_id"))
    return classes.unionAll(labels.select(F.col("node").alias("id"), F.col("comp").alias("class_id"))).groupBy("id").agg(F.min("class_id").alias("class_id"))
