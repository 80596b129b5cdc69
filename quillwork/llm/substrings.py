"""Near-duplicate passages by compact windows (operator 6).

Tokens are runs of five words. For each of a few hash functions, the Cartesian tree over a text's token hashes
gives compact windows (l, p, r): every stretch that starts in l..p and ends in p..r has its min-hash at p. Only
windows of at least a passage's length are kept, about 2 n / length of them. Windows of equal min-hash meet their
bucket's first document; documents whose windows meet the same first document for enough hash functions, over one
stretch, are compared with it word for word, and what repeats there is marked. Windows with words that this leaves
unmarked are compared with the others of their bucket by the tokens around the min-hash; pairs that share enough of
them, an unmarked one among them, are compared word for word as well. A window all of whose tokens stand in one
earlier document needs no comparison: that document is in the bucket. The first occurrence stays.

Equal texts are one document from the start: every later one repeats the first as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrowtext import chunks, fresh, grid, mix, shingles, tidy
from .heads import against_heads, slices
from .minhash import _blocks
from .storage import Scratch, holding, split

#: Runs that overlap by 0.8 agree in one of eight functions with probability 0.999997: so often they share a bucket. Four must
#: agree for a first look at the bucket's first document; what that leaves unmarked is compared with the rest of the bucket.
WIDTH, HASHES, AGREE, WORDS, SIMILARITY = 5, 8, 4, 50, 0.8
#: Bits of the filter that keeps most windows without a partner out of the shuffle, 4 MB whatever the input.
KEY_BITS = 25
#: Members of a bucket that one task compares pair by pair; some 2 MB of tokens.
BLOCK = 8192
SPAN = "struct<start:int,end:int,source:long>"
#: Stands for a null id: the last of all.
NULL_ID = (1 << 63) - 1


def least_of_stretches(values: np.ndarray, length: int) -> np.ndarray:
    """The least of every ``length`` neighbouring values, from the least of 2, 4, 8, ... neighbours."""
    span, out = 1, values
    while 2 * span <= length:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    return np.minimum(out[: len(values) - length + 1], out[length - span :])


def next_smaller(keys: np.ndarray, alone: np.ndarray) -> np.ndarray:
    """For each key the place of the nearest smaller one before it in its text, plus 1; 0 if there is none. ``alone`` marks the
    first key of each text. Whatever lies between a key and the place it points to is larger, so all keys can jump on
    from there at once."""
    to = np.where(alone, 0, np.arange(len(keys)))
    padded = np.concatenate([[np.uint64(0)], keys])
    active = np.flatnonzero(padded[to] > keys)
    own, at = keys[active], to[active]
    while len(active):
        to[active] = at = to[at - 1]
        more = padded[at] > own
        active, own, at = active[more], own[more], at[more]
    return to


def least_tokens(values: np.ndarray, first: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the least tokens of all stretches of ``least`` tokens, and ``values`` made different by place; ``first`` bounds
    the texts in ``values``. The leftmost of equal tokens is the least."""
    n = len(values)
    if n < least:
        return np.zeros(0, np.int64), values
    low = np.uint64((1 << n.bit_length()) - 1)
    keyed = values & ~low | np.arange(n, dtype=np.uint64)
    least_of = least_of_stretches(keyed, least)
    # stretches that reach into the next text do not count
    whole = np.zeros(len(least_of) + 1, np.int8)
    long = np.flatnonzero(np.diff(first) >= least)
    np.add.at(whole, first[long], 1)
    np.add.at(whole, first[long + 1] - least + 1, -1)
    new = np.ones(len(least_of), bool)
    new[1:] = least_of[1:] != least_of[:-1]
    new[first[long]] = True
    new &= np.cumsum(whole[:-1], dtype=np.int8).astype(bool)
    return (least_of[new] & low).astype(np.int64), keyed  # a least token stands nowhere before that of an earlier stretch


def compact_windows(values: np.ndarray, first: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """l, p and the end r + 1 of all windows of ``least`` tokens or more.

    Only the least tokens of stretches of ``least`` tokens have such windows, and the tokens that bound a window, its
    parents in the Cartesian tree, have one themselves or end the text: so the trees are built over these few.
    """
    at, keyed = least_tokens(values, first, least)
    if not len(at):
        return at, at, at
    text = np.searchsorted(first, at, side="right") - 1
    keys, starts = keyed[at], np.concatenate([[True], text[1:] != text[:-1]])
    before = next_smaller(keys, starts)
    after = next_smaller(keys[::-1], np.concatenate([starts[1:], [True]])[::-1])[::-1]
    left = np.where(before > 0, at[before - 1] + 1, first[text])
    right = np.where(after > 0, at[np.minimum(len(at) - after, len(at) - 1)], first[text + 1])
    return left, at, right


def hashed(values: np.ndarray, fn: int) -> np.ndarray:
    """The order of tokens that hash function ``fn`` takes: a multiplication by an odd number of its own."""
    return values * (mix(np.array([fn + 1], np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1))


def keys_of(own: np.ndarray, fn: np.ndarray | int) -> np.ndarray:
    """Bucket numbers of min-hashes."""
    return mix(own + np.asarray(fn).astype(np.uint64)).view(np.int64)


def windows(docs: DataFrame, width: int, hashes: int, tokens: int, bounds: bool = True) -> DataFrame:
    """id, key, window and place of the compact windows of ``docs`` (id, text); without ``bounds``, id and key alone.

    ``window`` packs the start (28 bits), the length (28) and the hash function (7); ``key`` also tells functions apart;
    ``place`` is where the least token stands.
    """

    @tidy
    def run(batches):
        for batch in batches:
            ids = batch.column(0).fill_null(NULL_ID).to_numpy()
            for start, stop in chunks(batch.column(1)):
                g = grid(batch.column(1).slice(start, stop - start))
                values, at = shingles(g.words(), g.doc, width)
                doc = g.doc[at]
                first = np.searchsorted(doc, np.arange(len(g) + 1))
                made = []
                for fn in range(hashes):
                    own = hashed(values, fn)
                    if not bounds:
                        p, _ = least_tokens(own, first, tokens)
                        made.append((ids[start + doc[p]], keys_of(own[p], fn)))
                        continue
                    l, p, r = compact_windows(own, first, tokens)
                    d = doc[p]
                    made.append((ids[start + d], keys_of(own[p], fn), (l - first[d]) << 35 | (r - l) << 7 | fn, (p - first[d]).astype(np.int32)))
                columns = [pa.array(np.concatenate(x)) for x in zip(*made, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "key", "window", "place"][: len(columns)])

    return docs.select("id", "text").mapInArrow(run, "id long, key long, window long, place int" if bounds else "id long, key long")


def share_stretch(pair: np.ndarray, window: np.ndarray, hashes: int, agree: int, tokens: int) -> np.ndarray:
    """Which windows start a stretch of ``tokens`` tokens that windows of ``agree`` hash functions of their pair share.

    By start, each window asks of every function how far its earlier windows reach.
    """
    by = np.lexsort((window, pair))
    start = window[by] >> 35
    end, fn = start + (window[by] >> 7 & ((1 << 28) - 1)), window[by] & 127
    base = np.cumsum(np.concatenate([[False], pair[by][1:] != pair[by][:-1]])) << 32
    n = np.zeros(len(by), np.int64)
    for f in range(hashes):
        n += np.maximum.accumulate(np.where(fn == f, base + end, 0)) >= base + start + tokens
    out = np.zeros(len(by), bool)
    out[by] = n >= agree
    return out


def agreeing(links: DataFrame, hashes: int, agree: int, tokens: int) -> DataFrame:
    """Pairs (id, head) for which windows of ``agree`` hash functions share a stretch of ``tokens`` tokens."""
    seen = F.expr("bit_count(bit_or(shiftleft(1, cast(window & 127 as int))))")
    pairs = links.groupBy("id", "head").agg(seen.alias("fns"), F.collect_list("window").alias("windows")).where(F.col("fns") >= agree)

    @tidy
    def run(batches):
        for batch in batches:
            lists = batch.column(2)
            pair = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())
            found = np.zeros(len(lists), bool)
            found[pair[share_stretch(pair, lists.flatten().to_numpy(), hashes, agree, tokens)]] = True
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["id", "head"]).filter(pa.array(found))

    return pairs.select("id", "head", "windows").mapInArrow(run, "id long, head long")


def passages(own: np.ndarray, other: np.ndarray, width: int, words: int, least: float, gap: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Word spans of ``own`` tokens that occur in ``other``, over gaps of up to ``gap`` tokens as long as ``least`` of the span
    occurs; and the runs of tokens without a gap among them that are as long as a passage."""
    found = np.zeros(len(own) + 2, bool)  # ``other`` is sorted
    if len(other):
        found[1:-1] = other[np.minimum(np.searchsorted(other, own), len(other) - 1)] == own
    starts, ends = np.flatnonzero(found[1:] & ~found[:-1]), np.flatnonzero(found[:-1] & ~found[1:])
    out: list[list[int]] = []
    for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
        if out and s - out[-1][1] <= gap and out[-1][2] + e - s >= least * (e - out[-1][0]):
            out[-1][1:] = [e, out[-1][2] + e - s]
        else:
            out.append([s, e, e - s])
    exact = [(s, e) for s, e in zip(starts.tolist(), ends.tolist(), strict=True) if e - s + width - 1 >= words]
    return [(s, e + width - 1) for s, e, _ in out if e - s + width - 1 >= words], exact


def around(wanted: DataFrame, known: DataFrame, docs: DataFrame, width: int, reach: int) -> DataFrame:
    """key, all, rep, open and bag of ``wanted`` (id, key, window, place, open, all): the tokens of the window at most ``reach``
    from the place. Of a number in ``bag``, 31 bits are the token and the last tells whether a word of it is outside the
    spans of ``known`` (id, spans).

    A document of several texts gives the windows of each.
    """
    listed = wanted.groupBy("id").agg(F.collect_list(F.struct("key", "window", "place", "open", "all")).alias("windows")).join(known.select("id", "spans"), "id", "left")
    texts = holding(docs, "id", wanted.select("id"), "id").select("id", "text").join(listed, "id").select("id", "text", "spans", "windows")

    @tidy
    def run(batches):
        for batch in batches:
            for start, stop in chunks(batch.column(1)):
                part = batch.slice(start, stop - start)
                g = grid(part.column(1))
                values, at = shingles(g.words(), g.doc, width)
                first = np.searchsorted(g.doc[at], np.arange(len(g) + 1))
                unmarked = np.ones(len(values), bool)
                for d, spans in enumerate(part.column(2).to_pylist()):
                    for s in spans or ():
                        unmarked[first[d] + s["start"] : max(first[d] + s["start"], min(first[d] + s["end"] - width + 1, first[d + 1]))] = False
                lists = part.column(3)
                flat = lists.flatten()
                key, window, place, open_, all_ = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(5))
                doc = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())
                p, left = first[doc] + place, first[doc] + (window >> 35)
                right = left + (window >> 7 & ((1 << 28) - 1))
                mine = np.flatnonzero(right <= first[doc + 1])
                own = np.zeros(len(p), np.int64)
                for fn in np.unique(window & 127):
                    k = mine[(window[mine] & 127) == fn]
                    own[k] = keys_of(hashed(values[p[k]], int(fn)), int(fn))
                kept = mine[own[mine] == key[mine]]
                low, high = np.maximum(p[kept] - reach, left[kept]), np.minimum(p[kept] + reach + 1, right[kept])
                marks = ((values >> np.uint64(33)).astype(np.uint32) << np.uint32(1)) | unmarked
                held = [marks[i:j].tobytes() for i, j in zip(low.tolist(), high.tolist(), strict=True)]
                ids = part.column(0).take(pa.array(doc[kept]))
                yield pa.RecordBatch.from_arrays([pa.array(key[kept]), pa.array(all_[kept]), ids, pa.array(open_[kept]), pa.array(held, pa.binary())], names=["key", "all", "rep", "open", "bag"])

    return texts.mapInArrow(run, "key long, all long, rep long, open boolean, bag binary")


def sharing(scratch: Scratch, rows: DataFrame, need: int) -> DataFrame:
    """``rows`` (key, rep, open, bag) with the tokens left out that no other document of the bucket has, without those that
    have too few left to meet another one. For buckets too large to be compared pair by pair at once: each window is
    spread out into its tokens, so the work grows with the windows, and a line that all of a bucket share
    brings nobody together. An open window may repeat a token; as often as one can be repeated (``most``) may a token of the others count."""
    rows = scratch.cut(rows.select("key", "rep", "open", "bag").withColumn("no", F.xxhash64("key", "rep", "bag")))

    @tidy
    def tokens(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                bag = [np.frombuffer(x, np.uint32) for x in part.column(3).to_pylist()]
                owner = np.repeat(np.arange(len(bag)), [len(x) for x in bag])
                flat = np.concatenate(bag) if bag else np.zeros(0, np.uint32)
                yield pa.RecordBatch.from_arrays([part.column(k).take(pa.array(owner)) for k in range(3)] + [pa.array((flat >> 1).astype(np.int32)), pa.array(flat & 1 == 1)], names=["key", "rep", "no", "token", "fresh"])

    spread = rows.select("key", "rep", "no", "bag").mapInArrow(tokens, "key long, rep long, no long, token int, fresh boolean")
    common = scratch.cut(spread.groupBy("key", "token").agg(F.min("rep").alias("x"), F.max("rep").alias("y")).where("x <> y").select("key", "token"))
    left = spread.join(common, ["key", "token"]).groupBy("key", "rep", "no").agg(F.collect_list(F.col("token").cast("long") * 2 + F.col("fresh").cast("int")).alias("held"), F.max("fresh").alias("fresh"))
    left = left.join(rows.select("key", "rep", "no", "open").distinct(), ["key", "rep", "no"]).withColumn("open", F.col("open") & F.col("fresh") & (F.size("held") >= need))
    left = scratch.cut(left.withColumn("n", F.size(F.array_distinct("held"))))
    most = scratch.cut(left.where("open").groupBy("key").agg(F.max(F.size("held") - F.col("n") + 1).alias("most")))
    left = left.join(most, "key").where(F.col("open") | (F.col("n") * F.col("most") >= need))

    @tidy
    def packed(batches):
        for batch in batches:
            held = [np.array(x, np.int64).astype(np.uint32).tobytes() for x in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(held, pa.binary())], names=["key", "rep", "open", "bag"])

    return left.select("key", "rep", "open", "held").mapInArrow(packed, "key long, rep long, open boolean, bag binary")


def meeting(rows: DataFrame, need: int, block: int = BLOCK, strip: int = 64) -> DataFrame:
    """Pairs (id, head) of documents in a bucket (key, rep, open, all, bag) where the earlier one, the head, has
    ``need`` tokens of the other one, which is open, and an unmarked one among them.

    Of the documents that an open one meets in a block, so many are named that they hold together all tokens it shares
    with any of them; documents of the same shared tokens are compared by the first of them. So a large group of
    copies gives one pair for each.
    """

    def promising(table: pa.Table) -> tuple[np.ndarray, ...]:
        """For all groups of rows (key, i, j) at once: of each row its group and whether it takes part and seeks, then owner,
        token and flag of the tokens that bring somebody together: those of several documents of a group."""
        rep, open_ = table["rep"].to_numpy(), table["open"].to_numpy(zero_copy_only=False)
        ends = [table[c].to_numpy() for c in ("key", "i", "j")]
        group = np.cumsum(np.concatenate([[False], np.any([k[1:] != k[:-1] for k in ends], axis=0)]))
        bag = table["bag"].combine_chunks()
        owner = np.repeat(np.arange(len(rep)), pc.binary_length(bag).to_numpy() // 4)
        flat = np.frombuffer(b"".join(bag.to_pylist()), np.uint32)
        code = group[owner].astype(np.uint64) << np.uint64(31) | (flat >> 1).astype(np.uint64)
        by = np.argsort(code, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], code[by][1:] != code[by][:-1]])) if len(code) else np.zeros(0, np.int64)
        held = rep[owner[by]]
        several = np.minimum.reduceat(held, first) < np.maximum.reduceat(held, first) if len(first) else np.zeros(0, bool)
        common = np.zeros(len(code), bool)
        common[by] = np.repeat(several, np.diff(np.append(first, len(code))))
        owner, flat = owner[common], flat[common]
        many = np.bincount(owner, minlength=len(rep))
        seeking = open_ & (many >= need) & (np.bincount(owner[flat & 1 == 1], minlength=len(rep)) > 0)
        different = np.bincount((np.unique(owner.astype(np.uint64) << np.uint64(31) | (flat >> 1)) >> np.uint64(31)).astype(np.int64), minlength=len(rep))
        # an open window may repeat a token, as often as its tokens are more than different ones
        most = np.zeros(group[-1] + 1, np.int64)
        np.maximum.at(most, group[seeking], (many - different)[seeking] + 1)
        return group, seeking | (different * most[group] >= need), seeking, owner, flat

    @tidy
    def compare(batches):
        for table in _whole_keys(batches):
            group, enough, seeking, owner, flat = promising(table)
            use = enough[owner]
            owner, flat = owner[use], flat[use]
            cuts = np.searchsorted(owner, np.arange(len(group) + 1))
            bounds = np.searchsorted(group, np.arange(group[-1] + 2))
            sides = [table[c].to_numpy(zero_copy_only=False) for c in ("rep", "second")] + [table[c].to_numpy() for c in ("i", "j")]
            for g in np.unique(group[seeking]):
                low, high = bounds[g], bounds[g + 1]
                tokens = slice(cuts[low], cuts[high])
                yield within(*(x[low:high] for x in sides), seeking[low:high], enough[low:high], owner[tokens] - low, flat[tokens])

    def within(rep, second, i, j, seeking, enough, owner, flat) -> pa.RecordBatch:
        """The pairs of one group."""
        left, right, apart = (np.flatnonzero(~second), np.flatnonzero(second), True) if i[0] != j[0] else (np.arange(len(rep)), np.arange(len(rep)), False)
        fresh_ = flat & 1 == 1
        _, word = np.unique(flat >> 1, return_inverse=True)
        cuts = np.searchsorted(owner, np.arange(len(rep) + 1))
        out: set[tuple[int, int]] = set()
        same: dict[bytes, int] = {}
        alone = np.zeros(len(rep), bool)
        for k in np.argsort(rep, kind="stable"):
            if enough[k]:
                first = same.setdefault(word[cuts[k] : cuts[k + 1]].tobytes(), k)
                alone[k] = first == k
                if first != k and seeking[k] and rep[first] != rep[k]:
                    out.add((int(rep[k]), int(rep[first])))
        for own, others in [(left, right), (right, left)][: 1 + apart]:
            own, others = own[alone[own] & seeking[own]], others[alone[others]]
            if not len(others):
                continue
            theirs = np.concatenate([word[cuts[k] : cuts[k + 1]] for k in others])
            whose = np.repeat(np.arange(len(others)), [cuts[k + 1] - cuts[k] for k in others])
            for at in range(0, len(own), strip):
                some = own[at : at + strip]
                words = np.unique(np.concatenate([word[cuts[k] : cuts[k + 1]] for k in some]))
                place = np.minimum(np.searchsorted(words, theirs), len(words) - 1)
                hit = words[place] == theirs
                n = np.bincount(whose[hit], minlength=len(others))
                met = np.flatnonzero(n > 0)
                if not len(met):
                    continue
                row = np.full(len(others), -1)
                row[met] = np.arange(len(met))
                held = np.zeros((len(met), len(words)), np.float32)
                held[row[whose[hit]], place[hit]] = 1
                often, news = (np.zeros((len(some), len(words)), np.float32) for _ in range(2))
                for r, k in enumerate(some):
                    c = np.searchsorted(words, word[cuts[k] : cuts[k + 1]])
                    np.add.at(often[r], c, 1)
                    news[r, c[fresh_[cuts[k] : cuts[k + 1]]]] = 1
                fits = (often @ held.T >= need) & (news @ held.T > 0) & (rep[others[met]][None, :] < rep[some][:, None])
                for r in np.flatnonzero(fits.any(axis=1)):
                    which = np.flatnonzero(fits[r])
                    which = which[np.argsort(rep[others[met[which]]], kind="stable")]
                    todo = (often[r] > 0).astype(np.float32)
                    while True:
                        gain = held[which] @ todo
                        best = int(gain.argmax())
                        if not gain[best]:
                            break
                        out.add((int(rep[some[r]]), int(rep[others[met[which[best]]]])))
                        todo[held[which[best]] > 0] = 0
        return pa.RecordBatch.from_arrays([pa.array([x[z] for x in out], pa.int64()) for z in (0, 1)], names=["id", "head"])

    return _blocks(rows, ["rep", "open", "bag"], block).mapInArrow(compare, "id long, head long").distinct()


def _whole_keys(batches: Iterator[pa.RecordBatch], rows: int = 4096) -> Iterator[pa.Table]:
    """The rows of sorted batches in tables of about ``rows`` rows, or of one group (key, i, j) that is larger."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        while batch.num_rows:
            if n < rows:
                take = min(rows - n, batch.num_rows)
            else:  # up to the next group
                last = [held[-1].column(k)[-1].as_py() for k in range(3)]
                other = np.flatnonzero(np.any([batch.column(k).to_numpy() != last[k] for k in range(3)], axis=0))
                take = int(other[0]) if len(other) else batch.num_rows
            if take:
                held.append(batch.slice(0, take))
                n += take
                batch = batch.slice(take)
            elif n:
                yield pa.Table.from_batches(held)
                held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def _merged(spans: Column) -> Column:
    """Overlapping or touching spans as one; the lowest source stays."""

    def add(done: Column, span: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], span["end"]).alias("end"), F.least(last["source"], span["source"]).alias("source"))
        return F.when((F.size(done) > 0) & (F.get(done, F.size(done) - 1)["end"] >= span["start"]), F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(done, F.array(span)))

    return F.aggregate(F.array_sort(spans), F.array().cast(f"array<{SPAN}>"), add)


def repeated_passages(
    df: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    *,
    words: int = WORDS,
    width: int = WIDTH,
    hashes: int = HASHES,
    agree: int = AGREE,
    least: float = SIMILARITY,
    gap: int = 10,
    block: int = BLOCK,
) -> DataFrame:
    """id, row and ``spans`` of the documents that repeat passages of an earlier one.

    ``row`` is ``xxhash64(doc_id, text)``. Spans run from word ``start`` to before word ``end`` and name the lowest
    ``source`` document they were matched with; documents go by id, nulls last. A passage has at least ``words``
    words, and ``least`` of its runs of ``width`` words occur in the source. Rows of one id are one document, so they
    do not repeat each other; null and short texts have no passages; an empty table gives no rows.
    """
    id_ = F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(NULL_ID))
    docs = df.select(F.xxhash64(F.col(f"`{doc_id}`"), F.col(f"`{text}`")).alias("row"), id_.alias("id"), F.col(f"`{text}`").alias("text")).where("text is not null")
    with Scratch(df.sparkSession) as scratch:
        cut = scratch.cut
        same = docs.select("row", "id", F.xxhash64("text").alias("h"), F.xxhash64(F.lit(1), "text").alias("g"))
        firsts = cut(same.groupBy("h", "g").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first <> last").select("h", "g", "first"))
        copies = cut(same.join(firsts, ["h", "g"]).where("id <> first").select("row", "id", "first").distinct())
        may, others = split(docs, "id", copies, "id")
        single = may.join(copies, ["row", "id"], "left_anti").select(*docs.columns).unionAll(others)
        n = F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
        whole = may.join(copies, ["row", "id"]).select("id", "row", F.array(F.struct(F.lit(0).alias("start"), n.alias("end"), F.col("first").alias("source"))).cast(f"array<{SPAN}>").alias("spans"))
        whole = cut(whole.where(F.col("spans")[0]["end"] >= words))
        found = _found(scratch, single, words, width, hashes, agree, least, gap, block)
        return scratch.keep(cut(found.unionAll(whole).groupBy("id", "row").agg(F.flatten(F.collect_set("spans")).alias("spans")).select("id", "row", _merged(F.col("spans")).alias("spans"))))


def _found(scratch: Scratch, docs: DataFrame, words: int, width: int, hashes: int, agree: int, least: float, gap: int, block: int) -> DataFrame:
    """id, row and spans of passages in ``docs`` (row, id, text), all of them different texts."""
    tokens, cut = words - width + 1, scratch.cut
    cuts = windows(docs, width, hashes, tokens)
    heads = cut(windows(docs, width, hashes, tokens, bounds=False).groupBy("key").agg(F.min("id").alias("head"), F.max("id").alias("last")).where("head <> last").select("key", "head"))
    shared = cut(holding(cuts, "key", heads, "key", KEY_BITS).join(heads, "key"))
    scratch.drop(heads)
    pairs = cut(agreeing(shared.where("id <> head"), hashes, agree, tokens))

    def compare(own, other):
        if len(other) == 1:  # a head, sorted when it is first compared
            other.append(np.unique(other[0]))
        spans, exact = passages(own[0], other[1], width, words, least, gap)
        runs = lambda found: [{"start": s, "end": e} for s, e in found]
        return {"spans": runs(spans), "exact": runs(exact)} if spans else None

    def prepare(texts):
        g = grid(texts)
        values, at = shingles(g.words(), g.doc, width)
        return [list(x) for x in slices(g.doc[at], len(texts), values)]

    def verify(some):
        return against_heads(scratch, some, docs, prepare, compare, ["spans", "exact"])

    first = cut(verify(pairs))
    single = docs.groupBy("id").agg(F.min("row").alias("row"), F.max("row").alias("other")).where("row = other").select("id", "row")  # spans of an id with several texts settle nothing
    lists = first.groupBy("id", "row").agg(F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_distinct(F.flatten(F.collect_list("exact"))).alias("exact"))
    known = lists.join(single, ["id", "row"]).select("id", "exact", F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(0).cast("long").alias("source"))).alias("spans"))
    known = cut(known.select("id", "exact", _merged(F.col("spans")).alias("spans")))
    rest = unsettled(scratch, shared, known, pairs, width, tokens)
    scratch.drop(shared)
    near = cut(around(rest, known, docs, width, tokens - 1))
    scratch.drop(rest, known)
    need = int(least * tokens)
    hot = cut(sharing(scratch, near.where(F.col("all") > block).drop("all"), need))
    again = cut(hot.groupBy("key").agg(F.count("*").alias("all")))
    more = meeting(near.where(F.col("all") <= block), need, block).unionAll(meeting(hot.join(again, "key"), need, block)).distinct()
    more = cut(more.join(pairs, ["id", "head"], "left_anti"))
    scratch.drop(near, hot, again, pairs)
    second = cut(verify(more))
    return first.unionAll(second).select("id", "row", F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.col("head").alias("source"))).alias("spans"))


def unsettled(scratch: Scratch, shared: DataFrame, known: DataFrame, pairs: DataFrame, width: int, tokens: int) -> DataFrame:
    """id, key, window, place, ``open`` and ``all`` of the windows in ``shared`` (id, key, window, place) that are still to be
    compared: those of buckets that have an open one after another document's; ``all`` counts a bucket's unsettled ones.

    A window is settled if all its tokens at most ``tokens`` - 1 from its place are in one of the exact runs of ``known`` (id,
    spans, exact), so in one earlier document; else it is open if one of these tokens has a word outside the spans.
    Buckets of two documents that were compared are left out.
    """

    def within(lists: pa.ListArray, doc: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Which of the ranges lie in a run of their document's list: how far do the runs reach that start before it?"""
        flat = lists.flatten()
        owner = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)).astype(np.int64) << 32
        if not len(owner):
            return np.zeros(len(low), bool)
        start, end = (owner + flat.field(k).to_numpy(zero_copy_only=False) for k in ("start", "end"))
        by = np.argsort(start, kind="stable")
        reach = np.maximum.accumulate(end[by])
        at = np.searchsorted(start[by], (doc << 32) + low, side="right") - 1
        return (at >= 0) & (reach[at] >= (doc << 32) + high)

    @tidy
    def settle(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                lists = part.column(1)
                doc = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy()).astype(np.int64)
                key, window, place = (lists.flatten().field(k).to_numpy() for k in range(3))
                start = window >> 35
                low = np.maximum(start, place.astype(np.int64) - tokens + 1)
                high = np.minimum(start + (window >> 7 & ((1 << 28) - 1)), place.astype(np.int64) + tokens)
                left = np.flatnonzero(~within(part.column(3), doc, low, high))
                open_ = ~within(part.column(2), doc[left], low[left], high[left] + width - 1)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(doc[left])), *(pa.array(x[left]) for x in (key, window, place)), pa.array(open_)], names=["id", "key", "window", "place", "open"])

    # a document's windows and runs come together once, however many windows it has
    listed = shared.groupBy("id").agg(F.collect_list(F.struct("key", "window", "place")).alias("windows")).join(known, "id", "left")
    state = scratch.cut(listed.select("id", "windows", "spans", "exact").mapInArrow(settle, "id long, key long, window long, place int, open boolean"))
    buckets = state.groupBy("key").agg(F.min("id").alias("least"), F.max(F.when(F.col("open"), F.col("id"))).alias("last"), F.count("*").alias("all")).where("last > least")
    done = pairs.select(F.col("id").alias("last"), F.col("head").alias("least"), F.lit(True).alias("done"))
    held = scratch.cut(buckets.join(done, ["last", "least"], "left").where("not (all = 2 and done is not null)").select("key", "last", "all"))
    rows = scratch.cut(state.join(held, "key").where("id <= last").drop("last"))
    scratch.drop(state)
    return rows


def mark(df: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``df`` with ``spans`` (an empty array where nothing repeats); a column of that name is replaced."""
    row, id_ = fresh(df, "_row"), fresh(df, "_id")
    kept = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() != "spans"])
    kept = kept.withColumn(row, F.xxhash64(F.col(f"`{doc_id}`"), F.col(f"`{text}`"))).withColumn(id_, F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(NULL_ID)))
    found = repeated_passages(df, doc_id, text, **options).withColumnsRenamed({"row": row, "id": id_})
    none = F.array().cast(f"array<{SPAN}>")
    may, cannot = split(kept, row, found, row)
    # by id and hash, so that texts whose hashes collide do not share spans
    return may.join(found, [row, id_], "left").withColumn("spans", F.coalesce("spans", none)).drop(row, id_).unionByName(cannot.withColumn("spans", none).drop(row, id_))


def remove(marked: DataFrame, text: str = "text") -> DataFrame:
    """``marked`` with the words of ``spans`` cut out of the text, each with the white space up to the next word."""
    names = marked.columns

    @tidy
    def run(batches):
        for batch in batches:
            for start, stop in chunks(batch.column(names.index(text))):
                part = batch.slice(start, stop - start)
                column, spans = part.column(names.index(text)), part.column(names.index("spans")).to_pylist()
                out = column.to_pylist()
                for d in [d for d, s in enumerate(spans) if s]:
                    g = grid(column.slice(d, 1))
                    raw, left, at = g.data.tobytes(), [], 0
                    for s in spans[d]:
                        left.append(raw[at : g.starts[s["start"]]])
                        at = g.starts[s["end"]] if s["end"] < len(g.starts) else len(raw)
                    out[d] = b"".join([*left, raw[at:]]).decode()
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if c == text else part.column(k) for k, c in enumerate(names)], names=names)

    return marked.mapInArrow(run, marked.schema)
