"""N-gram Jaccard self-join: which documents' shingle sets are similar, and the classes that such links make.

Method: prefix-tree join. Sets are ordered globally, rarest shingle first, and
stored in a trie; a probe walks the trie once for all sets below a node,
sharing their partial overlaps, and leaves a subtree as soon as the lengths
that remain can no longer reach the threshold.

How the corpus gets there, exactly and without any pair table of a whole group:

1. Of each set only a sample prefix in hash order is counted over the corpus,
   long enough that linked sets share at least ``_shared`` of it.
2. Within it, ordered by document frequency, linked sets share ``_seen`` of an
   index prefix of the rarest entries (twice the prefix-filter principle).
3. Sets equal to one with a smaller id stand back; they rejoin at the end.
4. Entries of at most GROUP sets give pairs, counted and kept if they share
   enough entries. Sets with a more frequent one go through 1 and 2 again among
   themselves, with their whole sets counted: what is frequent then, comes last
   in its set, and only entries frequent in spite of that give a star around one
   member instead of pairs. Texts that share a passage of less than about 3/4 of
   their shingles aren't thrown together by it.
5. Candidate components that come of it are joined with the trie; each task
   emits only a spanning forest of true links. Large components are first held
   against a few of their members (hubs), part by part; then only blocks of sets
   that aren't in one class by now are joined, pair of blocks by pair of blocks.
   A class of m near-copies so takes about m comparisons, not m * m.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshwright.operators.components import connected_components
from meshwright.plans.recovery import written

from . import census
from .columns import Columns
from .sizing import parts
from .words import U64, avalanche, planes, ragged, shingle_sets, slices, text_buffers, unplanes

SHINGLE = 5
#: A link: 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Sets that share an index entry, up to which pairs are emitted.
GROUP = 24
#: Sets and shingles to a block of a large candidate component; members that all of it are held against first.
BLOCK, BLOCK_SHINGLES, HUBS = 256, 1 << 18, 8
#: Sets that hold an entry, from which on its range is salted.
HOT = 1 << 20
SLICE = 1 << 20
#: Trie segments are no longer than this, so that a walk can leave a long one.
SEGMENT = 64


def _least(n: np.ndarray) -> np.ndarray:
    """The smallest size of a set, or intersection, linked with a set of n."""
    return -(-n * PERCENT // 100)


def _shared(n: np.ndarray) -> np.ndarray:
    return np.maximum(1, n * 3 // 10)


def _seen(n: np.ndarray) -> np.ndarray:
    return np.maximum(1, n * 6 // 100)


def _prefix(n: np.ndarray) -> np.ndarray:
    """Length of the sample prefix: of two linked sets, the prefixes share ``_shared`` of the smaller set at least."""
    return np.where(n > 0, n - _least(n) + _shared(n), 0)


def _index(n: np.ndarray) -> np.ndarray:
    """Length of the index prefix: of two linked sets, the index prefixes share ``_seen`` of the smaller set at least."""
    return np.where(n > 0, _prefix(n) - _shared(_least(n)) + _seen(n), 0)


def _whole_index(n: np.ndarray) -> np.ndarray:
    """The same where whole sets are counted."""
    return np.where(n > 0, n - _least(n) + _seen(n), 0)


def _sets(column) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    raw, off = text_buffers(column)
    for i, j in slices(off, SLICE):
        yield shingle_sets(raw[off[i] : off[j]], off[i : j + 1] - off[i], SHINGLE)


def _sampled(grams: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sample prefix of each set, in place order, and the set of each entry."""
    n = np.diff(bounds)
    row = np.repeat(np.arange(len(n)), n)
    rank = np.arange(len(grams)) - bounds[:-1][row]
    keep = rank < _prefix(n)[row]
    return grams[keep], row[keep]


def _counted(grams: np.ndarray, bounds: np.ndarray, whole: bool) -> tuple[np.ndarray, np.ndarray]:
    """The entries of each set that the corpus is searched for, and the set of each."""
    return (grams, np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))) if whole else _sampled(grams, bounds)


def _trie(seqs: list[np.ndarray], sizes: np.ndarray) -> dict[str, np.ndarray]:
    """A path-compressed trie over sequences in lexicographic order, as arrays; nodes of one depth are consecutive."""
    m = len(seqs)
    lcp = np.zeros(m + 1, np.int64)
    for i in range(1, m):
        a, b = seqs[i - 1], seqs[i]
        k = min(len(a), len(b))
        diff = np.flatnonzero(a[:k] != b[:k])
        lcp[i] = diff[0] if len(diff) else k
    lens = np.array([len(s) for s in seqs])
    level = [(0, m, 0, -1)]  # documents [a, b) share the path up to a depth; parent node
    nodes: list[tuple] = []
    while level:
        after = []
        for a, b, depth, parent in level:
            end = int(lens[a]) if b - a == 1 else int(min(lcp[a + 1 : b].min(), lens[a]))
            stop = min(end, depth + SEGMENT)
            me = len(nodes)
            nodes.append((parent, a, b, depth, stop))
            if stop < end:
                after.append((a, b, stop, me))
                continue
            ended = a
            while ended < b and lens[ended] == end:  # those that end here come first
                ended += 1
            if ended < b:
                cuts = [ended, *(ended + 1 + np.flatnonzero(lcp[ended + 1 : b] <= end)).tolist(), b]
                after += [(c, d, end, me) for c, d in zip(cuts[:-1], cuts[1:])]
        level = after
    parent, a, b, start, stop = (np.array(x) for x in zip(*nodes))
    out = {"parent": parent, "a": a, "b": b, "start": start, "stop": stop}
    out["low"] = np.array([sizes[i:j].min() for i, j in zip(a.tolist(), b.tolist())])
    out["high"] = np.array([sizes[i:j].max() for i, j in zip(a.tolist(), b.tolist())])
    out["rest"] = np.array([lens[i:j].max() for i, j in zip(a.tolist(), b.tolist())]) - stop
    order = np.argsort(parent, kind="stable")
    out["kids"] = order
    out["kid0"] = np.searchsorted(parent[order], np.arange(len(nodes)))
    out["kid1"] = np.searchsorted(parent[order], np.arange(len(nodes)), "right")
    return out


def trie_join(grams: np.ndarray, bounds: np.ndarray, probes: int = 0) -> list[tuple[int, int]]:
    """A spanning forest of the links among the sets ``grams[bounds[i]:bounds[i + 1]]``: no link joins what is joined already.

    With ``probes``, only links between one of the first so many sets and one of the others count.
    """
    n = np.diff(bounds)
    m = len(n)
    row = np.repeat(np.arange(m), n)
    _, token, df = np.unique(grams, return_inverse=True, return_counts=True)
    rank = np.empty(len(df), np.int64)
    rank[np.argsort(df, kind="stable")] = np.arange(len(df))
    if not (df > 1).any() or m == probes:
        return []
    keep = df[token] > 1  # an entry of one set counts in its size, but no overlap
    token, row = rank[token[keep]], row[keep]
    order = np.lexsort((token, row))
    token, row = token[order], row[order]
    cut = np.searchsorted(row, np.arange(m + 1))
    raw = [token[cut[i] : cut[i + 1]] for i in range(m)]
    by = np.array(sorted(range(probes, m), key=lambda i: raw[i].astype(">u4").tobytes()))
    seqs, sizes = [raw[i] for i in by.tolist()], n[by]
    flat = np.concatenate(seqs)
    at = np.concatenate([[0], np.cumsum([len(s) for s in seqs])])
    t = _trie(seqs, sizes)
    label = np.arange(m)
    mark = np.zeros(len(df), np.int64)
    links = []
    single = np.zeros(len(t["a"]), bool)
    stale = 0
    for after, x in [(-1, i) for i in range(probes)] or enumerate(by.tolist()):  # sets of the trie beyond ``after``
        if n[x] == 0:
            continue
        if stale >= 32:  # subtrees that are one class by now
            low, high = (f.reduceat(np.append(label[by], 0), np.stack([t["a"], t["b"]], 1).ravel())[::2] for f in (np.minimum, np.maximum))
            single, stale = low == high, 0
        size, seq = n[x], raw[x]
        mark[seq] = 1
        front, overlap = np.zeros(1, np.int64), np.zeros(1, np.int64)
        while len(front):
            ok = (t["b"][front] > after + 1) & (t["high"][front] * 100 >= size * PERCENT) & (t["low"][front] * PERCENT <= size * 100)
            ok &= ~(single[front] & (label[by[t["a"][front]]] == label[x]))
            front, overlap = front[ok], overlap[ok]
            if not len(front):
                break
            length = t["stop"][front] - t["start"][front]
            own = mark[flat[ragged(at[t["a"][front]] + t["start"][front], length)]]
            sums = np.concatenate([[0], np.cumsum(own)])
            ends = np.cumsum(length)
            overlap = overlap + sums[ends] - sums[ends - length]
            # what the probe has left beyond the segment, in the global order
            last = flat[np.maximum(at[t["a"][front]] + t["stop"][front] - 1, 0)] if len(flat) else front
            left = np.where(t["stop"][front] > 0, len(seq) - np.searchsorted(seq, last, "right"), len(seq))
            best = overlap + np.minimum(left, t["rest"][front])
            ok = best * (100 + PERCENT) >= PERCENT * (size + np.maximum(t["low"][front], _least(size)))
            front, overlap = front[ok], overlap[ok]
            # sets that end at a node: their overlap is complete
            done = t["rest"][front] >= 0
            for f, o in zip(front[done].tolist(), overlap[done].tolist()):
                stop = t["stop"][f]
                k = t["a"][f]
                while k < t["b"][f] and len(seqs[k]) == stop:
                    y = int(by[k])
                    if k > after and label[y] != label[x] and o * (100 + PERCENT) >= PERCENT * (size + n[y]):
                        links.append((x, y))
                        label[label == label[y]] = label[x]
                        stale += 1
                    k += 1
            kids = t["kid1"][front] - t["kid0"][front]
            overlap = np.repeat(overlap, kids)
            front = t["kids"][ragged(t["kid0"][front], kids)]
        mark[seq] = 0
    return links


def _state(docs: DataFrame, size: int, whole: bool = False) -> DataFrame:
    """(doc_id, n, sig_a, sig_b, text, entries, df): per document its set's size and identity; text and index prefix only where a partner is possible.

    Sets are counted by their sample prefixes, or ``whole``. ``size`` is the number of parts that the input fills.
    """
    length = _whole_index if whole else _index

    def hashes(column) -> np.ndarray:
        out = [_counted(g, b, whole)[0] for g, b in _sets(column)]
        return np.concatenate(out) if out else np.zeros(0, U64)

    dealt = census.chunked(docs, size)
    found = census.shared(dealt, hashes, size * census.RANGES)

    def index(table: pa.Table, told: pa.Table) -> pa.Table:
        known, total = census.gathered(told)
        column = table.column("text").combine_chunks()
        texts = column.fill_null("") if column.null_count else column
        n_all, sig, live, entries, dfs = [], [], [], [], []
        for grams, bounds in _sets(texts):
            n = np.diff(bounds)
            sums = np.zeros((2, len(grams) + 1), U64)
            np.cumsum(avalanche(grams ^ U64(0x5851F42D4C957F2D)), out=sums[0, 1:])
            np.cumsum(avalanche(grams ^ U64(0x14057B7EF767814F)), out=sums[1, 1:])
            sig.append((sums[:, bounds[1:]] - sums[:, bounds[:-1]]).view(np.int64))
            h, row = _counted(grams, bounds, whole)
            pos = np.searchsorted(known, h)
            pos[pos == len(known)] = 0
            hit = known[pos] == h if len(known) else np.zeros(len(h), bool)
            h, df, row, of = h[hit], total[pos[hit]], row[hit], np.bincount(row, minlength=len(n))
            order = np.lexsort((h, df, row))
            h, df, row = h[order], df[order], row[order]
            held = np.bincount(row, minlength=len(n))
            first = np.searchsorted(row, np.arange(len(n) + 1))
            place = np.arange(len(h)) - first[:-1][row] + (of - held)[row]  # entries found once come before all others
            use = place < length(n)[row]
            h, df, row = h[use], df[use], row[use]
            first = np.searchsorted(row, np.arange(len(n) + 1))
            enough = np.diff(first) >= _seen(_least(n))
            n_all.append(n)
            live.append(enough & (n > 0))
            for d, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
                entries.append(h[a:b].tobytes() if live[-1][d] else None)
                dfs.append(planes(np.minimum(df[a:b], U64(2**32 - 1)), 4) if live[-1][d] else None)
        n, alive, s = np.concatenate(n_all), np.concatenate(live), np.concatenate(sig, 1)
        return pa.table(
            [table.column("doc_id"), pa.array(n, pa.int64()), pa.array(s[0]), pa.array(s[1]), pa.compute.if_else(pa.array(alive), texts.cast(pa.string()), pa.scalar(None, pa.string())), pa.array(entries, pa.binary()), pa.array(dfs, pa.binary())],
            ["doc_id", "n", "sig_a", "sig_b", "text", "entries", "df"],
        )

    import pyarrow.compute  # noqa: F401

    schema = "doc_id bigint, n bigint, sig_a bigint, sig_b bigint, text string, entries binary, df binary"
    return written(dealt.groupBy("_key").cogroup(found.groupBy("_key")).applyInArrow(index, schema), "shingle-sets")


def _postings(state: DataFrame, ranges: int) -> DataFrame:
    """(range, h, doc, n): index entries, packed by hash range; ranges of very frequent entries are salted by document."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = [np.frombuffer(e, "<u8") for e in batch.column(2).to_pylist()]
            many = [len(e) for e in h]
            h = np.concatenate(h) if h else np.zeros(0, U64)
            df = np.concatenate([unplanes(e, 4) for e in batch.column(3).to_pylist()]) if many else h
            doc, n = (np.repeat(batch.column(c).to_numpy(), many) for c in (0, 1))
            salt = avalanche(doc.view(U64)) % (df // U64(HOT) + U64(1))
            n = np.where(df >= HOT, -n, n)  # marks entries whose sets are dealt to several ranges
            where = (avalanche(h + salt) % U64(ranges)).astype(np.int64)
            order = np.argsort(where, kind="stable")
            cut = np.searchsorted(where[order], np.arange(ranges + 1))
            rows = [(b, order[i:j]) for b, (i, j) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist())) if j > i]
            yield pa.RecordBatch.from_arrays(
                [pa.array([b for b, _ in rows], pa.int32()), pa.array([h[o].tobytes() for _, o in rows], pa.binary()), pa.array([planes(doc[o].view(U64), 8) for _, o in rows], pa.binary()), pa.array([planes(n[o].view(U64), 8) for _, o in rows], pa.binary())],
                ["range", "h", "doc", "n"],
            )

    return state.select("doc_id", "n", "entries", "df").mapInArrow(send, "range int, h binary, doc binary, n binary")


def _candidates(postings: DataFrame, stars: bool) -> DataFrame:
    """(a, b, least, shared, h): pairs of small groups with the entries they share here.

    Members of larger groups come with shared 0: with ``stars``, each beside one of them (a), and that one once more with
    h, the entry, else each beside itself.
    """

    def pair(table: pa.Table) -> pa.Table:
        h = np.concatenate([np.frombuffer(x, "<u8") for x in table.column("h").to_pylist()])
        doc, n = (np.concatenate([unplanes(x, 8) for x in table.column(c).to_pylist()]).view(np.int64) for c in ("doc", "n"))
        order = np.lexsort((doc, h))
        h, doc, n = h[order], doc[order], n[order]
        keep = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])
        h, doc, n = h[keep], doc[keep], n[keep]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        size = np.diff(np.append(first, len(h)))
        left, right = [], []
        big = (size > GROUP) | (n[first] < 0)
        for g in np.unique(size[(size > 1) & ~big]).tolist():
            f = first[(size == g) & ~big]
            i, j = np.triu_indices(g, 1)
            left.append((f[:, None] + i).ravel())
            right.append((f[:, None] + j).ravel())
        left, right = (np.concatenate(x) if x else np.zeros(0, int) for x in (left, right))
        close = (n[left] * 100 >= n[right] * PERCENT) & (n[right] * 100 >= n[left] * PERCENT)
        left, right = left[close], right[close]
        order = np.lexsort((doc[right], doc[left]))
        left, right = left[order], right[order]
        new = np.flatnonzero(np.concatenate([[True], (doc[left][1:] != doc[left][:-1]) | (doc[right][1:] != doc[right][:-1])])) if len(left) else np.zeros(0, int)
        count = np.diff(np.append(new, len(left)))
        left, right = left[new], right[new]
        members = ragged(first[big], size[big])
        hub = np.repeat(first[big], size[big])
        star = np.unique(np.stack([doc[hub if stars else members], doc[members]], 1), axis=0) if len(hub) else np.zeros((0, 2), np.int64)
        ends = first[big] if stars else first[:0]  # so that the parts of a salted entry find each other
        return pa.table(
            {
                "a": pa.array(np.concatenate([doc[left], star[:, 0], doc[ends]]), pa.int64()),
                "b": pa.array(np.concatenate([doc[right], star[:, 1], doc[ends]]), pa.int64()),
                "least": pa.array(np.concatenate([np.minimum(n[left], n[right]), np.zeros(len(star) + len(ends), np.int64)]), pa.int64()),
                "shared": pa.array(np.concatenate([count, np.zeros(len(star) + len(ends), np.int64)]), pa.int64()),
                "h": pa.array(np.concatenate([np.zeros(len(left) + len(star), np.int64), h[ends].view(np.int64)]), pa.int64(), mask=np.concatenate([np.ones(len(left) + len(star), bool), np.zeros(len(ends), bool)])),
            }
        )

    return postings.groupBy("range").applyInArrow(pair, "a bigint, b bigint, least bigint, shared bigint, h bigint")


def _pairs(found: DataFrame) -> DataFrame:
    """(a, b): pairs that share enough entries of small groups."""
    pairs = found.filter("shared > 0").groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.min("least").alias("least"))
    return pairs.filter(F.col("shared") >= F.greatest(F.lit(1), F.floor(F.col("least") * 6 / 100))).select("a", "b")


def _stars(found: DataFrame) -> DataFrame:
    """(a, b): what joins the members of large groups."""
    stars = found.filter("shared = 0 and h is null").select("a", "b")
    hubs = found.filter("h is not null").groupBy("h").agg(F.min("a").alias("hub"), F.count(F.lit(1)).alias("k")).filter("k > 1").select("h", "hub")
    across = found.filter("h is not null").join(hubs, "h").select("a", F.col("hub").alias("b"))
    return stars.union(across)


def _grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    found = list(_sets(texts))
    return np.concatenate([g for g, _ in found]), np.concatenate([[0], np.cumsum(np.concatenate([np.diff(s) for _, s in found]))])


def _verify(sets: DataFrame, near: DataFrame, tasks: int) -> DataFrame:
    """(a, b): links within candidate components; ``sets`` has (doc_id, n, text), ``near`` (v, component)."""
    # all that decides which task a set goes to is narrow; texts are joined to it once a step
    member = sets.select("doc_id", "n").join(near, F.col("doc_id") == F.col("v")).groupBy("component", "doc_id").agg(F.max("n").alias("n"))
    member = written(member, "members")
    cut = F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("int")
    size = member.groupBy("component").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("total")).filter("m > 1").select("component", "m", F.least(cut, F.col("m")).cast("int").alias("cut"))
    sized = member.join(size, "component")
    small = sized.filter("cut = 1").select("doc_id", "component", F.pmod(F.xxhash64("component"), F.lit(tasks)).alias("task"), F.lit(0).alias("part"), F.lit(0).alias("side"))
    large = sized.filter("cut > 1")
    part = F.pmod(F.xxhash64("doc_id"), F.col("cut")).cast("int")
    first = Window.partitionBy("component").orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id")
    hubs = large.withColumn("at", F.row_number().over(first)).filter(F.col("at") <= HUBS).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("cut") - 1)))
    place = F.xxhash64("component", "part")
    parted = [x.select("doc_id", "component", place.alias("task"), "part", F.lit(side).alias("side")) for side, x in ((1, hubs), (2, large.withColumn("part", part)))]
    texts = sets.select("doc_id", "text")

    def hold(table: pa.Table) -> pa.Table:
        """Links of small components, and of a large one's members to its hubs, whose class becomes their label."""
        kind, a, b, where = [], [], [], []
        table = table.take(pa.compute.sort_indices(table, [(c, "ascending") for c in ("component", "part", "side", "doc_id")]))
        ids, side, component = (table.column(c).to_numpy() for c in ("doc_id", "side", "component"))
        key = np.stack([component, table.column("part").to_numpy().astype(np.int64)], 1)
        bounds = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(1)])).tolist()
        column = table.column("text").combine_chunks()

        def add(k: int, x, y, c) -> None:
            kind.append(k)
            a.append(x)
            b.append(y)
            where.append(c)

        for i, j in zip(bounds, [*bounds[1:], len(ids)]):
            if j - i < 2:
                continue
            own, c = ids[i:j].tolist(), int(component[i])
            grams, cuts = _grams(column[i:j])
            h = int((side[i:j] == 1).sum())
            if not h:
                for x, y in trie_join(grams, cuts):
                    add(0, own[x], own[y], None)
                continue
            label = {x: {x} for x in own[:h]}
            for x, y in trie_join(grams[: cuts[h]], cuts[: h + 1]):
                add(0, own[x], own[y], None)
                both = label[own[x]] | label[own[y]]
                for z in both:
                    label[z] = both
            told: dict[int, int] = {}
            for x, y in trie_join(grams, cuts, h):
                add(0, own[x], own[y], None)
                told[y] = min(label[own[x]])
            for y in range(h, j - i):
                add(1, own[y], told.get(y), c)
        return pa.table([pa.array(kind, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(where, pa.int64())], ["kind", "a", "b", "component"])

    import pyarrow.compute  # noqa: F401

    dealt = texts.join(small.union(parted[0]).union(parted[1]), "doc_id")
    held = written(dealt.groupBy("task").applyInArrow(hold, "kind int, a bigint, b bigint, component bigint"), "held-links")
    links = held.filter("kind = 0").select("a", "b")

    # what remains of large components: pairs of blocks but those of one class; sets without a class (free) also meet within their block
    free = F.col("b").isNull()
    label = held.filter("kind = 1").select("component", F.col("a").alias("doc_id"), free.alias("free"), F.coalesce("b", F.lit(0)).alias("label")).distinct()
    per = size.select("component", (F.col("m") / F.col("cut")).alias("per"))
    count = label.groupBy("component", "free", "label").agg(F.count(F.lit(1)).alias("k")).join(per, "component")
    count = written(count.select("component", "free", "label", F.ceil(F.col("k") / F.col("per")).cast("int").alias("subs")), "blocks")
    block = count.withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("subs") - 1))).select("component", F.struct("free", "label", "sub").alias("x"))
    meet = (F.col("x") < F.col("y")) & ~((F.col("x.label") == F.col("y.label")) & ~F.col("x.free") & ~F.col("y.free")) | (F.col("x") == F.col("y")) & F.col("x.free")
    pair = block.join(block.withColumnRenamed("x", "y"), "component").filter(meet).select("component", "x", "y", F.xxhash64("component", "x", "y").alias("task"))
    pair = written(pair, "block-pairs")
    if not pair.limit(1).count():
        return links
    ends = pair.select("component", "x", "task", F.lit(0).alias("side")).union(pair.filter("x <> y").select("component", "y", "task", F.lit(1)))
    own = label.join(count, ["component", "free", "label"])
    own = own.select("component", "doc_id", F.struct("free", "label", F.pmod(F.xxhash64("doc_id", F.lit(2)), F.col("subs")).cast("int").alias("sub")).alias("x"))
    again = texts.join(own.join(ends, ["component", "x"]).select("doc_id", "task", "side"), "doc_id")

    def meet_blocks(table: pa.Table) -> pa.Table:
        a, b = [], []
        table = table.take(pa.compute.sort_indices(table, [(c, "ascending") for c in ("task", "side", "doc_id")]))
        ids, side, task = (table.column(c).to_numpy() for c in ("doc_id", "side", "task"))
        bounds = np.flatnonzero(np.concatenate([[True], task[1:] != task[:-1]])).tolist()
        column = table.column("text").combine_chunks()
        for i, j in zip(bounds, [*bounds[1:], len(ids)]):
            if j - i > 1:
                first = int((side[i:j] == 0).sum())
                for x, y in trie_join(*_grams(column[i:j]), first if first < j - i else 0):
                    a.append(ids[i + x])
                    b.append(ids[i + y])
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return links.union(again.groupBy("task").applyInArrow(meet_blocks, "a bigint, b bigint"))


def link(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, one row per row of ``docs``.

    component_id is the smallest doc_id reachable by links, itself included. Words are folded A-Z only. A text with 1 to
    4 words has one shingle, the whole sequence; a null text, or one without words, has none and is linked with nothing.
    Rows that repeat a doc_id are one document with the links of all its texts; a null id takes no part and has a null
    component. An empty table gives no rows. Other columns are not used. Shingles are told apart by 64-bit hashes.
    """
    size = parts(docs)
    ranges = size * census.RANGES
    state = _state(docs, size)
    live = state.filter("entries is not null and doc_id is not null")
    # written, so that the joins with it are plain ones, which are split where one set has very many copies
    reps = written(live.groupBy("sig_a", "sig_b", "n").agg(F.min("doc_id").alias("rep")), "first-copies")
    first = live.join(reps.select("sig_a", "sig_b", "n", F.col("rep").alias("doc_id")), ["sig_a", "sig_b", "n", "doc_id"], "left_semi")
    # written, too: four steps read it, and would each make the joins and the exchanges of texts again
    first = written(first.dropDuplicates(["doc_id", "sig_a", "sig_b"]).select("doc_id", "n", "text", "entries", "df"), "first-sets")
    found = written(_candidates(_postings(first, ranges), False), "candidates")
    frequent = written(found.filter("shared = 0").select(F.col("a").alias("doc_id")).distinct(), "frequent")
    edges = _pairs(found)
    if frequent.limit(1).count():
        again = _state(first.select("doc_id", "text").join(frequent, "doc_id", "left_semi"), size, True)
        stars = written(_candidates(_postings(again.filter("entries is not null"), ranges), True), "candidates")
        edges = edges.union(_pairs(stars)).union(_stars(stars))
    edges = edges.filter("a <> b").distinct()
    near = connected_components(written(edges, "candidate-edges"), "a", "b")
    links = _verify(first.select("doc_id", "n", "text"), near, ranges)
    copies = live.join(reps, ["sig_a", "sig_b", "n"]).filter("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    classes = connected_components(written(links.union(copies), "links"), "a", "b")
    out = state.select("doc_id", F.col("n").alias("n_shingles")).join(classes, F.col("doc_id") == F.col("v"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def first_of_each(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` per class: of the rows with the class's smallest doc_id, that with the smallest text hash.

    A null text comes last. Null ids take no part in the join and have no class: their rows stay, but of those with
    equal texts (of a word at least) one.
    """
    given = Columns(docs)
    rows, key, text = given.rows, given.at("doc_id"), given.at("text")
    plain = [f.name for f in rows.schema if "map<" not in f.dataType.simpleString()]
    order = [F.col(text).isNull(), F.xxhash64(text), F.col(text), F.xxhash64(*plain)]
    # ranked before the join, so that repeats go before the exchange; the join is by the same key

    def one(rows: DataFrame, key: str) -> DataFrame:
        return rows.withColumn("at", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("at = 1").drop("at")

    firsts = link(docs).filter("doc_id = component_id").select(F.col("doc_id").alias("first")).distinct()
    kept = one(rows.filter(F.col(key).isNotNull()), key).join(firsts, F.col(key).cast("long") == F.col("first"), "left_semi")
    nameless = rows.filter(F.col(key).isNull())
    words = F.coalesce(F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    return given.named(kept.unionByName(one(nameless.filter(words), text)).unionByName(nameless.filter(~words)))
