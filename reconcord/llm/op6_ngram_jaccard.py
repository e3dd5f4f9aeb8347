"""N-gram Jaccard join by grouped prefixes.

Every text becomes its set of word shingles, hashed to 64 bits.  For a
threshold t, the first ``n - ceil(t n) + 1`` of the n hashes in a fixed order
are its prefix: two sets that link share a prefix hash.  The order is that of
the hashes with *frequent* ones (in over ``frequent`` windows) moved behind;
a window is a prefix with some slack, so that a set with few frequent hashes
may leave them out and still shares a rare one with each partner.

1. Documents whose size and window agree are one group; only groups are indexed.
   Windows are made from the texts when they are indexed and kept in no table; a
   group that several tasks send is one holder of each list.
2. A posting list of a rare hash holds at most ``frequent`` groups; its pairs
   are counted, and a pair stays if the hashes in common plus those that can
   still follow reach the needed overlap.
3. The few groups made of frequent hashes get an exact prefix in order of
   document frequency.  Their lists, and groups of unlike sets, may be long:
   each member is compared with a few leaders first.  The components that are
   left on a list meet in blocks, where a parity sketch of each bounds the
   overlap from above; only pairs that the bound leaves within reach are rows.
4. Pairs are expanded to the members' sets and verified on whole sets.

Documents with the same set share one node, so copies cost one row each.
No list, group or partner is cut short.  The sets of a pair are compared by
their hashes: two different shingles would have to collide in 64 bits within
one pair to change a decision.

Inputs: ``id_col`` integer, ``text_col`` string, any further columns.  A null
or blank text has the empty set: size 0, linked with nothing.  Texts under
five words link only if equal word for word.  A repeated row comes back as
often; rows with a null id link with nothing and get a null component.  An empty table gives an
empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stage, components, semi_by_size
from .shingles import buffers, fingerprint, shingle_sets, slices

FREQUENT = 48
#: Members of a list, by size, that all others are compared with first.
LEADERS = 3
#: Sets that are compared with each other within a task at a time.
BLOCK = 64
#: Components of a list that meet those of another block within a task at a time.
PAIRED = 32
#: Bits of a component's sketch.
SKETCH = 2048
#: Hashes of a run of sets, and of a part of all hashes, about; they bound the memory of a task.
HELD = 1 << 15
PART = 1 << 16
#: Slots that one pass deals elements to, and the elements that a task gathers before it passes them on: about a thousand a row, at any size.
WAYS = 1 << 10
PASSED = 1 << 20
#: Groups that a task remembers to have sent.
SENT = 1 << 17


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def window_length(n: int, percent: int) -> int:
    p = prefix_length(n, percent)
    return min(n, p + 16 + p // 4)


def _spare(n: int, percent: int) -> int:
    """So many frequent hashes may be left out: fewer than any partner's window has in common with this one."""
    least = -(-percent * n // 100)
    return max(0, min(16 + prefix_length(least, percent) // 4, least - 1))


def _windows(column: pa.Array, size: int, percent: int) -> Iterator[tuple[int, int, list[np.ndarray], list[np.ndarray], list[int | None]]]:
    """Sets, windows and groups of the texts [i, j), a slice at a time; an empty set has no group."""
    data, offsets = buffers(column)
    for i, j in slices(offsets):
        sets = shingle_sets(data, offsets[i : j + 1], size)
        window = [s[: window_length(len(s), percent)] if len(s) else s for s in sets]
        yield i, j, sets, window, [int(fingerprint(w, 37) ^ len(s)) if len(s) else None for s, w in zip(sets, window)]


def _base_rows(size: int, percent: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, sets, window, group in _windows(batch.column(1), size, percent):
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([fingerprint(s, 31) if len(s) else None for s in sets], pa.int64()),
                        pa.array(group, pa.int64()),
                        pa.array([int(w[-1]) if len(w) else None for w in window], pa.int64()),
                    ],
                    names=["id", "n", "set_id", "group_id", "last"],
                )

    return rows


def _set_rows(size: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(0))
            for i, j in slices(offsets):
                sets = [s for s in shingle_sets(data, offsets[i : j + 1], size) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([fingerprint(s, 31) for s in sets], pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["set_id", "hashes"])

    return rows


def _postings(size: int, percent: int, frequent: int):
    """(hash, group, n, times) of each window of the texts; a hash that is frequent within the batch sends marks and one count instead of its groups.

    A mark has its hash in place of n.  A task sends a group once, as far as it remembers.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for batch in batches:
            found: list[tuple[int, int, np.ndarray]] = []
            for _, _, sets, window, groups in _windows(batch.column(0), size, percent):
                for s, w, g in zip(sets, window, groups):
                    if g is not None and g not in sent:
                        sent.add(g)
                        found.append((g, len(s), w.copy()))
            if len(sent) > SENT:
                sent.clear()
            if not found:
                continue
            lengths = np.array([len(w) for *_, w in found])
            value = np.concatenate([w for *_, w in found])
            group, n = (np.repeat(np.array(x, np.int64), lengths) for x in list(zip(*found))[:2])
            _, inverse, count = np.unique(value, return_inverse=True, return_counts=True)
            hot = count[inverse] > frequent
            h, k = np.unique(value[hot], return_counts=True)
            none = np.zeros(len(h), np.int64)
            # a mark only passes through: dealt by its group, not by its hash
            columns = [(np.where(hot, group, value), h), (group, none), (np.where(hot, value, n), none), (np.where(hot, 0, 1), k)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in columns], names=["hash", "grp", "n", "times"])

    return rows


def _holders(hash_: np.ndarray, group: np.ndarray, n: np.ndarray, times: np.ndarray) -> list[np.ndarray]:
    """The rows sorted by hash without those that name a holder of a hash again."""
    order = np.lexsort((group, hash_))
    hash_, group, n, times = hash_[order], group[order], n[order], times[order]
    new = np.ones(len(hash_), bool)
    new[1:] = (hash_[1:] != hash_[:-1]) | (group[1:] != group[:-1])
    return [hash_[new], group[new], n[new], times[new]]


def _candidates(frequent: int, percent: int):
    """Pairs from the lists of rare hashes; (group, null, hash) for each frequent hash of a group, perhaps several times.  Rows come sorted by hash."""

    def out(a: np.ndarray, b: np.ndarray, group: np.ndarray, hash_: np.ndarray) -> Iterator[pa.RecordBatch]:
        first = pa.array(np.concatenate([a, group]), pa.int64())
        second = pa.concat_arrays([pa.array(b, pa.int64()), pa.nulls(len(group), pa.int64())])
        third = pa.concat_arrays([pa.nulls(len(a), pa.int64()), pa.array(hash_, pa.int64())])
        for i in range(0, len(first), 1 << 16):
            yield pa.RecordBatch.from_arrays([x.slice(i, 1 << 16) for x in (first, second, third)], names=["a", "b", "hash"])

    def done(hash_: np.ndarray, group: np.ndarray, n: np.ndarray, times: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(hash_):
            return
        hash_, group, n, times = _holders(hash_, group, n, times)
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        start = np.flatnonzero(np.concatenate([[True], hash_[1:] != hash_[:-1]]))
        total = np.add.reduceat(times, start)
        length = np.diff(np.append(start, len(hash_)))
        over = np.repeat(total > frequent, length) & (n > 0)
        few = (total <= frequent) & (length > 1)
        for k in np.unique(length[few]):
            at = start[few & (length == k)][:, None] + np.arange(k)[None, :]
            i, j = np.triu_indices(int(k), 1)
            a, b = at[:, i].ravel(), at[:, j].ravel()
            near = 100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b])
            a, b = group[a[near]], group[b[near]]
            left.append(np.minimum(a, b))
            right.append(np.maximum(a, b))
        yield from out(np.concatenate(left), np.concatenate(right), group[over], hash_[over])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        held = [none] * 4
        for batch in batches:
            own = [np.asarray(x) for x in batch.columns]
            mark = own[3] == 0
            yield from out(none, none, own[1][mark], own[2][mark])
            now = [np.concatenate([x, y[~mark]]) for x, y in zip(held, own)]
            cut = int(np.searchsorted(now[0], now[0][-1], "left")) if len(now[0]) else 0
            yield from done(*(x[:cut] for x in now))
            held = [x[cut:] for x in now]
            if held[3].sum() > frequent:
                held = _holders(*held)
                total = int(held[3].sum())
                if total > frequent:
                    # a frequent hash needs its holders no more: they are marked, and its count goes on alone
                    yield from done(*held)
                    held = [held[0][:1], np.zeros(1, np.int64), np.zeros(1, np.int64), np.array([total])]
        yield from done(*held)

    return rows


class _Dealer:
    """Gathers elements (key, x, y) and passes them on in rows, one for each slot: the key divided by ``step``."""

    def __init__(self, step: int, passed: int):
        self.step, self.passed = step, passed
        self.held, self.n = [], 0

    def add(self, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append(columns)
        self.n += len(columns[0])
        if self.n >= self.passed:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.n:
            columns = [np.concatenate(x) for x in zip(*self.held)]
            slot = columns[0] // self.step
            order = np.argsort(slot, kind="stable")
            own, start = np.unique(slot[order], return_index=True)
            at = np.append(start, len(slot)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(own), *[pa.ListArray.from_arrays(at, x[order]) for x in columns]], names=["slot", "key", "x", "y"])
        self.held, self.n = [], 0


_DEALT = "slot long, key array<long>, x array<long>, y array<long>"


def _values(batch: pa.RecordBatch, i: int) -> list[np.ndarray]:
    return [np.asarray(batch.column(c)[i].values) for c in ("key", "x", "y")]


def _counted(parts: int, step: int, passed: int):
    """Elements (part, hash with its run's number beside it, sets of the run that hold it), dealt by part."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealer, last, held = _Dealer(step, passed), None, []

        def done() -> Iterator[pa.RecordBatch]:
            if held:
                hash_, times = np.unique(np.concatenate(held), return_counts=True)
                part = (hash_.view(np.uint64) % np.uint64(parts)).astype(np.int64)
                # run and count in one number; a run has far fewer than 2 ** 24 sets
                yield from dealer.add(part, hash_, (np.int64(last) << 24) + times)

        for batch in batches:
            for run, hashes in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if run != last:
                    yield from done()
                    last, held = run, []
                held.append(np.asarray(hashes.values))
        yield from done()
        yield from dealer.rest()

    return rows


def _dealt_again(step: int, passed: int):
    """Rows of a slot dealt on to the slots within it; they come sorted by slot."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealer, last = _Dealer(step, passed), None
        for batch in batches:
            for i, slot in enumerate(batch.column("slot").to_pylist()):
                if slot != last:
                    yield from dealer.rest()
                    last = slot
                yield from dealer.add(*_values(batch, i))
        yield from dealer.rest()

    return rows


def _steps(keys: int, ways: int) -> list[int]:
    """By what each pass divides the keys: with so many passes none deals to more than ``ways`` slots for one that it reads."""
    out = [1]
    while keys > ways * out[0]:
        out.insert(0, out[0] * ways)
    return out


def _dealt(first: DataFrame, steps: list[int], passed: int) -> DataFrame:
    """The elements of ``first``, dealt by the first step, together by key: sorted rows whose slot is the key."""
    for step in steps[1:]:
        first = first.repartition("slot").sortWithinPartitions("slot").mapInArrow(_dealt_again(step, passed), _DEALT)
    return first.repartition("slot").sortWithinPartitions("slot")


def _often(step: int, passed: int):
    """Elements (run, hash, sets of all runs that hold it) of each run's hashes that several sets hold, dealt by run; parts come sorted."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealer, last, held = _Dealer(step, passed), None, []

        def done() -> Iterator[pa.RecordBatch]:
            if held:
                hash_, both = (np.concatenate(x) for x in zip(*held))
                _, same = np.unique(hash_, return_inverse=True)
                df = np.bincount(same, both & ((1 << 24) - 1)).astype(np.int64)[same]
                yield from dealer.add(both[df > 1] >> 24, hash_[df > 1], df[df > 1])

        for batch in batches:
            for i, part in enumerate(batch.column("slot").to_pylist()):
                if part != last:
                    yield from done()
                    last, held = part, []
                held.append(_values(batch, i)[1:])
        yield from done()
        yield from dealer.rest()

    return rows


def _ranked(sets: pa.Table, often: pa.Table) -> pa.Table:
    """The sets of a run with those of their hashes that other sets hold too, the rarest first."""
    sets, often = sets.combine_chunks(), often.combine_chunks()
    known, df = (np.concatenate([np.zeros(0, np.int64), *(np.asarray(x.values) for x in often[c])]) for c in ("x", "y"))
    order = np.argsort(known)
    known, df = known[order], df[order]
    n, lists = [], []
    for x in sets["hashes"]:
        hash_ = np.asarray(x.values)
        n.append(len(hash_))
        at = np.minimum(np.searchsorted(known, hash_), max(0, len(known) - 1))
        found = known[at] == hash_ if len(known) else np.zeros(len(hash_), bool)
        hash_, many = hash_[found], df[at[found]] if len(known) else df
        first = np.lexsort((hash_, many))
        lists.append((many[first], hash_[first]))
    at = np.append(0, np.cumsum([len(h) for _, h in lists])).astype(np.int32)
    item = pa.StructArray.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *(x[i] for x in lists)])) for i in (0, 1)], ["df", "hash"])
    return pa.table({"set_id": sets["set_id"], "rich": sets["rich"], "n": pa.array(n, pa.int64()), "hashes": pa.ListArray.from_arrays(at, item)})


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size and sketch of each component's first set: each bit is the parity of the hashes that fall on it."""
    for batch in batches:
        offsets = np.asarray(batch.column(3).offsets)
        place = (np.asarray(batch.column(3).flatten()) >> 20) & (SKETCH - 1)
        bits = [np.packbits(np.bincount(place[i:j], minlength=SKETCH) & 1 == 1).tobytes() for i, j in zip(offsets[:-1], offsets[1:])]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.diff(offsets), pa.int64()), pa.array(bits, pa.binary())], names=["c", "more", "low", "size", "bits"])


def _near_components(percent: int):
    """Pairs of components of two blocks of a list that size, place in the list and sketch leave within reach.

    Two sets differ in at least as many hashes as their sketches in bits, so the
    first sets have at most half of what remains of their sizes in common.
    """

    def need(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return -(-percent * (a[:, None] + b[None, :]) // (100 + percent))

    def block(item: pa.StructArray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        number = {k: np.asarray(item.field(k).cast(pa.int64())) for k in ("c", "lo", "hi", "room", "short", "more", "low", "size")}
        return number, np.frombuffer(b"".join(item.field("bits").to_pylist()), np.uint64).reshape(len(item), -1)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = [], []
            for i in range(batch.num_rows):
                (s, own), (t, other) = block(batch.column(0)[i].values), block(batch.column(1)[i].values)
                differ = np.bitwise_count(own[:, None, :] ^ other[None, :, :]).sum(axis=2, dtype=np.int64)
                size = s["size"][:, None] + t["size"][None, :]
                common = np.minimum((size - differ) // 2, np.minimum(s["size"][:, None], t["size"][None, :]))
                near = common + s["more"][:, None] + t["more"][None, :] >= need(s["low"], t["low"])
                near &= need(s["lo"], t["lo"]) <= np.minimum(s["room"][:, None], t["room"][None, :])
                near &= (100 * s["hi"][:, None] >= percent * t["lo"][None, :]) & (100 * t["hi"][None, :] >= percent * s["lo"][:, None])
                near &= (s["short"][:, None] | t["short"][None, :]) > 0
                near &= (s["c"][:, None] < t["c"][None, :]) if batch.column(2)[i].as_py() else (s["c"][:, None] != t["c"][None, :])
                x, y = np.nonzero(near)
                left.append(np.minimum(s["c"][x], t["c"][y]))
                right.append(np.maximum(s["c"][x], t["c"][y]))
            pairs = np.unique(np.stack([np.concatenate(left), np.concatenate(right)]), axis=1) if left else np.zeros((2, 0), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0], pa.int64()), pa.array(pairs[1], pa.int64())], names=["a", "b"])

    return rows


def _block_links(percent: int):
    """For each set of the outer block one link into the inner block, if there is any; the inner sets are of one component."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for outer, inner in zip(batch.column(0), batch.column(1), strict=True):
                inner = [(x["set_id"].as_py(), x["n"].as_py(), x["more"].as_py(), np.asarray(x["hashes"].values)) for x in inner]
                inner.sort(key=lambda x: -x[2])
                for v in outer:
                    name, n, more, common, own = v["set_id"].as_py(), v["n"].as_py(), v["more"].as_py(), v["common"].as_py(), np.asarray(v["hashes"].values)
                    for u, m, beyond, other in inner:
                        need = -(-percent * (n + m) // (100 + percent))
                        if common + more + beyond >= need and len(np.intersect1d(own, other, assume_unique=True)) >= need:
                            a.append(min(u, name))
                            b.append(max(u, name))
                            break
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return rows


def ngram_jaccard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 75, frequent: int = FREQUENT) -> DataFrame:
    """Rows (id, n_shingles, component_id), one for each row of ``docs``; links need a Jaccard similarity of percent / 100 or more."""
    spark = docs.sparkSession
    stage = Stage(spark, "ngram-jaccard")
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    base = stage.keep(source.mapInArrow(_base_rows(size, percent), "id long, n long, set_id long, group_id long, last long"))
    full = base.where("n > 0 and id is not null")

    found = stage.keep(
        source.where("id is not null").select("text").mapInArrow(_postings(size, percent, frequent), "hash long, grp long, n long, times long")
        .repartition("hash").sortWithinPartitions("hash")
        .mapInArrow(_candidates(frequent, percent), "a long, b long, hash long")
    )
    shape = full.groupBy("group_id").agg(F.first("n").alias("n"), F.first("last").alias("last"), F.min("set_id").alias("lead"), F.count_distinct("set_id").alias("kinds"))
    marks = found.where("b is null").groupBy(F.col("a").alias("group_id")).agg(F.count_distinct("hash").alias("marks"))
    p = F.expr(f"n - ceil({percent} * n / 100) + 1")
    least = F.expr(f"ceil({percent} * n / 100)")
    spare = F.least(16 + F.floor((least - F.ceil(least * percent / 100) + 1) / 4), least - 1)
    group = stage.keep(
        shape.join(marks, "group_id", "left").fillna(0, ["marks"])
        .withColumn("rest", F.col("n") - F.least(F.col("n"), p + 16 + F.floor(p / 4)))
        .withColumn("frequent", F.col("marks") > spare)
    )

    side = lambda s: group.select(F.col("group_id").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("n", "last", "marks", "rest", "lead", "kinds")])
    need = lambda a, b: F.ceil(percent * (a + b) / (100 + percent))
    pairs = stage.keep(
        found.where("b is not null").groupBy("a", "b").agg(F.count("*").alias("common"))
        .join(side("a"), "a").join(side("b"), "b")
        .where(F.col("common") + F.least("marks_a", "marks_b") + F.when(F.col("last_a") <= F.col("last_b"), F.col("rest_a")).otherwise(F.col("rest_b")) >= need(F.col("n_a"), F.col("n_b")))
        .select("a", "b", "lead_a", "lead_b", ((F.col("kinds_a") > 1) | (F.col("kinds_b") > 1)).alias("unlike"))
    )
    stage.drop(found)

    # whole sets of what is compared
    wide = group.where("frequent or kinds > 1").select("group_id").union(pairs.where("unlike").select("a")).union(pairs.where("unlike").select("b"))
    sets = full.join(wide.distinct(), "group_id", "left_semi").select("set_id", "id")
    leads = pairs.select(F.col("lead_a").alias("set_id")).union(pairs.select("lead_b")).distinct()
    sets = sets.union(full.join(leads, "set_id", "left_semi").select("set_id", "id"))
    ids = stage.keep(sets.groupBy("set_id").agg(F.min("id").alias("id")).select("id").distinct())
    whole = stage.keep(semi_by_size(source, ids, "id").select("text").mapInArrow(_set_rows(size), "set_id long, hashes array<long>").dropDuplicates(["set_id"]))
    stage.drop(ids)

    def similar(candidates: DataFrame) -> DataFrame:
        """Adds the exact overlap and whether it makes a link."""
        a, b = (whole.select(F.col("set_id").alias(s), F.col("hashes").alias(f"hashes_{s}")) for s in "ab")
        both = candidates.join(a, "a").join(b, "b").withColumn("common", F.size(F.array_intersect("hashes_a", "hashes_b"))).withColumn("total", F.size("hashes_a") + F.size("hashes_b"))
        return both.select(*candidates.columns, "common", ((100 + percent) * F.col("common") >= percent * F.col("total")).alias("link"))

    # lists that may be long: frequent hashes of groups made of them, and groups of unlike sets
    members = full.select("group_id", "set_id").distinct()
    rich = group.where("frequent").join(members, "group_id").select("set_id", F.lit(True).alias("rich"))
    mixed = group.where("kinds > 1").join(members, "group_id").select("set_id", F.lit(False).alias("rich"))
    listed = stage.keep(rich.union(mixed).groupBy("set_id").agg(F.max("rich").alias("rich")))
    # how many sets hold each hash is counted by runs of sets and parts of the hashes; a row is about a thousand hashes, at any size
    total = whole.join(listed, "set_id", "left_semi").agg(F.sum(F.size("hashes"))).first()[0] or 0
    runs, parts = max(1, -(-total // HELD)), max(1, -(-total // PART))
    some = stage.keep(whole.join(listed, "set_id").select(F.pmod(F.xxhash64("set_id"), F.lit(runs)).alias("run"), "set_id", "rich", "hashes"))
    by_part, by_run = _steps(parts, WAYS), _steps(runs, WAYS)
    counted = some.select("run", "hashes").repartition("run").sortWithinPartitions("run").mapInArrow(_counted(parts, by_part[0], PASSED), _DEALT)
    found = _dealt(counted, by_part, PASSED).mapInArrow(_often(by_run[0], PASSED), _DEALT)
    often = stage.keep(_dealt(found, by_run, PASSED).select(F.col("slot").alias("run"), "x", "y"))
    ranked = stage.keep(some.groupBy("run").cogroup(often.groupBy("run")).applyInArrow(_ranked, "set_id long, rich boolean, n long, hashes array<struct<df:long,hash:long>>"))
    lists = (
        ranked.where("rich").withColumn("alone", F.col("n") - F.size("hashes"))
        .select("set_id", "n", "alone", F.posexplode(F.slice("hashes", F.lit(1), F.greatest(F.lit(0), (p - F.col("alone")).cast("int")))).alias("k", "h"))
        .select(F.col("h.hash").alias("list"), "set_id", "n", (F.col("n") - F.col("alone") - F.col("k")).alias("room"))
    )
    unlike = group.where("kinds > 1").select("group_id", "n").join(members, "group_id").select(F.xxhash64(F.lit("group"), "group_id").alias("list"), "set_id", "n", F.col("n").alias("room"))
    lists = lists.unionByName(unlike).withColumn("band", F.floor(F.log("n") / math.log(100 / percent)).cast("int"))
    # of two linked sets the smaller one has a common hash in this shorter prefix
    lists = stage.keep(lists.withColumn("short", F.col("room") >= need(F.col("n"), F.col("n"))))

    pair = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    sized = lambda a, b: 100 * F.least(a, b) >= percent * F.greatest(a, b)
    leader = lists.where("short").groupBy("list", "band").agg(
        F.array_distinct(F.array(*[F.min(F.struct(F.xxhash64("set_id", "list", F.lit(k)).alias("o"), "set_id", "n", "room")) for k in range(LEADERS)])).alias("leaders")
    )
    leader = leader.select("list", F.explode(F.array("band", F.col("band") + 1)).alias("band"), F.explode("leaders").alias("l"))
    star = lists.join(leader, ["list", "band"]).where(
        (F.col("set_id") != F.col("l.set_id")) & sized(F.col("n"), F.col("l.n")) & (F.least("room", "l.room") >= need(F.col("n"), F.col("l.n")))
    ).select(*pair("set_id", "l.set_id"))
    first = stage.keep(pairs.select(*pair("lead_a", "lead_b")).union(star).distinct())
    links = stage.keep(similar(first).where("link").select("a", "b"))
    comp = components(stage, links)

    # What is still in another component.  Two sets have in common at most what
    # their components' first sets have, and those of their own hashes beyond
    # their first set that any other listed set has; that rules out nearly all pairs.
    now = lists.join(comp.withColumnRenamed("id", "set_id"), "set_id", "left").withColumn("c", F.coalesce("component", "set_id"))
    part = now.groupBy("list", "c").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max("room").alias("room"), F.max("short").alias("short"))
    mixed = part.groupBy("list").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("list")
    part = stage.keep(part.join(mixed, "list", "left_semi"))
    # a component stands behind the member with the fewest hashes of its own, as that is closest to all others
    sole = F.coalesce(F.col("n") - F.size("hashes"), F.col("n"))
    own = now.select("set_id", "n", "c").distinct().join(part.select("c").distinct(), "c", "left_semi").join(ranked.select("set_id", "hashes"), "set_id", "left")
    own = stage.keep(own.select("set_id", "n", "c", sole.alias("sole"), F.coalesce(F.transform("hashes", lambda h: h["hash"]), F.array().cast("array<bigint>")).alias("shared")))
    head = stage.keep(own.groupBy("c").agg(F.min_by("set_id", F.struct("sole", F.col("n") * -1, "set_id")).alias("head")))
    own = own.join(head, "c").join(whole.select(F.col("set_id").alias("head"), "hashes"), "head")
    own = stage.keep(own.select("set_id", "n", "c", F.size(F.array_except("shared", "hashes")).cast("long").alias("more")))
    per = stage.keep(own.groupBy("c").agg(F.max("more").alias("more"), F.min("n").alias("lo"), F.count("*").alias("k")))
    sketch = per.join(head, "c").join(whole.withColumnRenamed("set_id", "head"), "head").select("c", "more", F.col("lo").alias("low"), "hashes")
    sketch = sketch.mapInArrow(_sketches, "c long, more long, low long, size long, bits binary")
    blocks = part.join(part.groupBy("list").agg(F.ceil(F.count("*") / PAIRED).alias("blocks")), "list").join(sketch, "c").withColumn("block", F.pmod(F.xxhash64("c"), F.col("blocks")))
    blocks = blocks.groupBy("list", "blocks", "block").agg(F.collect_list(F.struct("c", "lo", "hi", "room", "short", "more", "low", "size", "bits")).alias("parts"))
    # a long list is dealt into up to 64 tasks
    tasks = F.least(F.lit(64), F.ceil(F.col("blocks") / 16))
    blocks = stage.keep(blocks.withColumn("tasks", tasks))
    outer = blocks.select("list", F.pmod("block", "tasks").alias("task"), F.col("block").alias("i"), F.col("parts").alias("outer"))
    inner = blocks.select("list", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tasks") - 1)).alias("task"), F.col("block").alias("j"), F.col("parts").alias("inner"))
    cross = outer.join(inner, ["list", "task"]).where("i <= j").select("outer", "inner", F.expr("i = j").alias("same")).mapInArrow(_near_components(percent), "a long, b long").distinct()
    heads = cross.join(head.select(F.col("c").alias("a"), F.col("head").alias("head_a")), "a").join(head.select(F.col("c").alias("b"), F.col("head").alias("head_b")), "b")
    apart = similar(heads.select(F.col("a").alias("c"), F.col("b").alias("d"), F.col("head_a").alias("a"), F.col("head_b").alias("b")))
    apart = apart.select(F.col("c").alias("a"), F.col("d").alias("b"), "common")
    end = lambda x: per.select(F.col("c").alias(x), *[F.col(y).alias(f"{y}_{x}") for y in ("more", "lo", "k")])
    near = apart.join(end("a"), "a").join(end("b"), "b").where(F.col("common") + F.col("more_a") + F.col("more_b") >= need(F.col("lo_a"), F.col("lo_b")))
    larger = (F.col("k_a") > F.col("k_b")) | ((F.col("k_a") == F.col("k_b")) & (F.col("a") < F.col("b")))
    near = stage.keep(near.select(F.when(larger, F.col("a")).otherwise(F.col("b")).alias("large"), F.when(larger, F.col("b")).otherwise(F.col("a")).alias("small"), F.least("k_a", "k_b").alias("k"), "common"))
    # the sets of the larger component in blocks, those of its smaller neighbours in blocks; only pairs of blocks are rows
    few = near.select(F.col("large").alias("c")).union(near.select("small")).distinct()
    full_own = stage.keep(own.join(few, "c", "left_semi").join(whole, "set_id").join(per.select("c", "k"), "c"))
    item = F.struct("set_id", "n", "more", "hashes")
    inner = full_own.join(near.select(F.col("large").alias("c")).distinct(), "c", "left_semi")
    inner = inner.withColumn("block", F.pmod(F.xxhash64("set_id"), F.ceil(F.col("k") / BLOCK))).groupBy("c", "block").agg(F.collect_list(item).alias("inner"))
    around = near.groupBy("large").agg(F.sum("k").alias("total"))
    outer = near.drop("k").join(around, "large").join(full_own.withColumnRenamed("c", "small"), "small").withColumn("block", F.pmod(F.xxhash64("set_id"), F.ceil(F.col("total") / BLOCK)))
    outer = outer.groupBy("large", "block").agg(F.collect_list(F.struct("common", "set_id", "n", "more", "hashes")).alias("outer"))
    later = stage.keep(outer.select(F.col("large").alias("c"), "outer").join(inner.select("c", "inner"), "c").select("outer", "inner").mapInArrow(_block_links(percent), "a long, b long"))
    kin = members.join(comp.withColumnRenamed("id", "set_id"), "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    spread = (
        pairs.where("unlike").select("a", "b")
        .join(kin.select(F.col("group_id").alias("a"), F.col("set_id").alias("u"), F.col("component").alias("c")), "a")
        .join(kin.select(F.col("group_id").alias("b"), F.col("set_id").alias("v"), F.col("component").alias("d")), "b")
        .where("c <> d").select(*pair("u", "v"))
    )
    second = stage.keep(spread.distinct().join(first, ["a", "b"], "left_anti"))
    if later.head(1) or second.head(1):
        more = later.select("a", "b").union(similar(second).where("link").select("a", "b"))
        # the components found so far stand for all links that made them
        comp = components(stage, stage.keep(comp.select(F.col("id").alias("a"), F.col("component").alias("b")).union(more)))
    stage.drop(part, own, full_own, head, per, blocks, near, later, second, first, lists, listed, some, often, ranked, pairs, group, links)

    out = base.select("id", "n", "set_id").join(comp.withColumnRenamed("id", "set_id"), "set_id", "left").withColumn("node", F.coalesce("component", "set_id"))
    smallest = out.where("node is not null").groupBy("node").agg(F.min("id").alias("low"))
    return out.join(smallest, "node", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), F.coalesce("low", "id")).alias("component_id"),
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns, that have the smallest id of their component; of rows repeated with one id and text, one."""
    stage = Stage(docs.sparkSession, "near-copies")
    found = stage.keep(ngram_jaccard(docs, id_col, text_col, **options).select(F.col(id_col).alias("near_id"), "component_id"))
    gone = stage.keep(found.where("near_id <> component_id").select("near_id").distinct())
    out = docs.join(gone, F.col(id_col).cast("long") == F.col("near_id"), "left_anti")
    again = stage.keep(found.where("near_id is not null").groupBy("near_id").agg(F.count("*").alias("n")).where("n > 1").select("near_id"))
    if again.head(1):
        same = F.col(id_col).cast("long") == F.col("near_id")
        out = out.join(again, same, "left_anti").unionByName(out.join(again, same, "left_semi").dropDuplicates([id_col, text_col]))
    return out
