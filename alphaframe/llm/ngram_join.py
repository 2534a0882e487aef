"""Near-duplicate texts by the Jaccard similarity of their word shingles: a grouped prefix join.

Shingles are put in one order, common ones last. Two sets can only reach the threshold if they share
a shingle among the first few of each (their prefixes). Documents with one prefix and size form a
group, which takes part once. Candidates are compared in rounds, and what links is contracted after each. First, each
group is compared with the smallest group of each list it is in, and each member with the smallest member of
its group. Then, a few times, members of lists that still hold several components meet a few
neighbours of other components, others each time; that joins large sets of near copies by a number of pairs in
proportion to their members. At last all pairs of members that share a prefix shingle but are not connected yet are
compared, unless their sizes or the places of what they share already rule a link out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bucketed, discard, most_frequent, only, stored
from .components import components
from .shingles import mixed, shingle_set

SLICE = 1024
HOT_MOST = 1 << 16
HOT_LEAST = 24
SALT_ROWS = 512
LOW = np.uint64((1 << 31) - 1)
MERGES = 3  # rounds of neighbours at most; they change cost, not results
MEETINGS = 4  # neighbours of a member in a round
WORTH = 20  # a round that links less than one pair in so many is the last
MARKS = 4096  # bits of a set's marks; they bound what two sets can share before any set moves
DEAL_ROWS = 1024  # rows of a list that are compared with so many others by one task


def common_shingles(docs: DataFrame, most: int = HOT_MOST, least: int = HOT_LEAST) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that repeat among the documents of one batch, with how often they do, over all batches.

    They only decide the order of shingles, which any choice leaves correct; the number kept is bounded.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t) for t in batch.column("text").to_pylist()]
            h, n = np.unique(np.concatenate([*sets, np.empty(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h[n > 1].view(np.int64)), pa.array(n[n > 1])], names=["h", "n"])

    counts = docs.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    kept = stored(counts)
    top = most_frequent(kept, most)
    discard(kept)
    h, n = top.column("h").to_numpy().view(np.uint64), top.column("n").to_numpy()
    by = np.argsort(h)
    return h[by], n[by]


def prefix_of(shingles: np.ndarray, hot: np.ndarray, times: np.ndarray, share: int, salt_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles whose sharing is needed for a link, in order, and in how many parts each is dealt."""
    need = -(-share * len(shingles) // 100)  # the least overlap with any set it can link to
    size = len(shingles) - need + 1
    if not len(hot):
        return shingles[:size], np.ones(size, np.int32)
    at = np.searchsorted(hot, shingles)
    at[at == len(hot)] = 0
    known = hot[at] == shingles
    rank = np.where(known, times[at], 0)
    if size <= np.count_nonzero(~known):
        return shingles[~known][:size], np.ones(size, np.int32)
    by = np.lexsort((shingles, rank))[:size]
    return shingles[by], (rank[by] // salt_rows + 1).astype(np.int32)


def signatures(docs: DataFrame, hot: np.ndarray, times: np.ndarray, share: int, salt_rows: int = SALT_ROWS) -> DataFrame:
    """doc_id, n_shingles, grp (of prefix and size), member (of the whole set), prefix and parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[int] = set()
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                rows = []
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    s = shingle_set(text)
                    if not len(s):
                        rows.append((0, None, None, [], []))
                        continue
                    prefix, parts = prefix_of(s, hot, times, share, salt_rows)
                    grp = named(prefix, len(s))
                    shown = doc_id is not None and grp not in seen  # of a group's copies in a batch one shows the prefix
                    if shown:
                        seen.add(grp)
                    rows.append((len(s), grp, named(s, len(s)), prefix.view(np.int64) if shown else [], parts if shown else []))
                n, grp, member, prefix, parts = zip(*rows, strict=True) if rows else ((),) * 5
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(grp, pa.int64()), pa.array(member, pa.int64()),
                     pa.array(prefix, pa.list_(pa.int64())), pa.array(parts, pa.list_(pa.int32()))],
                    names=["doc_id", "n_shingles", "grp", "member", "prefix", "parts"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, n_shingles long, grp long, member long, prefix array<long>, parts array<int>")


def named(shingles: np.ndarray, size: int) -> int:
    """A 64-bit name of an ordered list and a size."""
    places = np.arange(1, len(shingles) + 1, dtype=np.uint64)
    total = np.bitwise_xor.reduce(mixed(shingles + mixed(places))) ^ np.uint64(size)
    return int(mixed(np.array([total + np.uint64(len(shingles))], np.uint64)).view(np.int64)[0])


def posting_lists(signs: DataFrame, share: int) -> DataFrame:
    """h, grp, n, place, dealt, lead, able: groups that share a prefix shingle, the list's smallest
    group, and whether sizes and places leave a link with that possible.

    A common shingle's list is dealt out in parts, each with a lead of its own; lists of one group are dropped.
    """
    tokens = signs.select("grp", "n_shingles", F.posexplode(F.arrays_zip("prefix", "parts")).alias("place", "t")).select(
        F.col("t.prefix").alias("h"), F.pmod("grp", F.col("t.parts")).cast("int").alias("part"), (F.col("t.parts") > 1).alias("dealt"),
        "grp", F.col("n_shingles").cast("int").alias("n"), "place")

    def kept(table: pa.Table) -> pa.RecordBatch:
        """Of whole lists: rows of those with two groups or more, and of those dealt out in parts."""
        h, part, dealt, grp = (table.column(c).to_numpy() for c in ("h", "part", "dealt", "grp"))
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (part[1:] != part[:-1])
        once = new.copy()
        once[1:] |= grp[1:] != grp[:-1]
        of = np.cumsum(new) - 1
        groups = np.bincount(of, weights=once, minlength=1)
        take = np.flatnonzero(once & ((groups[of] > 1) | dealt))
        n, place = (table.column(c).to_numpy().astype(np.int64) for c in ("n", "place"))
        lead, lead_n, lead_place = (x[new][of[take]] for x in (grp, n, place))
        n, place = n[take], place[take]
        # What two sets can share at most if they have the shingle at these places, against what a link needs.
        most = np.minimum(place, lead_place) + 1 + np.minimum(n - place - 1, lead_n - lead_place - 1)
        need = -(-share * (n + lead_n) // (100 + share))
        able = (100 * lead_n >= share * n) & (most >= need)
        return pa.RecordBatch.from_arrays(
            [pa.array(h[take]), pa.array(grp[take]), pa.array(n, pa.int32()), pa.array(place, pa.int32()), pa.array(dealt[take]), pa.array(lead), pa.array(able)],
            names=["h", "grp", "n", "place", "dealt", "lead", "able"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None  # the last list, which the next batch may go on with
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            h, part = table.column("h").to_numpy(), table.column("part").to_numpy()
            other = np.flatnonzero((h != h[-1]) | (part != part[-1]))
            cut = int(other[-1]) + 1 if len(other) else 0
            rest = table.slice(cut)
            if cut:
                yield kept(table.slice(0, cut))
        if rest is not None:
            yield kept(rest)

    dealt_out = tokens.repartition("h", "part").sortWithinPartitions("h", "part", "n", "grp")
    return dealt_out.mapInArrow(run, "h long, grp long, n int, place int, dealt boolean, lead long, able boolean")


def whole_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """member, n, shingles of the wanted (doc_id, member), read from the texts again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[int] = set()  # rows that repeat an id
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                sets = [shingle_set(t) for t in part.column("text").to_pylist()]
                ok = []
                for k, (s, m) in enumerate(zip(sets, part.column("member").to_pylist(), strict=True)):
                    if m not in seen and len(s) and named(s, len(s)) == m:
                        seen.add(m)
                        ok.append(k)
                yield pa.RecordBatch.from_arrays(
                    [part.column("member").take(pa.array(ok, pa.int32())), pa.array([len(sets[k]) for k in ok], pa.int32()),
                     pa.array([sets[k].view(np.int64) for k in ok], pa.list_(pa.int64()))],
                    names=["member", "n", "shingles"])

    return docs.join(wanted, "doc_id").select("member", "text").mapInArrow(run, "member long, n int, shingles array<long>")


def marks_of(shingles: np.ndarray) -> tuple[np.ndarray, int]:
    """The marks of a set as 64-bit words, and how many of its shingles share a bit with another."""
    bits = np.zeros(MARKS, bool)
    bits[(shingles % np.uint64(MARKS)).astype(np.intp)] = True
    return np.packbits(bits).view(np.int64), len(shingles) - int(np.count_nonzero(bits))


def half_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """member, n, shingles (31 bits of each number), marks and twice of the wanted members, stored in buckets of member.

    Sets are made from all texts where these lie and dealt by member once; no text moves, and joins by member find them in place.
    Each shingle sets one bit of the marks; ``twice`` counts those that found theirs set.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[int] = set()  # of a batch's copies one goes on
            for at in range(0, batch.num_rows, SLICE):
                found = {}
                for t in batch.slice(at, SLICE).column("text").to_pylist():
                    s = shingle_set(t)
                    if len(s) and (m := named(s, len(s))) not in seen:
                        seen.add(m)
                        found[m] = (len(s), np.unique((s & LOW).astype(np.int32)), *marks_of(s))
                n, halves, marks, twice = zip(*found.values(), strict=True) if found else ((),) * 4
                yield pa.RecordBatch.from_arrays(
                    [pa.array([*found], pa.int64()), pa.array(n, pa.int32()), pa.array(halves, pa.list_(pa.int32())),
                     pa.array(marks, pa.list_(pa.int64())), pa.array(twice, pa.int32())],
                    names=["member", "n", "shingles", "marks", "twice"])

    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sets = docs.select("text").mapInArrow(run, "member long, n int, shingles array<int>, marks array<long>, twice int").repartition(buckets, "member")
    return bucketed(sets.join(wanted, "member", "left_semi").dropDuplicates(["member"]), "member", buckets)


def of_like_size(pairs: DataFrame, members: DataFrame, share: int) -> DataFrame:
    """The pairs whose sizes leave a link possible; nothing but sizes moves for it."""
    a, b = (members.select(F.col("member").alias(x), F.col("n").alias(f"n_{x}")).distinct() for x in "ab")
    able = 100 * F.least("n_a", "n_b") >= share * F.greatest("n_a", "n_b")
    return pairs.join(a, "a").join(b, "b").where(able).select("a", "b")


def members_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("member")).distinct()


def once(sets: DataFrame) -> DataFrame:
    """One row per member; nothing moves unless rows repeat an id over several batches."""
    if sets.count() == sets.select("member").distinct().count():
        return sets
    alone = stored(sets.dropDuplicates(["member"]))
    discard(sets)
    return alone


def met_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs with both sets and the size of what they share. Sets grow with the data: they meet by member at every size."""
    left, right = (sets.select(F.col("member").alias(x), F.col("n").alias(f"n_{x}"), F.col("shingles").alias(f"s_{x}")).hint("merge") for x in "ab")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "n_a", "n_b", F.size(F.array_intersect("s_a", "s_b")).alias("common"))


def able_by_marks(pairs: DataFrame, halves: DataFrame, share: int) -> DataFrame:
    """The pairs whose marks leave a link possible; none that links is lost.

    What two sets share sets bits that both have, one each but for those that found their bit set.
    """
    left, right = (halves.select(F.col("member").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("n", "marks", "twice"))).hint("merge") for x in "ab")
    both = F.zip_with("marks_a", "marks_b", lambda x, y: F.bit_count(x.bitwiseAND(y)))
    most = F.aggregate(both, F.lit(0), lambda total, x: total + x) + F.least("twice_a", "twice_b")
    return pairs.join(left, "a").join(right, "b").where(100 * most >= share * (F.col("n_a") + F.col("n_b") - most)).select("a", "b")


def linked(pairs: DataFrame, halves: DataFrame, docs: DataFrame, members: DataFrame, share: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold.

    Halves of the numbers decide unless a pair is so close to the threshold that equal halves of different numbers
    could matter; those few are decided on whole numbers, read from the texts. Sets move for pairs only that their marks
    do not rule out.
    """
    def reach(common: Column) -> Column:
        return 100 * common >= share * (F.col("n_a") + F.col("n_b") - common)

    slack = 3 + F.ceil(F.col("n_a").cast("double") * F.col("n_b") / 2.0 ** 29)
    pairs = stored(able_by_marks(pairs, halves, share))
    judged = stored(met_sets(pairs, halves).where(reach(F.col("common") + slack)).select("a", "b", reach(F.col("common") - slack).alias("sure")))
    sure, doubtful = judged.where("sure").select("a", "b"), judged.where("NOT sure").select("a", "b")
    if doubtful.isEmpty():
        return sure
    exact = once(stored(whole_sets(docs, stored(members.join(members_of(doubtful), "member").select("doc_id", "member").distinct()))))
    found = stored(met_sets(doubtful, exact).where(reach(F.col("common"))).select("a", "b"))
    discard(exact)
    return sure.union(found)


def links_possible(share: int) -> Column:
    """Whether the sizes of two members of a list, and the places of the shingle they share, leave a link possible.

    The first shingle that two linked sets share lies early in both: behind it there is no room for more than need be missed.
    """
    need = F.ceil(share * (F.col("n_a") + F.col("n_b")) / (100 + share))
    early = (F.col("place_a") <= F.col("n_a") - need) & (F.col("place_b") <= F.col("n_b") - need)
    return (100 * F.least("n_a", "n_b") >= share * F.greatest("n_a", "n_b")) & early


def mixed_lists(places: DataFrame, label: DataFrame) -> DataFrame:
    """h, member, n, place, c: the lists that hold several components, with the component of each member."""
    labelled = stored(places.join(label, "member").select("h", "member", "n", "place", "c"))
    several = labelled.groupBy("h").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("size")).where("low < high")
    mixed = stored(labelled.join(several.select("h", "size"), "h"))
    discard(labelled)
    return mixed


def neighbours(open_lists: DataFrame, turn: int, share: int, salt_rows: int) -> DataFrame:
    """Pairs (a, b) of members of different components that lie side by side in a list; a few for each member.

    A list is dealt into parts and each part ordered by size class, then by chance; ``turn`` changes both.
    """
    chance = F.xxhash64("member", "h", F.lit(turn))
    part = F.pmod(F.xxhash64("member", F.lit(turn)), F.ceil(F.col("size") / F.lit(salt_rows)))
    # Only where the shingle lies early enough for a link with a set of the same size.
    early = open_lists.where(F.col("place") <= F.col("n") - F.ceil(2 * share * F.col("n") / (100 + share)))
    rows = early.withColumns({"_chance": chance, "_part": part, "_class": F.floor(F.log2("n") * 8)})
    order = Window.partitionBy("h", "_part").orderBy("_class", "_chance")
    own = F.struct("member", "n", "place", "c")
    beside = rows.withColumns({f"_o{k}": F.lead(own, k).over(order) for k in (1, 2)}).withColumn(
        "_o", F.explode(F.array("_o1", "_o2"))).where("_o.member IS NOT NULL")
    met = beside.select("_chance", *(F.col(x).alias(f"{x}_a") for x in ("member", "n", "place", "c")), *(F.col(f"_o.{x}").alias(f"{x}_b") for x in ("member", "n", "place", "c")))
    met = met.where("c_a <> c_b").where(links_possible(share))
    few = Window.partitionBy("member_a").orderBy("_chance")
    pairs = met.withColumn("_k", F.row_number().over(few)).where(F.col("_k") <= MEETINGS)
    return pairs.select(F.least("member_a", "member_b").alias("a"), F.greatest("member_a", "member_b").alias("b")).distinct()


def all_pairs(open_lists: DataFrame, share: int) -> DataFrame:
    """All pairs (a, b) of members of different components that a list brings together and that could link.

    A long list is dealt into parts, and each pair of parts is a key of its own.
    """
    parts = F.ceil(F.col("size") / F.lit(DEAL_ROWS)).cast("int")
    own = F.pmod(F.xxhash64("member"), parts).cast("int")
    rows = open_lists.select("*", own.alias("own"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("other"))
    x, y = (rows.select("h", F.col(i).alias("i"), F.col(j).alias("j"), *(F.col(c).alias(f"{c}_{k}") for c in ("member", "n", "place", "c")))
            for k, i, j in (("a", "own", "other"), ("b", "other", "own")))
    met = x.join(y, ["h", "i", "j"]).where("c_a < c_b").where(links_possible(share))
    # Those met here are counted from the first place on without gaps, since one order holds for all sets.
    shared = met.groupBy(F.col("member_a").alias("a"), F.col("member_b").alias("b"), "n_a", "n_b").agg(
        F.sum((F.col("place_a") >= 0).cast("int")).alias("shared"), F.max("place_a").alias("i"), F.max("place_b").alias("j"),
        F.min("place_a").alias("group_mark"))
    most = F.col("shared") + F.least(F.col("n_a") - F.col("i") - 1, F.col("n_b") - F.col("j") - 1)
    need = F.ceil(share * (F.col("n_a") + F.col("n_b")) / (100 + share))
    return shared.where((F.col("group_mark") < 0) | (most >= need)).select("a", "b")


def contracted(label: DataFrame, links: DataFrame) -> DataFrame:
    """The components (member, c) after more links (a, b) between members."""
    a, b = (label.select(F.col("member").alias(x), F.col("c").alias(f"c_{x}")) for x in "ab")
    between = links.join(a, "a").join(b, "b").select(F.col("c_a").alias("a"), F.col("c_b").alias("b"))
    moved = components(between).select(F.col("node").alias("c"), "component")
    return stored(label.join(moved, "c", "left").select("member", F.coalesce("component", "c").alias("c")))


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", share: int = 75,
    hot_most: int = HOT_MOST, hot_least: int = HOT_LEAST, salt_rows: int = SALT_ROWS,
) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id.

    Texts link when ``100 * common >= share * union`` of their distinct 5-word shingles; a component is
    all that links reach, named by its smallest doc_id. A text with fewer than five words is one shingle;
    a null or empty text, and one of white space, has none and links with nothing. Rows that repeat an
    id share its component; a row without an id links with nothing and has a null component_id. An empty table gives an
    empty result; further columns are ignored.
    """
    rows = only(docs, doc_id=id_col, text=text_col)
    hot, times = common_shingles(rows, hot_most, hot_least)
    signs = stored(signatures(rows, hot, times, share, salt_rows))
    known = signs.where("grp IS NOT NULL AND doc_id IS NOT NULL")
    lists = stored(posting_lists(known, share))
    texts = stored(signs.select("doc_id", "n_shingles", "member"))
    members = stored(known.groupBy("grp", "member", F.col("n_shingles").cast("int").alias("n")).agg(F.min("doc_id").alias("doc_id")))
    discard(signs)
    groups = stored(members.groupBy("grp").agg(F.min("member").alias("first"), F.count("*").alias("members")))
    several = groups.where("members > 1").select("grp", "first")

    # First round: stars.
    tops = lists.where("dealt").groupBy("h").agg(F.min("lead").alias("top"))
    stars = (
        # All the shingles a pair shares must leave a link possible.
        lists.where("lead <> grp").groupBy("lead", "grp").agg(F.min("able").alias("able")).where("able").select("lead", "grp")
        .union(lists.where("dealt").select("h", "lead").distinct().join(tops, "h").select("top", "lead"))
        .where("lead <> grp").distinct()
    )
    firsts = groups.select("grp", "first")
    between = (
        stars.join(firsts.select(F.col("grp").alias("lead"), F.col("first").alias("x")), "lead")
        .join(firsts.select("grp", F.col("first").alias("y")), "grp").select("x", "y")
    )
    within = members.join(several, "grp").select(F.col("first").alias("x"), F.col("member").alias("y"))
    pairs = between.union(within).where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    pairs = stored(of_like_size(pairs, members, share))
    met_in = lists.select("grp").union(several.select("grp")).distinct()
    halves = half_sets(rows, stored(members.join(met_in, "grp").select("member").distinct()))
    label = stored(members.select("member", F.col("member").alias("c")).distinct())
    label = contracted(label, linked(pairs, halves, rows, members, share))

    # Lists by member; a group of several members is a list too.
    of_group = members.select("grp", "member")
    places = stored(lists.join(of_group, "grp").select("h", "member", "n", "place").union(
        members.join(several, "grp").select(F.col("grp").alias("h"), "member", "n", F.lit(-1))))
    discard(lists)
    open_lists = mixed_lists(places, label)
    discard(places)
    # Rounds of neighbours, while they join what the last one left apart.
    for turn in range(MERGES):
        met = stored(neighbours(open_lists, turn, share, salt_rows))
        found = linked(met, halves, rows, members, share)
        n_met, n_found = met.count(), found.count()
        if n_found:
            label = contracted(label, found)
            before, open_lists = open_lists, mixed_lists(open_lists.drop("c", "size"), label)
            discard(before)
        if n_found * WORTH <= n_met:
            break

    # All that is left.
    late = stored(all_pairs(open_lists, share))
    label = contracted(label, linked(late, halves, rows, members, share))
    discard(open_lists, halves)

    labels = members.join(label, "member").select("member", "doc_id", "c")
    names = labels.groupBy("c").agg(F.min("doc_id").alias("component_id"))
    of_member = stored(labels.select("member", "c").distinct().join(names, "c").select("member", "component_id"))
    return texts.join(of_member, "member", "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "doc_id")).alias("component_id"))
