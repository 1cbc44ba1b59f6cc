"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

1. A pass over the texts gives each document its set's size, a 128-bit fingerprint and a 1024-bit parity signature,
   and counts the shingles that are frequent in its part of the texts. Documents with equal sets form a class; only
   its representative is joined.
2. A second pass deals the shingles of all representatives over ranges of their hashes, packed with the number of
   their document in its batch. A range has all documents of its shingles, so it knows their exact frequencies, and
   sends the shingles of several documents back to the batch they came from. Shingles in very many documents would
   gather in one range: they are those counted before, at most 2**FREQUENT_BITS, whose counts are broadcast instead.
3. Each batch orders the shingles of a document by (frequency, hash). The n - ceil(t n) + 1 first ones are its prefix;
   two sets with similarity t share a shingle of both prefixes. A prefix shingle of several classes is a posting list.
4. Rounds: in every list each member is paired with one leader, not with each other; pairs inside a component are
   left out. Pairs that pass the filters are verified against the whole sets, and links merge components. Then the
   leader leaves the list, and lists of one component are done.
5. What can still link lies in the lists that are left: members outside the list's largest component are
   joined with the members of other components that have about their length. After that no link between different
   components is left, so the components are exact.
6. linked() then compares the whole sets of all pairs of classes inside a component, where all links are: its classes
   are dealt over blocks, and a task counts the links of two blocks by products of 0/1 matrices. Pairs are not written.

Filters on a pair that shares a shingle: length (100 min >= percent max), positional (the overlap is at most one
plus what is left after the shingle; it holds at the first shared one) and suffix (parities of 1024 residue classes
bound the symmetric difference from below). A shingle is a 64-bit hash made from the mixed hashes of its words.
Frequencies and lists take its upper 48 bits; two that share them cost a candidate, not a wrong result.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactum.llm.components import components
from pactum.llm.store import Workspace, keyed, tidied
from pactum.llm.words import BLANKS, batches, grams, mix, utf8

#: At most so many frequent shingles, of 16 bytes, go to the driver and are broadcast.
FREQUENT_BITS = 18
#: Added to the counts of frequent shingles; exact frequencies stay below.
FREQUENT = 1 << 31
#: A shingle is frequent in a batch from one in so many of its documents on, and from LEAST documents.
SHARE, LEAST = 1024, 16
#: Shingles of a batch, about 8 MB, and documents of a batch, numbered by 16 bits.
BATCH_SHINGLES, BATCH_ROWS = 1 << 20, 1 << 16
#: At most so many ids of 8 bytes are broadcast; beyond, Spark joins by a shuffle.
BROADCAST_IDS = 500_000
#: Members that are verified against a leader in one group.
FOLLOWERS = 256
#: About so many classes, and shingles, of a component are one block.
BLOCK_CLASSES, BLOCK_SHINGLES = 1024, 1 << 20
#: Columns of the matrices whose product counts shared shingles.
COLUMNS = 4096
#: Rounds of leaders before what is left is joined, unless little is left before.
ROUNDS = 6
#: Residue classes of the parity signature, and its columns of 64 bits.
CLASSES = 1024
_SIGNATURE = [f"s{k}" for k in range(CLASSES // 64)]
_NUMBER = np.uint64(BATCH_ROWS - 1)


def shingle_sets(column: pa.Array, size: int):
    """Yields (row, sorted distinct shingle hashes) for every row, in order."""
    data, offsets = utf8(column)
    for row, counts, _, _, hashes in batches(data, offsets, BLANKS):
        runs, lo = grams(hashes, size), 0
        for doc, n in enumerate(counts.tolist()):
            if n >= size:
                yield row + doc, np.unique(runs[lo : lo + n - size + 1])
            elif n:
                yield row + doc, grams(hashes[lo : lo + n], n)
            else:
                yield row + doc, np.zeros(0, np.uint64)
            lo += n


def prefix_length(n, percent: int):
    return n - (percent * n + 99) // 100 + 1


def _batches(parts, size: int, most: int):
    """Batches of about so many shingles of the rows (id, text): (ids, sets); rows without words are left out."""
    ids, sets, held = [], [], 0
    for batch in parts:
        if not batch.num_rows:
            continue
        names = batch.column(0).to_numpy(zero_copy_only=False)
        for row, own in shingle_sets(batch.column(1), size):
            if len(own):
                ids.append(names[row])
                sets.append(own)
                held += len(own)
                if held >= most or len(ids) == BATCH_ROWS:
                    yield np.array(ids, np.int64), sets
                    ids, sets, held = [], [], 0
    if ids:
        yield np.array(ids, np.int64), sets


def _prints(sets: list[np.ndarray]) -> list[np.ndarray]:
    """The fingerprints of sets."""
    out = np.zeros((2, len(sets)), np.uint64)
    for k, own in enumerate(sets):
        out[0, k] = mix(own ^ np.uint64(0x632BE59BD9B4E019)).sum(dtype=np.uint64)
        out[1, k] = mix(own + np.uint64(0x1B873593CC9E2D51)).sum(dtype=np.uint64)
    return list(out.view(np.int64))


def _marks(sets: list[np.ndarray]) -> list[np.ndarray]:
    """The parity signatures of sets."""
    out = np.zeros((len(sets), len(_SIGNATURE)), np.int64)
    for k, own in enumerate(sets):
        out[k] = np.packbits(np.bincount((own % np.uint64(CLASSES)).astype(np.int64), minlength=CLASSES) & 1).view(np.int64)
    return list(out.T)


def _describe(texts: DataFrame, size: int) -> DataFrame:
    """A row (id, n, f1, f2) for each text with words, and rows (token, seen) of frequent shingles."""

    def run(parts):
        for ids, sets in _batches(parts, size, BATCH_SHINGLES):
            f1, f2 = _prints(sets)
            tokens, seen = np.unique(np.concatenate(sets) >> np.uint64(16), return_counts=True)
            often = seen >= max(LEAST, len(ids) / SHARE)
            tokens, seen = tokens[often].view(np.int64), seen[often]
            docs = [ids, np.array([len(own) for own in sets], np.int64), f1, f2]
            columns = [pa.array(np.concatenate([x, np.zeros(len(tokens), np.int64)])) for x in docs]
            columns += [pa.array(np.concatenate([np.zeros(len(ids), np.int64), x.astype(np.int64)])) for x in (tokens, seen)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "f1", "f2", "token", "seen"])

    return texts.mapInArrow(tidied(run), "id long, n long, f1 long, f2 long, token long, seen long")


def _frequent(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles in order and their counts: in about a 1 / SHARE of the documents, at most 2**FREQUENT_BITS."""
    documents, shingles = rows.where("seen = 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    least = max(4 * LEAST, documents / SHARE, shingles / 2**FREQUENT_BITS)
    found = rows.where("seen > 0").groupBy("token").agg(F.sum("seen").alias("seen")).where(F.col("seen") >= least).toArrow()
    tokens, seen = found["token"].to_numpy(), found["seen"].to_numpy()
    order = np.argsort(tokens)
    # Above all exact frequencies, so that these shingles come last.
    return tokens[order].astype(np.uint64), np.minimum(seen[order], FREQUENT - 1).astype(np.uint32) + np.uint32(FREQUENT)


_PACKED = "part long, home long, batch long, head boolean, body binary, counts binary"


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.large_binary(), pa.large_binary()]
    columns = [pa.array(x, t) for x, t in zip(zip(*rows), kinds)]
    return pa.RecordBatch.from_arrays([*columns[:4], *(c.cast(pa.binary()) for c in columns[4:])], names=["part", "home", "batch", "head", "body", "counts"])


def _planes(values: np.ndarray) -> bytes:
    """64-bit integers byte by byte, most significant bytes together: those of sorted values compress well."""
    return values.view(np.uint8).reshape(-1, 8).T.tobytes()


def _values(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()


def _matches(sorted_: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether each value is in the sorted table, its place there)."""
    if not len(sorted_):
        return np.zeros(len(values), bool), np.zeros(len(values), np.int64)
    at = np.minimum(np.searchsorted(sorted_, values), len(sorted_) - 1)
    return sorted_[at] == values, at


def _entries(texts: DataFrame, size: int, percent: int, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """The prefix shingles of the texts that other texts have too: (token, id, n, pos, signature)."""
    spark = texts.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    known = spark.sparkContext.broadcast(frequent)

    def deal(parts):
        """Each batch: a head with its documents, which waits for its shingles, and the shingles by range."""
        tokens, seen = known.value
        task = TaskContext.get().partitionId()
        for k, (ids, sets) in enumerate(_batches(parts, size, BATCH_SHINGLES)):
            lengths = np.array([len(own) for own in sets])
            number = np.repeat(np.arange(len(ids), dtype=np.uint64), lengths)
            packed = np.sort((np.concatenate(sets) & ~_NUMBER) | number)
            often, at = _matches(tokens, packed >> np.uint64(16))
            # Frequent shingles come last; most prefixes end before them.
            rest = lengths - np.bincount((packed[often] & _NUMBER).astype(np.int64), minlength=len(ids))
            often_here = np.flatnonzero(often)
            needed = (prefix_length(lengths, percent) > rest)[(packed[often_here] & _NUMBER).astype(np.int64)]
            heavy, counts = packed[often_here[needed]], seen[at[often_here[needed]]]
            home, batch = (task + k) % ranges, (task << 32) + k
            head = np.concatenate([[len(ids)], ids, lengths, rest, *_marks(sets)]).astype(np.int64).tobytes()
            yield _packed([(home, home, batch, True, head, b"")] + [(home, home, batch, True, heavy.tobytes(), counts.tobytes())] * bool(len(heavy)))
            packed = packed[~often]
            cuts = np.searchsorted((packed >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32), np.arange(ranges + 1))
            rows = [(p, home, batch, False, _planes(packed[lo:hi]), b"") for p, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:])) if lo < hi]
            if rows:
                yield _packed(rows)

    def count(parts):
        """What several documents of the range share, for each batch."""
        blocks = []
        for batch in parts:
            for row in zip(*(batch.column(k).to_pylist() for k in range(6))):
                if row[3]:
                    yield _packed([row])
                else:
                    blocks.append(row)
        if blocks:
            blocks = [(row, _values(row[4])) for row in blocks]
            tokens = np.sort(np.concatenate([x for _, x in blocks]) >> np.uint64(16))
            starts = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
            seen = np.diff(np.append(starts, len(tokens)))
            tokens, seen = tokens[starts[seen > 1]], np.minimum(seen[seen > 1], FREQUENT - 1).astype(np.uint32)
            for (_, home, name, _, _, _), packed in blocks:
                here, at = _matches(tokens, packed >> np.uint64(16))
                if here.any():
                    yield _packed([(home, home, name, False, packed[here].tobytes(), seen[at[here]].tobytes())])

    def order(parts):
        held: list = []
        for batch in parts:
            for row in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4, 5))):
                if held and held[0][0] != row[0]:
                    yield _prefixes(held, percent)
                    held = []
                held.append(row)
        if held:
            yield _prefixes(held, percent)

    dealt = texts.mapInArrow(tidied(deal), _PACKED).repartitionById(ranges, F.col("part").cast("int"))
    counted = dealt.mapInArrow(tidied(count), _PACKED).repartitionById(ranges, F.col("home").cast("int"))
    return counted.sortWithinPartitions("batch").mapInArrow(tidied(order), "token long, id long, n long, pos long, " + ", ".join(f"{s} long" for s in _SIGNATURE))


def _prefixes(rows: list[tuple], percent: int) -> pa.RecordBatch:
    """The entries of a batch's documents from its rows (batch, head, body, counts)."""
    documents = np.frombuffer(next(body for _, head, body, counts in rows if head and not counts), np.int64)
    total = int(documents[0])
    ids, n, rest, *marks = documents[1:].reshape(3 + len(_SIGNATURE), total)
    shared = [(body, counts) for _, _, body, counts in rows if counts]
    packed = np.concatenate([np.frombuffer(b, np.uint64) for b, _ in shared] or [np.zeros(0, np.uint64)])
    seen = np.concatenate([np.frombuffer(c, np.uint32) for _, c in shared] or [np.zeros(0, np.uint32)])
    owner = (packed & _NUMBER).astype(np.int64)
    rank = np.lexsort((packed, seen, owner))
    owner, packed = owner[rank], packed[rank]
    many = np.bincount(owner, minlength=total)
    # Shingles that no other document has come first: of those that aren't frequent the ones that didn't come back.
    alone = rest - np.bincount(owner[seen[rank] < FREQUENT], minlength=total)
    pos = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many) + alone[owner]
    keep = pos < prefix_length(n, percent)[owner]
    owner = owner[keep]
    columns = [(packed[keep] >> np.uint64(16)).view(np.int64), ids[owner], n[owner], pos[keep], *(m[owner] for m in marks)]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["token", "id", "n", "pos", *_SIGNATURE])


def _may_link(x: str, y: str, percent: int) -> Column:
    """Length, positional and suffix filters on two rows of a posting list."""
    c = lambda side, name: F.col(f"{side}.{name}")
    nx, ny = c(x, "n"), c(y, "n")
    least = F.floor((F.lit(percent) * (nx + ny) + F.lit(100 + percent - 1)) / F.lit(100 + percent)).cast("long")
    apart = reduce(lambda a, b: a + b, [F.bit_count(c(x, s).bitwiseXOR(c(y, s))) for s in _SIGNATURE])
    return (100 * F.least(nx, ny) >= percent * F.greatest(nx, ny)) & (F.least(nx - c(x, "pos"), ny - c(y, "pos")) >= least) & (apart <= nx + ny - 2 * least)


def _own(texts: DataFrame, ids: DataFrame, size: int, work: Workspace) -> DataFrame:
    """(id, own): the whole sets of some texts."""

    def collect(parts):
        for names, sets in _batches(parts, size, BATCH_SHINGLES):
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([own.tobytes() for own in sets], pa.large_binary()).cast(pa.binary())], names=["id", "own"])

    few = ids.count() <= BROADCAST_IDS
    return work.cut(texts.join(F.broadcast(ids) if few else ids, "id", "left_semi").mapInArrow(tidied(collect), "id long, own binary"), "own")


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the distinct pairs (a, b) whose whole sets link. The set of a goes once to each group of up to about
    FOLLOWERS of its partners, theirs stream past it."""
    groups = pairs.groupBy("a").agg(F.ceil(F.count("*") / FOLLOWERS).cast("int").alias("groups"))
    lead = groups.join(sets.select(F.col("id").alias("a"), "own"), "a")
    lead = lead.select("a", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"), F.lit(None).cast("long").alias("b"), "own")
    rest = pairs.join(groups, "a").select("a", F.pmod(F.xxhash64("b"), F.col("groups")).cast("int").alias("group"), "b")
    rest = rest.join(sets.select(F.col("id").alias("b"), "own"), "b").select("a", "group", "b", "own")

    def test(parts):
        lead = None
        for batch in parts:
            keep = np.zeros(batch.num_rows, bool)
            for k, (partner, own) in enumerate(zip(batch.column(2).is_valid().to_pylist(), batch.column(3))):
                own = np.frombuffer(own.as_buffer(), np.uint64)
                if not partner:
                    lead = own.copy()
                    continue
                both = len(lead) + len(own) - len(np.unique(np.concatenate([lead, own])))
                keep[k] = 100 * both >= percent * (len(lead) + len(own) - both)
            if keep.any():
                yield batch.select([0, 2]).filter(pa.array(keep))

    # Without a number of partitions: few pairs go to few tasks, and leave few files.
    placed = rest.unionByName(lead).repartition("a", "group").sortWithinPartitions("a", "group", F.col("b").asc_nulls_first())
    return placed.mapInArrow(tidied(test), "a long, b long")


class _Join:
    """The steps of a join of (id, text) with unique ids."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, size: int, percent: int, work: Workspace):
        self.size, self.percent, self.work = size, percent, work
        self.texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
        self.sets, self.links, self.tested, self.comps, self.found = None, None, None, None, 0
        rows = work.cut(_describe(self.texts, size), "rows")
        frequent = _frequent(rows)
        full = rows.where("seen = 0").select("id", "n", "f1", "f2")
        copies = full.groupBy("f1", "f2", "n").agg(F.min("id").alias("rep"), F.count("*").alias("size")).where("size > 1")
        self.copies = work.cut(copies, "copies")
        #: (id, n, rep) of the rows with words; rep is the representative of the row's class.
        self.members = work.cut(full.join(self.copies, ["f1", "f2", "n"], "left").select("id", "n", F.coalesce("rep", "id").alias("rep")), "members", rows)
        more = self.members.where("rep <> id").select("id")
        if more.count() <= BROADCAST_IDS:
            first = self.texts.join(F.broadcast(more), "id", "left_anti")
        else:
            first = self.texts.join(more, "id", "left_anti").sortWithinPartitions("id")  # a task run again deals the same batches
        entries = work.cut(_entries(first, size, percent, frequent), "entries")
        shared = entries.groupBy("token").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("token")
        self.lists = work.cut(entries.join(shared, "token", "left_semi").dropDuplicates(["token", "id"]), "lists", entries)
        self.entries = self.lists.count()
        if self.entries:
            self._components()

    def _components(self) -> None:
        self.sets = _own(self.texts, self.lists.select("id").distinct(), self.size, self.work)
        # A column beyond those of an entry: the component known so far.
        lists, x, y = self.lists.withColumn("comp", F.col("id")), F.col("x.token"), F.col("y.token")
        lists._pactum_path = self.lists._pactum_path
        for turn in range(ROUNDS):
            lead = lists.groupBy("token").agg(F.min_by(F.struct("id", "n", "pos", "comp", *_SIGNATURE), F.xxhash64("id", F.lit(turn))).alias("lead"), F.count("*").alias("k")).select("token", "k", "lead.*")
            lead = self.work.cut(lead, "leaders")
            pairs = lists.alias("x").join(lead.alias("y"), (x == y) & (F.col("x.comp") != F.col("y.comp")) & _may_link("x", "y", self.percent))
            self._step(pairs.select(F.col("y.id").alias("a"), F.col("x.id").alias("b")))
            # A leader has met all of its list and leaves it; a list of one component is done.
            rest = lists.join(lead.where("k > 2").select("token", F.col("id").alias("lead")), "token").where("id <> lead").drop("lead")
            if self.comps is not None:
                rest = rest.drop("comp").join(self.comps, "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component")
            rest = self.work.cut(rest.select("token", "id", "n", "pos", *_SIGNATURE, "comp"), "rest", lists, lead)
            parts = rest.groupBy("token", "comp").agg(F.count("*").alias("k")).groupBy("token").agg(F.sum("k").alias("all"), F.max("k").alias("most"), F.max_by("comp", "k").alias("main")).where("all > most")
            parts = self.work.cut(parts, "parts")
            lists = self.work.cut(rest.join(parts.select("token"), "token", "left_semi"), "lists", rest)
            left = parts.agg(F.sum(F.col("all") * (F.col("all") - F.col("most")))).first()[0] or 0
            if left <= 4 * self.entries:
                break
        if left:
            # Sets that link have lengths in the same or the next step of a ladder.
            step = F.floor(F.log(F.col("n")) / F.lit(math.log(100 / self.percent) * 1.000001 if self.percent < 100 else 1e-9)).cast("long")
            open_ = lists.join(parts.select("token", "main"), "token").withColumn("step", step)
            near = open_.withColumn("step", F.explode(F.array(*(F.col("step") + k for k in (-1, 0, 1)))))
            once = (F.col("y.comp") == F.col("y.main")) | (F.col("x.id") < F.col("y.id"))
            alike = (x == y) & (F.col("x.step") == F.col("y.step")) & (F.col("x.comp") != F.col("y.comp"))
            pairs = open_.where("comp <> main").alias("x").join(near.alias("y"), alike & once & _may_link("x", "y", self.percent))
            self._step(pairs.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")))
        self.work.drop(lists, parts, *(self.tested or []), *(self.links or []))

    def _step(self, pairs: DataFrame) -> int:
        """Verifies the pairs not tested before, merges components; the number of links."""
        pairs = pairs.groupBy(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).agg(F.min("a").alias("a"))
        if self.tested:
            pairs = pairs.join(reduce(DataFrame.unionByName, self.tested), ["lo", "hi"], "left_anti")
        pairs = self.work.cut(pairs, "pairs")
        self.tested = [*(self.tested or []), pairs.select("lo", "hi")]
        self.tested[-1]._pactum_path = pairs._pactum_path
        pairs = pairs.select("a", (F.col("lo") + F.col("hi") - F.col("a")).alias("b"))
        links = self.work.cut(_verify(pairs, self.sets, self.percent), "links")
        found = links.count()
        if found:
            self.links, self.found, before = [*(self.links or []), links], self.found + found, self.comps
            self.comps = components(reduce(DataFrame.unionByName, self.links), self.found, self.work)
            self.work.drop(before)
        return found


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: id, n_shingles, component_id (the smallest id that links reach, its own included).

    Null, empty and blank texts have no shingles and link with nothing; a text of fewer than `size` words has its
    whole sequence as one shingle. Ties: equal sets link. Rows with null or repeated identifiers are rows of their
    own; a null identifier comes after all others. Other columns are not read. An empty table gives an empty result.
    """
    return _answer(docs, id_col, text_col, size, percent, False)


def linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: id, n_shingles, class_id, n_links, component_id.

    class_id: the smallest id with an equal set of shingles. n_links: how many other rows' sets link with this row's,
    those of its class included. The rest is as in join().
    """
    return _answer(docs, id_col, text_col, size, percent, True)


def _answer(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int, links: bool) -> DataFrame:
    work = Workspace(docs.sparkSession, "jaccard")
    rows, key = keyed(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")), "id", "smallest", work, whole=True)
    did = _Join(rows, key, "text", size, percent, work)
    known = did.copies.select("rep", "size") if links else None
    if did.comps is not None:
        comps = did.comps.withColumnRenamed("id", "rep")
        known = comps if known is None else known.join(comps, "rep", "full")
        if links:
            known = known.join(_links(did), "rep", "full").select("rep", "component", (F.coalesce("size", F.lit(1)) - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    elif links:
        known = known.select("rep", F.col("rep").alias("component"), (F.col("size") - 1).alias("links"))
    members = did.members
    members = members.withColumn("component", F.col("rep")) if known is None else members.join(known, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    work.drop(did.sets)
    names = ["n", "rep", "component"] + ["links"] * links
    out = rows.select(F.col(f"`{key}`").alias("key"), "id").join(members.select(F.col("id").alias("key"), *names), "key", "left")
    label = lambda c: F.coalesce(c, "key")
    values = [F.coalesce("n", F.lit(0)).cast("long").alias("n_shingles")]
    if key == "id":
        values += [label("rep").cast(out.schema["id"].dataType).alias("class_id")] * links
        last = [label("component").cast(out.schema["id"].dataType).alias("component_id")]
    else:
        # Rows were numbered: the number of the class and of the component lead back to their ids.
        ids = rows.select(F.col(f"`{key}`").alias("_k"), F.col("id").alias("_id"))
        out = out.withColumns({"rep": label("rep"), "component": label("component")})
        out = out.join(ids.select(F.col("_k").alias("rep"), F.col("_id").alias("class_id")), "rep", "left")
        out = out.join(ids.select(F.col("_k").alias("component"), F.col("_id").alias("component_id")), "component", "left")
        values += [F.col("class_id")] * links
        last = [F.col("component_id")]
    values += [F.coalesce("links", F.lit(0)).cast("long").alias("n_links")] * links
    return out.select(F.col("id").alias(id_col), *values, *last)


def _links(did: _Join) -> DataFrame:
    """(rep, links) of the classes in components of several: the rows of other classes that link with a class."""
    work, percent = did.work, did.percent
    roots = did.comps.select("component").distinct().select(F.col("component").alias("id"), "component")
    wide = did.comps.unionByName(roots).join(did.copies.select(F.col("rep").alias("id"), "size"), "id", "left")
    wide = wide.select("id", "component", F.coalesce("size", F.lit(1)).alias("size"))
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK_CLASSES), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")
    sets = work.cut(wide.join(did.sets, "id").withColumn("n", (F.octet_length("own") / 8).cast("long")), "wide", did.sets)
    did.sets = sets
    many = sets.groupBy("component").agg(blocks.alias("blocks"))
    sets = sets.join(many, "component").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    key = ["component", "i", "j"]
    dealt = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "n", "size", "own")
    dealt = dealt.repartition(*key).sortWithinPartitions(*key)

    def count(parts):
        held, now = [], None
        for batch in parts:
            names = list(zip(*(batch.column(k).to_pylist() for k in range(3))))
            cuts = [0, *(k for k in range(1, len(names)) if names[k] != names[k - 1]), len(names)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo < hi:
                    if held and names[lo] != now:
                        yield _counted(held, percent)
                        held = []
                    held.append(batch.slice(lo, hi - lo))
                    now = names[lo]
        if held:
            yield _counted(held, percent)

    counts = dealt.mapInArrow(tidied(count), "rep long, links long").groupBy("rep").agg(F.sum("links").alias("links"))
    return work.cut(counts, "counts")


def _counted(parts: list[pa.RecordBatch], percent: int) -> pa.RecordBatch:
    """(rep, links) for the classes of the blocks i and j of a component: links between i and j, or within i."""
    rows = pa.Table.from_batches(parts).combine_chunks()
    column = lambda name: rows.column(name).to_numpy()
    n, weight, first = column("n"), column("size"), column("block") == column("i")
    own = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in rows.column("own")])
    owner = np.repeat(np.arange(len(n)), n)
    rank = np.argsort(own, kind="stable")
    own, owner = own[rank], owner[rank]
    fresh = np.concatenate([[True], own[1:] != own[:-1]])
    place = np.cumsum(fresh) - 1
    times = np.bincount(place)
    shared = times > 1
    here = shared[place]
    place, owner = (np.cumsum(shared) - 1)[place[here]], owner[here]
    x, same = np.flatnonzero(first), bool(first.all())
    y = x if same else np.flatnonzero(~first)
    both = np.zeros((len(x), len(y)), np.int32)
    for low in range(0, int(shared.sum()), COLUMNS):
        lo, hi = np.searchsorted(place, [low, low + COLUMNS])
        matrix = np.zeros((len(n), min(COLUMNS, int(shared.sum()) - low)), np.float32)
        matrix[owner[lo:hi], place[lo:hi] - low] = 1
        both += (matrix[x] @ matrix[y].T).astype(np.int32)
    both = both.astype(np.int64)
    link = 100 * both >= percent * (n[x][:, None] + n[y][None, :] - both)
    links = np.zeros(len(n), np.int64)
    if same:
        np.fill_diagonal(link, False)
    else:
        links[y] = weight[x] @ link
    links[x] = link @ weight[y]
    return pa.RecordBatch.from_arrays([rows.column("id").combine_chunks(), pa.array(links)], names=["rep", "links"])


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, all columns, of which one of each component stays: one with the smallest identifier.

    A null identifier comes after all others; rows with null or repeated identifiers count as rows of their own.
    """
    work = Workspace(docs.sparkSession, "jaccard")
    rows, key = keyed(docs, id_col, "smallest", work, whole=True)
    did = _Join(rows, key, text_col, size, percent, work)
    gone = did.members.where("rep <> id").select("id")
    if did.comps is not None:
        # A representative that isn't the least of its component goes, too.
        gone = gone.unionByName(did.comps.select("id"))
    work.drop(did.sets)
    gone = work.cut(gone, "gone")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return work.lend(rows.join(gone.withColumnRenamed("id", key), key, "left_anti").select([f"`{c}`" for c in docs.columns]))
