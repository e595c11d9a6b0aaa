"""Exact similarity join on word shingles with a token-group matrix.

A document is the set of its distinct shingles. Similar documents are put into groups; the matrix tells which tokens
the union of a group holds. A query can only reach similarity t with a member if t * |query| of its tokens are in the
union, so only groups that meet this bound are opened and compared member by member.

1. One pass gives every document its set's size and fingerprint (equal sets are one key from here on), and a sketch
   of token frequencies of fixed size. The sketch fixes a global order of tokens, rarest first.
2. Two similar sets share a token among the first n - ceil(t n) + 1 of either, so only these prefixes are posted.
   A posting list of one key ends here; a list of several names a leader for keys of similar size.
3. Groups: a key joins the leader it meets most often, if they meet often enough to be similar at all (two similar
   sets share more than one token of their prefixes; see :func:`least_shared`); keys that meet a leader less often,
   but not by chance, form groups beside it by size. Large groups are cut into parts of about GROUP members. All
   other keys are groups of their own. Each group is compared inside, and the leader of a cut group asks each of its
   parts, so the parts of a cluster are one component before any two of them are paired. Members outside the largest
   component of their group form a group beside it. (Any grouping gives the same components.)
4. Matrix: groups that meet in posting lists are counted, pair by pair, unless both are one component already; a pair
   is kept if it shares as many tokens as two members could need. Members of one are queries to the other: a query's
   overlap with the union of the group's tokens bounds its overlap with any member, and only groups that meet the
   bound are opened.

Nothing is capped: posting lists of more than LIST groups are dealt out as pairs of blocks, and the queries of a group
as salted shares of about ASK queries, each beside a copy of the members. Sets travel as sorted 64-bit codes.

Defined results
* null text, or text without words: no shingle, n_shingles 0, linked with nothing, component_id is its own id;
* fewer than SIZE words: the whole sequence is the one shingle;
* documents with equal sets are linked; rows that repeat an id are one document with each of their texts;
* a row without id takes part like any other and can link documents; its own component_id is null if its component
  has no id at all;
* ties (several smallest ids) cannot matter, since a component is named by its smallest id; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bitmap_of, components, documents, expand, expand_sorted, materialize, mix, parted, sequences, settled, squeeze, squeeze_sorted, text_blocks, words

SIZE, PERCENT = 5, 80
#: Counters of the frequency sketch: 2**SKETCH_BITS, sent in 16 parts.
SKETCH_BITS = 20
#: Members of a group, on average at most.
GROUP = 256
#: Groups of a posting list, and queries to a group, that one task takes at once.
LIST, ASK = 4096, 4096


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = SIZE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row."""
    hashes, counts = words(data, offsets)
    grams, runs = sequences(hashes, counts, size)
    ends, firsts = np.cumsum(runs), np.cumsum(counts) - counts
    out = []
    for k, (n, c) in enumerate(zip(runs.tolist(), counts.tolist(), strict=True)):
        if n:
            out.append(np.unique(grams[ends[k] - n : ends[k]]))
        elif c:  # a short text is one shingle, marked by its length
            out.append(sequences(hashes[firsts[k] : firsts[k] + c], np.array([c]), c)[0] ^ np.uint64(c))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_key(tokens: np.ndarray) -> int:
    """Fingerprint of a set: equal for equal sets whatever the order."""
    with np.errstate(over="ignore"):
        a = mix(tokens + np.uint64(0x632BE59BD9B4E019))
        return int(mix(np.array([a.sum(dtype=np.uint64) * np.uint64(3) + np.bitwise_xor.reduce(a) + np.uint64(len(tokens))], np.uint64)).view(np.int64)[0])


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-n * percent // 100) + 1


def _profile(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "owner", "n_shingles", "key", "part", "counts"]
        sketch = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, data, offsets in text_blocks(batch.column(2)):
                sets = shingle_sets(data, offsets, size)
                every = np.concatenate(sets)
                sketch += np.bincount((every & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64), minlength=1 << SKETCH_BITS)
                n = hi - lo
                yield pa.RecordBatch.from_arrays([ids.slice(lo, n), batch.column(1).slice(lo, n), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_key(s) if len(s) else None for s in sets], pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names)
        if sketch.any():
            yield pa.RecordBatch.from_arrays([*[pa.nulls(16, pa.int64())] * 4, pa.array(range(16), pa.int32()), pa.array([squeeze(p) for p in sketch.reshape(16, -1)], pa.binary())], names)

    return run


def _sum_sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            total[part] = total.get(part, 0) + expand(counts)
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([squeeze(v) for v in total.values()], pa.binary())], ["part", "counts"])


def token_codes(tokens: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """A one-to-one renaming of token hashes whose numeric order is the global order, rarest first."""
    low = (tokens & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64)
    return np.sort(rank[low] << np.uint64(64 - SKETCH_BITS) | tokens >> np.uint64(SKETCH_BITS))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of sorted batches re-cut so that rows with equal first column stay together."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if not len(cols[0]):
            continue
        cut = int(np.searchsorted(cols[0], cols[0][-1]))
        if cut or (held and held[-1][0][-1] != cols[0][0]):
            whole = [*held, [c[:cut] for c in cols]]
            yield [np.concatenate(p) for p in zip(*whole, strict=True)]
            held = []
        held.append([c[cut:] for c in cols])
    if held:
        yield [np.concatenate(p) for p in zip(*held, strict=True)]


def _lead(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted postings (code, n, key) to rows (code, key, n, leader, lead_n) of the lists with several keys. A leader is
        the first key of its list whose size the others can match. Only the last row of a batch is remembered."""
        code_0 = n_0 = key_0 = lead_n = lead_key = None
        alone = False  # the last row opened its list and was not sent yet
        for batch in batches:
            out: list[tuple[int, ...]] = []
            code, n, key = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            same = np.concatenate([[code_0 is not None and len(code) and code[0] == code_0], code[1:] == code[:-1]]).astype(bool)
            with_next = np.concatenate([same[1:], [True]])
            for i in np.flatnonzero(same | with_next).tolist():
                c, m, k = int(code[i]), int(n[i]), int(key[i])
                if c != code_0:
                    code_0, n_0, key_0, lead_n, lead_key, alone = c, m, k, m, k, True
                    continue
                if k == key_0 and m == n_0:
                    continue
                if alone:
                    out.append((c, key_0, n_0, lead_key, lead_n))
                    alone = False
                if m * percent > 100 * lead_n:
                    lead_n, lead_key = m, k
                out.append((c, k, m, lead_key, lead_n))
                n_0, key_0 = m, k
            if len(code) and not with_next[-1:].all():
                code_0 = None
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["code", "key", "n", "leader", "lead_n"])

    return run


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    at = np.searchsorted(a, b)
    return int((a[np.minimum(at, len(a) - 1)] == b).sum()) if len(a) else 0


def _similar(common: int, a: int, b: int, percent: int) -> bool:
    return 100 * common >= percent * (a + b - common)


def least_shared(low, high, percent: int = PERCENT):
    """Tokens that the prefixes of two similar sets share at least, for sizes between low and high (columns).

    All common tokens up to the end of the prefix that ends first are in both prefixes; beyond it that set of size n
    has ceil(t n) - 1 tokens left. So the prefixes share the overlap that similarity needs, t / (1 + t) of both
    sizes, less that; it is least for the smallest set beside the largest."""
    needed = F.floor((percent * (low + high) / (100 + percent)) - percent * high / 100)
    return F.greatest(needed, F.lit(1))


def _meet(percent: int):
    def least(low, high):
        """The same as least_shared, on numbers."""
        return np.maximum(1, np.floor(percent * (low + high) / (100 + percent) - percent * high / 100))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted rows (block, group, side, low, high, most, inn) to pairs of groups with the number of lists they share in
        this task. ``most`` bounds the lists of a group, so a pair that needs more is not counted at all; nor are groups
        of one component (``inn``, 0 if a group has several). A block across two sides of a long list pairs only groups
        of different sides (elsewhere the side is -1)."""
        count: dict[tuple[int, int], int] = {}

        def flush() -> pa.RecordBatch:
            a, b = zip(*count, strict=True) if count else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(list(count.values()), pa.int64())], ["g", "q", "shared"])

        for columns in _runs(batches):
            new = np.concatenate([[True], (columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1])])
            block, *columns = (c[new] for c in columns)
            starts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
            ends = np.concatenate([starts[1:], [len(block)]])
            many = ends - starts > 1
            for i, j in zip(starts[many].tolist(), ends[many].tolist(), strict=True):
                g, side, lo, hi, t, inn = (c[i:j] for c in columns)
                for x in range(len(g) - 1):
                    a, b = np.minimum(lo[x], lo[x + 1 :]), np.maximum(hi[x], hi[x + 1 :])
                    ok = (lo[x] * percent <= 100 * hi[x + 1 :]) & (lo[x + 1 :] * percent <= 100 * hi[x]) & (np.minimum(t[x], t[x + 1 :]) >= least(a, b))
                    ok &= ((inn[x] == 0) | (inn[x] != inn[x + 1 :])) & ((side[x] < 0) | (side[x] != side[x + 1 :]))
                    for y in np.flatnonzero(ok).tolist():
                        pair = (int(g[x]), int(g[x + 1 + y]))
                        count[pair] = count.get(pair, 0) + 1
                    if len(count) > 500_000:
                        yield flush()
                        count.clear()
        yield flush()

    return run


class _Group:
    """The members of a group: the union of their tokens, and who holds which."""

    def __init__(self, keys: list[int], bags: list[np.ndarray]):
        self.keys, self.sizes = keys, np.array([len(b) for b in bags])
        tokens, owner = np.concatenate(bags), np.repeat(np.arange(len(bags)), self.sizes)
        order = np.argsort(tokens, kind="stable")
        tokens, self.owner = tokens[order], owner[order]
        self.union, self.start = np.unique(tokens, return_index=True)
        self.start = np.append(self.start, len(tokens))

    def similar(self, bag: np.ndarray, percent: int) -> list[int]:
        """Members similar to a set. The union bounds the overlap first; only then members are compared."""
        at = np.minimum(np.searchsorted(self.union, bag), len(self.union) - 1)
        at = at[self.union[at] == bag]
        if 100 * len(at) < percent * len(bag):
            return []
        lengths = self.start[at + 1] - self.start[at]
        places = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(self.start[at], lengths)
        common = np.bincount(self.owner[places], minlength=len(self.keys))
        return np.flatnonzero(100 * common >= percent * (len(bag) + self.sizes - common)).tolist()


def _open(percent: int, inside: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (g, role, key, bag), members (role 0) before queries. A group sends, for each of the components that its
        links make, a star: every key beside the smallest."""
        at, keys, bags, group, up, a, b = None, [], [], None, {}, [], []

        def root(x: int) -> int:
            while up.setdefault(x, x) != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        def ask(key: int, bag: np.ndarray) -> None:
            for other in group.similar(bag, percent):
                x, y = root(key), root(group.keys[other])
                up[max(x, y)] = min(x, y)

        def close() -> None:
            nonlocal group
            if inside and keys:
                group = group or _Group(keys, bags)
                for k, bag in zip(keys, bags, strict=True):
                    ask(k, bag)
            for k in list(up):
                if (r := root(k)) != k:
                    a.append(k), b.append(r)

        for batch in batches:
            for g, role, key, bag in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if g != at:
                    close()
                    at, keys, bags, group, up = g, [], [], None, {}
                bag = expand_sorted(bag)
                if role == 0:
                    keys.append(key), bags.append(bag)
                elif keys:
                    group = group or _Group(keys, bags)
                    ask(key, bag)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
            a, b = [], []
        close()
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _owner(id_col: str, text_col: str):
    """What a row is found by: its id, or a hash of its text."""
    return F.coalesce(F.col(id_col).cast("bigint"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))


def _classes(df: DataFrame, size: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, owner, n_shingles, component_id, stays) for every row."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = df.select(F.col(id_col).cast("bigint").alias("doc_id"), _owner(id_col, text_col).alias("owner"), F.col(text_col).alias("text"))
    first = materialize(texts.mapInArrow(settled(_profile(size)), "doc_id bigint, owner bigint, n_shingles bigint, key bigint, part int, counts binary"), "sets")
    sets = first.where("part IS NULL").select("doc_id", "owner", "n_shingles", "key")

    counts = np.zeros((16, (1 << SKETCH_BITS) // 16), np.uint64)
    for r in first.where("part IS NOT NULL").select("part", "counts").repartition(16, "part").mapInArrow(_sum_sketch, "part int, counts binary").collect():
        counts[r.part] = expand(bytes(r.counts))
    rank = np.empty(1 << SKETCH_BITS, np.uint64)
    rank[np.argsort(counts.reshape(-1), kind="stable")] = np.arange(1 << SKETCH_BITS, dtype=np.uint64)
    order = spark.sparkContext.broadcast(rank.astype(np.uint32))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # equal sets of a task are posted once
        rank = order.value.astype(np.uint64)
        for batch in batches:
            for _, _, data, offsets in text_blocks(batch.column(0)):
                out, keys, sizes = [], [], []
                for s in shingle_sets(data, offsets, size):
                    if len(s) and (k := set_key(s)) not in seen:
                        seen.add(k)
                        out.append(token_codes(s, rank)[: prefix_length(len(s), percent)])
                        keys.append(k), sizes.append(len(s))
                if out:
                    lengths = [len(o) for o in out]
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64)), pa.array(np.repeat(np.array(sizes, np.int32), lengths)), pa.array(np.repeat(np.array(keys, np.int64), lengths))], ["code", "n", "key"])

    postings = texts.select("text").mapInArrow(settled(post), "code bigint, n int, key bigint").repartition(parts, "code").sortWithinPartitions("code", "n", "key")
    shared = materialize(postings.mapInArrow(_lead(percent), "code bigint, key bigint, n bigint, leader bigint, lead_n bigint"), "shared")

    def bags_of(keys: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        """((key, owner), (owner, key, bag)): the sets of these keys, and the one row that each is taken from. The bags of
        a few other rows, which the bitmap lets through, are never asked for."""
        owners = materialize(sets.where("key IS NOT NULL").groupBy("key").agg(F.min("owner").alias("owner")).join(keys, "key", "left_semi"), "owners")
        bits, width = bitmap_of(owners, "owner")
        wanted = spark.sparkContext.broadcast(bits)

        def bag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rank, bits, seen = order.value.astype(np.uint64), wanted.value, set()
            for batch in batches:
                slot = batch.column(2).to_numpy(zero_copy_only=False)
                take = np.flatnonzero(bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1)
                some = batch.take(pa.array(take, pa.int64()))
                for lo, hi, data, offsets in text_blocks(some.column(1)):
                    ids, keys, bags = [], [], []
                    for owner, s in zip(some.column(0).slice(lo, hi - lo).to_pylist(), shingle_sets(data, offsets, size), strict=True):
                        if len(s) and (owner, k := set_key(s)) not in seen:
                            seen.add((owner, k))
                            ids.append(owner), keys.append(k), bags.append(squeeze_sorted(token_codes(s, rank)))
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(bags, pa.binary())], ["owner", "key", "bag"])

        slot = F.pmod(F.xxhash64("owner"), F.lit(width))
        return owners, materialize(texts.select("owner", "text", slot.alias("slot")).mapInArrow(settled(bag), "owner bigint, key bigint, bag binary"), name)

    def compare(rows: DataFrame, owners: DataFrame, bags: DataFrame, inside: bool, name: str) -> DataFrame:
        """Links found by opening groups (g) of members (role 0) for themselves or for queries (role 1)."""
        dealt = rows.join(owners, "key").join(bags, ["owner", "key"]).select("g", "role", "key", "bag").repartition(parts, "g").sortWithinPartitions("g", "role", "key")
        return materialize(dealt.mapInArrow(settled(_open(percent, inside)), "a bigint, b bigint"), name)

    # groups of keys that share a leader
    met = shared.groupBy("key", "n", "leader", "lead_n").agg(F.count(F.lit(1)).alias("c"))
    best = met.groupBy("key", "n").agg(F.sum("c").alias("most"), F.max(F.when(F.col("key") != F.col("leader"), F.struct("c", "leader", "lead_n"))).alias("b"))
    needed = least_shared(F.least("n", "b.lead_n"), F.greatest("n", "b.lead_n"), percent)
    tag = F.coalesce(F.when(F.col("b.c") >= needed, 0).when(F.col("b.c") >= F.greatest(needed / 3, F.lit(3)), 1), F.lit(2))
    band = F.when(tag == 1, F.floor(F.log("n") * 20)).otherwise(0)  # far keys only with others of like size
    leader = F.when(tag < 2, F.col("b.leader"))
    homes = materialize(best.select("key", "n", "most", leader.alias("leader"), F.xxhash64(F.coalesce(leader, "key"), tag, band).alias("home")), "homes")
    sizes = homes.groupBy("home").agg(F.count(F.lit(1)).alias("size"))
    placed = homes.join(sizes, "home").select("key", "n", "most", "leader", F.xxhash64("home", F.pmod(F.xxhash64("key"), F.ceil(F.col("size") / GROUP))).alias("home"))
    placed = materialize(placed, "placed")

    # links inside groups, and of their parts to the leader
    many = placed.groupBy("home").agg(F.count(F.lit(1)).alias("size"), F.max("leader").alias("leader")).where("size > 1")
    rows = placed.join(many, "home", "left_semi").select(F.col("home").alias("g"), F.lit(0).alias("role"), "key")
    rows = rows.unionByName(many.where("leader IS NOT NULL").select(F.col("home").alias("g"), F.lit(1).alias("role"), F.col("leader").alias("key")))
    rows = materialize(rows, "rows_inside")
    owners, bags = bags_of(rows.select("key").distinct(), "bags_inside")
    links = compare(rows, owners, bags, True, "links_inside")
    known = materialize(components(links), "known")

    # members outside the largest component of their group become a group beside it
    split = placed.join(known, F.col("key") == F.col("node"), "left").select("key", "n", "most", "home", F.coalesce("component", "key").alias("inn"))
    largest = split.groupBy("home", "inn").agg(F.count(F.lit(1)).alias("c")).groupBy("home").agg(F.max(F.struct("c", "inn")).alias("m")).select("home", F.col("m.inn").alias("main"))
    member = materialize(split.join(largest, "home").select("key", "n", "most", "home", "inn", F.xxhash64("home", F.col("inn") == F.col("main")).alias("g")), "placed_again")
    group = member.groupBy("g").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.sum("most").alias("most"), F.count(F.lit(1)).alias("size"), F.min("inn").alias("inn"), F.max("inn").alias("inn_2"), F.min("home").alias("home"))
    group = materialize(group.withColumn("inn", F.when(F.col("inn") == F.col("inn_2"), F.col("inn")).otherwise(0)).drop("inn_2"), "groups")
    member = materialize(member.select("key", "g").join(group.select("g", "low", "high", "most", "inn"), "g"), "members")

    # pairs of groups that share enough; the pairs of a long list are dealt out by blocks
    long = shared.groupBy("code").agg(F.count(F.lit(1)).alias("keys")).where(F.col("keys") > LIST).select("code", F.ceil(F.col("keys") / LIST).cast("int").alias("sides"))
    lists = shared.select("code", "key").join(materialize(long, "long_lists"), "code", "left").join(member, "key")
    sides = F.coalesce("sides", F.lit(1))
    lists = lists.withColumn("side", F.pmod(F.xxhash64("g"), sides).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), sides - 1)))
    block = F.xxhash64("code", F.least("side", "other"), F.greatest("side", "other"))
    lists = lists.select(block.alias("block"), "g", F.when(F.col("side") == F.col("other"), -1).otherwise(F.col("side")).alias("side"), "low", "high", "most", "inn")
    meets = lists.repartition(parts, "block").sortWithinPartitions("block", "g").mapInArrow(settled(_meet(percent)), "g bigint, q bigint, shared bigint").groupBy("g", "q").agg(F.sum("shared").alias("shared"))
    of = lambda c: group.select(F.col("g").alias(c), *[F.col(x).alias(f"{c}_{x}") for x in ("low", "high", "size", "home")])
    sized = meets.where("shared > 0").join(of("g"), "g").join(of("q"), "q")
    fits = F.col("shared") >= least_shared(F.least("g_low", "q_low"), F.greatest("g_high", "q_high"), percent)
    turn = F.col("q_size") > F.col("g_size")  # the smaller group asks
    asked, asker = (F.when(turn, F.col(x)).otherwise(F.col(y)) for x, y in (("q", "g"), ("g", "q")))
    pairs = materialize(sized.where(fits & (F.col("g_home") != F.col("q_home"))).select(asked.alias("g"), asker.alias("q"), F.least("q_size", "g_size").alias("queries")), "pairs")

    # links between groups; a group that many ask is copied for each share of its queries
    shares = pairs.groupBy("g").agg(F.ceil(F.sum("queries") / ASK).cast("int").alias("shares"))
    salted = lambda salt: F.xxhash64("g", salt).alias("g")
    base = member.join(shares, "g").select("key", "g", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("salt")).select(salted("salt"), F.lit(0).alias("role"), "key")
    asking = pairs.select("g", "q").join(member.select(F.col("g").alias("q"), "key"), "q").join(shares, "g").select(salted(F.pmod(F.xxhash64("key"), "shares").cast("int")), F.lit(1).alias("role"), "key")
    rows = materialize(base.unionByName(asking), "rows_between")
    owners_2, bags_2 = bags_of(rows.select("key").distinct().join(owners, "key", "left_anti"), "bags_between")
    more = compare(rows, owners.unionByName(owners_2), bags.unionByName(bags_2), False, "links_between")

    # components of keys, then of documents
    whole = components(known.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))
    classes = sets.where("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("root"), F.min(F.when(F.col("doc_id").isNull(), F.col("owner"))).alias("nameless"))
    joined = whole.join(classes, F.col("node") == F.col("key")).select("key", "component", "root", "nameless")
    roots = joined.join(joined.groupBy("component").agg(F.min("root").alias("least"), F.min("nameless").alias("first")), "component").select("key", "least", "first")
    named = classes.join(roots, "key", "left").select("key", F.coalesce("least", "root").alias("component_id"), F.coalesce("first", "nameless").alias("first"))
    out = sets.join(materialize(named, "named"), "key", "left").select("doc_id", "owner", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "first", "key")
    stays = F.col("key").isNull() | F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull() & (F.col("owner") == F.col("first")))
    return out.select("doc_id", "owner", "n_shingles", "component_id", stays.alias("stays"))


def similarity_components(df: DataFrame, size: int = SIZE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row."""
    return _classes(df, size, percent, id_col, text_col).select("doc_id", "n_shingles", "component_id")


def representatives(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """The rows that stay when one document of each component does, with all columns: the one with the smallest id, or
    if no row of a component has an id, the text with the smallest hash. Rows that a bitmap tells to stay are never shuffled."""
    found = _classes(df, size, percent, id_col, text_col)
    gone = materialize(found.where("NOT stays").select(F.col("doc_id").isNull().alias("_nameless"), F.col("owner").alias("_gone")).distinct(), "near_copies")
    rest, some = parted(df, F.xxhash64(F.col(id_col).isNull(), _owner(id_col, text_col)), gone.select(F.xxhash64("_nameless", "_gone").alias("key")))
    return rest.unionByName(some.join(gone, (some[id_col].isNull() == gone["_nameless"]) & (_owner(id_col, text_col) == gone["_gone"]), "left_anti"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_components(documents(spark, sf_dir))
