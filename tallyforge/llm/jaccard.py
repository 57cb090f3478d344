"""Documents whose sets of five-word shingles are alike, by a token-group matrix.

Every link is found, and checked on whole sets:

1. Each text becomes a set of 64-bit shingle hashes. Equal sets (copies) become one class at once.
2. Shingles are counted over the corpus. A filter whose bits follow their number tells those in several texts, and about in
   how many, and the order of tokens puts them last. The order decides how much work there is, never the result.
3. The token-group matrix: two sets of Jaccard at least 0.75 share a token among the first n - ceil(0.75 n) + 1 of each,
   and so many of them that the sizes tell. Sets that do fall into one group (connected by such shared tokens; a token
   of very many sets connects them in a star, not in pairs).
4. Inside a group, tokens of all members are united. A set is a query to the group: how many of its tokens occur in
   the union bounds its Jaccard with any member. Only groups that qualify are opened, that is compared with the members.
   A large group is cut by size and hash into parts of ``PART`` sets, each a group of its own with a union of its own; sets
   that are not yet linked to the middle of the large group query all parts of fitting size.
5. Links become components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import exchange
from tallyforge.llm.components import components
from tallyforge.llm.words import mix, slices, words_of
from tallyforge.session import stage

WORDS = 5
#: Similarity as a fraction: 100 * intersection >= 75 * union.
NUMERATOR, DENOMINATOR = 75, 100
#: Shingles held by a task before it sends them on.
HELD = 800_000
#: Bits of the order filter for each entry, and hashes that it is looked up by: one in 50 others passes.
ORDER_BITS_EACH, ORDER_HASHES = 10, 3
#: Bits of the whole order filter at most, which bounds what is broadcast. Where they do not suffice, the lowest levels of shingles are left out.
ORDER_BITS = 1 << 28
#: Sets with a token in common up to which they are counted in pairs; beyond, they form a star.
PAIRED = 16
#: Sets in a part of a large group, and queries that go to a part at once.
PART, QUERIES = 256, 2_000
#: Parts of a large group hold sets of about the same size: powers of this.
SIZE_STEP = 1.1
#: Bits of the filter that tells which documents have to be read again.
FILTER_BITS = 1 << 23

_U = np.uint64


def shingle_sets(texts: pa.Array) -> Iterator[list[np.ndarray]]:
    """Sorted distinct shingle hashes of each text, a slice at a time; a short text is one shingle."""
    for _, _, data, offsets in slices(texts):
        words = words_of(data, offsets, lower=True)
        at, grams = words.grams(WORDS)
        edges = np.searchsorted(at, words.first)
        out = []
        for d, count in enumerate(np.diff(words.first)):
            if count >= WORDS:
                out.append(np.unique(grams[edges[d] : edges[d + 1]]))
            else:
                out.append(np.array([words.whole(d)] if count else [], np.uint64))
        yield out


def _signature(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    return int(mix(tokens).sum().astype(np.int64)), int(mix(tokens + _U(0x5851F42D4C957F2D)).sum().astype(np.int64))


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[np.ndarray]]]:
    for batch in batches:
        ids, at = batch.column(0).to_pylist(), 0
        for sets in shingle_sets(batch.column(1)):
            yield ids[at : at + len(sets)], sets
            at += len(sets)


PROFILE = "part int, doc_id long, n long, s1 long, s2 long, blob binary"


def _profiles(parts: int):
    """Each document's size and signature, and packed counts of the shingles."""
    schema = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("blob", pa.binary())])

    def counts(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        keys, count = np.unique(np.concatenate(held) >> _U(24), return_counts=True) if held else (np.empty(0, np.uint64), None)
        rows = []
        for part, a, b in exchange.cut(keys << _U(24), parts):
            rows.append({"part": part, "blob": exchange.planes(keys[a:b]) + exchange.planes(count[a:b].astype(np.uint32))})
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seen, done = [], 0, set(), 0
        for ids, sets in _batches(batches):
            signs = [_signature(s) for s in sets]
            # These rows pass the groups as they are; dealt in turn, so copies of one text do not meet.
            yield pa.RecordBatch.from_pylist(
                [{"part": (done + k) % parts, "doc_id": i, "n": len(s), "s1": a, "s2": b} for k, (i, s, (a, b)) in enumerate(zip(ids, sets, signs))], schema
            )
            done += len(sets)
            for s, sign in zip(sets, signs):
                if sign not in seen:
                    seen.add(sign)
                    held.append(s)
                    size += len(s)
            if size >= HELD:
                yield from counts(held)
                held, size, seen = [], 0, set()
        yield from counts(held)

    return run


def _entry(tokens: np.ndarray, level: np.ndarray | int) -> np.ndarray:
    """First hash of the entry that tokens (of which 40 bits count) are of a level or above; the next ones are made by ``mix``."""
    return mix((tokens >> _U(24)) * _U(64) + np.asarray(level, np.uint64))


def order_segment(tokens: np.ndarray, counts: np.ndarray, limit: int) -> tuple[int, bytes]:
    """The segment of the order filter for a range of tokens: the lowest level it knows, and at most ``limit`` bits.

    The level of a token is the number of binary digits of its count. It is entered for all levels up to its own, so a look-up climbs.
    """
    levels = np.frexp(counts.astype(float))[1]
    most = int(levels.max(initial=0))
    least, entries = most + 1, 0
    for level in range(most, 0, -1):
        entries += int((levels >= level).sum())
        if entries * ORDER_BITS_EACH > limit or level < levels.min():
            break
        least = level
    entries = sum(int((levels >= level).sum()) for level in range(least, most + 1))
    bits = np.zeros(entries * ORDER_BITS_EACH // 8 * 8, np.uint8)
    for level in range(least, most + 1):
        x = _entry(tokens[levels >= level], level)
        for _ in range(ORDER_HASHES):
            bits[(x >> _U(32)) * _U(len(bits)) >> _U(32)] = 1
            x = mix(x)
    return least, np.packbits(bits, bitorder="little").tobytes()


class Order:
    """The whole order filter: segments of ranges of tokens, one after the other."""

    def __init__(self, segments: list[tuple[int, int, bytes]], parts: int):
        self.least, self.size, self.start = (np.zeros(parts, np.uint64) for _ in range(3))
        at = 0
        for part, least, bits in segments:
            self.least[part], self.size[part], self.start[part] = least, 8 * len(bits), 8 * at
            at += len(bits)
        self.bits = np.frombuffer(b"".join(bits for _, _, bits in segments), np.uint8)

    def levels(self, tokens: np.ndarray) -> np.ndarray:
        """0, or about the number of binary digits of each token's count; where the filter errs, more. Equal tokens get equal numbers."""
        out = np.zeros(len(tokens), np.uint64)
        part = exchange.range_of(tokens, len(self.size))
        at = np.flatnonzero(self.size[part])
        part = part[at]
        level = self.least[part]
        while len(at):
            x = _entry(tokens[at], level)
            for _ in range(ORDER_HASHES):
                bit = self.start[part] + ((x >> _U(32)) * self.size[part] >> _U(32))
                there = np.flatnonzero(self.bits[bit >> _U(3)] >> (bit & _U(7)).astype(np.uint8) & np.uint8(1))
                at, part, level, x = at[there], part[there], level[there], mix(x[there])
            out[at] = level
            going = level < _U(63)
            at, part, level = at[going], part[going], level[going] + _U(1)
        return out


def _merge_profiles(parts: int):
    """Documents as they are; of the shingles the segment of the order filter that knows those in at least four documents."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        docs = table.filter(table.column("blob").is_null()).select(["doc_id", "n", "s1", "s2"])
        keys, counts = [], []
        for blob in table.column("blob"):
            if blob.is_valid:
                data = blob.as_py()
                k = len(data) // 12
                keys.append(exchange.from_planes(data[: 8 * k], "u8"))
                counts.append(exchange.from_planes(data[8 * k :], "u4"))
        rows = {"part": [], "least": [], "bits": []}
        if keys:
            token, count = np.concatenate(keys), np.concatenate(counts).astype(np.int64)
            order = np.argsort(token, kind="stable")
            token, count = token[order], count[order]
            at, _ = exchange.runs(token)
            token, count = token[at], np.add.reduceat(count, at)
            least, bits = order_segment(token[count >= 4] << _U(24), count[count >= 4], ORDER_BITS // parts)
            if bits:
                rows = {"part": [key[0].as_py()], "least": [least], "bits": [bits]}
        more = {"part": pa.int32(), "least": pa.int32(), "bits": pa.binary()}
        new = len(rows["part"])
        return pa.table(
            {
                **{c: pa.chunked_array([*docs.column(c).chunks, pa.nulls(new, pa.int64())]) for c in docs.column_names},
                **{c: pa.chunked_array([pa.nulls(len(docs), kind), pa.array(rows[c], kind)]) for c, kind in more.items()},
            }
        )

    return run


def _order(profile: DataFrame, parts: int) -> Order:
    """The segments, which have at most ORDER_BITS bits together, as one filter."""
    rows = profile.where("part IS NOT NULL").select("part", "least", "bits").toArrow()
    return Order(list(zip(*(rows.column(c).to_pylist() for c in rows.column_names))), parts)


def _prefixes(parts: int, frequent):
    """Packed first tokens of each set, in the order that has frequent tokens last, the most frequent ones at the end."""

    def pack(held: list) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        token = mix(np.concatenate([h[0] for h in held]))
        each = [len(h[0]) for h in held]
        doc, n, sign = (np.repeat(np.array([h[k] for h in held], t), each) for k, t in ((1, np.int64), (2, np.uint32), (3, np.int64)))
        order = np.argsort(token)
        token, doc, n, sign = token[order], doc[order], n[order], sign[order].view(np.uint64) >> _U(16)
        where, blobs = [], []
        for part, a, b in exchange.cut(token, parts):
            where.append(part)
            blobs.append(b"".join(exchange.planes(x[a:b]) for x in (token >> _U(16), doc, sign, n)))
        yield pa.RecordBatch.from_pydict({"part": pa.array(where, pa.int32()), "blob": pa.array(blobs, pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        size = 0
        for ids, sets in _batches(batches):
            every = frequent.value.levels(np.concatenate(sets)) if sets else None
            ends = np.cumsum([len(s) for s in sets])
            for doc, tokens, end in zip(ids, sets, ends):
                n = len(tokens)
                if not n or doc is None:
                    continue
                sign = _signature(tokens)
                if sign in held:
                    held[sign][1] = min(held[sign][1], doc)
                    continue
                level = every[end - n : end]
                if level.any():
                    tokens = tokens[np.argsort(level << _U(56) | tokens >> _U(8))]
                first = tokens[: n - -(-NUMERATOR * n // DENOMINATOR) + 1].copy()
                held[sign] = [first, doc, n, sign[0]]
                size += len(first)
            if size >= HELD:
                yield from pack(list(held.values()))
                held, size = {}, 0
        yield from pack(list(held.values()))

    return run


def needed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Tokens that two sets of these sizes have in common at least, if they are linked."""
    return -(-NUMERATOR * (a + b) // (NUMERATOR + DENOMINATOR))


def _edges(table: pa.Table) -> pa.Table:
    """Sets that share first tokens: pairs with the number of such tokens, or stars (count 0)."""
    columns: list[list[np.ndarray]] = [[], [], [], []]
    for blob in table.column("blob"):
        data = blob.as_py()
        k = len(data) // 28
        for values, a, b, kind in zip(columns, (0, 8, 16, 24), (8, 16, 24, 28), ("u8", "i8", "u8", "u4")):
            values.append(exchange.from_planes(data[a * k : b * k], kind))
    out: dict = {"a": [], "b": [], "need": [], "hits": []}

    def add(a, b, need, hits) -> None:
        for name, values in zip(out, (a, b, need, hits)):
            out[name].append(values.astype(np.int64))

    if columns[0]:
        token, doc, sign, n = (np.concatenate(x) for x in columns)
        order = np.argsort(token, kind="stable")
        at, length = exchange.runs(token[order])
        order = order[np.repeat(length > 1, length)]  # most tokens occur in one set only
        order = order[np.lexsort((doc[order], n[order], sign[order], token[order]))]
        token, doc, sign, n = token[order], doc[order], sign[order], n[order].astype(np.int64)
        if len(token):
            first = np.r_[True, (token[1:] != token[:-1]) | (sign[1:] != sign[:-1]) | (n[1:] != n[:-1])]
            token, doc, n = token[first], doc[first], n[first]  # one of each class of copies
            order = np.lexsort((doc, token))
            token, doc, n = token[order], doc[order], n[order]
        at, length = exchange.runs(token)
        for k in range(2, PAIRED + 1):
            rows = at[length == k]
            for i in range(k):
                for j in range(i + 1, k):
                    x, y = rows + i, rows + j
                    low, high = np.minimum(n[x], n[y]), np.maximum(n[x], n[y])
                    fit = (DENOMINATOR * low >= NUMERATOR * high) & (doc[x] != doc[y])
                    x, y, high = x[fit], y[fit], high[fit]
                    add(doc[x], doc[y], needed(n[x], n[y]) + NUMERATOR * high // -DENOMINATOR + 1, np.ones(len(x)))
        long = length > PAIRED
        if long.any():
            inside = np.repeat(long, length)
            center = np.repeat(at[long], length[long])
            pairs = np.unique(np.stack([doc[center], doc[inside]], 1), axis=0)
            pairs = pairs[pairs[:, 0] != pairs[:, 1]]
            add(pairs[:, 0], pairs[:, 1], np.zeros(len(pairs)), np.zeros(len(pairs)))
    flat = {k: np.concatenate(v) if v else np.empty(0, np.int64) for k, v in out.items()}
    if len(flat["a"]):  # sum up the tokens of a pair in this range
        order = np.lexsort((flat["need"], flat["b"], flat["a"]))
        flat = {k: v[order] for k, v in flat.items()}
        new = np.r_[True, (flat["a"][1:] != flat["a"][:-1]) | (flat["b"][1:] != flat["b"][:-1]) | (flat["need"][1:] != flat["need"][:-1])]
        at = np.flatnonzero(new)
        flat = {k: np.add.reduceat(v, at) if k == "hits" else v[at] for k, v in flat.items()}
    return pa.table(flat)


def _wanted_sets(bits):
    """Whole sets of the documents that a filter lets pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.unpackbits(np.frombuffer(bits.value, np.uint8), bitorder="little")
        for batch in batches:
            ids = batch.column(0)
            known = ids.fill_null(0).to_numpy(zero_copy_only=False)
            keep = table[mix(known.view(np.uint64)) % _U(FILTER_BITS)].astype(bool) & ids.is_valid().to_numpy(zero_copy_only=False)
            chosen = batch.filter(pa.array(keep))
            if not chosen.num_rows:
                continue
            docs, at = chosen.column(0), 0
            for sets in shingle_sets(chosen.column(1)):
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": docs[at : at + len(sets)],
                        "n": pa.array([len(s) for s in sets], pa.int64()),
                        "tokens": pa.array([s.tobytes() for s in sets], pa.binary()),
                    }
                )
                at += len(sets)

    return run


def _bitmap(ids: DataFrame):
    """Broadcast filter of FILTER_BITS bits with the bits of these ids set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(FILTER_BITS, np.uint8)
        for batch in batches:
            seen[mix(batch.column(0).to_numpy().view(np.uint64)) % _U(FILTER_BITS)] = 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_pydict({"at": pa.array(at, pa.int32())})

    found = ids.mapInArrow(run, "at int").distinct().toArrow().column(0).to_numpy()  # at most FILTER_BITS numbers
    table = np.zeros(FILTER_BITS, np.uint8)
    table[found] = 1
    return ids.sparkSession.sparkContext.broadcast(np.packbits(table, bitorder="little").tobytes())


def linked(queries: list[np.ndarray], members: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """For each query that qualifies: its number, and the numbers of the members it is linked with.

    The members' tokens are united with the places where they occur. The number of a query's tokens in the union,
    with the smallest size in the group, bounds its similarity with every member.
    """
    if not members or not queries:
        return
    size = np.array([len(m) for m in members])
    token = np.concatenate(members)
    owner = np.repeat(np.arange(len(members)), size)
    order = np.argsort(token, kind="stable")
    owner = owner[order]
    at, length = exchange.runs(token[order])
    union = token[order][at]
    least = size.min()
    for q, own in enumerate(queries):
        place = np.searchsorted(union, own)
        place[place == len(union)] = 0
        place = place[union[place] == own]
        bound = min(len(place), len(own))
        if DENOMINATOR * bound < NUMERATOR * (len(own) + max(0, least - bound)):
            continue
        k = length[place]
        flat = np.repeat(at[place] - np.r_[0, np.cumsum(k)[:-1]], k) + np.arange(k.sum())
        common = np.bincount(owner[flat], minlength=len(members))
        yield q, np.flatnonzero(DENOMINATOR * common >= NUMERATOR * (len(own) + size - common))


def _links_inside(table: pa.Table) -> pa.Table:
    """Every member of a group or part with one it is connected to by links inside; the middle of the group, if it can be."""
    docs = table.column("doc_id").to_numpy()
    family = table.column("family")[0].as_py()
    sets = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("tokens")]
    above = list(range(len(docs)))

    def top(x: int) -> int:
        while above[x] != x:
            above[x] = above[above[x]]
            x = above[x]
        return x

    for q, others in linked(sets, sets):
        for m in others:
            above[top(q)] = top(int(m))
    root = np.array([top(i) for i in range(len(docs))])
    for middle in np.flatnonzero(docs == family)[:1]:
        root[root == root[middle]] = middle
    return pa.table({"a": pa.array(docs, pa.int64()), "b": pa.array(docs[root], pa.int64()), "family": pa.array(np.full(len(docs), family), pa.int64())})


def _links_across(key, asking: pa.Table, part: pa.Table) -> pa.Table:
    """Links of queries with the members of a part."""
    q, m = asking.column("doc_id").to_numpy(), part.column("doc_id").to_numpy()
    sets = [[np.frombuffer(x.as_py(), np.uint64) for x in t.column("tokens")] for t in (asking, part)]
    out = [(q[i], m[j]) for i, js in linked(*sets) for j in js]
    return pa.table({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64())})


def near_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` of every row: the smallest id reachable over links of 0.75 or more.

    Null and empty texts have no shingles and are linked with nothing. Rows that share an id count as one document
    with several texts. A row whose id is null belongs to the class of its copies, if they have ids. Other columns of the
    input are not looked at, whatever their names. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    exchange.small_batches(spark)
    parts = exchange.range_count(spark)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    profile = stage(
        rows.mapInArrow(_profiles(parts), PROFILE).groupBy("part")
        .applyInArrow(_merge_profiles(parts), "doc_id long, n long, s1 long, s2 long, part int, least int, bits binary"),
        "shingle-profile",
    )
    sets = profile.where("part IS NULL").drop("part", "least", "bits")
    classes = sets.where("n > 0").groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"))

    frequent = spark.sparkContext.broadcast(_order(profile, parts))
    edges = stage(
        rows.mapInArrow(_prefixes(parts, frequent), "part int, blob binary").groupBy("part")
        .applyInArrow(_edges, "a long, b long, need long, hits long")
        .groupBy("a", "b").agg(F.sum("hits").alias("hits"), F.min("need").alias("need")).where("hits >= need").select("a", "b"),
        "shingle-edges",
    )
    group = components(edges, "shingle-groups").withColumnRenamed("node", "doc_id").withColumnRenamed("label", "family")

    tokens = rows.mapInArrow(_wanted_sets(_bitmap(group.select("doc_id"))), "doc_id long, n long, tokens binary")
    members = stage(tokens.join(group, "doc_id"), "shingle-sets")
    level = F.floor(F.log(F.col("n")) / F.log(F.lit(SIZE_STEP)))
    whole = members.groupBy("family").agg(F.count("*").alias("members"))
    cut = members.groupBy("family", level.alias("level")).agg(F.count("*").alias("alike"))
    sizes = cut.join(whole, "family")
    placed = (
        members.withColumn("level", level).join(sizes, ["family", "level"])
        .withColumn("large", F.col("members") > PART)
        .withColumn("level", F.when(F.col("large"), F.col("level")))
        .withColumn("part", F.when(F.col("large"), F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("alike") / PART))))
        .select("doc_id", "family", "large", "level", "part", "tokens")
    )
    placed = stage(placed, "shingle-parts")
    middles = placed.where("large AND doc_id = family").groupBy("family").agg(F.min_by("doc_id", "tokens").alias("doc_id"), F.min("tokens").alias("tokens"))
    joined = placed.where("large").select("family", "large", "level", "part").distinct().join(middles, "family").select(placed.columns)
    inside = stage(
        placed.unionByName(joined).groupBy("family", "level", "part").applyInArrow(_links_inside, "a long, b long, family long"),
        "shingle-links",
    )
    # Parts of large groups: sets not linked to the middle inside their part query the parts of fitting size.
    linked_to_middle = inside.where("b = family").select(F.col("a").alias("doc_id")).distinct()
    asking = placed.where("large").join(linked_to_middle, "doc_id", "left_anti").select("doc_id", "family", F.col("level").alias("own"), "tokens")
    reach = int(np.ceil(np.log(DENOMINATOR / NUMERATOR) / np.log(SIZE_STEP)))
    targets = placed.where("large").groupBy("family", "level", "part").agg(F.count("*").alias("members"))
    asked = asking.join(targets, "family").where(F.abs(F.col("own") - F.col("level")) <= reach)
    waiting = asking.groupBy("family").agg(F.ceil(F.count("*") / QUERIES).alias("salts"))
    asked = asked.join(waiting, "family").withColumn("salt", F.pmod(F.xxhash64("doc_id"), "salts"))
    salted = placed.where("large").join(waiting, "family").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    key = ["family", "level", "part", "salt"]
    asked = stage(asked.select(*key, "doc_id", "tokens"), "shingle-queries")
    across = (
        asked.groupBy(*key)
        .cogroup(salted.select(*key, "doc_id", "tokens").groupBy(*key)).applyInArrow(_links_across, "a long, b long")
    )
    final = components(inside.select("a", "b").unionByName(across), "shingle-components")
    return (
        sets.join(classes, ["s1", "s2"], "left")
        .join(final.withColumnRenamed("node", "rep"), "rep", "left")
        .select(
            "doc_id", F.col("n").alias("n_shingles"),
            F.when(F.col("n") > 0, F.coalesce("label", "rep", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
        )
    )
