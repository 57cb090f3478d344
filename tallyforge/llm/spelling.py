"""Words grouped with their misspellings, by a dictionary of pairs of trie nodes.

All words stand in a forward trie and, read backwards, in a reversed trie, whose nodes are numbered. Two words differ by one
replaced code point exactly if skipping one position in each leaves the same pair of integers (node of the prefix before it, node of the suffix after it).
They differ by one inserted code point exactly if the pair that skipping a position leaves in the longer word is the pair at which
the shorter one is cut there. So an equi-join on pairs of integers gives all neighbours, and nothing else.

A pair of nodes has few words: those that skip there differ in that one code point (at most as many as the alphabet has letters), and only one word is cut
there, as prefix and suffix make it up. Of a repeated letter only the first is skipped for insertions, so each neighbour is met once.
What a word needs of its neighbours (their number, the most frequent of them) is added up within each pair, so pairs of words are never listed.

Trie nodes are numbered by sorted order: node of depth i is named by the rank of the first word with those i code points. Sorted
parts number their own nodes along the way, and a node that runs over the edge of a part takes the name it has in the part
before; only the first and last word of each part are looked at for that.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.session import stage

#: Code points a word has at least, occurrences it has at least, and how many times as frequent its form is.
LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
#: Words counted in a task before the counts are sent on.
HELD = 200_000
#: Bits for the rank of a word within its part.
RANK_BITS = 40

_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = {code: code + 32 for code in range(65, 91)}


def _counted(batches: Iterator[pa.RecordBatch], planted: int | None) -> Iterator[pa.RecordBatch]:
    counts: Counter[str] = Counter()

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])

    for batch in batches:
        for key, text in zip(batch.column("key"), batch.column("text")):
            own = Counter(_RUN.findall((text.as_py() or "").translate(_LOWER)))
            start = None if planted is None or not key.is_valid else zlib.crc32(f"{key.as_py()}:".encode())
            for word, n in own.items():
                if len(word) < LEAST_LENGTH:
                    continue
                if start is not None:
                    h = zlib.crc32(word.encode(), start)
                    if h % planted == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < LEAST_LENGTH:
                            continue
                counts[word] += n
            if len(counts) >= HELD:
                yield flush()
                counts.clear()
    if counts:
        yield flush()


def word_counts(docs: DataFrame, planted: int | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``word``, ``n`` of every run of letters (A-Z in lower case) that is long and frequent enough, over all rows.

    With ``planted``, of a run for which that number divides the CRC-32 of ``<id>:<run>`` one code point goes, as the contract plants misspellings;
    rows without an id have none. Equal runs of a row are counted first, then those of a task, so a word that all rows hold
    is sent a few times by each task. Null texts have no words.
    """
    rows = docs.select(F.col(id_column).cast("string").alias("key"), F.col(text_column).alias("text"))
    found = rows.mapInArrow(lambda batches: _counted(batches, planted), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _shared(a: str, b: str) -> int:
    """Code points that two words begin with alike."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return next(i for i in range(n) if a[i] != b[i])


def _ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranks of the sorted words of a part, and the name of the node after 0, 1, ... code points of each."""
    base = TaskContext.get().partitionId() << RANK_BITS
    rank, last, nodes = base, "", []
    for batch in batches:
        ranks, paths = [], []
        for word in batch.column("_key"):
            word = word.as_py()
            nodes = nodes[: _shared(last, word) + 1]
            nodes = nodes + [rank] * (len(word) + 1 - len(nodes))
            ranks.append(rank)
            paths.append(nodes)
            rank, last = rank + 1, word
        columns = [*batch.columns, pa.array(ranks, pa.int64()), pa.array(paths, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "_rank", "_nodes"])


def with_nodes(words: DataFrame, key: Column, rank: str, nodes: str) -> DataFrame:
    """Words with the rank of a key in sorted order (no gaps within a part) and the numbers of the trie nodes along it.

    Parts are cut by sampled quantiles, and keys differ, so none is hot.
    """
    spark = words.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = words.withColumn("_key", key).repartitionByRange(parts, "_key").sortWithinPartitions("_key")
    added = [T.StructField("_rank", T.LongType()), T.StructField("_nodes", T.ArrayType(T.LongType()))]
    ranked = stage(ranged.mapInArrow(_ranked, T.StructType([*ranged.schema.fields, *added])), "trie")
    part = F.shiftright("_rank", RANK_BITS)
    edges = ranked.groupBy(part.alias("part")).agg(
        F.min("_key").alias("first"), F.max("_key").alias("last"), F.max_by("_nodes", "_key").alias("path")
    )
    names, before = [], None  # of the nodes of each part's first word that the part before has; one row for each part
    for row in edges.orderBy("part").collect():
        inherited = []
        if before is not None:
            inherited = before[1][: _shared(before[0], row["first"]) + 1]
            names.append((row["part"] << RANK_BITS, inherited))
        own = row["part"] << RANK_BITS
        path = [inherited[i] if name == own and i < len(inherited) else name for i, name in enumerate(row["path"])]
        before = (row["last"], path)
    renamed = spark.createDataFrame(names, "own long, inherited array<long>")
    joined = ranked.join(F.broadcast(renamed), F.shiftleft(part, RANK_BITS) == F.col("own"), "left")
    known = F.transform("_nodes", lambda name, i: F.when((name == F.col("own")) & (i < F.size("inherited")), F.get("inherited", i)).otherwise(name))
    path = F.when(F.col("own").isNull(), F.col("_nodes")).otherwise(known)
    return joined.select(*words.columns, F.col("_rank").alias(rank), path.alias(nodes))


def neighbours(words: DataFrame) -> DataFrame:
    """``rank``, ``word``, ``n``, ``n_near`` (words at edit distance one) and ``best`` (n, rank of the most frequent one) of each word.

    ``best`` is null without a neighbour; equal counts go to the word first in code-point order, which is the order of ranks.
    """
    numbered = with_nodes(words, F.col("word"), "rank", "before")
    numbered = stage(with_nodes(numbered, F.reverse("word"), "back", "after"), "words")
    length = F.size("before") - 1  # told without walking through the word for each of its positions
    # (place, prefix node, code points of the suffix, suffix node, whether cut, whether also an insertion)
    skipped = F.transform(
        F.sequence(F.lit(0), length - 1),
        lambda i: F.struct(
            i.alias("i"), F.get("before", i).alias("p"), (length - 1 - i).alias("j"), F.get("after", length - 1 - i).alias("s"),
            F.lit(False).alias("cut"), ((i == 0) | (F.get("letters", i) != F.get("letters", i - 1))).alias("first"),
        ),
    )
    cut = F.transform(
        F.sequence(F.lit(0), length),
        lambda i: F.struct(i.alias("i"), F.get("before", i).alias("p"), (length - i).alias("j"), F.get("after", length - i).alias("s"), F.lit(True).alias("cut"), F.lit(False).alias("first")),
    )
    # Never empty; the outer form keeps Spark from filtering by the array first, which would make it twice.
    pairs = numbered.withColumn("letters", F.split("word", "")).select("rank", "n", F.inline_outer(F.concat(skipped, cut)))
    member = F.struct((-F.col("n")).alias("less"), "rank", "cut", "first")
    groups = pairs.groupBy("i", "p", "j", "s").agg(F.array_sort(F.collect_list(member)).alias("all")).where(F.size("all") > 1)

    def seen(m: Column) -> Column:
        """Neighbours of one member within its pair, most frequent first."""
        others = F.filter(
            "all", lambda o: (o["rank"] != m["rank"]) & F.when(m["cut"], o["first"]).when(o["cut"], m["first"]).otherwise(F.lit(True))
        )
        return F.struct(m["rank"].alias("rank"), F.size(others).alias("near"), F.get(F.transform(others, lambda o: F.struct(o["less"], o["rank"])), F.lit(0)).alias("best"))

    told = groups.select(F.inline(F.transform("all", seen))).where("near > 0")
    known = told.groupBy("rank").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))
    joined = numbered.select("rank", "word", "n").join(known, "rank", "left")
    best = F.when(F.col("best").isNotNull(), F.struct((-F.col("best.less")).alias("n"), F.col("best.rank").alias("rank")))
    return joined.select("rank", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), best.alias("best"))


def variants(words: DataFrame) -> DataFrame:
    """``word``, ``n``, ``n_near``, ``form``, ``form_n``, ``root`` of each of the words (columns ``word``, ``n``; each word once).

    A word's form is its most frequent neighbour, if ``RATIO`` times as frequent as itself; its root is the form that has none.
    Counts grow along forms, so chains are short, and doubling follows them in a few joins. Words may be of any length. Without words there are no rows.
    """
    known = stage(neighbours(words), "neighbours")
    to = F.when(F.col("best.n") >= RATIO * F.col("n"), F.col("best.rank"))
    links = known.select("rank", to.alias("form")).where("form IS NOT NULL")
    reached = stage(links.select("rank", F.col("form").alias("root")), "roots")
    while True:
        after = reached.select(F.col("rank").alias("root"), F.col("root").alias("further"))
        if not reached.join(after, "root", "left_semi").limit(1).count():
            break
        reached = stage(reached.join(after, "root", "left").select("rank", F.coalesce("further", "root").alias("root")), "roots")
    named = known.select("rank", "word", "n")
    forms = links.join(named.toDF("form", "form_word", "form_n"), "form").select("rank", "form_word", "form_n")
    roots = reached.join(named.toDF("root", "root_word", "_n"), "root").select("rank", "root_word")
    out = known.join(forms, "rank", "left").join(roots, "rank", "left")
    return out.select("word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")
